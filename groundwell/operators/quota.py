"""Calls of models against limits a minute and a day, and analytics of run traces. Batch forms; the streaming ones are in groundwell.streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MINUTE = 60_000_000
#: Limits of the stand-in models: requests and tokens a minute and a day, and the zone in which a model's day begins.
RPM, TPM, RPD, TPD = 30, 8000, 1000, 200_000
ZONES = {"click": "America/Los_Angeles", "error": "UTC", "purchase": "America/Los_Angeles", "signup": "UTC", "view": "UTC"}
DAY = 86_400_000_000


def zone(model: Column) -> Column:
    return F.coalesce(*[F.when(model == m, z) for m, z in ZONES.items()], F.lit("UTC"))


def local_day(us: Column, model: Column) -> Column:
    """The day number in the model's own zone, summer time included."""
    return F.floor(F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), zone(model))) / DAY).cast("long")


def seconds_to_reset(us: Column, model: Column) -> Column:
    """From a time to the end of the model's day: its midnight and 24 hours, whatever the clocks do on that day."""
    midnight = F.to_utc_timestamp(F.timestamp_micros(local_day(us, model) * F.lit(DAY)), zone(model))
    return (F.unix_micros(midnight) + F.lit(DAY) - us) / 1_000_000


def minute_windows(calls: DataFrame) -> DataFrame:
    """calls (event_id, us, model, tokens): adds n_minute, tokens_minute and oldest of the 60 s before each call, itself left out.

    A call goes to its own minute's group and, as context, to the next one: so a busy model is many groups, not one."""
    m = F.floor(F.col("us") / MINUTE)
    spread = calls.withColumn("minute", F.explode(F.array(m, m + 1)))
    w = Window.partitionBy("model", "minute").orderBy("us").rangeBetween(-MINUTE, 0)
    seen = spread.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("t", F.sum("tokens").over(w)).withColumn("oldest", F.min("us").over(w))
    own = seen.where(F.col("minute") == F.floor(F.col("us") / MINUTE))
    return own.select(*calls.columns, (F.col("n") - 1).alias("n_minute"), (F.col("t") - F.col("tokens")).alias("tokens_minute"), F.when(F.col("n") > 1, F.col("oldest")).alias("oldest"))
