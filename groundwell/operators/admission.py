"""Admission of calls to models, in order of time: a call that a limit stops leaves no trace in what later calls meet.

The rule needs the calls before in order, so it is a fold. It is cut wherever the order doesn't matter: where a model was idle
for over a minute nothing of the minute's window is left, and the calls on both sides are pieces of their own. Pieces are
folded in parallel without the day's limits, which gives what each day would accept. Days run together into a span where no
idle minute parts them; only the spans with a day that can reach a limit are folded once more, whole and with the day's limits.
A task holds a minute of accepted calls of one model.

Limits are a table: model, rpm, tpm, rpd, tpd (null: none) and zone, whose midnight begins a model's day (null: UTC). Models
without a row have no limits. Calls at the same time go by event_id; a null time or model is an error.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwell.operators.quota import DAY, MINUTE
from groundwell.operators.retrieval import small
from groundwell.sources.work import saved

ANSWER = "blocked_by string, wait_us long, recoverable boolean, n_minute long, tokens_minute long, n_day long, tokens_day long"


class Gate:
    """A model's accepted calls of the last minute, and of its day."""

    def __init__(self) -> None:
        self.held: deque[tuple[int, int]] = deque()
        self.used = 0
        self.day: int | None = None
        self.n_day = self.tokens_day = 0

    def offer(self, us: int, tokens: int, day: int, reset_us: int, rpm: int | None, tpm: int | None, rpd: int | None, tpd: int | None) -> tuple:
        """The fields of ANSWER; the call is recorded if nothing stops it. Day limits are asked first, and aren't over before the day is."""
        if day != self.day:
            self.day, self.n_day, self.tokens_day = day, 0, 0
        while self.held and self.held[0][0] < us - MINUTE:
            self.used -= self.held.popleft()[1]
        seen = (len(self.held), self.used, self.n_day, self.tokens_day)
        if rpd is not None and self.n_day + 1 > rpd:
            return "rpd", reset_us, False, *seen
        if tpd is not None and self.tokens_day + tokens > tpd:
            return "tpd", reset_us, False, *seen
        wait = max(0, self.held[0][0] + MINUTE - us) if self.held else 1_000_000
        if rpm is not None and len(self.held) + 1 > rpm:
            return "rpm", wait, True, *seen
        if tpm is not None and self.used + tokens > tpm:
            return ("tpm", 0, False, *seen) if tokens > tpm else ("tpm", wait, True, *seen)
        self.held.append((us, tokens))
        self.used += tokens
        self.n_day += 1
        self.tokens_day += tokens
        return None, None, None, *seen


def with_limits(calls: DataFrame, limits: DataFrame) -> DataFrame:
    """calls (event_id, us, model, tokens) with the model's limits, day (its number in the model's zone) and reset_us (to the end of that day)."""
    rows = calls.select("event_id", "us", "model", "tokens").join(small(limits.withColumnRenamed("model", "_model")), F.col("model") == F.col("_model"), "left").drop("_model")
    zone = F.coalesce("zone", F.lit("UTC"))
    day = F.floor(F.unix_micros(F.from_utc_timestamp(F.timestamp_micros("us"), zone)) / DAY).cast("long")
    midnight = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(day * F.lit(DAY)), zone))
    return rows.withColumn("day", day).withColumn("reset_us", midnight + F.lit(DAY) - F.col("us")).drop("zone")


def _folded(rows: DataFrame, unit: str) -> DataFrame:
    """Rows of with_limits, with `unit`, folded by model and unit in order of time; adds the columns of ANSWER."""
    columns = ["model", unit, "us", "event_id", "tokens", "day", "reset_us", "rpm", "tpm", "rpd", "tpd"]
    names = [c.split(" ")[0] for c in ANSWER.split(", ")]
    types = [pa.string(), pa.int64(), pa.bool_(), *[pa.int64()] * 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, gate = None, Gate()
        for batch in batches:
            out = []
            for m, u, us, _, tokens, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (m, u) != key:
                    key, gate = (m, u), Gate()
                out.append(gate.offer(us, tokens, *rest))
            made = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], *made], names=[*columns[:7], *names])

    ordered = rows.select(*columns).repartition("model", unit).sortWithinPartitions("model", unit, "us", "event_id")
    kinds = dict(rows.dtypes)
    return ordered.mapInArrow(run, ", ".join([*[f"{c} {kinds[c]}" for c in columns[:7]], ANSWER]))


def _pieces(rows: DataFrame) -> DataFrame:
    """model, minute, piece and span: both are counted over a model's minutes, not over its calls."""
    minutes = rows.groupBy("model", F.floor(F.col("us") / MINUTE).alias("minute")).agg(F.min(F.struct("us", "day")).alias("a"), F.max(F.struct("us", "day")).alias("b"))
    by_time = Window.partitionBy("model").orderBy("minute")
    before = F.lag("b").over(by_time)
    cut = before.isNull() | (F.col("a.us") - before["us"] > MINUTE)
    marked = minutes.select("model", "minute", cut.cast("int").alias("cut"), (cut & F.coalesce(F.col("a.day") != before["day"], F.lit(True))).cast("int").alias("apart"))
    return marked.select("model", "minute", F.sum("cut").over(by_time).alias("piece"), F.sum("apart").over(by_time).alias("span"))


def admitted(calls: DataFrame, limits: DataFrame) -> DataFrame:
    """calls (event_id, us, model, tokens) to event_id, model, day, admitted and the columns of ANSWER: what a call met, and which limit stopped it."""
    rows = with_limits(calls, limits).withColumn("minute", F.floor(F.col("us") / MINUTE))
    rows = saved(rows.join(_pieces(rows), ["model", "minute"]).drop("minute"), "pieces")
    none = F.lit(None).cast("long")
    free = saved(_folded(rows.withColumns({"rpd": none, "tpd": none}), "piece"), "free")
    ok = F.col("blocked_by").isNull()
    of_piece = free.groupBy("model", "day", "piece").agg(F.sum(ok.cast("long")).alias("n"), F.coalesce(F.sum(F.when(ok, F.col("tokens"))), F.lit(0)).alias("t"), F.max("tokens").alias("most"))
    spans = rows.select("model", "day", "piece", "span", "rpd", "tpd").distinct()
    of_piece = saved(of_piece.join(spans, ["model", "day", "piece"]), "sums")
    # what a day accepts without its limits, and a call more: if that stays under them, they never stop one
    days = of_piece.groupBy("model", "span", "day").agg(F.sum("n").alias("n"), F.sum("t").alias("t"), F.max("most").alias("most"), F.first("rpd").alias("rpd"), F.first("tpd").alias("tpd"))
    can: Column = F.coalesce(F.col("n") + 1 > F.col("rpd"), F.lit(False)) | F.coalesce(F.col("t") + F.col("most") > F.col("tpd"), F.lit(False))
    bound = saved(days.where(can).select("model", "span").distinct(), "bound")
    earlier = Window.partitionBy("model", "day").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    base = of_piece.select("model", "day", "piece", "span", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("t0"))
    base = base.join(small(bound), ["model", "span"], "left_anti").drop("span")
    whole = _folded(rows.join(small(bound), ["model", "span"], "left_semi"), "span")
    parts = free.join(base, ["model", "day", "piece"]).withColumns({"n_day": F.col("n_day") + F.col("n0"), "tokens_day": F.col("tokens_day") + F.col("t0")})
    names = [c.split(" ")[0] for c in ANSWER.split(", ")]
    out = ["event_id", "model", "day", ok.alias("admitted"), *names]
    return parts.select(*out).unionByName(whole.select(*out))
