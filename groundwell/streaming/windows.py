"""Streaming forms: event-time windows with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwell.sources.tables import read
from groundwell.sources.work import work_path

LATE = "10 minutes"


def windowed(c: DataFrame, length: str, slide: str | None = None) -> DataFrame:
    """Calls and tokens by model and window; the same plan in batch and streaming."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    g = c.groupBy("model", w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"))
    return g.select("model", F.unix_micros("w.start").alias("start_us"), "n", "tokens")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files."""
    e = spark.readStream.schema(read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "user_id", F.col("event_type").alias("model"), F.floor(F.col("value") * 10).cast("long").alias("tokens"))


def _to_end(stream: DataFrame, path: str, mode: str) -> None:
    """Runs a stream over what is there now. Each batch's rows go to a folder of its own, so that a repeated batch replaces itself."""
    sink = lambda df, batch: df.write.mode("overwrite").parquet(f"{path}/out/batch={batch}")
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()


def run_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows of an hour over the stream of events; the last state of each window."""
    path = work_path(spark, "windows")
    _to_end(windowed(event_stream(spark, sf_dir).withWatermark("ts", LATE), "1 hour"), path, "update")
    schema = "model string, start_us long, n long, tokens long, batch long"
    found = spark.read.schema(schema).parquet(f"{path}/out")
    last = found.groupBy("model", "start_us").agg(F.max(F.struct("batch", "n", "tokens")).alias("x"))
    return last.select("model", "start_us", "x.n", "x.tokens")
