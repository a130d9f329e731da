"""Admission as a stream whose result doesn't depend on how calls fall into batches.

A call waits in its model's state until the watermark has passed it, so that calls are offered in order of time whatever batch
brought them; then it meets the same gate as in batch, and leaves the state. However many wait, a task holds some of them only
(groundwell.streaming.waiting). A timer at the earliest waiting call wakes a model that gets no more calls. What is kept of
accepted calls goes after RETENTION. A call that comes after its time was passed can't change what is decided: it goes to the
side output, as `late`. Spark itself drops what is older than its watermark, so that one is set GRACE_MS further back, and the
time that counts here is GRACE_MS ahead of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from groundwell.operators.admission import ANSWER, Gate, with_limits
from groundwell.streaming.waiting import Waiting

RETENTION = 130_000_000
LATE_MS, GRACE_MS = 600_000, 86_400_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = f"event_id long, model string, day long, admitted boolean, {ANSWER}, late boolean"
_WAITING = "us long, event_id long, tokens long, day long, reset_us long, rpm long, tpm long, rpd long, tpd long"
_HELD = "us long, tokens long"
_ARROW = pa.schema([(c.split(" ")[0], pa.int64()) for c in _WAITING.split(", ")])
#: Calls that are answered at once.
CHUNK = 20_000


def _frame(rows: list[tuple]) -> pd.DataFrame:
    """Rows of OUT."""
    return pd.DataFrame({c.split(" ")[0]: pd.array(x, dtype="object") for c, x in zip(OUT.split(", "), zip(*rows, strict=True), strict=True)})


def _values(column: pa.ChunkedArray) -> list:
    """to_pylist, in a tenth of its time where all values are there."""
    if column.null_count == len(column):
        return [None] * len(column)
    return column.to_pylist() if column.null_count else column.to_numpy().tolist()


class AdmissionProcessor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = Waiting(handle, "waiting", _ARROW, ["us", "event_id"])
        self.held = handle.getListState("held", _HELD)
        self.day = handle.getValueState("day", "day long, n long, tokens long, passed long")

    def _answers(self, key: tuple, frames: Iterator[pd.DataFrame], watermark_ms: int) -> Iterator[pd.DataFrame]:
        """Takes rows in and offers what the time has passed."""
        now_ms = watermark_ms + GRACE_MS if watermark_ms else 0
        gate = Gate()
        passed = -1
        if self.day.exists():
            day, n, tokens, passed = self.day.get()
            gate.day, gate.n_day, gate.tokens_day = day, n, tokens
        for us, tokens in self.held.get():
            gate.held.append((us, tokens))
            gate.used += tokens
        now = now_ms * 1000
        self.waiting.begin()
        for frame in frames:
            rows = pa.Table.from_pandas(frame[_ARROW.names], _ARROW, preserve_index=False)
            if rows["us"].null_count:
                raise ValueError("a call has no time")
            gone = pc.less_equal(rows["us"], passed)
            self.waiting.add(rows.filter(pc.invert(gone)))
            if late := [(r["event_id"], key[0], r["day"], False, *[None] * 7, True) for r in rows.filter(gone).to_pylist()]:
                yield _frame(late)
        for ready in self.waiting.passed(now):
            for at in range(0, len(ready), CHUNK):
                calls = zip(*map(_values, ready.slice(at, CHUNK).columns), strict=True)
                yield _frame([(e, key[0], day, a[0] is None, *a, False) for us, e, tokens, day, *rest in calls for a in [gate.offer(us, tokens, day, *rest)]])
        kept = [h for h in gate.held if h[0] >= now - RETENTION]
        self.held.put(kept) if kept else self.held.clear()
        self.day.update((gate.day, gate.n_day, gate.tokens_day, max(passed, now - 1)))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if self.waiting.first is not None:
            self.handle.registerTimer(max(self.waiting.first // 1000 + 1 - GRACE_MS, watermark_ms + 1))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield from self._answers(key, rows, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._answers(key, iter(()), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def admission(stream: DataFrame, limits: DataFrame, late_ms: int = LATE_MS) -> DataFrame:
    """A stream of calls (event_id, us, model, tokens) to the columns of OUT. The session needs the RocksDB state store."""
    rows = with_limits(stream, limits).withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", f"{late_ms + GRACE_MS} milliseconds")
    columns = ["model", "ts", *[c.split(" ")[0] for c in _WAITING.split(", ")]]
    whole = rows.select("model", "ts", *[F.col(c).cast("long").alias(c) for c in columns[2:]])
    return whole.groupBy("model").transformWithStateInPandas(AdmissionProcessor(), OUT, "Append", "EventTime")


def run_admission(spark: SparkSession, folder: str, schema: str, limits: DataFrame, path: str, files: int = 1, late_ms: int = LATE_MS) -> DataFrame:
    """Runs the stream over a folder of Parquet files, so many in a batch, to its end; what it answered. The last calls are answered when a later
    one moves the watermark past them."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    calls = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    sink = lambda df, batch: df.write.mode("overwrite").parquet(f"{path}/out/batch={batch}")  # noqa: E731  a repeated batch replaces itself
    query = admission(calls, limits, late_ms).writeStream.outputMode("append").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()
    return spark.read.schema(OUT).parquet(f"{path}/out/*")
