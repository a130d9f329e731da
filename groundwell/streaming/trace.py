"""A trace log of JSON lines as a stream: broken lines go to a table of their own, and spans come from a stack that is kept as state.

Two queries, each with its own checkpoint: the first reads the lines as they come and writes events and broken lines; the
second reads the events. An event waits in its run's state until the watermark has passed it, so that the stack sees a run's
events in order of (us, seq) whatever batch brought them. What is still open when a stream ends is not written.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from groundwell.operators.spans import EVENT, SPAN, Stack
from groundwell.streaming.admission import ROCKSDB

LATE = "10 minutes"
_COLUMNS = [c.split(" ")[0] for c in EVENT.split(", ")]

_ARROW = pa.schema([(c.split(" ")[0], pa.int64() if c.endswith("long") else pa.string()) for c in EVENT.split(", ")])
#: Events of a run in a value of its state, and those that go through the stack at once.
CHUNK = 50_000


def chunks(events: pa.Table) -> Iterator[tuple[bytes]]:
    """Events as values of the state; its strings are few, and are written once a chunk."""
    for at in range(0, len(events), CHUNK):
        some = events.slice(at, CHUNK).combine_chunks()
        some = pa.table([c.dictionary_encode() if pa.types.is_string(c.type) else c for c in some.columns], names=some.column_names)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, some.schema) as out:
            out.write_table(some)
        yield (sink.getvalue().to_pybytes(),)


def unpacked(chunk: bytes) -> pa.Table:
    return pa.ipc.open_stream(bytes(chunk)).read_all().cast(_ARROW)


class SpanProcessor(StatefulProcessor):
    """Waiting events are kept in chunks, each an Arrow table of up to CHUNK rows, so that the state is asked for some values of a run and not for
    each event. Chunks are only added until the watermark has passed the earliest event, which stands beside the stack."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "events binary")
        self.stack = handle.getValueState("stack", "opened string, last_left string, earliest long")

    def _answers(self, frames: Iterator[pd.DataFrame], watermark_ms: int) -> Iterator[pd.DataFrame]:
        opened, left, earliest = self.stack.get() if self.stack.exists() else ("[]", None, None)
        fresh = pa.Table.from_batches([pa.RecordBatch.from_pandas(f[_COLUMNS], _ARROW, preserve_index=False) for f in frames], _ARROW)
        first = min([x for x in (earliest, pc.min(fresh["us"]).as_py()) if x is not None], default=None)
        if first is not None and first < watermark_ms * 1000:
            events = pa.concat_tables([*[unpacked(x[0]) for x in self.waiting.get()], fresh]).sort_by([("us", "ascending"), ("seq", "ascending")])
            n = pc.sum(pc.less(events["us"], watermark_ms * 1000)).as_py()
            stack = Stack(json.loads(opened), left)
            for at in range(0, n, CHUNK):
                some = events.slice(at, min(CHUNK, n - at))
                out = [s for r in zip(*(c.to_pylist() for c in some.columns), strict=True) for s in stack.offer(*r)]
                if out:
                    yield pd.DataFrame({c.split(" ")[0]: pd.array([r[k] for r in out], dtype="object") for k, c in enumerate(SPAN.split(", "))})
            rest = events.slice(n)
            self.waiting.put(list(chunks(rest))) if len(rest) else self.waiting.clear()
            opened, left, first = json.dumps(stack.opened), stack.left, rest["us"][0].as_py() if len(rest) else None
        elif len(fresh):
            self.waiting.appendList(list(chunks(fresh)))
        self.stack.update((opened, left, first))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if first is not None:
            self.handle.registerTimer(max(first // 1000 + 1, watermark_ms + 1))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield from self._answers(rows, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._answers(iter(()), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def ingest(spark: SparkSession, folder: str, schema: str, path: str, files: int = 1) -> None:
    """Reads a folder of JSON lines to its end: events to path/events, lines that can't be read to path/broken. Blank lines are no lines."""
    lines = spark.readStream.schema(f"{schema}, broken string").option("columnNameOfCorruptRecord", "broken").option("mode", "PERMISSIVE").option("maxFilesPerTrigger", files).json(folder)

    def split(df: DataFrame, batch: int) -> None:
        df.where("broken is null").drop("broken").write.mode("overwrite").parquet(f"{path}/events/batch={batch}")
        df.where("broken is not null").select("broken").write.mode("overwrite").parquet(f"{path}/broken/batch={batch}")

    lines.writeStream.option("checkpointLocation", f"{path}/lines-state").trigger(availableNow=True).foreachBatch(split).start().awaitTermination()


def span_stream(events: DataFrame, late: str = LATE) -> DataFrame:
    """A stream of events to rows of SPAN. The session needs the RocksDB state store."""
    rows = events.select(*_COLUMNS).where("run is not null and us is not null and seq is not null").withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", late)
    return rows.groupBy("run").transformWithStateInPandas(SpanProcessor(), SPAN, "Append", "EventTime")


def run_spans(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """Spans and routes of the events that ingest wrote."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{path}/events/*")
    sink = lambda df, batch: df.write.mode("overwrite").parquet(f"{path}/spans/batch={batch}")
    span_stream(events).writeStream.outputMode("append").option("checkpointLocation", f"{path}/spans-state").trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
    return spark.read.schema(SPAN).parquet(f"{path}/spans/*")
