"""Spans and routes of run traces, by a stack of open nodes for each run.

An entry puts a node on the stack; its exit, or an error of that node, takes it off. An exit belongs to the innermost open
span of its node: spans above it, whose exits were lost, end as `lost`, without a duration. An exit without an entry is
`unmatched`. What is open in the end is `open`. A route comes from what it says itself, or else from the innermost open
node, or else from the node that was left last.

A run of any size is cut into ranges of (us, seq), and a task reduces a range: what it can pair without knowing the stack before it
becomes rows at once. An exit whose node isn't open within the range ends a segment: what it does depends on the stack before. The
entries that are still open then, and the exit itself, are left over, and are folded in order by run; where spans nest, these are few.
The fold tells each segment its stack's depth, top and last left node, and a join puts them into the segment's rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwell.sources.work import saved

EVENT = "run long, us long, seq long, type string, node string, from_node string, to_node string, reason string"
SPAN = "run long, kind string, seq long, node string, depth int, parent string, enter_us long, exit_us long, state string, to_node string, reason string"
#: A row of a range, or what is left over of it: its range, segment, and place in the segment (null of a row).
PART = f"{SPAN}, range int, segment int, place int"
_TYPES = {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}


class Stack:
    """The open nodes of a run as (seq, node, us), the innermost last, and the node that was left last."""

    def __init__(self, opened: list[tuple[int, str, int]] | None = None, left: str | None = None) -> None:
        self.opened = [tuple(x) for x in opened or []]
        self.left = left

    def _span(self, run: int, at: int, exit_us: int | None, state: str) -> tuple:
        seq, node, us = self.opened[at]
        return run, "span", seq, node, at, self.opened[at - 1][1] if at else None, us, exit_us, state, None, None

    def offer(self, run: int, us: int, seq: int, kind: str | None, node: str | None, from_node: str | None, to_node: str | None, reason: str | None) -> list[tuple]:
        """The rows of SPAN that an event completes. Entries and exits without a node are none."""
        if kind != "route" and not node:
            return []
        if kind == "node_enter":
            self.opened.append((seq, node, us))
            return []
        if kind == "route":
            at = from_node or (self.opened[-1][1] if self.opened else None) or self.left
            return [(run, "route", seq, at, len(self.opened), None, us, None, None, to_node, reason)]
        if kind not in ("node_exit", "error"):
            return []
        at = next((k for k in range(len(self.opened) - 1, -1, -1) if self.opened[k][1] == node), None)
        if at is None:
            return [(run, "span", seq, node, len(self.opened), None, None, us, "unmatched", None, None)]
        out = [self._span(run, k, None, "lost") for k in range(len(self.opened) - 1, at, -1)] + [self._span(run, at, us, "closed" if kind == "node_exit" else "error")]
        del self.opened[at:]
        self.left = node
        return out

    def rest(self, run: int) -> list[tuple]:
        """What is still open."""
        return [self._span(run, k, None, "open") for k in range(len(self.opened) - 1, -1, -1)]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    fields = [c.split(" ") for c in PART.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[f[1]]) for c, f in zip(columns, fields, strict=True)], names=[f[0] for f in fields])


class _Range:
    """What a range of a run makes of its events: rows with depths and parents within the segment, and what is left over for the fold."""

    def __init__(self, run: int | None, number: int) -> None:
        self.run, self.number, self.segment, self.place, self.told, self.stack = run, number, 0, 0, False, Stack()

    def _left_over(self, kind: str, seq: int | None = None, node: str | None = None, us: int | None = None) -> tuple:
        """A segment that has rows asks for its stack by a `start`, which is in place 0."""
        self.place += kind != "start"
        return self.run, kind, seq, node, None, None, us, None, None, None, None, self.number, self.segment, 0 if kind == "start" else self.place

    def _rows(self, rows: list[tuple]) -> list[tuple]:
        start = [] if self.told or not rows else [self._left_over("start")]
        self.told = self.told or bool(rows)
        return start + [(*r, self.number, self.segment, None) for r in rows]

    def offer(self, us: int, seq: int, kind: str | None, node: str | None, from_node: str | None, to_node: str | None, reason: str | None) -> list[tuple]:
        opened = self.stack.opened
        if kind == "route":
            top = from_node or (opened[-1][1] if opened else None)
            # where the segment knows no node, its stack's top comes before the node that was left last within it
            return self._rows([(self.run, "route", seq, top, len(opened), self.stack.left, us, None, None, to_node, reason)])
        if kind not in ("node_exit", "error") or not node or any(x[1] == node for x in opened):
            return self._rows(self.stack.offer(self.run, us, seq, kind, node, None, None, None))
        out = [*self.rest(), self._left_over(kind, seq, node, us)]
        self.segment, self.place, self.told, self.stack = self.segment + 1, 0, False, Stack()
        return out

    def rest(self) -> list[tuple]:
        """The entries that are open, and the node that was left last."""
        left = [] if self.stack.left is None else [self._left_over("left", node=self.stack.left)]
        return left + [self._left_over("node_enter", *x) for x in self.stack.opened]


def _reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: _Range | None = None
    for batch in batches:
        out: list[tuple] = []
        for run, us, seq, *event, number in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or run != now.run:
                out += now.rest() if now else []
                now = _Range(run, number)
            out += now.offer(us, seq, *event)
        yield _batch(out)
    if now:
        yield _batch(now.rest())


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left over of a run, in order: its spans, and of each segment that asks the depth, top and last left node of the stack before it."""
    now, stack = None, Stack()
    for batch in batches:
        out: list[tuple] = []
        for run, kind, seq, node, us, number, segment in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if run != now:
                out += [(*r, None, None, None) for r in stack.rest(now)]
                now, stack = run, Stack()
            if kind == "start":
                top = stack.opened[-1][1] if stack.opened else None
                out.append((run, "start", None, top, len(stack.opened), stack.left, None, None, None, None, None, number, segment, 0))
            elif kind == "left":
                stack.left = node
            else:
                out += [(*r, None, None, None) for r in stack.offer(run, us, seq, kind, node, None, None, None)]
        yield _batch(out)
    yield _batch([(*r, None, None, None) for r in stack.rest(now)])


def spans_and_routes(log: DataFrame) -> DataFrame:
    """Events (the columns of EVENT) to rows of SPAN; events without run, us or seq are left out. No task has to go through all events of a run."""
    events = saved(log.select(*[c.split(" ")[0] for c in EVENT.split(", ")]).where("run is not null and us is not null and seq is not null"), "events")
    ranged = events.repartitionByRange("run", "us", "seq").sortWithinPartitions("run", "us", "seq").withColumn("range", F.spark_partition_id())
    parts = saved(ranged.mapInArrow(_reduced, PART), "parts")
    over = parts.where("place is not null").select("run", "kind", "seq", "node", "enter_us", "range", "segment", "place")
    over = over.repartition("run").sortWithinPartitions("run", "range", "segment", "place").drop("place")
    folded = saved(over.mapInArrow(_folded, PART), "folded")
    starts = folded.where("kind = 'start'").select("run", "range", "segment", F.col("depth").alias("_depth"), F.col("node").alias("_top"), F.col("parent").alias("_left"))
    rows = parts.where("place is null").join(starts, ["run", "range", "segment"])
    route, bottom = F.col("kind") == "route", F.col("depth") == 0
    node = F.when(route, F.coalesce("node", "_top", "parent", "_left")).otherwise(F.col("node"))
    parent = F.when(~route, F.when(bottom, F.col("_top")).otherwise(F.col("parent")))
    names = [c.split(" ")[0] for c in SPAN.split(", ")]
    placed = rows.select("run", "kind", "seq", node.alias("node"), (F.col("depth") + F.col("_depth")).alias("depth"), parent.alias("parent"), *names[6:])
    return placed.unionByName(folded.where("kind <> 'start'").select(*names))


def with_duration(rows: DataFrame) -> DataFrame:
    return rows.withColumn("duration_us", F.col("exit_us") - F.when(F.col("state").isin("closed", "error"), F.col("enter_us")))
