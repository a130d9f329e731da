"""Rows that wait in a key's state until a time has passed them, however many they are, and leave it in order.

What comes is sorted some rows at a time, and each such run goes into the state as pieces, a value each. The rows that leave are
merged from the runs, of which only the pieces at their heads are held: beside RUN rows that come, a task holds PIECE rows of each
run. A run that isn't full takes in the next rows, so that small batches don't leave many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.streaming.stateful_processor import StatefulProcessorHandle

#: Rows that are sorted at once, and of a value of the state.
RUN, PIECE = 200_000, 5_000
_LAST = np.iinfo(np.int64).max


def packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_table(rows.combine_chunks())
    return sink.getvalue().to_pybytes()


class Head:
    """The first rows of a run that are still there: rows from a place on of piece `at` of `end`."""

    def __init__(self, run: int, at: int, end: int, rows: pa.Table, by: list[str]) -> None:
        self.run, self.at, self.end, self.by = run, at, end, by
        self.load(rows)

    def load(self, rows: pa.Table) -> None:
        self.rows, self.place = rows, 0
        self.first, self.second = (pc.fill_null(rows[c], _LAST).to_numpy() for c in self.by)

    @property
    def left(self) -> int:
        return len(self.rows) - self.place

    @property
    def last(self) -> tuple[int, int]:
        return int(self.first[-1]), int(self.second[-1])

    def take(self, to: tuple[int, int]) -> pa.Table:
        """The rows up to a key, itself too; they are gone then."""
        low, high = (int(np.searchsorted(self.first, to[0], side)) for side in ("left", "right"))
        end = max(self.place, low + int(np.searchsorted(self.second[low:high], to[1], "right")))
        found, self.place = self.rows.slice(self.place, end - self.place), end
        return found


class Waiting:
    """Rows of a schema, in order of by: a time that is never null, and a whole number (nulls go last). To be made in a processor's init."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, schema: pa.Schema, by: list[str]) -> None:
        self.schema, self.by = schema, by
        self.pieces = handle.getMapState(name, "run long, at long", "rows binary")
        # of each run its pieces that are left, how many rows it had, and the time of the first one that is left
        self.runs = handle.getListState(f"{name}Runs", "run long, at long, end long, n long, first long")

    def _piece(self, run: int, at: int) -> pa.Table:
        return pa.ipc.open_stream(bytes(self.pieces.getValue((run, at))[0])).read_all()

    def _sorted(self, rows: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(rows).sort_by([(c, "ascending") for c in self.by]).combine_chunks()

    def _write(self, rows: pa.Table) -> None:
        """Sorted rows as a run."""
        starts = range(0, len(rows), PIECE)
        for at, start in enumerate(starts):
            self.pieces.updateValue((self.number, at), (packed(rows.slice(start, PIECE)),))
        self.heads.append((self.number, 0, len(starts), len(rows), rows[self.by[0]][0].as_py()))
        self.number += 1

    def begin(self) -> None:
        """For each key, before add and passed."""
        self.heads = [tuple(r) for r in self.runs.get()]
        self.number = max((r[0] for r in self.heads), default=-1) + 1
        self.some: list[pa.Table] = []

    def add(self, rows: pa.Table) -> None:
        if not len(rows):
            return
        if not self.some and self.heads and self.heads[-1][3] < RUN:
            run, at, end, *_ = self.heads.pop()
            for k in range(at, end):
                self.some.append(self._piece(run, k))
                self.pieces.removeKey((run, k))
        self.some.append(rows)
        if sum(map(len, self.some)) >= RUN:
            self._write(self._sorted(self.some))
            self.some = []

    def passed(self, now: int) -> Iterator[pa.Table]:
        """The rows before a time, in order; these are gone then. To be read to its end. `first` is the time of the first of the others, if any."""
        held = Head(self.number, 0, 1, self._sorted(self.some) if self.some else self.schema.empty_table(), self.by)
        self.some = []
        if min([r[4] for r in self.heads] + held.first[:1].tolist(), default=now) < now:
            sizes = {r[0]: r[3] for r in self.heads}
            heads = [Head(run, at, end, self._piece(run, at), self.by) for run, at, end, *_ in self.heads]
            yield from self._merged(heads, held, now)
            for h in heads:
                if h.place:
                    self.pieces.updateValue((h.run, h.at), (packed(h.rows.slice(h.place)),))
            self.heads = [(h.run, h.at, h.end, sizes[h.run], int(h.first[h.place])) for h in heads]
        if held.left:
            self._write(held.rows.slice(held.place))
        self.runs.put(self.heads) if self.heads else self.runs.clear()
        self.first = min((r[4] for r in self.heads), default=None)

    def _merged(self, heads: list[Head], held: Head, now: int) -> Iterator[pa.Table]:
        """The rows before now, in order. Of heads, those that are left have a row at least."""
        while True:
            for h in [h for h in heads if not h.left]:
                self.pieces.removeKey((h.run, h.at))
                h.at += 1
                if h.at < h.end:
                    h.load(self._piece(h.run, h.at))
                else:
                    heads.remove(h)
            every = [*heads, held]
            if not any(h.left and h.first[h.place] < now for h in every):
                return
            # what comes after a piece of its run isn't known yet
            to = min([h.last for h in heads if h.at + 1 < h.end] + [(now - 1, _LAST)])
            yield self._sorted([h.take(to) for h in every])
