"""SimHash near-dedup with pivot distance tables.

A document's fingerprint has a bit for each bit that over half of its 3-word shingle hashes (XXH64, seed 42) have. Links
are between fingerprints at 2 or fewer differing bits. Equal fingerprints are one class; for each class the Hamming
distances to 16 reference fingerprints (pivots) are computed once. Two classes can be linked only if all their pivot
distances differ by 2 at most, so the largest coordinate difference discards a pair before its fingerprints are compared.
Pairs meet in cells only: of four 16-bit blocks, two are equal in any linked pair, which gives six cell keys for a class.
A cell with many classes is cut into parts, and each pair of parts is a task of its own. Of a task's links only a spanning
forest goes on to the connected components, so that no group is written out in pairs.

Defined cases: null, empty and blank texts have fingerprint zero and are linked like any other; fewer than three words give
one shingle of all of them; repeated rows share a class; a null doc_id never is a component's id unless all its members'
are null; an empty table gives an empty result. What stays in the corpus is one row of each component: the least doc_id,
then the least fingerprint and text digest; an id, null or not, may stay in several components with different texts. Whole texts are read, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import free_worker, saved, table
from .components import roots

NEAR = 2
SHINGLE = 3
BLOCKS = 4
#: Fixed by a rule, not by the data.
PIVOTS = [xxhash.xxh64_intdigest(f"pivot {k}".encode(), 7) for k in range(16)]
CELL_PART = 2048
BLOCK = 1 << 16


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None) -> int:
    """Of a whole text, unsigned."""
    found = (text or "").encode().lower().split()  # bytes: only A-Z are lowered, and only the six ASCII blanks split
    if not found:
        return 0
    grams: Iterator[bytes] = iter([b" ".join(found)]) if len(found) < SHINGLE else map(b" ".join, zip(found, found[1:], found[2:], strict=False))
    n = max(1, len(found) - SHINGLE + 1)
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    while block := [digest(g, 42) for g in islice(grams, BLOCK)]:
        bits = np.unpackbits(np.array(block, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


@F.arrow_udf(LongType())
def fingerprints(texts: pa.Array) -> pa.Array:
    free_worker()
    return pa.array([_long(fingerprint(t.as_py())) for t in texts], type=pa.int64())


def pivot_columns(fp: Column) -> list[Column]:
    """The pivot table's row of a fingerprint: eight distances of a byte each in a long."""
    out = []
    for at in range(0, len(PIVOTS), 8):
        packed = F.lit(0).cast("long")
        for k, p in enumerate(PIVOTS[at : at + 8]):
            packed = packed.bitwiseOR(F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(_long(p)))).cast("long"), 8 * k))
        out.append(packed.alias(f"d{at // 8}"))
    return out


def _cells(classes: DataFrame) -> DataFrame:
    """Each class with its six cell keys, in cells that have two classes at least, and there once for each task of the cell."""
    width = 64 // BLOCKS
    masks = [_long(sum(((1 << width) - 1) << width * b for b in pair)) for pair in combinations(range(BLOCKS), BLOCKS - NEAR)]
    keyed = classes.select("fp", "d0", "d1", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("mask", "cell"))
    many = keyed.groupBy("mask", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    held = keyed.join(many, ["mask", "cell"]).withColumn("parts", F.ceil(F.col("n") / CELL_PART))
    held = held.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return held.select("mask", "cell", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), F.col("d0").bitwiseAND(F.lit(255)).alias("first"), "fp", "d0", "d1")


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, least node) with the components of the edges."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    out = np.flatnonzero(label != np.arange(n))
    return out, label[out]


def links_in_order(task: np.ndarray, fp: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by (task, first pivot distance): a spanning forest of the links within each task, as row numbers."""
    n = len(fp)
    us, vs, held = np.empty(0, int), np.empty(0, int), []
    first = pivots[:, 0]
    here = np.arange(n)
    for step in range(1, n):
        here = here[here < n - step]
        there = here + step
        # sorted by the first coordinate: who is over NEAR away now is so for all later steps
        near = (task[here] == task[there]) & (first[there] - first[here] <= NEAR)
        here = here[near]
        if not len(here):
            break
        a, b = here, here + step
        for k in range(1, pivots.shape[1]):
            ok = np.abs(pivots[a, k] - pivots[b, k]) <= NEAR
            a, b = a[ok], b[ok]
        ok = np.bitwise_count(fp[a] ^ fp[b]) <= NEAR
        held.append((a[ok], b[ok]))
        if sum(len(x) for x, _ in held) > 1_000_000:
            us, vs = _forest(n, np.concatenate([us, *[x for x, _ in held]]), np.concatenate([vs, *[x for _, x in held]]))
            held = []
    return _forest(n, np.concatenate([us, *[x for x, _ in held]]), np.concatenate([vs, *[x for _, x in held]]))


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tasks stay whole: the last task of a batch waits for the next batch."""
    rest: pa.Table | None = None

    def found(t: pa.Table) -> pa.RecordBatch:
        task = np.stack([t[c].to_numpy() for c in ("mask", "cell", "a", "b")])
        task = np.concatenate([[0], np.cumsum((task[:, 1:] != task[:, :-1]).any(axis=0))])
        fp = t["fp"].to_numpy().view(np.uint64)
        pivots = np.stack([t[d].to_numpy() for d in ("d0", "d1")], axis=1).copy().view(np.uint8).astype(np.int16)
        u, v = links_in_order(task, fp, pivots)
        return pa.record_batch({"u": pa.array(fp[u].view(np.int64)), "v": pa.array(fp[v].view(np.int64))})

    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
        if not t.num_rows:
            continue
        keys = np.stack([t[c].to_numpy() for c in ("mask", "cell", "a", "b")])
        ends = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0))
        cut = int(ends[-1]) + 1 if len(ends) else 0
        if cut:
            yield found(t.slice(0, cut))
        rest = t.slice(cut)
    if rest is not None and rest.num_rows:
        yield found(rest)


def class_roots(fps: DataFrame) -> DataFrame:
    """fps (doc_id, fp) to one row per class of equal fingerprints: fp, its least doc_id, and the component's root, a fingerprint."""
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    classes = saved(classes.select("fp", "least", *pivot_columns(F.col("fp"))), "classes")
    order = ["mask", "cell", "a", "b", "first"]
    tasks = _cells(classes).repartition(*order[:4]).sortWithinPartitions(*order)
    reach = saved(roots(tasks.mapInArrow(_linked, "u long, v long")), "roots")
    return classes.join(reach.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_classes(fps: DataFrame) -> DataFrame:
    """fps (doc_id, fp) to one row per class of equal fingerprints: fp, component_id."""
    both = class_roots(fps)
    ids = both.groupBy("root").agg(F.min("least").alias("component_id"))
    return saved(both.join(ids, "root").select("fp", "component_id"), "near")


def components(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, fp, component_id."""
    fps = saved(docs.select("doc_id", fingerprints("text").alias("fp")), "fingerprints")
    return fps.join(near_classes(fps), "fp").select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame) -> DataFrame:
    """One row of docs for each component, that with the least id (null last); of several texts with that id, one by fingerprint and digest;
    of several rows with that id and text, one by a hash of the row as JSON."""
    each = docs.select("doc_id", fingerprints("text").alias("fp"), F.unhex(F.md5("text")).alias("digest")).groupBy("doc_id", "fp", "digest").agg(F.count(F.lit(1)).alias("n"))
    each = saved(each, "fingerprints")
    # first by class, which is the larger reduction and leaves one row for each side of the join
    first = each.groupBy("fp").agg(F.min(F.struct(F.isnull("doc_id").alias("last"), "doc_id", "fp", "digest", "n")).alias("first"))
    first = first.join(class_roots(each).select("fp", "root"), "fp").groupBy("root").agg(F.min("first").alias("first"))
    stays = saved(first.select(F.col("first.doc_id").alias("_stays"), F.col("first.digest").alias("_digest"), F.col("first.n").alias("_n")), "stays")
    repeats = stays.agg(F.max("_n")).first()[0] or 0
    # by sorting at every size: what stays grows with the input, so it's never broadcast. The row travels in a struct: no name of it can clash
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].alias("_id"), F.unhex(F.md5(docs["text"])).alias("_own"))
    same = F.col("_id").eqNullSafe(F.col("_stays")) & F.col("_own").eqNullSafe(F.col("_digest"))
    out = packed.join(stays.select("_stays", "_digest").hint("merge"), same, "left_semi")
    if repeats > 1:
        out = out.groupBy("_id", "_own").agg(F.min_by("row", F.struct(F.xxhash64(F.to_json("row")), F.md5(F.to_json("row")))).alias("row"))
    return out.select("row.*")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
