"""A stored index of vectors: an inverted file of cells, with filter columns beside the vectors and the filter inside the search.

Cells are fitted on a bounded sample of vectors by spherical k-means; every vector goes to its nearest cell. A search ranks the
cells for each query by the centroids and reads the first ones: as many as gave RECALL of the sample's own neighbours when the
index was built, which is few where vectors lie in clusters and most where they don't. Under a filter cells are taken on until
`enough` rows that pass it stand in them, so that a filter that few rows pass doesn't starve a query. An exact search reads all.

Vectors without a direction (of zeros, with null or NaN elements) or of another length than the index's are stored in a cell
of their own (-1), and are never found. Ids may repeat; each row is found by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from groundwell.operators.retrieval import HELD_BLOCKS, QUERY_BLOCK, VECTOR_BLOCK, Best, packed, rows_of, small, top, unit_rows
from groundwell.sources.work import saved, spread, work_path

#: Vectors that the cells are fitted on, and the most cells. The sample's vectors and all centroids pass the driver.
SAMPLE, MOST_CELLS = 20_000, 4096
TURNS = 12
#: What the number of cells to read is fitted to: neighbours of so many of the sample's vectors. And rows that pass the filter in them, as multiples of k.
RECALL, NEIGHBOURS, TRIED, ENOUGH = 0.96, 10, 400, 20
#: So many vectors meet all centroids at once.
CHUNK = 1024


@dataclass(frozen=True)
class VectorIndex:
    path: str
    centroids: np.ndarray
    probe: int
    filters: tuple[str, ...]
    schema: str

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(f"{self.path}/vectors")


def nearest(vectors: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each vector the nearest centroid and how near it is."""
    own, score = np.zeros(len(vectors), np.int64), np.zeros(len(vectors))
    for at in range(0, len(vectors), CHUNK):
        part = vectors[at : at + CHUNK] @ centre.T
        own[at : at + CHUNK], score[at : at + CHUNK] = part.argmax(axis=1), part.max(axis=1)
    return own, score


def fit_cells(vectors: np.ndarray, cells: int, seed: int = 3) -> np.ndarray:
    """Unit centroids of unit vectors. An empty cell gets the vector that is farthest from its own."""
    rng = np.random.default_rng(seed)
    centre = vectors[rng.choice(len(vectors), min(cells, len(vectors)), replace=False)]
    for _ in range(TURNS):
        own, score = nearest(vectors, centre)
        sums = np.zeros_like(centre)
        np.add.at(sums, own, vectors)
        held = np.bincount(own, minlength=len(centre))
        far = np.argsort(score, kind="stable")
        sums[held == 0] = vectors[far[: int((held == 0).sum())]]
        centre = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centre


def fit_probe(vectors: np.ndarray, centre: np.ndarray) -> int:
    """How many cells hold RECALL of the nearest neighbours of some of these vectors."""
    if len(vectors) < 2:
        return 1
    k, own, needed = min(NEIGHBOURS, len(vectors) - 1), nearest(vectors, centre)[0], []
    for at in range(0, min(TRIED, len(vectors)), 50):
        asked = vectors[at : min(at + 50, TRIED)]
        score = -(asked @ vectors.T)
        score[np.arange(len(asked)), at + np.arange(len(asked))] = np.inf
        near = np.argpartition(score, k - 1, axis=1)[:, :k]
        turn = np.argsort(np.argsort(-(asked @ centre.T), axis=1, kind="stable"), axis=1)
        needed.append(np.take_along_axis(turn, own[near], axis=1).ravel())
    needed = np.sort(np.concatenate(needed))
    return int(needed[int(np.ceil(RECALL * len(needed))) - 1]) + 1


def _with_cell(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """rows (vector, ...) with cell."""
    shared = rows.sparkSession.sparkContext.broadcast(centroids)  # MOST_CELLS at most
    size = centroids.shape[1]

    @F.arrow_udf("int")
    def cell(vectors: pa.Array) -> pa.Array:
        ok = [v.is_valid and len(v) == size for v in vectors]
        out = np.full(len(vectors), -1, np.int32)
        if any(ok):
            flat = vectors.filter(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            x = unit_rows(flat.tobytes(), sum(ok))
            near = nearest(x, shared.value)[0]
            out[np.flatnonzero(ok)] = np.where(np.isnan(x).any(axis=1), -1, near)
        return pa.array(out)

    return rows.withColumn("cell", cell("vector"))


def _stored(rows: DataFrame, path: str, mode: str) -> None:
    # Spark cuts large cells into several files
    rows.hint("rebalance", F.col("cell")).write.mode(mode).partitionBy("cell").parquet(f"{path}/vectors")


def build(rows: DataFrame, filters: tuple[str, ...] = (), path: str | None = None, cells: int | None = None, seed: int = 3) -> VectorIndex:
    """An index of rows (id, vector, and the columns that filters names)."""
    spark = rows.sparkSession
    path = path or work_path(spark, "vector-index")
    rows = rows.select("id", F.col("vector").cast("array<double>").alias("vector"), *filters)
    n = rows.count()
    share = min(1.0, SAMPLE / max(1, n))
    drawn = rows.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).select("id", "vector").limit(2 * SAMPLE)
    found = [np.frombuffer(r.vectors).reshape(len(r.ids), -1) for r in packed(drawn, "id", VECTOR_BLOCK).toLocalIterator()]
    found = [x[~np.isnan(x).any(axis=1)] for x in found]
    size = max(((sum(len(x) for x in found if x.shape[1] == s), s) for s in {x.shape[1] for x in found}), default=(0, 1))[1]
    sample = np.concatenate([unit_rows(x.tobytes(), len(x)) for x in found if x.shape[1] == size and len(x)] or [np.zeros((0, size))])
    sample = sample[~np.isnan(sample).any(axis=1)]
    cells = cells or int(min(MOST_CELLS, max(1, round(2 * np.sqrt(n))), max(1, len(sample) // 4)))
    centroids = fit_cells(sample, cells, seed) if len(sample) else np.eye(1, size)
    _stored(_with_cell(spread(rows), centroids), path, "errorifexists")
    probe = fit_probe(sample, centroids)
    spark.createDataFrame([(k, c.tolist(), probe) for k, c in enumerate(centroids)], "cell int, centroid array<double>, probe int").write.parquet(f"{path}/cells")
    return VectorIndex(path, centroids, probe, filters, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", cell int")


def opened(spark: SparkSession, path: str) -> VectorIndex:
    """An index as it is stored."""
    cells = sorted((r.cell, r.centroid, r.probe) for r in spark.read.parquet(f"{path}/cells").collect())  # MOST_CELLS at most
    stored = spark.read.parquet(f"{path}/vectors").schema
    filters = tuple(f.name for f in stored if f.name not in ("id", "vector", "cell"))
    return VectorIndex(path, np.array([c for _, c, _ in cells]), cells[0][2], filters, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stored))


def append(index: VectorIndex, rows: DataFrame) -> None:
    """Adds rows to an index: its cells stay as they are, and no stored vector is touched."""
    rows = rows.select("id", F.col("vector").cast("array<double>").alias("vector"), *index.filters)
    _stored(_with_cell(spread(rows), index.centroids), index.path, "append")


def plan_probes(queries: DataFrame, counts: DataFrame, centroids: np.ndarray, probe: int, enough: int) -> DataFrame:
    """queries (qid, vector) to qid, vector, near (the nearest cell) and reads, a bit for each cell: the nearest cells of each query, `probe`
    of them at least, and until `enough` rows stand in them. Queries that read none are left out.

    counts: cell, n (rows that pass the filter)."""
    spark = queries.sparkSession
    held = dict.fromkeys(range(len(centroids)), 0) | {r.cell: r.n for r in counts.where("cell >= 0").collect()}  # MOST_CELLS at most
    shared = spark.sparkContext.broadcast((centroids, np.array([held[k] for k in range(len(centroids))])))

    @F.arrow_udf("struct<near int, reads binary>")
    def cells(vectors: pa.Array) -> pa.Array:
        centre, n = shared.value
        near, reads = [], []
        for v in vectors:
            x = np.array(v.as_py() if v.is_valid else [], dtype=np.float64)
            order = np.zeros(0, np.int64)
            if len(x) == centre.shape[1] and np.linalg.norm(x) > 0:
                order = np.argsort(-(centre @ x), kind="stable")
                order = order[n[order] > 0]
                earlier = np.cumsum(n[order]) - n[order]
                order = order[(np.arange(len(order)) < probe) | (earlier < enough)]
            bits = np.zeros(len(n), bool)
            bits[order] = True
            near.append(int(order[0]) if len(order) else None)
            reads.append(np.packbits(bits).tobytes())
        return pa.StructArray.from_arrays([pa.array(near, pa.int32()), pa.array(reads, pa.binary())], names=["near", "reads"])

    return queries.withColumn("_cells", cells("vector")).select("qid", "vector", "_cells.near", "_cells.reads").where("near is not null")


@F.arrow_udf(ArrayType(IntegerType()))
def _cells_read(reads: pa.Array) -> pa.Array:
    """The cells that any query of a block reads."""
    union = [np.bitwise_or.reduce([np.frombuffer(x.as_buffer(), np.uint8) for x in r.values]) for r in reads]
    return pa.array([np.flatnonzero(np.unpackbits(x)).astype(np.int32) for x in union], pa.list_(pa.int32()))


def search(index: VectorIndex, queries: DataFrame, k: int, where: Column | None = None, probe: int | None = None, exact: bool = False, keep_self: bool = False) -> DataFrame:
    """The k nearest by cosine of queries (qid, vector): qid, id, score, rank. where: on the index's filter columns; probe: how many cells a
    query reads at least, if not the index's own number; exact: all.

    A query is written once, with a bit for each cell, however many cells it reads. Blocks of queries with like cells meet the blocks
    of vectors that have any of these, in a task that multiplies what the bits say. Nothing but the numbers of cells passes the driver."""
    spark = queries.sparkSession
    rows = index.read(spark).where("cell >= 0")
    rows = rows if where is None else rows.where(where)
    counts = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    cells = len(index.centroids)
    asked = queries.select("qid", F.col("vector").cast("array<double>").alias("vector"))
    asked = plan_probes(asked, counts, index.centroids, cells if exact else probe or index.probe, ENOUGH * k).repartitionByRange("near").sortWithinPartitions("near")
    q_blocks = packed(asked, "qid", QUERY_BLOCK, beside="reads").select("number", F.col("ids").alias("qids"), F.col("vectors").alias("asked"), "reads")
    q_blocks = saved(q_blocks.withColumn("wanted", _cells_read("reads")), "query-blocks")
    read = [r.cell for r in q_blocks.select(F.explode("wanted").alias("cell")).distinct().collect()]  # MOST_CELLS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, Best] = {}
        for number, qids, q, reads, ids, v, cell in rows_of(batches):
            key, qids, own, cell = number.as_py(), qids.values.to_numpy(), ids.values.to_numpy(), cell.values.to_numpy()
            if key not in best:
                if len(best) >= HELD_BLOCKS:
                    yield best.pop(next(iter(best))).rows()
                best[key] = Best(qids.copy(), k)
            q, v = unit_rows(q.as_buffer(), len(qids)), unit_rows(v.as_buffer(), len(own))
            bits = np.frombuffer(b"".join(reads.values.to_pylist()), np.uint8).reshape(len(qids), -1)
            for c in np.unique(cell):
                at = np.flatnonzero(bits[:, c >> 3] >> (7 - (c & 7)) & 1)
                best[key].meet(q, v[cell == c], own[cell == c], at, keep_self)
        for b in best.values():
            yield b.rows()

    v_blocks = packed(spread(rows.where(F.col("cell").isin(read))), "id", VECTOR_BLOCK, beside="cell").drop("number")
    v_blocks = saved(v_blocks.withColumn("held", F.array_distinct("cell")), "vector-blocks")
    pairs = q_blocks.join(v_blocks, F.arrays_overlap("wanted", "held")).drop("wanted", "held")
    return top(pairs.mapInArrow(run, "qid long, id long, score double"), k, ["qid"], F.desc("score"), "id")


def share_read(index: VectorIndex, queries: DataFrame, k: int, where: Column | None = None, probe: int | None = None) -> DataFrame:
    """What a search reads: qid, cells, rows (that pass the filter) and of how many."""
    spark = queries.sparkSession
    rows = index.read(spark).where("cell >= 0")
    counts = saved((rows if where is None else rows.where(where)).groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "cell-counts")
    asked = queries.select("qid", F.col("vector").cast("array<double>").alias("vector"))
    plan = plan_probes(asked, counts, index.centroids, probe or index.probe, ENOUGH * k)
    every = F.sum("n").over(Window.partitionBy())  # a row for each cell
    plan = plan.select("qid", F.explode(_cells_read(F.array("reads"))).alias("cell"))
    both = plan.join(small(counts.withColumn("of", every)), "cell")
    return both.groupBy("qid").agg(F.count(F.lit(1)).alias("cells"), F.sum("n").alias("rows"), F.max("of").alias("of"))
