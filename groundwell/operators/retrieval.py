"""Sparse, dense and fused retrieval for many queries at once, filters, reranking, and measures of ranked lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundwell.functions.text import tokens
from groundwell.sources.work import saved, spread, work_path

K1, B = 1.5, 0.75
RRF_K = 60
#: Query tables over this many rows are shuffled, not broadcast.
SMALL = 200_000
QUERY_BLOCK = 2048
VECTOR_BLOCK = 4096
#: A block of long vectors has fewer rows: about so many bytes, a row at least.
BLOCK_BYTES = 4 << 20
#: So many queries of a block meet a block of vectors at once, and the states of so many query blocks are held by a task.
CHUNK, HELD_BLOCKS = 256, 16
#: A task counts so many words of whole documents at once.
WORDS = 200_000
#: Folders of an index: a search reads those of its terms.
INDEX_PARTS = 16


def small(df: DataFrame) -> DataFrame:
    """df, with a broadcast hint if a count shows that it's small."""
    return F.broadcast(df) if df.count() <= SMALL else df


def top(df: DataFrame, k: int, by: list[str], *order: Column) -> DataFrame:
    """The first k rows of each group, numbered in `rank`."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def query_terms(queries: DataFrame) -> DataFrame:
    """queries (qid, text) to qid, term, qtf."""
    return queries.select("qid", F.explode(tokens(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf"))


def index_part(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(INDEX_PARTS)).cast("int")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (id, words) to their distinct words with counts, about WORDS words at a time, so that a task holds no more than these beside a batch."""
    for batch in batches:
        ends = np.cumsum(pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(ends):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + WORDS, side="right")))
            ids, words = (c.slice(at, to - at) for c in batch.columns)
            n, at = np.diff(ends[at:to], prepend=ends[at - 1] if at else 0), to
            row = np.repeat(np.arange(len(n)), n)
            t = pa.table({"row": row, "term": words.flatten(), "place": np.arange(len(row))}).group_by(["row", "term"], use_threads=False).aggregate([("place", "min"), ("place", "count")])
            own = t["row"].to_numpy()
            first = np.cumsum(n) - n
            yield pa.record_batch({"id": ids.take(pa.array(own)), "dl": n[own].astype(np.int32), "term": t["term"].combine_chunks(), "tf": t["place_count"].combine_chunks(), "head": t["place_min"].to_numpy() == first[own]})
            none = ids.filter(pa.array(n == 0))
            yield pa.record_batch({"id": none, "dl": np.zeros(len(none), np.int32), "term": pa.nulls(len(none), pa.string()), "tf": np.zeros(len(none), np.int64), "head": np.ones(len(none), bool)})


def postings(docs: DataFrame) -> DataFrame:
    """docs (id, text), one row each, to id, dl, term, tf, head and part; one row of each document has head, that of its first word or of none.

    So all that a search needs comes from one table: the number of documents and their mean length from its heads. Words are counted
    in the task that reads the text; nothing is shuffled."""
    each = spread(docs).select(F.col("id").cast("long").alias("id"), tokens(F.col("text")).alias("ts")).mapInArrow(_counted, "id long, dl int, term string, tf long, head boolean")
    return each.withColumn("part", F.coalesce(index_part(F.col("term")), F.lit(0)))


def write_index(docs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Postings in folders by part, sorted by term; Spark cuts large folders into several files."""
    postings(docs).hint("rebalance", F.col("part")).sortWithinPartitions("part", "term").write.mode(mode).partitionBy("part").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id long, dl int, term string, tf long, head boolean, part int").parquet(path)


def index(docs: DataFrame, path: str | None = None) -> DataFrame:
    """A stored index of docs (id, text), one row each."""
    path = path or work_path(docs.sparkSession, "index")
    write_index(docs, path)
    return read_index(docs.sparkSession, path)


def append(docs: DataFrame, path: str) -> DataFrame:
    """Adds the documents that an index doesn't have; the others stay as they are, and nothing is made again."""
    have = read_index(docs.sparkSession, path).where("head").select("id")
    write_index(saved(docs.join(have, "id", "left_anti"), "new"), path, "append")
    return read_index(docs.sparkSession, path)


def search(found: DataFrame, queries: DataFrame) -> DataFrame:
    """All BM25 scores over 0 of queries (qid, text) on an index: qid, id, score."""
    n, length = found.where("head").agg(F.count(F.lit(1)), F.avg("dl")).first()
    asked = saved(query_terms(queries), "asked")
    parts = [r.part for r in asked.select(index_part(F.col("term")).alias("part")).distinct().collect()]  # INDEX_PARTS at most
    terms = small(asked.select("term").distinct())
    found = found.where(F.col("part").isin(parts) & F.col("term").isNotNull()).join(terms, "term", "left_semi")
    df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.lit(n or 0) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    # what a query gives for a term goes into one small row, before it meets the postings
    weighed = small(saved(asked.join(df, "term").select("qid", "term", (F.col("qtf") * idf).alias("weight")), "weighed"))
    part = F.col("weight") * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(length or 1.0)))
    return found.join(weighed, "term").groupBy("qid", "id").agg(F.round(F.sum(part), 6).alias("score")).where("score > 0")


def packed(rows: DataFrame, key: str, block: int, by: list[str] | None = None, beside: str | None = None) -> DataFrame:
    """rows (key, vector) in blocks of up to so many rows of one length: the columns of by, number (of the block), ids, and the vectors one
    after another as a binary of 64-bit floats; a null element is NaN. The rows of a block have equal values in the (whole number) columns of by.
    beside: a column whose values come as an array, one of each row."""
    by, more = by or [], [beside] if beside else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch]).append_column("size", pc.list_value_length(batch.column(1)))
            for group in t.group_by([*by, "size"]).aggregate([]).to_pylist():
                if not group["size"]:  # a vector without elements is like no other
                    continue
                same = t.filter(np.logical_and.reduce([np.asarray(pc.equal(t[c], group[c])) for c in group]))
                step = max(1, min(block, BLOCK_BYTES // (8 * group["size"])))
                for at in range(0, same.num_rows, step):
                    part = same.slice(at, step)
                    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False).astype(np.float64) for c in part.column(1).chunks])
                    out = {"ids": pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), "vectors": pa.array([flat.tobytes()], pa.binary())}
                    out |= {c: pa.array([part[c].to_pylist()], pa.list_(batch.schema.field(c).type)) for c in more}
                    yield pa.record_batch(out | {c: pa.array([group[c]], batch.schema.field(c).type) for c in by})

    found = rows.select(key, "vector", *by, *more).where(F.col(key).isNotNull() & F.col("vector").isNotNull())
    types = dict(found.dtypes)
    blocks = found.mapInArrow(run, ", ".join(["ids array<long>", "vectors binary", *[f"{c} array<{types[c]}>" for c in more], *[f"{c} {types[c]}" for c in by]]))
    return blocks.select(*by, F.monotonically_increasing_id().alias("number"), "ids", "vectors", *more)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of batches one by one, as scalars that lie in the batch: no more than it is held."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield tuple(c[k] for c in batch.columns)


def unit_rows(flat: bytes, n: int) -> np.ndarray:
    """n vectors at length 1. One without a direction (of zeros, or with a NaN) is all NaN."""
    x = np.frombuffer(flat).reshape(n, -1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Of all pairs; -inf where one has no direction, so that it is never found."""
    score = np.round(q @ v.T, 6)
    score[np.isnan(score)] = -np.inf
    return score


class Best:
    """The k best so far of each query of a block."""

    def __init__(self, ids: np.ndarray, k: int) -> None:
        self.ids, self.k = ids, k
        self.score, self.found = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)

    def add(self, score: np.ndarray, own: np.ndarray, at: np.ndarray) -> None:
        """Scores of the queries in the places `at` with the vectors `own`."""
        hot = (score >= self.score[at, -1:]).any(axis=1)  # others have nothing that comes in, by a tie neither
        at, score = at[hot], score[hot]
        if not len(at):
            return
        found = np.concatenate([self.found[at], np.broadcast_to(own, score.shape)], axis=1)
        score = np.concatenate([self.score[at], score], axis=1)
        if score.shape[1] > 4 * self.k:  # first without regard to ties, which stay in
            least = np.partition(score, -self.k, axis=1)[:, -self.k]
            wide = int((score >= least[:, None]).sum(axis=1).max())
            some = np.argpartition(-score, wide - 1, axis=1)[:, :wide]
            score, found = np.take_along_axis(score, some, axis=1), np.take_along_axis(found, some, axis=1)
        order = np.lexsort((found, -score))[:, : self.k]
        self.score[at], self.found[at] = np.take_along_axis(score, order, axis=1), np.take_along_axis(found, order, axis=1)

    def meet(self, q: np.ndarray, v: np.ndarray, own: np.ndarray, at: np.ndarray, keep_self: bool) -> None:
        """The queries in the places `at` of q, all of this block's, meet the vectors v, some queries at a time."""
        for k in range(0, len(at), CHUNK):
            some = at[k : k + CHUNK]
            score = cosines(q[some], v)
            if not keep_self:
                score[self.ids[some][:, None] == own[None, :]] = -np.inf
            self.add(score, own, some)

    def rows(self) -> pa.RecordBatch:
        ok = self.score > -np.inf
        return pa.record_batch({"qid": np.repeat(self.ids, ok.sum(axis=1)), "id": self.found[ok], "score": self.score[ok]})


def dense_top(vectors: DataFrame, queries: DataFrame, k: int, keep_self: bool = False) -> DataFrame:
    """Exact cosine top k: vectors (id, vector) and queries (qid, vector) to qid, id, score, rank.

    Both sides are tables of blocks, and each block of queries meets each block of vectors in a task: one matrix product. A task
    keeps the k best of each query over all the blocks that it meets, so what is shuffled is small. Nothing passes the driver.
    Vectors without a direction, or of another length than the query's, are never found; the k others are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, Best] = {}
        for number, qids, q, ids, v in rows_of(batches):
            key, qids, own, q, v = number.as_py(), qids.values.to_numpy(), ids.values.to_numpy(), q.as_buffer(), v.as_buffer()
            if q.size * len(own) != v.size * len(qids):  # vectors of other lengths
                continue
            if key not in best:
                if len(best) >= HELD_BLOCKS:
                    yield best.pop(next(iter(best))).rows()
                best[key] = Best(qids.copy(), k)
            best[key].meet(unit_rows(q, len(qids)), unit_rows(v, len(own)), own, np.arange(len(qids)), keep_self)
        for b in best.values():
            yield b.rows()

    asked = saved(packed(queries, "qid", QUERY_BLOCK), "query-blocks").select("number", F.col("ids").alias("qids"), F.col("vectors").alias("asked"))
    pairs = asked.join(saved(packed(spread(vectors), "id", VECTOR_BLOCK), "vector-blocks").drop("number"), how="cross")
    return top(pairs.mapInArrow(run, "qid long, id long, score double"), k, ["qid"], F.desc("score"), "id")


def rrf(lists: DataFrame, k: int = RRF_K, weights: dict[str, float] | None = None) -> DataFrame:
    """Ranked lists (arm, qid, id, rank, score) to qid, id, rrf, and rank and score of the arms `dense` and `sparse`. Arms weigh 1 unless weights says otherwise."""
    weight = F.coalesce(*[F.when(F.col("arm") == a, F.lit(float(w))) for a, w in (weights or {}).items()], F.lit(1.0))
    of = lambda arm, c: F.max(F.when(F.col("arm") == arm, F.col(c)))
    return lists.groupBy("qid", "id").agg(
        F.round(F.sum(weight / (k + F.col("rank"))), 9).alias("rrf"), of("dense", "rank").alias("dense_rank"), of("sparse", "rank").alias("sparse_rank"), of("dense", "score").alias("dense_score"), of("sparse", "score").alias("sparse_score")
    )


def fused(dense: DataFrame, sparse: DataFrame, k: int, weights: dict[str, float] | None = None) -> DataFrame:
    lists = dense.withColumn("arm", F.lit("dense")).unionByName(sparse.withColumn("arm", F.lit("sparse")))
    return top(rrf(lists, weights=weights), k, ["qid"], F.desc("rrf"), "id").withColumn("both", F.col("dense_rank").isNotNull() & F.col("sparse_rank").isNotNull())


def passes(*, sections: list[str] | None = None, source_type: str | None = None, domains: list[str] | None = None, published_after: str | None = None, exclude_sections: list[str] | None = None) -> Column:
    """A filter on passages. A null date fails a date bound; a null section passes an exclusion. Never null."""
    ok = F.lit(True)
    if sections:
        ok = ok & F.coalesce(F.col("section").isin(*sections), F.lit(False))
    if source_type:
        ok = ok & F.coalesce(F.col("source_type") == source_type, F.lit(False))
    if domains:
        ok = ok & F.coalesce(F.col("source_domain").isin(*domains), F.lit(False))
    if published_after:
        ok = ok & F.coalesce(F.col("published") >= published_after, F.lit(False))
    if exclude_sections:
        ok = ok & ~F.coalesce(F.col("section").isin(*exclude_sections), F.lit(False))
    return ok


def route_filter(route: Column) -> Column:
    """What a route may return."""
    arxiv, abstract = F.col("source_type") == "arxiv", F.coalesce(F.col("section") == "Abstract", F.lit(False))
    return F.when(route == "arxiv_meta", arxiv & abstract).when(route == "arxiv_fulltext", arxiv & ~abstract).when(route == "web", F.col("source_type") == "web").otherwise(True)


def with_fallback(scored: DataFrame, ok: str) -> DataFrame:
    """The rows that pass, or all rows of a query of which none does."""
    some = scored.groupBy("qid").agg(F.max(F.col(ok).cast("int")).alias("some"))
    return scored.join(some, "qid").where(F.col(ok) | (F.col("some") == 0)).withColumn("fallback", F.col("some") == 0).drop("some")


def overlap_logit(query: Column, text: Column) -> Column:
    """A stand-in for a cross-encoder: the share of a query's words that a text has, on the scale of logits."""
    q = F.array_distinct(tokens(query))
    return F.round(F.when(F.size(q) > 0, 12.0 * F.size(F.array_intersect(q, tokens(text))) / F.size(q) - 4.0).otherwise(-4.0), 6)


def rerank(candidates: DataFrame, k: int, inputs: int, score: Column) -> DataFrame:
    """candidates (qid, id, rank, ...): the first `inputs` of each query, scored and numbered anew. The cut comes before the scorer."""
    cut = candidates.where(F.col("rank") <= inputs).withColumnRenamed("rank", "fusion_rank").withColumn("rerank_score", score)
    return top(cut, k, ["qid"], F.desc("rerank_score"), "fusion_rank")


def metrics(graded: DataFrame, counts: DataFrame, at: int = 10, deep: int = 20) -> DataFrame:
    """Ranked rows (config, qid, id, rank, grade or null) and counts of all judged ids (qid, grade over 0, n) to one row per config and query: ndcg, recall, strict recall, mrr."""
    gain = lambda g: F.pow(F.lit(2.0), g) - 1
    by_rank = lambda r: F.log2(r + 1)
    # the ideal list needs the numbers of each grade, not the rows in order
    sums = F.transform(F.sequence(F.lit(1), F.lit(at)), lambda r: F.struct(r.alias("r"), by_rank(r).alias("d")))
    above = F.coalesce(F.sum("n").over(Window.partitionBy("qid").orderBy(F.desc("grade")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = F.filter(sums, lambda x: (x["r"] > F.col("above")) & (x["r"] <= F.col("above") + F.col("n")))
    each = counts.withColumn("above", above).withColumn("gains", F.aggregate(places, F.lit(0.0), lambda s, x: s + gain(F.col("grade")) / x["d"]))
    ideal = each.groupBy("qid").agg(F.sum("gains").alias("ideal"), F.sum("n").alias("relevant"), F.coalesce(F.sum(F.when(F.col("grade") >= 2, F.col("n"))), F.lit(0)).alias("strict"))
    graded = graded.withColumn("grade", F.coalesce("grade", F.lit(0)))
    own = graded.groupBy("config", "qid").agg(
        F.coalesce(F.sum(F.when(F.col("rank") <= at, gain(F.col("grade")) / by_rank(F.col("rank")))), F.lit(0.0)).alias("dcg"),
        F.sum(((F.col("rank") <= deep) & (F.col("grade") >= 1)).cast("int")).alias("found"), F.sum(((F.col("rank") <= deep) & (F.col("grade") >= 2)).cast("int")).alias("found_strict"),
        F.min(F.when(F.col("grade") >= 2, F.col("rank"))).alias("first"),
    )
    both = own.join(ideal, "qid")
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return both.select("config", "qid", share("dcg", "ideal").alias("ndcg"), share("found", "relevant").alias("recall"), share("found_strict", "strict").alias("strict_recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"))
