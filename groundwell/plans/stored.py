"""Queries over stored vectors, and retrieval in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwell.operators import block_index as bi
from groundwell.operators import retrieval as r
from groundwell.operators import rounds as ro
from groundwell.operators import vector_index as vi
from groundwell.operators.decisions import HOPELESS_AT, LEAST_GAIN, LEAST_SOURCES, MOST_ROUNDS, RETRIEVALS, SUFFICIENT_AT
from groundwell.plans import retrieval as pr
from groundwell.sources.tables import PASSAGES_SQL, passages, read, vectors
from groundwell.sources.work import kept, saved

FILTERS = ("section", "source_type", "published")


def filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with the filter columns of the passage with their id."""
    p = passages(spark, sf_dir).select(F.col("doc_id").alias("id"), *FILTERS)
    return vectors(spark, sf_dir).select("id", "vector").join(p, "id", "left")


def _index(spark: SparkSession, sf_dir: str) -> vi.VectorIndex:
    """Written by the first query that needs it, and searched by all later ones until the table's files change."""
    path = kept(read(spark, sf_dir, "embeddings"), "vectors", lambda p: vi.build(filtered(spark, sf_dir), FILTERS, p))
    return vi.opened(spark, path)


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).where("id % 20 = 0").select(F.col("id").alias("qid"), "vector")


def some():
    return r.passes(published_after=pr.PAGES_AFTER, exclude_sections=["Abstract"])


def dense_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every 20th vector, from as many cells as the index was fitted to read."""
    return vi.search(_index(spark, sf_dir), asked(spark, sf_dir), 10)


def dense_indexed_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same among the passages that a filter lets pass; as many cells are read as hold enough of them."""
    return vi.search(_index(spark, sf_dir), asked(spark, sf_dir), 10, some())


def dense_indexed_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From all cells, under the filter."""
    return vi.search(_index(spark, sf_dir), asked(spark, sf_dir), 10, some(), exact=True)


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten neighbouring questions are a run's plan."""
    b = read(spark, sf_dir, "benchmark")
    return b.select(F.floor(F.col("item_id") / 10).alias("run"), F.col("item_id").alias("qid"), F.col("item_id").alias("place"), "text")


def retrieval_on(spark: SparkSession, sf_dir: str):
    """The retrieval of a round: one BM25 search for all rounds, the route's filter, and the reranker."""
    texts = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("passage"))
    of = r.small(questions(spark, sf_dir).select("qid", F.col("text").alias("question")))
    scored = lambda rows: rows.join(texts, "id").join(of, "qid").withColumn("rerank_score", r.overlap_logit(F.col("question"), F.col("passage")))
    p = passages(spark, sf_dir).select(F.col("doc_id").alias("id"), "source_id", "source_type", "section")
    return ro.retrieve_on_routes(saved(pr._bm25(spark, sf_dir), "scores"), p, scored)


def retrieval_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All questions in rounds until none is pending or affordable; a run has RETRIEVALS calls. Questions begin on different routes."""
    rows = ro.frontier(questions(spark, sf_dir), pr._route(F.col("qid")))
    out = ro.run_rounds(rows, retrieval_on(spark, sf_dir), RETRIEVALS)
    total = F.aggregate(F.map_values("scores"), F.lit(0.0), lambda s, x: s + x)
    return out.select("run", "qid", "route", "status", "rounds", F.array_join("attempted", ">").alias("attempted"), F.array_join("evidence", ",").alias("evidence"), F.round(total, 4).alias("score_sum"), "best")


def bm25_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best passages of each question, from blocks whose bounds let most postings of common words unread."""
    path = kept(read(spark, sf_dir, "documents"), "blocks", lambda p: bi.build(pr._titled(spark, sf_dir), p) and None)
    return bi.search(spark, path, pr._queries(spark, sf_dir), 10)


def bm25_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from an index that once had other texts for a third of the passages, lacked a third, and had some that were deleted again."""
    docs = saved(pr._titled(spark, sf_dir), "passages")
    stale = docs.where("id % 3 = 1").select("id", F.concat(F.lit("an older text "), F.substring("text", 1, 300)).alias("text"))
    extra = docs.where("id % 7 = 0").select((-F.col("id") - 1).alias("id"), "text")
    path = bi.build(docs.where("id % 3 = 0").unionByName(stale).unionByName(extra))
    bi.upsert(docs.where("id % 3 > 0"), path)
    bi.delete(extra.select("id"), path)
    return bi.search(spark, path, pr._queries(spark, sf_dir), 10)


QUERIES = {f.__name__: f for f in (bm25_blocks, bm25_upsert, dense_indexed, dense_indexed_filtered, dense_indexed_exact, retrieval_rounds)}


def _round_sql(n: int) -> str:
    """Round n over the frontier of the round before."""
    was = f"q{n - 1}"
    judged = f"""CASE WHEN f1 IS NULL THEN CASE WHEN rounds + 1 >= {MOST_ROUNDS} THEN 'abandoned' ELSE 'in_progress' END WHEN f1 >= {SUFFICIENT_AT} AND coalesce(sources, 0) >= {LEAST_SOURCES} THEN 'sufficient'
    WHEN coalesce(round(f1 - best, 6) < {LEAST_GAIN}, false) OR rounds + 1 >= {MOST_ROUNDS} THEN CASE WHEN f1 >= {SUFFICIENT_AT} THEN 'sufficient' WHEN f1 <= {HOPELESS_AT} THEN 'abandoned' ELSE 'insufficient' END ELSE 'in_progress' END"""
    return f"""a{n} AS (SELECT *, status IN ('pending', 'in_progress') AND sum(CAST(status IN ('pending', 'in_progress') AS INT)) OVER (PARTITION BY run ORDER BY qid) + sum(rounds) OVER (PARTITION BY run) <= {RETRIEVALS} AS now FROM {was}),
j{n} AS (SELECT a{n}.*, f1, sources, ids, {judged} AS judged FROM a{n} LEFT JOIN fnd ON fnd.qid = a{n}.qid AND fnd.r = a{n}.r),
q{n} AS (SELECT run, qid, CASE WHEN now AND judged = 'in_progress' THEN least(r + 1, 4) ELSE r END AS r, CASE WHEN now THEN judged ELSE status END AS status, rounds + CAST(now AS INT) AS rounds, CASE WHEN now THEN list_append(tried, routes[r]) ELSE tried END AS tried,
  CASE WHEN now THEN list_concat(ev, list_filter(coalesce(ids, []), lambda x: NOT list_contains(ev, x))) ELSE ev END AS ev, CASE WHEN now THEN greatest(best, f1) ELSE best END AS best, routes FROM j{n})"""


_ROUNDS_SQL = f"""WITH {pr._BM25_SQL}, {PASSAGES_SQL}, {pr._QQ_SQL}, rts AS (SELECT unnest([1, 2, 3, 4]) AS r),
o AS (SELECT qid, bm.id, score, source_id, r, CASE r WHEN 1 THEN source_type = 'arxiv' AND coalesce(section = 'Abstract', false) WHEN 2 THEN source_type = 'arxiv' AND coalesce(section <> 'Abstract', true) WHEN 3 THEN source_type = 'web' ELSE true END AS ok FROM bm JOIN passages ON bm.id = doc_id, rts),
w AS (SELECT * FROM o QUALIFY ok OR NOT bool_or(ok) OVER (PARTITION BY qid, r)), c AS (SELECT *, row_number() OVER (PARTITION BY qid, r ORDER BY score DESC, id) AS fr FROM w QUALIFY fr <= 30),
k AS (SELECT c.*, {pr._OVERLAP_SQL} AS rs FROM c JOIN dt USING (id) JOIN qq ON qq.qid = c.qid), t AS (SELECT *, row_number() OVER (PARTITION BY qid, r ORDER BY rs DESC, fr) AS rank FROM k QUALIFY rank <= 8),
fnd AS (SELECT qid, r, max(rs) AS f1, count(DISTINCT nullif(source_id, '')) AS sources, list(id ORDER BY rank) AS ids FROM t GROUP BY qid, r),
q0 AS (SELECT item_id // 10 AS run, item_id AS qid, CAST(item_id % 4 + 1 AS INT) AS r, 'pending' AS status, 0 AS rounds, CAST([] AS VARCHAR[]) AS tried, CAST([] AS BIGINT[]) AS ev, CAST(NULL AS DOUBLE) AS best, {list(ro.ROUTES)} AS routes FROM benchmark),
{", ".join(_round_sql(n) for n in range(1, MOST_ROUNDS + 1))},
ov AS (SELECT DISTINCT qid, id, rs FROM t), u AS (SELECT qid, unnest(ev) AS id FROM q{MOST_ROUNDS}), s AS (SELECT u.qid, round(sum(rs), 4) AS score_sum FROM u JOIN ov ON ov.qid = u.qid AND ov.id = u.id GROUP BY u.qid)
SELECT run, q.qid, routes[r] AS route, status, rounds, array_to_string(tried, '>') AS attempted, array_to_string(ev, ',') AS evidence, coalesce(score_sum, 0.0) AS score_sum, best FROM q{MOST_ROUNDS} q LEFT JOIN s ON s.qid = q.qid"""

ORACLE_SQL = {
    "bm25_blocks": pr.ORACLE_SQL["bm25_topk"],
    "bm25_upsert": pr.ORACLE_SQL["bm25_topk"],
    "dense_indexed_exact": f"""WITH {PASSAGES_SQL}, ok AS (SELECT doc_id AS id FROM passages WHERE published >= '{pr.PAGES_AFTER}' AND coalesce(section <> 'Abstract', true)),
s AS (SELECT q.vec_id AS qid, v.vec_id AS id, {pr._COS_SQL} AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id AND v.vec_id IN (SELECT id FROM ok)), {pr._top_sql("t", "s", 10)} SELECT qid, id, score, rank FROM t""",
    "retrieval_rounds": _ROUNDS_SQL,
}
