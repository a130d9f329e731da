"""Queries over labels, questions and small records: merges, parsing, routes, prompts, predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundwell.functions.json_text import repair
from groundwell.operators import calibration as cal
from groundwell.operators import decisions as d
from groundwell.operators import features as fs
from groundwell.operators import planning as pl
from groundwell.operators.ranks import ranked_in
from groundwell.plans import calibration, decisions, retrieval
from groundwell.sources.tables import PLAN_SQL, plan_rows, read
from groundwell.sources.work import saved

COEFFICIENTS = {"intercept": -1.2, "length": 0.35, "english": 0.4, "toxic": -0.8}


def parsed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's user turns as its plan: short ones go, equal ones stay once, seven at most, numbered anew."""
    c = read(spark, sf_dir, "conversations").where("role = 'user'").select(F.col("conv_id").alias("run"), F.col("turn").alias("at"), "text", F.lit("core").alias("kind"))
    return pl.parsed(c).select(F.col("run").alias("conv_id"), F.concat(F.lit("sq"), F.col("n").cast("string")).alias("id"), F.col("at").alias("turn"), F.md5("norm").alias("norm_md5"))


def question_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label 1 if all claims of a question are supported; questions without claims have no row."""
    f = decisions.findings(spark, sf_dir).groupBy("run", "pos").agg(F.bool_and(F.col("verdict") == "SUPPORTED").cast("int").alias("label"))
    return plan_rows(spark, sf_dir).select("run", "pos", "status").join(f, ["run", "pos"])


def merged_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old labels merged onto a new pool (documents of the benchmark's results): an old value stays, old keys outside survive."""
    return _merged(spark, sf_dir, retrieval.bm25_topk(spark, sf_dir))


def label_pool_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old labels merged onto the reference's pool by the same rules."""
    return _merged(spark, sf_dir, retrieval.label_pool(spark, sf_dir))


def _merged(spark: SparkSession, sf_dir: str, found: DataFrame) -> DataFrame:
    pool = found.select(F.col("id").alias("doc_id"), F.lit(None).cast("int").alias("fresh")).distinct()
    both = read(spark, sf_dir, "labels").select("doc_id", "quality").join(pool.withColumn("pooled", F.lit(True)), "doc_id", "full_outer")
    return both.select("doc_id", F.coalesce("quality", "fresh").alias("grade"), F.coalesce("pooled", F.lit(False)).alias("pooled"))


def contradiction_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both rates of a question: over all pairs of its evidence, and over the pairs that were scored."""
    best = saved(retrieval.reranked(spark, sf_dir), "reranked")
    n = best.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    c = retrieval.pairs_of(spark, sf_dir, best).groupBy("qid").agg(F.count(F.lit(1)).alias("found"), F.max("scanned").alias("scanned"))
    both = n.join(c, "qid", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return both.select("qid", "n", "found", F.when(F.col("n") < 2, 0.0).otherwise(F.round(F.col("found") / pairs, 6)).alias("of_all"), F.round(F.coalesce(F.try_divide("found", "scanned"), F.lit(0.0)), 6).alias("of_scanned"))


def contradicted_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = retrieval.contradiction_pairs(spark, sf_dir)
    return c.select(F.explode(F.array("id_a", "id_b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("pairs"))


def score_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a question's scores look like probabilities where logits are due: three or more, all in 0 to 1, two over 0.9."""
    s = F.col("rerank_score")
    return retrieval.reranked(spark, sf_dir).groupBy("qid").agg(((F.count(F.lit(1)) >= 3) & F.bool_and(s.between(0, 1)) & (F.sum((s > 0.9).cast("int")) >= 2)).alias("suspicious"), F.max(s).alias("f1"), F.count(F.lit(1)).alias("n"))


def route_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next route of a question: a cheap suggestion first, then a wider one, then a deeper one; and the depth of the deepest one so far."""
    first = F.when(F.col("sources") >= 2, "web").otherwise("arxiv_meta")
    second = pl.wider(first)
    third = pl.deeper(second)
    route = F.when(F.col("rounds") == 0, first).when(F.col("rounds") == 1, second).otherwise(third)
    p = plan_rows(spark, sf_dir).withColumn("route", route)
    tried = F.slice(F.array(first, second, third), 1, F.least(F.lit(3), F.col("rounds") + 1))
    return p.select("run", "pos", "rounds", "route", fs.route_escalation(tried).alias("f9"))


def prompt_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of a run's passages, in order of priority, fit in a budget of tokens."""
    r = decisions.round_robin_evidence(spark, sf_dir).withColumn("tokens", F.floor((F.col("passage") * 97 + 300) / 3.5).cast("long"))
    r = r.withColumn("used", F.sum("tokens").over(Window.partitionBy("run").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy("run").agg(F.sum((F.col("used") <= 1000).cast("long")).alias("fit"), F.count(F.lit(1)).alias("of"), F.coalesce(F.max(F.when(F.col("used") <= 1000, F.col("used"))), F.lit(0)).alias("tokens"))


def footnotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of a run's passages by first use, over its live questions in order."""
    e = decisions.evidence(spark, sf_dir).where("status <> 'abandoned'").groupBy("run", "passage").agg(F.min(F.struct("pos", "rank")).alias("first"), F.count(F.lit(1)).alias("uses"))
    return e.select("run", "passage", F.row_number().over(Window.partitionBy("run").orderBy("first", "passage")).alias("number"), "uses")


def event_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the events' properties, and whether the required one is there."""
    keys = F.json_object_keys("props")
    return read(spark, sf_dir, "events").groupBy("event_type", F.array_join(keys, ",").alias("keys")).agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.array_contains(keys, "k")).alias("complete"))


def json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' properties as a model might cut them off, repaired."""
    cut = F.substring("props", F.lit(1), (F.length("props") - F.col("event_id") % 2).cast("int"))
    e = read(spark, sf_dir, "events").select("event_id", "props", repair(cut).alias("fixed"))
    return e.select("event_id", F.get_json_object("fixed", "$.k").cast("int").alias("k"), (F.get_json_object("fixed", "$.k") == F.get_json_object("props", "$.k")).alias("same"))


def seeded_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's place in a fixed random order, over its source."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source", F.md5(F.concat(F.lit("7/"), F.col("doc_id").cast("string"))).alias("drawn"))
    return ranked_in(d, "source", "drawn").select("doc_id", "source", F.col("rank").alias("place"))


def predict_proba(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities by fixed coefficients, clamped to 0 to 1."""
    z = F.lit(COEFFICIENTS["intercept"]) + sum(F.lit(v) * F.col(k) for k, v in COEFFICIENTS.items() if k != "intercept")
    p = F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))
    return calibration.sample(spark, sf_dir).select("id", "label", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)), 6).alias("p"))


def isotonic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cal.fit_isotonic(calibration.sample(spark, sf_dir))


_FIND, _EV, _S = decisions._FIND, decisions._EV, calibration._S
_R = retrieval.ORACLE_SQL
QUERIES = {
    f.__name__: f
    for f in (parsed_questions, question_labels, merged_labels, label_pool_merged, contradiction_rates, contradicted_passages, score_sanity, route_choice, prompt_fit, footnotes, event_keys, json_repair, seeded_order, predict_proba, isotonic_fit)
}
ORACLE_SQL = {
    "parsed_questions": r"""WITH c AS (SELECT conv_id, turn, regexp_replace(lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))), '[?.]+$', '') AS norm FROM conversations WHERE role = 'user' AND length(trim(text)) >= 15),
g AS (SELECT conv_id, norm, min(turn) AS turn FROM c GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, norm) AS n FROM g) SELECT conv_id, 'sq' || n AS id, turn, md5(norm) AS norm_md5 FROM n WHERE n <= 7""",
    "question_labels": f"WITH {PLAN_SQL}, {_FIND}, l AS (SELECT run, pos, CAST(bool_and(verdict = 'SUPPORTED') AS INT) AS label FROM finds GROUP BY ALL) SELECT run, pos, status, label FROM plan JOIN l USING (run, pos)",
    "merged_labels": f"WITH pool AS (SELECT DISTINCT id FROM ({_R['bm25_topk']})) SELECT coalesce(doc_id, id) AS doc_id, quality AS grade, id IS NOT NULL AS pooled FROM labels FULL JOIN pool ON doc_id = id",
    "label_pool_merged": f"WITH pool AS (SELECT DISTINCT id FROM ({_R['label_pool']})) SELECT coalesce(doc_id, id) AS doc_id, quality AS grade, id IS NOT NULL AS pooled FROM labels FULL JOIN pool ON doc_id = id",
    "contradiction_rates": f"""WITH n AS (SELECT qid, count(*) AS n FROM ({_R['rerank_topk']}) GROUP BY qid), c AS (SELECT qid, count(*) AS found, max(scanned) AS scanned FROM ({_R['contradiction_pairs']}) GROUP BY qid)
SELECT n.qid, n, coalesce(found, 0) AS found, CASE WHEN n < 2 THEN 0.0 ELSE round(coalesce(found, 0) / (n * (n - 1) / 2), 6) END AS of_all, round(coalesce(found / scanned, 0.0), 6) AS of_scanned FROM n LEFT JOIN c ON n.qid = c.qid""",
    "contradicted_passages": f"SELECT id, count(*) AS pairs FROM (SELECT unnest([id_a, id_b]) AS id FROM ({_R['contradiction_pairs']})) GROUP BY id",
    "score_sanity": f"SELECT qid, count(*) >= 3 AND bool_and(rerank_score BETWEEN 0 AND 1) AND count(*) FILTER (rerank_score > 0.9) >= 2 AS suspicious, max(rerank_score) AS f1, count(*) AS n FROM ({_R['rerank_topk']}) GROUP BY qid",
    "route_choice": f"""WITH {PLAN_SQL}, r AS (SELECT run, pos, rounds, CASE WHEN rounds = 0 THEN CASE WHEN sources >= 2 THEN 'web' ELSE 'arxiv_meta' END WHEN rounds = 1 THEN CASE WHEN sources >= 2 THEN 'arxiv_meta' ELSE 'web' END ELSE 'arxiv_fulltext' END AS route FROM plan)
SELECT *, CASE WHEN rounds < 2 THEN CAST(0.5 AS DOUBLE) ELSE 1.0 END AS f9 FROM r""",
    "prompt_fit": f"""WITH e AS ({decisions.ORACLE_SQL['round_robin_evidence']}), u AS (SELECT run, sum(CAST(floor((passage * 97 + 300) / 3.5) AS BIGINT)) OVER (PARTITION BY run ORDER BY place) AS used FROM e)
SELECT run, count(*) FILTER (used <= 1000) AS fit, count(*) AS of, CAST(coalesce(max(used) FILTER (used <= 1000), 0) AS BIGINT) AS tokens FROM u GROUP BY run""",
    "footnotes": f"WITH {PLAN_SQL}, {_EV}, f AS (SELECT run, passage, min(pos * 100 + rank) AS first, count(*) AS uses FROM ev WHERE status <> 'abandoned' GROUP BY ALL) SELECT run, passage, CAST(row_number() OVER (PARTITION BY run ORDER BY first, passage) AS INT) AS number, uses FROM f",
    "event_keys": "SELECT event_type, array_to_string(json_keys(props), ',') AS keys, count(*) AS n, bool_and(list_contains(json_keys(props), 'k')) AS complete FROM events GROUP BY 1, 2",
    "seeded_order": "SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY source ORDER BY md5('7/' || doc_id)) AS INT) AS place FROM documents",
    "predict_proba": "SELECT doc_id AS id, quality AS label, round(1 / (1 + exp(-(-1.2 + 0.35 * ln(n_chars + 1.0) + 0.4 * CAST(lang = 'en' AS INT) - 0.8 * toxic))), 6) AS p FROM labels JOIN documents USING (doc_id)",
}
