"""The ten features of a question's evidence. A missing feature is null, never 0; a vector says so in a column of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The depth of a route, and what stands for a missing feature.
ROUTE_DEPTH = {"evidence_store": 0, "arxiv_meta": 1, "web": 1, "arxiv_fulltext": 2}
IMPUTE = {"f1": 0.0, "f2": 0.0, "f3": 0.0, "f4": 0.0, "f5": 0.0, "f6": 0.5, "f7": 0.5, "f8": 0.0, "f9": 0.0, "f10": 0.5}
HORIZON_YEARS = 8.0


def evidence_features(evidence: DataFrame, today: str) -> DataFrame:
    """evidence (qid, id, rerank_score, source_id, published) to qid, n, f1 to f4 and f10, a row for each question with evidence."""
    g = evidence.groupBy("qid").agg(
        F.sort_array(F.collect_list("rerank_score"), False).alias("s"), F.count_distinct(F.when(F.col("source_id") != "", F.col("source_id"))).cast("double").alias("f4"),
        F.sort_array(F.collect_list(F.try_to_date(F.substring("published", 1, 10)))).alias("d"), F.count(F.lit(1)).alias("n"),
    )
    mid = F.get("d", F.floor(F.size("d") / 2).cast("int"))
    recency = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.datediff(F.lit(today).cast("date"), mid) / 365.25 / HORIZON_YEARS))
    best = F.slice("s", 1, 3)
    return g.select(
        "qid", "n", F.round(F.get("s", F.lit(0)), 6).alias("f1"), F.when(F.size("s") > 0, F.round(F.aggregate(best, F.lit(0.0), lambda a, x: a + x) / F.size(best), 6)).alias("f2"),
        F.when(F.size("s") >= 5, F.round(F.get("s", F.lit(0)) - F.get("s", F.lit(4)), 6)).alias("f3"), "f4", F.when(mid.isNotNull(), F.round(recency, 6)).alias("f10"),
    )


def source_counts(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """questions (qid) and evidence (qid, source_id) to qid, sources and f4: the distinct sources of a question's evidence; one without a name isn't counted.
    Without evidence there are 0 sources, but f4 is missing."""
    n = evidence.groupBy("qid").agg(F.count_distinct(F.nullif("source_id", F.lit(""))).alias("sources"), F.lit(True).alias("_any"))
    both = questions.select("qid").distinct().join(n, "qid", "left")
    return both.select("qid", F.coalesce("sources", F.lit(0)).alias("sources"), F.when(F.col("_any"), F.col("sources").cast("double")).alias("f4"))


def contradiction_rate(found: Column, n: Column, scanned: Column) -> Column:
    """f5: of all pairs of n passages, those found to contradict; null if nobody looked."""
    return F.when(scanned, F.when(n < 2, 0.0).otherwise(F.round(F.coalesce(found, F.lit(0)) / (n * (n - 1) / 2), 6)))


def entailment_strength(verdicts: Column) -> Column:
    """f6: the mean strength of an array of verdicts, null without one; a verdict that isn't known counts half."""
    strength = F.transform(verdicts, lambda v: F.when(v == "SUPPORTED", 1.0).when(v.isin("UNSUPPORTED", "CONTRADICTED"), 0.0).otherwise(0.5))
    return F.when(F.size(verdicts) > 0, F.round(F.aggregate(strength, F.lit(0.0), lambda a, x: a + x) / F.size(verdicts), 6))


def premise_grounding(ran: Column, score: Column) -> Column:
    """f7: null unless the premises were checked."""
    return F.when(F.coalesce(ran, F.lit(False)), score)


def route_depth(route: Column) -> Column:
    return F.coalesce(*[F.when(route == a, n) for a, n in ROUTE_DEPTH.items()], F.lit(1))


def route_escalation(routes: Column) -> Column:
    """f9: the depth of the deepest route that was tried, 0 to 1; null if none was."""
    return F.when(F.size(routes) > 0, F.array_max(F.transform(routes, route_depth)) / max(ROUTE_DEPTH.values()))


def completeness(features: list[str]) -> Column:
    """The share of features that are there."""
    return F.round(sum(F.col(c).isNotNull().cast("int") for c in features) / len(features), 6)


def vector_columns(features: list[str]) -> list[Column]:
    """Each feature with its neutral value where it's missing, and a flag that says so, in a fixed order."""
    return [c for f in features for c in (F.coalesce(F.col(f), F.lit(IMPUTE[f])).alias(f), F.col(f).isNull().cast("int").alias(f"{f}_missing"))]
