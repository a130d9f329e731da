"""Retrieval in rounds, all questions at once: a frontier table that is retrieved for, judged and written again until nothing is pending.

The frontier has a row for each question: run, qid, place (in the run's plan), text, route (the next one), status, rounds, attempted
(routes), evidence (ids in the order in which they came), scores (of each id the best that this question has found), best (the
highest f1 so far) and reopened_from (the status to which a reopened question can't fall behind). In a round a run's pending
questions retrieve in the order of the plan, as many as its budget affords. A question whose round failed to judge it widens its
route. Each round's frontier is a saved table, and a later run goes on from any of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwell.operators.decisions import judge_round
from groundwell.operators.retrieval import route_filter, small, top, with_fallback
from groundwell.sources.work import saved

#: From narrow to wide; a question goes on to the next one and stays at the last.
ROUTES = ("arxiv_meta", "arxiv_fulltext", "web", "evidence_store")
PENDING = ("pending", "in_progress")
#: How far a status is from an answer; a reopened question never gets a lower one than it had.
RANKS = {"abandoned": 0, "insufficient": 1, "in_progress": 2, "sufficient": 3}
SCORES = "map<long,double>"


def frontier(questions: DataFrame, first: Column | str = ROUTES[0]) -> DataFrame:
    """questions (run, qid, place, text), untried, on the route first."""
    route = F.lit(first) if isinstance(first, str) else first
    return questions.select(
        "run", "qid", "place", "text", route.alias("route"), F.lit("pending").alias("status"), F.lit(0).alias("rounds"), F.array().cast("array<string>").alias("attempted"),
        F.array().cast("array<long>").alias("evidence"), F.create_map().cast(SCORES).alias("scores"), F.lit(None).cast("double").alias("best"), F.lit(None).cast("string").alias("reopened_from"),
    )


def reopened(rows: DataFrame, which: Column) -> DataFrame:
    """The questions that `which` names are pending again, and remember what they were."""
    return rows.withColumn("reopened_from", F.when(which, F.col("status")).otherwise(F.col("reopened_from"))).withColumn("status", F.when(which, "in_progress").otherwise(F.col("status")))


def merged_scores(old: Column, new: Column) -> Column:
    """Of each id the greater score; null is no score."""
    return F.map_zip_with(old, new, lambda _, x, y: F.greatest(x, y))


def never_worse(status: Column, before: Column) -> Column:
    rank = lambda c: F.coalesce(*[F.when(c == s, F.lit(n)) for s, n in RANKS.items()], F.lit(-1))
    return F.when(before.isNotNull() & (rank(status) < rank(before)), before).otherwise(status)


def wider(route: Column) -> Column:
    at = F.array_position(F.array(*map(F.lit, ROUTES)), route)
    return F.element_at(F.array(*map(F.lit, ROUTES)), F.least(at + 1, F.lit(len(ROUTES))).cast("int"))


def retrieve_on_routes(scored: DataFrame, passages: DataFrame, rerank_score: Callable[[DataFrame], DataFrame], candidates: int = 30, k: int = 8) -> Callable[[DataFrame], DataFrame]:
    """A round's retrieval from scores (qid, id, score) that were searched once: what the question's route lets pass, or everything where that
    is nothing; the first candidates, reranked. passages: id, source_id, source_type, section.

    rerank_score gets rows (qid, id, ...) and adds rerank_score."""
    held = scored.join(passages.select("id", "source_id", "source_type", "section"), "id")

    def run(asked: DataFrame) -> DataFrame:
        rows = held.join(small(asked.select("qid", "route")), "qid").withColumn("ok", route_filter(F.col("route")))
        first = top(with_fallback(rows, "ok"), candidates, ["qid"], F.desc("score"), "id").withColumnRenamed("rank", "fusion_rank")
        return top(rerank_score(first), k, ["qid"], F.desc("rerank_score"), "fusion_rank").select("qid", "id", "source_id", "rerank_score", "rank")

    return run


def affordable(rows: DataFrame, cap: int) -> DataFrame:
    """Adds `now`: pending questions, in order of the plan, that the run's budget affords after its rounds so far."""
    run = Window.partitionBy("run")
    open_ = F.col("status").isin(*PENDING)
    turn = F.sum(open_.cast("int")).over(run.orderBy("place", "qid").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_spent", F.sum("rounds").over(run)).withColumn("now", open_ & (turn + F.col("_spent") <= cap)).drop("_spent")


def one_round(rows: DataFrame, retrieve: Callable[[DataFrame], DataFrame], cap: int) -> DataFrame:
    """The frontier after a round."""
    marked = saved(affordable(rows, cap), "round")
    found = retrieve(marked.where("now"))
    scores = F.map_from_entries(F.collect_list(F.when(F.col("rerank_score").isNotNull(), F.struct(F.col("id"), F.col("rerank_score")))))
    of = found.groupBy("qid").agg(
        F.max("rerank_score").alias("f1"), F.count_distinct(F.when(F.col("source_id") != "", F.col("source_id"))).cast("int").alias("sources"), F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("ids"), scores.alias("new")
    )
    both = marked.join(of, "qid", "left")
    rounds = F.col("rounds") + 1
    status = judge_round(rounds, F.col("f1"), F.coalesce("sources", F.lit(0)), F.col("best"))
    after = {
        "status": never_worse(status, F.col("reopened_from")), "rounds": rounds, "attempted": F.array_append("attempted", F.col("route")), "evidence": F.array_union("evidence", F.coalesce("ids", F.array().cast("array<long>"))),
        "scores": F.coalesce(merged_scores(F.col("scores"), F.col("new")), F.col("scores")), "best": F.greatest("best", "f1"), "route": F.when(status.isin(*PENDING), wider(F.col("route"))).otherwise(F.col("route")), "reopened_from": F.lit(None).cast("string"),
    }
    return both.select(*[F.when(F.col("now"), after[c]).otherwise(F.col(c)).alias(c) if c in after else F.col(c) for c in rows.columns])


def run_rounds(rows: DataFrame, retrieve: Callable[[DataFrame], DataFrame], cap: int, each: Callable[[int, DataFrame], None] | None = None) -> DataFrame:
    """Rounds until no question is pending, or none that its run affords. each gets the number and the saved frontier of every round."""
    n = 0
    while affordable(rows, cap).where("now").limit(1).count():
        rows = saved(one_round(rows, retrieve, cap), "frontier")
        n += 1
        if each:
            each(n, rows)
    return rows
