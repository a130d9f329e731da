"""Decisions about open questions and runs: values, allocation, round policy, resolution, terminal decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUFFICIENT_AT, HOPELESS_AT = 4.0, 0.0
MOST_ROUNDS, LEAST_GAIN, LEAST_SOURCES = 3, 0.5, 2
DECAY, LEAST_VALUE, NO_EVIDENCE_VALUE = 0.5, 0.05, 0.3
ANSWER_AT, PARTIAL_AT = 0.65, 0.40
RETRIEVALS, RESERVE = 20, 0.20


def marginal_value(status: Column, rounds: Column, f1: Column) -> Column:
    """What one more round is worth."""
    near = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.coalesce(f1, F.lit(0.0)) - HOPELESS_AT) / (SUFFICIENT_AT - HOPELESS_AT)))
    chance = 1 / (1 + DECAY * rounds)
    tried = F.greatest(F.lit(LEAST_VALUE), F.when(f1.isNull(), NO_EVIDENCE_VALUE).otherwise(near) * chance)
    return F.round(F.when(status.isin("sufficient", "abandoned"), 0.0).when(rounds == 0, 1.0).otherwise(tried), 9)


def allocatable(cap: Column, used: Column) -> Column:
    """What may be given out: the reserve is rounded half to even."""
    return F.greatest(F.lit(0), cap - F.bround(cap * F.lit(RESERVE)) - used).cast("int")


def even_split(pool: Column, n: Column, place: Column, least: int = 1) -> Column:
    """The share of the row at place (from 0) of n: all of the pool goes out, the rest to the first rows."""
    funded = F.floor(pool / F.lit(least))
    starved = F.when(place < funded, least).otherwise(0) + F.when(place < pool - F.least(funded, n) * least, 1).otherwise(0)
    fair = F.floor(pool / n) + F.when(place < pool % n, 1).otherwise(0)
    return F.when(pool <= 0, 0).when(pool < least * n, starved).otherwise(fair).cast("int")


def allocate(rows: DataFrame) -> DataFrame:
    """rows (run, pos, value, pool): adds share. A first try for each untried row, the rest by value with largest remainders."""
    run = Window.partitionBy("run")
    r = rows.withColumn("n", F.count(F.lit(1)).over(run)).withColumn("untried", F.sum((F.col("value") >= 1).cast("int")).over(run)).withColumn("total", F.sum("value").over(run))
    r = r.withColumn("rest", F.col("pool") - F.col("untried"))
    exact = F.when((F.col("total") > 0) & (F.col("rest") > 0), F.round(F.col("rest") * F.col("value") / F.col("total"), 9)).otherwise(0.0)
    r = r.withColumn("exact", exact).withColumn("whole", F.floor("exact").cast("int"))
    r = r.withColumn("short", F.col("rest") - F.sum("whole").over(run))
    by_part = Window.partitionBy("run").orderBy((F.col("value") <= 0).cast("int"), F.desc(F.round(F.col("exact") - F.col("whole"), 9)), "pos")
    r = r.withColumn("turn", F.row_number().over(by_part))
    share = F.when(F.col("value") >= 1, 1).otherwise(0) + F.col("whole") + F.when((F.col("value") > 0) & (F.col("turn") <= F.col("short")), 1).otherwise(0)
    place = F.row_number().over(Window.partitionBy("run").orderBy("pos")) - 1
    out = F.when(F.col("pool") <= 0, 0).when(F.col("rest") <= 0, even_split(F.col("pool"), F.col("n"), place)).otherwise(share)
    return r.withColumn("share", out.cast("int")).drop("n", "untried", "total", "rest", "exact", "whole", "short", "turn")


def label_of(f1: Column) -> Column:
    return F.when(f1 >= SUFFICIENT_AT, "sufficient").when(f1 <= HOPELESS_AT, "abandoned").otherwise("insufficient")


def judge_round(rounds: Column, f1: Column, sources: Column, best: Column) -> Column:
    """The state of a question after a round; best is the highest f1 of the rounds before, or null."""
    over = rounds >= MOST_ROUNDS
    flat = F.coalesce(F.round(f1 - best, 6) < LEAST_GAIN, F.lit(False))
    return (
        F.when(f1.isNull(), F.when(over, "abandoned").otherwise("in_progress"))
        .when((f1 >= SUFFICIENT_AT) & (sources >= LEAST_SOURCES), "sufficient")
        .when(flat | over, label_of(f1))
        .otherwise("in_progress")
    )


def verdict_strength(verdict: Column) -> Column:
    return F.when(verdict == "SUPPORTED", 1.0).when(verdict.isin("UNSUPPORTED", "CONTRADICTED"), 0.0).otherwise(0.5)


def resolved(status: Column, f6: Column, supported: Column) -> Column:
    """By retrieval unless the claims say otherwise, or by the claims themselves."""
    return ((status == "sufficient") & F.coalesce(f6 >= 0.5, F.lit(True))) | (F.coalesce(f6 >= 0.5, F.lit(False)) & (supported >= 2))


def terminal(score: Column, premise_failed: Column, critic_failed: Column, has_draft: Column, error: Column, has_evidence: Column) -> tuple[Column, Column]:
    """The decision and the rule that made it; the first rule that applies."""
    no_text = ~has_draft & error
    rule = F.when(premise_failed, "premise").when(critic_failed | no_text, "system_failure").when(~has_evidence | score.isNull(), "no_evidence").otherwise("threshold")
    by_score = F.when(score >= ANSWER_AT, "ANSWER").when(score >= PARTIAL_AT, "PARTIAL").otherwise("ABSTAIN")
    return F.when(rule == "threshold", by_score).otherwise("ABSTAIN"), rule


def margin(score: Column, rule: Column) -> Column:
    return F.when(rule == "threshold", F.round(F.least(F.abs(score - ANSWER_AT), F.abs(score - PARTIAL_AT)), 4))


def next_node(c: dict[str, Column]) -> Column:
    """The node that a run goes to next, from its flags."""
    research_over = c["error"] | c["decided"]
    write = ~c["draft"] & (c["decision"] != "ABSTAIN") & ~c["premise_failed"] & c["evidence"] & ~c["error"]
    after = F.when(write, "synthesizer").when(c["draft"] & ~c["reviewed"], "critic").when(c["findings"] & ~c["routed"], "critic_router").when(~c["decided"], "decider").when(~c["report"], "finalizer").otherwise("finish")
    return (
        F.when(research_over, after)
        .when(~c["premise_ran"], "premise_checker")
        .when(c["premise_failed"] & ~c["planned"], after)
        .when(~c["planned"], "planner")
        .when(c["pending"], F.when(c["budget"], "retriever").otherwise(after))
        .when(c["revisable"] & c["budget"], "planner")
        .otherwise(after)
    )
