"""Queries over runs (orders) and their open questions (order lines): values, budgets, rounds, claims, decisions.

What the tables lack (claims, evidence lists, flags of a run) are rules on their keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundwell.operators import decisions as d
from groundwell.operators import drafts as dr
from groundwell.operators import planning as pl
from groundwell.sources.tables import PLAN_SQL, plan_rows, read

VERDICTS = ["SUPPORTED", "PARTIAL", "UNSUPPORTED", "CONTRADICTED"]


def _valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_rows(spark, sf_dir).withColumn("value", d.marginal_value(F.col("status"), F.col("rounds"), F.col("f1")))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, pos, claim, verdict."""
    p = plan_rows(spark, sf_dir).where("part % 4 > 0").select("run", "pos", "part", F.explode(F.sequence(F.lit(1), (F.col("part") % 4).cast("int"))).alias("claim"))
    return p.select("run", "pos", "claim", F.element_at(F.array(*map(F.lit, VERDICTS)), ((F.col("part") + F.col("claim")) % 4 + 1).cast("int")).alias("verdict"))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, pos, status, rank, passage: the ranked evidence list of each question."""
    p = plan_rows(spark, sf_dir).where("supp % 5 > 0")
    p = p.select("run", "pos", "status", "part", F.explode(F.sequence(F.lit(1), (F.col("supp") % 5).cast("int"))).alias("rank"))
    return p.select("run", "pos", "status", "rank", ((F.col("part") + 3 * F.col("rank")) % 12).alias("passage"))


def marginal_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _valued(spark, sf_dir).select("run", "pos", "status", "rounds", "f1", "value")


def next_sub_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("run").orderBy(F.desc("value"), "pos")
    return _valued(spark, sf_dir).where("value > 0").withColumn("n", F.row_number().over(w)).where("n = 1").select("run", "pos", "value")


def _pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("run"), (F.col("o_custkey") % 18).cast("int").alias("used")).withColumn("pool", d.allocatable(F.lit(d.RETRIEVALS), F.col("used")))


def largest_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _valued(spark, sf_dir).join(_pools(spark, sf_dir), "run")
    return d.allocate(rows.select("run", "pos", "value", "pool"))


def uniform_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = plan_rows(spark, sf_dir).join(_pools(spark, sf_dir), "run")
    n = F.count(F.lit(1)).over(Window.partitionBy("run"))
    return rows.select("run", "pos", "pool", d.even_split(F.col("pool"), n, F.col("pos") - 1).alias("share"))


def budget_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pools(spark, sf_dir)
    return p.select("run", "used", "pool", (F.col("pool") <= 0).alias("in_reserve"), F.round(F.coalesce(F.try_divide(F.col("used"), F.lit(d.RETRIEVALS)), F.lit(0.0)), 6).alias("consumed"), (F.col("used") + 1 <= d.RETRIEVALS).alias("can_spend"))


def spend_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spending in order of date for each customer: the calls that go over the cap."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    o = read(spark, sf_dir, "orders").withColumn("spent", F.sum((F.col("o_orderkey") % 3 + 1).cast("long")).over(w))
    return o.where(F.col("spent") > d.RETRIEVALS).select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("run"), "spent")


def round_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's questions in order as the rounds of one question."""
    best = F.max("f1").over(Window.partitionBy("run").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    p = plan_rows(spark, sf_dir).withColumn("best", best)
    return p.select("run", "pos", "f1", "best", d.judge_round(F.col("pos"), F.col("f1"), F.col("sources"), F.col("best")).alias("state"))


def claim_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).groupBy("run", "pos").agg(F.round(F.avg(d.verdict_strength(F.col("verdict"))), 6).alias("f6"), F.sum((F.col("verdict") == "SUPPORTED").cast("int")).alias("supported"), F.count(F.lit(1)).alias("claims"))


def resolve_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = plan_rows(spark, sf_dir).join(claim_features(spark, sf_dir), ["run", "pos"], "left")
    return rows.select("run", "pos", "kind", "status", "rounds", "f6", d.resolved(F.col("status"), F.col("f6"), F.coalesce("supported", F.lit(0))).alias("resolved"))


def run_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of resolved core questions of each run; null without one."""
    core = F.col("kind") == "core"
    return resolve_heuristic(spark, sf_dir).groupBy("run").agg(
        F.round(F.avg(F.when(core, F.col("resolved").cast("double"))), 6).alias("score"), F.bool_or(F.col("rounds") > 0).alias("has_evidence"), F.sum((~F.col("resolved")).cast("int")).alias("unresolved"),
        F.round(F.avg((F.col("status") == "sufficient").cast("double")), 6).alias("sufficient_share"),
    )


def decide_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run"), ((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_custkey") % 5 == 0)).alias("premise_failed"), ((F.col("o_orderstatus") == "P") & (F.col("o_custkey") % 3 == 0)).alias("critic_failed"),
        (F.col("o_custkey") % 7 != 0).alias("has_draft"), (F.col("o_custkey") % 13 == 0).alias("error"),
    )
    r = o.join(run_scores(spark, sf_dir), "run")
    decision, rule = d.terminal(F.col("score"), F.col("premise_failed"), F.col("critic_failed"), F.col("has_draft"), F.col("error"), F.col("has_evidence"))
    r = r.withColumn("terminal", decision).withColumn("rule", rule)
    return r.select("run", "score", "terminal", "rule", d.margin(F.col("score"), F.col("rule")).alias("margin"), F.col("rule").isin("premise", "no_evidence", "threshold").alias("epistemic"), (F.col("terminal") == "ANSWER").alias("same_when_static"))


def verdict_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    is_in = lambda *v: F.sum(F.col("verdict").isin(*v).cast("int"))
    n = F.count(F.lit(1))
    return findings(spark, sf_dir).groupBy("run").agg(n.alias("claims"), F.round(F.try_divide(is_in("SUPPORTED"), n), 6).alias("precision"), F.round(F.try_divide(is_in("UNSUPPORTED", "CONTRADICTED"), n), 6).alias("unsupported_rate"))


def critic_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A failed claim goes back to retrieval if its question is live and the run has budget left."""
    f = findings(spark, sf_dir).join(plan_rows(spark, sf_dir).select("run", "pos", "status"), ["run", "pos"]).join(_pools(spark, sf_dir), "run")
    action = F.when(F.col("verdict") == "SUPPORTED", "ACCEPT").when((F.col("status") != "abandoned") & (F.col("pool") > 0), "RE_RETRIEVE").otherwise("UNRESOLVED")
    return f.withColumn("action", action).groupBy("run", "action").agg(F.count(F.lit(1)).alias("claims"))


def revision_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first question of a run that was tried and is insufficient."""
    return pl.first_failed(plan_rows(spark, sf_dir))


def run_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pl.progress(plan_rows(spark, sf_dir))


def controller_next_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_custkey")
    o = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run"), (k % 17 == 0).alias("error"), (F.col("o_orderstatus") == "F").alias("decided"), F.when(k % 2 == 0, "ABSTAIN").otherwise("ANSWER").alias("decision"), (k % 3 != 0).alias("draft"), (k % 11 == 0).alias("premise_failed"),
        (k % 19 != 0).alias("premise_ran"), (k % 5 != 0).alias("reviewed"), (k % 23 != 0).alias("findings"), (k % 4 != 0).alias("routed"), (k % 7 == 0).alias("report"),
    )
    target = revision_target(spark, sf_dir).select("run", F.lit(True).alias("revisable"))
    r = o.join(run_progress(spark, sf_dir).select("run", "pending"), "run", "left").join(target, "run", "left").join(_pools(spark, sf_dir).select("run", "used"), "run")
    c = {x: F.col(x) for x in o.columns[1:]} | {"planned": F.col("pending").isNotNull(), "evidence": F.col("pending").isNotNull(), "pending": F.coalesce("pending", F.lit(0)) > 0, "revisable": F.coalesce("revisable", F.lit(False)), "budget": F.col("used") < d.RETRIEVALS - 4}
    return r.select("run", d.next_node(c).alias("node"))


def premise_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four questions of a run as presuppositions."""
    verdict = F.element_at(F.array(F.lit("SUPPORTED"), F.lit("UNVERIFIABLE"), F.lit("CONTRADICTED")), (F.col("part") % 3 + 1).cast("int"))
    return dr.grounding(plan_rows(spark, sf_dir).where("pos <= 4").select("run", "pos", "kind", verdict.alias("verdict")))


def passage_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dr.owners(evidence(spark, sf_dir))


def round_robin_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dr.round_robin(evidence(spark, sf_dir))


def plan_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insufficient questions that were tried become two each, numbered after their parent; the plan is numbered anew."""
    split = (F.col("status") == "insufficient") & (F.col("rounds") >= 1)
    p = plan_rows(spark, sf_dir).select("run", "pos", F.explode(F.when(split, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("")))).alias("suffix"), F.when(split, "pending").otherwise(F.col("status")).alias("status"))
    return p.select("run", F.concat(F.lit("sq"), F.col("pos").cast("string"), "suffix").alias("id"), "status", F.row_number().over(Window.partitionBy("run").orderBy("pos", "suffix")).alias("pos"))


def run_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and least value, share of sufficient questions and consumed budget of each run."""
    v = _valued(spark, sf_dir).groupBy("run").agg(F.round(F.avg("value"), 6).alias("r1"), F.round(F.min("value"), 6).alias("r2"), F.round(F.avg((F.col("status") == "sufficient").cast("double")), 6).alias("r3"))
    return v.join(budget_counters(spark, sf_dir).select("run", F.col("consumed").alias("r5")), "run")


_V = "val AS (SELECT *, round(CASE WHEN status IN ('sufficient', 'abandoned') THEN 0.0 WHEN rounds = 0 THEN 1.0 ELSE greatest(0.05, CASE WHEN f1 IS NULL THEN 0.3 ELSE greatest(0.0, least(1.0, f1 / 4.0)) END / (1 + 0.5 * rounds)) END, 9) AS value FROM plan)"
_POOL = "pools AS (SELECT o_orderkey AS run, CAST(o_custkey % 18 AS INT) AS used, CAST(greatest(0, 16 - o_custkey % 18) AS INT) AS pool FROM orders)"
_FIND = "fc AS (SELECT run, pos, part, unnest(generate_series(1, part % 4)) AS claim FROM plan WHERE part % 4 > 0), finds AS (SELECT run, pos, claim, (['SUPPORTED', 'PARTIAL', 'UNSUPPORTED', 'CONTRADICTED'])[CAST((part + claim) % 4 + 1 AS INT)] AS verdict FROM fc)"
_EV = "e0 AS (SELECT run, pos, status, part, unnest(generate_series(1, supp % 5)) AS rank FROM plan WHERE supp % 5 > 0), ev AS (SELECT run, pos, status, CAST(rank AS INT) AS rank, (part + 3 * rank) % 12 AS passage FROM e0)"
_RES = f"""{_FIND}, cf AS (SELECT run, pos, round(avg(CASE WHEN verdict = 'SUPPORTED' THEN 1.0 WHEN verdict IN ('UNSUPPORTED', 'CONTRADICTED') THEN 0.0 ELSE 0.5 END), 6) AS f6, CAST(count(*) FILTER (verdict = 'SUPPORTED') AS BIGINT) AS supported, count(*) AS claims FROM finds GROUP BY ALL),
res AS (SELECT run, pos, kind, status, rounds, f6, (status = 'sufficient' AND coalesce(f6 >= 0.5, true)) OR (coalesce(f6 >= 0.5, false) AND coalesce(supported, 0) >= 2) AS resolved FROM plan LEFT JOIN cf USING (run, pos))"""
_SPLIT = "CASE WHEN pool <= 0 THEN 0 WHEN pool < n THEN CASE WHEN pos - 1 < pool THEN 1 ELSE 0 END ELSE pool // n + CASE WHEN pos - 1 < pool % n THEN 1 ELSE 0 END END"
_PROGRESS = """pr AS (SELECT run, CAST(count(*) FILTER (status = 'pending') AS BIGINT) AS pending, count(*) FILTER (status = 'pending') = 0 AS all_terminal, CAST(count(*) FILTER (status = 'sufficient') AS BIGINT) AS n_sufficient, CAST(count(*) FILTER (status = 'insufficient') AS BIGINT) AS n_insufficient, CAST(count(*) FILTER (status = 'abandoned') AS BIGINT) AS n_abandoned FROM plan GROUP BY run)"""
_AFTER = "CASE WHEN NOT draft AND decision <> 'ABSTAIN' AND NOT premise_failed AND planned AND NOT error THEN 'synthesizer' WHEN draft AND NOT reviewed THEN 'critic' WHEN findings AND NOT routed THEN 'critic_router' WHEN NOT decided THEN 'decider' WHEN NOT report THEN 'finalizer' ELSE 'finish' END"

QUERIES = {
    f.__name__: f
    for f in (
        marginal_value, next_sub_question, largest_remainder, uniform_split, budget_counters, spend_violations, round_policy, claim_features, resolve_heuristic, run_scores, decide_terminal, verdict_metrics, critic_route,
        revision_target, run_progress, controller_next_node, premise_summary, passage_owner, round_robin_evidence, plan_split, run_features,
    )
}

ORACLE_SQL = {
    "marginal_value": f"WITH {PLAN_SQL}, {_V} SELECT run, pos, status, rounds, f1, value FROM val",
    "next_sub_question": f"WITH {PLAN_SQL}, {_V} SELECT run, pos, value FROM val WHERE value > 0 QUALIFY row_number() OVER (PARTITION BY run ORDER BY value DESC, pos) = 1",
    "largest_remainder": f"""WITH {PLAN_SQL}, {_V}, {_POOL}, a AS (SELECT run, pos, value, pool, count(*) OVER w AS n, pool - count(*) FILTER (value >= 1) OVER w AS rest, sum(value) OVER w AS total FROM val JOIN pools USING (run) WINDOW w AS (PARTITION BY run)),
b AS (SELECT *, CASE WHEN total > 0 AND rest > 0 THEN round(rest * value / total, 9) ELSE 0.0 END AS exact FROM a), c AS (SELECT *, floor(exact) AS whole, rest - sum(floor(exact)) OVER (PARTITION BY run) AS short FROM b),
t AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY CASE WHEN value <= 0 THEN 1 ELSE 0 END, round(exact - whole, 9) DESC, pos) AS turn FROM c)
SELECT run, pos, value, pool, CAST(CASE WHEN pool <= 0 THEN 0 WHEN rest <= 0 THEN {_SPLIT} ELSE CASE WHEN value >= 1 THEN 1 ELSE 0 END + whole + CASE WHEN value > 0 AND turn <= short THEN 1 ELSE 0 END END AS INT) AS share FROM t""",
    "uniform_split": f"WITH {PLAN_SQL}, {_POOL}, a AS (SELECT run, pos, pool, count(*) OVER (PARTITION BY run) AS n FROM plan JOIN pools USING (run)) SELECT run, pos, pool, CAST({_SPLIT} AS INT) AS share FROM a",
    "budget_counters": f"WITH {_POOL} SELECT run, used, pool, pool <= 0 AS in_reserve, round(used / 20, 6) AS consumed, used + 1 <= 20 AS can_spend FROM pools",
    "spend_violations": "WITH s AS (SELECT o_custkey AS customer, o_orderkey AS run, CAST(sum(o_orderkey % 3 + 1) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent FROM orders) SELECT * FROM s WHERE spent > 20",
    "round_policy": f"""WITH {PLAN_SQL}, b AS (SELECT *, max(f1) OVER (PARTITION BY run ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM plan)
SELECT run, pos, f1, best, CASE WHEN f1 IS NULL THEN CASE WHEN pos >= 3 THEN 'abandoned' ELSE 'in_progress' END WHEN f1 >= 4 AND sources >= 2 THEN 'sufficient'
  WHEN coalesce(round(f1 - best, 6) < 0.5, false) OR pos >= 3 THEN CASE WHEN f1 >= 4 THEN 'sufficient' WHEN f1 <= 0 THEN 'abandoned' ELSE 'insufficient' END ELSE 'in_progress' END AS state FROM b""",
    "claim_features": f"WITH {PLAN_SQL}, {_RES} SELECT * FROM cf",
    "resolve_heuristic": f"WITH {PLAN_SQL}, {_RES} SELECT * FROM res",
    "run_scores": f"WITH {PLAN_SQL}, {_RES} SELECT run, round(avg(CASE WHEN kind = 'core' THEN CAST(resolved AS INT) END), 6) AS score, bool_or(rounds > 0) AS has_evidence, CAST(count(*) FILTER (NOT resolved) AS BIGINT) AS unresolved, round(avg(CASE WHEN status = 'sufficient' THEN 1.0 ELSE 0.0 END), 6) AS sufficient_share FROM res GROUP BY run",
    "decide_terminal": f"""WITH {PLAN_SQL}, {_RES}, s AS (SELECT run, round(avg(CASE WHEN kind = 'core' THEN CAST(resolved AS INT) END), 6) AS score, bool_or(rounds > 0) AS has_evidence FROM res GROUP BY run),
r AS (SELECT s.*, CASE WHEN o_orderpriority = '1-URGENT' AND o_custkey % 5 = 0 THEN 'premise' WHEN (o_orderstatus = 'P' AND o_custkey % 3 = 0) OR (o_custkey % 7 = 0 AND o_custkey % 13 = 0) THEN 'system_failure' WHEN NOT has_evidence OR score IS NULL THEN 'no_evidence' ELSE 'threshold' END AS rule FROM s JOIN orders ON run = o_orderkey),
t AS (SELECT *, CASE WHEN rule <> 'threshold' THEN 'ABSTAIN' WHEN score >= 0.65 THEN 'ANSWER' WHEN score >= 0.40 THEN 'PARTIAL' ELSE 'ABSTAIN' END AS terminal FROM r)
SELECT run, score, terminal, rule, CASE WHEN rule = 'threshold' THEN round(least(abs(score - 0.65), abs(score - 0.40)), 4) END AS margin, rule IN ('premise', 'no_evidence', 'threshold') AS epistemic, terminal = 'ANSWER' AS same_when_static FROM t""",
    "verdict_metrics": f"WITH {PLAN_SQL}, {_FIND} SELECT run, count(*) AS claims, round(count(*) FILTER (verdict = 'SUPPORTED') / count(*), 6) AS precision, round(count(*) FILTER (verdict IN ('UNSUPPORTED', 'CONTRADICTED')) / count(*), 6) AS unsupported_rate FROM finds GROUP BY run",
    "critic_route": f"WITH {PLAN_SQL}, {_FIND}, {_POOL}, a AS (SELECT finds.run, CASE WHEN verdict = 'SUPPORTED' THEN 'ACCEPT' WHEN status <> 'abandoned' AND pool > 0 THEN 'RE_RETRIEVE' ELSE 'UNRESOLVED' END AS action FROM finds JOIN plan USING (run, pos) JOIN pools ON finds.run = pools.run) SELECT run, action, count(*) AS claims FROM a GROUP BY ALL",
    "revision_target": f"WITH {PLAN_SQL} SELECT run, min(pos) AS pos FROM plan WHERE status = 'insufficient' AND rounds >= 1 GROUP BY run",
    "run_progress": f"WITH {PLAN_SQL}, {_PROGRESS} SELECT * FROM pr",
    "controller_next_node": f"""WITH {PLAN_SQL}, {_PROGRESS}, f AS (SELECT o_orderkey AS run, o_custkey % 17 = 0 AS error, o_orderstatus = 'F' AS decided, CASE WHEN o_custkey % 2 = 0 THEN 'ABSTAIN' ELSE 'ANSWER' END AS decision, o_custkey % 3 <> 0 AS draft, o_custkey % 11 = 0 AS premise_failed, o_custkey % 19 <> 0 AS premise_ran,
  o_custkey % 5 <> 0 AS reviewed, o_custkey % 23 <> 0 AS findings, o_custkey % 4 <> 0 AS routed, o_custkey % 7 = 0 AS report, o_custkey % 18 < 16 AS budget, pr.pending IS NOT NULL AS planned, coalesce(pr.pending, 0) > 0 AS pending, o_orderkey IN (SELECT run FROM plan WHERE status = 'insufficient' AND rounds >= 1) AS revisable FROM orders LEFT JOIN pr ON pr.run = o_orderkey),
g AS (SELECT *, {_AFTER} AS after FROM f) SELECT run, CASE WHEN error OR decided THEN after WHEN NOT premise_ran THEN 'premise_checker' WHEN premise_failed AND NOT planned THEN after WHEN NOT planned THEN 'planner' WHEN pending THEN CASE WHEN budget THEN 'retriever' ELSE after END WHEN revisable AND budget THEN 'planner' ELSE after END AS node FROM g""",
    "premise_summary": f"""WITH {PLAN_SQL}, a AS (SELECT *, (['SUPPORTED', 'UNVERIFIABLE', 'CONTRADICTED'])[CAST(part % 3 + 1 AS INT)] AS verdict, bool_or(kind = 'core') OVER (PARTITION BY run) AS has_core FROM plan WHERE pos <= 4), b AS (SELECT *, kind = 'core' OR NOT has_core AS used FROM a)
SELECT run, round(coalesce(avg(CASE verdict WHEN 'SUPPORTED' THEN 1.0 WHEN 'CONTRADICTED' THEN 0.0 ELSE 0.5 END) FILTER (used), 1.0), 6) AS grounding, bool_or(used AND verdict = 'CONTRADICTED') AS failed, min(pos) FILTER (used AND verdict = 'CONTRADICTED') AS first_failure, CAST(count(*) FILTER (used AND verdict = 'SUPPORTED') AS BIGINT) AS confirmed FROM b GROUP BY run""",
    "passage_owner": f"WITH {PLAN_SQL}, {_EV} SELECT run, passage, pos AS owner, status <> 'abandoned' AS live FROM ev QUALIFY row_number() OVER (PARTITION BY run, passage ORDER BY status = 'abandoned', pos, rank) = 1",
    "round_robin_evidence": f"""WITH {PLAN_SQL}, {_EV}, l AS (SELECT run, passage, rank, pos FROM ev WHERE status <> 'abandoned' QUALIFY row_number() OVER (PARTITION BY run, passage ORDER BY rank, pos) = 1), x AS (SELECT run, passage, pos AS dpos, rank AS drank FROM ev QUALIFY row_number() OVER (PARTITION BY run, passage ORDER BY pos, rank) = 1)
SELECT run, passage, CAST(row_number() OVER (PARTITION BY run ORDER BY l.rank NULLS LAST, l.pos, dpos, drank, passage) AS INT) AS place, l.rank IS NOT NULL AS live FROM x LEFT JOIN l USING (run, passage) QUALIFY place <= 24""",
    "plan_split": f"WITH {PLAN_SQL}, s AS (SELECT run, pos, unnest(CASE WHEN status = 'insufficient' AND rounds >= 1 THEN ['a', 'b'] ELSE [''] END) AS suffix, CASE WHEN status = 'insufficient' AND rounds >= 1 THEN 'pending' ELSE status END AS status FROM plan) SELECT run, 'sq' || pos || suffix AS id, status, CAST(row_number() OVER (PARTITION BY run ORDER BY pos, suffix) AS INT) AS pos FROM s",
    "run_features": f"WITH {PLAN_SQL}, {_V}, {_POOL}, v AS (SELECT run, round(avg(value), 6) AS r1, round(min(value), 6) AS r2, round(avg(CASE WHEN status = 'sufficient' THEN 1.0 ELSE 0.0 END), 6) AS r3 FROM val GROUP BY run) SELECT run, r1, r2, r3, round(used / 20, 6) AS r5 FROM v JOIN pools USING (run)",
}
