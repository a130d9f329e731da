"""Queries over plans under way: rewrites, routing of claims, gates, budgets, rounds, routes, and scores in two stages.

What the tables lack (a model's choices, attempted queries, counters) are rules on the keys of runs and questions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwell.operators import decisions as d
from groundwell.operators import planning as pl
from groundwell.operators import rules
from groundwell.plans import decisions
from groundwell.sources.tables import CALLS_SQL, PLAN_SQL, calls, plan_rows, read

ACTIONS = ["REWRITE", "SPLIT", "MERGE", "ABANDON"]
ROUTES = ["ACCEPT", "RE_RETRIEVE", "REVISE_PLAN", "HEDGE", "DROP_CLAIM", "UNRESOLVED"]
KINDS = ["background", " Background ", "core", "", "other"]
MOST_REVISIONS = 2


def _nth(values: list, at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))


def _sq(pos: Column) -> Column:
    return F.concat(F.lit("sq"), pos.cast("string"))


def plan_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's plan after its first insufficient question was rewritten, split, merged or given up. A rewrite that says the same, a split with
    fewer than two usable parts and a merge into no question of the plan give it up, and leave a gap."""
    target = decisions.revision_target(spark, sf_dir).select("run", F.col("pos").alias("target"))
    p = plan_rows(spark, sf_dir)
    n = p.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    p = p.join(target, "run", "left").join(n, "run").withColumn("hit", F.coalesce(F.col("pos") == F.col("target"), F.lit(False))).withColumn("action", _nth(ACTIONS, F.col("run")))
    into = F.col("part") % 5 + 1
    p = p.select("run", _sq(F.col("pos")).alias("id"), "status", "rounds", "hit", "action", (F.col("part") % 2 == 0).alias("differs"), (F.col("part") % 5).alias("parts"), F.when(into <= F.col("n"), _sq(into)).alias("into"))
    return rules.rewritten_plan(p)


def covered_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abandoned questions that a live one of their run covers, by the field or, in older plans, by the words of the reason."""
    p = plan_rows(spark, sf_dir)
    into = _sq(F.col("part") % 7 + 1)
    plan = p.select("run", "pos", _sq(F.col("pos")).alias("id"), "status", F.when(F.col("part") % 2 == 0, into).alias("covered_by"), F.concat(F.lit("covered by "), into, F.lit(": "), "status").alias("rationale"))
    return pl.covered(plan).select("run", F.substring("id", 3, 9).cast("int").alias("pos"), "into")


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each run: whether it is decided, its pool, and revisions done (the larger of two counters) under the smaller of two ceilings."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), (F.col("o_orderstatus") == "F").alias("decided"), F.greatest(F.col("o_custkey") % 3, F.col("o_orderkey") % 4).cast("int").alias("done"), F.least(F.lit(MOST_REVISIONS), F.col("o_custkey") % 2 + 1).cast("int").alias("ceiling"))
    return o.join(decisions._pools(spark, sf_dir).select("run", "used", "pool"), "run")


def revisions_remain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a run may revise its plan, and whether it should: it may, has budget, and has a tried question that is insufficient."""
    target = decisions.revision_target(spark, sf_dir).select("run", F.lit(True).alias("has_target"))
    f = _flags(spark, sf_dir).join(target, "run", "left")
    remain, should = pl.should_revise(F.col("done"), F.col("ceiling"), F.col("used"), F.col("has_target"))
    return f.select("run", "done", "ceiling", remain.alias("remain"), should.alias("should_revise"))


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = decisions.findings(spark, sf_dir).join(plan_rows(spark, sf_dir).select("run", "pos", "part", "rounds", "status"), ["run", "pos"]).join(_flags(spark, sf_dir), "run")
    asked = F.when(F.col("verdict") == "SUPPORTED", "ACCEPT").otherwise(_nth(ROUTES[1:], F.col("part") + F.col("claim")))
    available = rules.available_actions(~F.col("decided") & (F.col("pool") > 0), F.col("done") < F.col("ceiling"))
    owned = F.col("part") % 6 > 0
    query = F.when(F.col("part") % 5 == 0, " ").otherwise(F.concat(F.lit(" Q"), (F.col("part") % 4).cast("string"), F.lit(" ")))
    tried = F.slice(F.array(F.lit("q0 "), F.lit("Q1"), F.lit("q2")), 1, F.least(F.lit(3), F.col("rounds")))
    gate = rules.claim_gate(asked, available, owned, query, tried)
    return f.select("run", "pos", "claim", "status", "verdict", asked.alias("asked"), gate.alias("gate"), F.when(gate.isNotNull(), "UNRESOLVED").otherwise(asked).alias("action"), owned.alias("owned"), F.size(available).alias("available"))


def router_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each claim: an action that the run can't have, that no question owns, or whose query was tried is unresolved. And the
    action in binary mode: what isn't supported goes back to retrieval if it is owned."""
    binary = F.when(F.col("verdict") == "SUPPORTED", "ACCEPT").when(F.col("owned"), "RE_RETRIEVE").otherwise("UNRESOLVED")
    return _routed(spark, sf_dir).select("run", "pos", "claim", "asked", "gate", "action", "available", binary.alias("binary"))


def router_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan after the router: claims in order reopen their question or make it insufficient; the verdict that retrieval had reached is kept,
    once. Whether the run needs more work, and so loses its draft."""
    return rules.routed_plan(plan_rows(spark, sf_dir), _routed(spark, sf_dir).where("owned"))


def partial_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a decision does to the draft: withheld when abstaining, written anew in part if that is due, allowed and affordable (three calls left).
    And what a run would have got without the decision layer."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), (F.col("o_custkey") % 7 != 0).alias("draft"), (F.col("o_custkey") % 2 == 0).alias("partial_mode"), (F.col("o_custkey") % 13 == 0).alias("error"), (F.col("o_custkey") % 9 != 0).alias("enabled"), (25 - F.col("o_custkey") % 26).cast("int").alias("left"))
    r = decisions.decide_terminal(spark, sf_dir).select("run", "terminal").join(o, "run")
    end, draft = F.col("terminal"), F.col("draft")
    outcome = pl.partial_outcome(end, draft, F.col("error"), F.col("partial_mode"), F.col("enabled"), F.col("left"))
    return r.select("run", outcome.alias("outcome"), pl.withheld(end, draft, outcome).alias("withheld"), pl.draft_mode(end).alias("mode"), F.lit("ANSWER").alias("static_terminal"), (end != "ANSWER").alias("static_differs"))


def prompt_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens that a prompt may have for each role (a user's last digit)."""
    c = calls(spark, sf_dir).groupBy((F.col("user_id") % 10).alias("role"), "model").agg(F.max("tokens").alias("longest"))
    return pl.prompt_budget(c.withColumn("limit", F.lit(8000)))


def next_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The route and the query of a question's next round."""
    p = plan_rows(spark, sf_dir)
    named = [*pl.ROUTES, "elsewhere"]
    suggested, last = _nth(named, F.col("part")), _nth(list(pl.ROUTES), F.col("supp") + F.col("rounds"))
    decided = F.when(F.col("part") % 3 == 0, pl.known_route(_nth(named, F.col("supp")))).when(F.col("part") % 3 == 1, pl.deeper(last))
    query = F.when(F.col("part") % 4 > 0, F.concat(F.lit(" q"), (F.col("part") % 4).cast("string"))).otherwise("  ")
    tried = F.slice(F.array(F.lit("q1"), F.lit("q2")), 1, F.least(F.lit(2), F.col("rounds")))
    return p.select("run", "pos", pl.next_route(F.col("rounds"), suggested, decided, last).alias("route"), pl.next_query(query, tried, _sq(F.col("pos"))).alias("query"), pl.known_route(suggested).alias("static_route"))


def round_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each round of a run (its questions with as many rounds): best score, sources, rows, and what is made of them."""
    r = plan_rows(spark, sf_dir).groupBy("run", F.col("rounds").alias("round")).agg(F.max("f1").alias("f1"), F.count_distinct("supp").cast("int").alias("sources"), F.count("f1").alias("rows"))
    return pl.round_outcomes(r)


def parsed_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans of conversations, parsed: seven questions at most, background only where that is said and a core remains, and the first turn itself
    where no question is usable."""
    c = read(spark, sf_dir, "conversations").where("role = 'user'").select(F.col("conv_id").alias("run"), F.col("turn").alias("at"), "text", _nth(KINDS, F.col("turn") + F.col("conv_id")).alias("kind"))
    return pl.or_verbatim(pl.parsed(c.where("run % 9 > 0")), c).select(F.col("run").alias("conv_id"), "n", F.col("at").alias("turn"), "kind")


def plan_from_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans as a model's reply lists them (the first turns of a conversation, every third as a bare string, some called question, every seventh blank), read and parsed."""
    c = read(spark, sf_dir, "conversations").where("turn < 12").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"), _nth(KINDS, F.col("turn") + F.col("conv_id")).alias("kind"), _nth([*pl.ROUTES, "Web "], F.col("turn")).alias("route"))
    named = F.when(F.col("turn") % 4 == 1, F.to_json(F.struct(F.lit(" ").alias("text"), F.col("text").alias("question"), "kind", "route")))
    bare = F.when(F.col("turn") % 3 == 2, F.get_json_object(F.to_json(F.struct(F.array("text").alias("x"))), "$.x"))
    item = F.coalesce(F.when(F.col("turn") % 7 == 6, F.lit('{"text":" "}')), F.substring(bare, F.lit(2), F.length(bare) - 2), named, F.to_json(F.struct("text", "kind", "route")))
    one = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", item.alias("x")))), lambda v: v["x"]), ",")
    replies = c.groupBy(F.col("conv_id").alias("run")).agg(F.concat(F.lit('{"sub_questions":['), one, F.lit("]}")).alias("reply"))
    found = pl.extracted_questions(replies)
    plan = pl.parsed(found).join(found.select("run", "at", "route"), ["run", "at"])
    return plan.select(F.col("run").alias("conv_id"), "n", F.md5("norm").alias("norm_md5"), "kind", "route")


STAGE1 = {"intercept": -0.5, "f1": 0.8, "sources": 0.3}
STAGE2 = {"intercept": -1.0, "mean_p": 2.0, "min_p": 1.5, "grounding": 0.5, "fraction": 1.0}


def _first_stage() -> Column:
    return pl.logistic(STAGE1, f1=F.coalesce("f1", F.lit(0.0)), sources=F.col("sources"))


def calibrated_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of runs in two stages: a probability for each question that was tried; then one for the run, from its core questions' ones."""
    p = plan_rows(spark, sf_dir).where("rounds > 0 and kind = 'core'").select("run", "status", F.round(_first_stage(), 4).alias("p"))
    runs = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), F.when(F.col("o_custkey") % 4 > 0, (F.col("o_custkey") % 3) / 2).alias("grounding"))
    return pl.run_probability(p, runs, STAGE2)


def plan_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan with the probability of each question that was scored; runs without a fitted scorer (odd ones) keep their values. With the run's
    mean, least value and share, its revisions and its budget."""
    v = plan_rows(spark, sf_dir).withColumn("value", F.round(F.when(F.col("f1").isNotNull(), (F.col("f1") + 2) / 12), 3))
    scored = plan_rows(spark, sf_dir).where("rounds > 0 and run % 2 = 0").select("run", "pos", F.round(_first_stage(), 3).alias("p"))
    both = v.join(scored, ["run", "pos"], "left").withColumn("sufficiency", F.coalesce("p", "value"))
    g = both.groupBy("run").agg(F.round(F.avg("sufficiency"), 6).alias("r1"), F.min("sufficiency").alias("r2"), F.round(F.avg((F.col("status") == "sufficient").cast("double")), 6).alias("r3"), F.count("p").alias("scored"))
    return g.join(_flags(spark, sf_dir).select("run", F.col("done").cast("double").alias("r4"), F.round(F.col("used") / d.RETRIEVALS, 6).alias("r5")), "run")


def run_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the controller sees of a run: each question's status, who is pending, and how many there are."""
    p = plan_rows(spark, sf_dir)
    in_order = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda x: x["v"]), ",")
    return p.groupBy("run").agg(in_order(F.struct("pos", F.concat(_sq(F.col("pos")), F.lit("="), "status").alias("v"))).alias("statuses"), in_order(F.when(pl.pending(), F.struct("pos", _sq(F.col("pos")).alias("v")))).alias("pending"), F.count(F.lit(1)).alias("questions"))


def merged_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ordered lists of a run's passages (of its odd and its even questions) as one, each once; and those of the first that the second has."""
    e = decisions.evidence(spark, sf_dir)
    of = lambda ok: F.array_distinct(F.transform(F.sort_array(F.collect_list(F.when(ok, F.struct("pos", "rank", "passage")))), lambda x: x["passage"].cast("string")))
    g = e.groupBy("run").agg(of(F.col("pos") % 2 == 1).alias("a"), of(F.col("pos") % 2 == 0).alias("b"))
    return g.select("run", F.array_join(F.array_union("a", "b"), ",").alias("merged"), F.array_join(F.array_intersect("a", "b"), ",").alias("kept"))


_D, _FIND, _EV, _POOL = decisions.ORACLE_SQL, decisions._FIND, decisions._EV, decisions._POOL
_FLAGS = f"{_POOL}, fl AS (SELECT o_orderkey AS run, o_orderstatus = 'F' AS decided, CAST(greatest(o_custkey % 3, o_orderkey % 4) AS INT) AS done, CAST(least(2, o_custkey % 2 + 1) AS INT) AS ceiling, used, pool FROM orders JOIN pools ON run = o_orderkey)"
_ROUTED = f"""{PLAN_SQL}, {_FIND}, {_FLAGS}, r0 AS (SELECT finds.run, finds.pos, claim, status, verdict, part, rounds, NOT decided AND pool > 0 AS open, done < ceiling AS remain, part % 6 > 0 AS owned,
  CASE WHEN verdict = 'SUPPORTED' THEN 'ACCEPT' ELSE (['RE_RETRIEVE', 'REVISE_PLAN', 'HEDGE', 'DROP_CLAIM', 'UNRESOLVED'])[CAST((part + claim) % 5 + 1 AS INT)] END AS asked FROM finds JOIN plan ON finds.run = plan.run AND finds.pos = plan.pos JOIN fl ON fl.run = finds.run),
r1 AS (SELECT *, CASE WHEN (asked = 'RE_RETRIEVE' AND NOT open) OR (asked = 'REVISE_PLAN' AND NOT (open AND remain)) THEN 'unavailable' WHEN asked IN ('RE_RETRIEVE', 'REVISE_PLAN') AND NOT owned THEN 'no owner' WHEN asked = 'RE_RETRIEVE' AND (part % 5 = 0 OR part % 4 < least(3, rounds)) THEN 'no new query' END AS gate FROM r0),
rt AS (SELECT *, CASE WHEN gate IS NOT NULL THEN 'UNRESOLVED' ELSE asked END AS action FROM r1)"""
_S1 = "round(1 / (1 + exp(-(-0.5 + 0.8 * coalesce(f1, 0.0) + 0.3 * sources))), 4)"
_KN = "['arxiv_meta', 'arxiv_fulltext', 'web', 'evidence_store']"

QUERIES = {
    f.__name__: f
    for f in (
        plan_rewrite, covered_by, revisions_remain, router_gates, router_apply, partial_rewrite, prompt_budget, next_query, round_outcomes, parsed_plan, plan_from_reply, calibrated_scores, plan_probabilities, run_snapshot, merged_ids,
    )
}

ORACLE_SQL = {
    "plan_rewrite": f"""WITH {PLAN_SQL}, tg AS (SELECT run, min(pos) AS target FROM plan WHERE status = 'insufficient' AND rounds >= 1 GROUP BY run), a AS (SELECT plan.*, coalesce(pos = target, false) AS hit, count(*) OVER (PARTITION BY plan.run) AS n, run % 4 AS act, least(3, part % 5) AS parts, part % 5 + 1 AS into_ FROM plan LEFT JOIN tg USING (run)),
b AS (SELECT *, CASE WHEN NOT hit THEN 'keep' WHEN act = 0 AND part % 2 = 0 THEN 'fresh' WHEN act = 1 AND parts >= 2 THEN 'split' WHEN act = 2 AND into_ <= n THEN 'merge' ELSE 'lost' END AS what FROM a),
c AS (SELECT *, unnest(CASE WHEN what = 'split' THEN generate_series(1, CAST(parts AS INT)) ELSE [0] END) AS i FROM b)
SELECT run, 'sq' || pos || CASE WHEN i > 0 THEN '.' || i ELSE '' END AS id, CASE what WHEN 'keep' THEN status WHEN 'fresh' THEN 'pending' WHEN 'split' THEN 'pending' ELSE 'abandoned' END AS status, CASE WHEN what IN ('fresh', 'split') THEN 0 ELSE rounds END AS rounds, CASE WHEN what = 'merge' THEN 'sq' || into_ END AS covered_by, what = 'lost' AS gap FROM c""",
    "covered_by": f"WITH {PLAN_SQL} SELECT a.run, a.pos, 'sq' || b.pos AS into FROM plan a JOIN plan b ON a.run = b.run AND b.pos = a.part % 7 + 1 WHERE a.status = 'abandoned' AND b.status <> 'abandoned'".replace("AS into", 'AS "into"'),
    "revisions_remain": f"WITH {PLAN_SQL}, {_FLAGS} SELECT run, done, ceiling, done < ceiling AS remain, done < ceiling AND used < 20 AND run IN (SELECT run FROM plan WHERE status = 'insufficient' AND rounds >= 1) AS should_revise FROM fl",
    "router_gates": f"WITH {_ROUTED} SELECT run, pos, claim, asked, gate, action, 4 + CAST(open AS INT) + CAST(open AND remain AS INT) AS available, CASE WHEN verdict = 'SUPPORTED' THEN 'ACCEPT' WHEN owned THEN 'RE_RETRIEVE' ELSE 'UNRESOLVED' END AS binary FROM rt".replace("AS binary", 'AS "binary"'),
    "router_apply": f"""WITH {_ROUTED}, l AS (SELECT run, pos, max_by(action, claim) AS last, max(claim) FILTER (action = 'RE_RETRIEVE') AS reopened, min(claim) FILTER (action = 'REVISE_PLAN') AS revised FROM rt WHERE owned AND action IN ('RE_RETRIEVE', 'REVISE_PLAN') GROUP BY ALL)
SELECT plan.run, plan.pos, CASE last WHEN 'RE_RETRIEVE' THEN 'in_progress' WHEN 'REVISE_PLAN' THEN 'insufficient' ELSE status END AS status, CASE WHEN reopened IS NOT NULL THEN CASE WHEN coalesce(revised < reopened, false) THEN 'insufficient' WHEN status IN ('abandoned', 'insufficient', 'sufficient') THEN status END END AS reopened_from, bool_or(last IS NOT NULL) OVER (PARTITION BY plan.run) AS draft_cleared FROM plan LEFT JOIN l ON plan.run = l.run AND plan.pos = l.pos""",
    "partial_rewrite": f"""WITH d AS ({_D['decide_terminal']}), r AS (SELECT run, terminal, o_custkey % 7 <> 0 AS draft, o_custkey % 2 = 0 AS pm, o_custkey % 13 = 0 AS err, o_custkey % 9 <> 0 AS en, 25 - o_custkey % 26 AS rest FROM d JOIN orders ON run = o_orderkey),
x AS (SELECT *, CASE WHEN terminal <> 'PARTIAL' THEN 'not_needed' WHEN NOT draft THEN CASE WHEN err THEN 'not_needed' ELSE 'requested' END WHEN pm THEN 'not_needed' WHEN NOT en THEN 'disabled' WHEN rest < 3 THEN 'unaffordable' ELSE 'requested' END AS outcome FROM r)
SELECT run, outcome, draft AND (terminal = 'ABSTAIN' OR (terminal = 'PARTIAL' AND outcome = 'requested')) AS withheld, CASE terminal WHEN 'ABSTAIN' THEN 'none' WHEN 'PARTIAL' THEN 'partial' ELSE 'answer' END AS mode, 'ANSWER' AS static_terminal, terminal <> 'ANSWER' AS static_differs FROM x""",
    "prompt_budget": f"WITH {CALLS_SQL}, m AS (SELECT user_id % 10 AS role, model, max(tokens) AS longest FROM calls GROUP BY ALL) SELECT role, min(8000 - longest) AS budget, count(*) AS models FROM m GROUP BY role",
    "next_query": f"""WITH {PLAN_SQL}, a AS (SELECT *, CASE WHEN part % 5 < 4 THEN ({_KN})[CAST(part % 5 + 1 AS INT)] ELSE 'arxiv_meta' END AS sug, ({_KN})[CAST((supp + rounds) % 4 + 1 AS INT)] AS last, CASE WHEN supp % 5 < 4 THEN ({_KN})[CAST(supp % 5 + 1 AS INT)] ELSE 'arxiv_meta' END AS nxt FROM plan)
SELECT run, pos, CASE WHEN rounds = 0 THEN CASE sug WHEN 'arxiv_fulltext' THEN 'arxiv_meta' ELSE sug END WHEN part % 3 = 0 THEN nxt WHEN part % 3 = 1 THEN CASE last WHEN 'evidence_store' THEN 'arxiv_meta' ELSE 'arxiv_fulltext' END ELSE CASE last WHEN 'web' THEN 'arxiv_meta' ELSE 'web' END END AS route,
  CASE WHEN part % 4 > least(2, rounds) THEN 'q' || part % 4 ELSE 'sq' || pos END AS query, sug AS static_route FROM a""",
    "round_outcomes": f"""WITH {PLAN_SQL}, r AS (SELECT run, rounds AS round, max(f1) AS f1, CAST(count(DISTINCT supp) AS INT) AS sources, count(f1) AS rows FROM plan GROUP BY ALL), b AS (SELECT *, max(f1) OVER (PARTITION BY run ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM r)
SELECT run, round, f1, sources, rows, greatest(best, f1) AS best_f1, CASE WHEN f1 IS NULL THEN CASE WHEN round + 1 >= 3 THEN 'abandoned' ELSE 'in_progress' END WHEN f1 >= 4 AND sources >= 2 THEN 'sufficient'
  WHEN coalesce(round(f1 - best, 6) < 0.5, false) OR round + 1 >= 3 THEN CASE WHEN f1 >= 4 THEN 'sufficient' WHEN f1 <= 0 THEN 'abandoned' ELSE 'insufficient' END ELSE 'in_progress' END AS state, CASE WHEN rows > 0 THEN 'sufficient' ELSE 'insufficient' END AS static_state FROM b""",
    "parsed_plan": rf"""WITH c AS (SELECT conv_id, turn, text, regexp_replace(lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))), '[?.]+$', '') AS norm, ({KINDS})[CAST((turn + conv_id) % 5 + 1 AS INT)] AS raw FROM conversations WHERE role = 'user'),
g AS (SELECT conv_id, norm, min(turn) AS turn, min_by(raw, turn) AS raw FROM c WHERE length(trim(text)) >= 15 AND conv_id % 9 > 0 GROUP BY ALL), n AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, norm) AS INT) AS n FROM g QUALIFY n <= 7),
k AS (SELECT *, CASE WHEN lower(trim(raw)) = 'background' THEN 'background' ELSE 'core' END AS kind FROM n), o AS (SELECT conv_id, n, turn, CASE WHEN bool_or(kind = 'core') OVER (PARTITION BY conv_id) THEN kind ELSE 'core' END AS kind FROM k)
SELECT * FROM o UNION ALL SELECT conv_id, 1, min(turn), 'core' FROM c WHERE conv_id NOT IN (SELECT conv_id FROM o) GROUP BY conv_id""",
    "plan_from_reply": rf"""WITH c AS (SELECT conv_id, turn, text, regexp_replace(lower(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))), '[?.]+$', '') AS norm, CASE WHEN turn % 3 <> 2 THEN lower(trim(({KINDS})[CAST((turn + conv_id) % 5 + 1 AS INT)])) END AS kind,
  CASE WHEN turn % 3 = 2 THEN 'arxiv_meta' ELSE (['arxiv_meta', 'arxiv_fulltext', 'web', 'evidence_store', 'web'])[CAST(turn % 5 + 1 AS INT)] END AS route FROM conversations WHERE turn < 12 AND turn % 7 <> 6),
g AS (SELECT conv_id, norm, min(turn) AS turn, arg_min_null(kind, turn) AS kind, min_by(route, turn) AS route FROM c WHERE length(trim(regexp_replace(text, '\s+', ' ', 'g'))) >= 15 GROUP BY ALL), n AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, norm) AS INT) AS n FROM g QUALIFY n <= 7)
SELECT conv_id, n, md5(norm) AS norm_md5, CASE WHEN bool_or(coalesce(kind, '') <> 'background') OVER (PARTITION BY conv_id) AND coalesce(kind, '') = 'background' THEN 'background' ELSE 'core' END AS kind, route FROM n""",
    "calibrated_scores": f"""WITH {PLAN_SQL}, p AS (SELECT run, status, {_S1} AS p FROM plan WHERE rounds > 0 AND kind = 'core'), g AS (SELECT run, avg(p) AS mp, min(p) AS lp, avg(CASE WHEN status = 'sufficient' THEN 1.0 ELSE 0.0 END) AS fr, count(*) AS n FROM p GROUP BY run),
s AS (SELECT o_orderkey AS run, CASE WHEN o_custkey % 4 > 0 THEN (o_custkey % 3) / 2 END AS gr FROM orders)
SELECT s.run, coalesce(n, 0) AS scored, round(mp, 6) AS mean_p, lp AS min_p, gr AS grounding, round(fr, 6) AS fraction, round(1 / (1 + exp(-(-1.0 + 2.0 * mp + 1.5 * lp + 0.5 * coalesce(gr, 0.5) + 1.0 * fr))), 6) AS score FROM s LEFT JOIN g ON s.run = g.run""",
    "plan_probabilities": f"""WITH {PLAN_SQL}, {_FLAGS}, v AS (SELECT run, status, CASE WHEN rounds > 0 AND run % 2 = 0 THEN {_S1.replace(", 4)", ", 3)")} END AS p, round((f1 + 2) / 12, 3) AS value FROM plan),
g AS (SELECT run, round(avg(coalesce(p, value)), 6) AS r1, min(coalesce(p, value)) AS r2, round(avg(CASE WHEN status = 'sufficient' THEN 1.0 ELSE 0.0 END), 6) AS r3, count(p) AS scored FROM v GROUP BY run) SELECT g.*, CAST(done AS DOUBLE) AS r4, round(used / 20, 6) AS r5 FROM g JOIN fl USING (run)""",
    "run_snapshot": f"WITH {PLAN_SQL} SELECT run, string_agg('sq' || pos || '=' || status, ',' ORDER BY pos) AS statuses, coalesce(string_agg('sq' || pos, ',' ORDER BY pos) FILTER (status = 'pending'), '') AS pending, count(*) AS questions FROM plan GROUP BY run",
    "merged_ids": f"""WITH {PLAN_SQL}, {_EV}, f AS (SELECT run, passage, min(pos * 100 + rank) FILTER (pos % 2 = 1) AS a, min(pos * 100 + rank) FILTER (pos % 2 = 0) AS b FROM ev GROUP BY ALL)
SELECT run, string_agg(CAST(passage AS VARCHAR), ',' ORDER BY a NULLS LAST, b) AS merged, coalesce(string_agg(CAST(passage AS VARCHAR), ',' ORDER BY a) FILTER (a IS NOT NULL AND b IS NOT NULL), '') AS kept FROM f GROUP BY run""",
}
