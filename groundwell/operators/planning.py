"""Plans under way, on any table: reading a plan, who is covered or pending, revisions, routes and queries of rounds, partial drafts, and scores in two stages.

A run's rows have its key in `run`. A question has an id, a place `pos` or a number `n` in the plan, a status and rounds (how often it was tried).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwell.functions import text as t
from groundwell.operators.decisions import RETRIEVALS, judge_round

LEAST_CHARS, MOST_QUESTIONS = 15, 7
TERMINAL = ("sufficient", "insufficient", "abandoned")
#: Calls that a draft in part needs.
REWRITE_CALLS = 3
# The routes, and where a search goes on from each.
ROUTES = ("arxiv_meta", "arxiv_fulltext", "web", "evidence_store")
DEFAULT_ROUTE = "arxiv_meta"
WIDER = {"arxiv_meta": "web", "arxiv_fulltext": "web", "web": "arxiv_meta", "evidence_store": "web"}
DEEPER = {"arxiv_meta": "arxiv_fulltext", "web": "arxiv_fulltext", "evidence_store": "arxiv_meta", "arxiv_fulltext": "arxiv_fulltext"}
CHEAP = {"arxiv_fulltext": "arxiv_meta"}
# Fixed value: how the reason of an older plan names the question that covers another.
COVERED_BY = r"covered by (\S+?):"


def norm_question(text: Column) -> Column:
    """The form in which two questions are the same: lower case, without extra blanks and marks at the end."""
    return F.regexp_replace(F.lower(t.clean(text)), r"[?.]+$", "")


def extracted_questions(replies: DataFrame) -> DataFrame:
    """replies (run, reply: JSON with a list `sub_questions`) to run, at (from 0), text, kind and route. An item is a string, or an object with a text, which may be
    called question or sub_question; without any its text is empty. A reply that isn't JSON, or has no list, has no rows."""
    items = F.from_json(F.get_json_object("reply", "$.sub_questions"), "array<string>")
    x = replies.select("run", F.posexplode(items).alias("at", "x"))
    whole = F.coalesce(F.col("x").startswith("{"), F.lit(False))
    field = lambda name: F.when(whole, F.get_json_object("x", f"$.{name}"))
    texts = [F.nullif(t.clean(field(name)), F.lit("")) for name in ("text", "question", "sub_question")]
    return x.select("run", "at", F.coalesce(*texts, t.clean(F.when(~whole, F.col("x"))), F.lit("")).alias("text"), field("kind").alias("kind"), known_route(F.lower(F.trim(field("route")))).alias("route"))


def parsed(items: DataFrame, most: int = MOST_QUESTIONS) -> DataFrame:
    """items (run, at, text, kind) to run, n (from 1), at, norm and kind: texts under 15 characters go, of the same ones the first stays, `most` of a run.

    A question is background only where that is said, and only in a plan that has a core question; all of a plan without one are core."""
    usable = items.where(F.length(F.trim("text")) >= LEAST_CHARS).groupBy("run", norm_question(F.col("text")).alias("norm")).agg(F.min(F.struct("at", "kind")).alias("x"))
    n = F.row_number().over(Window.partitionBy("run").orderBy("x.at", "norm"))
    ok = usable.withColumn("n", n).where(F.col("n") <= most)
    ok = ok.withColumn("kind", F.when(F.lower(F.trim("x.kind")) == "background", "background").otherwise("core"))
    core = F.max((F.col("kind") == "core").cast("int")).over(Window.partitionBy("run")) == 1
    return ok.select("run", "n", F.col("x.at").alias("at"), "norm", F.when(core, F.col("kind")).otherwise("core").alias("kind"))


def or_verbatim(plan: DataFrame, questions: DataFrame) -> DataFrame:
    """plan (run, n, at, kind) and, for each of questions (run, at) whose run has no usable row in it, the question as asked: number 1, core."""
    bare = questions.groupBy("run").agg(F.min("at").alias("at")).join(plan.select("run"), "run", "left_anti")
    return plan.select("run", "n", "at", "kind").unionByName(bare.select("run", F.lit(1).alias("n"), "at", F.lit("core").alias("kind")))


def covered(plan: DataFrame) -> DataFrame:
    """plan (run, id, status, covered_by, rationale): run, id and into of abandoned questions that a live one of their run covers: the field says so, or in older
    plans the reason. A field that names no live question isn't made good by the reason."""
    said = F.coalesce(F.nullif("covered_by", F.lit("")), F.nullif(F.regexp_extract(F.coalesce("rationale", F.lit("")), COVERED_BY, 1), F.lit("")))
    live = plan.where(~F.col("status").eqNullSafe("abandoned")).select("run", F.col("id").alias("into")).distinct()
    return plan.where("status = 'abandoned'").select("run", "id", said.alias("into")).join(live, ["run", "into"], "left_semi").select("run", "id", "into")


def pending() -> Column:
    """Whether a question is still to be tried; one without a status is."""
    return ~F.coalesce(F.col("status").isin(*TERMINAL), F.lit(False))


def progress(plan: DataFrame) -> DataFrame:
    """plan (run, status) by run: how many are pending, whether none is, and how many ended in which way."""
    open_ = F.sum(pending().cast("int"))
    return plan.groupBy("run").agg(open_.alias("pending"), (open_ == 0).alias("all_terminal"), *[F.sum(F.col("status").eqNullSafe(s).cast("int")).alias(f"n_{s}") for s in TERMINAL])


def first_failed(plan: DataFrame) -> DataFrame:
    """run and pos: the first question of a run that was tried and is insufficient, which a revision would change."""
    return plan.where("status = 'insufficient' and rounds >= 1").groupBy("run").agg(F.min("pos").alias("pos"))


def should_revise(done: Column, ceiling: Column, used: Column, target: Column) -> tuple[Column, Column]:
    """Whether a run may revise its plan (revisions done under the ceiling), and whether it should: it may, has budget, and has a question to change."""
    remain = done < ceiling
    return remain, remain & (used < RETRIEVALS) & F.coalesce(target, F.lit(False))


def _step(route: Column, to: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(route == a, b) for a, b in to.items()], F.lit("web"))


def known_route(route: Column) -> Column:
    """A route that a model names; what isn't one is the default."""
    return F.when(route.isin(*ROUTES), route).otherwise(DEFAULT_ROUTE)


def wider(route: Column) -> Column:
    return _step(route, WIDER)


def deeper(route: Column) -> Column:
    return _step(route, DEEPER)


def next_route(rounds: Column, suggested: Column, decided: Column, last: Column) -> Column:
    """The route of a question's next round: first the suggestion, made cheap; then what was decided, or else a wider one than the last."""
    s = known_route(suggested)
    first = F.coalesce(*[F.when(s == a, b) for a, b in CHEAP.items()], s)
    return F.when(rounds == 0, first).otherwise(F.coalesce(decided, wider(last)))


def next_query(query: Column, tried: Column, own: Column) -> Column:
    """A decided query, unless it is blank, missing or was tried: then the question's own text."""
    q = F.trim(query)
    return F.when((q != "") & ~F.coalesce(F.array_contains(tried, q), F.lit(False)), q).otherwise(own)


def round_outcomes(rounds: DataFrame) -> DataFrame:
    """rounds (run, round from 0, f1, sources, rows): adds best_f1 (highest so far), state (by the policy, against the best of earlier rounds) and static_state
    (sufficient with any row)."""
    best = F.max("f1").over(Window.partitionBy("run").orderBy("round").rowsBetween(Window.unboundedPreceding, -1))
    r = rounds.withColumn("_best", best)
    state = judge_round(F.col("round") + 1, F.col("f1"), F.col("sources"), F.col("_best"))
    return r.select(*rounds.columns, F.greatest("_best", "f1").alias("best_f1"), state.alias("state"), F.when(F.col("rows") > 0, "sufficient").otherwise("insufficient").alias("static_state"))


def partial_outcome(terminal: Column, draft: Column, error: Column, partial_mode: Column, enabled: Column, left: Column) -> Column:
    """Whether a draft is written anew in part: not_needed, requested, disabled or unaffordable. An answer in part without a draft asks for one, unless the run
    failed; a draft that is one in part already stays."""
    return (
        F.when(~terminal.eqNullSafe("PARTIAL"), "not_needed")
        .when(~draft, F.when(error, "not_needed").otherwise("requested"))
        .when(partial_mode, "not_needed")
        .when(~enabled, "disabled")
        .when(left < REWRITE_CALLS, "unaffordable")
        .otherwise("requested")
    )


def withheld(terminal: Column, draft: Column, outcome: Column) -> Column:
    """Whether a draft isn't shown: abstaining, or a draft in part is due."""
    return draft & ((terminal == "ABSTAIN") | ((terminal == "PARTIAL") & (outcome == "requested")))


def draft_mode(terminal: Column) -> Column:
    return F.when(terminal == "ABSTAIN", "none").when(terminal == "PARTIAL", "partial").otherwise("answer")


def logistic(weights: dict[str, float], **values: Column) -> Column:
    """The probability from an intercept and a weight for each value."""
    z = reduce(lambda a, kv: a + weights[kv[0]] * kv[1], values.items(), F.lit(weights["intercept"]))
    return 1 / (1 + F.exp(-z))


def run_probability(questions: DataFrame, runs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """questions (run, status, p: those that count, with their probability) and runs (run, grounding of the premises, null if not checked) to run, scored, mean_p,
    min_p, grounding, fraction (that is sufficient) and score; null without a question that counts. Unchecked premises are taken for a half."""
    share = F.avg(F.col("status").eqNullSafe("sufficient").cast("double"))
    g = questions.groupBy("run").agg(F.avg("p").alias("mean_p"), F.min("p").alias("min_p"), share.alias("fraction"), F.count(F.lit(1)).alias("scored"))
    s = runs.select("run", "grounding").join(g, "run", "left")
    p = logistic(weights, mean_p=F.col("mean_p"), min_p=F.col("min_p"), grounding=F.coalesce("grounding", F.lit(0.5)), fraction=F.col("fraction"))
    return s.select("run", F.coalesce("scored", F.lit(0)).alias("scored"), F.round("mean_p", 6).alias("mean_p"), "min_p", "grounding", F.round("fraction", 6).alias("fraction"), F.round(p, 6).alias("score"))


def prompt_budget(models: DataFrame) -> DataFrame:
    """models (role, model, limit of tokens a minute, longest output): the tokens that a role's prompt may have, the least of its models, and how many they are."""
    return models.groupBy("role").agg(F.min(F.col("limit") - F.col("longest")).alias("budget"), F.count(F.lit(1)).alias("models"))
