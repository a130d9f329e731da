"""The rules of plans on hand-made rows."""

import json

import pytest
from pyspark.sql import functions as F

from groundwell.operators import planning as pl

LONG = "What is the height of the tower"


def one(spark, kind, values, column):
    return spark.createDataFrame([values], kind).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ([{"text": " a  b ", "kind": "core", "route": " Web"}, "bare\nstring", {"text": " ", "question": "q"}, {"sub_question": "s", "route": "nowhere"}, {"kind": "core"}, None], [("a b", "core", "web"), ("bare string", None, "arxiv_meta"), ("q", None, "arxiv_meta"), ("s", None, "arxiv_meta"), ("", "core", "arxiv_meta"), ("", None, "arxiv_meta")]),
        ([], []), (None, []), ([{"text": 'say "x", {y}'}], [('say "x", {y}', None, "arxiv_meta")]),
    ],
)
def test_extracted_questions(spark, given, want):
    df = spark.createDataFrame([(1, json.dumps({"sub_questions": given})), (2, "not JSON"), (3, None), (4, "{}")], "run int, reply string")
    rows = pl.extracted_questions(df).orderBy("at").collect()
    assert [(r.text, r.kind, r.route) for r in rows] == want and {r.run for r in rows} <= {1}


def test_parsed_plans(spark):
    items = [(1, 0, "short?", "core"), (1, 1, f"{LONG}?", "Background "), (1, 2, f" {LONG.upper()}...", "core"), (1, 3, f"{LONG} of steel", "other"), (2, 0, f"{LONG}", "background"), (2, 1, None, "core"), (3, 0, "tiny", None)]
    items += [(4, k, f"{LONG} number {k}", None) for k in range(9)]
    plan = pl.parsed(spark.createDataFrame(items, "run int, at int, text string, kind string"))
    got = sorted((r.run, r.n, r["at"], r.kind) for r in plan.collect())
    assert got == [(1, 1, 1, "background"), (1, 2, 3, "core"), (2, 1, 0, "core")] + [(4, k + 1, k, "core") for k in range(7)]
    asked = spark.createDataFrame([(1, 0), (3, 0), (5, 2), (5, 1)], "run int, at int")
    assert sorted((r.run, r.n, r["at"]) for r in pl.or_verbatim(plan, asked).where("run in (3, 5)").collect()) == [(3, 1, 0), (5, 1, 1)]


def test_covered(spark):
    rows = [(1, "sq1", "sufficient", None, None), (1, "sq2", "abandoned", "sq1", None), (1, "sq3", "abandoned", None, "covered by sq1: done"), (1, "sq4", "abandoned", "sq2", "covered by sq1: done"), (1, "sq5", "abandoned", None, "gave up"), (1, "sq6", "pending", "sq1", None), (2, "sq2", "abandoned", "sq1", None), (1, "sq6.1", "pending", None, None), (1, "sq7", "abandoned", "", "dropped, covered by sq6.1: the same"), (1, "sq8", "abandoned", None, "covered by sq6, it says")]
    got = {(r.run, r.id): r.into for r in pl.covered(spark.createDataFrame(rows, "run int, id string, status string, covered_by string, rationale string")).collect()}
    assert got == {(1, "sq2"): "sq1", (1, "sq3"): "sq1", (1, "sq7"): "sq6.1"}


def test_progress_and_the_first_failed(spark):
    rows = [(1, 1, "sufficient", 1), (1, 2, "insufficient", 0), (1, 3, "insufficient", 2), (1, 4, None, 0), (2, 1, "abandoned", 1), (2, 2, "in_progress", 1), (3, 1, "sufficient", 3)]
    df = spark.createDataFrame(rows, "run int, pos int, status string, rounds int")
    assert {r.run: tuple(r)[1:] for r in pl.progress(df).collect()} == {1: (1, False, 1, 2, 0), 2: (1, False, 0, 0, 1), 3: (0, True, 1, 0, 0)}
    assert [tuple(r) for r in pl.first_failed(df).collect()] == [(1, 3)]


@pytest.mark.parametrize(("done", "ceiling", "used", "target", "want"), [(0, 2, 5, True, (True, True)), (2, 2, 5, True, (False, False)), (1, 2, 20, True, (True, False)), (1, 2, 19, True, (True, True)), (0, 1, 0, None, (True, False))])
def test_revisions(spark, done, ceiling, used, target, want):
    remain, should = pl.should_revise(*[F.col(c) for c in "dcut"])
    assert tuple(spark.createDataFrame([(done, ceiling, used, target)], "d int, c int, u int, t boolean").select(remain, should).first()) == want


@pytest.mark.parametrize(
    ("rounds", "suggested", "decided", "last", "want"),
    [
        (0, "arxiv_fulltext", "web", None, "arxiv_meta"), (0, "elsewhere", None, None, "arxiv_meta"), (0, "web", None, None, "web"), (0, None, None, None, "arxiv_meta"), (1, "web", "evidence_store", "web", "evidence_store"),
        (1, "web", None, "web", "arxiv_meta"), (2, None, None, "arxiv_meta", "web"), (2, None, None, "gone", "web"), (2, None, None, None, "web"),
    ],
)
def test_next_route(spark, rounds, suggested, decided, last, want):
    assert one(spark, "r int, s string, d string, l string", (rounds, suggested, decided, last), pl.next_route(*[F.col(c) for c in "rsdl"])) == want


@pytest.mark.parametrize(("query", "tried", "want"), [(" new ", ["old"], "new"), (" old", ["old"], "own"), ("  ", [], "own"), (None, [], "own"), ("x", None, "x"), ("x", [None], "x")])
def test_next_query(spark, query, tried, want):
    assert one(spark, "q string, t array<string>", (query, tried), pl.next_query(F.col("q"), F.col("t"), F.lit("own"))) == want


def test_deeper(spark):
    assert [one(spark, "r string", (r,), pl.deeper(F.col("r"))) for r in pl.ROUTES] == ["arxiv_fulltext", "arxiv_fulltext", "arxiv_fulltext", "arxiv_meta"]


def test_round_outcomes(spark):
    rows = [(1, 0, 1.0, 1, 3), (1, 1, 1.2, 1, 1), (2, 0, 4.5, 2, 1), (3, 0, None, 0, 0), (3, 2, None, 0, 0), (4, 0, 3.0, 1, 2), (4, 1, 3.6, 1, 2)]
    got = {(r.run, r.round): (r.best_f1, r.state, r.static_state) for r in pl.round_outcomes(spark.createDataFrame(rows, "run int, round int, f1 double, sources int, rows int")).collect()}
    assert got == {
        (1, 0): (1.0, "in_progress", "sufficient"), (1, 1): (1.2, "insufficient", "sufficient"), (2, 0): (4.5, "sufficient", "sufficient"), (3, 0): (None, "in_progress", "insufficient"), (3, 2): (None, "abandoned", "insufficient"),
        (4, 0): (3.0, "in_progress", "sufficient"), (4, 1): (3.6, "in_progress", "sufficient"),
    }


@pytest.mark.parametrize(
    ("terminal", "draft", "error", "mode", "enabled", "left", "want"),
    [
        ("ANSWER", True, False, False, True, 9, ("not_needed", False, "answer")), ("ABSTAIN", True, False, False, True, 9, ("not_needed", True, "none")), ("ABSTAIN", False, False, False, True, 9, ("not_needed", False, "none")), ("PARTIAL", False, True, False, True, 9, ("not_needed", False, "partial")),
        ("PARTIAL", False, False, False, False, 0, ("requested", False, "partial")), ("PARTIAL", True, False, True, True, 9, ("not_needed", False, "partial")), ("PARTIAL", True, False, False, False, 9, ("disabled", False, "partial")), ("PARTIAL", True, False, False, True, 2, ("unaffordable", False, "partial")), ("PARTIAL", True, False, False, True, 3, ("requested", True, "partial")),
    ],
)
def test_drafts_in_part(spark, terminal, draft, error, mode, enabled, left, want):
    df = spark.createDataFrame([(terminal, draft, error, mode, enabled, left)], "t string, d boolean, e boolean, m boolean, a boolean, l int")
    outcome = pl.partial_outcome(*[F.col(c) for c in "tdemal"])
    assert tuple(df.select(outcome, pl.withheld(F.col("t"), F.col("d"), outcome), pl.draft_mode(F.col("t"))).first()) == want


def test_run_probability(spark):
    weights = {"intercept": 0.0, "mean_p": 1.0, "min_p": 0.0, "grounding": 2.0, "fraction": -1.0}
    questions = spark.createDataFrame([(1, "sufficient", 0.8), (1, None, 0.4), (2, "sufficient", 0.5)], "run int, status string, p double")
    got = {r.run: r for r in pl.run_probability(questions, spark.createDataFrame([(1, None), (2, 1.0), (3, 1.0)], "run int, grounding double"), weights).collect()}
    assert (got[1].mean_p, got[1].min_p, got[1].fraction, got[1].scored, got[1].score) == (0.6, 0.4, 0.5, 2, round(1 / (1 + 2.718281828459045 ** -(0.6 + 1.0 - 0.5)), 6))
    assert got[2].score == round(1 / (1 + 2.718281828459045 ** -(0.5 + 2.0 - 1.0)), 6) and (got[3].score, got[3].scored) == (None, 0)


def test_prompt_budget(spark):
    rows = [("critic", "a", 8000, 3000), ("critic", "b", 6000, 500), ("writer", "a", 8000, 9000)]
    assert {tuple(r) for r in pl.prompt_budget(spark.createDataFrame(rows, "role string, model string, limit int, longest int")).collect()} == {("critic", 5000, 2), ("writer", -1000, 1)}
