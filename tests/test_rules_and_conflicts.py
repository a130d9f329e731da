"""Rules on hand-made rows, and conflicts that were planted."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundwell.operators import conflicts as con
from groundwell.operators import ranker, rules
from groundwell.queries import QUERIES


@pytest.mark.parametrize(
    ("status", "message", "kind", "want"),
    [
        (400, "json_validate_failed: x", "BadRequestError", "retry_plain"), (400, "Context_Length exceeded", None, "retry_plain"), (400, "bad", "BadRequestError", "fatal"), (429, "tokens per day", "RateLimitError", "switch"), (429, "limit (TPM)", "RateLimitError", "wait"),
        (429, "slow down", "RateLimitError", "switch_keep"), (401, "x", None, "fatal"), (403, None, None, "fatal"), (503, "x", None, "retry"), (504, "x", None, "retry"), (None, "x", "APITimeoutError", "retry"), (408, "x", "ReadTimeout", "retry"), (408, "a timeout, in words", "APIError", "fatal"),
        (404, "connection", "NotFoundError", "fatal"), (None, None, None, "retry"), (429, "per day and per minute", None, "switch"),
    ],
)
def test_error_actions(spark, status, message, kind, want):
    df = spark.createDataFrame([(status, message, kind)], "s int, m string, k string")
    assert df.select(rules.error_action(F.col("s"), F.col("m"), F.col("k")).alias("x")).first().x == want


@pytest.mark.parametrize(("message", "header", "want"), [("try again in 7.5s", None, 7.5), ("Try again in 1m2.5s", None, 62.5), ("in 2m try again in 2m", None, 120.0), ("x", None, 60.0), ("try again in 9s", "3", 3.0), ("try again in 9s", "soon", 9.0), (None, "-4", 0.0)])
def test_error_waits(spark, message, header, want):
    df = spark.createDataFrame([(message, header)], "m string, h string")
    assert df.select(rules.error_wait(F.col("m"), F.col("h")).alias("x")).first().x == want


def test_first_provider(spark):
    rows = [("a", 1, "x"), ("a", 0, "y"), ("a", 0, "z"), ("b", 2, "w"), (None, 0, "n")]
    got = rules.first_provider(spark.createDataFrame(rows, "search string, place int, url string"), "search", "place").collect()
    assert {(r.search, r.url) for r in got} == {("a", "y"), ("a", "z"), ("b", "w")}


def test_judged_sentences(spark):
    s = spark.createDataFrame([(1, 0, [7, 8]), (1, 1, []), (1, 2, [9]), (1, 3, []), (1, 4, [8]), (1, 5, [5])], "run int, idx int, citations array<int>")
    raw = spark.createDataFrame([(1, 0, 1, "PARTIAL"), (1, 0, 2, "SUPPORTED"), (1, 1, 1, "SUPPORTED"), (1, 2, 1, "GAP_STATEMENT"), (1, 3, 1, "GAP_STATEMENT"), (1, 4, 1, "NOT_A_CLAIM")], "run int, idx int, turn int, name string")
    given = rules.last_verdicts(raw.unionByName(spark.createDataFrame([(1, 5, 1, "what?")], raw.schema)))
    owners = spark.createDataFrame([(1, 8, "sq2"), (1, 9, "sq1")], "run int, passage int, owner string")
    got = {r.idx: (r.kind, r.verdict, r.owner) for r in rules.judged_sentences(s, given, owners).collect()}
    assert got == {0: ("claim", "SUPPORTED", "sq2"), 1: ("claim", "UNSUPPORTED", ""), 2: ("claim", "UNSUPPORTED", "sq1"), 3: ("gap", None, None), 4: ("discourse", None, None), 5: ("claim", "UNSUPPORTED", "")}


@pytest.mark.parametrize(
    ("action", "differs", "parts", "into", "want"),
    [
        ("REWRITE", True, 0, None, [("q", "pending", 0, None, False)]), ("REWRITE", False, 0, None, [("q", "abandoned", 2, None, True)]), ("SPLIT", True, 1, None, [("q", "abandoned", 2, None, True)]),
        ("SPLIT", True, 2, None, [("q.1", "pending", 0, None, False), ("q.2", "pending", 0, None, False)]), ("SPLIT", True, 9, None, [(f"q.{k}", "pending", 0, None, False) for k in (1, 2, 3)]),
        ("MERGE", True, 0, "p", [("q", "abandoned", 2, "p", False)]), ("MERGE", True, 0, None, [("q", "abandoned", 2, None, True)]), ("ABANDON", True, 0, None, [("q", "abandoned", 2, None, True)]), ("NOTHING", True, 3, "p", [("q", "abandoned", 2, None, True)]),
    ],
)
def test_rewritten_plan(spark, action, differs, parts, into, want):
    kind = "run int, id string, status string, rounds int, hit boolean, action string, differs boolean, parts int, into string"
    df = spark.createDataFrame([(1, "q", "insufficient", 2, True, action, differs, parts, into), (1, "p", "sufficient", 1, False, action, differs, parts, into)], kind)
    got = sorted((r.id, r.status, r.rounds, r.covered_by, r.gap) for r in rules.rewritten_plan(df).collect())
    assert got == sorted([*want, ("p", "sufficient", 1, None, False)])


@pytest.mark.parametrize(
    ("asked", "retrieval", "revision", "owned", "query", "tried", "want"),
    [
        ("ACCEPT", False, False, False, "", [], None), ("RE_RETRIEVE", False, True, True, "x", [], "unavailable"), ("REVISE_PLAN", True, False, True, "x", [], "unavailable"), ("REVISE_PLAN", True, True, False, "x", [], "no owner"), ("RE_RETRIEVE", True, True, True, " X ", ["x "], "no new query"),
        ("RE_RETRIEVE", True, True, True, "  ", [], "no new query"), ("RE_RETRIEVE", True, False, True, "y", ["x"], None), ("REVISE_PLAN", True, True, True, "", [], None), ("SHOUT", True, True, True, "y", [], "unavailable"),
    ],
)
def test_claim_gates(spark, asked, retrieval, revision, owned, query, tried, want):
    df = spark.createDataFrame([(asked, retrieval, revision, owned, query, tried)], "a string, r boolean, v boolean, o boolean, q string, t array<string>")
    gate = rules.claim_gate(F.col("a"), rules.available_actions(F.col("r"), F.col("v")), F.col("o"), F.col("q"), F.col("t"))
    assert df.select(gate.alias("x")).first().x == want


def test_routed_plan(spark):
    plan = spark.createDataFrame([(1, 1, "sufficient"), (1, 2, "pending"), (2, 1, "insufficient")], "run int, pos int, status string")
    routed = spark.createDataFrame([(1, 1, 1, "REVISE_PLAN"), (1, 1, 2, "RE_RETRIEVE"), (1, 2, 1, "HEDGE")], "run int, pos int, claim int, action string")
    got = {(r.run, r.pos): (r.status, r.reopened_from, r.draft_cleared) for r in rules.routed_plan(plan, routed).collect()}
    assert got == {(1, 1): ("in_progress", "insufficient", True), (1, 2): ("pending", None, True), (2, 1): ("insufficient", None, False)}


def test_labels_by_first_appearance(spark):
    found = spark.createDataFrame([(1, 0, 1, 50), (1, 0, 2, 40), (1, 1, 1, 40), (1, 1, 2, 30), (2, 3, 1, 50)], "run int, claim int, rank int, id int")
    assert {(r.run, r.id, r.label) for r in rules.labelled(found).collect()} == {(1, 50, "P01"), (1, 40, "P02"), (1, 30, "P03"), (2, 50, "P01")}


# conflicts

FRAMES = [
    ("The {w} model reached an accuracy of {n} percent on the benchmark", "On the benchmark the {w} model reached accuracy of {n}%"),
    ("Training the {w} network took {n} hours on one machine", "It took {n} hours to train the {w} network on one machine, training alone"),
    ("The {w} survey covered {n} km of coastline in the region", "In the region the {w} survey covered a coastline of {n} kilometres"),
    ("The {w} treaty was signed on 2011-03-{d:02} in the old capital", "In the old capital the {w} treaty was signed on 2011-03-{d:02}"),
    ("The {w} method improves recall on long documents", "On long documents the {w} method improves recall"),
]


def planted(n, seed=6):
    """Pairs of passages of one question: half of them paraphrases, half with one thing changed."""
    rng = random.Random(seed)
    rows, bad = [], set()
    filler = lambda: " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "amet", "elit", "sed", "magna"]) for _ in range(8)) + "."
    for q in range(n):
        a, b = FRAMES[q % len(FRAMES)]
        w, v, d = f"zeta{q}x", rng.randint(2, 97), rng.randint(1, 27)
        conflict = q % 2 == 0
        first, second = a.format(w=w, n=v, d=d), b.format(w=w, n=v + 1 if conflict else v, d=d + 1 if conflict else d)
        if conflict:
            bad.add(q)
            if q % len(FRAMES) == 4:
                second = second.replace("improves", "never improves")
        texts = [f"{filler().capitalize()} {first}. {filler().capitalize()}", f"{filler().capitalize()} {second}. {filler().capitalize()}"]
        rows += [(q, 2 * q + k, f"s{k}", t) for k, t in enumerate(texts)]
        rows.append((q, 10_000 + q, "s9", f"{filler().capitalize()} Nothing about it in {rng.randint(2, 90)} days."))
    return rows, bad


def test_planted_conflicts(spark):
    rows, bad = planted(200)
    got = con.conflicts(spark.createDataFrame(rows, "qid int, id int, source_id string, text string")).collect()
    found = {r.qid for r in got if (r.id_a, r.id_b) == (2 * r.qid, 2 * r.qid + 1)}
    precision, recall = len(found & bad) / len(found), len(found & bad) / len(bad)
    assert precision >= 0.98 and recall >= 0.95
    assert all(r.id_b < 10_000 for r in got)
    kinds = {r.qid: r.kinds for r in got}
    assert kinds[0] == "number" and kinds[8] == "date" and kinds[4] == "negation"


def test_no_conflict_within_a_source_or_without_text(spark):
    kind = "qid int, id int, source_id string, text string"
    same = [(1, 1, "s", "The model reached 90 percent accuracy there."), (1, 2, "s", "The model reached 80 percent accuracy there."), (2, 3, "a", None), (2, 4, "b", "")]
    assert con.conflicts(spark.createDataFrame(same, kind)).count() == 0
    other = [(1, 1, "s", "The model reached 90 percent accuracy there."), (1, 2, "t", "The model reached 80 percent accuracy there.")]
    assert [r.kinds for r in con.conflicts(spark.createDataFrame(other, kind)).collect()] == ["number"]


def test_evidence_conflicts(spark, sf_dir):
    """A conflict's sentences are of two sources of one question's evidence."""
    for r in QUERIES["evidence_conflicts"](spark, sf_dir).collect():
        assert r.id_a < r.id_b and r.share >= con.ALIGNED and set(r.kinds.split(",")) <= {"number", "negation", "date"}


# the fitted ranker


@pytest.mark.parametrize(
    ("question", "passage", "want"),
    [("a b c", "x a y b z", (2 / 3, 2 / 3, 0.0)), ("a b c", "a b c", (1.0, 1.0, 1.0)), ("a b", "b a x a b", (1.0, 1.0, 1.0)), ("a a b", "b x x a a", (1.0, 0.5, 0.5)), ("a", "x", (0.0, 0.0, 0.0)), ("", "x", (0.0, 0.0, 0.0)), ("a b", "", (0.0, 0.0, 0.0)), ("a b", "a", (0.5, 0.0, 0.0))],
)
def test_proximity(question, passage, want):
    assert ranker.proximity(question.split(), passage.split()) == pytest.approx(want)


def test_least_window_by_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        lists = [sorted(rng.sample(range(40), rng.randint(1, 6))) for _ in range(rng.randint(1, 4))]
        want = min(b - a + 1 for a in range(40) for b in range(a, 40) if all(any(a <= p <= b for p in x) for x in lists))
        assert ranker.least_window([np.array(x) for x in lists]) == want


def test_a_ranker_learns_the_order(spark):
    rng = random.Random(2)
    rows = [(q, d, grade, grade + rng.gauss(0, 0.3), rng.random(), 0.0, 0.1 * grade, rng.random(), 0.0) for q in range(12) for d in range(12) for grade in [rng.randint(0, 2)]]
    df = spark.createDataFrame(rows, "qid int, id int, grade int, " + ", ".join(f"f_{f} double" for f in ranker.FEATURES))
    weights = ranker.fit(df)
    assert weights["dense"] > 1 > abs(weights["sparse"]) and weights["rrf"] == weights["phrases"] == 0.0
    assert ranker.fit(df.withColumn("grade", F.lit(1))) == dict.fromkeys(ranker.FEATURES, 0.0)


def test_fitted_metrics(spark):
    """On questions that it hasn't seen the ranker's order is better than that of fusion."""
    got = {r.config: r for r in QUERIES["fitted_metrics"](spark, "/root/testdata/sf0.01").collect()}
    assert got["R5"].ndcg > got["R3"].ndcg
