"""The rules of drafts on hand-made rows."""

import json

import pytest
from pyspark.sql import functions as F

from groundwell.operators import drafts as dr

LISTED = "run int, pos int, status string, rank int, passage int"
#: Question 1 is dead, 2 and 3 (without a status) are live; passage 5 is in all three lists, 9 in the dead one's alone.
ROWS = [(1, 1, "abandoned", 1, 5), (1, 1, "abandoned", 2, 9), (1, 2, "sufficient", 1, 7), (1, 2, "sufficient", 2, 5), (1, 3, None, 1, 5), (1, 3, None, 2, 6), (2, 1, "pending", 1, 5)]


@pytest.fixture(scope="module")
def listed(spark):
    return spark.createDataFrame(ROWS, LISTED).cache()


def test_owners(listed):
    got = {(r.run, r.passage): (r.owner, r.live) for r in dr.owners(listed).collect()}
    assert got == {(1, 5): (2, True), (1, 9): (1, False), (1, 7): (2, True), (1, 6): (3, True), (2, 5): (1, True)}


@pytest.mark.parametrize(("most", "want"), [(24, [(7, True), (5, True), (6, True), (9, False)]), (2, [(7, True), (5, True)])])
def test_selected(listed, most, want):
    got = sorted((r.place, r.passage, r.live) for r in dr.selected(listed, most).collect() if r.run == 1)
    assert [(p, live) for _, p, live in got] == want and [n for n, _, _ in got] == list(range(1, len(want) + 1))


def test_round_robin(listed):
    got = sorted((r.place, r.passage, r.live) for r in dr.round_robin(listed).collect() if r.run == 1)
    assert [(p, live) for _, p, live in got] == [(7, True), (5, True), (6, True), (9, False)]
    assert dr.round_robin(listed.where("run > 2")).count() == 0


def test_evidence_of_questions_without_a_list(spark, listed):
    questions = spark.createDataFrame([(1, 1), (1, 4), (1, 4), (2, 1), (3, 1), (None, 1)], "run int, pos int")
    stored = spark.createDataFrame([(1, 4, 8), (1, 4, 8), (1, 4, 3), (1, 1, 2), (9, 1, 1), (None, 1, 4)], "run int, pos int, passage int")
    got = {(r.run, r.pos, r.rank, r.passage) for r in dr.evidence_of(questions, listed, stored).collect() if r.fallback}
    assert got == {(1, 4, 1, 3), (1, 4, 2, 8)}
    assert dr.evidence_of(questions, listed, stored).where("not fallback").count() == len(ROWS)


def test_own_scores_go_before_stored_ones(spark, listed):
    e = listed.withColumn("score", F.col("pos") + F.col("rank") / 10)
    own = spark.createDataFrame([(1, 2, 5, -1.0), (1, 2, 5, -2.0), (1, 3, 6, 3.2), (7, 7, 7, 7.0)], "run int, pos int, passage int, score double")
    got = {(r.run, r.pos): (round(r.f1, 6), r.overridden) for r in dr.best_scores(e, own).collect()}
    # passage 5 is stored with question 1's 1.1; question 2 has -1 for it, and 6's own score is the stored one
    assert got == {(1, 1): (1.2, 0), (1, 2): (2.1, 1), (1, 3): (3.2, 0), (2, 1): (1.1, 0)}


def test_findings_meet_sentences_by_their_text(spark):
    kind = "draft int, at int, text string"
    s = spark.createDataFrame([(1, 0, "One  claim. "), (1, 1, "Another."), (2, 0, "one claim."), (1, 2, None)], kind)
    f = spark.createDataFrame([(1, 5, "ONE claim.", "PARTIAL"), (1, 3, "one\nclaim.", "SUPPORTED"), (1, 0, None, "UNSUPPORTED")], f"{kind}, verdict string")
    got = {(r.draft, r.at): r.verdict for r in dr.with_findings(s, f).collect()}
    assert got == {(1, 0): "SUPPORTED", (1, 1): None, (2, 0): None, (1, 2): "UNSUPPORTED"}


def test_cited_labels(spark):
    shown = spark.createDataFrame([(1, 1, 70), (1, 2, 50), (2, 1, 9)], "run int, place int, passage int")
    cited = spark.createDataFrame([(1, 2), (1, 1), (1, 2), (1, 3), (2, 8)], "run int, place int")
    assert {(r.run, tuple(r.passages), r.unknown) for r in dr.cited_passages(cited, shown).collect()} == {(1, (70, 50), 1), (2, (), 1)}


def test_claim_counts(spark):
    rows = [(1, "claim", v) for v in ("SUPPORTED", "SUPPORTED", "PARTIAL", "UNSUPPORTED", "CONTRADICTED")] + [(1, "gap", None), (1, "discourse", None), (2, "gap", None)]
    got = {r.run: tuple(r)[1:] for r in dr.claim_counts(spark.createDataFrame(rows, "run int, kind string, verdict string")).collect()}
    assert got == {1: (4, 2, 2, 1, 1, 1), 2: (0, 0, 0, 0, 0, 1)}


def reply(*items):
    return json.dumps({"presuppositions": list(items)})


@pytest.mark.parametrize(
    ("given", "want"),
    [
        (reply({"text": " a "}, {"text": "b", "centrality": "Incidental"}), [("a", "core"), ("b", "incidental")]), (reply({"text": "  "}, "bare", 3, None, {"centrality": "core"}, {"text": "c", "centrality": "odd"}), [("c", "core")]),
        (reply(*[{"text": f"t{k}"} for k in range(6)]), [(f"t{k}", "core") for k in range(4)]), (reply({"text": 'say "x", {y}'}), [('say "x", {y}', "core")]), (reply(), []), (json.dumps({"presuppositions": None}), []), (json.dumps({"other": 1}), []), ("not JSON", []), (None, []), ("", []),
    ],
)
def test_extracted_premises(spark, given, want):
    rows = dr.extracted_premises(spark.createDataFrame([(1, given)], "run int, reply string")).orderBy("idx").collect()
    assert [(r.text, r.centrality) for r in rows] == want and [r.idx for r in rows] == list(range(len(want)))


def test_premises_and_note(spark):
    claims = spark.createDataFrame([(1, k, "core" if k else "incidental") for k in range(6)], "run int, idx int, centrality string")
    said = spark.createDataFrame([(1, 0, 1, "CONTRADICTED", 1), (1, 1, 1, "SUPPORTED", 9), (1, 1, 2, "CONTRADICTED", 2), (1, 2, 1, "SUPPORTED", 9), (1, 5, 1, "SUPPORTED", 1), (1, 8, 1, "SUPPORTED", 1)], "run int, idx int, at int, verdict string, label int")
    shown = spark.createDataFrame([(1, 1, 70), (1, 2, 50)], "run int, place int, passage int")
    v = dr.premises(claims, said, shown)
    assert {(r.idx, r.verdict, r.passage) for r in v.collect()} == {(0, "CONTRADICTED", 70), (1, "CONTRADICTED", 50), (2, "SUPPORTED", None)}
    note = dr.premise_note(v.withColumn("text", F.concat(F.lit("c"), "idx")).withColumn("correction", F.col("passage").cast("string"))).first()
    assert (note.established, note.warned, note.correction) == ("c2", True, "50")


def test_grounding(spark):
    rows = [(1, 1, "core", "SUPPORTED"), (1, 2, "core", None), (1, 3, "background", "CONTRADICTED"), (2, 1, "background", "CONTRADICTED"), (2, 2, None, "SUPPORTED"), (3, 1, "core", "CONTRADICTED")]
    got = {r.run: tuple(r)[1:] for r in dr.grounding(spark.createDataFrame(rows, "run int, pos int, kind string, verdict string")).collect()}
    assert got == {1: (0.75, False, None, 1), 2: (0.5, True, 1, 1), 3: (0.0, True, 1, 0)}


def test_evidence_block(spark):
    rows = [("q", 2, "s2", None, "b" * 9), ("q", 1, "s1", "Abstract", "a" * 9), ("p", 1, None, None, None)]
    got = {r.k: r.block for r in dr.evidence_block(spark.createDataFrame(rows, "k string, rank int, source_id string, section string, text string"), "k", 4).collect()}
    assert got == {"q": "[P01] s1, Abstract\naaaa\n\n[P02] s2\nbbbb", "p": "[P01] \n"}


@pytest.mark.parametrize(
    ("decided", "recorded", "unresolved", "want"),
    [(None, ["could not establish: a", "b?"], ["b?", "c."], ["a.", "b?", "c."]), ([], ["a"], ["b"], []), (["could not establish: x!"], ["a"], [], ["x!"]), (None, [], [], [])],
)
def test_gaps(spark, decided, recorded, unresolved, want):
    df = spark.createDataFrame([(decided, recorded, unresolved)], "d array<string>, r array<string>, u array<string>")
    assert df.select(dr.shown_gaps(dr.listed_gaps(F.col("d"), F.col("r"), F.col("u"))).alias("x")).first().x == want


@pytest.mark.parametrize(
    ("rule", "terminal", "open_", "head", "why"),
    [
        ("threshold", "PARTIAL", [1, 3, 4, 6, 7], "Answered in part", "0.46: 2 of 7 resolved. Not established: sq1; sq3; sq4 (+2 more)."), ("threshold", "ANSWER", [1], "Answered", "0.46: 2 of 7 resolved."),
        ("threshold", "ABSTAIN", [], "Not answered", "0.46: 2 of 7 resolved."), ("premise", "ABSTAIN", [2], "Rests on a false premise", "0.46: 2 of 7 resolved. Not established: sq2."),
    ],
)
def test_headlines(spark, rule, terminal, open_, head, why):
    df = spark.createDataFrame([(rule, terminal, open_, 0.456, 2, 7)], "r string, t string, o array<int>, s double, d int, n int")
    got = df.select(dr.banner(F.col("r"), F.col("t")).alias("b"), dr.rationale(F.col("s"), F.col("d"), F.col("n"), F.col("o"), F.col("t")).alias("w")).first()
    assert (got.b, got.w) == (head, why)
