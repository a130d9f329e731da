"""What comes from outside, on hand-made rows."""

import math

import pytest
from pyspark.sql import functions as F

from groundwell.operators import features as fs
from groundwell.operators import outside


def test_cached_answers(spark):
    entries = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 1, 2), ("b", 5, 1), (None, 1, 1)], "key string, at int, version int")
    lookups = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "c"), (5, None)], "n int, key string")
    assert {r.n: r.hit for r in outside.cached(lookups, entries, 1).collect()} == {1: False, 2: True, 3: True, 4: False, 5: False}
    assert {r.n: r.hit for r in outside.cached(lookups, entries.where("at > 9"), 1).collect()} == dict.fromkeys(range(1, 6), False)


@pytest.mark.parametrize(("hits", "lookups", "want"), [(1, 3, 0.333333), (0, 0, 0.0), (2, 2, 1.0)])
def test_hit_rate(spark, hits, lookups, want):
    assert spark.createDataFrame([(hits, lookups)], "h int, l int").select(outside.hit_rate(F.col("h"), F.col("l")).alias("x")).first().x == want


@pytest.mark.parametrize(("monthly", "configured", "want"), [(1000, None, 33), (29, None, 1), (0, None, 1), (1000, 7, 7), (1000, 0, 1)])
def test_daily_cap(spark, monthly, configured, want):
    assert spark.createDataFrame([(monthly, configured)], "m int, c int").select(outside.daily_cap(F.col("m"), F.col("c")).alias("x")).first().x == want


def test_items_by_id(spark):
    items = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "id string, n int")
    wanted = spark.createDataFrame([("a",), ("a",), ("z",), (None,)], "id string")
    assert sorted(r.n for r in outside.by_id(items, wanted, "id").collect()) == [1, 2]


def test_papers(spark):
    rows = [("x", 3, "t", "b"), ("x", 1, None, "b"), ("x", 2, " ", None), ("y", 9, "t", ""), (None, 5, "t", "b")]
    got = {r.n: r.score for r in outside.papers(spark.createDataFrame(rows, "g string, n int, title string, body string"), "g", "n").collect()}
    assert got == {1: 1.0, 3: 0.5, 9: 1.0, 5: 1.0}


@pytest.mark.parametrize(("logits", "which", "want"), [([1.0, 2.0, 3.0], 1, math.exp(2) / (math.exp(1) + math.exp(2) + math.exp(3))), ([0.3], 2, 0.3), ([1.0, 2.0], 5, 0.0), ([1000.0, 0.0], 0, 1.0), ([], 0, None), (None, 0, None)])
def test_class_probability(spark, logits, which, want):
    got = spark.createDataFrame([(logits, which)], "z array<double>, w int").select(outside.class_probability(F.col("z"), F.col("w")).alias("p")).first().p
    assert got == want if want is None else got == pytest.approx(want)


@pytest.mark.parametrize(("reply", "want"), [('{"k":1,"v":null}', []), ('{"v":1}', ["k"]), ("{}", ["k", "v"]), ("[1]", ["k", "v"]), ("no", ["k", "v"]), (None, ["k", "v"])])
def test_missing_keys(spark, reply, want):
    assert spark.createDataFrame([(reply,)], "r string").select(outside.missing_keys(F.col("r"), ["k", "v"]).alias("x")).first().x == want


def test_sources_are_missing_without_evidence(spark):
    questions = spark.createDataFrame([(1,), (2,), (3,), (3,)], "qid int")
    evidence = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (1, ""), (2, None), (2, ""), (9, "a")], "qid int, source_id string")
    assert {r.qid: (r.sources, r.f4) for r in fs.source_counts(questions, evidence).collect()} == {1: (2, 2.0), 2: (0, 0.0), 3: (0, None)}
