"""Hand values and null rules of the operators."""

import math

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from groundwell.functions import text as t
from groundwell.operators import calibration, decisions, passages, quota, ranks, retrieval
from groundwell.queries import ORACLE_SQL, QUERIES


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'double' if isinstance(v, float) else 'int'}" for k, v in values.items())).select(column.alias("x")).first().x


def test_dehyphenate(spark):
    assert one(spark, t.dehyphenate(F.col("s")), s="under-\n standing and é-\né x-y") == "understanding and éé x-y"


@pytest.mark.parametrize(
    ("line", "want"),
    [("3.1 Related Work", "Related Work"), ("ABSTRACT", "Abstract"), ("IV. RESULTS", "Results"), ("5 Experiments and more", "Experiments"), ("Something else", None), ("References", "References")],
)
def test_canonical_section(spark, line, want):
    assert one(spark, t.canonical_section(F.col("s")), s=line) == want


def test_sections_and_chunks(spark):
    text = "Title\n12\nAbstract\nWe do it.\n2 Related Work\nOthers did. More did.\nReferences\n[1] X\n7 Odd Heading\nbody"
    docs = spark.createDataFrame([(1, text), (2, None)], "id int, s string")
    found = t.with_sections(docs, "s", ["id"]).orderBy("at").collect()
    assert [(s.section, s.body) for s in found if s.id == 1] == [("Front Matter", "Title"), ("Abstract", "We do it."), ("Related Work", "Others did. More did."), (None, "body")]
    assert all(s.id == 1 for s in found)


def test_sentence_windows():
    text = "Aa bb. Cc dd. Ee ff. Gg hh."
    assert passages.sentence_windows(text, 100, 10) == [text]
    assert passages.sentence_windows(text, 14, 7) == ["Aa bb. Cc dd.", "Cc dd. Ee ff.", "Ee ff. Gg hh."]
    assert passages.sentence_windows("x" * 25, 10, 2) == ["x" * 10, "x" * 10, "x" * 9, "x"]
    # a sentence that is too long ends the windows around it; a long new sentence comes on top of what is carried
    assert passages.sentence_windows("Aa bb. " + "C" * 16 + ". Dd.", 14, 7) == ["Aa bb.", "C" * 14, "C" * 9 + ".", "CC.", "Dd."]
    assert passages.sentence_windows("Aa bb. Cc dd ee ff. Gg.", 14, 7) == ["Aa bb.", "Aa bb. Cc dd ee ff.", "Gg."]
    assert passages.sentence_windows(None, 10, 2) == passages.sentence_windows("  ", 10, 2) == []
    with pytest.raises(ValueError):
        passages.sentence_windows("x", 5, 5)


def test_segments_move_citations_back(spark):
    a, b = "P" + "a" * 12, "P" + "b" * 12
    drafts = [(0, f"It rose. [{a}] [{b}] Then it fell [{b}]. End."), (1, None), (2, f"[{a}] leads? [{b}] [{a}]. next one! (Yes)  it\n is"), (3, f"Up. [{a}]"), (4, " \n ")]
    df = spark.createDataFrame(drafts, "id int, d string").select("id", passages.segments(F.col("d")).alias("s"))
    got = {r.id: [(x["index"], x.text, x.citations) for x in r.s] for r in df.collect()}
    assert got[0] == [(0, f"It rose. [{a}] [{b}]", [a, b]), (1, f"Then it fell [{b}].", [b]), (2, "End.", [])]
    assert got[2] == [(0, f"[{a}] leads? [{b}] [{a}]", [a, b]), (1, ". next one!", []), (2, "(Yes) it is", [])]
    assert got[3] == [(0, f"Up. [{a}]", [a])] and got[1] == got[4] == []


@pytest.mark.parametrize(
    ("given", "want"),
    [("x [P1, P3] y (P05) z [P01-P03]", "x [P01][P03] y [P05] z [P01][P02][P03]"), ("[P1-P99] stays", "[P1-P99] stays"), ("【P7】", "[P07]"), ("[P5 and P2–P3; P5]", "[P02][P03][P05]"), ("[P01][P02]", "[P01][P02]"), ("[Pa] (see P1) [3]", "[Pa] (see P1) [3]"), (None, None), ("", "")],
)
def test_plain_citations(given, want):
    assert passages.plain_citation(given) == want


def test_uncited_and_markers(spark):
    c = "P" + "a" * 12
    long = "This sentence has rather more than forty characters"
    text = f"{long}. {long} [{c}]. Short one. {long}!"
    assert one(spark, passages.uncited(F.col("s")), s=text) == 2
    assert one(spark, passages.without_markers(F.col("s")), s=f"a [citation needed] b [UNRESOLVED]. [{c}] [3] [x]") == f"a b. [{c}] [3] [x]"


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ('{"a":{"b":1}} trailing }', '{"a":{"b":1}}'), ('{"a": 1} and then {"b": 2}', '{"a":1}'), ('{"a":1} prose with a } brace', '{"a":1}'), ('say ```json\n[1, 2,]\n``` so', "[1,2]"), ('{"a": [1, 2', '{"a":[1,2]}'),
        ('{"a": 1, "b', '{"a":1}'), ('{"a": 1, "b":', '{"a":1}'), ('{"a": "x } y", "b": 2}', '{"a":"x } y","b":2}'), ('{"a": "cut', '{"a":"cut"}'), ('{"a', "{}"), ('{"a": "q\\"}"}', '{"a":"q\\"}"}'), ("no json", None), ("5", None), ("", None), (None, None),
        ('prose [1] then {"a": 2}', "[1]"), ('{"a": 1,}', '{"a":1}'),
    ],
)
def test_repaired(given, want):
    from groundwell.functions.json_text import repaired

    assert repaired(given) == want


def test_bounded():
    from groundwell.functions.json_text import bounded

    deep = {"a": {"b": {"c": {"d": {"e": {"f": {"g": 1}}}}}}}
    assert bounded("x" * 2003) == "x" * 2000 + "... <+3 chars>" and bounded(list(range(27)))[24:] == [24, "<+2 more>"]
    assert bounded(deep)["a"]["b"]["c"]["d"]["e"]["f"] == {"g": "<max depth>"} and bounded({"n": None, "t": True, "x": 1.5}) == {"n": None, "t": True, "x": 1.5}


def test_days_in_a_zone_with_summer_time(spark):
    """Los Angeles is 7 hours behind in July and 8 in January; midnight comes after 24 hours even where the clocks change."""
    import datetime as dt
    from zoneinfo import ZoneInfo

    times = [dt.datetime(2024, m, d, h, 30, tzinfo=dt.UTC) for m, d in ((1, 5), (7, 5), (3, 10), (11, 3)) for h in (0, 6, 7, 8, 12, 23)]
    rows = spark.createDataFrame([(int(t.timestamp() * 1_000_000), m) for t in times for m in ("click", "view")], "us long, model string")
    got = rows.select("us", "model", quota.local_day(F.col("us"), F.col("model")).alias("day"), quota.seconds_to_reset(F.col("us"), F.col("model")).alias("left")).collect()
    for r in got:
        local = dt.datetime.fromtimestamp(r.us / 1_000_000, ZoneInfo(quota.ZONES[r.model]))
        assert r.day == (local.date() - dt.date(1970, 1, 1)).days
        assert r.left == local.replace(hour=0, minute=0, second=0, microsecond=0).timestamp() + 86400 - r.us / 1_000_000


def test_ranks_of_a_large_group(spark):
    from groundwell.operators.ranks import ranked_in

    rows = spark.range(500).select((F.col("id") * 7 % 500).alias("k"), F.when(F.col("id") % 5 > 0, "hot").when(F.col("id") % 10 == 0, "x").alias("g"))
    got = ranked_in(rows.repartition(7), "g", "k").collect()
    for g in ("hot", "x", None):
        mine = sorted((r.k, r["rank"]) for r in got if r.g == g)
        assert [n for _, n in mine] == list(range(1, len(mine) + 1)) and mine


def test_last_value_before(spark):
    """In a large group, small ones, and one without a key."""
    rng = np.random.default_rng(8)
    rows = [(int(g) if g < 6 else None, int(t), k, "xyz"[k % 3] if rng.random() < 0.4 else None) for k, (g, t) in enumerate(zip(rng.choice([1, 1, 1, 1, 2, 3, 9], 3000), rng.integers(0, 500, 3000), strict=True))]
    want, last = {}, {}
    for g, t, k, v in sorted(rows, key=lambda r: (r[1], r[2])):
        want[k] = last.get(g)
        last[g] = v or last.get(g)
    df = spark.createDataFrame(rows, "g int, t int, k int, v string")
    assert {r.k: r.before for r in ranks.last_before(df, "g", "v", "before", "t", "k").collect()} == want


def test_filters_on_nulls(spark):
    rows = spark.createDataFrame([(1, None, None), (2, "Abstract", "2024-01-01"), (3, "Method", "2020-01-01")], "id int, section string, published string")
    ids = lambda **f: sorted(r.id for r in rows.where(retrieval.passes(**f)).collect())
    assert ids(published_after="2021-01-01") == [2]
    assert ids(exclude_sections=["Abstract"]) == [1, 3]
    assert ids(sections=["Method"]) == [3]
    assert ids() == [1, 2, 3]


def test_metrics(spark):
    runs = spark.createDataFrame([("R", 1, 10, 1), ("R", 1, 11, 2), ("R", 2, 99, 1)], "config string, qid long, id long, rank int")
    qrels = spark.createDataFrame([(1, 10, 2), (1, 11, 2), (1, 12, 1), (2, 5, 1)], "qid long, id long, grade int")
    graded, counts = runs.join(qrels, ["qid", "id"], "left"), qrels.groupBy("qid", "grade").agg(F.count("*").alias("n"))
    got = {r.qid: r for r in retrieval.metrics(graded, counts).collect()}
    dcg = 3 + 3 / math.log2(3)
    assert got[1].ndcg == pytest.approx(dcg / (dcg + 1 / math.log2(4))) and got[1].recall == pytest.approx(2 / 3) and got[1].strict_recall == 1 and got[1].mrr == 1
    assert (got[2].ndcg, got[2].recall, got[2].mrr) == (0, 0, 0)


def test_dense_top_is_exact(spark):
    rng = np.random.default_rng(0)
    v = rng.standard_normal((60, 8))
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, vector array<double>")
    got = retrieval.dense_top(rows, rows.where("id < 5").select(F.col("id").alias("qid"), "vector"), 3).collect()
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for q in range(5):
        want = [k for k in np.argsort(-(unit @ unit[q])) if k != q][:3]
        assert [r.id for r in sorted(got, key=lambda r: r.rank) if r.qid == q] == want


def test_words_are_counted_some_at_a_time(monkeypatch):
    """What a task counts at once is bounded by words, a document at least; the postings are those of all documents at once."""
    rng = np.random.default_rng(12)
    docs = [(i, [f"w{x}" for x in rng.integers(0, 9, n)]) for i, n in enumerate([0, 5, 40, 0, 3, 7, 0, 25, 1, 0])]
    batch = pa.record_batch({"id": pa.array([i for i, _ in docs], pa.int64()), "ts": pa.array([ws for _, ws in docs], pa.list_(pa.string()))})
    monkeypatch.setattr(retrieval, "WORDS", 12)
    for given in ([batch], [batch.slice(2, 3), batch.slice(5)]):
        parts = [p.to_pylist() for p in retrieval._counted(iter(given))]
        words = [sum(x["tf"] for x in p) for p in parts]
        assert max(words) == 40 and all(n <= 12 or len({x["id"] for x in p}) == 1 for n, p in zip(words, parts, strict=True))
        got = sorted((x["id"], x["term"] or "", x["tf"], x["dl"], x["head"]) for p in parts for x in p)
        some = docs if len(given) == 1 else docs[2:]
        assert got == sorted([(i, w, ws.count(w), len(ws), w == ws[0]) for i, ws in some for w in set(ws)] + [(i, "", 0, 0, True) for i, ws in some if not ws])


def test_queries_meet_vectors_some_at_a_time(monkeypatch):
    """What a task holds of scores is bounded, whatever the blocks; the best are those of one matrix, ties by id."""
    rng = np.random.default_rng(11)
    q, v = rng.integers(-2, 3, (700, 4)) + 0.5, rng.integers(-2, 3, (900, 4)) + 0.5
    q, v = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (q, v))
    whole, seen, plain = retrieval.cosines(q, v), [], retrieval.cosines
    monkeypatch.setattr(retrieval, "cosines", lambda a, b: seen.append(len(a)) or plain(a, b))
    best = retrieval.Best(np.arange(700), 5)
    for at in range(0, 900, 300):
        best.meet(q, v[at : at + 300], np.arange(at, at + 300), np.arange(700), True)
    assert max(seen) <= retrieval.CHUNK < 700
    assert best.found.tolist() == [sorted(range(900), key=lambda i, k=k: (-whole[k, i], i))[:5] for k in range(700)]


def test_dense_top_in_blocks(spark, monkeypatch):
    """Any cut into blocks gives the same rows, ties included; queries without a vector have none."""
    rng = np.random.default_rng(1)
    v = rng.integers(-2, 3, (300, 4)).astype(float)
    v[(v == 0).all(axis=1), 0] = 1
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)] + [(999, None)], "id long, vector array<float>")
    asked = rows.where("id % 3 = 0").select(F.col("id").alias("qid"), "vector")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    score = np.round(unit @ unit.T, 6)
    want = {q: sorted((-score[q, k], k) for k in range(300) if k != q)[:5] for q in range(0, 300, 3)}
    for q, b in ((2048, 4096), (7, 11), (1, 40)):
        monkeypatch.setattr(retrieval, "QUERY_BLOCK", q)
        monkeypatch.setattr(retrieval, "VECTOR_BLOCK", b)
        got = {}
        for r in retrieval.dense_top(rows.repartition(3), asked, 5).collect():
            got.setdefault(r.qid, []).append((r.rank, -r.score, r.id))
        assert {q: [(s, i) for _, s, i in sorted(x)] for q, x in got.items()} == want


def test_stored_index(spark, tmp_path):
    """Documents without words count; an index that grew is the index of all; a search reads its terms' folders only."""
    docs = spark.createDataFrame([(1, "red fox red"), (2, "the of"), (3, None), (4, "blue fox"), (5, "green sea")], "id long, text string")
    asked = spark.createDataFrame([(1, "fox red red"), (2, "the"), (3, "sea")], "qid long, text string")
    whole = retrieval.search(retrieval.index(docs), asked).collect()
    path = f"file://{tmp_path}/index"
    retrieval.write_index(docs.where("id < 3"), path)
    grown = retrieval.search(retrieval.append(docs, path), asked).collect()
    assert sorted(whole) == sorted(grown) and {(r.qid, r.id) for r in whole} == {(1, 1), (1, 4), (3, 5)}
    idf = lambda df: math.log(1 + (5 - df + 0.5) / (df + 0.5))
    length = 7 / 5
    part = lambda tf, dl: tf / (tf + 1.5 * (0.25 + 0.75 * dl / length))
    assert {(r.qid, r.id): r.score for r in whole}[1, 1] == pytest.approx(2 * idf(1) * part(2, 3) + idf(2) * part(1, 3), abs=1e-6)
    assert retrieval.search(retrieval.index(docs.limit(0)), asked).count() == 0


def test_an_index_follows_its_table(spark, tmp_path):
    """It's written once, and anew when the table's files change."""
    from groundwell.sources.work import kept

    made = []
    table = f"file://{tmp_path}/t.parquet"
    for rows, times in ((10, 1), (10, 1), (11, 2)):
        if len(made) < times:
            spark.range(rows).write.mode("overwrite").parquet(table)
        path = kept(spark.read.parquet(table), "test", lambda p: made.append(p) or spark.read.parquet(table).write.parquet(p))
        assert len(made) == times and spark.read.parquet(path).count() == rows


def test_features_by_hand(spark):
    from groundwell.operators import features as fs

    rows = [(1, 1, 5.0, "a", "2026-01-01"), (1, 2, 4.0, "a", None), (1, 3, 3.0, "", "x"), (1, 4, 2.0, "b", "2020-01-01"), (1, 5, 0.5, None, None), (2, 1, None, "a", None)]
    e = spark.createDataFrame(rows, "qid int, id int, rerank_score double, source_id string, published string")
    got = {r.qid: r for r in fs.evidence_features(e, "2026-09-06").collect()}
    assert (got[1].f1, got[1].f2, got[1].f3, got[1].f4, got[1].n) == (5.0, 4.0, 4.5, 2.0, 5)
    assert got[1].f10 == pytest.approx(1 - 248 / 365.25 / 8, abs=1e-6)  # the later of two dates
    assert (got[2].f1, got[2].f2, got[2].f3, got[2].f4, got[2].f10) == (None, None, None, 1.0, None)
    cols = {"f5": fs.contradiction_rate(F.col("c"), F.col("n"), F.col("ran")), "f6": fs.entailment_strength(F.col("v")), "f7": fs.premise_grounding(F.col("ran"), F.col("g")), "f9": fs.route_escalation(F.col("routes"))}
    d = spark.createDataFrame([(1, 3, True, ["SUPPORTED", "ODD", "CONTRADICTED"], 0.5, ["web", "arxiv_fulltext"]), (None, 1, True, [], None, []), (1, 4, False, None, 0.5, ["evidence_store"])], "c int, n int, ran boolean, v array<string>, g double, routes array<string>")
    assert [tuple(r) for r in d.select(*[c.alias(k) for k, c in cols.items()]).collect()] == [(0.333333, 0.5, 0.5, 1.0), (0.0, None, None, None), (None, None, None, 0.0)]


def test_fusion_and_fallback(spark):
    lists = spark.createDataFrame([("dense", 1, 7, 1, 0.9), ("sparse", 1, 7, 2, 3.0), ("sparse", 1, 8, 1, 4.0)], "arm string, qid long, id long, rank int, score double")
    got = {r.id: r for r in retrieval.rrf(lists).collect()}
    assert got[7].rrf == pytest.approx(1 / 61 + 1 / 62, abs=1e-8) and got[8].dense_rank is None
    scored = spark.createDataFrame([(1, 1, True), (1, 2, False), (2, 3, False)], "qid long, id long, ok boolean")
    assert sorted((r.id, r.fallback) for r in retrieval.with_fallback(scored, "ok").collect()) == [(1, False), (3, True)]


@pytest.mark.parametrize(("pool", "n", "want"), [(7, 3, [3, 2, 2]), (2, 3, [1, 1, 0]), (0, 2, [0, 0]), (6, 3, [2, 2, 2])])
def test_even_split(spark, pool, n, want):
    rows = spark.range(n).select(decisions.even_split(F.lit(pool), F.lit(n), F.col("id")).alias("x"), "id").orderBy("id")
    assert [r.x for r in rows.collect()] == want


def test_allocation_sums_to_pool(spark):
    rows = spark.createDataFrame([(1, 1, 1.0, 10), (1, 2, 0.3, 10), (1, 3, 0.3, 10), (1, 4, 0.0, 10), (2, 1, 0.0, 5)], "run long, pos int, value double, pool int")
    got = {(r.run, r.pos): r.share for r in decisions.allocate(rows).collect()}
    assert sum(v for k, v in got.items() if k[0] == 1) == 10 and got[1, 4] == 0 and got[2, 1] == 0 and got[1, 2] >= got[1, 3]


@pytest.mark.parametrize(
    ("rounds", "f1", "sources", "best", "want"),
    [(1, None, 0, None, "in_progress"), (3, None, 0, None, "abandoned"), (1, 4.0, 2, None, "sufficient"), (1, 4.0, 1, None, "in_progress"), (2, 1.2, 3, 1.0, "insufficient"), (2, -1.0, 3, -1.2, "abandoned"), (2, 2.0, 3, 1.0, "in_progress"), (3, 4.5, 1, 1.0, "sufficient")],
)
def test_round_policy(spark, rounds, f1, sources, best, want):
    rows = spark.createDataFrame([(rounds, f1, sources, best)], "r int, f double, s int, b double")
    assert rows.select(decisions.judge_round(F.col("r"), F.col("f"), F.col("s"), F.col("b")).alias("x")).first().x == want


def test_thresholds_are_inclusive(spark):
    rows = spark.createDataFrame([(0.65,), (0.4,), (0.39,), (None,)], "score double")
    no = F.lit(False)
    decision, rule = decisions.terminal(F.col("score"), no, no, F.lit(True), no, F.lit(True))
    assert [(r.d, r.r) for r in rows.select(decision.alias("d"), rule.alias("r")).collect()] == [("ANSWER", "threshold"), ("PARTIAL", "threshold"), ("ABSTAIN", "threshold"), ("ABSTAIN", "no_evidence")]


def test_calibration_by_hand(spark):
    rows = spark.createDataFrame([(k, int(p > 0.5), p) for k, p in enumerate([0.0, 0.2, 0.3, 0.7, 0.9, 1.0])], "id long, label int, p double")
    assert {r.bin: r.n for r in calibration.reliability(rows).collect()} == {1: 2, 2: 1, 4: 1, 5: 2}
    assert calibration.roc_auc(rows).first().auc == 1.0
    assert calibration.roc_auc(rows.where("label = 1")).first().auc is None
    assert calibration.fit_logistic(rows.where("label = 1"), ["p"]).count() == 0


def test_minute_window_leaves_the_call_out(spark):
    rows = spark.createDataFrame([(1, 0, "m", 5), (2, 60_000_000, "m", 7), (3, 60_000_001, "m", 9)], "event_id long, us long, model string, tokens long")
    got = {r.event_id: (r.n_minute, r.tokens_minute) for r in quota.minute_windows(rows).collect()}
    assert got == {1: (0, 0), 2: (1, 5), 3: (1, 7)}


def test_label_pool_has_what_the_reranker_lifts(spark, tmp_path):
    """Both arms agree on the order 0 to 39; the scorer prefers 20 to 39, of which 20 to 29 reach it."""
    from groundwell.plans import records, retrieval as plans

    texts = ["alpha " * 20 + f"w{k} " * k if k < 20 else "beta gamma delta " + f"w{k} " * (600 + k) for k in range(40)]
    spark.createDataFrame([(k, x, "en", "s") for k, x in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "alpha beta gamma delta")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, [math.cos(k / 50), math.sin(k / 50)], k % 3) for k in range(40)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert {x.id: x.configs for x in plans.label_pool(spark, str(tmp_path)).collect()} == {k: 4 if k < 10 else 3 if k < 20 else 1 for k in range(30)}
    assert {x.id for x in plans.pooled_candidates(spark, str(tmp_path)).collect()} == set(range(20))
    assert [x.pooled for x in plans.label_pool_coverage(spark, str(tmp_path)).collect()] == [30]
    assert {x.doc_id for x in records.label_pool_merged(spark, str(tmp_path)).where("pooled").collect()} == set(range(30))


@pytest.fixture(scope="module")
def eight_passages(spark, tmp_path_factory):
    """Eight passages, each with a number of its own, from seven sources: 27 pairs that contradict, of 28; those of one source aren't looked at."""
    d = str(tmp_path_factory.mktemp("eight"))
    spark.createDataFrame([(k, f"alpha beta {k + 100}", "en", f"s{min(k, 6)}") for k in range(8)], "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, "alpha beta"), (7, "alpha")], "item_id long, text string").coalesce(1).write.parquet(f"{d}/benchmark.parquet")
    return d


@pytest.mark.parametrize(("query", "unseen"), [("sufficiency_features", None), ("feature_vector", 0.0)])
def test_f5_looks_at_all_pairs(spark, eight_passages, query, unseen):
    want = {1: round(27 / 28, 6), 7: unseen}
    assert {x.qid: x.f5 for x in QUERIES[query](spark, eight_passages).collect()} == want
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{eight_passages}/{t}.parquet/*.parquet'")
    assert dict(duck.sql(f"SELECT qid, f5 FROM ({ORACLE_SQL[query]})").fetchall()) == want


def test_contradiction_pairs_looks_at_the_first_15(spark, eight_passages):
    assert [x.scanned for x in QUERIES["contradiction_pairs"](spark, eight_passages).where("qid = 1").collect()] == [15] * 15
