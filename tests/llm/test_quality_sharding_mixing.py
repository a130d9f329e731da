"""Quality rules, sharding and mixing against plain Python, and on odd tables."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from groundwell.llm import mixing, quality_rules, sharding
from groundwell.llm.common import table, work_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, slot string, key int, bucket string"


def odd(spark, rows=None):
    """Nulls, empty and long texts, repeats, and columns whose names clash with inner ones."""
    long = " ".join(f"w{k % 997}" for k in range(50_000))
    texts = [None, "", "   \n", "one", "a b c", long, "x y z " * 40, "x y z " * 40, "tie " * 30, "é ñ ü " * 20]
    data = [(k, t, "en", None if k % 3 == 0 else f"s{k % 2}", None, "a", "b", 1, "c") for k, t in enumerate(texts)] + [(9, "é ñ ü " * 20, "en", None, None, "a", "b", 1, "c")] * 2 + [(None, "no id", None, "s1", 1, None, None, None, None)]
    return spark.createDataFrame(data if rows is None else rows, SCHEMA)


def counts_by_hand(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    many = Counter(grams)
    covered = {j for i, g in enumerate(grams) if many[g] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_counts_against_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source").unionByName(odd(spark).select("doc_id", "text", "source"))
    got = quality_rules.text_counts(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts_by_hand(r.text)


def test_op9_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = quality_rules.op9(spark, sf_dir)
    cols = sorted(got.columns)
    want = con.sql(quality_rules.ORACLE_SQL)
    order = [want.columns.index(c) for c in cols]
    assert sorted(repr([r[c] for c in cols]) for r in got.collect()) == sorted(repr([r[k] for k in order]) for r in want.fetchall())


def test_quality_filter_on_odd_rows(spark):
    docs = odd(spark)
    kept = quality_rules.quality_filter(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert 0 not in ids and 1 not in ids and 6 not in ids and None not in ids
    assert quality_rules.quality_filter(odd(spark, [])).count() == 0


def test_a_bad_host_is_rejected(spark):
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(30)) if host == "good" or k % 5 == 0 else "bad", "en", host, 1, "", "", 1, "") for host in ("good", "worse", "good2") for k in range(40)]
    rows = [r if r[3] != "good2" else (r[0], " ".join(f"q{j}" for j in range(30)), *r[2:]) for r in rows]
    got = Counter(r.source for r in quality_rules.quality_filter(odd(spark, rows)).collect())
    assert got == {"good": 40, "good2": 40}


def replayed(spark, n, *seeds):
    """Fisher-Yates in plain Python, with Spark's hash for the draws."""
    from pyspark.sql import functions as F

    draws = {r.i: r.j for r in spark.range(1, max(n, 2)).select(F.col("id").cast("int").alias("i")).select("i", F.pmod(F.xxhash64(*seeds, "i"), F.col("i").cast("long") + 1).alias("j")).collect()}
    order = list(range(n))
    for i in range(n - 1, 0, -1):
        order[i], order[draws[i]] = order[draws[i]], order[i]
    return order


def test_fisher_yates(spark):
    from pyspark.sql import functions as F

    got = [r.x for r in spark.range(300).select(sharding.fisher_yates(F.lit(4), F.lit(1), F.col("id")).alias("x")).collect()]
    assert all(sorted(x) == [0, 1, 2, 3] for x in got)
    assert len({tuple(x) for x in got}) == 24  # each order comes up
    first = Counter(x[0] for x in got)
    assert min(first.values()) > 40
    for n in (1, 2, 3, 5, 16, 17, 1000):
        assert spark.range(5, 6).select(sharding.fisher_yates(F.lit(n), F.lit(9), F.col("id")).alias("x")).first().x == replayed(spark, n, F.lit(9), F.lit(5).cast("long"))


def test_shards_are_a_replay(spark, tmp_path):
    """The whole sequence, by plain Python: buckets by hash, each in order of its keys, shuffled, one after another."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(k, f"text {k}") for k in range(700)], "doc_id long, text string")
    out = sharding.shuffle_into_shards(docs, f"file://{tmp_path}/t", shards=3, bucket_rows=9).collect()
    buckets = -(-700 // 9)
    rows = docs.select("doc_id", F.xxhash64(F.lit(17), "doc_id", "text").alias("key")).collect()
    whole = []
    for b in range(buckets):
        held = sorted((r.key, r.doc_id) for r in rows if r.key % buckets == b)
        places = replayed(spark, len(held), F.lit(17), F.lit(b).cast("long")) if held else []
        whole += [i for _, (_, i) in sorted(zip(places, held, strict=True))]
    assert [r.record.doc_id for r in sorted(out, key=lambda r: (r.shard, r.slot))] == whole


def test_very_many_equal_records(spark, monkeypatch):
    monkeypatch.setattr(sharding, "REPEATS", 20)
    docs = odd(spark, [(None, "", "en", "s", k, "", "", 1, "") for k in range(500)] + [(k, f"t{k}", "en", "s", k, "", "", 1, "") for k in range(300)])
    out = sharding.shuffle_into_shards(docs, work_path(spark, "t"), shards=4).collect()
    assert Counter(tuple(r.record) for r in out) == Counter(map(tuple, docs.collect()))
    assert sorted((r.shard, r.slot) for r in out) == [(s, k) for s in range(4) for k in range(200)]
    share = Counter(r.shard for r in out if r.record.doc_id is None)
    assert min(share.values()) > 90  # 125 of each, as hashes fall


@pytest.mark.parametrize("size", [{}, {"bucket_rows": 3}])
def test_shards_on_odd_rows(spark, size):
    docs = odd(spark)
    out = sharding.shuffle_into_shards(docs, work_path(spark, "t"), shards=4, **size).collect()
    assert Counter(tuple(r.record) for r in out) == Counter(map(tuple, docs.collect()))
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    again = sharding.shuffle_into_shards(docs.repartition(3), work_path(spark, "t"), shards=4, **size).collect()
    assert Counter((r.record.doc_id, r.record.text, r.shard, r.slot) for r in out) == Counter((r.record.doc_id, r.record.text, r.shard, r.slot) for r in again)


def test_shards_of_nothing_and_of_the_table(spark, sf_dir):
    assert sharding.shuffle_into_shards(odd(spark, []), work_path(spark, "t")).count() == 0
    docs = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    got = sharding.op2(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))


def water_level(sizes, weights, total):
    target, open_ = {}, set(sizes)
    while True:
        level = (total - sum(target.values())) / sum(weights[s] for s in open_) if open_ else 0
        over = {s for s in open_ if weights[s] * level >= 2 * sizes[s]}
        if not over:
            return target | {s: weights[s] * level for s in open_}
        target |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over


def test_mixing(spark, sf_dir):
    rows = mixing.op8(spark, sf_dir).collect()
    docs = table(spark, sf_dir, "documents").collect()
    assert sorted(r.doc_id for r in rows) == sorted(d.doc_id for d in docs)
    sizes = Counter()
    for d in docs:
        sizes[d.source] += len((d.text or "").split())
    names = sorted(sizes)
    want = water_level(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, 1.5 * sum(sizes.values()))
    taken = Counter()
    for r in rows:
        assert r.taken <= 2 * r.size and r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
    largest = max(r.size for r in rows)
    assert all(abs(taken[s] - want[s]) <= largest for s in names)
    assert sum(taken.values()) == pytest.approx(sum(want.values()), rel=0.02)
    assert {(r.doc_id, r.taken) for r in rows} == {(r.doc_id, r.taken) for r in mixing.op8(spark, sf_dir).collect()}


def test_flight_keeps_the_sums():
    rng = np.random.default_rng(0)
    p, size = rng.random(400), rng.integers(1, 50, 400)
    out = mixing.flight(p, size, rng)
    assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 2
    assert out.sum() == pytest.approx(p.sum()) and (out * size).sum() == pytest.approx((p * size).sum())
    # flight is fair: on average it leaves each probability as it was
    sizes = np.array([1, 2, 3, 4, 5, 6])
    mean = np.mean([mixing.flight(np.full(6, 0.3), sizes, np.random.default_rng(k)) for k in range(800)], axis=0)
    assert abs(mean - 0.3).max() < 0.06
    assert mixing.landing(np.array([1.0, 0.4, 0.0]), np.array([9, 5, 9])).tolist() == [1.0, 0.0, 0.0]


def test_mixing_on_odd_rows(spark):
    docs = odd(spark)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    n = Counter(r.doc_id for r in mixed.collect())
    assert n[0] == 0 and n[1] == 0 and 0 <= n[9] <= 6  # nothing of empty ones
    assert mixing.mix(odd(spark, [])).count() == 0


def test_a_source_of_repeats_comes_near_its_target(spark, tmp_path, monkeypatch):
    """Rows of a repeated document are taken one by one, in pieces of any size."""
    monkeypatch.setattr(mixing, "PIECE", 7)
    rows = [(1, "w " * 10, "a")] * 90 + [(k, "w " * 9, "b") for k in range(2, 90)] + [(None, None, None), (None, "w w", None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, copies string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.op8(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    want = water_level({"a": 900, "b": 792, None: 2}, {"a": 3, "b": 1, None: 2}, 1.5 * 1694)
    for s, t in want.items():
        assert abs(sum(r.taken for r in got if r.source == s) - t) <= 10 and all(r.taken <= 2 * r.size for r in got)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and Counter(r.doc_id for r in mixed.collect()) == Counter({k: n for k in {r.doc_id for r in got} if (n := sum(r.copies for r in got if r.doc_id == k))})


def test_numbered(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(x,) for x in ["b", None, "é", "a", "B", ""]], "source string")
    got = {r.source: r.place for r in mixing.numbered(rows, F.col("source").asc_nulls_last()).collect()}
    assert got == {"": 0, "B": 1, "a": 2, "b": 3, "é": 4, None: 5}
    assert mixing.numbered(rows.limit(0), F.col("source").asc_nulls_last()).count() == 0


def test_the_prior_is_that_of_the_hosts(spark):
    """Many small hosts of one rate have no spread of their own: all are shrunk to it. Hosts that differ keep their rates."""
    rng = np.random.default_rng(0)
    same = [(f"h{k}", bool(x)) for k in range(300) for x in rng.random(5) < 0.3]
    ruled = spark.createDataFrame(same, "source string, rule_failed boolean")
    rates = [r.rate for r in quality_rules.host_verdicts(ruled, "source", 0.5, 0.05).collect()]
    assert max(rates) - min(rates) < 0.2
    apart = [(f"h{k}", j < 20 * (k % 2)) for k in range(20) for j in range(20)]
    rates = {r.host: r.rate for r in quality_rules.host_verdicts(spark.createDataFrame(apart, "source string, rule_failed boolean"), "source", 0.5, 0.05).collect()}
    assert all(abs(v - int(k[1:]) % 2) < 0.03 for k, v in rates.items())
