"""Fingerprints, links and components against brute force."""

import random

import numpy as np
import xxhash

from groundwell.llm import simhash
from groundwell.llm.common import table
from groundwell.llm.components import roots


def groups(n, links):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(k) for k in range(n)]


def by_hand(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(monkeypatch):
    texts = [None, "", " \t", "One", "one TWO", "a b c d a b c", "É é x y", "w " * 3000, " ".join(map(str, range(500)))]
    assert [simhash.fingerprint(t) for t in texts] == [by_hand(t) for t in texts]
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert [simhash.fingerprint(t) for t in texts] == [by_hand(t) for t in texts]


def test_fingerprint_is_spark_hash(spark):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([("a b c",)], "t string").select(F.xxhash64("t").alias("h")).first().h
    assert got & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b c", 42)


def near_table(spark, n=600, seed=5):
    """Fingerprints in balls of a few bits, chains, and single ones."""
    rng = random.Random(seed)
    centre = [rng.getrandbits(64) for _ in range(6)]
    fps = [c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for c in centre for _ in range(n // 8)] + [rng.getrandbits(64) for _ in range(n // 4)]
    chain = rng.getrandbits(64)
    fps += [chain ^ ((1 << k) - 1) for k in range(0, 60, 2)] + [0, 0, 3]
    ids = rng.sample(range(10_000), len(fps))
    return fps, ids, spark.createDataFrame([(i, simhash._long(f)) for i, f in zip(ids, fps, strict=True)], "doc_id long, fp long")


def want_of(fps, ids):
    order = np.argsort(ids)
    f = np.array(fps, dtype=np.uint64)[order]
    links = [(i, j) for i in range(len(f)) for j in np.flatnonzero(np.bitwise_count(f[i] ^ f) <= 2) if j > i]
    return {ids[order[k]]: ids[order[g]] for k, g in enumerate(groups(len(f), links))}


def test_classes_against_brute_force(spark, monkeypatch):
    fps, ids, df = near_table(spark)
    for part in (simhash.CELL_PART, 16):  # whole cells, and cells cut into parts
        monkeypatch.setattr(simhash, "CELL_PART", part)
        comp = {r.fp: r.component_id for r in simhash.near_classes(df).collect()}
        assert {i: comp[simhash._long(f)] for i, f in zip(ids, fps, strict=True)} == want_of(fps, ids)


def test_whole_table(spark, sf_dir):
    rows = simhash.op3(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    fps = [by_hand(texts[r.doc_id]) for r in rows]
    assert [f"{f:016x}" for f in fps] == [r.fingerprint for r in rows]
    want = want_of(fps, [r.doc_id for r in rows])
    assert {r.doc_id: r.component_id for r in rows} == want


def test_odd_rows(spark):
    schema = "doc_id long, text string, fp string, component_id int"
    rows = [(3, None, "x", 1), (2, "", "x", 1), (7, "a b c d", "x", 1), (7, "a b c d", "x", 1), (8, "A b C d", "x", 1), (None, "a b c d", "x", 1), (None, "q r s t u", None, None)]
    docs = spark.createDataFrame(rows, schema)
    comp = sorted(((r.doc_id, r.component_id) for r in simhash.components(docs).collect()), key=str)
    assert comp == sorted([(3, 2), (2, 2), (7, 7), (7, 7), (8, 7), (None, 7), (None, None)], key=str)
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns and sorted((str(r.doc_id) for r in kept.collect())) == ["2", "7", "None"]
    empty = spark.createDataFrame([], schema)
    assert simhash.components(empty).count() == 0 and simhash.near_dedup(empty).count() == 0


def test_one_text_of_each_component_stays(spark):
    """Different texts under a null id or under one id aren't lost, and no copy stays for them."""
    a, b, c, d, e = (" ".join(random.Random(k).choices("abcdefghijklmnopqrstuvwxyz", k=40)) for k in range(5))
    rows = [(1, a), (5, a), (5, b), (5, b), (None, a), (None, c), (None, c), (None, d), (7, e), (None, e), (8, None), (None, "")]
    for n in (len(rows), len(rows) - 1):  # (8, null) with its copy, and alone
        for order in (rows[:n], rows[:n][::-1]):
            kept = simhash.near_dedup(spark.createDataFrame(order, "doc_id long, text string").coalesce(1))
            assert kept.columns == ["doc_id", "text"]
            assert sorted(map(tuple, kept.collect()), key=str) == sorted([(1, a), (5, b), (None, c), (None, d), (7, e), (8, None)], key=str)
    schema = "doc_id long, text string, fp string, component_id int"
    odd = [(3, None, "x", 1), (2, "", "x", 1), (7, "a b c d", "x", 1), (7, "a b c d", "x", 1), (8, "A b C d", "x", 1), (None, "a b c d", "x", 1), (None, "q r s t u", None, None)]
    kept = simhash.near_dedup(spark.createDataFrame(odd, schema)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(2, ""), (7, "a b c d"), (None, "q r s t u")], key=str)


def test_roots(spark):
    rng = random.Random(1)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(k, k + 1) for k in range(500, 600)] + [(700, k) for k in range(701, 800)]
    links = [x for x in links if x[0] != x[1]]
    got = {r.node: r.root for r in roots(spark.createDataFrame(links, "u long, v long")).collect()}
    want = groups(800, links)
    assert all(got.get(k, k) == want[k] for k in range(800))
    assert roots(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_dedup_keeps_columns_of_any_name(spark):
    """Columns that have the names of the stage's own; of rows with one id and text, the one with the least hash of its JSON, whatever their order."""
    rows = [(1, "a b c d", "x", 10, True), (1, "a b c d", "y", 20, False), (2, "a b c d", "z", 30, True), (3, "other words stand in here", "q", 40, None), (None, None, "n", 50, None)]
    kind = "doc_id long, text string, _own string, _stays int, _digest boolean"
    got = [sorted(map(tuple, simhash.near_dedup(spark.createDataFrame(r, kind)).collect()), key=str) for r in (rows, rows[::-1])]
    assert got[0] == got[1] and len(got[0]) == 3 and {r[3] for r in got[0]} >= {40, 50} and {r[0] for r in got[0]} == {1, 3, None}
    assert simhash.near_dedup(spark.createDataFrame(rows, kind)).columns == ["doc_id", "text", "_own", "_stays", "_digest"]
    more = spark.createDataFrame([(*r, k, k, "w") for k, r in enumerate(rows)], kind + ", _id int, row int, _n string")
    assert simhash.near_dedup(more).count() == 3
