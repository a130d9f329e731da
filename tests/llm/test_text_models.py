"""Language ID, BPE, toxicity and importance resampling."""

import hashlib
import math
import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer as Library

from groundwell.llm import bpe, importance, langid, toxicity
from groundwell.llm.common import table

ODD = [(1, None, "en", 1), (2, "", "en", 1), (3, " 12 --- \n", None, None), (4, "a", "xx", 7), (5, "the and of " * 90_000, "en", 2), (5, "the and of " * 90_000, "en", 2), (None, "une é ü", None, None)]
SCHEMA = "doc_id long, text string, lang string, p int"


@pytest.fixture(scope="module")
def tokenizer():
    with open(bpe.default_vocabulary(), encoding="utf-8") as f:
        return bpe.Tokenizer(f.read()), Library.from_file(bpe.default_vocabulary())


def ids_of(library, text):
    return library.encode(text, add_special_tokens=False).ids


def test_bpe_against_the_library(tokenizer, spark, sf_dir):
    own, library = tokenizer
    rng = random.Random(1)
    pool = [chr(c) for c in [*range(0x250), 0x85, 0xA0, 0x2003, 0x3000, 0x4E2D, 0x1F600, 0x301, 0x661]] + [" "] * 60 + ["<|endoftext|>", "'s", "'ll", "the", "ing"] * 5
    texts = ["", "a" * 3000 + "ab" * 2000, "<|endoftext|><|endoftext|> x", *["".join(rng.choices(pool, k=rng.randrange(40))) for _ in range(1500)]]
    texts += [r.text or "" for r in table(spark, sf_dir, "documents").collect()]
    for t in texts:
        ids = own.encode(t).tolist()
        assert ids == ids_of(library, t)
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False) == t
    assert own.encode(None).tolist() == []


def test_bpe_tokens_encode_themselves(tokenizer):
    own, _ = tokenizer
    assert all(own.encode_piece(own.token[k]) == (k,) for k in range(0, 50_256, 7))


def test_compatible_pairs_by_merging(tokenizer):
    own, _ = tokenizer
    rank = {pair: k for k, pair in enumerate(own.merged)}

    def merged(parts):
        while True:
            best = min(((rank.get(p, math.inf), i) for i, p in enumerate(zip(parts, parts[1:], strict=False))), default=(math.inf, 0))
            if best[0] == math.inf:
                return parts
            i = best[1]
            parts = [*parts[:i], own.merged[parts[i], parts[i + 1]], *parts[i + 2 :]]

    rng = random.Random(2)
    for _ in range(1500):
        a, b = rng.randrange(50_256), rng.randrange(3000)
        parts = [own.by_bytes[bytes([x])] for x in own.token[a] + own.token[b]]
        assert own.compatible(a, b) == (merged(parts) == [a, b])


def test_bpe_blocks(tokenizer, monkeypatch):
    own, library = tokenizer
    text = "the quick brown fox, 123 !!  jumps\n\n over" * 40
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 100)
    monkeypatch.setattr(bpe, "BLOCK_PIECES", 7)
    assert own.encode(text).tolist() == ids_of(library, text)


def test_op4_and_odd_rows(spark, sf_dir, tokenizer):
    _, library = tokenizer
    texts = {r.doc_id: r.text or "" for r in table(spark, sf_dir, "documents").collect()}
    for r in bpe.op4(spark, sf_dir).collect():
        ids = ids_of(library, texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
    docs = spark.createDataFrame(ODD, SCHEMA).withColumn("ids", F.lit("clash"))
    got = bpe.encode_documents(docs).collect()
    assert sorted(r.n_tokens for r in got) == sorted(len(ids_of(library, t or "")) for _, t, _, _ in ODD)
    assert bpe.encode_documents(docs.limit(0)).count() == 0
    v = bpe.shared_vocabulary(spark, bpe.default_vocabulary())
    both = docs.select("text", bpe.encoded_checked(F.col("text"), v).alias("t"), bpe.decoded(bpe.encoded(F.col("text"), v), v).alias("back")).collect()
    assert all(r.t.round_trip and r.back == (r.text or "") for r in both)


def test_language_held_out(spark, sf_dir):
    got = langid.op1(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").where("lang is not null").collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 20 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_language_scores_by_plain_python(spark, sf_dir):
    """The query's languages and scores by a kernel over sets of n-grams, Nystrom features and ridge regression written out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").collect()
    got = {r.doc_id: r for r in langid.op1(spark, sf_dir).collect()}

    def grams(t):
        t = "".join(c.lower()[0] if c.isalpha() else " " for c in t)
        return {place(t[i : i + n]) for n in range(1, 5) for i in range(len(t) - n + 1)}

    def place(g):
        h = 0
        for n, c in enumerate(g):
            h = ((h + ord(c)) * 2654435761 + n + 1) % 2**32
        return ((h ^ h >> 15) * 2246822519 % 2**32) >> 17

    # under SAMPLE rows of a language all of them are learned from
    sample = [r for r in docs if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and any(c.isalpha() for c in r.text)]
    sample.sort(key=lambda r: (zlib.crc32(f"5/{r.doc_id}".encode()), r.doc_id))
    names = sorted({r.lang for r in sample})
    sets = [grams(r.text) for r in sample]
    marks = [s for n in names for s in [g for g, r in zip(sets, sample, strict=True) if r.lang == n][: langid.LANDMARKS]]
    kernel = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b))
    inner = np.array([[kernel(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(inner)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = np.array([[kernel(a, b) for b in marks] for a in sets]) @ root
    weight = np.array([1 / sum(x.lang == r.lang for x in sample) for r in sample])
    target = np.array([[1.0 if r.lang == n else -1.0 for n in names] for r in sample])
    coef = np.linalg.solve(phi.T @ (weight[:, None] * phi) + langid.RIDGE * np.eye(phi.shape[1]), phi.T @ (weight[:, None] * target))
    for r in docs[:60]:
        if not any(c.isalpha() for c in r.text or ""):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0)
            continue
        f = np.array([kernel(grams(r.text), b) for b in marks]) @ root @ coef
        e = np.exp(langid.SHARPNESS * (f - f.max()))
        assert got[r.doc_id].lang_pred == names[int(f.argmax())] and got[r.doc_id].score == pytest.approx(e.max() / e.sum(), abs=1e-3)


def test_equal_language_scores_go_to_the_first():
    bits = [np.packbits(np.eye(1, langid.PLACES, 7, dtype=np.uint8)[0]).tobytes()] * 4
    names, matrix, _ = langid.fit(bits, ["b", "a", "a", "b"])
    assert names == ["a", "b"] and matrix[7, 0] == pytest.approx(matrix[7, 1], abs=1e-6)


def test_the_sample_is_bounded(spark):
    from groundwell.llm.common import hash_sample

    rows = spark.range(4000).select("id", (F.col("id") % 2).alias("y"))
    got = [r.id for r in hash_sample(rows, ["y"], 100, F.col("id"), 1).collect()]
    assert 120 < len(got) < 280 and got == [r.id for r in hash_sample(rows, ["y"], 100, F.col("id"), 1).collect()]
    same = rows.withColumn("k", F.lit(1))  # all hashes fall alike
    assert hash_sample(same, ["y"], 100, F.col("k"), 1).count() <= 800
    many = rows.select("id", F.when(F.col("id") < 3000, F.col("id") % 1500).otherwise(0).alias("y"))  # of 1,500 labels the largest, then the first
    assert {r.y for r in hash_sample(many, ["y"], 2, F.col("id"), 1).collect()} <= set(range(1000))


def test_presence_kernel_by_hand():
    def row(t):
        x = np.zeros(langid.PLACES)
        langid.mark_presence(t, x)
        return x

    def grams(t):
        t = "".join(c.lower() if c.isalpha() else " " for c in t)
        return {t[i : i + n] for n in range(1, 5) for i in range(len(t) - n + 1)}

    a, b = "The cat, Émile!", "the hat é"
    assert row(a).sum() == len(grams(a)) and row(a) @ row(b) == len(grams(a) & grams(b))
    assert not langid.mark_presence("12 !", np.zeros(langid.PLACES)) and langid.mark_presence("\U0001d400", np.zeros(langid.PLACES))


def test_presence_in_blocks(monkeypatch):
    text = "Der schnelle Fuchs, überall " * 20
    whole, cut = np.zeros(langid.PLACES), np.zeros(langid.PLACES)
    langid.mark_presence(text, whole)
    monkeypatch.setattr(langid, "BLOCK", 17)
    langid.mark_presence(text, cut)
    assert (whole == cut).all()


def test_language_odd_rows(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    kept = langid.language_filter(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) in (["4", "5", "5", "None"], ["5", "5", "None"])
    assert langid.language_filter(docs.limit(0)).count() == 0
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert langid.learn(none)[0] == [] and langid.language_filter(none).count() == 0


@pytest.mark.parametrize("learned", [["en"], ["de", "en"], ["de", "en", "fr"], ["de", "en", "es", "fr"]])
def test_language_filter_rejects(spark, sf_dir, learned):
    """Gibberish and a language that wasn't learned go, however many languages were; clean documents stay."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").where(F.col("lang").isin(learned))
    rng = random.Random(3)
    gibberish = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(n)) for n in (20, 50, 200, 1000)]
    foreign = [
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
    ]
    odd = spark.createDataFrame([(-1 - k, t, None) for k, t in enumerate(gibberish + foreign)], "doc_id long, text string, lang string")
    kept = [r.doc_id for r in langid.language_filter(docs.unionByName(odd)).collect()]
    assert min(kept) >= 0
    clean = {r.doc_id for r in docs.where("size(split(text, ' ')) >= 20").collect()}
    held = {k for k in clean if zlib.crc32(str(k).encode()) % 4 == 2}
    assert len(held) > 15 and len(held & set(kept)) >= 0.95 * len(held)


def test_gradients():
    net = toxicity.Network({b"a": 1.0, b"b": 0.0, b"c": 2.0})
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    words, windows, y = [None, b"a", b"b", b"dd", b"eee"], rng.integers(0, 5, (4, toxicity.SPAN)), np.array([0.0, 1, 1, 0])

    def loss():
        z = net.logits(net.project(net.inputs(net.known(words))), windows)
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    grad = net.gradients(net.known(words), windows, y)
    for name, at in (("word", (2, 1)), ("wx", (1, 3, 5)), ("u", (0, 2, 9)), ("att", (4,)), ("out", (1,)), ("bias", (0,)), ("bx", (1, 0, 3))):
        old, eps = net.p[name][at], 1e-3
        net.p[name][at] = old + eps
        up = loss()
        net.p[name][at] = old - eps
        down = loss()
        net.p[name][at] = old
        assert grad[name][at] == pytest.approx((up - down) / (2 * eps), rel=0.02, abs=1e-5)


def plain_windows(words):
    """All windows of a text: at every STRIDE-th word, and one that ends with the last."""
    n = len(words)
    if n <= toxicity.SPAN:
        return [words]
    at = list(range(0, n - toxicity.SPAN + 1, toxicity.STRIDE))
    at += [n - toxicity.SPAN] if at[-1] != n - toxicity.SPAN else []
    return [words[a : a + toxicity.SPAN] for a in at]


@pytest.mark.parametrize("block", [1, 5, 40, 77, 100, 1000, 400_000])
def test_windows_are_those_of_the_whole_text(monkeypatch, block):
    monkeypatch.setattr(toxicity, "BLOCK_BYTES", block)
    for n in (0, 1, 23, 24, 25, 39, 40, 41, 48, 56, 57, 199, 500):
        words = [f"w{k}".encode() for k in range(n)]
        for text in (b" ".join(words), b" \n" + b"\t ".join(words) + b" " * 150):
            got = [held[a : a + toxicity.SPAN] for held, starts in toxicity.window_blocks(text.decode()) for a in starts]
            assert got == plain_windows(words)
    assert [(w, list(a)) for w, a in toxicity.window_blocks(None)] == [([], [0])]


def plain_score(net, text):
    """The network by its formulas, one word after another."""
    p = {k: v.astype(float) for k, v in net.p.items()}
    h = toxicity.HIDDEN
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def vector(w):
        if w is None:
            word, w = p["word"][0], b""
        else:
            w = bytes(b + 32 if 65 <= b <= 90 else b for b in w if b >= 128 or chr(b).isalpha())
            word = p["word"][net.rows.get(w, 1)]
        m = b"^" + w + b"$" if w else b"^$$"
        places = [((m[i] * 961 + m[i + 1] * 31 + m[i + 2]) * 2654435761 % 2**32) >> 21 for i in range(len(m) - 2)]
        return np.concatenate([word, np.mean([p["char"][k] for k in places], axis=0)])

    def run(xs, k):
        s, out = np.zeros(h), []
        for x in xs:
            g, a = x @ p["wx"][k] + p["bx"][k][0], s @ p["u"][k]
            z, r = sigmoid(g[:h] + a[:h]), sigmoid(g[h : 2 * h] + a[h : 2 * h])
            n = np.tanh(g[2 * h :] + r * a[2 * h :])
            s = (1 - z) * n + z * s
            out.append(s)
        return out

    best = -np.inf
    for window in plain_windows((text or "").encode().split()):
        xs = [vector(w) for w in [*window, *[None] * (toxicity.SPAN - len(window))]]
        both = np.array([np.concatenate([a, b]) for a, b in zip(run(xs, 0), run(xs[::-1], 1)[::-1], strict=True)])
        e = np.exp(both @ p["att"])
        best = max(best, (e / e.sum()) @ both @ p["out"] + p["bias"][0])
    return sigmoid(best)


def test_op6_against_plain_python(spark, sf_dir):
    """The whole query: every score by an independent forward pass, the split, the verdicts, and held-out accuracy."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    got = {r.doc_id: r for r in toxicity.op6(spark, sf_dir).collect()}
    net = toxicity.learn(docs, labels)  # training doesn't depend on the run
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(got) == set(texts)
    for k, r in got.items():
        assert r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7)
    for k in sorted(texts, key=lambda k: len(texts[k] or ""))[:: max(1, len(texts) // 60)] + [max(texts, key=lambda k: len(texts[k] or ""))]:
        assert got[k].score == pytest.approx(plain_score(net, texts[k]), abs=2e-4)
    # the smallest tables have six toxic documents to learn from; other words than theirs can't be known
    held = [(got[r.doc_id].predicted, r.toxic) for r in labels.collect() if r.doc_id in got and got[r.doc_id].held_out]
    assert len(held) > 10 and not any(a > b for a, b in held) and sum(a == b for a, b in held) >= 0.8 * len(held)


def test_op6_odd_rows(spark, tmp_path):
    bad = "zorgak vixtum krelb"
    rows = [(k, " ".join(random.Random(k).choices(["ba", "no", "tire", "lusha", "re"], k=40)) + (f" {bad}" if k % 3 == 0 else "")) for k in range(200)]
    odd = [(300, None), (301, ""), (302, " \n "), (303, "x" * 100_000), (304, "no " * 30_000 + bad + " no" * 30_000), (5, rows[5][1]), (5, rows[5][1]), (None, rows[3][1])]
    schema = "doc_id long, text string, score string, toxic string"
    spark.createDataFrame([(*r, "x", "y") for r in rows + odd], schema).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([(k, int(k % 3 == 0), 1) for k in range(200)] + [(None, 1, 1), (7, None, 1)], "doc_id long, toxic int, score int").write.parquet(f"{tmp_path}/a/labels.parquet")
    got = toxicity.op6(spark, f"{tmp_path}/a").collect()
    assert len(got) == 208 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[300].score == by[301].score == by[302].score and not by[300].predicted and by[304].predicted and by[None].predicted and not by[None].held_out
    assert len({r.score for r in got if r.doc_id == 5}) == 1
    net = toxicity.learn(*[spark.read.parquet(f"{tmp_path}/a/{n}.parquet") for n in ("documents", "labels")])
    assert by[304].score == pytest.approx(plain_score(net, "no " * 64 + bad + " no" * 61), abs=2e-4)
    empty = spark.createDataFrame([], schema)
    empty.write.parquet(f"{tmp_path}/b/documents.parquet")
    spark.read.parquet(f"{tmp_path}/a/labels.parquet").write.parquet(f"{tmp_path}/b/labels.parquet")
    assert toxicity.op6(spark, f"{tmp_path}/b").count() == 0
    assert spark.createDataFrame([(0.7,), (0.6999,)], "score double").select(toxicity.verdict(F.col("score")).alias("p")).collect() == [(1,), (0,)]


def test_toxic_words_are_found(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices(["ba", "no", "ti", "re", "lu", "sha"], k=rng.randint(1, 3)))
    bad = ["zorgak", "vixtum", "krelb"]
    rows = []
    for k in range(400):
        w = [word() for _ in range(rng.choice([5, 40, 150]))]
        if k % 3 == 0:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((k, " ".join(w), int(k % 3 == 0)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, None), (1001, ""), (1002, " \n ")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5000, 1)], "doc_id long, toxic int")
    net = toxicity.learn(docs, labels)
    got = {r.doc_id: r.s for r in docs.select("doc_id", toxicity.toxicity(F.col("text"), spark, net).alias("s")).collect()}
    right = [(got[i] >= toxicity.THRESHOLD) == bool(y) for i, _, y in rows]
    assert sum(right) / len(right) > 0.95
    assert got[1000] == got[1001] == got[1002] < 0.7
    assert toxicity.learn(docs, labels.where("toxic = 0")) is None
    assert docs.select(toxicity.toxicity(F.col("text"), spark, None).alias("s")).first().s == 0.0


def test_kth_largest(spark, monkeypatch):
    monkeypatch.setattr(importance, "FEW", 5)
    rng = random.Random(4)
    x = [rng.gauss(0, 5) for _ in range(500)] + [1.5] * 40
    keys = spark.createDataFrame([(v,) for v in x], "key double")
    for k in (1, 7, 250, 270, 539, 540):
        assert importance.kth_largest(keys, k) == sorted(x, reverse=True)[k - 1]


def test_importance_by_hand(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    raw, target, weight = np.zeros(importance.PLACES), np.zeros(importance.PLACES), {}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for i, t in texts.items():
        for p in importance.places(t):
            np.add.at(raw, p, 1)
            if i in good:
                np.add.at(target, p, 1)
    ratio = np.log((target + 1) / (target.sum() + importance.PLACES)) - np.log((raw + 1) / (raw.sum() + importance.PLACES))
    rows = importance.resample(docs, labels).collect()
    for r in rows:
        assert r.log_weight == pytest.approx(sum(ratio[p].sum() for p in importance.places(texts[r.doc_id])), abs=1e-6)
    share = labels.where("quality = 1").count() / labels.where("quality in (0, 1)").count()
    assert sum(r.kept for r in rows) == round(share * len(rows))
    assert min(r.key for r in rows if r.kept) >= max(r.key for r in rows if not r.kept)


def test_importance_odd_rows(spark, monkeypatch):
    docs = spark.createDataFrame(ODD, SCHEMA)
    labels = spark.createDataFrame([(5, 1), (5, 1), (4, 0), (None, 1)], "doc_id long, quality int")
    got = importance.resample(docs, labels).collect()
    assert len(got) == len(ODD) and not any(r.kept for r in got if r.doc_id in (1, 2))
    assert importance.resample(docs.limit(0), labels).count() == 0
    assert all(r.kept == (r.log_weight is not None) for r in importance.resample(docs, labels.limit(0)).collect())
    whole = [p.tolist() for p in importance.places("a b c d e")]
    monkeypatch.setattr(importance, "BLOCK", 3)
    parts = [p.tolist() for p in importance.places("a b c d e")]
    assert sorted(sum(whole, [])) == sorted(sum(parts, []))


def test_texts_without_blanks_are_trained_on(spark):
    """A word over LONG bytes goes to the driver as PLACES of its trigrams, and counts as an unknown word."""
    word = ("坏话" * 200).encode()
    short = toxicity.shortened(word)
    assert len(short) == 1 + 2 * toxicity.PLACES and toxicity.shortened(b"brief") == b"brief"
    whole, some = set(toxicity.trigrams([word])[0].tolist()), toxicity.trigrams([b"ab", short, b""])
    assert some[1].tolist() == [2, toxicity.PLACES, 1] and set(some[0][2:-1].tolist()) <= whole
    got = list(toxicity._ranked(None, {})(iter([pd.DataFrame({"text": ["坏话" * 200, "ok then"], "toxic": [1, 0]})])))
    assert [len(g) for g in got] == [1, 1] and got[0].words[0] == [short]
    docs = spark.createDataFrame([(i, ("坏话" if i % 2 else "好事") * 60 + str(i)) for i in range(120)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, toxic int")
    net = toxicity.learn(docs, labels)
    scores = toxicity.Scorer(net).scores(pa.array(["坏话" * 80, "好事" * 80]))
    assert scores[0] > 0.7 > scores[1]
