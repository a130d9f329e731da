"""Queries that have no SQL, against plain Python over the same tables. A test has the name of its query."""

import json
import math
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundwell.functions import text as t
from groundwell.operators import calibration as cal
from groundwell.operators import models
from groundwell.plans import calibration as plans
from groundwell.queries import QUERIES
from groundwell.sources.tables import read


@pytest.fixture(scope="module")
def sample(spark, sf_dir):
    return [r.asDict() for r in plans.sample(spark, sf_dir).collect()]


def windows_by_hand(text, size, overlap):
    """Chunks by walking through the sentences and looking back over each window."""
    text = " ".join((text or "").split())
    if len(text) <= size:
        return [text] if text else []
    parts = [s.strip() for s in re.split(r"(?<=[.!?])\s+(?=[A-Z(\"'\[])", text) if s.strip()]
    out, window = [], []
    for s in [*parts, None]:
        full = s is None or len(s) > size or sum(len(x) + 1 for x in window) + len(s) + 1 > size
        if window and full:
            out.append(" ".join(window))
            keep = 0
            while s and len(s) <= size and keep < len(window) and len(" ".join(window[len(window) - keep - 1 :])) <= overlap:
                keep += 1
            window = window[len(window) - keep :]
        if s and len(s) > size:
            out += [s[at : at + size] for at in range(0, len(s), size - overlap)]
        elif s:
            window.append(s)
    return out


def test_web_chunks(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", t.html_text(F.col("html")).alias("body")).collect()
    got = defaultdict(list)
    for r in QUERIES["web_chunks"](spark, sf_dir).orderBy("page_id", "index").collect():
        got[r.page_id].append(r.chars)
    for p in pages:
        want = [p.body] if len(p.body) <= 800 else list(dict.fromkeys(windows_by_hand(p.body, 800, 150)))
        assert got[p.page_id] == [len(x) for x in want]


def test_section_aware_chunks(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").where(F.length(F.trim("text")) >= 500)
    sections = t.with_sections(docs, "text", ["doc_id"]).orderBy("doc_id", "at").collect()
    want, seen = defaultdict(list), set()
    for s in sections:
        for x in windows_by_hand(s.body, 1000, 150):
            if (s.doc_id, s.section, x) not in seen:
                seen.add((s.doc_id, s.section, x))
                want[s.doc_id].append((s.section, len(x)))
    got = defaultdict(list)
    for r in QUERIES["section_aware_chunks"](spark, sf_dir).orderBy("doc_id", "index").collect():
        assert r["index"] == len(got[r.doc_id])
        got[r.doc_id].append((r.section, r.chars))
    assert got == want and len(want) > 50


def test_sentence_segments(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").where("role = 'assistant'").collect()
    want = set()
    for r in turns:
        parts = [" ".join(s.split()) for s in re.split(r"(?<=[.!?])\s+(?=[A-Z(\"'\[])", r.text or "")]
        want |= {(r.conv_id, r.turn, k, len(s), 0, len(s) >= 25) for k, s in enumerate([s for s in parts if s])}
    assert {tuple(r) for r in QUERIES["sentence_segments"](spark, sf_dir).collect()} == want and want


def test_json_repair(spark, sf_dir):
    got = {r.event_id: r for r in QUERIES["json_repair"](spark, sf_dir).collect()}
    for r in read(spark, sf_dir, "events").collect():
        assert got[r.event_id].k == json.loads(r.props)["k"] and got[r.event_id].same


def test_bootstrap_ci(spark, sf_dir, sample):
    rows = spark.createDataFrame([(r["id"], d) for r in sample for d in range(1, 1001)], "id long, draw int").select("id", "draw", cal.resample_weight("id", "draw", seed=3).alias("w"))
    weight = {(r.id, r.draw): r.w for r in rows.collect()}
    values = {"rate": lambda r: r["label"], "brier": lambda r: (r["p"] - r["label"]) ** 2, "accuracy": lambda r: int((r["p"] >= 0.5) == r["label"])}
    got = {r.metric: r for r in QUERIES["bootstrap_ci"](spark, sf_dir).collect()}
    for name, value in values.items():
        x = [sum(weight[r["id"], d] * value(r) for r in sample) / sum(weight[r["id"], d] for r in sample) for d in range(1, 1001)]
        assert (got[name].low, got[name].high, got[name].draws) == pytest.approx((*np.percentile(x, [2.5, 97.5]), 1000), abs=2e-6)
        assert got[name].low < sum(map(value, sample)) / len(sample) < got[name].high


def newton(x, y, w, c):
    """Balanced, scaled, L2 logistic regression with row weights, written out."""
    mean = np.average(x, axis=0, weights=w)
    scale = np.sqrt(np.average((x - mean) ** 2, axis=0, weights=w))
    z = np.column_stack([np.ones(len(x)), (x - mean) / np.where(scale > 1e-12, scale, 1)])
    v = w * np.where(y > 0, w.sum() / (2 * (w * y).sum()), w.sum() / (2 * (w * (1 - y)).sum()))
    beta = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ beta))
        pen = np.array([0.0] + [1.0] * x.shape[1])
        beta -= np.linalg.solve((z * (c * v * p * (1 - p))[:, None]).T @ z + np.diag(pen + 1e-12), c * z.T @ (v * (p - y)) + pen * beta)
    return beta[1:], np.concatenate([[beta[0] - (mean / np.where(scale > 1e-12, scale, 1)) @ beta[1:]], beta[1:] / np.where(scale > 1e-12, scale, 1)])


def arrays(sample):
    return np.array([r["id"] for r in sample]), np.array([[float(r[f]) for f in plans.FEATURES] for r in sample]), np.array([float(r["label"]) for r in sample])


def test_logistic_fit(spark, sf_dir, sample):
    _, x, y = arrays(sample)
    got = {r.feature: r.coefficient for r in QUERIES["logistic_fit"](spark, sf_dir).collect()}
    assert [got[f] for f in plans.FEATURES] == pytest.approx(newton(x, y, np.ones(len(y)), 1.0)[0], abs=1e-3)


def test_coefficient_ci(spark, sf_dir, sample):
    ids, x, y = arrays(sample)
    draws = range(1, models.DRAWS + 1)
    w = models.Fits((1.0,) * models.DRAWS, tuple(draws), (-1,) * models.DRAWS).weights(ids, np.full(len(ids), -2))
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.1
    many = np.array([newton(x, y, w[:, k], 1.0)[0] for k in range(models.DRAWS) if 0 < w[:, k] @ y < w[:, k].sum()])
    got = {r.feature: r for r in QUERIES["coefficient_ci"](spark, sf_dir).collect()}
    for k, f in enumerate(plans.FEATURES):
        assert got[f].coefficient == pytest.approx(newton(x, y, np.ones(len(y)), 1.0)[0][k], abs=1e-5)
        assert (got[f].low, got[f].high) == pytest.approx(tuple(np.percentile(many[:, k], [2.5, 97.5])), abs=1e-4)
        assert got[f].significant == (got[f].low > 0 or got[f].high < 0)


def test_cv_scores(spark, sf_dir, sample):
    ids, x, y = arrays(sample)
    dealt = {r.id: r.fold for r in models.with_folds(plans.sample(spark, sf_dir), 5).collect()}
    fold = np.array([dealt[i] for i in ids])
    got = {r.c: r for r in QUERIES["cv_scores"](spark, sf_dir).collect()}
    for c in models.C_GRID:
        p = np.zeros(len(y))
        for f in range(5):
            b = newton(x[fold != f], y[fold != f], np.ones((fold != f).sum()), c)[1]
            p[fold == f] = np.round(1 / (1 + np.exp(-(b[0] + x[fold == f] @ b[1:]))), 6)
        wins = sum((a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0])
        assert (got[c].auc, got[c].brier) == pytest.approx((wins / (y.sum() * (len(y) - y.sum())), np.mean((p - y) ** 2)), abs=1e-4)


def test_model_report(spark, sf_dir, sample):
    r = QUERIES["model_report"](spark, sf_dir).first()
    tried = {x.c: x for x in QUERIES["cv_scores"](spark, sf_dir).collect()}
    best = max(tried.values(), key=lambda x: (x.auc, -x.c))
    assert (r.n, r.positives, r.predictors, r.degenerate) == (len(sample), sum(x["label"] for x in sample), 3, False)
    assert (r.c, r.auc, r.brier) == (best.c, best.auc, best.brier) and r.reliable and r.calibrate == (r.ece > 0.1)
    few = spark.createDataFrame([(k, 0, 1.0 * k) for k in range(20)], "id long, label int, x double")
    assert models.report(few, ["x"])["degenerate"] and not models.report(few, ["x"])["reliable"]


def test_isotonic_fit(spark, sf_dir, sample):
    """Pools of neighbours that break the order, by hand."""
    by = defaultdict(list)
    for r in sample:
        by[r["p"]].append(r["label"])
    pools = []
    for p in sorted(by):
        pools.append([sum(by[p]), len(by[p]), [p]])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            s, n, ps = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, pools[-1][2] + ps]
    want = {p: s / n for s, n, ps in pools for p in ps}
    got = QUERIES["isotonic_fit"](spark, sf_dir).orderBy("boundary").collect()
    assert all(r.value == pytest.approx(want[r.boundary], abs=1e-9) for r in got)
    assert {r.boundary for r in got} >= {ps[0] for _, _, ps in pools} and math.isclose(got[-1].boundary, max(by))


def test_folds_are_dealt_within_classes(spark):
    rows = spark.range(10_000).select("id", (F.col("id") % 1429 == 0).cast("int").alias("label"))
    n = models.with_folds(rows, 5).groupBy("label", "fold").count().collect()
    for label in (0, 1):
        counts = [r["count"] for r in n if r.label == label]
        assert len(counts) == 5 and max(counts) - min(counts) <= 1
    assert sum(r["count"] for r in n if r.label == 1) == 7


def test_short_and_repeated_papers(spark, tmp_path):
    para = "One sentence of this paper is here. " * 20
    rows = [(1, "Too short.", "en", "a"), (2, para, "en", "a"), (3, "1 Introduction\n" + para + "\n1 Introduction\n" + para, "en", "a"), (4, None, "en", "a")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["section_aware_chunks"](spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {2, 3}
    assert len(got) == len({(r.doc_id, r.id) for r in got}) and all(sorted(r["index"] for r in got if r.doc_id == d) == list(range(sum(r.doc_id == d for r in got))) for d in (2, 3))
