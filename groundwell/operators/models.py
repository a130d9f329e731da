"""Many logistic models over the same rows at once: resamples, folds and penalties as weights of one Newton iteration.

A pass over the rows makes, for each model, the sums that its next step needs: a task sends some numbers for each model,
whatever its rows, and the driver solves systems of the size of the features. A model's features are scaled by its own
weights, classes weigh alike, and the intercept isn't penalised.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwell.operators import calibration as cal
from groundwell.operators.ranks import ranked_in
from groundwell.sources.work import saved

# Penalties that are tried, resamples, and what a fit and a calibration need at least.
C_GRID = (0.01, 0.03, 0.1, 0.3, 1.0)
DRAWS, LEAST_DRAWS = 400, 50
LEAST_ROWS, LEAST_GOOD = 8, 2
PER_PREDICTOR, RELIABLE_GOOD = 3.0, 5
CALIBRATE_ROWS, CALIBRATE_GOOD, CALIBRATE_ECE = 40, 10, 0.1
STEPS = 25
#: The law of a row's number in a resample.
POISSON = np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720)])


def uniform(ids: np.ndarray, number: int | np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) that depend on an id and a number alone (splitmix64)."""
    x = ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.atleast_1d(number).astype(np.uint64)[None, :] * np.uint64(0xD1B54A32D192ED03) + np.uint64(0x8CB92BA72F3D8DD7)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    return (x ^ x >> np.uint64(31)).astype(np.float64) / 2.0**64


@dataclass(frozen=True)
class Fits:
    """Models by number: the penalty of each, and its resample (0 for all rows) or the fold that it leaves out (-1 for none)."""

    c: tuple[float, ...]
    draw: tuple[int, ...]
    fold: tuple[int, ...]

    def weights(self, ids: np.ndarray, own: np.ndarray) -> np.ndarray:
        """How often each row is in each model. own: the rows' folds."""
        out = np.ones((len(ids), len(self.c)))
        drawn = np.flatnonzero(self.draw)
        if len(drawn):
            out[:, drawn] = np.searchsorted(POISSON, uniform(ids, np.array(self.draw)[drawn]), side="right")
        return out * (own[:, None] != np.array(self.fold)[None, :])


def with_folds(rows: DataFrame, folds: int) -> DataFrame:
    """Adds fold, dealt within each class in the order of a hash of the id: a class's numbers in the folds differ by one at most.
    Ranks are made in ranges, so no task sees a class whole."""
    ranked = ranked_in(rows.withColumn("_deal", F.xxhash64(F.lit(1 << 40), "id")), "label", "_deal")
    return ranked.withColumn("fold", F.pmod(F.col("rank") - 1, F.lit(folds)).cast("int")).drop("_deal", "rank")


def _sums(rows: DataFrame, features: list[str], width: int, make) -> dict[int, np.ndarray]:
    """make(ids, labels, x, folds) gives a row of `width` sums for each model; their totals by model. Rows without folds are in all models."""
    rows = rows if "fold" in rows.columns else rows.withColumn("fold", F.lit(-2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            x = np.column_stack([b.column(f).to_numpy(zero_copy_only=False).astype(float) for f in features])
            part = make(b.column("id").to_numpy(zero_copy_only=False), b.column("label").to_numpy(zero_copy_only=False).astype(float), x, b.column("fold").to_numpy(zero_copy_only=False))
            total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch({"model": np.arange(len(total)), **{f"s{k}": total[:, k] for k in range(width)}})

    each = rows.select("id", "label", *features, "fold").mapInArrow(run, "model long, " + ", ".join(f"s{k} double" for k in range(width)))
    return {r.model: np.array(r[1:]) for r in each.groupBy("model").agg(*[F.sum(f"s{k}") for k in range(width)]).collect()}


def fit_many(rows: DataFrame, features: list[str], fits: Fits) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """rows (id, label, features): coefficients on scaled features (models x features), and the intercept and coefficients on the features as
    they are (models x 1 + features). A model whose rows are of one class is all NaN; a feature that is constant in a model has coefficient 0."""
    d, n = len(features), len(fits.c)
    moments = _sums(rows, features, 2 + 2 * d, lambda i, y, x, own: np.column_stack([(w := fits.weights(i, own)).sum(axis=0), w.T @ y, w.T @ x, w.T @ (x * x)]))
    m = np.array([moments.get(k, np.zeros(2 + 2 * d)) for k in range(n)])
    total, good = m[:, 0], m[:, 1]
    ok = (good > 0) & (good < total)
    mean = m[:, 2 : 2 + d] / np.maximum(total, 1)[:, None]
    scale = np.sqrt(np.maximum(m[:, 2 + d :] / np.maximum(total, 1)[:, None] - mean**2, 0))
    constant = scale < 1e-12
    scale[constant] = 1.0
    classes = np.column_stack([total / np.maximum(2 * (total - good), 1e-9), total / np.maximum(2 * good, 1e-9)])
    c = np.array(fits.c)
    up = np.triu_indices(d + 1)
    beta = np.zeros((n, d + 1))  # the intercept comes first

    for _ in range(STEPS):
        plain = np.column_stack([beta[:, 0] - (mean / scale * beta[:, 1:]).sum(axis=1), beta[:, 1:] / scale])

        def step(i: np.ndarray, y: np.ndarray, x: np.ndarray, own: np.ndarray, plain=plain) -> np.ndarray:
            one = np.column_stack([np.ones(len(x)), x])
            p = 1 / (1 + np.exp(-np.clip(one @ plain.T, -40, 40)))
            w = fits.weights(i, own) * np.where(y[:, None] > 0, classes[:, 1], classes[:, 0])
            return np.column_stack([(w * (p - y[:, None])).T @ one, (w * p * (1 - p)).T @ (one[:, up[0]] * one[:, up[1]])])

        got = _sums(rows, features, d + 1 + len(up[0]), step)
        move = np.zeros_like(beta)
        for k in np.flatnonzero(ok):
            s = got[k]
            h = np.zeros((d + 1, d + 1))
            h[up] = s[d + 1 :]
            h = h + h.T - np.diag(np.diag(h))
            turn = np.eye(d + 1)  # from features as they are to scaled ones
            turn[1:, 1:] = np.diag(1 / scale[k])
            turn[1:, 0] = -mean[k] / scale[k]
            grad, hess = c[k] * (turn @ s[: d + 1]), c[k] * (turn @ h @ turn.T)
            held = np.concatenate([[True], ~constant[k]])
            pull = np.concatenate([[0.0], beta[k, 1:]])
            move[k, held] = np.linalg.solve((hess + np.diag([1e-12] + [1.0] * d))[np.ix_(held, held)], (grad + pull)[held])
        beta -= move
        if np.abs(move).max() < 1e-9:
            break
    beta[~ok] = np.nan
    plain = np.column_stack([beta[:, 0] - (mean / scale * beta[:, 1:]).sum(axis=1), beta[:, 1:] / scale])
    return beta[:, 1:], plain, beta[:, 0]


def cross_validated(rows: DataFrame, features: list[str], folds: int = 5) -> DataFrame:
    """c, auc and brier over all rows, each judged by the model of its fold's complement."""
    rows = saved(with_folds(rows.select("id", "label", *features), folds), "folds")
    fits = Fits(tuple(x for x in C_GRID for _ in range(folds)), (0,) * (len(C_GRID) * folds), tuple(range(folds)) * len(C_GRID))
    plain = fit_many(rows, features, fits)[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([np.ones(b.num_rows), *[b.column(f).to_numpy(zero_copy_only=False).astype(float) for f in features]])
            own = b.column("fold").to_numpy(zero_copy_only=False)
            for k, c in enumerate(C_GRID):
                p = 1 / (1 + np.exp(-np.clip((x * plain[k * folds + own]).sum(axis=1), -40, 40)))
                yield pa.record_batch({"c": np.full(len(p), c), "label": b.column("label").cast(pa.int64()), "p": np.round(p, 6)})

    judged = saved(rows.select("id", "label", *features, "fold").mapInArrow(run, "c double, label long, p double"), "judged")
    out = None
    for c in C_GRID:
        own = judged.where(F.col("c") == c)
        one = cal.roc_auc(own).select(F.lit(c).alias("c"), "auc").join(own.agg(F.round(F.avg(F.pow(F.col("p") - F.col("label"), 2)), 6).alias("brier")), how="cross")
        out = one if out is None else out.unionByName(one)
    return out


def report(rows: DataFrame, features: list[str]) -> dict:
    """A fit with its choice of c (the best AUC, the least c of equal ones), its calibration error, and whether it may be relied on."""
    n, good = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    out = {"n": n, "positives": good, "predictors": len(features), "degenerate": n < LEAST_ROWS or good < LEAST_GOOD or good == n, "c": None, "auc": None, "brier": None, "ece": None, "calibrate": False, "reliable": False}
    if out["degenerate"]:
        return out
    folds = max(2, min(5, good, n - good))
    tried = [r for r in cross_validated(rows, features, folds).collect() if r.auc is not None]
    best = max(tried, key=lambda r: (r.auc, -r.c), default=None)
    out |= {"c": best.c, "auc": best.auc, "brier": best.brier} if best else {"c": C_GRID[2]}
    plain = fit_many(rows, features, Fits((out["c"],), (0,), (-1,)))[1][0]
    z = F.lit(float(plain[0])) + sum(F.lit(float(b)) * F.col(f) for f, b in zip(features, plain[1:], strict=True))
    out["ece"] = cal.calibration_error(rows.select("label", (1 / (1 + F.exp(-z))).alias("p"))).first().ece
    out["calibrate"] = n >= CALIBRATE_ROWS and good >= CALIBRATE_GOOD and out["ece"] > CALIBRATE_ECE
    out["reliable"] = n / len(features) >= PER_PREDICTOR and good >= RELIABLE_GOOD
    return out


def intervals(rows: DataFrame, features: list[str], c: float, draws: int = DRAWS) -> DataFrame:
    """feature, coefficient (on scaled features), low and high of 95 % of the resamples, and whether the interval leaves out 0. Null bounds under LEAST_DRAWS draws with both classes."""
    own = fit_many(rows, features, Fits((c,), (0,), (-1,)))[0][0]
    many = fit_many(rows, features, Fits((c,) * draws, tuple(range(1, draws + 1)), (-1,) * draws))[0]
    many = many[~np.isnan(many).any(axis=1)]
    some = len(many) >= LEAST_DRAWS
    low, high = (np.percentile(many, q, axis=0) if some else np.full(len(features), np.nan) for q in (2.5, 97.5))
    number = lambda x: None if np.isnan(x) else round(float(x), 6)
    data = [(f, number(b), number(x), number(y), bool(x > 0 or y < 0), len(many)) for f, b, x, y in zip(features, own, low, high, strict=True)]
    return rows.sparkSession.createDataFrame(data, "feature string, coefficient double, low double, high double, significant boolean, draws long")
