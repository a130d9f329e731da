"""A fitted reranker: features of a question and a passage, and a linear order learned from graded pairs.

Features are the scores of both arms and their fusion, the share of the question's words, how close these stand in the passage
(the least window with as many of them as it has) and how many of its word pairs stand side by side. The order is logistic
regression on differences within a question: which of two passages has the higher grade.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from groundwell.functions.text import tokens
from groundwell.operators.models import Fits, fit_many
from groundwell.sources.work import saved

FEATURES = ["dense", "sparse", "rrf", "share", "close", "phrases"]
PENALTY = 1.0


def least_window(places: list[np.ndarray]) -> int:
    """The length of the shortest stretch with a place of each list; 0 without lists."""
    if not places:
        return 0
    at = np.concatenate(places)
    owner = np.repeat(np.arange(len(places)), [len(p) for p in places])
    order = np.argsort(at, kind="stable")
    last = np.full(len(places), -1)
    best = 0
    for p, o in zip(at[order].tolist(), owner[order].tolist(), strict=True):
        last[o] = p
        if last.min() >= 0:
            width = p - int(last.min()) + 1
            best = width if not best else min(best, width)
    return best


def proximity(question: list[str], passage: list[str]) -> tuple[float, float, float]:
    """The share of a question's distinct words that a passage has, their number over the least window with all of those, and the share of
    the question's word pairs that stand side by side. 0 where there is nothing to look for."""
    wanted = list(dict.fromkeys(question))
    known = {w: k for k, w in enumerate(wanted)}
    ids = np.array([known.get(w, -1) for w in passage], dtype=np.int64)
    places = [p for k in range(len(wanted)) if len(p := np.flatnonzero(ids == k))]
    window = least_window(places)
    pairs = {(known[a], known[b]) for a, b in zip(question, question[1:], strict=False)}
    found = set(zip(ids[:-1].tolist(), ids[1:].tolist(), strict=True)) & pairs
    return len(places) / len(wanted) if wanted else 0.0, len(places) / window if window and len(places) > 1 else 0.0, len(found) / len(pairs) if pairs else 0.0


@F.arrow_udf(StructType([StructField(c, DoubleType()) for c in ("share", "close", "phrases")]))
def _proximities(questions: pa.Array, passages: pa.Array) -> pa.Array:
    rows = [proximity(q.as_py() or [], p.as_py() or []) for q, p in zip(questions, passages, strict=True)]
    return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.float64()) for k in range(3)], names=["share", "close", "phrases"])


def with_features(fused: DataFrame, question: str, passage: str) -> DataFrame:
    """fused (qid, id, rrf, dense_score, sparse_score, ... and both texts) with FEATURES; what an arm didn't find has 0 there."""
    near = fused.withColumn("_near", _proximities(tokens(F.col(question)), tokens(F.col(passage))))
    zero = lambda c, by=1.0: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * by
    own = {"dense": zero("dense_score"), "sparse": zero("sparse_score", 0.1), "rrf": zero("rrf", 30.0), "share": F.col("_near.share"), "close": F.col("_near.close"), "phrases": F.col("_near.phrases")}
    return near.withColumns({f"f_{k}": v for k, v in own.items()}).drop("_near")


def graded_pairs(graded: DataFrame) -> DataFrame:
    """graded (qid, id, grade, f_...) to rows for fit_many: of each two passages of a question with different grades their difference, both ways
    round. A question's candidates are a short list."""
    a, b = graded.alias("a"), graded.alias("b")
    both = a.join(b, (F.col("a.qid") == F.col("b.qid")) & (F.col("a.grade") > F.col("b.grade")))
    rows = both.select(F.xxhash64("a.qid", "a.id", "b.id").alias("id"), F.explode(F.array(F.lit(1), F.lit(0))).alias("label"), *[(F.col(f"a.f_{f}") - F.col(f"b.f_{f}")).alias(f) for f in FEATURES])
    return rows.select("id", "label", *[F.when(F.col("label") == 1, F.col(f)).otherwise(-F.col(f)).alias(f) for f in FEATURES])


def fit(graded: DataFrame) -> dict[str, float]:
    """What each feature weighs; nothing if no pair of grades differs."""
    pairs = saved(graded_pairs(graded), "pairs")
    if not pairs.limit(1).count():
        return dict.fromkeys(FEATURES, 0.0)
    plain = fit_many(pairs, FEATURES, Fits((PENALTY,), (0,), (-1,)))[1][0]
    return {f: 0.0 if np.isnan(w) else float(w) for f, w in zip(FEATURES, plain[1:], strict=True)}


def score(weights: dict[str, float]) -> Column:
    return F.round(sum((F.lit(w) * F.col(f"f_{f}") for f, w in weights.items()), F.lit(0.0)), 6)
