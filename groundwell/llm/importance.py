"""Quality classifier by importance resampling: the ratio of two hashed n-gram models, sampled by Gumbel top-k.

The raw model counts the hashed words and word pairs of all documents, the target model those of documents labelled
quality = 1. A document's log weight is the sum, over its n-grams, of the log ratio of target to raw. With Gumbel noise
from a hash of its id added, the k highest keys are a sample without replacement by weight. k is the share of target rows
among the labelled ones, of all documents. Counts are summed in each task before they're shuffled, and the k-th key is
found by counting keys in ever narrower ranges; no task sees all keys.

Defined cases: a null text or one without words has a null weight and is never kept; keys equal to the k-th are all kept;
repeated rows have one key; rows without an id share one noise value; without labels the models are equal and the share is 1, so that all with words are kept; an
empty table gives an empty result; other columns aren't looked at. Texts are read in blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import hash_share, join_small, saved, table

PLACES = 10_000
BLOCK = 1 << 22
SMOOTH = 1.0
BINS = 1024
FEW = 10_000


def places(text: str | None) -> Iterator[np.ndarray]:
    """The hashed places of all words and of all pairs of neighbours, block by block."""
    raw, at, last = (text or "").encode().lower(), 0, None
    while at < len(raw):
        end = at + BLOCK
        while end < len(raw) and raw[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        h = np.array([zlib.crc32(w) for w in raw[at:end].split()], dtype=np.uint64)
        at = end
        if len(h):
            yield (h % PLACES).astype(np.int64)
            both = h if last is None else np.concatenate([[last], h])
            yield ((both[:-1] * np.uint64(1_000_003) + both[1:]) % PLACES).astype(np.int64)
            last = h[-1]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(PLACES, np.int64), np.zeros(PLACES, np.int64)
    for b in batches:
        for text, good in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            for p in places(text.as_py()):
                n = np.bincount(p, minlength=PLACES)
                raw += n
                if good:
                    target += n
    some = np.flatnonzero(raw)
    yield pa.record_batch({"place": some, "raw": raw[some], "target": target[some]})


def log_ratio(docs: DataFrame, good: DataFrame) -> np.ndarray:
    """The log of target over raw for each place. good: doc_id of the target documents, each once."""
    good = good.select(F.col("doc_id").alias("_good"))
    both = join_small(docs.select("doc_id", "text"), good, F.col("doc_id") == F.col("_good")).select("text", F.col("_good").isNotNull().alias("good"))
    sums = both.mapInArrow(_counted, "place long, raw long, target long").groupBy("place").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(PLACES), np.zeros(PLACES)
    for r in sums.collect():  # PLACES rows at most
        raw[r.place], target[r.place] = r.raw, r.target
    if not target.sum():
        return np.zeros(PLACES)
    return np.log((target + SMOOTH) / (target.sum() + SMOOTH * PLACES)) - np.log((raw + SMOOTH) / (raw.sum() + SMOOTH * PLACES))


def log_weight(text: Column, spark: SparkSession, ratio: np.ndarray) -> Column:
    shared = spark.sparkContext.broadcast(ratio)

    @F.arrow_udf(DoubleType())
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            parts = [float(shared.value[p].sum()) for p in places(t.as_py())]
            out.append(sum(parts) if parts else None)
        return pa.array(out, pa.float64())

    return run(text)


def kth_largest(keys: DataFrame, k: int) -> float:
    """Of the column key (no nulls, k rows at least)."""
    while True:
        n, low, high = keys.agg(F.count(F.lit(1)), F.min("key"), F.max("key")).first()
        if low == high or k >= n:
            return low
        if n <= FEW:
            return sorted((r.key for r in keys.select("key").collect()), reverse=True)[k - 1]
        own = F.least(F.lit(BINS - 1), F.floor((F.col("key") - low) / F.lit((high - low) / BINS)))
        keys = keys.withColumn("bin", own)
        counts = sorted(((r.bin, r["count"]) for r in keys.groupBy("bin").count().collect()), reverse=True)
        for b, count in counts:
            if k <= count:
                break
            k -= count
        keys = keys.where(F.col("bin") == b).select("key")


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 29) -> DataFrame:
    """doc_id, log_weight, key and kept, for each row of docs."""
    graded = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    good = saved(graded.where("quality = 1").select("doc_id"), "good")
    if share is None:
        part = graded.agg(F.avg("quality")).first()[0]
        share = 1.0 if part is None else part
    weight = log_weight(F.col("text"), docs.sparkSession, log_ratio(docs, good))
    u = hash_share(F.col("doc_id"), seed=seed) + F.lit(0.5 / (1 << 30))
    weighted = docs.select("doc_id", weight.alias("log_weight"))
    keyed = saved(weighted.withColumn("key", F.col("log_weight") - F.log(-F.log(u))), "keyed")
    k = round(share * keyed.count())
    some = keyed.where("key is not null").select("key")
    least = kth_largest(some, k) if k and some.limit(1).count() else float("inf")
    return keyed.withColumn("kept", F.coalesce(F.col("key") >= F.lit(least), F.lit(False)))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
