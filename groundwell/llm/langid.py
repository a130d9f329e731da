"""Language ID with string kernels.

The kernel of two texts is the number of character n-grams (1 to 4, one blended spectrum) that both have, over the root of
both texts' own numbers. N-grams are of letters in lower case, with every other character a blank, and are hashed into
2^15 places. A bounded sample of labelled texts is fitted: landmarks of each language give the Nyström features, and kernel
ridge regression fits one language against the rest. As the kernel is linear in the presence vector, landmarks and
coefficients fold into one matrix, and a batch of texts is scored by one product of presence rows and that matrix.

Sample bound: SAMPLE rows in all (four times that if hashes fall badly), spread over the languages (the 1,000 with the most rows, if
there are more); 32 landmarks a language.
What a row leaves on the driver is its 4 KB presence row, whatever its length.

The pipeline's filter doesn't use the score, a softmax over the learned languages that is never under 1 / their number. It
uses the raw one-versus-rest value of the best language. Its bound is the value that 99 % of the fitted rows reach, each
as if it alone had been left out of the fit.

Defined cases: under CALIBRATE fitted rows there is no bound, and only `und` is filtered out; `und` with score 0 for a null text or one without a letter, and for all if nothing could be learned; equal
scores go to the language first in code-point order; very long texts are read in blocks; rows with a null doc_id are never
learned from; repeated rows are scored alike; an empty table gives an empty result; other columns pass through
identify() untouched and cannot clash, as its result is one struct column.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StringType, StructField, StructType

from .common import crc_of_id, free_worker, hash_sample, table

PLACES = 1 << 15
GRAMS = 4
SAMPLE = 1600
LANDMARKS = 32
RIDGE = 1e-2
SHARPNESS = 4.0
#: Of the fitted rows this share has a value under the filter's bound; so many rows are needed for one.
UNDER = 0.01
CALIBRATE = 100
BLOCK = 1 << 20
BATCH = 64
UNKNOWN = "und"
#: Letters of the basic plane by their lower-case code, other characters as a blank.
FOLDED = np.array([ord(chr(c).lower()[0]) if not 0xD800 <= c < 0xE000 and chr(c).isalpha() else 32 for c in range(1 << 16)], dtype=np.uint32)


def _folded(block: str) -> np.ndarray:
    codes = np.frombuffer(block.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    high = codes > 0xFFFF
    if high.any():
        out = FOLDED[np.where(high, 0, codes)]
        out[high] = [c if chr(c).isalpha() else 32 for c in codes[high].tolist()]
        return out
    return FOLDED[codes]


def mark_presence(text: str | None, row: np.ndarray) -> bool:
    """Sets row to 1 at the places of the text's n-grams; whether it has a letter."""
    letters = False
    for at in range(0, len(text or ""), BLOCK):
        codes = _folded(text[max(0, at - GRAMS + 1) : at + BLOCK])  # blocks overlap by what an n-gram may reach back
        letters = letters or bool((codes != 32).any())
        h = np.zeros(len(codes) + 1, dtype=np.uint32)
        for n in range(GRAMS):
            if len(codes) <= n:
                break
            h = (h[:-1] + codes[n:]) * np.uint32(2654435761) + np.uint32(n + 1)
            row[((h ^ (h >> np.uint32(15))) * np.uint32(2246822519)) >> np.uint32(17)] = 1
    return letters


@F.arrow_udf(BinaryType())
def presence(texts: pa.Array) -> pa.Array:
    """A text's presence row as bits; null without a letter."""
    free_worker()
    out = []
    for t in texts:
        row = np.zeros(PLACES, dtype=np.uint8)
        out.append(np.packbits(row).tobytes() if mark_presence(t.as_py(), row) else None)
    return pa.array(out, pa.binary())


def _unit(bits: list[bytes]) -> np.ndarray:
    """Presence rows over the roots of their own numbers."""
    rows = np.unpackbits(np.array([np.frombuffer(b, dtype=np.uint8) for b in bits]), axis=1).astype(np.float32)
    return rows / np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))


def fit(bits: list[bytes], labels: list[str]) -> tuple[list[str], np.ndarray, float]:
    """Presence rows as bits, and their languages, to the languages, the matrix (PLACES x languages) and the filter's bound."""
    names = sorted(set(labels))
    y = np.array([names.index(x) for x in labels])
    marks = _unit([bits[i] for k in range(len(names)) for i in np.flatnonzero(y == k)[:LANDMARKS]])
    values, vectors = np.linalg.eigh(marks @ marks.T)
    keep = values > 1e-6 * values.max()
    root = (vectors[:, keep] / np.sqrt(values[keep])).astype(np.float32)  # the Nyström map's K^(-1/2)
    phi = np.concatenate([(_unit(bits[at : at + BATCH]) @ marks.T) @ root for at in range(0, len(bits), BATCH)])
    target = 2.0 * (y[:, None] == np.arange(len(names))) - 1
    # a language counts as much as another, however many rows it has
    weight = (1 / np.bincount(y))[y][:, None]
    gram = phi.T @ (weight * phi) + RIDGE * np.eye(phi.shape[1])
    coef = np.linalg.solve(gram, phi.T @ (weight * target))
    bound = -np.inf
    if len(y) >= CALIBRATE:
        own = weight * (phi * np.linalg.solve(gram, phi.T).T).sum(axis=1, keepdims=True)  # a row's part in its own value
        bound = float(np.quantile(((phi @ coef - own * target) / np.maximum(1 - own, 1e-9)).max(axis=1), UNDER))
    return names, (marks.T @ (root @ coef)).astype(np.float32), bound


def learn(docs: DataFrame, seed: int = 5) -> tuple[list[str], np.ndarray, float]:
    """From text and non-null lang of a bounded sample of the rows whose crc32 of the id, mod 4, isn't 2."""
    # null texts are left out after the sampling, so that the counts read ids and languages only
    pool = docs.where(F.col("lang").isNotNull() & (F.pmod(crc_of_id(F.col("doc_id")), F.lit(4)) != 2)).select("doc_id", "lang", "text")
    sample = hash_sample(pool, ["lang"], lambda langs: max(2, SAMPLE // langs), F.col("doc_id"), seed)
    found = sample.select("doc_id", "lang", presence("text").alias("bits")).where("bits is not null").collect()
    # landmarks are a language's first rows: by a hash of the id, for small ids may have something in common
    found.sort(key=lambda r: (zlib.crc32(f"{seed}/{r.doc_id}".encode()), r.doc_id, r.lang, r.bits))
    if not found:
        return [], np.zeros((PLACES, 0), dtype=np.float32), -np.inf
    return fit([bytes(r.bits) for r in found], [r.lang for r in found])


PREDICTION = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("value", DoubleType())])


def identify(text: Column, spark: SparkSession, model: tuple[list[str], np.ndarray, float]) -> Column:
    """A struct of lang_pred, score and value, the raw one of lang_pred (null for `und`)."""
    shared = spark.sparkContext.broadcast(model[:2])

    @F.arrow_udf(PREDICTION)
    def run(texts: pa.Array) -> pa.Array:
        free_worker()
        names, matrix = shared.value
        best, score, value = [], [], []
        for at in range(0, len(texts), BATCH):
            part = texts.slice(at, BATCH)
            rows = np.zeros((len(part), PLACES), dtype=np.float32)
            letters = np.array([mark_presence(t.as_py(), rows[k]) for k, t in enumerate(part)])
            if not names:
                best += [UNKNOWN] * len(part)
                score += [0.0] * len(part)
                value += [None] * len(part)
                continue
            f = (rows @ matrix) / np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))
            e = np.exp(SHARPNESS * (f - f.max(axis=1, keepdims=True)).astype(float))
            p = e / e.sum(axis=1, keepdims=True)
            best += [names[k] if ok else UNKNOWN for k, ok in zip(f.argmax(axis=1), letters, strict=True)]
            score += [float(x) if ok else 0.0 for x, ok in zip(p.max(axis=1), letters, strict=True)]
            value += [float(x) if ok else None for x, ok in zip(f.max(axis=1), letters, strict=True)]
        return pa.StructArray.from_arrays([pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(value, pa.float64())], names=["lang_pred", "score", "value"])

    return run(text)


def language_filter(docs: DataFrame) -> DataFrame:
    """The rows whose language is known: not `und`, and with a value of at least the model's bound. They have the columns of docs."""
    model = learn(docs)
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), identify(F.col("text"), docs.sparkSession, model).alias("p"))
    return packed.where((F.col("p.lang_pred") != UNKNOWN) & (F.col("p.value") >= model[2])).select("row.*")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", F.coalesce(F.pmod(crc_of_id(F.col("doc_id")), F.lit(4)) == 2, F.lit(False)).alias("held_out"), identify(F.col("text"), spark, learn(docs)).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang_pred").alias("lang_pred"), F.col("p.score").alias("score"))
