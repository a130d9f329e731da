"""Mixing sources to target weights by balanced sampling with the cube method.

Sources in code-point order (null last) get the weights 3, 1, 2, and so on again. Together their targets are 150 % of all
words. A target stops at twice its source's size; what is over goes to the others by weight, until none is above.
A document of a source with ratio r = target / size is taken floor(r) times, and once more with probability r - floor(r).
The cube method draws these: flight moves the probabilities of three documents at a time along the null space of the two
balancing rows (documents, words), until one of them is 0 or 1. It runs in chunks of one source; the two at most that are
left in a chunk meet those of other chunks in the next level. What is left of a source in the end, two documents at most,
lands where its words come nearest to the target.

Rows equal in id, source and text are one unit with a number of repeats: r times that number is how often the unit is taken,
the whole part of it for sure and the rest by the draw. Its rows take equal shares, the first ones one more.

Defined cases: a null or empty text has size 0, and nothing is taken of it; an empty table gives an empty result; a source
without words has target 0. Draws depend on the seed and on the unit alone, so that reruns agree. Other columns of the
input are not looked at; mix() gives a unit's copies the columns of one of its rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_worker, join_small, n_words, saved, table

WEIGHTS = (3, 1, 2)
TOTAL_SHARE = 1.5
MOST = 2.0
CHUNK = 2048
FAN_IN = 256
EPS = 1e-9
#: A unit with more rows or copies than this is made in several tasks.
PIECE = 4096


def numbered(rows: DataFrame, order: Column) -> DataFrame:
    """Adds place, from 0, over all rows in order: ranks within ranges of the order, then the ranges' counts. No task sorts all rows."""
    ranged = saved(rows.repartitionByRange(order).withColumn("_range", F.spark_partition_id()), "ranged")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))  # a row for each range
    own = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1
    return ranged.withColumn("_own", own).join(counts, "_range").withColumn("place", F.col("_base") + F.col("_own")).drop("_range", "_own", "_base")


def source_targets(units: DataFrame) -> DataFrame:
    """source, n_docs, source_size, target."""
    sources = units.groupBy("source").agg(F.sum("repeats").alias("n_docs"), F.sum(F.col("size") * F.col("repeats")).cast("long").alias("source_size"))
    sources = saved(sources, "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.pmod(F.col("place"), F.lit(len(WEIGHTS))) + 1).cast("int"))
    sources = saved(numbered(sources, F.col("source").asc_nulls_last()).withColumn("weight", weight), "weighted")
    most = F.col("source_size") * MOST
    total = TOTAL_SHARE * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    capped = F.lit(False)
    while True:  # ends: each turn either caps another source or leaves the level as it is
        held, weights = sources.agg(F.sum(F.when(capped, most).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("weight")))).first()
        now = (total - held) / weights if weights else level
        if now == level or not weights:
            break
        level, capped = now, most <= F.col("weight") * now
    return sources.select("source", "n_docs", "source_size", F.least(most, F.col("weight") * level).alias("target"))


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Moves probabilities until two at most, of different sizes, are neither 0 nor 1; the sums of p and p * size stay."""
    p = p.astype(float).tolist()
    s = size.astype(float).tolist()
    draws = iter(rng.random(2 * len(p) + 4).tolist())
    active: list[int] = []
    rest = iter([k for k, x in enumerate(p) if EPS < x < 1 - EPS])
    while True:
        while len(active) < 3 and (k := next(rest, None)) is not None:
            active.append(k)
        if len(active) == 3:
            a, b, c = active
            move = [s[b] - s[c], s[c] - s[a], s[a] - s[b]]
            if not any(move):
                move = [1.0, -1.0, 0.0]
        elif len(active) == 2 and s[active[0]] == s[active[1]]:
            move = [1.0, -1.0]
        else:
            break
        up = min([(1 - p[k]) / u if u > 0 else p[k] / -u for k, u in zip(active, move, strict=True) if u])
        down = min([p[k] / u if u > 0 else (1 - p[k]) / -u for k, u in zip(active, move, strict=True) if u])
        step = up if next(draws) < down / (up + down) else -down
        for k, u in zip(active, move, strict=True):
            p[k] += step * u
            p[k] = 0.0 if p[k] < EPS else 1.0 if p[k] > 1 - EPS else p[k]
        active = [k for k in active if 0 < p[k] < 1]
    return np.array(p)


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The nearest of all ways to round what flight has left (two at most): words first, then documents."""
    left = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    best, out = None, p.round()
    for bits in range(1 << len(left)):
        take = np.array([bits >> k & 1 for k in range(len(left))], dtype=float)
        miss = (round(abs(float(((take - p[left]) * size[left]).sum())), 6), round(abs(float((take - p[left]).sum())), 6), bits)
        if best is None or miss < best:
            best = miss
            out[left] = take
    return out


UNIT = "doc_id long, source string, text_hash long, order_hash long, size long, repeats long, base long, p double, chunk long"


def _flown(level: int, last: bool, seed: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        free_worker()
        # the largest first, so that what is left in the end is small
        rows = rows.sort_values(["size", "order_hash", "doc_id", "text_hash"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        rng = np.random.default_rng([seed, level, abs(int(rows.order_hash.iloc[0])), len(rows)])
        size = rows["size"].to_numpy()
        p = flight(rows.p.to_numpy(), size, rng)
        rows["p"] = landing(p, size) if last else p
        return rows

    return run


def mixed_units(docs: DataFrame, seed: int = 23) -> DataFrame:
    """One row per unit: doc_id, source, text_hash, size, repeats, source_size, target, copies (of all its rows together, 0 to 2 for each)."""
    units = docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), n_words(F.col("text")).alias("size"))
    units = saved(units.groupBy("doc_id", "source", "text_hash", "size").agg(F.count(F.lit(1)).alias("repeats")), "units")
    targets = saved(source_targets(units), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    wanted = ratio * F.col("repeats")
    base = F.floor(wanted + EPS)
    chunks = F.ceil(F.col("n_docs") / CHUNK)
    order = F.xxhash64(F.lit(seed), "doc_id", "text_hash")
    t = targets.withColumnRenamed("source", "_source")
    level = join_small(units, t, F.col("source").eqNullSafe(F.col("_source")), "inner").select(
        "doc_id", "source", "text_hash", order.alias("order_hash"), "size", "repeats", base.alias("base"), F.greatest(F.lit(0.0), wanted - base).alias("p"), F.pmod(F.xxhash64(F.lit(seed + 1), order), chunks).alias("chunk"),
    )
    n = -(-(targets.agg(F.max("n_docs")).first()[0] or 0) // CHUNK)
    done, depth, is_open = [], 0, (F.col("p") > EPS) & (F.col("p") < 1 - EPS) & (F.col("size") > 0)
    done.append(level.where(~is_open))
    while True:
        last = n <= 1
        flown = saved(level.where(is_open).groupBy("source", "chunk").applyInPandas(_flown(depth, last, seed), UNIT), f"flight{depth}")
        done.append(flown if last else flown.where(~is_open))
        if last:
            break
        level, n, depth = flown.withColumn("chunk", F.floor(F.col("chunk") / FAN_IN)), -(-n // FAN_IN), depth + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    out = out.select("doc_id", "source", "text_hash", "size", "repeats", F.when(F.col("size") > 0, F.col("base") + F.round("p").cast("long")).otherwise(0).alias("copies"))
    return join_small(out, t, F.col("source").eqNullSafe(F.col("_source")), "inner").select("doc_id", "source", "text_hash", "size", "repeats", "source_size", "target", "copies")


def _pieces(units: DataFrame, n: str) -> DataFrame:
    """Each unit once for every PIECE of its n (1 at least), with the columns from and to; those of large units are spread over tasks."""
    cut = units.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1, F.lit(PIECE).cast("long")))).withColumn("to", F.least(F.col(n), F.col("from") + PIECE))
    return cut.repartition("doc_id", "text_hash", "from") if (units.agg(F.max(n)).first()[0] or 0) > PIECE else cut


def each_row(units: DataFrame) -> DataFrame:
    """One row for each of a unit's rows: doc_id, source, size, source_size, target, copies (0, 1 or 2)."""
    rows = _pieces(units, "repeats").withColumn("k", F.explode(F.sequence(F.col("from"), F.col("to") - 1)))
    share = F.floor(F.col("copies") / F.col("repeats")) + F.when(F.col("k") < F.col("copies") % F.col("repeats"), 1).otherwise(0)
    return rows.select("doc_id", "source", "size", "source_size", "target", share.cast("int").alias("copies"))


def mix(docs: DataFrame, seed: int = 23) -> DataFrame:
    """The mixture: each row of docs as often as it is taken, with the columns of docs."""
    units = saved(mixed_units(docs, seed), "mixed")
    u = units.where("copies > 0").select(F.col("doc_id").alias("u_id"), F.col("source").alias("u_source"), F.col("text_hash").alias("u_hash"), "copies")
    packed = docs.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.xxhash64("text").alias("_hash"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    if (units.agg(F.max("repeats")).first()[0] or 0) > 1:
        packed = packed.groupBy("_id", "_source", "_hash").agg(F.first("row").alias("row"))
    both = packed.join(u, F.col("_id").eqNullSafe(F.col("u_id")) & F.col("_source").eqNullSafe(F.col("u_source")) & (F.col("_hash") == F.col("u_hash")))
    both = both.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(PIECE).cast("long")))).withColumn("_n", F.least(F.lit(PIECE), F.col("copies") - F.col("_piece")).cast("int"))
    if (u.agg(F.max("copies")).first()[0] or 0) > PIECE:  # else no text is shuffled once more
        both = both.repartition("_id", "_hash", "_piece")
    return both.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("_n")))).select("row.*")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = each_row(saved(mixed_units(table(spark, sf_dir, "documents").select("doc_id", "source", "text")), "mixed"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")
