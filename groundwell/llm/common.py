"""Shared helpers of the training-data operators: inputs, shared work tables, words, samples."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these six ASCII blanks, in every operator of this package.
BLANKS = r"[\x20\x09-\x0D]+"
#: A table is broadcast only if a count has shown that it has no more rows than this.
BROADCAST_ROWS = 100_000
#: So many strata are sampled, one by one.
STRATA = 1000

_own_dirs: dict[str, str] = {}
_made: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as it lies there. One of a few splits (a small file is one, whatever its work) is dealt out over the cores."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores / 2 else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset a temporary one serves, on one machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that all machines of the cluster share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="groundwell-")
    return _own_dirs[app]


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/groundwell/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


@contextmanager
def work_dropped(spark: SparkSession, keep: str) -> Iterator[None]:
    """Work tables that are made meanwhile, but for the path to keep, are deleted in the end. What was computed from them has to be written by then."""
    made = _made.setdefault(spark.sparkContext.applicationId, [])
    before = len(made)
    yield
    for path in made[before:]:
        if path != keep:
            drop(path)
    made[before:] = []


def drop(path: str) -> None:
    where, at = fs.FileSystem.from_uri(path)
    if where.get_file_info(at).type != fs.FileType.NotFound:
        where.delete_dir(at)


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: computed once, and kept when executors are lost."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_large: dict[object, object] = {}


def kept_by_worker(key: object, make: Callable[[], object]) -> object:
    """In a task: an object that costs much to make, kept by the Python worker for its next tasks. It keeps one."""
    if key not in _large:
        _large.clear()
        _large[key] = make()
    return _large[key]


_last_task: list[int] = []


def free_worker() -> None:
    """In a task: drops what this Python worker kept for another operator's tasks; Spark gives workers to any task. Once a task, memory that is free goes back to the machine."""
    _large.clear()
    task = TaskContext.get()
    if task and _last_task != [task.taskAttemptId()]:
        _last_task[:] = [task.taskAttemptId()]
        give_back()


def give_back() -> None:
    """Memory that this process holds but doesn't use goes back to the machine, where the C library can do that."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def byte_slices(texts: pa.Array, most: int = 4 << 20) -> Iterator[pa.Array]:
    """An array of texts in slices of about so many bytes, a text at least."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield texts.slice(at, to - at)
        at = to


def words(text: Column) -> Column:
    """The words of a text as an array; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def join_small(left: DataFrame, right: DataFrame, on: Column, how: str = "left") -> DataFrame:
    """Join with right broadcast if a count shows that it's small; otherwise Spark shuffles both sides and splits hot keys."""
    return left.join(F.broadcast(right) if right.count() <= BROADCAST_ROWS else right, on, how)


def hash_share(*cols: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the seed and the columns alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def crc_of_id(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


def hash_sample(df: DataFrame, strata: list[str], wanted: int | Callable[[int], int], key: Column, seed: int) -> DataFrame:
    """About `wanted` rows of each stratum (a function gets their number), by a hash of key; all of a smaller one. Four times that many rows at most, in all strata
    together: those with the least hashes, so that a sample is the same each time.

    Of more than STRATA strata (labels, languages) those with the most rows are sampled, ties in order: a model learns that many at most."""
    rows = df.groupBy(*strata).count().orderBy(F.desc("count"), *strata).limit(STRATA).collect()
    counts = {tuple(r[:-1]): r[-1] for r in rows}
    per_stratum = wanted if isinstance(wanted, int) else wanted(max(1, len(counts)))
    share = F.lit(0.0)
    for values, n in counts.items():
        same = F.lit(True)
        for c, v in zip(strata, values, strict=True):
            same = same & F.col(c).eqNullSafe(F.lit(v))
        share = F.when(same, F.lit(min(1.0, per_stratum / n))).otherwise(share)
    drawn = df.withColumn("_drawn", hash_share(key, seed=seed)).where(F.col("_drawn") < share)
    most = 4 * per_stratum * max(1, len(counts))
    if drawn.count() > most:
        cut = drawn.select("_drawn").orderBy("_drawn").limit(most).agg(F.max("_drawn")).first()[0]
        drawn = drawn.where(F.col("_drawn") < cut)
    return drawn.drop("_drawn")
