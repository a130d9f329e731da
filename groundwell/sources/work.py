"""Work tables in the folder that driver and executors share, and the dealing out of small tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}
_kept: dict[tuple, str] = {}


def work_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir. Where that is unset a temporary folder serves, on one machine only."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines of the cluster share")
        app = spark.sparkContext.applicationId
        shared = _own_dirs.get(app) or _own_dirs.setdefault(app, "file://" + tempfile.mkdtemp(prefix="groundwell-"))
    return f"{shared.rstrip('/')}/groundwell/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: computed once, and kept when executors are lost."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(files: DataFrame, name: str, make: Callable[[str], None]) -> str:
    """The path of what make(path) wrote from these files, made once for an application as long as the files stay as they are.

    files: a table as it was read. Its files are known by path, size and time, of which a sum of hashes is taken in Spark: one row
    a file, without reading it."""
    spark = files.sparkSession
    listed = spark.read.format("binaryFile").load(files.inputFiles()).select("path", "length", "modificationTime")
    sign = listed.agg(F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first()[0]
    key = (spark.sparkContext.applicationId, name, sign)
    if key not in _kept:
        path = work_path(spark, name)
        make(path)
        _kept[key] = path
    return _kept[key]


def spread(df: DataFrame) -> DataFrame:
    """A table of a few splits (a small file is one, whatever its work) dealt out over the cores; any other as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores / 2 else df
