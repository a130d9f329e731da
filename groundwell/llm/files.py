"""Files that tasks write to and read from the shared folder, by any file system that pyarrow knows (local, HDFS, object stores).

A file's name holds the task attempt, and the rows that tell of it are committed by Spark: files of lost attempts are never read.
"""

from __future__ import annotations

from typing import BinaryIO

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_small, saved


def new_file(folder: str, suffix: str, count: int) -> tuple[str, BinaryIO]:
    """A name and an open file for this task's count-th file."""
    where, path = fs.FileSystem.from_uri(folder)
    where.create_dir(path, recursive=True)
    task = TaskContext.get()
    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{count:04d}{suffix}"
    return name, where.open_output_stream(f"{path}/{name}", compression=None)


def dealt(rows: DataFrame, files: DataFrame, task_bytes: int) -> DataFrame:
    """rows (file, offset, and what else), one for each piece of a file that is to be read, dealt out by the bytes they stand for.

    files: file and bytes. Spark sees rows of a few bytes, and would put all of them into one task. Here the files are laid one
    after another and cut into parts of task_bytes, or into a part for each core if that's more. Sums run over the files of a
    writing task, then over the tasks."""
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    files = saved(files.select("file", "bytes", F.split("file", "-")[1].cast("int").alias("task")), "laid")
    total = files.agg(F.sum("bytes")).first()[0] or 1
    tasks = files.groupBy("task").agg(F.sum("bytes").alias("in_task"))
    tasks = tasks.select("task", F.coalesce(F.sum("in_task").over(before.orderBy("task")), F.lit(0)).alias("earlier"))  # one row per writing task
    own = F.coalesce(F.sum("bytes").over(Window.partitionBy("task").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = saved(files.withColumn("own", own).join(tasks, "task").select(F.col("file").alias("_file"), (F.col("earlier") + F.col("own")).alias("_base")), "bases")
    parts = max(-(-total // task_bytes), files.sparkSession.sparkContext.defaultParallelism)
    part = F.floor((F.col("_base") + F.col("offset")) * F.lit(parts / total)).cast("int")
    placed = join_small(rows, base, F.col("file") == F.col("_file"), "inner")
    return placed.repartitionById(parts, F.least(F.lit(parts - 1), part)).drop("_file", "_base")


def open_file(folder: str, name: str):
    """A file for reading at any offset."""
    where, path = fs.FileSystem.from_uri(folder)
    return where.open_input_file(f"{path}/{name}")
