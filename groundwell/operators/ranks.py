"""Ranks within groups of any size: no task orders a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundwell.sources.work import saved


def _ranged(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Rows with _range, ranges of (group, order): a large group has many. Rows are saved first, as ranging reads them twice (once to sample); give narrow ones."""
    return saved(saved(rows, "unranged").repartitionByRange(group, *order).withColumn("_range", F.spark_partition_id()), "ranged")


def ranked_in(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """Adds rank, from 1, of each row in its group by order (ties by chance). Rows are ranked within a range, and a group's earlier ranges are counted."""
    ranged = _ranged(rows, group, list(order))
    counts = ranged.groupBy("_range", group).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col("_range").alias("_r"), F.col(group).alias("_g"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    own = F.row_number().over(Window.partitionBy("_range", group).orderBy(*order))
    placed = ranged.withColumn("_own", own).join(base, (F.col("_range") == F.col("_r")) & F.col(group).eqNullSafe(F.col("_g")))
    return placed.withColumn("rank", (F.col("_base") + F.col("_own")).cast("int")).drop("_range", "_own", "_r", "_g", "_base")


def last_before(rows: DataFrame, group: str, value: str, name: str, *order: str) -> DataFrame:
    """Adds name: the last value that isn't null of the rows before in the group, by order."""
    return lasts_before(rows, group, {name: value}, *order)


def lasts_before(rows: DataFrame, group: str, values: dict[str, str], *order: str) -> DataFrame:
    """Adds each name of values (name to column): the column's last value that isn't null of the rows before in the group, by order, which has no ties. Within a
    range it is looked for there, else among the ends of earlier ranges; rows are ranged once for all columns."""
    ranged = _ranged(rows, group, list(order))
    ends = ranged.groupBy("_range", group).agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), F.struct(*order))).alias(f"_end_{n}") for n, v in values.items()])
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = ends.select(F.col("_range").alias("_r"), F.col(group).alias("_g"), *[F.last(f"_end_{n}", ignorenulls=True).over(before).alias(f"_before_{n}") for n in values])
    own = Window.partitionBy("_range", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.select("*", *[F.last(v, ignorenulls=True).over(own).alias(f"_own_{n}") for n, v in values.items()])
    placed = placed.join(base, (F.col("_range") == F.col("_r")) & F.col(group).eqNullSafe(F.col("_g")))
    return placed.select(*rows.columns, *[F.coalesce(f"_own_{n}", f"_before_{n}").alias(n) for n in values])
