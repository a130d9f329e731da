"""The entities that the library works on, made from the driver's tables.

Sections, publication dates and titles of passages are rules on doc_id: the tables have none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwell.functions.text import passage_id


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: id, doc_id, source_type, source_id, title, text, section, published."""
    d = read(spark, sf_dir, "documents")
    section = F.element_at(F.array(F.lit("Abstract"), F.lit("Method"), F.lit("Results"), F.lit("Related Work"), F.lit(None)), (F.col("doc_id") % 5 + 1).cast("int"))
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 2000).cast("int"))
    d = d.select(
        "doc_id", F.when(F.col("lang") == "en", "arxiv").otherwise("web").alias("source_type"), F.col("source").alias("source_id"),
        F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), "text", section.alias("section"),
        F.when(F.col("doc_id") % 17 != 0, F.date_format(day, "yyyy-MM-dd")).alias("published"),
    )
    return d.withColumn("id", passage_id(F.col("source_id"), F.col("section"), F.col("text")))


PASSAGES_SQL = """p AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 'arxiv' ELSE 'web' END AS source_type, source AS source_id, 'Document ' || doc_id AS title, text,
  (['Abstract', 'Method', 'Results', 'Related Work', NULL])[CAST(doc_id % 5 + 1 AS INT)] AS section,
  CASE WHEN doc_id % 17 <> 0 THEN strftime(DATE '2020-01-01' + CAST(doc_id % 2000 AS INT), '%Y-%m-%d') END AS published FROM documents),
passages AS (SELECT *, 'P' || substr(sha256(source_id || chr(0) || coalesce(section, '') || chr(0) || text), 1, 12) AS id FROM p)"""


#: The host of a page's address.
DOMAIN_SQL = r"coalesce(nullif(regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)), '^www\.', ''), ''), 'unknown')"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, vector, label."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as calls of a model: event_type is the model, value the tokens, user_id the run; ts in UTC."""
    e = read(spark, sf_dir, "events")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "user_id", F.col("event_type").alias("model"), F.floor(F.col("value") * 10).cast("long").alias("tokens"), "props")


CALLS_SQL = "calls AS (SELECT event_id, ts, epoch_us(ts) AS us, user_id, event_type AS model, CAST(floor(value * 10) AS BIGINT) AS tokens, props FROM events)"


def plan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as open questions of a run: run, pos, f1, status, rounds, sources, kind.

    f1 is null where the discount is 0 (nothing retrieved)."""
    li = read(spark, sf_dir, "lineitem")
    f1 = F.when(F.col("l_discount") > 0, F.round(F.col("l_quantity") / 5 - 2, 4))
    status = F.when(F.col("l_returnflag") == "A", "sufficient").when(F.col("l_returnflag") == "R", "insufficient").when(F.col("l_linestatus") == "O", "pending").otherwise("abandoned")
    kind = F.when(F.col("l_partkey") % 4 == 0, "background").otherwise("core")
    return li.select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("supp"), F.col("l_partkey").alias("part"), f1.alias("f1"), status.alias("status"), F.floor(F.col("l_tax") * 50).cast("int").alias("rounds"), (F.col("l_suppkey") % 4).cast("int").alias("sources"), kind.alias("kind")).withColumn(
        "pos", F.row_number().over(_by_run())
    )


def _by_run():
    from pyspark.sql import Window

    return Window.partitionBy("run").orderBy("line", "part", "supp", F.col("f1").asc_nulls_first(), "status", "rounds")


PLAN_SQL = """plan0 AS (SELECT l_orderkey AS run, l_linenumber AS line, l_suppkey AS supp, l_partkey AS part, CASE WHEN l_discount > 0 THEN round(l_quantity / 5 - 2, 4) END AS f1,
  CASE WHEN l_returnflag = 'A' THEN 'sufficient' WHEN l_returnflag = 'R' THEN 'insufficient' WHEN l_linestatus = 'O' THEN 'pending' ELSE 'abandoned' END AS status,
  CAST(floor(l_tax * 50) AS INT) AS rounds, CAST(l_suppkey % 4 AS INT) AS sources, CASE WHEN l_partkey % 4 = 0 THEN 'background' ELSE 'core' END AS kind FROM lineitem),
plan AS (SELECT *, CAST(row_number() OVER (PARTITION BY run ORDER BY line, part, supp, f1 NULLS FIRST, status, rounds) AS INT) AS pos FROM plan0)"""
