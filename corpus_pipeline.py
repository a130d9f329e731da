"""The corpus pipeline: language ID, quality rules, near-dedup, mixing and BPE, each stage on what the one before kept.

Stages keep a row's columns whatever their names. Nulls, ties and empty tables are treated as the operators' modules say; in short:
a null text has no letter and goes in the first stage, equal rows are told apart by a hash of the whole row, and an empty table
gives an empty result. An id may be null or repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwell.llm import bpe, langid, mixing, quality_rules, simhash
from groundwell.llm.common import drop, table, work_dropped, work_path


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a known language go, those without a text or a letter too (langid.language_filter)."""
    return langid.language_filter(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the host-level rules reject go; a null source is a host of its own (quality_rules.quality_filter)."""
    return quality_rules.quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies one document stays, the one with the smallest id, null last (simhash.near_dedup)."""
    return simhash.near_dedup(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it: not at all, once or twice; never one without words (mixing.mix)."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids, and whether decoding gives the text again; a null text has no ids (bpe.encoded_checked)."""
    vocabulary = bpe.shared_vocabulary(spark, bpe.default_vocabulary())
    done = docs.select("doc_id", "source", bpe.encoded_checked(F.col("text"), vocabulary).alias("t"))
    return done.select("doc_id", "source", F.size("t.ids").cast("long").alias("n_tokens"), "t.ids", "t.round_trip")


STAGES = [("language ID", languages), ("quality rules", quality), ("SimHash near-dedup", near_dedup), ("mixing", mixture), ("BPE", tokens)]

#: Kernels, fingerprints and sampling can't be expressed in SQL; the tests hold the result against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; of what they write only the last one's output stays."""
    docs, last = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = work_path(spark, f"stage{k}")
        with work_dropped(spark, path):
            stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            drop(last)
        docs, last = spark.read.parquet(path), path
    return docs
