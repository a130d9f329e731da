"""A BM25 index in blocks with bounds, which grows, forgets, and is searched without reading what can't matter.

A term's postings are kept in blocks by ranges of ids (of 2^BITS), each with its number of postings, its largest tf and its
least document length: these bound what the block can add to a score, whatever the mean length becomes. A search first scores
a question's rarest terms, which gives a floor under its k-th score. Terms whose bounds together stay under the floor can't
bring a document in alone: of these only the blocks are read in which a document stands that the other terms brought.

Writes come in segments. Documents without an id aren't indexed. A document that comes again, or goes, leaves a tombstone for its old segment, and its terms are taken off
the counts; so a search after upserts and deletes is that of an index made anew. compacted() writes the living postings alone.

Folders of an index: blocks (segment, part), docs (segment), dead and dead_terms (by the segment that wrote them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundwell.operators.retrieval import K1, B, index_part, postings, query_terms, small, top
from groundwell.sources.work import saved, work_path

BITS = 10
#: The rarest terms of a question are scored first, until they have this many times k postings.
FIRST = 5
_BLOCK = "term string, bucket long, n int, max_tf int, min_dl int, ids array<long>, tfs array<int>, dls array<int>"
_SCHEMAS = {"blocks": f"{_BLOCK}, segment int, part int", "docs": "id long, dl int, segment int", "dead": "id long, dl int, of_segment int, segment int", "dead_terms": "term string, n long, segment int"}
_ARROW = pa.schema([("term", pa.string()), ("bucket", pa.int64()), ("n", pa.int32()), ("max_tf", pa.int32()), ("min_dl", pa.int32()), ("ids", pa.list_(pa.int64())), ("tfs", pa.list_(pa.int32())), ("dls", pa.list_(pa.int32()))])


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A folder of the index; empty if nothing was written to it."""
    return spark.read.schema(_SCHEMAS[name]).option("pathGlobFilter", "*.parquet").parquet(f"{path}/{name}")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings in order of (term, id) to blocks. A block may be cut between two batches: blocks of one bucket add up."""
    for batch in batches:
        if not batch.num_rows:
            continue
        term, ids, tf, dl = (batch.column(c) for c in ("term", "id", "tf", "dl"))
        bucket = ids.to_numpy() >> BITS
        code = term.dictionary_encode().indices.to_numpy()
        cut = np.flatnonzero((code[1:] != code[:-1]) | (bucket[1:] != bucket[:-1])) + 1
        begin = np.concatenate([[0], cut])
        offsets = pa.array(np.concatenate([begin, [len(ids)]]), pa.int32())
        tf, dl = tf.to_numpy().astype(np.int32), dl.to_numpy().astype(np.int32)
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (ids, tf, dl)]
        sizes = np.diff(np.concatenate([begin, [len(ids)]])).astype(np.int32)
        yield pa.RecordBatch.from_arrays([term.take(pa.array(begin)), pa.array(bucket[begin]), pa.array(sizes), pa.array(np.maximum.reduceat(tf, begin)), pa.array(np.minimum.reduceat(dl, begin)), *lists], schema=_ARROW)


def _write_blocks(rows: DataFrame, path: str, segment: int) -> None:
    """rows (term, id, tf, dl) as the blocks of a segment, in folders by part."""
    parted = rows.select("term", "id", "tf", "dl", index_part(F.col("term")).alias("part")).hint("rebalance", F.col("part")).sortWithinPartitions("part", "term", "id")
    blocks = parted.mapInArrow(_packed, _BLOCK).withColumn("segment", F.lit(segment)).withColumn("part", index_part(F.col("term")))
    blocks.write.mode("append").partitionBy("segment", "part").parquet(f"{path}/blocks")


def _add(docs: DataFrame, path: str, segment: int) -> None:
    made = saved(postings(docs.where("id is not null")), "postings")
    _write_blocks(made.where("term is not null"), path, segment)
    made.where("head").select("id", "dl").withColumn("segment", F.lit(segment)).write.mode("append").partitionBy("segment").parquet(f"{path}/docs")


def _prepared(spark: SparkSession, path: str) -> None:
    for name, schema in _SCHEMAS.items():
        spark.createDataFrame([], schema).drop("part").coalesce(1).write.mode("append").partitionBy("segment").parquet(f"{path}/{name}") if name != "blocks" else spark.createDataFrame([], schema).coalesce(1).write.mode("append").partitionBy("segment", "part").parquet(f"{path}/{name}")


def build(docs: DataFrame, path: str | None = None) -> str:
    """The path of a new index of docs (id, text), one row each."""
    path = path or work_path(docs.sparkSession, "blocks")
    _prepared(docs.sparkSession, path)
    _add(docs, path, 0)
    return path


def live(spark: SparkSession, path: str) -> DataFrame:
    """id, dl and segment of the documents that are in the index."""
    dead = table(spark, path, "dead").select(F.col("id").alias("_id"), F.col("of_segment").alias("_segment"))
    return table(spark, path, "docs").join(small(dead), (F.col("id") == F.col("_id")) & (F.col("segment") == F.col("_segment")), "left_anti")


def _exploded(blocks: DataFrame, *more: str) -> DataFrame:
    return blocks.select("segment", "term", *more, F.inline(F.arrays_zip(F.col("ids").alias("id"), F.col("tfs").alias("tf"), F.col("dls").alias("dl"))))


def _living(rows: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """Postings without those of tombstones."""
    dead = table(spark, path, "dead").select(F.col("id").alias("_id"), F.col("of_segment").alias("_segment"))
    return rows.join(small(dead), (F.col("id") == F.col("_id")) & (F.col("segment") == F.col("_segment")), "left_anti")


def _bury(spark: SparkSession, path: str, ids: DataFrame, segment: int) -> None:
    """Tombstones for the living documents with these ids, and their terms taken off the counts; reads the postings in the ids' buckets."""
    gone = saved(live(spark, path).join(small(ids.select("id").distinct()), "id", "left_semi"), "gone")
    buckets = small(gone.select(F.shiftright("id", BITS).alias("bucket")).distinct())
    theirs = _exploded(table(spark, path, "blocks").join(buckets, "bucket", "left_semi")).join(small(gone.select("id", "segment")), ["id", "segment"], "left_semi")
    theirs.groupBy("term").agg(F.count(F.lit(1)).alias("n")).withColumn("segment", F.lit(segment)).write.mode("append").partitionBy("segment").parquet(f"{path}/dead_terms")
    gone.select("id", "dl", F.col("segment").alias("of_segment"), F.lit(segment).alias("segment")).write.mode("append").partitionBy("segment").parquet(f"{path}/dead")


def _next(spark: SparkSession, path: str) -> int:
    last = [table(spark, path, n).agg(F.max("segment")).first()[0] for n in ("docs", "dead")]
    return 1 + max((x for x in last if x is not None), default=0)


def upsert(docs: DataFrame, path: str) -> None:
    """Adds docs (id, text), one row each; those that the index has are replaced."""
    spark = docs.sparkSession
    segment = _next(spark, path)
    docs = saved(docs.select("id", "text"), "upserts")
    _bury(spark, path, docs, segment)
    _add(docs, path, segment)


def delete(ids: DataFrame, path: str) -> None:
    """Takes documents (id) out; ids that the index doesn't have are no matter."""
    _bury(ids.sparkSession, path, ids, _next(ids.sparkSession, path))


def compacted(spark: SparkSession, path: str, to: str | None = None) -> str:
    """The path of a new index of the living postings alone; no text is needed."""
    to = to or work_path(spark, "blocks")
    _prepared(spark, to)
    _write_blocks(_living(_exploded(table(spark, path, "blocks")), spark, path), to, 0)
    live(spark, path).select("id", "dl", F.lit(0).alias("segment")).write.mode("append").partitionBy("segment").parquet(f"{to}/docs")
    return to


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, counts: dict | None = None) -> DataFrame:
    """The k best by BM25 of queries (qid, text): qid, id, score, rank. counts gets `of`, how many postings the questions' terms have, summed over the
    questions, and `scored`, how many of them met their question."""
    n, length = live(spark, path).agg(F.count(F.lit(1)), F.avg("dl")).first()
    asked = saved(query_terms(queries), "asked")
    parts = [r.part for r in asked.select(index_part(F.col("term")).alias("part")).distinct().collect()]  # INDEX_PARTS at most
    terms = small(asked.select("term").distinct())
    blocks = table(spark, path, "blocks").where(F.col("part").isin(parts)).join(terms, "term", "left_semi")
    impact = lambda tf, dl: F.col(tf) / (F.col(tf) + K1 * (1 - B + B * F.col(dl) / F.lit(length or 1.0)))
    bounds = saved(blocks.select("term", "segment", "bucket", "n", impact("max_tf", "min_dl").alias("most")), "bounds")  # without the postings
    gone = table(spark, path, "dead_terms").join(terms, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("gone"))
    df = bounds.groupBy("term").agg(F.sum("n").alias("all"), F.max("most").alias("most")).join(gone, "term", "left").withColumn("df", F.col("all") - F.coalesce("gone", F.lit(0)))
    idf = F.log(1 + (F.lit(n or 0) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = asked.join(df.where("df > 0"), "term").select("qid", "term", "all", (F.col("qtf") * idf).alias("weight"), (F.col("qtf") * idf * F.col("most")).alias("bound"))
    by_df = Window.partitionBy("qid").orderBy("all", "term").rowsBetween(Window.unboundedPreceding, -1)
    weighed = saved(weighed.withColumn("early", F.coalesce(F.sum("all").over(by_df), F.lit(0)) < FIRST * k), "weighed")

    def scored(rows: DataFrame, which: DataFrame) -> DataFrame:
        """qid, id and the sum of what postings give for which (qid, term, weight)."""
        part = F.round(F.sum(F.col("weight") * impact("tf", "dl")), 9)
        return _living(_exploded(rows), spark, path).join(small(which.select("qid", "term", "weight")), "term").groupBy("qid", "id").agg(part.alias("score"))

    only = lambda which: blocks.join(small(which.select("term").distinct()), "term", "left_semi")
    first = scored(only(weighed.where("early")), weighed.where("early"))
    floor = top(first, k, ["qid"], F.desc("score"), "id").where(F.col("rank") == k).select("qid", F.col("score").alias("floor"))
    # terms in order of their bounds: as long as these stay under the floor together, none of them brings a document in
    by_bound = Window.partitionBy("qid").orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, 0)
    ranked = weighed.join(saved(floor, "floors"), "qid", "left").withColumn("together", F.sum("bound").over(by_bound))
    light: Column = F.coalesce(F.col("together") < F.col("floor") - 1e-5, F.lit(False))
    ranked = saved(ranked.withColumn("light", light), "ranked")
    heavy, rest = ranked.where("not light"), ranked.where("light")
    # what the heavy terms brought, and can still reach the floor with all that the light ones may add
    more = rest.groupBy("qid").agg(F.sum("bound").alias("more"), F.max("floor").alias("floor"))
    found = scored(only(heavy), heavy).join(small(more), "qid", "left")
    found = saved(found.where(F.col("floor").isNull() | (F.col("score") + F.col("more") >= F.col("floor") - 1e-5)).select("qid", "id", "score"), "found")
    near = saved(found.select("qid", F.shiftright("id", BITS).alias("bucket")).distinct().join(small(rest.select("qid", "term", "weight")), "qid"), "near")
    if counts is not None:
        total = lambda which, *on: which.join(bounds, list(on)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        counts["of"], counts["scored"] = total(weighed.select("qid", "term"), "term"), total(heavy.select("qid", "term"), "term") + total(near, "term", "bucket")
    added = _living(_exploded(blocks.join(small(near), ["term", "bucket"]), "qid", "weight"), spark, path)
    extra = added.groupBy("qid", "id").agg(F.round(F.sum(F.col("weight") * impact("tf", "dl")), 9).alias("extra"))
    both = found.join(extra, ["qid", "id"], "left").select("qid", "id", F.round(F.col("score") + F.coalesce("extra", F.lit(0.0)), 6).alias("score")).where("score > 0")
    return top(both, k, ["qid"], F.desc("score"), "id")


