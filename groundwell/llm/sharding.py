"""Sharding: a two-pass external shuffle that deals whole records into shards.

Pass 1 scatters the records by a seeded hash into buckets that fit in memory. Pass 2 puts each bucket into an order that
depends on its content alone, shuffles it by Fisher-Yates with swaps drawn from a seeded hash, and writes it. The buckets
in a row are one shuffled sequence; it's cut into shards whose counts differ by one at most (law `rows`).
Only DataFrame functions are used.

A bucket has 128 MB or 65,536 records at most, on average, and a task takes eight of them in a row: 100 TB are some 800,000
buckets in 100,000 tasks. Fisher-Yates runs on places, not on records: an order of n numbers in blocks of about sqrt(n), so
that a swap copies two blocks and not the order. Records are sorted by Spark (which spills), numbered, and take their new
place out of their bucket's order.

Defined cases: a null or empty text is a record like any other (size 1 in the query); records equal in id and text can
stand for each other, and where there are more than REPEATS of them they are scattered one by one, not by their common
hash; an empty table gives an empty result with the same columns; the whole input row travels in the struct `record`, so
that no column name of the input can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, saved, table, work_path

#: So many equal records may share a bucket; more of them are spread over all buckets.
REPEATS = 1024
#: Small tables have so many buckets at least, that their work can be shared.
LEAST_BUCKETS = 64


def _put(blocks: Column, at: Column, block: Column) -> Column:
    """An array of blocks with the one at `at` (from 0) replaced."""
    return F.concat(F.slice(blocks, F.lit(1), at), F.array(block), F.slice(blocks, at + 2, F.size(blocks)))


def fisher_yates(n: Column, *seeds: Column) -> Column:
    """The numbers 0 to n - 1 (n at least 1), shuffled from the last place down, each swap drawn by a hash of the seeds and the place."""
    wide = F.greatest(F.lit(1), F.floor(F.sqrt(n))).cast("int")
    start = F.transform(F.sequence(F.lit(0), (n - 1).cast("int"), wide), lambda a: F.sequence(a, F.least(a + wide, n.cast("int")) - 1))
    place = lambda i, j: F.struct(F.floor(i / wide).cast("int").alias("a"), (i % wide).alias("x"), F.floor(j / wide).cast("int").alias("b"), (j % wide).alias("y"))
    draw = lambda i: place(i, F.pmod(F.xxhash64(*seeds, i), (i + 1).cast("long")).cast("int"))
    swaps = F.when(n > 1, F.transform(F.sequence((n - 1).cast("int"), F.lit(1), F.lit(-1)), draw))

    def step(blocks: Column, s: Column) -> Column:
        mine, other = F.get(F.get(blocks, s["a"]), s["x"]), F.get(F.get(blocks, s["b"]), s["y"])
        half = _put(blocks, s["a"], _put(F.get(blocks, s["a"]), s["x"], other))
        # j < i, so that within one block the second change has to see the first
        return F.when((s["a"] == s["b"]) & (s["x"] == s["y"]), blocks).otherwise(F.aggregate(F.array(s), half, lambda h, t: _put(h, t["b"], _put(F.get(h, t["b"]), t["y"], mine))))

    return F.flatten(F.aggregate(F.coalesce(swaps, F.array().cast("array<struct<a:int,x:int,b:int,y:int>>")), start, step))


def bucket_offsets(counts: DataFrame, wide: int = 4096) -> DataFrame:
    """(bucket, n) to (bucket, n, offset): the rows in all buckets before. Two levels, so that no task sums all buckets."""
    counts = counts.withColumn("high", F.floor(F.col("bucket") / wide))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    high = counts.groupBy("high").agg(F.sum("n").alias("in_high"))
    high = high.select("high", F.coalesce(F.sum("in_high").over(before.orderBy("high")), F.lit(0)).alias("base"))
    own = F.coalesce(F.sum("n").over(Window.partitionBy("high").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.select("bucket", "n", "high", own.alias("own")).join(high, "high").select("bucket", "n", (F.col("base") + F.col("own")).cast("long").alias("offset"))


def _salted(docs: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Records (key, salt, record) of which few are equal, and those of which there are many, if there are any.

    The latter are saved with their salts, so that all later steps see the same ones."""
    record = F.struct(*[docs[c] for c in docs.columns]).alias("record")
    plain = docs.select(key.alias("key"), F.lit(0).cast("long").alias("salt"), record)
    many = saved(keys.where(F.col("n") > REPEATS).select("key"), "repeated")
    n = many.count()
    if not n:
        return plain, None
    many = F.broadcast(many) if n <= BROADCAST_ROWS else many
    hot = plain.join(many, "key", "left_semi").withColumn("salt", F.monotonically_increasing_id())
    return plain.join(many, "key", "left_anti"), saved(hot.select("key", "salt", "record"), "repeats")


def shuffle_into_shards(docs: DataFrame, path: str, *, shards: int = 16, seed: int = 17, bucket_bytes: int = 128 << 20, bucket_rows: int = 1 << 16, task_buckets: int = 8) -> DataFrame:
    """Writes Parquet shards (partition column shard) to path and returns what was written: record, slot, shard."""
    spark = docs.sparkSession
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    keys = saved(docs.select(key.alias("key"), size.alias("size")).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")), "keys")
    rows, total = keys.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    buckets = max(LEAST_BUCKETS, -(-total // bucket_bytes), -(-rows // bucket_rows))
    per_task = min(task_buckets, max(1, buckets // int(spark.conf.get("spark.sql.shuffle.partitions"))))
    tasks = -(-buckets // per_task)

    plain, hot = _salted(docs, key, keys)
    bucket = F.when(F.col("salt") == 0, F.pmod("key", F.lit(buckets))).otherwise(F.pmod(F.xxhash64("key", "salt"), F.lit(buckets))).alias("bucket")
    cold = keys if hot is None else keys.where(F.col("n") <= REPEATS)
    counts = cold.select("n", F.lit(0).alias("salt"), "key").select(bucket, "n")
    if hot is not None:
        plain, counts = plain.unionByName(hot), counts.unionByName(hot.select(bucket, F.lit(1).cast("long").alias("n")))
    offsets = saved(bucket_offsets(counts.groupBy("bucket").agg(F.sum("n").alias("n"))), "offsets")

    # a task has neighbouring buckets, so that it writes to few shards
    task = F.floor(F.col("bucket") / per_task).cast("int")
    scattered = plain.select(bucket, "key", "salt", "record").withColumn("task", task).repartitionById(tasks, F.col("task"))
    numbered = scattered.withColumn("pos", F.row_number().over(Window.partitionBy("task", "bucket").orderBy("key", "salt")) - 1)
    orders = offsets.withColumn("task", task).repartitionById(tasks, F.col("task")).withColumn("order", fisher_yates(F.col("n"), F.lit(seed), F.col("bucket")))
    g = F.col("offset") + F.get("order", F.col("pos"))
    # the first `longer` shards have one row more than the others
    short, longer = divmod(rows, shards)
    cut = longer * (short + 1)
    dealt = numbered.join(orders.hint("shuffle_hash"), ["task", "bucket"]).select("record", g.alias("g"))
    late = F.lit(longer) + F.floor((F.col("g") - cut) / F.lit(max(short, 1)))
    shard = F.when(F.col("g") < cut, F.floor(F.col("g") / F.lit(short + 1))).otherwise(late).cast("int")
    slot = F.when(F.col("g") < cut, F.pmod("g", F.lit(short + 1))).otherwise(F.pmod(F.col("g") - cut, F.lit(max(short, 1)))).cast("long")
    out = dealt.select("record", slot.alias("slot"), shard.alias("shard"))
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = shuffle_into_shards(table(spark, sf_dir, "documents"), work_path(spark, "shards"))
    text = F.coalesce(F.col("record.text"), F.lit(""))
    return written.select(
        F.col("record.doc_id").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), F.col("shard"), F.col("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
