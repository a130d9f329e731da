"""The trie of conversations' first turns, from ternary search trees over numbered turns.

Turns (role and text, by SHA-256) are numbered in a dictionary, so that a conversation is a string of numbers. Equal strings
are one, with the number of its conversations. Strings are dealt out by ranges of their order; a task puts those of its shard
into a ternary search tree, the middle one first, then the middle ones of both halves, and so on, which balances it. A walk
back over the nodes, children before parents, adds up members, leaves and savings. Only prefixes of a shard's first and last
string can be in another shard too: these boundary nodes are written with what hangs below them, and are merged by key.

A conversation of any length goes in pieces of PIECE turns: the strings of a level begin with the class of all that came
before (its smallest conversation), and the deepest level goes first, as its sums belong to nodes of the level above. Long
lists of a node's conversations are joined in ranges, and one task streams the joined parts through SHA-256.

Defined cases: null role or text is empty; a null turn comes first, equal turns by the digest of role and text, and repeated
rows are turns of their own; rows without conv_id belong to no conversation; a conversation without turns is a member of the
root; conv_id % 20 has the sign of conv_id; an empty table gives an empty result. Other columns aren't looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of_id, free_worker, join_small, n_words, saved, table
from .mixing import numbered

PIECE = 64
#: Turns of a shard's strings.
SHARD = 200_000
#: Ids that are joined into one string.
JOINED = 4096
FAMILY, HEADS = 20, 4

_NODES = (
    "key binary, path array<binary>, parent_key binary, depth int, least long, parent_least long, class long, n long, children long, has_child boolean, leaves long, saved long, words long, ends string"
)
_EMPTY = hashlib.sha256(b"").hexdigest()


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), turn_id, words."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    each = conversations.where("conv_id is not null").select("conv_id", "turn", digest.alias("digest"), n_words(F.col("text")).alias("words"))
    placed = saved(numbered(saved(each, "digests"), F.struct("conv_id", "turn", "digest")), "placed")
    known = saved(placed.groupBy("digest").agg(F.min("words").alias("words")).withColumn("turn_id", F.monotonically_increasing_id()), "dictionary")
    starts = placed.groupBy("conv_id").agg(F.min("place").alias("start"))
    rows = placed.select("conv_id", "place", "digest").join(known, "digest").join(starts, "conv_id")
    return rows.select("conv_id", (F.col("place") - F.col("start") + 1).alias("pos"), "turn_id", "words")


def rebuilt(turns: DataFrame) -> DataFrame:
    """Each conversation with the first h turns of its family's first: conv_id, piece, ids, words (arrays of PIECE at most), ended."""
    h = (crc_of_id(F.col("conv_id")) % HEADS).cast("int")
    turns = saved(turns, "turns")
    heads = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < HEADS)).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "turn_id", "words"))).alias("head"))
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).join(heads, "base", "left")
    head = F.slice(F.coalesce("head", F.array().cast("array<struct<pos:long,turn_id:long,words:long>>")), F.lit(1), h)
    convs = saved(convs.select("conv_id", head.alias("head"), (F.size(head) + F.greatest(F.lit(0), F.col("n") - h)).alias("length")), "conversations")
    own = turns.where(F.col("pos") > h).join(convs.select("conv_id", F.size("head").alias("shift")), "conv_id").select("conv_id", (F.col("pos") - h + F.col("shift")).alias("pos"), "turn_id", "words")
    first = convs.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.pos", "t.turn_id", "t.words")
    pieces = own.unionByName(first).groupBy("conv_id", F.floor((F.col("pos") - 1) / PIECE).alias("piece")).agg(F.sort_array(F.collect_list(F.struct("pos", "turn_id", "words"))).alias("p"))
    pieces = pieces.join(convs.select("conv_id", "length"), "conv_id").select("conv_id", "piece", F.col("p.turn_id").alias("ids"), F.col("p.words").alias("words"), (F.col("length") <= (F.col("piece") + 1) * PIECE).alias("ended"))
    none = F.array().cast("array<long>")
    return pieces.unionByName(convs.where("length = 0").select("conv_id", F.lit(0).cast("long").alias("piece"), none.alias("ids"), none.alias("words"), F.lit(True).alias("ended")))


def joined_digests(members: DataFrame) -> DataFrame:
    """members (string_id, conv_id) to string_id and the SHA-256 of its ids in ascending order, joined by commas."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        now, ids = None, []

        def out() -> pa.RecordBatch:
            b = pa.record_batch({"string_id": [now], "least": [ids[0]], "joined": [",".join(map(str, ids))]})
            ids.clear()
            return b

        for batch in batches:
            for s, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (s != now or len(ids) >= JOINED):
                    yield out()
                now = s
                ids.append(c)
        if ids:
            yield out()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            for s, part in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if s != now:
                    if digest:
                        yield pa.record_batch({"string_id": [now], "ends": [digest.hexdigest()]})
                    now, digest = s, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(part.encode())
        if digest:
            yield pa.record_batch({"string_id": [now], "ends": [digest.hexdigest()]})

    ordered = saved(members, "members").repartitionByRange("string_id", "conv_id").sortWithinPartitions("string_id", "conv_id")
    parts = saved(ordered.mapInArrow(joined, "string_id long, least long, joined string"), "joined")
    return parts.repartition("string_id").sortWithinPartitions("string_id", "least").mapInArrow(hashed, "string_id long, ends string")


class SearchTree:
    """A ternary search tree of strings of numbers. Each node is one of the trie: `up` is the node of the string without its last number."""

    def __init__(self) -> None:
        self.split: list[int] = []
        self.low: list[int] = []
        self.high: list[int] = []
        self.equal: list[int] = []
        self.up: list[int] = []
        self.weight: list[int] = []
        self.first = -1

    def _new(self, key: int, up: int, weight: int) -> int:
        for column, value in ((self.split, key), (self.low, -1), (self.high, -1), (self.equal, -1), (self.up, up), (self.weight, weight)):
            column.append(value)
        return len(self.split) - 1

    def insert(self, keys: list[int], weights: list[int]) -> int:
        """The node of a string that isn't empty."""
        up = -1
        for key, weight in zip(keys, weights, strict=True):
            at = self.first if up < 0 else self.equal[up]
            if at < 0:
                at = self._new(key, up, weight)
                if up < 0:
                    self.first = at
                else:
                    self.equal[up] = at
            while key != self.split[at]:
                side = self.low if key < self.split[at] else self.high
                if side[at] < 0:
                    side[at] = self._new(key, up, weight)
                at = side[at]
            up = at
        return up


def middle_first(n: int) -> Iterator[int]:
    """0 to n - 1, each range's middle before its halves."""
    todo = [(0, n)]
    while todo:
        low, high = todo.pop()
        if low < high:
            mid = (low + high) // 2
            yield mid
            todo += [(low, mid), (mid + 1, high)]


def shard_nodes(strings: list[dict], deeper: bool) -> dict[str, list]:
    """Rows of _NODES for the ordered, distinct strings of a shard. deeper: a level below the first, where the class stands for the node."""
    tree = SearchTree()
    end = [0] * len(strings)
    for i in middle_first(len(strings)):
        s = strings[i]
        end[i] = tree.insert([s["class"], *s["ids"]], [0, *s["words"]])
    size = len(tree.split)
    n, children, leaves, saved_, below = ([0] * size for _ in range(5))
    least = [np.iinfo(np.int64).max] * size
    ends: list[str | None] = [None] * size
    for i, s in zip(end, strings, strict=True):
        n[i], least[i], ends[i] = s["n"], s["least"], s["ends"]
        below[i], leaves[i], saved_[i] = s["below_children"], s["below_leaves"], s["below_saved"]
    boundary: dict[int, tuple[bytes, ...]] = {}
    for i in (end[0], end[-1]):
        path = [i]
        while tree.up[path[-1]] >= 0:
            path.append(tree.up[path[-1]])
        keys: tuple[bytes, ...] = ()
        for x in reversed(path):
            keys += (hashlib.blake2b((keys[-1] if keys else b"") + tree.split[x].to_bytes(8, "little", signed=True), digest_size=16).digest(),)
            boundary[x] = keys
    depth = [1] * size
    for x, u in enumerate(tree.up):
        if u >= 0:
            depth[x] = depth[u] + 1
    has_child = [b > 0 for b in below]
    for x in range(size - 1, -1, -1):  # a node is made after the one above it
        children[x] += below[x]
        u = tree.up[x]
        if deeper and u < 0:
            least[x] = tree.split[x]
        if u >= 0:
            has_child[u] = True
            n[u] += n[x]
            least[u] = min(least[u], least[x])
        if x not in boundary:
            leaves[x] += not has_child[x]
            saved_[x] += (n[x] - 1) * tree.weight[x]
            if u >= 0:
                children[u] += 1
                leaves[u] += leaves[x]
                saved_[u] += saved_[x]
    known = [u >= 0 and u not in boundary for u in tree.up]
    return {
        "key": [boundary[x][-1] if x in boundary else None for x in range(size)],
        "path": [list(boundary[x]) if x in boundary else None for x in range(size)],
        "parent_key": [boundary[u][-1] if u in boundary else None for u in tree.up],
        "depth": depth, "least": least, "parent_least": [least[u] if k else None for u, k in zip(tree.up, known, strict=True)],
        "class": [tree.split[x] if tree.up[x] < 0 else None for x in range(size)],
        "n": n, "children": children, "has_child": has_child, "leaves": leaves, "saved": saved_, "words": tree.weight, "ends": ends,
    }


def _sharded(deeper: bool):
    schema = pa.schema(
        [("key", pa.binary()), ("path", pa.list_(pa.binary())), ("parent_key", pa.binary()), ("depth", pa.int32()), ("least", pa.int64()), ("parent_least", pa.int64()), ("class", pa.int64()), ("n", pa.int64()), ("children", pa.int64()),
         ("has_child", pa.bool_()), ("leaves", pa.int64()), ("saved", pa.int64()), ("words", pa.int64()), ("ends", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        strings = [s for b in batches for s in b.to_pylist()]  # a shard is bounded by its turns
        if strings:
            yield from pa.table(shard_nodes(strings, deeper), schema=schema).to_batches(max_chunksize=50_000)

    return run


def merged(nodes: DataFrame) -> DataFrame:
    """Nodes of all shards, boundary nodes once: depth, least, parent_least, class, n, children, leaves, saved, ends."""
    inner = nodes.where("key is null")
    b = nodes.where("key is not null").groupBy("key").agg(
        F.first("path").alias("path"), F.first("parent_key").alias("parent_key"), F.first("depth").alias("depth"), F.min("least").alias("least"), F.first("class").alias("class"), F.sum("n").alias("n"),
        F.sum("children").alias("children"), F.max("has_child").alias("has_child"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.first("words").alias("words"), F.max("ends").alias("ends"),
    )
    b = saved(b, "boundary")
    own = b.select("depth", F.posexplode("path").alias("at", "key"), (F.col("leaves") + (~F.col("has_child")).cast("long")).alias("leaves"), (F.col("saved") + (F.col("n") - 1) * F.col("words")).alias("saved"))
    sums = own.groupBy("key").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.sum((F.col("at") == F.col("depth") - 2).cast("long")).alias("more"))
    b = saved(b.drop("leaves", "saved").join(sums, "key").withColumn("children", F.col("children") + F.col("more")), "merged")
    both = inner.select("parent_key", "depth", "least", "parent_least", "class", "n", "children", "leaves", "saved", "ends").unionByName(
        b.select("parent_key", "depth", "least", F.lit(None).cast("long").alias("parent_least"), "class", "n", "children", "leaves", "saved", "ends")
    )
    above = b.select(F.col("key").alias("above_key"), F.col("least").alias("above"))
    both = join_small(both, above, F.col("parent_key") == F.col("above_key"))
    return both.withColumn("parent_least", F.coalesce("parent_least", "above")).drop("parent_key", "above_key", "above")


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    pieces = saved(rebuilt(numbered_turns(conversations)), "pieces")
    deepest = pieces.agg(F.max("piece")).first()[0]
    found = []
    now = pieces.where("piece = 0").withColumn("class", F.lit(0).cast("long"))
    for level in range((deepest or 0) + 1):
        strings = now.groupBy("class", "ids").agg(
            F.first("words").alias("words"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), F.sum(F.col("ended").cast("long")).alias("n_ended"), F.min(F.when(F.col("ended"), F.col("conv_id"))).alias("one")
        )
        strings = saved(strings, f"strings{level}")
        members = saved(now.select("conv_id", "class", "ids", "ended").join(strings.select("class", "ids", "least", "n_ended"), ["class", "ids"]).select("conv_id", F.col("least").alias("string_id"), "ended", "n_ended"), f"strings_of{level}")
        several = joined_digests(members.where("ended and n_ended > 1").select("string_id", "conv_id")).withColumnRenamed("string_id", "least")
        ends = F.when(F.col("n_ended") == 0, _EMPTY).when(F.col("n_ended") == 1, F.sha2(F.col("one").cast("string"), 256)).otherwise(F.col("ends"))
        found.append(saved(strings.join(several, "least", "left").select("class", "ids", "words", "n", "least", ends.alias("ends")), f"ended{level}"))
        if level < (deepest or 0):
            going = members.where(~F.col("ended")).select("conv_id", F.col("string_id").alias("class"))
            now = saved(pieces.where(F.col("piece") == level + 1).join(going, "conv_id"), f"pieces{level + 1}")
    below: DataFrame | None = None
    out: DataFrame | None = None
    for level in range(deepest or 0, -1, -1):
        strings = found[level]
        if below is None:
            strings = strings.select("*", *[F.lit(0).cast("long").alias(c) for c in ("below_children", "below_leaves", "below_saved")])
        else:
            full = (F.size("ids") == PIECE) & (F.col("least") == F.col("above"))
            strings = strings.join(below, full, "left").drop("above").fillna(0, ["below_children", "below_leaves", "below_saved"])
        turns = strings.agg(F.sum(F.size("ids") + 1)).first()[0] or 0
        shards = max(1, -(-turns // SHARD))
        dealt = saved(strings, "dealt").repartitionByRange(shards, "class", "ids").sortWithinPartitions("class", "ids")
        nodes = saved(merged(saved(dealt.mapInArrow(_sharded(level > 0), _NODES), "shards")), f"nodes{level}")
        rows = nodes if level == 0 else nodes.where("depth > 1")
        rows = rows.select(
            F.col("least").alias("conv_id"), (F.col("depth") - 1 + level * PIECE).cast("long").alias("depth"), F.col("parent_least").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
            F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(_EMPTY)).alias("ends_sha256"),
        )
        out = rows if out is None else out.unionByName(rows)
        below = nodes.where("depth = 1").select(F.col("class").alias("above"), F.col("children").alias("below_children"), F.col("leaves").alias("below_leaves"), F.col("saved").alias("below_saved"))
    return out


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


_CRC_SQL = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, x: xor(a >> 8, tab[CAST((xor(a, x) & 255) + 1 AS BIGINT)])), CAST(4294967295 AS BIGINT))"

ORACLE_SQL = rf"""WITH k AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, CAST(3988292384 AS BIGINT)) ELSE a >> 1 END)) AS tab),
e AS (SELECT conv_id, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS t, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({{'t': t, 'w': w}} ORDER BY turn NULLS FIRST, t) AS s FROM e GROUP BY conv_id),
c AS (SELECT o.conv_id, o.s, {_CRC_SQL.replace("conv_id", "o.conv_id")} % 4 AS h, b.s AS bs FROM o CROSS JOIN k LEFT JOIN o b ON b.conv_id = o.conv_id - o.conv_id % 20),
r AS (SELECT conv_id, list_concat(coalesce(bs[1:h], []), s[h + 1:]) AS s FROM c),
p AS (SELECT conv_id, d, s[1:d] AS x, len(s) = d AS ended FROM (SELECT *, unnest(generate_series(0, len(s))) AS d FROM r)),
n AS (SELECT x, d, min(conv_id) AS conv_id, count(*) AS n, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ended), '') AS ends FROM p GROUP BY x, d),
u AS (SELECT x[1:d - 1] AS x, count(*) AS children FROM n WHERE d > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(children, 0) AS children, CASE WHEN d > 0 THEN (n - 1) * x[d].w ELSE 0 END AS own FROM n LEFT JOIN u USING (x)),
z AS (SELECT x[1:j] AS x, sum(CAST(children = 0 AS BIGINT)) AS leaves, sum(own) AS saved FROM (SELECT *, unnest(generate_series(0, d)) AS j FROM m) GROUP BY ALL)
SELECT m.conv_id, CAST(m.d AS BIGINT) AS depth, q.conv_id AS parent_conv_id, m.n AS n_convs, m.children AS n_children, CAST(z.leaves AS BIGINT) AS n_leaves, CAST(z.saved AS BIGINT) AS saved_tokens, sha256(m.ends) AS ends_sha256
FROM m JOIN z USING (x) LEFT JOIN n q ON m.d > 0 AND q.x = m.x[1:m.d - 1]"""
