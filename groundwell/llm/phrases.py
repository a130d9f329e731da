"""Phrases that recur, from a weighted de Bruijn graph of word 4-grams.

The graph's edges are 4-grams, from the node of their first three words to that of their last three. Every word of a text
begins one window: the four words from it on, or fewer where its piece ends. Windows are counted where they are read, sorted,
and dealt out by ranges of their order, so that an edge, its nodes and all that begins alike stand side by side. In a range a
node's count is the flow out of it (its edges' weights) and the piece ends among its windows; the counts of two words and of
one follow in the same way from those above. What begins alike and lies across ranges is in the first or last rows of a range,
and is added up afterwards: a word, a pair or a node may hold any share of all windows.
Edges that are candidates make the heavy part of the graph. Its unary paths (nodes with one edge in and one out) are compacted
by pointer doubling, and a path tells each of its shorter phrases the largest weight of the edges that cover it, once.

Counts are exact: windows are compared whole, scores and shares are decimals.

Defined cases: a null or blank text has no words; a null lang is `und`, as is that text itself; repeated rows count as often
as they stand; an empty table gives an empty result; a text of any length is cut between pieces, and one piece stays whole
in memory. Only lang and text are looked at. The ranges' bounds come from a sample of rows; results don't depend on it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_worker, join_small, saved, table
from .mixing import numbered

LONGEST = 4
LEAST = 30
TOP = 2000
SCALE = 2_000_000
#: Bytes of text whose windows are counted at once, and whose windows a range has.
FLUSH, RANGE = 3 << 20, 5 << 20
RANGES = 1_000_000
#: Bytes of the texts that the ranges' bounds are taken from, and keys for each range.
SAMPLE, KEYS = 32 << 20, 20
PIECE_BREAKS = b".,;:!?\n\x0b\x0c\r"
PATH_PIECE = 256
#: Parts of a language that are ranked by themselves before all of it is.
PARTS = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, dtype=np.uint8)  # 0 in a word, 1 blank, 2 end of a piece
_KIND[list(b" \t")] = 1
_KIND[list(PIECE_BREAKS)] = 2


def _slices(flat: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """flat[begin:end] for each pair, as binary strings; slices may overlap."""
    length = end - begin
    ends = np.cumsum(length)
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    at = np.arange(offsets[-1], dtype=np.int64) + np.repeat(begin - offsets[:-1], length)
    return pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(flat[at])])


def windows(text: bytes) -> pa.Array:
    """For each word its window: up to four words of the same piece, each with a blank behind it."""
    raw = np.frombuffer(text + b"\n", dtype=np.uint8)
    kind = _KIND[raw]
    word = kind == 0
    closes = ~word & np.concatenate([[False], word[:-1]])  # the first byte behind a word
    kept = word | closes
    flat = np.where(closes, np.uint8(32), _LOWER[raw])[kept]
    last = np.flatnonzero(flat == 32) + 1
    first = np.concatenate([[0], last[:-1]]).astype(np.int64)
    piece = np.cumsum(kind == 2)[np.flatnonzero(closes) - 1]
    n = len(last)
    if not n:
        return pa.array([], pa.binary())
    piece_last = np.searchsorted(piece, piece, side="right") - 1
    return _slices(flat, first, last[np.minimum(np.arange(n) + LONGEST - 1, piece_last)])


def _cut(text: bytes) -> Iterator[bytes]:
    """A text in blocks of about FLUSH bytes, cut between pieces."""
    while len(text) > FLUSH:
        at = max(text.rfind(bytes([b]), 0, FLUSH) for b in PIECE_BREAKS)
        if at < 0:
            at = min((x for b in PIECE_BREAKS if (x := text.find(bytes([b]), FLUSH)) >= 0), default=-1)
        if at < 0:
            break
        yield text[: at + 1]
        text = text[at + 1 :]
    yield text


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """lang and joined texts of about FLUSH bytes; columns lang and text."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            for block in _cut(text.as_py() or b""):
                held.setdefault(lang, []).append(block)
                size[lang] = size.get(lang, 0) + len(block) + 1
                if size[lang] >= FLUSH:
                    yield lang, b"\n".join(held.pop(lang))
                    size.pop(lang)
            if sum(size.values()) > 4 * FLUSH:  # many languages
                for x in list(held):
                    yield x, b"\n".join(held.pop(x))
                size.clear()
    for lang, parts in held.items():
        yield lang, b"\n".join(parts)


def _summed(grams: pa.Array, n: pa.Array | None = None) -> tuple[pa.Array, np.ndarray]:
    """Distinct windows in order and how often each is there."""
    t = pa.table({"g": grams, "n": pa.array(np.ones(len(grams), np.int64)) if n is None else n}).group_by("g").aggregate([("n", "sum")])
    t = t.take(pc.sort_indices(t["g"])).combine_chunks()
    g = t["g"].combine_chunks()
    return g, t["n_sum"].to_numpy()


def _packed(grams: pa.Array, n: np.ndarray) -> bytes:
    offsets = np.frombuffer(grams.buffers()[1], np.int32)[grams.offset : grams.offset + len(grams) + 1]
    flat = memoryview(grams.buffers()[2])[offsets[0] : offsets[-1]]
    return zstandard.compress(b"".join([len(grams).to_bytes(4, "little"), np.diff(offsets).astype("<i4").tobytes(), n.astype("<i8").tobytes(), flat]), 1)


def _unpacked(blob: bytes) -> tuple[pa.Array, np.ndarray]:
    raw = zstandard.decompress(blob)
    n = int.from_bytes(raw[:4], "little")
    offsets = np.concatenate([[0], np.cumsum(np.frombuffer(raw, "<i4", n, 4))]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(raw[4 + 12 * n :])]), np.frombuffer(raw, "<i8", n, 4 + 4 * n)


def range_bounds(docs: DataFrame, size: int, ranges: int) -> list[tuple[str, bytes]]:
    """The first (lang, window) of each range but the first, from windows of a sample of rows."""
    share = min(1.0, SAMPLE / max(1, size))
    step = max(1, int(size * share / 6 / (KEYS * ranges)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        for lang, text in _blocks(batches):
            some = windows(text)[step // 2 :: step]
            yield pa.record_batch({"lang": pa.array([lang] * len(some), pa.string()), "gram": some})

    rows = docs if share == 1.0 else docs.sample(share, 13)
    keys = numbered(rows.mapInArrow(run, "lang string, gram binary"), F.struct("lang", "gram"))
    every = max(1, -(-keys.count() // ranges))
    found = keys.where(F.col("place") % every == every - 1).select("lang", "gram").distinct().collect()  # a key for each range
    return sorted((r.lang, bytes(r.gram)) for r in found)


def _scattered(bounds: list[tuple[str, bytes]]):
    """Windows of the texts, counted and packed by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_worker()
        for lang, text in _blocks(batches):
            grams, n = _summed(windows(text))
            if not len(grams):
                continue
            low, high = bisect_left(bounds, (lang, b"")), bisect_left(bounds, (lang + "\0", b""))
            cuts = [0] + [_place(grams, b) for _, b in bounds[low:high]] + [len(grams)]
            out = [(low + k, lang, _packed(grams[a:b], n[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.string(), pa.binary()), strict=True)], names=["range", "lang", "windows"])

    return run


def _place(grams: pa.Array, bound: bytes) -> int:
    """How many of the ordered windows are less than bound."""
    low, high = 0, len(grams)
    while low < high:
        mid = (low + high) // 2
        if grams[mid].as_py() < bound:
            low = mid + 1
        else:
            high = mid
    return low


def flows(grams: pa.Array, n: np.ndarray) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray]]:
    """Of ordered windows with counts: for each number of words the phrases that windows begin with, their counts, and which may go on in another range."""
    offsets = np.frombuffer(grams.buffers()[1], np.int32)[grams.offset : grams.offset + len(grams) + 1].astype(np.int64)
    flat = np.frombuffer(grams.buffers()[2], np.uint8)
    blanks = np.flatnonzero(flat == 32)
    begin = np.searchsorted(blanks, offsets[:-1])
    has = np.searchsorted(blanks, offsets[1:]) - begin
    same = np.ones(len(grams) - 1, bool)  # as the row before, so far
    word = offsets[:-1].copy()
    for k in range(1, LONGEST + 1):
        there = has >= k
        end = np.where(there, blanks[np.minimum(begin + k - 1, len(blanks) - 1)] + 1, word)
        each = _slices(flat, word, end)
        same &= there[1:] & there[:-1] & pc.equal(each[1:], each[:-1]).to_numpy(zero_copy_only=False)
        first = there & ~np.concatenate([[False], same])
        at = np.flatnonzero(first)
        if not len(at):
            return
        # rows without a k-th word stand at the end of no group: they are left out of the sums
        total = np.add.reduceat(np.where(there, n, 0), at)
        edge = np.zeros(len(at), bool)
        edge[[0, -1]] = True
        yield k, _slices(flat, offsets[at], end[at] - 1), total, edge
        word = end


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, lang, windows) in order to lang, k, phrase, f: what recurs, what may go on elsewhere, and with k = 0 how many words there are."""
    free_worker()
    held: list[tuple[pa.Array, np.ndarray]] = []
    key = None

    def out() -> Iterator[pa.RecordBatch]:
        lang = key[1]
        grams, n = _summed(pa.concat_arrays([g for g, _ in held]), pa.array(np.concatenate([x for _, x in held])))
        held.clear()
        yield pa.record_batch({"lang": [lang], "k": pa.array([0], pa.int32()), "phrase": [""], "f": [int(n.sum())]})
        for k, phrases, f, edge in flows(grams, n):
            keep = np.flatnonzero(edge | (f >= LEAST))
            yield pa.record_batch({"lang": pa.array([lang] * len(keep), pa.string()), "k": pa.array([k] * len(keep), pa.int32()), "phrase": phrases.take(pa.array(keep)).cast(pa.string()), "f": f[keep]})

    for batch in batches:
        for r, lang, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != (r, lang):
                if held:
                    yield from out()
                key = (r, lang)
            held.append(_unpacked(blob))
    if held:
        yield from out()


def phrase_counts(docs: DataFrame) -> DataFrame:
    """docs (lang, text) to lang, k, phrase, f: all phrases of k words that are there LEAST times, and with k = 0 the words of the language."""
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, min(RANGES, -(-size // RANGE)))
    bounds = range_bounds(docs, size, ranges) if ranges > 1 else []
    shared = docs.sparkSession.sparkContext.broadcast(bounds)  # RANGES keys at most
    counted = docs.mapInArrow(lambda batches: _scattered(shared.value)(batches), "range int, lang string, windows binary")
    ordered = counted.repartitionById(len(bounds) + 1, F.col("range")).sortWithinPartitions("range", "lang")
    rows = saved(ordered.mapInArrow(_gathered, "lang string, k int, phrase string, f long"), "ranges")
    return saved(rows.groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= LEAST) | (F.col("k") == 0)), "counts")


def first_words(phrase: Column, k: Column | int) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), 1, k), " ")


def last_words(phrase: Column, k: Column | int) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), -k, k), " ")


def compacted(edges: DataFrame) -> DataFrame:
    """edges (lang, phrase, f) of four words to paths: lang, head (a path's number), piece, words and weights (one less by three). Edges of a circle are paths of one."""
    edges = saved(edges.select("lang", "phrase", "f", F.monotonically_increasing_id().alias("edge")), "edges")
    ends = lambda node, name: edges.groupBy("lang", node.alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("edge").alias(name)).where("n = 1").drop("n")
    unary = ends(last_words(F.col("phrase"), 3), "before").join(ends(first_words(F.col("phrase"), 3), "edge"), ["lang", "node"]).where("edge <> before").select("edge", "before")
    # a head points at itself; each turn doubles how far the others see
    at = saved(edges.select("edge").join(unary, "edge", "left").select("edge", F.coalesce("before", "edge").alias("to"), F.col("before").isNotNull().cast("long").alias("far"), F.col("before").isNull().alias("done")), "pointers")
    left = None
    while (now := at.where("not done").count()) and now != left:
        left = now
        seen = at.select(F.col("edge").alias("to"), F.col("to").alias("next"), F.col("far").alias("more"), F.col("done").alias("ended"))
        at = saved(at.join(seen, "to").select("edge", F.when(F.col("done"), F.col("to")).otherwise(F.col("next")).alias("to"), F.when(F.col("done"), F.col("far")).otherwise(F.col("far") + F.col("more")).alias("far"), (F.col("done") | F.col("ended")).alias("done")), "pointers")
    # what is open still goes round in circles
    at = at.select("edge", F.when(F.col("done"), F.col("to")).otherwise(F.col("edge")).alias("head"), F.when(F.col("done"), F.col("far")).otherwise(0).alias("far"))
    rows = edges.join(at, "edge").groupBy("lang", "head", F.floor(F.col("far") / PATH_PIECE).alias("piece")).agg(F.sort_array(F.collect_list(F.struct("far", "phrase", "f"))).alias("p"))
    words = F.concat(F.split(F.col("p")[0]["phrase"], " "), F.transform(F.slice("p", F.lit(2), F.size("p")), lambda x: last_words(x["phrase"], 1)))
    return rows.select("lang", "head", "piece", words.alias("words"), F.col("p.f").alias("weights"))


def covered(paths: DataFrame) -> DataFrame:
    """Of each path the shorter phrases in it and the largest weight of the edges over each: lang, phrase, longer."""
    n = F.size("words")

    def of(k: int) -> Column:
        over = lambda i: F.array_max(F.slice("weights", F.greatest(F.lit(1), i + (k - LONGEST + 1)), F.least(F.size("weights"), i + 1) - F.greatest(F.lit(1), i + (k - LONGEST + 1)) + 1))
        return F.transform(F.sequence(F.lit(0), n - k), lambda i: F.struct(F.array_join(F.slice("words", i + 1, k), " ").alias("phrase"), over(i).alias("longer")))

    return paths.select("lang", F.explode(F.concat(of(2), of(3))).alias("c")).select("lang", "c.phrase", "c.longer")


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases."""
    counts = phrase_counts(docs)
    found = counts.where("k >= 2").select("lang", "k", "phrase", F.col("f").alias("a"))
    cuts = found.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "cut", first_words(F.col("phrase"), F.col("cut")).alias("left"), last_words(F.col("phrase"), F.col("k") - F.col("cut")).alias("right"))
    parts = saved(counts.where(f"k between 1 and {LONGEST - 1}").select(F.col("lang").alias("p_lang"), F.col("phrase").alias("part"), "f"), "parts")
    for side, name in (("left", "l"), ("right", "r")):
        own = parts.withColumnRenamed("f", name)
        cuts = join_small(cuts, own, (F.col("lang") == F.col("p_lang")) & (F.col(side) == F.col("part")), "inner").drop("p_lang", "part")
    score = F.expr(f"(cast(a as decimal(20,0)) * {SCALE}) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = saved(cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("b")), "scored")
    longer = covered(saved(compacted(counts.where(f"k = {LONGEST}")), "paths"))
    of_three = found.where("k = 3").select("lang", F.explode(F.array(first_words(F.col("phrase"), 2), last_words(F.col("phrase"), 2))).alias("phrase"), F.col("a").alias("longer"))
    longer = longer.unionByName(of_three).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    exact = lambda c, by: F.col(c).cast("decimal(20,0)") * by
    stays = best.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (exact("longer", 100) < exact("a", 80)))
    # first within parts of a language, so that what one task ranks in the end is bounded
    order = (F.desc("score"), F.desc("a"), F.col("phrase"))
    ranked = stays.select("lang", "phrase", "a", "b.l", "b.r", "b.score", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)).alias("part"))
    for by in (["lang", "part"], ["lang"]):
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    n = saved(counts.where("k = 0").select(F.col("lang").alias("n_lang"), F.col("f").alias("n")), "words")
    return join_small(ranked, n, F.col("lang") == F.col("n_lang"), "inner").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS ws FROM d),
s AS (SELECT lang, ws, unnest(generate_series(1, len(ws))) AS i FROM p),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM s, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(ws) GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM g WHERE k >= 2 AND f >= 30),
u AS (SELECT lang, k, phrase, a, ws, unnest(generate_series(1, k - 1)) AS cut FROM c),
x AS (SELECT u.*, l.f AS l, r.f AS r, CAST(2000000 AS HUGEINT) * a // (l.f + r.f) AS score FROM u
  JOIN g l ON l.lang = u.lang AND l.phrase = array_to_string(u.ws[1:u.cut], ' ') AND l.k = u.cut JOIN g r ON r.lang = u.lang AND r.phrase = array_to_string(u.ws[u.cut + 1:u.k], ' ') AND r.k = u.k - u.cut),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT *, unnest(generate_series(1, k - 1)) AS i FROM c), (SELECT unnest([2, 3]) AS m) WHERE m < k AND i + m - 1 <= k GROUP BY ALL),
z AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE longer IS NULL OR 100 * CAST(longer AS HUGEINT) < 80 * CAST(a AS HUGEINT))
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM z JOIN n USING (lang) WHERE rank <= 2000"""
