"""Toxicity: a bidirectional gated recurrent network with attention pooling, over character and word inputs.

A word's input is an embedding of the word itself (of a vocabulary from the sample; all others share one) beside the mean of
its character trigrams' embeddings. Windows of 24 words, 8 of them shared with the next, run through a GRU in both
directions; attention pools the states to one logit. A document's score is that of its highest window, over all windows.
The network is trained in numpy on the driver, in ROUNDS rounds: from a toxic document comes its most toxic window, from other
documents such windows and some by hash. In the first round the words' document counts rank a document's windows, in later
ones the network does, so that it meets what it got wrong.

Sample bound: PER_CLASS documents a class (of labels.toxic; four times that if hashes fall badly), WINDOWS windows of each;
vocabulary VOCABULARY words at most. Words over LONG bytes count as unknown words, but their characters are used: all of their
trigrams in scoring, and PLACES of them, evenly taken from all in order, in training, so that what the driver gets is bounded.

Defined cases: null, empty and blank texts are one window of padding and get its score; with no labelled rows of both kinds
every score is 0; very long texts are done in blocks, whose windows are those of the whole text; repeated rows are scored
alike; an empty table gives an empty result; a score of exactly 0.7 counts as toxic; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import crc_of_id, hash_sample, saved, table

SPAN = 24
STRIDE = 16
HIDDEN = 8
WORD_DIM = 8
CHAR_DIM = 8
TRIGRAMS = 2048
PER_CLASS = 1000
WINDOWS = 6
VOCABULARY = 20_000
LEAST_DOCS = 3
THRESHOLD = 0.7
ROUNDS = 3
UPDATES = 300
BATCH = 256
TOXIC_SHARE = 4
EMPTY_SHARE = 50
HELD_WORDS = 150_000
BLOCK_BYTES = 400_000
LONG = 64
PLACES = 64
_LOWER = bytes(range(256)).lower()
_DROPPED = bytes(b for b in range(128) if not chr(b).isalpha())


def normal(word: bytes) -> bytes:
    """ASCII letters in lower case, and all other letters as they are."""
    return word.translate(_LOWER, _DROPPED)


def window_blocks(text: str | None) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """The words of a text in blocks, with the places of the windows that begin there.

    Windows begin at every STRIDE-th word of the text, and one ends with its last word. A block begins with the last window
    of the one before, so that they are the same whatever the size of a block. A text of SPAN words or fewer is one window."""
    raw, at, held, first, some = (text or "").encode(), 0, [], 0, False
    while True:
        end = at + BLOCK_BYTES
        while end < len(raw) and raw[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        held += raw[at:end].split()
        starts = list(range(first, len(held) - SPAN + 1, STRIDE))
        latest = starts[-1] if starts else first - STRIDE if some else None
        if end >= len(raw):
            if latest is None:
                starts = [0]
            elif latest != len(held) - SPAN:
                starts.append(len(held) - SPAN)
        if starts:
            yield held, np.array(starts)
            some = True
        if end >= len(raw):
            return
        if latest is not None:
            held, first = held[latest:], STRIDE
        at = end


def shortened(word: bytes) -> bytes:
    """A normal word for training: one over LONG bytes as a zero byte (which no normal word has) and PLACES of its trigrams' places."""
    if len(word) <= LONG:
        return word
    places = np.sort(trigrams([word])[0])
    return b"\0" + places[np.linspace(0, len(places) - 1, PLACES).round().astype(int)].astype("<u2").tobytes()


def trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The places of all trigrams of normal or shortened words, one word after another, with ^ before and $ after it; and their number in each word."""
    short = {k for k, w in enumerate(words) if w[:1] == b"\0"}
    if short:
        grams, size = trigrams([b"" if k in short else w for k, w in enumerate(words)])
        each = [np.frombuffer(words[k][1:], "<u2").astype(grams.dtype) if k in short else g for k, g in enumerate(np.split(grams, np.cumsum(size)[:-1]))]
        return np.concatenate(each), np.array([len(g) for g in each])
    marked = [b"^" + w + b"$" if w else b"^$$" for w in words]
    flat = np.frombuffer(b"".join(marked), dtype=np.uint8).astype(np.uint32)
    size = np.array([len(w) for w in marked])
    h = flat.copy()
    h[:-2] = (flat[:-2] * np.uint32(961) + flat[1:-1] * np.uint32(31) + flat[2:]) * np.uint32(2654435761) >> np.uint32(21)
    held = np.ones(len(flat), dtype=bool)
    ends = np.cumsum(size)
    held[ends - 1] = held[ends - 2] = False
    return h[held], size - 2


class Words:
    """Normal words by number: their rows in the word table, and their trigrams. None is padding."""

    def __init__(self, rows: np.ndarray, grams: np.ndarray, size: np.ndarray) -> None:
        self.rows, self.grams, self.size = rows, grams, size

    def take(self, which: np.ndarray) -> Words:
        size = self.size[which]
        ends = np.cumsum(size)
        first = (np.cumsum(self.size) - self.size)[which]
        return Words(self.rows[which], self.grams[np.repeat(first - ends + size, size) + np.arange(ends[-1])], size)


def summed(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The sums of the rows of values by at, as n rows."""
    out = np.zeros((n, values.shape[1]), dtype=values.dtype)
    if len(at):
        order = np.argsort(at, kind="stable")
        ids, first = np.unique(at[order], return_index=True)
        out[ids] = np.add.reduceat(values[order], first, axis=0)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Row 0 of the word table is padding, row 1 all unknown words."""

    def __init__(self, odds: dict[bytes, float], seed: int = 1) -> None:
        """odds: the vocabulary, with what a word says of its document; the word table begins with it."""
        vocabulary = sorted(odds)
        rng = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        small = lambda *shape, by=0.3: (rng.standard_normal(shape) * by).astype(np.float32)
        self.rows = {w: k + 2 for k, w in enumerate(vocabulary)}
        words = small(len(vocabulary) + 2, WORD_DIM, by=0.1)
        words[2:, 0] = [odds[w] / 2 for w in vocabulary]
        self.p = {"word": words, "char": small(TRIGRAMS, CHAR_DIM), "wx": small(2, d, 3 * h), "bx": np.zeros((2, 1, 3 * h), np.float32), "u": small(2, h, 3 * h), "att": small(2 * h), "out": small(2 * h), "bias": np.zeros(1, np.float32)}

    def known(self, words: list[bytes | None]) -> Words:
        return Words(np.array([0 if w is None else self.rows.get(w, 1) for w in words]), *trigrams([w or b"" for w in words]))

    def inputs(self, words: Words) -> np.ndarray:
        chars = np.add.reduceat(self.p["char"][words.grams], np.cumsum(words.size) - words.size, axis=0) / words.size[:, None].astype(np.float32)
        return np.concatenate([self.p["word"][words.rows], chars], axis=1)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Inputs (n, d) to the gates of both directions (n, 2, 3h)."""
        return np.stack([x @ self.p["wx"][k] + self.p["bx"][k] for k in range(2)], axis=1)

    def states(self, gates: np.ndarray, keep: list | None = None) -> np.ndarray:
        """gates (T, 2, B, 3h), the second direction already turned round, to states (T, 2, B, h)."""
        h = HIDDEN
        state = np.zeros((*gates.shape[1:3], h), np.float32)
        out = np.empty((*gates.shape[:3], h), np.float32)
        for t, g in enumerate(gates):
            a = state @ self.p["u"]
            zr = _sigmoid(g[..., : 2 * h] + a[..., : 2 * h])
            z, r = zr[..., :h], zr[..., h:]
            n = np.tanh(g[..., 2 * h :] + r * a[..., 2 * h :])
            if keep is not None:
                keep.append((state, z, r, n, a[..., 2 * h :]))
            state = n + z * (state - n)
            out[t] = state
        return out

    def pooled(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both directions' states in word order (T, B, 2h), the attention (T, B) and its mean (B, 2h)."""
        both = np.concatenate([states[:, 0], states[::-1, 1]], axis=2)
        s = both @ self.p["att"]
        a = np.exp(s - s.max(axis=0))
        a /= a.sum(axis=0)
        return both, a, np.einsum("tb,tbh->bh", a, both)

    def logits(self, table: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """table: gates of words (n, 2, 3h); windows: rows of it (B, T)."""
        turned = windows.T
        gates = np.stack([table[turned, 0], table[turned[::-1], 1]], axis=1)
        return self.pooled(self.states(gates))[2] @ self.p["out"] + self.p["bias"]

    def gradients(self, words: Words, windows: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """windows: numbers of words."""
        p, h = self.p, HIDDEN
        x = self.inputs(words)
        turned = windows.T
        gates = np.stack([(g := self.project(x))[turned, 0], g[turned[::-1], 1]], axis=1)
        kept: list = []
        states = self.states(gates, kept)
        both, a, c = self.pooled(states)
        error = (_sigmoid(c @ p["out"] + p["bias"]) - y) / len(y)
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        grad["out"], grad["bias"] = c.T @ error, error.sum(keepdims=True)
        dc = error[:, None] * p["out"]
        da = np.einsum("bh,tbh->tb", dc, both)
        ds = a * (da - (a * da).sum(axis=0))
        grad["att"] = np.einsum("tb,tbh->h", ds, both)
        dboth = a[..., None] * dc + ds[..., None] * p["att"]
        dstates = np.stack([dboth[..., :h], dboth[::-1, :, h:]], axis=1)
        dgates = np.empty_like(gates)
        carried = np.zeros_like(dstates[0])
        for t in range(len(gates) - 1, -1, -1):
            before, z, r, n, an = kept[t]
            d = dstates[t] + carried
            dz = d * (before - n) * z * (1 - z)
            dn = d * (1 - z) * (1 - n * n)
            dr = dn * an * r * (1 - r)
            through = np.concatenate([dz, dr, dn * r], axis=2)
            dgates[t] = np.concatenate([dz, dr, dn], axis=2)
            carried = d * z + through @ p["u"].transpose(0, 2, 1)
            grad["u"] += before.transpose(0, 2, 1) @ through
        dx = np.zeros_like(x)
        for k, at in enumerate((turned, turned[::-1])):
            d = summed(at.ravel(), dgates[:, k].reshape(-1, 3 * h), len(x))
            grad["wx"][k] = x.T @ d
            grad["bx"][k] = d.sum(axis=0)
            dx += d @ p["wx"][k].T
        grad["word"] = summed(words.rows, dx[:, :WORD_DIM], len(p["word"]))
        grad["char"] = summed(words.grams, np.repeat(dx[:, WORD_DIM:] / words.size[:, None], words.size, axis=0), TRIGRAMS)
        return grad

    def train(self, windows: list[list[bytes]], y: np.ndarray, seed: int = 2) -> None:
        """Adam over batches with a fixed share of toxic windows. One in EMPTY_SHARE of the clean ones is empty, as texts may be."""
        rng = np.random.default_rng(seed)
        windows, y = [*windows, []], np.append(y, 0)
        number: dict[bytes | None, int] = {None: 0}
        ids = np.zeros((len(windows), SPAN), dtype=int)
        for k, w in enumerate(windows):
            ids[k, : len(w)] = [number.setdefault(x, len(number)) for x in w]
        words = self.known(list(number))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        kinds = [np.flatnonzero(y == k) for k in (0, 1)]
        kinds[0] = np.append(kinds[0], np.full(len(kinds[0]) // EMPTY_SHARE, len(y) - 1))
        for step in range(1, UPDATES + 1):
            pick = np.concatenate([rng.choice(k, n) for k, n in zip(kinds, (BATCH - BATCH // TOXIC_SHARE, BATCH // TOXIC_SHARE), strict=True)])
            used, own = np.unique(ids[pick], return_inverse=True)
            rate = 0.02 * min(1.0, 2 * (1 - step / (UPDATES + 1)))
            for name, g in self.gradients(words.take(used), own.reshape(BATCH, SPAN), y[pick].astype(np.float32)).items():
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.99 * v[name] + 0.01 * g * g
                self.p[name] = (self.p[name] - rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)


class Scorer:
    """Scores texts; the gates of words that were met lately are kept."""

    def __init__(self, net: Network) -> None:
        self.net = net
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.gates = self._gates([None])

    def _gates(self, words: list[bytes | None]) -> np.ndarray:
        return self.net.project(self.net.inputs(self.net.known(words)))

    def _ids(self, words: list[bytes]) -> np.ndarray:
        known, get = self.known, self.known.get
        out = [get(w) for w in words]
        if None in out:
            new: dict[bytes, int] = {}
            base = len(known) + 1
            out = [k if k is not None else new.setdefault(w, base + len(new)) for k, w in zip(out, words, strict=True)]
            known.update(new)
            self.fresh += new
        return np.array(out, dtype=np.int32)

    def windows_logits(self, words: list[bytes], starts: np.ndarray) -> np.ndarray:
        """Of normal words; for training."""
        words = [*words, *[None] * (SPAN - len(words))]
        return self.net.logits(self._gates(words), starts[:, None] + np.arange(SPAN))

    def scores(self, texts: pa.Array) -> list[float]:
        best = np.full(len(texts), -np.inf, dtype=np.float32)
        held, owner, count = [], [], 0
        self.fresh: list[bytes] = []

        def run() -> None:
            nonlocal held, owner, count
            if self.fresh:
                self.gates = np.concatenate([self.gates, self._gates([normal(w) for w in self.fresh])])
                self.fresh = []
            if count:
                windows, of = np.concatenate(held), np.repeat([k for k, _ in owner], [n for _, n in owner])
                for at in range(0, count, 4096):
                    np.maximum.at(best, of[at : at + 4096], self.net.logits(self.gates, windows[at : at + 4096]))
            held, owner, count = [], [], 0
            if len(self.known) > HELD_WORDS:
                self.clear()

        for k, t in enumerate(texts):
            for words, starts in window_blocks(t.as_py()):
                ids = self._ids(words)
                if len(ids) < SPAN:
                    ids = np.concatenate([ids, np.zeros(SPAN - len(ids), dtype=np.int32)])
                windows = ids[starts[:, None] + np.arange(SPAN)]
                held.append(windows)
                owner.append((k, len(windows)))
                count += len(windows)
                if count >= 16_384 or len(self.known) > HELD_WORDS:
                    run()
        run()
        return _sigmoid(best.astype(float)).tolist()


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    pool = labels.where(F.col("toxic").isin(0, 1) & (F.pmod(crc_of_id(F.col("doc_id")), F.lit(3)) != 1)).select("doc_id", "toxic")
    chosen = hash_sample(pool, ["toxic"], PER_CLASS, F.col("doc_id"), 11)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def _distinct_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for text, toxic in zip(b["text"], b["toxic"], strict=True):
            found = {normal(w) for words, _ in window_blocks(text) for w in words}
            yield pd.DataFrame({"word": sorted(w for w in found if 0 < len(w) <= LONG), "toxic": toxic})


def _ranked(net: Network | None, odds: dict[bytes, float]):
    """For each document of the sample its highest windows, by the network if there is one, or else by the words' odds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = net and Scorer(net)
        for b in batches:
            for text, toxic in zip(b["text"], b["toxic"], strict=True):
                held: list[tuple[float, int, list[bytes]]] = []
                seen = 0
                for words, at in window_blocks(text):
                    found = [normal(w) for w in words]
                    number = np.arange(seen, seen + len(at))
                    seen += len(at)
                    ends = np.minimum(at + SPAN, len(found))
                    if scorer:
                        value = scorer.windows_logits(found, at)
                    else:
                        each = np.array([max(0.0, odds.get(w, 0.0)) for w in found] or [0.0])
                        value = np.array([each[s : s + SPAN].max() for s in at])
                    held += [(-float(v), zlib.crc32(str(k).encode()), found[s:e]) for v, k, s, e in zip(value, number, at, ends, strict=True)]
                    held.sort(key=lambda x: x[:2])
                    held = held[:WINDOWS] + sorted(held[WINDOWS:], key=lambda x: x[1])[:WINDOWS]
                yield pd.DataFrame({"toxic": toxic, "words": [[shortened(x) for x in w] for _, _, w in held[: 1 if toxic else len(held)]]})

    return run


def learn(docs: DataFrame, labels: DataFrame) -> Network | None:
    """None if the sample lacks toxic or clean documents."""
    sample = saved(_sample(docs, labels), "toxicity-sample")
    sizes = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not (sizes.get(0) and sizes.get(1)):
        return None
    sample = sample.repartition(docs.sparkSession.sparkContext.defaultParallelism)  # a few files, which differ in size
    counts = sample.mapInPandas(_distinct_words, "word binary, toxic int").groupBy("word").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n"))
    common = counts.where(F.col("n") >= LEAST_DOCS).orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()
    odds = {bytes(r.word): float(np.log((r.bad + 0.5) / (sizes[1] + 1)) - np.log((r.n - r.bad + 0.5) / (sizes[0] + 1))) for r in common}

    net = Network(odds)
    kept: dict[tuple, int] = {}
    for turn in range(ROUNDS):
        rank = _ranked(None if turn == 0 else net, odds)
        rows = sample.mapInPandas(rank, "toxic int, words array<binary>").collect()
        kept |= {tuple(bytes(w) for w in r.words): r.toxic for r in rows}
        windows = sorted(kept)
        net.train([list(w) for w in windows], np.array([kept[w] for w in windows]))
    return net


def toxicity(text: Column, spark: SparkSession, net: Network | None) -> Column:
    """The score of a text, 0 to 1."""
    shared = spark.sparkContext.broadcast(net)

    @F.arrow_udf(DoubleType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = shared.value and Scorer(shared.value)
        for texts in batches:
            yield pa.array(scorer.scores(texts) if scorer else [0.0] * len(texts), pa.float64())

    return run(text)


def verdict(score: Column) -> Column:
    return F.when(score >= THRESHOLD, 1).otherwise(0)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    score = toxicity(F.col("text"), spark, learn(docs, table(spark, sf_dir, "labels")))
    found = docs.select("doc_id", F.coalesce(F.pmod(crc_of_id(F.col("doc_id")), F.lit(3)) == 1, F.lit(False)).alias("held_out"), score.alias("score"))
    return found.withColumn("predicted", verdict(F.col("score")))
