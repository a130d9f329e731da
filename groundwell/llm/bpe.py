"""Byte-level BPE: a backtracking encoder over Aho-Corasick matches, and a decoder over an offset table.

The encoder finds the longest token at each byte of a piece with one Aho-Corasick pass. It takes the longest token that is
compatible with the one before, shortens it to its longest prefix token while it isn't, and steps back where no prefix is
left; positions that failed once aren't tried again, so the time is linear. Two tokens are compatible if the merges, run
over their bytes, leave the two as they are. This gives exactly what the merges give. The decoder keeps all tokens' bytes in
one array with an offset for each token.

Defined cases: a null or empty text has no tokens and decodes to an empty text; a special token's own string in a text
becomes that token, as in the tokenizers library; very long texts are done in blocks of pieces; repeated rows are encoded
alike; other columns pass through. The vocabulary file is read once by the driver and broadcast (its size is checked).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain, islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from .common import byte_slices, give_back, kept_by_worker, table

#: The pattern that splits a text before the merges; fixed by the vocabulary.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
VOCABULARY_LIMIT = 64 << 20
CACHE = 120_000
BLOCK_CHARS = 1 << 20
BLOCK_PIECES = 1 << 16


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokenizer:
    """From the text of a tokenizers JSON file with a byte-level BPE model."""

    def __init__(self, source: str) -> None:
        spec = json.loads(source)
        letters = byte_letters()
        vocab = {k: v for k, v in spec["model"]["vocab"].items()}
        to_bytes = lambda word: bytes(letters[c] for c in word)
        size = 1 + max([*vocab.values(), *[t["id"] for t in spec["added_tokens"]]])
        self.token: list[bytes] = [b""] * size
        for word, k in vocab.items():
            self.token[k] = to_bytes(word)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for word, k in self.special.items():
            self.token[k] = word.encode()
        self.is_special = regex.compile("|".join(regex.escape(w) for w in sorted(self.special, key=len, reverse=True))) if self.special else None
        # merges by rank; a token is made by the merge with its own rank
        self.halves: list[tuple[int, int] | None] = [None] * size
        self.rank = list(range(size))
        self.merged: dict[tuple[int, int], int] = {}
        for at, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            made = vocab[a + b]
            self.merged[vocab[a], vocab[b]] = made
            self.halves[made] = self.halves[made] or (vocab[a], vocab[b])
            self.rank[made] = 256 + at
        for word, k in vocab.items():
            if len(word) == 1:
                self.rank[k] = -1
        self.pair_fits: dict[int, bool] = {}
        self.size = [len(t) for t in self.token]
        self.found = ahocorasick.Automaton()
        self.by_bytes = {self.token[k]: k for k in vocab.values() if self.rank[k] == -1 or self.halves[k] and self.compatible(*self.halves[k], self.rank[k])}
        for word, k in self.by_bytes.items():
            self.found.add_word(word.decode("latin-1"), k)
        self.found.make_automaton()
        self.shorter = [-1] * size
        for word, k in self.by_bytes.items():
            self.shorter[k] = next((self.by_bytes[word[:n]] for n in range(len(word) - 1, 0, -1) if word[:n] in self.by_bytes), -1)
        self.text_of_id = [str(k) for k in range(size)]
        self.cache: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.blob = np.frombuffer(b"".join(self.token), dtype=np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(t) for t in self.token])])

    def compatible(self, a: int, b: int, limit: int = 1 << 60) -> bool:
        """Whether the merges of rank below limit leave a and b, side by side, as they are.

        Undoes the merges of both along the border, the latest first: where the two at the border would have merged before, they aren't."""
        while True:
            made = self.merged.get((a, b))
            if made is not None and self.rank[made] < limit:
                return False
            a_parts, b_parts = self.halves[a], self.halves[b]
            if b_parts and (not a_parts or self.rank[b] >= self.rank[a]):
                limit, b = self.rank[b] + 1, b_parts[0]  # of equal merges the left one comes first
            elif a_parts:
                limit, a = self.rank[a], a_parts[1]
            else:
                return True

    def _fits(self, a: int, b: int) -> bool:
        """compatible, kept for the pair."""
        if len(self.pair_fits) > 2 * CACHE:
            self.pair_fits.clear()
        known = self.pair_fits[a << 32 | b] = self.compatible(a, b)
        return known

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        whole = self.by_bytes.get(piece)
        if whole is not None:
            return (whole,)
        sizes, shorter, fits = self.size, self.shorter, self.pair_fits.get
        n = len(piece)
        longest = [-1] * (n + 1)
        for end, k in self.found.iter(piece.decode("latin-1")):
            longest[end - sizes[k] + 1] = k  # ends grow, so the last is the longest
        out: list[int] = []
        failed: set[int] = set()
        at, k = 0, longest[0]
        while at < n:
            if out:
                before = out[-1]
                while k >= 0:
                    ok = fits(before << 32 | k)
                    if ok is None:
                        ok = self._fits(before, k)
                    if ok and (not failed or at + sizes[k] not in failed):
                        break
                    k = shorter[k]
            else:
                while k >= 0 and at + sizes[k] in failed:
                    k = shorter[k]
            if k >= 0:
                out.append(k)
                at += sizes[k]
                k = longest[at]
            else:
                failed.add(at)
                k = out.pop()
                at -= sizes[k]
                k = shorter[k]
        return tuple(out)

    def _missing(self, piece: str) -> tuple[int, ...]:
        ids = self.older.get(piece) or self.encode_piece(piece.encode())
        if len(piece) < 64:
            if len(self.cache) >= CACHE:  # what was in use lately stays
                self.older = dict(self.cache)
                self.cache.clear()
            self.cache[piece] = ids
        return ids

    def _plain(self, text: str) -> Iterator[list[int]]:
        if len(text) <= BLOCK_CHARS:
            blocks = iter([PATTERN.findall(text)])
        else:
            matches = (m.group() for m in PATTERN.finditer(text))
            blocks = iter(lambda: list(islice(matches, BLOCK_PIECES)), [])
        get, missing = self.cache.get, self._missing
        for pieces in blocks:
            yield list(chain.from_iterable([get(p) or missing(p) for p in pieces]))

    def encode_blocks(self, text: str | None) -> Iterator[list[int]]:
        """The ids of a text, in blocks that are whole pieces."""
        at = 0
        for m in self.is_special.finditer(text or "") if self.is_special else ():
            yield from self._plain(text[at : m.start()])
            yield [self.special[m.group()]]
            at = m.end()
        yield from self._plain((text or "")[at:])

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a whole text."""
        parts = [np.array(b, dtype=np.int32) for b in self.encode_blocks(text)]
        return parts[0] if len(parts) == 1 else np.concatenate([np.empty(0, np.int32), *parts])

    def forget(self) -> None:
        """Drops what was kept of pieces and pairs: a worker that waits for its next task holds the vocabulary alone."""
        self.cache.clear()
        self.older.clear()
        self.pair_fits.clear()

    def decode_bytes(self, ids: list[int] | np.ndarray) -> bytes:
        if not len(ids):
            return b""
        k = np.asarray(ids, dtype=np.int64)
        starts, sizes = self.offset[k], self.offset[k + 1] - self.offset[k]
        ends = np.cumsum(sizes)
        return self.blob[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1])].tobytes()

    def decode(self, ids: list[int] | np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")


def _tokenizer(shared) -> Tokenizer:
    """One for each Python worker."""
    source = shared.value
    return kept_by_worker(("bpe", hash(source)), lambda: Tokenizer(source))


def shared_vocabulary(spark: SparkSession, path: str):
    with open(path, encoding="utf-8") as f:
        source = f.read()
    if len(source) > VOCABULARY_LIMIT:
        raise ValueError(f"a vocabulary file of {len(source)} characters is too large to broadcast")
    return spark.sparkContext.broadcast(source)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *rows])))


def encoded(text: Column, vocabulary) -> Column:
    """The ids of a text."""

    @F.arrow_udf(ArrayType(IntegerType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        t = _tokenizer(vocabulary)
        for texts in batches:
            for some in byte_slices(texts):
                yield _lists([t.encode(x.as_py()) for x in some])
        t.forget()
        give_back()

    return run(text)


CHECKED = StructType([StructField("ids", ArrayType(IntegerType())), StructField("round_trip", BooleanType())])


def encoded_checked(text: Column, vocabulary) -> Column:
    """A struct of the ids of a text, and whether they decode to it."""

    @F.arrow_udf(CHECKED)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        t = _tokenizer(vocabulary)
        for texts in (some for batch in batches for some in byte_slices(batch)):
            rows, same = [], []
            for x in texts:
                rows.append(t.encode(x.as_py()))
                same.append(t.decode(rows[-1]) == (x.as_py() or ""))
            yield pa.StructArray.from_arrays([_lists(rows), pa.array(same, pa.bool_())], fields=[pa.field("ids", pa.list_(pa.int32())), pa.field("round_trip", pa.bool_())])
        t.forget()
        give_back()

    return run(text)


def decoded(ids: Column, vocabulary) -> Column:
    """The text of ids; null for null."""

    @F.arrow_udf(StringType())
    def run(lists: pa.Array) -> pa.Array:
        t = _tokenizer(vocabulary)
        return pa.array([t.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else None for x in lists], type=pa.string())

    return run(ids)


DIGESTS = StructType([StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())])


def round_trip_digests(text: Column, vocabulary) -> Column:
    """Encodes a text, decodes the ids, and returns the digests of both."""

    @F.arrow_udf(DIGESTS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        t = _tokenizer(vocabulary)
        for texts in batches:
            yield digests(t, texts)

    def digests(t: Tokenizer, texts: pa.Array) -> pa.Array:
        counts, ids_hex, text_hex = [], [], []
        for x in texts:
            n, ids_sha, text_sha = 0, hashlib.sha256(), hashlib.sha256()
            names = t.text_of_id
            for ids in t.encode_blocks(x.as_py()):
                if ids:
                    ids_sha.update((("," if n else "") + ",".join([names[k] for k in ids])).encode())
                    text_sha.update(t.decode(ids).encode())
                    n += len(ids)
            counts.append(n)
            ids_hex.append(ids_sha.hexdigest())
            text_hex.append(text_sha.hexdigest())
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(ids_hex), pa.array(text_hex)], fields=[pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())])

    return run(text)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids."""
    ids = encoded(F.col("text"), shared_vocabulary(docs.sparkSession, path or default_vocabulary()))
    return docs.select("doc_id", ids.alias("ids")).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = shared_vocabulary(spark, default_vocabulary())
    return table(spark, sf_dir, "documents").select("doc_id", round_trip_digests(F.col("text"), vocabulary).alias("d")).select("doc_id", "d.*")
