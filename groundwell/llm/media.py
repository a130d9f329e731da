"""Media columns: payloads as content-addressed PNG entries in tar shards, with digest, offset and length in the rows.

A payload is padded with zero bytes to a positive multiple of 64 and stored without loss as an 8-bit grey image, 64 wide.
The tasks that read the input write the shards, so that no payload is shuffled; an entry's name is the SHA-256 of its bytes,
and a task writes equal content once. The index keeps one entry for each digest; a payload that several tasks saw may stand
in several shards, and the index points at one. Metadata columns (width, height, depth) come from range reads of an entry's
first 33 bytes; features come from range reads of the entry. Both read in the order of the entries' places in the shards, and
a task has READ_BYTES of them.
Digests are kept as 32 bytes, and written as hex in the end.

Defined cases: a null text is an empty payload (64 zero bytes); equal texts get equal values; repeated rows stay rows; an
empty table gives no shards and an empty result; other columns of the input aren't looked at.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, table, work_path
from .files import dealt, new_file, open_file

WIDTH = 64
SHARD_BYTES = 64 << 20
READ_BYTES = 32 << 20
LEVEL = 6
HEADER = 33
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + bytes(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), dtype=np.uint8)  # each line begins with filter type 0
    lines[:, 1:] = rows
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from an image's first 33 bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", head[16:25])


def from_png(data: bytes) -> bytes:
    width, height, _ = png_header(data[:HEADER])
    at, packed = 8, []
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("a PNG chunk is damaged")
        packed += [body] if kind == b"IDAT" else []
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), dtype=np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("only filter type 0 is written here")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, deviation, and the share of samples in eight equal ranges, in thousandths."""
    x = np.frombuffer(payload, dtype=np.uint8)
    count = np.bincount(x, minlength=256)
    mean = float(count @ np.arange(256)) / len(x)
    spread = (float(count @ np.arange(256) ** 2) / len(x) - mean**2) ** 0.5
    shares = count.reshape(8, 32).sum(axis=1) * 1000 // len(x)
    return f"mean={mean:.3f};std={spread:.3f};hist={','.join(map(str, shares.tolist()))}"


class Shard:
    """A tar file that is being written: entries are named by their digest, and each digest is there once."""

    def __init__(self, folder: str, count: int) -> None:
        self.name, self.out = new_file(folder, ".tar", count)
        self.size = 0
        self.held: dict[bytes, int] = {}

    def add(self, digest: bytes, data: bytes) -> int:
        """The offset of the data."""
        if digest not in self.held:
            info = tarfile.TarInfo(f"{digest.hex()}.png")
            info.size = len(data)
            head = info.tobuf(tarfile.USTAR_FORMAT if len(data) < 8 << 30 else tarfile.GNU_FORMAT)
            self.out.write(head + data + bytes(-len(data) % 512))
            self.held[digest] = self.size + len(head)
            self.size += len(head) + len(data) + -len(data) % 512
        return self.held[digest]

    def close(self) -> None:
        self.out.write(bytes(1024))
        self.out.close()


def _stored(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, count = None, 0
        for batch in batches:
            rows = []
            for x in batch.column(1):
                if shard is None:
                    shard, count = Shard(folder, count), count + 1
                text = x.as_py()
                data = to_png(payload_of(text))
                digest = hashlib.sha256(data).digest()
                rows.append((len((text or "").encode()), digest, shard.name, shard.add(digest, data), len(data)))
                if shard.size >= SHARD_BYTES:
                    shard.close()
                    shard = None
            n, digest, file, offset, length = zip(*rows, strict=True) if rows else ([],) * 5
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(file, pa.string()), pa.array(offset, pa.int64()), pa.array(length, pa.int64())], names=["doc_id", "n_bytes", "digest", "file", "offset", "length"])
        if shard is not None:
            shard.close()

    return run


def store(docs: DataFrame, folder: str) -> DataFrame:
    """Writes the texts' payloads to tar shards in folder; one row per row of docs: doc_id, n_bytes, digest, file, offset, length."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return saved(docs.select("doc_id", "text").mapInArrow(_stored(folder), f"doc_id {id_type}, n_bytes long, digest binary, file string, offset long, length long"), "media-rows")


def index_of(rows: DataFrame) -> DataFrame:
    """One entry for each digest: digest, file, offset, length."""
    return rows.groupBy("digest").agg(F.min(F.struct("file", "offset", "length")).alias("at")).select("digest", "at.*")


def _ranges(folder: str, batch: pa.RecordBatch, most: int | None) -> Iterator[bytes]:
    """The entries' bytes (their first ones, up to most). The file of the row before stays open."""
    name, stream = None, None
    try:
        for file, offset, length in zip(*[batch.column(c).to_pylist() for c in ("file", "offset", "length")], strict=True):
            if file != name:
                if stream is not None:
                    stream.close()
                name, stream = file, open_file(folder, file)
            stream.seek(offset)
            yield stream.read(length if most is None else min(most, length))
    finally:
        if stream is not None:
            stream.close()


def in_place(index: DataFrame) -> DataFrame:
    """The index dealt out by the bytes of its entries, in the order of their places."""
    files = index.groupBy("file").agg(F.max(F.col("offset") + F.col("length")).alias("bytes"))
    return dealt(index, files, READ_BYTES).sortWithinPartitions("file", "offset")


def with_headers(index: DataFrame, folder: str) -> DataFrame:
    """Adds width, height and depth by header-only range reads; the result is in place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [png_header(h) for h in _ranges(folder, batch, HEADER)]
            extra = [pa.array([h[k] for h in heads], pa.int64()) for k in range(3)]
            yield pa.record_batch([*batch.columns, *extra], names=["digest", "file", "offset", "length", "width", "height", "depth"])

    return in_place(index).mapInArrow(run, "digest binary, file string, offset long, length long, width long, height long, depth long")


def with_features(index: DataFrame, folder: str) -> DataFrame:
    """Adds payload_bytes, payload_sha256, tail_crc32, media_bytes and feature, from the stored bytes. index: as with_headers returns it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, data in zip(batch.column("digest").to_pylist(), _ranges(folder, batch, None), strict=True):
                if hashlib.sha256(data).digest() != digest:
                    raise ValueError("an entry isn't what its digest says")
                p = from_png(data)
                rows.append((len(p), hashlib.sha256(p).digest(), zlib.crc32(p[-WIDTH:]), len(data), feature(p)))
            values = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string())
            kept = [batch.column(c) for c in ("digest", "width", "height", "depth")]
            yield pa.record_batch([*kept, *[pa.array(v, k) for v, k in zip(values, kinds, strict=True)]], names=["digest", "width", "height", "depth", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "feature"])

    return index.mapInArrow(run, "digest binary, width long, height long, depth long, payload_bytes long, payload_sha256 binary, tail_crc32 long, media_bytes long, feature string")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_path(spark, "media")
    rows = store(table(spark, sf_dir, "documents"), folder)
    index = saved(index_of(rows), "media-index")
    values = saved(with_features(with_headers(index, folder), folder), "media-features")
    sha = lambda c: F.lower(F.hex(c))
    both = rows.select("doc_id", "n_bytes", "digest").join(values, "digest")
    return both.select("doc_id", "n_bytes", "payload_bytes", sha("payload_sha256").alias("payload_sha256"), "tail_crc32", "media_bytes", sha("digest").alias("media_sha256"), "feature", "width", "height", "depth")
