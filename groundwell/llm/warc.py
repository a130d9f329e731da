"""WARC archives: writing captures, reading them back, and assembling transactions.

A capture is three records: request, response (or revisit) and metadata; the first and last name the second in
WARC-Concurrent-To. Of equal payloads of 1000 bytes or more the page with the largest id is written as the response, the
others as revisits, which name its address and carry the digest of its payload. Reading gives one row per record; assembly
joins the three over those identifiers into one nested row per capture, and a revisit finds its response by the digest.
Each record is a gzip member of its own. Pages are written by the tasks that read them, and a task reads one archive.

Defined cases: a null html is an empty payload; a null url becomes urn:page:<id>; line breaks in a url are percent-encoded;
a null page_id gives a response of its own; an empty table gives no files and an empty result; repeated rows are captures
with ids of their own; rows with one page_id and different payloads are told apart by these; a revisit without its response
is an error; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_small, saved, table, work_path
from .files import dealt, new_file, open_file

LEAST_SHARED = 1000
FILE_BYTES = 64 << 20
READ_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = 1 << 20


def _digested(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select("page_id", "url", "html", F.sha1(payload).alias("payload_digest"), F.octet_length(payload).alias("n"))


def originals(pages: DataFrame) -> DataFrame:
    """payload_digest, original and original_url: of each large payload that more than one page has, the page that holds it."""
    large = _digested(pages).where((F.col("n") >= LEAST_SHARED) & F.col("page_id").isNotNull())
    first = large.groupBy("payload_digest").agg(F.max(F.struct("page_id", "url")).alias("first"), F.min("page_id").alias("least"))
    return saved(first.where("least <> first.page_id").select("payload_digest", F.col("first.page_id").alias("original"), F.col("first.url").alias("original_url")), "originals")


def record_id(kind: str, capture_key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}/{capture_key}')}>"


def target_uri(page_id: int | None, url: str | None) -> str:
    return (url or f"urn:page:{page_id}").replace("\r", "%0D").replace("\n", "%0A")


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record as a gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))]) + "\r\n"
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def capture(key: str, page_id: int | None, url: str | None, html: str | None, digest: str, original: int | None, original_url: str | None) -> bytes:
    """The three records of a page. key: another one for each capture."""
    payload = (html or "").encode()
    uri = target_uri(page_id, url)
    revisit = original is not None and page_id is not None and original != page_id
    own = record_id("response", key)
    common = [("WARC-Date", DATE), ("WARC-Target-URI", uri)]
    path = "/" + uri.split("://", 1)[-1].partition("/")[2]
    host = uri.split("://", 1)[-1].partition("/")[0]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    about = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if revisit:
        about += [("WARC-Profile", PROFILE), ("WARC-Refers-To-Target-URI", target_uri(original, original_url)), ("WARC-Refers-To-Date", DATE)]
    asked = f"GET {path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()
    return (
        record([("WARC-Type", "request"), ("WARC-Record-ID", record_id("request", key)), *common, ("WARC-Concurrent-To", own), ("Content-Type", "application/http;msgtype=request")], asked)
        + record(about, http if revisit else http + payload)
        + record([("WARC-Type", "metadata"), ("WARC-Record-ID", record_id("metadata", key)), *common, ("WARC-Concurrent-To", own), ("Content-Type", "application/warc-fields")], f"page_id: {'' if page_id is None else page_id}\r\n".encode())
    )


def _written(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, size, count, held = None, None, 0, 0, 0
        told = lambda: pa.record_batch({"file": [name], "bytes": [size], "captures": [held]})
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                if out is None:
                    name, out = new_file(folder, ".warc.gz", count)
                    size, count, held = 0, count + 1, 0
                size += out.write(capture(f"{folder}/{name}/{held}", *[x.as_py() for x in row]))
                held += 1
                if size >= FILE_BYTES:
                    out.close()
                    yield told()
                    out = None
        if out is not None:
            out.close()
            yield told()

    return run


def write_warc(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the archives to folder and returns their names: file, bytes, captures."""
    first = originals(pages)
    own = _digested(pages)
    # only payloads that can be shared look for their original, so that small ones and empty ones are no hot key
    key = F.when((F.col("n") >= LEAST_SHARED) & F.col("page_id").isNotNull(), F.col("payload_digest"))
    both = join_small(own, first.withColumnRenamed("payload_digest", "_digest"), key == F.col("_digest"))
    kept = both.select("page_id", "url", "html", "payload_digest", "original", "original_url")
    return saved(kept.mapInArrow(_written(folder), "file string, bytes long, captures long"), "warc-files")


def members(stream) -> Iterator[bytes]:
    """The gzip members of a file, one after another. A file that ends within one is an error."""
    rest, unpack, parts = b"", zlib.decompressobj(31), []
    while data := rest or stream.read(READ):
        parts.append(unpack.decompress(data))
        rest = unpack.unused_data
        if unpack.eof:
            yield b"".join(parts)
            unpack, parts = zlib.decompressobj(31), []
    if parts:
        raise ValueError("the archive ends within a record")


def parsed(member: bytes) -> dict:
    """A record's fields: kind, record_id, concurrent_to, refers_to (an address), uri, digest, page_id, payload_bytes, payload."""
    head, _, block = member.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    out = {"kind": fields["WARC-Type"], "record_id": fields["WARC-Record-ID"], "concurrent_to": fields.get("WARC-Concurrent-To"), "refers_to": fields.get("WARC-Refers-To-Target-URI"), "uri": fields["WARC-Target-URI"], "digest": None, "page_id": None, "payload_bytes": None, "payload": None}
    if out["kind"] == "metadata":
        found = dict(line.split(": ", 1) for line in block.decode().split("\r\n") if ": " in line)["page_id"]
        out["page_id"] = int(found) if found else None
    elif out["kind"] in ("response", "revisit"):
        http, _, payload = block.partition(b"\r\n\r\n")
        said = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
        out["payload_bytes"] = int(said["Content-Length"])
        out["digest"] = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if out["kind"] == "response":
            out["payload"] = payload
            if hashlib.sha1(payload).hexdigest() != out["digest"] or len(payload) != out["payload_bytes"]:
                raise ValueError(f"the payload of {out['record_id']} isn't the one that was written")
    return out


RECORD = pa.schema([("kind", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("uri", pa.string()), ("digest", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])


def read_warc(files: DataFrame, folder: str, *, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives named in files; a task has READ_BYTES of them, or one larger archive. An archive with fewer
    or more captures than files says is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, captures in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, held, found = [], 0, 0
                with open_file(folder, name) as stream:
                    for m in members(stream):
                        row = parsed(m)
                        found += row["kind"] in ("response", "revisit")
                        if not with_payload:
                            row["payload"] = None
                        rows.append(row)
                        held += 500 + len(row["payload"] or b"")
                        if held > 16 << 20:
                            yield pa.RecordBatch.from_pylist(rows, RECORD)
                            rows, held = [], 0
                if found != captures:
                    raise ValueError(f"{name} has {found} captures of {captures}")
                yield pa.RecordBatch.from_pylist(rows, RECORD)

    kinds = "kind string, record_id string, concurrent_to string, refers_to string, uri string, digest string, page_id long, payload_bytes long, payload binary"
    return dealt(files.select("file", F.lit(0).alias("offset"), "captures"), files, READ_BYTES).select("file", "captures").mapInArrow(run, kinds)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, page_id, request, response, metadata."""
    side = lambda kind: records.where(F.col("kind") == kind).select(F.col("concurrent_to").alias("capture_id"), F.struct("record_id", "uri", "page_id").alias(kind))
    main = records.where(F.col("kind").isin("response", "revisit")).select(F.col("record_id").alias("capture_id"), F.struct("kind", "uri", "digest", "payload_bytes", "refers_to", "payload").alias("response"))
    both = main.join(side("request"), "capture_id", "left").join(side("metadata"), "capture_id", "left")
    return both.select("capture_id", F.col("metadata.page_id").alias("page_id"), "request", "response", "metadata")


def resolved(records: DataFrame) -> DataFrame:
    """One row per capture: page_id, payload_bytes, payload_digest, record_type, and refers_to, the page that holds a revisit's payload."""
    found = transactions(records).select("page_id", F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.digest").alias("payload_digest"), F.col("response.kind").alias("record_type"))
    found = saved(found, "captures")
    again = F.col("record_type") == "revisit"
    asked = found.where(again).select("payload_digest").distinct()
    held = found.where(~again & (F.col("payload_bytes") >= LEAST_SHARED)).groupBy("payload_digest").agg(F.max("page_id").alias("holder"))
    held = saved(held.join(asked, "payload_digest", "left_semi").withColumnRenamed("payload_digest", "_digest"), "holders")
    both = join_small(found, held, F.when(again, F.col("payload_digest")) == F.col("_digest"))
    lost = F.raise_error(F.concat(F.lit("no response for the revisit with payload "), "payload_digest")).cast("long")
    return both.select("page_id", "payload_bytes", "payload_digest", "record_type", F.when(again, F.coalesce("holder", lost)).alias("refers_to"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_path(spark, "warc")
    files = write_warc(table(spark, sf_dir, "pages"), folder)
    return resolved(saved(read_warc(files, folder, with_payload=False), "warc-records"))


ORACLE_SQL = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
m AS (SELECT h, max(page_id) AS first FROM d WHERE n >= 1000 GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d.h AS payload_digest, CASE WHEN m.first IS NOT NULL AND n >= 1000 AND m.first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN m.first IS NOT NULL AND n >= 1000 AND m.first <> page_id THEN m.first END AS refers_to
FROM d LEFT JOIN m USING (h)"""
