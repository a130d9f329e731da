"""Media shards, WARC archives and the pipeline."""

import hashlib
import io
import os
import tarfile
import zlib
from collections import Counter

import duckdb
import pytest

from groundwell.llm import files as files_helper
from groundwell.llm import media, warc
from groundwell.llm.common import shared_dir, table, work_path
from groundwell.llm.queries import ORACLE_SQL, QUERIES


def test_png_round_trip():
    for text in (None, "", "x" * 63, "é" * 32, "abc " * 5000):
        p = media.payload_of(text)
        data = media.to_png(p)
        assert media.from_png(data) == p and len(p) % 64 == 0 and p[: len((text or "").encode())] == (text or "").encode()
        assert media.png_header(data[:33]) == (64, len(p) // 64, 8)
    with pytest.raises(ValueError):
        media.from_png(data[:40] + b"!" + data[41:])


def plain_payload(text):
    raw = (text or "").encode()
    while not raw or len(raw) % 64:
        raw += b"\0"
    return raw


def plain_png(data):
    """The samples of an 8-bit grey image without filters, by the format's own rules."""
    assert data[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
    at, chunks = 8, []
    while at < len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        kind, body, crc = data[at + 4 : at + 8], data[at + 8 : at + 8 + size], data[at + 8 + size : at + 12 + size]
        assert zlib.crc32(kind + body) == int.from_bytes(crc, "big")
        chunks.append((kind, body))
        at += 12 + size
    assert [k for k, _ in chunks] == [b"IHDR", b"IDAT", b"IEND"]
    head = chunks[0][1]
    wide, high = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big")
    assert head[8:] == bytes([8, 0, 0, 0, 0])
    lines = zlib.decompress(chunks[1][1])
    assert len(lines) == high * (wide + 1)
    return b"".join(lines[k * (wide + 1) + 1 : (k + 1) * (wide + 1)] for k in range(high)), wide, high


def plain_feature(p):
    mean = sum(p) / len(p)
    spread = (sum((x - mean) ** 2 for x in p) / len(p)) ** 0.5
    return mean, spread, [sum(x // 32 == k for x in p) * 1000 // len(p) for k in range(8)]


def test_media_by_hand(spark, sf_dir):
    """The rows against payloads and features by plain Python, and against the images that lie in the shards."""
    docs = table(spark, sf_dir, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    folder = work_path(spark, "media")
    index = {bytes(r.digest).hex(): r for r in media.index_of(media.store(docs, folder)).collect()}
    rows = media.op5(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        p = plain_payload(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((texts[r.doc_id] or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        at = index[r.media_sha256]
        with open(f"{folder.removeprefix('file://')}/{at.file}", "rb") as f:
            f.seek(at.offset)
            data = f.read(at.length)
        assert len(data) == r.media_bytes and hashlib.sha256(data).hexdigest() == r.media_sha256
        assert plain_png(data) == (p, r.width, r.height) and r.depth == 8
        mean, spread, shares = plain_feature(p)
        said = dict(x.split("=") for x in r.feature.split(";"))
        assert float(said["mean"]) == pytest.approx(mean, abs=6e-4) and float(said["std"]) == pytest.approx(spread, abs=6e-4) and said["hist"] == ",".join(map(str, shares))


def test_reads_are_dealt_by_bytes(spark):
    """Pieces of files go to tasks by what they weigh, in order, and files of any sizes are cut."""
    from pyspark.sql import functions as F

    sizes = {f"part-{k:06d}-{900 - k}-{c:04d}.tar": 1000 * (1 + 9 * (k == 3)) for k in range(6) for c in range(2)}
    files = spark.createDataFrame(list(sizes.items()), "file string, bytes long")
    pieces = spark.createDataFrame([(f, at) for f, n in sizes.items() for at in range(0, n, 100)], "file string, offset long")
    got = files_helper.dealt(pieces, files, 3000).select("file", "offset", F.spark_partition_id().alias("task")).collect()
    assert sorted((r.file, r.offset) for r in got) == sorted((r.file, r.offset) for r in pieces.collect())
    held = Counter(r.task for r in got)
    assert len(held) == 10 and set(held.values()) == {30}
    in_order = [r.task for r in sorted(got, key=lambda r: (r.file, r.offset))]
    assert in_order == sorted(in_order)


def test_media_odd_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "a" * 64, "y"), (3, "a" * 64, "y"), (None, "b" * 300_000, "z")], "doc_id long, text string, digest string").coalesce(1)
    folder = work_path(spark, "media")
    rows = media.store(docs, folder)
    got = rows.collect()
    assert len(got) == 5 and len({bytes(r.digest) for r in got}) == 3
    index = media.index_of(rows).collect()
    assert len(index) == 3
    for name in {r.file for r in index}:
        with tarfile.open(f"{folder.removeprefix('file://')}/{name}") as t:
            assert {m.name.removesuffix(".png"): m.offset_data for m in t} == {r.digest.hex(): r.offset for r in index if r.file == name}
    values = media.with_features(media.with_headers(media.index_of(rows), folder), folder).collect()
    assert sorted(r.payload_bytes for r in values) == [64, 64, 300_032]
    none = media.store(docs.limit(0), work_path(spark, "media"))
    assert none.count() == 0 and media.with_headers(media.index_of(none), folder).count() == 0


def test_warc_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    got = sorted((tuple(r[c] for c in cols) for r in warc.op7(spark, sf_dir).collect()), key=str)
    assert got == sorted(con.sql(f"SELECT {', '.join(cols)} FROM ({warc.ORACLE_SQL})").fetchall(), key=str)


def test_warc_odd_rows(spark):
    h = "x" * 1500
    data = [(1, "http://a.b/c", h), (2, None, h), (3, "u\n", h), (3, "again", h), (4, "z", None), (5, "q", ""), (6, "z", "small"), (7, "z", "small"), (None, None, None), (8, "é", "é" * 700), (9, "é", "\r\n\r\nWARC/1.1\r\n")]
    pages = spark.createDataFrame([(*r, "k") for r in data], "page_id long, url string, html string, kind string")
    folder = work_path(spark, "warc")
    files = warc.write_warc(pages, folder)
    records = warc.read_warc(files, folder)
    assert Counter(r.kind for r in records.collect()) == {"request": 11, "metadata": 11, "response": 9, "revisit": 2}
    t = {(r.page_id, r.request.uri): r for r in warc.transactions(records).collect()}
    assert len(t) == 11 and all(r.metadata is not None for r in t.values())
    assert (t[1, "http://a.b/c"].response.kind, t[1, "http://a.b/c"].response.payload_bytes) == ("revisit", 1500)
    assert {t[3, "u%0A"].response.kind, t[3, "again"].response.kind} == {"response"}
    assert bytes(t[8, "é"].response.payload).decode() == "é" * 700 and bytes(t[9, "é"].response.payload) == b"\r\n\r\nWARC/1.1\r\n"
    assert t[6, "z"].response.kind == t[7, "z"].response.kind == "response"
    assert warc.read_warc(warc.write_warc(pages.limit(0), folder), folder).count() == 0


def test_warc_clashing_ids(spark, tmp_path):
    """One page_id with several payloads, and many pages without an id: each row is a capture of its own payload."""
    h, g = "x" * 1500, "y" * 1500
    rows = [(1, "u", h), (1, "u", "small"), (1, "v", g), (9, "w", h), (9, "w", g), (9, "w", g), (None, "n", h), (None, "n", h), (None, None, g), (None, None, "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = Counter(tuple(r) for r in warc.op7(spark, str(tmp_path)).collect())
    sha = lambda x: hashlib.sha1(x.encode()).hexdigest()
    want = Counter()
    for i, _, x in rows:
        again = i == 1 and x in (h, g)
        want[i, len(x), sha(x), "revisit" if again else "response", 9 if again else None] += 1
    assert got == want
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert got == Counter(con.sql(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM ({warc.ORACLE_SQL})").fetchall())


def test_a_lost_response_is_an_error(spark):
    records = spark.createDataFrame([("revisit", "r", None, "u", "u", "d", None, 2000, None), ("request", "q", "r", None, "u", None, None, None, None)], "kind string, record_id string, concurrent_to string, refers_to string, uri string, digest string, page_id long, payload_bytes long, payload binary")
    with pytest.raises(Exception, match="no response for the revisit"):
        warc.resolved(records).collect()


def test_registry():
    assert [n.split("_")[0] for n in sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{k}" for k in range(1, 14)]
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_pipeline(spark, sf_dir):
    """Each stage against what the stage before kept, by plain rules."""
    import corpus_pipeline as c

    from groundwell.llm import simhash
    from tests.llm.test_quality_sharding_mixing import counts_by_hand
    from tests.llm.test_simhash_components import want_of

    docs = table(spark, sf_dir, "documents")
    kept = []
    for _, stage in c.STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path := work_path(spark, "stage"))
        kept.append(docs := spark.read.parquet(path))
    first = table(spark, sf_dir, "documents").columns
    assert all(k.columns == first for k in kept[:-1])
    rows = [k.collect() for k in kept]
    assert len(rows[0]) > 0.95 * table(spark, sf_dir, "documents").count()
    for r in rows[1]:
        n, _, _, _, repeated = counts_by_hand(r.text)
        assert n >= 20 and 100 * repeated <= 30 * n
    comp = want_of([simhash.fingerprint(r.text) for r in rows[1]], [r.doc_id for r in rows[1]])
    assert sorted(r.doc_id for r in rows[2]) == sorted(set(comp.values()))
    times = Counter(r.doc_id for r in rows[3])
    assert set(times) <= {r.doc_id for r in rows[2]} and max(times.values()) <= 2
    assert Counter(r.doc_id for r in rows[4]) == times and all(r.round_trip for r in rows[4])
    held = set(os.listdir(work := f"{shared_dir(spark).removeprefix('file://')}/groundwell"))
    again = c.run(spark, sf_dir)
    assert [x.split("-")[0] for x in set(os.listdir(work)) - held] == ["stage4"]  # of all work tables only the result stays
    assert Counter((r.doc_id, r.n_tokens) for r in again.collect()) == Counter((r.doc_id, r.n_tokens) for r in rows[4])


def test_pipeline_odd_rows(spark, tmp_path):
    """Nulls, ids that clash, repeated rows, extra columns with inner names, and empty tables, through all stages."""
    import corpus_pipeline as c

    long = lambda k, n=60: " ".join(f"{w}{chr(97 + (k * 7 + j * j) % 26)}" for j, w in enumerate(["the", "quick", "brown", "fox", "jumps", "over"] * (n // 6)))
    texts = [long(k) for k in range(40)]
    rows = [(k, t, "en", f"s{k % 3}", k) for k, t in enumerate(texts)]
    rows += [(3, texts[3], "en", "s0", 3), (3, texts[7] + " more", "en", "s1", 3), (None, texts[5], "en", "s0", None), (None, long(90, 90), "en", None, None), (50, None, None, None, None), (51, "", "en", "s1", 0), (52, "12 ! 34", None, "s2", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema).selectExpr("*", "text AS fp", "doc_id AS component_id", "lang AS row", "1 AS copies", "'k' AS digest", "source AS _host")
    for given in (docs, docs.limit(0)):
        given.write.parquet(path := f"{tmp_path}/{given.count()}/documents.parquet")
        now, first = spark.read.parquet(path), given.columns
        for k, (name, stage) in enumerate(c.STAGES):
            before = Counter((r.doc_id, r.text) for r in now.collect()) if k < 4 else None
            out = stage(spark, now, str(tmp_path))
            out.write.parquet(to := f"{path}-{k}")
            now = spark.read.parquet(to)
            if k < 4:
                after = Counter((r.doc_id, r.text) for r in now.collect())
                assert now.columns == first and set(after) <= set(before), name
                if k in (0, 1):
                    assert after <= before, name
                if k == 2:
                    assert max(after.values(), default=1) == 1 and len({t for _, t in after}) == len(after)
        assert all(r.round_trip for r in now.collect())
    assert c.run(spark, f"{tmp_path}/{len(rows)}").count() > 20 and c.run(spark, f"{tmp_path}/0").count() == 0


def test_cut_archives_are_errors(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/b", "x" * 2000), (2, "http://a/c", "y")], "page_id long, url string, html string").coalesce(1)
    folder = f"file://{tmp_path}/warc"
    files = warc.write_warc(pages, folder)
    assert [r.captures for r in files.collect()] == [2]
    (path,) = (tmp_path / "warc").glob("*.gz")
    whole = path.read_bytes()
    assert len(list(warc.members(io.BytesIO(whole)))) == 6
    path.write_bytes(whole[:-10])
    with pytest.raises(ValueError, match="ends within"):
        list(warc.members(io.BytesIO(whole[:-10])))
    with pytest.raises(Exception, match="ends within"):
        warc.read_warc(files, folder).count()
    ends = [k for k in range(1, len(whole)) if whole[k : k + 4] == b"\x1f\x8b\x08\x00"]
    path.write_bytes(whole[: ends[2]])  # the first capture alone, cut between records
    with pytest.raises(Exception, match="1 captures of 2"):
        warc.read_warc(files, folder).count()
