"""Queries over documents, pages and conversations: ids, duplicates, chunks, sections, sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundwell.functions import text as t
from groundwell.operators import passages as op
from groundwell.operators.ranks import ranked_in
from groundwell.sources.tables import DOMAIN_SQL, PASSAGES_SQL, passages, read
from groundwell.sources.work import spread


def passage_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(spark, sf_dir).select("doc_id", "id", "source_type", "section", "published")


def ingest_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.keep_first(passages(spark, sf_dir).select("id", "doc_id", "source_id", "section"), "id", "doc_id")


def upsert_dedup_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as writes of a keyed store: the last turn of a conversation and role stays."""
    c = read(spark, sf_dir, "conversations").where(F.trim("text") != "").select(F.concat_ws("/", F.col("conv_id").cast("string"), "role").alias("key"), "turn", t.draft_digest(F.col("text")).alias("digest"))
    return op.upsert_last(c, "key", "turn", "digest")


def merge_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, then pages, as evidence: a text that came before isn't taken again."""
    a = read(spark, sf_dir, "documents").select(F.lit(0).alias("seq"), F.col("doc_id").alias("place"), F.sha2(t.clean(F.col("text")), 256).alias("id"))
    b = read(spark, sf_dir, "pages").select(F.lit(1).alias("seq"), F.col("page_id").alias("place"), F.sha2(t.html_text(F.col("html")), 256).alias("id"))
    return op.keep_first(a.unionByName(b), "id", "seq", "place")


def web_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of 80 characters or more with an address; the rank counts dropped pages too."""
    p = read(spark, sf_dir, "pages").select("page_id", F.coalesce("url", F.lit("")).alias("url"), t.domain(F.col("url")).alias("domain"), t.html_text(F.col("html")).alias("body"))
    # what is needed of a text is taken before the shuffle
    p = p.select("page_id", "url", "domain", F.length("body").alias("chars"), F.md5("body").alias("body_md5"))
    ranked = ranked_in(p, "domain", "page_id")
    return ranked.where((F.col("chars") >= 80) & (F.col("url") != "")).select("page_id", "domain", "chars", "body_md5", F.round(1 / F.col("rank"), 6).alias("score"))


def domain_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").groupBy(t.domain(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("pages"), F.countDistinct("url").alias("urls"))


def char_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", t.clean(F.col("text")).alias("whole"))
    d = d.select("doc_id", F.explode(op.char_windows(F.col("whole"), 1000, 150)).alias("w"))
    return d.select("doc_id", "w.index", "w.start", F.length("w.body").alias("chars"), F.md5("w.body").alias("body_md5"))


def dehyphenated(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = t.dehyphenate(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(fixed).alias("fixed_md5"), (F.length("text") - F.length(fixed)).alias("removed"))


def section_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = t.with_sections(spread(read(spark, sf_dir, "documents")), "text", ["doc_id"])
    return d.select("doc_id", F.col("at").alias("line_no"), "section", F.length("body").alias("chars"), F.md5("body").alias("body_md5"))


def sections_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The named sections of each document in order, each once."""
    d = section_islands(spark, sf_dir).where("section is not null").groupBy("doc_id", "section").agg(F.min("line_no").alias("line_no"))
    named = F.transform(F.sort_array(F.collect_list(F.struct("line_no", "section"))), lambda x: x["section"])
    return d.groupBy("doc_id").agg(F.array_join(named, ", ").alias("sections"))


def section_aware_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of whole sentences that don't cross a section: ids and places, numbered through the document. Documents of under
    LEAST_CHARS characters have none; of chunks of a document with one id the first stays."""
    d = t.with_sections(spread(read(spark, sf_dir, "documents").where(F.length(F.trim("text")) >= op.LEAST_CHARS)), "text", ["doc_id", "source"])
    d = d.select("doc_id", "source", "at", "section", F.posexplode(op.windows_of(F.col("body"), 1000, 150)).alias("k", "chunk"))
    d = d.select("doc_id", "at", "k", "section", F.length("chunk").alias("chars"), t.passage_id(F.col("source"), F.col("section"), F.col("chunk")).alias("id"))
    first = d.groupBy("doc_id", "id").agg(F.min(F.struct("at", "k", "section", "chars")).alias("x"))
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("x.at", "x.k")) - 1
    return first.select("doc_id", index.alias("index"), "x.section", "x.chars", "id")


def web_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of up to 800 characters whole, longer ones in chunks, each chunk text once a page."""
    p = read(spark, sf_dir, "pages").select("page_id", t.domain(F.col("url")).alias("domain"), t.html_text(F.col("html")).alias("body"))
    parts = F.array_distinct(F.when(F.length("body") <= 800, F.array("body")).otherwise(op.windows_of(F.col("body"), 800, 150)))
    return p.select("page_id", "domain", F.posexplode(parts).alias("index", "chunk")).select("page_id", "index", F.length("chunk").alias("chars"), t.passage_id(F.col("domain"), F.lit(None).cast("string"), F.col("chunk")).alias("id"))


def sentence_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assistant's turns in sentences; those of 25 characters or more are claims."""
    c = read(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.explode(op.segments(F.col("text"))).alias("s"))
    return c.select("conv_id", "turn", "s.index", F.length("s.text").alias("chars"), F.size("s.citations").alias("citations"), (F.length("s.text") >= 25).alias("claim"))


def gap_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gaps of a conversation: its user turns' gap lines, in order, each once."""
    c = read(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", t.gap_line(F.col("text")).alias("gap"))
    first = c.groupBy("conv_id", "gap").agg(F.min("turn").alias("turn"))
    return first.withColumn("pos", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "gap")))


def prompt_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache keys of the user turns as prompts, and how often each key is met again."""
    c = read(spark, sf_dir, "conversations").where("role = 'user'")
    key = F.sha2(F.concat_ws("\0", F.lit("v1"), F.lit("model-a"), F.lit(""), "text", F.format_string("%.4f", F.lit(0.2)), F.lit("512"), F.lit("0")), 256)
    k = c.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("lookups"), F.max(F.floor(F.length("text") / 3.5) + 512).cast("long").alias("token_estimate"))
    return k.withColumn("hits", F.col("lookups") - 1)


def duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that share a text, as unordered pairs: the first two sources of a text (by their first document) and the later document.

    A text's sources are few, whatever the number of its copies: copies are combined before the shuffle."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source", F.md5("text").alias("m")).where("source is not null")
    first = d.groupBy("m", "source").agg(F.min("doc_id").alias("doc_id"))
    two = first.groupBy("m").agg(F.min(F.struct("doc_id", "source")).alias("x"), F.count(F.lit(1)).alias("n")).where("n > 1")
    other = first.join(two, "m").where("source <> x.source").groupBy("m", F.col("x.source").alias("a")).agg(F.min(F.struct("doc_id", "source")).alias("y"))
    return op.unordered_pairs(other.select("a", F.col("y.source").alias("b"), F.col("y.doc_id").alias("doc_id")), "a", "b", "doc_id")


_BLANK = r"'\s+', ' ', 'g'"
_HTML_SQL = rf"trim(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), {_BLANK}))"
_CLEAN_SQL = rf"trim(regexp_replace(coalesce(text, ''), {_BLANK}))"
_DEHYPHEN_SQL = r"regexp_replace(text, '([\p{L}\p{N}_])[-‐‑]\s*\n\s*([\p{L}\p{N}_])', '\1\2', 'g')"


def _section_sql() -> str:
    plain = r"regexp_replace(lower(regexp_replace(trim(regexp_replace(b, '^\s*(?:\d+(?:\.\d+)*|[IVXL]+)\.?\s*', '')), '^[:.\- \t]+|[:.\- \t]+$', '', 'g')), '\s+', ' ', 'g')"
    exact = " ".join(f"WHEN k = '{k}' THEN '{v}'" for k, v in t.SECTIONS.items())
    begin = " ".join(f"WHEN starts_with(k, '{k} ') THEN '{v}'" for k, v in t.SECTIONS.items())
    return rf"""WITH l0 AS (SELECT doc_id, unnest(string_split_regex({_DEHYPHEN_SQL}, '\r\n|\n|\r')) AS line, generate_subscripts(string_split_regex({_DEHYPHEN_SQL}, '\r\n|\n|\r'), 1) - 1 AS line_no FROM documents),
l1 AS (SELECT *, trim(line) AS b FROM l0 WHERE NOT regexp_matches(line, '{t.PAGE_NOISE}')), l2 AS (SELECT *, {plain} AS k FROM l1), l3 AS (SELECT *, coalesce(CASE {exact} END, CASE {begin} END) AS section FROM l2),
l4 AS (SELECT *, CASE WHEN b = '' OR length(b) > 90 THEN false WHEN regexp_matches(b, '[.,;:]$') AND NOT regexp_matches(b, '{t.NUMBERED}') THEN false WHEN regexp_matches(b, '{t.NUMBERED}') OR regexp_matches(b, '{t.ROMAN}') THEN true ELSE len(string_split_regex(b, '\s+')) <= 6 AND section IS NOT NULL END AS head FROM l3),
l5 AS (SELECT *, max(CASE WHEN head THEN line_no ELSE -1 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS start FROM l4),
h AS (SELECT doc_id, line_no AS start, section FROM l5 WHERE head),
g AS (SELECT l5.doc_id, l5.start, trim(regexp_replace(string_agg(line, ' ' ORDER BY line_no) FILTER (NOT head), '\s+', ' ', 'g')) AS body FROM l5 GROUP BY ALL)
SELECT g.doc_id, CAST(g.start AS INT) AS line_no, CASE WHEN g.start = -1 THEN 'Front Matter' ELSE h.section END AS section, CAST(length(body) AS INT) AS chars, md5(body) AS body_md5 FROM g LEFT JOIN h ON g.doc_id = h.doc_id AND g.start = h.start
WHERE coalesce(body, '') <> '' AND coalesce(h.section NOT IN ('References', 'Acknowledgments'), true)"""


QUERIES = {
    "passage_ids": passage_ids, "ingest_dedup_first": ingest_dedup_first, "upsert_dedup_last": upsert_dedup_last, "merge_evidence": merge_evidence, "web_normalise": web_normalise, "domain_counts": domain_counts,
    "char_windows": char_windows, "dehyphenate": dehyphenated, "section_islands": section_islands, "sections_present": sections_present, "section_aware_chunks": section_aware_chunks, "web_chunks": web_chunks, "sentence_segments": sentence_segments,
    "gap_lines": gap_lines, "prompt_keys": prompt_keys, "merge_pairs_unordered": duplicate_pairs,
}

ORACLE_SQL = {
    "passage_ids": f"WITH {PASSAGES_SQL} SELECT doc_id, id, source_type, section, published FROM passages",
    "ingest_dedup_first": f"WITH {PASSAGES_SQL} SELECT id, doc_id, source_id, section FROM passages QUALIFY row_number() OVER (PARTITION BY id ORDER BY doc_id) = 1",
    "upsert_dedup_last": "SELECT conv_id || '/' || role AS key, turn, substr(sha256(trim(text)), 1, 16) AS digest FROM conversations WHERE trim(coalesce(text, '')) <> '' QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC, digest) = 1",
    "merge_evidence": f"SELECT * FROM (SELECT 0 AS seq, doc_id AS place, sha256({_CLEAN_SQL}) AS id FROM documents UNION ALL SELECT 1, page_id, sha256({_HTML_SQL}) FROM pages) QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq, place) = 1",
    "web_normalise": f"SELECT page_id, domain, CAST(length(body) AS INT) AS chars, md5(body) AS body_md5, round(1 / rank, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY page_id) AS rank FROM (SELECT page_id, coalesce(url, '') AS url, {DOMAIN_SQL} AS domain, {_HTML_SQL} AS body FROM pages)) WHERE length(body) >= 80 AND url <> ''",
    "domain_counts": f"SELECT {DOMAIN_SQL} AS domain, count(*) AS pages, count(DISTINCT url) AS urls FROM pages GROUP BY 1",
    "char_windows": f"""WITH c AS (SELECT doc_id, {_CLEAN_SQL} AS w FROM documents), s AS (SELECT doc_id, w, unnest(CASE WHEN length(w) <= 1000 THEN [0] ELSE generate_series(0, length(w) - 1, 850) END) AS start FROM c WHERE w <> '')
SELECT doc_id, CAST(start // 850 AS INT) AS index, CAST(start AS INT) AS start, CAST(length(substr(w, start + 1, 1000)) AS INT) AS chars, md5(substr(w, start + 1, 1000)) AS body_md5 FROM s""",
    "dehyphenate": f"SELECT doc_id, md5({_DEHYPHEN_SQL}) AS fixed_md5, CAST(length(text) - length({_DEHYPHEN_SQL}) AS INT) AS removed FROM documents",
    "section_islands": _section_sql(),
    "sections_present": f"WITH i AS ({_section_sql()}), f AS (SELECT doc_id, section, min(line_no) AS at_ FROM i WHERE section IS NOT NULL GROUP BY ALL) SELECT doc_id, string_agg(section, ', ' ORDER BY at_) AS sections FROM f GROUP BY doc_id",
    "gap_lines": rf"""WITH c AS (SELECT conv_id, turn, regexp_replace(trim(regexp_replace(coalesce(text, ''), {_BLANK})), '[ .]+$', '') AS p FROM conversations WHERE role = 'user'),
g AS (SELECT conv_id, turn, 'could not establish: ' || CASE WHEN length(p) > 200 THEN regexp_replace(regexp_replace(substr(p, 1, 200), ' [^ ]*$', ''), '[ ,;:]+$', '') || '…' ELSE p END AS gap FROM c),
f AS (SELECT conv_id, gap, min(turn) AS turn FROM g GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, gap) AS INT) AS pos FROM f""",
    "prompt_keys": "SELECT sha256('v1' || chr(0) || 'model-a' || chr(0) || '' || chr(0) || text || chr(0) || '0.2000' || chr(0) || '512' || chr(0) || '0') AS key, count(*) AS lookups, CAST(max(floor(length(text) / 3.5) + 512) AS BIGINT) AS token_estimate, count(*) - 1 AS hits FROM conversations WHERE role = 'user' GROUP BY 1",
    "merge_pairs_unordered": """WITH f AS (SELECT md5(text) AS m, source, min(doc_id) AS doc_id FROM documents WHERE source IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY doc_id, source) AS k FROM f WHERE m IS NOT NULL),
p AS (SELECT a.source AS a, b.source AS b, b.doc_id FROM r a JOIN r b ON a.m = b.m AND a.k = 1 AND b.k = 2) SELECT least(a, b) AS low, greatest(a, b) AS high, min(doc_id) AS doc_id FROM p GROUP BY 1, 2""",
}
