"""Queries over what comes from outside: results of search providers, cached answers, papers and passages by id, errors, and payloads.

Providers, statuses and messages are rules on the keys of pages and events, as the tables have none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwell.functions import text as t
from groundwell.functions.json_text import bound
from groundwell.operators import outside, rules
from groundwell.sources.tables import CALLS_SQL, DOMAIN_SQL, PASSAGES_SQL, calls, passages, read, vectors

#: In the order in which they're asked, the preferred one first.
PROVIDERS = ["ddgs", "tavily", "mirror"]
MESSAGES = [
    "Rate limit reached, please try again in 7.425s (TPM)", "try again in 1m2.5s: tokens per day", "Rate limit reached", "json_validate_failed: bad output", "context_length exceeded", "overloaded", "bad request", "Try again in 2m", "server error", "Connection reset",
]
STATUSES = [429, 429, 429, 400, 400, 503, 400, 429, 500, None, 401]
REQUIRED = ["k", "v"]


def _nth(values: list, at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))


def provider_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as results of searches (a search is a page's id over 10): the first provider in order that has rows with a text and an address wins. Raw
    content comes before content; a provider that fails for a search has no rows."""
    p = read(spark, sf_dir, "pages").select("page_id", F.floor(F.col("page_id") / 10).alias("search"), (F.col("page_id") % 3).cast("int").alias("provider"), F.coalesce("url", F.lit("")).alias("url"), t.html_text(F.col("html")).alias("body"))
    raw = F.when(F.col("page_id") % 4 == 0, F.lit("")).otherwise(F.substring("body", 1, 300))
    p = p.select("page_id", "search", "provider", "url", F.coalesce(F.nullif(raw, F.lit("")), F.nullif(F.substring("body", 1, 80), F.lit(""))).alias("content"))
    ok = p.where(F.col("content").isNotNull() & (F.col("url") != "") & ((F.col("search") + F.col("provider")) % 5 > 0))
    ok = ok.select("page_id", "search", "provider", F.md5("content").alias("content_md5"))
    return rules.first_provider(ok, "search", "provider").select("search", F.element_at(F.array(*map(F.lit, PROVIDERS)), F.col("provider") + 1).alias("provider"), "page_id", "content_md5")


def search_credits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A month's tokens of a model as its search credits, and the cap of a day: what is configured (not for views), or a thirtieth; one at least."""
    c = calls(spark, sf_dir).groupBy("model", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.sum("tokens").alias("credits"))
    configured = F.when(F.col("model") == "click", F.lit(33)).when(F.col("model") == "error", F.lit(0))
    return c.select("model", "month", "credits", outside.daily_cap(F.col("credits"), configured).alias("daily_cap"))


def cache_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as lookups in a cache that earlier turns were put into: of several entries of a key the last one counts; an entry of another
    version is a miss. Lookups, hits and rate of each conversation, 0 without lookups."""
    c = read(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.md5("text").alias("key"))
    put = c.where("turn % 3 < 2").select("key", F.struct("conv_id", "turn").alias("at"), (F.col("turn") % 2 + 1).alias("version"))
    asked = (F.col("turn") % 4 > 0).cast("long")
    g = outside.cached(c, put, 1).groupBy("conv_id").agg(F.sum(asked).alias("lookups"), F.sum(asked * F.col("hit").cast("long")).alias("hits"))
    return g.withColumn("hit_rate", outside.hit_rate(F.col("hits"), F.col("lookups")))


def passages_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages with the ids of a list (those of judged documents, and one that no passage has)."""
    p = passages(spark, sf_dir).select("id", "doc_id", "source_id")
    ids = read(spark, sf_dir, "labels").select("doc_id").join(p, "doc_id").select("id")
    return outside.by_id(p, ids.unionByName(spark.createDataFrame([("P000000000000",)], "id string")), "id")


def papers_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as papers, looked up by short id (the last part of an address): those of a list. Pages without title and text aren't papers; the score
    is that of the place among a domain's found ones."""
    p = read(spark, sf_dir, "pages").select("page_id", F.substring_index(F.coalesce("url", F.lit("")), "/", -1).alias("short_id"), t.domain(F.col("url")).alias("domain"), t.clean(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), t.html_text(F.col("html")).alias("body"))
    listed = p.where("(title <> '' or body <> '') and page_id % 10 = 0")
    found = outside.papers(outside.by_id(p, listed, "short_id").select("page_id", "short_id", "domain", "title", "body"), "domain", "page_id")
    return found.select("page_id", "short_id", "domain", F.length("title").alias("title_chars"), F.length("body").alias("chars"), "score")


def error_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to do about an error, by status and message: try again, in plain form, wait, go to another model (for good or for now), or give up.
    And for how long the provider asks to wait, a minute if it doesn't say."""
    e = calls(spark, sf_dir).select("event_id", _nth(MESSAGES, F.col("event_id")).alias("message"), _nth(STATUSES, F.col("event_id") + F.floor(F.col("event_id") / 10)).alias("status"), F.when(F.col("event_id") % 23 == 0, F.lit("12.5")).when(F.col("event_id") % 29 == 0, F.lit("soon")).alias("header"))
    e = e.withColumn("kind", F.when(F.col("message") == "Connection reset", "ConnectionError").otherwise("APIError"))
    return e.select("event_id", "status", rules.error_action(F.col("status"), F.col("message"), F.col("kind")).alias("action"), rules.error_wait(F.col("message"), F.col("header")).alias("wait"))


def class_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probability of a class (a vector's label) from logits (its first three values, or one)."""
    z = F.transform(F.slice("vector", 1, F.when(F.col("id") % 7 == 0, 1).otherwise(3)), lambda x: x.cast("double"))
    v = vectors(spark, sf_dir).select("id", z.alias("z"), F.when(F.col("id") % 11 == 0, 5).otherwise(F.col("label") % 3).cast("int").alias("which"))
    return v.select("id", F.round(outside.class_probability(F.col("z"), F.col("which")), 6).alias("p"))


def premise_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an entailment model reads of a passage: its first 400 characters, without extra blanks."""
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(F.substring(t.clean(F.col("text")), 1, 400)).alias("window_md5"))


def missing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose properties lack a key that is required, and which one, with the event as context."""
    e = read(spark, sf_dir, "events").select("event_type", F.array_join(outside.missing_keys(F.col("props"), REQUIRED), ",").alias("missing"))
    return e.where("missing <> ''").groupBy("event_type", "missing").agg(F.count(F.lit(1)).alias("events"))


def payload_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as trace payloads: long texts and lists are cut, and say by how much."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    held = d.select("doc_id", bound(F.to_json(F.struct("text", F.filter(F.split("text", " "), lambda x: x != "").alias("words")))).alias("p"))
    words = F.from_json(F.get_json_object("p", "$.words"), "array<string>")
    return held.select("doc_id", F.md5(F.get_json_object("p", "$.text")).alias("text_md5"), F.size(words).alias("items"), F.get(words, F.size(words) - 1).alias("last"))


_STATUS = "(" + str(STATUSES).replace("None", "NULL") + ")[CAST((event_id + event_id // 10) % 11 + 1 AS INT)]"
_WAIT = r"'(?i)try again in\s+(?:(\d+(?:\.\d+)?)m)?\s*(?:(\d+(?:\.\d+)?)s)?'"
_BODY = r"trim(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"

QUERIES = {
    f.__name__: f
    for f in (provider_results, search_credits, cache_reads, passages_by_id, papers_by_id, error_actions, class_probability, premise_windows, missing_keys, payload_bounds)
}

ORACLE_SQL = {
    "provider_results": rf"""WITH p AS (SELECT page_id, page_id // 10 AS search, page_id % 3 AS provider, coalesce(url, '') AS url, {_BODY} AS body FROM pages),
c AS (SELECT *, coalesce(nullif(CASE WHEN page_id % 4 = 0 THEN '' ELSE substr(body, 1, 300) END, ''), nullif(substr(body, 1, 80), '')) AS content FROM p), k AS (SELECT * FROM c WHERE content IS NOT NULL AND url <> '' AND (search + provider) % 5 > 0)
SELECT search, (['ddgs', 'tavily', 'mirror'])[CAST(provider + 1 AS INT)] AS provider, page_id, md5(content) AS content_md5 FROM k QUALIFY provider = min(provider) OVER (PARTITION BY search)""",
    "search_credits": f"WITH {CALLS_SQL}, c AS (SELECT model, strftime(ts, '%Y-%m') AS month, CAST(sum(tokens) AS BIGINT) AS credits FROM calls GROUP BY ALL) SELECT *, CAST(greatest(1, CASE model WHEN 'click' THEN 33 WHEN 'error' THEN 0 ELSE credits // 30 END) AS BIGINT) AS daily_cap FROM c",
    "cache_reads": """WITH c AS (SELECT conv_id, turn, md5(text) AS key FROM conversations WHERE role = 'user'), p AS (SELECT key, turn % 2 + 1 AS version FROM c WHERE turn % 3 < 2 QUALIFY row_number() OVER (PARTITION BY key ORDER BY conv_id DESC, turn DESC) = 1),
g AS (SELECT conv_id, count(*) FILTER (turn % 4 > 0) AS lookups, count(p.key) FILTER (turn % 4 > 0) AS hits FROM c LEFT JOIN p ON c.key = p.key AND version = 1 GROUP BY conv_id) SELECT *, round(coalesce(hits / nullif(lookups, 0), 0.0), 6) AS hit_rate FROM g""",
    "passages_by_id": f"WITH {PASSAGES_SQL} SELECT id, doc_id, source_id FROM passages WHERE id IN (SELECT id FROM passages WHERE doc_id IN (SELECT doc_id FROM labels))",
    "papers_by_id": rf"""WITH p AS (SELECT page_id, split_part(coalesce(url, ''), '/', -1) AS short_id, {DOMAIN_SQL} AS domain, trim(regexp_replace(regexp_extract(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title, {_BODY} AS body FROM pages),
k AS (SELECT * FROM p WHERE title <> '' OR body <> '') SELECT page_id, short_id, domain, CAST(length(title) AS INT) AS title_chars, CAST(length(body) AS INT) AS chars, round(1.0 / row_number() OVER (PARTITION BY domain ORDER BY page_id), 6) AS score FROM k WHERE short_id IN (SELECT short_id FROM k WHERE page_id % 10 = 0)""",
    "error_actions": f"""WITH e AS (SELECT event_id, ({MESSAGES})[CAST(event_id % 10 + 1 AS INT)] AS m, {_STATUS} AS s, CASE WHEN event_id % 23 = 0 THEN 12.5 END AS h FROM events),
x AS (SELECT *, lower(m) AS l, TRY_CAST(regexp_extract(m, {_WAIT}, 1) AS DOUBLE) AS mins, TRY_CAST(regexp_extract(m, {_WAIT}, 2) AS DOUBLE) AS secs FROM e)
SELECT event_id, s AS status, CASE WHEN s = 400 AND regexp_matches(l, 'json_validate_failed|failed to validate json|context_length|too large|overloaded') THEN 'retry_plain' WHEN s = 429 AND regexp_matches(l, 'per day|\\(tpd\\)|\\(rpd\\)|perday') THEN 'switch' WHEN s = 429 AND regexp_matches(l, 'per minute|\\(tpm\\)|\\(rpm\\)|perminute') THEN 'wait'
  WHEN s = 429 THEN 'switch_keep' WHEN s IN (401, 403) THEN 'fatal' WHEN s IN (500, 502, 503) THEN 'retry' WHEN m = 'Connection reset' THEN 'retry' WHEN s BETWEEN 400 AND 499 THEN 'fatal' ELSE 'retry' END AS action,
  CAST(coalesce(h, CASE WHEN mins IS NOT NULL OR secs IS NOT NULL THEN coalesce(mins, 0) * 60 + coalesce(secs, 0) END, 60.0) AS DOUBLE) AS wait FROM x""",
    "class_probability": """WITH v AS (SELECT vec_id AS id, CAST(embedding[1:CASE WHEN vec_id % 7 = 0 THEN 1 ELSE 3 END] AS DOUBLE[]) AS z, CAST(CASE WHEN vec_id % 11 = 0 THEN 5 ELSE label % 3 END AS INT) + 1 AS w FROM embeddings), e AS (SELECT *, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM v)
SELECT id, round(CASE WHEN len(z) = 1 THEN z[1] ELSE coalesce(e[w] / list_sum(e), 0.0) END, 6) AS p FROM e""",
    "premise_windows": r"SELECT doc_id, md5(substr(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), 1, 400)) AS window_md5 FROM documents",
    "missing_keys": "WITH e AS (SELECT event_type, array_to_string(list_filter(['k', 'v'], lambda x: NOT list_contains(coalesce(json_keys(props), []), x)), ',') AS missing FROM events) SELECT *, count(*) AS events FROM e WHERE missing <> '' GROUP BY ALL",
    "payload_bounds": """WITH d AS (SELECT doc_id, coalesce(text, '') AS x, list_filter(string_split(coalesce(text, ''), ' '), lambda w: w <> '') AS w FROM documents)
SELECT doc_id, md5(CASE WHEN length(x) > 2000 THEN substr(x, 1, 2000) || '... <+' || (length(x) - 2000) || ' chars>' ELSE x END) AS text_md5, CAST(least(26, len(w)) AS INT) AS items, CASE WHEN len(w) > 25 THEN '<+' || (len(w) - 25) || ' more>' ELSE w[-1] END AS last FROM d""",
}
