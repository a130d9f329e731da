"""Quality rules by host: documents' rule failures, shrunk host rates, and the hosts' verdicts joined back.

Each document gets exact counts and three rules: base (too few words, or too many in repeated 8-word windows), symbols and
repeated lines. A host is a value of `source`. Its failure rate is shrunk by a beta prior, whose mean is the rate over all
documents, and whose spread is that between the hosts' rates, weighed by documents, less what chance alone makes of it. A rate over `reject` makes a host rejected: none of its documents stay. One over `watch` makes it
watched: of its documents those that break no rule stay. Documents of other hosts stay unless they break the base rule.
Only DataFrame functions are used, and no text is shuffled.

Defined cases: a null text has no words, so it breaks the base rule; a null source is a host of its own; repeated rows
count as often as they stand; an empty table gives an empty result. Windows are told apart by 64-bit hashes within one
text. In quality_filter the input row travels in a struct, so that no column name can clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_small, saved, table, words

WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"
NOT_BLANK = r"[^\x20\x09-\x0D]"


def text_counts(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep (docs' columns that stay) and: n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words."""
    t = F.coalesce(F.col(text), F.lit(""))
    kept = [docs[c] for c in (docs.columns if keep is None else keep)]
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(NOT_BLANK))
    a = docs.select(*kept, words(F.col(text)).alias("_w"), lines.alias("_l"), (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).cast("long").alias("n_symbols"))
    n = F.size("_w")
    rest = [F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]
    b = a.select(
        *rest, "n_symbols", n.cast("long").alias("n_words"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"), F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(n > WINDOW, F.transform("_w", lambda x: F.xxhash64(x))).alias("_g"),
    )
    # a window's hash is made of its words' hashes, so that each word is hashed once
    windows = F.transform(F.sequence(F.lit(1), F.size("_g") - (WINDOW - 1)), lambda i: F.xxhash64(*[F.get("_g", i + (k - 1)) for k in range(WINDOW)]))
    b = b.select(*rest, "n_symbols", "n_words", "word_chars", "n_lines", "n_dup_lines", F.when(F.col("_g").isNotNull(), windows).alias("_h"))
    counts = ["n_symbols", "n_words", "word_chars", "n_lines", "n_dup_lines"]
    c = b.select(*rest, *counts, F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))).alias("_s"))
    twin = lambda e, j: F.when((F.get("_s", j - 1)["h"] == e["h"]) | (F.get("_s", j + 1)["h"] == e["h"]), e["at"])
    d = c.select(*rest, *counts, F.sort_array(F.filter(F.transform("_s", twin), lambda p: p.isNotNull())).alias("_p"))
    covered = F.aggregate(F.transform("_p", lambda p, k: F.when(k == 0, WINDOW).otherwise(F.least(F.lit(WINDOW), p - F.get("_p", k - 1)))), F.lit(0), lambda x, y: x + y)
    return d.select(*rest, *counts, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def rules(counted: DataFrame) -> DataFrame:
    """Adds base_failed and rule_failed (that, or one of the other rules)."""
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    symbols = 10 * F.col("n_symbols") > F.col("word_chars")
    lines = 100 * F.col("n_dup_lines") > 30 * F.col("n_lines")
    return counted.withColumn("base_failed", base).withColumn("rule_failed", base | symbols | lines)


def host_verdicts(ruled: DataFrame, host: str, reject: float, watch: float) -> DataFrame:
    """One row per host: host, n, failed, rate (shrunk), verdict (rejected, watched or trusted)."""
    hosts = ruled.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("rule_failed").cast("long")).alias("failed"))
    # the prior is a row of sums over all hosts
    x = lambda c: F.col(c).cast("double")
    prior = hosts.agg(F.sum(x("n")).alias("all"), F.sum(x("failed")).alias("bad"), F.sum(x("failed") * x("failed") / x("n")).alias("bad2"), F.sum(x("n") * x("n")).alias("n2"), F.count(F.lit(1)).alias("hosts"))
    prior = prior.withColumn("m", F.col("bad") / F.col("all"))
    chance = F.col("m") * (1 - F.col("m"))
    free = F.col("all") - F.col("n2") / F.col("all") - (F.col("hosts") - 1)
    # of all variance, the share between hosts (moments of a beta-binomial law); with a prior of strength s it is 1 / (s + 1)
    shared = F.when((chance > 0) & (free > 0), (F.col("bad2") - F.col("all") * F.col("m") * F.col("m") - chance * (F.col("hosts") - 1)) / (chance * free))
    strength = F.when(shared > 0, F.least(F.lit(1e6), F.greatest(F.lit(1.0), 1 / shared - 1))).otherwise(F.lit(1e6))
    prior = prior.select("m", strength.alias("strength"))
    rate = (F.col("failed") + F.col("m") * F.col("strength")) / (F.col("n") + F.col("strength"))
    both = hosts.join(F.broadcast(prior)).withColumn("rate", rate)
    return both.select("host", "n", "failed", "rate", F.when(rate > reject, "rejected").when(rate > watch, "watched").otherwise("trusted").alias("verdict"))


def judged(ruled: DataFrame, host: str, *, reject: float = 0.5, watch: float = 0.05) -> DataFrame:
    """Adds host_rate, host_verdict and kept."""
    verdicts = host_verdicts(ruled, host, reject, watch).select("host", F.col("rate").alias("host_rate"), F.col("verdict").alias("host_verdict"))
    verdicts = saved(verdicts, "hosts")
    out = join_small(ruled, verdicts, F.col(host).eqNullSafe(F.col("host"))).drop("host")
    ok = F.when(F.col("host_verdict") == "rejected", False).when(F.col("host_verdict") == "watched", ~F.col("rule_failed")).otherwise(True)
    return out.withColumn("kept", ~F.col("base_failed") & ok)


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows that stay, with the columns of docs."""
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("source").alias("_host"), F.col("text").alias("_text"))
    ruled = saved(rules(text_counts(packed, "_text", ["row", "_host"])), "ruled")
    return judged(ruled, "_host").where("kept").select("row.*")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    ruled = saved(rules(text_counts(docs, "text", ["doc_id", "source"])), "ruled")
    return judged(ruled, "source").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule_failed", F.round("host_rate", 9).alias("host_rate"), "host_verdict")


_COUNTS_SQL = r"""
w AS (SELECT row_number() OVER () AS id, doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT id, i, list_aggregate(ws[i:i + 7], 'string_agg', ' ') AS s FROM (SELECT id, ws, unnest(generate_series(1, len(ws) - 7)) AS i FROM w WHERE len(ws) > 8)),
r AS (SELECT id, i, lag(i) OVER (PARTITION BY id ORDER BY i) AS was FROM (SELECT id, i, count(*) OVER (PARTITION BY id, s) AS c FROM g) WHERE c > 1),
p AS (SELECT id, sum(least(8, i - coalesce(was, i - 8))) AS n FROM r GROUP BY id),
l AS (SELECT id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
b AS (SELECT w.doc_id, w.source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
  CAST(len(ls) AS BIGINT) AS n_lines, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words FROM w JOIN l USING (id) LEFT JOIN p USING (id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b),
u AS (SELECT *, base_failed OR 10 * n_symbols > word_chars OR 100 * n_dup_lines > 30 * n_lines AS rule_failed FROM f)"""

ORACLE_SQL = f"""WITH {_COUNTS_SQL},
h AS (SELECT source, count(*) AS n, sum(CAST(rule_failed AS BIGINT)) AS k FROM u GROUP BY source),
m0 AS (SELECT sum(CAST(n AS DOUBLE)) AS a, sum(CAST(k AS DOUBLE)) AS b, sum(CAST(k AS DOUBLE) * CAST(k AS DOUBLE) / CAST(n AS DOUBLE)) AS b2, sum(CAST(n AS DOUBLE) * CAST(n AS DOUBLE)) AS n2, count(*) AS c FROM h),
m AS (SELECT *, b / a AS m, b / a * (1 - b / a) AS v, a - n2 / a - (c - 1) AS f FROM m0),
g0 AS (SELECT m, CASE WHEN v > 0 AND f > 0 THEN (b2 - a * m * m - v * (c - 1)) / (v * f) END AS r FROM m),
q AS (SELECT m, CASE WHEN r > 0 THEN least(1e6, greatest(1.0, 1 / r - 1)) ELSE 1e6 END AS s FROM g0),
z AS (SELECT source, (k + m * s) / (n + s) AS rate FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND CASE WHEN rate > 0.5 THEN false WHEN rate > 0.05 THEN NOT rule_failed ELSE true END AS kept, rule_failed, round(rate, 9) AS host_rate,
  CASE WHEN rate > 0.5 THEN 'rejected' WHEN rate > 0.05 THEN 'watched' ELSE 'trusted' END AS host_verdict
FROM u JOIN z ON u.source IS NOT DISTINCT FROM z.source"""
