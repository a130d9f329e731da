"""Queries over events as a run trace (user_id is the run, event_type the surface or model) and as calls against quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwell.operators import quota as q
from groundwell.operators import retrieval as r
from groundwell.operators.ranks import last_before, lasts_before, ranked_in
from groundwell.sources.tables import CALLS_SQL, calls
from groundwell.sources.work import work_path
from groundwell.streaming import windows as stream

SURFACES = list(q.ZONES)


def surface_counts_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of each run on each surface, 0 where there are none."""
    c = calls(spark, sf_dir).groupBy("user_id").agg(*[F.sum((F.col("model") == s).cast("long")).alias(s) for s in SURFACES])
    return c.unpivot("user_id", SURFACES, "surface", "n")


def token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and tokens by model, and those that a cache answered (even k)."""
    cached = F.get_json_object("props", "$.k").cast("int") % 2 == 0
    return calls(spark, sf_dir).groupBy("model").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"), F.sum(F.when(cached, F.col("tokens")).otherwise(0)).alias("cached_tokens"), F.sum(cached.cast("long")).alias("cached_calls"))


def run_model_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each run calls each model, for how many tokens, and when first; most calls first."""
    c = calls(spark, sf_dir).groupBy("user_id", "model").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"), F.min("us").alias("first_us"))
    return ranked_in(c.withColumn("fewer", -F.col("calls")), "user_id", "fewer", "model").select("user_id", F.col("rank").alias("place"), "model", "calls", "tokens", "first_us")


def trace_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each run: events, first and last time, errors, models, and the time of the last purchase or else of the last event."""
    end = F.coalesce(F.max(F.when(F.col("model") == "purchase", F.col("us"))), F.max("us"))
    return calls(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.min("us").alias("first_us"), (end - F.min("us")).alias("wall_us"), F.sum((F.col("model") == "error").cast("long")).alias("errors"), F.countDistinct("model").alias("models"))


def span_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enter and exit of each run and node: a node's events in order, in pairs. trace_spans has spans by a stack."""
    c = calls(spark, sf_dir).select("event_id", "user_id", "model", "us", F.struct("user_id", "model").alias("node"))
    paired = ranked_in(c, "node", "us", "event_id").withColumn("span", F.ceil(F.col("rank") / 2).cast("int"))
    return paired.groupBy("user_id", "model", "span").agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("enter_us"), F.when(F.count(F.lit(1)) == 2, F.max("us") - F.min("us")).alias("duration_us"))


def route_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a run goes from one node to the next."""
    c = last_before(calls(spark, sf_dir).select("event_id", "user_id", "model", "us"), "user_id", "model", "from_node", "us", "event_id")
    return c.where("from_node is not null").groupBy("from_node", F.col("model").alias("to_node")).agg(F.count(F.lit(1)).alias("n"))


def route_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each error, the last other node of the run before it."""
    c = calls(spark, sf_dir).select("event_id", "user_id", "us", "model", F.when(F.col("model") != "error", F.col("model")).alias("other"))
    return last_before(c, "user_id", "other", "origin", "us", "event_id").where("model = 'error'").select("event_id", "user_id", "origin")


LOG = "seq long, run long, us long, type string, node string, surface string, from_node string, to_node string, reason string, tokens long"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a trace log of JSON lines, read back. Of a run's events of a node the odd ones enter it and the even ones leave it; errors are
    routes. Every 50th line is cut off and every 51st is blank: such lines are skipped."""
    c = calls(spark, sf_dir).withColumn("by", F.struct("user_id", "model"))
    c = ranked_in(c, "by", "us", "event_id").withColumnRenamed("rank", "n").withColumn("route", F.col("model") == "error")
    kind = F.when(F.col("route"), "route").when(F.col("n") % 2 == 1, "node_enter").otherwise("node_exit")
    row = F.struct(
        F.col("event_id").alias("seq"), F.col("user_id").alias("run"), "us", kind.alias("type"), F.when(~F.col("route"), F.col("model")).alias("node"), F.when(F.col("tokens") % 3 == 0, F.col("model")).alias("surface"),
        F.when(F.col("route") & (F.col("event_id") % 4 == 0), "planner").alias("from_node"), F.when(F.col("route"), "finalizer").alias("to_node"), F.when(F.col("route"), F.concat(F.lit("k="), F.get_json_object("props", "$.k"))).alias("reason"), "tokens",
    )
    line = F.to_json(row)
    path = work_path(spark, "trace")
    c.select(F.when(F.col("event_id") % 51 == 0, "").when(F.col("event_id") % 50 == 0, F.substring(line, 1, 20)).otherwise(line).alias("value")).write.text(path)
    return spark.read.schema(LOG).json(path, mode="DROPMALFORMED").where("seq is not null")


def trace_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the lines of a log say, by type and surface; lines that can't be read aren't counted."""
    return _log(spark, sf_dir).groupBy("type", "surface").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("run").alias("runs"), F.sum("tokens").alias("tokens"))


def nodes_visited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of each run in the order in which it entered them, a row for each."""
    e = _log(spark, sf_dir).where("type = 'node_enter'").select("run", "us", "seq", "node")
    return ranked_in(e, "run", "us", "seq").select("run", F.col("rank").alias("place"), "node")


def route_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each route with its reason and where it came from: what it says itself, or else the node that was entered last of those still open, or else
    the node that was left last."""
    nodes = [s for s in SURFACES if s != "error"]
    at = lambda kind, n: F.when((F.col("type") == kind) & (F.col("node") == n), F.struct("us", "seq"))
    kinds = {f"{k}_{n}": at(k, n) for k in ("node_enter", "node_exit") for n in nodes}
    log = _log(spark, sf_dir).select("run", "us", "seq", "type", "from_node", "to_node", "reason", *[c.alias(f"is_{k}") for k, c in kinds.items()])
    log = lasts_before(log, "run", {k: f"is_{k}" for k in kinds}, "us", "seq")
    last = lambda k, n: F.when(F.col(f"{k}_{n}").isNotNull(), F.struct(F.col(f"{k}_{n}").alias("at"), F.lit(n).alias("node")))
    is_open = lambda n: F.col(f"node_exit_{n}").isNull() | (F.col(f"node_enter_{n}") > F.col(f"node_exit_{n}"))
    newest = lambda found: F.array_max(F.array_compact(F.array(*found)))
    open_, left = newest(F.when(is_open(n), last("node_enter", n)) for n in nodes), newest(last("node_exit", n) for n in nodes)
    return log.where("type = 'route'").select("run", "seq", F.coalesce("from_node", open_["node"], left["node"]).alias("from_node"), "to_node", "reason")


def event_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of each run in order, with the time since its first."""
    log = _log(spark, sf_dir).select("run", "us", "seq", "type", F.coalesce("node", "to_node").alias("node"))
    first = log.groupBy("run").agg(F.min("us").alias("first_us"))
    return ranked_in(log, "run", "us", "seq").join(first, "run").select("run", F.col("rank").alias("place"), "type", "node", (F.col("us") - F.col("first_us")).alias("since_us"))


def quota_minute_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.minute_windows(calls(spark, sf_dir).select("event_id", "us", "model", "tokens")).select("event_id", "model", "n_minute", "tokens_minute", "oldest")


def day_bucket_tz(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = calls(spark, sf_dir).withColumn("day", q.local_day(F.col("us"), F.col("model")))
    return c.groupBy("model", "day").agg(F.count(F.lit(1)).alias("requests"), F.sum("tokens").alias("tokens"), F.greatest(F.lit(0), q.TPD - F.sum("tokens")).alias("remaining"))


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each model at its last call: calls and tokens of the minute before and of its day, the call itself included."""
    c = calls(spark, sf_dir).select("event_id", "us", "model", "tokens").withColumn("day", q.local_day(F.col("us"), F.col("model")))
    last = c.groupBy("model").agg(F.max("us").alias("now"), F.max("day").alias("today"))
    held = c.join(r.small(last), "model").where("day = today or us >= now - 60000000")
    now = (F.col("us") >= F.col("now") - q.MINUTE).cast("long")
    today = (F.col("day") == F.col("today")).cast("long")
    return held.groupBy("model", "now").agg(F.sum(now).alias("rpm"), F.sum(now * F.col("tokens")).alias("tpm"), F.sum(today).alias("rpd"), F.sum(today * F.col("tokens")).alias("tpd"))


def quota_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest use against limits, by model and dimension."""
    caps = ", ".join(f"'{n}', {n}, {cap}L" for n, cap in (("rpm", q.RPM), ("tpm", q.TPM), ("rpd", q.RPD), ("tpd", q.TPD)))
    s = _snapshot(spark, sf_dir).select("model", F.expr(f"stack(4, {caps}) as (dimension, used, cap)"))
    return s.withColumn("share", F.round(F.col("used") / F.col("cap"), 6))


def quota_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each model's day at its last call, until when, and the record that would use it up."""
    s = _snapshot(spark, sf_dir)
    left = F.greatest(F.lit(0), q.TPD - F.col("tpd"))
    return s.select("model", F.round(q.seconds_to_reset(F.col("now"), F.col("model")), 3).alias("seconds"), left.alias("remaining"), F.greatest(F.col("tpd"), F.lit(q.TPD)).alias("used_when_exhausted"), (left <= 0).alias("exhausted"))


def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.windowed(calls(spark, sf_dir), "1 hour")


def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.windowed(calls(spark, sf_dir), "1 hour", "15 minutes")


def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = calls(spark, sf_dir)
    s = c.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("tokens"))
    return s.select("user_id", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n", "tokens")


def tumbling_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tumbling windows by Structured Streaming, run to the end of what is there."""
    return stream.run_windows(spark, sf_dir)


_ZONE = "CASE WHEN model IN ('click', 'purchase') THEN 'America/Los_Angeles' ELSE 'UTC' END"
_DAY = f"CAST(floor(epoch_us(make_timestamp(us) AT TIME ZONE 'UTC' AT TIME ZONE {_ZONE}) / 86400000000) AS BIGINT)"

QUERIES = {
    f.__name__: f
    for f in (surface_counts_zero_fill, token_totals, run_model_calls, trace_summary, span_pairs, route_edges, route_origin, trace_log, nodes_visited, route_reasons, event_timeline, quota_minute_window, day_bucket_tz, quota_status, quota_reset, tumbling_windows, sliding_windows, session_windows, tumbling_stream)
}
_TUMBLE = f"WITH {CALLS_SQL} SELECT model, CAST(us // 3600000000 * 3600000000 AS BIGINT) AS start_us, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens FROM calls GROUP BY 1, 2"
_MW = "mw AS (SELECT *, count(*) OVER w - 1 AS n_minute, sum(tokens) OVER w - tokens AS tokens_minute, CASE WHEN count(*) OVER w > 1 THEN min(us) OVER w END AS oldest FROM calls WINDOW w AS (PARTITION BY model ORDER BY us RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW))"
_LOG_SQL = """l0 AS (SELECT *, row_number() OVER (PARTITION BY user_id, model ORDER BY us, event_id) AS n FROM calls),
lg AS (SELECT event_id AS seq, user_id AS run, us, CASE WHEN model = 'error' THEN 'route' WHEN n % 2 = 1 THEN 'node_enter' ELSE 'node_exit' END AS type, CASE WHEN model <> 'error' THEN model END AS node, CASE WHEN tokens % 3 = 0 THEN model END AS surface,
  CASE WHEN model = 'error' AND event_id % 4 = 0 THEN 'planner' END AS from_node, CASE WHEN model = 'error' THEN 'finalizer' END AS to_node, CASE WHEN model = 'error' THEN 'k=' || json_extract_string(props, '$.k') END AS reason, tokens FROM l0 WHERE event_id % 50 <> 0 AND event_id % 51 <> 0)"""
_SNAP_SQL = f"""dd AS (SELECT *, {_DAY} AS day FROM calls), la AS (SELECT model, max(us) AS now, max(day) AS today FROM dd GROUP BY model),
snap AS (SELECT model, now, today, count(*) FILTER (us >= now - 60000000) AS rpm, coalesce(sum(tokens) FILTER (us >= now - 60000000), 0) AS tpm, count(*) FILTER (day = today) AS rpd, coalesce(sum(tokens) FILTER (day = today), 0) AS tpd FROM dd JOIN la USING (model) GROUP BY ALL)"""
ORACLE_SQL = {
    "surface_counts_zero_fill": f"WITH {CALLS_SQL}, u AS (SELECT DISTINCT user_id FROM calls), s AS (SELECT unnest({SURFACES}) AS surface) SELECT u.user_id, s.surface, count(c.model) AS n FROM u CROSS JOIN s LEFT JOIN calls c ON c.user_id = u.user_id AND c.model = s.surface GROUP BY ALL",
    "token_totals": f"WITH {CALLS_SQL}, k AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) % 2 = 0 AS cached FROM calls) SELECT model, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(CASE WHEN cached THEN tokens ELSE 0 END) AS BIGINT) AS cached_tokens, count(*) FILTER (cached) AS cached_calls FROM k GROUP BY model",
    "run_model_calls": f"WITH {CALLS_SQL}, c AS (SELECT user_id, model, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens, min(us) AS first_us FROM calls GROUP BY ALL) SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY calls DESC, model) AS INT) AS place, model, calls, tokens, first_us FROM c",
    "trace_summary": f"WITH {CALLS_SQL} SELECT user_id, count(*) AS events, min(us) AS first_us, coalesce(max(us) FILTER (model = 'purchase'), max(us)) - min(us) AS wall_us, count(*) FILTER (model = 'error') AS errors, count(DISTINCT model) AS models FROM calls GROUP BY user_id",
    "span_pairs": f"WITH {CALLS_SQL}, s AS (SELECT *, CAST(ceil(row_number() OVER (PARTITION BY user_id, model ORDER BY us, event_id) / 2) AS INT) AS span FROM calls) SELECT user_id, model, span, count(*) AS n, min(us) AS enter_us, CASE WHEN count(*) = 2 THEN max(us) - min(us) END AS duration_us FROM s GROUP BY ALL",
    "route_edges": f"WITH {CALLS_SQL}, e AS (SELECT lag(model) OVER (PARTITION BY user_id ORDER BY us, event_id) AS from_node, model AS to_node FROM calls) SELECT from_node, to_node, count(*) AS n FROM e WHERE from_node IS NOT NULL GROUP BY ALL",
    "route_origin": f"WITH {CALLS_SQL}, o AS (SELECT *, last_value(CASE WHEN model <> 'error' THEN model END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS origin FROM calls) SELECT event_id, user_id, origin FROM o WHERE model = 'error'",
    "trace_log": f"WITH {CALLS_SQL}, {_LOG_SQL} SELECT type, surface, count(*) AS events, count(DISTINCT run) AS runs, CAST(sum(tokens) AS BIGINT) AS tokens FROM lg GROUP BY ALL",
    "nodes_visited": f"WITH {CALLS_SQL}, {_LOG_SQL} SELECT run, CAST(row_number() OVER (PARTITION BY run ORDER BY us, seq) AS INT) AS place, node FROM lg WHERE type = 'node_enter'",
    "route_reasons": f"""WITH {CALLS_SQL}, {_LOG_SQL}, n AS (SELECT unnest({[s for s in SURFACES if s != 'error']}) AS nd), x AS (SELECT r.run, r.seq, r.from_node, r.to_node, r.reason, nd, max(row(e.us, e.seq)) FILTER (e.type = 'node_enter') AS ent, max(row(e.us, e.seq)) FILTER (e.type = 'node_exit') AS ext
  FROM lg r CROSS JOIN n LEFT JOIN lg e ON e.run = r.run AND e.node = nd AND (e.us < r.us OR (e.us = r.us AND e.seq < r.seq)) WHERE r.type = 'route' GROUP BY ALL)
SELECT run, seq, coalesce(any_value(from_node), arg_max(nd, ent) FILTER (ent IS NOT NULL AND (ext IS NULL OR ent > ext)), arg_max(nd, ext) FILTER (ext IS NOT NULL)) AS from_node, any_value(to_node) AS to_node, any_value(reason) AS reason FROM x GROUP BY run, seq""",
    "event_timeline": f"WITH {CALLS_SQL}, {_LOG_SQL} SELECT run, CAST(row_number() OVER w AS INT) AS place, type, coalesce(node, to_node) AS node, us - first_value(us) OVER w AS since_us FROM lg WINDOW w AS (PARTITION BY run ORDER BY us, seq)",
    "quota_minute_window": f"WITH {CALLS_SQL}, {_MW} SELECT event_id, model, n_minute, CAST(tokens_minute AS BIGINT) AS tokens_minute, oldest FROM mw",
    "day_bucket_tz": f"WITH {CALLS_SQL} SELECT model, {_DAY} AS day, count(*) AS requests, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(greatest(0, 200000 - sum(tokens)) AS BIGINT) AS remaining FROM calls GROUP BY 1, 2",
    "quota_status": f"WITH {CALLS_SQL}, {_SNAP_SQL}" + " UNION ALL ".join(f" SELECT model, '{n}' AS dimension, CAST({n} AS BIGINT) AS used, CAST({cap} AS BIGINT) AS cap, round({n} / {cap}, 6) AS share FROM snap" for n, cap in (("rpm", 30), ("tpm", 8000), ("rpd", 1000), ("tpd", 200000))),
    "quota_reset": f"WITH {CALLS_SQL}, {_SNAP_SQL} SELECT model, round((epoch_us(make_timestamp(CAST(today * 86400000000 AS BIGINT)) AT TIME ZONE {_ZONE}) + 86400000000 - now) / 1000000, 3) AS seconds, CAST(greatest(0, 200000 - tpd) AS BIGINT) AS remaining, CAST(greatest(tpd, 200000) AS BIGINT) AS used_when_exhausted, tpd >= 200000 AS exhausted FROM snap",
    "tumbling_windows": _TUMBLE,
    "tumbling_stream": _TUMBLE,
    "sliding_windows": f"WITH {CALLS_SQL}, s AS (SELECT model, tokens, unnest([us // 900000000 * 900000000, us // 900000000 * 900000000 - 900000000, us // 900000000 * 900000000 - 1800000000, us // 900000000 * 900000000 - 2700000000]) AS start_us FROM calls) SELECT model, CAST(start_us AS BIGINT) AS start_us, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens FROM s GROUP BY 1, 2",
    "session_windows": f"""WITH {CALLS_SQL}, g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) < 1800000000 THEN 0 ELSE 1 END AS fresh FROM calls), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us, event_id) AS sid FROM g)
SELECT user_id, min(us) AS start_us, max(us) + 1800000000 AS end_us, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens FROM s GROUP BY user_id, sid""",
}
