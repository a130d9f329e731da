"""Queries over calls that limits admit, and over spans of run traces, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwell.operators import admission as a
from groundwell.operators import quota as q
from groundwell.operators import spans as s
from groundwell.plans.traces import SURFACES
from groundwell.sources.tables import CALLS_SQL, calls
from groundwell.sources.work import work_path
from groundwell.streaming import admission as admission_of_stream
from groundwell.streaming import trace


def limits(spark: SparkSession) -> DataFrame:
    """The stand-in models' limits and zones."""
    return spark.createDataFrame([(m, q.RPM, q.TPM, q.RPD, q.TPD, z) for m, z in q.ZONES.items()], "model string, rpm long, tpm long, rpd long, tpd long, zone string")


def quota_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All calls in order of time against their models' limits; a call that is stopped leaves no trace."""
    return a.admitted(calls(spark, sf_dir), limits(spark))


def admission_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by a stream with state, and a closing call that moves the time past the last one."""
    path = work_path(spark, "admission")
    c = calls(spark, sf_dir).select("event_id", "us", "model", "tokens")
    c.write.parquet(f"{path}/calls")
    close = c.agg((F.max("us") + 3_600_000_000).alias("us")).where("us is not null").select(F.lit(-1).cast("long").alias("event_id"), "us", F.lit("").alias("model"), F.lit(0).cast("long").alias("tokens"))
    close.write.mode("append").parquet(f"{path}/calls")
    found = admission_of_stream.run_admission(spark, f"{path}/calls", "event_id long, us long, model string, tokens long", limits(spark), path, files=100_000)
    return found.drop("late")


LOG = "seq long, run long, us long, type string, node string, surface string, from_node string, to_node string, reason string, tokens long"


def nested_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of nested spans: each event enters its own node and one within it (now and then the same), routes, leaves both. Errors end the outer one."""
    c = calls(spark, sf_dir)
    inner = F.when(F.col("tokens") % 3 == 0, F.col("model")).otherwise(F.element_at(F.array(*map(F.lit, SURFACES)), (F.col("tokens") % len(SURFACES) + 1).cast("int")))
    end = F.when(F.col("model") == "error", "error").otherwise("node_exit")
    lines = [("node_enter", F.col("model")), ("node_enter", inner), ("route", F.lit(None)), ("node_exit", inner), (end, F.col("model"))]
    each = F.array(*[F.struct(F.lit(i).alias("i"), (kind if i == 4 else F.lit(kind)).alias("type"), node.cast("string").alias("node")) for i, (kind, node) in enumerate(lines)])
    rows = c.select("event_id", "user_id", "us", "model", "tokens", F.explode(each).alias("x"))
    route = F.col("x.type") == "route"
    return rows.select(
        (F.col("event_id") * 8 + F.col("x.i")).alias("seq"), F.col("user_id").alias("run"), (F.col("us") + F.col("x.i")).alias("us"), "x.type", "x.node", F.when(F.col("tokens") % 3 == 0, F.col("model")).alias("surface"),
        F.when(route & (F.col("event_id") % 4 == 0), "planner").alias("from_node"), F.when(route, "finalizer").alias("to_node"), F.when(route, F.col("model")).alias("reason"), "tokens",
    )


def trace_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans by their stack: node, depth and node around it."""
    rows = s.with_duration(s.spans_and_routes(nested_log(spark, sf_dir))).where("kind = 'span'")
    return rows.select("run", "seq", "node", "depth", "parent", "enter_us", "duration_us", "state")


def trace_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = s.spans_and_routes(nested_log(spark, sf_dir)).where("kind = 'route'")
    return rows.select("run", "seq", F.col("node").alias("from_node"), "to_node", "reason")


def trace_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans that an error ended, as rows."""
    return trace_spans(spark, sf_dir).where("state = 'error'").select("run", "seq", "node", "enter_us")


def trace_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The routes of a surface, as rows; those without one aren't decisions."""
    return nested_log(spark, sf_dir).where("type = 'route' and surface is not null").select("run", "seq", "surface", "to_node", "tokens")


def _written(spark: SparkSession, sf_dir: str, path: str) -> None:
    """The log as JSON lines, of which every 50th is cut off and every 51st blank."""
    line = F.to_json(F.struct(*[c.split(" ")[0] for c in LOG.split(", ")]))
    nested_log(spark, sf_dir).select(F.when(F.col("seq") % 51 == 0, "").when(F.col("seq") % 50 == 0, F.substring(line, 1, 20)).otherwise(line).alias("value")).write.text(f"{path}/lines")


def trace_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a log by type, read as a stream; those that can't be read are kept apart and counted as `broken`."""
    path = work_path(spark, "trace")
    _written(spark, sf_dir, path)
    trace.ingest(spark, f"{path}/lines", LOG, path, files=100_000)
    good = spark.read.schema(LOG).parquet(f"{path}/events/*").groupBy("type").agg(F.count(F.lit(1)).alias("lines"))
    broken = spark.read.schema("broken string").parquet(f"{path}/broken/*").agg(F.lit("broken").alias("type"), F.count(F.lit(1)).alias("lines"))
    return good.unionByName(broken)


def trace_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of the unbroken log by a stream, with a stack as state and a last line that moves the time past all others."""
    path = work_path(spark, "trace")
    log = nested_log(spark, sf_dir)
    log.write.parquet(f"{path}/events/batch=0")
    last = log.agg((F.max("us") + 3_600_000_000).alias("us")).where("us is not null")
    last.select(F.lit(-1).cast("long").alias("seq"), F.lit(-1).cast("long").alias("run"), "us", *[F.lit(None).cast(t).alias(n) for n, t in (c.split(" ") for c in LOG.split(", ")[3:])]).write.parquet(f"{path}/events/batch=1")
    rows = s.with_duration(trace.run_spans(spark, path, LOG, files=100_000)).where("kind = 'span'")
    return rows.select("run", "seq", "node", "depth", "parent", "enter_us", "duration_us", "state")


QUERIES = {f.__name__: f for f in (quota_admission, admission_stream, trace_spans, trace_routes, trace_errors, trace_decisions, trace_lines, trace_stream)}

_ZONE = "CASE WHEN model IN ('click', 'purchase') THEN 'America/Los_Angeles' ELSE 'UTC' END"
_LOCAL = f"epoch_us(make_timestamp(us) AT TIME ZONE 'UTC' AT TIME ZONE {_ZONE})"
_ADMITTED = f"""WITH RECURSIVE {CALLS_SQL}, d AS (SELECT event_id, us, model, tokens, CAST(floor({_LOCAL} / 86400000000) AS BIGINT) AS day FROM calls),
o AS (SELECT *, epoch_us(make_timestamp(day * 86400000000) AT TIME ZONE {_ZONE}) + 86400000000 - us AS reset, row_number() OVER (PARTITION BY model ORDER BY us, event_id) AS k FROM d),
f AS (SELECT DISTINCT model, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(u BIGINT, t BIGINT)[]) AS held, CAST(NULL AS BIGINT) AS day, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS t, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS blocked_by, CAST(NULL AS BIGINT) AS wait_us,
    CAST(NULL AS BOOLEAN) AS recoverable, CAST(0 AS BIGINT) AS n_minute, CAST(0 AS BIGINT) AS tokens_minute, CAST(0 AS BIGINT) AS n_day, CAST(0 AS BIGINT) AS tokens_day FROM o
  UNION ALL SELECT model, k, CASE WHEN b IS NULL THEN list_append(h, {{'u': us, 't': tokens}}) ELSE h END, day, n0 + CAST(b IS NULL AS BIGINT), t0 + CASE WHEN b IS NULL THEN tokens ELSE 0 END, event_id, b,
    CASE WHEN b IN ('rpd', 'tpd') THEN reset WHEN b = 'tpm' AND tokens > {q.TPM} THEN 0 WHEN b IS NOT NULL THEN greatest(0, coalesce(h[1].u + 60000000 - us, 1000000)) END, CASE WHEN b IN ('rpd', 'tpd') THEN false WHEN b IS NOT NULL THEN NOT (b = 'tpm' AND tokens > {q.TPM}) END, n1, t1, n0, t0
  FROM (SELECT *, CASE WHEN n0 + 1 > {q.RPD} THEN 'rpd' WHEN t0 + tokens > {q.TPD} THEN 'tpd' WHEN n1 + 1 > {q.RPM} THEN 'rpm' WHEN t1 + tokens > {q.TPM} THEN 'tpm' END AS b
    FROM (SELECT *, CAST(len(h) AS BIGINT) AS n1, CAST(coalesce(list_sum(list_transform(h, lambda x: x.t)), 0) AS BIGINT) AS t1
      FROM (SELECT o.*, list_filter(f.held, lambda x: x.u >= o.us - 60000000) AS h, CASE WHEN o.day = f.day THEN f.n ELSE 0 END AS n0, CASE WHEN o.day = f.day THEN f.t ELSE 0 END AS t0 FROM f JOIN o ON o.model = f.model AND o.k = f.k + 1))))
SELECT event_id, model, day, blocked_by IS NULL AS admitted, blocked_by, wait_us, recoverable, n_minute, tokens_minute, n_day, tokens_day FROM f WHERE k > 0"""
_NEST = f"{CALLS_SQL}, e AS (SELECT *, CASE WHEN tokens % 3 = 0 THEN model ELSE ({SURFACES})[CAST(tokens % {len(SURFACES)} + 1 AS INT)] END AS inside FROM calls)"
_SPANS = f"""WITH {_NEST}, sp AS (SELECT user_id AS run, event_id * 8 AS seq, model AS node, 0 AS depth, CAST(NULL AS VARCHAR) AS parent, us AS enter_us, CAST(4 AS BIGINT) AS duration_us, CASE WHEN model = 'error' THEN 'error' ELSE 'closed' END AS state FROM e
UNION ALL SELECT user_id, event_id * 8 + 1, inside, 1, model, us + 1, CAST(2 AS BIGINT), 'closed' FROM e)"""
ORACLE_SQL = {
    "quota_admission": _ADMITTED,
    "admission_stream": _ADMITTED,
    "trace_spans": f"{_SPANS} SELECT * FROM sp",
    "trace_stream": f"{_SPANS} SELECT * FROM sp",
    "trace_routes": f"WITH {_NEST} SELECT user_id AS run, event_id * 8 + 2 AS seq, CASE WHEN event_id % 4 = 0 THEN 'planner' ELSE inside END AS from_node, 'finalizer' AS to_node, model AS reason FROM e",
    "trace_errors": f"{_SPANS} SELECT run, seq, node, enter_us FROM sp WHERE state = 'error'",
    "trace_decisions": f"WITH {_NEST} SELECT user_id AS run, event_id * 8 + 2 AS seq, model AS surface, 'finalizer' AS to_node, tokens FROM e WHERE tokens % 3 = 0",
    "trace_lines": f"""WITH {_NEST}, l AS (SELECT event_id * 8 + i AS seq, CASE WHEN i < 2 THEN 'node_enter' WHEN i = 2 THEN 'route' WHEN i = 4 AND model = 'error' THEN 'error' ELSE 'node_exit' END AS type FROM e, (SELECT unnest([0, 1, 2, 3, 4]) AS i))
SELECT CASE WHEN seq % 50 = 0 THEN 'broken' ELSE type END AS type, count(*) AS lines FROM l WHERE seq % 51 <> 0 GROUP BY ALL""",
}
