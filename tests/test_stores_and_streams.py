"""Stored vectors, admission, rounds and traces against plain Python, on hand-made rows."""

import random
from collections import defaultdict
from datetime import datetime
from types import SimpleNamespace
from zoneinfo import ZoneInfo

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from groundwell.operators import admission as adm
from groundwell.operators import block_index as bi
from groundwell.operators import retrieval as r
from groundwell.operators import rounds as ro
from groundwell.operators import spans as sp
from groundwell.operators import vector_index as vi
from groundwell.plans import stored
from groundwell.queries import QUERIES
from groundwell.sources.work import kept, saved, work_path
from groundwell.streaming import admission as adm_stream
from groundwell.streaming import trace, waiting

VECTORS = "id long, vector array<double>"


def cosine_top(rows, queries, k):
    """{qid: [score, ...]} by hand; rows and queries are lists of (id, vector)."""
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and all(x is not None for x in v) and np.linalg.norm(np.array(v, float)) > 0]
    out = {}
    for qid, q in queries:
        q = np.array(q, float)
        out[qid] = sorted((-round(float(v @ q / np.linalg.norm(v) / np.linalg.norm(q)), 6), i) for i, v in ok if len(v) == len(q) and i != qid)[:k]
    return out


@pytest.mark.parametrize("zeros", [0, 1, 3, 10, 50])
def test_dense_top_with_vectors_without_direction(spark, zeros):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(200)] + [(1000 + i, [0.0] * 6) for i in range(zeros)]
    rows += [(2000, [None] + [1.0] * 5), (2001, [1.0, 2.0]), (2002, []), (2003, None)]
    df = spark.createDataFrame(rows, VECTORS)
    got = defaultdict(list)
    for x in r.dense_top(df, df.where("id < 3").select(F.col("id").alias("qid"), "vector"), 10).collect():
        got[x.qid].append((-x.score, x.id))
    want = cosine_top(rows, rows[:3], 10)
    assert {q: sorted(v) for q, v in got.items()} == want and all(len(v) == 10 for v in got.values())


def test_blocks_that_begin_with_one_id(spark, monkeypatch):
    monkeypatch.setattr(r, "QUERY_BLOCK", 1)
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(8)], VECTORS)
    twice = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0])], "qid long, vector array<double>")
    assert r.dense_top(df, twice, 3, keep_self=True).count() == 3  # ids repeat: one query's rows, the best of both
    assert r.packed(twice, "qid", 1).select("number").distinct().count() == 2


def clustered(n, seed=5, size=16):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((30, size))
    return [(i, (centre[rng.integers(30)] + 0.6 * rng.standard_normal(size)).tolist(), int(rng.integers(40))) for i in range(n)]


def recall(got, want):
    return sum(len({i for _, i in want[q]} & {x.id for x in got if x.qid == q}) for q in want) / sum(len(v) for v in want.values())


def test_vector_index(spark):
    rows = clustered(3000)
    df = spark.createDataFrame(rows, f"{VECTORS}, part int")
    index = vi.build(df, ("part",))
    asked = df.where("id % 20 = 0").select(F.col("id").alias("qid"), "vector")
    plain = [(i, v) for i, v, _ in rows]
    queries = [x for x in plain if x[0] % 20 == 0]
    assert recall(vi.search(index, asked, 10).collect(), cosine_top(plain, queries, 10)) >= 0.9
    read = vi.share_read(index, asked, 10).agg(F.sum("rows") / F.sum("of")).first()[0]
    assert read < 0.5
    # under a filter that one in 40 passes, and one that few rows pass
    some = [(i, v) for i, v, p in rows if p == 7]
    got = vi.search(index, asked, 10, F.col("part") == 7).collect()
    assert recall(got, cosine_top(some, queries, 10)) >= 0.9 and len(got) == 10 * len(queries)
    few = [(i, v) for i, v, p in rows if p == 7 and i < 300]
    got = vi.search(index, asked, 10, (F.col("part") == 7) & (F.col("id") < 300)).collect()
    assert len(got) == sum(len(v) for v in cosine_top(few, queries, 10).values())
    exact = {(x.qid, x.id, x.score) for x in vi.search(index, asked, 10, exact=True).collect()}
    assert exact == {(q, i, -s) for q, v in cosine_top(plain, queries, 10).items() for s, i in v}


def test_vector_index_grows(spark):
    rows = clustered(600, 6)
    df = spark.createDataFrame(rows, f"{VECTORS}, part int")
    path = work_path(spark, "vectors")
    vi.build(df.where("id < 400"), ("part",), path)
    odd = [(9000, [0.0] * 16, 1), (9001, None, 1), (9002, [1.0], 1), (9003, [None] * 16, 1)]
    vi.append(vi.opened(spark, path), df.where("id >= 400").unionByName(spark.createDataFrame(odd, f"{VECTORS}, part int")))
    index = vi.opened(spark, path)
    assert index.read(spark).count() == 604 and index.filters == ("part",)
    asked = df.where("id % 50 = 0").select(F.col("id").alias("qid"), "vector")
    plain = [(i, v) for i, v, _ in rows]
    got = {(x.qid, x.id, x.score) for x in vi.search(index, asked, 5, exact=True).collect()}
    assert got == {(q, i, -s) for q, v in cosine_top(plain, [x for x in plain if x[0] % 50 == 0], 5).items() for s, i in v}
    none = vi.build(df.limit(0), ("part",))
    assert vi.search(none, asked, 5).count() == 0


def test_a_query_is_written_once(spark, monkeypatch):
    """However many cells it reads, and a vector once."""
    rows = clustered(2000, 8)
    df = spark.createDataFrame(rows, f"{VECTORS}, part int")
    index = vi.build(df, ("part",))
    written = {}
    monkeypatch.setattr(vi, "saved", lambda df, name: written.setdefault(name, saved(df, name)))
    asked = df.where("id % 20 = 0").select(F.col("id").alias("qid"), "vector")
    got = vi.search(index, asked, 5, exact=True)
    ids = [i for x in written["query-blocks"].collect() for i in x.qids]
    assert sorted(ids) == list(range(0, 2000, 20)) and len(index.centroids) > 50
    assert sorted(i for x in written["vector-blocks"].collect() for i in x.ids) == list(range(2000))
    plain = [(i, v) for i, v, _ in rows]
    assert {(x.qid, x.id, x.score) for x in got.collect()} == {(q, i, -s) for q, v in cosine_top(plain, [x for x in plain if x[0] % 20 == 0], 5).items() for s, i in v}


def test_dense_indexed(spark, sf_dir):
    exact = QUERIES["dense_topk"](spark, sf_dir).collect()
    got = {(x.qid, x.id) for x in QUERIES["dense_indexed"](spark, sf_dir).collect()}
    assert sum((x.qid, x.id) in got for x in exact) >= 0.9 * len(exact)


def test_dense_indexed_filtered(spark, sf_dir):
    exact = QUERIES["dense_indexed_exact"](spark, sf_dir).collect()
    got = {(x.qid, x.id) for x in QUERIES["dense_indexed_filtered"](spark, sf_dir).collect()}
    assert sum((x.qid, x.id) in got for x in exact) >= 0.9 * len(exact)


def test_a_tables_signature_follows_its_files(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/t")
    made = []
    for _ in range(2):
        kept(spark.read.parquet(f"{tmp_path}/t"), "signed", made.append)
    spark.range(3).write.mode("append").parquet(f"{tmp_path}/t")
    kept(spark.read.parquet(f"{tmp_path}/t"), "signed", made.append)
    assert len(made) == 2


# admission


def replay(calls, limits):
    """The rules call by call, with lists that are read anew each time."""
    out = {}
    accepted = defaultdict(list)
    for event, us, model, tokens in sorted(calls, key=lambda c: (c[1], c[0])):
        rpm, tpm, rpd, tpd, zone = limits.get(model, (None,) * 5)
        zone = ZoneInfo(zone or "UTC")
        local = datetime.fromtimestamp(us // 1_000_000, zone)
        minute = [c for c in accepted[model] if c[0] >= us - 60_000_000]
        day = [c for c in accepted[model] if c[2] == local.date()]
        mt, dt = sum(c[1] for c in minute), sum(c[1] for c in day)
        reset = int((local.replace(hour=0, minute=0, second=0, microsecond=0).timestamp() + 86400) * 1_000_000) - us
        wait = max(0, minute[0][0] + 60_000_000 - us) if minute else 1_000_000
        if rpd is not None and len(day) + 1 > rpd:
            said = ("rpd", reset, False)
        elif tpd is not None and dt + tokens > tpd:
            said = ("tpd", reset, False)
        elif rpm is not None and len(minute) + 1 > rpm:
            said = ("rpm", wait, True)
        elif tpm is not None and mt + tokens > tpm:
            said = ("tpm", 0, False) if tokens > tpm else ("tpm", wait, True)
        else:
            said = (None, None, None)
            accepted[model].append((us, tokens, local.date()))
        out[event] = (model, said[0] is None, *said, len(minute), mt, len(day), dt)
    return out


LIMITS = {"rpm": (3, None, None, None, None), "tpm": (None, 100, None, None, "Asia/Tokyo"), "rpd": (50, None, 40, None, "America/Los_Angeles"), "tpd": (None, 400, None, 900, "UTC"), "all": (4, 150, 60, 2000, "Europe/Berlin"), "zero": (0, None, None, None, "UTC")}
FIELDS = ["model", "admitted", "blocked_by", "wait_us", "recoverable", "n_minute", "tokens_minute", "n_day", "tokens_day"]


def some_calls(seed=9, n=1800):
    """Three days around a change to summer time, busy and idle, with calls at the same time, and one busy across a midnight."""
    rng = random.Random(seed)
    start = int(datetime(2024, 3, 9, 20, tzinfo=ZoneInfo("UTC")).timestamp() * 1_000_000)
    out, at = [], dict.fromkeys([*LIMITS, "free"], start)
    for e in range(n):
        m = rng.choice(list(at))
        at[m] += rng.choice([0, 1_000_000, 5_000_000, 20_000_000, 60_000_000, 61_000_000, 600_000_000, 3_600_000_000] if rng.random() < 0.2 or m in ("rpm", "zero") else [0, 7_000_000, 15_000_000, 60_000_000])
        out.append((e, at[m], m, rng.choice([1, 10, 30, 60, 120])))
    midnight = int(datetime(2024, 3, 12, tzinfo=ZoneInfo("UTC")).timestamp() * 1_000_000)
    out += [(n + k, midnight + (k - 40) * 10_000_000, "tpd", 30) for k in range(80)]
    return out


def tables(spark, calls):
    c = spark.createDataFrame(calls, "event_id long, us long, model string, tokens long")
    return c, spark.createDataFrame([(m, *x) for m, x in LIMITS.items()], "model string, rpm long, tpm long, rpd long, tpd long, zone string")


def test_admission_is_the_replay(spark):
    calls = some_calls()
    want = replay(calls, LIMITS)
    assert {w[2] for w in want.values()} == {None, "rpm", "tpm", "rpd", "tpd"}
    got = adm.admitted(*tables(spark, calls)).collect()
    assert len(got) == len(calls) and {x.event_id: tuple(x[c] for c in FIELDS) for x in got} == want
    assert adm.admitted(*tables(spark, [])).count() == 0


@pytest.mark.parametrize("batches", [1, 3, 20])
def test_admission_stream_is_the_replay(spark, batches):
    calls = sorted(some_calls(12, 200), key=lambda c: c[1])
    want = replay(calls, LIMITS)
    path = work_path(spark, "admission")
    step = -(-len(calls) // batches)
    late = calls[0]
    parts = [calls[i : i + step] for i in range(0, len(calls), step)]
    for k, part in enumerate(parts):  # within a batch in any order
        tables(spark, random.Random(k).sample(part, len(part)))[0].coalesce(1).write.mode("append").parquet(f"{path}/calls")
    close = calls[-1][1] + 3_600_000_000
    for k in range(2):
        tables(spark, [(-1 - k, close + k, "closing", 0)])[0].coalesce(1).write.mode("append").parquet(f"{path}/calls")
    again = (-9, late[1] + 1, late[2], 1)  # long after its time was passed
    tables(spark, [again])[0].coalesce(1).write.mode("append").parquet(f"{path}/calls")
    _, limits = tables(spark, [])
    rows = adm_stream.run_admission(spark, f"{path}/calls", "event_id long, us long, model string, tokens long", limits, path).collect()
    got = {x.event_id: tuple(x[c] for c in FIELDS) for x in rows if not x.late and x.model != "closing"}
    assert got == want
    assert [x.event_id for x in rows if x.late] == ([-9] if close - late[1] < 86_400_000_000 else [])


class States:
    """A processor's handle with states in plain Python, which knows the most rows that a value or a list had."""

    def __init__(self):
        self.most, self.held = 0, {}

    def getListState(self, name, schema):  # noqa: N802
        put = lambda rows: (self.held.update({name: list(rows)}), setattr(self, "most", max(self.most, len(rows))))
        return SimpleNamespace(get=lambda: iter(self.held.get(name, [])), put=put, clear=lambda: self.held.pop(name, None))

    def getMapState(self, name, key, schema):  # noqa: N802
        of = self.held.setdefault(name, {})

        def update(k, value):
            of[k] = value
            self.most = max(self.most, len(pa.ipc.open_stream(value[0]).read_all()))

        return SimpleNamespace(getValue=of.get, updateValue=update, removeKey=of.pop)

    def getValueState(self, name, schema):  # noqa: N802
        return SimpleNamespace(exists=lambda: name in self.held, get=lambda: self.held[name], update=lambda x: self.held.update({name: x}))

    def listTimers(self):  # noqa: N802
        return iter(self.held.get("timers", []))

    def deleteTimer(self, t):  # noqa: N802
        self.held["timers"].remove(t)

    def registerTimer(self, t):  # noqa: N802
        self.held.setdefault("timers", []).append(t)


@pytest.mark.parametrize("model", ["rpm", "tpm", "rpd", "tpd", "all", "free"])
def test_admission_holds_some_of_the_waiting_calls(monkeypatch, model):
    monkeypatch.setattr(waiting, "RUN", 100)
    monkeypatch.setattr(waiting, "PIECE", 7)
    monkeypatch.setattr(adm_stream, "CHUNK", 40)
    limits = {model: (*LIMITS.get(model, (None,) * 4)[:4], "UTC")}
    rng = random.Random(5)
    start = int(datetime(2024, 3, 9, 20, tzinfo=ZoneInfo("UTC")).timestamp() * 1_000_000)
    times = [start + rng.choice([0, 1, 30_000_000]) + rng.randrange(900) * 100_000_000 // 3 for _ in range(2500)]
    calls = [(e, us, model, rng.choice([1, 10, 30, 60, 120])) for e, us in enumerate(times)]
    handle, processor, got = States(), adm_stream.AdmissionProcessor(), []
    processor.init(handle)

    def frames(some):
        day = 86_400_000_000
        rows = [(us, e, tokens, us // day, day - us % day, *limits[model][:4]) for e, us, _, tokens in some]
        for at in range(0, len(rows), 30):
            yield pd.DataFrame(rows[at : at + 30], columns=["us", "event_id", "tokens", "day", "reset_us", "rpm", "tpm", "rpd", "tpd"])

    def offered(some, passed_us):
        time = SimpleNamespace(getCurrentWatermarkInMs=lambda: passed_us // 1000 - adm_stream.GRACE_MS if passed_us else 0)
        batch = list(processor.handleInputRows((model,), frames(some), time) if some else processor.handleExpiredTimer((model,), time, None))
        got.extend(x for f in batch for x in f.itertuples())
        assert all(len(f) <= 40 for f in batch)

    late = calls[:300]
    offered(calls[300:2000], 0)
    assert not got and handle.held["timers"]
    offered(calls[2000:2003], start + 9_000_000_000)  # part of the pieces goes
    offered([], start + 9_000_000_000)
    offered(calls[2003:], start + 9_000_000_000)
    offered([], start + 20_000_000_000)
    offered([], start + 90_000_000_000)
    early = {c[0] for c in calls[2003:] if c[1] < start + 9_000_000_000}
    assert {x.event_id for x in got if x.late} == early and not handle.held["timers"]
    offered(late, start + 90_000_000_000)
    assert len(got) == len(calls) and {x.event_id for x in got if x.late} == early | {c[0] for c in late}
    want = replay([c for c in calls[300:] if c[0] not in early], limits)
    assert {x.event_id: (model, *[None if getattr(x, c) is pd.NA else getattr(x, c) for c in FIELDS[1:]]) for x in got if not x.late} == want
    assert handle.most <= 60 and not handle.held["waiting"]


# traces


def spans_by_hand(events):
    out, opened, left = [], defaultdict(list), {}
    for run, us, seq, kind, node, frm, to, reason in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        held = opened[run]
        if kind == "node_enter":
            held.append((seq, node, us))
        elif kind == "route":
            out.append((run, "route", seq, frm or (held[-1][1] if held else left.get(run)), to))
        elif kind in ("node_exit", "error"):
            if node not in [h[1] for h in held]:
                out.append((run, "unmatched", seq, node, None))
                continue
            while True:
                s, n, t = held.pop()
                done = n == node
                out.append((run, ("closed" if kind == "node_exit" else "error") if done else "lost", s, n, (us - t) if done else None))
                if done:
                    left[run] = node
                    break
    return out + [(run, "open", s, n, None) for run, held in opened.items() for s, n, _ in held]


def some_events(seed=3, n=600):
    rng = random.Random(seed)
    out, held = [], defaultdict(list)
    for seq in range(n):
        run = rng.randrange(5)
        us = 1_700_000_000_000_000 + seq * 40_000_000
        if rng.random() < 0.15:
            out.append((run, us, seq, "route", None, "planner" if rng.random() < 0.2 else None, "end", "why"))
        elif held[run] and rng.random() < 0.5:
            out.append((run, us, seq, rng.choice(["node_exit", "node_exit", "error"]), held[run].pop(), None, None, None))
        else:
            held[run].append(rng.choice(["a", "b", "a"]))
            out.append((run, us, seq, "node_enter", held[run][-1], None, None, None))
    return out


def shaped(rows):
    return sorted((x.run, "route" if x.kind == "route" else x.state, x.seq, x.node, x.to_node if x.kind == "route" else x.exit_us - x.enter_us if x.state in ("closed", "error") else None) for x in rows)


def test_spans_nest(spark):
    events = [e for e in some_events() if e[2] % 23]  # some lines are lost
    got = sp.spans_and_routes(spark.createDataFrame(random.Random(1).sample(events, len(events)), sp.EVENT))
    assert shaped(got.collect()) == sorted(spans_by_hand(events))
    same = [(1, 1, 1, "node_enter", "a", None, None, None), (1, 2, 2, "node_enter", "a", None, None, None), (1, 3, 3, "node_exit", "a", None, None, None), (1, 9, 4, "node_exit", "a", None, None, None)]
    got = {(x.seq, x.duration_us, x.depth, x.parent) for x in sp.with_duration(sp.spans_and_routes(spark.createDataFrame(same, sp.EVENT))).collect()}
    assert got == {(1, 8, 0, None), (2, 1, 1, "a")}
    assert sp.spans_and_routes(spark.createDataFrame([], sp.EVENT)).count() == 0


def plain_fold(events):
    """One stack over all events of a run."""
    out, stacks = [], defaultdict(sp.Stack)
    for e in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        out += stacks[e[0]].offer(*e)
    return sorted(map(repr, out + [x for run, s in stacks.items() for x in s.rest(run)]))


@pytest.mark.parametrize(("seed", "lost"), [(1, 0.0), (2, 0.05), (3, 0.3), (4, 0.6)])
def test_a_hot_run_in_ranges(spark, seed, lost):
    """Nearly all events are one run's, in several ranges, with entries and exits that were lost, nodes that are missing, and exits of no entry."""
    rng = random.Random(seed)
    events, held = [], []
    for seq in range(1500):
        kind = rng.choice(["node_enter", "node_enter", "node_exit", "node_exit", "node_exit", "error", "route", "note"])
        node = rng.choice(["a", "b", "c", "d", None, ""] if seq % 40 == 0 else ["a", "b", "c", "d"])
        if kind == "node_enter":
            held.append(node)
        elif kind in ("node_exit", "error") and held:
            node = held.pop()
        if rng.random() >= lost:
            events.append((0 if seq % 300 else seq, seq // 3, seq, kind, node, rng.choice([None, None, "", "planner"]), "end", "why"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rng.sample(events, len(events)), sp.EVENT)
        assert df.repartitionByRange("run", "us", "seq").withColumn("p", F.spark_partition_id()).where("run = 0").select("p").distinct().count() > 2
        got = sorted(repr(tuple(r)) for r in sp.spans_and_routes(df).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == plain_fold(events)


@pytest.mark.parametrize("batches", [1, 6])
def test_trace_stream_is_the_batch(spark, tmp_path, batches):
    import json
    import os
    import time

    events = some_events(7, 240)
    names = [c.split(" ")[0] for c in sp.EVENT.split(", ")]
    lines = [json.dumps(dict(zip(names, e, strict=True))) for e in events]
    broken = [k for k in range(len(lines)) if k % 50 == 49]
    for k in broken:
        lines[k] = lines[k][:30]
    kept_events = [e for k, e in enumerate(events) if k not in broken]
    last = {"run": -1, "us": events[-1][1] + 3_600_000_000, "seq": 0, "type": "note"}
    os.makedirs(f"{tmp_path}/log")
    step = -(-len(lines) // batches)
    parts = [lines[i : i + step] for i in range(0, len(lines), step)] + [[json.dumps(last)], ["", json.dumps(last | {"us": last["us"] + 1})]]
    for k, part in enumerate(parts):
        with open(f"{tmp_path}/log/{k:03}.json", "w") as f:
            f.write("\n".join(part) + "\n")
        os.utime(f"{tmp_path}/log/{k:03}.json", (time.time() - 100 + k,) * 2)
    path = work_path(spark, "trace")
    trace.ingest(spark, f"file://{tmp_path}/log", sp.EVENT, path)
    assert spark.read.schema("broken string").parquet(f"{path}/broken/*").count() == len(broken)
    got = trace.run_spans(spark, path, sp.EVENT).collect()
    assert shaped(got) == sorted(x for x in spans_by_hand(kept_events) if x[1] != "open")


def test_a_runs_waiting_events_are_few_values(monkeypatch):
    """The state isn't asked for each event; what comes out is what one stack makes of all."""
    import pandas as pd

    class State:
        def __init__(self):
            self.held, self.written = [], 0

        def get(self):
            return self.held

        def exists(self):
            return bool(self.held)

        def clear(self):
            self.held = []

        def put(self, values):
            self.held, self.written = list(values), self.written + len(values)

        def appendList(self, values):
            self.held, self.written = self.held + list(values), self.written + len(values)

        def update(self, value):
            self.held = value

    class Handle:
        def __init__(self):
            self.states, self.timers = {}, []

        def getListState(self, name, schema):
            return self.states.setdefault(name, State())

        getValueState = getListState

        def listTimers(self):
            return list(self.timers)

        def deleteTimer(self, t):
            self.timers.remove(t)

        def registerTimer(self, t):
            self.timers.append(t)

    monkeypatch.setattr(trace, "CHUNK", 100)
    names = [c.split(" ")[0] for c in sp.EVENT.split(", ")]
    events = sorted((e for e in some_events(9, 900) if e[0] == 0), key=lambda e: e[1:3])
    assert len(events) > 150
    handle, processor = Handle(), trace.SpanProcessor()
    processor.init(handle)
    times = type("Times", (), {"__init__": lambda self, ms: setattr(self, "ms", ms), "getCurrentWatermarkInMs": lambda self: self.ms})
    frame = lambda rows: pd.DataFrame(rows, columns=names)
    middle = len(events) // 2
    got = list(processor.handleInputRows((0,), iter([frame(events[middle:])]), times(0))) + list(processor.handleInputRows((0,), iter([frame(events[:middle])]), times(0)))
    assert not got and handle.states["waiting"].written <= 2 + len(events) / 100 and len(handle.timers) == 1
    for us in (events[middle][1], events[-1][1] + 10**9):
        got += list(processor.handleExpiredTimer((0,), times(us // 1000), None))
    stack = sp.Stack()
    want = [x for e in events for x in stack.offer(*e)]
    assert [tuple(None if x is None or x != x else x for x in r) for f in got for r in f.itertuples(index=False, name=None)] == want
    assert not handle.states["waiting"].held and not handle.timers


# rounds


def test_rounds_go_on_from_a_saved_one(spark, sf_dir):
    rows = ro.frontier(stored.questions(spark, sf_dir), stored.pr._route(F.col("qid")))
    retrieve = stored.retrieval_on(spark, sf_dir)
    saved_rounds = {}
    whole = ro.run_rounds(rows, retrieve, 20, lambda n, df: saved_rounds.setdefault(n, df))
    names = [c for c in rows.columns if c != "scores"]
    in_order = lambda df: sorted(tuple(map(str, x)) for x in df.select(*names, F.array_sort(F.map_entries("scores")).alias("s")).collect())
    assert len(saved_rounds) > 1 and in_order(ro.run_rounds(saved_rounds[1], retrieve, 20)) == in_order(whole)
    spent = {x.run: x.spent for x in whole.groupBy("run").agg(F.sum("rounds").alias("spent")).collect()}
    assert max(spent.values()) <= 20
    assert all(x.status not in ro.PENDING or spent[x.run] == 20 for x in whole.collect())


def test_scores_merge_and_nothing_gets_worse(spark):
    row = spark.createDataFrame([({1: 2.0, 2: 5.0}, {2: 3.0, 3: None})], "a map<long,double>, b map<long,double>")
    assert row.select(ro.merged_scores(F.col("a"), F.col("b")).alias("m")).first().m == {1: 2.0, 2: 5.0, 3: None}
    rows = ro.frontier(spark.createDataFrame([(1, 10, 0, "q"), (1, 11, 1, "r"), (2, 12, 0, "s")], "run long, qid long, place int, text string"), "web")
    rows = rows.withColumn("status", F.when(F.col("qid") == 10, "sufficient").otherwise("pending")).withColumn("best", F.when(F.col("qid") == 10, 6.0)).withColumn("rounds", F.when(F.col("qid") == 10, 2).otherwise(0))
    again = ro.reopened(rows, F.col("qid") == 10)

    def retrieve(asked):
        assert asked.where("route is null").count() == 0
        return asked.where("qid <> 12").select("qid", F.lit(5).cast("long").alias("id"), F.lit("s").alias("source_id"), F.lit(-1.0).alias("rerank_score"), F.lit(1).alias("rank"))

    got = {x.qid: x for x in ro.one_round(again, retrieve, 20).collect()}
    assert (got[10].status, got[10].best, got[10].evidence, got[10].reopened_from, got[10].rounds) == ("sufficient", 6.0, [5], None, 3)
    assert (got[11].status, got[11].scores, got[11].route, got[11].attempted) == ("in_progress", {5: -1.0}, "evidence_store", ["web"])
    assert (got[12].status, got[12].evidence, got[12].best) == ("in_progress", [], None)
    poor = {x.qid: x.rounds for x in ro.one_round(again, retrieve, 3).collect()}
    assert poor == {10: 3, 11: 0, 12: 1}  # the plan's first question takes the last call of its run


def test_the_route_widens_to_the_last(spark):
    df = spark.createDataFrame([(x,) for x in ro.ROUTES], "route string")
    assert [x.w for x in df.select(ro.wider(F.col("route")).alias("w")).collect()] == [*ro.ROUTES[1:], ro.ROUTES[-1]]


@pytest.mark.parametrize(("status", "before", "want"), [("abandoned", "sufficient", "sufficient"), ("sufficient", "insufficient", "sufficient"), ("insufficient", None, "insufficient")])
def test_never_worse(spark, status, before, want):
    df = spark.createDataFrame([(status, before)], "s string, b string")
    assert df.select(ro.never_worse(F.col("s"), F.col("b")).alias("x")).first().x == want


# an index in blocks


def worded(n, seed=2):
    rng = random.Random(seed)
    rare = [f"rare{k}" for k in range(60)]
    return [(rng.choice([i, i * 1500]), " ".join(["common", *rng.choices(["alpha", "beta", "gamma", "delta", *rare], k=rng.randint(1, 30)), *(["common"] * rng.randint(0, 3))])) for i in range(1, n)]


def bm25_rows(df):
    return sorted((x.qid, x.rank, x.id, x.score) for x in df.collect())


def test_blocks_leave_postings_unread(spark):
    docs = spark.createDataFrame([*dict(worded(3000)).items(), (-5, "common"), (-6, ""), (None, "common alpha")], "id long, text string")
    asked = spark.createDataFrame([(1, "common rare3 rare7"), (2, "common"), (3, "alpha beta common rare1 rare1"), (4, "nothing here"), (5, ""), (6, "rare9 gamma")], "qid long, text string")
    path = bi.build(docs)
    counts = {}
    got = bm25_rows(bi.search(spark, path, asked, 10, counts))
    plain = r.search(r.index(docs.where("id is not null")), asked)
    assert got == bm25_rows(r.top(plain, 10, ["qid"], F.desc("score"), "id")) and {x[0] for x in got} == {1, 2, 3, 6}
    assert 0 < counts["scored"] <= counts["of"]
    one = spark.createDataFrame([(1, "common rare3 rare7")], "qid long, text string")
    bi.search(spark, path, one, 10, counts)
    assert counts["scored"] < 0.7 * counts["of"]  # of the word that all have only the blocks of documents with a rare one


def test_an_index_that_forgets(spark):
    docs = dict(worded(400))
    make = lambda d: spark.createDataFrame(list(d.items()), "id long, text string")
    asked = spark.createDataFrame([(1, "common rare3 alpha"), (2, "fresh rare5"), (3, "common")], "qid long, text string")
    path = bi.build(make(docs))
    now = dict(docs)
    ids = sorted(docs)
    steps = [({i: "fresh words alpha" for i in ids[:40]}, []), ({ids[3]: "fresh again rare5", 10**12: "fresh rare5"}, ids[50:90]), ({i: "back alpha" for i in ids[50:60]}, [ids[3], 77_777_777])]
    for new, gone in steps:
        bi.upsert(make(new), path)
        now |= new
        bi.delete(spark.createDataFrame([(i,) for i in gone], "id long"), path)
        now = {i: x for i, x in now.items() if i not in gone}
        want = bm25_rows(bi.search(spark, bi.build(make(now)), asked, 15))
        assert bm25_rows(bi.search(spark, path, asked, 15)) == want
    small = bi.compacted(spark, path)
    assert bm25_rows(bi.search(spark, small, asked, 15)) == want
    assert bi.table(spark, small, "docs").count() == len(now) and bi.table(spark, small, "dead").count() == 0
    assert bi.search(spark, bi.build(make(docs).limit(0)), asked, 5).count() == 0
