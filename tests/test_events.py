import datetime
import random

import pytest
from pyspark.sql import functions as F

from cairnflow.streaming import events as E

SEQUENCE = [("set", 10), ("inc", 4), ("dec", 8), ("inc", 9), ("set", 0), ("dec", 5)]
STATES = [(0, 10), (4, 10), (2, 2), (2, 2), (1, 1), (0, 0)]


def test_progress_fold(spark):
    now = (0, 1)
    for (op, x), want in zip(SEQUENCE, STATES, strict=True):
        now = E.fold_one(*now, op, x)
        assert now == want
    rows = [(f"r{n}", i, op, x) for n in range(1, 7) for i, (op, x) in enumerate(SEQUENCE[:n])]
    got = E.fold_progress(spark.createDataFrame(rows, "run_id string, seq long, op string, x long").repartition(3), ["run_id"]).collect()
    assert {r.run_id: (r.numerator, r.denominator) for r in got} == {f"r{n}": STATES[n - 1] for n in range(1, 7)}


def test_progress_of_one_long_key(spark):
    rng = random.Random(4)
    rows = [("r" if rng.random() < 0.9 else f"q{i % 5}", i, rng.choice(["set", "inc", "inc", "dec", "dec", "reset", "other"] if i % 97 == 0 else ["inc", "dec", "set" if i % 11 == 0 else "inc"]), rng.choice([None, -1, 0, 1, 2, 5, 40])) for i in range(900)]
    df = spark.createDataFrame(rows, "run_id string, seq long, op string, x long").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        got = {r.run_id: (r.numerator, r.denominator) for r in E.fold_progress(df, ["run_id"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want: dict = {}
    for key, _, op, x in rows:
        want[key] = E.fold_one(*want.get(key, (0, 1)), op, x or 0)
    assert got == want


def test_debounced_stream_equals_the_batch(spark, tmp_path):
    rng, t = random.Random(8), datetime.datetime(2026, 1, 1)
    rows, now = [], 0
    for i in range(120):
        now += rng.choice([1, 2, 3, 30])
        rows.append((rng.randint(1, 3), t + datetime.timedelta(seconds=now), i, f"v{i}"))
    rows.append((99, t + datetime.timedelta(seconds=now + 1000), 1000, "end"))  # moves the watermark past all others
    schema = "user long, ts timestamp, seq long, value string"
    for part in (rows[:50], rows[50:90], rows[90:-1], rows[-1:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = E.debounced_stream(stream, "user", 20, "60 seconds").writeStream.outputMode("append").format("memory").queryName("quiet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(180) and q.exception() is None
    plain = lambda df: sorted((r.user, r.seq, r.value) for r in df.collect() if r.user != 99)
    batch = E.debounced(spark.createDataFrame(rows, schema), "user", 20)
    assert plain(spark.table("quiet")) == plain(batch) and len(plain(batch)) > 10


def test_connections(spark):
    t = datetime.datetime(2026, 1, 1)
    beats = spark.createDataFrame([("a", t + datetime.timedelta(seconds=s)) for s in (0, 5, 10.9, 17)] + [("b", t)], "plugin_id string, ts timestamp")
    at = lambda s: t + datetime.timedelta(seconds=s)
    assert sorted((r.plugin_id, r.ts, r.connected) for r in E.connections(beats).collect()) == [("a", at(0), True), ("a", at(16.9), False), ("a", at(17), True), ("a", at(23), False), ("b", at(0), True), ("b", at(6), False)]


def test_progress_stream(spark, tmp_path):
    schema = "run_id string, stage string, seq long, op string, x long"
    for k, part in enumerate((SEQUENCE[:3], SEQUENCE[3:])):
        spark.createDataFrame([("r", "analysis", 10 * k + i, op, x) for i, (op, x) in enumerate(part)], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = E.progress_stream(stream).writeStream.outputMode("update").format("memory").queryName("progress").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120) and q.exception() is None
    assert {(r.numerator, r.denominator) for r in spark.table("progress").collect()} >= {(2, 2), (0, 0)} or spark.table("progress").count() == 2


def test_ndjson(spark):
    lines = spark.createDataFrame([('{"event":"a","payload":{"k":1}}',), ("oops",), ('{"payload":1}',), (None,), ("[1]",)], "value string")
    out = E.parsed(lines)
    assert [(r.event, r.payload) for r in out.collect()] == [("a", '{"k":1}')]
    assert [r.event for r in E.parsed(E.event_lines(out)).collect()] == ["a"]


def test_heartbeats(spark):
    t = datetime.datetime(2026, 1, 1)
    beats = spark.createDataFrame([("a", t, 1), ("a", t + datetime.timedelta(seconds=9), 2), ("b", t, 3)], "plugin_id string, ts timestamp, n int")
    last = E.latest_heartbeats(beats)
    now = F.lit(t + datetime.timedelta(seconds=14, milliseconds=900))
    assert {r.plugin_id: (r.n, r.alive) for r in last.withColumn("alive", E.alive(F.col("ts"), now)).collect()} == {"a": (2, True), "b": (3, False)}


def test_sessions_and_snapshots(spark):
    log = spark.createDataFrame([("r", 1, "progress", "{}"), ("r", 2, "session_started", '{"sessionId":"s"}'), ("r", 3, "x", "{}"), ("q", 1, "x", "{}")], "run_id string, seq long, event string, payload string")
    assert {(r.run_id, r.seq): r.session_id for r in E.with_session(log).collect()} == {("r", 1): None, ("r", 2): "s", ("r", 3): "s", ("q", 1): None}
    states = spark.createDataFrame([("k", i, s) for i, s in enumerate(["a", "a", None, None, "b", "a"])], "key string, seq long, snapshot string")
    assert sorted(r.seq for r in E.distinct_snapshots(states, "key").collect()) == [0, 2, 4, 5]


def test_selection_history(spark):
    rng, rows = random.Random(5), []
    for i in range(600):
        key = rng.choice(["hot", "hot", "hot", "a", None])
        op = rng.choices(["commit", "undo", "redo", "reset", "other"], [8, 5, 4, 1 if key != "hot" or i > 300 else 0, 1])[0]
        rows.append((key, i, op, rng.choice(["x", "y", "z", None])))
    want, logs = {}, {}
    for key, seq, op, snapshot in rows:
        before, at = logs.get(key, ([None], 0))
        if op == "reset":
            before, at = [snapshot], 0
        if op in ("commit", "undo") and not (op == "undo" and snapshot is None) and before[at] != snapshot:
            before, at = before[: at + 1] + [snapshot], at + 1
        at = max(at - 1, 0) if op == "undo" else min(at + 1, len(before) - 1) if op == "redo" else at
        logs[key] = before, at
        want[seq] = (key, before[at], at, at > 0, at + 1 < len(before))
    log = spark.createDataFrame(rows, "who string, seq long, op string, snapshot string").withColumn("depth", F.lit("a clashing name")).repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = {r.seq: (r.who, r.snapshot, r.depth, r.can_undo, r.can_redo) for r in E.selection_history(log, "who").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want
    assert E.selection_history(log.limit(0), "who").count() == 0


def test_cached_catalog():
    now, calls = [0.0], []

    def fetch():
        calls.append(now[0])
        if len(calls) == 2:
            raise OSError("down")
        return len(calls)

    c = E.CachedCatalog(fetch, clock=lambda: now[0])
    assert c.get() == (1, None)
    now[0] = 299
    assert c.get() == (1, None) and len(calls) == 1
    now[0] = 301
    assert c.get() == (1, "down")
    assert c.get() == (3, None)


@pytest.mark.parametrize(("stage", "n"), [("rendering", 25), ("analysis", 4), ("clustering", 100)])
def test_reports(spark, stage, n):
    assert spark.range(1).select(E.reports(F.lit(100), stage)).first()[0] == n
