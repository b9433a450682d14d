import os
import random

import pytest
from pyspark.sql import functions as F

from cairnflow.api import Bridge
from cairnflow.sources.eventlog import EventLog, log_sink, log_stream, read_log
from cairnflow.streaming import events as E


def _run(writer):
    q = writer.trigger(availableNow=True).start()
    assert q.awaitTermination(120) and q.exception() is None


def _lines(spark, folder):
    return [(r.at, r.value) for r in read_log(spark, folder).orderBy("at").collect()]


def test_offsets(tmp_path):
    log = EventLog(f"file://{tmp_path}/l")
    assert (log.end(), log.segments(), log.parts(0, 9)) == (0, [], [])
    log.append(["a", "b", "c"])
    log.append([])
    log.publish([log.staged("x", iter(["d"])), log.staged("y", iter([])), log.staged("z", iter(["e", "f"]))], "t")
    log.publish([log.staged("w", iter(["never"]))], "t")
    assert log.end() == 6 and [(p.first, p.start, p.end) for p in log.parts(1, 5)] == [(0, 1, 3), (3, 0, 1), (4, 0, 1)]
    assert len(log.tasks(0, 6)) == 1 and len(log.tasks(0, 6)[0].parts) == 3
    assert os.listdir(tmp_path / "l" / "_staging") == []
    with pytest.raises(ValueError):
        log.append(["two\nlines"])


def test_stream_equals_the_batch_after_a_restart(spark, tmp_path):
    source, sink, check = (str(tmp_path / d) for d in ("in", "out", "check"))
    log = EventLog(source)
    log.append(['{"event":"a","payload":1}', "no event", '{"event":"b","payload":{"k":"ü"}}'])
    through = lambda: log_sink(E.event_lines(E.parsed(log_stream(spark, source))), sink, check)
    _run(through())
    log.append(['{"event":"c","payload":null}'])
    log.append(["", '{"event":"d","payload":[2]}'])
    _run(through())
    want = [r.value for r in E.event_lines(E.parsed(read_log(spark, source))).collect()]
    assert sorted(v for _, v in _lines(spark, sink)) == sorted(want) and len(want) == 4
    last = max((f for f in os.listdir(f"{check}/commits") if f.isdigit()), key=int)
    os.remove(f"{check}/commits/{last}")  # as if the driver was lost between the sink's commit and Spark's
    if os.path.exists(f"{check}/commits/.{last}.crc"):
        os.remove(f"{check}/commits/.{last}.crc")
    log.append(['{"event":"e","payload":3}'])
    _run(through())  # runs the lost batch again
    _run(through())
    got = _lines(spark, sink)
    assert sorted(v for _, v in got) == sorted([*want, '{"event":"e","payload":3}']) and [a for a, _ in got] == list(range(5))


def test_heartbeats_of_a_bridge(spark, tmp_path):
    rng, now = random.Random(3), [1_760_000_000.0]
    log = EventLog(str(tmp_path / "beats"))
    bridge = Bridge(lambda: now[0], log)
    stream = lambda: E.connections_stream(E.heartbeats(log_stream(spark, str(tmp_path / "beats"))), "30 seconds")
    start = lambda: stream().writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
    for part in range(2):
        for _ in range(40):
            now[0] += rng.choice([0.5, 2.25, 5.5, 9])
            assert bridge.answer("POST", "/heartbeat", f'{{"plugin_id":"p{rng.randint(0, 2)}"}}')[0] == 200
        assert bridge.answer("POST", "/heartbeat", "{")[0] == 400
        if part:
            now[0] += 1000
            bridge.answer("POST", "/heartbeat", '{"plugin_id":"end"}')
        bridge.flush()
        _run(start())
    bridge.answer("POST", "/heartbeat", '{"plugin_id":"end"}')  # a run over what is there has no batch without data, and timers fire in the next batch
    bridge.flush()
    _run(start())
    plain = lambda df: sorted((r.plugin_id, r.ts, r.connected) for r in df.where(F.col("plugin_id") != "end").collect())
    batch = plain(E.connections(E.heartbeats(read_log(spark, str(tmp_path / "beats")))))
    assert plain(spark.read.parquet(str(tmp_path / "out"))) == batch and len(batch) > 20
