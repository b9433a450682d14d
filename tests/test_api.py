import numpy as np
import pytest

from cairnflow import api


@pytest.fixture
def engine(spark, tmp_path):
    calls = []

    def render(session):
        calls.append("render")
        e.catalog.write("items", session, spark.createDataFrame([(i, 400) for i in range(12)], "id long, weight int"))

    def analyze(session):
        calls.append("analyze")
        rng = np.random.default_rng(0)
        e.catalog.write("vectors", session, spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(12)], "id long, embedding array<double>"))

    e = api.Engine(spark, f"file://{tmp_path}/c", render, analyze)
    e.calls = calls
    return e


FRESH = {"rendering": {"text": "A"}, "analysis": {"model_id": "m"}, "clustering": {"method": "average", "distance_threshold": 0.0, "target_cluster_count": 3, "pca_dimensions": 3}}


def test_runs_only_what_changed(engine):
    s = engine.run(FRESH)
    assert engine.calls == ["render", "analyze"]
    load = engine.load(s)
    assert load["config"]["process_status"] == "clustered" and load["config"]["samples_amount"] == 12
    assert len({r.k for r in load["items"].collect()}) == 3 and load["merges"].count() == 11
    t = engine.run({"clustering": {**FRESH["clustering"], "target_cluster_count": 5}}, s, "duplicate_changed")
    assert t != s and engine.calls == ["render", "analyze"]
    assert len({r.k for r in engine.load(t)["items"].collect()}) == 5
    assert engine.latest() == t and [r.session_id for r in engine.history().collect()] == [t, s]
    engine.run({"analysis": {"model_id": "n"}}, t, "in_place_changed")
    assert engine.calls == ["render", "analyze", "analyze"]
    assert [r.place for r in api.listed(engine.load(t)["items"]).orderBy("leaf_angle").collect()] == list(range(12))
    engine.rename(s, "first")
    assert engine.load(s)["config"]["title"] == "first"
    assert engine.prune(1) == [s] and not engine.delete(s)


def test_admission(engine):
    with engine.jobs("a"):
        with pytest.raises(RuntimeError), engine.jobs("a"):
            pass
        assert engine.running() == ["a"]
    assert engine.running() == []


def test_bridge():
    now = [0.0]
    b = api.Bridge(lambda: now[0])
    assert b.answer("POST", "/heartbeat", '{"plugin_id":"p"}')[0] == 200 and b.answer("POST", "/heartbeat", "{")[0] == 400
    b.send({"a": 1})
    assert b.answer("GET", "/data") == (200, {"a": 1}) and b.answer("OPTIONS", "/x")[0] == 204 and b.answer("GET", "/x")[0] == 404
    now[0] = 5.9
    assert b.active() == ["p"]
    now[0] = 6.0
    assert b.active() == []


def test_what_is_left_of_unknown_sessions_goes(engine):
    s = engine.catalog.create({"title": "kept"})
    rows = engine.spark.range(2).withColumnRenamed("id", "weight")
    for session in (s, "left-over"):
        engine.catalog.write("items", session, rows)
    assert engine.reconcile() == ["left-over"] and engine.reconcile() == []
    assert engine.catalog.has("items", s) and not engine.catalog.has("items", "left-over")


def test_sessions_are_found_where_they_are(engine, tmp_path):
    from cairnflow.operators import sessions

    other = sessions.Catalog(engine.spark, f"file://{tmp_path}/other")
    s = other.create({"title": "x"})
    assert sessions.resolve([engine.catalog, other], s) is other
    with pytest.raises(KeyError):
        sessions.resolve([engine.catalog, other], "nowhere")
    assert sessions.resolve([engine.catalog, other], "archived", lambda session: session == "archived") is other


def test_bridge_on_a_port():
    import json
    import socket
    import urllib.request

    bridge = api.Bridge(lambda: 10.0)
    bridge.send({"a": 1})
    server = api.BridgeServer(bridge)
    try:
        with urllib.request.urlopen(f"http://localhost:{server.port}/data") as r:
            assert json.load(r) == {"a": 1} and r.headers["Access-Control-Allow-Origin"] == "*"
        with socket.create_connection(("localhost", server.port)) as c:  # head and body in one packet, as they are read at once
            body = json.dumps({"plugin_id": "p"})
            c.sendall(f"POST /heartbeat HTTP/1.1\r\nContent-Length: {len(body)}\r\n\r\n{body}".encode())
            assert c.recv(100).startswith(b"HTTP/1.1 200 OK")
        assert bridge.active() == ["p"]
        assert api.BridgeServer.response(bridge, b"OPTIONS /data HTTP/1.1\r\n\r\n").startswith(b"HTTP/1.1 204 No Content")
        assert api.BridgeServer.response(bridge, b"nonsense").startswith(b"HTTP/1.1 400")
    finally:
        server.close()
