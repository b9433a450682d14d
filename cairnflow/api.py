"""The engine's commands: sessions, runs, models and plugin connections over one catalog."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnflow.functions import names
from cairnflow.operators import features, linkage, selection, sessions
from cairnflow.sources.eventlog import EventLog
from cairnflow.streaming import events


class Jobs:
    """At most four jobs at once, and one for a session."""

    def __init__(self, most: int = sessions.MOST_JOBS):
        self.most, self.running, self._lock = most, set(), threading.Lock()

    def __call__(self, session: str):
        jobs = self

        class Admitted:
            def __enter__(self):
                with jobs._lock:
                    if session in jobs.running:
                        raise RuntimeError(f"session {session} is running")
                    if len(jobs.running) >= jobs.most:
                        raise RuntimeError(f"{jobs.most} jobs are running")
                    jobs.running.add(session)

            def __exit__(self, *_):
                with jobs._lock:
                    jobs.running.discard(session)

        return Admitted()


class Engine:
    """Commands over a catalog folder. ``render`` and ``analyze`` take a session id and fill the tables ``items`` and ``vectors``."""

    def __init__(self, spark: SparkSession, path: str, render: Callable[[str], None], analyze: Callable[[str], None], version: str = "1.0.0"):
        self.spark, self.catalog, self.version = spark, sessions.Catalog(spark, path), version
        self.steps = {"rendering": render, "analysis": analyze, "clustering": self.cluster}
        self.jobs = Jobs()

    def cluster(self, session: str, directions: dict[str, list[float]] | None = None) -> None:
        """Features, assignments, merges and statistics of a session from its vectors."""
        options = sessions.Algorithm.read(self.catalog.config(session).get("algorithm") or {}).clustering
        vectors = self.catalog.read("vectors", session).where("embedding is not null")
        emphasis = options.emphasis if options.enable_attribute_emphasis else None
        built = features.build_features(vectors, "embedding", "features", options.enable_preprocess_pca, options.pca_dimensions, emphasis, directions).select("session_id", "id", "features")
        built = features.scatter(built, "features")
        out, merges = linkage.clustered(built, options.method, options.distance_threshold, options.target_cluster_count)
        self.catalog.write("assignments", session, out.join(built.select("id", "two"), "id").drop("session_id"))
        self.catalog.write("merges", session, merges.drop("session_id"))
        stored = self.catalog.read("assignments", session)
        stats = stored.groupBy("k").agg(F.count("*").alias("size"), F.first("cluster_angle").alias("cluster_angle"), F.first("color_index").alias("color_index"))
        self.catalog.write("cluster_stats", session, stats)

    def clear(self, session: str, stage: str) -> None:
        """What a stage makes, and all that follows from it."""
        later = {"rendering": ("items",), "analysis": ("vectors",), "clustering": ("assignments", "merges", "cluster_stats")}
        for s in sessions.STAGES[sessions.STAGES.index(stage) :]:
            for name in later[s]:
                self.catalog.remove(name, session)

    def run(self, patch: dict, session: str | None = None, mode: str = "fresh", override: str | None = None) -> str:
        """Runs the stages that the configuration asks for; returns the session, a new one for fresh and duplicating runs."""
        sessions.check_mode(mode, patch)
        if mode == "fresh":
            algorithm, status = sessions.Algorithm.read(patch), "empty"
            session = self.catalog.create({"algorithm": algorithm.write(), "process_status": status, "app_version": self.version})
        else:
            config = self.catalog.config(session)
            old = sessions.Algorithm.read(config.get("algorithm") or {})
            algorithm = sessions.patched(old, patch)
            status = sessions.resume_status(config.get("process_status", "empty"), old, algorithm, override)
            session = self.catalog.duplicate(session) if mode == "duplicate_changed" else session
            self.catalog.update(session, algorithm=algorithm.write(), process_status=status, modified_app_version=self.version)
        with self.jobs(session):
            self.spark.addTag(session)
            try:
                sessions.Pipeline(self.steps, self.clear, lambda s, done: self.catalog.update(s, process_status=done))(session, status)
            finally:
                self.spark.removeTag(session)
        return session

    def reconcile(self) -> list[str]:
        """Removes what is left of sessions that have no configuration."""
        return sorted(self.catalog.reconcile())

    def stop(self, session: str) -> None:
        sessions.cancel(self.spark, session)

    def running(self) -> list[str]:
        return sorted(self.jobs.running)

    def history(self) -> DataFrame:
        """Sessions, newest first, running ones on top."""
        known = self.catalog.read("sessions").withColumn("running", F.col("session_id").isin(*self.running()) if self.running() else F.lit(False))
        return selection.running_first(known).orderBy("place")

    def prune(self, cap: int = 20) -> list[str]:
        """Deletes sessions of unsupported versions, and those beyond the cap that do not run."""
        known = self.catalog.read("sessions").withColumns({"protected": F.col("session_id").isin(*self.running()) if self.running() else F.lit(False), "_m": F.get_json_object("config", "$.modified_app_version"), "_a": F.get_json_object("config", "$.app_version")})
        sound = known.where(names.supported_version(F.col("_m"), F.col("_a")) | F.col("protected"))
        keep = {r.session_id for r in selection.history(sound, cap).select("session_id").collect()}  # as many as the cap, and those that run
        gone = [r.session_id for r in known.select("session_id").toLocalIterator() if r.session_id not in keep]
        for s in gone:
            self.catalog.delete(s)
        return gone

    def latest(self) -> str | None:
        row = selection.latest_clustered(self.catalog.read("sessions")).first()
        return row.session_id if row else None

    def load(self, session: str) -> dict:
        return self.catalog.payload(session)

    def rename(self, session: str, title: str) -> None:
        self.catalog.rename(session, title)

    def delete(self, session: str) -> bool:
        return self.catalog.delete(session)

    def models(self, local: DataFrame, remote: DataFrame) -> DataFrame:
        """Local models before remote ones of the same id."""
        return selection.union_by_precedence(local, remote, "id").orderBy("id")

    def connections(self, beats: DataFrame) -> DataFrame:
        """Plugins heard within the last five seconds."""
        return events.latest_heartbeats(beats).where(events.alive(F.col("ts"), F.current_timestamp()))


class Bridge:
    """What the plugin bridge answers; a server only has to pass requests on."""

    HELD_SECONDS = 1.0

    def __init__(self, clock: Callable[[], float], log: EventLog | None = None):
        """Heartbeats are appended to ``log``, if there is one, as lines of (plugin_id, ts: seconds) with the rest of their fields, at most once in ``HELD_SECONDS``."""
        self.clock, self.log, self.beats, self.data = clock, log, {}, None
        self.held, self.lock, self.written = [], threading.Lock(), float("-inf")

    def send(self, value: object) -> None:
        """Data for the plugins to fetch."""
        self.data = value

    def answer(self, method: str, path: str, body: str = "") -> tuple[int, object]:
        if method == "OPTIONS":
            return 204, None
        if (method, path) == ("GET", "/data"):
            return 200, self.data
        if (method, path) == ("POST", "/heartbeat"):
            try:
                beat = json.loads(body)
                self.beats[beat["plugin_id"]] = {**beat, "last_seen": self.clock()}
                self._hold({**beat, "ts": self.beats[beat["plugin_id"]]["last_seen"]})
            except (ValueError, KeyError, TypeError):
                return 400, None
            return 200, {"ok": True}
        return 404, None

    def _hold(self, beat: dict) -> None:
        if self.log is not None:
            with self.lock:
                self.held.append(json.dumps(beat))
            if self.clock() - self.written >= self.HELD_SECONDS:
                self.flush()

    def flush(self) -> None:
        """Writes the heartbeats that wait for the log."""
        with self.lock:
            held, self.held, self.written = self.held, [], self.clock()
        if held:
            self.log.append(held)

    def active(self) -> list[str]:
        return sorted(k for k, b in self.beats.items() if int(self.clock() - b["last_seen"]) <= events.ALIVE_SECONDS)


class BridgeServer:
    """A bridge on a local port. A request is read once, up to ``REQUEST_BYTES``, answered as JSON that any page may read, and closed."""

    REQUEST_BYTES = 4096

    def __init__(self, bridge: Bridge, port: int = 0):
        import socketserver

        class Handler(socketserver.BaseRequestHandler):
            def handle(self) -> None:
                self.request.sendall(BridgeServer.response(bridge, self.request.recv(BridgeServer.REQUEST_BYTES)))

        self.server = socketserver.ThreadingTCPServer(("localhost", port), Handler)
        self.port = self.server.server_address[1]
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    @staticmethod
    def response(bridge: Bridge, request: bytes) -> bytes:
        import http

        head, _, body = request.decode("utf-8", "replace").partition("\r\n\r\n")
        line = head.split("\r\n", 1)[0].split(" ")
        status, value = bridge.answer(line[0], line[1], body) if len(line) == 3 else (400, None)
        content = b"" if status == 204 else json.dumps(value).encode()
        allow = "Access-Control-Allow-Origin: *\r\nAccess-Control-Allow-Methods: GET, POST, OPTIONS\r\nAccess-Control-Allow-Headers: Content-Type\r\n"
        return f"HTTP/1.1 {status} {http.HTTPStatus(status).phrase}\r\nContent-Type: application/json\r\n{allow}Content-Length: {len(content)}\r\nConnection: close\r\n\r\n".encode() + content

    def close(self) -> None:
        self.server.shutdown()
        self.server.server_close()


def listed(items: DataFrame) -> DataFrame:
    """Clustered items in the order of their leaf angle, with their place in the circular list."""
    return selection.indexed(items.where("k is not null").withColumn("_order", F.struct("leaf_angle", "id")), "_order", "place").drop("_order")


def place_on_ring(position, n):
    """A scroll position, which may run past either end, as a place in the list."""
    return F.pmod(position, n)
