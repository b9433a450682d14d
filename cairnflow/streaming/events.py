"""Progress, heartbeats and event logs, in batch and as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from cairnflow.sources.store import stored

#: Fixed vocabulary (E5), seconds of a plugin's life (P14) and items between progress reports.
EVENTS = (
    "session_started", "font_rendering_start", "font_rendering_complete", "analysis_start", "analysis_complete", "clustering_start", "clustering_complete",
    "all_jobs_complete", "jobs_cancelled", "worker_result", "progress_numerator_reset", "progress_denominator_reset", "progress_numerator_increase", "progress_denominator_decrease",
)
ALIVE_SECONDS = 5
REPORT_EVERY = {"rendering": 4, "analysis": 32, "clustering": 1}

def fold_progress(events: DataFrame, keys: list[str]) -> DataFrame:
    """Numerator and denominator of every key after its operations (seq, op, x) in order; a null x counts as 0.

    Operations do not commute, but runs of them can be put together: a denominator is the last one set, less what was
    taken off since; and every operation takes a numerator n to min(n + a, b), or to a constant, and so does any run of them. Range
    partitions of the keys' sequences are folded side by side, and a key is put together from one row for each partition it lies in.
    """
    n, x = F.lit(0).cast("bigint"), F.coalesce(F.col("x").cast("bigint"), F.lit(0).cast("bigint"))
    ranged = stored(events.select(*keys, "seq", "op", x.alias("x")).repartitionByRange(*keys, "seq").withColumn("_part", F.spark_partition_id()), "ranges")
    to_one = (F.col("op") == "reset") | ((F.col("op") == "set") & (F.col("x") <= 0))
    total, off = F.when(to_one, F.lit(1).cast("bigint")).when(F.col("op") == "set", F.col("x")), F.when(F.col("op") == "dec", F.greatest("x", n)).otherwise(n)
    fixed, add = F.when(F.col("op") == "reset", n).when(to_one, n + 1), F.when(F.col("op") == "inc", F.greatest("x", n)).otherwise(n)
    each = ranged.select(*keys, "seq", "_part", total.alias("total"), off.alias("off"), fixed.alias("fixed"), add.alias("add"))
    run = lambda by, order: Window.partitionBy(*keys, *by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)

    own = run(["_part"], "seq")
    each = each.withColumns({"set": F.last("total", ignorenulls=True).over(own), "since": F.count("total").over(own), "turn": F.count("fixed").over(own)})
    each = each.withColumn("gone", F.sum("off").over(run(["_part", "since"], "seq")))
    ends = each.groupBy(*keys, "_part").agg(F.max_by(F.struct("set", "gone"), "seq").alias("e")).select(*keys, "_part", F.col("e.set").alias("set"), F.col("e.gone").alias("gone"))
    over = run([], "_part")  # a row for each partition
    ends = ends.withColumns({"_set": F.coalesce(F.last("set", ignorenulls=True).over(over), n + 1), "_since": F.count("set").over(over)})
    after = F.greatest(F.col("_set") - F.sum("gone").over(run(["_since"], "_part")), n)
    ends = ends.withColumn("after", after).withColumn("before", F.coalesce(F.lag("after").over(Window.partitionBy(*keys).orderBy("_part")), n + 1))

    at = each.join(ends.select(*keys, "_part", "before"), [*keys, "_part"]).withColumn("d", F.greatest(F.coalesce("set", "before") - F.col("gone"), n))
    at = at.withColumns({"sum": F.sum("add").over(run(["_part", "turn"], "seq")), "last": F.max("turn").over(Window.partitionBy(*keys, "_part"))}).where("turn = last")
    runs = at.groupBy(*keys, "_part").agg(F.max("fixed").alias("fixed"), F.sum("add").alias("sum"), F.min(F.col("d") - F.col("sum")).alias("least"), F.max_by("d", "seq").alias("d"))
    parts = F.sort_array(F.collect_list(F.struct("_part", "fixed", "sum", "least")))
    put = lambda s, r: F.least(F.coalesce(r["fixed"], s), r["least"]) + r["sum"]
    folded = runs.groupBy(*keys).agg(F.aggregate(parts, n, put).alias("numerator"), F.max_by("d", "_part").alias("denominator"))
    return folded.select(*keys, "numerator", "denominator")


def fold_one(numerator: int, denominator: int, op: str, x: int) -> tuple[int, int]:
    """E1 for one operation outside Spark."""
    if op == "reset":
        return 0, 1
    if op == "set":
        return (1, 1) if x <= 0 else (min(numerator, x), x)
    if op == "inc":
        return min(numerator + max(x, 0), denominator), denominator
    if op == "dec":
        rest = max(denominator - max(x, 0), 0)
        return min(numerator, rest), rest
    return numerator, denominator


def _progress(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now = state.get if state.exists else (0, 1)
    events = pd.concat(list(parts)).sort_values("seq", kind="stable")
    for op, x in zip(events["op"], events["x"], strict=True):
        now = fold_one(*now, op, int(x))
    state.update((int(now[0]), int(now[1])))
    yield pd.DataFrame({"run_id": [key[0]], "stage": [key[1]], "numerator": [now[0]], "denominator": [now[1]]})


def progress_stream(events: DataFrame) -> DataFrame:
    """E1 as a stream: events (run_id, stage, seq, op, x) to the latest progress of each stage, with state."""
    return events.groupBy("run_id", "stage").applyInPandasWithState(
        _progress, "run_id string, stage string, numerator long, denominator long", "numerator long, denominator long", "update", GroupStateTimeout.NoTimeout)


def parsed(lines: DataFrame, fields: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Events of NDJSON lines (value); lines that are no JSON object with an event are left out.

    A line is parsed once. ``fields`` (column: path, type) takes values out of it; without them comes the payload as JSON.
    """
    json = lines.select(F.try_parse_json(F.col("value")).alias("_line"))
    wanted = [F.try_variant_get("_line", path, kind).alias(c) for c, (path, kind) in (fields or {}).items()]
    rest = wanted or [F.to_json(F.try_variant_get("_line", "$.payload", "variant")).alias("payload")]
    return json.select(F.try_variant_get("_line", "$.event", "string").alias("event"), *rest).where("event is not null")


def event_lines(events: DataFrame) -> DataFrame:
    """Events as NDJSON lines."""
    return events.select(F.to_json(F.struct("event", F.try_parse_json("payload").alias("payload"))).alias("value"))


def with_session(events: DataFrame) -> DataFrame:
    """Every event with the session that its run last started (run_id, seq, event, payload)."""
    started = F.when(F.col("event") == "session_started", F.get_json_object("payload", "$.sessionId"))
    order = Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("session_id", F.last(started, ignorenulls=True).over(order))


def reports(total: Column, stage: str) -> Column:
    """How many progress reports a stage sends for so many items."""
    return F.ceil(total / REPORT_EVERY[stage])


def latest_heartbeats(beats: DataFrame) -> DataFrame:
    """The latest heartbeat of every plugin."""
    rest = [c for c in beats.columns if c != "plugin_id"]
    return beats.groupBy("plugin_id").agg(F.max(F.struct("ts", *(c for c in rest if c != "ts"))).alias("b")).select("plugin_id", *(F.col(f"b.{c}").alias(c) for c in rest))


def alive(last_seen: Column, now: Column) -> Column:
    """Seen at most five whole seconds ago."""
    return F.floor(now.cast("timestamp").cast("double") - last_seen.cast("timestamp").cast("double")) <= ALIVE_SECONDS


def _seconds(c: str) -> Column:
    return F.col(c).cast("timestamp").cast("double")


def debounced(events: DataFrame, key: str, delay: float) -> DataFrame:
    """Of each key's events (key, ts, seq, ...) the last one before every quiet gap of ``delay`` seconds or more, the log's end included;
    of equal times the largest seq is the last."""
    following = F.lead("ts").over(Window.partitionBy(key).orderBy("ts", "seq"))
    gap = _seconds("_next") - _seconds("ts")
    return events.withColumn("_next", following).where(F.col("_next").isNull() | (gap >= delay)).drop("_next")


def _quiet(delay: float, key: str):
    """The state is a key's last event; it is emitted once the watermark, or a later event, shows that nothing followed in time."""
    wait = int(delay * 1000)

    def run(of: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        last = state.get if state.exists else None
        if state.hasTimedOut:
            out.append(last)
            state.remove()
        else:
            rows = pd.concat(list(parts))
            times = rows["ts"].astype("datetime64[us]").astype("int64")
            for event in sorted(zip(times.tolist(), rows["seq"].tolist(), rows["value"].tolist(), strict=True)):
                if last is not None and event[0] - last[0] >= wait * 1000:
                    out.append(last)
                last = event if last is None or event > tuple(last) else last
            state.update(tuple(last))
            state.setTimeoutTimestamp(max(last[0] // 1000 + wait, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [of[0]] * len(out), "ts": pd.to_datetime([e[0] for e in out], unit="us"), "seq": [e[1] for e in out], "value": [e[2] for e in out]})

    return run


def debounced_stream(events: DataFrame, key: str, delay: float, late: str = "0 seconds") -> DataFrame:
    """E6 as a stream: events (key: long, ts, seq: long, value: string) with event-time timers; events later than ``late`` behind the newest are dropped."""
    schema, state = f"{key} long, ts timestamp, seq long, value string", "ts long, seq long, value string"
    return events.withWatermark("ts", late).groupBy(key).applyInPandasWithState(_quiet(delay, key), schema, state, "append", GroupStateTimeout.EventTimeTimeout)


def connections(beats: DataFrame) -> DataFrame:
    """E4, P14 over a log of heartbeats (plugin_id, ts): (plugin_id, ts, connected) as plugins connect, and fall silent ``ALIVE_SECONDS`` and one after their last beat."""
    order = Window.partitionBy("plugin_id").orderBy("ts")
    gap = lambda a, b: F.floor(_seconds(b) - _seconds(a)) > ALIVE_SECONDS
    each = beats.select("plugin_id", "ts", F.lag("ts").over(order).alias("_before"), F.lead("ts").over(order).alias("_next"))
    up = each.where(F.col("_before").isNull() | gap("_before", "ts")).select("plugin_id", "ts", F.lit(True).alias("connected"))
    down = each.where(F.col("_next").isNull() | gap("ts", "_next")).select("plugin_id", (F.col("ts") + F.make_dt_interval(secs=F.lit(ALIVE_SECONDS + 1))).alias("ts"), F.lit(False).alias("connected"))
    return up.union(down)


def _beat(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        yield pd.DataFrame({"plugin_id": [key[0]], "connected": [False]})
        return
    for _ in parts:
        pass
    state.update((True,))
    state.setTimeoutDuration((ALIVE_SECONDS + 1) * 1000)
    yield pd.DataFrame({"plugin_id": [key[0]], "connected": [True]})


def connection_stream(beats: DataFrame) -> DataFrame:
    """E4 as a stream: plugins as they connect and fall silent."""
    return beats.groupBy("plugin_id").applyInPandasWithState(_beat, "plugin_id string, connected boolean", "connected boolean", "update", GroupStateTimeout.ProcessingTimeTimeout)


def heartbeats(lines: DataFrame) -> DataFrame:
    """A bridge's log of lines (value) as heartbeats (plugin_id, ts), in batch or as a stream; other lines are left out."""
    beat = F.from_json("value", "plugin_id string, ts double")
    return lines.select(beat.alias("b")).where("b.plugin_id is not null and b.ts is not null").select("b.plugin_id", F.timestamp_micros(F.round(F.col("b.ts") * 1_000_000).cast("long")).alias("ts"))


def _connected(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The state is the last beat; a plugin falls silent at the first later beat, or once the watermark shows that none came in time."""
    out, last, life = [], state.get[0] if state.exists else None, 1_000_000 * (ALIVE_SECONDS + 1)
    if state.hasTimedOut:
        out.append((last + life, False))
        state.remove()
    else:
        for now in sorted(pd.concat(list(parts))["ts"].astype("datetime64[us]").astype("int64").tolist()):
            if last is not None and now - last >= life:
                out.append((last + life, False))
            if last is None or now - last >= life:
                out.append((now, True))
            last = now if last is None else max(now, last)
        state.update((last,))
        state.setTimeoutTimestamp(max((last + life) // 1000, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame({"plugin_id": [key[0]] * len(out), "ts": pd.to_datetime([o[0] for o in out], unit="us"), "connected": [o[1] for o in out]})


def connections_stream(beats: DataFrame, late: str = "0 seconds") -> DataFrame:
    """:func:`connections` as a stream by event time: beats (plugin_id, ts), dropped if they are later than ``late`` behind the newest."""
    return beats.withWatermark("ts", late).groupBy("plugin_id").applyInPandasWithState(
        _connected, "plugin_id string, ts timestamp, connected boolean", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def distinct_snapshots(log: DataFrame, key: str) -> DataFrame:
    """A log (seq, snapshot) per key without snapshots equal to the one before."""
    before = F.lag("snapshot").over(Window.partitionBy(key).orderBy("seq"))
    return log.withColumn("_before", before).where(~F.col("snapshot").eqNullSafe(F.col("_before"))).drop("_before")


def known(event: Column) -> Column:
    """E5: whether an event is of the vocabulary; a model's download has events of its own."""
    return event.isin(*EVENTS) | event.startswith("model_download_")


def _epochs(log: DataFrame, key: str) -> DataFrame:
    """The log with ``_epoch``: how many resets of its key came so far. Range partitions count side by side and are put together from one row for each."""
    ranged = stored(log.repartitionByRange(key, "seq").withColumn("_part", F.spark_partition_id()), "log")
    reset = F.when(F.col("op") == "reset", 1).otherwise(0)
    counts = ranged.groupBy(key, "_part").agg(F.sum(reset).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(F.col(key).alias("_key"), F.col("_part").alias("_of"), F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.sum(reset).over(Window.partitionBy(key, "_part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    joined = ranged.join(counts, ranged[key].eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_of")))
    return joined.withColumn("_epoch", F.col("_before") + own).drop("_part", "_key", "_of", "_before")


def selection_history(log: DataFrame, key: str) -> DataFrame:
    """What is selected after every operation of a log (key, seq, op, snapshot: string) of commits, undos, redos and resets.

    Returns (key, seq, op, snapshot, depth, can_undo, can_redo). A history starts with null; a commit of what is selected changes nothing, any
    other one drops what was undone; an undo first commits its snapshot, unless that is null; at either end, undo and redo change nothing; a reset starts anew
    with its snapshot; other operations change nothing. A null key is a key. ``seq`` is unique within a key.

    What lies behind a reset has no effect, so a key's stretches between resets are read side by side, each in order, batch by batch: a task holds
    one stretch's snapshots that can still be reached, not its log.
    """
    k, ahead = log.schema[key].dataType.simpleString(), ["_epoch", "seq"]
    rows = _epochs(log.select(key, "seq", "op", F.col("snapshot").cast("string").alias("snapshot")), key)
    seq = log.schema["seq"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, kept, at = None, [None], 0
        for part in parts:
            keys, epochs, ops, snapshots = (part.column(part.schema.get_field_index(c)).to_pylist() for c in (key, "_epoch", "op", "snapshot"))
            out = []
            for stretch, op, snapshot in zip(zip(keys, epochs, strict=True), ops, snapshots, strict=True):
                if stretch != of:
                    of, kept, at = stretch, [None], 0
                if op == "reset":
                    kept, at = [snapshot], 0
                if (op == "commit" or (op == "undo" and snapshot is not None)) and snapshot != kept[at]:
                    del kept[at + 1 :]
                    kept.append(snapshot)
                    at += 1
                at = max(0, at - 1) if op == "undo" else min(len(kept) - 1, at + 1) if op == "redo" else at
                out.append((kept[at], at, at > 0, at < len(kept) - 1))
            columns = list(zip(*out, strict=True)) or [()] * 4
            own = [part.column(part.schema.get_field_index(c)) for c in (key, "seq", "op")]
            types = (pa.string(), pa.int64(), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [key, "seq", "op", "snapshot", "depth", "can_undo", "can_redo"])

    dealt = rows.repartition(key, "_epoch").sortWithinPartitions(key, *ahead)
    return dealt.mapInArrow(run, f"`{key}` {k}, seq {seq}, op string, snapshot string, depth long, can_undo boolean, can_redo boolean")


class CachedCatalog:
    """A fetched value for five minutes; if fetching fails, the last good one with a warning."""

    def __init__(self, fetch, seconds: float = 300.0, clock=None):
        import time

        self.fetch, self.seconds, self.clock = fetch, seconds, clock or time.monotonic
        self.value, self.at = None, None

    def get(self) -> tuple[object, str | None]:
        if self.at is not None and self.clock() - self.at < self.seconds:
            return self.value, None
        try:
            self.value = self.fetch()
        except Exception as e:  # noqa: BLE001  a stale catalog is better than none
            return self.value, str(e)
        self.at = self.clock()
        return self.value, None
