"""Queries over event logs: folds, enrichment, liveness, JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnflow.functions import display
from cairnflow.plans.registry import query
from cairnflow.sources import eventlog
from cairnflow.sources.store import shared_folder
from cairnflow.sources.tables import table
from cairnflow.streaming import events as E

_OPS = "CASE event_type WHEN 'signup' THEN 'set' WHEN 'error' THEN 'dec' WHEN 'purchase' THEN 'reset' ELSE 'inc' END"
_FOLD = f"""WITH RECURSIVE o AS MATERIALIZED (SELECT user_id, {_OPS} AS op, CASE event_type WHEN 'signup' THEN event_id % 40 - 2 WHEN 'error' THEN 2 ELSE 3 END AS x,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
  f(user_id, r, n, d) AS (SELECT DISTINCT user_id, 0::BIGINT, 0::BIGINT, 1::BIGINT FROM o UNION ALL
  SELECT f.user_id, o.r, CASE op WHEN 'reset' THEN 0 WHEN 'set' THEN CASE WHEN x <= 0 THEN 1 ELSE least(n, x) END WHEN 'inc' THEN least(n + greatest(x, 0), d) ELSE least(n, greatest(d - greatest(x, 0), 0)) END,
  CASE op WHEN 'reset' THEN 1 WHEN 'set' THEN CASE WHEN x <= 0 THEN 1 ELSE x END WHEN 'inc' THEN d ELSE greatest(d - greatest(x, 0), 0) END
  FROM f JOIN o ON o.user_id = f.user_id AND o.r = f.r + 1)
  SELECT user_id, arg_max(n, r) AS numerator, arg_max(d, r) AS denominator FROM f GROUP BY user_id"""


def _ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    op = F.when(t == "signup", "set").when(t == "error", "dec").when(t == "purchase", "reset").otherwise("inc")
    x = F.when(t == "signup", F.col("event_id") % 40 - 2).when(t == "error", 2).otherwise(3)
    return table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), op.alias("op"), x.cast("bigint").alias("x"))


@query("progress_fold", _FOLD)
def progress_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as progress operations, in order."""
    return E.fold_progress(_ops(spark, sf_dir), ["user_id"])


@query("debounced_selections", """SELECT user_id, event_id, event_type FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n IS NULL OR epoch(n) - epoch(ts) >= 3600""")
def debounced_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last of each user's events before an hour without any."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", F.col("event_id").alias("seq"), "event_type")
    return E.debounced(e, "user_id", 3600).select("user_id", F.col("seq").alias("event_id"), "event_type")


@query("plugin_connections", """WITH b AS (SELECT user_id, ts, lag(ts) OVER w AS p, lead(ts) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))
  SELECT user_id AS plugin_id, ts, true AS connected FROM b WHERE p IS NULL OR floor(epoch(ts) - epoch(p)) > 5 UNION ALL SELECT user_id, ts + INTERVAL 6 SECONDS, false FROM b WHERE n IS NULL OR floor(epoch(n) - epoch(ts)) > 5""")
def plugin_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E4, P14 by event time: when each plugin connects and falls silent."""
    return E.connections(table(spark, sf_dir, "events").select(F.col("user_id").alias("plugin_id"), "ts"))


@query("progress_overall", "SELECT event_id, round(0.2 * least(1, value / 100) + 0.6 * CASE WHEN event_id % 7 <= 0 THEN 0 ELSE least(1, 3 / (event_id % 7)::DOUBLE) END + 0.2 * 0.5, 6) AS progress FROM events")
def progress_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14."""
    part = lambda n, d: F.struct(n.cast("double").alias("numerator"), d.cast("double").alias("denominator"))
    p = display.overall_progress(part(F.col("value"), F.lit(100)), part(F.lit(3), F.col("event_id") % 7), part(F.lit(1), F.lit(2)))
    return table(spark, sf_dir, "events").select("event_id", F.round(p, 6).alias("progress"))


@query("event_props_json", "SELECT event_id, event_type AS event, (props->>'$.k')::BIGINT AS k FROM events WHERE event_id % 10 <> 3")
def event_props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events from NDJSON lines, lines that are no JSON left out."""
    e = table(spark, sf_dir, "events")
    line = F.when(F.col("event_id") % 10 == 3, F.lit("not json")).otherwise(F.concat(F.lit('{"event":"'), "event_type", F.lit('","payload":{"id":'), F.col("event_id").cast("string"), F.lit(',"props":'), "props", F.lit("}}")))
    return E.parsed(e.select(line.alias("value")), {"event_id": ("$.payload.id", "bigint"), "k": ("$.payload.props.k", "bigint")}).select("event_id", "event", "k")


@query("plugin_liveness", """SELECT user_id AS plugin_id, event_id, floor(epoch((SELECT max(ts) FROM events)) - epoch(max_ts)) <= 5 AS alive FROM
  (SELECT user_id, max(ts) AS max_ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id)""")
def plugin_liveness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each plugin's latest heartbeat, and whether it is alive at the log's end."""
    e = table(spark, sf_dir, "events")
    last = E.latest_heartbeats(e.select(F.col("user_id").alias("plugin_id"), "ts", "event_id"))
    return last.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now")))).select("plugin_id", "event_id", E.alive(F.col("ts"), F.col("now")).alias("alive"))


@query("event_enrichment", """SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS session_id FROM events""")
def event_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with the session that its run last started."""
    e = table(spark, sf_dir, "events")
    named = F.when(F.col("event_type") == "signup", "session_started").otherwise(F.col("event_type"))
    out = E.with_session(e.select("event_id", F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), named.alias("event"), F.concat(F.lit('{"sessionId":'), F.col("event_id").cast("string"), F.lit("}")).alias("payload")))
    return out.select("event_id", F.col("session_id").cast("bigint").alias("session_id"))


@query("distinct_snapshots", "SELECT event_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b IS DISTINCT FROM event_type")
def distinct_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E9."""
    log = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_id").alias("seq"), F.col("event_type").alias("snapshot"))
    return E.distinct_snapshots(log, "user_id").select("event_id")


@query("event_log_stream", "SELECT event_id, event_type AS event, (props->>'$.k')::BIGINT AS k, true AS numbered FROM events WHERE event_id % 10 <> 3")
def event_log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table streamed into a log, and the log's offsets, without gaps or repeats, read back with its events."""
    folder, check = shared_folder(spark, "eventlog"), shared_folder(spark, "check")
    e = table(spark, sf_dir, "events")
    source = spark.readStream.schema(e.schema).parquet(f"{sf_dir}/events.parquet*")
    line = F.when(F.col("event_id") % 10 == 3, F.lit("not json")).otherwise(F.concat(F.lit('{"event":"'), "event_type", F.lit('","payload":{"id":'), F.col("event_id").cast("string"), F.lit(',"props":'), "props", F.lit("}}")))
    eventlog.log_sink(source.select(line.alias("value")), folder, check).trigger(availableNow=True).start().awaitTermination()
    log = eventlog.read_log(spark, folder)
    whole = log.agg((F.countDistinct("at") == F.max("at") + 1).alias("numbered"))
    events = E.parsed(log, {"event_id": ("$.payload.id", "bigint"), "k": ("$.payload.props.k", "bigint")})
    return events.select("event_id", "event", "k").crossJoin(F.broadcast(whole))


_HISTORY = """WITH RECURSIVE o AS MATERIALIZED (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN CASE WHEN event_id % 4 = 0 THEN 'reset' ELSE 'redo' END WHEN 'error' THEN 'undo' ELSE 'commit' END AS op,
  CASE WHEN event_type = 'error' AND event_id % 3 > 0 THEN NULL ELSE 's' || event_id % 4 END AS s, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
  f(user_id, r, event_id, h, p) AS (SELECT DISTINCT user_id, 0::BIGINT, NULL::BIGINT, [NULL]::VARCHAR[], 1::BIGINT FROM o UNION ALL
  SELECT user_id, r, event_id, CASE op WHEN 'reset' THEN [s] ELSE h2 END, CASE op WHEN 'reset' THEN 1 WHEN 'undo' THEN greatest(1, p2 - 1) WHEN 'redo' THEN least(len(h2), p2 + 1) ELSE p2 END
  FROM (SELECT user_id, r, event_id, op, s, CASE WHEN push THEN list_append(h[1:p], s) ELSE h END AS h2, CASE WHEN push THEN p + 1 ELSE p END AS p2
  FROM (SELECT f.user_id, o.r, o.event_id, o.op, o.s, f.h, f.p, (op = 'commit' OR (op = 'undo' AND s IS NOT NULL)) AND h[p] IS DISTINCT FROM s AS push FROM f JOIN o ON o.user_id = f.user_id AND o.r = f.r + 1)))
  SELECT event_id, h[p] AS snapshot, p - 1 AS depth, p > 1 AS can_undo, p < len(h) AS can_redo FROM f WHERE r > 0"""


@query("selection_history", _HISTORY)
def selection_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as commits, undos, redos and resets of each user's selection."""
    t, i = F.col("event_type"), F.col("event_id")
    op = F.when(t == "purchase", F.when(i % 4 == 0, "reset").otherwise("redo")).when(t == "error", "undo").otherwise("commit")
    snapshot = F.when((t == "error") & (i % 3 > 0), F.lit(None)).otherwise(F.concat(F.lit("s"), (i % 4).cast("string")))
    log = table(spark, sf_dir, "events").select("user_id", i.alias("seq"), op.alias("op"), snapshot.alias("snapshot"))
    return E.selection_history(log, "user_id").select(F.col("seq").alias("event_id"), "snapshot", "depth", "can_undo", "can_redo")


@query("progress_reports", "SELECT user_id, ceil(count(*) / 4.0)::BIGINT AS rendering, ceil(count(*) / 32.0)::BIGINT AS analysis FROM events GROUP BY user_id")
def progress_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E2."""
    n = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return n.select("user_id", E.reports(F.col("n"), "rendering").alias("rendering"), E.reports(F.col("n"), "analysis").alias("analysis"))
