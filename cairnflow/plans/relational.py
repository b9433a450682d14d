"""Queries beyond the similarity operators that the star schema invites: joins, rollups, windows, sets, time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnflow.plans.registry import query
from cairnflow.sources.tables import table


@query("pricing_summary", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, sum(round(l_extendedprice * (1 - l_discount) * 10000)::BIGINT)::BIGINT AS revenue_e4, count(*) AS n
  FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beyond the reference: filter, partial and final aggregation."""
    li = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp '1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.sum(F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 10000).cast("bigint")).alias("revenue_e4"), F.count("*").alias("n"))


@query("segment_revenue", """SELECT c_mktsegment, n_name, sum(round(l_extendedprice * (1 - l_discount) * 10000)::BIGINT)::BIGINT AS revenue_e4 FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
  JOIN nation ON n_nationkey = c_nationkey WHERE o_orderstatus = 'F' GROUP BY ALL""")
def segment_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beyond the reference: a star join."""
    t = lambda n: table(spark, sf_dir, n)
    joined = t("customer").join(t("orders").where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey")).join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return joined.groupBy("c_mktsegment", "n_name").agg(F.sum(F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 10000).cast("bigint")).alias("revenue_e4"))


@query("region_rollup", "SELECT r_name, n_name, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY ROLLUP (r_name, n_name)")
def region_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beyond the reference: grouping sets."""
    t = lambda n: table(spark, sf_dir, n)
    joined = t("region").join(t("nation"), F.col("r_regionkey") == F.col("n_regionkey")).join(t("supplier"), F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.rollup("r_name", "n_name").agg(F.count("*").alias("n"))


@query("customers_without_orders", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def customers_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beyond the reference: anti join."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(o, "c_custkey", "left_anti").select("c_custkey")


@query("top_orders_per_customer", "SELECT o_custkey, o_orderkey, r FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def top_orders_per_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beyond the reference: ranking within groups."""
    r = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, sf_dir, "orders").withColumn("r", r).where("r <= 3").select("o_custkey", "o_orderkey", "r")


@query("hourly_events", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beyond the reference: tumbling windows."""
    e = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select(F.col("w.start").alias("hour"), "event_type", "n", "total")


@query("user_sessions", """WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events),
  g AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, k""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beyond the reference: session windows."""
    e = table(spark, sf_dir, "events").groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return e.select("user_id", F.col("w.start").alias("start"), "n")


@query("shared_keys", "SELECT p_partkey AS key FROM part INTERSECT SELECT o_orderkey FROM orders EXCEPT SELECT s_suppkey FROM supplier")
def shared_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beyond the reference: set operations."""
    t = lambda n, c: table(spark, sf_dir, n).select(F.col(c).alias("key"))
    return t("part", "p_partkey").intersect(t("orders", "o_orderkey")).subtract(t("supplier", "s_suppkey"))
