"""Queries over session tables (orders stand for sessions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnflow.functions import names
from cairnflow.operators import selection, sessions
from cairnflow.plans.registry import query
from cairnflow.sources import archives, items, transfers
from cairnflow.sources.store import shared_folder
from cairnflow.sources.tables import table

_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'clustered' WHEN 'P' THEN 'analyzed' ELSE 'rendered' END"
_SESSIONS = f"SELECT o_orderkey AS session_id, o_orderdate AS modified_at, {_STATUS} AS process_status, o_orderkey % 100 = 1 AS protected, o_orderkey % 50 = 2 AS running, o_custkey FROM orders"


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("o_orderstatus")
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("session_id"), F.col("o_orderdate").alias("modified_at"), F.when(s == "F", "clustered").when(s == "P", "analyzed").otherwise("rendered").alias("process_status"),
        (key % 100 == 1).alias("protected"), (key % 50 == 2).alias("running"), "o_custkey")


@query("history_cap_protected", f"SELECT session_id FROM (SELECT *, row_number() OVER (ORDER BY modified_at DESC, session_id DESC) AS r FROM ({_SESSIONS})) WHERE r <= 20 OR protected")
def history_cap_protected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T3."""
    return selection.history(_sessions(spark, sf_dir)).select("session_id")


@query("latest_clustered", f"SELECT session_id FROM ({_SESSIONS}) WHERE process_status = 'clustered' ORDER BY modified_at DESC, session_id DESC LIMIT 1")
def latest_clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9, P15."""
    return selection.latest_clustered(_sessions(spark, sf_dir)).select("session_id")


@query("running_first_order", f"SELECT session_id, row_number() OVER (ORDER BY running DESC, modified_at DESC, session_id) AS place FROM ({_SESSIONS})")
def running_first_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4, as places, since a table has no order."""
    return selection.running_first(_sessions(spark, sf_dir).select("session_id", "running", "modified_at")).select("session_id", "place")


@query("unseen_completed", f"SELECT session_id FROM ({_SESSIONS}) WHERE process_status = 'clustered' AND NOT running AND session_id % 3 <> 0")
def unseen_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with keys divisible by 3 were seen as they are, by 4 at another time."""
    s = _sessions(spark, sf_dir)
    seen = s.where("session_id % 3 = 0").unionByName(s.where("session_id % 3 <> 0 and session_id % 4 = 0").withColumn("modified_at", F.col("modified_at") - F.expr("interval 1 day")))
    return selection.unseen_completed(s, seen).select("session_id")


@query("stage_invalidation", f"""SELECT session_id, ['empty', 'rendered', 'analyzed', 'clustered'][least(s, CASE WHEN session_id % 5 = 0 THEN 0 ELSE 9 END, CASE WHEN session_id % 3 = 0 THEN 1 ELSE 9 END, CASE WHEN session_id % 2 = 0 THEN 2 ELSE 9 END) + 1] AS resume
  FROM (SELECT session_id, CASE process_status WHEN 'clustered' THEN 3 WHEN 'analyzed' THEN 2 ELSE 1 END AS s FROM ({_SESSIONS}))""")
def stage_invalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2."""
    k = F.col("session_id")
    return _sessions(spark, sf_dir).select("session_id", sessions.resume_column(F.col("process_status"), F.lit(None).cast("string"), k % 5 == 0, k % 3 == 0, k % 2 == 0).alias("resume"))


@query("version_prune", "SELECT o_orderkey FROM orders WHERE (o_orderkey % 40 > 26 OR (o_orderkey % 40 = 26 AND o_custkey % 3 >= 1)) AND o_orderkey % 11 <> 0")
def version_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions v0.<n>.<m>, some unreadable."""
    o = table(spark, sf_dir, "orders")
    version = F.concat(F.lit("v0."), (F.col("o_orderkey") % 40).cast("string"), F.lit("."), (F.col("o_custkey") % 3).cast("string"))
    return o.where(names.supported_version(F.lit(None).cast("string"), F.when(F.col("o_orderkey") % 11 == 0, F.lit("?")).otherwise(version))).select("o_orderkey")


@query("cache_eviction", """SELECT o_orderkey AS key FROM (SELECT o_orderkey, sum(floor(o_totalprice)::BIGINT) OVER (ORDER BY o_orderdate DESC, o_orderkey ROWS UNBOUNDED PRECEDING) AS total FROM orders) WHERE total > 20000000""")
def cache_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S29."""
    cache = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.floor("o_totalprice").alias("bytes"), F.col("o_orderdate").alias("used_at"))
    return items.evicted(cache, 20_000_000).select("key")


def _archives(spark: SparkSession, sf_dir: str) -> str:
    """The parts as archives by brand: a member for each part, a document about all of them."""
    p = table(spark, sf_dir, "part")
    each = p.select(F.col("p_brand").alias("archive"), F.concat(F.lit("parts/"), F.col("p_partkey").cast("string"), F.lit(".txt")).alias("name"), F.encode("p_name", "utf-8").alias("content"))
    about = p.groupBy(F.col("p_brand").alias("archive")).agg(F.encode(F.concat(F.lit('{"parts":'), F.count("*").cast("string"), F.lit("}")), "utf-8").alias("content")).select("archive", F.lit("config.json").alias("name"), "content")
    folder = shared_folder(spark, "archives")
    archives.write_archives(each.unionByName(about), folder)
    return folder


_MEMBERS = """SELECT p_brand AS archive, 'parts/' || p_partkey || '.txt' AS name, p_name AS content FROM part UNION ALL SELECT p_brand, 'config.json', '{"parts":' || count(*) || '}' FROM part GROUP BY p_brand"""


@query("archive_members", f"SELECT archive, name, strlen(content) AS bytes, content FROM ({_MEMBERS})")
def archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables packed into archives, and all of their members read back."""
    return archives.read_archives(spark, _archives(spark, sf_dir)).withColumn("content", F.decode("content", "utf-8"))


@query("archive_configs", f"""SELECT archive, (content->>'$.parts')::BIGINT AS parts FROM ({_MEMBERS}) WHERE name = 'config.json'""")
def archive_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One member of each archive."""
    found = archives.member(spark, _archives(spark, sf_dir), "config.json")
    return found.select("archive", F.get_json_object(F.decode("content", "utf-8"), "$.parts").cast("bigint").alias("parts"))


@query("archive_replaced", f"""SELECT archive, name, CASE WHEN name = 'config.json' AND archive IN (SELECT p_brand FROM part WHERE p_size = 50) THEN '{{"largest":50}}' ELSE content END AS content FROM ({_MEMBERS})""")
def archive_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document about an archive replaced where it holds a part of the largest size; one for an archive that is not there is left out."""
    folder = _archives(spark, sf_dir)
    large = table(spark, sf_dir, "part").where("p_size = 50").select(F.col("p_brand").alias("archive")).distinct().union(spark.range(1).select(F.lit("nowhere")))
    archives.replace_members(spark, folder, large.select("archive", F.lit("config.json").alias("name"), F.encode(F.lit('{"largest":50}'), "utf-8").alias("content")))
    return archives.read_archives(spark, folder).select("archive", "name", F.decode("content", "utf-8").alias("content"))


def _written(spark: SparkSession, files: DataFrame) -> str:
    """Files (name, content: string) written by tasks below a shared folder."""
    folder = shared_folder(spark, "files")
    failed = transfers.save(files.select("name", F.encode("content", "utf-8").alias("content")), folder).where("error is not null").first()
    if failed is not None:
        raise OSError(failed.error)
    return folder


@query("item_files", """SELECT s_name AS safe_name, s_nationkey * 10 AS weight, 'n' || s_nationkey AS name_en, CASE WHEN s_suppkey % 3 = 0 THEN s_nationkey END AS k,
  CASE WHEN s_suppkey % 3 = 0 THEN [s_suppkey / 4, -0.5] END::VARCHAR AS two FROM supplier WHERE s_suppkey % 7 <> 1""")
def item_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each item, some broken, some with what was computed, written as files and scanned."""
    s = table(spark, sf_dir, "supplier")
    name, k = F.col("s_name"), F.col("s_suppkey")
    meta = F.to_json(F.struct(name.alias("safe_name"), (F.col("s_nationkey") * 10).alias("weight"), F.create_map(F.lit("en"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))).alias("family_names")))
    computed = F.to_json(F.struct(name.alias("safe_name"), F.struct(F.col("s_nationkey").alias("k"), F.array(k / 4, F.lit(-0.5)).alias("two")).alias("clustering")))
    files = s.select(F.concat(name, F.lit("/meta.json")).alias("name"), F.when(k % 7 == 1, F.lit("{broken")).otherwise(meta).alias("content"))
    folder = _written(spark, files.union(s.where(k % 3 == 0).select(F.concat(name, F.lit("/computed.json")), computed)))
    known = items.read_items(spark, folder).where("safe_name is not null").select("safe_name", "weight", F.col("family_names")["en"].alias("name_en"))
    both = selection.with_computed(known, items.read_computed(spark, folder).where("safe_name is not null"))
    two = F.transform("clustering.two", lambda x: x.cast("string"))
    return both.select("safe_name", "weight", "name_en", F.col("clustering.k").alias("k"), F.concat(F.lit("["), F.array_join(two, ", "), F.lit("]")).alias("two"))


@query("catalog_file", "SELECT row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) - 1 AS rank, s_name AS family, 'v' || s_nationkey AS variant FROM supplier")
def catalog_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog is one document, an ordered array, in the second of two places."""
    order = F.sort_array(F.collect_list(F.struct((-F.col("s_acctbal")).alias("a"), "s_suppkey", "s_name", "s_nationkey")))
    each = F.transform(order, lambda r: F.struct(r["s_name"].alias("family"), F.array(F.concat(F.lit("v"), r["s_nationkey"].cast("string"))).alias("variants"), F.array().cast("array<string>").alias("subsets")))
    folder = _written(spark, table(spark, sf_dir, "supplier").agg(F.to_json(each).alias("content")).select(F.lit("catalog.json").alias("name"), "content"))
    found = items.read_catalog(spark, f"{folder}/absent.json", f"{folder}/catalog.json")
    return found.select(F.col("rank").cast("bigint").alias("rank"), "family", F.col("variants")[0].alias("variant"))


@query("model_files", "SELECT 'm-' || s_suppkey AS id, s_name AS name, s_suppkey * 1000 AS parameter_count FROM supplier WHERE s_suppkey % 5 <> 2 AND s_suppkey % 4 <> 3 AND s_suppkey * 1000 <> 0")
def model_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests in folders of their own; those of another version, without sound digests or with no parameters are passed over."""
    k = F.col("s_suppkey")
    digest = F.when(k % 4 == 3, F.lit("short")).otherwise(F.sha2("s_name", 256))
    content = F.to_json(F.struct(F.when(k % 5 == 2, 9).otherwise(1).alias("api_version"), F.concat(F.lit("m-"), k.cast("string")).alias("id"), F.col("s_name").alias("name"), (k * 1000).alias("parameter_count"), F.array(digest).alias("digests")))
    folder = _written(spark, table(spark, sf_dir, "supplier").select(F.concat(F.lit("m-"), k.cast("string"), F.lit("/model.json")).alias("name"), content.alias("content")))
    return items.read_models(spark, folder).select("id", "name", "parameter_count")


@query("session_tables", """SELECT o_orderstatus || '' AS origin, o_orderkey AS id, o_totalprice AS price, o_custkey AS "left" FROM orders WHERE o_orderstatus IN ('F', 'P')
  UNION ALL SELECT 'copy', o_orderkey, o_totalprice, o_custkey FROM orders WHERE o_orderstatus = 'F'""")
def session_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of three sessions written, one session copied with all of its tables, one deleted."""
    catalog, o = sessions.Catalog(spark, shared_folder(spark, "catalog")), table(spark, sf_dir, "orders")
    ids = {}
    for status in ("F", "O", "P"):
        ids[status] = catalog.create({"title": status})
        own = o.where(F.col("o_orderstatus") == status)
        catalog.write("items", ids[status], own.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price")))
        catalog.write("merges", ids[status], own.select(F.col("o_orderkey").alias("step"), F.col("o_custkey").alias("left")))
    ids["copy"] = catalog.duplicate(ids["F"])
    catalog.delete(ids["O"])
    origin = F.element_at(F.create_map(*(F.lit(x) for pair in ids.items() for x in reversed(pair))), F.col("session_id"))
    both = catalog.read("items").join(catalog.read("merges").withColumnRenamed("step", "id"), ["session_id", "id"])
    return both.select(origin.alias("origin"), "id", "price", "left")
