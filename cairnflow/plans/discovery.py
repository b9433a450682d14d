"""Queries over names, faces, catalogs and selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnflow.functions import names
from cairnflow.operators import search, selection
from cairnflow.plans.registry import query
from cairnflow.sources.store import shared_folder
from cairnflow.sources.tables import table

TARGETS = (100, 200, 300, 400, 500)


def _faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_brand").alias("family"), F.col("p_partkey").alias("face_ord"), (F.col("p_size") * 10).alias("actual_weight"))


def _targets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t,) for t in TARGETS], "target int")


_WINDOW = "CASE WHEN target < 400 THEN w - target > -50 AND w - target <= 50 WHEN target > 400 THEN w - target >= -50 AND w - target < 50 ELSE w - target > -50 AND w - target < 50 END"
_BEST = f"""SELECT family, target, face_ord, w FROM (SELECT *, row_number() OVER (PARTITION BY family, target ORDER BY abs(w - target), face_ord) AS r FROM
  (SELECT p_brand AS family, p_partkey AS face_ord, p_size * 10 AS w FROM part), (SELECT unnest({list(TARGETS)}) AS target) WHERE {_WINDOW}) WHERE r = 1"""


@query("weight_window_best_face", f"SELECT family, target, face_ord, w AS actual_weight FROM ({_BEST})")
def weight_window_best_face(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4, J1, T7."""
    return selection.best_faces(_faces(spark, sf_dir), _targets(spark)).select("family", "target", "face_ord", "actual_weight")


@query("families_per_weight", f"""SELECT t.target, count(family) AS n, coalesce(string_agg(family, ',' ORDER BY family), '') AS families
  FROM (SELECT unnest({list((*TARGETS, 900))}) AS target) t LEFT JOIN ({_BEST}) b ON b.target = t.target GROUP BY t.target""")
def families_per_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3, A4."""
    targets = spark.createDataFrame([(t,) for t in (*TARGETS, 900)], "target int")
    out = selection.families_per_weight(selection.best_faces(_faces(spark, sf_dir), _targets(spark)), targets)
    return out.select("target", F.col("n").cast("bigint").alias("n"), F.array_join("families", ",").alias("families"))


@query("available_weights", "SELECT p_brand AS family, string_agg('Weight(' || (p_size * 10) || ')', ',' ORDER BY p_partkey) AS weights FROM part GROUP BY p_brand")
def available_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, A2."""
    return selection.available_weights(_faces(spark, sf_dir)).select("family", F.array_join("weights", ",").alias("weights"))


@query("safe_name_projection", r"SELECT p_partkey, (p_size * 10) || '_' || translate(p_name || '/' || p_brand, ' /\', '___') AS safe_name FROM part")
def safe_name_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1."""
    return table(spark, sf_dir, "part").select("p_partkey", names.safe_name(F.concat("p_name", F.lit("/"), "p_brand"), F.col("p_size") * 10).alias("safe_name"))


@query("family_from_stem", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE replace(p_brand, '_', ' ') END AS family FROM part")
def family_from_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2."""
    stem = F.concat(F.translate("p_brand", " ", "_"), F.when(F.col("p_size") % 3 == 0, F.lit("-400")).otherwise(F.lit("_Weight400_Weight")))
    return table(spark, sf_dir, "part").select("p_partkey", names.family_of_stem(stem).alias("family"))


@query("name_preference", """SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN p_name WHEN p_size % 4 = 1 THEN p_type WHEN p_size % 4 = 2 THEN p_brand ELSE p_name END AS name,
  CASE WHEN p_size % 4 = 0 THEN p_name WHEN p_size % 4 = 1 THEN p_type ELSE 'Regular' END AS style FROM part""")
def name_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3, F6, F7."""
    kind = F.col("p_size") % 4
    none = F.expr("cast(map() as map<string,string>)")
    typographic = F.when(kind == 0, F.create_map(F.lit("en-US"), "p_name", F.lit("en"), "p_brand")).when(kind == 1, F.create_map(F.lit("fr"), "p_name", F.lit("en"), "p_type")).otherwise(none)
    family = F.when(kind == 2, F.create_map(F.lit("1033"), "p_brand", F.lit("de"), "p_name")).otherwise(none)
    return table(spark, sf_dir, "part").select("p_partkey", names.family_key(typographic, family, F.col("p_name")).alias("name"), names.style_key(typographic, none).alias("style"))


@query("subset_coverage", "SELECT doc_id FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '(^|[^\\p{L}])the($|[^\\p{L}])') AND regexp_matches(text, '(^|[^\\p{L}])(of|and)($|[^\\p{L}])')")
def subset_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: documents whose words cover every requirement."""
    words = F.split("text", r"[^\p{L}]")
    wanted = F.array(F.array(F.lit("the")), F.array(F.lit("of"), F.lit("and")))
    return table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).where(names.covers(wanted, words)).select("doc_id")


_VARIANTS = "CASE p_size % 4 WHEN 0 THEN ['regular', '700'] WHEN 1 THEN ['bold'] WHEN 2 THEN ['300italic'] ELSE ['300', '400'] END"


def _variants() -> Column:
    a = lambda *v: F.array(*map(F.lit, v))
    k = F.col("p_size") % 4
    return F.when(k == 0, a("regular", "700")).when(k == 1, a("bold")).when(k == 2, a("300italic")).otherwise(a("300", "400"))


@query("api_weight_map", f"""SELECT p_partkey, w, CASE WHEN w = 400 AND (list_contains(v, 'regular') OR list_contains(v, '400')) THEN '400'
  WHEN w = 700 AND (list_contains(v, 'bold') OR list_contains(v, '700')) THEN '700' WHEN w NOT IN (400, 700) AND list_contains(v, w::VARCHAR) THEN w::VARCHAR END AS api
  FROM (SELECT p_partkey, {_VARIANTS} AS v FROM part), (SELECT unnest([300, 400, 700]) AS w)""")
def api_weight_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F10, P6."""
    each = table(spark, sf_dir, "part").select("p_partkey", _variants().alias("v"), F.explode(F.array(*map(F.lit, (300, 400, 700)))).alias("w"))
    return each.select("p_partkey", "w", names.api_weight(F.col("w"), F.col("v")).alias("api"))


@query("popularity_topn_after_filter", f"SELECT p_partkey AS rank, p_brand AS family FROM (SELECT *, {_VARIANTS} AS v FROM part) WHERE (list_contains(v, 'regular') OR list_contains(v, '400')) AND p_size % 2 = 0 ORDER BY rank LIMIT 100")
def popularity_topn_after_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1."""
    catalog = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("rank"), F.col("p_brand").alias("family"), _variants().alias("variants"), F.when(F.col("p_size") % 2 == 0, F.array(F.lit("latin"))).otherwise(F.array(F.lit("greek"))).alias("subsets"))
    return selection.top_after_filters(catalog, F.array(F.array(F.lit("latin"), F.lit("latin-ext"))), F.array(F.lit(400)), 100).select("rank", "family")


@query("largest_clusters_top9", "SELECT label AS k, count(*) AS size FROM embeddings GROUP BY label ORDER BY size DESC, k LIMIT 9")
def largest_clusters_top9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2."""
    return selection.largest_clusters(table(spark, sf_dir, "embeddings").select(F.col("label").alias("k")))


@query("interactive_filter", "SELECT p_partkey AS key FROM part WHERE p_size * 10 IN (100, 200, 300) AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#21') AND contains(lower(p_name), 'a')")
def interactive_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1."""
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), (F.col("p_size") * 10).alias("weight"), F.col("p_brand").alias("k"), "p_name")
    hits = items.where(F.lower("p_name").contains("a"))
    return selection.interactive_filter(items, (100, 200, 300), ("Brand#11", "Brand#12", "Brand#21"), hits).select("key")


@query("family_members", "SELECT p_partkey AS key, CASE WHEN p_partkey = 7 THEN 'alias-source' WHEN p_partkey = 5 THEN 'selected' WHEN p_brand = 'Brand#13' THEN 'family' ELSE 'none' END AS emphasis FROM part")
def family_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P24."""
    points = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("family"), F.lit(True).alias("is_filtered"), F.lit(False).alias("is_detailed"))
    return selection.presentation(points, "5", "Brand#13", "7", True, True).select("key", "emphasis")


@query("filter_indicator", "SELECT p_partkey, p_size % 5 = 0 OR p_size * 10 NOT IN (200, 300) AS active FROM part")
def filter_indicator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session has weights 200 and 300; an item's own weight decides whether both are switched on."""
    size = F.col("p_size")
    both = F.array(F.lit(200), F.lit(300))
    on = F.when((size * 10).isin(200, 300), both).otherwise(F.array(size * 10))
    text = F.when(size % 5 == 0, F.lit("x")).otherwise(F.lit(""))
    return table(spark, sf_dir, "part").select("p_partkey", selection.filter_active(text, both, on, F.array().cast("array<int>")).alias("active"))


@query("catalog_union_precedence", """SELECT s_suppkey AS id, s_name AS name, 'local' AS origin FROM supplier UNION ALL
  SELECT c_custkey, c_name, 'remote' FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)""")
def catalog_union_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U1, U2."""
    local = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("local").alias("origin"))
    remote = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("remote").alias("origin"))
    return selection.union_by_precedence(local, remote, "id")


FUZZY_SQL = """WITH t AS (SELECT p_partkey, unnest([p_brand, p_name]) AS v FROM part), ends AS (SELECT p_partkey, v, unnest(range(1, len(v) + 1)) AS e FROM t),
  near AS (SELECT p_partkey, v, e, min(levenshtein(substr(lower(v), e - n + 1, n), 'brnd#12')) AS k FROM ends, (SELECT unnest([6, 7, 8]) AS n) WHERE n <= e GROUP BY ALL),
  best AS (SELECT p_partkey, v, min(k / 7 + greatest(0, e - 7) / 100) AS s FROM near WHERE k <= 1 AND k / 7 + greatest(0, e - 7) / 100 <= 0.25 GROUP BY ALL)
  SELECT p_partkey, round(product(pow(CASE WHEN lower(v) = 'brnd#12' THEN pow(2.0, -52) ELSE greatest(s, 0.001) END, round(1 / sqrt(len(string_split(v, ' '))), 3) / 2)), 6) AS score FROM best GROUP BY p_partkey"""


@query("fuzzy_name_search", FUZZY_SQL)
def fuzzy_name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substrings within one error of the query, scored by errors and place, over two keys."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    return search.fuzzy_search(p, "brnd#12", [F.array("p_brand"), F.array("p_name")]).select("p_partkey", F.round("score", 6).alias("score"))


@query("fuzzy_index_search", FUZZY_SQL)
def fuzzy_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by an index of grams, written and then read at the query's grams."""
    index = search.NameIndex.build(table(spark, sf_dir, "part"), "p_partkey", [F.array("p_brand"), F.array("p_name")], shared_folder(spark, "names"))
    return index.search("brnd#12", 2).select(F.col("key").alias("p_partkey"), F.round("score", 6).alias("score"))


@query("name_edit_distance", "SELECT p_partkey, levenshtein(lower(p_brand), 'brand#11') AS edits FROM part WHERE levenshtein(lower(p_brand), 'brand#11') <= 1")
def name_edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V14's native approximation."""
    d = F.levenshtein(F.lower("p_brand"), F.lit("brand#11")).cast("bigint")
    return table(spark, sf_dir, "part").select("p_partkey", d.alias("edits")).where("edits <= 1")


@query("weight_labels", "SELECT p_partkey, ['Th', 'El', 'L', 'R', 'M', 'S', 'B', 'Eb', 'Bl'][floor(p_size * 20 / 100.0 + 0.5)::INT] AS label FROM part")
def weight_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F13."""
    return table(spark, sf_dir, "part").select("p_partkey", names.weight_label(F.col("p_size") * 20).alias("label"))
