"""Queries over item vectors: scans, norms, distances, moments, features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnflow.functions import vectors as V
from cairnflow.operators import features, linkage, pairs, selection
from cairnflow.plans.registry import query
from cairnflow.sources.tables import table


@query("vec_scan_indexed", "SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS idx, len(embedding) AS dims FROM embeddings WHERE embedding IS NOT NULL")
def vec_scan_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1."""
    e = table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", F.size("embedding").cast("bigint").alias("dims"))
    return selection.indexed(e, "vec_id").select("vec_id", "idx", "dims")


@query("vec_norms", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings")
def vec_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V10 against the origin."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.sqrt(V.squared_norm(F.col("embedding"))), 6).alias("norm"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), V.doubles(F.col("embedding")).alias("v"))


_PAIRS = "SELECT a.vec_id AS id_a, b.vec_id AS id_b, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id"


@query("pairwise_distances_top", f"SELECT id_a, id_b, round(d, 6) AS d FROM ({_PAIRS}) ORDER BY d, id_a, id_b LIMIT 100")
def pairwise_distances_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J10, V10 and the hundred nearest pairs."""
    return pairs.nearest_pairs(_vectors(spark, sf_dir), 100).select(F.col("a").alias("id_a"), F.col("b").alias("id_b"), F.round("d", 6).alias("d"))


@query("unit_diameter_rescale", f"WITH m AS (SELECT max(d) AS d FROM ({_PAIRS})) SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE / m.d)), 6) AS total, round(embedding[1]::DOUBLE / m.d, 6) AS first FROM embeddings, m")
def unit_diameter_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V11, A6."""
    e, widest = table(spark, sf_dir, "embeddings"), pairs.farthest(_vectors(spark, sf_dir))
    scaled = e.crossJoin(F.broadcast(widest)).select("vec_id", V.divided(F.col("embedding"), F.col("m")).alias("v"))
    return scaled.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.round(F.get("v", F.lit(0)), 6).alias("first"))


@query("nearest_neighbor", """SELECT a.vec_id, arg_min(b.vec_id, (round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9), b.vec_id)) AS neighbor,
  round(min(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id GROUP BY a.vec_id""")
def nearest_neighbor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact nearest item of every item (the tree search in the optional subpackage avoids all pairs)."""
    return pairs.nearest_of_each(_vectors(spark, sf_dir)).select(F.col("a").alias("vec_id"), F.col("b").alias("neighbor"), F.round("d", 6).alias("d"))


@query("column_mean_std", "SELECT i AS component, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY i")
def column_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: one row for each component of a vector."""
    rows = features.component_moments(table(spark, sf_dir, "embeddings"), "embedding")
    return rows.select(F.col("component").cast("long").alias("component"), F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("standardize_columns", """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
  m AS (SELECT i, avg(x) AS a, greatest(stddev_pop(x), 1e-6) AS s FROM e GROUP BY i)
  SELECT vec_id, round(sum((x - a) / s), 4) AS total, round(max((x - a) / s), 4) AS most FROM e JOIN m USING (i) GROUP BY vec_id""")
def standardize_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3."""
    z = features.standardize(table(spark, sf_dir, "embeddings"), "embedding", "z")
    return z.select("vec_id", F.round(F.aggregate("z", F.lit(0.0), lambda s, x: s + x), 4).alias("total"), F.round(F.array_max("z"), 4).alias("most"))


@query("emphasis_axis", """WITH m AS (SELECT avg(embedding[1]::DOUBLE) AS a, greatest(stddev_pop(embedding[1]::DOUBLE), 1e-6) AS s FROM embeddings),
  r AS (SELECT i, stddev_pop(x) AS s FROM (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) WHERE i > 1 GROUP BY i),
  t AS (SELECT greatest(sum(s) / 64, 1e-6) AS ref FROM r)
  SELECT vec_id, round((embedding[1]::DOUBLE - m.a) / m.s * ref * 4, 5) AS axis FROM embeddings, m, t""")
def emphasis_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The axis of an attribute whose direction is the first basis vector, at level 2."""
    e = table(spark, sf_dir, "embeddings")
    built = features.build_features(e, "embedding", "f", dims=64, emphasis={"first": 2}, directions={"first": [1.0] + [0.0] * 63})
    return built.select("vec_id", F.round(F.element_at("f", -1), 5).alias("axis"))


@query("gram_schmidt_residual", "SELECT vec_id, round(list_sum(list_transform(embedding[3:], lambda x: x::DOUBLE * x::DOUBLE)), 6) AS rest FROM embeddings")
def gram_schmidt_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6: squared length left after the span of two directions is taken away (the first two basis vectors, given obliquely)."""
    rows = np.zeros((3, 64))
    rows[0, 0], rows[1, :2], rows[2, 0] = 2.0, (1.0, 3.0), 4.0
    basis = features.orthonormal(rows)
    e = features.project(table(spark, sf_dir, "embeddings"), "embedding", basis, np.zeros(64), "c")
    inside = F.aggregate("c", F.lit(0.0), lambda s, x: s + x * x)
    return e.select("vec_id", F.round(V.squared_norm(F.col("embedding")) - inside, 6).alias("rest"))


@query("pca_variance", "SELECT 64::BIGINT AS components, round(sum(v), 5) AS variance FROM (SELECT var_pop(x) AS v FROM (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY i)")
def pca_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: the components carry the columns' whole variance (free of signs)."""
    s = features.pca(table(spark, sf_dir, "embeddings"), "embedding", 64, "s")
    each = s.select(F.posexplode("s").alias("i", "x")).groupBy("i").agg(F.var_pop("x").alias("v"))
    return each.agg(F.count("*").alias("components"), F.round(F.sum("v"), 5).alias("variance"))


def _axis_sql(k: int, covariance: str) -> str:
    """The leading axis of a covariance (i, j, v) by repeated squaring, its largest entry positive, and what is left without it."""
    return f"""sq{k}(step, i, j, v) AS (SELECT 0, i, j, v / (SELECT sum(v) FROM {covariance} WHERE i = j) FROM {covariance} UNION ALL
    (WITH size AS (SELECT sum(v * v) AS t FROM sq{k}) SELECT a.step + 1, a.i, b.j, sum(a.v * b.v) / max(t) FROM sq{k} a JOIN sq{k} b ON a.j = b.i, size WHERE a.step < 20 GROUP BY ALL)),
  last{k} AS (SELECT i, j, v FROM sq{k} WHERE step = 20), line{k} AS (SELECT i, v FROM last{k} WHERE j = (SELECT arg_max(i, v) FROM last{k} WHERE i = j)),
  axis{k} AS (SELECT i, v / sqrt((SELECT sum(v * v) FROM line{k})) * sign((SELECT arg_max(v, abs(v)) FROM line{k})) AS v FROM line{k}),
  share{k} AS (SELECT sum(c.v * a.v * b.v) AS l FROM {covariance} c JOIN axis{k} a ON a.i = c.i JOIN axis{k} b ON b.i = c.j),
  rest{k} AS MATERIALIZED (SELECT c.i, c.j, c.v - l * a.v * b.v AS v FROM {covariance} c JOIN axis{k} a ON a.i = c.i JOIN axis{k} b ON b.i = c.j, share{k}),
  score{k} AS (SELECT vec_id, sum(x * v) AS s FROM x JOIN axis{k} USING (i) GROUP BY vec_id)"""


@query("scatter_projection", f"""WITH RECURSIVE raw AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
  x AS MATERIALIZED (SELECT vec_id, i, x - avg(x) OVER (PARTITION BY i) AS x FROM raw), cov AS MATERIALIZED (SELECT a.i AS i, b.i AS j, avg(a.x * b.x) AS v FROM x a JOIN x b USING (vec_id) GROUP BY ALL),
  {_axis_sql(1, 'cov')}, {_axis_sql(2, 'rest1')}
  SELECT vec_id, round(a.s / greatest((SELECT stddev_pop(s) FROM score1), 1e-6), 4) AS x, round(b.s / greatest((SELECT stddev_pop(s) FROM score2), 1e-6), 4) AS y FROM score1 a JOIN score2 b USING (vec_id)""")
def scatter_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V9."""
    return features.scatter(table(spark, sf_dir, "embeddings"), "embedding").select("vec_id", F.round("two.x", 4).alias("x"), F.round("two.y", 4).alias("y"))


@query("cluster_stats_by_label", """WITH c AS (SELECT label, i, avg(x) AS c, count(*) AS n FROM
  (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i)
  SELECT label AS k, max(n) AS size, round(sum(c), 5) AS total, round(max(c), 5) AS most FROM c GROUP BY label""")
def cluster_stats_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and centroid of every cluster."""
    c = linkage.statistics(table(spark, sf_dir, "embeddings").select(F.col("label").alias("k"), "embedding"), ["k"], "embedding")
    return c.select("k", "size", F.round(F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x), 5).alias("total"), F.round(F.array_max("centroid"), 5).alias("most"))
