"""Queries over hierarchical clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnflow.functions import display
from cairnflow.functions import vectors as V
from cairnflow.operators import graph, hierarchy, linkage, pairs, selection, topology
from cairnflow.plans.registry import query
from cairnflow.plans.vectors import _PAIRS, _vectors
from cairnflow.sources.store import stored
from cairnflow.sources.tables import table

THRESHOLD = 0.62
_LABELS = f"""WITH RECURSIVE p AS MATERIALIZED ({_PAIRS}), m AS (SELECT max(d) AS d FROM p),
  e AS MATERIALIZED (SELECT id_a AS a, id_b AS b FROM p, m WHERE p.d / m.d <= {THRESHOLD} UNION ALL SELECT id_b, id_a FROM p, m WHERE p.d / m.d <= {THRESHOLD}),
  r(node, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node WHERE r.root < e.b),
  c AS (SELECT node, min(root) AS root FROM r GROUP BY node)"""


@query("single_linkage_cut", f"{_LABELS} SELECT node AS vec_id, dense_rank() OVER (ORDER BY root) - 1 AS k FROM c")
def single_linkage_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1, G3, G4, W2 for single linkage: components of the pairs within the threshold, in unit-diameter space."""
    v = _vectors(spark, sf_dir)
    near = pairs.connected(v, THRESHOLD)
    return graph.single_linkage_labels(v.select(F.col("id").alias("node")), near).select(F.col("node").alias("vec_id"), "k")


@query("single_linkage_sizes", f"{_LABELS} SELECT root AS k_root, count(*) AS size FROM c GROUP BY root ORDER BY size DESC, k_root LIMIT 9")
def single_linkage_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2 over the cut: the largest clusters by their smallest member."""
    k = single_linkage_cut(spark, sf_dir)
    roots = k.groupBy("k").agg(F.min("vec_id").alias("k_root"), F.count("*").alias("size"))
    return roots.orderBy(F.desc("size"), "k_root").limit(9).select("k_root", "size")


def _session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.lit("all").alias("session_id"), F.col("vec_id").alias("id"), V.doubles(F.col("embedding")).alias("features"))


#: How a merged cluster's distance follows from those of its parts (x, y: distances, a, b, s: sizes, h: their own distance).
_UPDATE = {
    "single": "least(dx, dy)", "complete": "greatest(dx, dy)", "average": "(a * dx + b * dy) / (a + b)", "weighted": "(dx + dy) / 2",
    "ward": "((a + s) * dx + (b + s) * dy - s * h) / (a + b + s)", "centroid": "(a * dx + b * dy) / (a + b) - a * b * h / ((a + b) * (a + b))", "median": "dx / 2 + dy / 2 - h / 4",
}


def _merges_sql(method: str, target: int = 12) -> str:
    """Common table expressions of a clustering: merges (s, i, j, h: slots are smallest members), tree (node, parent), labels after the cut."""
    squared = method in ("ward", "centroid", "median")
    order = "step" if method in ("centroid", "median") else "t[1], step"
    return f"""WITH RECURSIVE e AS MATERIALIZED (SELECT vec_id, label, (row_number() OVER (ORDER BY vec_id) - 1)::BIGINT AS i, embedding::DOUBLE[] AS v FROM embeddings),
  n AS (SELECT count(*) AS n FROM e), p AS MATERIALIZED (SELECT a.i AS i, b.i AS j, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.i < b.i), m AS (SELECT max(d) AS d FROM p),
  state(step, i, j, d, si, sj) AS (
    SELECT 0, p.i, p.j, {"(p.d / m.d) * (p.d / m.d)" if squared else "p.d / m.d"}, 1::DOUBLE, 1::DOUBLE FROM p, m UNION ALL
    (WITH best AS (SELECT i AS x, j AS y, d AS h, si AS a, sj AS b FROM state ORDER BY d, i, j LIMIT 1),
     near AS (SELECT CASE WHEN i IN (x, y) THEN j ELSE i END AS k, CASE WHEN i IN (x, y) THEN sj ELSE si END AS s, x, a, b, h, step,
       max(CASE WHEN i = x OR j = x THEN d END) AS dx, max(CASE WHEN i = y OR j = y THEN d END) AS dy FROM state, best WHERE (i IN (x, y)) <> (j IN (x, y)) GROUP BY ALL)
     SELECT step + 1, i, j, d, si, sj FROM state, best WHERE i NOT IN (x, y) AND j NOT IN (x, y)
     UNION ALL SELECT step + 1, least(x, k), greatest(x, k), {_UPDATE[method]}, CASE WHEN x < k THEN a + b ELSE s END, CASE WHEN x < k THEN s ELSE a + b END FROM near)),
  merges AS MATERIALIZED (SELECT row_number() OVER (ORDER BY {order}) - 1 AS s, t[2] AS i, t[3] AS j, {"sqrt(greatest(t[1], 0))" if squared else "t[1]"} AS h FROM (SELECT step, min((d, i, j)) AS t FROM state GROUP BY step)),
  tree AS MATERIALIZED (SELECT coalesce(n.n + lag(s) OVER (PARTITION BY slot ORDER BY s), slot) AS node, n.n + s AS parent, s, h FROM (SELECT s, h, unnest([i, j]) AS slot FROM merges), n),
  hung(slot, root) AS (SELECT i, i FROM e UNION ALL SELECT hung.slot, merges.i FROM hung JOIN merges ON merges.j = hung.root, n WHERE merges.s < n.n - {target}),
  labels AS (SELECT slot, dense_rank() OVER (ORDER BY root) - 1 AS k FROM (SELECT slot, min(root) AS root FROM hung GROUP BY slot)),
  up(leaf, node) AS (SELECT i, i FROM e WHERE label <> 0 UNION ALL SELECT leaf, tree.parent FROM up JOIN tree USING (node)),
  down(node, depth) AS (SELECT max(parent), 0 FROM tree UNION ALL SELECT tree.node, depth + 1 FROM down JOIN tree ON tree.parent = down.node),
  heights AS (SELECT DISTINCT parent AS node, h FROM tree)"""


def _method(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if name in hierarchy.METHODS:
            r, _ = hierarchy.clustered(_session(spark, sf_dir), name, threshold=0.0, target=12)
        else:
            r = linkage.assignments(_session(spark, sf_dir), name, threshold=0.0, target=12, order=False)
        return r.select(F.col("id").alias("vec_id"), "k", F.round("join_height", 5).alias("join_height"))

    run.__doc__ = f"G1-G4, J5 with {name} linkage, cut to twelve clusters."
    return run


for _m in linkage.METHODS:
    query(f"linkage_{_m}", f"{_merges_sql(_m)} SELECT vec_id, k, round(h, 5) AS join_height FROM e JOIN labels ON slot = i JOIN tree ON node = i")(_method(_m))


@query("dendrogram_merges", f"{_merges_sql('average')} SELECT s AS step, min(node) AS low, max(node) AS high, round(max(h), 5) AS height FROM tree GROUP BY s")
def dendrogram_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merges and the nodes that they join, free of their order."""
    m = hierarchy.dendrogram(_session(spark, sf_dir), "average")
    return m.select("step", F.col("left").alias("low"), F.col("right").alias("high"), F.round("height", 5).alias("height"))


@query("reciprocal_merges", f"{_merges_sql('complete')} SELECT s AS step, min(node) AS low, max(node) AS high, round(max(h), 5) AS height FROM tree GROUP BY s")
def reciprocal_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1, G2 by rounds of reciprocal neighbours down to a few clusters, as sessions of many items are merged."""
    m = hierarchy.dendrogram(_session(spark, sf_dir), "complete", few=200)
    return m.select("step", F.col("left").alias("low"), F.col("right").alias("high"), F.round("height", 5).alias("height"))


@query("single_linkage_merges", f"{_merges_sql('single')} SELECT s AS step, min(node) AS low, max(node) AS high, round(max(h), 5) AS height FROM tree GROUP BY s")
def single_linkage_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole tree of single linkage, contracted from spanning forests."""
    m = hierarchy.dendrogram(_session(spark, sf_dir), "single", most=300)
    return m.select("step", F.col("left").alias("low"), F.col("right").alias("high"), F.round("height", 5).alias("height"))


@query("leaf_angles", "SELECT vec_id, round((row_number() OVER (ORDER BY vec_id) - 0.5) * 2 * pi() / count(*) OVER (), 6) AS angle FROM embeddings")
def leaf_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1, G8."""
    i = selection.indexed(table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id")
    return i.crossJoin(F.broadcast(i.agg(F.count("*").alias("n")))).select("vec_id", F.round(display.leaf_angle(F.col("idx"), F.col("n")), 6).alias("angle"))


@query("ring_color_slots")
def ring_color_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of ring-neighbouring clusters."""
    return linkage.assignments(_session(spark, sf_dir), "average", 0.0, 25).select("k", "color_index").distinct()


@query("leaf_order")
def leaf_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by their place on the ring, and how often each represents a merge."""
    items, merges = linkage.clustered(_session(spark, sf_dir), "average", 0.0, 25)
    wins = topology.representative_wins(items.select("session_id", "idx"), merges)
    return items.join(wins, ["session_id", "idx"]).select(F.col("id").alias("vec_id"), F.round("leaf_angle", 5).alias("leaf_angle"), F.round("cluster_angle", 5).alias("cluster_angle"), "wins")


@query("dendrogram_topology", f"""{_merges_sql('average')} SELECT up.node, vec_id AS id, CASE WHEN up.node >= n.n THEN up.node - n.n END AS merge_index, count(*) AS visible_leaves, max(tree.parent) AS parent, max(depth) AS depth,
  round(coalesce(max(heights.h), 0), 5) AS height FROM up JOIN down USING (node) LEFT JOIN tree USING (node) LEFT JOIN heights USING (node) LEFT JOIN e ON e.i = up.node, n GROUP BY up.node, vec_id, n.n""")
def dendrogram_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible tree without items of label 0."""
    nodes = topology.topology(*_tree(spark, sf_dir))
    return nodes.select("node", "id", "merge_index", F.col("visible_leaves").cast("bigint").alias("visible_leaves"), "parent", "depth", F.round("height", 5).alias("height"))


def _tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items, merges = hierarchy.clustered(_session(spark, sf_dir), "average", 0.0, 25)
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    leaves = items.join(labels, "id").select("session_id", "idx", "id", (F.col("label") != 0).alias("visible"), "k", F.lit(None).cast("double").alias("cluster_angle"))
    return stored(leaves, "leaves"), merges


@query("dendrogram_ancestry", f"""{_merges_sql('average')} SELECT vec_id AS id, up.node, round(coalesce(heights.h, 0), 5) AS height, depth FROM up JOIN down USING (node) JOIN e ON e.i = up.leaf LEFT JOIN heights USING (node)""")
def dendrogram_ancestry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node above each visible item."""
    nodes = stored(topology.topology(*_tree(spark, sf_dir)), "nodes")
    ids = table(spark, sf_dir, "embeddings").select(F.lit("all").alias("session_id"), F.col("vec_id").alias("id"))
    return topology.ancestry(nodes, ids).select("id", "node", F.round("height", 5).alias("height"), "depth")
