"""Queries over layouts, thinning and hit-testing; points are orders, their place made of prices and keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnflow.functions import display
from cairnflow.operators import layouts, selection, spatial, topology
from cairnflow.plans.registry import query
from cairnflow.sources.store import stored
from cairnflow.sources.tables import table

_POINTS = "SELECT o_orderkey AS key, (o_orderkey * 7919 % 100003) / 100.003 AS x, (o_orderkey * 104729 % 100019) / 100.019 AS y FROM orders"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("key"), ((k * 7919 % 100003) / F.lit(100.003)).alias("x"), ((k * 104729 % 100019) / F.lit(100.019)).alias("y"))


def _bounds(low: float, high: float):
    return F.struct(F.lit(low).alias("min_x"), F.lit(high).alias("max_x"), F.lit(low).alias("min_y"), F.lit(high).alias("max_y"))


@query("viewport_filter", f"SELECT key FROM ({_POINTS}) WHERE x BETWEEN 100 - 48 AND 400 + 48 AND y BETWEEN 200 - 48 AND 500 + 48")
def viewport_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P18, L12."""
    box = F.struct(F.lit(100.0).alias("x"), F.lit(200.0).alias("y"), F.lit(300.0).alias("width"), F.lit(300.0).alias("height"))
    return _points(spark, sf_dir).where(display.inside(F.col("x"), F.col("y"), display.padded_bounds(box, F.lit(2.0)))).select("key")


_SYMLOG = "sign({0}) * ln(1 + abs({0}) / 1.25)"


@query("scatter_symlog", f"""WITH p AS (SELECT o_orderkey AS key, (o_totalprice - 150000) / 50000 AS x, (o_orderkey % 97 - 48) / 7.0::DOUBLE AS y FROM orders),
  s AS (SELECT key, {_SYMLOG.format('x')} AS sx, {_SYMLOG.format('y')} AS sy FROM p), e AS (SELECT min(sx) a, max(sx) b, min(sy) c, max(sy) d FROM s)
  SELECT key, round((sx - a) / (b - a) * 1000, 5) AS px, round(1000 - (sy - c) / (d - c) * 1000, 5) AS py FROM s, e""")
def scatter_symlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L5, F17, A12."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), ((F.col("o_totalprice") - 150000) / 50000).alias("x"), ((F.col("o_orderkey") % 97 - 48) / F.lit(7.0)).alias("y"))
    return layouts.scatter_plot(o).select("key", F.round("px", 5).alias("px"), F.round("py", 5).alias("py"))


@query("gridlines", f"WITH s AS (SELECT unnest(range(-6, 7)) AS sigma), v AS (SELECT sigma, {_SYMLOG.format('sigma')} AS t FROM s), e AS (SELECT {_SYMLOG.format('(-48 / 7.0::DOUBLE)')} AS a, {_SYMLOG.format('(48 / 7.0::DOUBLE)')} AS b) SELECT sigma::INT AS sigma, round((t - a) / (b - a) * 1000, 5) AS position FROM v, e")
def gridlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L5's lines of whole sigmas."""
    y = table(spark, sf_dir, "orders").select(((F.col("o_orderkey") % 97 - 48) / F.lit(7.0)).alias("y"))
    return layouts.gridlines(y, "y").select("sigma", F.round("position", 5).alias("position"))


_POLAR = f"""WITH p AS (SELECT key, sqrt((x - 500) * (x - 500) + (y - 500) * (y - 500)) AS r, fmod(atan2(y - 500, x - 500) + 2 * pi(), 2 * pi()) AS a FROM ({_POINTS}) WHERE x BETWEEN 50 AND 950 AND y BETWEEN 50 AND 950),
  b AS (SELECT *, floor(r / 32) AS ring, (floor(r / 32) + 0.5) * 32 AS c FROM p), n AS (SELECT *, greatest(1, floor(2 * pi() * c / 32 + 0.5)) AS n FROM b),
  s AS (SELECT *, floor(a / (2 * pi() / n)) % n AS slot FROM n),
  d AS (SELECT *, least(abs(a - (slot + 0.5) * 2 * pi() / n), 2 * pi() - abs(a - (slot + 0.5) * 2 * pi() / n)) / (2 * pi() / n) + abs(r - c) / 32 AS score FROM s)
  SELECT ring::BIGINT AS ring, slot::BIGINT AS slot, arg_min(key, (round(score, 9), key)) AS key FROM d GROUP BY ring, slot"""


@query("polar_thinning", _POLAR)
def polar_thinning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L9, A15."""
    return spatial.polar_thinning(_points(spark, sf_dir), _bounds(50.0, 950.0), 1.0, 32.0).select("ring", "slot", "key")


@query("hex_thinning", f"""WITH g AS (SELECT r, c, c * 34.64 + CASE WHEN r % 2 = 0 THEN 17.32 ELSE 0 END AS sx, r * 30.0 AS sy FROM (SELECT unnest(range(0, 36)) AS r), (SELECT unnest(range(-2, 32)) AS c)),
  d AS (SELECT r, c, key, x, y, (x - sx) * (x - sx) + (y - sy) * (y - sy) AS d2 FROM g JOIN ({_POINTS}) p ON x BETWEEN sx - 20 AND sx + 20 AND y BETWEEN sy - 20 AND sy + 20
  WHERE r >= floor(100 / 30.0) AND r <= ceil(900 / 30.0) AND c >= floor((100 - CASE WHEN r % 2 = 0 THEN 17.32 ELSE 0 END) / 34.64) AND c <= ceil((900 - CASE WHEN r % 2 = 0 THEN 17.32 ELSE 0 END) / 34.64)),
  m AS (SELECT r, c, arg_min(key, (d2, key)) AS key, arg_min(x, (d2, key)) AS x, arg_min(y, (d2, key)) AS y FROM d WHERE d2 < 400 GROUP BY r, c)
  SELECT DISTINCT key FROM m WHERE x BETWEEN 100 AND 900 AND y BETWEEN 100 AND 900""")
def hex_thinning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L10."""
    return spatial.hex_thinning(_points(spark, sf_dir), (100.0, 900.0, 100.0, 900.0), 1.0, 40.0)


@query("nearest_point", f"""WITH q AS (SELECT s_suppkey AS pointer, (s_suppkey * 6151 % 9973) / 9.973 AS px, (s_suppkey * 3571 % 9967) / 9.967 AS py FROM supplier)
  SELECT pointer, arg_min(key, ((x - px) * (x - px) + (y - py) * (y - py), key)) AS key FROM q JOIN ({_POINTS}) p ON x BETWEEN px - 40 AND px + 40 AND y BETWEEN py - 40 AND py + 40
  WHERE (x - px) * (x - px) + (y - py) * (y - py) < 1600 GROUP BY pointer""")
def nearest_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J11."""
    k = F.col("s_suppkey")
    q = table(spark, sf_dir, "supplier").select(k.alias("pointer"), ((k * 6151 % 9973) / F.lit(9.973)).alias("x"), ((k * 3571 % 9967) / F.lit(9.967)).alias("y"))
    return spatial.nearest_within(q, _points(spark, sf_dir), 40.0).select("pointer", "key")


@query("cell_lookup", """WITH q AS (SELECT s_suppkey AS pointer, (s_suppkey * 6151 % 9973) / 9.973 AS x, (s_suppkey * 3571 % 9967) / 9.967 AS y FROM supplier),
  c AS (SELECT p_partkey AS id, p_partkey % 50 * 20.0 AS x0, p_partkey % 50 * 20.0 + 20 AS x1, p_size * 20.0 AS y0, p_size * 20.0 + 15 AS y1 FROM part)
  SELECT pointer, min(id) AS id FROM q JOIN c ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY pointer""")
def cell_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J13."""
    k, x0, y0 = F.col("s_suppkey"), F.col("p_partkey") % 50 * 20.0, F.col("p_size") * 20.0
    q = table(spark, sf_dir, "supplier").select(k.alias("pointer"), ((k * 6151 % 9973) / F.lit(9.973)).alias("x"), ((k * 3571 % 9967) / F.lit(9.967)).alias("y"))
    cells = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), x0.alias("x0"), (x0 + 20).alias("x1"), y0.alias("y0"), (y0 + 15).alias("y1"))
    return spatial.cell_at(q, cells)


@query("zoomed_view", "SELECT p_partkey, round(p_size - (p_size - 10.0) * w / 100, 6) AS x, round(w, 6) AS width FROM (SELECT p_partkey, p_size, least(greatest(100 * p_size / 20.0, 10), 3000)::DOUBLE AS w FROM part)")
def zoomed_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F24."""
    box = F.struct(F.lit(10.0).alias("x"), F.lit(0.0).alias("y"), F.lit(100.0).alias("width"), F.lit(50.0).alias("height"))
    z = display.zoomed(box, F.col("p_size").cast("double"), F.lit(0.0), F.col("p_size") / 20.0)
    return table(spark, sf_dir, "part").select("p_partkey", z.alias("z")).select("p_partkey", F.round("z.x", 6).alias("x"), F.round("z.width", 6).alias("width"))


@query("cluster_colours", "SELECT p_partkey, round(p_size * 0.1 + 0.1 * (p_partkey % 6 - p_size * 0.1), 6) AS angle FROM part")
def cluster_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F14."""
    return table(spark, sf_dir, "part").select("p_partkey", F.round(display.colour_angle(F.col("p_size") * 0.1, F.col("p_partkey") % 6), 6).alias("angle"))


_LEAVES = "SELECT p_type AS kind, p_brand AS brand, p_type || '|' || p_brand || '|' || lpad(p_size::VARCHAR, 3, '0') AS key, count(*) AS n FROM part GROUP BY ALL"
_TREE = f"""leaf AS (SELECT *, row_number() OVER (ORDER BY key) - 1 AS place, count(*) OVER () AS total FROM ({_LEAVES})),
  brand AS (SELECT kind, brand, min(place) AS first, max(place) AS last, max(total) + row_number() OVER (ORDER BY min(place)) - 1 AS node FROM leaf GROUP BY kind, brand),
  kind AS (SELECT kind, min(first) AS first, max(last) AS last, (SELECT max(node) FROM brand) + row_number() OVER (ORDER BY min(first)) AS node FROM brand GROUP BY kind),
  root AS (SELECT max(node) + 1 AS node FROM kind)"""


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree as ``topology`` gives it: types, their brands, and of these the sizes, which are leaves that weigh their parts.

    Its size follows from the catalog's vocabulary, not from the number of parts.
    """
    p = table(spark, sf_dir, "part").select(F.col("p_type").alias("kind"), F.col("p_brand").alias("brand"), F.concat_ws("|", "p_type", "p_brand", F.lpad(F.col("p_size").cast("string"), 3, "0")).alias("key"))
    leaf = stored(selection.indexed(p.groupBy("kind", "brand", "key").agg(F.count("*").alias("n")), "key", "first"), "leaves").withColumns({"last": F.col("first"), "height": F.lit(0.0)})
    levels, below, offset = [], leaf.withColumn("node", F.col("first")), leaf.count()
    for depth, by in enumerate((["kind", "brand"], ["kind"], [])):
        up = below.groupBy(*by).agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sort_array(F.collect_list("node")).alias("children"), F.sum("n").alias("n"))
        up = stored(selection.indexed(up, "first", "rank"), "level").withColumns({"node": F.col("rank") + offset, "height": F.lit(depth + 1.0)}).drop("rank")
        parent = up.select(F.explode("children").alias("node"), F.col("node").alias("parent"))
        levels.append(below.join(parent, "node", "left").withColumn("depth", F.lit(3 - depth)))
        below, offset = up, offset + up.count()
    levels.append(below.withColumns({"parent": F.lit(None).cast("long"), "depth": F.lit(0)}))
    whole = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), levels)
    children = F.coalesce("children", F.array().cast("array<bigint>")).cast("array<int>")
    is_leaf = F.size(children) == 0
    return stored(whole.select(
        F.lit("all").alias("session_id"), F.col("node").cast("int"), F.when(is_leaf, F.col("node")).alias("id"), children.alias("children"), F.col("parent").cast("int"), (F.col("n") - 1).cast("int").alias("wins"), "height", "depth",
        F.col("first").cast("int").alias("first_place"), F.col("last").cast("int").alias("last_place"), F.when(~is_leaf, F.col("node")).cast("int").alias("merge_index"), F.col("first").cast("int").alias("representative"), "kind"), "nodes")


def _layout(name: str, f, angle: str, x: str, y: str):
    """``angle``: of a leaf by its place; ``x`` and ``y``: from the mean angle a and the level l."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(_catalog(spark, sf_dir)).select("node", "id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))

    run.__doc__ = f.__doc__
    query(name, f"""WITH {_TREE}, a0 AS (SELECT kind, brand, place AS node, place AS id, {angle} AS a, 1.0 AS l FROM leaf), a1 AS (SELECT kind, brand, b.node, avg(a) AS a, 2 / 3.0::DOUBLE AS l FROM a0 JOIN brand b USING (kind, brand) GROUP BY ALL),
      a2 AS (SELECT kind, k.node, avg(a) AS a, 1 / 3.0::DOUBLE AS l FROM a1 JOIN kind k USING (kind) GROUP BY ALL), a3 AS (SELECT root.node, avg(a) AS a, 0.0 AS l FROM a2, root GROUP BY ALL),
      whole AS (SELECT node, id, a, l FROM a0 UNION ALL SELECT node, NULL, a, l FROM a1 UNION ALL SELECT node, NULL, a, l FROM a2 UNION ALL SELECT node, NULL, a, l FROM a3)
      SELECT node, id, round({x}, 4) AS x, round({y}, 4) AS y FROM whole""")(run)


_layout("radial_tree", layouts.radial_tree, "-pi() / 2 + 2 * pi() * (place + 0.5) / total", "500 + 500 * l * cos(a)", "500 + 500 * l * sin(a)")
_layout("horizontal_tree", layouts.horizontal_tree, "(place + 0.5) / total * 900", "1500 * l", "a")


@query("radial_positions", "SELECT vec_id, round(500 + 500 * cos(a), 5) AS x, round(500 + 500 * sin(a), 5) AS y FROM (SELECT vec_id, -pi() / 2 + 2 * pi() * (row_number() OVER (ORDER BY vec_id) - 0.5) / count(*) OVER () AS a FROM embeddings)")
def radial_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1 of a forest without merges: the items of one session round the circle."""
    i = selection.indexed(table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id")
    place = F.col("idx").cast("int")
    nodes = i.select(F.lit("all").alias("session_id"), place.alias("node"), F.col("vec_id").alias("id"), F.array().cast("array<int>").alias("children"), F.lit(0.0).alias("height"), place.alias("first_place"))
    return layouts.radial_tree(nodes).select(F.col("id").alias("vec_id"), F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


_ROLLED = f"""{_TREE}, rolled AS (SELECT place AS node, place AS first, b.node AS parent, n FROM leaf JOIN brand b USING (kind, brand) UNION ALL
    SELECT b.node, min(b.first), max(k.node), sum(n) FROM leaf JOIN brand b USING (kind, brand) JOIN kind k USING (kind) GROUP BY ALL UNION ALL
    SELECT k.node, min(k.first), max(root.node), sum(n) FROM leaf JOIN kind k USING (kind), root GROUP BY ALL UNION ALL SELECT root.node, 0, NULL, sum(n) FROM leaf, root GROUP BY ALL)"""


@query("rectangular_treemap", f"""WITH RECURSIVE {_ROLLED},
  ranked AS MATERIALIZED (SELECT node, parent, n, row_number() OVER (PARTITION BY parent ORDER BY first) - 1 AS i, sum(n) OVER (PARTITION BY parent ORDER BY first) AS until, count(*) OVER (PARTITION BY parent) AS many FROM rolled),
  cells(parent, i, j, x0, y0, x1, y1) AS (
    SELECT -1::BIGINT, 0::BIGINT, 1::BIGINT, 0::DOUBLE, 0::DOUBLE, 1500::DOUBLE, 900::DOUBLE UNION ALL
    (WITH wide AS (SELECT c.parent, c.i, c.j, x0, y0, x1, y1, sum(CASE WHEN r.i = c.i - 1 THEN r.until ELSE 0 END) AS a, sum(CASE WHEN r.i = c.j - 1 THEN r.until ELSE 0 END) AS b FROM cells c JOIN ranked r ON r.parent = c.parent WHERE c.j - c.i > 1 GROUP BY ALL),
     half AS (SELECT w.*, min(CASE WHEN r.i >= w.i AND r.until >= a + (b - a) / 2 THEN r.i END) AS m FROM wide w JOIN ranked r ON r.parent = w.parent AND r.i < w.j GROUP BY ALL),
     cut AS (SELECT * EXCLUDE m, greatest(least(coalesce(m, j) + 1, j - 1), i + 1) AS k FROM half),
     near AS (SELECT c.* EXCLUDE k, CASE WHEN c.i + 1 < k AND a + (b - a) / 2 - p.until < q.until - a - (b - a) / 2 THEN k - 1 ELSE k END AS k FROM cut c JOIN ranked p ON p.parent = c.parent AND p.i = k - 2 + CASE WHEN k = 1 THEN 1 ELSE 0 END JOIN ranked q ON q.parent = c.parent AND q.i = k - 1),
     done AS (SELECT n.*, (r.until - a) AS l, x1 - x0 > y1 - y0 AS across FROM near n JOIN ranked r ON r.parent = n.parent AND r.i = k - 1),
     halves AS (SELECT *, CASE WHEN across THEN (x0 * (b - a - l) + x1 * l) / (b - a) ELSE (y0 * (b - a - l) + y1 * l) / (b - a) END AS c FROM done)
     SELECT parent, i, k, x0, y0, CASE WHEN across THEN c ELSE x1 END, CASE WHEN across THEN y1 ELSE c END FROM halves UNION ALL
     SELECT parent, k, j, CASE WHEN across THEN c ELSE x0 END, CASE WHEN across THEN y0 ELSE c END, x1, y1 FROM halves UNION ALL
     SELECT r.node, 0, (SELECT count(*) FROM rolled u WHERE u.parent = r.node), x0, y0, x1, y1 FROM cells c JOIN ranked r ON coalesce(r.parent, -1) = c.parent AND r.i = c.i WHERE c.j - c.i = 1 AND EXISTS (SELECT 1 FROM rolled u WHERE u.parent = r.node)))
  SELECT node, round(x0, 4) AS x0, round(y0, 4) AS y0, round(x1, 4) AS x1, round(y1, 4) AS y1 FROM cells c JOIN ranked r ON coalesce(r.parent, -1) = c.parent AND r.i = c.i WHERE c.j - c.i = 1""")
def rectangular_treemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3: the corners of every cell."""
    cells = layouts.rectangular_treemap(_catalog(spark, sf_dir))
    return cells.select("node", *(F.round(c, 4).alias(c) for c in ("x0", "y0", "x1", "y1")))


@query("voronoi_treemap", f"WITH {_ROLLED} SELECT node, n::DOUBLE AS weight, true AS fits, true AS tiled FROM rolled")
def voronoi_treemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L4: whether every cell has its share of its parent's area, and what its children have adds up to its own."""
    nodes = _catalog(spark, sf_dir)
    sized = stored(layouts.voronoi_treemap(nodes).select("node", layouts.moments(F.col("polygon"))["area"].alias("area")), "cells")
    whole = layouts.weights(nodes).select("node", "weight").join(sized, "node").join(nodes.select("node", "parent"), "node")
    above = whole.select(F.col("node").alias("parent"), F.col("area").alias("_area"), F.col("weight").alias("_weight"))
    below = whole.groupBy(F.col("parent").alias("node")).agg(F.sum("area").alias("_sum"))
    each = whole.join(above, "parent", "left").join(below, "node", "left")
    fits = F.abs(F.col("area") / F.col("_area") - F.col("weight") / F.col("_weight")) <= 2 * layouts.VORONOI_RATIO
    tiled = F.abs(F.col("_sum") / F.col("area") - 1) <= 1e-6
    return each.select("node", "weight", F.coalesce(fits, F.lit(True)).alias("fits"), F.coalesce(tiled, F.lit(True)).alias("tiled"))


@query("tree_links", f"""WITH {_TREE}, a0 AS (SELECT kind, brand, place AS child, -pi() / 2 + 2 * pi() * (place + 0.5) / total AS c FROM leaf), a1 AS (SELECT kind, brand, avg(c) AS p, count(*) AS many FROM a0 GROUP BY kind, brand),
  links AS (SELECT child, b.node AS parent, c, p, 1000 / 6.0 * 2 AS r, many FROM a0 JOIN a1 USING (kind, brand) JOIN brand b USING (kind, brand))
  SELECT child, parent, CASE WHEN many = 1 THEN 'straight' ELSE 'elbow' END AS kind, CASE WHEN many > 1 THEN round(500 + r * cos(c), 4) END AS elbow_x, CASE WHEN many > 1 THEN round(500 + r * sin(c), 4) END AS elbow_y,
    CASE WHEN many > 1 THEN greatest(1, ceil(abs(c - p) * r / 3))::INT END AS n_points,
    CASE WHEN many > 1 THEN round(500 + r * cos(p + (c - p) / greatest(1, ceil(abs(c - p) * r / 3))), 4) END AS first_x, CASE WHEN many > 1 THEN round(500 + r * sin(c), 4) END AS last_y FROM links""")
def tree_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links from parents to leaves: their kind, the elbow, and the arc from the parent's angle to the child's."""
    nodes = _catalog(spark, sf_dir)
    links = layouts.radial_links(layouts.edges(nodes, layouts.radial_tree(nodes)))
    ends = {"elbow_x": F.col("elbow.x"), "elbow_y": F.col("elbow.y"), "first_x": F.element_at("arc.x", 1), "last_y": F.element_at("arc.y", -1)}
    return links.join(nodes.where("id is not null").select(F.col("node").alias("child")), "child").select("child", "parent", "kind", F.when(F.col("arc").isNotNull(), F.size("arc")).alias("n_points"), *(F.round(v, 4).alias(c) for c, v in ends.items()))


@query("subtree_leaves", f"WITH {_TREE} SELECT k.node AS root, place AS node FROM leaf JOIN kind k USING (kind)")
def subtree_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaves below every type."""
    nodes = _catalog(spark, sf_dir)
    return topology.subtree_leaves(nodes, nodes.where("height = 2").select("session_id", "node")).select("root", "node")


@query("merge_dots", f"WITH {_TREE} SELECT node FROM brand UNION ALL SELECT node FROM kind UNION ALL SELECT node FROM root")
def merge_dots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner nodes whose representative is a visible leaf."""
    nodes = _catalog(spark, sf_dir)
    return layouts.merge_dots(nodes, layouts.radial_tree(nodes)).select("node")
