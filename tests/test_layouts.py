import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnflow.operators import layouts, linkage, spatial, topology


@pytest.fixture(scope="module")
def nodes(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([("s", i, rng.normal(size=3).tolist()) for i in range(14)], "session_id string, id long, features array<double>")
    a = linkage.assignments(df, "average", 0.0, 4)
    leaves = a.select("session_id", "idx", "id", (~F.col("id").isin(3, 7)).alias("visible"), "k", "cluster_angle")
    merges = linkage.dendrogram(df, "average")
    return topology.topology(leaves, merges).cache(), leaves.cache(), merges.cache()


def test_topology(nodes):
    rows = {r.node: r for r in nodes[0].collect()}
    assert sorted(r.id for r in rows.values() if r.id is not None) == [i for i in range(14) if i not in (3, 7)]
    root = max(rows)
    assert rows[root].visible_leaves == 12 and (rows[root].first_place, rows[root].last_place) == (0, 11)
    for r in rows.values():
        if r.children:
            assert r.visible_leaves == sum(rows[c].visible_leaves for c in r.children)
            k = {rows[c].cluster_id for c in r.children}
            assert r.cluster_id == (k.pop() if len(k) == 1 else None)
    assert sum(r.wins or 0 for r in rows.values()) <= 13


def test_wins_and_join_heights(spark, nodes):
    _, leaves, merges = nodes
    assert topology.representative_wins(leaves, merges).agg(F.sum("wins")).first()[0] == 13
    n = spark.createDataFrame([("s", 14)], "session_id string, n int")
    assert topology.join_heights(merges, n).count() == 14


def test_ancestry_and_subtrees(spark, nodes):
    rows = {r.node: r for r in nodes[0].collect()}
    up = topology.ancestry(nodes[0], spark.createDataFrame([("s", 5)], "session_id string, id long")).collect()
    leaf = next(n for n, r in rows.items() if r.id == 5)
    want, at = [], leaf
    while at is not None:
        want.append(at)
        at = rows[at].parent
    assert [r.node for r in sorted(up, key=lambda r: -r.depth)] == want
    below = topology.subtree_leaves(nodes[0], spark.createDataFrame([("s", max(rows))], "session_id string, node int"))
    assert below.count() == 12


def test_trees(nodes):
    radial = {r.node: r for r in layouts.radial_tree(nodes[0]).collect()}
    flat = {r.node: r for r in layouts.horizontal_tree(nodes[0]).collect()}
    rows = {r.node: r for r in nodes[0].collect()}
    top = max(r.height for r in rows.values())
    for n, r in rows.items():
        if r.children:
            assert radial[n].angle == pytest.approx(np.mean([radial[c].angle for c in r.children]))
            assert radial[n].radius == pytest.approx(500 * (1 - r.height / top)) and flat[n].x == pytest.approx(1500 * (1 - r.height / top))
            assert flat[n].y == pytest.approx(np.mean([flat[c].y for c in r.children]))
        else:
            assert radial[n].angle == pytest.approx(-math.pi / 2 + 2 * math.pi * (r.first_place + 0.5) / 12)
            assert (flat[n].x, flat[n].y) == pytest.approx((1500, (r.first_place + 0.5) / 12 * 900))


def test_rectangles_tile_their_parents(nodes):
    cells = {r.node: r for r in layouts.rectangular_treemap(nodes[0]).collect()}
    rows = {r.node: r for r in nodes[0].collect()}
    weight = {}
    for n in sorted(rows):
        weight[n] = (rows[n].wins + 1) if not rows[n].children else sum(weight[c] for c in rows[n].children)
    area = lambda c: (c.x1 - c.x0) * (c.y1 - c.y0)
    for n, c in cells.items():
        assert area(c) == pytest.approx(1500 * 900 * weight[n] / weight[max(rows)])
    top = layouts.cluster_rectangles(layouts.rectangular_treemap(nodes[0]), nodes[0]).collect()
    assert len({r.cluster_id for r in top}) == len({r.cluster_id for r in rows.values() if r.cluster_id is not None})


def test_voronoi_areas():
    square = np.array([[0, 0], [1, 0], [1, 1], [0, 1]], float)
    weights = np.array([1.0, 2.0, 3.0, 4.0])
    cells = layouts.power_cells(square, weights, np.random.default_rng(1))
    areas = np.array([layouts.centroid(c)[1] for c in cells])
    assert areas.sum() == pytest.approx(1, abs=1e-6) and np.abs(areas - weights / 10).max() < 0.02


def test_voronoi_nesting(nodes):
    out = {r.node: r for r in layouts.voronoi_treemap(nodes[0]).withColumn("m", layouts.moments(F.col("polygon"))).collect()}
    rows = {r.node: r for r in nodes[0].collect()}
    weight = {r.node: r.weight for r in layouts.weights(nodes[0]).collect()}
    assert set(out) == set(rows)
    for n, r in rows.items():
        middle, area = layouts.centroid(np.array(out[n].polygon))
        assert (out[n].x, out[n].y, out[n].m.area) == pytest.approx((*middle, area))
        if r.children:
            assert sum(out[c].m.area for c in r.children) == pytest.approx(area)
            assert all(abs(out[c].m.area / area - weight[c] / weight[n]) <= 2 * layouts.VORONOI_RATIO for c in r.children)


def test_means_of_chains_and_bushes(spark):
    n = 40
    chain = [("c", n + s, [n + s - 1 if s else 0, s + 1], None) for s in range(n - 1)] + [("c", i, [], i) for i in range(n)]
    bush = [("b", 100, list(range(9)), None)] + [("b", i, [], i) for i in range(9)]
    nodes = spark.createDataFrame([r[:3] for r in chain + bush], "session_id string, node int, children array<int>")
    leaves = spark.createDataFrame([(s, v, float(x * x % 7)) for s, v, _, x in chain + bush if x is not None], "session_id string, node int, value double")
    got = {(r.session_id, r.node): r.value for r in layouts.child_means(nodes, leaves).collect()}
    kids = {(s, v): c for s, v, c, _ in chain + bush}
    want = {(r.session_id, r.node): r.value for r in leaves.collect()}
    for key in sorted(kids):
        if kids[key]:
            want[key] = sum(want[key[0], c] for c in kids[key]) / len(kids[key])
    assert got == pytest.approx(want)


def test_links(spark, nodes):
    links = layouts.edges(nodes[0], layouts.radial_tree(nodes[0]))
    assert links.count() == nodes[0].agg(F.sum(F.size("children"))).first()[0]
    for r in layouts.radial_links(links).collect():
        if r.kind == "elbow":
            assert (r.arc[-1].x, r.arc[-1].y) == pytest.approx((r.elbow.x, r.elbow.y))
    assert layouts.merge_dots(nodes[0], layouts.radial_tree(nodes[0])).count() <= 13
    at = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    points = spark.range(1).select(layouts.curve_points(at(0.0, 0.0), at(100.0, 50.0), F.lit(1.0)).alias("p")).first().p
    assert len(points) == math.ceil(math.sqrt(math.hypot(100, 50) / 0.25)) + 1
    assert (points[0].x, points[0].y, points[-1].x, points[-1].y) == pytest.approx((0, 0, 100, 50))


def test_scatter_of_a_constant_axis(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0)], "x double, y double")
    assert [(r.px, r.py) for r in layouts.scatter_plot(df).collect()] == [(0.0, 500.0), (1000.0, 500.0)]


def test_hit_testing(spark):
    rng = random.Random(1)
    points = [(i, rng.uniform(0, 300), rng.uniform(0, 300)) for i in range(200)]
    asked = [(i, rng.uniform(-10, 310), rng.uniform(-10, 310)) for i in range(60)]
    got = {r.pointer: r.key for r in spatial.nearest_within(spark.createDataFrame(asked, "pointer long, x double, y double"), spark.createDataFrame(points, "key long, x double, y double"), 25.0).collect()}
    want = {}
    for p, x, y in asked:
        near = min(((a - x) ** 2 + (b - y) ** 2, k) for k, a, b in points)
        if near[0] < 625:
            want[p] = near[1]
    assert got == want
    boxes = spark.createDataFrame([("img", 0.0, 0.0, 100.0, 100.0)], "key string, x0 double, y0 double, x1 double, y1 double")
    named = spark.createDataFrame([(f"p{k}", a, b) for k, a, b in points], "key string, x double, y double")
    dots = spark.createDataFrame([("d", 200.0, 200.0)], "key string, x double, y double")
    pointers = spark.createDataFrame([(1, 50.0, 50.0), (2, 200.0, 200.0)], "pointer long, x double, y double")
    assert {r.pointer: r.kind for r in spatial.pick(boxes, dots, named, pointers, 25.0).collect()} == {1: "image", 2: "dot"}
    squares = spark.createDataFrame([(k, [[k * 10.0, 0.0], [k * 10.0 + 10, 0.0], [k * 10.0 + 10, 10.0], [k * 10.0, 10.0]]) for k in range(3)], "id long, polygon array<array<double>>")
    where = spark.createDataFrame([(1, 5.0, 5.0), (2, 25.0, 1.0), (3, 50.0, 5.0)], "pointer long, x double, y double")
    assert {r.pointer: r.id for r in spatial.polygon_at(where, squares).collect()} == {1: 0, 2: 2}
    gaps = spark.range(1).select(spatial.gap_of(F.lit("radial-tree"), F.lit(False)), spatial.gap_of(F.lit("scatter-plot"), F.lit(True))).first()
    assert tuple(gaps) == (16, 60)


def test_nearest_of_dense_and_lonely_points(spark, monkeypatch):
    """Before, a pointer met every point of nine cells of the radius's size: here 6000 rows for each of 200 pointers."""
    monkeypatch.setattr(spatial, "FULL", 2)
    rng = np.random.default_rng(6)
    points = np.concatenate([rng.random((3000, 2)) * 40, np.repeat([[20.0, 20.0]], 3000, axis=0), [[90.0, 90.0], [130.0, 90.0]]])
    asked = np.concatenate([rng.random((197, 2)) * 40, [[20.0, 20.0], [110.0, 90.0], [300.0, 0.0]]])
    to = lambda rows, name: spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(rows)], f"{name} long, x double, y double")
    found = spatial.nearest_within(to(asked, "pointer"), to(points, "key"), 40.0)
    d2 = ((asked[:, None] - points[None]) ** 2).sum(axis=2)
    assert {r.pointer: r.key for r in found.collect()} == {k: int(r.argmin()) for k, r in enumerate(d2) if r.min() < 1600}


def test_equal_cells_are_tried_once(spark):
    """Before, every pointer met each of the copies of a cell: their numbers were multiplied."""
    pointers = spark.createDataFrame([(k, 5.0, 5.0) for k in range(50)] + [(50, 25.0, 5.0)], "pointer long, x double, y double")
    boxes = spark.range(100).selectExpr("id", "double(0) x0", "double(0) y0", "double(10) x1", "double(10) y1")
    polygons = boxes.selectExpr("id", "array(array(x0, y0), array(x1, y0), array(x1, y1), array(x0, y1)) polygon")
    for found in (spatial.cell_at(pointers, boxes), spatial.polygon_at(pointers, polygons)):
        assert {r.pointer: r.id for r in found.collect()} == dict.fromkeys(range(50), 0)
        assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 2  # of the cells, and of the answers
