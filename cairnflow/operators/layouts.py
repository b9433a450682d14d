"""Positions of tree nodes and points: radial and horizontal trees, treemaps, scatter plots, edges."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnflow.functions import display
from cairnflow.operators.selection import running_total
from cairnflow.sources.store import discard, stored

#: Fixed sizes of the graph: the square of radial layouts, and the rectangle of the others.
SIZE, WIDTH, HEIGHT = 1000.0, 1500.0, 900.0
#: Rounds and tolerance of the weighted Voronoi cells.
VORONOI_SIDES, VORONOI_ROUNDS, VORONOI_RATIO, VORONOI_SEED = 128, 100, 0.005, 42


def child_means(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """(session_id, node, value) of every node: a leaf's own, else the mean of the children's. ``leaves``: session_id, node, value.

    The tree is contracted: a node with one child left to find is a linear function of it, and such functions are put into
    each other by doubling, so a chain of any length takes as many rounds as its length has bits.
    """
    known = stored(leaves.select("session_id", "node", "value"), "known")
    links = stored(nodes.select("session_id", "node", F.size("children").alias("k"), F.explode("children").alias("child")), "links")
    linear = known.select("session_id", "node", F.col("node").alias("on"), F.col("value").alias("p"), F.col("value").alias("q")).limit(0)
    while True:
        at = known.select("session_id", F.col("node").alias("child"), "value")
        state = links.join(at, ["session_id", "child"], "left").groupBy("session_id", "node").agg(
            (F.coalesce(F.sum("value"), F.lit(0.0)) / F.first("k")).alias("q"), F.count_if(F.col("value").isNull()).alias("open"), F.max(F.when(F.col("value").isNull(), F.col("child"))).alias("on"), (F.lit(1.0) / F.first("k")).alias("p"))
        state = stored(state, "state")
        every = linear.unionByName(state.where("open = 1").select("session_id", "node", "on", "p", "q"))
        on = known.select("session_id", F.col("node").alias("on"), "value")
        after = every.select("session_id", F.col("node").alias("on"), F.col("on").alias("_on"), F.col("p").alias("_p"), F.col("q").alias("_q"))
        step = every.join(on, ["session_id", "on"], "left").join(after, ["session_id", "on"], "left")
        step = stored(step.select("session_id", "node", F.coalesce("_on", "on").alias("on"), (F.col("p") * F.coalesce("_p", F.lit(1.0))).alias("p"), (F.col("q") + F.col("p") * F.coalesce("_q", F.lit(0.0))).alias("q"), (F.col("p") * F.col("value") + F.col("q")).alias("value")), "linear")
        found = state.where("open = 0").select("session_id", "node", F.col("q").alias("value")).union(step.where("value is not null").select("session_id", "node", "value"))
        before, known = known, stored(known.union(found), "known")
        links = links.join(state.where("open < 2").select("session_id", "node"), ["session_id", "node"], "left_anti")
        linear = step.where("value is null").select("session_id", "node", "on", "p", "q")
        discard(before)
        if not (links.limit(1).count() or linear.limit(1).count()):
            return known
        links = stored(links, "links")


def _placed(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(session_id, node, id, share, level): how far from the top of the tree; and the leaves with their share of the way round."""
    whole = nodes.groupBy("session_id").agg(F.count_if(F.col("id").isNotNull()).alias("_total"), F.max("height").alias("_most"))
    known = nodes.join(whole, "session_id")
    level = F.when(F.size("children") == 0, 1.0).when(F.col("_most") <= 0, 0.0).otherwise(1 - F.col("height") / F.col("_most"))
    leaves = known.where("id is not null").select("session_id", "node", ((F.col("first_place") + 0.5) / F.col("_total")).alias("value"))
    return known.select("session_id", "node", "id", level.alias("level")), leaves


def radial_tree(nodes: DataFrame) -> DataFrame:
    """L1: leaves evenly round a circle in their order, inner nodes at the mean of their children's angles, nearer the centre the higher."""
    known, leaves = _placed(nodes)
    at = child_means(nodes, leaves.withColumn("value", F.col("value") * 2 * math.pi - math.pi / 2)).withColumnRenamed("value", "angle")
    out = known.join(at, ["session_id", "node"]).withColumn("radius", F.col("level") * SIZE / 2)
    return out.select("session_id", "node", "id", "angle", "radius", (F.col("radius") * F.cos("angle") + SIZE / 2).alias("x"), (F.col("radius") * F.sin("angle") + SIZE / 2).alias("y"))


def horizontal_tree(nodes: DataFrame) -> DataFrame:
    """L2: leaves at the right edge in their order, inner nodes at the mean of their children, to the left the higher."""
    known, leaves = _placed(nodes)
    at = child_means(nodes, leaves.withColumn("value", F.col("value") * HEIGHT)).withColumnRenamed("value", "y")
    none = F.lit(None).cast("double")
    return known.join(at, ["session_id", "node"]).select("session_id", "node", "id", none.alias("angle"), none.alias("radius"), (F.col("level") * WIDTH).alias("x"), "y")


def weights(nodes: DataFrame) -> DataFrame:
    """(session_id, node, weight): a leaf weighs its wins and one, a node what its leaves weigh: sums over their places."""
    one = nodes.where("id is not null").select("session_id", F.col("first_place").alias("place"), (F.col("wins") + 1).cast("long").alias("own"))
    until = stored(running_total(one, [F.col("session_id"), F.col("place")], F.col("own"), "until"), "until")
    first = until.select("session_id", F.col("place").alias("first_place"), (F.col("until") - F.col("own")).alias("_before"))
    last = until.select("session_id", F.col("place").alias("last_place"), F.col("until").alias("_until"))
    both = nodes.select("session_id", "node", "first_place", "last_place").join(first, ["session_id", "first_place"]).join(last, ["session_id", "last_place"])
    return both.select("session_id", "node", (F.col("_until") - F.col("_before")).cast("double").alias("weight"))


def _down(nodes: DataFrame, whole: list, cut) -> DataFrame:
    """(session_id, node, shape) of every node, from the roots down: a level's shapes are handed to its children, and each set of
    siblings cuts that of its parent in a group of its own. ``cut``: shapes of siblings from parent's shape, weights and parent's number."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("at")
        shapes = cut(group.column("shape")[0].as_py(), group.column("weight").to_numpy(), group.column("parent")[0].as_py())
        return pa.table({"session_id": group.column("session_id"), "node": group.column("node"), "shape": pa.array(shapes, kind)})

    deep = isinstance(whole[0], list)
    kind = pa.list_(pa.list_(pa.float64())) if deep else pa.list_(pa.float64())
    sql = "array<array<double>>" if deep else "array<double>"
    place = nodes.select("session_id", F.col("node").alias("parent"), F.posexplode("children").alias("at", "node"))
    known = nodes.select("session_id", "node", "depth").join(place, ["session_id", "node"], "left").join(weights(nodes), ["session_id", "node"])
    known = stored(known.withColumns({"parent": F.coalesce("parent", F.lit(-1)), "at": F.when(F.col("parent").isNull(), F.col("node")).otherwise(F.col("at"))}), "siblings")
    levels = known.agg(F.max("depth")).first()[0]
    top = F.array(*(F.array(*map(F.lit, p)) for p in whole)) if deep else F.array(*map(F.lit, whole))
    above, out = known.select("session_id").distinct().select("session_id", F.lit(-1).alias("parent"), top.alias("shape")), []
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for depth in range((levels if levels is not None else -1) + 1):
        level = known.where(F.col("depth") == depth).join(above, ["session_id", "parent"]).repartition(parts, "session_id", "parent")  # rows are few, but their work is not
        out.append(stored(level.groupBy("session_id", "parent").applyInArrow(run, f"session_id string, node int, shape {sql}"), "level"))
        above = out[-1].select("session_id", F.col("node").alias("parent"), "shape")
    empty = above.select("session_id", F.col("parent").cast("int").alias("node"), "shape").limit(0)
    return reduce(DataFrame.union, out, empty)


def _split(weights: list[float], i: int, j: int, box: tuple, out: dict) -> None:
    """Cuts a box among items i..j-1: where their weight is halved, across the longer side."""
    stack = [(i, j, box)]
    until = np.concatenate([[0.0], np.cumsum(weights)])
    while stack:
        i, j, (x0, y0, x1, y1) = stack.pop()
        if j - i == 1:
            out[i] = (x0, y0, x1, y1)
            continue
        total = until[j] - until[i]
        half = until[i] + total / 2
        k = int(np.searchsorted(until[i + 1 : j], half, "left")) + i + 1
        k = min(max(k, i + 1), j - 1)
        if half - until[k - 1] < until[k] - half and i + 1 < k:
            k -= 1
        left = until[k] - until[i]
        if x1 - x0 > y1 - y0:
            cut = (x0 * (total - left) + x1 * left) / total if total else x1
            stack += [(i, k, (x0, y0, cut, y1)), (k, j, (cut, y0, x1, y1))]
        else:
            cut = (y0 * (total - left) + y1 * left) / total if total else y1
            stack += [(i, k, (x0, y0, x1, cut)), (k, j, (x0, cut, x1, y1))]


def _rectangles(box: list[float], weight: np.ndarray, parent: int) -> list[list[float]]:
    cells: dict[int, tuple] = {}
    _split(weight.tolist(), 0, len(weight), tuple(box), cells)
    return [list(map(float, cells[i])) for i in range(len(weight))]


def rectangular_treemap(nodes: DataFrame) -> DataFrame:
    """L3: cells of all nodes, a leaf weighing its wins and one; positions are centres."""
    cells = _down(nodes, [0.0, 0.0, WIDTH, HEIGHT], _rectangles)
    corners = [F.col("shape")[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))]
    found = nodes.select("session_id", "node", "id").join(cells, ["session_id", "node"]).select("session_id", "node", "id", *corners)
    return found.withColumns({"x": (F.col("x0") + F.col("x1")) / 2, "y": (F.col("y0") + F.col("y1")) / 2})


def cluster_rectangles(cells: DataFrame, nodes: DataFrame) -> DataFrame:
    """L3: the cells of the topmost node of every cluster."""
    known = nodes.where("cluster_id is not null")
    above = nodes.select("session_id", F.col("node").alias("parent"), F.col("cluster_id").alias("_above"))
    top = known.join(above, ["session_id", "parent"], "left").where(~F.col("cluster_id").eqNullSafe(F.col("_above"))).select("session_id", "node", "cluster_id", "color_angle")
    return cells.join(top, ["session_id", "node"])


def boundaries(cells: DataFrame, nodes: DataFrame) -> DataFrame:
    """L3: (session_id, node, merge_index, color_angle, x1, y1, x2, y2): the line between the two cells of every merge with two visible children."""
    at = cells.select("session_id", "node", F.struct("x0", "y0", "x1", "y1").alias("box"))
    pair = nodes.where("merge_index is not null and size(children) = 2").select("session_id", "node", "merge_index", "color_angle", F.col("children")[0].alias("a"), F.col("children")[1].alias("b"))
    both = pair.join(at.withColumnsRenamed({"node": "a", "box": "p"}), ["session_id", "a"]).join(at.withColumnsRenamed({"node": "b", "box": "q"}), ["session_id", "b"])
    beside = (F.col("p.x1") == F.col("q.x0")) | (F.col("q.x1") == F.col("p.x0"))
    x, y = (F.when(F.col(f"p.{c}1") == F.col(f"q.{c}0"), F.col(f"p.{c}1")).otherwise(F.col(f"q.{c}1")) for c in "xy")
    low, high = (lambda c: F.greatest(f"p.{c}0", f"q.{c}0")), (lambda c: F.least(f"p.{c}1", f"q.{c}1"))
    ends = (F.when(beside, x).otherwise(low("x")), F.when(beside, low("y")).otherwise(y), F.when(beside, x).otherwise(high("x")), F.when(beside, high("y")).otherwise(y))
    return both.select("session_id", "node", "merge_index", "color_angle", *(e.alias(n) for e, n in zip(ends, ("x1", "y1", "x2", "y2"), strict=True)))


def shared_edge(first: np.ndarray, second: np.ndarray, eps: float = 1e-7) -> np.ndarray | None:
    """L4: the longest segment (two points) that edges of two convex polygons have in common, None if there is none."""
    best, length = None, eps
    for a, b in zip(first, np.roll(first, -1, axis=0), strict=True):
        along = b - a
        size = float(np.hypot(*along))
        if size <= eps:
            continue
        unit = along / size
        for c, d in zip(second, np.roll(second, -1, axis=0), strict=True):
            off = [abs(unit[0] * (p - a)[1] - unit[1] * (p - a)[0]) for p in (c, d)]
            if max(off) > max(eps, eps * size):
                continue
            s, t = sorted((float((c - a) @ unit), float((d - a) @ unit)))
            lo, hi = max(0.0, s), min(size, t)
            if hi - lo > length:
                best, length = np.array([a + unit * lo, a + unit * hi]), hi - lo
    return best


def voronoi_boundaries(cells: DataFrame, nodes: DataFrame) -> DataFrame:
    """L4: (session_id, node, segment) of every coloured merge with two visible children whose cells share an edge."""
    at = cells.select("session_id", "node", "polygon")
    pair = nodes.where("merge_index is not null and color_angle is not null and size(children) = 2").select("session_id", "node", F.col("children")[0].alias("a"), F.col("children")[1].alias("b"))
    both = pair.join(at.withColumnsRenamed({"node": "a", "polygon": "p"}), ["session_id", "a"]).join(at.withColumnsRenamed({"node": "b", "polygon": "q"}), ["session_id", "b"])

    @F.pandas_udf("array<array<double>>")
    def segment(p: pd.Series, q: pd.Series) -> pd.Series:
        points = lambda x: np.stack([np.asarray(v, dtype=float) for v in x])
        found = [shared_edge(points(x), points(y)) for x, y in zip(p, q, strict=True)]
        return pd.Series([None if s is None else s.tolist() for s in found], dtype=object)

    return both.select("session_id", "node", segment("p", "q").alias("segment")).where("segment is not null")


def clip(polygon: list[tuple], a: float, b: float, c: float) -> list[tuple]:
    """The part of a convex polygon where a x + b y <= c."""
    out = []
    side = [a * x + b * y - c for x, y in polygon]
    for i, (x, y) in enumerate(polygon):
        before = side[i - 1]
        if before * side[i] < 0:
            u, v = polygon[i - 1]
            t = before / (before - side[i])
            out.append((u + (x - u) * t, v + (y - v) * t))
        if side[i] <= 0:
            out.append((x, y))
    return out


def _moments(polygon: list[tuple]) -> tuple[float, float, float]:
    """Centre and area of a polygon."""
    area = cx = cy = 0.0
    u, v = polygon[-1]
    for x, y in polygon:
        cross = u * y - x * v
        area += cross
        cx += (u + x) * cross
        cy += (v + y) * cross
        u, v = x, y
    if abs(area) < 2e-12:
        return sum(x for x, _ in polygon) / len(polygon), sum(y for _, y in polygon) / len(polygon), 0.0
    return cx / (3 * area), cy / (3 * area), abs(area) / 2


def centroid(polygon: np.ndarray) -> tuple[np.ndarray, float]:
    """Centre of mass and area of a polygon."""
    x, y = polygon.T
    cross = x * np.roll(y, -1) - np.roll(x, -1) * y
    area = cross.sum() / 2
    if abs(area) < 1e-12:
        return polygon.mean(axis=0), 0.0
    return np.array([((x + np.roll(x, -1)) * cross).sum(), ((y + np.roll(y, -1)) * cross).sum()]) / (6 * area), abs(area)


def power_cells(polygon: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    """L4: cells of a convex polygon with areas in proportion to the weights (power diagram, moved to centroids round by round)."""
    n = len(weight)
    whole = [tuple(map(float, p)) for p in polygon]
    if n == 1:
        return [np.array(whole)]
    share = (weight / weight.sum()).tolist()
    mx, my, area = _moments(whole)
    wide, high = (max(abs(p[k] - m) for p in whole) for k, m in ((0, mx), (1, my)))
    sites = [(mx + (a - 0.5) * wide, my + (b - 0.5) * high) for a, b in rng.random((n, 2)).tolist()]
    power = [0.0] * n
    best, least = [], math.inf
    for _ in range(VORONOI_ROUNDS):
        cells = []
        for i, (x, y) in enumerate(sites):
            near = sorted(((u - x) ** 2 + (v - y) ** 2 - power[j], j) for j, (u, v) in enumerate(sites) if j != i)
            cell, reach = whole, math.inf
            for gap, j in near:
                u, v = sites[j]
                if gap + power[i] >= 2 * reach * math.hypot(u - x, v - y):  # the line lies beyond the cell's farthest corner
                    continue
                cell = clip(cell, 2 * (u - x), 2 * (v - y), u * u + v * v - x * x - y * y - power[j] + power[i])
                if len(cell) < 3:
                    break
                reach = max(math.hypot(a - x, b - y) for a, b in cell)
            cells.append(cell)
        moments = [_moments(c) if len(c) > 2 else (*s, 0.0) for c, s in zip(cells, sites, strict=True)]
        off = sum(abs(m[2] / area - w) for m, w in zip(moments, share, strict=True)) / 2
        if off < least:
            best, least = cells, off
        if off <= VORONOI_RATIO:
            break
        sites = [m[:2] for m in moments]
        power = [p + (w * area - m[2]) * 0.5 for p, w, m in zip(power, share, moments, strict=True)]
        low = min(power)
        power = [p - low for p in power]
    return [np.array(c).reshape(-1, 2) for c in best]


def _voronoi(polygon: list, weight: np.ndarray, parent: int) -> list[list]:
    cells = power_cells(np.array(polygon), weight, np.random.default_rng([VORONOI_SEED, parent + 1])) if len(polygon) > 2 else [np.array(polygon)] * len(weight)
    return [c.tolist() if len(c) > 2 else polygon for c in cells]


def voronoi_treemap(nodes: DataFrame) -> DataFrame:
    """L4: convex cells in a 128-gon, nested along the tree, with the rectangular treemap's weights."""
    turn = [2 * math.pi * k / VORONOI_SIDES for k in range(VORONOI_SIDES)]
    cells = _down(nodes, [[SIZE / 2 + SIZE / 2 * math.cos(t), SIZE / 2 + SIZE / 2 * math.sin(t)] for t in turn], _voronoi)
    found = nodes.select("session_id", "node", "id").join(cells.withColumnRenamed("shape", "polygon"), ["session_id", "node"])
    return found.withColumn("_m", moments(F.col("polygon"))).select("session_id", "node", "id", "polygon", F.col("_m.x").alias("x"), F.col("_m.y").alias("y"))


def moments(polygon: Column) -> Column:
    """Centre (x, y) and area of a convex polygon with an area: sums over its edges."""
    before = F.concat(F.slice(polygon, -1, 1), F.slice(polygon, 1, F.size(polygon) - 1))
    cross = F.zip_with(before, polygon, lambda p, q: F.struct((p[0] * q[1] - q[0] * p[1]).alias("c"), (p[0] + q[0]).alias("x"), (p[1] + q[1]).alias("y")))
    total = lambda f: F.aggregate(cross, F.lit(0.0), lambda s, e: s + f(e))
    area = total(lambda e: e["c"])
    return F.struct((total(lambda e: e["x"] * e["c"]) / (3 * area)).alias("x"), (total(lambda e: e["y"] * e["c"]) / (3 * area)).alias("y"), (F.abs(area) / 2).alias("area"))


def scatter_plot(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Symmetric-log coordinates scaled to 0..1000, y upwards; a constant axis is 500."""
    ends = points.agg(*(f(display.symlog(F.col(c))).alias(f"_{n}_{c}") for c in (x, y) for n, f in (("low", F.min), ("high", F.max))))
    each = points.crossJoin(F.broadcast(ends))  # one row
    at = lambda c: display.scaled(display.symlog(F.col(c)), F.col(f"_low_{c}"), F.col(f"_high_{c}"))
    return each.withColumns({"px": at(x), "py": F.lit(SIZE) - at(y)}).drop(*ends.columns)


def gridlines(points: DataFrame, axis: str) -> DataFrame:
    """(sigma, position) of the whole sigmas of an axis within the values' range."""
    ends = points.agg(F.min(axis).alias("lo"), F.max(axis).alias("hi"))
    line = ends.where("lo is not null and ceil(lo) <= floor(hi)").select("lo", "hi", F.explode(F.sequence(F.ceil("lo").cast("int"), F.floor("hi").cast("int"))).alias("sigma"))
    s = lambda c: display.symlog(c.cast("double"))
    return line.select("sigma", display.scaled(s(F.col("sigma")), s(F.col("lo")), s(F.col("hi"))).alias("position"))


def edges(nodes: DataFrame, positions: DataFrame) -> DataFrame:
    """Parent and child positions for every link: session_id, parent, child, p (struct), c (struct), n_children."""
    at = positions.select("session_id", "node", F.struct("x", "y", "angle", "radius").alias("at"))
    link = nodes.select("session_id", F.col("node").alias("parent"), F.size("children").alias("n_children"), F.explode("children").alias("child"))
    link = link.join(at.withColumnsRenamed({"node": "parent", "at": "p"}), ["session_id", "parent"])
    return link.join(at.withColumnsRenamed({"node": "child", "at": "c"}), ["session_id", "child"])


def radial_links(links: DataFrame) -> DataFrame:
    """An arc at the parent's radius to the child's angle, then a spoke; a single child gets a straight line; coincident ends none."""
    far = F.abs(F.col("p.x") - F.col("c.x")) + F.abs(F.col("p.y") - F.col("c.y")) >= 1e-6
    elbow = F.struct((F.col("p.radius") * F.cos("c.angle") + SIZE / 2).alias("x"), (F.col("p.radius") * F.sin("c.angle") + SIZE / 2).alias("y"))
    kind = F.when(F.col("n_children") == 1, "straight").otherwise("elbow")
    return links.where(far).withColumns({"kind": kind, "elbow": F.when(kind == "elbow", elbow), "arc": F.when(kind == "elbow", arc_points(F.col("p.angle"), F.col("c.angle"), F.col("p.radius")))})


def arc_points(start: Column, end: Column, radius: Column, chord: float = 3.0) -> Column:
    """Points along an arc, the start left out, the end included, at most ``chord`` apart."""
    steps = F.greatest(F.lit(1), F.ceil(F.abs(end - start) * radius / chord).cast("int"))

    def point(k: Column, angle: Column) -> Column:
        return F.struct((F.lit(SIZE / 2) + k["radius"] * F.cos(angle)).alias("x"), (F.lit(SIZE / 2) + k["radius"] * F.sin(angle)).alias("y"))

    return _with_constants(
        {"start": start, "span": end - start, "radius": radius, "steps": steps},
        lambda k: F.transform(F.transform(F.sequence(F.lit(1), k["steps"]), lambda i: k["start"] + k["span"] * i / k["steps"]), lambda a: point(k, a)),
    )


def _with_constants(values: dict[str, Column], f) -> Column:
    """``f`` of a struct of values that are computed once, not again for every element of what ``f`` makes."""
    return F.get(F.transform(F.array(F.struct(*(v.alias(c) for c, v in values.items()))), f), F.lit(0))


def curve_points(child: Column, parent: Column, unit: Column) -> Column:
    """Points of a cubic link, level at both ends; ``unit``: graph units of a pixel. 8 to 256 segments by its span on the screen."""
    dx, dy = parent["x"] - child["x"], parent["y"] - child["y"]
    hx = F.when(F.abs(dx) > 1e-6, child["x"] + dx * 0.5).otherwise(child["x"] - F.least(F.abs(dy) / 2, unit * 12))
    n = F.greatest(F.lit(8), F.least(F.lit(256), F.ceil(F.sqrt(F.sqrt(dx * dx + dy * dy) / unit / 0.25)).cast("int")))

    def at(k: Column, t: Column) -> Column:
        s = F.lit(1.0) - t
        x = s * s * s * k["x0"] + (s * s * t + s * t * t) * 3 * k["hx"] + t * t * t * k["x1"]
        y = (s * s * s + s * s * t * 3) * k["y0"] + (s * t * t * 3 + t * t * t) * k["y1"]
        return F.struct(x.alias("x"), y.alias("y"))

    ends = {"x0": child["x"], "y0": child["y"], "x1": parent["x"], "y1": parent["y"], "hx": hx, "n": n}
    return _with_constants(ends, lambda k: F.transform(F.transform(F.sequence(F.lit(0), k["n"]), lambda i: i / k["n"]), lambda t: at(k, t)))


def merge_dots(nodes: DataFrame, positions: DataFrame) -> DataFrame:
    """Positions of merges above height 0 whose representative is visible."""
    shown = nodes.where("id is not null").select("session_id", F.col("node").alias("representative"))
    keep = nodes.where("merge_index is not null and height > 1e-6").join(shown, ["session_id", "representative"], "left_semi")
    return keep.join(positions.select("session_id", "node", "x", "y"), ["session_id", "node"])
