"""Spatial thinning and hit-testing with cells as join and group keys."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnflow.operators.layouts import SIZE
from cairnflow.sources.store import stored

#: Points on average in the smallest cells of a search for nearest points.
FULL = 4
_EPS = 2.220446049250313e-16
#: Gaps in pixels by kind of graph, with images or with labels only.
GAPS = {"plane": (60, 40), "tree": (32, 16), "exemplar": (24, 24)}


def gap_of(mode: Column, images: Column) -> Column:
    """The gap between samples of a kind of graph."""
    pick = lambda kind: F.when(images, GAPS[kind][0]).otherwise(GAPS[kind][1])
    return F.when(mode.endswith("tree"), pick("tree")).otherwise(pick("plane"))


def polar_cells(points: DataFrame, gap: float) -> DataFrame:
    """Ring, slot and score of every point (key, x, y) about the centre."""
    gap = max(gap, _EPS)
    dx, dy = F.col("x") - SIZE / 2, F.col("y") - SIZE / 2
    with_polar = points.withColumns({"_r": F.sqrt(dx * dx + dy * dy), "_a": (F.atan2(dy, dx) + 2 * math.pi) % F.lit(2 * math.pi)})
    ring = F.floor(F.col("_r") / gap)
    centre = F.greatest((F.col("ring") + 0.5) * gap, F.lit(_EPS))
    slots = F.greatest(F.lit(1), F.floor(centre * (2 * math.pi) / gap + 0.5))
    step = F.lit(2 * math.pi) / F.col("_n")
    off = F.abs(F.col("_a") - (F.col("slot") + 0.5) * step)
    out = with_polar.withColumn("ring", ring).withColumn("_n", slots).withColumn("slot", F.floor(F.col("_a") / step) % F.col("_n"))
    return out.withColumn("score", F.least(off, F.lit(2 * math.pi) - off) / step + F.abs(F.col("_r") - centre) / gap).drop("_r", "_a", "_n")


def polar_thinning(points: DataFrame, bounds: Column, scale: float, pixels: float) -> DataFrame:
    """The point nearest to the middle of each ring slot; the smaller key wins ties."""
    from cairnflow.functions.display import inside

    cells = polar_cells(points.where(inside(F.col("x"), F.col("y"), bounds)), pixels * scale)
    return cells.groupBy("ring", "slot").agg(F.min(F.struct("score", "key")).alias("m")).select("ring", "slot", "m.key", "m.score")


def hex_thinning(points: DataFrame, bounds: tuple[float, float, float, float], scale: float, pixels: float) -> DataFrame:
    """For each site of a hexagonal grid the nearest point less than half a cell away, if it is in the bounds (min x, max x, min y, max y).

    A point can only belong to the sites around it, so it is exploded to these few and no pair of point and site is tried in vain.
    """
    h = max(pixels * scale, _EPS)
    row, column, shift, reach = h * 0.75, h * 0.866, h * 0.433, h * 0.5
    min_x, max_x, min_y, max_y = bounds
    rows = F.explode(F.sequence(F.floor((F.col("y") - reach) / row), F.ceil((F.col("y") + reach) / row)))
    near = points.select("key", "x", "y", rows.alias("row")).where((F.col("row") >= math.floor(min_y / row)) & (F.col("row") <= math.ceil(max_y / row)))
    near = near.withColumn("_o", F.when(F.col("row") % 2 == 0, F.lit(shift)).otherwise(F.lit(0.0)))
    columns = F.explode(F.sequence(F.floor((F.col("x") - F.col("_o") - reach) / column), F.ceil((F.col("x") - F.col("_o") + reach) / column)))
    near = near.select("*", columns.alias("col"))
    near = near.where((F.col("col") >= F.floor((F.lit(min_x) - F.col("_o")) / column)) & (F.col("col") <= F.ceil((F.lit(max_x) - F.col("_o")) / column)))
    dx, dy = F.col("x") - (F.col("col") * F.lit(column) + F.col("_o")), F.col("y") - F.col("row") * F.lit(row)
    best = near.withColumn("d2", dx * dx + dy * dy).where(F.col("d2") < reach * reach).groupBy("row", "col").agg(F.min(F.struct("d2", "key", "x", "y")).alias("m"))
    return best.select("m.key", "m.x", "m.y").where(F.col("x").between(min_x, max_x) & F.col("y").between(min_y, max_y)).select("key").distinct()


def nearest_within(pointers: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """For each pointer (pointer, x, y) the nearest point (key, x, y) strictly within the radius; ties to the smaller key.

    Cells are the join key: first small ones, of ``FULL`` points on average, then larger ones up to the radius for those pointers that
    have no point within a cell's size. So a pointer meets about as many points however densely they lie.
    """
    points = stored(points.where("x is not null and y is not null").groupBy("x", "y").agg(F.min("key").alias("key")), "points")
    cell = lambda c, size: F.floor(F.col(c) / size)
    held, cells = points.groupBy(cell("x", radius), cell("y", radius)).agg(F.count("*").alias("n")).agg(F.sum("n"), F.count("*")).first()
    level = max(0, math.ceil(math.log(held / cells / FULL, 4))) if held else 0
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    left, found = pointers.select("pointer", F.col("x").alias("px"), F.col("y").alias("py")).distinct(), []
    d2 = (F.col("x") - F.col("px")) * (F.col("x") - F.col("px")) + (F.col("y") - F.col("py")) * (F.col("y") - F.col("py"))
    while True:
        size = radius / 2**level
        asked = left.withColumn("o", around).select("pointer", "px", "py", (cell("px", size) + F.col("o.i")).alias("cx"), (cell("py", size) + F.col("o.j")).alias("cy"))
        sure = size * size * (1 - 1e-9) if level else radius * radius  # nearer points than this all lie in the cells around
        near = asked.join(points.select("key", "x", "y", cell("x", size).alias("cx"), cell("y", size).alias("cy")), ["cx", "cy"]).withColumn("d2", d2).where(F.col("d2") < sure)
        best = near.groupBy("pointer", "px", "py").agg(F.min(F.struct("d2", "key")).alias("m"))
        found.append(stored(best, "nearest") if level else best)
        if not level:
            break
        left = stored(left.join(found[-1].select("pointer", "px", "py"), ["pointer", "px", "py"], "left_anti"), "left")
        if left.isEmpty():
            break
        level -= 1
    return reduce(DataFrame.unionByName, found).groupBy("pointer").agg(F.min("m").alias("m")).select("pointer", "m.key", "m.d2")


def pick(boxes: DataFrame, dots: DataFrame, points: DataFrame, pointers: DataFrame, radius: float) -> DataFrame:
    """An exemplar's image box (key, x0, y0, x1, y1) first, else the nearer of merge dot and point, dots winning ties."""
    hit = cell_candidates(pointers, boxes.groupBy("x0", "y0", "x1", "y1").agg(F.min("key").alias("key"))).groupBy("pointer").agg(F.min("key").alias("key"))
    ranked = hit.select("pointer", "key", F.lit(0).alias("rank"), F.lit(0.0).alias("d2"), F.lit("image").alias("kind"))
    for kind, table in (("dot", dots), ("point", points)):
        ranked = ranked.unionByName(nearest_within(pointers, table, radius).select("pointer", "key", F.lit(1).alias("rank"), "d2", F.lit(kind).alias("kind")))
    return ranked.groupBy("pointer").agg(F.min(F.struct("rank", "d2", "kind", "key")).alias("m")).select("pointer", "m.kind", "m.key")


def cell_at(pointers: DataFrame, cells: DataFrame, step: float = 100.0) -> DataFrame:
    """The leaf cell (id, x0, y0, x1, y1; bounds included) that holds a pointer; cells are filed under the tiles that they touch, equal ones once."""
    span = lambda a, b: F.sequence(F.floor(F.col(a) / step), F.floor(F.col(b) / step))
    cells = cells.where("id is not null").groupBy("x0", "y0", "x1", "y1").agg(F.min("id").alias("id"))
    filed = cells.select("id", "x0", "y0", "x1", "y1", F.explode(span("x0", "x1")).alias("tx"), span("y0", "y1").alias("ys")).select("*", F.explode("ys").alias("ty")).drop("ys")
    asked = pointers.select("pointer", "x", "y", F.floor(F.col("x") / step).alias("tx"), F.floor(F.col("y") / step).alias("ty"))
    inside = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    return asked.join(filed, ["tx", "ty"]).where(inside).groupBy("pointer").agg(F.min("id").alias("id"))


def polygon_at(pointers: DataFrame, cells: DataFrame) -> DataFrame:
    """J13 for convex polygons (id, polygon): a pointer is inside if it is on one side of all edges; equal polygons are tried once."""
    p = F.col("polygon")
    n = F.size(p)
    side = F.transform(F.sequence(F.lit(0), n - 1), lambda i: (p[(i + 1) % n][0] - p[i][0]) * (F.col("y") - p[i][1]) - (p[(i + 1) % n][1] - p[i][1]) * (F.col("x") - p[i][0]))
    xs, ys = F.transform(p, lambda q: q[0]), F.transform(p, lambda q: q[1])
    boxed = cells.where("id is not null").groupBy("polygon").agg(F.min("id").alias("id")).withColumns({"x0": F.array_min(xs), "x1": F.array_max(xs), "y0": F.array_min(ys), "y1": F.array_max(ys)})
    near = cell_candidates(pointers, boxed)
    return near.where(F.forall(side, lambda s: s >= -1e-9) | F.forall(side, lambda s: s <= 1e-9)).groupBy("pointer").agg(F.min("id").alias("id"))


def cell_candidates(pointers: DataFrame, cells: DataFrame, step: float = 100.0) -> DataFrame:
    """Pointers with the cells whose box holds them."""
    span = lambda a, b: F.sequence(F.floor(F.col(a) / step), F.floor(F.col(b) / step))
    filed = cells.select("*", F.explode(span("x0", "x1")).alias("tx")).select("*", F.explode(span("y0", "y1")).alias("ty")).drop("x", "y")
    asked = pointers.select("pointer", "x", "y", F.floor(F.col("x") / step).alias("tx"), F.floor(F.col("y") / step).alias("ty"))
    return asked.join(filed, ["tx", "ty"]).where(F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1")))
