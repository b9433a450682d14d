"""Merges of reducible linkages from the items themselves, without a table of their distances.

The distance of two clusters is the mean (average), the mean by shares (weighted) or the largest (complete) distance of their items,
or follows from their centres and sizes (ward). So a round needs no distances of the round before: clusters are dealt into groups of whole
clusters with about as many items, each group is a part of a stored table, and a task sweeps two parts. Time grows with the
square of the items, what is stored with the items.

A round puts clusters that lead to the same pair by their nearest ones into a circle of at most ``CIRCLE`` clusters. A sweep gives all distances within circles and
each cluster's least distance to what is outside of its circle; a circle goes on merging pairs that are each other's nearest as long as
nothing outside can be nearer. As these linkages are reducible, no merge outside brings anything nearer, so these merges are those of any order.
Circles are a guess that decides how far a round comes, not what it merges; if a round merges nothing, nearest clusters are searched again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnflow.operators import linkage, pairs
from cairnflow.sources.store import discard, opened, shared_folder, stored

#: Items of a group: a 24th of all between these bounds.
LEAST, MOST, PARTS = 1024, 8192, 24
_TILE = 1 << 19
#: Clusters from this size on lie one after the other in a group, smaller ones member by member, so that sums run along the memory.
_LONG = 16
#: Clusters whose distances to each other one task holds.
CIRCLE = 1024
NEAREST = "session_id string, slot int, near int, d double, far double"
_WORKED = "session_id string, turn int, i int, j int, height double, representative int, slot int, `to` int, part_of double, size long, centre array<double>, rep int, at array<double>, near int, d double"


class _Side:
    """A group's clusters by size and slot, and their items in an order in which equal sizes are added up at once."""

    def __init__(self, slot: np.ndarray, share: np.ndarray, x: np.ndarray, circle: np.ndarray):
        order = np.argsort(slot, kind="stable")
        names, first, count = np.unique(slot[order], return_index=True, return_counts=True)
        by_size = np.argsort(count, kind="stable")
        self.slots, self.sizes = names[by_size], count[by_size]
        self.classes, items, at, where = [], [], 0, 0
        for k in np.unique(self.sizes):
            own = first[by_size][self.sizes == k]
            grid = own[:, None] + np.arange(k)
            items.append((grid.T if k < _LONG else grid).ravel())
            self.classes.append((int(k), len(own), at, where))
            at, where = at + len(own), where + len(own) * int(k)
        take = order[np.concatenate(items)]
        self.x, self.share = x[take], share[take]
        self.circle = circle[order[first]]  # by rank
        self.by_slot = np.argsort(self.slots)
        self.rank = np.empty(len(names), np.int64)
        self.rank[self.by_slot] = np.arange(len(names))
        self.ordered = bool((self.by_slot == np.arange(len(names))).all())
        self.best, self.who = np.full(len(names), np.inf), np.full(len(names), -1, np.int64)  # by rank

    def rows(self, most: int) -> Iterator[tuple[slice, list[np.ndarray]]]:
        """(clusters, their items member by member): as many as a tile takes."""
        for k, c, at, where in self.classes:
            for u in range(0, c, most):
                some = np.arange(u, min(u + most, c))
                t = np.arange(k)[:, None]
                grid = where + (t * c + some if k < _LONG else some * k + t)
                step = max(1, most // len(some))
                yield slice(at + u, at + u + len(some)), [grid[s : s + step] for s in range(0, k, step)]

    def columns(self, table: np.ndarray, add: np.ufunc) -> np.ndarray:
        """A row for each cluster of the other side, a column for each item here, put together by clusters in the order of slots."""
        if len(self.classes) > 1 or self.classes[0][0] > 1:
            out = np.empty((len(table), len(self.slots)))
            for k, c, at, where in self.classes:
                own = table[:, where : where + k * c]
                add.reduce(own.reshape(len(table), k, c) if k < _LONG else own.reshape(len(table), c, k), axis=1 if k < _LONG else 2, out=out[:, at : at + c])
            table = out
        return table if self.ordered else table[:, self.by_slot]

    def nearer(self, at: np.ndarray, d: np.ndarray, who: np.ndarray) -> None:
        at, d, who = at[np.isfinite(d)], d[np.isfinite(d)], who[np.isfinite(d)]
        better = (d < self.best[at]) | ((d == self.best[at]) & (who < self.who[at]))
        self.best[at[better]], self.who[at[better]] = d[better], who[better]


def _distances(p: _Side, q: _Side, method: str) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """(clusters of p, their distances to those of q in the order of slots, the largest distance of items) in strips; squares for ward."""
    centre = q.x.mean(axis=0)
    x, y = p.x - centre, q.x - centre
    m, n = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
    error = 8 * (x.shape[1] + 8) * np.finfo(float).eps * float(m.max() + n.max() + np.square(centre).sum())
    if not np.isfinite(error):
        raise ValueError("vectors have components that are not finite")
    left, right = np.column_stack([-2 * x, m, np.ones(len(x))]), np.ascontiguousarray(np.column_stack([y, np.ones(len(y)), n]).T)
    add = np.maximum if method == "complete" else np.add
    for clusters, parts in p.rows(max(1, _TILE // len(y))):
        whole, far = None, 0.0
        for grid in parts:
            items = grid.ravel()
            g = left[items] @ right
            if g.min() <= error * 1e6:  # too near for what the product leaves of them
                i, j = np.nonzero(g <= error * 1e6)
                g[i, j] = np.square(pairs.measured(p.x, q.x, items[i], j))
            far = max(far, float(g.max()))
            if method in ("average", "weighted"):
                np.sqrt(g, out=g)
            if method == "weighted":
                g *= p.share[items][:, None]
            one = add.reduce(g.reshape(*grid.shape, -1), axis=0) if len(grid) > 1 else g
            whole = one if whole is None else add(whole, one, out=whole)
        if method == "weighted":
            whole *= q.share
        d = q.columns(whole, add)
        if method == "average":
            d /= p.sizes[clusters][:, None] * q.sizes[q.by_slot].astype(float)
        elif method == "complete":
            d = np.sqrt(d)
        elif method == "ward":  # items are centres here, and their shares sizes
            a, b = p.share[clusters][:, None], q.share[q.by_slot]
            d = d * (2 * a * b / (a + b))
        yield np.arange(clusters.start, clusters.stop), d, float(np.sqrt(far))


def _apart(d: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Of a group with itself each pair once."""
    d[np.arange(d.shape[1]) <= rank[:, None]] = np.inf
    return d


def _part(path: str, part: int, columns: list[str]) -> pa.Table:
    fs, top = opened(path)
    files = [f.path for f in fs.get_file_info(FileSelector(f"{top}/part={part}")) if f.path.endswith(".parquet")]
    return pa.concat_tables([pq.ParquetFile(fs.open_input_file(f)).read(columns, use_threads=False) for f in files]).combine_chunks()


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten(), dtype=np.float64).reshape(len(column), -1)


def vectors_of(path: str, part: int) -> tuple[np.ndarray, np.ndarray]:
    """(idx, features) of a part of a stored table, in the order of idx."""
    t = _part(path, part, ["idx", "features"]).sort_by("idx")
    return t.column("idx").to_numpy(), _matrix(t.column("features"))


def _read(path: str, part: int) -> _Side:
    t = _part(path, part, ["slot", "share", "v", "circle"])
    return _Side(t.column("slot").to_numpy(), t.column("share").to_numpy(), _matrix(t.column("v")), t.column("circle").to_numpy())


def _both(p: _Side, q: _Side, clusters: np.ndarray, d: np.ndarray) -> None:
    """Takes distances into the nearest clusters of both sides."""
    if not d.size:
        return
    j, rank = d.argmin(axis=1), p.rank[clusters]
    p.nearer(rank, d[np.arange(len(j)), j], q.slots[q.by_slot[j]])
    least = d.min(axis=0)
    some = np.flatnonzero((least <= q.best) & np.isfinite(least))
    q.nearer(some, least[some], p.slots[clusters[d[:, some].argmin(axis=0)]])


def _swept(tasks: DataFrame, path: str, method: str) -> DataFrame:
    """(NEAREST): for each cluster its nearest one within a group, and the largest distance of items; ``tasks``: session_id, p, q."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.to_pylist():
                p, far = _read(path, t["p"]), 0.0
                q = p if t["p"] == t["q"] else _read(path, t["q"])
                for clusters, d, most in _distances(p, q, method):
                    far = max(far, most)
                    _both(p, q, clusters, _apart(d, p.rank[clusters]) if p is q else d)
                for side in [p] if p is q else [p, q]:
                    known = side.who >= 0
                    n = int(known.sum())
                    columns = [pa.array([t["session_id"]] * n, pa.string()), pa.array(side.slots[side.by_slot][known], pa.int32()), pa.array(side.who[known], pa.int32()), pa.array(side.best[known]), pa.array(np.full(n, far))]
                    yield pa.RecordBatch.from_arrays(columns, names=["session_id", "slot", "near", "d", "far"])

    return tasks.mapInArrow(run, NEAREST)


def _circled(tasks: DataFrame, path: str, method: str) -> DataFrame:
    """(session_id, circle, a, b, d): the distances of all pairs of clusters of a circle, and each cluster's least one to another circle's cluster (b: -1 - its slot)."""
    names = ["session_id", "circle", "a", "b", "d"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.to_pylist():
                rows = lambda circle, a, b, d: pa.RecordBatch.from_arrays([pa.array([t["session_id"]] * len(a), pa.string()), pa.array(circle, pa.int32()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(d, pa.float64())], names=names)  # noqa: B023, E731
                p = _read(path, t["p"])
                q = p if t["p"] == t["q"] else _read(path, t["q"])
                own = q.slots[q.by_slot]
                for clusters, d, _ in _distances(p, q, method):
                    rank = p.rank[clusters]
                    if p is q:
                        d = _apart(d, rank)
                    same = p.circle[rank][:, None] == q.circle
                    i, j = np.nonzero(same & np.isfinite(d))
                    if len(i):
                        a, b = p.slots[clusters[i]], own[j]
                        yield rows(q.circle[j], np.minimum(a, b), np.maximum(a, b), d[i, j])
                    d[same] = np.inf
                    _both(p, q, clusters, d)
                for side in [p] if p is q else [p, q]:
                    known = side.who >= 0
                    yield rows(side.circle[known], side.slots[side.by_slot][known], -1 - side.who[known], side.best[known])

    return tasks.mapInArrow(run, "session_id string, circle int, a int, b int, d double")


def _dealt(points: DataFrame, clusters: DataFrame, method: str, group: int) -> tuple[DataFrame, DataFrame, str]:
    """Items (session_id, slot, share, v) as parts of a stored table, one for each group of clusters (session_id, slot, size, circle), the pairs of
    groups, and the folder."""
    spark = points.sparkSession
    loads = clusters.groupBy("session_id").agg(F.sum(F.lit(1) if method == "ward" else F.col("size")).alias("n")).orderBy("session_id").collect()  # a row for each large session
    bases, tasks, at = [], [], 0
    for r in loads:
        many = -(-r.n // group)
        bases.append((r.session_id, at, many))
        tasks += [(r.session_id, p, q) for p in range(at, at + many) for q in range(p, at + many)]
        at += many
    known = spark.createDataFrame(bases, "session_id string, base int, many int")
    grouped = clusters.join(F.broadcast(known), "session_id").select("session_id", "slot", "circle", (F.col("base") + F.pmod(F.xxhash64("slot"), F.col("many"))).cast("int").alias("part"))
    path = shared_folder(spark, "parts")
    points.join(grouped, ["session_id", "slot"]).select("session_id", "slot", "share", "v", "circle", "part").repartition("part").write.partitionBy("part").parquet(path)
    fs, top = opened(path)
    there = {int(f.path.rsplit("=", 1)[1]) for f in fs.get_file_info(FileSelector(top)) if "/part=" in f.path}  # by chance a group may be empty
    tasks = [t for t in tasks if t[1] in there and t[2] in there]
    tasks = spark.createDataFrame(tasks, "session_id string, p int, q int").repartition(max(1, min(len(tasks), max(32, 3 * spark.sparkContext.defaultParallelism))))
    out = spark.read.schema("session_id string, slot int, share double, v array<double>, circle int, part int").parquet(path)
    out.stored_at = path
    return out, tasks, path


def _circles(clusters: DataFrame) -> DataFrame:
    """``clusters`` (with near and d) with the circle that they are in: the smaller of the pair that they lead to, or what they reach in eight steps; a session of few clusters is one circle."""
    to = clusters.select("session_id", "slot", F.col("near").alias("p"))
    back = to.select("session_id", F.col("slot").alias("p"), F.col("p").alias("_q"))
    to = to.join(back, ["session_id", "p"], "left").select("session_id", "slot", F.when((F.col("_q") == F.col("slot")) & (F.col("slot") < F.col("p")) | F.col("_q").isNull(), F.col("slot")).otherwise(F.col("p")).alias("p"))
    for _ in range(3):
        back = to.select("session_id", F.col("slot").alias("p"), F.col("p").alias("_q"))
        to = to.join(back, ["session_id", "p"], "left").select("session_id", "slot", F.coalesce("_q", "p").alias("p"))
    ranked = clusters.join(to, ["session_id", "slot"]).withColumn("_r", F.row_number().over(Window.partitionBy("session_id", "p").orderBy("d", "slot")))
    first = F.min("slot").over(Window.partitionBy("session_id", "p", F.floor((F.col("_r") - 1) / CIRCLE)))
    few = clusters.groupBy("session_id").agg((F.count("*") <= CIRCLE).alias("_few"))
    return ranked.withColumn("circle", first).join(F.broadcast(few), "session_id").withColumn("circle", F.when(F.col("_few"), F.lit(0)).otherwise(F.col("circle"))).drop("p", "_r", "_few")


def _worked(method: str, turn: int):
    """Merges of a circle, and its clusters after these with what is nearest to them as far as it is known."""

    def run(clusters: pa.Table, near: pa.Table) -> pa.Table:
        clusters = clusters.sort_by("slot")
        m, names = clusters.num_rows, [f.split()[0].strip("`") for f in _WORKED.split(", ")]
        slot, size = clusters.column("slot").to_numpy(), clusters.column("size").to_numpy().astype(float)
        table = lambda c: np.array(clusters.column(c).combine_chunks().flatten(), dtype=float).reshape(m, -1)
        centre, at, rep = table("centre"), table("at"), clusters.column("rep").to_numpy().copy()
        a, b, d = (near.column(c).to_numpy() for c in ("a", "b", "d"))
        dist, outside, who = np.full((m, m), np.inf), np.full(m, np.inf), np.full(m, -1, np.int64)
        inner = b >= 0
        i, j = np.searchsorted(slot, a[inner]), np.searchsorted(slot, b[inner])
        dist[i, j] = dist[j, i] = d[inner]
        i, out, other = np.searchsorted(slot, a[~inner]), d[~inner], -1 - b[~inner]
        order = np.lexsort((-other, -out))
        outside[i[order]], who[i[order]] = out[order], other[order]  # the least comes last
        merges, to, best = linkage.merge_within(dist, method, size.copy(), outside)
        rows, inside_of, share = [], {k: [k] for k in range(m)}, np.ones(m)
        for k, (x, y, h) in enumerate(merges):
            total = size[x] + size[y]
            c = (centre[x] * size[x] + centre[y] * size[y]) / total
            if np.square(at[x] - c).sum() > np.square(at[y] - c).sum() * (1 + 1e-9):
                at[x], rep[x] = at[y], rep[y]
            centre[x], size[x] = c, total
            inside_of[x] += inside_of.pop(y)
            share[inside_of[x]] /= 2
            if outside[y] < outside[x]:
                outside[x], who[x] = outside[y], who[y]
            rows.append({"turn": turn + k, "i": int(slot[x]), "j": int(slot[y]), "height": h, "representative": int(rep[x])})
        for k in range(m):
            row = {"slot": int(slot[k]), "to": int(slot[to[k]]), "part_of": float(share[k])}
            if to[k] == k:
                inside = best[k][0] <= outside[k]
                row |= {"size": int(size[k]), "centre": centre[k], "rep": int(rep[k]), "at": at[k], "near": int(slot[best[k][1]]) if inside and best[k][1] >= 0 else int(who[k]), "d": float(min(best[k][0], outside[k]))}
            rows.append(row)
        session = clusters.column("session_id")[0].as_py()
        schema = {"turn": pa.int32(), "i": pa.int32(), "j": pa.int32(), "height": pa.float64(), "representative": pa.int32(), "slot": pa.int32(), "to": pa.int32(), "part_of": pa.float64(), "size": pa.int64(), "centre": pa.list_(pa.float64()), "rep": pa.int32(), "at": pa.list_(pa.float64()), "near": pa.int32(), "d": pa.float64()}
        return pa.table({n: pa.array([session] * len(rows), pa.string()) if n == "session_id" else pa.array([r.get(n) for r in rows], schema[n]) for n in names})

    return run


def merged(items: DataFrame, method: str, few: int) -> tuple[list[DataFrame], DataFrame, DataFrame, DataFrame]:
    """Rounds until each session has at most ``few`` clusters: (merges of each round, clusters, distances of all of these, the sessions' largest distances of items).

    ``items``: session_id, idx, features. Distances are those of the items as they are, squared for ward."""
    columns = ["session_id", "slot", "size", "centre", "rep", "at"]
    single = items.select("session_id", F.col("idx").alias("slot"), F.lit(1).cast("long").alias("size"), F.col("features").alias("centre"), F.col("idx").alias("rep"), F.col("features").alias("at"))
    clusters, points = stored(single, "clusters"), items.select("session_id", F.col("idx").alias("slot"), F.lit(1.0).alias("share"), F.col("features").alias("v"))
    most = clusters.groupBy("session_id").count().agg(F.max("count")).first()[0] or 0
    group = min(MOST, max(LEAST, -(-most // PARTS)))
    items_of = lambda: clusters.select("session_id", "slot", F.col("size").cast("double").alias("share"), F.col("centre").alias("v")) if method == "ward" else points
    widest, out, turn, count, exact = None, [], 0, None, True
    while True:
        most, total = clusters.groupBy("session_id").count().agg(F.max("count"), F.sum("count")).first()
        if (most or 0) <= few:
            break
        if total == count:
            if exact:
                raise ValueError("no two clusters are each other's nearest")
            exact = True
        else:
            exact = count is None
        count = total
        if exact:
            dealt, tasks, path = _dealt(items_of(), clusters.withColumn("circle", F.lit(0)), method, group)
            near = stored(_swept(tasks, path, method).groupBy("session_id", "slot").agg(F.min(F.struct("d", "near")).alias("m"), F.max("far").alias("far")).select("session_id", "slot", "m.near", "m.d", "far"), "near")
            if widest is None:
                widest = stored(near.groupBy("session_id").agg(F.max("far").alias("m")), "widest")
            discard(dealt)
            clusters = clusters.select(*columns).join(near.drop("far"), ["session_id", "slot"], "left")
        before, clusters = clusters, stored(_circles(clusters), "clusters")
        discard(before)
        before = points
        points, tasks, path = _dealt(items_of(), clusters, method, group)
        discard(before)
        pairs_ = _circled(tasks, path, method)
        worked = stored(clusters.groupBy("session_id", "circle").cogroup(pairs_.groupBy("session_id", "circle")).applyInArrow(_worked(method, turn), _WORKED), "worked")
        to = worked.where("slot is not null").select("session_id", "slot", F.col("to").alias("_to"), "part_of")
        after = worked.where("slot = `to`").select(*columns, "near", "d").join(to.select("session_id", F.col("slot").alias("near"), "_to"), ["session_id", "near"], "left")
        before, clusters = clusters, stored(after.select(*columns, F.col("_to").alias("near"), "d"), "clusters")
        discard(before)
        if method != "ward":
            moved, stored_at = points.join(to, ["session_id", "slot"]), points.stored_at
            points = moved.select("session_id", F.col("_to").alias("slot"), (F.col("share") * F.col("part_of")).alias("share"), "v")
            points.stored_at = stored_at
        made = worked.where("turn is not null").select("session_id", "turn", "i", "j", F.col("height").alias("h"), "representative")
        turn += CIRCLE
        out.append(made)
    before = points
    points, tasks, path = _dealt(items_of(), clusters.withColumn("circle", F.lit(0)), method, group)
    discard(before)
    table = stored(_circled(tasks, path, method).select("session_id", "a", "b", "d"), "near")
    discard(points)
    return out, clusters.select(*columns), table, widest
