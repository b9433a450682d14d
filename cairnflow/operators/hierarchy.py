"""Merge trees of sessions of any size, by rounds of reciprocal nearest neighbours.

For reducible linkages (complete, average, weighted, ward) two clusters that are each other's nearest are
merged sooner or later whatever else happens, so all such pairs are merged at once. While a session has more than ``TABLE`` clusters,
rounds find nearest clusters from the items themselves (``sweeps``). Then a round works on a table of
cluster distances: the nearest cluster of each is a partial aggregate, pairs that chose each other are merged, and the distances
of what they become follow from at most four rows each by Lance and Williams. Nothing holds a whole session; the table
shrinks with the square of the clusters from round to round, and is stored in between.

Sessions of at most ``FEW`` clusters, at the start or after some rounds, are finished in one bounded group each.

Single linkage tends to chains, in which only one pair of clusters is reciprocal at a time. Its tree comes from the edges of
spanning forests of pairs of blocks instead, in the order of their lengths: the edges are halved by length, the components of the
lighter half stand for their members in the heavier half, and both halves go on alone, until a part has at most ``EDGES`` edges.
So all parts of a level are contracted side by side.

Pairs are ordered by distance, then by their smallest members, so that every round merges at least the nearest pair.
Among merges of one height the order may differ from that of merging one pair at a time.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnflow.functions import vectors as V
from cairnflow.operators import graph, linkage, pairs, sweeps
from cairnflow.operators.selection import running_total
from cairnflow.sources.store import discard, shared_folder, stored

METHODS = ("single", "complete", "average", "weighted", "ward")
#: Clusters of a session that are merged in one group.
FEW = 2048
#: Clusters of a session whose distances are stored as a table.
TABLE = 2048
#: Edges of a spanning forest that are put in order in one group.
EDGES = 4096
#: Blocks in a run: the spanning trees of all pairs of blocks of two runs are made one forest, before any of their edges travel on.
RUN = 16
_TIE = 1 + 1e-9
_STEPS = "session_id string, turn int, i int, j int, height double, representative int"


def numbered(df: DataFrame, *order: str, name: str = "idx") -> DataFrame:
    """Rows of every session numbered from 0 in an order, without sorting a session in one task."""
    ranked = running_total(df, [F.col("session_id"), *(F.col(c) for c in order)], F.lit(1), "_at")
    first = ranked.groupBy("session_id").agg(F.min("_at").alias("_first"))
    return ranked.join(first, "session_id").withColumn(name, (F.col("_at") - F.col("_first")).cast("int")).drop("_at", "_first")


def _table(session: str, a: list, b: list, d: list) -> pa.Table:
    a, b, d = (np.concatenate(x) if x else np.zeros(0) for x in (a, b, d))
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    return pa.table({"session_id": pa.array([session] * len(d), pa.string()), "a": pa.array(lo, pa.int32()), "b": pa.array(hi, pa.int32()), "d": pa.array(d, pa.float64())})


def _blocks(items: DataFrame, sparse: bool, block: int) -> DataFrame:
    """(session_id, a, b, d): the distances of every two items of a session, or enough of them to span it, and its largest."""

    def run(table: pa.Table) -> pa.Table:
        own, idx = table.column("block").to_numpy(), table.column("idx").to_numpy()
        x = np.asarray(table.column("features").combine_chunks().flatten(), dtype=np.float64).reshape(len(idx), -1)
        p, q = (np.flatnonzero(own == table.column(c)[0].as_py()) for c in ("p", "q"))
        session = table.column("session_id")[0].as_py()
        if sparse:
            one = np.array_equal(p, q)
            if one and len(p) < 2:
                return _table(session, [], [], [])
            i, j, d = pairs.tree(x[p], None if one else x[q])
            names = idx[p] if one else np.concatenate([idx[p], idx[q]])
            return _table(session, [names[i]], [names[j]], [d])
        a, b, d = [], [], []
        for k in range(0, len(p), 32):
            some = p[k : k + 32]
            gap = x[some][:, None, :] - x[q][None, :, :]
            near = np.sqrt(np.einsum("abk,abk->ab", gap, gap))
            i, j = np.nonzero(idx[some][:, None] < idx[q][None, :])  # blocks are in the order of idx
            a.append(idx[some][i])
            b.append(idx[q][j])
            d.append(near[i, j])
        return _table(session, a, b, d)

    placed = items.select("session_id", "idx", "features", F.floor(F.col("idx") / block).cast("int").alias("block"))
    last = placed.groupBy("session_id").agg(F.max("block").alias("_last"))
    other = placed.join(last, "session_id").withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_last"))))
    keyed = other.select("session_id", F.least("block", "_other").alias("p"), F.greatest("block", "_other").alias("q"), "block", "idx", "features")
    return keyed.groupBy("session_id", "p", "q").applyInArrow(run, "session_id string, a int, b int, d double")


def _joined(method: str, x: Column, y: Column, h: Column, a: Column, b: Column, s: Column) -> Column:
    """The distance of a merged pair (of sizes a, b, at distance h) to a cluster of size s from those of its parts."""
    return {
        "complete": F.greatest(x, y), "average": (a * x + b * y) / (a + b), "weighted": (x + y) / 2,
        "ward": ((a + s) * x + (b + s) * y - s * h) / (a + b + s),
    }[method]


def _reciprocal(near: DataFrame) -> DataFrame:
    """(session_id, i, j, h): pairs of clusters that are each other's nearest."""
    both = near.select("session_id", F.col("a").alias("p"), "a", "b", "d").union(near.select("session_id", F.col("b").alias("p"), "a", "b", "d"))
    # the least distances first, as plain numbers, which need no sort; ties are settled among the few pairs at them
    least = stored(both.groupBy("session_id", "p").agg(F.min("d").alias("least")), "least")
    chosen = both.join(least, ["session_id", "p"]).where(F.col("d") == F.col("least")).groupBy("session_id", "p").agg(F.min(F.struct("d", "a", "b")).alias("m")).select("session_id", "m.*")
    return chosen.groupBy("session_id", F.col("a").alias("i"), F.col("b").alias("j")).agg(F.count("*").alias("n"), F.first("d").alias("h")).where("n = 2").drop("n")


def _next_clusters(clusters: DataFrame, merged: DataFrame) -> DataFrame:
    """Clusters after a round; the representative of a pair is that of the part which is nearer its centre (of the first, if both are as near)."""
    side = lambda s, slot: clusters.select("session_id", F.col("slot").alias(slot), *(F.col(c).alias(f"{c}_{s}") for c in ("size", "centre", "rep", "at")))
    both = merged.join(side("x", "i"), ["session_id", "i"]).join(side("y", "j"), ["session_id", "j"]).withColumn("size", F.col("size_x") + F.col("size_y"))
    centre = F.zip_with("centre_x", "centre_y", lambda x, y: (x * F.col("size_x") + y * F.col("size_y")) / F.col("size"))
    both = both.withColumn("centre", centre).withColumn("first", V.squared_distance(F.col("at_x"), F.col("centre")) <= V.squared_distance(F.col("at_y"), F.col("centre")) * _TIE)
    pick = lambda c: F.when(F.col("first"), F.col(f"{c}_x")).otherwise(F.col(f"{c}_y")).alias(c)
    return both.select("session_id", F.col("i").alias("slot"), "size", "centre", pick("rep"), pick("at"), F.lit(True).alias("new"), "j", "h")


def _round(near: DataFrame, clusters: DataFrame, method: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round: the merges, the distances and the clusters after it."""
    made = stored(_next_clusters(clusters, _reciprocal(near)), "merged")
    part = lambda slot, at: made.select("session_id", F.col(slot).alias("slot"), F.col("slot").alias("to"), F.lit(at).alias("part"), "h")
    roles = clusters.select("session_id", "slot", "size").join(part("slot", 0).union(part("j", 1)), ["session_id", "slot"], "left")
    roles = stored(roles.select("session_id", "slot", "size", F.coalesce("to", "slot").alias("to"), F.coalesce("part", F.lit(0)).alias("part"), "h"), "roles")
    side = lambda slot, s: roles.select("session_id", F.col("slot").alias(slot), *(F.col(c).alias(f"{c}_{s}") for c in ("to", "part", "h", "size")))
    placed = near.join(side("a", "x"), ["session_id", "a"]).join(side("b", "y"), ["session_id", "b"])
    kept = placed.where("h_x is null and h_y is null").select("session_id", "a", "b", "d")  # neither cluster was merged
    moved = placed.where("to_x <> to_y and (h_x is not null or h_y is not null)")
    first = F.col("to_x") < F.col("to_y")
    of = lambda s, t, c: F.when(first, F.col(f"{c}_{s}")).otherwise(F.col(f"{c}_{t}")).alias(f"{c}_{s}")
    turned = moved.select("session_id", "d", *(of(s, t, c) for s, t in ("xy", "yx") for c in ("to", "part", "h", "size")))
    cell = lambda p, q: F.max(F.when((F.col("part_x") == p) & (F.col("part_y") == q), F.col("d"))).alias(f"d{p}{q}")
    sizes = [F.max(F.when(F.col(f"part_{s}") == p, F.col(f"size_{s}"))).alias(f"{s}{p}") for s in "xy" for p in (0, 1)]
    cells = turned.groupBy("session_id", "to_x", "to_y").agg(*(cell(p, q) for p in (0, 1) for q in (0, 1)), *sizes, F.first("h_x").alias("h_x"), F.first("h_y").alias("h_y"))
    x0, x1, y0, y1 = (F.col(c) for c in ("x0", "x1", "y0", "y1"))
    to = [F.when(F.col("h_x").isNull(), F.col(f"d0{q}")).otherwise(_joined(method, F.col(f"d0{q}"), F.col(f"d1{q}"), F.col("h_x"), x0, x1, size)) for q, size in ((0, y0), (1, y1))]
    d = F.when(F.col("h_y").isNull(), to[0]).otherwise(_joined(method, to[0], to[1], F.col("h_y"), y0, y1, x0 + F.coalesce(x1, F.lit(0))))
    after = stored(cells.select("session_id", F.col("to_x").alias("a"), F.col("to_y").alias("b"), d.alias("d")).union(kept), "near")
    discard(roles)
    gone = made.select("session_id", F.explode(F.array("slot", "j")).alias("slot"))
    rest = stored(clusters.join(gone, ["session_id", "slot"], "left_anti").unionByName(made.select(*clusters.columns)), "clusters")
    return made, after, rest


def _finish(method: str, turn: int):
    """The merges of a session of few clusters."""

    def run(clusters: pa.Table, near: pa.Table) -> pa.Table:
        clusters = clusters.sort_by("slot")
        out: list[tuple] = []
        m = clusters.num_rows
        if m > 1:
            slot, size = clusters.column("slot").to_numpy(), clusters.column("size").to_numpy().astype(float)
            rep, centre, at = clusters.column("rep").to_pylist(), np.array(clusters.column("centre").to_pylist()), np.array(clusters.column("at").to_pylist())
            dist = np.full((m, m), np.inf)
            i, j = (np.searchsorted(slot, near.column(c).to_numpy()) for c in ("a", "b"))
            dist[i, j] = dist[j, i] = near.column("d").to_numpy()
            low, weight, rep, centre, at = slot.tolist(), size.tolist(), list(rep), [*centre], [*at]
            for left, right, height in linkage.merge(np.sqrt(dist) if method == "ward" else dist, method, size):
                left, right = sorted((left, right), key=low.__getitem__)
                total = weight[left] + weight[right]
                c = (centre[left] * weight[left] + centre[right] * weight[right]) / total
                best = left if ((at[left] - c) ** 2).sum() <= ((at[right] - c) ** 2).sum() * _TIE else right
                out.append((low[left], low[right], height, rep[best]))
                for column, value in ((low, low[left]), (weight, total), (centre, c), (rep, rep[best]), (at, at[best])):
                    column.append(value)
        columns = list(zip(*out, strict=True)) or [()] * 4
        session = clusters.column("session_id")[0] if m else None
        kinds = (pa.int32(), pa.int32(), pa.float64(), pa.int32())
        names = ("i", "j", "height", "representative")
        return pa.table({"session_id": pa.array([session.as_py()] * len(out) if m else [], pa.string()), "turn": pa.array([turn + k for k in range(len(out))], pa.int32()), **{n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)}})

    return run


def _kruskal(edges: pa.Table) -> pa.Table:
    """The edges of a part that join two components, with the smallest members of both."""
    edges = edges.sort_by("pos")
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    out = []
    for a, b, d, pos in zip(*(edges.column(c).to_pylist() for c in ("a", "b", "d", "pos")), strict=True):
        i, j = sorted((find(a), find(b)))
        if i != j:
            up[j] = i
            out.append((i, j, d, pos))
    columns = list(zip(*out, strict=True)) or [()] * 4
    return pa.table({n: pa.array(c, k) for n, c, k in zip(("i", "j", "height", "pos"), columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)})


def _thinned(near: DataFrame, width: int) -> DataFrame:
    """The edges of ``near`` without those that are in no spanning forest of two runs of ``width`` items."""

    def run(edges: pa.Table) -> pa.Table:
        edges = edges.sort_by([("d", "ascending"), ("a", "ascending"), ("b", "ascending")])
        a, b = edges.column("a").to_numpy(), edges.column("b").to_numpy()
        names = np.unique(np.concatenate([a, b]))
        up, kept = list(range(len(names))), []
        for at, (i, j) in enumerate(zip(np.searchsorted(names, a).tolist(), np.searchsorted(names, b).tolist(), strict=True)):
            while up[i] != i:
                up[i] = i = up[up[i]]
            while up[j] != j:
                up[j] = j = up[up[j]]
            if i != j:
                up[j] = i
                kept.append(at)
        return edges.take(pa.array(kept, pa.int64())).select(["session_id", "a", "b", "d"])

    of = lambda c: F.floor(F.col(c) / width).alias(f"_{c}")
    return near.groupBy("session_id", of("a"), of("b")).applyInArrow(run, "session_id string, a int, b int, d double")


def _forest(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Which edges are in a spanning forest of them all, and one of the longest."""
    order, names = np.lexsort((b, a, d)), np.unique(np.concatenate([a, b]))
    up, kept = list(range(len(names))), [int(d.argmax())]
    for at, i, j in zip(order.tolist(), np.searchsorted(names, a[order]).tolist(), np.searchsorted(names, b[order]).tolist(), strict=True):
        while up[i] != i:
            up[i] = i = up[up[i]]
        while up[j] != j:
            up[j] = j = up[up[j]]
        if i != j:
            up[j] = i
            kept.append(at)
    return np.unique(kept)


def _spanning(items: DataFrame, large: list, block: int) -> DataFrame:
    """As sparse ``_blocks`` of the sessions of ``large`` (session_id, n). A vector is stored once, as part of its block; tasks read the blocks of two runs, and
    one forest of a pair of runs leaves a task, with its longest edge."""
    spark, bases, tasks, at = items.sparkSession, [], [], 0
    for r in large:
        many = -(-r.n // block)
        run = max(1, min(RUN, many // 14))
        runs = [(at + k, min(at + k + run, at + many)) for k in range(0, many, run)]
        tasks += [(r.session_id, *p, *q) for i, p in enumerate(runs) for q in runs[i:]]
        bases.append((r.session_id, at))
        at += many
    path = shared_folder(spark, "blocks")
    placed = items.join(F.broadcast(spark.createDataFrame(bases, "session_id string, base int")), "session_id").withColumn("part", (F.col("base") + F.floor(F.col("idx") / block)).cast("int"))
    placed.select("idx", "features", "part").repartition("part").write.partitionBy("part").parquet(path)

    def run_(batches):
        for batch in batches:
            for t in batch.to_pylist():
                found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
                for p in range(t["p"], t["p_to"]):
                    x = sweeps.vectors_of(path, p)
                    for q in range(max(p, t["q"]), t["q_to"]):
                        y = x if p == q else sweeps.vectors_of(path, q)
                        if p == q and len(x[0]) < 2:
                            continue
                        i, j, d = pairs.tree(x[1], None if p == q else y[1])
                        names = x[0] if p == q else np.concatenate([x[0], y[0]])
                        found = [np.concatenate(c) for c in zip(found, (names[i], names[j], d), strict=True)]
                    if len(found[2]):
                        kept = _forest(*found)
                        found = [c[kept] for c in found]
                yield from _table(t["session_id"], *([c] for c in found)).to_batches()

    listed = spark.createDataFrame(tasks, "session_id string, p int, p_to int, q int, q_to int").repartition(min(2000, len(tasks)))
    return listed.mapInArrow(run_, "session_id string, a int, b int, d double")


def _chained(items: DataFrame, most: int, block: int) -> DataFrame:
    """``steps`` of single linkage, without representatives."""
    sizes = stored(items.groupBy("session_id").agg(F.count("*").alias("n")), "sizes")
    large = sizes.where(F.col("n") > block).collect()  # a row for each session of more than a block
    near = _blocks(items.join(sizes.where(F.col("n") <= block).select("session_id"), "session_id", "left_semi"), True, block)
    near = stored(near.unionByName(_spanning(items, large, block)) if large else near, "near")
    widest = stored(near.groupBy("session_id").agg(F.max("d").alias("m")), "widest")
    before, near = near, stored(_thinned(near, block * RUN), "near")
    discard(before)
    known = stored(running_total(items.select("session_id", "idx"), [F.col("session_id"), F.col("idx")], F.lit(1), "node"), "known")
    side = lambda c, to: known.select("session_id", F.col("idx").alias(c), F.col("node").alias(to))
    placed = near.join(widest, "session_id").join(side("a", "x"), ["session_id", "a"]).join(side("b", "y"), ["session_id", "b"])
    scaled = placed.select(F.col("x").alias("a"), F.col("y").alias("b"), F.when(F.col("m") > 0, F.col("d") / F.col("m")).otherwise(F.col("d")).alias("d"))
    edges = stored(running_total(scaled, [F.col("d"), F.col("a"), F.col("b")], F.lit(1), "pos"), "edges")
    total, count = known.agg(F.max("node")).first()[0] or 0, edges.agg(F.max("pos")).first()[0] or 0
    shift = max(0, count.bit_length())
    while (1 << shift) > most:  # parts are runs of 2 ** shift edges
        shift -= 1
        light = F.shiftright("pos", shift) % 2 == 0
        code = lambda c: (F.shiftright("pos", shift + 1) * (total + 1) + F.col(c)).alias(c)
        pairs_ = edges.where(light).select(code("a"), code("b"))
        found = graph.components(pairs_.select(F.explode(F.array("a", "b")).alias("node")).distinct(), pairs_)
        to = lambda c: found.select(F.col("node").alias(f"_{c}"), (F.col("component") % (total + 1)).alias(f"_to_{c}"))
        heavy = edges.where(~light).withColumns({"_a": code("a"), "_b": code("b")}).join(to("a"), "_a", "left").join(to("b"), "_b", "left")
        heavy = heavy.select(F.coalesce("_to_a", "a").alias("a"), F.coalesce("_to_b", "b").alias("b"), "d", "pos").where("a <> b")
        before, edges = edges, stored(edges.where(light).select("a", "b", "d", "pos").union(heavy), "edges")
        discard(before)
    found = edges.groupBy(F.shiftright("pos", shift).alias("part")).applyInArrow(_kruskal, "i long, j long, height double, pos long")
    back = lambda c, to: known.select("session_id", F.col("idx").alias(to), F.col("node").alias(c))
    named = found.join(back("i", "_i"), "i").join(back("j", "_j").drop("session_id"), "j")
    made = named.select("session_id", F.col("_i").alias("i"), F.col("_j").alias("j"), "height", F.lit(None).cast("int").alias("representative"), "pos")
    discard(near)
    return numbered(made, "pos", name="step").drop("pos")


def steps(items: DataFrame, method: str, few: int = FEW, block: int = pairs.BLOCK, most: int = EDGES, table: int = TABLE) -> DataFrame:
    """(session_id, step, i, j, height, representative): the merges of every session in the order of their heights, in
    unit-diameter space; i < j are the smallest members of what is merged (single linkage names no representatives).
    ``items``: session_id, idx, features."""
    if method not in METHODS:
        raise ValueError(f"linkage {method} is not reducible")
    if method == "single":
        return _chained(items, most, block)
    table = max(few, table)
    height = F.sqrt(F.greatest("h", F.lit(0.0))) if method == "ward" else F.col("h")
    sizes = stored(items.groupBy("session_id").agg(F.count("*").alias("n")), "sizes")
    large, turn, made = sizes.where(F.col("n") > table).select("session_id"), 0, []
    rest, parts = items, []
    if large.head(1):
        before, many, swept, far = sweeps.merged(items.join(large, "session_id", "left_semi"), method, few)
        by = lambda c: F.when(F.col("m") > 0, F.col(c) / (F.col("m") * F.col("m") if method == "ward" else F.col("m"))).otherwise(F.col(c)).alias(c)
        made = [m.join(far, "session_id").select("session_id", "turn", "i", "j", by("h"), "representative").withColumn("height", height).select("session_id", "turn", "i", "j", "height", "representative") for m in before]
        turn = len(before) * sweeps.CIRCLE
        unit = lambda c: V.divided(F.col(c), F.col("m")).alias(c)
        parts = [(swept.join(far, "session_id").select("session_id", "a", "b", by("d")), many.join(far, "session_id").select("session_id", "slot", "size", unit("centre"), "rep", unit("at")))]
        rest = items.join(large, "session_id", "left_anti")
    near = stored(_blocks(rest, False, block), "near")
    widest = stored(near.groupBy("session_id").agg(F.max("d").alias("m")), "widest")
    scaled = near.join(widest, "session_id").withColumn("d", F.when(F.col("m") > 0, F.col("d") / F.col("m")).otherwise(F.col("d")))
    scaled = scaled.select("session_id", "a", "b", (F.col("d") * F.col("d") if method == "ward" else F.col("d")).alias("d"))
    placed = rest.join(widest, "session_id", "left").select("session_id", F.col("idx").alias("slot"), F.lit(1).cast("long").alias("size"), V.divided(F.col("features"), F.coalesce("m", F.lit(0.0))).alias("centre"), F.col("idx").alias("rep"))
    parts.append((scaled, placed.withColumn("at", F.col("centre"))))
    scaled, clusters = (stored(reduce(DataFrame.unionByName, side), name) for side, name in zip(zip(*parts, strict=True), ("near", "clusters"), strict=True))
    discard(near)
    near = scaled
    while (clusters.groupBy("session_id").count().agg(F.max("count")).first()[0] or 0) > few:
        merged, after, rest = _round(near, clusters, method)
        discard(near, clusters)
        near, clusters = after, rest
        made.append(merged.select("session_id", F.lit(turn).alias("turn"), F.col("slot").alias("i"), "j", height.alias("height"), F.col("rep").alias("representative")))
        turn += 1
    last = clusters.groupBy("session_id").cogroup(near.groupBy("session_id")).applyInArrow(_finish(method, turn), _STEPS)
    return numbered(reduce(DataFrame.unionByName, [*made, last]), "height", "turn", "i", "j", name="step").drop("turn")


def _items(vectors: DataFrame) -> DataFrame:
    return stored(numbered(vectors.select("session_id", "id", V.doubles(F.col("features")).alias("features")), "id"), "items")


def _sizes(items: DataFrame) -> DataFrame:
    return items.groupBy("session_id").agg(F.count("*").cast("int").alias("n"))


def nodes_of(found: DataFrame, n: DataFrame) -> DataFrame:
    """``steps`` with the nodes that they join: the last merge of a smallest member before, or the item itself. Columns as ``linkage.MERGES``."""
    slots = found.select("session_id", "step", "height", "representative", F.explode(F.array("i", "j")).alias("slot")).join(n, "session_id")
    before = F.lag("step").over(Window.partitionBy("session_id", "slot").orderBy("step"))
    nodes = slots.withColumn("node", F.coalesce(F.col("n") + before, F.col("slot")))
    one = nodes.groupBy("session_id", "step").agg(F.min("node").alias("left"), F.max("node").alias("right"), F.first("height").alias("height"), F.first("representative").alias("representative"))
    return one.select("session_id", "step", "left", "right", "height", "representative")


def labels(items: DataFrame, found: DataFrame, threshold: float, target: int) -> DataFrame:
    """(session_id, idx, k): clusters after the merges up to the target or the threshold, numbered by their smallest members."""
    applied = found.join(_sizes(items), "session_id")
    if target > 0:
        applied = applied.where(F.col("step") < F.col("n") - F.greatest(F.lit(1), F.least(F.lit(target), F.col("n"))))
    if threshold > 0:
        applied = applied.where(F.col("height") <= threshold)
    if target <= 0 and threshold <= 0:
        applied = applied.where(F.lit(False))
    known = stored(running_total(items.select("session_id", "idx"), [F.col("session_id"), F.col("idx")], F.lit(1), "node"), "known")
    side = lambda c, to: known.select("session_id", F.col("idx").alias(c), F.col("node").alias(to))
    edges = applied.join(side("i", "a"), ["session_id", "i"]).join(side("j", "b"), ["session_id", "j"]).select("a", "b")
    found = known.join(graph.components(known.select("node"), edges), "node")
    roots = numbered(found.where("node = component").select("session_id", "component"), "component", name="k")
    return found.join(roots, ["session_id", "component"]).select("session_id", "idx", "k")


def dendrogram(vectors: DataFrame, method: str = "complete", few: int = FEW, most: int = EDGES) -> DataFrame:
    """The merges of every session of ``vectors`` (session_id, id, features), of whatever size."""
    items = _items(vectors)
    return nodes_of(steps(items, method, few, most=most), _sizes(items))


def clustered(vectors: DataFrame, method: str = "complete", threshold: float = 0.25, target: int = 0) -> tuple[DataFrame, DataFrame]:
    """Assignments (session_id, id, idx, k, join_height) and merges of every session, of whatever size."""
    items = _items(vectors)
    found = stored(steps(items, method), "steps")
    n = _sizes(items)
    merges = stored(nodes_of(found, n), "merges")
    first = merges.select("session_id", F.explode(F.array("left", "right")).alias("idx"), F.col("height").alias("join_height"))
    own = items.select("session_id", "id", "idx").join(labels(items, found, threshold, target), ["session_id", "idx"])
    return own.join(first, ["session_id", "idx"], "left").select("session_id", "id", "idx", "k", F.coalesce("join_height", F.lit(0.0)).alias("join_height")), merges
