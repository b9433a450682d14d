import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnflow.operators import hierarchy, linkage, topology


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(0)
    data = [(s, 7 * i, rng.normal(size=4).tolist()) for s, n in (("a", 70), ("b", 25)) for i in range(n)] + [("one", 5, [1.0] * 4)]
    return data, spark.createDataFrame(data, "session_id string, id long, features array<double>").repartition(3)


def of(rows, session):
    return [(r.left, r.right, round(r.height, 9), r.representative) for r in sorted(rows, key=lambda r: r.step) if r.session_id == session]


@pytest.mark.parametrize("method", hierarchy.METHODS)
def test_merges_equal_those_of_one_group(spark, vectors, method):
    data, df = vectors
    items = hierarchy._items(df)
    found = hierarchy.nodes_of(hierarchy.steps(items, method, few=16, block=32, most=9), hierarchy._sizes(items)).collect()
    for s in ("a", "b"):
        want = linkage.cluster(np.array([f for q, _, f in data if q == s]), method, 0.0, 5, order=False)["merges"]
        assert of(found, s) == [(min(a, b), max(a, b), round(h, 9), None if method == "single" else rep) for a, b, h, rep in want]
    assert of(found, "one") == []


def test_labels_and_heights(vectors, monkeypatch):
    data, df = vectors
    monkeypatch.setattr(hierarchy, "FEW", 16)
    for threshold, target in ((0.4, 0), (0.0, 6)):
        out, merges = hierarchy.clustered(df, "complete", threshold, target)
        rows = out.collect()
        assert len(rows) == 96 and merges.count() == 69 + 24
        for s in ("a", "b"):
            own = sorted((r for r in rows if r.session_id == s), key=lambda r: r.idx)
            want = linkage.cluster(np.array([f for q, _, f in data if q == s]), "complete", threshold, target, order=False)
            assert [r.k for r in own] == want["labels"].tolist() and np.allclose([r.join_height for r in own], want["join_height"])
    assert [(r.k, r.join_height) for r in rows if r.session_id == "one"] == [(0, 0.0)]


def test_copies_and_methods_that_cannot(spark, vectors):
    same = spark.createDataFrame([("s", i, [1.0, 2.0] if i < 30 else [0.0, float(i)]) for i in range(40)], "session_id string, id long, features array<double>")
    for method in ("average", "single"):
        items = hierarchy._items(same)
        heights = sorted(r.height for r in hierarchy.steps(items, method, few=4, most=4).collect())
        assert len(heights) == 39 and heights[:29] == [0.0] * 29 and heights[29] > 0
    with pytest.raises(ValueError, match="reducible"):
        hierarchy.steps(items, "median")
    assert hierarchy.dendrogram(vectors[1].limit(0)).count() == 0


def walked(n, merges, visible):
    """Depths, places and counts by walking from the roots."""
    kids = {n + s: (a, b) for s, (a, b) in enumerate(merges)}
    roots = sorted(set(range(n)) | set(kids) - {c for m in merges for c in m})
    roots = [r for r in [*range(n), *kids] if r not in {c for m in merges for c in m}]
    out, at = {}, 0

    def visit(v, depth):
        nonlocal at
        first = at
        below = [visit(c, depth + 1) for c in kids.get(v, ())]
        if v < n and visible[v]:
            at += 1
        if at > first:
            out[v] = (depth, first, at - first, [c for c, some in zip(kids.get(v, ()), below, strict=True) if some])
        return at > first

    for r in roots:
        visit(r, 0)
    return out


@pytest.mark.parametrize("shape", ["chain", "random", "forest"])
def test_tours_of_trees(spark, shape):
    rng = np.random.default_rng(3)
    n = 60
    alive, merges = list(range(n)), []
    for s in range(n - (8 if shape == "forest" else 1)):
        pick = [alive[-1], alive[0]] if shape == "chain" else rng.choice(alive, 2, replace=False).tolist()
        merges.append(tuple(pick))
        alive = [x for x in alive if x not in pick] + [n + s]
    visible, k = rng.random(n) < 0.7, (np.arange(n) // 7).tolist()
    leaves = spark.createDataFrame([("s", i, 100 + i, bool(visible[i]), k[i] if i % 9 else None, float(k[i])) for i in range(n)], "session_id string, idx int, id long, visible boolean, k int, cluster_angle double")
    rows = spark.createDataFrame([("s", s, a, b, 0.1 * s, min(a, n - 1)) for s, (a, b) in enumerate(merges)], "session_id string, step int, `left` int, `right` int, height double, representative int")
    got = {r.node: r for r in topology.topology(leaves, rows).collect()}
    want = walked(n, merges, visible)
    assert {v: (r.depth, r.first_place, r.visible_leaves, r.children) for v, r in got.items()} == want
    wins = [m[0] if m[0] < n else n - 1 for m in merges]
    for v, r in got.items():
        below = [v] if v < n else [u for u in want if u < n and r.first_place <= want[u][1] <= r.last_place]
        ks = {k[u] if u % 9 else None for u in below}
        assert r.cluster_id == (next(iter(ks)) if len(ks) == 1 else None)
        assert (r.id, r.merge_index) == ((100 + v, None) if v < n else (None, v - n)) and r.wins == (wins.count(v) if v < n else None)
    angles = topology.leaf_angles(leaves.withColumn("k", F.lit(0)), rows).orderBy("leaf_angle").collect()
    assert [r.idx for r in angles] == sorted(range(n), key=lambda i: walked(n, merges, [True] * n)[i][1])


def test_edges_of_pairs_of_blocks_are_thinned(spark):
    """Before, every pair of blocks passed its whole tree on: items squared over the block's size."""
    rng = np.random.default_rng(4)
    items = hierarchy._items(spark.createDataFrame([("s", i, rng.normal(size=4).tolist()) for i in range(200)], "session_id string, id long, features array<double>"))
    near = hierarchy._blocks(items, True, 8)
    assert near.count() > 200 * 20
    assert hierarchy._thinned(near, 8 * hierarchy.RUN).count() < 200 * 4
    x = np.array([r.features for r in items.orderBy("idx").collect()])
    want = [round(h, 9) for _, _, h in linkage.merge(linkage.distances(x) / linkage.distances(x).max(), "single")]
    assert [round(r.height, 9) for r in hierarchy.steps(items, "single", block=8, most=40).orderBy("step").collect()] == want


def test_reciprocal_pairs_with_ties(spark):
    """Before, the rows of all pairs were sorted for a least struct; now the least distances are aggregated as numbers first."""
    rng = np.random.default_rng(2)
    d = {(a, b): float(rng.integers(1, 9)) for a in range(30) for b in range(a + 1, 30)}
    near = spark.createDataFrame([("s", a, b, v) for (a, b), v in d.items()], "session_id string, a int, b int, d double")
    found = hierarchy._reciprocal(near)
    own = [min((v, *p) for p, v in d.items() if k in p)[1:] for k in range(30)]
    assert {(r.i, r.j, r.h) for r in found.collect()} == {(*p, d[p]) for p in own if own.count(p) == 2}
    assert "least" in found._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("method", ["complete", "average", "weighted", "ward"])
def test_sweeps_need_no_table_of_distances(spark, method, monkeypatch):
    """Before, the distances of all pairs of items were stored as rows; now only those of ``table`` clusters are."""
    rng = np.random.default_rng(6)
    data = [(s, i, x) for s, n in (("s", 90), ("t", 70), ("u", 12)) for i, x in enumerate(rng.normal(size=(n, 3)).tolist())]
    data += [("s", 90 + i, data[i][2]) for i in range(10)]  # copies
    items = hierarchy._items(spark.createDataFrame(data, "session_id string, id long, features array<double>").repartition(3))
    monkeypatch.setattr(hierarchy.sweeps, "LEAST", 40)
    monkeypatch.setattr(hierarchy.sweeps, "CIRCLE", 30)
    seen, blocks = [], hierarchy._blocks
    monkeypatch.setattr(hierarchy, "_blocks", lambda rest, *a: seen.append(rest.count()) or blocks(rest, *a))
    found = hierarchy.steps(items, method, few=60, table=60).collect()
    assert seen == [12]
    for s in "stu":
        x = np.array([f for q, _, f in data if q == s])
        want = linkage.cluster(x, method, 0.0, 5, order=False)["merges"]
        rows = sorted((r for r in found if r.session_id == s), key=lambda r: r.step)
        assert np.allclose([r.height for r in rows], [m[2] for m in want], atol=1e-9)
        got = hierarchy.labels(items, spark.createDataFrame(found), 0.0, 7).where(F.col("session_id") == s).orderBy("idx").collect()
        assert [r.k for r in got] == linkage.cut(len(x), [m[:3] for m in want], 0.0, 7)[0].tolist()


def test_vectors_do_not_travel_to_every_block(spark):
    """Before, each vector went through a shuffle once for every block, and each pair of blocks passed its tree on."""
    rng = np.random.default_rng(7)
    items = hierarchy._items(spark.createDataFrame([("s", i, rng.normal(size=4).tolist()) for i in range(300)], "session_id string, id long, features array<double>"))
    near = hierarchy._spanning(items, items.groupBy("session_id").agg(F.count("*").alias("n")).collect(), 10).toPandas()
    kept = hierarchy._forest(near.a.to_numpy(), near.b.to_numpy(), near.d.to_numpy())
    _, _, d = hierarchy.pairs.tree(np.array([r.features for r in items.orderBy("idx").collect()]), None)
    assert np.allclose(np.sort(near.d.to_numpy()[kept]), np.sort(d)) and near.d.max() == d.max()
    assert len(near) < 30 * 31 / 2 * 10  # edges of the trees of all pairs of blocks, roughly
