import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairnflow.operators import graph, linkage

def orders(node, n, merges):
    if node < n:
        return [[node]]
    left, right = merges[node - n][:2]
    return [o for a in orders(left, n, merges) for b in orders(right, n, merges) for o in (a + b, b + a)]


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6), st.integers(3, 7))
def test_order_of_random_trees(seed, n):
    rng = random.Random(seed)
    points = np.array([[rng.random(), rng.random()] for _ in range(n)])
    alive, merges = list(range(n)), []
    for s in range(n - 1):
        a, b = rng.sample(alive, 2)
        merges.append((a, b, 1.0))
        alive = [x for x in alive if x not in (a, b)] + [n + s]
    dist = linkage.distances(points)
    out = linkage.optimal_order(dist, merges)
    got = linkage.ring_cost(dist, linkage.leaves_of(n, out))
    assert [set(m[:2]) for m in out] == [set(m[:2]) for m in merges]
    assert math.isclose(got, min(linkage.ring_cost(dist, o) for o in orders(2 * n - 2, n, merges)), abs_tol=1e-9)


def test_large_products_leave_out_joints_without_changing_a_sum(monkeypatch):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(900, 5))
    d = linkage.distances(points)
    assert np.array_equal(d, np.stack([np.sqrt(np.einsum("ij,ij->i", points - p, points - p)) for p in points]))
    seen = []
    one = linkage._least_of_row
    monkeypatch.setattr(linkage, "_least_of_row", lambda *a: seen.append(len(a[0])) or one(*a))
    for a, b in ((d[:200, 200:500], d[200:500, 500:]), (d[:500, 500:700], d[500:700, :90]), (np.ones((200, 200)), np.ones((200, 200))), (d[:200, 200:500] - 3, np.round(d[200:500, 500:]))):
        assert np.array_equal(linkage._least_sum(a, b), np.min(a[:, :, None] + b[None], axis=1))
    assert len(seen) == 200 + 90 + 200 + 200
    a = d[:200, 200:400].copy()
    a[3, 5] = np.inf
    assert np.array_equal(linkage._least_sum(a, a), np.min(a[:, :, None] + a[None], axis=1))


def test_degenerate_orders():
    assert linkage.optimal_order(np.zeros((1, 1)), []) == []
    assert linkage.leaves_of(2, linkage.optimal_order(np.zeros((2, 2)), [(0, 1, 0.0)])) == [0, 1]
    zero = [(0, 1, 0.0), (2, 3, 0.0), (4, 5, 0.0)]
    assert linkage.optimal_order(np.zeros((4, 4)), zero) == linkage.optimal_order(np.zeros((4, 4)), zero)


def plain_merges(points, method):
    """Merges by the geometric definitions."""
    d = linkage.distances(points)
    groups, where, out = {i: [i] for i in range(len(points))}, {i: points[i] for i in range(len(points))}, []
    weight = {(i, j): d[i, j] for i in groups for j in groups}

    def apart(a, b):
        x, y = groups[a], groups[b]
        each = d[np.ix_(x, y)]
        gap = np.sqrt(((points[x].mean(axis=0) - points[y].mean(axis=0)) ** 2).sum())
        return {
            "single": each.min(), "complete": each.max(), "average": each.mean(), "weighted": weight.get((a, b)), "centroid": gap,
            "ward": gap * math.sqrt(2 * len(x) * len(y) / (len(x) + len(y))), "median": np.sqrt(((where[a] - where[b]) ** 2).sum()),
        }[method]

    for s in range(len(points) - 1):
        h, a, b = min((apart(a, b), a, b) for a in groups for b in groups if a < b)
        node = len(points) + s
        for c in groups:
            if c not in (a, b):
                weight[node, c] = weight[c, node] = (weight[a, c] + weight[b, c]) / 2
        where[node] = (where[a] + where[b]) / 2
        groups[node] = groups.pop(a) + groups.pop(b)
        out.append((a, b, round(float(h), 8)))
    return out


@pytest.mark.parametrize("method", linkage.METHODS)
def test_merges_equal_the_definitions(method):
    points = np.random.default_rng(0).normal(size=(24, 3))
    assert [(a, b, round(h, 8)) for a, b, h in linkage.merge(linkage.distances(points), method)] == plain_merges(points, method)


@pytest.mark.parametrize("method", linkage.CENTRAL)
def test_merges_of_centres_need_no_table(spark, monkeypatch, method):
    rng = np.random.default_rng(4)
    for points in (rng.normal(size=(300, 12)), rng.normal(size=(90, 1)), np.repeat(rng.normal(size=(40, 3)), 3, axis=0), np.ones((5, 2)), np.ones((1, 2))):
        d = linkage.distances(points)
        want = linkage.merge(d, method) if len(points) > 1 else []
        np.fill_diagonal(d, np.inf)
        for least in (None, d.min(axis=1, initial=np.inf)):
            got = linkage.merge_centres(points, method, least)
            assert [m[:2] for m in got] == [m[:2] for m in want] and np.allclose([m[2] for m in got], [m[2] for m in want], atol=1e-9)
    monkeypatch.setattr(linkage.pairs, "BLOCK", 40)
    data = [(s, 3 * i, rng.normal(size=4).tolist()) for s, n in (("a", 150), ("b", 61), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(data, "session_id string, id long, features array<double>")
    out = linkage.assignments(df, method, 0.0, 7, order=False).collect()
    assert len(out) == len(data)
    for s in "abc":
        want = linkage.cluster(np.array([f for t, _, f in data if t == s]), method, 0.0, 7, order=False)
        own = sorted((r for r in out if r.session_id == s), key=lambda r: r.id)
        assert [r.k for r in own] == want["labels"].tolist()
        assert [r.join_height for r in own] == pytest.approx(want["join_height"].tolist())


def test_more_items_than_a_table_holds(spark, monkeypatch):
    monkeypatch.setattr(linkage, "MOST_ITEMS", 20)
    points = np.random.default_rng(5).normal(size=(50, 3))
    assert len(linkage.cluster(points, "centroid", 0.0, 5, False, (float(linkage.distances(points).max()), np.zeros(50)))["merges"]) == 49
    with pytest.raises(ValueError):
        linkage.cluster(points, "average")


def test_cut_stops_at_either_criterion():
    merges = [(0, 1, 0.1), (2, 3, 0.2), (4, 5, 0.5)]
    labels = lambda *a: linkage.cut(4, merges, *a)[0].tolist()
    assert labels(0.25, 0) == [0, 0, 1, 1]
    assert labels(0.0, 0) == [0, 1, 2, 3]
    assert labels(0.0, 3) == [0, 0, 1, 2]
    assert labels(0.15, 1) == [0, 0, 1, 2]
    assert labels(9.0, 1) == [0, 0, 0, 0]
    assert linkage.cut(4, merges, 0.25, 0)[2] == 0.2


def test_ring_colours():
    assert linkage.ring_colours([0, 8, 1, 9, 2, 3, 4, 5, 6, 7], 10) == [0, 1, 2, 3, 4, 5, 6, 7, 2, 3]
    rng = random.Random(0)
    for n in range(2, 40):
        ring = rng.sample(range(n), n)
        c = linkage.ring_colours(ring, n)
        assert all(c[a] != c[b] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))


def test_bookkeeping():
    points = np.array([[0.0], [1.0], [10.0]])
    merges = [(0, 1, 1.0), (2, 3, 9.5)]
    joined, rep = linkage.bookkeeping(points, merges)
    assert joined.tolist() == [1.0, 1.0, 9.5] and rep == [0, 0]


def test_sessions_cluster_side_by_side(spark):
    rng = np.random.default_rng(1)
    data = [(s, i, rng.normal(size=4).tolist()) for s in ("a", "b") for i in range(12)] + [("one", 0, [1.0, 2.0])]
    df = spark.createDataFrame(data, "session_id string, id long, features array<double>")
    out = linkage.assignments(df, "average", 0.0, 3).collect()
    assert len(out) == 25
    for s in ("a", "b"):
        points = np.array([f for t, _, f in data if t == s])
        want = linkage.cluster(points, "average", 0.0, 3)
        own = sorted((r for r in out if r.session_id == s), key=lambda r: r.id)
        assert [r.k for r in own] == want["labels"].tolist()
        assert sorted(r.leaf_angle for r in own) == pytest.approx([2 * math.pi * (i + 0.5) / 12 for i in range(12)])
    assert linkage.dendrogram(df, "ward").count() == 22


def test_components_and_single_linkage(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)]
    up = list(range(300))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    nodes = spark.range(300).select(F.col("id").alias("node"))
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.component for r in graph.components(nodes, df).collect()} == {i: find(i) for i in range(300)}
    roots = sorted({find(i) for i in range(300)})
    assert {r.node: r.k for r in graph.single_linkage_labels(nodes, df).collect()} == {i: roots.index(find(i)) for i in range(300)}
