"""Hierarchical clustering of a session's items: seven linkages, the cut, leaf order, ring colours and statistics.

One session is one group here, which holds a distance matrix: ``MOST_ITEMS`` bounds it, and many sessions run side by side.
Centroid and median linkage without the leaves' order hold a session's vectors alone: all pairs are met before, in blocks.
``hierarchy`` has merges, cut and labels of reducible linkages for sessions of any size.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnflow.operators import pairs
from cairnflow.sources.store import stored

METHODS = ("single", "complete", "average", "weighted", "ward", "centroid", "median")
SLOTS = 8
MOST_ITEMS = 20_000
#: Linkages whose distances are those between centres.
CENTRAL = ("centroid", "median")
_NEARLY = 1 + 1e-9
#: Sums in a min-plus product from which on joints are ruled out by bounds.
_LARGE = 1 << 21


def distances(points: np.ndarray, rows: int = 8, columns: int = 256) -> np.ndarray:
    """All pairwise distances, each measured once in blocks that stay in the cache."""
    n = len(points)
    out = np.zeros((n, n))
    for i in range(0, n, rows):
        for j in range(i, n, columns):
            gap = points[i : i + rows, None] - points[None, j : j + columns]
            out[i : i + rows, j : j + columns] = np.sqrt(np.einsum("abk,abk->ab", gap, gap))
    for i in range(0, n, columns):
        k = min(i + columns, n)
        out[k:, i:k] = out[i:k, k:].T
        out[i:k, i:k] = np.triu(out[i:k, i:k], 1) + np.triu(out[i:k, i:k], 1).T
    return out


def _joined(method: str, x: np.ndarray, y: np.ndarray, h: float, a: float, b: float, c: np.ndarray) -> np.ndarray:
    """The distances (x, y) of a merged pair of sizes a, b at distance h to clusters of sizes c, by Lance and Williams."""
    if method == "single":
        return np.minimum(x, y)
    if method == "complete":
        return np.maximum(np.where(np.isinf(x), -np.inf, x), np.where(np.isinf(y), -np.inf, y))
    if method == "average":
        return (a * x + b * y) / (a + b)
    if method == "weighted":
        return (x + y) / 2
    if method == "ward":
        return ((a + c) * x + (b + c) * y - c * h) / (a + b + c)
    if method == "centroid":
        return (a * x + b * y) / (a + b) - a * b * h / (a + b) ** 2
    return x / 2 + y / 2 - h / 4


def merge_within(d: np.ndarray, method: str, size: np.ndarray, outside: np.ndarray) -> tuple[list[tuple[int, int, float]], np.ndarray, list[tuple[float, int]]]:
    """Merges (i, j, h: i < j, and i stands for both on) of a reducible linkage that hold whatever happens to other clusters, of which none is nearer than ``outside``;
    what each cluster became, and (distance, cluster) of the nearest here. ``d`` and ``size`` are worked on in place, distances of ward are squares.

    A cluster is closed once something outside may be nearer than what is nearest here, or once its nearest one is closed."""
    n = len(d)
    np.fill_diagonal(d, np.inf)
    bound, to, alive, closed, out = outside.astype(float).copy(), np.arange(n), np.ones(n, bool), np.zeros(n, bool), []
    near = d.argmin(axis=1) if n > 1 else np.zeros(n, int)
    least = d[np.arange(n), near].copy()
    known = np.ones(n, bool)
    while True:
        i = int(np.where(closed, np.inf, least).argmin())
        if closed[i] or np.isinf(least[i]):
            break
        if not known[i]:
            near[i], known[i] = d[i].argmin(), True
            least[i] = d[i, near[i]]
            continue
        j, h = int(near[i]), float(least[i])
        if closed[j] or h > bound[i] or h > bound[j]:
            closed[i] = True
            closed[j] |= h > bound[j]
            continue
        i, j = min(i, j), max(i, j)
        a, b, x, y = size[i], size[j], d[i], d[j]
        new = _joined(method, x, y, h, a, b, size)
        p, q = bound[i], bound[j]
        if np.isinf(p) or np.isinf(q):
            bound[i] = min(p, q)
        elif method == "complete":
            bound[i] = max(p, q)
        elif method == "weighted":
            bound[i] = (p + q) / 2
        else:
            bound[i] = (a * p + b * q) / (a + b) if method == "average" else min((a * p + b * q) / (a + b), p + q - h)
        alive[j] = False
        new[~alive] = np.inf
        new[i] = np.inf
        d[i], d[:, i] = new, new
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        to[to == j] = i
        out.append((i, j, h))
        least[j], closed[j] = np.inf, True
        stale = alive & ((near == i) | (near == j))
        known[stale] = False
        least[stale] = np.minimum(least[stale], new[stale])
        closer = alive & ~stale & known & ((new < least) | ((new == least) & (i < near)))
        near[closer], least[closer] = i, new[closer]
        near[i], known[i] = new.argmin(), True
        least[i] = new[near[i]]
    best = [(float(d[k].min()), int(d[k].argmin())) if alive[k] and n > 1 and np.isfinite(d[k].min()) else (np.inf, -1) for k in range(n)]
    return out, to, best


def merge(dist: np.ndarray, method: str, sizes: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """G1: merges (left, right, height), nodes from n on in the order of merges; ties go to the smallest pair. ``sizes``: of clusters to begin with.

    A lower bound of each row's nearest distance is kept, and a row is searched again only when its bound is the least
    and its neighbour is gone; distances follow Lance and Williams.
    """
    if method not in METHODS:
        raise ValueError(f"unknown linkage {method}")
    n = len(dist)
    d = dist.astype(float).copy()
    if method in ("ward", "centroid", "median"):
        d *= d
    np.fill_diagonal(d, np.inf)
    size, node = np.ones(n) if sizes is None else sizes.astype(float), np.arange(n)
    alive = np.ones(n, bool)
    near = d.argmin(axis=1) if n > 1 else np.zeros(n, int)
    least = d[np.arange(n), near] if n > 1 else np.full(n, np.inf)
    out = []
    for step in range(n - 1):
        i = int(least.argmin())
        while near[i] < 0:
            near[i] = d[i].argmin()
            least[i] = d[i, near[i]]
            i = int(least.argmin())
        j = int(near[i])
        h = d[i, j]
        a, b, c = size[i], size[j], size
        x, y = d[i], d[j]
        new = _joined(method, x, y, h, a, b, c)
        height = math.sqrt(max(h, 0.0)) if method in ("ward", "centroid", "median") else float(h)
        left, right = sorted((int(node[i]), int(node[j])))
        out.append((left, right, height))
        alive[j] = False
        new[~alive] = np.inf
        new[i] = np.inf
        d[i], d[:, i] = new, new
        d[j], d[:, j] = np.inf, np.inf
        least[j] = np.inf
        size[i] += size[j]
        node[i] = n + step
        stale = alive & ((near == i) | (near == j))
        near[stale] = -1
        least[stale] = np.minimum(least[stale], new[stale])  # a bound still: only the distance to the merged pair changed
        closer = alive & ~stale & ((new < least) | ((new == least) & (i < near)))
        near[closer], least[closer] = i, new[closer]
        near[i] = new.argmin()
        least[i] = new[near[i]]
    order = sorted(range(n - 1), key=lambda s: (out[s][2], s)) if method not in ("centroid", "median") else range(n - 1)
    place = {n + s: n + k for k, s in enumerate(order)}
    return [(*sorted((place.get(out[s][0], out[s][0]), place.get(out[s][1], out[s][1]))), out[s][2]) for s in order]


class _Centres:
    """Centres of clusters by slot, of which those that are left are scanned as products in single precision with a stated error."""

    def __init__(self, points: np.ndarray):
        self.at = points.astype(float)
        self.middle = self.at.mean(axis=0)
        self.slots = np.arange(len(points))
        self._pack()

    def _pack(self) -> None:
        self.place = np.full(len(self.at), -1)
        self.place[self.slots] = np.arange(len(self.slots))
        self.flat = (self.at[self.slots] - self.middle).astype(np.float32)
        self.norm = np.einsum("ij,ij->i", self.flat, self.flat, dtype=float)
        self.most = float(self.norm.max(initial=0))
        self.gone = 0

    def drop(self, slot: int) -> None:
        self.norm[self.place[slot]] = np.inf
        self.gone += 1

    def move(self, slot: int, to: np.ndarray) -> None:
        k = self.place[slot]
        self.at[slot], self.flat[k] = to, to - self.middle
        self.norm[k] = float(np.square(self.flat[k], dtype=float).sum())  # a centre lies among the points: none is longer

    def pack(self) -> bool:
        """Whether places have changed, since a quarter of them was empty."""
        if self.gone * 4 < len(self.slots):
            return False
        self.slots = self.slots[np.isfinite(self.norm)]
        self._pack()
        return True

    def bounds(self, slot: int) -> tuple[np.ndarray, np.ndarray]:
        """At least and at most how far each place is from a centre; infinite for itself and for what is gone."""
        c = self.flat[self.place[slot]]
        square = self.norm - 2.0 * (self.flat @ c) + float(np.square(c, dtype=float).sum())
        square[self.place[slot]] = np.inf
        error = 16 * (len(c) + 8) * float(np.finfo(np.float32).eps) * self.most
        return np.sqrt(np.maximum(square - error, 0)), np.sqrt(np.maximum(square, 0) + error)

    def measured(self, slot: int, places: np.ndarray) -> np.ndarray:
        gap = self.at[self.slots[places]] - self.at[slot]
        return np.sqrt(np.einsum("ij,ij->i", gap, gap))

    def nearest(self, slot: int, places: np.ndarray) -> tuple[float, int]:
        """The least distance to some places, and the smallest slot at it."""
        d = self.measured(slot, places)
        near = d.min()
        return float(near), int(self.slots[places[d == near]].min())


def merge_centres(points: np.ndarray, method: str, least: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """G1 of centroid and median linkage without a table of distances: these are those of the clusters' centres. As ``merge``.

    ``least``: a lower bound of each point's nearest distance (none: 0). A cluster is searched only while its bound is the least. The cluster
    that was merged last is left out of the others' bounds; what is nearest to it comes from its last scan, as far as it has moved since.
    So a cluster that takes in one point after the other, as these linkages tend to, is scanned seldom while it moves little.
    """
    n = len(points)
    centres = _Centres(points)
    least = (np.zeros(n) if least is None else np.asarray(least, float).copy()) if n > 1 else np.zeros(n)
    near, size, node = np.full(n, -1), np.ones(n), np.arange(n)
    last, out = -1, []
    low = high = seen = None  # the last cluster's scan and where it was then

    def scan() -> None:
        nonlocal low, high, seen
        (low, high), seen = centres.bounds(last), centres.at[last].copy()

    def beside() -> tuple[float, int]:
        """The nearest to the last cluster."""
        for again in (True, False):
            moved = float(np.sqrt(np.square(centres.at[last] - seen).sum())) * _NEARLY
            places = np.flatnonzero(low <= (high.min() + 2 * moved) * _NEARLY)
            if len(places) * 16 <= len(low) + 512 or not again or not moved:
                break
            scan()
        return centres.nearest(last, places)

    for step in range(n - 1):
        own = (np.inf, -1, -1)
        if last >= 0:
            d, j = beside()
            own = (d, min(last, j), max(last, j))
        while True:
            i = int(least.argmin())
            if least[i] > own[0] or near[i] >= 0:
                break
            a, b = centres.bounds(i)
            if last >= 0:
                a[centres.place[last]] = b[centres.place[last]] = np.inf
            top = b.min()
            if np.isinf(top):
                least[i] = np.inf
                continue
            least[i], near[i] = centres.nearest(i, np.flatnonzero(a <= top))
        other = (float(least[i]), *sorted((i, int(near[i]))))
        h, i, j = min(own, other) if np.isfinite(other[0]) else own
        if last >= 0 and last not in (i, j):  # the others' bounds take it in again
            a, b = centres.bounds(last)
            closer = a < least[centres.slots]
            slots = centres.slots[closer]
            least[slots], near[slots] = a[closer], -1
            least[last], near[last] = a.min(), -1
        centres.move(i, centres.at[i] + (centres.at[j] - centres.at[i]) * (0.5 if method == "median" else size[j] / (size[i] + size[j])))
        centres.drop(j)
        out.append((*sorted((int(node[i]), int(node[j]))), h))
        size[i] += size[j]
        node[i] = n + step
        least[[i, j]] = np.inf
        near[(near == i) | (near == j)] = -1  # their bounds stand
        fresh = last not in (i, j)
        if not fresh and not centres.gone * 4 >= len(centres.slots):
            places = centres.place[[i, j]]
            low[places] = high[places] = np.inf
        last = i
        if centres.pack() or fresh:
            scan()
    return out


def bookkeeping(points: np.ndarray, merges: list[tuple[int, int, float]]) -> tuple[np.ndarray, list[int]]:
    """The height at which each leaf is first absorbed, and each merge's representative (the child's that is nearer the merged centroid, ties left)."""
    n = len(points)
    centre, size, rep = [*points.astype(float)], [1] * n, [*range(n)]
    joined = np.zeros(n)
    for left, right, height in merges:
        for child in (left, right):
            if child < n:
                joined[child] = height
        total = size[left] + size[right]
        c = (centre[left] * size[left] + centre[right] * size[right]) / total
        apart = [float(((points[rep[k]] - c) ** 2).sum()) for k in (left, right)]
        rep.append(rep[left] if apart[0] <= apart[1] * (1 + 1e-9) else rep[right])
        centre.append(c)
        size.append(total)
    return joined, rep[n:]


def cut(n: int, merges: list[tuple[int, int, float]], threshold: float, target: int) -> tuple[np.ndarray, dict[int, int], float]:
    """Labels by smallest member, each cluster's root node, and the last height applied.

    Merges are applied in order until the number of clusters reaches the target (if there is one), or the first height
    over the threshold (if there is one); with neither, none is applied.
    """
    want = max(1, min(target, n)) if target > 0 else None
    active = {i: (i, [i]) for i in range(n)}  # the smallest member, and all
    last = 0.0
    for step, (left, right, height) in enumerate(merges):
        if (want is not None and len(active) <= want) or (want is None and threshold <= 0) or (threshold > 0 and height > threshold):
            break
        (low, own), (other, more) = active.pop(left), active.pop(right)
        own, more = (own, more) if len(own) >= len(more) else (more, own)
        own += more
        active[n + step] = (min(low, other), own)
        last = height
    labels = np.zeros(n, np.int64)
    roots = {}
    for k, (node, (_, members)) in enumerate(sorted(active.items(), key=lambda a: a[1][0])):
        labels[members] = k
        roots[node] = k
    return labels, roots, last


def leaves_of(n: int, merges: list[tuple[int, int, float]]) -> list[int]:
    """Leaves left child first."""
    out, stack = [], [n + len(merges) - 1] if merges else [*range(n)][::-1]
    while stack:
        node = stack.pop()
        if node < n:
            out.append(node)
        else:
            stack += [merges[node - n][1], merges[node - n][0]]
    return out


def _least_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The min-plus product: for each row of a and column of b the least sum over what joins them.

    In large products a row takes its joints k by a[k] + u[k], u[k] the least of b[k], and stops where this and the least that b holds over u in a
    column exceed the sums already found: no later joint can give less. The margin is far above what rounding adds.
    """
    p, many = a.shape
    r = b.shape[1]
    if many >= 64 and p * many * r >= _LARGE:
        if p > r:
            return _least_sum(b.T, a.T).T
        b = np.ascontiguousarray(b)
        u = b.min(axis=1)
        low = (b - u[:, None]).min(axis=0)
        key = a + u
        bounds = (np.abs(key).max(), np.abs(low).max(), np.abs(a).max(), np.abs(b).max())
        if np.isfinite(bounds).all():
            margin = 1e-9 * max(bounds)
            return np.stack([_least_of_row(row, b, low, k - margin) for row, k in zip(a, key, strict=True)])
    if many <= p:
        out = a[:, :1] + b[:1]
        for k in range(1, many):
            np.minimum(out, a[:, k : k + 1] + b[k], out=out)
        return out
    return np.stack([(row[:, None] + b).min(axis=0) for row in a])


def _least_of_row(row: np.ndarray, b: np.ndarray, low: np.ndarray, key: np.ndarray) -> np.ndarray:
    """``_least_sum`` of one row; key[k] + low[j] is at most row[k] + b[k, j]."""
    order = np.argsort(key)
    key, n, r = key[order], len(order), len(low)
    at = step = 16
    best = (b[order[:at]] + row[order[:at], None]).min(axis=0)
    while at < n:
        need = best - low
        open_ = np.flatnonzero(need > key[at])
        if not len(open_):
            break
        if len(open_) * 3 > r:
            end = at + step
            some = order[at:end]
            np.minimum(best, (b[some] + row[some, None]).min(axis=0), out=best)
        else:
            end = min(int(np.searchsorted(key, need[open_].max())), at + 4 * step)
            some = order[at:end]
            best[open_] = np.minimum(best[open_], (b[some[:, None], open_] + row[some, None]).min(axis=0))
        at, step = end, min(2 * step, 64)
    return best


def optimal_order(dist: np.ndarray, merges: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """The merges with children flipped so that the sum of distances between neighbours round the ring is least.

    Bar-Joseph et al. (2001): best[a, b] is the least cost of a subtree's order from leaf a to leaf b. For a pair of
    subtrees the inner ends are minimised one after the other, as min-plus products. The ring is closed at
    the root, whose left side stays first; of equal costs the first is taken.
    """
    n = len(dist)
    if n < 3:
        return list(merges)
    best = np.full((n, n), np.inf)  # of a pair of leaves, for the smallest subtree that holds both
    meet = np.full((n, n), -1, np.int32)  # that subtree
    members = [np.array([i]) for i in range(n)]

    def within(node: int, a: int, x: np.ndarray) -> np.ndarray:
        """Costs of the subtree's orders from leaf a to each of its leaves x."""
        return np.where(meet[a, x] == node, best[a, x], np.inf) if node >= n else np.zeros(1)

    def across(node: int, gap: np.ndarray) -> np.ndarray:
        """For each leaf a of the subtree the least cost of an order from a, and on from its far end along ``gap``.

        The far end lies in the other child, so each child is tried against the other one only.
        """
        if node < n:
            return gap
        first, second, _ = merges[node - n]
        own, one = best[np.ix_(members[first], members[second])], len(members[first])
        return np.concatenate([_least_sum(own, gap[one:]), _least_sum(own.T, gap[:one])])

    for step, (left, right, _) in enumerate(merges):
        x, y = members[left], members[right]
        full = across(right, across(left, dist[np.ix_(x, y)]).T).T
        best[np.ix_(x, y)], best[np.ix_(y, x)] = full, full.T
        meet[np.ix_(x, y)] = meet[np.ix_(y, x)] = n + step
        members.append(np.concatenate([x, y]))
    out = list(merges)
    left, right, _ = merges[-1]
    x, y = members[left], members[right]
    closed = best[np.ix_(x, y)] + dist[np.ix_(x, y)]
    i, j = np.unravel_index(closed.argmin(), closed.shape)
    todo = [(n + len(merges) - 1, int(x[i]), int(y[j]))]
    while todo:
        node, a, b = todo.pop()
        if node < n:
            continue
        left, right, height = merges[node - n]
        x, y = members[left], members[right]
        flip = a not in set(x.tolist())
        if flip:
            left, right, x, y = right, left, y, x
        out[node - n] = (left, right, height)
        total = within(left, a, x)[:, None] + dist[np.ix_(x, y)] + within(right, b, y)[None, :]
        i, j = np.unravel_index(total.argmin(), total.shape)
        todo += [(left, a, int(x[i])), (right, int(y[j]), b)]
    return out


def ring_cost(dist: np.ndarray, order: list[int]) -> float:
    """The sum of distances between neighbours, last to first included."""
    return float(sum(dist[a, b] for a, b in zip(order, order[1:] + order[:1], strict=True)))


def ring_colours(ring: list[int], n_labels: int, slots: int = SLOTS) -> list[int]:
    """A slot for each label, by default its remainder; neighbours on the ring differ where that can be."""
    slot = [k % slots for k in range(n_labels)]
    for at, label in enumerate(ring[1:], 1):
        before, after = slot[ring[at - 1]], slot[ring[(at + 1) % len(ring)]]
        if slot[label] == before or (at == len(ring) - 1 and slot[label] == after):
            free = ((slot[label] + k) % slots for k in range(1, slots))
            slot[label] = next((s for s in free if s not in (before, after)), slot[label])
    return slot


def cluster(points: np.ndarray, method: str = "complete", threshold: float = 0.25, target: int = 0, order: bool = True, known: tuple[float, np.ndarray] | None = None) -> dict:
    """Everything that a session's clustering yields, in unit-diameter space. Without ``order`` leaves stay
    in the order of the merges as they were found, which spares the dearest step where no places or angles are asked for.
    ``known``: the largest distance and a lower bound of each point's nearest one; with these, and without ``order``, central linkages need no table of distances."""
    points = np.asarray(points, dtype=float)
    n = len(points)
    if known is not None and method in CENTRAL and not order:
        widest, least = known
        if widest > 0:
            points, least = points / widest, least / widest
        merges = merge_centres(points, method, least)
    else:
        if n > MOST_ITEMS:
            raise ValueError(f"more than {MOST_ITEMS} items in one session")
        dist = distances(points)
        widest = dist.max() if n else 0.0
        if widest > 0:
            dist /= widest
            points = points / widest
        merges = merge(dist, method) if n > 1 else []
    joined, rep = bookkeeping(points, merges)
    labels, roots, cut_height = cut(n, merges, threshold, target)
    merges = optimal_order(dist, merges) if order else merges
    ring_order = leaves_of(n, merges)
    angle = np.zeros(n)
    angle[ring_order] = 2 * math.pi * (np.arange(n) + 0.5) / max(n, 1)
    ring = list(dict.fromkeys(labels[ring_order].tolist()))
    colours = ring_colours(ring, len(roots))
    stats = []
    for node, k in sorted(roots.items(), key=lambda r: r[1]):
        own = labels == k
        stats.append({"k": k, "size": int(own.sum()), "centroid": points[own].mean(axis=0).tolist(), "diameter": float(merges[node - n][2]) if node >= n else 0.0, "cluster_angle": float(angle[own].mean()), "color_index": colours[k]})
    return {"merges": [(*m, r) for m, r in zip(merges, rep, strict=True)], "join_height": joined, "leaf_angle": angle, "labels": labels, "cut_height": cut_height, "order": ring_order, "stats": stats}


ASSIGNMENTS = "session_id string, id long, idx int, k int, join_height double, leaf_angle double, cluster_angle double, color_index int"
MERGES = "session_id string, step int, `left` int, `right` int, height double, representative int"
_BOTH = f"{ASSIGNMENTS}, {MERGES.split(', ', 1)[1]}"


def _grouped(items: bool, merges: bool, method: str, threshold: float, target: int, order: bool):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", kind="stable")
        session = group["session_id"].iloc[0]
        known = (float(group["widest"].iloc[0]), group["least"].to_numpy()) if "least" in group else None
        r = cluster(np.stack(group["features"].to_numpy()), method, threshold, target, order, known)
        tree = pd.DataFrame([(session, s, *m) for s, m in enumerate(r["merges"])], columns=["session_id", "step", "left", "right", "height", "representative"])
        by = r["stats"]
        k = r["labels"]
        own = pd.DataFrame({
            "session_id": session, "id": group["id"].to_numpy(), "idx": np.arange(len(group)), "k": k, "join_height": r["join_height"], "leaf_angle": r["leaf_angle"],
            "cluster_angle": [by[x]["cluster_angle"] for x in k], "color_index": [by[x]["color_index"] for x in k],
        })
        if not (items and merges):
            return own if items else tree
        both = pd.concat([own, tree], ignore_index=True)
        whole = ["id", "idx", "k", "color_index", "step", "left", "right", "representative"]
        return both.astype(dict.fromkeys(whole, "Int64"))[[f.split()[0].strip("`") for f in _BOTH.split(", ")]]

    return run


def _bounds(vectors: DataFrame) -> DataFrame:
    """(session_id, id, least, widest): a lower bound of each item's nearest distance (infinite for one alone), and the session's largest distance.

    Every pair of blocks of a session is a bounded group."""

    def run(table: pa.Table) -> pa.Table:
        own, ids = table.column("block").to_numpy(), table.column("id")
        x = np.asarray(table.column("features").combine_chunks().flatten(), dtype=np.float64).reshape(len(own), -1)
        a, b = (np.flatnonzero(own == table.column(c)[0].as_py()) for c in ("p", "q"))
        same = table.column("p")[0].as_py() == table.column("q")[0].as_py()
        least, most = np.full(len(own), np.inf), 0.0
        for k, g, error in pairs.squares(x[a], x[b]):
            rows = a[k : k + len(g)]
            g[np.isnan(g)] = 0
            if g.size and (top := g.max()) >= most * most * (1 - 1e-9) - error:
                i, j = np.nonzero(g >= top - 2 * error)
                most = max(most, float(np.nanmax(pairs.measured(x, x, rows[i], b[j]))))
            if same:
                g[np.arange(len(g)), np.arange(k, k + len(g))] = np.inf
            least[rows] = np.minimum(least[rows], g.min(axis=1, initial=np.inf) - error)
            least[b] = np.minimum(least[b], g.min(axis=0, initial=np.inf) - error)
        session = pa.array([table.column("session_id")[0].as_py()] * len(own), pa.string())
        return pa.table({"session_id": session, "id": ids, "least": np.sqrt(np.maximum(least, 0)) * (1 - 1e-9), "widest": np.full(len(own), most)})

    n = vectors.groupBy("session_id").agg(F.count("*").alias("n"))
    many = F.ceil(F.col("n") / F.least(F.lit(pairs.MOST), F.greatest(F.lit(pairs.BLOCK), F.ceil(F.col("n") / pairs.PARTS)))).cast("int")
    most = n.agg(F.max(many)).first()[0] or 1
    placed = vectors.join(n.select("session_id", many.alias("many")), "session_id").withColumn("block", F.pmod(F.xxhash64("id"), F.col("many")).cast("int"))
    other = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
    keyed = other.select("session_id", F.least("block", "o").alias("p"), F.greatest("block", "o").alias("q"), "block", "id", F.col("features").cast("array<double>").alias("features"))
    # the rows are few, the work on them is not
    found = keyed.repartition(max(8, min(2000, most * (most + 1) // 2)), "session_id", "p", "q").groupBy("session_id", "p", "q").applyInArrow(run, "session_id string, id long, least double, widest double")
    each = stored(found.groupBy("session_id", "id").agg(F.min("least").alias("least"), F.max("widest").alias("most")), "bounds")
    return each.join(each.groupBy("session_id").agg(F.max("most").alias("widest")), "session_id").select("session_id", "id", "least", "widest")


def _by_session(vectors: DataFrame, run, schema: str, bounded: bool) -> DataFrame:
    items = vectors.select("session_id", "id", "features")
    if bounded:
        items = items.join(_bounds(items), ["session_id", "id"])
    return items.groupBy("session_id").applyInPandas(run, schema)


def assignments(vectors: DataFrame, method: str = "complete", threshold: float = 0.25, target: int = 0, order: bool = True) -> DataFrame:
    """Clustering of every session of ``vectors`` (session_id, id, features)."""
    return _by_session(vectors, _grouped(True, False, method, threshold, target, order), ASSIGNMENTS, method in CENTRAL and not order)


def dendrogram(vectors: DataFrame, method: str = "complete", order: bool = True) -> DataFrame:
    """The merges of every session, by default with their children in the leaves' best order."""
    return _by_session(vectors, _grouped(False, True, method, 0.0, 0, order), MERGES, method in CENTRAL and not order)


def clustered(vectors: DataFrame, method: str = "complete", threshold: float = 0.25, target: int = 0, order: bool = True) -> tuple[DataFrame, DataFrame]:
    """Assignments and merges of every session, clustered once and stored."""
    both = stored(_by_session(vectors, _grouped(True, True, method, threshold, target, order), _BOTH, method in CENTRAL and not order), "clustered")
    columns = lambda schema: [F.col(f.split()[0].strip("`")).alias(f.split()[0].strip("`")) for f in schema.split(", ")]  # noqa: E731  (new columns: the two may be joined)
    return both.where("step is null").select(*columns(ASSIGNMENTS)), both.where("step is not null").select(*columns(MERGES))


def statistics(items: DataFrame, keys: list[str], features: str = "features") -> DataFrame:
    """A7 without a group in one task: size and centroid (mean vector) of every cluster of ``items`` by ``keys``."""
    return items.groupBy(*keys).agg(F.count("*").alias("size"), vector_to_array(Summarizer.mean(array_to_vector(F.col(features).cast("array<double>")))).alias("centroid"))
