"""Gradient-boosted trees for two classes, by histograms of bins (Friedman, 2001).

``Boosted.fit`` takes arrays and bins of quantiles. ``fit_table`` takes a table of any size, whose features are binned and whose equal rows are counted: a level
of the trees of all kinds is one aggregate over the whole table, of which the driver sees sums by node, feature and bin.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from cairnflow.llm import textvec as tv
from cairnflow.llm.shared import discard, stored

BINS = 32
#: Sums over a table are whole multiples of 1/UNIT, so that they do not depend on their order.
UNIT = 1 << 20
#: Scores are told apart in so many steps where thresholds are set.
STEPS = 1 << 16
#: After so many trees the blocks are written anew, with their scores so far.
KEPT = 10
#: Rows of a block, and of a task's blocks.
BLOCK, SHARE = 1 << 16, 1 << 17


class Boosted:
    """Trees of equal depth; the branches of node i are 2i + 1 (value up to the cut) and 2i + 2."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, damping: float = 1.0):
        self.trees, self.depth, self.rate, self.damping = trees, depth, rate, damping
        self.start, self.grown = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        share = (y.sum() + 0.5) / (len(y) + 1)
        self.start = float(np.log(share / (1 - share)))
        cuts = [np.unique(np.quantile(column, np.linspace(0, 1, BINS)[1:-1])) for column in x.T]
        binned = np.stack([np.searchsorted(c, column, "left") for c, column in zip(cuts, x.T, strict=True)], axis=1)
        score = np.full(len(y), self.start)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            feature, cut, leaf, at = self._grow(binned, cuts, p - y, p * (1 - p))
            self.grown.append((feature, cut, leaf))
            score += leaf[at]
        return self

    def _grow(self, binned: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> tuple:
        inner, rows = (1 << self.depth) - 1, np.arange(len(g))
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(g), np.int64)
        for level in range(self.depth):
            first, n = (1 << level) - 1, 1 << level
            best, place = self.best(histograms(binned, at - first, n, g, h))
            for node in np.flatnonzero(place < BINS):
                feature[first + node], cut[first + node] = best[node], cuts[best[node]][place[node]]
            at = 2 * at + 1 + (binned[rows, best[at - first]] > place[at - first])
        at -= inner
        sums = [np.bincount(at, w, inner + 1) for w in (g, h)]
        return feature, cut, -self.rate * sums[0] / (sums[1] + self.damping), at

    def best(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Feature and last lower bin of each node's best cut (bin ``BINS``: none gains anything), from sums as ``histograms`` gives them."""
        left = sums.cumsum(axis=-1)
        whole = left[..., -1:]
        worth = lambda s: s[0] ** 2 / (s[1] + self.damping)
        gain = (worth(left) + worth(whole - left) - worth(whole)).reshape(sums.shape[1], -1)
        at = gain.argmax(axis=1)
        fine = gain[np.arange(len(at)), at] > 1e-6
        return np.where(fine, at // BINS, 0), np.where(fine, at % BINS, BINS)

    def leaves(self, sums: np.ndarray, feature: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Values on both sides of the last level's cuts."""
        left, nodes = sums.cumsum(axis=-1), np.arange(len(feature))
        below = left[:, nodes, feature, np.minimum(place, BINS - 1)]
        g, h = np.stack([below, left[:, nodes, feature, -1] - below], axis=-1).reshape(2, -1)
        return -self.rate * g / (h + self.damping)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1."""
        return 1 / (1 + np.exp(-self.start - gained(x, self.grown, self.depth)))


def reached(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """The node that each row comes to, counted from the first of its level."""
    at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    for _ in range(levels):
        at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
    return at - ((1 << levels) - 1)


def gained(x: np.ndarray, grown: list[tuple], depth: int) -> np.ndarray:
    """What trees add to the scores of rows."""
    score = np.zeros(len(x))
    for feature, cut, leaf in grown:
        score += leaf[reached(x, feature, cut, depth)]
    return score


def histograms(binned: np.ndarray, node: np.ndarray, nodes: int, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Sums of g and of h by node, feature and bin."""
    out, node = np.empty((2, nodes, binned.shape[1], BINS)), node * BINS
    for k in range(binned.shape[1]):
        cell = node + binned[:, k]
        for i, w in enumerate((g, h)):
            out[i, :, k] = np.bincount(cell, w, nodes * BINS).reshape(nodes, BINS)
    return out


_BLOCK = "kind string, tested boolean, x binary, n binary, good binary, score binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one kind in blocks, feature by feature."""
    held: dict[tuple, list] = {}
    for batch in batches:
        for kind in batch.column("kind").unique().to_pylist():
            for tested in (False, True):
                part = batch.filter(pa.compute.and_(pa.compute.equal(batch.column("kind"), kind), pa.compute.equal(batch.column("tested"), tested)))
                if part.num_rows:
                    held.setdefault((kind, tested), []).append(part)
                if sum(p.num_rows for p in held.get((kind, tested), [])) >= BLOCK:
                    yield _block(kind, tested, held.pop((kind, tested)))
    for (kind, tested), parts in held.items():
        yield _block(kind, tested, parts)


def _block(kind: str, tested: bool, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    x = np.concatenate([tv.buffers(p.column("x"))[0].reshape(p.num_rows, -1) for p in parts])
    n, good = (np.concatenate([np.asarray(p.column(c)) for p in parts]) for c in ("n", "good"))
    made = [pa.array([w.tobytes()], pa.binary()) for w in (x.T, n, good, np.zeros(len(n)))]
    return pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([tested]), *made], names=["kind", "tested", "x", "n", "good", "score"])


def _arrays(r: Row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = np.frombuffer(r.n, np.int64)
    return np.frombuffer(r.x, np.uint8).reshape(-1, len(n)).T, n, np.frombuffer(r.good, np.int64), np.frombuffer(r.score)


def _level(models: dict[str, Boosted], since: dict[str, list], growing: dict[str, tuple], level: int) -> Callable:
    """Sums of gradients and curvatures by kind, node, feature and bin over a task's blocks."""
    starts, depth = {k: m.start for k, m in models.items()}, {k: m.depth for k, m in models.items()}

    def run(rows: Iterator[Row]) -> Iterator[tuple[str, np.ndarray]]:
        total: dict[str, np.ndarray] = {}
        for r in rows:
            if r.kind in starts and not r.tested:
                x, n, good, score = _arrays(r)
                p = 1 / (1 + np.exp(-starts[r.kind] - score - gained(x, since[r.kind], depth[r.kind])))
                g, h = (np.rint(w * UNIT) for w in (n * p - good, n * p * (1 - p)))
                total[r.kind] = total.get(r.kind, 0) + histograms(x, reached(x, *growing[r.kind], level), 1 << level, g, h)
        yield total

    return run


def _merged(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {k: a[k] + b[k] if k in a and k in b else a.get(k, b.get(k)) for k in {*a, *b}}


def _scored(since: dict[str, list], depth: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in (Row(**r) for r in batch.to_pylist()):
                x, _, _, score = _arrays(r)
                out.append((score + gained(x, since.get(r.kind, []), depth)).tobytes())
            yield batch.set_column(batch.schema.get_field_index("score"), "score", pa.array(out, pa.binary()))

    return run


def _stepped(models: dict[str, Boosted], since: dict[str, list]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in (Row(**r) for r in batch.to_pylist()):
                if r.kind in models:
                    x, n, good, score = _arrays(r)
                    p = 1 / (1 + np.exp(-models[r.kind].start - score - gained(x, since[r.kind], models[r.kind].depth)))
                    step, of = np.unique(steps(p), return_inverse=True)
                    counts = [np.bincount(of, w).astype(np.int64) for w in (n, good)]
                    yield pa.RecordBatch.from_arrays([pa.array([r.kind] * len(step), pa.string()), pa.array(step), *map(pa.array, counts)], names=["kind", "step", "n", "good"])

    return run


def fit_table(rows: DataFrame, cuts: np.ndarray, precision: float, **shape: float) -> tuple[dict[str, Boosted], dict[str, float]]:
    """A model and its threshold for each kind, from all rows: kind, x (binary: the bin of each feature, by ``cuts``), tested, n (how many rows are equal) and
    good (how many of them are of class 1). Tested rows set the threshold, the others grow the trees; a kind that lacks either has no model."""
    total = rows.groupBy("kind", "tested").agg(F.count("*").alias("rows"), F.sum("n").alias("n"), F.sum("good").alias("good")).collect()
    models, tested = {}, {r.kind for r in total if r.tested}
    for r in sorted(total, key=lambda r: r.kind):
        if not r.tested and r.kind in tested and 0 < r.good < r.n:
            models[r.kind] = Boosted(**shape)
            share = (r.good + 0.5) / (r.n + 1)
            models[r.kind].start = float(np.log(share / (1 - share)))
    if not models:
        return {}, {}
    trees, depth = (getattr(next(iter(models.values())), a) for a in ("trees", "depth"))
    inner, tasks = (1 << depth) - 1, -(-sum(r.rows for r in total) // SHARE)
    blocks, since = stored(rows.coalesce(tasks).mapInArrow(_blocks, _BLOCK), "blocks"), {k: [] for k in models}
    passed = blocks.rdd.coalesce(tasks)
    bounds = np.array([*cuts, *[np.inf] * (BINS + 1 - len(cuts))])
    for t in range(trees):
        if t and t % KEPT == 0:
            before, blocks = blocks, stored(blocks.coalesce(tasks).mapInArrow(_scored(since, depth), _BLOCK), "blocks")
            discard(before)
            passed, since = blocks.rdd.coalesce(tasks), {k: [] for k in models}
        growing = {k: (np.zeros(inner, np.int64), np.full(inner, BINS)) for k in models}
        for level in range(depth):
            begin, end = (1 << level) - 1, (2 << level) - 1
            sums = passed.mapPartitions(_level(models, since, growing, level)).treeReduce(_merged)
            for kind, (feature, place) in growing.items():
                sums[kind] /= UNIT
                feature[begin:end], place[begin:end] = models[kind].best(sums[kind])
        for kind, (feature, place) in growing.items():
            leaf = models[kind].leaves(sums[kind], feature[begin:], place[begin:])
            since[kind].append((feature, place, leaf))
            models[kind].grown.append((feature, bounds[place], leaf))
    found = blocks.where("tested").mapInArrow(_stepped(models, since), "kind string, step double, n long, good long")
    found = found.groupBy("kind", "step").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).toArrow()
    discard(blocks)
    thresholds = {}
    for kind in models:
        mine = found.filter(pa.compute.equal(found.column("kind"), kind))
        thresholds[kind] = threshold(*(np.asarray(mine.column(c)) for c in ("step", "good")), precision, np.asarray(mine.column("n")))
    return models, thresholds


def steps(p: np.ndarray) -> np.ndarray:
    """Probabilities, rounded down to whole steps."""
    return np.floor(np.asarray(p) * STEPS) / STEPS


def threshold(p: np.ndarray, y: np.ndarray, precision: float, n: np.ndarray | None = None) -> float:
    """Midway below the smallest probability from which on so large a share of what is taken is of class 1 (above 1: there is none).

    With ``n``, an entry stands for n rows, of which y are of class 1.
    """
    order = np.argsort(-p, kind="stable")
    good = np.cumsum(y[order]) / np.cumsum(np.ones(len(p), np.int64) if n is None else n[order])
    last = np.concatenate([p[order][1:] != p[order][:-1], [True]]) if len(p) else np.zeros(0, bool)  # equal scores are taken together
    fine = np.flatnonzero((good >= precision) & last)
    if not len(fine):
        return 2.0
    least, rest = p[order][fine[-1]], p[order][fine[-1] + 1 :]
    return float((least + (rest[0] if len(rest) else 0)) / 2)
