"""Hard negatives by bit-sliced integer products.

Components become integers, floor(``SCALE`` * x). A row's integers less their smallest are cut into bit-planes, and an anchor's inner
product with a row is a sum of products with its planes. Planes are taken most significant first: after each one the
product is known within an interval, whose width halves with every plane. A pair of anchor and row is dropped as
soon as its interval cannot qualify; what is left after the last plane has its exact product.

Anchors meet all other rows in bounded blocks, twice:

1. Positives: within a label, an anchor's rows are dropped whose interval ends below the k-th largest beginning.
2. Negatives: rows of other labels are dropped whose interval meets no positive's window (``least`` percent of the
   positive's score to that score), or lies below the k-th largest beginning among those surely inside each window.

Each block returns k rows at most for each anchor (and positive), and the k best of these make the result.

Defined results: rows take no part that have a null id, label or vector, a null or non-finite component, or
another number of components than most; rows that repeat an id count once, as the one of smallest label, then smallest vector; "other"
rows are those of another id; ties go to the smaller id; an anchor without positives, or a positive without
negatives, has no rows. Products beyond 64 bits are refused with an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnflow.llm.shared import discard, lean_batches, stored

SCALE = 256
#: Positives of an anchor, and negatives of a positive.
K = 5
#: The least share of a positive's score that a negative has, in percent.
LEAST = 80
#: Rows of a block, anchors of a block, and anchors whose pairs are held at once.
BLOCK, ANCHORS, AT_ONCE = 8192, 4096, 256
#: The share of pairs left below which planes are multiplied pair by pair.
SPARSE = 0.05
_NONE = -(2**62)


def integers(column: pa.ChunkedArray) -> np.ndarray:
    """floor(SCALE * x) of every component: exact floats where products are sure to be, else Python's integers."""
    flat = np.asarray(column.combine_chunks().flatten(), dtype=np.float64)
    out = np.floor(flat * SCALE).reshape(len(column), -1)
    return out if _exact(out, out) else np.array([int(v) for v in out.ravel()], dtype=object).reshape(out.shape)


def _exact(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether all partial sums of products of rows of x with planes of y are integers that doubles hold."""
    top = lambda a: max(1.0, float(np.abs(a).max(initial=0)))
    return x.shape[1] * top(x) * top(y) * 4 < 2**52 if x.size and y.size else True


class Planes:
    """Rows of integers, cut into bit-planes; ``low`` stands in for what all components have at least."""

    def __init__(self, rows: np.ndarray):
        self.low = min(rows.min(initial=0), 0)
        rest = rows - self.low
        self.bits = int(rest.max(initial=0)).bit_length()
        rest = rest if rest.dtype == object else rest.astype(np.int64)
        kind = object if rows.dtype == object else np.float64
        self.at = [((rest >> b) & 1).astype(kind) for b in range(self.bits)]


def products(anchors: np.ndarray, planes: Planes, alive: np.ndarray, narrowed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (anchor, row) still alive after all planes, with their products.

    ``alive``: the pairs to begin with. ``narrowed(i, j, lo, hi)`` is given pairs, ordered by anchor, with their intervals, and says which
    may still qualify.
    """
    up, down = np.maximum(anchors, 0).sum(axis=1), np.minimum(anchors, 0).sum(axis=1)
    i, j = np.nonzero(alive)
    whole = np.repeat((anchors.sum(axis=1) * planes.low)[:, None], alive.shape[1], axis=1)
    known = whole[i, j]
    dense = True
    for b in range(planes.bits - 1, -1, -1):
        if dense and len(i) < SPARSE * alive.size:
            known, dense = whole[i, j], False
        if dense:
            whole += anchors @ planes.at[b].T * (1 << b)
            known = whole[i, j]
        else:
            known = known + _pairwise(anchors, planes.at[b], i, j) * (1 << b)
        rest = (1 << b) - 1
        keep = narrowed(i, j, known + down[i] * rest, known + up[i] * rest)
        i, j, known = i[keep], j[keep], known[keep]
    return i, j, known


def _pairwise(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, most: int = 1 << 16) -> np.ndarray:
    parts = [(x[i[a : a + most]] * y[j[a : a + most]]).sum(axis=1) for a in range(0, len(i), most)]
    return np.concatenate(parts) if parts else np.zeros(0, x.dtype)


def _sortable(x: np.ndarray) -> np.ndarray:
    """x, or for Python's integers their ranks."""
    return np.unique(x, return_inverse=True)[1] if x.dtype == object else x


def _kth(i: np.ndarray, value: np.ndarray, n: int, k: int) -> np.ndarray:
    """For each of n anchors the k-th largest of its values (_NONE with fewer)."""
    order = np.lexsort((-_sortable(value), i))
    first = np.searchsorted(i[order], np.arange(n + 1))
    at = first[:-1] + k - 1
    out = np.full(n, _NONE, value.dtype)
    some = at < first[1:]
    out[some] = value[order[at[some]]]
    return out


def _first(i: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each i: by score, then by the smaller id."""
    order = np.lexsort((ids, -_sortable(score), i))
    sorted_i = i[order]
    place = np.arange(len(order)) - np.searchsorted(sorted_i, sorted_i)
    return order[place < k]


def _long(x: np.ndarray) -> pa.Array:
    """Products as 64-bit integers; larger ones raise."""
    return pa.array([int(v) for v in x], pa.int64())


def _positives(k: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = [[], [], []]
        if anchors.num_rows and rows.num_rows:
            a, x, a_ids, ids = *_same(integers(anchors.column("anchor")), integers(rows.column("v"))), anchors.column("anchor_id").to_numpy(), rows.column("vec_id").to_numpy()
            planes = Planes(x)
            for s in range(0, len(a), AT_ONCE):
                own, mine = a[s : s + AT_ONCE], a_ids[s : s + AT_ONCE]
                i, j, score = products(own, planes, mine[:, None] != ids[None, :], lambda i, j, lo, hi, n=len(own): hi >= _kth(i, lo, n, k)[i])
                best = _first(i, score, ids[j], k)
                for column, part in zip(out, (mine[i[best]], ids[j[best]], score[best]), strict=True):
                    column.extend(part)
        return pa.table({"anchor_id": pa.array(out[0], pa.int64()), "positive_id": pa.array(out[1], pa.int64()), "positive_score": _long(out[2])})

    return run


def _negatives(k: int, least: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = [[] for _ in range(4)]
        if anchors.num_rows and rows.num_rows:
            a, x, a_ids, ids = *_same(integers(anchors.column("anchor")), integers(rows.column("v"))), anchors.column("anchor_id").to_numpy(), rows.column("vec_id").to_numpy()
            labels, others = anchors.column("anchor_label").to_numpy(), rows.column("label").to_numpy()
            wanted = [np.array(w.as_py() or [], dtype=object if a.dtype == object else np.float64) for w in anchors.column("positives")]
            planes = Planes(x)
            for s in range(0, len(a), AT_ONCE):
                own, mine, tops = a[s : s + AT_ONCE], a_ids[s : s + AT_ONCE], wanted[s : s + AT_ONCE]
                n, most = len(own), max(map(len, tops))
                top = np.full((n, most), _NONE, own.dtype)
                for r, t in enumerate(tops):
                    top[r, : len(t)] = t
                floor = -((-least * top) // 100)

                def narrowed(i, j, lo, hi, top=top, floor=floor, n=n):
                    keep = np.zeros(len(i), bool)
                    for p in range(top.shape[1]):
                        ends, begins = top[i, p], floor[i, p]
                        meets = (ends > _NONE) & (lo <= ends) & (hi >= begins)
                        sure = meets & (lo >= begins) & (hi <= ends)
                        keep |= meets & (hi >= _kth(i[sure], lo[sure], n, k)[i])
                    return keep

                i, j, score = products(own, planes, labels[s : s + AT_ONCE, None] != others[None, :], narrowed)
                for p in range(most):
                    inside = np.flatnonzero((top[i, p] > _NONE) & (score <= top[i, p]) & (score >= floor[i, p]))
                    best = inside[_first(i[inside], score[inside], ids[j[inside]], k)]
                    for column, part in zip(out, (mine[i[best]], top[i[best], p], ids[j[best]], score[best]), strict=True):
                        column.extend(part)
        return pa.table({"anchor_id": pa.array(out[0], pa.int64()), "positive_score": _long(out[1]), "negative_id": pa.array(out[2], pa.int64()), "negative_score": _long(out[3])})

    return run


def _same(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as floats if all their products are exact, else both as Python's integers."""
    if a.dtype != object and x.dtype != object and _exact(a, x):
        return a, x
    return tuple(m if m.dtype == object else np.array([int(v) for v in m.ravel()], dtype=object).reshape(m.shape) for m in (a, x))


def sound(vectors: DataFrame, label: Column) -> DataFrame:
    """(vec_id, label, v): the rows that take part, one for each id."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    rows = vectors.select("vec_id", label.alias("label"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & finite)
    widths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    rows = rows.where(F.size("v") == (widths[0].d if widths else 0))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("row")).select("vec_id", "row.*")


def mine(vectors: DataFrame, anchors: Column, label: Column | None = None, k: int = K, least: int = LEAST) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of ``vectors`` (vec_id, embedding, label) where ``anchors`` holds."""
    lean_batches(vectors)
    rows = stored(sound(vectors, F.col("label") if label is None else label), "rows")
    asked = rows.where(anchors).select(F.col("vec_id").alias("anchor_id"), F.col("label").alias("anchor_label"), F.col("v").alias("anchor"))
    one_of = lambda key, n: F.pmod(F.xxhash64(key), n).cast("int")
    each_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    parts = lambda n, most: F.ceil(F.col(n) / most).cast("int")
    sizes = rows.groupBy("label").agg(F.count("*").alias("n"), F.count_if(anchors).alias("n_anchors"))
    by_label = stored(sizes.where("n_anchors > 0").select("label", parts("n", BLOCK).alias("parts"), parts("n_anchors", ANCHORS).alias("blocks")), "shape")

    key = ["label", "part", "block"]
    left = asked.withColumnRenamed("anchor_label", "label").join(by_label, "label").withColumn("block", one_of("anchor_id", F.col("blocks"))).withColumn("part", each_of("parts")).select(*key, "anchor_id", "anchor")
    right = rows.join(by_label, "label").withColumn("part", one_of("vec_id", F.col("parts"))).withColumn("block", each_of("blocks")).select(*key, "vec_id", "v")
    near = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_positives(k), "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    positives = stored(near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k), "positives")

    shape = rows.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / BLOCK)).cast("int").alias("parts"), F.greatest(F.lit(1), F.ceil(F.count_if(anchors) / ANCHORS)).cast("int").alias("blocks"))
    shape = F.broadcast(stored(shape, "shape"))  # one row
    tops = positives.groupBy("anchor_id").agg(F.collect_set("positive_score").alias("positives"))  # k at most
    key = ["part", "block"]
    left = asked.join(tops, "anchor_id").crossJoin(shape).withColumn("block", one_of("anchor_id", F.col("blocks"))).withColumn("part", each_of("parts")).select(*key, "anchor_id", "anchor_label", "anchor", "positives")
    right = rows.crossJoin(shape).withColumn("part", one_of("vec_id", F.col("parts"))).withColumn("block", each_of("blocks")).select(*key, "vec_id", "label", "v")
    far = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_negatives(k, least), "anchor_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    negatives = stored(far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "negatives")
    discard(rows)
    return positives.join(negatives, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
