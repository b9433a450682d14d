"""Approximate nearest neighbours by cosine, with a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample (``SAMPLE`` vectors, and ``PER_LEAF`` for each leaf), with a leaf for every ``LEAF``
vectors up to ``MOST_LEAVES``, since the tree is sent to all workers. Every vector is then filed under its leaf. A
query walks the tree with a priority queue: down to the nearest leaf first, then on from the nearest branch left
aside. How many leaves it visits is calibrated: visits are widened on sample queries until their recall against
brute force over the sample reaches ``RECALL``. Neighbouring leaves make up bins of at most ``BLOCK`` vectors. A query travels
once to each bin in which it visits leaves, with the list of these; a bin's vectors travel once for every ``QUERIES`` queries, and not
at all where none comes; leaves larger than a bin are dealt over several blocks. Scores are computed in double precision on the
original vectors.

Defined results: vectors that are null, zero, of another length than most, or hold a null or a non-finite
component take no part, nor do null ids; rows that repeat an id with the same vector count once, and of several
vectors of one id the nearest counts; with fewer candidates than asked for, all are returned; ties go to the smaller id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnflow.llm.shared import discard, lean_batches, stored

SAMPLE, PER_LEAF = 16_384, 16
BRANCHES = 8
#: Vectors for a leaf, and most leaves.
LEAF, MOST_LEAVES = 400, 8192
#: What the sample must reach; the contract asks for 0.9.
RECALL = 0.95
PROBES = 128
#: Rows of a block of candidates (fewer in small tables, so that all tasks have some), and of queries.
BLOCK, QUERIES = 8192, 8192
SMALL, BINS = 1024, 64


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(10):
        own = (x @ centres.T).argmax(axis=1)
        for c in range(k):
            if (own == c).any():
                m = x[own == c].mean(axis=0)
                centres[c] = m / max(np.sqrt((m * m).sum()), 1e-12)
    return centres, (x @ centres.T).argmax(axis=1)


class Tree:
    """Nodes with the unit centres of their branches; ``children[i]`` are nodes, or leaves as -1 - leaf."""

    def __init__(self, sample: np.ndarray, leaves: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.n_leaves = 0
        self.root = self._grow(sample, leaves, rng)
        self.visits = self.n_leaves

    def _grow(self, x: np.ndarray, leaves: int, rng: np.random.Generator) -> int:
        k = min(BRANCHES, leaves, len(x))
        centres, own = _kmeans(x, k, rng) if k > 1 else (x[:0], None)
        if k < 2 or len(np.unique(own)) < 2:
            self.n_leaves += 1
            return -self.n_leaves
        node = len(self.centres)
        self.centres.append(centres)
        self.children.append([])
        shares = np.maximum(1, np.round(np.bincount(own, minlength=k) / len(x) * leaves)).astype(int)
        for c in range(k):
            self.children[node].append(self._grow(x[own == c], int(shares[c]), rng))
        return node

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each unit vector."""
        out = np.full(len(x), -1, np.int64)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -1 - node
                continue
            own = (x[rows] @ self.centres[node].T).argmax(axis=1)
            todo += [(child, rows[own == c]) for c, child in enumerate(self.children[node]) if (own == c).any()]
        return out

    def best_first(self, q: np.ndarray, visits: int) -> list[int]:
        """The first leaves that a unit query visits."""
        queue, out, n = [(0.0, 0, self.root)], [], 1
        while queue and len(out) < visits:
            _, _, node = heapq.heappop(queue)
            while node >= 0:
                near = self.centres[node] @ q
                best = int(near.argmax())
                for c, child in enumerate(self.children[node]):
                    if c != best:
                        heapq.heappush(queue, (-float(near[c]), n, child))
                        n += 1
                node = self.children[node][best]
            out.append(-1 - node)
        return out

    def calibrate(self, sample: np.ndarray, k: int, goal: float = RECALL) -> None:
        """Widens the visits until the recall of sample queries reaches the goal."""
        probes = sample[:: max(1, len(sample) // PROBES)][:PROBES]
        near = probes @ sample.T
        near[near > 1 - 1e-12] = -2  # the query itself, and copies
        best = np.argsort(-near, axis=1)[:, :k]
        own = self.leaf(sample)
        orders = [{leaf: i for i, leaf in enumerate(self.best_first(q, self.n_leaves))} for q in probes]
        rank = np.array([[order[own[j]] for j in row] for order, row in zip(orders, best, strict=True)])
        self.visits = next((v for v in range(1, self.n_leaves + 1) if (rank < v).mean() >= goal), self.n_leaves)


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _file(tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = tree.value.leaf(_unit(_matrix(b.column("embedding")))) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("embedding"), pa.array(leaf, pa.int32())], names=["vec_id", "embedding", "leaf"])

    return run


def _visit(tree, bins: np.ndarray):
    """A row for each query and bin that it visits, with its leaves there; ``bins``: of each leaf, -1 where it is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, bin_of, leaves = [], [], []
            for i, q in enumerate(_unit(_matrix(b.column("embedding"))) if b.num_rows else []):
                seen = np.array(tree.value.best_first(q, tree.value.visits))
                seen = seen[bins[seen] >= 0]
                for one in np.unique(bins[seen]).tolist():
                    at.append(i)
                    bin_of.append(one)
                    leaves.append(seen[bins[seen] == one])
            at = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(at), b.column("embedding").take(at), pa.array(bin_of, pa.int32()), pa.array(leaves, pa.list_(pa.int32()))], names=["query_id", "query", "bin", "leaves"])

    return run


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of the rows of x and y, each summed alike whatever stands beside it."""
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def _nearest(k: int):
    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if queries.num_rows and vectors.num_rows:
            ids, x = vectors.column("vec_id").to_numpy(), _matrix(vectors.column("embedding"))
            own, q = queries.column("query_id").to_numpy(), _matrix(queries.column("query"))
            units, leaf = _unit(x), vectors.column("leaf").to_numpy()
            known, leaf = np.unique(leaf, return_inverse=True)
            asked = queries.column("leaves").to_pylist()
            for a in range(0, len(q), 256):
                near = _unit(q[a : a + 256]) @ units.T
                near[own[a : a + 256, None] == ids[None, :]] = -9
                near[~np.stack([np.isin(known, seen) for seen in asked[a : a + 256]])[:, leaf]] = -9  # leaves that the query doesn't visit
                for i, row in enumerate(near):
                    most = k
                    while True:  # rows that repeat an id may fill places: then more are taken
                        edge = np.partition(row, len(row) - most)[len(row) - most] if most < len(row) else -8
                        at = np.flatnonzero(row >= max(edge - 1e-9, -8))
                        score = cosines(x[at], np.broadcast_to(q[a + i], (len(at), q.shape[1])))
                        order = np.lexsort((ids[at], -score))
                        _, first = np.unique(ids[at][order], return_index=True)
                        if len(first) >= k or most >= len(row):
                            break
                        most *= 4
                    pick = order[np.sort(first)[:k]]
                    out += [(own[a + i], ids[at[p]], float(score[p])) for p in pick]
        columns = list(zip(*out, strict=True)) or [()] * 3
        return pa.table({"query_id": pa.array(columns[0], pa.int64()), "vec_id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of ``vectors`` to each row of ``queries`` (both vec_id, embedding), its own id left out."""
    spark = vectors.sparkSession

    def sound(df: DataFrame) -> DataFrame:
        v = F.col("embedding")
        finite = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
        return df.select("vec_id", v.cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda c: c != 0))

    lean_batches(vectors)
    vectors, queries = sound(vectors), sound(queries)
    sizes = vectors.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sizes:
        return empty
    d, n = sizes[0]
    vectors, queries = (df.where(F.size("embedding") == d) for df in (vectors, queries))
    leaves = max(1, min(MOST_LEAVES, n // LEAF))
    wanted = max(SAMPLE, PER_LEAF * leaves)
    at = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20))
    drawn = vectors.where(at < int(np.ceil(min(1.0, wanted / n) * (1 << 20)))).orderBy(at, "vec_id").limit(wanted)
    chosen = drawn.select("vec_id", "embedding").toArrow().sort_by("vec_id")
    sample = _unit(_matrix(chosen.column("embedding"))) if chosen.num_rows else np.eye(1, d)
    model = Tree(sample, leaves)
    model.calibrate(sample, k, recall)
    tree = spark.sparkContext.broadcast(model)  # bounded by the number of leaves
    filed = stored(vectors.mapInArrow(_file(tree), "vec_id long, embedding array<double>, leaf int"), "leaves")
    sizes = {r.leaf: r["count"] for r in filed.groupBy("leaf").count().collect()}  # a row for each leaf
    bins, fill, block = np.full(model.n_leaves, -1, np.int32), [], min(BLOCK, max(SMALL, n // BINS))
    for leaf in sorted(sizes):  # leaves are numbered along the tree
        if not fill or fill[-1] + sizes[leaf] > block:
            fill.append(0)
        fill[-1] += sizes[leaf]
        bins[leaf] = len(fill) - 1
    walked = stored(queries.mapInArrow(_visit(tree, bins), "query_id long, query array<double>, bin int, leaves array<int>"), "walks")
    of_leaf = spark.createDataFrame([(leaf, int(bins[leaf]), max(1, -(-fill[bins[leaf]] // block))) for leaf in sorted(sizes)], "leaf int, bin int, parts int")
    blocks = walked.groupBy("bin").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("blocks"))
    shape = stored(of_leaf.join(blocks, "bin"), "shape")
    per_leaf, per_bin = F.broadcast(shape), F.broadcast(shape.select("bin", "parts", "blocks").distinct())  # at most a row for each leaf
    one_of = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    each_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = walked.join(per_bin, "bin").withColumn("block", one_of("query_id", "blocks")).withColumn("part", each_of("parts"))
    dealt = filed.join(per_leaf, "leaf").withColumn("part", one_of("vec_id", "parts")).withColumn("block", each_of("blocks"))
    key, schema = ["bin", "part", "block"], "query_id long, vec_id long, score double"
    asked, dealt = asked.select(*key, "query_id", "query", "leaves"), dealt.select(*key, "vec_id", "embedding", "leaf")
    found = stored(asked.groupBy(*key).cogroup(dealt.groupBy(*key)).applyInArrow(_nearest(k), schema), "near")
    discard(filed, walked, shape)
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
