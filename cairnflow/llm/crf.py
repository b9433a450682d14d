"""Document quality from a linear-chain conditional random field over lines.

Every line that is not blank has a state, good or bad. A line's score comes from its own features and those of
the lines before and after it; neighbouring states are tied by a transition table. The model is fitted on a
bounded sample of whole labelled documents (about ``SAMPLE`` of them, chosen by a hash of their ids, as long as they have
``SAMPLE_LINES`` lines together; a document with over an eighth of that is not chosen), whose lines take their document's label; the
lines' features are computed by the executors, and only these reach the driver. Whole texts are scored: forward-backward gives each line its marginal of being good, and
their mean weighted by length is the document's quality, which a logistic curve of the same sample turns into
the probability of label 1.

Defined results: a text without a line that is not blank, or null, has the share of label 1 in the sample as its
score; without labelled documents all scores are 0.5; a document with two labels counts once for each; ids
are only used to find labels and to hold documents out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnflow.llm import textvec as tv
from cairnflow.llm.shared import discard, held_out, lean_batches, stored

SAMPLE = 3000
#: Lines of the sample: 10 MB of features, 34 MB with those of neighbours.
SAMPLE_LINES = 200_000
STEPS = 120
THRESHOLD = 0.3
_FEATURED = "at long, doc_id long, tag long, quality int, sizes array<int>, x binary"


def _class(members: bytes) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(members)] = 1
    return out


_UPPER = _class(bytes(range(65, 91)))
_ALPHA = _class(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(0x80, 256)))
_OTHERS = [(_class(bytes(range(48, 58))), 4), (_class(b"!"), 8), (_class(b"|"), 10), (_class(b"#$%&*@^~<>{}[]=+_\\/"), 4), (_class(b".,;:?"), 8), (_class(bytes(range(0x80, 256))), 2)]
#: Features of a line itself.
OWN = 7 + len(_OTHERS)


def lines(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every line that is not blank: its text's row, its length in bytes, its own features."""
    data, starts, ends = tv.buffers(column)
    full = np.flatnonzero(ends > starts)
    if not len(full):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, OWN), np.float32)
    lo, hi = int(starts[full[0]]), int(ends[full[-1]])
    raw = data[lo:hi]
    cut = np.flatnonzero(raw == 10) + 1
    begin = np.union1d(cut[cut < len(raw)], np.concatenate([starts[full], ends[full][ends[full] < hi]]) - lo)
    row = full[np.searchsorted(starts[full] - lo, begin, "right") - 1]
    size = np.diff(np.concatenate([begin, [len(raw)]]))
    total = lambda member: np.add.reduceat(member, begin, dtype=np.int64)
    dark = (~tv.SPACE[raw]).view(np.uint8)
    solid = total(dark)
    keep = (solid > 0) & (begin + lo < ends[row])
    head = dark.copy()
    head[1:] &= 1 - dark[:-1]
    head[begin] = dark[begin]
    words, n = total(head), np.maximum(solid, 1)
    values, powers = tv._VALUE[raw], np.arange(len(raw)) - np.repeat(begin, size)
    same = np.add.reduceat(values * tv._POW[powers % tv._PIECE] * dark, begin)
    order = np.lexsort((same, row))
    twin = (same[order][1:] == same[order][:-1]) & (row[order][1:] == row[order][:-1])
    again = np.zeros(len(begin), bool)
    again[order] = np.concatenate([twin, [False]]) | np.concatenate([[False], twin])
    alpha = total(_ALPHA[raw])
    ws, we, _ = tv.word_spans(data, starts, ends)
    word, line = tv.word_hashes(data, ws, we, True), np.searchsorted(begin, ws - lo, "right") - 1
    repeats = np.bincount(line[1:][(word[1:] == word[:-1]) & (line[1:] == line[:-1])], minlength=len(begin))
    features = [np.log1p(solid) / 6, np.log1p(words) / 4, n / np.maximum(words, 1) / 10, again, repeats / np.maximum(words, 1) * 2, total(_UPPER[raw]) / np.maximum(alpha, 1), alpha / n]
    features += [np.minimum(total(member[raw]) / n * scale, 2) for member, scale in _OTHERS]
    x = np.stack([np.asarray(f, np.float32) for f in features], axis=1)
    return row[keep], solid[keep], x[keep]


def with_neighbours(row: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Own features, those of the lines before and after in the same text (else zero), whether first and last, and one."""
    first = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
    last = np.concatenate([first[1:], [True]]) if len(row) else first
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[first], after[last] = 0, 0
    return np.concatenate([x, before, after, first[:, None], last[:, None], np.ones((len(x), 1))], axis=1, dtype=np.float32)


class Chains:
    """The lines of many texts by step: at step t stand the texts with more than t lines, the longest first."""

    def __init__(self, row: np.ndarray):
        rows, begin, size = np.unique(row, return_index=True, return_counts=True)
        order = np.argsort(-size, kind="stable")
        self.rows, self.begin, self.size = rows[order], begin[order], size[order]
        longest = int(self.size[0]) if len(rows) else 0
        self.alive = np.searchsorted(-self.size, -np.arange(longest), "left") if longest else np.zeros(0, np.int64)

    def at(self, t: int) -> np.ndarray:
        return self.begin[: self.alive[t]] + t

    def marginals(self, good: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """For line scores of state good (bad has 0) and log transitions: marginals of good, expected transitions, log normaliser."""
        n = len(good)
        f, b = np.zeros((n, 2)), np.zeros((n, 2))
        unary = np.stack([np.zeros(n), good], axis=1)
        total = 0.0
        for t in range(len(self.alive)):
            i = self.at(t)
            f[i] = unary[i]
            if t:
                p = f[i - 1]
                f[i, 0] += np.logaddexp(p[:, 0] + table[0, 0], p[:, 1] + table[1, 0])
                f[i, 1] += np.logaddexp(p[:, 0] + table[0, 1], p[:, 1] + table[1, 1])
        for t in range(len(self.alive) - 2, -1, -1):
            i = self.at(t + 1)
            q = b[i] + unary[i]
            b[i - 1, 0] = np.logaddexp(q[:, 0] + table[0, 0], q[:, 1] + table[0, 1])
            b[i - 1, 1] = np.logaddexp(q[:, 0] + table[1, 0], q[:, 1] + table[1, 1])
        end = self.begin + self.size - 1
        z = np.logaddexp(f[end, 0], f[end, 1])
        total = float(z.sum())
        per = np.empty(n)
        for k, (a, m) in enumerate(zip(self.begin.tolist(), self.size.tolist(), strict=True)):
            per[a : a + m] = z[k]
        marginal = np.exp(f[:, 1] + b[:, 1] - per)
        steps = np.zeros((2, 2))
        if len(self.alive) > 1:
            inner = np.ones(n, bool)
            inner[self.begin] = False
            j = np.flatnonzero(inner)
            for s in (0, 1):
                for r in (0, 1):
                    steps[s, r] = np.exp(f[j - 1, s] + table[s, r] + unary[j, r] + b[j, r] - per[j]).sum()
        return marginal, steps, total


class Model:
    """Weights of the chain, and the curve from mean marginals to probabilities."""

    def __init__(self, weights: np.ndarray, table: np.ndarray, slope: float = 1.0, offset: float = 0.0, base: float = 0.5):
        self.weights, self.table, self.slope, self.offset, self.base = weights, table, slope, offset, base

    def quality(self, column: pa.Array) -> np.ndarray:
        """Length-weighted mean marginal of good lines of each text; NaN without lines."""
        row, size, x = lines(column)
        return self.quality_of(len(column), row, size, x)

    def quality_of(self, n: int, row: np.ndarray, size: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The same of the lines of n texts."""
        out = np.full(n, np.nan)
        if len(row):
            marginal, _, _ = Chains(row).marginals(with_neighbours(row, x) @ self.weights, self.table)
            weight = np.bincount(row, size, minlength=n)
            with np.errstate(invalid="ignore", divide="ignore"):
                out = np.bincount(row, size * marginal, minlength=n) / weight
        return out

    def scores(self, quality: np.ndarray) -> np.ndarray:
        q = np.clip(np.nan_to_num(quality, nan=0.5), 1e-4, 1 - 1e-4)
        return np.where(np.isnan(quality), self.base, 1 / (1 + np.exp(-(self.slope * np.log(q / (1 - q)) + self.offset))))


def _adam(gradient, start: np.ndarray, steps: int, rate: float) -> np.ndarray:
    x, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x -= rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return x


def fit(texts: list[str], labels: list[int], steps: int = STEPS) -> Model:
    """Fits the chain to whole texts."""
    return fit_lines(np.asarray(labels), *lines(pa.array(texts, pa.large_string())), steps)


def fit_lines(labels: np.ndarray, row: np.ndarray, size: np.ndarray, x: np.ndarray, steps: int = STEPS) -> Model:
    """Fits the chain by maximum conditional likelihood to the lines (as ``lines`` gives them) of labelled texts."""
    width = 3 * OWN + 3
    base = float(labels.mean()) if len(labels) else 0.5
    if not len(row) or len(set(labels[row])) < 2:
        return Model(np.zeros(width, np.float32), np.zeros((2, 2)), 1.0, np.log((base + 1e-3) / (1 - base + 1e-3)), base)
    z = with_neighbours(row, x)
    chains, y = Chains(row), labels[row].astype(float)
    inner = np.ones(len(row), bool)
    inner[chains.begin] = False
    seen = np.array([np.sum(inner & (y == 0)), 0, 0, np.sum(inner & (y == 1))]).reshape(2, 2).astype(float)

    def gradient(p: np.ndarray) -> np.ndarray:
        marginal, pairs, _ = chains.marginals(z @ p[:width], p[width:].reshape(2, 2))
        return np.concatenate([(marginal - y) @ z / len(y), (pairs - seen).ravel() / len(y)]) + 2e-3 * np.concatenate([p[:width] * 0.1, p[width:]])

    p = _adam(gradient, np.zeros(width + 4), steps, 0.15)
    model = Model(p[:width].astype(np.float32), p[width:].reshape(2, 2), base=base)
    q = model.quality_of(len(labels), row, size, x)
    some = ~np.isnan(q)
    q = np.clip(q[some], 1e-4, 1 - 1e-4)
    u, t = np.log(q / (1 - q)), labels[some]

    def curve(c: np.ndarray) -> np.ndarray:
        r = 1 / (1 + np.exp(-(c[0] * u + c[1]))) - t
        return np.array([(r * u).mean(), r.mean()]) + 1e-3 * np.array([c[0] - 1, c[1]])

    model.slope, model.offset = (float(c) for c in _adam(curve, np.array([1.0, 0.0]), 400, 0.05))
    return model


def _classify(model: Model, carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.pieces(batch):
                score = model.scores(model.quality(part.column("text")))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carried), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=[*carried, "score", "predicted"])

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from about ``sample`` labelled documents that are not held out, chosen by a hash of their ids."""
    lean_batches(docs)
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1))
    n = known.count()
    share = min(1.0, sample / n) if n else 0.0
    at = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    chosen = known.withColumn("at", at).where(F.col("at") < int(np.ceil(share * (1 << 20)))).orderBy("at", "doc_id", "quality").limit(2 * sample)
    few = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("tag", F.xxhash64("text"))  # bounded by the sample's size
    kept = stored(few.select("at", "doc_id", "tag", "quality", "text").mapInArrow(_featured, _FEATURED), "lines")
    place = F.struct("at", "doc_id", "tag", "quality")
    found = kept.where(F.size("sizes") <= SAMPLE_LINES // 8)
    sizes = found.select(place.alias("place"), F.size("sizes").alias("n")).orderBy("place").limit(2 * sample).collect()
    until = int(np.searchsorted(np.cumsum([r.n for r in sizes]), SAMPLE_LINES, "right"))
    if not until:
        return fit([], [])
    last = F.struct(*(F.lit(v).cast(t).alias(c) for c, v, t in zip(("at", "doc_id", "tag", "quality"), sizes[until - 1].place, ("long", "long", "long", "int"), strict=True)))
    rows = found.where(place <= last).orderBy("at", "doc_id", "tag", "quality").limit(until).select("quality", "sizes", "x").toArrow().combine_chunks()
    discard(kept)
    lists = rows.column("sizes").combine_chunks()
    per = np.asarray(pa.compute.list_value_length(lists), dtype=np.int64)
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float32).reshape(-1, OWN)
    return fit_lines(np.asarray(rows.column("quality")), np.repeat(np.arange(len(per)), per), np.asarray(lists.flatten(), dtype=np.int64), x)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lengths and features of every document's lines."""
    for batch in batches:
        for part in tv.pieces(batch):
            row, size, x = lines(part.column("text"))
            first = np.searchsorted(row, np.arange(part.num_rows + 1))
            blobs = [x[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            kept = [part.column(c) for c in ("at", "doc_id", "tag", "quality")]
            yield pa.RecordBatch.from_arrays([*kept, pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(size, pa.int32())), pa.array(blobs, pa.binary())], names=["at", "doc_id", "tag", "quality", "sizes", "x"])


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score (probability of label 1), predicted (1 from THRESHOLD on)."""
    model = train(docs, labels, sample)
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return out.mapInArrow(_classify(model, ["doc_id", "held_out"]), "doc_id long, held_out boolean, score double, predicted int")


def _good(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.pieces(batch):
                yield part.filter(pa.array(model.scores(model.quality(part.column("text"))) >= THRESHOLD))

    return run


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``classify`` predicts to have label 1."""
    return docs.mapInArrow(_good(train(docs, labels, sample)), docs.schema)
