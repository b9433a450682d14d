"""Cross-entropy difference of two bigram models (Moore and Lewis, 2010).

The target and the background model are matched in vocabulary (the whole of a public byte-level one), order and
smoothing. Bigrams are counted over all rows of both corpora, as a keyed table that grows with them; where the
documents are the background themselves, a document's own counts are taken out of the model that scores it,
so that no model has seen what it scores:

1. Tasks tokenise, and deal the distinct bigrams of each batch, with counts, over buckets by the bigram's hash.
   The documents' tokens are stored beside them.
2. In a bucket the counts of all batches are added up, and the bigrams of each batch of documents get both corpora's counts.
3. The answers come back to their batch's tokens, which are scored. Only what the vocabulary bounds travels
   to all tasks: the counts of single tokens, and of tokens as contexts.

A document's score is the mean, over its tokens, of background loss less target loss: the larger, the more
it resembles the target.

Defined results: a text without tokens, or null, has no losses (null) and score 0; a corpus without rows (or with
no other document than the one scored) gives a uniform model; null ids and repeated rows are scored like others.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnflow.llm import blobs
from cairnflow.llm import textvec as tv
from cairnflow.llm.packing import WordTokenizer
from cairnflow.llm.shared import lean_batches, stored

#: Pseudo-counts that the unigram model gets in every context.
PRIOR = 16.0
#: Tokens beyond which a batch is dealt out.
_TOKENS = 3 << 19
#: Tokens that are scored at once.
_SCORED_TOKENS = 1 << 18
_BUCKET_BYTES = 16 << 20
_TARGET, _BACKGROUND, _DOCS = range(3)
_CELLS, _TEXTS, _TOTALS = range(3)
_DEALT = "corpus int, part int, bucket int, batch long, blob binary, ids array<long>, n array<long>, heads array<long>"
_SCORED = "doc_id long, n_tokens long, ce_target double, ce_background double, score double"


class SpacedTokenizer(WordTokenizer):
    """Ids of " word" for every word under the first ids of a byte-level vocabulary."""

    def __init__(self, path: str, size: int):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        model["vocab"] = {t: i for t, i in model["vocab"].items() if i < size}
        pair = lambda m: tuple(m.split(" ")) if isinstance(m, str) else tuple(m)
        model["merges"] = [m for m in model["merges"] if "".join(pair(m)) in model["vocab"] and all(x in model["vocab"] for x in pair(m))]
        spec["added_tokens"], spec["post_processor"] = [], None
        self.encoder = Tokenizer.from_str(json.dumps(spec))
        self._clear()

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        super()._learn(hashes, [f" {w}" for w in words])


_tokenizers: dict[tuple[str, int], SpacedTokenizer] = {}


def tokenizer(path: str, size: int) -> SpacedTokenizer:
    """The worker's tokenizer for a vocabulary file and size."""
    if (path, size) not in _tokenizers:
        _tokenizers[path, size] = SpacedTokenizer(path, size)
    return _tokenizers[path, size]


@functools.cache
def whole(path: str) -> int:
    """The size of a vocabulary: one more than its largest id."""
    with open(path, encoding="utf-8") as f:
        return max(json.load(f)["model"]["vocab"].values()) + 1


def _before(ids: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """The token before each token; ``size`` at the start of a text (``n``: tokens of each text)."""
    before = np.empty(len(ids), np.int64)
    before[1:] = ids[:-1]
    before[(np.cumsum(n) - n)[n > 0]] = size
    return before


def _bucket(cells: np.ndarray, n_buckets: int) -> np.ndarray:
    return (tv.mix(cells.astype(np.uint64)) % np.uint64(n_buckets)).astype(np.int64)


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of one length, each number in the bytes that its column needs."""
    widths = [blobs._width(c.max(initial=0)) for c in columns]
    return bytes(widths) + b"".join(blobs._cut(c, w).tobytes() for c, w in zip(columns, widths, strict=True))


def _unpack(blob: bytes, k: int) -> list[np.ndarray]:
    raw = np.frombuffer(blob, np.uint8)
    widths = raw[:k].tolist()
    n, at, out = (len(raw) - k) // sum(widths), k, []
    for w in widths:
        out.append(blobs._whole(raw[at : at + n * w], n, w).astype(np.int64))
        at += n * w
    return out


def _rows(corpus: int, part: int, bucket: list | None, batch: int, blob: list, *lists: list | None) -> pa.RecordBatch:
    n = len(blob)
    columns = [
        pa.array([corpus] * n, pa.int32()), pa.array([part] * n, pa.int32()), pa.array(bucket or [None] * n, pa.int32()), pa.array([batch] * n, pa.int64()), pa.array(blob, pa.binary()),
        *(pa.array([x] * n, pa.list_(pa.int64())) for x in (*lists, None, None, None)[:3]),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["corpus", "part", "bucket", "batch", "blob", "ids", "n", "heads"])


def _enter(corpus: int, path: str, size: int, n_buckets: int):
    """Step 1: the bigrams of each batch by bucket, the counts of its tokens and contexts, and its tokens (of documents only)."""

    def dealt(batch: int, docs: list, sizes: list[np.ndarray], tokens: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        ids, n = np.concatenate(tokens), np.concatenate(sizes)
        if corpus == _DOCS:
            yield _rows(corpus, _TEXTS, None, batch, [ids.astype("<u2").tobytes()], docs, n)
        if not len(ids):
            return
        before = _before(ids, n, size)
        ones, heads = np.bincount(ids, minlength=size + 1), np.bincount(before, minlength=size + 1)
        some = np.flatnonzero(ones + heads)
        yield _rows(corpus, _TOTALS, None, batch, [None], some, ones[some], heads[some])
        cells, count = np.unique(before * size + ids, return_counts=True)
        bucket = _bucket(cells, n_buckets)
        order = np.argsort(bucket, kind="stable")
        head, _ = blobs.groups(bucket[order])
        own = [order[i:j] for i, j in zip(head, [*head[1:], len(order)], strict=True)]
        yield _rows(corpus, _CELLS, bucket[order[head]].tolist(), batch, [_pack(np.diff(cells[o], prepend=0), count[o]) for o in own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch, held = TaskContext.get().partitionId() << 32, 0
        docs, sizes, tokens = [], [], []
        for rows in batches:
            for part in tv.pieces(rows):
                ids, at = tokenizer(path, size).encode(part.column("text"))
                docs += part.column("doc_id").to_pylist() if corpus == _DOCS else []
                sizes.append(np.diff(at))
                tokens.append(ids)
                held += len(ids) + part.num_rows
                if held >= _TOKENS:
                    yield from dealt(batch, docs, sizes, tokens)
                    batch, held, docs, sizes, tokens = batch + 1, 0, [], [], []
        if sizes:
            yield from dealt(batch, docs, sizes, tokens)

    return run


def _answer(background: int):
    """Step 2: for each batch of documents, the counts of its bigrams in both corpora, in the order of the bigrams."""

    def run(table: pa.Table) -> pa.Table:
        rows = [(c, b, *_unpack(x, 2)) for c, b, x in zip(*(table.column(k).to_pylist() for k in ("corpus", "batch", "blob")), strict=True)]
        rows = [(c, b, np.cumsum(step), count) for c, b, step, count in rows]
        counts = []
        for corpus in (_TARGET, background):
            cells, which = np.unique(np.concatenate([np.zeros(0, np.int64), *(x for c, _, x, _ in rows if c == corpus)]), return_inverse=True)
            counts.append((cells, np.bincount(which, np.concatenate([np.zeros(0, np.int64), *(n for c, _, _, n in rows if c == corpus)]), len(cells)).astype(np.int64)))

        def of(cells: np.ndarray, count: np.ndarray, x: np.ndarray) -> np.ndarray:
            if not len(cells):
                return np.zeros(len(x), np.int64)
            i = np.minimum(np.searchsorted(cells, x), len(cells) - 1)
            return np.where(cells[i] == x, count[i], 0)

        out = [(b, _pack(*(of(*c, x) for c in counts))) for corpus, b, x, _ in rows if corpus == _DOCS]
        bucket = table.column("bucket")[0].as_py()
        return pa.table({"bucket": pa.array([bucket] * len(out), pa.int32()), "batch": pa.array([b for b, _ in out], pa.int64()), "blob": pa.array([x for _, x in out], pa.binary())})

    return run


def _own(row: np.ndarray, which: np.ndarray, heads: np.ndarray, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """For every token: how often its document has its bigram, its context and the token itself, and the document's length."""

    def times(key: np.ndarray, order: np.ndarray) -> np.ndarray:
        head, run_of = blobs.groups(key[order])
        out = np.empty(len(key), np.int64)
        out[order] = np.diff(np.concatenate([head, [len(key)]]))[run_of] if len(key) else 0
        return out

    cell = row * (len(heads) + 1) + which  # bigrams are numbered in the order of their contexts
    order = np.argsort(cell, kind="stable")
    token = row * (int(ids.max(initial=0)) + 1) + ids
    return times(cell, order), times(row * (int(heads.max(initial=0)) + 1) + heads[which], order), times(token, np.argsort(token, kind="stable")), n[row]


def _score(totals, size: int, n_buckets: int, held_out: bool):
    """Step 3: the scores of a batch of documents."""

    def run(table: pa.Table) -> pa.Table:
        answers, texts = [], None
        for bucket, blob, docs, n in zip(*(table.column(k) for k in ("bucket", "blob", "ids", "n")), strict=True):
            if bucket.is_valid:
                answers.append((bucket.as_py(), _unpack(blob.as_buffer().to_pybytes(), 2)))
            else:
                texts = np.frombuffer(blob.as_buffer().to_pybytes(), "<u2").astype(np.int64), docs.values, np.asarray(n.values)
        ids, docs, n = texts
        cells, which = np.unique(_before(ids, n, size) * size + ids, return_inverse=True)
        order = np.argsort(_bucket(cells, n_buckets), kind="stable")
        answers.sort(key=lambda a: a[0])
        which, ends, loss = which.astype(np.int32), np.cumsum(n), np.zeros((2, len(n)))
        counts = []
        for k in range(2):
            count = np.zeros(len(cells), np.int64)
            count[order] = np.concatenate([np.zeros(0, np.int64), *(a[k] for _, a in answers)])
            counts.append(count)
        del answers, order
        first = 0
        while first < len(n):
            begin = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, begin + _SCORED_TOKENS, "right")))
            at, some = slice(begin, ends[last - 1]), n[first:last]
            row, own_ids, own_cells = np.repeat(np.arange(len(some)), some), ids[at], which[at]
            for k, (one, heads) in enumerate(totals.value):
                own = _own(row, own_cells, cells // size, own_ids, some) if k and held_out else (0, 0, 0, 0)
                single = (one[own_ids] - own[2] + 1) / (one.sum() + size - own[3])
                cost = np.log(heads[cells[own_cells] // size] - own[1] + PRIOR) - np.log(counts[k][own_cells] - own[0] + PRIOR * single)
                loss[k, first:last] = np.bincount(row, cost, minlength=len(some)) / np.maximum(some, 1)
            first = last
        none = n == 0
        columns = [docs, pa.array(n, pa.int64()), *(pa.array(x, pa.float64(), mask=none) for x in loss), pa.array(np.where(none, 0.0, loss[1] - loss[0]))]
        return pa.table(dict(zip(("doc_id", "n_tokens", "ce_target", "ce_background", "score"), columns, strict=True)))

    return run


def _totals(dealt: DataFrame, size: int, corpora: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each corpus how often each token occurs, and how often it (and the start) is a context."""
    rows = dealt.where(F.col("part") == _TOTALS).select("corpus", F.inline(F.arrays_zip("ids", "n", "heads"))).groupBy("corpus", "ids").agg(F.sum("n").alias("n"), F.sum("heads").alias("heads"))
    found = rows.toArrow()  # at most a row for each corpus and piece of the vocabulary
    corpus, ids, n, heads = (np.asarray(found.column(k)) for k in ("corpus", "ids", "n", "heads"))
    out = []
    for c in corpora:
        own, one, head = corpus == c, np.zeros(size + 1), np.zeros(size + 1)
        one[ids[own]], head[ids[own]] = n[own], heads[own]
        out.append((one[:size], head))
    return out


def score(docs: DataFrame, target: DataFrame, path: str, background: DataFrame | None = None, size: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, ce_target, ce_background, score (background less target, in nats a token).

    Without a ``background`` the documents are it, each scored by all others; a table given as ``background`` counts whole. ``size`` keeps only the first ids of the vocabulary; without it the whole vocabulary is used.
    """
    lean_batches(docs)
    size = size or whole(path)
    n = blobs.buckets_for(docs, _BUCKET_BYTES)
    own = _DOCS if background is None else _BACKGROUND
    corpora = {_DOCS: docs.select("doc_id", "text"), _TARGET: target.select("text")} | ({} if own == _DOCS else {_BACKGROUND: background.select("text")})
    dealt = stored(functools.reduce(DataFrame.unionAll, (t.mapInArrow(_enter(c, path, size, n), _DEALT) for c, t in corpora.items())), "bigrams")
    totals = docs.sparkSession.sparkContext.broadcast(_totals(dealt, size, [_TARGET, own]))
    cells = dealt.where(F.col("part") == _CELLS).select("corpus", "bucket", "batch", "blob")
    answers = cells.groupBy("bucket").applyInArrow(tv.lean(_answer(own)), "bucket int, batch long, blob binary")
    texts = dealt.where(F.col("part") == _TEXTS).select("bucket", "batch", "blob", "ids", "n")
    return texts.unionByName(answers, allowMissingColumns=True).groupBy("batch").applyInArrow(tv.lean(_score(totals, size, n, own == _DOCS)), _SCORED)
