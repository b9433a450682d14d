"""Packing of token sequences into windows by the sum-of-squares rule.

Online, a document goes to the fill level for which the sum of the squared counts of partially filled
windows grows least (Csirik et al., 2006); the counts are kept in an array indexed by level, so a
placement is one vector expression. Documents longer than a window give whole windows first. What is
left open when a partition ends is cut and closed up, and the last rest is split into powers of two,
which need no padding.

Defined results: a null text is empty, and its document is the end id alone; null ids and repeated
rows are packed like others; partitions are packed independently, so no window waits for another task.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from cairnflow.llm import textvec as tv
from cairnflow.llm.shared import lean_batches

WINDOW = 2048
END_ID = 1
#: Open windows in a task; beyond them the open ones are closed up.
MOST_OPEN = 1 << 15
#: Distinct words whose ids a worker remembers.
MOST_WORDS = 1 << 21
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordTokenizer:
    """Ids of whole texts from a tokenizer that never joins across white space, each distinct word encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self._clear()

    def _clear(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint16)

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        ids = [x.ids for x in self.encoder.encode_batch_fast(words, add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.uint16, int(size.sum()))
        start = len(self.pool) + np.cumsum(size) - size
        self.pool = np.concatenate([self.pool, flat])
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known, kind="stable")
        self.known = known[order]
        self.start = np.concatenate([self.start, start])[order]
        self.size = np.concatenate([self.size, size])[order]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one array, and where each text's ids begin (and the last ends)."""
        data, starts, ends = tv.buffers(column)
        ws, we, first = tv.word_spans(data, starts, ends)
        if not len(ws):
            return np.zeros(0, np.uint16), np.zeros(len(column) + 1, np.int64)
        unique, example, which = np.unique(tv.word_hashes(data, ws, we), return_index=True, return_inverse=True)
        if len(self.known) > MOST_WORDS:
            self._clear()
        at = np.searchsorted(self.known, unique)
        new = at >= len(self.known)
        new[~new] = self.known[at[~new]] != unique[~new]
        if new.any():
            raw = data.tobytes()
            self._learn(unique[new], [raw[a:b].decode("utf-8", "replace") for a, b in zip(ws[example[new]].tolist(), we[example[new]].tolist(), strict=True)])
            at = np.searchsorted(self.known, unique)
        size = self.size[at][which]
        until = np.cumsum(size)
        ids = self.pool[np.repeat(self.start[at][which] - until + size, size) + np.arange(until[-1])]
        return ids, np.concatenate([[0], until])[first]


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """The worker's tokenizer for a vocabulary file."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


class Packer:
    """Packs documents into windows; ``rows`` collects finished pieces."""

    def __init__(self, window: int = WINDOW, first_sequence: int = 0):
        self.window = window
        self.next = first_sequence
        self.count = np.zeros(window + 1, np.int64)  # open windows by level; the last entry stays 0
        self.open: list[list[list]] = [[] for _ in range(window)]
        self.n_open = 0
        self.rows: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, offset))
            offset += len(ids)
        self.next += 1

    def level(self, size: int) -> int:
        """The fill level whose choice lets the sum of squares grow least (ties: the fullest)."""
        c, w = self.count, self.window
        change = 2 * c[size : w + 1] + 1 - 2 * c[: w - size + 1]  # level g to g + size
        change[-1] -= 1  # a full window is counted no more
        change += 1
        change[1:][c[1 : w - size + 1] == 0] = np.iinfo(np.int64).max
        change[0] = 2 * c[size] + 1 if size < w else 0
        return len(change) - 1 - int(np.argmin(change[::-1]))

    def add(self, doc, ids: np.ndarray) -> None:
        """Places a document of at least one id."""
        w, total = self.window, len(ids)
        for k in range(0, total - w + 1, w):
            self._emit([(doc, k, ids[k : k + w], total)])
        if not (size := total % w):
            return
        g = self.level(size)
        if g:
            pieces = self.open[g].pop()
            self.count[g] -= 1
            self.n_open -= 1
        else:
            pieces = []
        pieces.append((doc, total - size, ids[total - size :].copy(), total))
        if g + size == w:
            self._emit(pieces)
            return
        self.open[g + size].append(pieces)
        self.count[g + size] += 1
        self.n_open += 1
        if self.n_open > MOST_OPEN:
            self.close(False)

    def close(self, last: bool = True) -> None:
        """Cuts the open windows' pieces to whole windows; the rest becomes powers of two, or stays open if more may come."""
        w = self.window
        pieces = [p for level in self.open for ps in level for p in ps]
        self.open, self.n_open = [[] for _ in range(w)], 0
        self.count[:] = 0
        now: list[tuple] = []
        room = w
        left = sum(len(p[2]) for p in pieces)
        if left < w:
            room = _power(left, w) if last else w
        for doc, start, ids, total in pieces:
            while len(ids):
                part = ids[:room]
                now.append((doc, start, part, total))
                ids, start, room, left = ids[len(part) :], start + len(part), room - len(part), left - len(part)
                if not room:
                    self._emit(now)
                    now, room = [], w if left >= w or not last else _power(left, w)
        if now:
            fill = sum(len(p[2]) for p in now)
            self.open[fill].append(now)
            self.count[fill] = self.n_open = 1


def _power(n: int, most: int) -> int:
    return min(1 << (n.bit_length() - 1), most) if n else most


def _packed(path: str, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(path)
        packer = Packer(window, TaskContext.get().partitionId() << 32)
        schema = pa.schema([(f.split()[0], pa.int64()) for f in SCHEMA.split(", ")])

        def out() -> pa.RecordBatch:
            columns = list(zip(*packer.rows, strict=True)) or [[]] * len(schema)
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

        for batch in batches:
            for part in tv.pieces(batch):
                ids, at = encoder.encode(part.column("text"))
                for i, doc in enumerate(part.column("doc_id").to_pylist()):
                    packer.add(doc, np.append(ids[at[i] : at[i + 1]], np.uint16(END_ID)))
                yield out()
        packer.close()
        yield out()

    return run


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``vocabulary`` is a word-level tokenizer file that every executor can read. Each task packs its own
    partition in one pass without a shuffle; memory holds one batch and at most MOST_OPEN open windows.
    """
    lean_batches(docs)
    return docs.select("doc_id", "text").mapInArrow(_packed(vocabulary, window), SCHEMA)
