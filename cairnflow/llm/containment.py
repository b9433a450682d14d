"""Benchmark items inside documents, by size-partitioned MinHash containment search.

Items are partitioned by the size of their shingle sets. Every item is sketched by the shingles that are
smallest under K permutations; each of them lies in a document with probability equal to the containment
of the item, whatever the document's size, so a long document is searched as surely as a short one.
A partition's K, and the number of sketch hits that makes a candidate, follow from its size and the
threshold: an item at the threshold is missed with probability below ``MISS``. Candidates are verified by
exact containment of the item's shingles in the document's.

Items travel to all tasks while they are small (``MOST_SHINGLES``); beyond that, sketches and documents meet
in a shuffle on the shingle, where texts are known by a 128-bit key, so that the rows found do not depend
on the branch. Defined results: an item of one to four words is one shingle, its whole sequence, and is looked for among the
documents' sequences of that length; items without words, or null, are in no document; equal items each give their row;
repeated rows of a pair are one row; rows with a null id are left out of the pairs, since none could name them, but judged in
decontamination, where items of fewer than ``LEAST_WORDS`` words, which any clean document may hold, condemn no row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnflow.llm import textvec as tv
from cairnflow.llm.minhash import shingle_sets
from cairnflow.llm.shared import lean_batches, stored

MISS = 1e-9
MOST_SHINGLES = 1 << 21
#: Words of the shortest items for which a document is removed.
LEAST_WORDS = 3
_BITS = 20
_PAIRS = "doc_id long, item_id long, n_item_shingles long, n_shared long"


def partition_of(size: int) -> int:
    """Items of 2^(p-1) to 2^p - 1 shingles share partition p."""
    return int(size).bit_length()


def coordinates(partition: int) -> int:
    """Number of permutations for a partition: more for larger items, 16 to 64."""
    return min(64, max(16, 1 << partition - 1))


def hits_needed(k: int, percent: int) -> int:
    """Most sketch hits (of k) that an item at the threshold reaches but with probability MISS."""
    p, total, m = percent / 100, 0.0, 0
    while m < k:
        total += math.comb(k, m) * p**m * (1 - p) ** (k - m)
        if total > MISS:
            break
        m += 1
    return max(1, m)


def sketch(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that are smallest under the partition's permutations, and under how many each is."""
    k = coordinates(partition_of(len(shingles)))
    seeds = tv.mix(np.arange(1, k + 1, dtype=np.uint64))
    least = np.array([tv.mix(shingles ^ s).argmin() for s in seeds])
    at, count = np.unique(least, return_counts=True)
    return shingles[at], count


class Index:
    """The sketches of all items by shingle."""

    def __init__(self, items: list[tuple[int, np.ndarray, int]], percent: int):
        """``items``: id, shingles, and number of words."""
        self.ids = np.array([i for i, _, _ in items], np.int64)
        self.sets = [s for _, s, _ in items]
        self.short = tuple(sorted({n for _, _, n in items if n < 5}))  # lengths of the items that are one short sequence
        self.need = np.array([hits_needed(coordinates(partition_of(len(s))), percent) for s in self.sets], np.int64)
        rows = [(h, i, c) for i, s in enumerate(self.sets) for h, c in zip(*sketch(s), strict=True)]
        rows.sort(key=lambda r: (int(r[0]), r[1]))
        shingle = np.array([r[0] for r in rows], np.uint64)
        self.item, self.weight = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
        self.shingle, self.begin = np.unique(shingle, return_index=True)
        self.begin = np.concatenate([self.begin, [len(rows)]])
        self.filter = np.zeros(1 << _BITS, bool)
        self.filter[self.shingle & np.uint64((1 << _BITS) - 1)] = True

    def candidates(self, grams: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, item) pairs with enough sketch hits."""
        at = np.flatnonzero(self.filter[grams & np.uint64((1 << _BITS) - 1)])
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        i = np.searchsorted(self.shingle, grams[at])
        i[i == len(self.shingle)] = 0
        hit = self.shingle[i] == grams[at]
        if not hit.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pair = np.unique(row[at[hit]] * len(self.shingle) + i[hit])
        r, i = pair // len(self.shingle), pair % len(self.shingle)
        size = self.begin[i + 1] - self.begin[i]
        entry = np.arange(size.sum()) + np.repeat(self.begin[i] - np.cumsum(size) + size, size)
        both, which = np.unique(np.repeat(r, size) * len(self.ids) + self.item[entry], return_inverse=True)
        enough = np.bincount(which, self.weight[entry]) >= self.need[both % len(self.ids)]
        return both[enough] // len(self.ids), both[enough] % len(self.ids)


def _grams(part: pa.RecordBatch, short: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """All five-word shingles of the texts, the text of each, and where each text's begin; then sequences of the
    ``short`` lengths, hashed like texts of that length, with the text of each."""
    data, starts, ends = tv.buffers(part.column("text"))
    ws, we, first = tv.word_spans(data, starts, ends)
    words = tv.word_hashes(data, ws, we, True)

    def of(k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        grams = tv.gram_hashes(words, k)
        size = np.maximum(np.diff(first) - k + 1, 0)
        row = np.repeat(np.arange(part.num_rows), size)
        begin = np.cumsum(size) - size
        return grams[np.arange(len(row)) + np.repeat(first[:-1] - begin, size)] if len(row) else grams[:0], row, np.concatenate([begin, [len(row)]])

    return *of(5), [(tv.mix(grams + np.uint64(k)), row) for k in short for grams, row, _ in (of(k),)]


def _verified(found: Index, part: pa.RecordBatch, percent: int) -> Iterator[tuple[int, int, int]]:
    """(row, item's place, shared shingles) of the candidates that hold enough of the item."""
    grams, row, begin, others = _grams(part, found.short)
    last, own = -1, grams[:0]
    for r, i in zip(*(x.tolist() for x in found.candidates(grams, row)), strict=True):
        if r != last:
            last, own = r, np.unique(grams[begin[r] : begin[r + 1]])
        s = found.sets[i]
        shared = int((own[np.minimum(np.searchsorted(own, s), len(own) - 1)] == s).sum())
        if 100 * shared >= percent * len(s):
            yield r, i, shared
    for grams, row in others:  # an item of one shingle is held where its sketch is hit
        yield from ((r, i, 1) for r, i in zip(*(x.tolist() for x in found.candidates(grams, row)), strict=True))


def _search(index, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = index.value
        for batch in batches:
            for part in tv.pieces(batch):
                ids = part.column("doc_id").to_pylist()
                out = [(ids[r], int(found.ids[i]), len(found.sets[i]), shared) for r, i, shared in _verified(found, part, percent)]
                columns = list(zip(*out, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "n_item_shingles", "n_shared"])

    return run


def _clean(index, percent: int):
    """The rows whose texts hold no item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = index.value
        for batch in batches:
            for part in tv.pieces(batch):
                stay = np.ones(part.num_rows, bool)
                for r, _, _ in _verified(found, part, percent):
                    stay[r] = False
                yield part.filter(pa.array(stay))

    return run


def _sketched(percent: int):
    """Rows (item, shingle, weight, need) for the shuffled search."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, s in zip(batch.column("item").to_pylist(), shingle_sets(batch), strict=True):
                if len(s):
                    need = hits_needed(coordinates(partition_of(len(s))), percent)
                    out += [(i, int(h.view(np.int64)), int(c), need) for h, c in zip(*sketch(s), strict=True)]
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["item", "shingle", "weight", "need"])

    return run


def _lengths(batch: pa.RecordBatch) -> np.ndarray:
    """Numbers of words."""
    data, starts, ends = tv.buffers(batch.column("text"))
    return np.diff(tv.word_spans(data, starts, ends)[2])


def _sets(name: str, short: tuple[int, ...] | None = None):
    """The texts' shingle sets; with ``short`` lengths, as a document's: five-word shingles and the sequences of those lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.pieces(batch):
                if short is None:
                    sets = list(shingle_sets(part))
                else:
                    grams, _, begin, others = _grams(part, short)
                    own = [np.searchsorted(row, np.arange(part.num_rows + 1)) for _, row in others]
                    sets = [np.unique(np.concatenate([grams[a:b], *(g[o[i] : o[i + 1]] for (g, _), o in zip(others, own, strict=True))])) for i, (a, b) in enumerate(zip(begin[:-1], begin[1:], strict=True))]
                ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([part.column(name), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], names=[name, "set"])

    return run


def _count_words(text: Column) -> Column:
    """How many words a text has."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""))


def _index(items: DataFrame, percent: int, most_shingles: int, least_words: int = 1):
    """The distinct items of enough words, and the broadcast index of them if they are within the bound, else None."""
    lean_batches(items)
    items = items.select("item_id", "text").where("item_id is not null").where(_count_words(F.col("text")) >= least_words).distinct()
    size = items.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    if (size[0] or 0) > 2 * most_shingles or size[1] > most_shingles:  # a shingle has two bytes at least that the next one has not
        return items, None
    batches = items.toArrow().to_batches()
    own = [(i, s, n) for b in batches for i, s, n in zip(b.column("item_id").to_pylist(), shingle_sets(b), _lengths(b).tolist(), strict=True) if len(s)]
    return items, items.sparkSession.sparkContext.broadcast(Index(own, percent))


def _keyed(df: DataFrame) -> DataFrame:
    """The distinct texts, by their key."""
    return df.where("text is not null").select(_key(F.col("text")).alias("key"), "text").dropDuplicates(["key"])


def _key(text: Column) -> Column:
    """What a text is known by in a shuffle: equal texts hold the same items, under whatever id."""
    return F.unhex(F.md5(text))


def _shuffled(docs: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """(key, item, n_item_shingles, n_shared) for the texts of ``docs`` and the items' texts that they hold, both by key."""
    texts, own = _keyed(docs), _keyed(items).withColumnRenamed("key", "item")
    short = tuple(sorted(r.n for r in items.select(_count_words(F.col("text")).alias("n")).where("n between 1 and 4").distinct().collect()))
    shingles = texts.mapInArrow(_sets("key", short), "key binary, set array<long>").select("key", F.explode("set").alias("shingle"))
    sketches = own.mapInArrow(_sketched(percent), "item binary, shingle long, weight long, need long")
    hits = shingles.join(sketches, "shingle").groupBy("key", "item").agg(F.sum("weight").alias("w"), F.max("need").alias("need")).where("w >= need")
    hits = stored(hits.select("key", "item"), "hits")
    doc_sets = texts.join(hits, "key", "left_semi").mapInArrow(_sets("key", short), "key binary, set array<long>")
    item_sets = own.mapInArrow(_sets("item"), "item binary, set array<long>").withColumnRenamed("set", "own")
    both = hits.join(doc_sets, "key").join(item_sets, "item")
    return both.select("key", "item", F.size("own").cast("long").alias("n_item_shingles"), F.size(F.array_intersect("own", "set")).cast("long").alias("n_shared")).where(F.col("n_shared") * 100 >= F.col("n_item_shingles") * percent)


def contained(docs: DataFrame, items: DataFrame, percent: int = 80, most_shingles: int = MOST_SHINGLES) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_shared, containment) for every item with at least ``percent`` % of its shingles in a document."""
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    items, index = _index(items, percent, most_shingles)
    if index is not None:
        pairs = docs.mapInArrow(_search(index, percent), _PAIRS)
    else:
        found = _shuffled(docs, items, percent)
        named = found.join(docs.select("doc_id", _key(F.col("text")).alias("key")), "key").join(items.select("item_id", _key(F.col("text")).alias("item")), "item")
        pairs = named.select("doc_id", "item_id", "n_item_shingles", "n_shared")
    return pairs.distinct().withColumn("containment", F.col("n_shared") / F.col("n_item_shingles"))


def decontaminate(docs: DataFrame, items: DataFrame, percent: int = 80, most_shingles: int = MOST_SHINGLES, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no item: every row is judged by its own text, whatever its id."""
    items, index = _index(items, percent, most_shingles, least_words)
    if index is not None:
        return docs.mapInArrow(_clean(index, percent), docs.schema)
    gone = _shuffled(docs, items, percent).select("key").distinct()
    return docs.join(gone, _key(docs["text"]) == gone["key"], "left_anti")
