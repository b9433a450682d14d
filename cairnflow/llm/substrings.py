"""Removal of repeated word passages by fixed-block anchors.

Every document is cut into non-overlapping reference blocks of ten words; every rolling run of ten
words probes them. A passage of twenty words holds a whole block wherever it starts, so every repeat
gives a hit on either side. Hits are extended: all windows of twenty words over a hit are compared by
their sequences, and runs of windows that also start earlier are the maximal exact repeats to remove.

Per task, an occurrence that is settled inside the task travels as its result, and only one
representative of a repeated run goes to the bucket of its key. Blocks begin at an offset that
depends on the row, so that a passage at the same place of very many documents meets block
starts in each of its runs; a passage that a third of all documents share thus costs a task a few entries.

Defined results: a null text has no words; a row is known by its id and a tag, the
64-bit hash of its text; rows equal in both are one, so repeated rows do not remove each other, and windows
apply to the text they were found in alone; texts of one id come in the order of their tags; null ids sort
last. Sequences are compared by 96 bits of independent hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnflow.llm import blobs
from cairnflow.llm import textvec as tv
from cairnflow.llm.shared import discard, free_name, lean_batches, stored

BLOCK = 10
WINDOW = 2 * BLOCK
_SHIPPED = "bucket int, blob binary, doc_id long, tag long, pos array<int>"
_FOUND = "doc_id long, tag long, pos array<int>"


def _shipped(dealt: Iterator[tuple[int, bytes, np.ndarray]], docs: np.ndarray, tags: np.ndarray, pos: np.ndarray, n_buckets: int) -> pa.RecordBatch:
    """Blobs for buckets, and settled positions of rows, dealt over the buckets too."""
    ids, tags, lists = blobs.by_row(docs, tags, pos)
    rows = [(b, x) for b, x, _ in dealt]
    bucket, blob = [b for b, _ in rows], [x for _, x in rows]
    none = len(bucket)
    columns = [
        pa.array([*bucket, *(tv.mix(ids.view(np.uint64) ^ tags) % np.uint64(n_buckets)).tolist()], pa.int32()),
        pa.array([*blob, *[None] * len(ids)], pa.binary()),
        pa.concat_arrays([pa.nulls(none, pa.int64()), pa.array(ids, pa.int64())]),
        pa.concat_arrays([pa.nulls(none, pa.int64()), pa.array(tags.view(np.int64))]),
        pa.concat_arrays([pa.nulls(none, pa.list_(pa.int32())), lists.cast(pa.list_(pa.int32()))]),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "blob", "doc_id", "tag", "pos"])


def _settled(table: pa.Table) -> pa.Table:
    return table.select(["doc_id", "tag", "pos"]).filter(pa.compute.is_valid(table.column("doc_id")))


def _rows(docs: np.ndarray, tags: np.ndarray, pos: np.ndarray) -> pa.Table:
    ids, tags, lists = blobs.by_row(docs, tags, pos)
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "tag": pa.array(tags.view(np.int64)), "pos": lists})


def _tags(part: pa.RecordBatch) -> np.ndarray:
    return np.asarray(part.column("tag")).view(np.uint64)


def _starts_block(docs: np.ndarray, tags: np.ndarray, pos: np.ndarray, block: int) -> np.ndarray:
    """Whether a reference block begins there."""
    return (pos + (tv.mix(docs.view(np.uint64) ^ tags) % np.uint64(block)).astype(np.int64)) % block == 0


def _probe(n_buckets: int, block: int):
    """Rolling runs of every document long enough; those repeated within the batch are settled here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.pieces(batch, most=blobs.piece_bytes(n_buckets)):
                data, starts, ends = tv.buffers(part.column("text"))
                ws, we, first = tv.word_spans(data, starts, ends)
                grams = tv.gram_hashes(tv.word_hashes(data, ws, we), block)
                ids, n_words = blobs.ids_of(part.column("doc_id")), np.diff(first)
                long = n_words >= 2 * block
                size = np.where(long, n_words - block + 1, 0)
                row = np.repeat(np.arange(part.num_rows), size)
                pos = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                key, doc = grams[first[row] + pos] if len(row) else grams[:0], ids[row]
                tag = _tags(part)[row]
                del grams, row
                order = np.argsort(key, kind="stable")
                head, run_of = blobs.groups(key[order])
                aligned = _starts_block(doc, tag, pos, block)[order]
                many = np.diff(np.concatenate([head, [len(order)]])) > 1
                # a repeated run with a reference block is settled; its first reference block represents it
                place = np.where(aligned, np.arange(len(order)), len(order))
                chosen = np.minimum.reduceat(place, head) if len(head) else place
                done = many & (chosen < len(order))
                out = done[run_of]
                settled = order[out]
                keep = ~out
                keep[chosen[done]] = True
                sent = np.sort(order[keep])
                bucket = (key[sent] % np.uint64(n_buckets)).astype(np.int64)
                yield _shipped(blobs.deal(bucket, n_buckets, doc[sent], pos[sent], [(key[sent] >> np.uint64(24), 5)], tag[sent]), doc[settled], tag[settled], pos[settled], n_buckets)

    return run


def _hits(block: int):
    def run(table: pa.Table) -> pa.Table:
        doc, pos, (key, tag) = blobs.decode_all(table, [5], True)
        order = np.lexsort((pos, tag, doc, key))
        if len(order):  # copies of a row are one
            other = np.any([x[order][1:] != x[order][:-1] for x in (key, doc, tag, pos)], axis=0)
            order = order[np.concatenate([[True], other])]
        head, run_of = blobs.groups(key[order])
        if len(head):
            aligned = np.maximum.reduceat(_starts_block(doc, tag, pos, block)[order].astype(np.int8), head) > 0
            hit = (aligned & (np.diff(np.concatenate([head, [len(order)]])) > 1))[run_of]
            order = order[hit]
        settled = _settled(table)
        places, docs, tags = blobs.flat(settled.column("pos"), settled.column("doc_id").to_numpy(), settled.column("tag").to_numpy().view(np.uint64))
        return _rows(np.concatenate([doc[order], docs]), np.concatenate([tag[order], tags]), np.concatenate([pos[order], places]))

    return run


def _extend(n_buckets: int, block: int):
    """Windows over the hits; those that start earlier within the batch are settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.pieces(batch, most=blobs.piece_bytes(n_buckets)):
                data, starts, ends = tv.buffers(part.column("text"))
                ws, we, first = tv.word_spans(data, starts, ends)
                words = tv.word_hashes(data, ws, we)
                lists = part.column("pos")
                seeds = np.asarray(lists.flatten(), dtype=np.int64)
                row = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(lists.offsets)))
                edge = np.zeros(len(words) + 1, np.int32)
                lo, hi = np.maximum(first[row] + seeds - block, first[row]), np.minimum(first[row] + seeds, first[row + 1] - 2 * block)
                fits = lo <= hi
                np.add.at(edge, lo[fits], 1)
                np.add.at(edge, hi[fits] + 1, -1)
                start = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                row = np.searchsorted(first, start, "right") - 1
                key = tv.gram_hashes(words, 2 * block)[start]
                more = tv.gram_hashes(tv.mix(words ^ np.uint64(0xA5A5A5A55A5A5A5A)), 2 * block)[start] >> np.uint64(32)
                doc, pos = blobs.ids_of(part.column("doc_id"))[row], start - first[row]
                tag = _tags(part)[row]
                order = np.lexsort((pos, tag, doc, more, key))
                k, m = key[order], more[order]
                new = np.concatenate([[True], (k[1:] != k[:-1]) | (m[1:] != m[:-1])]) if len(k) else np.zeros(0, bool)
                head = np.flatnonzero(new)[np.cumsum(new) - 1]
                same = (doc[order] == doc[order][head]) & (tag[order] == tag[order][head]) & (pos[order] == pos[order][head])
                later = order[~same]
                sent = np.sort(order[new])
                bucket = (key[sent] % np.uint64(n_buckets)).astype(np.int64)
                yield _shipped(blobs.deal(bucket, n_buckets, doc[sent], pos[sent], [(key[sent], 8), (more[sent], 4)], tag[sent]), doc[later], tag[later], pos[later], n_buckets)

    return run


def _later(table: pa.Table) -> pa.Table:
    """Windows whose sequence also starts earlier."""
    doc, pos, (key, more, tag) = blobs.decode_all(table, [8, 4], True)
    order = np.lexsort((pos, tag, doc, more, key))
    k, m, doc, tag, pos = key[order], more[order], doc[order], tag[order], pos[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (m[1:] != m[:-1])]) if len(k) else np.zeros(0, bool)
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    gone = (doc != doc[head]) | (tag != tag[head]) | (pos != pos[head])
    return pa.concat_tables([_settled(table), _rows(doc[gone], tag[gone], pos[gone])])


def _of_rows(found: DataFrame) -> DataFrame:
    return found.groupBy("doc_id", "tag").agg(F.flatten(F.collect_list("pos")).alias("pos"))


def repeated_windows(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, tag, pos): starts of the windows of ``2 * block`` words whose sequence also starts earlier; null ids are NO_ID."""
    docs = docs.select("doc_id", "text", _tag(docs).alias("tag"))
    n = blobs.buckets_for(docs)
    lean_batches(docs, blobs.piece_bytes(n))
    seeds = stored(docs.mapInArrow(_probe(n, block), _SHIPPED).groupBy("bucket").applyInArrow(tv.lean(_hits(block)), _FOUND), "hits")
    keyed = docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(blobs.NO_ID)))
    once = keyed.groupBy("doc_id", "tag").agg(F.first("text").alias("text"))
    windows = once.join(_of_rows(seeds), ["doc_id", "tag"]).select("doc_id", "text", "tag", "pos").mapInArrow(_extend(n, block), _SHIPPED)
    repeats = stored(windows.groupBy("bucket").applyInArrow(tv.lean(_later), _FOUND), "repeats")
    out = stored(_of_rows(repeats), "gone")  # stored, so that Spark splits the join of a row with many copies
    discard(seeds, repeats)
    return out


def _tag(docs: DataFrame) -> Column:
    """Tells the rows of one id apart: equal texts have equal windows."""
    return F.xxhash64(docs["text"])


def _stay(pos: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of n words no window covers."""
    edge = np.zeros(n + 1, np.int32)
    at = np.unique(pos)
    np.add.at(edge, np.minimum(at, n), 1)
    np.add.at(edge, np.minimum(at + size, n), -1)
    return np.cumsum(edge[:-1]) == 0


def _cut(size: int):
    """Words that stay, joined by one space, with counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.pieces(batch):
                total, removed, kept = [], [], []
                for text, pos in zip(part.column("text"), part.column("pos"), strict=True):
                    words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                    total.append(len(words))
                    if pos.is_valid:
                        words = list(compress(words, _stay(np.asarray(pos.values), len(words), size).tolist()))
                    removed.append(total[-1] - len(words))
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return run


def _rewrite(size: int, mark: str):
    """Rows with the words removed from their text; texts that lose nothing stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.pieces(batch):
                names = [c for c in part.schema.names if c != mark]
                texts, lists = part.column("text"), part.column(mark)
                changed = {}
                for i in np.flatnonzero(np.asarray(lists.is_valid()) & np.asarray(texts.is_valid())).tolist():
                    words = texts[i].as_buffer().to_pybytes().split()
                    kept = list(compress(words, _stay(np.asarray(lists[i].values), len(words), size).tolist()))
                    if len(kept) < len(words):
                        changed[i] = b" ".join(kept).decode("utf-8", "replace")
                columns = {c: part.column(c) for c in names}
                if changed:
                    columns["text"] = pa.array([changed.get(i, t) for i, t in enumerate(texts.to_pylist())], texts.type)
                    if "n_chars" in columns and pa.types.is_integer(columns["n_chars"].type):
                        columns["n_chars"] = pa.array([len(changed[i]) if i in changed else n for i, n in enumerate(columns["n_chars"].to_pylist())], columns["n_chars"].type)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    return run


def _with_windows(docs: DataFrame, block: int, mark: str) -> DataFrame:
    key, tag = free_name(docs, "_key"), free_name(docs, "_tag")
    gone = repeated_windows(docs, block).select(F.col("doc_id").alias(key), F.col("tag").alias(tag), F.col("pos").alias(mark))
    return docs.join(gone, (F.coalesce(docs["doc_id"], F.lit(blobs.NO_ID)) == gone[key]) & (_tag(docs) == gone[tag]), "left").select(*(docs[c] for c in docs.columns), gone[mark])


def remove_repeats(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the words that stay, joined by one space)."""
    rows = _with_windows(docs.select("doc_id", "text"), block, "pos")
    return rows.mapInArrow(_cut(2 * block), "doc_id long, n_words long, n_removed long, kept string")


def rewrite(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs``, with all their columns, without the repeats in their text.

    A text that loses words becomes the others joined by one space, and n_chars (if there is such a number) its length;
    other texts stay as they are.
    """
    mark = free_name(docs, "_windows")
    return _with_windows(docs, block, mark).mapInArrow(_rewrite(2 * block, mark), docs.schema)
