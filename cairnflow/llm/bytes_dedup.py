"""Removal of repeated byte strings by a sparse suffix array, sorted deep-shallow.

Any window of 400 bytes has an anchor: its leftmost smallest 64-byte hash. Equal windows have equal
anchors at equal places, so repeats are looked for among the anchors' contexts only:

1. Each run of windows with one anchor is an entry of its anchor's bucket. Anchors that occur once drop out.
2. Anchors that occur often are narrowed first: their windows' hashes are counted, and windows that
   occur once drop out. What stays of a widely shared passage then has the same ends in every document.
3. The contexts right and left of the anchors that are left are sorted, each side once, by deep-shallow
   sorting. A window reaches o bytes left and 400 - o right; it is repeated if another context lies in the
   same class of both sorted orders at these depths.

Rows equal in id and text are one row from step 2 on; that there are several removes all of them. Contexts that are
equal within a task are settled there and travel once, so a group of copies costs a task one entry. Defined results: a null text is empty; texts shorter than a window keep all bytes; a
repeated row repeats every string of its text, so both are removed alike; a row is known by the
64-bit hash of its id and text, so spans apply to the text they were found in alone; null ids are allowed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnflow.llm import blobs
from cairnflow.llm import textvec as tv
from cairnflow.llm.shared import discard, lean_batches, stored
from cairnflow.llm.suffixes import deep_shallow

WINDOW, GRAM = 400, 64
#: Occurrences of an anchor beyond which its windows are narrowed first.
OFTEN = 32
_CHUNK = 1 << 16
_FLAGGED = "doc_id long, pos array<int>, often boolean"
_SHIPPED = "bucket int, blob binary, doc_id long, pos array<int>"
_FOUND = "doc_id long, pos array<int>"


def _anchors(data: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window start in lo..hi-400: its anchor's place and the anchor's hash."""
    n = hi - lo - WINDOW + 1
    at, key = np.empty(n, np.int64), np.empty(n, np.uint64)
    span = WINDOW - GRAM + 1
    low = np.uint64((1 << 17) - 1)
    for c in range(0, n, _CHUNK):
        m = min(_CHUNK, n - c)
        raw = data[lo + c : lo + c + m + WINDOW - 1]
        p = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(tv._VALUE[raw] * tv._POW[: len(raw)], out=p[1:])
        h = tv.mix((p[GRAM:] - p[:-GRAM]) * tv._INV[: len(raw) - GRAM + 1])
        v = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while width * 2 <= span:
            v = np.minimum(v[:-width], v[width:])
            width *= 2
        v = np.minimum(v[:m], v[span - width : span - width + m])
        place = (v & low).astype(np.int64)
        at[c : c + m] = place + lo + c
        key[c : c + m] = h[place]
    return at, key


def _runs(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: row, first and last start, anchor's place (in the batch's bytes), key; then bytes and starts."""
    data, starts, ends = tv.buffers(part.column("text"))
    long = np.flatnonzero(ends - starts >= WINDOW)
    if not len(long):
        return *(np.zeros(0, np.int64) for _ in range(4)), np.zeros(0, np.uint64), data, starts
    lo, hi = int(starts[long[0]]), int(ends[long[-1]])
    at, key = _anchors(data, lo, hi)
    first, last = starts[long], ends[long] - WINDOW
    cut = np.union1d(np.flatnonzero(at[1:] != at[:-1]) + 1 + lo, first)
    until = np.concatenate([cut[1:], [hi]]) - 1
    doc = np.searchsorted(first, cut, "right") - 1
    fits = cut <= last[doc]
    s, doc = cut[fits], doc[fits]
    return long[doc], s, np.minimum(until[fits], last[doc]), at[s - lo], key[s - lo], data, starts


def _send(rows: list[tuple[int, bytes]], n_buckets: int, docs: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """Blobs, and settled positions of documents, which are dealt over the buckets too."""
    ids, lists = blobs.by_doc(docs, pos)
    k = len(rows)
    columns = [
        pa.array([*(b for b, _ in rows), *(tv.mix(ids.view(np.uint64)) % np.uint64(n_buckets)).tolist()], pa.int32()),
        pa.array([*(blob for _, blob in rows), *[None] * len(ids)], pa.binary()),
        pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(ids, pa.int64())]),
        pa.concat_arrays([pa.nulls(k, pa.list_(pa.int32())), lists.cast(pa.list_(pa.int32()))]),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "blob", "doc_id", "pos"])


def _settled(table: pa.Table) -> pa.Table:
    return table.select(["doc_id", "pos"]).filter(pa.compute.is_valid(table.column("doc_id")))


def _enter(n_buckets: int, limit: int):
    """Step 1, in tasks: an entry for each run. An anchor that is frequent within the batch is settled as such."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.pieces(batch, most=blobs.piece_bytes(n_buckets)):
                row, s, _, _, key, _, starts = _runs(part)
                ids = np.asarray(part.column("row"))
                order = np.argsort(key, kind="stable")
                head, run_of = blobs.groups(key[order])
                count = np.diff(np.concatenate([head, [len(order)]]))
                often = (count > limit)[run_of] if len(order) else np.zeros(0, bool)
                one = np.zeros(len(order), bool)
                one[head] = True
                sent = np.sort(order[one | ~often])
                weight = np.ones(len(order), np.uint64)
                weight[order[head]] = np.where(count > limit, count, 1)
                k = key[sent]
                dealt = blobs.deal((k % np.uint64(n_buckets)).astype(np.int64), n_buckets, ids[row[sent]], s[sent] - starts[row[sent]], [(k >> np.uint64(24), 5), (weight[sent], 4)])
                gone = order[often & ~one]
                yield _send([(b, blob) for b, blob, _ in dealt], n_buckets, ids[row[gone]], s[gone] - starts[row[gone]])

    return run


def _repeated(limit: int):
    """Step 1, in buckets: runs whose anchor occurs again, and whether it does so often."""

    def run(table: pa.Table) -> pa.Table:
        doc, pos, (key, weight) = blobs.decode_all(table, [5, 4])
        order = np.argsort(key, kind="stable")
        head, run_of = blobs.groups(key[order])
        total = np.add.reduceat(weight[order].astype(np.int64), head)[run_of] if len(head) else np.zeros(0, np.int64)
        settled = _settled(table)
        places, own = blobs.flat(settled.column("pos"), settled.column("doc_id").to_numpy())
        parts = []
        for often, keep in ((False, (total > 1) & (total <= limit)), (True, total > limit)):
            docs, at = (doc[order[keep]], pos[order[keep]]) if not often else (np.concatenate([doc[order[keep]], own]), np.concatenate([pos[order[keep]], places]))
            ids, lists = blobs.by_doc(docs, at, once=True)  # copies of a row have the same places
            parts.append(pa.table({"doc_id": pa.array(ids, pa.int64()), "pos": lists.cast(pa.list_(pa.int32())), "often": pa.array([often] * len(ids), pa.bool_())}))
        return pa.concat_tables(parts)

    return run


def _chosen(part: pa.RecordBatch, column: str, row: np.ndarray, s: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places of the runs (sorted by start) whose first windows the column lists."""
    lists = part.column(column)
    sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0))
    flat = np.asarray(lists.drop_null().flatten(), dtype=np.int64) if lists.null_count else np.asarray(lists.flatten(), dtype=np.int64)
    return np.searchsorted(s, np.unique(flat + np.repeat(starts, sizes)))


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All integers of the inclusive ranges, one after the other."""
    size = last - first + 1
    return np.arange(int(size.sum())) + np.repeat(first - np.cumsum(size) + size, size)


def _narrow(n_buckets: int):
    """Step 2, in tasks: windows of frequent anchors by hash; those repeated within the batch are settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.pieces(batch, most=blobs.piece_bytes(n_buckets)):
                row, s, e, at, key, data, starts = _runs(part)
                k = _chosen(part, "often", row, s, starts)
                start = _ranges(s[k], e[k])
                size = e[k] - s[k] + 1
                owner = np.repeat(k, size)
                key = tv.mix(_window_hashes(data, s[k], e[k]) ^ key[owner] ^ (at[owner] - start).astype(np.uint64))
                ids = np.asarray(part.column("row"))[row[owner]]
                pos = start - starts[row[owner]]
                order = np.argsort(key, kind="stable")
                head, run_of = blobs.groups(key[order])
                many = (np.diff(np.concatenate([head, [len(order)]])) > 1)[run_of] if len(order) else np.zeros(0, bool)
                sent = np.sort(order[head])
                k = key[sent]
                dealt = blobs.deal((k % np.uint64(n_buckets)).astype(np.int64), n_buckets, ids[sent], pos[sent], [(k >> np.uint64(16), 6)])
                yield _spans(_send([(b, blob) for b, blob, _ in dealt], n_buckets, ids[order[many]], pos[order[many]]))

    return run


def _window_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of all windows that start in the given ranges."""
    out = []
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        for c in range(a, b + 1, _CHUNK):
            d = min(b + 1, c + _CHUNK)
            raw = data[c : d + WINDOW - 1]
            p = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(tv._VALUE[raw] * tv._POW[: len(raw)], out=p[1:])
            out.append((p[WINDOW:] - p[:-WINDOW]) * tv._INV[: d - c])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _to_spans(pos: np.ndarray) -> np.ndarray:
    """Positions as pairs (first, last) of their maximal runs, in one array."""
    pos = np.unique(pos)
    if not len(pos):
        return pos
    cut = np.flatnonzero(np.diff(pos) > 1)
    return np.stack([pos[np.concatenate([[0], cut + 1])], pos[np.concatenate([cut, [len(pos) - 1]])]], axis=1).ravel()


def _spans(data):
    """Every list of positions as spans."""
    lists = data.column("pos")
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    out = [_to_spans(np.asarray(x.values)) if x.is_valid else None for x in lists]
    return data.set_column(data.schema.get_field_index("pos"), "pos", pa.array(out, pa.list_(pa.int32())))


def _again(table: pa.Table) -> pa.Table:
    """Step 2, in buckets: windows whose hash comes from several tasks."""
    doc, pos, (key,) = blobs.decode_all(table, [6])
    order = np.argsort(key, kind="stable")
    head, run_of = blobs.groups(key[order])
    keep = (np.diff(np.concatenate([head, [len(order)]])) > 1)[run_of] if len(order) else np.zeros(0, bool)
    ids, lists = blobs.by_doc(doc[order[keep]], pos[order[keep]])
    return pa.concat_tables([_settled(table), _spans(pa.table({"doc_id": pa.array(ids, pa.int64()), "pos": lists.cast(pa.list_(pa.int32()))}))])


def _contexts(n_buckets: int):
    """Step 3, in tasks: contexts of the runs that are left; those equal within the batch are settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.pieces(batch, most=blobs.piece_bytes(n_buckets)):
                row, s, e, at, key, data, starts = _runs(part)
                k = _chosen(part, "seldom", row, s, starts)
                row_k, s_k, e_k, at_k, key_k = row[k], s[k], e[k], at[k], key[k]
                lists = part.column("left")
                if len(lists) > lists.null_count and len(s):  # narrowed spans, cut at the runs that own their windows
                    sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0))
                    spans = (np.asarray((lists.drop_null() if lists.null_count else lists).flatten(), dtype=np.int64) + np.repeat(starts, sizes)).reshape(-1, 2)
                    pos = _to_spans(_ranges(spans[:, 0], spans[:, 1])).reshape(-1, 2)
                    i, j = np.searchsorted(s, pos[:, 0], "right") - 1, np.searchsorted(s, pos[:, 1], "right") - 1
                    owner = _ranges(i, j)
                    of = np.repeat(np.arange(len(pos)), j - i + 1)
                    a, b = np.maximum(pos[of, 0], s[owner]), np.minimum(pos[of, 1], e[owner])
                    row_k, s_k, e_k, at_k, key_k = (np.concatenate(x) for x in ((row_k, row[owner]), (s_k, a), (e_k, b), (at_k, at[owner]), (key_k, key[owner])))
                ids = np.asarray(part.column("row"))
                raw = data.tobytes()
                seen: dict[tuple, int] = {}
                size = np.zeros(len(s_k), np.int64)
                settled: set[int] = set()
                for i, (a, b, c, h) in enumerate(zip(s_k.tolist(), (e_k + WINDOW).tolist(), at_k.tolist(), key_k.tolist(), strict=True)):
                    f = seen.setdefault((h, c - a, xxhash.xxh3_128_intdigest(raw[a:b])), i)
                    if f == i:
                        size[i] = b - a
                    else:
                        settled.add(f)
                        settled.add(i)
                sent = np.flatnonzero(size)
                r, a, m, h = row_k[sent], s_k[sent], size[sent], key_k[sent]
                keys = [((at_k[sent] - a).astype(np.uint64), 2), (m.astype(np.uint64), 4), (h, 8)]
                rows = []
                for b, head, i in blobs.deal((h % np.uint64(n_buckets)).astype(np.int64), n_buckets, ids[r], a - starts[r], keys):
                    rows.append((b, len(head).to_bytes(8, "little") + head + b"".join(raw[p : p + x] for p, x in zip(a[i].tolist(), m[i].tolist(), strict=True))))
                done = np.array(sorted(settled), np.int64)
                pairs = np.stack([s_k[done], e_k[done]], axis=1) - starts[row_k[done]][:, None]
                yield _send(rows, n_buckets, np.repeat(ids[row_k[done]], 2), pairs.ravel())

    return run


def _sorted_out(table: pa.Table) -> pa.Table:
    """Step 3, in buckets: spans of the windows that lie in a class of two contexts or more."""
    doc, pos, left, size, key, raw = [], [], [], [], [], []
    for b in table.column("blob").combine_chunks():
        if b.is_valid:
            b = b.as_buffer().to_pybytes()
            n = int.from_bytes(b[:8], "little")
            d, p, (x, m, h) = blobs.decode(b[8 : 8 + n], [2, 4, 8])
            for to, v in zip((doc, pos, left, size, key, raw), (d, p, x.astype(np.int64), m.astype(np.int64), h, np.frombuffer(b, np.uint8)[8 + n :]), strict=True):
                to.append(v)
    if not doc:
        return _settled(table)
    doc, pos, left, size, key, raw = map(np.concatenate, (doc, pos, left, size, key, raw))
    begin = np.cumsum(size) - size
    some = np.bincount(np.unique(key, return_inverse=True)[1])  # anchors of one context have nothing to share
    alone = some[np.unique(key, return_inverse=True)[1]] < 2
    keep = np.flatnonzero(~alone)
    doc, pos, left, size, key, begin = doc[keep], pos[keep], left[keep], size[keep], key[keep], begin[keep]
    n, wide = len(doc), WINDOW - GRAM
    if not n:
        return _settled(table)
    right_rows, left_rows = np.zeros((n, WINDOW), np.uint8), np.zeros((n, wide), np.uint8)
    for k in range(0, n, 4096):
        q = slice(k, k + 4096)
        o = np.arange(WINDOW)
        i = begin[q, None] + left[q, None] + o
        inside = o < (size[q] - left[q])[:, None]
        right_rows[q] = np.where(inside, raw[np.where(inside, i, 0)], 0)
        o = np.arange(wide)
        i = begin[q, None] + left[q, None] - 1 - o
        inside = o < left[q][:, None]
        left_rows[q] = np.where(inside, raw[np.where(inside, i, 0)], 0)
    right_order, right_shared = deep_shallow(right_rows, key)
    left_order, left_shared = deep_shallow(left_rows, key)
    del right_rows, left_rows

    def longest(order: np.ndarray, shared: np.ndarray) -> np.ndarray:
        out = np.empty(n, np.int64)
        out[order] = np.maximum(shared, np.concatenate([shared[1:], [-1]]))
        return out

    # a window needs o bytes on the left and WINDOW - o on the right in common with one other context
    most_left, most_right = longest(left_order, left_shared), longest(right_order, right_shared)
    lo, hi = np.maximum(left - (size - WINDOW), WINDOW - most_right), np.minimum(left, most_left)
    found = np.zeros((n, wide + 3), bool)
    for o in range(int(max(0, lo.min())), int(min(wide, hi.max())) + 1):
        now = np.flatnonzero((lo <= o) & (o <= hi))
        if len(now) < 2:
            continue
        a, b = np.empty(n, np.int64), np.empty(n, np.int64)
        a[left_order] = np.cumsum(left_shared < o)
        b[right_order] = np.cumsum(right_shared < WINDOW - o)
        both = a[now] * (n + 1) + b[now]
        order = np.argsort(both)
        same = both[order][1:] == both[order][:-1]
        found[now[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]], o + 1] = True
    step = np.diff(found.astype(np.int8), axis=1)  # column o changes between o - 1 and o
    i, up = np.nonzero(step == 1)
    _, down = np.nonzero(step == -1)
    spans = np.stack([pos[i] + left[i] - (down - 1), pos[i] + left[i] - up], axis=1)
    ids, lists = blobs.by_doc(np.repeat(doc[i], 2), spans.ravel())
    return pa.concat_tables([_settled(table), pa.table({"doc_id": pa.array(ids, pa.int64()), "pos": lists.cast(pa.list_(pa.int32()))})])


def _of_rows(found: DataFrame, name: str) -> DataFrame:
    return found.groupBy(F.col("doc_id").alias("row")).agg(F.flatten(F.collect_list("pos")).alias(name))


def _cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tv.pieces(batch):
            total, removed, runs, kept = [], [], [], []
            for text, pos in zip(part.column("text"), part.column("pos"), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                total.append(len(raw))
                spans = 0
                if pos.is_valid and len(pos.values):
                    pairs = np.asarray(pos.values, dtype=np.int64).reshape(-1, 2)
                    edge = np.zeros(len(raw) + 1, np.int32)
                    np.add.at(edge, np.minimum(pairs[:, 0], len(raw)), 1)
                    np.add.at(edge, np.minimum(pairs[:, 1] + WINDOW, len(raw)), -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0])
                    raw = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                removed.append(total[-1] - len(raw))
                runs.append(spans)
                kept.append(raw)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeated_bytes(docs: DataFrame, often: int = OFTEN) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the remaining bytes).

    Removed are the bytes covered by a 400-byte string that also starts anywhere else, in the same document too.
    """
    docs = docs.select("doc_id", "text")
    n = blobs.buckets_for(docs)
    lean_batches(docs, blobs.piece_bytes(n))
    rows = docs.withColumn("row", F.xxhash64(F.coalesce("doc_id", F.lit(blobs.NO_ID)), "text"))
    long = rows.where(F.octet_length("text") >= WINDOW).select("row", "text")
    flagged = stored(long.mapInArrow(_enter(n, often), _SHIPPED).groupBy("bucket").applyInArrow(tv.lean(_repeated(often)), _FLAGGED), "anchors")
    lists = lambda often: F.flatten(F.collect_list(F.when(F.col("often") == often, F.col("pos")))).alias("often" if often else "seldom")
    marks = flagged.groupBy(F.col("doc_id").alias("row")).agg(lists(True), lists(False))
    once = long.groupBy("row").agg(F.first("text").alias("text"), F.count("*").alias("times"))
    marked = stored(once.join(marks, "row"), "marked")
    discard(flagged)
    narrowed = marked.where(F.size("often") > 0).select("row", "text", "often").mapInArrow(_narrow(n), _SHIPPED)
    left = stored(narrowed.groupBy("bucket").applyInArrow(tv.lean(_again), _FOUND), "windows")
    runs = marked.select("row", "text", "seldom").join(_of_rows(left, "left"), "row", "left").where((F.size("seldom") > 0) | F.col("left").isNotNull())
    found = stored(runs.mapInArrow(_contexts(n), _SHIPPED).groupBy("bucket").applyInArrow(tv.lean(_sorted_out), _FOUND), "repeats")
    whole = marked.where("times > 1").select(F.col("row").alias("doc_id"), F.array(F.lit(0), F.octet_length("text") - WINDOW).alias("pos"))
    spans = stored(_of_rows(found.unionByName(whole), "pos"), "spans")  # stored, so that Spark splits the join of a row with many copies
    discard(marked, left, found)
    return rows.join(spans, "row", "left").select("doc_id", "text", "pos").mapInArrow(_cover, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
