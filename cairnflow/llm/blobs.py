"""Entries (document, position, key) of many documents, shuffled as one binary value per batch and bucket.

Numbers are cut to the bytes that the batch needs. The number of buckets follows the size of the input, so that a
bucket holds the entries of about ``BUCKET_BYTES`` of it, and batches grow with it, so that values do not get too small.
Beyond ``MOST`` buckets (4 TB of input) a bucket's share grows: 95 MB of input at 100 TB.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

#: Bytes of input for a bucket; at least, at most so many buckets.
BUCKET_BYTES, LEAST, MOST = 4 << 20, 64, 1 << 20
#: Stands for a null id, and sorts after all others.
NO_ID = np.iinfo(np.int64).max


def buckets_for(df: DataFrame, each: int = BUCKET_BYTES) -> int:
    """A number of buckets after the size of the input that the plan reports."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return int(min(MOST, max(LEAST, size // each)))


def ids_of(column: pa.Array) -> np.ndarray:
    """Ids as integers, NO_ID for null."""
    return np.asarray(column.cast(pa.int64()).fill_null(NO_ID))


def ids_back(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)


def piece_bytes(n_buckets: int) -> int:
    """Bytes of text that are dealt over the buckets at once: 4 MB, more for very many buckets."""
    return min(32 << 20, max(4 << 20, n_buckets << 8))


def _cut(a: np.ndarray, width: int) -> np.ndarray:
    """Rows of the low bytes of unsigned numbers."""
    return np.ascontiguousarray(a.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :width])


def _width(most: int) -> int:
    return max(1, (int(most).bit_length() + 7) // 8)


def _whole(raw: np.ndarray, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = raw.reshape(n, width)
    return out.view("<u8").ravel()


def deal(bucket: np.ndarray, n_buckets: int, docs: np.ndarray, pos: np.ndarray, keys: list[tuple[np.ndarray, int]], tags: np.ndarray | None = None) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """(bucket, blob, entries) for every bucket that has entries; each key with the number of its low bytes to keep.

    ``tags`` tell the rows of one id apart, and take their room once for each run of entries of a row.
    """
    if not len(bucket):
        return
    order = np.argsort(bucket.astype(np.uint16 if n_buckets <= 1 << 16 else np.uint32), kind="stable")
    bucket, ids, pos = bucket[order], docs[order], pos[order]
    base = int(ids.min())
    other = (ids[1:] != ids[:-1]) | (bucket[1:] != bucket[:-1])
    if tags is not None:
        tags = tags[order]
        other |= tags[1:] != tags[:-1]
    new = np.flatnonzero(np.concatenate([[True], other]))
    tagged = np.zeros((len(new), 0), np.uint8) if tags is None else _cut(tags[new], 8)
    runs = np.diff(np.concatenate([new, [len(ids)]]))
    step = ids[new].view(np.uint64) - np.uint64(base & (1 << 64) - 1)
    widths = _width(step.max()), _width(runs.max()), _width(pos.max())
    columns = [_cut(step, widths[0]), _cut(runs, widths[1]), _cut(pos, widths[2]), *(_cut(k[order], w) for k, w in keys)]
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    ends = np.concatenate([first[1:], [len(bucket)]])
    at, until = np.searchsorted(new, first), np.searchsorted(new, ends)
    tail = base.to_bytes(8, "little", signed=True) + bytes(widths)
    for b, i, j, x, y in zip(bucket[first].tolist(), first.tolist(), ends.tolist(), at.tolist(), until.tolist(), strict=True):
        head = (j - i).to_bytes(4, "little") + (y - x).to_bytes(4, "little") + tail
        yield b, b"".join((head, columns[0][x:y].tobytes(), columns[1][x:y].tobytes(), tagged[x:y].tobytes(), *(c[i:j].tobytes() for c in columns[2:]))), order[i:j]


def decode(blob: bytes, widths: list[int], tagged: bool = False) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Documents, positions and keys of a blob, in the order in which they were dealt; the tags are one more key."""
    raw = np.frombuffer(blob, np.uint8)
    n, m = (int(x) for x in raw[:8].view("<u4"))
    base, own = raw[8:16].view("<i8")[0], raw[16:19].tolist()
    at = 19
    parts = []
    for size, width in [(m, own[0]), (m, own[1]), *([(m, 8)] * tagged), (n, own[2]), *((n, w) for w in widths)]:
        parts.append(_whole(raw[at : at + size * width], size, width))
        at += size * width
    runs = parts[1].astype(np.int64)
    docs = np.repeat((parts[0] + base.view(np.uint64)).view(np.int64), runs)
    tags = [np.repeat(parts.pop(2), runs)] if tagged else []
    return docs, parts[2].astype(np.int64), parts[3:] + tags


def decode_all(table: pa.Table, widths: list[int], tagged: bool = False) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The entries of all blobs of a bucket."""
    found = [decode(b.as_buffer(), widths, tagged) for b in table.column("blob").combine_chunks() if b.is_valid]
    n_keys = len(widths) + tagged
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), [np.zeros(0, np.uint64) for _ in range(n_keys)]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), [np.concatenate([f[2][i] for f in found]) for i in range(n_keys)]


def by_doc(docs: np.ndarray, pos: np.ndarray, once: bool = False) -> tuple[np.ndarray, pa.ListArray]:
    """Distinct documents with their positions as int lists (in no order; each position of a document only once, with ``once``)."""
    order = np.lexsort((pos, docs)) if once else np.argsort(docs, kind="stable")
    docs, pos = docs[order], pos[order]
    if once and len(docs):
        new = np.concatenate([[True], (docs[1:] != docs[:-1]) | (pos[1:] != pos[:-1])])
        docs, pos = docs[new], pos[new]
    new = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]])) if len(docs) else np.zeros(0, np.int64)
    return docs[new], pa.ListArray.from_arrays(pa.array(np.concatenate([new, [len(docs)]]), pa.int32()), pa.array(pos, pa.int32()))


def by_row(docs: np.ndarray, tags: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
    """Distinct pairs of document and tag with their distinct positions as int lists."""
    order = np.lexsort((pos, tags, docs))
    docs, tags, pos = docs[order], tags[order], pos[order]
    if len(docs):
        new = np.concatenate([[True], (docs[1:] != docs[:-1]) | (tags[1:] != tags[:-1]) | (pos[1:] != pos[:-1])])
        docs, tags, pos = docs[new], tags[new], pos[new]
    new = np.flatnonzero(np.concatenate([[True], (docs[1:] != docs[:-1]) | (tags[1:] != tags[:-1])])) if len(docs) else np.zeros(0, np.int64)
    return docs[new], tags[new], pa.ListArray.from_arrays(pa.array(np.concatenate([new, [len(docs)]]), pa.int32()), pa.array(pos, pa.int32()))


def flat(lists: pa.ChunkedArray, *of: np.ndarray) -> list[np.ndarray]:
    """The members of lists, and for each what ``of`` says of its list."""
    lists = lists.combine_chunks()
    sizes = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0), dtype=np.int64)
    return [np.asarray(lists.flatten(), dtype=np.int64), *(np.repeat(x, sizes) for x in of)]


def groups(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of each run of equal keys, and for each place the number of its run."""
    new = np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]) if len(sorted_keys) else np.zeros(0, bool)
    return np.flatnonzero(new), np.cumsum(new) - 1
