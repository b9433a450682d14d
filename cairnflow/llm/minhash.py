"""Near-duplicate documents by circulant MinHash.

A document is the set of its distinct five-word shingles. One permutation spreads the shingles over a
universe; a second one, circularly shifted by 0, 1, 2, ..., gives every coordinate of the signature
(C-MinHash, Li and Li, 2021), so two tables replace as many permutations as there are coordinates.
Bands of the signature propose pairs; a pair is a link only after its full sets are compared.

Defined results: a text without words, or null, has an empty set and no links; a text with fewer words
than a shingle is one shingle, the whole sequence; equal sets (by a 128-bit digest) are one class,
represented by its smallest id; rows with a null id are linked like others but come last, so that a class or
component has no id only where none of its rows has; repeated rows repeat in the result. Set members are
64-bit hashes of the shingles' words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnflow.llm import textvec as tv
from cairnflow.llm.components import components
from cairnflow.llm.shared import discard, free_name, lean_batches, stored

UNIVERSE = 1 << 22
ROWS, BANDS = 5, 24
#: Comparisons with hubs of other components before all that are left are compared.
ROUNDS = 5
SEED = 20211
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _permutations(width: int) -> tuple[np.ndarray, np.ndarray]:
    """The spreading permutation, and every circular run of ``width`` entries of the second one."""
    if width not in _tables:
        rng = np.random.Generator(np.random.PCG64(SEED))
        spread = rng.permutation(UNIVERSE).astype(np.uint32)
        ring = rng.permutation(UNIVERSE).astype(np.uint32)
        ring = np.concatenate([ring, ring[: width - 1]])
        _tables[width] = spread, np.lib.stride_tricks.sliding_window_view(ring, width)
    return _tables[width]


def signature(shingles: np.ndarray, width: int = ROWS * BANDS) -> np.ndarray:
    """The circulant MinHash signature of a non-empty set of 64-bit shingle hashes."""
    spread, ring = _permutations(width)
    at = spread[shingles & np.uint64(UNIVERSE - 1)]
    out = ring[at[:2048]].min(axis=0)
    for k in range(2048, len(at), 2048):
        np.minimum(out, ring[at[k : k + 2048]].min(axis=0), out=out)
    return out


def shingle_sets(batch: pa.RecordBatch, k: int = 5, lower: bool = True) -> Iterator[np.ndarray]:
    """For each text its distinct shingles, sorted."""
    data, starts, ends = tv.buffers(batch.column("text"))
    ws, we, first = tv.word_spans(data, starts, ends)
    words = tv.word_hashes(data, ws, we, lower)
    grams = tv.gram_hashes(words, k)
    for i in range(batch.num_rows):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= k:
            g = np.sort(grams[a : b - k + 1])
            yield g[np.concatenate([[True], g[1:] != g[:-1]])] if len(g) > 1 else g
        elif b > a:
            yield tv.mix(tv.gram_hashes(words[a:b], b - a) + np.uint64(b - a))
        else:
            yield words[:0]


def _bands(signatures: np.ndarray, bands: int) -> np.ndarray:
    """Band hashes (rows: documents), each different from band to band."""
    s = signatures.reshape(len(signatures), bands, ROWS).astype(np.uint64)
    h = np.broadcast_to(tv.mix(np.arange(1, bands + 1, dtype=np.uint64)), s.shape[:2]).copy()
    for r in range(ROWS):
        h = tv.mix(h * np.uint64(31) + s[:, :, r])
    return h.view(np.int64)


def _sketch(bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.pieces(batch):
                sizes, digests, rows, found = [], [], [], []
                for i, g in enumerate(shingle_sets(part)):
                    sizes.append(len(g))
                    digests.append(xxhash.xxh3_128_digest(g.tobytes()))
                    if len(g):
                        rows.append(i)
                        found.append(signature(g, ROWS * bands))
                counts = np.zeros(part.num_rows + 1, np.int32)
                counts[np.array(rows, np.int64) + 1] = bands
                flat = _bands(np.stack(found), bands).ravel() if found else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("tag"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(np.cumsum(counts, dtype=np.int32)), pa.array(flat))],
                    names=["doc_id", "tag", "n", "digest", "bands"],
                )

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tv.pieces(batch):
            sets = list(shingle_sets(part))
            ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], names=["key", "set"])


def _confirm(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct ``pairs`` (a, b) whose full sets, one a key, are similar enough."""
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("set").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", shared.alias("s"), (F.size("x") + F.size("y")).alias("t")).where(F.col("s") * 100 >= (F.col("t") - F.col("s")) * percent).select("a", "b")


def _gathered(df: DataFrame, used: list[DataFrame]) -> DataFrame:
    """What was gathered of each bucket, stored before it is joined back: only a join of two plain exchanges is one whose
    large buckets Spark deals over several tasks."""
    used.append(stored(df, "gathered"))
    return used[-1]


def _hubs(filed: DataFrame, used: list[DataFrame]) -> DataFrame:
    """The hub of every bucket with several keys: the smallest key after a scrambling that differs from bucket to bucket."""
    low = filed.groupBy("bucket").agg(F.min(F.col("key").bitwiseXOR(F.col("bucket"))).alias("o"), F.min("key").alias("l"), F.max("key").alias("h"))
    return _gathered(low.where("l < h").select("bucket", F.col("o").bitwiseXOR(F.col("bucket")).alias("hub")), used)


def _mixed(filed: DataFrame, used: list[DataFrame]) -> DataFrame:
    """The buckets with keys of several components."""
    return _gathered(filed.groupBy("bucket").agg(F.min("comp").alias("l"), F.max("comp").alias("h")).where("l < h").select("bucket"), used)


def _star(near: DataFrame) -> DataFrame:
    """For each key the one hub with which it shares most buckets, from rows (key, hub)."""
    best = near.groupBy("key", "hub").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("hub", F.struct("c", "hub")).alias("hub"))
    return best.select(F.least("key", "hub").alias("a"), F.greatest("key", "hub").alias("b")).distinct()


def _rarest(sets: DataFrame, percent: int, used: list[DataFrame]) -> DataFrame:
    """(key, n, alone, shared): of each set's rarest shingles those that other sets hold too, any two similar sets sharing one.

    Shingles are ordered by how many of the sets hold them; those of a single set come first and are
    counted only. Two sets over the bound share a shingle among the first n - ceil(n * percent / 100) + 1.
    """
    each = sets.select("key", F.size("set").alias("n"), F.explode("set").alias("bucket"))
    held = _gathered(each.groupBy("bucket").agg(F.count("*").alias("df")).where("df > 1"), used)
    ordered = each.join(held, "bucket").groupBy("key", "n").agg(F.sort_array(F.collect_list(F.struct("df", "bucket"))).alias("shared"))
    alone = F.col("n") - F.size("shared")
    length = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - alone
    return ordered.where(length > 0).select("key", "n", alone.alias("alone"), F.slice("shared", F.lit(1), length.cast("int"))["bucket"].alias("shared"))


def _spread(rarest: DataFrame) -> DataFrame:
    """A row for each shared shingle: bucket, and at, its place in the rarity order; with the other columns."""
    others = [c for c in rarest.columns if c != "shared"]
    return rarest.select(*others, F.posexplode("shared").alias("i", "bucket")).select("bucket", *others, (F.col("alone") + F.col("i")).alias("at"))


def _rare_prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(bucket, key, n, alone, at) of the shared ones among each set's rarest shingles."""
    return _spread(_rarest(sets, percent, []))


def _may(percent: int):
    """Whether sizes and places in the rarity order allow the pair (x, y) to be similar."""
    need = F.ceil((F.col("n_x") + F.col("n_y")) * percent / (100 + percent))
    return F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y")) >= need


def _central(now: DataFrame, percent: int, used: list[DataFrame]) -> DataFrame:
    """Pairs of every key with two hubs of other components: that of most common buckets, and the most central one.

    The hub of a bucket is the key with the fewest shingles of its own, so the one that most others resemble.
    """
    hubs = now.groupBy("bucket").agg(F.min(F.struct("alone", "at", "n", "key", "comp")).alias("h")).select("bucket", *(F.col(f"h.{c}").alias(f"{c}_y") for c in ("key", "comp", "at", "n", "alone")))
    near = _side(now, "x").join(_gathered(hubs, used), "bucket").where((F.col("comp_x") != F.col("comp_y")) & _may(percent))
    each = near.groupBy("key_x", "key_y").agg(F.count("*").alias("c"), F.min("alone_y").alias("alone"))
    picks = each.groupBy("key_x").agg(F.max_by("key_y", F.struct("c", "key_y")).alias("p"), F.min_by("key_y", F.struct("alone", "key_y")).alias("q"))
    pairs = picks.select("key_x", F.explode(F.array_distinct(F.array("p", "q"))).alias("key_y"))
    return pairs.select(F.least("key_x", "key_y").alias("a"), F.greatest("key_x", "key_y").alias("b")).distinct()


def _side(filed: DataFrame, s: str) -> DataFrame:
    return filed.select("bucket", *(F.col(c).alias(f"{c}_{s}") for c in ("key", "comp", "at", "n")))


def _components(docs: DataFrame, percent: int, bands: int) -> DataFrame:
    """One row per row of ``docs``: doc_id, tag (the hash of its text), n, own and best (the representatives of
    its class and component: none, doc_id, tag of their least row; null without words)."""
    lean_batches(docs)
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("tag"))
    sketch = stored(docs.mapInArrow(_sketch(bands), "doc_id long, tag long, n long, digest binary, bands array<long>"), "sketch")
    least = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")
    whole = sketch.where("n > 0").groupBy("digest").agg(F.min(least).alias("own"), F.first("bands").alias("bands"))
    classes = stored(whole.withColumn("key", F.monotonically_increasing_id()), "classes")  # numbered once: the files hold the numbers
    filed = classes.select("key", F.explode("bands").alias("bucket"))
    used: list[DataFrame] = []
    members = stored(filed.join(_hubs(filed, used), "bucket"), "members")
    tried = stored(_star(members.where("key <> hub")), "tried")
    firsts = classes.join(members.select("key").distinct(), "key", "left_semi").select("key", F.col("own.doc_id").alias("id"), F.col("own.tag").alias("of"))
    keyed = docs.join(firsts, docs["doc_id"].eqNullSafe(firsts["id"]) & (docs["tag"] == firsts["of"])).select("key", "text")
    sets = stored(keyed.mapInArrow(_sets, "key long, set array<long>").groupBy("key").agg(F.first("set").alias("set")), "sets")
    links = stored(_confirm(sets, tried, percent), "links")
    joined = components(links)
    used += [members, tried, sets, links]

    labelled = members.select("bucket", "key").join(joined.withColumnRenamed("node", "key"), "key", "left").select("bucket", "key", F.coalesce("component", "key").alias("comp"))
    open_keys = labelled.join(_mixed(labelled, used), "bucket", "left_semi").select("key").distinct()
    rare = stored(_rarest(sets.join(open_keys, "key", "left_semi"), percent, used), "rare")
    found = True
    used.append(rare)
    for step in range(ROUNDS + 1):
        now = _spread(rare.join(joined.withColumnRenamed("node", "key"), "key", "left").select("key", F.coalesce("component", "key").alias("comp"), "n", "alone", "shared"))
        now = stored(now.join(_mixed(now, used), "bucket", "left_semi"), "open")
        last = step == ROUNDS or not found
        if last:
            pairs = _side(now, "x").join(_side(now, "y"), "bucket").where((F.col("comp_x") < F.col("comp_y")) & _may(percent))
            pairs = pairs.select(F.least("key_x", "key_y").alias("a"), F.greatest("key_x", "key_y").alias("b")).distinct()
        else:
            pairs = _central(now, percent, used)
        more = stored(_confirm(sets, pairs, percent), "links")
        used += [now, more]
        if found := more.limit(1).count():
            links = links.union(more)
            before, joined = joined, components(links)
            used.append(before)
        if last:
            break
    discard(*used)
    of = joined.withColumnRenamed("node", "key").join(classes.select("key", "own"), "key")
    label = of.groupBy("component").agg(F.min("own").alias("best")).join(of.select("key", "component"), "component").select("key", "best")
    named = classes.select("digest", "key", "own").join(label, "key", "left").select("digest", "own", F.coalesce("best", "own").alias("best"))
    return sketch.select("doc_id", "tag", "n", "digest").join(named, "digest", "left").drop("digest")


def near_duplicates(docs: DataFrame, percent: int = 85, bands: int = BANDS) -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id, component_id, kept.

    Two documents are linked if 100 * |intersection| >= ``percent`` * |union|. ``class_id`` is the
    smallest id with the same set; ``component_id`` the smallest id reachable over links.

    Work: a class is compared with one hub of the band buckets that it shares, and the links found are
    contracted. Classes that still share a bucket with another component are filed under their rarest
    shingles (an exact filter); there they are compared with central hubs of other components as long as that
    finds links, and at last every pair from different components that sizes and places allow. So a group of near copies costs about one
    comparison a member, and no link between components is left out among the band buckets' classes.
    With 24 bands of five coordinates a pair at 0.85 meets in no bucket with probability 1e-6.
    """
    rows = _components(docs, percent, bands)
    ids = [F.when(F.col("n") > 0, F.col(f"{c}.doc_id")).otherwise(F.col("doc_id")) for c in ("own", "best")]
    return rows.select("doc_id", F.col("n").alias("n_shingles"), ids[0].alias("class_id"), ids[1].alias("component_id")).withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))


def keep_one(docs: DataFrame, percent: int = 80, bands: int = 36) -> DataFrame:
    """The rows of ``docs``, with all their columns, of one document of each group: that of the smallest id (of
    several texts of one id, or where no row has an id, that of the smallest hash). Of rows equal in id and text, whatever
    else they hold, the one whose columns have the smallest hash stays.

    With 36 bands a pair at 0.8 meets in no bucket with probability 1e-6. Rows without words stay, those equal in all
    columns once.
    """
    mark, same, tag = free_name(docs, "_id"), free_name(docs, "_text"), free_name(docs, "_tag")
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    mine = F.col("best.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("best.tag") == F.col("tag"))
    kept = _components(docs, percent, bands).where(mine).select(F.col("doc_id").alias(mark), F.col("tag").alias(same)).distinct()
    tagged = docs.where(worded).withColumn(tag, F.xxhash64("text"))
    rows = tagged.join(kept, tagged["doc_id"].eqNullSafe(kept[mark]) & (tagged[tag] == kept[same]), "left_semi")
    row = F.struct(*docs.columns)
    one = rows.groupBy("doc_id", tag).agg(F.min_by(row, F.xxhash64(*docs.columns)).alias(mark)).select(f"{mark}.*")
    return one.union(docs.where(~worded).dropDuplicates())
