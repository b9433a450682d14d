import hashlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairnflow.llm import bytes_dedup, components, minhash, queries, substrings, suffixes
from cairnflow.llm import textvec as tv
from tests.llm import brute


def keyed(rows):
    return {d: t for d, t in rows if d is not None}


def test_near_duplicates_equal_brute_force(documents):
    df, rows = documents
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()}
    assert got == brute.near(rows)


def test_near_duplicates_of_odd_rows(hostile):
    df, rows = hostile
    out = minhash.near_duplicates(df).collect()
    assert len(out) == len(rows)
    want = brute.near(list(keyed(rows).items()))
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out if r.doc_id is not None} == want
    assert [r.kept for r in out if r.doc_id == 13] == [True, True]
    assert {r.component_id for r in out if r.doc_id is None} == {None}


def test_near_duplicates_of_a_large_group(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for at in rng.integers(0, 120, rng.integers(0, 8)):
            w[at] = f"n{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for percent in (80, 85):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, percent, 36).collect()}
        assert got == brute.near(rows, percent)


def test_rare_prefixes_lose_no_similar_pair(spark):
    rng = np.random.default_rng(1)
    sets = [sorted(rng.choice(60, rng.integers(20, 40), replace=False).tolist()) for _ in range(60)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "key long, set array<long>")
    filed = minhash._rare_prefixes(df, 60).withColumn("comp", minhash.F.col("key"))
    pairs = minhash._side(filed, "x").join(minhash._side(filed, "y"), "bucket").where((minhash.F.col("key_x") < minhash.F.col("key_y")) & minhash._may(60)).select("key_x", "key_y").distinct()
    got = {(r.key_x, r.key_y) for r in pairs.collect()}
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            n = len(set(a) & set(b))
            if 100 * n >= 60 * len(set(a) | set(b)):
                assert (j, i) in got


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, 2), (5, 2), (9, 9), (7, 5)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(100, 141), 100), **dict.fromkeys((1, 2, 5, 7), 1)}


def test_bytes_equal_brute_force(documents):
    df, rows = documents
    for often in (1, 32):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in bytes_dedup.remove_repeated_bytes(df, often).collect()}
        assert got == brute.byte_dedup(rows)


def test_bytes_of_odd_rows(hostile):
    df, rows = hostile
    small = [(d, t) for d, t in rows if d not in (11, 12)]
    sample = df.where("doc_id is null or doc_id not in (11, 12)")
    # a repeated row repeats every string of its text: brute force sees it as another document
    want = brute.byte_dedup([(d if d is not None else 10**6 + i, t) for i, (d, t) in enumerate(small) if d != 13] + [(13, "ab " * 900), (10**7, "ab " * 900)])
    for often in (1, 32):
        out = bytes_dedup.remove_repeated_bytes(sample, often).collect()
        assert len(out) == len(small)
        assert all((r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) == want[r.doc_id] for r in out if r.doc_id is not None)
    whole = {r.doc_id: r for r in bytes_dedup.remove_repeated_bytes(df).collect()}
    assert (whole[11].n_removed, whole[11].n_spans, whole[12].n_removed) == (300_000, 1, 0)


def test_words_equal_brute_force(documents):
    df, rows = documents
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substrings.remove_repeats(df).collect()}
    assert got == brute.word_dedup(rows)


def test_words_of_odd_rows(hostile):
    df, rows = hostile
    out = substrings.remove_repeats(df).collect()
    assert len(out) == len(rows)
    want = brute.word_dedup(list(keyed(rows).items()))
    assert {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in out if r.doc_id is not None} == want


def test_rewrite_keeps_columns_and_untouched_texts(hostile):
    df, rows = hostile
    out = substrings.rewrite(df)
    assert out.schema == df.schema
    want = brute.word_dedup(list(keyed(rows).items()))
    for r in out.collect():
        if r.doc_id is not None:
            text = keyed(rows)[r.doc_id]
            assert (r.text == text) if not want[r.doc_id][1] else hashlib.sha256(r.text.encode()).hexdigest() == want[r.doc_id][2]
            assert r.n_chars == (None if r.text is None else len(r.text))
            assert (r.key, r.pos, r.kept, r._windows, r._id) == ("k", "p", "b", "w", "i")


def test_windows_stay_with_the_text_they_were_found_in(spark):
    word = iter(f"w{i:05d}" for i in range(10**5))
    text = lambda n: " ".join(next(word) for _ in range(n))
    passage, other, long, twice = text(70), text(70), text(70), text(70)
    rows = [
        (1, f"{passage} {text(30)}"), (None, f"{passage} {text(30)}"), (None, text(100)), (None, f"{text(30)} {text(90)}"),  # windows of one null id
        (2, f"{other} {text(30)}"), (5, text(100)), (5, f"{other} {text(30)}"),  # of one of an id's texts
        (None, f"{long} {text(9)}"), (None, f"{long} {text(8)}"), (6, twice), (6, twice), (7, None), (None, None),  # the same place in two null ids; equal rows
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in substrings.remove_repeats(df).collect())
    gone = {1: 70, 6: 70}
    own = [(d, len((t or "").split()), gone.get(i, 0)) for i, (d, t) in enumerate(rows)]
    first, second = [list(own), list(own)]  # which of two null ids comes first is up to their hashes
    first[7], second[8] = (None, 79, 70), (None, 78, 70)
    assert kept in [sorted((str(d), n, r) for d, n, r in x) for x in (first, second)]
    assert sorted(r.text or "" for r in substrings.rewrite(df).collect()) in [sorted(" ".join((t or "").split()[r:]) for (_, t), (_, _, r) in zip(rows, x, strict=True)) for x in (first, second)]
    whole = brute.byte_dedup([(i, t) for i, (_, t) in enumerate(rows)])
    for often in (1, 32):
        got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in bytes_dedup.remove_repeated_bytes(df, often).collect())
        assert got == sorted((str(d), *whole[i]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("name", sorted(set(queries.ORACLES)))
def test_registered_queries_equal_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    out = queries.QUERIES[name](spark, sf)
    assert sorted(out.columns) == sorted(columns)
    plain = lambda row: repr(tuple(round(v, 9) if isinstance(v, float) else v for v in row))
    assert sorted(plain(r[c] for c in columns) for r in out.collect()) == sorted(map(plain, want.fetchall()))


def test_empty_tables(no_rows):
    assert minhash.near_duplicates(no_rows).count() == 0
    assert minhash.keep_one(no_rows).count() == 0
    assert bytes_dedup.remove_repeated_bytes(no_rows).count() == 0
    assert substrings.remove_repeats(no_rows).count() == 0
    assert substrings.rewrite(no_rows).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=16, max_size=16) | st.text("ab", min_size=16, max_size=16).map(str.encode), min_size=1, max_size=40), st.integers(1, 3))
def test_deep_shallow_order(strings, n_groups):
    rows = np.frombuffer(b"".join(strings), np.uint8).reshape(-1, 16)
    group = np.array([i % n_groups for i in range(len(strings))], np.uint64)
    small = suffixes.SMALL
    for suffixes.SMALL in (1, 2, 64):
        order, shared = suffixes.deep_shallow(rows, group)
        got = [(int(group[i]), strings[i]) for i in order]
        assert got == sorted(got)
        for k in range(1, len(got)):
            a, b = got[k - 1], got[k]
            n = next((i for i in range(16) if a[1][i] != b[1][i]), 16)
            assert shared[k] == (n if a[0] == b[0] else -1)
    suffixes.SMALL = small


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("aB \n\té", max_size=30), min_size=1, max_size=8))
def test_words_and_hashes(texts):
    import pyarrow as pa

    data, starts, ends = tv.buffers(pa.array([None, *texts], pa.string()).slice(1))
    ws, we, first = tv.word_spans(data, starts, ends)
    h = tv.word_hashes(data, ws, we, True)
    words = [brute.WORD.findall(t) for t in texts]
    assert [data[a:b].tobytes().decode() for a, b in zip(ws, we, strict=True)] == [w for ws_ in words for w in ws_]
    assert np.diff(first).tolist() == [len(w) for w in words]
    flat = [brute.lower(w) for ws_ in words for w in ws_]
    for i, a in enumerate(flat):
        for j, b in enumerate(flat):
            assert (h[i] == h[j]) == (a == b)


def test_hash_of_a_word_longer_than_a_piece():
    raw = np.frombuffer(b"q" * (tv._PIECE + 5) + b" " + b"q" * (tv._PIECE + 5) + b" " + b"q" * (tv._PIECE + 4), np.uint8)
    ws, we, _ = tv.word_spans(raw, np.array([0]), np.array([len(raw)]))
    h = tv.word_hashes(raw, ws, we)
    assert h[0] == h[1] != h[2]
