from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnflow.llm import bit_slices, divergence, oracles, queries


def terms(text):
    out, run = [], ""
    for c in (text or "") + " ":
        if ord(c) >= 128 or c.isascii() and c.isalpha():
            run += c.lower() if c.isascii() else c
        elif run:
            out.append(run)
            run = ""
    return out


def audit(rows, least, top):
    """rows: (text, lang, source). Over the whole grid, without histograms."""
    counts, held, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        counts[lang, source].update(terms(text))
        held[lang].update(set(terms(text)))
    out = set()
    f = lambda p, q: (p - q) ** 2 // q
    for lang, sources in groups.items():
        kept = [t for t, n in held[lang].items() if n >= least]

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 1) // (total + len(kept)) for t in kept}

        whole = shares(sum((counts[lang, s] for s in sources), Counter()))
        p = {s: shares(counts[lang, s]) for s in sources}
        for s in sources:
            found = {"pair": [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s], "term": [(-f(p[s][t], whole[t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > whole[t]]}
            for part, items in found.items():
                for rank, (value, item) in enumerate(sorted(items), 1):
                    if part == "pair" or rank <= top:
                        out.add((lang, s, part, item.decode(), -value, rank))
    return out


def rows_of(df):
    return {(r.lang, r.source, r.part, r.item, r.value, r.rank) for r in df.collect()}


def test_audit_against_the_whole_grid(spark, sf, documents):
    df, _ = documents
    data = [(r.text, r.lang, r.source) for r in df.collect()]
    assert rows_of(divergence.audit(df, 2, 7)) == audit(data, 2, 7)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    assert rows_of(queries.op12_count_histograms(spark, sf)) == {tuple(r) for r in con.execute(oracles.divergences()).fetchall()} == audit(data, 3, 200)


def test_audit_of_odd_rows(spark, hostile, no_rows):
    df, _ = hostile
    assert rows_of(divergence.audit(df, 1)) == audit([(r.text, r.lang, r.source) for r in df.collect()], 1, 200)
    assert divergence.audit(no_rows).count() == 0
    odd = [(1, "Straße straße STRASSE İx", "de", "a"), (1, "Straße x", "de", "a"), (2, None, "de", "b"), (None, "", "de", None), (3, "e 1 2", None, None), (4, "12 34", None, "z"), (5, "x[y\\z`w{v", "de", "b"), (6, "日本 語x", "ja", "one")] + [(7, "of " * 5000, "de", "c")] * 3
    df = spark.createDataFrame([(*r, 7) for r in odd], "doc_id long, text string, lang string, source string, term int")
    for least in (1, 2, 9):
        assert rows_of(divergence.audit(df, least)) == audit([r[1:] for r in odd], least, 200)


def test_histograms_cover_all_terms(spark):
    counts = spark.createDataFrame([("l", "a", "x", 1), ("l", "a", "y", 1), ("l", "b", "x", 2), ("l", "b", "z", 2)], "lang string, source string, term string, n long")
    groups = spark.createDataFrame([("l", s, 6) for s in "abc"], "lang string, source string, terms long")
    out = {(r.a, r.b, r.x, r.y): r.m for r in divergence.histograms(counts, groups).collect()}
    assert out == {("a", "b", 1, 2): 1, ("a", "b", 1, 0): 1, ("a", "b", 0, 2): 1, ("a", "b", 0, 0): 3, ("a", "c", 1, 0): 2, ("a", "c", 0, 0): 4, ("b", "c", 2, 0): 2, ("b", "c", 0, 0): 4}


def test_shares_beyond_64_bits(spark):
    n = 40_000_000_000
    r = spark.range(1).select(divergence.share(F.lit(n), F.lit(3 * n), F.lit(7)).alias("p")).first()
    assert r.p == 1 + 1_000_000_000 * (n + 1) // (3 * n + 7)


def negatives(rows, every=10, k=5, least=80):
    """rows: (vec_id, vector, label), sound ones only."""
    vec = {i: [int(np.floor(256.0 * x)) for x in v] for i, v, _ in rows}
    label = {i: lab for i, _, lab in rows}
    out = set()
    for a in (i for i in vec if i % every == 0):
        score = {i: sum(x * y for x, y in zip(vec[a], vec[i], strict=True)) for i in vec if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if label[i] == label[a]][:k]:
            fit = [i for i in order if label[i] != label[a] and least * score[p] <= 100 * score[i] <= 100 * score[p]]
            out |= {(a, p, rank, n, score[p], score[n]) for rank, n in enumerate(fit[:k], 1)}
    return out


COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mined(df, every=10, **kw):
    return {tuple(r[c] for c in COLUMNS) for r in bit_slices.mine(df, F.col("vec_id") % every == 0, **kw).collect()}


def table(spark, rows):
    return spark.createDataFrame([(*r, 0.5, "b") for r in rows], "vec_id long, embedding array<double>, label int, score double, block string")


def test_query_against_all_products(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    got = con.execute(oracles.hard_negatives())
    names = [d[0] for d in got.description]
    want = {tuple(r[names.index(c)] for c in COLUMNS) for r in got.fetchall()}
    assert {tuple(r[c] for c in COLUMNS) for r in queries.op13_bit_sliced_negatives(spark, sf).collect()} == want and want


def test_negatives_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(bit_slices, "BLOCK", 40)
    monkeypatch.setattr(bit_slices, "ANCHORS", 7)
    monkeypatch.setattr(bit_slices, "AT_ONCE", 3)
    rng = np.random.default_rng(4)
    centre = rng.normal(0, 0.2, (3, 12))
    rows = [(i, (centre[i % 3] + rng.normal(0, 0.1, 12)).tolist(), int(rng.integers(0, 3))) for i in range(300)]
    assert mined(table(spark, rows)) == negatives(rows)


def test_negatives_of_copies_and_ties(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [1.0, 0.5, 0.0], i % 2) for i in range(80)] + [(100 + i, rng.integers(-3, 3, 3).astype(float).tolist(), i % 3) for i in range(60)]
    assert mined(table(spark, rows)) == negatives(rows)
    assert mined(table(spark, rows), k=2, least=50) == negatives(rows, k=2, least=50)


def test_negatives_of_odd_rows(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(0, 1, 4).tolist(), i % 2) for i in range(40)]
    odd = [(None, [1.0] * 4, 1), (200, None, 1), (210, [1.0, None, 0.0, 0.0], 1), (220, [1.0, float("nan"), 0.0, 0.0], 1), (230, [1.0, float("inf"), 0.0, 0.0], 0), (240, [1.0] * 4, None), (250, [1.0], 1), (260, [], 1), rows[3], rows[10]]
    assert mined(table(spark, rows + odd)) == negatives(rows)
    huge = [(i, [3e5 * (i + 1), -1.0 * i, 3.0], i % 2) for i in range(30)]
    assert mined(table(spark, huge)) == negatives(huge)
    assert mined(table(spark, [])) == set() == mined(table(spark, rows[:1]))
    with pytest.raises(Exception, match="(?i)overflow|too (large|big)"):
        mined(table(spark, [(i, [1e300, float(i)], i % 2) for i in range(30)]))


def test_planes_give_exact_products():
    rng = np.random.default_rng(2)
    a, x = rng.integers(-300, 300, (9, 16)).astype(float), rng.integers(-500, 90, (50, 16)).astype(float)
    for kind in (float, object):
        p, q = a.astype(kind), x.astype(kind)
        if kind is object:
            p, q = (np.array([int(v) for v in m.ravel()], object).reshape(m.shape) for m in (a, x))
        widths = []

        def all_of(i, j, lo, hi, widths=widths):
            true = (a @ x.T)[i, j]
            assert (lo <= true).all() and (true <= hi).all()
            widths.append((hi - lo).max())
            return true > 1000

        i, j, score = bit_slices.products(p, bit_slices.Planes(q), np.ones((9, 50), bool), all_of)
        assert (score == (a @ x.T)[i, j]).all() and set(zip(i, j, strict=True)) == set(zip(*np.nonzero(a @ x.T > 1000), strict=True))
        assert widths == sorted(widths, reverse=True) and widths[-1] == 0
