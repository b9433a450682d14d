import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from cairnflow.llm import containment, crf, kmeans_tree, langid, lmscore, packing, queries, urlfilter
from tests.llm import brute

P = pytest.importorskip("public_tokenizers")
WORDS, BYTES = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")


def held(d):
    return zlib.crc32(str(d).encode()) % 5 == 0


def test_language_of_held_out_documents(spark, documents):
    df, rows = documents
    out = {r.doc_id: r for r in langid.identify(df, WORDS).collect()}
    lang = {r.doc_id: r.lang for r in df.collect()}
    assert all(r.held_out == held(d) and 0 <= r.score <= 1 for d, r in out.items())
    tested = [d for d in out if held(d)]
    assert sum(out[d].lang_pred == lang[d] for d in tested) / len(tested) > 0.95
    hidden = df.selectExpr("doc_id", "text", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then null else lang end as lang")
    assert {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(hidden, WORDS).collect()} == {d: (r.lang_pred, r.score) for d, r in out.items()}


def test_language_of_odd_rows(hostile, no_rows):
    df, rows = hostile
    out = langid.identify(df, WORDS).collect()
    assert len(out) == len(rows)
    for r in out:
        text = dict(rows).get(r.doc_id)
        if r.doc_id is not None:
            assert (r.lang_pred == "und") == (text is None or not any(c.isalpha() for c in text))
    assert langid.identify(no_rows, WORDS).count() == 0
    assert {r.lang_pred for r in langid.identify(df.withColumn("lang", langid.F.lit(None).cast("string")), WORDS).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    pieces = [b"a", b"b", b"ab", b"ba", b"aba", b"\xff", b"a\xff"]
    prob = np.concatenate([np.random.default_rng(0).random((len(pieces), 2)), np.zeros((1, 2))])
    word = b"abaab\xff"

    def total(rest, k):
        return 1.0 if not rest else sum(prob[i, k] * total(rest[len(p) :], k) for i, p in enumerate(pieces) if rest.startswith(p))

    got = langid.forward(langid.Pieces(pieces).substrings(np.frombuffer(word, np.uint8)[None]), prob)[-1]
    assert np.allclose(got[0], [total(word, 0), total(word, 1)])


def test_expectations_of_long_words(monkeypatch):
    rng = np.random.default_rng(7)
    pieces = sorted({bytes([b]) for b in range(256)} | {bytes(rng.choice(list(b"abc\xe6"), n)) for n in (2, 3, 5) for _ in range(20)} | {b"a\xff", b"bc\xff"})
    prob = np.concatenate([rng.random((len(pieces), 2)) / 50, np.zeros((1, 2))])
    words = [bytes(rng.choice(list(b"abc\xe6"), n)) for n in (7, 12, 12, 30, 3)]
    data, weight = np.frombuffer(b" ".join(words), np.uint8), rng.integers(1, 5, (5, 2)).astype(float)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    finder = langid.Pieces(pieces)
    want = sum(langid._expected(finder.substrings(np.frombuffer(w + b"\xff", np.uint8)[None]), prob, weight[[i]]) for i, w in enumerate(words))
    got = langid.expected_long(data, ends - [len(w) for w in words], ends, finder, prob, weight)
    assert np.allclose(got[:-1], want[:-1]) and got[:-1].sum() > 0
    texts = [("x", "abcab bca " * 3 + "ca" * 30), ("y", "bb cc " * 5 + "cb" * 25 + " a")] * 2
    whole = langid.fit(texts, pieces)[1]
    monkeypatch.setattr(langid, "LONG", 1000)
    assert np.allclose(langid.fit(texts, pieces)[1], whole, rtol=1e-6)  # the same model by sums as by logarithms
    monkeypatch.setattr(langid, "LONG", 10)
    monkeypatch.setattr(langid, "LONG_BYTES", 70)
    assert sorted(langid._within([*texts, ("z", "q" * 500)])) == sorted({*texts, ("z", "q" * 500)})


def test_forward_over_long_words():
    rng = np.random.default_rng(2)
    pieces = sorted({bytes([b]) for b in range(256)} | {bytes(rng.choice(list(b"abc\xe6"), n)) for n in (2, 3, 5, 7) for _ in range(30)} | {b"a\xff", b"bc\xff"})
    prob = np.concatenate([rng.random((len(pieces), 3)) / 50, np.zeros((1, 3))])
    words = [bytes(rng.choice(list(b"abc\xe6"), n)) for n in (5, 41, 41, 120, 300, 77)]
    data = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    got = langid.forward_long(data, ends - [len(w) for w in words], ends, langid.Pieces(pieces), prob)
    for w, value in zip(words, got, strict=True):
        logs = [np.zeros(3)]
        for j in range(1, len(w) + 2):
            s = (w + b"\xff")[:j]
            terms = [logs[j - len(p)] + np.log(prob[i]) for i, p in enumerate(pieces) if s.endswith(p)]
            logs.append(np.logaddexp.reduce(terms, axis=0) if terms else np.full(3, -np.inf))
        assert np.allclose(value, logs[-1])


def test_language_of_texts_without_spaces(spark):
    known = [(i, ("de la que el en y a los" if i % 2 else "the of and to in is that") + f" {i}", "es" if i % 2 else "en") for i in range(60)]
    joined = [(100, "thatisthe\u00a0ofandtheinto" * 9, None), (101, "quelosen\u00a0delaqueel" * 9, None)]
    out = {r.doc_id: r.lang_pred for r in langid.identify(spark.createDataFrame(known + joined, "doc_id long, text string, lang string"), WORDS).collect()}
    assert (out[100], out[101]) == ("en", "es")
    vast = spark.createDataFrame([(i, ("the of and " if i % 2 else "de la que ") * 200_000, "en" if i % 2 else "es") for i in (1, 2, 3, 4)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.identify(vast, WORDS, 1).orderBy("doc_id").collect()] == ["en", "es", "en", "es"]  # languages with long texts alone are learned


def test_fit_raises_the_likelihood():
    texts = [("x", "aab aab aba"), ("y", "bba bbb bab")] * 5
    pieces = [bytes([b]) for b in range(256)] + [b"aa", b"bb", b"ab"]
    langs, prob = langid.fit(texts, pieces)
    assert langs == ["x", "y"] and np.allclose(prob.sum(axis=0), 1)
    assert langid.Scorer(pieces, prob).texts(langid.pa.array(["aab", "bbb"])).argmax(axis=1).tolist() == [0, 1]


def test_urls_equal_sql(spark, sf):
    odd = [None, "", "no scheme", "http://", "http://NET", "http://net/", "https://a.Net/x?y#z", "ftp://example.net/en/a", "http://example.net/en", "http://xexample.com/de/", "http://example.com/de/?q", "http://casino-win.example.org/fr/1",
           "http://www.casino-win.example.com:80/a", "http://u@spam-farm.org#f", "http://a://b/c", "HTTP://ORG/fr/", "http://.net/", "http://ads.example.com", "x://y.net\n/z", "http://example.org?//net/",
           "http://ads.a.org/x/banner/1", "http://b.ads.org/banner/", "http://bads.org/banner/", "http://c.org/track/a/b.GIF", "http://c.org/track/a.gif/", "http://c.org/wp-login.php", "http://c.org/WP-LOGIN.php5",
           "http://c.org/a/affiliate/1/click", "http://c.org/affiliate-click", "http://doorway.org/redirect", "http://c.org/utm-spam", "http://c.org/" + "x/" * 40_000 + "xmlrpc.php"]
    rows = [(i, u, "r", "h") for i, u in enumerate(odd)] + [(3, "http://net/", "r", "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string, host string")
    got = sorted(map(str, map(tuple, urlfilter.filter_urls(pages).collect())))
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", [r[:2] for r in rows])
    assert got == sorted(map(str, con.execute(urlfilter.oracle()).fetchall()))
    con.execute("drop table pages")
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    assert sorted(map(str, map(tuple, queries.op3_url_filters(spark, sf).collect()))) == sorted(map(str, con.execute(urlfilter.oracle()).fetchall()))
    assert urlfilter.filter_urls(pages.limit(0)).count() == 0
    assert [r.page_id for r in urlfilter.filter_urls(pages.selectExpr("cast(null as bigint) as page_id", "url").limit(2)).collect()] == [None, None]
    many = [urlfilter.Rule.pattern(f"/p{i}/*/q{i}^") for i in range(3000)]
    hits = spark.createDataFrame([(i, f"http://h.org/p{i}/x/q{i + i % 2}") for i in range(50)], "page_id long, url string")
    assert {r.page_id: r.patterns for r in urlfilter.filter_urls(hits, many).collect()} == {i: "" if i % 2 else f"/p{i}/*/q{i}^" for i in range(50)}
    with pytest.raises(ValueError):
        urlfilter.filter_urls(pages, [])


def test_cross_entropy_against_plain_counts(spark, documents):
    df, rows = documents
    size = 600
    target = spark.createDataFrame([(t,) for _, t in rows[:40]], "text string").repartition(3)
    got = {r.doc_id: r for r in lmscore.score(df, target, BYTES, size=size).collect()}
    tok = lmscore.tokenizer(BYTES, size)
    ids = lambda t: [i for w in brute.WORD.findall(t or "") for i in tok.encoder.encode(f" {w}", add_special_tokens=False).ids]

    def model(texts):
        c, one = defaultdict(Counter), Counter()
        for t in texts:
            before = size
            for i in ids(t):
                c[before][i] += 1
                one[i] += 1
                before = i
        n = sum(one.values())
        single = lambda i: (one[i] + 1) / (n + size)
        return lambda b, i: (c[b][i] + lmscore.PRIOR * single(i)) / (sum(c[b].values()) + lmscore.PRIOR)

    near = model([t for _, t in rows[:40]])
    for at, (d, t) in enumerate(rows[:15]):
        x, models = ids(t), (near, model([t for i, (_, t) in enumerate(rows) if i != at]))  # what is scored is held out
        loss = [-sum(math.log(m(b, i)) for b, i in zip([size, *x], x, strict=False)) / len(x) for m in models]
        assert got[d].n_tokens == len(x)
        assert np.allclose([got[d].ce_target, got[d].ce_background, got[d].score], [*loss, loss[1] - loss[0]], atol=1e-4)


def test_the_background_is_named_not_recognised(spark, documents):
    df, _ = documents
    docs, plain = df.limit(20), lambda rows: sorted((r.doc_id, round(r.score, 9)) for r in rows.collect())
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    apart = plain(lmscore.score(docs, docs, BYTES, docs, 500))
    assert apart == plain(lmscore.score(docs, docs, BYTES, docs.select("*"), 500)) != plain(lmscore.score(docs, docs, BYTES, size=500))


def test_a_background_apart_from_the_documents(spark):
    texts = ["a b c a b", "b c d", "a a b"]
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "d d")], "doc_id long, text string")
    table = spark.createDataFrame([(t,) for t in texts], "text string")
    out = lmscore.score(docs, table, BYTES, table, 600).collect()
    assert len(out) == 3 and all(abs(r.score) < 1e-12 and r.ce_target == r.ce_background for r in out)  # one corpus on both sides


def test_cross_entropy_of_odd_rows(spark, hostile, no_rows):
    df, rows = hostile
    out = lmscore.score(df, no_rows, BYTES, size=300).collect()
    assert len(out) == len(rows)
    assert all((r.ce_target is None and r.score == 0) if r.n_tokens == 0 else r.ce_target > 0 for r in out)
    assert lmscore.score(no_rows, no_rows, BYTES, no_rows, 300).count() == 0


def test_cross_entropy_counts_the_whole_vocabulary(spark):
    tok = lmscore.tokenizer(BYTES, lmscore.whole(BYTES))
    late = [w for w in ("mitochondria", "archipelago", "thermodynamic", "parliament") if max(tok.encoder.encode(f" {w}").ids) >= 2048]
    assert late
    docs = spark.createDataFrame([(i, w) for i, w in enumerate(late)], "doc_id long, text string")
    target = spark.createDataFrame([(f"{late[0]} " * 20,)], "text string")
    out = {r.doc_id: r for r in lmscore.score(docs, target, BYTES).collect()}
    assert all(out[i].n_tokens == len(tok.encoder.encode(f" {w}").ids) for i, w in enumerate(late))
    assert max(out.values(), key=lambda r: r.score).doc_id == 0


def check_packing(out, texts, window=packing.WINDOW):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    ids = {d: t.encode(x or "", add_special_tokens=False).ids + [1] for d, x in texts.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for d in ids:
        at = 0
        for start, length in sorted(pieces[d]):
            assert start == at
            at += length
        assert at == len(ids[d])
    padding = 0
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def test_packing_round_trip(documents):
    df, rows = documents
    assert check_packing(packing.pack(df, WORDS).collect(), dict(rows)) == 0


def test_packing_of_odd_rows(hostile, no_rows):
    df, rows = hostile
    out = packing.pack(df.where("doc_id is not null").dropDuplicates(["doc_id"]), WORDS).collect()
    assert check_packing(out, {d: t for d, t in rows if d is not None}) == 0
    whole = packing.pack(df, WORDS).collect()
    assert sum(r.length for r in whole if r.doc_id is None and r.start + r.length == r.doc_tokens) and len({(r.sequence_id, r.offset) for r in whole}) == len(whole)
    assert packing.pack(no_rows, WORDS).count() == 0


def test_sum_of_squares_choice():
    p = packing.Packer(8)
    rng = np.random.default_rng(0)
    for i in range(300):
        size = int(rng.integers(1, 8))
        c = p.count.copy()
        options = [g for g in range(0, 8 - size + 1) if g == 0 or c[g]]

        def cost(g, c=c, size=size):
            n = c.copy()
            n[g] -= g > 0
            if g + size < 8:
                n[g + size] += 1
            return int((n[1:8] ** 2).sum())

        assert cost(p.level(size)) == min(map(cost, options))
        p.add(i, np.ones(size, np.uint16))
    p.close()
    fill = Counter()
    for r in p.rows:
        fill[r[5]] += r[2]
    assert all(n & (n - 1) == 0 for n in fill.values())


def neighbours(vectors, queries_, k=5):
    out = {}
    for q, x in queries_:
        x = np.array(x, float)
        near = sorted((-float((x * np.array(y, float)).sum() / (np.sqrt((x * x).sum()) * np.sqrt((np.array(y, float) ** 2).sum()))), i) for i, y in vectors if i != q)
        out[q] = [(i, -s) for s, i in near[:k]]
    return out


def test_neighbours_of_the_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = neighbours(rows, [r for r in rows if r[0] % 50 == 0])
    got = defaultdict(list)
    for r in sorted(queries.op7_kmeans_tree(spark, sf).collect(), key=lambda r: r.rank):
        got[r.query_id].append((r.vec_id, r.score))
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))
    assert hit >= 0.9 and all([len(g) == 5 for g in got.values()]) and set(got) == set(want)


def test_neighbours_with_a_tree_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16))
    rows = [(i, (centres[i % 30] + 0.3 * rng.normal(size=16)).tolist()) for i in range(3000)]
    rows += [(3000 + i, rows[0][1]) for i in range(12)] + [(5, rows[5][1])]  # copies, and a repeated row
    odd = [(4000, None), (4050, [0.0] * 16), (4100, [float("nan")] + [1.0] * 15), (4150, [None] + [1.0] * 15), (4200, [1.0] * 7), (4250, [float("inf")] * 16), (None, rows[1][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(3)
    got = defaultdict(list)
    for r in sorted(kmeans_tree.search(df, df.where("vec_id % 50 = 0")).collect(), key=lambda r: r.rank):
        got[r.query_id].append((r.vec_id, r.score))
    want = neighbours(list(dict(rows).items()), [r for r in dict(rows).items() if r[0] % 50 == 0])
    assert set(got) == set(want)
    assert got[0] == want[0]  # ties go to the smaller ids
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in w}) for q, w in want.items()) / sum(map(len, want.values())) >= 0.9
    few = spark.createDataFrame([(0, [1.0, 0.0]), (50, [0.0, 1.0]), (7, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert kmeans_tree.search(few, few.where("vec_id % 50 = 0")).count() == 4
    assert kmeans_tree.search(few.limit(0), few).count() == 0
    clash = few.selectExpr("vec_id", "embedding", "1 as leaf", "2 as part", "3 as block", "4 as query_id", "5 as score")
    assert sorted(map(tuple, kmeans_tree.search(clash, clash.where("vec_id % 50 = 0")).collect())) == sorted(map(tuple, kmeans_tree.search(few, few.where("vec_id % 50 = 0")).collect()))


def test_neighbours_through_several_levels(spark):
    rng = np.random.default_rng(11)
    n, d = 30_000, 24
    centres = rng.normal(size=(300, d))
    x = (centres[rng.integers(0, 300, n)] + 0.7 * rng.normal(size=(n, d))).astype(np.float32)
    df = spark.createDataFrame(kmeans_tree.pa.table({"vec_id": np.arange(n), "embedding": kmeans_tree.pa.array(list(x), kmeans_tree.pa.list_(kmeans_tree.pa.float32()))})).repartition(4)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    tree = kmeans_tree.Tree(unit[:: n // 16_384 + 1], n // kmeans_tree.LEAF)
    tree.calibrate(unit[:: n // 16_384 + 1], 5)
    deep = [c for node in tree.children[tree.root] if node >= 0 for c in tree.children[node]]
    assert len(deep) > 20 and tree.n_leaves > 50 and tree.visits < tree.n_leaves / 2
    out = kmeans_tree.search(df, df.where("vec_id % 300 = 0")).collect()
    found = {(r.query_id, r.vec_id) for r in out}
    near = unit[::300] @ unit.T
    near[np.arange(len(near)), np.arange(0, n, 300)] = -2
    best = np.argsort(-near, axis=1)[:, :5]
    assert len(out) == 5 * len(best)
    assert np.mean([(300 * i, int(j)) in found for i, row in enumerate(best) for j in row]) >= 0.9
    kmeans_tree.QUERIES, before = 16, kmeans_tree.QUERIES  # a leaf's queries over several blocks
    try:
        assert {(r.query_id, r.rank, r.vec_id) for r in kmeans_tree.search(df, df.where("vec_id % 300 = 0")).collect()} == {(r.query_id, r.rank, r.vec_id) for r in out}
    finally:
        kmeans_tree.QUERIES = before


def contained(docs, items, percent=80):
    words = {d: brute.WORD.findall(brute.lower(t or "")) for d, t in docs}
    s = {n: {d: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for d, w in words.items()} for n in range(1, 6)}
    out = set()
    for i, t in items:
        own = brute.shingles(t)  # of an item of fewer than five words the whole sequence, looked for as such
        held = s[min(5, len(brute.WORD.findall(t or "")) or 5)]
        out |= {(d, i, len(own), len(own & x)) for d, x in held.items() if own and 100 * len(own & x) >= percent * len(own)}
    return out


def test_containment_equals_brute_force(spark, sf, documents):
    df, rows = documents
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    want = contained(rows, [(r.item_id, r.text) for r in items.collect()])
    assert want
    for bound in (containment.MOST_SHINGLES, 0):
        assert {(r.doc_id, r.item_id, r.n_item_shingles, r.n_shared) for r in containment.contained(df, items, most_shingles=bound).collect()} == want


def test_containment_of_odd_rows(spark, hostile, no_rows):
    df, rows = hostile
    words = dict(rows)[12].split()
    texts = [" ".join(words[500:540]), " ".join(words[9000:9006]), "one two", None, "", " ".join(words[100:130] + ["other"] * 3), dict(rows)[0], " ".join(words[500:540]), " ".join(["q"] + words[100:110] + ["r"] * 20)]
    items = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[0])], "item_id long, text string")
    want = contained([r for r in rows if r[0] is not None], list(enumerate(texts)))
    assert len(want) > 50
    for bound in (containment.MOST_SHINGLES, 0):
        assert {(r.doc_id, r.item_id, r.n_item_shingles, r.n_shared) for r in containment.contained(df, items, most_shingles=bound).collect()} == want
        left = containment.decontaminate(df, items, most_shingles=bound, least_words=1)
        assert left.schema == df.schema
        assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == sorted(d for d, _ in rows if d is not None and d not in {w[0] for w in want})
    assert containment.contained(no_rows, items).count() == 0
    assert containment.contained(df, items.limit(0)).count() == 0
    assert containment.decontaminate(df, items.limit(0)).count() == len(rows)


def test_decontamination_judges_every_row_by_its_text(spark):
    words = [f"w{i}" for i in range(400)]
    item, long, clean = " ".join(words[:20]), " ".join(words[100:300]), " ".join(words[300:])
    rows = [(None, f"a {item} b", 1), (None, clean, 2), (7, f"{item} c", 3), (7, clean, 4), (8, None, 5), (9, clean, 6), (10, f"x {item}", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key long")
    items = spark.createDataFrame([(1, item), (1, long)], "item_id long, text string")  # one id, two texts of different sizes
    for bound in (containment.MOST_SHINGLES, 0):
        left = containment.decontaminate(docs, items, most_shingles=bound)
        assert left.schema == docs.schema
        assert {tuple(r) for r in left.collect()} == {rows[i] for i in (1, 3, 4, 5)}
        assert {(r.doc_id, r.item_id, r.n_shared) for r in containment.contained(docs, items, most_shingles=bound).collect()} == {(7, 1, 16), (10, 1, 16)}


def test_short_items(spark):
    docs = spark.createDataFrame([(1, "the Capital of France Paris is"), (2, "capital of france"), (3, "paris"), (4, "of france paris capital"), (5, None), (6, "x capital of france paris")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "capital of france paris"), (2, "paris"), (3, ""), (4, "of  france")], "item_id long, text string")
    want = {(1, 1), (6, 1), (1, 2), (3, 2), (4, 2), (6, 2), (1, 4), (2, 4), (4, 4), (6, 4)}
    for bound in (containment.MOST_SHINGLES, 0):
        assert {(r.doc_id, r.item_id) for r in containment.contained(docs, items, most_shingles=bound).collect()} == want
        assert {r.doc_id for r in containment.decontaminate(docs, items, most_shingles=bound).collect()} == {2, 3, 4, 5}  # one or two words condemn no document


def test_hits_needed_keeps_the_miss_rate():
    for k in (16, 32, 64):
        m = containment.hits_needed(k, 80)
        miss = sum(math.comb(k, i) * 0.8**i * 0.2 ** (k - i) for i in range(m))
        assert m >= 1 and miss <= containment.MISS


def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = {r.doc_id: r for r in crf.classify(docs, labels).collect()}
    tested = [(r.quality, out[r.doc_id]) for r in labels.collect() if held(r.doc_id)]
    assert all(r.held_out and r.predicted == (r.score >= 0.3) for _, r in tested)
    assert sum(q == r.predicted for q, r in tested) / len(tested) > 0.95
    assert not [1 for q, r in tested if q == 1 and r.predicted == 0]


def test_quality_of_odd_rows(spark, hostile, no_rows):
    df, rows = hostile
    labels = spark.createDataFrame([(d, i % 2) for i, (d, _) in enumerate(rows)], "doc_id long, quality int")
    out = crf.classify(df, labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert {r.score for r in crf.classify(df, labels.limit(0)).collect()} == {0.5}
    assert crf.classify(no_rows, labels).count() == 0
    kept = crf.keep_good(df, labels.limit(0))
    assert kept.schema == df.schema and kept.count() == len(rows)


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(4)
    row = np.array([0, 0, 0, 2, 2, 5])
    good, table = rng.normal(size=6), rng.normal(size=(2, 2))
    marginal, steps, z = crf.Chains(row).marginals(good, table)
    total, want = 0.0, np.zeros(6)
    for own in ([0, 1, 2], [3, 4], [5]):
        sums, weight = np.zeros(6), 0.0
        for bits in np.ndindex(*[2] * len(own)):
            w = math.exp(sum(good[i] * b for i, b in zip(own, bits, strict=True)) + sum(table[a, b] for a, b in zip(bits, bits[1:], strict=False)))
            weight += w
            sums[own] += w * np.array(bits)
        want += sums / weight
        total += math.log(weight)
    assert np.allclose(marginal, want) and np.isclose(z, total) and np.isclose(steps.sum(), 3)
