import hashlib

import corpus_pipeline
from cairnflow.llm import crf
from cairnflow.llm.shared import stored
from tests.llm import brute
from tests.llm.test_scoring import WORDS, check_packing, contained  # noqa: F401


def test_stages_against_plain_steps(spark, documents):
    _, rows = documents
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = {r.doc_id for r in crf.classify(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1").collect()}
    state = {d: t for d, t in rows if d in good}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stored(stage(spark, docs, sf), name)
        if name == "near_duplicates":
            kept = brute.near(list(state.items()), 80)
            state = {d: t for d, t in state.items() if kept[d][2]}
        elif name == "substring_dedup":
            cut = brute.word_dedup(list(state.items()))
        elif name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            gone = {d for d, *_ in contained(list(state.items()), items)}
            state = {d: t for d, t in state.items() if d not in gone}
        if name == "packing":
            assert check_packing(docs.collect(), state) == 0
            break
        assert docs.schema == before.schema
        got = {r.doc_id: r.text for r in docs.collect()}
        assert got.keys() == state.keys()
        if name == "substring_dedup":
            assert all(got[d] == state[d] if not cut[d][1] else hashlib.sha256(got[d].encode()).hexdigest() == cut[d][2] for d in got)
            state = got
        else:
            assert got == state


def test_stages_on_odd_and_empty_tables(spark, hostile, tmp_path):
    df, rows = hostile
    spark.createDataFrame([(d, 1) for d, _ in rows], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (df, df.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stored(stage(spark, docs, str(tmp_path)), name)
            if name != "packing":
                assert out.schema == docs.schema
            docs = out
        assert bool(docs.count()) == bool(df is not None and out.count())


def test_run_and_registration(spark, sf):
    import __spark_entry__ as entry

    names = entry.queries()
    assert {f"op{n}_" for n in range(1, 11)} == {k.split("_")[0] + "_" for k in names if k.startswith("op")}
    assert corpus_pipeline.run(spark, sf).count() > 0 and "pipeline" in names


def test_registered_queries_give_a_row_for_every_document(spark, sf):
    from cairnflow.llm import queries

    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    columns = {
        "op1_segmentation_unigrams": ["doc_id", "held_out", "lang_pred", "score"],
        "op4_cross_entropy_difference": ["doc_id", "n_tokens", "ce_target", "ce_background", "score"],
        "op9_line_crf": ["doc_id", "held_out", "score", "predicted"],
    }
    for name, wanted in columns.items():
        out = queries.QUERIES[name](spark, sf).toPandas()
        assert list(out.columns) == wanted and len(out) == n and out["doc_id"].is_unique
        if name != "op4_cross_entropy_difference":
            assert out["score"].between(0, 1).all()
    pieces = queries.QUERIES["op6_sum_of_squares_packing"](spark, sf).toPandas()
    assert (pieces.groupby("doc_id")["length"].sum() == pieces.groupby("doc_id")["doc_tokens"].first()).all() and pieces["doc_id"].nunique() == n
    fill = pieces.groupby("sequence_id")["length"].sum()
    assert ((fill == 2048) | (fill & (fill - 1) == 0)).all()


def test_learning_reads_whole_texts_within_its_bound(spark, monkeypatch):
    good, bad = "\n".join(["Some words of a decent line of prose, and more of them."] * 300), "\n".join(["!!!! $$$$ 1234 |||"] * 300)
    texts = [(i, (good if i % 2 else bad) * (40 if i % 10 < 2 else 1)) for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i, _ in texts], "doc_id long, quality int")
    assert max(len(t) for _, t in texts) > 500_000
    for most in (crf.SAMPLE_LINES, 4000):
        monkeypatch.setattr(crf, "SAMPLE_LINES", most)
        out = crf.classify(docs, labels).toPandas().set_index("doc_id")
        assert ((out["predicted"] == 1) == (out.index % 2 == 1)).all()
