"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnflow.llm import bit_slices, bytes_dedup, containment, crf, divergence, kmeans_tree, langid, lmscore, minhash, oracles, packing, pii, substrings, urlfilter
from cairnflow.llm.shared import table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_segmentation_unigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return langid.identify(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 400-byte strings that start more than once."""
    out = bytes_dedup.remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL."""
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"))


def op4_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much more every document resembles the conversations than the documents."""
    return lmscore.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "conversations"), _vocabulary("byte_bpe_50k.json"))


def op5_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents at a similarity of 0.85."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), 85).select("doc_id", "n_shingles", "component_id", "kept", "class_id")


def op6_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into windows of 2048 ids."""
    return packing.pack(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op7_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return kmeans_tree.search(vectors, vectors.where("vec_id % 50 = 0"))


def op8_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items in every document, at a containment of 0.8."""
    return containment.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document."""
    return crf.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_fixed_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 20-word windows that also start earlier."""
    out = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op11_boosted_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: counts and a digest of the base spans, and all spans."""
    found = pii.detect(table(spark, sf_dir, "documents"))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(said("base"), 256).alias("base_sha256"), said("spans").alias("spans"))


def op12_count_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language are apart, and the terms that set a source off."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_bit_sliced_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every vector whose id is divisible by 100, with every seventh label shifted."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return bit_slices.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("op")}
ORACLES: dict[str, str] = {
    "op2_suffix_array_dedup": oracles.repeated_bytes(),
    "op3_url_filters": urlfilter.oracle(),
    "op5_circulant_minhash": oracles.near_duplicates(),
    "op7_kmeans_tree": oracles.nearest(),
    "op8_minhash_containment": oracles.contained(),
    "op10_fixed_block_anchors": oracles.repeated_words(),
    "op13_bit_sliced_negatives": oracles.hard_negatives(),
    "op12_count_histograms": oracles.divergences(),
}
