"""How far apart the sources of a language are in their use of words, from joint histograms of counts.

Every source of a language has a smoothed share p of each kept term, out of ``SCALE``, which depends only on
how often the term occurs there. A pair of sources is therefore described by how many terms have each combination (count
in one, count in the other): ``f`` is evaluated once for each combination, times that number. Terms that both sources
have are tallied by joining counts on the term; the cells with a zero follow from each source's own histogram less
what the joint one already holds, so that no term is written out for a source that does not have it.

1. Terms of whole texts are counted by (lang, source, term), with the number of documents, in each batch and then by key; those in
   fewer than ``least`` documents of their language go.
2. Pairs of sources that share a term are tallied by their two counts, and completed by the implied zero cells.
3. ``f`` of each cell, both ways, gives the value of each ordered pair. Terms that stand out in a source against
   its whole language are ranked by the same f.

All arithmetic is on integers; products that may pass 64 bits are decimals.

Defined results: null text, lang and source are read as ''; a language of one source has no pairs; where no term is
kept every pair's value is 0; repeated rows and rows without ids count as documents of their own; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnflow.llm import textvec as tv
from cairnflow.llm.shared import lean_batches, stored

#: What the shares of a source's terms add up to, about.
SCALE = 1_000_000_000
#: Documents of a language that a kept term occurs in, and terms reported for each source.
LEAST, TOP = 3, 200
#: What a term is, and the bytes that are in none.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_OUTSIDE = np.zeros(256, bool)
_OUTSIDE[[*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


def share(count: Column, total: Column, terms: Column) -> Column:
    """The smoothed share of a term with ``count`` occurrences among ``total`` of ``terms`` kept terms."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide(count + 1), wide(total + terms))


def divergence(p: Column, q: Column) -> Column:
    """(p - q)^2 / q, rounded down; shares are at most SCALE + 1, so the square fits 64 bits."""
    return F.call_function("div", (p - q) * (p - q), q)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The terms of each batch by group: occurrences, and documents."""
    for batch in batches:
        for part in tv.pieces(batch):
            data, starts, ends = tv.buffers(part.column("text"))
            ws, we, first = tv.word_spans(data, starts, ends, _OUTSIDE)
            inside = np.zeros(len(data) + 1, np.int8)
            inside[ws] += 1
            inside[we] -= 1
            letters = tv.LOWER[data][np.cumsum(inside[:-1], dtype=np.int8).view(bool)]
            ends_at = np.concatenate([[0], np.cumsum(we - ws)]).astype(np.int32)
            terms = pa.StringArray.from_buffers(len(ws), pa.py_buffer(ends_at), pa.py_buffer(letters)).dictionary_encode()
            lang, source = (part.column(c).dictionary_encode() for c in ("lang", "source"))
            width, sources = max(1, len(terms.dictionary)), max(1, len(source.dictionary))
            group = np.asarray(lang.indices, np.int64) * sources + np.asarray(source.indices, np.int64)
            held, times = np.unique(np.repeat(np.arange(part.num_rows), np.diff(first)) * width + np.asarray(terms.indices, np.int64), return_counts=True)
            key, which = np.unique(group[held // width] * width + held % width, return_inverse=True)
            n, docs = np.bincount(which, times, len(key)).astype(np.int64), np.bincount(which, minlength=len(key))
            columns = [lang.dictionary.take(pa.array(key // width // sources)), source.dictionary.take(pa.array(key // width % sources)), terms.dictionary.take(pa.array(key % width)), pa.array(n), pa.array(docs, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that have the term."""
    lean_batches(docs)
    rows = docs.select(*_group(), "text").mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _group() -> list[Column]:
    return [F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]


def histograms(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, x, y, m) for the sources a < b of a language: m of its ``terms`` kept terms occur x times in a and y times in b.

    ``counts``: lang, source, term, n (positive counts of kept terms); ``groups``: lang, source, terms.
    """
    side = lambda a, x: counts.select("lang", "term", F.col("source").alias(a), F.col("n").alias(x))
    keys = ["lang", "a", "b", "x", "y"]
    both = side("a", "x").join(side("b", "y"), ["lang", "term"]).where("a < b").groupBy(*keys).agg(F.count("*").alias("m"))
    own = counts.groupBy("lang", "source", "n").agg(F.count("*").alias("m"))
    pairs = groups.select("lang", F.col("source").alias("a"), "terms").join(groups.select("lang", F.col("source").alias("b")), "lang").where("a < b")

    def cells(rows: DataFrame, *signed: tuple) -> DataFrame:
        """For each row the cells (x, y, m); what is counted elsewhere is taken off with a negative m."""
        cell = F.array(*(F.struct(*(F.lit(v).cast("long").alias(k) if not isinstance(v, Column) else v.cast("long").alias(k) for k, v in zip("xym", c, strict=True))) for c in signed))
        return rows.select("lang", "a", "b", F.inline(cell))

    x, y, m, n = (F.col(c) for c in "xymn")
    parts = [
        cells(both, (x, y, m), (x, 0, -m), (0, y, -m), (0, 0, m)),
        cells(pairs.join(own.withColumnRenamed("source", "a"), ["lang", "a"]), (n, 0, m), (0, 0, -m)),
        cells(pairs.join(own.withColumnRenamed("source", "b"), ["lang", "b"]), (0, n, m), (0, 0, -m)),
        cells(pairs, (0, 0, F.col("terms"))),
    ]
    return reduce(DataFrame.union, parts).groupBy(*keys).agg(F.sum("m").alias("m")).where("m > 0")


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has every other source of the language, part ``term`` the source's ``top`` terms."""
    terms = Window.partitionBy("lang", "term")
    counted = term_counts(docs).withColumn("held", F.sum("docs").over(terms)).withColumn("in_lang", F.sum("n").over(terms))
    counts = stored(counted.where(F.col("held") >= least).select("lang", "source", "term", "n", "in_lang"), "term_counts")
    per_lang = counts.groupBy("lang", "term").agg(F.first("in_lang").alias("n")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    known = docs.select(*_group()).distinct().join(totals, ["lang", "source"], "left").join(per_lang, "lang", "left").na.fill(0, ["total", "terms", "lang_total"])
    groups = stored(known, "sources")

    cells = histograms(counts, groups)
    of = lambda s: groups.select("lang", F.col("source").alias(s), F.col("total").alias(f"total_{s}"), *(["terms"] if s == "a" else []))
    shares = cells.join(of("a"), ["lang", "a"]).join(of("b"), ["lang", "b"])
    p, q = share(F.col("x"), F.col("total_a"), F.col("terms")), share(F.col("y"), F.col("total_b"), F.col("terms"))
    each = shares.withColumn("p", p).withColumn("q", q)
    times = lambda f: F.sum((f * F.col("m")).cast("decimal(38,0)")).cast("long")
    found = each.groupBy("lang", "a", "b").agg(times(divergence(F.col("p"), F.col("q"))).alias("ab"), times(divergence(F.col("q"), F.col("p"))).alias("ba"))
    both_ways = F.array(*(F.struct(F.col(s).alias("source"), F.col(i).alias("item"), F.col(v).alias("value")) for s, i, v in (("a", "b", "ab"), ("b", "a", "ba"))))
    wanted = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = wanted.join(found.select("lang", F.inline(both_ways)), ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))

    here, there = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("in_lang"), F.col("lang_total"), F.col("terms"))
    marked = counts.join(groups, ["lang", "source"]).withColumn("p", here).withColumn("q", there).where("p > q")
    words = marked.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return ranked(pairs).union(ranked(words).where(F.col("rank") <= top))
