"""Approximate search over item names (V14): Bitap matches scored by errors and place."""

from __future__ import annotations

import math
import zlib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Worst accepted score, and the distance that costs a whole point.
THRESHOLD, DISTANCE = 0.25, 100
#: What an equal text scores before it is weighted: the step between 1 and the next double.
EQUAL = 2.0**-52
#: Longest piece of a query that is matched as one; a match of the first piece lies within the first ``REACH`` characters.
PIECE = 32
REACH = PIECE + int(THRESHOLD * DISTANCE)


def bitap(text: str, pattern: str, threshold: float = THRESHOLD, distance: int = DISTANCE) -> float | None:
    """The least errors / length + place / distance of an approximate match, or None if none is within the threshold."""
    text, pattern = text.lower(), pattern.lower()
    if not pattern:
        return None
    if text == pattern:
        return 0.0
    if len(pattern) > PIECE:  # longer patterns are matched in pieces, whose scores are averaged
        parts = [bitap(text, pattern[i : i + PIECE], threshold, distance + i) for i in range(0, len(pattern), PIECE)]
        return None if any(p is None for p in parts) else sum(parts) / len(parts)
    m = len(pattern)
    best, at = None, text.find(pattern)
    if at >= 0 and at / distance <= threshold:
        best = at / distance
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    accept = 1 << m - 1
    rows = [(1 << k) - 1 for k in range(m + 1)]  # k errors match the first k characters at once
    most = min(m - 1, int(threshold * m)) if best is None or best > 0 else 0
    for i, c in enumerate(text):
        before, mask = rows[:], masks.get(c, 0)
        rows[0] = (before[0] << 1 | 1) & mask
        for k in range(1, most + 1):
            rows[k] = ((before[k] << 1 | 1) & mask) | before[k - 1] << 1 | rows[k - 1] << 1 | before[k - 1] | 1
        for k in range(most + 1):
            if rows[k] & accept:
                start = max(0, i - m + 1)
                score = max(k, 0) / m + start / distance
                if score <= threshold and (best is None or score < best):
                    best = score
                break
    return best


def _parts(query: str) -> list[str]:
    """Of k errors' k + 1 parts of the (first 32 characters of the) query, one is in a matching text as it is."""
    pattern = query.lower()[:PIECE]
    parts = int(THRESHOLD * len(pattern)) + 1
    cuts = [round(i * len(pattern) / parts) for i in range(parts + 1)]
    return sorted({pattern[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True) if i < j})


def _has_part(query: str, text: Column) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(F.lower(text), F.lit(p)) for p in _parts(query)))


def _may_match(query: str, values: Column) -> Column:
    """A native condition for a match."""
    return F.exists(values, lambda v: _has_part(query, v))


def fuzzy_score(query: str, keys: list[Column], n_keys: int) -> Column:
    """The product over all matching strings of score to the power of norm / ``n_keys``, null if none matches: the smaller, the better.

    ``keys`` are arrays of strings, one for each key. A string's norm is one over the root of its number of words, to three
    digits. A text equal to the query counts as the smallest double step, any other match as 0.001 at least.
    """

    @F.pandas_udf("double")
    def run(*lists: pd.Series) -> pd.Series:
        def one(strings: tuple) -> float | None:
            found = [(_string_score(v, query), round(len(v.split(" ")) ** -0.5, 3)) for own in strings for v in (own if own is not None else []) if v]
            found = [(s, norm) for s, norm in found if s is not None]
            return math.prod(s ** (norm / n_keys) for s, norm in found) if found else None

        return pd.Series([one(row) for row in zip(*lists, strict=True)], dtype="Float64")

    return run(*keys)


def fuzzy_search(items: DataFrame, query: str, keys: list[Column], n_keys: int | None = None) -> DataFrame:
    """Items with a string within the threshold, with their ``score``. ``keys``: arrays of strings; ``n_keys``: how many keys share the weight (all of them by default).

    Python sees only rows that share a part of the query, which native conditions find.
    """
    if not query:
        return items.withColumn("score", F.lit(None).cast("double")).limit(0)
    present = [F.filter(F.coalesce(k, F.array().cast("array<string>")), lambda v: v.isNotNull()) for k in keys]
    near = items.where(_may_match(query, F.concat(*present)))
    return near.withColumn("score", fuzzy_score(query, present, n_keys or len(keys))).where(F.col("score").isNotNull())


class NameIndex:
    """V14 by an index: the strings of all items filed under their grams of one to three characters, for searches that read the grams of their query only.

    A row is (bucket, gram, text, key, times); files are partitioned by the gram's bucket and sorted by gram, so that a search prunes buckets and
    then row groups. Only the first ``REACH`` characters can hold a part of a match, so a string has at most three times as many rows.
    """

    GRAM, BUCKETS = 3, 64

    def __init__(self, spark: SparkSession, path: str, key_type: str = "string"):
        self.spark, self.path, self.schema = spark, path, f"gram string, text string, key {key_type}, times long, bucket int"

    @classmethod
    def build(cls, items: DataFrame, key: str, keys: list[Column], path: str) -> NameIndex:
        """Writes the index of ``items``, known by ``key``, over the strings of ``keys``; null and blank strings are left out."""
        strings = F.flatten(F.array(*(F.coalesce(k, F.array().cast("array<string>")) for k in keys)))
        each = items.select(F.col(key).alias("key"), F.explode(strings).alias("text")).where(F.length(F.trim("text")) > 0)
        each = each.groupBy("key", "text").agg(F.count("*").alias("times"))
        low = F.lower("text")
        starts = lambda n: F.sequence(F.lit(1), F.greatest(F.least(F.length(low) - (n - 1), F.lit(REACH)), F.lit(1)))
        grams = [F.transform(starts(n), cls._gram(low, n)) for n in range(1, cls.GRAM + 1)]
        filed = each.select(F.explode(F.array_distinct(F.flatten(F.array(*grams)))).alias("gram"), "text", "key", "times").withColumn("bucket", cls._bucket(F.col("gram")))
        # frequent grams fill several files each
        filed.repartitionByRange("bucket", "gram", "text", "key").sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(path)
        return cls(items.sparkSession, path, items.schema[key].dataType.simpleString())

    @staticmethod
    def _gram(text: Column, n: int):
        return lambda start: F.substring(text, start, F.lit(n))

    @classmethod
    def _bucket(cls, gram: Column) -> Column:
        return F.pmod(F.crc32(F.encode(gram, "utf-8")), F.lit(cls.BUCKETS)).cast("int")

    def candidates(self, query: str) -> DataFrame:
        """(key, text, times) of the strings that share a part with the query."""
        grams = sorted({p[: self.GRAM] for p in _parts(query)})
        buckets = sorted({zlib.crc32(g.encode()) % self.BUCKETS for g in grams})
        found = self.spark.read.schema(self.schema).parquet(self.path).where(F.col("bucket").isin(buckets) & F.col("gram").isin(grams) & _has_part(query, F.col("text")))
        return found.select("key", "text", "times").distinct()

    def search(self, query: str, n_keys: int) -> DataFrame:
        """The items (key, score) that :func:`fuzzy_search` finds among all; ``n_keys`` keys share the weight."""
        rows = self.candidates(query) if query else self.candidates("-").limit(0)

        @F.pandas_udf("double")
        def score(texts: pd.Series) -> pd.Series:
            return pd.Series([_string_score(v, query) for v in texts], dtype="Float64")

        norm = F.round(F.pow(F.size(F.split("text", " ")), F.lit(-0.5)), 3)
        hits = rows.withColumn("s", score("text")).where(F.col("s").isNotNull())
        return hits.groupBy("key").agg(F.product(F.pow("s", norm * F.col("times") / n_keys)).alias("score"))


def _string_score(text: str, query: str) -> float | None:
    """What a string scores before it is weighted."""
    s = bitap(text, query) if text.strip() else None
    return None if s is None else EQUAL if text.lower() == query.lower() else max(s, 0.001)


def first_hit(hits: DataFrame, key: str) -> DataFrame:
    """The hit to select: best score, then smallest key."""
    return hits.orderBy("score", key).limit(1)


#: Keys of an item that are searched; maps count twice, once as themselves, which never match.
NAME_KEYS = 10


def name_fields() -> list[Column]:
    """The searched keys of an item: names, families, publishers and designers, maps flattened."""
    plain = [F.array("font_name"), F.array("family_name")]
    return [*plain, *(F.coalesce(F.map_values(c), F.array().cast("array<string>")) for c in ("family_names", "preferred_family_names", "publishers", "designers"))]
