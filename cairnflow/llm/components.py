"""Connected components of an edge table by alternating large-star and small-star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnflow.llm.shared import discard, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction. large: every larger neighbour hangs on the smallest neighbour; else every smaller one does."""
    if large:
        near = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    linked = near.join(low, "a")
    if large:
        out = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long), the component being its smallest node.

    Rounds go on until the edges stay the same (a star for each component); each round's edges are
    stored in the shared folder, and the last round's are what the result reads. Self-loops and nulls are ignored.
    """
    now = stored(edges.select("a", "b").where("a <> b").distinct(), "edges")
    seen = _digest(now)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        before, now = now, stored(_star(_star(now, True), False), "edges")
        got = _digest(now)
        discard(before)
        if got == seen:
            break
        seen = got
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    out = now.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("component")).union(now.select(F.least("a", "b").alias("node"), F.least("a", "b").alias("component"))).distinct()
    out.stored_at = now.stored_at
    return out
