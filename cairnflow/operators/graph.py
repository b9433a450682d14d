"""Connected components and single linkage on edges, without collecting them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnflow.sources.store import discard, stored


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of ``nodes`` (node: long) reaches over ``edges`` (a, b).

    Edges hang on ever smaller nodes (large-star and small-star contractions) until they form stars;
    each round's edges are stored in the shared folder.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    mark = None
    while True:
        got = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if got == mark or not got[0]:
            break
        mark = got
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        hung = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = hung.groupBy("a").agg(F.min("b").alias("m"))
        before, now = now, stored(hung.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", "m")).where("a <> b").distinct(), "edges")
        discard(before)
    return nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def single_linkage_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, k): single-linkage clusters at a threshold are the components of the edges up to it, numbered by their smallest node."""
    found = components(nodes, edges)
    from cairnflow.operators.selection import indexed

    roots = indexed(found.select("component").distinct(), "component", "k")
    return found.join(roots.select("component", "k"), "component").select("node", "k")
