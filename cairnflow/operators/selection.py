"""Filters, best matches, unions by precedence and ranked limits over DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairnflow.functions import names
from cairnflow.sources.store import stored


def running_total(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """The sum of ``value`` over each row and all rows before it, without one task that sorts all rows.

    Range partitions are summed first; a row's total is that of its partition so far, after the partitions before it.
    The partitions are stored, since their bounds are sampled anew whenever they are computed.
    """
    ranged = stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = sums.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row for each partition
    so_far = F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("_so_far", so_far).join(before, "_part").withColumn(name, F.col("_so_far") + F.col("_before")).drop("_part", "_so_far", "_before")


def indexed(df: DataFrame, key: str, name: str = "idx") -> DataFrame:
    """Rows numbered from 0 in the order of their key."""
    return running_total(df, [F.col(key)], F.lit(1), name).withColumn(name, F.col(name) - 1)


def interactive_filter(items: DataFrame, weights: Sequence[int], clusters: Sequence[int] = (), hits: DataFrame | None = None, key: str = "key") -> DataFrame:
    """Items of the active weights (none active: no items) and visible clusters (none chosen: all), among the search hits if there are any."""
    kept = items.where(F.col("weight").isin(*weights) if weights else F.lit(False))
    if clusters:
        kept = kept.where(F.col("k").isin(*clusters))
    return kept if hits is None else kept.join(hits.select(key).distinct(), key, "left_semi")


def filter_active(query: Column, session_weights: Column, active_weights: Column, clusters: Column) -> Column:
    """A query, a session weight that is switched off, or chosen clusters."""
    return (F.coalesce(query, F.lit("")) != "") | (F.size(F.array_except(session_weights, active_weights)) > 0) | (F.size(clusters) > 0)


def best_faces(faces: DataFrame, weights: DataFrame) -> DataFrame:
    """For each family and target weight the nearest face within the window; the first face wins ties.

    ``faces``: family, face_ord, actual_weight, ...; ``weights``: target. Windows meet faces on tiles of fifty, an equi join.
    The best is kept by a partial aggregate, so a family with very many faces costs one row a task.
    """
    tiles = F.sequence(F.floor((F.col("target") - 50) / 50), F.floor((F.col("target") + 50) / 50))
    asked = weights.select("target", F.explode(tiles).alias("_tile"))
    near = faces.withColumn("_tile", F.floor(F.col("actual_weight") / 50)).join(asked, "_tile").where(names.in_weight_window(F.col("target"), F.col("actual_weight")))
    rest = [c for c in faces.columns if c != "family"]
    best = near.groupBy("family", "target").agg(F.min(F.struct(F.abs(F.col("actual_weight") - F.col("target")).alias("_d"), F.col("face_ord"), *(F.col(c) for c in rest if c != "face_ord"))).alias("b"))
    return best.select("family", "target", *(F.col(f"b.{c}").alias(c) for c in rest))


def available_weights(faces: DataFrame) -> DataFrame:
    """A1, A2: ``Weight(n)`` of every face of a family in face order, repeats kept."""
    listed = F.transform(F.sort_array(F.collect_list(F.struct("face_ord", "actual_weight"))), lambda f: F.concat(F.lit("Weight("), f["actual_weight"].cast("string"), F.lit(")")))
    return faces.groupBy("family").agg(listed.alias("weights"))


def families_per_weight(best: DataFrame, weights: DataFrame) -> DataFrame:
    """A3, A4: families and their number for every target weight, also where there is none."""
    found = best.groupBy("target").agg(F.sort_array(F.collect_list("family")).alias("families"))
    return weights.join(found, "target", "left").select("target", F.coalesce("families", F.array().cast("array<string>")).alias("families")).withColumn("n", F.size("families"))


def resolve_faces(items: DataFrame, faces: DataFrame) -> DataFrame:
    """The face of an item: the last one with its PostScript name, else the first within 50 of its weight that shares a family name.
    Names and weights meet once each, however many items and faces have them.

    ``items``: item, postscript_name, weight, names (array); ``faces``: face_ord, postscript_name, weight, names.
    """
    by_name = faces.where("postscript_name is not null").groupBy("postscript_name").agg(F.max("face_ord").alias("exact"))
    tile = lambda c: F.floor(F.col(c) / 50)
    held = faces.select("face_ord", F.col("weight").alias("face_weight"), F.explode(F.array_distinct("names")).alias("name")).groupBy("name", "face_weight").agg(F.min("face_ord").alias("face_ord"))
    wanted = items.select("item", "weight", F.explode(F.array_distinct("names")).alias("name"))
    asked = wanted.select("name", "weight").distinct().withColumn("_tile", F.explode(F.sequence(tile("weight") - 1, tile("weight") + 1)))
    near = asked.join(held.withColumn("_tile", tile("face_weight")), ["name", "_tile"]).where(F.abs(F.col("weight") - F.col("face_weight")) <= 50)
    near = near.groupBy("name", "weight").agg(F.min("face_ord").alias("near"))
    alike = wanted.join(near, ["name", "weight"]).groupBy("item").agg(F.min("near").alias("near"))
    return items.join(by_name, "postscript_name", "left").join(alike, "item", "left").select("item", F.coalesce("exact", "near").alias("face_ord"))


def top_after_filters(catalog: DataFrame, requirements: Column, weights: Column, n: int | None) -> DataFrame:
    """The n most popular families (null: all) that cover the text and offer a weight; the limit comes after both filters."""
    kept = catalog.where(names.covers(requirements, F.col("subsets")) & names.offers_any(weights, F.col("variants"))).orderBy("rank")
    return kept if n is None else kept.limit(n)


def largest_clusters(items: DataFrame, n: int = 9) -> DataFrame:
    """The largest clusters, ties by number."""
    return items.where("k is not null").groupBy("k").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "k").limit(n)


def union_by_precedence(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """All rows of the first table, and those of the second whose key it does not have."""
    return first.unionByName(second.join(first.select(key), key, "left_anti"))


def with_missing(models: DataFrame, selected: DataFrame, loading: bool) -> DataFrame:
    """The models (id, name, place, availability) in their order, then each id of ``selected`` (id, at) that is not among them once, in the order of its first ``at``."""
    once = selected.groupBy("id").agg(F.min("at").alias("_at")).join(models.select("id"), "id", "left_anti")
    placed = running_total(once, [F.col("_at"), F.col("id")], F.lit(1), "_n")
    after = F.broadcast(models.agg(F.coalesce(F.max("place"), F.lit(-1)).alias("_after")))  # one row
    missing = placed.crossJoin(after).select("id", F.col("id").cast("string").alias("name"), (F.col("_n") + F.col("_after")).alias("place"), F.lit("loading" if loading else "unknown").alias("availability"))
    return models.unionByName(missing, allowMissingColumns=True)


def history(sessions: DataFrame, cap: int = 20) -> DataFrame:
    """The newest sessions up to the cap; protected ones stay beyond it."""
    newest = sessions.orderBy(F.desc("modified_at"), F.desc("session_id")).limit(cap).select("session_id")
    return sessions.join(newest.withColumn("_in", F.lit(True)), "session_id", "left").where(F.col("_in") | F.col("protected")).drop("_in")


def running_first(sessions: DataFrame) -> DataFrame:
    """T4: running sessions, then the newest, then by id, with their ``place`` from 1 in that order."""
    return running_total(sessions, [F.desc("running"), F.desc("modified_at"), F.asc("session_id")], F.lit(1), "place")


def latest_clustered(sessions: DataFrame) -> DataFrame:
    """The newest clustered session; of equal times the last id."""
    return sessions.where("process_status = 'clustered'").groupBy().agg(F.max(F.struct("modified_at", "session_id")).alias("m")).select("m.session_id", "m.modified_at")


def unseen_completed(sessions: DataFrame, seen: DataFrame) -> DataFrame:
    """Clustered, not running, and changed since it was last seen (never seen counts)."""
    joined = sessions.join(seen.select("session_id", F.col("modified_at").alias("_seen")), "session_id", "left")
    return joined.where((F.col("process_status") == "clustered") & ~F.col("running") & ~F.col("_seen").eqNullSafe(F.col("modified_at"))).drop("_seen")


def split_errors(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """The rows that succeeded, and those that did not."""
    return df.where(F.col(error).isNull()).drop(error), df.where(F.col(error).isNotNull())


def with_sources(tasks: DataFrame, sources: DataFrame, key: str = "safe_name") -> DataFrame:
    """Every task with its source; a task without one carries an error."""
    found = tasks.join(sources.withColumn("_found", F.lit(True)), key, "left")
    return found.withColumn("error", F.when(F.col("_found").isNull(), F.concat(F.lit("no source for "), F.col(key)))).drop("_found")


def with_computed(items: DataFrame, computed: DataFrame, key: str = "safe_name") -> DataFrame:
    """Items with their computed data where there is any."""
    return items.join(computed, key, "left")


def presentation(points: DataFrame, selected: str | None, family: str | None, alias: str | None, show_images: bool, show_names: bool) -> DataFrame:
    """What to draw for a point (key, family, is_filtered, is_detailed): emphasis, sample, label and core."""
    emphasis = F.when(F.col("key") == F.lit(alias), "alias-source").when(F.col("key") == F.lit(selected), "selected").when(F.col("family") == F.lit(family), "family").otherwise("none")
    detailed = F.col("is_detailed") | (emphasis != "none")
    return points.withColumn("emphasis", emphasis).withColumns({
        "is_active": F.col("is_filtered"), "show_sample": detailed & F.lit(show_images) & F.col("is_filtered"),
        "show_label": detailed & F.lit(show_names) & F.col("is_filtered"), "show_core": ~(detailed & F.lit(show_images) & F.col("is_filtered")),
    })


#: The kinds of graph, trees first.
TREES = ("radial-tree", "horizontal-tree", "rectangular-treemap", "voronoi-treemap")


def available_modes(has_dendrogram: Column, has_scatter: Column) -> Column:
    """P20: the kinds of graph that a session can be shown as."""
    none = F.array().cast("array<string>")
    return F.concat(F.when(has_dendrogram, F.array(*map(F.lit, TREES))).otherwise(none), F.when(has_scatter, F.array(F.lit("scatter-plot"))).otherwise(none))
