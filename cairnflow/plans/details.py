"""Queries over names, manifests, view boxes, sources and sinks: the smaller operators, on columns made of the star schema's."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnflow import api
from cairnflow.functions import display, names
from cairnflow.operators import features, layouts, search, selection, sessions, spatial, topology
from cairnflow.plans.layout import _POINTS, _points
from cairnflow.plans.discovery import FUZZY_SQL
from cairnflow.plans.registry import query
from cairnflow.sources import items
from cairnflow.sources.tables import table
from cairnflow.streaming import events as E


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part")


def _strings(*values: str) -> Column:
    return F.array(*map(F.lit, values))


@query("glyph_coverage", "SELECT p_partkey, regexp_full_match(p_name, '[a-r ]*') AS covered FROM part")
def glyph_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names whose characters are all among a to r and blanks."""
    return _parts(spark, sf_dir).select("p_partkey", names.glyphs_cover(F.col("p_name"), _strings(*"abcdefghijklmnopqr ")).alias("covered"))


@query("internal_names", "SELECT p_partkey, p_size % 3 = 0 OR p_size % 5 = 0 AS internal FROM part")
def internal_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3."""
    size = F.col("p_size")
    name = F.when(size % 3 == 0, F.concat(F.lit("."), "p_name")).when(size % 5 == 0, F.concat("p_name", F.lit("LastResort"))).otherwise(F.concat("p_name", F.lit(".x")))
    return _parts(spark, sf_dir).select("p_partkey", names.internal_name(F.array("p_brand", name)).alias("internal"))


@query("active_emphasis", """SELECT p_partkey, concat_ws(',', CASE WHEN p_size % 7 <> 0 THEN 'calm:' || least(4, p_size % 7) END, CASE p_size % 3 WHEN 1 THEN 'wide:-3' WHEN 2 THEN 'wide:-4' END) AS active FROM part""")
def active_emphasis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels clamped to -4..4, zeros left out, sorted by name."""
    size = F.col("p_size")
    levels = F.create_map(F.lit("wide"), -(size % 3) * 3, F.lit("calm"), size % 7, F.lit("thin"), F.lit(0))
    shown = F.transform(names.active_emphasis(levels), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    return _parts(spark, sf_dir).select("p_partkey", F.array_join(shown, ",").alias("active"))


@query("emphasis_preset", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'default' ELSE 'custom' END AS preset FROM part")
def emphasis_preset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F18."""
    kind = F.col("p_size") % 3
    default = F.create_map(*(F.lit(x) for kv in names.DEFAULT_EMPHASIS.items() for x in kv))
    levels = F.when(kind == 0, F.create_map(F.lit("calm"), F.lit(0))).when(kind == 1, F.map_concat(default, F.create_map(F.lit("calm"), F.lit(0)))).otherwise(F.create_map(F.lit("serif"), F.lit(3)))
    return _parts(spark, sf_dir).select("p_partkey", names.emphasis_preset(levels).alias("preset"))


@query("manifest_validity", "SELECT p_partkey, p_size % 2 = 0 AND p_size % 7 <> 0 AND p_size % 11 <> 0 AND p_size % 13 <> 0 AS valid, p_size % 5 <> 0 AS named FROM part")
def manifest_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P9, P10, T8."""
    size = F.col("p_size")
    digest = F.when(size % 13 == 0, F.lit("beef")).otherwise(F.sha2("p_name", 256))
    manifest = F.struct((size % 2 + 1).alias("api_version"), F.col("p_brand").alias("id"), F.when(size % 7 == 0, F.lit(" ")).otherwise(F.col("p_name")).alias("name"), F.when(size % 11 == 0, 0).when(size % 3 == 0, 5).alias("parameter_count"), F.array(digest).alias("digests"))
    model = F.concat(F.lit("m"), size.cast("string"), F.when(size % 5 == 0, F.lit("-")).otherwise(F.lit("-v1")))
    return _parts(spark, sf_dir).select("p_partkey", names.valid_manifest(manifest, F.col("p_brand")).alias("valid"), names.valid_model_id(model).alias("named"))


def _release() -> Column:
    size = F.col("p_size")
    asset = lambda n, i: F.struct(F.lit(n).alias("name"), (size % 4 + i).cast("bigint").alias("size"), F.concat(F.lit("sha256:"), F.sha2("p_name", 256)).alias("digest"))
    whole = [asset(n, i) for i, n in enumerate(names.REQUIRED_ASSETS, 1)]
    assets = F.when(size % 5 == 0, F.array(*whole[:2])).when(size % 7 == 0, F.array(*whole, asset("other", 1))).otherwise(F.array(*whole))
    return F.struct((size % 3 == 0).alias("draft"), (size % 11 == 0).alias("prerelease"), assets.alias("assets"))


@query("release_sizes", "SELECT p_partkey AS id, 3 * (p_size % 4) + 6 AS download_size FROM part WHERE p_size % 5 <> 0 AND p_size % 7 <> 0 AND p_size % 3 <> 0 AND p_size % 11 <> 0")
def release_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models of sound releases with their download sizes."""
    return items.remote_models(_parts(spark, sf_dir).select(F.col("p_partkey").alias("id"), _release().alias("r")).select("id", "r.*"))


@query("direction_validity", "SELECT p_partkey, p_size % 3 <> 0 AND p_size % 5 <> 0 AS valid FROM part")
def direction_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P12, S19's check: two unit vectors of length two, some of them too long or under another name."""
    size = F.col("p_size")
    unit = lambda a: F.array(F.cos(a), F.sin(a))
    second = F.when(size % 3 == 0, F.transform(unit(size), lambda x: x * 1.1)).otherwise(unit(size))
    key = F.when(size % 5 == 0, F.lit("other")).otherwise(F.lit("wide"))
    return _parts(spark, sf_dir).select("p_partkey", names.valid_directions(F.map_from_arrays(F.array(F.lit("calm"), key), F.array(unit(F.lit(1.0)), second)), ("calm", "wide"), 2).alias("valid"))


@query("digest_checks", "SELECT p_partkey, p_size % 3 <> 0 AS same, p_size % 3 <> 0 AND p_size % 5 <> 0 AS sound FROM part")
def digest_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P13, S22."""
    size, content = F.col("p_size"), F.col("p_name").cast("binary")
    digest = F.upper(F.sha2(F.when(size % 3 == 0, F.lit("x").cast("binary")).otherwise(content), 256))
    stated = F.octet_length("p_name") + F.when(size % 5 == 0, 1).otherwise(0)
    return _parts(spark, sf_dir).select("p_partkey", names.digest_matches(content, digest).alias("same"), items.sound_manifest(content, stated, digest).alias("sound"))


@query("localized_names", """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN p_type WHEN 2 THEN NULL ELSE p_brand END AS localized, CASE WHEN p_size % 4 = 2 THEN p_name ELSE p_brand END AS shown,
  CASE p_size % 4 WHEN 0 THEN 'en=' || p_name || ',und=b' ELSE 'und=c' END AS entries FROM part""")
def localized_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``en-US``, ``en``, any, an empty choice being none; entries without empty values, the last of a language."""
    kind, text = F.col("p_size") % 4, "string"
    by = F.when(kind == 0, F.create_map(F.lit("en"), "p_type", F.lit("en-US"), "p_name")).when(kind == 1, F.create_map(F.lit("de"), "p_brand", F.lit("en"), "p_type"))
    by = by.when(kind == 2, F.create_map(F.lit("en-US"), F.lit(""))).otherwise(F.create_map(F.lit("fr"), "p_name", F.lit("de"), "p_brand"))
    entry = lambda k, v: F.struct(F.lit(k).cast(text).alias("language"), v.cast(text).alias("value"))
    first = F.array(entry("en", F.col("p_brand")), entry(None, F.lit("a")), entry("fr", F.lit("")), entry("en", F.col("p_name")), entry("und", F.lit("b")))
    entries = names.localized_map(F.when(kind == 0, first).otherwise(F.array(entry("en", F.lit(None)), entry(None, F.lit("c")))))
    listed = F.array_join(F.transform(F.array_sort(F.map_entries(entries)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    none = F.lit(None).cast(text)
    shown = names.display_name(none, F.when(kind == 2, F.col("p_name")), F.col("p_brand"), F.lit("postscript"))
    return _parts(spark, sf_dir).select("p_partkey", names.localized(by).alias("localized"), shown.alias("shown"), listed.alias("entries"))


@query("subset_requirements", """SELECT p_partkey, array_to_string(list_transform(list_filter(string_split(p_name, ''), lambda c: c IN ('a', 'e', 'i')), lambda c: CASE c WHEN 'a' THEN 'latin' WHEN 'e' THEN 'greek+latin' ELSE 'latin-ext' END), ',') AS asked FROM part""")
def subset_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """what the vowels of a name ask for; blanks, unknown characters and the subset ``menu`` ask for nothing."""
    of = F.create_map(F.lit("a"), _strings("menu", "latin"), F.lit("e"), _strings("greek", "latin"), F.lit("i"), _strings("latin-ext"), F.lit("o"), _strings("menu"))
    return _parts(spark, sf_dir).select("p_partkey", F.array_join(F.transform(names.subset_requirements(F.col("p_name"), of), lambda r: F.array_join(r, "+")), ",").alias("asked"))


@query("stylesheet_queries", r"""SELECT p_partkey, 'family=' || replace(p_name, ' ', '+') || ':wght@' || p_size * 10 || '&text=' || url_encode(p_brand || ' ~*é/') AS address, CASE WHEN p_size % 3 = 0 THEN NULL ELSE 'https://x.org/' || p_size || '.ttf' END AS source FROM part""")
def stylesheet_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F11, F12."""
    size = F.col("p_size").cast("string")
    css = F.when(F.col("p_size") % 3 == 0, F.lit("@font-face { src: local(x) }")).otherwise(F.concat(F.lit("@font-face { src:  url(https://x.org/"), size, F.lit(".ttf) format('truetype'); src: url(no) }")))
    return _parts(spark, sf_dir).select("p_partkey", names.css_query(F.col("p_name"), F.col("p_size") * 10, F.concat("p_brand", F.lit(" ~*é/"))).alias("address"), names.css_source(css).alias("source"))


@query("font_containers", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'woff2' WHEN 1 THEN 'ttf' WHEN 2 THEN 'otf' END AS container FROM part")
def font_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S10's sniffing."""
    kind = F.col("p_size") % 4
    head = F.when(kind == 0, F.lit("774F4632")).when(kind == 1, F.lit("00010000")).when(kind == 2, F.lit("4F54544F")).otherwise(F.lit("89504E47"))
    return _parts(spark, sf_dir).select("p_partkey", names.font_container(F.unhex(F.concat(head, F.hex("p_name")))).alias("container"))


@query("vector_files", "SELECT p_partkey, CASE WHEN p_size % 5 <> 0 THEN p_size::BIGINT END AS n, CASE WHEN p_size % 5 <> 0 THEN p_size * 1.5::DOUBLE END AS total FROM part")
def vector_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of little-endian floats, some cut off."""
    content = F.unhex(F.concat(F.repeat(F.lit("0000C03F"), F.col("p_size")), F.when(F.col("p_size") % 5 == 0, F.lit("00")).otherwise(F.lit(""))))
    v = _parts(spark, sf_dir).select("p_partkey", items.floats(content).alias("v"))
    return v.select("p_partkey", F.when(F.col("v").isNotNull(), F.size("v").cast("bigint")).alias("n"), F.aggregate("v", F.lit(0.0), lambda s, x: s + x).alias("total"))


@query("titles_and_numbers", """SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN p_brand ELSE 'A' END AS title, CASE WHEN p_size % 4 = 0 OR p_size % 4 = 1 THEN 7 ELSE p_size END AS number,
  least(100, greatest(0, round(p_size * 100 / 40.0)::INT)) AS percent FROM part""")
def titles_and_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F21, F19, F22."""
    size = F.col("p_size")
    title = names.title_of(F.when(size % 3 == 0, F.col("p_name")).otherwise(F.lit("")), F.when(size % 3 == 1, F.col("p_brand")))
    value = F.when(size % 4 == 0, F.lit("")).when(size % 4 == 1, F.lit("x1")).otherwise(size.cast("string"))
    return _parts(spark, sf_dir).select("p_partkey", title.alias("title"), names.coerced(value, "int", 7).alias("number"), display.percent(size, F.lit(40)).alias("percent"))


@query("preview_keys", "SELECT count(DISTINCT (p_name, p_size % 4))::BIGINT AS n FROM part")
def preview_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """as many keys as there are different inputs, a blank standing for nothing."""
    key = names.preview_key(F.col("p_name"), F.when(F.col("p_size") % 4 == 0, F.lit("")).otherwise((F.col("p_size") % 4).cast("string")))
    return _parts(spark, sf_dir).agg(F.countDistinct(key).alias("n"))


@query("css_colours", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'rgb(113 113 122)' ELSE 'oklch(0.7193 0.157 ' || printf('%.4f', p_size * 2.0) || ')' END AS colour FROM part")
def css_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a colour for every angle, grey without one."""
    angle = F.when(F.col("p_size") % 5 != 0, F.col("p_size") * 2.0 * (math.pi / 180))
    return _parts(spark, sf_dir).select("p_partkey", display.css_colour(angle).alias("colour"))


@query("view_boxes", """SELECT p_partkey, 10.0 + p_size AS panned, w.w AS width, round(50 - w.w / 2, 6) AS x, round(25 + p_size / 2 - w.w / 4, 6) AS y, round(10 + (p_size - greatest(0, 400 - 100 * s) / 2) / s, 6) AS graph_x, round(p_size / s, 6) AS moved
  FROM part, LATERAL (SELECT least(greatest(greatest(100.0, p_size * 2.0), 10.0), 3000.0)::DOUBLE AS w) w, LATERAL (SELECT least(4.0, 6.0)::DOUBLE AS s)""")
def view_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """panning, fitting into an aspect of two, and screen to graph coordinates."""
    size = F.col("p_size").cast("double")
    at = lambda **c: F.struct(*(F.lit(v).cast("double").alias(k) if not isinstance(v, Column) else v.alias(k) for k, v in c.items()))
    box = at(x=10, y=0, width=100, height=50)
    rect = at(left=0, top=0, width=400, height=300)
    fit = display.fitting(at(min_x=0, max_x=100, min_y=25, max_y=size + 25), F.lit(2.0))
    point, moved = display.to_graph(size, F.lit(0.0), rect, box), display.screen_delta(size, F.lit(0.0), rect, box)
    return _parts(spark, sf_dir).select("p_partkey", display.panned(box, size, F.lit(1.0))["x"].alias("panned"), fit["width"].alias("width"), F.round(fit["x"], 6).alias("x"), F.round(fit["y"], 6).alias("y"), F.round(point["x"], 6).alias("graph_x"), F.round(moved["x"], 6).alias("moved"))


@query("link_points", """SELECT p_partkey, greatest(1, ceil(p_size / 100.0 * 291.7 / 3))::BIGINT AS arc, round(500 + 291.7 * cos(p_size / 100.0 + 1), 4) AS arc_x,
  greatest(8, least(256, ceil(sqrt(sqrt(100.0 * p_size * p_size + p_size * p_size) / 0.5 / 0.25))))::BIGINT + 1 AS curve, round(p_size * 10.0, 4) AS curve_x FROM part""")
def link_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many points arcs and curves have, and where they end."""
    size = F.col("p_size").cast("double")
    arc = layouts.arc_points(F.lit(1.0), size / 100 + 1, F.lit(291.7))
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    curve = layouts.curve_points(point(F.lit(0.0), F.lit(0.0)), point(size * 10, size), F.lit(0.5))
    return _parts(spark, sf_dir).select("p_partkey", F.size(arc).cast("bigint").alias("arc"), F.round(F.element_at(arc, -1)["x"], 4).alias("arc_x"), F.size(curve).cast("bigint").alias("curve"), F.round(F.element_at(curve, -1)["x"], 4).alias("curve_x"))


_POINTERS = "SELECT s_suppkey AS pointer, (s_suppkey * 6151 % 9973) / 9.973 AS px, (s_suppkey * 3571 % 9967) / 9.967 AS py FROM supplier"


def _pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("pointer"), ((k * 6151 % 9973) / F.lit(9.973)).alias("x"), ((k * 3571 % 9967) / F.lit(9.967)).alias("y"))


@query("hit_priority", f"""WITH q AS ({_POINTERS}), b AS (SELECT p_partkey AS key, p_partkey % 50 * 20.0 AS x0, p_partkey % 50 * 20.0 + 8 AS x1, p_size * 20.0 AS y0, p_size * 20.0 + 6 AS y1 FROM part),
  hits AS (SELECT pointer, 0 AS r, 0.0 AS d, 'image' AS kind, key FROM q JOIN b ON px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1 UNION ALL
    SELECT pointer, 1, (x - px) * (x - px) + (y - py) * (y - py), CASE WHEN key % 2 = 0 THEN 'dot' ELSE 'point' END, key FROM q JOIN ({_POINTS}) p ON x BETWEEN px - 30 AND px + 30 AND y BETWEEN py - 30 AND py + 30 WHERE (x - px) * (x - px) + (y - py) * (y - py) < 900)
  SELECT pointer, arg_min(kind, (r, d, kind, key)) AS kind, arg_min(key, (r, d, kind, key)) AS key FROM hits GROUP BY pointer""")
def hit_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image's box first, else the nearer of merge dot (even keys) and point."""
    x0, y0 = F.col("p_partkey") % 50 * 20.0, F.col("p_size") * 20.0
    boxes = _parts(spark, sf_dir).select(F.col("p_partkey").alias("key"), x0.alias("x0"), (x0 + 8).alias("x1"), y0.alias("y0"), (y0 + 6).alias("y1"))
    points = _points(spark, sf_dir)
    return spatial.pick(boxes, points.where("key % 2 = 0"), points.where("key % 2 <> 0"), _pointers(spark, sf_dir), 30.0).select("pointer", "kind", "key")


@query("polygon_lookup", f"""WITH q AS ({_POINTERS}), c AS (SELECT p_partkey AS id, p_partkey % 50 * 20.0 + 10 AS cx, p_size * 20.0 + 10 AS cy FROM part)
  SELECT pointer, min(id) AS id FROM q JOIN c ON px BETWEEN cx - 10 AND cx + 10 AND py BETWEEN cy - 10 AND cy + 10 WHERE abs(px - cx) + abs(py - cy) <= 10 GROUP BY pointer""")
def polygon_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J13 for polygons: which diamond holds a pointer."""
    x, y = F.col("p_partkey") % 50 * 20.0 + 10, F.col("p_size") * 20.0 + 10
    cells = _parts(spark, sf_dir).select(F.col("p_partkey").alias("id"), F.array(F.array(x - 10, y), F.array(x, y - 10), F.array(x + 10, y), F.array(x, y + 10)).alias("polygon"))
    return spatial.polygon_at(_pointers(spark, sf_dir), cells)


@query("system_faces", """WITH f AS (SELECT p_partkey AS ord, p_name AS ps, p_size * 10 AS w, [p_brand, p_type] AS names FROM part WHERE p_size % 2 = 0), i AS (SELECT p_partkey AS item, CASE WHEN p_size % 3 = 0 THEN p_name END AS ps, p_size * 10 AS w, [p_brand] AS names FROM part WHERE p_size % 2 = 1)
  SELECT i.item, coalesce((SELECT max(ord) FROM f WHERE f.ps = i.ps), (SELECT min(ord) FROM f WHERE abs(f.w - i.w) <= 50 AND list_has_any(f.names, i.names))) AS face_ord FROM i""")
def system_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2, U4."""
    p, size = _parts(spark, sf_dir), F.col("p_size")
    faces = p.where("p_size % 2 = 0").select(F.col("p_partkey").alias("face_ord"), F.col("p_name").alias("postscript_name"), (size * 10).alias("weight"), F.array("p_brand", "p_type").alias("names"))
    wanted = p.where("p_size % 2 = 1").select(F.col("p_partkey").alias("item"), F.when(size % 3 == 0, F.col("p_name")).alias("postscript_name"), (size * 10).alias("weight"), F.array("p_brand").alias("names"))
    return selection.resolve_faces(wanted, faces)


@query("computed_items", "SELECT c_custkey AS safe_name, s_acctbal AS computed FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def computed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3, S2, S4."""
    computed = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("safe_name"), F.col("s_acctbal").alias("computed"))
    return selection.with_computed(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("safe_name")), computed)


@query("tasks_with_sources", "SELECT c_custkey AS safe_name, CASE WHEN s_suppkey IS NULL THEN 'no source for ' || c_custkey END AS error FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def tasks_with_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks, split by whether they have a source, and put together again."""
    sources = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("safe_name"))
    good, bad = selection.split_errors(selection.with_sources(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("safe_name")), sources))
    return good.select("safe_name", F.lit(None).cast("string").alias("error")).unionByName(bad.select("safe_name", "error"))


@query("circular_list", "SELECT p_partkey AS id, row_number() OVER (ORDER BY (p_size * 37 % 50)::DOUBLE, p_partkey) - 1 AS place, (row_number() OVER (ORDER BY (p_size * 37 % 50)::DOUBLE, p_partkey) + 6) % 5 AS ring FROM part WHERE p_size % 7 <> 0")
def circular_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clustered items in the order of their angles, and a scroll position seven further on a ring of five."""
    size = F.col("p_size")
    p = _parts(spark, sf_dir).select(F.col("p_partkey").alias("id"), F.when(size % 7 != 0, size).alias("k"), (size * 37 % 50).cast("double").alias("leaf_angle"))
    return api.listed(p).select("id", "place", api.place_on_ring(F.col("place") + 7, F.lit(5)).alias("ring"))


@query("first_search_hit", f"SELECT p_partkey AS key, score FROM ({FUZZY_SQL}) ORDER BY score, key LIMIT 1")
def first_search_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of the search's hits, then the smallest key."""
    p = _parts(spark, sf_dir).withColumn("key", F.col("p_partkey"))
    hit = search.first_hit(search.fuzzy_search(p, "brnd#12", [F.array("p_brand"), F.array("p_name")]), "key")
    return hit.select("key", F.round("score", 6).alias("score"))


@query("exact_name_search", "SELECT p_partkey, round(pow(2.0, -52 * 0.707 / 2) * CASE WHEN lower(p_brand) = 'zzz' THEN 2 ELSE 1 END, 8) AS score FROM part WHERE p_name = 'red widget'")
def exact_name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An equal name of two words under one of two keys; near names score otherwise and are left out here."""
    found = search.fuzzy_search(_parts(spark, sf_dir), "Red Widget", [F.array("p_name"), F.array("p_brand")])
    return found.where(F.lower("p_name") == "red widget").select("p_partkey", F.round("score", 8).alias("score"))


@query("selected_models", """WITH m AS (SELECT s_suppkey AS id, s_name AS name, s_suppkey AS place, 'ready' AS availability FROM supplier), o AS (SELECT o_custkey AS id, min(o_orderkey) AS first FROM orders WHERE o_custkey NOT IN (SELECT s_suppkey FROM supplier) GROUP BY o_custkey)
  SELECT * FROM m UNION ALL SELECT id, id::VARCHAR, (SELECT max(place) FROM m) + row_number() OVER (ORDER BY first, id), 'loading' FROM o""")
def selected_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The models that there are, then those that are selected but missing, once each, in the order of their selection."""
    known = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("place"), F.lit("ready").alias("availability"))
    return selection.with_missing(known, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("at")), True)


@query("representative_wins", "SELECT p_partkey AS idx, count(l_partkey) AS wins FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey")
def representative_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: how many merges (line items) each leaf (part) represents."""
    one = F.lit("all").alias("session_id")
    leaves = _parts(spark, sf_dir).select(one, F.col("p_partkey").alias("idx"))
    merges = table(spark, sf_dir, "lineitem").select(one, F.col("l_partkey").alias("representative"))
    return topology.representative_wins(leaves, merges).select("idx", "wins")


@query("absorption_heights", "SELECT unnest([2 * s_suppkey, 2 * s_suppkey + 1]) AS idx, s_acctbal AS join_height FROM supplier WHERE s_suppkey < 40")
def absorption_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The height of the merge that first takes up a leaf; nodes from 80 on are no leaves."""
    one, k = F.lit("all").alias("session_id"), F.col("s_suppkey")
    merges = table(spark, sf_dir, "supplier").select(one, (2 * k).alias("left"), (2 * k + 1).alias("right"), F.col("s_acctbal").alias("height"))
    return topology.join_heights(merges, spark.range(1).select(one, F.lit(80).alias("n"))).select("idx", "join_height")


@query("emphasis_fallback", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total FROM embeddings")
def emphasis_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8, V5: emphasis without directions is left out, and vectors of at most 64 components are features as they are."""
    built = features.build_features(table(spark, sf_dir, "embeddings"), "embedding", "f", dims=64, emphasis={"calm": 2})
    return built.select("vec_id", F.round(F.aggregate("f", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query("event_round_trip", "SELECT event_type AS event, event_id AS id, value FROM events")
def event_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events to NDJSON lines and back."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("event"), F.to_json(F.struct("event_id", "value")).alias("payload"))
    return E.parsed(E.event_lines(e), {"id": ("$.payload.event_id", "bigint"), "value": ("$.payload.value", "double")}).select("event", "id", "value")


_RUNS = "SELECT o_orderkey AS session_id, CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'clustered' ELSE 'empty' END WHEN 'P' THEN 'analyzed' ELSE 'rendered' END AS status, o_orderkey % 3 <> 0 AS pca, o_custkey % 4 <> 0 AS emphasis, o_custkey % 5 AS level FROM orders"


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with their status and options (orders stand for sessions)."""
    s, key, other = F.col("o_orderstatus"), F.col("o_orderkey"), F.col("o_custkey")
    status = F.when((s == "F") & (key % 2 == 0), "clustered").when(s == "F", "empty").when(s == "P", "analyzed").otherwise("rendered")
    return table(spark, sf_dir, "orders").select(key.alias("session_id"), status.alias("status"), (key % 3 != 0).alias("pca"), (other % 4 != 0).alias("emphasis"), (other % 5).alias("level"))


@query("run_plans", f"""SELECT session_id, CASE status WHEN 'empty' THEN 'rendering,analysis,clustering' WHEN 'rendered' THEN 'analysis,clustering' WHEN 'analyzed' THEN 'clustering' ELSE '' END AS stages,
  status IN ('empty', 'rendered') OR (status = 'analyzed' AND pca AND emphasis AND level <> 0) AS model FROM ({_RUNS})""")
def run_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages that every session still needs, and whether its run needs the model."""
    wanted = sessions.model_wanted(F.col("status"), F.col("pca"), F.col("emphasis"), F.array("level"))
    return _runs(spark, sf_dir).select("session_id", F.array_join(sessions.open_stages(F.col("status")), ",").alias("stages"), wanted.alias("model"))


@query("graph_modes", f"""SELECT session_id, mode, CASE WHEN mode IN ('radial-tree', 'horizontal-tree') THEN CASE WHEN pca THEN 32 ELSE 16 END ELSE CASE WHEN pca THEN 60 ELSE 40 END END AS gap
  FROM (SELECT session_id, pca, unnest(CASE WHEN status = 'clustered' THEN ['radial-tree', 'horizontal-tree', 'rectangular-treemap', 'voronoi-treemap'] ELSE [] END || CASE WHEN status IN ('analyzed', 'clustered') AND emphasis THEN ['scatter-plot'] ELSE [] END) AS mode FROM ({_RUNS}))""")
def graph_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of graph that every session can be shown as, with the gap between samples (images, or labels only)."""
    modes = selection.available_modes(F.col("status") == "clustered", F.col("status").isin("analyzed", "clustered") & F.col("emphasis"))
    return _runs(spark, sf_dir).select("session_id", "pca", F.explode(modes).alias("mode")).select("session_id", "mode", spatial.gap_of(F.col("mode"), F.col("pca")).alias("gap"))
