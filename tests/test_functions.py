import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnflow.functions import display, names
from cairnflow.operators import search, selection


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first().c


def strings(**kw):
    return F.create_map(*(F.lit(x) for kv in kw.items() for x in kv))


def test_weight_windows(spark):
    actual = [250, 251, 350, 351, 449, 450, 549, 550, 650, 749, 750]
    df = spark.createDataFrame([(t, a) for t in (300, 400, 500, 700) for a in actual], "t int, a int")
    got = {(r.t, r.a) for r in df.where(names.in_weight_window(F.col("t"), F.col("a"))).collect()}
    assert got == {(300, 251), (300, 350), (400, 351), (400, 449), (500, 450), (500, 549), (700, 650), (700, 749)}


def test_best_face_ties_and_empty_weights(spark):
    faces = spark.createDataFrame([("A", 2, 710), ("A", 1, 690), ("B", 3, 400), ("A", 4, 400), ("A", 5, 400)], "family string, face_ord long, actual_weight int")
    weights = spark.createDataFrame([(400,), (700,), (900,)], "target int")
    best = selection.best_faces(faces, weights)
    assert {(r.family, r.target): r.face_ord for r in best.collect()} == {("A", 700): 1, ("A", 400): 4, ("B", 400): 3}
    assert {r.target: r.families for r in selection.families_per_weight(best, weights).collect()} == {400: ["A", "B"], 700: ["A"], 900: []}
    assert {r.family: r.weights for r in selection.available_weights(faces).collect()}["A"] == ["Weight(690)", "Weight(710)", "Weight(400)", "Weight(400)"]


@pytest.mark.parametrize(("variants", "want"), [(["regular", "700"], [None, "400", "700"]), (["bold"], [None, None, "700"]), (["300italic"], [None, None, None]), (["300", "400"], ["300", "400", None])])
def test_api_weights(spark, variants, want):
    v = F.array(*map(F.lit, variants))
    assert [one(spark, names.api_weight(F.lit(w), v)) for w in (300, 400, 700)] == want
    assert one(spark, names.offers_any(F.array(F.lit(300), F.lit(400)), v)) == any(want[:2])


def test_names(spark):
    assert one(spark, names.safe_name(F.lit("A B/C\\D"), F.lit(400))) == "400_A_B_C_D"
    assert one(spark, names.family_of_stem(F.lit("Open_Sans_Weight400_Weight"))) == "Open Sans"
    assert one(spark, names.family_of_stem(F.lit("Open_Sans"))) is None
    assert one(spark, names.preferred(strings(fr="f", de="d"))) == "d"
    assert one(spark, names.preferred(F.create_map(F.lit("1033"), F.lit("m"), F.lit("aa"), F.lit("a")))) == "m"
    assert one(spark, names.localized(F.create_map(F.lit("en-US"), F.lit(""), F.lit("en"), F.lit("x")))) is None
    entries = F.array(*(F.struct(F.lit(a).cast("string").alias("language"), F.lit(b).cast("string").alias("value")) for a, b in ((None, "n"), ("en", "x"), ("en", "y"), ("de", ""))))
    assert one(spark, names.localized_map(entries)) == {"und": "n", "en": "y"}
    assert one(spark, names.style_key(F.expr("cast(map() as map<string,string>)"), F.expr("cast(map() as map<string,string>)"))) == "Regular"
    assert one(spark, names.internal_name(F.array(F.lit("x"), F.lit(".LastOne"))))
    assert [one(spark, names.weight_label(F.lit(w))) for w in (100, 249, 250, 400, 900)] == ["Th", "El", "L", "R", "Bl"]


def test_coverage(spark):
    subsets = F.create_map(F.lit("a"), F.array(F.lit("latin"), F.lit("menu")), F.lit("я"), F.array(F.lit("cyrillic")), F.lit("m"), F.array(F.lit("menu")))
    need = names.subset_requirements(F.lit("a яm\t?"), subsets)
    assert one(spark, need) == [["latin"], ["cyrillic"]]
    assert not one(spark, names.covers(need, F.array(F.lit("latin"))))
    assert one(spark, names.covers(need, F.array(F.lit("latin"), F.lit("cyrillic"))))
    assert one(spark, names.covers(F.expr("cast(array() as array<array<string>>)"), F.array(F.lit("x"))))
    assert one(spark, names.glyphs_cover(F.lit("ab�"), F.array(F.lit("a"), F.lit("b")))) and not one(spark, names.glyphs_cover(F.lit("abc"), F.array(F.lit("a"))))


@pytest.mark.parametrize(("version", "kept"), [("0.26.1", True), ("v0.26.1", True), ("0.26.1-rc.1", False), ("0.26.0", False), ("1.0.0-alpha", True), ("0.27.0+b", True), ("x", False), (None, False)])
def test_versions(spark, version, kept):
    assert one(spark, names.supported_version(F.lit(None).cast("string"), F.lit(version).cast("string"))) is kept


def test_version_order(spark):
    order = ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.0.1", "1.10.0"]
    df = spark.createDataFrame([(v,) for v in reversed(order)], "v string")
    assert [r.v for r in df.orderBy(names.version_key(F.col("v"))).collect()] == order


def test_model_records(spark):
    ok = "a" * 64
    m = F.struct(F.lit(1).alias("api_version"), F.lit("m-1").alias("id"), F.lit("M").alias("name"), F.lit(5).alias("parameter_count"), F.array(F.lit(ok)).alias("digests"))
    assert one(spark, names.valid_manifest(m, F.lit("m-1"))) and not one(spark, names.valid_manifest(m, F.lit("m-2")))
    assert [one(spark, names.valid_model_id(F.lit(i))) for i in ("a", "a-b1", "-a", "a-", "A", "")] == [True, True, False, False, False, False]
    asset = lambda n, size=3: F.struct(F.lit(n).alias("name"), F.lit(size).alias("size"), F.lit(f"sha256:{ok}").alias("digest"))
    release = lambda *a: F.struct(F.lit(False).alias("draft"), F.lit(False).alias("prerelease"), F.array(*a).alias("assets"))
    assert one(spark, names.valid_release(release(*map(asset, names.REQUIRED_ASSETS))))
    assert not one(spark, names.valid_release(release(*map(asset, names.REQUIRED_ASSETS[:2]))))
    assert not one(spark, names.valid_release(release(asset("model.json", 0), *map(asset, names.REQUIRED_ASSETS[1:]))))
    unit = F.create_map(F.lit("a"), F.array(F.lit(1.0), F.lit(0.0)))
    assert one(spark, names.valid_directions(unit, ("a",), 2)) and not one(spark, names.valid_directions(unit, ("a", "b"), 2)) and not one(spark, names.valid_directions(unit, ("a",), 3))
    assert one(spark, names.digest_matches(F.lit(b"x"), F.upper(F.sha2(F.lit(b"x"), 256))))


def test_web_addresses(spark):
    assert one(spark, names.css_query(F.lit("Open Sans"), F.lit("400"), F.lit("a b~*é/"))) == "family=Open+Sans:wght@400&text=a%20b~%2A%C3%A9%2F"
    assert one(spark, names.css_source(F.lit("@font-face { src: url(https://x/y.woff2) format('woff2') }"))) == "https://x/y.woff2"
    assert one(spark, names.css_source(F.lit("none"))) is None
    assert [one(spark, names.font_container(F.lit(b))) for b in (b"wOF2zz", b"\0\1\0\0z", b"OTTO", b"zzzz")] == ["woff2", "ttf", "otf", None]


def test_settings(spark):
    assert [one(spark, names.coerced(F.lit(v).cast("string"), "double", 0.25)) for v in ("", "0", "x", "NaN", "0.5", None)] == [0.25, 0.25, 0.25, 0.25, 0.5, 0.25]
    assert one(spark, names.title_of(F.lit(""), F.lit(None).cast("string"))) == "A"
    levels = F.create_map(F.lit("b"), F.lit(7), F.lit("a"), F.lit(-9), F.lit("c"), F.lit(0))
    assert [tuple(r) for r in one(spark, names.active_emphasis(levels))] == [("a", -4), ("b", 4)]
    zero, preset = F.create_map(F.lit("a"), F.lit(0)), F.create_map(F.lit("a"), F.lit(2), F.lit("b"), F.lit(0))
    assert [one(spark, names.emphasis_preset(x, preset)) for x in (zero, F.create_map(F.lit("a"), F.lit(2)), F.create_map(F.lit("a"), F.lit(1)))] == ["none", "default", "custom"]
    assert one(spark, names.emphasis_preset(F.create_map(*(F.lit(x) for kv in names.DEFAULT_EMPHASIS.items() for x in kv)))) == "default"
    assert len(set(names.ATTRIBUTES)) == 37 and set(names.DEFAULT_EMPHASIS) < set(names.ATTRIBUTES)
    assert one(spark, names.preview_key(F.lit("a"), F.lit(""))) == one(spark, names.preview_key(F.lit("a"), F.lit(" ")))


def test_view_boxes(spark):
    box = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(100.0).alias("width"), F.lit(50.0).alias("height"))
    z = one(spark, display.zoomed(box, F.lit(50.0), F.lit(25.0), F.lit(0.01)))
    assert (z.x, z.y, z.width, z.height) == (45.0, 22.5, 10.0, 5.0)
    rect = F.struct(F.lit(0.0).alias("left"), F.lit(0.0).alias("top"), F.lit(200.0).alias("width"), F.lit(200.0).alias("height"))
    p = one(spark, display.to_graph(F.lit(100.0), F.lit(100.0), rect, box))
    assert (p.x, p.y) == (50.0, 25.0)
    d = one(spark, display.screen_delta(F.lit(4.0), F.lit(2.0), rect, box))
    assert (d.x, d.y) == (2.0, 1.0)
    bounds = F.struct(F.lit(0.0).alias("min_x"), F.lit(100.0).alias("max_x"), F.lit(0.0).alias("min_y"), F.lit(100.0).alias("max_y"))
    f = one(spark, display.fitting(bounds, F.lit(2.0)))
    assert (f.x, f.y, f.width, f.height) == (-50.0, 0.0, 200.0, 100.0)
    assert one(spark, display.panned(box, F.lit(1.0), F.lit(2.0))).y == 2.0


def test_colours(spark):
    assert one(spark, display.css_colour(F.lit(None).cast("double"))) == display.NO_COLOUR
    assert one(spark, display.css_colour(F.lit(math.pi))) == "oklch(0.7193 0.157 180.0000)"
    rgb = display.rgb_of(np.linspace(0, 6, 13))
    assert rgb.shape == (13, 3) and (rgb >= 0).all() and (rgb <= 1).all()
    assert one(spark, display.percent(F.lit(7), F.lit(3))) == 100
    assert len(one(spark, display.srgb(F.lit(1.0)))) == 3


def test_bitap():
    assert search.bitap("Roboto", "roboto") == 0
    assert search.bitap("Open Sans", "sans") == pytest.approx(0.05)
    assert search.bitap("Roboto", "zzzz") is None
    assert 0 < search.bitap("Helvetica", "helvetca") <= 0.25
    assert search.bitap("x" * 40 + "sans", "sans") is None


def test_fuzzy_search(spark):
    items = spark.createDataFrame([("a", "Open Sans", {"en": "Noto"}), ("b", "Roboto", None), ("c", None, {"en": "Sansa"})], "key string, font_name string, family_names map<string,string>")
    hits = search.fuzzy_search(items, "sans", [F.array("font_name"), F.coalesce(F.map_values("family_names"), F.expr("cast(array() as array<string>)"))])
    assert {r.key for r in hits.collect()} == {"a", "c"} and search.first_hit(hits, "key").first().key == "c"
    weights = items.withColumns({"weight": F.lit(400), "k": F.when(F.col("key") == "a", 1)})
    assert selection.interactive_filter(weights, ()).count() == 0
    assert [r.key for r in selection.interactive_filter(weights, (400,), (1,)).collect()] == ["a"]
    assert selection.interactive_filter(weights, (400,), (), hits).count() == 2


def test_index_finds_what_the_scan_finds(spark, tmp_path):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdAü ") for _ in range(n))
    rows = [(i, rng.choice([None, word(rng.choice([1, 3, 8, 20, 90]))]), [rng.choice([word(6), "Sans", "", " ", None]) for _ in range(rng.randint(0, 3))]) for i in range(300)]
    items = spark.createDataFrame([*rows, (300, "x" * 24 + "abcdabcd", None), (301, "a" * 40, ["a" * 40, "a" * 40])], "id long, name string, more array<string>")
    keys = [F.array("name"), F.col("more")]
    index = search.NameIndex.build(items, "id", keys, str(tmp_path / "i"))
    for query in ("a", "dc", "abc", "sans", "Abcda", "abcdabcd", word(12).strip() or "a", "a" * 40, "zz"):
        want = {r.id: r.score for r in search.fuzzy_search(items, query, keys).collect()}
        got = {r.key: r.score for r in index.search(query, 2).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-30) for k in want), query
    assert index.search("", 2).count() == 0
    plan = index.candidates("abcdabcd")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(gram" in plan
    empty = search.NameIndex.build(items.limit(0), "id", keys, str(tmp_path / "e"))
    assert empty.search("abc", 2).count() == 0


def test_selections(spark):
    faces = spark.createDataFrame([(1, "ps", 400, ["A"]), (2, "ps", 700, ["B"]), (3, None, 430, ["A", "C"])], "face_ord long, postscript_name string, weight int, names array<string>")
    items = spark.createDataFrame([("x", "ps", 400, ["Z"]), ("y", "no", 440, ["C", "C"]), ("z", None, 600, ["A"])], "item string, postscript_name string, weight int, names array<string>")
    assert {r.item: r.face_ord for r in selection.resolve_faces(items, faces).collect()} == {"x": 2, "y": 3, "z": None}
    good, bad = selection.split_errors(selection.with_sources(spark.createDataFrame([("a",), ("b",)], "safe_name string"), spark.createDataFrame([("a", "p")], "safe_name string, path string")))
    assert [r.safe_name for r in good.collect()] == ["a"] and [r.safe_name for r in bad.collect()] == ["b"]
    assert one(spark, selection.available_modes(F.lit(False), F.lit(True))) == ["scatter-plot"] and len(one(spark, selection.available_modes(F.lit(True), F.lit(True)))) == 5
    numbered = selection.indexed(spark.createDataFrame([(x,) for x in "dbcaef"], "k string").repartition(3), "k")
    assert {r.k: r.idx for r in numbered.collect()} == dict(zip("abcdef", range(6), strict=True))


def test_faces_of_many_alike(spark):
    """Before, all items and faces of a name met: a product of their numbers."""
    faces = spark.range(300).selectExpr("id face_ord", "string(null) postscript_name", "int(id % 5 * 100) weight", "array('a', 'b') names")
    items = spark.range(300).selectExpr("id item", "string(null) postscript_name", "int(id % 2 * 250 + 30) weight", "array('a', 'a') names")
    found = selection.resolve_faces(items, faces)
    assert {r.item: r.face_ord for r in found.collect()} == {k: 3 if k % 2 else 0 for k in range(300)}
    assert "Deduplicate" in found._jdf.queryExecution().analyzed().toString()
