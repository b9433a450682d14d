import hashlib
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnflow.functions import display
from cairnflow.operators import layouts, selection
from cairnflow.sources import items, transfers
from cairnflow.streaming import events


def sheets(url):
    if "Broken" in url:
        raise OSError("gone")
    if url.startswith("css:"):
        return b"nothing here" if "Empty" in url else b"@font-face { src: url(file:" + url.split("family=")[1].split(":")[0].encode() + b") }"
    return b"\0\1\0\0" + url.encode() if "Odd" not in url else b"<html>"


def test_subsets_by_way_of_stylesheets(spark):
    asked = spark.createDataFrame([("Open Sans", "400", "aé"), ("Broken", "400", "a"), ("Empty", "700", "a"), ("Odd", "400", "a")], "family string, weight string, text string")
    out = {r.family: r for r in transfers.subsets(asked, sheets, "css:?").collect()}
    assert bytes(out["Open Sans"].content) == b"\0\1\0\0file:Open+Sans" and out["Open Sans"].container == "ttf" and out["Open Sans"].error is None
    assert [out[f].error for f in ("Broken", "Empty", "Odd")] == ["gone", "no address", "not a font"]
    assert all(out[f].content is None for f in ("Broken", "Empty", "Odd"))


def test_bulk_download_and_preview(spark, tmp_path):
    catalog = spark.createDataFrame([("Open Sans", ["regular", "bold"]), ("Odd", ["300"])], "family string, variants array<string>")
    asked = transfers.wanted(catalog, [300, 400, 700], "a")
    assert sorted((r.family, r.requested) for r in asked.collect()) == [("Odd", 300), ("Open Sans", 400), ("Open Sans", 700)]
    files = transfers.subsets(asked, sheets, "css:?").withColumn("name", transfers.file_name(F.col("family"), F.col("requested")))
    saved = transfers.save(files, str(tmp_path / "fonts")).collect()
    assert sorted(p.name for p in (tmp_path / "fonts").iterdir()) == ["Open_Sans_Weight400.ttf", "Open_Sans_Weight700.ttf"] and all(r.error is None for r in saved)
    assert transfers.preview(catalog, "Open", 400, "a", sheets, "css:?").count() == 0
    assert transfers.preview(catalog, "Open Sans", 400, "a", sheets, "css:?").first().container == "ttf"


def test_releases_and_downloads(spark):
    df = spark.createDataFrame([(str(i), i) for i in range(130)], "id string, published_at int")
    assert sorted(r.published_at for r in transfers.newest_releases(df).collect()) == list(range(30, 130))
    whole = [b"x" * 700_000] * 3
    digest, told = hashlib.sha256(b"".join(whole)).hexdigest(), []
    assert b"".join(transfers.download(whole, 2_100_000, f"sha256:{digest}", told.append)) == b"".join(whole) and told == [1_400_000, 2_100_000]
    for size, d in ((2_000_000, digest), (2_200_000, digest), (2_100_000, "0" * 64)):
        with pytest.raises(ValueError):
            list(transfers.download(whole, size, d))


def test_catalog_from_the_first_place_that_there_is(spark, tmp_path):
    (tmp_path / "b.json").write_text('[{"family": "A", "variants": ["400"], "subsets": ["latin"]}, {"family": "B", "variants": [], "subsets": []}]')
    out = items.read_catalog(spark, str(tmp_path / "a.json"), str(tmp_path / "b.json")).orderBy("rank").collect()
    assert [(r.rank, r.family) for r in out] == [(0, "A"), (1, "B")]


def test_vectors_and_images_are_counted(spark):
    two, three = spark.range(2), spark.range(3)
    assert items.checked_vectors(two, two).count() == 2
    with pytest.raises(ValueError):
        items.checked_vectors(two, three)


def test_analysis_needs_one_success(spark):
    ink = np.zeros((9, 7), np.uint8)
    ink[2:5, 3:6] = 200
    image = items.cropped(ink)
    assert items.decode_png(image).shape == (3, 3, 2) and (items.decode_png(image)[..., 0] == 255).all()
    with pytest.raises(ValueError):
        items.cropped(np.zeros((3, 3)))
    encoder = lambda: lambda x: np.ones((len(x), 4), np.float32)
    rows = spark.createDataFrame([("a", bytearray(image)), ("b", bytearray(b"no"))], "id string, content binary")
    good, bad = items.analyzed(rows, encoder, width=4)
    assert [r.id for r in good.collect()] == ["a"] and [r.error for r in bad.collect()] == ["not a PNG"]
    with pytest.raises(RuntimeError, match="not a PNG"):
        items.analyzed(rows.where("id = 'b'"), encoder, width=4)


def font(names, characters):
    """A font file with a name table (Windows entries) and a character map of format 4."""
    strings = b"".join(v.encode("utf-16-be") for _, _, v in names)
    records, at = b"", 0
    for language, name, value in names:
        size = len(value.encode("utf-16-be"))
        records += struct.pack(">6H", 3, 1, language, name, size, at)
        at += size
    name_table = struct.pack(">3H", 0, len(names), 6 + len(records)) + records + strings
    codes = sorted(map(ord, characters))
    n = len(codes) + 1
    body = struct.pack(f">{n}H", *codes, 0xFFFF) + b"\0\0" + struct.pack(f">{n}H", *codes, 0xFFFF) + struct.pack(f">{n}H", *((i + 1 - c) & 0xFFFF for i, c in enumerate(codes)), 1) + struct.pack(f">{n}H", *[0] * n)
    cmap = struct.pack(">HHHHI", 0, 1, 3, 1, 12) + struct.pack(">7H", 4, 14 + len(body), 0, 2 * n, 0, 0, 0) + body
    head = 12 + 32
    out = b"\0\1\0\0" + struct.pack(">4H", 2, 0, 0, 0) + struct.pack(">4sIII", b"cmap", 0, head, len(cmap)) + struct.pack(">4sIII", b"name", 0, head + len(cmap), len(name_table))
    return out + cmap + name_table


def test_fonts_without_glyphs_or_with_internal_names_are_left_out(spark, tmp_path):
    good = font([(0x0409, 1, "Fine"), (0x0407, 1, "Fein"), (0x7777, 4, "Odd tag")], "abc")
    assert [items.glyph_of(good, c) for c in "abcd"] == [1, 2, 3, 0]
    for name, content in (("a", good), ("b", font([(0x0409, 1, ".Hidden")], "abc")), ("c", font([(0x0409, 1, "Few")], "a")), ("d", b"no font")):
        (tmp_path / f"{name}.ttf").write_bytes(content)
    found = items.scan_fonts(spark, str(tmp_path), "abc").collect()
    assert [r.path.rsplit("/", 1)[1] for r in found] == ["a.ttf"]
    assert [(x.language, x.value) for x in found[0].names] == [("en-US", "Fine"), ("de", "Fein"), (str(0x7777), "Odd tag")]
    assert len(items.scan_fonts(spark, str(tmp_path)).collect()) == 2


def test_seeding_returns_the_newest_time(spark):
    some = spark.createDataFrame([("a", 1, "0"), ("b", 5, "0")], "session_id string, modified_at int, app_version string")
    rows, newest = items.seeded(some.limit(0), some, "2")
    assert newest == 5 and {r.app_version for r in rows.collect()} == {"2"}
    assert items.seeded(some, some, "2")[1] is None


def test_missing_models_follow_in_the_order_of_selection(spark):
    known = spark.createDataFrame([("m1", "One", 0, "installed"), ("m2", "Two", 1, "remote")], "id string, name string, place long, availability string")
    out = selection.with_missing(known, spark.createDataFrame([("x", 0), ("m2", 1), ("y", 2), ("x", 3)], "id string, at long"), True).orderBy("place").collect()
    assert [(r.id, r.place, r.availability) for r in out] == [("m1", 0, "installed"), ("m2", 1, "remote"), ("x", 2, "loading"), ("y", 3, "loading")]


def test_vocabulary(spark):
    df = spark.createDataFrame([("analysis_start",), ("model_download_progress",), ("other",)], "e string")
    assert [r.k for r in df.select(events.known(F.col("e")).alias("k")).collect()] == [True, True, False]


def test_boundaries_between_cells(spark):
    nodes = spark.createDataFrame(
        [("s", 0, [], None, None), ("s", 1, [], None, None), ("s", 2, [], None, None), ("s", 3, [0, 1], 0, 0.5), ("s", 4, [3, 2], 1, None)],
        "session_id string, node int, children array<int>, merge_index int, color_angle double")
    cells = spark.createDataFrame([("s", 0, 0.0, 0.0, 4.0, 3.0), ("s", 1, 0.0, 3.0, 4.0, 9.0), ("s", 2, 4.0, 0.0, 10.0, 9.0), ("s", 3, 0.0, 0.0, 4.0, 9.0), ("s", 4, 0.0, 0.0, 10.0, 9.0)], "session_id string, node int, x0 double, y0 double, x1 double, y1 double")
    got = {r.node: (r.x1, r.y1, r.x2, r.y2) for r in layouts.boundaries(cells, nodes).collect()}
    assert got == {3: (0.0, 3.0, 4.0, 3.0), 4: (4.0, 0.0, 4.0, 9.0)}
    square = np.array([[0.0, 0.0], [4, 0], [4, 4], [0, 4]])
    assert np.allclose(sorted(map(tuple, layouts.shared_edge(square, square + [4, 1]))), [(4, 1), (4, 4)])
    assert layouts.shared_edge(square, square + [9, 0]) is None
    polygons = spark.createDataFrame([("s", 0, square.tolist()), ("s", 1, (square + [4, 0]).tolist())], "session_id string, node int, polygon array<array<double>>")
    seg = layouts.voronoi_boundaries(polygons, nodes).collect()
    assert [r.node for r in seg] == [3] and np.allclose(sorted(map(tuple, seg[0].segment)), [(4, 0), (4, 4)])


def test_display_p3_is_the_wider_gamut():
    angles = np.linspace(0, 6, 25)
    narrow, wide = display.rgb_of(angles), display.rgb_of(angles, "p3")
    assert narrow.shape == wide.shape == (25, 3) and (wide >= 0).all() and (wide <= 1).all() and (wide.max(axis=1) <= narrow.max(axis=1) + 1e-9).mean() > 0.8
    with pytest.raises(ValueError):
        display.rgb_of(angles, "cmyk")
