import dataclasses
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnflow.operators import selection, sessions
from cairnflow.sources import items, store


def test_defaults():
    a = sessions.Algorithm.read({"clustering": {"method": "ward"}})
    assert a.analysis.model_id == sessions.DEFAULT_MODEL and a.clustering.enable_preprocess_pca and a.clustering.enable_attribute_emphasis
    assert not sessions.Clustering().enable_attribute_emphasis and sessions.Clustering().method == "complete"
    assert sessions.Algorithm.read(sessions.Algorithm().write()) == sessions.Algorithm()


@pytest.mark.parametrize(("part", "change", "want"), [("rendering", {"text": "B"}, "empty"), ("analysis", {"model_id": "m"}, "rendered"), ("clustering", {"method": "ward"}, "analyzed"), (None, {}, "clustered")])
def test_invalidation(part, change, want):
    old = sessions.Algorithm()
    new = dataclasses.replace(old, **{part: dataclasses.replace(getattr(old, part), **change)}) if part else old
    assert sessions.resume_status("clustered", old, new) == want
    assert sessions.resume_status("empty", old, new, "clustered") == "empty"
    assert sessions.resume_status("clustered", old, old, "rendered") == "rendered"


def test_stage_machine():
    ran, saved = [], []
    p = sessions.Pipeline({s: (lambda _, s=s: ran.append(s)) for s in sessions.STAGES}, lambda i, s: ran.append(f"clear {s}"), lambda i, s: saved.append(s))
    assert p("x", "rendered") == "clustered"
    assert ran == ["clear analysis", "analysis", "clear clustering", "clustering"] and saved == ["analyzed", "clustered"]
    assert sessions.stages_to_run("clustered") == ()
    assert sessions.needs_model("empty", sessions.Clustering()) and not sessions.needs_model("analyzed", sessions.Clustering())
    assert sessions.needs_model("analyzed", sessions.Clustering(enable_attribute_emphasis=True, emphasis={"a": 1}))
    with pytest.raises(ValueError):
        sessions.check_mode("fresh", {"rendering": {}})
    old = sessions.Algorithm(clustering=sessions.Clustering(method="ward"))
    assert sessions.patched(old, {"rendering": {"text": "Q"}}).clustering.method == "ward"


def test_catalog(spark, tmp_path):
    c = sessions.Catalog(spark, f"file://{tmp_path}/catalog")
    a, b = c.create({"title": "one"}), c.create({"title": "two"})
    for s, n in ((a, 3), (b, 2)):
        c.write("items", s, spark.range(n).withColumnRenamed("id", "id"))
    before = c.config(a)["_modified_at"]
    c.rename(a, "renamed")
    assert c.config(a)["title"] == "renamed" and c.config(a)["_modified_at"] == before
    c.update(a, process_status="analyzed")
    assert c.config(a)["_modified_at"] != before
    c.write("items", a, spark.range(5))
    assert (c.read("items", a).count(), c.read("items", b).count()) == (5, 2)
    d = c.duplicate(a)
    assert c.payload(d)["config"]["samples_amount"] == 5
    c.update(d, process_status="clustered")
    with pytest.raises(FileNotFoundError):
        c.payload(d)
    assert c.delete(b) and not c.delete(b) and c.read("sessions").count() == 2


def test_history_keeps_protected(spark):
    df = spark.createDataFrame([(f"s{i:02}", i, i == 0) for i in range(30)], "session_id string, modified_at long, protected boolean")
    assert {r.session_id for r in selection.history(df).collect()} == {"s00", *(f"s{i}" for i in range(10, 30))}


def test_documents(tmp_path):
    src = tmp_path / "s"
    (src / "a").mkdir(parents=True)
    (src / "a" / "x.txt").write_text("x")
    (src / "config.json").write_text("{}")
    items.pack_folder(str(src), str(tmp_path / "d.zip"))
    items.replace_member(str(tmp_path / "d.zip"), "config.json", b'{"a":1}')
    assert items.member(str(tmp_path / "d.zip"), "config.json") == b'{"a":1}'
    items.unpack(str(tmp_path / "d.zip"), str(tmp_path / "out"))
    assert (tmp_path / "out" / "a" / "x.txt").read_text() == "x"
    import zipfile

    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../evil", "x")
    with pytest.raises(ValueError):
        items.unpack(str(tmp_path / "bad.zip"), str(tmp_path / "out"))
    store.write_json(str(tmp_path / "c.json"), {"a": 1})
    assert json.loads((tmp_path / "c.json").read_text()) == {"a": 1}


def test_scans(spark, tmp_path):
    for i, name in enumerate(("b", "a", "c")):
        d = tmp_path / "samples" / name
        d.mkdir(parents=True)
        (d / "meta.json").write_text(json.dumps({"safe_name": name, "weight": 400, "family_names": {"en": "F"}}) if name != "c" else "{broken")
        if name != "c":
            (d / "computed.json").write_text(json.dumps({"safe_name": name, "clustering": {"k": i}}))
            (d / "vector.bin").write_bytes(np.arange(4, dtype="<f4").tobytes())
        (d / "sample.png").write_bytes(items.encode_png(np.full((5, 9), 255, np.uint8), np.arange(45, dtype=np.uint8).reshape(5, 9)) if name != "a" else b"no image")
    top = str(tmp_path / "samples")
    joined = selection.with_computed(items.read_items(spark, top).where("safe_name is not null"), items.read_computed(spark, top).where("safe_name is not null"))
    assert {r.safe_name: r.clustering.k for r in joined.collect()} == {"a": 1, "b": 0}
    assert {r.id: list(r.embedding) for r in items.read_vectors(spark, top).collect()} == {"a": [0, 1, 2, 3], "b": [0, 1, 2, 3]}
    out = items.embed(items.read_images(spark, top), lambda: lambda x: np.repeat(x.mean(axis=(1, 2, 3))[:, None], 512, axis=1)).collect()
    assert {r.id: r.error is None for r in out} == {"a": False, "b": True, "c": True} and all(len(r.embedding) == 512 for r in out if r.error is None)
    (tmp_path / "catalog.json").write_text(json.dumps([{"family": "B", "variants": ["regular"], "subsets": ["latin"]}, {"family": "A", "variants": [], "subsets": []}]))
    assert [(r.rank, r.family) for r in items.read_catalog(spark, str(tmp_path / "catalog.json")).orderBy("rank").collect()] == [(0, "B"), (1, "A")]


def test_images():
    rng = np.random.default_rng(0)
    grey, alpha = (rng.integers(0, 256, (6, 11)).astype(np.uint8) for _ in range(2))
    back = items.decode_png(items.encode_png(grey, alpha))
    assert (back[..., 0] == grey).all() and (back[..., 1] == alpha).all()
    x = items.preprocess(np.stack([np.full((20, 10), 255, np.uint8), np.full((20, 10), 255, np.uint8)], axis=2))
    assert x.shape == (224, 224) and x[0, 0] == 1 and x[112, 112] == 0 and abs((x == 0).mean() - 0.5) < 0.01


def test_fetching_reports_errors(spark):
    def fetch(url):
        if url == "bad":
            raise OSError("gone")
        return url.encode()

    out = {r.url: (r.content, r.error) for r in items.fetched(spark.createDataFrame([("ok",), ("bad",)], "url string"), fetch).collect()}
    assert bytes(out["ok"][0]) == b"ok" and out["bad"] == (None, "gone")


def test_models(spark, tmp_path):
    ok = "b" * 64
    for name in ("m-b", "m-a"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "model.json").write_text(json.dumps({"api_version": 1, "id": name, "name": "M", "digests": [ok]}))
    assert [r.id for r in items.read_models(spark, str(tmp_path)).collect()] == ["m-a", "m-b"]
    assert spark.range(1).select(items.sound_manifest(F.lit(b"x"), F.lit(1), F.sha2(F.lit(b"x"), 256))).first()[0]
    cache = spark.createDataFrame([("a", 60, 1), ("b", 50, 2), ("c", 40, 3)], "key string, bytes long, used_at long")
    assert [r.key for r in items.evicted(cache, 100).collect()] == ["a"]


def test_name_tables():
    import struct

    value = "Ünit".encode("utf-16-be")
    table = struct.pack(">HHH", 0, 1, 18) + struct.pack(">6H", 3, 1, 1033, 1, len(value), 0) + value
    font = b"\0\1\0\0" + struct.pack(">HHHH", 1, 0, 0, 0) + struct.pack(">4sIII", b"name", 0, 28, len(table)) + table
    assert items.parse_names(font) == [(3, 1, 1033, 1, "Ünit")]
