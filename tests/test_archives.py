import os
import zipfile

import pytest
from pyspark.sql import functions as F

from cairnflow.sources import archives


def _members(spark):
    rows = [(f"s{a}", n, f"{a}{n}".encode() * (a + 1)) for a in range(4) for n in ("config.json", "samples/a/meta.json", "samples/a/v.bin")]
    return spark.createDataFrame([*rows, ("s0", "empty", b""), ("s0", "none", None)], "archive string, name string, content binary").repartition(3)


def _plain(df):
    return sorted((r.archive, r.name, r.bytes, bytes(r.content)) for r in df.collect())


def test_round_trip_and_one_member(spark, tmp_path):
    top = str(tmp_path / "a")
    os.makedirs(top)
    archives.write_archives(_members(spark), top)
    assert sorted(os.listdir(top)) == ["s0.zip", "s1.zip", "s2.zip", "s3.zip"]
    want = sorted((r.archive, r.name, len(r.content or b""), bytes(r.content or b"")) for r in _members(spark).collect())
    got = archives.read_archives(spark, top)
    assert _plain(got) == want and got.rdd.getNumPartitions() == 4
    with zipfile.ZipFile(f"{top}/s0.zip") as z:
        assert z.namelist() == sorted(z.namelist()) and z.testzip() is None and all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
    assert _plain(archives.member(spark, f"file://{top}", "config.json")) == [w for w in want if w[1] == "config.json"]
    one = archives.read_archives(spark, top, names=["config.json"], only=["s2"])
    assert _plain(one) == [w for w in want if w[:2] == ("s2", "config.json")] and one.rdd.getNumPartitions() == 1
    assert archives.member(spark, top, "absent").count() == 0
    two = archives.member(spark, top, "config.json").union(archives.member(spark, top, "samples/a/v.bin"))
    assert _plain(two) == [w for w in want if w[1] in ("config.json", "samples/a/v.bin")]
    assert got.where("archive = 's1'").join(got.where("archive <> 's0'").select("archive", "name"), ["archive", "name"]).count() == 3
    listed = archives.read_archives(spark, top, content=False)
    assert sorted((r.archive, r.name, r.bytes) for r in listed.collect()) == [w[:3] for w in want] and listed.where("content is not null").count() == 0


def test_content_of_other_members_is_not_read(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("config.json", "{}")
        z.writestr("z", "spoilt")
    data = (tmp_path / "x.zip").read_bytes().replace(b"spoilt", b"SPOILT")  # its checksum no longer holds
    (tmp_path / "x.zip").write_bytes(data)
    assert bytes(archives.member(spark, str(tmp_path), "config.json").first().content) == b"{}"
    with pytest.raises(Exception, match="CRC"):
        archives.read_archives(spark, str(tmp_path)).collect()


def test_replaced_members_and_overwriting(spark, tmp_path):
    top = str(tmp_path)
    archives.write_archives(_members(spark), top)
    before = {f: os.stat(f"{top}/{f}").st_ino for f in os.listdir(top)}
    changes = spark.createDataFrame([("s1", "config.json", b"new"), ("s1", "more", b"m"), ("nowhere", "config.json", b"x")], "archive string, name string, content binary")
    archives.replace_members(spark, top, changes)
    got = {(a, n): c for a, n, _, c in _plain(archives.read_archives(spark, top))}
    assert got["s1", "config.json"] == b"new" and got["s1", "more"] == b"m" and got["s1", "samples/a/v.bin"] == b"1samples/a/v.bin" * 2
    assert sorted(os.listdir(top)) == ["s0.zip", "s1.zip", "s2.zip", "s3.zip"] and {f for f in before if os.stat(f"{top}/{f}").st_ino != before[f]} == {"s1.zip"}
    archives.write_archives(changes.where("archive = 's1'"), top, overwrite=True)
    assert os.listdir(top) == ["s1.zip"] and len(_plain(archives.read_archives(spark, top))) == 2


@pytest.mark.parametrize("bad", [[("s", "../x", b"")], [("s", "/x", b"")], [("s", "a", b""), ("s", "a", b"")], [("../s", "a", b"")], [(None, "a", b"")]])
def test_a_bad_member_leaves_what_was_there(spark, tmp_path, bad):
    top = str(tmp_path)
    archives.write_archives(_members(spark).where("archive = 's0'"), top)
    want = _plain(archives.read_archives(spark, top))
    rows = spark.createDataFrame([("s0", "b", b"new"), *bad], "archive string, name string, content binary")
    with pytest.raises(Exception):  # noqa: B017, PT011  Spark wraps it
        archives.write_archives(rows, top)
    assert os.listdir(top) == ["s0.zip"] and _plain(archives.read_archives(spark, top)) == want


def test_names_that_leave_the_folder(spark, tmp_path):
    names = ["a", "a/b", "..", "../a", "a/../../b", "a\\..\\b", "/a", "\\a", "c:/a", "a/c:d", "..a/b..", "", "a\0b"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.ok for r in df.select(archives.enclosed(F.col("n")).alias("ok")).collect()] == [archives.encloses(n) for n in names]
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../evil", "x")
    with pytest.raises(Exception, match="leaves its folder"):
        archives.read_archives(spark, str(tmp_path)).collect()


def test_a_folder_without_archives(spark, tmp_path):
    assert archives.read_archives(spark, str(tmp_path)).count() == 0
