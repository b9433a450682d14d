import hashlib
import os

import pytest

from cairnflow.sources.installs import BusyError, Installer

STEPS = ["recover", "fetch", "list", "aside", "place", "clean"]


class Lost(BaseException):
    """The installer's process ends."""


def _assets(spark, version, spoil=None):
    rows = [(f"f{i}.bin", f"{version}-{i}", 2 * len(f"{version}-{i}"), "sha256:" + hashlib.sha256(f"{version}-{i}".encode() * 2).hexdigest()) for i in range(3)]
    if spoil is not None:
        rows[1] = spoil(rows[1])
    return spark.createDataFrame(rows, "name string, url string, size long, digest string")


def _fetch(url):
    if url == "gone":
        raise OSError("no such file")
    return [url.encode(), url.encode()]


def _content(path):
    return {f: open(f"{path}/{f}").read() for f in os.listdir(path) if f.startswith("f")} if path else None


def _of(version):
    return {f"f{i}.bin": f"{version}-{i}" * 2 for i in range(3)}


def test_installs_once(spark, tmp_path):
    seen, root = [], f"file://{tmp_path}/models"
    one = Installer(spark, root, step=seen.append)
    assert one.resolve("m-1") is None
    assert _content(one.install("m-1", _assets(spark, "a"), _fetch).removeprefix("file://")) == _of("a") and seen == STEPS
    assert one.install("m-1", _assets(spark, "b"), _fetch) == f"{root}/m-1" and seen == STEPS
    os.remove(tmp_path / "models" / "m-1" / "f1.bin")  # no longer sound: filled again
    assert one.resolve("m-1") is None and _content(one.install("m-1", _assets(spark, "b"), _fetch).removeprefix("file://")) == _of("b")
    assert os.listdir(tmp_path / "models" / "_work") == [] and sorted(os.listdir(tmp_path / "models")) == ["_work", "m-1"]
    with pytest.raises(ValueError, match="id"):
        one.install("../m", _assets(spark, "a"), _fetch)


@pytest.mark.parametrize("at", STEPS)
def test_a_crash_at_each_step(spark, tmp_path, at):
    root, now = str(tmp_path), [1000.0]
    Installer(spark, root, clock=lambda: now[0]).install("m-1", _assets(spark, "old"), _fetch)

    def lose(step):
        if step == at:
            raise Lost

    with pytest.raises(Lost):
        Installer(spark, root, clock=lambda: now[0], step=lose).install("m-1", _assets(spark, "new"), _fetch, again=True)
    other = Installer(spark, root, clock=lambda: now[0])
    assert _content(other.resolve("m-1")) == _of("new" if at == "clean" else "old")  # one of both can be read at any time
    with pytest.raises(BusyError):
        other.install("m-1", _assets(spark, "new"), _fetch, again=True)
    now[0] += 601
    other.lease("m-1")
    other.recover("m-1")
    assert _content(f"{root}/m-1") == _of("new" if at == "clean" else "old")
    other._release("m-1")
    assert _content(other.install("m-1", _assets(spark, "third"), _fetch, again=True)) == _of("third") and os.listdir(tmp_path / "_work") == []


@pytest.mark.parametrize(("spoil", "says"), [
    (lambda r: (r[0], "gone", *r[2:]), "no such file"), (lambda r: (*r[:2], r[2] + 1, r[3]), "instead of"), (lambda r: (*r[:2], 1, r[3]), "more than"),
    (lambda r: (*r[:3], "sha256:00"), "digest"), (lambda r: ("../x", *r[1:]), "no name"), (lambda r: ("f0.bin", *r[1:]), "twice")])
def test_a_failure_keeps_what_was_there(spark, tmp_path, spoil, says):
    one = Installer(spark, str(tmp_path))
    one.install("m-1", _assets(spark, "old"), _fetch)
    with pytest.raises(ValueError, match=says):
        one.install("m-1", _assets(spark, "new", spoil), _fetch, again=True)
    assert _content(one.resolve("m-1")) == _of("old") and os.listdir(tmp_path / "_work") == []


def test_an_installer_that_lost_its_lease_stops(spark, tmp_path):
    now, root = [0.0], str(tmp_path)
    slow = Installer(spark, root, clock=lambda: now[0])

    def taken(step):
        if step == "list":
            now[0] += 601
            Installer(spark, root, clock=lambda: now[0]).lease("m-1")

    slow.step = taken
    with pytest.raises(BusyError):
        slow.install("m-1", _assets(spark, "a"), _fetch)
    assert slow.resolve("m-1") is None
