"""Models installed as a whole (D13): fetched by tasks beside their place, checked, and put there by renames that a crash at any step leaves mendable."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnflow.functions import names
from cairnflow.sources.store import opened
from cairnflow.sources.transfers import download

#: What lists an installed folder's files; it is written last.
LISTING = "_assets.json"


class BusyError(RuntimeError):
    """Another installer holds the lease."""


class Installer:
    """Installs into ``root``, on any file system that Spark and Arrow both know.

    Below the root are the models' folders and, under ``_work``, leases, folders that are being filled and what an install puts aside. A lease ends
    ``hold`` seconds after it was taken or last renewed, and is then taken over by one rename, which one of many succeeds in. ``step`` is told what comes next.
    """

    def __init__(self, spark: SparkSession, root: str, hold: float = 600.0, clock: Callable[[], float] = time.time, step: Callable[[str], None] = lambda name: None):
        self.spark, self.root, self.hold, self.clock, self.step = spark, root.rstrip("/"), hold, clock, step
        self.token = uuid.uuid4().hex
        self._jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
        self.fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self._jvm.Path(f"{self.root}/{path}" if path else self.root)

    def _there(self, path: str) -> bool:
        return self.fs.exists(self._at(path))

    def _move(self, path: str, to: str) -> bool:
        return self._there(path) and self.fs.rename(self._at(path), self._at(to))

    def _drop(self, path: str) -> None:
        self.fs.delete(self._at(path), True)

    def _text(self, path: str) -> str | None:
        store, top = opened(self.root)
        try:
            with store.open_input_file(f"{top}/{path}") as f:
                return f.read().decode()
        except OSError:
            return None

    def _write(self, path: str, text: str, replace: bool = False) -> bool:
        """A small new file; False if it is there already."""
        try:
            out = self.fs.create(self._at(path), replace)
        except Exception:  # noqa: BLE001  py4j wraps what is raised
            if not replace and self._there(path):
                return False
            raise
        out.write(text.encode())
        out.close()
        return True

    def lease(self, model: str) -> None:
        """Takes the model's lease, or raises :class:`BusyError`."""
        path = f"_work/{model}.lease"
        mine = json.dumps({"token": self.token, "until": self.clock() + self.hold})
        if self._write(path, mine):
            return
        try:
            until = json.loads(self._text(path) or "{}").get("until")
        except ValueError:
            until = None  # it was not written whole: its age decides
        if until is None:
            until = self.fs.getFileStatus(self._at(path)).getModificationTime() / 1000 + self.hold
        if until > self.clock() or not self._move(path, f"_work/{model}.ended-{self.token}"):
            raise BusyError(f"{model} is being installed")
        self._drop(f"_work/{model}.ended-{self.token}")
        if not self._write(path, mine):
            raise BusyError(f"{model} is being installed")

    def _held(self, model: str) -> None:
        """Renews the lease before a step that cannot be taken back; an installer whose lease was taken over stops here."""
        if json.loads(self._text(f"_work/{model}.lease") or "{}").get("token") != self.token:
            raise BusyError(f"the lease of {model} was taken over")
        self._write(f"_work/{model}.lease", json.dumps({"token": self.token, "until": self.clock() + self.hold}), replace=True)

    def sound(self, path: str) -> bool:
        """Whether a folder holds what its listing says, by names and sizes (digests were checked as the files were written)."""
        try:
            listed = json.loads(self._text(f"{path}/{LISTING}") or "null")
        except ValueError:
            return False
        if not isinstance(listed, dict):
            return False
        sizes = {s.getPath().getName(): s.getLen() for s in self.fs.listStatus(self._at(path))}
        return all(sizes.get(name) == size for name, size in listed.items())

    def resolve(self, model: str) -> str | None:
        """Where a sound install of the model is: its folder or, amid an install, what was put aside."""
        return next((f"{self.root}/{p}" for p in (model, f"_work/{model}.aside") if self._there(p) and self.sound(p)), None)

    def recover(self, model: str) -> None:
        """Mends what a lost installer left, with the lease held: half-filled folders go, and what was put aside returns unless a sound folder took its place."""
        if self._there("_work"):
            for s in self.fs.listStatus(self._at("_work")):
                if s.getPath().getName().startswith(f"{model}.filling-"):
                    self.fs.delete(s.getPath(), True)
        aside = f"_work/{model}.aside"
        if self._there(aside):
            if self.sound(aside) and not (self._there(model) and self.sound(model)):
                self._drop(model)
                self._move(aside, model)
            else:
                self._drop(aside)

    def install(self, model: str, assets: DataFrame, fetch: Callable[[str], Iterable[bytes]], again: bool = False) -> str:
        """The folder of the model, which is filled from ``assets`` (name, url, size, digest) unless it is sound already; ``again`` fills it anyway.

        ``fetch(url)`` gives a file's chunks; tasks call it, one for each file, and write under names of their own, so that a repeated task does no harm.
        """
        if not self.spark.range(1).select(names.valid_model_id(F.lit(model))).first()[0]:
            raise ValueError(f"{model!r} is no model's id")
        if not again and self._there(model) and self.sound(model):
            return f"{self.root}/{model}"
        self.fs.mkdirs(self._at("_work"))
        self.lease(model)
        try:
            self.step("recover")
            self.recover(model)
            if again or not (self._there(model) and self.sound(model)):
                self._fill(model, assets, fetch)
        except Exception:
            self._release(model)
            raise
        self._release(model)
        return f"{self.root}/{model}"

    def _release(self, model: str) -> None:
        if json.loads(self._text(f"_work/{model}.lease") or "{}").get("token") == self.token:
            self._drop(f"_work/{model}.lease")

    def _fill(self, model: str, assets: DataFrame, fetch: Callable[[str], Iterable[bytes]]) -> None:
        filling, aside = f"_work/{model}.filling-{self.token}", f"_work/{model}.aside"
        self._drop(filling)
        self.fs.mkdirs(self._at(filling))
        self.step("fetch")
        rows = assets.select("name", "url", "size", "digest").repartition("name").mapInPandas(_fetcher(f"{self.root}/{filling}", fetch), "name string, size long, error string").collect()
        failed = sorted((r.name or "", r.error) for r in rows if r.error)
        if failed or len({r.name for r in rows}) < len(rows):
            self._drop(filling)
            raise ValueError(f"{model}: {failed[0][0]}: {failed[0][1]}" if failed else f"{model} names a file twice")
        self.step("list")
        self._write(f"{filling}/{LISTING}", json.dumps({r.name: r.size for r in rows}, sort_keys=True))
        if not self.sound(filling):
            raise ValueError(f"{model}: files are missing")
        self._held(model)
        self.step("aside")
        self._move(model, aside)
        self.step("place")
        if not self._move(filling, model):
            self.recover(model)
            raise OSError(f"{model} could not be put into place")
        self.step("clean")
        self._drop(aside)


def _fetcher(folder: str, fetch: Callable[[str], Iterable[bytes]]):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, top = opened(folder)
        for p in parts:
            errors = []
            for name, url, size, digest in zip(p["name"], p["url"], p["size"], p["digest"], strict=True):
                part = f"{top}/_{uuid.uuid4().hex}"
                try:
                    if not name or "/" in name or name.startswith(("_", ".")):
                        raise ValueError("no name of a file")
                    with store.open_output_stream(part) as f:
                        for chunk in download(fetch(url), int(size), digest):
                            f.write(chunk)
                    if store.get_file_info(f"{top}/{name}").type == fs.FileType.NotFound:
                        store.move(part, f"{top}/{name}")
                    else:  # another attempt of this task was first
                        store.delete_file(part)
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  reported beside the file
                    errors.append(str(e) or type(e).__name__)
            yield pd.DataFrame({"name": p["name"], "size": p["size"], "error": errors})

    return run
