"""Session archives (ZIP files of members) as a Spark source and sink, one task an archive."""

from __future__ import annotations

import json
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from cairnflow.sources.store import opened

SCHEMA = "archive string, name string, bytes long, content binary"
SUFFIX, BATCH = ".zip", 4 << 20


def encloses(name: str) -> bool:
    """Whether a member's name stays below the folder that it is unpacked to."""
    parts = name.replace("\\", "/").split("/")
    return bool(name) and ".." not in parts and not name.startswith(("/", "\\")) and ":" not in parts[0] and "\0" not in name


def enclosed(name: Column) -> Column:
    """:func:`encloses` for a column."""
    return ~name.rlike(r"(^|[/\\])\.\.($|[/\\])|^[/\\]|^[^/\\]*:|\x00") & (F.length(name) > 0)


@dataclass
class _Archive(InputPartition):
    path: str


@dataclass
class _Written(WriterCommitMessage):
    files: list


class ArchiveReader(DataSourceReader):
    """A partition for each archive. The options ``names`` and ``archives`` (JSON arrays) choose what is read, ``content`` whether contents are.

    They are options, not conditions that Spark passes on: a session keeps what it last passed for all scans of one table, so that a plan that
    reads a table twice, under two conditions, would lose rows.
    """

    def __init__(self, options: dict):
        chosen = lambda k: set(json.loads(options[k])) if k in options else None
        self.path, self.names, self.archives, self.content = options["path"], chosen("names"), chosen("archives"), options.get("content", "true") == "true"

    def partitions(self) -> list[InputPartition]:
        store, top = opened(self.path)
        found = sorted(f.path for f in store.get_file_info(fs.FileSelector(top)) if f.type == fs.FileType.File and f.path.endswith(SUFFIX))
        return [_Archive(f) for f in found if self.archives is None or _stem(f) in self.archives] or [_Archive("")]

    def read(self, partition: _Archive) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, _ = opened(self.path)
        types = {"archive": pa.string(), "name": pa.string(), "bytes": pa.int64(), "content": pa.binary()}
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), types[k]) for k, c in zip(types, zip(*rows, strict=True), strict=True)], list(types))

        with store.open_input_file(partition.path) as file, zipfile.ZipFile(file) as z:
            for info in z.infolist():
                if info.is_dir() or (self.names is not None and info.filename not in self.names):
                    continue
                if not encloses(info.filename):
                    raise ValueError(f"{info.filename} of {partition.path} leaves its folder")
                rows.append((_stem(partition.path), info.filename, info.file_size, z.read(info) if self.content else None))
                size += len(rows[-1][3] or b"") + len(info.filename)
                if size >= BATCH:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()


class ArchiveWriter(DataSourceWriter):
    """Each task writes its archives beside their places; the commit moves them there, and an abort removes them.

    Archives of the same name are replaced one by one, each complete or not at all; ``overwrite`` also removes all others.
    """

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        store, top = opened(self.path)
        store.create_dir(f"{top}/{self.staging}")
        files, mine, last = [], uuid.uuid4().hex, None
        for archive, rows in groupby(iterator, key=lambda r: r.archive):
            if not archive or not encloses(archive) or "/" in archive or archive in {f[0] for f in files}:
                raise ValueError(f"{archive!r} is no name of an archive, or its rows are not together")
            part, last = f"{self.staging}/{mine}-{len(files)}{SUFFIX}", None
            with store.open_output_stream(f"{top}/{part}") as file, zipfile.ZipFile(file, "w", zipfile.ZIP_STORED) as z:
                for row in rows:
                    if not row.name or not encloses(row.name) or (last is not None and row.name <= last):
                        raise ValueError(f"{row.name!r} of {archive} leaves its folder, is there twice or out of order")
                    last = row.name
                    with z.open(zipfile.ZipInfo(row.name), "w") as to:
                        to.write(row.content or b"")
            files.append((archive, part))
        return _Written(files)

    def commit(self, messages: list) -> None:
        store, top = opened(self.path)
        files = dict(f for m in messages if m is not None for f in m.files)
        if len(files) < sum(len(m.files) for m in messages if m is not None):
            self.abort(messages)
            raise ValueError("an archive was written by two tasks")
        for archive, part in files.items():
            store.move(f"{top}/{part}", f"{top}/{archive}{SUFFIX}")
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(top)):
                if f.path.endswith(SUFFIX) and _stem(f.path) not in files:
                    store.delete_file(f.path)
        self._clean()

    def abort(self, messages: list) -> None:
        self._clean()

    def _clean(self) -> None:
        store, top = opened(self.path)
        if store.get_file_info(f"{top}/{self.staging}").type == fs.FileType.Directory:
            store.delete_dir(f"{top}/{self.staging}")


class ArchiveSource(DataSource):
    """``spark.read.format("archives").load(folder)``: (archive, name, bytes, content) of every member of every archive in a folder."""

    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return ArchiveWriter(self.options["path"], overwrite)


def _stem(path: str) -> str:
    return path.rsplit("/", 1)[-1][: -len(SUFFIX)]


def read_archives(spark: SparkSession, folder: str, names: list[str] | None = None, only: list[str] | None = None, content: bool = True) -> DataFrame:
    """The members of all archives of a folder, or those of these names, or of these archives only; without ``content`` what their directories tell."""
    spark.dataSource.register(ArchiveSource)
    chosen = {k: json.dumps(v) for k, v in (("names", names), ("archives", only)) if v is not None}
    return spark.read.format("archives").options(content=str(content).lower(), **chosen).load(folder)


def member(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One member of every archive that has it; no other content is read."""
    return read_archives(spark, folder, names=[name])


def write_archives(members: DataFrame, folder: str, overwrite: bool = False) -> None:
    """Members (archive, name, content) as archives, entries sorted by name and stored as they are. An archive is one task's, as its file is."""
    members.sparkSession.dataSource.register(ArchiveSource)
    rows = members.select("archive", "name", F.length("content").cast("long").alias("bytes"), "content")
    rows.repartition("archive").sortWithinPartitions("archive", "name").write.format("archives").mode("overwrite" if overwrite else "append").save(folder)


def replace_members(spark: SparkSession, folder: str, changes: DataFrame) -> None:
    """Members (archive, name, content) replaced, or added, in the archives that are there; the others of these archives are copied, other archives left alone."""
    new = changes.select("archive", "name", "content")
    there, known = read_archives(spark, folder), read_archives(spark, folder, content=False).select("archive").distinct()
    own = there.join(new.select("archive").distinct(), "archive", "left_semi")
    kept = own.join(new, ["archive", "name"], "left_anti").select("archive", "name", "content")
    write_archives(kept.unionByName(new.join(known, "archive", "left_semi").select("archive", "name", "content")), folder)
