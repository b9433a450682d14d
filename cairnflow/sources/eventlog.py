"""Logs of lines as a streaming source with offsets, and as a streaming sink that a restart does not repeat."""

from __future__ import annotations

import io
import itertools
import threading
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage

from cairnflow.sources.store import opened

SCHEMA = "at long, value string"
BATCH, TASK_LINES = 4 << 20, 100_000


@dataclass
class _Part:
    """Lines ``start`` to ``end`` (exclusive) of a part, of which the first one has the offset ``first``."""

    path: str
    first: int
    start: int
    end: int


@dataclass
class _Staged(WriterCommitMessage):
    part: str
    lines: int


@dataclass
class _Task(InputPartition):
    parts: list


class EventLog:
    """A log in a folder: immutable segments ``<first offset>-<lines>-<tag>`` of parts ``<number>-<lines>.ndjson``, each there as a whole or not at all.

    One writer at a time, as of one bridge or one stream.
    """

    def __init__(self, folder: str):
        self.folder, self.lock = folder, threading.Lock()
        self.store, self.top = opened(folder)

    def segments(self) -> list[tuple[int, int, str, str]]:
        """(first offset, lines, tag, path), in order."""
        found = self.store.get_file_info(fs.FileSelector(self.top, allow_not_found=True))
        names = [(f.base_name.split("-", 2), f.path) for f in found if f.type == fs.FileType.Directory and not f.base_name.startswith("_")]
        return sorted((int(n[0]), int(n[1]), n[2], path) for n, path in names)

    def end(self) -> int:
        """The offset of the next line."""
        return max((first + n for first, n, _, _ in self.segments()), default=0)

    def tasks(self, start: int, end: int) -> list[InputPartition]:
        """The same for Spark: small parts, as of single events, are read by one task."""
        out, lines = [_Task([])], 0
        for p in self.parts(start, end):
            if lines >= TASK_LINES:
                out.append(_Task([]))
                lines = 0
            out[-1].parts.append(p)
            lines += p.end - p.start
        return out

    def parts(self, start: int, end: int) -> list[_Part]:
        """What holds the lines from offset ``start`` to ``end``."""
        out = []
        for first, n, _, path in self.segments():
            if first >= end or first + n <= start:
                continue
            for f in sorted(self.store.get_file_info(fs.FileSelector(path)), key=lambda f: f.base_name):
                lines = int(f.base_name.split("-")[1].split(".")[0])
                if first < end and first + lines > start:
                    out.append(_Part(f.path, first, max(start - first, 0), min(end - first, lines)))
                first += lines
        return out

    def staged(self, name: str, lines: Iterator[str]) -> tuple[str, int]:
        """Lines written to a file that is not yet part of the log."""
        self.store.create_dir(f"{self.top}/_staging")
        path, n = f"{self.top}/_staging/{name}", 0
        with self.store.open_output_stream(path) as f:
            for line in lines:
                if "\n" in line or "\r" in line:
                    raise ValueError("an event is one line")
                f.write(line.encode() + b"\n")
                n += 1
        return path, n

    def publish(self, parts: list[tuple[str, int]], tag: str) -> None:
        """Staged files become the log's next segment, by one rename; nothing happens if a segment has this tag."""
        known, total = self.segments(), sum(n for _, n in parts)
        if total and tag not in {s[2] for s in known}:
            place = f"{self.top}/_staging/{uuid.uuid4().hex}"
            self.store.create_dir(place)
            for i, (path, n) in enumerate(p for p in parts if p[1]):
                self.store.move(path, f"{place}/{i:06d}-{n}.ndjson")
            self.store.move(place, f"{self.top}/{max((f + n for f, n, _, _ in known), default=0):016d}-{total}-{tag}")
        for path, _ in parts:
            if self.store.get_file_info(path).type == fs.FileType.File:
                self.store.delete_file(path)

    def append(self, lines: list[str]) -> None:
        """Lines as one segment, from outside Spark."""
        with self.lock:
            name = uuid.uuid4().hex
            self.publish([self.staged(name, iter(lines))], name)


class LogReader(DataSourceReader):
    """All lines of a log, a partition for each part."""

    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        log = EventLog(self.folder)
        return log.tasks(0, log.end())

    def read(self, partition: _Task) -> Iterator[pa.RecordBatch]:
        return _lines(self.folder, partition)


class LogStreamReader(DataSourceStreamReader):
    """Offsets are numbers of lines, so a batch that is run again reads the lines that it read before."""

    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:  # noqa: N802  Spark's name
        return {"at": 0}

    def latestOffset(self) -> dict:  # noqa: N802  Spark's name
        return {"at": EventLog(self.folder).end()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return EventLog(self.folder).tasks(start["at"], end["at"])

    def commit(self, end: dict) -> None:
        """Nothing is removed: others may read the log."""

    def read(self, partition: _Task) -> Iterator[pa.RecordBatch]:
        return _lines(self.folder, partition)


def _lines(folder: str, task: _Task) -> Iterator[pa.RecordBatch]:
    at, values, size = [], [], 0
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(values, pa.string())], ["at", "value"])
    for part in task.parts:
        with opened(folder)[0].open_input_file(part.path) as raw:
            for i, line in enumerate(itertools.islice(io.BufferedReader(raw), part.end)):
                if i >= part.start:
                    at.append(part.first + i)
                    values.append(line.rstrip(b"\n").decode("utf-8", "replace"))
                    size += len(line)
                if size >= BATCH:
                    yield batch()
                    at, values, size = [], [], 0
    if at:
        yield batch()


class LogWriter(DataSourceStreamWriter):
    """A batch becomes one segment that bears its number; a batch that is committed again is left out."""

    def __init__(self, folder: str, name: str):
        self.folder, self.name = folder, name

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        return _Staged(*EventLog(self.folder).staged(uuid.uuid4().hex, (r.value for r in iterator if r.value is not None)))

    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803  Spark's name
        EventLog(self.folder).publish([(m.part, m.lines) for m in messages if m is not None], f"{self.name}.{batchId}")

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803  Spark's name
        store = EventLog(self.folder).store
        for m in messages:
            if m is not None and store.get_file_info(m.part).type == fs.FileType.File:
                store.delete_file(m.part)


class LogSource(DataSource):
    """The format ``eventlog`` of :class:`EventLog`, in batch and as a stream; the option ``writer`` names a sink among those of one log."""

    @classmethod
    def name(cls) -> str:
        return "eventlog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return LogReader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802  Spark's name
        return LogStreamReader(self.options["path"])

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:  # noqa: N802  Spark's name
        return LogWriter(self.options["path"], self.options.get("writer", "stream"))


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    """The lines (at, value) of a log."""
    spark.dataSource.register(LogSource)
    return spark.read.format("eventlog").load(folder)


def log_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A log's lines (at, value) as they come."""
    spark.dataSource.register(LogSource)
    return spark.readStream.format("eventlog").load(folder)


def log_sink(lines: DataFrame, folder: str, checkpoint: str, writer: str = "stream"):
    """A stream of lines (value) appended to a log, each batch once; returns Spark's stream writer, to be started."""
    lines.sparkSession.dataSource.register(LogSource)
    out = lines.select("value").writeStream.format("eventlog").outputMode("append")
    return out.option("path", folder).option("writer", writer).option("checkpointLocation", checkpoint)
