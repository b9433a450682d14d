"""Tables in the folder that all executors share, and atomic small files."""

from __future__ import annotations

import json
import os
import re
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir`` (or the warehouse, where that is unset), removed when the application ends."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    path = f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path (local, or any that Arrow knows) and the path in it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path).rstrip("/"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once below ``spark.checkpoint.dir`` (or the warehouse, where that is unset) and read back; removed by ``discard``, or when the application ends."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes the files of stored tables that nothing reads any more (other tables are left alone)."""
    for t in tables:
        if path := getattr(t, "stored_at", None):
            at = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def write_json(path: str, value: dict) -> None:
    """A small document, complete or not there at all."""
    top = os.path.dirname(os.path.abspath(path))
    handle, part = tempfile.mkstemp(dir=top, suffix=".part")
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        json.dump(value, f, sort_keys=True)
    os.replace(part, path)
