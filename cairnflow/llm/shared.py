"""What the operators share: tables in the cluster's shared folder, the learning split, small helpers."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnflow.sources.tables import table

__all__ = ["discard", "free_name", "held_out", "lean_batches", "shared_dir", "stored", "table"]

#: Bytes of an Arrow batch on its way to Python, where the session has Spark's own 64 MB.
BATCH_BYTES = 4 << 20
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"
_set: set[str] = {"67108864b", "64m", "64mb"}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or one below the warehouse only where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder as Parquet and read back: its lineage is cut and survives lost executors.

    The files go with ``discard``, or when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at, fs = _file(spark, path)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes the files of stored tables that nothing reads any more (tables of any other kind are left alone)."""
    for t in tables:
        if path := getattr(t, "stored_at", None):
            at, fs = _file(t.sparkSession, path)
            fs.delete(at, True)


def _file(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def lean_batches(df: DataFrame, least: int = BATCH_BYTES) -> None:
    """Has the session send Python batches of about ``least`` bytes, unless it was told another size: with thousands of rows a
    batch, long texts would need many times the memory on either side."""
    conf = df.sparkSession.conf
    if str(conf.get(_BATCHES, "64m")).lower() in _set:
        conf.set(_BATCHES, f"{least}b")
        _set.add(f"{least}b")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text is divisible by 5 (a null id is held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that the table does not have yet."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish
