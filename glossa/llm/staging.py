"""Lineage cuts that survive the loss of executors.

A staged table is an ordinary Parquet table in the folder named by
``spark.checkpoint.dir``, which the driver and all executors share.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Settings while a table is staged: a query's shuffle files go when it ends, and batches for Python are small.
_SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}

#: Seconds between collections on the driver, by which Spark learns which broadcasts nobody refers to and frees them on the executors.
COLLECT_EVERY = 2.0

_collected = 0.0
_scopes: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where unset, a temporary one on a local master only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="glossa-stage-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it again, so that later plans start from the written table.

    The table stays until it is discarded, its scope ends, or the driver does.
    """
    global _collected
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in _SETTINGS}
    for k, value in _SETTINGS.items():
        spark.conf.set(k, value)
    try:
        df.write.parquet(path)
    finally:
        for k, value in before.items():
            spark.conf.unset(k) if value is None else spark.conf.set(k, value)
    folder, place = _folder(spark, path)
    folder.deleteOnExit(place)
    if time.monotonic() - _collected > COLLECT_EVERY:
        gc.collect()
        spark._jvm.System.gc()
        _collected = time.monotonic()
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    if _scopes:
        _scopes[-1].append(out)
    return out


def discard(*staged: DataFrame) -> None:
    """Delete staged tables that nothing reads any more: all that came from them is staged or written itself."""
    for df in staged:
        folder, place = _folder(df.sparkSession, df._staged_at)
        folder.delete(place, True)


@contextmanager
def scope() -> Iterator[list[DataFrame]]:
    """Delete, at the end, what operators staged within; take a table out of the given list to keep it.

        with scope() as staged:
            exact_dedup(docs).write.parquet(path)
    """
    held: list[DataFrame] = []
    _scopes.append(held)
    try:
        yield held
    finally:
        _scopes.pop()
        discard(*held)


def _folder(spark: SparkSession, path: str) -> tuple:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows whose texts in a column have about ``most`` bytes together, a row at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def keep_rows(docs: DataFrame, key: str, text: str, decided: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns alone.

    ``decided`` has a row for each of ``docs``: ``id``, ``digest`` (xxhash64 of the
    text) and ``stays``.  Null keys and null texts are equal to each other.  Rows alike in
    both are interchangeable; of those at most one stays, whatever their other columns.  What goes is far less than what stays, so rows are held against the former.
    """
    classes = decided.groupBy("id", "digest").agg(F.count(F.lit(1)).alias("many"), F.max("stays").alias("stays")).where("many > 1 or not stays")
    classes = stage(classes, "leaving").select(F.col("id").alias("__id"), F.col("digest").alias("__digest"), "many", "stays")
    own = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(key).alias("id"), F.xxhash64(text).alias("digest")]
    rows = docs.select(*own)
    out = rows.join(classes.select("__id", "__digest"), F.col("id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest")), "left_anti").select("row.*")
    again = classes.where("stays")
    if again.isEmpty():
        return out
    first = F.row_number().over(Window.partitionBy("id", "digest").orderBy(F.xxhash64("row")))
    repeated = rows.join(again.select("__id", "__digest"), F.col("id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest")), "left_semi")
    return out.union(repeated.withColumn("place", first).where("place = 1").select("row.*"))


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that clash with none of ``df``'s, in the order of ``wanted``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
