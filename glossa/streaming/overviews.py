"""Overviews that a stream keeps, so that asking for them doesn't read all runs again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.matching import ValidationError

_MERGES = {"sum": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class Overview:
    """Aggregates by ``by`` that can be merged: by name an expression over a run and how its values, and later the parts, become one.

    ``count`` is a sum of ones; the latest run is the ``max`` of a struct that begins with its time.
    """

    by: list[str]
    values: dict[str, tuple[Column, str]]

    def __post_init__(self) -> None:
        wrong = [how for _, how in self.values.values() if how not in _MERGES]
        if wrong:
            raise ValidationError(f"no merge {wrong[0]!r}; there are {', '.join(_MERGES)}")

    def part(self, runs: DataFrame) -> DataFrame:
        """The aggregates of some runs."""
        return runs.groupBy(*self.by).agg(*[_MERGES[how](value).alias(name) for name, (value, how) in self.values.items()])

    def merged(self, parts: DataFrame) -> DataFrame:
        return parts.groupBy(*self.by).agg(*[_MERGES[how](name).alias(name) for name, (_, how) in self.values.items()])


def keep(runs: DataFrame, overview: Overview, folder: str, merge_every: int = 16, **trigger) -> StreamingQuery:
    """Start keeping an overview of a stream of runs in ``folder``.

    Each micro-batch writes the aggregates of its own runs under its number, replacing
    what an attempt before has left there; so a batch that is run again after a failure counts
    once.  Every ``merge_every`` batches all parts so far become one, under a
    number of its own, and parts it holds are passed over from then on.
    """

    def write(batch: DataFrame, number: int) -> None:
        overview.part(batch).coalesce(1).write.mode("overwrite").parquet(f"{folder}/parts/batch={number}")  # a row a group
        if number % merge_every == merge_every - 1:
            own = overview.part(batch)
            every = _parts(batch.sparkSession, folder, number - 1).unionByName(own) if number else own
            overview.merged(every).write.mode("overwrite").parquet(f"{folder}/merged/upto={number}")

    return runs.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


def _numbers(spark, folder: str, name: str) -> list[int]:
    """Numbers of the complete parts; their names are few, as merged ones take the place of many."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}=*/_SUCCESS"))
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or [])


def _parts(spark, folder: str, upto: int) -> DataFrame:
    """The last merged part and the batches after it, up to a number."""
    merged = [n for n in _numbers(spark, folder, "merged/upto") if n <= upto]
    start = merged[-1] if merged else -1
    paths = [f"{folder}/merged/upto={start}"] * bool(merged) + [f"{folder}/parts/batch={n}" for n in _numbers(spark, folder, "parts/batch") if start < n <= upto]
    if not paths:
        raise ValidationError("no batch has been kept yet")
    return spark.read.parquet(*paths)


def kept(spark, overview: Overview, folder: str) -> DataFrame:
    """The overview as of the last batch: one row a group, from the parts alone."""
    return overview.merged(_parts(spark, folder, (1 << 62)))
