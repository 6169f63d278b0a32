"""Consecutive numbers over a whole table's order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import staged


def numbered(rows: DataFrame, *order: str | Column, name: str = "number") -> DataFrame:
    """``rows`` with ``name``: each row's place in the order, from 0; a staged table.

    Rows are sorted by ranges and counted within each; only the number of rows a range
    has, one number a task, comes to the driver.
    """
    # The id holds the partition above 33 bits and the row's place in it below.
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    held = staged(ordered, "ordered")
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r["part"], r["n"]) for r in held.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, total = [0] * (sizes[-1][0] + 1 if sizes else 1), 0
    for p, n in sizes:
        before[p], total = total, total + n
    offset = F.get(F.lit(before).cast("array<long>"), part.cast("int"))
    out = held.withColumn(name, offset + place).drop("__at")
    out._staged_at = held._staged_at
    return out


def with_previous(rows: DataFrame, number: str, *columns: str, prefix: str = "prev_") -> DataFrame:
    """A numbered table with columns of the row before; null in the first row.  Joined by number, so neighbours over a border of tasks meet too."""
    shifted = rows.select((F.col(number) + 1).alias(number), *[F.col(c).alias(f"{prefix}{c}") for c in columns])
    return rows.join(shifted, number, "left")
