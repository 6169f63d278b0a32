"""Exact deduplication by content sort.

Rows are range-partitioned on the leading bytes of the normalised text (Spark
samples the splitters), a digest and a salt; the external sort of each range
puts equal texts next to each other, and a window over runs of equal texts
compares every text in full with its neighbour.  The salt comes from the row's
identifier, so copies of one text spread over many ranges; each range passes on
one short record a run, and these records are merged by the text's SHA-256.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import keep_rows, stage

#: Runs into which copies of one text are salted.
SALTS = 1024
#: Leading characters that order the ranges; splitter samples hold no more of a text than this.
LEAD = 32


def exact_dedup(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    keep: str = "min",
    normalise: Callable[[Column], Column] | None = None,
    carry: bool = False,
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after ``normalise`` (default: no change); null
    counts as the empty text.  Of equal texts the row with the smallest key stays
    (``keep="max"``: the largest).  A null key loses to any other; of rows that
    repeat both text and key exactly one stays.  An empty table gives an empty
    result.  With ``carry`` only rows that stay are returned, with the columns of
    ``docs`` alone; otherwise extra columns are ignored, whatever their names.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep must be 'min' or 'max'")
    best = F.max if keep == "max" else F.min
    text_value = F.coalesce(F.col(text), F.lit(""))
    if normalise is not None:
        text_value = normalise(text_value)
    first = F.col("id").desc_nulls_last() if keep == "max" else F.col("id").asc_nulls_last()

    rows = docs.select(F.col(key).alias("id"), text_value.alias("body"), F.xxhash64(text).alias("original"))
    rows = rows.select(
        "*",
        F.substring("body", 1, LEAD).alias("lead"),
        F.xxhash64("body").alias("digest"),
        F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"),
    )
    run = Window.partitionBy("lead", "digest", "salt", "body")
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = stage(
        rows.repartitionByRange("lead", "digest", "salt").select(
            "id",
            "original",
            F.unhex(F.sha2(F.encode("body", "UTF-8"), 256)).alias("sha"),
            "salt",
            F.row_number().over(run.orderBy(first)).alias("place"),
            F.count(F.lit(1)).over(whole).alias("run_size"),
            best("id").over(whole).alias("run_best"),
        ),
        "dedup-runs",
    )
    groups = (
        runs.where("place = 1")
        .groupBy("sha")
        .agg(best("run_best").alias("keep_id"), F.sum("run_size").alias("group_size"), F.collect_set("salt").alias("salts"))
        .select("sha", "keep_id", "group_size", F.explode("salts").alias("salt"))
    )
    joined = runs.join(groups, ["sha", "salt"])
    stays = (F.col("place") == 1) & _stays(keep)
    if carry:
        return keep_rows(docs, key, text, joined.select("id", F.col("original").alias("digest"), stays.alias("stays")))
    return joined.select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        stays.alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def _stays(keep: str) -> Column:
    """Whether a run's first row is its group's; a group of null keys alone keeps one row, as all have one salt."""
    return F.col("id").eqNullSafe(F.col("keep_id"))
