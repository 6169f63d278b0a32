"""Matching of a dictionary of patterns in one pass over the texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import quoted, quoted_column
from .matching import ValidationError

#: From this many patterns on, one automaton pass beats one expression a pattern.
AUTOMATON_FROM = 50
#: Most patterns of a dictionary; it travels with the plan.
MOST_PATTERNS = 500


def check_patterns(patterns: list[str]) -> list[str]:
    """Non-empty patterns in order, repeated ones kept."""
    kept = [p for p in patterns if p]
    if not kept:
        raise ValidationError("at least one pattern is needed")
    if len(kept) > MOST_PATTERNS:
        raise ValidationError(f"at most {MOST_PATTERNS} patterns are allowed")
    return kept


def pattern_frame(spark: SparkSession, patterns: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(check_patterns(patterns))), "pattern_id int, pattern string")


def find_many(df: DataFrame, patterns: list[str], text: str = "text", key: str = "doc_id", automaton_from: int = AUTOMATON_FROM) -> DataFrame:
    """One row per occurrence: ``key, pattern_id, pattern, pos``; keys must be unique."""
    patterns = check_patterns(patterns)
    if len(patterns) >= automaton_from:
        return _by_automaton(df, patterns, text, key)
    entries = F.array(*[F.struct(F.lit(i).alias("pattern_id"), F.lit(p).alias("pattern")) for i, p in enumerate(patterns)])
    rows = df.select(key, F.col(text).alias("__text"), F.explode(entries).alias("__e")).select(key, "__text", "__e.*")
    rows = rows.where(F.contains("__text", "pattern"))
    pieces = F.split("__text", F.concat(F.lit("(?="), quoted_column(F.col("pattern")), F.lit(")")), -1)
    rows = rows.select(key, "pattern_id", "pattern", F.startswith("__text", F.col("pattern")).alias("__at0"), F.posexplode(pieces).alias("__k", "__piece"))
    rows = rows.withColumn("__len", F.length("__piece")).drop("__piece")
    before = Window.partitionBy(key, "pattern_id").orderBy("__k").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("pos", F.coalesce(F.sum("__len").over(before), F.lit(0)).cast("int"))
    return rows.where((F.col("__k") > 0) | F.col("__at0")).select(key, "pattern_id", "pattern", "pos")


def _by_automaton(df: DataFrame, patterns: list[str], text: str, key: str) -> DataFrame:
    ids: dict[str, list[int]] = {}
    for i, p in enumerate(patterns):
        ids.setdefault(p, []).append(i)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for p in ids:
            machine.add_word(p, p)
        machine.make_automaton()
        for batch in batches:
            rows, found, places = [], [], []
            for r, t in enumerate(batch.column(1).to_pylist()):
                for end, p in machine.iter(t or ""):
                    for i in ids[p]:
                        rows.append(r), found.append(i), places.append(end - len(p) + 1)
            keys = batch.column(0).take(pa.array(rows, pa.int32()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(found, pa.int32()), pa.array([patterns[i] for i in found], pa.string()), pa.array(places, pa.int32())], [key, "pattern_id", "pattern", "pos"])

    rows = df.select(key, F.col(text).alias("text"))
    return rows.mapInArrow(scan, f"`{key}` {rows.schema[key].dataType.simpleString()}, pattern_id int, pattern string, pos int")


def emission_order() -> list:
    """How an automaton reports: by end of occurrence, longer patterns first."""
    return [F.col("pos") + F.length("pattern"), F.length("pattern").desc(), F.col("pattern_id")]


def pattern_counts(df: DataFrame, patterns: list[str], text: str = "text") -> DataFrame:
    """``pattern_id, pattern, matches`` over all texts, zeros included, without listing positions."""
    patterns = check_patterns(patterns)
    sums = df.agg(*[F.sum(F.regexp_count(text, F.lit(f"(?={quoted(p)})"))).alias(f"c{i}") for i, p in enumerate(patterns)])
    entry = [F.struct(F.lit(i).alias("pattern_id"), F.lit(p).alias("pattern"), F.coalesce(f"c{i}", F.lit(0)).cast("long").alias("matches")) for i, p in enumerate(patterns)]
    return sums.select(F.inline(F.array(*entry)))


def automaton_states(spark: SparkSession, patterns: list[str]) -> DataFrame:
    """One row, ``states``: the distinct prefixes of the patterns, the empty one included."""
    frame = pattern_frame(spark, patterns)
    prefixes = frame.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("pattern")), lambda k: F.substring("pattern", F.lit(1), k))).alias("prefix"))
    return prefixes.agg((F.countDistinct("prefix") + 1).alias("states"))
