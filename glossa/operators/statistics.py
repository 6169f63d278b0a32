"""Corpus statistics, statistics of repeated measurements, fits and pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, lines, raw_words, trim

# How blanks are shown in character counts.
SHOWN = {" ": "␣", "\n": "↵", "\t": "⇥"}


def dataset_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """One row over all texts: ``characters, words, lines, documents, avgDocumentLength, vocabularySize, bytes``.

    Documents are non-blank lines; their average length is rounded to one decimal.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    kept = F.filter(F.transform(lines(t), trim), lambda x: x != "")
    sums = df.select(
        F.length(t).cast("long").alias("c"),
        F.size(raw_words(t)).cast("long").alias("w"),
        F.when(t == "", 0).otherwise(F.size(lines(t))).cast("long").alias("l"),
        F.size(kept).cast("long").alias("d"),
        F.aggregate(kept, F.lit(0).cast("long"), lambda s, x: s + F.length(x)).alias("dl"),
        F.octet_length(t).cast("long").alias("b"),
    ).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("c", "w", "l", "d", "dl", "b")])
    vocabulary = df.select(F.explode(raw_words(t)).alias("word")).agg(F.countDistinct("word").alias("vocabularySize"))
    average = F.when(F.col("d") > 0, F.floor(F.col("dl") / F.col("d") * 10 + 0.5) / 10).otherwise(F.lit(0.0))
    out = sums.join(vocabulary)
    return out.select(
        F.col("c").alias("characters"), F.col("w").alias("words"), F.col("l").alias("lines"), F.col("d").alias("documents"), average.alias("avgDocumentLength"), "vocabularySize", F.col("b").alias("bytes")
    )


def word_frequencies(df: DataFrame, text: str = "text", content_only: bool = False) -> DataFrame:
    """``word, count`` of lower-cased words, without stop words if ``content_only``."""
    rows = df.select(F.explode(raw_words(F.col(text))).alias("word"))
    if content_only:
        rows = rows.where(~F.col("word").isin(STOP_WORDS))
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("count"))


def top_words(df: DataFrame, limit: int = 25, text: str = "text", content_only: bool = False) -> DataFrame:
    """``rank, word, count``, ties by word."""
    return ranked(word_frequencies(df, text, content_only), [F.desc("count"), F.col("word")], limit)


def character_frequencies(df: DataFrame, text: str = "text") -> DataFrame:
    """``char, count``; space, line break and tab are shown by signs."""
    rows = df.select(F.explode(F.split(F.col(text), "")).alias("c")).where("c <> ''").groupBy("c").agg(F.count(F.lit(1)).alias("count"))
    shown = F.col("c")
    for raw, sign in SHOWN.items():
        shown = F.when(F.col("c") == raw, sign).otherwise(shown)
    return rows.select(shown.alias("char"), "count")


def ranked(df: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows in ``order`` with a ``rank`` in front; only those rows meet in one task."""
    top = df.orderBy(*order).limit(limit)
    return top.select(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).alias("rank"), *df.columns)


def type_token_ratio(df: DataFrame, text: str = "text") -> DataFrame:
    """One row: ``ratio`` of distinct words to words, three decimals."""
    words = word_frequencies(df, text)
    sums = words.agg(F.count(F.lit(1)).alias("v"), F.sum("count").alias("n"))
    return sums.select(F.when(F.col("n") > 0, F.floor(F.col("v") / F.col("n") * 1000 + 0.5) / 1000).otherwise(F.lit(0.0)).alias("ratio"))


def run_statistics(df: DataFrame, value: str, *by: str) -> DataFrame:
    """``median, mean, min, max, stdev`` (population) of measurements by group."""
    v = F.col(value)
    return df.groupBy(*by).agg(F.median(v).alias("median"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_pop(v).alias("stdev"))


def model_value(model: Column, n: Column, m: Column) -> Column:
    """Work that a theoretical model predicts for input size n and pattern size m."""
    n, one = n.cast("double"), F.greatest(m, F.lit(1)).cast("double")
    lg = F.log2(F.greatest(n, F.lit(2.0)))
    return (
        F.when(model.isin("nm", "mn"), n * one)
        .when(model == "n/m", n / one)
        .when(model == "n+m", n + m)
        .when(model == "nlogn", n * lg)
        .when(model == "nlog2n", n * lg * lg)
        .otherwise(n)
    )


def scaling_fit(points: DataFrame, *by: str) -> DataFrame:
    """``constant, exponent`` by group from ``n, m, t, model``: least squares of t over the model, and the log-log slope."""
    f = model_value(F.col("model"), F.col("n"), F.col("m"))
    rows = points.withColumn("__f", f)
    positive = (F.col("t") > 0) & (F.col("n") > 0)
    slope = F.regr_slope(F.when(positive, F.log("t")), F.when(positive, F.log("n")))
    return rows.groupBy(*by).agg(
        F.coalesce(F.sum(F.col("__f") * F.col("t")) / F.nullif(F.sum(F.col("__f") * F.col("__f")), F.lit(0.0)), F.lit(0.0)).alias("constant"), slope.alias("exponent")
    )


def reproducibility(df: DataFrame, value: str, *by: str) -> DataFrame:
    """``runs, mean, stdev, cv, min, max`` of groups with more than one run."""
    v = F.col(value)
    out = df.where(v.isNotNull()).groupBy(*by).agg(F.count(v).alias("runs"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("stdev"), F.min(v).alias("min"), F.max(v).alias("max"))
    return out.where("runs > 1").withColumn("cv", F.when(F.col("mean") != 0, F.col("stdev") / F.col("mean")).otherwise(F.lit(0.0)))


def matrix(df: DataFrame, row: str, column: str, value: str, columns: list[str], how: str = "first") -> DataFrame:
    """One row per ``row``, a column for each of ``columns``; naming them spares the pass that would find them.

    All columns are one aggregate by ``row``; what no row has is null, a count too.
    """

    def cell(name: str) -> Column:
        here = F.col(column) == F.lit(name)
        if how == "first":  # a null that comes first counts
            return F.first(F.when(here, F.struct(F.col(value).alias("v"))), ignorenulls=True)["v"]
        chosen = {"sum": F.sum, "avg": F.avg, "max": F.max, "count": F.count}[how](F.when(here, F.col(value)))
        return F.when(F.count_if(here) > 0, chosen) if how == "count" else chosen

    return df.groupBy(row).agg(*[cell(name).alias(str(name)) for name in columns])
