"""Text operators over Structured Streaming.

Row-wise operators (tokens, counts of matches, preprocessing) are Column expressions
and run on a streaming DataFrame as they are.  What aggregates over time takes an
event-time column and a watermark, so that its state is dropped once windows close.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators.matching import match_count


def read_documents(spark: SparkSession, folder: str, schema: str = "doc_id long, text string, ts timestamp", files_per_trigger: int = 16) -> DataFrame:
    """Documents from Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def matched(stream: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """Rows of the stream that contain the pattern, with how often."""
    return stream.where(F.contains(F.col(text), F.lit(pattern))).withColumn("matches", match_count(F.col(text), pattern))


def windowed_terms(stream: DataFrame, length: str = "10 minutes", slide: str | None = None, late: str = "10 minutes", text: str = "text", ts: str = "ts", remove_stop_words: bool = True) -> DataFrame:
    """``start, end, term, count`` of terms by window; rows later than ``late`` are left out."""
    rows = stream.withWatermark(ts, late).select(F.col(ts), F.explode(tokens(F.col(text), remove_stop_words=remove_stop_words)).alias("term"))
    span = F.window(ts, length, slide) if slide else F.window(ts, length)
    return rows.groupBy(span.alias("w"), "term").agg(F.count(F.lit(1)).alias("count")).select("w.start", "w.end", "term", "count")


def first_seen(stream: DataFrame, late: str = "1 hour", text: str = "text", ts: str = "ts") -> DataFrame:
    """Documents whose text has not come before within the watermark."""
    return stream.withWatermark(ts, late).withColumn("digest", F.xxhash64(text)).dropDuplicatesWithinWatermark(["digest"]).drop("digest")
