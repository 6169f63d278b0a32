import shutil

import pytest
from pyspark.sql import functions as F

from glossa.operators.matching import ValidationError
from glossa.plans import queries
from glossa.streaming.overviews import Overview, keep, kept

SCHEMA = "id long, algorithm string, ms double, at timestamp"


@pytest.fixture
def overview(spark):
    return Overview(["algorithm"], {"runs": (F.lit(1), "sum"), "total": (F.col("ms"), "sum"), "least": (F.col("ms"), "min"), "latest": (F.struct("at", "id"), "max")})


def rows(df):
    return sorted((r.algorithm or "", r.runs, round(r.total or 0, 6), r.least, r.latest.id) for r in df.collect())


def test_equals_the_batch_query_after_each_batch_and_a_restart(spark, tmp_path, overview):
    import datetime as dt

    folder, source = str(tmp_path / "kept"), str(tmp_path / "runs")
    for step in range(5):
        data = [(100 * step + k, [None, "kmp", "naive"][k % 3], None if k == 7 else k * 1.5, dt.datetime(2024, 1, 1 + (step * 7 + k) % 28)) for k in range(20)]
        for part in range(2):
            spark.createDataFrame(data[part::2], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        query = keep(stream, overview, folder, merge_every=3)
        query.awaitTermination()
        assert query.exception() is None
        assert rows(kept(spark, overview, folder)) == rows(overview.part(spark.read.schema(SCHEMA).parquet(source)))
    # What a merged part holds isn't read again.
    shutil.rmtree(tmp_path / "kept" / "parts" / "batch=0")
    assert rows(kept(spark, overview, folder)) == rows(overview.part(spark.read.schema(SCHEMA).parquet(source)))


def test_a_batch_that_is_run_again_counts_once(spark, tmp_path, overview):
    folder, source = str(tmp_path / "kept"), str(tmp_path / "runs")
    spark.range(10).selectExpr("id", "'kmp' algorithm", "cast(id as double) ms", "timestamp'2024-01-01' at").coalesce(1).write.parquet(source)
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(source)
    keep(stream(), overview, folder).awaitTermination()
    for log in (tmp_path / "kept" / "checkpoint" / "commits").iterdir():
        log.unlink()  # as after a failure between writing and committing
    keep(stream(), overview, folder).awaitTermination()
    assert rows(kept(spark, overview, folder)) == [("kmp", 10, 45.0, 0.0, 9)]


def test_refusals(spark, tmp_path, overview):
    with pytest.raises(ValidationError):
        Overview(["a"], {"x": (F.lit(1), "avg")})
    with pytest.raises(ValidationError):
        kept(spark, overview, str(tmp_path))


def test_query_equals_the_batch(spark):
    folder = "/root/testdata/sf0.001"
    got = {r.event_type: (r.runs, r.measured, round(r.total, 4), r.least, r.most, r.latest_id) for r in queries.QUERIES["streamed_overview"](spark, folder).collect()}
    e = spark.read.parquet(f"{folder}/events.parquet")
    want = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("runs"), F.count("value").alias("measured"), F.sum("value").alias("total"), F.min("value").alias("least"), F.max("value").alias("most"), F.max(F.struct("ts", "event_id")).alias("latest"))
    assert got == {r.event_type: (r.runs, r.measured, round(r.total, 4), r.least, r.most, r.latest.event_id) for r in want.collect()}
