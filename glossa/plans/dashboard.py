"""Overviews of what is stored: totals, the research feed, runs by dataset, matrices of runs.

All take tables with the store's column names, so they serve any tables that are renamed
to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.statistics import matrix
from ..sources.store import Store
from .registry import CATEGORIES, META

#: Fields of a run's summary that overviews read.
SUMMARY = "array<struct<algorithmId:string,algorithm:string,label:string,status:string,inputSize:double,runtimeMs:double,comparisons:double,operations:double,correctness:string>>"


def totals(datasets: DataFrame, experiments: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """One row: ``algorithms, categories, datasets, experiments, benchmarks, visualizable``."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    # All sides are one row.
    out = count(datasets, "datasets").join(count(experiments, "experiments")).join(count(benchmarks, "benchmarks"))
    return out.select(F.lit(len(META)).alias("algorithms"), F.lit(len(CATEGORIES)).alias("categories"), "datasets", "experiments", "benchmarks", F.lit(len(META)).alias("visualizable"))


def store_totals(store: Store) -> DataFrame:
    return totals(store.latest("datasets"), store.latest("experiments"), store.table("benchmark_runs"))


def research_feed(runs: DataFrame, experiments: DataFrame, most_runs: int = 500, most_experiments: int = 200) -> DataFrame:
    """``run_id, experiment_id, name, mode, dataset_id, dataset_version, created_at`` of the latest runs.

    ``runs`` has ``id, experiment_id, created_at``.  A run's dataset is that of its
    experiment if that is among the latest, else null.
    """
    names = experiments.select(F.col("id").alias("experiment_id"), "name", "mode")
    shown = runs.select(F.col("id").alias("run_id"), "experiment_id", "created_at").join(names, "experiment_id").orderBy(F.desc("created_at"), F.desc("run_id")).limit(most_runs)
    known = experiments.orderBy(F.desc("created_at"), F.desc("id")).limit(most_experiments).select(F.col("id").alias("experiment_id"), "dataset_id", "dataset_version")
    return shown.join(known, "experiment_id", "left").select("run_id", "experiment_id", "name", "mode", "dataset_id", "dataset_version", "created_at")


def scaling_history(benchmarks: DataFrame, most: int = 50) -> DataFrame:
    """``at, config, summary`` of the scaling benchmarks among the latest."""
    return benchmarks.orderBy(F.desc("created_at"), F.desc("id")).limit(most).where("kind = 'scaling'").select(F.col("created_at").alias("at"), "config", "summary")


def run_entries(runs: DataFrame) -> DataFrame:
    """``run_id, experiment_id, created_at`` and the fields of each entry of a run's JSON ``summary``."""
    rows = runs.select(F.col("id").alias("run_id"), "experiment_id", "created_at", F.explode(F.from_json("summary", SUMMARY)).alias("__e"))
    return rows.select("run_id", "experiment_id", "created_at", "__e.*")


def runs_by_dataset(entries: DataFrame, experiments: DataFrame, datasets: DataFrame) -> DataFrame:
    """``dataset, version, experiment, algorithmId, runtimeMs, comparisons, created_at`` of entries whose experiment read a dataset.

    A dataset that is gone is named by its number.
    """
    e = experiments.select(F.col("id").alias("experiment_id"), F.col("name").alias("experiment"), "dataset_id", F.col("dataset_version").alias("version")).where("dataset_id is not null")
    d = datasets.select(F.col("id").alias("dataset_id"), F.col("name").alias("known"))
    rows = entries.join(e, "experiment_id").join(d, "dataset_id", "left")
    name = F.coalesce("known", F.concat(F.lit("#"), F.col("dataset_id").cast("string"), F.lit(" (deleted)")))
    return rows.select(name.alias("dataset"), "version", "experiment", "algorithmId", "runtimeMs", "comparisons", "created_at")


def throughput(benchmarks: DataFrame) -> DataFrame:
    """``algorithmId, runs, avgThroughput, avgMedianMs`` over the entries of all comparisons that ended well, from their JSON ``summary``."""
    entry = "array<struct<algorithmId:string,status:string,inputSize:double,medianMs:double>>"
    rows = benchmarks.where("kind = 'compare'").select(F.explode(F.from_json("summary", entry)).alias("e")).select("e.*").where("status = 'ok' and medianMs > 0")
    sums = rows.groupBy("algorithmId").agg(F.count(F.lit(1)).alias("runs"), F.sum("inputSize").alias("n"), F.sum("medianMs").alias("ms"))
    return sums.select("algorithmId", "runs", (F.col("n") / F.col("ms") * 1000).alias("avgThroughput"), (F.col("ms") / F.col("runs")).alias("avgMedianMs"))


def run_matrix(entries: DataFrame, algorithms: list[str], how: str = "first") -> DataFrame:
    """One row a run, a column of run time for each algorithm."""
    return matrix(entries, "run_id", "algorithmId", "runtimeMs", algorithms, how)


def latest_matrix(entries: DataFrame, experiments: list[int]) -> DataFrame:
    """Experiments side by side: the entries of each one's latest run, one row an algorithm and label."""
    place = F.dense_rank().over(Window.partitionBy("experiment_id").orderBy(F.desc("created_at"), F.desc("run_id")))
    rows = entries.where(F.col("experiment_id").isin(experiments)).withColumn("__p", place).where("__p = 1")
    key = F.concat(F.col("algorithmId"), F.when(F.col("label").isNotNull(), F.concat(F.lit(" ["), F.col("label"), F.lit("]"))).otherwise(""))
    return rows.withColumn("entry", key).groupBy("entry").pivot("experiment_id", experiments).agg(F.first("runtimeMs"))
