"""A versioned store of datasets, experiments, runs and attempts in Parquet tables.

Rows are only ever appended: a change of metadata is a new row with a later sequence
number, a removal a row marked as such, and readers take the latest.  Contents live
in their own table by dataset and version, so listings never read them.
"""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.preprocess import preprocess
from ..operators.matching import ValidationError
from ..operators.statistics import dataset_stats
from .files import validate_content

# The tables and their columns.
TABLES = {
    "datasets": "id int, seq int, name string, description string, source string, current_version int, created_at timestamp, updated_at timestamp, removed boolean",
    "dataset_versions": "dataset_id int, version int, content string, stats string, preprocessing string, note string, created_at timestamp",
    "experiments": "id int, seq int, name string, description string, mode string, algorithms array<string>, config string, dataset_id int, dataset_version int, parent_id int, environment string, created_at timestamp, removed boolean",
    "experiment_runs": "id int, experiment_id int, results string, summary string, created_at timestamp",
    "benchmark_runs": "id int, kind string, algorithms array<string>, config string, summary string, created_at timestamp",
    "challenge_attempts": "id int, challenge_id string, answer string, correct boolean, created_at timestamp",
}


class Store:
    """Tables under ``root``, which all executors share; one writer at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def table(self, name: str) -> DataFrame:
        """All rows ever written."""
        schema = TABLES[name]
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], schema)
            raise

    def latest(self, name: str) -> DataFrame:
        """Current rows of a table whose rows have sequence numbers."""
        place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("seq")))
        return self.table(name).withColumn("__p", place).where("__p = 1 and not removed").drop("__p")

    def append(self, table: str, /, **values) -> dict:
        schema = self.spark.createDataFrame([], TABLES[table]).schema
        row = {f.name: values.get(f.name) for f in schema.fields}
        self.spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{self.root}/{table}")
        return row

    def compact(self, name: str) -> None:
        """Write a table's rows into few files again, without removed rows' children; a listing then reads little.

        Runs of removed experiments and versions of removed datasets go, as do rows that
        later ones replace.  Nothing else may write meanwhile.
        """
        rows = self.latest(name).withColumn("removed", F.lit(False)) if "seq int" in TABLES[name] else self.table(name)
        parent = {"dataset_versions": ("datasets", "dataset_id"), "experiment_runs": ("experiments", "experiment_id")}.get(name)
        if parent:
            alive = self.latest(parent[0]).select(F.col("id").alias(parent[1]))
            rows = rows.join(alive, parent[1], "left_semi")
        fields = [f.split()[0] for f in TABLES[name].split(", ")]
        spare = f"{self.root}/_{name}-compacted"
        rows.select(*fields).write.mode("overwrite").parquet(spare)
        if name in ("datasets", "experiments") and rows.count() < self._top(name):
            # A removed row may have had the largest identifier, which is not given out again.
            self.spark.createDataFrame([{"id": self._top(name), "seq": 1 << 30, "removed": True}], TABLES[name]).write.mode("append").parquet(spare)
        self.spark.read.schema(TABLES[name]).parquet(spare).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/{name}")
        place = self.spark._jvm.org.apache.hadoop.fs.Path(spare)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def _top(self, name: str) -> int:
        return self.table(name).agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]

    def next_id(self, name: str) -> int:
        return self.table(name).agg(F.coalesce(F.max("id"), F.lit(0)) + 1).first()[0]

    def _now(self) -> datetime:
        return datetime.now(timezone.utc).replace(tzinfo=None)

    # Datasets

    def create_dataset(self, name: str, content: str, description: str = "", source: str = "paste", note: str = "Initial version") -> int:
        if not name.strip():
            raise ValidationError("a dataset needs a name")
        if source not in ("paste", "txt", "csv", "synthetic", "derived"):
            raise ValidationError(f"unknown source {source!r}")
        new, now = self.next_id("datasets"), self._now()
        self._add_content(new, 1, content, None, note)
        self.append("datasets", id=new, seq=1, name=name.strip(), description=description, source=source, current_version=1, created_at=now, updated_at=now, removed=False)
        return new

    def _add_content(self, dataset: int, version: int, content: str, config: dict | None, note: str) -> None:
        content = validate_content(content)
        frame = self.spark.createDataFrame([(content,)], "text string")
        stats = dataset_stats(frame).first().asDict()
        self.append("dataset_versions", dataset_id=dataset, version=version, content=content, stats=json.dumps(stats), preprocessing=json.dumps(config) if config else None, note=note, created_at=self._now())

    def datasets(self) -> DataFrame:
        """Current datasets with the statistics of their current version, latest change first; contents are not read."""
        d = self.latest("datasets")
        v = self.table("dataset_versions").select(F.col("dataset_id").alias("id"), F.col("version").alias("current_version"), "stats")
        return d.join(v, ["id", "current_version"], "left").orderBy(F.desc("updated_at"))

    def dataset(self, dataset: int) -> dict:
        row = self.latest("datasets").where(F.col("id") == dataset).first()
        if row is None:
            raise KeyError(f"no dataset {dataset}")
        return row.asDict()

    def versions(self, dataset: int) -> DataFrame:
        """Versions of a dataset without contents, latest first; a removed dataset has none."""
        self.dataset(dataset)
        return self.table("dataset_versions").where(F.col("dataset_id") == dataset).select("version", "stats", "preprocessing", "note", "created_at").orderBy(F.desc("version"))

    def content(self, dataset: int, version: int | None = None) -> DataFrame:
        """``text``: the content of a version, by default the current one; that of a removed dataset is gone."""
        version = version or self.dataset(dataset)["current_version"]
        self.dataset(dataset)
        return self.table("dataset_versions").where((F.col("dataset_id") == dataset) & (F.col("version") == version)).select(F.col("content").alias("text"))

    def add_version(self, dataset: int, content: str, config: dict | None = None, note: str = "") -> int:
        row = self.dataset(dataset)
        version = self.table("dataset_versions").where(F.col("dataset_id") == dataset).agg(F.coalesce(F.max("version"), F.lit(0)) + 1).first()[0]
        self._add_content(dataset, version, content, config, note)
        self.append("datasets", **{**row, "seq": row["seq"] + 1, "current_version": version, "updated_at": self._now()})
        return version

    def preprocess_version(self, dataset: int, config: dict[str, bool], version: int | None = None, note: str = "Preprocessed") -> int:
        """A new version made from an old one by the preprocessing pipeline."""
        text = preprocess(self.content(dataset, version), config).first()["text"]
        return self.add_version(dataset, text, config, note)

    def update_dataset(self, dataset: int, **changes: str) -> dict:
        row = self.dataset(dataset)
        if set(changes) - {"name", "description"}:
            raise ValidationError("only name and description can be changed")
        return self.append("datasets", **{**row, **changes, "seq": row["seq"] + 1, "updated_at": self._now()})

    def remove(self, name: str, key: int) -> None:
        """Mark a dataset or experiment as removed; its versions or runs go out of all listings with it, and with :meth:`compact` for good."""
        row = self.latest(name).where(F.col("id") == key).first()
        if row is None:
            raise KeyError(f"no such row in {name}: {key}")
        self.append(name, **{**row.asDict(), "seq": row["seq"] + 1, "removed": True})

    # Experiments, benchmarks, attempts

    def experiments(self, limit: int = 50, offset: int = 0) -> DataFrame:
        """A page of experiments, latest first, with the number and time of their runs."""
        page = self.latest("experiments").orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)
        runs = self.table("experiment_runs").groupBy(F.col("experiment_id").alias("id")).agg(F.count(F.lit(1)).alias("runs"), F.max("created_at").alias("lastRun"))
        return page.join(runs, "id", "left").withColumn("runs", F.coalesce("runs", F.lit(0))).orderBy(F.desc("created_at"), F.desc("id"))

    def rename_experiment(self, experiment: int, name: str, description: str | None = None) -> dict:
        row = self.latest("experiments").where(F.col("id") == experiment).first()
        if row is None:
            raise KeyError(f"no experiment {experiment}")
        if not name.strip():
            raise ValidationError("an experiment needs a name")
        changed = {"name": name.strip()} | ({} if description is None else {"description": description})
        return self.append("experiments", **{**row.asDict(), **changed, "seq": row["seq"] + 1})

    def experiment(self, experiment: int) -> tuple[dict, DataFrame]:
        """(the experiment, its runs from the latest on)."""
        row = self.latest("experiments").where(F.col("id") == experiment).first()
        if row is None:
            raise KeyError(f"no experiment {experiment}")
        return row.asDict(), self.table("experiment_runs").where(F.col("experiment_id") == experiment).orderBy(F.desc("created_at"), F.desc("id"))

    def benchmarks(self, limit: int = 50) -> DataFrame:
        """The latest benchmarks."""
        return self.table("benchmark_runs").orderBy(F.desc("created_at"), F.desc("id")).limit(limit)

    def recent_runs(self, limit: int = 50) -> DataFrame:
        e = self.latest("experiments").select(F.col("id").alias("experiment_id"), "name", "mode")
        return self.table("experiment_runs").drop("results").join(e, "experiment_id").orderBy(F.desc("created_at"), F.desc("id")).limit(limit)

    def challenge_progress(self) -> DataFrame:
        """``challenge_id, attempts, solved``."""
        return self.table("challenge_attempts").groupBy("challenge_id").agg(F.count(F.lit(1)).alias("attempts"), F.sum(F.when(F.col("correct"), 1).otherwise(0)).alias("solved"))

    def activity(self, limit: int = 12) -> DataFrame:
        """``kind, title, at`` of the latest experiments, benchmarks, attempts and datasets together."""
        feeds = [
            self.latest("experiments").orderBy(F.desc("created_at")).limit(6).select(F.lit("experiment").alias("kind"), F.col("name").alias("title"), F.col("created_at").alias("at")),
            self.table("benchmark_runs").orderBy(F.desc("created_at")).limit(20).select(F.lit("benchmark"), F.concat_ws(": ", "kind", F.array_join("algorithms", ", ")), "created_at"),
            self.table("challenge_attempts").orderBy(F.desc("created_at")).limit(10).select(F.lit("challenge"), "challenge_id", "created_at"),
            self.latest("datasets").orderBy(F.desc("updated_at")).limit(5).select(F.lit("dataset"), "name", "updated_at"),
        ]
        out = feeds[0]
        for f in feeds[1:]:
            out = out.union(f)
        return out.orderBy(F.desc("at")).limit(limit)
