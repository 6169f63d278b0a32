"""Experiments that can be run again, and exercises with computed answers."""

from __future__ import annotations

import json
import math
import os
import platform
import re
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.preprocess import preprocess
from ..functions.text import normalize_answer, split_documents
from ..operators import matching as ma
from ..operators.matching import ValidationError
from ..sources.store import Store
from ..sources.workloads import TYPES, Workload, generate
from . import benchmark
from .registry import META, Input, compact, execute

MODES = ("run", "compare", "scaling", "stress")


def environment(spark: SparkSession) -> dict:
    """Versions, machine and memory that a run had."""
    conf = spark.sparkContext.getConf()
    pages = os.sysconf("SC_PHYS_PAGES") * os.sysconf("SC_PAGE_SIZE")
    return {
        "spark": spark.version, "python": platform.python_version(), "platform": platform.platform(), "cpu": platform.processor() or platform.machine(), "cpus": os.cpu_count(),
        "memoryGB": round(pages / 1e9), "parallelism": spark.sparkContext.defaultParallelism, "driverMemory": conf.get("spark.driver.memory", "1g"), "executorMemory": conf.get("spark.executor.memory", "1g"),
    }


def benchmark_source(spark: SparkSession, store: Store | None, source: dict) -> tuple[Input | None, Workload | None]:
    """(input, workload) that a benchmark's source names: ``kind`` workload, dataset or, by default, inline."""
    kind = source.get("kind", "inline")
    if kind == "workload":
        spec = source.get("workload") or {}
        if spec.get("type") not in TYPES:
            raise ValidationError(f"unknown workload type {spec.get('type')!r}")
        return None, generate(**spec)
    if kind == "dataset":
        return resolve_input(spark, store, {"dataset_id": source["dataset_id"], "dataset_version": source.get("version"), "input": source.get("input"), "preprocessing": source.get("preprocessing")}), None
    return sanitized(source.get("input")), None


def sanitized(raw: dict | None) -> Input:
    """An input of the known fields alone, each of its type; lists hold texts, ``top_k`` is from 1 to 100."""
    raw = raw if isinstance(raw, dict) else {}
    texts = {k: raw[k] for k in ("text", "pattern", "query", "text_b", "method") if isinstance(raw.get(k), str)}
    lists = {k: string_list(raw[k]) for k in ("patterns", "documents") if raw.get(k) is not None}
    top = raw.get("top_k")
    number = {"top_k": clamp_int(top, 1, 100, 10)} if isinstance(top, (int, float)) and not isinstance(top, bool) else {}
    return Input(**texts, **lists, **number)


def string_list(value: object) -> list[str]:
    if not isinstance(value, (list, tuple)):
        raise ValidationError("a list of texts is needed")
    return [str(x) for x in value]


def clamp_int(value: object, low: int, high: int, default: int) -> int:
    """A number or the number that a text begins with, brought into its bounds; the default where there is none."""
    if isinstance(value, str):
        m = re.match(r"\s*[+-]?\d+", value)
        value = int(m.group()) if m else None
    if isinstance(value, bool) or not isinstance(value, (int, float)) or value != value or abs(value) == float("inf"):
        return default
    return max(low, min(high, math.floor(value)))


def parse_id(value: object) -> int:
    """A positive whole number."""
    number = clamp_int(value, -(1 << 53), 1 << 53, 0) if not isinstance(value, str) or value.strip().isdecimal() else 0
    if number <= 0 or (isinstance(value, float) and value != number):
        raise ValidationError(f"{value!r} is no identifier")
    return number


def check_config(config: dict) -> dict:
    """A configuration with its mode and algorithms checked; inline inputs are bounded."""
    if config.get("mode") not in MODES:
        raise ValidationError(f"the mode must be one of {', '.join(MODES)}")
    if not config.get("algorithms"):
        raise ValidationError("select at least one algorithm")
    if len(json.dumps(config.get("input") or {})) > 200_000:
        raise ValidationError("an inline input must not exceed 200,000 characters; store it as a dataset")
    return config


def resolve_input(spark: SparkSession, store: Store | None, config: dict) -> Input:
    """The input that a configuration names: a dataset's version, a workload or inline fields."""
    params = dict(config.get("input") or {})
    if config.get("dataset_id"):
        frame = store.content(config["dataset_id"], config.get("dataset_version"))
        if config.get("preprocessing"):
            frame = preprocess(frame, config["preprocessing"])
        row = frame.select("text", split_documents(F.col("text")).alias("documents")).first()
        return Input(**{**params, "text": row["text"], "documents": row["documents"]})
    if config.get("workload"):
        w = generate(**config["workload"])
        return Input(text=w.text, pattern=w.pattern, patterns=w.patterns, documents=w.documents, query=w.query, text_b=w.text_b)
    given = Input(**params)
    if config.get("preprocessing") and given.text:
        given.text = preprocess(spark.createDataFrame([(given.text,)], "text string"), config["preprocessing"]).first()["text"]
    return given


def run_config(spark: SparkSession, store: Store | None, config: dict) -> tuple[list, list[dict]]:
    """(results, summary rows) of one run; in run mode an algorithm's failure is a row of its own."""
    check_config(config)
    names, mode = config["algorithms"], config["mode"]
    if mode == "scaling":
        points, fits = benchmark.scaling(spark, names, config.get("sizes", [1000, 10_000, 100_000]), config.get("workload", {}).get("type", "random"), config.get("repetitions"))
        exponent = {r["algorithmId"]: r["exponent"] for r in fits.collect()}
        series = benchmark.scaling_series(points).orderBy("algorithmId", "size").collect()
        rows = [
            {"algorithmId": r["algorithmId"], "label": f"n={r['size']}", "inputSize": r["n"], "runtimeMs": r["t"], "theoretical": r["theoretical"], "comparisons": r["comparisons"], "exponent": exponent.get(r["algorithmId"])}
            for r in series
        ]
        return rows, rows
    if mode == "stress":
        found = benchmark.stress(spark, names, config.get("workloads", ["random", "repetitive", "worst-case"]), config.get("size", 50_000), config.get("repetitions"))
        return found, [{"algorithmId": e["algorithmId"], "label": e["workload"], "runtimeMs": e.get("medianMs"), "correctness": e.get("correctness")} for e in found]
    given = resolve_input(spark, store, config)
    if mode == "compare":
        found = benchmark.compare(spark, names, given=given, repetitions=config.get("repetitions"))
        return found, [{"algorithmId": e["algorithmId"], "runtimeMs": e.get("medianMs"), "inputSize": e.get("inputSize"), "correctness": e.get("correctness"), "status": e["status"]} for e in found]
    results, rows = [], []
    for name in names:
        try:
            r = compact(execute(spark, name, given))
            results.append(asdict(r))
            rows.append({"algorithmId": name, "status": "ok", **r.metrics})
        except ValidationError as e:
            rows.append({"algorithmId": name, "status": "error", "message": str(e)})
    return results, rows


def create_and_run(spark: SparkSession, store: Store, name: str, config: dict, description: str = "", parent: int | None = None) -> tuple[int, int]:
    """(experiment, run): the configuration is stored with the dataset version it read."""
    if not name.strip():
        raise ValidationError("an experiment needs a name")
    config = dict(check_config(config))
    if config.get("dataset_id") and not config.get("dataset_version"):
        config["dataset_version"] = store.dataset(config["dataset_id"])["current_version"]
    results, rows = run_config(spark, store, config)
    new = store.next_id("experiments")
    store.append(
        "experiments", id=new, seq=1, name=name.strip(), description=description, mode=config["mode"], algorithms=config["algorithms"], config=json.dumps(config),
        dataset_id=config.get("dataset_id"), dataset_version=config.get("dataset_version"), parent_id=parent, environment=json.dumps(environment(spark)), created_at=store._now(), removed=False,
    )
    return new, _store_run(store, new, results, rows)


def _store_run(store: Store, experiment: int, results: list, rows: list[dict]) -> int:
    run = store.next_id("experiment_runs")
    store.append("experiment_runs", id=run, experiment_id=experiment, results=json.dumps(results, default=str), summary=json.dumps(rows, default=str), created_at=store._now())
    return run


def rerun(spark: SparkSession, store: Store, experiment: int) -> int:
    row = store.latest("experiments").where(F.col("id") == experiment).first()
    if row is None:
        raise KeyError(f"no experiment {experiment}")
    return _store_run(store, experiment, *run_config(spark, store, json.loads(row["config"])))


def duplicate(spark: SparkSession, store: Store, experiment: int) -> tuple[int, int]:
    row = store.latest("experiments").where(F.col("id") == experiment).first()
    if row is None:
        raise KeyError(f"no experiment {experiment}")
    return create_and_run(spark, store, f"{row['name']} (copy)", json.loads(row["config"]), row["description"] or "", parent=experiment)


def report(store: Store, experiment: int) -> DataFrame:
    """One row: an experiment with its configuration, environment, algorithms' growth bounds and all of its runs, as structs."""
    row, runs = store.experiment(experiment)
    spark = store.spark
    meta = [(a, *META[a][:4]) if a in META else (a, None, None, None, None) for a in row["algorithms"]]
    algorithms = spark.createDataFrame(meta, "id string, name string, category string, worst string, space string").agg(F.collect_list(F.struct("*")).alias("algorithms"))
    given = spark.createDataFrame([(row["config"], row["environment"])], "configuration string, environment string")
    own = F.struct(*[F.lit(row[k]).cast(kind).alias(k) for k, kind in (("id", "int"), ("name", "string"), ("description", "string"), ("mode", "string"), ("created_at", "timestamp"), ("parent_id", "int"))])
    source = F.struct(F.lit(row["dataset_id"]).cast("int").alias("id"), F.lit(row["dataset_version"]).cast("int").alias("version"))
    listed = runs.agg(F.sort_array(F.collect_list(F.struct("id", "created_at", "summary", "results")), False).alias("runs"))
    # All sides are one row.
    return given.join(algorithms).join(listed).select(F.current_timestamp().alias("exportedAt"), own.alias("experiment"), F.when(F.lit(row["dataset_id"] is not None), source).alias("dataset"), "configuration", "environment", "algorithms", "runs")


# Exercises. Their identifiers, inputs and, where nothing is computed, answers.
def _found(text: str, pattern: str) -> Callable[[SparkSession], str]:
    return lambda spark: ",".join(map(str, execute(spark, "kmp", Input(text=text, pattern=pattern)).output["matches"]))


def _order(text: str) -> Callable[[SparkSession], str]:
    return lambda spark: ",".join(map(str, execute(spark, "suffix-array", Input(text=text)).output["suffixArray"]))


def _distance(a: str, b: str) -> Callable[[SparkSession], str]:
    return lambda spark: str(execute(spark, "edit-distance", Input(text=a, text_b=b)).output["distance"])


def _fewer(spark: SparkSession) -> str:
    given = Input(text="a" * 200, pattern="aaaab")
    return min(("kmp", "naive"), key=lambda a: execute(spark, a, given).metrics["comparisons"])


CHALLENGES: dict[str, Callable[[SparkSession], str]] = {
    "find-pattern-1": _found("abracadabra abracadabra", "abra"),
    "lps-1": lambda spark: ",".join(map(str, ma.lps("AABAACAABAA"))),
    "lps-2": lambda spark: ",".join(map(str, ma.lps("ABABABAB"))),
    "kmp-next-step": lambda spark: str(ma.lps("ABABC")[3]),
    "complexity-1": lambda spark: "O(n·m)",
    "complexity-2": lambda spark: "O(n + z)",
    "compare-1": _fewer,
    "sa-1": _order("banana"),
    "sa-2": _order("mississippi"),
    "ed-1": _distance("sunday", "saturday"),
    "ed-2": _distance("algorithm", "altruistic"),
    "ac-1": lambda spark: str(execute(spark, "aho-corasick", Input(text="ushers", patterns=["he", "she", "his", "hers"])).output["totalMatches"]),
}


def grade(spark: SparkSession, challenge: str, answer: str, store: Store | None = None) -> bool:
    """Whether an answer equals the computed one but for case, brackets and separators; kept in the store if there is one."""
    if challenge not in CHALLENGES:
        raise KeyError(f"no challenge {challenge}")
    pair = spark.createDataFrame([(answer, CHALLENGES[challenge](spark))], "given string, wanted string")
    good = pair.select(normalize_answer(F.col("given")) == normalize_answer(F.col("wanted"))).first()[0]
    if store is not None:
        store.append("challenge_attempts", id=store.next_id("challenge_attempts"), challenge_id=challenge, answer=answer, correct=good, created_at=store._now())
    return good
