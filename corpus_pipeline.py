"""A corpus from raw documents to packed texts: five stages, each written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glossa.llm.exact_dedup import exact_dedup
from glossa.llm.jaccard_join import jaccard_components
from glossa.llm.mixing import mix
from glossa.llm.packing import pack_documents
from glossa.llm.staging import discard, scope, stage
from glossa.llm.toxicity import drop_toxic


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id."""
    return exact_dedup(docs, keep="max", carry=True)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five-word shingles, similarity 0.8 or more, by links) the document with the smallest doc_id."""
    return jaccard_components(docs, width=5, num=80, den=100, carry=True)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the leaves of the mix's tree draw their blocks, in the order of its shards."""
    return mix(docs, carry=True).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their texts in bins; copies of a document are never in one bin."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("ngram_jaccard_join", jaccard_stage),
    ("mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL can't express the toxicity stage's model.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage staged ends with it, its output when the next one is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, step in STAGES[:-1]:
        with scope() as staged:
            docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
            staged.remove(docs)
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
