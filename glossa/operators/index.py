"""An inverted index that is written once and asked many times.

A term's postings are cut into blocks of CELL neighbouring document ids, so no block
grows with the corpus and blocks of one cell, whatever their terms, can be merged on
their own.  A block has its postings as offsets to the cell's first id, with their
counts and all their places, and the largest count as a bound; postings with more than
MOST_PLACES places together are several blocks.  A file has the blocks of some
neighbouring cells, sorted by term, so a query reads the row groups of its terms only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .analytics import inverted_index, query_terms

#: Document ids of a cell.
CELL = 4096
#: Places of a block at most, but for those of its last posting.
MOST_PLACES = 1 << 17
#: Cells that are scored first to learn what a further cell has to reach.
FIRST_CELLS = 64
#: Rows of a row group are few, so that a term's blocks are found by the group's least and largest term.
GROUP_BYTES = 4 << 20
#: Files that an index has at most.
MOST_FILES = 512


@dataclass(frozen=True)
class Index:
    """A written index: ``blocks`` (term, cell, n, top, total, offsets, counts, positions) and the number of documents that aren't blank."""

    blocks: DataFrame
    documents: int
    key: str

    def of(self, terms: list[str]) -> DataFrame:
        """Blocks of some terms; the filter reaches the scan."""
        return self.blocks.where(F.col("term").isin(terms or [""]))


def _packed(postings: DataFrame) -> DataFrame:
    """Blocks out of ``term, cell, offset, tf, positions``, whose partitions are sorted and hold a cell's postings together."""

    def blocks(rows: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        term, cell, offset, tf, positions = rows.columns
        ends = np.append(starts, len(rows))
        several = lambda c: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), c)
        first, counts = pa.array(starts), np.asarray(tf)
        columns = [term.take(first), cell.take(first), pa.array(np.diff(ends)), pa.array(np.maximum.reduceat(counts, starts)), pa.array(np.add.reduceat(counts, starts)), several(offset), several(tf), several(positions)]
        return pa.RecordBatch.from_arrays(columns, ["term", "cell", "n", "top", "total", "offsets", "counts", "positions"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = batch if held is None else pa.concat_batches([held, batch])
            if not len(rows):
                continue
            new = [np.asarray(pc.not_equal(c[1:], c[:-1])) for c in rows.columns[:2]]
            starts = np.append(0, np.flatnonzero(new[0] | new[1]) + 1)
            # A block also ends where its places are enough.
            before = np.cumsum(rows.column(3)) - np.asarray(rows.column(3))
            full = (before - np.repeat(before[starts], np.diff(np.append(starts, len(rows))))) // MOST_PLACES
            starts = np.union1d(starts, np.flatnonzero(full[1:] != full[:-1]) + 1)
            held = rows.slice(starts[-1])  # the last block may go on
            if len(starts) > 1:
                yield blocks(rows.slice(0, starts[-1]), starts[:-1])
        if held is not None:
            yield blocks(held, np.zeros(1, np.int64))

    return postings.mapInArrow(run, "term string, cell long, n long, top long, total long, offsets array<int>, counts array<long>, positions array<array<int>>")


def build_index(df: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> Index:
    """Write the index of ``df``, whose keys are whole numbers and unique, to ``path`` and open it.

    Documents without terms have no postings; rows with a null key or text are left out.
    Every place of a term is kept.  Documents are dealt to files by cells, so that postings need no shuffle of their own.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("__id"), F.col(text).alias("__text"))
    cell = F.floor(F.col("__id") / CELL)
    cells = rows.select(cell.alias("cell")).distinct().count()
    dealt = rows.repartitionByRange(max(1, min(cells, MOST_FILES)), cell)
    found = inverted_index(dealt, "__text", "__id", most_positions=None).select("term", cell.alias("cell"), (F.col("__id") - cell * CELL).cast("int").alias("offset"), "tf", "positions")
    _packed(found.sortWithinPartitions("term", "cell", "offset")).write.option("parquet.block.size", GROUP_BYTES).parquet(f"{path}/blocks")
    rows.where(F.trim("__text") != "").agg(F.count(F.lit(1)).alias("documents"), F.lit(key).alias("key")).write.parquet(f"{path}/about")
    return open_index(df.sparkSession, path)


def open_index(spark: SparkSession, path: str) -> Index:
    about = spark.read.parquet(f"{path}/about").first()
    return Index(spark.read.parquet(f"{path}/blocks"), about["documents"], about["key"])


def _ids(offset: Column) -> Column:
    return F.col("cell") * CELL + offset


def and_query(index: Index, query: str) -> DataFrame:
    """``key`` of the documents that have all terms of the query; none if it has no terms or one isn't indexed.

    Cells without the rarest term are left out before any list is read further; within a
    cell a term's blocks are one list, and lists are intersected shortest first.
    """
    wanted = query_terms(query)
    blocks = index.of(wanted)
    sizes = {r["term"]: r["n"] for r in blocks.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a number a term
    if not wanted or len(sizes) < len(wanted):
        return index.blocks.where(F.lit(False)).select(_ids(F.lit(0)).alias(index.key))
    rarest = min(wanted, key=lambda t: (sizes[t], wanted.index(t)))
    cells = index.of([rarest]).select("cell")
    rows = blocks.select("cell", F.struct("term", "offsets").alias("list")).join(cells, "cell", "left_semi")
    of = lambda term: F.flatten(F.transform(F.filter("lists", lambda x: x["term"] == term), lambda x: x["offsets"]))
    whole = rows.groupBy("cell").agg(F.collect_list("list").alias("lists")).select("cell", F.transform(F.array(*[F.lit(w) for w in wanted]), of).alias("lists"))
    by_size = F.array_sort(F.transform("lists", lambda x: F.struct(F.size(x).alias("n"), x.alias("offsets"))))
    merged = whole.where(F.forall("lists", lambda x: F.size(x) > 0)).select("cell", by_size.alias("lists"))
    both = F.aggregate(F.slice("lists", 2, len(wanted)), F.get("lists", F.lit(0))["offsets"], lambda got, x: F.when(F.size(got) == 0, got).otherwise(F.array_intersect(got, x["offsets"])))
    return merged.select("cell", F.explode(both).alias("offset")).select(_ids(F.col("offset")).alias(index.key))


def _scored(blocks: DataFrame, wanted: list[str], key: str) -> DataFrame:
    place = F.array_position(F.array(*[F.lit(w) for w in wanted or [""]]), F.col("term")).cast("int")
    hits = blocks.select("cell", place.alias("place"), "term", F.inline(F.arrays_zip("offsets", "counts")))
    return hits.groupBy(_ids(F.col("offsets")).alias(key)).agg(F.count(F.lit(1)).alias("matched"), F.sum("counts").alias("score"), F.min("place").alias("first"), F.array_sort(F.collect_list(F.struct("place", "term"))).alias("terms"))


def or_query(index: Index, query: str, limit: int | None = 50) -> DataFrame:
    """``rank, key, matched, score, terms``: by number of terms, then by their total count, then by first term and key.

    A cell's documents have at most as many terms as the cell has blocks, and at most
    the sum of their largest counts.  The most promising cells are scored first; of the
    others only those are read whose bounds reach the last place.
    """
    wanted = query_terms(query)
    blocks = index.of(wanted)
    order = [F.desc("matched"), F.desc("score"), F.col("first"), F.col(index.key)]
    if limit is not None:
        bounds = blocks.groupBy("cell").agg(F.count(F.lit(1)).alias("matched"), F.sum("top").alias("score"))
        first = bounds.orderBy(F.desc("matched"), F.desc("score"), "cell").limit(FIRST_CELLS).select("cell")
        best = _scored(blocks.join(first, "cell", "left_semi"), wanted, index.key).orderBy(*order).limit(limit).select("matched", "score").collect()
        if len(best) == limit:
            least = best[-1]
            reach = (F.col("matched") > least["matched"]) | ((F.col("matched") == least["matched"]) & (F.col("score") >= least["score"]))
            blocks = blocks.join(bounds.where(reach).select("cell"), "cell", "left_semi")
    found = _scored(blocks, wanted, index.key)
    if limit is not None:
        found = found.orderBy(*order).limit(limit)
    return found.select(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).alias("rank"), index.key, "matched", "score", F.col("terms.term").alias("terms"))


def query_postings(index: Index, query: str) -> DataFrame:
    """``term, key, tf, positions`` of the query's terms."""
    rows = index.of(query_terms(query)).select("term", "cell", F.inline(F.arrays_zip("offsets", "counts", "positions")))
    return rows.select("term", _ids(F.col("offsets")).alias(index.key), F.col("counts").alias("tf"), "positions")


def index_stats(index: Index) -> DataFrame:
    """One row: ``documents, terms, postings``, from the blocks' headers."""
    return index.blocks.agg(F.countDistinct("term").alias("terms"), F.coalesce(F.sum("n"), F.lit(0)).alias("postings")).select(F.lit(index.documents).cast("long").alias("documents"), "terms", "postings")


def top_terms(index: Index, limit: int = 20) -> DataFrame:
    """``rank, term, df, totalTf`` by document frequency, ties by first appearance; the headers' sums, and the first posting of a term's first block."""
    first = F.struct(_ids(F.get("offsets", F.lit(0))).alias("id"), F.get(F.get("positions", F.lit(0)), F.lit(0)).alias("pos"))
    per_term = index.blocks.groupBy("term").agg(F.sum("n").alias("df"), F.sum("total").alias("totalTf"), F.min(first).alias("first"))
    order = [F.desc("df"), F.col("first")]
    top = per_term.orderBy(*order).limit(limit)
    return top.select(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).alias("rank"), "term", "df", "totalTf")
