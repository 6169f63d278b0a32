"""Vector code compression: each part of a vector is named by the nearest entry of a codebook.

The search for a nearest entry starts at the entry of the round before.  With d the
distance to it, an entry that is as near has at most 2 d to the starting entry, so only
that much of the start's list of other entries, sorted by distance, is scanned.  Squared
distances are integers, so the radius, the comparison and the ties are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import discard, stage

#: Components of this size or more have no exact 64-bit distance; their vectors count as not finite.
MOST = 1 << 16
#: Labels with more than 1 / HOT_LABELS of all rows, of which there are fewer than HOT_LABELS, get their sums by broadcast.
HOT_LABELS = 1 << 15

_ROW = "vec_id {0}, label {1}, parts binary, entries binary, sums array<long>"


def cuts(width: int, parts: int) -> list[tuple[int, int]]:
    """Where each part of a vector begins and ends; equal parts where ``parts`` divides the width."""
    edges = [width * p // parts for p in range(parts + 1)]
    return list(zip(edges[:-1], edges[1:]))


def neighbour_lists(book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each entry the other entries by distance, ties by index, and their squared distances."""
    apart = ((book[:, None] - book[None]) ** 2).sum(2)
    k = len(book)
    order = np.array([[j for j in np.argsort(apart[a], kind="stable") if j != a] for a in range(k)], np.int64).reshape(k, k - 1)
    return order, np.take_along_axis(apart, order, 1)


def nearest(x: np.ndarray, book: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest entry, ties to the lower index, and the squared distance; ``start`` is where each search begins."""
    order, apart = neighbour_lists(book)
    best, least = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    for a in np.unique(start):
        rows = np.flatnonzero(start == a)
        low = ((x[rows] - book[a]) ** 2).sum(1)
        reach = np.searchsorted(apart[a], 4 * low, "right")  # how far each row reads the list
        by = np.argsort(-reach, kind="stable")
        rows, low, reach = rows[by], low[by], reach[by]
        mine, at = x[rows], np.full(len(rows), a)
        for s in range(int(reach[0])):
            m = int(np.searchsorted(-reach, -s, "left"))  # rows that read on
            j = order[a, s]
            d = ((mine[:m] - book[j]) ** 2).sum(1)
            better = (d < low[:m]) | ((d == low[:m]) & (j < at[:m]))
            low[:m][better], at[:m][better] = d[better], j
        best[rows], least[rows] = at, low
    return best, least


def _assigned(x: np.ndarray, books: list[np.ndarray], spans: list[tuple[int, int]], entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of all parts and the distances summed over parts."""
    out, error = np.empty_like(entries), np.zeros(len(x), np.int64)
    for p, (a, b) in enumerate(spans):
        found, d = nearest(x[:, a:b], books[p], entries[:, p].astype(np.int64))
        out[:, p] = found
        error += d
    return out, error


def _round(rows: DataFrame, books: list[np.ndarray], spans: list[tuple[int, int]], schema: str) -> DataFrame:
    """Rows with their entries under ``books``; at the end of each task a row with the sums of parts and the counts by entry."""
    k, width = len(books[0]), spans[-1][1]
    names = ["vec_id", "label", "parts", "entries", "sums"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, width), np.int64), np.zeros((k, len(spans)), np.int64)
        kinds = None
        for batch in batches:
            kinds = [batch.schema.field(i).type for i in (0, 1)]
            n = len(batch)
            x = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int32).reshape(n, width).astype(np.int64)
            before = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(n, len(spans))
            entries, _ = _assigned(x, books, spans, before)
            for p, (a, b) in enumerate(spans):
                counts[:, p] += np.bincount(entries[:, p], minlength=k)
                for e in np.unique(entries[:, p]):
                    sums[e, a:b] += x[entries[:, p] == e, a:b].sum(0)
            packed = pa.array([r.tobytes() for r in entries], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), packed, pa.nulls(n, pa.list_(pa.int64()))], names)
        if kinds:
            total = np.concatenate([sums.ravel(), counts.ravel()]).tolist()
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kinds[0]), pa.nulls(1, kinds[1]), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([total], pa.list_(pa.int64()))], names)

    return rows.select("vec_id", "label", "parts", "entries").mapInArrow(run, schema)


def _moved(done: DataFrame, books: list[np.ndarray], spans: list[tuple[int, int]]) -> list[np.ndarray]:
    """Each entry replaced by the floored mean of its parts; the tasks' sums are added by Spark, one number a component comes here."""
    k, width = len(books[0]), spans[-1][1]
    added = done.where("sums is not null").select(F.posexplode("sums").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    flat = np.zeros(k * (width + len(spans)), np.int64)
    for r in added.collect():
        flat[r["i"]] = r["x"]
    sums, counts = flat[: k * width].reshape(k, width), flat[k * width :].reshape(k, len(spans))
    out = []
    for p, (a, b) in enumerate(spans):
        used = counts[:, p] > 0
        book = books[p].copy()
        book[used] = sums[used, a:b] // counts[used, p, None]
        out.append(book)
    return out


def compress(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of each kept row.

    Components become ``floor(scale * x)``.  Codebooks start as the parts of the rows
    with the smallest keys (null last, ties by vector; fewer rows give fewer entries) and
    are moved ``rounds`` times.  Dropped are rows whose vector is null, holds a null or
    non-finite component or one of MOST or more, or has another length than the first
    kept one's.  Repeated rows count and are coded each; equal labels (nulls are equal)
    share ``label_error``; an empty table gives an empty result; other columns are ignored.

    Each round is one pass that writes rows with their entries to the shared folder, from
    which the next starts; only sums by entry come to the driver.
    """
    if not 1 <= entries <= 256:
        raise ValueError("entries must be from 1 to 256")
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")]
    rows = rows.where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < MOST)))
    order = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    first = rows.orderBy(*order).limit(1).collect()
    if not first:
        return spark.createDataFrame([], f"vec_id {kinds[0]}, code string, error long, label_error long, codebooks_sha256 string")
    width = len(first[0]["v"])
    rows = rows.where(F.size("v") == width)
    seeds = np.array([r["v"] for r in rows.orderBy(*order).limit(entries).collect()], float).reshape(-1, width)
    seeds = np.floor(seeds * scale).astype(np.int64)
    spans = cuts(width, parts)
    books = [seeds[:, a:b] for a, b in spans]

    def floored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            x = np.floor(batch.column(2).flatten().to_numpy().reshape(n, width) * scale).astype(np.int32)
            packed = pa.array([r.tobytes() for r in x], pa.binary())
            start = pa.array([bytes(len(spans))] * n, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed, start], ["vec_id", "label", "parts", "entries"])

    schema = _ROW.format(*kinds)
    done = None
    for _ in range(rounds):
        source = done.where("sums is null") if done is not None else rows.mapInArrow(floored, schema.rsplit(",", 1)[0])
        new = stage(_round(source, books, spans, schema), "vector-codes")
        books = _moved(new, books, spans)
        if done is not None:
            discard(done)
        done = new
    source = done.where("sums is null") if done is not None else rows.mapInArrow(floored, schema.rsplit(",", 1)[0])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            x = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int32).reshape(n, width).astype(np.int64)
            before = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(n, len(spans))
            found, error = _assigned(x, books, spans, before)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes().hex() for r in found], pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    out = stage(source.select("vec_id", "label", "parts", "entries").mapInArrow(coded, f"vec_id {kinds[0]}, label {kinds[1]}, code string, error long"), "vector-errors")
    if done is not None:
        discard(done)
    digest = hashlib.sha256(",".join(str(int(c)) for book in books for entry in book for c in entry).encode()).hexdigest()
    return _with_label_errors(out).withColumn("codebooks_sha256", F.lit(digest))


def _with_label_errors(rows: DataFrame) -> DataFrame:
    """``vec_id, code, error`` and the error summed over the row's label; a frequent label meets its rows by broadcast, so no task gets them all."""
    sums = stage(rows.groupBy("label").agg(F.sum("error").alias("total"), F.count(F.lit(1)).alias("n")), "vector-labels")
    bar = sums.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"] // HOT_LABELS
    hot = sums.where(F.col("n") > bar).select(F.col("label").alias("__hot"), F.col("total").alias("__total"))
    rare = sums.where(F.col("n") <= bar).select(F.col("label").alias("__rare"), F.lit(0).alias("__none"), "total")
    met = rows.join(F.broadcast(hot), F.col("label").eqNullSafe(F.col("__hot")), "left")
    # A row that has met its label goes on under a number that no rare label has, spread by key.
    met = met.withColumn("__part", F.when(F.col("__total").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64("vec_id", "code"), F.lit(256)).cast("int")))
    out = met.join(rare, F.col("label").eqNullSafe(F.col("__rare")) & (F.col("__part") == F.col("__none")), "left")
    return out.select("vec_id", "code", "error", F.coalesce("__total", "total").alias("label_error"))
