"""Occurrences of the patterns of a table, however many, in texts.

Windows of a text are named by rolling fingerprints.  A bitmap of bounded size tells
which windows may begin a pattern and another which may be one; what is left, hardly
more than the true occurrences, is joined with the patterns by their text, so the result
is exact whatever the fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap for each pattern, and of the smallest and largest one (8 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 26
#: Positions of a text that are looked at together.
BLOCK = 1 << 17

# An odd base and its inverse modulo 2 ** 64.
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)


class Windows:
    """Fingerprints of the windows of one text, each found from two running sums."""

    def __init__(self, text: str, powers: tuple[np.ndarray, np.ndarray]):
        codes = _codes(text)
        self.n, self.inverse = len(codes), powers[1]
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(codes * powers[0][: self.n], dtype=np.uint64, out=self.sums[1:])

    def at(self, places: np.ndarray, length: int) -> np.ndarray:
        x = (self.sums[places + length] - self.sums[places]) * self.inverse[places]
        x = (x ^ (x >> np.uint64(32))) * _MIX
        return x ^ (x >> np.uint64(29))


def _powers_up_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(_BASE, n), _powers(_INVERSE, n)


def _level(length: int) -> int:
    """The largest power of two that isn't longer: a pattern's beginning of that length is looked for first."""
    return 1 << (length.bit_length() - 1)


def _bitmap(marks: DataFrame, which: str, bits: int) -> np.ndarray:
    """Bits of a column of fingerprints; words are put together by Spark, MOST_BITS / 64 numbers at most come here."""
    word, bit = F.shiftrightunsigned(F.col(which).bitwiseAND(F.lit(bits - 1)), 6), F.col(which).bitwiseAND(F.lit(63)).cast("int")
    found = marks.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits")).toArrow()
    out = np.zeros(bits >> 6, np.uint64)
    out[np.asarray(found["word"], np.int64)] = np.asarray(found["bits"]).astype(np.int64).view(np.uint64)
    return out


def _known(bitmap: np.ndarray, prints: np.ndarray) -> np.ndarray:
    at = prints & np.uint64((len(bitmap) << 6) - 1)
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def find_dictionary(df: DataFrame, patterns: DataFrame, text: str = "text", key: str = "doc_id", pattern: str = "pattern") -> DataFrame:
    """``key, pos`` and the columns of ``patterns``: one row per occurrence of a pattern, overlapping ones included.

    Null and empty patterns are never found, repeated ones as often as they are rows; a
    null text has no occurrences; keys needn't be unique.
    """
    spark = df.sparkSession
    wanted = patterns.where(F.col(pattern) != "")

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for p in batch.column(0).to_pylist():
                w = Windows(p, _powers_up_to(len(p)))
                rows.append((len(p), int(w.at(np.zeros(1, np.int64), _level(len(p)))[0].view(np.int64)), int(w.at(np.zeros(1, np.int64), len(p))[0].view(np.int64))))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["length", "begin", "whole"])

    marks = wanted.select(F.col(pattern).alias("p")).distinct().mapInArrow(prints, "length long, begin long, whole long")
    # One number for each length that occurs.
    lengths = {r["length"]: r["n"] for r in marks.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not lengths:
        return df.select(key, F.lit(0).alias("pos"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in patterns.schema]).where(F.lit(False))
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * sum(lengths.values())).bit_length()))
    shared = spark.sparkContext.broadcast((_bitmap(marks, "begin", bits), _bitmap(marks, "whole", bits)))
    levels: dict[int, list[int]] = {}
    for n in sorted(lengths):
        levels.setdefault(_level(n), []).append(n)
    longest = max(lengths)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins, wholes = shared.value
        powers = _powers_up_to(BLOCK + longest)
        for batch in batches:
            for r, t in enumerate(batch.column(1).to_pylist()):
                for start in range(0, len(t or ""), BLOCK):
                    piece = t[start : start + BLOCK + longest - 1]
                    windows, own = Windows(piece, powers), min(BLOCK, len(t) - start)
                    places, found = [], []
                    for level, sizes in levels.items():
                        most = min(own, windows.n - level + 1)
                        if most <= 0:
                            continue
                        at = np.arange(most)
                        at = at[_known(begins, windows.at(at, level))]
                        for n in sizes:
                            here = at[at + n <= windows.n]
                            here = here[_known(wholes, windows.at(here, n))]
                            places += here.tolist()
                            found += [piece[i : i + n] for i in here.tolist()]
                    if places:
                        keys = batch.column(0).take(pa.array(np.full(len(places), r), pa.int32()))
                        yield pa.RecordBatch.from_arrays([keys, pa.array(np.array(places) + start, pa.int32()), pa.array(found, pa.string())], ["k", "pos", "p"])

    rows = df.select(F.col(key).alias("k"), F.col(text).alias("text"))
    likely = rows.mapInArrow(scan, f"k {rows.schema['k'].dataType.simpleString()}, pos int, p string")
    hits = likely.join(wanted, F.col("p") == wanted[pattern])
    return hits.select(F.col("k").alias(key), "pos", *[wanted[c] for c in patterns.columns])
