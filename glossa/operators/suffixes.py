"""Suffix order and common prefixes of texts of any length, over many tasks.

Prefix doubling on rows: a suffix is ``doc, pos`` and the rank of its first h
characters; each round sorts the suffixes that share a rank by the rank that stands h
characters further on.  Sorting is by range, ranks are counted within partitions and
joined over their borders, so neither a text nor a group of like suffixes has to fit in
a task, and settled suffixes are not touched again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import dropped, staged

#: Characters in a number (21 bits each), and those that the first round sorts by.
PACKED, FIRST = 3, 6
#: Characters of a text that one row hands on.
CHUNK = 1 << 14

_ROW = "doc long, pos long, n long, r long, r2 long"
#: ``border`` is null but in a partition's last row, which tells its first and last row's doc, pos, r and r2, where the last row's groups began, and how many rows there are.
_RANKED = _ROW + ", part int, whole long, own long, single boolean, before long, common int, border array<long>"
_NAMES = [c.split()[0] for c in _RANKED.split(", ")]


def _chunks(docs: DataFrame) -> DataFrame:
    """Pieces of texts with the characters behind them that a first rank needs."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for at in range(0, len(text), CHUNK):
                    columns = [pa.array([x], pa.int64()) for x in (doc, at, len(text))]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([text[at : at + CHUNK + FIRST - 1]], pa.string())], ["doc", "at", "n", "piece"])

    return docs.select("doc", "text").mapInArrow(cut, "doc long, at long, n long, piece string").repartition("doc", "at")


def _suffixes(docs: DataFrame) -> DataFrame:
    """A row for each suffix; ``r`` and ``r2`` hold its first and next PACKED characters, zero where it has ended."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, at, n, piece in zip(*(c.to_pylist() for c in batch.columns)):
                here = min(CHUNK, n - at)
                codes = np.zeros(here + FIRST, np.int64)
                known = np.frombuffer(piece.encode("utf-32-le"), np.uint32)
                codes[: len(known)] = known + np.int64(1)
                packed = (codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]
                columns = [np.full(here, doc), np.arange(at, at + here), np.full(here, n), packed[:here], packed[PACKED : PACKED + here]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc", "pos", "n", "r", "r2"])

    return _chunks(docs).mapInArrow(spread, _ROW)


def _fields(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading characters that two numbers of PACKED characters share."""
    x = a ^ b
    return np.where(x == 0, 3, np.where(x < 1 << 21, 2, np.where(x < 1 << 42, 1, 0)))


def _both(r: np.ndarray, s: np.ndarray, r2: np.ndarray, s2: np.ndarray) -> np.ndarray:
    """The same of two numbers each."""
    return np.where(r != s, _fields(r, s), PACKED + _fields(r2, s2))


def _shared(a: Column, b: Column) -> Column:
    x = a.bitwiseXOR(b)
    return F.when(x == 0, 3).when(x < 1 << 21, 2).when(x < 1 << 42, 1).otherwise(0)


def _sorted_once(rows: DataFrame) -> DataFrame:
    """Rows in order with, counted within their partition, the first row of those alike in ``doc, r, r2`` (``whole``) and in ``doc, r`` (``own``).

    ``single`` tells that no neighbour is alike, ``before`` is the position in the row
    before where ``r2`` alone changes, and ``common`` how many packed characters a row
    shares with the row before of its text.
    """

    def table(columns: list[np.ndarray], single: np.ndarray, part: int) -> pa.RecordBatch:
        doc, pos, n, r, r2, whole, own, before, common = columns
        arrays = [*(pa.array(c, pa.int64()) for c in (doc, pos, n, r, r2)), pa.array(np.full(len(doc), part), pa.int32()), pa.array(whole, pa.int64()), pa.array(own, pa.int64()), pa.array(single)]
        arrays += [pa.array(before, pa.int64(), mask=before < 0), pa.array(common, pa.int32(), mask=common < 0), pa.nulls(len(doc), pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(arrays, _NAMES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, whole, own = TaskContext.get().partitionId(), 0, 0, 0
        first = last = held = held_new = None  # held: the last row so far, as only the next one tells whether it is alone
        for batch in batches:
            if not len(batch):
                continue
            doc, pos, n, r, r2 = (np.asarray(c) for c in batch.columns)
            here = [doc, pos, r, r2]
            if first is None:
                first = [int(c[0]) for c in here]
                last = [c[:1] for c in here]
            shifted = [np.concatenate([p, c[:-1]]) for p, c in zip(last, here)]  # the row before each
            new_doc = doc != shifted[0]
            new_doc[0] |= seen == 0
            new_own = new_doc | (r != shifted[2])
            new_whole = new_own | (r2 != shifted[3])
            index = np.arange(seen, seen + len(doc))
            wholes, owns = np.maximum.accumulate(np.where(new_whole, index, whole)), np.maximum.accumulate(np.where(new_own, index, own))
            before = np.where(new_whole & ~new_own, shifted[1], -1)
            common = np.where(new_whole & ~new_doc, _both(r, shifted[2], r2, shifted[3]), -1)
            seen, whole, own, last = seen + len(doc), int(wholes[-1]), int(owns[-1]), [c[-1:] for c in here]
            columns = [doc, pos, n, r, r2, wholes, owns, before, common]
            if held is not None:
                columns = [np.concatenate([h, c]) for h, c in zip(held, columns)]
                new_whole = np.concatenate([held_new, new_whole])
            yield table([c[:-1] for c in columns], new_whole[:-1] & new_whole[1:], part)
            held, held_new = [c[-1:] for c in columns], new_whole[-1:]
        if held is not None:
            yield table(held, held_new, part)
            empty = [pa.nulls(1, t) for t in [pa.int64()] * 5]
            border = pa.array([[*first, *(int(c[0]) for c in last), whole, own, seen]], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*empty, pa.array([part], pa.int32()), *(pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32())), border], _NAMES)

    order = ["doc", "r", "r2", "pos"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(count, _RANKED)


class _Round:
    """Ranks after a round: rows with their global ``rank`` and whether it is ``settled``, and the borders between ranks that the round made."""

    def __init__(self, rows: DataFrame, first: bool):
        self.table = staged(_sorted_once(rows), "suffix-round")
        parts = sorted((r["part"], r["border"]) for r in self.table.where("border is not null").select("part", "border").collect())  # one a task
        size = parts[-1][0] + 1 if parts else 1
        # By partition: rows before it, where the groups of its first row began, whether that group goes on from before, and where its last row's began and whether that goes on.
        offset, whole, own, goes_on, last_whole, followed = ([0] * size for _ in range(6))
        total, extra, was = 0, [], None
        for p, border in parts:
            doc, pos, r, r2, *_, last, last_own, rows_here = border
            offset[p], whole[p], own[p], last_whole[p] = total, total, total, last
            if was:
                q, (*_, was_doc, was_pos, was_r, was_r2, was_last, was_own, _) = was
                same_own = (was_doc, was_r) == (doc, r)
                if same_own:
                    own[p] = own[q] if was_own == 0 else offset[q] + was_own
                if same_own and was_r2 == r2:
                    whole[p] = whole[q] if was_last == 0 else offset[q] + was_last
                    goes_on[p], followed[q] = 1, 1
                elif first and was_doc == doc:
                    extra.append((total, doc, 0, pos, int(_both(*np.array([r, was_r, r2, was_r2])))))
                elif not first and same_own:
                    extra.append((r + total - own[p], doc, was_pos, pos, None))
            was, total = (p, border), total + rows_here
        at = lambda xs: F.get(F.lit(xs).cast("array<long>"), F.col("part"))
        start = lambda local, carried: F.when(F.col(local) == 0, at(carried)).otherwise(at(offset) + F.col(local))
        rank = start("whole", whole) if first else F.col("r") + start("whole", whole) - start("own", own)
        alone = F.col("single") & ~((F.col("whole") == 0) & (at(goes_on) == 1)) & ~((F.col("whole") == at(last_whole)) & (at(followed) == 1))
        ranked = self.table.where("border is null").withColumns({"rank": rank, "settled": alone})
        self.rows = ranked.select("doc", "pos", "n", "rank", "settled")
        self.codes = ranked.select("doc", "pos", "r", "r2")
        self.open = self.rows.where("not settled")
        within = ranked.where("common is not null" if first else "before is not null").select(F.col("rank").alias("x"), "doc", F.col("before").alias("i"), F.col("pos").alias("j"), "common")
        self.borders = within.union(rows.sparkSession.createDataFrame(extra, "x long, doc long, i long, j long, common int"))


def _common_prefixes(rounds: list[_Round]) -> tuple[DataFrame, list[DataFrame]]:
    """``x, lcp`` of each rank that doesn't begin a text, and the tables to drop afterwards.

    What a round has parted is alike for the width of the round before; what it shares
    beyond is added up from the widths below, largest first, then from single characters.
    """
    out, held = rounds[0].borders.select("x", F.col("common").cast("long").alias("lcp")), []
    width = lambda k: FIRST << k
    active = None

    def sides(pairs: DataFrame) -> DataFrame:
        return pairs.select("x", "doc", F.explode(F.array(F.struct(F.lit(0).alias("side"), (F.col("i") + F.col("l")).alias("pos")), F.struct(F.lit(1).alias("side"), (F.col("j") + F.col("l")).alias("pos")))).alias("s")).select("x", "doc", "s.*")

    for k in range(len(rounds) - 1, 0, -1):
        more = rounds[k].borders.select("x", "doc", "i", "j", F.lit(width(k - 1)).cast("long").alias("l"))
        active = more if active is None else active.union(more)
        if k == 1:
            break
        level = rounds[k - 2]
        active = staged(active, "suffix-pairs")
        held.append(active)
        ranks = level.open.select("doc", "pos", "rank").join(sides(active), ["doc", "pos"])
        alike = ranks.groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("low"), F.max("rank").alias("high")).where("n = 2 and low = high").select("x", F.lit(width(k - 2)).cast("long").alias("more"))
        active = active.join(alike, "x", "left").withColumn("l", F.col("l") + F.coalesce("more", F.lit(0))).drop("more")
    if active is not None:
        active = staged(active, "suffix-pairs")
        held.append(active)
        found = rounds[0].codes.join(sides(active), ["doc", "pos"])
        # Where a suffix has ended there is no row, and its characters count as zero.
        side = lambda s, c: F.coalesce(F.max(F.when(F.col("side") == s, F.col(c))), F.lit(0))
        codes = found.groupBy("x").agg(*[side(s, c).alias(f"{c}_{s}") for s in (0, 1) for c in ("r", "r2")])
        rest = _shared(F.col("r_0"), F.col("r_1"))
        more = F.when(rest == PACKED, PACKED + _shared(F.col("r2_0"), F.col("r2_1"))).otherwise(rest)
        out = out.union(active.select("x", "l").join(codes.select("x", more.alias("more")), "x", "left").select("x", F.col("l") + F.coalesce("more", F.lit(0))))
    return out, held


def long_suffix_array(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per suffix: ``key, rank, pos, lcp`` as ints; keys must be unique; texts that are null or empty have no suffixes."""
    docs = staged(df.select(F.col(key), F.col(text).alias("text")).where(F.length("text") > 0).withColumn("doc", F.monotonically_increasing_id()), "suffix-texts")
    rounds, width = [_Round(_suffixes(docs), True)], FIRST
    while not rounds[-1].open.isEmpty():
        # Ranks hold where they were settled last.
        known = rounds[-1].open.select("doc", "pos", "rank")
        for done in rounds:
            known = known.union(done.rows.where("settled").select("doc", "pos", "rank"))
        waiting = rounds[-1].open.select("doc", F.col("pos").alias("from"), "n", F.col("rank").alias("r"), (F.col("pos") + width).alias("pos"))
        further = known.join(waiting, ["doc", "pos"]).select("doc", F.col("from").alias("pos"), "n", "r", F.col("rank").alias("r2"))
        ended = waiting.where("pos = n").select("doc", F.col("from").alias("pos"), "n", "r", F.lit(-1).cast("long").alias("r2"))
        rounds.append(_Round(further.union(ended), False))
        width *= 2
    order = rounds[0].rows.where("settled")
    for done in rounds[1:]:
        order = order.union(done.rows.where("settled"))
    common, held = _common_prefixes(rounds)
    begin = rounds[0].rows.groupBy("doc").agg(F.min("rank").alias("begin"))
    out = order.join(common.withColumnRenamed("x", "rank"), "rank", "left").join(begin, "doc").join(docs.select("doc", key), "doc")
    out = staged(out.select(key, (F.col("rank") - F.col("begin")).cast("int").alias("rank"), F.col("pos").cast("int").alias("pos"), F.coalesce("lcp", F.lit(0)).cast("int").alias("lcp")), "suffix-array")
    dropped(docs, *held, *(r.table for r in rounds))
    return out
