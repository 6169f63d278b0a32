"""Sharding by sampled splitters.

The key of a record is a digest of its text, so equal texts have one key.  A
sample of keys drawn with probability in proportion to size gives quantile
boundaries for many more ranges than shards, and the exact size of each range is
then measured.  A range that alone exceeds a shard's fair share is subdivided: a key
that does so by itself becomes ranges of its own, split by a hash of the identifier,
and what lies beside it is split by key, so that equal texts stay together.  The
largest pieces go first, each to the shard that is least full.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import fresh, stage

#: Key ranges; bounds every table of ranges and what the driver sees of them.
RANGES = 1024
#: Parts of a range, by a hash of the identifier; a part is the unit of numbering.
PARTS = 64
#: Keys of the size-weighted sample that a range has, on average.
SAMPLE = 32


def shard_documents(
    docs: DataFrame, shards: int = 16, text: str = "text", key: str = "doc_id", ranges: int = RANGES, parts: int = PARTS, carry: bool = False
) -> DataFrame:
    """One row per input row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    The law is ``bytes``: shards come out near equal in size, a size being the
    UTF-8 bytes of the text (null: none) plus 1.  Equal texts share a shard unless
    their group alone exceeds a shard's fair share; such a group, and no other, is split
    by a hash of the key.  A group is thus never more than a fair share: where groups just
    below it don't fit the shards (17 like ones and 16 shards), a shard holds up to a fair
    share more than others.  Slots number each shard's rows from 0 without gaps; repeated rows
    get slots of their own.  A null key is a key like any other.  An empty table
    gives an empty result; columns besides text and key are ignored.  With ``carry`` the
    columns of ``docs`` are returned, then ``shard`` and ``slot`` under names that clash with none.
    """
    spark = docs.sparkSession
    data = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    rows = docs.select(
        F.col(key).alias("id"),
        (F.length(data).cast("long") + 1).alias("size"),
        F.crc32(data).alias("crc"),
        F.xxhash64(data).alias("hash"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []),
    ).withColumn("part", F.pmod(F.xxhash64(F.lit(17), "id"), F.lit(parts)).cast("int"))
    keys = stage(rows.drop("row"), "shard-keys")
    total = keys.agg(F.sum("size")).first()[0]
    if total is None:
        return _result(docs, rows.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")}), carry)

    # A record of size s is drawn with probability min(1, s * SAMPLE * ranges / total), by a hash and so the same on a rerun.
    draw = F.pmod(F.xxhash64(F.lit(29), "id", "hash"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chance = F.col("size") * F.lit(float(SAMPLE * ranges) / total)
    sample = keys.where(draw < chance).select("hash", F.greatest(F.lit(1.0), chance).alias("weight"))
    bounds = _quantiles(sample, ranges)
    fair = total / shards
    in_range = _range_of(F.col("hash"), bounds)
    sizes = keys.groupBy(in_range.alias("range")).agg(F.sum("size").alias("bytes"))
    over = sorted(r["range"] for r in sizes.where(F.col("bytes") > fair).collect())  # less than the shards
    heavy: list[int] = []
    if over:
        beside = keys.where(in_range.isin(over)).groupBy("hash").agg(F.sum("size").alias("bytes"))
        heavy = sorted(r["hash"] for r in beside.where(F.col("bytes") > fair).collect())  # less than the shards

    def placed(df: DataFrame) -> DataFrame:
        """``range, part``: a heavy key's ranges come after the others, an overfull range's parts are by key and then by identifier."""
        df = df.withColumn("range", in_range)
        own = F.array_position(F.array(*[F.lit(h) for h in heavy]) if heavy else F.array().cast("array<long>"), F.col("hash")).cast("int")
        by_key = F.pmod(F.xxhash64(F.lit(19), "hash"), F.lit(parts)).cast("int") * parts + F.col("part")
        is_over = F.col("range").isin(over) if over else F.lit(False)
        return df.withColumns({"range": F.when(own > 0, own + ranges - 1).otherwise(F.col("range")), "part": F.when((own == 0) & is_over, by_key).otherwise(F.col("part"))})

    held = placed(keys).groupBy("range", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).collect()
    # At most (ranges + shards * parts) * parts rows of four numbers.
    place = _assign([(r["range"], r["part"], r["n"], r["bytes"]) for r in held], shards, set(over), ranges, parts)
    table = spark.createDataFrame(place, "range int, part int, shard int, base long")
    within = Window.partitionBy("range", "part").orderBy("hash", "id", "size")
    numbered = placed(rows if carry else keys).withColumn("place", F.row_number().over(within)).join(F.broadcast(table), ["range", "part"])
    return _result(docs, numbered.withColumn("slot", F.col("base") + F.col("place") - 1), carry)


def _result(docs: DataFrame, df: DataFrame, carry: bool) -> DataFrame:
    if carry:
        shard, slot = fresh(docs, "shard", "slot")
        return df.select("row.*", F.col("shard").cast("int").alias(shard), F.col("slot").cast("long").alias(slot))
    return df.select(
        F.col("id").alias("doc_id"),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _quantiles(sample: DataFrame, ranges: int) -> list[int]:
    """At most ``ranges - 1`` distinct upper boundaries of equal weight; the sample's size has a bound whatever the input's."""
    drawn = sorted((r["hash"], r["weight"]) for r in sample.collect())
    step = sum(w for _, w in drawn) / ranges if drawn else 1.0
    bounds, run = [], 0.0
    for value, weight in drawn:
        run += weight
        if run >= step * (len(bounds) + 1) and len(bounds) < ranges - 1 and (not bounds or value > bounds[-1]):
            bounds.append(value)
    return bounds


def _range_of(value: Column, bounds: list[int]) -> Column:
    """Index of the first boundary that is not below ``value``, by binary search in an expression tree."""
    if not bounds:
        return F.lit(0)
    edges = F.array(*[F.lit(b) for b in bounds])
    widths = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    # Each step tries to move the lower end on; beyond the array get() is null, and the end stays.
    return F.aggregate(widths, F.lit(0), lambda low, w: F.when(F.get(edges, low + w - 1) < value, low + w).otherwise(low))


def _assign(held: list[tuple], shards: int, over: set[int], ranges: int, parts: int) -> list[tuple]:
    """(range, part, shard, first slot) of each part, largest units first to the least full shard."""

    def unit_of(r: int, p: int) -> tuple[int, int]:
        return (r, p) if r >= ranges else (r, p // parts) if r in over else (r, -1)

    units: dict[tuple[int, int], int] = {}
    for r, p, _, b in held:
        units[unit_of(r, p)] = units.get(unit_of(r, p), 0) + b
    load = [(0, s) for s in range(shards)]
    shard = {}
    for unit, b in sorted(units.items(), key=lambda x: (-x[1], x[0])):
        full, s = heapq.heappop(load)
        shard[unit] = s
        heapq.heappush(load, (full + b, s))
    out, base = [], [0] * shards
    for r, p, n, _ in sorted(held):
        s = shard[unit_of(r, p)]
        out.append((r, p, s, base[s]))
        base[s] += n
    return out


def write_shards(docs: DataFrame, path: str, shards: int = 16, text: str = "text", key: str = "doc_id") -> None:
    """Write the documents with their shard and slot, one folder a shard, the rows of a file in slot order.

    All columns of ``docs`` are kept; where it has a ``shard`` or ``slot`` of its own, the folders and slots take another name.
    """
    out = shard_documents(docs, shards, text, key, carry=True)
    shard, slot = out.columns[-2:]
    out.sortWithinPartitions(shard, slot).write.mode("overwrite").partitionBy(shard).parquet(path)
