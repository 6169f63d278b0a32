"""Best-fit packing of documents into bins, with conflicts.

Documents are cut into pieces that a bin can hold and dealt by a hash into groups of
bounded size; each group is packed on its own, largest items first.  Open bins are kept
in order of what is left in them and carry two bitmaps: which sources fill which of
their slots, and which clusters of duplicates are present.  The search starts at the
tightest bin that the item fits and goes on to the next until one is compatible; only
then is a bin opened.  Pieces carry their text into their bins.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .mixing import WORD, word_count
from .staging import stage

#: Words that a bin holds.
CAPACITY = 2048
#: Documents of one source that a bin may hold.
SOURCE_SLOTS = 4
#: Items of a group, about; a group is packed by one task.
GROUP = 4096
#: Rows alike in key and text that may meet in a group; where there are more they are numbered and dealt to all groups.
ALIKE = 16


def duplicate_cluster(text: Column) -> Column:
    """A digest that texts share which differ in A-Z, a-z and white space alone."""
    return F.xxhash64(F.lower(F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))))


def pack_documents(
    docs: DataFrame,
    capacity: int = CAPACITY,
    text: str = "text",
    key: str = "doc_id",
    source: str = "source",
    cluster: Column | DataFrame | None = None,
    slots: int = SOURCE_SLOTS,
    group: int = GROUP,
) -> DataFrame:
    """One row per piece of a document: ``doc_id, piece, piece_start, size, bin, position, bin_offset, bin_fill, text``.

    Sizes are words.  A document longer than ``capacity`` is cut into pieces of
    ``capacity`` words and a rest, each with the blanks after its words, so that its
    pieces in order are its text.  A bin holds at most ``capacity`` words, at most
    ``slots`` pieces of one source and no two of one cluster.  ``cluster`` is a column of
    ``docs``, or a table of a key and a cluster such as a similarity join's components
    (of a key's clusters the least counts), by default texts equal but for case and white
    space.  Null sources and null clusters conflict with nothing.  Empty and null texts
    are pieces of 0 words; rows that repeat count each; an empty table gives an empty
    result; other columns are ignored.  ``bin_offset`` is the word of its bin at which a
    piece starts.  Equal input gives equal bins whatever its partitions.
    """
    joined = isinstance(cluster, DataFrame)
    own = docs.select(
        F.col(key).alias("id"),
        F.col(source).cast("string").alias("source"),
        (F.lit(None) if joined else duplicate_cluster(F.col(text)) if cluster is None else cluster).cast("long").alias("cluster"),
        F.col(text).alias("text"),
        F.xxhash64(text).alias("digest"),
    )
    if joined:
        of, mark = (F.col(f"`{c}`") for c in cluster.columns[:2])
        table = cluster.groupBy(of.alias("of")).agg(F.min(mark).cast("long").alias("cluster"))
        own = own.drop("cluster").join(table, F.col("id") == F.col("of"), "left").drop("of")
    # Very many rows alike in key and text are told apart by a number, so that they don't all meet in one group.
    repeated = own.groupBy(F.col("id").alias("of"), F.col("digest").alias("with")).agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > ALIKE).drop("many")
    repeated = stage(repeated, "pack-repeated")
    alike = F.col("id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("with"))
    number = F.row_number().over(Window.partitionBy("id", "digest").orderBy("source"))
    items = own.join(repeated, alike, "left_anti").withColumn("again", F.lit(0)).unionByName(own.join(repeated, alike, "left_semi").withColumn("again", number))
    # About as many pieces as documents and their bytes make at six bytes a word.
    about = docs.agg(F.sum(F.greatest(F.lit(1), F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / F.lit(6 * capacity))))).first()[0] or 0
    groups = max(1, -(-int(about) // group))
    kind = own.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = re.compile(WORD)
        for batch in batches:
            take, pieces, starts, sizes, texts = [], [], [], [], []
            for k, (words, t) in enumerate(zip(batch.column(5).to_pylist(), batch.column(6))):
                if words <= capacity:
                    take.append(k), pieces.append(0), starts.append(0), sizes.append(words), texts.append(t.as_py())
                    continue
                t = t.as_py()
                edges = [0, *[m.start() for m in word.finditer(t)][capacity::capacity], len(t)]
                for n, (a, b) in enumerate(zip(edges, edges[1:])):
                    take.append(k), pieces.append(n), starts.append(n * capacity), sizes.append(min(capacity, words - n * capacity)), texts.append(t[a:b])
            rows = pa.array(take, pa.int32())
            columns = [batch.column(c).take(rows) for c in range(5)]
            columns += [pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int32()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "source", "cluster", "digest", "again", "piece", "start", "size", "text"])

    items = items.select("id", "source", "cluster", "digest", "again", word_count(F.col("text")).alias("words"), "text")
    pieces = items.mapInArrow(cut, f"id {kind}, source string, cluster long, digest long, again int, piece int, start long, size int, text string")
    pieces = pieces.withColumn("grp", F.pmod(F.xxhash64(F.lit(71), "id", "piece", "digest", "again"), F.lit(groups)).cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), *((c, "ascending") for c in ("id", "digest", "piece", "again", "source"))])
        sizes, sources, clusters = (table[c].to_pylist() for c in ("size", "source", "cluster"))
        placed, offsets, fills = best_fit(sizes, sources, clusters, capacity, slots)
        first = table["grp"][0].as_py() << 32 if len(table) else 0
        positions: list[int] = []
        seen: dict[int, int] = {}
        for b in placed:
            positions.append(seen.get(b, 0))
            seen[b] = positions[-1] + 1
        columns = [table["id"], table["piece"], table["start"], table["size"], pa.array([first + b for b in placed], pa.int64())]
        columns += [pa.array(positions, pa.int32()), pa.array(offsets, pa.int32()), pa.array([fills[b] for b in placed], pa.int32()), table["text"]]
        return pa.table(columns, ["doc_id", "piece", "piece_start", "size", "bin", "position", "bin_offset", "bin_fill", "text"])

    schema = f"doc_id {kind}, piece int, piece_start long, size int, bin long, position int, bin_offset int, bin_fill int, text string"
    return pieces.groupBy("grp").applyInArrow(pack, schema)


def best_fit(
    sizes: list[int], sources: list, clusters: list, capacity: int, slots: int
) -> tuple[list[int], list[int], list[int]]:
    """(bin of each item, where it starts there, fill of each bin) for items in the order given."""
    source_bit: dict = {}
    many: dict = {}
    for c in clusters:
        many[c] = many.get(c, 0) + 1
    cluster_bit: dict = {}
    one = (1 << slots) - 1
    fills: list[int] = []
    source_map: list[int] = []
    cluster_map: list[int] = []
    order: list[tuple[int, int]] = []  # (what is left, bin)
    placed, offsets = [], []
    for size, source, cluster in zip(sizes, sources, clusters):
        shift = source_bit.setdefault(source, len(source_bit)) * slots if source is not None else -1
        full = one << shift if shift >= 0 else 0
        mark = 1 << cluster_bit.setdefault(cluster, len(cluster_bit)) if cluster is not None and many[cluster] > 1 else 0
        at = bisect_left(order, (size, -1))
        while at < len(order):
            b = order[at][1]
            if not cluster_map[b] & mark and (not full or source_map[b] & full != full):
                break
            at += 1
        if at < len(order):
            left, b = order.pop(at)
        else:
            left, b = capacity, len(fills)
            fills.append(0), source_map.append(0), cluster_map.append(0)
        placed.append(b), offsets.append(fills[b])
        fills[b] += size
        insort(order, (left - size, b))
        cluster_map[b] |= mark
        if full:
            used = (source_map[b] & full) >> shift
            source_map[b] |= (used + 1 & ~used) << shift  # the lowest free slot
    return placed, offsets, fills


def packed_texts(packing: DataFrame, between: str = "\n\n") -> DataFrame:
    """``bin, doc_ids, text`` of each bin that :func:`pack_documents` gives: its pieces in order, null as empty, with ``between`` between them."""
    piece = F.struct("position", "doc_id", F.coalesce("text", F.lit("")).alias("text")).alias("piece")
    bins = packing.select("bin", piece).groupBy("bin").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))  # a bin is bounded by its capacity
    return bins.select("bin", F.col("pieces.doc_id").alias("doc_ids"), F.array_join("pieces.text", between).alias("text"))
