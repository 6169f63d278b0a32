"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A hash permutes the documents of a source and deals them to blocks; a source has the
more blocks the larger it is.  Its target fixes an exact quota of draws, each a block
in one of the mix's passes over the source; the last draw may be cut off at the
document where the target is reached.  The quotas of all sources enter the root of a
binary tree.  At each node half of its draws go left, so many of each source as the
multivariate hypergeometric law gives for a draw without replacement.  Leaves are the
output shards.  Each leaf then draws its own run of every source's permuted draws,
and a document is taken as often as leaves own its block.  Within a shard a hash of
the copy gives the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import discard, fresh, stage

#: Runs of white space are outside words.
WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block, about, and least blocks of a source as a power of two; a block of few documents may be empty.
BLOCK_WORDS, LEAST_BITS = 1 << 20, 8
#: Levels of the tree: 2 ** LEVELS output shards.
LEVELS = 4


def word_count(text: Column) -> Column:
    """Number of words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float, weights: tuple[float, ...], most: float) -> DataFrame:
    """``source, source_size, target`` and any other columns of a table that has ``source, source_size``.

    Sources by code point, null last, take ``weights`` in turn.  They share
    ``share`` of all sizes by weight, none above ``most`` times its size; what a
    source can't take is shared again by weight.  The level at which that settles
    is found in one pass over sources, one row each, ordered by limit over weight.
    """
    everyone = Window.partitionBy(F.lit(0))
    place = F.row_number().over(everyone.orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.array(*[F.lit(float(w)) for w in weights])
    sized = sizes.withColumn("weight", F.get(turn, (place % len(weights)).cast("int"))).withColumn("limit", F.col("source_size") * most)
    first = everyone.orderBy((F.col("limit") / F.col("weight")), F.col("source").asc_nulls_last())
    before = first.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everyone) * share - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    # With all before it full, this source's level; the first that isn't full sets the level of the rest.
    levels = sized.withColumn("level", left / open_weight).withColumn("full", F.col("level") * F.col("weight") >= F.col("limit"))
    level = F.min(F.when(~F.col("full"), F.struct(F.col("limit") / F.col("weight"), F.col("level").alias("level")))).over(everyone)["level"]
    target = F.coalesce(F.least(level * F.col("weight"), F.col("limit")), F.col("limit"))
    return levels.withColumn("target", target).select(*sizes.columns, "target")


def mix(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    source: str = "source",
    share: float = 1.5,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    most: float = 2.0,
    levels: int = LEVELS,
    carry: bool = False,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per input row: ``doc_id, size, source_size, target, taken, copies, shards``.

    A document's size is its number of words (null: 0).  ``copies`` says how often
    leaves of the tree own its block, ``shards`` which leaves, and ``taken`` is
    ``size * copies``.  A document is taken whole; a source's taken words miss its
    target by half a document at most, none is taken more than ``ceil(most)`` times.
    Null sources are one source; documents without words are taken as their block is,
    those of sources without words not at all.  Rows alike in key and text are one
    document that counts as often as it is there.  An empty table gives an empty
    result.  Equal input gives equal output whatever its partitions.
    With ``carry``, one row per taken copy: the columns of ``docs``, then ``shard`` and
    ``position`` (a hash that orders the shard) under names that clash with none.
    """
    slim = docs.select(F.col(key).alias("id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"), _order(key, text).alias("order"))
    rows = stage(slim, "mix-rows")
    sources = stage(_sources(rows, share, weights, most, block_words), "mix-sources")
    blocks = stage(_quotas(_placed(rows, sources), sources), "mix-blocks")
    plan = stage(_owned(_placed(rows, sources), blocks, splitting_tree(blocks, levels)), "mix-plan")
    if not carry:
        found = _placed(rows, sources).join(plan, ["sid", "block"], "left")
        shards = F.coalesce(_taken(), F.array().cast("array<int>"))
        found = found.select("id", "size", "source_size", "target", shards.alias("shards"))
        copies = F.size("shards")
        return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), "shards")

    shard, position = fresh(docs, "shard", "position")
    # Ranges of a shard's order, so many that a task holds some blocks whatever the size of the mix.
    ranges = blocks.agg(F.ceil(F.log2(F.greatest(F.lit(1), F.sum("passes") / (8 << levels)))).cast("int")).first()[0] or 0
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(source).cast("string").alias("source"), _order(key, text).alias("order"))
    taken = _placed(whole, sources).join(plan, ["sid", "block"]).select("row", "order", F.posexplode(_taken()).alias("copy", "to"))
    out = taken.select("row.*", F.col("to").alias(shard), F.xxhash64(F.lit(43), "order", "copy").alias(position))
    discard(rows, blocks)
    return out.repartition(shard, _top_bits(F.col(position), F.lit(ranges))).sortWithinPartitions(shard, position)


def _order(key: str, text: str) -> Column:
    """The permutation of documents: a hash of key and text."""
    return F.xxhash64(F.lit(41), key, F.xxhash64(text))


def _top_bits(value: Column, bits: Column) -> Column:
    """The first ``bits`` bits of a hash as a number; none: 0."""
    return F.when(bits == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", value, (64 - bits).cast("int")))


def _sources(rows: DataFrame, share: float, weights: tuple[float, ...], most: float, block_words: int) -> DataFrame:
    """``source, source_size, bits, target, sid``: one row a source, with the bits that number its blocks."""
    weight = F.sum(F.col("size") + 1)  # documents without words fill blocks too
    bits = F.greatest(F.lit(LEAST_BITS), F.ceil(F.log2(weight / F.lit(block_words))).cast("int"))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), bits.alias("bits"))
    return source_targets(sizes, share, weights, most).withColumn("sid", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())))


def _placed(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows with their source's columns and their block."""
    named = sources.withColumnRenamed("source", "of")
    return rows.join(named, rows["source"].eqNullSafe(named["of"])).drop("of", "source").withColumn("block", _top_bits(F.col("order"), F.col("bits")))


def _quotas(placed: DataFrame, sources: DataFrame) -> DataFrame:
    """``sid, block, passes, room``: how often each block is drawn; its last draw is cut after ``room`` words where that is set.

    Whole passes draw every block; the last pass draws blocks in permuted order until
    the target is reached.  Blocks are one row each from here on.
    """
    words = placed.groupBy("sid", "block").agg(F.sum("size").alias("words")).join(sources.select("sid", "source_size", "target"), "sid")
    line = Window.partitionBy("sid").orderBy(F.xxhash64(F.lit(47), "sid", "block"), "block").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))
    words = words.withColumns({"whole": whole, "rest": F.col("target") - whole * F.col("source_size"), "before": F.coalesce(F.sum("words").over(line), F.lit(0))})
    last = (F.col("rest") > 0) & (F.col("before") < F.col("rest"))
    cut = last & (F.col("before") + F.col("words") > F.col("rest"))
    passes = (F.col("whole") + F.when(last, 1).otherwise(0)).cast("int")
    return words.select("sid", "block", passes.alias("passes"), F.when(cut, F.col("rest") - F.col("before")).alias("room")).where("passes > 0")


def splitting_tree(quotas: DataFrame, levels: int) -> DataFrame:
    """``sid, ends``: where each leaf's run of a source's draws ends, from a table of ``sid, passes``.

    A node is one row with an array of its sources' counts, so the tree's size depends
    on sources and leaves alone.
    """
    sums = quotas.groupBy("sid").agg(F.sum("passes").alias("n"))
    nodes = sums.agg(F.array_sort(F.collect_list(F.struct("sid", "n"))).alias("counts")).withColumn("node", F.lit(0))
    for level in range(levels):
        total = F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x["n"])
        half = F.floor((F.col("total") + F.col("node") % 2) / 2)
        nodes = nodes.withColumn("total", total).withColumn("left", _split(F.col("counts"), F.col("total"), half, F.col("node"), level))
        right = F.zip_with("counts", "left", lambda x, y: F.struct(x["sid"].alias("sid"), (x["n"] - y["n"]).alias("n")))
        sides = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("counts")), F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("counts")))
        nodes = nodes.select(F.inline(sides))
    leaves = nodes.select("node", F.inline("counts")).groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("node", "n"))).alias("leaves"))
    numbers = F.sequence(F.lit(1), F.lit(1 << levels))
    return leaves.select("sid", F.transform(numbers, lambda k: F.aggregate(F.slice("leaves", 1, k), F.lit(0).cast("long"), lambda s, x: s + x["n"])).alias("ends"))


def _split(counts: Column, total: Column, taken: Column, node: Column, level: int) -> Column:
    """How many of each source go left when ``taken`` of ``total`` draws do: one source after another, given those before it."""
    empty = F.array().cast("array<struct<sid:int,n:bigint>>")
    start = F.struct(total.cast("long").alias("total"), taken.cast("long").alias("taken"), empty.alias("out"))

    def one(state: Column, x: Column) -> Column:
        chance = F.pmod(F.xxhash64(F.lit(53), F.lit(level), node, x["sid"]), F.lit(1 << 53)) / F.lit(float(1 << 53))
        drawn = hypergeometric(state["total"], x["n"], state["taken"], chance).cast("long")
        # The draw is an element of its own array, so that it is made once though it is used twice.
        return F.element_at(
            F.transform(
                F.array(drawn),
                lambda d: F.struct(
                    (state["total"] - x["n"]).alias("total"), (state["taken"] - d).alias("taken"), F.concat(state["out"], F.array(F.struct(x["sid"].alias("sid"), d.alias("n")))).alias("out")
                ),
            ),
            1,
        )

    return F.aggregate(counts, start, one, lambda s: s["out"])


def hypergeometric(total: Column, marked: Column, taken: Column, chance: Column) -> Column:
    """How many of ``taken`` draws from ``total`` are among the ``marked``, by inversion of the distribution at ``chance``.

    Weights follow from one another by ratio.  They are summed over ten deviations and
    twenty on either side of the mode, beyond which nothing moves a double's sum.
    """
    total, marked, taken = (c.cast("double") for c in (total, marked, taken))
    mode = F.floor((taken + 1) * (marked + 1) / (total + 2))
    part = marked / F.greatest(total, F.lit(1.0))
    reach = F.ceil(F.sqrt(taken * part * (1 - part)) * 10) + 20
    low = F.greatest(F.lit(0), (taken + marked - total).cast("long"), mode - reach)
    high = F.least(taken.cast("long"), marked.cast("long"), mode + reach)
    span = F.sequence(low, F.greatest(low, high))

    def ratio(k: Column) -> Column:
        return (marked - k) * (taken - k) / ((k + 1) * (total - marked - taken + k + 1))

    one, nothing = F.lit(1.0), F.lit(0.0)
    mass = F.aggregate(
        span, F.struct(one.alias("w"), nothing.alias("sum")), lambda s, k: F.struct((s["w"] * ratio(k)).alias("w"), (s["sum"] + s["w"]).alias("sum")), lambda s: s["sum"]
    )
    bar = F.array(mass * chance)
    found = F.aggregate(
        span,
        F.struct(one.alias("w"), nothing.alias("sum"), low.alias("pick"), bar.alias("bar")),
        lambda s, k: F.struct(
            (s["w"] * ratio(k)).alias("w"),
            (s["sum"] + s["w"]).alias("sum"),
            F.when(s["sum"] + s["w"] <= F.get(s["bar"], F.lit(0)), k + 1).otherwise(s["pick"]).alias("pick"),
            s["bar"].alias("bar"),
        ),
        lambda s: s["pick"],
    )
    return F.least(found, F.greatest(low, high))


def _owned(placed: DataFrame, blocks: DataFrame, tree: DataFrame) -> DataFrame:
    """``sid, block, leaves, cut``: the leaves that own each draw of a block, and the order up to which its last draw goes (null: to the end)."""
    draws = blocks.select("sid", "block", F.explode(F.sequence(F.lit(1), F.col("passes"))).alias("pass"))
    place = F.row_number().over(Window.partitionBy("sid").orderBy(F.xxhash64(F.lit(59), "sid", "block", "pass"), "block", "pass"))
    draws = draws.withColumn("place", place).join(tree, "sid")
    leaf = F.size(F.filter("ends", lambda end: end < F.col("place"))).cast("int")
    owned = draws.select("sid", "block", F.struct("pass", leaf.alias("leaf")).alias("draw")).groupBy("sid", "block").agg(F.array_sort(F.collect_list("draw")).alias("draws"))
    owned = owned.select("sid", "block", F.transform("draws", lambda d: d["leaf"]).alias("leaves"))

    # One block of each source is cut: its documents in order, as far as their middles are within the room.
    short = placed.join(blocks.where("room is not null").select("sid", "block", "room"), ["sid", "block"])
    short = short.groupBy("sid", "block", "room", "order").agg(F.sum("size").alias("size"))
    line = Window.partitionBy("sid", "block").orderBy("order")
    start = F.coalesce(F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = short.withColumn("middle", start + F.col("size") / 2.0).groupBy("sid", "block")
    cuts = cuts.agg(F.coalesce(F.max(F.when(F.col("middle") < F.col("room"), F.col("order"))), F.lit(-(1 << 63))).alias("cut"))
    return owned.join(cuts, ["sid", "block"], "left")


def _taken() -> Column:
    """The leaves that own a row of a planned block; null outside of the plan."""
    over = F.coalesce(F.col("order") > F.col("cut"), F.lit(False))
    return F.when(over, F.slice("leaves", 1, F.size("leaves") - 1)).otherwise(F.col("leaves"))
