"""N-gram Jaccard join by prefix filters under several global token orders.

A document is the set of its distinct word n-grams, each a 64-bit hash.  If two sets
are similar enough, then under any global order of tokens their prefixes of length
``size - ceil(t * size) + 1`` share a token.  A first sieve looks at a fixed pseudo-random
part of the token space, put first in an order of its own: sets whose prefix there has no
token that another set has can't link.  What passes is read again in whole.  The second
sieve counts all tokens among what passed; its three orders put rare tokens before frequent
ones and differ in how tokens of like frequency follow each other.  Candidates share a
prefix token under the first order; only those that also share one under each of the
others, and whose sizes and parity bitmaps don't prove them too far apart, are verified on
whole sets.  Tokens that a single set has fill prefixes without being able to match, so
they are only counted.

Equal sets are one node from the start.  Links join components in two rounds: first
each token's documents are held against the token's largest document, then what shares a
token but not yet a component is compared in full.  Large groups of near copies thus
cost a comparison each, and no link between components is lost.

Tokens so frequent that there can only be HOT of them meet their postings by broadcast,
the others by a shuffle in which each has a small share; pairs of a token are salted by
SALTED of its rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .staging import discard, keep_rows, slices, stage

#: Bytes of text that are hashed at a time.
BATCH = 1 << 21
#: Share of the token space that comes first: per unit of (1 - threshold), which is a prefix's share of a set, and at most.
FIRST, MOST_FIRST = 2.5, 0.3
#: Bits of the bitmap of wanted identifiers, at most 8 MB in all.
MAP_BITS = 1 << 26
#: Bits of a hash that name a token in the sieves; tokens that share a name only let more through.
NAME = (1 << 48) - 1
#: Bits of a set's parity bitmap.
BITS = 512
#: Tokens that can be hot, at most: those with more than 1 / HOT of all postings.
HOT = 1 << 15
#: Rows of a token that its pairs are salted by.
SALTED = 4096
#: Bytes from which a word is hashed by itself.
LONG_WORD = 256

_U = np.uint64
_MIX = (_U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB))
_BASE = 0x9E3779B97F4A7C15
_RNG = np.random.default_rng(20240)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Masks of the first 0 to 7 bytes of eight.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(8)], np.uint64)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True
_PLACE = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x + _U((seed * _BASE + 0x632BE59BD9B4E019) & (1 << 64) - 1)
    x = (x ^ (x >> _U(30))) * _MIX[0]
    x = (x ^ (x >> _U(27))) * _MIX[1]
    return x ^ (x >> _U(31))


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word of ``data``, A-Z as a-z: eight bytes at a time, each step a scrambling of all before."""
    low = np.concatenate([_LOWER[data], np.zeros(8, np.uint8)])
    eights = np.ndarray((len(low) - 7,), "<u8", low.data, strides=(1,))
    size = end - begin
    out = mix(size.astype(np.uint64), 3)
    left = np.flatnonzero(size < LONG_WORD)
    at = 0
    while len(left):
        rest = size[left] - at
        part = eights[begin[left] + at]
        last = rest < 8
        part[last] &= _FIRST[rest[last]]
        out[left] = mix(out[left] ^ part, 4)
        left = left[rest > 8]
        at += 8
    for k in np.flatnonzero(size >= LONG_WORD):
        out[k] = int.from_bytes(hashlib.blake2b(low[begin[k] : end[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def shingle_sets(data: np.ndarray, starts: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; texts lie one after another in ``data``.

    A word is a run of non-blank bytes; a text with fewer words than ``width`` is one
    shingle of all its words.
    """
    n = len(starts) - 1
    blank = _BLANK[data]
    opens = ~blank
    opens[1:] &= blank[:-1]
    first = starts[:-1][starts[:-1] < starts[1:]]
    opens[first] = ~blank[first]
    begin = np.flatnonzero(opens)
    empty = np.empty(0, np.uint64)
    if not len(begin):
        return [empty] * n
    closes = ~blank
    closes[:-1] &= blank[1:]
    last = starts[1:][starts[:-1] < starts[1:]] - 1
    closes[last] = ~blank[last]
    words = word_hashes(data, begin, np.flatnonzero(closes) + 1)

    edges = np.searchsorted(begin, starts)  # of words, by text
    grams = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        grams += words[k : k + len(grams)] * _PLACE[k]
    grams = mix(grams, width)
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        elif b > a:
            out.append(mix((words[a:b] * _PLACE[: b - a]).sum(keepdims=True, dtype=np.uint64), b - a))
        else:
            out.append(empty)
    return out


def text_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Shingle sets of a column of texts, null as empty, in runs of bounded size."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BATCH, "right")) - 1)
        yield from shingle_sets(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], width)
        at = to


def _fingerprint(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit sums over a set; they and its size name it."""
    return tuple(int(np.int64(mix(s, k).sum(dtype=np.uint64).view(np.int64))) for k in (101, 202))


def _parities(s: np.ndarray) -> list[int]:
    """A bitmap of how many hashes fall on each bit, odd or even: two sets differ in at least as many elements as bits."""
    odd = np.bincount((mix(s, 9) & _U(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _need(n: int, num: int, den: int) -> int:
    """Prefix length of a set of ``n``: what is left after all but the least possible overlap, and one more."""
    return n + (-num * n // den) + 1


def jaccard_components(
    docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, text: str = "text", key: str = "doc_id", carry: bool = False
) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    Texts are lower-cased (A-Z) and cut into words at spaces, tabs and line breaks; a
    document's set is its distinct ``width``-word shingles, or with fewer words the
    whole sequence as one.  Documents link when ``den * |intersection| >= num * |union|``
    and neither set is empty; null and blank texts link with nothing.
    ``component_id`` is the smallest key reachable by links, its own included (null keys
    only where there is no other), and ``kept`` marks one row of each component: that
    key's, of rows that repeat it the first in a fixed order.  An empty table gives an
    empty result; other columns are ignored.  With ``carry`` the kept rows of ``docs``
    are returned with their columns alone.
    """
    share = min(MOST_FIRST, FIRST * (1 - num / den))
    limit = _U(int(share * (1 << 32)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in (part for whole in batches for part in slices(whole, 1, BATCH)):
            sizes, ones, twos, tokens, rest = [], [], [], [], []
            for s in text_sets(batch.column(1), width):
                one, two = _fingerprint(s) if len(s) else (0, 0)
                sizes.append(len(s)), ones.append(one), twos.append(two)
                if not len(s) or (one, two) in seen:  # equal sets speak once in a task
                    tokens.append(None), rest.append(None)
                    continue
                if len(seen) > 100_000:
                    seen.clear()
                seen.add((one, two))
                first = (mix(s, 7) & _U(0xFFFFFFFF)) < limit
                tokens.append((s[first] & _U(NAME)).view(np.int64))
                # A prefix that goes beyond the first part of the token space needs the rest as well.
                rest.append((s[~first] & _U(NAME)).view(np.int64) if first.sum() < _need(len(s), num, den) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(ones, pa.int64()), pa.array(twos, pa.int64()), _lists(tokens), _lists(rest)],
                ["id", "digest", "n", "one", "two", "tokens", "rest"],
            )
        pa.default_memory_pool().release_unused()  # a worker lives on after its task

    source = _source(docs, text, key)
    kind = source.schema["id"].dataType.simpleString()
    read_schema = f"id {kind}, digest long, n long, one long, two long, tokens array<long>, rest array<long>"
    read_rows = source.mapInArrow(read, read_schema).withColumns({"row": F.monotonically_increasing_id(), "m": F.size("tokens"), "r": F.coalesce(F.size("rest"), F.lit(0))})
    read_rows = stage(read_rows, "jaccard-rows")
    rows = stage(read_rows.select("row", "id", "digest", "n", "one", "two", F.col("tokens").isNotNull().alias("speaks")), "jaccard-names")

    # A set is named by its size and fingerprint; its node is the first row that spoke for it.
    sets = rows.where("n > 0").groupBy("one", "two", "n").agg(F.min(F.when(F.col("speaks"), F.col("row"))).alias("node"), F.min("id").alias("least"))
    sets = stage(sets, "jaccard-sets")
    links = _links(docs, read_rows, rows, sets, width, num, den, text, key)
    labels = components(links)
    sets = sets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    roots = sets.groupBy("label").agg(F.min("least").alias("component"))
    named = stage(sets.join(roots, "label").select("one", "two", "n", "component"), "jaccard-named")

    # Copies of one set may be a third of all rows, so the join with their few sets is salted by row.
    salt = F.pmod(F.xxhash64("row"), F.lit(256)).cast("int")
    salts = rows.where("n > 0").withColumn("salt", salt).groupBy("one", "two", "n").agg(F.collect_set("salt").alias("salts"))
    named = named.join(salts, ["one", "two", "n"]).select("one", "two", "n", "component", F.explode("salts").alias("salt"))
    out = rows.drop("speaks").withColumn("salt", salt).join(named, ["one", "two", "n", "salt"], "left")
    out = out.withColumn("component", F.coalesce("component", "id"))
    # One row stays: that of the component's key, or where no member has a key, the first of its set.
    own = out.where(F.col("id").eqNullSafe(F.col("component")))
    first = stage(own.groupBy("component", F.when(F.col("component").isNull(), F.concat_ws(":", "one", "two", "n")).alias("of")).agg(F.min("row").alias("stays")), "jaccard-stays")
    kept = first.select(F.col("stays").alias("row"), F.lit(True).alias("kept"))
    out = out.join(kept, "row", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    if carry:
        return keep_rows(docs, key, text, out.select("id", "digest", F.col("kept").alias("stays")))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "kept")


def _source(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("digest"))


def _lists(values: list) -> pa.Array:
    """A list array of numpy arrays and nulls without a Python object for each number."""
    ends = np.cumsum([0, *(0 if v is None else len(v) for v in values)], dtype=np.int32)
    full = [v for v in values if v is not None]
    flat = pa.array(np.concatenate(full) if full else np.empty(0, np.int64), pa.int64())
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, mask=pa.array([v is None for v in values]))


def _links(docs: DataFrame, read_rows: DataFrame, rows: DataFrame, sets: DataFrame, width: int, num: int, den: int, text: str, key: str) -> DataFrame:
    """Verified links (a, b) that join the same nodes as all links."""
    # First sieve, on the part of the tokens that comes first: who has a shared token in its prefix at all.
    spoken = read_rows.where("tokens is not null").select("row", "n", "m", F.col("rest").isNotNull().alias("beyond"), "tokens", "rest")
    postings = spoken.select("row", F.lit(1).alias("first"), F.explode("tokens").alias("token")).union(spoken.select("row", F.lit(0), F.explode("rest")))
    limit = _limit(read_rows.where("m > 0 or r > 0"), F.greatest("m", F.lit(0)) + F.greatest("r", F.lit(0)))
    often = postings.groupBy("token").agg(F.count(F.lit(1)).alias("often")).where("often >= 2")
    shared = _by_token(postings, often, limit).groupBy("row").agg(F.sum("first").alias("shared"), F.sum(1 - F.col("first")).alias("shared2"))
    prefix = F.col("n") - F.ceil(F.lit(num) * F.col("n") / F.lit(den)) + 1
    within = prefix > F.col("m") - F.col("shared")
    after = (F.col("shared") > 0) | (prefix - F.col("m") > F.col("n") - F.col("m") - F.col("shared2"))
    open_ = spoken.drop("tokens", "rest").join(shared, "row").where(F.when(F.col("beyond"), after).otherwise(within)).select("row")
    open_ = open_.join(sets.select(F.col("node").alias("row")), "row", "left_semi")
    held = _whole_sets(docs, rows, open_, width, text, key)

    # Second sieve, on whole sets and among those that passed.
    postings = held.select("node", F.explode("tokens").alias("token")).withColumn("token", F.col("token").bitwiseAND(F.lit(NAME)))
    limit = _limit(held, F.size("tokens"))
    often = postings.groupBy("token").agg(F.count(F.lit(1)).alias("often")).where("often >= 2")
    lists = _by_token(postings, often, limit).groupBy("node").agg(F.collect_list(F.struct("often", "token")).alias("list"))
    nodes = lists.join(held.select("node", F.size("tokens").cast("long").alias("n"), "bits"), "node").withColumn("s", F.size("list").cast("long"))
    nodes = nodes.withColumn("q", (prefix - (F.col("n") - F.col("s"))).cast("int")).where("q > 0")

    def under(rarity, order) -> object:
        ordered = F.array_sort(F.transform("list", lambda x: F.struct(rarity(x["often"]).alias("often"), order(x["token"]).alias("place"), x["token"].alias("token"))))
        return F.transform(F.slice(ordered, 1, F.least("q", F.size("list"))), lambda x: x["token"])

    same, level = lambda often: often, lambda often: F.floor(F.log2(often))
    orders = [under(same, lambda t: t), under(level, lambda t: F.xxhash64(t)), under(level, lambda t: F.bitwise_not(F.xxhash64(t)))]
    nodes = stage(nodes.select("node", "n", "s", "bits", *[o.alias(f"p{k}") for k, o in enumerate(orders)]), "jaccard-nodes")

    # Sizes alone exclude a pair: no more is common than either shares with anyone.
    most = F.least("s", "s2")
    close = F.lit(den) * most >= F.lit(num) * (F.col("n") + F.col("n2") - most)
    apart = sum((F.bit_count(F.col("bits")[k].bitwiseXOR(F.col("bits2")[k])) for k in range(BITS // 64)), F.lit(0))
    close = close & (apart * (den + num) <= (F.col("n") + F.col("n2")) * (den - num))
    posted = nodes.select("node", "n", "s", "bits", F.explode("p0").alias("token"))
    limit = _limit(nodes, F.size("p0"))
    heads = posted.groupBy("token").agg(F.max(F.struct("s", "n", "node", "bits")).alias("head"), F.count(F.lit(1)).alias("often")).where("often > 1")
    heads = heads.select("token", "often", F.col("head.node").alias("a"), F.col("head.n").alias("n2"), F.col("head.s").alias("s2"), F.col("head.bits").alias("bits2"))
    stars = _by_token(posted, heads, limit).where((F.col("node") != F.col("a")) & close).select("a", F.col("node").alias("b")).distinct()
    stars = stage(stars, "jaccard-pairs")
    found = stage(_verified(_filtered(stars, nodes), held, num, den), "jaccard-links")

    # Second round: what shares a token but not a component yet. A token's largest component is only held against others.
    labels = components(found)
    marked = stage(posted.join(labels, "node", "left").select("token", "node", "n", "s", "bits", F.coalesce("label", "node").alias("part")), "jaccard-marked")
    parts = marked.groupBy("token", "part").agg(F.count(F.lit(1)).alias("many"))
    mixed = parts.groupBy("token").agg(F.max(F.struct("many", "part")).alias("top"), F.count(F.lit(1)).alias("parts"), F.sum("many").alias("often"))
    mixed = mixed.where("parts > 1").select("token", "often", F.col("top.part").alias("large"))
    several = stage(_by_token(marked, mixed, limit).withColumn("salts", (F.floor(F.col("often") / SALTED) + 1).cast("int")), "jaccard-several")
    left = several.where("part <> large").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    left = left.select("token", "salt", "node", "n", "s", "bits", "part")
    other = several.select("token", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"), F.col("node").alias("b"), F.col("n").alias("n2"), F.col("s").alias("s2"), F.col("bits").alias("bits2"), F.col("part").alias("part2"))
    pairs = left.join(other, ["token", "salt"]).where((F.col("part") != F.col("part2")) & close)
    pairs = pairs.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
    known = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = stage(pairs.join(known, ["a", "b"], "left_anti"), "jaccard-pairs")
    late = stage(_verified(_filtered(pairs, nodes), held, num, den), "jaccard-links")
    discard(read_rows, held, nodes, stars, marked, several, pairs)
    return found.union(late)


def _limit(table: DataFrame, postings: Column) -> int:
    """Postings above which a token is hot; less than HOT tokens can be."""
    return max(2, (table.agg(F.sum(postings)).first()[0] or 0) // HOT)


def _by_token(rows: DataFrame, table: DataFrame, limit: int) -> DataFrame:
    """``rows`` with the columns of ``table``, one row a token with its frequency ``often``; no hot token meets in one task."""
    with_hot = rows.join(F.broadcast(table.where(F.col("often") > limit)), "token", "left")  # one broadcast for both
    few, rest = with_hot.where("often is not null"), with_hot.where("often is null").select(rows.columns)
    return few.unionByName(rest.join(table.where(F.col("often") <= limit), "token"))


def _filtered(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs that share a prefix token under each of the other orders too."""
    a = nodes.select(F.col("node").alias("a"), F.col("p1").alias("a1"), F.col("p2").alias("a2"))
    b = nodes.select(F.col("node").alias("b"), F.col("p1").alias("b1"), F.col("p2").alias("b2"))
    both = pairs.join(a, "a").join(b, "b").where(F.arrays_overlap("a1", "b1") & F.arrays_overlap("a2", "b2"))
    return stage(both.select("a", "b"), "jaccard-candidates")


def _whole_sets(docs: DataFrame, rows: DataFrame, open_: DataFrame, width: int, text: str, key: str) -> DataFrame:
    """``node, tokens, bits``: the whole sets of the given rows, read from the texts again."""
    wanted = stage(rows.join(open_, "row").select("row", F.col("id").alias("of"), F.col("digest").alias("with"), "one", "two", "n"), "jaccard-open")
    source = _likely(_source(docs, text, key), wanted.select(F.col("of").alias("id"), F.col("with").alias("digest")))
    # Key and digest of the text together, as one key may have any number of rows.
    asked = source.join(wanted, F.col("id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("with"))).select("text", "row", "n", "one", "two")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 0, BATCH)):
            names = zip(*(batch.column(k).to_pylist() for k in range(1, 5)))
            nodes, values, bits = [], [], []
            for s, (row, n, one, two) in zip(text_sets(batch.column(0), width), names):
                # Two texts of a key may have one digest; the fingerprint picks the right one.
                if len(s) == n and _fingerprint(s) == (one, two):
                    nodes.append(row), values.append(s.view(np.int64)), bits.append(_parities(s))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), _lists(values), pa.array(bits, pa.list_(pa.int64()))], ["node", "tokens", "bits"])
        pa.default_memory_pool().release_unused()

    held = stage(asked.mapInArrow(read, "node long, tokens array<long>, bits array<long>"), "jaccard-values")
    if held.groupBy("node").count().where("count > 1").isEmpty():
        return held
    return stage(held.dropDuplicates(["node"]), "jaccard-values")  # rows that repeat key and text


def _likely(source: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``source`` whose key and digest may be in ``wanted``, so that texts nobody asks for aren't shuffled.

    The filter is a bitmap of hashed identifiers in MAP_BITS / 32768 rows of 4 KB, whatever the input.
    """
    slot = F.pmod(F.xxhash64("id", "digest"), F.lit(MAP_BITS))
    bucket, bit = F.floor(slot / 32768).cast("int"), slot % 32768
    maps = stage(wanted.groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(bit).alias("map")), "jaccard-map")
    byte = F.conv(F.hex(F.substring("map", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    near = source.withColumn("bucket", bucket).join(F.broadcast(maps), "bucket")
    return near.where(F.getbit(byte, (bit % 8).cast("int")) == 1).select("id", "text", "digest")


def _verified(pairs: DataFrame, held: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs whose whole sets are similar enough."""
    a = held.select(F.col("node").alias("a"), F.col("tokens").alias("x"))
    b = held.select(F.col("node").alias("b"), F.col("tokens").alias("y"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (p, ps), (q, qs) = (_arrays(batch.column(k)) for k in (2, 3))
            keep = []
            for k in range(len(batch)):
                both = np.concatenate([p[ps[k] : ps[k + 1]], q[qs[k] : qs[k + 1]]])
                both.sort()
                inter = int((both[1:] == both[:-1]).sum())
                keep.append(den * inter >= num * (len(both) - inter))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])
        pa.default_memory_pool().release_unused()

    return pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def _arrays(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all lists one after another, and where each list begins and the last ends."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
    return np.asarray(column.flatten()), np.concatenate([[0], np.cumsum(sizes)])
