"""Prefix and suffix structures: tries, suffix order, common prefixes, repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import numbered, with_previous
from .suffixes import long_suffix_array

#: Up to this length a text's suffixes are ranked by Spark's own sort, above by prefix doubling in a task.
SHORT_TEXT = 512
#: From this length on a text is the work of many tasks.
LONG_TEXT = 1 << 18


def sorted_words(words: DataFrame, word: str = "word") -> DataFrame:
    """``w, number, lcp``: the distinct words in order, and how many characters each shares with the word before.

    Words are sorted by ranges; neighbours, those at a border of two ranges too, meet by
    their numbers.
    """
    distinct = numbered(words.select(F.col(word).alias("w")).where("w <> ''").distinct(), "w")
    return with_previous(distinct, "number", "w").select("w", "number", common_prefix(F.col("w"), F.coalesce("prev_w", F.lit(""))).alias("lcp"))


def trie_nodes(words: DataFrame, word: str = "word") -> DataFrame:
    """``prefix, depth, parent, terminal`` of each node below the root.

    A word adds the nodes below what it shares with its left neighbour in order, so each
    node is made once; one that is a word itself is that word's, which comes before all longer ones.
    """
    rows = sorted_words(words, word).where("lcp < length(w)")
    nodes = rows.select("w", F.explode(F.sequence(F.col("lcp") + 1, F.length("w"))).alias("depth"))
    prefix = F.substring("w", F.lit(1), F.col("depth"))
    return nodes.select(prefix.alias("prefix"), "depth", F.substring("w", F.lit(1), F.col("depth") - 1).alias("parent"), (F.col("depth") == F.length("w")).alias("terminal"))


def trie_edges(words: DataFrame, word: str = "word") -> DataFrame:
    """``prefix, label, terminal`` of the edges of the compressed trie, whose inner nodes are words or branch.

    A node of the plain trie stays if it is a word, or if two neighbours in order part
    there.  The characters between two nodes that stay are one label.
    """
    rows = sorted_words(words, word)
    # A node where two words part is what a word shares with its neighbour.
    parts = rows.where("lcp > 0").select(F.expr("substring(w, 1, lcp)").alias("prefix"))
    kept = parts.union(rows.select(F.col("w").alias("prefix"))).distinct()
    terminal = rows.select(F.col("w").alias("prefix"), F.lit(True).alias("terminal"))
    inner = sorted_words(kept, "prefix").withColumnRenamed("w", "prefix")
    # In order, a kept prefix hangs from the longest kept prefix of it, and that has as many characters as it shares with the one before.
    return inner.select("prefix", F.expr("substring(prefix, lcp + 1, length(prefix))").alias("label")).join(terminal, "prefix", "left").select("prefix", "label", F.coalesce("terminal", F.lit(False)).alias("terminal"))


def trie_summary(words: DataFrame, query: str, word: str = "word") -> DataFrame:
    """One row: ``nodeCount, wordsInserted, prefixFound, isWord``; the root is a node, repeated words count as inserted."""
    kept = words.select(F.col(word).alias("w")).where("w <> ''")
    asked = kept.agg(
        F.count(F.lit(1)).alias("wordsInserted"),
        F.coalesce(F.bool_or(F.startswith("w", F.lit(query))), F.lit(query == "")).alias("prefixFound"),
        F.coalesce(F.bool_or(F.col("w") == query), F.lit(False)).alias("isWord"),
    )
    nodes = sorted_words(words, word).agg((F.coalesce(F.sum(F.length("w") - F.col("lcp")), F.lit(0)) + 1).alias("nodeCount"))
    # Both sides are one row.
    return nodes.join(asked).select("nodeCount", "wordsInserted", (F.col("prefixFound") | F.lit(query == "")).alias("prefixFound"), "isWord")


def trie_completions(words: DataFrame, query: str, word: str = "word", limit: int = 200) -> DataFrame:
    """``rank, word``: the first ``limit`` distinct words with the prefix, in order."""
    found = words.select(F.col(word).alias("word")).where((F.col("word") != "") & F.startswith("word", F.lit(query)))
    top = found.distinct().orderBy("word").limit(limit)
    return top.select(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("word")).alias("rank"), "word")


def suffix_array(df: DataFrame, text: str = "text", key: str = "doc_id", short: int = SHORT_TEXT, long: int = LONG_TEXT) -> DataFrame:
    """One row per suffix: ``key, rank, pos, lcp``; keys must be unique.

    ``rank`` counts from 0 in code-point order, ``lcp`` is the common prefix with the
    suffix before.  A text of n characters has n suffixes of n/2 characters on average,
    so only short texts are exploded; longer ones are sorted by prefix doubling, those
    below ``long`` each within a task, others by rows over all tasks.
    """
    source = df.select(F.col(key), F.col(text).alias("__t")).where(F.length("__t") > 0)
    low = source.where(F.length("__t") <= short)
    rows = low.select(key, "__t", F.explode(F.sequence(F.lit(0), F.length("__t") - 1)).alias("pos"))
    rows = rows.select(key, "pos", F.expr("substring(__t, pos + 1)").alias("__s"))
    order = Window.partitionBy(key).orderBy("__s")
    rows = rows.select(key, (F.row_number().over(order) - 1).alias("rank"), "pos", "__s", F.lag("__s").over(order).alias("__p"))
    small = rows.select(key, "rank", "pos", common_prefix(F.col("__s"), F.coalesce("__p", F.lit(""))).alias("lcp"))
    high = source.where((F.length("__t") > short) & (F.length("__t") < long))
    kind = high.schema[key].dataType.simpleString()

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, t in enumerate(batch.column(1).to_pylist()):
                order, common = sort_suffixes(t)
                n = len(order)
                keys = batch.column(0).take(pa.array(np.full(n, r), pa.int32()))
                yield pa.RecordBatch.from_arrays([keys, pa.array(np.arange(n), pa.int32()), pa.array(order, pa.int32()), pa.array(common, pa.int32())], [key, "rank", "pos", "lcp"])

    out = small.union(high.mapInArrow(ranked, f"`{key}` {kind}, rank int, pos int, lcp int"))
    huge = source.where((F.length("__t") > short) & (F.length("__t") >= long))
    return out if huge.isEmpty() else out.union(long_suffix_array(huge, "__t", key))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two strings, by halving; strings have less than 2 ** 31 characters."""
    n = F.least(F.length(a), F.length(b))
    # Powers of two up to the length, largest first.
    steps = F.transform(F.sequence(F.ceil(F.log2((n + 1).cast("double"))).cast("int"), F.lit(0)), lambda k: F.call_function("shiftleft", F.lit(1), k))
    return F.aggregate(steps, F.lit(0), lambda got, s: F.when((got + s <= n) & (F.substring(a, F.lit(1), got + s) == F.substring(b, F.lit(1), got + s)), got + s).otherwise(got))


def sort_suffixes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Start of each suffix in order, and its common prefix with the one before, by prefix doubling on ranks."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    n = len(codes)
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    width, order = 1, np.argsort(rank, kind="stable")
    history = [rank]
    while n > 1 and rank.max() < n - 1:
        second = np.full(n, -1, np.int64)
        second[:-width] = rank[width:] if width < n else second[:-width]
        both = rank * (n + 1) + second + 1
        rank = np.unique(both, return_inverse=True)[1].astype(np.int64)
        order = np.argsort(rank, kind="stable")
        history.append(rank)
        width *= 2
    # Ranks of power-of-two prefixes tell where two suffixes part.
    common = np.zeros(n, np.int64)
    if n > 1:
        a, b = order[:-1].copy(), order[1:].copy()
        got = np.zeros(n - 1, np.int64)
        for k in reversed(range(len(history))):
            inside = (a + got < n) & (b + got < n)
            same = np.zeros(n - 1, bool)
            same[inside] = history[k][(a + got)[inside]] == history[k][(b + got)[inside]]
            # Equal ranks mean equal prefixes only as far as neither text ends.
            room = (np.maximum(a, b) + got + (1 << k)) <= n
            got[same & room] += 1 << k
        common[1:] = got
    return order, common


def repeats(suffixes: DataFrame, df: DataFrame, text: str = "text", key: str = "doc_id", shown: int = 200) -> DataFrame:
    """Per text: ``longestRepeatedSubstring, longestRepeatLength, distinctSubstrings``; of equal lengths the first in suffix order."""
    best = suffixes.groupBy(key).agg(F.max(F.struct(F.col("lcp"), (-F.col("rank")).alias("low"), F.col("pos"))).alias("b"), F.sum("lcp").alias("all"), F.count(F.lit(1)).alias("n"))
    out = best.join(df.select(F.col(key), F.col(text).alias("__t")), key)
    n = F.col("n").cast("long")
    repeat = F.expr(f"substring(__t, b.pos + 1, least(b.lcp, {shown}))")
    return out.select(key, F.when(F.col("b.lcp") > 0, repeat).otherwise("").alias("longestRepeatedSubstring"), F.col("b.lcp").alias("longestRepeatLength"), (F.expr("n * (n + 1) div 2") - F.col("all")).alias("distinctSubstrings"))
