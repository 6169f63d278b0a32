"""Work counters of the algorithms whose work depends on more than a pattern's scan.

``comparisons`` and ``operations`` are those of the textbook procedure, counted from
what the operators compute anyway: closed forms over tries, suffix arrays and posting
lists.  Only an automaton with many states follows them one character after another.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from .analytics import query_terms
from .matching import MOST_PREFIXES, failures
from .multi_pattern import check_patterns
from .structures import common_prefix


class Machine:
    """A pattern automaton by states: edges, failure links, and the operations that made it."""

    def __init__(self, patterns: list[str]):
        self.edges: list[dict[str, int]] = [{}]
        self.names = [""]
        self.work = 0
        for pattern in patterns:
            at = 0
            for c in pattern:
                self.work += 1
                if c not in self.edges[at]:
                    self.edges[at][c] = len(self.edges)
                    self.names.append(self.names[at] + c)
                    self.edges.append({})
                at = self.edges[at][c]
        self.fail = [0] * len(self.edges)
        waiting = deque(self.edges[0].values())
        while waiting:
            at = waiting.popleft()
            for c, below in self.edges[at].items():
                waiting.append(below)
                link, steps = self._follow(self.fail[at], c)
                self.work += steps + 1
                self.fail[below] = self.edges[link].get(c, 0)

    def _follow(self, at: int, c: str) -> tuple[int, int]:
        """The first state along failure links that has an edge, or the root, and how many links that took."""
        steps = 0
        while at and c not in self.edges[at]:
            at, steps = self.fail[at], steps + 1
        return at, steps

    def comparisons(self, text: str) -> int:
        """One for each character and one for each failure link."""
        at, total = 0, len(text)
        for c in text:
            at, steps = self._follow(at, c)
            total += steps
            at = self.edges[at].get(c, 0)
        return total


def automaton_counters(df: DataFrame, patterns: list[str], text: str = "text", key: str = "doc_id", most_prefixes: int = MOST_PREFIXES) -> DataFrame:
    """``key, comparisons, operations`` of each text: the automaton's construction is part of the operations; null counts as empty.

    The scan compares once for each character and once for each failure link; with few
    states those are counted by place, with many a task follows the states.
    """
    patterns = check_patterns(patterns)
    made = Machine(patterns)
    if len(made.names) - 1 <= most_prefixes:
        whole = F.coalesce(text, F.lit(""))
        n = F.length(whole).cast("long")
        failed = failures(whole, {name: set(edges) for name, edges in zip(made.names, made.edges) if name})
        return df.select(key, (n + failed).alias("comparisons"), (n + made.work).alias("operations"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine(patterns)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            columns = [pa.array([machine.comparisons(t) for t in texts], pa.int64()), pa.array([machine.work + len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [key, "comparisons", "operations"])

    rows = df.select(key, F.col(text).alias("text"))
    return rows.mapInArrow(scan, f"`{key}` {rows.schema[key].dataType.simpleString()}, comparisons long, operations long")


def trie_counters(words: DataFrame, query: str, word: str = "word") -> DataFrame:
    """One row, ``comparisons, operations``: one for each character inserted; the walk along the query compares up to the first miss."""
    w = F.col(word)
    sums = words.where(w != "").agg(F.coalesce(F.sum(F.length(w)), F.lit(0)).alias("inserted"), F.coalesce(F.max(common_prefix(w, F.lit(query))), F.lit(0)).alias("found"))
    walked = F.least(F.lit(len(query)), F.col("found") + 1)
    return sums.select((F.col("inserted") + walked).cast("long").alias("comparisons"), F.col("inserted").cast("long").alias("operations"))


def lcp_counters(suffixes: DataFrame, df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, comparisons, operations`` of finding all common prefixes in text order, from a suffix array's ``rank, pos, lcp``.

    A suffix inherits all but one character of what the suffix before it in the text has
    in common, compares the rest and, unless one of the two ends there, one more.
    """
    by_rank, by_place = Window.partitionBy(key).orderBy("rank"), Window.partitionBy(key).orderBy("pos")
    rows = suffixes.withColumns({"__other": F.lag("pos").over(by_rank), "__kept": F.greatest(F.lag("lcp").over(by_place) - 1, F.lit(0))})
    rows = rows.where(F.col("__other").isNotNull()).join(df.select(key, F.length(text).alias("__n")), key)
    more = F.when(F.greatest("pos", "__other") + F.col("lcp") < F.col("__n"), 1).otherwise(0)
    compared = F.col("lcp") - F.coalesce("__kept", F.lit(0)) + more
    return rows.groupBy(key).agg(F.sum(compared).cast("long").alias("comparisons"), F.count(F.lit(1)).alias("operations"))


def index_counters(df: DataFrame, query: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row, ``comparisons, operations`` of building an index and answering a query with it.

    Every token indexed and every posting scored is an operation; every query term is a
    comparison, and so is each step of the merges that intersect the terms' lists, shortest
    first.  A merge of two lists takes as many steps as there are documents in either up to
    the smaller of their last ones, so no list is gathered.
    """
    asked = query_terms(query)
    have = tokens(F.col(text), remove_stop_words=True)
    rows = df.select(F.col(key).alias("k"), F.size(have).cast("long").alias("n"), *[F.array_contains(have, t).alias(f"h{i}") for i, t in enumerate(asked)])
    flags = [F.col(f"h{i}") for i in range(len(asked))]
    sums = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *[F.count_if(h).alias(f"d{i}") for i, h in enumerate(flags)])
    if not asked:
        return sums.select(F.lit(0).cast("long").alias("comparisons"), F.col("n").alias("operations"))
    sizes = sums.first()  # one number a term of the query
    order = sorted(range(len(asked)), key=lambda i: (sizes[f"d{i}"], i))
    both = flags[order[0]]
    merges = []  # (list so far, next list)
    for i in order[1:]:
        merges.append((both, flags[i]))
        both = both & flags[i]
    if merges:
        ends = rows.agg(*[F.least(F.max(F.when(a, F.col("k"))), F.max(F.when(b, F.col("k")))).alias(f"e{j}") for j, (a, b) in enumerate(merges)]).first()
        # least() passes over nulls, but an empty list ends a merge at once: so far empty stays empty, and a term's list is known.
        empty = rows.agg(*[F.count_if(a).alias(f"a{j}") for j, (a, _) in enumerate(merges)]).first()
        steps = [F.count_if((a | b) & (F.col("k") <= F.lit(ends[f"e{j}"]))) for j, (a, b) in enumerate(merges) if empty[f"a{j}"] and sizes[f"d{order[j + 1]}"]]
    else:
        steps = []
    compared = sum(steps, F.lit(len(asked)).cast("long"))
    scored = sum(sizes[f"d{i}"] for i in range(len(asked)))
    return rows.agg(compared.alias("comparisons"), (F.coalesce(F.sum("n"), F.lit(0)) + F.lit(scored)).alias("operations"))


def similarity_counters(df: DataFrame, text_a: str = "text", text_b: str = "textB", key: str = "doc_id") -> DataFrame:
    """``key, comparisons, operations``: one look-up for each distinct term of the first text, one operation for each token of both."""
    a, b = (tokens(F.col(c), remove_stop_words=True) for c in (text_a, text_b))
    return df.select(key, F.size(F.array_distinct(a)).cast("long").alias("comparisons"), (F.size(a) + F.size(b)).cast("long").alias("operations"))


def tfidf_counters(df: DataFrame, text: str = "text") -> DataFrame:
    """One row, ``comparisons, operations, memoryBytes``: one operation for each token and each weight; memory by weights and vocabulary."""
    found = tokens(F.col(text), remove_stop_words=True)
    rows = df.select(F.size(found).cast("long").alias("n"), F.array_distinct(found).alias("t"))
    sums = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.size("t")), F.lit(0)).alias("w"))
    vocabulary = rows.select(F.explode("t").alias("t")).agg(F.countDistinct("t").alias("v"))
    out = sums.join(vocabulary)  # both sides are one row
    return out.select(F.lit(0).cast("long").alias("comparisons"), (F.col("n") + F.col("w")).alias("operations"), (F.col("w") * 48 + F.col("v") * 64).alias("memoryBytes"))
