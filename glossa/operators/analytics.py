"""Edit distance, term weights, inverted index and set similarity."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from itertools import batched

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, round4, token_pattern, tokens
from ..sources.scratch import staged
from .matching import ValidationError

# Most cells of a full edit matrix, and of any.
FULL_MATRIX, MOST_CELLS = 4_000_000, 100_000_000
#: Cells up to which a matrix of lists is quicker than arrays.
SMALL_MATRIX = 4096
METHODS = ("cosine", "jaccard", "dice", "overlap")
#: Terms that may be too frequent for one task to join, at most.
HOT_TERMS = 1 << 15
#: Pairs whose results are put into an array at once.
AT_ONCE = 256


# Edit distance


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def edit_similarity(a: Column, b: Column) -> Column:
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def _next_row(row: np.ndarray, differ: np.ndarray, slope: np.ndarray) -> np.ndarray:
    """The row of costs below ``row``; ``differ`` tells where the row's character is another."""
    out = np.empty_like(row)
    out[0] = row[0] + 1
    out[1:] = np.minimum(row[1:] + 1, row[:-1] + differ)
    return np.minimum.accumulate(out - slope) + slope  # insertions run along the row


def _small_script(a: str, b: str) -> list[tuple[str, str, str]]:
    """The same path out of a whole matrix of lists, which short texts are done with before an array is made."""
    rows = [list(range(len(b) + 1))]
    for c in a:
        above, left = rows[-1], rows[-1][0] + 1
        row = [left]
        for d, corner, up in zip(b, above, above[1:]):
            if c != d:
                corner += 1
            if up < left:
                left = up
            left = corner if corner <= left else left + 1
            row.append(left)
        rows.append(row)
    out, i, j = [], len(a), len(b)
    while i or j:
        cost = rows[i][j]
        if i and j and cost == rows[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            out.append(("match" if a[i] == b[j] else "substitute", a[i], b[j]))
        elif i and cost == rows[i - 1][j] + 1:
            i -= 1
            out.append(("delete", a[i], ""))
        else:
            j -= 1
            out.append(("insert", "", b[j]))
    return out[::-1]


def edit_script(a: str, b: str, most_cells: int | None = FULL_MATRIX) -> list[tuple[str, str, str]] | None:
    """(op, a, b) of an optimal script, diagonal steps preferred, then deletions; None above ``most_cells`` cells.

    Only one row in about sqrt(n) of the matrix is kept.  The path is followed from the
    end, and the rows between two kept ones are made again when it gets there, so it is
    the path of the whole matrix in memory of about sqrt(n) rows.
    """
    n, m = len(a), len(b)
    if most_cells is not None and (n + 1) * (m + 1) > most_cells:
        return None
    if (n + 1) * (m + 1) <= SMALL_MATRIX:
        return _small_script(a, b)
    x, y = (np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in (a, b))
    slope = np.arange(m + 1, dtype=np.int32)
    stride = max(1, int(np.sqrt(n + 1)))
    row, kept = slope.copy(), []
    for i in range(n + 1):
        if i % stride == 0:
            kept.append(row)
        if i < n:
            row = _next_row(row, y != x[i], slope)
    out, i, j = [], n, m
    for k in reversed(range(len(kept))):
        first = k * stride
        rows = [kept[k]]
        while first + len(rows) <= i:
            rows.append(_next_row(rows[-1], y != x[first + len(rows) - 1], slope))
        # Within these rows; a step to the row above the first ends it.
        while i > first or (k == 0 and j):
            here, above = rows[i - first], rows[i - first - 1] if i > first else None
            if i and j and here[j] == above[j - 1] + (x[i - 1] != y[j - 1]):
                out.append(("match" if x[i - 1] == y[j - 1] else "substitute", a[i - 1], b[j - 1]))
                i, j = i - 1, j - 1
            elif i and here[j] == above[j] + 1:
                out.append(("delete", a[i - 1], ""))
                i -= 1
            else:
                out.append(("insert", "", b[j - 1]))
                j -= 1
    return out[::-1]


def alignment(a: Column, b: Column, most_cells: int | None = FULL_MATRIX) -> Column:
    """Edit script of each pair; null where the matrix would have more than ``most_cells`` cells or a text is null."""

    def one(x: str | None, y: str | None) -> list[dict] | None:
        found = edit_script(x, y, most_cells) if x is not None and y is not None else None
        return None if found is None else [dict(zip(("op", "a", "b"), s)) for s in found]

    @F.pandas_udf("array<struct<op:string,a:string,b:string>>")
    def align(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([one(x, y) for x, y in zip(xs, ys)], dtype=object)

    return align(a, b)


# Terms


def terms(df: DataFrame, text: str = "text", key: str = "doc_id", remove_stop_words: bool = True) -> DataFrame:
    """``key, pos, term`` of each token; positions count from 0 after stop words are gone."""
    return df.select(key, F.posexplode(tokens(F.col(text), remove_stop_words=remove_stop_words)).alias("pos", "term"))


def _run_starts(ordered: str) -> Column:
    """Indexes at which a run of equal elements begins in a column of sorted arrays."""
    starts = F.transform(ordered, lambda t, i: F.when((i == 0) | (t != F.get(ordered, i - 1)), i))
    return F.filter(starts, lambda i: i.isNotNull())


def _runs(ordered: str, starts: str) -> Column:
    """Array of ``term, cnt``: the runs of a column of sorted arrays."""
    ends = lambda at, k: F.coalesce(F.get(starts, k + 1), F.size(ordered)) - at
    return F.transform(starts, lambda at, k: F.struct(F.get(ordered, at).alias("term"), ends(at, k).cast("long").alias("cnt")))


def term_frequencies(df: DataFrame, text: str = "text", key: str = "doc_id", remove_stop_words: bool = True) -> DataFrame:
    """``key, term, cnt, len``: how often a document has a term and how many tokens it has; a row is a document, nothing is shuffled."""
    # Each step is a column of its own, so none is computed twice.
    rows = df.select(key, F.sort_array(tokens(F.col(text), remove_stop_words=remove_stop_words)).alias("__w")).withColumn("__s", _run_starts("__w"))
    return rows.select(key, F.size("__w").alias("len"), F.explode(_runs("__w", "__s")).alias("__t")).select(key, "__t.term", "__t.cnt", "len")


def document_frequencies(df: DataFrame, text: str = "text", remove_stop_words: bool = True) -> DataFrame:
    """``term, df``: one aggregate of each document's distinct terms."""
    rows = df.select(F.explode(F.array_distinct(tokens(F.col(text), remove_stop_words=remove_stop_words))).alias("term"))
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _documents(df: DataFrame, text: str) -> DataFrame:
    """One row, ``n``: documents that aren't blank."""
    return df.where(F.trim(text) != "").agg(F.count(F.lit(1)).alias("n"))


def _idf(df: DataFrame, text: str, often: DataFrame) -> DataFrame:
    """A table with ``df`` and its smoothed inverse; the number of documents is one row."""
    return often.join(F.broadcast(_documents(df, text))).withColumn("idf", F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).drop("n")


def idf(df: DataFrame, text: str = "text", key: str = "doc_id", remove_stop_words: bool = True) -> DataFrame:
    """``term, df, idf`` with ``idf = ln((1 + N) / (1 + df)) + 1``."""
    return _idf(df, text, document_frequencies(df, text, remove_stop_words))


def tfidf_weights(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, term, cnt, len, tf, df, idf, weight`` in long form.

    Terms that hold more than 1 / HOT_TERMS of all postings, of which there are fewer
    than HOT_TERMS, meet their postings by broadcast; the others, of which none is
    large, by a shuffle.
    """
    counts = term_frequencies(df, text, key)
    # Frequencies are wanted three times and counted once.
    often = staged(document_frequencies(df, text), "frequencies")
    bar = often.agg(F.floor(F.coalesce(F.sum("df"), F.lit(0)) / F.lit(HOT_TERMS)).alias("__bar"))
    model = _idf(df, text, often).join(F.broadcast(bar)).withColumn("__hot", F.col("df") > F.col("__bar")).drop("__bar")
    hot = model.where("__hot").select("term", F.col("df").alias("__df"), F.col("idf").alias("__idf"))
    rare = model.where("not __hot").select(F.col("term").alias("__term"), F.lit(0).alias("__part"), "df", "idf")
    # One pass over the documents: a frequent term has met its row already and goes on under no term, spread by document.
    rows = counts.join(F.broadcast(hot), "term", "left")
    met = F.col("__df").isNotNull()
    rows = rows.withColumns({"__term": F.when(~met, F.col("term")), "__part": F.when(met, F.pmod(F.xxhash64(key), F.lit(256)).cast("int")).otherwise(0)})
    rows = rows.join(rare, ["__term", "__part"], "left").withColumns({"df": F.coalesce("__df", "df"), "idf": F.coalesce("__idf", "idf")})
    tf = F.col("cnt") / F.col("len")
    return rows.select(key, "term", "cnt", "len", tf.alias("tf"), "df", "idf", (tf * F.col("idf")).alias("weight"))


def tfidf_global(df: DataFrame, text: str = "text", key: str = "doc_id", limit: int | None = 30) -> DataFrame:
    """``rank, term, score, df``: terms by their largest weight in any document, ties by term.

    One aggregate by term: a term's largest weight is its largest frequency times its idf.
    """
    counts = term_frequencies(df, text, key)
    best = _idf(df, text, counts.groupBy("term").agg(F.max(F.col("cnt") / F.col("len")).alias("tf"), F.count(F.lit(1)).alias("df")))
    best = best.select("term", "df", (F.col("tf") * F.col("idf")).alias("w"))
    if limit is None:
        return best.select("term", round4(F.col("w")).alias("score"), "df")
    top = best.orderBy(F.desc("w"), "term").limit(limit)
    return top.select(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("w"), "term")).alias("rank"), "term", round4(F.col("w")).alias("score"), "df")


def tfidf_top_terms(df: DataFrame, top_k: int = 10, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, rank, term, weight``: each document's heaviest terms, ties by term."""
    if not 1 <= top_k <= 100:
        raise ValidationError("topK must be from 1 to 100")
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("weight"), "term"))
    ranked = tfidf_weights(df, text, key).withColumn("rank", place).where(F.col("rank") <= top_k)
    return ranked.select(key, "rank", "term", round4(F.col("weight")).alias("weight"))


# Inverted index


def inverted_index(df: DataFrame, text: str = "text", key: str = "doc_id", most_positions: int | None = 50, wanted: list[str] | None = None) -> DataFrame:
    """``term, key, tf, positions``: one posting a row, so that no term's list has to fit in a task; of ``wanted`` terms alone, if given.

    A row is a document: its postings are runs of its sorted (term, position) pairs, and nothing is shuffled.
    """
    words = F.transform(tokens(F.col(text), remove_stop_words=True), lambda t, i: F.struct(t.alias("term"), i.alias("pos")))
    if wanted is not None:
        words = F.filter(words, lambda x: x["term"].isin(wanted or [""]))
    # Each step is a column of its own, so none is computed twice.
    rows = df.select(key, F.sort_array(words).alias("__w"))
    starts = F.transform("__w", lambda x, i: F.when((i == 0) | (x["term"] != F.get("__w", i - 1)["term"]), i))
    rows = rows.withColumn("__s", F.filter(starts, lambda i: i.isNotNull()))
    size = lambda at, k: F.coalesce(F.get("__s", k + 1), F.size("__w")) - at
    shown = lambda at, k: F.least(size(at, k), F.lit(most_positions)) if most_positions else size(at, k)
    posting = lambda at, k: F.struct(F.get("__w", at)["term"].alias("term"), size(at, k).cast("long").alias("tf"), F.transform(F.slice("__w", at + 1, shown(at, k)), lambda x: x["pos"]).alias("positions"))
    return rows.select(key, F.explode(F.transform("__s", posting)).alias("__p")).select("__p.term", key, "__p.tf", "__p.positions")


def index_stats(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row: ``documents, terms, postings``."""
    sums = document_frequencies(df, text).agg(F.count(F.lit(1)).alias("terms"), F.coalesce(F.sum("df"), F.lit(0)).alias("postings"))
    return _documents(df, text).join(sums).select(F.col("n").alias("documents"), "terms", "postings")


def top_terms(df: DataFrame, text: str = "text", key: str = "doc_id", limit: int = 20) -> DataFrame:
    """``rank, term, df, totalTf`` by document frequency, ties by first appearance.

    One aggregate finds the frequency that the last of the first ``limit`` has; only terms
    that reach it, which the first places and their ties are, are looked up again.
    """
    often = document_frequencies(df, text)
    bar = often.orderBy(F.desc("df")).limit(limit).agg(F.min("df").alias("bar"))
    reach = often.join(F.broadcast(bar), F.col("df") >= F.col("bar")).drop("bar")
    seen = terms(df, text, key).join(reach, "term")
    per_term = seen.groupBy("term").agg(F.first("df").alias("df"), F.count(F.lit(1)).alias("totalTf"), F.min(F.struct(key, "pos")).alias("first"))
    order = [F.desc("df"), F.col("first")]
    top = per_term.orderBy(*order).limit(limit)
    return top.select(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).alias("rank"), "term", "df", "totalTf")


def query_terms(query: str) -> list[str]:
    """Distinct tokens of a query without stop words, in order, as :func:`glossa.functions.text.tokens` finds them."""
    from ..functions.text import TOKEN_CHARS

    found = (t.strip("'") for t in re.findall(f"[{TOKEN_CHARS}]+", query[:500].lower()))
    return list(dict.fromkeys(t for t in found if t and t not in STOP_WORDS))


def and_query(df: DataFrame, query: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` of the documents that have all terms of the query; none if it has no terms.

    Decided within each row, so nothing is shuffled.
    """
    wanted = query_terms(query)
    if not wanted:
        return df.select(key).where(F.lit(False))
    have = tokens(F.col(text))
    return df.select(key, have.alias("__w")).where(F.size(F.array_except(F.array(*[F.lit(w) for w in wanted]), "__w")) == 0).select(key)


def or_query(df: DataFrame, query: str, text: str = "text", key: str = "doc_id", limit: int | None = 50) -> DataFrame:
    """``rank, key, matched, score, terms``: by number of terms, then by their total count, then by first term and key.

    A row is a document, so it is scored where it is; only the first ``limit`` meet.
    """
    wanted = query_terms(query)
    words = F.array(*[F.lit(w) for w in wanted or [""]])
    hits = F.filter(tokens(F.col(text)), lambda t: t.isin(wanted or [""]))
    rows = df.select(key, F.transform(hits, lambda t: F.array_position(words, t).cast("int")).alias("__h")).where(F.size("__h") > 0)
    places = F.array_sort(F.array_distinct("__h"))
    found = rows.select(key, F.size(places).cast("long").alias("matched"), F.size("__h").cast("long").alias("score"), F.array_min("__h").alias("first"), F.transform(places, lambda p: F.element_at(words, p)).alias("terms"))
    order = [F.desc("matched"), F.desc("score"), F.col("first"), F.col(key)]
    if limit is not None:
        found = found.orderBy(*order).limit(limit)
    return found.select(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).alias("rank"), key, "matched", "score", "terms")


def query_postings(df: DataFrame, query: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``term, key, tf, positions`` of the query's terms alone; other terms never leave their rows."""
    return inverted_index(df, text, key, wanted=query_terms(query))


# Similarity


def _of_counts(a: Column, b: Column, kind: pa.DataType, spark_kind: str, of: Callable[[Counter, Counter], object]) -> Column:
    """``of`` the counts of two texts' terms, as ``kind``, which Spark calls ``spark_kind``; null where a text is null."""
    find = re.compile(token_pattern()).findall

    def counts(text: str) -> Counter:
        found = Counter(find(text))
        for word in STOP_WORDS:
            found.pop(word, None)
        return found

    @F.arrow_udf(spark_kind)
    def compared(xs: pa.Array, ys: pa.Array) -> pa.Array:
        pairs = ((x.as_py(), y.as_py()) for x, y in zip(xs, ys))
        found = (None if x is None or y is None else of(counts(x), counts(y)) for x, y in pairs)
        # Only some rows at a time are Python's objects.
        return pa.concat_arrays([pa.array(part, kind) for part in batched(found, AT_ONCE)] or [pa.array([], kind)])

    return compared(F.lower(a), F.lower(b))


def _dot_and_squares(a: Column, b: Column) -> Column:
    """``dot, squaresA, squaresB``: the product of both texts' vectors of term counts, and each with itself."""

    def of(x: Counter, y: Counter) -> dict[str, int]:
        own = [sum([n * n for n in side.values()]) for side in (x, y)]
        return {"dot": sum([x[t] * y[t] for t in x.keys() & y.keys()]), "squaresA": own[0], "squaresB": own[1]}

    return _of_counts(a, b, pa.struct([(c, pa.int64()) for c in ("dot", "squaresA", "squaresB")]), "dot long, squaresA long, squaresB long", of)


def _contributions(a: Column, b: Column) -> Column:
    """Array of ``product, term`` of the terms that both texts have, the greatest product first, then by term."""

    def of(x: Counter, y: Counter) -> list[dict[str, object]]:
        found = sorted((-x[t] * y[t], t) for t in x.keys() & y.keys())
        return [{"product": -less, "term": t} for less, t in found]

    return _of_counts(a, b, pa.list_(pa.struct([("product", pa.int64()), ("term", pa.string())])), "array<struct<product:long,term:string>>", of)


def similarity(df: DataFrame, text_a: str = "text", text_b: str = "textB", method: str = "cosine") -> DataFrame:
    """``df`` with ``score`` by ``method``, all four measures, shared and one-sided terms, contributions and token counts.

    Everything is computed within the row, and only what is used of it; empty sides score
    0.  Counts of terms are taken in Python, in time linear in the texts.  To list
    ``contributions``, use ``explode_outer``: below a plain ``explode`` the optimizer
    filters by their number and computes them once more for that.
    """
    if method not in METHODS:
        raise ValidationError(f"unknown method {method!r}; one of {', '.join(METHODS)}")
    rows = df.withColumns({"__a": tokens(F.col(text_a), remove_stop_words=True), "__b": tokens(F.col(text_b), remove_stop_words=True)})
    rows = rows.withColumns({"__da": F.array_distinct("__a"), "__db": F.array_distinct("__b")})
    rows = rows.withColumn("__p", _dot_and_squares(F.col(text_a), F.col(text_b)))
    rows = rows.withColumns(
        {
            "sharedTerms": F.array_intersect("__da", "__db"),
            "onlyInA": F.array_except("__da", "__db"),
            "onlyInB": F.array_except("__db", "__da"),
            "contributions": _contributions(F.col(text_a), F.col(text_b)),
            "__both": F.size(F.array_intersect("__da", "__db")),
        }
    )
    # The product of both squares may be beyond a long; as doubles they are whole up to 2**53, so it is rounded once.
    dot, length = F.col("__p.dot"), F.sqrt(F.col("__p.squaresA").cast("double") * F.col("__p.squaresB").cast("double"))
    both, a, b = F.col("__both"), F.size("__da"), F.size("__db")
    ratio = lambda up, down: F.when(down > 0, up / down).otherwise(F.lit(0.0))
    rows = rows.withColumns(
        {
            "cosine": ratio(dot, length),
            "jaccard": ratio(both, a + b - both),
            "dice": ratio(2 * both, a + b),
            "overlap": ratio(both, F.least(a, b)),
            "tokensA": F.size("__a"),
            "tokensB": F.size("__b"),
        }
    )
    return rows.withColumn("score", round4(F.col(method))).drop(*(c for c in rows.columns if c.startswith("__")))
