"""Exact single-pattern matching: overlapping positions, counts, tables and work counters.

All single-pattern algorithms have the same answer, so they share one physical
operator on Spark's own expressions.  Their tables depend on the pattern alone and
are made on the driver; work counters that follow a sequential scan run as Arrow UDFs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import quoted

# The rolling hash.
HASH_BASE, HASH_MODULUS = 256, 1_000_003


class ValidationError(ValueError):
    """An argument that no operator accepts."""


def check_pattern(pattern: str) -> str:
    if not isinstance(pattern, str) or not pattern:
        raise ValidationError("the pattern must not be empty")
    if len(pattern) > 10_000:
        raise ValidationError("the pattern must not have more than 10,000 characters")
    return pattern


def match_count(text: Column, pattern: str) -> Column:
    """Number of occurrences, overlapping ones included."""
    return F.regexp_count(text, F.lit(f"(?={quoted(check_pattern(pattern))})"))


def match_positions(df: DataFrame, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per occurrence: ``key, pos``; keys must be unique.

    The text is split in front of each occurrence; positions are running sums of the
    lengths of the pieces.  Texts without the pattern are filtered before.
    """
    check_pattern(pattern)
    source = df.select(F.col(key), F.col(text).alias("__text")).where(F.contains("__text", F.lit(pattern)))
    pieces = source.select(key, F.startswith("__text", F.lit(pattern)).alias("__at0"), F.posexplode(F.split("__text", f"(?={quoted(pattern)})", -1)).alias("__k", "__piece"))
    pieces = pieces.select(key, "__at0", "__k", F.length("__piece").alias("__len"))
    before = Window.partitionBy(key).orderBy("__k").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("pos", F.coalesce(F.sum("__len").over(before), F.lit(0)).cast("int"))
    return placed.where((F.col("__k") > 0) | F.col("__at0")).select(key, "pos")


def matches(df: DataFrame, pattern: str, text: str = "text", key: str = "doc_id", limit: int | None = 1000) -> DataFrame:
    """``df``'s keys with ``matches`` (ascending, the first ``limit``) and ``totalMatches``."""
    found = match_positions(df, pattern, text, key).groupBy(key).agg(F.array_sort(F.collect_list("pos")).alias("m"))
    out = df.select(key).join(found, key, "left").withColumn("m", F.coalesce("m", F.array().cast("array<int>")))
    shown = F.slice("m", 1, limit) if limit is not None else F.col("m")
    return out.select(key, shown.alias("matches"), F.size("m").alias("totalMatches"))


def naive_comparisons(text: Column, pattern: str) -> Column:
    """Character comparisons of the plain scan, in closed form: at each shift, the prefixes that match and one more."""
    m = len(check_pattern(pattern))
    n = F.length(text)
    total = (n - m + 1).cast("long")
    for j in range(1, m):
        total = total + match_count(F.substring(text, 1, n - m + j), pattern[:j])
    return F.when(n >= m, total).otherwise(F.lit(0).cast("long"))


def naive_operations(text: Column, pattern: str) -> Column:
    return F.greatest(F.length(text) - len(check_pattern(pattern)) + 1, F.lit(0)).cast("long")


def lps(pattern: str) -> list[int]:
    """For each prefix the length of its longest proper prefix that is also its suffix."""
    return _lps(pattern)[0]


def lps_work(pattern: str) -> int:
    """Comparisons that making the table takes."""
    return _lps(pattern)[1]


def _lps(pattern: str) -> tuple[list[int], int]:
    table, work, k = [0] * len(pattern), 0, 0
    i = 1
    while i < len(pattern):
        work += 1
        if pattern[i] == pattern[k]:
            k += 1
            table[i] = k
            i += 1
        elif k:
            k = table[k - 1]
        else:
            i += 1
    return table, work


def bad_character(pattern: str) -> dict[str, int]:
    """Last place of each character."""
    return {c: i for i, c in enumerate(pattern)}


def good_suffix(pattern: str) -> list[int]:
    """Shift for each number of characters left when a suffix has matched."""
    return _good_suffix(pattern)[0]


def good_suffix_work(pattern: str) -> int:
    """Comparisons that making the shifts takes."""
    return _good_suffix(pattern)[1]


def _good_suffix(pattern: str) -> tuple[list[int], int]:
    m, work = len(pattern), 0
    shift, edge = [0] * (m + 1), [m + 1] * (m + 1)
    wide = m + 1
    for i in range(m, 0, -1):
        while wide <= m and pattern[i - 1] != pattern[wide - 1]:
            work += 1
            shift[wide] = shift[wide] or wide - i
            wide = edge[wide]
        wide -= 1
        edge[i - 1] = wide
    wide = edge[0]
    for i in range(m + 1):
        shift[i] = shift[i] or wide
        if i == wide:
            wide = edge[wide]
    return shift, work


def pattern_hash(pattern: str) -> int:
    value = 0
    for c in pattern:
        value = (value * HASH_BASE + ord(c)) % HASH_MODULUS
    return value


def _kmp_scan(text: str, pattern: str, table: list[int]) -> tuple[int, int]:
    compared = changed = i = j = 0
    n, m = len(text), len(pattern)
    while i < n:
        compared += 1
        if text[i] == pattern[j]:
            i, j = i + 1, j + 1
            if j == m:
                changed += 1
                j = table[j - 1]
        elif j:
            changed += 1
            j = table[j - 1]
        else:
            i += 1
    return compared, changed


def _boyer_moore_scan(text: str, pattern: str, shift: list[int], last: dict[str, int]) -> tuple[int, int]:
    compared = aligned = s = 0
    n, m = len(text), len(pattern)
    while s <= n - m:
        aligned += 1
        j = m - 1
        while j >= 0:
            compared += 1
            if pattern[j] != text[s + j]:
                break
            j -= 1
        s += shift[0] if j < 0 else max(shift[j + 1], j - last.get(text[s + j], -1))
    return compared, aligned


#: Up to so many prefixes failures are counted by one expression each; above, a task's scan is faster.
MOST_PREFIXES = 24


def _codes(text: str) -> str:
    return "".join(f"\\x{{{ord(c):x}}}" for c in text)


def failures(text: Column, edges: dict[str, set[str]]) -> Column:
    """How often a scan follows a failure link, for the prefixes in ``edges`` and the characters that go on from each.

    At a character, the scan tries the prefixes that end there, longest first, up to the
    first that goes on with it.  So a prefix fails where it is followed by none of its
    characters, and no longer prefix that ends with it is followed by one of its own.
    Each prefix is a pattern of places; nothing is scanned step by step.
    """
    total = F.lit(0).cast("long")
    for x, onward in edges.items():
        other = f"[^{_codes(''.join(sorted(onward)))}]" if onward else r"[\s\S]"
        place = f"(?={_codes(x)}{other})"
        for y, more in edges.items():
            if more and len(y) > len(x) and y.endswith(x):
                place += f"(?!(?<={_codes(y[: -len(x)])}){_codes(x)}[{_codes(''.join(sorted(more)))}])"
        total = total + F.regexp_count(text, F.lit(place))
    return total


def kmp_counters(text: Column, pattern: str, most_prefixes: int = MOST_PREFIXES) -> Column:
    """Struct ``comparisons, operations`` of the scan with a failure table, its construction included.

    A scan compares once for each character and once more after each failure; failures
    and matches are its operations.
    """
    table, work = _lps(check_pattern(pattern))
    m = len(pattern)
    if m - 1 <= most_prefixes:
        whole = F.coalesce(text, F.lit(""))
        failed = failures(whole, {pattern[:k]: {pattern[k]} for k in range(1, m)})
        # A scan of a text that is shorter than the pattern isn't begun.
        begun = lambda n: work + F.when(F.length(whole) >= m, n).otherwise(F.lit(0).cast("long"))
        return F.struct(begun(F.length(whole) + failed).alias("comparisons"), begun(failed + match_count(whole, pattern)).alias("operations"))

    @F.pandas_udf("comparisons long, operations long")
    def count(texts: pd.Series) -> pd.DataFrame:
        found = [_kmp_scan(t or "", pattern, table) if len(t or "") >= len(pattern) else (0, 0) for t in texts]
        return pd.DataFrame([(work + a, work + b) for a, b in found], columns=["comparisons", "operations"])

    return count(text)


def boyer_moore_counters(text: Column, pattern: str) -> Column:
    """Struct ``comparisons, operations`` of the right-to-left scan, the good-suffix table's construction included."""
    shift, work = _good_suffix(check_pattern(pattern))
    last = bad_character(pattern)

    @F.pandas_udf("comparisons long, operations long")
    def count(texts: pd.Series) -> pd.DataFrame:
        found = [_boyer_moore_scan(t or "", pattern, shift, last) for t in texts]
        return pd.DataFrame([(work + a, b) for a, b in found], columns=["comparisons", "operations"])

    return count(text)


def rabin_karp_counters(text: Column, pattern: str) -> Column:
    """Struct ``hashHits, spuriousHits, comparisons, operations`` of the rolling-hash scan."""
    wanted, m = pattern_hash(check_pattern(pattern)), len(pattern)
    codes = np.array([ord(c) for c in pattern], np.int64)

    @F.pandas_udf("hashHits long, spuriousHits long, comparisons long, operations long")
    def count(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            data = np.frombuffer((t or "").encode("utf-32-le"), np.uint32).astype(np.int64)
            n = len(data)
            if n < m:
                out.append((0, 0, 0, 0))
                continue
            value = np.zeros(n - m + 1, np.int64)
            for k in range(m):
                value = (value * HASH_BASE + data[k : k + n - m + 1]) % HASH_MODULUS
            hits = np.flatnonzero(value == wanted)
            checked = real = 0
            for at in hits:
                differ = np.flatnonzero(data[at : at + m] != codes)
                checked += int(differ[0]) + 1 if len(differ) else m
                real += not len(differ)
            out.append((len(hits), len(hits) - real, n - m + 1 + checked, 2 * m + n - m))
        return pd.DataFrame(out, columns=["hashHits", "spuriousHits", "comparisons", "operations"])

    return count(text)


def estimated_memory(algorithm: str, pattern: str) -> int:
    """Bytes of each algorithm's tables, by the model of its description."""
    m = len(pattern)
    return {"naive": 0, "kmp": 8 * m, "rabin-karp": 32, "boyer-moore": 16 * (m + 1) + 40 * len(set(pattern))}[algorithm]
