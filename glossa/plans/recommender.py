"""Rule-based advice on algorithms for a table of workload profiles, as one expression per algorithm."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matching import ValidationError
from .registry import META

# The fields of a profile with their defaults, the values of its choices, and the tasks.
PROFILE = {
    "task": ("string", "single-pattern"),
    "textSize": ("double", 100_000.0),
    "patternSize": ("double", 8.0),
    "patternCount": ("double", 1.0),
    "documentCount": ("double", 1.0),
    "repetition": ("string", "low"),
    "alphabet": ("string", "large"),
    "queryFrequency": ("string", "once"),
    "needIndexing": ("boolean", False),
    "streaming": ("boolean", False),
}
CHOICES = {"repetition": ("low", "medium", "high"), "alphabet": ("small", "large"), "queryFrequency": ("once", "occasional", "frequent")}
TASKS = (
    "single-pattern", "multi-pattern", "prefix-lookup", "substring-queries", "repeat-analysis",
    "fuzzy-match", "keyword-ranking", "document-search", "document-similarity",
)
MOST_NUMBER = 1e10
#: Order in which equal scores are listed.
ORDER = ("naive", "kmp", "boyer-moore", "rabin-karp", "aho-corasick", "trie", "suffix-array", "kasai", "edit-distance", "tfidf", "inverted-index", "similarity")


def parse_profiles(raw: DataFrame) -> DataFrame:
    """A table of profiles as text, null where a field isn't given, with every field in its type and bounds.

    Numbers that aren't or are negative take their default, others end at MOST_NUMBER, and
    there is one pattern at least; choices other than the known ones take their default; a
    flag is set unless its text is empty, ``false``, ``no`` or ``0``.  An unknown task is an
    error of the query.  Other columns stay.
    """
    out = {}
    for name, (kind, default) in PROFILE.items():
        c = F.col(name)
        if name == "task":
            out[name] = F.when(c.isin(*TASKS), c).otherwise(F.raise_error(F.concat(F.lit(f"unknown task; use one of {', '.join(TASKS)}: "), F.coalesce(c, F.lit("none")))).cast("string"))
        elif kind == "double":
            number = c.try_cast("double")
            fine = number.isNotNull() & ~F.isnan(number) & (number >= 0) & (number < float("inf"))
            value = F.when(fine, F.least(number, F.lit(MOST_NUMBER))).otherwise(F.lit(default))
            out[name] = F.greatest(F.lit(1.0), value) if name == "patternCount" else value
        elif kind == "boolean":
            out[name] = ~F.lower(F.coalesce(c, F.lit(""))).isin("", "false", "no", "0")
        else:
            out[name] = F.when(c.isin(*CHOICES[name]), c).otherwise(F.lit(default))
    return raw.withColumns(out)


def profiles(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A table of profiles with defaults filled in and a ``profile_id``; an unknown task is refused at once."""
    for r in rows:
        if r.get("task", PROFILE["task"][1]) not in TASKS:
            raise ValidationError(f"unknown task {r.get('task')!r}; use one of {', '.join(TASKS)}")
    text = lambda v: None if v is None else str(v)
    data = [(i, *(text(r.get(k, PROFILE["task"][1] if k == "task" else None)) for k in PROFILE)) for i, r in enumerate(rows)]
    return parse_profiles(spark.createDataFrame(data, "profile_id int, " + ", ".join(f"{k} string" for k in PROFILE)))


_SINGLE, _MANY = ("task", "=", "single-pattern"), ("patternCount", ">", 1)
_MULTI = ([("task", "=", "multi-pattern")], [_SINGLE, _MANY])

# Points of each algorithm, and the fields of a profile that give them.  A rule marked True makes the algorithm applicable.
RULES: dict[str, list[tuple[bool, int, list[tuple[str, str, object]]]]] = {
    "naive": [(True, 40, [_SINGLE]), (False, 20, [_SINGLE, ("patternSize", "<=", 3)]), (False, 10, [_SINGLE, ("textSize", "<", 10_000)]), (False, -30, [("repetition", "=", "high")])],
    "kmp": [(True, 60, [_SINGLE]), (False, 20, [_SINGLE, ("repetition", "<>", "low")]), (False, 10, [_SINGLE, ("alphabet", "=", "small")]), (False, 15, [("streaming", "=", True)])],
    "boyer-moore": [
        (True, 55, [_SINGLE]), (False, 15, [_SINGLE, ("alphabet", "=", "large")]), (False, 15, [_SINGLE, ("patternSize", ">=", 8)]),
        (False, -15, [("alphabet", "=", "small")]), (False, -15, [("repetition", "=", "high")]),
    ],
    "rabin-karp": [(True, 45, [_SINGLE]), (True, 30, [("task", "=", "multi-pattern")]), (False, 35, [("task", "=", "document-similarity")]), (False, -10, [("repetition", "=", "high")])],
    "aho-corasick": [*((True, 85, m) for m in _MULTI), *((False, 10, [*m, ("patternCount", ">=", 10)]) for m in _MULTI)],
    "trie": [(True, 90, [("task", "=", "prefix-lookup")]), *((True, 45, [*m, ("queryFrequency", "=", "frequent")]) for m in _MULTI)],
    "suffix-array": [(True, 85, [("task", "=", "substring-queries")]), (True, 70, [_SINGLE, ("queryFrequency", "=", "frequent"), ("needIndexing", "=", True)])],
    "kasai": [(True, 90, [("task", "=", "repeat-analysis")]), (True, 50, [("task", "=", "substring-queries")])],
    "edit-distance": [(True, 90, [("task", "=", "fuzzy-match"), ("textSize", "<=", 5000)]), (True, 55, [("task", "=", "fuzzy-match"), ("textSize", ">", 5000)])],
    "tfidf": [(True, 90, [("task", "=", "keyword-ranking")]), (True, 55, [("task", "=", "document-search")])],
    "inverted-index": [(True, 90, [("task", "=", "document-search")]), (True, 60, [("task", "<>", "document-search"), ("needIndexing", "=", True), ("documentCount", ">", 1)])],
    "similarity": [(True, 85, [("task", "=", "document-similarity")])],
}

_RELATIONS = {
    "=": ("is", operator.eq), "<>": ("is not", operator.ne), "<": ("is below", operator.lt),
    "<=": ("is at most", operator.le), ">": ("is above", operator.gt), ">=": ("is at least", operator.ge),
}


def _holds(terms: list[tuple[str, str, object]]) -> Column:
    return reduce(operator.and_, (_RELATIONS[relation][1](F.col(field), value) for field, relation, value in terms))


def _said(points: int, terms: list[tuple[str, str, object]]) -> Column:
    """A rule in words, with what the profile has in its fields."""
    parts: list[Column] = []
    for field, relation, value in terms:
        shown = f"{value:,}" if isinstance(value, int) and not isinstance(value, bool) else str(value).lower()
        own = F.format_number(F.col(field), 0) if PROFILE[field][0] == "double" else None
        parts.append(F.concat(F.lit(f"{field} ("), own, F.lit(f") {_RELATIONS[relation][0]} {shown}")) if own is not None else F.lit(f"{field} {_RELATIONS[relation][0]} {shown}"))
    return F.concat(F.concat_ws(", ", *parts), F.lit(f": {points:+d}"))


def scores() -> dict[str, tuple[Column, Column]]:
    """(applicable, score before bounds) of each algorithm over the columns of a profile."""
    out = {}
    for name, rules in RULES.items():
        points = [F.when(_holds(terms), value).otherwise(0) for _, value, terms in rules]
        out[name] = reduce(operator.or_, (_holds(terms) for opens, _, terms in rules if opens)), reduce(operator.add, points)
    return out


def grounds() -> dict[str, tuple[list[tuple[Column, Column]], list[tuple[Column, Column]]]]:
    """(reasons, cautions) of each algorithm, each a condition and what is said where it holds: the rules that gain points, and those that cost some or let none apply."""
    out, applicable = {}, scores()
    for name, rules in RULES.items():
        lines = {True: [], False: []}
        for _, points, terms in rules:
            lines[points > 0].append((_holds(terms), _said(points, terms)))
        opening = [", ".join(f"{f} {_RELATIONS[r][0]} {str(v).lower()}" for f, r, v in terms) for opens, _, terms in rules if opens]
        out[name] = lines[True], [*lines[False], (~applicable[name][0], F.lit(f"applies only if {'; or '.join(opening)}"))]
    return out


def recommend(df: DataFrame, key: str = "profile_id") -> DataFrame:
    """``key, rank, algorithmId, name, applicable, score, reasons, cautions, complexity``: twelve rows a profile, applicable ones first, then by score."""
    rules, said = scores(), grounds()
    texts = lambda pairs: F.array_compact(F.array(*[F.when(when, text) for when, text in pairs])) if pairs else F.array().cast("array<string>")
    entries = [
        F.struct(
            F.lit(i).alias("place"),
            F.lit(a).alias("algorithmId"),
            F.lit(META[a][0]).alias("name"),
            rules[a][0].alias("applicable"),
            F.greatest(F.lit(0), F.least(F.lit(100), rules[a][1])).alias("score"),
            texts(said[a][0]).alias("reasons"),
            texts(said[a][1]).alias("cautions"),
            F.lit(f"{META[a][2]} worst, {META[a][3]} space").alias("complexity"),
        )
        for i, a in enumerate(ORDER)
    ]
    # The fields stand in dozens of rules; an explode keeps what they are made from out of each.
    given = df.select(key, F.explode_outer(F.array(F.struct(*PROFILE))).alias("__p")).select(key, "__p.*")
    # A profile's twelve entries are one row's array, so they are ranked in the row.
    placed = lambda e: F.struct((~e["applicable"]).alias("no"), (-e["score"]).alias("low"), e["place"].alias("place"), e.alias("entry"))
    rows = given.select(key, F.posexplode_outer(F.array_sort(F.transform(F.array(*entries), placed))).alias("__at", "__e"))
    columns = ("algorithmId", "name", "applicable", "score", "reasons", "cautions", "complexity")
    return rows.select(key, (F.col("__at") + 1).alias("rank"), *[F.col(f"__e.entry.{c}").alias(c) for c in columns])


def explanation(df: DataFrame, key: str = "profile_id") -> DataFrame:
    """``key, explanation``: the first three applicable algorithms in a sentence."""
    first = recommend(df, key).where("applicable and rank <= 3").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "name"))).alias("r"))
    names = F.array_join("r.name", ", ")
    said = F.when(F.col("r").isNull(), "No algorithm here is made for this combination.").otherwise(F.concat(F.lit("For "), F.col("task"), F.lit(": "), names, F.lit(". Scores follow from the rules listed; measure to be sure.")))
    return df.select(key, "task").join(first, key, "left").select(key, said.alias("explanation"))


def suggested_workload() -> Column:
    return (
        F.when(F.col("repetition") == "high", "repetitive")
        .when(F.col("patternCount") > 1, "pattern-heavy")
        .when(F.col("textSize") >= 500_000, "large")
        .when(F.col("textSize") >= 50_000, "medium")
        .otherwise("small")
    )


def verification(df: DataFrame, key: str = "profile_id") -> DataFrame:
    """``key, algorithms, workload, size, patternLength, patternCount``: the first five applicable algorithms and a workload to compare them on."""
    first = recommend(df, key).where("applicable and rank <= 5").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "algorithmId"))).alias("r"))
    bounded = lambda name, low, high: F.least(F.greatest(F.col(name), F.lit(float(low))), F.lit(float(high))).alias(name)
    rows = df.select(key, suggested_workload().alias("workload"), bounded("textSize", 1000, 1_000_000).alias("size"), bounded("patternSize", 1, 200).alias("patternLength"), bounded("patternCount", 1, 200))
    return rows.join(first, key, "left").select(key, F.coalesce(F.col("r.algorithmId"), F.array().cast("array<string>")).alias("algorithms"), "workload", "size", "patternLength", "patternCount")
