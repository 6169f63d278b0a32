"""The twelve algorithms: metadata, input checks, and one call that runs any of them on one input."""

from __future__ import annotations

import sys
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics as an
from ..operators import counters as co
from ..operators import matching as ma
from ..operators import multi_pattern as mp
from ..operators import structures as st
from ..operators.matching import ValidationError

# Categories, and per algorithm its name, category, growth bounds, cost model and largest benchmark input.
CATEGORIES = {
    "string-matching": "String Matching",
    "multi-pattern": "Multi-Pattern Matching",
    "text-structures": "Text Structures",
    "text-analytics": "Text Analytics",
}
META = {
    "naive": ("Naive String Matching", "string-matching", "O(n·m)", "O(1)", "nm", 2_000_000),
    "kmp": ("Knuth–Morris–Pratt (KMP)", "string-matching", "O(n + m)", "O(m)", "n+m", 5_000_000),
    "rabin-karp": ("Rabin–Karp", "string-matching", "O(n·m)", "O(1)", "n+m", 5_000_000),
    "boyer-moore": ("Boyer–Moore", "string-matching", "O(n·m)", "O(m + σ)", "n/m", 5_000_000),
    "aho-corasick": ("Aho–Corasick", "multi-pattern", "O(n + m + z)", "O(m · σ)", "n+z", 5_000_000),
    "trie": ("Trie (Prefix Tree)", "text-structures", "O(L)", "O(total characters · σ)", "L", 3_000_000),
    "suffix-array": ("Suffix Array", "text-structures", "O(n log² n)", "O(n)", "nlog2n", 100_000),
    "kasai": ("Kasai LCP Array", "text-structures", "O(n)", "O(n)", "nlog2n", 100_000),
    "edit-distance": ("Edit Distance (Levenshtein)", "text-analytics", "O(n·m)", "O(n·m)", "mn", 5_000),
    "tfidf": ("TF-IDF", "text-analytics", "O(T + D·V)", "O(D·V)", "n", 3_000_000),
    "inverted-index": ("Inverted Index", "text-analytics", "O(T)", "O(T)", "n", 3_000_000),
    "similarity": ("Text Similarity", "text-analytics", "O(n + m)", "O(V)", "n", 3_000_000),
}
#: Characters of one text and of all documents, documents, and characters of a query.
MOST_TEXT, MOST_DOCUMENTS, MOST_QUERY = 5_000_000, 20_000, 1000


@dataclass
class Input:
    """What an algorithm reads; each takes the fields it knows."""

    text: str | None = None
    pattern: str | None = None
    patterns: list[str] | None = None
    documents: list[str] | None = None
    query: str | None = None
    text_b: str | None = None
    method: str = "cosine"
    top_k: int = 10


@dataclass
class Result:
    """An algorithm's answer and what its run cost."""

    algorithm: str
    output: dict[str, Any]
    summary: str
    metrics: dict[str, float]
    preview: str = ""
    complexity: dict[str, str] = field(default_factory=dict)
    steps: list[dict] = field(default_factory=list)
    truncated: bool = False


def metadata(spark: SparkSession) -> DataFrame:
    """``id, name, category, worst, space, model, maxBenchmarkSize``."""
    return spark.createDataFrame([(k, *v) for k, v in META.items()], "id string, name string, category string, worst string, space string, model string, maxBenchmarkSize int")


def categories(spark: SparkSession) -> DataFrame:
    """``category, name, algorithms, count``."""
    names = spark.createDataFrame(list(CATEGORIES.items()), "category string, label string")
    return metadata(spark).join(names, "category").groupBy("category", "label").agg(F.array_sort(F.collect_list("id")).alias("algorithms"), F.count(F.lit(1)).alias("count"))


def checked_text(text: str | None, name: str = "text") -> str:
    if not text:
        raise ValidationError(f"the {name} must not be empty")
    if len(text) > MOST_TEXT:
        raise ValidationError(f"the {name} has more than {MOST_TEXT:,} characters")
    return text


def checked_documents(documents: list[str] | None) -> list[str]:
    kept = [d for d in documents or [] if d.strip()]
    if not kept:
        raise ValidationError("at least one document is needed")
    if len(kept) > MOST_DOCUMENTS or sum(map(len, kept)) > MOST_TEXT:
        raise ValidationError("too many documents")
    return kept


def _pattern_in(given: Input) -> tuple[str, str]:
    text, pattern = checked_text(given.text), ma.check_pattern(given.pattern or "")
    if len(pattern) > len(text):
        raise ValidationError("the pattern is longer than the text")
    return text, pattern


def _one(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(0, text)], "doc_id long, text string")


def _matcher(algorithm: str) -> Callable[[SparkSession, Input], tuple[dict, str, dict]]:
    def run(spark: SparkSession, given: Input) -> tuple[dict, str, dict]:
        text, pattern = _pattern_in(given)
        df, t = _one(spark, text), F.col("text")
        found = ma.matches(df, pattern).first()
        out = {"matches": found["matches"], "totalMatches": found["totalMatches"]}
        if algorithm == "naive":
            work = df.select(ma.naive_comparisons(t, pattern).alias("comparisons"), ma.naive_operations(t, pattern).alias("operations")).first().asDict()
        elif algorithm == "kmp":
            work = df.select(ma.kmp_counters(t, pattern).alias("w")).first()["w"].asDict()
            out["lps"] = ma.lps(pattern)[:500]
        elif algorithm == "boyer-moore":
            work = df.select(ma.boyer_moore_counters(t, pattern).alias("w")).first()["w"].asDict()
            out |= {"goodSuffix": ma.good_suffix(pattern)[:200], "badCharacter": dict(list(ma.bad_character(pattern).items())[:100])}
        else:
            work = df.select(ma.rabin_karp_counters(t, pattern).alias("w")).first()["w"].asDict()
            out |= {"patternHash": ma.pattern_hash(pattern), "hashHits": work.pop("hashHits"), "spuriousHits": work.pop("spuriousHits"), "base": ma.HASH_BASE, "modulus": ma.HASH_MODULUS}
        work["memoryBytes"] = ma.estimated_memory(algorithm, pattern)
        n = found["totalMatches"]
        where = f" at index {', '.join(map(str, out['matches'][:10]))}{', …' if n > 10 else ''}" if n else ""
        return out, f"Found {n} occurrence{'' if n == 1 else 's'}{where}.", work

    return run


def _aho_corasick(spark: SparkSession, given: Input) -> tuple[dict, str, dict]:
    text, patterns = checked_text(given.text), mp.check_patterns(given.patterns or [])
    df = _one(spark, text)
    rows = mp.find_many(df, patterns).orderBy(*mp.emission_order()).select("pattern", F.col("pos").alias("index"))
    counts = [(r["pattern"], r["matches"]) for r in mp.pattern_counts(df, patterns).orderBy("pattern_id").collect()]
    states, total = mp.automaton_states(spark, patterns).first()["states"], sum(n for _, n in counts)
    out = {"totalMatches": total, "matches": [tuple(r) for r in rows.limit(1000).collect()], "perPattern": counts, "states": states}
    work = co.automaton_counters(df, patterns).first()
    return out, f"{total} matches of {len(patterns)} patterns.", {"comparisons": work["comparisons"], "operations": work["operations"], "memoryBytes": 80 * states}


def _trie(spark: SparkSession, given: Input) -> tuple[dict, str, dict]:
    words, query = mp.check_patterns(given.patterns or []), given.query or ""
    if len(query) > MOST_QUERY:
        raise ValidationError("the query is too long")
    df = spark.createDataFrame([(w,) for w in words], "word string")
    out = st.trie_summary(df, query).first().asDict()
    out["completions"] = [r["word"] for r in st.trie_completions(df, query).orderBy("rank").collect()]
    work = co.trie_counters(df, query).first()
    return out, f"{out['nodeCount']} nodes, {len(out['completions'])} completions.", {"comparisons": work["comparisons"], "operations": work["operations"], "memoryBytes": 64 * out["nodeCount"]}


def _suffixes(spark: SparkSession, given: Input, with_lcp: bool) -> tuple[dict, str, dict]:
    text = checked_text(given.text)
    df = _one(spark, text)
    rows = st.suffix_array(df).orderBy("rank").limit(1000).collect()
    out = {"suffixArray": [r["pos"] for r in rows], "length": len(text)}
    if not with_lcp:
        out["sortedSuffixes"] = [text[r["pos"] : r["pos"] + 60] for r in rows[:50]]
        return out, f"Sorted {len(text)} suffixes.", {"memoryBytes": 24 * len(text)}
    out["lcp"] = [r["lcp"] for r in rows]
    found = st.repeats(st.suffix_array(df), df).first().asDict()
    found.pop("doc_id")
    out |= found
    work = co.lcp_counters(st.suffix_array(df), df).first()
    counted = {"comparisons": work["comparisons"], "operations": work["operations"]} if work else {"comparisons": 0, "operations": 0}
    return out, f"Longest repeat: {out['longestRepeatLength']} characters.", {**counted, "memoryBytes": 32 * len(text)}


def _edit_distance(spark: SparkSession, given: Input) -> tuple[dict, str, dict]:
    a, b = given.text or "", given.text_b or ""
    if not a and not b:
        raise ValidationError("one of the texts must not be empty")
    if len(a) * len(b) > an.MOST_CELLS:
        raise ValidationError("the texts are too long for an edit distance")
    df = spark.createDataFrame([(a, b)], "a string, b string")
    x, y = F.col("a"), F.col("b")
    row = df.select(an.edit_distance(x, y).alias("distance"), an.edit_similarity(x, y).alias("similarity"), an.alignment(x, y).alias("script")).first()
    out = {"distance": row["distance"], "similarity": row["similarity"]}
    if row["script"] is None:
        out |= {"alignment": None, "note": "The texts are too long for an alignment."}
    else:
        steps = [tuple(s) for s in row["script"]]
        out |= {"alignment": steps[:2000], "edits": {op: sum(s[0] == op for s in steps) for op in ("match", "substitute", "insert", "delete")}}
    cells = len(a) * len(b)
    return out, f"Edit distance {row['distance']}.", {"comparisons": cells, "operations": cells}


def _corpus(spark: SparkSession, given: Input) -> DataFrame:
    return spark.createDataFrame(list(enumerate(checked_documents(given.documents))), "doc_id long, text string")


def _tfidf(spark: SparkSession, given: Input) -> tuple[dict, str, dict]:
    df = _corpus(spark, given)
    weights = an.tfidf_weights(df)
    size = weights.agg(F.countDistinct("term").alias("v"), F.sum("cnt").alias("t")).first()
    ranking = [(r["term"], r["score"], r["df"]) for r in an.tfidf_global(df).orderBy("rank").collect()]
    tops: dict[int, list] = {}
    for r in an.tfidf_top_terms(df, given.top_k).where("doc_id < 50").orderBy("doc_id", "rank").collect():
        tops.setdefault(r["doc_id"], []).append((r["term"], r["weight"]))
    out = {"documents": df.count(), "vocabularySize": size["v"], "totalTokens": size["t"] or 0, "globalRanking": ranking, "topTermsPerDocument": tops}
    work = co.tfidf_counters(df).first().asDict()
    return out, f"{size['v']} terms.", work


def _index(spark: SparkSession, given: Input) -> tuple[dict, str, dict]:
    df, query = _corpus(spark, given), given.query or ""
    out = an.index_stats(df).first().asDict()
    out["queryTerms"] = an.query_terms(query)
    out["andResults"] = [r["doc_id"] for r in an.and_query(df, query).orderBy("doc_id").limit(200).collect()]
    out["orResults"] = [(r["doc_id"], r["matched"], r["score"], r["terms"]) for r in an.or_query(df, query).orderBy("rank").collect()]
    out["topTerms"] = [(r["term"], r["df"], r["totalTf"]) for r in an.top_terms(df).orderBy("rank").collect()]
    work = co.index_counters(df, query).first().asDict()
    return out, f"{out['terms']} terms, {out['postings']} postings.", {**work, "memoryBytes": 64 * out["terms"] + 40 * out["postings"]}


def _similarity(spark: SparkSession, given: Input) -> tuple[dict, str, dict]:
    df = spark.createDataFrame([(checked_text(given.text), checked_text(given.text_b, "second text"))], "text string, textB string")
    row = an.similarity(df, method=given.method).first()
    out = {"method": given.method, "score": row["score"], "allMethods": {m: row[m] for m in an.METHODS}, "tokensA": row["tokensA"], "tokensB": row["tokensB"]}
    out |= {k: row[k][:200] for k in ("sharedTerms", "onlyInA", "onlyInB")}
    out["contributions"] = [(c["term"], c["product"]) for c in row["contributions"][:30]]
    work = co.similarity_counters(df.withColumn("doc_id", F.lit(0))).first()
    distinct = sum(len(row[k]) for k in ("sharedTerms", "sharedTerms", "onlyInA", "onlyInB"))
    return out, f"{given.method} similarity {row['score']}.", {"comparisons": work["comparisons"], "operations": work["operations"], "memoryBytes": 48 * distinct}


RUN: dict[str, Callable[[SparkSession, Input], tuple[dict, str, dict]]] = {
    **{k: _matcher(k) for k in ("naive", "kmp", "rabin-karp", "boyer-moore")},
    "aho-corasick": _aho_corasick,
    "trie": _trie,
    "suffix-array": lambda s, i: _suffixes(s, i, False),
    "kasai": lambda s, i: _suffixes(s, i, True),
    "edit-distance": _edit_distance,
    "tfidf": _tfidf,
    "inverted-index": _index,
    "similarity": _similarity,
}


def input_size(algorithm: str, given: Input) -> tuple[int, int, int]:
    """(n, m, k): characters read, characters of the pattern or second text, number of patterns or documents."""
    if algorithm == "trie":
        return sum(map(len, given.patterns or [])), len(given.query or ""), len(given.patterns or [])
    if algorithm in ("tfidf", "inverted-index"):
        return sum(map(len, given.documents or [])), len(given.query or ""), len(given.documents or [])
    if algorithm == "aho-corasick":
        return len(given.text or ""), sum(map(len, given.patterns or [])), len(given.patterns or [])
    if algorithm in ("edit-distance", "similarity"):
        return len(given.text or ""), len(given.text_b or ""), 1
    return len(given.text or ""), len(given.pattern or "") if algorithm not in ("suffix-array", "kasai") else 0, 1


def preview(given: Input, shown: int = 160) -> str:
    """The beginning of what an algorithm reads."""
    return (given.text if given.text is not None else " | ".join(given.documents) if given.documents else ", ".join(given.patterns or []))[:shown]


def _held() -> int:
    """Bytes of objects that this process has allocated and not freed."""
    return sys.getallocatedblocks() * 64


def execute(spark: SparkSession, algorithm: str, given: Input, record: bool = False, most_steps: int = 2500) -> Result:
    """Check the input, run the algorithm on Spark, and measure; with ``record`` the steps of a small input come with it."""
    if algorithm not in RUN:
        raise ValidationError(f"unknown algorithm {algorithm!r}")
    steps, truncated = [], False
    if record:
        from .traces import trace  # traces read this module's table

        steps, truncated = trace(algorithm, given, most_steps)
    before, began = _held(), time.perf_counter()
    output, summary, work = RUN[algorithm](spark, given)
    ms = (time.perf_counter() - began) * 1000
    n, m, k = input_size(algorithm, given)
    metrics = {"runtimeMs": ms, "throughputCharsPerSec": n / ms * 1000 if ms else 0.0, "heapDeltaBytes": max(0, _held() - before), "inputSize": n, "patternSize": m, "itemCount": k, **work}
    return Result(algorithm, output, summary, metrics, preview(given), {"worst": META[algorithm][2], "space": META[algorithm][3]}, steps, truncated)


def compact(result: Result, shown: int = 200) -> Result:
    """A result without steps and with its list of matches cut, for listings."""
    out = dict(result.output)
    if "matches" in out:
        out["matches"] = out["matches"][:shown]
    return Result(result.algorithm, out, result.summary, result.metrics, result.preview, result.complexity)
