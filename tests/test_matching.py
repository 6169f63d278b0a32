import random

import pytest
from pyspark.sql import functions as F

from glossa.operators import matching as ma
from glossa.operators import multi_pattern as mp


def find(text, pattern):
    return [i for i in range(len(text) - len(pattern) + 1) if text.startswith(pattern, i)]


def one(spark, text):
    return spark.createDataFrame([(0, text)], "doc_id long, text string")


INPUTS = [
    ("to see the sea one has to see", "see"), ("abaababaabaababaababa", "abaababa"), ("red lorry yellow lorry", "lorry"), ("1618033988749894848", "8948"),
    ("tatatictatacticta", "tactic"), ("x" * 90 + "y", "xxxy"), ("aaaaa", "aa"), ("no", "a pattern that is longer"), ("", "a"),
]


def shifts_by_definition(p):
    """The least shift that keeps what matched from j on and brings another character to the place before it."""
    m = len(p)

    def keeps(j, s):
        return all(k < s or p[k - s] == p[k] for k in range(j, m)) and (j == 0 or j - 1 < s or p[j - 1 - s] != p[j - 1])

    return [next(s for s in range(1, m + 1) if keeps(j, s)) for j in range(m + 1)]


def naive_by_hand(t, p):
    return sum(next((j + 1 for j in range(len(p)) if t[s + j] != p[j]), len(p)) for s in range(len(t) - len(p) + 1))


def kmp_by_hand(t, p):
    """Comparisons of the scan: at each character, one for every border that is tried."""
    border = lambda q: next(k for k in range(len(q) - 1, -1, -1) if q.endswith(q[:k]))
    total, held = 0, 0
    for c in t if len(t) >= len(p) else "":
        while True:
            total += 1
            if p[held] == c:
                held += 1
                break
            if not held:
                break
            held = border(p[:held])
        if held == len(p):
            held = border(p)
    return total


def boyer_moore_by_hand(t, p):
    shifts, total, s = shifts_by_definition(p), 0, 0
    while s <= len(t) - len(p):
        fits = next((k for k in range(len(p)) if p[-1 - k] != t[s + len(p) - 1 - k]), len(p))
        total += min(fits + 1, len(p))
        j = len(p) - 1 - fits
        s += shifts[0] if j < 0 else max(shifts[j + 1], j - p.rfind(t[s + j]))
    return total


@pytest.mark.parametrize("text,pattern", INPUTS)
def test_matches_tables_and_counters(spark, text, pattern):
    df, t = one(spark, text), F.col("text")
    where = find(text, pattern)
    row = ma.matches(df, pattern).first()
    assert (row["matches"], row["totalMatches"]) == (where, len(where))
    got = df.select(
        ma.match_count(t, pattern).alias("n"), ma.naive_comparisons(t, pattern).alias("naive"), ma.kmp_counters(t, pattern).alias("kmp"),
        ma.boyer_moore_counters(t, pattern).alias("bm"), ma.rabin_karp_counters(t, pattern).alias("rk"),
    ).first()
    assert (got["n"], got["naive"]) == (len(where), naive_by_hand(text, pattern))
    assert got["kmp"]["comparisons"] - ma.lps_work(pattern) == kmp_by_hand(text, pattern)
    assert got["bm"]["comparisons"] - ma.good_suffix_work(pattern) == boyer_moore_by_hand(text, pattern)
    assert ma.good_suffix(pattern) == shifts_by_definition(pattern)
    hashes = [ma.pattern_hash(text[k : k + len(pattern)]) for k in range(len(text) - len(pattern) + 1)]
    hits = sum(h == ma.pattern_hash(pattern) for h in hashes)
    assert (got["rk"]["hashHits"], got["rk"]["spuriousHits"]) == (hits, hits - len(where))


def test_linear_work(spark):
    """What is asserted of the failure table: at most 2n + 8 comparisons where the plain scan takes far more."""
    df, t = one(spark, "a" * 10_000), F.col("text")
    got = df.select(ma.kmp_counters(t, "aaab").alias("kmp"), ma.naive_comparisons(t, "aaab").alias("naive")).first()
    assert got["kmp"]["comparisons"] <= 2 * 10_000 + 8 < got["naive"]


def test_agreement_on_random_texts(spark):
    rnd = random.Random(7)
    for pattern in ("a", "ab", "aab", "abab", "\\E.a"):
        rows = [(i, "".join(rnd.choice("ab\\E.") for _ in range(rnd.randint(0, 60)))) for i in range(60)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r["doc_id"]: r["matches"] for r in ma.matches(df, pattern, limit=None).collect()}
        assert got == {i: find(t, pattern) for i, t in rows}


def test_large_text(spark):
    assert one(spark, "abcde" * 200_000).select(ma.match_count(F.col("text"), "cdeab").alias("n")).first()["n"] == 199_999


def test_lps_and_errors(spark):
    assert ma.lps("ABABCABAB") == [0, 0, 1, 2, 0, 1, 2, 3, 4]
    assert ma.lps("AABAACAABAA") == [0, 1, 0, 1, 2, 0, 1, 2, 3, 4, 5]
    for bad in ("", None, "x" * 10_001):
        with pytest.raises(ma.ValidationError):
            ma.match_count(F.col("text"), bad)


@pytest.mark.parametrize("threshold", [1, 50])
def test_many_patterns(spark, threshold):
    text, patterns = "abccab abc", ["a", "ab", "bc", "bca", "c", "caa"]
    rows = mp.find_many(one(spark, text), patterns, automaton_from=threshold).orderBy(*mp.emission_order()).collect()
    assert [(r["pattern"], r["pos"]) for r in rows] == [("a", 0), ("ab", 0), ("bc", 1), ("c", 2), ("c", 3), ("a", 4), ("ab", 4), ("a", 7), ("ab", 7), ("bc", 8), ("c", 9)]
    assert mp.automaton_states(spark, patterns).first()["states"] == 9


def test_repeated_patterns_count_each(spark):
    got = mp.pattern_counts(one(spark, "ushers"), ["he", "she", "he", "zz"]).orderBy("pattern_id").collect()
    assert [r["matches"] for r in got] == [1, 1, 1, 0]
    with pytest.raises(ma.ValidationError):
        mp.check_patterns(["", ""])


def test_positions_stay_in_the_jvm(spark):
    plan = ma.match_positions(one(spark, "aaa"), "a")._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan
