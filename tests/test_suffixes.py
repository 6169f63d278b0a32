import random

import pytest

from glossa.operators import suffixes
from glossa.operators.structures import repeats, sort_suffixes, suffix_array, trie_edges, trie_nodes
from pyspark.sql import functions as F


def want(text):
    order, common = sort_suffixes(text)
    return [(i, int(a), int(c)) for i, (a, c) in enumerate(zip(order, common))]


@pytest.mark.parametrize("chunk", [1 << 14, 7])
def test_all_texts_by_rows_equal_the_order_of_each(spark, monkeypatch, chunk):
    monkeypatch.setattr(suffixes, "CHUNK", chunk)
    rng = random.Random(chunk)
    base = "".join(rng.choice("abc ") for _ in range(900))
    texts = [(1, "banana"), (2, "a" * 50), (3, "".join(rng.choice("ab") for _ in range(200))), (4, base + base[300:700] + "é\U0001f600" + base[:200]), (5, "x"), (6, None), (7, ""), (8, "ab" * 70)]
    got = {}
    for r in suffixes.long_suffix_array(spark.createDataFrame(texts, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append((r["rank"], r.pos, r.lcp))
    assert {k: sorted(v) for k, v in got.items()} == {k: want(t) for k, t in texts if t}


def test_long_and_short_texts_meet(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("ab ") for _ in range(3000))
    df = spark.createDataFrame([("l", long), ("s", "mississippi"), ("m", long[:700])], "name string, text string")
    array = suffix_array(df, key="name", long=2000)
    best = {r["name"]: r for r in repeats(array, df, key="name").collect()}
    for name, text in (("l", long), ("s", "mississippi"), ("m", long[:700])):
        lcp = [c for _, _, c in want(text)]
        assert best[name].longestRepeatLength == max(lcp) and text.count(best[name].longestRepeatedSubstring[:200]) >= 1
        assert best[name].distinctSubstrings == len(text) * (len(text) + 1) // 2 - sum(lcp)


def test_empty(spark):
    assert suffixes.long_suffix_array(spark.createDataFrame([(1, "")], "doc_id long, text string")).collect() == []


WORDS = ["a", "ab", "abc", "abd", "b", "bcd", "bce", "bce", "", None, "zzz", "é", "ab"]


def test_trie_of_neighbours(spark):
    df = spark.createDataFrame([(w,) for w in WORDS], "word string").repartition(4)
    words = {w for w in WORDS if w}
    nodes = {w[:k] for w in words for k in range(1, len(w) + 1)}
    assert sorted(map(tuple, trie_nodes(df).collect())) == sorted((p, len(p), p[:-1], p in words) for p in nodes)
    kept = {p for p in nodes if p in words or len({q for q in nodes if q[:-1] == p}) > 1}
    up = {p: max((q for q in kept if p.startswith(q) and q != p), key=len, default="") for p in kept}
    assert sorted(map(tuple, trie_edges(df).collect())) == sorted((p, p[len(up[p]) :], p in words) for p in kept)
    assert trie_nodes(df.where(F.lit(False))).collect() == [] and trie_edges(df.where(F.lit(False))).collect() == []
