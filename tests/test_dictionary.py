import random
from collections import Counter

import pytest

from glossa.operators import dictionary as di


def brute(texts, patterns):
    out = Counter()
    for k, t in texts:
        for i, p in patterns:
            if t and p:
                at = t.find(p)
                while at >= 0:
                    out[k, i, p, at] += 1
                    at = t.find(p, at + 1)
    return out


def found(spark, texts, patterns):
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    rows = di.find_dictionary(df, spark.createDataFrame(patterns, "id int, pattern string")).collect()
    return Counter((r.doc_id, r.id, r.pattern, r.pos) for r in rows)


TEXTS = [(1, "abracadabra"), (1, "abracadabra"), (2, ""), (3, None), (None, "xaay"), (4, "é\U0001f600é\U0001f600\n" * 3), (5, "a" * 40)]
PATTERNS = [(1, "a"), (2, "aa"), (3, "abra"), (4, "abra"), (5, ""), (6, None), (7, "\U0001f600é"), (8, "abracadabra"), (9, "abracadabrax"), (10, "a" * 17), (11, "é\U0001f600\n"), (12, "zz")]


@pytest.mark.parametrize("block", [1 << 17, 5])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(di, "BLOCK", block)
    assert found(spark, TEXTS, PATTERNS) == brute(TEXTS, PATTERNS)


def test_many_patterns(spark):
    rng = random.Random(2)
    texts = [(k, "".join(rng.choices("abcd ", k=rng.randrange(400)))) for k in range(40)]
    patterns = [(i, "".join(rng.choices("abcd ", k=rng.randrange(1, 9)))) for i in range(3000)]
    assert found(spark, texts, patterns) == brute(texts, patterns)


def test_no_patterns_and_no_texts(spark):
    assert found(spark, TEXTS, []) == Counter() and found(spark, TEXTS, [(1, ""), (2, None)]) == Counter() and found(spark, [], PATTERNS) == Counter()


def test_full_bitmaps_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(di, "LEAST_BITS", 64)
    monkeypatch.setattr(di, "MOST_BITS", 64)
    assert found(spark, TEXTS, PATTERNS) == brute(TEXTS, PATTERNS)
