import math
import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glossa.functions.text import STOP_WORDS
from glossa.operators import analytics as an
from glossa.operators import structures as st
from glossa.operators.matching import ValidationError


def words(spark, *items):
    return spark.createDataFrame([(w,) for w in items], "word string")


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_trie(spark):
    df = words(spark, "tea", "ten", "to", "inn", "in", "tree", "tea")
    row = st.trie_summary(df, "te").first()
    assert (row["nodeCount"], row["wordsInserted"], row["prefixFound"], row["isWord"]) == (12, 7, True, False)
    assert [r["word"] for r in st.trie_completions(df, "te").orderBy("rank").collect()] == ["tea", "ten"]
    assert st.trie_summary(df, "").first()["prefixFound"] is True


@pytest.mark.parametrize("short", [0, 512])
@pytest.mark.parametrize(
    "text,order,lcp,repeat,distinct",
    [
        ("banana", [5, 3, 1, 0, 4, 2], [0, 1, 3, 0, 0, 2], "ana", 15),
        ("mississippi", [10, 7, 4, 1, 0, 9, 8, 6, 3, 5, 2], [0, 1, 1, 4, 0, 0, 1, 0, 2, 1, 3], "issi", 53),
        ("a", [0], [0], "", 1),
    ],
)
def test_suffixes(spark, short, text, order, lcp, repeat, distinct):
    df = docs(spark, text)
    rows = st.suffix_array(df, short=short).orderBy("rank").collect()
    assert [r["pos"] for r in rows] == order and [r["lcp"] for r in rows] == lcp
    row = st.repeats(st.suffix_array(df, short=short), df).first()
    assert (row["longestRepeatedSubstring"], row["distinctSubstrings"]) == (repeat, distinct)


def test_suffix_doubling_on_random_texts():
    rnd = random.Random(3)
    for _ in range(100):
        t = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 80)))
        order, common = st.sort_suffixes(t)
        want = sorted(range(len(t)), key=lambda i: t[i:])
        assert list(order) == want
        assert list(common) == [0] + [len(os.path.commonprefix([t[a:], t[b:]])) for a, b in zip(want, want[1:])]


def test_edit_distance(spark):
    pairs = [("kitten", "sitting", 3), ("sunday", "saturday", 3), ("", "abc", 3), ("algorithm", "altruistic", 6)]
    df = spark.createDataFrame([(a, b) for a, b, _ in pairs], "a string, b string")
    rows = df.select("*", an.edit_distance(F.col("a"), F.col("b")).alias("d"), an.alignment(F.col("a"), F.col("b")).alias("s")).collect()
    for r, (a, b, d) in zip(rows, pairs):
        steps = r["s"]
        assert r["d"] == d == sum(s["op"] != "match" for s in steps)
        assert "".join(s["a"] for s in steps) == a and "".join(s["b"] for s in steps) == b


def test_tfidf(spark):
    df = docs(spark, "the cat sat on the mat", "the dog sat on the log", "cats and dogs are pets", "the mat is red")
    got = {r["term"]: (r["score"], r["df"]) for r in an.tfidf_global(df).collect()}
    assert got["red"] == (0.9581, 1) and got["mat"] == (0.7554, 2) and got["cat"] == (0.6388, 1) and got["sat"] == (0.5036, 2) and len(got) == 9
    top = an.tfidf_top_terms(df, 1).orderBy("doc_id").collect()
    assert [r["term"] for r in top] == ["cat", "dog", "cats", "red"]
    with pytest.raises(ValidationError):
        an.tfidf_top_terms(df, 0)


def test_index(spark):
    df = docs(spark, "home sales", "home july", "sales july", "", "home sales july")
    assert sorted(r["doc_id"] for r in an.and_query(df, "home sales").collect()) == [0, 4]
    assert an.and_query(df, "the").count() == 0 and an.and_query(df, "home nowhere").count() == 0
    rows = an.or_query(df, "home sales july").orderBy("rank").collect()
    assert [(r["doc_id"], r["matched"]) for r in rows] == [(4, 3), (0, 2), (1, 2), (2, 2)]
    assert an.index_stats(df).first().asDict() == {"documents": 4, "terms": 3, "postings": 9}
    posting = an.inverted_index(df).where("term = 'july' and doc_id = 4").first()
    assert (posting["tf"], posting["positions"]) == (1, [2])


def test_similarity(spark):
    a = "Machine learning models learn patterns from data and improve predictions."
    b = "Deep learning models learn complex patterns from large data sets."
    row = an.similarity(spark.createDataFrame([(a, b)], "text string, textB string")).first()
    assert (row["tokensA"], row["tokensB"], len(row["sharedTerms"])) == (8, 9, 5)
    assert [round(row[m], 4) for m in an.METHODS] == [0.5893, 0.4167, 0.5882, 0.625]
    empty = an.similarity(spark.createDataFrame([("", "x y"), ("same words", "same words")], "text string, textB string")).collect()
    assert [r["cosine"] for r in empty] == [0.0, 1.0]
    with pytest.raises(ValidationError):
        an.similarity(spark.createDataFrame([("a", "b")], "text string, textB string"), method="none")


def test_cosine_counts_terms_without_lambdas(spark):
    rng = random.Random(14)
    some = ["oak", "Oak", "ÉLAN", "élan", "it's", "'ash'", "the", "x1", "ɏ", "a'", "'", "日本", "fir-elm"]
    texts = ["", None, "the of", "' ''", *(" ".join(rng.choices(some, k=rng.randrange(1, 60))) for _ in range(600))]
    pairs = [(i, *rng.choices(texts[:4] if i < 30 else texts, k=2)) for i in range(700)]
    rows = an.similarity(spark.createDataFrame(pairs, "i long, text string, textB string").repartition(2))

    def counts(text):
        found = (w.strip("'") for w in re.findall("[a-z0-9\u00c0-\u024f']+", text.lower()))
        return Counter(w for w in found if w and w not in STOP_WORDS)

    got = {r["i"]: r for r in rows.select("i", "score", "contributions", "sharedTerms").collect()}
    assert len(got) == len(pairs)
    for i, a, b in pairs:
        if a is None or b is None:
            assert got[i]["score"] == 0.0 and got[i]["contributions"] is None
            continue
        x, y = counts(a), counts(b)
        products = sorted((-x[t] * y[t], t) for t in x if t in y)
        squares = sum(n * n for n in x.values()) * sum(n * n for n in y.values())
        assert got[i]["score"] == (math.floor(-sum(p for p, _ in products) / math.sqrt(squares) * 10000 + 0.5) / 10000 if squares else 0.0)
        assert [(-c["product"], c["term"]) for c in got[i]["contributions"]] == products
        assert sorted(got[i]["sharedTerms"]) == sorted(t for _, t in products)
    for column in ("score", "contributions"):
        assert "lambdafunction" not in rows.select("i", column)._jdf.queryExecution().optimizedPlan().toString()


def test_cosine_of_texts_whose_squares_multiply_beyond_a_long(spark):
    text = "oak " * 60_000
    row = an.similarity(spark.createDataFrame([(text, text + "ash")], "text string, textB string")).select("score", "contributions").first()
    assert row["score"] == 1.0 and [tuple(c) for c in row["contributions"]] == [(3_600_000_000, "oak")]
