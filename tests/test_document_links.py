import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossa.functions.text import STOP_WORDS
from glossa.operators import analytics as an
from glossa.operators import links as li


def brute(rows, num, den):
    vectors = {k: Counter(w for w in (t or "").split() if w not in STOP_WORDS) for k, t in rows if k is not None}
    up = {k: k for k in vectors}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    links, square = Counter(), {k: sum(c * c for c in v.values()) for k, v in vectors.items()}
    for a in vectors:
        for b in vectors:
            dot = sum(c * vectors[b][w] for w, c in vectors[a].items())
            if a != b and dot and den * den * dot * dot >= num * num * square[a] * square[b]:
                links[a] += 1
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {k: (links[k], root(k)) for k in vectors}


def found(spark, rows, num, den):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {r.doc_id: (r.n_links, r.component_id) for r in li.similar_documents(df, num, den).collect()}


@pytest.mark.parametrize("num, den", [(4, 5), (1, 2)])
def test_equals_all_pairs(spark, num, den):
    rng = random.Random(num)
    words = ["w" + "abcdefghij"[k % 10] * (k // 10 + 1) for k in range(60)]
    rows, base = [], [rng.choices(words, k=12) for _ in range(15)]
    for i in range(90):
        text = list(rng.choice(base))
        for _ in range(rng.randrange(6)):
            text[rng.randrange(12)] = rng.choice(words)
        rng.shuffle(text)
        rows.append((8 * i % 91, " ".join(text)))
    rows += [(200 + i, "copy of one text") for i in range(20)] + [(300, ""), (301, None), (302, "the and"), (None, "copy of one text"), (303, "copy of one text text text")]
    assert found(spark, rows, num, den) == brute(rows, num, den)


def test_links_never_become_rows(spark, monkeypatch):
    """Of 300 documents that are all linked, no table has a row a link; small blocks make many pairs of blocks."""
    sizes = []

    def counted(df, name, staged=li.staged):
        out = staged(df, name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(li, "staged", counted)
    monkeypatch.setattr(li, "BLOCK_VECTORS", 32)
    monkeypatch.setattr(li, "AT_ONCE", 16)
    word = lambda i: "x" + "".join("abcdefghij"[int(c)] for c in str(i))
    rows = [(i, f"ash birch cedar elm fir oak pine yew larch {word(i)}") for i in range(300)]
    assert found(spark, rows, 4, 5) == {i: (299, 0) for i in range(300)}
    assert max(sizes) < 10_000


def test_short_scripts_are_those_of_arrays(monkeypatch):
    rng = random.Random(4)
    pairs = [tuple("".join(rng.choices("abc", k=rng.randrange(12))) for _ in range(2)) for _ in range(400)]
    short = [an.edit_script(a, b) for a, b in pairs]
    monkeypatch.setattr(an, "SMALL_MATRIX", 0)
    assert short == [an.edit_script(a, b) for a, b in pairs]


def test_nothing_to_link(spark):
    assert found(spark, [], 4, 5) == {}
    assert found(spark, [(1, "ash"), (2, "oak")], 4, 5) == {1: (0, 1), 2: (0, 2)}


def matrix_script(a, b):
    """The path by the whole matrix."""
    n, m = len(a), len(b)
    cost = np.zeros((n + 1, m + 1), int)
    cost[0], cost[:, 0] = np.arange(m + 1), np.arange(n + 1)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            cost[i, j] = min(cost[i - 1, j - 1] + (a[i - 1] != b[j - 1]), cost[i - 1, j] + 1, cost[i, j - 1] + 1)
    out, i, j = [], n, m
    while i or j:
        if i and j and cost[i, j] == cost[i - 1, j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            out.append(("match" if a[i] == b[j] else "substitute", a[i], b[j]))
        elif i and cost[i, j] == cost[i - 1, j] + 1:
            i -= 1
            out.append(("delete", a[i], ""))
        else:
            j -= 1
            out.append(("insert", "", b[j]))
    return out[::-1]


def test_scripts_are_those_of_the_matrix():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(14))) for _ in range(2))
        assert an.edit_script(a, b) == matrix_script(a, b)


def test_long_pair(spark):
    rng = random.Random(8)
    a = "".join(rng.choice("acgt") for _ in range(20_000))
    b = "".join(c for c in a if rng.random() > 0.01)
    assert an.edit_script(a, b) is None
    script = an.edit_script(a, b, None)
    assert "".join(s[1] for s in script) == a and "".join(s[2] for s in script) == b
    edits = sum(s[0] != "match" for s in script)
    assert edits == spark.range(1).select(F.levenshtein(F.lit(a), F.lit(b))).first()[0] == len(a) - len(b)


def test_frequent_terms_are_multiplied_and_others_looked_up(monkeypatch):
    """Two blocks, whether their strips' pairs are verified one by one or as matrices: each vector's links are those of whole numbers, some exactly at the bound."""
    import pyarrow as pa

    monkeypatch.setattr(li, "STRIP", 16)
    rng = np.random.default_rng(2)
    sparse = rng.random((8, 60)) < 0.3
    rows = [np.where(rng.random(60) < 0.08, rng.integers(1, 4, 60), sparse[rng.integers(8)] * 2) for _ in range(70)]
    rows = [r for r in rows if r.any()] + [np.eye(60, dtype=int)[0] * 4 + np.eye(60, dtype=int)[1] * 3, np.eye(60, dtype=int)[0]]
    names = np.concatenate([np.arange(20), -(np.arange(40) * 1_000_003 + 1)])  # places of frequent terms, and names of others

    def block(some, first):
        return li.Block(pa.array(range(first, first + len(some))), pa.array([1 + k % 3 for k in range(len(some))]), pa.array([int((r > 0).sum()) for r in some]), np.concatenate([names[r > 0] for r in some]), np.concatenate([r[r > 0] for r in some]).astype(np.int32))

    x, y = block(rows, 0), block(rows[::-1], 100)
    table = np.array(rows)
    dots, square = table @ table.T, (table**2).sum(1)
    links = 25 * dots**2 >= 16 * np.outer(square, square)
    assert links[-2, -1] and links.sum() > 300
    for few in (0, 1000):
        monkeypatch.setattr(li, "FEW", few)
        mine, theirs, a, b = li._linked(x, y, 4, 5)
        assert (mine == links[:, ::-1] @ y.many).all() and (theirs == links[:, ::-1].T @ x.many).all()
        assert links[:, ::-1][a, b].all() and len(a) < 2 * (links.shape[0] + links.shape[1]) * 25
        n = len(rows)
        every = np.nonzero(links[:, ::-1])
        assert (li._least(2 * n, a, b + n) == li._least(2 * n, every[0], every[1] + n)).all()
        mine, theirs, a, b = li._linked(x, x, 4, 5)
        assert (mine + theirs == (links & ~np.eye(n, dtype=bool)) @ x.many).all()
