import random
from collections import Counter

import numpy as np
import pytest
from glossa.llm import embedding_dedup
from glossa.llm import jaccard_join as jj
from glossa.llm.components import components
from glossa.llm.embedding_dedup import near_duplicate_vectors


class Union:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def shingles(text, width):
    words = (text or "").translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})).replace("\xa0", "¤").split()
    return frozenset(zip(*[words[k:] for k in range(width)])) if len(words) >= width else frozenset([tuple(words)] if words else [])


@pytest.mark.parametrize("width,num", [(3, 90), (5, 80)])
def test_components_equal_brute_force(documents, width, num):
    rnd = random.Random(9)
    vocabulary = [f"v{i}" for i in range(300)]
    bases = [[rnd.choice(vocabulary) for _ in range(rnd.randint(1, 120))] for _ in range(25)]
    rows = []
    for i in range(500):
        words = list(bases[int(rnd.random() ** 3 * len(bases))])  # some bases have very many copies
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 5])):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        rows.append((i, (" ".join(words)).upper() if i % 7 == 0 else " ".join(words), "s"))
    rows += [(600, "a b", "s"), (601, "A  b", "s"), (602, "b a", "s"), (603, None, "s"), (604, "", "s"), (605, "  ", "s")]
    sets = {i: shingles(t, width) for i, t, _ in rows}
    union = Union(sets)
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= num * (len(sets[a]) + len(sets[b]) - both):
                union.join(a, b)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in jj.jaccard_components(documents(rows), width, num, 100).collect()}
    assert got == {i: (len(s), union.find(i), union.find(i) == i) for i, s in sets.items()}
    kept = jj.jaccard_components(documents(rows), width, num, 100, carry=True)
    assert kept.columns == documents(rows).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i in sets if union.find(i) == i)


def test_odd_rows(odd, none):
    got = jj.jaccard_components(odd).collect()
    assert len(got) == 9 and sum(r["kept"] for r in got if r["doc_id"] in (1, 2)) == 1
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2)} == {1}
    assert {(r["doc_id"], r["component_id"], r["n_shingles"]) for r in got if r["doc_id"] in (3, 4, 5)} == {(3, 3, 0), (4, 4, 0), (5, 5, 0)}
    assert jj.jaccard_components(odd, carry=True).count() == sum(r["kept"] for r in got)
    assert jj.jaccard_components(none).count() == 0


def test_hashes_follow_the_words():
    texts = ["One two  three", "one two three", "one\ntwo\tthree four", "é É", "", "x"]
    data = "".join(texts).encode()
    starts = np.cumsum([0] + [len(t.encode()) for t in texts])
    a, b, c, d, e, f = jj.shingle_sets(np.frombuffer(data, np.uint8), starts, 3)
    assert (a == b).all() and len(c) == 2 and a[0] in c and len(d) == 1 and len(e) == 0 and len(f) == 1


def thue_morse(n):
    return "".join("ab"[bin(k).count("1") % 2] for k in range(n))


def test_words_of_any_length_differ():
    swap = str.maketrans("ab", "ba")
    words = [w for k in (8, 64, 255, 256, 257, 1024, 4096) for w in (thue_morse(k), thue_morse(k).translate(swap))]
    words += ["x" * k for k in range(1, 300)] + [f"{'y' * k}z" for k in range(300)] + ["a\0", "a", "a\0\0"]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    hashes = jj.word_hashes(data, ends - [len(w) for w in words], ends)
    assert len(set(hashes.tolist())) == len(set(words))
    upper = np.frombuffer(" ".join(words).upper().encode(), np.uint8)
    assert (jj.word_hashes(upper, ends - [len(w) for w in words], ends) == hashes).all()


def test_colliding_polynomials_stay_apart(documents):
    texts = [f"one two {w} three four five" for k in (1024, 2048) for w in (thue_morse(k), thue_morse(k).translate(str.maketrans("ab", "ba")))]
    got = jj.jaccard_components(documents([(i, t, "s") for i, t in enumerate(texts)])).collect()
    assert all(r["kept"] and r["component_id"] == r["doc_id"] for r in got)


def test_one_key_in_many_rows(documents):
    rows = [(None if i % 2 else 7, f"w{i} " + " ".join(f"v{(i // 4) * 100 + k}" for k in range(60)), "s") for i in range(400)]
    got = jj.jaccard_components(documents(rows)).collect()
    assert len(got) == 400 and sum(r["kept"] for r in got) == 1  # groups of four hold the key 7 each, so one component id
    assert {r["component_id"] for r in got} == {7}


@pytest.mark.parametrize("hot", [1, 1 << 15])
def test_hot_tokens(documents, monkeypatch, hot):
    monkeypatch.setattr(jj, "HOT", hot)
    monkeypatch.setattr(jj, "SALTED", 7 if hot == 1 else 4096)
    rows = [(i, "every text begins with this line " + (f"a{i % 5} " * (i % 7)), "s") for i in range(300)]
    sets = {i: shingles(t, 3) for i, t, _ in rows}
    union = Union(sets)
    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both):
                union.join(a, b)
    got = {r["doc_id"]: r["component_id"] for r in jj.jaccard_components(documents(rows), 3, 90, 100).collect()}
    assert got == {i: union.find(i) for i in sets}


def test_connected_components(spark):
    rnd = random.Random(10)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(60)]
    union = Union(range(2000))
    for a, b in edges:
        union.join(a, b)
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: union.find(x) for a, b in edges if a != b for x in (a, b)}


@pytest.mark.parametrize("margin", [2.0, None])
def test_vectors_equal_brute_force(spark, margin):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(60, 16))
    rows = [(i, (centres[i % 60] + rng.normal(size=16) * rng.choice([0.05, 0.3, 1.0])).tolist()) for i in range(900)]
    rows += [(2000 + i, rows[0][1]) for i in range(40)] + [(3000, None), (3001, [0.0] * 16), (3002, [float("nan")] * 16), (3003, [None] * 16), (3004, []), (3005, [1.0, 2.0]), (3006, [2.0, 4.0]), (None, rows[0][1])]
    fine = [(i, np.array(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    union, links = Union([i for i, _ in rows]), {i: 0 for i, _ in rows}
    for k, (i, x) in enumerate(fine):
        for j, y in fine[k + 1 :]:
            if len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.95:
                links[i] += 1
                links[j] += 1
                union.join(i, j)
    df = spark.createDataFrame([(i, v, 1, "m") for i, v in rows], "vec_id long, embedding array<double>, label int, mark string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_duplicate_vectors(df, margin=margin).collect()}
    want = {i: (links[i], union.find(i), union.find(i) == i) for i, _ in rows if i is not None} | {None: (0, None, False)}
    if margin is None:
        assert got == want
    else:
        assert sum(g[0] for g in got.values()) >= 0.9 * sum(w[0] for w in want.values()) and all(got[i][0] <= want[i][0] for i in want)
    assert near_duplicate_vectors(df.where("false")).count() == 0


def test_many_cells_are_fitted_in_two_steps(monkeypatch):
    monkeypatch.setattr(embedding_dedup, "FITTED", 8)
    rng = np.random.default_rng(13)
    x = embedding_dedup._unit(rng.normal(size=(4000, 8)))
    two, one = embedding_dedup.fit_centroids(x, 64), embedding_dedup.fit_centroids(x[:4000], 8)
    assert 48 <= len(two) <= 80 and np.allclose(np.linalg.norm(two, axis=1), 1)
    assert (x @ two.T).max(1).mean() > (x @ one.T).max(1).mean()


@pytest.mark.parametrize("fitted", [1024, 5])
def test_vectors_of_unequal_multiplicity(spark, monkeypatch, fitted):
    monkeypatch.setattr(embedding_dedup, "CELL", 20)
    monkeypatch.setattr(embedding_dedup, "FITTED", fitted)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(14)
    base = rng.normal(size=(300, 3))
    rows = [(i, base[i % 300 if i % 3 else 0]) for i in range(700)]
    unit = embedding_dedup._unit(np.array([v for _, v in rows]))
    near = (unit @ unit.T >= 0.95) & ~np.eye(len(rows), dtype=bool)
    union = Union(range(len(rows)))
    for a, b in zip(*np.nonzero(near)):
        union.join(int(a), int(b))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_duplicate_vectors(df).collect()}
    assert got == {i: (int(near[i].sum()), union.find(i)) for i in range(len(rows))}


@pytest.mark.parametrize("margin", [None, 0.3])
def test_vectors_of_low_intrinsic_dimension(spark, monkeypatch, margin):
    monkeypatch.setattr(embedding_dedup, "CELL", 100)
    rng = np.random.default_rng(12)
    x = rng.normal(size=(2000, 4)) @ rng.normal(size=(4, 64))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.99) & ~np.eye(len(x), dtype=bool)
    union = Union(range(len(x)))
    for a, b in zip(*np.nonzero(near)):
        union.join(int(a), int(b))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = {} if margin is None else {"margin": margin}
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_duplicate_vectors(df, threshold=0.99, **asked).collect()}
    if margin is None:
        assert got == {i: (int(near[i].sum()), union.find(i)) for i in range(len(x))}
    else:  # a pair found in one cell alone counts for both of its rows
        members = Counter(c for _, c in got.values())
        assert all((n > 0) == (members[c] > 1) for n, c in got.values())
        assert sum(n for n, _ in got.values()) < near.sum()
