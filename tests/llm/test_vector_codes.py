import hashlib
from collections import defaultdict

import numpy as np
import pytest

from glossa.llm.vector_codes import compress, nearest, neighbour_lists

SCHEMA = "vec_id long, embedding array<float>, label int, code string, parts int, total long"


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    """Every entry of every codebook held against every part, in Python's integers."""
    kept = [(i, [int(np.floor(np.float64(np.float32(x)) * scale)) for x in v], l) for i, v, l in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return []
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == width]
    spans = [(width * p // parts, width * (p + 1) // parts) for p in range(parts)]
    books = [[v[a:b] for _, v, _ in kept[:entries]] for a, b in spans]

    def best(x, book):
        return min((sum((s - t) ** 2 for s, t in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p, (a, b) in enumerate(spans):
            groups = defaultdict(list)
            for _, v, _ in kept:
                groups[best(v[a:b], books[p])[1]].append(v[a:b])
            for e, xs in groups.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    out, totals = [], defaultdict(int)
    for i, v, l in kept:
        found = [best(v[a:b], books[p]) for p, (a, b) in enumerate(spans)]
        error = sum(d for d, _ in found)
        totals[l] += error
        out.append((i, "".join(f"{e:02x}" for _, e in found), error, l))
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return [(i, c, e, totals[l], digest) for i, c, e, l in out]


def given(spark, rows):
    return spark.createDataFrame([(i, v, l, "c", 1, 2) for i, v, l in rows], SCHEMA)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("spread", [1, 6, 100])
def test_nearest_is_the_full_search(spread):
    rng = np.random.default_rng(spread)
    for k in (1, 2, 16, 40):
        book = rng.integers(-spread, spread + 1, (k, 4))
        x = rng.integers(-2 * spread, 2 * spread + 1, (300, 4))
        d = ((x[:, None] - book[None]) ** 2).sum(2)
        entry, low = nearest(x, book, rng.integers(0, k, 300))
        assert (entry == d.argmin(1)).all() and (low == d.min(1)).all()


def test_lists_are_sorted_and_leave_out_the_entry_itself():
    order, apart = neighbour_lists(np.array([[0], [5], [0], [2]]))
    assert order.tolist() == [[2, 3, 1], [3, 0, 2], [0, 3, 1], [0, 2, 1]]
    assert (np.diff(apart, axis=1) >= 0).all()


@pytest.mark.parametrize("width", [16, 8, 20, 3])
def test_equals_brute_force(spark, width):
    rng = np.random.default_rng(width)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.01, width).astype(np.float32)], int(i % 3) if i % 7 else None) for i in rng.permutation(120)]
    rows += [(200 + i, rows[0][1], 1) for i in range(40)]
    assert got(compress(given(spark, rows).repartition(5))) == sorted(brute(rows), key=repr)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    v = [0.5] * 8
    rows = [(3, v, 1), (3, v, 1), (None, [0.25] * 8, None), (1, None, 1), (2, [nan] * 8, 1), (4, [inf, *v[1:]], 1), (5, [None, *v[1:]], 1), (6, [0.1] * 9, 1), (7, [-0.00001] * 8, None)]
    out = got(compress(given(spark, rows)))
    assert out == sorted(brute(rows), key=repr) and len(out) == 4
    assert compress(given(spark, rows).where("vec_id = 1")).collect() == []
    assert compress(given(spark, [])).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_a_vector_too_large_for_exact_distances_is_dropped(spark):
    rows = [(1, [0.5] * 8, 1), (2, [1e30] * 8, 1)]
    assert [r.vec_id for r in compress(given(spark, rows)).collect()] == [1]


def test_repeats_agree_whatever_the_partitions(spark):
    rows = [(i, [((i * 37 + k * 11) % 101) / 1000 for k in range(16)], i % 2) for i in range(200)]
    df = given(spark, rows)
    assert got(compress(df.repartition(7))) == got(compress(df.coalesce(1)))
