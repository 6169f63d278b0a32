import random
import re
from collections import Counter, defaultdict

import pytest

from glossa.functions.text import STOP_WORDS
from glossa.operators import analytics as an
from glossa.operators import index as ix
from glossa.sources import scratch

WORDS = ["ash", "birch", "cedar", "elm", "fir", "oak", "pine", "the", "and", "yew"]


def corpus(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        k = 3 * i - 200
        words = rng.choices(WORDS, weights=[60, 30, 20, 10, 5, 3, 2, 50, 50, 1], k=rng.randrange(0, 80))
        rows.append((k, " ".join(words)))
    return rows


def postings(rows):
    out = defaultdict(dict)
    for k, text in rows:
        found = [w for w in re.findall("[a-z]+", text) if w not in STOP_WORDS]
        for p, w in enumerate(found):
            out[w].setdefault(k, []).append(p)
    return out


def ranked(lists, wanted):
    docs = {d for w in wanted for d in lists.get(w, {})}
    scored = []
    for d in docs:
        has = [w for w in wanted if d in lists.get(w, {})]
        scored.append((-len(has), -sum(len(lists[w][d]) for w in has), wanted.index(has[0]), d, tuple(has)))
    return [(r + 1, d, -m, -s, has) for r, (m, s, _, d, has) in enumerate(sorted(scored))]


@pytest.fixture(scope="module")
def built(spark):
    cell, ix.CELL = ix.CELL, 16
    rows = corpus(5)
    df = spark.createDataFrame([*rows, (None, "ash"), (10_000, None), (10_001, ""), (10_002, "the and")], "doc_id long, text string").repartition(3)
    yield ix.build_index(df, scratch.new_folder(spark, "index-test")), rows, df
    ix.CELL = cell


@pytest.mark.parametrize("query", ["ash", "pine fir", "yew oak fir pine", "the ash", "ash nothing", "", "the", "ash birch cedar elm fir oak pine yew"])
def test_queries_equal_brute_force(built, query):
    index, rows, df = built
    lists, wanted = postings(rows), an.query_terms(query)
    every = set.intersection(*[set(lists.get(w, {})) for w in wanted]) if wanted else set()
    assert Counter(r[0] for r in ix.and_query(index, query).collect()) == Counter(every)
    want = ranked(lists, wanted)
    for limit in (3, 50, None):
        assert [tuple(r)[:4] + (tuple(r.terms),) for r in ix.or_query(index, query, limit).orderBy("rank").collect()] == want[:limit]
    assert {(r.term, r.doc_id): (r.tf, r.positions) for r in ix.query_postings(index, query).collect()} == {(w, d): (len(p), p[:50]) for w in wanted for d, p in lists.get(w, {}).items()}
    # Without an index the same, but that rows with a null key have no place in one.
    known = df.where("doc_id is not null")
    assert [tuple(r)[:4] for r in an.or_query(known, query).orderBy("rank").collect()] == [w[:4] for w in want[:50]]


def test_early_stop_reads_fewer_cells(built, monkeypatch):
    index, rows, _ = built
    monkeypatch.setattr(ix, "FIRST_CELLS", 2)
    want = ranked(postings(rows), ["yew", "pine"])[:2]
    found = ix.or_query(index, "yew pine", 2)
    assert [tuple(r)[:4] for r in found.orderBy("rank").collect()] == [w[:4] for w in want]


def test_reads_only_blocks_of_asked_terms(built):
    index, _, _ = built
    for asked in (ix.and_query(index, "pine fir"), ix.or_query(index, "pine fir"), ix.query_postings(index, "pine fir")):
        plan = asked._jdf.queryExecution().executedPlan().toString()
        scans = [x for x in plan.split("\n") if "FileScan" in x]
        assert scans and all("In(term" in x or "EqualTo(term" in x for x in scans)
    assert "positions" not in ix.or_query(index, "pine")._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1].split("\n")[0]


def test_blocks_are_bounded_and_open_again(spark, built):
    index, rows, _ = built
    lists = postings(rows)
    blocks = index.blocks.collect()
    assert max(r.n for r in blocks) <= 16 and len({(r.term, r.cell) for r in blocks}) == len(blocks)
    assert all(r.top == max(r.counts) and r.total == sum(r.counts) and r.offsets == sorted(r.offsets) for r in blocks)
    stats = ix.index_stats(index).first()
    assert (stats.documents, stats.terms, stats.postings) == (sum(bool(t) for _, t in rows) + 1, len(lists), sum(map(len, lists.values())))
    top = sorted(lists, key=lambda w: (-len(lists[w]), min((d, p[0]) for d, p in lists[w].items())))
    assert [(r.term, r.df, r.totalTf) for r in ix.top_terms(index, 5).orderBy("rank").collect()] == [(w, len(lists[w]), sum(map(len, lists[w].values()))) for w in top[:5]]


def test_empty_corpus(spark):
    index = ix.build_index(spark.createDataFrame([], "doc_id long, text string"), scratch.new_folder(spark, "index-test"))
    assert ix.and_query(index, "ash").collect() == [] and ix.or_query(index, "ash").collect() == [] and ix.index_stats(index).first().postings == 0


def test_postings_shuffle_nothing(spark):
    df = spark.createDataFrame([(1, "ash oak ash")], "doc_id long, text string")
    for found in (an.inverted_index(df), an.query_postings(df, "ash")):
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert an.or_query(df, "ash oak")._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 1


def test_files_hold_whole_cells(built):
    """Documents are dealt, not postings: a cell is one file's, in which blocks are sorted."""
    index, _, _ = built
    where = defaultdict(set)
    files = defaultdict(list)
    for r in index.blocks.selectExpr("input_file_name() as f", "term", "cell").collect():
        where[r.cell].add(r.f)
        files[r.f].append((r.term, r.cell))
    assert len(where) > 5 and all(len(f) == 1 for f in where.values())
    assert all(blocks == sorted(set(blocks)) for blocks in files.values())


def test_words_are_sorted_without_a_comparator(spark):
    df = an.inverted_index(spark.createDataFrame([(1, "oak ash oak")], "doc_id long, text string"))
    assert sorted(tuple(r) for r in df.collect()) == [("ash", 1, 1, [1]), ("oak", 1, 2, [0, 2])]
    assert "array_sort" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_every_place_is_kept_in_bounded_blocks(spark, monkeypatch):
    """A term's places beyond the 50th are in the index; blocks that end by their places answer as whole ones do."""
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(["ash", "oak", "elm"], weights=[i % 7, 1, 0.1], k=rng.randrange(200)))) for i in range(60)]
    df = spark.createDataFrame([*rows, (70, "fir " * 300)], "doc_id long, text string").repartition(3)
    lists = postings([*rows, (70, "fir " * 300)])
    for most in (ix.MOST_PLACES, 256):
        monkeypatch.setattr(ix, "MOST_PLACES", most)
        index = ix.build_index(df, scratch.new_folder(spark, "index-test"))
        blocks = index.blocks.collect()
        assert (max(Counter((r.term, r.cell) for r in blocks).values()) > 2) == (most == 256)
        assert all(r.total - r.counts[-1] <= most for r in blocks)
        assert {(r.term, r.doc_id): (r.tf, r.positions) for r in ix.query_postings(index, "ash oak elm fir").collect()} == {(w, d): (len(p), p) for w in lists for d, p in lists[w].items()}
        for query in ("ash", "ash oak", "elm oak ash", "ash fir"):
            wanted = query.split()
            assert Counter(r[0] for r in ix.and_query(index, query).collect()) == Counter(set.intersection(*[set(lists[w]) for w in wanted]))
            assert [tuple(r)[:4] for r in ix.or_query(index, query, 5).orderBy("rank").collect()] == [w[:4] for w in ranked(lists, wanted)[:5]]
        stats = ix.index_stats(index).first()
        assert (stats.terms, stats.postings) == (4, sum(map(len, lists.values())))
        assert [(r.df, r.totalTf) for r in ix.top_terms(index).orderBy("rank").collect()] == sorted(((len(p), sum(map(len, p.values()))) for p in lists.values()), reverse=True)
