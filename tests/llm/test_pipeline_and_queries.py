import os
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from glossa.llm import exact_dedup, mixing, queries, staging, url_filters
from glossa.llm.toxicity import toxicity
from pyspark.sql import functions as F
from test_links import Union, shingles
from test_mixing_packing_urls import brute_mix, n_words

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, before = docs.columns, docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard_join", "mixing", "best_fit_packing"]
    counts = [before]
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns == names
        counts.append(docs.count())
        if name == "exact_dedup":
            assert docs.select("text").distinct().count() == docs.count()
    assert counts[1] < counts[0] and counts[2] < counts[1] and counts[3] <= counts[2]


def brute_run(docs, rejected):
    """(doc_id, text) as often as the pipeline packs it."""
    kept = [(i, t, s) for i, t, s in docs if i not in rejected]
    last = {}
    for i, t, _ in kept:
        last[t] = max(i, last.get(t, i))
    kept = [d for d in kept if last[d[1]] == d[0]]
    sets = {i: shingles(t, 5) for i, t, _ in kept}
    of = defaultdict(set)
    for i, shingle_set in sets.items():
        for x in shingle_set:
            of[x].add(i)
    union = Union(sets)
    for i, mine in sets.items():
        for j, both in Counter(j for x in mine for j in of[x] if j < i).items():
            if 100 * both >= 80 * (len(mine) + len(sets[j]) - both):
                union.join(i, j)
    kept = [d for d in kept if union.find(d[0]) == d[0]]
    copies = brute_mix(kept, 1 << 20)
    return Counter({(i, t): len(copies[i]) for i, t, _ in kept if copies[i]})


def test_run_equals_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rejected = {r["doc_id"] for r in toxicity(docs, labels).where("predicted = 1").collect()}
    want = brute_run([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()], rejected)
    rows = corpus_pipeline.run(spark, SF).collect()
    pieces, bins = defaultdict(lambda: defaultdict(list)), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]][r["piece"]].append(r["text"])
        bins[r["bin"]].append(r)
    got = Counter({(i, "".join(p[k][0] for k in sorted(p))): len(p[0]) for i, p in pieces.items()})
    assert got == want
    assert all(len({*x}) == 1 and len(x) == len(p[0]) for p in pieces.values() for x in p.values())
    assert all(sum(r["size"] for r in b) == b[0]["bin_fill"] <= 2048 and len({r["text"] for r in b}) == len(b) for b in bins.values())


ODD = "doc_id long, text string, lang string, source string, n_chars long, shard int, position int, bin long, digest long, row string, id long, score double, size long"


def odd_corpus(spark, folder, rows):
    docs = spark.createDataFrame([(i, t, None, s, None, 1, 2, 3, 4, "r", 5, 0.5, 6) for i, t, s in rows], ODD)
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(i, None, int(bool(t) and "idiot" in t)) for i, t, _ in rows] + [(7, 1, None), (None, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_stages_take_odd_rows(spark, tmp_path):
    long = " ".join(f"w{k}" for k in range(9000))
    rows = [(i, f"a plain text about the river number {i} and the hill", "s") for i in range(60)] + [(100 + i, f"you idiot number {i} are an idiot", "s") for i in range(60)]
    rows += [(1, "a plain text about the river number 1 and the hill", "s")] * 3 + [(None, "no key", "s"), (None, "no key", None), (None, None, None), (200, None, "t"), (201, "", "t"), (202, " \n ", None), (203, long, None), (None, long, "t")]
    docs = odd_corpus(spark, tmp_path, rows)
    names, counts = docs.columns, [docs.count()]
    for k, (_, step) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = step(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        assert docs.columns == names
        counts.append(docs.count())
    assert counts[1] <= counts[0] - 50 and counts[2] < counts[1]
    assert docs.where("shard <> 1 or position <> 2 or bin <> 3 or digest <> 4 or size <> 6").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    texts = Counter(r["text"] for r in docs.collect() if r["text"] is not None)
    words = sum(n * n_words(t) for t, n in texts.items())
    assert sum(r["size"] for r in packed) == words and any(r["doc_id"] == 203 and r["piece"] == 4 for r in packed) == (long in {t for t in texts})
    assert sum(r["size"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == words


def test_pipeline_of_an_empty_table(spark, tmp_path):
    odd_corpus(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_staged_tables_end_with_their_scope(spark):
    def there(df):
        folder, place = staging._folder(spark, df._staged_at)
        return folder.exists(place)

    with staging.scope() as held:
        a, b = (staging.stage(spark.range(3).withColumn("x", F.lit(k)), "scope-test") for k in range(2))
        held.remove(b)
        assert there(a) and there(b)
    assert not there(a) and there(b) and b.count() == 3
    staging.discard(b)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    df = queries.QUERIES[name](spark, SF)
    result = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    want = sorted(repr([r[names.index(c)] for c in sorted(names)]) for r in result.fetchall())
    assert sorted(repr([r[c] for c in sorted(names)]) for r in df.collect()) == want


NATIVE = {
    **{name: queries.QUERIES[name] for name in ("op2_url_filters", "op7_exact_dedup", "op9_mixing")},
    "urls by a table of rules": lambda spark, sf: url_filters.judge_urls(spark.read.parquet(f"{sf}/pages.parquet"), queries.URL_RULES, literal_rules=0),
    "dedup with rows": lambda spark, sf: exact_dedup.exact_dedup(spark.read.parquet(f"{sf}/documents.parquet"), carry=True),
    "mix with rows": lambda spark, sf: mixing.mix(spark.read.parquet(f"{sf}/documents.parquet"), carry=True),
}


@pytest.mark.parametrize("name", sorted(NATIVE))
def test_native_queries_have_no_python_in_any_plan(spark, monkeypatch, name):
    plans = []

    def watched(df, label, real=staging.stage):
        plans.append(df._jdf.queryExecution().toString())
        return real(df, label)

    for module in (exact_dedup, mixing, staging):
        monkeypatch.setattr(module, "stage", watched)
    plans.append(NATIVE[name](spark, SF)._jdf.queryExecution().toString())
    assert len(plans) > ("urls" not in name and "op2" not in name)
    assert not any(x in plan for plan in plans for x in ("Python", "Pandas", "ArrowEval", "InArrow", "ExternalRDD", "MapPartitions"))
