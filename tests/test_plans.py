import os

import pytest

import __spark_entry__ as entry
from glossa.operators import statistics
from glossa.operators.matching import ValidationError
from glossa.plans import benchmark, experiments, queries, recommender, registry
from glossa.plans.registry import Input, execute
from glossa.sources import workloads
from glossa.sources.store import Store

SF = "/root/testdata/sf0.001"


def test_registry(spark):
    assert registry.metadata(spark).count() == 12
    assert {r["category"]: r["count"] for r in registry.categories(spark).collect()} == {"string-matching": 4, "multi-pattern": 1, "text-structures": 3, "text-analytics": 4}
    with pytest.raises(ValidationError):
        execute(spark, "none", Input())


@pytest.mark.parametrize(
    "algorithm,given,field,want",
    [
        ("kmp", Input(text="abcabc", pattern="bc"), "matches", [1, 4]),
        ("aho-corasick", Input(text="ushers", patterns=["he", "she", "his", "hers"]), "totalMatches", 3),
        ("trie", Input(patterns=["tea", "ten", "to", "inn"], query="te"), "completions", ["tea", "ten"]),
        ("kasai", Input(text="banana"), "distinctSubstrings", 15),
        ("edit-distance", Input(text="kitten", text_b="sitting"), "distance", 3),
        ("inverted-index", Input(documents=["home sales", "home july", "sales july"], query="home sales"), "andResults", [0]),
        ("tfidf", Input(documents=["red cat", "red dog"]), "vocabularySize", 3),
        ("similarity", Input(text="red cat", text_b="red cat"), "score", 1.0),
    ],
)
def test_execute(spark, algorithm, given, field, want):
    assert execute(spark, algorithm, given).output[field] == want


@pytest.mark.parametrize("algorithm,given", [("kmp", Input(text="", pattern="a")), ("naive", Input(text="a", pattern="ab")), ("aho-corasick", Input(text="a", patterns=[])), ("tfidf", Input(documents=["  "]))])
def test_invalid(spark, algorithm, given):
    with pytest.raises(ValidationError):
        execute(spark, algorithm, given)


def test_recommend(spark):
    df = recommender.profiles(spark, [{"task": "multi-pattern", "patternCount": 50, "textSize": 1e6}, {"task": "fuzzy-match", "textSize": 100}])
    got = recommender.recommend(df).where("rank = 1").orderBy("profile_id").collect()
    assert [r["algorithmId"] for r in got] == ["aho-corasick", "edit-distance"]
    assert recommender.recommend(df).count() == 24
    assert recommender.verification(df).where("profile_id = 0").first()["workload"] == "pattern-heavy"


def test_benchmarks(spark):
    w = workloads.generate("random", 500)
    found = benchmark.compare(spark, ["kmp", "edit-distance"], w, repetitions=1)
    assert [e["correctness"] for e in found] == ["verified", "verified"]
    points, fits = benchmark.scaling(spark, ["kmp"], [100, 400], "random", repetitions=1)
    assert points.count() == 2 and fits.count() == 1
    assert len(benchmark.stress(spark, ["boyer-moore"], ["repetitive", "worst-case"], 200, repetitions=1)) == 2
    with pytest.raises(ValidationError):
        benchmark.scaling(spark, ["kmp"], [100], "random")


def test_experiments(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    data = store.create_dataset("d", "home sales\nhome july")
    config = {"mode": "run", "algorithms": ["tfidf", "kmp"], "dataset_id": data, "input": {"query": "home"}}
    new, run = experiments.create_and_run(spark, store, "e", config)
    experiments.rerun(spark, store, new)
    assert store.experiments().first()["runs"] == 2 and store.recent_runs().count() == 2
    experiments.duplicate(spark, store, new)
    assert store.latest("experiments").where("parent_id is not null").count() == 1
    assert store.activity().count() == 3


def test_challenges(spark):
    answers = {"find-pattern-1": "[0, 7, 12, 19]", "lps-2": "0 0 1 2 3 4 5 6", "kmp-next-step": "2", "compare-1": "KMP", "sa-1": "5,3,1,0,4,2", "ed-1": "3", "ac-1": "3", "complexity-1": "O(n·m)"}
    assert all(experiments.grade(spark, k, v) for k, v in answers.items())
    assert not experiments.grade(spark, "ed-2", "5")


def _compare(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    df = queries.QUERIES[name](spark, SF)
    result = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)

    def plain(v):
        return round(v, 6) + 0.0 if isinstance(v, float) else v

    want = sorted(repr([plain(r[names.index(c)]) for c in sorted(names)]) for r in result.fetchall())
    got = sorted(repr([plain(r[c]) for c in sorted(names)]) for r in df.collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    _compare(spark, name)


@pytest.mark.parametrize("name", ["naive_counters", "rabin_karp_hits"])
def test_counters_of_short_texts(spark, tmp_path, name):
    """A text that is shorter than the pattern has a row in SQL too."""
    import duckdb

    rows = [(1, "A."), (2, ""), (3, None), (4, "the"), (5, "thermal the")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(queries.ORACLE_SQL[name]).fetchall()) and len(got) == 5


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_other_queries_run(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_run_matrix_is_one_aggregate(spark):
    rows = [(1, "a", 2.0), (1, "a", 3.0), (1, "b", None), (2, "c", 5.0), (None, "b", 7.0)]
    df = spark.createDataFrame(rows, "run_id int, algorithmId string, runtimeMs double")
    out = {how: {r[0]: tuple(r)[1:] for r in statistics.matrix(df, "run_id", "algorithmId", "runtimeMs", ["a", "b"], how).collect()} for how in ("max", "sum", "avg", "count")}
    assert out["max"] == {1: (3.0, None), 2: (None, None), None: (None, 7.0)}
    assert out["sum"][1] == (5.0, None) and out["avg"][1] == (2.5, None) and out["count"] == {1: (2, 0), 2: (None, None), None: (None, 1)}
    first = statistics.matrix(df.where("runtimeMs is null or runtimeMs > 2"), "run_id", "algorithmId", "runtimeMs", ["a", "b"])
    assert {tuple(r) for r in first.collect()} == {(1, 3.0, None), (2, None, None), (None, None, 7.0)}
    plan = _plan(queries.QUERIES["run_matrix"](spark, SF))
    assert "pivotfirst" not in plan and f", {queries._ENTRY_PARTS})" in plan


def test_scaling_series_shuffles_no_points(spark):
    """An algorithm's constant comes to its points, however large the tables are."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" not in _plan(queries.QUERIES["scaling_series"](spark, SF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_dictionary_matches_holds_no_groups_of_a_scan(spark):
    """All aggregates of matches are behind the exchange that deals them; none is held by the task that scans."""
    plan = _plan(queries.QUERIES["dictionary_matches"](spark, SF))
    assert f", {queries._DOCUMENT_PARTS})" in plan and plan.index(f", {queries._DOCUMENT_PARTS})") > plan.rindex("min(pos")


def test_entry(spark):
    assert entry.entry(spark).count() == 30
    assert set(entry.oracle_sql()) <= set(entry.queries())
