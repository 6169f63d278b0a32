import json
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from glossa.operators import counters as co
from glossa.operators import structures as st
from glossa.operators.matching import ValidationError
from glossa.plans import benchmark, dashboard, experiments, learning, queries, recommender, registry, traces
from glossa.plans.registry import Input, execute
from glossa.sources import files, workloads
from glossa.sources.store import Store


# Counters


def automaton_by_hand(text, patterns):
    prefixes = {p[:k] for p in patterns for k in range(len(p) + 1)}
    fall = lambda q: next(q[k:] for k in range(1, len(q) + 1) if q[k:] in prefixes)
    compared, at = 0, ""
    for c in text:
        compared += 1
        while at and at + c not in prefixes:
            at, compared = fall(at), compared + 1
        at = at + c if at + c in prefixes else ""
    made, waiting = sum(map(len, patterns)), deque(q for q in prefixes if len(q) == 1)
    while waiting:
        q = waiting.popleft()
        for r in (x for x in prefixes if x[:-1] == q and x):
            waiting.append(r)
            f = fall(q)
            while f and f + r[-1] not in prefixes:
                f, made = fall(f), made + 1
            made += 1
    return compared, made + len(text)


def test_automaton_counters(spark):
    rnd = random.Random(3)
    for patterns in (["he", "she", "his", "hers"], ["a", "ab", "bab", "bab", "caa"], ["aaa", "aab", "b"]):
        rows = [(i, "".join(rnd.choice("abches") for _ in range(rnd.randint(0, 40)))) for i in range(30)] + [(99, None)]
        got = {r["doc_id"]: (r["comparisons"], r["operations"]) for r in co.automaton_counters(spark.createDataFrame(rows, "doc_id long, text string"), patterns).collect()}
        assert got == {i: automaton_by_hand(t or "", patterns) for i, t in rows}


def test_trie_counters(spark):
    words = ["fir", "fern", "fennel", "fern", ""]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    for query, walked in (("fe", 2), ("fen", 3), ("fex", 3), ("x", 1), ("", 0), ("fernery", 5)):
        r = co.trie_counters(df, query).first()
        assert (r["comparisons"], r["operations"]) == (17 + walked, 17)


def lcp_by_hand(t):
    order = sorted(range(len(t)), key=lambda i: t[i:])
    rank, h, compared = {p: r for r, p in enumerate(order)}, 0, 0
    for i in range(len(t)):
        if rank[i] == 0:
            h = 0
            continue
        j = order[rank[i] - 1]
        while i + h < len(t) and j + h < len(t):
            compared += 1
            if t[i + h] != t[j + h]:
                break
            h += 1
        h = max(0, h - 1)
    return compared, len(t) - 1


def test_lcp_counters(spark):
    texts = ["banana", "senselessness", "tralalala", "aaaa", "ab", "abcabcabc"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["comparisons"], r["operations"]) for r in co.lcp_counters(st.suffix_array(df), df).collect()}
    assert got == {i: lcp_by_hand(t) for i, t in enumerate(texts)}


def test_index_counters(spark):
    rnd = random.Random(5)
    docs = [" ".join(rnd.choices(["rain", "snow", "hill", "coast", "sun"], weights=[5, 3, 2, 1, 1], k=rnd.randint(0, 4))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    for query in ("rain snow hill", "coast rain", "nothing rain", "sun", "", "coast sun hill snow rain"):
        asked = query.split()
        lists = [[i for i, d in enumerate(docs) if t in d.split()] for t in asked]
        compared, operations = len(asked), sum(len(d.split()) for d in docs) + sum(map(len, lists))
        lists = sorted(lists, key=len)
        both = lists[0] if lists else []
        for other in lists[1:]:
            i = j = 0
            kept = []
            while i < len(both) and j < len(other):
                compared += 1
                if both[i] == other[j]:
                    kept.append(both[i])
                    i, j = i + 1, j + 1
                elif both[i] < other[j]:
                    i += 1
                else:
                    j += 1
            both = kept
        r = co.index_counters(df, query).first()
        assert (r["comparisons"], r["operations"]) == (compared, operations), query


# Execution, traces, learning


def test_execution_tells_all(spark):
    r = execute(spark, "trie", Input(patterns=["fir", "fern"], query="fe"), record=True)
    assert r.preview == "fir, fern" and r.complexity["worst"] == "O(L)" and r.steps and not r.truncated and r.metrics["heapDeltaBytes"] >= 0
    assert registry.compact(r).steps == []
    r = execute(spark, "kmp", Input(text="ababab", pattern="ab"), record=True, most_steps=3)
    assert len(r.steps) == 3 and r.truncated
    with pytest.raises(ValidationError):
        execute(spark, "suffix-array", Input(text="x" * 25), record=True)
    for algorithm, given in (("aho-corasick", Input(text="ushers", patterns=["he"])), ("similarity", Input(text="red cat", text_b="red dog")), ("tfidf", Input(documents=["red cat"]))):
        assert {"comparisons", "operations", "memoryBytes"} <= set(execute(spark, algorithm, given).metrics)


@pytest.mark.parametrize("algorithm", sorted(learning.PRESETS))
def test_presets_can_be_traced(spark, algorithm):
    assert set(traces.TRACES) == set(learning.NOTES) == set(learning.PRESETS) == set(registry.META) == set(traces.LIMITS)
    for label, given in learning.PRESETS[algorithm]:
        steps, truncated = traces.trace(algorithm, given)
        assert label and steps and not truncated and all(set(s) == {"phase", "description", "vars"} for s in steps)
    assert traces.trace_frame(spark, algorithm, learning.PRESETS[algorithm][0][1], 2).count() == 2


def test_traces_find_what_the_operators_find(spark):
    for algorithm in ("naive", "kmp", "rabin-karp", "boyer-moore"):
        for _, given in learning.PRESETS[algorithm]:
            found = sum(s["phase"] == "match" for s in traces.trace(algorithm, given)[0])
            assert found == execute(spark, algorithm, given).output["totalMatches"]
    assert learning.learning(spark).count() == 12


# Benchmarks, store, reports


def test_history_and_overviews(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert dashboard.store_totals(store).first().asDict() == {"algorithms": 12, "categories": 4, "datasets": 0, "experiments": 0, "benchmarks": 0, "visualizable": 12}
    w = workloads.generate("random", 300)
    benchmark.compare(spark, ["kmp", "similarity"], w, repetitions=1, store=store)
    points, _ = benchmark.scaling(spark, ["kmp"], [100, 300], "random", repetitions=1, store=store)
    benchmark.stress(spark, ["naive"], ["repetitive"], 200, repetitions=1, store=store)
    assert [r["kind"] for r in store.benchmarks().orderBy("id").collect()] == ["compare", "scaling", "stress"]
    assert {r["algorithmId"]: r["runs"] for r in dashboard.throughput(store.table("benchmark_runs")).collect()} == {"kmp": 1, "similarity": 1}
    assert dashboard.scaling_history(store.benchmarks()).count() == 1 and store.activity().count() == 3
    assert benchmark.scaling_series(points).where("theoretical > 0").count() == 2

    data = store.create_dataset("d", "home sales\nhome july")
    first, _ = experiments.create_and_run(spark, store, "e", {"mode": "run", "algorithms": ["tfidf"], "dataset_id": data})
    second, _ = experiments.create_and_run(spark, store, "f", {"mode": "run", "algorithms": ["kmp"], "input": {"text": "abab", "pattern": "ab"}})
    experiments.rerun(spark, store, first)
    runs, e = store.table("experiment_runs"), store.latest("experiments")
    assert dashboard.research_feed(runs, e).count() == 3 and dashboard.research_feed(runs, e, 2, 1).where("dataset_id is not null").count() == 0
    entries = dashboard.run_entries(runs)
    found = dashboard.runs_by_dataset(entries, e, store.datasets()).collect()
    assert [r["dataset"] for r in found] == ["d", "d"] and dashboard.run_matrix(entries, ["tfidf", "kmp"]).count() == 3
    assert dashboard.latest_matrix(entries, [first, second]).count() == 2

    assert store.rename_experiment(first, "g", "better")["description"] == "better" and store.experiment(first)[0]["name"] == "g"
    row = experiments.report(store, first).first()
    assert row["experiment"]["name"] == "g" and len(row["runs"]) == 2 and row["algorithms"][0]["id"] == "tfidf" and row["dataset"]["id"] == data and json.loads(row["environment"])["cpus"] > 0
    files.export_json(experiments.report(store, second), str(tmp_path / "r"))
    assert "dataset" not in spark.read.json(str(tmp_path / "r")).columns  # null fields are left out

    store.remove("experiments", second)
    store.remove("datasets", data)
    with pytest.raises(KeyError):
        store.versions(data)
    with pytest.raises(KeyError):
        store.content(data, 1)
    for name in ("experiment_runs", "dataset_versions", "experiments", "datasets"):
        store.compact(name)
    assert store.table("experiment_runs").count() == 2 and store.table("dataset_versions").count() == 0
    assert [r["name"] for r in store.latest("experiments").collect()] == ["g"] and store.next_id("experiments") == second + 1 and store.next_id("datasets") == data + 1


def test_sources_of_benchmarks(spark):
    given, workload = experiments.benchmark_source(spark, None, {"kind": "workload", "workload": {"type": "random", "size": 50}})
    assert given is None and len(workload.text) == 50
    given, _ = experiments.benchmark_source(spark, None, {"input": {"text": "a", "patterns": [1, "b"], "top_k": 900, "pattern": 7}})
    assert (given.text, given.patterns, given.top_k, given.pattern) == ("a", ["1", "b"], 100, None)
    with pytest.raises(ValidationError):
        experiments.benchmark_source(spark, None, {"kind": "workload", "workload": {"type": "none"}})
    with pytest.raises(ValidationError):
        experiments.sanitized({"patterns": "ab"})


@pytest.mark.parametrize("value,want", [(5, 5), ("7 of them", 7), (" -3", 1), (99, 10), (2.9, 2), (None, 4), ("x", 4), (float("nan"), 4), (True, 4)])
def test_clamped(value, want):
    assert experiments.clamp_int(value, 1, 10, 4) == want


def test_identifiers():
    assert experiments.parse_id("12") == experiments.parse_id(12) == 12
    for bad in ("0", -1, "x", "1.5", 2.5, None):
        with pytest.raises(ValidationError):
            experiments.parse_id(bad)


def test_keys_of_a_trie_are_not_cut(spark):
    w = workloads.generate("small", 20_000)
    given = benchmark.adapt("trie", w, 3_000_000)
    assert len(given.patterns) > 500 and benchmark.benchmark_one(spark, "trie", given, 1)["status"] == "error"
    assert sum(map(len, benchmark.adapt("trie", w, 100).patterns)) <= 100


def test_distances_agree(spark):
    rnd = random.Random(6)
    for _ in range(20):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 9))) for _ in range(2))
        assert spark.range(1).select(F.levenshtein(F.lit(a), F.lit(b))).first()[0] == benchmark._distance(a, b)


# Recommender


def test_profiles(spark):
    raw = [{"textSize": -1, "patternCount": 0, "repetition": "extreme", "needIndexing": "false", "streaming": True, "documentCount": 1e12}, {"task": "fuzzy-match", "patternSize": "x"}]
    a, b = recommender.profiles(spark, raw).orderBy("profile_id").collect()
    assert (a["textSize"], a["patternCount"], a["repetition"], a["needIndexing"], a["streaming"], a["documentCount"]) == (100_000.0, 1.0, "low", False, True, 1e10)
    assert (b["task"], b["patternSize"]) == ("fuzzy-match", 8.0)
    with pytest.raises(ValidationError):
        recommender.profiles(spark, [{"task": "none"}])
    with pytest.raises(Exception, match="unknown task"):
        recommender.parse_profiles(spark.createDataFrame([("none", *[None] * 9)], ", ".join(f"{k} string" for k in recommender.PROFILE))).collect()


def test_reasons(spark):
    df = recommender.profiles(spark, [{"patternSize": 2, "textSize": 500, "repetition": "high"}, {"task": "document-search", "documentCount": 40, "queryFrequency": "frequent"}])
    got = {(r["profile_id"], r["algorithmId"]): r for r in recommender.recommend(df).collect()}
    assert got[0, "naive"]["reasons"] == ["task is single-pattern: +40", "task is single-pattern, patternSize (2) is at most 3: +20", "task is single-pattern, textSize (500) is below 10,000: +10"]
    assert got[0, "naive"]["cautions"] == ["repetition is high: -30"] and got[0, "naive"]["score"] == 40
    assert got[1, "inverted-index"]["reasons"] == ["task is document-search: +90"] and got[1, "inverted-index"]["cautions"] == []
    assert got[1, "naive"]["cautions"] == ["applies only if task is single-pattern"] and not got[1, "naive"]["applicable"] and got[1, "kasai"]["reasons"] == []
    # What is said is what is scored.
    for r in got.values():
        points = [int(x.rsplit(": ", 1)[1]) for x in r["reasons"] + [c for c in r["cautions"] if not c.startswith("applies")]]
        assert r["score"] == max(0, min(100, sum(points)))
    assert got[0, "kmp"]["complexity"] == "O(n + m) worst, O(m) space"
    v = recommender.verification(df).where("profile_id = 0").first()
    assert (v["size"], v["patternLength"], v["patternCount"]) == (1000.0, 2.0, 1.0)
    said = [r["explanation"] for r in recommender.explanation(df).orderBy("profile_id").collect()]
    assert "Knuth" in said[0] and "Inverted" in said[1]


# Files


def test_pasted_tables(spark):
    content = 'id, body \r\n1,"hello, world"\n2,"say ""hi"""\r3,half "quo,ted" field\n\n ,\n4,"two\n  lines"'
    assert files.parse_csv(content)[1:4] == [["1", "hello, world"], ["2", 'say "hi"'], ["3", "half quo,ted field"]]
    assert [r["text"] for r in files.pasted_csv(spark, content).collect()] == ["hello, world", 'say "hi"', "half quo,ted field", "two lines"]
    assert files.pasted_csv(spark, content, "id").count() == 4
    for bad, column in (("a,b", None), (content, "none")):
        with pytest.raises(ValidationError):
            files.pasted_csv(spark, bad, column)


def test_uploads_are_bounded(spark, tmp_path, monkeypatch):
    (tmp_path / "a.txt").write_text("one\n\n two ")
    assert [r["text"] for r in files.read_text(spark, str(tmp_path / "a.txt"), upload=True).collect()] == ["one", "two"]
    monkeypatch.setattr(files, "MOST_BYTES", 3)
    with pytest.raises(ValidationError):
        files.read_text(spark, str(tmp_path / "a.txt"), upload=True)


def test_previews_and_payloads(spark, tmp_path):
    df = spark.createDataFrame([(1, "The  Cat!\n\nThe  Cat!\nA dog.")], "doc_id long, text string")
    config = {k: True for k in ("lowercase", "removePunctuation", "removeStopWords", "normalizeWhitespace", "removeEmptyLines")}
    r = files.preprocess_preview(df, config, key="doc_id", shown=5).first()
    assert len(r["steps"]) == 5 and r["before"]["lines"] == 4 and r["before"]["vocabulary"] == 4 and r["after"]["preview"] == "cat\nc" and r["truncated"]
    files.export_payload(spark, "t", [{"a": 1}, {"b": "x,y"}], str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first()["title"] == "t"
    files.export_payload(spark, "t", [{"a": 1}, {"b": "x,y"}], str(tmp_path / "c"), "csv")
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "c"), header=True).collect()] == [("1", None), (None, "x,y")]


def test_preview_of_a_table_keeps_empty_and_null_texts(spark, tmp_path):
    import duckdb

    df = spark.createDataFrame([(1, "The cat!"), (2, ""), (3, None), (4, " \n")], "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.QUERIES["preprocess_preview"](spark, str(tmp_path))
    sql = queries.ORACLE_SQL["preprocess_preview"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = duckdb.sql(sql)
    assert sorted(map(tuple, out.select(*want.columns).collect()), key=lambda r: r[0]) == sorted(want.fetchall(), key=lambda r: r[0])
    # A request's empty text is refused still.
    with pytest.raises(Exception, match="nothing to preprocess"):
        files.preprocess_preview(df, {"lowercase": True}).collect()
