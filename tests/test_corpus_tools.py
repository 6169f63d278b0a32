import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from glossa.functions import preprocess as pp
from glossa.functions import text as tx
from glossa.operators import statistics as stt
from glossa.operators.matching import ValidationError
from glossa.sources import files, workloads
from glossa.sources.store import Store
from glossa.streaming import text as streaming


def text(spark, value):
    return spark.createDataFrame([(value,)], "text string")


def test_tokens(spark):
    df = text(spark, "The quick, brown fox's 'quoted' Été!")
    row = df.select(tx.tokens(F.col("text"), remove_stop_words=True).alias("a"), tx.tokens(F.col("text"), lowercase=False).alias("b")).first()
    assert row["a"] == ["quick", "brown", "fox's", "quoted", "été"]
    assert row["b"][0] == "The"


def test_pipeline(spark):
    flags = ["lowercase", "removePunctuation", "normalizeWhitespace", "removeEmptyLines", "removeDuplicateLines"]
    row = pp.preprocess(text(spark, "The  Cat!\n\nThe  Cat!\nA dog."), dict.fromkeys(flags, True), report="r").first()
    assert row["text"] == "the cat\na dog"
    assert [s["name"] for s in row["r"]["steps"]] == flags and row["r"]["before"]["lines"] == 4
    with pytest.raises(ValueError):
        pp.preprocess(text(spark, "x"), {"other": True})


@pytest.mark.parametrize(
    "flag,before,after",
    [
        ("removeStopWords", "the, S3 été cat", "   cat"),
        ("normalizeUnicode", "Élan ﬁn", "Elan fin"),
        ("removeDuplicateLines", "a\n\na\n\nb", "a\n\n\nb"),
        ("tokenize", "It's  'A' test.\nOK", "It's A test\nOK"),
    ],
)
def test_stages(spark, flag, before, after):
    assert pp.preprocess(text(spark, before), {flag: True}).first()["text"] == after


def test_statistics(spark):
    row = stt.dataset_stats(text(spark, "Hello world\nhello again\n\nworld")).first()
    assert (row["lines"], row["documents"], row["words"], row["vocabularySize"]) == (4, 3, 5, 3)
    assert stt.top_words(text(spark, "Hello world\nhello again\n\nworld")).where("rank = 1").first()["count"] == 2
    empty = stt.dataset_stats(spark.createDataFrame([], "text string")).first()
    assert empty["words"] == 0 and empty["avgDocumentLength"] == 0.0


def test_scaling_fit(spark):
    points = spark.createDataFrame([("a", "n", n, 1, 3.0 * n) for n in (10, 100, 1000)], "id string, model string, n long, m long, t double")
    row = stt.scaling_fit(points, "id").first()
    assert abs(row["constant"] - 3) < 1e-9 and abs(row["exponent"] - 1) < 1e-9


def test_files(spark, tmp_path):
    (tmp_path / "x.csv").write_text('id, body\n1,"hello, world"\n2,"say ""hi""\nagain"\n3,\n')
    assert [r["text"] for r in files.read_csv(spark, str(tmp_path / "x.csv")).collect()] == ["hello, world", 'say "hi" again']
    with pytest.raises(ValidationError):
        files.read_csv(spark, str(tmp_path / "x.csv"), "none")
    (tmp_path / "x.txt").write_text("one\r\n\n two \n")
    assert [r["text"] for r in files.read_text(spark, str(tmp_path / "x.txt")).orderBy("line").collect()] == ["one", "two"]
    for bad in ("   ", "a\0b"):
        with pytest.raises(ValidationError):
            files.validate_content(bad)
    assert files.validate_content("a\r\nb") == "a\nb"
    a, b = spark.createDataFrame([(1, 'q"x')], "a int, b string"), spark.createDataFrame([(2,)], "c int")
    files.export_csv([a, b], str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True, quote='"', escape='"').columns == ["a", "b", "c"]


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    first = store.create_dataset("one", "The  Cat!\nA dog.")
    assert store.preprocess_version(first, {"lowercase": True}) == 2
    assert store.content(first).first()["text"] == "the  cat!\na dog."
    assert store.content(first, 1).first()["text"] == "The  Cat!\nA dog."
    store.update_dataset(first, name="renamed")
    row = store.datasets().first()
    assert (row["name"], row["current_version"]) == ("renamed", 2) and "vocabularySize" in row["stats"]
    store.remove("datasets", first)
    assert store.datasets().count() == 0
    with pytest.raises(KeyError):
        store.dataset(first)


def test_draws(spark):
    want = [next(g) for g in [workloads.draws(42)] for _ in range(500)]
    assert want[:2] == [0.6011037519201636, 0.44829055899754167]
    got = [r["u"] for r in spark.range(500).select("id", workloads.draw(42, F.col("id")).alias("u")).orderBy("id").collect()]
    assert got == want
    assert workloads.generate("random", 500).text == "".join(r["c"] for r in workloads.random_characters(spark, 500).orderBy("i").collect())


@pytest.mark.parametrize("kind", workloads.TYPES)
def test_workloads(kind):
    a, b = workloads.generate(kind, 1500), workloads.generate(kind, 1500)
    assert a == b and len(a.text) == 1500 and a.patterns and a.documents and len(a.text_b) == len(a.text)
    if kind not in ("worst-case", "adversarial"):
        assert workloads.generate(kind, 1500, seed=9).text != a.text or kind == "best-case"


def test_streams(spark, tmp_path):
    rows = [(i, f"alpha beta {random.Random(i).choice(['x', 'y'])}", f"2024-01-01 00:{i:02d}:00") for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, t string").selectExpr("doc_id", "text", "timestamp(t) ts").write.parquet(str(tmp_path / "in"))
    stream = streaming.windowed_terms(streaming.read_documents(spark, str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("terms").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(str(r["start"])[11:16], r["term"]): r["count"] for r in spark.table("terms").collect()}
    assert got["00:00", "alpha"] == 10 and got["00:10", "beta"] == 10


def test_marks_are_stripped_a_text_at_a_time(spark):
    """The same forms as pandas gives, and no series of whole batches."""
    texts = ["Éaux", "ﬁn ①", "e\u0301\u0302", "\u0345x", "plain", "", None, "한국 Ω"]
    want = [t and unicodedata.normalize("NFKC", re.sub("[\u0300-\u036f]", "", unicodedata.normalize("NFKD", t))) for t in texts]
    out = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", tx.strip_marks(F.col("t")).alias("t"))
    assert [r.t for r in out.orderBy("k").collect()] == want
    assert "ArrowEvalPython" in out._jdf.queryExecution().executedPlan().toString() and not hasattr(tx, "pd")
