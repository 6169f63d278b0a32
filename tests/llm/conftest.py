import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, row string, body string, score double, shard int"


@pytest.fixture
def documents(spark):
    """A function that makes a documents table, with extra columns under names that operators use themselves."""

    def make(rows):
        data = [(i, t, "en", s, len(t) if t is not None else None, 1, "r", "b", 0.5, 3) for i, t, s in rows]
        return spark.createDataFrame(data, DOCS)

    return make


@pytest.fixture
def odd(documents):
    """Nulls, blanks, ties, repeated rows and one long text."""
    long = " ".join(f"w{i}" for i in range(30_000))
    return documents(
        [(1, "a b c d e f", "x"), (2, "a b c d e f", None), (2, "a b c d e f", None), (3, None, "y"), (4, "", "y"), (5, " \n\t ", "x"), (None, "only null key", "x"), (6, long, "x"), (7, "x", None)]
    )


@pytest.fixture
def none(documents):
    return documents([])
