import random

import pytest

from glossa.operators.matching import ValidationError
from glossa.sources import csv_table as ct
from glossa.plans import queries
from glossa.sources.files import export_csv


def parse_csv(content):
    """Sign by sign."""
    rows, row, cell, quoted, k = [], [], "", False, 0
    while k < len(content):
        c, two = content[k], content[k : k + 2]
        k += 1
        if quoted and two == '""':
            cell, k = cell + c, k + 1
        elif c == '"':
            quoted = not quoted
        elif quoted or c not in ",\r\n":
            cell += c
        else:
            row, cell = [*row, cell], ""
            if c != ",":
                k += two == "\r\n"
                rows, row = [*rows, row], []
    if cell or row:
        rows.append([*row, cell])
    return [r for r in rows if any(x.strip() for x in r)]


def random_table(rng, n):
    cells = ["", "a", "b c", '"x,y"', '"line\nbreak"', '"say ""hi"""', 'mid"quo,ted"end', '""', '"\r\n"', "é", '"' + "long\n" * 20 + '"', " "]
    return "".join(",".join(rng.choices(cells, k=rng.randrange(1, 4))) + rng.choice(["\n", "\r\n", "\r", "\n\n"]) for _ in range(n))


def test_rows_of_a_text():
    rng = random.Random(1)
    for _ in range(300):
        content = random_table(rng, 3)
        for text in (content, content.rstrip("\r\n"), content[:-3], content[1:]):
            assert ct.split_rows(text) == parse_csv(text), text


@pytest.mark.parametrize("block", [64, 1 << 20])
def test_rows_over_blocks(spark, tmp_path, block):
    rng = random.Random(block)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        content = random_table(rng, 60) + "last,row"
        (tmp_path / "t.csv").write_bytes(content.encode())
        rows = ct.csv_rows(spark, str(tmp_path / "t.csv")).collect()
        if block == 64:
            assert len({r.block for r in rows}) > 5
        ordered = [r.fields for r in sorted(rows, key=lambda r: (r.block, r.place, r["row"]))]
        assert ordered == parse_csv(content)
    finally:
        for name, value in zip(("maxPartitionBytes", "openCostInBytes"), before):
            spark.conf.set(f"spark.sql.files.{name}", value)


def test_table_of_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\nid, body\n1,"x, y"\n2\n3,z,more\n')
    (tmp_path / "b.csv").write_text('id,body\r4,"un\nclosed')
    out = ct.csv_table(spark, str(tmp_path))
    assert out.columns == ["id", "body"]
    assert sorted(map(tuple, out.collect())) == [("1", "x, y"), ("2", ""), ("3", "z"), ("4", "un\nclosed")]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "e.csv").write_text("\n")
    with pytest.raises(ValidationError):
        ct.csv_table(spark, str(tmp_path / "none"))


def test_documents_come_back_from_an_export(spark):
    folder = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in queries.QUERIES["csv_round_trip"](spark, folder).collect()}
    import hashlib

    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(docs) == len(rows) and all(rows[d.doc_id].digest == hashlib.md5(d.text.encode()).hexdigest() and rows[d.doc_id].source == d.source for d in docs)


def test_export_keeps_edges_and_line_ends(spark, tmp_path):
    values = [" a ", "b\r", "\n", 'q"q', ",", "\tz"]
    export_csv([spark.createDataFrame([(v,) for v in values], "v string")], str(tmp_path / "o"))
    assert sorted(r.fields[0] for r in ct.csv_rows(spark, str(tmp_path / "o")).collect()) == sorted([v for v in values if v.strip()] + ["v"] * len({p.name for p in (tmp_path / "o").glob("*.csv")}))
