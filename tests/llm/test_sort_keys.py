import datetime as dt
import itertools
import random
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glossa.llm import sort_keys
from glossa.llm.sort_keys import encode, keys_at, with_keys

INF, NAN = float("inf"), float("nan")

COLUMNS = [
    (pa.int64(), [None, -(2**63), -5, -1, 0, 1, 255, 256, 2**63 - 1]),
    (pa.int32(), [None, -(2**31), -1, 0, 7, 2**31 - 1]),
    (pa.bool_(), [None, False, True]),
    (pa.float64(), [None, -INF, -1e300, -1.5, -1e-300, 0.0, 1e-300, 0.5, 1.5, 1e300, INF, NAN]),
    (pa.float32(), [None, -INF, -1.5, 0.0, 1.5, NAN]),
    (pa.string(), [None, "", "\x00", "\x00\x00", "\x00\x01", "\x00a", "\x01", "a", "a\x00", "a\x00\x00", "a\x00b", "aa", "ab", "b", "é", "￿", "\U0001f600"]),
    (pa.binary(), [None, b"", b"\x00", b"\x00\xff", b"\x01", b"\xff", b"\xff\xff"]),
    (pa.timestamp("us"), [None, dt.datetime(1901, 1, 1), dt.datetime(1970, 1, 1), dt.datetime(2024, 1, 1, 0, 0, 0, 1)]),
    (pa.date32(), [None, dt.date(1901, 1, 1), dt.date(2024, 1, 1)]),
    (pa.decimal128(20, 2), [None, Decimal("-10.50"), Decimal("-0.01"), Decimal("0"), Decimal("99999.99")]),
    (pa.list_(pa.int64()), [None, [], [None], [None, 1], [-1], [0], [0, None], [0, 0], [1]]),
    (pa.struct([("a", pa.int64()), ("b", pa.string())]), [None, {"a": None, "b": "z"}, {"a": 1, "b": None}, {"a": 1, "b": "x"}]),
]


@pytest.mark.parametrize("kind, ordered", COLUMNS)
def test_keys_compare_as_values(kind, ordered):
    keys = encode([pa.array(ordered, kind)]).to_pylist()
    assert all(a < b for a, b in itertools.pairwise(keys))
    assert not any(a != b and b.startswith(a) for a in keys for b in keys)


def test_minus_zero_is_zero():
    a, b = encode([pa.array([0.0, -0.0])]).to_pylist()
    assert a == b


def test_rows_compare_by_column():
    rng = random.Random(3)
    rows = [(rng.randrange(3), rng.choice([None, 1, 2]), rng.choice([None, "", "a", "a\x00", "b"]), rng.choice([None, -0.5, 2.0]), i) for i in range(400)]
    lead, tail = np.array([r[0] for r in rows]), np.array([r[4] for r in rows])
    keys = encode([pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.float64())], lead, tail).to_pylist()
    plain = lambda r: (r[0], *((v is not None, v if v is not None else 0) if not isinstance(v, str) else (True, v.encode()) for v in (r[1],)), (r[2] is not None, (r[2] or "").encode()), (r[3] is not None, r[3] or 0.0), r[4])
    assert sorted(range(400), key=lambda i: keys[i]) == sorted(range(400), key=lambda i: plain(rows[i]))


@pytest.mark.parametrize("leaf", [1, 7, 20_000])
def test_splitters_are_exact(spark, monkeypatch, leaf):
    monkeypatch.setattr(sort_keys, "LEAF", leaf)
    rng = random.Random(leaf)
    # A third of the rows share all but the number, another third the lead.
    rows = [(5, "same", 1) if k % 3 == 0 else (5, f"t{rng.randrange(10**6)}", None) if k % 3 == 1 else (rng.randrange(2**32), "x" * rng.randrange(30), k) for k in range(900)]
    df = spark.createDataFrame(rows, "lead long, t string, k long").repartition(4)
    path = sort_keys_path(spark, df)
    keyed = spark.read.parquet(path)
    ordered = sorted(bytes(r["key"]) for r in keyed.select("key").collect())
    ranks = [1, 50, 51, 299, 300, 301, 450, 898, 899]
    assert keys_at(keyed, ranks) == [ordered[k] for k in ranks]
    assert keys_at(keyed, []) == []


def sort_keys_path(spark, df):
    import uuid

    path = f"{spark.conf.get('spark.checkpoint.dir')}/{uuid.uuid4().hex}"
    with_keys(df.select("lead", F.struct("t", "k").alias("row")), "lead").write.parquet(path)
    return path
