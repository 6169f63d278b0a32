import glob
import hashlib
import math
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from glossa.llm.erasure import erase, mask

SF = "/root/testdata/sf0.001"
NAMES = ("clients", "clicks", "sales", "sale_lines")
MONEY = {"clients": "balance", "clicks": "value", "sales": "total", "sale_lines": "amount"}


def crc(x):
    return zlib.crc32(b"" if x is None else str(x).encode())


def comparable(v):
    """Nulls first, then -0 as 0, NaN last."""
    if v is None:
        return (0, 0, 0)
    if isinstance(v, float):
        return (1, 1, 0) if math.isnan(v) else (1, 0, v + 0.0)
    return (1, 0, v.encode() if isinstance(v, str) else v)


def brute(tables, share=350, every=400):
    """(table, file_no): all that is reported of a final file, by sorting whole tables."""
    clients, clicks, sales, lines = (tables[n][1] for n in NAMES)
    pairs = {(r["client_id"], r["master_id"]) for r in clients if r["master_id"] is not None}
    clicked = Counter(r["client_id"] for r in clicks if r["client_id"] is not None)
    per_master = defaultdict(int)
    for c, m in pairs:
        per_master[m] += clicked.get(c, 0)
    masters = {m for m in per_master if crc(m) % every == 0}
    if per_master:
        masters.add(min(per_master, key=lambda m: (-per_master[m], m)))
    gone = {c for c, m in pairs if m in masters and c is not None}
    owner, hit = {}, set()
    for r in sales:
        s, c = r["sale_id"], r["client_id"]
        if s is None:
            continue
        if c in gone:
            hit.add(s)
        owner[s] = c if owner.get(s) is None else min(owner[s], c) if c is not None else owner[s]
    lead = {"clients": lambda r: r["client_id"], "clicks": lambda r: r["client_id"], "sales": lambda r: r["client_id"], "sale_lines": lambda r: owner.get(r["sale_id"]) if r["sale_id"] is not None else None}
    dead = {"clients": lambda r: r["master_id"] in masters, "clicks": lambda r: r["client_id"] in gone, "sales": lambda r: r["client_id"] in gone, "sale_lines": lambda r: r["sale_id"] in hit}
    out = {}
    for name in NAMES:
        columns, rows = tables[name]
        rows = sorted(rows, key=lambda r: (crc(lead[name](r)), *(comparable(r[c]) for c in columns)))
        size = 1 + len(rows) // share
        for k in range(0, len(rows), size):
            part = rows[k : k + size]
            kept = [r for r in part if not dead[name](r)]
            if kept:
                ids = ",".join("" if r[columns[0]] is None else str(r[columns[0]]) for r in kept)
                money = (r[MONEY[name]] for r in kept)
                cents = sum(math.floor(100 * x + 0.5) for x in money if x is not None and math.isfinite(x))
                out[name, k // size] = (len(kept), len(part) - len(kept), cents, len(kept) < len(part), hashlib.sha256(ids.encode()).hexdigest(), ",".join(columns), kept)
    return out


def check(report, tables, **how):
    rows = report.collect()
    want = brute(tables, **how)
    got = {(r.table_name, r.file_no): (r.n_rows, r.n_erased, r.cents, r.rewritten, r.ids_sha256, r.columns) for r in rows}
    assert got == {k: v[:-1] for k, v in want.items()} and len(rows) == len(got)
    for r in rows:
        found = pq.read_table(r.path.removeprefix("file://"), partitioning=None)
        columns = tables[r.table_name][0]
        assert found.column_names == list(columns)
        kept = want[r.table_name, r.file_no][-1]
        assert [[comparable(x[c]) for c in columns] for x in found.to_pylist()] == [[comparable(x[c]) for c in columns] for x in kept]
        about = pq.ParquetFile(r.path.removeprefix("file://")).metadata
        ids = [x[columns[0]] for x in kept if x[columns[0]] is not None]
        stats = [about.row_group(g).column(0).statistics for g in range(about.num_row_groups)]
        if ids:
            assert (min(s.min for s in stats if s.has_min_max), max(s.max for s in stats if s.has_min_max)) == (min(ids), max(ids))
    if rows:
        base = os.path.dirname(os.path.dirname(rows[0].path.removeprefix("file://")))
        there = {p for p in glob.glob(f"{base}/**", recursive=True) if os.path.isfile(p)}
        assert there == {r.path.removeprefix("file://") for r in rows}
    return rows


def test_whole_tables_equal_brute_force(spark):
    tables = {n: (pq.read_schema(f"{SF}/{n}.parquet").names, pq.read_table(f"{SF}/{n}.parquet").to_pylist()) for n in NAMES}
    rows = check(erase(*(spark.read.parquet(f"{SF}/{n}.parquet") for n in NAMES)), tables)
    assert any(r.rewritten for r in rows) and any(not r.rewritten for r in rows)


COLUMNS = {
    "clients": "client_id long, master_id long, key binary, row string, balance double",
    "clicks": "click_id long, client_id long, value double, file_no int, id string",
    "sales": "sale_id long, client_id long, total double, lead long, hit boolean",
    "sale_lines": "sale_id long, line_no int, amount double, `__sale` long, key string",
}


def small(spark, data):
    frames, tables = [], {}
    for n in NAMES:
        df = spark.createDataFrame(data[n], COLUMNS[n])
        frames.append(df)
        tables[n] = (df.columns, [r.asDict() for r in df.collect()])
    return frames, tables


def test_nulls_ties_repeats_and_clashing_names(spark):
    nan = float("nan")
    clients = [(i, i % 7 if i % 5 else None, b"\x00k", "r" * (i % 3), [1.005, None, -0.0, nan, -2.5][i % 5]) for i in range(60)] + [(None, 3, None, None, 1.0), (3, 1, b"", "", 2.0), (3, 1, b"", "", 2.0)]
    clicks = [(i % 40, i % 9 if i % 4 else None, i / 3, i, None) for i in range(200)] + [(None, 7, None, None, "x")] * 3
    sales = [(i, i % 11 if i % 6 else None, float(i), i, None) for i in range(90)] + [(None, 5, 1.0, 1, True), (4, 2, 1.0, 1, True), (4, 2, 1.0, 1, True)]
    lines = [(i % 120 if i % 8 else None, i % 3, i / 7 if i % 9 else None, 1, "z") for i in range(300)] + [(7, 1, 0.1, 2, "k")] * 50
    frames, tables = small(spark, {"clients": clients, "clicks": clicks, "sales": sales, "sale_lines": lines})
    check(erase(*frames, share=20, every=3), tables, share=20, every=3)
    check(erase(*(f.repartition(3) for f in frames), share=1, every=1), tables, share=1, every=1)


def test_empty_tables(spark):
    frames, tables = small(spark, {n: [] for n in NAMES})
    assert check(erase(*frames), tables) == []
    data = {n: [] for n in NAMES} | {"clients": [(1, 2, None, "r", 1.0), (2, None, None, "r", 2.0)], "sale_lines": [(1, 1, 1.0, 1, "k")]}
    frames, tables = small(spark, data)
    assert {r.table_name for r in check(erase(*frames), tables)} == {"clients", "sale_lines"}


@pytest.mark.parametrize("ids, column, want", [([1, 5, 9], [5, None, 0, 9, 10, 1], [1, 0, 0, 1, 0, 1]), ([0], [None, 0], [0, 1])])
def test_mask(ids, column, want):
    assert mask(np.array(ids), pa.array(column, pa.int64())).tolist() == [bool(w) for w in want]
