"""Cascading erasure: clients, and all that hangs on them, leave sorted Parquet files.

Tables are written in the order of binary keys as files of equal numbers of rows, one
task a file.  The ids that must go are dealt to the files whose range of leading key
values holds theirs; each such file is masked by binary search in its sorted ids and,
if a row is hit, written anew from the rows that stay.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sort_keys import encode, keys_at, with_keys
from .staging import discard, shared_dir, stage

#: Rows that a task writes at least, where files are smaller.
TASK_ROWS = 100_000
#: Rows of a row group.
GROUP_ROWS = 1 << 16

#: Bytes of a key that hold its lead, and those that hold a whole number behind it.
LEAD, NUMBER = 4, 9

_REPORT = "file_no long, n_rows long, n_erased long, cents long, ids_sha256 string, low binary, high binary, path string"


@dataclass(frozen=True)
class Relation:
    """How a table takes part: its rows, the number of four bytes that leads its order, what cents are summed of and which column names a victim."""

    name: str
    rows: DataFrame
    money: str
    victim: str

    @property
    def reach(self) -> int:
        """Bytes of a key that tell where an id may be: those of the lead, and of the id if its column comes first."""
        first = self.rows.schema[0]
        return LEAD + NUMBER * (first.name == self.victim and first.dataType.typeName() in ("long", "integer", "short", "byte"))


def crc(column: Column) -> Column:
    """CRC-32 of a number written in decimal; null is the empty string."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


class _File:
    """A file being written at a place of its own; when it is whole it moves to its name, so a task that is run again does no harm."""

    def __init__(self, base: str, folder: str, name: str, schema: pa.Schema, money: int):
        self.fs, root = FileSystem.from_uri(base)
        self.path, self.money, self.name = f"{base}/{folder}/{name}", money, f"{root}/{folder}/{name}"
        self.attempt = f"{root}/_attempts/{uuid.uuid4().hex}"
        for place in (f"{root}/_attempts", f"{root}/{folder}"):
            self.fs.create_dir(place, recursive=True)
        self.writer = pq.ParquetWriter(self.attempt, schema, filesystem=self.fs)
        self.held: list[pa.RecordBatch] = []
        self.n = self.waiting = self.cents = 0
        self.digest = hashlib.sha256()

    def add(self, batch: pa.RecordBatch) -> None:
        if not len(batch):
            return
        ids = pc.fill_null(pc.cast(batch.column(0), pa.string()), "").to_pylist()
        self.digest.update((("," if self.n else "") + ",".join(ids)).encode())
        x = np.asarray(pc.fill_null(pc.cast(batch.column(self.money), pa.float64()), 0.0))
        self.cents += int(np.floor(100 * np.where(np.isfinite(x), x, 0.0) + 0.5).astype(np.int64).sum())
        self.n += len(batch)
        self.waiting += len(batch)
        self.held.append(batch)
        if self.waiting >= GROUP_ROWS:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            self.writer.write_table(pa.Table.from_batches(self.held), row_group_size=GROUP_ROWS)
        self.held, self.waiting = [], 0

    def close(self) -> None:
        """Give the file its name; one without rows gets none."""
        self._flush()
        self.writer.close()
        if self.n:
            try:
                self.fs.move(self.attempt, self.name)
            except OSError:  # where a move replaces nothing
                self.fs.delete_file(self.name)
                self.fs.move(self.attempt, self.name)
        else:
            self.fs.delete_file(self.attempt)


def _report(rows: list[tuple]) -> pa.RecordBatch:
    names = [f.split()[0] for f in _REPORT.split(", ")]
    kinds = [{"string": pa.string(), "binary": pa.binary(), "long": pa.int64()}[f.split()[1]] for f in _REPORT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _file_name(number: int) -> str:
    return f"file-{number:05d}.parquet"


def _in_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Runs of rows with the same number in the first column."""
    for batch in batches:
        number = np.asarray(batch.column(0))
        edges = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
        for a, b in zip(edges[:-1], edges[1:]):
            if a < b:
                yield int(number[a]), batch.slice(a, b - a)


def _dealt(rows: DataFrame, files: int, n: int, order: list[str]) -> DataFrame:
    """Rows of each file in one task, in order; neighbouring small files share a task."""
    tasks = min(files, max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_ROWS)))
    return rows.repartitionById(tasks, F.floor(F.col("file_no") * tasks / files).cast("int")).sortWithinPartitions(*order)


def write_sorted(keyed: DataFrame, base: str, name: str, money: str, share: int, reach: int = LEAD) -> DataFrame:
    """Write ``row`` of ``key, row`` in the keys' order as files of ``1 + n // share`` rows; a report of each (see _REPORT), ``low`` and ``high`` the first ``reach`` bytes of its keys."""
    n = keyed.count()
    size = 1 + n // share
    files = -(-n // size)
    splits = keys_at(keyed, [size * k for k in range(1, files)])
    kind = keyed.schema["row"].dataType
    at = kind.fieldNames().index(money)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array(splits, dtype="S") if splits else np.empty(0, "S1")
        for batch in batches:
            # No key is the beginning of another, so zeros at their ends don't matter.
            number = np.searchsorted(edges, np.array(batch.column(0).to_pylist(), dtype="S"), "right") if len(edges) else np.zeros(len(batch), int)
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), *batch.columns], ["file_no", "key", "row"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, now = None, -1
        low = high = b""

        def done() -> pa.RecordBatch:
            file.close()
            return _report([(now, file.n, 0, file.cents, file.digest.hexdigest(), low, high, file.path)])

        for number, run in _in_runs(batches):
            rows = run.column(2)
            plain = pa.RecordBatch.from_arrays(rows.flatten(), [f.name for f in rows.type])
            if number != now:
                if file:
                    yield done()
                file, now = _File(base, name, _file_name(number), plain.schema, at), number
                low = run.column(1)[0].as_py()[:reach]
            high = run.column(1)[-1].as_py()[:reach]
            file.add(plain)
        if file:
            yield done()

    rows = keyed.mapInArrow(numbered, f"file_no long, key binary, row {kind.simpleString()}")
    return stage(_dealt(rows, max(files, 1), n, ["key"]).mapInArrow(write, _REPORT), f"erasure-{name}-written")


def _place(victims: DataFrame, files: list, reach: int) -> DataFrame:
    """``file_no, id`` of ``id, lead``: each file whose range of keys may hold the id; ranges are ascending and few (``share`` of them).

    Where a client has very many rows and their ids don't come first, all its files get the one id of the client.
    """
    lows, highs = (np.array([f[c] for f in files], f"S{reach}") for c in ("low", "high"))
    kind = victims.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead = np.asarray(batch.column(1))
            keys = np.array(encode([batch.column(0)] if reach > LEAD else [], lead).to_pylist(), f"S{reach}")
            first, end = np.searchsorted(highs, keys, "left"), np.searchsorted(lows, keys, "right")
            many = np.maximum(end - first, 0)
            row = np.repeat(np.arange(len(lead)), many)
            number = first[row] + np.arange(len(row)) - (np.cumsum(many) - many)[row]
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), batch.column(0).take(pa.array(row))], ["file_no", "id"])

    return victims.select("id", "lead").mapInArrow(run, f"file_no long, id {kind}")


def mask(ids: np.ndarray, column: pa.Array) -> np.ndarray:
    """Which values of a column are among sorted ids; null never is."""
    values = np.asarray(column.fill_null(0))
    at = np.minimum(np.searchsorted(ids, values), len(ids) - 1)
    return (ids[at] == values) & ~np.asarray(column.is_null())


def rewrite(written: DataFrame, base: str, relation: Relation, victims: DataFrame) -> DataFrame:
    """Write files that hold one of ``victims`` (``id, lead``) anew, beside the old ones; a report of each, also of those left without rows.

    A task holds the ids dealt to one file: not more than the file has different ones, and those of its two border values.
    """
    files = sorted(written.collect(), key=lambda r: r["file_no"])  # share + 1 rows at most
    paths = {r["file_no"]: r["path"] for r in files}
    columns = relation.rows.columns
    name, money, column = relation.name, columns.index(relation.money), relation.victim

    def masked(number: int, ids: np.ndarray) -> tuple | None:
        fs, path = FileSystem.from_uri(paths[number])
        with fs.open_input_file(path) as source:
            old = pq.ParquetFile(source)
            hits = [mask(ids, old.read_row_group(g, columns=[column]).column(0).combine_chunks()) for g in range(old.num_row_groups)]
            erased = int(sum(h.sum() for h in hits))
            if not erased:
                return None
            new = _File(base, f"_rewritten/{name}", _file_name(number), old.schema_arrow, money)
            for g, hit in enumerate(hits):
                for batch in old.read_row_group(g).filter(pa.array(~hit)).to_batches():
                    new.add(batch)
            new.close()
        return number, new.n, erased, new.cents, new.digest.hexdigest(), None, None, new.path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = -1, []
        for number, part in _in_runs(batches):
            if number != now and held:
                done = masked(now, np.concatenate(held))
                held = []
                if done:
                    yield _report([done])
            now = number
            held.append(np.asarray(part.column(1)))
        if held:
            done = masked(now, np.concatenate(held))
            if done:
                yield _report([done])

    placed = _place(victims, files, relation.reach)
    n = max(sum(r["n_rows"] for r in files), 1)
    return stage(_dealt(placed, max(len(files), 1), n, ["file_no", "id"]).mapInArrow(run, _REPORT), f"erasure-{name}-rewritten")


def _commit(base: str, written: DataFrame, rewritten: DataFrame) -> None:
    """Put new files in the place of old ones and delete old ones that have no rows left; ``share`` files a table at most."""
    fs, _ = FileSystem.from_uri(base)
    old = {r["file_no"]: r["path"] for r in written.select("file_no", "path").collect()}
    for r in rewritten.select("file_no", "n_rows", "path").collect():
        target = FileSystem.from_uri(old[r["file_no"]])[1]
        fs.delete_file(target)
        if r["n_rows"]:
            fs.move(FileSystem.from_uri(r["path"])[1], target)


def victim_masters(clients: DataFrame, clicks: DataFrame, every: int) -> DataFrame:
    """``master_id``: those whose CRC-32 ``every`` divides, and the one whose clients have most clicks (of equals the smallest)."""
    pairs = clients.where("master_id is not null").select("client_id", "master_id").distinct()
    chosen = pairs.select("master_id").where(crc(F.col("master_id")) % every == 0)
    many = clicks.where("client_id is not null").groupBy("client_id").agg(F.count(F.lit(1)).alias("n"))
    clicked = pairs.join(many, "client_id", "left").groupBy("master_id").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
    return chosen.union(clicked.orderBy(F.desc("n"), "master_id").limit(1).select("master_id")).distinct()


def erase(clients: DataFrame, clicks: DataFrame, sales: DataFrame, sale_lines: DataFrame, share: int = 350, every: int = 400) -> DataFrame:
    """Write the four tables sorted, erase the victims of :func:`victim_masters`, and report each final file.

    Columns: ``table_name, file_no, n_rows, n_erased, cents, rewritten, ids_sha256,
    columns, path``.  Rows are in the order of the CRC-32 of their client (of a line, its
    sale's client; null or no sale: of the empty string), then of all columns, nulls
    first; -0 counts as 0 and NaN as largest.  Each table has files of ``1 + n // share``
    rows in a new folder of the shared one.  A client row is a victim by its master,
    clicks and sales by their client, lines by their sale.  Null ids are never victims; a
    sale number that occurs repeatedly belongs to its smallest client and goes if one of its clients
    goes; repeated rows are all kept or all erased; amounts that are null or not finite count as 0
    cents; an empty table has no files; columns that the operator doesn't name are written like any other.
    """
    spark = clients.sparkSession
    base = f"{shared_dir(spark)}/erasure-{uuid.uuid4().hex}"
    masters = stage(victim_masters(clients, clicks, every), "erasure-masters")
    gone = stage(clients.join(masters, "master_id", "left_semi").select("client_id", "master_id").distinct(), "erasure-clients")
    ids = stage(gone.where("client_id is not null").select(F.col("client_id").alias("id")).distinct(), "erasure-ids")
    flagged = sales.where("sale_id is not null").select("sale_id", "client_id").join(ids.select(F.col("id").alias("client_id"), F.lit(True).alias("hit")), "client_id", "left")
    owners = stage(flagged.groupBy("sale_id").agg(F.min("client_id").alias("client_id"), F.coalesce(F.bool_or("hit"), F.lit(False)).alias("hit")), "erasure-owners")

    by_client = ids.select("id", crc(F.col("id")).alias("lead"))
    owner = owners.select(F.col("sale_id").alias("__sale"), F.col("client_id").alias("__client"))
    lines = sale_lines.select(F.struct(*[F.col(f"`{c}`") for c in sale_lines.columns]).alias("row"))
    lines = lines.join(owner, F.col("row.sale_id") == F.col("__sale"), "left").select(crc(F.col("__client")).alias("lead"), "row")
    own: Callable[[DataFrame], DataFrame] = lambda t: t.select(crc(F.col("client_id")).alias("lead"), F.struct(*[F.col(f"`{c}`") for c in t.columns]).alias("row"))
    work = [
        (Relation("clients", clients, "balance", "master_id"), own(clients), gone.select(F.col("master_id").alias("id"), crc(F.col("client_id")).alias("lead")).distinct()),
        (Relation("clicks", clicks, "value", "client_id"), own(clicks), by_client),
        (Relation("sales", sales, "total", "client_id"), own(sales), by_client),
        (Relation("sale_lines", sale_lines, "amount", "sale_id"), lines, owners.where("hit").select(F.col("sale_id").alias("id"), crc(F.col("client_id")).alias("lead"))),
    ]
    reports, spent = [], [masters, gone, ids, owners]
    for relation, rows, victims in work:
        keyed = stage(with_keys(rows, "lead"), f"erasure-{relation.name}-keyed")
        written = write_sorted(keyed, base, relation.name, relation.money, share, relation.reach)
        discard(keyed)
        rewritten = rewrite(written, base, relation, victims)
        _commit(base, written, rewritten)
        new = rewritten.select("file_no", *[F.col(c).alias(f"new_{c}") for c in ("n_rows", "n_erased", "cents", "ids_sha256")])
        hit = F.col("new_n_rows").isNotNull()
        after = lambda c, h=hit: F.when(h, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)
        both = written.join(F.broadcast(new), "file_no", "left").where(~hit | (F.col("new_n_rows") > 0))
        reports.append(
            both.select(
                F.lit(relation.name).alias("table_name"), "file_no", after("n_rows"), after("n_erased"), after("cents"), hit.alias("rewritten"), after("ids_sha256"), F.lit(",".join(relation.rows.columns)).alias("columns"), "path"
            )
        )
        spent += [written, rewritten]
    fs, root = FileSystem.from_uri(base)
    for leftover in ("_attempts", "_rewritten"):
        if fs.get_file_info(f"{root}/{leftover}").type.name == "Directory":
            fs.delete_dir(f"{root}/{leftover}")
    out = reports[0]
    for report in reports[1:]:
        out = out.union(report)
    out = stage(out.coalesce(1), "erasure-report")  # share + 1 rows a table at most
    discard(*spent)
    return out
