"""CSV files of any size, read by many tasks, with the quoting of pasted tables.

A quote opens or closes wherever it stands, so whether a place is quoted is the parity
of the quotes before it.  Blocks of a file are counted first; with the parity at its
beginning each block tells rows from line breaks within fields on its own.  A row over
the border of blocks is put together from its pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matching import ValidationError
from .scratch import staged

_FIELD = re.compile(r'((?:[^",\r\n]|"(?:[^"]|"")*(?:"|\Z))*)(,|\r\n?|\n|\Z)')
_QUOTED = re.compile(r'"((?:[^"]|"")*)"?')

_PIECE = "file string, block long, place long, kind int, text string"


def split_rows(text: str) -> list[list[str]]:
    """Rows of a text that begins outside of quotes, those of blanks alone left out; rows end at LF, CR or both."""
    rows, row, at = [], [], 0
    while at < len(text):
        m = _FIELD.match(text, at)
        field, ends, at = m.group(1), m.group(2), m.end()
        row.append(_QUOTED.sub(lambda q: q.group(1).replace('""', '"'), field) if '"' in field else field)
        if ends == "," and at == len(text):
            row.append("")
        if ends != "," or at == len(text):
            rows.append(row)
            row = []
    return [r for r in rows if any(x.strip() for x in r)]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines between LF with the file and the block that they are read from, in order within a task."""
    return spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _pieces(lines: DataFrame, quoted: dict[tuple[str, int], bool]) -> DataFrame:
    """Whole rows (kind 0), and of each block what goes on from before (1) and what goes on behind (2), or both (3)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, inside, begun, place = None, [], False, False, 0

        def piece(kind: int) -> tuple:
            return (*here, place, kind, "\n".join(held))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [c.split()[0] for c in _PIECE.split(", ")])

        for batch in batches:
            out = []
            for file, block, value in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, block) != here:
                    if here and held:
                        out.append(piece(2 if begun else 3))
                    here, held, place = (file, block), [], 0
                    inside = quoted[file, block]
                    begun = not inside
                held.append(value)
                inside ^= value.count('"') % 2 == 1
                if not inside:
                    out.append(piece(0 if begun else 1))
                    held, begun, place = [], True, place + 1
            if out:
                yield batch_of(out)
        if here and held:
            yield batch_of([piece(2 if begun else 3)])

    return lines.mapInArrow(cut, _PIECE)


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, place, row, fields``: the rows of CSV files, the header among them; order within a file is by block, place and row.

    One number for each block, a part of a file that a task reads, comes to the driver.
    A quote that is never closed takes the rest of its file, as one field.
    """
    lines = _lines(spark, path)
    counts = lines.groupBy("file", "block").agg(F.sum(F.length("value") - F.length(F.translate("value", '"', ""))).alias("n")).collect()
    quoted, before = {}, {}
    for r in sorted(counts, key=lambda r: (r["file"], r["block"])):
        quoted[r["file"], r["block"]] = before.get(r["file"], 0) % 2 == 1
        before[r["file"]] = before.get(r["file"], 0) + r["n"]
    pieces = staged(_pieces(lines, quoted), "csv-pieces")
    # A broken row belongs to the block where it begins; blocks and kinds alone come here.
    owner, last = [], {}
    for r in sorted(pieces.where("kind > 0").select("file", "block", "kind").collect(), key=lambda r: (r["file"], r["block"], r["kind"] == 2)):
        if r["kind"] == 2:
            last[r["file"]] = r["block"]
        owner.append((r["file"], r["block"], r["kind"], last.get(r["file"], r["block"])))
    owners = spark.createDataFrame(owner, "file string, block long, kind int, begin long")
    parts = pieces.where("kind > 0").join(F.broadcast(owners), ["file", "block", "kind"]).groupBy("file", F.col("begin").alias("block"))
    broken = parts.agg(F.max(F.when(F.col("kind") == 2, F.col("place"))).alias("place"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("block").alias("b"), "text"))), lambda x: x["text"]), "\n").alias("text"))
    whole = pieces.where("kind = 0").select("file", "block", "place", "text").unionByName(broken)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [split_rows(t) for t in batch.column(3).to_pylist()]
            row = pa.array([i for i, rows in enumerate(found) for _ in rows], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(row) for c in range(3)), pa.array([k for rows in found for k in range(len(rows))], pa.int32()), pa.array([r for rows in found for r in rows], pa.list_(pa.string()))],
                ["file", "block", "place", "row", "fields"],
            )

    return whole.mapInArrow(parse, "file string, block long, place long, row int, fields array<string>")


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    """A column of text for each trimmed name of the header, which is the first row of each file and the same in all.

    Short rows are filled with empty texts, long ones cut; of names that repeat the later ones get their place behind.
    """
    rows = csv_rows(spark, path)
    first = rows.groupBy("file").agg(F.min(F.struct("block", "place", "row", "fields")).alias("h"))
    headers = first.orderBy("file").limit(1).collect()
    if not headers:
        raise ValidationError("a header is needed")
    names: list[str] = []
    for k, name in enumerate(x.strip() for x in headers[0]["h"]["fields"]):
        names.append(name if name not in names else f"{name}_{k + 1}")
    heads = first.select("file", "h.block", "h.place", "h.row")
    data = rows.join(F.broadcast(heads), ["file", "block", "place", "row"], "left_anti")
    return data.select(*[F.coalesce(F.get("fields", F.lit(k)), F.lit("")).alias(name) for k, name in enumerate(names)])
