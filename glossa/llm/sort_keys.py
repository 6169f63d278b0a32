"""Binary keys that compare as their rows do, and exact splitters of a table by radix counting."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Cells of so many keys or fewer are sorted as they are instead of being divided further.
LEAF = 20_000
#: Bytes of the first digit and of those after it.
FIRST_DIGIT, DIGIT = 2, 1
#: Bytes behind a digit whose common beginning is skipped.
AHEAD = 7

_SIGN = np.uint64(1 << 63)


def _fixed(words: np.ndarray, null: np.ndarray) -> np.ndarray:
    """A mark and eight bytes, largest first; null is all zeros."""
    out = np.empty((len(words), 9), np.uint8)
    out[:, 0] = 1
    out[:, 1:] = words.astype(">u8").view(np.uint8).reshape(-1, 8)
    out[null] = 0
    return out


def _signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.int64).view(np.uint64) ^ _SIGN


def _real(values: np.ndarray) -> np.ndarray:
    """Negative numbers are complemented, others get the sign bit; -0 is 0, and NaN is above all."""
    values = np.where(np.isnan(values), np.nan, values.astype(np.float64) + 0.0)
    bits = values.view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | _SIGN)


def _texts(column: pa.Array) -> pa.Array:
    """A mark, the bytes with zeros escaped, two zeros; null is one zero."""
    data = column.cast(pa.binary())
    if pc.any(pc.match_substring(data, b"\x00")).as_py():
        data = pc.replace_substring(data, pattern=b"\x00", replacement=b"\x00\xff")
    n = len(column)
    whole = pc.binary_join_element_wise(pa.repeat(pa.scalar(b"\x01", pa.binary()), n), data, pa.repeat(pa.scalar(b"\x00\x00", pa.binary()), n), pa.scalar(b"", pa.binary()))
    return pc.fill_null(whole, b"\x00")


def _value(value: object, kind: pa.DataType) -> bytes:
    """A value of a nested or decimal type: a sequence is its elements, each behind a one, and a zero."""
    if value is None:
        return b"\x00"
    if pa.types.is_list(kind):
        return b"\x01" + b"".join(b"\x01" + _value(v, kind.value_type) for v in value) + b"\x00"
    if pa.types.is_struct(kind):
        return b"\x01" + b"".join(_value(value[f.name], f.type) for f in kind)
    if pa.types.is_map(kind):
        return b"\x01" + b"".join(b"\x01" + _value(k, kind.key_type) + _value(v, kind.item_type) for k, v in sorted(value)) + b"\x00"
    if pa.types.is_decimal(kind):
        return b"\x01" + (int(value.scaleb(kind.scale)) + (1 << 127)).to_bytes(16, "big")
    return encode([pa.array([value], kind)])[0].as_py()


def _column(column: pa.Array) -> np.ndarray | pa.Array:
    """A column's part of the keys: a table of bytes if all have the same length, else a binary array."""
    kind, null = column.type, np.asarray(column.is_null())
    if pa.types.is_boolean(kind) or pa.types.is_integer(kind):
        return _fixed(_signed(column.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)), null)
    if pa.types.is_floating(kind):
        return _fixed(_real(column.cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False)), null)
    if pa.types.is_timestamp(kind) or pa.types.is_duration(kind) or pa.types.is_date64(kind):
        return _fixed(_signed(column.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)), null)
    if pa.types.is_date32(kind):
        return _fixed(_signed(column.cast(pa.int32()).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)), null)
    if pa.types.is_null(kind):
        return np.zeros((len(column), 1), np.uint8)
    if pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_string(kind) or pa.types.is_large_binary(kind):
        return _texts(column)
    return pa.array([_value(v, kind) for v in column.to_pylist()], pa.binary())


def _binary(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def encode(columns: Sequence[pa.Array], lead: np.ndarray | None = None, tail: np.ndarray | None = None) -> pa.Array:
    """One binary key a row, whose order is that of the columns, left to right, nulls first.

    ``lead`` (unsigned, four bytes) comes before all, ``tail`` (eight bytes) behind.  No
    key is the beginning of another of the same columns.
    """
    parts: list[np.ndarray | pa.Array] = [lead.astype(">u4").view(np.uint8).reshape(-1, 4)] if lead is not None else []
    parts += [_column(c) for c in columns]
    if tail is not None:
        parts.append(tail.astype(">u8").view(np.uint8).reshape(-1, 8))
    pieces: list[pa.Array] = []
    flat: list[np.ndarray] = []
    for part in [*parts, None]:
        if isinstance(part, np.ndarray):
            flat.append(part)
            continue
        if flat:
            pieces.append(_binary(np.hstack(flat)))
            flat = []
        if part is not None:
            pieces.append(part)
    return pieces[0] if len(pieces) == 1 else pc.binary_join_element_wise(*pieces, pa.scalar(b"", pa.binary()))


def with_keys(rows: DataFrame, lead: str) -> DataFrame:
    """``key, row`` of ``lead`` (a number of four bytes) and ``row`` (a struct); a number behind makes each key unique."""
    schema = f"key binary, row {rows.schema['row'].dataType.simpleString()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column(1)
            keys = encode(whole.flatten(), batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([keys, whole], ["key", "row"])

    return rows.select(F.col(lead).cast("long"), "row", F.monotonically_increasing_id().alias("number")).mapInArrow(run, schema)


def _ahead(at: str) -> str:
    """The bytes behind position ``at`` as a number, zeros where a key has ended."""
    return f"cast(conv(rpad(hex(substring(key, {at} + 1, {AHEAD})), {2 * AHEAD}, '0'), 16, 10) as long)"


def _common(low: int, high: int) -> int:
    """How many leading bytes two numbers of AHEAD bytes share."""
    return AHEAD - ((low ^ high).bit_length() + 7) // 8


def keys_at(keyed: DataFrame, ranks: Sequence[int]) -> list[bytes]:
    """The keys (column ``key``, unique, none the beginning of another) that have these ranks, from 0, in order.

    Radix partitioning from the most significant byte: keys are counted by digit, only
    cells in which a rank lies go on to the next digit behind what all their keys share,
    and cells of LEAF keys or fewer are sorted.  Counts come to the driver: 65,536 of the
    first digit, then 256 for each rank at most; keys never do, but for those asked for.
    """
    spark, found = keyed.sparkSession, {}
    frame = keyed.select("key", F.lit(0).alias("at"))
    cells = {b"": (0, 0, sorted(set(ranks)))}  # beginning: (where the next digit is, keys below, ranks)
    digit = FIRST_DIGIT
    while cells:
        counted = frame.select(F.expr(f"substring(key, 1, at + {digit})").alias("begin"), F.expr(_ahead(f"(at + {digit})")).alias("ahead"))
        counted = counted.groupBy("begin").agg(F.count(F.lit(1)).alias("n"), F.min("ahead").alias("low"), F.max("ahead").alias("high"))
        children: dict[bytes, list] = {}
        for r in sorted(((bytes(r["begin"]), r["n"], r["low"], r["high"]) for r in counted.collect()), key=lambda r: r[0]):
            children.setdefault(next(c for c in _beginnings(r[0], digit) if c in cells), []).append(r)
        todo, leaves = {}, []
        for begin, (_, below, wanted) in cells.items():
            for child, n, low, high in children.get(begin, []):
                inside = [k for k in wanted if below <= k < below + n]
                if inside and n <= LEAF:
                    leaves += [(child, k - below + 1, k) for k in inside]
                elif inside:
                    todo[child] = (len(child) + _common(low, high), below, inside)
                below += n
        if leaves:
            asked = F.broadcast(spark.createDataFrame([(bytearray(b), p, k) for b, p, k in leaves], "begin binary, place int, rank long"))
            rows = frame.select("key", F.expr(f"substring(key, 1, at + {digit})").alias("begin")).join(asked.select("begin").distinct(), "begin", "left_semi")
            rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("begin").orderBy("key")))
            found |= {r["rank"]: bytes(r["key"]) for r in rows.join(asked, ["begin", "place"]).select("rank", "key").collect()}
        if todo:
            # A cell is named by its beginning; its keys share what comes up to the next digit.
            open_cells = F.broadcast(spark.createDataFrame([(bytearray(b), at) for b, (at, _, _) in todo.items()], "begin binary, next int"))
            frame = frame.withColumn("begin", F.expr(f"substring(key, 1, at + {digit})")).join(open_cells, "begin").select("key", F.col("next").alias("at"))
        cells, digit = todo, DIGIT
    return [found[k] for k in ranks]


def _beginnings(child: bytes, digit: int) -> Iterator[bytes]:
    """Names that the cell of a child may have: its beginnings, longest first."""
    for n in range(len(child) - digit, -1, -1):
        yield child[:n]
