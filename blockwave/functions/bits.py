"""Bit strings, Exp-Golomb codes, coefficient codes and the CRC, as column expressions; decoding over Arrow batches."""

from __future__ import annotations

from binascii import crc_hqx
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import on_blocks
from .ints import Value, array, bit_length, col, div, let

#: The most zeros that a code may begin with, and the largest magnitude of a coefficient.
MAX_ZEROS, MAX_LEVEL = 31, 32767


@cache
def zigzag(n: int) -> tuple[int, ...]:
    """Raster positions along the anti-diagonals, the first step to the right."""
    cells = sorted((i + j, j if (i + j) % 2 else i, i, j) for i in range(n) for j in range(n))
    turned = [(s, (i if s % 2 else j), i, j) for s, _, i, j in cells]
    return tuple(i * n + j for _, _, i, j in sorted(turned))


def scan(block: Column, n: int) -> Column:
    return let(block, lambda b: F.transform(array(zigzag(n)), lambda i: F.get(b, i)))


def unscan(block: Column, n: int) -> Column:
    z = zigzag(n)
    back = [z.index(p) for p in range(n * n)]
    return let(block, lambda b: F.transform(array(back), lambda i: F.get(b, i)))


def last_nonzero(block: Column) -> Column:
    """The last place that is not 0, or -1."""
    at = F.array_position(F.reverse(F.transform(block, lambda v: (v != 0).cast("int"))), 1)
    return F.when(at == 0, -1).otherwise(F.size(block) - at).cast("int")


def bits(v: Value, n: int) -> Column:
    """n binary digits, the highest first."""
    return F.lpad(F.bin(col(v).cast("bigint")), n, "0")


def ue(v: Value) -> Column:
    """Exp-Golomb code of an unsigned number."""
    code = F.bin(col(v).cast("bigint") + 1)
    return F.concat(F.repeat(F.lit("0"), F.length(code) - 1), code)


def ue_bits(v: Value) -> Column:
    return bit_length(col(v) + 1) * 2 - 1


def se_number(v: Value) -> Column:
    """The unsigned number that stands for a signed one: 0, 1, -1, 2, -2 become 0, 1, 2, 3, 4."""
    v = col(v)
    return F.when(v > 0, v * 2 - 1).otherwise(v * -2)


def se_value(u: Value) -> Column:
    u = col(u)
    return F.when(u % 2 == 1, div(u + 1, 2)).otherwise(-div(u, 2))


def se(v: Value) -> Column:
    return ue(se_number(v))


def read_ue(text: Column, at: Value = 0) -> Column:
    """struct(value, next, error) of the code at a 0-based place of a bit string."""

    def decode(s: Column) -> Column:
        zeros = F.instr(s, "1") - 1
        body = F.substring(s, zeros + 1, zeros + 1)
        bad = (zeros < 0) | (zeros > MAX_ZEROS) | (F.length(body) < zeros + 1)
        value = F.when(~bad, F.conv(body, 2, 10).cast("bigint") - 1)
        return F.struct(value.alias("value"), (col(at) + zeros * 2 + 1).cast("int").alias("next"), bad.alias("error"))

    return let(F.substring(text, col(at) + 1, F.lit(2 * MAX_ZEROS + 2)), decode)


def pack(text: Column) -> Column:
    """A bit string as bytes, the last filled up with zeros."""

    def cells(full: Column) -> Column:
        byte = lambda i: F.lpad(F.conv(F.substring(full, i, F.lit(8)), 2, 16), 2, "0")
        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(full), F.lit(8)), byte), "")

    def whole(t: Column) -> Column:
        full = F.rpad(t, div(F.length(t) + 7, 8).cast("int") * 8, "0")
        return F.when(F.length(t) == 0, F.unhex(F.lit(""))).otherwise(F.unhex(let(full, cells)))

    return let(text, whole)


def unpack(data: Column) -> Column:
    """Bytes as a bit string."""

    def body(d: Column) -> Column:
        cells = F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1)))
        return F.array_join(F.transform(cells, lambda i: F.lpad(F.bin(byte_at(d, i).cast("bigint")), 8, "0")), "")

    return F.when(F.length(data) == 0, "").otherwise(let(data, body))


def coefficient_code(block: Column, n: int) -> Column:
    """Bit string of a block: last place plus 1, then magnitudes and signs from there back to the first."""
    one = lambda v: F.concat(ue(F.abs(v)), F.when(v > 0, "0").when(v < 0, "1").otherwise(""))

    def body(z: Column) -> Column:
        last = last_nonzero(z)
        used = F.reverse(F.slice(z, F.lit(1), last + 1))
        return F.concat(ue(last + 1), F.array_join(F.transform(used, one), ""))

    return let(scan(block, n), body)


def coefficient_bits(block: Column, n: int) -> Column:
    """The length of ``coefficient_code`` without making it."""

    def body(z: Column) -> Column:
        last = last_nonzero(z)
        used = F.slice(z, F.lit(1), last + 1)
        return ue_bits(last + 1) + F.aggregate(used, F.lit(0), lambda a, v: a + ue_bits(F.abs(v)) + (v != 0).cast("int"))

    return let(scan(block, n), body)


def _read_codes(data: np.ndarray, one: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, next, error) of the Exp-Golomb codes at many places; ``one`` has the next 1 bit from each bit on."""
    first = one[np.minimum(at, len(one) - 1)]
    zeros = first - at
    bad = (zeros > MAX_ZEROS) | (first + zeros + 1 > end)
    zeros = np.where(bad, 0, zeros)
    byte = np.where(bad, 0, first) >> 3
    window = np.zeros(len(at), np.uint64)
    for k in range(8):
        window = window << np.uint64(8) | data[byte + k].astype(np.uint64)
    value = (window << (first & 7).astype(np.uint64)) >> (63 - zeros).astype(np.uint64)
    return value.astype(np.int64) - 1, first + zeros + 1, bad


def decode_blocks(codes: np.ndarray, n: int) -> dict[str, np.ndarray]:
    """Levels (rows, n*n) and errors of coded blocks, all rows a code at a time."""
    size = np.fromiter(map(len, codes), np.int64, len(codes))
    data = np.frombuffer(b"".join(codes) + bytes(16), np.uint8)
    set_, places = np.unpackbits(data), np.arange(8 * len(data))
    one = np.minimum.accumulate(np.where(set_, places, len(places) + 64)[::-1])[::-1]
    end = 8 * np.cumsum(size)
    count, at, bad = _read_codes(data, one, end - 8 * size, end)
    bad |= count > n * n
    count = np.where(bad, 0, count)
    levels = np.zeros((len(codes), n * n), np.int32)
    order = np.array(zigzag(n))
    for k in range(int(count.max(initial=0))):
        row = np.flatnonzero((count > k) & ~bad)
        mag, after, wrong = _read_codes(data, one, at[row], end[row])
        wrong |= mag > MAX_LEVEL
        negative = set_[np.minimum(after, len(set_) - 1)].astype(bool) & (after < end[row])
        levels[row, order[count[row] - 1 - k]] = np.where(wrong, 0, np.where(negative, -mag, mag))
        at[row], bad[row] = after + (mag > 0), wrong
    return {"block": levels, "error": bad}


def coefficient_decode(packed: DataFrame, column: str, n: int) -> DataFrame:
    """``packed`` with struct(block, error) of the packed block in place of a binary column; levels after an
    error are 0, and null gives null."""
    at, kind = packed.columns.index(column), "struct<block:array<int>,error:boolean>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.set_column(at, column, on_blocks(lambda codes: decode_blocks(codes, n), b.column(at)))

    schema = ", ".join(f"`{f.name}` {kind if f.name == column else f.dataType.simpleString()}" for f in packed.schema.fields)
    return packed.mapInArrow(run, schema)


def crc16(data: Column) -> Column:
    """CRC-16/CCITT-FALSE of a binary: polynomial 0x1021, start 0xFFFF; null for null. Whole Arrow batches go through the
    standard library's table."""

    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else crc_hqx(v, 0xFFFF) for v in values.to_pylist()], pa.int32())

    return F.arrow_udf(run, "int")(data)
