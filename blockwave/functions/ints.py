"""Exact integer arithmetic as column expressions: C division, shifts, wrapping and clipping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Value = Column | int


def col(x: Value | str) -> Column:
    return F.lit(x) if isinstance(x, int) else F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: what a lambda refers to is otherwise computed at each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def div(a: Value, b: Value) -> Column:
    """Integer quotient, truncated towards zero; a BIGINT."""
    return F.call_function("div", col(a), col(b))


def shr(a: Value, n: int) -> Column:
    """Arithmetic shift to the right."""
    return F.shiftright(col(a), n)


def clip(a: Value, low: Value, high: Value) -> Column:
    return F.least(F.greatest(col(a), col(low)), col(high))


def clip8(a: Value) -> Column:
    return clip(a, 0, 255)


def wrap16(a: Value) -> Column:
    """As a cast to a signed 16-bit integer wraps."""
    return (col(a) + 32768).bitwiseAND(F.lit(65535)) - 32768


def u16(a: Value) -> Column:
    return col(a).bitwiseAND(F.lit(65535))


def byte_at(b: Column, i: Value) -> Column:
    """The unsigned byte at a 1-based place of a binary, null past its end."""
    return F.conv(F.hex(F.substring(b, i, 1) if isinstance(i, int) else F.call_function("substring", b, i, F.lit(1))), 16, 10).cast("int")


def int_be(b: Column, i: int, n: int) -> Column:
    """n bytes from the 1-based place i as a big-endian unsigned integer."""
    return F.conv(F.hex(F.substring(b, i, n)), 16, 10).cast("bigint")


def int_le(b: Column, i: int, n: int) -> Column:
    """n bytes from the 1-based place i as a little-endian unsigned integer."""
    return sum((byte_at(b, i + k).cast("bigint") * (1 << 8 * k) for k in range(1, n)), byte_at(b, i).cast("bigint"))


def bytes_be(v: Value, n: int) -> Column:
    return F.unhex(F.lpad(F.hex(col(v).cast("bigint")), 2 * n, "0"))


def bytes_le(v: Value, n: int) -> Column:
    v = col(v).cast("bigint")
    return F.concat(*[F.unhex(F.lpad(F.hex(F.shiftright(v, 8 * k).bitwiseAND(F.lit(255))), 2, "0")) for k in range(n)])


def bit_length(v: Value) -> Column:
    """Binary digits of a positive integer."""
    return F.length(F.bin(col(v)))


def array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])
