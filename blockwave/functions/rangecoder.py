"""An adaptive binary range coder and its coefficient model: serial by nature, one stream a row.

The coder runs inside an Arrow function, a packet at a time; streams are independent, so a table of
them is as parallel as its rows.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

STATES, RAREST = 64, 0.01875
#: Each likely symbol lowers the less likely one's probability by a constant factor, from a half to RAREST in the last state.
_DECAY = (RAREST / 0.5) ** (1 / (STATES - 1))


def _after_less(state: int) -> int:
    """The state nearest to the probability that the same decay gives after a less likely symbol."""
    p = 1 - _DECAY + _DECAY * 0.5 * _DECAY**state
    return min(state, max(0, round(math.log(2 * p) / math.log(_DECAY))))


#: By state: the probability of the less likely symbol in 1/256, and the state after one.
LESS_LIKELY = tuple(max(1, round(128 * _DECAY**s)) for s in range(STATES))
AFTER_LESS = tuple(map(_after_less, range(STATES)))
LEAST_RANGE, MASK, FLUSH = 1 << 24, 0xFFFFFFFF, 5
LAST_STATE = STATES - 1


class Contexts(dict):
    """Adaptive states by name: (state, more likely bit); a new one is even."""

    def __missing__(self, name):
        return (0, 0)

    def move(self, name, bit: int) -> None:
        state, likely = self[name]
        if bit == likely:
            self[name] = (min(state + 1, LAST_STATE), likely)
        else:
            self[name] = (AFTER_LESS[state], likely ^ (state == 0))


class Encoder:
    """Bits to bytes. A carry is added to the bytes already out, as one large number."""

    def __init__(self):
        self.out, self.low, self.range, self.contexts = bytearray(), 0, MASK, Contexts()

    def _carry(self) -> None:
        i = len(self.out) - 1
        while i >= 0 and self.out[i] == 0xFF:
            self.out[i] = 0
            i -= 1
        if i >= 0:
            self.out[i] += 1

    def bit(self, name, bit: int) -> None:
        state, likely = self.contexts[name]
        part = (self.range >> 8) * LESS_LIKELY[state]
        if bit == likely:
            self.range -= part
        else:
            self.low += self.range - part
            self.range = part
            if self.low > MASK:
                self.low &= MASK
                self._carry()
        self.contexts.move(name, bit)
        while self.range < LEAST_RANGE:
            self.out.append(self.low >> 24)
            self.low = self.low << 8 & MASK
            self.range <<= 8

    def finish(self) -> bytes:
        for _ in range(FLUSH):
            self.out.append(self.low >> 24)
            self.low = self.low << 8 & MASK
        return bytes(self.out)


class Decoder:
    """Bytes to bits; past the end there are zeros."""

    def __init__(self, data: bytes):
        self.data, self.at, self.range, self.contexts = data, 4, MASK, Contexts()
        self.low = int.from_bytes(data[:4].ljust(4, b"\0"), "big")

    def bit(self, name) -> int:
        state, likely = self.contexts[name]
        part = (self.range >> 8) * LESS_LIKELY[state]
        if self.low < self.range - part:
            self.range -= part
            bit = likely
        else:
            self.low -= self.range - part
            self.range = part
            bit = likely ^ 1
        self.contexts.move(name, bit)
        while self.range < LEAST_RANGE:
            more = self.data[self.at] if self.at < len(self.data) else 0
            self.at += 1
            self.low = (self.low << 8 | more) & MASK
            self.range <<= 8
        return bit


def write_number(e: Encoder, name: str, v: int) -> None:
    """Exp-Golomb with a context for each place of the prefix and of the suffix."""
    n = (v + 1).bit_length()
    for k in range(n - 1):
        e.bit((name, "p", k), 0)
    e.bit((name, "p", n - 1), 1)
    for k in range(n - 2, -1, -1):
        e.bit((name, "s", k), v + 1 >> k & 1)


def read_number(d: Decoder, name: str) -> int | None:
    """The number, or None where a prefix has no end."""
    n = 0
    while not d.bit((name, "p", n)):
        n += 1
        if n > 31:
            return None
    v = 1
    for k in range(n - 1, -1, -1):
        v = v << 1 | d.bit((name, "s", k))
    return v - 1


def encode_levels(blocks: list[list[int]]) -> bytes:
    """Blocks of levels as one stream: last place, then for each place significance, above one, above two, the
    rest and the sign; the DC place has contexts of its own."""
    e = Encoder()
    for levels in blocks:
        last = max((i for i, v in enumerate(levels) if v), default=-1)
        write_number(e, "last", last + 1)
        for i in range(last + 1):
            bank, v = "dc" if i == 0 else "ac", abs(levels[i])
            e.bit((bank, "sig"), int(v > 0))
            if v:
                e.bit((bank, "gt1"), int(v > 1))
                if v > 1:
                    e.bit((bank, "gt2"), int(v > 2))
                    if v > 2:
                        write_number(e, bank, v - 3)
                e.bit((bank, "sign"), int(levels[i] < 0))
    return e.finish()


def decode_levels(data: bytes, blocks: int, size: int) -> list[list[int]] | None:
    """The blocks, or None for a stream that does not hold them."""
    d, out = Decoder(data), []
    for _ in range(blocks):
        n = read_number(d, "last")
        if n is None or n > size:
            return None
        levels = [0] * size
        for i in range(n):
            bank = "dc" if i == 0 else "ac"
            if not d.bit((bank, "sig")):
                continue
            v = 1
            if d.bit((bank, "gt1")):
                v = 2
                if d.bit((bank, "gt2")):
                    rest = read_number(d, bank)
                    if rest is None or rest > 32767:
                        return None
                    v = 3 + rest
            levels[i] = -v if d.bit((bank, "sign")) else v
        out.append(levels)
    return out


def encoded(blocks: Column) -> Column:
    """Streams of arrays of blocks."""

    def run(x: pa.Array) -> pa.Array:
        return pa.array([None if b is None else encode_levels(b) for b in x.to_pylist()], pa.binary())

    run.__annotations__ = {"x": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "binary")(blocks)


def decoded(data: Column, count: Column, size: int) -> Column:
    """Blocks of streams; null for a stream that does not hold them."""

    def run(x: pa.Array, n: pa.Array) -> pa.Array:
        out = [None if d is None else decode_levels(d, k, size) for d, k in zip(x.to_pylist(), n.to_pylist())]
        return pa.array(out, pa.list_(pa.list_(pa.int32())))

    run.__annotations__ = {"x": pa.Array, "n": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<array<int>>")(data, count)
