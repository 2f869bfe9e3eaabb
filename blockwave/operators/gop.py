"""Encoding and decoding of closed groups of frames, a group a task.

Inside a group every step needs the samples and coder states that the one before it left, so a group
is the unit of work; groups are independent, as each begins with a key frame. Frames are luma planes
of whole 8x8 blocks. The stream format is this module's own: a frame header, then one range-coded
payload of block decisions, vectors, levels and band offsets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predict import DC, HORIZONTAL, MODES, PLANAR, VERTICAL
from ..functions.quant import STEPS, WEIGHTS
from ..functions.rangecoder import Decoder, Encoder, read_number, write_number
from ..functions.transform import matrix
from ..sources.container import DEFAULT_QP, KEY, MAGIC, RAP

N, CTU, EDGE = 8, 64, 4
SKIP, INTER, INTRA = 0, 1, 2
_C = np.array(matrix("dct", N), np.int64)
_BANDS = np.where(np.arange(64) == 0, 0, np.where(np.arange(64) < 16, 1, np.where(np.arange(64) < 32, 2, 3)))
_EFF = np.array([[max((s * w + 4) >> 3, 1) for w in WEIGHTS] for s in STEPS], np.int64)
PACKETS = "clip string, gop long, pkt_idx long, frame_idx long, key boolean, size int, sse long, payload binary"


def forward(x: np.ndarray) -> np.ndarray:
    return (_C @ ((x @ _C.T + 8192) >> 14) + 8192) >> 14


def inverse(x: np.ndarray) -> np.ndarray:
    return (_C.T @ ((x @ _C + 8192) >> 14) + 8192) >> 14


def levels_of(residual: np.ndarray, qp: int, lam: int) -> np.ndarray:
    """Quantized coefficients, ones dropped where that is cheaper."""
    c, eff = forward(residual).ravel(), _EFF[qp][_BANDS]
    q = np.sign(c) * ((np.abs(c) + eff // 3) // eff)
    back = q * eff + np.sign(q) * (eff // 6)
    return np.where((np.abs(q) == 1) & (c * c + lam < (c - back) ** 2 + 2 * lam), 0, q)


def residual_of(levels: np.ndarray, qp: int) -> np.ndarray:
    eff = _EFF[qp][_BANDS]
    return inverse((levels * eff + np.sign(levels) * (eff // 6)).reshape(N, N))


def estimate(levels: np.ndarray) -> int:
    """Bits of a block's levels, about."""
    at = np.flatnonzero(levels)
    if not len(at):
        return 1
    used = np.abs(levels[: at[-1] + 1])
    return int(np.where(used == 0, 1, 2 + 2 * np.frexp(np.maximum(used, 1).astype(float))[1]).sum()) + 2 * int(at[-1] + 2).bit_length() - 1


def references(rec: np.ndarray, y: int, x: int) -> tuple[np.ndarray, np.ndarray]:
    """Corner, then 16 samples above and at the left; 128 where there is none, the last one repeated."""
    corner = rec[y - 1, x - 1] if y and x else 128
    above = rec[y - 1, x : x + 2 * N] if y else np.full(2 * N, 128)
    left = rec[y : y + N, x - 1] if x else np.full(N, 128)
    pad = lambda a: np.r_[corner, a, np.full(2 * N - len(a), a[-1])].astype(np.int64)
    return pad(above), pad(left)


_Y, _X = np.mgrid[0:N, 0:N]


def _angular() -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """The angular modes; for each and each sample the two references that it lies between, those at the left after those
    above, and how far from the first it is."""
    modes, tables = [m for m in range(MODES) if m not in (PLANAR, DC)], []
    for mode in modes:
        vertical = mode in VERTICAL
        along, away = (_X, _Y) if vertical else (_Y, _X)
        pos = along * 32 + away * (VERTICAL[mode] if vertical else HORIZONTAL[mode])
        at, frac = (np.abs(pos) >> 5) + 1, np.abs(pos) & 31
        side = ((pos >= 0) != vertical) * (2 * N + 1)
        tables.append((np.minimum(at, 2 * N) + side, np.minimum(at + 1, 2 * N) + side, frac))
    return modes, *map(np.array, zip(*tables))


_ANGLES, _FIRST, _SECOND, _FRAC = _angular()


def predictions(above: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The block by every mode."""
    out, both = np.empty((MODES, N, N), np.int64), np.concatenate([above, left])
    a, b = both[_FIRST], both[_SECOND]
    out[_ANGLES] = a + (((b - a) * _FRAC + 16) >> 5)
    out[PLANAR] = (above[_X + 1] * (N - 1 - _Y) + left[_Y + 1] * (N - 1 - _X) + above[0] * (_X + _Y) + N) // (2 * N)
    out[DC] = (above[1 : N + 1].sum() + left[1 : N + 1].sum() + N) // (2 * N)
    return np.minimum(np.maximum(out, 0, out=out), 255, out=out)


def predict(above: np.ndarray, left: np.ndarray, mode: int) -> np.ndarray:
    return predictions(above, left)[mode]


def moved(ref: np.ndarray, y: int, x: int, dy: int, dx: int) -> np.ndarray | None:
    """The block at a displacement, None outside the frame."""
    a, b = y + dy, x + dx
    if a < 0 or b < 0 or a + N > ref.shape[0] or b + N > ref.shape[1]:
        return None
    return ref[a : a + N, b : b + N]


def best_vector(cur: np.ndarray, ref: np.ndarray, y: int, x: int, reach: int) -> tuple[int, int]:
    """The whole-sample displacement with the least error within the reach, the smallest of equals."""
    a, b = max(0, y - reach), max(0, x - reach)
    part = ref[a : min(ref.shape[0], y + reach + N), b : min(ref.shape[1], x + reach + N)]
    views = np.lib.stride_tricks.sliding_window_view(part, (N, N))
    cost = np.abs(views - cur).sum(axis=(2, 3))
    at = np.argwhere(cost == cost.min()) + (a - y, b - x)
    return min((abs(int(dy)) + abs(int(dx)), int(dy), int(dx)) for dy, dx in at)[1:]


def _deblock_lines(v: np.ndarray, qp: int) -> None:
    """Vertical edges every four columns but on CTU borders, in place. Edges do not touch each other."""
    q = np.arange(EDGE, v.shape[1] - 1, EDGE)
    q = q[q % CTU != 0]
    p1, p0, q0, q1 = v[:, q - 2], v[:, q - 1], v[:, q], v[:, q + 1]
    reach = max(min(max(qp // 4, 2), 16), min(max(qp // 2, 4), 32), min(max(qp, 8), 48))
    t = min(max(qp // 3, 1), 10)
    on = np.abs(p0 - q0) < reach
    low = np.clip(p0 + np.clip((9 * (q0 - p0) - 3 * (q1 - p1) + 8) >> 4, -t, t), 0, 255)
    high = np.clip(q0 + np.clip((9 * (p0 - q0) - 3 * (p1 - q1) + 8) >> 4, -t, t), 0, 255)
    v[:, q - 1], v[:, q] = np.where(on, low, p0), np.where(on, high, q0)


def deblock(rec: np.ndarray, qp: int) -> None:
    _deblock_lines(rec, qp)
    _deblock_lines(rec.T, qp)


def choose_offset(orig: np.ndarray, rec: np.ndarray) -> tuple[int, int, int] | None:
    """(change, band, offset) of the band offset that lowers the error most."""
    d, band = orig - rec, rec >> 3
    best = None
    for b in np.unique(band).tolist():
        own = d[band == b]
        s, n = int(own.sum()), len(own)
        off = max(-7, min(7, (abs(s) + n // 2) // n * (1 if s >= 0 else -1)))
        if off:
            shift = np.clip(rec[band == b] + off, 0, 255) - rec[band == b]
            change = int((shift * shift - 2 * shift * own).sum())
            if change < 0 and (best is None or (change, b, off) < best):
                best = (change, b, off)
    return best


class _Writer:
    """Symbols into a range coder."""

    def __init__(self):
        self.coder = Encoder()

    def number(self, name: str, v: int) -> int:
        write_number(self.coder, name, v)
        return v

    def finish(self) -> bytes:
        return self.coder.finish()


class _Reader:
    """The same calls, answered from a stream; what is passed is ignored."""

    def __init__(self, data: bytes):
        self.coder = Decoder(data)

    def number(self, name: str, v: int = 0) -> int:
        got = read_number(self.coder, name)
        if got is None:
            raise ValueError("damaged stream")
        return got


def _signed(io: _Writer | _Reader, name: str, v: int = 0) -> int:
    u = io.number(name, 2 * v - 1 if v > 0 else -2 * v)
    return (u + 1) // 2 if u % 2 else -(u // 2)


def _levels(io: _Writer | _Reader, levels: np.ndarray | None = None) -> np.ndarray:
    at = np.flatnonzero(levels) if levels is not None else ()
    n = io.number("last", int(at[-1]) + 1 if len(at) else 0)
    if n > 64:
        raise ValueError("damaged stream")
    out = np.zeros(64, np.int64)
    for i in range(n):
        out[i] = _signed(io, "dc" if i == 0 else "ac", int(levels[i]) if levels is not None else 0)
    return out


@dataclass
class Block:
    kind: int
    mode: int
    vector: tuple[int, int]
    levels: np.ndarray
    rec: np.ndarray
    cost: int


def _decide(cur: np.ndarray, rec: np.ndarray, ref: np.ndarray | None, y: int, x: int, near: tuple[int, int], qp: int, lam: int, reach: int) -> Block:
    """Of skip, inter and intra the block with the least error plus weighted bits; the first of equals."""
    above, left = references(rec, y, x)
    tries: list[tuple[int, int, tuple[int, int], np.ndarray]] = []
    if ref is not None:
        if (p := moved(ref, y, x, *near)) is not None:
            tries.append((SKIP, 0, near, p))
        v = best_vector(cur, ref, y, x, reach)
        tries.append((INTER, 0, v, moved(ref, y, x, *v)))
    preds = predictions(above, left)
    mode = int(np.abs(cur - preds).sum(axis=(1, 2)).argmin())
    tries.append((INTRA, mode, near, preds[mode]))
    best = None
    for kind, m, v, pred in tries:
        levels = np.zeros(64, np.int64) if kind == SKIP else levels_of(cur - pred, qp, lam)
        out = pred if not levels.any() else np.clip(pred + residual_of(levels, qp), 0, 255)
        side = 1 if kind == SKIP else 6 if kind == INTRA else 2 + 2 * sum(2 * (2 * abs(a - b) + 1).bit_length() - 1 for a, b in zip(v, near))
        cost = int(((cur - out) ** 2).sum()) + lam * (side + (0 if kind == SKIP else estimate(levels)))
        if best is None or cost < best.cost:
            best = Block(kind, m, v, levels, out, cost)
    return best


def _blocks(io: _Writer | _Reader, orig: np.ndarray | None, ref: np.ndarray | None, shape: tuple[int, int], qp: int, reach: int) -> np.ndarray:
    """One frame, written (``orig`` given) or read."""
    lam = max(1, STEPS[qp] ** 2 * 200 >> 10)
    rec = np.zeros(shape, np.int64)
    for y in range(0, shape[0], N):
        near = (0, 0)
        for x in range(0, shape[1], N):
            b = _decide(orig[y : y + N, x : x + N], rec, ref, y, x, near, qp, lam, reach) if orig is not None else None
            kind = io.number("kind", b.kind if b else 0) if ref is not None else INTRA
            vector, levels = near, None
            if kind == INTER:
                vector = tuple(_signed(io, "mv", (b.vector[k] - near[k]) if b else 0) + near[k] for k in (0, 1))
            if kind in (SKIP, INTER):
                pred = moved(ref, y, x, *vector)
            elif kind == INTRA and (mode := io.number("mode", b.mode if b else 0)) < MODES:
                pred = predict(*references(rec, y, x), mode)
            else:
                pred = None
            if pred is None:
                raise ValueError("damaged stream")
            if kind != SKIP:
                levels = _levels(io, b.levels if b else None)
            near = vector
            rec[y : y + N, x : x + N] = pred if levels is None or not levels.any() else np.clip(pred + residual_of(levels, qp), 0, 255)
    deblock(rec, qp)
    for y in range(0, shape[0], CTU):
        for x in range(0, shape[1], CTU):
            part = rec[y : y + CTU, x : x + CTU]
            best = choose_offset(orig[y : y + CTU, x : x + CTU], part) if orig is not None else None
            if best and best[0] + 6 * lam >= 0:
                best = None
            if io.number("sao", int(best is not None)):
                band, off = io.number("band", best[1] if best else 0), _signed(io, "off", best[2] if best else 0)
                part[part >> 3 == band] = np.clip(part[part >> 3 == band] + off, 0, 255)
    return rec


def encode_frame(orig: np.ndarray, ref: np.ndarray | None, qp: int, number: int, reach: int = 8) -> tuple[bytes, np.ndarray]:
    """A packet, and the frame as a decoder sees it. Without a reference it is a key frame."""
    io = _Writer()
    rec = _blocks(io, orig.astype(np.int64), ref, orig.shape, qp, reach)
    h, w = orig.shape
    head = MAGIC + bytes([2]) + w.to_bytes(2, "big") + h.to_bytes(2, "big") + bytes([KEY | RAP if ref is None else 0, (qp - DEFAULT_QP) & 255, number & 255, 0, 0, 0])
    return head + io.finish(), rec


def decode_frame(packet: bytes, ref: np.ndarray | None) -> np.ndarray:
    """The frame of a packet; ValueError for a damaged one."""
    if len(packet) < 14 or packet[:3] != MAGIC:
        raise ValueError("not a packet")
    w, h, qp = int.from_bytes(packet[4:6], "big"), int.from_bytes(packet[6:8], "big"), DEFAULT_QP + int.from_bytes(packet[9:10], "big", signed=True)
    key = bool(packet[8] & KEY)
    if w % N or h % N or not w or not h or not 0 <= qp <= 63 or (not key and (ref is None or ref.shape != (h, w))):
        raise ValueError("damaged header")
    return _blocks(_Reader(packet[14:]), None, None if key else ref, (h, w), qp, 0)


def _dealt(df: DataFrame) -> DataFrame:
    """Groups over all tasks. They are few bytes and much work, so tasks must not be merged by their bytes."""
    return df.repartition(max(32, 4 * df.sparkSession.sparkContext.defaultParallelism), "clip", "gop")


def encode(frames: DataFrame, qp: int = 30, interval: int = 30, reach: int = 8) -> DataFrame:
    """Packets of frames (clip, frame_idx, width, height, y binary), a closed group of ``interval`` frames a task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, ref = [], None
        for f in pdf.sort_values("frame_idx").itertuples():
            orig = np.frombuffer(f.y, np.uint8).reshape(f.height, f.width).astype(np.int64)
            packet, rec = encode_frame(orig, ref, qp, f.frame_idx, reach)
            rows.append((f.clip, f.gop, f.frame_idx, f.frame_idx, ref is None, len(packet), int(((orig - rec) ** 2).sum()), packet))
            ref = rec
        return pd.DataFrame(rows, columns=[c.split(" ")[0] for c in PACKETS.split(", ")])

    grouped = frames.withColumn("gop", F.floor(F.col("frame_idx") / interval).cast("long"))
    return _dealt(grouped).groupBy("clip", "gop").applyInPandas(run, PACKETS)


def decode(packets: DataFrame, *carried: str) -> DataFrame:
    """(clip, frame_idx, y, error) of packets (clip, gop, pkt_idx, frame_idx, payload), and the packets' ``carried`` columns. A damaged
    packet gives a row with its error, and the group's frames after it are not decoded."""
    kinds = dict(packets.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(_decoded(pdf, carried)), columns=["clip", "frame_idx", "y", "error", *carried])

    schema = ", ".join(["clip string, frame_idx long, y binary, error string", *(f"{c} {kinds[c]}" for c in carried)])
    return _dealt(packets).groupBy("clip", "gop").applyInPandas(run, schema)


def _decoded(pdf: pd.DataFrame, carried: tuple[str, ...] = ()) -> Iterator[tuple]:
    ref, wrong = None, ""
    for p in pdf.sort_values("pkt_idx").itertuples():
        if not wrong:
            try:
                ref = decode_frame(bytes(p.payload), ref)
            except (ValueError, IndexError) as e:
                wrong = str(e) or "damaged stream"
        yield p.clip, p.frame_idx, None if wrong else ref.astype(np.uint8).tobytes(), wrong, *(getattr(p, c) for c in carried)


def squared_error(x: Column, y: Column) -> Column:
    """The sum of squared differences of two planes of bytes; null where one is."""

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        plane = lambda d: np.frombuffer(d, np.uint8).astype(np.int64)
        both = zip(a.to_pylist(), b.to_pylist())
        return pa.array([None if u is None or v is None else int(((plane(u) - plane(v)) ** 2).sum()) for u, v in both], pa.int64())

    run.__annotations__ = {"a": pa.Array, "b": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "long")(x, y)
