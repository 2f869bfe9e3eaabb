"""In-loop filters as column expressions: deblocking of one edge, and the band offset."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ints import Value, clip, clip8, col, div, shr

BANDS, MOST = 32, 7


def edge_strength(p0: Column, q0: Column, qp: Value) -> Column:
    """2 for small steps, 1 for larger ones, 0 for what is likely a real edge."""
    d = F.abs(p0 - q0)
    return F.when(d < clip(div(qp, 4), 2, 16), 2).when(d < clip(div(qp, 2), 4, 32), 1).when(d < clip(qp, 8, 48), 1).otherwise(0)


def weak(a1: Column, a0: Column, b0: Column, b1: Column, qp: Value) -> Column:
    """The sample a0 next to the edge, filtered; a1 is behind it, b0 and b1 are beyond the edge."""
    t = clip(div(qp, 3), 1, 10)
    delta = shr((b0 - a0) * 9 - (b1 - a1) * 3 + 8, 4)
    return clip8(a0 + clip(delta, -t, t))


def edge(p1: Column, p0: Column, q0: Column, q1: Column, qp: Value) -> tuple[Column, Column]:
    """Both samples next to the edge, filtered where the strength is above 0."""
    on = edge_strength(p0, q0, qp) > 0
    return F.when(on, weak(p1, p0, q0, q1, qp)).otherwise(p0), F.when(on, weak(q1, q0, p0, p1, qp)).otherwise(q0)


def chroma_edge(p0: Column, q0: Column, qp: Value, decide: tuple[Column, Column] | None = None) -> tuple[Column, Column]:
    """A chroma edge at one QP less. ``decide``: the pair that the strength is taken from, if another one."""
    own = clip(col(qp) - 1, 0, 63)
    a, b = decide or (p0, q0)
    t = clip(div(own, 4), 1, 6)
    delta = clip(shr(q0 - p0 + 1, 1), -t, t)
    on = edge_strength(a, b, own) > 0
    return F.when(on, clip8(p0 + delta)).otherwise(p0), F.when(on, clip8(q0 - delta)).otherwise(q0)


def band(v: Column) -> Column:
    return shr(clip8(v), 3)


def band_offset(v: Column, which: Value, offset: Value) -> Column:
    """v moved by the offset if it is of the band."""
    return F.when(band(v) == clip(which, 0, BANDS - 1), clip8(v + clip(offset, -MOST, MOST))).otherwise(v)
