"""Rate control: the QP model, and the buffer recurrence as a fold over a key's frames in order."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ints import Value, clip, col

#: Middle and scale of the model, and the QP range.
MIDDLE, SCALE = 28.0, 8.0
QP_MIN, QP_MAX = 0, 63


def rho(qp: Value) -> Column:
    """The share of coarseness that a QP stands for."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(col(qp).cast("double") - MIDDLE) / SCALE))


def qp_of(r: Column) -> Column:
    logit = F.ln(r / (F.lit(1.0) - r))
    near = clip(F.floor(F.lit(MIDDLE) + logit * SCALE + 0.5).cast("int"), QP_MIN, QP_MAX)
    return F.when(r <= 0.01, QP_MIN).when(r >= 0.99, QP_MAX).otherwise(near).cast("int")


def step_of(level: Column) -> Column:
    """What the fullness of the budget asks for: negative for a finer QP."""
    return F.when(level > 0.8, -2.0).when(level > 0.6, -1.0).when(level < 0.2, 2.0).when(level < 0.4, 1.0).otherwise(0.0)


def start_frame(qp: Column, level: Column) -> Column:
    """The QP of the next frame, constant and variable rate alike."""
    target = F.least(F.greatest(rho(qp) + step_of(level) * 0.05, F.lit(0.05)), F.lit(0.95))
    return qp_of(target)


def next_qp(qp: int, level: float) -> int:
    """The QP after one look at the budget, as a plain number."""
    ask = -2.0 if level > 0.8 else -1.0 if level > 0.6 else 2.0 if level < 0.2 else 1.0 if level < 0.4 else 0.0
    r = min(max(1.0 / (1.0 + math.exp(-(qp - MIDDLE) / SCALE)) + ask * 0.05, 0.05), 0.95)
    return min(max(int(MIDDLE + SCALE * math.log(r / (1.0 - r)) + 0.5), QP_MIN), QP_MAX)


def end_frame(level: Column, used: Column, target: Column, size: Column) -> Column:
    """The budget after a frame, between 0 and 1; without a buffer it stays."""
    after = level + (target.cast("double") - used.cast("double")) / size
    return F.when(size > 0, F.least(F.greatest(after, F.lit(0.0)), F.lit(1.0))).otherwise(level)


def fold(bits: Column, qp: Value, bitrate: Value, fps: float) -> Column:
    """struct(qp, level, total, frames, qps) after an ordered array of frame sizes in bits.

    The recurrence is clamped at every frame, so it is no window sum: an array fold for each key.
    """
    rate = col(bitrate).cast("double")
    target = F.floor(rate / fps).cast("bigint")
    start = F.struct(
        col(qp).cast("int").alias("qp"), F.lit(0.5).alias("level"), F.lit(0).cast("bigint").alias("total"), F.lit(0).alias("frames"), F.array().cast("array<int>").alias("qps")
    )

    def one(s: Column, used: Column) -> Column:
        q = start_frame(s["qp"], s["level"])
        return F.struct(
            q.alias("qp"), end_frame(s["level"], used, target, rate).alias("level"), (s["total"] + used).alias("total"), (s["frames"] + 1).alias("frames"), F.concat(s["qps"], F.array(q)).alias("qps")
        )

    return F.aggregate(bits, start, one)


def layer_offset(position: Value) -> Column:
    """QP offset of a coding position in groups of four: middle 1, outer 2, anchors 0."""
    p = col(position)
    c = (p + 3) % 4
    return F.when(p == 0, 0).when(c == 1, 1).when(c >= 2, 2).otherwise(0)


def layer_qp(qp: Value, position: Value) -> Column:
    return clip(col(qp) + layer_offset(position), QP_MIN, QP_MAX)
