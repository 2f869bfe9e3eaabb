"""Intra prediction from reference samples, over Arrow batches of blocks; chroma from luma as expressions.

``above`` and ``left`` hold 2n+1 samples each, the corner first.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .batches import over_blocks
from .ints import clip, clip8, div, let

#: Displacement of the angular modes in 1/32 samples a line.
VERTICAL = {2: 32, 3: 16, 4: 6, 5: 0, 6: -6, 7: -16, 8: -32}
HORIZONTAL = {9: 32, 10: 16, 11: 6, 12: 0, 13: -6, 14: -16, 15: -32, 16: -48, 17: 48}
PLANAR, DC = 0, 1
MODES = 18


def predict_blocks(above: np.ndarray, left: np.ndarray, n: int, mode: int) -> np.ndarray:
    """The blocks (rows, n*n) that a mode predicts from the rows' references; unknown modes count as DC.

    Modes 2 to 8 project onto the row above, 9 to 17 onto the column at the left; each falls back on the other.
    """
    y, x = np.divmod(np.arange(n * n), n)
    if mode == PLANAR:
        total = above[:, x + 1] * (n - 1 - y) + left[:, y + 1] * (n - 1 - x) + above[:, :1] * (x + y) + n
        out = np.where(total < 0, -(-total // (2 * n)), total // (2 * n))
    elif mode in VERTICAL or mode in HORIZONTAL:
        vertical = mode in VERTICAL
        main, other = (above, left) if vertical else (left, above)
        along, away = (x, y) if vertical else (y, x)
        pos = along * 32 + away * (VERTICAL[mode] if vertical else HORIZONTAL[mode])
        far = np.abs(pos)
        ref = lambda k: np.where(pos >= 0, main[:, np.minimum(k, 2 * n)], other[:, np.minimum(k, 2 * n)])
        a, b = ref((far >> 5) + 1), ref((far >> 5) + 2)
        out = a + (((b - a) * (far & 31) + 16) >> 5)
    else:
        total = above[:, 1 : n + 1].sum(1) + left[:, 1 : n + 1].sum(1) + n
        return np.repeat(total // (2 * n), n * n).reshape(-1, n * n).astype(np.int32)
    return np.clip(out, 0, 255).astype(np.int32)


def predict(above: Column, left: Column, n: int, mode: int) -> Column:
    """The block that a mode predicts; unknown modes count as DC."""
    return over_blocks(lambda a, b: predict_blocks(a, b, n, mode), "array<int>", above, left)


def predict_all(above: Column, left: Column, n: int, modes: range = range(MODES)) -> Column:
    """The blocks of several modes, in their order."""
    return over_blocks(lambda a, b: np.stack([predict_blocks(a, b, n, m) for m in modes], axis=1), "array<array<int>>", above, left)


def best_mode(block: Column, above: Column, left: Column, n: int) -> Column:
    """struct(sad, mode) of the mode with the least sum of absolute differences, the lowest mode of equals."""

    def kernel(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
        sads = np.stack([np.abs(x - predict_blocks(a, b, n, m)).sum(1) for m in range(MODES)], axis=1)
        return {"sad": sads.min(1), "mode": sads.argmin(1).astype(np.int32)}

    return over_blocks(kernel, "struct<sad:bigint,mode:int>", block, above, left)


def chroma_dc(above: Column, left: Column) -> Column:
    """The rounded mean of the neighbours there are (arrays without corner, null at a border), else 128."""
    none = F.array().cast("array<int>")
    both = F.concat(F.coalesce(above, none), F.coalesce(left, none))
    total = F.aggregate(both, F.lit(0).cast("bigint"), lambda a, v: a + v)
    k = F.size(both)
    return F.when(k == 0, 128).otherwise(div(total + div(k, 2), F.greatest(k, F.lit(1)))).cast("int")


def luma_slope(n: Column, sl: Column, sc: Column, slc: Column, sll: Column) -> Column:
    """struct(sign, shift) of chroma against luma from sums over neighbours: count, luma, chroma, products, squares."""
    cov, var = n * slc - sl * sc, n * sll - sl * sl
    q = div(var, F.greatest(F.abs(cov), F.lit(1)))
    log = F.length(F.bin(F.greatest(q, F.lit(1)))) - 1
    shift = F.when((n > 0) & (var > 0) & (cov != 0), clip(F.when(q < 1, 2).otherwise(log), 2, 5)).otherwise(3)
    return F.struct(F.when((n == 0) | (cov >= 0), 1).otherwise(-1).alias("sign"), shift.cast("int").alias("shift"))


def luma_blend(chroma: Column, luma: Column, sign: Column, shift: Column) -> Column:
    """A 4x4 chroma tile moved by its luma's deviation from the tile's rounded mean, shifted down."""
    total = F.aggregate(luma, F.lit(0).cast("bigint"), lambda a, v: a + v)
    mean = div(total + div(F.size(luma), 2), F.size(luma))
    moved = lambda m: F.zip_with(chroma, luma, lambda c, v: clip8(c + sign * F.call_function("shiftright", (v - m).cast("int"), shift)).cast("int"))
    return let(mean, moved)


def legacy_luma_blend(chroma: Column, luma: Column) -> Column:
    """The older form: an eighth of the deviation, always with its sign."""
    return luma_blend(chroma, luma, F.lit(1), F.lit(3))


def references(n: int, missing: int = 128) -> tuple[Column, Column]:
    """Above and left samples from neighbour columns ``corner``, ``above_n`` and ``left_n`` (arrays of up to 2n,
    null where there is no neighbour): a missing side is 128, a short one repeats its last sample."""

    def side(name: str) -> Column:
        known = F.coalesce(F.col(name), F.array().cast("array<int>"))
        last = F.coalesce(F.element_at(known, -1), F.lit(missing)) if n else None
        filled = F.concat(known, F.array_repeat(F.when(F.size(known) > 0, last).otherwise(missing), F.lit(2 * n) - F.size(known)))
        return F.concat(F.array(F.coalesce(F.col("corner"), F.lit(missing))), filled)

    return side("above_n"), side("left_n")
