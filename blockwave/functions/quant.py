"""Perceptually weighted quantization, its inverses, and rate-distortion choices, as array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ints import Value, array, bit_length, clip, clip8, col, div, shr

#: The step of each QP, and the weight of each frequency band in eighths.
STEPS = (
    1, 1, 1, 1, 1, 2, 2, 2, 3, 3, 4, 4, 5, 6, 7, 8, 9, 10, 12, 14, 16, 18, 21, 24, 28, 32, 37, 42, 49, 56, 64, 74,
    85, 98, 112, 128, 149, 171, 197, 226, 256, 299, 343, 394, 453, 512, 598, 686, 788, 907, 1024, 1196, 1373, 1576, 1814, 2048, 2392, 2745, 3153, 3629, 4096, 4784, 5490, 6305,
)
WEIGHTS = (6, 7, 8, 10)


def step(qp: Value) -> Column:
    """The step of a QP, clamped to 0..63."""
    return F.get(array(STEPS), clip(qp, 0, 63).cast("int"))


def weight(band: Value) -> Column:
    return F.get(array(WEIGHTS), clip(band, 0, 3).cast("int"))


def band_of(pos: Value, n: int) -> Column:
    """The frequency band of a raster position: DC, below a quarter, below half, the rest."""
    p = col(pos)
    return F.when(p == 0, 0).when(p < n * n // 4, 1).when(p < n * n // 2, 2).otherwise(3)


def effective(qp: Value, band: Value) -> Column:
    return F.greatest(shr(step(qp) * weight(band) + 4, 3), F.lit(1))


def effective_table(spark: SparkSession) -> DataFrame:
    """(qp, band, pos, eff) for every QP, band and position."""
    ranges = [spark.range(n).select(F.col("id").cast("int").alias(name)) for name, n in (("qp", 64), ("band", 4), ("pos", 64))]
    grid = ranges[0].join(F.broadcast(ranges[1]), how="cross").join(F.broadcast(ranges[2]), how="cross")
    return grid.select("qp", "band", "pos", effective(F.col("qp"), F.col("band")).alias("eff"))


def trade_off(qp: Value) -> Column:
    """The weight of a bit against squared error."""
    s = step(qp).cast("bigint")
    return clip(shr(s * s * 200, 10), 1, 1 << 30)


def _sign(v: Column) -> Column:
    return F.signum(v).cast("int")


def quantize_value(c: Column, eff: Column) -> Column:
    """Dead zone of a third of the step."""
    return div(F.abs(c) + div(eff, 3), eff) * _sign(c)


def dequantize_value(q: Column, eff: Column, legacy: bool = False) -> Column:
    """Reconstruction above the multiple by half the step (legacy) or a sixth of it."""
    return q * eff + (shr(eff, 1) if legacy else div(eff, 6)) * _sign(q)


def _each(block: Column, qp: Column, n: int, band: int | None, one) -> Column:
    def cell(v: Column, i: Column) -> Column:
        return one(v, effective(qp, band if band is not None else band_of(i, n))).cast("int")

    return F.transform(block, cell)


def quantize(block: Column, qp: Column, n: int, band: int | None = None) -> Column:
    """Levels of a block; every position in its own band unless one is given (legacy blocks)."""
    return _each(block, qp, n, band, quantize_value)


def dequantize(levels: Column, qp: Column, n: int, band: int | None = None, legacy: bool = False) -> Column:
    return _each(levels, qp, n, band, lambda q, e: dequantize_value(q, e, legacy))


def nonzero(levels: Column) -> Column:
    return F.size(F.filter(levels, lambda v: v != 0))


def drop_ones(levels: Column, block: Column, qp: Column, n: int) -> Column:
    """Levels of 1 and -1 set to 0 where error plus bits are then smaller."""
    pairs = F.arrays_zip(levels.alias("q"), block.alias("c"))
    lam = trade_off(qp)

    def cell(p: Column, i: Column) -> Column:
        q, c = p["q"].cast("bigint"), p["c"].cast("bigint")
        back = dequantize_value(q, effective(qp, band_of(i, n)))
        better = c * c + lam < (c - back) * (c - back) + lam * 2
        return F.when((F.abs(q) == 1) & better, 0).otherwise(p["q"])

    return F.transform(pairs, cell)


def add_residual(pred: Column, residual: Column) -> Column:
    """Prediction plus residual, clipped to a byte."""
    return F.zip_with(pred, residual, lambda p, r: clip8(p + r))


def level_bits(levels: Column, last: Column) -> Column:
    """Estimated bits of significance and levels up to the last position."""
    part = F.slice(levels, F.lit(1), F.greatest(last + 1, F.lit(0)))
    cost = lambda v: F.when(v == 0, 1).otherwise(F.lit(2) + bit_length(F.abs(v)) * 2)
    return F.aggregate(part, F.lit(0), lambda a, v: a + cost(v))


def last_bits(last: Column) -> Column:
    """Estimated bits of the last significant position."""
    far = F.lit(5) + bit_length(F.greatest(last - 3, F.lit(1))) * 2
    return F.when(last < 0, 1).when(last < 4, last + 3).otherwise(far)
