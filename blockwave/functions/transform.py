"""Block transforms: Walsh-Hadamard and residual DCT of 4x4 and 8x8 blocks.

A block is an array of n*n integers in raster order. Both passes are matrix products over an Arrow batch
of blocks, without a shuffle. ``spread`` is the same computation over exploded coefficients, for blocks
that are stored one value per row.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import over_blocks
from .ints import shr, wrap16


@cache
def matrix(kind: str, n: int) -> tuple[tuple[int, ...], ...]:
    """Rows of the forward matrix: the orthonormal DCT times 2**14, or Hadamard rows in natural order."""
    if kind == "wht":
        return tuple(tuple(1 - 2 * ((i & j).bit_count() & 1) for j in range(n)) for i in range(n))
    unit = 1 << 14

    def value(k: int, j: int) -> int:
        return round(unit * math.sqrt((1 if k == 0 else 2) / n) * math.cos(math.pi * k * (2 * j + 1) / (2 * n)))

    return tuple(tuple(value(k, j) for j in range(n)) for k in range(n))


def _rounding(kind: str, n: int, last: bool) -> tuple[int, int]:
    """What to add and how far to shift after a pass."""
    if kind == "dct":
        return 8192, 14
    return (n // 2, n.bit_length() - 1) if last else (0, 0)


def transform_blocks(x: np.ndarray, kind: str, n: int, inverse: bool = False) -> np.ndarray:
    """Rows of blocks transformed: each block's rows, then its columns."""
    m = np.array(matrix(kind, n), np.int64)
    m = m.T if inverse and kind == "dct" else m
    x = x.reshape(-1, n, n)
    for by_row in (True, False):
        add, shift = _rounding(kind, n, not by_row)
        x = ((x @ m.T if by_row else m @ x) + add) >> shift
    return x.astype(np.int16).astype(np.int32).reshape(len(x), n * n)


def transform2d(block: Column, kind: str, n: int, inverse: bool = False) -> Column:
    """The transformed block, wrapped to 16 bits. The Hadamard transform is its own inverse."""
    return over_blocks(lambda x: transform_blocks(x, kind, n, inverse), "array<int>", block)


def spread(coefficients: DataFrame, keys: list[str], kind: str, n: int, inverse: bool = False) -> DataFrame:
    """(keys, i, j, v) transformed: two joins with a literal matrix of n*n rows and two sums.

    The matrix is of fixed size, so its broadcast is safe; the sums are combined before the shuffle.
    """
    spark, m = coefficients.sparkSession, matrix(kind, n)
    turned = inverse and kind == "dct"
    rows = [(k, t, m[t][k] if turned else m[k][t]) for k in range(n) for t in range(n)]
    mat = F.broadcast(spark.createDataFrame(rows, "k int, t int, w bigint"))
    out = coefficients
    for line, last in (("j", False), ("i", True)):
        add, shift = _rounding(kind, n, last)
        other = "i" if line == "j" else "j"
        joined = out.join(mat, out[line] == mat["t"])
        out = joined.groupBy(*keys, other, F.col("k").alias(line)).agg(shr(F.sum(F.col("v") * F.col("w")) + add, shift).alias("v"))
    return out.select(*keys, "i", "j", wrap16("v").alias("v"))


def dc_only(dc: Column, n: int) -> Column:
    """Every sample of the inverse DCT of a block with nothing but a DC coefficient."""
    w = 8192 if n == 4 else 5793
    return shr(shr(dc.cast("bigint") * w + 8192, 14) * w + 8192, 14)


def inverse_dct(block: Column, n: int) -> Column:
    """The inverse DCT; of blocks with nothing but a DC coefficient it is ``dc_only``, to the last bit."""
    return transform2d(block, "dct", n, True)
