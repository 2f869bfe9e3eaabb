"""Array columns as NumPy arrays, an Arrow batch at a time.

For kernels whose native form would be nested lambdas, which Spark interprets element by element. Spark
deals the rows; a kernel sees one batch of blocks of one length.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _numbers(a: pa.Array) -> np.ndarray:
    """(rows, length) of an array column without nulls, or the rows of any other one."""
    if not pa.types.is_list(a.type):
        return a.to_numpy(zero_copy_only=False)
    flat = a.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    return flat.reshape(len(a), -1) if len(a) else np.empty((0, 0), np.int64)


def _arrow(values, good: np.ndarray) -> pa.Array:
    """Rows of numbers, of lists or of lists of lists as an Arrow array with nulls where ``good`` is false."""
    if isinstance(values, dict):
        return pa.StructArray.from_arrays([_arrow(v, np.ones(len(v), bool)) for v in values.values()], list(values)).take(_places(good))
    out = pa.array(values.ravel())
    for width in reversed(values.shape[1:]):
        out = pa.ListArray.from_arrays(pa.array(np.arange(0, len(out) + 1, width), pa.int32()), out)
    return out.take(_places(good))


def _places(good: np.ndarray) -> pa.Array:
    return pa.array(np.cumsum(good) - 1, pa.int64(), mask=~good)


def on_blocks(kernel: Callable, *arrays: pa.Array) -> pa.Array:
    """``kernel`` over (rows, length) arrays of 64-bit integers, one for each Arrow array; what it gives has a row
    for each row, or is a dict of such. Rows with a null in any array are null."""
    good = np.ones(len(arrays[0]), bool)
    for a in arrays:
        good &= a.is_valid().to_numpy(zero_copy_only=False)
    return _arrow(kernel(*[_numbers(a if good.all() else a.filter(pa.array(good))) for a in arrays]), good)


def over_blocks(kernel: Callable, kind: str, *columns: Column) -> Column:
    """``on_blocks`` over columns."""

    def run(*arrays: pa.Array) -> pa.Array:
        return on_blocks(kernel, *arrays)

    return F.arrow_udf(run, kind)(*columns)
