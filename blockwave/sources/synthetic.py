"""Generated frames: pure functions of row, column and frame number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ints import div

_A, _C, _M = 1103515245, 12345, 1 << 32


def grid(spark: SparkSession, h: int, w: int, frames: int) -> DataFrame:
    """(f, r, c) of every sample, from one range: no join."""
    ids = spark.range(frames * h * w)
    return ids.select(div("id", h * w).alias("f"), (div("id", w) % h).alias("r"), (F.col("id") % w).alias("c"))


def noise_at(i: Column, seed: int) -> Column:
    """Sample i of the linear congruential noise: a fold over the bits of i jumps the generator to its
    place, so samples need not be made in order."""
    low = lambda x: x.bitwiseAND(F.lit(_M - 1))
    jumps, a, c = [], _A, _C
    for bit in range(24):
        jumps.append(F.struct(F.lit(bit).alias("bit"), F.lit(a & 0xFFFF).alias("low"), F.lit(a >> 16).alias("high"), F.lit(c).cast("bigint").alias("add")))
        a, c = a * a % _M, (a * c + c) % _M

    def jump(x: Column, j: Column) -> Column:
        # x * a in two parts, as the product would leave 64 bits
        moved = low(x * j["low"] + low(x * j["high"]) * 65536 + j["add"])
        on = F.call_function("shiftright", i.cast("bigint"), j["bit"]).bitwiseAND(F.lit(1)) == 1
        return F.when(on, moved).otherwise(x)

    first = (seed * _A + _C) % _M  # the state after one step is the first sample's
    return F.shiftright(F.aggregate(F.array(*jumps), F.lit(first).cast("bigint"), jump), 16).bitwiseAND(F.lit(255))


def pattern(spark: SparkSession, name: str, h: int, w: int, frames: int = 1, block: int = 16, seed: int = 7) -> DataFrame:
    """(f, r, c, v) of a named pattern: gradient, checkerboard, hlines, vlines, diagonal, noise, container, bridge, probe."""
    r, c, f = F.col("r"), F.col("c"), F.col("f")
    full = F.lit(255)
    on = lambda e: F.when(e, full).otherwise(0)
    value = {
        "gradient": div(div(r * 255, h) + div(c * 255, w), 2),
        "checkerboard": on((div(c, block) + div(r, block)) % 2 == 1),
        "hlines": on(r % 16 < 8),
        "vlines": on(c % 16 < 8),
        "diagonal": on((r + c) % 32 < 16),
        "container": (c * 9 + r * 13 + f * 17).bitwiseAND(full),
        "bridge": (c * 5 + r * 7 + f * 19).bitwiseAND(full),
    }
    if name == "noise":
        v = noise_at(r * w + c, seed)
    elif name == "probe":  # a drifting gradient with a moving square, a bar and a noisy corner
        square = (r >= 40 + f * 2) & (r < 72 + f * 2) & (c >= 20 + f * 3) & (c < 52 + f * 3)
        bar = (c >= w - 24) & (c < w - 16)
        noisy = (r >= h - 48) & (c < 48)
        v = F.when(square, 235).when(bar, 16).when(noisy, noise_at(r * w + c + f * h * w, seed)).otherwise(div(r * 255, h) + f * 2).bitwiseAND(full)
    else:
        v = value[name]
    return grid(spark, h, w, frames).withColumn("v", v.cast("int"))


def planes(pixels: DataFrame, keys: list[str], h: int, w: int) -> DataFrame:
    """(keys, plane) as one binary of h * w bytes a frame, rows first. A frame's samples meet in one row, as
    the format has it; frames are bounded by 4096 x 4096."""
    rows = pixels.groupBy(*keys, "r").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", "v"))), lambda s: F.lpad(F.hex(s["v"].cast("bigint")), 2, "0")), "").alias("line"))
    frames = rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "line"))), lambda s: s["line"]), "").alias("all"))
    return frames.where(F.length("all") == 2 * h * w).select(*keys, F.unhex("all").alias("plane"))
