"""Colour conversion in 14-bit fixed point (BT.601, full range), as projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ints import clip8, div, shr

#: Rows of the forward matrix and the inverse coefficients, times 2**14.
FORWARD = {"y": (4899, 9617, 1868), "cb": (-2763, -5425, 8192), "cr": (8192, -6855, -1327)}
INVERSE = {"r_cr": 22970, "g_cb": -5638, "g_cr": -11696, "b_cb": 29032}


def rgb_to_ycc(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """y, cb and cr of one pixel."""

    def row(k: str) -> Column:
        a, c, d = FORWARD[k]
        return shr(r * a + g * c + b * d + 8192, 14)

    return {"y": clip8(row("y")), "cb": clip8(row("cb") + 128), "cr": clip8(row("cr") + 128)}


def ycc_to_rgb(y: Column, cb: Column, cr: Column) -> dict[str, Column]:
    """red, green and blue of one pixel."""
    u, v = cb - 128, cr - 128
    return {
        "red": clip8(y + shr(v * INVERSE["r_cr"] + 8192, 14)),
        "green": clip8(y + shr(u * INVERSE["g_cb"] + v * INVERSE["g_cr"] + 8192, 14)),
        "blue": clip8(y + shr(u * INVERSE["b_cb"] + 8192, 14)),
    }


def frame_to_420(pixels: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Luma (keys, r, c, y) and chroma (keys, r, c, cb, cr) planes of RGB pixels (keys, r, c, red, green, blue).

    Chroma is the truncated mean of the four converted values; an odd last row or column gives luma only.
    """
    ycc = rgb_to_ycc(F.col("red"), F.col("green"), F.col("blue"))
    all_ = pixels.select(*keys, "r", "c", *[v.alias(k) for k, v in ycc.items()])
    quads = all_.groupBy(*keys, div("r", 2).alias("r"), div("c", 2).alias("c"))
    chroma = quads.agg(F.count("*").alias("n"), F.sum("cb").alias("cb"), F.sum("cr").alias("cr")).where("n = 4")
    return all_.select(*keys, "r", "c", "y"), chroma.select(*keys, "r", "c", div("cb", 4).alias("cb"), div("cr", 4).alias("cr"))


def frame_to_rgb(luma: DataFrame, chroma: DataFrame, keys: list[str]) -> DataFrame:
    """RGB pixels of planes; each chroma sample serves the four luma samples that it covers."""
    halves = luma.select(*keys, "r", "c", "y", div("r", 2).alias("_r"), div("c", 2).alias("_c"))
    near = chroma.select(*keys, F.col("r").alias("_r"), F.col("c").alias("_c"), "cb", "cr")
    rgb = ycc_to_rgb(F.col("y"), F.col("cb"), F.col("cr"))
    return halves.join(near, [*keys, "_r", "_c"]).select(*keys, "r", "c", *[v.alias(k) for k, v in rgb.items()])
