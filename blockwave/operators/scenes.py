"""Scene cuts, key frames, static areas and other decisions on a clip's frames in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ints import Value, col, div
from .metrics import HISTOGRAM_BINS, histogram

CUT = 0.5
STATIC_BLOCK, STATIC_CTU = 31, 2000
ENTRY_BYTES = 256


def chi_square(now: Column, before: Column) -> Column:
    """One bin's distance; 0 where both are empty."""
    mean = (now + before) / F.lit(2.0)
    return F.when(mean > 0, (now - before) * (now - before) / mean).otherwise(0.0)


def cut_distances(samples: DataFrame, clip: list[str], frame: str, value: str) -> DataFrame:
    """(clip, frame, n, distance) of each frame with samples to the one before it; null for the first.

    Histograms are combined before the shuffle; bins become 16 columns of one row for each frame, so
    the window sees frames, not samples.
    """
    h = histogram(samples, [*clip, frame], value)
    bins = [F.sum(F.when(F.col("bin") == b, F.col("n")).otherwise(0)).alias(f"b{b}") for b in range(HISTOGRAM_BINS)]
    wide = h.groupBy(*clip, frame).agg(F.sum("n").alias("n"), *bins)
    w = Window.partitionBy(*clip).orderBy(frame) if clip else Window.orderBy(frame)
    parts = [chi_square(F.col(f"b{b}").cast("double"), F.lag(f"b{b}").over(w).cast("double")) for b in range(HISTOGRAM_BINS)]
    total = sum(parts[1:], parts[0]) / F.col("n")
    return wide.select(*clip, frame, "n", F.when(F.lag("n").over(w).isNotNull(), total).alias("distance"))


def scene_cuts(samples: DataFrame, clip: list[str], frame: str, value: str, threshold: float = CUT) -> DataFrame:
    """``cut_distances`` with ``key``: the first frame, and each whose distance is above the threshold."""
    d = cut_distances(samples, clip, frame, value)
    return d.withColumn("key", F.col("distance").isNull() | (F.col("distance") > threshold))


def scene_cuts_gated(frames: DataFrame, clip: list[str], interval: int, threshold: float = CUT) -> DataFrame:
    """Key flags of frames (clip, idx, bins array) where only frames that come to the test leave their
    histogram behind: frame 0 and cadence keys do not, so the next one meets an older histogram or none.
    That histogram is the last one of a frame off the cadence: one window pass."""
    cadence = F.col("idx") % interval == 0
    w = Window.partitionBy(*clip).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    before = frames.withColumn("_last", F.last(F.when(~cadence, F.col("bins")), ignorenulls=True).over(w))
    total = F.aggregate("bins", F.lit(0).cast("bigint"), lambda a, v: a + v)
    far = F.aggregate(F.zip_with(F.col("bins").cast("array<double>"), F.col("_last").cast("array<double>"), chi_square), F.lit(0.0), lambda a, v: a + v)
    cut = F.col("_last").isNotNull() & (far / total > threshold)
    return before.select(*clip, F.col("idx").cast("bigint").alias("idx"), F.coalesce(cadence | cut, F.lit(False)).alias("key"))


def cadence_key(idx: Value, interval: Value = 30, forced: Column | None = None) -> Column:
    key = F.pmod(col(idx), col(interval)) == 0
    return key | forced if forced is not None else key


def static_blocks(pairs: DataFrame, keys: list[str], n: int = 8) -> DataFrame:
    """(keys, by, bx, sad, sse, static, exact) of paired samples (keys, r, c, a, b) of two frames."""
    d = F.col("a").cast("bigint") - F.col("b").cast("bigint")
    limit = STATIC_CTU if n == 64 else STATIC_BLOCK
    sums = pairs.groupBy(*keys, div("r", n).alias("by"), div("c", n).alias("bx")).agg(F.sum(F.abs(d)).alias("sad"), F.sum(d * d).alias("sse"))
    return sums.withColumns({"static": F.col("sad") <= limit, "exact": F.col("sse") == 0})


def entry_points(frames: DataFrame, clip: list[str], idx: str, size: Column, rows: Column) -> DataFrame:
    """``frames`` with ``entry``: whether the frame before had 256 bytes or more a row; on for the first."""
    w = Window.partitionBy(*clip).orderBy(idx)
    return frames.withColumn("entry", F.coalesce(F.lag(div(size, rows)).over(w) >= ENTRY_BYTES, F.lit(True)))


def band_energy(blocks: DataFrame, keys: list[str], band: Column, value: str) -> DataFrame:
    """(keys, band, energy, n): squared coefficients by frequency band."""
    v = F.col(value).cast("bigint")
    return blocks.groupBy(*keys, band.alias("band")).agg(F.sum(v * v).alias("energy"), F.count("*").alias("n"))
