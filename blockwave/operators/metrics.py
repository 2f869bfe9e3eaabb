"""Error metrics, histograms, and rate-distortion curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ints import div

PEAK = 255 * 255
C1, C2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
IDENTICAL = 100.0
HISTOGRAM_BINS = 16
SPLIT_VARIANCE = 512


def sse(a: Column, b: Column) -> Column:
    """Aggregate: exact sum of squared errors."""
    d = a.cast("bigint") - b.cast("bigint")
    return F.sum(d * d)


def sad(a: Column, b: Column) -> Column:
    """Aggregate: sum of absolute differences."""
    return F.sum(F.abs(a.cast("bigint") - b.cast("bigint")))


def psnr(sse_: Column, n: Column, identical: float = IDENTICAL) -> Column:
    """Decibels from a sum of squared errors over n samples; ``identical`` (100, or infinity) without error."""
    return F.when(sse_ == 0, float(identical)).otherwise(F.lit(10.0) * F.log10(F.lit(float(PEAK)) / (sse_ / n)))


def psnr_by(pairs: DataFrame, keys: list[str], a: str = "a", b: str = "b", identical: float = IDENTICAL) -> DataFrame:
    """(keys, n, sse, psnr) of paired samples: one combined aggregation."""
    sums = pairs.groupBy(*keys).agg(F.count("*").alias("n"), sse(F.col(a), F.col(b)).alias("sse"))
    return sums.withColumn("psnr", psnr(F.col("sse"), F.col("n"), identical))


def ssim_blocks(pixels: DataFrame, keys: list[str], size: int = 8) -> DataFrame:
    """(keys, by, bx, ssim) of whole size x size blocks of pixels (keys, r, c, a, b).

    Population variances and the sample covariance, without a window; 1 where the denominator is 0.
    """
    blocks = pixels.groupBy(*keys, div("r", size).alias("by"), div("c", size).alias("bx"))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    m = blocks.agg(F.count("*").alias("n"), F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.var_pop(a).alias("va"), F.var_pop(b).alias("vb"), F.covar_samp(a, b).alias("cov"))
    num = (F.col("ma") * F.col("mb") * 2 + C1) * (F.col("cov") * 2 + C2)
    den = (F.col("ma") * F.col("ma") + F.col("mb") * F.col("mb") + C1) * (F.col("va") + F.col("vb") + C2)
    value = F.when(den == 0, 1.0).otherwise(F.least(F.greatest(num / den, F.lit(0.0)), F.lit(1.0)))
    return m.where(F.col("n") == size * size).select(*keys, "by", "bx", value.alias("ssim"))


def ssim(pixels: DataFrame, keys: list[str], size: int = 8) -> DataFrame:
    """(keys, ssim): the mean over whole blocks."""
    return ssim_blocks(pixels, keys, size).groupBy(*keys).agg(F.avg("ssim").alias("ssim"))


def first_frame(pixels: DataFrame) -> DataFrame:
    """The pixels of frame 0 only, for metrics that are defined on it."""
    return pixels.where("frame_idx = 0")


def histogram(samples: DataFrame, keys: list[str], value: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """(keys, bin, n) of values 0 to 255, bins without values left out."""
    bin_ = F.least(div(F.col(value).cast("int") * bins, 256), F.lit(bins - 1)).cast("int")
    return samples.groupBy(*keys, bin_.alias("bin")).agg(F.count("*").alias("n"))


def integer_variance(total: Column, squares: Column, n: Column) -> Column:
    """Mean square less the square of the mean, both truncated."""
    mean = div(total, n)
    return div(squares, n) - mean * mean


def transform_size(samples: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, variance, size): transform 4 above the variance threshold, else 8."""
    v = F.col(value).cast("bigint")
    sums = samples.groupBy(*keys).agg(F.sum(v).alias("s"), F.sum(v * v).alias("q"), F.count("*").alias("n"))
    var = integer_variance(F.col("s"), F.col("q"), F.col("n"))
    return sums.select(*keys, var.alias("variance")).withColumn("size", F.when(F.col("variance") > SPLIT_VARIANCE, 4).otherwise(8))


def bitrate_kbps(size: Column, frames: Column, fps: Column) -> Column:
    return size * 8 / (frames / fps) / 1000


def best_and_median(runs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, best, median, n): the largest, and the upper median. The rank is found by a window over the
    key's sorted rows, so no key is collected into an array."""
    w = Window.partitionBy(*keys)
    ranked = runs.select(*keys, F.col(value).alias("v"), F.row_number().over(w.orderBy(value)).alias("k"), F.count("*").over(w).alias("n"))
    middle = F.max(F.when(F.col("k") == F.floor(F.col("n") / 2) + 1, F.col("v")))
    return ranked.groupBy(*keys).agg(F.max("v").alias("best"), middle.alias("median"), F.max("n").alias("n"))


def totals(frames: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, frames, bytes, psnr, ratio) of frames (keys, size, raw, psnr): sums and means of a run."""
    out = frames.groupBy(*keys).agg(F.count("*").alias("frames"), F.sum("size").alias("bytes"), F.avg("psnr").alias("psnr"), F.sum("raw").alias("raw"))
    return out.withColumn("ratio", F.col("raw") / F.col("bytes")).drop("raw")


def metric_log(lines: DataFrame, keys: list[str], name: str, expected: Column) -> DataFrame:
    """(keys, mean, frames, ok) of a metric in log lines (keys, line) as ``name:value``; inf counts as 100,
    and the count has to be the expected one with no value that is not a number."""
    text = F.regexp_extract("line", name + r":([-+]?(?:[0-9.]+|inf|nan))", 1)
    v = F.when(text == "inf", IDENTICAL).otherwise(text.try_cast("double"))
    found = lines.select(*keys, text.alias("t"), v.alias("v")).where("t <> ''")
    out = found.groupBy(*keys).agg(F.avg("v").alias("mean"), F.count("*").alias("frames"), F.sum(F.when(F.isnan("v") | F.col("v").isNull() | (F.col("t") == "-inf"), 1).otherwise(0)).alias("bad"))
    return out.select(*keys, "mean", "frames", ((F.col("bad") == 0) & (F.col("frames") == expected)).alias("ok"))


def quality_join(summary: DataFrame, reference: DataFrame, decoded: DataFrame) -> DataFrame:
    """Summary rows (codec, clip, qp) with the pixels of their reference clip and their decoded run."""
    ref = reference.select("clip", "frame_idx", "plane", "r", "c", F.col("v").alias("a"))
    dec = decoded.select("codec", "clip", "qp", "frame_idx", "plane", "r", "c", F.col("v").alias("b"))
    return summary.join(dec, ["codec", "clip", "qp"]).join(ref, ["clip", "frame_idx", "plane", "r", "c"])


def keep_scores(steps: DataFrame, keys: list[str], base_bytes: Column, base_psnr: Column) -> DataFrame:
    """Steps with ``keep``: at least half a percent smaller, and less than half a decibel worse."""
    return steps.withColumn("keep", (F.col("bytes") < base_bytes * 0.995) & (F.col("psnr") - base_psnr > -0.5))


def bd_rate(points: DataFrame, keys: list[str], reference: str) -> DataFrame:
    """(keys, codec, bd_rate) of points (keys, codec, rate, psnr) against the reference codec, in percent.

    The logarithm of the rate is piecewise linear in PSNR. Both curves are evaluated at all knots of
    either within the overlap, where trapezoids are exact. Null with fewer than two points or without
    an overlap. All steps are equi-joins and windows on (keys, codec); curves have a handful of points.
    """
    p = points.select(*keys, "codec", F.col("psnr").cast("double").alias("x"), F.ln("rate").alias("y"))
    w = Window.partitionBy(*keys, "codec").orderBy("x", "y")
    seg = p.select("*", F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1")).where("x1 > x")
    span = p.groupBy(*keys, "codec").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n"))
    ref = span.where(F.col("codec") == reference).select(*keys, F.col("low").alias("rl"), F.col("high").alias("rh"), F.col("n").alias("rn"))
    pair = span.where(F.col("codec") != reference).join(ref, keys)
    pair = pair.select(*keys, "codec", F.greatest("low", "rl").alias("a"), F.least("high", "rh").alias("b"), (F.least("n", "rn") >= 2).alias("enough"))
    own = p.where(F.col("codec") != reference).select(*keys, "codec", "x")
    others = p.where(F.col("codec") == reference).select(*keys, "x").join(pair.select(*keys, "codec"), keys).select(*keys, "codec", "x")
    ends = pair.select(*keys, "codec", F.explode(F.array("a", "b")).alias("x"))
    inside = own.unionByName(others).unionByName(ends).distinct().join(pair.where("enough AND b > a"), [*keys, "codec"])
    inside = inside.where("x BETWEEN a AND b").select(*keys, "codec", "x", "a", "b")

    def at(curve: DataFrame, name: str, on: list[str]) -> DataFrame:
        s = curve.select(*on, F.col("x").alias("p0"), F.col("y").alias("q0"), F.col("x1").alias("p1"), F.col("y1").alias("q1"))
        hit = inside.select(*keys, "codec", "x").join(s, on).where("x BETWEEN p0 AND p1")
        v = F.col("q0") + (F.col("q1") - F.col("q0")) * (F.col("x") - F.col("p0")) / (F.col("p1") - F.col("p0"))
        return hit.groupBy(*keys, "codec", "x").agg(F.min(v).alias(name))

    mine = at(seg.where(F.col("codec") != reference), "t", [*keys, "codec"])
    base = at(seg.where(F.col("codec") == reference).drop("codec"), "r", keys)
    knots = inside.join(mine, [*keys, "codec", "x"]).join(base, [*keys, "codec", "x"]).withColumn("d", F.col("t") - F.col("r"))
    kw = Window.partitionBy(*keys, "codec").orderBy("x")
    strips = knots.select(*keys, "codec", "a", "b", ((F.lead("x").over(kw) - F.col("x")) * (F.lead("d").over(kw) + F.col("d")) / 2).alias("area"))
    area = strips.groupBy(*keys, "codec").agg((F.sum("area") / F.max(F.col("b") - F.col("a"))).alias("mean"))
    out = pair.select(*keys, "codec").join(area, [*keys, "codec"], "left")
    return out.select(*keys, "codec", ((F.exp("mean") - 1) * 100).alias("bd_rate"))


def bd_overall(table: DataFrame, key: str) -> DataFrame:
    """The table by key, and a row OVERALL with each codec's mean: a rollup."""
    total = table.groupBy("codec").agg(F.avg("bd_rate").alias("bd_rate")).select(F.lit("OVERALL").alias(key), "codec", "bd_rate")
    return table.select(key, "codec", "bd_rate").unionByName(total)
