"""Deblocking and band offsets over pixel tables, and the quadtree split over leaf costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.filters import MOST, band, band_offset, chroma_edge, edge
from ..functions.ints import Value, clip8, div

CTU, EDGE = 64, 4


def _pass(pixels: DataFrame, keys: list[str], along: str, qp: Value) -> DataFrame:
    """Edges every 4 samples but on CTU borders. An edge reads two samples and writes one on each side, so
    edges of one direction do not touch each other."""
    other = "r" if along == "c" else "c"
    w = Window.partitionBy(*keys, other).orderBy(along)
    at = F.col(along) % EDGE
    before, after = F.lag("v", 1).over(w), F.lead("v", 1).over(w)
    before2, after2 = F.lag("v", 2).over(w), F.lead("v", 2).over(w)
    after_border = ((F.col(along) + 1) % CTU) == 0
    low, _ = edge(before, F.col("v"), after, after2, qp)
    _, high = edge(before2, before, F.col("v"), after, qp)
    v = F.when((at == EDGE - 1) & ~after_border & after2.isNotNull(), low).when((at == 0) & (F.col(along) % CTU != 0) & after.isNotNull(), high).otherwise(F.col("v"))
    return pixels.withColumn("v", v.cast("int"))


def deblock_luma(pixels: DataFrame, keys: list[str], qp: Value) -> DataFrame:
    """Vertical edges, then horizontal ones, of luma pixels (keys, r, c, v)."""
    return _pass(_pass(pixels, keys, "c", qp), keys, "r", qp)


def deblock_chroma(pixels: DataFrame, keys: list[str], qp: Value) -> DataFrame:
    """Chroma pixels (keys, r, c, cb, cr): vertical edges change cb only; horizontal edges pair the row of the
    edge with the next one, and both planes follow the strength of cr. CTU borders stay."""
    half = CTU // 2
    w = Window.partitionBy(*keys, "r").orderBy("c")
    low, _ = chroma_edge(F.col("cb"), F.lead("cb").over(w), qp)
    _, high = chroma_edge(F.lag("cb").over(w), F.col("cb"), qp)
    c = F.col("c")
    is_low = (c % 4 == 3) & ((c + 1) % half != 0) & F.lead("cb").over(w).isNotNull()
    cb = F.when(is_low, low).when((c % 4 == 0) & (c % half != 0), high).otherwise(F.col("cb"))
    p = pixels.withColumn("cb", cb.cast("int"))
    w = Window.partitionBy(*keys, "c").orderBy("r")
    r = F.col("r")
    on_edge = (r % 4 == 0) & (r % half != 0) & F.lead("cr").over(w).isNotNull()
    below = (r % 4 == 1) & ((r - 1) % half != 0)
    out = {}
    for name in ("cb", "cr"):
        low, _ = chroma_edge(F.col(name), F.lead(name).over(w), qp, (F.col("cr"), F.lead("cr").over(w)))
        _, high = chroma_edge(F.lag(name).over(w), F.col(name), qp, (F.lag("cr").over(w), F.col("cr")))
        out[name] = F.when(on_edge, low).when(below, high).otherwise(F.col(name)).cast("int")
    return p.withColumns(out)


def choose_offset(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, band, offset, sse, base): for each key of samples (keys, a original, b rebuilt) the band and the
    offset with the least error, strictly below that without; null band where there is none.

    Clipping matters only for bands at the ends, so errors come from sums by band and value of b: at
    most 256 rows for a key after combining.
    """
    d = F.col("a").cast("bigint") - F.col("b")
    by_value = pairs.groupBy(*keys, F.col("b").cast("int").alias("b")).agg(F.count("*").alias("n"), F.sum(d).alias("s"), F.sum(d * d).alias("q")).withColumn("band", band(F.col("b")))
    sums = by_value.groupBy(*keys, "band").agg(F.sum("s").alias("bs"), F.sum("n").alias("bn"))
    half = div("bn", 2)
    mean = div(F.col("bs") + F.when(F.col("bs") >= 0, half).otherwise(-half), F.col("bn"))
    offset = F.least(F.greatest(mean, F.lit(-MOST)), F.lit(MOST))
    tried = sums.select(*keys, "band", offset.alias("offset"))
    moved = clip8(F.col("b") + F.col("offset")) - F.col("b")
    gain = by_value.join(tried, [*keys, "band"]).groupBy(*keys, "band", "offset").agg(F.sum(moved * moved * F.col("n") - moved * F.col("s") * 2).alias("change"), F.sum("q").alias("q"))
    best = gain.groupBy(*keys).agg(F.sum("q").alias("base"), F.min(F.when((F.col("change") < 0) & (F.col("offset") != 0), F.struct("change", "band", "offset"))).alias("m"))
    return best.select(*keys, F.col("m.band").alias("band"), F.col("m.offset").alias("offset"), (F.col("base") + F.coalesce("m.change", F.lit(0))).alias("sse"), "base")


def apply_offset(pixels: DataFrame, choices: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels (keys, v) with their key's band offset applied."""
    j = pixels.join(choices.select(*keys, "band", "offset"), keys, "left")
    v = F.when(F.col("band").isNotNull(), band_offset(F.col("v"), F.col("band"), F.col("offset"))).otherwise(F.col("v"))
    return j.withColumn("v", v.cast("int")).drop("band", "offset")


def split_blocks(leaves: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, y, x, cost, split) of blocks one level up from leaf costs (keys, y, x, cost, own): ``own`` is the
    parent's cost as one leaf, equal in its four children. Split where the children cost no more."""
    g = leaves.groupBy(*keys, div("y", 2).alias("y"), div("x", 2).alias("x"))
    s = g.agg(F.sum("cost").alias("children"), F.max("own").alias("own"))
    return s.select(*keys, "y", "x", F.least("children", "own").alias("cost"), (F.col("children") <= F.col("own")).alias("split"))
