"""Sweeps over quantizers, acceptance scans and meters."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import quant as Q
from ..functions.bits import last_nonzero


def sweep(blocks: DataFrame, keys: list[str], qps: tuple[int, ...], n: int = 8) -> DataFrame:
    """(keys, codec, qp, n, bits, sse) of blocks (keys, b) at every QP, by the newer quantizer ``own`` and the older one
    ``base``: each block is read once and measured at all of them, and sums are combined before the one shuffle."""
    points = F.explode(F.array(*[F.struct(F.lit(c).alias("codec"), F.lit(q).alias("qp")) for c in ("own", "base") for q in qps])).alias("x")
    own, qp = F.col("codec") == "own", F.col("qp")
    levels = F.when(own, Q.quantize(F.col("b"), qp, n)).otherwise(Q.quantize(F.col("b"), qp, n, band=0))
    back = F.when(own, Q.dequantize(F.col("q"), qp, n)).otherwise(Q.dequantize(F.col("q"), qp, n, band=0, legacy=True))
    each = blocks.select(*keys, "b", points).select(*keys, "b", "x.codec", "x.qp").withColumn("q", levels).withColumn("d", back)
    error = F.aggregate(F.zip_with("b", "d", lambda a, b: (a - b).cast("bigint") * (a - b)), F.lit(0).cast("bigint"), lambda s, v: s + v)
    bits = Q.level_bits(F.col("q"), last_nonzero(F.col("q")))
    sums = each.select(*keys, "codec", "qp", F.size("b").alias("size"), bits.cast("bigint").alias("bits"), error.alias("sse"))
    return sums.groupBy(*keys, "codec", "qp").agg(*[F.sum(a).cast("bigint").alias(b) for a, b in (("size", "n"), ("bits", "bits"), ("sse", "sse"))])


def lower_hull(points: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """``points`` with ``hull``: on the lower convex hull of their key, no chord of two others passes below or through them.
    A key has a handful of points, which meet each other."""
    one = lambda a: points.select(*keys, F.col(x).cast("double").alias(f"{a}x"), F.col(y).cast("double").alias(f"{a}y")).distinct()
    chord = points.select(*keys, x, y).distinct().join(one("_a"), keys).where(F.col("_ax") < F.col(x)).join(one("_b"), keys).where(F.col("_bx") > F.col(x))
    above = (F.col("_bx") - F.col("_ax")) * (F.col(y) - F.col("_ay")) >= (F.col(x) - F.col("_ax")) * (F.col("_by") - F.col("_ay"))
    under = chord.where(above).select(*keys, x, y).distinct().withColumn("_under", F.lit(True))
    return points.join(under, [*keys, x, y], "left").withColumn("hull", F.col("_under").isNull()).drop("_under")


def accepted(steps: DataFrame, keys: list[str], order: str, base_bytes: float, base_psnr: float) -> DataFrame:
    """``steps`` (keys, order, bytes, psnr) with ``keep``: at least half a percent smaller than the base, less than half a
    decibel worse; each step that is kept is the base of those after it. A key's steps are walked in order by one task, which
    keeps two numbers."""
    names = [*keys, order, "bytes", "psnr"]
    slim = steps.select(*keys, order, F.col("bytes").cast("double").alias("bytes"), F.col("psnr").cast("double").alias("psnr"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, base = None, (base_bytes, base_psnr)
        for b in batches:
            out = []
            own = list(zip(*(b.column(k).to_pylist() for k in range(len(keys))))) if keys else [()] * b.num_rows
            for name, size, psnr in zip(own, b.column("bytes").to_pylist(), b.column("psnr").to_pylist()):
                if name != now:
                    now, base = name, (base_bytes, base_psnr)
                out.append(size is not None and psnr is not None and size < base[0] * 0.995 and psnr - base[1] > -0.5)
                if out[-1]:
                    base = size, psnr
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.bool_())], [*names, "keep"])

    dealt = slim.repartition(*keys) if keys else slim.coalesce(1)
    return dealt.sortWithinPartitions(*keys, order).mapInArrow(run, f"{kinds}, keep boolean")


def metered(df: DataFrame, name: str, **meters: Column) -> tuple[DataFrame, Observation]:
    """``df`` with meters that are counted in the pass that reads it, without a job of their own."""
    seen = Observation(name)
    return df.observe(seen, *[m.alias(k) for k, m in meters.items()]), seen


def meter_rows(spark: SparkSession, seen: Observation) -> DataFrame:
    """(meter, value) once the metered table has been read; waits for that."""
    return spark.createDataFrame([(k, float(v) if v is not None else None) for k, v in seen.get.items()], "meter string, value double")
