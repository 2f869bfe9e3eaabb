"""Tables of measurements: rate-distortion points, results, and the corpus list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RD = "clip string, codec string, tag string, qp string, frames string, bytes string, bitrate_kbps string, psnr_y string, psnr_avg string, ssim string, enc_s string, dec_s string, enc_fps string, dec_fps string"
CORPUS = "id string, url string, fetch_bytes string, seek_s string, dur_s string, w string, h string, fps string, class string"


def rd_points(spark: SparkSession, path: str) -> DataFrame:
    """(clip, codec, qp, rate, psnr) of result files with a header line; the rate is ``avg_bitrate_kbps`` or
    ``bitrate_kbps``, else 8 bits of ``total_bytes`` or ``bytes`` over 1000. Rows without positive numbers go."""
    raw = spark.read.csv(path, header=True)
    number = lambda c: F.col(c).try_cast("double") if c in raw.columns else F.lit(None).cast("double")
    rate = F.coalesce(number("avg_bitrate_kbps"), number("bitrate_kbps"), number("total_bytes") * 8 / 1000, number("bytes") * 8 / 1000)
    out = raw.select("clip", "codec", F.col("qp").try_cast("int").alias("qp"), rate.alias("rate"), number("psnr_y").alias("psnr"))
    return out.where("rate > 0 AND psnr > 0")


def write_results(results: DataFrame, path: str) -> None:
    """Append results as CSV with a header; runs add files to the folder."""
    results.write.mode("append").csv(path, header=True)


def corpus(spark: SparkSession, path: str, only: list[str] | None = None) -> DataFrame:
    """The corpus list: tab-separated, comments, blank lines, its header and rows with fewer than nine fields left out."""
    lines = spark.read.text(path).where("value <> '' AND value NOT LIKE '#%'")
    f = F.split("value", "\t")
    names = [c.split(" ")[0] for c in CORPUS.split(", ")]
    t = lines.where(F.size(f) >= len(names)).select(*[F.get(f, F.lit(i)).alias(n) for i, n in enumerate(names)]).where("id <> 'id'")
    t = t.select("id", "url", F.col("fetch_bytes").try_cast("bigint").alias("fetch_bytes"), F.col("seek_s").try_cast("int").alias("seek_s"), F.col("dur_s").try_cast("double").alias("dur_s"), *[F.col(c).try_cast("int").alias(c) for c in ("w", "h", "fps")], "class")
    return t.where(F.col("id").isin(only)) if only else t
