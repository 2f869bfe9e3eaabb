"""What the query modules share: stand-in signals, and their SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QP = 30

#: 8x8 blocks of whole numbers from the embeddings, one row a sample.
CELLS = "cells AS (SELECT vec_id, label, unnest(range(64)) AS p, unnest(list_transform(embedding, lambda e: floor(e::DOUBLE * 512)::BIGINT)) AS v FROM embeddings)"
#: The same, as bytes around 128.
BYTES = CELLS + ", px AS (SELECT vec_id, label, p, p // 8 AS r, p % 8 AS c, least(greatest(v + 128, 0), 255) AS v FROM cells)"
#: One array a block.
ARRAYS = "blk AS (SELECT vec_id, label, list_transform(embedding, lambda e: floor(e::DOUBLE * 512)::BIGINT) AS b FROM embeddings)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, b): each embedding as an 8x8 block of whole numbers."""
    whole = F.transform("embedding", lambda e: F.floor(e.cast("double") * 512).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", whole.alias("b"))


def byte_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``blocks`` as bytes around 128."""
    return blocks(spark, sf_dir).withColumn("b", F.transform("b", lambda v: F.least(F.greatest(v + 128, F.lit(0)), F.lit(255))))


def spread(df: DataFrame, column: str = "b") -> DataFrame:
    """One row a sample: (vec_id, label, p, r, c, v)."""
    s = df.select("vec_id", "label", F.posexplode(column).alias("p", "v"))
    return s.select("vec_id", "label", "p", F.floor(F.col("p") / 8).cast("int").alias("r"), (F.col("p") % 8).alias("c"), "v")


def rows(df: DataFrame, column: str) -> DataFrame:
    """(vec_id, p, v) of an array column, as BIGINT."""
    return df.select("vec_id", F.posexplode(column).alias("p", "v")).select("vec_id", F.col("p").cast("bigint").alias("p"), F.col("v").cast("bigint").alias("v"))


def values(pairs) -> str:
    """A SQL VALUES list."""
    return "(VALUES " + ", ".join("(" + ", ".join(map(str, p)) + ")" for p in pairs) + ")"


def scratch(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which executors share; in local mode, where that is unset, one of
    our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="blockwave-")
    return f"{root if '://' in root else 'file://' + root}/files-{uuid.uuid4().hex}"
