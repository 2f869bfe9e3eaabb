"""Tables in the folder all executors share, and connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_local: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset in local mode (tests), one of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="blockwave-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return "file://" + _local[0]


def shared_dir(spark: SparkSession) -> str:
    """The application's own folder for intermediate tables."""
    return f"{shared_root(spark)}/blockwave-{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Delete the application's intermediate tables, once the results that read them are written."""
    forget(spark, shared_dir(spark))


def write(df: DataFrame, tag: str) -> str:
    """Write ``df`` to a new folder of the shared directory; the path."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def keep(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet and read again: lineage is cut and a lost executor costs nothing."""
    return df.sparkSession.read.schema(df.schema).parquet(write(df, tag))


def drop(*tables: DataFrame) -> None:
    """Delete what ``keep`` has written of tables that are read no more."""
    for t in tables:
        for folder in {f.rpartition("/")[0] for f in t.inputFiles()}:
            forget(t.sparkSession, folder)


def exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def forget(spark: SparkSession, path: str) -> None:
    """Delete a folder."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the component's smallest node.

    Alternates the large-star and the small-star step (Kiveris et al., 2014): every round is a few
    aggregations and equi-joins over the edge table, which never grows, so no component meets in one
    task. Hot centres are split by AQE's skew join. Rounds end when the edges no longer change.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    path, seen = write(e, "edges"), None
    for _ in range(max_rounds):
        e = spark.read.schema("a long, b long").parquet(path)
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if now == seen or now[0] == 0:
            break
        seen = now
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = write(small.union(least).distinct(), "edges")
        forget(spark, path)
        path = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    e = spark.read.schema("a long, b long").parquet(path)
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select("b", "b").distinct())


BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's rows and bytes in an Arrow batch, so that neither many texts nor long ones make
    batches of tens of MB, in the JVM and in Python. Smaller settings of the caller stay."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).removesuffix("b")
    if not (now.isdigit() and int(now) <= BATCH_BYTES):
        spark.conf.set(name, f"{BATCH_BYTES}b")


def groups_of(batches: Iterator[pa.RecordBatch], by: int = 0) -> Iterator[list[np.ndarray]]:
    """The columns of batches of numbers that are sorted by column ``by``, cut only between its values."""
    held: list[list[np.ndarray]] = []  # pieces of columns that may still grow
    for b in batches:
        if not b.num_rows:
            continue
        new = [b.column(k).to_numpy() for k in range(b.num_columns)]
        if new[by][0] == new[by][-1] and (not held or held[-1][by][-1] == new[by][0]):
            held.append(new)
            continue
        cut = int(np.searchsorted(new[by], new[by][-1]))
        held.append([x[:cut] for x in new])
        yield [np.concatenate(x) for x in zip(*held)]
        held = [[x[cut:] for x in new]]
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def keep_rows(docs: DataFrame, good: Callable[[list[str | None]], list[bool]]) -> DataFrame:
    """The rows of ``docs`` whose text is good; all columns stay. Whole batches go through Python, so no row
    waits in the JVM for its answer."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(good(b.column(at).to_pylist()), pa.bool_()))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def with_texts(docs: DataFrame, change: Callable[[list[str | None]], list[str | None]]) -> DataFrame:
    """``docs`` with other texts; all other columns stay."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.set_column(at, "text", pa.array(change(b.column(at).to_pylist()), pa.string()))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def from_texts(docs: DataFrame, find: Callable[[list[str | None]], dict[str, list]], schema: str) -> DataFrame:
    """(doc_id, ...) with the columns that ``find`` gives for each batch of texts; ``schema`` lists them."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = find(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(found[n]) if found[n] else pa.array([], kinds[n]) for n in names]], ["doc_id", *names])

    kinds = {n: {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}[c.strip().split(" ")[1]] for n, c in zip(names, schema.split(","))}
    small_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, f"doc_id long, {schema}")


def one_of_each(docs: DataFrame, rows: DataFrame, roots: DataFrame) -> DataFrame:
    """One row of ``docs`` for each group: the one with the smallest doc_id, nulls last, then text hash.

    ``rows`` (doc_id, h, node) has the xxhash64 ``h`` of each row's text, ``roots`` (node, root) the
    groups of the nodes that have links. Choices are made for nodes first, so a hot node is no hot key.
    """
    best = rows.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("m"))
    best = best.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("group")).agg(F.min("m").alias("m"))
    stay = best.select(F.col("m.doc_id").alias("_stay"), F.col("m.h").alias("_hash"))
    hashed = docs.withColumn("_text", F.xxhash64(F.col("text").cast("string")))
    kept = hashed.join(stay, (F.col("_text") == F.col("_hash")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_stay")), "left_semi")
    nth = F.row_number().over(Window.partitionBy("doc_id", "_text").orderBy("text"))
    return kept.withColumn("_nth", nth).where("_nth = 1").drop("_nth", "_text")
