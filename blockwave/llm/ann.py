"""Nearest neighbours by multiprobe p-stable hashing.

A table hashes a vector x to the slots floor((a.x + b) / w) of some Gaussian directions a. A neighbour at
distance r differs from the query by N(0, r^2) along each of them, which gives the chance of each slot; the
product over the directions is a perturbed bucket's estimated success. Queries visit buckets in that order
until the successes add up to a share, which is fitted to a bounded number of queries that are compared with
all vectors, and the candidates of all tables are merged and ranked by their exact distances.

Buckets meet queries in blocks: a block of vectors is held, the queries of its bucket stream past it, and
only those candidates leave that can be among the nearest. A hot bucket is many blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import keep, small_batches

TABLES = 2
#: Vectors that a bucket has on average, at most.
BUCKET = 64
#: Vectors in a block.
CHUNK = 8192
#: Vectors that give the spread and each query's bound; those of them whose true neighbours, of all vectors, are searched first.
SAMPLE, TRIED = 4096, 256
#: The share of those neighbours that the buckets visited have to hold.
TARGET = 0.94
#: Hot buckets in a broadcast.
HOT = 100_000
_ODD, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(h: np.ndarray, slot: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (slot.astype(np.int64).astype(np.uint64) + _ODD)) * _STEP
    return h ^ (h >> np.uint64(29))


def _phi(z: np.ndarray) -> np.ndarray:
    """The normal distribution, to 2e-4 (a logistic curve); it only orders buckets."""
    return 1 / (1 + np.exp(-np.clip(1.5976 * z + 0.070566 * z**3, -40, 40)))


@dataclass
class Index:
    """What hashes vectors and finds the buckets of a query."""

    planes: list[np.ndarray]  # by table: dimensions x directions
    shifts: list[np.ndarray]
    width: float
    radius: float
    share: float
    ids: np.ndarray
    sample: np.ndarray
    near: int

    def _first(self, table: int, shape: tuple) -> np.ndarray:
        return np.full(shape, table + 1, np.uint64)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """The bucket of each vector in each table."""
        out = []
        for t, (a, b) in enumerate(zip(self.planes, self.shifts)):
            h = self._first(t, len(x))
            for slots in np.floor((x @ a + b) / self.width).T:
                h = _mix(h, slots)
            out.append(h.astype(np.int64))
        return np.stack(out, 1)

    def _best(self, x: np.ndarray, t: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``most`` likeliest buckets of each query, in order: their codes and logarithms of their success."""
        at = x @ self.planes[t] + self.shifts[t]
        reach = ceil(4 * self.radius / self.width) + 1
        h, odds = self._first(t, (len(x), 1)), np.zeros((len(x), 1))
        for p in at.T:
            slots = np.floor(p / self.width)[:, None] + np.arange(-reach, reach + 1)
            edge = (slots * self.width - p[:, None]) / max(self.radius, 1e-300)
            chance = np.maximum(_phi(edge + self.width / max(self.radius, 1e-300)) - _phi(edge), 1e-12)
            chance = np.log(chance / chance.sum(1, keepdims=True))
            # the best products have prefixes among the best ones, so no others need be carried on
            odds = (odds[:, :, None] + chance[:, None, :]).reshape(len(x), -1)
            keep_ = np.argpartition(-odds, most - 1, axis=1)[:, :most] if odds.shape[1] > most else np.broadcast_to(np.arange(odds.shape[1]), odds.shape)
            odds = np.take_along_axis(odds, keep_, 1)
            h = _mix(np.take_along_axis(h, keep_ // len(chance[0]), 1), np.take_along_axis(slots, keep_ % len(chance[0]), 1))
        order = np.argsort(-odds, axis=1, kind="stable")
        return np.take_along_axis(h, order, 1).astype(np.int64), np.take_along_axis(odds, order, 1)

    def probes(self, x: np.ndarray, t: int, share: float, most: int = 128) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the buckets of a table whose successes add up to ``share``, in order, and the sums so far."""
        out: list = [None] * len(x)
        left = np.arange(len(x))
        while len(left):
            after, step = [], max(1, (1 << 16) // most)
            for i in range(0, len(left), step):
                own = left[i : i + step]
                codes, odds = self._best(x[own], t, most)
                sums = np.cumsum(np.exp(odds), axis=1)
                for q, c, s in zip(own.tolist(), codes, sums):
                    if s[-1] >= share or len(c) < most:
                        n = int(np.searchsorted(s, share)) + 1
                        out[q] = c[:n], s[:n]
                    else:
                        after.append(q)
            left, most = np.array(after, int), most * 4
        return out

    def cells(self, x: np.ndarray) -> list[np.ndarray]:
        """The buckets that each query visits, of all tables."""
        by_table = [self.probes(x, t, self.share) for t in range(len(self.planes))]
        return [np.concatenate([p[k][0] for p in by_table]) for k in range(len(x))]

    def bounds(self, ids: np.ndarray, x: np.ndarray) -> np.ndarray:
        """What the farthest neighbour's distance can't exceed: as near lie vectors of the sample already."""
        out = np.full(len(x), np.inf)
        if len(np.unique(self.ids)) > self.near and len(np.unique(self.ids)) == len(self.ids):
            d = _squares(x, self.sample)
            d[ids[:, None] == self.ids] = np.inf
            out = np.sqrt(np.maximum(np.partition(d, self.near - 1, axis=1)[:, self.near - 1], 0))
        return out


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows, up to rounding."""
    return (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T


def fit(n: int, ids: np.ndarray, sample: np.ndarray, near: int, tried: list[tuple[np.ndarray, np.ndarray]], tables: int = TABLES, bucket: int = BUCKET, target: float = TARGET, seed: int = 12) -> Index:
    """An index for ``n`` vectors. Directions grow with log n, so that buckets keep their size; the width is twice
    the spread along a direction (about 1.5 bits); the radius and the share visited come from ``tried``: some queries, each
    with its true neighbours among all vectors."""
    rng, dims = np.random.default_rng(seed), sample.shape[1]
    k = min(dims, ceil(log2(n / bucket) / 1.5)) if n > bucket else 0
    planes = [np.linalg.qr(rng.normal(size=(dims, k)))[0] * np.sqrt(dims) for _ in range(tables)] if k else [np.zeros((dims, 0))]
    spread = float(np.median((sample @ planes[0]).std(0))) if k else 0.0
    width = 2 * spread if spread > 0 else 1.0
    shifts = [rng.uniform(0, width, p.shape[1]) for p in planes]
    index = Index(planes, shifts, width, 1.0, 1.0, ids, sample, near)
    tried = [(q, x) for q, x in tried if len(x)]
    if not k or not tried:
        return index
    queries = np.stack([q for q, _ in tried])
    index.radius = max(float(np.median(np.concatenate([np.sqrt(((x - q) ** 2).sum(1)) for q, x in tried]))), 1e-6 * width)
    least = [np.ones(len(x)) for _, x in tried]
    for t in range(len(planes)):
        for q, (own, sums) in enumerate(index.probes(queries, t, 0.995)):
            when = dict(zip(own.tolist(), sums.tolist()))
            least[q] = np.minimum(least[q], [when.get(c, 1.0) for c in index.codes(tried[q][1])[:, t].tolist()])
    index.share = min(0.995, float(np.quantile(np.concatenate(least), target, method="higher")) + 1e-9)
    return index


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """Lists of numbers as rows; shorter ones end with zeros."""
    n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(int)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (n == dims).all():
        return flat.reshape(len(n), dims)
    out = np.zeros((len(n), dims))
    out[np.arange(dims) < n[:, None]] = flat
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): rows with an id and a vector that isn't zero, of finite numbers; float vectors stay float."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    v = F.col("embedding") if kind in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    finite: Column = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # NaN is above infinity
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


#: 128 bits stand for a vector.
HASHES = ("h", "g")


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"h": F.xxhash64("v"), "g": F.xxhash64(F.reverse("v"))})


def few_copies(rows: DataFrame, near: int) -> DataFrame:
    """Of equal vectors those of the smallest near + 1 ids: no others can be among the nearest, as ties go to the smaller id."""
    nth = F.dense_rank().over(Window.partitionBy(*HASHES).orderBy("vec_id"))
    ranked = _hashed(rows).withColumn("nth", nth).where(F.col("nth") <= near + 1)
    # equal rows have one rank
    return ranked.dropDuplicates([*HASHES, "vec_id"]).select("vec_id", "v")


MATCHES = "query_id long, vec_id long, score double"


def matched(blocks: DataFrame, queries: DataFrame, dims: int, near: int) -> DataFrame:
    """``MATCHES``: for each query the candidates of each block that can be among its nearest.

    ``blocks`` (code, salt, vec_id, v) are the vectors of buckets, ``queries`` (code, salt, vec_id, bound, v)
    those that visit them. A task holds one block at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, held, whole = None, [], [], None
        for b in batches:
            code, salt, side, own, bound = (b.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            x = _matrix(b.column(5), dims)
            cut = np.flatnonzero((np.diff(code) != 0) | (np.diff(salt) != 0) | (np.diff(side) != 0)) + 1
            found: list[tuple] = []
            for i, j in zip([0, *cut], [*cut, len(code)]):
                if i == j:
                    continue
                if (key := (code[i], salt[i])) != now:
                    now, ids, held, whole = key, [], [], None
                if side[i] == 0:
                    ids.append(own[i:j])
                    held.append(x[i:j])
                    continue
                if not held:
                    continue
                if whole is None:
                    whole = np.concatenate(ids), np.concatenate(held)
                for s in range(i, j, 256):
                    e = min(j, s + 256)
                    d = _squares(x[s:e], whole[1])
                    slack = 1e-9 * (np.abs(x[s:e]).max() ** 2 + np.abs(whole[1]).max() ** 2) * dims
                    d[own[s:e, None] == whole[0]] = np.inf
                    most = bound[s:e] ** 2
                    if len(whole[0]) > near:
                        most = np.minimum(most, np.partition(d, near - 1, axis=1)[:, near - 1])
                    q, v = np.nonzero((d <= most[:, None] + slack) & (d < np.inf))
                    gap = x[s:e][q] - whole[1][v]
                    found.append((own[s:e][q], whole[0][v], np.sqrt((gap * gap).sum(1))))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["query_id", "vec_id", "score"])

    same = ["code", "salt", "side", "vec_id", "bound", "v"]
    rows = blocks.withColumns({"side": F.lit(0), "bound": F.lit(0.0)}).select(same).union(queries.withColumn("side", F.lit(1)).select(same))
    return rows.repartition("code", "salt").sortWithinPartitions("code", "salt", "side").mapInArrow(run, MATCHES)


def nearest_of(matches: DataFrame, near: int) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's nearest; a pair that several tables found counts once."""
    pairs = matches.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= near).select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, queries: Column, near: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``near`` nearest vectors of each row of ``vectors`` (vec_id, embedding) that
    ``queries`` holds for, by Euclidean distance, nearest first, ties to the smaller id.

    Every row is indexed; recall is below 1 (see the README). Rows without vec_id and vectors that are null,
    zero or hold null or non-finite numbers take no part; a shorter vector counts as one with zeros at its end. Repeated rows
    count once; where an id has several vectors, its nearest one counts. Other columns are not read. A query that finds fewer
    than ``near`` although there are more is searched again in all blocks.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = keep(few_copies(usable(vectors), near), "vectors")
    n, dims, ids = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.count_distinct("vec_id")).first()
    if ids < 2:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    some = rows.orderBy(F.xxhash64("vec_id", F.lit(12)), "vec_id", "v").limit(SAMPLE).collect()
    sample = _matrix(pa.array([r.v for r in some], pa.list_(pa.float64())), dims)
    parts = ceil(n / CHUNK)
    every = rows.select(F.lit(0).cast("long").alias("code"), "vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("salt"))

    def among_all(asking: DataFrame) -> DataFrame:
        """The nearest of all vectors, block by block."""
        sought = asking.select(F.lit(0).cast("long").alias("code"), "vec_id", F.lit(float("inf")).alias("bound"), "v", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("salt"))
        return nearest_of(matched(every, sought, dims, near), near)

    first = spark.createDataFrame([(r.vec_id, r.v) for r in some[:TRIED]], rows.schema)
    true = among_all(first).select("query_id", "vec_id").join(rows, "vec_id").select("query_id", "v").collect()
    tried = [(sample[k], _matrix(pa.array([t.v for t in true if t.query_id == r.vec_id], pa.list_(pa.float64())), dims)) for k, r in enumerate(some[:TRIED])]
    index = fit(n, np.array([r.vec_id for r in some], np.int64), sample, near, tried)
    sent = spark.sparkContext.broadcast(index)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = sent.value.codes(_matrix(b.column(1), dims))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1) * codes.shape[1], pa.int32()), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], ["vec_id", "v", "codes"])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), dims)
            cells = sent.value.cells(x)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, cells)]), pa.int32()), pa.array(np.concatenate([*cells, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sent.value.bounds(b.column(0).to_numpy(), x)), lists], ["vec_id", "v", "bound", "codes"])

    kind = f"vec_id long, v {rows.schema['v'].dataType.simpleString()}"
    buckets = rows.mapInArrow(coded, f"{kind}, codes array<long>")
    own = _hashed(usable(vectors.where(queries))).dropDuplicates(["vec_id", *HASHES]).select("vec_id", "v")
    asking = own.mapInArrow(asked, f"{kind}, bound double, codes array<long>")
    asking = keep(asking, "queries")
    each = lambda df, *more: df.select(F.explode("codes").alias("code"), "vec_id", *more, "v")
    sizes = buckets.select(F.explode("codes").alias("code")).groupBy("code").count().where(F.col("count") > CHUNK)
    hot = keep(sizes.select("code", F.ceil(F.col("count") / CHUNK).cast("int").alias("parts")), "hot-buckets")
    held, sought = each(buckets), each(asking, "bound")
    if many := hot.count():
        hot = F.broadcast(hot) if many <= HOT else hot
        held = held.join(hot, "code", "left").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
        sought = sought.join(hot, "code", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    else:
        held, sought = held.withColumn("salt", F.lit(0)), sought.withColumn("salt", F.lit(0))
    found = keep(nearest_of(matched(held, sought, dims, near), near), "nearest")
    short = keep(asking.select("vec_id", "v").join(found.where(F.col("rank") == min(near, ids - 1)), asking["vec_id"] == F.col("query_id"), "left_anti"), "short")
    if short.count():
        found = found.join(short.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(among_all(short))
    return found
