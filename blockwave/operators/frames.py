"""Work on frames that are tables of blocks (keys, by, bx, b): what a block needs of its neighbours is sent to it.

References for intra prediction take the edge rows and columns of neighbours, motion search the blocks within reach, in
tiles, so that a block goes to four tiles and not to every block around it. Split trees take sums by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ints import div

MISSING = 128
#: Displacements (x, y) of the search patterns, and how often each pattern is tried at most.
LARGE, SMALL = ((-2, -4), (2, -4), (-4, 0), (4, 0), (-2, 4), (2, 4)), ((-1, -2), (1, -2), (-2, 0), (2, 0), (-1, 2), (1, 2))
DIAMOND = ((0, -1), (-1, 0), (1, 0), (0, 1))
ROUNDS = ((LARGE, 2), (SMALL, 3), (DIAMOND, 4))


# ── references ──


def with_edges(blocks: DataFrame, keys: list[str], n: int) -> DataFrame:
    """``blocks`` with ``above``, ``above_right``, ``left``, ``below_left`` (arrays of n) and ``corner``: what the neighbours
    have next to the block, null where there is none. One shuffle, of each block once and of three rows and columns."""
    row, column = F.slice("b", n * n - n + 1, n), F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.element_at("b", i * n))
    none = F.lit(None).cast("array<int>")
    sent = (("own", 0, 0, F.col("b")), ("above", 1, 0, row), ("above_right", 1, -1, row), ("corner", 1, 1, F.slice(row, n, 1)), ("left", 0, 1, column), ("below_left", -1, 1, column))
    parts = F.array(*[F.struct(F.lit(side).alias("side"), (F.col("by") + y).cast("bigint").alias("y"), (F.col("bx") + x).cast("bigint").alias("x"), v.cast("array<int>").alias("v")) for side, y, x, v in sent])
    each = blocks.select(*keys, F.inline(parts))
    got = each.groupBy(*keys, F.col("y").alias("by"), F.col("x").alias("bx")).agg(*[F.max(F.when(F.col("side") == s, F.col("v")).otherwise(none)).alias(s) for s, *_ in sent])
    return got.where("own IS NOT NULL").withColumnRenamed("own", "b").withColumn("corner", F.get("corner", F.lit(0)))


def _repeat(side: Column, n: int) -> Column:
    return F.array_repeat(F.element_at(side, -1), n)


def references(n: int) -> tuple[Column, Column]:
    """Above and left references (2n + 1, the corner first) of ``with_edges`` with the further samples of the blocks
    beyond, where there are any; a missing side is 128."""
    flat = F.array_repeat(F.lit(MISSING), 2 * n)
    above = F.when(F.col("above").isNotNull(), F.concat("above", F.coalesce("above_right", _repeat(F.col("above"), n)))).otherwise(flat)
    left = F.when(F.col("left").isNotNull(), F.concat("left", F.coalesce("below_left", _repeat(F.col("left"), n)))).otherwise(flat)
    return F.concat(F.array(F.coalesce("corner", F.get(above, F.lit(0)))), above), F.concat(F.array(F.coalesce("corner", F.get(left, F.lit(0)))), left)


def near_references(n: int) -> tuple[Column, Column]:
    """The newer form: n samples of each side, the last one repeated; a missing side takes the nearest sample of the
    other."""
    first = lambda side: F.get(F.col(side), F.lit(0))
    above = F.coalesce("above", F.array_repeat(F.coalesce(first("left"), F.lit(MISSING)), n))
    left = F.coalesce("left", F.array_repeat(F.coalesce(first("above"), F.lit(MISSING)), n))
    corner = F.coalesce("corner", first("above"), first("left"), F.lit(MISSING))
    return F.concat(F.array(corner), above, _repeat(above, n)), F.concat(F.array(corner), left, _repeat(left, n))


# ── split trees ──


def split_trees(leaves: DataFrame, keys: list[str], price: int, depth: int = 3) -> DataFrame:
    """(keys, ty, tx, y, x, size, cost, total): the leaves of the cheapest tree of each tile of 2^depth x 2^depth blocks.

    ``leaves`` (keys, by, bx, n, s, q) has each block's samples, their sum and sum of squares. A leaf of any size costs its
    squared error around its mean, rounded up, and ``price``; four children that cost no more than their parent replace it.
    Where blocks are missing, at a frame's end, a parent has to split. ``y``, ``x`` and ``size`` count blocks, ``total``
    is the tile's cost. A tile is one row of the shuffle; all tiles of a batch are solved at once.
    """
    side = 1 << depth
    tile = (div("by", side).alias("ty"), div("bx", side).alias("tx"))
    each = leaves.select(*keys, *tile, F.struct((F.col("by") % side * side + F.col("bx") % side).cast("int").alias("p"), *[F.col(c).cast("bigint").alias(c) for c in ("n", "s", "q")]).alias("l"))
    tiles = each.groupBy(*keys, "ty", "tx").agg(F.collect_list("l").alias("l"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tiles.drop("l").schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("l")
            sums = np.zeros((3, b.num_rows, side * side), np.int64)
            at = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten().field("p").to_numpy()
            for k, name in enumerate("nsq"):
                sums[k][at] = lists.flatten().field(name).to_numpy()
            total, levels = _solve(sums.reshape(3, -1, side, side), price, depth)
            rows = [np.stack([t, y << d, x << d, np.full(len(t), 1 << d), cost[t, y, x]], 1) for d, (leaf, cost) in enumerate(levels) for t, y, x in [np.nonzero(leaf)]]
            found = np.concatenate(rows)
            same = b.drop_columns("l").take(pa.array(found[:, 0]))
            yield pa.RecordBatch.from_arrays([*same.columns, *map(pa.array, found[:, 1:].T.copy()), pa.array(total[found[:, 0]])], [*same.schema.names, "y", "x", "size", "cost", "total"])

    return tiles.mapInArrow(run, f"{kinds}, y bigint, x bigint, size bigint, cost bigint, total bigint")


def _solve(sums: np.ndarray, price: int, depth: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Each tile's cost, and by level which nodes are leaves of its tree and what these cost; sums (3, tiles, side, side)."""
    whole = sums[0] > 0
    costs, own, split = [], [], []
    for d in range(depth + 1):
        n, s, q = sums
        leaf = np.where(whole, q - s * s // np.maximum(n, 1) + price, 0)
        if d == 0:
            best, cut = leaf, ~whole
        else:
            four = costs[-1].reshape(*costs[-1].shape[:1], leaf.shape[1], 2, leaf.shape[2], 2).sum((2, 4))
            cut = ~whole | (four <= leaf)
            best = np.where(cut, four, leaf)
        costs.append(best)
        own.append(leaf)
        split.append(cut)
        two = (*sums.shape[:2], sums.shape[2] // 2, 2, sums.shape[3] // 2, 2)
        if d < depth:
            sums = sums.reshape(two).sum((3, 5))
            whole = whole.reshape(two[1:]).all((2, 4))
    levels, open_ = [], np.ones(split[-1].shape, bool)
    for d in reversed(range(depth + 1)):
        levels.append((open_ & ~split[d], own[d]))
        open_ = (open_ & split[d]).repeat(2, 1).repeat(2, 2)
    return costs[-1][:, 0, 0], levels[::-1]


# ── motion ──


def greedy(current: DataFrame, reference: DataFrame, keys: list[str], n: int, reach: int, tile: int = 8) -> DataFrame:
    """(keys, by, bx, sad, dy, dx, tried): a descent from each block's own place over whole samples, by a large and a small
    hexagon and a diamond, each repeated while it finds less; ``tried`` counts the points it looked at.

    A point that is less is gone to at once. Blocks outside the frame are no points. Both tables are blocks
    (keys, by, bx, b) of n x n samples; frames are whole.
    """
    scale = max(1, reach // 4)
    beyond = -(-(16 * scale + 16) // n)  # blocks that the descent can reach
    size = reference.groupBy(*keys).agg(((F.max("by") + 1) * n).alias("h"), ((F.max("bx") + 1) * n).alias("w"))  # a row for each frame
    one = lambda side: F.struct(F.lit(side).alias("side"), F.col("by").cast("int").alias("y"), F.col("bx").cast("int").alias("x"), F.col("b").cast("array<int>").alias("b")).alias("l")
    own = current.select(*keys, div("by", tile).alias("ty"), div("bx", tile).alias("tx"), one(0))
    around = lambda c: F.explode(F.sequence(div(F.greatest(F.col(c) - beyond, F.lit(0)), tile), div(F.col(c) + beyond, tile)))
    near = reference.withColumn("ty", around("by")).withColumn("tx", around("bx")).select(*keys, "ty", "tx", one(1))
    tiles = own.unionByName(near).groupBy(*keys, "ty", "tx").agg(F.collect_list("l").alias("l")).join(size, keys)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tiles.select(*keys).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for k, blocks, ty, tx, h, w in zip(range(b.num_rows), b.column("l"), *(b.column(c).to_pylist() for c in ("ty", "tx", "h", "w"))):
                v = blocks.values
                side, y, x = (v.field(c).to_numpy() for c in ("side", "y", "x"))
                samples = v.field("b").flatten().to_numpy().reshape(-1, n, n).astype(np.int64)
                mine = side == 0
                if not mine.any():
                    continue
                first = (ty * tile - beyond) * n, (tx * tile - beyond) * n
                area = np.zeros(((tile + 2 * beyond) * n,) * 2, np.int64)
                for i in np.flatnonzero(~mine):
                    r, c = y[i] * n - first[0], x[i] * n - first[1]
                    area[r : r + n, c : c + n] = samples[i]
                found = _descend(area, first, samples[mine], y[mine] * n, x[mine] * n, h, w, scale)
                at += [k] * len(found)
                rows.append(np.concatenate([np.stack([y[mine], x[mine]], 1), found], 1))
            out = np.concatenate([*rows, np.zeros((0, 6), np.int64)]).astype(np.int64)
            same = [b.column(c).take(pa.array(at, pa.int64())) for c in keys]
            yield pa.RecordBatch.from_arrays([*same, *map(pa.array, out.T.copy())], [*keys, "by", "bx", "sad", "dy", "dx", "tried"])

    return tiles.mapInArrow(run, f"{kinds}, by bigint, bx bigint, sad bigint, dy bigint, dx bigint, tried bigint")


def _descend(area: np.ndarray, first: tuple[int, int], blocks: np.ndarray, y0: np.ndarray, x0: np.ndarray, h: int, w: int, scale: int) -> np.ndarray:
    """(sad, dy, dx, tried) of all blocks of a tile, which walk side by side."""
    n = blocks.shape[1]
    i, j = np.arange(n)[:, None], np.arange(n)[None, :]

    def error(y: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.abs(area[(y - first[0])[:, None, None] + i, (x - first[1])[:, None, None] + j] - blocks).sum((1, 2))

    y, x = y0.astype(np.int64), x0.astype(np.int64)
    least, tried = error(y, x), np.ones(len(y), np.int64)
    for k, (points, times) in enumerate(ROUNDS):
        going = np.ones(len(y), bool)
        for _ in range(times):
            better = np.zeros(len(y), bool)
            for dx, dy in points:
                step = scale if k == 0 else 1
                ny, nx = y + dy * step, x + dx * step
                inside = going & (ny >= 0) & (nx >= 0) & (ny + n <= h) & (nx + n <= w)
                sad = np.where(inside, error(np.where(inside, ny, y), np.where(inside, nx, x)), least)
                tried += inside
                less = sad < least
                y, x, least = np.where(less, ny, y), np.where(less, nx, x), np.where(less, sad, least)
                better |= less
            going = better
    return np.stack([least, y - y0, x - x0, tried], 1)
