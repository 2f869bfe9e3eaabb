"""Motion: block matching, sub-sample interpolation and compensation over pixel tables.

Pixels are rows (keys, r, c, v). Searches are exhaustive, so their error is never above that of a greedy
search over the same range, and the displacement may be another one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ints import Value, clip8, col, div, shr

#: The half-sample filter, in 1/32.
TAPS = (1, -5, 20, 20, -5, 1)
#: The points (x, y) around a whole-sample vector, in quarter samples, in the order of trial.
AROUND = ((1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (-1, 1), (1, -1), (-1, -1))

REGION = 64  # side, about, of the parts of frames that are searched at once
CHUNK = 16  # regions in work at once
_FAR = 1 << 40


def _regions(side: int, keys: list[str], own: DataFrame, reference: DataFrame, reach: int, blocks: DataFrame | None = None) -> DataFrame:
    """(keys, ry, rx, own, ref): the samples of the regions of ``side`` x ``side`` samples that frames are cut into, and those
    of the reference up to ``reach`` around, each as its place in the window and its value in one number. Samples are
    grouped once, a reference sample in the ((side + 2 * reach) / side) ** 2 regions that it is near to. ``blocks``
    (keys, ry, rx, m) are gathered with them."""
    packed = lambda place: F.shiftleft(place.cast("long"), 32).bitwiseOR(F.col("v").cast("int").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    no, wide = F.lit(None), side + 2 * reach
    span = lambda x: F.explode(F.sequence(F.greatest(F.floor((F.col(x) - reach) / side), F.lit(0)), F.floor((F.col(x) + reach) / side)))
    at = [*keys, "ry", "rx"]
    mine = own.select(*keys, div("r", side).alias("ry"), div("c", side).alias("rx"), packed((F.col("r") % side) * side + F.col("c") % side).alias("own"), no.cast("long").alias("ref"))
    near = reference.select(*keys, "r", "c", "v", span("r").alias("ry")).select("*", span("c").alias("rx"))
    near = near.select(*at, no.cast("long").alias("own"), packed((F.col("r") - F.col("ry") * side + reach) * wide + F.col("c") - F.col("rx") * side + reach).alias("ref"))
    both, lists = mine.unionByName(near), ["own", "ref"]
    if blocks is not None:
        both, lists = both.unionByName(blocks, allowMissingColumns=True), ["own", "ref", "m"]
    return both.groupBy(*at).agg(*[F.collect_list(c).alias(c) for c in lists]).where(F.size("own") > 0)


def _filled(samples: pa.ListArray, side: int, empty: int) -> np.ndarray:
    """(rows, side, side) of the samples at their places, ``empty`` where there is none."""
    out = np.full((len(samples), side * side), empty, np.int64)
    row = np.repeat(np.arange(len(samples)), np.diff(samples.offsets.to_numpy()))
    x = samples.flatten().to_numpy()
    out[row, x >> 32] = x.astype(np.int32)
    return out.reshape(-1, side, side)


def _used(own: np.ndarray, n: int) -> tuple[int, int]:
    """Rows and columns of the regions that hold samples, in whole blocks."""
    has = (own != _FAR).any(axis=0)
    return tuple(-(-(int(np.flatnonzero(has.any(axis=a)).max(initial=-1)) + 1) // n) * n for a in (1, 0))


def _kinds(df: DataFrame, names: list[str]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*names).schema.fields)


def search(current: DataFrame, reference: DataFrame, keys: list[str], n: int, reach: int, step: int = 1) -> DataFrame:
    """(keys, by, bx, sad, dy, dx): for each n x n block the displacement with the least error, of equals the
    smallest (dy, dx). Displacements that leave the frame do not count, nor do blocks that are not whole.

    The blocks of a region and what they may reach of the reference meet in one row; errors are summed over Arrow batches.
    """
    many = max(1, REGION // n)
    side, k = many * n, len(keys)
    both = _regions(side, keys, current, reference, reach)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, CHUNK):
                part = b.slice(i, CHUNK)
                own, ref = _filled(part.column(k + 2), side, _FAR), _filled(part.column(k + 3), side + 2 * reach, -_FAR)
                h, w = _used(own, n)
                best = _least(own[:, :h, :w], ref[:, : h + 2 * reach, : w + 2 * reach], n, reach, step)
                at, y, x = np.nonzero(best[..., 0] < _FAR)
                found, row = best[at, y, x], pa.array(at)
                place = [pa.array(part.column(k + j).to_numpy()[at] * many + v) for j, v in ((0, y), (1, x))]
                rows = [*(part.column(j).take(row) for j in range(k)), *place, pa.array(found[:, 0]), *(pa.array(found[:, j].astype(np.int32)) for j in (1, 2))]
                yield pa.RecordBatch.from_arrays(rows, [*keys, "by", "bx", "sad", "dy", "dx"])

    return both.mapInArrow(run, _kinds(both, keys) + "by bigint, bx bigint, sad bigint, dy int, dx int")


def _least(own: np.ndarray, ref: np.ndarray, n: int, reach: int, step: int) -> np.ndarray:
    """(regions, blocks down, blocks across, 3): sad, dy and dx of the least error of each block."""
    _, h, w = own.shape
    best = np.full((len(own), h // n, w // n, 3), _FAR, np.int64)
    for y in range(0, 2 * reach + 1, step):
        for x in range(0, 2 * reach + 1, step):
            sad = np.abs(ref[:, y : y + h, x : x + w] - own).reshape(-1, h // n, n, w // n, n).sum(axis=(2, 4))
            less = sad < best[..., 0]
            best[less] = np.stack([sad[less], np.full(less.sum(), y - reach), np.full(less.sum(), x - reach)], axis=1)
    return best


def global_motion(current: DataFrame, reference: DataFrame, keys: list[str], reach: int = 8, every: int = 4, outside: int = 1020) -> DataFrame:
    """(keys, sad, dy, dx) of whole frames on every fourth sample each way; samples that leave the frame cost
    ``outside``. Every displacement is tried, over the samples of a region at once; a region gives a row for each."""
    side, k, across = every * max(1, REGION // every), len(keys), 2 * reach + 1
    few = current.where((F.col("r") % every == 0) & (F.col("c") % every == 0))
    both = _regions(side, keys, few, reference, reach)
    dy, dx = (x.ravel() - reach for x in np.indices((across, across), np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, CHUNK):
                part = b.slice(i, CHUNK)
                own = _filled(part.column(k + 2), side, _FAR)
                h, w = _used(own, every)
                own = own[:, :h:every, :w:every]
                ref = _filled(part.column(k + 3), side + 2 * reach, _FAR)
                sad = np.empty((len(own), across * across), np.int64)
                for j, (y, x) in enumerate(zip(dy + reach, dx + reach)):
                    there = ref[:, y : y + h : every, x : x + w : every]
                    cost = np.where(there == _FAR, outside, np.abs(own - there))
                    sad[:, j] = np.where(own == _FAR, 0, cost).sum(axis=(1, 2))
                row = pa.array(np.repeat(np.arange(len(own)), across * across))
                moves = (pa.array(np.tile(v, len(own)).astype(np.int32)) for v in (dy, dx))
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(row) for c in range(k)), *moves, pa.array(sad.ravel())], [*keys, "dy", "dx", "sad"])

    cost = both.mapInArrow(run, _kinds(both, keys) + "dy int, dx int, sad bigint").groupBy(*keys, "dy", "dx").agg(F.sum("sad").alias("sad"))
    best = cost.groupBy(*keys).agg(F.min(F.struct("sad", F.abs("dy").alias("ay"), F.abs("dx").alias("ax"), "dy", "dx")).alias("m"))
    return best.select(*keys, "m.sad", "m.dy", "m.dx")


def six_tap(pixels: DataFrame, keys: list[str], along: str) -> DataFrame:
    """Pixels with ``half``: the value half a sample further along rows (``c``) or columns (``r``); where the
    filter leaves the frame the mean of the two neighbours, at the end the sample itself."""
    other = "r" if along == "c" else "c"
    w = Window.partitionBy(*keys, other).orderBy(along)
    near = [F.lag("v", 2).over(w), F.lag("v", 1).over(w), F.col("v"), F.lead("v", 1).over(w), F.lead("v", 2).over(w), F.lead("v", 3).over(w)]
    full = clip8(shr(sum((v * t for v, t in zip(near[1:], TAPS[1:])), near[0] * TAPS[0]) + 16, 5))
    return pixels.withColumn("half", F.coalesce(full, shr(F.col("v") + near[3] + 1, 1), F.col("v")).cast("int"))


def anchors(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels with what every quarter-sample position to their right and below is made of: the samples ``a10``,
    ``a01`` and ``a11`` of the cell, the half samples ``b`` and ``e`` along its upper and lower row, ``c2`` and
    ``f`` along its left and right column, and ``d`` at its centre. Null where a filter leaves the frame; half
    samples are not clipped. Two window passes, one along rows and one along columns."""
    across, down = (Window.partitionBy(*keys, o).orderBy(a) for o, a in (("r", "c"), ("c", "r")))

    def six(name: str, w) -> Column:
        near = [F.lag(name, 2).over(w), F.lag(name, 1).over(w), F.col(name), F.lead(name, 1).over(w), F.lead(name, 2).over(w), F.lead(name, 3).over(w)]
        return shr(sum((v * t for v, t in zip(near[1:], TAPS[1:])), near[0] * TAPS[0]) + 16, 5).cast("int")

    rows = pixels.withColumns({"b": six("v", across), "a10": F.lead("v").over(across)})
    both = rows.withColumns({"c2": six("v", down), "d": six("b", down), "a01": F.lead("v").over(down), "a11": F.lead("a10").over(down), "e": F.lead("b").over(down)})
    return both.withColumn("f", F.lead("c2").over(across))


def at_quarter(dx: Value, dy: Value, bilinear: bool = False) -> Column:
    """The sample of a cell of ``anchors`` at quarters (dx, dy): half samples by the six taps, quarters the mean of
    their neighbours; where the taps leave the frame, or for ``bilinear``, weights by quarters; null where the cell
    itself leaves it."""
    x, y = col(dx), col(dy)
    mean = lambda p, q: shr(p + q + 1, 1)
    along = lambda k, p, half, q: F.when(k == 0, p).when(k == 1, mean(p, half)).when(k == 2, half).otherwise(mean(half, q))
    top, mid, bottom = (along(x, F.col(p), F.col(h), F.col(q)) for p, h, q in (("v", "b", "a10"), ("c2", "d", "f"), ("a01", "e", "a11")))
    plain = quarter(quarter(F.col("v"), F.col("a10"), x), quarter(F.col("a01"), F.col("a11"), x), y)
    if bilinear:
        return plain.cast("int")
    sharp = clip8(along(y, top, mid, bottom))
    return F.when(F.col("b").isNotNull() & F.col("c2").isNotNull(), sharp).otherwise(plain).cast("int")


def quarter(a: Column, b: Column, frac: Value) -> Column:
    """Between two samples at frac quarters."""
    f = col(frac)
    return clip8(div(a * (F.lit(4) - f) + b * f + 2, 4))


def compensate(blocks: DataFrame, reference: DataFrame, keys: list[str], n: int) -> DataFrame:
    """(keys, by, bx, r, c, pred) of blocks (keys, by, bx, dy, dx) moved by whole samples over the reference;
    places outside the frame take its nearest border sample."""
    size = reference.groupBy(*keys).agg(F.max("r").alias("_h"), F.max("c").alias("_w"))  # one row a key
    cell = F.explode(F.sequence(F.lit(0), F.lit(n * n - 1))).alias("_p")
    b = (blocks.join(size, keys) if keys else blocks.crossJoin(size)).select(*keys, "by", "bx", "dy", "dx", "_h", "_w", cell)
    r, c = F.col("by") * n + div("_p", n), F.col("bx") * n + F.col("_p") % n
    at = b.select(*keys, "by", "bx", r.alias("r0"), c.alias("c0"), F.least(F.greatest(r + F.col("dy"), F.lit(0)), F.col("_h")).alias("r"), F.least(F.greatest(c + F.col("dx"), F.lit(0)), F.col("_w")).alias("c"))
    hit = at.join(reference.select(*keys, "r", "c", F.col("v").alias("pred")), [*keys, "r", "c"])
    return hit.select(*keys, "by", "bx", F.col("r0").alias("r"), F.col("c0").alias("c"), "pred")


def _cells(blocks: DataFrame, keys: list[str], n: int, size: DataFrame) -> DataFrame:
    """A row for each sample of each block, with its place (r0, c0) and the frame's size."""
    cell = F.explode(F.sequence(F.lit(0), F.lit(n * n - 1))).alias("_p")
    b = (blocks.join(size, keys) if keys else blocks.crossJoin(size)).select("*", cell)
    return b.withColumns({"r0": F.col("by") * n + div("_p", n), "c0": F.col("bx") * n + F.col("_p") % n}).drop("_p")


def _size(frame: DataFrame, keys: list[str]) -> DataFrame:
    return frame.groupBy(*keys).agg(F.max("r").alias("_h"), F.max("c").alias("_w"))  # one row a key


def compensate_quarters(blocks: DataFrame, reference: DataFrame, keys: list[str], n: int) -> DataFrame:
    """(keys, by, bx, r, c, pred) of blocks (keys, by, bx, qy, qx) moved by quarter samples over the reference.
    A cell that leaves the frame takes the frame's nearest sample."""
    p = _cells(blocks, keys, n, _size(reference, keys))
    p = p.withColumns({"fy": F.col("r0") + shr("qy", 2), "fx": F.col("c0") + shr("qx", 2), "dy": F.col("qy").bitwiseAND(F.lit(3)), "dx": F.col("qx").bitwiseAND(F.lit(3))})
    inside = (F.col("fx") >= 0) & (F.col("fy") >= 0) & (F.col("fx") < F.col("_w")) & (F.col("fy") < F.col("_h"))
    near = lambda at, d, most: F.least(F.greatest(F.col(at) + (F.col(d) >= 2).cast("int"), F.lit(0)), F.col(most))
    p = p.withColumns({"inside": inside, "r": F.when(inside, F.col("fy")).otherwise(near("fy", "dy", "_h")), "c": F.when(inside, F.col("fx")).otherwise(near("fx", "dx", "_w"))})
    hit = p.join(anchors(reference.select(*keys, "r", "c", "v"), keys), [*keys, "r", "c"])
    value = F.when(F.col("inside"), at_quarter(F.col("dx"), F.col("dy"))).otherwise(F.col("v"))
    return hit.select(*keys, "by", "bx", F.col("r0").alias("r"), F.col("c0").alias("c"), value.alias("pred"))


def refine(best: DataFrame, current: DataFrame, reference: DataFrame, keys: list[str], n: int, reach: int | None = None) -> DataFrame:
    """(keys, by, bx, sad, qy, qx): the vectors of ``search`` (keys, by, bx, sad, dy, dx) and the eight quarter
    samples around each; the least error, the vector itself and then the earlier point first of equals. Errors are
    by the six taps, or bilinear where these leave the frame for a sample of the block; points whose block leaves
    the frame do not count. ``reach`` is the most that a vector has either way, looked up if it is not given."""
    if reach is None:
        reach = best.agg(F.max(F.greatest(F.abs("dy"), F.abs("dx")))).first()[0] or 0
    side, k, margin = n * max(1, REGION // n), len(keys), reach + 3
    place = [div(c, side // n).alias(r) for c, r in (("by", "ry"), ("bx", "rx"))]
    vectors = best.select(*keys, *place, F.struct(*[F.col(c).cast("long").alias(c) for c in ("by", "bx", "sad", "dy", "dx")]).alias("m"))
    both = _regions(side, keys, current, reference, margin, vectors).where(F.size("m") > 0)
    size = _size(reference, keys)
    both = (both.join(size, keys) if keys else both.crossJoin(size)).select(*keys, "own", "ref", "m", F.col("_h").cast("long").alias("_h"), F.col("_w").cast("long").alias("_w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, CHUNK):
                part = b.slice(i, CHUNK)
                own, ref = _filled(part.column(k), side, _FAR), _filled(part.column(k + 1), side + 2 * margin, 0)
                m = part.column(k + 2)
                row = np.repeat(np.arange(part.num_rows), np.diff(m.offsets.to_numpy()))
                by, bx, sad, dy, dx = (m.flatten().field(j).to_numpy() for j in range(5))
                y, x = by * n % side, bx * n % side
                cut = lambda a, top, left, rows: a[row[:, None, None], top[:, None, None] + np.arange(rows)[:, None], left[:, None, None] + np.arange(rows)]
                blocks, window = cut(own, y, x, n), cut(ref, y + dy + margin - 3, x + dx + margin - 3, n + 6)
                h, w = (part.column(k + j).to_numpy()[row] for j in (3, 4))
                found = _refined(blocks, window, n, by * n + dy, bx * n + dx, h, w, sad)
                own_keys = [part.column(j).take(pa.array(row)) for j in range(k)]
                q = [pa.array((4 * v + found[:, j]).astype(np.int32)) for j, v in ((1, dy), (2, dx))]
                yield pa.RecordBatch.from_arrays([*own_keys, pa.array(by), pa.array(bx), pa.array(found[:, 0]), *q], [*keys, "by", "bx", "sad", "qy", "qx"])

    return both.mapInArrow(run, _kinds(both, keys) + "by bigint, bx bigint, sad bigint, qy int, qx int")


def _refined(own: np.ndarray, near: np.ndarray, n: int, top: np.ndarray, left: np.ndarray, h: np.ndarray, w: np.ndarray, sad: np.ndarray) -> np.ndarray:
    """(sad, y, x) of the best of the vector itself, whose error is ``sad``, and the points AROUND it, for blocks ``own`` whose
    vectors lead to (top, left) of a frame with last row h and column w; ``near`` begins three samples before that.

    The arrays are those of ``anchors``, of cells from one before the block."""
    six = lambda a: (sum(t * a[..., j : a.shape[-1] - 5 + j] for j, t in enumerate(TAPS)) + 16) >> 5
    down = lambda a: six(a.swapaxes(1, 2)).swapaxes(1, 2)
    b, c2 = six(near), down(near)
    d = down(b)
    mean, least = lambda p, q: (p + q + 1) >> 1, np.stack([sad, np.zeros_like(sad), np.zeros_like(sad)], axis=1)
    along = lambda f, p, half, q: (p, mean(p, half), half, mean(half, q))[f]
    flat = lambda p, q, f: np.clip((p * (4 - f) + q * f + 2) // 4, 0, 255)
    for x, y in AROUND:
        oy, ox = y >> 2, x >> 2
        cells = lambda a, i, j: a[:, i : i + n, j : j + n]
        v, a10, a01, a11 = (cells(near, 3 + oy + i, 3 + ox + j) for i, j in ((0, 0), (0, 1), (1, 0), (1, 1)))
        upper, lower = (cells(b, 3 + oy + i, 1 + ox) for i in (0, 1))
        first, second = (cells(c2, 1 + oy, 3 + ox + j) for j in (0, 1))
        fx, fy = x & 3, y & 3
        sharp = along(fy, along(fx, v, upper, a10), along(fx, first, cells(d, 1 + oy, 1 + ox), second), along(fx, a01, lower, a11))
        plain = flat(flat(v, a10, fx), flat(a01, a11, fx), fy)
        t, s = top + oy, left + ox
        may = (s >= 0) & (t >= 0) & (s + n <= w) & (t + n <= h)
        safe = (s >= 2) & (t >= 2) & (s + n + 1 < w) & (t + n + 1 < h)
        error = np.abs(own - np.where(safe[:, None, None], np.clip(sharp, 0, 255), plain)).sum(axis=(1, 2))
        less = may & (error < least[:, 0])
        least[less] = np.stack([error[less], np.full(less.sum(), y), np.full(less.sum(), x)], axis=1)
    return least


def compensate_chroma(blocks: DataFrame, reference: DataFrame, keys: list[str], n: int) -> DataFrame:
    """(keys, by, bx, r, c, pred) of chroma blocks of n samples moved by luma vectors (qy, qx) in quarter samples,
    which are eighths of chroma samples; all four corners are clamped to the frame."""
    p = _cells(blocks, keys, n, _size(reference, keys))
    corner = lambda at, v, k, most: F.least(F.greatest(F.col(at) + shr(v, 3) + k, F.lit(0)), F.col(most))
    places = [F.struct(F.lit(2 * i + j).alias("_k"), corner("r0", "qy", i, "_h").alias("r"), corner("c0", "qx", j, "_w").alias("c")) for i in (0, 1) for j in (0, 1)]
    p = p.select(*keys, "by", "bx", "qy", "qx", "r0", "c0", F.inline(F.array(*places)))
    hit = p.join(reference.select(*keys, "r", "c", "v"), [*keys, "r", "c"])
    four = hit.groupBy(*keys, "by", "bx", "qy", "qx", "r0", "c0").agg(*[F.max(F.when(F.col("_k") == k, F.col("v"))).alias(f"s{k}") for k in range(4)])
    seven = lambda v: F.col(v).bitwiseAND(F.lit(7))
    value = chroma_eighth(*[F.col(f"s{k}") for k in range(4)], seven("qx"), seven("qy"))
    return four.select(*keys, "by", "bx", F.col("r0").alias("r"), F.col("c0").alias("c"), value.cast("int").alias("pred"))


def chroma_eighth(a: Column, b: Column, c: Column, d: Column, fx: Value, fy: Value) -> Column:
    """Bilinear value at eighths between the samples a b over c d."""
    x, y = col(fx), col(fy)
    total = a * (F.lit(8) - x) * (F.lit(8) - y) + b * x * (F.lit(8) - y) + c * (F.lit(8) - x) * y + d * x * y
    return shr(total + 32, 6)


def both_ways(a: Column, b: Column) -> Column:
    """The rounded mean of a forward and a backward prediction."""
    return shr(a + b + 1, 1)


def best_match(items: DataFrame, keys: list[str], item: str, block: str) -> DataFrame:
    """(keys, item, match, sad): for each item the other one of its key with the least error. Blocks are
    arrays; pairs are made within a key only, so keys have to be bounded (frames of one group)."""
    a = items.select(*keys, F.col(item).alias("item"), F.col(block).alias("x"))
    b = items.select(*keys, F.col(item).alias("match"), F.col(block).alias("y"))
    error = F.aggregate(F.zip_with("x", "y", lambda p, q: F.abs(p - q)), F.lit(0).cast("bigint"), lambda s, v: s + v)
    pairs = a.join(b, keys).where("item <> match").select(*keys, "item", "match", error.alias("sad"))
    return pairs.groupBy(*keys, "item").agg(F.min(F.struct("sad", "match")).alias("m")).select(*keys, F.col("item").alias(item), "m.match", "m.sad")
