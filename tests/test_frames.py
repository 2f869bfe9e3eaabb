"""Edges, trees and descents on frames against plain walks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockwave.operators import frames


def made(h, w, n=8, seed=1, gaps=()):
    """A frame of h x w blocks as rows (clip, by, bx, b), without those of ``gaps``."""
    v = np.random.default_rng(seed).integers(0, 256, (h * n, w * n))
    return v, [(7, y, x, v[y * n : y * n + n, x * n : x * n + n].ravel().tolist()) for y in range(h) for x in range(w) if (y, x) not in gaps]


def table(spark, rows):
    return spark.createDataFrame(rows, "clip long, by long, bx long, b array<int>").repartition(5)


def test_edges_come_from_the_neighbours(spark):
    v, rows = made(3, 4, gaps={(1, 2)})
    wide, near = frames.references(8), frames.near_references(8)
    got = frames.with_edges(table(spark, rows), ["clip"], 8).select("*", wide[0].alias("wa"), wide[1].alias("wl"), near[0].alias("na"), near[1].alias("nl")).collect()
    have = {(r[1], r[2]) for r in rows}
    assert {(r.by, r.bx) for r in got} == have
    for r in got:
        y, x = r.by * 8, r.bx * 8
        up, left, corner = (r.by - 1, r.bx) in have, (r.by, r.bx - 1) in have, (r.by - 1, r.bx - 1) in have
        a = v[y - 1, x : x + 8].tolist() if up else None
        c = v[y : y + 8, x - 1].tolist() if left else None
        more = v[y - 1, x + 8 : x + 16].tolist() if (r.by - 1, r.bx + 1) in have else [a[-1]] * 8 if up else None
        down = v[y + 8 : y + 16, x - 1].tolist() if (r.by + 1, r.bx - 1) in have else [c[-1]] * 8 if left else None
        k = [int(v[y - 1, x - 1])] if corner else None
        wa, wl = (a + more if up else [128] * 16), (c + down if left else [128] * 16)
        assert r.wa == (k or wa[:1]) + wa and r.wl == (k or wl[:1]) + wl
        na, nl = a or [c[0] if left else 128] * 8, c or [a[0] if up else 128] * 8
        k = k or (a or c or [128])[:1]
        assert r.na == k + na + [na[-1]] * 8 and r.nl == k + nl + [nl[-1]] * 8


@pytest.mark.parametrize("price", (0, 500, 100_000_000))
def test_trees_equal_a_recursion(spark, price):
    r = random.Random(price)
    leaves = {(y, x): (64, s := r.randint(0, 64 * 255), s * s // 64 + r.randint(0, 9000)) for y in range(11) for x in range(17) if (y, x) != (2, 5)}

    def best(y, x, d):
        inside = [leaves.get((y + i, x + j)) for i in range(1 << d) for j in range(1 << d)]
        if not any(inside):
            return 0, []
        n, s, q = (sum(c) for c in zip(*filter(None, inside)))
        own = q - s * s // n + price if all(inside) else None
        if d == 0:
            return own, [(y, x, 1, own)]
        parts = [best(y + (i << d - 1), x + (j << d - 1), d - 1) for i in (0, 1) for j in (0, 1)]
        four = sum(c for c, _ in parts)
        return (four, [t for _, p in parts for t in p]) if own is None or four <= own else (own, [(y, x, 1 << d, own)])

    df = spark.createDataFrame([(3, y, x, *v) for (y, x), v in leaves.items()], "clip long, by long, bx long, n long, s long, q long").repartition(4)
    got = sorted((t.clip, t.ty, t.tx, t.y, t.x, t["size"], t.cost, t.total) for t in frames.split_trees(df, ["clip"], price).collect())
    want = []
    for ty in range(2):
        for tx in range(3):
            total, tree = best(ty * 8, tx * 8, 3)
            want += [(3, ty, tx, y - ty * 8, x - tx * 8, size, cost, total) for y, x, size, cost in tree]
    assert got == sorted(want)


@pytest.mark.parametrize("reach,tile", ((4, 2), (8, 8)))
def test_descents_equal_a_walk(spark, reach, tile):
    v, rows = made(5, 6, seed=reach)
    v = np.cumsum(np.cumsum(v - 127, 0), 1) // 40 % 256  # smooth enough to descend
    rows = [(7, y, x, v[y * 8 : y * 8 + 8, x * 8 : x * 8 + 8].ravel().tolist()) for _, y, x, _ in rows]
    moved = np.roll(v, (3, -2), (0, 1))
    cur = [(7, y, x, moved[y * 8 : y * 8 + 8, x * 8 : x * 8 + 8].ravel().tolist()) for _, y, x, _ in rows]

    def walk(y0, x0):
        block, tried = moved[y0 : y0 + 8, x0 : x0 + 8], 1
        error = lambda y, x: int(np.abs(v[y : y + 8, x : x + 8] - block).sum())
        y, x, least = y0, x0, error(y0, x0)
        for k, (points, times) in enumerate(frames.ROUNDS):
            for _ in range(times):
                found = False
                for dx, dy in points:
                    s = max(1, reach // 4) if k == 0 else 1
                    ny, nx = y + dy * s, x + dx * s
                    if 0 <= ny <= v.shape[0] - 8 and 0 <= nx <= v.shape[1] - 8:
                        tried += 1
                        if error(ny, nx) < least:
                            y, x, least, found = ny, nx, error(ny, nx), True
                if not found:
                    break
        return least, y - y0, x - x0, tried

    got = frames.greedy(table(spark, cur), table(spark, rows), ["clip"], 8, reach, tile).collect()
    assert len(got) == 30
    for r in got:
        assert (r.sad, r.dy, r.dx, r.tried) == walk(r.by * 8, r.bx * 8)


def test_empty_tables(spark):
    none = table(spark, [])
    assert frames.greedy(none, none, ["clip"], 8, 4).collect() == []
    assert frames.with_edges(none, ["clip"], 8).collect() == []
    assert frames.split_trees(none.select("clip", "by", "bx", *[F.lit(1).alias(c) for c in "nsq"]), ["clip"], 1).collect() == []


@pytest.mark.parametrize("frames", ["_cur", "_half"])
def test_shifted_frames_take_one_pass(spark, sf_dir, frames):
    """No pass over a frame's 1024 places holds another one, which would run for each of them."""
    from blockwave.queries import clips

    plan = getattr(clips, frames)(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    passes = [line.count("transform(") for line in plan.splitlines() if "embedding" not in line]
    assert max(passes) == 1
