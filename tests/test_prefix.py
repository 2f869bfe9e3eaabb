"""Recurrences over ranges against plain walks, with one hot key and ranges that cut it."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockwave.functions.ratecontrol import next_qp
from blockwave.operators import order, prefix
from blockwave.queries import all_queries


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    return [(k, t, r.choice((None, 0, 100, 3000, 4000, 5000, 60_000, 900_000)), r.random() < 0.3) for k, n in ((1, 3000), (2, 1), (3, 40), (None, 25), (4, 300)) for t in range(n)]


def walked(rows, bitrate=120_000, fps=30.0):
    out, state, size, target = [], {}, max(bitrate, 0), int(bitrate / fps)
    for k, t, bits, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        qp, level, total, n = state.get(k, (32, size, 0, 0))
        qp = next_qp(qp, level / (2 * size) if size else 0.5)
        level, total = min(max(level + 2 * (target - (bits or 0)), 0), 2 * size) if size else level, total + (bits or 0)
        state[k] = qp, level, total, n + 1
        out.append((k, t, n, total, qp, level / (2 * size) if size else 0.5))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "clip long, t long, bits long, key boolean").repartition(5)


@pytest.mark.parametrize("parts", (1, 3, 16))
def test_budget_equals_a_walk(spark, rows, parts):
    got = prefix.budget(frame(spark, rows), ["clip"], ["t"], "bits", 32, 120_000, 30.0, parts)
    assert sorted(map(tuple, got.select("clip", "t", "place", "total", "qp", "level").collect()), key=str) == walked(rows)


def test_budget_without_a_bitrate_and_empty(spark, rows):
    got = prefix.budget(frame(spark, rows), ["clip"], ["t"], "bits", 32, 0, 30.0, 4)
    assert sorted(map(tuple, got.select("clip", "t", "place", "total", "qp", "level").collect()), key=str) == walked(rows, 0)
    assert prefix.budget(frame(spark, []), ["clip"], ["t"], "bits", 32, 120_000, 30.0).collect() == []


def test_budget_equals_the_fold(spark, sf_dir):
    folded = {r.user_id: (r.frames, r.qp, r.level, r.total) for r in all_queries()["vbv_fold_users"](spark, sf_dir).collect()}
    last = {}
    for r in all_queries()["vbv_prefix_users"](spark, sf_dir).collect():
        if r.place >= last.get(r.user_id, (0,))[0] - 1:
            last[r.user_id] = (r.place + 1, r.qp, round(r.level, 6), r.total)
    assert last == folded


def test_steps_and_tables_compose_associatively():
    r = np.random.default_rng(1)
    a, b, c = ((np.minimum(x, y), np.maximum(x, y), z) for x, y, z in r.integers(-50, 50, (3, 3, 40)))
    left, right = prefix.clamps(prefix.clamps(a, b), c), prefix.clamps(a, prefix.clamps(b, c))
    x = r.integers(-90, 90, 40)
    for low, high, move in (left, right):
        y = x
        for lo, hi, d in (a, b, c):
            y = np.minimum(hi, np.maximum(lo, y + d))
        assert (np.minimum(high, np.maximum(low, x + move)) == y).all()


@pytest.mark.parametrize("parts", (1, 7))
def test_places_and_values_before(spark, rows, parts):
    got = prefix.numbered(frame(spark, rows), ["clip"], ["t"], parts)
    assert all(r.place == r.t for r in got.collect()) and got.count() == len(rows)
    got = prefix.carried(frame(spark, rows).withColumn("v", F.when(F.col("bits") > 5000, F.col("t"))), ["clip"], ["t"], "v", "w", parts).collect()
    for k in (1, 2, 3, None, 4):
        last = None
        for r in sorted((r for r in got if r.clip == k), key=lambda r: r.t):
            last = r.v if r.v is not None else last
            assert r.w == last


@pytest.mark.parametrize("target", (1, 5, 64))
def test_segments_equal_a_walk_of_each_stream(spark, rows, target):
    rows = [(k, t, b, key or (t == 0 and k != 3)) for k, t, b, key in rows if not (k == 3 and t == 0)] + [(3, 0, 1, False)]
    got = prefix.segments(frame(spark, rows), ["clip"], ["t"], F.col("key"), target).select("clip", "t", "segment")
    want = order.segments(frame(spark, rows), ["clip"], "t", "key", target)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
