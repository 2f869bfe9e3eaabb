"""Nearest neighbours against brute force: recall, exact scores, ties and odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockwave.llm import ann
from blockwave.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, code long, v string, salt int, score double"


def frame(spark, rows):
    return spark.createDataFrame([(i, x, 1, 2, "v", 3, 0.5) for i, x in rows], SCHEMA)


def plain(rows, every, near=10):
    """{query: [(score, vec_id)]} of all rows; an id with several vectors counts with its nearest one."""
    dims = max((len(x) for _, x in rows if x), default=0)
    pad = lambda x: np.array([*np.float32(x), *[0] * (dims - len(x))], np.float64)
    good = [(i, pad(x)) for i, x in rows if i is not None and x and all(y is not None and math.isfinite(y) for y in x) and any(x)]
    out = {}
    for i, x in good:
        if i % every == 0:
            for j, y in good:
                if i != j:
                    d = float(np.sqrt(((x - y) ** 2).sum()))
                    own = out.setdefault(i, {})
                    own[j] = min(own.get(j, d), d)
    return {i: sorted((d, j) for j, d in x.items())[:near] for i, x in out.items()}


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


def check(got, want, least):
    assert got.keys() == want.keys()
    hits = 0
    for q, own in got.items():
        assert len(own) == len(want[q]) and own == sorted(own)
        true = dict((j, d) for d, j in want[q])
        hits += sum(j in true for _, j in own)
        assert all(math.isclose(true[j], d, abs_tol=1e-12) for d, j in own if j in true)
    assert hits >= least * sum(map(len, want.values()))


@pytest.mark.parametrize("sf", ("sf0.01", "sf0.1"))
def test_query_reaches_its_recall(spark, sf):
    folder = f"/root/testdata/{sf}"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    check(found(QUERIES["op12_neighbours"](spark, folder)), plain(rows, 100), 0.9)


def test_hot_buckets_copies_and_clusters(spark, monkeypatch):
    monkeypatch.setattr(ann, "CHUNK", 200)
    monkeypatch.setattr(ann, "SAMPLE", 300)
    r = np.random.default_rng(3)
    centre = r.normal(size=(5, 12))
    rows = [(k, (centre[k % 5] + 0.01 * r.normal(size=12)).tolist()) for k in range(1500)]
    rows += [(k, [1.0] * 12) for k in range(2000, 2900)] + [(k, [1.0] * 12) for k in range(2000, 2900, 7)]
    want = plain(rows, 50)
    assert want[2000] == [(0.0, k) for k in range(2001, 2011)]
    check(found(ann.search(frame(spark, rows), F.col("vec_id") % 50 == 0)), want, 0.9)


def test_odd_rows_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, -1.0]), (3, [2.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, []), (None, [1.0, 0.0]), (10, [1.0]), (10, [3.0, 3.0]), (0, [1.0, 0.0])]
    want = plain(rows, 5)
    assert [j for _, j in want[0]] == [10, 1, 2, 3]  # fewer than ten: all of them, ties by id; a shorter vector ends with zeros
    assert found(ann.search(frame(spark, rows), F.col("vec_id") % 5 == 0)) == want
    assert ann.search(frame(spark, []), F.col("vec_id") % 5 == 0).collect() == []
    assert ann.search(frame(spark, [(0, [1.0])]), F.col("vec_id") % 5 == 0).collect() == []


def test_a_query_that_finds_too_few_is_searched_in_all_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "fit", lambda *a, f=ann.fit: narrow(f(*a)))

    def narrow(index):
        index.share = 1e-6
        return index

    r = np.random.default_rng(4)
    rows = [(k, r.normal(size=16).tolist()) for k in range(600)]
    got = found(ann.search(frame(spark, rows), F.col("vec_id") % 60 == 0))
    assert all(len(x) == 10 for x in got.values()) and len(got) == 10


def test_buckets_come_in_the_order_of_their_success():
    r = np.random.default_rng(5)
    x = r.normal(size=(3000, 8))
    d = ann._squares(x[:50], x)
    tried = [(x[k], x[np.argsort(d[k])[1:11]]) for k in range(50)]
    index = ann.fit(3000, np.arange(3000), x, 10, tried)
    for t in range(ann.TABLES):
        for (codes, sums), own in zip(index.probes(x[:20], t, index.share), index.codes(x[:20])):
            steps = np.diff(sums, prepend=0)
            assert (np.diff(steps) <= 1e-12).all() and sums[-1] >= index.share and len(set(codes)) == len(codes)
            assert own[t] in codes[:3000]
