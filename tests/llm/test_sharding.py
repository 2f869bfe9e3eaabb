import random
import zlib

import pytest
from pyspark.sql import functions as F

from blockwave.llm import sharding

from . import cases


def best_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, n, used = (low + high) // 2, 1, 0
        for s in sizes:
            if used + s > mid:
                n, used = n + 1, 0
            used += s
        low, high = (low, mid) if n <= shards else (mid + 1, high)
    return low


def check(spark, docs, n_rows):
    got = sharding.shard(docs).collect()
    assert len(got) == n_rows
    for k in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))
    keyed = docs.selectExpr("xxhash64(coalesce(text, '')) AS key", "octet_length(coalesce(text, '')) + 1 AS size").collect()
    by = {}
    for r in keyed:
        by[r["key"]] = by.get(r["key"], 0) + r["size"]
    sums = {}
    for r in got:
        sums[r["shard"]] = sums.get(r["shard"], 0) + r["size"]
    assert max(sums.values()) == best_capacity([by[k] for k in sorted(by)], 8)
    return got


def test_odd_documents(spark):
    got = check(spark, cases.frame(spark), len(cases.odd_texts()))
    texts = dict(cases.odd_texts())
    for r in got:
        t = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 1, zlib.crc32(t), "bytes", None)
    assert len({r["shard"] for r in got if texts[r["doc_id"]] == texts[6]}) == 1
    assert sharding.shard(cases.empty(spark)).count() == 0


@pytest.mark.parametrize("hot", [1, 700])
def test_minimax(spark, monkeypatch, hot):
    monkeypatch.setattr(sharding, "BITS", 4)  # several rounds of ranges
    r = random.Random(hot)
    texts = [(i, "".join(r.choice("ab ") for _ in range(r.randint(0, 60)))) for i in range(1400)] + [(2000 + i, "hot " * 5) for i in range(hot)]
    check(spark, cases.frame(spark, texts), len(texts))


def test_few_groups(spark):
    check(spark, cases.frame(spark, [(1, "a"), (2, "b" * 10), (3, "a")]), 3)


def test_many_equal_rows_are_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK", 100)
    df = cases.frame(spark, [(None, "same")] * 3000 + [(7, "again")] * 2500 + [(k, f"text {k}") for k in range(50)])
    out = sharding.shard(df).collect()
    assert len(out) == 5550 and sum(r["doc_id"] is None for r in out) == 3000
    for k in range(8):
        slots = sorted(r["slot"] for r in out if r["shard"] == k)
        assert slots == list(range(len(slots)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sizes = [r["count"] for r in sharding.shard(df).groupBy(F.spark_partition_id()).count().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(sizes) < 3 * 5550 / 4
