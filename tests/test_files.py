"""The packet source and sink: ranges, columns, filters, two-phase commit."""

import os
import random
import struct

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from blockwave.sources import files
from blockwave.sources.formats import KEY, MAGIC


def payloads(n, seed=1):
    r = random.Random(seed)
    return [MAGIC + bytes([1, 1, 64, 0, 240, KEY if k % 5 == 0 else 0]) + r.randbytes(r.randint(1, 300)) for k in range(n)]


def packets(spark, n, streams=3):
    return spark.createDataFrame([(f"s{s}", k, bytearray(p)) for s in range(streams) for k, p in enumerate(payloads(n, s))], "name string, t long, payload binary").repartition(7)


@pytest.mark.parametrize("kind", ("stream", "container"))
def test_streams_are_cut_over_tasks_and_read_in_ranges(spark, tmp_path, kind):
    path = f"file://{tmp_path}/out"
    files.write(packets(spark, 200), "name", ["t"], "payload", path, kind, parts=8, split=1000)
    assert len([f for f in os.listdir(tmp_path / "out") if f.startswith("s1.")]) > 1 and not any("temporary" in f for f in os.listdir(tmp_path / "out"))
    got = files.read(spark, path, kind, split=1000)
    assert got.rdd.getNumPartitions() > 40
    for s in range(3):
        own = sorted((r for r in got.collect() if r.stream_id.endswith(f"s{s}")), key=lambda r: r.pkt_idx)
        assert [bytes(r.payload) for r in own] == payloads(200, s) and all(r.error == "" and r.pts == r.pkt_idx and r.key == (r.pkt_idx % 5 == 0) for r in own)
    # without the sink's index the lengths are passed over; a part of a container then lacks its opening
    if kind == "stream":
        os.remove(tmp_path / "out" / files.INDEX)
        again = files.read(spark, path, kind, split=1000)
        assert again.rdd.getNumPartitions() > 40 and sorted(bytes(r.payload) for r in again.collect()) == sorted(bytes(r.payload) for r in got.collect())


def test_filters_and_columns_reach_the_reader(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    files.write(packets(spark, 100), "name", ["t"], "payload", path, parts=4, split=2000)
    got = files.read(spark, path, columns="stream_id,pkt_idx,key").where(F.col("key") & (F.col("pkt_idx") > 20) & (F.col("pkt_idx") <= 60) & F.col("stream_id").endswith("s2"))
    assert sorted(r.pkt_idx for r in got.collect()) == list(range(25, 61, 5))
    reader = files._Reader({"path": path, "kind": "stream"}, files.StructType.fromDDL(files.PACKETS))
    every = reader.partitions()
    left = list(reader.pushFilters([files.GreaterThan(("pkt_idx",), 90), files.StringEndsWith(("stream_id",), "s0"), files.EqualTo(("size",), 5)]))
    assert [f.attribute for f in left] == [("size",)]
    few = reader.partitions()
    assert 0 < len(few) < len(every) / 3 and {s.stream[-2:] for s in few} == {"s0"}


def test_a_large_sparse_file_is_many_tasks(spark, tmp_path):
    """Above 2 GB: 45 packets of 50 MB that are holes but for their beginnings."""
    name, n = tmp_path / "large", 50 << 20
    with open(name, "wb") as f:
        for k in range(45):
            f.write(struct.pack("<I", n) + MAGIC + bytes([0, 0, 0, 0, 0, KEY if k % 9 == 0 else 0]))
            f.seek((k + 1) * (n + 4))
        f.truncate(45 * (n + 4))
    assert os.path.getsize(name) > 2 << 30
    got = files.read(spark, f"file://{name}", columns="pkt_idx,size,key,error")
    assert got.rdd.getNumPartitions() > 20
    rows = sorted(map(tuple, got.collect()))
    assert rows == [(k, n, k % 9 == 0, "") for k in range(45)]


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    bad = packets(spark, 50).withColumn("payload", F.when((F.col("name") == "s2") & (F.col("t") == 49), F.raise_error(F.lit("no")).cast("binary")).otherwise(F.col("payload")))
    spark.dataSource.register(files.PacketFiles)
    rows = bad.select(F.col("name").alias("stream"), F.col("t").alias("pkt_idx"), F.col("t").alias("pts"), "payload")
    with pytest.raises(PySparkException):
        rows.write.format("packets").mode("append").save(f"file://{tmp_path}/out")
    assert [f for f in (os.listdir(tmp_path / "out") if os.path.isdir(tmp_path / "out") else [])] == []


def test_parts_are_never_written_over(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    files.write(packets(spark, 5), "name", ["t"], "payload", path, parts=1)
    before = {f: (tmp_path / "out" / f).read_bytes() for f in os.listdir(tmp_path / "out")}
    with pytest.raises(PySparkException):
        files.write(packets(spark, 6), "name", ["t"], "payload", path, parts=1)
    assert {f: (tmp_path / "out" / f).read_bytes() for f in os.listdir(tmp_path / "out")} == before


def test_raw_frames(spark, tmp_path):
    (tmp_path / "clip").write_bytes(b"".join(bytes([k]) * 10 for k in range(30)) + b"half")
    got = files.read(spark, f"file://{tmp_path}/clip", "frames", frame=10, split=70)
    assert got.rdd.getNumPartitions() == 5 and {r.frame_idx: bytes(r.data) for r in got.collect()} == {k: bytes([k]) * 10 for k in range(30)}
    assert [r.frame_idx for r in files.read(spark, f"file://{tmp_path}/clip", "frames", "frame_idx", frame=10).where("frame_idx = 7").collect()] == [7]


def test_small_files_share_a_task_and_are_not_opened_to_plan(spark, tmp_path, monkeypatch):
    for k in range(300):
        (tmp_path / f"s{k}").write_bytes(b"".join(struct.pack("<I", len(p)) + p for p in payloads(3, k)) + b"\1\2" * (k % 7 == 0))
    got = files.read(spark, f"file://{tmp_path}", tasks=10)
    assert got.rdd.getNumPartitions() <= 20
    rows = sorted((int(r.stream_id.rpartition("s")[2]), r.pkt_idx, bytes(r.payload), r.error) for r in got.collect())
    assert rows == sorted([(k, i, p, "") for k in range(300) for i, p in enumerate(payloads(3, k))] + [(k, 3, b"", "length") for k in range(0, 300, 7)])
    monkeypatch.setattr(files, "spans", None)
    reader = files._Reader({"path": f"file://{tmp_path}", "kind": "stream"}, files.StructType.fromDDL(files.PACKETS))
    assert sum(1 + len(s.more) for s in reader.partitions()) == 300


def test_parts_follow_the_tasks_and_not_the_query(spark, sf_dir, tmp_path, monkeypatch):
    """One task writes no whole table, and a range is not so short that a large table is many tasks."""
    from blockwave.queries import files as queries

    monkeypatch.setattr(queries, "scratch", lambda _: f"file://{tmp_path}/bytes")
    found = queries.container_bytes(spark, sf_dir)
    assert {f.rpartition(".")[2] for f in os.listdir(tmp_path / "bytes") if f[0] == "s"} == {f"{k:06d}" for k in range(4)}
    assert found.count() == spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr("page_id div 16 AS s").distinct().count()
    monkeypatch.setattr(queries, "scratch", lambda _: f"file://{tmp_path}/parts")
    queries.packet_parts(spark, sf_dir)
    assert sorted(f for f in os.listdir(tmp_path / "parts") if f[0] == "a") == [f"all.{k:06d}" for k in range(4)]
    assert files.read(spark, f"file://{tmp_path}/parts", "container").rdd.getNumPartitions() <= 4
