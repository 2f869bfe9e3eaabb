"""The group codec: what decodes is what the encoder saw, quality follows QP, damage is an error."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockwave.functions import predict, transform
from blockwave.operators import gop


def clip(frames=3, h=48, w=64, seed=1):
    r = np.random.default_rng(seed)
    y, x = np.mgrid[0:h, 0:w]
    for f in range(frames):
        yield np.clip((x * 3 + y * 2 + f * 4) % 200 + 40 * ((x - 3 * f) // 16 % 2) + r.integers(-3, 4, (h, w)), 0, 255).astype(np.int64)


def run(frames, qp):
    ref, packets, recs = None, [], []
    for k, f in enumerate(frames):
        p, ref = gop.encode_frame(f, ref, qp, k)
        packets.append(p)
        recs.append(ref)
    return packets, recs


def test_decoder_sees_what_the_encoder_saw():
    frames = list(clip())
    errors, sizes = [], []
    for qp in (10, 28, 45):
        packets, recs = run(frames, qp)
        ref = None
        for p, rec in zip(packets, recs):
            ref = gop.decode_frame(p, ref)
            assert (ref == rec).all()
        assert packets == run(frames, qp)[0]
        errors.append(sum(int(((a - b) ** 2).sum()) for a, b in zip(frames, recs)))
        sizes.append(sum(map(len, packets)))
    assert errors == sorted(errors) and sizes == sorted(sizes, reverse=True)


def test_a_still_clip_is_nearly_free():
    f = next(clip(1))
    packets, _ = run([f, f, f], 30)
    assert len(packets[2]) < len(packets[0]) / 5


def test_damage_is_an_error_or_a_frame():
    packets, recs = run(list(clip()), 30)
    r = random.Random(4)
    for _ in range(60):
        k = r.randrange(3)
        d = bytearray(packets[k])
        for _ in range(r.randint(1, 4)):
            d[r.randrange(14, len(d))] ^= 1 << r.randrange(8)
        d = bytes(d[: r.randint(15, len(d))] if r.random() < 0.25 else d)
        try:
            out = gop.decode_frame(d, recs[k - 1] if k else None)
            assert out.shape == recs[0].shape and out.min() >= 0 and out.max() <= 255
        except ValueError:
            pass
    for bad in (b"", b"abc", packets[1]):
        with pytest.raises(ValueError):
            gop.decode_frame(bad, None)


def test_twins_of_the_column_functions(spark):
    r = np.random.default_rng(2)
    above, left, block = r.integers(0, 256, 17), r.integers(0, 256, 17), r.integers(-255, 256, (8, 8))
    lit = lambda a: F.array(*[F.lit(int(v)) for v in np.ravel(a)])
    got = spark.range(1).select(*[predict.predict(lit(above), lit(left), 8, m) for m in range(18)], transform.transform2d(lit(block), "dct", 8), transform.transform2d(lit(block), "dct", 8, True)).first()
    assert all(got[m] == gop.predict(above, left, m).ravel().tolist() for m in range(18))
    assert got[18] == gop.forward(block).ravel().tolist() and got[19] == gop.inverse(block).ravel().tolist()


def test_groups_in_spark(spark):
    frames = list(clip(5))
    rows = [(c, k, 64, 48, bytes(f.astype(np.uint8).tobytes())) for c in ("a", "b") for k, f in enumerate(frames)]
    df = spark.createDataFrame(rows, "clip string, frame_idx long, width int, height int, y binary")
    packets = gop.encode(df, qp=28, interval=2)
    assert sorted((r["clip"], r["frame_idx"]) for r in packets.where("key").collect()) == [(c, k) for c in "ab" for k in (0, 2, 4)]
    out = {(r["clip"], r["frame_idx"]): r for r in gop.decode(packets).collect()}
    want = {r["frame_idx"]: r["sse"] for r in packets.where("clip = 'a'").collect()}
    for (c, k), r in out.items():
        y = np.frombuffer(r["y"], np.uint8).reshape(48, 64).astype(int)
        assert r["error"] == "" and int(((frames[k] - y) ** 2).sum()) == want[k]
    broken = packets.withColumn("payload", F.when(F.col("frame_idx") == 2, F.lit(b"x")).otherwise(F.col("payload")))
    assert {r["frame_idx"] for r in gop.decode(broken).where("error <> ''").collect()} == {2, 3}


def test_groups_are_dealt_to_many_tasks(spark):
    """However few bytes the groups are, tasks are not merged; columns of packets are carried through the decoder."""
    f = next(clip(1, 16, 16)).astype(np.uint8).tobytes()
    df = spark.createDataFrame([(str(c), k, 16, 16, f) for c in range(24) for k in (0, 1)], "clip string, frame_idx long, width int, height int, y binary")
    packets = gop.encode(df, qp=28, interval=2)
    assert packets.select(F.spark_partition_id()).distinct().count() > 4
    out = gop.decode(packets, "size", "sse")
    assert out.select(F.spark_partition_id()).distinct().count() > 4
    key = lambda rows: sorted((r["clip"], r["frame_idx"], r["size"], r["sse"]) for r in rows)
    assert key(out.collect()) == key(packets.collect()) and out.columns == ["clip", "frame_idx", "y", "error", "size", "sse"]
