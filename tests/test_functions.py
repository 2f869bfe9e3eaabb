"""Known answers, round trips and plain twins of the column functions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockwave.functions import bits, color, ints, predict, quant, rangecoder, ratecontrol, transform
from blockwave.functions.filters import band_offset, chroma_edge, edge
from blockwave.sources import synthetic


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def blocks(spark, n, rows=12, low=-255, high=255, seed=1):
    r = random.Random(seed)
    data = [(k, [r.randint(low, high) for _ in range(n * n)]) for k in range(rows)]
    return data, spark.createDataFrame(data, "id int, b array<int>")


def test_integers(spark):
    r = one(spark, ints.div(-7, 2), ints.shr(-7, 1), ints.wrap16(40000), ints.byte_at(F.lit(b"\x00\xff\x10"), 2), ints.int_be(F.lit(b"\x01\x02"), 1, 2), ints.int_le(F.lit(b"\x01\x02"), 1, 2), F.hex(ints.bytes_le(258, 4)), F.hex(ints.bytes_be(258, 4)))
    assert list(r) == [-3, -4, -25536, 255, 258, 513, "02010000", "00000102"]


@pytest.mark.parametrize("n", [4, 8])
@pytest.mark.parametrize("kind", ["wht", "dct"])
def test_transforms_against_matrices(spark, kind, n):
    data, df = blocks(spark, n)
    m = np.array(transform.matrix(kind, n), np.int64)
    for inverse in (False, True):
        a = m.T if inverse and kind == "dct" else m
        got = {r["id"]: r["t"] for r in df.select("id", transform.transform2d(F.col("b"), kind, n, inverse).alias("t")).collect()}
        for k, b in data:
            x = np.array(b).reshape(n, n)
            if kind == "dct":
                y = (a @ ((x @ a.T + 8192) >> 14) + 8192) >> 14
            else:
                y = (a @ (x @ a.T) + n // 2) >> (n.bit_length() - 1)
            assert got[k] == y.ravel().tolist()


@pytest.mark.parametrize("kind, n, gain", [("wht", 4, 4), ("dct", 4, 4), ("dct", 8, 8)])
def test_dc_gain(spark, kind, n, gain):
    t = one(spark, transform.transform2d(F.array_repeat(F.lit(100), n * n), kind, n))[0]
    assert t == [100 * gain] + [0] * (n * n - 1)


def test_round_trip_is_within_two(spark):
    for kind in ("wht", "dct"):
        for n in (4, 8):
            _, df = blocks(spark, n, low=-2000, high=2000)
            back = df.select("b", transform.transform2d(transform.transform2d(F.col("b"), kind, n), kind, n, True).alias("t")).collect()
            assert max(abs(a - b) for r in back for a, b in zip(r["b"], r["t"])) <= 2


def test_dc_shortcut_equals_the_full_inverse(spark):
    for n in (4, 8):
        df = spark.range(-2000, 2001, 37).select(F.concat(F.array(F.col("id").cast("int")), F.array_repeat(F.lit(0), n * n - 1)).alias("b"))
        assert df.where(transform.inverse_dct(F.col("b"), n) != transform.transform2d(F.col("b"), "dct", n, True)).count() == 0


def test_crc_and_codes(spark):
    assert one(spark, bits.crc16(F.lit(b"123456789")))[0] == 0x29B1
    assert one(spark, bits.crc16(F.lit(b"")))[0] == 0xFFFF
    assert list(one(spark, *[bits.se_number(F.lit(v)) for v in (0, 1, -1, 2, -2)])) == [0, 1, 2, 3, 4]
    assert list(one(spark, *[bits.ue(F.lit(v)) for v in (0, 1, 2, 6)])) == ["1", "010", "011", "00111"]
    r = one(spark, bits.read_ue(F.lit("0" * 40)), bits.read_ue(F.lit("001")), bits.read_ue(F.lit("1100111"), 2))
    assert r[0]["error"] and r[1]["error"] and r[2]["value"] == 6 and r[2]["next"] == 7


def test_zigzag():
    assert bits.zigzag(4) == (0, 1, 4, 8, 5, 2, 3, 6, 9, 12, 13, 10, 7, 11, 14, 15)
    assert sorted(bits.zigzag(8)) == list(range(64)) and bits.zigzag(8)[:4] == (0, 1, 8, 16)


def test_coefficient_code_round_trip(spark):
    for n in (4, 8):
        _, df = blocks(spark, n, low=-9, high=9)
        df = df.unionAll(spark.createDataFrame([(99, [0] * (n * n))], "id int, b array<int>"))
        c = df.select("b", bits.coefficient_code(F.col("b"), n).alias("c")).select("b", "c", bits.coefficient_bits(F.col("b"), n).alias("k"), bits.pack(F.col("c")).alias("d"))
        c = bits.coefficient_decode(c, "d", n)
        for r in c.collect():
            assert r["d"]["block"] == r["b"] and not r["d"]["error"] and len(r["c"]) == r["k"]
    codes = spark.createDataFrame([(0, None), (1, "00FF"), (2, "04"), (3, "0000000000000000"), (4, "")], "k int, h string").select("k", F.unhex("h").alias("d"))
    none, bad, cut, wild, nothing = (r["d"] for r in bits.coefficient_decode(codes, "d", 4).orderBy("k").collect())
    assert none is None and bad["error"] and cut["error"] and wild["error"]
    assert nothing["error"] and nothing["block"] == [0] * 16


def test_quantizer(spark):
    _, df = blocks(spark, 8, low=-3000, high=3000)
    q = df.select("b", quant.quantize(F.col("b"), F.lit(20), 8).alias("q")).withColumn("d", quant.dequantize(F.col("q"), F.lit(20), 8))
    for r in q.collect():
        for p, (c, level, back) in enumerate(zip(r["b"], r["q"], r["d"])):
            eff = max((16 * (6, 7, 8, 10)[0 if p == 0 else 1 if p < 16 else 2 if p < 32 else 3] + 4) >> 3, 1)
            assert abs(level) == (abs(c) + eff // 3) // eff and level * c >= 0
            assert back == (level * eff + (eff // 6) * ((level > 0) - (level < 0)))
    assert list(one(spark, quant.step(-5), quant.step(99), quant.trade_off(0))) == [1, 6305, 1]


def test_colour_of_grey_and_corners(spark):
    df = spark.createDataFrame([(v, v, v) for v in (0, 1, 128, 255)] + [(255, 0, 0), (0, 255, 0), (0, 0, 255)], "r int, g int, b int")
    ycc = df.select("r", "g", "b", *[v.alias(k) for k, v in color.rgb_to_ycc(F.col("r"), F.col("g"), F.col("b")).items()])
    rgb = ycc.select("*", *[v.alias(k) for k, v in color.ycc_to_rgb(F.col("y"), F.col("cb"), F.col("cr")).items()])
    for r in rgb.collect():
        assert max(abs(r["r"] - r["red"]), abs(r["g"] - r["green"]), abs(r["b"] - r["blue"])) <= 3
        if r["r"] == r["g"] == r["b"]:
            assert (r["y"], r["cb"], r["cr"]) == (r["r"], 128, 128)


def test_prediction_of_flat_references(spark):
    flat = F.array_repeat(F.lit(77), 17)
    got = one(spark, *[predict.predict(flat, flat, 8, m) for m in (*range(1, 18), 50)])
    assert all(b == [77] * 64 for b in got)
    mode = one(spark, predict.best_mode(F.array_repeat(F.lit(77), 64), flat, flat, 8))[0]
    assert (mode["sad"], mode["mode"]) == (0, 1)  # the planar mode pulls towards 0 by its rounding


def test_vertical_and_horizontal_modes_copy(spark):
    up, side = [0, *range(10, 26)], [0, *range(110, 126)]
    a, b = F.array(*map(F.lit, up)), F.array(*map(F.lit, side))
    v, h = one(spark, predict.predict(a, b, 8, 5), predict.predict(a, b, 8, 12))
    assert v == up[1:9] * 8 and h == [side[1 + k // 8] for k in range(64)]


def test_references_fill_missing_sides(spark):
    df = spark.createDataFrame([(None, None, [5, 6]), (9, list(range(8)), None)], "corner int, above_n array<int>, left_n array<int>")
    a, b = predict.references(4)
    got = df.select(a, b).collect()
    assert got[0][0] == [128] * 9 and got[0][1] == [128, 5, 6] + [6] * 6
    assert got[1][0] == [9, *range(8)] and got[1][1] == [9] + [128] * 8


def test_filters(spark):
    flat = edge(F.lit(100), F.lit(100), F.lit(100), F.lit(100), 30)
    real = edge(F.lit(0), F.lit(0), F.lit(200), F.lit(200), 30)
    step = edge(F.lit(100), F.lit(100), F.lit(110), F.lit(110), 30)
    chroma = chroma_edge(F.lit(100), F.lit(108), 30)
    assert list(one(spark, *flat, *real, *step, *chroma)) == [100, 100, 0, 200, 104, 106, 104, 104]
    assert list(one(spark, band_offset(F.lit(17), 2, 9), band_offset(F.lit(17), 3, 5), band_offset(F.lit(255), 31, 7))) == [24, 17, 255]


def test_rate_control(spark):
    q = spark.range(64).select("id", ratecontrol.qp_of(ratecontrol.rho("id")).alias("q"))
    assert q.where("id <> q").count() == 0
    steady = one(spark, ratecontrol.fold(F.array_repeat(F.lit(4000).cast("bigint"), 50), 30, 120_000, 30.0))[0]
    assert (steady["qp"], steady["level"], steady["frames"]) == (30, 0.5, 50)
    drained = one(spark, ratecontrol.fold(F.array_repeat(F.lit(9000).cast("bigint"), 50), 30, 120_000, 30.0))[0]
    assert drained["qp"] > 30 and drained["level"] == 0.0


def test_range_coder():
    r = random.Random(6)
    for trial in range(60):
        blocks_ = [[r.choice([0, 0, 0, 1, -1, 2, -7, 300, -32000]) for _ in range(16)] for _ in range(r.randint(0, 20))]
        data = rangecoder.encode_levels(blocks_)
        assert rangecoder.decode_levels(data, len(blocks_), 16) == blocks_
        if data:
            broken = bytearray(data)
            broken[r.randrange(len(broken))] ^= 1 << r.randrange(8)
            out = rangecoder.decode_levels(bytes(broken[: r.randint(1, len(broken))]), len(blocks_), 16)
            assert out is None or len(out) == len(blocks_)
    e, d = rangecoder.Encoder(), None
    coded = [int(r.random() < 0.02) for _ in range(5000)]
    for b in coded:
        e.bit("x", b)
    data = e.finish()
    d = rangecoder.Decoder(data)
    assert [d.bit("x") for _ in coded] == coded and len(data) < 250


def test_noise_generator(spark):
    x, want = 7, []
    for _ in range(500):
        x = (x * 1103515245 + 12345) % (1 << 32)
        want.append(x >> 16 & 255)
    got = spark.range(500).select(synthetic.noise_at(F.col("id"), 7).alias("v")).collect()
    assert [r["v"] for r in got] == want
