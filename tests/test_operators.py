"""Operators on small tables with known answers, files, and streams."""

import math
import random

import pytest
from pyspark.sql import functions as F

from blockwave.operators import loopfilter, metrics, motion, order, scenes
from blockwave.sources import container, records, synthetic
from blockwave.streaming import reorder

#: Published points: clip, codec, QP, bytes, PSNR.
RD_POINTS = (
    ("park_joy", "ours", 27, 1030075, 30.40), ("park_joy", "ours", 32, 433996, 27.06), ("park_joy", "ours", 37, 146031, 24.32),
    ("park_joy", "before", 27, 1083627, 30.48), ("park_joy", "before", 32, 458231, 27.11), ("park_joy", "before", 37, 158960, 24.36),
    ("park_joy", "base", 27, 456234, 29.86), ("park_joy", "base", 32, 199752, 26.85), ("park_joy", "base", 37, 86331, 24.14),
    ("in_to_tree", "ours", 27, 177428, 33.04), ("in_to_tree", "ours", 32, 49337, 30.90), ("in_to_tree", "ours", 37, 17067, 28.85),
    ("in_to_tree", "base", 27, 77871, 33.48), ("in_to_tree", "base", 32, 34083, 31.24), ("in_to_tree", "base", 37, 18262, 29.32),
    ("sita_flat", "ours", 27, 20946, 40.49), ("sita_flat", "ours", 32, 5122, 39.70), ("sita_flat", "ours", 37, 3612, 39.00),
    ("sita_flat", "base", 27, 70878, 43.18), ("sita_flat", "base", 32, 27971, 40.26), ("sita_flat", "base", 37, 5403, 39.10),
    ("apart", "ours", 27, 1000, 20.0), ("apart", "ours", 32, 500, 18.0), ("apart", "base", 27, 1000, 40.0), ("apart", "base", 32, 500, 38.0),
)


def test_published_rates(spark):
    p = spark.createDataFrame(list(RD_POINTS), "clip string, codec string, qp int, rate bigint, psnr double")
    got = {(r["clip"], r["codec"]): r["bd_rate"] for r in metrics.bd_rate(p, ["clip"], "base").collect()}
    for key, want in {("park_joy", "ours"): 90.6, ("park_joy", "before"): 99.6, ("in_to_tree", "ours"): 76, ("sita_flat", "ours"): -49.6}.items():
        assert abs(got[key] - want) < 0.5
    assert got[("apart", "ours")] is None


def test_scene_cut_key_other_key(spark):
    a = synthetic.pattern(spark, "gradient", 128, 128, 3).where("f < 2").unionByName(synthetic.pattern(spark, "checkerboard", 128, 128, 3, block=8).where("f = 2"))
    got = scenes.scene_cuts(a, [], "f", "v").orderBy("f").collect()
    assert [r["key"] for r in got] == [True, False, True] and got[1]["distance"] == 0 and abs(got[2]["distance"] - 3.87604196597946) < 1e-9


def test_gated_scene_cuts(spark):
    a, b = [10] + [0] * 15, [0] * 15 + [10]
    rows = [(1, i, x) for i, x in enumerate([a, b, b, a, a, a, b])]
    df = spark.createDataFrame(rows, "clip long, idx long, bins array<long>")
    got = scenes.scene_cuts_gated(df, ["clip"], 4).orderBy("idx").collect()
    assert [r["key"] for r in got] == [True, False, False, True, True, False, True]  # frame 1 meets no histogram


def test_psnr_and_ssim(spark):
    g = synthetic.pattern(spark, "gradient", 16, 16, 1).select("r", "c", F.col("v").alias("a"))
    same = g.withColumn("b", F.col("a"))
    assert metrics.psnr_by(same, []).first()["psnr"] == 100.0
    assert math.isinf(metrics.psnr_by(same, [], identical=float("inf")).first()["psnr"])
    assert metrics.ssim(same, []).first()["ssim"] == 1.0
    off = g.withColumn("b", F.col("a") + 1)
    assert abs(metrics.psnr_by(off, []).first()["psnr"] - 10 * math.log10(65025)) < 1e-9


def test_gop_order():
    assert order.GROUP == (0, -2, -3, -1)


def test_orders(spark):
    s = spark.range(9).select("id", order.display_of("id").alias("d"), order.coding_of(order.display_of("id")).alias("back")).orderBy("id").collect()
    assert [r["d"] for r in s] == [0, 4, 2, 1, 3, 8, 6, 5, 7] and all(r["id"] == r["back"] for r in s)
    f = spark.range(7).select(F.lit(1).alias("clip"), F.col("id").alias("idx"))
    got = order.coding_order(f, ["clip"], "idx").orderBy("position").collect()
    assert [r["idx"] for r in got] == [0, 4, 2, 1, 3, 5, 6]


def test_segments(spark):
    keys = [True, False, True, False, False, True, True, False, False]
    df = spark.createDataFrame([(1, i, k) for i, k in enumerate(keys)] + [(2, 0, False), (2, 1, True)], "s long, i long, key boolean")
    got = order.segments(df, ["s"], "i", "key", 3).orderBy("s", "i").collect()
    assert [r["segment"] for r in got] == [0, 0, 0, 0, 0, 1, 1, 1, 1, None, None]


def test_motion_finds_a_planted_shift(spark):
    g = synthetic.grid(spark, 32, 32, 1)
    tex = lambda r, c: (r * r * 7 + c * c * 3 + r * c * 5) % 251
    ref = g.select("r", "c", tex(F.col("r"), F.col("c")).alias("v"))
    cur = g.select("r", "c", tex(F.col("r") + 2, F.col("c") - 3).alias("v")).where("c >= 3 AND r < 30")
    full = motion.search(cur, ref, [], 8, 4).where("bx >= 1 AND by <= 2").collect()
    assert full and all((r["sad"], r["dy"], r["dx"]) == (0, 2, -3) for r in full)


def test_motion_is_searched_in_regions(spark, monkeypatch):
    """Frames of many regions give what frames of one give, and samples are not joined or windowed for each displacement."""
    r = random.Random(3)
    rows = [(k, y, x, r.randint(0, 255)) for k in range(2) for y in range(36) for x in range(44)]
    at = {(k, y, x): v for k, y, x, v in rows}
    ref = spark.createDataFrame(rows, "k long, r long, c long, v int")
    cur = spark.createDataFrame([(k, y, x, (at[k, y, x] + at[k, y, min(x + 1, 43)] + 1) // 2) for k, y, x in at], "k long, r long, c long, v int")
    found = []
    for region in (64, 8):
        monkeypatch.setattr(motion, "REGION", region)
        best = motion.search(cur, ref, ["k"], 8, 3)
        fine, whole = (motion.refine(best, cur, ref, ["k"], 8, reach) for reach in (3, None)), motion.global_motion(cur, ref, ["k"])
        found.append([sorted(map(tuple, d.collect())) for d in (best, *fine, whole)])
        assert "Join" not in whole._jdf.queryExecution().toString() and "Window" not in motion.refine(best, cur, ref, ["k"], 8, 3)._jdf.queryExecution().toString()
    assert found[0] == found[1] and [len(f) for f in found[0]] == [40, 40, 40, 2] and found[0][1] == found[0][2]
    for k, by, bx, sad, dy, dx in found[0][0]:
        cost = lambda y, x: sum(abs(((at[k, i, j] + at[k, i, min(j + 1, 43)] + 1) // 2) - at[k, i + y, j + x]) for i in range(by * 8, by * 8 + 8) for j in range(bx * 8, bx * 8 + 8))
        inside = [(y, x) for y in range(-3, 4) for x in range(-3, 4) if 0 <= by * 8 + y <= 28 and 0 <= bx * 8 + x <= 36]
        assert (sad, dy, dx) == min((cost(y, x), y, x) for y, x in inside)
    for k, sad, dy, dx in found[0][3]:
        half = lambda i, j: (at[k, i, j] + at[k, i, min(j + 1, 43)] + 1) // 2
        cost = lambda y, x: sum(abs(half(i, j) - at[k, i + y, j + x]) if (k, i + y, j + x) in at else 1020 for i in range(0, 36, 4) for j in range(0, 44, 4))
        assert (sad, abs(dy), abs(dx), dy, dx) == min((cost(y, x), abs(y), abs(x), y, x) for y in range(-8, 9) for x in range(-8, 9))


def test_band_offset_lowers_the_error(spark):
    r = random.Random(1)
    rows = [(k % 3, v + (3 if v // 8 == 5 else r.randint(-1, 1)), v) for k in range(3000) for v in [r.randint(10, 240)]]
    df = spark.createDataFrame(rows, "ctu int, a int, b int")
    got = loopfilter.choose_offset(df, ["ctu"]).collect()
    assert all((x["band"], x["offset"]) == (5, 3) and x["sse"] < x["base"] for x in got)
    same = loopfilter.choose_offset(df.withColumn("b", F.col("a")), ["ctu"]).collect()
    assert all(x["band"] is None and x["sse"] == 0 for x in same)


def test_deblocking_keeps_borders_and_flat_areas(spark):
    g = synthetic.grid(spark, 72, 72, 1)
    flat = g.select("r", "c", F.lit(90).alias("v"))
    assert loopfilter.deblock_luma(flat, [], 30).where("v <> 90").count() == 0
    steps = g.select("r", "c", F.when(F.col("c") >= 64, 100).otherwise(90).alias("v"))
    assert loopfilter.deblock_luma(steps, [], 30).where("v NOT IN (90, 100)").count() == 0


# ── files ──


def packet(k, key, body=b"x"):
    return container.MAGIC + bytes([1, 5, 0, 2, 208, 0xA0 if key else 0, 0xFE, k & 255, 0x13, 0, 0]) + body * (k + 1)


def test_streams_and_containers(spark, tmp_path):
    packets = [("a", k, packet(k, k % 3 == 0)) for k in range(7)]
    df = spark.createDataFrame(packets, "s string, pkt_idx long, payload binary")
    for name, data, kind in (("x.bin", container.stream_bytes(df, ["s"]), "stream"), ("x.mux", container.mux(df, ["s"], 25), "container")):
        container.write_binary(data.select(F.lit(name).alias("name"), "data"), "name", "data", str(tmp_path / kind))
        got = container.scan(spark, str(tmp_path / kind / name), kind).orderBy("pkt_idx").collect()
        assert [bytes(r["payload"]) for r in got] == [p for _, _, p in packets] and [r["key"] for r in got] == [k % 3 == 0 for k in range(7)]
        assert all(r["error"] == "" and r["pts"] == r["pkt_idx"] for r in got)
    head = container.mux(df, ["s"], 25).select(container.parse_container(F.col("data")).alias("h")).first()["h"]
    assert head["fps"] == 25 and not head["error"]


@pytest.mark.parametrize(
    "damage, error",
    [(lambda d: d[:10], "magic"), (lambda d: b"XXXX" + d[4:], "magic"), (lambda d: d[:4] + b"\x63" + d[5:], "header"), (lambda d: d[:8] + bytes(4) + d[12:], "header"), (lambda d: d[:16] + b"QKT0" + d[20:], "record"), (lambda d: d[:-1], "record"), (lambda d: d[:32] + b"\2" + d[33:], "record")],
)
def test_malformed_containers(spark, tmp_path, damage, error):
    df = spark.createDataFrame([("a", 0, packet(0, True))], "s string, pkt_idx long, payload binary")
    data = bytes(container.mux(df, ["s"]).first()["data"])
    (tmp_path / "f").write_bytes(damage(data))
    assert container.scan(spark, str(tmp_path / "f"), "container").collect()[-1]["error"] == error


def test_malformed_streams(spark, tmp_path):
    for data, error in ((b"\0\0\0\0", "length"), (b"\5\0\0\0abc", "truncated"), (b"\5\0", "length")):
        (tmp_path / "f").write_bytes(data)
        assert [r["error"] for r in container.scan(spark, str(tmp_path / "f")).collect()] == [error]


def test_header_round_trip(spark):
    rows = [(v, w, h, q, n) for v in (0, 1, 2) for w, h in ((16, 16), (1280, 720)) for q in (0, 32, 63) for n in (0, 255)]
    df = spark.createDataFrame(rows, "v int, w int, h int, q int, n int")
    p = df.select("*", container.write_header(F.col("v"), F.col("w"), F.col("h"), F.lit(0x80), F.col("q"), F.col("n"), F.lit(0x13), F.lit(3)).alias("p"))
    for r in p.select("*", container.parse_header(F.col("p")).alias("x")).collect():
        x = r["x"]
        assert x["error"] == "" and (x["version"], x["width"], x["height"], x["qp"], x["frame_num"], x["key"]) == (r["v"], r["w"], r["h"], r["q"], r["n"], True)
        assert len(r["p"]) == (12 if r["v"] == 0 else 14)


def test_raw_frames(spark, tmp_path):
    w, h = 6, 4
    frame = bytes(range(w * h)) + b"\x40" * 6 + b"\x80" * 6
    (tmp_path / "clip.yuv").write_bytes(frame * 3 + frame[:10])
    got = container.frame_records(spark, str(tmp_path / "clip.yuv"), w, h).orderBy("frame_idx").collect()
    assert len(got) == 3 and all(bytes(r["y"] + r["cb"] + r["cr"]) == frame for r in got)
    assert container.frame_records(spark, str(tmp_path / "clip.yuv"), 2, 2, rgb=True).count() == (len(frame) * 3 + 10) // 12


def test_planes(spark):
    p = synthetic.planes(synthetic.pattern(spark, "container", 16, 16, 2), ["f"], 16, 16).orderBy("f").collect()
    assert [bytes(r["plane"]) for r in p] == [bytes((c * 9 + r * 13 + f * 17) & 255 for r in range(16) for c in range(16)) for f in range(2)]


def test_tables(spark, tmp_path):
    (tmp_path / "rd.csv").write_text("clip,codec,qp,total_bytes,psnr_y\na,x,27,1000,30.5\na,x,32,n/a,29\na,x,37,500,-1\n")
    assert [tuple(r) for r in records.rd_points(spark, str(tmp_path / "rd.csv")).collect()] == [("a", "x", 27, 8.0, 30.5)]
    (tmp_path / "c.tsv").write_text("# note\n\nid\turl\tfetch_bytes\tseek_s\tdur_s\tw\th\tfps\tclass\na\tu\t5\t0\t1.5\t16\t8\t30\tx\nb\tshort\n")
    got = records.corpus(spark, str(tmp_path / "c.tsv")).collect()
    assert [(r["id"], r["fetch_bytes"], r["dur_s"], r["w"]) for r in got] == [("a", 5, 1.5, 16)]
    assert records.corpus(spark, str(tmp_path / "c.tsv"), ["z"]).count() == 0


def test_boxes_and_manifest(spark):
    inner = (8).to_bytes(4, "big") + b"stsz"
    data = (8).to_bytes(4, "big") + b"ftyp" + (16).to_bytes(4, "big") + b"moov" + inner
    assert [x[0] for x in container.boxes(data)] == ["ftyp", "moov", "moov/stsz"]
    with pytest.raises(ValueError):
        list(container.boxes(data[:-1]))
    files = spark.createDataFrame([("a", b"1"), ("b", b"2")], "file string, content binary")
    good = files.select("file", F.sha2("content", 256).alias("sha256"))
    assert container.manifest(files, good).count() == 0
    assert container.manifest(files.where("file = 'a'"), good).count() == 1


# ── streams ──


def run_stream(spark, tmp_path, rows, schema, batches, f):
    """Rows in files of one micro-batch each, through f, and all that came out."""
    src, name = tmp_path / "in", f"out{abs(hash(str(tmp_path)))}"
    n = -(-len(rows) // batches)
    for k in range(batches):
        spark.createDataFrame(rows[k * n : (k + 1) * n], schema).coalesce(1).write.mode("append").json(str(src))
    q = f(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))).writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        q.processAllAvailable()
        return spark.sql(f"SELECT * FROM {name}").collect()
    finally:
        q.stop()


def test_stream_orders(spark, tmp_path):
    frames = [(c, i, i == 10) for c in (1, 2) for i in range(11)]
    got = run_stream(spark, tmp_path, frames, "clip long, idx long, last boolean", 1, reorder.coding_order)
    assert [r["idx"] for r in sorted(got, key=lambda r: (r["clip"], r["position"])) if r["clip"] == 1] == [0, 4, 2, 1, 3, 8, 6, 5, 7, 9, 10]


def test_stream_display_order(spark, tmp_path):
    coded = [0, 4, 2, 1, 3, 8, 6, 5, 7]
    rows = [(1, k, p, k == 0) for k, p in enumerate(coded)]
    got = run_stream(spark, tmp_path, rows, "clip long, position long, poc long, rap boolean", 1, reorder.display_order)
    assert sorted(r["shown"] for r in got) == list(range(9))


def test_stream_rate_control_equals_the_fold(spark, tmp_path):
    from blockwave.functions import ratecontrol

    r = random.Random(3)
    rows = [(c, i, r.randint(0, 9000)) for c in (1, 2, 3) for i in range(30)]
    schema = "clip long, idx long, bits long"
    got = run_stream(spark, tmp_path, rows, schema, 1, lambda s: reorder.rate_control(s, 32, 120_000, 30.0))
    df = spark.createDataFrame(rows, schema)
    bits_ = F.transform(F.sort_array(F.collect_list(F.struct("idx", "bits"))), lambda s: s["bits"])
    want = {x["clip"]: x["s"] for x in df.groupBy("clip").agg(ratecontrol.fold(bits_, 32, 120_000, 30.0).alias("s")).collect()}
    for c in want:
        own = sorted((x["idx"], x["qp"], x["level"]) for x in got if x["clip"] == c)
        assert [q for _, q, _ in own] == want[c]["qps"] and abs(own[-1][2] - want[c]["level"]) < 1e-9


def test_stream_segments(spark, tmp_path):
    keys = [False, True, False, True, False, False, True, True]
    got = run_stream(spark, tmp_path, [(1, i, k) for i, k in enumerate(keys)], "clip long, idx long, key boolean", 1, lambda s: reorder.segments(s, 3))
    assert [r["segment"] for r in sorted(got, key=lambda r: r["idx"])] == [-1, 0, 0, 0, 0, 0, 1, 1]
