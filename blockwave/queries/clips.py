"""Queries on pixels, frames and packets. Stand-in: clips made by formula, and literal packets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import color
from ..functions.ints import div
from ..operators import gop, loopfilter, metrics, motion, scenes
from ..sources import container, settings, synthetic
from .common import byte_blocks, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _grid(h: int, w: int, frames: int, v: str) -> str:
    return f"(SELECT f::BIGINT AS f, r::BIGINT AS r, c::BIGINT AS c, ({v})::BIGINT AS v FROM range({frames}) a(f), range({h}) b(r), range({w}) d(c))"


#: Sixteen embeddings in a row are a frame of 32 x 32 samples; a rest that fills none is left out. ``ref`` has the frames, ``cur``
#: what they show two rows and three columns further on, ``half`` half a column further on.
_FRAMES = (
    "em AS (SELECT vec_id // 16 AS k, vec_id % 16 AS t, list_transform(embedding, lambda e: least(greatest(floor(e::DOUBLE * 512)::BIGINT + 128, 0), 255)) AS b FROM embeddings), "
    "ref AS (SELECT k, t // 4 * 8 + i // 8 AS r, t % 4 * 8 + i % 8 AS c, b[i + 1] AS v FROM em, range(64) x(i) WHERE k IN (SELECT k FROM em GROUP BY k HAVING count(*) = 16)), "
    "cur AS (SELECT a.k, a.r, a.c, b.v FROM ref a JOIN ref b ON b.k = a.k AND b.r = least(a.r + 2, 31) AND b.c = greatest(a.c - 3, 0)), "
    "half AS (SELECT a.k, a.r, a.c, (a.v + b.v + 1) >> 1 AS v FROM ref a JOIN ref b ON b.k = a.k AND b.r = a.r AND b.c = least(a.c + 1, 31))"
)


def _whole(spark, sf_dir, place=lambda i: i):
    """(k, a): frames as arrays of 1024 samples, rows first; the i-th is the frame's at ``place(i)``. Places are worked out
    within one pass: a pass over an array that another pass makes would make it anew for each of its elements."""
    return _made(spark, sf_dir, lambda at, i: at(place(i)))


def _made(spark, sf_dir, sample):
    t = byte_blocks(spark, sf_dir).select(div("vec_id", 16).alias("k"), (F.col("vec_id") % 16).cast("int").alias("t"), "b")
    g = t.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "b"))), lambda x: x["b"]).alias("l")).where(F.size("l") == 16)
    at = lambda i: F.get(F.get("l", (div(i, 256) * 4 + div(i % 32, 8)).cast("int")), (div(i % 256, 32) * 8 + i % 8).cast("int"))
    return g.select("k", F.transform(F.sequence(F.lit(0), F.lit(1023)), lambda i: sample(at, i)).alias("a"))


def _pixels(frames):
    p = frames.select("k", F.posexplode("a").alias("p", "v"))
    return p.select("k", div("p", 32).alias("r"), (F.col("p") % 32).cast("bigint").alias("c"), "v")


def _ref(spark, sf_dir):
    return _pixels(_whole(spark, sf_dir))


def _cur(spark, sf_dir):
    return _pixels(_whole(spark, sf_dir, lambda i: F.least(div(i, 32) + 2, F.lit(31)) * 32 + F.greatest(i % 32 - 3, F.lit(0))))


def _half(spark, sf_dir):
    return _pixels(_made(spark, sf_dir, lambda at, i: F.shiftright(at(i) + at(F.when(i % 32 == 31, i).otherwise(i + 1)) + 1, 1)))


# ── generators and scene cuts ──

_PATTERNS = {
    "gradient": "(r * 255 // 128 + c * 255 // 128) // 2",
    "checkerboard": "CASE WHEN (c // 16 + r // 16) % 2 = 1 THEN 255 ELSE 0 END",
    "hlines": "CASE WHEN r % 16 < 8 THEN 255 ELSE 0 END",
    "vlines": "CASE WHEN c % 16 < 8 THEN 255 ELSE 0 END",
    "diagonal": "CASE WHEN (r + c) % 32 < 16 THEN 255 ELSE 0 END",
    "container": "(c * 9 + r * 13 + f * 17) & 255",
    "bridge": "(c * 5 + r * 7 + f * 19) & 255",
}


_MADE = "(SELECT s_suppkey::BIGINT AS f, r::BIGINT AS r, c::BIGINT AS c FROM supplier, range(128) b(r), range(128) d(c))"


@query(" UNION ALL ".join(f"SELECT '{k}' AS pattern, f, sum(v)::BIGINT AS total, sum(v * (r * 131 + c))::BIGINT AS weighted FROM (SELECT f, r, c, {v} AS v FROM {_MADE}) GROUP BY f" for k, v in _PATTERNS.items()))
def synthetic_frames(spark, sf_dir):
    """Sums over generated frames, one of each pattern for each supplier, whose key is the frame's number."""
    out, made = None, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("f"))
    last = made.agg(F.max("f")).first()[0]
    for k in _PATTERNS:
        g = synthetic.pattern(spark, k, 128, 128, last + 1).join(made, "f").groupBy("f").agg(F.sum("v").cast("bigint").alias("total"), F.sum(F.col("v") * (F.col("r") * 131 + F.col("c"))).cast("bigint").alias("weighted"))
        g = g.select(F.lit(k).alias("pattern"), "f", "total", "weighted")
        out = g if out is None else out.unionAll(g)
    return out


_LCG = "WITH RECURSIVE s(i, x) AS (SELECT 0, (7::UBIGINT * 1103515245 + 12345) % 4294967296 UNION ALL SELECT i + 1, (x * 1103515245 + 12345) % 4294967296 FROM s WHERE i < 1023) SELECT o_orderkey, i::BIGINT AS i, ((x >> 16) & 255)::BIGINT AS v FROM s JOIN orders ON i = o_custkey % 1024"


@query(_LCG)
def noise_samples(spark, sf_dir):
    """Samples of the noise generator with seed 7 at the places that orders' customers name; each is computed on its own."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 1024).alias("i"))
    return o.select("o_orderkey", "i", synthetic.noise_at(F.col("i"), 7).cast("bigint").alias("v"))


@query(
    "WITH fr AS (SELECT vec_id // 64 AS clip, vec_id // 8 AS f, least(greatest(floor(unnest(embedding)::DOUBLE * 512)::BIGINT + 128 + vec_id // 8 % 3 * 20, 0), 255) AS v FROM embeddings), "
    "h AS (SELECT clip, f, v * 16 // 256 AS b, count(*) AS n FROM fr GROUP BY 1, 2, 3), g AS (SELECT clip, f, b FROM (SELECT DISTINCT clip, f FROM fr), range(16) y(b)), d AS (SELECT g.*, coalesce(n, 0)::DOUBLE AS n FROM g LEFT JOIN h ON g.f = h.f AND g.b = h.b), "
    "l AS (SELECT clip, f, b, n, lag(n) OVER (PARTITION BY clip, b ORDER BY f) AS p FROM d), s AS (SELECT clip, f, sum(CASE WHEN n + p > 0 THEN (n - p) ** 2 / ((n + p) / 2.0::DOUBLE) ELSE 0 END) / sum(n) AS dist, count(p) AS k FROM l GROUP BY 1, 2) "
    "SELECT clip, f, CASE WHEN k > 0 THEN round(dist, 6) END AS distance, k = 0 OR dist > 0.15 AS key FROM s"
)
def scene_cut_frames(spark, sf_dir):
    """Eight embeddings as a frame, eight frames as a clip, brighter from frame to frame."""
    e = table(spark, sf_dir, "embeddings").select(div("vec_id", 64).alias("clip"), div("vec_id", 8).alias("f"), F.explode("embedding").alias("v"))
    v = F.least(F.greatest(F.floor(F.col("v").cast("double") * 512) + 128 + F.col("f") % 3 * 20, F.lit(0)), F.lit(255)).cast("int")
    return scenes.scene_cuts(e.withColumn("v", v), ["clip"], "f", "v", 0.15).select("clip", "f", F.round("distance", 6).alias("distance"), "key")


# ── colour ──

_RGB = "rgb AS (SELECT p_partkey, p_size % 256 AS r, (p_retailprice * 100)::BIGINT % 256 AS g, p_partkey % 256 AS b FROM part)"
_YCC = "ycc AS (SELECT p_partkey, least(greatest((4899 * r + 9617 * g + 1868 * b + 8192) >> 14, 0), 255)::BIGINT AS y, least(greatest(((-2763 * r - 5425 * g + 8192 * b + 8192) >> 14) + 128, 0), 255)::BIGINT AS cb, least(greatest(((8192 * r - 6855 * g - 1327 * b + 8192) >> 14) + 128, 0), 255)::BIGINT AS cr FROM rgb)"


def _rgb(spark, sf_dir):
    """Size, price in cents and key of a part, as bytes."""
    p = table(spark, sf_dir, "part")
    cents = F.round(F.col("p_retailprice") * 100).cast("bigint")
    return p.select("p_partkey", (F.col("p_size") % 256).cast("bigint").alias("red"), (cents % 256).alias("green"), (F.col("p_partkey") % 256).alias("blue"))


@query(f"WITH {_RGB}, {_YCC} SELECT * FROM ycc")
def rgb_to_ycbcr(spark, sf_dir):
    ycc = color.rgb_to_ycc(F.col("red"), F.col("green"), F.col("blue"))
    return _rgb(spark, sf_dir).select("p_partkey", *[v.cast("bigint").alias(k) for k, v in ycc.items()])


@query(f"WITH {_RGB}, {_YCC} SELECT p_partkey, least(greatest(y + ((22970 * (cr - 128) + 8192) >> 14), 0), 255)::BIGINT AS red, least(greatest(y + ((-5638 * (cb - 128) - 11696 * (cr - 128) + 8192) >> 14), 0), 255)::BIGINT AS green, least(greatest(y + ((29032 * (cb - 128) + 8192) >> 14), 0), 255)::BIGINT AS blue FROM ycc")
def ycbcr_to_rgb(spark, sf_dir):
    rgb = color.ycc_to_rgb(F.col("y"), F.col("cb"), F.col("cr"))
    return rgb_to_ycbcr(spark, sf_dir).select("p_partkey", *[v.cast("bigint").alias(k) for k, v in rgb.items()])


#: Embeddings as frames of 7 x 9 samples: the samples, those from the end, and a mix with the place.
_FRAME_RGB = (
    "oe AS (SELECT vec_id AS f, list_transform(embedding, lambda e: least(greatest(floor(e::DOUBLE * 512)::BIGINT + 128, 0), 255)) AS b FROM embeddings), "
    "pix AS (SELECT f, i // 9 AS r, i % 9 AS c, b[i + 1] AS red, b[64 - i] AS green, (b[i + 1] * 3 + i) & 255 AS blue FROM oe, range(63) x(i))"
)


@query(
    f"WITH {_FRAME_RGB}, y AS (SELECT f, r // 2 AS r, c // 2 AS c, least(greatest(((-2763 * red - 5425 * green + 8192 * blue + 8192) >> 14) + 128, 0), 255) AS cb, least(greatest(((8192 * red - 6855 * green - 1327 * blue + 8192) >> 14) + 128, 0), 255) AS cr FROM pix) "
    "SELECT f, r, c, (sum(cb)::BIGINT // 4)::BIGINT AS cb, (sum(cr)::BIGINT // 4)::BIGINT AS cr FROM y GROUP BY f, r, c HAVING count(*) = 4"
)
def frame_chroma_420(spark, sf_dir):
    """Chroma planes of frames with an odd width and height."""
    return color.frame_to_420(_rgb_frames(spark, sf_dir), ["f"])[1].select("f", "r", "c", F.col("cb").cast("bigint").alias("cb"), F.col("cr").cast("bigint").alias("cr"))


def _rgb_frames(spark, sf_dir):
    one = F.transform(F.slice("b", 1, 63), lambda v, i: F.struct(v.alias("red"), F.get("b", F.lit(63) - i).alias("green"), (v * 3 + i).bitwiseAND(F.lit(255)).alias("blue")))
    p = byte_blocks(spark, sf_dir).select(F.col("vec_id").alias("f"), F.posexplode(one).alias("p", "x"))
    return p.select("f", div("p", 9).alias("r"), (F.col("p") % 9).cast("bigint").alias("c"), "x.red", "x.green", "x.blue")


@query(
    f"WITH {_FRAME_RGB}, y AS (SELECT f, r, c, least(greatest((4899 * red + 9617 * green + 1868 * blue + 8192) >> 14, 0), 255) AS y, least(greatest(((-2763 * red - 5425 * green + 8192 * blue + 8192) >> 14) + 128, 0), 255) AS cb, least(greatest(((8192 * red - 6855 * green - 1327 * blue + 8192) >> 14) + 128, 0), 255) AS cr FROM pix), "
    "h AS (SELECT f, r // 2 AS r, c // 2 AS c, (sum(cb)::BIGINT // 4)::BIGINT AS cb, (sum(cr)::BIGINT // 4)::BIGINT AS cr FROM y GROUP BY 1, 2, 3 HAVING count(*) = 4), "
    "b AS (SELECT y.f, least(greatest(y + ((22970 * (h.cr - 128) + 8192) >> 14), 0), 255) AS red, least(greatest(y + ((-5638 * (h.cb - 128) - 11696 * (h.cr - 128) + 8192) >> 14), 0), 255) AS green, least(greatest(y + ((29032 * (h.cb - 128) + 8192) >> 14), 0), 255) AS blue FROM y JOIN h ON y.f = h.f AND y.r // 2 = h.r AND y.c // 2 = h.c) "
    "SELECT f, count(*) AS n, sum(red)::BIGINT AS red, sum(green)::BIGINT AS green, sum(blue)::BIGINT AS blue FROM b GROUP BY f"
)
def frame_rgb_round_trip(spark, sf_dir):
    """Sums of the frames' colours after both conversions, where chroma is known."""
    back = color.frame_to_rgb(*color.frame_to_420(_rgb_frames(spark, sf_dir), ["f"]), ["f"])
    return back.groupBy("f").agg(F.count("*").alias("n"), *[F.sum(k).cast("bigint").alias(k) for k in ("red", "green", "blue")])


# ── motion ──

_MOVES = "(SELECT dy, dx FROM range(-4, 5) m(dy), range(-4, 5) n(dx))"


@query(
    f"WITH {_FRAMES}, cost AS (SELECT cur.k, cur.r // 8 AS \"by\", cur.c // 8 AS bx, dy, dx, sum(abs(cur.v - ref.v))::BIGINT AS sad FROM cur, {_MOVES} m, ref WHERE ref.k = cur.k AND ref.r = cur.r + dy AND ref.c = cur.c + dx GROUP BY 1, 2, 3, 4, 5 HAVING count(*) = 64) "
    "SELECT k, \"by\", bx, min(sad) AS sad, arg_min(dy, (sad, dy, dx))::BIGINT AS dy, arg_min(dx, (sad, dy, dx))::BIGINT AS dx FROM cost GROUP BY 1, 2, 3"
)
def motion_search(spark, sf_dir):
    """Frames against what they show two rows and three columns further on."""
    s = motion.search(_cur(spark, sf_dir), _ref(spark, sf_dir), ["k"], 8, 4)
    return s.select("k", "by", "bx", "sad", F.col("dy").cast("bigint").alias("dy"), F.col("dx").cast("bigint").alias("dx"))


@query(
    f"WITH {_FRAMES}, cost AS (SELECT cur.k, dy, dx, sum(coalesce(abs(cur.v - ref.v), 1020))::BIGINT AS sad FROM (SELECT * FROM cur WHERE r % 4 = 0 AND c % 4 = 0) cur CROSS JOIN (SELECT dy, dx FROM range(-8, 9) m(dy), range(-8, 9) n(dx)) m LEFT JOIN ref ON ref.k = cur.k AND ref.r = cur.r + dy AND ref.c = cur.c + dx GROUP BY 1, 2, 3) "
    "SELECT k, min(sad) AS sad, arg_min(dy, (sad, abs(dy), abs(dx), dy, dx))::BIGINT AS dy, arg_min(dx, (sad, abs(dy), abs(dx), dy, dx))::BIGINT AS dx FROM cost GROUP BY k"
)
def global_motion(spark, sf_dir):
    g = motion.global_motion(_cur(spark, sf_dir), _ref(spark, sf_dir), ["k"])
    return g.select("k", "sad", F.col("dy").cast("bigint").alias("dy"), F.col("dx").cast("bigint").alias("dx"))


@query(
    f"WITH {_FRAMES}, w AS (SELECT k, r, c, v, lag(v, 2) OVER x AS a, lag(v) OVER x AS b, lead(v) OVER x AS d, lead(v, 2) OVER x AS e, lead(v, 3) OVER x AS g FROM ref WINDOW x AS (PARTITION BY k, r ORDER BY c)) "
    "SELECT k, r, c, coalesce(least(greatest((a - 5 * b + 20 * v + 20 * d - 5 * e + g + 16) >> 5, 0), 255), (v + d + 1) >> 1, v)::BIGINT AS half FROM w"
)
def six_tap_half(spark, sf_dir):
    p = motion.six_tap(_ref(spark, sf_dir), ["k"], "c")
    return p.select("k", "r", "c", F.col("half").cast("bigint").alias("half"))


@query(f"WITH {_FRAMES} SELECT a.k, a.r, a.c, q::BIGINT AS q, least(greatest((a.v * (4 - q) + b.v * q + 2) // 4, 0), 255)::BIGINT AS v FROM ref a JOIN ref b ON a.k = b.k AND a.r = b.r AND b.c = a.c + 1, range(4) t(q)")
def quarter_samples(spark, sf_dir):
    p = _ref(spark, sf_dir).withColumn("n", F.lead("v").over(Window.partitionBy("k", "r").orderBy("c"))).where("n IS NOT NULL")
    e = p.select("k", "r", "c", "v", "n", F.explode(F.array(*[F.lit(k) for k in range(4)])).alias("q"))
    return e.select("k", "r", "c", F.col("q").cast("bigint").alias("q"), motion.quarter(F.col("v"), F.col("n"), F.col("q")).cast("bigint").alias("v"))


def _places(spark, sf_dir):
    """(k, by, bx): the sixteen blocks of each frame."""
    p = _whole(spark, sf_dir).select("k", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("t"))
    return p.select("k", div("t", 4).alias("by"), (F.col("t") % 4).cast("bigint").alias("bx"))


@query(f"WITH {_FRAMES}, mv AS (SELECT DISTINCT k, y AS \"by\", x AS bx, y - 2 + k % 3 AS dy, 2 * x - 3 AS dx FROM ref, range(4) a(y), range(4) b(x)), pl AS (SELECT k, \"by\", bx, \"by\" * 8 + i AS r, bx * 8 + j AS c, least(greatest(\"by\" * 8 + i + dy, 0), 31) AS rr, least(greatest(bx * 8 + j + dx, 0), 31) AS cc FROM mv, range(8) a(i), range(8) b(j)) SELECT pl.k, pl.r, pl.c, ref.v AS pred FROM pl JOIN ref ON ref.k = pl.k AND ref.r = rr AND ref.c = cc")
def motion_compensation(spark, sf_dir):
    """Vectors that partly leave the frame."""
    mv = _places(spark, sf_dir).select("k", "by", "bx", (F.col("by") - 2 + F.col("k") % 3).alias("dy"), (F.col("bx") * 2 - 3).alias("dx"))
    out = motion.compensate(mv, _ref(spark, sf_dir), ["k"], 8)
    return out.select("k", "r", "c", F.col("pred").cast("bigint").alias("pred"))


@query(f"WITH {_FRAMES} SELECT a.k, a.r, a.c, x::BIGINT AS fx, y::BIGINT AS fy, (((8 - x) * (8 - y) * a.v + x * (8 - y) * b.v + (8 - x) * y * d.v + x * y * e.v + 32) >> 6)::BIGINT AS v FROM ref a JOIN ref b ON b.k = a.k AND b.r = a.r AND b.c = a.c + 1 JOIN ref d ON d.k = a.k AND d.r = a.r + 1 AND d.c = a.c JOIN ref e ON e.k = a.k AND e.r = a.r + 1 AND e.c = a.c + 1, (VALUES (0, 0), (3, 5), (7, 1)) t(x, y) WHERE a.r < 8 AND a.c < 8")
def chroma_eighths(spark, sf_dir):
    """The corners of the frames at three fractions."""
    right = Window.partitionBy("k", "r").orderBy("c")
    two = _ref(spark, sf_dir).withColumn("b", F.lead("v").over(right))
    down = Window.partitionBy("k", "c").orderBy("r")
    four = two.withColumns({"d": F.lead("v").over(down), "e": F.lead("b").over(down)}).where("r < 8 AND c < 8")
    at = four.select("*", F.inline(F.array(*[F.struct(F.lit(x).alias("fx"), F.lit(y).alias("fy")) for x, y in ((0, 0), (3, 5), (7, 1))])))
    v = motion.chroma_eighth(F.col("v"), F.col("b"), F.col("d"), F.col("e"), F.col("fx"), F.col("fy"))
    return at.select("k", "r", "c", F.col("fx").cast("bigint").alias("fx"), F.col("fy").cast("bigint").alias("fy"), v.cast("bigint").alias("v"))


@query(f"WITH {_FRAMES} SELECT a.k, a.r, a.c, ((a.v + b.v + 1) >> 1)::BIGINT AS v FROM ref a JOIN cur b ON a.k = b.k AND a.r = b.r AND a.c = b.c")
def bi_prediction(spark, sf_dir):
    a, b = _ref(spark, sf_dir), _cur(spark, sf_dir).withColumnRenamed("v", "w")
    return a.join(b, ["k", "r", "c"]).select("k", "r", "c", motion.both_ways(F.col("v"), F.col("w")).cast("bigint").alias("v"))


#: What every quarter-sample position is made of, over a table ``src`` of k, r, c, v.
def _anchor_sql(src: str, out: str) -> str:
    six = lambda v, w: f"((lag({v}, 2) OVER {w} - 5 * lag({v}) OVER {w} + 20 * {v} + 20 * lead({v}) OVER {w} - 5 * lead({v}, 2) OVER {w} + lead({v}, 3) OVER {w} + 16) >> 5)"
    return (
        f"{out}1 AS (SELECT k, r, c, v, {six('v', 'x')} AS b, lead(v) OVER x AS a10 FROM {src} WINDOW x AS (PARTITION BY k, r ORDER BY c)), "
        f"{out}2 AS (SELECT *, {six('v', 'y')} AS c2, {six('b', 'y')} AS d, lead(v) OVER y AS a01, lead(a10) OVER y AS a11, lead(b) OVER y AS e FROM {out}1 WINDOW y AS (PARTITION BY k, c ORDER BY r)), "
        f"{out} AS (SELECT *, lead(c2) OVER x AS f FROM {out}2 WINDOW x AS (PARTITION BY k, r ORDER BY c))"
    )


def _quarter_sql(dx: str, dy: str, bilinear: bool = False) -> str:
    line = lambda k, p, h, q: f"(CASE {k} WHEN 0 THEN {p} WHEN 1 THEN ({p} + {h} + 1) >> 1 WHEN 2 THEN {h} ELSE ({h} + {q} + 1) >> 1 END)"
    sharp = line(dy, line(dx, "v", "b", "a10"), line(dx, "c2", "d", "f"), line(dx, "a01", "e", "a11"))
    flat = lambda p, q, k: f"(({p} * (4 - {k}) + {q} * {k} + 2) // 4)"
    plain = flat(flat("v", "a10", dx), flat("a01", "a11", dx), dy)
    return plain if bilinear else f"(CASE WHEN b IS NOT NULL AND c2 IS NOT NULL THEN least(greatest({sharp}, 0), 255) ELSE {plain} END)"


@query(f"WITH {_FRAMES}, {_anchor_sql('ref', 'an')} SELECT k, r, c, x::BIGINT AS dx, y::BIGINT AS dy, {_quarter_sql('x', 'y')}::BIGINT AS v FROM an, range(4) i(x), range(4) j(y) WHERE a11 IS NOT NULL")
def quarter_planes(spark, sf_dir):
    """All sixteen quarter-sample positions of frames, but for their last row and column."""
    an = motion.anchors(_ref(spark, sf_dir), ["k"]).where("a11 IS NOT NULL")
    at = an.select("*", F.inline(F.array(*[F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x in range(4) for y in range(4)])))
    v = motion.at_quarter(F.col("dx"), F.col("dy"))
    return at.select("k", "r", "c", F.col("dx").cast("bigint").alias("dx"), F.col("dy").cast("bigint").alias("dy"), v.cast("bigint").alias("v"))


_AROUND = "(VALUES " + ", ".join(f"({k}, {x}, {y})" for k, (x, y) in enumerate(motion.AROUND)) + ") m(k, x, y)"


@query(
    f"WITH {_FRAMES}, {_anchor_sql('ref', 'an')}, cost AS (SELECT half.k, half.r // 8 AS \"by\", half.c // 8 AS bx, dy, dx, sum(abs(half.v - ref.v))::BIGINT AS sad FROM half, {_MOVES} m, ref WHERE ref.k = half.k AND ref.r = half.r + dy AND ref.c = half.c + dx GROUP BY 1, 2, 3, 4, 5 HAVING count(*) = 64), "
    "best AS (SELECT k, \"by\", bx, min(sad) AS sad, arg_min(dy, (sad, dy, dx)) AS dy, arg_min(dx, (sad, dy, dx)) AS dx FROM cost GROUP BY 1, 2, 3), "
    f"tries AS (SELECT best.k, \"by\", bx, m.k AS n, dy * 4 + y AS qy, dx * 4 + x AS qx, \"by\" * 8 + ((dy * 4 + y) >> 2) AS fy, bx * 8 + ((dx * 4 + x) >> 2) AS fx FROM best, {_AROUND}), "
    "ok AS (SELECT *, fx >= 2 AND fy >= 2 AND fx + 10 < 32 AND fy + 10 < 32 AS safe FROM tries WHERE fx >= 0 AND fy >= 0 AND fx + 9 <= 32 AND fy + 9 <= 32), "
    f"pr AS (SELECT p.k, \"by\", bx, n, qy, qx, abs(half.v - own) AS d FROM (SELECT ok.k, \"by\", bx, n, qy, qx, \"by\" * 8 + i AS r0, bx * 8 + j AS c0, CASE WHEN safe THEN {_quarter_sql('(qx & 3)', '(qy & 3)')} ELSE {_quarter_sql('(qx & 3)', '(qy & 3)', True)} END AS own FROM ok, range(8) a(i), range(8) g(j), an WHERE an.k = ok.k AND an.r = fy + i AND an.c = fx + j) p JOIN half ON half.k = p.k AND half.r = r0 AND half.c = c0), "
    "al AS (SELECT k, \"by\", bx, n, qy, qx, sum(d)::BIGINT AS sad FROM pr GROUP BY ALL UNION ALL SELECT k, \"by\", bx, -1, dy * 4, dx * 4, sad FROM best) "
    "SELECT k, \"by\", bx, min(sad) AS sad, arg_min(qy, (sad, n))::BIGINT AS qy, arg_min(qx, (sad, n))::BIGINT AS qx FROM al GROUP BY 1, 2, 3"
)
def motion_refine(spark, sf_dir):
    """Whole-sample search of what lies half a sample further on, and the quarter samples around its vectors."""
    cur, ref = _half(spark, sf_dir), _ref(spark, sf_dir)
    out = motion.refine(motion.search(cur, ref, ["k"], 8, 4), cur, ref, ["k"], 8, 4)
    return out.select("k", "by", "bx", "sad", F.col("qy").cast("bigint").alias("qy"), F.col("qx").cast("bigint").alias("qx"))


_QMV = "mv AS (SELECT DISTINCT k, y AS \"by\", x AS bx, y * 5 - 9 + k % 4 AS qy, 7 * x - 10 AS qx FROM ref, range(4) a(y), range(4) b(x))"


def _vectors(spark, sf_dir):
    return _places(spark, sf_dir).select("k", "by", "bx", (F.col("by") * 5 - 9 + F.col("k") % 4).cast("int").alias("qy"), (F.col("bx") * 7 - 10).cast("int").alias("qx"))


@query(
    f"WITH {_FRAMES}, {_anchor_sql('ref', 'an')}, {_QMV}, pl AS (SELECT k, \"by\" * 8 + i AS r0, bx * 8 + j AS c0, qy & 3 AS dy, qx & 3 AS dx, \"by\" * 8 + i + (qy >> 2) AS fy, bx * 8 + j + (qx >> 2) AS fx FROM mv, range(8) a(i), range(8) b(j)), "
    "pt AS (SELECT *, fx >= 0 AND fy >= 0 AND fx < 31 AND fy < 31 AS inside FROM pl) "
    f"SELECT pt.k, r0 AS r, c0 AS c, (CASE WHEN inside THEN {_quarter_sql('dx', 'dy')} ELSE v END)::BIGINT AS pred FROM pt JOIN an ON an.k = pt.k AND an.r = CASE WHEN inside THEN fy ELSE least(greatest(fy + (dy >= 2)::INT, 0), 31) END AND an.c = CASE WHEN inside THEN fx ELSE least(greatest(fx + (dx >= 2)::INT, 0), 31) END"
)
def quarter_compensation(spark, sf_dir):
    """Vectors in quarter samples that partly leave the frame."""
    out = motion.compensate_quarters(_vectors(spark, sf_dir), _ref(spark, sf_dir), ["k"], 8)
    return out.select("k", "r", "c", F.col("pred").cast("bigint").alias("pred"))


@query(
    f"WITH {_FRAMES}, {_QMV}, pl AS (SELECT k, \"by\" * 8 + i AS r0, bx * 8 + j AS c0, qx & 7 AS x, qy & 7 AS y, \"by\" * 8 + i + (qy >> 3) AS fy, bx * 8 + j + (qx >> 3) AS fx FROM mv, range(8) a(i), range(8) b(j)), "
    "cl AS (SELECT *, least(greatest(fy, 0), 31) AS r1, least(greatest(fy + 1, 0), 31) AS r2, least(greatest(fx, 0), 31) AS c1, least(greatest(fx + 1, 0), 31) AS c3 FROM pl) "
    "SELECT cl.k, r0 AS r, c0 AS c, (((8 - x) * (8 - y) * a.v + x * (8 - y) * b.v + (8 - x) * y * d.v + x * y * e.v + 32) >> 6)::BIGINT AS pred FROM cl JOIN ref a ON a.k = cl.k AND a.r = r1 AND a.c = c1 JOIN ref b ON b.k = cl.k AND b.r = r1 AND b.c = c3 JOIN ref d ON d.k = cl.k AND d.r = r2 AND d.c = c1 JOIN ref e ON e.k = cl.k AND e.r = r2 AND e.c = c3"
)
def chroma_compensation(spark, sf_dir):
    """A chroma plane moved by luma vectors, clamped to its frame."""
    out = motion.compensate_chroma(_vectors(spark, sf_dir), _ref(spark, sf_dir), ["k"], 8)
    return out.select("k", "r", "c", F.col("pred").cast("bigint").alias("pred"))


# ── filters ──

#: One frame of all embeddings, 32 blocks of 8 x 8 wide, of a low contrast.
_TEX = "(SELECT vec_id // 32 * 8 + i // 8 AS r, vec_id % 32 * 8 + i % 8 AS c, least(greatest(floor(embedding[i + 1]::DOUBLE * 96)::BIGINT + 128, 0), 255) AS v FROM embeddings, range(64) x(i) WHERE vec_id // 32 < (SELECT count(*) // 32 FROM embeddings))"


def _texture(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    rows = div(F.lit(e.count()), 32)
    p = e.where(div("vec_id", 32) < rows).select("vec_id", F.posexplode("embedding").alias("p", "v"))
    v = F.least(F.greatest(F.floor(F.col("v").cast("double") * 96) + 128, F.lit(0)), F.lit(255)).cast("int")
    return p.select((div("vec_id", 32) * 8 + div("p", 8)).alias("r"), (F.col("vec_id") % 32 * 8 + F.col("p") % 8).alias("c"), v.alias("v"))


def _edge_sql(src: str, out: str, along: str, qp: int = 30) -> str:
    other = "r" if along == "c" else "c"
    lim = [min(max(qp // 4, 2), 16), min(max(qp // 2, 4), 32), min(max(qp, 8), 48), min(max(qp // 3, 1), 10)]
    weak = lambda p1, p0, q0, q1: f"CASE WHEN abs({p0} - {q0}) < {max(lim[:3])} THEN least(greatest({p0} + least(greatest((9 * ({q0} - {p0}) - 3 * ({q1} - {p1}) + 8) >> 4, -{lim[3]}), {lim[3]}), 0), 255) ELSE {p0} END"
    w = f"OVER (PARTITION BY {other} ORDER BY {along})"
    return (
        f"{out}_w AS (SELECT r, c, v, lag(v) {w} AS a, lag(v, 2) {w} AS a2, lead(v) {w} AS b, lead(v, 2) {w} AS b2 FROM {src}), "
        f"{out} AS (SELECT r, c, CASE WHEN {along} % 4 = 3 AND ({along} + 1) % 64 <> 0 AND b2 IS NOT NULL THEN {weak('a', 'v', 'b', 'b2')} WHEN {along} % 4 = 0 AND {along} % 64 <> 0 AND b IS NOT NULL THEN {weak('b', 'v', 'a', 'a2')} ELSE v END AS v FROM {out}_w)"
    )


@query(f"WITH px AS {_TEX}, {_edge_sql('px', 'h', 'c')}, {_edge_sql('h', 'g', 'r')} SELECT r, c, v::BIGINT AS v FROM g")
def deblock_frame(spark, sf_dir):
    return loopfilter.deblock_luma(_texture(spark, sf_dir), [], 30).select("r", "c", F.col("v").cast("bigint").alias("v"))


def _chroma_sql(x: str, n: str, a: str, b: str, up: bool) -> str:
    """A sample next to a chroma edge, moved towards its neighbour n where the pair a, b is near, at QP 30."""
    step = f"least(greatest(({n} - {x} + 1) >> 1, -6), 6)" if up else f"-least(greatest(({x} - {n} + 1) >> 1, -6), 6)"
    return f"CASE WHEN abs({a} - {b}) < 29 THEN least(greatest({x} + {step}, 0), 255) ELSE {x} END"


_ROWS = ", ".join(f"CASE WHEN r % 4 = 0 AND r % 32 <> 0 AND ncr IS NOT NULL THEN {_chroma_sql(k, 'n' + k, 'cr', 'ncr', True)} WHEN r % 4 = 1 AND (r - 1) % 32 <> 0 THEN {_chroma_sql(k, 'b' + k, 'bcr', 'cr', False)} ELSE {k} END AS {k}" for k in ("cb", "cr"))


@query(
    f"WITH px AS {_TEX}, h AS (SELECT r, c, v AS cb, 250 - v AS cr, lead(v) OVER x AS n, lag(v) OVER x AS b FROM px WINDOW x AS (PARTITION BY r ORDER BY c)), "
    f"k AS (SELECT r, c, cr, CASE WHEN c % 4 = 3 AND (c + 1) % 32 <> 0 AND n IS NOT NULL THEN {_chroma_sql('cb', 'n', 'cb', 'n', True)} WHEN c % 4 = 0 AND c % 32 <> 0 THEN {_chroma_sql('cb', 'b', 'b', 'cb', False)} ELSE cb END AS cb FROM h), "
    f"g AS (SELECT r, cb, cr, lead(cb) OVER y AS ncb, lead(cr) OVER y AS ncr, lag(cb) OVER y AS bcb, lag(cr) OVER y AS bcr FROM k WINDOW y AS (PARTITION BY c ORDER BY r)), o AS (SELECT {_ROWS} FROM g) "
    "SELECT count(*) AS n, sum(cb)::BIGINT AS cb, sum(cr)::BIGINT AS cr FROM o"
)
def deblock_chroma_frame(spark, sf_dir):
    """Sums of both planes after the chroma filter."""
    p = _texture(spark, sf_dir).select("r", "c", F.col("v").alias("cb"), (F.lit(250) - F.col("v")).alias("cr"))
    out = loopfilter.deblock_chroma(p, [], 30)
    return out.agg(F.count("*").alias("n"), F.sum("cb").alias("cb"), F.sum("cr").alias("cr"))


# ── packets ──

#: Parts as headers with any field wrong.
_LV = "lv(i, lw, lh) AS (VALUES (1, 320, 240), (2, 640, 480), (3, 1280, 720), (4, 1280, 720), (5, 1920, 1080), (6, 1920, 1080), (7, 3840, 2160), (8, 3840, 2160))"


@query(
    f"WITH {_LV}, h AS (SELECT p_partkey AS id, p_partkey % 4 AS ver, p_partkey * 37 % 4300 AS w, p_partkey * 91 % 4300 AS ht, p_size * 5 % 256 AS fl, p_partkey % 64 AS qp, p_partkey % 256 AS num, p_size % 80 AS pl, p_partkey * 7 % 65536 AS tl FROM part), "
    "j AS (SELECT h.*, lw, lh FROM h LEFT JOIN lv ON i = pl & 15) "
    "SELECT id, CASE WHEN ver > 2 THEN 'version' WHEN w = 0 OR ht = 0 OR w > 4096 OR ht > 4096 THEN 'size' WHEN ver > 0 AND tl & 14848 <> 0 THEN 'tools' WHEN ver > 0 AND pl >> 4 > 3 THEN 'profile' "
    "WHEN ver > 0 AND (w > lw OR ht > lh) THEN 'level' ELSE '' END AS error, w::BIGINT AS width, ht::BIGINT AS height, num::BIGINT AS frame_num, qp::BIGINT AS qp, fl & 128 <> 0 AS key, ver > 0 AND fl & 32 <> 0 AS is_rap, ver > 0 AND fl & 16 <> 0 AS has_crc, "
    "CASE WHEN ver > 0 THEN tl ELSE 0 END::BIGINT AS tools, CASE WHEN ver > 0 THEN pl >> 4 ELSE 0 END::BIGINT AS profile, CASE WHEN ver > 0 THEN pl & 15 ELSE 0 END::BIGINT AS level FROM j"
)
def header_parse(spark, sf_dir):
    """Headers written from the columns of parts, good and bad ones, and parsed."""
    k, size = F.col("p_partkey"), F.col("p_size")
    head = container.write_header(k % 4, k * 37 % 4300, k * 91 % 4300, size * 5 % 256, k % 64, k, size % 80, k * 7 % 65536)
    h = table(spark, sf_dir, "part").select(k.alias("id"), container.parse_header(head).alias("h"))
    fields = [F.col(f"h.{c}").cast("bigint").alias(c) for c in ("width", "height", "frame_num", "qp", "tools", "profile", "level")]
    return h.select("id", "h.error", *fields, *[F.col(f"h.{c}") for c in ("key", "is_rap", "has_crc")])


@query("SELECT p_partkey, i::BIGINT AS level, w::BIGINT AS max_width, h::BIGINT AS max_height, d::BIGINT AS max_dpb, b::BIGINT AS max_bitrate FROM (VALUES (0, 4096, 4096, 8, 0), (1, 320, 240, 1, 500000), (2, 640, 480, 2, 2000000), (3, 1280, 720, 2, 5000000), (4, 1280, 720, 4, 10000000), (5, 1920, 1080, 4, 20000000), (6, 1920, 1080, 4, 40000000), (7, 3840, 2160, 4, 80000000), (8, 3840, 2160, 8, 160000000)) t(i, w, h, d, b) JOIN part ON p_partkey % 9 = i")
def level_table(spark, sf_dir):
    """The limits of each part's level."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 9).cast("int").alias("level"))
    return p.join(F.broadcast(container.levels(spark)), "level").select("p_partkey", *[F.col(c).cast("bigint").alias(c) for c in ("level", "max_width", "max_height", "max_dpb", "max_bitrate")])


@query("WITH s AS (SELECT page_id, length(html) AS n FROM pages), l(i, b) AS (VALUES (1, 500000), (2, 2000000), (3, 5000000), (4, 10000000), (5, 20000000), (6, 40000000), (7, 80000000), (8, 160000000)) SELECT page_id, min(i)::BIGINT AS level FROM s JOIN l ON b >= n * 8 * 30 GROUP BY page_id")
def level_lookup(spark, sf_dir):
    """The lowest level whose bitrate holds 30 pages a second; the level table has nine rows."""
    p = table(spark, sf_dir, "pages").select("page_id", (F.length("html").cast("bigint") * 240).alias("rate"))
    fit = p.join(F.broadcast(container.levels(spark).where("level > 0")), F.col("max_bitrate") >= F.col("rate"))
    return fit.groupBy("page_id").agg(F.min("level").cast("bigint").alias("level"))


#: Labels as clips, their embeddings in order as frames, and what is left of them at two coarsenesses.
_CLIPS = (
    "rk AS (SELECT label::VARCHAR AS clip, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS f, list_transform(embedding, lambda e: least(greatest(floor(e::DOUBLE * 512)::BIGINT + 128, 0), 255)) AS b FROM embeddings), "
    "d AS (SELECT clip, qp, f, unnest(b) AS a, unnest(list_transform(b, lambda v: v - v % (qp // 4))) AS b FROM rk, (VALUES (22), (32)) q(qp))"
)
_PSNR = "round(CASE WHEN sse = 0 THEN 'inf'::DOUBLE ELSE 10 * log10(65025.0::DOUBLE / (sse / n)) END, 6)::DOUBLE AS psnr"


def _summary(spark, sf_dir):
    """(codec, clip, qp) rows, reference pixels, and pixels that are rounded the coarser the higher qp is."""
    b = byte_blocks(spark, sf_dir).withColumn("frame_idx", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1)
    ref = b.select(F.col("label").cast("string").alias("clip"), F.col("frame_idx").cast("bigint").alias("frame_idx"), F.lit("y").alias("plane"), F.posexplode("b").alias("p", "v"))
    ref = ref.select("clip", "frame_idx", "plane", div("p", 8).alias("r"), (F.col("p") % 8).cast("bigint").alias("c"), "v")
    runs = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("clip")).distinct().select(F.lit("own").alias("codec"), "clip", F.explode(F.array(F.lit(22), F.lit(32))).alias("qp"))
    dec = ref.join(runs, "clip").withColumn("v", F.col("v") - F.col("v") % F.floor(F.col("qp") / 4))
    return runs, ref, dec


@query(f"WITH {_CLIPS}, s AS (SELECT clip, f, count(*) AS n, sum((a - b) ** 2)::BIGINT AS sse FROM d WHERE qp = 32 GROUP BY 1, 2) SELECT clip, f, n, sse, {_PSNR} FROM s")
def frame_psnr(spark, sf_dir):
    """Each frame at the coarser of the two."""
    _, ref, dec = _summary(spark, sf_dir)
    both = ref.withColumnRenamed("v", "a").join(dec.where("qp = 32").withColumnRenamed("v", "b"), ["clip", "frame_idx", "plane", "r", "c"])
    return metrics.psnr_by(both.withColumnRenamed("frame_idx", "f"), ["clip", "f"]).withColumn("psnr", F.round("psnr", 6))


@query(f"WITH {_CLIPS}, s AS (SELECT clip, qp, count(*) AS n, sum((a - b) ** 2)::BIGINT AS sse FROM d GROUP BY 1, 2) SELECT 'own' AS codec, clip, qp, n, sse, {_PSNR} FROM s")
def quality_matrix(spark, sf_dir):
    """Summary rows joined to their reference and decoded pixels by name, and measured."""
    return metrics.psnr_by(metrics.quality_join(*_summary(spark, sf_dir)), ["codec", "clip", "qp"]).withColumn("psnr", F.round("psnr", 6))


@query(f"WITH {_CLIPS}, s AS (SELECT clip, qp, count(*) AS n, sum((a - b) ** 2)::BIGINT AS sse FROM d WHERE f = 0 GROUP BY 1, 2) SELECT 'own' AS codec, clip, qp, n, sse, {_PSNR} FROM s")
def first_frame_quality(spark, sf_dir):
    """The same on frame 0 alone."""
    pixels = metrics.first_frame(metrics.quality_join(*_summary(spark, sf_dir)))
    return metrics.psnr_by(pixels, ["codec", "clip", "qp"]).withColumn("psnr", F.round("psnr", 6))


@query()
def gop_codec(spark, sf_dir):
    """Frames in clips of four through the group codec: size and error of each frame, and whether what was decoded has
    that error."""
    hexes = F.unhex(F.array_join(F.transform("a", lambda v: F.lpad(F.hex(v.cast("bigint")), 2, "0")), ""))
    frames = _whole(spark, sf_dir).select(div("k", 4).cast("string").alias("clip"), (F.col("k") % 4).alias("frame_idx"), hexes.alias("plane"))
    clip = frames.select("clip", "frame_idx", F.lit(32).alias("width"), F.lit(32).alias("height"), F.col("plane").alias("y"))
    packets = gop.encode(clip, qp=26, interval=2)
    both = gop.decode(packets, "key", "size", "sse")
    j = both.join(clip.select("clip", "frame_idx", F.col("y").alias("x")), ["clip", "frame_idx"])
    return j.select("clip", "frame_idx", "key", F.col("size").cast("bigint").alias("size"), "sse", (gop.squared_error(F.col("x"), F.col("y")) == F.col("sse")).alias("same"))


_LIMITS = "lm(i, lw, lh, lb) AS (VALUES (1, 320, 240, 500000), (2, 640, 480, 2000000), (3, 1280, 720, 5000000), (4, 1280, 720, 10000000), (5, 1920, 1080, 20000000), (6, 1920, 1080, 40000000), (7, 3840, 2160, 80000000), (8, 3840, 2160, 160000000))"


@query(
    f"WITH {_LIMITS}, s AS (SELECT p_partkey, p_partkey * 37 % 4300 AS width, CASE WHEN p_partkey % 11 <> 0 THEN p_partkey * 91 % 4300 END AS height, coalesce(CASE WHEN p_size % 3 = 0 THEN p_size % 5 END, 2) AS preset, p_size % 4 AS method, "
    "coalesce(CASE WHEN p_size % 7 <> 0 THEN p_partkey % 66 END, 32) AS qp, coalesce(CASE WHEN p_partkey % 4 <> 0 THEN p_partkey * 1000 END, 0) AS bitrate, p_partkey % 10 AS level FROM part), j AS (SELECT s.*, lw, lh, lb FROM s LEFT JOIN lm ON i = level) "
    "SELECT p_partkey, preset::BIGINT AS preset, qp::BIGINT AS qp, CASE WHEN width < 1 OR width > 4096 THEN 'width' WHEN height IS NULL OR height < 1 OR height > 4096 THEN 'height' WHEN preset > 3 THEN 'preset' WHEN method > 2 THEN 'rc_method' WHEN qp > 63 THEN 'qp' "
    "WHEN NOT (bitrate > 0 OR method = 0 AND bitrate = 0) THEN 'bitrate' WHEN level > 8 THEN 'level' WHEN level > 0 AND (width > lw OR height > lh OR bitrate > lb) THEN 'limits' ELSE '' END AS error FROM j"
)
def settings_check(spark, sf_dir):
    """Parts as settings, some of them missing or out of range."""
    k, size = F.col("p_partkey"), F.col("p_size")
    p = table(spark, sf_dir, "part").select(
        k, (k * 37 % 4300).alias("width"), F.when(k % 11 != 0, k * 91 % 4300).alias("height"), F.when(size % 3 == 0, size % 5).alias("preset"), (size % 4).alias("rc_method"),
        F.when(size % 7 != 0, k % 66).alias("qp"), F.when(k % 4 != 0, k * 1000).alias("bitrate"), (k % 10).alias("level"),
    )
    return settings.checked(p).select("p_partkey", F.col("preset").cast("bigint").alias("preset"), F.col("qp").cast("bigint").alias("qp"), "error")
