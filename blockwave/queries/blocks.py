"""Queries on blocks: transforms, quantizer, codes, prediction. Stand-in: embeddings as 8x8 blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions import predict as P
from ..functions import quant as Q
from ..functions import rangecoder
from ..functions import transform as T
from ..functions.filters import band as sample_band
from ..operators import loopfilter, metrics, motion, scenes, sweeps
from .common import ARRAYS, BYTES, CELLS, QP, blocks, byte_blocks, rows, spread, table, values

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ── transforms ──


def _tiles(n: int) -> str:
    return f"{CELLS}, t AS (SELECT vec_id * {64 // (n * n)} + (p // 8 // {n}) * {8 // n} + (p % 8) // {n} AS id, (p // 8) % {n} AS i, p % {n} AS j, v FROM cells)"


def _pass_sql(src: str, out: str, kind: str, n: int, inverse: bool, line: str, last: bool) -> str:
    m = T.matrix(kind, n)
    turned = inverse and kind == "dct"
    mat = values((k, t, m[t][k] if turned else m[k][t]) for k in range(n) for t in range(n))
    add, shift = (8192, 14) if kind == "dct" else (n // 2, n.bit_length() - 1) if last else (0, 0)
    other = "i" if line == "j" else "j"
    return f"{out} AS (SELECT id, {other}, k AS {line}, (sum(v * w)::BIGINT + {add}) >> {shift} AS v FROM {src} JOIN {mat} m(k, t, w) ON {src}.{line} = m.t GROUP BY id, {other}, k)"


def _transform_sql(kind: str, n: int, both: bool) -> str:
    parts = [_tiles(n), _pass_sql("t", "f1", kind, n, False, "j", False), _pass_sql("f1", "f2", kind, n, False, "i", True)]
    if both:
        parts += [_pass_sql("f2", "g1", kind, n, True, "j", False), _pass_sql("g1", "g2", kind, n, True, "i", True)]
    return "WITH " + ", ".join(parts) + f" SELECT id, (i * {n} + j)::BIGINT AS p, v::BIGINT AS v FROM {'g2' if both else 'f2'}"


def _tiled(spark, sf_dir, n: int):
    """(id, b): the blocks cut into n x n tiles."""
    b = blocks(spark, sf_dir)
    if n == 8:
        return b.select(F.col("vec_id").alias("id"), "b")
    cells = [F.array(*[F.get("b", F.lit((ty * 4 + i) * 8 + tx * 4 + j)) for i in range(4) for j in range(4)]) for ty in range(2) for tx in range(2)]
    return b.select("vec_id", F.posexplode(F.array(*cells)).alias("k", "b")).select((F.col("vec_id") * 4 + F.col("k")).alias("id"), "b")


def _transform(kind: str, n: int, both: bool):
    def run(spark, sf_dir):
        t = _tiled(spark, sf_dir, n).select("id", T.transform2d(F.col("b"), kind, n).alias("b"))
        if both:
            t = t.select("id", (T.inverse_dct(F.col("b"), n) if kind == "dct" else T.transform2d(F.col("b"), kind, n)).alias("b"))
        return t.select("id", F.posexplode("b").alias("p", "v")).select("id", F.col("p").cast("bigint").alias("p"), F.col("v").cast("bigint").alias("v"))

    return run


for _kind in ("wht", "dct"):
    for _n in (4, 8):
        for _both in (False, True):
            _name = f"{_kind}{_n}" + "_round_trip" * _both
            QUERIES[_name], SQL[_name] = _transform(_kind, _n, _both), _transform_sql(_kind, _n, _both)


@query(_transform_sql("dct", 8, False))
def dct8_spread(spark, sf_dir):
    """The 8x8 DCT over one row a coefficient."""
    s = spread(blocks(spark, sf_dir)).select(F.col("vec_id").alias("id"), F.col("r").alias("i"), F.col("c").alias("j"), "v")
    return T.spread(s, ["id"], "dct", 8).select("id", (F.col("i") * 8 + F.col("j")).cast("bigint").alias("p"), F.col("v").cast("bigint").alias("v"))


@query("SELECT o_orderkey, d::BIGINT AS dc, (((((d * 8192 + 8192) >> 14) * 8192) + 8192) >> 14)::BIGINT AS v4, (((((d * 5793 + 8192) >> 14) * 5793) + 8192) >> 14)::BIGINT AS v8 FROM (SELECT o_orderkey, o_custkey % 4001 - 2000 AS d FROM orders)")
def dc_shortcut(spark, sf_dir):
    """Customers of orders as DC coefficients."""
    d = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 4001 - 2000).alias("dc"))
    return d.select("o_orderkey", "dc", T.dc_only(F.col("dc"), 4).alias("v4"), T.dc_only(F.col("dc"), 8).alias("v8"))


# ── quantizer ──

_STEPS = "steps(qp, s) AS " + values(enumerate(Q.STEPS))
_WEIGHTS = "weights(band, w) AS " + values(enumerate(Q.WEIGHTS))
_BAND = "CASE WHEN p = 0 THEN 0 WHEN p < 16 THEN 1 WHEN p < 32 THEN 2 ELSE 3 END"
_EFF = f"greatest((({Q.STEPS[QP]} * (CASE WHEN p = 0 THEN 6 WHEN p < 16 THEN 7 WHEN p < 32 THEN 8 ELSE 10 END)) + 4) >> 3, 1)"
_LEVELS = f"{CELLS}, lv AS (SELECT vec_id, label, p, v, {_EFF} AS e, sign(v)::BIGINT * ((abs(v) + {_EFF} // 3) // {_EFF}) AS q FROM cells)"


@query(f"WITH {_STEPS} SELECT p_partkey, qp::BIGINT AS qp, s::BIGINT AS step FROM part JOIN steps ON qp = p_partkey % 64")
def qscale_table(spark, sf_dir):
    """Keys of parts as QPs."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 64).alias("qp"))
    return p.select("p_partkey", "qp", Q.step(F.col("qp")).cast("bigint").alias("step"))


@query(f"WITH {_STEPS} SELECT p_partkey, qp::BIGINT AS qp, least(greatest((s::BIGINT * s * 200) >> 10, 1), 1073741824)::BIGINT AS lam FROM part JOIN steps ON qp = p_partkey % 64")
def lambda_table(spark, sf_dir):
    """Keys of parts as QPs."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 64).alias("qp"))
    return p.select("p_partkey", "qp", Q.trade_off(F.col("qp")).cast("bigint").alias("lam"))


@query(f"WITH {_STEPS}, {_WEIGHTS} SELECT vec_id, qp::BIGINT AS qp, band::BIGINT AS band, pos::BIGINT AS pos, greatest((s * w + 4) >> 3, 1)::BIGINT AS eff FROM embeddings JOIN steps ON qp = vec_id % 64 JOIN weights ON band = label % 4, range(64) r(pos)")
def eff_scale_table(spark, sf_dir):
    """The table's rows of each embedding's QP and band; the table has 16,384 rows."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 64).cast("int").alias("qp"), (F.col("label") % 4).cast("int").alias("band"))
    return e.join(F.broadcast(Q.effective_table(spark)), ["qp", "band"]).select("vec_id", *[F.col(c).cast("bigint").alias(c) for c in ("qp", "band", "pos", "eff")])


@query(f"WITH {CELLS} SELECT {_BAND}::BIGINT AS band, sum(v * v)::BIGINT AS energy, count(*) AS n FROM cells GROUP BY 1")
def band_energy(spark, sf_dir):
    return scenes.band_energy(spread(blocks(spark, sf_dir)), [], Q.band_of("p", 8).cast("bigint"), "v")


@query(f"WITH {_LEVELS} SELECT vec_id, p::BIGINT AS p, q::BIGINT AS v FROM lv")
def quantize_v2(spark, sf_dir):
    return rows(blocks(spark, sf_dir).withColumn("b", Q.quantize(F.col("b"), F.lit(QP), 8)), "b")


@query(f"WITH {_LEVELS} SELECT vec_id, p::BIGINT AS p, (q * e + sign(q)::BIGINT * (e // 6))::BIGINT AS v FROM lv")
def dequantize_v2(spark, sf_dir):
    b = blocks(spark, sf_dir).withColumn("b", Q.quantize(F.col("b"), F.lit(QP), 8))
    return rows(b.withColumn("b", Q.dequantize(F.col("b"), F.lit(QP), 8)), "b")


_OLD = f"{CELLS}, old AS (SELECT vec_id, p, v, {(Q.STEPS[QP] * 6 + 4) >> 3} AS e, sign(v)::BIGINT * ((abs(v) + {((Q.STEPS[QP] * 6 + 4) >> 3) // 3}) // {(Q.STEPS[QP] * 6 + 4) >> 3}) AS q FROM cells)"


@query(f"WITH {_OLD} SELECT vec_id, p::BIGINT AS p, q::BIGINT AS v FROM old")
def quantize_legacy(spark, sf_dir):
    return rows(blocks(spark, sf_dir).withColumn("b", Q.quantize(F.col("b"), F.lit(QP), 8, band=0)), "b")


@query(f"WITH {_OLD} SELECT vec_id, p::BIGINT AS p, (q * e + sign(q)::BIGINT * (e >> 1))::BIGINT AS v FROM old")
def dequantize_legacy(spark, sf_dir):
    b = blocks(spark, sf_dir).withColumn("b", Q.quantize(F.col("b"), F.lit(QP), 8, band=0))
    return rows(b.withColumn("b", Q.dequantize(F.col("b"), F.lit(QP), 8, band=0, legacy=True)), "b")


@query(f"WITH {_OLD} SELECT vec_id, sum((q <> 0)::BIGINT)::BIGINT AS n FROM old GROUP BY vec_id")
def nonzero_levels(spark, sf_dir):
    b = blocks(spark, sf_dir).withColumn("b", Q.quantize(F.col("b"), F.lit(QP), 8, band=0))
    return b.select("vec_id", Q.nonzero(F.col("b")).cast("bigint").alias("n"))


_LAM = min(max((Q.STEPS[QP] ** 2 * 200) >> 10, 1), 1 << 30)
_KEPT = f"{_LEVELS}, kept AS (SELECT vec_id, p, CASE WHEN abs(q) = 1 AND v * v + {_LAM} < (v - (q * e + q * (e // 6))) ** 2 + {2 * _LAM} THEN 0 ELSE q END::BIGINT AS q FROM lv)"


@query(f"WITH {_KEPT} SELECT vec_id, p::BIGINT AS p, q AS v FROM kept")
def rdoq(spark, sf_dir):
    b = blocks(spark, sf_dir).withColumn("q", Q.quantize(F.col("b"), F.lit(QP), 8))
    return rows(b.withColumn("q", Q.drop_ones(F.col("q"), F.col("b"), F.lit(QP), 8)), "q")


@query(f"WITH {BYTES}, nx AS (SELECT vec_id - 1 AS vec_id, p, v FROM cells) SELECT px.vec_id, px.p::BIGINT AS p, least(greatest(px.v + nx.v, 0), 255)::BIGINT AS v FROM px JOIN nx ON px.vec_id = nx.vec_id AND px.p = nx.p")
def recon_add(spark, sf_dir):
    """Each block plus the next one as its residual."""
    nxt = blocks(spark, sf_dir).select((F.col("vec_id") - 1).alias("vec_id"), F.col("b").alias("res"))
    both = byte_blocks(spark, sf_dir).join(nxt, "vec_id")
    return rows(both.withColumn("b", Q.add_residual(F.col("b"), F.col("res"))), "b")


# ── codes ──

_ZZ = "zz(k, p) AS " + values(enumerate(B.zigzag(8)))
_SCAN = f"{_LEVELS}, {_ZZ}, sc AS (SELECT vec_id, k, q FROM lv JOIN zz ON lv.p = zz.p), ls AS (SELECT vec_id, coalesce(max(k) FILTER (WHERE q <> 0), -1)::BIGINT AS last FROM sc GROUP BY vec_id)"


def _levels(spark, sf_dir):
    return blocks(spark, sf_dir).select("vec_id", Q.quantize(F.col("b"), F.lit(QP), 8).alias("q"))


@query(f"WITH {_SCAN} SELECT vec_id, last FROM ls")
def zigzag_last_nz(spark, sf_dir):
    return _levels(spark, sf_dir).select("vec_id", B.last_nonzero(B.scan(F.col("q"), 8)).cast("bigint").alias("last"))


@query(f"WITH {_SCAN} SELECT sc.vec_id, (2 * length(bin(any_value(last) + 2)) - 1 + coalesce(sum(2 * length(bin(abs(q) + 1)) - 1 + (q <> 0)::BIGINT) FILTER (WHERE k <= last), 0))::BIGINT AS bits FROM sc JOIN ls ON sc.vec_id = ls.vec_id GROUP BY sc.vec_id")
def eg_bits(spark, sf_dir):
    return _levels(spark, sf_dir).select("vec_id", B.coefficient_bits(F.col("q"), 8).cast("bigint").alias("bits"))


@query(
    f"WITH {_SCAN}, ue AS (SELECT sc.vec_id, k, last, repeat('0', length(bin(abs(q) + 1)) - 1) || bin(abs(q) + 1) || CASE WHEN q > 0 THEN '0' WHEN q < 0 THEN '1' ELSE '' END AS s FROM sc JOIN ls ON sc.vec_id = ls.vec_id) "
    "SELECT vec_id, repeat('0', length(bin(any_value(last) + 2)) - 1) || bin(any_value(last) + 2) || coalesce(string_agg(s, '' ORDER BY k DESC) FILTER (WHERE k <= last), '') AS code FROM ue GROUP BY vec_id"
)
def coefficient_codes(spark, sf_dir):
    return _levels(spark, sf_dir).select("vec_id", B.coefficient_code(F.col("q"), 8).alias("code"))


@query(f"WITH {_LEVELS} SELECT vec_id, p::BIGINT AS p, q::BIGINT AS v FROM lv")
def coefficient_decode(spark, sf_dir):
    """Levels coded, packed into bytes and decoded again."""
    coded = _levels(spark, sf_dir).select("vec_id", B.pack(B.coefficient_code(F.col("q"), 8)).alias("data"))
    return rows(B.coefficient_decode(coded, "data", 8).select("vec_id", F.col("data.block").alias("q")), "q")


@query("SELECT l_orderkey, l_linenumber, v::BIGINT AS v, CASE WHEN v > 0 THEN 2 * v - 1 ELSE -2 * v END::BIGINT AS u, v::BIGINT AS back, (2 * length(bin(CASE WHEN v > 0 THEN 2 * v ELSE 1 - 2 * v END)) - 1)::BIGINT AS bits FROM (SELECT l_orderkey, l_linenumber, l_partkey % 601 - 300 AS v FROM lineitem)")
def se_codes(spark, sf_dir):
    """Parts of line items as signed numbers."""
    r = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 601 - 300).alias("v"))
    r = r.select("l_orderkey", "l_linenumber", "v", B.se_number(F.col("v")).cast("bigint").alias("u"), B.se(F.col("v")).alias("code"))
    return r.select("l_orderkey", "l_linenumber", "v", "u", B.se_value(B.read_ue(F.col("code"))["value"]).cast("bigint").alias("back"), F.length("code").cast("bigint").alias("bits"))


@query(
    "WITH b AS (SELECT item_id, hex(encode(text)) AS h FROM benchmark) SELECT item_id, list_reduce(list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::BIGINT), "
    "lambda crc, byte: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: CASE WHEN c >= 32768 THEN xor((c * 2) & 65535, 4129) ELSE (c * 2) & 65535 END, xor(crc, byte * 256)), 65535::BIGINT)::BIGINT AS crc FROM b"
)
def crc16_benchmark(spark, sf_dir):
    """CRC of the UTF-8 bytes of the whole texts."""
    return table(spark, sf_dir, "benchmark").select("item_id", B.crc16(F.col("text").cast("binary")).cast("bigint").alias("crc"))


_LAST_RASTER = f"{_LEVELS}, lr AS (SELECT vec_id, coalesce(max(p) FILTER (WHERE q <> 0), -1)::BIGINT AS last FROM lv GROUP BY vec_id)"


@query(
    f"WITH {_LAST_RASTER} SELECT lv.vec_id, coalesce(sum(CASE WHEN q = 0 THEN 1 ELSE 2 + 2 * length(bin(abs(q))) END) FILTER (WHERE p <= last), 0)::BIGINT AS level_bits, "
    "(CASE WHEN any_value(last) < 0 THEN 1 WHEN any_value(last) < 4 THEN any_value(last) + 3 ELSE 5 + 2 * length(bin(greatest(any_value(last) - 3, 1))) END)::BIGINT AS last_bits FROM lv JOIN lr ON lv.vec_id = lr.vec_id GROUP BY lv.vec_id"
)
def bit_estimates(spark, sf_dir):
    last = B.last_nonzero(F.col("q"))
    q = _levels(spark, sf_dir).withColumn("last", last)
    return q.select("vec_id", Q.level_bits(F.col("q"), F.col("last")).cast("bigint").alias("level_bits"), Q.last_bits(F.col("last")).cast("bigint").alias("last_bits"))


# ── prediction ──
# The block's own first 17 and next 17 samples stand for the references above and at the left.

_REFS = f"{ARRAYS}, rf AS (SELECT vec_id, list_transform(b, lambda v: least(greatest(v + 128, 0), 255)) AS b FROM blk), ref AS (SELECT vec_id, b, b[1:17] AS above, b[18:34] AS lft FROM rf)"


def _pred_sql(mode: int, x: str = "x", y: str = "y") -> str:
    """Expression of the predicted sample at x, y from the lists above and lft (1-based)."""
    if mode == 0:
        return f"least(greatest((above[{x} + 2] * (7 - {y}) + lft[{y} + 2] * (7 - {x}) + above[1] * ({x} + {y}) + 8) // 16, 0), 255)"
    if mode == 1:
        return "(list_sum(above[2:9]) + list_sum(lft[2:9]) + 8) // 16"
    vertical = mode in P.VERTICAL
    d = P.VERTICAL[mode] if vertical else P.HORIZONTAL[mode]
    pos = f"({x} * 32 + {y} * {d})" if vertical else f"({y} * 32 + {x} * {d})"
    a, b = ("above", "lft") if vertical else ("lft", "above")

    def get(k: str) -> str:
        i = f"least(greatest((abs({pos}) >> 5) + {k}, 0), 16) + 1"
        return f"(CASE WHEN {pos} >= 0 THEN {a}[{i}] ELSE {b}[{i}] END)"

    p0, p1 = get("1"), get("2")
    return f"least(greatest({p0} + ((({p1} - {p0}) * (abs({pos}) & 31) + 16) >> 5), 0), 255)"


def _pred_rows(modes) -> str:
    return " UNION ALL ".join(f"SELECT vec_id, {m} AS mode, y * 8 + x AS p, ({_pred_sql(m)})::BIGINT AS v, b FROM ref, range(8) a(y), range(8) c(x)" for m in modes)


def _referred(spark, sf_dir):
    return byte_blocks(spark, sf_dir).select("vec_id", "b", F.slice("b", 1, 17).alias("above"), F.slice("b", 18, 17).alias("left"))


@query(f"WITH {_REFS}, pr AS ({_pred_rows([0])}) SELECT vec_id, p::BIGINT AS p, v FROM pr")
def intra_planar(spark, sf_dir):
    r = _referred(spark, sf_dir)
    return rows(r.withColumn("b", P.predict(F.col("above"), F.col("left"), 8, P.PLANAR)), "b")


@query(f"WITH {_REFS}, pr AS ({_pred_rows([1])}) SELECT vec_id, p::BIGINT AS p, v::BIGINT AS v FROM pr")
def intra_dc(spark, sf_dir):
    r = _referred(spark, sf_dir)
    return rows(r.withColumn("b", P.predict(F.col("above"), F.col("left"), 8, P.DC)), "b")


@query(f"WITH {_REFS}, pr AS ({_pred_rows(range(2, 18))}) SELECT vec_id, mode::BIGINT AS mode, p::BIGINT AS p, v FROM pr")
def intra_angular(spark, sf_dir):
    r = _referred(spark, sf_dir)
    all_ = P.predict_all(F.col("above"), F.col("left"), 8, range(2, 18))
    e = r.select("vec_id", F.posexplode(all_).alias("m", "b")).select("vec_id", (F.col("m") + 2).cast("bigint").alias("mode"), F.posexplode("b").alias("p", "v"))
    return e.select("vec_id", "mode", F.col("p").cast("bigint").alias("p"), F.col("v").cast("bigint").alias("v"))


@query(f"WITH {_REFS}, pr AS ({_pred_rows(range(18))}), s AS (SELECT vec_id, mode, sum(abs(v - b[p + 1]))::BIGINT AS sad FROM pr GROUP BY vec_id, mode) SELECT vec_id, min(sad) AS sad, arg_min(mode, (sad, mode))::BIGINT AS mode FROM s GROUP BY vec_id")
def intra_best(spark, sf_dir):
    r = _referred(spark, sf_dir)
    best = r.select("vec_id", P.best_mode(F.col("b"), F.col("above"), F.col("left"), 8).alias("m"))
    return best.select("vec_id", F.col("m.sad").cast("bigint").alias("sad"), F.col("m.mode").cast("bigint").alias("mode"))


@query(f"WITH {BYTES}, n AS (SELECT a.vec_id, sum(a.v) AS s, count(*) AS k FROM px a WHERE r = 0 OR c = 0 GROUP BY 1) SELECT vec_id, ((s + k // 2) // k)::BIGINT AS dc FROM n")
def chroma_dc(spark, sf_dir):
    """The first row and the first column (its corner once) stand for the neighbours."""
    b = byte_blocks(spark, sf_dir)
    side = F.transform(F.sequence(F.lit(8), F.lit(56), F.lit(8)), lambda i: F.get("b", i))
    return b.select("vec_id", P.chroma_dc(F.slice("b", 1, 8), side).cast("bigint").alias("dc"))


@query(
    f"WITH {BYTES}, nx AS (SELECT vec_id - 1 AS vec_id, p, v FROM px), s AS (SELECT px.vec_id, count(*) AS n, sum(px.v) AS sl, sum(nx.v) AS sc, sum(px.v * nx.v) AS slc, sum(px.v * px.v) AS sll FROM px JOIN nx ON px.vec_id = nx.vec_id AND px.p = nx.p GROUP BY 1), "
    "q AS (SELECT vec_id, n * slc - sl * sc AS cov, n * sll - sl * sl AS var FROM s) SELECT vec_id, CASE WHEN cov >= 0 THEN 1 ELSE -1 END::BIGINT AS sgn, "
    "CASE WHEN var > 0 AND cov <> 0 THEN least(greatest(CASE WHEN var // abs(cov) < 1 THEN 2 ELSE length(bin((var // abs(cov))::BIGINT)) - 1 END, 2), 5) ELSE 3 END::BIGINT AS shift FROM q"
)
def cfl_regression(spark, sf_dir):
    """A block as luma, the next one as chroma."""
    s = spread(byte_blocks(spark, sf_dir))
    nxt = s.select((F.col("vec_id") - 1).alias("vec_id"), "p", F.col("v").cast("bigint").alias("c"))
    j = s.select("vec_id", "p", F.col("v").cast("bigint").alias("l")).join(nxt, ["vec_id", "p"])
    sums = j.groupBy("vec_id").agg(F.count("*").alias("n"), F.sum("l").alias("sl"), F.sum("c").alias("sc"), F.sum(F.col("l") * F.col("c")).alias("slc"), F.sum(F.col("l") * F.col("l")).alias("sll"))
    m = sums.select("vec_id", P.luma_slope(*[F.col(c) for c in ("n", "sl", "sc", "slc", "sll")]).alias("m"))
    return m.select("vec_id", F.col("m.sign").cast("bigint").alias("sgn"), F.col("m.shift").cast("bigint").alias("shift"))


@query(f"WITH {BYTES}, nx AS (SELECT vec_id - 1 AS vec_id, p, v FROM px), m AS (SELECT vec_id, (sum(v) + 32) // 64 AS mean FROM px GROUP BY 1) SELECT px.vec_id, px.p::BIGINT AS p, least(greatest(nx.v + ((px.v - mean)::BIGINT >> 3), 0), 255)::BIGINT AS v FROM px JOIN nx ON px.vec_id = nx.vec_id AND px.p = nx.p JOIN m ON m.vec_id = px.vec_id")
def cfl_blend(spark, sf_dir):
    nxt = byte_blocks(spark, sf_dir).select((F.col("vec_id") - 1).alias("vec_id"), F.col("b").alias("chroma"))
    both = byte_blocks(spark, sf_dir).join(nxt, "vec_id")
    return rows(both.withColumn("b", P.legacy_luma_blend(F.col("chroma"), F.col("b"))), "b")


# ── metrics on blocks ──

_PAIRS = f"{BYTES}, pairs AS (SELECT a.vec_id, a.p, a.r, a.c, a.v AS a, b.v AS b FROM px a JOIN px b ON b.vec_id = a.vec_id + 1 AND b.p = a.p)"


def _pairs(spark, sf_dir):
    """Samples of each block and the next one."""
    s = spread(byte_blocks(spark, sf_dir))
    nxt = s.select((F.col("vec_id") - 1).alias("vec_id"), "p", F.col("v").alias("b"))
    return s.select("vec_id", "label", "p", "r", "c", F.col("v").alias("a")).join(nxt, ["vec_id", "p"])


@query(f"WITH {_PAIRS}, s AS (SELECT vec_id, count(*) AS n, sum((a - b) ** 2)::BIGINT AS sse FROM pairs GROUP BY 1) SELECT vec_id, n, sse, round(CASE WHEN sse = 0 THEN 100.0 ELSE 10 * log10(65025.0::DOUBLE / (sse / n)) END, 6)::DOUBLE AS psnr FROM s")
def psnr_embedding_pairs(spark, sf_dir):
    return metrics.psnr_by(_pairs(spark, sf_dir), ["vec_id"]).withColumn("psnr", F.round("psnr", 6))


@query(f"WITH {BYTES}, ce AS (SELECT label, p, round(avg(v))::BIGINT AS m FROM px GROUP BY 1, 2), s AS (SELECT px.label, count(*) AS n, sum((v - m) ** 2)::BIGINT AS sse FROM px JOIN ce ON px.label = ce.label AND px.p = ce.p GROUP BY 1) SELECT label, n, sse, round(CASE WHEN sse = 0 THEN 100.0 ELSE 10 * log10(65025.0::DOUBLE / (sse / n)) END, 6)::DOUBLE AS psnr FROM s")
def psnr_label_centroid(spark, sf_dir):
    """Blocks against their label's mean block: 64 rows a label."""
    s = spread(byte_blocks(spark, sf_dir))
    mean = s.groupBy("label", "p").agg(F.round(F.avg("v")).cast("bigint").alias("b"))
    return metrics.psnr_by(s.withColumnRenamed("v", "a").join(mean, ["label", "p"]), ["label"]).withColumn("psnr", F.round("psnr", 6))


_SSIM = f"""WITH {_PAIRS}, m AS (SELECT vec_id, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS va, var_pop(b) AS vb, covar_samp(a, b) AS cov FROM pairs GROUP BY 1)
SELECT vec_id, round(least(greatest((2 * ma * mb + {metrics.C1}) * (2 * cov + {metrics.C2}) / ((ma * ma + mb * mb + {metrics.C1}) * (va + vb + {metrics.C2})), 0.0), 1.0), 6)::DOUBLE AS ssim FROM m"""


@query(_SSIM)
def ssim_blocks_embeddings(spark, sf_dir):
    return metrics.ssim_blocks(_pairs(spark, sf_dir), ["vec_id"]).select("vec_id", F.round("ssim", 6).alias("ssim"))


@query(f"WITH s AS ({_SSIM}), l AS (SELECT label, ssim FROM s JOIN embeddings USING (vec_id)) SELECT label, round(avg(ssim), 5)::DOUBLE AS ssim FROM l GROUP BY 1")
def ssim_mean_by_label(spark, sf_dir):
    s = metrics.ssim_blocks(_pairs(spark, sf_dir), ["vec_id", "label"]).select("label", F.round("ssim", 6).alias("ssim"))
    return s.groupBy("label").agg(F.round(F.avg("ssim"), 5).alias("ssim"))


@query(f"WITH {BYTES}, g AS (SELECT vec_id // 16 AS grp, vec_id, p, v FROM px), s AS (SELECT a.grp, a.vec_id, b.vec_id AS match, sum(abs(a.v - b.v))::BIGINT AS sad FROM g a JOIN g b ON a.grp = b.grp AND a.p = b.p AND a.vec_id <> b.vec_id GROUP BY 1, 2, 3) SELECT grp, vec_id, arg_min(match, (sad, match)) AS match, min(sad) AS sad FROM s GROUP BY 1, 2")
def sad_best_match(spark, sf_dir):
    """The nearest other block of each group of 16."""
    b = byte_blocks(spark, sf_dir).withColumn("grp", F.floor(F.col("vec_id") / 16))
    return motion.best_match(b, ["grp"], "vec_id", "b")


@query(f"WITH {BYTES} SELECT vec_id, (sum(v * v) // 64 - (sum(v) // 64) ** 2)::BIGINT AS variance, CASE WHEN sum(v * v) // 64 - (sum(v) // 64) ** 2 > 512 THEN 4 ELSE 8 END::BIGINT AS size FROM px GROUP BY 1")
def block_variance_txsize(spark, sf_dir):
    t = metrics.transform_size(spread(byte_blocks(spark, sf_dir)), ["vec_id"], "v")
    return t.withColumn("size", F.col("size").cast("bigint"))


@query(f"WITH {_PAIRS} SELECT vec_id, sum(abs(a - b))::BIGINT AS sad, sum((a - b) ** 2)::BIGINT AS sse, sum(abs(a - b)) <= 31 AS static, sum((a - b) ** 2) = 0 AS exact FROM pairs GROUP BY 1")
def static_blocks(spark, sf_dir):
    return scenes.static_blocks(_pairs(spark, sf_dir), ["vec_id"]).select("vec_id", "sad", "sse", "static", "exact")


_SAO = f"""{_PAIRS}, q AS (SELECT vec_id // 8 AS ctu, a, b - (b % 12) AS b FROM pairs), bs AS (SELECT ctu, b >> 3 AS band, sum(a - b)::BIGINT AS s, count(*) AS n FROM q GROUP BY 1, 2),
tr AS (SELECT ctu, band, least(greatest((s + CASE WHEN s >= 0 THEN n // 2 ELSE -(n // 2) END) // n, -7), 7) AS off FROM bs),
ch AS (SELECT q.ctu, tr.band, off, sum((a - least(greatest(b + off, 0), 255)) ** 2 - (a - b) ** 2)::BIGINT AS change FROM q JOIN tr ON q.ctu = tr.ctu AND b >> 3 = tr.band GROUP BY 1, 2, 3),
ba AS (SELECT ctu, sum((a - b) ** 2)::BIGINT AS base FROM q GROUP BY 1),
be AS (SELECT ctu, min((change, band, off)) AS m FROM ch WHERE change < 0 AND off <> 0 GROUP BY 1),
cho AS (SELECT ba.ctu, m[2] AS band, m[3] AS off, base + coalesce(m[1], 0) AS sse, base FROM ba LEFT JOIN be ON ba.ctu = be.ctu)"""


def _rough(spark, sf_dir):
    """Original and coarsely rounded samples, eight blocks a unit."""
    p = _pairs(spark, sf_dir)
    return p.select(F.floor(F.col("vec_id") / 8).alias("ctu"), "vec_id", "p", "a", (F.col("b") - F.col("b") % 12).alias("b"))


@query(f"WITH {_SAO} SELECT ctu, band::BIGINT AS band, off::BIGINT AS off, sse::BIGINT AS sse, base::BIGINT AS base FROM cho")
def sao_choose(spark, sf_dir):
    c = loopfilter.choose_offset(_rough(spark, sf_dir), ["ctu"])
    return c.select("ctu", F.col("band").cast("bigint").alias("band"), F.col("offset").cast("bigint").alias("off"), F.col("sse").cast("bigint").alias("sse"), F.col("base").cast("bigint").alias("base"))


@query(f"WITH {_SAO} SELECT q.ctu, sum(CASE WHEN b >> 3 = band THEN least(greatest(b + off, 0), 255) ELSE b END)::BIGINT AS total, sum((a - CASE WHEN b >> 3 = band THEN least(greatest(b + off, 0), 255) ELSE b END) ** 2)::BIGINT AS sse FROM q JOIN cho ON q.ctu = cho.ctu GROUP BY 1")
def sao_apply(spark, sf_dir):
    s = _rough(spark, sf_dir)
    out = loopfilter.apply_offset(s.withColumnRenamed("b", "v"), loopfilter.choose_offset(s, ["ctu"]), ["ctu"])
    d = (F.col("a") - F.col("v")).cast("bigint")
    return out.groupBy("ctu").agg(F.sum("v").cast("bigint").alias("total"), F.sum(d * d).alias("sse"))


@query(f"WITH {BYTES} SELECT (v >> 3)::BIGINT AS band, count(*) AS n FROM px GROUP BY 1")
def sao_bands(spark, sf_dir):
    return spread(byte_blocks(spark, sf_dir)).groupBy(sample_band(F.col("v")).cast("bigint").alias("band")).agg(F.count("*").alias("n"))


_SPLIT = f"{BYTES}, c4 AS (SELECT vec_id, r // 4 AS y, c // 4 AS x, count(*) * sum(v * v)::BIGINT - sum(v)::BIGINT * sum(v)::BIGINT AS cost FROM px GROUP BY 1, 2, 3), ow AS (SELECT vec_id, (count(*) * sum(v * v)::BIGINT - sum(v)::BIGINT * sum(v)::BIGINT) // 4 AS own FROM px GROUP BY 1)"


@query(f"WITH {_SPLIT} SELECT c4.vec_id, least(sum(cost) + 4096, any_value(own))::BIGINT AS cost, sum(cost) + 4096 <= any_value(own) AS split FROM c4 JOIN ow ON c4.vec_id = ow.vec_id GROUP BY 1")
def quadtree_split(spark, sf_dir):
    """Spread of samples plus a constant a leaf as the cost; 1024 for each of the four children."""
    s = spread(byte_blocks(spark, sf_dir)).withColumn("v", F.col("v").cast("bigint"))
    spread_of = F.count("*") * F.sum(F.col("v") * F.col("v")) - F.sum("v") * F.sum("v")
    own = s.groupBy("vec_id").agg(F.floor(spread_of / 4).alias("own"))
    leaves = s.groupBy("vec_id", F.floor(F.col("r") / 4).alias("y"), F.floor(F.col("c") / 4).alias("x")).agg((spread_of + 1024).alias("cost")).join(own, "vec_id")
    return loopfilter.split_blocks(leaves, ["vec_id"]).select("vec_id", "cost", "split")


@query(f"WITH {_LEVELS} SELECT vec_id, p::BIGINT AS p, q::BIGINT AS v FROM lv")
def range_coder_round_trip(spark, sf_dir):
    """Levels through the adaptive range coder, four blocks a stream, and back."""
    q = _levels(spark, sf_dir).select("vec_id", F.floor(F.col("vec_id") / 4).alias("stream"), "q")
    s = q.groupBy("stream").agg(F.sort_array(F.collect_list(F.struct("vec_id", "q"))).alias("l"))
    coded = s.select("stream", F.transform("l", lambda x: x["vec_id"]).alias("ids"), rangecoder.encoded(F.transform("l", lambda x: x["q"])).alias("data"))
    back = coded.select("ids", rangecoder.decoded(F.col("data"), F.size("ids"), 64).alias("b"))
    rows_ = back.select(F.inline(F.arrays_zip("ids", "b"))).select(F.col("ids").alias("vec_id"), F.col("b").alias("q"))
    return rows(rows_, "q")


# ── sweeps and meters ──

_QPS = (22, 27, 32, 37, 42)
_SWEPT = (
    f"{CELLS}, {_STEPS}, {_WEIGHTS}, lv AS (SELECT vec_id, label, p, v, codec, qp, greatest((s * w + 4) >> 3, 1) AS e FROM cells, steps, weights, (VALUES ('own'), ('base')) c(codec) WHERE qp IN ({', '.join(map(str, _QPS))}) AND band = CASE codec WHEN 'own' THEN {_BAND} ELSE 0 END), "
    "lq AS (SELECT *, sign(v)::BIGINT * ((abs(v) + e // 3) // e) AS q FROM lv), ll AS (SELECT *, coalesce(max(p) FILTER (WHERE q <> 0) OVER (PARTITION BY vec_id, codec, qp), -1) AS last FROM lq), "
    "sw AS (SELECT label::BIGINT AS label, codec, qp::BIGINT AS qp, count(*) AS n, coalesce(sum(CASE WHEN q = 0 THEN 1 ELSE 2 + 2 * length(bin(abs(q))) END) FILTER (WHERE p <= last), 0)::BIGINT AS bits, "
    "sum((v - q * e - sign(q)::BIGINT * CASE codec WHEN 'own' THEN e // 6 ELSE e >> 1 END) ** 2)::BIGINT AS sse FROM ll GROUP BY 1, 2, 3)"
)


def _sweep(spark, sf_dir):
    return sweeps.sweep(blocks(spark, sf_dir).withColumn("label", F.col("label").cast("bigint")), ["label"], _QPS).withColumn("qp", F.col("qp").cast("bigint"))


@query(
    f"WITH {_SWEPT} SELECT p.*, NOT EXISTS (SELECT 1 FROM sw a, sw b WHERE a.label = p.label AND b.label = p.label AND a.codec = p.codec AND b.codec = p.codec AND a.bits < p.bits AND b.bits > p.bits "
    "AND (b.bits - a.bits)::DOUBLE * (p.sse - a.sse)::DOUBLE >= (p.bits - a.bits)::DOUBLE * (b.sse - a.sse)::DOUBLE) AS hull FROM sw p"
)
def rd_sweep(spark, sf_dir):
    """Embeddings as blocks of coefficients at five QPs and by both quantizers, and which points are on a label's lower hull."""
    return sweeps.lower_hull(_sweep(spark, sf_dir), ["label", "codec"], "bits", "sse")


@query(f"WITH {_SWEPT} SELECT band, sum((q = 0)::INT)::DOUBLE AS zeros, count(*)::DOUBLE AS n FROM (SELECT *, {_BAND} AS band FROM ll WHERE codec = 'own' AND qp = 32) GROUP BY band")
def meter_shares(spark, sf_dir):
    """How many levels of each band are zero, counted in the pass that quantizes; nothing is read twice."""
    q = Q.quantize(F.col("b"), F.lit(32), 8)
    each = rows(blocks(spark, sf_dir).withColumn("q", q), "q").withColumn("band", Q.band_of("p", 8))
    meters = {f"{what}_{k}": F.sum(F.when((F.col("band") == k) & on, 1).otherwise(0)) for k in range(4) for what, on in (("zeros", F.col("v") == 0), ("n", F.lit(True)))}
    read, seen = sweeps.metered(each, "levels", **meters)
    read.write.format("noop").mode("overwrite").save()  # the work that is metered
    m = sweeps.meter_rows(spark, seen).select(F.split("meter", "_").alias("m"), "value")
    by = m.groupBy(F.col("m")[1].cast("bigint").alias("band")).agg(*[F.max(F.when(F.col("m")[0] == k, F.col("value"))).alias(k) for k in ("zeros", "n")])
    return by.where("n > 0")
