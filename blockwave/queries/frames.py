"""Queries on whole frames. Stand-in: sixteen embeddings in a row as a frame of 4 x 4 blocks of 8 x 8 samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predict as P
from ..functions.ints import div
from ..operators import frames
from .blocks import _pred_sql
from .common import byte_blocks

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def tiles(spark, sf_dir) -> DataFrame:
    """(f, by, bx, b): blocks of frames; the last frame may lack some."""
    b = byte_blocks(spark, sf_dir).withColumn("k", F.col("vec_id") % 16)
    return b.select(div("vec_id", 16).alias("f"), div("k", 4).alias("by"), (F.col("k") % 4).cast("bigint").alias("bx"), "b")


_TILES = "tl AS (SELECT vec_id // 16 AS f, vec_id % 16 // 4 AS y, vec_id % 4 AS x, list_transform(embedding, lambda e: least(greatest(floor(e::DOUBLE * 512)::BIGINT + 128, 0), 255)) AS b FROM embeddings)"
_EDGES = (
    f"{_TILES}, ed AS (SELECT t.*, a.b[57:64] AS ab, r.b[57:64] AS ar, c.b[64] AS co, list_transform(range(1, 9), lambda i: l.b[i * 8]) AS lf, list_transform(range(1, 9), lambda i: d.b[i * 8]) AS bl, l.b IS NULL AS nol, d.b IS NULL AS nod FROM tl t "
    "LEFT JOIN tl a ON a.f = t.f AND a.y = t.y - 1 AND a.x = t.x LEFT JOIN tl r ON r.f = t.f AND r.y = t.y - 1 AND r.x = t.x + 1 LEFT JOIN tl c ON c.f = t.f AND c.y = t.y - 1 AND c.x = t.x - 1 "
    "LEFT JOIN tl l ON l.f = t.f AND l.y = t.y AND l.x = t.x - 1 LEFT JOIN tl d ON d.f = t.f AND d.y = t.y + 1 AND d.x = t.x - 1)"
)
_FLAT = "list_transform(range(16), lambda i: 128)"
_WIDE = (
    f"{_EDGES}, rw AS (SELECT f, y, x, b, co, CASE WHEN ab IS NULL THEN {_FLAT} ELSE list_concat(ab, coalesce(ar, list_transform(range(8), lambda i: ab[8]))) END AS aa, "
    f"CASE WHEN nol THEN {_FLAT} ELSE list_concat(lf, CASE WHEN nod THEN list_transform(range(8), lambda i: lf[8]) ELSE bl END) END AS ll FROM ed), "
    "ref AS (SELECT f, y AS ty, x AS tx, b, list_concat([coalesce(co, aa[1])], aa) AS above, list_concat([coalesce(co, ll[1])], ll) AS lft FROM rw)"
)
_NEAR = (
    f"{_EDGES}, rw AS (SELECT f, y, x, b, coalesce(co, ab[1], CASE WHEN NOT nol THEN lf[1] END, 128) AS co, coalesce(ab, list_transform(range(8), lambda i: CASE WHEN nol THEN 128 ELSE lf[1] END)) AS aa, "
    "CASE WHEN nol THEN list_transform(range(8), lambda i: coalesce(ab[1], 128)) ELSE lf END AS ll FROM ed), "
    "ref AS (SELECT f, y AS ty, x AS tx, b, list_concat([co], aa, list_transform(range(8), lambda i: aa[8])) AS above, list_concat([co], ll, list_transform(range(8), lambda i: ll[8])) AS lft FROM rw)"
)


def _modes(refs: str) -> str:
    tries = " UNION ALL ".join(f"SELECT f, ty, tx, {m} AS mode, list_sum(list_transform(range(64), lambda i: abs(b[i + 1] - v[i + 1])))::BIGINT AS sad FROM (SELECT *, list_transform(range(64), lambda p: {_at(m)}) AS v FROM ref)" for m in range(P.MODES))
    return f"WITH {refs}, tr AS ({tries}) SELECT f, ty AS \"by\", tx AS bx, min(sad) AS sad, arg_min(mode, (sad, mode))::BIGINT AS mode FROM tr GROUP BY f, ty, tx"


def _at(mode: int) -> str:
    """The predicted sample at place p of a block."""
    return _pred_sql(mode, "(p % 8)", "(p // 8)")


def _mode_map(t: DataFrame) -> DataFrame:
    best = t.select("f", "by", "bx", P.best_mode(F.col("b"), F.col("above_refs"), F.col("left_refs"), 8).alias("m"))
    return best.select("f", "by", "bx", "m.sad", F.col("m.mode").cast("bigint").alias("mode"))


def _referred(spark, sf_dir, how) -> DataFrame:
    above, left = how(8)
    return frames.with_edges(tiles(spark, sf_dir), ["f"], 8).withColumns({"above_refs": above, "left_refs": left})


@query(_modes(_NEAR))
def intra_mode_map(spark, sf_dir):
    """The best mode of each block from its neighbours' edges."""
    return _mode_map(_referred(spark, sf_dir, frames.near_references))


@query(_modes(_WIDE))
def intra_mode_map_wide(spark, sf_dir):
    """The same with references that reach into the blocks beyond."""
    return _mode_map(_referred(spark, sf_dir, frames.references))


@query(f"WITH {_WIDE} SELECT f, ty AS \"by\", tx AS bx, p::BIGINT AS p, above[p + 1]::BIGINT AS above, lft[p + 1]::BIGINT AS lft FROM ref, range(17) t(p)")
def intra_edges(spark, sf_dir):
    """The references themselves, a row for each place."""
    r = _referred(spark, sf_dir, frames.references)
    each = r.select("f", "by", "bx", F.posexplode(F.arrays_zip("above_refs", "left_refs")).alias("p", "v"))
    return each.select("f", "by", "bx", F.col("p").cast("bigint").alias("p"), F.col("v.above_refs").cast("bigint").alias("above"), F.col("v.left_refs").cast("bigint").alias("lft"))


# Trees: embeddings in rows of 32 blocks, so that a tile of 8 x 8 blocks has 64 of them.

_PRICE = 200_000
_LEAF = "SELECT vec_id // 32 AS y, vec_id % 32 AS x, 64 AS n, list_sum(b)::BIGINT AS s, list_sum(list_transform(b, lambda v: v * v))::BIGINT AS q FROM bb"


def _level(d: int) -> str:
    """Nodes of level d: their sums, whether they are whole, their cost as a leaf and the least cost."""
    child = f"SELECT y // 2 AS y, x // 2 AS x, sum(n)::BIGINT AS n, sum(s)::BIGINT AS s, sum(q)::BIGINT AS q, sum(best)::BIGINT AS four FROM l{d - 1} GROUP BY 1, 2" if d else "SELECT *, 0 AS four FROM leaf"
    whole = f"n = {64 * 4**d}"
    own = f"q - s * s // n + {_PRICE}"
    if not d:
        return f"l0 AS (SELECT *, {own} AS own, {own} AS best, false AS cut FROM ({child}))"
    return f"l{d} AS (SELECT *, CASE WHEN {whole} THEN {own} END AS own, CASE WHEN {whole} AND NOT four <= {own} THEN {own} ELSE four END AS best, NOT ({whole}) OR four <= {own} AS cut FROM ({child}))"


@query(
    "WITH RECURSIVE bb AS (SELECT vec_id, list_transform(embedding, lambda e: least(greatest(floor(e::DOUBLE * 512)::BIGINT + 128, 0), 255)) AS b FROM embeddings), "
    f"leaf AS ({_LEAF}), {', '.join(map(_level, range(4)))}, a AS (" + " UNION ALL ".join(f"SELECT {d} AS d, y, x, own, best, cut FROM l{d}" for d in range(4)) + "), "
    "t AS (SELECT d, y, x, own, cut, y AS ty, x AS tx, best AS total FROM a WHERE d = 3 UNION ALL SELECT a.d, a.y, a.x, a.own, a.cut, t.ty, t.tx, t.total FROM t JOIN a ON t.cut AND a.d = t.d - 1 AND a.y // 2 = t.y AND a.x // 2 = t.x) "
    "SELECT ty, tx, (y << d) % 8 AS y, (x << d) % 8 AS x, (1 << d)::BIGINT AS size, own AS cost, total FROM t WHERE NOT cut"
)
def split_tree(spark, sf_dir):
    """The cheapest tree of blocks of 8 to 64 samples over all embeddings, in rows of 32; the last row may lack some."""
    b = byte_blocks(spark, sf_dir)
    total = lambda f: F.aggregate("b", F.lit(0).cast("bigint"), lambda a, v: a + f(v))
    leaves = b.select(div("vec_id", 32).alias("by"), (F.col("vec_id") % 32).alias("bx"), F.size("b").alias("n"), total(lambda v: v).alias("s"), total(lambda v: v * v).alias("q"))
    return frames.split_trees(leaves, [], _PRICE)


_WALK = [(dx, dy, k, t == 0, p == 0) for k, (points, times) in enumerate(frames.ROUNDS) for t in range(times) for p, (dx, dy) in enumerate(points)]
_STEPS = "(VALUES " + ", ".join(f"({i}, {dx}, {dy}, {str(first).lower()}, {str(start).lower()})" for i, (dx, dy, _, first, start) in enumerate(_WALK)) + ") st(i, ax, ay, fresh, start)"


@query(
    f"WITH RECURSIVE {_TILES}, whole AS (SELECT f FROM tl GROUP BY f HAVING count(*) = 16), "
    "px AS (SELECT f, y * 8 + i // 8 AS r, x * 8 + i % 8 AS c, b[i + 1] AS v FROM tl, range(64) t(i) WHERE f IN (SELECT f FROM whole)), fr AS (SELECT f, list(v ORDER BY r, c) AS v FROM px GROUP BY f), "
    f"st AS (SELECT * FROM {_STEPS}), cur AS (SELECT tl.f, tl.y, tl.x, tl.b, fr.v AS ref FROM tl JOIN fr ON fr.f = tl.f - 1 WHERE tl.f IN (SELECT f FROM whole)), "
    "s AS (SELECT f, y, x, -1 AS i, y * 8 AS py, x * 8 AS px, list_sum(list_transform(range(64), lambda k: abs(b[k + 1] - ref[(y * 8 + k // 8) * 32 + x * 8 + k % 8 + 1])))::BIGINT AS sad, false AS going, false AS better, 1::BIGINT AS tried FROM cur UNION ALL "
    "SELECT f, y, x, i, CASE WHEN e < sad THEN ny ELSE py END, CASE WHEN e < sad THEN nx ELSE px END, CASE WHEN e < sad THEN e ELSE sad END, going, better OR coalesce(e < sad, false), tried + (e IS NOT NULL)::INT FROM ("
    "SELECT g.*, CASE WHEN going AND ny >= 0 AND nx >= 0 AND ny <= 24 AND nx <= 24 THEN list_sum(list_transform(range(64), lambda k: abs(cur.b[k + 1] - cur.ref[(ny + k // 8) * 32 + nx + k % 8 + 1])))::BIGINT END AS e FROM ("
    "SELECT s.f, s.y, s.x, st.i, s.py, s.px, s.sad, s.tried, CASE WHEN st.start THEN st.fresh OR s.going AND s.better ELSE s.going END AS going, CASE WHEN st.start THEN false ELSE s.better END AS better, s.py + st.ay AS ny, s.px + st.ax AS nx "
    "FROM s JOIN st ON st.i = s.i + 1) g JOIN cur ON cur.f = g.f AND cur.y = g.y AND cur.x = g.x) h) "
    f"SELECT f, y AS \"by\", x AS bx, sad, py - y * 8 AS dy, px - x * 8 AS dx, tried FROM s WHERE i = {len(_WALK) - 1}"
)
def greedy_search(spark, sf_dir):
    """The descent of each block of a frame in the frame before it; a rest that fills no frame is left out."""
    t = tiles(spark, sf_dir)
    full = t.join(t.groupBy("f").count().where("count = 16").select("f"), "f")
    return frames.greedy(full.where("f > 0"), full.withColumn("f", F.col("f") + 1), ["f"], 8, 4)
