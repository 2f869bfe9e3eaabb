"""Queries on ordered tables: histograms, rate control, ordering, offsets, rate-distortion curves.
Stand-ins: events as frames of a user or a day, conversations as coded clips, pages as packets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ratecontrol as R
from ..functions.filters import edge
from ..functions.ints import div
from ..operators import metrics, order, prefix, scenes, sweeps
from ..sources import container
from ..streaming import timed
from .common import scratch, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ── histograms and scene cuts ──

_DAYS = "d AS (SELECT ts::DATE AS day, least(floor(value)::BIGINT // 16, 15) AS b FROM events), h AS (SELECT day, b, count(*)::DOUBLE AS n FROM d GROUP BY 1, 2), g AS (SELECT day, b FROM (SELECT DISTINCT day FROM d), range(16) r(b)), f AS (SELECT g.day, g.b, coalesce(n, 0) AS n FROM g LEFT JOIN h ON g.day = h.day AND g.b = h.b), l AS (SELECT day, b, n, lag(n) OVER (PARTITION BY b ORDER BY day) AS p FROM f)"


@query(f"WITH {_DAYS}, s AS (SELECT day, sum(n) AS total, sum(CASE WHEN n + p > 0 THEN (n - p) ** 2 / ((n + p) / 2.0::DOUBLE) ELSE 0 END) AS x, count(p) AS k FROM l GROUP BY day) SELECT day, total::BIGINT AS n, CASE WHEN k > 0 THEN round(x / total, 6) END AS distance, k = 0 OR x / total > 0.05 AS key FROM s")
def scene_cut_events_daily(spark, sf_dir):
    """Days as frames, event values as samples. The flagship query."""
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), F.least(F.floor("value"), F.lit(255)).cast("int").alias("v"))
    cut = scenes.scene_cuts(e, [], "day", "v", threshold=0.05)
    return cut.select("day", "n", F.round("distance", 6).alias("distance"), "key")


@query(
    "WITH d AS (SELECT user_id, datediff('day', DATE '2024-01-01', ts::DATE) AS idx, least(floor(value)::BIGINT, 255) * 16 // 256 AS b FROM events), h AS (SELECT user_id, idx, b, count(*) AS n FROM d GROUP BY 1, 2, 3), f AS (SELECT DISTINCT user_id, idx FROM d), "
    "pr AS (SELECT f.user_id, f.idx, max(g.idx) AS last FROM f LEFT JOIN f g ON g.user_id = f.user_id AND g.idx < f.idx AND g.idx % 10 <> 0 GROUP BY 1, 2), "
    "x AS (SELECT pr.user_id, pr.idx, pr.last, coalesce(a.n, 0)::DOUBLE AS a, coalesce(l.n, 0)::DOUBLE AS l FROM pr CROSS JOIN range(16) r(b) LEFT JOIN h a ON a.user_id = pr.user_id AND a.idx = pr.idx AND a.b = r.b LEFT JOIN h l ON l.user_id = pr.user_id AND l.idx = pr.last AND l.b = r.b) "
    "SELECT user_id, idx::BIGINT AS idx, idx % 10 = 0 OR (any_value(last) IS NOT NULL AND sum(CASE WHEN a + l > 0 THEN (a - l) ** 2 / ((a + l) / 2.0::DOUBLE) ELSE 0 END) / sum(a) > 0.5) AS key FROM x GROUP BY user_id, idx"
)
def scene_cut_gated_users(spark, sf_dir):
    """Key flags of each user's days where keys by cadence leave no histogram behind."""
    e = table(spark, sf_dir, "events").select("user_id", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("bigint").alias("idx"), F.least(F.floor("value"), F.lit(255)).cast("int").alias("v"))
    h = metrics.histogram(e, ["user_id", "idx"], "v")
    bins = h.groupBy("user_id", "idx").agg(*[F.sum(F.when(F.col("bin") == b, F.col("n")).otherwise(0)).alias(f"b{b}") for b in range(16)])
    frames = bins.select("user_id", "idx", F.array(*[f"b{b}" for b in range(16)]).alias("bins"))
    return scenes.scene_cuts_gated(frames, ["user_id"], 10)


@query("SELECT l_returnflag, least(least((l_quantity * 5)::BIGINT, 255) * 16 // 256, 15)::BIGINT AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2")
def hist16_lineitem_qty(spark, sf_dir):
    q = table(spark, sf_dir, "lineitem").select("l_returnflag", F.least((F.col("l_quantity") * 5).cast("bigint"), F.lit(255)).cast("int").alias("v"))
    return metrics.histogram(q, ["l_returnflag"], "v").withColumn("bin", F.col("bin").cast("bigint"))


# ── rate control ──


@query("SELECT p_partkey, qp::BIGINT AS qp, round(1 / (1 + exp(-(qp - 28) / 8.0::DOUBLE)), 9) AS rho, qp::BIGINT AS back FROM (SELECT p_partkey, p_partkey % 64 AS qp FROM part)")
def rho_qp_roundtrip(spark, sf_dir):
    """Keys of parts as QPs."""
    q = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 64).alias("qp"))
    q = q.withColumn("rho", R.rho(F.col("qp")))
    return q.select("p_partkey", "qp", F.round("rho", 9).alias("rho"), R.qp_of(F.col("rho")).cast("bigint").alias("back"))


_STEP = "CASE WHEN s.level > 0.8 THEN -2.0 WHEN s.level > 0.6 THEN -1.0 WHEN s.level < 0.2 THEN 2.0 WHEN s.level < 0.4 THEN 1.0 ELSE 0.0 END"
_TARGET = f"least(greatest(1 / (1 + exp(-(s.qp - 28) / 8.0::DOUBLE)) + ({_STEP})::DOUBLE * 0.05::DOUBLE, 0.05::DOUBLE), 0.95::DOUBLE)"


@query(
    "WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, floor(value * 100)::BIGINT AS bits FROM events), "
    f"s AS (SELECT user_id, 0::BIGINT AS k, 32::BIGINT AS qp, 0.5::DOUBLE AS level, 0::BIGINT AS total FROM (SELECT DISTINCT user_id FROM e) UNION ALL "
    f"SELECT s.user_id, s.k + 1, least(greatest(floor(28 + 8 * ln({_TARGET} / (1 - {_TARGET})) + 0.5), 0), 63)::BIGINT, least(greatest(s.level + (4000 - e.bits) / 120000.0::DOUBLE, 0), 1)::DOUBLE, s.total + e.bits FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1) "
    "SELECT user_id, k AS frames, qp, round(level, 6) AS level, total FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC) = 1"
)
def vbv_fold_users(spark, sf_dir):
    """A user's events as frames of ``value * 100`` bits at 120,000 bits a second and 30 frames a second."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.floor(F.col("value") * 100).cast("bigint").alias("bits"))
    frames = F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", "bits"))), lambda s: s["bits"])
    f = e.groupBy("user_id").agg(R.fold(frames, 32, 120_000, 30.0).alias("s"))
    return f.select("user_id", F.col("s.frames").cast("bigint").alias("frames"), F.col("s.qp").cast("bigint").alias("qp"), F.round("s.level", 6).alias("level"), F.col("s.total").alias("total"))


# the level in halves of a bit, so that it is a whole number
_ASK = "CASE WHEN 5 * s.half > 960000 THEN -2 WHEN 5 * s.half > 720000 THEN -1 WHEN 5 * s.half < 240000 THEN 2 WHEN 5 * s.half < 480000 THEN 1 ELSE 0 END"
_RHO = f"least(greatest(1 / (1 + exp(-(s.qp - 28) / 8.0::DOUBLE)) + ({_ASK})::DOUBLE * 0.05::DOUBLE, 0.05::DOUBLE), 0.95::DOUBLE)"


def _walked(key: str) -> str:
    """The budget frame by frame, for each key of ``events``."""
    return (
        f"WITH RECURSIVE e AS (SELECT {key} AS key, event_id, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) - 1 AS place, floor(value * 100)::BIGINT AS bits FROM events), "
        "s AS (SELECT DISTINCT key, NULL::BIGINT AS event_id, -1::BIGINT AS place, 32::BIGINT AS qp, 120000::BIGINT AS half, 0::BIGINT AS total FROM e UNION ALL "
        f"SELECT s.key, e.event_id, e.place, least(greatest(floor(28 + 8 * ln({_RHO} / (1 - {_RHO})) + 0.5), 0), 63)::BIGINT, least(greatest(s.half + 2 * (4000 - e.bits), 0), 240000)::BIGINT, s.total + e.bits FROM s JOIN e ON e.key = s.key AND e.place = s.place + 1) "
    )


def _frames(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.floor(F.col("value") * 100).cast("bigint").alias("bits"))


@query(_walked("user_id") + "SELECT key AS user_id, event_id, place, qp, round(half / 240000.0::DOUBLE, 9) AS level, total FROM s WHERE place >= 0")
def vbv_prefix_users(spark, sf_dir):
    """The budget of ``vbv_fold_users`` frame by frame, as a parallel prefix over ranges of all events."""
    b = prefix.budget(_frames(spark, sf_dir), ["user_id"], ["ts", "event_id"], "bits", 32, 120_000, 30.0)
    return b.select("user_id", "event_id", "place", F.col("qp").cast("bigint").alias("qp"), F.round("level", 9).alias("level"), "total")


@query(_walked("0") + "SELECT event_id, place, qp, round(half / 240000.0::DOUBLE, 9) AS level, total FROM s WHERE place >= 0")
def vbv_prefix_one_stream(spark, sf_dir):
    """All events as one stream, which is cut over all tasks."""
    b = prefix.budget(_frames(spark, sf_dir), [], ["ts", "event_id"], "bits", 32, 120_000, 30.0)
    return b.select("event_id", "place", F.col("qp").cast("bigint").alias("qp"), F.round("level", 9).alias("level"), "total")


@query("SELECT o_orderkey, p::BIGINT AS position, CASE WHEN p = 0 THEN 0 WHEN (p - 1) % 4 = 1 THEN 1 WHEN (p - 1) % 4 > 1 THEN 2 ELSE 0 END::BIGINT AS off, least(62 + CASE WHEN p = 0 THEN 0 WHEN (p - 1) % 4 = 1 THEN 1 WHEN (p - 1) % 4 > 1 THEN 2 ELSE 0 END, 63)::BIGINT AS qp FROM (SELECT o_orderkey, o_custkey % 1000 AS p FROM orders)")
def layer_qp(spark, sf_dir):
    """Customers of orders as coding positions."""
    p = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 1000).alias("position"))
    return p.select("o_orderkey", "position", R.layer_offset("position").cast("bigint").alias("off"), R.layer_qp(62, "position").cast("bigint").alias("qp"))


# ── order ──


@query("SELECT conv_id, turn, turn % 4 = 0 AS key FROM conversations")
def key_cadence(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", scenes.cadence_key("turn", 4).alias("key"))


@query("SELECT o_orderkey, p::BIGINT AS position, CASE WHEN p = 0 THEN 0 ELSE 4 * ((p + 3) // 4) + CASE (p - 1) % 4 WHEN 0 THEN 0 WHEN 1 THEN -2 WHEN 2 THEN -3 ELSE -1 END END::BIGINT AS display, p::BIGINT AS back FROM (SELECT o_orderkey, o_custkey % 1000 AS p FROM orders)")
def gop_schedule(spark, sf_dir):
    """Customers of orders as coding positions."""
    p = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 1000).cast("bigint").alias("position"))
    p = p.withColumn("display", order.display_of("position"))
    return p.withColumn("back", order.coding_of("display"))


_CODED = "m AS (SELECT conv_id, turn, max(turn) OVER (PARTITION BY conv_id) // 4 * 4 AS whole FROM conversations), co AS (SELECT conv_id, turn, CASE WHEN turn = 0 OR turn > whole THEN turn ELSE (turn + 3) // 4 * 4 - 4 + CASE (turn + 3) // 4 * 4 - turn WHEN 0 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 4 END END AS position FROM m)"


def _coded(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return order.coding_order(c, ["conv_id"], "turn")


@query(f"WITH {_CODED} SELECT conv_id, turn, position FROM co")
def gop_coding_order(spark, sf_dir):
    return _coded(spark, sf_dir)


@query(f"WITH {_CODED}, sg AS (SELECT conv_id, turn, position, sum((turn % 4 = 0)::INT) OVER (PARTITION BY conv_id ORDER BY position)::BIGINT AS segment FROM co) SELECT conv_id, turn, position, segment, row_number() OVER (PARTITION BY conv_id, segment ORDER BY turn, position) - 1 AS shown FROM sg")
def display_reorder(spark, sf_dir):
    c = _coded(spark, sf_dir).withColumn("rap", F.col("turn") % 4 == 0)
    return order.display_order(c, ["conv_id"], "position", "turn", "rap").drop("rap")


@query("WITH g AS (SELECT conv_id, turn, sum((turn % 5 = 0)::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS grp FROM conversations) SELECT conv_id, turn, lag(turn) OVER w AS ref1, lag(turn, 2) OVER w AS ref2, lag(turn, 3) OVER w AS ref3, lag(turn, 4) OVER w AS ref4 FROM g WINDOW w AS (PARTITION BY conv_id, grp ORDER BY turn)")
def dpb_refs(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") % 5 == 0).alias("key"))
    return order.references(c, ["conv_id"], "turn", "key").drop("key")


@query(f"WITH {_CODED}, p AS (SELECT a.conv_id, a.turn, a.position, b.turn AS t FROM co a LEFT JOIN co b ON a.conv_id = b.conv_id AND b.position BETWEEN a.position - 4 AND a.position - 1) SELECT conv_id, turn, position, max(t) FILTER (WHERE t < turn) AS before, min(t) FILTER (WHERE t > turn) AS after FROM p GROUP BY 1, 2, 3")
def asof_refs(spark, sf_dir):
    return order.nearest_references(_coded(spark, sf_dir), ["conv_id"], "position", "turn")


@query("SELECT l_orderkey, l_linenumber, l_partkey::BIGINT AS a, list_sort([l_partkey % 97, l_suppkey % 89, l_linenumber * 10])[2]::BIGINT AS med, CASE WHEN abs(l_partkey % 97 - 48) <= abs(l_suppkey % 89 - 44) THEN l_partkey % 97 - 48 ELSE l_suppkey % 89 - 44 END::BIGINT AS near FROM lineitem")
def vector_prediction(spark, sf_dir):
    """Components made from keys: the median of three, and the nearer to zero of two."""
    t = table(spark, sf_dir, "lineitem")
    a, b, c = F.col("l_partkey") % 97, F.col("l_suppkey") % 89, (F.col("l_linenumber") * 10).cast("bigint")
    pair = F.array(F.struct((a - 48).alias("x"), F.lit(0).cast("bigint").alias("y")), F.struct((b - 44).alias("x"), F.lit(0).cast("bigint").alias("y")))
    return t.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("a"), order.median_vector(a, b, c).alias("med"), order.least_vector(pair)["x"].alias("near"))


@query("SELECT page_id, page_id // 16 AS stream, length(html)::BIGINT AS size, (coalesce(sum(length(html)) OVER (PARTITION BY page_id // 16 ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS \"offset\" FROM pages")
def row_offsets(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.floor(F.col("page_id") / 16).alias("stream"), F.length("html").cast("bigint").alias("size"))
    return order.offsets(p, ["stream"], ["page_id"], "size")


@query(
    "WITH t AS (SELECT page_id, page_id // 16 AS stream, sum(length(html)) OVER (PARTITION BY page_id // 16 ORDER BY page_id) - length(html) AS off FROM pages), b AS (SELECT stream, page_id, CASE WHEN page_id % 48 = 21 THEN 1 ELSE off END AS off FROM t), "
    "l AS (SELECT stream, off, lag(off) OVER (PARTITION BY stream ORDER BY page_id) AS before FROM b) SELECT stream, bool_and(off >= coalesce(before, 0) AND off <= 1099511627776) AS ok FROM l GROUP BY 1"
)
def offset_check(spark, sf_dir):
    """Offsets of which one in every third stream falls back."""
    o = row_offsets(spark, sf_dir).withColumn("offset", F.when(F.col("page_id") % 48 == 21, 1).otherwise(F.col("offset")))
    return order.check_offsets(o, ["stream"], "page_id", "offset", F.lit(1 << 40))


@query("WITH t AS (SELECT page_id // 16 AS stream, length(html)::BIGINT AS n, page_id FROM pages), o AS (SELECT stream, page_id, n, (4096 + coalesce(sum(n) OVER (PARTITION BY stream ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS off FROM t) SELECT stream, printf('%08X', 20 + 4 * count(*)) || '7374737A' || repeat('00', 8) || printf('%08X', count(*)) || string_agg(printf('%08X', n), '' ORDER BY page_id) AS stsz, printf('%08X', 16 + 4 * count(*)) || '7374636F' || repeat('00', 4) || printf('%08X', count(*)) || string_agg(printf('%08X', off), '' ORDER BY page_id) AS stco FROM o GROUP BY stream")
def mp4_offsets(spark, sf_dir):
    """Size and chunk-offset boxes, as hex."""
    p = table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 16).alias("stream"), F.col("page_id").alias("pkt_idx"), F.length("html").alias("size"))
    b = container.sample_boxes(p, ["stream"], 4096)
    return b.select("stream", F.hex("stsz").alias("stsz"), F.hex("stco").alias("stco"))


_SEG = "WITH RECURSIVE p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, turn, role = 'user' AS key FROM conversations), s AS (SELECT conv_id, k, turn, CASE WHEN key THEN 0 END::BIGINT AS segment, 0::BIGINT AS begun FROM p WHERE k = 0 UNION ALL SELECT p.conv_id, p.k, p.turn, CASE WHEN p.key AND p.k - s.begun >= 3 THEN s.segment + 1 ELSE s.segment END, CASE WHEN p.key AND p.k - s.begun >= 3 THEN p.k ELSE s.begun END FROM s JOIN p ON p.conv_id = s.conv_id AND p.k = s.k + 1)"


@query(f"{_SEG} SELECT conv_id, turn, segment FROM s")
def segment_by_key(spark, sf_dir):
    """Turns of users as key packets, three packets or more a segment."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("role") == "user").alias("key"))
    return order.segments(c, ["conv_id"], "turn", "key", 3)


@query(f"{_SEG} SELECT conv_id, turn, k AS place, segment FROM s")
def segment_doubling(spark, sf_dir):
    """The same segments by pointer doubling."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return prefix.segments(c, ["conv_id"], ["turn"], F.col("role") == "user", 3).select("conv_id", "turn", "place", "segment")


_ONE = (
    "WITH RECURSIVE p AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS place, value < 40 OR row_number() OVER (ORDER BY ts, event_id) = 1 AS key FROM events), "
    "k AS MATERIALIZED (SELECT place FROM p WHERE key), n AS MATERIALIZED (SELECT a.place, b.place AS after FROM k a ASOF JOIN k b ON a.place + 24 <= b.place), "
    "c AS (SELECT 0::BIGINT AS place, 0::BIGINT AS segment UNION ALL SELECT n.after, c.segment + 1 FROM c JOIN n ON n.place = c.place WHERE n.after IS NOT NULL) "
    "SELECT p.event_id, p.place, c.segment FROM p ASOF JOIN c ON p.place >= c.place"
)


@query(_ONE)
def segment_one_stream(spark, sf_dir):
    """All events as one stream of packets, small values as key packets, 24 packets or more a segment."""
    e = table(spark, sf_dir, "events").select("ts", "event_id", "value")
    n = prefix.numbered(e, [], ["ts", "event_id"]).withColumnRenamed("place", "_nth")
    return prefix.segments(n, [], ["ts", "event_id"], (F.col("value") < 40) | (F.col("_nth") == 0), 24).select("event_id", "place", "segment")


@query(f"{_SEG}, n AS (SELECT conv_id, segment, count(*) AS n FROM s WHERE segment IS NOT NULL GROUP BY 1, 2) SELECT conv_id, chr(35) || 'EXTM3U' || chr(10) || '#EXT-X-VERSION:7' || chr(10) || '#EXT-X-TARGETDURATION:' || ((max(n) FILTER (WHERE segment = 0) + 1) // 2) || chr(10) || '#EXT-X-MEDIA-SEQUENCE:0' || chr(10) || string_agg('#EXTINF:' || printf('%.6f', n / 2.0::DOUBLE) || ',' || chr(10) || 'seg_' || lpad(segment::VARCHAR, 4, '0') || '.m4s' || chr(10), '' ORDER BY segment) || '#EXT-X-ENDLIST' || chr(10) AS text FROM n GROUP BY conv_id")
def playlists(spark, sf_dir):
    """Playlists of those segments at two packets a second."""
    return container.playlist(segment_by_key(spark, sf_dir).where("segment IS NOT NULL"), ["conv_id"], 2)


@query("SELECT conv_id, turn, coalesce(lag(length(text) // 4) OVER (PARTITION BY conv_id ORDER BY turn) >= 256, true) AS entry FROM conversations")
def entry_point_gate(spark, sf_dir):
    """A turn's characters as bytes of four rows."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return scenes.entry_points(c, ["conv_id"], "turn", F.col("n"), F.lit(4)).drop("n")


@query("SELECT conv_id, count(*) AS n, (16 + sum(strlen(text) + 14 + 20))::BIGINT AS bytes FROM conversations GROUP BY 1")
def container_sizes(spark, sf_dir):
    """Conversations as streams of packets with a header each, put into containers."""
    t = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pkt_idx"), F.col("text").cast("binary").alias("body"))
    head = container.write_header(F.lit(1), F.lit(1280), F.lit(720), F.when(F.col("pkt_idx") == 0, 0xA0).otherwise(0), F.lit(30), F.col("pkt_idx"), F.lit(0x13), F.lit(1))
    p = t.select("conv_id", "pkt_idx", F.concat(head, F.col("body")).alias("payload"))
    n = p.groupBy("conv_id").agg(F.count("*").alias("n"))
    return container.mux(p, ["conv_id"]).join(n, "conv_id").select("conv_id", "n", F.length("data").cast("bigint").alias("bytes"))


# ── one-dimensional filter ──

_WEAK = "CASE WHEN abs({p0} - {q0}) < 30 THEN least(greatest({p0} + least(greatest((9 * ({q0} - {p0}) - 3 * ({q1} - {p1}) + 8) >> 4, -10), 10), 0), 255) ELSE {p0} END"


@query(
    "WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, least(floor(value)::BIGINT, 255) AS v FROM events), w AS (SELECT *, lag(v) OVER x AS a, lag(v, 2) OVER x AS a2, lead(v) OVER x AS b, lead(v, 2) OVER x AS b2 FROM e WINDOW x AS (PARTITION BY user_id ORDER BY k)) "
    f"SELECT user_id, k, CASE WHEN k % 4 = 3 AND b2 IS NOT NULL AND a IS NOT NULL THEN {_WEAK.format(p1='a', p0='v', q0='b', q1='b2')} WHEN k % 4 = 0 AND a2 IS NOT NULL AND b IS NOT NULL THEN {_WEAK.format(p1='b', p0='v', q0='a', q1='a2')} ELSE v END::BIGINT AS v FROM w"
)
def deblock_weak_1d(spark, sf_dir):
    """A user's values in order, an edge before every fourth."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.least(F.floor("value"), F.lit(255)).cast("bigint").alias("v"))
    e = e.select("user_id", (F.row_number().over(w) - 1).cast("bigint").alias("k"), "v", *[F.lag("v", n).over(w).alias(f"a{n}") for n in (1, 2)], *[F.lead("v", n).over(w).alias(f"b{n}") for n in (1, 2)])
    low, _ = edge(F.col("a1"), F.col("v"), F.col("b1"), F.col("b2"), 30)
    low2, _ = edge(F.col("b1"), F.col("v"), F.col("a1"), F.col("a2"), 30)
    v = F.when((F.col("k") % 4 == 3) & F.col("b2").isNotNull() & F.col("a1").isNotNull(), low).when((F.col("k") % 4 == 0) & F.col("a2").isNotNull() & F.col("b1").isNotNull(), low2).otherwise(F.col("v"))
    return e.select("user_id", "k", v.cast("bigint").alias("v"))


# ── measurements ──

#: Suppliers modulo seven as clips, return flags as codecs, line numbers as QPs.
_RDV = "rd(clip, codec, qp, bytes, psnr) AS (SELECT (l_suppkey % 7)::VARCHAR, CASE l_returnflag WHEN 'A' THEN 'base' WHEN 'N' THEN 'ours' ELSE 'before' END, l_linenumber, sum(l_orderkey)::BIGINT, round(avg(l_quantity + 10 * ln(l_linenumber + l_partkey % 7) - length(l_returnflag)), 4) FROM lineitem GROUP BY 1, 2, 3)"
_BD = f"""WITH {_RDV}, pt AS (SELECT clip, codec, psnr AS x, ln(bytes * 8.0::DOUBLE / 1000) AS y FROM rd), sg AS (SELECT clip, codec, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM pt WINDOW w AS (PARTITION BY clip, codec ORDER BY x)),
sp AS (SELECT clip, codec, min(x) AS lo, max(x) AS hi FROM pt GROUP BY 1, 2), pr AS (SELECT t.clip, t.codec, greatest(t.lo, b.lo) AS a, least(t.hi, b.hi) AS b FROM sp t JOIN sp b ON t.clip = b.clip AND b.codec = 'base' WHERE t.codec <> 'base'),
kn AS (SELECT DISTINCT pr.clip, pr.codec, a, b, k.x FROM pr JOIN (SELECT clip, codec, x FROM pt) k ON k.clip = pr.clip AND k.codec IN (pr.codec, 'base') AND k.x BETWEEN a AND b WHERE b > a UNION SELECT clip, codec, a, b, a FROM pr WHERE b > a UNION SELECT clip, codec, a, b, b FROM pr WHERE b > a),
ev AS (SELECT kn.clip, kn.codec, kn.a, kn.b, kn.x, min(t.y0 + (t.y1 - t.y0) * (kn.x - t.x0) / (t.x1 - t.x0)) - min(r.y0 + (r.y1 - r.y0) * (kn.x - r.x0) / (r.x1 - r.x0)) AS d FROM kn JOIN sg t ON t.clip = kn.clip AND t.codec = kn.codec AND kn.x BETWEEN t.x0 AND t.x1 JOIN sg r ON r.clip = kn.clip AND r.codec = 'base' AND kn.x BETWEEN r.x0 AND r.x1 GROUP BY 1, 2, 3, 4, 5),
ar AS (SELECT clip, codec, a, b, (lead(x) OVER w - x) * (lead(d) OVER w + d) / 2 AS s FROM ev WINDOW w AS (PARTITION BY clip, codec ORDER BY x)), bd AS (SELECT clip, codec, (exp(sum(s) / max(b - a)) - 1) * 100 AS v FROM ar GROUP BY 1, 2), ta AS (SELECT pr.clip, pr.codec, v FROM pr LEFT JOIN bd ON pr.clip = bd.clip AND pr.codec = bd.codec)"""


def _rd(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    codec = F.when(F.col("l_returnflag") == "A", "base").when(F.col("l_returnflag") == "N", "ours").otherwise("before")
    psnr = F.col("l_quantity") + F.ln(F.col("l_linenumber") + F.col("l_partkey") % 7) * 10 - 1
    p = t.groupBy((F.col("l_suppkey") % 7).cast("string").alias("clip"), codec.alias("codec"), F.col("l_linenumber").alias("qp")).agg(F.sum("l_orderkey").cast("bigint").alias("bytes"), F.round(F.avg(psnr), 4).alias("psnr"))
    return p.withColumn("rate", F.col("bytes") * 8 / 1000)


@query(f"{_BD} SELECT clip, codec, round(v, 6) AS bd_rate FROM ta UNION ALL SELECT 'OVERALL', codec, round(avg(v), 6) FROM ta GROUP BY codec")
def bd_rate_published(spark, sf_dir):
    """Curves of line items against those that were returned."""
    out = metrics.bd_overall(metrics.bd_rate(_rd(spark, sf_dir), ["clip"], "base"), "clip")
    return out.withColumn("bd_rate", F.round("bd_rate", 6))


@query(f"WITH {_RDV} SELECT clip, codec, qp::BIGINT AS qp, round(bytes * 8 / (30 / 25.0::DOUBLE) / 1000, 6) AS kbps, row_number() OVER (PARTITION BY clip, codec ORDER BY bytes)::BIGINT AS place FROM rd")
def rd_curves(spark, sf_dir):
    """Bitrates of 30 frames at 25 a second, curves in order of rate."""
    from pyspark.sql import Window

    kbps = metrics.bitrate_kbps(F.col("bytes"), F.lit(30.0), F.lit(25.0))
    place = F.row_number().over(Window.partitionBy("clip", "codec").orderBy("bytes")).cast("bigint")
    return _rd(spark, sf_dir).select("clip", "codec", F.col("qp").cast("bigint").alias("qp"), F.round(kbps, 6).alias("kbps"), place.alias("place"))


@query("WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, max(value) AS best, max(value) FILTER (WHERE k = n // 2 + 1) AS median, max(n) AS n FROM r GROUP BY 1")
def median_best_of_n(spark, sf_dir):
    return metrics.best_and_median(table(spark, sf_dir, "events"), ["user_id"], "value")


@query("SELECT o_orderpriority, count(*) AS frames, sum(o_custkey)::BIGINT AS bytes, round(avg(o_totalprice), 4) AS psnr, round(sum(o_orderkey) / sum(o_custkey), 6)::DOUBLE AS ratio FROM orders GROUP BY 1")
def run_totals(spark, sf_dir):
    """Orders as frames of a run."""
    o = table(spark, sf_dir, "orders").select("o_orderpriority", F.col("o_custkey").alias("size"), F.col("o_orderkey").alias("raw"), F.col("o_totalprice").alias("psnr"))
    return metrics.totals(o, ["o_orderpriority"]).withColumns({"psnr": F.round("psnr", 4), "ratio": F.round("ratio", 6)})


@query("WITH l AS (SELECT user_id, CASE WHEN event_type = 'error' THEN 100.0::DOUBLE ELSE value END AS v FROM events) SELECT user_id, round(avg(v), 6) AS mean, count(*) AS frames, count(*) = 100 AS ok FROM l GROUP BY 1")
def metric_log_means(spark, sf_dir):
    """Events as log lines, errors as infinite values; a hundred lines a user are expected."""
    text = F.concat(F.lit("n:1 psnr_y:"), F.when(F.col("event_type") == "error", "inf").otherwise(F.col("value").cast("string")), F.lit(" end"))
    lines = table(spark, sf_dir, "events").select("user_id", text.alias("line"))
    return metrics.metric_log(lines, ["user_id"], "psnr_y", F.lit(100)).withColumn("mean", F.round("mean", 6))


@query("WITH b AS (SELECT min(l_extendedprice) AS x FROM lineitem) SELECT l_shipdate::DATE AS day, sum(l_extendedprice) < 1000000 * 0.995 AND avg(l_quantity) - 26 > -0.5 AS keep FROM lineitem GROUP BY 1")
def score_guard(spark, sf_dir):
    """Days as tuning steps against a base of a million bytes and 26 decibels."""
    d = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.sum("l_extendedprice").alias("bytes"), F.avg("l_quantity").alias("psnr"))
    return metrics.keep_scores(d, ["day"], F.lit(1_000_000.0), F.lit(26.0)).select("day", "keep")


@query(
    "WITH RECURSIVE d AS (SELECT l_suppkey % 7 AS mode, l_shipdate::DATE AS day, sum(l_partkey)::DOUBLE AS bytes, round(avg(l_quantity), 6) AS psnr FROM lineitem GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY day) AS k FROM d), "
    "s AS (SELECT DISTINCT mode, 0::BIGINT AS k, NULL::DATE AS day, 1e12::DOUBLE AS bb, 26.0::DOUBLE AS bp, false AS keep FROM d UNION ALL SELECT n.mode, n.k, n.day, CASE WHEN n.bytes < s.bb * 0.995 AND n.psnr - s.bp > -0.5 THEN n.bytes ELSE s.bb END, "
    "CASE WHEN n.bytes < s.bb * 0.995 AND n.psnr - s.bp > -0.5 THEN n.psnr ELSE s.bp END, n.bytes < s.bb * 0.995 AND n.psnr - s.bp > -0.5 FROM s JOIN n ON n.mode = s.mode AND n.k = s.k + 1) SELECT mode, day, keep FROM s WHERE k > 0"
)
def score_chain(spark, sf_dir):
    """Days as tuning steps by supplier modulo seven, where each kept one is the base of those after it."""
    d = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 7).alias("mode"), F.to_date("l_shipdate").alias("day")).agg(F.sum("l_partkey").cast("double").alias("bytes"), F.round(F.avg("l_quantity"), 6).alias("psnr"))
    return sweeps.accepted(d, ["mode"], "day", 1e12, 26.0).select("mode", "day", "keep")


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def content_manifest(spark, sf_dir):
    """Digests of whole contents."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query("SELECT source, count(*) AS n, count(DISTINCT lang) AS langs FROM documents GROUP BY ROLLUP (source)")
def clip_rollup(spark, sf_dir):
    """Counts and distinct values a source, and overall."""
    return table(spark, sf_dir, "documents").rollup("source").agg(F.count("*").alias("n"), F.count_distinct("lang").alias("langs"))


@query("SELECT day(ts)::BIGINT AS day, sum(length(props))::BIGINT * 8 / (count(*)::DOUBLE / 30.0::DOUBLE) / 1000 AS kbps FROM events GROUP BY 1")
def daily_kbps(spark, sf_dir):
    """Events as frames of as many bytes as their properties have, 30 a second."""
    n = table(spark, sf_dir, "events").groupBy(F.dayofmonth("ts").cast("bigint").alias("day")).agg(F.count("*").alias("n"), F.sum(F.length("props")).alias("size"))
    return n.select("day", metrics.bitrate_kbps(F.col("size"), F.col("n").cast("double"), F.lit(30.0)).alias("kbps"))


@query("SELECT vec_id // 16 AS frame, vec_id % 16 AS cell, label::BIGINT AS label, CASE WHEN lag(vec_id // 16) OVER w = vec_id // 16 - 1 THEN lag(label) OVER w END::BIGINT AS before FROM embeddings WHERE vec_id % 5 <> 0 WINDOW w AS (PARTITION BY vec_id % 16 ORDER BY vec_id // 16)")
def previous_vectors(spark, sf_dir):
    """Embeddings as cells of a grid of vectors, sixteen a frame and a fifth of them missing: the cell's vector one frame before."""
    e = table(spark, sf_dir, "embeddings").where("vec_id % 5 <> 0")
    e = e.select(F.floor(F.col("vec_id") / 16).alias("frame"), (F.col("vec_id") % 16).alias("cell"), F.col("label").cast("bigint").alias("label"))
    return order.previous_grid(e, [], "frame", ["cell"], "label")


@query("SELECT l_orderkey, l_linenumber, r::BIGINT AS r, (r * 7) // 3 AS q, -((r * 7) // 3) AS m FROM (SELECT l_orderkey, l_linenumber, l_partkey AS r FROM lineitem)")
def truncating_division(spark, sf_dir):
    """Quotients truncate towards zero."""
    r = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("r"))
    return r.select("l_orderkey", "l_linenumber", "r", div(F.col("r") * 7, 3).alias("q"), div(F.col("r") * -7, 3).alias("m"))


# ── streams with time ──

#: Turns a second apart, conversations a minute; in the first half of the table a tenth of the third turns comes at the very end, far too late.
_TIMED = (
    "t AS (SELECT conv_id AS clip, turn AS idx, (conv_id + 1) * 60 + turn AS ts, conv_id % 10 = 0 AND turn = 2 AND conv_id * 2 < (SELECT max(conv_id) FROM conversations) AS late FROM conversations), "
    "o AS (SELECT *, max(idx) OVER w AS top, max(ts) OVER w AS newest, row_number() OVER (PARTITION BY clip ORDER BY idx) - 1 AS place FROM t WHERE NOT late WINDOW w AS (PARTITION BY clip)), "
    "g AS (SELECT *, min(CASE WHEN place <> idx THEN idx END) OVER (PARTITION BY clip) AS gap, newest + 1800 <= (SELECT max(ts) FROM t) - 600 AS over FROM o)"
)


def _frames_in_time(spark, sf_dir, folder):
    """Conversations as a stream of eight files in the order of time, the late turns in the last one."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("clip"), F.col("turn").alias("idx"), ((F.col("conv_id") + 1) * 60 + F.col("turn")).alias("s"))
    top = c.agg(F.max("clip").alias("top"), F.max("s").alias("end")).first()
    late = (F.col("clip") % 10 == 0) & (F.col("idx") == 2) & (F.col("clip") * 2 < top["top"])
    part = F.when(late, 7).otherwise(F.least(F.floor(F.col("s") * 7 / (top["end"] + 1)), F.lit(6))).cast("int")
    dealt = c.select("clip", "idx", F.timestamp_seconds("s").alias("ts"), part.alias("part"))
    for k in range(8):  # one after the other, as a stream takes files by their times
        dealt.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema("clip long, idx long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


@query(
    f"WITH {_TIMED}, f AS (SELECT *, CASE WHEN idx = 0 THEN true ELSE (idx + 3) // 4 * 4 <= top AND ((idx + 3) // 4 * 4 < coalesce(gap - 1, top + 1)) END AS grouped FROM g) "
    "SELECT clip, idx, CASE WHEN grouped AND idx > 0 THEN (idx + 3) // 4 * 4 - 4 + CASE (idx + 3) // 4 * 4 - idx WHEN 0 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 4 END ELSE place END AS place, NOT grouped AS flushed FROM f WHERE grouped OR over"
)
def stream_coding_order(spark, sf_dir):
    """Turns as frames of a stream: full groups at once in coding order, tails and what waits for a lost frame by a timer."""
    folder = scratch(spark)
    frames = _frames_in_time(spark, sf_dir, folder)
    return timed.run(spark, timed.ordered(frames, timed.CodingOrder(1_800_000), "600 seconds"), folder)


@query(f"WITH {_TIMED} SELECT clip, idx, place, idx >= coalesce(gap, top + 1) AS flushed FROM g WHERE idx < coalesce(gap, top + 1) OR over")
def stream_display_order(spark, sf_dir):
    """The same frames in display order: each when it is due, those behind a lost one by a timer."""
    folder = scratch(spark)
    frames = _frames_in_time(spark, sf_dir, folder)
    return timed.run(spark, timed.ordered(frames, timed.DisplayOrder(1_800_000), "600 seconds"), folder)
