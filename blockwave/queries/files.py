"""Queries that write files and read them again. Stand-ins: generated frames, pages and test items as packets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bits import crc16
from ..functions.ints import byte_at, bytes_be, bytes_le
from ..sources import container, files, records
from .common import scratch, table

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


# ── raw frames ──

_SAMPLES = "e AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS f, list_transform(embedding, lambda e: least(greatest(floor(e::DOUBLE * 512)::BIGINT + 128, 0), 255)) AS b FROM embeddings)"


def _plane_sql(name: str, first: int, n: int) -> str:
    return f"SELECT f, '{name}' AS plane, list_sum(b[{first + 1}:{first + n}])::BIGINT AS total, list_sum(list_transform(b[{first + 1}:{first + n}], lambda v, i: v * (i - 1)))::BIGINT AS weighted FROM e"


def _samples(spark, sf_dir):
    """(name, vec_id, data): embeddings as raw frames of 64 bytes, all of one stream."""
    byte = F.transform("embedding", lambda e: F.lpad(F.hex(F.least(F.greatest(F.floor(e.cast("double") * 512) + 128, F.lit(0)), F.lit(255))), 2, "0"))
    return table(spark, sf_dir, "embeddings").select(F.lit("clip").alias("name"), "vec_id", F.unhex(F.array_join(byte, "")).alias("data"))


def _sums(frames: DataFrame, **planes: tuple[int, int]) -> DataFrame:
    """(f, plane, total, weighted) of parts of frames, by first byte and length."""
    parts = F.array(*[F.struct(F.lit(k).alias("plane"), F.substring("data", a + 1, n).alias("d")) for k, (a, n) in planes.items()])
    each = frames.select(F.col("frame_idx").alias("f"), F.inline(parts))
    v = each.select("f", "plane", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("d")), lambda i: byte_at(F.col("d"), i))).alias("p", "v"))
    return v.groupBy("f", "plane").agg(F.sum("v").cast("bigint").alias("total"), F.sum(F.col("v") * F.col("p")).cast("bigint").alias("weighted"))


@query(f"WITH {_SAMPLES} " + " UNION ALL ".join((_plane_sql("y", 0, 40), _plane_sql("cb", 40, 12), _plane_sql("cr", 52, 12))))
def raw_frame_files(spark, sf_dir):
    """Frames of three planes as one raw stream, written by all tasks in ranges and read by ranges of bytes."""
    path = scratch(spark)
    files.write(_samples(spark, sf_dir), "name", ["vec_id"], "data", path, "frames")
    return _sums(files.read(spark, path, "frames", frame=64), y=(0, 40), cb=(40, 12), cr=(52, 12))


@query(f"WITH {_SAMPLES}, g AS (SELECT (vec_id // 50)::BIGINT AS clip, row_number() OVER (PARTITION BY vec_id // 50 ORDER BY vec_id) - 1 AS f, b[1:48] AS b FROM e) SELECT clip, f, list_sum(b)::BIGINT AS total, list_sum(list_transform(b, lambda v, i: v * (i - 1)))::BIGINT AS weighted FROM g WHERE f >= 3")
def raw_rgb_files(spark, sf_dir):
    """Packed colours, 16 samples of three bytes, a clip a file; the first three frames of each are skipped by the reader."""
    path, s = scratch(spark), _samples(spark, sf_dir)
    own = s.select(F.concat(F.lit("c"), F.floor(F.col("vec_id") / 50).cast("string")).alias("name"), "vec_id", F.substring("data", 1, 48).alias("data"))
    files.write(own, "name", ["vec_id"], "data", path, "frames")
    found = files.read(spark, path, "frames", frame=48).where("frame_idx >= 3").withColumn("clip", F.regexp_extract("stream_id", "c([0-9]+)$", 1).cast("bigint"))
    v = found.select("clip", F.col("frame_idx").alias("f"), F.posexplode(F.transform(F.sequence(F.lit(1), F.length("data")), lambda i: byte_at(F.col("data"), i))).alias("p", "v"))
    return v.groupBy("clip", "f").agg(F.sum("v").cast("bigint").alias("total"), F.sum(F.col("v") * F.col("p")).cast("bigint").alias("weighted"))


# ── packets ──


def _packets(spark, sf_dir):
    """Pages as packets: a header, a key one for every fourth page, and the page."""
    key = F.when(F.col("page_id") % 4 == 0, container.KEY).otherwise(0)
    head = container.write_header(F.lit(0), F.lit(320), F.lit(240), key, F.lit(32), F.col("page_id"), F.lit(0), F.lit(0))
    p = table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 16).alias("stream"), "page_id", F.col("page_id").alias("pkt_idx"), F.concat(head, F.col("html").cast("binary")).alias("payload"))
    return p.withColumn("name", F.concat(F.lit("s"), F.col("stream").cast("string")))


_PACKET = "SELECT page_id // 16 AS stream, row_number() OVER (PARTITION BY page_id // 16 ORDER BY page_id) - 1 AS k, 12 + strlen(html) AS size, page_id % 4 = 0 AS key, sha256(html) AS digest FROM pages"


def _scanned(found: DataFrame) -> DataFrame:
    stream = F.regexp_extract("stream_id", "s([0-9]+)$", 1).cast("bigint").alias("stream")
    body = F.col("payload").substr(F.lit(13), F.length("payload"))
    return found.where("error = ''").select(stream, F.col("pkt_idx").alias("k"), F.col("size").cast("bigint").alias("size"), "key", F.sha2(body, 256).alias("digest"))


@query(_PACKET)
def packet_stream_files(spark, sf_dir):
    """Length-prefixed streams written and scanned."""
    path, p = scratch(spark), _packets(spark, sf_dir)
    container.write_binary(container.stream_bytes(p, ["name"]), "name", "data", path)
    return _scanned(container.scan(spark, path))


@query(_PACKET)
def container_files(spark, sf_dir):
    """Containers written (mux), scanned with their flags checked (demux), written as streams and scanned again."""
    path, again, p = scratch(spark), scratch(spark), _packets(spark, sf_dir)
    container.write_binary(container.mux(p, ["name"]), "name", "data", path)
    good = container.scan(spark, path, "container").where("error = ''")
    name = F.regexp_extract("stream_id", "(s[0-9]+)$", 1).alias("name")
    container.write_binary(container.stream_bytes(good.select(name, "pkt_idx", "payload"), ["name"]), "name", "data", again)
    return _scanned(container.scan(spark, again))


_ALL = "SELECT page_id, row_number() OVER (ORDER BY page_id) - 1 AS k, 12 + strlen(html) AS size, page_id % 4 = 0 AS key, html FROM pages"


@query(f"WITH a AS ({_ALL}) SELECT k, 2 * k AS pts, size, key, sha256(html) AS digest FROM a")
def packet_parts(spark, sf_dir):
    """All pages as one container, of which every task writes a part, read again by ranges of bytes."""
    path, p = scratch(spark), _packets(spark, sf_dir)
    files.write(p.withColumn("name", F.lit("all")), "name", ["page_id"], "payload", path, "container", pts=F.col("place") * 2)
    body = F.col("payload").substr(F.lit(13), F.length("payload"))
    return files.read(spark, path, "container").where("error = ''").select(F.col("pkt_idx").alias("k"), "pts", F.col("size").cast("bigint").alias("size"), "key", F.sha2(body, 256).alias("digest"))


@query(f"WITH a AS ({_ALL}) SELECT k, size FROM a WHERE key AND k BETWEEN 11 AND (SELECT count(*) // 2 FROM pages)")
def packet_filters(spark, sf_dir):
    """Sizes of key packets from the 12th to the middle of a stream: payloads and other packets are not read."""
    path, pages = scratch(spark), table(spark, sf_dir, "pages")
    files.write(_packets(spark, sf_dir).withColumn("name", F.lit("all")), "name", ["page_id"], "payload", path)
    half = pages.count() // 2
    found = files.read(spark, path, columns="pkt_idx,size,key").where(F.col("key") & (F.col("pkt_idx") > 10) & (F.col("pkt_idx") <= half))
    return found.select(F.col("pkt_idx").alias("k"), F.col("size").cast("bigint").alias("size"))


def _little(v: str, n: int) -> str:
    """SQL of the lower-endian bytes of a number, as hexadecimal digits."""
    return " || ".join(f"printf('%02X', ({v}) // {256**i} % 256)" for i in range(n))


_HEADED = "'54435600014000F0' || CASE WHEN page_id % 4 = 0 THEN '80' ELSE '00' END || '00' || printf('%02X', page_id % 256) || '00' || hex(encode(html))"


@query(
    f"WITH p AS (SELECT page_id // 16 AS stream, page_id, row_number() OVER (PARTITION BY page_id // 16 ORDER BY page_id) - 1 AS k, page_id % 4 = 0 AS key, {_HEADED} AS h FROM pages), "
    f"r AS (SELECT stream, k, '504B5430' || {_little('k', 8)} || {_little('length(h) // 2', 4)} || CASE WHEN key THEN '01' ELSE '00' END || '000000' || h AS h FROM p), "
    "f AS (SELECT stream, '54434D58' || '01000000' || '1E000000' || '00000000' || string_agg(h, '' ORDER BY k) AS h FROM r GROUP BY stream) SELECT stream, length(h) // 2 AS bytes, sha256(unhex(h)) AS digest FROM f"
)
def container_bytes(spark, sf_dir):
    """The files of containers, byte by byte; the parts of a stream that two tasks have written are laid end to end."""
    path = scratch(spark)
    files.write(_packets(spark, sf_dir), "name", ["page_id"], "payload", path, "container")
    found = spark.read.format("binaryFile").option("pathGlobFilter", "s*").load(path)
    named = [F.regexp_extract("path", r"s([0-9]+)\.([0-9]+)$", k).cast("bigint").alias(c) for k, c in ((1, "stream"), (2, "part"))]
    parts = found.select(*named, "content").groupBy("stream").agg(F.array_sort(F.collect_list(F.struct("part", "content"))).alias("l"))
    whole = F.when(F.size("l") == 1, F.get("l", F.lit(0))["content"]).otherwise(F.unhex(F.array_join(F.transform("l", lambda p: F.hex(p["content"])), "")))
    return parts.select("stream", whole.alias("d")).select("stream", F.length("d").cast("bigint").alias("bytes"), F.sha2("d", 256).alias("digest"))


#: Malformed files: name, kind, the bytes that follow two good packets (or stand alone, where they begin a file), the row that says so.
_BAD = (
    ("none", "container", "", None, None), ("length", "stream", "0102", 2, "length"), ("opening", "container", "=54434D58", 0, "magic"), ("zero", "stream", "00000000", 2, "length"),
    ("foreign", "container", "=52494646" + "00" * 12, 0, "magic"), ("huge", "stream", "FFFFFF7F00", 2, "length"), ("version", "container", "=54434D58630000001E00000000000000", 0, "header"), ("short", "stream", "0A000000" + "00" * 4, 2, "truncated"),
    ("rate", "container", "=54434D58010000000000000000000000", 0, "header"), ("whole", "stream", "", None, None), ("record", "container", "42414430" + "00" * 8 + "0E00000001000000" + "544356" + "00" * 11, 2, "record"),
    ("payload", "container", "504B5430" + "00" * 8 + "0E00000001000000" + "54435600", 2, "record"), ("flag", "container", "504B5430" + "00" * 8 + "0E00000002000000" + "544356" + "00" * 11, 2, "record"),
    ("unlike", "container", "504B5430" + "00" * 8 + "0E00000001000000" + "544356" + "00" * 11, 2, "record"), ("reserved", "container", "504B5430" + "00" * 8 + "0E00000000000100" + "544356" + "00" * 11, 2, "record"),
    ("empty", "container", "504B5430" + "00" * 8 + "0000000000000000", 2, "record"), ("cut", "container", "504B543000", 2, "record"), ("tiny", "container", "504B5430" + "00" * 8 + "0300000000000000544356", 2, "record"),
)
_BAD_SQL = "(VALUES " + ", ".join(f"({i}, '{name}', {'NULL' if at is None else at}, {'NULL' if error is None else repr(error)}, {str(tail.startswith('=')).lower()})" for i, (name, _, tail, at, error) in enumerate(_BAD)) + ") b(i, name, place, error, alone)"


@query(
    f"WITH p AS (SELECT page_id // 4 AS stream, row_number() OVER (PARTITION BY page_id // 4 ORDER BY page_id) - 1 AS k, html FROM pages), j AS (SELECT p.*, b.* FROM p JOIN {_BAD_SQL} ON p.stream % {len(_BAD)} = b.i WHERE k < 2) "
    "SELECT stream, name, k, (12 + strlen(html))::BIGINT AS size, '' AS error FROM j WHERE NOT alone UNION ALL SELECT DISTINCT stream, name, place::BIGINT, 0::BIGINT, error FROM j WHERE error IS NOT NULL"
)
def malformed_files(spark, sf_dir):
    """Two pages as packets and then one of the things that can be wrong with a file: each is a row with its error."""
    path = scratch(spark)
    p = _packets(spark, sf_dir).withColumn("stream", F.floor(F.col("page_id") / 4))
    two = files.numbered(p, ["stream"], ["page_id"]).where("place < 2")
    kinds = spark.createDataFrame([(i, name, kind, tail.lstrip("="), tail.startswith("=")) for i, (name, kind, tail, _, _) in enumerate(_BAD)], "i long, what string, kind string, tail string, alone boolean")
    key = (F.col("page_id") % 4 == 0).cast("int")
    record = F.concat(F.lit(b"PKT0"), bytes_le(F.col("place"), 8), bytes_le(F.length("payload"), 4), bytes_le(key, 1), F.unhex(F.lit("000000")), F.col("payload"))
    one = F.when(F.col("kind") == "container", record).otherwise(F.concat(bytes_le(F.length("payload"), 4), F.col("payload")))
    j = two.join(F.broadcast(kinds), F.col("stream") % len(_BAD) == F.col("i")).withColumn("d", F.hex(one))
    whole = j.groupBy("stream", "what", "kind", "tail", "alone").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "d"))), lambda s: s["d"]), "").alias("d"))
    head = F.when(F.col("kind") == "container", "54434D58010000001E00000000000000").otherwise("")
    data = F.when(F.col("alone"), F.col("tail")).otherwise(F.concat(head, "d", "tail"))
    out = None
    for kind in ("container", "stream"):
        own = whole.where(F.col("kind") == kind).select(F.concat_ws("-", "what", F.col("stream").cast("string")).alias("name"), F.unhex(data).alias("data"))
        container.write_binary(own, "name", "data", f"{path}-{kind}")
        found = files.read(spark, f"{path}-{kind}", kind, "stream_id,pkt_idx,size,error")
        out = found if out is None else out.union(found)
    named = F.regexp_extract("stream_id", "([a-z]+)-[0-9]+$", 1), F.regexp_extract("stream_id", "-([0-9]+)$", 1).cast("bigint")
    return out.select(named[1].alias("stream"), named[0].alias("name"), F.col("pkt_idx").alias("k"), F.col("size").cast("bigint").alias("size"), "error")


@query("SELECT page_id // 16 AS stream, row_number() OVER (PARTITION BY page_id // 16 ORDER BY page_id) - 1 AS k, 12 + strlen(html) AS size, sha256(html) AS digest FROM pages")
def mp4_files(spark, sf_dir):
    """Streams as MP4 files and back by their sample tables."""
    path, p = scratch(spark), _packets(spark, sf_dir)
    container.write_binary(container.mp4(p, ["name"], 320, 240), "name", "data", path)
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "s([0-9]+)$", 1).cast("bigint").alias("stream"), F.col("content").alias("data"))
    out = container.mp4_packets(files, ["stream"]).where("error = ''")
    return out.select("stream", F.col("pkt_idx").alias("k"), F.length("payload").cast("bigint").alias("size"), F.sha2(F.col("payload").substr(F.lit(13), F.length("payload")), 256).alias("digest"))


_HEX_CRC = "list_reduce(list_transform(range(0, length(h) // 2 - 2), lambda i: ('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::BIGINT), lambda crc, byte: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda c, k: CASE WHEN c >= 32768 THEN xor((c * 2) & 65535, 4129) ELSE (c * 2) & 65535 END, xor(crc, byte * 256)), 65535::BIGINT)"


@query(
    "WITH b AS (SELECT item_id, text, '54435601014000F0' || printf('%02X', CASE WHEN item_id % 5 = 0 THEN 0 ELSE 16 END) || '00' || printf('%02X', item_id % 256) || '000000' || hex(encode(text)) AS body FROM benchmark), "
    "w AS (SELECT item_id, body || CASE WHEN item_id % 3 = 0 THEN 'BEEF' ELSE '0000' END AS h, item_id % 3 <> 0 AS right_ FROM b), "
    f"c AS (SELECT item_id, right_, substr(h, length(h) - 3) AS tail, {_HEX_CRC} AS crc FROM w) "
    "SELECT item_id, CASE WHEN item_id % 5 = 0 OR right_ THEN true ELSE crc = 48879 END AS valid FROM c"
)
def packet_crc(spark, sf_dir):
    """Test items as packets with a CRC, a wrong one in every third; packets without the flag are not checked."""
    flags = F.when(F.col("item_id") % 5 == 0, 0).otherwise(container.CRC)
    head = container.write_header(F.lit(1), F.lit(320), F.lit(240), flags, F.lit(32), F.col("item_id"), F.lit(0), F.lit(0))
    p = table(spark, sf_dir, "benchmark").select("item_id", F.concat(head, F.col("text").cast("binary")).alias("body"))
    crc = F.when(F.col("item_id") % 3 == 0, F.lit(0xBEEF)).otherwise(crc16(F.col("body")))
    return p.select("item_id", container.crc_valid(F.concat("body", bytes_be(crc, 2))).alias("valid"))


@query("SELECT l_orderkey::VARCHAR AS clip, l_returnflag AS codec, l_linenumber::INT AS qp, l_extendedprice AS rate, l_quantity AS psnr FROM lineitem WHERE l_orderkey % 10 <> 0 AND l_extendedprice > 0 AND l_quantity > 0")
def result_files(spark, sf_dir):
    """Line items as results appended to CSV files, a tenth of them without a number, and read as rate points."""
    path = scratch(spark)
    rate = F.when(F.col("l_orderkey") % 10 == 0, "n/a").otherwise(F.col("l_extendedprice").cast("string"))
    r = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("clip"), F.col("l_returnflag").alias("codec"), F.col("l_linenumber").alias("qp"), rate.alias("bitrate_kbps"), F.col("l_quantity").alias("psnr_y"), "l_suppkey")
    for part in (0, 1):
        records.write_results(r.where(F.col("l_suppkey") % 2 == part).drop("l_suppkey"), path)
    return records.rd_points(spark, path)


@query("SELECT p_name AS id, p_partkey::BIGINT AS fetch_bytes, p_size::INT AS w, p_retailprice AS dur_s, p_type AS class FROM part WHERE p_partkey % 7 <> 0")
def corpus_files(spark, sf_dir):
    """Parts as a corpus list with comments, blank lines, a header and short rows, and read again."""
    path = scratch(spark)
    fields = F.concat_ws("\t", "p_name", F.lit("u"), F.col("p_partkey").cast("string"), F.lit("0"), F.col("p_retailprice").cast("string"), F.col("p_size").cast("string"), F.lit("9"), F.lit("30"), "p_type")
    line = F.when(F.col("p_partkey") % 7 != 0, fields).when(F.col("p_partkey") % 14 == 0, F.concat(F.lit("# "), fields)).otherwise(F.lit("short\trow"))
    lines = table(spark, sf_dir, "part").select(line.alias("value"))
    odd = spark.createDataFrame([("id\turl\tfetch_bytes\tseek_s\tdur_s\tw\th\tfps\tclass",), ("",)], "value string")
    lines.unionAll(odd).write.text(path)
    return records.corpus(spark, path).select("id", "fetch_bytes", "w", "dur_s", "class")
