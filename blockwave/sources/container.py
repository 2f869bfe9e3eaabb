"""Packets: frame headers, the length-prefixed stream, the record container, playlists and sample tables.

Everything that is set-oriented is a column expression; files are read and written by ``sources.files``.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.bits import crc16
from ..functions.ints import byte_at, bytes_be, bytes_le, clip, div, int_be, int_le
from ..operators.order import offsets, segments
from .files import read
from .formats import CRC, DEFAULT_QP, EXTENDED, HEADER, KEY, LARGEST, LARGEST_SIDE, LEVELS, MAGIC, NEWEST, PROFILES, RAP, RECORD_MAGIC, SEGMENT_MAGIC, STREAM_MAGIC, TOOLS, VERSION


def levels(spark: SparkSession) -> DataFrame:
    """(level, max_width, max_height, max_dpb, max_bitrate): nine rows."""
    return spark.createDataFrame(list(LEVELS), "level int, max_width int, max_height int, max_dpb int, max_bitrate bigint")


def parse_header(p: Column) -> Column:
    """A struct of the header's fields. ``error`` is empty or names the first thing wrong: short, magic,
    version, size, tools, profile, level."""
    version = byte_at(p, 4)
    later = version > 0
    w, h, flags = int_be(p, 5, 2), int_be(p, 7, 2), byte_at(p, 9)
    delta, pl, tools = byte_at(p, 10), byte_at(p, 12), int_be(p, 13, 2)
    on = lambda bit: later & (flags.bitwiseAND(F.lit(bit)) != 0)
    level = pl.bitwiseAND(F.lit(15))
    wide = F.get(F.array(*[F.lit(x[1]) for x in LEVELS]), level)
    high = F.get(F.array(*[F.lit(x[2]) for x in LEVELS]), level)
    over = (level > 0) & (level < len(LEVELS)) & ((w > wide) | (h > high))
    error = (
        F.when(F.substring(p, 1, 3) != F.lit(MAGIC), "magic")
        .when(F.length(p) < F.when(later, 14).otherwise(12), "short")
        .when(version > NEWEST, "version")
        .when((w == 0) | (h == 0) | (w > LARGEST_SIDE) | (h > LARGEST_SIDE), "size")
        .when(later & (tools.bitwiseAND(F.lit(0xFFFF & ~TOOLS)) != 0), "tools")
        .when(later & (F.shiftright(pl, 4) > PROFILES), "profile")
        .when(later & over, "level")
        .otherwise("")
    )
    key = flags.bitwiseAND(F.lit(KEY)) != 0
    extra = byte_at(p, 15)
    kind = F.when(on(EXTENDED), F.when(extra == 0, "key").when(extra == 2, "both").otherwise("inter")).when(key, "key").otherwise("inter")
    signed = F.when(delta > 127, delta - 256).otherwise(delta)
    fields = {
        "version": version, "width": w, "height": h, "flags": flags, "qp_delta": signed, "frame_num": byte_at(p, 11),
        "profile": F.when(later, F.shiftright(pl, 4)).otherwise(0), "level": F.when(later, level).otherwise(0), "tools": F.when(later, tools).otherwise(0),
        "frame_type": kind, "qp": clip(signed + DEFAULT_QP, 0, 63), "key": key, "is_rap": on(RAP), "has_crc": on(CRC), "has_ext": on(EXTENDED), "error": F.coalesce(error, F.lit("short")),
    }
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def write_header(version: Column, width: Column, height: Column, flags: Column, qp: Column, frame_num: Column, profile_level: Column, tools: Column) -> Column:
    """The bytes of a header: 12 for version 0, 14 later."""
    start = F.concat(F.lit(MAGIC), bytes_be(version, 1), bytes_be(width, 2), bytes_be(height, 2), bytes_be(flags, 1), bytes_be((qp - DEFAULT_QP).bitwiseAND(F.lit(255)), 1), bytes_be(frame_num.bitwiseAND(F.lit(255)), 1))
    return F.when(version == 0, F.concat(start, bytes_be(F.lit(0), 1))).otherwise(F.concat(start, bytes_be(profile_level, 1), bytes_be(tools, 2)))


# ── files ──


def scan(spark: SparkSession, path: str, kind: str = "stream", columns: str = "") -> DataFrame:
    """Packets of files, one row each, a bad one with its error: ``files.read``, by ranges of bytes."""
    return read(spark, path if "://" in path else f"file://{path}", kind, columns)


def frame_records(spark: SparkSession, path: str, width: int, height: int, rgb: bool = False) -> DataFrame:
    """(path, frame_idx, y, cb, cr) or (path, frame_idx, rgb) of raw frames; a short last frame is left out."""
    luma, chroma = width * height, (width // 2) * (height // 2)
    size = 3 * luma if rgb else luma + 2 * chroma
    # Spark's fixed-length record reader splits large files; binaryFile gives a file whole.
    files = spark.read.format("binaryFile").load(path)
    n = div(F.length("content"), size)
    at = files.where(n > 0).select("path", "content", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)).alias("frame_idx"))
    part = lambda a, k: F.substring("content", (F.col("frame_idx") * size + a + 1).cast("int"), F.lit(k))
    if rgb:
        return at.select("path", "frame_idx", part(0, size).alias("rgb"))
    return at.select("path", "frame_idx", part(0, luma).alias("y"), part(luma, chroma).alias("cb"), part(luma + chroma, chroma).alias("cr"))


def write_binary(rows: DataFrame, name: str, data: str, path: str) -> int:
    """Write each row's bytes as one file of the folder, in tasks, and give their number. A file gets its name
    when it is whole, so a task that fails or runs twice leaves no half a file. ``path`` is of a store that
    pyarrow opens."""

    def run(batches: Iterator) -> Iterator:
        import uuid

        import pyarrow as pa
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(path)
        store.create_dir(top)
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                part = f"{top}/.{file}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(content or b"")
                store.move(part, f"{top}/{file}")
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    return rows.select(F.col(name).cast("string"), data).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


# ── packets as bytes ──


def _joined(listed: str) -> Column:
    """The bytes ``d`` of a list of structs, laid end to end at once."""
    return F.unhex(F.array_join(F.transform(listed, lambda s: F.hex(s["d"])), ""))


def crc_valid(p: Column) -> Column:
    """Whether a packet's last two bytes are the CRC of all before them; true for packets that have none."""
    head = parse_header(p)
    stored, body = p.substr(F.length(p) - 1, F.lit(2)), p.substr(F.lit(1), F.length(p) - 2)
    return F.when(head["has_crc"] & (head["version"] > 0), F.conv(F.hex(stored), 16, 10).cast("int") == crc16(body)).otherwise(True)


def stream_bytes(packets: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, data): each stream's packets with their lengths, in order. A stream is one value of at most 2 GB."""
    one = F.concat(bytes_le(F.length("payload"), 4), F.col("payload"))
    listed = packets.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pkt_idx", one.alias("d")))).alias("l"))
    return listed.select(*keys, _joined("l").alias("data"))


def mux(packets: DataFrame, keys: list[str], fps: int = 30, segment: bool = False) -> DataFrame:
    """(keys, data): each stream as a container; pts is the place in the stream."""
    w = Window.partitionBy(*keys).orderBy("pkt_idx")
    key = byte_at(F.col("payload"), 9).bitwiseAND(F.lit(KEY)) != 0
    p = packets.select(*keys, "payload", (F.row_number().over(w) - 1).alias("pts"), key.cast("int").alias("k"))
    record = F.concat(F.lit(RECORD_MAGIC), bytes_le(F.col("pts"), 8), bytes_le(F.length("payload"), 4), bytes_le(F.col("k"), 1), F.unhex(F.lit("000000")), F.col("payload"))
    listed = p.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pts", record.alias("d")))).alias("l"))
    head = struct.pack("<4sIII", SEGMENT_MAGIC if segment else STREAM_MAGIC, VERSION, fps or 30, 0)
    return listed.select(*keys, F.concat(F.lit(head), _joined("l")).alias("data"))


def parse_container(p: Column) -> Column:
    """struct(fps, error) of a container's header."""
    magic, fps = F.substring(p, 1, 4), int_le(p, 9, 4)
    bad = (F.length(p) < HEADER) | ~(magic.isin(STREAM_MAGIC, SEGMENT_MAGIC)) | (int_le(p, 5, 4) != VERSION) | (fps < 1) | (fps > 1000)
    return F.struct(fps.alias("fps"), F.coalesce(bad, F.lit(True)).alias("error"))


def segment(packets: DataFrame, keys: list[str], target: int) -> DataFrame:
    """Packets with their segment; see ``operators.order.segments``."""
    return packets.join(segments(packets, keys, "pkt_idx", "key", target), [*keys, "pkt_idx"])


def playlist(cut: DataFrame, keys: list[str], fps: int) -> DataFrame:
    """(keys, text): a playlist of segments. The target duration is that of the first segment, rounded up."""
    n = cut.groupBy(*keys, "segment").agg(F.count("*").alias("n"))
    line = F.concat(F.lit("#EXTINF:"), F.format_string("%.6f", F.col("n") / F.lit(float(fps))), F.lit(",\nseg_"), F.lpad(F.col("segment").cast("string"), 4, "0"), F.lit(".m4s\n"))
    listed = n.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("segment", "n", line.alias("t")))).alias("l"))
    first = div(F.get("l", F.lit(0))["n"] + fps - 1, fps)
    head = F.concat(F.lit("#EXTM3U\n#EXT-X-VERSION:7\n#EXT-X-TARGETDURATION:"), first.cast("string"), F.lit("\n#EXT-X-MEDIA-SEQUENCE:0\n"))
    return listed.select(*keys, F.concat(head, F.array_join(F.transform("l", lambda s: s["t"]), ""), F.lit("#EXT-X-ENDLIST\n")).alias("text"))


def sample_table(packets: DataFrame, keys: list[str], start: int) -> DataFrame:
    """(keys, pkt_idx, size, offset): sizes and places of samples laid end to end after ``start`` bytes."""
    return offsets(packets.select(*keys, "pkt_idx", "size"), keys, ["pkt_idx"], "size", start)


def sample_boxes(packets: DataFrame, keys: list[str], start: int) -> DataFrame:
    """(keys, stsz, stco): the size and chunk-offset boxes of each stream."""
    return _size_boxes(sample_table(packets, keys, start), keys)


def _size_boxes(table: DataFrame, keys: list[str]) -> DataFrame:
    t = table.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pkt_idx", "size", "offset"))).alias("l"))
    hexes = lambda f: F.array_join(F.transform("l", lambda s: F.lpad(F.hex(s[f].cast("bigint")), 8, "0")), "")
    count = F.size("l")
    stsz = F.concat(bytes_be(count * 4 + 20, 4), F.lit(b"stsz"), F.unhex(F.lit("00" * 8)), bytes_be(count, 4), F.unhex(hexes("size")))
    stco = F.concat(bytes_be(count * 4 + 16, 4), F.lit(b"stco"), F.unhex(F.lit("00" * 4)), bytes_be(count, 4), F.unhex(hexes("offset")))
    return t.select(*keys, stsz.alias("stsz"), stco.alias("stco"))


def _box(kind: str, *parts: Column) -> Column:
    body = F.concat(*parts) if parts else F.unhex(F.lit(""))
    return F.concat(bytes_be(F.length(body) + 8, 4), F.lit(kind.encode()), body)


def mp4(packets: DataFrame, keys: list[str], width: int, height: int, fps: int = 30) -> DataFrame:
    """(keys, data): each stream as an MP4 file of one track with the private sample entry ``tcv1``, a sample a
    packet and a chunk a sample. A stream is one value of at most 2 GB."""
    zeros = lambda n: F.unhex(F.lit("00" * n))
    raw = lambda h: F.unhex(F.lit(h.replace(" ", "")))
    unity = "00010000 00000000 00000000 00000000 00010000 00000000 00000000 00000000 40000000"
    p = packets.select(*keys, "pkt_idx", "payload", F.length("payload").alias("size"))
    listed = p.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pkt_idx", F.col("payload").alias("d")))).alias("l"), F.count("*").alias("n"))
    time = bytes_be(F.col("n"), 4)
    entry = _box("tcv1", zeros(6), raw("0001"), zeros(16), bytes_be(F.lit(width), 2), bytes_be(F.lit(height), 2), raw("00480000 00480000 00000000 0001"), zeros(32), raw("0018 FFFF"))
    stts = F.concat(zeros(4), raw("00000001"), time, raw("00000001"))
    table = _box("stbl", _box("stsd", zeros(4), raw("00000001"), entry), _box("stts", stts), _box("stsc", zeros(4), raw("00000001 00000001 00000001 00000001")), F.col("stsz"), F.col("stco"))
    media = _box("minf", _box("vmhd", raw("00000001"), zeros(8)), _box("dinf", _box("dref", zeros(4), raw("00000001"), _box("url ", raw("00000001")))), table)
    mdia = _box("mdia", _box("mdhd", zeros(12), bytes_be(F.lit(fps), 4), time, raw("55C4 0000")), _box("hdlr", zeros(8), F.lit(b"vide"), zeros(13)), media)
    track = _box("trak", _box("tkhd", raw("00000007"), zeros(8), raw("00000001"), zeros(4), time, zeros(16), raw(unity), bytes_be(F.lit(width << 16), 4), bytes_be(F.lit(height << 16), 4)), mdia)
    moov = _box("moov", _box("mvhd", zeros(12), bytes_be(F.lit(fps), 4), time, raw("00010000 0100 0000"), zeros(8), raw(unity), zeros(24), raw("00000002")), track)
    start = F.concat(_box("ftyp", F.lit(b"isom"), raw("00000200"), F.lit(b"isomtcv1")), moov)
    # The places of the samples follow from the length of what comes before them, which they do not change.
    empty = sample_boxes(p, keys, 0)
    before = listed.join(empty, keys).select(*keys, "l", "n", (F.length(start) + 8).alias("before"))
    placed = p.join(before.select(*keys, "before"), keys)
    w = Window.partitionBy(*keys).orderBy("pkt_idx").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.select(*keys, "pkt_idx", "size", (F.coalesce(F.sum("size").over(w), F.lit(0)) + F.col("before")).alias("offset"))
    return before.join(_size_boxes(placed, keys), keys).select(*keys, F.concat(start, _box("mdat", _joined("l"))).alias("data"))


def mp4_packets(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pkt_idx, payload, error) of MP4 files (keys, data): samples by their stsz and stco boxes. A file
    whose boxes are missing, disagree or leave the file is one row with its error."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.select(*keys).schema.fields)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            at, rows = [], []
            for i, data in enumerate(b.column(len(keys)).to_pylist()):
                try:
                    own = [(k, data[o : o + n], "") for k, (o, n) in enumerate(samples(data or b""))]
                except (ValueError, struct.error) as e:
                    own = [(0, None, str(e))]
                at += [i] * len(own)
                rows += own
            columns = zip(list(zip(*rows)) or [[]] * 3, (pa.int64(), pa.binary(), pa.string()))
            own_keys = [b.column(k).take(pa.array(at, pa.int64())) for k in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*own_keys, *(pa.array(c, kind) for c, kind in columns)], [*keys, "pkt_idx", "payload", "error"])

    return files.select(*keys, "data").mapInArrow(run, f"{kinds}, pkt_idx bigint, payload binary, error string")


def samples(data: bytes) -> list[tuple[int, int]]:
    """(offset, size) of the samples of an MP4 file."""
    found = {path: (a, b) for path, a, b in boxes(data)}
    try:
        (sa, sb), (ca, cb) = (found[f"moov/trak/mdia/minf/stbl/{k}"] for k in ("stsz", "stco"))
    except KeyError as e:
        raise ValueError(f"no {e.args[0]} box") from None
    fixed, n = struct.unpack(">II", data[sa + 4 : sa + 12])
    (chunks,) = struct.unpack(">I", data[ca + 4 : ca + 8])
    if n != chunks or ca + 8 + 4 * n > cb or (not fixed and sa + 12 + 4 * n > sb):
        raise ValueError("sample tables disagree")
    sizes = [fixed] * n if fixed else struct.unpack(f">{n}I", data[sa + 12 : sa + 12 + 4 * n])
    out = list(zip(struct.unpack(f">{n}I", data[ca + 8 : ca + 8 + 4 * n]), sizes))
    if any(not 0 < k <= LARGEST or o + k > len(data) for o, k in out):
        raise ValueError("a sample leaves the file")
    return out


def boxes(data: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[str, int, int]]:
    """(path, first byte, end) of the boxes of a file, those inside moov, trak, mdia, minf and stbl included."""
    end, at = len(data) if end is None else end, start
    while at + 8 <= end:
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if n < 8 or at + n > end:
            raise ValueError(f"box at {at} leaves its parent")
        name = kind.decode("latin-1")
        yield name, at + 8, at + n
        if name in ("moov", "trak", "mdia", "minf", "stbl"):
            for inner, a, b in boxes(data, at + 8, at + n):
                yield f"{name}/{inner}", a, b
        at += n


def manifest(files: DataFrame, expected: DataFrame) -> DataFrame:
    """(file, expected, found): rows of the expected manifest (file, sha256) that the files (file, content) don't meet."""
    got = files.select("file", F.sha2("content", 256).alias("found"))
    return expected.select("file", F.col("sha256").alias("expected")).join(got, "file", "left").where("found IS NULL OR found <> expected")
