"""Packet streams, containers and raw frames as Spark data sources: ``spark.read.format("packets")``, ``df.write.format("packets")``.

A reader plans byte ranges, so one large file is many tasks: raw frames have a fixed size, packets an index of where
some of them begin, written by the sink or found by a pass over the lengths alone. Columns that aren't asked for are not
read, and filters on the file, the packet's number and its key flag are applied before a payload is.

A sink writes each task's run of a stream as a part of its own, under a temporary name; parts get their names when all
tasks are done, so a job that fails leaves nothing. Parts of a stream, laid end to end, are the stream's file.

Stores are those that pyarrow opens.
"""

from __future__ import annotations

import json
import struct
import time
import uuid
from collections import Counter
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, StringContains, StringEndsWith, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from ..operators.prefix import numbered
from .formats import HEADER, KEY, LARGEST, MAGIC, RECORD, RECORD_MAGIC, SEGMENT_MAGIC, STREAM_MAGIC, VERSION

SPLIT = 64 << 20
OPEN, TASKS = 256 << 10, 32  # bytes that opening a file counts for, and tasks that small files are dealt over at least
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
INDEX = "_cuts.json"
PACKETS = "stream_id string, pkt_idx bigint, pts bigint, size int, key boolean, payload binary, error string"
FRAMES = "stream_id string, frame_idx bigint, data binary"
SINK = "stream string, pkt_idx bigint, pts bigint, payload binary"
KINDS = ("stream", "container", "frames")


@dataclass
class Span(InputPartition):
    """Bytes of one file, and the stream, number and place that its first packet has; small files that are read in the same
    task follow."""

    path: str
    stream: str
    start: int
    end: int
    first: int
    more: tuple[Span, ...] = ()


@dataclass
class Part(WriterCommitMessage):
    """Files that a task has written: (temporary name, stream, number of its first packet, bytes, spans)."""

    files: list[tuple[str, str, int, int, list[tuple[int, int, int]]]]


def _head(data: bytes, kind: str) -> tuple[int, int, bool | None, int]:
    """(size, pts or -1, key flag if the record has one, bytes of the head) of what stands before a payload; size 0 if it is wrong."""
    if kind == "stream":
        n = struct.unpack("<I", data)[0] if len(data) == 4 else 0
        return (n if n <= LARGEST else 0), -1, None, 4
    if len(data) < RECORD or data[:4] != RECORD_MAGIC:
        return 0, -1, None, RECORD
    pts, n, key, zero = struct.unpack("<QIB3s", data[4:])
    good = 0 < n <= LARGEST and key <= 1 and zero == b"\0\0\0"
    return (n if good else 0), pts, bool(key), RECORD


def opening_error(head: bytes) -> str:
    """What is wrong with a container's first bytes."""
    if len(head) < HEADER or head[:4] not in (STREAM_MAGIC, SEGMENT_MAGIC):
        return "magic"
    version, fps = struct.unpack("<II", head[4:12])
    return "" if version == VERSION and 1 <= fps <= 1000 else "header"


def spans(f: pa.NativeFile, size: int, kind: str, split: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, number of the first packet) of ranges of about ``split`` bytes: one short read for each packet."""
    at = start = HEADER if kind == "container" else 0
    n = first = 0
    length = 4 if kind == "stream" else RECORD
    while at < size:
        f.seek(at)
        found, _, _, head = _head(f.read(length), kind)
        if not found or at + head + found > size:
            break  # the range that reads on says so
        at, n = at + head + found, n + 1
        if at - start >= split and at < size:
            yield start, at, first
            start, first = at, n
    yield start, size, first


def dealt(found: list[Span], split: int, tasks: int) -> list[Span]:
    """The spans, small whole files as one where they are up to ``split`` bytes together, opening included. A file of many
    spans stays cut."""
    files = Counter(s.path for s in found)
    small = [s for s in found if files[s.path] == 1]
    cost = lambda s: OPEN + max(0, s.end - s.start)
    most = min(split, max(OPEN, sum(map(cost, small)) // max(1, tasks)))
    out, held, size = [s for s in found if files[s.path] > 1], [], 0
    for s in [*small, None]:
        if held and (s is None or size + cost(s) > most):
            out.append(replace(held[0], more=tuple(held[1:])))
            held, size = [], 0
        if s:
            held.append(s)
            size += cost(s)
    return out


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.options, self.names = dict(options), schema.fieldNames()
        self.kind = self.options.get("kind", "stream")
        if self.kind not in KINDS:
            raise ValueError(f"kind is one of {KINDS}")
        self.split = int(self.options.get("split", SPLIT))
        self.low, self.high, self.key = 0, None, None
        self.files: list[tuple[str, str]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        place = "frame_idx" if self.kind == "frames" else "pkt_idx"
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name == place and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif name == place and isinstance(f, (LessThan, LessThanOrEqual)):
                top = f.value + isinstance(f, LessThanOrEqual)
                self.high = top if self.high is None else min(self.high, top)
            elif name == place and isinstance(f, EqualTo):
                self.low, self.high = max(self.low, f.value), f.value + 1 if self.high is None else min(self.high, f.value + 1)
            elif name == "key" and isinstance(f, EqualTo) and self.kind != "frames" and self.key in (None, f.value):
                self.key = f.value
            elif name == "stream_id" and isinstance(f, (EqualTo, StringEndsWith, StringContains)):
                self.files.append((type(f).__name__, f.value))
            else:
                yield f

    def _wanted(self, stream: str) -> bool:
        test = {"EqualTo": str.__eq__, "StringEndsWith": str.endswith, "StringContains": str.__contains__}
        return all(test[k](stream, v) for k, v in self.files)

    def partitions(self) -> list[Span]:
        uri = self.options["path"]
        store, top = fs.FileSystem.from_uri(uri)
        prefix = uri[: len(uri) - len(top.rstrip("/"))] if uri.rstrip("/").endswith(top.rstrip("/")) else ""
        if store.get_file_info(top).type == fs.FileType.File:
            found = [store.get_file_info(top)]
        else:
            found = sorted((i for i in store.get_file_info(fs.FileSelector(top)) if i.is_file and i.base_name[0] not in "._"), key=lambda i: i.path)
        known: dict[str, Any] = {}
        if store.get_file_info(f"{top}/{INDEX}").is_file:
            with store.open_input_stream(f"{top}/{INDEX}") as f:
                known = json.loads(f.read())

        def plan(info: fs.FileInfo) -> list[Span]:
            own = known.get(info.base_name)
            own = own if own and own["size"] == info.size else None
            stream = prefix + (info.path.rpartition("/")[0] + "/" + own["stream"] if own else info.path)
            if not self._wanted(stream):
                return []
            if self.kind == "frames":
                n = int(self.options["frame"])
                step = max(1, self.split // n)
                whole, first = info.size // n, own["first"] if own else 0
                return [Span(info.path, stream, k * n, min(whole, k + step) * n, first + k) for k in range(0, whole, step)]
            if own:
                cuts = [(a, b, own["first"] + k) for a, b, k in own["spans"]]
            elif info.size <= self.split:
                cuts = [(HEADER if self.kind == "container" else 0, info.size, 0)]
            else:
                with store.open_input_file(info.path) as f:
                    cuts = list(spans(f, info.size, self.kind, self.split))
            return [Span(info.path, stream, *c) for c in cuts]

        with ThreadPoolExecutor(16) as pool:
            out = [s for own in pool.map(plan, found) for s in own]
        ends = [*(s.first if s.stream == t.stream else None for t, s in zip(out, out[1:])), None]
        wanted = [s for s, end in zip(out, ends) if (self.high is None or s.first < self.high) and (end is None or end > self.low)]
        return dealt(wanted, self.split, int(self.options.get("tasks", TASKS)))

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.options["path"])
        rows, size = [], 0
        for own in (span, *span.more):
            with store.open_input_file(own.path) as f:
                for row, held in self._rows(f, own):
                    rows.append(row)
                    size += held
                    if len(rows) == BATCH_ROWS or size > BATCH_BYTES:
                        yield self._batch(rows)
                        rows, size = [], 0
        yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"stream_id": pa.string(), "pkt_idx": pa.int64(), "frame_idx": pa.int64(), "pts": pa.int64(), "size": pa.int32(), "key": pa.bool_(), "payload": pa.binary(), "data": pa.binary(), "error": pa.string()}
        columns = list(zip(*rows)) or [[]] * len(self.names)
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[n]) for n, c in zip(self.names, columns)], self.names)

    def _rows(self, f: pa.NativeFile, span: Span) -> Iterator[tuple[tuple, int]]:
        row = lambda **x: tuple(x.get(n) for n in self.names)
        inside = lambda k: k >= self.low and (self.high is None or k < self.high)
        if self.kind == "frames":
            n, data = int(self.options["frame"]), "data" in self.names
            for k, at in enumerate(range(span.start, span.end, n), span.first):
                if inside(k):
                    f.seek(at)
                    yield row(stream_id=span.stream, frame_idx=k, data=f.read(n) if data else None), n * data
            return
        at, k, end = span.start, span.first, f.size()
        wrong = lambda error, pts=0: (row(stream_id=span.stream, pkt_idx=k, pts=pts, size=0, key=False, payload=b"", error=error), 0)
        if self.kind == "container" and span.first == 0:
            f.seek(0)
            if error := opening_error(f.read(HEADER)):
                if inside(0) and self.key is not True:
                    yield wrong(error)
                return
        while at < span.end:
            f.seek(at)
            n, pts, flag, head = _head(f.read(4 if self.kind == "stream" else RECORD), self.kind)
            # of the payload, what its key flag needs, and the rest only if it is asked for
            start = f.read(min(n, 9)) if n and at + head + n <= end else b""
            key = len(start) > 8 and bool(start[8] & KEY)
            error = ("length" if not n else "" if start else "truncated") if self.kind == "stream" else "" if start[:3] == MAGIC and len(start) == 9 and key == flag else "record"
            if error:
                if inside(k) and self.key is not True:
                    yield wrong(error, k if self.kind == "stream" else max(pts, 0))
                return
            if inside(k) and self.key in (None, key):
                body = start + f.read(n - len(start)) if "payload" in self.names else None
                yield row(stream_id=span.stream, pkt_idx=k, pts=k if pts < 0 else pts, size=n, key=key, payload=body, error=""), n if body else 0
            at, k = at + head + n, k + 1


class _Writer(DataSourceArrowWriter):
    """Rows of ``SINK``, sorted by stream and number in each task, those of a stream in ranges of rising task numbers."""

    def __init__(self, options: dict[str, str]):
        self.options, self.kind = dict(options), options.get("kind", "stream")
        self.job = f"_temporary-{uuid.uuid4().hex}"
        self.split = int(self.options.get("split", SPLIT))
        store, top = self._place()
        store.create_dir(f"{top}/{self.job}")

    def _place(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.options["path"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        store, top = self._place()
        attempt = f"{top}/{self.job}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        store.create_dir(attempt, recursive=False)  # no more once the job is aborted
        out, now, files = None, None, []
        start = struct.pack("<4sIII", SEGMENT_MAGIC if self.options.get("segment") else STREAM_MAGIC, VERSION, int(self.options.get("fps", 30)), 0)

        def done() -> None:
            out.close()
            files.append((name, now, first, size, [*cuts, (begun, size, n)] if begun < size or not cuts else cuts))

        for b in iterator:
            for stream, k, pts, payload in zip(*(b.column(c).to_pylist() for c in ("stream", "pkt_idx", "pts", "payload"))):
                if stream != now:
                    if out:
                        done()
                    now, first, size, begun, n, cuts, seen = stream, k, 0, 0, 0, [], 0
                    name = f"{attempt}/{len(files):06d}"
                    out = store.open_output_stream(name)
                    if self.kind == "container" and k == 0:
                        out.write(start)
                        size = begun = HEADER
                data = payload or b""
                head = b""
                if self.kind == "stream":
                    head = struct.pack("<I", len(data))
                elif self.kind == "container":
                    head = struct.pack("<4sQIB3s", RECORD_MAGIC, k if pts is None else pts, len(data), len(data) > 8 and bool(data[8] & KEY), b"\0\0\0")
                out.write(head + data)
                size, seen = size + len(head) + len(data), seen + 1
                if size - begun >= self.split:
                    cuts.append((begun, size, n))
                    begun, n = size, seen
        if out:
            done()
        return Part(files)

    def commit(self, messages: list[Part | None]) -> None:
        store, top = self._place()
        # the index names the parts, so one that is not in it is no part yet
        index, moves = {}, []
        if store.get_file_info(f"{top}/{INDEX}").is_file:
            with store.open_input_stream(f"{top}/{INDEX}") as f:
                index = json.loads(f.read())
        for number, m in enumerate(messages):
            for name, stream, first, size, cuts in m.files if m else []:
                final = f"{stream}.{number:06d}"
                if final in index:
                    raise ValueError(f"{final} is there already")
                index[final] = {"stream": stream, "first": first, "size": size, "spans": cuts}
                moves.append((name, f"{top}/{final}"))
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda move: store.move(*move), moves))
        with store.open_output_stream(f"{top}/{self.job}/{INDEX}") as f:
            f.write(json.dumps(index).encode())
        store.move(f"{top}/{self.job}/{INDEX}", f"{top}/{INDEX}")
        store.delete_dir(f"{top}/{self.job}")

    def abort(self, messages: list[Part | None]) -> None:
        store, top = self._place()
        for wait in (0, 0.1, 1, 3):  # tasks that are being killed may still write
            time.sleep(wait)
            try:
                if store.get_file_info(f"{top}/{self.job}").type == fs.FileType.NotFound:
                    return
                store.delete_dir(f"{top}/{self.job}")
            except OSError:
                continue


class PacketFiles(DataSource):
    """Options: path; kind (stream, container or frames); columns, those wanted of a read; split, bytes of a task; tasks,
    those that small files are dealt over at least; frame, the bytes of a raw frame; fps and segment of a container to write."""

    @classmethod
    def name(cls) -> str:
        return "packets"

    def schema(self) -> str:
        whole = FRAMES if self.options.get("kind") == "frames" else PACKETS
        kinds = dict(c.split(" ") for c in whole.split(", "))
        wanted = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        return ", ".join(f"{c} {kinds[c]}" for c in wanted) if wanted else whole

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite or set(schema.fieldNames()) != {c.split(" ")[0] for c in SINK.split(", ")}:
            raise ValueError(f"packets are appended, as ({SINK})")
        return _Writer(self.options)


def read(spark: SparkSession, path: str, kind: str = "stream", columns: str = "", **options: Any) -> DataFrame:
    """Packets of the files of a folder, or of one file, a row each; a bad one is a row with its error and ends its stream.
    ``frames`` gives raw frames of ``frame`` bytes; a short last one is left out."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PacketFiles)
    return spark.read.format("packets").options(**{"kind": kind, "columns": columns, "tasks": spark.sparkContext.defaultParallelism, **options}).load(path)


def write(rows: DataFrame, stream: str, order: list[str], payload: str, path: str, kind: str = "stream", pts: str | Column | None = None, parts: int | None = None, **options: Any) -> None:
    """Write rows as streams, in order, cut over all tasks wherever ranges end. ``pts`` of a container is the place in the
    stream unless a column gives it, which may be made of ``place``."""
    rows.sparkSession.dataSource.register(PacketFiles)
    at = numbered(rows, [stream], order, parts)  # in sorted ranges, as the sink needs them
    time = F.col("place") if pts is None else F.col(pts) if isinstance(pts, str) else pts
    ready = at.select(F.col(stream).cast("string").alias("stream"), F.col("place").alias("pkt_idx"), time.cast("long").alias("pts"), F.col(payload).cast("binary").alias("payload"))
    ready.write.format("packets").options(kind=kind, **options).mode("append").save(path)
