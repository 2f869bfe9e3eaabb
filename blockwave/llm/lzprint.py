"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into dictionary phrases (LZ78: each is a known phrase and one more character); the
set of phrases is hashed, and the minimum of each of 128 ranges of the hash makes the fingerprint.
The share of equal minima estimates the Jaccard similarity of two phrase sets, which follows how
well one text compresses given the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

BINS = 128
_BIN_BITS = 7
_MULT = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULT, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


class Parse:
    """Phrases of a text so far, in order, and the open one."""

    def __init__(self, phrases: dict[str, None] | None = None, open_: str = ""):
        self.phrases, self.open = {} if phrases is None else phrases, open_

    def feed(self, text: str) -> Parse:
        phrases, now = self.phrases, self.open
        for c in text:
            now += c
            if now not in phrases:
                phrases[now] = None
                now = ""
        self.open = now
        return self

    def fork(self) -> Parse:
        return Parse(self.phrases.copy(), self.open)

    def signature(self) -> np.ndarray:
        """The minimum of each range of the hash as 16 bits, never 0; 0 where a range has no phrase."""
        out = np.zeros(BINS, np.uint16)
        if not self.phrases:
            return out
        h = np.sort(_hashes(self.phrases))
        at = np.searchsorted(h, np.arange(BINS, dtype=np.uint64) << np.uint64(64 - _BIN_BITS))
        first = h[np.minimum(at, len(h) - 1)]
        held = (at < len(h)) & ((first >> np.uint64(64 - _BIN_BITS)) == np.arange(BINS, dtype=np.uint64))
        value = first & np.uint64(0xFFFF)  # the high bits of a minimum shrink with the number of phrases
        return np.where(held, np.maximum(value, 1), 0).astype(np.uint16)


def _grow(n: int) -> None:
    """Powers of the multiplier and of its inverse, up to n."""
    if len(_powers[0]) <= n:
        n = max(n + 1, 2 * len(_powers[0]))
        for k, m in enumerate((_MULT, _INVERSE)):
            full = np.full(n, m, np.uint64)
            full[0] = 1
            _powers[k] = np.multiply.accumulate(full)


def _hashes(phrases: dict[str, None]) -> np.ndarray:
    """64-bit hashes of distinct phrases, by differences of one polynomial's prefix sums."""
    codes = np.frombuffer("".join(phrases).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    length = np.fromiter(map(len, phrases), np.int64, len(phrases))
    ends = np.cumsum(length)
    starts = ends - length
    _grow(len(codes))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * _powers[0][: len(codes)], dtype=np.uint64)])
    h = (sums[ends] - sums[starts]) * _powers[1][starts] + length.astype(np.uint64)
    for shift, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # SplitMix64's finish
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(m)
    return h ^ (h >> np.uint64(31))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of ranges with equal minima among those that either has; 1 for two empty texts."""
    either = (a > 0) | (b > 0)
    n = int(either.sum())
    return float((a[either] == b[either]).sum()) / n if n else 1.0


def text_hex(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


class _Pending:
    """A document that waits for the next one's text."""

    def __init__(self, doc_id: int | None, text: str):
        self.doc_id, self.n = doc_id, len(text)
        self.head = text[: self.n - self.n // 3]
        parse = Parse().feed(self.head)
        self.edited = parse.fork()
        self.signature = parse.feed(text[len(self.head) :]).signature()

    def finish(self, text: str, signature: np.ndarray) -> tuple:
        tail = text[: self.n // 3]
        edited = self.edited.feed(tail).signature()
        digest = hashlib.sha256(self.head.encode() + tail.encode()).hexdigest()
        return self.doc_id, self.n, digest, text_hex(self.signature), text_hex(edited), likeness(self.signature, edited), likeness(self.signature, signature)


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket and in order, the copy of the next bucket's first document last."""
    now, bucket, done = None, None, False
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    for b in batches:
        rows = []
        buckets, copies, ids = (b.column(k).to_pylist() for k in range(3))
        for i, (at, copy, doc_id) in enumerate(zip(buckets, copies, ids)):
            if at != bucket:
                now, bucket, done = None, at, False
            if done:
                continue
            text = b.column(3)[i].as_py() or ""
            new = _Pending(doc_id, text) if not copy else None
            if now is not None:
                rows.append(now.finish(text, new.signature if new else Parse().feed(text).signature()))
            now, done = new, copy
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 7, kinds)], [f.split(" ")[0] for f in _SCHEMA.split(", ")])


def _longs(values: list[int | None]) -> Column:
    """A literal array; as text, so that the plan stays small however many there are."""
    return F.transform(F.split(F.lit(",".join("" if v is None else str(v) for v in values)), ","), lambda v: v.try_cast("bigint"))


def _at_most(row: tuple[Column, Column], cuts: list[tuple[int, int]]) -> Column:
    """How many of the sorted cuts are at most the row's pair of numbers, by bisection."""
    if not cuts:
        return F.lit(0)
    first, second = (_longs(list(c)) for c in zip(*cuts))
    halves = F.array(*[F.lit(1 << b) for b in reversed(range(len(cuts).bit_length()))])

    def low(k: Column) -> Column:
        return (F.get(first, k) < row[0]) | (F.get(first, k) == row[0]) & (F.get(second, k) <= row[1])

    step = lambda n, half: F.when((n + half <= len(cuts)) & low(n + half - 1), n + half).otherwise(n)
    return F.aggregate(halves, F.lit(0), step)


def _cuts(d: DataFrame, n: int) -> list[tuple[int, int]]:
    """Sorted cuts of (key, tie) that make about ``n`` ranges of equal rows. Ids that fill more than a range
    are cut by their ties."""
    if n < 2:
        return []
    total, at = d.agg(F.count("*"), F.percentile_approx("key", [k / n for k in range(1, n)], max(10_000, 10 * n))).first()
    out = {(k, -(1 << 63)) for k in at or []}
    hot = d.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") * n > total).collect()  # n rows at most
    for r in hot:
        own = r["n"] * n // total
        ties = d.where(F.col("key") == r["key"]).agg(F.percentile_approx("tie", [k / (own + 1) for k in range(1, own + 1)], 10_000)).first()[0]
        out |= {(r["key"], t) for t in ties}
    return sorted(out)


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that stand before their like: (doc_id, text) as both documents; what follows stays."""
    for b in batches:
        made = [_Pending(i, t) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        rows = [p.finish(t, p.signature) for p, t in zip(made, b.column(1).to_pylist())]
        columns = [pa.array(c) for c in zip(*rows)] if rows else [pa.array([], k) for k in (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
        columns[0] = b.column(0)
        yield pa.RecordBatch.from_arrays([*columns, b.column(2)], [*(f.split(" ")[0] for f in _SCHEMA.split(", ")), "times"])


def _once(d: DataFrame, cuts: list[tuple[int, int]]) -> tuple[DataFrame, DataFrame | None]:
    """``d`` where rows of which there are more equal ones than fill a range stand once; and the results of their copies,
    which stand before their like, made by many tasks."""
    hot = {k for k, tie in cuts if tie != -(1 << 63)}  # ids that more than a range's rows have
    if not hot:
        return d, None
    n = len(cuts) + 1
    least = d.count() // n
    # a row for each hot tie, and there are fewer of them than ranges
    held = d.where(F.col("key").isin(hot)).groupBy("key", "tie").agg(F.count("*").alias("times")).where(F.col("times") > least).collect()
    same = F.broadcast(d.sparkSession.createDataFrame(held, "key long, tie long, times long"))
    alike = d.join(same, ["key", "tie"]).groupBy("doc_id", "key", "tie", "times").agg(F.first("text").alias("text"))
    once = d.join(same, ["key", "tie"], "left_anti").unionByName(alike.drop("times"))
    made = alike.select("doc_id", "text", (F.col("times") - 1).alias("times")).mapInArrow(_alike, f"{_SCHEMA}, times long")
    part = made.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).repartitionById(n, F.col("part"))
    own = F.expr(f"(times + {n - 1} - part) div {n}")
    return once, part.withColumn("times", own).where("times > 0").withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("times", "part")


def fingerprints(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """A row for each row of ``docs``: its fingerprint, that of its edited text, and how near they and the
    next document's are.

    The next document is the one before in doc_id, after the first the last; rows with one doc_id stand in
    the order of a hash of their texts, equal rows side by side, and rows without doc_id come at the end. Of rows that
    are equal and fill a range one is read, with their number.
    A null text counts as empty. The table is cut into ranges of doc_id, and of the hash where an id has
    more rows than a range; a range also gets a copy of the first row of the next one, so no task needs
    more than its range. A table of one row is its own next document; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Equal rows share a tie, which follows from the text alone: however often rows are read, in whatever order, they get the same.
    text = F.coalesce("text", F.lit(""))
    d = d.select("doc_id", text.alias("text"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"), F.xxhash64(text).alias("tie"))
    cuts = _cuts(d.select("key", "tie"), buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = F.lit(len(cuts)) - _at_most((F.col("key"), F.col("tie")), cuts)  # bucket 0 has the largest ids
    heads = d.groupBy(own.alias("bucket")).agg(F.max(F.struct("key", "tie")).alias("head")).collect()  # a row for each bucket
    held = sorted(r["bucket"] for r in heads)
    keys, ties, before = [None] * (len(cuts) + 1), [None] * (len(cuts) + 1), [0] * (len(cuts) + 1)
    for r in heads:
        keys[r["bucket"]], ties[r["bucket"]] = r["head"]
        before[r["bucket"]] = held[held.index(r["bucket"]) - 1]
    once, copies = _once(d, cuts)
    at = once.select("doc_id", "text", "tie", own.cast("int").alias("own"), "key")
    row = F.struct(F.col("own").alias("bucket"), F.lit(False).alias("copy"))
    copy = F.struct(F.get(_longs(before), F.col("own")).cast("int").alias("bucket"), F.lit(True).alias("copy"))
    is_head = (F.get(_longs(keys), F.col("own")) == F.col("key")) & (F.get(_longs(ties), F.col("own")) == F.col("tie"))
    targets = F.when(is_head, F.array(row, copy)).otherwise(F.array(row))
    dealt = at.select(F.explode(targets).alias("t"), "doc_id", "text", "tie").select("t.bucket", "t.copy", "doc_id", "text", "tie")
    dealt = dealt.repartitionById(len(cuts) + 1, F.col("bucket"))
    dealt = dealt.sortWithinPartitions("bucket", "copy", F.desc_nulls_last("doc_id"), F.desc("tie")).drop("tie")
    out = dealt.mapInArrow(_walk, _SCHEMA)
    return out if copies is None else out.unionByName(copies)
