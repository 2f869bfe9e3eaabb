"""Sharding: a minimax contiguous partition of atomic groups.

Equal texts form a group; groups stand in the order of a 64-bit hash of their text and are cut into
contiguous shards so that the largest shard is as small as can be. The smallest feasible capacity
is found by binary search with a greedy check. The check needs the groups only near its cuts: the
driver holds sums over ranges of the hash, of a bounded number, and asks for finer ranges where the
cuts of capacities still in question may fall, until those are known to the group.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import keep

SHARDS = 8
BITS = 12  # a range is cut into 2**BITS finer ones
LANES = 1024  # parts of a shard that are numbered on their own
CHUNK = 10_000  # equal rows that one row stands for at most when they are made again

_Range = tuple[int, int, int, int]  # first key (unsigned), width in bits, sum of sizes, groups


class _Line:
    """Ranges in order, with the sums before them."""

    def __init__(self, ranges: list[_Range]):
        self.ranges = sorted(ranges)
        self.before = [0, *accumulate(r[2] for r in self.ranges)]

    @property
    def total(self) -> int:
        return self.before[-1]

    def furthest(self, start: int, capacity: int) -> tuple[int, int]:
        """Where a shard that begins at ``start`` can end: at least, and at most."""
        end = start + capacity
        if end >= self.total:
            return self.total, self.total
        k = bisect_right(self.before, end) - 1
        return self.before[k], self.before[k] if self.ranges[k][3] == 1 else end

    def ends(self, capacity: int, shards: int) -> list[tuple[int, int]]:
        low = high = 0
        out = []
        for _ in range(shards):
            low, high = self.furthest(low, capacity)[0], self.furthest(high, capacity)[1]
            out.append((low, high))
        return out

    def smallest(self, least: int, shards: int, side: int) -> int:
        """The smallest capacity that surely (side 0) or possibly (side 1) is enough."""
        low, high = least, max(least, self.total)
        while low < high:
            mid = (low + high) // 2
            if self.ends(mid, shards)[-1][side] >= self.total:
                high = mid
            else:
                low = mid + 1
        return low

    def unclear(self, least: int, shards: int) -> tuple[list[int], int]:
        """Ranges of more than one group that a cut may fall into, and the capacity once there are none."""
        maybe, sure = self.smallest(least, shards, 1), self.smallest(least, shards, 0)
        spans = [(a, b) for (a, _), (_, b) in zip(self.ends(maybe, shards), self.ends(sure, shards))]
        out = set()
        for a, b in spans[:-1]:
            k = max(0, bisect_right(self.before, a) - 1)
            while k < len(self.ranges) and self.before[k] <= b:
                if self.ranges[k][3] > 1 and self.before[k + 1] > a:
                    out.add(k)
                k += 1
        return sorted(out), sure


def _unsigned(x: int) -> int:
    return x + (1 << 63)


def _histogram(groups: DataFrame, line: _Line | None, which: list[int]) -> list[_Range]:
    """Sums over finer ranges of ``groups`` (key, size): of all keys, or of those in the named ranges.
    Keys are moved up by 2**63 so that their order is that of unsigned numbers."""
    bits = 64 if line is None else line.ranges[which[0]][1]
    fine = max(0, bits - BITS)
    part = groups
    if line is not None:
        inside = F.lit(False)
        for k in which:
            first = line.ranges[k][0] - (1 << 63)
            inside |= F.col("key").between(first, first + (1 << bits) - 1)
        part = groups.where(inside)
    cell = F.shiftright("key", fine)
    rows = part.groupBy(cell.alias("cell")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    return [((r["cell"] << fine) + (1 << 63), fine, r["size"], r["n"]) for r in rows]


def cuts(groups: DataFrame, shards: int = SHARDS) -> list[int]:
    """The signed keys at which shards 1, 2, ... begin; shards without groups begin past the last key."""
    biggest = groups.agg(F.max("size")).first()[0] or 0
    line = _Line(_histogram(groups, None, []))
    if not line.ranges:
        return []
    least = max(biggest, -(-line.total // shards))
    while True:
        which, capacity = line.unclear(least, shards)
        if not which:
            break
        widest = max(line.ranges[k][1] for k in which)
        if widest == 0:
            raise AssertionError("two groups with one key")
        now = [k for k in which if line.ranges[k][1] == widest]
        some = now[:64]
        fine = _histogram(groups, line, some)
        gone = set(some)
        line = _Line([r for k, r in enumerate(line.ranges) if k not in gone] + fine)
    starts = {b: r[0] - (1 << 63) for b, r in zip(line.before, line.ranges)}
    out = []
    for low, _ in line.ends(capacity, shards)[:-1]:
        if low >= line.total:
            break
        out.append(starts[low])
    return out


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of ``docs``, law ``bytes``.

    size is the UTF-8 length of the text plus 1; a null text has no bytes and is one group with the
    empty text. Rows of a group stay together, so a group above an even share makes its shard larger
    than the others. slot numbers the rows of a shard without gaps: lanes of rows by the hash of
    doc_id, and by (doc_id, checksum, size) inside a lane; repeated rows stand side by side. A null
    doc_id is one like any other; other columns are ignored; an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("key"))
    slim = keep(slim, "sizes")
    groups = keep(slim.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    number = F.lit(0)
    for k, first in enumerate(cuts(groups, shards)):
        number = F.when(F.col("key") >= first, k + 1).otherwise(number)
    lane = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(LANES)).cast("int")
    # Equal rows are one row with a count until they have their numbers.
    each = slim.groupBy("doc_id", "size", "text_crc32", "key").agg(F.count("*").alias("n"))
    placed = each.withColumn("shard", number.cast("int")).withColumn("lane", lane)
    counts = placed.groupBy("shard", "lane").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("shard").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("shard", "lane", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("base"))
    inner = Window.partitionBy("shard", "lane").orderBy("doc_id", "text_crc32", "size", "key").rowsBetween(Window.unboundedPreceding, -1)
    # shards * LANES rows of three numbers at most
    out = placed.withColumn("before", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(F.broadcast(base), ["shard", "lane"])
    out = out.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long"))))
    out = out.repartition("key", "doc_id", "first")  # so that many equal rows are made by many tasks
    last = F.least(F.col("first") + CHUNK, F.col("n")) - 1
    out = out.select("doc_id", "size", "text_crc32", "shard", "base", "before", F.explode(F.sequence("first", last)).alias("nth"))
    slot = (F.col("base") + F.col("before") + F.col("nth")).cast("long")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
