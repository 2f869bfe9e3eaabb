"""Coding order, display order, reference lists and offsets."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ints import Value, col, div

#: Display place of a group's coding places, relative to the group's anchor.
GROUP = (0, -2, -3, -1)
SLOTS = 4
REORDER = 5


def display_of(position: Value) -> Column:
    """The display number of a coding position in groups of four: 0, 4, 2, 1, 3, 8, 6, 5, 7, ..."""
    p = col(position).cast("bigint")
    off = F.get(F.array(*[F.lit(x) for x in GROUP]), ((p + 3) % 4).cast("int"))
    return F.when(p == 0, 0).otherwise(div(p + 3, 4) * 4 + off).cast("bigint")


def coding_of(display: Value) -> Column:
    """The coding position of a display number, the inverse of ``display_of``."""
    d = col(display).cast("bigint")
    group = div(d + 3, 4) * 4
    place = F.get(F.array(F.lit(1), F.lit(4), F.lit(2), F.lit(3)), (group - d).cast("int"))
    return F.when(d == 0, 0).otherwise(group - 4 + place).cast("bigint")


def coding_order(frames: DataFrame, clip: list[str], idx: str) -> DataFrame:
    """``frames`` with ``position`` in coding order; a last group that is not full is coded in display order."""
    w = Window.partitionBy(*clip)
    last = F.max(idx).over(w)
    full = div(last, 4) * 4
    return frames.withColumn("position", F.when(F.col(idx) <= full, coding_of(idx)).otherwise(F.col(idx)).cast("bigint"))


def display_order(packets: DataFrame, clip: list[str], coded: str, display: str, rap: str) -> DataFrame:
    """``packets`` with ``segment``, counted up at each random-access point in coding order, and ``shown``,
    the place in display order from 0 within the segment."""
    w = Window.partitionBy(*clip).orderBy(coded).rowsBetween(Window.unboundedPreceding, 0)
    s = packets.withColumn("segment", F.sum(F.col(rap).cast("int")).over(w).cast("bigint"))
    return s.withColumn("shown", (F.row_number().over(Window.partitionBy(*clip, "segment").orderBy(display, coded)) - 1).cast("bigint"))


def references(frames: DataFrame, clip: list[str], coded: str, key: str, slots: int = SLOTS) -> DataFrame:
    """``frames`` with ``ref1`` .. the newest ``slots`` frames coded before, none from before the last key frame."""
    w = Window.partitionBy(*clip).orderBy(coded)
    g = frames.withColumn("_group", F.sum(F.col(key).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy(*clip, "_group").orderBy(coded)
    return g.withColumns({f"ref{k}": F.lag(coded, k).over(own) for k in range(1, slots + 1)}).drop("_group")


def nearest_references(frames: DataFrame, clip: list[str], coded: str, display: str, slots: int = SLOTS) -> DataFrame:
    """``frames`` with ``before`` and ``after``: of the last ``slots`` coded frames, the nearest in display
    order on each side. An as-of lookup over a bounded window of rows."""
    w = Window.partitionBy(*clip).orderBy(coded).rowsBetween(-slots, -1)
    held = frames.withColumn("_held", F.collect_list(display).over(w))
    low = F.array_max(F.filter("_held", lambda p: p < F.col(display)))
    high = F.array_min(F.filter("_held", lambda p: p > F.col(display)))
    return held.withColumns({"before": low, "after": high}).drop("_held")


def offsets(rows: DataFrame, keys: list[str], order: list[str], size: str, start: Value = 0) -> DataFrame:
    """``rows`` with ``offset``: where each begins when they are laid end to end."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", (F.coalesce(F.sum(size).over(w), F.lit(0)) + col(start)).cast("bigint"))


def check_offsets(table: DataFrame, keys: list[str], order: str, offset: str, total: Column) -> DataFrame:
    """(keys, ok): offsets rise and stay within the total."""
    w = Window.partitionBy(*keys).orderBy(order)
    t = table.withColumn("_good", (F.col(offset) >= F.coalesce(F.lag(offset).over(w), F.lit(0))) & (F.col(offset) <= total))
    return t.groupBy(*keys).agg(F.every("_good").alias("ok"))


def segments(packets: DataFrame, stream: list[str], order: str, key: str, target: int) -> DataFrame:
    """(stream, order, segment) where a new segment begins at the first key packet once the present one has
    at least ``target`` packets; null segments for streams that do not begin with a key packet.

    Where to cut depends on the last cut, so each stream is walked in order; a task keeps three numbers.
    """
    slim = packets.select(*stream, order, F.col(key).cast("boolean").alias("_key"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.drop("_key").schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, segment, size = None, None, 0
        for b in batches:
            names, out = list(zip(*(b.column(k).to_pylist() for k in range(len(stream))))), []
            for name, is_key in zip(names, b.column(len(stream) + 1).to_pylist()):
                if name != now:
                    now, segment, size = name, 0 if is_key else None, 0
                elif is_key and segment is not None and size >= target:
                    segment, size = segment + 1, 0
                size += 1
                out.append(segment)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.int64())], [*stream, order, "segment"])

    dealt = slim.repartition(*stream).sortWithinPartitions(*stream, order)
    return dealt.mapInArrow(run, f"{kinds}, segment bigint")


def previous_grid(vectors: DataFrame, clip: list[str], frame: str, cell: list[str], value: str) -> DataFrame:
    """``vectors`` with ``before``: what the same cell had in the frame just before, null where it had none."""
    w = Window.partitionBy(*clip, *cell).orderBy(frame)
    return vectors.withColumn("before", F.when(F.lag(frame).over(w) == F.col(frame) - 1, F.lag(value).over(w)))


def median_vector(a: Column, b: Column, c: Column) -> Column:
    """The median of three, as older blocks predict each component of a vector."""
    return F.get(F.sort_array(F.array(a, b, c)), F.lit(1))


def least_vector(candidates: Column) -> Column:
    """Of structs (x, y), nulls left out, the one with the least |x| + |y|, the first of equals; (0, 0) if none."""
    ranked = F.transform(candidates, lambda v, i: F.when(v.isNotNull(), F.struct((F.abs(v["x"]) + F.abs(v["y"])).alias("m"), i.alias("i"), v["x"].alias("x"), v["y"].alias("y"))))
    best = F.array_min(F.filter(ranked, lambda v: v.isNotNull()))
    return F.struct(F.coalesce(best["x"], F.lit(0)).alias("x"), F.coalesce(best["y"], F.lit(0)).alias("y"))
