"""Recurrences over ordered rows as parallel prefixes: a single long key is cut over all tasks.

Rows are sorted by key and order into ranges, which may cut a key anywhere, and checkpointed, so that every later pass
sees the same ranges. A pass gives a few numbers for each range, the driver carries them from range to range, and
the next pass starts each range with what comes in. Nothing is gathered by key.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.ratecontrol import QP_MAX, next_qp


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` in ``spark.checkpoint.dir``, partition by partition; in local mode, where that is unset, in a folder of our own."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        root = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not root and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(root or tempfile.mkdtemp(prefix="blockwave-"))
    return df.checkpoint(eager=True)


def ranged(rows: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """``rows`` with ``_key``, one column that stands for all keys, sorted by keys and order, in checkpointed ranges of
    number ``_range``."""
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit("")
    by = [*(F.col(k).asc() for k in keys), *(F.col(c).asc() for c in order)]
    return checkpointed(rows.withColumn("_key", key).repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_range", F.spark_partition_id()))


def summaries(sorted_rows: DataFrame, columns: list[str], summarise: Callable, schema: str) -> dict[int, dict[str, Any]]:
    """By range: ``first`` and ``last``, its outermost keys, and the fields of ``schema`` that ``summarise`` gives for
    an iterator of (range, starts, columns): starts is true where a key begins, but for the range's first row."""
    kind = StructType.fromDDL(f"range int, first string, last string, {schema}")
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge: list = []

        def parts() -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
            for number, starts, columns, keys in _cut(batches):
                edge[:] = [number, edge[1] if edge else keys[0].as_py(), keys[-1].as_py()]
                yield number, starts, columns

        found = summarise(parts())
        if edge:
            yield pa.RecordBatch.from_pylist([{**dict(zip(("range", "first", "last"), edge)), **found}], arrow)

    return {r["range"]: r.asDict() for r in sorted_rows.select("_range", "_key", *columns).mapInArrow(run, kind).collect()}


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, list[np.ndarray], pa.Array]]:
    """Batches of (_range, _key, columns ...) with where keys begin; the first row of a range counts as going on."""
    before = None
    for b in batches:
        if b.num_rows:
            keys = b.column(1)
            starts = np.ones(b.num_rows, bool)
            starts[1:] = pa.compute.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
            starts[0] = before is not None and keys[0].as_py() != before
            before = keys[-1].as_py()
            yield b.column(0)[0].as_py(), starts, [b.column(k).to_numpy(zero_copy_only=False) for k in range(2, b.num_columns)], keys


def entries(found: dict[int, dict[str, Any]], start: Any, after: Callable) -> dict[int, Any]:
    """What comes into each range: ``start`` where its first key begins with it, else what ``after`` gives for the
    range before and what came into that."""
    out, last, state = {}, None, start
    for k in sorted(found):
        out[k] = state if last is not None and found[k]["first"] == last else start
        state, last = after(found[k], out[k]), found[k]["last"]
    return out


def applied(sorted_rows: DataFrame, columns: list[str], came_in: dict[int, Any], walk: Callable, schema: str) -> DataFrame:
    """``sorted_rows`` without ``_key`` and ``_range`` and with the columns of ``schema``; ``walk`` is made for each range with what came
    in and gives, batch by batch, their arrays for (starts, columns)."""
    names = sorted_rows.columns
    sent = sorted_rows.sparkSession.sparkContext.broadcast(came_in)
    kinds = [pa.int32() if t == "int" else pa.int64() if t == "long" else pa.float64() for t in (c.split(" ")[1] for c in schema.split(", "))]
    kept = [n for n in names if n not in ("_key", "_range")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, before = None, None
        for b in batches:
            if not b.num_rows:
                continue
            own = pa.RecordBatch.from_arrays([b.column(c) for c in ("_range", "_key", *columns)], ["_range", "_key", *columns])
            number, starts, values, keys = next(_cut(iter([own])))
            if step is None:
                step = walk(sent.value[number])
            starts[0] = before is not None and keys[0].as_py() != before
            before = keys[-1].as_py()
            new = [pa.array(x, k, mask=m) for (x, m), k in zip(step(starts, values), kinds)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *new], [*kept, *(c.split(" ")[0] for c in schema.split(", "))])

    same = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sorted_rows.schema.fields if f.name in kept)
    return sorted_rows.mapInArrow(run, f"{same}, {schema}")


# ── places and as-of values ──


def numbered(rows: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """``rows`` with ``place``, counted from 0 within the key."""

    def count(batches: Iterator) -> dict:
        n, fresh = 0, False
        for _, starts, _ in batches:
            at = np.flatnonzero(starts)
            n, fresh = (len(starts) - int(at[-1]), True) if len(at) else (n + len(starts), fresh)
        return {"n": n, "fresh": fresh}

    def walk(n: int) -> Callable:
        def step(starts: np.ndarray, _: list) -> list:
            nonlocal n
            k = np.arange(len(starts))
            begin = np.maximum.accumulate(np.where(starts, k, -n))
            place = k - begin
            n = int(place[-1]) + 1
            return [(place, None)]

        return step

    r = ranged(rows, keys, order, parts)
    found = summaries(r, [], count, "n long, fresh boolean")
    return applied(r, [], entries(found, 0, lambda s, n: s["n"] if s["fresh"] else n + s["n"]), walk, "place long")


def carried(rows: DataFrame, keys: list[str], order: list[str], value: str, out: str, parts: int | None = None) -> DataFrame:
    """``rows`` with ``out``: the last ``value`` (long) that isn't null at or before the row within its key. With two tables
    united it is an as-of join that no hot key slows down."""

    def last(batches: Iterator) -> dict:
        found, fresh = None, False
        for _, starts, (v,) in batches:
            known = _filled(starts, v, np.nan if found is None else found)
            found, fresh = (None if np.isnan(known[-1]) else known[-1]), fresh or bool(starts.any())
        return {"value": None if found is None else int(found), "fresh": fresh}

    def walk(came: int | None) -> Callable:
        def step(starts: np.ndarray, columns: list) -> list:
            nonlocal came
            known = _filled(starts, columns[0], np.nan if came is None else came)
            came = None if np.isnan(known[-1]) else int(known[-1])
            none = np.isnan(known)
            return [(np.where(none, 0, known).astype(np.int64), none)]

        return step

    r = ranged(rows, keys, order, parts)
    found = summaries(r, [value], last, "value long, fresh boolean")
    came = entries(found, None, lambda s, v: s["value"] if s["value"] is not None or s["fresh"] else v)
    return applied(r, [value], came, walk, f"{out} long")


def _filled(starts: np.ndarray, v: np.ndarray, before: float) -> np.ndarray:
    """Doubles (whole numbers below 2^53) with each gap filled from before it, not across the start of a key."""
    v, k = v.astype(np.float64), np.arange(len(v))
    known = np.maximum.accumulate(np.where(np.isnan(v), -1, k))
    begin = np.maximum.accumulate(np.where(starts, k, -1))
    out = np.where(known >= 0, v[np.maximum(known, 0)], before)
    return np.where(known < begin, np.nan, out)


# ── rate control ──


def _halves(maps: tuple, compose: Callable) -> tuple:
    """All maps composed in order, in pairs, then pairs of pairs."""
    while (n := len(maps[0])) > 1:
        pairs = compose(tuple(m[0 : n - 1 : 2] for m in maps), tuple(m[1::2] for m in maps))
        maps = tuple(np.concatenate([p, m[n - 1 :]]) if n % 2 else p for p, m in zip(pairs, maps))
    return tuple(m[0] for m in maps)


def clamps(a: tuple, b: tuple) -> tuple:
    """Maps x -> min(high, max(low, x + move)), b after a: one of the same kind."""
    (low, high, move), (low2, high2, move2) = a, b
    fit = lambda x: np.minimum(high2, np.maximum(low2, x + move2))
    return fit(low), fit(high), move + move2


def tables(a: tuple, b: tuple) -> tuple:
    """Maps over a small number of states as tables, b after a."""
    return (np.take_along_axis(b[0], a[0].astype(np.int64), 1),)


def budget(frames: DataFrame, keys: list[str], order: list[str], bits: str, qp: int, bitrate: int, fps: float, parts: int | None = None) -> DataFrame:
    """``frames`` with ``place``, ``total`` (bits so far), ``qp`` that the frame gets and ``level`` of the budget after it.

    The level moves by clamped steps, which are closed under composition, and the QP by one of five maps over its
    64 values, as the level says; both compose associatively, so ranges are composed, carried and then walked. The
    level is kept in whole numbers (twice the bits), so a range starts with exactly what a walk from the
    beginning would bring; a walk in doubles differs by rounding. Null sizes count as none; without a bitrate the level stays.
    """
    size, target = max(int(bitrate), 0), int(bitrate / fps) if bitrate > 0 else 0
    maps = np.array([[next_qp(q, level) for q in range(QP_MAX + 1)] for level in (0.9, 0.7, 0.5, 0.3, 0.1)], np.uint8)
    sized = frames.withColumn("_bits", F.coalesce(F.col(bits).cast("long"), F.lit(0).cast("long")))
    r = ranged(sized, keys, order, parts)

    def moves(used: np.ndarray) -> np.ndarray:
        return 2 * (target - used) if size else np.zeros(len(used), np.int64)

    def ask(levels: np.ndarray) -> np.ndarray:
        """Which of the five maps a level (in halves of a bit) asks for: thresholds at 0.8, 0.6, 0.4 and 0.2."""
        x = 5 * levels
        return np.select([x > 8 * size, x > 6 * size, x < 2 * size, x < 4 * size], [0, 1, 4, 3], 2)

    def levels(starts: np.ndarray, used: np.ndarray, level: int) -> tuple[np.ndarray, int]:
        """The level before each frame, and after the last one."""
        out = []
        for begins, move in zip(starts.tolist(), moves(used).tolist()):
            if begins:
                level = size
            out.append(level)
            level = min(2 * size, max(0, level + move))
        return np.array(out, np.int64), level

    def compose(batches: Iterator) -> dict:
        """A range as one clamped step; where a key begins, the level before is the starting one."""
        all_ = None
        total = n = 0
        fresh = False
        for _, starts, (used,) in batches:
            move = moves(used)
            base = np.where(starts, np.clip(size + move, 0, 2 * size), 0)
            one = _halves((base, np.where(starts, base, 2 * size), move), clamps)
            all_ = clamps(all_, one) if all_ else one
            at = np.flatnonzero(starts)
            total, n = (int(used[at[-1] :].sum()), len(used) - int(at[-1])) if len(at) else (total + int(used.sum()), n + len(used))
            fresh = fresh or len(at) > 0
        low, high, move = all_ or (0, 0, 0)
        return {"low": int(low), "high": int(high), "move": int(move), "total": total, "n": n, "fresh": fresh}

    steps = summaries(r, ["_bits"], compose, "low long, high long, move long, total long, n long, fresh boolean")

    def after(s: dict, x: tuple) -> tuple:
        level, total, n = x
        return min(s["high"], max(s["low"], level + s["move"])), s["total"] + (0 if s["fresh"] else total), s["n"] + (0 if s["fresh"] else n)

    came = entries(steps, (size, 0, 0), after)
    sent = r.sparkSession.sparkContext.broadcast(came)

    def chain(batches: Iterator) -> dict:
        """A range as one map over QPs: where a key begins, a constant one."""
        level, all_ = None, None
        for number, starts, (used,) in batches:
            if level is None:
                level = sent.value[number][0]
            before, level = levels(starts, used, level)
            each = maps[ask(before)]
            each[starts] = each[starts][:, [qp]]
            one = _halves((each,), tables)
            all_ = (one[0][all_[0].astype(np.int64)],) if all_ else one
        return {"map": all_[0].tolist() if all_ else []}

    chains = summaries(r, ["_bits"], chain, "map array<int>")
    qps = entries(chains, qp, lambda s, q: s["map"][q])

    def walk(came_in: tuple) -> Callable:
        level, total, n, q = came_in
        to = maps.tolist()

        def step(starts: np.ndarray, columns: list) -> list:
            nonlocal level, total, n, q
            used = columns[0]
            before, level = levels(starts, used, level)
            got = []
            for begins, k in zip(starts.tolist(), ask(before).tolist()):
                q = to[k][qp if begins else q]
                got.append(q)
            k = np.arange(len(starts))
            begin = np.maximum.accumulate(np.where(starts, k, -1))
            sums = np.cumsum(used)
            totals = sums - np.where(begin >= 0, (sums - used)[np.maximum(begin, 0)], -total)
            place = np.where(begin >= 0, k - begin, k + n)
            total, n = int(totals[-1]), int(place[-1]) + 1
            ends = np.r_[before[1:], level]
            ends[:-1][starts[1:]] = np.clip(before + moves(used), 0, 2 * size)[:-1][starts[1:]]
            return [(place, None), (totals, None), (np.array(got), None), (ends / (2 * size) if size else np.full(len(ends), 0.5), None)]

        return step

    states = {k: (*came[k], qps[k]) for k in came}
    return applied(r, ["_bits"], states, walk, "place long, total long, qp int, level double").drop("_bits")


# ── segments by pointer doubling ──


def segments(packets: DataFrame, stream: list[str], order: list[str], key: Column, target: int) -> DataFrame:
    """``packets`` with ``place`` and ``segment``: a new segment begins at the first key packet once the present one has
    at least ``target`` packets; null in streams that don't begin with a key packet.

    Each key packet links to the first one ``target`` places on. Links are doubled, so that the k-th round's links
    skip 2^k segments and twice as many cuts are known after it: log n self-joins of links, whatever the stream's length.
    """
    at = numbered(packets.withColumn("_is_key", F.coalesce(key, F.lit(False))), stream, order)
    keys = at.where("_is_key").select(*stream, "place")
    # the first key packet from place + target on, by one sort of packets and targets, the last place first
    none = F.lit(None).cast("long")
    here = keys.select(*stream, (-F.col("place")).alias("_by"), F.lit(0).alias("_kind"), F.col("place").alias("_value"), none.alias("place"))
    wanted = keys.select(*stream, (-F.col("place") - target).alias("_by"), F.lit(1).alias("_kind"), none.alias("_value"), "place")
    linked = carried(here.union(wanted), stream, ["_by", "_kind"], "_value", "to").where("_kind = 1 AND to IS NOT NULL").select(*stream, "place", "to")
    cuts = keys.where("place = 0").withColumn("segment", F.lit(0).cast("long"))
    same = lambda a, b, on: [*(F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in stream), on]
    step = 1
    while True:
        linked = checkpointed(linked)
        new = cuts.alias("c").join(linked.alias("l"), same("c", "l", F.col("c.place") == F.col("l.place"))).select(*[F.col(f"c.{c}") for c in stream], F.col("l.to").alias("place"), (F.col("segment") + step).alias("segment"))
        new = checkpointed(new)
        if new.isEmpty():
            break
        cuts = checkpointed(cuts.union(new))
        linked = linked.alias("a").join(linked.alias("b"), same("a", "b", F.col("a.to") == F.col("b.place"))).select(*[F.col(f"a.{c}") for c in stream], F.col("a.place"), F.col("b.to"))
        step *= 2
    marks = cuts.select(*stream, "place", F.col("segment").alias("_cut"), F.lit(True).alias("_mark"))
    own = at.drop("_is_key").withColumns({"_cut": none, "_mark": F.lit(False)})
    both = own.unionByName(marks, allowMissingColumns=True).withColumn("_last", ~F.col("_mark"))
    out = carried(both, stream, ["place", "_last"], "_cut", "segment")
    return out.where("NOT _mark").drop("_cut", "_mark", "_last")
