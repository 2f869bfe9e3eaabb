"""Streaming forms of the ordered operators: coding order, display order, the rate-control budget, segments.

Each is one small state for each clip, held in the state store; the batch operators of
``operators.order`` and ``functions.ratecontrol`` give the same results over whole tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.ratecontrol import next_qp
from ..operators.order import GROUP, REORDER


def _run(stream: DataFrame, key: str, f, out: str, state: str) -> DataFrame:
    return stream.groupBy(key).applyInPandasWithState(f, out, state, "append", GroupStateTimeout.NoTimeout)


def coding_order(stream: DataFrame) -> DataFrame:
    """(clip, idx, position) of frames (clip, idx, last) that arrive in display order: groups of four go out
    when they are full, what is left goes out in display order after the frame whose ``last`` is set."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, position = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        rows: list[tuple[Any, int, int]] = []
        frames = sorted((int(i), bool(e)) for b in batches for i, e in zip(b["idx"], b["last"]))
        for idx, last in frames:
            held.append(idx)
            if idx == 0:
                out, held = held, []
            elif idx % 4 == 0:
                out, held = [idx + off for off in GROUP], []
            elif last:
                out, held = held, []
            else:
                continue
            for i in out:
                rows.append((key[0], i, position))
                position += 1
        state.update((held, position))
        yield pd.DataFrame(rows, columns=["clip", "idx", "position"])

    return _run(stream, "clip", step, "clip long, idx long, position long", "held array<long>, position long")


def display_order(stream: DataFrame, slots: int = REORDER) -> DataFrame:
    """(clip, poc, shown) of frames (clip, position, poc, rap) that arrive in coding order: a frame goes out when
    it is the next to be shown; a random-access point drops what waits and starts anew. A frame that finds
    all slots taken is not held and never shown."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, due = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        rows: list[tuple[Any, int, int]] = []
        for _, poc, rap in sorted((int(p), int(c), bool(r)) for b in batches for p, c, r in zip(b["position"], b["poc"], b["rap"])):
            if rap:
                held, due = [], poc
            if poc == due or len(held) < slots:
                held.append(poc)
            while due in held:
                held.remove(due)
                rows.append((key[0], due, due))
                due += 1
        state.update((held, due))
        yield pd.DataFrame(rows, columns=["clip", "poc", "shown"])

    return _run(stream, "clip", step, "clip long, poc long, shown long", "held array<long>, due long")


def rate_control(stream: DataFrame, qp: int, bitrate: int, fps: float) -> DataFrame:
    """(clip, idx, qp, level) of frames (clip, idx, bits) in order: the QP each was given and the budget after it."""
    target = math.floor(bitrate / fps)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        q, level = state.get if state.exists else (qp, 0.5)
        rows = []
        for idx, bits in sorted((int(i), int(n)) for b in batches for i, n in zip(b["idx"], b["bits"])):
            q = next_qp(q, level)
            level = min(max(level + (target - bits) / bitrate, 0.0), 1.0)
            rows.append((key[0], idx, q, level))
        state.update((q, level))
        yield pd.DataFrame(rows, columns=["clip", "idx", "qp", "level"])

    return _run(stream, "clip", step, "clip long, idx long, qp int, level double", "qp int, level double")


def segments(stream: DataFrame, target: int) -> DataFrame:
    """(clip, idx, segment) of packets (clip, idx, key) in order, cut at the first key packet once a segment has
    ``target`` packets; -1 before a first key packet."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        segment, n = state.get if state.exists else (-1, 0)
        rows = []
        for idx, is_key in sorted((int(i), bool(k)) for b in batches for i, k in zip(b["idx"], b["key"])):
            if is_key and (segment < 0 or n >= target):
                segment, n = segment + 1, 0
            n += 1
            rows.append((key[0], idx, segment))
        state.update((segment, n))
        yield pd.DataFrame(rows, columns=["clip", "idx", "segment"])

    return _run(stream, "clip", step, "clip long, idx long, segment int", "segment int, n int")
