"""Coding and display order as streams with event time: frames may come in any order within the watermark's delay.

State is a list of the frames that wait and where the clip stands. A clip's timer runs from its newest frame; when the
watermark passes it, what waits goes out, so that a tail that is not a full group, or frames behind one that never
came, do not wait for ever. Frames below the watermark are dropped by Spark, frames that come after their place has gone
out by the operator.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.order import GROUP

OUT = "clip long, idx long, place long, flushed boolean"


class _Order(StatefulProcessor):
    """Frames (clip, idx, ts) go out by ``ready``; what waits longer than ``wait`` milliseconds, in display order."""

    def __init__(self, wait: int):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "idx long")
        self.stand = handle.getValueState("stand", "due long, place long, timer long")

    def ready(self, held: set[int], due: int) -> tuple[list[int], int]:
        """The frames that can go out next, and the number due after them."""
        raise NotImplementedError

    def _where(self) -> tuple[set[int], int, int, int]:
        held = {int(r[0]) for r in self.held.get()}
        return held, *(map(int, self.stand.get()) if self.stand.exists() else (0, 0, -1))

    def _keep(self, held: set[int], due: int, place: int, timer: int) -> None:
        self.held.clear()
        if held:
            self.held.put([(i,) for i in sorted(held)])
        self.stand.update((due, place, timer))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held, due, place, timer = self._where()
        newest, out = -1, []
        for b in rows:
            held.update(int(i) for i in b["idx"] if i >= due)
            newest = max(newest, int(b["ts"].max().timestamp() * 1000))
        while (found := self.ready(held, due))[0]:
            for i in found[0]:
                out.append((key[0], i, place, False))
                place += 1
            held, due = held - set(found[0]), found[1]
        if timer >= 0 and (not held or newest + self.wait > timer):
            self.handle.deleteTimer(timer)
            timer = -1
        if held and timer < 0:
            timer = newest + self.wait
            self.handle.registerTimer(timer)
        self._keep(held, due, place, timer)
        yield pd.DataFrame(out, columns=["clip", "idx", "place", "flushed"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        held, due, place, _ = self._where()
        out = [(key[0], i, place + k, True) for k, i in enumerate(sorted(held))]
        self._keep(set(), max([due, *(i + 1 for i in held)]), place + len(out), -1)
        yield pd.DataFrame(out, columns=["clip", "idx", "place", "flushed"])

    def close(self) -> None:
        pass


class CodingOrder(_Order):
    """Frame 0, then groups of four that are complete, the last one first."""

    def ready(self, held: set[int], due: int) -> tuple[list[int], int]:
        if due == 0:
            return ([0], 1) if 0 in held else ([], 0)
        group = [due + 3 + off for off in GROUP]
        return (group, due + 4) if held.issuperset(group) else ([], due)


class DisplayOrder(_Order):
    """Frames in the order of their numbers, each as soon as it is due."""

    def ready(self, held: set[int], due: int) -> tuple[list[int], int]:
        return ([due], due + 1) if due in held else ([], due)


def ordered(stream: DataFrame, processor: StatefulProcessor, delay: str) -> DataFrame:
    """``OUT`` of a stream of frames (clip, idx, ts): the place in the order, and whether a timer let the frame go."""
    return stream.withWatermark("ts", delay).groupBy("clip").transformWithStateInPandas(processor, OUT, "append", "EventTime")


def run(spark: SparkSession, stream: DataFrame, folder: str) -> DataFrame:
    """The stream's output once all there is has been read (availableNow), from files in ``folder``. State is in RocksDB,
    its checkpoint beside the files; the session's own provider is set back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
