"""Gap sessions over a stream: the batch rule of scenes by time, with a watermark.

Time is cut into slices, and events meet by slice (and key), so no key holds all events. A session that
doesn't come within the gap of an end of its slice is whole. The others, two a slice at most, are
merged with their neighbours: on a table by one ordered pass over these few rows, on a stream in a state
that holds what still waits for its neighbour.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

#: Seconds of a slice.
SLICE = 3600


def _micros(c: str) -> Column:
    return F.unix_micros(c)


def _partial(events: DataFrame, gap: int, slice_: int, late: str, ts: str, keys: list[str]) -> DataFrame:
    """keys, w, slice, start, last (microseconds), n of the sessions of each slice; edge: whether one may go on in a slice beside it."""
    x = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        x = x.withWatermark("_ts", late)
    w = F.session_window("_ts", f"{gap // 1_000_000} seconds {gap % 1_000_000 + 1} microseconds")
    x = x.withColumn("_slice", F.floor(_micros("_ts") / slice_).cast("long"))
    g = x.groupBy("_slice", *keys, w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min("_ts").alias("_first"), F.max("_ts").alias("_last"))
    # the first event, not the window's start: a condition on that would be put before events are merged
    g = g.select(*keys, "w", F.col("_slice").alias("slice"), _micros("_first").alias("start"), _micros("_last").alias("last"), "n")
    early, long_ = F.col("start") - F.col("slice") * slice_ <= gap, (F.col("slice") + 1) * slice_ - F.col("last") <= gap
    return g.withColumn("edge", early | long_)


def _merged_table(parts: DataFrame, gap: int, keys: list[str]) -> DataFrame:
    """Sessions at the edges of slices, merged in the order of their starts."""
    w = Window.partitionBy(*keys).orderBy("start")
    cut = F.coalesce((F.col("start") - F.lag("last").over(w) > gap).cast("long"), F.lit(1))
    x = parts.filter("edge").withColumn("_cut", cut).withColumn("_seg", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.groupBy(*keys, "_seg").agg(F.min("start").alias("start"), F.max("last").alias("last"), F.sum("n").alias("n"))
    return parts.filter("not edge").select(*keys, "start", "last", "n").union(x.select(*keys, "start", "last", "n"))


def chains(parts: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """(start, last, n) of parts joined where one starts no later than the gap after the one before."""
    out: list[tuple[int, int, int]] = []
    for start, last, n in sorted(parts):
        if out and start - out[-1][1] <= gap:
            out[-1] = (out[-1][0], max(last, out[-1][1]), out[-1][2] + n)
        else:
            out.append((start, last, n))
    return out


class _Neighbours(StatefulProcessor):
    """Whole sessions go through; those at edges wait, by key, until no part of a neighbouring slice can come.

    A part of the next slice that goes on from a session starts within the gap, so it has ended, and
    was told, when the watermark has passed the end of that slice and the gap.
    """

    def __init__(self, gap: int, slice_: int, keys: list[str]):
        self.gap, self.slice_, self.keys = gap, slice_, keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "starts array<long>, lasts array<long>, ns array<long>")

    def close(self) -> None:
        pass

    def _ready(self, session: tuple[int, int, int]) -> int:
        """The watermark (milliseconds) from which a session is whole."""
        end = (session[1] // self.slice_ + 1) * self.slice_
        return (end + self.slice_ + self.gap if end - session[1] <= self.gap else session[1] + self.gap) // 1000 + 1

    def _told(self, key: tuple, done: list[tuple[int, int, int]]) -> pd.DataFrame:
        of = {k: [v] * len(done) for k, v in zip(self.keys, key[1:-1], strict=True)}
        return pd.DataFrame({**of, "start": [s[0] for s in done], "last": [s[1] for s in done], "n": [s[2] for s in done]})

    def _settle(self, key: tuple, rows: list[tuple[int, int, int]], now: int) -> Iterator[pd.DataFrame]:
        have = self.waiting.get()
        every = chains([*(zip(*have, strict=True) if have else ()), *rows], self.gap)
        left = [s for s in every if self._ready(s) > now]
        if left:
            self.waiting.update(tuple(list(c) for c in zip(*left, strict=True)))
            self.handle.registerTimer(min(map(self._ready, left)))
        elif have:
            self.waiting.clear()
        yield self._told(key, [s for s in every if self._ready(s) <= now])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        parts = [r for f in rows for r in zip(f["start"].tolist(), f["last"].tolist(), f["n"].tolist(), strict=True)]
        if key[-1] == "whole":
            yield self._told(key, parts)
        else:
            yield from self._settle(key, parts, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._settle(key, [], timerValues.getCurrentWatermarkInMs())


def _merged_stream(parts: DataFrame, gap: int, slice_: int, keys: list[str]) -> DataFrame:
    """Sessions at the edges of slices, merged by a state; its store must be the one that such states need."""
    parts.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = T.StructType([*(parts.schema[k] for k in keys), *(T.StructField(c, T.LongType()) for c in ("start", "last", "n"))])
    # whole ones are dealt by slice; of those at edges a key has two a slice
    x = parts.withColumn("_of", F.when(F.col("edge"), F.lit(-1)).otherwise(F.col("slice"))).withColumn("_kind", F.when(F.col("edge"), "edge").otherwise("whole"))
    return x.groupBy("_of", *keys, "_kind").transformWithStateInPandas(_Neighbours(gap, slice_, keys), out, "append", "eventTime")


def stream_sessions(events: DataFrame, gap_seconds: int = 120, late: str = "1 hour", ts: str = "ts", keys: list[str] | None = None, slice_seconds: int = SLICE) -> DataFrame:
    """start, last, n of each session (per key, if keys are given); works on streams and tables.

    An event belongs to the session if it is no later than the gap after the event before. On a
    stream a session is told when the watermark has passed it, or, if it reaches the end of a
    slice, the slice after. Slices are wider than the gap.
    """
    gap, slice_ = gap_seconds * 1_000_000, max(slice_seconds, 2 * gap_seconds) * 1_000_000
    keys = list(keys or [])
    parts = _partial(events, gap, slice_, late, ts, keys)
    x = _merged_stream(parts, gap, slice_, keys) if events.isStreaming else _merged_table(parts, gap, keys)
    return x.select(*keys, F.timestamp_micros("start").alias("start"), F.timestamp_micros("last").alias("last"), "n")
