"""Stateful streams: which runs are alive by the age of their last line, and every n-th row of a key.

State lives in Spark's state store and is versioned with the batches, so a query that starts again from its checkpoint
goes on where its last whole batch ended. The session needs the RocksDB state store (rocks()).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

#: Seconds after a run's last line from which it no longer counts as running (a fixed value).
STALE = 200


def rocks(spark: SparkSession) -> None:
    """Chooses the state store that these operators need, for queries that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _time(ms: int) -> pd.Timestamp:
    return pd.Timestamp(ms, unit="ms")


class _Liveness(StatefulProcessor):
    """A run's last line and whether it counts as running; a timer stands at the time from which it no longer does."""

    def __init__(self, stale: int, forget: int) -> None:
        self.stale, self.forget = stale * 1000, forget * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "ms long, alive boolean")

    def _watch(self, at: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = sorted({int(t.value // 1_000_000) for part in rows for t in part["ts"]})
        last, alive = self.last.get() if self.last.exists() else (None, False)
        out = []
        for ms in times:
            if last is not None and ms <= last:
                continue
            if alive and ms - last >= self.stale:
                out.append((last + self.stale, "interrupted"))
                alive = False
            if not alive:
                out.append((ms, "running"))
            last, alive = ms, True
        if last is not None and times and last == times[-1]:
            self.last.update((last, alive))
            self._watch(last + self.stale)
        yield pd.DataFrame({"run": [key[0]] * len(out), "at": [_time(ms) for ms, _ in out], "state": [s for _, s in out]}).astype({"run": object, "at": "datetime64[ns]", "state": object})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ms, alive = self.last.get()
        if alive:
            self.last.update((ms, False))
            self.handle.registerTimer(ms + self.stale + self.forget)
            yield pd.DataFrame({"run": [key[0]], "at": [_time(ms + self.stale)], "state": ["interrupted"]})
        else:
            self.last.clear()


def liveness(lines: DataFrame, stale: int = STALE, delay: str = "0 seconds", forget: int = 86_400) -> DataFrame:
    """run, at, state: every change of a run between running and interrupted; lines: a stream of run (string) and ts.

    A run is running from a line on that comes stale seconds or more after the one before, or is its first, and interrupted stale seconds
    after a line that no other has followed by then. The watermark, delay behind the latest line of all runs, is the clock: timers fire when it passes
    them. Lines that come later than the watermark are left out. What a run's state holds is dropped forget seconds after an interruption.
    """
    # Times are whole milliseconds, as timers are.
    timed = lines.select(F.col("run").cast("string").alias("run"), F.timestamp_millis(F.unix_millis("ts")).alias("ts")).filter("run is not null and ts is not null")
    return timed.withWatermark("ts", delay).groupBy("run").transformWithStateInPandas(_Liveness(stale, forget), "run string, at timestamp, state string", "Append", "EventTime")


def liveness_changes(lines: DataFrame, until: dt.datetime, stale: int = STALE) -> DataFrame:
    """The same changes of a table of lines, with a clock that stands at until."""
    timed = lines.select(F.col("run").cast("string").alias("run"), F.timestamp_millis(F.unix_millis("ts")).alias("ts")).filter("run is not null and ts is not null").distinct()
    own = Window.partitionBy("run").orderBy("ts")
    gap = F.expr(f"make_dt_interval(0, 0, 0, {stale})")
    near = timed.withColumns({"before": F.lag("ts").over(own), "next": F.lead("ts").over(own)})
    began = near.filter(F.col("before").isNull() | (F.col("ts") >= F.col("before") + gap)).select("run", F.col("ts").alias("at"), F.lit("running").alias("state"))
    ended = near.filter(F.coalesce(F.col("next"), F.lit(until)) >= F.col("ts") + gap).select("run", (F.col("ts") + gap).alias("at"), F.lit("interrupted").alias("state"))
    return began.unionByName(ended)


class _EveryNth(StatefulProcessor):
    """Counts a key's rows; those with a number that n divides go out."""

    def __init__(self, n: int, order: str, number: str) -> None:
        self.n, self.order, self.number = n, order, number

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = self.seen.get()[0] if self.seen.exists() else 0
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        numbers = range(seen + 1, seen + len(batch) + 1)
        self.seen.update((seen + len(batch),))
        batch.insert(len(batch.columns), self.number, list(numbers))
        yield batch[batch[self.number] % self.n == 0]


def every_nth(stream: DataFrame, key: str, order: str, n: int = 20, number: str = "step") -> DataFrame:
    """Each n-th row of a key, with its number from 1; rows come in the order of a column, within a batch and from batch to batch.

    The counter belongs to the key and is versioned with the batches: the same rows go out however the stream is cut into batches, and a
    batch that runs again counts again from where it began. A key's rows of one batch pass through one task.
    """
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields), f"`{number}` long"])
    return stream.groupBy(key).transformWithStateInPandas(_EveryNth(n, order, number), fields, "Append", "None")
