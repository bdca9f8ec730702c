"""The log timeline on streams: errors per minute, bursts as sessions, silences per source."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def errors_per_bucket(events: DataFrame, ts: str, error: Column, bucket: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(ts, late).filter(error).groupBy(F.window(ts, bucket)).agg(F.count("*").alias("errors")).select("window.start", "window.end", "errors")


def error_sessions(events: DataFrame, ts: str, error: Column, source: str, gap: str = "2 minutes", late: str = "10 minutes", least: int = 3) -> DataFrame:
    """Bursts per source: runs of errors with no more than a gap between them."""
    out = events.withWatermark(ts, late).filter(error).groupBy(F.session_window(ts, gap), F.col(source)).agg(F.count("*").alias("errors"))
    return out.select(F.col(source).alias("source"), "session_window.start", "session_window.end", "errors").filter(F.col("errors") >= least)


class Silences(StatefulProcessor):
    """Times wait until the watermark has passed them, so that events which come out of order are put in order; then each
    is held against the last one before it. A source that says nothing for `forget` is forgotten."""

    def __init__(self, min_seconds: float, forget: float):
        self.least, self.forget = round(min_seconds * 1e6), round(forget * 1e3)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "micros long")
        self.waiting = handle.getMapState("waiting", "micros long", "times int")

    def _wake(self, at: int) -> None:
        """One timer at a time: at the first time that waits, or when the source is to be forgotten."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for t in batch["ts"].dropna():
                micros = int(t.value // 1000)
                if not self.waiting.containsKey((micros,)):
                    self.waiting.updateValue((micros,), (1,))
        first = min((k[0] for k in self.waiting.keys()), default=None)
        if first is not None:
            self._wake(first // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        times = sorted(k[0] for k in self.waiting.keys())
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for t in (t for t in times if t <= passed):
            if last is not None and t - last >= self.least:
                out.append((key[0], pd.Timestamp(last, unit="us"), pd.Timestamp(t, unit="us"), (t - last) / 1e6))
            last = t if last is None else max(last, t)
            self.waiting.removeKey((t,))
        left = [t for t in times if t > passed]
        if left:
            self._wake(left[0] // 1000 + 1)
        elif last is not None and last // 1000 + self.forget <= timerValues.getCurrentWatermarkInMs():
            self.last.clear()
            last = None
        elif last is not None:
            self._wake(last // 1000 + self.forget)
        if last is not None:
            self.last.update((last,))
        yield pd.DataFrame(out, columns=["source", "start", "end", "seconds"])

    def close(self) -> None:
        pass


def silences(events: DataFrame, ts: str, source: str, min_seconds: float = 300, late: str = "10 minutes", forget: float = 30 * 86400) -> DataFrame:
    """Per source, steps of at least min_seconds between one event and the next, in the order of their times.

    Events may come out of order by `late`; a step is told once the watermark has passed its end, and later ones than that
    are left out. What is held per source are its last time and the times within `late`; after `forget` seconds without an
    event the source goes. Needs the state store that spark.sql.streaming.stateStore.providerClass names to be RocksDB's.
    """
    rows = events.select(F.col(source).cast("string").alias("source"), F.col(ts).cast("timestamp").alias("ts")).filter("ts IS NOT NULL").withWatermark("ts", late)
    return rows.groupBy("source").transformWithStateInPandas(Silences(min_seconds, forget), "source string, start timestamp, end timestamp, seconds double", "Append", "EventTime")


ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
