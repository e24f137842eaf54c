"""Stateful rules over streams of scans and requests, with Spark's state variables and timers."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

HOUR = 3_600_000
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_variables(spark: SparkSession) -> Iterator[None]:
    """Streams that are started within keep their state where state variables are supported."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class _Absence(StatefulProcessor):
    """last: when the item was last seen; gone: whether its absence was told."""

    def __init__(self, hold: int, forget: int):
        self.hold, self.forget = hold, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "last long, gone boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, gone = self.seen.get() if self.seen.exists() else (None, False)
        before, was_gone, told = last, gone, []
        for at in sorted(int(t) for part in rows for t in part["at_ms"]):
            if last is not None and at <= last:
                continue  # an older sighting that came late
            if gone or (last is not None and at - last > self.hold):
                told += [] if gone else [("absent", last + self.hold)]
                told.append(("back", at))
            last, gone = at, False
        if (last, gone) != (before, was_gone):
            if before is not None:
                self.handle.deleteTimer(before + (self.forget if was_gone else self.hold) + 1)
            self.handle.registerTimer(last + self.hold + 1)
            self.seen.update((last, gone))
        yield _told(key, told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        told = []
        if self.seen.exists():
            last, gone = self.seen.get()
            if gone and expiredTimerInfo.getExpiryTimeInMs() > last + self.forget:
                self.seen.clear()
            elif not gone and expiredTimerInfo.getExpiryTimeInMs() > last + self.hold:
                told = [("absent", last + self.hold)]
                self.seen.update((last, True))
                self.handle.registerTimer(last + self.forget + 1)
        yield _told(key, told)

    def close(self) -> None:
        pass


def _told(key: tuple, told: list[tuple[str, int]]) -> pd.DataFrame:
    columns = {"item": [key[0]] * len(told), "change": [t[0] for t in told]}
    return pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in columns.items()} | {"at_ms": pd.Series([t[1] for t in told], dtype="int64")})


def absences(scans: DataFrame, key: str, time_col: str, scan_hours: float = 12, grace_hours: float = 24, delay: str = "1 hour", forget_days: int = 90) -> DataFrame:
    """item, change, at_ms of a stream of sightings (key, time_col) by scans every `scan_hours`: an item is
    'absent' when two scans in a row lacked it and it wasn't seen for the grace, and
    'back' when it is seen again. Sightings may come `delay` late; older ones count for nothing.
    Of an item that stays away the state goes after `forget_days`. Start it within state_variables()."""
    hold = int(max(grace_hours, 2 * scan_hours) * HOUR)
    kind = scans.schema[key].dataType.simpleString()
    at = scans.filter(F.col(key).isNotNull() & F.col(time_col).isNotNull()).select(F.col(key).alias("item"), F.col(time_col).cast("timestamp").alias("at"), F.unix_millis(F.col(time_col).cast("timestamp")).alias("at_ms"))
    processor = _Absence(hold, max(hold + 1, forget_days * 24 * HOUR))
    return at.withWatermark("at", delay).groupBy("item").transformWithStateInPandas(processor, f"item {kind}, change string, at_ms long", "Append", "EventTime")


class _Limit(StatefulProcessor):
    """recent: times of the allowed events of the last `seconds`, at most `limit` of them."""

    def __init__(self, limit: int, seconds: float):
        self.limit, self.span = limit, int(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getValueState("recent", "times array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        recent = list(self.recent.get()[0]) if self.recent.exists() else []
        for part in rows:  # in the order of time within each part of a batch
            part, allowed = part.sort_values(["at_ms", "event_id"]), []
            for at in part["at_ms"].tolist():
                recent = [t for t in recent if t > at - self.span]
                allowed.append(len(recent) < self.limit)
                recent += [at] if allowed[-1] else []
            yield pd.DataFrame({"key": pd.Series([key[0]] * len(part), dtype=object), "event_id": part["event_id"].to_numpy(), "allowed": allowed})
        self.recent.update((recent,))

    def close(self) -> None:
        pass


def rate_limit(events: DataFrame, by: str, limit: int, seconds: float) -> DataFrame:
    """key, event_id, allowed of a stream (event_id long, at_ms long): an event is allowed if
    fewer than `limit` allowed ones of its key lie within the last `seconds`; rejected
    ones don't count. The state of a key is at most `limit` times. Start it within state_variables()."""
    kind = events.schema[by].dataType.simpleString()
    return events.select(F.col(by).alias("key"), "event_id", "at_ms").groupBy("key").transformWithStateInPandas(_Limit(limit, seconds), f"key {kind}, event_id long, allowed boolean", "Append", "None")


def run_until_now(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Append what the stream says about all that is there by now to the Parquet folder `out`."""
    with state_variables(stream.sparkSession):
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
