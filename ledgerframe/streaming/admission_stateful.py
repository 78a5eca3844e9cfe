"""Admission on a stream in event time (T1), with ``transformWithState``.

Hits wait in the key's state until the watermark has passed them and are then decided in
(time, id) order, so the order in which micro-batches bring them does not matter: decisions
are those of the batch twin. A timer per key wakes it at its earliest waiting hit; when none
waits, it wakes it when its newest admitted hit leaves the window, and the key's state goes.
A hit that comes after the watermark has passed it is too late to be decided in order: it is
returned as refused and ``late`` (where Spark has not dropped it before) and takes no place.

The query needs the RocksDB state store (:data:`STATE_STORE`), which holds state outside the
executors' heap.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerframe.streaming.admission import admit_sequence

STATE_STORE = {"spark.sql.streaming.stateStore.providerClass":
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
DECISIONS = "event_id long, key long, ts timestamp_ntz, admitted boolean, late boolean"


class Admission(StatefulProcessor):
    """``waiting``: hits beyond the watermark; ``held``: admitted times in the window (at most
    ``limit``); ``wake``: the time of the one timer."""

    def __init__(self, limit: int, window_us: int):
        self.limit, self.window_us = limit, window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, event_id long")
        self.held = handle.getListState("held", "us long")
        self.wake = handle.getValueState("wake", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        new, late = [], []
        for pdf in rows:
            for us, event in zip(pdf["us"].tolist(), pdf["event_id"].tolist()):
                (new if us > passed else late).append((us, event))
        if new:
            self.waiting.appendList(new)
            self._wake_at(min(us for us, _ in new) // 1000 + 1)
        yield self._decisions(key, late, np.zeros(len(late), bool), True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        self.wake.clear()
        waiting = sorted(tuple(r) for r in self.waiting.get())
        due = [w for w in waiting if w[0] <= passed]
        ok, held = admit_sequence(np.array([us for us, _ in due], np.int64), self.limit, self.window_us,
                                  deque(sorted(r[0] for r in self.held.get())))
        # A hit to come is after the watermark: older times can refuse none.
        held = [us for us in held if passed - us < self.window_us]
        rest = waiting[len(due):]
        for state, rows in ((self.waiting, rest), (self.held, [(us,) for us in held])):
            if rows:
                state.put(rows)
            else:
                state.clear()
        if rest:
            self._wake_at(rest[0][0] // 1000 + 1)
        elif held:
            self._wake_at((held[-1] + self.window_us) // 1000 + 1)
        yield self._decisions(key, due, ok, False)

    def _wake_at(self, ms: int) -> None:
        """One timer per key, at the earliest time asked for."""
        if self.wake.exists():
            now = self.wake.get()[0]
            if now <= ms:
                return
            self.handle.deleteTimer(now)
        self.handle.registerTimer(ms)
        self.wake.update((ms,))

    def _decisions(self, key, hits: list[tuple[int, int]], ok: np.ndarray, late: bool) -> pd.DataFrame:
        return pd.DataFrame({"event_id": np.array([e for _, e in hits], np.int64),
                             "key": np.full(len(hits), key[0], np.int64),
                             "ts": np.array([us for us, _ in hits], "datetime64[us]"),
                             "admitted": ok, "late": np.full(len(hits), late)})

    def close(self) -> None:
        pass


def admission_in_event_time(events: DataFrame, key: str = "user_id", ts: str = "ts", order: str = "event_id",
                            limit: int = 3, window_seconds: int = 60, delay: str = "1 hour") -> DataFrame:
    """``(event_id, key, ts, admitted, late)`` of every hit of a stream that comes at most ``delay``
    after a later one; a hit's row appears when the watermark passes it. Hits without a
    time or key are left out of the state and of the result."""
    timed = events.select(F.col(order).alias("event_id"), F.col(key).alias("key"),
                          F.col(ts).cast("timestamp").alias("event_time")).where("event_time is not null and key is not null")
    hits = timed.withWatermark("event_time", delay).withColumn("us", F.unix_micros("event_time"))
    return hits.groupBy("key").transformWithStateInPandas(
        Admission(limit, window_seconds * 1_000_000), DECISIONS, "append", "EventTime")
