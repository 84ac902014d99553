"""Keyed state that starts from compact rows and ends: a processor with list state, timers and initial state."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from almanac.streaming.jobs import bucketed, whole

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RecentEvents(StatefulProcessor):
    """Lets the first `most` different events of a user through. What it remembers of a user, the ids let through, goes when
    event time has passed the user's last row by `keep_ms`: then the user begins anew, and state holds active users alone.
    A key is a bucket of users, whose state is read and written once a batch, with one timer, of the first that is due."""

    def __init__(self, most: int, keep_ms: int):
        self.most, self.keep_ms = most, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("users", "users array<long>, until array<long>, kept array<array<long>>, timer long")

    def _read(self) -> tuple[dict, int | None]:
        """By user, until when (ms) which ids are remembered; the timer."""
        if (held := self.state.get()) is None:
            return {}, None
        users, until, kept, timer = held
        return {u: [t, dict.fromkeys(ids)] for u, t, ids in zip(users, until, kept, strict=True)}, timer

    def _write(self, users: dict, timer: int | None, due: bool = False) -> None:
        first = min((t for t, _ in users.values()), default=None)
        if first != timer or due:
            if timer is not None and not due:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)
        if users:
            self.state.update((list(users), [t for t, _ in users.values()], [list(ids) for _, ids in users.values()], first))
        else:
            self.state.clear()

    def _late(self, ms: pd.Series) -> list[int]:
        return (ms.astype("datetime64[ms]").astype("int64") + self.keep_ms).tolist()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        users, timer = self._read()
        users = {u: v for u, v in users.items() if v[0] > now}
        for part in rows:
            part, out = part.sort_values(["ts", "event_id"]), []
            for i, (user, event, until) in enumerate(zip(whole(part["user_id"]), whole(part["event_id"]), self._late(part["ts"]), strict=True)):
                held = users.setdefault(user, [until, {}])
                held[0] = max(held[0], until)
                if len(held[1]) < self.most and event not in held[1]:
                    held[1][event] = None
                    out.append(i)
            if out:
                yield part.iloc[out][["user_id", "event_id", "ts"]]
        self._write(users, timer)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        users, timer = self._read()
        self._write({u: v for u, v in users.items() if v[0] > now}, timer, due=True)
        yield from ()

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        users, timer = self._read()
        for user, kept, until in zip(whole(initialState["user_id"]), initialState["kept"], self._late(initialState["ts"]), strict=True):
            held = users.setdefault(user, [until, {}])
            held[0] = max(held[0], until)
            held[1].update((int(i), None) for i in kept)
        self._write(users, timer)

    def close(self) -> None:
        pass


def recent_capped(events: DataFrame, most: int, keep_ms: int, late: str = "1 day", initial: DataFrame | None = None) -> DataFrame:
    """The first `most` different events of each user since it was last silent for keep_ms. initial(user_id, kept, ts): ids that
    an earlier run let through, and the last row's time, with which a user begins."""
    state = bucketed(initial).groupBy("bucket") if initial is not None else None
    return bucketed(events.withWatermark("ts", late)).groupBy("bucket").transformWithStateInPandas(RecentEvents(most, keep_ms), "user_id long, event_id long, ts timestamp", "Append", "EventTime", initialState=state)


@contextmanager
def rocks(spark: SparkSession):
    """State in RocksDB, which such processors need."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
