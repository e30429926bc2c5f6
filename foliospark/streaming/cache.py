"""A cache with a time to live as a stream: state for each key, and timers of event time that let it go."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "key string, id long, at long, outcome string, value string"


class TimedCache(StatefulProcessor):
    """Puts and gets of one key in order of time. An entry lives for ttl_ms after its put; a get finds it or misses."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "value string, until long")

    def _forget(self) -> None:
        self.entry.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """The state is read before a batch's rows and written after them: each call of it goes to the JVM and back."""
        asked = pd.concat(list(rows)).sort_values(["at", "id"], kind="stable")
        held = self.entry.get() if self.entry.exists() else None
        found, last = [], None
        for at, value in zip(asked["at"].tolist(), asked["value"].tolist(), strict=True):
            if not pd.isna(value):
                held = last = (value, at + self.ttl_ms)
                found.append(("stored", value))
            elif held is not None and at < held[1]:
                found.append(("hit", held[0]))
            else:
                found.append(("miss", None))
        if last is not None:
            self._forget()
            self.entry.update(last)
            self.handle.registerTimer(last[1])
        outcomes, values = zip(*found, strict=True)
        yield pd.DataFrame({"key": key[0], "id": asked["id"].to_numpy(), "at": asked["at"].to_numpy(), "outcome": outcomes, "value": values})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.entry.exists():
            value, until = self.entry.get()
            if until <= expiredTimerInfo.getExpiryTimeInMs():
                self.entry.clear()
                yield pd.DataFrame([(key[0], None, until, "expired", value)], columns=["key", "id", "at", "outcome", "value"])

    def close(self) -> None:
        pass


def cached(requests: DataFrame, ttl_seconds: int = 300, late: str = "10 minutes") -> DataFrame:
    """key, id, at (milliseconds), outcome, value of requests (key string, id, ts, value): a value is stored, a null one asks for the key.

    outcome is stored, hit, miss, or expired when the watermark passes the end of an entry, whose state then goes. Within a batch requests go
    by ts and id. Entries are kept by key in the state store, so a restart from the checkpoint goes on with them.
    """
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = requests.withWatermark("ts", late).selectExpr("key", "id", "unix_millis(ts) AS at", "value", "ts")
    return rows.groupBy("key").transformWithStateInPandas(TimedCache(ttl_seconds * 1000), OUT, "Append", "EventTime")
