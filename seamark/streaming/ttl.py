"""Caches with a lifetime, as state of a stream: entries expire by event time and leave the state by timers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Seconds that an entry of each cache lives (fixed values).
LIFETIMES = {"discovery": 24 * 3600, "chunks": 7 * 24 * 3600, "paths": 300, "files": 180, "annotations": 300}


class Expiring(StatefulProcessor):
    """The entries of one key, one in each cache: when they were made.

    A use within the lifetime finds its entry; the first use after that makes
    it anew.  Uses of a batch are taken in order of time and number; one that
    comes late, but not too late for the stream, finds the entry that was made
    after it.  All caches of a key share a state, as each one costs several
    calls; it goes when the last entry expires.
    """

    def __init__(self, lifetimes: dict[str, int]):
        self.names, self.lifetimes = list(lifetimes), [seconds * 1_000_000 for seconds in lifetimes.values()]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.made = handle.getValueState("made", ", ".join(f"at_{i} long" for i in range(len(self.names))))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        parts = [(x["at"].to_numpy(np.int64), x["event_id"].to_numpy(np.int64)) for x in rows]
        at, number = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        order = np.lexsort((number, at))
        at, number = at[order], number[order]
        before = tuple(self.made.get()) if self.made.exists() else None
        known, found = list(before or [None] * len(self.names)), []
        for i, lifetime in enumerate(self.lifetimes):
            made, k = [], 0
            if known[i] is not None:
                k = int(np.searchsorted(at, known[i] + lifetime))
            while k < len(at):
                made.append(k)
                known[i] = int(at[k])
                k = int(np.searchsorted(at, known[i] + lifetime))
            if made:
                found.append(pd.DataFrame({"cache": self.names[i], "event_id": number[made]}))
        if found:
            if before is not None:
                self.handle.deleteTimer(self._over(before))
            self.made.update(tuple(known))
            self.handle.registerTimer(self._over(known))
            yield pd.concat(found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.made.exists() and self._over(self.made.get()) <= expiredTimerInfo.getExpiryTimeInMs():
            self.made.clear()
        yield pd.DataFrame({"cache": [], "event_id": []}).astype({"cache": str, "event_id": "int64"})

    def _over(self, made) -> int:
        """When the last entry expires."""
        return _milliseconds(max(at + lifetime for at, lifetime in zip(made, self.lifetimes) if at is not None))

    def close(self) -> None:
        pass


def _milliseconds(micros: int) -> int:
    return -(-micros // 1000)


def computed(events: DataFrame, key: list[str], lifetimes: dict[str, int] = LIFETIMES, late: str = "10 minutes") -> DataFrame:
    """cache, event_id of each use (event_id, ts, ``key``) that finds no living entry of its key and makes one, for every cache of ``lifetimes`` (seconds).

    A stream; its query needs RocksDB state (``jobs.rocksdb``).  Uses that come
    later than ``late`` are dropped; a null in the key is a value of its own.
    """
    uses = events.withWatermark("ts", late).select("ts", "event_id", F.unix_micros("ts").alias("at"), *key)
    return uses.groupBy(*key).transformWithStateInPandas(Expiring(lifetimes), "cache string, event_id long", "Append", "EventTime")
