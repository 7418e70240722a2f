"""Running stacks of correlations, one state a pair.

Rows are (pair, ts, data): a correlation and its time. A pair's state holds the number of its correlations, their sum and the latest
time. Each micro-batch gives a row for each pair that it touched: n, the mean of all so far, and how like the batch's own mean is to the
stack before it, which is what monitoring looks at. The means do not depend on how rows fall into batches.

A correlation that is older than the watermark (the latest time of the batches before, less `late`) is left out. A pair without
news for `idle_s` seconds of event time is closed: one row more with closed = true, and its state goes, so that states do not pile
up; news after that begin a new stack.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "pair string, n long, latest timestamp, likeness double, closed boolean, stack array<double>"
STATE = "n long, latest double, total array<double>"
#: The state store that these states need: spark.sql.streaming.stateStore.providerClass.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def likeness(a: np.ndarray, b: np.ndarray) -> float | None:
    size = np.sqrt((a**2).sum() * (b**2).sum())
    return float((a * b).sum() / size) if size > 0 else None


class RunningStack(StatefulProcessor):
    def __init__(self, idle_s: float):
        self.idle_s = idle_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("stack", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n, latest, total = self.state.get() if self.state.exists() else (0, 0.0, [])
        added, fresh = None, 0
        for row in rows:  # a row at a time: a batch may hold very many of one pair
            x = np.array(row.data, float)
            added, fresh, latest = (x if added is None else added + x), fresh + 1, max(latest, row.seconds)
        before = np.array(total)
        alike = likeness(before / n, added / fresh) if n else None
        total, n = (before + added if n else added), n + fresh
        self.state.update((n, latest, total.tolist()))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(1000 * (latest + self.idle_s)))
        yield self._row(key, n, latest, total, alike, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        n, latest, total = self.state.get()
        self.state.clear()
        yield self._row(key, n, latest, np.array(total), None, True)

    @staticmethod
    def _row(key, n, latest, total, alike, closed) -> Row:
        return Row(pair=key[0], n=n, latest=dt.datetime.fromtimestamp(latest), likeness=alike, closed=closed, stack=(total / n).tolist())

    def close(self) -> None:
        pass


def running_stacks(ccs: DataFrame, late: str = "1 day", idle_s: float = 30 * 86400.0) -> DataFrame:
    """The stream of stacks of a stream of correlations (pair string, ts, data of equal lengths); rows with a null drop out."""
    timed = ccs.select("pair", F.col("ts").cast("timestamp").alias("ts"), F.col("data").cast("array<double>").alias("data")).where("data IS NOT NULL AND pair IS NOT NULL AND ts IS NOT NULL")
    timed = timed.withWatermark("ts", late).withColumn("seconds", F.col("ts").cast("double"))
    return timed.groupBy("pair").transformWithState(RunningStack(idle_s), OUT, "Update", "EventTime")
