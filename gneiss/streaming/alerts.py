"""Alert rules on the end of each series while its values still arrive.

Events carry a key, a time and an amount; a value of a series is the sum of a calendar
month.  State of a key is bounded: the sums of its open months, and of its closed
ones their count, mean, sum of squares and last six values.  A month closes by a
timer when the watermark has passed its end; then it moves into the closed part, and
events of it that come later are left out, as the watermark leaves them out anyhow.
A key without events for ``idle`` is forgotten.

After each batch a key that had events, or a month that closed, tells its alerts as
``causes.alert_rules`` does for all values so far.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

_STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_MEASURES = "change double, last_z double, recent double, low double, high double, `drop` boolean, spike boolean, outlier boolean, shift boolean"
_KEPT = 6


def rules(n: int, mean: float, m2: float, last: list[float]) -> tuple:
    """(change, last_z, recent, low, high, drop, spike, outlier, shift) of a series by its moments and last values."""
    sd = float(np.sqrt(max(m2, 0.0) / n))
    newest, before = last[-3:], last[-6:-3]

    def step(a, b):
        return None if a is None or b is None or b == 0 else (a - b) / abs(b)

    change = step(last[-1], last[-2] if len(last) > 1 else None)
    recent = step(float(np.mean(newest)), float(np.mean(before)) if before else None)
    z = abs(last[-1] - mean) / sd if sd > 0 else 0.0
    # fixed values: the limits of the four rules
    flags = (change is not None and change < -0.15, change is not None and change > 0.25, z > 2.5, recent is not None and abs(recent) > 0.2)
    return (change, z, recent, mean - 2 * sd, mean + 2 * sd, *flags)


def _month_end(month: int) -> int:
    """The first millisecond after a month, which is a number of months since the year 0."""
    return int(datetime((month + 1) // 12, (month + 1) % 12 + 1, 1, tzinfo=UTC).timestamp() * 1000)


class MonthlyAlerts(StatefulProcessor):
    def __init__(self, key: str, idle_ms: int):
        self.key, self.idle_ms = key, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "month int", "total double")
        self.closed = handle.getValueState("closed", "n long, mean double, m2 double, last array<double>, through int, seen long")

    def _closed(self) -> tuple:
        return self.closed.get() if self.closed.exists() else (0, 0.0, 0.0, [], -1, 0)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        n, mean, m2, last, through, seen = self._closed()
        for pdf in rows:
            sums = pdf.groupby("month")["amount"].sum(min_count=1).dropna()
            for month, total in sums.items():
                if int(month) > through:
                    before = self.open.getValue((int(month),))[0] if self.open.containsKey((int(month),)) else 0.0
                    self.open.updateValue((int(month),), (before + float(total),))
                    self.handle.registerTimer(_month_end(int(month)))
                    seen = max(seen, _month_end(int(month)))
        self.closed.update((n, mean, m2, list(last), through, seen))
        if seen:
            self.handle.registerTimer(seen + self.idle_ms)
        yield from self._tell(key)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, mean, m2, last, through, seen = self._closed()
        now = expiredTimerInfo.getExpiryTimeInMs()
        if seen and now >= seen + self.idle_ms:
            self.open.clear()
            self.closed.clear()
            return
        done = sorted(m for (m,) in self.open.keys() if _month_end(m) <= now)
        last = list(last)
        for month in done:
            value = self.open.getValue((month,))[0]
            n += 1
            d = value - mean
            mean += d / n
            m2 += d * (value - mean)
            last = [*last, value][-_KEPT:]
            through = max(through, month)
            self.open.removeKey((month,))
        self.closed.update((n, mean, m2, last, through, seen))
        if done:
            yield from self._tell(key)

    def _tell(self, key: tuple) -> Iterator[pd.DataFrame]:
        """The rules over the closed months followed by the open ones."""
        n, mean, m2, last, _, _ = self._closed()
        last = list(last)
        for _, value in sorted((m, v) for (m,), (v,) in self.open.iterator()):
            n += 1
            d = value - mean
            mean += d / n
            m2 += d * (value - mean)
            last = [*last, value][-_KEPT:]
        if last:
            names = [self.key, "change", "last_z", "recent", "low", "high", "drop", "spike", "outlier", "shift"]
            yield pd.DataFrame([(key[0], *rules(n, mean, m2, last))], columns=names)


def alert_stream(df: DataFrame, key: str, time: str, amount: str, late: str = "1 day", idle_days: int = 730) -> DataFrame:
    """(key, change, last_z, recent, low, high, drop, spike, outlier, shift) as often as a key changes; the last row of a key holds.

    State lives in the RocksDB store, which this sets for the session.
    """
    spark = df.sparkSession
    if spark.conf.get(_STATE_STORE) != _ROCKS:
        spark.conf.set(_STATE_STORE, _ROCKS)
    month = (12 * F.year(time) + F.month(time) - 1).alias("month")
    rows = df.withWatermark(time, late).where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(key, time, month, F.col(amount).cast("double").alias("amount"))
    kind = df.schema[key].dataType.simpleString()
    processor = MonthlyAlerts(key, idle_days * 86_400_000)
    return rows.groupBy(key).transformWithStateInPandas(processor, f"`{key}` {kind}, {_MEASURES}", "update", "eventTime")
