"""Residual feedback on a stream: what the next day's forecast is to be moved by, as soon as a day is over."""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY_MS = 86_400_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "series_id string, day int, hour int, rho double, residual double"


def _rounded(x: float) -> Decimal:
    return Decimal(repr(x)).quantize(Decimal("1e-9"), ROUND_HALF_UP)


class DailyFeedback(StatefulProcessor):
    """A series' state: rows of days that aren't over, the last residual of each hour, and of each day in the window the number
    of its pairs and the summed error of each factor. A day's rows are counted once, when the watermark has passed its end."""

    def __init__(self, window: int, shrink: float, least: int, rho_max: float, n: int):
        self.window, self.shrink, self.least = window, shrink, least
        self.factors = [rho_max * i / (n - 1) for i in range(n)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.over = handle.getValueState("over", "day int")
        self.open = handle.getMapState("open", "day int", "hours array<int>, p50 array<double>, actual array<double>")
        self.last = handle.getMapState("last", "hour int", "residual double")
        self.sums = handle.getMapState("sums", "day int", "n long, errors array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        over = self.over.get()[0] if self.over.exists() else None
        for pdf in rows:
            for day, part in pdf.groupby("day", sort=True):
                day = int(day)
                if over is not None and day <= over:
                    continue  # its correction and its sums are out
                held = self.open.getValue((day,)) if self.open.containsKey((day,)) else ([], [], [])
                hours, p50, actual = (list(x) for x in held)
                for r in part.itertuples():
                    if r.hour not in hours:
                        hours.append(int(r.hour))
                        p50.append(float(r.p50))
                        actual.append(float(r.actual))
                self.open.updateValue((day,), (hours, p50, actual))
                self.handle.registerTimer(day * DAY_MS)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs() // DAY_MS
        if self.over.exists() and until <= self.over.get()[0]:
            return  # closed with a later day: timers of one batch come in any order
        waiting = sorted(k[0] for k in self.open.keys() if k[0] <= until)
        sums = {k[0]: v for k, v in self.sums.iterator()}
        last = {k[0]: v[0] for k, v in self.last.iterator()}
        day = self.over.get()[0] + 1 if self.over.exists() else waiting[0] if waiting else until + 1
        out = []
        while day <= until:
            if day in waiting:
                waiting.remove(day)
                sums[day] = self._close(day, last)
            elif not any(day + 1 - self.window <= d for d in sums):  # silent for the whole window: no shift until rows come again
                day = waiting[0] if waiting else until + 1
                continue
            for d in [d for d in sums if d < day + 1 - self.window]:
                del sums[d]
                self.sums.removeKey((d,))
            rho = self._rho(sums)
            out += [(key[0], day + 1, hour, rho, None if math.isnan(r) else r) for hour, r in sorted(last.items())]
            day += 1
        self.over.update((until,))
        if sums:
            self.handle.registerTimer((until + 1) * DAY_MS)  # the next day is over in its turn, with rows or without
        names = [c.split()[0] for c in OUT.split(", ")]
        yield pd.DataFrame(out, columns=names).astype({"day": "int32", "hour": "int32", "rho": float, "residual": float})

    def _close(self, day: int, last: dict[int, float]) -> tuple[int, list[float]]:
        """A day's pairs and summed errors; last becomes the day's residuals."""
        n, errors = 0, [0.0] * len(self.factors)
        for hour, p50, actual in zip(*self.open.getValue((day,))):
            residual, before = actual - p50, last.get(hour, math.nan)
            if not math.isnan(residual - before):
                n += 1
                errors = [e + abs(residual - f * before) for e, f in zip(errors, self.factors)]
            last[hour] = residual
            self.last.updateValue((hour,), (residual,))
        self.open.removeKey((day,))
        self.sums.updateValue((day,), (n, errors))
        return n, errors

    def _rho(self, sums: dict[int, tuple]) -> float:
        n = sum(v[0] for v in sums.values())
        if len(sums) < self.least or not n:
            return 0.0
        totals = [sum(v[1][i] for _, v in sorted(sums.items())) for i in range(len(self.factors))]
        return self.shrink * min((_rounded(t / n), f) for t, f in zip(totals, self.factors))[1]

    def close(self) -> None:
        pass


def daily_feedback(
    rows: DataFrame, window: int = 28, shrink: float = 0.5, least: int = 14, rho_max: float = 0.8, n: int = 17, late: str = "2 hours"
) -> DataFrame:
    """A stream of (series_id, day, hour, p50, actual), days and hours numbered by the series' own calendar -> (series_id, day, hour,
    rho, residual): once a day is over, what calibration.residual_feedback() finds for the day after it; the shift is rho times
    residual, none where either is missing.

    A day is over when a row comes that is `late` past its end, of whichever series; rows of days that are over are dropped, and of
    a repeated hour the first row counts. Days without rows are over in their turn, by timers; a series that is silent for a whole
    window gives no rows until it is heard again. A null actual value gives a null residual. State a series: the window's days
    with n + 1 numbers each, one residual an hour, and the rows of open days. Needs the RocksDB state store
    (spark.sql.streaming.stateStore.providerClass: ROCKS) and the append mode."""
    at = F.timestamp_seconds(F.col("day").cast("long") * 86400 + F.col("hour").cast("long") * 3600)
    x = rows.select("series_id", F.col("day").cast("int").alias("day"), F.col("hour").cast("int").alias("hour"), F.col("p50").cast("double").alias("p50"), F.col("actual").cast("double").alias("actual"), at.alias("at"))
    # a day behind, so that no row of an open day is late; a day's timer is its start
    return x.withWatermark("at", f"1 day {late}").groupBy("series_id").transformWithStateInPandas(
        statefulProcessor=DailyFeedback(window, shrink, least, rho_max, n), outputStructType=OUT, outputMode="Append", timeMode="EventTime"
    )
