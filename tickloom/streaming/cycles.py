"""The lock cycles of a stream of bars: the same scores and transitions as operators.cycles, with state of bounded size.

Bars may come late and in any order within the watermark's delay: they wait in the state until the watermark has passed
them, and are then taken in order of time. A symbol's state is the latest bars that the means need, the bars that wait,
the machine's state and the cycles whose five bars after the break-out haven't come yet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickloom.functions import series

#: Bars that are kept for means and for the bar before them.
TAIL = series.WARM_UP + series.GATE_BARS
_BAR = "ts timestamp, open double, high double, low double, close double, volume double"
_FIELDS = ["open", "high", "low", "close", "volume"]
#: A cycle: its lock's first bar and its break-out (numbers and times), change, close, and the last close known after it.
_CYCLE = "lock_ts timestamp, ts timestamp, at long, lock_days int, change double, close double, latest double"


def _replace(state, rows: list[tuple]) -> None:
    if rows:
        state.put(rows)
    else:
        state.clear()


class Cycles(StatefulProcessor):
    """Emits a cycle once five bars have followed its break-out, or once no bar has come for `patience` milliseconds."""

    def __init__(self, patience: int):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tail = handle.getListState("tail", _BAR)
        self.waiting = handle.getListState("waiting", _BAR)
        self.open = handle.getListState("open", _CYCLE)
        self.machine = handle.getValueState("machine", "n long, state int, since long, since_ts timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for row in batch[["ts", *_FIELDS]].itertuples(index=False):
                self.waiting.appendValue((row.ts, *map(float, row[1:])))
                self.handle.registerTimer(int(row.ts.timestamp() * 1000) + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(map(tuple, self.waiting.get()))
        ready = [x for x in waiting if int(x[0].timestamp() * 1000) < passed]
        found = self._take(ready) if ready else []
        if ready:
            _replace(self.waiting, waiting[len(ready) :])
            self.handle.registerTimer(int(ready[-1][0].timestamp() * 1000) + self.patience)
        tail = list(map(tuple, self.tail.get()))
        if tail and int(tail[-1][0].timestamp() * 1000) + self.patience <= passed and len(waiting) == len(ready):
            found += list(map(tuple, self.open.get()))
            self.open.clear()
        if found:
            yield pd.DataFrame(
                [(key[0], s, t, n, change, (latest - close) / max(close, 0.01) * 100) for s, t, _, n, change, close, latest in found],
                columns=["symbol", "lock_ts", "ts", "lock_days", "breakout_return", "return_5d"],
            )

    def _take(self, bars: list[tuple]) -> list[tuple]:
        """Goes on over bars in order of time; the cycles that are whole now."""
        tail = list(map(tuple, self.tail.get()))
        n, state, since, since_ts = self.machine.get() if self.machine.exists() else (0, series.FREE, 0, bars[0][0])
        cycles, done = list(map(tuple, self.open.get())), []
        rows = tail + bars
        first = n - len(tail)
        columns = (np.array(x) for x in zip(*(r[1:] for r in rows)))
        signs, out, change = series.lock_scores(*columns, first=first)
        locked = signs >= series.SIGNS
        for k in range(len(tail), len(rows)):
            i, ts, close = first + k, rows[k][0], rows[k][4]
            cycles = [(*c[:6], close) for c in cycles]
            done += [c for c in cycles if i - c[2] >= series.AHEAD]
            cycles = [c for c in cycles if i - c[2] < series.AHEAD]
            if i < series.FIRST:
                continue
            from_ = max(series.FIRST, i - series.GATE_BARS + 1) - first
            new = series.next_state(state, bool(locked[k]), locked[from_ : k + 1].sum() >= series.GATE_LOCKED, bool(out[k]))
            if state == series.FREE and new == series.LOCKED:
                since, since_ts = i, ts
            if state != series.FREE and out[k] and i - since >= series.LEAST_DAYS:
                cycles.append((since_ts, ts, i, i - since, float(change[k]), close, close))
            state = new
        _replace(self.tail, rows[-TAIL:])
        self.machine.update((n + len(bars), state, since, since_ts))
        _replace(self.open, cycles)
        return done


def cycle_stream(bars: DataFrame, late: str = "2 days", patience_days: int = 30) -> DataFrame:
    """symbol, lock_ts, ts, lock_days, breakout_return, return_5d of a stream of (symbol, ts, open, high, low, close,
    volume), one row a cycle. Bars later than the watermark are dropped. The LEAST_BARS that a whole table needs are
    not asked for, as a stream has no end. Needs the RocksDB state store."""
    return bars.withWatermark("ts", late).groupBy("symbol").transformWithStateInPandas(
        Cycles(patience_days * 86_400_000), "symbol string, lock_ts timestamp, ts timestamp, lock_days int, breakout_return double, return_5d double", "append", "eventTime",
    )
