"""Passes over one ordered series that need more than a window: lock scores, cycle states, and reaches of a range.

All work on numpy arrays of one symbol's bars; operators and streams hand them the bars of a group.
"""

from __future__ import annotations

from collections import deque

import numpy as np

# Bounds of a lock's three signs, signs that make a lock, and what makes a break-out
ATR_RATIO, MEANS_SPREAD, VOLUME_RATIO, SIGNS = 0.8, 0.04, 0.8, 2
BREAKOUT_PERCENT, BREAKOUT_VOLUME = 2.0, 1.5
#: Bars before there is a score, before a cycle may begin, and in all before there are cycles.
WARM_UP, FIRST, LEAST_BARS = 25, 30, 60
#: Of so many bars so many must be locked for a lock to begin; unlocked bars in a row that end one; its fewest bars.
GATE_BARS, GATE_LOCKED, PATIENCE, LEAST_DAYS, AHEAD = 5, 3, 3, 2, 5


def _mean(x: np.ndarray, n: int) -> np.ndarray:
    """Means of the last n values; nan before there are so many."""
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        out[n - 1 :] = np.lib.stride_tricks.sliding_window_view(x, n).mean(axis=1)
    return out


def lock_scores(o: np.ndarray, h: np.ndarray, l: np.ndarray, c: np.ndarray, v: np.ndarray, first: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each bar the signs of a lock (narrow ranges, close means, thin volume: 0 to 3), whether it breaks out, and its
    change in percent. first is the number of the first bar given; bars before WARM_UP have no signs."""
    before = np.concatenate((c[:1], c[:-1]))
    true_range = np.maximum(h - l, np.maximum(np.abs(h - before), np.abs(l - before)))
    means = np.stack([_mean(c, n) for n in (5, 10, 20)])
    volume = _mean(v, 20)
    signs = (_mean(true_range, 5) / np.maximum(_mean(true_range, 20), 1e-9) < ATR_RATIO).astype(int)
    signs += (means.max(axis=0) - means.min(axis=0)) / np.maximum(c, 0.01) < MEANS_SPREAD
    signs += _mean(v, 5) / np.maximum(volume, 1e-9) < VOLUME_RATIO
    change = (c - o) / np.maximum(o, 0.01) * 100
    out = (change > BREAKOUT_PERCENT) | ((v / np.maximum(volume, 1e-9) > BREAKOUT_VOLUME) & (c > o))
    known = np.arange(first, first + len(c)) >= WARM_UP
    return np.where(known, signs, 0), out & known, change


#: States of the cycle machine: free, locked, and locked with one or two unlocked bars at last.
FREE, LOCKED, WEAK, WEAKER = range(4)


def next_state(state: int, locked: bool, gate: bool, breaks_out: bool) -> int:
    """The state after one more bar. gate: enough of the latest bars are locked; a break-out always sets free."""
    if state == FREE:
        return LOCKED if locked and gate else FREE
    if breaks_out:
        return FREE
    if locked:
        return LOCKED
    return state + 1 if state - LOCKED + 1 < PATIENCE else FREE


def cycle_states(signs: np.ndarray, breaks_out: np.ndarray) -> tuple[list[int], list[int]]:
    """For each bar the state after it, and the bars since the lock began where the bar ends a whole cycle (else 0)."""
    locked = signs >= SIGNS
    recent = np.convolve(locked & (np.arange(len(locked)) >= FIRST), np.ones(GATE_BARS, int))[: len(locked)]
    states, ended, state, since = [], [], FREE, 0
    for i, (is_locked, n, out) in enumerate(zip(locked.tolist(), recent.tolist(), breaks_out.tolist())):
        new = next_state(state, is_locked, n >= GATE_LOCKED, out) if i >= FIRST else FREE
        if state == FREE and new == LOCKED:
            since = i
        ended.append(i - since if state != FREE and out and i - since >= LEAST_DAYS else 0)
        states.append(new)
        state = new
    return states, ended


def reaches(high: np.ndarray, low: np.ndarray, percent: float) -> np.ndarray:
    """For each start the last bar up to which the range, in percent of its low, is within percent; start - 1 where not
    even the start is. Two monotonic queues hold the running extremes, so that a pass is linear."""
    n = len(high)
    out, tops, bottoms, end = np.empty(n, np.int64), deque(), deque(), 0
    for start in range(n):
        end = max(end, start)
        while end < n:
            while tops and high[tops[-1]] <= high[end]:
                tops.pop()
            while bottoms and low[bottoms[-1]] >= low[end]:
                bottoms.pop()
            tops.append(end)
            bottoms.append(end)
            least = low[bottoms[0]]
            if (high[tops[0]] - least) / max(least, 0.01) * 100 > percent:
                break  # stays in the queues; it is looked at again from the next start
            end += 1
        out[start] = end - 1
        for queue in (tops, bottoms):
            if queue and queue[0] == start:
                queue.popleft()
            if queue and queue[-1] == end:
                queue.pop()
    return out


def range_segments(
    high: np.ndarray, low: np.ndarray, window: int = 20, tight: float = 15.0, wide: float = 17.0, least: int = 20, tail: int = 10, restart: bool = True
) -> list[tuple[int, int]]:
    """First and last bar of the locks of a series, from the left: a lock begins where the range of `window` bars is
    within `tight` percent, and goes on while its whole range is within `wide`, but not into the last `tail` - 1 bars.

    A lock of fewer than `least` bars is none; the next one is then looked for from its second bar on (restart), or else
    behind it. Equal to trying every bar in turn, in linear time: the reach of every start is known beforehand.
    """
    n = len(high)
    if n <= window:
        return []
    bottom = np.lib.stride_tricks.sliding_window_view(low, window).min(axis=1)[: n - window]
    top = np.lib.stride_tricks.sliding_window_view(high, window).max(axis=1)[: n - window]
    begins = np.flatnonzero((bottom > 0) & ((top - bottom) / np.where(bottom > 0, bottom, 1.0) * 100 <= tight))
    ends = np.minimum(np.maximum(reaches(high, low, wide)[begins], begins + window - 1), n - tail)
    if restart:
        begins, ends = (x[ends - begins + 1 >= least] for x in (begins, ends))
    found, k = [], 0
    while k < len(begins):
        a, b = int(begins[k]), int(ends[k])
        if b - a + 1 >= least:
            found.append((a, b))
        k = int(np.searchsorted(begins, max(b, a) + 1))
    return found
