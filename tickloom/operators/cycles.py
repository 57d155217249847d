"""Locks of a series and what follows them: scored lock cycles, the place in a cycle, range locks and their break-outs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.bars import daily_bars
from tickloom.functions import series
from tickloom.functions.recursive import grouped
from tickloom.plans.sql import daily, over

QUERIES, SQL = {}, {}


def cycle_days(bars: DataFrame) -> DataFrame:
    """symbol, d, close, score, locked, breakout, change, state; where a bar ends a cycle also lock_days, lock_d (the
    lock's first day) and return_5d (percent, to the fifth bar after it or the last one).

    One grouped pass over a symbol's bars, a few thousand rows; symbols are what the work is spread over. Symbols of
    fewer than LEAST_BARS bars have scores, but no cycles.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        o, h, l, c, v = (rows[x].to_numpy(float) for x in ("open", "high", "low", "close", "volume"))
        signs, out, change = series.lock_scores(o, h, l, c, v)
        states, ended = series.cycle_states(signs, out) if len(rows) >= series.LEAST_BARS else ([series.FREE] * len(rows), [0] * len(rows))
        ended = np.array(ended)
        at = np.arange(len(rows))
        later = c[np.minimum(at + series.AHEAD, len(rows) - 1)]
        rows["score"], rows["locked"], rows["breakout"], rows["change"], rows["state"] = signs, signs >= series.SIGNS, out, change, states
        rows["lock_days"] = pd.array(np.where(ended > 0, ended, 0), "Int32").copy()
        rows.loc[ended == 0, "lock_days"] = pd.NA
        rows["lock_d"] = rows["d"].to_numpy()[at - ended]
        rows.loc[ended == 0, "lock_d"] = None
        rows["return_5d"] = np.where(ended > 0, (later - c) / np.maximum(c, 0.01) * 100, np.nan)
        return rows

    added = "score int, locked boolean, breakout boolean, change double, state int, lock_days int, lock_d date, return_5d double"
    return grouped(bars.select("symbol", "d", "open", "high", "low", "close", "volume"), run, added).drop("open", "high", "low", "volume")


def cycles(days: DataFrame) -> DataFrame:
    """One row a cycle of cycle_days(): symbol, lock_d, d, lock_days, breakout_return, return_5d."""
    return days.where("lock_days IS NOT NULL").select("symbol", "lock_d", "d", "lock_days", F.round("change", 2).alias("breakout_return"), F.round("return_5d", 2).alias("return_5d"))


def lock_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cycles(cycle_days(daily_bars(spark, sf_dir)))


#: From the definition: windows for the three signs, and one recursive step a bar for the machine.
_CYCLES_SQL = f"""WITH RECURSIVE {daily()},
 r AS (SELECT *, row_number() {over()} - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n,
   greatest(high - low, abs(high - coalesce(lag(close) {over()}, close)), abs(low - coalesce(lag(close) {over()}, close))) AS tr FROM bars),
 w AS (SELECT *, avg(tr) {over(5)} AS tr5, avg(tr) {over(20)} AS tr20, avg(close) {over(5)} AS m5, avg(close) {over(10)} AS m10,
   avg(close) {over(20)} AS m20, avg(volume) {over(5)} AS v5, avg(volume) {over(20)} AS v20, (close - open) / greatest(open, 0.01) * 100 AS change,
   lead(close, 5) {over()} AS later, last_value(close) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final FROM r),
 s AS (SELECT *, CASE WHEN i < 25 THEN 0 ELSE CAST(tr5 / greatest(tr20, 1e-9) < 0.8 AS INT)
     + CAST((greatest(m5, m10, m20) - least(m5, m10, m20)) / greatest(close, 0.01) < 0.04 AS INT) + CAST(v5 / greatest(v20, 1e-9) < 0.8 AS INT) END AS score,
   i >= 25 AND (change > 2 OR (volume / greatest(v20, 1e-9) > 1.5 AND close > open)) AS breakout FROM w),
 g AS (SELECT *, score >= 2 AS locked, sum(CASE WHEN score >= 2 AND i >= 30 THEN 1 ELSE 0 END) {over(5)} >= 3 AS gate FROM s),
 m AS (SELECT symbol, i, false AS inside, 0 AS weak, CAST(NULL AS BIGINT) AS since, CAST(NULL AS BIGINT) AS ended FROM g WHERE i = 29 AND n >= 60
  UNION ALL SELECT g.symbol, g.i,
   CASE WHEN NOT m.inside THEN g.locked AND g.gate WHEN g.breakout THEN false ELSE g.locked OR m.weak < 2 END,
   CASE WHEN NOT m.inside OR g.breakout OR g.locked THEN 0 ELSE m.weak + 1 END,
   CASE WHEN m.inside THEN m.since WHEN g.locked AND g.gate THEN g.i END,
   CASE WHEN m.inside AND g.breakout AND g.i - m.since >= 2 THEN m.since END
  FROM m JOIN g ON g.symbol = m.symbol AND g.i = m.i + 1),
 c AS (SELECT g.symbol, b.d AS lock_d, g.d, CAST(g.i - m.ended AS INT) AS lock_days, round(g.change, 2) AS breakout_return,
   round((coalesce(g.later, g.final) - g.close) / greatest(g.close, 0.01) * 100, 2) AS return_5d
  FROM m JOIN g USING (symbol, i) JOIN g b ON b.symbol = m.symbol AND b.i = m.ended)"""
QUERIES["lock_cycles"] = lock_cycles
SQL["lock_cycles"] = f"{_CYCLES_SQL} SELECT * FROM c"

#: Bars that are looked at from the last one back.
LOOK_BACK = 59


def positions(days: DataFrame) -> DataFrame:
    """One row a symbol of cycle_days(): statistics of its cycles, the phase it is in (breakout, lockup, normal; unknown
    below WARM_UP bars), the lock's days so far and its place in the mean cycle, with the features made of them."""
    stats = cycles(days).groupBy("symbol").agg(
        F.count("*").alias("n_cycles"), F.round(F.avg("lock_days"), 1).alias("avg_lock"), F.round(F.stddev_pop("lock_days") / F.avg("lock_days"), 3).alias("cv"),
        F.round(F.avg("breakout_return"), 2).alias("avg_return"),
        F.round(F.avg("return_5d") / F.greatest(F.abs(F.avg("breakout_return")), F.lit(0.01)), 1).alias("return_ratio"),
    )
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("d"))) - 1
    n = F.count("*").over(Window.partitionBy("symbol"))
    seen = days.select("symbol", "locked", "breakout", back.alias("k"), n.alias("n")).where(F.col("k") < F.least(F.lit(LOOK_BACK), F.greatest(F.col("n") - 1, F.lit(1))))
    stops = F.col("breakout") | ~F.col("locked")
    last = seen.groupBy("symbol", "n").agg(F.min(F.when(stops, F.col("k"))).alias("stop"), F.min_by("breakout", F.when(stops, F.col("k"))).alias("by_breakout"))
    day = F.when(F.col("n") < series.WARM_UP, 0).otherwise(F.coalesce("stop", F.least(F.lit(LOOK_BACK), F.col("n") - 1))).cast("int")
    known = last.join(stats, "symbol", "left").fillna({"n_cycles": 0, "avg_lock": 0.0, "cv": 999.0, "avg_return": 0.0, "return_ratio": 0.0}).withColumn("day", day)
    phase = F.when(F.col("n") < series.WARM_UP, "unknown").when(F.col("by_breakout") & (F.col("stop") <= 1), "breakout").when(F.col("day") > 0, "lockup").otherwise("normal")
    known = known.withColumns({"phase": phase, "place": F.round(F.col("day") / F.greatest("avg_lock", F.lit(1e-9)), 3)})
    early = F.when(F.col("place") < 0.5, "early").when(F.col("place") < 0.8, "near").when(F.col("place") < 1.2, "due").otherwise("overdue")
    chance = F.when((F.col("phase") == "lockup") & F.col("place").between(0.8, 1.2), 0.6).when((F.col("phase") == "lockup") & (F.col("place") > 1.2), 0.3)
    chance = chance.when(F.col("phase") == "breakout", 1.0).otherwise(F.round(F.greatest(1 - F.abs(F.col("place") - 0.85), F.lit(0.05)), 2))
    return known.select(
        "symbol", "n_cycles", "avg_lock", "cv", "avg_return", "return_ratio",
        F.when(F.col("n_cycles") == 0, "none").when(F.col("cv") < 0.3, "regular").when(F.col("cv") < 0.6, "fair").otherwise("random").alias("regularity"),
        "phase", "day", "place", F.when(F.col("phase") == "lockup", early).otherwise(F.col("phase")).alias("window_status"),
        F.round(F.greatest(F.col("avg_lock") - F.col("day"), F.lit(0.0)), 1).alias("remaining"), chance.alias("breakout_chance"),
    )


def cycle_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions(cycle_days(daily_bars(spark, sf_dir)))


QUERIES["cycle_position"] = cycle_position
SQL["cycle_position"] = f"""{_CYCLES_SQL},
 a AS (SELECT symbol, count(*) AS n_cycles, round(avg(lock_days), 1) AS avg_lock, round(stddev_pop(lock_days) / avg(lock_days), 3) AS cv,
   round(avg(breakout_return), 2) AS avg_return, round(avg(return_5d) / greatest(abs(avg(breakout_return)), 0.01), 1) AS return_ratio FROM c GROUP BY symbol),
 k AS (SELECT symbol, n - 1 - i AS k, locked, breakout, n FROM g WHERE n - 1 - i < 59 AND i > 0),
 e AS (SELECT symbol, any_value(n) AS n, min(k) FILTER (breakout OR NOT locked) AS stop, min(k) FILTER (breakout) AS first_out FROM k GROUP BY symbol),
 p AS (SELECT symbol, n, coalesce(stop, least(59, n - 1)) AS day, first_out = stop AND stop <= 1 AS out_now, coalesce(n_cycles, 0) AS n_cycles, coalesce(avg_lock, 0) AS avg_lock,
   coalesce(cv, 999) AS cv, coalesce(avg_return, 0) AS avg_return, coalesce(return_ratio, 0) AS return_ratio, round(coalesce(stop, least(59, n - 1)) / greatest(coalesce(avg_lock, 0), 1e-9), 3) AS place
  FROM e LEFT JOIN a USING (symbol)),
 q AS (SELECT *, CASE WHEN out_now THEN 'breakout' WHEN day > 0 THEN 'lockup' ELSE 'normal' END AS phase FROM p)
 SELECT symbol, n_cycles, avg_lock, cv, avg_return, return_ratio, CASE WHEN n_cycles = 0 THEN 'none' WHEN cv < 0.3 THEN 'regular' WHEN cv < 0.6 THEN 'fair' ELSE 'random' END AS regularity,
  phase, day, place, CASE WHEN phase <> 'lockup' THEN phase WHEN place < 0.5 THEN 'early' WHEN place < 0.8 THEN 'near' WHEN place < 1.2 THEN 'due' ELSE 'overdue' END AS window_status,
  round(greatest(avg_lock - day, 0), 1) AS remaining,
  CASE WHEN phase = 'lockup' AND place >= 0.8 AND place <= 1.2 THEN 0.6 WHEN phase = 'lockup' AND place > 1.2 THEN 0.3 WHEN phase = 'breakout' THEN 1
   ELSE round(greatest(1 - abs(place - 0.85), 0.05), 2) END AS breakout_chance FROM q"""


def smoothed(bars: DataFrame, n: int = 100) -> DataFrame:
    """Bars of the means of the last n closes (where there are so many), as the given prices are too wild to be locked."""
    w = Window.partitionBy("symbol").orderBy("d").rowsBetween(1 - n, 0)
    out = bars.select("symbol", "d", F.avg("close").over(w).alias("close"), "volume", F.count("*").over(w).alias("seen")).where(F.col("seen") == n)
    return out.select("symbol", "d", F.col("close").alias("high"), F.col("close").alias("low"), "close", "volume")


_SEGMENT = (
    "symbol string, k int, first_d date, last_d date, days int, high double, low double, avg_price double, avg_volume double, early_range double, late_range double, "
    "early_volume double, late_volume double, close double, close_5 double, close_20 double, n_bars int, bars_after int"
)


def range_locks_of(bars: DataFrame, latest: int = 800, restart: bool = True, least: int = 20) -> DataFrame:
    """The locks of a symbol's latest bars (symbol, d, high, low, close, volume), taken from the left by their range:
    one row a lock, with the ranges and volumes of its two halves and the closes 5 and 20 bars after it.

    One grouped pass, linear in a symbol's bars. Missing values count as 0.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("d", ignore_index=True).tail(latest).fillna({"high": 0.0, "low": 0.0, "close": 0.0, "volume": 0.0})
        d = rows["d"].tolist()
        h, l, c, v = (rows[x].to_numpy(float) for x in ("high", "low", "close", "volume"))
        spread = lambda a, b: (h[a:b].max() - l[a:b].min()) / max(l[a:b].min(), 0.01) * 100
        later = lambda i: c[i] if i < len(c) else None
        found = []
        for k, (a, b) in enumerate(series.range_segments(h, l, restart=restart, least=least), 1):
            half = a + (b - a + 1) // 2
            found.append((
                rows["symbol"].iloc[0], k, d[a], d[b], b - a + 1, h[a : b + 1].max(), l[a : b + 1].min(), c[a : b + 1].mean(), v[a : b + 1].mean(), spread(a, half), spread(half, b + 1),
                v[a:half].mean(), v[half : b + 1].mean(), c[b], later(b + 5), later(b + 20), len(c), len(c) - 1 - b,
            ))
        return pd.DataFrame(found, columns=[x.split()[0] for x in _SEGMENT.split(", ")])

    return bars.select("symbol", "d", "high", "low", "close", "volume").groupBy("symbol").applyInPandas(run, _SEGMENT)


def lock_signals(locks: DataFrame, least_cycles: int = 4) -> DataFrame:
    """What was known at the end of each lock that is a symbol's least_cycles-th or a later one: its length against the
    locks so far, whether its range narrowed and its volume thinned, level (pre_breakout, late_stage, monitoring) and
    score; and the gains 5 and 20 bars later. Nothing that comes after a lock takes part in its level and score."""
    so_far = Window.partitionBy("symbol").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = locks.withColumns({
        "avg_days": F.avg("days").over(so_far), "max_days": F.max("days").over(so_far), "median_days": F.percentile("days", 0.5).over(so_far),
        "std_days": F.stddev_pop("days").over(so_far), "longer": F.collect_list("days").over(so_far),
    })
    x = x.where(F.col("k") >= least_cycles).withColumns({
        "days_ratio": F.col("days") / F.greatest("avg_days", F.lit(1.0)),
        "rank_pct": F.round(F.size(F.filter("longer", lambda y: y >= F.col("days"))) / F.col("k") * 100, 1),
        "narrows": F.col("late_range") < F.col("early_range") * 0.85,
        "thins": (F.col("late_volume") < F.col("early_volume") * 0.7) & (F.col("early_volume") > 0),
    })
    signs = sum(F.col(c).cast("int") for c in ("narrows", "thins")) + (F.col("days_ratio") >= 0.8).cast("int")
    duration = F.least(F.lit(100.0), F.greatest(F.lit(0.0), (F.col("days") - F.col("avg_days") * 0.5) / F.greatest("avg_days", F.lit(1.0)) * 100))
    score = duration + F.when(F.col("narrows"), 20).otherwise(0) + F.when(F.col("thins"), 15).otherwise(0) + F.least(F.lit(25), F.col("k") * 2)
    gain = lambda c: F.when((F.col("close") > 0) & (F.col(c) > 0), (F.col(c) - F.col("close")) / F.col("close") * 100)
    return x.withColumns({
        "level": F.when(signs == 3, "pre_breakout").when(signs == 2, "late_stage").otherwise("monitoring"), "score": F.round(F.least(F.lit(100.0), score), 1),
        "gain_5": gain("close_5"), "gain_20": gain("close_20"),
    }).drop("longer")


def veteran_locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of at least 200 bars that have been locked four times or more, and are locked now or were 30 bars ago."""
    x = lock_signals(range_locks_of(smoothed(daily_bars(spark, sf_dir))))
    last = F.max("k").over(Window.partitionBy("symbol"))
    x = x.withColumn("last", last).where((F.col("k") == F.col("last")) & (F.col("n_bars") >= 200) & (F.col("bars_after") <= 30))
    return x.select(
        "symbol", F.col("k").alias("cycles"), "days", (F.col("bars_after") <= 4).alias("locked_now"), F.round("avg_days", 1).alias("avg_days"), "max_days", "median_days",
        F.round("std_days", 1).alias("std_days"), F.round("days_ratio", 2).alias("days_ratio"), "rank_pct", "narrows", "thins", "level", "score",
    )


def lock_breakouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often locks of a level rose by more than 3 percent in 5 bars, or 5 percent in 20, and by how much they did."""
    x = lock_signals(range_locks_of(smoothed(daily_bars(spark, sf_dir)), latest=1_000_000))
    rose_5, rose_20 = F.col("gain_5") > 3, F.col("gain_20") > 5
    rate = lambda c: F.round(F.count_if(c) / F.count("*") * 100, 1)
    mean = lambda c, x: F.round(F.coalesce(F.avg(F.when(c, F.col(x))), F.lit(0.0)), 1)
    out = [F.count("*").alias("n"), rate(rose_5).alias("rate_5"), rate(rose_20).alias("rate_20"), mean(rose_5, "gain_5").alias("gain_5"), mean(rose_20, "gain_20").alias("gain_20")]
    return x.groupBy("level").agg(*out)


QUERIES["veteran_locks"] = veteran_locks
QUERIES["lock_breakouts"] = lock_breakouts


def _locks_sql(latest: int) -> str:
    """From the definition: the range of every stretch from every start, then locks by pointers to the next start."""
    whole = "OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)"
    return f"""WITH RECURSIVE {daily()},
 sm AS (SELECT symbol, d, avg(close) {over(100)} AS close, volume, row_number() {over()} AS rn, count(*) OVER (PARTITION BY symbol) AS total FROM bars),
 t AS (SELECT symbol, d, close, volume, row_number() {over()} - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM sm WHERE rn >= 100 AND rn > total - {latest}),
 w AS (SELECT symbol, i, n, max(close) {whole} AS top, min(close) {whole} AS bottom FROM t),
 b AS (SELECT symbol, i, n FROM w WHERE i < n - 20 AND bottom > 0 AND (top - bottom) / bottom * 100 <= 15),
 r AS (SELECT b.symbol, b.i, b.n, t.i AS j, max(t.close) OVER p AS hi, min(t.close) OVER p AS lo FROM b JOIN t ON t.symbol = b.symbol AND t.i >= b.i WINDOW p AS (PARTITION BY b.symbol, b.i ORDER BY t.i)),
 e AS (SELECT symbol, i, least(coalesce(min(j) FILTER ((hi - lo) / greatest(lo, 0.01) * 100 > 17), n) - 1, n - 10) AS e FROM r GROUP BY symbol, i, n),
 g AS (SELECT * FROM e WHERE e - i + 1 >= 20),
 p AS (SELECT g.symbol, g.i, g.e, f.i AS follows FROM g ASOF LEFT JOIN g f ON f.symbol = g.symbol AND f.i > g.e),
 k AS (SELECT symbol, 1 AS k, i, e, follows FROM p WHERE i = (SELECT min(i) FROM p q WHERE q.symbol = p.symbol)
  UNION ALL SELECT p.symbol, k.k + 1, p.i, p.e, p.follows FROM k JOIN p ON p.symbol = k.symbol AND p.i = k.follows),
 l AS (SELECT k.symbol, k.k, k.e - k.i + 1 AS days, any_value(t.n) AS n, any_value(t.n) - 1 - k.e AS after,
   max(close) FILTER (t.i < k.i + (k.e - k.i + 1) // 2) AS h1, min(close) FILTER (t.i < k.i + (k.e - k.i + 1) // 2) AS l1, avg(volume) FILTER (t.i < k.i + (k.e - k.i + 1) // 2) AS v1,
   max(close) FILTER (t.i >= k.i + (k.e - k.i + 1) // 2) AS h2, min(close) FILTER (t.i >= k.i + (k.e - k.i + 1) // 2) AS l2, avg(volume) FILTER (t.i >= k.i + (k.e - k.i + 1) // 2) AS v2,
   any_value(close) FILTER (t.i = k.e) AS c, k.e AS at FROM k JOIN t ON t.symbol = k.symbol AND t.i BETWEEN k.i AND k.e GROUP BY k.symbol, k.k, k.i, k.e),
 m AS (SELECT *, avg(days) OVER f AS mean, max(days) OVER f AS longest, median(days) OVER f AS middle, stddev_pop(days) OVER f AS sd, max(k) OVER (PARTITION BY symbol) AS last,
   (h2 - l2) / greatest(l2, 0.01) < (h1 - l1) / greatest(l1, 0.01) * 0.85 AS narrows, v2 < v1 * 0.7 AND v1 > 0 AS thins FROM l WINDOW f AS (PARTITION BY symbol ORDER BY k)),
 x AS (SELECT m.*, days / greatest(mean, 1) AS ratio, (SELECT count(*) FROM l q WHERE q.symbol = m.symbol AND q.k <= m.k AND q.days >= m.days) / k * 100 AS longer FROM m WHERE k >= 4),
 y AS (SELECT *, CASE CAST(narrows AS INT) + CAST(thins AS INT) + CAST(ratio >= 0.8 AS INT) WHEN 3 THEN 'pre_breakout' WHEN 2 THEN 'late_stage' ELSE 'monitoring' END AS level,
   least(100, least(100, greatest(0, (days - mean * 0.5) / greatest(mean, 1) * 100)) + CASE WHEN narrows THEN 20 ELSE 0 END + CASE WHEN thins THEN 15 ELSE 0 END + least(25, 2 * k)) AS score FROM x)"""


SQL["veteran_locks"] = f"""{_locks_sql(800)}
 SELECT symbol, k AS cycles, days, after <= 4 AS locked_now, round(mean, 1) AS avg_days, longest AS max_days, middle AS median_days, round(sd, 1) AS std_days, round(ratio, 2) AS days_ratio,
  round(longer, 1) AS rank_pct, narrows, thins, level, round(score, 1) AS score FROM y WHERE k = last AND n >= 200 AND after <= 30"""
SQL["lock_breakouts"] = f"""{_locks_sql(1_000_000)},
 z AS (SELECT y.level, (a.close - y.c) / y.c * 100 AS g5, (b.close - y.c) / y.c * 100 AS g20 FROM y LEFT JOIN t a ON a.symbol = y.symbol AND a.i = y.at + 5 LEFT JOIN t b ON b.symbol = y.symbol AND b.i = y.at + 20)
 SELECT level, count(*) AS n, round(count(*) FILTER (g5 > 3) / count(*) * 100, 1) AS rate_5, round(count(*) FILTER (g20 > 5) / count(*) * 100, 1) AS rate_20,
  round(coalesce(avg(g5) FILTER (g5 > 3), 0), 1) AS gain_5, round(coalesce(avg(g20) FILTER (g20 > 5), 0), 1) AS gain_20 FROM z GROUP BY level"""
