"""The momentum-signal indicator: adaptive lines, deviations, directions, strengths and levels of a symbol's bars.

The columns are layers of SQL expressions over windows along a symbol, with one grouped pass for the recurrences in
between: two exchanges by symbol altogether, whatever the number of columns. The same layers run on weekly bars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.bars import daily_bars, weekly_bars
from tickloom.functions.recursive import ema_alpha, recurrences
from tickloom.plans.layers import duck, layered, layered_sql, recurrences_sql
from tickloom.plans.sql import UP_TO_NOW, daily, over

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def r(name: str, digits: int = 6):
    """A rounded column; the small addend keeps dyadic fractions away from a half, where engines round differently."""
    return F.round(F.col(name) + 1e-8, digits).alias(name)


def rounded(names: list[str], digits: int = 6) -> str:
    return ", ".join(f"round({x} + 1e-8, {digits}) AS {x}" for x in names)


ALL = "OVER (PARTITION BY symbol)"
BEFORE = over(first=-1_000_000, last=-1)


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) {over()}"


def crosses(a: str, b: str) -> str:
    return f"coalesce({a} > {b} AND {lag(a)} <= {lag(b)}, false)"


def unit(x: str) -> str:
    return f"least(greatest({x}, 0.0), 1.0)"


def since(flag: str) -> str:
    """Bars since the flag was last set; 0 before it first was."""
    return f"coalesce(rn - max(CASE WHEN {flag} THEN rn END) {UP_TO_NOW}, 0)"


# The indicator's periods, bounds, weights and factors
BASE = [
    {
        "rn": f"row_number() {over()}", "total": f"count(*) {ALL}", "tp": "(close + low + high) / 3", "atr20": f"avg(high - low) {over(20)}",
        "ma5": f"avg(close) {over(5)}", "ma10": f"avg(close) {over(10)}", "ma20": f"avg(close) {over(20)}",
        "vma5": f"avg(volume) {over(5)}", "vma20": f"avg(volume) {over(20)}", "vma60": f"avg(volume) {over(60)}",
        "low9": f"min(low) {over(9)}", "high9": f"max(high) {over(9)}", "c1": lag("close"), "c5": lag("close", 5),
    },
    {"atr_ratio": f"atr20 / nullif({lag('atr20', 20)}, 0)", "rsv": "coalesce((close - low9) / nullif(high9 - low9, 0) * 100, 50.0)"},
    {
        "n": "CASE WHEN atr_ratio > 1.8 THEN 7 WHEN atr_ratio > 1.3 THEN 10 ELSE 13 END",
        "m": "CASE WHEN atr_ratio > 1.8 THEN 5 WHEN atr_ratio > 1.3 THEN 7 ELSE 9 END",
        "mom": "CASE WHEN atr_ratio > 1.5 THEN 3 ELSE 5 END",
        "gain": "CASE WHEN c1 IS NOT NULL THEN greatest(close - c1, 0.0) END", "loss": "CASE WHEN c1 IS NOT NULL THEN greatest(c1 - close, 0.0) END",
    },
    {f"n{x}": f"sum(CASE WHEN n = {x} AND rn > total - 60 THEN 1 ELSE 0 END) {ALL}" for x in (7, 10, 13)}
    | {f"mom{x}": f"sum(CASE WHEN mom = {x} AND rn > total - 60 THEN 1 ELSE 0 END) {ALL}" for x in (3, 5)},
    # the most frequent value of the last 60 bars, the smaller on ties
    {
        "alpha_sell": "2.0 / (1 + CASE WHEN n7 >= n10 AND n7 >= n13 THEN 7 WHEN n10 >= n13 THEN 10 ELSE 13 END)",
        "then_close": f"CASE WHEN mom3 >= mom5 THEN {lag('close', 3)} ELSE c5 END",
    },
    {"gain_pct": "(close - then_close) / nullif(then_close, 0) * 100"},
]
LINES = [
    ("v1", "tp", ema_alpha(3)), ("buy_line", "v1", ema_alpha(3)), ("sell_line", "v1", "alpha_sell"), ("momentum", "gain_pct", ema_alpha(3)),
    ("f12", "close", ema_alpha(12)), ("f26", "close", ema_alpha(26)), ("dea", "f12 - f26", ema_alpha(9)), ("k", "rsv", 1 / 3), ("dl", "k", 1 / 3),
    ("up", "gain", ema_alpha(14)), ("down", "loss", ema_alpha(14)),
]
_WINDOW = "((month(d) = 4 AND day(d) BETWEEN 28 AND 30) OR (month(d) = 9 AND day(d) BETWEEN 26 AND 30) OR (month(d) = 1 AND day(d) BETWEEN 18 AND 23))"
SIGNALS = [
    {
        "diff": "f12 - f26", "hist": "2 * (f12 - f26 - dea)", "j": "3 * k - 2 * dl", "rsi14": "100 - 100 / (1 + up / CASE WHEN down = 0 THEN 0.000000001 ELSE down END)",
        "vol_ratio": "volume / CASE WHEN vma5 = 0 THEN 1.0 ELSE vma5 END", "top60": f"max(high) {over(60)}", "bottom60": f"min(low) {over(60)}",
        "amp5": f"avg((high - low) / nullif(close, 0) * 100) {over(5)}", "amp60": f"avg((high - low) / nullif(close, 0) * 100) {over(60)}",
        "sd5": f"stddev_samp(volume) {over(5)}", "sd20": f"stddev_samp(volume) {over(20)}",
        "holiday": f"{_WINDOW} AND (lead(d) {over()} IS NULL OR lead(d) {over()} > d + INTERVAL 1 DAY)",
        "m1": lag("momentum"), "m2": lag("momentum", 2), "m3": lag("momentum", 3), "m5": lag("momentum", 5),
        "cross_up": crosses("buy_line", "sell_line"), "cross_down": crosses("sell_line", "buy_line"), "k_before": lag("k"), "dl_before": lag("dl"),
    },
    {
        "dist_high": "(top60 - close) / nullif(top60, 0) * 100", "dist_low": "(close - bottom60) / nullif(bottom60, 0) * 100", "hist1": lag("hist"),
        "vola": f"sd5 / CASE WHEN {lag('sd20', 5)} > 0 THEN {lag('sd20', 5)} ELSE 1.0 END",
        "rising": "coalesce(momentum > m1, false)", "falling": "coalesce(momentum < m1, false)", "able": "coalesce(momentum > -5, false)",
    },
    {
        "high_vola": "coalesce(vola > 1.8 AND amp5 > amp60 * 1.5, false)",
        "huge": "coalesce(volume > vma20 * 2.5, false) OR coalesce(volume > vma20 * 1.8 AND vola > 2, false)",
        "buy_dir": "(cross_up AND rising AND able) OR coalesce(rising AND momentum > m2 AND close > c1 AND j < 40 AND able, false) OR (rising AND dist_low < 3 AND vol_ratio > 1.2 AND able)",
        "sell_dir": "(cross_down AND falling) OR coalesce(falling AND momentum < m2 AND close < c1 AND j > 50, false) OR (falling AND dist_high < 5 AND vol_ratio > 1.4)",
    },
    {"since_huge": since("huge"), "since_buy": since("buy_dir")},
    {
        # the lowest low of as many bars as have passed since the last huge volume, this one at least
        "low_since": f"CASE WHEN since_huge <= 1 THEN low ELSE min(CASE WHEN NOT huge THEN low END) OVER (PARTITION BY symbol, rn - since_huge ORDER BY d ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) END",
        "quick": "coalesce(since_buy <= 3 AND close < c1 AND momentum < 0 AND j > 35, false)",
        "volume_part": unit("vol_ratio / 2.0"), "gain_part": f"CASE WHEN c1 IS NOT NULL THEN {unit('(close / nullif(c1, 0) - 1) / 0.05')} END", "low_part": unit("1 - dist_low / 10"),
        "loss_part": f"CASE WHEN c1 IS NOT NULL THEN {unit('(c1 - close) / nullif(close, 0) / 0.05')} END", "high_part": unit("1 - dist_high / 10"),
        "factor": "CASE WHEN momentum > 0 THEN 1.2 WHEN momentum > -2 THEN 1.0 WHEN momentum > -5 THEN 0.7 ELSE 0.4 END",
    },
    {
        "free": "since_huge > 8 OR coalesce(volume < vma5 * 0.9 AND volume < vma20 AND close > low_since, false)",
        "sell_any": "sell_dir OR quick", "buy_strength": f"CASE WHEN gain_part IS NOT NULL THEN {unit('(volume_part + gain_part + low_part) / 3 * factor')} END",
        "sell_strength": "(volume_part + loss_part + high_part) / 3",
    },
    # strengths at the last signal and at the last but one
    {
        "buy_before": f"coalesce(max_by(buy_strength, CASE WHEN buy_dir THEN rn END) {BEFORE}, 0)", "sell_before": f"coalesce(max_by(sell_strength, CASE WHEN sell_any THEN rn END) {BEFORE}, 0)",
        "buy_last": f"coalesce(max_by(buy_strength, CASE WHEN buy_dir THEN rn END) {UP_TO_NOW}, 0)", "sell_last": f"coalesce(max_by(sell_strength, CASE WHEN sell_any THEN rn END) {UP_TO_NOW}, 0)",
        "buys60": f"sum(CASE WHEN buy_dir THEN 1 ELSE 0 END) {over(60)}", "sells60": f"sum(CASE WHEN sell_any THEN 1 ELSE 0 END) {over(60)}",
    },
    {
        "buy_mean": f"CASE WHEN buys60 >= 2 THEN (buy_last + coalesce(max_by(buy_before, CASE WHEN buy_dir THEN rn END) {UP_TO_NOW}, 0)) / 2 ELSE 0.5 END",
        "sell_mean": f"CASE WHEN sells60 >= 2 THEN (sell_last + coalesce(max_by(sell_before, CASE WHEN sell_any THEN rn END) {UP_TO_NOW}, 0)) / 2 ELSE 0.5 END",
    },
    {
        "break_up": "coalesce(buy_dir AND buy_strength > buy_mean * CASE WHEN holiday THEN 1.5 ELSE 1.25 END AND buy_strength > 0.6 AND dist_low < 10, false)",
        "break_down": "coalesce(sell_any AND sell_strength > sell_mean * 1.35 AND sell_strength > 0.65, false)",
        "steady": "coalesce(buy_dir AND amp5 < amp60 * CASE WHEN holiday THEN 0.55 ELSE 0.75 END AND dist_low < 10 AND close > c5 AND momentum > m5, false)",
        "buy_points": "CASE WHEN dist_low < 1.5 THEN 2 WHEN dist_low < 3 THEN 1 ELSE 0 END + CASE WHEN vol_ratio > 1.2 AND volume > vma60 * 0.8 AND NOT holiday THEN 1 ELSE 0 END"
        " + CASE WHEN (close - c1) / nullif(c1, 0) * 100 > 3 THEN 1 ELSE 0 END + CASE WHEN high_vola AND momentum > m3 AND close > ma20 THEN 1 ELSE 0 END",
        "sell_points": "CASE WHEN dist_high < 5 THEN 2 WHEN dist_high < 10 THEN 1 ELSE 0 END + CASE WHEN vol_ratio > 1.4 AND volume > vma60 * 1.5 AND NOT holiday THEN 1 ELSE 0 END"
        " + CASE WHEN (open - close) / nullif(open, 0) * 100 > 3 THEN 1 ELSE 0 END + CASE WHEN high_vola AND momentum < m3 AND close < ma20 THEN 1 ELSE 0 END",
        "dead_cross": "coalesce(j > 75 AND k < dl AND k_before >= dl_before, false)",
    },
    {
        "big_sell": "coalesce(sell_any AND dist_high < 5 AND dead_cross AND hist < 0 AND diff < dea AND (open - close) / nullif(open, 0) * 100 > 3, false)",
        "big_buy": "coalesce(buy_dir AND buy_points >= CASE WHEN holiday THEN 4 ELSE 3 END AND j < CASE WHEN holiday THEN 20 ELSE 25 END AND hist > hist1 AND momentum > -2 AND j < 60, false)",
        "buy_grade": "CASE WHEN buy_points <= 1 THEN 1 WHEN buy_points < CASE WHEN holiday THEN 4 ELSE 3 END THEN 2 ELSE 3 END",
        "sell_grade": "CASE WHEN sell_points <= 1 THEN 1 WHEN sell_points <= 2 THEN 2 ELSE 3 END",
    },
    {
        "buy_up": "CASE WHEN buy_dir AND (steady OR break_up) AND buy_grade < 3 AND NOT (holiday AND buy_grade >= 2) THEN buy_grade + 1 ELSE buy_grade END",
        "sell_up": "CASE WHEN sell_any AND break_down AND sell_grade < 3 AND NOT big_sell THEN sell_grade + 1 ELSE sell_grade END",
    },
    {
        "buy_three": "CASE WHEN big_buy THEN 3 WHEN buy_dir AND buy_up = 3 AND j < 60 THEN 3 WHEN buy_dir AND buy_up = 3 THEN 2 WHEN buy_dir THEN buy_up ELSE 0 END",
        "sell_level": "CASE WHEN big_sell THEN 3 WHEN sell_any THEN sell_up ELSE 0 END",
        "support": "CASE WHEN close > ma5 AND ma5 > ma10 AND ma10 > ma20 THEN 1 ELSE 0 END + CASE WHEN rsi14 > 55 THEN 1 ELSE 0 END + CASE WHEN hist > 0 THEN 1 ELSE 0 END",
        "composite": "least(100.0, greatest(0.0, 25 + 1.5 * momentum + 1.5 * (15 - dist_low) + 0.3 * (j - 50) + 5 * vol_ratio + 30 * buy_strength))",
        "trigger": "CASE WHEN big_buy THEN 'big_buy' WHEN steady THEN 'steady' WHEN break_up THEN 'break_up' ELSE 'points' END",
    },
    # a third level that two of three trend conditions support counts as the fifth: the fourth is passed at once
    {"buy_level": "CASE WHEN buy_dir AND buy_three >= 3 AND support >= 2 THEN 5 ELSE buy_three END"},
]


def indicator(bars: DataFrame) -> DataFrame:
    """All columns of the indicator for bars(symbol, d, open, high, low, close, volume)."""
    given = bars.select("symbol", "d", "open", "high", "low", "close", "volume")
    return layered(recurrences(layered(given, *BASE), LINES), *SIGNALS)


def indicator_sql(source: str, name: str) -> str:
    return f"{layered_sql(source, f'{name}_b', *BASE)},\n {recurrences_sql(f'{name}_b', f'{name}_l', LINES)},\n {layered_sql(f'{name}_l', name, *SIGNALS)}"


_DAILY = f"WITH RECURSIVE {daily()},\n {indicator_sql('bars', 'ind')}"
_STRENGTHS = ["buy_line", "sell_line", "momentum", "vol_ratio", "vola", "dist_high", "dist_low", "j", "rsi14", "buy_strength", "sell_strength", "buy_mean", "sell_mean"]


@query(f"{_DAILY} SELECT symbol, d, m, huge, since_huge, free, holiday, {rounded(_STRENGTHS)} FROM ind")
def signal_strengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adaptive lines, momentum, volume and volatility state, strengths and the means of the last two signals' strengths."""
    return indicator(daily_bars(spark, sf_dir)).select("symbol", "d", "m", "huge", "since_huge", "free", "holiday", *[r(c) for c in _STRENGTHS])


_LEVELS = ["buy_dir", "sell_any", "quick", "buy_points", "sell_points", "steady", "break_up", "break_down", "big_buy", "big_sell", "support", "buy_level", "sell_level"]


@query(f"{_DAILY} SELECT symbol, d, {', '.join(_LEVELS)} FROM ind")
def signal_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions, deviation points, upgrades and final levels of every bar."""
    return indicator(daily_bars(spark, sf_dir)).select("symbol", "d", *_LEVELS)


_EVENT = ["momentum", "close", "vol_ratio", "dist_low", "j", "buy_strength"]


@query(f"{_DAILY} SELECT symbol, d, buy_level, trigger, {rounded(_EVENT)} FROM ind WHERE buy_dir AND buy_level > 0")
def signal_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each bar with a buy signal."""
    rows = indicator(daily_bars(spark, sf_dir)).where("buy_dir AND buy_level > 0")
    return rows.select("symbol", "d", "buy_level", "trigger", *[r(c) for c in _EVENT])


_FOR_SCAN = "rn = total AND total >= 60 AND volume > 0 AND close >= 2"


@query(f"{_DAILY} SELECT symbol, d, buy_dir, buy_level, trigger, {rounded([*_EVENT, 'composite'])} FROM ind WHERE {_FOR_SCAN}")
def signal_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest bar of every symbol with 60 bars or more, with its level, trigger and composite score."""
    rows = indicator(daily_bars(spark, sf_dir)).where(_FOR_SCAN)
    return rows.select("symbol", "d", "buy_dir", "buy_level", "trigger", *[r(c) for c in [*_EVENT, "composite"]])


# Scores of the two periods' agreement
_RESONANCE = "CASE WHEN buy_dir AND weekly_buy THEN 'weekly_resonance' WHEN weekly_buy THEN 'weekly_driven' ELSE 'daily_only' END"
_RESONANCE_SCORE = "CASE resonance WHEN 'weekly_resonance' THEN 1.0 WHEN 'weekly_driven' THEN 0.6 ELSE 0.0 END"
_WEEKLY = """weeks AS (SELECT symbol, max(d) AS d, arg_min(open, d) AS open, max(high) AS high, min(low) AS low, arg_max(close, d) AS close, sum(volume) AS volume
  FROM bars GROUP BY symbol, isoyear(d), week(d) HAVING count(*) >= 2)"""


@query(f"""{_DAILY}, {_WEEKLY}, {indicator_sql('weeks', 'wk')},
 w AS (SELECT symbol, buy_dir AS weekly_buy, momentum AS weekly_momentum FROM wk WHERE rn = total AND total >= 20 AND volume > 0 AND close >= 2),
 x AS (SELECT ind.symbol, ind.d, buy_dir, coalesce(weekly_buy, false) AS weekly_buy, coalesce(weekly_momentum, 0) AS weekly_momentum FROM ind LEFT JOIN w USING (symbol) WHERE {_FOR_SCAN}),
 y AS (SELECT *, {_RESONANCE} AS resonance FROM x)
 SELECT symbol, d, buy_dir, weekly_buy, {rounded(['weekly_momentum'])}, resonance, {duck(_RESONANCE_SCORE)} AS score FROM y""")
def signal_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily scan with the weekly indicator's direction laid over it, the kind of agreement and its score."""
    bars = daily_bars(spark, sf_dir)
    w = indicator(weekly_bars(bars)).where("rn = total AND total >= 20 AND volume > 0 AND close >= 2")
    w = w.select("symbol", F.col("buy_dir").alias("weekly_buy"), F.col("momentum").alias("weekly_momentum"))
    x = indicator(bars).where(_FOR_SCAN).select("symbol", "d", "buy_dir").join(w, "symbol", "left")
    x = x.withColumns({"weekly_buy": F.coalesce("weekly_buy", F.lit(False)), "weekly_momentum": F.coalesce("weekly_momentum", F.lit(0.0))})
    return layered(x, {"resonance": _RESONANCE}, {"score": _RESONANCE_SCORE}).select("symbol", "d", "buy_dir", "weekly_buy", r("weekly_momentum"), "resonance", "score")
