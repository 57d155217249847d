"""Scorers of a bar by its history: technical state, sentiment, trend lines, downside risk, structure of means."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.bars import daily_bars
from tickloom.functions.recursive import ema_alpha, recurrences
from tickloom.operators.signals import lag, r, rounded
from tickloom.plans.layers import Layer, layered, layered_sql, recurrences_sql
from tickloom.plans.sql import UP_TO_NOW, daily, over

QUERIES, SQL = {}, {}


def register(name: str, doc: str, columns: list[str], where: str, *parts: Layer | list, plain: list[str] = ()) -> None:
    """A query over daily bars whose columns are layers (dicts) and recurrences (lists), and its SQL.

    columns are rounded, plain ones taken as they are; rows for which where holds are returned.
    """
    ctes, source = [], "bars"
    for k, part in enumerate(parts):
        ctes.append(layered_sql(source, f"p{k}", part) if isinstance(part, dict) else recurrences_sql(source, f"p{k}", part))
        source = f"p{k}"
    SQL[name] = ",\n ".join([f"WITH RECURSIVE {daily()}", *ctes]) + f"\n SELECT {', '.join(['symbol', 'd', *plain])}{', ' + rounded(columns) if columns else ''} FROM {source} WHERE {where}"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = daily_bars(spark, sf_dir)
        for part in parts:
            rows = layered(rows, part) if isinstance(part, dict) else recurrences(rows, part)
        return rows.where(where).select("symbol", "d", *plain, *[r(c) for c in columns])

    run.__name__, run.__doc__ = name, doc
    QUERIES[name] = run


def clip(x: str, low: float, high: float) -> str:
    return f"least(greatest({x}, {float(low)!r}), {float(high)!r})"


def strict(x: str, n: int, of: str = "avg") -> str:
    """An aggregate of the last n rows, null until there are n that aren't null."""
    return f"CASE WHEN count({x}) {over(n)} = {n} THEN {of}({x}) {over(n)} END"


def ladder(x: str, steps: list[tuple[str, float]], rest: float) -> str:
    return "CASE " + " ".join(f"WHEN {c.replace('?', x)} THEN {float(v)!r}" for c, v in steps) + f" ELSE {float(rest)!r} END"


ROW = {"rn": f"row_number() {over()}", "c1": lag("close")}
CHANGES = {"gain": "CASE WHEN c1 IS NOT NULL THEN greatest(close - c1, 0.0) END", "loss": "CASE WHEN c1 IS NOT NULL THEN greatest(c1 - close, 0.0) END"}
MACD = [("f12", "close", ema_alpha(12)), ("f26", "close", ema_alpha(26)), ("dea", "f12 - f26", ema_alpha(9))]

# Bounds and points of the scorers below
register(
    "score_technical", "Relative strength, MACD, volume trend and place in the Bollinger bands.", ["rsi", "hist", "score"], "rn >= 20",
    ROW, MACD, CHANGES,
    {"u": strict("gain", 14), "dn": strict("loss", 14), "hist": "2 * (f12 - f26 - dea)", "v5": f"avg(volume) {over(5)}", "v20": f"avg(volume) {over(20)}",
     "ma20": f"avg(close) {over(20)}", "sd20": f"stddev_samp(close) {over(20)}"},
    {"rsi": "CASE WHEN dn > 0 THEN 100 - 100 / (1 + u / dn) ELSE 100.0 END", "hist1": lag("hist"), "hist2": lag("hist", 2),
     "vr": "CASE WHEN v20 > 0 THEN v5 / v20 ELSE 1.0 END", "z": "CASE WHEN sd20 > 0 THEN (close - ma20) / sd20 ELSE 0.0 END"},
    {"score": clip(
        ladder("rsi", [("? < 25", 4), ("? < 35", 3), ("? < 45", 1.5), ("? < 55", 0), ("? < 65", -1), ("? < 75", -2.5)], -4)
        + " + CASE WHEN hist > 0 THEN 1.5 + CASE WHEN hist > hist1 THEN 1.0 ELSE 0.0 END + CASE WHEN hist2 < 0 THEN 1.5 ELSE 0.0 END"
        + " ELSE -1.5 - CASE WHEN hist < hist1 THEN 1.0 ELSE 0.0 END - CASE WHEN hist < 0 AND hist2 > 0 THEN 1.5 ELSE 0.0 END END + "
        + ladder("vr", [("? > 1.5 AND ? <= 2.5", 2.5), ("? > 1.0 AND ? <= 1.5", 1.5), ("? >= 0.8 AND ? <= 1.0", 0), ("? >= 0.5 AND ? < 0.8", -1), ("? > 4", -2.5), ("? < 0.3", -3)], -1.5)
        + " + " + ladder("z", [("? > -2 AND ? < -1", 2.5), ("? >= -1 AND ? < -0.3", 1.5), ("? >= -0.3 AND ? <= 0.3", 0), ("? > 0.3 AND ? <= 1", -1), ("? > 1 AND ? <= 2", -2)], -3), -10, 10)},
)

_RATIO = lambda a, b: f"{strict(a, 26, 'sum')} / CASE WHEN {strict(b, 26, 'sum')} = 0 THEN 0.000000001 ELSE {strict(b, 26, 'sum')} END * 100"
register(
    "score_arbr", "Popularity and willingness over 26 bars, and their crossings in the last three steps.", ["ar_shown", "br_shown", "score"], "rn >= 30",
    ROW,
    {"ho": "greatest(high - open, 0.0)", "ol": "greatest(open - low, 0.0)", "hc": "CASE WHEN c1 IS NOT NULL THEN greatest(high - c1, 0.0) END", "cl": "CASE WHEN c1 IS NOT NULL THEN greatest(c1 - low, 0.0) END"},
    {"ar": _RATIO("ho", "ol"), "br": _RATIO("hc", "cl")},
    {"up": f"CASE WHEN {lag('ar')} <= {lag('br')} AND ar > br THEN 1 ELSE 0 END", "down": f"CASE WHEN {lag('ar')} >= {lag('br')} AND ar < br THEN 1 ELSE 0 END"},
    {"gold": f"max(up) {over(3)} = 1", "dead": f"max(down) {over(3)} = 1", "ar_shown": "least(ar, 1000000.0)", "br_shown": "least(br, 1000000.0)"},
    {"score": clip(
        "CASE WHEN br > ar AND br >= 80 AND br <= 200 THEN 6.0 WHEN br > ar AND br > 200 THEN 2.0 WHEN ar > br AND ar > 200 THEN -5.0 WHEN ar < 50 AND br < 60 THEN 3.0 ELSE 0.0 END"
        " + CASE WHEN gold AND ar < 120 THEN 2.0 ELSE 0.0 END + CASE WHEN gold AND ar < 70 THEN 1.5 ELSE 0.0 END"
        " - CASE WHEN dead AND br > 200 THEN 3.0 ELSE 0.0 END - CASE WHEN dead AND br > 300 THEN 3.0 ELSE 0.0 END", -10, 10)},
    plain=["gold", "dead"],
)

register(
    "score_bbi", "Deviation from the mean of four means, its slope over ten bars, and crossings in five.", ["deviation", "slope", "score"], "rn >= 30",
    ROW,
    {"bbi": "(" + " + ".join(strict("close", n) for n in (3, 6, 12, 24)) + ") / 4"},
    {"deviation": "coalesce((close - bbi) / nullif(bbi, 0) * 100, 0.0)", "slope": f"coalesce((bbi - {lag('bbi', 9)}) / nullif({lag('bbi', 9)}, 0) * 100, 0.0)",
     "step": f"CASE WHEN close > bbi AND c1 <= {lag('bbi')} THEN 1 WHEN close < bbi AND c1 >= {lag('bbi')} THEN -1 ELSE 0 END"},
    {"crossings": f"CAST(sum(step) {over(5)} AS INT)"},
    {"score": clip(
        f"CASE WHEN deviation < 0 THEN {clip('5.0 - deviation * 0.5', 3, 9)} ELSE {clip('5.0 - deviation * 0.8', 0, 8)} END + {clip('slope * 0.5', -2, 2)} + {clip('crossings * 0.5', -1, 1)}", 0, 10)},
    plain=["crossings"],
)

_WEAK = "(close < open OR (close < h1 AND close > open) OR (close >= open AND high - close >= close - open AND close / c1 < 1.02) OR (close = open AND high - close >= close - low AND close / c1 < 1.05))"
_STRONG = "((close > open AND close / c1 > 0.94) OR (close > l1 AND close < open) OR (close <= open AND close - low >= open - close AND close / c1 > 0.98) OR (close = open AND close - low >= high - close AND close / c1 > 0.95))"
_PASS = lambda k: {f"s{k + 1}": f"CASE WHEN s{k} > base AND {lag(f's{k}')} <= {lag('base')} AND weak THEN base * 0.98 WHEN s{k} < base AND {lag(f's{k}')} >= {lag('base')} AND strong THEN base * 1.02 ELSE s{k} END"}
register(
    "score_trend_deviation", "A weighted price drawn towards the trend's base in ten passes, its deviation and how steady its side is.", ["base", "line", "deviation", "score"], "rn >= 30",
    ROW, [("e5", "close", 2 / 6)],
    {"base": "coalesce((" + " + ".join(strict("close", n) for n in (3, 7, 13, 27)) + ") / 4, e5)", "s0": "(high + low + 2 * open + 6 * close) / 10", "h1": lag("high"), "l1": lag("low")},
    {"weak": f"coalesce({_WEAK}, false)", "strong": f"coalesce({_STRONG}, false)"},
    *[_PASS(k) for k in range(10)],
    {"line": "s10", "side": "CASE WHEN s10 >= base THEN 1 ELSE -1 END", "deviation": "(s10 / nullif(base, 0) - 1) * 100"},
    {"turn": f"CASE WHEN side <> {lag('side')} THEN 1 ELSE 0 END"},
    {"stability": f"CAST(greatest(0, 10 - sum(turn) {over(29)}) AS INT)"},
    {"score": clip(f"CASE WHEN abs(deviation) < 1 THEN 0.0 ELSE {clip('5.0 + deviation * 0.5', 0, 10)} * 0.6 + stability * 0.4 END - CASE WHEN deviation < 0 THEN 3.0 ELSE 0.0 END", 0, 10)},
    plain=["stability"],
)

register(
    "score_downside", "Overheating, sudden volatility, rises without volume, falling streaks, broken means, crashes.", ["rsi", "score"], "rn >= 21",
    ROW, CHANGES, [("up", "gain", ema_alpha(14)), ("down", "loss", ema_alpha(14))],
    {"rsi": "100 - 100 / (1 + up / CASE WHEN down = 0 THEN 0.000000001 ELSE down END)", "change": "(close - c1) / nullif(c1, 0)", "c4": lag("close", 4),
     "last_rise": "CASE WHEN c1 IS NULL OR close >= c1 THEN rn END",
     "v3": f"avg(volume) {over(3)}", "v5": f"avg(volume) {over(first=-7, last=-3)}", "ma5": f"avg(close) {over(5)}", "ma20": f"avg(close) {over(20)}"},
    {"sd5": f"stddev_pop(change) {over(5)}", "sd20": f"stddev_pop(change) {over(20)}", "streak": f"CAST(least(9, rn - max(last_rise) {UP_TO_NOW}) AS INT)"},
    {"score": clip(
        "CASE WHEN rsi > 75 THEN -(rsi - 75) * 0.25 WHEN rsi > 65 THEN -(rsi - 65) * 0.15 WHEN rsi < 25 THEN (25 - rsi) * 0.2 ELSE 0.0 END - CASE WHEN sd20 > 0 AND sd5 > sd20 * 2 THEN 2.5 ELSE 0.0 END"
        " - CASE WHEN close > c4 AND v3 < v5 * 0.7 THEN 2.0 ELSE 0.0 END - CASE WHEN streak >= 4 THEN streak * 0.6 WHEN streak >= 2 THEN streak * 0.25 ELSE 0.0 END"
        " - CASE WHEN close < ma20 AND ma5 < ma20 THEN 2.0 ELSE 0.0 END - CASE WHEN change < -0.07 THEN 3.0 ELSE 0.0 END", -10, 10)},
    {"risk": "CASE WHEN score < -5 THEN 'high' WHEN score < -2 THEN 'elevated' ELSE 'normal' END"},
    plain=["streak", "risk"],
)

register(
    "score_mean_trend", "Order of the means of 5, 20 and 60 bars and the deviation from the middle one.", ["bias", "score"], "rn >= 60",
    ROW, {f"ma{n}": f"avg(close) {over(n)}" for n in (5, 20, 60)},
    {"bias": "(close - ma20) / nullif(ma20, 0) * 100"},
    {"score": clip(
        "CASE WHEN close > ma5 AND ma5 > ma20 AND ma20 > ma60 THEN 4.5 WHEN close > ma5 AND ma5 > ma20 THEN 3.0 WHEN close > ma20 THEN 1.5 WHEN close > ma60 THEN 0.5 ELSE -2.0 END"
        " + CASE WHEN bias > -5 AND bias < -2 THEN 2.5 WHEN bias >= -2 AND bias <= 2 THEN 1.0 WHEN bias > 10 THEN -2.0 WHEN bias < -15 THEN -2.0 ELSE 0.0 END", -10, 10)},
)

_POWER = lambda own, other: f"sum(CASE WHEN {own} > 0 AND {own} > {other} THEN {own} ELSE 0.0 END) {over(25)} * 100 / greatest(tr25, 0.01)"
register(
    "directional_power", "Buying and selling power over 25 bars and the mean divergence of 15.", ["buy_power", "sell_power", "divergence"], "rn >= 1",
    ROW,
    {"tr": "CASE WHEN c1 IS NULL THEN high - low ELSE greatest(high - low, abs(high - c1)) END", "rise": f"coalesce(high - {lag('high')}, 0.0)", "fall": f"coalesce({lag('low')} - low, 0.0)"},
    {"tr25": f"sum(tr) {over(25)}"},
    {"buy_power": _POWER("rise", "fall"), "sell_power": _POWER("fall", "rise")},
    {"apart": "abs(sell_power - buy_power) / nullif(sell_power + buy_power, 0) * 100"},
    {"divergence": f"CASE WHEN rn >= 15 THEN avg(apart) {over(15)} ELSE 0.0 END", "sellers": "sell_power > buy_power AND sell_power > 25 AND buy_power < 25"},
    plain=["sellers"],
)

register(
    "recursive_variants", "Exponential means seeded with a mean, Wilder's true range and relative strength, and the stochastic line that starts from its first value.",
    ["ema_mean_seed", "ema_late_seed", "atr_wilder", "rsi_ema", "rsi_wilder6", "rsi_wilder12", "rsi_mean_seed", "k_first", "j_first", "k_floor"], "rn >= 1",
    ROW, CHANGES,
    {"tr": "greatest(high - low, abs(high - c1), abs(low - c1))", "low9": f"min(low) {over(9)}", "high9": f"max(high) {over(9)}"},
    {"x12": f"CASE WHEN rn = 1 THEN avg(close) {over(first=0, last=11)} ELSE close END", "x108": f"CASE WHEN rn = 108 THEN avg(close) {over(108)} WHEN rn > 108 THEN close END",
     "tr14": f"CASE WHEN rn = 14 THEN avg(tr) {over(13)} WHEN rn > 14 THEN tr END", "gain0": f"CASE WHEN rn = 1 THEN avg(coalesce(gain, 0.0)) {over(first=0, last=13)} ELSE gain END", "loss0": f"CASE WHEN rn = 1 THEN avg(coalesce(loss, 0.0)) {over(first=0, last=13)} ELSE loss END",
     "rsv": "coalesce((close - low9) / nullif(high9 - low9, 0) * 100, 50.0)", "rsv_floor": "CASE WHEN rn = 1 THEN 50.0 ELSE (close - low9) / greatest(high9 - low9, 0.0001) * 100 END"},
    [("ema_mean_seed", "x12", ema_alpha(12)), ("ema_late_seed", "x108", ema_alpha(108)), ("atr_wilder", "tr14", 1 / 14), ("u14", "gain", ema_alpha(14)), ("d14", "loss", ema_alpha(14)),
     ("u6", "gain", 1 / 6), ("d6", "loss", 1 / 6), ("u12", "gain", 1 / 12), ("d12", "loss", 1 / 12), ("us", "gain0", ema_alpha(14)), ("ds", "loss0", ema_alpha(14)),
     ("k_first", "rsv", 1 / 3), ("d_first", "k_first", 1 / 3), ("k_floor", "rsv_floor", 1 / 3)],
    {"rsi_ema": "100 - 100 / (1 + u14 / CASE WHEN d14 = 0 THEN 0.000000001 ELSE d14 END)", "rsi_wilder6": "100 - 100 / (1 + u6 / CASE WHEN d6 = 0 THEN 0.000000001 ELSE d6 END)",
     "rsi_wilder12": "100 - 100 / (1 + u12 / CASE WHEN d12 = 0 THEN 0.000000001 ELSE d12 END)", "rsi_mean_seed": "100 - 100 / (1 + us / greatest(ds, 0.0001))", "j_first": "3 * k_first - 2 * d_first"},
)


def run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest runs of rising bars in the last 60 of each symbol, their number, and the share of the last ten."""
    rows = layered(daily_bars(spark, sf_dir), *_RUNS)
    runs = rows.where("age <= 60 AND red").groupBy("symbol", "island").agg(F.count("*").alias("n")).groupBy("symbol").agg(F.max("n").alias("longest"), F.sum("n").alias("rising"))
    last = rows.where("age <= 10").groupBy("symbol").agg(F.avg(F.col("red").cast("double")).alias("share10"))
    return last.join(runs, "symbol", "left").select("symbol", F.coalesce("longest", F.lit(0)).alias("longest"), F.coalesce("rising", F.lit(0)).alias("rising"), r("share10"))


_RUNS = [
    {"rn": f"row_number() {over()}", "total": "count(*) OVER (PARTITION BY symbol)", "red": "close > open"},
    {"island": f"rn - sum(CASE WHEN close > open THEN 1 ELSE 0 END) {UP_TO_NOW}", "age": "total - rn + 1"},
]
QUERIES["run_lengths"] = run_lengths
SQL["run_lengths"] = f"""WITH {daily()}, {layered_sql("bars", "x", *_RUNS)},
 g AS (SELECT symbol, island, count(*) AS n FROM x WHERE age <= 60 AND red GROUP BY 1, 2), m AS (SELECT symbol, max(n) AS longest, CAST(sum(n) AS BIGINT) AS rising FROM g GROUP BY 1),
 l AS (SELECT symbol, avg(CASE WHEN red THEN 1.0::DOUBLE ELSE 0 END) AS share10 FROM x WHERE age <= 10 GROUP BY 1)
 SELECT symbol, coalesce(longest, 0) AS longest, coalesce(rising, 0) AS rising, {rounded(["share10"])} FROM l LEFT JOIN m USING (symbol)"""
