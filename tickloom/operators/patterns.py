"""Candlestick patterns as conditions over a bar and its predecessors, and structures over longer windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.bars import daily_bars
from tickloom.functions import windows as W
from tickloom.operators.rolling import r
from tickloom.plans.sql import UP_TO_NOW, daily, over, rounded

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def candles(bars: DataFrame) -> DataFrame:
    """Adds to each bar what the patterns look at: body, shadows, the two bars before, means of volume and body."""
    b = bars.withColumns({
        "body": F.abs(F.col("close") - F.col("open")), "bull": F.col("close") > F.col("open"),
        "upper": F.col("high") - F.greatest("close", "open"), "lower": F.least("close", "open") - F.col("low"), "rn": W.row(),
    })
    more = {f"{c}{k}": W.ref(c, k) for c in ("open", "high", "low", "close", "volume", "body", "bull", "upper", "lower") for k in (1, 2)}
    more |= {f"ma{n}": W.ma("close", n) for n in (5, 10, 20)}
    more |= {"v9": F.avg("volume").over(W.ahead(-9, -1)), "v19": F.avg("volume").over(W.ahead(-19, -1)), "body5": F.avg("body").over(W.ahead(-7, -3)), "body10": F.avg("body").over(W.ahead(-12, -3))}
    more |= {"low20": W.lowest("close", 20), "high20": W.highest("close", 20)}
    b = b.withColumns(more)
    return b.withColumns({f"ma{n}p": W.ref(f"ma{n}") for n in (5, 10, 20)})


#: Each pattern as a condition on the columns of candles(); the same text is valid in either dialect.
PATTERNS = {
    "three_rising": "rn >= 4 AND bull AND bull1 AND bull2 AND close2 < close1 AND close1 < close AND body1 >= body2 * 0.7 AND body >= body1 * 0.7 AND volume / greatest(v9, 1) >= 1",
    "convergence": "rn >= 25 AND (greatest(ma5, ma10, ma20) - least(ma5, ma10, ma20)) / ma20 * 100 <= 2 AND close > ma5 AND close > ma10 AND close > ma20 AND volume / greatest(v19, 1) >= 1.5",
    "sandwich": "rn >= 5 AND bull2 AND NOT bull1 AND bull AND body2 > 0 AND body1 <= body2 * 1.2 AND close > close2 AND volume1 <= volume2 * 1.1 AND volume >= volume2 * 1.1",
    "morning_star": "rn >= 10 AND NOT bull2 AND bull AND body5 > 0 AND body2 / close2 >= 0.02 AND body2 >= body5 * 1.3 AND body1 <= body2 * 0.35 AND upper1 >= body1 * 0.3 AND lower1 >= body1 * 0.3 AND close >= close2",
    "piercing": "rn >= 10 AND NOT bull1 AND bull AND body1 / close1 >= 0.02 AND open < low1 AND close > (open1 + close1) / 2 AND volume >= v9",
    "low_shadow": "rn >= 20 AND low <= low20 * 1.03 AND body > 0 AND lower >= body * 3 AND high > low AND (close - low) >= 0.5 * (high - low) AND volume >= v9 * 1.1",
    "three_falling": "rn >= 5 AND NOT bull AND NOT bull1 AND NOT bull2 AND close2 > close1 AND close1 > close AND body1 >= body2 * 0.5 AND body >= body1 * 0.5 AND NOT (coalesce(body10, 0) > 0 AND (body + body1 + body2) / 3 < body10)",
    "evening_star": "rn >= 5 AND bull2 AND NOT bull AND body2 / close2 >= 0.02 AND body1 <= body2 * 0.35 AND upper1 >= body1 * 0.3 AND lower1 >= body1 * 0.3 AND close <= close2",
    "hanging_man": "rn >= 20 AND high >= high20 * 0.95 AND body > 0 AND lower >= body * 2 AND upper <= body * 0.5 AND high > low AND (close - low) >= 0.3 * (high - low)",
    "break_of_means": "rn >= 25 AND NOT bull AND (close / close1 - 1) * 100 <= -3 AND close1 > ma5p AND close1 > ma10p AND close1 > ma20p AND close < ma5p AND close < ma10p AND close < ma20p",
    "dark_cloud": "rn >= 5 AND bull1 AND NOT bull AND body1 / close1 >= 0.015 AND open > high1 AND close <= (open1 + close1) / 2 AND close >= close1",
    "pouring_rain": "rn >= 5 AND bull1 AND NOT bull AND body1 / close1 >= 0.015 AND open > high1 AND close < (open1 + close1) / 2",
}

_LAGS = ", ".join(f"lag({c}, {k}) {over()} AS {c}{k}" for c in ("open", "high", "low", "close", "volume", "body", "bull", "upper", "lower") for k in (1, 2))
CANDLES = f"""{daily("p_type")}, b0 AS (SELECT *, abs(close - open) AS body, close > open AS bull, high - greatest(close, open) AS upper, least(close, open) - low AS lower, row_number() {over()} AS rn FROM bars),
 b1 AS (SELECT *, {_LAGS}, avg(close) {over(5)} AS ma5, avg(close) {over(10)} AS ma10, avg(close) {over(20)} AS ma20, avg(volume) {over(first=-9, last=-1)} AS v9, avg(volume) {over(first=-19, last=-1)} AS v19,
 avg(body) {over(first=-7, last=-3)} AS body5, avg(body) {over(first=-12, last=-3)} AS body10, min(close) {over(20)} AS low20, max(close) {over(20)} AS high20 FROM b0),
 b2 AS (SELECT *, lag(ma5) {over()} AS ma5p, lag(ma10) {over()} AS ma10p, lag(ma20) {over()} AS ma20p FROM b1)"""


def _double(text: str) -> str:
    """Decimal literals as doubles, for DuckDB."""
    import re

    return re.sub(r"\b(\d+\.\d+)\b", r"\1::DOUBLE", text)


@query(f"WITH {CANDLES} SELECT symbol, d, {', '.join(f'coalesce({_double(x)}, false) AS {n}' for n, x in PATTERNS.items())} FROM b2")
def candle_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candlestick patterns at every bar; one exchange by symbol serves every window."""
    import re

    b = candles(daily_bars(spark, sf_dir, "p_type"))
    return b.select("symbol", "d", *[W.true(F.expr(re.sub(r"\b(\d+\.\d+)\b", r"\1D", x))).alias(n) for n, x in PATTERNS.items()])


@query(f"WITH {CANDLES}, f AS ({' UNION ALL '.join(f'''SELECT '{n}' AS pattern, d FROM b2 WHERE {_double(x)}''' for n, x in PATTERNS.items())}) SELECT pattern, count(*) AS n, min(d) AS d FROM f GROUP BY 1")
def pattern_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each pattern fires over the market."""
    flags = candle_patterns(spark, sf_dir)
    long = flags.select("d", F.explode(F.filter(F.array(*[F.when(F.col(n), F.lit(n)) for n in PATTERNS]), lambda x: x.isNotNull())).alias("pattern"))
    return long.groupBy("pattern").agg(F.count("*").alias("n"), F.min("d").alias("d"))


@query(f"""WITH {daily()}, e AS (SELECT symbol, d, close, low, volume, row_number() {over()} AS rn, (close / nullif(lag(close) {over()}, 0) - 1) * 100 >= 9.5::DOUBLE AS surge FROM bars),
 p AS (SELECT symbol, d, rn, lag(rn) {over()} AS first_rn FROM e WHERE surge),
 j AS (SELECT p.symbol, p.d, p.rn - p.first_rn AS between_bars, min(b.close) FILTER (WHERE b.rn >= p.first_rn AND b.rn < p.rn) AS between_low, min(b.low) FILTER (WHERE b.rn BETWEEN p.first_rn - 1 AND p.first_rn) AS first_low,
 avg(b.volume) FILTER (WHERE b.rn >= p.first_rn AND b.rn < p.rn) AS between_v, avg(b.volume) FILTER (WHERE b.rn < p.first_rn) AS before_v
 FROM p JOIN e b ON b.symbol = p.symbol AND b.rn >= p.first_rn - 5 AND b.rn < p.rn WHERE p.rn - p.first_rn <= 20 GROUP BY ALL)
 SELECT symbol, d, between_bars, coalesce(between_low >= first_low * 0.98::DOUBLE AND before_v > 0 AND between_v < before_v * 0.7::DOUBLE, false) AS quiet FROM j""")
def double_surge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two surges within 20 bars, and whether the bars between them were quiet and held the first one's low.

    Offsets of a surge are bounded, so each one is met with its window by an equi-join on (symbol, row).
    """
    e = daily_bars(spark, sf_dir).select("symbol", "d", "close", "low", "volume", W.row().alias("rn"), W.true(W.change("close") >= 9.5).alias("surge"))
    p = e.where("surge").select("symbol", "d", "rn", W.ref("rn").alias("first_rn")).where("rn - first_rn <= 20")
    at = p.select("*", F.explode(F.sequence(F.col("first_rn") - 5, F.col("rn") - 1)).alias("at"))
    j = at.join(e.select("symbol", F.col("rn").alias("at"), "close", "low", "volume"), ["symbol", "at"])
    inside, around, before = F.col("at") >= F.col("first_rn"), F.col("at").between(F.col("first_rn") - 1, F.col("first_rn")), F.col("at") < F.col("first_rn")
    g = j.groupBy("symbol", "d", (F.col("rn") - F.col("first_rn")).cast("long").alias("between_bars")).agg(
        F.min(F.when(inside, F.col("close"))).alias("between_low"), F.min(F.when(around, F.col("low"))).alias("first_low"),
        F.avg(F.when(inside, F.col("volume"))).alias("between_v"), F.avg(F.when(before, F.col("volume"))).alias("before_v"),
    )
    quiet = (F.col("between_low") >= F.col("first_low") * 0.98) & (F.col("before_v") > 0) & (F.col("between_v") < F.col("before_v") * 0.7)
    return g.select("symbol", "d", "between_bars", W.true(quiet).alias("quiet"))


@query(f"""WITH {daily()}, k AS (SELECT symbol, d, close, max(high) {over(15)} AS h15, min(low) {over(15)} AS l15, max(high) {over(30)} AS h30, min(low) {over(30)} AS l30, count(*) {over(30)} AS n FROM bars),
 f AS (SELECT symbol, d, n = 30 AND (h15 / nullif(l15, 0) - 1) * 100 <= 900 AND (h30 / nullif(l30, 0) - 1) * 100 <= 1000 AS locked FROM k),
 g AS (SELECT *, CASE WHEN locked = coalesce(lag(locked) {over()}, NOT locked) THEN 0 ELSE 1 END AS new FROM f), i AS (SELECT *, sum(new) {UP_TO_NOW} AS island FROM g),
 s AS (SELECT symbol, island, min(d) AS d, max(d) AS last_d, count(*) AS bars FROM i WHERE locked GROUP BY 1, 2) SELECT symbol, d, last_d, bars FROM s""")
def range_locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches in which the price stays within a range over 15 and over 30 bars, as islands.

    The bounds suit bars of unrelated trades, which are wide; narrower ones are a parameter of range_lock_cycles.
    """
    return range_lock_cycles(daily_bars(spark, sf_dir), 900.0, 1000.0)


def range_lock_cycles(bars: DataFrame, short: float = 15.0, long: float = 17.0) -> DataFrame:
    """symbol, d, last_d, bars of every stretch whose range is within short % over 15 bars and long % over 30."""
    within = lambda n, most: (W.ratio(W.highest("high", n), W.lowest("low", n)) - 1) * 100 <= most
    f = bars.select("symbol", "d", W.true((F.count(F.lit(1)).over(W.back(30)) == 30) & within(15, short) & within(30, long)).alias("locked"))
    g = f.withColumn("new", F.when(F.col("locked") == W.ref("locked"), 0).otherwise(1))
    i = g.withColumn("island", F.sum("new").over(W.so_far())).where("locked")
    return i.groupBy("symbol", "island").agg(F.min("d").alias("d"), F.max("d").alias("last_d"), F.count("*").alias("bars")).drop("island")


@query(f"""WITH {daily()}, a AS (SELECT symbol, d, avg(high - low) {over(15)} AS now15, avg(high - low) {over(first=-29, last=-15)} AS before15 FROM bars)
 SELECT symbol, d, round(now15 / nullif(before15, 0), 6) AS amplitude_ratio, CASE WHEN before15 IS NULL OR before15 = 0 THEN 'unknown' WHEN now15 < before15 * 0.8::DOUBLE THEN 'shrinking' WHEN now15 > before15 * 1.2::DOUBLE THEN 'growing' ELSE 'steady' END AS trend FROM a""")
def amplitude_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean daily range of the last 15 bars against the 15 before."""
    size = F.col("high") - F.col("low")
    a = daily_bars(spark, sf_dir).select("symbol", "d", W.ma(size, 15).alias("now15"), F.avg(size).over(W.ahead(-29, -15)).alias("before15"))
    trend = F.when(F.col("before15").isNull() | (F.col("before15") == 0), "unknown").when(F.col("now15") < F.col("before15") * 0.8, "shrinking").when(F.col("now15") > F.col("before15") * 1.2, "growing").otherwise("steady")
    return a.select("symbol", "d", r("amplitude_ratio", W.ratio("now15", "before15")), trend.alias("trend"))


@query(f"""WITH {daily()}, e AS (SELECT *, row_number() {over()} AS rn, (close / nullif(lag(close) {over()}, 0) - 1) * 100 AS chg, volume / nullif(avg(volume) {over(first=-5, last=-1)}, 0) AS vr FROM bars),
 t AS (SELECT symbol, d, rn, close, volume FROM e WHERE chg >= 9.5::DOUBLE AND vr >= 1.8::DOUBLE),
 a AS (SELECT t.symbol, t.d, count(*) AS bars, min(b.close) / any_value(t.close) - 1 AS drawdown, avg(b.volume) / any_value(t.volume) AS shrink FROM t JOIN e b ON b.symbol = t.symbol AND b.rn > t.rn AND b.rn <= t.rn + 15 GROUP BY t.symbol, t.d, t.rn)
 SELECT symbol, d, bars, {rounded({"drawdown": "drawdown * 100", "shrink": "shrink"})}, bars >= 3 AND drawdown <= -0.02::DOUBLE AND drawdown >= -0.12::DOUBLE AND shrink < 0.8::DOUBLE AS ambush FROM a""")
def pullback_ambush(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A surge on high volume and the pullback of up to 15 bars after it, by frames that look ahead."""
    after = W.ahead(1, 15)
    e = daily_bars(spark, sf_dir).select(
        "symbol", "d", W.change("close").alias("chg"), W.ratio("volume", F.avg("volume").over(W.ahead(-5, -1))).alias("vr"), F.count(F.lit(1)).over(after).alias("bars"),
        (F.min("close").over(after) / F.col("close") - 1).alias("drawdown"), (F.avg("volume").over(after) / F.col("volume")).alias("shrink"),
    )
    t = e.where("chg >= 9.5 and vr >= 1.8 and bars > 0")
    return t.select("symbol", "d", "bars", r("drawdown", F.col("drawdown") * 100), r("shrink", "shrink"), ((F.col("bars") >= 3) & (F.col("drawdown") <= -0.02) & (F.col("drawdown") >= -0.12) & (F.col("shrink") < 0.8)).alias("ambush"))


@query(f"""WITH {daily()} SELECT symbol, d, {rounded({"support20": f"min(low) {over(20)}", "support60": f"min(low) {over(60)}", "resistance20": f"max(high) {over(20)}", "resistance60": f"max(high) {over(60)}",
 "to_support": f"(close / nullif(min(low) {over(20)}, 0) - 1) * 100", "to_resistance": f"(max(high) {over(20)} / nullif(close, 0) - 1) * 100"})} FROM bars""")
def support_resistance(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = daily_bars(spark, sf_dir)
    return b.select(
        "symbol", "d", r("support20", W.lowest("low", 20)), r("support60", W.lowest("low", 60)), r("resistance20", W.highest("high", 20)), r("resistance60", W.highest("high", 60)),
        r("to_support", (W.ratio("close", W.lowest("low", 20)) - 1) * 100), r("to_resistance", (W.ratio(W.highest("high", 20), "close") - 1) * 100),
    )


@query()
def exit_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exits of a position entered 20 bars before: range stop, trailing stop, time decay; each flagged at every bar."""
    tr = F.greatest(F.col("high") - F.col("low"), F.coalesce(F.abs(F.col("high") - W.ref("close")), F.lit(0.0)), F.coalesce(F.abs(F.col("low") - W.ref("close")), F.lit(0.0)))
    t = daily_bars(spark, sf_dir).withColumn("tr", tr).withColumns({"atr": W.ma("tr", 14), "peak": W.highest("high", 20), "entry": W.ref("close", 19)}).where("entry is not null")
    return t.select(
        "symbol", "d", (F.col("close") < F.col("entry") - 2 * F.col("atr")).alias("range_stop"), (F.col("close") < F.col("peak") - 3 * F.col("atr")).alias("trailing_stop"),
        (F.abs(F.col("close") / F.col("entry") - 1) < 0.03).alias("time_decay"), r("trail", F.col("peak") - 3 * F.col("atr"), 5),
    )


SQL["exit_signals"] = f"""WITH {daily()}, q AS (SELECT *, greatest(high - low, coalesce(abs(high - lag(close) {over()}), 0), coalesce(abs(low - lag(close) {over()}), 0)) AS tr FROM bars),
 t AS (SELECT symbol, d, close, avg(tr) {over(14)} AS atr, max(high) {over(20)} AS peak, lag(close, 19) {over()} AS entry FROM q)
 SELECT symbol, d, close < entry - 2 * atr AS range_stop, close < peak - 3 * atr AS trailing_stop, abs(close / entry - 1) < 0.03::DOUBLE AS time_decay, round(peak - 3 * atr, 5) AS trail FROM t WHERE entry IS NOT NULL"""
