"""Rolling and recursive time-series operators over daily bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.bars import counted_bars, daily_bars, event_bars, weekly_bars
from tickloom.functions import recursive as R
from tickloom.functions import windows as W
from tickloom.plans.sql import UP_TO_NOW, daily, over, rounded
from tickloom.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def r(name: str, x, digits: int = 6):
    return F.round(x, digits).alias(name)


@query(f"WITH {daily()} SELECT symbol, d, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume, round(amount, 4) AS amount FROM bars")
def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = daily_bars(spark, sf_dir)
    return b.select("symbol", "d", r("open", "open"), r("high", "high"), r("low", "low"), r("close", "close"), "volume", r("amount", "amount", 4))


@query(f"""WITH {daily()} SELECT symbol, d, {rounded({
    "ma5": f"avg(close) {over(5)}", "ma20": f"avg(close) {over(20)}",
    "sma20": f"CASE WHEN count(*) {over(20)} = 20 THEN avg(close) {over(20)} END", "ref1": f"lag(close) {over()}",
    "hhv20": f"max(high) {over(20)}", "llv20": f"min(low) {over(20)}", "std20": f"stddev_samp(close) {over(20)}",
    "stdp20": f"stddev_pop(close) {over(20)}", "chg1": f"(close / lag(close) {over()} - 1) * 100",
    "chg5": f"(close / lag(close, 5) {over()} - 1) * 100"})},
  CAST(sum(CASE WHEN close > open THEN 1 ELSE 0 END) {over(10)} AS BIGINT) AS up10 FROM bars""")
def rolling_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means, references, extremes, deviations, changes and conditional counts."""
    b = daily_bars(spark, sf_dir)
    return b.select(
        "symbol", "d", r("ma5", W.ma("close", 5)), r("ma20", W.ma("close", 20)), r("sma20", W.sma("close", 20)), r("ref1", W.ref("close")),
        r("hhv20", W.highest("high", 20)), r("llv20", W.lowest("low", 20)), r("std20", W.std("close", 20)), r("stdp20", W.std_pop("close", 20)),
        r("chg1", W.change("close")), r("chg5", W.change("close", 5)), W.count_true(F.col("close") > F.col("open"), 10).alias("up10"),
    )


@query(f"""WITH {daily()}, m AS (SELECT symbol, d, close, avg(close) {over(5)} AS m5, avg(close) {over(20)} AS m20, row_number() {over()} AS rn FROM bars),
 c AS (SELECT *, coalesce(m5 > m20 AND lag(m5) {over()} <= lag(m20) {over()}, false) AS up FROM m)
 SELECT symbol, d, up AS crossed, coalesce(rn - last_value(CASE WHEN up THEN rn END IGNORE NULLS) {UP_TO_NOW}, 0) AS bars_since FROM c""")
def rolling_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crossings of two means and the bars since the last one."""
    m = daily_bars(spark, sf_dir).select("symbol", "d", W.ma("close", 5).alias("m5"), W.ma("close", 20).alias("m20"))
    c = m.select("symbol", "d", W.cross("m5", "m20").alias("crossed"))
    return c.withColumn("bars_since", W.bars_last(F.col("crossed")))


@query(f"""WITH {daily()}, s AS (SELECT symbol, d, close, avg(close) {over(20)} AS mid, stddev_samp(close) {over(20)} AS sd FROM bars)
 SELECT symbol, d, {rounded({"mid": "mid", "upper": "mid + 2 * sd", "lower": "mid - 2 * sd", "width": "4 * sd / nullif(mid, 0)",
 "place": "(close - (mid - 2 * sd)) / nullif(4 * sd, 0)", "z": "(close - mid) / nullif(sd, 0)"})} FROM s""")
def bollinger(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = daily_bars(spark, sf_dir).select("symbol", "d", "close", W.ma("close", 20).alias("mid"), W.std("close", 20).alias("sd"))
    low = F.col("mid") - 2 * F.col("sd")
    return s.select(
        "symbol", "d", r("mid", "mid"), r("upper", F.col("mid") + 2 * F.col("sd")), r("lower", low), r("width", W.ratio(4 * F.col("sd"), "mid")),
        r("place", W.ratio(F.col("close") - low, 4 * F.col("sd"))), r("z", W.ratio(F.col("close") - F.col("mid"), "sd")),
    )


@query(f"""WITH {daily()}, g AS (SELECT symbol, d, close, CASE WHEN lag(close) {over()} IS NOT NULL THEN greatest(close - lag(close) {over()}, 0) END AS up, CASE WHEN lag(close) {over()} IS NOT NULL THEN greatest(lag(close) {over()} - close, 0) END AS down FROM bars),
 m AS (SELECT symbol, d, avg(up) {over(14)} AS u, avg(down) {over(14)} AS dn, count(up) {over(14)} AS n FROM g)
 SELECT symbol, d, {rounded({"rsi_loss_zero_100": "CASE WHEN n < 14 THEN NULL WHEN dn > 0 THEN 100 - 100 / (1 + u / dn) ELSE 100 END",
 "rsi_loss_zero_1": "CASE WHEN n = 14 THEN 100 - 100 / (1 + u / CASE WHEN dn = 0 THEN 1 ELSE dn END) END"})} FROM m""")
def rsi_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative strength by simple means of 14 changes; the variants differ where nothing was lost."""
    g = daily_bars(spark, sf_dir).withColumns({"up": F.when(W.ref("close").isNotNull(), F.greatest(F.col("close") - W.ref("close"), F.lit(0.0))), "down": F.when(W.ref("close").isNotNull(), F.greatest(W.ref("close") - F.col("close"), F.lit(0.0)))})
    m = g.select("symbol", "d", W.ma("up", 14).alias("u"), W.ma("down", 14).alias("dn"), F.count("up").over(W.back(14)).alias("n"))
    strength = lambda dn: 100 - 100 / (1 + F.col("u") / dn)
    return m.select(
        "symbol", "d", r("rsi_loss_zero_100", F.when(F.col("n") == 14, F.when(F.col("dn") > 0, strength(F.when(F.col("dn") > 0, F.col("dn")))).otherwise(100.0))),
        r("rsi_loss_zero_1", F.when(F.col("n") == 14, strength(F.when(F.col("dn") == 0, 1.0).otherwise(F.col("dn"))))),
    )


@query(f"""WITH {daily()}, t AS (SELECT symbol, d, (high + low + close) / 3 AS tp FROM bars),
 w AS (SELECT symbol, d, tp, list(tp) {over(14)} AS xs, avg(tp) {over(14)} AS m FROM t)
 SELECT symbol, d, round(CASE WHEN len(xs) = 14 THEN (tp - m) / nullif(0.015 * list_avg(list_transform(xs, lambda x: abs(x - m))), 0) END, 4) AS cci FROM w""")
def cci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commodity channel index over 14 bars with the mean absolute deviation."""
    t = daily_bars(spark, sf_dir).select("symbol", "d", ((F.col("high") + F.col("low") + F.col("close")) / 3).alias("tp"))
    w = t.select("symbol", "d", "tp", F.collect_list("tp").over(W.back(14)).alias("xs"), W.ma("tp", 14).alias("m"))
    off = F.aggregate(F.transform("xs", lambda x: F.abs(x - F.col("m"))), F.lit(0.0), lambda a, x: a + x) / 14
    return w.select("symbol", "d", r("cci", F.when(F.size("xs") == 14, W.ratio(F.col("tp") - F.col("m"), 0.015 * off)), 4))


@query(f"""WITH {daily()}, t AS (SELECT symbol, d, high, low, close, greatest(high - low, coalesce(abs(high - lag(close) {over()}), 0), coalesce(abs(low - lag(close) {over()}), 0)) AS tr FROM bars)
 SELECT symbol, d, {rounded({"tr": "tr", "atr14": f"avg(tr) {over(14)}", "range14": f"avg(high - low) {over(14)}"})} FROM t""")
def atr_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True range, its simple mean, and the mean of the daily range."""
    leg = lambda x: F.coalesce(F.abs(F.col(x) - W.ref("close")), F.lit(0.0))
    t = daily_bars(spark, sf_dir).withColumn("tr", F.greatest(F.col("high") - F.col("low"), leg("high"), leg("low")))
    return t.select("symbol", "d", r("tr", "tr"), r("atr14", W.ma("tr", 14)), r("range14", W.ma(F.col("high") - F.col("low"), 14)))


@query(f"""WITH {daily()}, s AS (SELECT symbol, d, coalesce(sign(close - lag(close) {over()}), 0) * volume AS v FROM bars),
 o AS (SELECT symbol, d, sum(v) {UP_TO_NOW} AS obv FROM s) SELECT symbol, d, round(obv, 4) AS obv, round(avg(obv) {over(20)}, 4) AS obv20 FROM o""")
def on_balance_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = daily_bars(spark, sf_dir).select("symbol", "d", (F.coalesce(F.signum(F.col("close") - W.ref("close")), F.lit(0.0)) * F.col("volume")).alias("v"))
    o = s.select("symbol", "d", F.sum("v").over(W.so_far()).alias("obv"))
    return o.select("symbol", "d", r("obv", "obv", 4), r("obv20", W.ma("obv", 20), 4))


def _strict(n: int) -> str:
    return f"CASE WHEN count(*) {over(n)} = {n} THEN avg(close) {over(n)} END"


@query(f"""WITH {daily()}, b AS (SELECT symbol, d, close, (({_strict(3)}) + ({_strict(6)}) + ({_strict(12)}) + ({_strict(24)})) / 4 AS bbi FROM bars),
 x AS (SELECT *, CASE WHEN close > bbi AND lag(close) {over()} <= lag(bbi) {over()} THEN 1 WHEN close < bbi AND lag(close) {over()} >= lag(bbi) {over()} THEN -1 ELSE 0 END AS c FROM b)
 SELECT symbol, d, {rounded({"deviation": "(close - bbi) / nullif(bbi, 0) * 100", "slope": f"(bbi / nullif(lag(bbi, 9) {over()}, 0) - 1) * 100"})},
 CAST(sum(c) {over(5)} AS BIGINT) AS crossings FROM x""")
def bull_bear_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the strict 3, 6, 12 and 24-bar means, deviation from it, its slope over ten bars, crossings in five."""
    b = daily_bars(spark, sf_dir).select("symbol", "d", "close", ((W.sma("close", 3) + W.sma("close", 6) + W.sma("close", 12) + W.sma("close", 24)) / 4).alias("bbi"))
    up, down = W.cross("close", "bbi"), W.true((F.col("close") < F.col("bbi")) & (W.ref("close") >= W.ref("bbi")))
    x = b.withColumn("c", F.when(up, 1).when(down, -1).otherwise(0))
    return x.select("symbol", "d", r("deviation", W.ratio(F.col("close") - F.col("bbi"), "bbi") * 100), r("slope", W.change("bbi", 9)), W.total("c", 5).alias("crossings"))


def _sum26(x: str) -> str:
    return f"sum(greatest({x}, 0)) {over(26)}"


@query(f"""WITH {daily()}, p AS (SELECT *, lag(close) {over()} AS pc, count(*) {over(26)} AS n FROM bars),
 s AS (SELECT symbol, d, n, {_sum26("high - open")} AS a, {_sum26("open - low")} AS b, sum(CASE WHEN pc IS NULL THEN 0 ELSE greatest(high - pc, 0) END) {over(26)} AS c,
 sum(CASE WHEN pc IS NULL THEN 0 ELSE greatest(pc - low, 0) END) {over(26)} AS e FROM p)
 SELECT symbol, d, CASE WHEN n = 26 AND b > 0 THEN round(a / nullif(b, 0) * 100, 4) END AS ar, CASE WHEN n = 26 AND e > 0 THEN round(c / nullif(e, 0) * 100, 4) END AS br FROM s""")
def sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AR and BR over 26 bars; null where the divisor is zero."""
    plus = lambda x: W.total(F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0)), 26)
    pc = W.ref("close")
    b = daily_bars(spark, sf_dir).withColumn("pc", pc)
    s = b.select("symbol", "d", F.count(F.lit(1)).over(W.back(26)).alias("n"), plus(F.col("high") - F.col("open")).alias("a"), plus(F.col("open") - F.col("low")).alias("b"), plus(F.col("high") - F.col("pc")).alias("c"), plus(F.col("pc") - F.col("low")).alias("e"))
    part = lambda x, y: F.when((F.col("n") == 26) & (F.col(y) > 0), F.round(W.ratio(x, y) * 100, 4))
    return s.select("symbol", "d", part("a", "b").alias("ar"), part("c", "e").alias("br"))


@query(f"""WITH {daily()} SELECT symbol, d, {rounded({"v_ma5": f"volume / nullif(avg(volume) {over(5)}, 0)", "v_ma20": f"volume / nullif(avg(volume) {over(20)}, 0)",
 "ma5_ma20": f"avg(volume) {over(5)} / nullif(avg(volume) {over(20)}, 0)", "v_prior5": f"volume / nullif(avg(volume) {over(first=-5, last=-1)}, 0)",
 "vwap20_off": f"(close / nullif(sum(amount) {over(20)} / nullif(sum(volume) {over(20)}, 0), 0) - 1) * 100"})} FROM bars""")
def volume_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = daily_bars(spark, sf_dir)
    return b.select(
        "symbol", "d", r("v_ma5", W.ratio("volume", W.ma("volume", 5))), r("v_ma20", W.ratio("volume", W.ma("volume", 20))), r("ma5_ma20", W.ratio(W.ma("volume", 5), W.ma("volume", 20))),
        r("v_prior5", W.ratio("volume", F.avg("volume").over(W.ahead(-5, -1)))), r("vwap20_off", (W.ratio("close", W.ratio(W.total("amount", 20), W.total("volume", 20))) - 1) * 100),
    )


@query(f"""WITH {daily()}, f AS (SELECT symbol, d, CASE WHEN close > lag(close) {over()} THEN 1 WHEN close < lag(close) {over()} THEN -1 ELSE 0 END AS way FROM bars),
 g AS (SELECT *, CASE WHEN way = lag(way) {over()} THEN 0 ELSE 1 END AS new FROM f), i AS (SELECT *, sum(new) {UP_TO_NOW} AS island FROM g)
 SELECT symbol, d, way, row_number() OVER (PARTITION BY symbol, island ORDER BY d) AS streak FROM i""")
def streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of rising, falling and unchanged closes, by gaps and islands."""
    f = daily_bars(spark, sf_dir).select("symbol", "d", F.when(F.col("close") > W.ref("close"), 1).when(F.col("close") < W.ref("close"), -1).otherwise(0).alias("way"))
    g = f.withColumn("new", F.when(F.col("way") == W.ref("way"), 0).otherwise(1))
    i = g.withColumn("island", F.sum("new").over(W.so_far()))
    w = W.Window.partitionBy("symbol", "island").orderBy("d")
    return i.select("symbol", "d", "way", F.row_number().over(w).cast("long").alias("streak"))


@query(f"""WITH {daily()}, g AS (SELECT symbol, d, CASE WHEN low > lag(high) {over()} THEN 1 ELSE 0 END AS up, CASE WHEN high < lag(low) {over()} THEN 1 ELSE 0 END AS down,
 CASE WHEN open > lag(close) {over()} * 1.01::DOUBLE THEN 1 ELSE 0 END AS jump FROM bars)
 SELECT symbol, d, CAST(sum(up) {over(20)} AS BIGINT) AS gaps_up, CAST(sum(down) {over(20)} AS BIGINT) AS gaps_down, CAST(sum(jump) {over(20)} AS BIGINT) AS jumps FROM g""")
def gap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price gaps between neighbouring bars, counted over 20 bars."""
    g = daily_bars(spark, sf_dir).select("symbol", "d", W.true(F.col("low") > W.ref("high")).alias("up"), W.true(F.col("high") < W.ref("low")).alias("down"), W.true(F.col("open") > W.ref("close") * 1.01).alias("jump"))
    return g.select("symbol", "d", W.count_true(F.col("up"), 20).alias("gaps_up"), W.count_true(F.col("down"), 20).alias("gaps_down"), W.count_true(F.col("jump"), 20).alias("jumps"))


@query(f"""WITH {daily()} SELECT symbol, extract(isoyear FROM d) AS year, extract(week FROM d) AS week, max(d) AS d, round(arg_min(open, d), 6) AS open, round(max(high), 6) AS high,
 round(min(low), 6) AS low, round(arg_max(close, d), 6) AS close, sum(volume) AS volume, count(*) AS sessions FROM bars GROUP BY ALL HAVING count(*) >= 2""")
def bars_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = weekly_bars(daily_bars(spark, sf_dir))
    return w.select("symbol", F.col("year").cast("long").alias("year"), F.col("week").cast("long").alias("week"), "d", r("open", "open"), r("high", "high"), r("low", "low"), r("close", "close"), "volume", "sessions")


@query(f"""WITH {daily()}, k AS (SELECT *, (row_number() {over()} - 1) // 5 AS bucket FROM bars)
 SELECT symbol, bucket, min(d) AS d, round(arg_min(open, d), 6) AS open, round(max(high), 6) AS high, round(min(low), 6) AS low, round(arg_max(close, d), 6) AS close, sum(volume) AS volume FROM k GROUP BY ALL""")
def bars_of_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = counted_bars(daily_bars(spark, sf_dir), 5)
    return k.select("symbol", "bucket", "d", r("open", "open"), r("high", "high"), r("low", "low"), r("close", "close"), "volume")


@query("""SELECT event_type AS symbol, time_bucket(INTERVAL '1 hour', ts) AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
 arg_max(value, (ts, event_id)) AS close, round(sum(value), 4) AS amount, count(*) AS n FROM events GROUP BY ALL""")
def bars_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_bars(table(spark, sf_dir, "events")).withColumn("amount", F.round("amount", 4))


def _fold_sql(columns: dict[str, tuple[str, float]], source: str) -> str:
    """A recursive CTE for y = a x + (1 - a) y over source(symbol, d, rn, columns)."""
    first = ", ".join(f"{c} AS {n}" for n, (c, _) in columns.items())
    step = ", ".join(f"{a!r}::DOUBLE * x.{c} + {1.0 - a!r}::DOUBLE * y.{n}" for n, (c, a) in columns.items())
    return f"""y AS (SELECT symbol, rn, d, {first} FROM {source} WHERE rn = 1
 UNION ALL SELECT x.symbol, x.rn, x.d, {step} FROM y JOIN {source} x ON x.symbol = y.symbol AND x.rn = y.rn + 1)"""


EMAS = {"ema5": ("close", R.ema_alpha(5)), "ema12": ("close", R.ema_alpha(12)), "ema26": ("close", R.ema_alpha(26)), "wilder14": ("close", 1 / 14)}


@query(f"WITH RECURSIVE {daily()}, x AS (SELECT *, row_number() {over()} AS rn FROM bars), {_fold_sql(EMAS, 'x')} SELECT symbol, d, {rounded({n: n for n in EMAS})} FROM y")
def exponential_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponential means of several spans and Wilder's mean in one fold."""
    out = R.exponential(daily_bars(spark, sf_dir), EMAS)
    return out.select("symbol", "d", *[r(n, n) for n in EMAS])


@query(f"""WITH RECURSIVE {daily()}, x AS (SELECT *, row_number() {over()} AS rn FROM bars),
 {_fold_sql({"f": ("close", R.ema_alpha(12)), "g": ("close", R.ema_alpha(26))}, "x")}, z AS (SELECT symbol, d, rn, f - g AS dif FROM y),
 s AS (SELECT symbol, rn, d, dif, dif AS dea FROM z WHERE rn = 1 UNION ALL
 SELECT z.symbol, z.rn, z.d, z.dif, {R.ema_alpha(9)!r}::DOUBLE * z.dif + {1.0 - R.ema_alpha(9)!r}::DOUBLE * s.dea FROM s JOIN z ON z.symbol = s.symbol AND z.rn = s.rn + 1)
 SELECT symbol, d, {rounded({"dif": "dif", "dea": "dea", "macd": "2 * (dif - dea)"})} FROM s""")
def macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.macd(daily_bars(spark, sf_dir))
    return out.select("symbol", "d", r("dif", "dif"), r("dea", "dea"), r("macd", "macd"))


@query(f"""WITH RECURSIVE {daily()}, h AS (SELECT symbol, d, close, min(low) {over(9)} AS lo, max(high) {over(9)} AS hi, row_number() {over()} AS rn FROM bars),
 x AS (SELECT symbol, d, rn, CASE WHEN hi > lo THEN (close - lo) / (hi - lo) * 100 ELSE 50 END AS rsv FROM h),
 k AS (SELECT symbol, rn, d, {1 - 1 / 3!r}::DOUBLE * 50 + {1 / 3!r}::DOUBLE * rsv AS k, {1 - 1 / 3!r}::DOUBLE * 50 + {1 / 3!r}::DOUBLE * ({1 - 1 / 3!r}::DOUBLE * 50 + {1 / 3!r}::DOUBLE * rsv) AS e FROM x WHERE rn = 1
 UNION ALL SELECT x.symbol, x.rn, x.d, {1 - 1 / 3!r}::DOUBLE * k.k + {1 / 3!r}::DOUBLE * x.rsv, {1 - 1 / 3!r}::DOUBLE * k.e + {1 / 3!r}::DOUBLE * ({1 - 1 / 3!r}::DOUBLE * k.k + {1 / 3!r}::DOUBLE * x.rsv)
 FROM k JOIN x ON x.symbol = k.symbol AND x.rn = k.rn + 1)
 SELECT symbol, d, {rounded({"k": "k", "d_line": "e", "j": "3 * k - 2 * e"})} FROM k""")
def stochastic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K, D and J of nine bars, means that start from 50; a bar without range counts as the middle."""
    h = daily_bars(spark, sf_dir).withColumns({"lo": W.lowest("low", 9), "hi": W.highest("high", 9)})
    rsv = h.select("symbol", "d", F.when(F.col("hi") > F.col("lo"), W.ratio(F.col("close") - F.col("lo"), F.col("hi") - F.col("lo")) * 100).otherwise(50.0).alias("rsv"))
    out = R.stochastic(rsv)
    return out.select("symbol", "d", r("k", "k"), r("d_line", "d_line"), r("j", "j"))


@query(f"""WITH RECURSIVE {daily()}, x AS (SELECT symbol, d, close, row_number() {over()} AS rn FROM bars),
 z AS (SELECT symbol, rn, d, 0 AS direction, close AS extreme FROM x WHERE rn = 1 UNION ALL
 SELECT x.symbol, x.rn, x.d, CASE WHEN z.direction >= 0 AND x.close <= z.extreme * 0.95::DOUBLE THEN -1 WHEN z.direction <= 0 AND x.close >= z.extreme * 1.05::DOUBLE THEN 1 ELSE z.direction END,
 CASE WHEN (z.direction >= 0 AND x.close <= z.extreme * 0.95::DOUBLE) OR (z.direction <= 0 AND x.close >= z.extreme * 1.05::DOUBLE) THEN x.close
 WHEN z.direction > 0 THEN greatest(z.extreme, x.close) WHEN z.direction < 0 THEN least(z.extreme, x.close) ELSE z.extreme END
 FROM z JOIN x ON x.symbol = z.symbol AND x.rn = z.rn + 1) SELECT symbol, d, direction, round(extreme, 6) AS extreme FROM z""")
def zigzag(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.zigzag(daily_bars(spark, sf_dir))
    return out.select("symbol", "d", "direction", r("extreme", "extreme"))


@query(f"""WITH {daily()} SELECT symbol, d, high = max(high) {over(first=-15, last=15)} AS swing_high, low = min(low) {over(first=-15, last=15)} AS swing_low FROM bars""")
def swing_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars whose high (low) is the extreme of the 15 bars before and after."""
    b = daily_bars(spark, sf_dir)
    around = W.ahead(-15, 15)
    return b.select("symbol", "d", (F.col("high") == F.max("high").over(around)).alias("swing_high"), (F.col("low") == F.min("low").over(around)).alias("swing_low"))


@query(f"""WITH {daily()}, m AS (SELECT d, avg(close) AS market FROM bars GROUP BY d), j AS (SELECT symbol, d, close / lag(close) {over()} - 1 AS x, market / lag(market) {over()} - 1 AS y FROM bars JOIN m USING (d))
 SELECT symbol, {rounded({"correlation": "corr(x, y)", "beta": "covar_samp(x, y) / var_samp(y)", "idiosyncratic": "1 - corr(x, y) * corr(x, y)", "slope": "regr_slope(x, y)", "r2": "regr_r2(x, y)"})}
 FROM j WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY symbol""")
def market_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation, beta, idiosyncratic share and regression of daily changes on the equal-weight market."""
    b = daily_bars(spark, sf_dir).select("symbol", "d", "close")
    m = b.groupBy("d").agg(F.avg("close").alias("market"))
    j = b.join(m, "d").select("symbol", (W.ratio("close", W.ref("close")) - 1).alias("x"), (W.ratio("market", W.ref("market")) - 1).alias("y")).where("x is not null and y is not null")
    return j.groupBy("symbol").agg(
        r("correlation", F.corr("x", "y")), r("beta", F.covar_samp("x", "y") / F.var_samp("y")), r("idiosyncratic", 1 - F.corr("x", "y") * F.corr("x", "y")),
        r("slope", F.regr_slope("x", "y")), r("r2", F.regr_r2("x", "y")),
    )
