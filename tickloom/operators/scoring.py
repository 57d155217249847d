"""Scorers, forward labels, calibration and the cross-sectional scoring pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.bars import daily_bars
from tickloom.functions import recursive as R
from tickloom.functions import windows as W
from tickloom.operators.rolling import SQL as ROLLING_SQL
from tickloom.operators.rolling import r
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


def _case(x: str, steps: list[tuple[float, float]], rest: float) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL " + " ".join(f"WHEN {x} < {b!r}::DOUBLE THEN {v!r}::DOUBLE" for b, v in steps) + f" ELSE {rest!r}::DOUBLE END"


# Bounds and points of the score ladders
RSI_STEPS, RSI_REST = [(25.0, 4.0), (35.0, 3.0), (45.0, 1.5), (55.0, 0.0), (65.0, -1.0), (75.0, -2.5)], -4.0
BULL_STEPS, BULL_REST = [(0.25, -3.0), (0.40, -1.0), (0.55, 1.0), (0.70, 2.0)], 3.0


def volume_score(x: Column) -> Column:
    """Points of a volume ratio: moderate growth is best, extremes are bad."""
    return F.when((x > 1.5) & (x <= 2.5), 7.0).when((x >= 0.8) & (x <= 1.5), 2.0).when((x > 2.5) & (x <= 4), -1.0).when((x >= 0.5) & (x < 0.8), -2.0).when(x > 4, -5.0).otherwise(-6.0)


_VOLUME = "CASE WHEN {x} > 1.5 AND {x} <= 2.5 THEN 7.0::DOUBLE WHEN {x} >= 0.8::DOUBLE AND {x} <= 1.5 THEN 2 WHEN {x} > 2.5 AND {x} <= 4 THEN -1 WHEN {x} >= 0.5 AND {x} < 0.8::DOUBLE THEN -2 WHEN {x} > 4 THEN -5 ELSE -6 END"


@query(f"""WITH {daily()}, s AS (SELECT symbol, d, volume / nullif(avg(volume) {over(20)}, 0) AS vr, count(*) {over(20)} AS n FROM bars) SELECT symbol, d, round(vr, 6) AS vr, {_VOLUME.format(x='vr')} AS score FROM s WHERE n = 20""")
def score_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = daily_bars(spark, sf_dir).select("symbol", "d", W.ratio("volume", W.ma("volume", 20)).alias("vr"), F.count(F.lit(1)).over(W.back(20)).alias("n")).where("n = 20")
    return s.select("symbol", "d", r("vr", "vr"), volume_score(F.col("vr")).alias("score"))


@query(f"""WITH {daily()}, a AS (SELECT *, CASE WHEN close > open THEN 1.0::DOUBLE ELSE 0 END AS bull, abs(close - open) / CASE WHEN high = low THEN 0.01::DOUBLE ELSE high - low END AS br, row_number() {over()} AS rn FROM bars),
 s AS (SELECT symbol, d, close, rn, avg(bull) {over(20)} AS bulls, avg(br) {over(5)} AS body, max(high) {over(20)} AS h, min(low) {over(20)} AS l, coalesce(last_value(CASE WHEN bull = 0 THEN rn END IGNORE NULLS) {UP_TO_NOW}, 0) AS last_bear FROM a)
 SELECT symbol, d, round(greatest(least(({_case('bulls', BULL_STEPS, BULL_REST)}) + CASE WHEN body > 0.7::DOUBLE THEN 2.5 WHEN body > 0.5 THEN 2 WHEN body > 0.3::DOUBLE THEN 1 WHEN body > 0.15::DOUBLE THEN -1.5 ELSE -3 END
 + CASE WHEN close >= h * 0.98::DOUBLE THEN 2.5 WHEN close >= h * 0.93::DOUBLE THEN 1.5 WHEN close >= h * 0.85::DOUBLE THEN 0.5 WHEN close <= l * 1.05::DOUBLE THEN -3.5 ELSE 0 END + least(2, (rn - last_bear) * 0.5), 10), -10), 4) AS score FROM s WHERE rn >= 20""")
def score_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of rising bars, size of bodies, place in the 20-bar range, streak of rising bars."""
    bull = F.col("close") > F.col("open")
    size = F.when(F.col("high") == F.col("low"), 0.01).otherwise(F.col("high") - F.col("low"))
    a = daily_bars(spark, sf_dir).withColumns({"bull": bull.cast("double"), "br": F.abs(F.col("close") - F.col("open")) / size, "rn": W.row()})
    s = a.select("symbol", "d", "close", "rn", W.ma("bull", 20).alias("bulls"), W.ma("br", 5).alias("body"), W.highest("high", 20).alias("h"), W.lowest("low", 20).alias("l"), F.coalesce(F.last(F.when(F.col("bull") == 0, F.col("rn")), ignorenulls=True).over(W.so_far()), F.lit(0)).alias("last_bear"))
    body, close = F.col("body"), F.col("close")
    points = W.ladder(F.col("bulls"), BULL_STEPS, BULL_REST) + F.when(body > 0.7, 2.5).when(body > 0.5, 2.0).when(body > 0.3, 1.0).when(body > 0.15, -1.5).otherwise(-3.0)
    points = points + F.when(close >= F.col("h") * 0.98, 2.5).when(close >= F.col("h") * 0.93, 1.5).when(close >= F.col("h") * 0.85, 0.5).when(close <= F.col("l") * 1.05, -3.5).otherwise(0.0)
    points = points + F.least(F.lit(2.0), (F.col("rn") - F.col("last_bear")) * 0.5)
    return s.where("rn >= 20").select("symbol", "d", r("score", W.clip(points, -10, 10), 4))


_RSI = ROLLING_SQL["rsi_simple"].split("SELECT symbol, d, round(")[0]


@query(f"""{_RSI}, b AS (SELECT symbol, d, (close - avg(close) {over(20)}) / nullif(stddev_samp(close) {over(20)}, 0) AS z, avg(volume) {over(5)} / nullif(avg(volume) {over(20)}, 0) AS vr, row_number() {over()} AS rn FROM bars),
 x AS (SELECT b.*, CASE WHEN m.n < 14 THEN NULL WHEN m.dn > 0 THEN 100 - 100 / (1 + m.u / m.dn) ELSE 100 END AS rsi FROM b JOIN m USING (symbol, d))
 SELECT symbol, d, {_case('rsi', RSI_STEPS, RSI_REST)} AS rsi_points, CASE WHEN z > -2 AND z < -1 THEN 2.5::DOUBLE WHEN z >= -1 AND z < -0.3::DOUBLE THEN 1.5 WHEN z >= -0.3::DOUBLE AND z <= 0.3::DOUBLE THEN 0 WHEN z > 0.3::DOUBLE AND z <= 1 THEN -1 WHEN z > 1 AND z <= 2 THEN -2 ELSE -3 END AS band_points,
 CASE WHEN vr > 1.5 AND vr <= 2.5 THEN 2.5::DOUBLE WHEN vr > 1 AND vr <= 1.5 THEN 1.5 WHEN vr >= 0.8::DOUBLE AND vr <= 1 THEN 0 WHEN vr >= 0.5 AND vr < 0.8::DOUBLE THEN -1 WHEN vr > 4 THEN -2.5 WHEN vr < 0.3::DOUBLE THEN -3 ELSE -1.5 END AS volume_points FROM x WHERE rn >= 20""")
def score_technical_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of relative strength, place in the Bollinger bands and volume trend."""
    up, down = F.col("close") - W.ref("close"), W.ref("close") - F.col("close")
    zero = F.lit(0.0)
    b = daily_bars(spark, sf_dir).withColumns({"up": F.when(up.isNotNull(), F.greatest(up, zero)), "down": F.when(down.isNotNull(), F.greatest(down, zero)), "rn": W.row()})
    x = b.select("symbol", "d", "rn", W.ma("up", 14).alias("u"), W.ma("down", 14).alias("dn"), W.ratio(F.col("close") - W.ma("close", 20), W.std("close", 20)).alias("z"), W.ratio(W.ma("volume", 5), W.ma("volume", 20)).alias("vr")).where("rn >= 20")
    rsi = F.when(F.col("dn") > 0, 100 - 100 / (1 + W.ratio("u", "dn"))).otherwise(100.0)
    z, v = F.col("z"), F.col("vr")
    band = F.when((z > -2) & (z < -1), 2.5).when((z >= -1) & (z < -0.3), 1.5).when((z >= -0.3) & (z <= 0.3), 0.0).when((z > 0.3) & (z <= 1), -1.0).when((z > 1) & (z <= 2), -2.0).otherwise(-3.0)
    flow = F.when((v > 1.5) & (v <= 2.5), 2.5).when((v > 1) & (v <= 1.5), 1.5).when((v >= 0.8) & (v <= 1), 0.0).when((v >= 0.5) & (v < 0.8), -1.0).when(v > 4, -2.5).when(v < 0.3, -3.0).otherwise(-1.5)
    return x.select("symbol", "d", W.ladder(rsi, RSI_STEPS, RSI_REST).alias("rsi_points"), band.alias("band_points"), flow.alias("volume_points"))


@query(f"""WITH RECURSIVE {daily()}, x AS (SELECT *, row_number() {over()} AS rn FROM bars), y AS (SELECT symbol, rn, d, close AS e1, close AS e2, close AS e3 FROM x WHERE rn = 1
 UNION ALL SELECT x.symbol, x.rn, x.d, {", ".join(f"{R.ema_alpha(n)!r}::DOUBLE * x.close + {1.0 - R.ema_alpha(n)!r}::DOUBLE * y.e{k}" for k, n in ((1, 8), (2, 21), (3, 55)))} FROM y JOIN x ON x.symbol = y.symbol AND x.rn = y.rn + 1)
 SELECT y.symbol, y.d, round((x.close / e2 - 1) * 100, 6) AS deviation, CASE WHEN e1 > e2 AND e2 > e3 THEN 30 WHEN e1 > e2 OR e2 > e3 THEN 15 ELSE 0 END AS alignment FROM y JOIN x ON x.symbol = y.symbol AND x.rn = y.rn""")
def score_mean_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviation from and alignment of exponential means, all of them from one fold."""
    b = daily_bars(spark, sf_dir)
    e = R.exponential(b, {"e1": ("close", R.ema_alpha(8)), "e2": ("close", R.ema_alpha(21)), "e3": ("close", R.ema_alpha(55)), "close": ("close", 1.0)})
    up1, up2 = F.col("e1") > F.col("e2"), F.col("e2") > F.col("e3")
    return e.select("symbol", "d", r("deviation", (W.ratio("close", "e2") - 1) * 100), F.when(up1 & up2, 30).when(up1 | up2, 15).otherwise(0).alias("alignment"))


@query(f"""WITH {daily()}, x AS (SELECT symbol, d, row_number() {over()} AS day, (max(high) {over(first=1, last=60)} / nullif(close, 0) - 1) * 100 AS peak, (min(low) {over(first=1, last=60)} / nullif(close, 0) - 1) * 100 AS drawdown,
 (last_value(close) {over(first=1, last=60)} / nullif(close, 0) - 1) * 100 AS final FROM bars)
 SELECT symbol, d, {rounded({"peak": "peak", "drawdown": "drawdown", "final": "final"})}, CASE WHEN peak >= 80 THEN 'major_rally' WHEN peak >= 30 THEN 'strong' WHEN peak <= -15 THEN 'fail' ELSE 'normal' END AS label FROM x WHERE day > 60 AND peak IS NOT NULL""")
def label_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peak, drawdown and end of the 60 sessions ahead, and their class; short frames at the end count."""
    after = W.ahead(1, 60)
    against = lambda x: (W.ratio(x, "close") - 1) * 100
    x = daily_bars(spark, sf_dir).select("symbol", "d", W.row().alias("day"), against(F.max("high").over(after)).alias("peak"), against(F.min("low").over(after)).alias("drawdown"), against(F.last("close").over(after)).alias("final"))
    peak = F.col("peak")
    label = F.when(peak >= 80, "major_rally").when(peak >= 30, "strong").when(peak <= -15, "fail").otherwise("normal")
    return x.where("day > 60 and peak is not null").select("symbol", "d", r("peak", "peak"), r("drawdown", "drawdown"), r("final", "final"), label.alias("label"))


@query(f"""WITH {daily()}, m AS (SELECT d, avg(close) AS market FROM bars GROUP BY 1), c AS (SELECT d, market, row_number() OVER (ORDER BY d) AS n FROM m),
 e AS (SELECT a.d, (z.market / nullif(s.market, 0) - 1) * 100 AS bench FROM c a JOIN c s ON s.n = a.n + 1 JOIN c z ON z.n = a.n + 5),
 y AS (SELECT symbol, d, (lead(close, 5) {over()} / nullif(close, 0) - 1) * 100 AS own FROM bars)
 SELECT symbol, d, round(own - bench, 6) AS excess, CASE WHEN own - bench >= 5 THEN 'great' WHEN own - bench >= 0 THEN 'good' WHEN own - bench >= -2 THEN 'flat' WHEN own - bench >= -5 THEN 'weak' ELSE 'bad' END AS outcome FROM y JOIN e USING (d) WHERE own IS NOT NULL""")
def label_excess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change over five bars beyond the market's, whose base is the first session after the bar; and its class."""
    b = daily_bars(spark, sf_dir)
    calendar = Window.orderBy("d")  # one row a day
    m = b.groupBy("d").agg(F.avg("close").alias("market"))
    e = m.select("d", ((W.ratio(F.lead("market", 5).over(calendar), F.lead("market", 1).over(calendar)) - 1) * 100).alias("bench")).where("bench is not null")
    y = b.select("symbol", "d", ((W.ratio(F.lead("close", 5).over(W.by_time()), "close") - 1) * 100).alias("own")).where("own is not null").join(e, "d")
    x = F.col("own") - F.col("bench")
    outcome = F.when(x >= 5, "great").when(x >= 0, "good").when(x >= -2, "flat").when(x >= -5, "weak").otherwise("bad")
    return y.select("symbol", "d", r("excess", x), outcome.alias("outcome"))


@query(f"""WITH {daily()}, s AS (SELECT symbol, d, close, coalesce(close > max(close) {over(first=-20, last=-1)}, false) AS fired, lead(close) {over()} AS c1, lead(close, 5) {over()} AS c5, max(high) {over(first=1, last=5)} AS top, min(low) {over(first=1, last=5)} AS bottom,
 max(high) {over(20)} AS zone_high, min(low) {over(20)} AS zone_low FROM bars),
 p AS (SELECT *, count(*) OVER (PARTITION BY symbol ORDER BY d RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS pushes FROM s WHERE fired)
 SELECT symbol, d, pushes, {rounded({"ret1": "(c1 / nullif(close, 0) - 1) * 100", "ret5": "(c5 / nullif(close, 0) - 1) * 100", "max_gain": "(top / nullif(close, 0) - 1) * 100", "max_loss": "(bottom / nullif(close, 0) - 1) * 100", "zone_width": "(zone_high / nullif(zone_low, 0) - 1) * 100"})} FROM p""")
def label_signal_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New 20-bar highs with the pushes of the 30 days before, results after 1 and 5 bars, best and worst of five, price zone."""
    s = daily_bars(spark, sf_dir).select(
        "symbol", "d", "close", W.true(F.col("close") > F.max("close").over(W.ahead(-20, -1))).alias("fired"), F.lead("close").over(W.by_time()).alias("c1"), F.lead("close", 5).over(W.by_time()).alias("c5"),
        F.max("high").over(W.ahead(1, 5)).alias("top"), F.min("low").over(W.ahead(1, 5)).alias("bottom"), W.highest("high", 20).alias("zone_high"), W.lowest("low", 20).alias("zone_low"),
    ).where("fired")
    days = Window.partitionBy("symbol").orderBy(F.datediff("d", F.lit("1970-01-01"))).rangeBetween(-30, -1)
    p = s.withColumn("pushes", F.count(F.lit(1)).over(days))
    pct = lambda n, a, b: r(n, (W.ratio(a, b) - 1) * 100)
    return p.select("symbol", "d", "pushes", pct("ret1", "c1", "close"), pct("ret5", "c5", "close"), pct("max_gain", "top", "close"), pct("max_loss", "bottom", "close"), pct("zone_width", "zone_high", "zone_low"))


@query(f"""WITH {daily()}, f AS (SELECT symbol, floor((close / nullif(lag(close, 5) {over()}, 0) - 1) * 20) * 5 AS bucket, (lead(close, 5) {over()} / nullif(close, 0) - 1) * 100 AS ret FROM bars),
 b AS (SELECT symbol, bucket, count(*) AS n, avg(CASE WHEN ret > 0 THEN 1.0::DOUBLE ELSE 0 END) AS win FROM f WHERE bucket IS NOT NULL AND ret IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 10),
 l AS (SELECT *, lag(win) OVER (PARTITION BY symbol ORDER BY bucket) AS before FROM b)
 SELECT symbol, bucket, n, round(win, 6) AS win_rate, round(greatest(least((n * win + 10 * 0.5::DOUBLE) / (n + 10), 0.78::DOUBLE), 0.05::DOUBLE), 6) AS calibrated, bool_and(coalesce(win >= before, true)) OVER (PARTITION BY symbol) AS monotone FROM l""")
def calibrate_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Win rates of score buckets by group, shrunk to one half and clamped, and whether they rise throughout."""
    f = daily_bars(spark, sf_dir).select("symbol", (F.floor((W.ratio("close", W.ref("close", 5)) - 1) * 20) * 5).cast("double").alias("bucket"), ((W.ratio(F.lead("close", 5).over(W.by_time()), "close") - 1) * 100).alias("ret"))
    b = f.where("bucket is not null and ret is not null").groupBy("symbol", "bucket").agg(F.count("*").alias("n"), F.avg((F.col("ret") > 0).cast("double")).alias("win")).where("n >= 10")
    w = Window.partitionBy("symbol")
    rises = F.coalesce(F.col("win") >= F.lag("win").over(w.orderBy("bucket")), F.lit(True))
    l = b.withColumn("rises", rises)
    return l.select("symbol", "bucket", "n", r("win_rate", "win"), r("calibrated", W.clip((F.col("n") * F.col("win") + 5.0) / (F.col("n") + 10), 0.05, 0.78)), F.bool_and("rises").over(w).alias("monotone"))


_DIMS = {"a": 2.0, "b": 1.0, "c": 0.5}


@query("""WITH s AS (SELECT c_custkey AS id, c_mktsegment AS archetype, CASE WHEN c_acctbal >= 0 THEN c_acctbal / 1000 END AS a, CASE WHEN c_nationkey % 4 > 0 THEN CAST(c_nationkey % 11 AS DOUBLE) END AS b, CAST(c_custkey % 11 AS DOUBLE) AS c FROM customer),
 t AS (SELECT *, 10 * (coalesce(a * 2, 0) + coalesce(b, 0) + coalesce(c * 0.5::DOUBLE, 0)) / (CASE WHEN a IS NULL THEN 0 ELSE 2.0::DOUBLE END + CASE WHEN b IS NULL THEN 0 ELSE 1 END + CASE WHEN c IS NULL THEN 0 ELSE 0.5::DOUBLE END) AS raw FROM s),
 g AS (SELECT *, count(*) OVER w AS n, min(raw) OVER w AS lo, max(raw) OVER w AS hi, avg(raw) OVER w AS m, stddev_pop(raw) OVER w AS sd FROM t WINDOW w AS (PARTITION BY archetype))
 SELECT id, archetype, round(raw, 6) AS raw_total, round(CASE WHEN n = 1 THEN greatest(least(raw, 100), 0) WHEN hi - lo <= 0.01::DOUBLE THEN 50 WHEN n <= 4 THEN (raw - m) / nullif(sd, 0) * 15 + 50 ELSE (raw - lo) / nullif(hi - lo, 0) * 100 END, 6) AS composite FROM g""")
def scoring_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted mean over the dimensions that are present, normalised within the archetype.

    The group's count, extremes and moments are aggregated with partial sums and joined back, so an archetype that
    holds a third of all rows is never gathered in one task.
    """
    s = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("archetype"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal") / 1000).alias("a"),
        F.when(F.col("c_nationkey") % 4 > 0, (F.col("c_nationkey") % 11).cast("double")).alias("b"), (F.col("c_custkey") % 11).cast("double").alias("c"),
    )
    parts = sum(F.coalesce(F.col(x) * w, F.lit(0.0)) for x, w in _DIMS.items())
    weights = sum(F.when(F.col(x).isNull(), 0.0).otherwise(w) for x, w in _DIMS.items())
    t = s.select("id", "archetype", (10 * parts / weights).alias("raw"))
    g = t.groupBy("archetype").agg(F.count("*").alias("n"), F.min("raw").alias("lo"), F.max("raw").alias("hi"), F.avg("raw").alias("m"), F.stddev_pop("raw").alias("sd"))
    x, span = F.col("raw"), F.col("hi") - F.col("lo")
    score = F.when(F.col("n") == 1, W.clip(x, 0, 100)).when(span <= 0.01, 50.0).when(F.col("n") <= 4, W.ratio(x - F.col("m"), "sd") * 15 + 50).otherwise(W.ratio(x - F.col("lo"), span) * 100)
    return t.join(g, "archetype").select("id", "archetype", r("raw_total", "raw"), r("composite", score))


@query("""WITH s AS (SELECT c_custkey AS id, c_mktsegment AS archetype, 90 + c_acctbal / 1000 AS score FROM customer), k AS (SELECT *, row_number() OVER (PARTITION BY archetype ORDER BY score DESC, id) - 1 AS place FROM s WHERE score >= 98)
 SELECT id, round(greatest(score - 0.8::DOUBLE * place, 85), 6) AS score FROM k UNION ALL SELECT id, round(score, 6) FROM s WHERE score < 98""")
def spread_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores from 98 on are spread by their rank, down to 85."""
    s = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("archetype"), (90 + F.col("c_acctbal") / 1000).alias("score"))
    # from the 20th on all are at 85, so no more ranks are needed: tasks keep 20 of a group before they send any on
    w = Window.partitionBy("archetype").orderBy(F.desc("score"), "id")
    best = s.where("score >= 98").withColumn("place", F.row_number().over(w)).where("place <= 20").select("id", "place")
    top = s.where("score >= 98").join(best, "id", "left")
    top = top.select("id", r("score", F.greatest(F.col("score") - 0.8 * (F.coalesce("place", F.lit(20)) - 1), F.lit(85.0))))
    return top.unionByName(s.where("score < 98").select("id", r("score", "score")))


@query(f"""WITH {daily()}, k AS (SELECT symbol, d, close, avg(close) {over(5)} AS m5, avg(close) {over(10)} AS m10, avg(close) {over(20)} AS m20, min(low) {over(60)} AS low60, max(close) {over(first=-20, last=-1)} AS high20, volume / nullif(avg(volume) {over(first=-5, last=-1)}, 0) AS vr,
 (close / nullif(lag(close, 5) {over()}, 0) - 1) * 100 AS momentum, row_number() OVER (PARTITION BY symbol ORDER BY d DESC) AS age FROM bars),
 c AS (SELECT *, m5 > m10 AND m10 > m20 AS aligned, (close / nullif(low60, 0) - 1) * 100 AS dist_low, coalesce(close > high20, false) AS breakout FROM k WHERE age = 1)
 SELECT symbol, d, aligned, breakout, {rounded({"dist_low": "dist_low", "vr": "vr", "momentum": "momentum", "composite": "greatest(least(25 + 1.5::DOUBLE * coalesce(momentum, 0) + 1.5::DOUBLE * (15 - dist_low) + 5 * coalesce(vr, 1) + CASE WHEN breakout THEN 30 ELSE 0 END, 100), 0)"})} FROM c""")
def latest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest bar of every symbol with alignment of means, distance from the low, breakout, volume and composite score."""
    newest = Window.partitionBy("symbol").orderBy(F.desc("d"))
    k = daily_bars(spark, sf_dir).select(
        "symbol", "d", "close", W.ma("close", 5).alias("m5"), W.ma("close", 10).alias("m10"), W.ma("close", 20).alias("m20"), W.lowest("low", 60).alias("low60"),
        F.max("close").over(W.ahead(-20, -1)).alias("high20"), W.ratio("volume", F.avg("volume").over(W.ahead(-5, -1))).alias("vr"), W.change("close", 5).alias("momentum"), F.row_number().over(newest).alias("age"),
    ).where("age = 1")
    c = k.withColumns({"dist_low": (W.ratio("close", "low60") - 1) * 100, "breakout": W.true(F.col("close") > F.col("high20"))})
    score = 25 + 1.5 * F.coalesce("momentum", F.lit(0.0)) + 1.5 * (15 - F.col("dist_low")) + 5 * F.coalesce("vr", F.lit(1.0)) + F.when(F.col("breakout"), 30).otherwise(0)
    return c.select("symbol", "d", ((F.col("m5") > F.col("m10")) & (F.col("m10") > F.col("m20"))).alias("aligned"), "breakout", r("dist_low", "dist_low"), r("vr", "vr"), r("momentum", "momentum"), r("composite", W.clip(score, 0, 100)))
