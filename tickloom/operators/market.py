"""Market, sector and flow analytics: breadth, regimes, trends, consensus, concentration, price zones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.bars import daily_bars, trades
from tickloom.functions import windows as W
from tickloom.operators.rolling import r
from tickloom.plans.sql import daily, over, rounded
from tickloom.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query(f"""WITH {daily()}, x AS (SELECT symbol, d, close > lag(close) {over()} AS up, close < lag(close) {over()} AS down, close > avg(close) {over(20)} AS above, close > max(close) {over(first=-60, last=-1)} AS new_high, close < min(close) {over(first=-60, last=-1)} AS new_low FROM bars)
 SELECT d, count(*) AS n, count(*) FILTER (WHERE up) AS up, count(*) FILTER (WHERE down) AS down, count(*) FILTER (WHERE above) AS above, count(*) FILTER (WHERE new_high) AS highs, count(*) FILTER (WHERE new_low) AS lows,
 round(count(*) FILTER (WHERE up) * 100.0::DOUBLE / count(*), 6) AS advance FROM x GROUP BY d""")
def market_breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rising and falling symbols, those above their mean, new highs and lows, by day."""
    c, before = F.col("close"), W.ahead(-60, -1)
    x = daily_bars(spark, sf_dir).select("d", (c > W.ref("close")).alias("up"), (c < W.ref("close")).alias("down"), (c > W.ma("close", 20)).alias("above"), (c > F.max("close").over(before)).alias("high"), (c < F.min("close").over(before)).alias("low"))
    out = x.groupBy("d").agg(F.count("*").alias("n"), F.count_if("up").alias("up"), F.count_if("down").alias("down"), F.count_if("above").alias("above"), F.count_if("high").alias("highs"), F.count_if("low").alias("lows"))
    return out.withColumn("advance", F.round(F.col("up") * 100.0 / F.col("n"), 6))


@query(f"""WITH {daily()}, m AS (SELECT d, avg(close) AS close, sum(amount) AS turnover FROM bars GROUP BY 1), s AS (SELECT d, close, avg(close) OVER w5 AS m5, avg(close) OVER w20 AS m20, avg(close) OVER w60 AS m60, lag(close, 10) OVER (ORDER BY d) AS c10,
 avg(turnover) OVER w5 AS t5, avg(turnover) OVER (ORDER BY d ROWS BETWEEN 9 PRECEDING AND 5 PRECEDING) AS t5p FROM m WINDOW w5 AS (ORDER BY d ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), w20 AS (ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), w60 AS (ORDER BY d ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
 SELECT d, CASE WHEN close > m5 AND m5 > m20 AND m20 > m60 THEN 'strong_up' WHEN close > m20 AND m20 > m60 THEN 'up' WHEN close < m5 AND m5 < m20 AND m20 < m60 THEN 'strong_down' WHEN close < m20 AND m20 < m60 THEN 'down' ELSE 'range' END AS regime,
 CASE WHEN c10 IS NULL THEN 'range' WHEN close > c10 * 1.01::DOUBLE THEN 'bull' WHEN close < c10 * 0.99::DOUBLE THEN 'bear' ELSE 'range' END AS phase, round(t5 / nullif(t5p, 0), 6) AS turnover_trend FROM s""")
def market_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regime by the order of the market's means, phase by its change over ten days, trend of the turnover.

    Bars are aggregated to one row a day before the windows, which then run over the calendar only.
    """
    m = daily_bars(spark, sf_dir).groupBy("d").agg(F.avg("close").alias("close"), F.sum("amount").alias("turnover"))
    day = Window.orderBy("d")
    mean = lambda c, a, b=0: F.avg(c).over(day.rowsBetween(a, b))
    s = m.select("d", "close", mean("close", -4).alias("m5"), mean("close", -19).alias("m20"), mean("close", -59).alias("m60"), F.lag("close", 10).over(day).alias("c10"), mean("turnover", -4).alias("t5"), mean("turnover", -9, -5).alias("t5p"))
    regime = F.expr("""CASE WHEN close > m5 AND m5 > m20 AND m20 > m60 THEN 'strong_up' WHEN close > m20 AND m20 > m60 THEN 'up'
        WHEN close < m5 AND m5 < m20 AND m20 < m60 THEN 'strong_down' WHEN close < m20 AND m20 < m60 THEN 'down' ELSE 'range' END""")
    c = F.col("close")
    phase = F.when(F.col("c10").isNull(), "range").when(c > F.col("c10") * 1.01, "bull").when(c < F.col("c10") * 0.99, "bear").otherwise("range")
    return s.select("d", regime.alias("regime"), phase.alias("phase"), r("turnover_trend", W.ratio("t5", "t5p")))


@query(f"""WITH {daily("p_type")}, s AS (SELECT symbol, d, {rounded({f"pct{n}": f"(close / nullif(lag(close, {n}) {over()}, 0) - 1) * 100" for n in (5, 10, 20)})}, volume / nullif(avg(volume) {over(first=-5, last=-1)}, 0) AS vr, regr_slope(close, epoch(d) / 86400) {over(11)} AS slope FROM bars)
 SELECT symbol, d, pct5, pct10, pct20, round(vr, 6) AS volume_ratio, CASE WHEN slope > 0 THEN 'up' WHEN slope < 0 THEN 'down' ELSE 'flat' END AS direction, rank() OVER (PARTITION BY d ORDER BY pct5 DESC, symbol) AS rank5, rank() OVER (PARTITION BY d ORDER BY pct20 DESC, symbol) AS rank20,
 CASE WHEN pct5 > 5 AND pct20 > 10 THEN 'hot' WHEN pct5 > 0 AND pct20 <= 0 THEN 'starting' WHEN pct5 < 0 AND pct20 > 0 THEN 'fading' ELSE 'cold' END AS lifecycle FROM s WHERE pct20 IS NOT NULL""")
def sector_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sectors' changes, volume against the days before, direction by regression over 11 bars, ranks and lifecycle."""
    day = F.datediff("d", F.lit("1970-01-01")).cast("double")
    s = daily_bars(spark, sf_dir, "p_type").select(
        "symbol", "d", *[r(f"pct{n}", W.change("close", n)) for n in (5, 10, 20)], W.ratio("volume", F.avg("volume").over(W.ahead(-5, -1))).alias("vr"),
        F.regr_slope("close", day).over(W.back(11)).alias("slope"),
    ).where("pct20 is not null")
    place = lambda c: F.rank().over(W.across().orderBy(F.desc(c), "symbol")).cast("long")
    life = F.when((F.col("pct5") > 5) & (F.col("pct20") > 10), "hot").when((F.col("pct5") > 0) & (F.col("pct20") <= 0), "starting").when((F.col("pct5") < 0) & (F.col("pct20") > 0), "fading").otherwise("cold")
    way = F.when(F.col("slope") > 0, "up").when(F.col("slope") < 0, "down").otherwise("flat")
    return s.select("symbol", "d", "pct5", "pct10", "pct20", r("volume_ratio", "vr"), way.alias("direction"), place("pct5").alias("rank5"), place("pct20").alias("rank20"), life.alias("lifecycle"))


@query(f"""WITH {daily()}, x AS (SELECT symbol, d, (close / nullif(lag(close) {over()}, 0) - 1) * 100 AS chg FROM bars), g AS (SELECT symbol, d, chg, left(symbol, 7) AS sector FROM x WHERE chg IS NOT NULL),
 c AS (SELECT sector, d, avg(chg) AS consensus, abs(sum(CASE WHEN chg > 0 THEN 1 WHEN chg < 0 THEN -1 ELSE 0 END)) / count(*) AS agreement, count(*) AS members FROM g GROUP BY 1, 2)
 SELECT symbol, g.d, round(consensus, 6) AS consensus, round(agreement, 6) AS agreement, members, CASE WHEN members >= 2 AND agreement >= 0.6::DOUBLE THEN CASE WHEN consensus > 0 THEN 3 ELSE -3 END ELSE 0 END AS boost, round(chg - consensus, 6) AS apart FROM g JOIN c USING (sector, d)""")
def sector_alliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consensus of a sector's members by day, their agreement, the boost it gives and each member's distance."""
    g = daily_bars(spark, sf_dir).select("symbol", "d", W.change("close").alias("chg"), F.substring("symbol", 1, 7).alias("sector")).where("chg is not null")
    c = g.groupBy("sector", "d").agg(F.avg("chg").alias("consensus"), (F.abs(F.sum(F.signum("chg"))) / F.count("*")).alias("agreement"), F.count("*").alias("members"))
    boost = F.when((F.col("members") >= 2) & (F.col("agreement") >= 0.6), F.when(F.col("consensus") > 0, 3).otherwise(-3)).otherwise(0)
    return g.join(c, ["sector", "d"]).select("symbol", "d", r("consensus", "consensus"), r("agreement", "agreement"), "members", boost.alias("boost"), r("apart", F.col("chg") - F.col("consensus")))


@query(f"""WITH {daily()}, j AS (SELECT symbol, d, close, avg(close) OVER (PARTITION BY d) AS market, avg(close) OVER (PARTITION BY d, right(symbol, 1)) AS sector FROM bars),
 f AS (SELECT *, first_value(close) OVER w AS c0, first_value(market) OVER w AS m0, first_value(sector) OVER w AS s0 FROM j WINDOW w AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
 SELECT symbol, d, {rounded({"own": "(close / c0 - 1) * 100", "market": "(market / m0 - 1) * 100", "sector": "(sector / s0 - 1) * 100"})}, (close / c0 > market / m0) AS beats_market, (close / c0 > sector / s0) AS beats_sector FROM f""")
def three_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A symbol, its own sector (the symbols of the same last digit) and the market, rebased on the symbol's first day."""
    day, sector = W.across(), Window.partitionBy("d", F.right("symbol", F.lit(1)))
    j = daily_bars(spark, sf_dir).select("symbol", "d", "close", F.avg("close").over(sector).alias("sector"), F.avg("close").over(day).alias("market"))
    f = j.withColumns({f"{c}0": F.first(c).over(W.so_far()) for c in ("close", "market", "sector")})
    own, market, sector = (F.col(c) / F.col(f"{c}0") for c in ("close", "market", "sector"))
    return f.select("symbol", "d", r("own", (own - 1) * 100), r("market", (market - 1) * 100), r("sector", (sector - 1) * 100), (own > market).alias("beats_market"), (own > sector).alias("beats_sector"))


@query("""WITH t AS (SELECT p_brand AS symbol, l_suppkey AS seat, sum(l_extendedprice) AS bought FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bought DESC, seat) AS place, sum(bought) OVER (PARTITION BY symbol) AS whole FROM t)
 SELECT symbol, round(max(bought) FILTER (WHERE place = 1) / any_value(whole), 6) AS top1, round(sum(bought) FILTER (WHERE place <= 5) / any_value(whole), 6) AS top5, count(*) AS seats FROM k GROUP BY 1""")
def seat_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a symbol's turnover that its largest and its five largest seats have."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    t = table(spark, sf_dir, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("symbol", F.col("l_suppkey").alias("seat")).agg(F.sum("l_extendedprice").alias("bought"))
    w = Window.partitionBy("symbol").orderBy(F.desc("bought"), "seat")
    top = t.withColumn("place", F.row_number().over(w)).where("place <= 5").groupBy("symbol").agg(F.max("bought").alias("first"), F.sum("bought").alias("five"))
    whole = t.groupBy("symbol").agg(F.sum("bought").alias("whole"), F.count("*").alias("seats"))
    return whole.join(top, "symbol").select("symbol", r("top1", F.col("first") / F.col("whole")), r("top5", F.col("five") / F.col("whole")), "seats")


@query("""WITH t AS (SELECT p_brand AS symbol, floor(l_extendedprice * 100 / l_quantity) / 100 AS price, l_quantity AS v FROM lineitem JOIN part ON l_partkey = p_partkey), m AS (SELECT symbol, sum(price * v) / sum(v) AS cost FROM t GROUP BY 1)
 SELECT symbol, sum(CASE WHEN price < cost * 0.85::DOUBLE THEN v ELSE 0 END) AS below, sum(CASE WHEN price >= cost * 0.85::DOUBLE AND price <= cost * 1.15::DOUBLE THEN v ELSE 0 END) AS locked, sum(CASE WHEN price > cost * 1.15::DOUBLE THEN v ELSE 0 END) AS above FROM t JOIN m USING (symbol) GROUP BY 1""")
def price_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume traded below, around and above the mean cost: one pass for the cost, one for the zones."""
    t = trades(spark, sf_dir).select("symbol", "price", "volume")
    m = t.groupBy("symbol").agg((F.sum(F.col("price") * F.col("volume")) / F.sum("volume")).alias("cost"))
    low, high, p = F.col("cost") * 0.85, F.col("cost") * 1.15, F.col("price")
    part = lambda c: F.sum(F.when(c, F.col("volume")).otherwise(0.0))
    return t.join(m, "symbol").groupBy("symbol").agg(part(p < low).alias("below"), part((p >= low) & (p <= high)).alias("locked"), part(p > high).alias("above"))


@query("""WITH s AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS d, value, ts, event_id, extract(hour FROM ts) < 12 AS morning FROM events),
 g AS (SELECT symbol, d, count(*) AS n, arg_min(value, (ts, event_id)) AS first, arg_max(value, (ts, event_id)) AS last, max(value) FILTER (WHERE morning) AS mh, max(value) FILTER (WHERE NOT morning) AS ah, min(value) FILTER (WHERE morning) AS ml, min(value) FILTER (WHERE NOT morning) AS al FROM s GROUP BY 1, 2)
 SELECT symbol, d, n, CASE WHEN mh IS NULL OR ah IS NULL THEN 'short' WHEN ah > mh AND al >= ml THEN 'rising' WHEN ah <= mh AND al < ml THEN 'falling' WHEN ah > mh THEN 'widening' ELSE 'narrowing' END AS shape, round(last - first, 6) AS move FROM g""")
def day_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shape of a day by its halves' extremes."""
    order, morning = F.struct("ts", "event_id"), F.hour("ts") < 12
    g = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("symbol"), F.to_date("ts").alias("d")).agg(
        F.count("*").alias("n"), F.min_by("value", order).alias("first"), F.max_by("value", order).alias("last"), F.max(F.when(morning, F.col("value"))).alias("mh"),
        F.max(F.when(~morning, F.col("value"))).alias("ah"), F.min(F.when(morning, F.col("value"))).alias("ml"), F.min(F.when(~morning, F.col("value"))).alias("al"),
    )
    shape = F.expr("""CASE WHEN mh IS NULL OR ah IS NULL THEN 'short' WHEN ah > mh AND al >= ml THEN 'rising' WHEN ah <= mh AND al < ml THEN 'falling' WHEN ah > mh THEN 'widening' ELSE 'narrowing' END""")
    return g.select("symbol", "d", "n", shape.alias("shape"), r("move", F.col("last") - F.col("first")))
