"""News around signals: a join of dates within some days, by buckets of days, and how often news tells the way."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.bars import event_bars
from tickloom.functions import windows as W
from tickloom.sources.tables import table

QUERIES, SQL = {}, {}

#: Days before and after a signal, bars after which it is judged, and the fewest signals that are.
DAYS, AHEAD, LEAST = 3, 5, 3


def within_days(left: DataFrame, right: DataFrame, days: int) -> DataFrame:
    """Rows of left (symbol, d, ...) with those of right (symbol, on, ...) that are `days` days apart at most, each pair
    once; left rows without any stay out. Days are dealt into buckets of `days` (1 at least): a left row looks into its
    own bucket and the two beside it, a right row lies in one alone, so an equality join finds all pairs."""
    width = max(days, 1)
    bucket = lambda c: F.floor(F.datediff(F.col(c), F.lit("1970-01-01").cast("date")) / width)
    a = left.withColumn("_bucket", F.explode(F.array(*[bucket("d") + k for k in (-1, 0, 1)])))
    b = right.withColumn("_bucket", bucket("on"))
    return a.join(b, ["symbol", "_bucket"]).where(F.abs(F.datediff("on", "d")) <= days).drop("_bucket")


def resonance(signals: DataFrame, news: DataFrame, days: int = DAYS, least: int = LEAST) -> DataFrame:
    """One row a symbol: its signals (symbol, d, change; null changes don't count), how many have news (symbol, on, way: 1,
    -1 or 0) around them, and how often the sum of the news' ways has the sign of the change. News is summed by day
    before the join, so a hot day is one row. Symbols of fewer than `least` signals: none."""
    known = signals.where("d IS NOT NULL AND change IS NOT NULL").select("symbol", "d", "change")
    by_day = news.where("on IS NOT NULL").groupBy("symbol", "on").agg(F.sum("way").alias("way"))
    ways = within_days(known.select("symbol", "d").distinct(), by_day, days).groupBy("symbol", "d").agg(F.signum(F.sum("way")).alias("way"))
    x = known.join(ways, ["symbol", "d"], "left")
    has = F.col("way").isNotNull()
    g = x.groupBy("symbol").agg(F.count("*").alias("signals"), F.count_if(has).alias("with_news"), F.count_if(has & (F.col("way") * F.col("change") > 0)).alias("right"))
    rate = lambda c: F.round(c / F.col("signals"), 3)
    return g.where(F.col("signals") >= least).select(
        "symbol", "signals", "with_news", "right", rate(F.col("with_news")).alias("news_driven"), rate(F.col("signals") - F.col("with_news")).alias("tech_driven"),
        F.round(F.col("right") / F.greatest("with_news", F.lit(1)), 3).alias("accuracy"),
    )


def news_resonance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rising days of each event type as signals, and its events above 250 as news, good where the number is even."""
    events = table(spark, sf_dir, "events")
    w = W.by_time()
    bars = event_bars(events, "1 day").select("symbol", F.to_date("ts").alias("d"), "close")
    x = bars.select("symbol", "d", (F.col("close") > F.lag("close").over(w)).alias("rises"), ((F.lead("close", AHEAD).over(w) / F.col("close") - 1) * 100).alias("change"))
    news = events.where("value > 250").select(F.col("event_type").alias("symbol"), F.to_date("ts").alias("on"), F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1).alias("way"))
    return resonance(x.where("rises"), news)


QUERIES["news_resonance"] = news_resonance
SQL["news_resonance"] = """WITH b AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS d, arg_max(value, (ts, event_id)) AS close FROM events GROUP BY ALL),
 s AS (SELECT symbol, d, close > lag(close) OVER w AS rises, (lead(close, 5) OVER w / close - 1) * 100 AS change FROM b WINDOW w AS (PARTITION BY symbol ORDER BY d)),
 k AS (SELECT * FROM s WHERE rises AND change IS NOT NULL),
 n AS (SELECT k.symbol, k.d, k.change, sign(sum(CASE WHEN e.event_id % 2 = 0 THEN 1 WHEN e.event_id IS NOT NULL THEN -1 END)) AS way
  FROM k LEFT JOIN events e ON e.event_type = k.symbol AND e.value > 250 AND CAST(e.ts AS DATE) BETWEEN k.d - 3 AND k.d + 3 GROUP BY ALL)
 SELECT symbol, count(*) AS signals, count(way) AS with_news, count(*) FILTER (way * change > 0) AS "right", round(count(way) / count(*), 3) AS news_driven, round((count(*) - count(way)) / count(*), 3) AS tech_driven,
  round(count(*) FILTER (way * change > 0) / greatest(count(way), 1), 3) AS accuracy FROM n GROUP BY symbol HAVING count(*) >= 3"""
