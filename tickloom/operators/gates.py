"""Gates on candidates: the hard rules on each symbol's latest bar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.bars import daily_bars
from tickloom.functions import windows as W
from tickloom.operators.signals import indicator, indicator_sql
from tickloom.plans.sql import daily, over

QUERIES, SQL = {}, {}

# Archetypes without the deviation rules (stand-ins by a symbol's last digit), and the rules: those that block, and
# those that are only noted
EXEMPT = ("1", "2")
BLOCKING = {
    "micro_cap": "cap > 0 AND cap < 50", "weak": "NOT exempt AND bias < -3", "chase_high": "NOT exempt AND bias > 10", "rsi_overbought": "rsi > 70",
    "strong_bear": "m5 < m10 AND m10 < m20",
}
NOTED = {"macd_bear": "diff < 0", "kdj_overbought": "j > 80", "chip_too_low": "cost_50 < 5"}


def judged(rows: DataFrame) -> DataFrame:
    """rows(cap, exempt, bias, rsi, m5, m10, m20, diff, j, cost_50) with failed and noted, the names of the rules that
    apply, in order, and passed: none that blocks does. A figure that is missing fails no rule."""
    names = lambda rules: F.concat_ws(",", *[F.when(F.expr(x), n) for n, x in rules.items()])
    return rows.withColumns({"failed": names(BLOCKING), "noted": names(NOTED)}).withColumn("passed", F.col("failed") == "")


def hard_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = daily_bars(spark, sf_dir)
    x = indicator(bars).select("symbol", "d", "close", "diff", "j")
    w = W.by_time()
    move = F.col("close") - F.lag("close").over(w)
    mean = lambda c, n: F.avg(c).over(w.rowsBetween(1 - n, 0))
    own = bars.select(
        "symbol", "d", (F.sum("amount").over(w.rowsBetween(-59, 0)) / 10000).alias("cap"), mean("close", 50).alias("cost_50"),
        *[mean("close", n).alias(f"m{n}") for n in (5, 10, 20)], F.greatest(move, F.lit(0.0)).alias("up"), F.greatest(-move, F.lit(0.0)).alias("down"),
    )
    own = own.withColumns({"up": mean("up", 14), "down": mean("down", 14)})
    last = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("d")))
    x = x.join(own, ["symbol", "d"]).withColumn("age", last).where("age = 1").withColumns({
        "exempt": F.substring("symbol", -1, 1).isin(*EXEMPT), "bias": (F.col("close") / F.when(F.col("m20") != 0, F.col("m20")) - 1) * 100,
        "rsi": 100 - 100 / (1 + F.col("up") / F.when(F.col("down") == 0, 1.0).otherwise(F.col("down"))),
    })
    return judged(x).select("symbol", "d", "failed", "noted", "passed")


QUERIES["hard_rules"] = hard_rules
SQL["hard_rules"] = f"""WITH RECURSIVE {daily()},
 {indicator_sql("bars", "ind")},
 u AS (SELECT *, greatest(close - lag(close) {over()}, 0) AS up, greatest(lag(close) {over()} - close, 0) AS down FROM bars),
 g AS (SELECT symbol, d, sum(amount) {over(60)} / 10000 AS cap, avg(close) {over(50)} AS cost, avg(close) {over(5)} AS a, avg(close) {over(10)} AS b, avg(close) {over(20)} AS c, avg(up) {over(14)} AS up, avg(down) {over(14)} AS down FROM u),
 r AS (SELECT symbol, d, (close / c - 1) * 100 AS bias, right(symbol, 1) IN ('1', '2') AS free, cap, cost, a, b, c, 100 - 100 / (1 + g.up / CASE WHEN g.down = 0 THEN 1 ELSE g.down END) AS rsi, diff, j FROM ind JOIN g USING (symbol, d)
  QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY d DESC) = 1),
 f AS (SELECT symbol, d, concat_ws(',', CASE WHEN cap > 0 AND cap < 50 THEN 'micro_cap' END, CASE WHEN NOT free AND bias < -3 THEN 'weak' END, CASE WHEN NOT free AND bias > 10 THEN 'chase_high' END,
   CASE WHEN rsi > 70 THEN 'rsi_overbought' END, CASE WHEN a < b AND b < c THEN 'strong_bear' END) AS failed,
  concat_ws(',', CASE WHEN diff < 0 THEN 'macd_bear' END, CASE WHEN j > 80 THEN 'kdj_overbought' END, CASE WHEN cost < 5 THEN 'chip_too_low' END) AS noted FROM r)
 SELECT symbol, d, failed, noted, failed = '' AS passed FROM f"""
