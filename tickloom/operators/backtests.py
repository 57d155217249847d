"""Back-tests of entries: results after fixed times, exits that depend on the path, and levels with what touching them led to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.bars import daily_bars
from tickloom.functions import windows as W
from tickloom.plans.sql import daily, over

QUERIES, SQL = {}, {}

#: Bars after which results are taken, and the fewest results that make a figure.
HORIZONS, LEAST = (5, 10, 20), 5
#: Exits: percent below the entry, percent below the highest close since, and bars held at most.
RULES = {"tight": (5.0, 8.0, 5), "wide": (30.0, 40.0, 20), "time_only": (100.0, 100.0, 10)}


def entries(bars: DataFrame, fast: int = 20, slow: int = 100) -> DataFrame:
    """symbol, d, close, kind of the bars that close above the mean of `fast` or of `slow` bars for the first time:
    weekly_resonance (above both, the slow mean standing for that of weeks), daily_only or weekly_driven; with path, the
    closes of the bars after it, as many as the longest exit needs."""
    w = W.by_time()
    above = {n: F.col("close") > F.avg("close").over(w.rowsBetween(1 - n, 0)) for n in (fast, slow)}
    x = bars.select("symbol", "d", "close", above[fast].alias("fast"), above[slow].alias("slow"), F.row_number().over(w).alias("i"))
    most = max(*HORIZONS, *(n for _, _, n in RULES.values()))
    x = x.withColumns({"path": F.collect_list("close").over(w.rowsBetween(1, most)), "was_fast": F.lag("fast").over(w), "was_slow": F.lag("slow").over(w)})
    x = x.where((F.col("i") > slow) & ((F.col("fast") & ~F.col("was_fast")) | (F.col("slow") & ~F.col("was_slow"))))
    return x.select("symbol", "d", "close", F.when(F.col("fast") & F.col("slow"), "weekly_resonance").when(F.col("fast"), "daily_only").otherwise("weekly_driven").alias("kind"), "path")


def exits(rows: DataFrame, rules: dict[str, tuple[float, float, int]] = RULES) -> DataFrame:
    """One row an entry (symbol, d, close, kind, path) and rule: days held, reason (stop, trail, time; open where the bars
    end before), and the change in percent. Positions overlap freely; each entry folds over its own short path. On a bar
    that meets both, the stop counts."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(s).alias("stop"), F.lit(t).alias("trail"), F.lit(h).alias("most")) for n, (s, t, h) in rules.items()]))
    x = rows.select("symbol", "d", "close", "kind", "path", each.alias("r")).select("symbol", "d", "close", "kind", "path", "r.*")
    start = F.struct(F.col("close").alias("peak"), F.lit(0).alias("days"), F.lit("open").alias("reason"), F.col("close").alias("at"))

    def step(a, c):
        days, peak = a["days"] + 1, F.greatest(a["peak"], c)
        reason = F.when(c <= F.col("close") * (1 - F.col("stop") / 100), "stop").when(c <= peak * (1 - F.col("trail") / 100), "trail").when(days >= F.col("most"), "time").otherwise("open")
        return F.when(a["reason"] != "open", a).otherwise(F.struct(peak.alias("peak"), days.alias("days"), reason.alias("reason"), c.alias("at")))

    x = x.withColumn("e", F.aggregate("path", start, step))
    return x.select("symbol", "d", "kind", "rule", F.col("e.days").alias("days"), F.col("e.reason").alias("reason"), ((F.col("e.at") / F.col("close") - 1) * 100).alias("change"))


def exit_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exits(entries(daily_bars(spark, sf_dir))).withColumn("change", F.round("change", 4))


def resonance_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries by kind, and how many rose after 5, 10 and 20 bars and by how much; null below five results."""
    x = entries(daily_bars(spark, sf_dir))
    out = [F.count("*").alias("n")]
    for h in HORIZONS:
        change = (F.get("path", F.lit(h - 1)) / F.col("close") - 1) * 100
        known = F.count(change) >= LEAST
        out += [F.when(known, F.round(F.avg((change > 0).cast("double")) * 100, 1)).alias(f"win_{h}"), F.when(known, F.round(F.avg(change), 2)).alias(f"mean_{h}")]
    return x.groupBy("kind").agg(*out)


_ENTRIES_SQL = f"""{daily()},
 m AS (SELECT symbol, d, close, close > avg(close) {over(20)} AS f, close > avg(close) {over(100)} AS s, row_number() {over()} AS i FROM bars),
 n AS (SELECT *, lag(f) {over()} AS pf, lag(s) {over()} AS ps FROM m),
 e AS (SELECT symbol, d, close, i, CASE WHEN f AND s THEN 'weekly_resonance' WHEN f THEN 'daily_only' ELSE 'weekly_driven' END AS kind FROM n WHERE i > 100 AND ((f AND NOT pf) OR (s AND NOT ps)))"""
QUERIES["exit_backtest"] = exit_backtest
SQL["exit_backtest"] = f"""WITH {_ENTRIES_SQL},
 r(rule, stop, trail, most) AS (VALUES ('tight', 0.05, 0.08, 5), ('wide', 0.30, 0.40, 20), ('time_only', 1.0, 1.0, 10)),
 p AS (SELECT e.symbol, e.d, e.kind, e.close, r.*, b.i - e.i AS days, b.close AS now, greatest(e.close, max(b.close) OVER (PARTITION BY e.symbol, e.i, r.rule ORDER BY b.i)) AS peak
  FROM e CROSS JOIN r LEFT JOIN m b ON b.symbol = e.symbol AND b.i > e.i AND b.i <= e.i + r.most),
 q AS (SELECT *, CASE WHEN now <= close * (1 - stop::DOUBLE) THEN 'stop' WHEN now <= peak * (1 - trail::DOUBLE) THEN 'trail' WHEN days = most THEN 'time' ELSE 'open' END AS reason FROM p)
 SELECT symbol, d, kind, rule, coalesce(days, 0) AS days, reason, coalesce(round((now / close - 1) * 100, 4), 0) AS change FROM q
 QUALIFY row_number() OVER (PARTITION BY symbol, d, rule ORDER BY reason = 'open', CASE WHEN reason = 'open' THEN -days ELSE days END) = 1"""
QUERIES["resonance_backtest"] = resonance_backtest
SQL["resonance_backtest"] = f"""WITH {_ENTRIES_SQL},
 l AS (SELECT e.kind, {", ".join(f"(x{h}.close / e.close - 1) * 100 AS c{h}" for h in HORIZONS)} FROM e {" ".join(f"LEFT JOIN m x{h} ON x{h}.symbol = e.symbol AND x{h}.i = e.i + {h}" for h in HORIZONS)})
 SELECT kind, count(*) AS n, {", ".join(f"CASE WHEN count(c{h}) >= 5 THEN round(avg(CASE WHEN c{h} > 0 THEN 100.0 WHEN c{h} IS NOT NULL THEN 0 END), 1) END AS win_{h}, CASE WHEN count(c{h}) >= 5 THEN round(avg(c{h}), 2) END AS mean_{h}" for h in HORIZONS)}
 FROM l GROUP BY kind"""

# Percent within which a price is at a mean, at a high or low, and touches a level
AT_MEAN, AT_EXTREME, TOUCH, SWING, GAP, LEAST_TOUCHES = 2.0, 3.0, 0.02, 5, 0.02, 3


def levels(bars: DataFrame) -> DataFrame:
    """symbol, last (the latest close), kind, value: the means of the last 60, 120 and 250 closes where there are so many,
    the highest high and lowest low of 250 bars, and clusters of three or more swing prices (a high or low that no bar
    within five undercuts or tops), which part where neighbours differ by more than 2 percent; a mean within 2 percent
    of the latest close, all others within 3."""
    w, whole = W.by_time(), Window.partitionBy("symbol")
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("d")))
    x = bars.select("symbol", "d", "high", "low", "close", back.alias("back"), F.count("*").over(whole).alias("n"))
    means = [F.when(F.max("n") >= k, F.avg(F.when(F.col("back") <= k, F.col("close")))).alias(f"mean_{k}") for k in (60, 120, 250)]
    recent = F.col("back") <= 250
    one = x.groupBy("symbol").agg(*means, F.max(F.when(recent, F.col("high"))).alias("high_250"), F.min(F.when(recent, F.col("low"))).alias("low_250"), F.min_by("close", "back").alias("last"))
    kinds = ["mean_60", "mean_120", "mean_250", "high_250", "low_250"]
    plain = one.select("symbol", "last", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in kinds])).alias("x")).select("symbol", "last", "x.*")
    around = w.rowsBetween(-SWING, SWING)
    full = F.count("*").over(around) == 2 * SWING + 1
    swing = bars.select("symbol", F.when(full & (F.col("high") == F.max("high").over(around)), F.col("high")).alias("top"), F.when(full & (F.col("low") == F.min("low").over(around)), F.col("low")).alias("bottom"))
    swing = swing.select("symbol", F.explode(F.array("top", "bottom")).alias("price")).where("price > 0")
    by_price = Window.partitionBy("symbol").orderBy("price")
    parts = F.coalesce((F.col("price") / F.lag("price").over(by_price) - 1 > GAP).cast("int"), F.lit(1))
    swing = swing.withColumn("new", parts).withColumn("cluster", F.sum("new").over(by_price.rowsBetween(Window.unboundedPreceding, 0)))
    swing = swing.groupBy("symbol", "cluster").agg(F.avg("price").alias("value"), F.count("*").alias("n")).where("n >= 3")
    swing = swing.join(one.select("symbol", "last"), "symbol").select("symbol", "last", F.lit("swing").alias("kind"), "value")
    near = F.abs((F.col("last") - F.col("value")) / F.col("value") * 100) < F.when(F.col("kind").startswith("mean"), AT_MEAN).otherwise(AT_EXTREME)
    return plain.union(swing).where((F.col("value") > 0) & near)


def key_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels that a symbol is at, and what came of closes within 2 percent of them: how many, the share that stood higher
    five bars later, and the mean change; null below three. A symbol's few levels meet its bars, by symbol."""
    bars = daily_bars(spark, sf_dir)
    at = levels(bars).withColumn("action", F.when(F.col("kind") == "high_250", "resistance").when(F.col("kind") == "low_250", "support").when(F.col("last") > F.col("value"), "support").otherwise("resistance"))
    w = W.by_time()
    later = bars.select(F.col("symbol").alias("of"), "close", F.lead("close", 5).over(w).alias("later"), F.row_number().over(w).alias("i"), F.count("*").over(Window.partitionBy("symbol")).alias("n"))
    touch = (F.col("symbol") == F.col("of")) & (F.abs(F.col("close") - F.col("value")) / F.col("value") < TOUCH) & (F.col("i") <= F.col("n") - 10)
    change = (F.col("later") / F.col("close") - 1) * 100
    g = at.join(later, touch, "left").groupBy("symbol", "kind", "value", "last", "action").agg(F.count("close").alias("touches"), F.avg((change > 0).cast("double")).alias("rate"), F.avg(change).alias("bounce"))
    sure = F.col("touches") >= LEAST_TOUCHES
    return g.select(
        "symbol", "kind", F.round("value", 2).alias("value"), F.round((F.col("last") - F.col("value")) / F.col("value") * 100, 2).alias("distance"), "action", "touches",
        F.when(sure, F.round("rate", 3)).alias("rate"), F.when(sure, F.round("bounce", 2)).alias("bounce"),
    )


QUERIES["key_levels"] = key_levels
SQL["key_levels"] = f"""WITH {daily()},
 b AS (SELECT *, row_number() {over()} AS i, count(*) OVER (PARTITION BY symbol) AS n, lead(close, 5) {over()} AS later FROM bars),
 t AS (SELECT symbol, any_value(close) FILTER (i = n) AS last, {", ".join(f"CASE WHEN max(n) >= {k} THEN avg(close) FILTER (i > n - {k}) END AS m{k}" for k in (60, 120, 250))},
   max(high) FILTER (i > n - 250) AS hi, min(low) FILTER (i > n - 250) AS lo FROM b GROUP BY symbol),
 w AS (SELECT x.symbol, x.high AS price FROM b x WHERE x.i > 5 AND x.i <= x.n - 5 AND x.high >= (SELECT max(y.high) FROM b y WHERE y.symbol = x.symbol AND y.i BETWEEN x.i - 5 AND x.i + 5)
  UNION ALL SELECT x.symbol, x.low FROM b x WHERE x.i > 5 AND x.i <= x.n - 5 AND x.low <= (SELECT min(y.low) FROM b y WHERE y.symbol = x.symbol AND y.i BETWEEN x.i - 5 AND x.i + 5)),
 g AS (SELECT *, CASE WHEN price / lag(price) OVER (PARTITION BY symbol ORDER BY price) - 1 <= 0.02 THEN 0 ELSE 1 END AS new FROM w WHERE price > 0),
 c AS (SELECT symbol, price, sum(new) OVER (PARTITION BY symbol ORDER BY price ROWS UNBOUNDED PRECEDING) AS k FROM g),
 v AS ({" UNION ALL ".join(f"SELECT symbol, last, '{n}' AS kind, {c} AS value FROM t" for n, c in (("mean_60", "m60"), ("mean_120", "m120"), ("mean_250", "m250"), ("high_250", "hi"), ("low_250", "lo")))}
  UNION ALL SELECT symbol, t.last, 'swing', value FROM (SELECT symbol, avg(price) AS value FROM c GROUP BY symbol, k HAVING count(*) >= 3) s JOIN t USING (symbol)),
 a AS (SELECT *, CASE WHEN kind = 'high_250' THEN 'resistance' WHEN kind = 'low_250' OR last > value THEN 'support' ELSE 'resistance' END AS action FROM v
  WHERE value > 0 AND abs(last - value) / value * 100 < CASE WHEN kind LIKE 'mean%' THEN 2 ELSE 3 END),
 x AS (SELECT a.*, count(b.close) AS touches, avg(CASE WHEN b.later > b.close THEN 1.0 WHEN b.close IS NOT NULL THEN 0 END) AS rate, avg((b.later / b.close - 1) * 100) AS bounce
  FROM a LEFT JOIN b ON b.symbol = a.symbol AND abs(b.close - a.value) / a.value < 0.02 AND b.i <= b.n - 10 GROUP BY ALL)
 SELECT symbol, kind, round(value, 2) AS value, round((last - value) / value * 100, 2) AS distance, action, touches, CASE WHEN touches >= 3 THEN round(rate, 3) END AS rate, CASE WHEN touches >= 3 THEN round(bounce, 2) END AS bounce FROM x"""
