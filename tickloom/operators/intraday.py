"""Actions within a session, what bars looked like before them, and which conditions come before them more than else.

A bar's conditions are one number, a bit for each; bars are counted by symbol and number first, so that mining all
conditions and pairs of them works on a few counts a symbol, whatever the number of bars. The bars that are compared
with are all others, not a sample.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.bars import event_bars
from tickloom.sources.tables import table

QUERIES, SQL = {}, {}

# Bounds of the actions, and the conditions on a bar before them
RISE, BUSY, STILL, STILL_BARS, STILL_BUSY, TAIL, TAIL_BARS, TAIL_SAME, CHARGE, CHARGE_BUSY, CHARGE_BARS = 1.5, 2.0, 0.3, 6, 1.5, 1.0, 6, 3, 1.0, 3.0, 12
CONDITIONS = {
    "back_to_vwap": "vwap_dist > -1.0 AND vwap_dist < 0.5", "below_mean": "vwap_dist < -1.0 AND place < 0.4", "narrow": "width_rank < 0.25", "whole_number": "whole",
    "thin_sideways": "volume_ratio < 0.6 AND place > 0.3 AND place < 0.7", "busy_bottom": "volume_ratio > 2.0 AND place < 0.3", "upper_shadow": "shadow > 0.5",
    "means_close": "means_gap < 0.5 AND mean_dist > -2 AND mean_dist < 2", "vwap_sideways": "vwap_dist > -0.5 AND vwap_dist < 0.5 AND means_gap < 1.0", "below_open": "open_dist < -1.0 AND place < 0.5",
}
#: Bars between what is looked at and the action, bars before there is something to look at, and bounds of a rule.
BEFORE, WARM_UP, LEAST_ACTIONS, LIFT, HIT = 3, 10, 20, 3.0, 0.5


def _in_series():
    return Window.partitionBy("symbol").orderBy("ts")


def _in_day():
    return Window.partitionBy("symbol", "day").orderBy("ts")


def session_bars(bars: DataFrame) -> DataFrame:
    """Bars (symbol, ts, open, high, low, close, volume) with day, their number in the series (i) and the day (k, from
    0, and back from the end: left), change and volume against the mean of the last 20 bars."""
    x = bars.withColumn("day", F.to_date("ts"))
    mean = F.avg("volume").over(_in_series().rowsBetween(-19, 0))
    return x.withColumns({
        "i": F.row_number().over(_in_series()) - 1, "k": F.row_number().over(_in_day()) - 1, "left": F.count("*").over(Window.partitionBy("symbol", "day")) - F.row_number().over(_in_day()),
        "change": (F.col("close") - F.col("open")) / F.greatest("open", F.lit(0.01)) * 100, "busy": F.col("volume") / F.greatest(mean, F.lit(1e-9)),
    })


def actions(bars: DataFrame) -> DataFrame:
    """symbol, ts, i, kind, change, busy, one row an action of session_bars(): fast_rise and fast_fall of a busy bar,
    support_sideways (a run of still and busy bars within a day; its first bar), tail_attack (the day's last bars move
    one way; the first of them) and open_charge (the day's first busy rise among its first bars)."""
    one = bars.where((F.col("i") >= 20) & (F.col("busy") > BUSY) & (F.abs("change") >= RISE))
    fast = one.select("symbol", "ts", "i", F.when(F.col("change") > 0, "fast_rise").otherwise("fast_fall").alias("kind"), "change", "busy")
    still = ((F.col("high") - F.col("low")) / F.greatest("open", F.lit(0.01)) * 100 < STILL) & (F.col("busy") > STILL_BUSY)
    x = bars.withColumn("still", still)
    run = x.withColumn("run", F.col("k") - F.sum(F.col("still").cast("int")).over(_in_day())).where("still").groupBy("symbol", "day", "run")
    first = lambda c: F.min_by(c, "ts").alias(c)
    held = run.agg(first("ts"), first("i"), ((F.max_by("close", "ts") / F.greatest(F.min_by("close", "ts"), F.lit(0.01)) - 1) * 100).alias("change"), F.avg("busy").alias("busy"), F.count("*").alias("n"))
    held = held.where(F.col("n") >= STILL_BARS).select("symbol", "ts", "i", F.lit("support_sideways").alias("kind"), "change", "busy")
    moved = (F.max_by("close", "ts") - F.min_by("open", "ts")) / F.greatest(F.min_by("open", "ts"), F.lit(0.01)) * 100
    same = lambda up: F.count_if(F.col("close") > F.col("open") if up else F.col("close") < F.col("open"))
    tail = bars.where(F.col("left") < TAIL_BARS).groupBy("symbol", "day").agg(first("ts"), first("i"), moved.alias("change"), F.avg("busy").alias("busy"), same(True).alias("up"), same(False).alias("down"))
    tail = tail.where((F.abs("change") >= TAIL) & (F.when(F.col("change") > 0, F.col("up")).otherwise(F.col("down")) >= TAIL_SAME))
    tail = tail.select("symbol", "ts", "i", F.lit("tail_attack").alias("kind"), "change", "busy")
    begun = bars.where((F.col("k") < CHARGE_BARS) & (F.col("change") >= CHARGE) & (F.col("busy") > CHARGE_BUSY)).groupBy("symbol", "day")
    charge = begun.agg(first("ts"), first("i"), first("change"), first("busy")).select("symbol", "ts", "i", F.lit("open_charge").alias("kind"), "change", "busy")
    return fast.union(held).union(tail).union(charge)


def indicators(bars: DataFrame) -> DataFrame:
    """session_bars() with the ten figures of a bar: distances to the session's volume-weighted mean, the 21-bar mean, the
    close before and the session's open, place in the session's range, rank of the band's width among the last 41, volume
    ratio, whether the price is near a whole number, gap of the means, upper shadow of the bar before."""
    so_far = _in_day().rowsBetween(Window.unboundedPreceding, 0)
    last = lambda f, c, n: f(c).over(_in_series().rowsBetween(1 - n, 0))
    off = lambda c: (F.col("close") - F.col(c)) / F.greatest(F.col(c), F.lit(0.01)) * 100
    x = bars.withColumn("paid", F.col("close") * F.col("volume")).withColumns({
        "vwap": F.sum("paid").over(so_far) / F.greatest(F.sum("volume").over(so_far), F.lit(1e-9)), "m21": last(F.avg, "close", 21), "m6": last(F.avg, "close", 6), "sd": last(F.stddev_pop, "close", 21),
        "before": F.coalesce(F.lag("close").over(_in_series()), "close"), "first_open": F.first("open").over(so_far), "top": F.max("high").over(so_far), "bottom": F.min("low").over(so_far),
        "v21": last(F.avg, "volume", 21), "shadow": (F.col("high") - F.greatest("open", "close")) / F.greatest(F.col("high") - F.col("low"), F.lit(0.001)),
    })
    x = x.withColumns({
        "width": F.round(2 * F.col("sd") / F.greatest("m21", F.lit(0.01)), 9), "vwap_dist": off("vwap"), "mean_dist": off("m21"), "before_dist": off("before"), "open_dist": off("first_open"),
        "place": F.when(F.col("top") > F.col("bottom"), (F.col("close") - F.col("bottom")) / (F.col("top") - F.col("bottom"))).otherwise(0.5), "volume_ratio": F.col("volume") / F.greatest("v21", F.lit(1e-9)),
        "whole": F.abs(F.col("close") - F.round("close")) / F.greatest("close", F.lit(0.01)) < 0.005, "means_gap": F.abs(F.col("m6") - F.col("m21")) / F.greatest("m21", F.lit(0.01)) * 100,
        "shadow": F.coalesce(F.lag("shadow").over(_in_series()), F.lit(0.0)),
    })
    widths = F.collect_list("width").over(_in_series().rowsBetween(-40, 0))
    return x.withColumn("width_rank", F.size(F.filter(widths, lambda y: y <= F.col("width"))) / F.size(widths))


def conditions(bars: DataFrame) -> DataFrame:
    """indicators() with met, a bit for each of CONDITIONS."""
    bits = [F.when(F.expr(x), 1 << k).otherwise(0) for k, x in enumerate(CONDITIONS.values())]
    return indicators(bars).withColumn("met", sum(bits[1:], bits[0]))


def _rules() -> list[tuple[str, int]]:
    names = list(CONDITIONS)
    single = [(n, 1 << k) for k, n in enumerate(names)]
    return single + [(f"{a} & {b}", x | y) for (a, x), (b, y) in combinations(single, 2)]


def rules(bars: DataFrame, least: int = LEAST_ACTIONS, lift: float = LIFT, hit: float = HIT) -> DataFrame:
    """symbol, kind, rule, bits, actions, hit_rate, other_rate, lift: conditions and pairs of them that hold BEFORE bars
    ahead of at least `hit` of a kind's actions, `lift` times as often as ahead of other bars. Kinds of fewer than `least`
    actions, and actions with fewer than WARM_UP bars before them, don't count."""
    x = conditions(bars).withColumn("ahead", F.lag("met", BEFORE).over(_in_series())).where(F.col("i") >= WARM_UP + BEFORE)
    kinds = actions(bars).groupBy("symbol", "i").agg(F.collect_set("kind").alias("kinds"))
    counted = x.select("symbol", "i", "ahead").join(kinds, ["symbol", "i"], "left").groupBy("symbol", "ahead", "kinds").agg(F.count("*").alias("n"))
    names = F.array(*[F.lit(k) for k in ("fast_rise", "fast_fall", "support_sideways", "tail_attack", "open_charge")])
    by = counted.withColumn("kind", F.explode(names)).withColumn("acts", F.coalesce(F.array_contains("kinds", F.col("kind")), F.lit(False)))
    table_of = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).alias("bits")) for n, b in _rules()])
    by = by.withColumn("r", F.explode(table_of)).withColumn("holds", F.col("ahead").bitwiseAND(F.col("r.bits")) == F.col("r.bits"))
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    x = by.groupBy("symbol", "kind", "r.rule", "r.bits").agg(
        n(F.col("acts")).alias("actions"), n(F.col("acts") & F.col("holds")).alias("hits"), n(~F.col("acts")).alias("others"), n(~F.col("acts") & F.col("holds")).alias("other_hits")
    )
    x = x.where(F.col("actions") >= least).withColumns({"hit_rate": F.col("hits") / F.col("actions"), "other_rate": F.col("other_hits") / F.greatest("others", F.lit(1))})
    x = x.withColumn("lift", F.col("hit_rate") / F.greatest("other_rate", F.lit(0.001))).where((F.col("lift") >= lift) & (F.col("hit_rate") >= hit))
    return x.select("symbol", "kind", "rule", "bits", "actions", *[F.round(c, 4).alias(c) for c in ("hit_rate", "other_rate", "lift")])


def active(bars: DataFrame, found: DataFrame) -> DataFrame:
    """symbol, kind, active (rules that hold at a symbol's last bar) and chance, the greatest hit rate among them. Bars
    with a column met, of a table or of a stream, are joined with the rules by symbol."""
    last = conditions(bars).withColumn("back", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))).where("back = 1")
    return matched(last, found).groupBy("symbol", "kind").agg(F.sort_array(F.collect_list("rule")).alias("active"), F.max("hit_rate").alias("chance"))


def matched(met: DataFrame, found: DataFrame) -> DataFrame:
    """symbol, ts, kind, rule, hit_rate for each rule that holds at a row of (symbol, ts, met); works on streams too."""
    return met.join(found.select(F.col("symbol").alias("_of"), "kind", "rule", "bits", "hit_rate"), (F.col("symbol") == F.col("_of")) & (F.col("met").bitwiseAND(F.col("bits")) == F.col("bits"))).select(
        "symbol", "ts", "kind", "rule", "hit_rate"
    )


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_bars(event_bars(table(spark, sf_dir, "events")).withColumnRenamed("n", "volume").drop("amount"))


def intraday_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = actions(hourly(spark, sf_dir))
    return x.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "kind", F.round("change", 4).alias("change"), F.round("busy", 4).alias("busy"))


def trigger_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of hourly bars, with bounds low enough for random ones to have some."""
    return rules(hourly(spark, sf_dir), lift=1.3, hit=0.1).drop("bits")


_BARS_SQL = f"""e AS (SELECT event_type AS symbol, time_bucket(INTERVAL '1 hour', ts) AS ts, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume
   FROM events GROUP BY ALL),
 b AS (SELECT *, CAST(ts AS DATE) AS day, row_number() OVER s - 1 AS i, row_number() OVER dd - 1 AS k, count(*) OVER (PARTITION BY symbol, CAST(ts AS DATE)) - row_number() OVER dd AS togo,
   (close - open) / greatest(open, 0.01) * 100 AS change, volume / avg(volume) OVER (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING) AS busy FROM e
  WINDOW s AS (PARTITION BY symbol ORDER BY ts), dd AS (PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts)),
 st AS (SELECT *, sum(CASE WHEN (high - low) / greatest(open, 0.01) * 100 < 0.3 AND busy > 1.5 THEN 0 ELSE 1 END) OVER (PARTITION BY symbol, day ORDER BY ts) AS brk, (high - low) / greatest(open, 0.01) * 100 < 0.3 AND busy > 1.5 AS still FROM b),
 a AS (SELECT symbol, ts, i, CASE WHEN change > 0 THEN 'fast_rise' ELSE 'fast_fall' END AS kind, change, busy FROM b WHERE i >= 20 AND busy > 2 AND abs(change) >= 1.5
  UNION ALL SELECT symbol, min(ts), min(i), 'support_sideways', (arg_max(close, ts) / greatest(arg_min(close, ts), 0.01) - 1) * 100, avg(busy) FROM st WHERE still GROUP BY symbol, day, brk HAVING count(*) >= 6
  UNION ALL SELECT symbol, ts, i, 'tail_attack', moved, busy FROM (SELECT symbol, day, min(ts) AS ts, min(i) AS i, (arg_max(close, ts) - arg_min(open, ts)) / greatest(arg_min(open, ts), 0.01) * 100 AS moved, avg(busy) AS busy,
    count(*) FILTER (close > open) AS up, count(*) FILTER (close < open) AS down FROM b WHERE togo < 6 GROUP BY symbol, day) t WHERE abs(moved) >= 1 AND CASE WHEN moved > 0 THEN up ELSE down END >= 3
  UNION ALL SELECT symbol, ts, i, 'open_charge', change, busy FROM (SELECT * FROM b WHERE k < 12 AND change >= 1 AND busy > 3 QUALIFY row_number() OVER (PARTITION BY symbol, day ORDER BY ts) = 1) c)"""
QUERIES["intraday_actions"] = intraday_actions
SQL["intraday_actions"] = f"WITH {_BARS_SQL} SELECT symbol, ts, kind, round(change, 4) AS change, round(busy, 4) AS busy FROM a"
QUERIES["trigger_rules"] = trigger_rules
SQL["trigger_rules"] = f"""WITH {_BARS_SQL},
 m AS (SELECT *, sum(close * volume) OVER d / sum(volume) OVER d AS vwap, avg(close) OVER w21 AS m21, avg(close) OVER w6 AS m6, stddev_pop(close) OVER w21 AS sd, first_value(open) OVER d AS o1, max(high) OVER d AS hi, min(low) OVER d AS lo,
   avg(volume) OVER w21 AS v21, lag((high - greatest(open, close)) / greatest(high - low, 0.001), 1, 0) OVER (PARTITION BY symbol ORDER BY ts) AS shadow FROM b
  WINDOW d AS (PARTITION BY symbol, day ORDER BY ts), w21 AS (PARTITION BY symbol ORDER BY ts ROWS 20 PRECEDING), w6 AS (PARTITION BY symbol ORDER BY ts ROWS 5 PRECEDING)),
 f AS (SELECT symbol, i, (close - vwap) / greatest(vwap, 0.01) * 100 AS vd, (close - m21) / greatest(m21, 0.01) * 100 AS md, (close - o1) / greatest(o1, 0.01) * 100 AS od,
   CASE WHEN hi > lo THEN (close - lo) / (hi - lo) ELSE 0.5 END AS pl, volume / v21 AS vr, abs(close - round(close)) / greatest(close, 0.01) < 0.005 AS whole, abs(m6 - m21) / greatest(m21, 0.01) * 100 AS mg, shadow, round(2 * sd / greatest(m21, 0.01), 9) AS w FROM m),
 r AS (SELECT x.symbol, x.i, avg(CASE WHEN y.w <= x.w THEN 1.0 ELSE 0.0 END) AS wr FROM f x JOIN f y ON y.symbol = x.symbol AND y.i BETWEEN x.i - 40 AND x.i GROUP BY ALL),
 c AS (SELECT symbol, i, unnest([{", ".join(f"'{n}'" for n in CONDITIONS)}]) AS name, unnest([vd > -1 AND vd < 0.5, vd < -1 AND pl < 0.4, wr < 0.25, whole, vr < 0.6 AND pl > 0.3 AND pl < 0.7, vr > 2 AND pl < 0.3, shadow > 0.5,
   mg < 0.5 AND md > -2 AND md < 2, vd > -0.5 AND vd < 0.5 AND mg < 1, od < -1 AND pl < 0.5]) AS holds, generate_subscripts([{", ".join("1" * len(CONDITIONS))}], 1) AS at FROM f JOIN r USING (symbol, i)),
 h AS (SELECT symbol, i, name AS rule FROM c WHERE holds UNION ALL SELECT p.symbol, p.i, p.name || ' & ' || q.name FROM c p JOIN c q ON q.symbol = p.symbol AND q.i = p.i AND q.at > p.at WHERE p.holds AND q.holds),
 x AS (SELECT b.symbol, b.i, n.kind, EXISTS (SELECT 1 FROM a WHERE a.symbol = b.symbol AND a.i = b.i AND a.kind = n.kind) AS acts FROM b, (SELECT unnest(['fast_rise', 'fast_fall', 'support_sideways', 'tail_attack', 'open_charge']) AS kind) n WHERE b.i >= 13),
 t AS (SELECT symbol, kind, count(*) FILTER (acts) AS actions, count(*) FILTER (NOT acts) AS others FROM x GROUP BY ALL),
 g AS (SELECT x.symbol, x.kind, h.rule, count(*) FILTER (acts) AS hits, count(*) FILTER (NOT acts) AS other_hits FROM x JOIN h ON h.symbol = x.symbol AND h.i = x.i - 3 GROUP BY ALL)
 SELECT symbol, kind, rule, actions, round(hits / actions, 4) AS hit_rate, round(other_hits / greatest(others, 1), 4) AS other_rate, round(hits / actions / greatest(other_hits / greatest(others, 1), 0.001), 4) AS lift
 FROM g JOIN t USING (symbol, kind) WHERE actions >= 20 AND hits / actions >= 0.1 AND hits / actions / greatest(other_hits / greatest(others, 1), 0.001) >= 1.3"""
