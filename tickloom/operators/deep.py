"""Deep scores: weights resolved through fallbacks, weighted totals, scores within the archetype, and what is added to them.

Weights come as data: base beliefs, offsets and overrides by archetype, and a regime's own beliefs, which take part only
behind gates on samples, parameters and fit. Each weight carries the tier that it came from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.bars import daily_bars
from tickloom.functions import windows as W
from tickloom.plans.sql import daily, over

QUERIES, SQL = {}, {}

# Gates and share of a regime's beliefs, the least weight, a score that stands for a missing total, and the ladder
# of discounts by an archetype's win rate
LEAST_SAMPLES, LEAST_PARAMETERS, LEAST_FIT, BLEND, LEAST_WEIGHT, NO_TOTAL = 50, 10, 0.55, 0.5, 0.05, 50.0
DISCOUNTS = [(30, 0.65), (35, 0.78), (40, 0.88)]
LABELS = {"S1": ("bluechip", "defensive"), "S2": ("growth", "cyclical"), "S3": ("speculative", "small")}


def resolved_weights(base: DataFrame, offsets: DataFrame, overrides: DataFrame, beliefs: DataFrame, fits: DataFrame) -> DataFrame:
    """archetype, regime, param, weight, tier for every archetype of offsets and regime of fits, from base (param, value),
    offsets and overrides (archetype, param, offset), beliefs (regime, param, mu, n) and fits (regime, auc).

    A weight is the base value, changed by the archetype's offset or, before that, its override, and LEAST_WEIGHT at least;
    where the regime passes all gates and has a belief on the parameter, half of that is mixed in. tier is regime,
    override, offset or base.
    """
    kinds = offsets.select("archetype").distinct().join(base)  # archetypes and parameters: two short lists
    own = lambda df, name: df.select("archetype", "param", F.col("offset").alias(name))
    x = kinds.join(own(offsets, "_o"), ["archetype", "param"], "left").join(own(overrides, "_v"), ["archetype", "param"], "left")
    x = x.withColumn("_w", F.greatest(F.lit(LEAST_WEIGHT), F.round(F.col("value") * (1 + F.coalesce("_v", "_o", F.lit(0.0))), 4)))
    tier = F.when(F.col("_v").isNotNull(), "override").when(F.col("_o").isNotNull(), "offset").otherwise("base")
    gates = beliefs.groupBy("regime").agg(F.max("n").alias("_n"), F.count("*").alias("_p")).join(fits, "regime")
    open_ = gates.where((F.col("_n") >= LEAST_SAMPLES) & (F.col("_p") >= LEAST_PARAMETERS) & (F.col("auc") >= LEAST_FIT)).select("regime")
    believed = beliefs.join(open_, "regime").select("regime", "param", "mu")
    x = x.withColumn("tier", tier).join(fits.select("regime")).join(believed, ["regime", "param"], "left")
    weight = F.coalesce(F.round(F.col("_w") * (1 - BLEND) + F.col("mu") * BLEND, 4), F.col("_w"))
    return x.select("archetype", "regime", "param", weight.alias("weight"), F.when(F.col("mu").isNotNull(), "regime").otherwise(F.col("tier")).alias("tier"))


def totals(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """symbol, raw_total and tiers (of the weights used, in order of name) from scores (symbol, archetype, regime, param,
    score: 0 to 10, null where missing): ten times the weighted mean of the dimensions that are there."""
    x = scores.join(weights, ["archetype", "regime", "param"], "left")
    w = F.when(F.col("score").isNotNull(), F.coalesce("weight", F.lit(0.0)))
    used = F.array_sort(F.array_distinct(F.collect_list(F.when(F.col("score").isNotNull(), F.col("tier")))))
    x = x.groupBy("symbol", "archetype", "regime").agg(F.sum(w * F.col("score")).alias("_s"), F.sum(w).alias("_w"), F.concat_ws(",", used).alias("tiers"))
    return x.select("symbol", "archetype", "regime", F.round(F.when(F.col("_w") > 0, F.col("_s") / F.col("_w") * 10).otherwise(NO_TOTAL), 1).alias("raw_total"), "tiers")


def discount(win_rate: Column) -> Column:
    """What an archetype's total is multiplied by, by its win rate in percent (null: as of 50)."""
    rate, out = F.coalesce(win_rate, F.lit(50.0)), None
    for below, x in DISCOUNTS:
        out = F.when(rate < below, x) if out is None else out.when(rate < below, x)
    return out.when(rate >= 45, 1.05).otherwise(1.0)


def within_archetype(rows: DataFrame, total: str = "raw_total") -> DataFrame:
    """rows with base, from 0 to 100: the total itself for one alone, 50 where all are equal, deviations of 15 around 50
    for up to four, and else the place between the least and the greatest. Groups are counted by partial sums and joined."""
    x = F.col(total)
    g = rows.groupBy("archetype").agg(F.count("*").alias("_n"), F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.avg(x).alias("_m"), F.stddev_pop(x).alias("_sd"))
    few = F.when(F.col("_sd") > 0.1, (x - F.col("_m")) / F.col("_sd") * 15 + 50).otherwise(50.0)
    span = F.col("_hi") - F.col("_lo")
    base = F.when(F.col("_n") == 1, x).when(span <= 0.01, 50.0).when(F.col("_n") <= 4, few).otherwise((x - F.col("_lo")) / F.when(span > 0, span) * 100)
    return rows.join(g, "archetype").withColumn("base", F.round(W.clip(base, 0, 100), 1)).drop("_n", "_lo", "_hi", "_m", "_sd")


def composed(rows: DataFrame) -> DataFrame:
    """rows(base, sector_bonus, event_impact, fundamental, market_coef, sector_coef, predicted, rank) with composite,
    coef, adjusted, win_probability, quality, label and final: predictions of rises add 5 or 10 to the composite and of
    falls take 5 off; a rank from 0.7 adds 5, up to 0.3 takes 5 off. Missing parts count as nothing."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    x = rows.withColumn("composite", F.round(W.clip(zero("base") + zero("sector_bonus") * 1.5 + zero("event_impact") * 0.3 + zero("fundamental"), 0, 100), 1))
    x = x.withColumn("coef", F.coalesce("market_coef", F.lit(1.0)) * F.coalesce("sector_coef", F.lit(1.0)))
    x = x.withColumns({"adjusted": F.round(W.clip(F.col("composite") * F.col("coef"), 0, 100), 1), "win_probability": F.round(W.clip(F.col("composite") / 200 + 0.05, 0.05, 0.65), 4)})
    label = None
    for name, words in LABELS.items():
        hit = F.col("archetype").rlike("|".join(words))
        label = F.when(hit, name) if label is None else label.when(hit, name)
    predicted = F.when(F.col("predicted") > 5, 10).when(F.col("predicted") > 0, 5).when(F.col("predicted") < -3, -5).otherwise(0)
    ranked = F.when(F.col("rank") >= 0.7, 5).when(F.col("rank") <= 0.3, -5).otherwise(0)
    once = F.round(W.clip(F.col("composite") + predicted, 0, 100), 1)
    return x.withColumns({
        "quality": F.round(W.clip(F.col("composite") / 100 * 0.8 + F.col("win_probability") * 0.4, 0.1, 0.95), 3), "label": label, "final": F.round(W.clip(once + ranked, 0, 100), 1),
    })


# Stand-ins of the query: archetypes by a symbol's last digit, beliefs, offsets and regimes
_KINDS = ["large_bluechip", "growth_tech", "cyclical_resource", "value_defensive", "small_speculative"]
_BASE = {"technical": 1.5, "momentum": 1.2, "vol_ratio": 1.0, "trend": 2.0, "place": 0.8}
_OFFSETS = [("large_bluechip", "technical", -0.2), ("large_bluechip", "trend", 0.3), ("growth_tech", "momentum", 0.4), ("cyclical_resource", "place", 0.25), ("value_defensive", "vol_ratio", -0.3), ("small_speculative", "momentum", 0.2)]
_OVERRIDES = [("growth_tech", "technical", 0.1)]
_BELIEFS = [("rising", p, 1.0 + k / 10, 60) for k, p in enumerate(["momentum", "trend", "vol_ratio", *(f"other_{i}" for i in range(8))])] + [("falling", p, 2.0, 20) for p in _BASE]
_FITS = [("rising", 0.6), ("falling", 0.7)]
_COEFS = {"rising": 1.05, "falling": 0.85}


def deep_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deep scores of every symbol's latest bar, each part as a column. The market's regime is the sign of the mean change."""
    w = W.by_time()
    mean = lambda c, n: F.avg(c).over(w.rowsBetween(1 - n, 0))
    last = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("d")))
    x = daily_bars(spark, sf_dir).withColumns({"before": F.lag("close").over(w), "m5": mean("close", 5), "m20": mean("close", 20), "v20": mean("volume", 20), "hi": F.max("high").over(w.rowsBetween(-59, 0)), "lo": F.min("low").over(w.rowsBetween(-59, 0)), "age": last})
    x = x.where("age = 1").withColumn("change", (F.col("close") / F.col("before") - 1) * 100)
    digit = F.try_to_number(F.substring("symbol", -1, 1), F.lit("9")).cast("int")
    ten = lambda c: F.round(W.clip(c, 0, 10), 4)
    dims = {
        "technical": ten(5 + F.col("change") / 20), "momentum": F.when(F.col("close") > F.col("m5"), ten((F.col("close") / F.col("m5") - 1) * 10)), "vol_ratio": ten(F.col("volume") / F.col("v20") * 5),
        "trend": ten(5 + (F.col("m5") / F.col("m20") - 1) * 10), "place": ten((F.col("close") - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")) * 10),
    }
    x = x.select("symbol", "change", F.element_at(F.array(*map(F.lit, _KINDS)), digit % 5 + 1).alias("archetype"), *[c.alias(n) for n, c in dims.items()])
    regime = x.agg(F.when(F.avg("change") > 0, "rising").otherwise("falling").alias("regime"))
    x = x.join(F.broadcast(regime))
    long = x.select("symbol", "archetype", "regime", F.explode(F.array(*[F.struct(F.lit(n).alias("param"), F.col(n).alias("score")) for n in dims])).alias("s")).select("symbol", "archetype", "regime", "s.*")
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    weights = resolved_weights(
        frame(list(_BASE.items()), "param string, value double"), frame(_OFFSETS, "archetype string, param string, offset double"), frame(_OVERRIDES, "archetype string, param string, offset double"),
        frame(_BELIEFS, "regime string, param string, mu double, n int"), frame(_FITS, "regime string, auc double"),
    )
    rates = x.groupBy("archetype").agg((F.avg((F.col("change") > 0).cast("double")) * 100).alias("rate"))
    t = totals(long, weights).join(rates, "archetype").withColumn("discount", discount(F.col("rate"))).withColumn("discounted", F.round(F.col("raw_total") * F.col("discount"), 1))
    t = within_archetype(t, "discounted").join(x.select("symbol", "change", "vol_ratio"), "symbol")
    coef = F.element_at(F.create_map(*[F.lit(y) for p in _COEFS.items() for y in p]), F.col("regime"))
    t = t.withColumns({
        "sector_bonus": F.when(F.col("vol_ratio") > 5, 2.0), "event_impact": F.when(F.abs("change") > 50, 10.0), "fundamental": F.lit(None).cast("double"), "market_coef": coef,
        "sector_coef": F.when(F.col("rate") < 40, 0.9), "predicted": F.col("change") / 10, "rank": F.col("vol_ratio") / 10,
    })
    return composed(t).select("symbol", "archetype", "regime", "tiers", "raw_total", "discount", "base", "composite", F.round("coef", 4).alias("coef"), "adjusted", "win_probability", "quality", "label", "final")


def _rows(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x!r}::DOUBLE" if isinstance(x, float) else str(x) for x in row) + ")" for row in rows)


_ten = lambda x: f"round(greatest(0, least(10, {x})), 4)"
QUERIES["deep_scores"] = deep_scores
SQL["deep_scores"] = f"""WITH {daily()},
 k AS (SELECT *, (close / lag(close) {over()} - 1) * 100 AS change, avg(close) {over(5)} AS m5, avg(close) {over(20)} AS m20, avg(volume) {over(20)} AS v20, max(high) {over(60)} AS hi, min(low) {over(60)} AS lo, row_number() OVER (PARTITION BY symbol ORDER BY d DESC) AS age FROM bars),
 x AS (SELECT symbol, change, [{", ".join(f"'{n}'" for n in _KINDS)}][CAST(right(symbol, 1) AS INT) % 5 + 1] AS archetype, {_ten("5 + change / 20")} AS technical, CASE WHEN close > m5 THEN {_ten("(close / m5 - 1) * 10")} END AS momentum,
  {_ten("volume / v20 * 5")} AS vol_ratio, {_ten("5 + (m5 / m20 - 1) * 10")} AS trend, CASE WHEN hi > lo THEN {_ten("(close - lo) / (hi - lo) * 10")} END AS place FROM k WHERE age = 1),
 g AS (SELECT CASE WHEN avg(change) > 0 THEN 'rising' ELSE 'falling' END AS regime FROM x),
 base(param, v) AS (VALUES {_rows(list(_BASE.items()))}), off(archetype, param, o) AS (VALUES {_rows(_OFFSETS)}), ovr(archetype, param, o) AS (VALUES {_rows(_OVERRIDES)}), bel(regime, param, mu, n) AS (VALUES {_rows(_BELIEFS)}), fit(regime, auc) AS (VALUES {_rows(_FITS)}),
 ok AS (SELECT b.regime FROM bel b JOIN fit USING (regime) GROUP BY b.regime, auc HAVING max(n) >= 50 AND count(*) >= 10 AND auc >= 0.55),
 l AS (UNPIVOT x ON technical, momentum, vol_ratio, trend, place INTO NAME param VALUE score),
 ww AS (SELECT l.symbol, l.archetype, g.regime, l.score, greatest(0.05, round(v * (1 + coalesce(r.o, o.o, 0)), 4)) AS w, mu, CASE WHEN mu IS NOT NULL THEN 'regime' WHEN r.o IS NOT NULL THEN 'override' WHEN o.o IS NOT NULL THEN 'offset' ELSE 'base' END AS tier
  FROM l CROSS JOIN g JOIN base b ON b.param = l.param LEFT JOIN off o ON o.archetype = l.archetype AND o.param = l.param LEFT JOIN ovr r ON r.archetype = l.archetype AND r.param = l.param
  LEFT JOIN (SELECT bel.* FROM bel JOIN ok USING (regime)) q ON q.regime = g.regime AND q.param = l.param),
 t AS (SELECT symbol, archetype, regime, round(sum(coalesce(round(w * 0.5 + mu * 0.5, 4), w) * score) / sum(coalesce(round(w * 0.5 + mu * 0.5, 4), w)) * 10, 1) AS raw_total, string_agg(DISTINCT tier, ',' ORDER BY tier) AS tiers FROM ww GROUP BY ALL),
 ra AS (SELECT archetype, avg(CASE WHEN change > 0 THEN 100.0 WHEN change IS NOT NULL THEN 0 END) AS rate FROM x GROUP BY 1),
 d AS (SELECT t.*, rate, CASE WHEN rate < 30 THEN 0.65 WHEN rate < 35 THEN 0.78 WHEN rate < 40 THEN 0.88 WHEN rate >= 45 OR rate IS NULL THEN 1.05 ELSE 1.0 END AS discount FROM t JOIN ra USING (archetype)),
 e AS (SELECT *, round(raw_total * discount, 1) AS z FROM d),
 n AS (SELECT *, count(*) OVER p AS n, min(z) OVER p AS lo, max(z) OVER p AS hi, avg(z) OVER p AS m, stddev_pop(z) OVER p AS sd FROM e WINDOW p AS (PARTITION BY archetype)),
 b AS (SELECT *, round(greatest(0, least(100, CASE WHEN n = 1 THEN z WHEN hi - lo <= 0.01 THEN 50 WHEN n <= 4 THEN CASE WHEN sd > 0.1 THEN (z - m) / sd * 15 + 50 ELSE 50 END ELSE (z - lo) / (hi - lo) * 100 END)), 1) AS base FROM n),
 c AS (SELECT b.*, x.change, x.vol_ratio, round(greatest(0, least(100, base + CASE WHEN x.vol_ratio > 5 THEN 3 ELSE 0 END + CASE WHEN abs(x.change) > 50 THEN 3 ELSE 0 END)), 1) AS composite,
  CASE b.regime WHEN 'rising' THEN 1.05 ELSE 0.85 END * CASE WHEN rate < 40 THEN 0.9 ELSE 1 END AS coef FROM b JOIN x USING (symbol)),
 h AS (SELECT *, round(greatest(0.05, least(0.65, composite / 200 + 0.05)), 4) AS wp, round(greatest(0, least(100, composite + CASE WHEN change / 10 > 5 THEN 10 WHEN change / 10 > 0 THEN 5 WHEN change / 10 < -3 THEN -5 ELSE 0 END)), 1) AS one FROM c)
 SELECT symbol, archetype, regime, tiers, raw_total, discount::DOUBLE AS discount, base, composite, round(coef, 4)::DOUBLE AS coef, round(greatest(0, least(100, composite * coef)), 1) AS adjusted, wp AS win_probability,
  round(greatest(0.1, least(0.95, composite / 100 * 0.8 + wp * 0.4)), 3) AS quality, CASE WHEN archetype LIKE '%bluechip%' OR archetype LIKE '%defensive%' THEN 'S1' WHEN archetype LIKE '%growth%' OR archetype LIKE '%cyclical%' THEN 'S2' ELSE 'S3' END AS label,
  round(greatest(0, least(100, one + CASE WHEN vol_ratio >= 7 THEN 5 WHEN vol_ratio <= 3 THEN -5 ELSE 0 END)), 1) AS final FROM h"""
