"""Structures, labels, calibration and gates as SQL over daily bars, read by Spark and by the checking engine alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.bars import daily_bars
from tickloom.operators.scorers import register
from tickloom.plans.layers import doubles, duck
from tickloom.plans.sql import UP_TO_NOW, daily, over

QUERIES, SQL = {}, {}


def shared(name: str, doc: str, body: str, *tables: str) -> None:
    """A query whose CTEs and SELECT are plain SQL over {bars} and the named tables of the data folder."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        given = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
        if "{bars}" in body:
            given["bars"] = daily_bars(spark, sf_dir)
        return spark.sql(doubles(body), **given)

    run.__name__, run.__doc__ = name, doc
    QUERIES[name] = run
    text = duck(body)
    for t in ("bars", *tables):
        text = text.replace("{" + t + "}", t)
    head = f"WITH {daily()}, " if "{bars}" in body else "WITH "
    SQL[name] = head + text.removeprefix("WITH").lstrip()


def pct(a: str, b: str) -> str:
    return f"({a} / nullif({b}, 0) - 1) * 100"


def rnd(x: str, name: str, digits: int = 6) -> str:
    return f"round({x} + 0.00000001, {digits}) AS {name}"


# Bounds of the range locks, in percent of the low, and their windows
shared("lock_states", "Whether the latest bars of a symbol are locked in a range by two windows, for how long, and which way they left it.", f"""WITH
 a AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY d DESC) AS age, count(*) OVER (PARTITION BY symbol) AS n, avg(close) {over(20)} AS ma20, lag(close, 19) {over()} AS c20, lag(close, 29) {over()} AS c30 FROM {{bars}}),
 w AS (SELECT *, max(high) OVER (PARTITION BY symbol ORDER BY age ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top, min(low) OVER (PARTITION BY symbol ORDER BY age ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bottom FROM a WHERE age <= 80 AND n >= 30),
 r AS (SELECT *, (top - bottom) / nullif(bottom, 0) * 100 AS amp FROM w),
 g AS (SELECT symbol, max(CASE WHEN age = 15 THEN amp END) AS amp15, max(CASE WHEN age = 20 THEN amp END) AS amp20, max(CASE WHEN age = 30 THEN amp END) AS amp30, max(CASE WHEN age <= 40 THEN amp END) AS amp40,
  least(min(CASE WHEN amp > CASE WHEN age <= 20 THEN 15 ELSE 17 END THEN age END) - 1, 79) AS first_bad, max(CASE WHEN age < least(n, 80) THEN age END) AS longest,
  max(CASE WHEN age = 1 THEN close END) AS close, max(CASE WHEN age = 1 THEN ma20 END) AS ma20, max(CASE WHEN age = 1 THEN {pct('close', 'c20')} END) AS trend, max(CASE WHEN age = 1 THEN {pct('close', 'c30')} END) AS change30 FROM r GROUP BY symbol),
 m AS (SELECT avg(change30) AS market FROM g),
 s AS (SELECT g.*, market, amp15 <= 15 AND amp20 <= 15 AND amp40 <= 17 AS in_lock FROM g CROSS JOIN m)
 SELECT symbol, in_lock, {rnd('amp15', 'amp15')}, {rnd('amp20', 'amp20')}, {rnd('amp30', 'amp30')}, {rnd('amp40', 'amp40')}, CAST(coalesce(first_bad, longest) AS INT) AS lock_days,
  CASE WHEN in_lock THEN 'locked' WHEN close > ma20 AND trend > -3 THEN 'breakout_up' ELSE 'breakout_down' END AS state,
  CASE WHEN NOT in_lock THEN CASE WHEN amp15 > 15 THEN 'short_window' ELSE 'long_window' END WHEN market < -3 THEN 'strong_lock' WHEN market > 5 THEN 'weak_lock' WHEN change30 - market > 3 THEN 'gathering_strong' ELSE 'gathering' END AS verdict FROM s""")

shared("structure_breaks", "Rising pairs of swing highs, the lowest swing low strictly between as support, and how many of the last five supports the price broke.", f"""WITH
 a AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY d DESC) AS age FROM {{bars}}),
 x AS (SELECT *, row_number() {over()} AS i, count(*) OVER (PARTITION BY symbol) AS n FROM a WHERE age <= 400),
 p AS (SELECT *, high = max(high) {over(first=-15, last=15)} AND i > 15 AND i <= n - 15 AS is_high, low = min(low) {over(first=-15, last=15)} AND i > 15 AND i <= n - 15 AS is_low FROM x WHERE n >= 150),
 h AS (SELECT symbol, i, high, d FROM p WHERE is_high), l AS (SELECT symbol, i, low, d FROM p WHERE is_low),
 pairs AS (SELECT b.symbol, b.i AS i2, a.i AS i1, b.high AS h2, a.high AS h1 FROM h b JOIN h a ON a.symbol = b.symbol AND a.i < b.i AND b.high > a.high),
 v AS (SELECT pairs.symbol, i2, i1, h2, min(low) AS support FROM pairs JOIN l ON l.symbol = pairs.symbol AND l.i > i1 AND l.i < i2 GROUP BY pairs.symbol, i2, i1, h2),
 k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY i2 DESC, i1 DESC) AS place FROM v),
 now AS (SELECT symbol, max_by(close, i) AS price, max(CASE WHEN age <= 200 THEN high END) AS peak, min(CASE WHEN is_high THEN 1 END) AS any_high FROM p GROUP BY symbol),
 s AS (SELECT k.symbol, max(CASE WHEN place = 1 THEN support END) AS key_support, sum(CASE WHEN price < support THEN 1 ELSE 0 END) AS broken, max(CASE WHEN price < support THEN support END) AS highest, max(CASE WHEN place = 1 AND price < support THEN 1 ELSE 0 END) AS key_broken
  FROM k JOIN now ON now.symbol = k.symbol WHERE place <= 5 GROUP BY k.symbol),
 b AS (SELECT p.symbol, sum(CASE WHEN close < highest THEN 1 ELSE 0 END) AS days_below FROM p JOIN s ON s.symbol = p.symbol GROUP BY p.symbol),
 y AS (SELECT now.symbol, price, peak, key_support, broken, key_broken, days_below, {pct('price', 'peak')} AS drawdown FROM now LEFT JOIN s ON s.symbol = now.symbol LEFT JOIN b ON b.symbol = now.symbol)
 SELECT symbol, {rnd('key_support', 'key_support')}, CAST(broken AS INT) AS broken, CAST(days_below AS INT) AS days_below, {rnd('drawdown', 'drawdown')},
  CASE WHEN key_support IS NULL THEN 'no_key_support' WHEN broken >= 3 AND days_below > 60 THEN 'dead' WHEN drawdown < -40 AND broken >= 1 THEN 'dead' WHEN broken >= 2 AND days_below > 30 THEN 'dead'
   WHEN key_broken = 1 AND days_below > 20 THEN 'broken' WHEN key_broken = 1 THEN 'warning' ELSE 'intact' END AS status FROM y""")

_EXCESS = "CASE WHEN m0 > 0 AND mn > 0 THEN own - (mn - m0) / m0 * 100 END"
shared("label_excess_horizons", "Change over 2, 5, 10 and 20 bars beyond the market's, whose base is the first session after the bar; without a market figure 0, or the change alone.", f"""WITH
 m AS (SELECT d, avg(close) AS market FROM {{bars}} GROUP BY d),
 c AS (SELECT d, lead(market) OVER (ORDER BY d) AS m0, {', '.join(f'lead(market, {h}) OVER (ORDER BY d) AS m{h}' for h in (2, 5, 10, 20))} FROM m),
 y AS (SELECT symbol, d, close, {', '.join(f'lead(close, {h}) {over()} AS c{h}' for h in (2, 5, 10, 20))} FROM {{bars}}),
 z AS ({' UNION ALL '.join(f"SELECT symbol, y.d, {h} AS horizon, (c{h} - greatest(close, 0.01)) / greatest(close, 0.01) * 100 AS own, m0, m{h} AS mn FROM y JOIN c ON c.d = y.d WHERE c{h} IS NOT NULL" for h in (2, 5, 10, 20))})
 SELECT symbol, d, horizon, {rnd(f'coalesce({_EXCESS}, 0)', 'excess')}, {rnd(f'coalesce({_EXCESS}, own)', 'excess_or_own')} FROM z""")

# new 20-bar highs with what came of them; the same rows feed labels, signal quality, calibration and the grid of gates
_HISTORY = f"""s AS (SELECT symbol, d, close, coalesce(close > max(close) {over(first=-20, last=-1)}, false) AS fired, {', '.join(f'lead(close, {k}) {over()} AS c{k}' for k in (1, 2, 3, 5))}, {pct('close', f'lag(close, 5) {over()}')} AS mom5,
  max(high) {over(20)} AS zone_high, min(low) {over(20)} AS zone_low, volume / nullif(avg(volume) {over(first=-5, last=-1)}, 0) AS vr FROM {{bars}}),
 f AS (SELECT *, datediff(d, DATE '1990-01-01') AS day FROM s WHERE fired),
 hist AS (SELECT symbol, d, right(symbol, 1) AS archetype, close, mom5, vr, count(*) OVER (PARTITION BY symbol ORDER BY day RANGE BETWEEN 30 PRECEDING AND 1 PRECEDING) AS pushes, {pct('zone_high', 'zone_low')} AS width,
  {', '.join(f"{pct(f'c{k}', 'close')} AS ret{k}" for k in (1, 2, 3, 5))} FROM f),
 lab AS (SELECT *, CASE WHEN ret2 IS NULL THEN 'unknown' WHEN ret2 > 5 THEN 'strong_win' WHEN ret2 > 0 THEN 'weak_win' WHEN ret2 > -2 THEN 'flat' WHEN ret2 > -5 THEN 'weak_loss' ELSE 'strong_loss' END AS outcome,
  CASE WHEN ret2 > 5 THEN 'breakout' WHEN ret1 < -3 THEN 'quick_crash' WHEN ret2 < -2 THEN 'slow_fade' WHEN pushes >= 3 AND width > 0 AND width < 10 THEN 'flatline' ELSE 'normal' END AS deception FROM hist)"""


def history(name: str, doc: str, rest: str) -> None:
    shared(name, doc, f"WITH {_HISTORY}{rest}")
    SQL[name] = SQL[name].replace("datediff(d, DATE '1990-01-01')", "datediff('day', DATE '1990-01-01', d)")


history("label_outcomes", "New highs with the pushes of 30 days before, results after 1, 2, 3 and 5 bars, and the classes of outcome and deception.",
        f" SELECT symbol, d, pushes, {rnd('width', 'width')}, {', '.join(rnd(f'ret{k}', f'ret{k}') for k in (1, 2, 3, 5))}, outcome, deception FROM lab")

_BAD = "CASE WHEN deception NOT IN ('normal', 'breakout') THEN 1.0 ELSE 0.0 END"
history("signal_quality", "Quality of a signal by the share of deceptive ones before it, its own and its archetype's, and adjusted by the bar's volume.", f""",
 a AS (SELECT archetype, avg({_BAD}) AS kind_rate FROM lab GROUP BY archetype),
 o AS (SELECT *, count(*) {over(first=-1_000_000, last=-1)} AS total, avg({_BAD}) {over(first=-1_000_000, last=-1)} AS own_rate FROM lab),
 q AS (SELECT symbol, d, total, own_rate, kind_rate, vr, CASE WHEN total = 0 THEN 0.6 ELSE greatest(0.1, least(1.0, 1 - (own_rate * 0.6 + kind_rate * 0.4))) END AS quality, CASE WHEN total >= 5 THEN 'high' WHEN total >= 2 THEN 'medium' ELSE 'low' END AS confidence FROM o JOIN a ON a.archetype = o.archetype)
 SELECT symbol, d, total, {rnd('quality', 'quality')}, confidence, {rnd("greatest(0.05, least(1.0, quality + CASE WHEN vr > 1.5 THEN 0.1 WHEN vr < 0.7 THEN -0.1 ELSE 0.0 END * CASE confidence WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.5 ELSE 0.25 END))", 'adjusted')} FROM q""")

_SCORE = "greatest(0.0, least(100.0, 50 + coalesce(mom5, 0)))"
_SIGMOID = "CASE WHEN score < 20 THEN 0.05 ELSE least(0.65, greatest(0.05, 0.10 + 0.55 / (1 + exp(-(score - 50) / 15)))) END"
_BUCKETS = f""", t AS (SELECT symbol, d, archetype, {_SCORE} AS score, CASE WHEN ret3 > 0 THEN 1.0 ELSE 0.0 END AS win, CASE WHEN vr > 1 THEN 'busy' ELSE 'calm' END AS regime FROM lab WHERE ret3 IS NOT NULL),
 e AS (SELECT archetype FROM t GROUP BY archetype HAVING count(*) >= 10),
 b AS (SELECT t.archetype, CAST(floor(score / 5) * 5 AS INT) AS lo, count(*) AS samples, avg(win) AS rate FROM t JOIN e ON e.archetype = t.archetype GROUP BY 1, 2)"""
history("calibration_curve", "Win rates of buckets of five points by archetype, and whether they rise throughout.", f"""{_BUCKETS},
 l AS (SELECT *, lag(rate) OVER (PARTITION BY archetype ORDER BY lo) AS before FROM b)
 SELECT archetype, lo, samples, {rnd('rate', 'rate')}, min(CASE WHEN rate < before THEN 0 ELSE 1 END) OVER (PARTITION BY archetype) = 1 AS monotone FROM l""")
history("calibrated_probability", "Probability of a signal: its bucket's win rate, blended with a sigmoid where samples are few, with floors and bounds; by regime where that has ten samples.", f"""{_BUCKETS},
 br AS (SELECT t.archetype, regime, CAST(floor(score / 5) * 5 AS INT) AS lo, count(*) AS samples, avg(win) AS rate FROM t JOIN e ON e.archetype = t.archetype GROUP BY 1, 2, 3 HAVING count(*) >= 10),
 j AS (SELECT t.*, coalesce(br.rate, b.rate) AS rate, coalesce(br.samples, b.samples, 0) AS samples, br.rate IS NOT NULL AS by_regime FROM t LEFT JOIN b ON b.archetype = t.archetype AND b.lo = CAST(floor(score / 5) * 5 AS INT) LEFT JOIN br ON br.archetype = t.archetype AND br.regime = t.regime AND br.lo = CAST(floor(score / 5) * 5 AS INT)),
 g AS (SELECT *, {_SIGMOID} AS curve, least(1.0, samples / 10.0) AS weight FROM j),
 p AS (SELECT *, coalesce(rate, 0) * weight + curve * (1 - weight) AS blend FROM g)
 SELECT symbol, d, {rnd('score', 'score')}, by_regime, {rnd('least(0.78, greatest(0.05, greatest(blend, CASE WHEN score > 35 THEN 0.15 WHEN score > 20 THEN 0.08 ELSE 0.0 END)))', 'probability')} FROM p""")

# The grid of gates
_GRID = " UNION ALL ".join(f"SELECT {sq} AS sq, {wp} AS wp, {trend} AS trend" for sq in ("0.5", "0.55", "0.6", "0.65", "0.7") for wp in ("0.40", "0.45", "0.50", "0.55") for trend in (2, 3, 4))
history("grid_gates", "Mean results behind every gate of a grid over estimated quality, win probability and trend; rows are counted by cell before the grid meets them.", f""",
 est AS (SELECT least(0.9, greatest(0.1, 0.75 - pushes * 0.05)) AS sq, floor(least(0.7, greatest(0.2, ({_SCORE} - 30) / 100 + 0.3)) * 20 + 0.000001) / 20 AS wp, CASE WHEN width > 8 THEN 2 ELSE 3 END AS trend, coalesce(ret2, 0) AS ret FROM lab),
 cells AS (SELECT sq, wp, trend, count(*) AS n, sum(ret) AS total FROM est GROUP BY sq, wp, trend), grid AS ({_GRID}), every AS (SELECT sum(n) AS n FROM cells)
 SELECT grid.sq, grid.wp, grid.trend, CAST(sum(cells.n) AS BIGINT) AS n, {rnd('sum(total) / sum(cells.n)', 'mean_return')}, {rnd('sum(cells.n) * 100.0 / max(every.n)', 'passing')}
 FROM grid JOIN cells ON cells.sq >= grid.sq - 0.000001 AND cells.wp >= grid.wp - 0.000001 AND cells.trend >= grid.trend CROSS JOIN every GROUP BY grid.sq, grid.wp, grid.trend HAVING sum(cells.n) >= 5""")

shared("recommendation_check", "The three strongest symbols of each session, checked 3, 5 and 15 sessions later (or at the next price within three days), with win rates.", f"""WITH
 c AS (SELECT d, row_number() OVER (ORDER BY d) AS n FROM (SELECT DISTINCT d FROM {{bars}}) u),
 k AS (SELECT symbol, d, close, row_number() OVER (PARTITION BY d ORDER BY mom DESC, symbol) AS place FROM (SELECT symbol, d, close, {pct('close', f'lag(close, 5) {over()}')} AS mom FROM {{bars}}) v WHERE mom IS NOT NULL),
 e AS (SELECT k.symbol, k.d, k.close, c.n, h.horizon FROM k JOIN c ON c.d = k.d CROSS JOIN (SELECT 3 AS horizon UNION ALL SELECT 5 UNION ALL SELECT 15) h WHERE place <= 3),
 t AS (SELECT e.*, c.d AS target FROM e JOIN c ON c.n = e.n + e.horizon),
 days AS ({' UNION ALL '.join(f'SELECT symbol, d, horizon, close, CAST(target + INTERVAL {k} DAY AS DATE) AS day FROM t' for k in range(4))}),
 x AS (SELECT t.symbol, t.d, t.horizon, t.close, min_by(b.close, b.d) AS sold FROM days t JOIN {{bars}} b ON b.symbol = t.symbol AND b.d = t.day GROUP BY t.symbol, t.d, t.horizon, t.close)
 SELECT horizon, count(*) AS verified, CAST(sum(CASE WHEN sold > close THEN 1 ELSE 0 END) AS BIGINT) AS profitable, {rnd('avg(CASE WHEN sold > close THEN 100.0 ELSE 0.0 END)', 'win_rate')}, {rnd(f"avg({pct('sold', 'close')})", 'mean_return', 4)} FROM x GROUP BY horizon""")

# Tiers of the gate by regime (probability, number and score of cold, then of hot candidates)
_TIERS = " UNION ALL ".join(f"SELECT '{r}' AS regime, {cp} AS cold_p, {cn} AS cold_n, {cs} AS cold_s, {hp} AS hot_p, {hn} AS hot_n, {hs} AS hot_s" for r, cp, cn, cs, hp, hn, hs in (
    ("rising", "0.28", 120, 38, "0.22", 120, 34), ("structural", "0.30", 100, 40, "0.25", 100, 36), ("sideways", "0.32", 80, 42, "0.26", 80, 38), ("stable", "0.35", 60, 42, "0.28", 60, 38),
    ("thin", "0.40", 30, 48, "0.30", 45, 44), ("weak", "0.48", 12, 54, "0.35", 30, 48), ("panic", "0.55", 6, 56, "0.40", 15, 50)))
shared("tiered_gate", "Candidates of every session that pass the gate of its regime, with the cap on cold ones, and relaxed where fewer than five pass.", f"""WITH
 x AS (SELECT symbol, d, greatest(0.0, least(100.0, 45 + {pct('close', f'lag(close, 5) {over()}')} / 4)) AS score, {pct('close', f'lag(close) {over()}')} AS chg, right(symbol, 1) IN ('1', '5') AS hot FROM {{bars}}),
 m AS (SELECT d, avg(chg) AS market, CASE WHEN avg(chg) > 60 THEN 'rising' WHEN avg(chg) > 40 THEN 'structural' WHEN avg(chg) > 25 THEN 'sideways' WHEN avg(chg) > 10 THEN 'stable' WHEN avg(chg) > 0 THEN 'thin' WHEN avg(chg) > -10 THEN 'weak' ELSE 'panic' END AS regime FROM x GROUP BY d),
 tiers AS ({_TIERS}),
 c AS (SELECT x.symbol, x.d, score, hot, m.regime, score / 120 AS p, cold_p, cold_n, cold_s, hot_s FROM x JOIN m ON m.d = x.d JOIN tiers ON tiers.regime = m.regime WHERE score IS NOT NULL),
 g AS (SELECT *, CASE WHEN hot THEN score >= hot_s ELSE score >= cold_s AND p >= cold_p END AS able FROM c),
 k AS (SELECT *, row_number() OVER (PARTITION BY d, able, hot ORDER BY score DESC, symbol) AS place FROM g),
 f AS (SELECT *, able AND (hot OR place <= cold_n) AS passed FROM k),
 n AS (SELECT *, sum(CASE WHEN passed THEN 1 ELSE 0 END) OVER (PARTITION BY d) AS total FROM f),
 o AS (SELECT *, row_number() OVER (PARTITION BY d, passed ORDER BY CASE WHEN score >= greatest(40, cold_s - 10) AND p >= greatest(0.30, cold_p - 0.12) THEN 0 ELSE 1 END, score DESC, symbol) AS spare FROM n)
 SELECT symbol, d, regime, hot, NOT passed AS relaxed, {rnd('score', 'score')} FROM o WHERE passed OR (total < 5 AND score >= greatest(40, cold_s - 10) AND p >= greatest(0.30, cold_p - 0.12) AND spare + total <= 10)""")

shared("volatility_ratio", "Deviation of the last bars' changes against that of some more, by position in the last 60 bars.", f"""WITH
 a AS (SELECT symbol, d, close, row_number() OVER (PARTITION BY symbol ORDER BY d DESC) AS age FROM {{bars}}),
 x AS (SELECT symbol, close / nullif(lag(close) OVER w, 0) - 1 AS ret, row_number() OVER w AS rn FROM a WHERE age <= 60 WINDOW w AS (PARTITION BY symbol ORDER BY d))
 SELECT symbol, {rnd('stddev_samp(CASE WHEN rn >= 56 THEN ret END) / nullif(stddev_samp(CASE WHEN rn >= 41 THEN ret END), 0)', 'hv_ratio')} FROM x WHERE ret IS NOT NULL GROUP BY symbol HAVING count(*) >= 20""")

shared("two_latest", "The last two results of a supplier and the change between them; the value before the last.", f"""WITH
 k AS (SELECT l_suppkey, l_shipdate, sum(l_extendedprice) AS v FROM {{lineitem}} GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC) AS rn FROM k),
 g AS (SELECT l_suppkey, max(CASE WHEN rn = 1 THEN v END) AS latest, max(CASE WHEN rn = 2 THEN v END) AS previous FROM r WHERE rn <= 2 GROUP BY l_suppkey)
 SELECT l_suppkey, {rnd('latest', 'latest', 4)}, {rnd('previous', 'previous', 4)}, {rnd(pct('latest', 'previous'), 'change')} FROM g""", "lineitem")

shared("first_named", "The first source that has a value: three lookups in turn.", """WITH
 a AS (SELECT o_custkey, max(o_orderpriority) AS v FROM {orders} WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey, max(o_orderpriority) AS v FROM {orders} WHERE o_orderstatus = 'P' GROUP BY 1)
 SELECT c_custkey, coalesce(a.v, b.v, c_mktsegment) AS name, CASE WHEN a.v IS NOT NULL THEN 1 WHEN b.v IS NOT NULL THEN 2 ELSE 3 END AS tier FROM {customer} LEFT JOIN a ON a.o_custkey = c_custkey LEFT JOIN b ON b.o_custkey = c_custkey""", "orders", "customer")

shared("soft_exclusions", "Customers without an unexpired exclusion: an order of high priority excludes until 90 days later, an urgent one for good.", """WITH
 e AS (SELECT o_custkey AS k, CASE WHEN o_orderpriority LIKE '1%' THEN NULL ELSE o_orderdate + INTERVAL 90 DAY END AS expires FROM {orders} WHERE o_orderpriority LIKE '1%' AND o_totalprice > 300000 OR o_orderpriority LIKE '2%'),
 now AS (SELECT max(o_orderdate) AS t FROM {orders}), x AS (SELECT DISTINCT k FROM e CROSS JOIN now WHERE expires IS NULL OR expires > t)
 SELECT c_custkey, c_mktsegment FROM {customer} LEFT ANTI JOIN x ON k = c_custkey""", "orders", "customer")
SQL["soft_exclusions"] = SQL["soft_exclusions"].replace("LEFT ANTI JOIN", "ANTI JOIN")

shared("not_in_array", "Suppliers that no list names; a null in a list names nobody.", """WITH
 lists AS (SELECT split('1,3,5,7,9,11', ',') AS xs UNION ALL SELECT split('2,4,', ',')), names AS (SELECT DISTINCT try_cast(x AS BIGINT) AS k FROM (SELECT explode(xs) AS x FROM lists) u)
 SELECT s_suppkey, s_nationkey FROM {supplier} LEFT ANTI JOIN names ON k = s_suppkey""", "supplier")
SQL["not_in_array"] = SQL["not_in_array"].replace("split('", "string_split('").replace("explode(", "unnest(").replace("LEFT ANTI JOIN", "ANTI JOIN")

shared("lead_lag", "Bars by which a symbol's daily change leads or follows the market's, within six either way, by the strongest correlation.", f"""WITH
 s AS (SELECT symbol, row_number() {over()} AS i, d, {pct('close', 'open')} AS x FROM {{bars}}),
 m AS (SELECT row_number() OVER (ORDER BY d) AS i, d, avg({pct('close', 'open')}) AS y FROM {{bars}} GROUP BY d),
 shifts AS ({' UNION ALL '.join(f'SELECT {k} AS shift' for k in range(-6, 7))}),
 j AS (SELECT s.symbol, shift, s.x, m.y FROM s CROSS JOIN shifts JOIN m ON m.i = s.i + shift),
 c AS (SELECT symbol, shift, corr(x, y) AS r, count(*) AS n FROM j GROUP BY symbol, shift HAVING count(*) >= 20),
 k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(abs(r), 9) DESC, abs(shift), shift) AS place FROM c)
 SELECT symbol, shift, {rnd('r', 'r')} FROM k WHERE place = 1""")

shared("vwap_slope", "Slope of the cumulative volume-weighted price over a symbol's bars of a month, in percent of its first open.", f"""WITH
 a AS (SELECT symbol, d, date_trunc('month', d) AS month, open, close * volume AS pv, volume FROM {{bars}}),
 w AS (SELECT symbol, month, d, open, row_number() OVER k AS i, sum(pv) OVER k / nullif(sum(volume) OVER k, 0) AS vwap FROM a WINDOW k AS (PARTITION BY symbol, month ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
 g AS (SELECT symbol, month, count(*) AS n, min_by(open, d) AS first_open, regr_slope(vwap, i) AS slope FROM w GROUP BY symbol, month)
 SELECT symbol, CAST(month AS DATE) AS month, n, {rnd('CASE WHEN n > 2 THEN slope / greatest(first_open, 0.01) * 100 ELSE 0.0 END', 'slope')} FROM g""")

shared("recency_shape", "Share of rising and falling bars over a symbol's last 20, and over its last five with weights that grow towards the end.", f"""WITH
 a AS (SELECT symbol, close, open, row_number() OVER (PARTITION BY symbol ORDER BY d DESC) AS age FROM {{bars}}),
 g AS (SELECT symbol, avg(CASE WHEN close > open THEN 1.0 ELSE 0.0 END) AS up, avg(CASE WHEN close < open THEN 1.0 ELSE 0.0 END) AS down,
  sum(CASE WHEN age <= 5 AND close > open THEN exp(-0.125 * (age - 1)) ELSE 0.0 END) / sum(CASE WHEN age <= 5 THEN exp(-0.125 * (age - 1)) ELSE 0.0 END) AS up5,
  sum(CASE WHEN age <= 5 AND close < open THEN exp(-0.125 * (age - 1)) ELSE 0.0 END) / sum(CASE WHEN age <= 5 THEN exp(-0.125 * (age - 1)) ELSE 0.0 END) AS down5 FROM a WHERE age <= 20 GROUP BY symbol)
 SELECT symbol, {rnd('up', 'up')}, {rnd('up5', 'up5')}, {rnd('greatest(-1.0, least(1.0, (up - down) * 0.6 + (up5 - down5) * 0.4))', 'score')} FROM g""")

shared("unadjusted_chunks", "Stretches of 20 bars or more without a jump of the adjustment factor or the two days after one.", f"""WITH
 a AS (SELECT symbol, d, close, 1 + floor((month(d) - 1) / 3) / 10 AS factor FROM {{bars}}),
 j AS (SELECT *, abs(factor - lag(factor) {over()}) > 0.01 AS jumped FROM a),
 k AS (SELECT *, max(CASE WHEN jumped THEN d END) {UP_TO_NOW} AS last_jump FROM j),
 f AS (SELECT *, coalesce(d <= last_jump + INTERVAL 2 DAY, false) AS affected FROM k),
 i AS (SELECT *, sum(CASE WHEN affected THEN 1 ELSE 0 END) {UP_TO_NOW} AS island FROM f)
 SELECT symbol, min(d) AS first_d, max(d) AS last_d, count(*) AS n FROM i WHERE NOT affected GROUP BY symbol, island HAVING count(*) >= 20""")

_SURGE = f"""x AS (SELECT *, row_number() {over()} AS i, lag(close) {over()} AS c1, lag(low) {over()} AS l1, CASE WHEN count(*) {over(20)} = 20 THEN avg(volume) {over(20)} END AS v20, lead(open) {over()} AS o_next, lead(close) {over()} AS c_next, lead(volume) {over()} AS v_next FROM {{bars}}),
 y AS (SELECT *, coalesce({pct('close', 'c1')} >= 7 AND volume / greatest(v20, 1) > 1.5, false) AS surge, coalesce({pct('close', 'c1')} >= 5 AND volume / greatest(v20, 1) > 1.5, false) AS big, least(low, l1) AS low2 FROM x)"""
shared("pattern_refueling", "A surge 4 to 14 bars back (the latest), a heavy falling bar above it, and quiet bars since that held its low.", f"""WITH {_SURGE},
 e AS (SELECT *, max(CASE WHEN surge THEN i END) {over(first=-14, last=-4)} AS at FROM y),
 j AS (SELECT e.symbol, e.d, e.i, e.close, e.open, s.i AS at, s.low2, s.close AS s_close, s.o_next, s.c_next, s.v_next, n.v20 AS v20_next, {pct('s.close', 's.c1')} AS gain FROM e JOIN y s ON s.symbol = e.symbol AND s.i = e.at JOIN y n ON n.symbol = e.symbol AND n.i = e.at + 1 WHERE e.i >= 20),
 g AS (SELECT j.symbol, j.d, j.i, j.close, j.open, j.low2, j.s_close, j.o_next, j.c_next, j.v_next, j.v20_next, j.gain, min(b.low) AS low_since, avg(CASE WHEN b.i <= j.i - 2 THEN b.volume END) AS quiet FROM j JOIN y b ON b.symbol = j.symbol AND b.i >= j.at + 2 AND b.i <= j.i GROUP BY ALL)
 SELECT symbol, d, CASE WHEN low_since > low2 * 0.995 THEN 9.0 ELSE 7.5 END AS score, {rnd('gain', 'gain')} FROM g
 WHERE c_next <= o_next AND o_next > s_close AND v_next / greatest(v20_next, 1) >= 2 AND low_since >= low2 * 0.98 AND NOT coalesce(quiet > v_next * 0.6, false) AND abs(close - open) / greatest(close, 0.01) * 100 <= 2""")
shared("pattern_unbroken", "A big bar 6 to 12 bars back whose low held on small volume and whose close the price is near to; the latest that qualifies.", f"""WITH {_SURGE},
 j AS (SELECT e.symbol, e.d, e.i, e.close, s.i AS big_at, s.low2, s.close AS s_close, s.volume AS s_volume FROM y e JOIN y s ON s.symbol = e.symbol AND s.i >= e.i - 12 AND s.i <= e.i - 6 WHERE s.big AND e.i >= 15),
 g AS (SELECT j.symbol, j.d, j.i, j.close, j.big_at, j.low2, j.s_close, j.s_volume, min(b.low) AS low_since, avg(b.volume) AS quiet FROM j JOIN y b ON b.symbol = j.symbol AND b.i > j.big_at AND b.i <= j.i GROUP BY ALL),
 q AS (SELECT *, row_number() OVER (PARTITION BY symbol, d ORDER BY big_at DESC) AS place FROM g WHERE low_since >= low2 * 0.98 AND quiet <= s_volume * 0.5 AND abs(close - s_close) / s_close * 100 < 3)
 SELECT symbol, d, CAST(i - big_at AS INT) AS days, CASE WHEN i - big_at >= 10 THEN 8.5 ELSE 7.0 END AS score, {rnd('least(1.0, 0.6 + (i - big_at) * 0.03)', 'confidence')} FROM q WHERE place = 1""")

shared("array_quality", "Rates of missing and infinite values and of valid ones, by symbol: changes, and ratios that may divide by zero.", f"""WITH
 a AS (SELECT symbol, {pct('close', f'lag(close) {over()}')} AS x FROM {{bars}})
 SELECT symbol, count(*) AS total, CAST(sum(CASE WHEN x IS NULL OR isnan(x) THEN 1 ELSE 0 END) AS BIGINT) AS missing, {rnd('avg(CASE WHEN x IS NULL OR isnan(x) THEN 0.0 ELSE 1.0 END)', 'valid_rate')} FROM a GROUP BY symbol""")

shared("safe_correlation", "Correlation of a symbol's change with its volume ratio in a month: 0 where there are too few rows or no deviation.", f"""WITH
 a AS (SELECT symbol, date_trunc('month', d) AS month, {pct('close', f'lag(close) {over()}')} AS x, volume / nullif(avg(volume) {over(20)}, 0) AS y FROM {{bars}}),
 g AS (SELECT symbol, month, count(*) AS n, stddev_pop(x) AS sx, stddev_pop(y) AS sy, covar_pop(x, y) AS c FROM a WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY symbol, month)
 SELECT symbol, CAST(month AS DATE) AS month, n, {rnd('CASE WHEN n < 2 OR sx < 0.000000001 OR sy < 0.000000001 THEN 0.0 ELSE c / (sx * sy) END', 'r')} FROM g""")

register(
    "bearish_confluence", "Seven bearish dimensions of a bar, their number and class.", ["k", "j", "dif", "rsi"], "rn >= 60",
    {"rn": f"row_number() {over()}", "c1": f"lag(close) {over()}", "c5": f"lag(close, 5) {over()}", "c10": f"lag(close, 10) {over()}", "low9": f"min(low) {over(9)}", "high9": f"max(high) {over(9)}",
     "x12": f"CASE WHEN row_number() {over()} = 1 THEN avg(close) {over(first=0, last=11)} ELSE close END", "x26": f"CASE WHEN row_number() {over()} = 1 THEN avg(close) {over(first=0, last=25)} ELSE close END",
     "ma5": f"avg(close) {over(5)}", "ma10": f"avg(close) {over(10)}", "ma20": f"avg(close) {over(20)}", "v5": f"avg(volume) {over(first=-5, last=-1)}", "v20": f"avg(volume) {over(first=-20, last=-1)}"},
    {"rsv": "CASE WHEN rn = 1 THEN 50.0 ELSE (close - low9) / greatest(high9 - low9, 0.0001) * 100 END", "g": "greatest(coalesce(close - c1, 0.0), 0.0)", "l": "greatest(coalesce(c1 - close, 0.0), 0.0)"},
    {"g0": f"CASE WHEN rn = 1 THEN avg(g) {over(first=0, last=13)} ELSE g END", "l0": f"CASE WHEN rn = 1 THEN avg(l) {over(first=0, last=13)} ELSE l END"},
    [("k", "rsv", 1 / 3), ("e", "k", 1 / 3), ("f12", "x12", 2 / 13), ("f26", "x26", 2 / 27), ("up", "g0", 2 / 15), ("down", "l0", 2 / 15)],
    {"dif": "f12 - f26", "d9": f"CASE WHEN rn = 1 THEN avg(f12 - f26) {over(first=0, last=8)} ELSE f12 - f26 END", "j": "3 * k - 2 * e", "rsi": "100 - 100 / (1 + up / greatest(down, 0.0001))",
     "chg1": pct("close", "c1"), "chg5": pct("close", "c5"), "chg10": pct("close", "c10")},
    [("dea", "d9", 0.2)],
    {"hist": "2 * (dif - dea)", "j_turning": f"coalesce(j < lag(j, 2) {over()}, false)", "rsi_turning": f"coalesce(rsi < lag(rsi, 2) {over()}, false)", "j_peak": f"max(j) {over(6)}",
     "hot": "CASE WHEN j > 95 THEN 1 ELSE 0 END + CASE WHEN rsi > 75 THEN 1 ELSE 0 END + CASE WHEN close > ma20 * 1.12 THEN 1 ELSE 0 END + CASE WHEN chg10 > 8 THEN 1 ELSE 0 END",
     "vr5": "volume / CASE WHEN v5 > 0 THEN v5 ELSE volume END", "flow": "CASE WHEN v20 > 0 THEN v5 / v20 ELSE 1.0 END"},
    {"score": "CASE WHEN k < e OR k < 20 OR e < 20 OR j < 0 OR j > 100 OR (j > 80 AND j_turning) THEN 1 ELSE 0 END + CASE WHEN hist < 0 OR dif < dea THEN 1 ELSE 0 END"
     " + CASE WHEN ma5 < ma10 OR close < ma20 OR (close < ma5 AND chg1 < -1) THEN 1 ELSE 0 END + CASE WHEN rsi < 50 OR (rsi > 70 AND rsi_turning) THEN 1 ELSE 0 END"
     " + CASE WHEN (vr5 > 1.3 AND chg1 < -1.5) OR flow < 0.65 OR (vr5 > 1.5 AND abs(chg1) < 0.8) THEN 1 ELSE 0 END + CASE WHEN chg1 < -5 OR chg5 < -3 OR (chg5 > 3 AND chg1 < -1.5) THEN 1 ELSE 0 END"
     " + CASE WHEN (hot >= 3 AND (j_turning OR rsi_turning)) OR (hot >= 2 AND j_peak > 105 AND j_turning) THEN 1 ELSE 0 END"},
    {"signal": "CASE WHEN score >= 3 THEN 'strong_sell' WHEN score >= 2 THEN 'sell' WHEN score >= 1 THEN 'weak' ELSE 'normal' END"},
    plain=["score", "signal"],
)

register(
    "score_dimensions", "MACD, stochastic line, relative strength, place in the bands and balance volume, each from 0 to 10 by pieces of lines.", ["macd_score", "kdj_score", "rsi_score", "boll_score", "obv_score"], "rn >= 24",
    {"rn": f"row_number() {over()}", "c1": f"lag(close) {over()}", "low9": f"min(low) {over(9)}", "high9": f"max(high) {over(9)}", "mid": f"avg(close) {over(20)}", "sd": f"stddev_samp(close) {over(20)}"},
    {"rsv": "coalesce((close - low9) / nullif(high9 - low9, 0) * 100, 50.0)", "gain": "CASE WHEN c1 IS NOT NULL THEN greatest(close - c1, 0.0) END", "loss": "CASE WHEN c1 IS NOT NULL THEN greatest(c1 - close, 0.0) END",
     "signed": "CASE WHEN close > c1 THEN volume WHEN close < c1 THEN -volume ELSE 0.0 END"},
    [("f12", "close", 2 / 13), ("f26", "close", 2 / 27), ("dea", "f12 - f26", 0.2), ("k", "rsv", 1 / 3), ("e", "k", 1 / 3), ("up", "gain", 1 / 24), ("down", "loss", 1 / 24)],
    {"obv": f"sum(signed) {UP_TO_NOW}", "j": "greatest(0.0, least(100.0, 3 * k - 2 * e))", "rsi": "100 - 100 / (1 + up / CASE WHEN down = 0 THEN 0.000000001 ELSE down END)",
     "place": "greatest(0.0, least(1.0, coalesce((close - (mid - 2 * sd)) / nullif(4 * sd, 0), 0.5)))"},
    {"obv20": f"avg(obv) {over(20)}", "macd_score": "greatest(0.0, least(10.0, 5 + (f12 - f26) * 0.5 + 2 * (f12 - f26 - dea) * 0.05))",
     "kdj_score": "CASE WHEN j < 20 THEN 10 - j / 20 * 2 WHEN j > 80 THEN 5 - (j - 80) / 20 * 3 ELSE 5 + (1 - abs(j - 50) / 30) * 2 END",
     "rsi_score": "CASE WHEN rsi < 30 THEN 8 + (30 - rsi) / 30 * 2 WHEN rsi > 70 THEN 5 - (rsi - 70) / 30 * 3 ELSE 5 + (1 - abs(rsi - 50) / 20) * 2 END",
     "boll_score": "CASE WHEN place < 0.1 THEN 9 - place * 10 WHEN place > 0.9 THEN 3 - (place - 0.9) * 10 WHEN place < 0.3 THEN 5 + (0.3 - place) / 0.2 * 2 WHEN place > 0.7 THEN 5 - (place - 0.7) / 0.2 * 2 ELSE 5 + (1 - abs(place - 0.5) / 0.2) * 2 END"},
    {"obv_score": "CASE WHEN obv > obv20 AND close > c1 THEN 7.5 WHEN obv > obv20 THEN 6.0 WHEN close < c1 THEN 3.0 ELSE 4.5 END"},
)
