"""Relational operators: filters, projections, joins, aggregations, set operations, sorts and SQL windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.bars import daily_bars
from tickloom.functions import windows as W
from tickloom.operators.rolling import r
from tickloom.plans.sql import daily, over
from tickloom.sources.tables import table, upserted

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query("SELECT p_brand AS symbol, count(*) AS n, CAST(min(l_shipdate) AS DATE) AS d, CAST(max(l_shipdate) AS DATE) AS last_d FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') GROUP BY 1")
def scan_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars' trades of a few symbols between dates; date bounds and the symbol list reach the scans."""
    t = table(spark, sf_dir, "lineitem").where("l_shipdate >= timestamp_ntz'1996-01-01' and l_shipdate < timestamp_ntz'1997-01-01'")
    p = table(spark, sf_dir, "part").where(F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#13"))
    j = t.join(p, F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy(F.col("p_brand").alias("symbol")).agg(F.count("*").alias("n"), F.to_date(F.min("l_shipdate")).alias("d"), F.to_date(F.max("l_shipdate")).alias("last_d"))


@query("SELECT DISTINCT p_brand AS symbol FROM part WHERE p_brand NOT LIKE 'Brand#1%' AND p_brand NOT LIKE 'Brand#2%'")
def scan_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbols there are, without those of given prefixes."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("symbol"))
    return p.where(~F.col("symbol").startswith("Brand#1") & ~F.col("symbol").startswith("Brand#2")).distinct()


@query(f"WITH {daily()} SELECT symbol, d, round(close, 6) AS close, row_number() OVER (PARTITION BY symbol ORDER BY d DESC) AS age FROM bars QUALIFY age <= 20")
def scan_last_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 20 bars of each symbol; the rank limit is applied within tasks before the exchange."""
    latest = Window.partitionBy("symbol").orderBy(F.desc("d"))
    b = daily_bars(spark, sf_dir).select("symbol", "d", r("close", "close"), F.row_number().over(latest).cast("long").alias("age"))
    return b.where("age <= 20")


@query(f"WITH {daily()} SELECT max(d) AS d, count(DISTINCT symbol) AS symbols, count(*) AS n, count(DISTINCT symbol) FILTER (WHERE d >= DATE '1998-01-01') AS recent FROM bars")
def scan_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = daily_bars(spark, sf_dir)
    return b.agg(F.max("d").alias("d"), F.countDistinct("symbol").alias("symbols"), F.count("*").alias("n"), F.countDistinct(F.when(F.col("d") >= F.lit("1998-01-01").cast("date"), F.col("symbol"))).alias("recent"))


BOARD = "CASE WHEN symbol LIKE '%1' THEN 9.5 WHEN symbol LIKE '%2' THEN 19.5 ELSE 29.5 END"


@query(f"""WITH {daily()}, p AS (SELECT *, (close / nullif(lag(close) {over()}, 0) - 1) * 100 AS chg, count(*) OVER (PARTITION BY symbol) AS n FROM bars)
 SELECT symbol, d, round(chg, 6) AS chg, chg >= CAST({BOARD} AS DOUBLE) AS limit_up, close < 1000 AS low_price, n >= 250 AS long_history FROM p WHERE chg IS NOT NULL""")
def filters_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limit-up by the board's own bound, low price and minimum history, as flags."""
    board = F.when(F.col("symbol").endswith("1"), 9.5).when(F.col("symbol").endswith("2"), 19.5).otherwise(29.5)
    p = daily_bars(spark, sf_dir).select("symbol", "d", "close", W.change("close").alias("chg"), F.count("*").over(Window.partitionBy("symbol")).alias("n"))
    return p.where("chg is not null").select("symbol", "d", r("chg", "chg"), (F.col("chg") >= board).alias("limit_up"), (F.col("close") < 1000).alias("low_price"), (F.col("n") >= 250).alias("long_history"))


@query("""SELECT c_custkey AS id, regexp_matches(c_name, '(?i)0{3}[1-5]') AS by_pattern, c_mktsegment LIKE '%MACH%' AS by_like,
 (contains(lower(c_mktsegment), 'auto') OR contains(lower(c_mktsegment), 'house')) AND NOT contains(lower(c_name), '00001') AS by_keyword,
 CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 2500 THEN 'low' WHEN c_acctbal < 7500 THEN 'middle' ELSE 'high' END AS bucket,
 greatest(least(c_acctbal / 100, 50.0::DOUBLE), -5.0::DOUBLE) AS clipped FROM customer""")
def filters_text_and_ladders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pattern, LIKE and keyword predicates with a white list; a ladder of buckets; clipping."""
    name, segment, balance = F.col("c_name"), F.col("c_mktsegment"), F.col("c_acctbal")
    word = F.lower(segment).contains("auto") | F.lower(segment).contains("house")
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), name.rlike("(?i)0{3}[1-5]").alias("by_pattern"), segment.like("%MACH%").alias("by_like"),
        (word & ~F.lower(name).contains("00001")).alias("by_keyword"),
        F.when(balance < 0, "debt").when(balance < 2500, "low").when(balance < 7500, "middle").otherwise("high").alias("bucket"),
        W.clip(balance / 100, -5.0, 50.0).alias("clipped"),
    )


@query("""SELECT c_custkey AS id, 'C' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 6, '0') || CASE c_nationkey % 3 WHEN 0 THEN '.SH' WHEN 1 THEN '.SZ' ELSE '.BJ' END AS code,
 CASE WHEN c_nationkey % 3 = 2 THEN 'north' WHEN lpad(CAST(c_custkey % 1000 AS VARCHAR), 6, '0') LIKE '0003%' THEN 'growth' WHEN lpad(CAST(c_custkey % 1000 AS VARCHAR), 6, '0') LIKE '0006%' THEN 'science' ELSE 'main' END AS board,
 coalesce(round(c_acctbal / nullif(c_nationkey, 0), 6), 0) AS safe_ratio, try_cast(right(c_name, 3) AS DOUBLE) AS parsed FROM customer""")
def symbol_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes normalised with a venue suffix, boards by prefix, guarded division and casts."""
    digits = F.lpad((F.col("c_custkey") % 1000).cast("string"), 6, "0")
    k = F.col("c_nationkey") % 3
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.concat(F.lit("C"), digits, F.when(k == 0, ".SH").when(k == 1, ".SZ").otherwise(".BJ")).alias("code"),
        F.when(k == 2, "north").when(digits.startswith("0003"), "growth").when(digits.startswith("0006"), "science").otherwise("main").alias("board"),
        F.coalesce(F.round(F.try_divide("c_acctbal", "c_nationkey"), 6), F.lit(0.0)).alias("safe_ratio"), F.expr("try_cast(right(c_name, 3) as double)").alias("parsed"),
    )


@query("""SELECT c_custkey, coalesce(n_name, 'unknown') AS nation, o.n_orders, round(o.spent, 4) AS spent FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
 LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, sum(o_totalprice) AS spent FROM orders GROUP BY 1) o ON o_custkey = c_custkey""")
def join_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left joins with a default; orders are summed before they are joined."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"), r("spent", F.sum("o_totalprice"), 4))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    j = c.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(o, F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.select("c_custkey", F.coalesce("n_name", F.lit("unknown")).alias("nation"), "n_orders", "spent")


@query("""SELECT o_custkey AS custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS orderkey, round(arg_max(o_totalprice, (o_orderdate, o_orderkey)), 4) AS price FROM orders GROUP BY 1""")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest row of each key, by an aggregate of the ordering struct instead of a sort of all rows."""
    at = F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_orderdate", "o_orderkey"))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(at.alias("x")).select("custkey", F.col("x.o_orderkey").alias("orderkey"), r("price", "x.o_totalprice", 4))


@query(f"""WITH {daily()}, {daily("p_type", "sectors")}
 SELECT b.symbol, b.d, max(x.d) AS as_of_d FROM bars b LEFT JOIN (SELECT DISTINCT d FROM sectors WHERE extract(dow FROM d) = 1) x ON x.d <= b.d GROUP BY 1, 2""")
def join_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest Monday with sector bars on or before each bar: the running value of a calendar, joined by date.

    The calendar has one row a day, so its window in one task is bounded by time, not by symbols.
    """
    b = daily_bars(spark, sf_dir).select("symbol", "d")
    marks = daily_bars(spark, sf_dir, "p_type").select("d").distinct().where(F.dayofweek("d") == 2).withColumn("at", F.col("d"))
    days = b.select("d").distinct().join(marks, "d", "full")
    asof = days.select("d", F.last("at", ignorenulls=True).over(Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)).alias("as_of_d"))
    return b.join(asof, "d").select("symbol", "d", "as_of_d")


@query(f"""WITH {daily()}, c AS (SELECT d, row_number() OVER (ORDER BY d) AS n FROM (SELECT DISTINCT d FROM bars))
 SELECT a.symbol, a.d, e.d AS exit_d, round((y.close / a.close - 1) * 100, 6) AS ret FROM bars a JOIN c ON c.d = a.d JOIN c e ON e.n = c.n + 5 JOIN bars y ON y.symbol = a.symbol AND y.d = e.d""")
def join_sessions_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each bar with the same symbol's bar five sessions of the market's calendar later.

    The calendar has one row a day, so its numbering in one task is bounded by time, not by symbols.
    """
    b = daily_bars(spark, sf_dir).select("symbol", "d", "close")
    c = b.select("d").distinct().select("d", F.row_number().over(Window.orderBy("d")).alias("n"))
    later = c.select((F.col("n") - 5).alias("n"), F.col("d").alias("exit_d"))
    y = b.select("symbol", F.col("d").alias("exit_d"), F.col("close").alias("exit"))
    return b.join(c, "d").join(later, "n").join(y, ["symbol", "exit_d"]).select("symbol", "d", "exit_d", r("ret", (W.ratio("exit", "close") - 1) * 100))


@query("""SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') AS urgent FROM customer
 WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)""")
def join_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semi and anti joins: customers without very large orders, flagged by urgent ones."""
    o = table(spark, sf_dir, "orders")
    big = o.where("o_totalprice > 400000").select("o_custkey")
    urgent = o.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("urgent", F.lit(True))
    c = table(spark, sf_dir, "customer").select("c_custkey").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return c.join(urgent, "c_custkey", "left").select("c_custkey", F.coalesce("urgent", F.lit(False)).alias("urgent"))


@query("""WITH k(word, sector, priority) AS (VALUES ('ECON', 'economy', 1), ('STEEL', 'metal', 2), ('BRASS', 'metal', 3), ('STANDARD', 'base', 4), ('PROMO', 'promotion', 5))
 SELECT p_type AS industry, arg_min(sector, priority) AS sector, count(DISTINCT p_partkey) AS parts FROM part LEFT JOIN k ON contains(p_type, word) OR contains(word, p_type) GROUP BY 1""")
def join_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Industries matched to sectors by containment either way; the first rule that matches wins.

    Distinct industries are matched, not parts, and the rules are a literal table.
    """
    rules = [("ECON", "economy", 1), ("STEEL", "metal", 2), ("BRASS", "metal", 3), ("STANDARD", "base", 4), ("PROMO", "promotion", 5)]
    k = spark.createDataFrame(rules, "word string, sector string, priority int")
    p = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("industry")).agg(F.count_distinct("p_partkey").alias("parts"))
    hit = p.join(F.broadcast(k), F.col("industry").contains(F.col("word")) | F.col("word").contains(F.col("industry")), "left")
    return hit.groupBy("industry").agg(F.min_by("sector", "priority").alias("sector"), F.max("parts").alias("parts"))


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n,
 count(*) FILTER (WHERE l_quantity > 25) AS n_large, round(sum(l_extendedprice) FILTER (WHERE l_discount > 0.05), 2) AS discounted,
 round(stddev_samp(l_quantity), 6) AS sd, round(stddev_samp(l_quantity) FILTER (WHERE l_tax > 0.04), 6) AS sd_taxed FROM lineitem GROUP BY 1, 2 HAVING count(*) > 10""")
def aggregate_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums, means, deviations and counts with filters of their own, and a condition on groups."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus")
    out = g.agg(
        F.sum("l_quantity").alias("sum_qty"), r("sum_price", F.sum("l_extendedprice"), 2), r("avg_disc", F.avg("l_discount")), F.count("*").alias("n"),
        F.count_if(F.col("l_quantity") > 25).alias("n_large"), r("discounted", F.sum(F.when(F.col("l_discount") > 0.05, F.col("l_extendedprice"))), 2),
        r("sd", F.stddev_samp("l_quantity")), r("sd_taxed", F.stddev_samp(F.when(F.col("l_tax") > 0.04, F.col("l_quantity")))),
    )
    return out.where("n > 10")


@query("""WITH k AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2), m AS (SELECT p_brand, arg_max(p_size, (n, -p_size)) AS mode_size FROM k GROUP BY 1)
 SELECT p_brand AS symbol, round(quantile_cont(p_retailprice, 0.1), 6) AS q10, round(quantile_cont(p_retailprice, 0.5), 6) AS q50, round(quantile_cont(p_retailprice, 0.9), 6) AS q90,
 max(mode_size) AS mode_size, count(DISTINCT p_type) AS types, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS type_list FROM part JOIN m USING (p_brand) GROUP BY 1""")
def aggregate_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles, the most frequent value (the smallest of several), distinct counts and sorted distinct lists."""
    g = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("symbol"))
    q = lambda p: F.round(F.percentile("p_retailprice", p), 6)
    return g.agg(
        q(0.1).alias("q10"), q(0.5).alias("q50"), q(0.9).alias("q90"), F.mode("p_size", True).alias("mode_size"),
        F.countDistinct("p_type").alias("types"), F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("type_list"),
    )


@query(f"""WITH {daily()}, f AS (SELECT symbol, d, (close / nullif(lag(close, 5) {over()}, 0) - 1) * 100 AS score, (lead(close, 5) {over()} / nullif(close, 0) - 1) * 100 AS ret FROM bars)
 SELECT floor(score / 5) * 5 AS bucket, count(*) AS n, round(avg(ret), 6) AS avg_ret, round(avg(CASE WHEN ret > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS win_rate FROM f WHERE score IS NOT NULL AND ret IS NOT NULL GROUP BY 1 HAVING count(*) >= 50""")
def aggregate_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets of five points of a score with mean result and win rate, from 50 rows on."""
    f = daily_bars(spark, sf_dir).select(W.change("close", 5).alias("score"), ((W.ratio(F.lead("close", 5).over(W.by_time()), "close") - 1) * 100).alias("ret")).where("score is not null and ret is not null")
    g = f.groupBy((F.floor(F.col("score") / 5) * 5).cast("double").alias("bucket"))
    return g.agg(F.count("*").alias("n"), r("avg_ret", F.avg("ret")), r("win_rate", F.avg((F.col("ret") > 0).cast("double")))).where("n >= 50")


@query("""WITH c AS (SELECT CAST(ts AS DATE) AS d, event_type, count(*) AS n FROM events GROUP BY 1, 2),
 s AS (SELECT *, avg(n) OVER w AS m, stddev_pop(n) OVER w AS sd FROM c WINDOW w AS (PARTITION BY event_type ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT d, event_type, n, round(m, 6) AS mean, round(sd, 6) AS sd, coalesce(abs(n - m) > 3 * sd, false) AS anomaly FROM s""")
def aggregate_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts against the mean and three deviations of all days before."""
    c = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("d"), "event_type").agg(F.count("*").alias("n"))
    w = Window.partitionBy("event_type").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)
    s = c.withColumns({"m": F.avg("n").over(w), "s": F.stddev_pop("n").over(w)})
    return s.select("d", "event_type", "n", r("mean", "m"), r("sd", "s"), F.coalesce(F.abs(F.col("n") - F.col("m")) > 3 * F.col("s"), F.lit(False)).alias("anomaly"))


@query(f"""WITH {daily()}, h AS (SELECT symbol, d, close, max(close) {over(first=-60, last=-20)} AS far_high, (lag(close, 10) {over()}) AS c10, row_number() {over()} AS rn FROM bars)
 SELECT symbol, d, round(far_high, 6) AS far_high, CASE WHEN c10 IS NULL THEN 'range' WHEN close > c10 * 1.02::DOUBLE THEN 'up' WHEN close < c10 * 0.98::DOUBLE THEN 'down' ELSE 'range' END AS phase, rn FROM h""")
def window_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame that lies wholly in the past, and the phase by the change over ten bars."""
    c, before = F.col("close"), W.ref("close", 10)
    phase = F.when(before.isNull(), "range").when(c > before * 1.02, "up").when(c < before * 0.98, "down").otherwise("range")
    b = daily_bars(spark, sf_dir)
    return b.select("symbol", "d", r("far_high", F.max("close").over(W.ahead(-60, -20))), phase.alias("phase"), W.row().cast("long").alias("rn"))


@query(f"""WITH {daily()}, x AS (SELECT symbol, d, (close / nullif(lag(close) {over()}, 0) - 1) * 100 AS chg FROM bars)
 SELECT symbol, d, row_number() OVER (PARTITION BY d ORDER BY chg DESC, symbol) AS place, round(percent_rank() OVER (PARTITION BY d ORDER BY chg), 6) AS share FROM x WHERE chg IS NOT NULL""")
def window_across(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks within a day's cross-section, ties by symbol."""
    x = daily_bars(spark, sf_dir).select("symbol", "d", W.change("close").alias("chg")).where("chg is not null")
    return x.select("symbol", "d", F.row_number().over(W.across().orderBy(F.desc("chg"), "symbol")).cast("long").alias("place"), r("share", F.percent_rank().over(W.across().orderBy("chg"))))


@query("""SELECT o_orderkey, o_orderpriority, round(o_totalprice, 2) AS price FROM orders ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey LIMIT 100""")
def sort_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the first hundred orders by priority class and price."""
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    o = table(spark, sf_dir, "orders").orderBy(rank, F.desc("o_totalprice"), "o_orderkey").limit(100)
    return o.select("o_orderkey", "o_orderpriority", r("price", "o_totalprice", 2))


@query("""SELECT o_custkey AS custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place, o_orderkey FROM orders QUALIFY place <= 3""")
def sort_top_in_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), F.row_number().over(w).cast("long").alias("place"), "o_orderkey").where("place <= 3")


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'O'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F')
 SELECT k, 'both' AS kind FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT k, 'only_open' FROM (SELECT k FROM a EXCEPT SELECT k FROM b) UNION ALL SELECT k, 'any' FROM (SELECT k FROM a UNION SELECT k FROM b)""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union, intersection and difference of key sets."""
    keys = lambda s: table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k")).distinct()
    a, b = keys("O"), keys("F")
    kind = lambda df, x: df.withColumn("kind", F.lit(x))
    return kind(a.intersect(b), "both").unionByName(kind(a.subtract(b), "only_open")).unionByName(kind(a.union(b).distinct(), "any"))


@query("""WITH n AS (SELECT o_custkey AS c_custkey, sum(o_totalprice) AS v FROM orders GROUP BY 1) SELECT c_custkey, round(coalesce(v, c_acctbal), 4) AS c_acctbal FROM customer LEFT JOIN n USING (c_custkey)
 UNION ALL SELECT c_custkey, round(v, 4) FROM n WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New values over old ones by key, as an upsert of a whole table."""
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.lit(0).alias("at"))
    new = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("c_acctbal"), F.lit(1).alias("at"))
    return upserted(old, new, ["c_custkey"], F.col("at")).select("c_custkey", r("c_acctbal", "c_acctbal", 4))
