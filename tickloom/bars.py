"""Bars: daily bars from trades, weekly and fixed-count resampling, hourly bars from events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.sources.tables import table

#: A total order of a day's trades: order and line numbers alone aren't unique.
TRADE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def ohlc(price: Column, order: Column) -> list[Column]:
    """open, high, low and close as aggregates of prices in an order."""
    return [F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close")]


def trades(spark: SparkSession, sf_dir: str, symbol: str = "p_brand") -> DataFrame:
    """symbol, d, price (in whole cents), volume, amount and the order within the day.

    Catalyst broadcasts part where its size allows, and sorts and merges where it doesn't.
    """
    part = table(spark, sf_dir, "part").select("p_partkey", F.col(symbol).alias("symbol"))
    t = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return t.select(
        "symbol", F.to_date("l_shipdate").alias("d"), (F.floor(F.col("l_extendedprice") * 100 / F.col("l_quantity")) / 100).alias("price"),
        F.col("l_quantity").alias("volume"), F.col("l_extendedprice").alias("amount"), F.struct(*TRADE_ORDER).alias("k"),
    )


def daily_bars(spark: SparkSession, sf_dir: str, symbol: str = "p_brand") -> DataFrame:
    """symbol, d, open, high, low, close, volume, amount: one shuffle by (symbol, d), combined before it."""
    sums = [F.sum("volume").alias("volume"), F.sum("amount").alias("amount")]
    return trades(spark, sf_dir, symbol).groupBy("symbol", "d").agg(*ohlc(F.col("price"), F.col("k")), *sums)


def weekly_bars(daily: DataFrame, least: int = 2) -> DataFrame:
    """ISO weeks of at least so many sessions: symbol, year, week, d (last session), OHLCV, sessions."""
    g = daily.groupBy("symbol", F.expr("extract(yearofweek from d)").alias("year"), F.weekofyear("d").alias("week"))
    out = g.agg(
        F.max("d").alias("d"), F.min_by("open", "d").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "d").alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("sessions"),
    )
    return out.where(F.col("sessions") >= least)


def counted_bars(daily: DataFrame, n: int) -> DataFrame:
    """Bars of n sessions each, counted from a symbol's first one."""
    w = Window.partitionBy("symbol").orderBy("d")
    k = daily.withColumn("bucket", F.floor((F.row_number().over(w) - 1) / n).cast("long"))
    return k.groupBy("symbol", "bucket").agg(
        F.min("d").alias("d"), F.min_by("open", "d").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "d").alias("close"), F.sum("volume").alias("volume"),
    )


def event_bars(events: DataFrame, width: str = "1 hour", key: str = "event_type") -> DataFrame:
    """OHLC of value and the number of events, by key and tumbling window; the same function serves streams."""
    order = F.struct("ts", "event_id")
    g = events.groupBy(F.col(key).alias("symbol"), F.window("ts", width).alias("w"))
    out = g.agg(*ohlc(F.col("value"), order), F.sum("value").alias("amount"), F.count("*").alias("n"))
    return out.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "amount", "n")
