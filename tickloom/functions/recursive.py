"""First-order recurrences along a symbol's bars: exponential means, Wilder's means, stochastic lines, zigzag.

A symbol's bars are one group of a grouped pass over Arrow batches, in order of time; the recurrences themselves are
pandas' compiled exponential means, linear in the number of rows. A group is one symbol's bars, a few thousand rows;
symbols are what the work is spread over. Rows that are dealt out by symbol already stay where they are.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def grouped(df: DataFrame, run, added: str, key: str = "symbol", time: str = "d") -> DataFrame:
    """df with the columns (DDL) that run(the rows of a key in order of time) adds."""
    schema = StructType(df.schema.fields + StructType.fromDDL(added).fields)
    names = schema.names

    def each(rows: pd.DataFrame) -> pd.DataFrame:
        return run(rows.sort_values(time, ignore_index=True))[names]

    return df.groupBy(key).applyInPandas(each, schema)


def recurrences(df: DataFrame, spec: list[tuple[str, str, float | str]], key: str = "symbol", time: str = "d") -> DataFrame:
    """df with y = alpha x + (1 - alpha) y for each (name of y, x, alpha), seeded with the first x that isn't null.

    x is an expression of columns and of recurrences before it; alpha a number, or a column that is constant in a key.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        for name, x, alpha in spec:
            a = float(rows[alpha].iloc[-1]) if isinstance(alpha, str) else alpha
            rows[name] = pd.to_numeric(rows.eval(x)).astype(float).ewm(alpha=a, adjust=False).mean()
        return rows

    return grouped(df, run, ", ".join(f"{name} double" for name, _, _ in spec), key, time)


def ema_alpha(span: int) -> float:
    return 2.0 / (span + 1)


def exponential(bars: DataFrame, alphas: dict[str, tuple[str, float]], key: str = "symbol", time: str = "d") -> DataFrame:
    """key, time and, for each name: (column, alpha), the recurrence y = alpha x + (1 - alpha) y, seeded with the first x."""
    columns = sorted({c for c, _ in alphas.values()})
    given = bars.select(key, time, *[F.col(c).cast("double").alias(f"_{c}") for c in columns])
    return recurrences(given, [(n, f"_{c}", a) for n, (c, a) in alphas.items()], key, time).drop(*[f"_{c}" for c in columns])


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """symbol, d, dif, dea and macd = 2 (dif - dea)."""
    spec = [("f", "close", ema_alpha(fast)), ("g", "close", ema_alpha(slow)), ("dea", "f - g", ema_alpha(signal))]
    out = recurrences(bars.select("symbol", "d", "close"), spec)
    return out.select("symbol", "d", (F.col("f") - F.col("g")).alias("dif"), "dea", (2 * (F.col("f") - F.col("g") - F.col("dea"))).alias("macd"))


def stochastic(rsv: DataFrame, start: float = 50.0) -> DataFrame:
    """symbol, d, k, d_line, j from rsv(symbol, d, rsv): k and d_line are means of weight 1/3 that start from 50."""

    def line(x: pd.Series) -> pd.Series:
        return pd.concat([pd.Series([start]), x]).ewm(alpha=1.0 / 3.0, adjust=False).mean().iloc[1:].reset_index(drop=True)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows["k"] = line(rows["rsv"])
        rows["d_line"] = line(rows["k"])
        return rows

    out = grouped(rsv.select("symbol", "d", "rsv"), run, "k double, d_line double").drop("rsv")
    return out.withColumn("j", 3 * F.col("k") - 2 * F.col("d_line"))


def zigzag(bars: DataFrame, percent: float = 5.0) -> DataFrame:
    """symbol, d, direction (1 up, -1 down, 0 none yet), extreme: the running extreme of the current leg.

    A leg turns once the close has moved by percent against its extreme.
    """
    up, down = 1 + percent / 100, 1 - percent / 100

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ways, extremes = [], []
        way, e = 0, None
        for c in rows["close"].tolist():
            if e is None:
                e = c
            elif way >= 0 and c <= e * down:
                way, e = -1, c
            elif way <= 0 and c >= e * up:
                way, e = 1, c
            elif way:
                e = max(e, c) if way > 0 else min(e, c)
            ways.append(way)
            extremes.append(e)
        rows["direction"], rows["extreme"] = ways, extremes
        return rows

    return grouped(bars.select("symbol", "d", "close"), run, "direction int, extreme double").drop("close")
