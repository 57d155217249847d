"""Pieces of the DuckDB SQL that results are checked against."""

from __future__ import annotations


def daily(symbol: str = "p_brand", name: str = "bars") -> str:
    k = "(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)"
    price = "floor(l_extendedprice * 100 / l_quantity) / 100"
    return f"""{name} AS (
  SELECT {symbol} AS symbol, CAST(l_shipdate AS DATE) AS d, arg_min({price}, {k}) AS open, max({price}) AS high,
    min({price}) AS low, arg_max({price}, {k}) AS close, sum(l_quantity) AS volume, sum(l_extendedprice) AS amount
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""


def over(n: int | None = None, first: int | None = None, last: int | None = None) -> str:
    """OVER clause along a symbol's bars: the last n rows, rows from first to last (relative), or none (plain order)."""
    frame = ""
    if n is not None:
        first, last = 1 - n, 0
    if first is not None:
        side = lambda x: f"{abs(x)} {'PRECEDING' if x <= 0 else 'FOLLOWING'}"
        frame = f" ROWS BETWEEN {side(first)} AND {side(last)}"
    return f"OVER (PARTITION BY symbol ORDER BY d{frame})"


UP_TO_NOW = "OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def rounded(columns: dict[str, str], digits: int = 6) -> str:
    return ", ".join(f"round({x}, {digits}) AS {n}" for n, x in columns.items())
