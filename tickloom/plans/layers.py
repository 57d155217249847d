"""Columns in layers: SQL expressions over the columns of the layers before, for Spark and for the SQL that checks it.

Expressions are plain SQL that both engines read the same way. Decimal literals are doubles in both.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

Layer = dict[str, str]

_DECIMAL = re.compile(r"(?<![\w.])(\d+\.\d+)(?![\w.])")
_WORD = re.compile(r"[A-Za-z_]\w*(?!\w*\s*\()")


def doubles(expression: str) -> str:
    return _DECIMAL.sub(r"\1e0", expression)


def layered(df: DataFrame, *layers: Layer) -> DataFrame:
    """df with the layers' columns; windows of the same order share one exchange and one sort."""
    for layer in layers:
        df = df.selectExpr("*", *[f"{doubles(x)} AS {name}" for name, x in layer.items()])
    return df


def layered_sql(source: str, name: str, *layers: Layer) -> str:
    """CTEs that add the layers' columns to source; the last one is called name."""
    out = []
    for k, layer in enumerate(layers):
        to = name if k == len(layers) - 1 else f"{name}_{k}"
        columns = ", ".join(f"{duck(x)} AS {c}" for c, x in layer.items())
        out.append(f"{to} AS (SELECT *, {columns} FROM {source})")
        source = to
    return ",\n ".join(out)


def duck(expression: str) -> str:
    return doubles(expression).replace("max_by(", "arg_max(").replace("min_by(", "arg_min(")


def recurrences_sql(source: str, name: str, spec: list[tuple[str, str, float | str]]) -> str:
    """CTEs (the query must be WITH RECURSIVE) that add the recurrences of functions.recursive.recurrences to source."""
    new: dict[str, str] = {}
    first, step = [], []
    for target, x, alpha in spec:
        given = _WORD.sub(lambda m: f"({new[m[0]]})" if m[0] in new else f"q.{m[0]}", x)
        a = f"q.{alpha}" if isinstance(alpha, str) else f"{alpha!r}::DOUBLE"
        before = dict(new)
        new[target] = f"CASE WHEN p.{target} IS NULL THEN {given} ELSE {a} * ({given}) + (1 - {a}) * p.{target} END"
        step.append(f"{new[target]} AS {target}")
        first.append((target, x, before))
    firsts: dict[str, str] = {}
    for target, x, _ in first:
        firsts[target] = _WORD.sub(lambda m: f"({firsts[m[0]]})" if m[0] in firsts else f"q.{m[0]}", x)
    names = ", ".join(t for t, _, _ in spec)
    return f"""{name}_q AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY d) AS qn FROM {source}),
 {name}_r AS (SELECT q.symbol, q.qn, {", ".join(f"CAST({e} AS DOUBLE) AS {t}" for t, e in firsts.items())} FROM {name}_q q WHERE qn = 1
  UNION ALL SELECT q.symbol, q.qn, {", ".join(step)} FROM {name}_r p JOIN {name}_q q ON q.symbol = p.symbol AND q.qn = p.qn + 1),
 {name} AS (SELECT q.*, {names} FROM {name}_q q JOIN {name}_r USING (symbol, qn))"""
