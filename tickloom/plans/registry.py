"""All queries of the analytics operators, and their SQL."""

from __future__ import annotations

from tickloom.operators import backtests, boosting, cycles, deep, features, gates, intraday, learning, market, moods, news, patterns, relational, rolling, scorers, scoring, signals, similarity, structures, text
from tickloom.streaming import bars as streaming

_MODULES = (scoring, signals, scorers, structures, features, cycles, similarity, boosting, moods, intraday, gates, backtests, deep, news, rolling, relational, patterns, market, text, learning, streaming)
QUERIES = {"latest_scan": scoring.latest_scan} | {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
