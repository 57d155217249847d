"""Safe numerics, excess returns and the signal indicator against fixed numbers."""

import datetime
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.functions import safe
from tickloom.functions.recursive import recurrences
from tickloom.operators.signals import indicator

D = lambda k: datetime.date(2024, 6, k)
# Ten sessions of a benchmark, and excess returns in it
SESSIONS = dict(zip((3, 4, 5, 6, 7, 10, 11, 12, 13, 14), (5000.0, 5025.0, 5010.0, 5035.0, 5050.0, 5060.0, 5040.0, 5075.0, 5100.0, 5080.0)))
CASES = [(100, 105, 3, 5, 4.3035), (200, 198, 7, 2, -0.6047), (100, 101, 3, 1, 1.0), (100, 105, 3, 50, 0.0), (100, 105, 14, 5, 0.0)]


def excess(spark, cases, closes, fallback=False):
    rows = spark.createDataFrame([(i, float(a), float(b), D(d), h) for i, (a, b, d, h) in enumerate(cases)], "i int, today double, future double, d date, horizon int")
    bench = spark.createDataFrame([(D(k), v) for k, v in closes.items()], "d date, close double")
    return [r.excess for r in safe.excess_returns(rows, bench, fallback).orderBy("i").collect()]


def test_excess_returns(spark):
    assert excess(spark, [c[:4] for c in CASES], SESSIONS) == pytest.approx([c[4] for c in CASES], abs=1e-6)
    assert excess(spark, [(100, 105, 3, 5)], {}) == [0.0] and excess(spark, [(100, 105, 3, 1)], {4: 0.0, 5: 5025.0}) == [0.0]
    assert excess(spark, [(100, 105, 3, 50), (100, 105, 3, 5)], SESSIONS, True) == pytest.approx([5.0, 4.3035], abs=1e-6)
    # sessions are counted, not days
    sessions = excess(spark, [(100, 103, 7, 5)], SESSIONS)[0]
    assert abs(sessions - (3.0 - (5075 / 5050 - 1) * 100)) > 0.01
    assert abs(excess(spark, [(0.005, 0.010, 3, 5)], SESSIONS)[0]) < 1000


def test_safe_numbers(spark):
    texts = spark.createDataFrame([(None,), ("3.14",), ("hello",), ("",), ("42",), ("NaN",), ("Infinity",)], "x string")
    assert [r[0] for r in texts.select(safe.number("x", -1.0)).collect()] == [-1.0, 3.14, -1.0, -1.0, 42.0, -1.0, -1.0]
    pairs = spark.createDataFrame([(10.0, 2.0), (10.0, 0.0), (10.0, 1e-10), (None, 2.0), (float("nan"), 2.0), (1.0, None)], "a double, b double")
    assert [r[0] for r in pairs.select(safe.divided("a", "b")).collect()] == [5.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    arrays = spark.createDataFrame([([1.0, float("nan"), float("inf"), 4.0, 5.0],), ([],)], "xs array<double>")
    got = arrays.select(safe.filled("xs").alias("f"), safe.quality("xs").alias("q")).collect()
    assert got[0].f == [1.0, 0.0, 0.0, 4.0, 5.0] and tuple(got[0].q) == (5, 1, 1, 0.6) and got[1].q.valid_rate == 1.0
    assert spark.createDataFrame([(True,)], "x boolean").select(safe.number("x")).first()[0] == 1.0


def test_safe_correlation(spark):
    of = lambda xs, ys, default=0.0: spark.createDataFrame(list(zip(xs, ys)), "a double, b double").agg(safe.correlation("a", "b", default)).first()[0]
    assert of([1.0, 2.0, 3.0], [2.0, 4.0, 6.0]) == pytest.approx(1) and of([1.0, 2.0, 3.0], [6.0, 4.0, 2.0]) == pytest.approx(-1)
    assert of([1.0, 1.0, 1.0], [1.0, 2.0, 3.0], 0.5) == 0.5 and of([1.0], [2.0]) == 0.0


def test_json_safe(spark):
    row = spark.createDataFrame([(1.5, float("nan"), [1.0, float("-inf")], "NaN is a word")], "a double, b double, xs array<double>, t string")
    assert row.select(safe.json_safe(F.struct("*"), row.schema)).first()[0] == '{"a":1.5,"b":null,"xs":[1.0,null],"t":"NaN is a word"}'
    texts = spark.createDataFrame([("NaN", ["Infinity", "-Infinity"], {"NaN": float("nan")}, ("NaN", float("inf")), None)], "t string, xs array<string>, m map<string,double>, s struct<a:string,b:double>, n struct<a:double>")
    assert texts.select(safe.json_safe(F.struct("*"), texts.schema)).first()[0] == '{"t":"NaN","xs":["Infinity","-Infinity"],"m":{"NaN":null},"s":{"a":"NaN","b":null},"n":null}'


def test_recurrences_seed_with_the_first_value(spark):
    rows = spark.createDataFrame([("a", i, x) for i, x in enumerate([None, 10.0, 20.0, 40.0])], "symbol string, d int, x double")
    got = [r.y for r in recurrences(rows, [("y", "x", 0.5)]).orderBy("d").collect()]
    assert (got[0] is None or math.isnan(got[0])) and got[1:] == [10.0, 15.0, 27.5]


def test_indicator_against_pandas(spark):
    bars = pd.DataFrame({"symbol": "a", "d": pd.date_range("2024-01-01", periods=120).date, "open": 100.0, "volume": [1000.0 + 37 * (i % 11) for i in range(120)]})
    bars["close"] = [100 + 10 * math.sin(i / 7) + (i % 5) for i in range(120)]
    bars["high"], bars["low"] = bars["close"] + 2, bars["close"] - 3
    got = indicator(spark.createDataFrame(bars)).orderBy("d").toPandas()
    mean = lambda x, n: x.ewm(span=n, adjust=False).mean()
    base = mean((bars["close"] + bars["low"] + bars["high"]) / 3, 3)
    assert (got["buy_line"] - mean(base, 3)).abs().max() < 1e-9 and (got["sell_line"] - mean(base, 13)).abs().max() < 1e-9
    momentum = mean((bars["close"] / bars["close"].shift(5) - 1) * 100, 3)
    assert (got["momentum"][5:] - momentum[5:]).abs().max() < 1e-9
    assert set(got["buy_level"]) <= {0, 1, 2, 3, 5} and (got["buy_level"] > 0).tolist() == got["buy_dir"].tolist()
