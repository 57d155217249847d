"""The join of dates within days: all pairs once, by equality, at bucket edges too; and rates by hand."""

import datetime
import random

import pytest

from tickloom.operators import news

DAY = datetime.date(2024, 1, 1)


@pytest.mark.parametrize("days", [0, 1, 3, 7])
def test_pairs_are_those_of_the_range_join(spark, days, capsys):
    rng = random.Random(days)
    day = lambda: DAY + datetime.timedelta(days=rng.randrange(-40, 40))
    a = [(rng.choice("AB"), day(), i) for i in range(120)] + [("A", None, 999), (None, DAY, 998)]
    b = [(rng.choice("AB"), DAY if k % 3 == 0 else day(), k) for k in range(150)] + [("A", None, 999)]
    left, right = spark.createDataFrame(a, "symbol string, d date, i int"), spark.createDataFrame(b, "symbol string, on date, k int")
    got = news.within_days(left, right, days)
    pairs = sorted((r.i, r.k) for r in got.collect())
    assert pairs == sorted((i, k) for s, x, i in a for t, y, k in b if s and s == t and x and y and abs((x - y).days) <= days)
    got.explain()
    assert "NestedLoop" not in (out := capsys.readouterr().out) and "Cartesian" not in out


def test_rates(spark):
    at = lambda k: DAY + datetime.timedelta(days=k)
    signals = [("A", at(0), 2.0), ("A", at(10), -1.0), ("A", at(20), 3.0), ("A", at(30), None), ("A", at(40), 1.0), ("B", at(0), 1.0)]
    items = [("A", at(3), 1), ("A", at(3), 1), ("A", at(-3), -1), ("A", at(13), -1), ("A", at(24), 1), ("A", at(40), 1), ("A", at(41), -1), ("B", at(0), 1), ("A", None, 1)]
    got = news.resonance(spark.createDataFrame(signals, "symbol string, d date, change double"), spark.createDataFrame(items, "symbol string, on date, way int")).collect()
    # day 0: +1 and right; day 10: -1 and right; day 20: none within three days; day 40: the ways cancel out
    assert [tuple(r) for r in got] == [("A", 4, 3, 2, 0.75, 0.25, 0.667)]
