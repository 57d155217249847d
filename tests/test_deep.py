"""Deep scores: golden values for hand-made symbols, gates and tiers of weights, groups of every size."""

import pytest
from pyspark.sql import functions as F

from tickloom.operators import deep

BASE = [("a", 2.0), ("b", 1.0), ("c", 0.01)]
OFFSETS = [("big", "a", -0.5), ("big", "b", 0.2), ("small", "b", 0.5)]
OVERRIDES = [("big", "b", 1.0)]


def weights(spark, beliefs, auc=0.55):
    frame = spark.createDataFrame
    return deep.resolved_weights(
        frame(BASE, "param string, value double"), frame(OFFSETS, "archetype string, param string, offset double"), frame(OVERRIDES, "archetype string, param string, offset double"),
        frame(beliefs, "regime string, param string, mu double, n int"), frame([("up", auc)], "regime string, auc double"),
    )


TEN = [("up", "a", 4.0, 50)] + [("up", f"x{i}", 1.0, 3) for i in range(9)]


@pytest.mark.parametrize(("beliefs", "auc", "open_"), [
    (TEN, 0.55, True), (TEN, 0.549, False), (TEN[:-1], 0.55, False), ([("up", p, m, min(n, 49)) for _, p, m, n in TEN], 0.55, False),
])
def test_weights_and_gates(spark, beliefs, auc, open_):
    got = {(r.archetype, r.param): (r.weight, r.tier) for r in weights(spark, beliefs, auc).collect()}
    a = {"big": (2.5, "regime"), "small": (3.0, "regime")} if open_ else {"big": (1.0, "offset"), "small": (2.0, "base")}
    assert got == {
        ("big", "a"): a["big"], ("small", "a"): a["small"], ("big", "b"): (2.0, "override"), ("small", "b"): (1.5, "offset"), ("big", "c"): (0.05, "base"), ("small", "c"): (0.05, "base"),
    }


def test_totals_of_what_is_there(spark):
    rows = [("one", "big", "up", "a", 8.0), ("one", "big", "up", "b", 2.0), ("two", "big", "up", "a", None), ("two", "big", "up", "b", 3.0), ("three", "big", "up", "a", None)]
    got = {r.symbol: (r.raw_total, r.tiers) for r in deep.totals(spark.createDataFrame(rows, "symbol string, archetype string, regime string, param string, score double"), weights(spark, TEN, 0.1)).collect()}
    assert got == {"one": (40.0, "offset,override"), "two": (30.0, "override"), "three": (50.0, "")}


@pytest.mark.parametrize(("values", "want"), [
    ([120.0], [100.0]), ([30.0, 30.005], [50.0, 50.0]), ([40.0, 60.0], [35.0, 65.0]), ([10.0, 20.0, 30.0, 40.0, 60.0], [0.0, 20.0, 40.0, 60.0, 100.0]), ([50.0, 50.1], [50.0, 50.0]),
])
def test_within_archetype(spark, values, want):
    got = deep.within_archetype(spark.createDataFrame([("k", v) for v in values], "archetype string, raw_total double")).orderBy("raw_total").collect()
    assert [r.base for r in got] == want


def test_discounts(spark):
    df = spark.createDataFrame([(x,) for x in (29.9, 30.0, 35.0, 40.0, 44.9, 45.0, None)], "x double")
    assert [r.y for r in df.select(deep.discount(F.col("x")).alias("y")).collect()] == [0.65, 0.78, 0.88, 1.0, 1.0, 1.05, 1.05]


def test_three_symbols(spark):
    """Golden values, worked out by hand."""
    schema = "symbol string, archetype string, base double, sector_bonus double, event_impact double, fundamental double, market_coef double, sector_coef double, predicted double, rank double"
    rows = [("A", "large_bluechip", 60.0, 4.0, 10.0, -5.0, 1.1, 0.9, 6.0, 0.7), ("B", "growth_tech", 98.0, 4.0, None, None, None, None, -3.0, 0.3), ("C", "small_speculative", 2.0, None, -20.0, None, 0.8, None, -3.1, None), ("D", "other", 50.0, *[None] * 7)]
    got = {r.symbol: r for r in deep.composed(spark.createDataFrame(rows, schema)).collect()}
    a, b, c, d = (got[s] for s in "ABCD")
    assert (a.composite, round(a.coef, 4), a.adjusted, a.win_probability, a.quality, a.label, a.final) == (64.0, 0.99, 63.4, 0.37, 0.66, "S1", 79.0)
    assert (b.composite, b.coef, b.adjusted, b.win_probability, b.quality, b.label, b.final) == (100.0, 1.0, 100.0, 0.55, 0.95, "S2", 95.0)
    assert (c.composite, c.coef, c.adjusted, c.win_probability, c.quality, c.label, c.final) == (0.0, 0.8, 0.0, 0.05, 0.1, "S3", 0.0)
    assert (d.composite, d.win_probability, d.label, d.final) == (50.0, 0.3, None, 50.0)
