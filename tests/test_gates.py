"""The hard rules by hand-made rows, on either side of each bound."""

import pytest

from tickloom.operators import gates

FINE = {"cap": 80.0, "exempt": False, "bias": 0.0, "rsi": 50.0, "m5": 3.0, "m10": 2.0, "m20": 1.0, "diff": 0.1, "j": 50.0, "cost_50": 9.0}


@pytest.mark.parametrize(("change", "failed", "noted"), [
    ({}, "", ""), ({"cap": 49.9}, "micro_cap", ""), ({"cap": 50.0}, "", ""), ({"cap": 0.0}, "", ""), ({"bias": -3.1}, "weak", ""), ({"bias": -3.0}, "", ""), ({"bias": 10.1}, "chase_high", ""), ({"bias": 10.0}, "", ""),
    ({"bias": -9.0, "exempt": True}, "", ""), ({"bias": 20.0, "exempt": True}, "", ""), ({"rsi": 70.1}, "rsi_overbought", ""), ({"rsi": 70.0}, "", ""), ({"m5": 1.0, "m10": 2.0, "m20": 3.0}, "strong_bear", ""),
    ({"m5": 2.0, "m20": 3.0}, "", ""), ({"diff": -0.1}, "", "macd_bear"), ({"diff": 0.0}, "", ""), ({"j": 80.1}, "", "kdj_overbought"), ({"j": 80.0}, "", ""), ({"cost_50": 4.9}, "", "chip_too_low"), ({"cost_50": 5.0}, "", ""),
    ({"cap": 1.0, "rsi": 99.0, "j": 99.0, "diff": -1.0}, "micro_cap,rsi_overbought", "macd_bear,kdj_overbought"), (dict.fromkeys(("cap", "bias", "rsi", "m5", "diff", "j", "cost_50")), "", ""),
])
def test_rules(spark, change, failed, noted):
    row = FINE | change
    df = spark.createDataFrame([tuple(row.values())], "cap double, exempt boolean, bias double, rsi double, m5 double, m10 double, m20 double, diff double, j double, cost_50 double")
    got = gates.judged(df).first()
    assert (got.failed, got.noted, got.passed) == (failed, noted, failed == "")  # what is only noted blocks nothing
