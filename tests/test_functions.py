"""Column builders, folds, sources and streams on small inputs with known results."""

import datetime

import pytest
from conftest import SF
from pyspark.sql import functions as F

from tickloom.functions import recursive as R
from tickloom.functions import windows as W
from tickloom.operators.patterns import candles, PATTERNS, range_lock_cycles
from tickloom.operators.text import near_titles, simhash, tokens
from tickloom.sources.tables import artefact, dictionary, save_by_date, upserted
from tickloom.streaming.bars import event_stream, next_tier, sessions, tier_stream, tiers

DAY = datetime.date(2024, 1, 1)


def bars(spark, closes, symbol="A"):
    rows = [(symbol, DAY + datetime.timedelta(days=i), float(c), float(c) + 1, float(c) - 1, float(c), 100.0, 100.0 * c) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, d date, open double, high double, low double, close double, volume double, amount double")


def column(df, c):
    return [r[0] for r in df.orderBy("d").select(c).collect()]


def test_head_of_windows(spark):
    b = bars(spark, [1, 2, 3, 4])
    assert column(b.select("d", W.ma("close", 3).alias("x")), "x") == [1, 1.5, 2, 3]
    assert column(b.select("d", W.sma("close", 3).alias("x")), "x") == [None, None, 2, 3]
    assert column(b.select("d", W.bars_last(F.col("close") == 2).alias("x")), "x") == [0, 0, 1, 2]


def test_cross_and_ladder(spark):
    b = bars(spark, [1, 3, 1, 3]).withColumn("two", F.lit(2.0))
    assert column(b.select("d", W.cross("close", "two").alias("x")), "x") == [False, True, False, True]
    assert column(b.select("d", W.ladder(F.col("close"), [(2.0, 10.0)], 20.0).alias("x")), "x") == [10, 20, 10, 20]


def test_exponential_against_loop(spark):
    closes = [5.0, 7.0, 6.0, 9.0, 4.0]
    want, y = [], None
    for c in closes:
        y = c if y is None else 0.5 * c + 0.5 * y
        want.append(y)
    out = R.exponential(bars(spark, closes), {"y": ("close", 0.5)})
    assert column(out, "y") == pytest.approx(want)


def test_zigzag_turns(spark):
    out = R.zigzag(bars(spark, [100, 106, 110, 103, 100, 106]), 5.0)
    assert column(out, "direction") == [0, 1, 1, -1, -1, 1]


def test_range_lock(spark):
    out = range_lock_cycles(bars(spark, [100.0] * 40 + [300.0] * 5))
    row = out.collect()
    assert len(row) == 1 and row[0].bars == 11


def test_pattern_three_rising(spark):
    rows = [("A", DAY + datetime.timedelta(days=i), o, c + 0.1, o - 0.1, c, v, 1.0) for i, (o, c, v) in enumerate([(10, 9.9, 100), (10, 10.5, 100), (10.5, 11, 100), (11, 11.6, 150)])]
    b = spark.createDataFrame([tuple(float(x) if isinstance(x, int) else x for x in r) for r in rows], "symbol string, d date, open double, high double, low double, close double, volume double, amount double")
    import re

    flags = candles(b).select("d", W.true(F.expr(re.sub(r"\b(\d+\.\d+)\b", r"\1D", PATTERNS["three_rising"]))).alias("x"))
    assert column(flags, "x") == [False, False, False, True]


def test_tokens_and_fingerprints(spark):
    df = spark.createDataFrame([(1, "Alpha beta 42"), (2, None), (3, "")], "id long, t string")
    assert df.where("id = 1").select(tokens(F.col("t")).alias("x")).first().x == ["alpha", "beta", "42"]
    prints = {r.id: r.fingerprint for r in simhash(df, "id", "t").collect()}
    assert prints[2] == prints[3] == 0 and prints[1] > 0


def test_near_titles_keep_the_strongest(spark):
    df = spark.createDataFrame([("k", 3.0, 1, 0), ("k", 2.0, 2, 1), ("k", 1.0, 3, 0xFFFF)], "k string, score double, id int, f long")
    assert sorted(r.id for r in near_titles(df, ["k"], "score", "f").collect()) == [1, 3]


def test_upsert_dictionary_artefact(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, at int")
    new = spark.createDataFrame([(2, "c", 1), (3, "d", 1)], "k int, v string, at int")
    assert {(r.k, r.v) for r in upserted(old, new, ["k"], F.col("at")).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    (tmp_path / "d.txt").write_text("x|1\ny|2\n")
    assert dictionary(spark, str(tmp_path / "d.txt")).columns == ["k0", "k1"]
    (tmp_path / "m.json").write_text('{"auc": 0.8,\n "n": 3}')
    assert artefact(spark, str(tmp_path / "m.json")).first().n == 3
    b = bars(spark, [1, 2])
    save_by_date(b, str(tmp_path / "bars"))
    save_by_date(b.where("close = 2").withColumn("close", F.lit(9.0)), str(tmp_path / "bars"))
    assert sorted(r.close for r in spark.read.parquet(str(tmp_path / "bars")).collect()) == [1.0, 9.0]


def test_tiers_in_batch_and_stream_agree(spark, tmp_path):
    p = [0.7, 0.5, 0.3, 0.3, 0.3, 0.3, 0.3, 0.3, 0.5]
    rows = [("A", DAY + datetime.timedelta(days=i), x) for i, x in enumerate(p)]
    batch = tiers(spark.createDataFrame(rows, "symbol string, d date, probability double"))
    tier, low, want = "observe", 0, []
    for x in p:
        tier, low = next_tier(tier, low, x)
        want.append(tier)
    assert column(batch, "tier") == want
    src = str(tmp_path / "in")
    spark.createDataFrame([(s, datetime.datetime.combine(d, datetime.time()), x) for s, d, x in rows], "symbol string, ts timestamp, probability double").coalesce(1).write.parquet(src)
    stream = tier_stream(spark.readStream.schema("symbol string, ts timestamp, probability double").parquet(src))
    q = stream.writeStream.format("memory").queryName("tiers").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.table("tiers").first()
    assert (last.tier, last.low_days) == (tier, low)


def test_sessions_on_a_stream(spark, tmp_path):
    s = sessions(event_stream(spark, SF).withWatermark("ts", "1 hour"))
    assert s.isStreaming


def test_near_titles_folds_over_distinct_fingerprints(spark, capsys):
    rows = [("u", i, float(i % 50), [0, 0xFF, 0xFFFF00, 1][i % 4]) for i in range(400)] + [("u", 1000 + i, 1.0, None) for i in range(2)]
    got = near_titles(spark.createDataFrame(rows, "user string, id long, value double, f long"), ["user"], "value", "f")
    want, kept = set(), []
    for _, i, _, f in sorted(rows, key=lambda r: (-r[2], r[1])):
        if f is None or all((f ^ g).bit_count() >= 8 for g in kept):
            want.add(i)
            kept += [f] if f is not None else []
    assert {r.id for r in got.collect()} == want
    got.explain()
    assert "partial_min" in capsys.readouterr().out


def test_greedy_locks_against_a_plain_scan():
    import numpy as np

    from tickloom.operators.features import greedy_locks

    def plain(c):
        ok = lambda w, first: all(0.85 * m <= x <= 1.15 * m for m in [float(np.median(w)) or 1.0] for x in w) and (np.std(w) / (np.median(w) or 1.0) * 100 < 8 if first else np.std(w) / (np.median(w) or 1.0) * 100 <= 8)
        found, i = [], 0
        while i <= len(c) - 20:
            if not ok(c[i : i + 20], True):
                i += 1
                continue
            start, i = i, i + 1
            while i <= len(c) - 20 and ok(c[i : i + 20], False) and i < len(c) - 1:
                i += 1
            end = min(i + 19, len(c) - 1)
            if end - start >= 10:
                found.append((start, end))
        return found

    rng = np.random.default_rng(6)
    for _ in range(30):
        c = 100 * np.exp(np.cumsum(rng.normal(0, rng.choice([0.005, 0.03, 0.08]), 150)))
        assert greedy_locks(c) == plain(c)
    assert greedy_locks(np.ones(10)) == []
