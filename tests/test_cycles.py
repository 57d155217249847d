"""Lock cycles, range locks and their reaches: hand-made series, plain scans, and a stream that agrees with the table."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions import series
from tickloom.operators import cycles

DAY = datetime.date(2024, 1, 1)
SCHEMA = "symbol string, d date, open double, high double, low double, close double, volume double"


def walk(seed, n, quiet=0.004):
    """Bars of a walk with quiet stretches and jumps: (open, high, low, close, volume)."""
    rng = random.Random(seed)
    price, out, calm = 100.0, [], 0
    for _ in range(n):
        if calm == 0 and rng.random() < 0.08:
            calm = rng.randint(5, 25)
        step = quiet if calm else 0.03
        volume = rng.uniform(50, 80) if calm else rng.uniform(80, 300)
        close = price * (1.04 if calm == 1 and rng.random() < 0.7 else 1 + rng.uniform(-step, step))
        calm = max(calm - 1, 0)
        out.append((price, max(price, close) * (1 + rng.random() * step), min(price, close) * (1 - rng.random() * step), close, volume))
        price = close
    return out


def plain_score(bars, i):
    if i < 25:
        return 0, False, 0.0
    o, h, l, c, v = (np.array(x) for x in zip(*bars))
    tr = [max(h[j] - l[j], abs(h[j] - c[j - 1]), abs(l[j] - c[j - 1])) for j in range(i - 19, i + 1)]
    means = [c[i - n + 1 : i + 1].mean() for n in (5, 10, 20)]
    v20 = v[i - 19 : i + 1].mean()
    score = sum(map(int, (np.mean(tr[-5:]) / np.mean(tr) < 0.8, (max(means) - min(means)) / c[i] < 0.04, v[i - 4 : i + 1].mean() / v20 < 0.8)))
    change = (c[i] - o[i]) / o[i] * 100
    return int(score), bool(change > 2 or (v[i] / v20 > 1.5 and c[i] > o[i])), change


def plain_cycles(bars):
    """(first bar, break-out, change, later change) by looking back from each bar."""
    found, start = [], None
    if len(bars) < 60:
        return found
    score = [plain_score(bars, i) for i in range(len(bars))]
    for i in range(30, len(bars)):
        s, out, change = score[i]
        if start is None:
            if s >= 2 and sum(x[0] >= 2 for x in score[max(30, i - 4) : i + 1]) >= 3:
                start = i
        elif out:
            if i - start >= 2:
                later = bars[min(i + 5, len(bars) - 1)][3]
                found.append((start, i, change, (later - bars[i][3]) / bars[i][3] * 100))
            start = None
        elif i - start >= 3 and all(x[0] < 2 for x in score[i - 2 : i + 1]):
            start = None
    return found


def frame(spark, series_of):
    rows = [(s, DAY + datetime.timedelta(days=i), *b) for s, bars in series_of.items() for i, b in enumerate(bars)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


SERIES = {f"S{k}": walk(k, n) for k, n in enumerate([300, 240, 61, 60, 59, 20, 1])}


def test_cycles_against_a_plain_scan(spark):
    days = cycles.cycle_days(frame(spark, SERIES))
    got = {(r.symbol, (r.lock_d - DAY).days, (r.d - DAY).days): (r.lock_days, r.breakout_return, r.return_5d) for r in cycles.cycles(days).collect()}
    want = {(s, a, b): (b - a, change, later) for s, bars in SERIES.items() for a, b, change, later in plain_cycles(bars)}
    assert len(want) > 5 and got.keys() == want.keys()
    assert all(got[k] == (w[0], pytest.approx(w[1], abs=0.0051), pytest.approx(w[2], abs=0.0051)) for k, w in want.items())
    assert days.limit(0).count() == 0 and cycles.cycle_days(frame(spark, {"x": []})).count() == 0


def test_transitions():
    f, l, w, x = series.FREE, series.LOCKED, series.WEAK, series.WEAKER
    assert [series.next_state(f, *s) for s in ((True, True, False), (True, False, False), (False, True, False), (True, True, True))] == [l, f, f, l]
    assert [series.next_state(s, False, False, False) for s in (l, w, x)] == [w, x, f]
    assert [series.next_state(s, True, False, False) for s in (l, w, x)] == [l, l, l]
    assert [series.next_state(s, True, True, True) for s in (l, w, x)] == [f, f, f]


def test_positions(spark):
    flat = [(100.0, 100.5, 99.5, 100.0, 100.0)] * 40
    rising = [(100.0, 104.0, 99.0, 103.0, 100.0)]
    still = [(100.0, 100.1, 99.9, 100.0, 60.0)] * 10
    got = {r.symbol: r for r in cycles.positions(cycles.cycle_days(frame(spark, {"out": flat + still + rising, "lock": flat + still, "short": flat[:20]}))).collect()}
    assert (got["out"].phase, got["out"].day, got["out"].breakout_chance) == ("breakout", 0, 1.0)
    assert (got["lock"].phase, got["lock"].window_status, got["lock"].n_cycles, got["lock"].cv) == ("lockup", "overdue", 0, 999.0)
    assert got["short"].phase == "unknown" and got["short"].day == 0
    # two more signs once the quiet bars fill a fifth of the means
    assert got["lock"].day == next(k for k in range(50) if plain_score(flat + still, 49 - k)[0] < 2)


def test_stream_and_table_agree(spark, tmp_path):
    """Bars in shuffled micro-batches, late within the watermark's delay; a bar of another symbol moves the watermark on."""
    from tickloom.streaming.cycles import cycle_stream

    bars = {s: b for s, b in SERIES.items() if len(b) >= 60}
    rows = [(s, datetime.datetime.combine(DAY, datetime.time()) + datetime.timedelta(days=i), *b) for s, x in bars.items() for i, b in enumerate(x)]
    rng = random.Random(2)
    rows.sort(key=lambda r: r[1] + datetime.timedelta(days=rng.uniform(0, 4)))  # five days out of order at most
    schema = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"
    src = str(tmp_path / "in")
    for k in range(0, len(rows), 120):
        spark.createDataFrame(rows[k : k + 120], schema).coalesce(1).write.mode("append").parquet(src)
    spark.createDataFrame([("z", datetime.datetime(2030, 1, 1), 1.0, 1.0, 1.0, 1.0, 1.0)], schema).coalesce(1).write.mode("append").parquet(src)
    spark.createDataFrame([("z", datetime.datetime(2030, 6, 1), 1.0, 1.0, 1.0, 1.0, 1.0)], schema).coalesce(1).write.mode("append").parquet(src)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        given = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        q = cycle_stream(given, "6 days").writeStream.format("memory").queryName("cycles").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = sorted((r.symbol, r.lock_ts.date(), r.ts.date(), r.lock_days, round(r.breakout_return, 2), round(r.return_5d, 2)) for r in spark.table("cycles").collect())
    table = cycles.cycles(cycles.cycle_days(frame(spark, bars))).collect()
    assert got == sorted((r.symbol, r.lock_d, r.d, r.lock_days, r.breakout_return, r.return_5d) for r in table)


def test_reaches_and_segments_against_quadratic_scans():
    for seed in range(40):
        rng = np.random.default_rng(seed)
        n = int(rng.integers(1, 140))
        middle = 100 * np.exp(np.cumsum(rng.normal(0, rng.choice([0.002, 0.01, 0.03]), n)))
        high, low = middle * (1 + rng.random(n) * 0.02), middle * (1 - rng.random(n) * 0.02)
        if seed % 5 == 0:
            low[rng.integers(0, n)] = 0.0
        wide = lambda a, b: (high[a : b + 1].max() - low[a : b + 1].min()) / max(low[a : b + 1].min(), 0.01) * 100
        want = [max([b for b in range(a, n) if wide(a, b) <= 17], default=a - 1) for a in range(n)]
        assert series.reaches(high, low, 17.0).tolist() == want
        for least, restart in ((20, True), (21, False)):
            found, a = [], 0
            while a < n - 20:
                b = a
                if low[a : a + 20].min() > 0 and (high[a : a + 20].max() / low[a : a + 20].min() - 1) * 100 <= 15:
                    b = max([x for x in range(a + 19, n) if wide(a, x) <= 17], default=a + 19)
                    b = min(b, n - 10)
                    if b - a + 1 >= least:
                        found.append((a, b))
                        a = b + 1
                        continue
                    a = a + 1 if restart else max(b, a) + 1
                    continue
                a += 1
            assert series.range_segments(high, low, least=least, restart=restart) == found
