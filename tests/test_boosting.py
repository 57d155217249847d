"""Boosted trees: gradients and splits against plain loops, the same model however rows lie, and held-out days."""

import datetime

import numpy as np
import pandas as pd
import pytest
from conftest import SF
from pyspark.sql import functions as F

from tickloom.operators import boosting as B

NAMES = ["a", "b", "c"]


def frame(spark, seed, n, days=30):
    """Labels by the sign of a product, which no linear model can tell; a third of all rows are of one day."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    signal = np.sign(x[:, 0] * x[:, 1]) * 1.5 + x[:, 2] * 0.2
    up = (signal + rng.normal(size=n) > 0).astype(float)
    x[rng.random((n, 3)) < 0.03] = np.nan
    day = np.where(np.arange(n) < n // 3, 0, rng.integers(0, days, n))
    value = signal * 2 + rng.normal(size=n) * 0.3
    rows = pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "up": up, "value": value, "grade": np.clip(np.round(signal + 2), 0, 4)})
    rows["d"] = [datetime.date(2024, 1, 1) + datetime.timedelta(days=int(k)) for k in day]
    rows = rows.astype(object).where(rows.notna(), None)
    return spark.createDataFrame(rows.values.tolist(), "a double, b double, c double, up double, value double, grade double, d date")


def linear(train, test, label):
    """Scores of a least-squares line on the same features."""
    x, z = (df.select(*NAMES, label).toPandas().fillna(0.0).to_numpy(float) for df in (train, test))
    w = np.linalg.lstsq(np.c_[x[:, :3], np.ones(len(x))], x[:, 3], rcond=None)[0]
    return F.lit(float(w[3])) + sum((F.coalesce(F.col(c), F.lit(0.0)) * float(v) for c, v in zip(NAMES, w)), F.lit(0.0))


def test_pair_gradients():
    rng = np.random.default_rng(1)
    label, margin = rng.integers(0, 3, 23).astype(float), rng.normal(size=23)
    g, h = np.zeros(23), np.zeros(23)
    for i in range(23):
        for j in range(23):
            if label[i] > label[j]:
                p = 1 / (1 + np.exp(margin[i] - margin[j]))
                g[i], g[j] = g[i] - p, g[j] + p
                h[i], h[j] = h[i] + p * (1 - p), h[j] + p * (1 - p)
    for rows in (512, 4):
        got = B.pair_gradients(label, margin, rows)
        assert np.allclose(got[0], g / 22) and np.allclose(got[1], h / 22)


def test_first_split_is_the_best_one(spark):
    df = frame(spark, 3, 400)
    model = B.fit(df, NAMES, "value", "value", rounds=1, depth=1, rate=1.0, smooth=0.0, least=5)
    rows = df.toPandas()
    y, mean = rows["value"].to_numpy(float), float(rows["value"].astype(float).mean())
    best = None
    for k, name in enumerate(NAMES):
        x = rows[name].astype(float).fillna(-np.inf).to_numpy()
        for b, edge in enumerate([*model.edges[k]]):
            left = x <= edge
            if min(left.sum(), (~left).sum()) >= 5:
                loss = ((y[left] - y[left].mean()) ** 2).sum() + ((y[~left] - y[~left].mean()) ** 2).sum()
                if best is None or loss < best[0] - 1e-9:
                    best = (loss, k, b, y[left].mean(), y[~left].mean())
    tree = model.trees[0]
    assert (tree.feature[0], tree.bin[0]) == best[1:3]
    assert (model.base + tree.value[1], model.base + tree.value[2]) == pytest.approx(best[3:], abs=1e-4) and model.base == pytest.approx(mean)


@pytest.mark.parametrize(("kind", "label"), [("class", "up"), ("rank", "grade")])
def test_same_model_for_any_partitioning(spark, kind, label):
    df = frame(spark, 5, 500)
    a, b = (B.fit(x, NAMES, label, kind, rounds=2, depth=2) for x in (df.repartition(5), df.coalesce(1).orderBy("a")))
    assert a == b and len(a.trees) == 2


def test_scores_are_the_margins(spark):
    df = frame(spark, 6, 300)
    model = B.fit(df, NAMES, "up", rounds=3)
    rows = df.select(*NAMES, model.column().alias("m"), model.score().alias("p")).toPandas()
    want = model.margins(model.bins(rows))
    assert np.allclose(rows["m"], want) and np.allclose(rows["p"], 1 / (1 + np.exp(-want)))


def test_better_than_a_line_on_later_days(spark):
    df = frame(spark, 7, 1500).persist()
    end, first, last = B.folds(df, 2, 2)[-1]
    assert (first - end).days == 3
    train, test = df.where(F.col("d") <= end), df.where(F.col("d").between(first, last))
    score = lambda model, label: test.withColumn("s", model.score() if isinstance(model, B.Boosted) else model)
    trees, line = (score(m, "up") for m in (B.fit(train, NAMES, "up", rounds=8), linear(train, test, "up")))
    assert B.auc(trees, "s", "up") > 0.75 > 0.6 > B.auc(line, "s", "up")
    trees, line = (score(m, "grade") for m in (B.fit(train, NAMES, "grade", "rank", rounds=8), linear(train, test, "grade")))
    assert B.ndcg(trees, "s", "grade") > B.ndcg(line, "s", "grade") + 0.05


def test_measures(spark):
    df = spark.createDataFrame([(1, 0.9, 1.0), (1, 0.5, 0.0), (1, 0.5, 1.0), (1, 0.1, 0.0)], "d int, s double, y double")
    assert B.auc(df, "s", "y") == 0.875
    ideal = 1 + 1 / np.log2(3)  # equal scores count with the lower gain first
    assert B.ndcg(df, "s", "y", k=4) == pytest.approx((1 + 1 / 2) / ideal)
    assert B.ndcg(df.withColumn("s", -F.col("s")), "s", "y", k=4) == pytest.approx((1 / 2 + 1 / np.log2(5)) / ideal)
    assert B.ndcg(df, "s", "y", k=1) == pytest.approx(1.0)


def test_no_rows_and_one_class(spark):
    df = frame(spark, 8, 30)
    assert B.fit(df.limit(0), NAMES, "up", rounds=2).margins(np.zeros((1, 3), np.int16))[0] == pytest.approx(np.log(1e-6), rel=1e-3)
    assert B.fit(df.withColumn("up", F.lit(None).cast("double")), NAMES, "up", rounds=1).trees[0].feature[0] == -1
    one = B.fit(df.withColumn("up", F.lit(1.0)), NAMES, "up", rounds=1)
    assert one.trees[0].feature[0] == -1 and one.base > 10


def test_labels_end_with_the_bars(spark):
    rows = [("A", datetime.date(2024, 1, 1) + datetime.timedelta(days=k), 10.0, 11.0, 9.0, 10.0 + k, 5.0) for k in range(6)]
    got = B.labelled_bars(spark.createDataFrame(rows, "symbol string, d date, open double, high double, low double, close double, volume double")).orderBy("d").collect()
    assert [r.later is None for r in got] == [False] * 3 + [True] * 3 and [r.up for r in got] == [1.0] * 3 + [None] * 3
    assert got[0].later == pytest.approx(30.0) and got[0].fifth == 0.0


def test_passes_over_the_rows(spark, monkeypatch):
    """Three models of six trees of three levels: one pass a level for all of them, none for the last level's leaves."""
    passes, sums = [], B._sums
    monkeypatch.setattr(B, "_sums", lambda *a: passes.append(a) or sums(*a))
    assert B.boosted_scores(spark, SF).count() > 0
    assert 0 < len(passes) <= 18


def test_models_fitted_together(spark):
    """Each as if fitted alone, also where labels are missing from different rows and one has no rows."""
    df = frame(spark, 9, 600).withColumn("up", F.when(F.col("a") > -0.5, F.col("up"))).withColumn("none", F.lit(None).cast("double"))
    targets = [("rank", "grade"), ("class", "up"), ("value", "value"), ("class", "none")]
    got = B.fit_all(df, NAMES, targets, rounds=2, depth=2)
    assert got == [B.fit(df, NAMES, label, kind, rounds=2, depth=2) for kind, label in targets]
    assert [len(m.trees) for m in got] == [2, 2, 2, 1]
