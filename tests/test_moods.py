"""Moods: clusters against a plain version, silhouettes by definition, chains that absorb and that only cycle."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import moods


def plain_silhouette(x, labels):
    out = []
    for i in range(len(x)):
        d = [np.linalg.norm(x[i] - y) for y in x]
        by = {c: [d[j] for j in range(len(x)) if labels[j] == c and j != i] for c in set(labels)}
        own = by.pop(labels[i])
        if not own:
            out.append(0.0)
            continue
        a, b = np.mean(own), min(np.mean(v) for v in by.values())
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return float(np.mean(out))


def test_silhouette_by_definition():
    rng = np.random.default_rng(1)
    for n, k in ((40, 3), (15, 6), (9, 9)):
        x, labels = rng.normal(size=(n, 4)), rng.integers(0, k, n)
        labels[:k] = np.arange(k)
        assert moods.silhouette(x, labels, rows=7) == pytest.approx(plain_silhouette(x, labels.tolist()))
    assert moods.silhouette(x, np.zeros(9, int)) == 0.0


def test_the_number_of_clusters():
    rng = np.random.default_rng(2)
    for k in (6, 8, 10):
        centres = rng.normal(size=(k, 9)) * 20
        want = rng.integers(0, k, 300)
        labels, found, worth = moods.best_clusters(centres[want] + rng.normal(size=(300, 9)) * 0.2)
        assert found == k and worth > 0.8 and len(set(zip(want.tolist(), labels.tolist()))) == k
        assert labels[0] == 0  # numbered by first row
    assert moods.best_clusters(np.ones((50, 9)))[1] == 1 and moods.best_clusters(rng.normal(size=(29, 9)))[1] == 1
    few = moods.best_clusters(rng.normal(size=(31, 9)))
    assert few[1] == 6  # five rows a cluster at least


def test_every_symbol_by_itself(spark):
    rng = np.random.default_rng(3)
    rows = []
    for s in ("A", "B", "C"):
        for i in range(60 if s != "C" else 5):
            c = 10 + rng.random()
            rows.append((s, datetime.date(2024, 1, 1) + datetime.timedelta(days=i), 10.0, 12.0, 9.0, c, float(rng.integers(1, 9))))
    days = moods.daily_moods(spark.createDataFrame(rows, "symbol string, d date, open double, high double, low double, close double, volume double"))
    assert {r.symbol: r["count"] for r in days.groupBy("symbol").count().collect()} == {"A": 54, "B": 54}
    got = moods.clustered(days).collect()
    for s in ("A", "B"):
        x = np.array([[r[c] for c in moods.MOODS] for r in days.where(F.col("symbol") == s).orderBy("d").collect()])
        labels, k, worth = moods.best_clusters(x)
        own = sorted((r for r in got if r.symbol == s), key=lambda r: r.d)
        assert [r.mood for r in own] == labels.tolist() and own[0].moods == k and own[0].silhouette == pytest.approx(worth)


def test_stationary_distributions():
    weather = np.array([[0.9, 0.1], [0.5, 0.5]])
    assert moods.stationary(weather) == pytest.approx([5 / 6, 1 / 6])
    assert moods.stationary(np.array([[0.0, 1.0], [1.0, 0.0]])) == pytest.approx([0.5, 0.5])  # only cycles
    assert moods.stationary(np.array([[0.0, 1.0, 0.0], [0.0, 0.0, 1.0], [1.0, 0.0, 0.0]])) == pytest.approx([1 / 3] * 3)
    assert moods.stationary(np.array([[0.5, 0.5], [0.0, 1.0]])) == pytest.approx([0.0, 1.0], abs=1e-9)  # absorbs
    assert moods.stationary(np.eye(1)) == pytest.approx([1.0])
    rng = np.random.default_rng(4)
    p = rng.random((7, 7))
    p /= p.sum(axis=1, keepdims=True)
    value, vector = np.linalg.eig(p.T)
    v = np.real(vector[:, np.argmax(np.real(value))])
    assert moods.stationary(p) == pytest.approx(v / v.sum())


def test_chain_figures():
    p = np.array([[0.9, 0.1], [0.5, 0.5]])
    h = lambda *x: -sum(y * np.log2(y) for y in x)
    got = moods.chain_features(p, 1)
    want = {
        "entropy_rate": 5 / 6 * h(0.9, 0.1) + 1 / 6 * 1.0, "persistence": 0.7, "reversal": 0.3, "mode": 0.0, "stationary_entropy": h(5 / 6, 1 / 6), "mixing": 1 / 0.6,
        "best_p": 0.5, "worst_p": 0.5, "best": 0.0, "worst": 0.0, "stability": (h(0.9, 0.1) + 1) / 2, "gap": 0.6,
    }
    assert got == pytest.approx(want)
    assert list(got) == moods.CHAIN
    assert moods.chain_features(np.array([[0.0, 1.0], [1.0, 0.0]]), 0)["mixing"] == 20.0  # never mixes
    assert moods.chain_features(np.eye(1), 0)["entropy_rate"] == 0.0


def test_chains_count_transitions(spark):
    day = lambda i: datetime.date(2024, 1, 1) + datetime.timedelta(days=i)
    rows = [("A", day(i), s, 3) for i, s in enumerate([0, 1, 0, 1, 1, 2])] + [("B", day(0), 1, 2)]
    got = {r.symbol: r for r in moods.chains(spark.createDataFrame(rows, "symbol string, d date, state int, states int")).collect()}
    p = np.array([[1, 3, 1], [2, 2, 2], [1, 1, 1]]) / np.array([[5], [6], [3]])
    assert got["A"].distribution == pytest.approx(moods.stationary(p), abs=1e-6) and got["A"].current == 2
    assert got["B"].distribution == [0.5, 0.5] and got["B"].current == 1
