"""Moods of a symbol: a vector for each day, clusters of its days with their number by silhouette, and the chain of moods."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.bars import daily_bars
from tickloom.functions import windows as W
from tickloom.plans.sql import daily, over

QUERIES, SQL = {}, {}

#: Clusters that are tried, the fewest days that are clustered, and days for each cluster at least.
LEAST_K, MOST_K, LEAST_DAYS, DAYS_PER_CLUSTER = 6, 10, 30, 5
MOODS = ["open_dir", "amplitude", "shadows", "busy", "busy_change", "gap", "strength", "slope", "persistence"]


def daily_moods(bars: DataFrame) -> DataFrame:
    """symbol, d and the nine figures of a day that daily bars give, from the seventh bar on: change, amplitude and shadows
    of the bar, volume against its mean, both together, gap, strength of the close, slope, and rises in five days."""
    w = W.by_time()
    spread = F.greatest(F.col("high") - F.col("low"), F.lit(0.001))
    low = lambda c: F.greatest(F.col(c), F.lit(0.01))
    m = lambda c, n: F.avg(c).over(w.rowsBetween(1 - n, 0))
    x = bars.withColumns({
        "before": F.lag("close").over(w), "v20": m("volume", 20), "m5": m("close", 5), "i": F.row_number().over(w) - 1, "n": F.count("*").over(Window.partitionBy("symbol")),
    })
    x = x.withColumn("rise", (F.col("close") > F.col("before")).cast("int"))
    body = F.col("close") - F.col("open")
    x = x.withColumns({
        "open_dir": body / low("open") * 100, "amplitude": (F.col("high") - F.col("low")) / low("open") * 100,
        "shadows": (F.col("high") - F.greatest("open", "close") - (F.least("open", "close") - F.col("low"))) / spread, "busy": F.col("volume") / F.greatest("v20", F.lit(1e-9)),
        "gap": F.when(F.col("before") > 0, (F.col("open") - F.col("before")) / low("before") * 100).otherwise(0.0),
        "strength": F.when(spread > 0.001, body / spread).otherwise(0.0) * 100, "slope": (F.col("close") - F.col("m5")) / low("m5") * 100,
        "persistence": F.sum("rise").over(w.rowsBetween(-4, 0)) / 5,
    }).withColumn("busy_change", F.col("open_dir") * F.col("busy") / 10)
    return x.where("i >= 6 AND n >= 10").select("symbol", "d", *[F.round(c, 4).alias(c) for c in MOODS], "close")


def mood_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_moods(daily_bars(spark, sf_dir)).drop("close")


QUERIES["mood_vectors"] = mood_vectors
SQL["mood_vectors"] = f"""WITH {daily()},
 x AS (SELECT *, lag(close) {over()} AS before, avg(volume) {over(20)} AS v20, avg(close) {over(5)} AS m5, row_number() {over()} AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
 y AS (SELECT *, (close - open) / greatest(open, 0.01) * 100 AS change, volume / greatest(v20, 1e-9) AS vr, sum(CASE WHEN close > before THEN 1 ELSE 0 END) {over(5)} AS rises FROM x)
 SELECT symbol, d, round(change, 4) AS open_dir, round((high - low) / greatest(open, 0.01) * 100, 4) AS amplitude,
  round((high - greatest(open, close)) / greatest(high - low, 0.001) - (least(open, close) - low) / greatest(high - low, 0.001), 4) AS shadows, round(vr, 4) AS busy,
  round(change * vr / 10, 4) AS busy_change, round(CASE WHEN before > 0 THEN (open / greatest(before, 0.01) - before / greatest(before, 0.01)) * 100 ELSE 0 END, 4) AS gap,
  round(CASE WHEN high - low > 0.001 THEN (close - open) / (high - low) * 100 ELSE 0 END, 4) AS strength, round((close - m5) / greatest(m5, 0.01) * 100, 4) AS slope, round(rises / 5, 4) AS persistence
 FROM y WHERE rn >= 7 AND n >= 10"""


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * x @ y.T, 0.0)


def k_means(x: np.ndarray, k: int, rounds: int = 100) -> tuple[np.ndarray, float]:
    """Labels and the sum of squared distances. Seeds: the row farthest from the mean, then each time the one farthest
    from all seeds, the first of equal ones. A row goes to the first of its nearest centres; a centre that no row is
    nearest to stays where it is."""
    at = [int(_squares(x, x.mean(axis=0)[None])[:, 0].argmax())]
    far = _squares(x, x[at])[:, 0]
    for _ in range(1, k):
        at.append(int(far.argmax()))
        far = np.minimum(far, _squares(x, x[at[-1:]])[:, 0])
    centres, labels = x[at].copy(), None
    for _ in range(rounds):
        d = _squares(x, centres)
        new = d.argmin(axis=1)
        if labels is not None and (new == labels).all():
            break
        labels = new
        n = np.bincount(labels, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, labels, x)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return labels, float(_squares(x, centres)[np.arange(len(x)), labels].sum())


def silhouette(x: np.ndarray, labels: np.ndarray, rows: int = 512) -> float:
    """The mean over all rows of (b - a) / max(a, b), a being the mean distance to the own cluster's others and b that to
    the nearest other cluster; 0 for a row alone. Some rows at a time, so that no square table is made. One cluster: 0."""
    names, own = np.unique(labels, return_inverse=True)
    if len(names) < 2:
        return 0.0
    member = np.zeros((len(x), len(names)))
    member[np.arange(len(x)), own] = 1.0
    n, total = member.sum(axis=0), 0.0
    for at in range(0, len(x), rows):
        s = slice(at, at + rows)
        to = np.sqrt(((x[s, None, :] - x[None, :, :]) ** 2).sum(axis=2)) @ member
        here = own[s]
        line = np.arange(len(here))
        a = to[line, here] / np.maximum(n[here] - 1, 1)
        to = to / n
        to[line, here] = np.inf
        b = to.min(axis=1)
        total += np.where(n[here] > 1, (b - a) / np.maximum(np.maximum(a, b), 1e-300), 0.0).sum()
    return total / len(x)


def best_clusters(x: np.ndarray) -> tuple[np.ndarray, int, float]:
    """Labels, their number and silhouette: of LEAST_K to MOST_K clusters (DAYS_PER_CLUSTER rows each at least) those of
    the greatest silhouette, of equal ones the fewest. Too few rows, or all equal: one cluster. Figures are
    standardised first; clusters are numbered in the order of their first row."""
    spread = x.std(axis=0) if len(x) else np.zeros(x.shape[1])
    most = min(MOST_K, len(x) // DAYS_PER_CLUSTER)
    if len(x) < LEAST_DAYS or (spread < 1e-9).all():
        return np.zeros(len(x), int), 1, 0.0
    z = (x - x.mean(axis=0)) / np.where(spread < 1e-9, 1.0, spread)
    best = None
    for k in range(LEAST_K, most + 1):
        labels, _ = k_means(z, k)
        worth = silhouette(z, labels)
        if best is None or worth > best[2] + 1e-12:
            best = labels, k, worth
    names, first, own = np.unique(best[0], return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[own], len(names), best[2]


def clustered(moods: DataFrame) -> DataFrame:
    """symbol, d, close, mood, moods (their number) and silhouette: every symbol's days clustered by themselves, in one
    grouped pass. A symbol's days are a few thousand rows; missing figures count as 0."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("d", ignore_index=True)
        rows["mood"], rows["moods"], rows["silhouette"] = best_clusters(rows[MOODS].fillna(0.0).to_numpy(float))
        return rows[["symbol", "d", "close", "mood", "moods", "silhouette"]]

    return moods.groupBy("symbol").applyInPandas(run, "symbol string, d date, close double, mood int, moods int, silhouette double")


def emotion_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a symbol and mood: days, the mean change of the day after, and the silhouette."""
    x = clustered(daily_moods(daily_bars(spark, sf_dir)))
    after = (F.lead("close").over(W.by_time()) / F.col("close") - 1) * 100
    return x.withColumn("after", after).groupBy("symbol", "mood", "moods", F.round("silhouette", 4).alias("silhouette")).agg(F.count("*").alias("days"), F.round(F.avg("after"), 4).alias("day_after"))


QUERIES["emotion_clusters"] = emotion_clusters


def stationary(p: np.ndarray, tolerance: float = 1e-12, rounds: int = 100_000) -> np.ndarray:
    """The distribution that the chain stays in, by powers of half the chain and half standing still, which has the
    same one and also settles where the chain itself only cycles. With several such distributions, the one reached from
    equal shares."""
    at = np.full(len(p), 1 / len(p))
    for _ in range(rounds):
        new = (at + at @ p) / 2
        if np.abs(new - at).max() < tolerance:
            return new
        at = new
    return at


def chain_features(p: np.ndarray, current: int) -> dict[str, float]:
    """Twelve figures of a chain: entropy rate, persistence, reversal, mode and entropy of the stationary distribution,
    mixing time by the second eigenvalue, the current state's likeliest and unlikeliest next ones, mean row entropy, and
    the spectral gap."""
    k, pi = len(p), stationary(p)
    entropy = lambda x: float(-(x[x > 0] * np.log2(x[x > 0])).sum())
    rows = [entropy(r) for r in p]
    second = sorted(np.abs(np.linalg.eigvals(p)), reverse=True)[1] if k > 1 else 0.0
    mixing = 1 / max(1 - second, 0.01) if k > 1 and second < 1 - 1e-9 else (k * 10.0 if k > 1 else 1.0)
    return {
        "entropy_rate": float(pi @ rows), "persistence": float(np.diag(p).mean()), "reversal": float(p[~np.eye(k, dtype=bool)].mean()) if k > 1 else 0.0,
        "mode": float(np.argmax(np.round(pi, 9))), "stationary_entropy": entropy(pi), "mixing": float(min(mixing, 100.0)), "best_p": float(p[current].max()), "worst_p": float(p[current].min()),
        "best": float(p[current].argmax()), "worst": float(p[current].argmin()), "stability": float(np.mean(rows)), "gap": float(1 - min(second, 1.0)),
    }


CHAIN = ["entropy_rate", "persistence", "reversal", "mode", "stationary_entropy", "mixing", "best_p", "worst_p", "best", "worst", "stability", "gap"]


def chains(states: DataFrame, alpha: float = 1.0) -> DataFrame:
    """symbol, states, current, the stationary distribution and the figures of chain_features(), from states (symbol, d,
    state: 0 to states - 1, states): transitions are counted by partial sums, smoothed by alpha, and each symbol's few
    counts are one small group. A symbol of one day has a uniform chain."""
    w = W.by_time()
    step = states.select("symbol", "d", "states", "state", F.lead("state").over(w).alias("next"))
    n = step.groupBy("symbol", "states", "state", "next").agg(F.count("*").alias("n"))
    names = ", ".join(f"{c} double" for c in CHAIN)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        k = int(rows["states"].iloc[0])
        known = rows.dropna(subset=["next"])
        count = np.zeros((k, k))
        np.add.at(count, (known["state"].astype(int), known["next"].astype(int)), known["n"])
        p = (count + alpha) / (count.sum(axis=1, keepdims=True) + alpha * k)
        current = int(rows.loc[rows["next"].isna(), "state"].iloc[0])
        return pd.DataFrame([{"symbol": rows["symbol"].iloc[0], "states": k, "current": current, "distribution": stationary(p).tolist(), **chain_features(p, current)}])

    return n.groupBy("symbol").applyInPandas(run, f"symbol string, states int, current int, distribution array<double>, {names}")


def emotion_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain of each symbol's moods."""
    x = clustered(daily_moods(daily_bars(spark, sf_dir)))
    out = chains(x.select("symbol", "d", F.col("mood").alias("state"), F.col("moods").alias("states")))
    return out.select("symbol", "states", "current", F.transform("distribution", lambda y: F.round(y, 6)).alias("distribution"), *[F.round(c, 4).alias(c) for c in CHAIN])


QUERIES["emotion_chains"] = emotion_chains


def state_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain of each symbol's falling, flat and rising days."""
    change = F.col("close") / F.lag("close").over(W.by_time())
    x = daily_bars(spark, sf_dir).select("symbol", "d", F.when(change > 1.02, 2).when(change < 0.98, 0).otherwise(1).alias("state"), F.lit(3).alias("states"))
    out = chains(x)
    return out.select("symbol", "current", *[F.round(F.col("distribution")[k], 5).alias(f"p{k}") for k in range(3)], *[F.round(c, 3).alias(c) for c in ("entropy_rate", "persistence", "stationary_entropy", "stability", "gap")])


QUERIES["state_chains"] = state_chains
#: Three states in closed form: the distribution by cofactors, the other eigenvalues from trace and determinant.
SQL["state_chains"] = f"""WITH {daily()},
 s AS (SELECT symbol, d, CASE WHEN close / lag(close) {over()} > 1.02 THEN 2 WHEN close / lag(close) {over()} < 0.98 THEN 0 ELSE 1 END AS a FROM bars),
 t AS (SELECT symbol, d, a, lead(a) {over()} AS b FROM s),
 n AS (SELECT symbol, {", ".join(f"count(*) FILTER (a = {i} AND b = {j}) + 1 AS n{i}{j}" for i in range(3) for j in range(3))}, max(a) FILTER (b IS NULL) AS current FROM t GROUP BY symbol),
 p AS (SELECT symbol, current, {", ".join(f"n{i}{j} / (n{i}0 + n{i}1 + n{i}2)::DOUBLE AS p{i}{j}" for i in range(3) for j in range(3))} FROM n),
 c AS (SELECT *, (1 - p11) * (1 - p22) - p12 * p21 AS c0, (1 - p00) * (1 - p22) - p02 * p20 AS c1, (1 - p00) * (1 - p11) - p01 * p10 AS c2,
  {", ".join(f"-(p{i}0 * log2(p{i}0) + p{i}1 * log2(p{i}1) + p{i}2 * log2(p{i}2)) AS h{i}" for i in range(3))}, p00 + p11 + p22 AS tr,
  p00 * (p11 * p22 - p12 * p21) - p01 * (p10 * p22 - p12 * p20) + p02 * (p10 * p21 - p11 * p20) AS det FROM p),
 q AS (SELECT *, {", ".join(f"c{i} / (c0 + c1 + c2) AS q{i}" for i in range(3))}, (tr - 1) * (tr - 1) - 4 * det AS disc FROM c)
 SELECT symbol, current, {", ".join(f"round(q{i}, 5) AS p{i}" for i in range(3))}, round(q0 * h0 + q1 * h1 + q2 * h2, 3) AS entropy_rate, round(tr / 3, 3) AS persistence,
  round(-(q0 * log2(q0) + q1 * log2(q1) + q2 * log2(q2)), 3) AS stationary_entropy, round((h0 + h1 + h2) / 3, 3) AS stability,
  round(1 - CASE WHEN disc >= 0 THEN (abs(tr - 1) + sqrt(disc)) / 2 ELSE sqrt(det) END, 3) AS gap FROM q"""
