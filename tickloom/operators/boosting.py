"""Boosted trees for classes, values and ranks within a day: gradient sums over binned features, one job a level for
all models that are fitted to the same rows.

Rows stay where they are: a task adds up the gradients of its rows by node, feature and bin, and only these sums, whose
number is nodes x features x bins, reach the driver, which picks the splits. Gradients are rounded to whole numbers
before they are added, so that sums, and with them the model, don't depend on how rows are dealt out. Bins are cut at
quantiles of a bounded sample of rows, chosen by hash; everything else is counted over all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.bars import daily_bars

QUERIES, SQL = {}, {}

#: Rows from whose values the bins are cut, and the bins of a feature.
SAMPLE_ROWS, BINS = 20_000, 32
#: Parts of one that gradients are rounded to.
UNIT = 1 << 20


@dataclass
class Tree:
    """Nodes by number: the children of node i are 2 i + 1 (value <= edge, or missing) and 2 i + 2. A leaf has feature -1."""

    feature: list[int]
    bin: list[int]
    value: list[float]

    def leaves(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """The node that each row reaches within so many levels."""
        feature, cut = np.array(self.feature), np.array(self.bin)
        node = np.zeros(len(bins), np.int64)
        for _ in range(depth):
            at = feature[node]
            right = bins[np.arange(len(bins)), np.maximum(at, 0)] > cut[node]
            node = np.where(at >= 0, 2 * node + 1 + right, node)
        return node


@dataclass
class Boosted:
    kind: str
    features: list[str]
    edges: list[list[float]]
    base: float
    depth: int
    trees: list[Tree] = field(default_factory=list)

    def bins(self, rows: pd.DataFrame) -> np.ndarray:
        """How many edges lie below each value; missing values are below all."""
        out = np.zeros((len(rows), len(self.features)), np.int16)
        for k, (name, edges) in enumerate(zip(self.features, self.edges)):
            x = rows[name].to_numpy(float)
            out[:, k] = np.searchsorted(edges, np.where(np.isnan(x), -np.inf, x), "left")
        return out

    def margins(self, bins: np.ndarray) -> np.ndarray:
        total = np.full(len(bins), self.base)
        for tree in self.trees:
            total += np.array(tree.value)[tree.leaves(bins, self.depth)]
        return total

    def column(self) -> Column:
        """The margin as nested conditions, which Spark compiles; no Python takes part in scoring."""

        number = lambda x: f"CAST('{float(x)!r}' AS DOUBLE)"

        def node(tree: Tree, i: int) -> str:
            if tree.feature[i] < 0:
                return number(tree.value[i])
            x, edges = f"CAST(`{self.features[tree.feature[i]]}` AS DOUBLE)", self.edges[tree.feature[i]]
            left = f"{x} IS NULL OR isnan({x})"
            if tree.bin[i] < len(edges):
                left += f" OR {x} <= {number(edges[tree.bin[i]])}"
            return f"CASE WHEN {left} THEN {node(tree, 2 * i + 1)} ELSE {node(tree, 2 * i + 2)} END"

        total = F.lit(self.base)
        for tree in self.trees:
            total = total + F.expr(node(tree, 0))  # one call for a tree; calls to the JVM take longer than its scores
        return total

    def score(self) -> Column:
        """A probability for classes, else the margin."""
        return 1 / (1 + F.exp(-self.column())) if self.kind == "class" else self.column()


def pair_gradients(label: np.ndarray, margin: np.ndarray, rows: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Logistic gradients of all pairs of a day with different labels, the higher label first; some rows at a time."""
    g, h = np.zeros(len(label)), np.zeros(len(label))
    for at in range(0, len(label), rows):
        s = slice(at, at + rows)
        sign = np.sign(label[s, None] - label[None, :])
        p = 1 / (1 + np.exp(sign * (margin[s, None] - margin[None, :])))
        g[s] = -(sign * p).sum(axis=1)
        h[s] = (np.abs(sign) * p * (1 - p)).sum(axis=1)
    n = max(len(label) - 1, 1)
    return g / n, h / n


def gradients(kind: str, label: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss; those of ranks are of one day's rows."""
    if kind == "class":
        p = 1 / (1 + np.exp(-margin))
        return p - label, p * (1 - p)
    if kind == "value":
        return margin - label, np.ones(len(label))
    return pair_gradients(label, margin)


def _whole_days(frames: Iterator[pd.DataFrame], day: str) -> Iterator[pd.DataFrame]:
    """Rows that come sorted by day, some whole days at a time."""
    held: list[pd.DataFrame] = []
    for rows in frames:
        if not len(rows):
            continue
        if held and held[-1][day].iloc[-1] != rows[day].iloc[0]:
            yield pd.concat(held, ignore_index=True)
            held = []
        same = (rows[day] == rows[day].iloc[-1]).to_numpy()
        if not same.all():
            yield pd.concat([*held, rows[~same]], ignore_index=True)
            held = []
        held.append(rows[same])
    if held:
        yield pd.concat(held, ignore_index=True)


def _sums(fitted: list[tuple[Boosted, str, Tree]], rows: DataFrame, day: str, level: int) -> list[pd.DataFrame]:
    """For each model, with its label and tree, sums of gradients by node of the level, feature and bin, of all rows
    with the label."""
    width, nodes = len(fitted[0][0].features) * (BINS + 1), 2**level
    by_day = any(model.kind == "rank" for model, _, _ in fitted)

    def add(total: np.ndarray, model: Boosted, tree: Tree, x: pd.DataFrame, y: np.ndarray) -> None:
        bins = model.bins(x)
        margin = model.margins(bins)
        if model.kind == "rank":
            d = x[day].to_numpy()
            edges = [0, *(np.flatnonzero(d[1:] != d[:-1]) + 1).tolist(), len(d)]
            g, h = (np.concatenate(z) for z in zip(*[gradients("rank", y[lo:hi], margin[lo:hi]) for lo, hi in zip(edges[:-1], edges[1:])]))
        else:
            g, h = gradients(model.kind, y, margin)
        node = tree.leaves(bins, level) - (nodes - 1)
        at = node >= 0
        cells = (node[at, None] * len(model.features) + np.arange(len(model.features))) * (BINS + 1) + bins[at]
        for k, part in enumerate((np.rint(g[at] * UNIT).astype(np.int64), np.rint(h[at] * UNIT).astype(np.int64), np.ones(at.sum(), np.int64))):
            np.add.at(total[k], cells.ravel(), np.repeat(part, len(model.features)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(fitted), 3, nodes * width), np.int64)
        for x in _whole_days(frames, day) if by_day else frames:
            for i, (model, label, tree) in enumerate(fitted):
                known = x[label].notna().to_numpy()
                if known.any():
                    add(total[i], model, tree, x[known], x[label].to_numpy(float)[known])
        i, used = np.nonzero(total[:, 2])
        yield pd.DataFrame({"cell": i * nodes * width + used, "g": total[i, 0, used], "h": total[i, 1, used], "n": total[i, 2, used]})

    out = rows.mapInPandas(run, "cell long, g long, h long, n long").groupBy("cell").agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")])
    out = out.toPandas()  # models x nodes x features x bins at most
    of = out["cell"] // (nodes * width)
    out["cell"] %= nodes * width
    return [out[of == i] for i in range(len(fitted))]


def best_splits(sums: pd.DataFrame, nodes: int, features: int, smooth: float, least: int) -> list[tuple[int, int, tuple, tuple, tuple] | None]:
    """For each node its best (feature, bin), with the sums g, h and n of its own rows, and of those to the left and the
    right; feature -1 where no split gains. Of equal gains the first feature's first bin. None: no rows."""
    table = np.zeros((3, nodes * features * (BINS + 1)))
    table[:, sums["cell"].to_numpy()] = sums[["g", "h", "n"]].to_numpy(float).T
    g, h, n = table.reshape(3, nodes, features, BINS + 1)
    out = []
    for k in range(nodes):
        total = g[k, 0].sum(), h[k, 0].sum(), n[k, 0].sum()
        if not total[2]:
            out.append(None)
            continue
        left = [x[k].cumsum(axis=1)[:, :-1] for x in (g, h, n)]
        right = [t - x for t, x in zip(total, left)]
        worth = lambda g, h: (g / UNIT) ** 2 / np.maximum(h / UNIT + smooth, 1e-12)
        gain = worth(left[0], left[1]) + worth(right[0], right[1]) - worth(total[0], total[1])
        gain[(left[2] < least) | (right[2] < least)] = -1.0
        f, b = divmod(int(gain.argmax()), BINS)
        own, *sides = [(x[0] / UNIT, x[1] / UNIT, int(x[2])) for x in (total, *([z[f, b] for z in side] for side in (left, right)))]
        out.append((f if gain[f, b] > 1e-9 else -1, b, own, *sides))
    return out


def fit(rows: DataFrame, features: list[str], label: str, kind: str = "class", day: str = "d", rounds: int = 20, depth: int = 3, rate: float = 0.2, smooth: float = 1.0, least: int = 20) -> Boosted:
    """Boosted trees over rows with a label. kind: class (0 or 1), value, or rank (order within a day).

    Rows without a label are left out; missing features are below all others. One row or one class: a constant. No
    rows: 0. For ranks the rows of a day, one for each symbol, are in one task.
    """
    return fit_all(rows, features, [(kind, label)], day, rounds, depth, rate, smooth, least)[0]


def fit_all(rows: DataFrame, features: list[str], targets: list[tuple[str, str]], day: str = "d", rounds: int = 20, depth: int = 3, rate: float = 0.2, smooth: float = 1.0, least: int = 20) -> list[Boosted]:
    """What fit() gives for each (kind, label); all models grow by a level in one pass over the rows."""
    named = [F.col(c).cast("double").alias(c) for c in dict.fromkeys([*features, *(label for _, label in targets)])]
    known = {label: F.col(label).isNotNull() & ~F.isnan(label) for _, label in targets}
    rows = rows.select(day, *named).where(reduce(or_, known.values()))
    if any(kind == "rank" for kind, _ in targets):
        rows = rows.repartition(day).sortWithinPartitions(day)
    rows = rows.persist()
    marks = np.arange(1, BINS) / BINS
    means = rows.agg(*[F.avg(F.when(known[label], F.col(label)).cast("decimal(30,9)")) for _, label in targets]).first()
    models = []
    for (kind, label), mean in zip(targets, means):
        order = F.xxhash64(*[F.coalesce(F.col(c), F.lit(-1.0)) for c in (*features, label)])
        sample = rows.where(known[label]).orderBy(order, *features).limit(SAMPLE_ROWS).select(*features).toPandas()
        edges = [np.unique(np.quantile(x, marks)).tolist() if len(x := sample[c].dropna().to_numpy(float)) else [] for c in features]
        mean = float(mean or 0)
        base = {"class": float(np.log(max(mean, 1e-6) / max(1 - mean, 1e-6))), "value": mean, "rank": 0.0}[kind]
        models.append(Boosted(kind, features, edges, base, depth))
    growing = list(zip(models, [label for _, label in targets]))
    size = 2 ** (depth + 1) - 1
    value = lambda sums: -rate * sums[0] / (sums[1] + smooth)
    for _ in range(rounds):
        trees = [(model, label, Tree([-1] * size, [0] * size, [0.0] * size)) for model, label in growing]
        split = trees
        for level in range(max(depth, 1)):
            if not split:
                break
            for (_, _, tree), sums in zip(split, _sums(split, rows, day, level)):
                for k, found in enumerate(best_splits(sums, 2**level, len(features), smooth, least)):
                    if not found:
                        continue
                    i = 2**level - 1 + k
                    tree.value[i] = value(found[2])
                    if level < depth:
                        tree.feature[i], tree.bin[i] = found[:2]
                    if level == depth - 1 and found[0] >= 0:  # the sums of the last level are those of the two sides
                        for child, side in zip((2 * i + 1, 2 * i + 2), found[3:]):
                            tree.value[child] = value(side) if side[2] else 0.0
            split = [x for x in split if any(f >= 0 for f in x[2].feature[2**level - 1 : 2 ** (level + 1) - 1])]
        for model, _, tree in trees:
            model.trees.append(tree)
        growing = [(model, label) for model, label, tree in trees if tree.feature[0] >= 0]
        if not growing:
            break
    rows.unpersist()
    return models


def folds(days: DataFrame, n: int, gap: int, day: str = "d") -> list[tuple]:
    """n folds in order of time over the distinct days: (last training day, first test day, last test day), the training
    days ending `gap` days before the test begins, so that no label of theirs looks into it. Days are one short column."""
    found = sorted(r[0] for r in days.select(day).distinct().collect())  # one value a day
    cuts = [len(found) * (k + 1) // (n + 1) for k in range(n + 1)]
    return [(found[a - 1 - gap], found[a], found[b - 1]) for a, b in zip(cuts[:-1], cuts[1:]) if a - 1 - gap >= 0 and b > a]


def auc(rows: DataFrame, score: str, label: str) -> float:
    """The chance that a row of class 1 scores above one of class 0, ties by half: from counts by score, rounded to 9
    digits, ranked by distinct score."""
    by = rows.groupBy(F.round(score, 9).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("one"), F.count("*").alias("n"))
    below = F.sum(F.col("n") - F.col("one")).over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1))
    x = by.withColumn("zero", F.col("n") - F.col("one")).withColumn("below", F.coalesce(below, F.lit(0)))
    won, ones, zeros = x.agg(F.sum(F.col("one") * (F.col("below") + F.col("zero") / 2)), F.sum("one"), F.sum("zero")).first()
    return float(won / (ones * zeros)) if ones and zeros else float("nan")


def ndcg(rows: DataFrame, score: str, gain: str, k: int = 10, day: str = "d") -> float:
    """Mean over days of the discounted gains of the k best scores by those of the k best gains."""
    place = lambda c: F.row_number().over(Window.partitionBy(day).orderBy(F.desc(c), F.desc(score), gain))
    worth = lambda at: F.sum(F.when(F.col(at) <= k, F.col(gain) / F.log2(F.col(at) + 1)))
    by = rows.withColumns({"_at": place(score), "_ideal": place(gain)}).groupBy(day).agg((worth("_at") / worth("_ideal")).alias("x"))
    return by.agg(F.avg("x")).first()[0]


_FEATURES = {
    "vs_5": "close / m5 - 1", "vs_20": "close / m20 - 1", "vs_60": "close / m60 - 1", "change": "close / before - 1", "range": "(high - low) / close",
    "busy": "volume / v20", "busy_5": "v5 / v20", "place": "(close - low20) / nullif(high20 - low20, 0)",
}


def labelled_bars(bars: DataFrame, ahead: int = 3) -> DataFrame:
    """symbol, d, the features of each bar, the change in percent `ahead` bars later (null at the end), whether it is
    above 0, and its fifth (0 to 4) among the day's."""
    w = Window.partitionBy("symbol").orderBy("d")
    last = lambda f, c, n: f(c).over(w.rowsBetween(1 - n, 0))
    x = bars.select(
        "*", *[last(F.avg, "close", n).alias(f"m{n}") for n in (5, 20, 60)], *[last(F.avg, "volume", n).alias(f"v{n}") for n in (5, 20)], last(F.max, "high", 20).alias("high20"),
        last(F.min, "low", 20).alias("low20"), F.lag("close").over(w).alias("before"), F.lead("close", ahead).over(w).alias("later"),
    )
    x = x.select("symbol", "d", *[F.expr(e).alias(n) for n, e in _FEATURES.items()], ((F.col("later") / F.col("close") - 1) * 100).alias("later"))
    day = Window.partitionBy("d", F.col("later").isNull())
    fifth = F.floor((F.rank().over(day.orderBy("later")) - 1) * 5 / F.count("*").over(day))
    known = lambda c: F.when(F.col("later").isNotNull(), c)
    return x.select("*", known((F.col("later") > 0).cast("double")).alias("up"), known(fifth.cast("double")).alias("fifth"))


def boosted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the last fold's test days by models of the days before it: probability of a rise, change, and rank of
    the day's symbols."""
    rows = labelled_bars(daily_bars(spark, sf_dir)).persist()
    end, first, last = folds(rows, 3, 3)[-1]
    train, names = rows.where(F.col("d") <= end), list(_FEATURES)
    targets = [("class", "up"), ("value", "later"), ("rank", "fifth")]
    models = {model.kind: model for model in fit_all(train, names, targets, rounds=6)}
    test = rows.where(F.col("d").between(first, last))
    place = F.row_number().over(Window.partitionBy("d").orderBy(F.desc("rank_score"), "symbol"))
    out = test.select("symbol", "d", models["class"].score().alias("probability"), models["value"].score().alias("change"), models["rank"].score().alias("rank_score"))
    return out.withColumn("place", place)


QUERIES["boosted_scores"] = boosted_scores
