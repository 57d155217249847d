"""Profiles as vectors, and the profiles most alike each of them: an exact search by blocks, without a table of all pairs.

Vectors of length 1 are dealt to tiles by the planes of a tree that a sample of them gives. A search in a vector's own
tile gives k similar ones; another tile is looked at only if the box around its vectors reaches as near. Equal vectors
are one, with their first keys; so many equal profiles don't meet each other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.sources.tables import table

QUERIES, SQL = {}, {}

#: A tree has LEAVES leaves for each pivot at most, each cut from as many vectors of the sample as LEAF.
PIVOTS, LEAVES, LEAF = 1024, 8, 8
#: The rows of a tile, and the parts in which a tile's visitors are dealt to it.
TILE, PARTS = 2048, 2
#: Half of the last digit of a similarity, which is rounded, and room for sums in another order.
_HALF = 0.00005 + 1e-9
#: Similarities are compared as whole numbers of their last digit.
_DIGIT = 10_000


def profile_vectors(profiles: DataFrame, key: str, columns: list[str], first: str, second: str) -> DataFrame:
    """key and vector: a profile's columns (null: 0) scaled from 0 to 1 by its own least and greatest. Where all are
    equal or none is above 0 they stay, but for the first two: first / 20 and second / 10."""
    x = profiles.select(F.col(key).alias("key"), F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]).alias("v"), F.col(first).alias("a"), F.col(second).alias("b"))
    least, most = F.array_min("v"), F.array_max("v")
    plain = F.concat(F.array(F.coalesce("a", F.lit(5.0)) / 20, F.coalesce("b", F.lit(1.0)) / 10), F.slice("v", 3, len(columns)))
    scaled = F.transform("v", lambda y: (y - F.col("least")) / (F.col("most") - F.col("least")))
    return x.withColumns({"least": least, "most": most}).select("key", F.when((F.col("most") > F.col("least")) & (F.col("most") > 0), scaled).otherwise(plain).alias("vector"))


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.stack(rows.to_numpy()) if len(rows) else np.zeros((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; those of no length stay 0."""
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.where(norm < 1e-9, 0.0, x / np.maximum(norm, 1e-9))


def _planes(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """A tree over vectors: the coordinate and the cut of node i, whose children are 2 i + 1 (up to the cut) and 2 i + 2.
    A leaf has coordinate -1. The widest coordinate is cut at its median."""
    at, cut = np.full(2 ** (depth + 1) - 1, -1), np.zeros(2 ** (depth + 1) - 1)
    held = {0: sample}
    for i in range(2**depth - 1):
        x = held.pop(i, None)
        if x is None or len(x) < 2:
            continue
        wide = int((x.max(axis=0) - x.min(axis=0)).argmax())
        y = x[:, wide]
        if y.max() == y.min():
            continue
        median = np.quantile(y, 0.5, method="lower")
        at[i], cut[i] = wide, median if median < y.max() else y[y < y.max()].max()
        held[2 * i + 1], held[2 * i + 2] = x[y <= cut[i]], x[y > cut[i]]
    return at, cut


def _leaves(x: np.ndarray, at: np.ndarray, cut: np.ndarray, depth: int) -> np.ndarray:
    """The leaf of each vector."""
    node = np.zeros(len(x), np.int64)
    for _ in range(depth):
        wide = at[node]
        right = x[np.arange(len(x)), np.maximum(wide, 0)] > cut[node]
        node = np.where(wide >= 0, 2 * node + 1 + right, node)
    return node


def _whole(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of vectors of length 1, in whole numbers of their last digit."""
    return np.rint(a @ b.T * _DIGIT).astype(np.int32)


def _kth(similarity: np.ndarray, number: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """The similarity of each row's k-th best column, columns counting `number` times, its own one once less; -2 where
    there are fewer."""
    m = min(k + 1, similarity.shape[1])
    best = np.argpartition(-similarity, m - 1, axis=1)[:, :m] if m < similarity.shape[1] else np.broadcast_to(np.arange(m), similarity.shape)
    found = np.take_along_axis(similarity, best, axis=1)
    order = np.argsort(-found, axis=1, kind="stable")
    found, best = np.take_along_axis(found, order, axis=1), np.take_along_axis(best, order, axis=1)
    enough = np.cumsum(number[best] - (best == own[:, None]), axis=1) >= k
    return np.where(enough.any(axis=1), found[np.arange(len(found)), enough.argmax(axis=1)], -2 * _DIGIT)


def _members(vectors: DataFrame) -> DataFrame:
    """Each key with the first key of those of an equal vector (node), and its place among them."""
    same = Window.partitionBy("vector")
    return vectors.withColumn("at", F.row_number().over(same.orderBy("key"))).withColumn("node", F.min("key").over(same.orderBy("key")))


def _searched(members: DataFrame, k: int, pivots: int, tile: int) -> tuple[DataFrame, DataFrame] | None:
    """The distinct vectors (node: their first key) with the first keys of those that may be among their k + 1 nearest,
    and how many pairs each tile's visits compare (n)."""
    # of equal vectors the first k + 1 keys are enough
    nodes = members.where(F.col("at") <= k + 1).groupBy("vector").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    nodes = nodes.select("keys", F.col("keys")[0].alias("node"), "vector", F.xxhash64("vector").alias("hash"))
    total = nodes.count()
    leaves = min(-(-2 * total // tile), LEAVES * pivots)
    found = nodes.orderBy("hash").limit(max(1, LEAF * leaves)).select("vector").toPandas()  # LEAVES x LEAF x pivots vectors at most
    kind = members.schema["key"].dataType.simpleString()
    if not len(found):
        return None
    depth = max(leaves - 1, 0).bit_length()
    at, cut = _planes(_unit(_matrix(found["vector"])), depth)
    width = len(found["vector"].iloc[0])

    def place(batches):
        for x in batches:
            if len(x):
                unit = _unit(_matrix(x["vector"]))
                yield pd.DataFrame({"keys": x["keys"], "node": x["node"], "unit": list(unit), "leaf": _leaves(unit, at, cut, depth), "hash": x["hash"]})

    placed = nodes.mapInPandas(place, f"keys array<{kind}>, node {kind}, unit array<double>, leaf long, hash long").persist()
    # a leaf of more rows than a tile's, such as many vectors of one direction, is several tiles: one row a leaf
    parts_of = placed.groupBy("leaf").agg(F.ceil(F.count("*") / tile).alias("tiles"))
    tiled = placed.join(F.broadcast(parts_of), "leaf").select("keys", "node", "unit", (F.col("leaf") * (1 << 30) + F.pmod("hash", "tiles")).alias("tile"))
    ends = [f(F.col("unit")[i]).alias(f"{n}{i}") for n, f in (("lo", F.min), ("hi", F.max)) for i in range(width)]
    boxes = tiled.groupBy("tile").agg(*ends).toPandas().sort_values("tile", ignore_index=True)  # one row a tile
    low, high = (boxes[[f"{n}{i}" for i in range(width)]].to_numpy() for n in ("lo", "hi"))
    names = boxes["tile"].to_numpy()

    def visits(x: pd.DataFrame) -> pd.DataFrame:
        """The tiles that a tile's vectors must visit, their own among them."""
        v = _matrix(x["unit"])
        n = x["keys"].map(len).to_numpy()
        out = []
        for a in range(0, len(x), 512):
            some = v[a : a + 512]
            kth = _kth(_whole(some, v), n, a + np.arange(len(some)), k)
            # the squared distance within which a vector is as similar; first for the box around all of these
            far = 2 - 2 * (kth / _DIGIT - _HALF)
            gap = np.maximum(np.maximum(low - some.max(axis=0), some.min(axis=0) - high), 0)
            near = np.flatnonzero((gap**2).sum(axis=1) <= far.max())
            square = np.zeros((len(some), len(near)))
            for c in range(width):
                y = some[:, c, None]
                square += np.maximum(np.maximum(low[near, c] - y, y - high[near, c]), 0) ** 2
            i, j = np.nonzero(square <= far[:, None])
            out.append(pd.DataFrame({"node": x["node"].to_numpy()[a + i], "unit": x["unit"].to_numpy()[a + i], "least": kth[i], "to": names[near[j]], "part": i % PARTS}))
        return pd.concat(out)

    def meet(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        """Of each visitor the k + 1 best of a tile, one of which may be itself; of equal ones those with the first keys."""
        out = [pd.DataFrame({"node": [], "others": [], "similarity": []}, dtype=object)]
        x = x.sort_values("node", ignore_index=True)
        keys = x["keys"].to_numpy()
        a, b = (_matrix(y["unit"]) for y in (q, x))
        for at in range(0, len(q) if len(x) else 0, 512):
            similarity = _whole(a[at : at + 512], b)
            i, j = np.nonzero(similarity >= q["least"].to_numpy()[at : at + 512, None] - 1)
            s = similarity[i, j]
            order = np.lexsort((j, -s, i))
            i, j, s = i[order], j[order], s[order]
            best = np.arange(len(i)) - np.searchsorted(i, i) <= k
            out.append(pd.DataFrame({"node": q["node"].to_numpy()[at + i[best]], "others": keys[j[best]], "similarity": s[best] / _DIGIT + 0.0}))
        return pd.concat(out[1:] or out)

    queries = tiled.groupBy("tile").applyInPandas(visits, f"node {kind}, unit array<double>, least int, to long, part int")
    dealt = tiled.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    near = queries.groupBy("to", "part").cogroup(dealt.groupBy("tile", "part")).applyInPandas(meet, f"node {kind}, others array<{kind}>, similarity double")
    sizes = tiled.groupBy("tile").agg(F.count("*").alias("rows"))
    return near, queries.groupBy("to").count().join(sizes, F.col("to") == F.col("tile")).select((F.col("count") * F.col("rows")).alias("n"))


def compared(vectors: DataFrame, k: int, pivots: int = PIVOTS, tile: int = TILE) -> int:
    """Pairs of distinct vectors whose similarity nearest() computes."""
    found = _searched(_members(vectors).persist(), k, pivots, tile)
    return found[1].agg(F.sum("n")).first()[0] if found else 0


def nearest(vectors: DataFrame, k: int, pivots: int = PIVOTS, tile: int = TILE) -> DataFrame:
    """For each key of (key, vector) the k most similar others: key, other, similarity (cosine to 4 digits; 0 with a
    vector of no length), rank. Ties by the other key. Keys are unique; no rows: none; fewer than k others: all."""
    members = _members(vectors).persist()  # vectors made by sums of fractions might differ when they are made again
    found = _searched(members, k, pivots, tile)
    if found is None:
        kind = vectors.schema["key"].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"key {kind}, other {kind}, similarity double, rank int")
    near, _ = found
    # of the first k + 1 keys of each distinct vector the k + 1 best for each node, and of those the k best for each key
    ranked = Window.partitionBy("node").orderBy(F.desc("similarity"), "other")
    top = near.select("node", F.explode("others").alias("other"), "similarity").withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= k + 1)
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("similarity"), "other"))
    pairs = members.select("key", "node").join(top, "node").where("key <> other")
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("key", "other", "similarity", "rank")


#: Stand-ins for a profile's entropy, cycle, reaction and tail figures: statistics of a part's trades.
_STATISTICS = {
    "price": "avg(l_extendedprice / l_quantity) / 100", "price_spread": "stddev_pop(l_extendedprice / l_quantity) / 100", "size": "avg(l_quantity)", "size_spread": "stddev_pop(l_quantity)",
    "trades": "count(*)", "discount": "avg(l_discount) * 100", "tax": "avg(l_tax) * 100", "returned": "avg(CASE WHEN l_returnflag = 'R' THEN 20.0 ELSE 0.0 END)",
    "open": "avg(CASE WHEN l_linestatus = 'O' THEN 20.0 ELSE 0.0 END)", "sellers": "count(DISTINCT l_suppkey)", "lines": "avg(l_linenumber)", "smallest": "min(l_quantity)", "largest": "max(l_quantity)",
}


def part_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sellers are counted apart: beside the other figures each pair of part and seller would carry all their sums."""
    lines = table(spark, sf_dir, "lineitem").where("l_partkey IS NOT NULL")  # no key: no neighbours, and none's
    figures = lines.groupBy("l_partkey").agg(*[F.expr(x).cast("double").alias(n) for n, x in _STATISTICS.items() if n != "sellers"])
    sellers = lines.select(F.col("l_partkey").alias("part"), "l_suppkey").repartition("part").groupBy("part").agg(F.expr(_STATISTICS["sellers"]).cast("double").alias("sellers"))
    rows = figures.join(sellers, F.col("l_partkey") == F.col("part"))
    return profile_vectors(rows, "l_partkey", list(_STATISTICS), "trades", "sellers")


def profile_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five parts whose profiles are most alike each part's."""
    return nearest(part_profiles(spark, sf_dir), 5)


QUERIES["profile_neighbours"] = profile_neighbours
SQL["profile_neighbours"] = f"""WITH s AS (SELECT l_partkey AS key, {", ".join(f"CAST({x} AS DOUBLE) AS {n}" for n, x in _STATISTICS.items())} FROM lineitem GROUP BY 1),
 l AS (SELECT key, [{", ".join(_STATISTICS)}] AS v, trades, sellers FROM s),
 u AS (SELECT key, CASE WHEN list_max(v) > list_min(v) AND list_max(v) > 0 THEN [(x - list_min(v)) / (list_max(v) - list_min(v)) FOR x IN v] ELSE [trades / 20, sellers / 10] || v[3:] END AS v FROM l),
 p AS (SELECT a.key, b.key AS other, coalesce(round(list_cosine_similarity(a.v, b.v), 4), 0) AS similarity FROM u a JOIN u b ON a.key <> b.key)
 SELECT key, other, similarity, row_number() OVER (PARTITION BY key ORDER BY similarity DESC, other) AS rank FROM p QUALIFY rank <= 5"""
