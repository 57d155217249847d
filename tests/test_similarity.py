"""The search for similar profiles against all pairs, with equal, opposite and empty vectors, and how much it compares."""

import re

import numpy as np
import pytest
from conftest import SF

from tickloom.operators import similarity

SCHEMA = "key long, vector array<double>"


def all_pairs(rows, k):
    keys, v = [r[0] for r in rows], np.array([r[1] for r in rows])
    n = np.linalg.norm(v, axis=1, keepdims=True)
    u = np.where(n < 1e-9, 0, v / np.maximum(n, 1e-9))
    s = np.round(u @ u.T, 4)
    out = set()
    for i, key in enumerate(keys):
        best = sorted((-s[i, j], o) for j, o in enumerate(keys) if j != i)[:k]
        out |= {(key, o, round(float(-x), 4) + 0.0, r) for r, (x, o) in enumerate(best, 1)}
    return out


@pytest.mark.parametrize(("seed", "n", "pivots", "tile"), [(1, 300, 7, 40), (2, 40, 50, 5), (3, 700, 12, 64), (4, 3, 4, 4)])
def test_nearest_is_all_pairs(spark, seed, n, pivots, tile):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, 5)) * (rng.random((n, 5)) < 0.7)
    v[: n // 3] = v[0]  # a third of all profiles are equal
    v[n // 2] = 0.0
    rows = [(int(k), [float(x) for x in y]) for k, y in zip(rng.permutation(n) * 3, v)]
    got = similarity.nearest(spark.createDataFrame(rows, SCHEMA), 4, pivots * 256, tile).collect()
    assert {(r.key, r.other, r.similarity, r.rank) for r in got} == all_pairs(rows, 4)


def test_no_profiles(spark):
    assert similarity.nearest(spark.createDataFrame([], SCHEMA), 4).count() == 0
    assert similarity.nearest(spark.createDataFrame([(1, [1.0, 2.0])], SCHEMA), 4).count() == 0


def test_vectors(spark):
    df = spark.createDataFrame([("a", 1.0, None, 3.0, 7.0, 2.0), ("b", 5.0, 5.0, 5.0, None, None), ("c", -1.0, -2.0, -3.0, 10.0, 4.0)], "k string, x double, y double, z double, best double, kinds double")
    got = {r.key: r.vector for r in similarity.profile_vectors(df, "k", ["x", "y", "z"], "best", "kinds").collect()}
    assert got == {"a": pytest.approx([1 / 3, 0.0, 1.0]), "b": [0.25, 0.1, 5.0], "c": [0.5, 0.4, -3.0]}


def test_fewer_pairs_than_the_square(spark):
    """Clustered profiles: tiles that can't hold a neighbour aren't visited."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(24, 6))
    visits = []
    for n in (1536, 6144):
        v = centres[rng.integers(0, 24, n)] + rng.normal(size=(n, 6)) * 0.01
        df = spark.createDataFrame([(i, [float(x) for x in y]) for i, y in enumerate(v)], SCHEMA)
        visits.append(similarity.compared(df, 3, tile=128) / n**2)
    assert visits[1] < visits[0] and visits[1] < 0.3


def test_near_copies_visit_few_tiles(spark):
    """Dense profiles with near copies, as those of the parts of repeated trades: a box is nearer than a cone, so few tiles are visited."""
    rng = np.random.default_rng(6)
    v = np.repeat(rng.random((700, 13)), 6, axis=0) + rng.normal(size=(4200, 13)) * 1e-6
    rows = [(i, [float(x) for x in y]) for i, y in enumerate(v)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert similarity.compared(df, 5, tile=128) < 0.15 * 4200**2
    got = similarity.nearest(df, 5, tile=128).collect()
    assert {(r.key, r.other, r.similarity, r.rank) for r in got} == all_pairs(rows, 5)


def test_one_direction_is_several_tiles(spark):
    """Different vectors of one direction can't be cut by planes; all are alike, and the first keys count."""
    rows = [(i, [1.0 + i, 2.0 + 2 * i]) for i in range(300)]
    got = similarity.nearest(spark.createDataFrame(rows, SCHEMA), 3, tile=16).collect()
    assert {(r.key, r.other, r.similarity, r.rank) for r in got} == all_pairs(rows, 3)


def test_sellers_are_counted_apart(spark):
    """No row of a part and a seller carries the sums of the other figures through a shuffle."""
    plan = similarity.part_profiles(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\(l_partkey#\d+L?, l_suppkey|merge_avg", plan)
