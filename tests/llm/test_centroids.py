"""Clustering with ns-bounds against plain rounds over all distances."""

import hashlib

import numpy as np
import pytest

from tidewell.llm import centroids as C


def plain(rows, k=40, rounds=5, scale=256):
    """(id, cluster, distance, cluster inertia, inertia, centroid hash) of (id, vector) rows."""
    x = np.floor(np.array([v for _, v in rows], np.float64) * scale).astype(np.int64)
    order = sorted(range(len(rows)), key=lambda i: (hashlib.sha256(f"2:{'' if rows[i][0] is None else rows[i][0]}".encode()).hexdigest(), x[i].tolist()))
    c = x[order[:k]]
    for left in range(rounds, -1, -1):
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        a = d.argmin(1)
        if left:
            c = np.array([[int(s) // int((a == j).sum()) for s in x[a == j].sum(0)] if (a == j).any() else c[j] for j in range(len(c))])
    best = d[np.arange(len(x)), a]
    return [(rows[i][0], int(a[i]), int(best[i]), int(best[a == a[i]].sum()), int(best.sum()), hashlib.sha256(",".join(map(str, c[a[i]])).encode()).hexdigest()) for i in range(len(x))]


@pytest.mark.parametrize("spread", [0.02, 0.3, 2e4])
def test_bounds_keep_every_assignment(spread):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(20, 8))
    x = np.floor((middles[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 8)) * spread) * 256).astype(np.int64)
    x[:50] = x[0]
    history = x[rng.choice(3000, 19, replace=False)][None]
    groups = 3
    cluster, own, own_round = np.zeros(3000, np.int32), np.zeros(3000, np.int64), np.zeros(3000, np.int32)
    low, low_round = np.full((3000, groups), -np.inf, np.float32), np.zeros((3000, groups), np.uint8)
    cost = []
    for _ in range(9):
        cost.append(C.assign(x, history, cluster, own, own_round, low, low_round))
        d = ((x[:, None] - history[-1][None]) ** 2).sum(2)
        assert (cluster == d.argmin(1)).all()
        new = [x[cluster == j].sum(0) // max(1, (cluster == j).sum()) if (cluster == j).any() else history[-1][j] for j in range(19)]
        history = np.concatenate([history, np.array([new])])
    assert spread > 1 or cost[-1] < 3000 * 19 / 2


def test_ends_beyond_floats():
    x = np.array([[2**28, 0], [-(2**28), 1], [2**28 - 1, 3]], np.int64)
    assert (C.distances(x, x) == ((x[:, None] - x[None]) ** 2).sum(2)).all()


def test_odd_vectors(spark):
    bad = [(9, None), (9, [0.1]), (9, [0.5, None]), (9, [float("nan"), 1.0]), (9, [1.0, float("inf")])]
    rng = np.random.default_rng(1)
    good = [(i % 90, [float(np.float32(a)) for a in rng.normal(size=2)]) for i in range(200)] + [(None, [0.5, 0.5])] + [(7, [0.25, 0.25])] * 60
    df = spark.createDataFrame(bad + good, "vec_id long, embedding array<float>").selectExpr("*", "1 AS cluster", "2 AS v", "3 AS own")
    got = C.cluster_vectors(df, 7, 3, dims=2).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain(good, 7, 3), key=repr)
    few = C.cluster_vectors(df.filter("vec_id IS NULL"), dims=2).collect()
    assert [tuple(r)[:5] for r in few] == [(None, 0, 0, 0, 0)]
    assert C.cluster_vectors(df.filter("vec_id = 9 AND embedding IS NULL"), dims=2).count() == 0
    with pytest.raises(ValueError, match="64 bits"):
        C.cluster_vectors(spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>"), dims=2)


def test_many_rows_alike_stay_spread(spark):
    same = spark.range(0, 4000, 1, 8).selectExpr("id AS vec_id", "IF(id % 3 = 0, array(1.0D, 2.0D), array(rand(1), rand(2))) AS embedding")
    out = C.cluster_vectors(same, 5, 2, dims=2)
    assert out.count() == 4000 and out.rdd.getNumPartitions() > 1
