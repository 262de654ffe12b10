"""Vector search against all distances."""

import numpy as np
import pytest

from tidewell.operators import vectors as X


def table(spark, m, key, vec, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in row]) for i, row in enumerate(m)], f"{key} long, {vec} array<double>").repartition(3)


def exact(q, x, n, metric):
    out = {}
    for i, row in enumerate(q):
        d = ((x - row) ** 2).sum(1) if metric == "l2" else 1 - (x @ row) / np.sqrt((x * x).sum(1) * (row @ row))
        d = np.round(d, 9)
        out[i] = [(j, d[j]) for j in sorted(range(len(x)), key=lambda j: (d[j], j))[:n]]
    return out


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.chunk_id, r.distance))
    return out


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("small", [True, False])
def test_exact(spark, metric, small, monkeypatch):
    monkeypatch.setattr(X, "VECTORS", 50)
    monkeypatch.setattr(X, "QUESTIONS", 7)
    monkeypatch.setattr(X, "BROADCAST", 64 << 20 if small else 0)
    rng = np.random.default_rng(4)
    x, q = rng.normal(size=(300, 8)), rng.normal(size=(23, 8))
    x[100:200] = x[100]  # ties at the end of the list
    assert got(X.vector_top_n(table(spark, q, "query_id", "qvec"), table(spark, x, "chunk_id", "embedding"), 5, metric)) == exact(q, x, 5, metric)


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [0.5, None]), (5, [float("nan"), 1.0]), (6, [0.0, 0.0]), (7, [])]
    v = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    q = spark.createDataFrame([(1, [2.0, 0.0]), (2, None), (3, [1.0])], "query_id long, qvec array<float>")
    found = [(r.query_id, r.chunk_id, r["rank"]) for r in X.vector_top_n(q, v, 3).collect()]
    assert sorted(found) == [(1, 1, 0), (1, 6, 1), (3, 3, 0)]
    assert X.vector_top_n(q, v.limit(0), 3).count() == 0 and X.vector_top_n(q.limit(0), v, 3).count() == 0


def test_a_task_holds_few_distances_at_once(spark, monkeypatch):
    whole = X._distances

    def few(q, x, metric):
        assert len(q) * len(x) <= 64 * 4096
        return whole(q, x, metric)

    monkeypatch.setattr(X, "_distances", few)
    rng = np.random.default_rng(9)
    x, q = rng.normal(size=(5000, 4)), rng.normal(size=(600, 4))
    assert got(X.vector_top_n(table(spark, q, "query_id", "qvec").coalesce(1), table(spark, x, "chunk_id", "embedding").coalesce(1), 3)) == exact(q, x, 3, "cosine")


@pytest.mark.parametrize("waiting", [0, 2000, 32 << 20])
def test_packing_holds_few_vectors_of_many_lists(spark, monkeypatch, waiting):
    monkeypatch.setattr(X, "WAITING", waiting, raising=False)
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in rng.normal(size=2 + i % 2)], int(rng.integers(100))) for i in range(1500)]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<double>, list int").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        blocks = X.packed(df, "chunk_id", "embedding", 10, "ids", "m", keep="list").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    unpacked = [(i, [float(v) for v in m], b.list) for b in blocks for i, m in zip(b.ids, np.frombuffer(b.m).reshape(-1, b.dim), strict=True)]
    assert sorted(unpacked) == rows and max(len(b.ids) for b in blocks) < 20
    assert (len(blocks) > 800) == (waiting < 32 << 20)


@pytest.mark.parametrize("scale", [1.0, 3.0, 100.0])
def test_lists_keep_their_promise_at_any_scale(spark, tmp_path, scale):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    x = np.array([r.embedding for r in v.orderBy("vec_id").collect()], np.float64) * scale
    X.build_lists(spark, str(tmp_path / "lists"), table(spark, x, "chunk_id", "embedding"))
    found = got(X.search_lists(spark, str(tmp_path / "lists"), table(spark, x[::20], "query_id", "qvec"), 15))
    want = exact(x[::20], x, 15, "l2")
    assert all(len(found[i]) == 15 for i in want)
    assert np.mean([len({j for j, _ in found[i]} & {j for j, _ in want[i]}) / 15 for i in want]) >= 0.9


def test_lists_widen_until_there_are_enough(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = np.concatenate([np.zeros((300, 4)), rng.normal(size=(60, 4)) + 9])  # a group of copies, and others far away
    root = str(tmp_path / "lists")
    X.build_lists(spark, root, table(spark, x, "chunk_id", "embedding"))
    found = got(X.search_lists(spark, root, table(spark, x[-2:], "query_id", "qvec"), 100, probe=1))
    assert [len(f) for f in found.values()] == [100, 100]
    assert got(X.search_lists(spark, root, table(spark, x[-2:], "query_id", "qvec"), 500, probe=1)) == exact(x[-2:], x, 500, "l2")
    X.build_lists(spark, str(tmp_path / "none"), table(spark, x[:0], "chunk_id", "embedding"))
    assert X.search_lists(spark, str(tmp_path / "none"), table(spark, x[:1, :1], "query_id", "qvec"), 5).count() == 0
