"""Embedders and domains that users add."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions.embed import embedder, hashed_trigrams, with_vectors
from tidewell.operators import domains as D
from tidewell.operators import insight as I
from tidewell.operators import vectors as X
from tidewell.plans import QUERIES


def test_embedder_gives_each_text_its_vector(spark):
    texts = ["abc", None, "", "Abc", "xyz " * 300, "abcd"] * 60
    df = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string").repartition(5)
    embed = embedder(hashed_trigrams, rows=7)
    got = {r.chunk_id: r.v for r in df.select("chunk_id", embed("text").alias("v")).collect()}
    for i, t in enumerate(texts):
        assert got[i] is None if t is None else np.allclose(got[i], hashed_trigrams()([t])[0], atol=1e-6)
    near = X.vector_top_n(df.filter("chunk_id = 5").select(F.col("chunk_id").alias("query_id"), embed("text").alias("qvec")), df.filter("chunk_id < 5").select("chunk_id", embed("text").alias("embedding")), 2)
    assert [r.chunk_id for r in near.orderBy("rank").collect()] == [0, 3]


def test_hybrid_search_with_an_embedder(spark, sf):
    from tidewell.plans import QUERIES

    rows = QUERIES["i13_hybrid_embedded"](spark, sf).collect()
    asked = spark.read.parquet(f"{sf}/benchmark.parquet").count()
    assert len({r.query_id for r in rows}) == asked and len({(r.query_id, r.doc_id) for r in rows}) == len(rows) <= 5 * asked


def test_vectors_of_a_table_are_those_of_the_column_function(spark):
    texts = ["abc", None, "", "a", "\U0001f600 가나다 é", "xyz " * 300] * 60
    df = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string").repartition(5)
    got = {r.chunk_id: (r.text, r.embedding) for r in with_vectors(df, hashed_trigrams, rows=7).collect()}
    assert got == {r.chunk_id: (r.text, r.v) for r in df.select("*", embedder(hashed_trigrams)("text").alias("v")).collect()} and len(got) == len(texts)
    assert with_vectors(df.limit(0), hashed_trigrams).count() == 0


def test_chunks_wait_for_vectors_without_their_documents(spark, sf):
    plan = QUERIES["i13_hybrid_embedded"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and not [line for line in plan.splitlines() if "EvalPython" in line and "_w#" in line]


def test_domains(spark, monkeypatch):
    monkeypatch.setattr(D, "REGISTRY", dict(D.REGISTRY))
    mine = D.register(D.Domain("mine", ("a",), {"rows": lambda df: df.agg(F.count("*").alias("n"))}))
    assert D.register(mine) is mine
    with pytest.raises(ValueError, match="already"):
        D.register(D.Domain("mine", (), {}))
    df = spark.createDataFrame([(1,), (None,)], "a int")
    assert D.analyse(df, "mine")["rows"].first().n == 2
    with pytest.raises(ValueError, match="need date, amount"):
        D.analyse(df, "sales")
    with pytest.raises(KeyError, match="no domain"):
        D.analyse(df, "none")
    assert {r.domain: r.coverage for r in D.coverage(df, ["a"]).collect()} == {"mine": 0.5, "sales": 0.0, "voc": 0.0}


def test_several_domains_may_fit(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:00:{i:02d}", 3 * i, "view", 1.0, '{"k": 1}') for i in range(1, 7)]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    events.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.domain: (r.coverage, r.chosen) for r in QUERIES["e18_domain_coverage"](spark, str(tmp_path)).collect()}
    assert got == {"rated": (1.0, True), "voc": (1.0, True), "sales": (0.0, False)}
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert {r.domain: (r.fits, r.chosen) for r in I.domain_coverage(df, {"x": ["a"], "y": ["b"]}, ["a"]).collect()} == {"x": (True, False), "y": (True, False)}
