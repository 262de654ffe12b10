"""A third of all rows alike: no task gets or makes all of them, and each has its row in the result."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewell.llm import packing, shared, topk_search, url_filter
from tidewell.llm.queries import TOKENIZERS, URL_RULES


@pytest.fixture
def whole_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def largest_share(df):
    """Rows of the largest partition by those of an even one."""
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(sizes) * 8 / sum(sizes)


def test_repeated(spark, monkeypatch, whole_partitions):
    monkeypatch.setattr(shared, "COPIES", 50)
    rows = spark.createDataFrame([("a", 1), ("b", 50), ("c", 51), ("d", 3001)], "x string, copies long")
    out = shared.repeated(rows, "copies", "no")
    assert Counter((r.x, r.no) for r in out.collect()) == Counter((x, i) for x, n in [("a", 1), ("b", 50), ("c", 51), ("d", 3001)] for i in range(n))
    assert largest_share(out) < 3


def test_packing(spark, monkeypatch, whole_partitions):
    monkeypatch.setattr(shared, "COPIES", 50)
    seen, real = {}, packing.cut
    monkeypatch.setattr(packing, "cut", lambda df, name: seen.setdefault(name, real(df, name)))
    n = F.col("id")
    docs = spark.range(6000).select(F.when(n % 3 == 0, -1).otherwise(n).alias("doc_id"), F.when(n % 3 == 0, F.lit("the same text")).otherwise(F.concat(F.lit("number "), n)).alias("text"))
    out = packing.pack_documents(docs, tokenizer=f"{TOKENIZERS}/word_bpe_49k.json", size=64)
    assert seen["pieces"].count() == 4001
    got = sorted((r.sequence_id, r.offset, r.length, r.doc_id) for r in out.collect())
    assert Counter(r[3] for r in got) == Counter({-1: 2000, **{i: 1 for i in range(6000) if i % 3}})
    at, end = None, 0
    for seq, offset, length, _ in got:
        end = 0 if seq != at else end
        assert offset == end and (end := end + length) <= 64
        at = seq
    assert largest_share(out) < 2


def test_urls(spark, monkeypatch, whole_partitions):
    monkeypatch.setattr(shared, "COPIES", 50)
    n = F.col("id")
    pages = spark.range(6000).select(F.when(n % 3 == 0, -1).otherwise(n).alias("page_id"), F.when(n % 3 == 0, F.lit("http://com/en/x")).otherwise(F.concat(F.lit("http://net/de/"), n)).alias("url"))
    out = url_filter.judge_urls(pages, URL_RULES)
    got = Counter((r.page_id, r.verdict) for r in out.collect())
    assert got == Counter({(-1, "block"): 2000, **{(i, "allow"): 1 for i in range(6000) if i % 3}})
    assert largest_share(out) < 2


def test_url_ids_beside_null(spark):
    big = 2**53 + 1
    pages = spark.createDataFrame([(big, "http://com/en/x"), (None, "http://com/en/y"), (None, "http://com/en/y")], "page_id long, url string")
    assert Counter(r.page_id for r in url_filter.judge_urls(pages, URL_RULES).collect()) == Counter({None: 2, big: 1})


def test_top_k(spark, monkeypatch):
    """1000 rows alike in all, 1000 of one id with vectors of their own, 1000 others."""
    seen, real = {}, topk_search.cut
    monkeypatch.setattr(topk_search, "cut", lambda df, name: seen.setdefault(name, real(df, name)))
    rng = np.random.default_rng(5)
    rows = [(-1, [0.5, 0.25, 0.0])] * 1000 + [(-2, list(map(float, rng.normal(size=3)))) for _ in range(1000)] + [(i, list(map(float, rng.normal(size=3)))) for i in range(1000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk_search.exact_top_k(df, F.col("vec_id") % 100 == 0, k=4, shard_rows=100).collect()
    assert seen["vectors"].count() == 2004
    v = [(i, np.floor(np.array(x) * 1024).astype(np.int64)) for i, x in rows]
    want = []
    for q, x in v:
        if q % 100 == 0:
            best = sorted((-int(x @ y), i) for i, y in v if i != q)[:4]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(want)
    sizes = [len(topk_search._unpack(bytes(r.tree))["ids"]) for r in seen["trees"].collect()]
    assert max(sizes) < 5 * sum(sizes) / len(sizes)


def test_pipeline_keeps_one_of_many(spark, sf, tmp_path):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit(text)).otherwise(F.concat_ws(" ", *[F.xxhash64("id", F.lit(i)).cast("string") for i in range(20)])).alias("text"))
    docs.write.parquet(f"{tmp_path}/docs")
    out = corpus_pipeline.near_duplicates(spark, spark.read.parquet(f"{tmp_path}/docs"), sf)
    assert Counter(r.doc_id for r in out.collect()) == Counter({-1: 1, **{i: 1 for i in range(3000) if i % 3}})
    assert out.columns == ["doc_id", "text"]
    plan = out._jdf.queryExecution().optimizedPlan().toString() + out._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and "WindowGroupLimit" in plan
