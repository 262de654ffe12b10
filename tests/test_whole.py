"""Queries read whole tables: what a cut would leave out has to arrive."""

from tidewell.plans import QUERIES


def test_fusion_asks_all_documents(spark, sf):
    number = [int(r.chunk_id[1:]) for r in QUERIES["i05_rrf"](spark, sf).collect()]
    assert len(set(number)) > 40 and max(number) >= 40


def test_searches_ask_by_divisible_id(spark, sf):
    ids = {r.vec_id for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id").collect()}
    asked = {r.query_id for r in QUERIES["i01_vector_top_n"](spark, sf).collect()}
    assert asked == {i for i in ids if i % 20 == 0} and max(asked) >= 20


def test_all_lines_are_links_and_models(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    pairs = lines.selectExpr("l_orderkey AS no").union(lines.selectExpr("l_partkey * 10")).distinct()
    assert QUERIES["h01_union_distinct"](spark, sf).count() == pairs.count()
    assert QUERIES["e24_ab_summary"](spark, sf).count() == lines.select("l_linenumber").distinct().count()
