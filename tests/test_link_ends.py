"""Ends of links, each once."""

from tidewell.plans import QUERIES


def test_ends_of_links_need_no_distinct_links(spark, tmp_path):
    rows = [(1, 7, "R"), (1, 7, "R"), (1, 7, "N"), (70, 1, "A"), (10, 3, "R")]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    ends = QUERIES["h01_union_distinct"](spark, str(tmp_path))
    assert sorted(r.no for r in ends.collect()) == [1, 10, 30, 70]
    assert "l_returnflag" not in ends._jdf.queryExecution().executedPlan().toString()
