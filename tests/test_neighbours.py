"""Neighbours over links in both directions."""

from tidewell.operators import graph as G
from tidewell.plans import QUERIES, record_queries
from tidewell.plans.registry import Views

EDGES = "src string, dst string, rel string, meta string"
LINKS = [("a", "b", "LINKS_TO", "1"), ("b", "a", "LINKS_TO", "2"), ("a", "b", "LINKS_TO", "1"), ("c", "c", "LINKS_TO", "3"), ("d", "a", "LINKS_TO", "4"), (None, "a", "LINKS_TO", "5"), ("a", None, "LINKS_TO", "6"), ("a", "x", "HAS_LABEL", "7"), ("a", "gone", "LINKS_TO", "8")]


def test_neighbours_are_a_set_in_both_directions(spark):
    edges = spark.createDataFrame(LINKS, EDGES)
    nodes = spark.createDataFrame([(i, "issue", i.upper(), "{}") for i in "abcdx"], "id string, type string, label string, meta string")
    keys = spark.createDataFrame([("a",), ("a",), ("c",), (None,), ("d",)], "key string")
    got = G.neighbours(edges, nodes, keys).select("key", "id", "label", "meta")
    assert sorted(map(tuple, got.collect())) == [("a", "b", "B", "1"), ("a", "b", "B", "2"), ("a", "d", "D", "4"), ("c", "c", "C", "3"), ("d", "a", "A", "4")]
    once = G.neighbours(edges, nodes, keys, meta=False).select("key", "id", "label")
    assert sorted(map(tuple, once.collect())) == [("a", "b", "B"), ("a", "d", "D"), ("c", "c", "C"), ("d", "a", "A")]


def test_links_of_neighbours_are_those_of_the_whole_graph(spark, sf):
    v = Views(spark, sf)
    (nodes, edges), (issues, links) = record_queries.graph(v), record_queries.linked(v)
    both = lambda a, b: a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    assert both(links.select("src", "dst").distinct(), edges.filter("rel = 'LINKS_TO'").select("src", "dst").distinct())
    assert both(issues.select("id", "type", "label"), nodes.filter("type = 'issue'").select("id", "type", "label"))


def test_neighbours_make_no_arrays_and_no_meta(spark, sf):
    for name in ("d07_neighbours", "j04_linked_issues"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "collect_list" not in plan and "StructsToJson" not in plan and "to_json" not in plan, name
