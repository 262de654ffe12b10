"""The index of approximate vector search against brute force."""

from tidewell.operators import retrieval as R
from tidewell.operators import vectors as X
from tidewell.plans.registry import Views
from tidewell.plans.search_queries import vectors


def test_recall_of_the_index(spark, sf):
    v = Views(spark, sf)
    of = lambda df: {(r.query_id, r.chunk_id) for r in df.select("query_id", "chunk_id").collect()}
    exact = of(X.vector_top_n(v.query_vectors, vectors(v), 15, "l2"))
    found = of(R.vector_top_n_lsh(v.query_vectors, vectors(v), 15))
    print("recall", len(exact & found) / len(exact))
    assert len(exact & found) >= 0.9 * len(exact)


def test_candidates_are_not_shuffled_as_pairs(spark, sf):
    v = Views(spark, sf)
    found = R.vector_top_n_lsh(v.query_vectors, vectors(v), 15)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "datasetA" not in plan
    assert found.groupBy("query_id").count().filter("count > 15").isEmpty() and found.select("query_id", "chunk_id").distinct().count() == found.count()
