"""Groups that don't fit into one row or one batch."""

from tidewell.operators import corpus as K
from tidewell.plans import QUERIES
from tidewell.streaming import streams as S


def test_clients_are_users(spark, sf):
    users = {r.user_id for r in spark.read.parquet(f"{sf}/events.parquet").select("user_id").collect()}
    assert {r.client_id for r in QUERIES["l05_rate_limit"](spark, sf).collect()} == users


def test_limit_goes_on_over_batches(spark):
    calls = [(c, i, i * (7 + c)) for c in range(3) for i in range(40)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = spark.createDataFrame(calls, "client_id long, id long, s long").selectExpr("client_id", "id", "timestamp_seconds(s) AS created_at")
        got = S.rate_limit(df, 2)
        assert "MapInPandas" in got._jdf.queryExecution().toString()
        got = {(r.client_id, r.id): r.accepted for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for c in range(3):
        want = S.accept_calls([float(s) for k, _, s in calls if k == c], [], 2)[0]
        assert [got[c, i] for i in range(40)] == want


def test_hash_in_parts(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "2"), ("a", "2"), ("b", "2"), ("b", "1"), ("b", "2"), ("c", ""), ("d", "1"), ("d", "2"), ("e", "")], "g string, content_hash string")
    got = {r.g: r.source_hash for r in K.source_hash_parts(df, "g").collect()}
    assert got["a"] == got["b"] and got["c"] == got["e"] and len({got["a"], got["c"], got["d"]}) == 3
