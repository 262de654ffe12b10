"""Rules with known results, and what the queries' tables don't hold: broken input, sequences, files."""

import json
from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from tidewell.functions import query_text as Q
from tidewell.functions import text as T
from tidewell.operators import chunks as C
from tidewell.operators import corpus as K
from tidewell.operators import insight as I
from tidewell.operators import retrieval as R
from tidewell.sources import files as S
from tidewell.streaming.streams import accept_calls


def sales(spark, rows):
    return spark.createDataFrame([(date.fromisoformat(d), Decimal(a), n, m) for d, a, n, m in rows], "date date, amount decimal(18,2), cnt int, dimension map<string,string>")


def test_sales_totals(spark):
    s = sales(spark, [("2026-01-01", "100000", 10, {"store": "a"}), ("2026-01-02", "200000", 20, {"store": "b"})])
    r = I.sales_summary(s).first()
    assert (r.total, r.days, r.count_total, r.best_day) == (300000.0, 2, 30, date(2026, 1, 2))
    assert {x.value: round(x.share, 4) for x in I.dimension_stats(s).collect()} == {"a": 0.3333, "b": 0.6667}


def test_growth(spark):
    s = sales(spark, [("2026-01-01", "150000", 1, {}), ("2025-12-01", "100000", 1, {})])
    assert I.compare_periods(s, ("2026-01-01", "2026-01-31"), ("2025-12-01", "2025-12-31")).first().growth == 0.5
    assert I.compare_periods(s, ("2026-01-01", "2026-01-31"), ("2024-12-01", "2024-12-31")).first().growth is None


def test_spike(spark):
    s = sales(spark, [(f"2026-01-{d:02d}", "2000000" if d == 15 else "100000", 1, {}) for d in range(1, 16)])
    assert [(r.date.day, r.direction) for r in I.anomalies(I.daily_sales(s)).collect()] == [(15, "spike")]
    assert I.anomalies(I.daily_sales(s.filter("amount < 200000"))).count() == 0


def test_empty_period_is_an_error(spark):
    import pytest

    with pytest.raises(ValueError):
        I.some_rows(I.in_period(sales(spark, [("2026-01-01", "1", 1, {})]), "2027-01-01", "2027-01-31"))


def test_amounts(spark):
    df = spark.createDataFrame([(16050000.0, 0.5), (3600000.0, -0.122), (320000000.0, None), (9500.0, 0.0), (-20000.0, 12.0)], "v double, r double")
    rows = df.select(T.format_amount("v").alias("a"), T.format_pct("r").alias("p")).collect()
    assert [r.a for r in rows] == ["1,605만 원", "360만 원", "3.2억 원", "9,500원", "-2만 원"]
    assert [r.p for r in rows] == ["+50.0%", "-12.2%", None, "+0.0%", "+1,200.0%"]


def test_voc(spark):
    rows = [(date(2026, 1, 1), 5, "a")] * 10 + [(date(2026, 1, 1), 1, "b"), (date(2026, 1, 1), 2, "c")]
    r = I.rating_stats(spark.createDataFrame(rows, "date date, rating int, category string")).first()
    assert (r.negative, r.n5, round(r.negative_ratio, 6)) == (2, 10, round(2 / 12, 6))


def test_periods(spark):
    asked = ["최근 7일", "지난 2주간", "1개월 내", "한 달 동안", "두 달", "세 달", "그냥"]
    df = spark.createDataFrame(list(enumerate(asked)), "i int, q string")
    assert [r.d for r in df.orderBy("i").select(Q.explicit_days("q").alias("d")).collect()] == [7, 14, 30, 30, 60, 90, None]


def test_keywords(spark):
    df = spark.createDataFrame([("WMPO-10564 관련 정산시스템에서 오류가 발생", "x"), ("", "y"), (None, "z")], "q string, i string")
    got = {r.i: r.k for r in df.select("i", Q.extract_keywords("q").alias("k")).collect()}
    assert got["x"][:2] == ["WMPO-10564", "정산시스템"] and got["y"] == [] and got["z"] == []


def test_ladder(spark):
    rows = [(1, "c1", "issue", "2026-03-20", None), (1, "c2", "issue", "2026-02-20", None), (1, "c3", "issue", "2026-01-30", None), (1, "c4", "issue", "2025-12-20", None), (2, "d1", "issue", "2026-03-23", 7), (2, "d2", "issue", "2026-03-10", 7)]
    df = spark.createDataFrame(rows, "query_id int, chunk_id string, source string, created_at string, days int")
    got = R.recency_ladder(df, "2026-03-25 00:00:00")
    assert sorted((r.query_id, r.chunk_id, r.window) for r in got.collect()) == [(1, "c1", 60), (1, "c2", 60), (1, "c3", 60), (2, "d1", 7)]


def test_recency_is_neutral_without_date(spark):
    df = spark.createDataFrame([("2026-03-20",), ("2020-01-01",), (None,), ("junk",)], "c string")
    a, b, c, d = (r.s for r in df.select(R.recency_score(F.try_to_timestamp("c"), "2026-03-25 00:00:00", F.lit(30.0)).alias("s")).collect())
    assert 1 > a > b > 0 and c == d == 0.5


def test_chunks(spark):
    text = lambda n: " ".join(f"w{i}" for i in range(n))
    df = spark.createDataFrame([("a", text(5)), ("b", text(150)), ("c", ""), ("d", None), ("e", text(120))], "id string, content string")
    n = {r.doc_id: r.n for r in C.chunk_words(df, 100, 50).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert n == {"a": 1, "b": 3, "e": 3}
    assert C.chunk_words(df, 20, 5).filter(F.size(F.split("text", " ")) > 20).count() == 0
    assert {r.doc_id: r.n for r in C.chunk_tokens(df, 100, 50).groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {"a": 1, "b": 2, "e": 2}


def test_rich_text(spark):
    tree = json.dumps({"type": "doc", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}, {"type": "paragraph"}]})
    deep = {"type": "text", "text": "x"}
    for _ in range(200):
        deep = {"type": "p", "content": [deep]}
    rows = [(tree,), ('{"type": "other"}',), ("junk",), (None,), (json.dumps({"type": "doc", "content": [deep]}),)]
    got = spark.createDataFrame(rows, "j string").select(T.adf_text_spaces("j").alias("s"), T.adf_text_lines("j").alias("l")).collect()
    assert [r.s for r in got] == ["a b", '{"type": "other"}', "junk", None, "x"]
    assert [r.l for r in got] == ["a\nb", "", "", "", "x"]


def test_sql_fences_strict(spark):
    df = spark.createDataFrame([("a\n```\nSELECT 1\n```\nb\n```\nplain\n```",)], "text string")
    loose, strict = T.strip_sql_fences(df).first(), T.strip_sql_fences(df, strict=True).first()
    assert loose.n_removed == 0 and "SELECT" in loose.text
    assert strict.n_removed == 1 and "SELECT" not in strict.text and "plain" in strict.text


def test_reply_images(spark):
    df = spark.createDataFrame([('<p>a<img src="https://example.org/i.png"/>b<img src="x">c</p>',)], "h string")
    import hashlib

    got = df.select(T.reply_html_to_text("h").alias("t")).first().t
    assert hashlib.md5(b"https://example.org/i.png").hexdigest() in got and got.startswith("a") and "bc" in got.replace(" ", "")


def test_source_hash_ignores_order(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "2"), ("b", "1"), ("c", "")], "g string, content_hash string")
    got = {r.g: r.source_hash for r in K.source_hash(df, "g").collect()}
    assert got["a"] == got["b"] != got["c"]


def test_conflict_folds_blanks(spark):
    rows = [(1, "open hours", "9", "approved"), (2, "Open  Hours", "10", "approved"), (3, "openhours", "10", "disabled"), (4, "", "1", "draft")]
    df = spark.createDataFrame(rows, "page_id int, fact_key string, fact_value string, status string")
    assert {r.n_values for r in K.fact_conflicts(df).collect()} == {2}
    assert K.fact_conflicts(df.filter("page_id <> 1")).count() == 0


def test_limiter():
    ok, kept = accept_calls([0, 1, 2, 60, 61.5, 61.6], [], 2)
    assert ok == [True, True, False, False, True, True] and len(kept) == 2
    assert accept_calls([0, 0, 0], [], 0)[0] == [True] * 3


def test_references_fall_back(spark):
    rows = [(1, i, False, 0.9, f"u{i}", None, "page") for i in range(5)]
    df = spark.createDataFrame(rows, "query_id int, pos int, priority boolean, distance double, url string, issue_key string, source string")
    assert [r.pos for r in R.build_references(df).orderBy("ref").collect()] == [0, 1, 2]
    first = df.withColumn("priority", F.col("pos") == 4)
    assert [r.pos for r in R.build_references(first).collect()] == [4]


def test_read_documents(spark, tmp_path):
    lines = ['{"id": "a", "content": "x", "metadata": {"k": "v"}}', "", "{broken", '{"id": "b"}', '{"content": "y"}']
    (tmp_path / "d.jsonl").write_text("\n".join(lines))
    docs, rejects = S.read_documents(spark, str(tmp_path / "d.jsonl"))
    docs.cache().count()
    assert [r.id for r in docs.collect()] == ["a"]
    assert S.read_issue_docs(spark, str(tmp_path / "d.jsonl")).filter("id = 'a'").count() == 1
    assert rejects.select("reason").count() == 3


def test_markdown_tree(spark, tmp_path):
    (tmp_path / "x/y").mkdir(parents=True)
    (tmp_path / "x/y/a.md").write_text("# Title\n" + "word " * 30)
    (tmp_path / "x/README.md").write_text("# No\n" + "word " * 30)
    (tmp_path / "x/short.md").write_text("short")
    got = S.read_markdown_tree(spark, str(tmp_path)).collect()
    assert [(r.rel_path, r.title, r.category) for r in got] == [("x/y/a.md", "Title", "x/y")]


def test_upsert_table(spark, tmp_path):
    schema = "chunk_id string, source string, content_hash string, meta map<string,string>"
    path = str(tmp_path / "t")
    S.upsert_chunks(spark, path, spark.createDataFrame([("1", "a", "h1", {}), ("2", "a", "h2", {}), ("3", "b", "h3", {})], schema))
    new = spark.createDataFrame([("1", "a", "h1", {}), ("2", "a", "new", {}), ("4", "c", "h4", {})], schema)
    done = {r.chunk_id: r.action for r in S.upsert_chunks(spark, path, new).collect()}
    assert done == {"1": "skipped", "2": "updated", "4": "new"}
    assert sorted((r.chunk_id, r.content_hash) for r in S.read_chunks(spark, path).collect()) == [("1", "h1"), ("2", "new"), ("3", "h3"), ("4", "h4")]
    S.rebuild_collection(spark, path)
    assert S.read_chunks(spark, path).count() == 4


def test_table_function(spark):
    from tidewell.functions.udtf import register

    register(spark)
    assert [r.text for r in spark.sql("SELECT * FROM chunk('a b c d', 2, 1)").collect()] == ["a b", "b c", "c d", "d"]


def test_upsert_moves_chunks_between_sources(spark, tmp_path):
    """A chunk that comes with another source stands there once, and a source that lost its last chunk is gone."""
    row = lambda *rows: spark.createDataFrame([(c, s, h, {"k": "v"}) for c, s, h in rows], "chunk_id string, source string, content_hash string, meta map<string,string>")
    table = str(tmp_path / "table")
    S.upsert_chunks(spark, table, row(("1", "a b", "x"), ("2", "b", "x"), ("3", "b", "x")))
    S.upsert_chunks(spark, table, row(("1", "b", "y"), ("3", "c", "x2"), ("4", "d", "z"), ("2", "b", "x")))
    got = sorted((r.chunk_id, r.source, r.content_hash) for r in S.read_chunks(spark, table).collect())
    assert got == [("1", "b", "y"), ("2", "b", "x"), ("3", "c", "x2"), ("4", "d", "z")]


def test_chunks_keep_columns(spark):
    df = spark.createDataFrame([("a", "x y z", "s"), ("a", "x", "t")], "id string, content string, source string")
    got = sorted((r.doc_id, r.chunk_ix, r.text, r.source) for r in C.chunk_words(df, 2, 1, keep=["source"]).collect())
    assert got == [("a", 0, "x", "t"), ("a", 0, "x y", "s"), ("a", 1, "y z", "s"), ("a", 2, "z", "s")]
