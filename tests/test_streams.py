"""Ingestion and upserts, whole and twice."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from tidewell.sources import files, versions
from tidewell.streaming import streams as S


def test_ingest_keeps_all_chunks(spark, sf):
    from tidewell.plans import stream_queries
    from tidewell.plans.registry import Views

    table = stream_queries._ingested(Views(spark, sf))
    words = spark.read.parquet(f"{sf}/documents.parquet").agg(F.max(F.size(F.split(F.trim("text"), r"[ \t\r\n]+")))).first()[0]
    assert table.agg(F.max("chunk_ix")).first()[0] == -(-words // 80) - 1
    assert table.count() == table.select("chunk_id").distinct().count()


CHUNK = "chunk_id string, content_hash string, meta map<string,string>, text string"


def test_upsert_may_run_twice_and_hold_an_id_twice(spark, tmp_path):
    root = str(tmp_path / "t")
    new = spark.createDataFrame([("1", "h", {}, "a"), ("2", "h", {}, "b"), ("1", "h2", {}, "c"), ("1", "h3", {}, "d"), (None, "h", {}, "e")], CHUNK)
    for n in range(2):
        actions = files.upsert_chunks(spark, root, new)
        assert {(r.chunk_id, r.action) for r in actions.collect()} >= {("1", "skipped" if n else "new"), ("2", "skipped" if n else "new")}
    got = sorted((r.chunk_id, r.text) for r in files.read_chunks(spark, root).collect())
    assert got == [("1", "d"), ("2", "b")]


def test_who_reads_and_a_load_that_stops_keep_the_old_version(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    files.upsert_chunks(spark, root, spark.createDataFrame([(str(i), "h", {}, "old") for i in range(50)], CHUNK))
    before = files.read_chunks(spark, root)
    load = spark.createDataFrame([(str(i), "h2", {}, "new") for i in range(40, 60)], CHUNK)

    def stop(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as m:
        m.setattr(files, "commit", stop)
        with pytest.raises(RuntimeError, match="stopped"):
            files.upsert_chunks(spark, root, load)
    assert files.read_chunks(spark, root).filter("text = 'old'").count() == 50
    files.upsert_chunks(spark, root, load)
    assert before.count() == before.filter("text = 'old'").count() == 50
    now = files.read_chunks(spark, root)
    assert now.count() == 60 and now.filter("text = 'new'").count() == 20
    number = files.rebuild_collection(spark, root)
    assert sorted(map(str, files.read_chunks(spark, root).collect())) == sorted(map(str, now.collect()))
    assert files.read_chunks(spark, root, number - 2).filter("text = 'old'").count() == 50
    versions.vacuum(spark, root, keep=1)
    assert files.read_chunks(spark, root).count() == 60


def test_newest_reply_stays_under_the_first_document(spark, tmp_path):
    from tidewell.streaming.streams import reply_state

    schema = "question string, doc_id long, reply string, created_at long"
    batches = [[("a", 1, "x", 10), ("a", 2, "y", 20), ("b", 9, "z", 5)], [("a", 3, "late", 15), ("b", 8, "w", 6)]]
    got = []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/n={i}"))
        src = spark.readStream.schema(schema).parquet(str(tmp_path / "in/*"))
        put = lambda b, n: got.extend(tuple(r) for r in b.collect())
        reply_state(src).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(got) == [("a", 1, "y", 20), ("b", 9, "w", 6), ("b", 9, "z", 5)]


def feed(spark, tmp_path, schema, rows, start):
    """Adds a file of rows and runs the query until it has read it; returns the query."""
    n = len(list((tmp_path / "in").glob("n=*"))) if (tmp_path / "in").exists() else 0
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/n={n}"))
    q = start(spark.readStream.schema(schema).parquet(str(tmp_path / "in/*"))).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def state_rows(q):
    return next(p["stateOperators"][0]["numRowsTotal"] for p in reversed(q.recentProgress) if p["stateOperators"])


def test_limiter_over_batches_forgets_idle_clients(spark, tmp_path):
    schema, out = "client_id long, id long, created_at timestamp", []
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    batches = [[(c, 10 * c + i, at(20 * i)) for c in (1, 2, 3) for i in range(5)], [(1, 100 + i, at(85 + 15 * i)) for i in range(6)], [(9, 900, at(9000))], [(2, 800, at(9001))]]
    start = lambda s: S.rate_limit(s, 2).writeStream.foreachBatch(lambda b, n: out.extend(tuple(r) for r in b.collect()))
    sizes = [state_rows(feed(spark, tmp_path, schema, rows, start)) for rows in batches]
    for client in (1, 2, 3, 9):
        calls = sorted((t, i) for rows in batches for c, i, t in rows if c == client)
        ok, _ = S.accept_calls([t.timestamp() for t, _ in calls], [], 2)
        assert [(i, a) for c, i, _, a in sorted(out, key=lambda r: r[2]) if c == client] == [(i, a) for (_, i), a in zip(calls, ok)]
    assert sizes[0] >= 6 and sizes[-1] < sizes[0], sizes
    batch = S.rate_limit(spark.createDataFrame(sum(batches, []), schema), 2).collect()
    assert sorted(map(tuple, batch)) == sorted(out)


@pytest.mark.parametrize("quiet_ms", [S.QUIET_MS, 1000])
def test_turns_and_replies_of_quiet_keys_begin_anew(spark, tmp_path, quiet_ms):
    kept, turns, replies, day = quiet_ms == S.QUIET_MS, [], [], 86_400_000
    t = lambda s: S.turn_counter(s, quiet_ms).writeStream.foreachBatch(lambda b, n: turns.extend(tuple(r) for r in b.collect()))
    r = lambda s: S.reply_state(s, quiet_ms).writeStream.outputMode("update").foreachBatch(lambda b, n: replies.extend(tuple(r) for r in b.collect()))
    for rows in [[("s", 1, 10), ("s", 2, 5)], [("z", 9, 3 * day)], [("s", 3, 4 * day)]]:
        feed(spark, tmp_path / "t", "session_id string, id long, created_at long", [(k, i, 1000 * at) for k, i, at in rows], t)
        feed(spark, tmp_path / "r", "question string, doc_id long, reply string, created_at long", [(k, i, f"r{i}", at) for k, i, at in rows], r)
    assert sorted(turns) == [("s", 1, 1), ("s", 2, 0), ("s", 3, 2 if kept else 0), ("z", 9, 0)]
    assert replies == [("s", 2, "r1", 10), ("z", 9, "r9", 3 * day), ("s", 2 if kept else 3, "r3", 4 * day)]


def test_surges_of_closed_days_over_batches(spark, tmp_path):
    day = lambda d, n: [(dt.datetime(2024, 1, d, 12),)] * n
    told = {}
    for n, days in enumerate([[(1, 5), (2, 5)], [(3, 6), (4, 5)], [(5, 60), (6, 5)], [(7, 1), (8, 5), (9, 4)]]):
        spark.createDataFrame(sum((day(*d) for d in days), []), "ts timestamp").coalesce(1).write.parquet(str(tmp_path / f"in/n={n}"))
        S.surge_stream(spark.readStream.schema("ts timestamp").parquet(str(tmp_path / "in/*")), lambda b, k, n=n: told.setdefault(n, []).extend((r.date.day, r.n) for r in b.collect()), str(tmp_path / "ring"), str(tmp_path / "state"), days=5, z=1.5).awaitTermination()
        rings = [spark.read.parquet(str(p)).count() for p in (tmp_path / "ring").glob("batch=*")]
        assert len(rings) <= 2 and max(rings) <= 5
    assert told == {0: [], 1: [], 2: [(5, 60)], 3: [(5, 60)]} or told == {1: [], 2: [(5, 60)], 3: [(5, 60)]}, told


def test_late_rows_of_more_batches_than_a_query_remembers(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "4")  # a hundred by default
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    for n in range(12):
        rows = [(2 * n, at(7200 + n))] + ([(2 * n + 1, at(0))] if n > 1 else [])
        spark.createDataFrame(rows, "id long, ts timestamp").coalesce(1).write.parquet(str(tmp_path / f"in/n={n:03d}"))
    late = S.LateRows(spark, str(tmp_path / "late"))
    spark.streams.addListener(late)
    source = spark.readStream.schema("id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = S.dedup_stream(source, "id").writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    late.wait(q)
    spark.streams.removeListener(late)
    spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    assert late.rows().agg(F.sum("late")).first()[0] == 10
    assert len(q.recentProgress) <= 4
