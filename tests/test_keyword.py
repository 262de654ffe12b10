"""Keyword search and the index that is kept, against a plain version."""

import collections
import math
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tidewell.operators import keyword as W
from tidewell.sources import versions as V

TEXTS = {
    "c0": "See WMPO-10564 and WMPO-105 for user.name, please", "c1": "wmpo 10564 is not wmpo 20564", "c2": "10564 wmpo", "c3": "Café de la Gare; CAFE au lait", "c4": "the the the end", "c5": "the end of the endless", "c6": "", "c7": None,
    "c8": "user names and user name", "c9": "über uber", "d0": "alpha beta beta", "d1": "alphabet a", "d2": "be", "d3": "al be", "d4": "beta",
}
ASKS = [(1, ["WMPO-10564"]), (2, ["user.name", "the end"]), (3, ["cafe", "gare;"]), (4, ["the the"]), (5, ["ÜB"]), (6, ["", "-", None]), (7, []), (8, None), (9, ["the-end", "The End"]), (10, ["Alpha", "be", "a"]), (11, ["zzz"]), (12, ["the", "end", "wmpo", "u", "b", "al"])]


def terms(text):
    low = "".join(c for c in unicodedata.normalize("NFD", (text or "").lower()) if not unicodedata.combining(c))
    return re.findall(r"[^\W_]+", low)


def plain(texts, asks, n):
    docs = {c: terms(t) for c, t in texts.items() if terms(t)}
    mean, out = sum(map(len, docs.values())) / len(docs), []
    for query, keywords in asks:
        score = collections.Counter()
        for phrase in {tuple(terms(k)) for k in keywords or []} - {()}:
            m, tf = len(phrase), {}
            for c, t in docs.items():
                tf[c] = sum(tuple(t[i : i + m - 1]) == phrase[:-1] and t[i + m - 1].startswith(phrase[-1]) for i in range(len(t) - m + 1))
            df = sum(f > 0 for f in tf.values())
            idf = max(math.log((len(docs) - df + 0.5) / (df + 0.5)), 1e-6)
            for c, f in tf.items():
                if f:
                    score[c] += idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(docs[c]) / mean))
        best = sorted(((-round(s, 9), c) for c, s in score.items()))[:n]
        out += [(query, c, -s, rank) for rank, (s, c) in enumerate(best)]
    return out


def found(index, spark, n=10):
    asks = spark.createDataFrame(ASKS, "query_id long, keywords array<string>")
    return sorted((r.query_id, r.chunk_id, round(r.score, 8), r["rank"]) for r in W.bm25_search(asks, index, n).collect())


def wanted(texts, n=10):
    return sorted((q, c, round(s, 8), r) for q, c, s, r in plain(texts, ASKS, n))


def frame(spark, texts):
    return spark.createDataFrame(list(texts.items()), "chunk_id string, text string")


@pytest.mark.parametrize("n", [1, 2, 10])
def test_phrases_with_a_prefix(spark, n, monkeypatch):
    index = W.index_of(frame(spark, TEXTS))
    assert found(index, spark, n) == wanted(TEXTS, n)
    assert [c for q, c, *_ in wanted(TEXTS) if q == 1] == ["c0", "c1"] and {c for q, c, *_ in wanted(TEXTS) if q == 2} >= {"c0", "c8", "c4", "c5"}
    monkeypatch.setattr(W, "is_small", lambda *_: False)
    assert found(index, spark, n) == wanted(TEXTS, n)


def test_no_chunks(spark):
    assert found(W.index_of(frame(spark, {"x": None})), spark) == []


def test_kept_index(spark, tmp_path):
    root = f"file://{tmp_path}/index"
    old = {**TEXTS, "c1": "old words", "gone": "the end of user name", "d0": "beta"}
    W.build_index(spark, root, frame(spark, old))
    before = W.open_index(spark, root)
    assert found(before, spark) == wanted(old)
    first = V.latest(spark, root)
    changed = frame(spark, {"c1": TEXTS["c1"], "d0": TEXTS["d0"], "c2": ""})
    new = W.upsert_index(spark, root, changed, gone=frame(spark, {"gone": ""}))
    now = {k: t for k, t in TEXTS.items() if k != "c2"}
    assert found(W.open_index(spark, root), spark) == wanted(now)
    # who opened the index before still reads it as it was; nothing that was there is written again
    assert found(before, spark) == wanted(old) and found(W.open_index(spark, root, first.number), spark) == wanted(old)
    for b, folders in first.tables["postings"][1].items():
        assert new.tables["postings"][1][b][: len(folders)] == folders
    same = [b for b, f in first.tables["docs"][1].items() if new.tables["docs"][1].get(b) == f]
    assert len(same) >= len(first.tables["docs"][1]) - 4
    W.compact_index(spark, root)
    index = W.open_index(spark, root)
    assert found(index, spark) == wanted(now)
    assert index.postings.count() == W.live_postings(index).count() == W.places_of(frame(spark, now)).count()


def test_postings_stay_with_their_chunk(spark, tmp_path):
    texts = {f"c{i:02d}": f"w{i} w{i + 1} the end of v{i % 7}" for i in range(60)}
    W.build_index(spark, f"{tmp_path}/i", frame(spark, texts).repartition(3))
    postings = W.open_index(spark, f"{tmp_path}/i").postings.withColumn("file", F.input_file_name())
    assert postings.select("file").distinct().count() == 3
    assert postings.groupBy("chunk_id").agg(F.count_distinct("file").alias("n")).filter("n > 1").isEmpty()


def test_a_load_that_holds_an_id_twice(spark, tmp_path):
    twice = spark.createDataFrame([("a", "one two"), ("a", "three"), ("b", "one")], "chunk_id string, text string")
    W.build_index(spark, f"{tmp_path}/i", twice)
    assert W.open_index(spark, f"{tmp_path}/i").docs.count() == 2
    W.upsert_index(spark, f"{tmp_path}/i", twice)
    index = W.open_index(spark, f"{tmp_path}/i")
    assert index.docs.count() == 2 and W.live_postings(index).select("chunk_id").distinct().count() == 2


def test_two_loads_at_once(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    one = V.write(root, frame(spark, {"a": "x"}), V.bucket_of("chunk_id", 4))
    base = V.commit(spark, root, None, {"t": one})
    V.commit(spark, root, base, {"t": one})
    with pytest.raises(V.Conflict):
        V.commit(spark, root, base, {"t": one})
    assert V.latest(spark, root).number == 1


def test_vacuum_leaves_what_is_read(spark, tmp_path):
    root = f"file://{tmp_path}/v"
    W.build_index(spark, root, frame(spark, TEXTS))
    W.upsert_index(spark, root, frame(spark, {"c0": "the end"}))
    W.compact_index(spark, root)
    V.write(root, frame(spark, {"a": "stopped load"}), V.bucket_of("chunk_id", 4))
    want = found(W.open_index(spark, root), spark)
    assert V.vacuum(spark, root, keep=1) > 0 and found(W.open_index(spark, root), spark) == want
    assert V.latest(spark, root, 0) is None and V.vacuum(spark, root, keep=1) == 0


def test_prefixes_are_joined_by_their_length(spark):
    terms = spark.createDataFrame([("a",), ("abc",), ("abcd",), ("b",)], "term string")
    prefixes = spark.createDataFrame([("a",), ("abc",), ("bc",)], "prefix string")
    got = W._expanded(terms, prefixes)
    assert sorted(map(tuple, got.collect())) == [("a", "a"), ("abc", "a"), ("abc", "abc"), ("abcd", "a"), ("abcd", "abc")]
    assert "startswith" not in got._jdf.queryExecution().optimizedPlan().toString().lower()
    assert W._expanded(terms, prefixes.limit(0)).count() == 0


def test_distinct_chunks_are_indexed_without_dealing_texts_out(spark):
    once, twice = frame(spark, {"x": "a b", "y": "b"}), spark.createDataFrame([("x", "a b"), ("x", "c")], "chunk_id string, text string")
    assert "Window" not in W.index_of(once).docs._jdf.queryExecution().optimizedPlan().toString()
    assert W.index_of(twice).docs.count() == 1


def test_scores_of_many_queries_with_shared_keywords(spark):
    rng = __import__("random").Random(8)
    texts = {f"k{i:03d}": " ".join(rng.choice(["aa", "ab", "b", "cc", "cd", "d"]) for _ in range(rng.randrange(1, 7))) for i in range(200)}
    asks = [(q, rng.sample(["a", "b", "c", "aa", "cd d", "ab b"], rng.randrange(1, 5))) for q in range(12)]
    got = W.bm25_search(spark.createDataFrame(asks, "query_id long, keywords array<string>"), W.index_of(frame(spark, texts)), 5).collect()
    assert sorted((r.query_id, r.chunk_id, round(r.score, 8), r["rank"]) for r in got) == sorted((q, c, round(s, 8), r) for q, c, s, r in plain(texts, asks, 5))
