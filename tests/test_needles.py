"""Many names in texts against `in`."""

import random

from pyspark.sql import functions as F

from tidewell.operators import graph as G
from tidewell.operators import needles as N
from tidewell.operators import retrieval as R


def test_fifty_thousand_names_in_several_passes(spark):
    rng = random.Random(3)
    word = lambda k: "".join(rng.choice("abcde ") for _ in range(k))
    names = [(i, word(rng.randint(4, 9))) for i in range(50_000)] + [(-1, ""), (-2, None), (-3, "é漢\U0001f600"), (-4, "é漢\U0001f600"), (-5, "aa")]
    texts = [(i, word(400)) for i in range(60)] + [(-1, None), (-2, ""), (-3, "x é漢\U0001f600 é漢\U0001f600"), (-4, "aaaa")]
    t, n = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(names, "name long, alias string")
    want = {(i, k) for i, text in texts for k, alias in names if text and alias and alias in text}
    for most in (N.NAMES, 20_000):
        got = [(r.id, r.name) for r in N.contains_join(t, n, "text", "alias", most).collect()]
        assert len(got) == len(want) and set(got) == want
    assert N.contains_join(t, n.limit(0), "text", "alias").count() == N.contains_join(t.limit(0), n, "text", "alias").count() == 0


def test_texts_are_not_handed_on(spark):
    t, n = spark.createDataFrame([("a", "one two")], "id string, text string"), spark.createDataFrame([("two",)], "alias string")
    assert N.contains_join(t, n, "text", "alias").columns == ["id", "alias"]


def test_first_rows_of_each_name(spark):
    rng = random.Random(5)
    texts = [(f"t{rng.randrange(300)}", " ".join(rng.choice("abcdef") for _ in range(4))) for _ in range(600)]
    t = spark.createDataFrame(texts, "id string, text string").repartition(5)
    n = spark.createDataFrame([(c,) for c in "abcxyz"], "alias string")
    got = sorted((r.id, r.alias) for r in N.contains_join(t, n, "text", "alias", first=("id", 4)).collect())
    want = []
    for c in "abcxyz":
        ids = sorted(i for i, text in texts if c in text)
        want += [(i, c) for i in ids if i in ids[:4]]
    assert got == sorted(want)


def test_substring_search_by_all_pairs(spark):
    rng = random.Random(6)
    texts = [(f"d{i}", " ".join(rng.choice(["red", "blue", "green", "old"]) for _ in range(3))) for i in range(400)]
    asks = [(1, ["blue", "red"]), (2, ["old", "old"]), (3, ["none", "green"]), (4, ["", "een o"])]
    t, q = spark.createDataFrame(texts, "chunk_id string, text string"), spark.createDataFrame(asks, "query_id long, keywords array<string>")
    want = set()
    for i, keys in asks:
        hits = sorted((min(k for k, x in enumerate(keys) if x and x in text), c) for c, text in texts if any(x and x in text for x in keys))
        want |= {(i, c, rank) for rank, (_, c) in enumerate(hits[:10])}
    assert {(r.query_id, r.chunk_id, r["rank"]) for r in R.substring_search(q, t.repartition(3), 10).collect()} == want


def test_mentions_of_a_frequent_alias_meet_in_parts(spark, monkeypatch):
    monkeypatch.setattr(G, "PART", (3, 4))
    nodes = spark.createDataFrame([(f"d{i}", "doc", "Red Blue" if i % 2 else "blue") for i in range(30)] + [("d1", "doc", "red")], "id string, type string, label string")
    names = [(f"n{i}", "BLUE" if i % 3 else "red") for i in range(20)] + [("n1", "red"), ("n2", "blue")]
    got = [(r.src, r.dst) for r in G.link_mentions(nodes, spark.createDataFrame(names, "name string, alias string")).collect()]
    want = {(d, f"entity:{n}") for d, _, label in map(tuple, nodes.collect()) for n, a in names if a.lower() in label.lower()}
    assert len(got) == len(want) and set(got) == want


def test_pairs_are_made_in_as_many_tasks_as_they_ask_for(spark, monkeypatch):
    monkeypatch.setattr(G, "PART", (5, 10))
    monkeypatch.setattr(G, "PAIRS", 200, raising=False)
    nodes = spark.createDataFrame([(f"d{i}", "doc", "so red") for i in range(100)], "id string, type string, label string")
    pairs = G.link_mentions(nodes, spark.createDataFrame([(f"n{i}", "red") for i in range(60)], "name string, alias string"))
    made = [r.n for r in pairs.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(made) == pairs.distinct().count() == 6000 and max(made) < 1500
