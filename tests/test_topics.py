"""Topic candidates against a union-find over all pairs."""

import random

from tidewell.operators import corpus as K


def by_pairs(rows, similarity):
    head = {i: i for i, _ in rows}

    def top(i):
        while head[i] != i:
            i = head[i]
        return i

    words = {i: set(q.split()) for i, q in rows}
    for i in words:
        for j in words:
            if i < j and len(words[i] & words[j]) >= similarity * len(words[i] | words[j]) - 1e-9:
                a, b = sorted((top(i), top(j)))
                head[b] = a
    sizes = {}
    for i in words:
        sizes[top(i)] = sizes.get(top(i), 0) + 1
    return sorted(((n, t) for t, n in sizes.items() if n >= 2), key=lambda x: (-x[0], x[1]))


def found(spark, rows):
    got = K.topic_candidates(spark.createDataFrame(rows, "query_id long, q string"), most=10_000).collect()
    return sorted(((r["size"], r.topic_id) for r in got), key=lambda x: (-x[0], x[1])), got


def test_a_chain_is_one_topic(spark):
    rows = [(1, "a b c"), (2, "b c d"), (3, "c d e"), (4, "d e f"), (5, "x y z"), (6, "q")]
    sizes, got = found(spark, rows)
    assert sizes == by_pairs(rows, 0.4) == [(4, 1)]
    assert got[0].samples == ["a b c", "b c d", "c d e", "d e f"]


def test_topics_are_those_of_all_pairs(spark):
    r = random.Random(3)
    rows = [(i, " ".join(["hot"] * (i % 3 == 0) + [f"w{r.randrange(90)}" for _ in range(r.randrange(1, 7))])) for i in range(240)]
    assert found(spark, rows)[0] == by_pairs(rows, 0.4)
