"""Spelling variants against a plain version over deletions of letters."""

import collections
import itertools
import re
import zlib

import numpy as np
import pytest

from tidewell.llm import queries as Q
from tidewell.llm import spelling as S


def counted(docs, least_chars=6, least_count=5, every=199):
    n = collections.Counter()
    for key, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= least_chars and c >= least_count}


def neighbours(words):
    """word -> set of words one edit away: words that share a form with a letter left out, checked."""
    by = collections.defaultdict(set)
    for w in words:
        by[w].add(w)
        for i in range(len(w)):
            by[w[:i] + w[i + 1 :]].add(w)

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out = {w: set() for w in words}
    for group in by.values():
        for a, b in itertools.combinations(sorted(group), 2):
            if near(a, b):
                out[a].add(b)
                out[b].add(a)
    return out


def plain(n, times=5):
    near, form = neighbours(n), {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query(spark, sf, monkeypatch):
    monkeypatch.setattr(S, "CELL", 100)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = Q.QUERIES["op11_kd_spelling"](spark, sf).collect()
    want = plain(counted(docs))
    assert len(got) == len(want) and set(map(tuple, got)) == want
    assert got[0].asDict().keys() == {"word", "form", "root", "n", "n_near", "form_n"}


def test_many_alike_words_without_sample(spark, monkeypatch):
    """Words of the same letters, runs of one letter, lengths that the sample lacks, chains of forms."""
    monkeypatch.setattr(S, "CELL", 50)
    monkeypatch.setattr(S, "SAMPLE", 300)
    rng = np.random.default_rng(5)
    words = {"".join(p) for p in itertools.permutations("aabbcd")} | {"a" * i for i in range(1, 9)} | {"x" * 40, "x" * 41, "aaéb", "aaéc", "漢字\U0001f600a", "漢字\U0001f600"}
    n = {w: int(rng.integers(1, 400)) for w in words} | {"a": 9 ** 7, "aa": 9 ** 6, "aaa": 9 ** 5, "aaaa": 9 ** 4, "aaaaa": 9 ** 3}
    df = spark.createDataFrame([*n.items(), (None, 3), ("", 4)], "word string, n int").selectExpr("*", "1 AS cell", "2 AS root")
    got = S.spelling_variants(df).collect()
    assert set(map(tuple, got)) == plain(n) and len(got) == len(n)
    assert {r.root for r in got if r.word == "aaaaa"} == {"a"}


@pytest.mark.parametrize("leaf", [1, 4, 1000])
def test_search_finds_what_all_pairs_find(leaf):
    rng = np.random.default_rng(leaf)
    for a, b in ((5, 5), (5, 6), (1, 1), (1, 2)):
        q, p = (np.unique(rng.integers(97, 100, (150, n)), axis=0).astype(np.uint32) for n in (a, b))
        one, two = S.search(p, q, leaf)
        x, y = np.nonzero(S.one_edit(q, p))
        assert list(zip(one, two)) == list(zip(x, y))


def test_odd_documents(spark, odd_documents, no_documents):
    assert S.spelling_variants(S.counted_words(no_documents)).count() == 0
    docs = [(r.doc_id, r.text) for r in odd_documents.collect()]
    got = S.counted_words(odd_documents, least_chars=2, least_count=1, typo_every=3).collect()
    assert {r.word: r.n for r in got} == counted(docs, 2, 1, 3)
