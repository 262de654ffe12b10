"""Winnowing against a plain version: window by window, in Python."""

import hashlib
import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from tidewell.llm import queries as Q
from tidewell.llm import winnowing as W


def fingerprint(text):
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()) if w] or [text]

    def gram(i):
        h = 42
        for w in words[i : i + W.K]:
            h = xxhash.xxh64_intdigest(w.encode(), seed=h)
        return struct.unpack("<q", struct.pack("<Q", h))[0]

    hashes = [gram(i) for i in range(max(0, len(words) - W.K) + 1)]
    kept = set()
    for at in range(max(0, len(hashes) - W.W) + 1):
        window = range(at, min(at + W.W, len(hashes)))
        kept.add(min(window, key=lambda i: (hashes[i] >> 26, -i)))
    return [(hashes[i], i) for i in sorted(kept)]


def like(a, b):
    x, y = {h for h, _ in a}, {h for h, _ in b}
    return len(x & y) / len(x | y)


def plain(rows):
    """(id, n_chars, edited sha256, fingerprint, edited fingerprint, near_edited, near_next) of (id, text), ids ascending."""
    for i, (key, text) in enumerate(rows):
        after, half = rows[(i + 1) % len(rows)][1], len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b = fingerprint(text), fingerprint(edited)
        yield key, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, like(a, b), like(a, fingerprint(after))


def test_against_plain(spark, sf):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    rows = W.edited_fingerprints(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    got = sorted((r.doc_id, r.n_chars, r.edited_sha256, [tuple(x) for x in r.fingerprint], [tuple(x) for x in r.edited], r.near_edited, r.near_next) for r in rows)
    assert got == list(plain(docs))


def test_query(spark, sf):
    rows = Q.QUERIES["op13_winnowing"](spark, sf).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    of = {}
    for r in rows:
        assert of.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
    assert len(set(of.values())) > 0.95 * len(of)
    # a half of a text of twenty words and more has whole windows
    long = [r for r in rows if len(texts[r.doc_id].split()) > 40]
    assert min(r.near_edited for r in long) > 0.1 and sum(r.near_next for r in long) / len(long) < 0.05


def test_odd_documents(spark, odd_documents, no_documents):
    assert W.dealt(W.edited_fingerprints(no_documents)).count() == 0
    one = W.edited_fingerprints(spark.createDataFrame([(5, "a b c")], "doc_id long, text string")).collect()
    assert [(r.near_edited, r.near_next) for r in one] == [(0.0, 1.0)]
    rows = W.dealt(W.edited_fingerprints(odd_documents)).collect()
    assert len(rows) == odd_documents.count()
    # rows of one id follow each other by a hash of the text
    given = sorted(((r.doc_id is not None, r.doc_id or 0, xxhash_of(r.text or ""), r.text or "") for r in odd_documents.collect()), key=lambda x: x[:3])
    want = list(plain([(x[1] if x[0] else None, x[3]) for x in given]))
    got = [(r.doc_id, r.n_chars, r.edited_sha256, [tuple(x) for x in r.fingerprint], [tuple(x) for x in r.edited], r.near_edited, r.near_next) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def xxhash_of(text):
    return struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(text.encode(), seed=42)))[0]


def test_many_rows_alike_are_dealt_in_pieces(spark):
    docs = spark.range(3000).select(F.when(F.col("id") < 2500, 7).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") < 2500, "one and the same text of a few words in a row").otherwise(F.concat(F.lit("text no "), "id")).alias("text"))
    out = W.dealt(W.edited_fingerprints(docs))
    assert out.count() == 3000 and out.filter("doc_id = 7").count() == 2500 and out.filter("doc_id = 7 AND near_next = 1").count() == 2499


def test_no_python_in_the_plan(spark, sf):
    plan = Q.QUERIES["op13_winnowing"](spark, sf)._jdf.queryExecution().toString()
    assert not [x for x in ("Python", "Pandas", "Arrow", "ExistingRDD") if x in plan]


@pytest.mark.parametrize("n", [12, 13, 30])
def test_shared_passages_of_enough_words_meet(spark, n):
    passage = " ".join(f"p{i}" for i in range(n))
    rows = [(1, f"one two three {passage} four five"), (2, f"{passage} six seven eight nine ten eleven")]
    got = W.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), "text", "fingerprint")
    met = W.shared_passages(got.filter("doc_id = 1"), got.filter("doc_id = 2"), "doc_id").collect()
    assert met and all(r.a_place - 3 == r.b_place for r in met)
