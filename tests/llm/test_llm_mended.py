"""Foreign WARC records, exact draws, spread copies, ids with two labels."""

import base64
import gzip
import hashlib
import math
import random
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewell.llm import knn_quality, sharding, warc_zip


def record(kind, block, **fields):
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{kind}-{len(block)}>", "Content-Length": len(block), **fields}
    return gzip.compress(("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + block + b"\r\n\r\n")


def package(spark, tmp_path, *records):
    with zipfile.ZipFile(tmp_path / "foreign.wacz", "w", zipfile.ZIP_STORED) as z:
        z.writestr("archive/data.warc.gz", b"".join(records))
    return spark.createDataFrame([(f"file://{tmp_path}/foreign.wacz",)], "path string")


def test_foreign_package(spark, tmp_path):
    body = b"<html>hello</html>"
    sha1 = "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n" + body
    rows = [
        record("warcinfo", b"software: something\r\n"), record("request", b"GET / HTTP/1.1\r\n\r\n"),
        record("response", http, **{"WARC-Target-URI": "http://a.b/", "WARC-Payload-Digest": sha1}),
        record("response", b"no head at all", **{"WARC-Payload-Digest": "blake9:xyz"}),
        record("revisit", b"HTTP/1.1 304 Not Modified\r\n\r\n", **{"WARC-Payload-Digest": sha1, "WARC-Refers-To": "<urn:uuid:1>"}),
        record("metadata", b"x"), record("response", b"HTTP/1.1 200 OK\r\n\r\n"),
    ]
    got = warc_zip.read_archives(package(spark, tmp_path, *rows)).collect()
    assert len(got) == 4 and all(r.page_id is None and r.refers_to is None for r in got)
    by = {(r.record_type, r.payload_bytes): r for r in got}
    page = by["response", len(body)]
    assert (page.url, bytes(page.payload), page.payload_digest, page.record_id) == ("http://a.b/", body, hashlib.sha256(body).hexdigest(), f"<urn:uuid:response-{len(http)}>")
    assert bytes(by["response", 14].payload) == b"no head at all" and bytes(by["response", 0].payload) == b""
    assert by["revisit", None].payload_digest == sha1 and by["revisit", None].payload is None


@pytest.mark.parametrize("fields", [{"WARC-Payload-Digest": "sha1:" + "A" * 32}, {"WARC-Block-Digest": "md5:00"}])
def test_damaged_foreign_record(spark, tmp_path, fields):
    with pytest.raises(Exception, match="damaged"):
        warc_zip.read_archives(package(spark, tmp_path, record("response", b"HTTP/1.1 200 OK\r\n\r\nx", **fields))).collect()


@pytest.mark.parametrize("rows", [10**3, 10**9, 10**11, 16 * 10**12])
@pytest.mark.parametrize("draws", [0, 1, 700, 100_000])
def test_the_law_has_a_mass_of_one(rows, draws):
    good, draws = rows // 16, min(draws, rows)
    law = list(sharding.law(good, rows - good, draws))
    assert len({k for k, _ in law}) == len(law) and abs(math.fsum(p for _, p in law) - 1) < 1e-9
    mean = math.fsum(k * p for k, p in law)
    assert abs(mean - draws * good / rows) <= 1e-6 * max(1, draws)


def test_small_law_is_that_of_counting():
    want = {k: math.comb(7, k) * math.comb(5, 6 - k) / math.comb(12, 6) for k in range(1, 7)}
    assert {k: pytest.approx(p, rel=1e-12) for k, p in sharding.law(7, 5, 6)} == want
    rng = random.Random(2)
    got = Counter(sharding.hypergeometric(rng, 7, 5, 6) for _ in range(20_000))
    assert all(abs(got[k] / 20_000 - p) < 0.015 for k, p in want.items())


def test_copies_are_spread_over_partitions(spark, monkeypatch):
    seen, real = [], sharding.cut
    monkeypatch.setattr(sharding, "cut", lambda df, name: seen.append((name, real(df, name))) or seen[-1][1])
    rows = spark.range(10_000).select(F.when(F.col("id") < 9_001, 1).otherwise(F.col("id")).alias("doc_id"), F.lit("s").alias("no"))
    out = sharding.shuffle_into_shards(rows, key_cols=["doc_id"])
    got = out.collect()
    assert Counter(r.doc_id for r in got)[1] == 9_001 and len(got) == 10_000
    shards = Counter(r.shard for r in got)
    assert max(shards.values()) - min(shards.values()) <= 1 and len({(r.shard, r.slot) for r in got}) == 10_000
    pieces = dict(seen)["sharding"].groupBy("shard", "piece").count().collect()
    assert max(r["count"] for r in pieces) < 3 * 10_000 / len(pieces)


def test_an_id_with_both_labels_teaches_the_smaller(spark):
    docs = spark.createDataFrame([(i, f"words of text number {i} " * 20) for i in range(40)], "doc_id long, text string")
    both = [(i, i % 2) for i in range(40)] + [(i, 1) for i in range(40)]
    models = [knn_quality.fit_quality(docs, spark.createDataFrame(rows, "doc_id long, quality int").repartition(n), F.lit(True), dims=8) for n, rows in ((1, both), (5, both[::-1]))]
    assert all(sorted(m["labels"].tolist()) == [0] * 20 + [1] * 20 for m in models)
    assert (models[0]["vectors"] == models[1]["vectors"]).all()
