"""Each operator on nulls, empty and long texts, ties, repeated rows, empty tables, clashing extra columns; and parts
of operators against plain versions."""

import io
import random
import re
import zipfile
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewell.llm import chat_tree, decontam, knn_quality, near_dedup, ngram_lm, packing, sharding, textcore, topk_search, url_filter, warc_zip
from tidewell.llm.elias_fano import EliasFano
from tidewell.llm.queries import TOKENIZERS
from tidewell.llm.shared import cut, scratch

BYTES = f"{TOKENIZERS}/byte_bpe_50k.json"
WORDS = f"{TOKENIZERS}/word_bpe_49k.json"


# quality


def test_quality_odd(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 1), (5, 0), (7, 1), (None, 1), (99, 0), (6, None)], "doc_id long, quality int")
    model = knn_quality.fit_quality(odd_documents, labels, F.lit(True))
    rows = odd_documents.select("doc_id", knn_quality.quality_score(odd_documents, model).alias("s")).collect()
    assert len(rows) == odd_documents.count() and all(0 <= r.s <= 1 for r in rows)
    often = odd_documents.select("doc_id", "text").unionByName(spark.range(500).selectExpr("7L AS doc_id", "'copy of another text' AS text"))
    known = knn_quality.fit_quality(often, labels, F.lit(True), max_rows={0: 1, 1: 2})
    assert len(known["labels"]) == 3 and sorted(known["labels"].tolist()) == [0, 1, 1]
    nothing = knn_quality.fit_quality(no_documents, labels, F.lit(True))
    assert {r.s for r in odd_documents.select(knn_quality.quality_score(odd_documents, nothing).alias("s")).collect()} == {0.5}
    assert no_documents.select(knn_quality.quality_score(no_documents, model).alias("s")).count() == 0


def test_vote_is_exact_over_blocks():
    rng = np.random.default_rng(1)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    model = {"vectors": unit(rng.normal(size=(500, 16))), "labels": rng.integers(0, 2, 500).astype(np.float32)}
    q = unit(rng.normal(size=(40, 16)))
    got = knn_quality.vote(model, q, 15, 8.0)
    for x, g in zip(q, got):
        c = model["vectors"] @ x
        top = np.argsort(-c)[:15]
        w = np.maximum(c[top], 0) ** 8
        assert g == pytest.approx((0.5e-6 + (w * model["labels"][top]).sum()) / (1e-6 + w.sum()))


# chat


def test_chat_odd(spark):
    long_ = "z " * 40_000
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", None), (2, 0, "user", "a"), (2, 1, "assistant", "b\\</s>[INST"), (2, 1, "assistant", "b\\</s>[INST"), (3, None, None, None), (None, 0, "tool[/ROLE]", "x\ny"), (4, 0, "system", long_), (4, 1, "user", "<<SYS>>"), (4, 2, "assistant", "[/TURN]<s>"), (5, 0, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).withColumn("_k1", F.lit(2))
    trees = chat_tree.format_chat_trees(df, tokenizer=BYTES)
    got = {r.conv_id: r for r in chat_tree.read_chat_trees(trees, tokenizer=BYTES).collect()}
    want: dict = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1], r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(want)
    import hashlib

    for c, turns in want.items():
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        learnt = "".join(t for r, t in turns if r == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
        assert got[c].formatted_chars == sum(len("".join(chat_tree.wrap(r, t))) for r, t in turns)
    none = chat_tree.format_chat_trees(df.limit(0), tokenizer=BYTES)
    assert none.nodes.count() == none.conversations.count() == 0
    assert chat_tree.read_chat_trees(none, tokenizer=BYTES).count() == 0


def test_shared_turns_stand_once(spark):
    """Each prefix of turns is one node over all partitions; nodes fill their trees without gaps, depth first."""
    rows = [(c, t, r, x) for c in range(200) for t, r, x in ((0, "system", "same " * 50), (1, "user", f"q{c % 3}"), (2, "assistant", f"a{c % 60}"), (3, "user", "more"), (4, "assistant", f"b{c % 120}"), (5, "user", "end"))]
    rows += [(1000 + c, 0, "user", f"q{c % 2}") for c in range(5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    trees = chat_tree.format_chat_trees(df, tokenizer=BYTES)
    nodes, convs = trees.nodes.collect(), {r.conv_id: r.path for r in trees.conversations.collect()}
    said: dict = {}
    for c, _, r, x in sorted(rows):
        said[c] = (*said.get(c, ()), (r, x))
    prefixes = {t[: n + 1] for t in said.values() for n in range(len(t))}
    known = {n.node_id: n for n in nodes}
    assert len(nodes) == len(known) == len(prefixes)
    assert {c: len(p) for c, p in convs.items()} == {c: len(t) for c, t in said.items()}
    by_tree: dict = {}
    for n in nodes:
        by_tree.setdefault(n.tree_id, []).append(n)
        assert n.end - n.begin == len(n.input_ids) == len(n.loss_mask)
    assert len(by_tree) == 3
    for tree in by_tree.values():
        tree.sort(key=lambda n: n.begin)
        assert [n.begin for n in tree] == [0, *[n.end for n in tree[:-1]]]
        stack: list = []
        for n in tree:  # depth first: a node's parent is on the open path
            del stack[n.depth :]
            assert (stack[-1].node_id if stack else None) == n.parent_id
            before = [i for x in n.attend for i in range(x.begin, x.end)]
            assert before == [i for x in stack for i in range(x.begin, x.end)]
            assert n.position_ids == list(range(len(before), len(before) + len(n.input_ids)))
            stack.append(n)


def test_escape_round_trip():
    rng = random.Random(3)
    bits = [*chat_tree.CONTROL, "\\", "[", "<", "s>", "/", "ROLE]", "a", "\n", "]", ">"]
    for _ in range(3000):
        text = "".join(rng.choices(bits, k=rng.randint(0, 8)))
        safe = chat_tree.escape(text)
        assert chat_tree.unescape(safe) == text and not any(c in safe for c in chat_tree.CONTROL)
        role = rng.choice(["user", "assistant", "system", text])
        assert chat_tree.parse("".join(chat_tree.wrap(role, text)) * 2) == [(role, text)] * 2


# packing


def test_packing_odd(spark, odd_documents, no_documents):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORDS)
    rows = packing.pack_documents(odd_documents, tokenizer=WORDS).collect()
    want = Counter()
    for r in odd_documents.select("doc_id", "text").collect():
        n = len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1
        want.update((r.doc_id, p, min(4096, n - p * 4096)) for p in range(-(-n // 4096)))
    assert Counter((r.doc_id, r.piece, r.length) for r in rows) == want
    spans = {(r.sequence_id, r.offset) for r in rows}
    assert len(spans) == len(rows)
    assert packing.pack_documents(no_documents, tokenizer=WORDS).count() == 0


def test_words_are_encoded_as_the_tokenizer_does():
    from tokenizers import Tokenizer

    tok, own = Tokenizer.from_file(WORDS), packing.WordTokens(WORDS, remember=50)
    rng = random.Random(5)
    bits = ["don't", "'S", "it's", "é", "ß", "Ç", "12", "!!'re", "…", "漢", "\x1c", "\u0301", " ", "  ", "\n", "ab", "İ", "<|endoftext|>", "_", "x²", "ª"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 20))) for _ in range(800)]
    for first in range(0, 800, 100):
        some = texts[first : first + 100]
        assert [np.frombuffer(x, "<u4").tolist() for x in own(some)] == [tok.encode(t, add_special_tokens=False).ids for t in some]


@pytest.mark.parametrize("seed", range(6))
def test_plans_use_every_piece_once(seed):
    rng = random.Random(seed)
    counts = Counter(min(4096, max(1, int(rng.lognormvariate(6 - seed / 3, 1.2)))) for _ in range(rng.choice([1, 7, 500, 5000])))
    plan = packing.pack_plan(dict(counts))
    used = Counter()
    for lengths, n in plan:
        assert n > 0 and sum(lengths) <= 4096
        for x in lengths:
            used[x] += n
    assert used == counts
    least = -(-sum(k * v for k, v in counts.items()) // 4096)
    assert sum(n for _, n in plan) <= 1.05 * least + 2 or max(counts) > 2048


def test_nnls_fits():
    rng = np.random.default_rng(2)
    a, x = rng.random((30, 60)), np.maximum(rng.normal(size=60), 0)
    got = packing.nnls(a, a @ x)
    assert (got >= 0).all() and np.linalg.norm(a @ got - a @ x) < 1e-6


# archives


def test_archives_odd(spark):
    same = "y" * 200
    rows = [(1, "http://a/\r\nX: y", "x"), (2, None, None), (3, "u", ""), (9, "u", same), (4, "v", same), (4, "v", same), (None, "w", same), (5, "s", "short"), (6, "s", "short"), (7, "l", "é" * 500_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("first", F.lit(2))
    done = cut(warc_zip.write_archives(df, scratch(spark, "warc"), max_bytes=500), "w")
    assert sum(r.records for r in done.collect()) == len(rows)
    got = warc_zip.read_archives(done).collect()
    want = Counter()
    for p, _, html in rows:
        data = (html or "").encode()
        first = 4 if html == same else None
        want[(p, "revisit" if first and p != first else "response", first if first and p != first else None, len(data))] += 1
    assert Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got) == want
    texts = {r.page_id: bytes(r.payload).decode() for r in got if r.payload is not None}
    assert texts[7] == "é" * 500_000 and texts[2] == ""
    assert warc_zip.read_archives(cut(warc_zip.write_archives(df.limit(0), scratch(spark, "warc")), "w")).count() == 0


def test_central_directories():
    for entries, prefix, comment in ((3, b"", b""), (3, b"junk" * 10, b"PK\5\6 in a comment"), (70_000, b"", b"")):
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            z.comment = comment
            for i in range(entries):
                with z.open(f"archive/{i}.txt", "w", force_zip64=i < 3) as f:
                    f.write(b"%d" % i)
        raw = prefix + data.getvalue()
        members = list(warc_zip.central_directory(io.BytesIO(raw), len(raw)))
        assert [m["name"] for m in members] == [f"archive/{i}.txt" for i in range(entries)]
        for m in (members[0], members[-1]):
            at = warc_zip.data_start(io.BytesIO(raw), m)
            assert raw[at : at + m["size"]] == m["name"][8:-4].encode()
    with pytest.raises(ValueError):
        list(warc_zip.central_directory(io.BytesIO(b"nothing"), 7))


def test_archives_without_index(spark):
    """Members that no index lists are found by reading the archive through."""
    folder = scratch(spark, "bare").removeprefix("file://")
    import os

    os.makedirs(folder)
    records = [warc_zip.record_bytes(i, f"u{i}", b"p%d" % i, len(b"p%d" % i), __import__("hashlib").sha256(b"p%d" % i).hexdigest()) for i in range(5)]
    with zipfile.ZipFile(f"{folder}/x.wacz", "w", zipfile.ZIP_STORED) as z:
        z.writestr("archive/a.warc.gz", b"".join(records))
        z.writestr("pages/pages.jsonl", "{}")
    got = warc_zip.read_archives(spark.createDataFrame([(f"file://{folder}/x.wacz",)], "path string")).collect()
    assert sorted((r.page_id, bytes(r.payload)) for r in got) == [(i, b"p%d" % i) for i in range(5)]


def test_archives_that_cannot_be_read_by_ranges(spark):
    """Compressed members, and indexes that name none or several archives, are errors; base names may repeat."""
    import hashlib
    import os

    folder = scratch(spark, "odd").removeprefix("file://")
    os.makedirs(folder)
    records = [warc_zip.record_bytes(i, f"u{i}", b"p%d" % i, 2, hashlib.sha256(b"p%d" % i).hexdigest()) for i in range(4)]
    line = lambda name, i: f"u{i} 2024 " + __import__("json").dumps({"offset": 0, "length": len(records[i]), "filename": name})

    def read(method, members, index):
        path = f"{folder}/{len(os.listdir(folder))}.wacz"
        with zipfile.ZipFile(path, "w", method) as z:
            for name, i in members:
                z.writestr(name, records[i])
            if index:
                z.writestr("indexes/index.cdxj", "\n".join(index))
        rows = warc_zip.read_archives(spark.createDataFrame([(f"file://{path}",)], "path string")).collect()
        return sorted((r.page_id, bytes(r.payload)) for r in rows)

    two = [("archive/x/a.warc.gz", 0), ("archive/y/a.warc.gz", 1)]
    both = [(0, b"p0"), (1, b"p1")]
    assert read(zipfile.ZIP_STORED, two, []) == both
    assert read(zipfile.ZIP_STORED, two, [line("x/a.warc.gz", 0), line("archive/y/a.warc.gz", 1)]) == both
    for method, members, index in ((zipfile.ZIP_DEFLATED, two, []), (zipfile.ZIP_STORED, two, [line("a.warc.gz", 0)]), (zipfile.ZIP_STORED, two[:1], [line("b.warc.gz", 0)])):
        with pytest.raises(Exception, match="package"):
            read(method, members, index)


# top-k


def test_top_k_odd(spark):
    rows = [(0, [1.0, 2.0]), (20, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 0.0]), (5, [float("inf"), 0.0]), (6, [1.0]), (7, []), (None, [1.0, 1.0]), (8, [-0.5, 0.25]), (8, [-0.5, 0.25])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("shard", F.lit(1)).withColumn("q", F.lit("x"))
    got = topk_search.exact_top_k(df, F.col("vec_id") % 20 == 0, k=3, shard_rows=2, block_queries=1).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == [(0, 1, 1, 5242880), (0, 2, 20, 5242880), (0, 3, 8, 0), (20, 1, 0, 5242880), (20, 2, 1, 5242880), (20, 3, 8, 0)]
    assert topk_search.exact_top_k(df.limit(0), F.lit(True)).count() == 0
    big = spark.createDataFrame([(0, [2.0**30, 2.0**30]), (1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="64 bits"):
        topk_search.exact_top_k(big, F.lit(True))


def test_trees_find_what_brute_force_finds():
    rng = np.random.default_rng(4)
    for n, d, top in ((1, 3, 5), (700, 4, 10), (3000, 16, 10), (500, 2, 7)):
        rows, ids = rng.integers(-50, 50, (n, d)), rng.permutation(n * 2)[:n]
        rows[: n // 3] = rows[0]
        tree = topk_search.build_tree(ids, rows, leaf=16)
        q = rng.integers(-50, 50, (20, d))
        got: dict = {}
        for query, row, score in topk_search.search_tree(tree, np.arange(20) + 10**6, q, top, np.full(20, -(2**63))):
            got.setdefault(query, []).append((-score, row))
        for i in range(20):
            want = sorted(zip((-(rows @ q[i])).tolist(), ids.tolist()))[:top]
            assert sorted(got[10**6 + i]) == want


# language model


def test_lm_odd(spark, odd_documents, no_documents):
    model = ngram_lm.train(odd_documents, F.col("text"), words_a_file=10_000, places_a_file=5000)
    rows = ngram_lm.score_texts(odd_documents, model).collect()
    assert len(rows) == odd_documents.count()
    assert all(r.n_tokens >= 1 and r.score < 0 and np.isfinite(r.score) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3, 4)} == {1}
    nothing = ngram_lm.train(no_documents, F.col("text"))
    assert all(r.n_known == 0 and r.score == r.base_score == 0 for r in ngram_lm.score_texts(odd_documents, nothing).collect())
    assert ngram_lm.score_texts(no_documents, model).count() == 0


def _plain_model(texts, least=1, discount=0.7):
    """log10 probability of a text by interpolated absolute discounting, with plain dictionaries."""
    split = lambda t: ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in re.findall("[^\x20\x09-\x0d]+", t)]
    one, two, three = Counter(), Counter(), Counter()
    for t in texts:
        w = [None, *split(t), 0]
        one.update(w[1:])
        two.update(zip(w, w[1:]))
        three.update(zip(w, w[1:], w[2:]))
    begins, n, v = len(texts), sum(one.values()), len(one)
    two_kept, three_kept = ({k: c for k, c in x.items() if c >= least} for x in (two, three))
    three_kept = {k: c for k, c in three_kept.items() if k[:2] in two_kept}
    mass2, mass3 = Counter(), Counter()
    for k, c in two_kept.items():
        mass2[k[0]] += c - discount
    for k, c in three_kept.items():
        mass3[k[:2]] += c - discount

    def score(t):
        w, out = [None, *split(t), 0], 0.0
        for i in range(1, len(w)):
            p = (one[w[i]] + 1) / (n + v + 1)
            if w[i - 1] in one or i == 1:
                occurs = begins if i == 1 else one[w[i - 1]]
                p = max(0, two_kept.get((w[i - 1], w[i]), discount) - discount) / occurs + (1 - mass2[w[i - 1]] / occurs) * p
            if i > 1 and (pair := (w[i - 2], w[i - 1])) in two_kept:
                p = max(0, three_kept.get((*pair, w[i]), discount) - discount) / two[pair] + (1 - mass3[pair] / two[pair]) * p
            out += np.log10(p)
        return out

    return score


@pytest.mark.parametrize("least", [1, 2])
def test_lm_scores_as_a_plain_model_does(spark, monkeypatch, least):
    """Also with words and the text's begin in several files, and texts longer than a run."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(vocabulary, weights=[60 / (i + 1) for i in range(60)], k=rng.randint(0, 40))) for _ in range(300)]
    texts += ["the " * 300, "", "Only ONCE said", "w0 w1 " * 700]
    held = ["w0 w1 never w2 w3 w0", "only once", "", "w59 w58 w57", "once said w0", "w0 w1 w0 w1 w0"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for run, files in ((1_500_000, 1_000_000), (200, 100)):
        monkeypatch.setattr(ngram_lm, "RUN", run)
        monkeypatch.setattr(ngram_lm, "MAPPED", run)
        model = ngram_lm.train(docs, F.col("text"), least=least, words_a_file=20, places_a_file=files)
        assert run > 1000 or len(model.files) > 20 and len(model.split) > 3
        plain = _plain_model(texts, least)
        asked = spark.createDataFrame(list(enumerate(texts + held)), "doc_id long, text string")
        for r in ngram_lm.score_texts(asked, model).collect():
            assert -0.003 * r.n_tokens <= r.score - plain((texts + held)[r.doc_id]) <= 1e-9


def test_lm_counts_alike_in_runs_of_any_length(spark, monkeypatch):
    rng = random.Random(12)
    texts = [" ".join(rng.choices("abcdefgh", k=rng.randint(0, 30))) for _ in range(80)] + ["a b " * 500, ""]
    model = ngram_lm.train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), F.col("text"), places_a_file=500)
    found = []
    for run in (1_500_000, 40):
        monkeypatch.setattr(ngram_lm, "RUN", run)
        parts: dict = {}
        for batch in ngram_lm._trigrams(iter([pa.record_batch([pa.array(texts)], names=["text"])]), model):
            parts.setdefault(batch.column("shard")[0].as_py(), []).append(batch.column("data")[0].as_py())
        found.append({(s, *row) for s, data in parts.items() for row in zip(*(c.tolist() for c in ngram_lm._merge(data)))})
        assert run > 40 or max(map(len, parts.values())) > 10
    assert found[0] == found[1] and sum(r[4] for r in found[0]) == sum(len(t.split()) + 1 for t in texts)


def test_lm_sums_to_one_at_most(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choices("abcdefgh", k=12)) for _ in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    model = ngram_lm.train(docs, F.col("text"), places_a_file=50, words_a_file=3)
    trie = ngram_lm.Trie(model)
    ids = np.arange(model.vocabulary)
    p1 = trie.unigram(trie.counts_of(ids))
    for before, last in ((-1, -1), (-1, model.vocabulary), (model.vocabulary, 0), (3, 4), (2, -1)):
        total = 0.0
        for word in ids:  # a place and, before it, the place of its context
            got = trie.score(np.array([-1, before]), np.array([before, last]), np.array([last, word]), np.array([0.5, p1[word]]))
            total += got[1]
        assert 0.97 < total <= 1.0


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1), (5, 3), (1000, 10**9), (50_000, 10**12), (5000, 200)):
        v = np.sort(rng.integers(0, top, n))
        e = EliasFano(EliasFano.encode(v, "x"), "x")
        assert n == 0 or (e.get(np.arange(n)) == v).all()
        t = rng.integers(0, top + 5, 3000)
        assert (e.successor(t, np.zeros(3000, np.int64), np.full(3000, n)) == np.searchsorted(v, t)).all()


# sharding


def test_sharding_odd(spark, odd_documents, no_documents):
    odd = odd_documents.select("doc_id", F.length("text").alias("l"), *[F.col("doc_id").alias(c) for c in ("_part", "_rank", "piece", "row", "slot", "n", "a.b")])
    rows = sharding.shuffle_into_shards(odd, key_cols=["doc_id", "l"], n_shards=4, least_partitions=3).collect()
    assert len(rows) == odd_documents.count() and all(r["_part"] == r["row"] == r["piece"] == r["n"] == r["a.b"] == r.doc_id for r in rows)
    slots = Counter((r.shard, r.slot) for r in rows)
    sizes = Counter(r.shard for r in rows)
    assert max(slots.values()) == 1 and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(s < sizes[h] for h, s in slots)
    assert sharding.shuffle_into_shards(no_documents.select("doc_id"), key_cols=["doc_id"]).count() == 0


def test_matrices_have_their_sums_and_law():
    m = sharding.communication_matrix([5, 0, 7, 100], [28, 28, 28, 28], 1)
    assert [sum(r) for r in m] == [5, 0, 7, 100] and [sum(c) for c in zip(*m)] == [28] * 4
    rng, good, bad, draws = random.Random(2), 6, 9, 5
    n = 20_000
    got = Counter(sharding.hypergeometric(rng, good, bad, draws) for _ in range(n))
    from math import comb

    for k in range(6):
        assert abs(got[k] / n - comb(good, k) * comb(bad, draws - k) / comb(15, 5)) < 0.015
    big = [sharding.hypergeometric(rng, 10**11, 10**11, 10**6) for _ in range(200)]
    assert abs(np.mean(big) - 5e5) < 300 and 300 < np.std(big) < 800


def test_every_order_is_as_likely(spark):
    """The shard of a row, over seeds."""
    df = spark.range(6).toDF("i")
    got = Counter()
    for seed in range(12):
        got.update((r.i, r.shard) for r in sharding.shuffle_into_shards(df, key_cols=["i"], n_shards=2, seed=seed, least_partitions=2).collect())
    assert all(got[i, 0] + got[i, 1] == 12 for i in range(6)) and len(got) >= 11


# decontamination


@pytest.mark.parametrize("limits", [{}, {"filter_bits": 64, "max_broadcast": 0}])
def test_contamination_odd(spark, odd_documents, no_documents, limits):
    items = [(1, "quick brown fox jumps over the lazy dog and runs"), (2, "Word"), (3, None), (4, "?!"), (None, "null id has"), (10, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 w16"), (11, "W6 w7 w8 w9 w10 w11 w12 w13 w14 w15"), (12, "text that")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("k", F.lit(1))
    got = decontam.find_contamination(odd_documents, bench, **limits).collect()
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    want = Counter()
    for r in odd_documents.select("doc_id", "text").collect():
        w, hit, found = words(r.text), set(), set()
        at = {}
        for i, x in enumerate(w):
            at.setdefault(x, []).append(i)
        for item, text in items:
            iw = words(text)
            for s in range(max(1, len(iw) - 9)) if iw else ():
                win = iw[s : s + 10]
                for p in at.get(win[0], ()):
                    if w[p : p + len(win)] == win:
                        hit.update(range(p, p + len(win)))
                        found.add("null" if item is None else str(item))
        import hashlib

        want[(r.doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))] += 1
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want
    assert decontam.find_contamination(no_documents, bench, **limits).count() == 0
    assert {r.n_hit for r in decontam.find_contamination(odd_documents, bench.limit(0), **limits).collect()} == {0}


# near duplicates


def test_near_duplicates_odd(spark, odd_documents, no_documents):
    rows = near_dedup.near_duplicates(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    classes = {}
    for r in rows:
        classes.setdefault(r.class_id, []).append(r)
    assert sorted(r.doc_id for r in classes[7]) == [7, 7, 8, 12]
    assert all(sum(r.kept for r in c) == 1 for k, c in classes.items() if k is not None)
    assert sorted(str(r.doc_id) for r in classes[2]) == ["2", "3", "None"]
    assert near_dedup.near_duplicates(no_documents).count() == 0


def _edited(rng, base, most, n):
    texts = []
    for _ in range(n):
        w = list(base)
        for i in rng.sample(range(len(base)), rng.randint(1, most)):
            w[i] = f"x{rng.randrange(10**12)}"
        texts.append(" ".join(w))
    return texts


def _linked(texts, k=5):
    bags = [Counter(tuple(t.split()[i : i + k]) for i in range(len(t.split()) - k + 1)) for t in texts]
    label, changed = list(range(len(texts))), True
    near = [(i, j) for i in range(len(texts)) for j in range(i) if (bags[i] & bags[j]).total() >= 0.8 * (bags[i] | bags[j]).total()]
    while changed:
        changed = False
        for i, j in near:
            m = min(label[i], label[j])
            changed |= label[i] != m or label[j] != m
            label[i] = label[j] = m
    return dict(enumerate(label))


@pytest.mark.parametrize(("paired", "held", "rounds"), [(2, 7, 1), (2, 1000, 3)])
def test_large_buckets_are_compared_in_blocks(spark, monkeypatch, paired, held, rounds):
    rng = random.Random(9)
    texts = _edited(rng, [f"w{i}" for i in range(150)], 8, 120)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(near_dedup, "PAIRED", paired)
    monkeypatch.setattr(near_dedup, "ASKED", 5)
    monkeypatch.setattr(near_dedup, "HELD", held)
    monkeypatch.setattr(near_dedup, "SPREAD", 10)
    monkeypatch.setattr(near_dedup, "ROUNDS", rounds)
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()} == _linked(texts)


def test_links_are_at_most_one_a_row_and_round(spark, monkeypatch):
    """A large group of close copies, and two groups of one boilerplate that share buckets but no link."""
    rng = random.Random(10)
    half = [f"w{i}" for i in range(170)]
    texts = _edited(rng, [f"v{i}" for i in range(200)], 5, 300)
    for g in "ab":
        texts += _edited(rng, half + [f"{g}{i}" for i in range(30)], 2, 150)
    seen: dict = {}
    plain = near_dedup.cut

    def counted(df, name):
        out = plain(df, name)
        seen.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "cut", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()}
    assert got == _linked(texts)
    assert all(n <= len(texts) for n in seen["pairs"]) and len(seen["pairs"]) <= near_dedup.ROUNDS
    assert sum(seen["more-links"]) <= len(texts)
    assert all(n <= 2 * len(texts) for n in seen["components-edges"])


def test_repeated_shingles_weigh(spark):
    """The same shingles, but one text says them five times: alike as sets, not as weighted sets."""
    line = " ".join(f"w{i}" for i in range(60)) + " "
    df = spark.createDataFrame([(1, line * 4), (2, line * 20), (3, line * 20 + "end")], "doc_id long, text string")
    classes = lambda **how: {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df, **how).collect()}
    assert classes() == {1: 1, 2: 2, 3: 2}
    assert classes(counted=False) == {1: 1, 2: 1, 3: 1}


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(6)
    for n, common, w in ((1, 1, None), (10, 5, None), (400, 330, None), (60, 50, 2.5), (50, 20, 0.3)):
        out = []
        for _ in range(30):
            ids = rng.integers(0, 2**63, 2 * n - common).astype(np.uint64)
            doc, el = np.repeat([0, 1], n), np.concatenate([ids[:n], ids[n - common :]])
            s = near_dedup.dart_signatures(2, doc, el, None if w is None else np.full(2 * n, w), 192)
            out.append((s[0] == s[1]).mean())
        assert abs(np.mean(out) - common / (2 * n - common)) < 0.05
    el = np.arange(1, 6).astype(np.uint64)
    weights = np.array([1, 2, 3, 4, 5.0])
    a = [near_dedup.dart_signatures(2, np.repeat([0, 1], 5), np.tile(el, 2), np.concatenate([weights, weights[::-1]]), 192, seed=s) for s in range(40)]
    assert abs(np.mean([(s[0] == s[1]).mean() for s in a]) - 9 / 21) < 0.05


# URLs


def test_urls_odd(spark):
    urls = [None, "", "no scheme", "http://", "http://COM/en/x", "http://a.b.Example.com/en/7?x", "http://example.com/en/8#y", "https://notexample.com/en/7", "ftp://com?/en/", "http://net/de/8/9", "x://example.net/de/81", "x://.net/de/8", "http://example.net:80/de/8", "http://user@example.com/en/7", "a://b://com/en/", "http://com/EN/", "http://com,example/en/7x", "http://com\x00/en/", "http://.com/en/"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(0, None), (4, urls[4]), (None, urls[4])]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1)).withColumn("_key", F.lit(2))
    from tidewell.llm.queries import URL_RULES

    def plain(u):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        return host, path, best[1], best[2]

    for most in (200_000, 2):
        got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df, URL_RULES, max_rules=most).collect())
        assert got == Counter((i, *plain(u)) for i, u in rows)
    assert url_filter.judge_urls(df.limit(0), URL_RULES).count() == 0
    assert {r.rule for r in url_filter.judge_urls(df, [("block", "example/com", "/en/"), ("block", "com?", "")]).collect()} == {None}
    assert {r.verdict for r in url_filter.judge_urls(df, [], default="block").collect()} == {"block"}


# words


def test_word_hashes_tell_words_apart():
    texts = ["Hello, Wörld foo", "", "  a b ", "ÀB c", "word", " ", None, "tail of text. And", "x" * 50] * 3
    for lut, pattern in ((textcore.WORDS, rb"[a-z0-9\x80-\xff]+"), (textcore.SPACED, rb"[^\x20\x09-\x0d]+")):
        want = [(i, w) for i, t in enumerate(texts) for w in re.findall(pattern, (t or "").encode().lower())]
        for block in (1, 1 << 20):
            doc, got = [], []
            for first, _, data, offsets in textcore.blocks(pa.array(texts), block):
                d, h = textcore.words(data, offsets, lut)
                doc += (d + first).tolist()
                got += h.tolist()
            assert doc == [i for i, _ in want]
            known: dict = {}
            assert all(known.setdefault(w, h) == h for (_, w), h in zip(want, got)) and len(set(known.values())) == len(known)


