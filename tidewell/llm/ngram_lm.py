"""N-gram language model in an Elias-Fano trie.

The vocabulary is sorted 64-bit word hashes with counts; a word's id is its place. A node of the trie is an n-gram: a
context and one more word. A level keeps, by context, where its successors begin (monotone pointers), the successors'
ids made monotone by adding what the contexts before use up, and discounted frequencies and back-off weights in
steps of 1/2048 of a decade, always rounded down. Bigrams and trigrams are cut by their first two words into files of
bounded size in the shared folder, each with both levels; tasks map a few of them at a time into memory and look up
whole batches by successor search relative to a context.

Smoothing is interpolated absolute discounting down to add-one unigrams. Every n-gram counts, those seen once too
(``least`` can prune). All levels come from one shuffle: each place of a text gives one trigram, whose begin is its
bigram.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .elias_fano import EliasFano, map_arrays, write_arrays
from .shared import cut, scratch
from .textcore import SPACED, U, blocks, words

#: Bytes of text that are counted or scored at once; each block asks most files.
BLOCK, SCORED = 2 << 20, 4 << 20
#: Places of texts that are counted at once: three local ids of so many distinct words fit 63 bits.
RUN = 1_500_000
#: Bytes of files that a task keeps mapped.
MAPPED = 128 << 20
#: The hash that stands for the end of a text in the vocabulary.
END = np.array([0x5BD1E9955BD1E995], U).view(np.int64)[0]
STEPS = 2048
SCORES = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
FILES = "shard long, uri string, bigrams long, trigrams long, head long, head_mass double, tail long, tail_mass double"
_ZSTD = "zstd"


@dataclass
class Model:
    """What tasks need to open the trie: a few numbers and the files' places; its size grows with the files only.

    Words and the mark before a text's first word (id ``vocabulary``) are below ``width``. File i has the n-grams whose
    first two words, as ``first * width + second``, are from edges[i] to edges[i + 1]."""

    tokens: int
    vocabulary: int
    texts: int
    vocab_bits: int
    vocab: list[tuple[str, int]]
    edges: list[int] = field(default_factory=lambda: [0])
    files: list[str] = field(default_factory=list)
    #: log10 steps of the back-off of words whose successors are in several files.
    split: dict[int, int] = field(default_factory=dict)

    @property
    def width(self) -> int:
        return self.vocabulary + 2


def _quantise(p: np.ndarray) -> np.ndarray:
    return np.minimum(65535, np.ceil(-np.log10(np.maximum(p, 1e-31)) * STEPS)).astype(np.uint16)


_VALUES = 10.0 ** (np.arange(65536) / -float(STEPS))


def _value(steps: np.ndarray) -> np.ndarray:
    return _VALUES[steps]


class Trie:
    def __init__(self, model: Model) -> None:
        self.m = model
        self.first = np.cumsum([0, *(n for _, n in model.vocab)])
        self.edges = np.array(model.edges, np.int64)
        self.maps: OrderedDict[str, tuple[dict[str, np.ndarray], int]] = OrderedDict()
        self.mapped = 0

    def _arrays(self, uri: str) -> dict[str, np.ndarray]:
        """A file's arrays; of files used last, MAPPED bytes at most stay mapped."""
        if uri in self.maps:
            self.maps.move_to_end(uri)
            return self.maps[uri][0]
        arrays = map_arrays(uri)
        size = sum(a.nbytes for a in arrays.values())
        self.mapped += size
        self.maps[uri] = arrays, size
        while self.mapped > MAPPED and len(self.maps) > 1:
            self.mapped -= self.maps.popitem(last=False)[1][1]
        return arrays

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, count) of distinct sorted hashes."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        shard = _vocab_shard(hashes, self.m.vocab_bits)
        for s in np.unique(shard):
            uri, n = self.m.vocab[s]
            if n:
                a, b = np.searchsorted(shard, [s, s + 1])
                known = self._arrays(uri)
                at = np.minimum(np.searchsorted(known["hash"], hashes[a:b]), n - 1)
                same = known["hash"][at] == hashes[a:b]
                ids[a:b] = np.where(same, at + self.first[s], -1)
                counts[a:b] = np.where(same, known["count"][at], 0)
        return ids, counts

    def counts_of(self, ids: np.ndarray) -> np.ndarray:
        """Counts of words by id; of the mark before a text's first word, the number of texts."""
        out, shard = np.full(len(ids), self.m.texts, np.int64), np.searchsorted(self.first, ids, "right") - 1
        for s in np.unique(shard[ids < self.m.vocabulary]):
            here = (shard == s) & (ids < self.m.vocabulary)
            out[here] = self._arrays(self.m.vocab[s][0])["count"][ids[here] - self.first[s]]
        return out

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 1) / (self.m.tokens + self.m.vocabulary + 1)

    def score(self, before: np.ndarray, last: np.ndarray, word: np.ndarray, p1: np.ndarray) -> np.ndarray:
        """Probabilities of words (id or -1, unigram ``p1``), in order of their texts, after ``last`` (the mark of a begin,
        or unknown: -1) and ``before`` that (or missing: -1)."""
        width = self.m.width
        known = last >= 0
        ctx = (before >= 0) & known  # the bigram (before, last) is (last, word) of the place before
        code, back = np.unique((last * width + np.where(word >= 0, word, width - 1))[known], return_inverse=True)
        pair = np.full(len(word), -1)
        pair[known] = back
        context = np.where(ctx, np.append(-1, pair[:-1]), -1)
        del back
        asked = np.flatnonzero(ctx)
        tri, tri_back = np.unique(context[asked] * width + np.where(word[asked] >= 0, word[asked], width - 1), return_inverse=True)
        tri_context, tri_word = np.divmod(tri, width)
        q2, off2, off3, q3 = np.zeros(len(code)), np.ones(len(code)), np.ones(len(code)), np.zeros(len(tri))
        ends = np.searchsorted(code, self.edges)
        tri_ends = np.searchsorted(tri_context, ends)
        for s in np.flatnonzero(np.diff(ends)):
            if not self.m.files[s]:
                continue
            a, b, ta, tb = ends[s], ends[s + 1], tri_ends[s], tri_ends[s + 1]
            f = self._arrays(self.m.files[s])
            low = int(f["low"][0])
            first, second = np.divmod(code[a:b], width)
            node = _find(f, "2", first - low, second)
            hit = node >= 0
            q2[a:b][hit] = _value(f["prob2"][node[hit]])
            off2[a:b] = _value(f["backoff2"][first - low])
            off3[a:b][hit] = _value(f["backoff3"][node[hit]])
            if tb > ta:
                own = node[tri_context[ta:tb] - a]
                there = np.flatnonzero(own >= 0)
                found = _find(f, "3", own[there], tri_word[ta:tb][there])
                hit = found >= 0
                q3[ta + there[hit]] = _value(f["prob3"][found[hit]])
        for w, steps in self.m.split.items():  # words in several files: a few very frequent ones
            off2[np.searchsorted(code, w * width) : np.searchsorted(code, (w + 1) * width)] = _VALUES[steps]
        p = p1.copy()
        p[known] = q2[pair[known]] + off2[pair[known]] * p1[known]
        p[asked] = q3[tri_back] + off3[context[asked]] * p[asked]
        return p


def _find(f: dict[str, np.ndarray], level: str, context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Nodes of (context, word), sorted, or -1."""
    pointers, successors = EliasFano(f, f"pointers{level}"), EliasFano(f, f"words{level}")
    node = np.full(len(word), -1, np.int64)
    if not len(word) or not successors.n:
        return node
    heads = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
    size = np.diff(np.append(heads, len(context)))
    begin, end = pointers.get(context[heads]), pointers.get(context[heads] + 1)
    base = np.zeros(len(heads), np.int64)
    base[begin > 0] = successors.get(begin[begin > 0] - 1) + 1
    some = np.flatnonzero(np.repeat(begin < end, size))
    begin, end, base = (np.repeat(x, size)[some] for x in (begin, end, base))
    target = base + word[some]
    at = successors.successor(target, begin, end)
    inside = np.flatnonzero(at < end)
    inside = inside[successors.get(at[inside]) == target[inside]]
    node[some[inside]] = at[inside]
    return node


def _vocab_shard(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> (64 - bits)) + (1 << bits >> 1) if bits else np.zeros(len(hashes), np.int64)


def _stream(batch_text: pa.Array, most: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, document, hash) of runs of texts; each text's words and then END."""
    for first, last, data, offsets in blocks(batch_text, most):
        doc, word = words(data, offsets, SPACED)
        n = last - first
        size = np.bincount(doc, minlength=n) + 1
        hashed = np.full(len(doc) + n, END)
        hashed[np.arange(len(doc)) + doc] = word.view(np.int64)
        yield first, last, np.repeat(np.arange(n), size), hashed


def _counted(parts: Iterator[np.ndarray], most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and counts, in runs of at most about ``most`` keys."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        key, back = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return key, np.bincount(back, np.concatenate([n for _, n in held]), minlength=len(key)).astype(np.int64)

    for keys in parts:
        held.append(np.unique(keys, return_counts=True))
        if sum(len(k) for k, _ in held) > most:
            held = [merged()]
            if len(held[0][0]) > most / 2:
                yield held.pop()
    if held:
        yield merged()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[np.ndarray, np.ndarray, int]]]:
    """Lists of (hashes, which of them begin a text, number of places) with RUN places at most in all; where a text goes
    on behind a list, its next two hashes stand there too."""
    held, size = [], 0
    for batch in batches:
        for _, _, doc, hashed in _stream(batch.column("text")):
            begins = np.append(True, doc[1:] != doc[:-1])
            for at in range(0, len(hashed), RUN // 2):
                upto = min(len(hashed), at + RUN // 2)
                held.append((hashed[at : upto + 2], begins[at : upto + 2], upto - at))
                size += upto - at
                if size > RUN // 2:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def _pack(columns: list[np.ndarray]) -> bytes:
    """Columns of small whole numbers, byte by byte, so that what is alike stands together."""
    raw = b"".join(np.ascontiguousarray(c.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for c in columns)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec=_ZSTD, asbytes=True)


def _unpack(data: bytes) -> np.ndarray:
    raw = pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec=_ZSTD, asbytes=True)
    return np.frombuffer(raw, np.uint8)


def _trigrams(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """shard, data: the counted (first, second, third) word ids of a run that fall into a file, sorted. Each place gives
    one: what stands there, the next word, and the one after; none after a text's end (id width - 1)."""
    trie, width = Trie(model), model.width
    for held in _runs(batches):
        hashes = np.concatenate([h for h, _, _ in held])
        some, local = np.unique(hashes, return_inverse=True)
        ids = trie.ids(some)[0]  # in the order of hashes
        mark, none, m = len(some), len(some) + 1, len(some) + 2
        end, keys, at = int(np.searchsorted(some, END)), [], 0
        for h, begins, n in held:
            here = local[at : at + len(h)]
            at += len(h)
            nxt, after = np.append(here[1:], none)[:n], np.append(here[2:], [none, none])[:n]
            inner = here[:n] != end
            third = np.where(nxt == end, none, after)
            keys.append(((here[:n] * m + nxt) * m + third)[inner])
            starts = np.flatnonzero(begins[:n])  # the mark, the first word, the second
            second = np.where(here[starts] == end, none, nxt[starts])
            keys.append((mark * m + here[starts]) * m + second)
        key = np.concatenate(keys)
        key.sort()
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        count = np.diff(np.append(new, len(key)))
        pair, third = np.divmod(key[new], m)
        first, second = np.divmod(pair, m)
        ids = np.append(ids, [model.vocabulary, width - 1])
        first, second, third = ids[first], ids[second], ids[third]
        cuts = np.searchsorted(first * width + second, trie.edges)
        for s in np.flatnonzero(np.diff(cuts)):
            a, b = cuts[s], cuts[s + 1]
            step = np.diff(first[a:b], prepend=first[a])
            data = first[a].tobytes() + _pack([step, second[a:b], third[a:b], count[a:b]])
            yield pa.record_batch([pa.array([s], pa.int64()), pa.array([data], pa.binary())], names=["shard", "data"])


def _merge(parts: list[bytes]) -> list[np.ndarray]:
    """Distinct (first, second, third) of packed runs, sorted, and the sums of their counts."""
    columns = []
    for data in parts:
        planes = _unpack(data[8:]).reshape(4, 4, -1)
        step, second, third, count = (np.ascontiguousarray(p.T).view("<u4")[:, 0].astype(np.int64) for p in planes)
        columns.append((int.from_bytes(data[:8], "little") + np.cumsum(step), second, third, count))
    first, second, third, count = (np.concatenate(c) for c in zip(*columns, strict=True))
    del columns
    low, span = first.min(), int(max(second.max(), third.max())) + 1
    if (int(first.max() - low) + 1) * span**2 < 2**63:
        key = ((first - low) * span + second) * span + third
        order = np.argsort(key)
        key = key[order]
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        pair, third = np.divmod(key[new], span)
        first, second = np.divmod(pair, span)
        first += low
    else:
        order = np.lexsort((third, second, first))
        first, second, third = first[order], second[order], third[order]
        new = np.flatnonzero(np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1]) | (third[1:] != third[:-1])))
        first, second, third = first[new], second[new], third[new]
    return [first, second, third, np.add.reduceat(count[order], new)]


def _level(begin: np.ndarray, word: np.ndarray, name: str) -> dict[str, np.ndarray]:
    """Pointers and successors of the contexts that begin at ``begin`` (and where the last one ends)."""
    some = np.flatnonzero(np.diff(begin))
    used = np.cumsum(word[begin[some + 1] - 1] + 1)
    word = word + np.repeat(np.append(0, used)[:-1], np.diff(begin)[some])
    return EliasFano.encode(begin, f"pointers{name}") | EliasFano.encode(word, f"words{name}")


def _build(group: pa.Table, model: Model, least: int, discount: float, folder: str) -> pa.Table:
    """Writes the file of one range of bigrams: bigrams by first word, trigrams by bigram."""
    trie, shard = Trie(model), int(group.column("shard")[0].as_py())
    first, second, third, count = _merge(group.column("data").to_pylist())
    new = np.flatnonzero(np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])))
    total = np.add.reduceat(count, new)  # how often each bigram stands there, and is a context if no text ends there
    kept = total >= least
    first, second = first[new], second[new]
    many = (count >= least) & np.repeat(kept, np.diff(np.append(new, len(count)))) & (third < model.width - 1)
    size = np.add.reduceat(many, new, dtype=np.int64)[kept]
    first, second, total = first[kept], second[kept], total[kept]
    third, count = third[many], count[many]
    del many, new
    low, high = int(trie.edges[shard] // model.width), int((trie.edges[shard + 1] - 1) // model.width) + 1
    begin2, begin3 = np.searchsorted(first, np.arange(low, high + 1)), np.append(0, np.cumsum(size))
    contexts = np.arange(low, high)
    occurs = np.maximum(trie.counts_of(contexts), 1)
    # what is taken off each successor, and all of those that were left out, goes to the lower order
    mass2 = np.bincount(first - low, total - discount, minlength=high - low)
    mass3 = np.bincount(np.repeat(np.arange(len(total)), size), count - discount, minlength=len(total))
    arrays = {
        "low": np.array([low]),
        "prob2": _quantise((total - discount) / occurs[first - low]),
        "backoff2": _quantise(np.clip(1 - mass2 / occurs, 0, 1)),
        "prob3": _quantise((count - discount) / np.repeat(total, size)),
        "backoff3": _quantise(np.clip(1 - mass3 / total, 0, 1)),
    }
    arrays["backoff2"][np.diff(begin2) == 0] = 0
    arrays["backoff3"][size == 0] = 0
    arrays |= _level(begin2, second, "2") | _level(begin3, third, "3")
    uri = f"{folder}/ngrams-{shard:06d}-{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}.ef"
    write_arrays(uri, arrays)
    ends = [low, mass2[0], high - 1, mass2[-1]]
    return pa.table({"shard": [shard], "uri": [uri], "bigrams": [len(total)], "trigrams": [len(count)], "head": [ends[0]], "head_mass": [float(ends[1])], "tail": [ends[2]], "tail_mass": [float(ends[3])]})


def _edges(model: Model, heavy: dict[int, int], places_a_file: int) -> list[int]:
    """Where files begin, as first * width + second: ranges of first words, and a heavy first word cut by second words.
    ``heavy``: ids of words (or the mark) that more than ``places_a_file`` places begin with, and how many."""
    width, cuts = model.width, {0, model.width**2}
    ranges = max(1, -(-(model.tokens + model.texts) // places_a_file))
    cuts.update((i * (model.vocabulary + 1) // ranges) * width for i in range(1, ranges))
    for word, n in heavy.items():
        parts = -(-n // places_a_file)
        cuts.update(word * width + i * width // parts for i in range(parts + 1))
    return sorted(cuts)


def train(docs: DataFrame, text: Column, *, least: int = 1, discount: float = 0.7, words_a_file: int = 2_000_000, places_a_file: int = 1_000_000) -> Model:
    """A model of all texts of ``docs``; null is an empty text. Files go to the shared folder.

    Words are known by a 64-bit hash; at most 2**31 distinct words, so that a bigram fits 64 bits. A file has the n-grams
    of about ``places_a_file`` places of texts; a first word of more is cut by its second words, so that only the
    successors of one bigram, as many as there are words at most, meet in one task. Counts are summed before they are
    sent, whatever the corpus repeats.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(text, F.lit("")).alias("text"))
    folder = scratch(spark, "ngram-lm")

    def unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, n in _counted(hashed for batch in batches for *_, hashed in _stream(batch.column("text"))):
            for a in range(0, len(key), 100_000):
                yield pa.record_batch([pa.array(key[a : a + 100_000]), pa.array(n[a : a + 100_000])], names=["key", "n"])

    counted = cut(texts.mapInArrow(unigrams, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "words")
    size = counted.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.when(F.col("key") == int(END), F.col("n"))), F.lit(0)).alias("texts")).first()
    if size["v"] >= 2**31:
        raise ValueError(f"{size['v']} distinct words; keys are for fewer than 2**31")
    bits = max(0, (max(1, -(-size["v"] // words_a_file)) - 1).bit_length())
    shard = (F.shiftright("key", 64 - bits) + (1 << bits >> 1)).cast("int") if bits else F.lit(0)

    def write_words(group: pa.Table) -> pa.Table:
        s, order = group.column("shard")[0].as_py(), np.argsort(group.column("key").to_numpy())
        uri = f"{folder}/words-{s:06d}-{TaskContext.get().taskAttemptId()}.ef"
        write_arrays(uri, {"hash": group.column("key").to_numpy()[order], "count": group.column("n").to_numpy()[order]})
        return pa.table({"shard": pa.array([s], pa.int32()), "uri": [uri], "size": [group.num_rows]})

    files = cut(counted.withColumn("shard", shard).groupBy("shard").applyInArrow(write_words, "shard int, uri string, size long"), "word-files")
    known = {r["shard"]: (r["uri"], r["size"]) for r in files.collect()}  # a row a file
    model = Model(size["tokens"], size["v"], size["texts"], bits, [known.get(s, ("", 0)) for s in range(1 << bits)])
    if not model.tokens:
        return model
    # words that more places begin with than a file holds: fewer than there are files
    often = counted.filter((F.col("n") > places_a_file) & (F.col("key") != int(END))).collect()
    keys = np.sort(np.array([r["key"] for r in often], np.int64))
    of = {r["key"]: r["n"] for r in often}
    heavy = dict(zip(Trie(model).ids(keys)[0].tolist(), [of[k] for k in keys.tolist()], strict=True))
    if model.texts > places_a_file:
        heavy[model.vocabulary] = model.texts
    model.edges = _edges(model, heavy, places_a_file)
    packed = texts.mapInArrow(lambda b: _trigrams(b, model), "shard long, data binary")
    written = packed.groupBy("shard").applyInArrow(lambda g: _build(g, model, least, discount, folder), FILES)
    rows = cut(written, "ngram-files").collect()  # a row a file
    model.files = [""] * (len(model.edges) - 1)
    mass: dict[int, float] = {}
    for r in rows:
        model.files[r["shard"]] = r["uri"]
        for word, part in {r["head"]: r["head_mass"], r["tail"]: r["tail_mass"]}.items():
            mass[word] = mass.get(word, 0.0) + part
    model.split = {w: int(_quantise(np.array([max(0.0, 1 - mass.get(w, 0.0) / n)]))[0]) for w, n in heavy.items()}
    return model


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    trie = Trie(model)
    for batch in batches:
        for first, last, doc, hashed in _stream(batch.column("text"), SCORED):
            some, back = np.unique(hashed, return_inverse=True)
            ids, counts = trie.ids(some)
            known, p1, word = (counts > 0)[back], trie.unigram(counts)[back], ids[back]
            begins = np.append(True, doc[1:] != doc[:-1])
            before = np.append(-1, word[:-1])
            before[begins] = model.vocabulary  # the mark before the first word
            earlier = np.append(-1, before[:-1])
            earlier[begins] = -1
            p = trie.score(earlier, before, word, p1) if model.files else p1
            n = last - first
            totals = (np.bincount(doc, np.log10(x), minlength=n) for x in (p1, p))
            yield pa.record_batch(
                [batch.column("doc_id").slice(first, n), pa.array(np.bincount(doc, minlength=n)), pa.array(np.bincount(doc, known, minlength=n).astype(np.int64)), pa.array(np.full(n, model.tokens)), *map(pa.array, totals)],
                names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )


def score_texts(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, n_known, train_tokens, base_score (add-one unigrams), score (the model), both sums of
    log10 probabilities over the words and the end of the text; null is an empty text, which is its end alone. Rows
    and ids may repeat or be null; other columns are ignored; an empty table gives an empty result, and a model
    without training texts gives every token what add-one smoothing gives an unknown word."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return given.mapInArrow(lambda b: _score(b, held.value), SCORES)
