"""Packing token sequences by patterns that non-negative least squares picks.

Only the histogram of piece lengths (at most ``size`` numbers) goes to the driver. There lengths are put into
coarse bins, all patterns of a few bins that fill a sequence are listed, and non-negative least squares says how
often to use each so that the histogram is used up. The counts are rounded down and filled with true lengths, the
last place of a pattern by best fit; pieces that are left go into open places and new sequences by best fit, again on
the histogram. The plan is a list of (lengths, repeats), as long for any number of documents; pieces find their place
by their rank among the pieces of their length.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, repeated

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PLACED = pa.schema([*PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])

#: How the vocabulary word_bpe_49k splits lower-cased text: a fixed value, its letters and digits spelt out for Latin-1.
_LETTERS = "a-zß-öø-ÿ"
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s0-9{_LETTERS}]+")
#: Texts with other characters than these, or with something like a special token, go to the tokenizer as they are.
_OTHER = re.compile("[^\t\n\r -~À-ÖØ-öø-ÿ]|<\\|")


class WordTokens:
    """The tokenizer's ids of a text as little-endian unsigned 32-bit numbers. Words are looked up in a memory of
    bounded size; a batch's new words are encoded at once."""

    def __init__(self, path: str, remember: int = 400_000) -> None:
        from tokenizers import Tokenizer

        self.tok, self.remember, self.young, self.old = Tokenizer.from_file(path), remember, {}, {}
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        for first in range(0, len(words), 2000):
            some = words[first : first + 2000]
            ids = np.array(self.tok.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(some):
                data, begin = ids.tobytes(), 0
                for word, stop in zip(some, (stops * 4).tolist()):
                    self.young[word] = data[begin:stop]
                    begin = stop
            else:
                self.young.update((w, self._whole(w)) for w in some)

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.young) > self.remember:
            self.old, self.young = self.young, {}
        split = [None if _OTHER.search(t) else _SPLIT.findall(t.lower()) for t in texts]
        young, old, new = self.young, self.old, {}
        for words in split:
            for w in words or ():
                if w not in young:
                    if w in old:
                        young[w] = old[w]
                    else:
                        new[w] = None
        self._learn(list(new))
        get = self.young.__getitem__
        return [self._whole(t) if words is None else b"".join(map(get, words)) for t, words in zip(texts, split, strict=True)]


def _pieces(batches: Iterator[pa.RecordBatch], tokenizer: str, size: int, end: int) -> Iterator[pa.RecordBatch]:
    encode, last = WordTokens(tokenizer), np.array([end], "<u4").tobytes()
    for batch in batches:
        for first in range(0, batch.num_rows, 256):
            part = batch.slice(first, 256)
            rows = []
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), encode([t or "" for t in part.column("text").to_pylist()]), strict=True):
                ids += last
                for n, at in enumerate(range(0, len(ids), 4 * size)):
                    one = ids[at : at + 4 * size]
                    rows.append((doc_id, n, at // 4, len(one) // 4, zlib.crc32(one)))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), PIECES.types, strict=True)], schema=PIECES)


def token_pieces(docs: DataFrame, *, tokenizer: str, size: int = 4096, end: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and then ``end``, cut where longer than ``size``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda b: _pieces(b, tokenizer, size, end), "doc_id long, piece int, start long, length long, ids_crc32 long")


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 that makes |a x - b| least, by an active set: the column that promises most comes in, columns that would
    turn negative go out."""
    x, on = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[on] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= 1e-9 * max(1.0, float(np.abs(b).max())):
            break
        on[best] = True
        while True:
            z = np.zeros_like(x)
            z[on] = np.linalg.lstsq(a[:, on], b, rcond=None)[0]
            low = on & (z <= 0)
            if not low.any():
                break
            step = float(np.min(x[low] / np.maximum(x[low] - z[low], 1e-300)))
            x += step * (z - x)
            on &= x > 1e-12
            x[~on] = 0
        x = z
    return x


def bin_patterns(bins: list[int], total: int, most: int) -> Iterator[tuple[int, ...]]:
    """Falling tuples of at most ``most`` of ``bins`` that sum to ``total``."""

    def grow(head: tuple[int, ...], left: int, parts: int) -> Iterator[tuple[int, ...]]:
        if not left:
            yield head
        elif parts:
            for b in bins:
                if b <= left and (not head or b <= head[-1]) and b * parts >= left:
                    yield from grow((*head, b), left - b, parts - 1)

    return grow((), total, most)


class _Stock:
    """How many pieces of each length are left, with the lengths that are, in order."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.n = {k: v for k, v in counts.items() if v}
        self.lengths = sorted(self.n)

    def at_most(self, length: int) -> int:
        i = bisect_left(self.lengths, length + 1)
        return self.lengths[i - 1] if i else 0

    def take(self, length: int, n: int) -> None:
        self.n[length] -= n
        if not self.n[length]:
            del self.n[length]
            self.lengths.pop(bisect_left(self.lengths, length))


def pack_plan(counts: dict[int, int], size: int = 4096, unit: int = 64, places: int = 4, most_patterns: int = 20_000) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of the pieces of a sequence, how many such sequences): all pieces, none twice."""
    stock = _Stock(counts)
    done: list[tuple[tuple[int, ...], int]] = []
    if size in stock.n:
        done.append(((size,), stock.n[size]))
        stock.take(size, stock.n[size])
    binned: dict[int, int] = {}
    for length, n in stock.n.items():
        binned[-(-length // unit)] = binned.get(-(-length // unit), 0) + n
    bins = sorted(binned, reverse=True)
    patterns = list(islice(bin_patterns(bins, -(-size // unit), places), most_patterns))
    open_: list[tuple[int, tuple[int, ...], int]] = []  # (space, lengths, sequences)
    if patterns:
        row = {b: i for i, b in enumerate(bins)}
        a = np.zeros((len(bins), len(patterns)))
        for j, p in enumerate(patterns):
            for b in p:
                a[row[b], j] += 1
        want = np.array([binned[b] for b in bins], float)
        weight = 1 / np.sqrt(np.maximum(want, 1))[:, None]
        times = np.floor(nnls(a * weight, want * weight[:, 0]) + 1e-6).astype(np.int64)
        for j in np.argsort(-times, kind="stable"):
            left = int(times[j])
            while left > 0:
                head: tuple[int, ...] = ()
                for b in patterns[j][:-1]:
                    # the longest of the bin that still fits; a length asked for twice needs two pieces
                    length = stock.at_most(min(b * unit, size - sum(head)))
                    while length > (b - 1) * unit and stock.n[length] <= head.count(length):
                        length = stock.at_most(length - 1)
                    if length <= (b - 1) * unit:
                        break
                    head += (length,)
                if len(head) < len(patterns[j]) - 1:
                    break
                tail = stock.at_most(size - sum(head))
                while tail and stock.n[tail] <= head.count(tail):
                    tail = stock.at_most(tail - 1)
                if not tail:
                    break
                pattern = (*head, tail)
                run = min(left, *(stock.n[x] // pattern.count(x) for x in set(pattern)))
                for x in pattern:
                    stock.take(x, run)
                left -= run
                open_.append((size - sum(pattern), pattern, run))
    return done + _best_fit(stock, open_, size)


def _best_fit(stock: _Stock, open_: list[tuple[int, tuple[int, ...], int]], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest pieces first, each into the fullest open sequences that have room; runs of alike ones at once."""
    spaces: list[int] = []
    at: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def add(space: int, pattern: tuple[int, ...], n: int) -> None:
        if space not in at:
            insort(spaces, space)
            at[space] = []
        at[space].append((pattern, n))

    for space, pattern, n in open_:
        add(space, pattern, n)
    for length in reversed(stock.lengths):
        n = stock.n[length]
        while n:
            i = bisect_left(spaces, length)
            if i < len(spaces):
                space = spaces[i]
                pattern, many = at[space].pop()
                if many > n:
                    at[space].append((pattern, many - n))
                if not at[space]:
                    del at[space]
                    spaces.pop(i)
                run = min(n, many)
                add(space - length, (*pattern, length), run)
                n -= run
            else:
                each = size // length
                if n >= each:
                    add(size - each * length, (length,) * each, n // each)
                if n % each:
                    add(size - n % each * length, (length,) * (n % each), 1)
                n = 0
    return [(pattern, n) for group in at.values() for pattern, n in group]


def plan_slots(plan: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each place of a pattern: the ranks among pieces of its length that go there, its first sequence, offset."""
    used: dict[int, int] = {}
    rows, first = [], 0
    for pattern, n in plan:
        offset = 0
        for length in pattern:
            rows.append((length, used.get(length, 0), first, offset))
            used[length] = used.get(length, 0) + n
            offset += length
        first += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"key": (table[:, 0] << 44) + table[:, 1], "rank": table[:, 1], "first": table[:, 2], "offset": table[:, 3]}


def _place(batches: Iterator[pa.RecordBatch], slots: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
        i = np.searchsorted(slots["key"], (length << 44) + rank, "right") - 1
        kept = [batch.column(f.name) for f in PIECES]
        yield pa.record_batch([*kept, pa.array(slots["first"][i] + rank - slots["rank"][i]), pa.array(slots["offset"][i])], schema=PLACED)


def pack_documents(docs: DataFrame, *, tokenizer: str, size: int = 4096, end: int = 1, rows_per_part: int = 20_000, least_parts: int = 64) -> DataFrame:
    """Per piece of a document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Sequences hold at most ``size`` tokens; pieces stand in them without gaps. Null and empty texts are the end
    token alone. Rows of one doc_id are documents of their own; null ids stay null. Columns besides doc_id and text
    are ignored; an empty table gives an empty result. Pieces alike in all columns are counted before they are ranked,
    and get places one after the other.
    """
    pieces = token_pieces(docs, tokenizer=tokenizer, size=size, end=end)
    pieces = cut(pieces.groupBy(*PIECES.names).agg(F.count("*").alias("copies")), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.sum("copies").alias("n")).collect()}  # at most ``size`` rows
    slots = docs.sparkSession.sparkContext.broadcast(plan_slots(pack_plan(counts, size)))
    parts = max(least_parts, sum(counts.values()) // rows_per_part)
    dealt = pieces.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    sizes = dealt.groupBy("length", "_part").agg(F.sum("copies").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("length", "_part", before.alias("_before"))
    earlier = Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "ids_crc32", "start").rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum("copies").over(earlier), F.lit(0))
    first = dealt.withColumn("_own", own).join(sizes, ["length", "_part"]).select(*PIECES.names, "copies", (F.col("_before") + F.col("_own")).alias("_first"))
    ranked = repeated(first, "copies", "_no").withColumn("rank", F.col("_first") + F.col("_no"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select(*PIECES.names, "rank").mapInArrow(lambda b: _place(b, slots.value), schema)
