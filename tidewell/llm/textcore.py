"""Words, word hashes and shingle hashes of a batch of texts, as whole-array numpy work on Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text that are worked on at once; a longer text is a batch of its own.
BLOCK_BYTES = 1 << 20
#: Base of word hashes and its inverse modulo 2**64; tables of their powers are kept for so many bytes of text.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
TABLE_BYTES = 6 << 20


def _table(word: np.ndarray) -> np.ndarray:
    lut = np.where(word, np.arange(256), -1).astype(np.int16)
    lut[65:91] = np.where(word[97:123], np.arange(97, 123), -1)
    return lut


_code = np.arange(256)
#: Letters, digits and all non-ASCII bytes make words, A-Z lower-cased: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of lower-cased text.
WORDS = _table((_code >= 48) & (_code < 58) | (_code >= 97) & (_code < 123) | (_code >= 128))
#: All but ASCII white space makes words, A-Z lower-cased: [^\x20\x09-\x0D]+ of lower-cased text.
SPACED = _table((_code != 32) & ((_code < 9) | (_code > 13)))


def blocks(texts: pa.Array, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last + 1, UTF-8 bytes, offsets) of runs of texts; null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + block_bytes, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """Steele and others' 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_powers = {}


def powers(base: int, n: int) -> np.ndarray:
    if len(_powers.get(base, ())) < n:
        factors = np.full(max(n, 64), base, U)
        factors[0] = 1
        _powers[base] = np.cumprod(factors, dtype=U)
    return _powers[base][:n]


def words(data: np.ndarray, offsets: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document of each word, hash of each word), in order of the text."""
    cls = lut[data]
    on = cls >= 0
    starts_, stops_ = on.copy(), on.copy()
    starts_[1:] &= ~on[:-1]
    stops_[:-1] &= ~on[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(on))]
    starts_[cuts], stops_[cuts - 1] = on[cuts], on[cuts - 1]
    starts = np.flatnonzero(starts_)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, U)
    ends = np.flatnonzero(stops_) + 1
    sizes = ends - starts
    if len(data) <= TABLE_BYTES:
        # sums over words from a running sum; a word's first place is taken out by the inverse of the base
        total = np.zeros(len(data) + 1, U)
        np.multiply((cls + 1).astype(U), powers(BASE, len(data)), out=total[1:])
        np.cumsum(total[1:], out=total[1:])
        code = (total[ends] - total[starts]) * powers(INVERSE, len(data))[starts]
    else:
        first = np.cumsum(sizes) - sizes
        place = np.arange(first[-1] + sizes[-1]) - np.repeat(first, sizes)
        code = np.add.reduceat((cls[on] + 1).astype(U) * powers(BASE, int(sizes.max()))[place], first)
    hashed = mix(code + sizes.astype(U) * U(0xD6E8FEB86659FD93))
    return np.searchsorted(offsets, starts, "right") - 1, hashed


def shingles(doc: np.ndarray, word: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each run of ``k`` words; a document of fewer words, but not none, is one shingle."""
    if not len(doc):
        return doc, word
    at, count = np.unique(doc, return_index=True, return_counts=True)[1:]
    weight = powers(0xC2B2AE3D27D4EB4F, max(k, 2))
    total = np.zeros(max(0, len(word) - k + 1), U)
    for j in range(k):
        total += word[j : len(word) - k + 1 + j] * weight[j] if len(total) else 0
    full = doc[: len(total)] == doc[k - 1 :] if len(total) else np.zeros(0, bool)
    few = np.flatnonzero(count < k)
    out_doc, out_hash = doc[: len(total)][full], mix(total[full])
    if len(few):
        short = np.zeros(len(few), U)
        for j in range(k - 1):
            has = count[few] > j
            short[has] += word[at[few[has]] + j] * weight[j]
        out_doc = np.concatenate([out_doc, doc[at[few]]])
        out_hash = np.concatenate([out_hash, mix(short + count[few].astype(U) * U(0xA0761D6478BD642F))])
        order = np.argsort(out_doc, kind="stable")
        out_doc, out_hash = out_doc[order], out_hash[order]
    return out_doc, out_hash
