"""Quality by the votes of nearest labelled neighbours in a latent-semantic space.

Terms of a text are hashed byte trigrams, how long it is, and how often words come again. A bounded sample of
labelled rows gives the terms' weights and a truncated SVD; its documents, as unit vectors in that space, go to
all tasks. Every document is then compared with all of them in blocks (a matrix product), and its nearest ones vote
with a power of their cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textcore import SPACED, U, blocks, mix, words

TRIGRAMS, LENGTHS, STEPS = 4096, 32, 16
#: Pseudo-terms: length, and shares (in STEPS steps) of words that are the one before, of distinct words, of upper-case, of punctuation.
SHARES = 4
TERMS = TRIGRAMS + LENGTHS + SHARES * STEPS
_code = np.arange(256)
_UPPER = (_code >= 65) & (_code < 91)
_MARKS = (_code >= 33) & (_code < 48) | (_code >= 58) & (_code < 65) | (_code >= 91) & (_code < 97) | (_code >= 123) & (_code < 127)


def term_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, TERMS) term frequencies, as 1 + log; pseudo-terms weigh like a frequent term."""
    n, size = len(offsets) - 1, np.diff(offsets)
    out = np.zeros((n, TERMS), np.float32)
    if len(data) > 2:
        code = (data[:-2].astype(np.uint32) << 16) | (data[1:-1].astype(np.uint32) << 8) | data[2:]
        owner = np.repeat(np.arange(n), size)
        inside = owner[:-2] == owner[2:]
        term = ((code * np.uint32(0x9E3779B1)) >> np.uint32(20)).astype(np.int64)
        for first in range(0, n, 64):  # bounded memory
            a, b = np.searchsorted(owner, [first, first + 64])
            b = min(b, len(term))
            flat = (owner[a:b] - first) * TRIGRAMS + term[a:b]
            part = np.bincount(flat[inside[a:b]], minlength=64 * TRIGRAMS).reshape(64, TRIGRAMS)
            out[first : first + 64, :TRIGRAMS] = np.log1p(part[: min(64, n - first)])
    doc, word = words(data, offsets, SPACED)
    count = np.maximum(np.bincount(doc, minlength=n), 1)
    again = np.bincount(doc[1:][(word[1:] == word[:-1]) & (doc[1:] == doc[:-1])], minlength=n)
    order = np.lexsort((word, doc))
    new = np.ones(len(order), bool)
    new[1:] = (word[order][1:] != word[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    distinct = np.bincount(doc[order][new], minlength=n)
    total = np.concatenate([[0], np.cumsum(_UPPER[data])]), np.concatenate([[0], np.cumsum(_MARKS[data])])
    chars = np.maximum(size, 1)
    # distinct words against what a text of that length has: n words have about n**0.85 distinct ones
    shares = [again / count, distinct / count**0.85, *((t[offsets[1:]] - t[offsets[:-1]]) / chars for t in total)]
    at = np.arange(n)
    out[at, TRIGRAMS + np.minimum(LENGTHS - 1, np.log2(1 + size).astype(int))] = 1
    for i, share in enumerate(shares):
        out[at, TRIGRAMS + LENGTHS + i * STEPS + np.minimum(STEPS - 1, (np.sqrt(share) * STEPS).astype(int))] = 4
    return out


def fit(rows: np.ndarray, labels: np.ndarray, dims: int, seed: int = 1) -> dict[str, np.ndarray]:
    """Weights of terms, projection and unit vectors of the labelled rows, by a randomised SVD; ``rows`` is used up."""
    weight = np.log((1 + len(rows)) / (1 + np.count_nonzero(rows, axis=0))).astype(np.float32) + 1
    x = rows
    x *= weight
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)[:, None]
    mean = x.mean(0)
    x -= mean
    rank = max(1, min(dims, len(rows), rows.shape[1]))
    q = x.T @ np.random.default_rng(seed).standard_normal((len(x), rank + 16)).astype(np.float32)
    for _ in range(4):
        q = np.linalg.qr(x.T @ (x @ np.linalg.qr(q)[0]))[0]
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    projection = (q @ vt[:rank].T).astype(np.float32)
    return {"weight": weight, "mean": mean, "projection": projection, "vectors": _unit(x @ projection), "labels": labels.astype(np.float32)}


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def embed(model: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
    x = rows * model["weight"]
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    return _unit((x - model["mean"]) @ model["projection"])


def vote(model: dict[str, np.ndarray], vectors: np.ndarray, k: int, power: float) -> np.ndarray:
    """Share of label 1 among the k nearest, by cosine (at least 0) to a power; evened towards 0.5 by one vote of
    that weight at the k-th place, so that no neighbour at all gives 0.5."""
    k = min(k, len(model["labels"]))
    if not k:
        return np.full(len(vectors), 0.5)
    cosine = vectors @ model["vectors"].T
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** power
    return (0.5e-6 + (weight * model["labels"][near]).sum(1)) / (1e-6 + weight.sum(1))


def _batches(texts: pa.Array) -> Iterator[np.ndarray]:
    for first in range(0, len(texts), 256):
        for _, _, data, offsets in blocks(texts.slice(first, 256)):
            yield term_rows(data, offsets)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """label and the positions and values of a row that are not 0."""
    for batch in batches:
        packed = []
        for rows in _batches(batch.column("text")):
            for row in rows:
                at = np.flatnonzero(row)
                packed.append(at.astype(np.uint16).tobytes() + row[at].astype(np.float16).tobytes())
        yield pa.record_batch([batch.column("label"), pa.array(packed, pa.binary())], names=["label", "terms"])


def fit_quality(docs: DataFrame, labels: DataFrame, train: Column, *, max_rows: dict[int, int] | None = None, dims: int = 64, seed: int = 1) -> dict[str, np.ndarray]:
    """A model from ``labels`` (doc_id, quality) and the texts of ``docs`` (doc_id, text).

    The sample is bounded: for each label at most ``max_rows`` of the rows for which ``train`` (on doc_id) holds,
    those first by a hash of their id. Ids that are null, or labels that are null or without document, teach
    nothing; an id with several labels has the smallest; of a document that is given several times the text that is first
    by its hash is learnt from. Of neighbours with the same similarity at the k-th place the vote takes any, always the
    same ones for one model. Without any label the model says 0.5.
    """
    bound = max_rows or {0: 1500, 1: 4500}
    known = labels.filter(train & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("label"))
    ids = None
    for label, most in bound.items():
        some = known.filter(F.col("label") == label).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(most)
        ids = some if ids is None else ids.unionByName(some)
    # of rows of one id the text that comes first by its hash teaches, so the sample has a row an id at most
    taught = docs.select("doc_id", "text").join(F.broadcast(ids.dropDuplicates(["doc_id"])), "doc_id")
    taught = taught.groupBy("doc_id").agg(F.first("label").alias("label"), F.min_by("text", F.xxhash64("text")).alias("text")).select("label", "text")
    rows = taught.mapInArrow(_terms, "label int, terms binary").collect()
    rows = sorted(((r["label"], bytes(r["terms"])) for r in rows), key=lambda r: r)
    x = np.zeros((len(rows), TERMS), np.float32)
    for i, (_, packed) in enumerate(rows):
        n = len(packed) // 4
        x[i, np.frombuffer(packed, np.uint16, n)] = np.frombuffer(packed, np.float16, n, 2 * n)
    if not len(rows):
        empty = np.zeros((0, 1), np.float32)
        return {"weight": np.ones(TERMS, np.float32), "mean": np.zeros(TERMS, np.float32), "projection": np.zeros((TERMS, 1), np.float32), "vectors": empty, "labels": np.zeros(0, np.float32)}
    return fit(x, np.array([r[0] for r in rows]), dims, seed)


def quality_score(docs: DataFrame, model: dict[str, np.ndarray], text: str = "text", *, k: int = 15, power: float = 8.0) -> Column:
    """Score between 0 and 1 of each whole text, for use on ``docs``; null is an empty text, and an empty text is
    scored by its length like others."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(texts: pa.Array) -> pa.Array:
        out = [vote(held.value, embed(held.value, rows), k, power) for rows in _batches(texts)]
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return F.arrow_udf(score, "double")(F.col(text))
