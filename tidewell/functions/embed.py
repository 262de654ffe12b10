"""Texts to vectors: any model as a column function, and a small one that needs no files."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

#: A model: texts to a matrix with a row for each.
Model = Callable[[list[str]], np.ndarray]


def embedder(load: Callable[[], Model], rows: int = 256) -> Callable[[Column], Column]:
    """A column function text -> array<float>. ``load`` runs once for each task, in the worker, so a model of any size is not
    sent with the plan; the model gets up to ``rows`` texts at once. A null text has no vector."""

    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for part in parts:
            at = np.flatnonzero(part.notna().to_numpy())
            out = np.full(len(part), None, object)
            for i in range(0, len(at), rows):
                some = at[i : i + rows]
                for k, vector in zip(some, np.asarray(model(part.iloc[some].tolist()), np.float32), strict=True):
                    out[k] = vector
            yield pd.Series(out)

    return F.pandas_udf(embed, "array<float>")


def with_vectors(df: DataFrame, load: Callable[[], Model], text: str = "text", out: str = "embedding", rows: int = 256) -> DataFrame:
    """``df`` with the vector of column ``text`` as ``out``; otherwise as `embedder`, for large tables. A column function's
    rows wait, with all that its text was made of (a document's words, for each chunk), in a queue that goes to disk, and
    a filter of its vectors makes them twice. Here only the columns of ``df`` pass through the worker, once."""
    names, schema = df.columns, StructType([*df.schema.fields, StructField(out, ArrayType(FloatType()))])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for b in batches:
            for i in range(0, b.num_rows, rows):
                part = b.slice(i, rows)
                texts = part.column(names.index(text)).to_pylist()
                some = [t for t in texts if t is not None]
                made = iter(np.asarray(model(some), np.float32) if some else ())
                vectors = pa.array([None if t is None else next(made) for t in texts], pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*part.columns, vectors], [*names, out])

    return df.mapInArrow(go, schema)


def hashed_trigrams(dims: int = 64) -> Model:
    """Counts of the trigrams of the lower-cased text between blanks, each added to or taken from one of ``dims`` places by
    its crc32; vectors of length 1 (0 for an empty text)."""

    def model(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims))
        # code points of all texts, one after the other; a trigram is known by three of them
        low = [f" {' '.join(text.lower().split())} " for text in texts]
        codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        if len(codes) > 2:
            ends = np.cumsum([len(t) for t in low])
            own = np.repeat(np.arange(len(low)), [len(t) for t in low])
            at = np.flatnonzero(np.arange(len(codes)) + 2 < ends[own])
            grams, which = np.unique(codes[at] << 42 | codes[at + 1] << 21 | codes[at + 2], return_inverse=True)
            h = np.array([zlib.crc32("".join(map(chr, (g >> 42, g >> 21 & 0x1FFFFF, g & 0x1FFFFF))).encode()) for g in grams.tolist()], np.int64)
            if len(h):
                np.add.at(out, (own[at], (h % dims)[which]), np.where(h & 1 << 20, 1.0, -1.0)[which])
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    return model
