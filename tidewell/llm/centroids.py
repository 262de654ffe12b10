"""Lloyd's clustering in whole numbers, with ns-bounds.

A vector keeps its exact distance to its own centroid and, for each group of centroids, a lower bound of its distance to
the nearest other one there, each with the round in which it was measured. All rounds' centroids are retained: a bound
is loosened by how far a centroid is now from where it was in that round (the norm of the whole displacement, for a group
the largest), not by the sum of its moves since, which is never smaller. Only a group whose bound no longer clears the
own distance is measured again, in whole numbers, so the result is that of a full search with ties to the smaller number.

Vectors and bounds are rows of a table that each round writes anew to the shared folder; a task hands on one row of sums
for each centroid, and only vectors that changed their centroid are summed (added to the new one, taken from the old).
The driver holds the centroids of all rounds and nothing that grows with the vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

#: Centroids that share a lower bound.
GROUP = 8
#: Relative slack of bounds, far above the rounding of their square roots.
SLACK = 1e-9
STATE = "vec_id {id}, v array<int>, was int, cluster int, own long, own_round int, low binary, low_round binary"


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows in whole numbers; by floating-point units where no sum can pass 2**53."""
    top = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))
    if 4 * x.shape[1] * float(top) ** 2 < 2**53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], 1) if len(c) else np.zeros((len(x), 0), np.int64)


def assign(x: np.ndarray, history: np.ndarray, cluster: np.ndarray, own: np.ndarray, own_round: np.ndarray, low: np.ndarray, low_round: np.ndarray) -> int:
    """Brings ``cluster`` and the bounds, all changed in place, to the last round of ``history`` (rounds, centroids,
    components). Returns how many distances it measured."""
    now, groups = len(history) - 1, low.shape[1]
    moved = np.sqrt(((history[-1] - history).astype(np.float64) ** 2).sum(2)) * (1 + SLACK)
    moved_group = np.stack([moved[:, g * GROUP : (g + 1) * GROUP].max(1) for g in range(groups)], 1)
    upper = np.sqrt(own.astype(np.float64)) * (1 + SLACK) + moved[own_round, cluster]
    lower = low - moved_group[low_round, np.arange(groups)]
    lower -= SLACK * np.where(np.isfinite(lower), np.abs(lower), 0)
    unsure = np.flatnonzero((lower <= upper[:, None]).any(1))
    if not len(unsure):
        return 0
    old = cluster[unsure].copy()
    step = x[unsure] - history[-1][old]
    own[unsure], own_round[unsure] = (step * step).sum(1), now
    upper = np.sqrt(own[unsure].astype(np.float64)) * (1 + SLACK)
    failing, measured = lower[unsure] <= upper[:, None], len(unsure)
    best, best_at = own[unsure].copy(), old.copy()
    told = {}
    for g in range(groups):
        at = np.flatnonzero(failing[:, g])
        if not len(at):
            continue
        first = g * GROUP
        d = distances(x[unsure[at]], history[-1][first : first + GROUP])
        measured += d.size
        nearest = d.argmin(1)
        least = d[np.arange(len(at)), nearest]
        better = (least < best[at]) | (least == best[at]) & (first + nearest < best_at[at])
        best[at[better]], best_at[at[better]] = least[better], first + nearest[better]
        told[g] = at, d
    cluster[unsure], own[unsure] = best_at, best
    for g, (at, d) in told.items():  # the nearest of each group but the centroid taken
        mine = best_at[at] - g * GROUP
        inside = (mine >= 0) & (mine < d.shape[1])
        rest = d.astype(np.float64)
        rest[np.flatnonzero(inside), mine[inside]] = np.inf
        low[unsure[at], g] = np.nextafter(np.sqrt(rest.min(1)).astype(np.float32), np.float32(-np.inf))
        low_round[unsure[at], g] = now
    # the centroid left is now one of the others of its group
    gone = np.flatnonzero((best_at != old) & ~failing[np.arange(len(old)), old // GROUP])
    if len(gone):
        i, g = unsure[gone], old[gone] // GROUP
        step = x[i] - history[-1][old[gone]]
        left = np.sqrt((step * step).sum(1).astype(np.float64)) * (1 - SLACK)
        low[i, g] = np.nextafter(np.minimum(lower[i, g], left).astype(np.float32), np.float32(-np.inf))
        low_round[i, g] = now
    return measured


def _column(batch: pa.RecordBatch, name: str, kind, width: int) -> np.ndarray:
    """A copy of a column of equally long binaries or lists as a matrix."""
    col = batch.column(name)
    if pa.types.is_binary(col.type):
        return np.frombuffer(b"".join(col.to_pylist()), kind).reshape(-1, width).copy()
    return col.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def cluster_vectors(vectors: DataFrame, k: int = 40, rounds: int = 5, *, dims: int = 64, scale: int = 256, salt: str = "2:", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector of ``dims`` components, none of
    them null or non-finite, as whole numbers ``floor(scale * x)``; other rows take no part.

    The first centroids are the ``k`` vectors (all, if fewer) whose ids after ``salt`` have the smallest SHA-256, in that
    order (rows of one id: by their components; a null id counts as an empty text). Rows alike take part each. An empty
    table gives an empty result. Vectors so large that a squared distance might not fit 64 bits are an error before the
    first round. Other columns are ignored.
    """
    spark, x = vectors.sparkSession, F.col(vector_col)
    good = x.isNotNull() & (F.size(x) == dims) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    whole = vectors.filter(good).select(F.col(id_col).alias("vec_id"), x.alias("x"))
    kind = whole.schema["vec_id"].dataType.simpleString()
    top = whole.agg(F.max(F.array_max(F.transform("x", lambda v: F.abs(v.cast("double") * scale)))).alias("top")).first()["top"]
    if dims * (2 * float(top or 0) + 2) ** 2 >= 2**63:
        raise ValueError(f"squared distances of {dims} components up to {top:.4g} don't fit 64 bits; take a smaller scale")
    points = cut(whole.select("vec_id", F.transform("x", lambda v: F.floor(v.cast("double") * scale).cast("int")).alias("v")), "points")
    name = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    chosen = points.orderBy(name, "v").limit(k).collect()
    k = len(chosen)
    out = "vec_id {id}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string".format(id=kind)
    if not k:
        return spark.createDataFrame([], out)
    history = np.array([[r["v"] for r in chosen]], np.int64)
    groups = -(-k // GROUP)
    schema, sums = STATE.format(id=kind), np.zeros((k, dims + 1), object)
    state = points.selectExpr("vec_id", "v", "-1 AS was", "-1 AS cluster", "0L AS own", "0 AS own_round", "CAST(NULL AS BINARY) AS low", "CAST(NULL AS BINARY) AS low_round")
    for now in range(rounds + 1):
        held = spark.sparkContext.broadcast(history)

        def go(batches: Iterator[pa.RecordBatch], held=held, now=now, last=now == rounds) -> Iterator[pa.RecordBatch]:
            for b in batches:
                n, all_rounds = b.num_rows, held.value
                v, was = _column(b, "v", np.int64, dims), b.column("cluster").to_numpy()
                if now:
                    cluster, own, own_round = (b.column(c).to_numpy().copy() for c in ("cluster", "own", "own_round"))
                    low, low_round = _column(b, "low", np.float32, groups), _column(b, "low_round", np.uint8, groups)
                else:
                    cluster, own, own_round = np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int32)
                    low, low_round = np.full((n, groups), -np.inf, np.float32), np.zeros((n, groups), np.uint8)
                assign(v, all_rounds, cluster, own, own_round, low, low_round)
                if last:  # distances of vectors that the bounds passed over
                    own[:] = ((v - all_rounds[-1][cluster]) ** 2).sum(1)
                binary = lambda m: pa.array([row.tobytes() for row in m], pa.binary())
                cols = [b.column("vec_id"), b.column("v"), pa.array(was, pa.int32()), pa.array(cluster, pa.int32()), pa.array(own, pa.int64()), pa.array(own_round, pa.int32()), binary(low), binary(low_round)]
                yield pa.RecordBatch.from_arrays(cols, ["vec_id", "v", "was", "cluster", "own", "own_round", "low", "low_round"])

        state = cut(state.mapInArrow(go, schema), f"clusters-{now}")
        if now == rounds:
            break

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k, dims + 1), np.int64)
            for b in batches:
                v = np.concatenate([_column(b, "v", np.int64, dims), np.ones((b.num_rows, 1), np.int64)], 1)
                new, old = b.column("cluster").to_numpy(), b.column("was").to_numpy()
                np.add.at(total, new, v)
                np.subtract.at(total, old[old >= 0], v[old >= 0])
            yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(total.tolist(), pa.list_(pa.int64()))], ["cluster", "parts"])

        moved = state.filter("cluster <> was").select("cluster", "was", "v").mapInArrow(add, "cluster int, parts array<long>")
        parts = moved.select("cluster", F.posexplode("parts").alias("at", "part")).groupBy("cluster", "at").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("part"))
        for r in parts.collect():  # centroids times components
            sums[r["cluster"], r["at"]] += int(r["part"])
        following = [[int(s) // int(row[-1]) for s in row[:-1]] if row[-1] else list(history[-1][j]) for j, row in enumerate(sums)]
        history = np.concatenate([history, np.array([following], np.int64)])
    inertia = {r["cluster"]: r["s"] for r in state.groupBy("cluster").agg(F.sum("own").alias("s")).collect()}
    total = sum(inertia.values())
    told = [(j, s, total, hashlib.sha256(",".join(map(str, history[-1][j])).encode()).hexdigest()) for j, s in inertia.items()]
    told = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    rows = state.select("vec_id", "cluster", F.col("own").alias("distance"))
    return rows.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
