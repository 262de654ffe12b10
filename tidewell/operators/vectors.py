"""Nearest vectors: exact, by products of packed matrices, and by inverted lists under trained centroids.

Vectors are packed into blocks (a list of ids and one matrix) in the tasks that read them. A pair of a block of questions
and a block of vectors is one matrix product, of which the best n of each question are kept; `top_by` merges them. A
vector that is null, has a null or non-finite component, or another length than the question's, is compared with none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import cut
from ..sources import versions as V
from .sizes import MOST, is_small
from .tops import top_by

#: Vectors and questions of a block; questions of which the distances to a block are held at once.
VECTORS, QUESTIONS, TILE = 4096, 2048, 64
#: Bytes of vectors that wait in a task for their blocks to fill; beyond, blocks go on as they are.
WAITING = 32 << 20
#: Bytes of question vectors up to which they are sent to all tasks.
BROADCAST = 64 << 20
#: The inverted lists: rows that train (about) for each list, most lists, rounds of training, rows that measure recall.
TRAIN, LISTS, ROUNDS, PROBES = 64, 1024, 8, 128


def _good(df: DataFrame, vec: str) -> DataFrame:
    x = F.col(vec)
    return df.filter(x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf"))))


def packed(df: DataFrame, key: str, vec: str, rows: int, ids: str, matrix: str, keep: str | None = None) -> DataFrame:
    """``keep``, ``ids`` (array of ``key``), dim, ``matrix`` (float64 rows): blocks of up to ``rows`` vectors of one length, and
    of one value of ``keep`` (int) if it is given, packed where they are read. A task holds `WAITING` bytes of them, however
    many values of ``keep`` it meets."""
    kind = df.schema[key].dataType.simpleString()
    own = [F.col(keep)] if keep else [F.lit(0).alias("_keep")]
    df = _good(df, vec).select(*own, F.col(key).alias("_id"), F.col(vec).cast("array<double>").alias("_v"))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        waiting = 0

        def out(group: tuple[int, int]) -> pa.RecordBatch:
            parts = held.pop(group)
            names = pa.concat_arrays([p[0] for p in parts])
            lists = pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names)
            data = np.concatenate([p[1] for p in parts]).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([group[0]], pa.int32()), lists, pa.array([group[1]], pa.int32()), pa.array([data], pa.binary())], ["_keep", ids, "dim", matrix])

        for b in batches:
            v, group = b.column("_v"), b.column(0).to_numpy(zero_copy_only=False)
            dims = np.diff(v.offsets.to_numpy())
            for k, d in np.unique(np.stack([group, dims], 1), axis=0) if len(dims) else ():
                at = np.flatnonzero((group == k) & (dims == d))
                for first in range(0, len(at), rows):
                    some = pa.array(at[first : first + rows])
                    m = v.take(some).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                    parts = held.setdefault((int(k), int(d)), [])
                    parts.append((b.column("_id").take(some), m))
                    waiting += m.nbytes
                    if sum(len(p[0]) for p in parts) >= rows:
                        waiting -= sum(p[1].nbytes for p in parts)
                        yield out((int(k), int(d)))
                    if waiting > WAITING:
                        waiting = 0
                        for full in list(held):
                            yield out(full)
        for group in list(held):
            yield out(group)

    return df.mapInArrow(go, f"_keep int, {ids} array<{kind}>, dim int, {matrix} binary").withColumnRenamed("_keep", keep or "_keep")


def _distances(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    dot = q @ x.T
    if metric == "l2":
        return np.maximum((q * q).sum(1)[:, None] - 2 * dot + (x * x).sum(1), 0)
    with np.errstate(invalid="ignore", divide="ignore"):
        return 1 - dot / np.sqrt((q * q).sum(1)[:, None] * (x * x).sum(1))


def _nearest(pairs: DataFrame, n: int, metric: str) -> DataFrame:
    """query_id, chunk_id, distance (rounded to 9 places): best ``n`` of each pair of blocks (q_ids, q, v_ids, v, dim)."""
    q_kind, v_kind = (pairs.schema[c].dataType.elementType.simpleString() for c in ("q_ids", "v_ids"))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                dim = b.column("dim")[i].as_py()
                q, x = (np.frombuffer(b.column(c)[i].as_buffer(), np.float64).reshape(-1, dim) for c in ("q", "v"))
                for first in range(0, len(q), TILE):
                    d = _distances(q[first : first + TILE], x, metric)
                    if d.shape[1] > n >= 1:  # all that are no farther than the n-th, so that ties are left to the ids
                        kth = np.partition(d, n - 1, 1)[:, n - 1 : n]
                        row, col = np.nonzero((d <= kth + 2e-9 * (1 + np.abs(kth))) | np.isnan(kth))
                    else:
                        row, col = (a.ravel() for a in np.indices(d.shape))
                    for at in range(0, len(row), 100_000):
                        r, c = row[at : at + 100_000], col[at : at + 100_000]
                        # squared distances once more, as sums of squares lose no digits
                        exact = ((q[first + r] - x[c]) ** 2).sum(1) if metric == "l2" else d[r, c]
                        yield pa.RecordBatch.from_arrays([b.column("q_ids")[i].values.take(pa.array(first + r)), b.column("v_ids")[i].values.take(pa.array(c)), pa.array(np.round(exact, 9) + 0.0)], ["query_id", "chunk_id", "distance"])

    blocks = pairs.select("q_ids", "q", "v_ids", "v", "dim")
    return blocks.mapInArrow(go, f"query_id {q_kind}, chunk_id {v_kind}, distance double")


def vector_top_n(queries: DataFrame, vectors: DataFrame, n: int, metric: str = "cosine") -> DataFrame:
    """query_id, chunk_id, distance, rank: exact nearest ``n`` (question vectors qvec, chunk vectors embedding) by cosine or
    squared distance; ties go to the smaller chunk_id, vectors without direction come last by cosine.

    Questions of up to `BROADCAST` bytes are sent to the tasks that hold the vectors. More of them meet the vectors by
    shuffle, in a grid of groups of blocks, of which each pair meets in one key."""
    asked = packed(queries.select("query_id", "qvec"), "query_id", "qvec", QUESTIONS, "q_ids", "q").drop("_keep")
    blocks = packed(vectors.select("chunk_id", "embedding"), "chunk_id", "embedding", VECTORS, "v_ids", "v").drop("_keep")
    return top_by(_nearest(_meet(asked, blocks, _bytes(queries), ["dim"]), n, metric), n, "distance", "chunk_id")


def _bytes(queries: DataFrame) -> int:
    """Bytes of the question vectors."""
    told = queries.agg(F.count("*").alias("n"), F.max(F.size("qvec")).alias("dim")).first()
    return told["n"] * (told["dim"] or 0) * 8


def _meet(asked: DataFrame, blocks: DataFrame, size: int, keys: list[str]) -> DataFrame:
    """Pairs of question and vector blocks that agree in ``keys``: by broadcast of ``size`` bytes, or in a shuffled grid."""
    if size <= BROADCAST:
        return blocks.join(F.broadcast(asked), keys)
    asked, blocks = cut(asked, "question-blocks"), cut(blocks, "vector-blocks")
    groups = [max(1, -(-asked.count() // 64)), max(1, -(-blocks.count() // 64))]
    part = lambda i, c: F.pmod(F.xxhash64(c), F.lit(groups[i]))
    everywhere = lambda i: F.explode(F.sequence(F.lit(0), F.lit(groups[i] - 1)).cast("array<bigint>"))
    return asked.withColumn("_q", part(0, "q")).withColumn("_v", everywhere(1)).join(blocks.withColumn("_v", part(1, "v")).withColumn("_q", everywhere(0)), [*keys, "_q", "_v"])


def nearest_in_lists(queries: DataFrame, vectors: DataFrame, n: int) -> DataFrame:
    """query_id, chunk_id, distance (l2): the best ``n`` of each block of vectors (chunk_id, embedding, list) that a question
    (query_id, qvec, list) meets in one of its lists; a pair once."""
    asked = packed(queries, "query_id", "qvec", QUESTIONS, "q_ids", "q", keep="list")
    blocks = packed(vectors, "chunk_id", "embedding", VECTORS, "v_ids", "v", keep="list")
    return _nearest(_meet(asked, blocks, _bytes(queries), ["list", "dim"]), n, "l2").dropDuplicates(["query_id", "chunk_id"])


def train(sample: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of the rows of ``sample`` by Lloyd's rounds, from the first rows of a fixed shuffle."""
    rng = np.random.default_rng(7)
    c = sample[rng.permutation(len(sample))[:lists]].copy()
    for _ in range(rounds):
        at = _distances(sample, c, "l2").argmin(1)
        sums, sizes = np.zeros_like(c), np.bincount(at, minlength=len(c))
        np.add.at(sums, at, sample)
        c[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0][:, None]
    return c


def _with_lists(df: DataFrame, key: str, vec: str, centroids: np.ndarray, metric: str, sizes: np.ndarray | None = None, probe: int = 1, n: int = 0) -> DataFrame:
    """``key``, ``vec`` and lists: the numbers of the nearest ``probe`` centroids, nearest first, and of as many more as it
    takes until the lists (of ``sizes``) hold ``n`` rows."""
    held = df.sparkSession.sparkContext.broadcast((centroids, sizes))
    kind = df.schema[key].dataType.simpleString()

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, sizes = held.value
        for b in (b.slice(i, QUESTIONS // 4) for b in batches for i in range(0, b.num_rows, QUESTIONS // 4)):
            v = b.column("_v")
            d = _distances(v.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, centroids.shape[1]), centroids, "l2")
            if probe == 1 and sizes is None:
                lists = d.argmin(1)[:, None].tolist()
            else:
                order = d.argsort(1, kind="stable")
                before = np.cumsum(sizes[order], 1) - sizes[order]
                take = np.maximum(probe, (before < n).sum(1))
                lists = [row[:t].tolist() for row, t in zip(order, take, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("_id"), v, pa.array(lists, pa.list_(pa.int32()))], [key, vec, "lists"])

    x = F.col(vec).cast("array<double>")
    if metric == "cosine":  # the nearest by angle are the nearest of length 1
        size = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
        x = F.when(size > 0, F.transform(x, lambda v: v / size)).otherwise(x)
    rows = _good(df, vec).filter(F.size(vec) == centroids.shape[1]).select(F.col(key).alias("_id"), x.alias("_v"))
    return rows.mapInArrow(go, f"{key} {kind}, {vec} array<double>, lists array<int>")


def build_lists(spark: SparkSession, root: str, vectors: DataFrame, metric: str = "l2", *, recall: float = 0.95, n: int = 15) -> V.Version:
    """Keeps inverted lists of all ``vectors`` (chunk_id, embedding; of the length that most have) below ``root``.

    About the square root of the number of rows, at most `LISTS`, are lists. Their centroids are trained on about `TRAIN`
    rows a list, taken by a hash of the id; every row is in the list of its nearest centroid. How many lists a question
    has to ask is measured: about `PROBES` rows, by hash, are searched exactly for their nearest ``n``, and as many lists
    are asked as give ``recall`` of them on average."""
    good = _good(vectors.select("chunk_id", "embedding"), "embedding")
    told = good.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    total, dim = (told[0]["n"], told[0]["dim"]) if told else (0, 1)
    lists = int(min(LISTS, max(1, round(total**0.5))))
    some = lambda salt, size: good.filter((F.size("embedding") == dim) & (F.pmod(F.xxhash64(F.lit(salt), "chunk_id"), F.lit(max(1, total))) < size))
    one = np.zeros((1, dim))
    rows = [r["lists"] for r in _with_lists(some(1, TRAIN * lists), "chunk_id", "embedding", one, metric).select(F.col("embedding").alias("lists")).collect()]
    centroids = train(np.array(sorted(rows)), lists) if rows else one
    placed = _with_lists(good, "chunk_id", "embedding", centroids, metric).select("chunk_id", "embedding", F.col("lists")[0].alias("list"))
    tables = {"vectors": V.write(root, placed, F.col("list"), ["chunk_id"])}
    stored = V.read(spark, root, V.Version(0, tables), "vectors")
    sizes = {r["list"]: r["count"] for r in stored.groupBy("list").count().collect()}
    asked = some(2, PROBES).select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("qvec"))
    exact = vector_top_n(asked, good, n, metric).join(stored.select("chunk_id", "list"), "chunk_id")
    order = _with_lists(asked, "query_id", "qvec", centroids, metric, np.zeros(len(centroids), np.int64), len(centroids)).select("query_id", "lists")
    place = exact.join(order, "query_id").select(F.array_position("lists", F.col("list")).alias("p"))
    found, probe = place.groupBy("p").count().orderBy("p").collect(), lists
    reached, all_found = 0, sum(r["count"] for r in found)
    for r in found:
        reached += r["count"]
        if reached >= recall * all_found:
            probe = int(r["p"])
            break
    rows = [(i, sizes.get(i, 0), probe, metric, [float(v) for v in c]) for i, c in enumerate(centroids)]
    about = spark.createDataFrame(rows, "list int, rows long, probe int, metric string, centroid array<double>")
    return V.commit(spark, root, V.latest(spark, root), {**tables, "lists": V.write(root, about, F.lit(0))})


def search_lists(spark: SparkSession, root: str, queries: DataFrame, n: int, *, probe: int | None = None) -> DataFrame:
    """query_id, chunk_id, distance, rank: nearest ``n`` of the rows in the lists that each question asks: as many as were
    measured when the lists were built (or ``probe``), and further ones until they hold ``n`` rows. Distances are exact."""
    version = V.latest(spark, root)
    about = sorted(V.read(spark, root, version, "lists").collect(), key=lambda r: r["list"])  # at most LISTS rows
    metric, centroids = about[0]["metric"], np.array([r["centroid"] for r in about])
    sizes = np.array([r["rows"] for r in about])
    asks = _with_lists(queries.select("query_id", "qvec"), "query_id", "qvec", centroids, metric, sizes, probe or about[0]["probe"], n)
    asks = asks.select("query_id", "qvec", F.explode("lists").alias("list"))
    asked = packed(asks, "query_id", "qvec", QUESTIONS, "q_ids", "q", keep="list")
    blocks = packed(V.read(spark, root, version, "vectors"), "chunk_id", "embedding", VECTORS, "v_ids", "v", keep="list")
    if is_small(queries, MOST // 10):
        asked = F.broadcast(asked)
    return top_by(_nearest(blocks.join(asked, ["list", "dim"]), n, metric), n, "distance", "chunk_id")
