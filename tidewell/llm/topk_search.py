"""Exact top-k inner products with one KD-tree a shard.

Rows are dealt by hash into shards of bounded size. A shard's tree halves its rows at the median of the widest
axis until leaves are small; every node has the tight box of its rows and the smallest id below it. A query walks
the tree best first: the largest inner product that a box can hold bounds all its rows, and a node is dropped when
that bound is under the k-th score (or equal to it with only greater ids). Each query block first asks one shard;
the k-th score found there goes along to all shards.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

LEAF = 256
BLOCKS_A_GROUP = 32
PAIR = "query_id long, vec_id long, score long"


def build_tree(ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF) -> dict[str, np.ndarray]:
    """Nodes in heap-free preorder: lo, hi (box), least (id), left (child or -1), right, begin, end (rows)."""
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows[order]
    perm = np.arange(len(ids))
    nodes: list[list] = []

    def split(begin: int, end: int) -> int:
        me, own = len(nodes), perm[begin:end]
        lo, hi = rows[own].min(0), rows[own].max(0)
        nodes.append([lo, hi, ids[own].min(), -1, -1, begin, end])
        if end - begin > leaf and (axis := int(np.argmax(hi - lo))) >= 0 and hi[axis] > lo[axis]:
            middle = (end - begin) // 2
            perm[begin:end] = own[np.argpartition(rows[own, axis], middle)]
            nodes[me][3] = split(begin, begin + middle)
            nodes[me][4] = split(begin + middle, end)
        elif end - begin > leaf:  # all alike: halves by id
            perm[begin:end] = np.sort(own)
            middle = (end - begin) // 2
            nodes[me][3] = split(begin, begin + middle)
            nodes[me][4] = split(begin + middle, end)
        else:
            perm[begin:end] = np.sort(own)
        return me

    if len(ids) and rows.shape[1]:
        split(0, len(ids))
    elif len(ids):
        nodes.append([rows[0], rows[0], ids.min(), -1, -1, 0, len(ids)])
    lo, hi, least, left, right, begin, end = zip(*nodes, strict=True)
    return {"ids": ids[perm], "rows": rows[perm], "lo": np.array(lo), "hi": np.array(hi), "least": np.array(least), "left": np.array(left), "right": np.array(right), "begin": np.array(begin), "end": np.array(end)}


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in whole numbers; by floating-point units where no sum can pass 2**53."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def search_tree(tree: dict[str, np.ndarray], ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(query id, row id, score) of the best k of this tree's rows whose score reaches the query's ``floor``."""
    plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
    bounds = _exact(plus, tree["hi"]) + _exact(minus, tree["lo"])
    for q, qid in enumerate(ids):
        bound, best = bounds[q], []  # best: heap of (score, -id), the worst on top
        kth = (int(floor[q]), -(2**63))
        line = [(-int(bound[0]), int(tree["least"][0]), 0)]
        while line:
            most, least, node = heapq.heappop(line)
            if (-most, -least) < kth:
                break
            if tree["left"][node] >= 0:
                for child in (tree["left"][node], tree["right"][node]):
                    if (int(bound[child]), -int(tree["least"][child])) >= kth:
                        heapq.heappush(line, (-int(bound[child]), int(tree["least"][child]), int(child)))
                continue
            begin, end = tree["begin"][node], tree["end"][node]
            scores, own = _exact(tree["rows"][begin:end], queries[q : q + 1])[:, 0], tree["ids"][begin:end]
            for i in np.flatnonzero((scores >= kth[0]) & (own != qid)):
                item = (int(scores[i]), -int(own[i]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
            if len(best) == k:
                kth = max(kth, best[0])
        yield from ((int(qid), -i, s) for s, i in best)


def _pack(**arrays: np.ndarray) -> bytes:
    np.savez(out := io.BytesIO(), **arrays)
    return out.getvalue()


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as z:
        return {k: z[k] for k in z.files}


def exact_top_k(
    vectors: DataFrame,
    is_query: Column,
    *,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 1024,
    shard_rows: int = 16384,
    block_queries: int = 512,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row of ``vectors`` for which ``is_query`` holds, the ``k``
    other rows of the largest integer inner product of ``floor(scale * x)``; ties go to the smaller id.

    Vectors that are null or hold a null or non-finite component, and rows without id, take no part. Vectors of
    another length than the query's are not compared with it. Of rows of one id each takes part, except against a
    query of that id. Fewer than k candidates: all. Vectors so large that an inner product might not fit 64 bits are an
    error before any search. An empty table gives an empty result. Other columns are ignored.
    """
    x = F.col(vector_col)
    good = F.col(id_col).isNotNull() & x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    rows = vectors.filter(good).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale)).alias("v"), is_query.alias("q"), F.size(x).alias("dim"), x.alias("x"))
    # one number for all: sums of products have to fit 64 bits
    told = rows.agg(F.max(F.size("v")).alias("dim"), F.max(F.array_max(F.transform("x", lambda v: F.abs(v.cast("double") * scale)))).alias("top")).first()
    if (told["dim"] or 0) * (float(told["top"] or 0) + 1) ** 2 >= 2**63:
        raise ValueError(f"inner products of {told['dim']} components up to {told['top']:.4g} don't fit 64 bits; take a smaller scale")
    # a query takes k at most of rows alike in id and vector, so k of them are all that it can need
    alike = rows.groupBy("id", "v", "q", "dim").agg(F.count("*").alias("copies"))
    rows = cut(alike.withColumn("copies", F.explode(F.array_repeat(F.lit(1), F.least("copies", F.lit(k)).cast("int")))).drop("copies"), "vectors")
    shards = -(-max(1, rows.count()) // shard_rows)
    spread = lambda salt, m: F.pmod(F.xxhash64(F.lit(salt), "id", "v"), F.lit(m)).cast("int")
    query_blocks = -(-max(1, rows.filter("q").count()) // block_queries)
    queries = rows.filter("q").dropDuplicates(["id", "v"]).withColumn("block", spread(2, query_blocks))

    def matrix(part: pd.DataFrame) -> np.ndarray:
        return np.array(part["v"].tolist(), np.int64).reshape(len(part), -1)

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        return part[["dim", "shard"]].head(1).assign(tree=[_pack(**build_tree(part["id"].to_numpy(np.int64), matrix(part)))])

    def stack(part: pd.DataFrame) -> pd.DataFrame:
        packed = _pack(ids=part["id"].to_numpy(np.int64), rows=matrix(part), floor=part["floor"].to_numpy(np.int64))
        return part[["dim", "block"]].head(1).assign(queries=[packed])

    def ask(blocks: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, int]] = []
        for tree in map(_unpack, trees["tree"]):
            for q in map(_unpack, blocks["queries"]):
                found += search_tree(tree, q["ids"], q["rows"], k, q["floor"])
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    def blocks(df: DataFrame, name: str) -> DataFrame:
        return cut(df.groupBy("dim", "block").applyInPandas(stack, "dim int, block int, queries binary"), name)

    trees = cut(rows.withColumn("shard", spread(1, shards)).groupBy("dim", "shard").applyInPandas(grow, "dim int, shard int, tree binary"), "trees")
    lowest = F.lit(-(2**63)).cast("long")
    # First one shard for each block of queries, for a k-th score to begin with.
    first = blocks(queries.withColumn("floor", lowest), "queries").withColumn("shard", F.pmod("block", F.lit(shards)).cast("int"))
    seeds = first.groupBy("dim", "shard").cogroup(trees.groupBy("dim", "shard")).applyInPandas(ask, PAIR)
    floors = seeds.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("floor")).filter(F.col("n") >= k).select(F.col("query_id").alias("id"), "floor")
    # Then all shards. A shard meets the blocks in groups, and its tree is sent once to each group.
    lifted = blocks(queries.join(floors, "id", "left").withColumn("floor", F.coalesce("floor", lowest)), "lifted")
    group = F.floor(F.col("block") / BLOCKS_A_GROUP).cast("int")
    everywhere = lifted.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("part", group)
    sent = trees.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit((query_blocks - 1) // BLOCKS_A_GROUP))))
    keys = ["dim", "shard", "part"]
    found = everywhere.groupBy(keys).cogroup(sent.groupBy(keys)).applyInPandas(ask, PAIR)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
