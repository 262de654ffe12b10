"""Sets of words that are alike, and what such links connect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import cut


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node that it is connected with) of all nodes of ``edges`` (a, b)."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "linked")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "linked")
    while True:
        near = both.join(labels, F.col("a") == F.col("node")).groupBy("b").agg(F.min("label").alias("near"))
        moved = labels.join(near, F.col("node") == F.col("b"), "left").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = cut(moved.join(up, "label", "left").select("node", "was", F.least("label", "up").alias("label")), "linked")
        labels = new.select("node", "label")
        if new.filter("was <> label").isEmpty():
            return labels


def alike_groups(sets: DataFrame, similarity: float) -> DataFrame:
    """node, label (the smallest node of the group) of sets (node, words ARRAY, distinct and not empty) that are connected
    by links of Jaccard similarity ``similarity`` at least; sets without link are left out.

    Exact: sets that are alike share one of their rarest words (all but so many as they must share, and one more). Such
    words' sets are compared with the word's first set; pairs are only made with sets that this did not connect."""
    n = sets.select("node", F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    ranked = sets.select("node", F.size("words").alias("size"), F.explode("words").alias("w")).join(n, "w")
    ordered = ranked.groupBy("node", "size").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "w"))), lambda x: x["w"]).alias("words"))
    keep = F.col("size") - F.ceil(F.col("size") * similarity - 1e-9).cast("int") + 1
    ordered = cut(ordered, "linked")
    heads = cut(ordered.select("node", "size", F.explode(F.slice("words", F.lit(1), keep)).alias("w")), "linked")

    def links(pairs: DataFrame) -> DataFrame:
        left, right = ordered.select(F.col("node").alias("a"), F.col("words").alias("wa")), ordered.select(F.col("node").alias("b"), F.col("words").alias("wb"))
        both = F.size(F.array_intersect("wa", "wb"))
        return pairs.distinct().join(left, "a").join(right, "b").filter(both >= (F.size("wa") + F.size("wb") - both) * similarity - 1e-9).select("a", "b")

    firsts = heads.groupBy("w").agg(F.min("node").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    stars = heads.join(firsts, "w").filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    edges = cut(links(stars), "linked")
    labels = components(edges)
    named = heads.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    first = firsts.join(labels.withColumnRenamed("node", "first"), "first", "left").select("w", F.coalesce("label", "first").alias("first_label"))
    named = cut(named.join(first, "w"), "linked")
    rest = named.filter("label <> first_label").select("w", F.col("node").alias("x"), F.col("label").alias("lx"), F.col("size").alias("sx"))
    other = named.select("w", F.col("node").alias("y"), F.col("label").alias("ly"), F.col("size").alias("sy"))
    fits = F.least("sx", "sy") >= F.greatest("sx", "sy") * similarity - 1e-9
    pairs = rest.join(other, "w").filter((F.col("lx") != F.col("ly")) & fits).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return components(edges.unionByName(links(pairs)))
