"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations.

An item's window (``window`` consecutive words; all of a shorter item) is a set of word shingles with positions.
A window can only occur in a document that has each of its shingles, so a prefix of one is enough: its rarest, by
counts over all documents. One scan picks document shingles that a Bloom filter of the items' shingles lets through
(of fixed size, whatever the benchmark's; the joins sort out what it lets through wrongly); the prefix join keeps
positions where a window's rarest shingle stands; bounds on position and length drop windows that would not fit;
what is left is compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, cut

#: Between words, after lower-casing A-Z.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def _hash_sql(k: int, i: str = "i") -> str:
    return "xxhash64(" + ", ".join(f"get(_w, {i} + {j})" for j in range(k)) + ")"


def item_windows(benchmark: DataFrame, window: int, shingle: int) -> DataFrame:
    """item, win (words), len, k (words of a shingle), shingles array<struct<at, h>>; windows of an item once each."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words_of(F.col("text")).alias("_all")).filter(F.size("_all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_all") - (window - 1)))
    wins = items.select("item", F.explode(F.transform(starts, lambda s: F.slice("_all", s, window))).alias("_w")).distinct()
    wins = wins.withColumn("len", F.size("_w")).withColumn("k", F.least("len", F.lit(shingle)))
    by_k = F.expr("CASE k " + " ".join(f"WHEN {k} THEN transform(sequence(0, len - {k}), i -> struct(i AS at, {_hash_sql(k)} AS h))" for k in range(1, shingle + 1)) + " END")
    return wins.withColumn("shingles", by_k).withColumnRenamed("_w", "win")


def _places(h: str, bits: int) -> list[str]:
    """The two bits of a shingle's hash, as SQL."""
    return [f"({h} & {bits - 1})", f"(shiftrightunsigned({h}, 32) & {bits - 1})"]


def bloom_words(shingles: DataFrame, bits: int) -> str:
    """A Bloom filter of column h as SQL: a constant array of ``bits`` / 64 longs. As many rows come to the driver at
    most; ``bits`` is a power of two, up to 2^31."""
    places = shingles.select(F.explode(F.expr(f"array({', '.join(_places('h', bits))})")).alias("_b"))
    words = places.groupBy(F.shiftright("_b", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, CAST(_b & 63 AS INT)))").alias("v")).collect()
    out = ["0"] * (bits // 64)
    for word in words:
        out[word["at"]] = str(word["v"])
    return f"CAST(split('{','.join(out)}', ',') AS ARRAY<BIGINT>)"


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 10,
    shingle: int = 3,
    filter_bits: int = 1 << 22,
    max_broadcast: int = 50_000,
) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, n_words, n_hit (words inside any occurrence of a window), n_items,
    items_sha256 (of the found items' ids, sorted as strings, joined by commas), contaminated.

    Null and wordless texts have no words; wordless items match nothing; items without id count as "null".
    Repeated rows stay repeated, equal windows of several items count for each. The Bloom filter's size is
    ``filter_bits``: a benchmark of many more shingles than a tenth of that only lets more positions through, which
    the join by shingle drops. Up to ``max_broadcast`` windows are sent to all tasks for that join, more go by shuffle.
    An empty table of documents gives an empty result; other columns are ignored.
    """
    wins = cut(item_windows(benchmark, window, shingle), "windows")
    held = (lambda df: F.broadcast(df)) if wins.limit(max_broadcast + 1).count() <= max_broadcast else (lambda df: df)
    ks = sorted(r["k"] for r in wins.select("k").distinct().collect())
    empty = F.expr("CAST(array() AS array<struct<k: int, pos: int, h: bigint>>)")
    text = F.col(text_col)
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), words_of(text).alias("_w"))
    base = base.withColumn("n_words", F.size("_w").cast("long"))
    bloom = bloom_words(wins.select(F.explode("shingles.h").alias("h")), filter_bits)
    known = " AND ".join(f"getbit(get({bloom}, CAST(shiftright({b}, 6) AS INT)), CAST({b} & 63 AS INT)) = 1" for b in _places("c.h", filter_bits))
    every = [F.when(F.col("n_words") >= k, F.expr(f"transform(sequence(0, n_words - {k}), i -> struct({k} AS k, CAST(i AS INT) AS pos, {_hash_sql(k)} AS h))")) for k in ks]
    base = base.withColumn("_c", F.concat(*[F.coalesce(e, empty) for e in every]) if every else empty).withColumn("_c", F.expr(f"filter(_c, c -> {known})"))
    near = F.expr(f"transform(_c, c -> struct(c.k AS k, c.pos AS pos, c.h AS h, greatest(c.pos - {window}, 0) AS first, slice(_w, greatest(c.pos - {window}, 0) + 1, {2 * window + 1}) AS near))")
    base = cut(base.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text_hash", "n_words", near.alias("_c")), "shingles")
    spots = base.select("_row", "n_words", F.explode("_c").alias("c")).select("_row", "n_words", "c.*")
    counts = spots.groupBy("k", "h").agg(F.count("*").alias("n"))
    each = wins.select("item", "win", "len", "k", F.explode("shingles").alias("s")).select("item", "win", "len", "k", "s.at", "s.h")
    prefix = each.join(counts, ["k", "h"], "left").groupBy("item", "win", "len", "k").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "at")).alias("p"))
    prefix = prefix.filter("p.n > 0").select("item", "win", "len", "k", "p.h", "p.at")
    start = F.col("pos") - F.col("at")
    hits = spots.join(held(prefix), ["k", "h"]).filter((start >= 0) & (start + F.col("len") <= F.col("n_words")))
    hits = hits.filter(F.slice("near", start - F.col("first") + 1, F.col("len")) == F.col("win")).select("_row", "item", start.alias("a"), (start + F.col("len")).alias("b"))
    spans = hits.groupBy("_row").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
    covered = F.expr("aggregate(spans, named_struct('e', 0, 'n', 0L), (s, x) -> named_struct('e', greatest(s.e, x.b), 'n', s.n + greatest(0, x.b - greatest(x.a, s.e))), s -> s.n)")
    spans = spans.select("_row", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))
    out = base.drop("_c").join(spans, "_row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return out.select("doc_id", "text_hash", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items_sha256", nothing).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
