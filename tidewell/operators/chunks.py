"""From documents to chunks, and what a load changes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_hash

BLANKS = r"(?U)\s+"
TOKENS = r"[^\p{L}\p{N}]+"


def tokens_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), TOKENS), "")


def _words(text: Column, pattern: str = BLANKS) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), pattern), "")


def chunk_words(df: DataFrame, size: int = 100, overlap: int = 20, text: str = "content", doc_id: str = "id", blanks: str = BLANKS, keep: Sequence[str] = (), empty: bool = False) -> DataFrame:
    """doc_id, chunk_ix, text and the columns ``keep`` of the document: windows of ``size`` words, each beginning ``size - overlap`` after the one before, as
    long as a word is left to begin with (so the last may hold nothing new); all words if they are ``size`` at most;
    no chunk without words, or with ``empty`` one whose text is empty."""
    step = max(1, size - overlap)
    n = F.size("_w")
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - 1, F.lit(step)))
    cut = df.select(F.col(doc_id).alias("doc_id"), *keep, _words(F.col(text), blanks).alias("_w"))
    cut = cut if empty else cut.filter(F.size("_w") > 0)
    places = cut.select("doc_id", *keep, "_w", F.posexplode(starts).alias("chunk_ix", "_s"))
    return places.select("doc_id", "chunk_ix", F.array_join(F.slice("_w", F.col("_s") + 1, size), " ").alias("text"), *keep)


def chunk_tokens(df: DataFrame, size: int = 512, overlap: int = 64, text: str = "content", doc_id: str = "id", tokenizer: Callable[[Column], Column] = tokens_of) -> DataFrame:
    """doc_id, chunk_ix, text: windows of ``size`` tokens; the last is the first that reaches the end. Blank chunks are
    dropped and the others are numbered without gaps. ``tokenizer``: column of texts to column of token lists."""
    step = max(1, size - overlap)
    n = F.size("_w")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - size) / step) * step).cast("int"), F.lit(step))
    cut = df.select(F.col(doc_id).alias("doc_id"), tokenizer(F.col(text)).alias("_w")).filter(F.size("_w") > 0)
    texts = F.filter(F.transform(starts, lambda s: F.array_join(F.slice("_w", s + 1, size), " ")), lambda t: F.trim(t) != "")
    return cut.select("doc_id", F.posexplode(texts).alias("chunk_ix", "text"))


def split_oversize(chunks: DataFrame, max_tokens: int, blanks: str = BLANKS) -> DataFrame:
    """Chunks (chunk_id, text, content_hash) of more than ``max_tokens`` words become pieces of half the words
    (rounded down), with ids `-sub-j` and hashes of their own."""
    words = _words(F.col("text"), blanks)
    half = F.greatest(F.lit(1), F.floor(F.size("_w") / 2).cast("int"))
    long_ = F.size("_w") > max_tokens
    parts = F.when(long_, F.transform(F.sequence(F.lit(0), F.size("_w") - 1, half), lambda s: F.array_join(F.slice("_w", s + 1, half), " "))).otherwise(F.array("text"))
    out = chunks.withColumn("_w", words).withColumn("_long", long_).select("*", F.posexplode(parts).alias("_j", "_t"))
    out = out.withColumn("chunk_id", F.when(F.col("_long"), F.concat("chunk_id", F.lit("-sub-"), F.col("_j").cast("string"))).otherwise(F.col("chunk_id")))
    return out.withColumn("content_hash", F.when(F.col("_long"), content_hash("_t")).otherwise(F.col("content_hash"))).withColumn("text", F.col("_t")).drop("_w", "_long", "_j", "_t")


def cap_content(df: DataFrame, max_chars: int = 1_000_000, text: str = "content") -> DataFrame:
    return df.withColumn(text, F.substring(text, 1, max_chars))


def drop_raw_dumps(df: DataFrame, max_kb: int = 1024, text: str = "content", mime: str = "mime_type") -> DataFrame:
    """Drops spreadsheets of more than ``max_kb`` * 1024 characters."""
    sheet = F.lower(F.coalesce(F.col(mime), F.lit(""))).rlike("excel|spreadsheet")
    return df.filter(~(sheet & (F.length(F.coalesce(F.col(text), F.lit(""))) > max_kb * 1024)))


def diff_chunks(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """``incoming`` (chunk_id, content_hash, meta MAP) with action: new, updated or skipped. Skipped: same hash and no
    key of the incoming metadata differs; keys that only the stored row has don't count."""
    old = stored.select("chunk_id", F.col("content_hash").alias("_hash"), F.col("meta").alias("_meta"))
    differs = F.size(F.map_filter("meta", lambda k, v: ~F.col("_meta")[k].eqNullSafe(v))) > 0
    action = F.when(F.col("_hash").isNull(), "new").when((F.col("_hash") != F.col("content_hash")) | differs, "updated").otherwise("skipped")
    return incoming.join(old, "chunk_id", "left").withColumn("action", action).drop("_hash", "_meta")


def stale_chunks(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored chunks of documents that were loaded again and no longer have them."""
    return stored.join(incoming.select("doc_id").distinct(), "doc_id", "left_semi").join(incoming.select("chunk_id"), "chunk_id", "left_anti")


def load_report(diffed: DataFrame) -> DataFrame:
    return diffed.groupBy("action").agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("docs"))


def upserted(target: DataFrame, incoming: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``target`` after new and changed rows of ``incoming`` came in; incoming rows replace stored ones."""
    return target.join(incoming.select(key), key, "left_anti").unionByName(incoming)


def latest_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """First row of each key by ``order``."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
