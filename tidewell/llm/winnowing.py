"""Fingerprints of texts by winnowing: of each window of word k-grams the one with the smallest hash, with its place.

DataFrame functions only. Words are runs of letters and digits of the lower-cased text (a text without any is one word,
itself); a k-gram is K words in a row, a text of fewer words is one gram. A gram is known by xxhash64 of its words. It is
hashed as a slice of the word list, as column functions carry no value from one element to the next: the hashes are
those that rolling along would give to each place.

Of W grams in a row the smallest hash is kept, the rightmost of equal ones; a text of fewer grams is one window. So any
passage of K + W - 1 words that two texts share gives both a common hash, at places that `shared_passages` names, and no
passage of under K words gives one.

Defined results: null text counts as empty; texts alike have fingerprints alike; a null id is the first of all, rows of
one id follow each other by a hash of the text, rows alike in both stand in a row (each is the next of the one before).
An empty table gives no rows. Columns besides the id and the text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

#: Words in a gram, grams in a window.
K, W = 5, 8
#: Low bits of a window's entries that hold the place, counted down, so that the rightmost of equal hashes is smallest.
_PLACES = (1 << 26) - 1
#: Copies of a row that one task writes.
_COPIES = 1024


def words_of(text: Column) -> Column:
    found = F.array_remove(F.split(F.lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")
    return F.when(F.size(found) > 0, found).otherwise(F.array(text))


def fingerprints(texts: DataFrame, text: str, out: str, k: int = K, w: int = W) -> DataFrame:
    """``texts`` with column ``out``: array of (hash, place), places (from 0) ascending; ``text`` must not be null.

    Each step is a column of its own that the next one names more than once, so that none is computed again inside a
    lambda."""
    words, keyed, kept = (f"{out}_{x}" for x in ("words", "keyed", "kept"))
    step = texts.withColumn(words, words_of(F.col(text)))
    gram = lambda i: F.xxhash64(F.slice(words, i + 1, k))
    grams = F.sequence(F.lit(0), F.greatest(F.size(words) - k, F.lit(0)))
    step = step.withColumn(keyed, F.transform(grams, lambda i: gram(i).bitwiseAND(F.lit(~_PLACES)).bitwiseOR(F.lit(_PLACES) - i)))
    windows = F.sequence(F.lit(0), F.greatest(F.size(keyed) - w, F.lit(0)))
    # windows move to the right, so entries come in the order of their places
    step = step.withColumn(kept, F.array_distinct(F.transform(windows, lambda i: F.array_min(F.slice(keyed, i + 1, w)))))
    place = lambda x: (F.lit(_PLACES) - x.bitwiseAND(F.lit(_PLACES))).cast("int")
    found = F.transform(kept, lambda x: F.struct(gram(place(x)).alias("hash"), place(x).alias("place")))
    return step.withColumn(out, found).drop(words, keyed, kept)


def likeness(a: Column, b: Column) -> Column:
    """Share of the distinct hashes of two fingerprints (their lists of hashes) that stand in both."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    both = F.size(F.array_intersect(x, y))
    return both / (F.size(x) + F.size(y) - both)


def digest(fingerprint: Column) -> Column:
    """The number of grams kept, and SHA-256 of their hashes and places."""
    hashes, places = (F.array_join(fingerprint[c].cast("array<string>"), ",") for c in ("hash", "place"))
    return F.concat(F.size(fingerprint).cast("string"), F.lit(":"), F.sha2(F.concat(hashes, F.lit(";"), places), 256))


def shared_passages(a: DataFrame, b: DataFrame, key: str, fingerprint: str = "fingerprint") -> DataFrame:
    """a_key, b_key, hash, a_place, b_place of grams kept of a text of ``a`` and of one of ``b``: a row for each meeting, so
    for sides such as a document against a set of sources, not for a corpus against itself."""
    row = lambda df, s: df.select(F.col(key).alias(f"{s}_key"), F.inline(fingerprint)).withColumnRenamed("place", f"{s}_place")
    return row(a, "a").join(row(b, "b"), "hash")


def neighbours(keys: DataFrame) -> DataFrame:
    """key, copies, chars and prev (struct key, chars): distinct ``keys`` (key, copies, chars), each with the one before
    it; the first has the last. Ranges of keys are ordered apart; only the first and last of each range meet."""
    ranged = cut(keys.repartitionByRange("key").withColumn("_range", F.spark_partition_id()), "winnow-keys")
    own = F.struct("key", "chars")
    inside = ranged.withColumn("prev", F.lag(own).over(Window.partitionBy("_range").orderBy("key")))
    # a row for each range: as many as there are partitions
    ends = ranged.groupBy("_range").agg(F.max_by(own, "key").alias("_end"))
    order = Window.orderBy("_range")
    ends = ends.select(F.lead("_range").over(order).alias("_next"), "_end", F.min("_range").over(Window.partitionBy()).alias("_first"))
    ends = ends.select(F.coalesce("_next", "_first").alias("_range"), "_end")
    return inside.join(F.broadcast(ends), "_range").withColumn("prev", F.coalesce("prev", "_end")).drop("_range", "_end")


def edited_fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited (fingerprint), near_edited, near_next of each row: its edited text
    has the first characters of the next row's text in place of its own last half.

    Rows alike are counted before they are shuffled, and dealt out again in pieces. A text goes by shuffle once, and to
    the row before it as far as that takes it in, with the hashes of its grams."""
    body = F.coalesce(F.col(text), F.lit(""))
    # fields that may be null, as they are once read from a table: else the joins cast the key and shuffle texts again
    kind = f"struct<doc_id: {docs.schema[doc_id].dataType.simpleString()}, hash: bigint>"
    rows = docs.select(F.struct(F.col(doc_id).alias("doc_id"), F.xxhash64(body).alias("hash")).cast(kind).alias("key"), body.alias("text"))
    keys = rows.groupBy("key").agg(F.count("*").alias("copies"), F.first(F.length("text")).alias("chars"))
    texts = rows.groupBy("key").agg(F.first("text").alias("text"))
    known = texts.join(neighbours(keys).hint("merge"), "key")
    told = fingerprints(known, "text", "_fp")
    given = told.select(F.col("prev.key").alias("key"), F.substring("text", F.lit(1), (F.col("prev.chars") / 2).cast("int")).alias("_start"), F.col("_fp.hash").alias("_next"))
    own = told.drop("prev").join(given.hint("merge"), "key")
    half = F.floor(F.col("chars") / 2).cast("int")
    plain = F.struct(F.col("_start").alias("start"), F.lit(1).cast("long").alias("times"), likeness(F.col("_fp.hash"), F.col("_next")).alias("near_next"))
    alike = F.struct(F.substring("text", F.lit(1), half).alias("start"), (F.col("copies") - 1).alias("times"), F.lit(1.0).alias("near_next"))
    forms = own.select("key", "chars", "text", "_fp", F.explode(F.when(F.col("copies") > 1, F.array(plain, alike)).otherwise(F.array(plain))).alias("_form"))
    forms = forms.withColumn("_edited", F.concat(F.substring("text", F.lit(1), F.col("chars") - half), F.col("_form.start")))
    return fingerprints(forms, "_edited", "_efp").select(
        F.col("key.doc_id").alias("doc_id"), F.col("chars").cast("long").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256"), F.col("_fp").alias("fingerprint"),
        F.col("_efp").alias("edited"), likeness(F.col("_fp.hash"), F.col("_efp.hash")).alias("near_edited"), F.col("_form.near_next").alias("near_next"), F.col("_form.times").alias("_times"),
    )


def dealt(rows: DataFrame) -> DataFrame:
    """Each row as many times as its column _times says, in pieces that are spread over tasks."""
    pieces = rows.withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_times") - 1) / _COPIES))))
    spread = pieces.repartition(F.xxhash64("doc_id", "edited_sha256", "_piece"))
    n = F.least(F.col("_times") - F.col("_piece") * _COPIES, F.lit(_COPIES)).cast("int")
    return spread.withColumn("_copy", F.explode(F.sequence(F.lit(1), n))).drop("_piece", "_copy", "_times")
