"""A keyword index with places: phrases whose last word is a prefix, BM25, and what a load changes.

The index has two tables. ``docs`` (chunk_id, doc_len, load) has a row for each chunk; ``postings`` (term, chunk_id, load,
places) a row for each term of a chunk, written by the task that reads the chunk: searches read all terms, so words of
texts are neither dealt out nor sorted. A load appends the postings of its chunks, in folders of their own, and writes
anew only those buckets of the narrow docs table that hold its chunks: older postings of a chunk no longer agree with its
``load`` and are passed over, until `compact_index` leaves them out.
"""

from __future__ import annotations

import unicodedata
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import cut
from ..sources import versions as V
from .chunks import latest_by, tokens_of
from .sizes import MOST, held, is_small
from .tops import top_by

CHUNK_BUCKETS = 16


def _marked_letters() -> tuple[str, str]:
    """Lower-case Latin letters that are a plain letter and one combining mark, and the plain letters."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]]
    pairs = [(c, d[0]) for c, d in pairs if len(d) == 2 and d[0].isascii() and unicodedata.combining(d[1]) and c.lower() == c]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


MARKED, PLAIN = _marked_letters()


def terms_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits without the marks of Latin letters."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return tokens_of(F.when(F.length(low) == F.octet_length(low), low).otherwise(F.translate(low, MARKED, PLAIN)))


class KeywordIndex(NamedTuple):
    docs: DataFrame
    postings: DataFrame


def places_of(chunks: DataFrame, text: str = "text") -> DataFrame:
    """term, chunk_id, doc_len, places (from 0, ascending): terms are grouped inside a chunk, without a shuffle."""
    own = chunks.select("chunk_id", terms_of(F.col(text)).alias("_t")).filter(F.size("_t") > 0)
    own = own.select("chunk_id", F.size("_t").alias("doc_len"), F.sort_array(F.transform("_t", lambda t, i: F.struct(t.alias("term"), i.alias("at")))).alias("_s"))
    term = lambda i: F.get("_s", i)["term"]
    own = own.withColumn("_b", F.filter(F.sequence(F.lit(0), F.size("_s") - 1), lambda i: (i == 0) | (term(i) != term(i - 1))))
    run = lambda b, j: F.slice("_s", b + 1, F.coalesce(F.get("_b", j + 1), F.col("doc_len")) - b)
    rows = F.transform("_b", lambda b, j: F.struct(term(b).alias("term"), F.transform(run(b, j), lambda x: x["at"]).alias("places")))
    return own.select("chunk_id", "doc_len", F.inline(rows)).select("term", "chunk_id", "doc_len", "places")


def postings_of(chunks: DataFrame, text: str = "text") -> DataFrame:
    """term, chunk_id, tf, doc_len."""
    return places_of(chunks, text).select("term", "chunk_id", F.size("places").cast("long").alias("tf"), "doc_len")


def upsert_postings(index: DataFrame, chunks: DataFrame) -> DataFrame:
    """Postings (term, chunk_id, tf, doc_len) after the chunks' old entries were deleted and new ones put in."""
    return index.join(chunks.select("chunk_id"), "chunk_id", "left_anti").unionByName(postings_of(chunks))


def _tables(chunks: DataFrame, load: int, text: str) -> KeywordIndex:
    """Index rows of ``chunks`` (chunk_id, text); of rows of one id the first by the text's hash."""
    one = chunks.select("chunk_id", F.coalesce(F.col(text), F.lit("")).alias("text"))
    if not chunks.groupBy("chunk_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():  # else no text has to be dealt out
        one = latest_by(one, ["chunk_id"], F.xxhash64("text"))
    at = F.lit(load).alias("load")
    docs = one.select("chunk_id", F.size(terms_of(F.col("text"))).alias("doc_len"), at).filter("doc_len > 0")
    return KeywordIndex(docs, places_of(one).select("term", "chunk_id", at, "places"))


def index_of(chunks: DataFrame, text: str = "text") -> KeywordIndex:
    """An index that is not kept: it reads the texts once for lengths and once for places."""
    return _tables(chunks, 0, text)


def build_index(spark: SparkSession, root: str, chunks: DataFrame, text: str = "text") -> V.Version:
    """Keeps an index of ``chunks`` below ``root``, in place of any that is there."""
    return _store(spark, root, V.latest(spark, root), _tables(chunks, 0, text))


def _store(spark: SparkSession, root: str, base: V.Version | None, index: KeywordIndex) -> V.Version:
    tables = {
        "docs": V.write(root, index.docs, V.bucket_of("chunk_id", CHUNK_BUCKETS), ["chunk_id"]),
        "postings": V.write(root, index.postings, None),
    }
    return V.commit(spark, root, base, tables)


def open_index(spark: SparkSession, root: str, number: int | None = None) -> KeywordIndex:
    version = V.latest(spark, root, number)
    if version is None:
        raise FileNotFoundError(f"no index below {root}")
    return KeywordIndex(V.read(spark, root, version, "docs"), V.read(spark, root, version, "postings"))


def upsert_index(spark: SparkSession, root: str, chunks: DataFrame, text: str = "text", gone: DataFrame | None = None) -> V.Version:
    """Puts ``chunks`` (chunk_id, text) in the place of those of their ids and takes those of ids ``gone`` (chunk_id) out;
    chunks without terms go out as well. Writes postings of these chunks only."""
    base = V.latest(spark, root)
    if base is None:
        return build_index(spark, root, chunks, text)
    new = _tables(chunks, base.number + 1, text)
    docs = KeywordIndex(cut(new.docs, "index-docs"), new.postings).docs
    out = chunks.select("chunk_id").distinct() if gone is None else chunks.select("chunk_id").unionByName(gone.select("chunk_id")).distinct()
    tables = {"docs": V.upsert(spark, root, "docs", base, docs, "chunk_id", CHUNK_BUCKETS, out.join(docs.select("chunk_id"), "chunk_id", "left_anti"))}
    schema, parts = V.write(root, new.postings, None)
    old = base.tables["postings"][1]
    tables["postings"] = schema, {b: old.get(b, []) + parts.get(b, []) for b in sorted({*old, *parts})}
    return V.commit(spark, root, base, tables)


def compact_index(spark: SparkSession, root: str) -> V.Version:
    """Writes all buckets with live postings only."""
    base, index = V.latest(spark, root), open_index(spark, root)
    live = index.postings.join(index.docs.select("chunk_id", "load"), ["chunk_id", "load"], "left_semi").select(index.postings.columns)
    return _store(spark, root, base, KeywordIndex(index.docs, live))


def live_postings(index: KeywordIndex) -> DataFrame:
    """term, chunk_id, tf, doc_len."""
    return index.postings.join(index.docs, ["chunk_id", "load"]).select("term", "chunk_id", F.size("places").cast("long").alias("tf"), "doc_len")


def _expanded(terms: DataFrame, prefixes: DataFrame) -> DataFrame:
    """term, prefix: ``prefixes`` (prefix, distinct) with the distinct ``terms`` that begin with them, joined by the beginnings
    of a term that have the length of a prefix: a term has fewer of these than letters, however many prefixes there are."""
    lengths = sorted(r["n"] for r in prefixes.select(F.length("prefix").alias("n")).distinct().collect())
    if not lengths:
        return terms.limit(0).select("term", F.col("term").alias("prefix"))
    heads = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("term")), lambda n: F.substring(F.col("term"), F.lit(1), n))
    return terms.select("term", F.explode(heads).alias("prefix")).join(prefixes, "prefix").select("term", "prefix")


def _live(met: DataFrame, index: KeywordIndex) -> DataFrame:
    """Rows of postings (chunk_id, load, ...) that count, with doc_len, dealt by chunk_id."""
    docs = index.docs.select("chunk_id", "doc_len", F.col("load").alias("_now"))
    return met.join(docs, "chunk_id").filter("load = _now").drop("load", "_now")


def phrase_hits(phrases: DataFrame, index: KeywordIndex) -> DataFrame:
    """kw, chunk_id, tf, doc_len: how often ``phrases`` (kw, ARRAY phrase, distinct, not empty) stand in live chunks: their
    words one after the other, the last one as the beginning of a term.

    Phrases of one word are a sum over postings without their places. A word of longer ones has its postings read once for
    all phrases that have it. The rarest word of a phrase gives its chunks, and the others are only looked up there, so a
    frequent word doesn't give each phrase that has it all its chunks."""
    words = phrases.select("kw", F.posexplode("phrase").alias("at", "word"), F.size("phrase").alias("of"))
    words = words.select("kw", "at", "of", "word", (F.col("at") == F.col("of") - 1).alias("begins"))
    words = cut(words.withColumn("word_id", F.xxhash64("word", "begins")), "phrase-words")
    asked = words.select("word_id", "word", "begins").distinct()
    hint = F.broadcast if is_small(asked) else lambda df: df
    begun = _expanded(index.postings.select("term").distinct(), hint(asked.filter("begins").select(F.col("word").alias("prefix"))))
    begun = begun.select("term", F.xxhash64("prefix", F.lit(True)).alias("word_id"))
    terms = cut(asked.filter("NOT begins").select(F.col("word").alias("term"), "word_id").unionByName(begun), "asked-terms")
    at_once = F.broadcast if is_small(terms, 10 * MOST) else lambda df: df
    alone = cut(terms.join(hint(words.filter("of = 1").select("word_id", "kw")), "word_id").select("term", "kw"), "single-terms")
    one = _live(index.postings.join(at_once(alone), "term").select("kw", "chunk_id", "load", F.size("places").alias("_n")), index)
    one = one.groupBy("kw", "chunk_id").agg(F.sum(F.col("_n").cast("long")).alias("tf"), F.first("doc_len").alias("doc_len"))
    several = words.filter("of > 1")
    if several.isEmpty():
        return one
    terms = cut(terms.join(hint(several.select("word_id").distinct()), "word_id", "left_semi"), "several-terms")
    met = index.postings.join(at_once(terms), "term").select("word_id", "chunk_id", "load", "places")
    met = cut(_live(met, index).select("word_id", "chunk_id", "doc_len", "places"), "word-hits")
    counts = met.groupBy("word_id").agg(F.count("*").alias("_df"))
    ranked = several.join(counts, "word_id", "left").withColumn("_df", F.coalesce("_df", F.lit(0)))
    ranked = cut(ranked.withColumn("_n", F.row_number().over(Window.partitionBy("kw").orderBy("_df", "at"))).select("kw", "at", "of", "word_id", "_n"), "ranked-words")
    rare = met.join(ranked.filter("_n = 1").drop("_n"), "word_id")
    rest = ranked.filter("_n > 1").drop("_n")
    others = met.join(rare.select("kw", "chunk_id").join(rest, "kw").distinct(), ["word_id", "chunk_id"])
    columns = ["kw", "chunk_id", "of", "at", "doc_len", "places"]
    # places where the phrase would begin, by each of its words; a chunk's places are all that is in a group
    begins = F.transform("places", lambda p: p - F.col("at"))
    groups = rare.select(columns).unionByName(others.select(columns)).groupBy("kw", "chunk_id", "of").agg(F.flatten(F.collect_list(begins)).alias("_s"), F.first("doc_len").alias("doc_len"))
    # a word stands at a place once, so a beginning that all words give is there as many times as there are words
    groups = groups.withColumn("_s", F.sort_array("_s")).filter(F.size("_s") >= F.col("of"))
    whole = F.filter(F.sequence(F.lit(0), F.size("_s") - F.col("of")), lambda i: F.get("_s", i) == F.get("_s", i + F.col("of") - 1))
    return one.unionByName(groups.select("kw", "chunk_id", F.size(whole).cast("long").alias("tf"), "doc_len").filter("tf > 0"))


def bm25_search(queries: DataFrame, index: KeywordIndex, n: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query_id, chunk_id, score, rank (from 0): sum over a query's distinct keywords (ARRAY keywords) of BM25, each a phrase
    whose last word is a prefix; keywords without letters and digits find nothing. Scores are rounded to 9 places before
    they are ranked; ties go to the smaller chunk_id.

    A chunk with only one of a query's keywords is among its best n only if it is among that keyword's, so each keyword
    hands these on, and their n-th score is the one to beat. Chunks with several keywords have one besides the most frequent
    keyword, and one besides those that all together don't reach the n-th score: the larger of these two sets isn't handed to the
    query, and of the other keywords only chunks that can reach that score with all the rest."""
    stats = index.docs.agg(F.count("*").alias("_docs"), F.avg(F.col("doc_len").cast("double")).alias("_avg"))
    keys = queries.select("query_id", F.explode("keywords").alias("_kw")).select("query_id", terms_of(F.col("_kw")).alias("phrase")).filter(F.size("phrase") > 0).distinct()
    keys = cut(keys.select("query_id", "phrase", F.xxhash64("phrase").alias("kw")), "keywords")
    found = cut(phrase_hits(keys.select("kw", "phrase").distinct(), index), "phrase-hits")
    df = cut(found.groupBy("kw").agg(F.count("*").alias("_df")), "keyword-counts")
    few = is_small(df)
    hint = F.broadcast if few else lambda df: df
    idf = F.greatest(F.log((F.col("_docs") - F.col("_df") + 0.5) / (F.col("_df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("doc_len") / F.col("_avg")))
    scored = found.join(hint(df), "kw").crossJoin(F.broadcast(stats)).select("kw", "chunk_id", part.alias("_s"))
    if not few:
        scored = cut(scored, "scored")
    best = cut(top_by(scored.withColumn("_r", F.round("_s", 9)), n, F.desc("_r"), "chunk_id", by="kw").select("kw", "chunk_id", "_s"), "keyword-best")
    most = best.groupBy("kw").agg(F.max("_s").alias("_most")).join(df, "kw")
    told = keys.select("query_id", "kw").join(hint(most), "kw").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("_most", "kw", "_df"))).alias("_k"))
    each = cut(told.select("query_id", "_k", F.explode("_k").alias("_x")).select("query_id", "_k", "_x.kw"), "asked-keywords")

    def totals(pairs: DataFrame) -> DataFrame:
        """``pairs`` (query_id, chunk_id, _k, distinct) with the score of all keywords of the query."""
        wanted = pairs.select("query_id", "chunk_id", "_k", F.explode("_k.kw").alias("kw"))
        met = scored.join(held(wanted, 5 * MOST), ["kw", "chunk_id"])
        return met.groupBy("query_id", "chunk_id").agg(F.first("_k").alias("_k"), F.round(F.sum("_s"), 9).alias("score"))

    pair = ["query_id", "chunk_id"]
    first = cut(each.join(hint(best.select("kw", "chunk_id")), "kw").select(*pair, "_k").dropDuplicates(pair), "first-chunks")
    first = cut(totals(first), "first-scores")
    if each.filter(F.size("_k") > 1).isEmpty():
        return top_by(first.drop("_k"), n, F.desc("score"), "chunk_id")
    beat = top_by(first, n, F.desc("score"), "chunk_id").groupBy("query_id").agg(F.first("_k").alias("_k"), F.when(F.count("*") >= n, F.min("score")).otherwise(0.0).alias("_nth"))
    # keywords in the order of their best scores: as long as these add up to less than the n-th score, they can't do alone
    upto = lambda i: F.aggregate(F.slice("_k", 1, i), F.lit(0.0), lambda s, x: s + x["_most"])
    size, rows = F.size("_k"), lambda k: F.aggregate(k, F.lit(0).cast("long"), lambda s, x: s + x["_df"])
    beat = beat.filter(size > 1).withColumn("_weak", F.filter("_k", lambda x, i: upto(i + 1) < F.col("_nth") - 1e-8))
    beat = beat.withColumn("_wide", F.slice(F.array_sort("_k", lambda x, y: F.when(x["_df"] > y["_df"], -1).when(x["_df"] < y["_df"], 1).when(x["kw"] < y["kw"], -1).when(x["kw"] > y["kw"], 1).otherwise(0)), 1, 1))
    beat = beat.withColumn("_out", F.when(rows(F.col("_weak")) > rows(F.col("_wide")), F.col("_weak")).otherwise(F.col("_wide")))
    lead = F.filter("_k", lambda x: ~F.array_contains(F.transform("_out", lambda y: y["kw"]), x["kw"]))
    lead = cut(beat.select("query_id", "_k", (F.col("_nth") - 1e-8 - upto(size)).alias("_lack"), F.explode(lead).alias("_x")).select("query_id", "_k", "_x.kw", (F.col("_lack") + F.col("_x._most")).alias("_least")), "leading-keywords")
    more = scored.join(held(lead), "kw").filter(F.col("_s") >= F.col("_least")).select(*pair, "_k")
    more = cut(more.dropDuplicates(pair), "more-chunks")
    total = first.drop("_k").unionByName(totals(more).drop("_k")).groupBy(*pair).agg(F.max("score").alias("score"))
    return top_by(total, n, F.desc("score"), "chunk_id")
