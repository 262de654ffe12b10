"""What state the corpus is in: copies, dumps, stale topic pages, facts that disagree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import tokens_of
from .linked import alike_groups


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """source, group (of blanks: `default`), chunks, docs."""
    group = F.coalesce(F.nullif(F.trim("group"), F.lit("")), F.lit("default"))
    return chunks.groupBy("source", group.alias("group")).agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("docs"))


def oversized_docs(chunks: DataFrame, threshold: int = 1000) -> DataFrame:
    """doc_id, chunks of spreadsheets with more than ``threshold`` chunks (mime_type)."""
    sheet = F.lower(F.coalesce("mime_type", F.lit(""))).rlike("excel|spreadsheet")
    return chunks.filter(sheet).groupBy("doc_id").agg(F.count("*").alias("chunks")).filter(F.col("chunks") > threshold)


def document_keys(chunks: DataFrame) -> DataFrame:
    """doc_id, title (trimmed), content_key (of the set of chunk hashes), chunks."""
    return chunks.groupBy("doc_id").agg(F.trim(F.first("title")).alias("title"), F.md5(F.array_join(F.array_sort(F.collect_set("content_hash")), "|").cast("binary")).alias("content_key"), F.count("*").alias("chunks"))


def identical_groups(chunks: DataFrame) -> DataFrame:
    """title, content_key, docs (of the group), doc_id of documents with the same title and the same set of chunk hashes; a
    row a document, so that a group may be of any size."""
    keys = document_keys(chunks)
    groups = keys.groupBy(F.col("title").alias("_title"), F.col("content_key").alias("_key")).agg(F.count("*").alias("docs")).filter("docs > 1")
    return keys.join(groups, F.col("title").eqNullSafe(F.col("_title")) & (F.col("content_key") == F.col("_key"))).select("title", "content_key", "docs", "doc_id")


def keep_largest(chunks: DataFrame) -> DataFrame:
    """doc_id, keep: of identical documents the one with the most chunks stays (smallest id of equals)."""
    keys = document_keys(chunks)
    best = keys.groupBy(F.col("title").alias("_title"), F.col("content_key").alias("_key")).agg(F.min_by("doc_id", F.struct(-F.col("chunks"), "doc_id")).alias("_best"))
    return keys.join(best, F.col("title").eqNullSafe(F.col("_title")) & (F.col("content_key") == F.col("_key"))).select("doc_id", (F.col("doc_id") == F.col("_best")).alias("keep"))


def drop_identical(chunks: DataFrame, postings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, postings, report) without the copies that `keep_largest` doesn't keep."""
    gone = keep_largest(chunks).filter("NOT keep").select("doc_id")
    gone_chunks = chunks.join(gone, "doc_id", "left_semi").select("chunk_id")
    report = gone_chunks.agg(F.count("*").alias("chunks_removed")).crossJoin(gone.agg(F.count("*").alias("docs_removed")))
    return chunks.join(gone, "doc_id", "left_anti"), postings.join(gone_chunks, "chunk_id", "left_anti"), report


def drop_oversized(chunks: DataFrame, threshold: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(chunks, report: before, after, docs) without `oversized_docs`; use the report alone for a dry run."""
    gone = oversized_docs(chunks, threshold)
    before, lost = chunks.agg(F.count("*").alias("before")), gone.agg(F.coalesce(F.sum("chunks"), F.lit(0)).alias("_lost"), F.count("*").alias("docs"))
    report = before.crossJoin(lost).select("before", (F.col("before") - F.col("_lost")).alias("after"), "docs")
    return chunks.join(gone.select("doc_id"), "doc_id", "left_anti"), report


def latest_versions(files: DataFrame) -> DataFrame:
    """Of versioned files of one folder and base name (version ARRAY) the highest, the first of equals by position; files without version stay."""
    w = Window.partitionBy("folder", F.lower("base")).orderBy(F.desc("version"), "position")
    ranked = files.filter(F.size("version") > 0).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return ranked.unionByName(files.filter(F.size("version") == 0))


def skip_folders(df: DataFrame, names: list[str], max_depth: int = 15, col: str = "path") -> DataFrame:
    """Rows whose path has none of ``names`` as a folder and is not deeper than ``max_depth``."""
    parts = F.split(col, "/")
    return df.filter(~F.arrays_overlap(parts, F.array(*map(F.lit, names))) & (F.size(parts) <= max_depth))


def source_hash(df: DataFrame, group: str, hash_col: str = "content_hash") -> DataFrame:
    """md5 of a group's non-empty hashes, sorted (copies kept) and joined by a bar."""
    some = F.filter(F.array_sort(F.collect_list(hash_col)), lambda h: h != "")
    return df.groupBy(group).agg(F.md5(F.array_join(some, "|").cast("binary")).alias("source_hash"))


def source_hash_parts(df: DataFrame, group: str, hash_col: str = "content_hash") -> DataFrame:
    """As `source_hash` for groups of any size: md5 of the sorted hashes that share their first three characters, and
    md5 over those digests in order."""
    part = F.when(F.col("_x") != "", F.concat("_x", F.md5(F.array_join(F.array_sort(F.collect_list(hash_col)), "|").cast("binary"))))
    parts = df.filter(F.col(hash_col).isNotNull()).withColumn("_x", F.substring(hash_col, 1, 3)).groupBy(group, "_x").agg(part.alias("_part"))
    return parts.groupBy(group).agg(F.md5(F.array_join(F.array_sort(F.collect_list("_part")), "|").cast("binary")).alias("source_hash"))


def fact_conflicts(facts: DataFrame) -> DataFrame:
    """fact_key, n_values, page_id, fact_value: a row for each page of keys that have more than one value over pages that
    aren't disabled; keys and values are compared without blanks and case; blank keys don't count."""
    plain = lambda c: F.lower(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", ""))
    some = facts.filter("status <> 'disabled'").select(plain("fact_key").alias("_k"), plain("fact_value").alias("_v"), "page_id", "fact_value").filter("_k <> ''")
    apart = some.select("_k", "_v").distinct().groupBy("_k").agg(F.count("*").alias("n_values")).filter("n_values > 1")
    return some.join(apart, "_k").select(F.col("_k").alias("fact_key"), "n_values", "page_id", "fact_value")


def collect_sources(questions: DataFrame, hits: DataFrame, per_question: int = 8, most: int = 25) -> DataFrame:
    """Per page the documents its questions (page_id, query_id) hit (query_id, doc_id, source, pos): each once, at
    its best place; pages themselves not; ``most`` at most."""
    found = questions.join(hits.filter((F.col("source") != "wiki") & (F.col("pos") < per_question)), "query_id")
    best = found.groupBy("page_id", "doc_id").agg(F.min(F.struct("pos", "query_id")).alias("_at"))
    w = Window.partitionBy("page_id").orderBy("_at", "doc_id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).drop("_at")


def stale_pages(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """pages (topic, source_hash, status) with state: rebuilt if ``sources`` (topic, source_hash) differ, missing
    if there are none, else unchanged; and was_approved."""
    now = sources.select("topic", F.col("source_hash").alias("_now"))
    state = F.when(F.col("_now").isNull(), "missing").when(F.col("_now") != F.col("source_hash"), "rebuilt").otherwise("unchanged")
    return pages.join(now, "topic", "left").select("topic", state.alias("state"), ((F.col("status") == "approved") & (state == "rebuilt")).alias("was_approved"))


def page_status(events: DataFrame) -> DataFrame:
    """page_id, status (the last event's; a rebuild makes a draft), indexed (not disabled)."""
    last = events.groupBy("page_id").agg(F.max_by("event", F.struct("ts", "event")).alias("_e"))
    status = F.when(F.col("_e") == "rebuilt", "draft").otherwise(F.col("_e"))
    return last.select("page_id", status.alias("status"), (status != "disabled").alias("indexed"))


def accept_pages(pages: DataFrame, least_sources: int = 3, least_chars: int = 200) -> DataFrame:
    """Adds reason why a page is not accepted, null if it is."""
    reason = F.when(F.col("n_sources") < least_sources, "too few sources").when(F.length(F.coalesce("content", F.lit(""))) < least_chars, "too short").when(~F.coalesce("content", F.lit("")).rlike(r"\[REF\d+\]"), "no citation")
    return pages.withColumn("reason", reason)


def question_index(pages: DataFrame) -> DataFrame:
    """A row a question of each page that isn't disabled: id, page_id, ordinal, question, topic."""
    some = pages.filter("status <> 'disabled'").select("page_id", "topic", F.posexplode("questions").alias("ordinal", "question"))
    return some.select(F.concat(F.lit("page-"), F.col("page_id").cast("string"), F.lit("-q-"), F.col("ordinal").cast("string")).alias("id"), "page_id", "ordinal", "question", "topic")


def replace_questions(index: DataFrame, pages: DataFrame) -> DataFrame:
    return index.join(pages.select("page_id"), "page_id", "left_anti").unionByName(question_index(pages))


def upsert_pages(pages: DataFrame, incoming: DataFrame) -> DataFrame:
    """Pages (topic, content, status, created_at, updated_at) after ``incoming`` (topic, content, ts, position): what
    comes in is a draft with the old creation time; of a topic that comes twice the last counts."""
    last = incoming.groupBy("topic").agg(F.max_by(F.struct("content", "ts"), "position").alias("_n"))
    both = pages.join(last, "topic", "full_outer")
    new = F.col("_n").isNotNull()
    return both.select("topic", F.coalesce("_n.content", "content").alias("content"), F.when(new, "draft").otherwise(F.col("status")).alias("status"), F.coalesce("created_at", "_n.ts").alias("created_at"), F.coalesce("_n.ts", "updated_at").alias("updated_at"))


def flag_existing(topics: DataFrame, pages: DataFrame) -> DataFrame:
    return topics.join(pages.select("topic", F.lit(True).alias("_has")), "topic", "left").withColumn("has_page", F.coalesce("_has", F.lit(False))).drop("_has")


def topic_candidates(questions: DataFrame, similarity: float = 0.4, least: int = 2, most: int = 15) -> DataFrame:
    """topic_id, size, samples: questions (query_id, q) that share words, directly or over others, as groups named by
    their smallest id."""
    words = questions.select("query_id", "q", F.array_sort(F.array_distinct(tokens_of(F.col("q")))).alias("words")).filter(F.size("words") > 0)
    sets = words.groupBy("words").agg(F.min("query_id").alias("node"))
    named = sets.join(alike_groups(sets, similarity), "node", "left").select("words", F.coalesce("label", "node").alias("topic_id"))
    first = F.row_number().over(Window.partitionBy("topic_id").orderBy("q", "query_id"))
    all_ = words.join(named, "words")
    sizes = all_.groupBy("topic_id").agg(F.count("*").alias("size")).filter(F.col("size") >= least).orderBy(F.desc("size"), "topic_id").limit(most)
    some = all_.select("topic_id", "query_id", "q").withColumn("_n", first).filter("_n <= 8").groupBy("topic_id").agg(F.array_sort(F.collect_list("q")).alias("samples"))
    return sizes.join(some, "topic_id").select("topic_id", "size", "samples")


def ab_summary(judged: DataFrame) -> DataFrame:
    """Per model: mean score, errors, mean and largest latency, cases won and tied (case_id, model, score, error, ms)."""
    best = F.max("score").over(Window.partitionBy("case_id"))
    ties = F.count_if(F.col("score") == F.col("_best")).over(Window.partitionBy("case_id"))
    some = judged.withColumn("_best", best).withColumn("_ties", ties)
    top = F.col("score") == F.col("_best")
    return some.groupBy("model").agg(F.avg(F.col("score").cast("double")).alias("mean_score"), F.count_if("error").alias("errors"), F.avg(F.col("ms").cast("double")).alias("mean_ms"), F.max("ms").alias("max_ms"), F.count_if(top & (F.col("_ties") == 1)).alias("wins"), F.count_if(top & (F.col("_ties") > 1)).alias("ties"))


def ndcg(ranked: DataFrame, k: int = 3) -> DataFrame:
    """Mean NDCG@k per ranker over cases that all rankers were judged on: (ranker, case_id, pos from 0, rel)."""
    case = Window.partitionBy("case_id")
    ok = ranked.withColumn("_ok", F.min(F.col("rel").isNotNull().cast("int")).over(case)).filter("_ok = 1")
    place = F.row_number().over(Window.partitionBy("ranker", "case_id").orderBy(F.desc("rel"), "pos")) - 1
    gain = lambda p: F.sum(F.when(p < k, F.col("rel") / F.log2(p + F.lit(2.0))).otherwise(0.0))
    per = ok.withColumn("_ideal", place).groupBy("ranker", "case_id").agg(gain(F.col("pos")).alias("_dcg"), gain(F.col("_ideal")).alias("_best"))
    return per.groupBy("ranker").agg(F.avg(F.when(F.col("_best") > 0, F.col("_dcg") / F.col("_best")).otherwise(0.0)).alias("ndcg"), F.count("*").alias("cases"))


