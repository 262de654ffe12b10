"""Sources and sinks: JSON exports, file listings, markdown trees; chunk tables that are upserted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import card_text, first_heading, issue_content, markup_to_text, merge_comments, merge_replies, message_html_to_text, question_section
from ..operators.chunks import diff_chunks, latest_by
from ..shared import cut
from .versions import Version, bucket_of, commit, latest, read, upsert, write

DOCUMENT = "id string, source string, source_id string, url string, title string, content string, content_type string, created_at string, updated_at string, author string, metadata map<string, string>"


def read_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects) of JSON lines: blank lines don't count, broken ones and those without id or content are
    rejects with a reason."""
    raw = spark.read.schema(f"{DOCUMENT}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    reason = F.when(F.col("_corrupt").isNotNull(), "malformed").when(F.coalesce("id", F.lit("")) == "", "no id").when(F.coalesce("content", F.lit("")) == "", "no content")
    marked = raw.withColumn("reason", reason)
    return marked.filter("reason IS NULL").drop("_corrupt", "reason"), marked.filter("reason IS NOT NULL").select("id", "reason", "_corrupt")


def read_issue_docs(spark: SparkSession, path: str) -> DataFrame:
    """Documents of JSON lines; broken lines are dropped."""
    return spark.read.schema(DOCUMENT).option("mode", "DROPMALFORMED").json(path)


ISSUE = (
    "id string, key string, fields struct<summary: string, description: string, created: string, updated: string, duedate: string, "
    "assignee: struct<displayName: string>, reporter: struct<displayName: string>, labels: array<string>, issuetype: struct<name: string>, status: struct<name: string>, priority: struct<name: string>, "
    "comment: struct<comments: array<struct<author: struct<displayName: string>, created: string, body: string>>>, "
    "issuelinks: array<struct<type: struct<name: string, inward: string, outward: string>, inwardIssue: struct<key: string>, outwardIssue: struct<key: string>>>, attachment: array<struct<filename: string>>>"
)


def flatten_issues(raw: DataFrame, col: str = "json") -> DataFrame:
    """A document row for each issue of a JSON column; issues without fields are dropped."""
    f = raw.select(F.from_json(col, ISSUE).alias("i")).filter("i.fields IS NOT NULL").select("i.id", "i.key", "i.fields.*")
    comments = F.transform(F.coalesce("comment.comments", F.array()), lambda c: F.struct(c["author"]["displayName"].alias("author"), c["created"].alias("created"), c["body"].alias("body")))
    linked = F.filter(F.coalesce("issuelinks", F.array()), lambda x: x["outwardIssue"].isNotNull() | x["inwardIssue"].isNotNull())
    links = F.transform(linked, lambda x: F.concat(F.coalesce(x["outwardIssue"]["key"], x["inwardIssue"]["key"]), F.lit(" ("), F.coalesce(F.when(x["outwardIssue"].isNotNull(), x["type"]["outward"]).otherwise(x["type"]["inward"]), x["type"]["name"], F.lit("")), F.lit(")")))
    parts = f.select(
        "id",
        "key",
        "summary",
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("assignee.displayName", F.lit("")).alias("assignee"),
        F.coalesce("reporter.displayName", F.lit("")).alias("reporter"),
        F.array_join(F.coalesce("labels", F.array()), ", ").alias("labels"),
        F.substring(F.coalesce("duedate", F.lit("")), 1, 10).alias("due_date"),
        merge_comments(comments).alias("comments"),
        F.array_join(links, ", ").alias("linked_issues"),
        F.array_join(F.filter(F.transform(F.coalesce("attachment", F.array()), lambda a: a["filename"]), lambda n: F.coalesce(n, F.lit("")) != ""), ", ").alias("attachments"),
        F.coalesce("issuetype.name", F.lit("Unknown")).alias("issue_type"),
        F.coalesce("status.name", F.lit("Unknown")).alias("status"),
        F.coalesce("priority.name", F.lit("None")).alias("priority"),
        "created",
        "updated",
    )
    return issue_content(parts).select(
        F.concat(F.lit("issue-"), "id").alias("id"),
        F.lit("issue").alias("source"),
        F.col("key").alias("issue_key"),
        F.concat(F.lit("["), "key", F.lit("] "), F.coalesce("summary", F.lit("No Summary"))).alias("title"),
        "content",
        F.col("created").alias("created_at"),
        F.col("updated").alias("updated_at"),
        F.when(F.col("reporter") != "", F.col("reporter")).otherwise("Unknown").alias("author"),
        "issue_type",
        "status",
        "priority",
        F.when(F.col("assignee") != "", F.col("assignee")).otherwise("Unassigned").alias("assignee"),
        "labels",
        "due_date",
        "linked_issues",
        "attachments",
    )


def flatten_wiki_pages(raw: DataFrame, least: int = 50) -> DataFrame:
    """Document rows of wiki pages (id, title, body markup, ancestors ARRAY<STRUCT<title>>); texts under ``least`` characters are dropped."""
    titles = F.filter(F.transform(F.coalesce("ancestors", F.array()), lambda a: a["title"]), lambda t: F.coalesce(t, F.lit("")) != "")
    out = raw.select(F.concat(F.lit("page-"), F.col("id").cast("string")).alias("id"), F.lit("page").alias("source"), "title", markup_to_text("body").alias("content"), F.array_join(titles, " / ").alias("ancestors"))
    return out.filter(F.length("content") >= least)


def flatten_messages(raw: DataFrame, hub_team: str | None = None, least: int = 50) -> DataFrame:
    """Document rows of channel messages (id, team, kind, subject, user, app, body markup, cards JSON, created, replies
    ARRAY<STRUCT<author, created, body>>). Only kind `message`; the author falls back from user to application; an
    empty body falls back to its cards. Messages of ``hub_team`` need replies and keep the question alone."""
    text = message_html_to_text("body")
    body = F.when(text != "", text).otherwise(card_text("cards"))
    kept = raw.filter(F.col("kind") == "message").withColumn("author", F.coalesce("user", "app", F.lit("Unknown"))).withColumn("body", body)
    hub = F.coalesce(F.col("team") == F.lit(hub_team), F.lit(False))
    replied = F.size(F.coalesce("replies", F.array())) > 0
    kept = merge_replies(kept.filter(F.when(hub, replied).otherwise(F.length("body") >= least)))
    kept = merge_replies(kept.withColumnRenamed("merged", "plain"), hub=True)
    return kept.select(
        F.concat(F.lit("message-"), F.col("id").cast("string")).alias("id"),
        F.lit("message").alias("source"),
        F.coalesce(F.nullif("subject", F.lit("")), F.concat(F.lit("Message in "), "team")).alias("title"),
        F.when(hub, question_section("body")).otherwise(F.col("plain")).alias("content"),
        F.when(hub, F.col("merged")).alias("hub_reply"),
        "author",
        F.col("created").alias("created_at"),
        F.size(F.coalesce("replies", F.array())).alias("reply_count"),
    )


def flatten_chat(raw: DataFrame, least: int = 50) -> DataFrame:
    """Document rows of direct-chat messages (id, kind, topic, author, body, created)."""
    out = raw.filter(F.col("kind") == "message").withColumn("content", message_html_to_text("body")).filter(F.length("content") >= least)
    title = F.concat(F.lit("Chat"), F.when(F.coalesce("topic", F.lit("")) != "", F.concat(F.lit(" "), "topic")).otherwise(""), F.lit(" - "), F.coalesce("author", F.lit("Unknown")))
    return out.select(F.concat(F.lit("chat-"), F.col("id").cast("string")).alias("id"), F.lit("chat").alias("source"), title.alias("title"), "content", "author", F.col("created").alias("created_at"))


#: Extensions that a text parser is for, and those read as they are.
PARSED = [".docx", ".pptx", ".xlsx", ".pdf"]
PLAIN = [".txt", ".md", ".csv", ".json", ".html"]


def route_files(listing: DataFrame, cap: int = 50 * 1024 * 1024) -> DataFrame:
    """Adds route: text, binary (a parser), too_large, unsupported; and the content placeholder for the last two."""
    name = F.lower("name")
    any_of = lambda exts: F.exists(F.array(*map(F.lit, exts)), lambda e: F.endswith(name, e))
    route = F.when(~(any_of(PARSED) | any_of(PLAIN)), "unsupported").when(F.col("size_bytes") > cap, "too_large").when(any_of(PLAIN), "text").otherwise("binary")
    return listing.withColumn("route", route).withColumn("placeholder", F.when(F.col("route").isin("unsupported", "too_large"), F.concat(F.lit("content not extracted: "), "name")))


def read_markdown_tree(spark: SparkSession, root: str, subdirs: list[str] | None = None, least: int = 50) -> DataFrame:
    """rel_path, title, content, category, updated_at of all *.md below ``root``; no READMEs, none under ``least`` characters."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load([f"{root}/{d}" for d in subdirs] if subdirs else root)
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + root.rstrip("/").removeprefix("file://") + "/", "")
    text = found.select(rel.alias("rel_path"), F.col("content").cast("string").alias("content"), F.col("modificationTime").alias("updated_at"))
    text = text.filter(~F.lower(F.element_at(F.split("rel_path", "/"), -1)).startswith("readme") & (F.length(F.trim("content")) >= least))
    stem = F.regexp_extract("rel_path", r"([^/]+)\.md$", 1)
    return text.select("rel_path", first_heading("content", stem).alias("title"), "content", F.regexp_extract("rel_path", r"^(.*)/[^/]+$", 1).alias("category"), "updated_at")


def union_sources(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


#: Buckets of a chunk table.
BUCKETS = 64


def unique_chunks(incoming: DataFrame) -> DataFrame:
    """One row of each chunk_id: the newest by ``updated_at`` where there is such a column, then of the greatest hash of its
    content, then of all its other columns (those that can be hashed). Rows without chunk_id are left out."""
    plain = [c.name for c in incoming.schema if "map<" not in c.dataType.simpleString() and c.dataType.simpleString() != "variant"]
    order = [F.desc_nulls_last(c) for c in ("updated_at", "content_hash") if c in incoming.columns]
    return latest_by(incoming.filter("chunk_id IS NOT NULL"), ["chunk_id"], *order, F.xxhash64(*plain))


def upsert_chunks(spark: SparkSession, root: str, incoming: DataFrame) -> DataFrame:
    """Puts new and changed chunks (chunk_id, content_hash, meta, ...) into the table below ``root`` (`read_chunks`); of rows of
    one chunk_id the one of `unique_chunks`. Only buckets that hold changed chunks are written, into new folders, and one
    rename makes them count, so who reads meanwhile reads the table as it was. Returns chunk_id and action."""
    base, one = latest(spark, root), unique_chunks(incoming)
    stored = read(spark, root, base, "chunks") if base else spark.createDataFrame([], one.schema)
    diff = cut(diff_chunks(one, stored), "load-diff")
    changed = diff.filter("action <> 'skipped'").select(stored.columns)
    if base is None or not changed.isEmpty():
        commit(spark, root, base, {"chunks": upsert(spark, root, "chunks", base, changed, "chunk_id", BUCKETS)})
    return diff.select("chunk_id", "action")


def read_chunks(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    """The chunk table below ``root`` at its newest version, or at version ``number``."""
    version = latest(spark, root, number)
    if version is None:
        raise FileNotFoundError(f"no such table below {root}")
    return read(spark, root, version, "chunks")


def rebuild_collection(spark: SparkSession, root: str) -> int:
    """Writes all rows of the table below ``root`` anew, in as few files as they need, checks that none is missing, and makes
    them the next version, whose number it returns. The old version stays readable until `vacuum`."""
    base = latest(spark, root)
    old = read(spark, root, base, "chunks")
    tables = {"chunks": write(root, old, bucket_of("chunk_id", BUCKETS), ["chunk_id"])}
    before, after = old.count(), read(spark, root, Version(0, tables), "chunks").count()
    if before != after:
        raise ValueError(f"{before} rows became {after}")
    return commit(spark, root, base, tables).number


def evolve(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Adds missing columns and fills nulls of those that are there, from ``defaults``."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in defaults.items()})
