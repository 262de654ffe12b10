"""Text functions on columns: markup to text, question sections, chunk texts, identifiers, amounts, citations.

All are expressions that Catalyst compiles, but for the two that walk a tree of unbounded depth.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tags that begin and end a line, and the shape of lines that open or go on with a SQL statement.
BLOCK_TAGS = ["p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr", "br", "div", "section"]
SQL_START = r"(?i)^\s*(SELECT\b|INSERT\s+INTO\b|UPDATE\s+\w+\s+SET\b|DELETE\s+FROM\b|CREATE\s+(TABLE|INDEX|VIEW|DATABASE)\b|DROP\s+(TABLE|INDEX|VIEW)\b|ALTER\s+TABLE\b|TRUNCATE\b|EXPLAIN\s+SELECT\b|WITH\s+\w+\s+AS\s*\()"
SQL_MORE = r"(?i)^\s*(FROM|WHERE|JOIN|LEFT\s+JOIN|RIGHT\s+JOIN|INNER\s+JOIN|OUTER\s+JOIN|ON\b|GROUP\s+BY|ORDER\s+BY|HAVING|LIMIT|OFFSET|AND\b|OR\b|SET\b|VALUES\b|INTO\b|UNION\b|EXCEPT\b|INTERSECT\b)\b"
#: Entities that markup text decodes, `&amp;` last.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _tree_texts(node, out: list[str]) -> None:
    stack = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            if x.get("type") == "text":
                out.append(str(x.get("text", "")))
            kids = x.get("content")
            stack.extend(reversed(kids if isinstance(kids, list) else []))
        elif isinstance(x, list):
            stack.extend(reversed(x))


def _lines(node: dict) -> str:
    """Children's texts joined by newlines, empty ones left out, from the leaves up."""
    done: dict[int, str] = {}
    stack = [(node, False)]
    while stack:
        x, ready = stack.pop()
        kids = [k for k in x.get("content") or [] if isinstance(k, dict)] if isinstance(x.get("content"), list) else []
        if x.get("type") == "text":
            done[id(x)] = str(x.get("text", ""))
        elif ready:
            done[id(x)] = "\n".join(t for t in (done[id(k)] for k in kids) if t)
        else:
            stack.append((x, True))
            stack.extend((k, False) for k in kids)
    return done[id(node)]


def adf_text_spaces(json_col: Column | str) -> Column:
    """Text of a rich-text JSON tree, pieces joined by spaces; what is no `doc` stays as it is; null stays null."""

    @F.pandas_udf("string")
    def convert(col: pd.Series) -> pd.Series:
        def one(s):
            if s is None:
                return None
            try:
                node = json.loads(s)
            except ValueError:
                return s
            if not isinstance(node, dict) or node.get("type") != "doc":
                return s
            _tree_texts(node, out := [])
            return " ".join(out).strip()

        return col.map(one)

    return convert(_c(json_col))


def adf_text_lines(json_col: Column | str) -> Column:
    """Text of a rich-text JSON tree, children joined by newlines and empty ones left out; no object gives ''."""

    @F.pandas_udf("string")
    def convert(col: pd.Series) -> pd.Series:
        def one(s):
            try:
                node = json.loads(s) if s is not None else None
            except ValueError:
                node = None
            return _lines(node) if isinstance(node, dict) else ""

        return col.map(one)

    return convert(_c(json_col))


def _markup_steps(kind: str) -> list[tuple[str, str]]:
    tags = "|".join(BLOCK_TAGS)
    steps = [(r"(?s)<!--.*?-->", "")]
    if kind == "wiki":
        steps += [(r"(?s)<ac:plain-text-body[^>]*>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</ac:plain-text-body>", "\n$1\n"), (r"</?ac:[^>]*>", ""), (r"(?s)<ri:[^>]*?/>", ""), (r"(?s)<ri:[^>]*>.*?</ri:[^>]*>", "")]
    else:
        steps += [(r"(?s)<attachment[^>]*>.*?</attachment>", ""), (r"<img[^>]*>", "")]
    return [*steps, (rf"(?i)</?(?:{tags})(?:\s[^>]*)?/?>", "\n"), (r"(?i)</(?:td|th)>", "\t"), (r"<[^>]+>", " ")]


MARKUP_END = [(r"[ \t]+", " "), (r"\n{3,}", "\n\n")]


def _markup(text: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, put in steps:
        text = F.regexp_replace(text, pattern, put)
    for entity, put in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(put))
    for pattern, put in MARKUP_END:
        text = F.regexp_replace(text, pattern, put)
    return F.regexp_replace(text, r"\A[ \t\n\r]+|[ \t\n\r]+\z", "")


def markup_to_text(html: Column | str) -> Column:
    """Wiki storage markup to text: code bodies stay, block tags break lines, cells end in a blank; null gives ''."""
    return _markup(F.coalesce(_c(html), F.lit("")), _markup_steps("wiki"))


def message_html_to_text(html: Column | str) -> Column:
    """Message markup to text; what has no `<` is only trimmed; attachments and images go; null gives ''."""
    text = F.coalesce(_c(html), F.lit(""))
    return F.when(~text.contains("<"), F.regexp_replace(text, r"\A[ \t\n\r]+|[ \t\n\r]+\z", "")).otherwise(_markup(text, _markup_steps("message")))


def reply_html_to_text(html: Column | str, host: str = "example.org", folder: str = "/static/images/") -> Column:
    """As message text, with images from ``host`` replaced by a link to md5(address) at their place."""
    text = F.coalesce(_c(html), F.lit(""))
    mark = rf'(?i)<img[^>]*\ssrc="([^"]*{host}[^"]*)"[^>]*>'
    found = F.regexp_extract_all(text, F.lit(mark), 1)
    rest = F.split(text, mark)
    link = F.transform(F.sequence(F.lit(0), F.size(rest) - 1), lambda i: F.concat(F.get(rest, i), F.when(i < F.size(found), F.concat(F.lit(f"\n![image]({folder}"), F.md5(F.get(found, i)), F.lit(".png)\n"))).otherwise("")))
    return _markup(F.array_join(link, ""), _markup_steps("message"))


def card_text(attachments: Column | str) -> Column:
    """Non-blank TextBlock texts of adaptive cards in a JSON list of attachments, a line each."""
    kind = "application/vnd.microsoft.card.adaptive"
    cards = F.filter(F.from_json(_c(attachments), "array<struct<contentType: string, content: string>>"), lambda a: a["contentType"] == kind)
    bodies = F.flatten(F.transform(cards, lambda a: F.coalesce(F.from_json(a["content"], "struct<body: array<struct<type: string, text: string>>>")["body"], F.array())))
    texts = F.transform(F.filter(bodies, lambda b: b["type"] == "TextBlock"), lambda b: F.trim(F.coalesce(b["text"], F.lit(""))))
    return F.coalesce(F.array_join(F.filter(texts, lambda t: t != ""), "\n"), F.lit(""))


def question_section(text: Column | str, start: str = "**[Q]**", ends: tuple[str, ...] = ("**[", "[Reply by ")) -> Column:
    """What follows ``start``, up to the first of ``ends`` (by their order, not their place) that occurs; all if there is no ``start``."""
    text = _c(text)
    after = F.trim(F.substring(text, F.instr(text, start) + len(start), F.length(text)))
    cut = after
    for end in reversed(ends):
        cut = F.when(F.instr(after, end) > 0, F.trim(F.substring(after, F.lit(1), F.instr(after, end) - 1))).otherwise(cut)
    return F.when(F.instr(text, start) > 0, cut).otherwise(text)


def first_heading(text: Column | str, fallback: Column | str) -> Column:
    """First level-1 heading, else ``fallback``."""
    return F.coalesce(F.nullif(F.trim(F.regexp_extract(F.coalesce(_c(text), F.lit("")), r"(?m)^[ \t]*# ([^\n]*)$", 1)), F.lit("")), _c(fallback))


def strip_sql_fences(df: DataFrame, col: str = "text", strict: bool = False) -> DataFrame:
    """Takes out fences marked sql, and with ``strict`` also fences with a line that begins like SQL. Without it such
    fences stay here and their lines go in `strip_sql_lines`. Adds n_removed."""
    tagged = r"(?si)```\s*sql\b.*?```"
    text = F.coalesce(F.col(col), F.lit(""))
    out = df.withColumn("n_removed", F.regexp_count(text, F.lit(tagged))).withColumn(col, F.regexp_replace(text, tagged, ""))
    if strict:
        fenced = r"(?s)(```[^\n]*\n.*?```)"
        start = SQL_START.replace("(?i)^", "(?im)^")
        pieces, rest = F.regexp_extract_all(F.col(col), F.lit(fenced), 1), F.split(F.col(col), fenced)
        keep = F.transform(pieces, lambda p: F.when(p.rlike(start), F.lit("")).otherwise(p))
        joined = F.array_join(F.transform(F.sequence(F.lit(0), F.size(rest) - 1), lambda i: F.concat(F.get(rest, i), F.coalesce(F.get(keep, i), F.lit("")))), "")
        out = out.withColumn("n_removed", F.col("n_removed") + F.size(F.filter(pieces, lambda p: p.rlike(start)))).withColumn(col, joined)
    return out


def strip_sql_lines(df: DataFrame, col: str = "text") -> DataFrame:
    """Takes out each line that begins a SQL statement and the lines that go on with it (clauses, blank, comments).
    Adds n_removed, the number of first lines."""
    lines = F.split(F.coalesce(F.col(col), F.lit("")), "\n")
    zero = F.struct(F.lit(False).alias("on"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("kept"))

    def step(state: Column, line: Column) -> Column:
        begins, goes_on = line.rlike(SQL_START), (F.trim(line) == "") | line.rlike(SQL_MORE) | F.ltrim(line).startswith("--")
        inside = begins | (state["on"] & goes_on)
        return F.struct(inside.alias("on"), (state["n"] + begins.cast("int")).alias("n"), F.when(inside, state["kept"]).otherwise(F.array_append(state["kept"], line)).alias("kept"))

    done = df.withColumn("_s", F.aggregate(lines, zero, step))
    return done.withColumn(col, F.array_join("_s.kept", "\n")).withColumn("n_removed", F.col("_s.n")).drop("_s")


def embed_text(title: Column | str, content: Column | str) -> Column:
    title, content = F.coalesce(_c(title), F.lit("")), F.coalesce(_c(content), F.lit(""))
    return F.when(title != "", F.concat(title, F.lit("\n\n"), content)).otherwise(content)


def content_hash(text: Column | str) -> Column:
    return F.md5(_c(text).cast("binary"))


def chunk_id(doc_id: Column | str, ix: Column | str) -> Column:
    return F.concat(_c(doc_id), F.lit("-chunk-"), _c(ix).cast("string"))


def base_doc_id(chunk: Column | str) -> Column:
    return F.regexp_extract(_c(chunk), r"(?s)^(.*)-chunk-", 1)


def usable_content(text: Column | str) -> Column:
    """At least 10 characters and no left-over of a failed extraction."""
    junk = r"(?si)^(content not extracted|<systemEventMessage\s*/>|<p\s*/>|.*%%EOF\s*$|.*startxref\s+\d+\s*$)$"
    text = F.trim(F.coalesce(_c(text), F.lit("")))
    return (F.length(text) >= 10) & ~text.rlike(junk)


def file_version(name: Column | str) -> Column:
    """STRUCT<base, version>: base name and version numbers of a file name; an empty list is no version."""
    stem = F.regexp_replace(_c(name), r"(?<=.)\.[^.]*$", "")
    number = F.regexp_extract(stem, r"(?i)_v(?:er)?[\s._]?(\d+(?:\.\d+)*)", 1)
    base = F.trim(F.regexp_extract(stem, r"(?is)^(.*?)_v(?:er)?[\s._]?\d+", 1))
    version = F.transform(F.split(number, r"\."), lambda x: x.cast("int"))
    return F.when(number != "", F.struct(base.alias("base"), version.alias("version"))).otherwise(F.struct(stem.alias("base"), F.array().cast("array<int>").alias("version")))


def parse_links(links: Column | str) -> Column:
    """ARRAY<STRUCT<key, rel>> of `KEY-1 (rel), KEY-2`."""
    found = F.regexp_extract_all(F.coalesce(_c(links), F.lit("")), F.lit(r"([A-Z][A-Z0-9]+-\d+(?:\s*\([^)]*\))?)"), 1)
    return F.transform(found, lambda x: F.struct(F.regexp_extract(x, r"^([A-Z][A-Z0-9]+-\d+)", 1).alias("key"), F.trim(F.regexp_extract(x, r"\(([^)]*)\)", 1)).alias("rel")))


def strip_key_prefix(title: Column | str, key: Column | str) -> Column:
    title, mark = _c(title), F.concat(F.lit("["), _c(key), F.lit("]"))
    return F.when(F.startswith(title, mark), F.trim(F.substr(title, F.length(mark) + 1))).otherwise(title)


def quoted(text: Column) -> Column:
    """Percent-encoded, blanks as %20."""
    return F.replace(F.url_encode(F.coalesce(text, F.lit(""))), F.lit("+"), F.lit("%20"))


def message_url(df: DataFrame, tenant: str, site: str = "https://teams.microsoft.com/l") -> Column:
    """Deep link of a message: its url, else by team and channel, by chat, or ''. Needs url, source_id, team_id,
    team_name, channel_id, channel_name, chat_id."""
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    by_channel = F.concat(F.lit(f"{site}/message/"), "channel_id", F.lit("/"), "source_id", F.lit(f"?tenantId={tenant}&groupId="), "team_id", F.lit("&parentMessageId="), "source_id", F.lit("&teamName="), quoted(F.col("team_name")), F.lit("&channelName="), quoted(F.col("channel_name")))
    by_chat = F.concat(F.lit(f"{site}/message/"), "chat_id", F.lit("/"), "source_id", F.lit(f"?tenantId={tenant}&parentMessageId="), "source_id")
    chat = F.concat(F.lit(f"{site}/chat/"), "chat_id", F.lit(f"/0?tenantId={tenant}"))
    return F.when(has("url"), F.col("url")).when(has("team_id") & has("channel_id") & has("source_id"), by_channel).when(has("chat_id") & has("source_id"), by_chat).when(has("chat_id"), chat).otherwise("")


def display_name(df: DataFrame) -> Column:
    """Name to show for a document (source, url, title, key): key of an issue, file name of a file, else the title."""
    title = F.nullif(F.coalesce(F.col("title"), F.lit("")), F.lit(""))
    asked = F.element_at(F.split(F.url_decode(F.regexp_extract("url", r"[?&]file=([^&#]+)", 1)), "/"), -1)
    path = F.regexp_replace(F.regexp_extract("url", r"^[^:]+://[^/?#]*([^?#]*)", 1), "/+$", "")
    last = F.url_decode(F.element_at(F.split(path, "/"), -1))
    of_file = F.when(asked != "", asked).when((last != "") & ~F.lower(last).endswith(".aspx"), last)
    return (
        F.when(F.col("source") == "issue", F.coalesce(F.nullif("key", F.lit("")), title, F.lit("issue")))
        .when(F.col("source") == "file", F.coalesce(of_file, title, F.lit("file")))
        .otherwise(F.coalesce(title, F.col("source")))
    )


def source_label(df: DataFrame) -> Column:
    """One line on where a document is from: source, title, url, author and day."""
    some = lambda c: F.coalesce(F.col(c), F.lit(""))
    day = F.substring(F.coalesce(F.col("created_at").cast("string"), F.lit("")), 1, 10)
    plain = F.concat(F.lit("["), some("source"), F.lit("] title: "), some("title"), F.lit(" | url: "), some("url"))
    full = F.concat(plain, F.lit(" | author: "), some("author"), F.lit(" | date: "), day)
    return F.when(F.col("source").isin("issue", "page", "file"), full).otherwise(plain)


def format_amount(num: Column | str, big: str = "억 원", middle: str = "만 원", unit: str = "원") -> Column:
    """From 1e8: in units of 1e8, at most 2 decimals; from 1e4: whole units of 1e4; below: whole."""
    v = F.round(_c(num).cast("decimal(38,6)")).cast("decimal(38,0)")
    a, sign = F.abs(v).cast("double"), F.when(v < 0, "-").otherwise("")
    eok = F.regexp_replace(F.regexp_replace(F.format_number(a / 1e8, 2), r"0+$", ""), r"\.$", "")
    return F.when(a >= 1e8, F.concat(sign, eok, F.lit(big))).when(a >= 1e4, F.concat(sign, F.format_number(a / 1e4, 0), F.lit(middle))).otherwise(F.concat(sign, F.format_number(a, 0), F.lit(unit)))


def format_pct(ratio: Column | str) -> Column:
    r = _c(ratio)
    return F.when(r.isNotNull(), F.concat(F.when(r >= 0, "+").otherwise(""), F.format_number(r * 100, 1), F.lit("%")))


def lenient_json(text: Column | str) -> Column:
    """The JSON object from the first `{` to the last `}` as VARIANT; an empty object if there is none."""
    return F.coalesce(F.try_parse_json(F.regexp_extract(F.coalesce(_c(text), F.lit("")), r"(?s)(\{.*\})", 1)), F.parse_json(F.lit("{}")))


def split_page_facts(text: Column | str, mark: str = "---FACTS---") -> Column:
    """STRUCT<content, facts>: the page, and the facts (key, value, source) from the JSON list after ``mark``."""
    parts = F.split(F.coalesce(_c(text), F.lit("")), mark, 2)
    block = F.regexp_extract(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), r"(?s)(\[.*\])", 1)
    facts = F.filter(F.coalesce(F.from_json(block, "array<struct<key: string, value: string, source: string>>"), F.array()), lambda f: f["key"].isNotNull() & f["value"].isNotNull())
    return F.struct(F.trim(F.get(parts, F.lit(0))).alias("content"), facts.alias("facts"))


def finalize_answer(df: DataFrame, phrase: str, col: str = "answer", least: int = 40) -> DataFrame:
    """Adds is_no_answer: the text has ``phrase`` and besides it fewer than ``least`` characters; it is then the phrase
    alone. A phrase at the end of a real answer goes."""
    s = F.trim(F.coalesce(F.col(col), F.lit("")))
    rest = F.trim(F.replace(s, F.lit(phrase), F.lit("")))
    none = s.contains(phrase) & (F.length(rest) < least)
    cut = F.when(s.endswith(phrase), F.rtrim(F.substring(s, F.lit(1), F.length(s) - len(phrase)))).otherwise(s)
    return df.withColumn("is_no_answer", none).withColumn(col, F.when(none, phrase).otherwise(cut))


def flat_metadata(df: DataFrame, core: list[str], lists: list[str], meta: str = "metadata") -> DataFrame:
    """Adds meta: the open keys with non-null values, under the core columns as text and the list columns as JSON."""
    fixed = F.create_map(*[x for c in core for x in (F.lit(c), F.col(c).cast("string"))], *[x for c in lists for x in (F.lit(c), F.to_json(F.coalesce(F.col(c), F.array())))])
    own = F.map_filter(F.coalesce(F.col(meta), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda k, v: v.isNotNull() & ~k.isin(*core, *lists))
    return df.withColumn("meta", F.map_concat(own, F.map_filter(fixed, lambda k, v: v.isNotNull())))


def restore_lists(df: DataFrame, keys: dict[str, str], meta: str = "meta") -> DataFrame:
    """Columns of the named lists from their JSON in ``meta``; bad or no JSON is an empty list."""
    return df.withColumns({k: F.coalesce(F.from_json(F.col(meta)[k], kind), F.array().cast(kind)) for k, kind in keys.items()})


def merge_comments(comments: Column | str) -> Column:
    """`[Comment by author on day]` and body of each comment (author, created, body) whose body isn't blank."""
    some = F.filter(F.coalesce(_c(comments), F.array()), lambda c: F.trim(F.coalesce(c["body"], F.lit(""))) != "")
    return F.array_join(F.transform(some, lambda c: F.concat(F.lit("[Comment by "), F.coalesce(c["author"], F.lit("Unknown")), F.lit(" on "), F.substring(F.coalesce(c["created"], F.lit("")), 1, 10), F.lit("]\n"), F.trim(c["body"]))), "\n\n")


def merge_replies(df: DataFrame, hub: bool = False) -> DataFrame:
    """Adds merged: replies (author, created, body) of a message behind its body, each under a header line; with
    ``hub`` the reply bodies alone. Blank replies are left out."""
    some = F.filter(F.coalesce(F.col("replies"), F.array()), lambda r: F.trim(F.coalesce(r["body"], F.lit(""))) != "")
    if hub:
        return df.withColumn("merged", F.array_join(F.transform(some, lambda r: F.trim(r["body"])), "\n\n"))
    blocks = F.transform(some, lambda r: F.concat(F.lit("[Reply by "), F.coalesce(r["author"], F.lit("Unknown")), F.lit(" on "), F.substring(F.coalesce(r["created"], F.lit("")), 1, 10), F.lit("]\n"), F.trim(r["body"])))
    return df.withColumn("merged", F.array_join(F.concat(F.array(F.coalesce("body", F.lit(""))), blocks), "\n\n"))


def issue_content(df: DataFrame) -> DataFrame:
    """Adds content of an issue: description, a line for each of the fields that are set, comments; blank parts go."""
    line = lambda name, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{name}: "), F.col(c)))
    extra = F.nullif(F.concat_ws("\n", line("assignee", "assignee"), line("reporter", "reporter"), line("labels", "labels"), line("due", "due_date")), F.lit(""))
    return df.withColumn("content", F.concat_ws("\n\n", F.nullif("description", F.lit("")), extra, F.nullif("comments", F.lit(""))))


def page_markers(hits: DataFrame) -> DataFrame:
    """url, nums: slide numbers of presentations and page numbers of PDFs that hits (url, title, content) name."""
    title = F.lower(F.coalesce("title", F.lit("")))
    slide, page = (F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit(rf"\[{w} (\d+)\]"), 1) for w in ("Slide", "Page"))
    found = F.when(title.endswith(".pptx") | title.endswith(".ppt"), slide).when(title.endswith(".pdf"), page)
    one = hits.filter(F.coalesce("url", F.lit("")) != "").select("url", F.explode(found).alias("n"))
    return one.groupBy("url").agg(F.array_sort(F.collect_set(F.col("n").cast("int"))).alias("nums"))
