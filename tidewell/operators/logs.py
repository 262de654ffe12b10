"""The question log: turns, sessions, dashboards, retention, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def append_history(df: DataFrame) -> DataFrame:
    """Adds ref_count and sources (distinct, in order) from refs ARRAY<STRUCT<source, ...>>."""
    refs = F.coalesce(F.col("refs"), F.array())
    return df.withColumn("ref_count", F.size(refs)).withColumn("sources", F.array_distinct(F.transform(refs, lambda r: r["source"])))


def collection_dates(docs: DataFrame, sources: list[str]) -> DataFrame:
    """source, last: newest created_at of each of ``sources``, null where there is none."""
    wanted = docs.sparkSession.createDataFrame([(s,) for s in sources], "source string")
    newest = docs.filter(F.col("source").isin(sources)).groupBy("source").agg(F.max("created_at").alias("last"))
    return wanted.join(newest, "source", "left")


def clean_access_log(df: DataFrame) -> DataFrame:
    """Adds ip (first forwarded address, else the peer's, else -) and cuts user_agent to 300 characters."""
    first = F.trim(F.get(F.split(F.coalesce("xff", F.lit("")), ","), F.lit(0)))
    ip = F.coalesce(F.nullif(first, F.lit("")), F.nullif("peer", F.lit("")), F.lit("-"))
    return df.withColumn("ip", ip).withColumn("user_agent", F.substring(F.coalesce("user_agent", F.lit("")), 1, 300))


def purge(df: DataFrame, ts_col: str, days: int, now: str) -> DataFrame:
    return df.filter(F.col(ts_col) >= F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS"))


def search_log(df: DataFrame, *, no_answer: bool | None = None, feedback: int | None = None, date_from: str | None = None, date_to: str | None = None, contains: str | None = None) -> DataFrame:
    """Rows that meet all given conditions; ``date_to`` is inclusive to the end of its day."""
    terms = []
    if no_answer is not None:
        terms.append(F.col("is_no_answer") == int(no_answer))
    if feedback is not None:
        terms.append(F.col("feedback") == feedback)
    if date_from:
        terms.append(F.col("created_at") >= F.lit(date_from).cast("timestamp_ntz"))
    if date_to:
        terms.append(F.col("created_at") < F.lit(date_to).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY"))
    if contains:
        terms.append(F.col("question").contains(contains))
    for t in terms:
        df = df.filter(t)
    return df


def clean_questions(log: DataFrame, now: str, days: int = 90, n: int = 200) -> DataFrame:
    """Newest ``n`` distinct questions of the last ``days``: over 8 characters, no address, no session marker."""
    recent = purge(log, "created_at", days, now).filter((F.length(F.trim("question")) > 8) & ~F.lower("question").startswith("http") & ~F.col("question").contains("[session"))
    last = recent.groupBy(F.trim("question").alias("question")).agg(F.max("created_at").alias("created_at"))
    return last.orderBy(F.desc("created_at"), "question").limit(n)


def log_totals(log: DataFrame, now: str, days: int = 14) -> DataFrame:
    rate = lambda a, b: F.when(b > 0, a.cast("double") / b)
    one = purge(log, "created_at", days, now).agg(
        F.count("*").alias("total"),
        F.avg(F.col("response_time_ms").cast("double")).alias("mean_ms"),
        F.count_if(F.col("is_no_answer") == 1).alias("no_answer"),
        F.count_if(F.col("feedback") == 1).alias("up"),
        F.count_if(F.col("feedback") == -1).alias("down"),
    )
    return one.withColumn("success_rate", F.coalesce(rate(F.col("total") - F.col("no_answer"), F.col("total")), F.lit(0.0))).withColumn("satisfaction", rate(F.col("up"), F.col("up") + F.col("down")))


def hourly(log: DataFrame) -> DataFrame:
    return log.groupBy(F.hour("created_at").alias("hour")).agg(F.count("*").alias("total"), F.count_if(F.col("is_no_answer") == 0).alias("answered"))


def daily(log: DataFrame) -> DataFrame:
    return log.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("total"), F.count_if(F.col("is_no_answer") == 0).alias("answered"))


def today_totals(log: DataFrame, now: str, offset_hours: int = 9) -> DataFrame:
    """Rows of the day of ``now`` (UTC) in a zone ``offset_hours`` ahead."""
    local = lambda c: F.to_date(c + F.expr(f"INTERVAL {offset_hours} HOURS"))
    same = local(F.col("created_at")) == local(F.lit(now).cast("timestamp_ntz"))
    return log.filter(same).agg(F.count("*").alias("total"), F.count_if(F.col("is_no_answer") == 1).alias("no_answer"), F.count_if(F.col("feedback") == 1).alias("up"), F.count_if(F.col("feedback") == -1).alias("down"))


def source_counts(log: DataFrame, col: str = "refs_json") -> DataFrame:
    """source, n over a JSON list column of sources."""
    return log.select(F.explode(F.from_json(col, "array<string>")).alias("source")).groupBy("source").agg(F.count("*").alias("n"))


def session_rollup(log: DataFrame) -> DataFrame:
    """Per session: first question, turns, latest time, largest feedback, whether any answer was missing."""
    return log.groupBy("session_id").agg(
        F.min_by("question", F.struct("created_at", "id")).alias("root_question"),
        F.count("*").alias("turns"),
        F.max("created_at").alias("latest"),
        F.max("feedback").alias("feedback"),
        F.max("is_no_answer").alias("any_no_answer"),
    )


def number_turns(log: DataFrame) -> DataFrame:
    """Adds turn_index (from 0), parent_id and group_feedback: the session's last feedback that isn't 0."""
    order = Window.partitionBy("session_id").orderBy("created_at", "id")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.last(F.nullif("feedback", F.lit(0)), ignorenulls=True).over(every)
    return log.withColumn("turn_index", F.row_number().over(order) - 1).withColumn("parent_id", F.lag("id").over(order)).withColumn("group_feedback", F.coalesce(last, F.lit(0)))


def last_turn(log: DataFrame) -> DataFrame:
    return log.withColumn("_n", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("id")))).filter("_n = 1").drop("_n")


def apply_feedback(log: DataFrame, feedback: DataFrame) -> DataFrame:
    """``feedback``: id or session_id, rating, ts. The last rating of a key counts; a record's own beats its session's."""
    last = F.max_by("rating", "ts")
    own = feedback.filter("id IS NOT NULL").groupBy("id").agg(last.alias("_own"))
    group = feedback.filter("id IS NULL AND session_id IS NOT NULL").groupBy("session_id").agg(last.alias("_group"))
    return log.join(own, "id", "left").join(group, "session_id", "left").withColumn("feedback", F.coalesce("_own", "_group", "feedback")).drop("_own", "_group")


def page(df: DataFrame, order: list[Column], page_no: int, size: int) -> DataFrame:
    """Rows of page ``page_no`` (from 1) with total and pages (at least 1). Deep pages cost a sort of all before
    them; `page_after` goes on from a key."""
    sums = df.agg(F.count("*").alias("total")).withColumn("pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long"))
    return df.orderBy(*order).offset((page_no - 1) * size).limit(size).crossJoin(F.broadcast(sums))


def page_after(df: DataFrame, key: str, after, size: int) -> DataFrame:
    rows = df if after is None else df.filter(F.col(key) > after)
    return rows.orderBy(key).limit(size)


def recent_negative(log: DataFrame, n: int = 20) -> DataFrame:
    return log.filter(F.col("feedback") == -1).orderBy(F.desc("created_at"), F.desc("id")).limit(n).withColumn("preview", F.substring("question", 1, 200))


def session_detail(log: DataFrame, session_ids: list[str]) -> DataFrame:
    """Per session the ordered turns and the first row's feedback."""
    some = log.filter(F.col("session_id").isin(session_ids))
    turn = F.struct("created_at", "id", "question", "feedback")
    out = some.groupBy("session_id").agg(F.array_sort(F.collect_list(turn)).alias("_t"))
    return out.select("session_id", F.transform("_t", lambda t: t["question"]).alias("questions"), F.get("_t", F.lit(0))["feedback"].alias("feedback"))


def calls_last_minute(calls: DataFrame, limit: int = 30) -> DataFrame:
    """Adds calls in the 60 s up to each call, per client, and whether they pass ``limit`` (0 or less: never)."""
    w = Window.partitionBy("client_id").orderBy("_us").rangeBetween(-60_000_000, 0)
    timed = calls.withColumn("_us", F.unix_micros(F.col("created_at").cast("timestamp")))
    return timed.withColumn("n_minute", F.count("*").over(w)).withColumn("over_limit", (F.col("n_minute") > limit) & F.lit(limit > 0)).drop("_us")


def calls_with_client(calls: DataFrame, clients: DataFrame) -> DataFrame:
    return calls.join(clients, "client_id", "left")


def pair_turns(msgs: DataFrame) -> DataFrame:
    """question, answer: a user's message and the assistant's right after it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    nxt = msgs.withColumn("_role", F.lead("role").over(w)).withColumn("answer", F.lead("text").over(w))
    return nxt.filter("role = 'user' AND _role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


def conversation_tail(msgs: DataFrame, n: int) -> DataFrame:
    return msgs.withColumn("_n", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).filter(F.col("_n") <= n).drop("_n")


def transcripts(msgs: DataFrame, cut: int = 500) -> DataFrame:
    """Per conversation its lines in order, `Q: ` or `A: ` and the text; answers cut."""
    line = F.when(F.col("role") == "user", F.concat(F.lit("Q: "), "text")).otherwise(F.concat(F.lit("A: "), F.substring("text", 1, cut)))
    return msgs.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("transcript"))


def reply_versions(replies: DataFrame) -> DataFrame:
    """(id, doc_id, question, reply, created_at) with doc_id of the question's first reply, version (1 the newest) and
    is_active."""
    first = F.first("doc_id").over(Window.partitionBy("question").orderBy("created_at", "id"))
    moved = replies.withColumn("doc_id", first)
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("created_at"), F.desc("id")))
    return moved.withColumn("version", n).withColumn("is_active", F.col("version") == 1)


def eval_questions(log: DataFrame, now: str, n: int) -> DataFrame:
    return clean_questions(log.filter("is_no_answer = 0"), now, n=n)
