"""Retrieval for tables of questions: vector and keyword search, fusion, boosts, second-stage ranking, references.

A question is a row of ``queries`` (query_id, ...). Tables of questions are small beside the corpus; they are broadcast
when a count shows that they are few (`sizes.held`), and joined by shuffle otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunks import tokens_of
from .needles import contains_join
from .tops import top_by
from .vectors import nearest_in_lists

#: Fixed values of the fusion: rank offset, weight of hits by keyword only, largest fused score.
RRF_K, KEYWORD_ONLY = 60, 0.5
RRF_MAX = 2 / 61
SOURCE_WEIGHTS = {"jira": 0.95, "confluence": 0.85, "teams": 0.9, "sharepoint": 0.7, "local": 0.7, "docs": 0.5}


def vector_top_n_lsh(queries: DataFrame, vectors: DataFrame, n: int, bucket: float = 0.5, tables: int = 6, reach: float = 1.5) -> DataFrame:
    """As `vector_top_n` with l2, over candidates of a random-projection index, whose distances are exact. ``bucket`` and
    ``reach`` are multiples of the vectors' mean length. It promises no number of rows; `vectors.search_lists` does."""
    size = F.sqrt(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, v: s + v * v))
    mean = vectors.agg(F.avg(size).alias("m")).first()["m"] or 1.0
    own = vectors.select("chunk_id", "embedding", array_to_vector("embedding").alias("v"))
    asked = queries.select("query_id", "qvec", array_to_vector("qvec").alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=bucket * mean, numHashTables=tables, seed=1).fit(own)
    # a list is a bucket of a table; blocks of a bucket's vectors are compared as matrices, so no pair of rows is shuffled
    number = F.pmod(vector_to_array("_b")[0].cast("long") * tables + F.col("_t"), F.lit((1 << 31) - 1)).cast("int").alias("list")
    lists = lambda df, *c: model.transform(df).select(*c, F.posexplode("h").alias("_t", "_b")).select(*c, number)
    near = nearest_in_lists(lists(asked, "query_id", "qvec"), lists(own, "chunk_id", "embedding"), n)
    return top_by(near.filter(F.col("distance") < (reach * mean) ** 2), n, "distance", "chunk_id")


def substring_search(queries: DataFrame, chunks: DataFrame, n: int) -> DataFrame:
    """query_id, chunk_id, rank: chunks (chunk_id a text) that have a keyword in them, by the keyword's place in the query, then id.

    A query's first ``n`` are among the first ``n`` of each of its keywords by id, so no keyword hands on more."""
    keys = queries.select("query_id", F.posexplode("keywords").alias("_k", "kw")).filter("kw <> ''")
    found = contains_join(chunks.select("chunk_id", "text"), keys, "text", "kw", first=("chunk_id", n))
    hits = found.groupBy("query_id", "chunk_id").agg(F.min("_k").alias("_k"))
    return top_by(hits, n, "_k", "chunk_id").drop("_k")


def attach_chunks(hits: DataFrame, chunks: DataFrame, sources: list[str] | None = None, filter_first: bool = False) -> DataFrame:
    """Hits with their chunks' columns. The source filter comes after the cut to the best hits, unless ``filter_first``
    (then hits have to come uncut)."""
    side = chunks.filter(F.col("source").isin(sources)) if sources and filter_first else chunks
    out = hits.join(side, "chunk_id")
    return out.filter(F.col("source").isin(sources)) if sources and not filter_first else out


def merge_candidates(vec: DataFrame, kw: DataFrame) -> DataFrame:
    """query_id, chunk_id, v_rank, k_rank, distance over both lists of hits."""
    v = vec.select("query_id", "chunk_id", F.col("rank").alias("v_rank"), "distance")
    return v.join(kw.select("query_id", "chunk_id", F.col("rank").alias("k_rank")), ["query_id", "chunk_id"], "full_outer")


def merge_multi_query(hits: DataFrame) -> DataFrame:
    return hits.groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank"), F.min("distance").alias("distance"))


def rrf(candidates: DataFrame, k: int = RRF_K, kw_only: float = KEYWORD_ONLY) -> DataFrame:
    """Adds rrf: reciprocal ranks added up; hits by keyword only count less."""
    one = lambda c: F.coalesce(1.0 / (F.col(c) + (k + 1)), F.lit(0.0))
    return candidates.withColumn("rrf", F.when(F.col("v_rank").isNull(), one("k_rank") * kw_only).otherwise(one("v_rank") + one("k_rank")))


def apply_boosts(scored: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Multiplies rrf by the weight of each boolean column that is true."""
    score = F.col("rrf")
    for flag, w in weights.items():
        score = score * F.when(F.col(flag), w).otherwise(1.0)
    return scored.withColumn("rrf", score)


def recency_score(created: Column, now: str, half_life: Column | float) -> Column:
    # `greatest` would skip a null and take 0 days
    age = F.floor((F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(created.cast("timestamp"))) / 86_400_000_000)
    days = F.when(age > 0, age).when(age.isNotNull(), F.lit(0))
    return F.coalesce(F.pow(F.lit(2.0), -days / half_life), F.lit(0.5))


def recency_boost(scored: DataFrame, now: str, half_life: float = 30.0, issue_source: str = "jira") -> DataFrame:
    """Multiplies rrf by 1 + 2^(-days / half-life), half as long for issues; no date counts 0.5."""
    life = F.when(F.col("source") == issue_source, half_life / 2).otherwise(half_life)
    return scored.withColumn("rrf", F.col("rrf") * (1 + recency_score(F.col("created_at"), now, life)))


def weight_distance(hits: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Divides nothing and ranks nothing anew: the distance kept for references, by its source's weight."""
    w = F.coalesce(*[F.when(F.col("source") == s, x) for s, x in (weights or SOURCE_WEIGHTS).items()], F.lit(1.0))
    return hits.withColumn("distance", F.col("distance") / w)


def token_overlap(query: Column, text: Column) -> Column:
    """Share of a query's tokens that a text has: the built-in second-stage score."""
    q = F.array_distinct(tokens_of(query))
    return F.coalesce(F.size(F.array_intersect(q, tokens_of(text))).cast("double") / F.nullif(F.size(q), F.lit(0)), F.lit(0.0))


def rerank(hits: DataFrame, scorer: Callable[[Column, Column], Column] = token_overlap, top_n: int = 10, cut: int = 256) -> DataFrame:
    """The best ``top_n`` by rrf, ordered by rerank_score of (q, first ``cut`` characters of text); others are dropped."""
    best = top_by(hits, top_n, F.desc("rrf"), "chunk_id").drop("rank")
    scored = best.withColumn("rerank_score", F.round(scorer(F.col("q"), F.substring("text", 1, cut)), 6))
    return top_by(scored, top_n, F.desc("rerank_score"), F.desc("rrf"), "chunk_id")


def calibrate(hits: DataFrame, boost: float = 1.5, flag: str = "is_manual") -> DataFrame:
    """Adds calibrated: sigmoid of rerank_score, times ``boost`` for flagged rows; rank anew."""
    p = 1 / (1 + F.exp(-F.col("rerank_score"))) * F.when(F.col(flag), boost).otherwise(1.0)
    scored = hits.drop("rank").withColumn("calibrated", p)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("calibrated"), "chunk_id")) - 1)


def recency_ladder(hits: DataFrame, now: str, rungs: tuple[int, ...] = (30, 60, 90), least: int = 3, issue_source: str = "issue") -> DataFrame:
    """Issue hits of the first window with ``least`` of them (the last window counts in any case; ``days`` of the
    query, where set, instead); issues without date go; other hits stay. Adds window."""
    w = Window.partitionBy("query_id")
    issue = F.col("source") == issue_source
    age = F.floor((F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 86_400_000_000)
    within = lambda d: F.count_if(issue & (F.col("_age") <= d)).over(w)
    aged = hits.withColumn("_age", age)
    chosen = F.coalesce(F.col("days"), *[F.when(within(d) >= least, d) for d in rungs[:-1]], F.lit(rungs[-1]))
    return aged.withColumn("window", chosen).filter(~issue | (F.col("_age") <= F.col("window"))).drop("_age")


def dedup_documents(hits: DataFrame) -> DataFrame:
    """Each document's best chunk (by rrf): documents are told apart by url, else doc_id, else title; hits without
    any of them stay."""
    key = F.coalesce(F.nullif("url", F.lit("")), F.nullif(F.col("doc_id").cast("string"), F.lit("")), F.nullif("title", F.lit("")))
    keyed = hits.withColumn("_key", key)
    n = F.row_number().over(Window.partitionBy("query_id", "_key").orderBy(F.desc("rrf"), "chunk_id"))
    return keyed.withColumn("_n", n).filter(F.col("_key").isNull() | (F.col("_n") == 1)).drop("_key", "_n")


def dominance_gate(hits: DataFrame, flag: str, ratio: float = 2.0) -> DataFrame:
    """Per query the top hit and whether it passes: it is flagged, and its rrf at least ``ratio`` times the second's."""
    w = Window.partitionBy("query_id").orderBy(F.desc("rrf"), "chunk_id")
    top = hits.withColumn("_n", F.row_number().over(w)).withColumn("_next", F.lead("rrf").over(w)).filter("_n = 1")
    return top.withColumn("passes", F.col(flag) & (F.col("_next").isNull() | (F.col("rrf") >= ratio * F.col("_next")))).drop("_n", "_next")


def build_references(hits: DataFrame, listing: bool = False, most: int = 10, reach: float = 0.35, fallback: int = 3, hidden_source: str = "docs") -> DataFrame:
    """References in order: priority hits first, others within ``reach``; without any priority hit the first
    ``fallback`` whatever their distance. One a url and an issue key, at most ``most`` (half more for listings);
    ``hidden_source`` never. hits: query_id, pos, priority, distance, url, issue_key, source."""
    q = Window.partitionBy("query_id")
    some = hits.filter((F.col("source") != hidden_source) & (F.coalesce("url", F.lit("")) != ""))
    some = some.withColumn("_any", F.max(F.col("priority").cast("int")).over(q)).withColumn("_near", F.col("priority") | (F.col("distance") <= reach))
    some = some.filter((F.col("_any") == 0) | F.col("_near"))
    order = [F.desc("priority"), F.col("pos")]
    own = F.coalesce("issue_key", F.concat(F.lit("url:"), "url"))
    some = some.withColumn("_u", F.row_number().over(Window.partitionBy("query_id", "url").orderBy(*order))).filter("_u = 1")
    some = some.withColumn("_own", own).withColumn("_k", F.row_number().over(Window.partitionBy("query_id", "_own").orderBy(*order))).filter("_k = 1")
    # a far hit comes in while fewer than ``fallback`` were taken: those before it are near ones and far ones that came in
    rank = F.row_number().over(q.orderBy(*order))
    some = some.withColumn("_p", rank).filter(F.col("_near") | (F.col("_p") <= fallback))
    return some.withColumn("ref", F.row_number().over(q.orderBy(*order))).filter(F.col("ref") <= (most * 3 // 2 if listing else most)).drop("_any", "_near", "_u", "_own", "_k", "_p")


def inject_by_key(queries: DataFrame, hits: DataFrame, chunks: DataFrame, per_key: int = 5) -> DataFrame:
    """query_id, chunk_id, injected, pos: chunks of the issue keys named in a query (at most ``per_key`` a key) stand
    first; hits that are there already are only marked."""
    keys = queries.select("query_id", F.explode(F.array_distinct(F.regexp_extract_all("q", F.lit(r"\b([A-Z][A-Z0-9]*-\d+)\b"), 1))).alias("issue_key"))
    named = keys.join(chunks.select("chunk_id", "issue_key"), "issue_key")
    named = named.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "issue_key").orderBy("chunk_id"))).filter(F.col("_n") <= per_key)
    marked = hits.select("query_id", "chunk_id", F.col("rank")).join(named.select("query_id", "chunk_id", F.lit(True).alias("_in")).distinct(), ["query_id", "chunk_id"], "full_outer")
    pos = F.row_number().over(Window.partitionBy("query_id").orderBy(F.when(F.col("rank").isNull(), 0).otherwise(1), "rank", "chunk_id")) - 1
    return marked.select("query_id", "chunk_id", F.coalesce("_in", F.lit(False)).alias("injected"), pos.alias("pos"))


def prepend(injected: DataFrame, hits: DataFrame) -> DataFrame:
    """Injected rows before hits, the order of each kept (pos)."""
    both = injected.withColumn("_seg", F.lit(0)).unionByName(hits.withColumn("_seg", F.lit(1)))
    return both.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("_seg", "pos", "chunk_id")) - 1).drop("_seg")


def inject_entities(found: DataFrame, mentions: DataFrame, hits: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """query_id, doc_id, type, rank: documents that mention the entities found in a query (query_id, name), newest
    first, per type at most ``limits``; those hit already and placeholders are left out. mentions: name, doc_id,
    type, created_at, placeholder."""
    caps = limits or {"manual": 2, "issue": 3, "doc": 2}
    some = found.select("query_id", "name").join(mentions.filter("NOT placeholder"), "name").join(hits.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    one = some.groupBy("query_id", "name", "type", "doc_id").agg(F.max("created_at").alias("created_at"))
    w = Window.partitionBy("query_id", "name", "type").orderBy(F.desc("created_at"), "doc_id")
    cap = F.coalesce(*[F.when(F.col("type") == t, n) for t, n in caps.items()], F.lit(0))
    return one.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= cap).drop("created_at")


def substitute_pages(hits: DataFrame, pages: DataFrame, cut: int = 4000) -> DataFrame:
    """Hits on a page's questions get the page's text; those whose page is disabled or gone are dropped."""
    p = pages.select("page_id", F.col("content").alias("_content"), F.col("status").alias("_status"))
    out = hits.join(p, "page_id", "left").filter(~F.col("is_page") | (F.col("_status").isNotNull() & (F.col("_status") != "disabled")))
    return out.withColumn("text", F.when(F.col("is_page"), F.substring("_content", 1, cut)).otherwise(F.col("text"))).drop("_content", "_status")


def compare_references(hits: DataFrame, refs: DataFrame, reach: float = 0.35, share: float = 0.1) -> DataFrame:
    """Adds verdict: cited, missed (relevant and near, not cited) or other."""
    known = refs.select("query_id", "doc_id", F.lit(True).alias("_cited")).distinct()
    relevant = F.col("rrf") >= share * RRF_MAX
    out = hits.join(known, ["query_id", "doc_id"], "left")
    return out.withColumn("verdict", F.when(F.col("_cited"), "cited").when(relevant & (F.col("distance") <= reach), "missed").otherwise("other")).drop("_cited")


def resolve_citations(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, pos, name of the hits (pos from 0, name) that an answer's [REFn] marks name."""
    marks = answers.select("query_id", F.explode(F.array_distinct(F.regexp_extract_all("answer", F.lit(r"\[REF(\d+)\]"), 1))).alias("n"))
    return marks.select("query_id", (F.col("n").cast("int") - 1).alias("pos")).join(hits.select("query_id", "pos", "name"), ["query_id", "pos"])


def render_citations(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """Adds rendered: [REFn] becomes a link to hit n (pos n - 1: name, url), nothing if there is none; a bare [KEY-1]
    that no link follows gets the address of a hit on that key (issue_key)."""
    by_pos = hits.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct((F.col("pos") + 1).cast("string"), F.when(F.coalesce("url", F.lit("")) != "", F.concat(F.lit("["), "name", F.lit("]("), "url", F.lit(")"))).otherwise(F.col("name"))))).alias("_refs"))
    first = hits.filter("issue_key IS NOT NULL").groupBy("query_id", "issue_key").agg(F.min_by("url", "pos").alias("url"))
    by_key = first.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("issue_key", F.when(F.coalesce("url", F.lit("")) != "", F.concat(F.lit("["), "issue_key", F.lit("]("), "url", F.lit(")")))))).alias("_keys"))
    out = answers.join(by_pos, "query_id", "left").join(by_key, "query_id", "left")

    def put(text: Column, mark: str, value: Callable[[Column], Column]) -> Column:
        found, rest = F.regexp_extract_all(text, F.lit(mark), 1), F.split(text, mark)
        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(rest) - 1), lambda i: F.concat(F.get(rest, i), F.when(i < F.size(found), value(F.get(found, i))).otherwise(""))), "")

    text = put(F.col("answer"), r"\[REF(\d+)\]", lambda n: F.coalesce(F.col("_refs")[n], F.lit("")))
    out = out.withColumn("rendered", text)
    return out.withColumn("rendered", put(F.col("rendered"), r"\[([A-Z]+-\d+)\](?!\()", lambda k: F.coalesce(F.col("_keys")[k], F.concat(F.lit("["), k, F.lit("]"))))).drop("_refs", "_keys")


def active_reply(hits: DataFrame, replies: DataFrame) -> DataFrame:
    """Hits with the active reply of their document (doc_id, reply, is_active)."""
    return hits.join(replies.filter("is_active").select("doc_id", "reply"), "doc_id", "left")


def assemble_context(hits: DataFrame) -> DataFrame:
    """query_id, context: numbered blocks of label and text in order of pos."""
    block = F.concat(F.lit("[REF"), (F.col("pos") + 1).cast("string"), F.lit("] "), "label", F.lit("\n"), "text")
    return hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("context"))


def assemble_sources(docs: DataFrame, cut: int = 1200) -> DataFrame:
    """page_id, block: title, source and day, and the first ``cut`` characters of each source (rank, title, source, day, content)."""
    block = F.concat(F.lit("# "), "title", F.lit(" ("), "source", F.lit(", "), F.col("day").cast("string"), F.lit(")\n"), F.substring("content", 1, cut))
    return docs.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("block"))


def compact_hits(hits: DataFrame) -> DataFrame:
    return hits.select([c for c in hits.columns if c not in ("text", "content", "embedding", "qvec")])


def sort_recent(df: DataFrame, col: str = "created_at", id_col: str = "id") -> DataFrame:
    return df.orderBy(F.desc_nulls_last(col), id_col)


def hit_report(hits: DataFrame) -> DataFrame:
    """Adds relevance_pct (share of the largest fused score) and found_by."""
    by = F.concat_ws("+", F.when(F.col("v_rank").isNotNull(), "vector"), F.when(F.col("k_rank").isNotNull(), "keyword"))
    return hits.withColumn("relevance_pct", F.col("rrf") / RRF_MAX * 100).withColumn("found_by", by)


def route(queries: DataFrame) -> DataFrame:
    """Adds route: chat, list, hub, page or context, by flags is_question, is_aggregate, has_filter, hub_passes, page_passes."""
    r = F.when(~F.col("is_question"), "chat").when(F.col("is_aggregate") & F.col("has_filter"), "list").when(F.col("hub_passes"), "hub").when(F.col("page_passes"), "page").otherwise("context")
    return queries.withColumn("route", r)
