"""The property graph of issues, people, projects, labels and entities: nodes (id, type, label, meta) and edges
(src, dst, rel, meta)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import cut
from .needles import contains_join
from .sizes import held

#: Names and labels of an alias that meet in one key, about.
PART = 2_000, 2_000
#: Pairs that a task makes, about, and tasks at most.
PAIRS, TASKS = 2_000_000, 4_096
#: Aliases of one pass over labels. An automaton of so many of six letters takes 40 MB; `needles.BYTES` bounds longer ones.
ALIASES = 500_000
#: What open and closed mean, and the words that ask for them.
OPEN_STATUSES = ["Open", "To Do", "In Progress", "In Review", "Ready for Development", "Reopened", "Frozen"]
CLOSED_STATUSES = ["Closed", "Done", "Resolved"]
OPEN_WORDS = ["진행", "미완료", "오픈", "열려", "open", "todo", "to do"]
CLOSED_WORDS = ["완료", "닫힌", "종료", "해결", "close", "done", "resolve"]


def _node(id_: Column, type_: str, label: Column, meta: Column | None = None) -> Column:
    return F.struct(id_.alias("id"), F.lit(type_).alias("type"), label.alias("label"), (F.lit("{}") if meta is None else meta).alias("meta"))


def _edge(src: Column, dst: Column, rel: str, meta: Column | None = None) -> Column:
    return F.struct(src.alias("src"), dst.alias("dst"), F.lit(rel).alias("rel"), (F.lit("{}") if meta is None else meta).alias("meta"))


def _with_key(docs: DataFrame) -> DataFrame:
    return docs.filter(F.coalesce("issue_key", F.lit("")) != "").withColumn("issue_key", F.upper("issue_key"))


def issue_graph(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of issue rows: issue_key, project, title, status, assignee, reporter, labels ARRAY, links
    ARRAY<STRUCT<key, rel>>, created_at, position. A missing project is the key's own prefix. Nodes keep position."""
    d = _with_key(docs)
    d = d.withColumn("project", F.upper(F.coalesce(F.nullif("project", F.lit("")), F.get(F.split("issue_key", "-"), F.lit(0)))))
    me, project = F.concat(F.lit("issue:"), "issue_key"), F.concat(F.lit("project:"), "project")
    person = lambda c: F.concat(F.lit("person:"), F.trim(F.col(c)))
    has = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    labels = F.filter(F.transform(F.coalesce("labels", F.array()), lambda x: F.trim(x)), lambda x: x != "")
    meta = F.to_json(F.struct("project", "status", "assignee", "created_at"))
    nodes = F.concat(
        F.array(_node(me, "issue", F.coalesce("title", "issue_key"), meta), _node(project, "project", F.col("project"))),
        *[F.when(has(c), F.array(_node(person(c), "person", F.trim(c)))).otherwise(F.array()) for c in ("assignee", "reporter")],
        F.transform(labels, lambda x: _node(F.concat(F.lit("label:"), x), "label", x)),
    )
    edges = F.concat(
        F.array(_edge(project, me, "HAS_ISSUE")),
        *[F.when(has(c), F.array(_edge(me, person(c), rel))).otherwise(F.array()) for c, rel in (("assignee", "ASSIGNED_TO"), ("reporter", "REPORTED_BY"))],
        F.transform(labels, lambda x: _edge(me, F.concat(F.lit("label:"), x), "HAS_LABEL")),
        F.transform(F.coalesce("links", F.array()), lambda x: _edge(me, F.concat(F.lit("issue:"), F.upper(x["key"])), "LINKS_TO", F.to_json(F.struct(x["rel"].alias("link_type"))))),
    )
    return d.select("position", F.explode(nodes).alias("n")).select("n.*", "position"), d.select("position", F.explode(edges).alias("e")).select("e.*", "position")


def link_graph(docs: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of `issue_graph` that are issues and links between them, which is all that neighbours need: without
    meta, of issue rows (issue_key, title, position) and link rows (issue_key, key). Nodes keep position."""
    me, issue = F.concat(F.lit("issue:"), "issue_key"), F.lit("issue").alias("type")
    nodes = _with_key(docs).select(me.alias("id"), issue, F.coalesce("title", "issue_key").alias("label"), "position")
    return nodes, _with_key(links).select(me.alias("src"), F.concat(F.lit("issue:"), F.upper("key")).alias("dst"), F.lit("LINKS_TO").alias("rel"))


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """One row an id: the last by position for issues, the first for others."""
    order = F.struct(F.when(F.col("type") == "issue", -F.col("position")).otherwise(F.col("position")).alias("at"), "type", "label")
    rest = [c for c in nodes.columns if c not in ("id", "position")]
    return nodes.groupBy("id").agg(F.min_by(F.struct(*rest), order).alias("n")).select("id", "n.*").select([c for c in nodes.columns if c != "position"])


def merge_edges(edges: DataFrame) -> DataFrame:
    """One row a (src, dst, rel): the last by position."""
    return edges.groupBy("src", "dst", "rel").agg(F.max_by("meta", F.struct("position", "meta")).alias("meta"))


def placeholder_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` and a bare issue node for each link's target that isn't there."""
    gone = edges.filter("rel = 'LINKS_TO'").select(F.col("dst").alias("id")).distinct().join(nodes.select("id"), "id", "left_anti")
    bare = gone.select("id", F.lit("issue").alias("type"), F.regexp_replace("id", "^issue:", "").alias("label"), F.lit('{"placeholder":true}').alias("meta"))
    return nodes.unionByName(bare.select(nodes.columns))


def replace_types(nodes: DataFrame, edges: DataFrame, new_nodes: DataFrame, new_edges: DataFrame, types: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes of ``types`` and the edges that begin at them give way to the new ones; other parts stay."""
    old = nodes.filter(F.col("type").isin(types)).select("id")
    kept = nodes.filter(~F.col("type").isin(types)).join(new_nodes.select("id"), "id", "left_anti")
    kept_edges = edges.join(old.withColumnRenamed("id", "src"), "src", "left_anti").join(new_edges.select("src", "dst", "rel"), ["src", "dst", "rel"], "left_anti")
    return kept.unionByName(new_nodes), kept_edges.unionByName(new_edges)


def rebuild_graph(docs: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, stats) after all issues were built anew."""
    raw_nodes, raw_edges = issue_graph(docs)
    fresh_edges = merge_edges(raw_edges)
    fresh = placeholder_nodes(merge_nodes(raw_nodes), fresh_edges)
    nodes, edges = replace_types(nodes, edges, fresh, fresh_edges, ["issue", "project", "person", "label"])
    return nodes, edges, graph_counts(nodes, edges)


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.groupBy(F.lit("node").alias("kind"), F.col("type").alias("name")).agg(F.count("*").alias("n")).unionByName(edges.groupBy(F.lit("edge").alias("kind"), F.col("rel").alias("name")).agg(F.count("*").alias("n")))


def issues_with_edge(issues: DataFrame, edges: DataFrame, rels: list[str], dst: str) -> DataFrame:
    return issues.join(edges.filter(F.col("rel").isin(rels) & (F.col("dst") == dst)).select(F.col("src").alias("id")), "id", "left_semi")


def neighbours(edges: DataFrame, nodes: DataFrame, keys: DataFrame, meta: bool = True) -> DataFrame:
    """key, id, label, and a link's meta, of nodes linked with ``keys`` (column key), in both directions, once each; without
    ``meta`` a key has a node once, however many links there are.

    Links are made once, and distinct by both ends, so neither a key nor a node of many links is one task; the ends then
    change places."""
    more = ["meta"] if meta else []
    links = edges.filter("rel = 'LINKS_TO' AND src IS NOT NULL AND dst IS NOT NULL")
    pairs = links.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), *more).distinct()
    way = lambda key, id_: F.struct(F.col(key).alias("key"), F.col(id_).alias("id"))
    ways = pairs.select(F.explode(F.when(F.col("a") == F.col("b"), F.array(way("a", "b"))).otherwise(F.array(way("a", "b"), way("b", "a")))).alias("w"), *more)
    # ids have long beginnings in common, so that sorts for joins compare them whole; hashes come first
    hashed = lambda df, c: df.withColumn("_h", F.xxhash64(c))
    found = hashed(ways.select("w.*", *more), "key").join(hashed(keys, "key"), ["_h", "key"], "left_semi")
    return hashed(found, "id").join(hashed(nodes.select("id", "label"), "id"), ["_h", "id"]).select("id", "key", *more, "label")


def linked_issues(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    one = nodes.sparkSession.createDataFrame([(f"issue:{key}",)], "key string")
    return neighbours(edges, nodes, one, meta=False)


def link_mentions(nodes: DataFrame, entities: DataFrame, most: int = ALIASES) -> DataFrame:
    """src, dst: nodes (issue or doc) whose label has an entity's name or alias (name, alias) in it, by lower case;
    ``most`` aliases are looked for in one pass.

    Labels meet aliases first, and then an alias's labels its names, in a grid of parts of both, so that an alias of many
    labels and names is no single task; there are as many tasks as the pairs ask for. Only names of several aliases can
    give a pair twice."""
    some = nodes.filter(F.col("type").isin("issue", "doc")).select("id", F.lower("label").alias("_label"))
    alias = entities.select("name", F.lower("alias").alias("_alias")).filter(F.length("_alias") >= 2).distinct()
    alias = cut(alias.withColumn("_several", F.count("*").over(Window.partitionBy("name")) > 1), "aliases")
    found = cut(contains_join(some, alias.select("_alias").distinct(), "_label", "_alias", most).select("id", "_alias").distinct(), "found")
    names, labels = alias.groupBy("_alias").agg(F.count("*").alias("_names")), found.groupBy("_alias").agg(F.count("*").alias("_labels"))
    parts = [F.ceil(F.col(c) / n).alias(c) for c, n in zip(("_names", "_labels"), PART, strict=True)]
    grid = cut(names.join(labels, "_alias").select("_alias", *parts, (F.col("_names") * F.col("_labels")).alias("_pairs")), "grid")
    tasks = min(TASKS, 1 + (grid.agg(F.sum("_pairs")).first()[0] or 0) // PAIRS)
    grid, at = grid.drop("_pairs"), ["_alias", "_at", "_of"]
    part, all_parts = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)), lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = found.join(grid, "_alias").withColumn("_at", part("id", "_labels")).withColumn("_of", all_parts("_names")).select(F.col("id").alias("src"), *at)
    right = alias.join(grid, "_alias").withColumn("_of", part("name", "_names")).withColumn("_at", all_parts("_labels")).select(F.concat(F.lit("entity:"), "name").alias("dst"), "_several", *at)
    pairs = lambda several: left.repartition(tasks, *at).join(right.filter(F.col("_several") == several).drop("_several").repartition(tasks, *at), at).select("src", "dst")
    return pairs(False).unionByName(pairs(True).distinct())


def clean_entities(df: DataFrame) -> DataFrame:
    """name, aliases, is_active: no blank or repeated names (first by position), no aliases under 2 characters."""
    some = df.withColumn("name", F.trim("name")).filter(F.col("name") != "")
    one = some.withColumn("_n", F.row_number().over(Window.partitionBy("name").orderBy("position"))).filter("_n = 1")
    return one.select("name", F.filter(F.transform("aliases", lambda a: F.trim(a)), lambda a: F.length(a) >= 2).alias("aliases"), "is_active")


def rebuild_entities(entities: DataFrame, docs: DataFrame, nodes: DataFrame, edges: DataFrame, keep_docs: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with entity nodes (of name, alias), document nodes (id, label) and mention edges."""
    of_docs = docs.select(F.concat(F.lit("doc:"), "id").alias("id"), F.lit("doc").alias("type"), "label", F.lit("{}").alias("meta"))
    own = entities.select("name").distinct().select(F.concat(F.lit("entity:"), "name").alias("id"), F.lit("entity").alias("type"), F.col("name").alias("label"), F.lit("{}").alias("meta"))
    mentioned = link_mentions(nodes.filter("type = 'issue'").unionByName(of_docs), entities)
    fresh = own.unionByName(of_docs.join(mentioned.select(F.col("src").alias("id")), "id", "left_semi"))
    fresh_edges = mentioned.select("src", "dst", F.lit("MENTIONS").alias("rel"), F.lit("{}").alias("meta"))
    without = edges.filter("rel <> 'MENTIONS'")
    return replace_types(nodes, without, fresh, fresh_edges, ["entity"] if keep_docs else ["entity", "doc"])


def newest_mentions(mentions: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """Per (entity, type) the newest ``n`` mentioning nodes (created_at)."""
    w = Window.partitionBy("dst", "type").orderBy(F.desc_nulls_last("created_at"), "src")
    return mentions.join(nodes.withColumnRenamed("id", "src"), "src").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def detect_entities(queries: DataFrame, entities: DataFrame, max_n: int = 2) -> DataFrame:
    """query_id, name: entities one of whose aliases stands in the query as written; the longest first, ``max_n`` at most."""
    found = contains_join(queries, entities, "q", "alias")
    best = found.groupBy("query_id", "name").agg(F.max(F.length("alias")).alias("_len"))
    w = Window.partitionBy("query_id").orderBy(F.desc("_len"), "name")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max_n).drop("_len")


def status_predicate(df: DataFrame, word: str, col: str = "status") -> DataFrame:
    """Rows of the open or closed group that ``word`` asks for, else of a status like it; '' asks for nothing."""
    low = word.strip().lower()
    if not low:
        return df
    if any(w in low for w in OPEN_WORDS):
        return df.filter(F.col(col).isin(OPEN_STATUSES))
    if any(w in low for w in CLOSED_WORDS):
        return df.filter(F.col(col).isin(CLOSED_STATUSES))
    return df.filter(F.lower(col).contains(low))


def normalise_filter(queries: DataFrame) -> DataFrame:
    """Cleans project, assignee, label, status, days, keywords; rows without any condition are dropped."""
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    out = queries.withColumns({c: text(c) for c in ("project", "assignee", "label", "status")})
    out = out.withColumn("days", F.greatest(F.lit(0), F.coalesce(F.col("days").try_cast("int"), F.lit(0)))).withColumn("keywords", F.filter(F.coalesce("keywords", F.array()), lambda k: F.trim(F.coalesce(k, F.lit(""))) != ""))
    return out.filter((F.col("project") != "") | (F.col("assignee") != "") | (F.col("label") != "") | (F.col("status") != "") | (F.col("days") > 0) | (F.size("keywords") > 0))


def list_with_total(df: DataFrame, n: int = 50, newest: str = "created_at", id_col: str = "issue_key") -> DataFrame:
    """Newest ``n`` rows, with the number of all rows: one pass counts, one takes the top; no sort of everything."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(F.desc_nulls_last(newest), id_col).limit(n).crossJoin(F.broadcast(total))


def query_issues(issues: DataFrame, *, project: str = "", assignee: str = "", label: str = "", status: str = "", days: int = 0, keywords: tuple[str, ...] = (), now: str = "", n: int = 50) -> DataFrame:
    """Issues (issue_key, project, assignee, label, status, created_at, title) that meet all conditions, newest ``n`` with total."""
    for col, value in (("project", project), ("assignee", assignee), ("label", label)):
        if value:
            issues = issues.filter(F.lower(col) == value.lower())
    issues = status_predicate(issues, status)
    if days:
        issues = issues.filter(F.col("created_at") >= F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS"))
    for word in keywords[:5]:
        issues = issues.filter(F.lower("title").contains(word.lower()))
    return list_with_total(issues, n)


def list_answers(queries: DataFrame, issues: DataFrame, top: int = 5) -> DataFrame:
    """Per query (query_id, project, assignee, status group `open`, `closed` or '') condition, total, first keys and
    whether the answer is definite: rows were found, or project or assignee was given."""
    opened = F.when(F.col("status").isin(OPEN_STATUSES), "open").when(F.col("status").isin(CLOSED_STATUSES), "closed").otherwise("other")
    # an issue answers at most eight conditions: each of its three values, or none of it
    fields, either = ["project", "assignee", "status"], lambda c: F.explode(F.array(c, F.lit("")))
    asked = queries.select(*fields).distinct()
    own = issues.select("issue_key", "created_at", "project", "assignee", opened.alias("status"))
    for c in fields:
        own = own.withColumn(c, either(F.col(c)))
    hits = own.join(held(asked), fields, "left_semi")
    w = Window.partitionBy(*fields).orderBy(F.desc("created_at"), "issue_key")
    first = hits.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= top).groupBy(*fields).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "issue_key"))), lambda x: x["issue_key"]), ",").alias("first_keys"))
    totals = hits.groupBy(*fields).agg(F.count("*").alias("total"))
    out = queries.join(totals, fields, "left").join(first, fields, "left")
    condition = F.concat_ws(" ", F.nullif("project", F.lit("")), F.nullif("assignee", F.lit("")), F.nullif("status", F.lit("")))
    total = F.coalesce("total", F.lit(0))
    return out.select("query_id", condition.alias("condition"), total.alias("total"), F.coalesce("first_keys", F.lit("")).alias("first_keys"), ((total > 0) | (F.col("project") != "") | (F.col("assignee") != "")).alias("definite"))
