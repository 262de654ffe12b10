"""Queries of retrieval and of the corpus's state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import query_text as Q
from ..functions.embed import embedder, hashed_trigrams, with_vectors
from ..operators import corpus as K
from ..operators import keyword as W
from ..operators import retrieval as R
from ..operators import vectors as X
from ..operators.sizes import MOST, held, is_small
from .registry import Views, query
from .text_queries import _CHUNKS, _POST, _TERMS, _TOK, chunk_table

NOW = "2025-01-01 00:00:00"
_SRC = "CASE CAST(substr(chunk_id, 2, position('-' IN chunk_id) - 2) AS BIGINT) % 4 WHEN 0 THEN 'jira' WHEN 1 THEN 'confluence' WHEN 2 THEN 'sharepoint' ELSE 'docs' END"

# Vector hits, keyword hits and their fusion over documents: document i has the vector of row i % n.

_QV = "query_vectors"
_VEC = """vec AS (SELECT query_id, vec_id AS chunk_id, round(list_cosine_distance(qvec::DOUBLE[], embedding::DOUBLE[]), 9) AS distance FROM query_vectors, embeddings),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) - 1 AS rank FROM vec)"""


def vectors(v: Views):
    return v.embeddings.select(F.col("vec_id").alias("chunk_id"), "embedding")


@query("i01_vector_top_n", f"WITH {_VEC} SELECT query_id, chunk_id, distance, CAST(rank AS INTEGER) AS rank FROM vr WHERE rank < 15")
def _(v: Views):
    return X.vector_top_n(v.query_vectors, vectors(v), 15)


@query("f03_rank_hits", f"WITH {_VEC} SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank FROM vr WHERE rank < 5")
def _(v: Views):
    return X.vector_top_n(v.query_vectors, vectors(v), 5).select("query_id", "chunk_id", "rank")


@query("i02_vector_lsh")
def _(v: Views):
    return R.vector_top_n_lsh(v.query_vectors, vectors(v), 15)


def kept_lists(v: Views) -> str:
    return v.kept("lists", v.embeddings, lambda root: X.build_lists(v.spark, root, vectors(v)))


@query("i02_vector_lists")
def _(v: Views):
    return X.search_lists(v.spark, kept_lists(v), v.query_vectors, 15)


@query("i02_lists_promise", "SELECT count(*) AS questions, count(*) * least(15, (SELECT count(*) FROM embeddings)) AS found, true AS recall_reached FROM query_vectors")
def _(v: Views):
    """How many rows the inverted lists give, and whether they hold nine tenths of the exact nearest ones."""
    got = X.search_lists(v.spark, kept_lists(v), v.query_vectors, 15).select("query_id", "chunk_id", F.lit(True).alias("by_lists"))
    exact = X.vector_top_n(v.query_vectors, vectors(v), 15, "l2").select("query_id", "chunk_id", F.lit(True).alias("exact"))
    both = got.join(exact, ["query_id", "chunk_id"], "full_outer")
    return both.agg(F.count_distinct("query_id").alias("questions"), F.count("by_lists").alias("found"), (F.count_if(F.col("by_lists") & F.col("exact")) >= 0.9 * F.count("exact")).alias("recall_reached"))


@query("h03_merge_multi_query", f"WITH {_VEC}, t AS (SELECT query_id % 5 AS query_id, chunk_id, rank, distance FROM vr WHERE rank < 15) SELECT query_id, chunk_id, CAST(min(rank) AS INTEGER) AS rank, min(distance) AS distance FROM t GROUP BY 1, 2")
def _(v: Views):
    return R.merge_multi_query(X.vector_top_n(v.query_vectors, vectors(v), 15).withColumn("query_id", F.col("query_id") % 5))


def asked(v: Views):
    return v.queries_v.select("query_id", "q", F.transform(Q.extract_keywords("q"), lambda k: F.lower(k)).alias("keywords"))


_KW = f"""kw0 AS (SELECT query_id, regexp_extract_all(q, '([가-힣A-Za-z0-9]+)', 1) AS w FROM queries_v), kw1 AS (SELECT query_id, unnest(w) AS t, unnest(range(len(w))) AS i FROM kw0),
kw2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY length(t) DESC, i) AS n FROM kw1 WHERE length(t) >= 2 AND regexp_matches(t, '^[가-힣a-zA-Z]')),
kws AS (SELECT DISTINCT query_id, array_to_string({_TERMS.format('t')}, ' ') AS kw FROM kw2 WHERE n <= 3)"""
# keywords are phrases of terms, the last one a prefix; p has the places of all terms
_BM = f"""kj AS (SELECT kw, t, j, m FROM (SELECT kw, len(l) AS m, unnest(l) AS t, unnest(range(len(l))) AS j FROM (SELECT kw, string_split(kw, ' ') AS l FROM (SELECT DISTINCT kw FROM kws WHERE kw <> '')))),
ex AS (SELECT kw, j, m, term FROM (SELECT DISTINCT term FROM p) JOIN kj ON j = m - 1 AND starts_with(term, t) UNION ALL SELECT kw, j, m, t FROM kj WHERE j < m - 1),
oc AS (SELECT kw, chunk_id, pos - j AS s, any_value(doc_len) AS doc_len FROM p JOIN ex USING (term) GROUP BY kw, chunk_id, s, m HAVING count(*) = m),
tf AS (SELECT kw, chunk_id, count(*) AS tf, any_value(doc_len) AS doc_len FROM oc GROUP BY 1, 2),
st AS (SELECT count(DISTINCT chunk_id) AS n, (SELECT avg(d) FROM (SELECT chunk_id, any_value(doc_len) AS d FROM p GROUP BY 1)) AS a FROM p), df AS (SELECT kw, count(*) AS df FROM tf GROUP BY 1),
sc AS (SELECT query_id, chunk_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * doc_len / a))), 9) AS score FROM tf JOIN df USING (kw) JOIN kws USING (kw), st GROUP BY 1, 2),
br AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM sc)"""


# and with two words in a row, the second of them cut, as one keyword
_KW2 = _KW + """, kwp AS (SELECT query_id, lower(regexp_extract(q, '[A-Za-z]{3,} [A-Za-z]{3}')) AS kw FROM queries_v)"""
_KW2 = _KW2.replace("kws AS (", "kwo AS (") + ", kws AS (SELECT query_id, kw FROM kwo UNION SELECT query_id, kw FROM kwp WHERE kw <> '')"


def chunk_index(v: Views) -> W.KeywordIndex:
    return v.kept_index("chunks", chunk_table(v))


@query("i03_bm25_search", f"WITH {_CHUNKS}, {_POST}, {_KW2}, {_BM} SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM br WHERE rank < 10")
def _(v: Views):
    phrase = F.regexp_extract("q", "[A-Za-z]{3,} [A-Za-z]{3}", 0)
    asks = asked(v).withColumn("keywords", F.concat("keywords", F.array(F.regexp_replace(phrase, " ", "-"))))
    return W.bm25_search(asks, chunk_index(v), 10).withColumn("score", F.round("score", 6))


# every twentieth issue is looked for by its key, among the titles of all

_ISSUES = f"""ch AS (SELECT issue_key AS chunk_id, '[' || issue_key || '] ' || title || ' (' || assignee || ')' AS text FROM issues), {_POST},
kws AS (SELECT issue_no AS query_id, array_to_string({_TERMS.format('k')}, ' ') AS kw FROM (SELECT issue_no, unnest([issue_key, assignee]) AS k FROM issues WHERE issue_no % 20 = 0))"""


@query("i03_issue_key_search", f"WITH {_ISSUES}, {_BM} SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM br WHERE rank < 5")
def _(v: Views):
    title = F.concat(F.lit("["), "issue_key", F.lit("] "), "title", F.lit(" ("), "assignee", F.lit(")"))
    index = W.index_of(v.issues.select(F.col("issue_key").alias("chunk_id"), title.alias("text")))
    asks = v.issues.filter("issue_no % 20 = 0").select(F.col("issue_no").alias("query_id"), F.array("issue_key", "assignee").alias("keywords"))
    return W.bm25_search(asks, index, 5).withColumn("score", F.round("score", 6))


@query("i04_substring_search", "WITH h AS (SELECT query_id, id AS chunk_id, min(k) AS k FROM (SELECT query_id, unnest([substr(q, 1, 6), substr(q, 8, 5)]) AS kw, unnest([0, 1]) AS k FROM queries_v) JOIN corpus_docs ON contains(content, kw) GROUP BY 1, 2) SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY k, chunk_id) - 1 AS INTEGER) AS rank FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY k, chunk_id) <= 10")
def _(v: Views):
    q = v.queries_v.select("query_id", F.array(F.substring("q", 1, 6), F.substring("q", 8, 5)).alias("keywords"))
    return R.substring_search(q, v.corpus_docs.select(F.col("id").alias("chunk_id"), F.col("content").alias("text")), 10)


@query("d03_attach_chunks", f"WITH {_CHUNKS}, {_POST}, {_KW}, {_BM} SELECT query_id, br.chunk_id, ch.source FROM br JOIN ch USING (chunk_id) WHERE rank < 10 AND ch.source IN ('src0', 'src1', 'src2')")
def _(v: Views):
    c = chunk_table(v)
    return R.attach_chunks(W.bm25_search(asked(v), chunk_index(v), 10), c.select("chunk_id", "source"), ["src0", "src1", "src2"]).select("query_id", "chunk_id", "source")


# Candidates of both searches over all documents and all vectors; document i has vector i.

_HITS = f"""hv AS (SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) - 1 AS rank
FROM (SELECT q.vec_id AS query_id, 'd' || e.vec_id AS chunk_id, round(list_cosine_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS distance FROM embeddings q JOIN queries_v ON query_id = q.vec_id, embeddings e)) WHERE rank < 12),
hk AS (WITH ch AS (SELECT id AS chunk_id, content AS text FROM corpus_docs), {_POST}, {_KW}, {_BM} SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank FROM br WHERE rank < 12),
cand AS (SELECT coalesce(hv.query_id, hk.query_id) AS query_id, coalesce(hv.chunk_id, hk.chunk_id) AS chunk_id, hv.rank AS v_rank, hk.rank AS k_rank, hv.distance FROM hv FULL JOIN hk ON hv.query_id = hk.query_id AND hv.chunk_id = hk.chunk_id),
fused AS (SELECT *, CASE WHEN v_rank IS NULL THEN 0.5::DOUBLE / (k_rank + 61) ELSE 1.0::DOUBLE / (v_rank + 61) + coalesce(1.0::DOUBLE / (k_rank + 61), 0) END AS rrf FROM cand),
hits AS (SELECT f.*, d.source AS lang_source, CASE CAST(substr(chunk_id, 2) AS BIGINT) % 3 WHEN 0 THEN 'jira' WHEN 1 THEN 'page' ELSE 'docs' END AS source, CAST(substr(chunk_id, 2) AS BIGINT) AS no, d.title, d.created_at, d.content AS text FROM fused f JOIN corpus_docs d ON d.id = f.chunk_id)"""


def candidates(v: Views):
    asks = v.queries_v.join(v.embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec")), "query_id")
    vecs = v.embeddings.select(F.concat(F.lit("d"), F.col("vec_id").cast("string")).alias("chunk_id"), "embedding")
    whole = v.corpus_docs.select(F.col("id").alias("chunk_id"), F.col("content").alias("text"))
    return R.merge_candidates(X.vector_top_n(asks, vecs, 12), W.bm25_search(asked(v), v.kept_index("documents", whole), 12))


def hits(v: Views):
    no = F.substring("chunk_id", 2, 20).cast("long")
    d = v.corpus_docs.select(F.col("id").alias("chunk_id"), "title", "created_at", F.col("content").alias("text"))
    kind = F.when(no % 3 == 0, "jira").when(no % 3 == 1, "page").otherwise("docs")
    return R.rrf(candidates(v)).join(d, "chunk_id").withColumn("no", no).withColumn("source", kind)


@query("d04_merge_candidates", f"WITH {_HITS} SELECT query_id, chunk_id, v_rank, k_rank FROM cand")
def _(v: Views):
    return candidates(v).select("query_id", "chunk_id", "v_rank", "k_rank")


@query("i05_rrf", f"WITH {_HITS} SELECT query_id, chunk_id, rrf FROM fused")
def _(v: Views):
    return R.rrf(candidates(v)).select("query_id", "chunk_id", "rrf")


@query("g02_top_k", f"WITH {_HITS} SELECT query_id, chunk_id FROM fused QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, chunk_id) <= 3")
def _(v: Views):
    return R.top_by(R.rrf(candidates(v)), 3, F.desc("rrf"), "chunk_id").select("query_id", "chunk_id")


@query("i06_apply_boosts", f"WITH {_HITS} SELECT query_id, chunk_id, rrf * CASE WHEN source = 'page' THEN 3.0 ELSE 1.0 END * CASE WHEN source = 'docs' THEN 4.0 ELSE 1.0 END AS rrf FROM hits")
def _(v: Views):
    h = hits(v).withColumn("is_page", F.col("source") == "page").withColumn("is_manual", F.col("source") == "docs")
    return R.apply_boosts(h, {"is_page": 3.0, "is_manual": 4.0}).select("query_id", "chunk_id", "rrf")


@query("i07_recency_boost", f"WITH {_HITS} SELECT query_id, chunk_id, round(rrf * (1 + CASE WHEN no % 5 = 0 THEN 0.5 ELSE pow(2.0, -(DATE '2025-01-01' - CAST(created_at AS DATE)) / CASE WHEN source = 'jira' THEN 15.0 ELSE 30.0 END) END), 12) AS rrf FROM hits")
def _(v: Views):
    h = hits(v).withColumn("created_at", F.when(F.col("no") % 5 != 0, F.col("created_at")))
    return R.recency_boost(h, NOW).select("query_id", "chunk_id", F.round("rrf", 12).alias("rrf"))


@query("i08_weight_distance", f"WITH {_HITS} SELECT query_id, chunk_id, distance / CASE source WHEN 'jira' THEN 0.95 WHEN 'docs' THEN 0.5 ELSE 1.0 END::DOUBLE AS distance FROM hits WHERE distance IS NOT NULL")
def _(v: Views):
    return R.weight_distance(hits(v)).filter("distance IS NOT NULL").select("query_id", "chunk_id", "distance")


_OVER = f"(len(list_intersect(list_distinct({_TOK.format('q')}), {_TOK.format('substr(text, 1, 256)')})) / CAST(len(list_distinct({_TOK.format('q')})) AS DOUBLE))"
_RR = f"""{_HITS}, top AS (SELECT h.*, q.q FROM hits h JOIN queries_v q USING (query_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, chunk_id) <= 10),
rr AS (SELECT *, round({_OVER}, 6) AS rerank_score FROM top)"""


def reranked(v: Views):
    return R.rerank(hits(v).join(held(v.queries_v), "query_id"))


@query("i09_rerank", f"WITH {_RR} SELECT query_id, chunk_id, rerank_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rrf DESC, chunk_id) - 1 AS INTEGER) AS rank FROM rr")
def _(v: Views):
    return reranked(v).select("query_id", "chunk_id", "rerank_score", "rank")


@query("i10_calibrate", f"WITH {_RR}, c AS (SELECT *, round(1 / (1 + exp(-rerank_score)) * CASE WHEN source = 'docs' THEN 1.5 ELSE 1.0 END, 9) AS calibrated FROM rr) SELECT query_id, chunk_id, calibrated FROM c")
def _(v: Views):
    return R.calibrate(reranked(v).withColumn("is_manual", F.col("source") == "docs")).select("query_id", "chunk_id", F.round("calibrated", 9).alias("calibrated"))


@query("i11_recency_ladder", f"""WITH {_HITS}, a AS (SELECT *, DATE '2024-02-20' - CAST(created_at AS DATE) AS age FROM hits),
w AS (SELECT *, CASE WHEN count(*) FILTER (source = 'jira' AND age <= 30) OVER (PARTITION BY query_id) >= 3 THEN 30 WHEN count(*) FILTER (source = 'jira' AND age <= 40) OVER (PARTITION BY query_id) >= 3 THEN 40 ELSE 50 END AS window_days FROM a)
SELECT query_id, chunk_id, window_days FROM w WHERE source <> 'jira' OR age <= window_days""")
def _(v: Views):
    h = hits(v).withColumn("days", F.lit(None).cast("int"))
    return R.recency_ladder(h, "2024-02-20 00:00:00", (30, 40, 50), issue_source="jira").select("query_id", "chunk_id", F.col("window").alias("window_days"))


@query("f05_dedup_documents", f"WITH {_HITS} SELECT query_id, arg_max(chunk_id, (rrf, -no)) AS chunk_id FROM hits GROUP BY query_id, no % 6 HAVING true UNION ALL SELECT NULL, NULL WHERE false")
def _(v: Views):
    h = hits(v).withColumn("url", F.when(F.col("no") % 2 == 0, F.concat(F.lit("u"), (F.col("no") % 6).cast("string")))).withColumn("doc_id", F.when(F.col("no") % 6 == 1, F.lit("d1")))
    h = h.withColumn("title", F.concat(F.lit("t"), (F.col("no") % 6).cast("string"))).withColumn("chunk_id", F.col("chunk_id"))
    h = h.withColumn("_tie", F.col("no")).withColumn("old_id", F.col("chunk_id")).withColumn("chunk_id", F.format_string("%018d", F.col("no")))
    return R.dedup_documents(h).select("query_id", F.col("old_id").alias("chunk_id"))


@query("f04_dominance_gate", f"WITH {_HITS}, o AS (SELECT query_id, source, rrf, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, chunk_id) AS n FROM hits) SELECT a.query_id, a.source = 'docs' AND a.rrf >= 1.02 * b.rrf AS passes FROM o a JOIN o b ON a.query_id = b.query_id AND a.n = 1 AND b.n = 2")
def _(v: Views):
    return R.dominance_gate(hits(v).withColumn("flag", F.col("source") == "docs"), "flag", 1.02).select("query_id", "passes")


@query("f08_build_references", f"""WITH {_HITS}, h AS (SELECT query_id, no, no % 4 = 0 AS priority, coalesce(distance, 0) AS distance, no % 9 AS url FROM hits WHERE source <> 'docs'),
k AS (SELECT * FROM h WHERE priority OR distance <= 0.1), u AS (SELECT *, row_number() OVER (PARTITION BY query_id, url ORDER BY priority DESC, no) AS u FROM k)
SELECT query_id, no, CAST(row_number() OVER (PARTITION BY query_id ORDER BY priority DESC, no) AS INTEGER) AS ref FROM u WHERE u = 1 AND query_id IN (SELECT query_id FROM h WHERE priority) QUALIFY ref <= 6""")
def _(v: Views):
    h = hits(v).select("query_id", "no", F.col("no").alias("pos"), (F.col("no") % 4 == 0).alias("priority"), F.coalesce("distance", F.lit(0.0)).alias("distance"), (F.col("no") % 9).cast("string").alias("url"), F.lit(None).cast("string").alias("issue_key"), "source")
    some = h.filter("source <> 'docs' AND priority").select("query_id").distinct()
    return R.build_references(h.join(some, "query_id", "left_semi"), most=6, reach=0.1).select("query_id", "no", "ref")


@query("d05_inject_by_key", f"""WITH {_HITS}, k AS (SELECT query_id, id AS chunk_id FROM queries_v, corpus_docs WHERE CAST(substr(id, 2) AS BIGINT) % 50 = query_id % 50 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY id) <= 2)
SELECT coalesce(k.query_id, hv.query_id) AS query_id, coalesce(k.chunk_id, hv.chunk_id) AS chunk_id, k.chunk_id IS NOT NULL AS injected FROM hv FULL JOIN k ON k.query_id = hv.query_id AND k.chunk_id = hv.chunk_id""")
def _(v: Views):
    q = v.queries_v.select("query_id", F.concat(F.lit("see AB-"), (F.col("query_id") % 50).cast("string"), F.lit(" now")).alias("q"))
    c = v.corpus_docs.select(F.col("id").alias("chunk_id"), F.concat(F.lit("AB-"), (F.substring("id", 2, 20).cast("long") % 50).cast("string")).alias("issue_key"))
    h = candidates(v).filter("v_rank IS NOT NULL").select("query_id", "chunk_id", F.col("v_rank").alias("rank"))
    return R.inject_by_key(q, h, c, 2).select("query_id", "chunk_id", "injected")


@query("h02_prepend", f"WITH {_HITS} SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s, r, chunk_id) - 1 AS INTEGER) AS pos FROM (SELECT 0 AS s, rank AS r, query_id, chunk_id FROM hk UNION ALL SELECT 1, rank, query_id, chunk_id FROM hv)")
def _(v: Views):
    c = candidates(v)
    a = c.filter("k_rank IS NOT NULL").select("query_id", "chunk_id", F.col("k_rank").alias("pos"))
    return R.prepend(a, c.filter("v_rank IS NOT NULL").select("query_id", "chunk_id", F.col("v_rank").alias("pos")))


@query("d15_inject_entities", """WITH f AS (SELECT query_id, name FROM (SELECT query_id, name, row_number() OVER (PARTITION BY query_id ORDER BY max(length(alias)) DESC, name) AS n FROM queries_v JOIN entities_v ON contains(q, alias) GROUP BY 1, 2) WHERE n <= 2),
m AS (SELECT DISTINCT e.name, d.id AS doc_id, CASE CAST(substr(d.id, 2) AS BIGINT) % 2 WHEN 0 THEN 'issue' ELSE 'doc' END AS type, d.created_at FROM corpus_docs d JOIN entities_v e ON contains(lower(d.title), lower(e.alias)))
SELECT query_id, name, type, doc_id FROM f JOIN m USING (name) WHERE CAST(substr(doc_id, 2) AS BIGINT) >= 20 QUALIFY row_number() OVER (PARTITION BY query_id, name, type ORDER BY created_at DESC, doc_id) <= CASE type WHEN 'issue' THEN 3 ELSE 2 END""")
def _(v: Views):
    from ..operators import graph as G

    found = G.detect_entities(v.queries_v, v.entities_v)
    d = v.corpus_docs
    links = G.link_mentions(d.select("id", F.lit("doc").alias("type"), F.col("title").alias("label")), v.entities_v)
    no = F.substring("doc_id", 2, 20).cast("long")
    m = links.select(F.regexp_replace("dst", "^entity:", "").alias("name"), F.col("src").alias("doc_id")).join(d.select(F.col("id").alias("doc_id"), "created_at"), "doc_id")
    m = m.withColumn("type", F.when(no % 2 == 0, "issue").otherwise("doc")).withColumn("placeholder", F.lit(False))
    hit = v.queries_v.select("query_id").crossJoin(F.broadcast(d.filter(F.substring("id", 2, 20).cast("long") < 20).select(F.col("id").alias("doc_id"))))
    return R.inject_entities(found, m, hit).select("query_id", "name", "type", "doc_id")


@query("d12_substitute_pages", f"WITH {_HITS}, p AS (SELECT DISTINCT page_id, status FROM page_facts) SELECT query_id, chunk_id, CASE WHEN source = 'page' THEN 'body ' || page_id ELSE text END AS text FROM hits LEFT JOIN p ON page_id = no % 12 WHERE source <> 'page' OR status <> 'disabled'")
def _(v: Views):
    pages = v.page_facts.select("page_id", "status").distinct().withColumn("content", F.concat(F.lit("body "), F.col("page_id").cast("string")))
    h = hits(v).withColumn("page_id", F.col("no") % 12).withColumn("is_page", F.col("source") == "page")
    return R.substitute_pages(h, pages).select("query_id", "chunk_id", "text")


@query("d13_compare_references", f"WITH {_HITS} SELECT query_id, chunk_id, CASE WHEN no % 7 = 0 THEN 'cited' WHEN rrf >= 0.1 * 2 / 61 AND distance <= 0.1 THEN 'missed' ELSE 'other' END AS verdict FROM hits")
def _(v: Views):
    h = hits(v).withColumn("doc_id", F.col("no"))
    return R.compare_references(h, h.filter("no % 7 = 0").select("query_id", "doc_id"), reach=0.1).select("query_id", "chunk_id", "verdict")


# answers are pieces of the questions with marks of hits, some of which there are not; the hits are the vector search's

_ANSWERS = """an AS (SELECT query_id, substr(q, 1, 30) || ' [REF' || (1 + query_id % 5) || '] ' || substr(q, 31, 20) || ' [REF2] and [REF' || (10 + query_id % 4) || ']' AS answer FROM queries_v),
nm AS (SELECT query_id, rank AS pos, title AS name FROM hv JOIN corpus_docs d ON d.id = chunk_id WHERE rank < 11)"""


def _answers(v: Views):
    n = F.col("query_id")
    return v.queries_v.select("query_id", F.concat(F.substring("q", 1, 30), F.lit(" [REF"), 1 + n % 5, F.lit("] "), F.substring("q", 31, 20), F.lit(" [REF2] and [REF"), 10 + n % 4, F.lit("]")).alias("answer"))


def _named(v: Views):
    none = F.lit(None).cast("string")
    return hits(v).filter("v_rank < 11").select("query_id", F.col("v_rank").alias("pos"), F.col("title").alias("name"), F.concat(F.lit("u"), F.col("no").cast("string")).alias("url"), none.alias("issue_key"))


@query("d14_resolve_citations", f"WITH {_HITS}, {_ANSWERS}, m AS (SELECT DISTINCT query_id, CAST(unnest(regexp_extract_all(answer, 'REF([0-9]+)', 1)) AS INTEGER) - 1 AS pos FROM an) SELECT query_id, pos, name FROM m JOIN nm USING (query_id, pos)")
def _(v: Views):
    return R.resolve_citations(_answers(v), _named(v))


@query("b37_render_citations", "SELECT query_id, 'a [n0](u0) b n2 c  d [AB-1](u1) e [AB-1](x) f [CD-2] g' AS rendered FROM queries_v")
def _(v: Views):
    marked = v.queries_v.select("query_id", F.lit("a [REF1] b [REF3] c [REF9] d [AB-1] e [AB-1](x) f [CD-2] g").alias("answer"))
    places = v.queries_v.select("query_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("pos"))
    named = places.select("query_id", "pos", F.concat(F.lit("n"), F.col("pos").cast("string")).alias("name"), F.when(F.col("pos") != 2, F.concat(F.lit("u"), F.col("pos").cast("string"))).alias("url"), F.when(F.col("pos") == 1, "AB-1").alias("issue_key"))
    return R.render_citations(marked, named).select("query_id", "rendered")


@query("c17_compact_hits", f"WITH {_HITS} SELECT query_id, chunk_id, rrf FROM hits")
def _(v: Views):
    return R.compact_hits(hits(v).select("query_id", "chunk_id", "rrf", "text"))


@query("i15_hit_report", f"WITH {_HITS} SELECT query_id, chunk_id, round(rrf / (2.0::DOUBLE / 61) * 100, 9) AS relevance_pct, CASE WHEN v_rank IS NULL THEN 'keyword' WHEN k_rank IS NULL THEN 'vector' ELSE 'vector+keyword' END AS found_by FROM fused")
def _(v: Views):
    return R.hit_report(R.rrf(candidates(v))).select("query_id", "chunk_id", F.round("relevance_pct", 9).alias("relevance_pct"), "found_by")


@query("i14_route", "SELECT query_id, CASE WHEN query_id % 11 = 0 THEN 'chat' WHEN query_id % 5 = 0 THEN 'list' WHEN query_id % 3 = 0 THEN 'hub' WHEN query_id % 2 = 0 THEN 'page' ELSE 'context' END AS route FROM queries_v")
def _(v: Views):
    n = F.col("query_id")
    q = v.queries_v.select("query_id", (n % 11 != 0).alias("is_question"), (n % 5 == 0).alias("is_aggregate"), F.lit(True).alias("has_filter"), (n % 3 == 0).alias("hub_passes"), (n % 2 == 0).alias("page_passes"))
    return R.route(q).select("query_id", "route")


@query("e27_assemble_context", f"WITH {_HITS} SELECT query_id, string_agg('[REF' || (rank + 1) || '] ' || chunk_id || chr(10) || d.title, chr(10) || chr(10) ORDER BY rank) AS context FROM hv JOIN corpus_docs d ON d.id = chunk_id GROUP BY 1")
def _(v: Views):
    h = hits(v).filter("v_rank IS NOT NULL").select("query_id", F.col("v_rank").alias("pos"), F.col("chunk_id").alias("label"), F.col("title").alias("text"))
    return R.assemble_context(h)


@query("e28_assemble_sources", "SELECT CAST(substr(id, 2) AS BIGINT) // 20 AS page_id, string_agg('# ' || title || ' (' || source || ', ' || CAST(created_at AS VARCHAR) || ')' || chr(10) || substr(content, 1, 1200), chr(10) || chr(10) ORDER BY CAST(substr(id, 2) AS BIGINT)) AS block FROM corpus_docs GROUP BY 1")
def _(v: Views):
    no = F.substring("id", 2, 20).cast("long")
    d = v.corpus_docs.select(F.floor(no / 20).alias("page_id"), no.alias("rank"), "title", "source", F.col("created_at").alias("day"), "content")
    return R.assemble_sources(d)


@query("h05_collect_sources", f"WITH {_HITS}, b AS (SELECT query_id % 8 AS page_id, no AS doc_id, min((v_rank, query_id)) AS best FROM hits WHERE v_rank < 8 GROUP BY 1, 2) SELECT page_id, doc_id FROM b QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY best, doc_id) <= 10")
def _(v: Views):
    q = v.queries_v.select((F.col("query_id") % 8).alias("page_id"), "query_id")
    h = hits(v).filter("v_rank IS NOT NULL").select("query_id", F.col("no").alias("doc_id"), "source", F.col("v_rank").alias("pos"))
    return K.collect_sources(q, h, most=10).select("page_id", "doc_id")


# hybrid search: the whole way from a table of questions to the best documents

_HYB = f"""WITH {_CHUNKS}, {_POST}, {_KW}, {_BM},
ev AS (SELECT query_id, 'd' || vec_id || '-chunk-0' AS chunk_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, 'd' || vec_id || '-chunk-0') - 1 AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS distance FROM embeddings q JOIN queries_v ON query_id = q.vec_id, embeddings e)),
cc AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.chunk_id, b.chunk_id) AS chunk_id, a.rank AS v, b.rank AS k FROM (SELECT * FROM ev WHERE rank < 15) a FULL JOIN (SELECT * FROM br WHERE rank < 15) b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id),
sr AS (SELECT query_id, chunk_id, CASE WHEN v IS NULL THEN 0.5::DOUBLE / (k + 61) ELSE 1.0::DOUBLE / (v + 61) + coalesce(1.0::DOUBLE / (k + 61), 0) END AS r0 FROM cc),
tt AS (SELECT sr.query_id, sr.chunk_id, ch.doc_id, ch.text, round(r0 * (1 + pow(2.0, -(DATE '2025-01-01' - d.created_at) / 30.0)), 12) AS rrf FROM sr JOIN ch USING (chunk_id) JOIN corpus_docs d ON d.id = ch.doc_id),
top AS (SELECT tt.*, q.q FROM tt JOIN queries_v q USING (query_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, chunk_id) <= 10),
rr AS (SELECT *, round({_OVER}, 6) AS rs FROM top), dd AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rs DESC, rrf DESC, chunk_id) AS n FROM rr)
SELECT query_id, doc_id, chunk_id, rs AS rerank_score FROM dd WHERE n = 1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rs DESC, rrf DESC, chunk_id) <= 5"""


def hybrid_search(queries, chunks, index: W.KeywordIndex, vecs, k: int, now: str):
    """query_id, doc_id, chunk_id, rerank_score: questions (query_id, q, keywords, qvec) against chunks (chunk_id,
    doc_id, source, text, created_at), their index and vectors: both searches, fusion, recency, second stage,
    a document once, best ``k``."""
    vec = X.vector_top_n(queries.filter("qvec IS NOT NULL"), vecs, 3 * k)
    fused = R.rrf(R.merge_candidates(vec, W.bm25_search(queries, index, 3 * k)))
    if is_small(queries, MOST // (6 * k)):  # then so are the hits: 6 * k a question at most
        fused = F.broadcast(fused)
    scored = R.recency_boost(fused.join(chunks, "chunk_id"), now).withColumn("rrf", F.round("rrf", 12))
    ranked = R.rerank(scored.join(queries.select("query_id", "q"), "query_id"))
    best = F.struct(F.col("rerank_score"), F.col("rrf"))
    one = R.top_by(ranked.drop("rank").withColumn("_key", F.struct("query_id", "doc_id")), 1, best.desc(), "chunk_id", by="_key").drop("rank", "_key")
    return R.top_by(one, k, F.desc("rerank_score"), F.desc("rrf"), "chunk_id").select("query_id", "doc_id", "chunk_id", "rerank_score")


@query("i13_hybrid_search", _HYB)
def hybrid_query(v: Views):
    c = chunk_table(v, "created_at")
    q = asked(v).join(v.embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec")), "query_id", "left")
    vecs = v.embeddings.select(F.concat(F.lit("d"), F.col("vec_id").cast("string"), F.lit("-chunk-0")).alias("chunk_id"), "embedding")
    return hybrid_search(q, c.select("chunk_id", "doc_id", "source", "text", "created_at"), chunk_index(v), vecs, 5, NOW)


@query("i13_hybrid_embedded")
def _(v: Views):
    """Hybrid search with vectors that an embedder makes of the questions' and the chunks' texts."""
    c = chunk_table(v, "created_at")
    q = asked(v).withColumn("qvec", embedder(hashed_trigrams)("q"))
    return hybrid_search(q, c.select("chunk_id", "doc_id", "source", "text", "created_at"), chunk_index(v), with_vectors(c.select("chunk_id", "text"), hashed_trigrams), 5, NOW)


@query("k07_feedback_triage", f"WITH {_HITS} SELECT query_id, CASE WHEN k_rank < 4 THEN 'cited' WHEN rrf >= 0.3 * 2 / 61 AND distance <= 0.6 THEN 'missed' ELSE 'other' END AS verdict, count(*) AS n FROM hits GROUP BY 1, 2")
def _(v: Views):
    """What an answer by the best keyword hits cites, against all hits with their fused scores and distances."""
    h = hits(v).withColumn("doc_id", F.col("no"))
    found = R.compare_references(h, h.filter("k_rank < 4").select("query_id", "doc_id"), share=0.3, reach=0.6)
    return found.groupBy("query_id", "verdict").agg(F.count("*").alias("n"))


# the corpus

_GRP = "CASE WHEN lang = 'en' THEN 'default' ELSE lang END"


@query("e07_corpus_stats", f'WITH {_CHUNKS} SELECT source, {_GRP} AS "group", count(*) AS chunks, count(DISTINCT doc_id) AS docs FROM ch GROUP BY 1, 2')
def _(v: Views):
    return K.corpus_stats(chunk_table(v).withColumn("group", F.when(F.col("lang") != "en", F.col("lang")).otherwise(" ")))


@query("e21_oversized_docs", f"WITH {_CHUNKS} SELECT doc_id, count(*) AS chunks FROM ch WHERE mime_type LIKE '%excel%' GROUP BY 1 HAVING count(*) > 5")
def _(v: Views):
    return K.oversized_docs(chunk_table(v), 5)


@query("k02_drop_oversized", f"WITH {_CHUNKS}, o AS (SELECT doc_id, count(*) AS n FROM ch WHERE mime_type LIKE '%excel%' GROUP BY 1 HAVING count(*) > 5) SELECT (SELECT count(*) FROM ch) AS before, (SELECT count(*) FROM ch) - coalesce(CAST(sum(n) AS BIGINT), 0) AS after, count(*) AS docs FROM o")
def _(v: Views):
    return K.drop_oversized(chunk_table(v), 5)[1]


_KEYS = "k AS (SELECT doc_id, trim(any_value(title)) AS title, list_sort(list_distinct(list(content_hash))) AS key, count(*) AS chunks FROM ch GROUP BY 1)"


@query("e23_identical_groups", f"WITH {_CHUNKS}, {_KEYS} SELECT title, docs, doc_id FROM (SELECT *, count(*) OVER (PARTITION BY title, key) AS docs FROM k) WHERE docs > 1")
def _(v: Views):
    return K.identical_groups(chunk_table(v)).select("title", "docs", "doc_id")


_KEEP = f"{_KEYS}, r AS (SELECT *, row_number() OVER (PARTITION BY title, key ORDER BY chunks DESC, doc_id) AS n FROM k)"


@query("f12_keep_largest", f"WITH {_CHUNKS}, {_KEEP} SELECT doc_id, n = 1 AS keep FROM r")
def _(v: Views):
    return K.keep_largest(chunk_table(v))


@query("k01_drop_identical", f"WITH {_CHUNKS}, {_KEEP} SELECT CAST(sum(chunks) AS BIGINT) AS chunks_removed, count(*) AS docs_removed FROM r WHERE n > 1")
def _(v: Views):
    c = chunk_table(v)
    return K.drop_identical(c, W.postings_of(c))[2]


@query("e19_source_hash", f"WITH {_CHUNKS} SELECT source, md5(string_agg(content_hash, '|' ORDER BY content_hash)) AS source_hash FROM ch GROUP BY 1")
def _(v: Views):
    return K.source_hash(chunk_table(v), "source")


@query("e19_source_hash_parts", f"WITH {_CHUNKS}, x AS (SELECT source, substr(content_hash, 1, 3) || md5(string_agg(content_hash, '|' ORDER BY content_hash)) AS part FROM ch GROUP BY source, substr(content_hash, 1, 3)) SELECT source, md5(string_agg(part, '|' ORDER BY part)) AS source_hash FROM x GROUP BY 1")
def _(v: Views):
    return K.source_hash_parts(chunk_table(v), "source")


@query("e20_fact_conflicts", "WITH f AS (SELECT lower(replace(fact_key, ' ', '')) AS k, page_id, fact_value FROM page_facts WHERE status <> 'disabled') SELECT k AS fact_key, count(DISTINCT fact_value) AS n_values, count(*) AS n FROM f GROUP BY 1 HAVING count(DISTINCT fact_value) > 1")
def _(v: Views):
    return K.fact_conflicts(v.page_facts).groupBy("fact_key", "n_values").agg(F.count("*").alias("n"))


@query("k04_stale_pages", f"WITH {_CHUNKS}, h AS (SELECT source, md5(string_agg(content_hash, '|' ORDER BY content_hash)) AS h FROM ch GROUP BY 1) SELECT source AS topic, CASE WHEN source IN ('src1', 'src2') THEN 'rebuilt' ELSE 'unchanged' END AS state, source = 'src1' AS was_approved FROM h UNION ALL SELECT 'gone', 'missing', false")
def _(v: Views):
    now = K.source_hash_parts(chunk_table(v), "source").withColumnRenamed("source", "topic")
    pages = now.withColumn("source_hash", F.when(F.col("topic").isin("src1", "src2"), "old").otherwise(F.col("source_hash"))).withColumn("status", F.when(F.col("topic") == "src2", "draft").otherwise("approved"))
    return K.stale_pages(pages.unionByName(v.spark.createDataFrame([("gone", "x", "approved")], "topic string, source_hash string, status string")), now)


@query("k05_page_status", "SELECT s_suppkey % 20 AS page_id, CASE WHEN arg_max(s_nationkey, s_suppkey) % 3 = 0 THEN 'draft' WHEN arg_max(s_nationkey, s_suppkey) % 3 = 1 THEN 'approved' ELSE 'disabled' END AS status, arg_max(s_nationkey, s_suppkey) % 3 <> 2 AS indexed FROM supplier GROUP BY 1")
def _(v: Views):
    n = F.col("s_nationkey") % 3
    return K.page_status(v.supplier.select((F.col("s_suppkey") % 20).alias("page_id"), F.when(n == 0, "rebuilt").when(n == 1, "approved").otherwise("disabled").alias("event"), F.col("s_suppkey").alias("ts")))


@query("k06_accept_pages", "SELECT id, CASE WHEN CAST(substr(id, 2) AS BIGINT) % 5 < 3 THEN 'too few sources' WHEN length(content) + 7 < 200 THEN 'too short' WHEN CAST(substr(id, 2) AS BIGINT) % 2 = 0 THEN 'no citation' END AS reason FROM corpus_docs")
def _(v: Views):
    no = F.substring("id", 2, 20).cast("long")
    d = v.corpus_docs.select("id", (no % 5).alias("n_sources"), F.concat("content", F.when(no % 2 == 0, " [REFx]").otherwise(" [REF1]")).alias("content"))
    return K.accept_pages(d).select("id", "reason")


_PAGES = "SELECT conv_id AS page_id, 't' || CAST(conv_id AS {0}) AS topic, CASE conv_id % 4 WHEN 0 THEN 'disabled' ELSE 'draft' END AS status, turn, text FROM conversations WHERE role = 'user'"


@query("k10_question_index", f"SELECT 'page-' || page_id || '-q-' || (row_number() OVER (PARTITION BY page_id ORDER BY turn) - 1) AS id, topic, CASE WHEN page_id % 5 = 0 THEN 'old ' || text ELSE text END AS question FROM ({_PAGES.format('VARCHAR')}) WHERE page_id % 5 = 0 OR status <> 'disabled'")
def _(v: Views):
    """All pages stand in the index with old questions; four fifths come again, some of them disabled."""
    rows = v.sql(_PAGES.format("STRING"))
    pages = rows.groupBy("page_id", "topic", "status").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("questions"))
    old = pages.withColumn("status", F.lit("draft")).withColumn("questions", F.transform("questions", lambda t: F.concat(F.lit("old "), t)))
    return K.replace_questions(K.question_index(old), pages.filter("page_id % 5 <> 0")).select("id", "topic", "question")


@query("a18_upsert_pages", "WITH o AS (SELECT s_suppkey AS k, 't' || s_suppkey AS topic FROM supplier WHERE s_suppkey % 2 = 0), i AS (SELECT s_suppkey AS k, 't' || s_suppkey AS topic FROM supplier WHERE s_suppkey % 3 = 0) SELECT coalesce(o.topic, i.topic) AS topic, CASE WHEN i.k IS NULL THEN 'old' ELSE 'new2' END AS content, CASE WHEN i.k IS NULL THEN 'approved' ELSE 'draft' END AS status, CASE WHEN o.k IS NULL THEN 9 ELSE 1 END AS created_at, CASE WHEN i.k IS NULL THEN 1 ELSE 9 END AS updated_at FROM o FULL JOIN i ON o.topic = i.topic")
def _(v: Views):
    topic = F.concat(F.lit("t"), F.col("s_suppkey").cast("string")).alias("topic")
    old = v.supplier.filter("s_suppkey % 2 = 0").select(topic, F.lit("old").alias("content"), F.lit("approved").alias("status"), F.lit(1).alias("created_at"), F.lit(1).alias("updated_at"))
    new = v.supplier.filter("s_suppkey % 3 = 0").select(topic, F.explode(F.array(F.lit(1), F.lit(2))).alias("position")).select("topic", F.concat(F.lit("new"), F.col("position").cast("string")).alias("content"), F.lit(9).alias("ts"), "position")
    return K.upsert_pages(old, new)


@query("d17_flag_existing", "SELECT s_suppkey, s_suppkey % 2 = 0 AS has_page FROM supplier")
def _(v: Views):
    t = v.supplier.select("s_suppkey", F.col("s_suppkey").alias("topic"))
    return K.flag_existing(t, t.filter("topic % 2 = 0").select("topic")).select("s_suppkey", "has_page")


@query("k03_topic_candidates")
def _(v: Views):
    q = v.chat_history.groupBy(F.col("question").alias("q")).agg(F.min("id").alias("query_id"))
    return K.topic_candidates(q)


@query("e24_ab_summary", """WITH j AS (SELECT l_orderkey AS case_id, 'm' || l_linenumber AS model, CAST(l_quantity AS BIGINT) % 4 AS score, l_discount > 0.09 AS error, l_quantity AS ms FROM lineitem),
b AS (SELECT *, max(score) OVER (PARTITION BY case_id) AS best FROM j), t AS (SELECT *, count(*) FILTER (score = best) OVER (PARTITION BY case_id) AS tied FROM b)
SELECT model, avg(score) AS mean_score, count(*) FILTER (error) AS errors, avg(ms) AS mean_ms, max(ms) AS max_ms, count(*) FILTER (score = best AND tied = 1) AS wins, count(*) FILTER (score = best AND tied > 1) AS ties FROM t GROUP BY 1""")
def _(v: Views):
    j = v.lineitem.select(F.col("l_orderkey").alias("case_id"), F.concat(F.lit("m"), F.col("l_linenumber").cast("string")).alias("model"), (F.col("l_quantity").cast("long") % 4).alias("score"), (F.col("l_discount") > 0.09).alias("error"), F.col("l_quantity").alias("ms"))
    return K.ab_summary(j)


_RANKED = "SELECT 'a' AS ranker, doc_id // 10 AS case_id, doc_id % 10 AS pos, CASE WHEN doc_id % 97 = 0 THEN NULL ELSE greatest(0, quality + 1 - toxic) END AS rel FROM labels UNION ALL SELECT 'b', doc_id // 10, 9 - doc_id % 10, greatest(0, quality + 1 - toxic) FROM labels"


@query("e25_ndcg", f"""WITH r AS ({_RANKED}), ok AS (SELECT * FROM r QUALIFY count(*) FILTER (rel IS NULL) OVER (PARTITION BY case_id) = 0), p AS (SELECT *, row_number() OVER (PARTITION BY ranker, case_id ORDER BY rel DESC, pos) - 1 AS ideal FROM ok),
g AS (SELECT ranker, case_id, coalesce(sum(rel / log2(pos + 2)) FILTER (pos < 3), 0) AS dcg, coalesce(sum(rel / log2(ideal + 2)) FILTER (ideal < 3), 0) AS best FROM p GROUP BY 1, 2)
SELECT ranker, round(avg(CASE WHEN best > 0 THEN dcg / best ELSE 0.0 END), 9) AS ndcg, count(*) AS cases FROM g GROUP BY 1""")
def _(v: Views):
    return K.ndcg(v.sql(_RANKED.replace("//", "DIV"))).withColumn("ndcg", F.round("ndcg", 9))


@query("k09_compare_rankers", f"""WITH r AS ({_RANKED.replace('97', '89')}), ok AS (SELECT * FROM r QUALIFY count(*) FILTER (rel IS NULL) OVER (PARTITION BY case_id) = 0), p AS (SELECT *, row_number() OVER (PARTITION BY ranker, case_id ORDER BY rel DESC, pos) - 1 AS ideal FROM ok),
g AS (SELECT ranker, case_id, coalesce(sum(rel / log2(pos + 2)) FILTER (pos < 5), 0) AS dcg, coalesce(sum(rel / log2(ideal + 2)) FILTER (ideal < 5), 0) AS best FROM p GROUP BY 1, 2)
SELECT ranker, round(avg(CASE WHEN best > 0 THEN dcg / best ELSE 0.0 END), 9) AS ndcg, count(*) AS cases FROM g GROUP BY 1""")
def _(v: Views):
    return K.ndcg(v.sql(_RANKED.replace("//", "DIV").replace("97", "89")), 5).withColumn("ndcg", F.round("ndcg", 9))


