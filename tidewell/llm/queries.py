"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, chat_tree, decontam, knn_quality, near_dedup, ngram_lm, packing, sharding, spelling, topk_search, url_filter, warc_zip, winnowing
from .shared import cut, scratch, table

#: The rules that the URL query judges by: verdict, host, path prefix.
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


#: Where the public tokenizers' files are.
TOKENIZERS = "/opt/tokenizers"


#: Documents from this score on are kept.
KEEP_SCORE = 0.3


def held_out(modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; rows without id are not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def op1_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = knn_quality.fit_quality(docs, table(spark, sf_dir, "labels"), ~held_out(5, 0))
    scored = docs.select("doc_id", held_out(5, 0).alias("held_out"), knn_quality.quality_score(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= KEEP_SCORE).cast("int"))


def op2_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", asked), (-1, 1, "assistant", asked)], "conv_id long, turn long, role string, text string")
    tokenizer = f"{TOKENIZERS}/byte_bpe_50k.json"
    trees = chat_tree.format_chat_trees(table(spark, sf_dir, "conversations").select(extra.columns).unionByName(extra), tokenizer=tokenizer)
    return chat_tree.read_chat_trees(trees._replace(nodes=cut(trees.nodes, "chat-nodes")), tokenizer=tokenizer)


def op3_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer=f"{TOKENIZERS}/word_bpe_49k.json")


def op4_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = warc_zip.write_archives(table(spark, sf_dir, "pages"), scratch(spark, "packages"))
    return warc_zip.read_archives(cut(written, "packages-written"), with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_kd_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = ngram_lm.train(docs.filter(~held_out(7, 2)), F.col("text"))
    out = ngram_lm.score_texts(docs, model)
    return out.select("doc_id", held_out(7, 2).alias("held_out"), *out.columns[1:])


def op7_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = sharding.shuffle_into_shards(docs, key_cols=["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_prefix_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op9_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


def op10_url_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op11_kd_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.counted_words(table(spark, sf_dir, "documents"))
    return spelling.spelling_variants(cut(words, "words"))


def op12_ns_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))


def op13_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = winnowing.edited_fingerprints(table(spark, sf_dir, "documents"))
    out = out.withColumns({c: winnowing.digest(F.col(c)) for c in ("fingerprint", "edited")}).withColumnRenamed("edited", "edited_fingerprint")
    return winnowing.dealt(out)


QUERIES = {f.__name__: f for f in (op1_knn_quality, op2_chat_prefix_tree, op3_pattern_packing, op4_warc_zip, op5_kd_top_k, op6_elias_fano_lm, op7_hypergeometric_shards, op8_prefix_set_join, op9_dart_minhash, op10_url_range_join, op11_kd_spelling, op12_ns_centroids, op13_winnowing)}

_ESCAPED = "replace({}, '\\', '\\\\')"
for _c in chat_tree.CONTROL:
    _ESCAPED = f"replace({_ESCAPED}, '{_c}', '{_c[0]}\\{_c[1:]}')"



def _clustering_sql(k: int = 40, rounds: int = 5) -> str:
    """k-means as a chain of tables: c0, then a{i} (nearest centroid) and c{i + 1} (their floors of means) for each round."""
    parts = [f"""
kept AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
         WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, unnest(range(1, 65)) AS j, unnest(v) AS x FROM kept),
s AS (SELECT r, CAST(row_number() OVER (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS INTEGER) AS cluster FROM kept),
c0 AS MATERIALIZED (SELECT cluster, j, x AS c FROM s JOIN p USING (r) WHERE cluster < {k})"""]
    for i in range(rounds + 1):
        parts.append(f"""d{i} AS (SELECT r, cluster, sum((x - c) * (x - c)) AS d FROM p JOIN c{i} USING (j) GROUP BY r, cluster),
a{i} AS MATERIALIZED (SELECT r, min_by(cluster, (d, cluster)) AS cluster, CAST(min(d) AS BIGINT) AS distance FROM d{i} GROUP BY r)""")
        parts.append(f"""m{i} AS (SELECT cluster, j, sum(x) AS t, count(*) AS n FROM a{i} JOIN p USING (r) GROUP BY cluster, j),
c{i + 1} AS MATERIALIZED (SELECT cluster, j, CAST(CASE WHEN n IS NULL THEN c ELSE (t - ((t % n) + n) % n) // n END AS BIGINT) AS c FROM c{i} LEFT JOIN m{i} USING (cluster, j))""")
    return f"""
WITH {", ".join(parts[:-1])},
h AS (SELECT cluster, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY j)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN h USING (cluster)"""


ORACLES = {
    "op12_ns_centroids": _clustering_sql(),
    "op2_chat_prefix_tree": f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
f AS (SELECT *, length({_ESCAPED.format("text")}) + CASE role WHEN 'user' THEN 13 WHEN 'system' THEN 15 WHEN 'assistant' THEN 7 ELSE 20 + length({_ESCAPED.format("role")}) END AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars FROM f GROUP BY conv_id""",
    "op4_warc_zip": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to FROM f""",
    "op8_prefix_set_join": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, w[s : s + 9] AS win FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS s FROM b WHERE len(w) > 0)),
k AS (SELECT DISTINCT len(win) AS n FROM i),
p AS (SELECT r, n, s, w[s : s + n - 1] AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d JOIN k ON len(w) >= n)),
h AS (SELECT r, s, n, item_id FROM p JOIN i USING (win)),
c AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS x FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT r, item_id FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)""",
    "op5_kd_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 1024)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op10_url_range_join": r"""
WITH u AS (SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1) AS h0,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
v AS (SELECT page_id, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u),
r(verdict, rh, rp) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
m AS (SELECT v.*, rh || rp AS rule, r.verdict AS rv FROM v LEFT JOIN r ON (v.host = rh OR ends_with(v.host, '.' || rh)) AND starts_with(v.path, rp))
SELECT page_id, host, path, arg_max(rule, len(rule)) AS rule, coalesce(arg_max(rv, len(rule)), 'allow') AS verdict FROM m GROUP BY page_id, host, path""",
}
