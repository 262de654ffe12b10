"""Views over the driver's tables that give operators their inputs; Spark and DuckDB read the same text."""

VIEWS = {
    "corpus_docs": """SELECT 'd' || CAST(doc_id AS STRING) AS id, source, substr(text, 1, 40) AS title, text AS content,
       CASE doc_id % 3 WHEN 0 THEN 'issue' WHEN 1 THEN 'page' ELSE 'file' END AS content_type,
       CASE WHEN doc_id % 20 = 0 THEN 'application/vnd.ms-excel' ELSE 'text/plain' END AS mime_type,
       DATE '2024-01-01' + CAST(doc_id % 365 AS INT) AS created_at, lang
FROM documents""",
    "queries_v": """SELECT item_id AS query_id, text AS q FROM benchmark""",
    "query_vectors": """SELECT vec_id AS query_id, embedding AS qvec FROM embeddings WHERE vec_id % 20 = 0""",
    "chat_history": """SELECT event_id AS id,
       's' || CAST(user_id AS STRING) || '-' || substr(CAST(ts AS STRING), 1, 10) AS session_id,
       ts AS created_at, event_type || ' ' || props AS question,
       CAST(floor(value * 100) AS INT) AS response_time_ms,
       CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS is_no_answer,
       CASE WHEN event_type = 'purchase' THEN 1 WHEN event_type = 'error' AND value > 20 THEN -1 ELSE 0 END AS feedback,
       CASE WHEN event_type = 'error' THEN NULL ELSE 'src' || CAST(user_id % 4 AS STRING) END AS ref_source
FROM events""",
    "api_calls": """SELECT event_id AS id, user_id % 50 AS client_id, event_type AS domain,
       CASE WHEN event_type = 'error' THEN 502 ELSE 200 END AS status, ts AS created_at FROM events""",
    "issues": """SELECT 'N' || CAST(n.n_nationkey AS STRING) || '-' || CAST(o.o_orderkey AS STRING) AS issue_key, o.o_orderkey AS issue_no,
       n.n_name AS project, c.c_name AS assignee, o.o_orderpriority AS label,
       CASE o.o_orderstatus WHEN 'O' THEN 'Open' WHEN 'P' THEN 'In Progress' ELSE 'Closed' END AS status,
       o.o_orderdate AS created_at, c.c_mktsegment || ' order ' || CAST(o.o_orderkey AS STRING) AS title
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey""",
    "issue_links": """SELECT DISTINCT l_orderkey AS src_no, l_partkey * 10 AS dst_no,
       CASE WHEN l_returnflag = 'R' THEN 'blocks' ELSE 'relates' END AS link_type
FROM lineitem""",
    "sales_records": """SELECT CAST(o.o_orderdate AS DATE) AS date, CAST(o.o_totalprice AS DECIMAL(18,2)) AS amount, 1 AS cnt,
       o.o_orderpriority AS dim_priority, c.c_mktsegment AS dim_segment
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey""",
    "voc_records": """SELECT CAST(ts AS DATE) AS date, event_type || ' ' || props AS text,
       CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(1 + event_id % 5 AS INT) END AS rating,
       event_type AS category, CASE user_id % 3 WHEN 0 THEN 'app' WHEN 1 THEN 'web' ELSE NULL END AS channel
FROM events""",
    "file_listing": """SELECT p_partkey AS file_id, p_brand AS folder,
       CASE WHEN p_partkey % 4 = 0 THEN p_name || '.pdf'
            ELSE p_name || '_v' || CAST(p_size % 5 AS STRING) || '.' || CAST(p_partkey % 13 AS STRING) || '.pptx' END AS name,
       p_size * 1048576 AS size_bytes
FROM part""",
    "messages": """SELECT conv_id, turn, role, text FROM conversations WHERE role <> 'system'""",
    "relevance": """SELECT doc_id, greatest(0, quality + 1 - toxic) AS rel FROM labels""",
    "page_facts": """SELECT s_suppkey % 10 AS page_id, 'Nation ' || CAST(s_nationkey AS STRING) AS fact_key,
       CAST(s_suppkey % 3 AS STRING) AS fact_value,
       CASE s_suppkey % 10 WHEN 9 THEN 'disabled' WHEN 8 THEN 'draft' ELSE 'approved' END AS status
FROM supplier""",
    "entities_v": """SELECT * FROM (VALUES ('E1', 'tion'), ('E1', 'ment'), ('E2', 'ouble'), ('E3', 'eux'), ('E4', 'sch'), ('E5', 'zzzz')) AS t(name, alias)""",
}
