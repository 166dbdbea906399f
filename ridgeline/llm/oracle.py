"""DuckDB SQL of the training-data queries that SQL can express over whole tables."""

from __future__ import annotations

from ridgeline.llm import secrets

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

OP1 = rf"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: concat(ws[i], ' ', ws[i + 1], ' ', ws[i + 2])) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * m >= 85 * (a.c + b.c - m)),
arcs AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(v, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT arcs.y, r.c FROM r JOIN arcs ON arcs.x = r.v WHERE r.c < arcs.y)
SELECT d.doc_id, coalesce(n.c, 0)::BIGINT AS n_shingles, k.c AS component_id, k.c = d.doc_id AS kept FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT v, min(c) AS c FROM r GROUP BY v) k ON k.v = d.doc_id"""

OP2 = """WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS b, sha256(coalesce(html, '')) AS h FROM pages),
q AS (SELECT *, CASE WHEN b >= 100 THEN min(page_id) OVER (PARTITION BY h) ELSE page_id END AS f FROM p)
SELECT page_id, b AS payload_bytes, h AS payload_digest, CASE WHEN f = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN f <> page_id THEN f END AS refers_to FROM q"""


def _escaped(value: str) -> str:
    return rf"replace(replace(replace({value}, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')"


OP8 = rf"""WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, k, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) x(k, r)),
f AS (SELECT *, 15 + length(replace({_escaped('role')}, ':', '\:')) + length({_escaped('text')}) AS n FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn)) AS turns_sha256,
coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars FROM f GROUP BY conv_id"""

OP9 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20"""


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash": OP1, "op2_warc": OP2, "op6_secrets": secrets.oracle_sql(), "op8_chat": OP8, "op9_topk": OP9}
