"""The registered queries of the operators in this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from tidewire.llm.bpe import op11
from tidewire.llm.chaining import op7
from tidewire.llm.conversations import op12
from tidewire.llm.decontamination import op6
from tidewire.llm.exact_topk import op10
from tidewire.llm.language_id import op8
from tidewire.llm.minhash import op2
from tidewire.llm.mixing import op3
from tidewire.llm.quality import op1
from tidewire.llm.sharding import op9
from tidewire.llm.substring_dedup import op4
from tidewire.llm.token_counts import op5
from tidewire.llm.whitening import op13

QUERIES = {
    "op1_quality": op1,
    "op2_near_duplicates": op2,
    "op3_mix_sources": op3,
    "op4_substring_dedup": op4,
    "op5_token_counts": op5,
    "op6_decontaminate": op6,
    "op7_passages": op7,
    "op8_language_id": op8,
    "op9_shards": op9,
    "op10_exact_topk": op10,
    "op11_bpe": op11,
    "op12_conversation_repair": op12,
    "op13_whitening": op13,
}

ORACLE_SQL = {
    "op4_substring_dedup": """
        WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
        w AS (SELECT doc_id, i, md5(b[i + 1 : i + 200]) AS h FROM (SELECT doc_id, b, unnest(range(0, octet_length(b) - 199)) AS i FROM d WHERE octet_length(b) >= 200)),
        r AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
        s AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM w JOIN r USING (h)),
        p AS (SELECT doc_id, min(i) AS lo, max(i) + 200 AS hi FROM s GROUP BY doc_id, g),
        q AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY doc_id ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS first FROM p),
        m AS (SELECT doc_id, min(lo) AS lo, max(hi) AS hi FROM (SELECT *, sum(first) OVER (PARTITION BY doc_id ORDER BY lo) AS run FROM q) GROUP BY doc_id, run),
        k AS (SELECT doc_id, coalesce(lag(hi) OVER v, 0) AS a, lo AS z FROM m WINDOW v AS (PARTITION BY doc_id ORDER BY lo) UNION ALL SELECT doc_id, max(hi), 1000000000 FROM m GROUP BY doc_id),
        t AS (SELECT doc_id, string_agg(hex(b[a + 1 : least(z, octet_length(b))]), '' ORDER BY a) AS x FROM k JOIN d USING (doc_id) GROUP BY doc_id),
        n AS (SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans FROM m GROUP BY doc_id)
        SELECT d.doc_id, octet_length(b) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(CASE WHEN n.doc_id IS NULL THEN b ELSE unhex(coalesce(x, '')) END) AS kept_sha256
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
    """,
    "op6_decontaminate": """
        WITH lower_ AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        items AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
        win AS (SELECT DISTINCT item, k, array_to_string(w[i + 1 : i + k], ' ') AS h FROM (SELECT item, w, least(10, len(w)) AS k, unnest(range(0, len(w) - least(10, len(w)) + 1)) AS i FROM items WHERE len(w) > 0)),
        spots AS (SELECT doc_id, k, i, array_to_string(w[i + 1 : i + k], ' ') AS h FROM (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS i FROM lower_, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
        hit AS (SELECT doc_id, item, i, spots.k FROM spots JOIN win ON spots.k = win.k AND spots.h = win.h),
        pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
        its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM lower_ LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
    """,
    "op10_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
            FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
        ), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
}
