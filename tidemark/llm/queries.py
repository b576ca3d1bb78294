"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from importlib import import_module

#: Query: module of this subpackage that holds it.
_MODULES = {
    "op1_packing": "packing",
    "op2_suffix_dedup": "suffix_dedup",
    "op3_media": "media",
    "op4_brown_lm": "brown",
    "op5_line_dedup": "line_dedup",
    "op6_token_store": "token_store",
    "op7_near_dedup": "bottom_k",
    "op8_imatch": "imatch",
    "op9_toxicity": "toxicity",
    "op10_bpe": "bpe",
}

QUERIES = {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in _MODULES.items()}

#: Strings of 50 bytes as hexadecimal text; each one's smallest document; runs of covered bytes; what lies between them.
_REPEATS = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
s AS (SELECT doc_id, i, substr(hx, 2 * i + 1, 100) AS w FROM (SELECT doc_id, hx, unnest(range(0, greatest(n - 49, 0))) AS i FROM d)),
m AS (SELECT w, min(doc_id) AS least FROM s GROUP BY w HAVING count(*) > 1),
hits AS (SELECT s.doc_id, s.i FROM s JOIN m USING (w) WHERE m.least < s.doc_id),
marked AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM hits),
numbered AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM marked),
spans AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY doc_id, k),
parts AS (SELECT p.doc_id, p.a, substr(d.hx, 2 * p.was + 1, 2 * (p.a - p.was)) AS part FROM (SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS was FROM (SELECT doc_id, a, b FROM spans UNION ALL SELECT doc_id, n, n FROM d)) p JOIN d USING (doc_id)),
kept AS (SELECT doc_id, string_agg(part, '' ORDER BY a) AS hx FROM parts GROUP BY doc_id),
gone AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(g.n_removed, 0)::BIGINT AS n_removed, coalesce(g.n_spans, 0)::BIGINT AS n_spans, sha256(unhex(kept.hx)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN gone g USING (doc_id)"""

#: Distinct shingles as text, pairs that share one, exact similarities, and who reaches whom.
_NEAR = """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS x FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM s p JOIN s q ON p.x = q.x AND p.doc_id < q.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM reach r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) e ON e.a = r.b),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM least LEFT JOIN n USING (doc_id)"""

#: The others' results need a tokenizer, a hash or a trained model that SQL doesn't have, or (lines) compare too many pairs for it:
#: tests hold them against brute-force versions.
ORACLES: dict[str, str] = {"op2_suffix_dedup": _REPEATS, "op7_near_dedup": _NEAR}
