"""DuckDB SQL of those opN_ queries that SQL can express."""

from __future__ import annotations

from . import mixture

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

WARC = f"""WITH q AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, n, min(page_id) AS first FROM q GROUP BY d, n)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('{UPPER}234567', (((('0x' || substr(d, (i // 8) * 10 + 1, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to
FROM q JOIN f USING (d, n)"""

DEDUP = r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS MATERIALIZED (SELECT doc_id, unnest(list_transform(range(len(ws) - 12), lambda i: array_to_string(ws[i + 1:i + 13], ' '))) AS gram, unnest(range(len(ws) - 12)) AS pos FROM w WHERE len(ws) >= 13),
f AS MATERIALIZED (SELECT gram, min(doc_id) AS first FROM g GROUP BY gram),
h AS MATERIALIZED (SELECT doc_id, pos FROM g JOIN f USING (gram) WHERE doc_id > first),
r AS MATERIALIZED (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(pos, pos + 13)) AS p FROM h) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(ps, i - 1)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)"""

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x{{00}}-\x{{2F}}\x{{3A}}-\x{{60}}\x{{7B}}-\x{{7F}}]+')"
DECONTAMINATE = f"""WITH items AS (SELECT item_id, {_WORDS} AS ws FROM benchmark), docs AS MATERIALIZED (SELECT doc_id, {_WORDS} AS ws FROM documents),
win AS MATERIALIZED (SELECT DISTINCT item_id, least(10, len(ws)) AS k, unnest(list_transform(range(greatest(1, len(ws) - 9)), lambda i: array_to_string(ws[i + 1:i + 10], ' '))) AS gram FROM items WHERE len(ws) > 0),
ks AS (SELECT DISTINCT k FROM win),
g AS MATERIALIZED (SELECT doc_id, k, unnest(list_transform(range(len(ws) - k + 1), lambda i: array_to_string(ws[i + 1:i + k], ' '))) AS gram, unnest(range(len(ws) - k + 1)) AS pos FROM docs, ks WHERE len(ws) >= k),
hit AS MATERIALIZED (SELECT doc_id, item_id, pos, k FROM g JOIN win USING (k, gram)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + k)) AS p FROM hit) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)"""

JACCARD = rf"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(len(ws) - 3), lambda i: array_to_string(ws[i + 1:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT x, y FROM common JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)),
both_ways AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
least_of AS (SELECT x AS doc_id, min(y) AS y FROM reach GROUP BY x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(y, doc_id)) AS component_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN least_of USING (doc_id)"""

ORACLES: dict[str, str] = {"op4_jaccard_join": JACCARD, "op1_warc": WARC, "op2_substring_dedup": DEDUP, "op3_mixture": mixture.oracle_sql(), "op10_decontaminate": DECONTAMINATE}
