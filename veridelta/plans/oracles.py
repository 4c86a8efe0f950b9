"""DuckDB SQL of the registered queries, put together from shared common table expressions."""

from __future__ import annotations

SPACE = r"[\s\x0B\x{1C}-\x{1F}\x{85}\p{Z}]+"


def weight(c: str) -> str:
    return f"greatest(1, len(list_filter(string_split_regex({c}, '{SPACE}'), lambda w: w <> '')))::DOUBLE"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{SPACE}|{SPACE}$', '', 'g')"


def label(text: str, heading: str) -> str:
    return rf"coalesce(nullif(regexp_extract({text}, '(?i)(section\s+\d+(?:\.\d+)*)', 1), ''), {heading})"


def blocks(table: str = "documents") -> str:
    """CTEs ending in blocks(doc_id, block_ord, text, is_heading)."""
    if table == "documents":
        return """lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS block_ord FROM documents),
blocks AS (SELECT doc_id, block_ord, text, false AS is_heading FROM lines WHERE trim(text) <> '')"""
    if table == "conversations":
        return "blocks AS (SELECT conv_id AS doc_id, turn AS block_ord, text, false AS is_heading FROM conversations WHERE text IS NOT NULL)"
    return r"""found AS (SELECT page_id, regexp_extract_all(array_to_string(regexp_extract_all(html, '(?s)<article[^>]*>(.*?)</article>', 1), chr(10)), '(?s)<(?:h[1-6]|p|li|pre|blockquote|td|th)(?:\s[^>]*)?>.*?</(?:h[1-6]|p|li|pre|blockquote|td|th)>') AS els FROM pages),
parts AS (SELECT page_id AS doc_id, unnest(els) AS el, unnest(range(len(els))) AS block_ord FROM found),
blocks AS (SELECT doc_id, block_ord, regexp_matches(el, '^<h[1-6]') AS is_heading,
  replace(replace(replace(replace(replace(regexp_replace(el, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS text FROM parts)"""


HEADED = "headed AS (SELECT *, coalesce(last_value(CASE WHEN is_heading THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_ord ROWS UNBOUNDED PRECEDING), '') AS heading FROM blocks)"


def chunks(granularity: str, cap: int | None = None, name: str = "chunks") -> str:
    """CTEs from blocks to chunks(doc_id, granularity, index, text, section, weight)."""
    index = "row_number() OVER (PARTITION BY doc_id ORDER BY {}) - 1"
    if granularity == "paragraph":
        own = f"SELECT doc_id, {index.format('block_ord')} AS index, text, {label('text', 'heading')} AS section FROM headed"
        pre = HEADED + ", "
    elif granularity == "sentence":
        marked = r"""regexp_replace(text, '([.!?])["'')\]]?[\s\x0B\x{1C}-\x{1F}\x{85}\p{Z}]+(["''(\[]?[A-Z0-9])', '\1' || chr(1) || '\2', 'g')"""
        pre = f"""{HEADED}, pieces AS (SELECT doc_id, block_ord, {label('text', 'heading')} AS section, string_split({marked}, chr(1)) AS ps FROM headed),
sents AS (SELECT doc_id, block_ord, section, {strip('unnest(ps)')} AS text, unnest(range(len(ps))) AS pos FROM pieces), """
        own = f"SELECT doc_id, {index.format('block_ord, pos')} AS index, text, section FROM sents WHERE text <> ''"
    else:
        pre = """numbered AS (SELECT *, sum(is_heading::INT) OVER (PARTITION BY doc_id ORDER BY block_ord ROWS UNBOUNDED PRECEDING) AS grp FROM blocks),
grouped AS (SELECT doc_id, grp, string_agg(text, ' ' ORDER BY block_ord) AS text, arg_min(text, block_ord) AS head, arg_min(is_heading, block_ord) AS headed FROM numbered GROUP BY doc_id, grp), """
        own = f"SELECT doc_id, {index.format('grp')} AS index, text, CASE WHEN headed THEN head ELSE {label('head', chr(39) * 2)} END AS section FROM grouped"
    limit = "" if cap is None else f" WHERE index < {cap}"
    return f"{pre}{name}_all AS ({own}), {name} AS MATERIALIZED (SELECT doc_id, '{granularity}' AS granularity, index, text, section, {weight('text')} AS weight FROM {name}_all{limit})"


PAIRS = """firsts AS (SELECT doc_id, string_split(text, chr(10))[1] AS line FROM documents),
leasts AS (SELECT line, min(doc_id) AS doc_a FROM firsts GROUP BY line),
pairs AS MATERIALIZED (SELECT f.doc_id AS pair_id, l.doc_a, f.doc_id AS doc_b FROM firsts f JOIN leasts l ON f.line = l.line WHERE f.doc_id <> l.doc_a)"""


def neighbours(table: str, key: str) -> str:
    return f"ids AS (SELECT DISTINCT {key} AS id FROM {table}), pairs AS MATERIALIZED (SELECT a.id AS pair_id, a.id AS doc_a, b.id AS doc_b FROM ids a JOIN ids b ON b.id = a.id + 1)"


#: CRC-32 of tokens by a table of 256 remainders
CRC = """bits AS (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM (SELECT unnest(range(256)) AS i)),
crcs AS (SELECT list(c ORDER BY i) AS cs FROM bits),
hashed AS MATERIALIZED (SELECT token, xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(token))), lambda k: ('0x' || substr(hex(encode(token)), 2 * k + 1, 2))::BIGINT)),
  lambda s, b: xor(cs[(xor(s, b) % 256) + 1], s // 256)), 4294967295) AS h FROM (SELECT DISTINCT token FROM tokens), crcs)"""


def features(source: str = "chunks", dim: int = 1024) -> str:
    """CTEs from chunks to features(doc_id, granularity, index, bucket, v)."""
    return f"""tokens AS (SELECT doc_id, granularity, index, unnest(regexp_extract_all(lower(text), '\\p{{L}}+|\\p{{N}}+')) AS token FROM {source}),
{CRC},
features AS MATERIALIZED (SELECT doc_id, granularity, index, h % {dim} AS bucket, sum(CASE WHEN (h // 65536) % 2 = 1 THEN 1 ELSE -1 END)::BIGINT AS v
  FROM tokens JOIN hashed USING (token) GROUP BY ALL HAVING v <> 0)"""


def candidates(floor: float = 0.45) -> str:
    """CTEs from pairs and features to candidates(pair_id, granularity, i, j, s)."""
    return f"""norms AS MATERIALIZED (SELECT doc_id, granularity, index, sum(v * v) AS n2 FROM features GROUP BY ALL),
fa AS MATERIALIZED (SELECT pair_id, granularity, index AS i, bucket, v AS va FROM pairs JOIN features ON doc_a = doc_id),
fb AS MATERIALIZED (SELECT pair_id, granularity, index AS j, bucket, v AS vb FROM pairs JOIN features ON doc_b = doc_id),
dots AS MATERIALIZED (SELECT pair_id, granularity, i, j, sum(va * vb) AS dot FROM fa JOIN fb USING (pair_id, granularity, bucket) GROUP BY ALL HAVING dot > 0),
na AS MATERIALIZED (SELECT pair_id, granularity, index AS i, n2 AS na FROM pairs JOIN norms ON doc_a = doc_id),
nb AS MATERIALIZED (SELECT pair_id, granularity, index AS j, n2 AS nb FROM pairs JOIN norms ON doc_b = doc_id),
scaled AS MATERIALIZED (SELECT pair_id, granularity, i, j, dot / sqrt((na * nb)::DOUBLE) AS s FROM dots JOIN na USING (pair_id, granularity, i) JOIN nb USING (pair_id, granularity, j)),
candidates AS MATERIALIZED (SELECT * FROM scaled WHERE s >= {floor})"""


MATCHED = """sorted AS (SELECT pair_id, granularity, list([{'s': s, 'i': i, 'j': j}] ORDER BY s DESC, i DESC, j DESC) AS l FROM candidates GROUP BY ALL),
folded AS (SELECT pair_id, granularity, unnest(list_reduce(l, lambda kept, x: CASE WHEN len(list_filter(kept, lambda y: y.i = x[1].i OR y.j = x[1].j)) > 0 THEN kept ELSE kept || x END)) AS m FROM sorted),
matched AS MATERIALIZED (SELECT pair_id, granularity, m.i AS i, m.j AS j, m.s AS s FROM folded)"""

SIDES = """ca AS MATERIALIZED (SELECT pair_id, granularity, index AS i, text AS ta, section AS sa, weight AS wa FROM pairs JOIN chunks ON doc_a = doc_id),
cb AS MATERIALIZED (SELECT pair_id, granularity, index AS j, text AS tb, section AS sb, weight AS wb FROM pairs JOIN chunks ON doc_b = doc_id)"""


def changes(similarity: str = "s", threshold: float = 0.95, judged: str = "false", explanation: str = "''", more: str = "") -> str:
    """CTEs from matched and chunks to changes, with one row for each match and each chunk alone."""
    return f"""{SIDES},
attached AS MATERIALIZED (SELECT * FROM matched JOIN ca USING (pair_id, granularity, i) JOIN cb USING (pair_id, granularity, j)),
scored AS MATERIALIZED (SELECT a.*, {similarity} AS similarity, {judged} AS judged, {explanation} AS explanation FROM attached a {more}),
changes AS MATERIALIZED (
  SELECT pair_id, granularity, CASE WHEN similarity >= {threshold} THEN 'same' ELSE 'changed' END AS kind, similarity, (wa + wb) / 2 AS weight, ta, tb, sa, sb, explanation, judged, 0 AS k, i AS n FROM scored
  UNION ALL SELECT pair_id, granularity, 'deleted', 0.0, wa, ta, NULL, sa, NULL, '', false, 1, i FROM ca WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.pair_id = ca.pair_id AND m.granularity = ca.granularity AND m.i = ca.i)
  UNION ALL SELECT pair_id, granularity, 'added', 0.0, wb, NULL, tb, NULL, sb, '', false, 2, j FROM cb WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.pair_id = cb.pair_id AND m.granularity = cb.granularity AND m.j = cb.j))"""


def summary(levels: str = "('paragraph')") -> str:
    return f"""SELECT pair_id, granularity, round(100 * (1 - CASE WHEN den > 0 THEN num / den ELSE 0 END), 6) AS similarity_pct,
  round(100 - 100 * (1 - CASE WHEN den > 0 THEN num / den ELSE 0 END), 6) AS difference_pct, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b, coalesce(judged_pairs, 0) AS judged_pairs
FROM pairs CROSS JOIN (VALUES {levels}) AS g(granularity) LEFT JOIN (
  SELECT pair_id, granularity, sum((1 - similarity) * weight) AS num, sum(weight) AS den, count(ta) AS n_a, count(tb) AS n_b, count(*) FILTER (judged) AS judged_pairs FROM changes GROUP BY ALL) USING (pair_id, granularity)"""


def trimmed(c: str) -> str:
    flat = f"array_to_string(list_filter(string_split_regex({c}, '{SPACE}'), lambda w: w <> ''), ' ')"
    return f"CASE WHEN length({flat}) <= 100 THEN {flat} ELSE substr({flat}, 1, 99) || '…' END"


TEXT_PAIRS = f"{blocks()}, {PAIRS}, {chunks('paragraph')}, {features('(SELECT * FROM chunks WHERE doc_id IN (SELECT doc_a FROM pairs UNION SELECT doc_b FROM pairs))')}, {candidates()}, {MATCHED}"


def pdf_pages(columns: str = "doc_id, block_ord, page, text, is_heading, error", per_page: int = 40, words: int = 12, leading: int = 12) -> str:
    """What files made of page blocks hold: lines of `words` words, headings in 18 points of a body of 10."""
    return f"""WITH {blocks('pages')},
flat AS (SELECT doc_id, block_ord, is_heading AS big, list_filter(string_split_regex(text, '{SPACE}'), lambda w: w <> '') AS ws, row_number() OVER (PARTITION BY doc_id ORDER BY block_ord) - 1 AS k FROM blocks),
placed AS (SELECT doc_id, k, (k // {per_page} + 1)::INTEGER AS page, CASE WHEN big THEN 18.0 ELSE 10.0 END AS size, array_to_string(ws, ' ') AS text, CASE WHEN len(ws) = 0 THEN 0 WHEN big THEN 1 ELSE (len(ws) + {words} - 1) // {words} END::INTEGER AS n_lines FROM flat),
ys AS (SELECT *, 2000.0 - coalesce(sum({leading} * n_lines + 40) OVER (PARTITION BY doc_id, page ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS y FROM placed),
body AS (SELECT doc_id, page, median(size) AS body FROM (SELECT doc_id, page, size, unnest(range(n_lines)) FROM placed) GROUP BY doc_id, page),
read AS (SELECT doc_id::VARCHAR AS doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INTEGER AS block_ord, page, text, size >= 1.2 * body AS is_heading, NULL::VARCHAR AS error, 72.0::DOUBLE AS x, y::DOUBLE AS y, size::DOUBLE AS size, n_lines
  FROM ys JOIN body USING (doc_id, page) WHERE n_lines > 0)
SELECT {columns} FROM read"""


LISTINGS = """cells AS (SELECT s_suppkey % 5 AS doc, s_suppkey AS key, [s_suppkey::VARCHAR, CASE WHEN s_suppkey % 7 = 3 THEN '' ELSE s_name END, s_nationkey::VARCHAR] AS cs FROM supplier),
listed AS (SELECT doc::VARCHAR AS doc_id, 1 AS block_ord, 1 AS page, count(*)::INTEGER AS n_rows, 3 AS n_columns, string_agg(array_to_string(cs, '|'), chr(10) ORDER BY key) AS grid,
  array_to_string(list_filter(flatten(list(cs ORDER BY key)), lambda c: c <> ''), ' ') AS text FROM cells GROUP BY doc)"""

#: left edges: the listing's line and its cells, clustered where neighbours are at most 12 apart
COLUMNS = f"""WITH {LISTINGS}, edges AS (SELECT DISTINCT doc_id, 72.0 AS x FROM listed
  UNION SELECT doc::VARCHAR, [72.0, 190.0, 330.0][i] + key % 3 * 1.5 FROM (SELECT doc, key, cs, unnest([1, 2, 3]) AS i FROM cells) WHERE cs[i] <> ''),
gaps AS (SELECT doc_id, x, coalesce(x - lag(x) OVER (PARTITION BY doc_id ORDER BY x) > 12, true) AS opens FROM edges)
SELECT doc_id, 1 AS page, round(x, 6)::DOUBLE AS anchor FROM gaps WHERE opens"""


def reports(fmt: str) -> str:
    """Reports of the paragraph comparison of first-line pairs, without a judge."""
    flat = lambda c: f"array_to_string(list_filter(string_split_regex({c}, '{SPACE}'), lambda w: w <> ''), ' ')"
    cut = lambda c: f"CASE WHEN length({flat(c)}) <= 100 THEN {flat(c)} ELSE substr({flat(c)}, 1, 99) || '…' END"
    place = "coalesce(nullif(coalesce(sa, sb), ''), 'p1')"
    alone = f"CASE kind WHEN 'deleted' THEN {cut('ta')} ELSE {cut('tb')} END"
    lines = lambda *parts: " || chr(10) || ".join(parts)

    def entry(indent: int, name: str, sql: str, end: str = ",") -> str:
        return f"""'{" " * indent}"{name}": ' || {sql} || '{end}'"""

    quoted = lambda c: f"coalesce(to_json({c}::VARCHAR)::VARCHAR, 'null')"
    if fmt == "text":
        changed = lines(f"'  [CHANGED · sim ' || printf('%.2f', similarity) || ' · ' || printf('%.0f', weight) || 'w · ' || {place} || ']'", f"""'    A: "' || {cut("ta")} || '"'""", f"""'    B: "' || {cut("tb")} || '"'""")
        one, joined = f"""CASE WHEN kind = 'changed' THEN {changed} ELSE '  [' || upper(kind) || ' · ' || {place} || '] "' || {alone} || '"' END""", "chr(10)"
        whole = lines(
            "'PDF semantic comparison'", "'  A: ' || doc_a", "'  B: ' || doc_b", "'  embed: hash:1024   judge: none'", "''", "'SIMILARITY  paragraph=' || printf('%.1f', similarity_pct) || '%'", "''",
            "'── PARAGRAPH ★ ' || repeat('─', 40)", "'  similarity: ' || printf('%5.1f', similarity_pct) || '%   difference: ' || printf('%5.1f', difference_pct) || '%'",
            "'  chunks: A=' || n_a || ' B=' || n_b || '   judged pairs: 0'", "'  equivalent (unchanged in meaning): ' || coalesce(n_same, 0) || CASE WHEN body IS NULL THEN '' ELSE chr(10) || chr(10) || body END", "''",
        )
    elif fmt == "md":
        changed = lines(f"'- **CHANGED** · sim ' || printf('%.2f', similarity) || ' · ' || {place}", f"'  - A: ' || {cut('ta')}", f"'  - B: ' || {cut('tb')}")
        one, joined = f"CASE WHEN kind = 'changed' THEN {changed} ELSE '- **' || upper(kind) || '** · ' || {place} || ': ' || {alone} END", "chr(10)"
        whole = lines(
            "'# PDF semantic comparison'", "''", "'- **A:** `' || doc_a || '`'", "'- **B:** `' || doc_b || '`'", "'- **embed:** hash:1024 · **judge:** none'", "''", "'## Similarity'", "''", "'| Granularity | Similarity | Difference |'", "'| --- | --- | --- |'",
            "'| paragraph ★ | ' || printf('%.1f', similarity_pct) || '% | ' || printf('%.1f', difference_pct) || '% |'", "''", "'## Changes — paragraph'", "''", "coalesce(body || chr(10), '_No material differences._' || chr(10))",
        )
    else:
        similarity = "CASE WHEN kind = 'changed' THEN round(similarity, 4)::VARCHAR ELSE 'null' END"
        one, joined = lines("'        {'", *(entry(10, *x) for x in (("kind", quoted("kind")), ("similarity", similarity), ("weight", "weight::VARCHAR"), ("section", quoted(place)), ("a", quoted("ta")), ("b", quoted("tb")), ("explanation", "'null'", ""))), "'        }'"), "',' || chr(10)"
        level = (("similarity_pct", "round(similarity_pct, 2)::VARCHAR"), ("difference_pct", "round(difference_pct, 2)::VARCHAR"), ("n_chunks_a", "n_a"), ("n_chunks_b", "n_b"), ("judged_pairs", "0"), ("changes", "'[' || CASE WHEN body IS NULL THEN '' ELSE chr(10) || body || chr(10) || '      ' END", "]"))
        head = (("pdf_a", quoted("doc_a")), ("pdf_b", quoted("doc_b")), ("embed_backend", quoted("'hash:1024'")), ("judge_backend", quoted("'none'")), ("primary", quoted("'paragraph'")), ("granularities", "'{'", ""))
        whole = lines("'{'", *(entry(2, *x) for x in head), entry(4, "paragraph", "'{'", ""), *(entry(6, *x) for x in level), "'    }'", "'  }'", "'}'")
    return f"""WITH {TEXT_PAIRS}, {changes()},
sums AS (SELECT pair_id, sum((1 - similarity) * weight) AS num, sum(weight) AS den, count(ta) AS n_a, count(tb) AS n_b, count(*) FILTER (kind = 'same') AS n_same FROM changes GROUP BY pair_id),
real AS (SELECT *, CASE kind WHEN 'changed' THEN 0 WHEN 'deleted' THEN 1 ELSE 2 END AS o, weight * (1 - similarity) AS mass FROM changes WHERE kind <> 'same'),
shown AS (SELECT pair_id, string_agg({one}, {joined} ORDER BY o, mass DESC, k, n) AS body FROM real GROUP BY pair_id),
heads AS (SELECT pair_id, doc_a, doc_b, 100 * (1 - CASE WHEN den > 0 THEN num / den ELSE 0 END) AS similarity_pct, 100 - 100 * (1 - CASE WHEN den > 0 THEN num / den ELSE 0 END) AS difference_pct, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b, n_same, body
  FROM pairs LEFT JOIN sums USING (pair_id) LEFT JOIN shown USING (pair_id))
SELECT pair_id, {whole} AS report FROM heads"""
