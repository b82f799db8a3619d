"""DuckDB SQL for those queries that SQL can express."""

from __future__ import annotations

_WS = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"
_PHRASES = (
    "all rights reserved|licensed under|copyright|cookie|terms of use|privacy policy|subscribe|javascript|click here|lorem ipsum"
)

_ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '{_ITEM_WORD}') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '{_ITEM_WORD}') AS ws FROM benchmark
), bw AS (
  SELECT item_id, least(len(ws), 8) AS n, ws, unnest(range(1, len(ws) - least(len(ws), 8) + 2)) AS i
  FROM b WHERE len(ws) > 0
), items AS (
  SELECT DISTINCT n, array_to_string(ws[i:i + n - 1], ' ') AS g, item_id FROM bw
), sizes AS (
  SELECT DISTINCT n FROM items
), dw AS (
  SELECT rid, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n
), hits AS (
  SELECT rid, i, n, item_id
  FROM (SELECT rid, i, n, array_to_string(ws[i:i + n - 1], ' ') AS g FROM dw) JOIN items USING (n, g)
), words AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rid
), by_item AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY rid
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN by_item USING (rid)
"""

OP2 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '{_WORD}') AS ws FROM d
), win AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)
), rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n >= 2
), reps AS (
  SELECT rid, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid
), lines AS (
  SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d
), judged AS (
  SELECT rid, line, len(regexp_extract_all(line, '{_WORD}')) AS words,
         len(regexp_extract_all(line, '[|»›•·]')) AS seps,
         len(regexp_extract_all(line, '[#*$%&|<>]')) AS syms,
         regexp_matches(lower(line), '{_PHRASES}') AS phrase,
         regexp_matches(line, '[.!?…:;,)\]"''”’»。！？؟]{_WS}*$') AS closed
  FROM lines WHERE regexp_matches(line, '{_WORD}')
), failed AS (
  SELECT rid, line,
         (seps >= 3 AND seps * 4 >= words)
         OR (syms >= 4 AND (syms * 5 >= length(line) OR syms * 2 >= words * 3))
         OR (phrase AND words <= 30)
         OR (words < 4 AND NOT closed) AS fails
  FROM judged
), by_line AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines,
         count(*) FILTER (fails) AS n_lines_removed,
         coalesce(sum(length(regexp_replace(line, '{_WS}+', '', 'g'))) FILTER (fails), 0) AS lost
  FROM failed GROUP BY rid
), m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(n_lines_removed, 0)::BIGINT AS n_lines_removed, coalesce(lost, 0) AS lost
  FROM w LEFT JOIN reps USING (rid) LEFT JOIN by_line USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost * 100 <= word_chars * 40 AS kept,
       n_lines_removed
FROM m
"""


_ESCAPED = "replace(replace({}, '\\', '\\b'), '<|', '\\l')"

OP5 = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) t(k)
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}) + 23)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""


OP6 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages
), r AS (
  SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes, sha1(payload) AS h,
         min(page_id) OVER (PARTITION BY payload) AS original
  FROM p
)
SELECT page_id, payload_bytes,
       array_to_string([
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                1 + ((('0x' || substr(h, (1 + 5 * (i // 4))::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)
         FOR i IN range(32)
       ], '') AS payload_digest,
       CASE WHEN coalesce(page_id = original, original IS NULL) THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN coalesce(page_id = original, original IS NULL) THEN NULL ELSE original END AS refers_to
FROM r
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontaminate": OP1,
        "op2_quality_rules": OP2,
        "op5_chat_format": OP5,
        "op6_warc": OP6,
    }
