"""DuckDB SQL of the queries on drafts, replies and texts."""

from __future__ import annotations

from ..functions.scoring import SPACE

_squeezed = lambda x: f"trim(regexp_replace(coalesce({x}, ''), '{SPACE}+', ' ', 'g'))"
_words = lambda x: f"len(list_filter(regexp_split_to_array({x}, '{SPACE}+'), lambda w: w <> ''))"
QUOTE = "et sitat på minst fire ord"

SQL = {
    "draft_shape": f"""WITH x AS (SELECT doc_id AS i, substring({_squeezed("CASE WHEN doc_id % 13 <> 0 THEN text END")}, 1, 180) AS title, substring({_squeezed("substring(text, 50, 600)")}, 1, 420) AS dek,
  list_filter(list_transform(string_split(text, chr(10)), lambda p: {_squeezed("p")}), lambda p: p <> '')[1:18] AS p, substring({_squeezed("text")}, 1, 2200) AS a FROM documents WHERE text IS NOT NULL), y AS (SELECT *, {_words("dek || ' ' || array_to_string(p, ' ')")} AS words FROM x)
  SELECT i AS id, sha256(title) AS title_sha256, length(dek) AS dek_chars, len(p) AS paragraphs, CASE WHEN i % 3 = 0 THEN 'Renter' WHEN i % 2 = 0 THEN 'Analyse' ELSE 'Markeder' END AS section, ['data_chart', 'none', 'none'][i % 3 + 1] AS visual_type,
  greatest(0, least(100, floor(i % 250 / 2 - 5 + 0.5)))::BIGINT AS quality_score, length(a) AS analysis_chars, title <> '' AND dek <> '' AND len(p) >= 2 AND words <= 1200 AS passed, words FROM y""",
    "enrichment_check": """SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN 'INVALID_ENRICHMENT_SHAPE' WHEN event_id % 11 = 0 THEN 'INVALID_ENRICHMENT_TEXT' WHEN event_id % 17 = 0 THEN 'ENRICHMENT_VERIFICATION_FAILED'
  WHEN event_id % 13 = 0 OR event_id % 4 = 3 THEN 'ENRICHMENT_EVIDENCE_MISSING' WHEN event_id % 7 = 0 AND event_id <> 99 THEN 'ENRICHMENT_NUMBER_NOT_IN_SOURCE' END AS reject FROM events""",
    "last_assertion": """WITH x AS (SELECT event_id AS i FROM events) SELECT i AS id, CASE WHEN i % 19 = 0 OR i % 23 = 0 THEN 'EDITORIAL_LEASE_LOST' WHEN i % 17 = 0 OR i % 13 = 0 THEN 'EDITORIAL_PROOF_CHANGED' WHEN i % 11 = 0 OR i % 7 = 0 THEN 'EDITORIAL_ARTICLE_NOT_READY'
  WHEN i % 9 = 0 THEN 'EDITORIAL_DRAFT_CHANGED' WHEN i % 8 = 0 THEN 'EDITORIAL_FACT_PACK_CHANGED' WHEN i % 5 = 0 OR i % 6 = 0 OR i % 40 > 36 THEN 'EDITORIAL_PUBLICATION_BLOCKED' END AS error FROM x""",
    "model_calls": """WITH x AS (SELECT event_id AS id, event_id // 5 % 4 AS a, CASE WHEN event_id % 7 = 0 THEN 429 WHEN event_id % 11 = 0 THEN 400 WHEN event_id % 13 = 0 THEN 503 ELSE 200 END AS s, event_id % 5 < 2 AS fine, event_id // 20 % 3 = 1 AS cut FROM events),
  y AS (SELECT *, CASE WHEN s = 400 THEN NULL WHEN s > 400 THEN 900 WHEN cut OR fine THEN NULL ELSE 700 END AS w FROM x), z AS (SELECT *, s = 200 AND fine AND NOT cut AS ok, w IS NOT NULL AND a < 3 AS again FROM y)
  SELECT id, CASE WHEN ok THEN 'ok' WHEN again THEN 'again' ELSE 'failed' END AS outcome, CASE WHEN again THEN (w * pow(2, a))::BIGINT END AS wait_ms, CASE WHEN again THEN least(8000, floor(3000 * (1 + (a + 1) * 0.35::DOUBLE) + 0.5))::BIGINT END AS next_tokens FROM z""",
    "text_parts": rf"""WITH x AS (SELECT doc_id AS id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS line FROM documents WHERE text IS NOT NULL)
  SELECT id, len(list_filter(string_split(text, chr(10)), lambda p: trim(p) <> '')) AS paragraphs, 1 AS links, sha256('Se kilden og «{QUOTE}», ' || text) AS plain_sha256, '{QUOTE}' AS quote,
  1 + len(regexp_extract_all(text, '[.!?]\s+[A-ZÆØÅ–]')) AS sentences, len(list_distinct(list_transform(regexp_extract_all(text, '\d+(?:[,.]\d+)?'), lambda n: replace(n, ',', '.')::DOUBLE))) AS numbers,
  length(substring(trim(regexp_replace(repeat(text, 4), '\s+', ' ', 'g')), 1, 1800)) AS window_chars FROM x""",
}
