"""DuckDB SQL of the readers' queries: what the bodies were written from."""

from __future__ import annotations

from ..sources.readings import CURRENCIES, PAGE_URL

EV = "e AS (SELECT event_id AS id, date_trunc('second', ts) AS ts, user_id, event_type, value, json_extract(props, '$.k')::BIGINT AS k, ts::DATE AS day FROM events)"
_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_DECISION = """CASE WHEN c = 0 THEN 'UNTRUSTED_DECISION_URL' WHEN c = 1 THEN 'AMBIGUOUS_RATE_HEADING' WHEN c = 2 THEN 'AMBIGUOUS_RATE_DECISION' WHEN c = 4 THEN 'PUBLICATION_TIME_MISSING' WHEN c = 5 THEN 'PUBLICATION_TIME_CONFLICT'
  WHEN c = 7 THEN 'DECISION_NOT_FRESH' WHEN c = 8 THEN 'DECISION_DATE_CONFLICT' WHEN c = 9 THEN 'DECISION_NOT_CONFIRMED' WHEN c = 10 AND NOT flat THEN 'RATE_TEXT_CONFLICT' WHEN c = 12 THEN 'RATE_DIRECTION_CONFLICT' WHEN c = 11 AND flat THEN 'UNCHANGED_RATE_NOT_CONFIRMED' END"""

SQL = {
    "index_read": f"""WITH {EV}, x AS (SELECT *, 'index ' || user_id || ' ' || day AS name, row_number() OVER (PARTITION BY user_id, day ORDER BY id) - 1 AS place FROM e)
  SELECT name || CASE WHEN id % 4 <> 0 THEN ' · www.n.example.com' ELSE '' END AS source_name, 'news-index' AS source_kind, CASE WHEN id % 4 <> 0 THEN 'www.n.example.com' ELSE 'n' || id % 5 || '.example.com' END AS source_domain, 'Item & ' || id AS title,
  CASE WHEN id % 2 = 0 THEN 'US · English' ELSE 'US' END AS summary, 'https://www.n' || id % 5 || '.example.com/a?id=' || id AS url, epoch(CASE WHEN id % 3 = 1 THEN date_trunc('minute', ts) ELSE ts END)::BIGINT AS second, place FROM x WHERE place < 60 AND id % 11 <> 0""",
    "fx_read": f"""WITH {EV}, x AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY id DESC) AS n, {_list(CURRENCIES)}[user_id % 6 + 1] AS c FROM e WHERE id % 13 <> 0),
  y AS (SELECT user_id, day, any_value(c) AS c, max(floor(value)) FILTER (n = 1) AS latest, max(floor(value)) FILTER (n = 2) AS before FROM x GROUP BY ALL),
  z AS (SELECT *, CASE WHEN c IN ('SEK', 'DKK', 'CHF') THEN 100 ELSE 1 END AS unit FROM y)
  SELECT user_id, day::VARCHAR AS day, c || 'NOK' AS symbol, round(latest / unit, 6) AS value, round(CASE WHEN coalesce(before, latest) = 0 THEN 0 ELSE (latest / coalesce(before, latest) - 1) * 100 END, 6)::DOUBLE AS change_pct FROM z""",
    "quotes_read": f"""WITH {EV}, x AS (SELECT id, 'S' || user_id % 11 AS symbol, id % 7 AS c, floor(value) AS p, k FROM e)
  SELECT id, symbol, CASE WHEN c BETWEEN 1 AND 4 THEN p END AS value, CASE WHEN c = 1 THEN 0 WHEN c = 2 THEN round((p / (k + 1) - 1) * 100, 6) WHEN c IN (3, 4) THEN round((p / (k + 2) - 1) * 100, 6) END::DOUBLE AS change_pct,
  CASE WHEN c = 0 THEN 'no valid price' WHEN c >= 5 THEN 'no market data' END AS error FROM x""",
    "policy_read": f"""WITH {EV}, x AS (SELECT id, CASE WHEN id % 4 = 0 THEN k % 9 + 0.25 WHEN id % 4 = 1 THEN k % 7 END::DOUBLE AS page, CASE WHEN id % 5 <> 0 THEN k + 0.5 END::DOUBLE AS api_rate FROM e)
  SELECT id, coalesce(page, api_rate) AS rate, api_rate, CASE WHEN page IS NOT NULL THEN 'official-page' ELSE 'api' END AS source FROM x WHERE page IS NOT NULL OR api_rate IS NOT NULL""",
    "company_read": f"""WITH {EV}, x AS (SELECT *, user_id || ' ' || day AS page, strftime(ts, '%-d %b %Y %H:%M') || CASE WHEN id % 2 = 0 THEN ' CET' ELSE ' CEST' END AS stamp, row_number() OVER (PARTITION BY user_id, day ORDER BY id) AS place FROM e WHERE id % 6 <> 0 AND id % 7 <> 0 AND id % 9 <> 0)
  SELECT page AS id, place, epoch(date_trunc('minute', ts))::BIGINT - CASE WHEN id % 2 = 0 THEN 3600 ELSE 7200 END AS second, 'A ' || user_id AS company, 'News & ' || x.id AS title, event_type AS category, 'https://live.euronext.com/en/company-news/' || x.id AS url,
  'Selskap: A ' || user_id || chr(10) || 'Kategori: ' || event_type || chr(10) || 'Sektor: Energy' || chr(10) || 'Tittel: News & ' || x.id AS body, substring(sha256(stamp || '|A ' || user_id || '|News & ' || x.id), 1, 40) AS external_id FROM x WHERE place <= 50""",
    "decision_feed": f"""WITH {EV} SELECT '{PAGE_URL}' || strftime(ts, '%Y/%Y-%m-%d') || '-rente/' AS url, epoch(ts)::BIGINT AS second FROM e WHERE id % 5 <> 0 AND id % 7 <> 0 AND (k % 60 - 5) * 180 BETWEEN -60 AND 7200""",
    "decision_read": f"""WITH {EV}, x AS (SELECT id, ts, id % 14 AS c, k % 9 + 1 AS old, CASE WHEN id % 14 = 12 THEN k % 9 + 1 WHEN id % 3 = 1 THEN k % 9 ELSE k % 9 + 2 END AS new, id % 3 = 2 AND id % 14 <> 12 AS flat, id % 3 = 0 OR id % 14 = 12 AS up FROM e),
  y AS (SELECT *, {_DECISION} AS reject, CASE WHEN up THEN 'up' WHEN flat THEN 'unchanged' ELSE 'down' END AS way, CASE WHEN up THEN 'hever' WHEN flat THEN 'holder' ELSE 'senker' END AS verb FROM x),
  z AS (SELECT *, 'Norges Bank ' || verb || CASE WHEN flat THEN ' styringsrenten uendret på ' || old ELSE ' styringsrenten til ' || new END || ' prosent' AS head FROM y)
  SELECT id, reject, CASE WHEN reject IS NULL THEN CASE WHEN flat THEN old ELSE new END END::DOUBLE AS rate, CASE WHEN reject IS NULL AND NOT flat THEN old END::DOUBLE AS previous, CASE WHEN reject IS NULL THEN way END AS direction, CASE WHEN reject IS NULL THEN head END AS headline,
  CASE WHEN reject IS NULL THEN CASE WHEN flat THEN head || '.' ELSE 'Norges Bank ' || verb || ' styringsrenten fra ' || old || ' til ' || new || ' prosent.' END END AS fact, CASE WHEN reject IS NULL THEN epoch(ts)::BIGINT END AS second FROM z""",
    "named_signs": f"WITH {EV} SELECT id, 'Øl &lt; å' || chr(128512) || ' &unknown; &#xD800; ' || event_type || '…' || id || '&' AS text FROM e",
    "review_gate": """WITH b AS (SELECT conv_id AS c, turn AS t, CASE WHEN (conv_id + turn) % 11 = 0 THEN '' ELSE text END AS text, conv_id % 3 <> 0 OR turn % 2 = 0 AS checked FROM conversations),
  r AS (SELECT c, t, 1 AS o, 'unsupported:b' || t AS why FROM b WHERE NOT checked OR coalesce(text, '') = '' OR t % 5 = 3 OR t % 4 = 2 OR t % 6 = 4 UNION ALL SELECT c, t, 2, 'facts_mismatch:b' || t FROM b WHERE NOT checked OR t % 7 = 5),
  f AS (SELECT c, string_agg(why, ',' ORDER BY t, o) AS w FROM r GROUP BY c), n AS (SELECT c, count(*) AS blocks, count(*) FILTER (checked) AS checks FROM b GROUP BY c)
  SELECT n.c AS conv_id, array_to_string(list_filter([CASE WHEN n.c % 5 = 0 THEN 'reviewer_rejected' END, CASE WHEN blocks <> checks THEN 'incomplete_review' END, w, CASE WHEN n.c % 7 = 0 THEN 'investment_advice_check_failed' END], lambda x: x IS NOT NULL), ',') AS reasons FROM n LEFT JOIN f ON f.c = n.c""",
}
