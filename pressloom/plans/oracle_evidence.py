"""DuckDB SQL of the queries on sources, dates, clocks and quotes. URLs are made of known parts, so what is expected of
each part is stated here by hand."""

from __future__ import annotations

from ..functions import timing as T
from ..functions.unicode import BASE, MARKED
from ..operators.clocks import SYMBOLS
from ..operators.evidence import CHAIN, HOSTS, PATHS, SCHEMES, STOP
from .oracle import HEADLINES, _list

PLAIN = f"trim(regexp_replace(translate(lower(%s), '{MARKED}', '{BASE}'), '[^a-z0-9æøå]+', ' ', 'g'))"


def _words(x: str) -> str:
    return f"list_distinct(list_filter(string_split({PLAIN % x}, ' '), lambda x: length(x) >= 3 AND NOT list_contains({_list(STOP)}, x)))"


BRANDS = ["ssb", "reuters", "equinor", "example", "dn", "euronext", "newsweb", "nvidia", "yahoo", "sec"]
CONTAINED = "CASE WHEN least(len(w), len(v)) > 0 THEN len(list_intersect(w, v))::DOUBLE / least(len(w), len(v)) ELSE 0 END"
ITEMS = f"""{HEADLINES}, it0 AS (SELECT id, title, CASE WHEN id % 4 <> 0 THEN 'Summary of item ' || id || ' with enough text' END AS summary, {_list(SCHEMES)}[id % 5 + 1] AS scheme, {_list(HOSTS)}[id % 10 + 1] AS host,
  {_list(PATHS)}[(id // 3) % 8 + 1] AS path, id % 10 AS hi, (id // 3) % 8 AS pi, id % 5 AS si, score, published, (user_id % 97) || '|' || source_kind || '|' || strftime(published, '%Y-%m-%d') AS event_key FROM h),
  it1 AS (SELECT *, scheme || host || path AS url, pi IN (1, 3, 5) AS is_index, hi IN (0, 6, 9) OR hi = 5 AND pi = 4 AS specific, hi IN (0, 9) AS official_host, pi IN (1, 2, 7) AS company_path, {_list(BRANDS)}[hi + 1] AS brand,
  CASE WHEN si >= 3 THEN 'unknown' WHEN hi IN (0, 5, 6, 9) THEN 'primary' WHEN hi IN (1, 4) THEN 'trusted_secondary' ELSE 'unknown' END AS url_role,
  CASE hi WHEN 1 THEN 'Reuters' WHEN 4 THEN 'Dagens Næringsliv' END AS paper, length(concat_ws('. ', title, summary)) AS chars FROM it0),
  it AS (SELECT *, CASE url_role WHEN 'primary' THEN 'official' WHEN 'trusted_secondary' THEN 'high' ELSE 'unknown' END AS url_quality, CASE WHEN url_role = 'primary' THEN 'primary' WHEN paper IS NOT NULL AND chars >= 40 THEN 'trusted_secondary' END AS role,
  CASE WHEN url_role = 'primary' THEN '{CHAIN[1]}' WHEN paper IS NOT NULL AND chars >= 40 THEN '{CHAIN[4]}' END AS method FROM it1)"""
MATES = """rk AS (SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY CASE WHEN paper IS NULL THEN 1 ELSE 0 END, score DESC NULLS LAST, published DESC NULLS LAST, id) AS rank FROM it),
  dd AS (SELECT *, row_number() OVER (PARTITION BY event_key, url ORDER BY rank) AS again FROM rk WHERE rank <= 12 AND role IS NOT NULL),
  mates AS (SELECT it.id AS item, dd.rank, dd.id AS mate, dd.url, dd.role, dd.method, dd.is_index FROM it JOIN dd USING (event_key) WHERE again = 1)"""
_clean = lambda q: f"scheme || host || CASE WHEN pi = 6 THEN '/a/b?{q}' ELSE path END"
_plural = lambda n, one, more: f"{n} || CASE WHEN {n} = 1 THEN ' {one} siden' ELSE ' {more} siden' END"
_no = lambda x, digits: f"translate(format('{{:,.{digits}f}}', {x}), ',.-', ' ,−')"
LOCAL = "(ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Oslo')"
_RANGE = f"""WITH {HEADLINES}, t AS (SELECT DISTINCT title, {_words('title')} AS w FROM h), p AS (SELECT a.title AS one, b.title AS two, len(list_intersect(a.w, b.w))::DOUBLE / least(len(a.w), len(b.w)) AS score FROM t a, t b WHERE len(list_intersect(a.w, b.w)) > 0),
  c AS (SELECT i.id, r.id AS raw_id, r.published, p.score FROM h i JOIN h r ON r.source_kind = 'error' AND r.published BETWEEN i.published - INTERVAL 4 DAY AND i.published + INTERVAL 2 DAY JOIN p ON p.one = i.title AND p.two = r.title WHERE i.source_kind = 'click')
  SELECT id, arg_max(raw_id, (score, published, -raw_id)) AS raw_id, round(max(score), 6) AS score FROM c GROUP BY id"""
_SEARCH = f"""WITH {ITEMS}, f AS (SELECT id - 1 AS id, url, title, is_index, url_role, official_host, company_path, brand FROM it UNION ALL SELECT id - 2, url, title, is_index, url_role, official_host, company_path, brand FROM it),
  w AS (SELECT it.id, f.* EXCLUDE (id), {_words("concat_ws(' ', it.title, it.summary)")} AS w, {_words('f.title')} AS v, replace({PLAIN % "concat_ws(' ', it.title, it.summary)"}, ' ', '') AS compact FROM it JOIN f ON f.id = it.id WHERE f.url_role = 'primary' AND NOT f.is_index),
  s AS (SELECT *, {CONTAINED} AS likeness FROM w), u AS (SELECT id, url, max(round(likeness + 1.2 + CASE WHEN official_host THEN 0.4 ELSE 0 END + CASE WHEN company_path THEN 0.35 ELSE 0 END, 6)) AS score FROM s WHERE contains(compact, brand) OR likeness >= 0.25 GROUP BY id, url)
  SELECT id, arg_max(url, (score, url)) AS url, max(score)::DOUBLE AS score FROM u GROUP BY id"""

SQL = {
    "canonical_urls": f"WITH {ITEMS} SELECT id, CASE WHEN si < 4 THEN {_clean('a=1&b=2')} END AS canonical, {_clean('b=2&a=1')} AS cleaned, brand, is_index, specific, official_host, company_path FROM it",
    "source_role": f"WITH {ITEMS} SELECT id, url_role, url_quality, role, method, paper FROM it",
    "public_addresses": """WITH x AS (SELECT event_id AS i, event_id % 256 AS a, event_id * 37 % 256 AS b FROM events)
  SELECT i AS id, CASE WHEN i % 3 = 0 THEN i % 5 IN (0, 3) WHEN i % 7 = 0 THEN false ELSE NOT (a IN (0, 10, 127) OR a >= 224 OR a = 169 AND b = 254 OR a = 172 AND b BETWEEN 16 AND 31 OR a = 192 AND b = 168 OR a = 100 AND b BETWEEN 64 AND 127 OR a = 198 AND b IN (18, 19)) END AS public FROM x""",
    "publication_evidence": """WITH x AS (SELECT event_id AS id, event_id % 8 IN (0, 1, 5) AS known, event_id % 8 AS m, ts FROM events)
  SELECT id, CASE WHEN known THEN floor(epoch(ts))::BIGINT END AS second, CASE WHEN known THEN CASE WHEN m = 5 THEN 'article_jsonld' ELSE 'publication_meta' END END AS kind, CASE WHEN known THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS raw FROM x""",
    "strict_dates": """WITH x AS (SELECT event_id AS id, event_id % 33 AS d, ts FROM events)
  SELECT id, CASE WHEN id % 4 <> 3 AND d BETWEEN 1 AND day(last_day(ts)) THEN (epoch(date_trunc('month', ts)) + (d - 1) * 86400 + hour(ts) * 3600 + minute(ts) * 60 + CASE WHEN id % 2 = 0 THEN second(ts) ELSE 0 END - [0, 7200, -19800][id % 4 + 1])::BIGINT END AS second FROM x""",
    "standard_forms": """WITH x AS (SELECT event_id AS id, event_id % 7 AS c, CASE WHEN event_id % 65536 = 0 THEN '' ELSE lower(to_hex(event_id % 65536)) END AS h FROM events),
  y AS (SELECT *, CASE c WHEN 0 THEN 'https://www.example.no/b/' || id WHEN 1 THEN 'http://127.0.0.1/%41%20%C3%A9?q=%27' || id WHEN 2 THEN 'https://xn--bcher-kva.example/x#' || id WHEN 3 THEN 'http://[2001:db8::' || h || ']/'
  WHEN 4 THEN 'https://a.no/x?utm_source=1&b=2&a=' || id WHEN 6 THEN 'https://u:p@a.no/' || id END AS standard FROM x)
  SELECT id, standard, CASE c WHEN 2 THEN 'https://xn--bcher-kva.example/x' WHEN 4 THEN 'https://a.no/x?a=' || id || '&b=2' WHEN 6 THEN NULL WHEN 1 THEN 'http://127.0.0.1/%41%20%C3%A9?q=%27' || id ELSE standard END AS canonical,
  CASE c WHEN 0 THEN 'example.no' WHEN 1 THEN '127.0.0.1' WHEN 2 THEN 'xn--bcher-kva.example' WHEN 3 THEN '[2001:db8::' || h || ']' WHEN 4 THEN 'a.no' WHEN 6 THEN 'a.no' ELSE '' END AS host FROM y""",
    "cluster_mates": f"WITH {ITEMS}, {MATES} SELECT item, rank, mate, url, role, method FROM mates",
    "title_range_match": _RANGE,
    "source_search": _SEARCH,
    "source_chain": f"""WITH {ITEMS}, {MATES}, c AS (SELECT id, 0 AS prio, url, 'primary' AS role FROM it WHERE specific AND NOT is_index
  UNION ALL SELECT item, 1, arg_min(url, (rank, url)), 'primary' FROM mates WHERE role = 'primary' AND NOT is_index GROUP BY item UNION ALL SELECT id, 2, url, 'primary' FROM ({_SEARCH})
  UNION ALL SELECT t.id, 3, it.url, 'primary' FROM ({_RANGE}) t JOIN it ON it.id = t.raw_id WHERE t.score >= 0.65 AND it.specific UNION ALL SELECT item, 4, arg_min(url, (rank, url)), 'trusted_secondary' FROM mates WHERE role = 'trusted_secondary' GROUP BY item
  UNION ALL SELECT id, 5, url, 'trusted_secondary' FROM it WHERE role = 'trusted_secondary') SELECT id, {_list(CHAIN)}[min(prio) + 1] AS method, arg_min(url, prio) AS url, arg_min(role, prio) AS role FROM c GROUP BY id""",
    "supporting_sources": f"""WITH {ITEMS}, {MATES}, tx AS (SELECT url, min(id) * 7 % 90 AS chars FROM it GROUP BY url), mn AS (SELECT item, url AS main FROM mates WHERE rank = 1),
  o AS (SELECT m.item, m.rank, m.url, row_number() OVER (PARTITION BY m.item ORDER BY m.rank) AS tried FROM mates m LEFT JOIN mn USING (item) WHERE main IS NULL OR url <> main),
  k AS (SELECT item, rank, url, row_number() OVER (PARTITION BY item ORDER BY rank) AS place FROM o JOIN tx USING (url) WHERE tried <= 3 AND chars >= 40) SELECT item AS id, place, url FROM k WHERE place <= 2""",
    "time_labels": f"""WITH x AS (SELECT event_id AS id, ts, {LOCAL} AS l, floor((epoch(max(ts) OVER ()) - epoch(ts)) / 60)::BIGINT AS m FROM events)
  SELECT id, hour(l) >= {T.OPENS} AS open, CASE WHEN m < 1 THEN 'nå' WHEN m < 60 THEN m || ' min siden' WHEN m < 1440 THEN {_plural("(m // 60)", "time", "timer")} ELSE {_plural("(m // 1440)", "dag", "dager")} END AS said,
  strftime(l, '%H:%M') AS clock, day(l) || '. ' || {_list(T.MONTHS)}[month(l)] || ' ' || year(l) || ' kl. ' || strftime(l, '%H:%M') AS full_date FROM x""",
    "pulse_health": f"""WITH x AS (SELECT event_id AS id, event_id % 5 <> 0 AS enabled, event_id % 7 <> 0 AS ever, event_id % 25 AS late, (hour({LOCAL}) - 6) * 60 + minute(ts) + floor(second(ts)) / 60 AS opened, hour({LOCAL}) >= 6 AS open, ts FROM events),
  y AS (SELECT *, greatest(0, CASE WHEN ever THEN least(late, opened) ELSE opened END) AS gap FROM x)
  SELECT id, CASE WHEN NOT enabled THEN 'paused' WHEN NOT open THEN 'closed' WHEN gap >= 15 THEN 'error' WHEN gap >= 10 THEN 'warning' ELSE 'ok' END AS status, CASE WHEN enabled AND open THEN floor(greatest(0, gap - 5))::BIGINT ELSE 0 END AS delay_minutes, floor(gap)::BIGINT AS gap_minutes,
  dayofweek(ts) BETWEEN 1 AND 5 AND hour(ts) BETWEEN 6 AND 16 AND (NOT ever OR late > 10 OR late = 10 AND floor(epoch(ts)) < epoch(ts)) AS watch_late FROM y""",
    "retry_waits": """WITH x AS (SELECT event_type AS kind, nullif(json_extract(props, '$.k')::BIGINT % 5, 4) AS attempts, count(*) AS n FROM events GROUP BY ALL)
  SELECT *, CASE WHEN attempts >= 2 THEN 900 WHEN attempts = 1 THEN 300 ELSE 90 END AS scoring, CASE WHEN attempts >= 2 THEN 1200 WHEN attempts = 1 THEN 420 ELSE 120 END AS research, least(300, 30 * coalesce(attempts, 0)) AS job, 120 AS case_wait FROM x""",
    "market_formats": f"""WITH x AS (SELECT event_id AS id, {_list(SYMBOLS)}[event_id % 4 + 1] AS s, round(value * 1000, 1) AS v, floor(value - 50) / 4 AS c FROM events)
  SELECT id, CASE WHEN s = 'NOKPOLICY' THEN {_no('v', 2)} || ' %' WHEN s = 'EURNOK' THEN {_no('v', 4)} ELSE {_no('v', 2)} END AS value, CASE WHEN c > 0 THEN '+' WHEN c < 0 THEN '−' ELSE '' END || {_no('abs(c)', 2)} || CASE WHEN s = 'NOKPOLICY' THEN ' pp' ELSE ' %' END AS change FROM x""",
}
