"""DuckDB SQL of the desk's own changes and calls."""

from __future__ import annotations

from ..operators.evidence import STOP
from .oracle import ARTICLES, HEADLINES, _list

K = "json_extract(props, '$.k')::BIGINT"
_PEAK = "dayofweek(ts) BETWEEN 1 AND 5 AND (hour(ts) BETWEEN 1 AND 3 OR hour(ts) BETWEEN 6 AND 9)"
_TERMS = f"list_filter(string_split(trim(regexp_replace(lower(title || ' ' || coalesce(summary, '')), '[^a-z0-9æøå]+', ' ', 'g')), ' '), lambda x: length(x) >= 3 AND NOT list_contains({_list(STOP)}, x))"

SQL = {
    "usage_costs": f"""WITH x AS (SELECT ts::DATE AS day, event_type AS step, event_id AS i, {K} AS k, {_PEAK} AS peak FROM events), y AS (SELECT day, step, CASE WHEN i % 2 = 0 THEN 'raw' ELSE 'radar' END AS tariff, i % 1000 AS p, CASE WHEN i % 5 <> 0 THEN k * 3 ELSE 0 END AS o,
  (k * 7 * CASE WHEN i % 2 = 0 THEN 0.003 ELSE 0.022 END::DOUBLE + CASE WHEN i % 3 <> 0 THEN i % 900 ELSE i % 1000 END * CASE WHEN i % 2 = 0 THEN 0.15 ELSE 0.66 END::DOUBLE + CASE WHEN i % 5 <> 0 THEN k * 3 ELSE 0 END * CASE WHEN i % 2 = 0 THEN 0.6 ELSE 1.98 END::DOUBLE) * CASE WHEN peak THEN 2 ELSE 1 END / 1e6 AS c FROM x)
  SELECT day, step, tariff, count(*) AS calls, sum(p)::BIGINT AS tokens_in, sum(o)::BIGINT AS tokens_out, round(sum(c), 6) AS cost FROM y GROUP BY ALL""",
    "guarded_changes": f"""WITH {ARTICLES}, x AS (SELECT id, status, pinned, pin_place, CASE WHEN id % 4 <> 1 THEN published END AS published, max(published) OVER () AS as_of, ['approve', 'reject', 'archive', 'pin', 'unpin'][id % 5 + 1] AS action FROM articles)
  SELECT id, action, CASE action WHEN 'approve' THEN 'live' WHEN 'reject' THEN 'rejected' WHEN 'archive' THEN 'archived' ELSE status END AS status, CASE WHEN action IN ('archive', 'unpin') THEN false WHEN action = 'pin' THEN true ELSE pinned END AS pinned,
  CASE WHEN action IN ('archive', 'unpin') THEN NULL WHEN action = 'pin' THEN 1 ELSE pin_place END AS pin_place, CASE WHEN action = 'approve' THEN coalesce(published, as_of) ELSE published END AS published
  FROM x WHERE action = 'archive' OR action IN ('approve', 'reject') AND status = 'draft' OR action IN ('pin', 'unpin') AND status = 'live'""",
    "failed_cases": f"""WITH x AS (SELECT event_id AS id, {K} % 7 AS revision, CASE WHEN event_id % 4 <> 0 THEN 't' || event_id % 9 END AS token, ts, event_type = 'error' AND event_id % 4 <> 0 AND event_id % 3 <> 0 AS hit FROM events)
  SELECT id, CASE WHEN hit THEN 'failed' ELSE 'writing' END AS state, revision, CASE WHEN NOT hit THEN token END AS token, CASE WHEN hit THEN ts + INTERVAL 2 MINUTE END AS retry_after, CASE WHEN hit THEN 800 END AS error_chars, CASE WHEN hit THEN 812 END AS logged FROM x""",
    "source_searches": f"""WITH {HEADLINES}, x AS (SELECT id, title, CASE id % 3 WHEN 0 THEN 'They said «we will sell the whole fleet ' || id || '» and left' WHEN 1 THEN 'Item number ' || id END AS summary FROM h), y AS (SELECT id, {_TERMS} AS w FROM x),
  z AS (SELECT id, list_filter(w, lambda v, i: list_position(w, v) = i) AS w FROM y)
  SELECT id, 0 AS place, array_to_string(w[1:6], ' ') AS query FROM z WHERE len(w) >= 2 UNION ALL SELECT id, 1, '"we will sell the whole fleet ' || id || '"' FROM z WHERE len(w) >= 2 AND id % 3 = 0""",
    "case_rows": f"""WITH {ARTICLES}, c AS (SELECT event_id AS id, event_id + {K} AS item, user_id % 40 AS run, CASE WHEN event_id % 2 = 0 THEN event_id END AS article FROM events WHERE event_type <> 'view'), r AS (SELECT event_id AS item, CASE WHEN {K} % 3 <> 0 THEN {K} * 37 % 100 END AS rank FROM events)
  SELECT run, c.id, rank, CASE WHEN c.id % 5 = 0 THEN (c.id % 10 = 0)::VARCHAR END AS verification_pending, a.status AS article_status FROM c JOIN r USING (item) LEFT JOIN articles a ON a.id = c.article""",
    "breaking_json": f"""WITH {ARTICLES}, l AS (SELECT id, published, max(published) OVER () AS m FROM articles WHERE status = 'live'), t AS (SELECT * FROM l WHERE published > m - INTERVAL 2 HOUR ORDER BY published DESC, id DESC LIMIT 1)
  SELECT '{{"story":{{"id":' || id || ',"at":"' || strftime(published, '%Y-%m-%dT%H:%M:%S') || '"}}}}' AS json FROM t""",
    "health_json": """SELECT '{"ok":true,"counts":{"articles":' || (SELECT count(*) FROM orders) || ',"feed":' || (SELECT count(*) FROM events) || ',"markets":' || (SELECT count(DISTINCT user_id) FROM events) || '}}' AS json""",
}
