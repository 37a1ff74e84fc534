"""DuckDB SQL of the queries on time and order."""

from __future__ import annotations

SQL = {
    "thinned_events": """WITH RECURSIVE kept AS (SELECT event_type AS k, min(ts) AS t FROM events GROUP BY event_type
  UNION ALL SELECT k, t FROM (SELECT k, (SELECT min(ts) FROM events e WHERE e.event_type = kept.k AND e.ts >= kept.t + INTERVAL 8 HOUR) AS t FROM kept) WHERE t IS NOT NULL)
  SELECT min(event_id) AS id, ts, event_type AS event_key FROM kept JOIN events ON event_type = k AND ts = t GROUP BY ts, event_type""",
}
