"""DuckDB SQL of the state changes, lists and queues."""

from __future__ import annotations

import re

from ..functions import vocabulary as V
from ..operators.lists import BOARD, LIVE_TYPES, MODEL, STATUS_ORDER
from ..operators.state import EDIT_SECTIONS
from ..sources.catalogue import FEEDS, INDEX_QUERIES, LIVE_FEEDS, LIVE_QUERIES
from ..sources.feeds import AGE_HOURS
from ..sources.tables import EVENT_KINDS, SOURCE_DOMAINS
from .oracle import ARTICLES, FEED, HEADLINES, RADAR, _hit, _hits, _list, _pick

K = "json_extract(props, '$.k')::BIGINT"
RI = f"""{HEADLINES}, ri0 AS (SELECT *, k * 37 % 100 AS attention, k * 53 % 100 AS numbers, {_pick(EVENT_KINDS, "k")} AS type, regexp_replace({_pick(SOURCE_DOMAINS, "user_id")}, '^www[.]', '') AS domain,
  {_pick([*STATUS_ORDER, "expired"], "k")} AS triage, CASE id % 3 WHEN 0 THEN '{MODEL}' WHEN 1 THEN 'model/v4' END AS model, CASE WHEN id % 4 <> 0 THEN round(score) END AS ai_score, CASE WHEN id % 6 <> 0 THEN k * 29 % 100 END AS priority,
  CASE WHEN id % 5 <> 0 THEN {_pick(["overvak", "ignorer", "krediter"], "id")} END AS next_step, CASE WHEN k % 5 = 0 THEN published + INTERVAL 1 DAY END AS retry_after, user_id % 50 AS run, max(published) OVER () AS as_of FROM h),
  ri AS (SELECT *, CASE WHEN id % 9 <> 0 THEN (user_id % 200) || '|' || type || '|' || strftime(published, '%Y-%m-%d') END AS event_key FROM ri0)"""
UNSCORED = f"triage = 'candidate' AND (ai_score IS NULL OR model IS DISTINCT FROM '{MODEL}')"
STATES = f"""CASE WHEN triage = 'candidate' AND model IS NOT DISTINCT FROM '{MODEL}' THEN 0 WHEN triage = 'candidate' THEN 1 WHEN triage = 'duplicate' THEN 2 WHEN triage = 'overflow' THEN 3 WHEN triage = 'noise' THEN 4 ELSE 5 END"""
COVERED = "id IN (SELECT id FROM articles WHERE status IN ('draft', 'live'))"
_maps = lambda r, w, v: f"array_to_string(list_sort(list_filter([CASE WHEN {r} > 0 THEN 'research=' || ({r}) END, CASE WHEN {w} > 0 THEN 'write=' || ({w}) END, CASE WHEN {v} > 0 THEN 'verify=' || ({v}) END], lambda x: x IS NOT NULL)), ',')"


def _round(live: bool) -> str:
    """A round a day: items in order in their body, of indexes the first 60, of feeds those young enough, then the first 80 relevant ones."""
    given = [(n, k, 2 if live else h or AGE_HOURS) for n, _, k, h in FEEDS if not live or re.search(LIVE_FEEDS, n)] + [(n, "news-index", 10**6) for n, _, _ in INDEX_QUERIES if not live or re.search(LIVE_QUERIES, n)]
    names = _list([x[0] for x in (*FEEDS, *INDEX_QUERIES)])
    rows = ", ".join(f"('{n}', '{k}', {h})" for n, k, h in given)
    return f"""WITH {RADAR}, s(name, kind, hours) AS (VALUES {rows}), i AS (SELECT r.* EXCLUDE (name, kind), {names}[user_id % {len(FEEDS) + len(INDEX_QUERIES)} + 1] AS name, event_type, published::DATE AS day FROM r JOIN events ON event_id = id),
  w AS (SELECT i.*, s.kind, row_number() OVER (PARTITION BY name, day ORDER BY published DESC, id DESC) AS n, hours FROM i JOIN s USING (name)),
  x AS (SELECT *, {_hits(V.STRONG)} AS strong, {_hits(V.COMPANY)} AS company, {_hits(V.ATTENTION)} AS alert, {_hits(V.BROAD)} AS broad, {_hits(V.NOISE)} AS noise FROM w WHERE CASE WHEN kind = 'news-index' THEN n <= 60 ELSE epoch(day + 1) - floor(epoch(published)) <= hours * 3600 END),
  y AS (SELECT *, CASE WHEN {_hit("E24 – Aksjetips", "name")} OR company >= 1 AND (strong >= 1 OR alert >= 1) OR strong >= 2 OR strong >= 1 AND (noise = 0 OR broad >= 1) THEN true WHEN {_hit("GDELT|Google News", "name")} THEN (strong >= 1 OR broad >= 1 OR company >= 1 AND alert >= 1) AND noise = 0
  WHEN {_hit("CNBC|Yahoo Finance|Financial Times|WSJ|Economist", "name")} THEN (strong >= 1 OR company >= 1 OR alert >= 1 OR broad >= 2) AND noise = 0 WHEN {_hit("Federal Reserve|ECB", "name")} THEN strong >= 1 OR broad >= 1
  WHEN {_hit("E24 – Børs og finans|E24 – Makro og politikk|Dagens Næringsliv", "name")} THEN broad >= 2 AND noise = 0 ELSE false END AS relevant FROM x),
  z AS (SELECT *, row_number() OVER (PARTITION BY name, day ORDER BY n) AS place FROM y WHERE relevant AND name NOT LIKE 'ECB%'),
  c AS (SELECT name, count(*) AS seen, count(*) FILTER (event_type <> 'view') AS inserted FROM z WHERE place <= 80 GROUP BY name)
  SELECT DISTINCT w.name, w.kind, coalesce(seen, 0) AS seen, coalesce(inserted, 0) AS inserted, CASE WHEN w.name LIKE 'ECB%' THEN 'empty' END AS error FROM w LEFT JOIN c USING (name)"""


SQL = {
    "insert_composite": "SELECT l_suppkey, l_orderkey, min(l_linenumber) AS line, count(*) AS asked FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem o WHERE o.l_returnflag = 'R' AND o.l_suppkey = l.l_suppkey AND o.l_orderkey = l.l_orderkey) GROUP BY ALL",
    "slot_jobs": """WITH r AS (SELECT event_type AS kind, date_trunc('hour', ts)::TIMESTAMP AS slot, props, event_id, ts, max(ts) OVER () AS as_of FROM events), o AS (SELECT kind, slot, 'old ' || min(event_id) AS payload FROM r WHERE ts < as_of - INTERVAL 1 DAY GROUP BY ALL),
  n AS (SELECT kind, slot, arg_min(props, event_id) AS payload FROM r WHERE ts >= as_of - INTERVAL 2 DAY GROUP BY ALL) SELECT n.kind, n.slot, coalesce(o.payload, n.payload) AS payload, o.payload IS NULL AS created FROM n LEFT JOIN o USING (kind, slot)""",
    "bulk_update": """WITH c AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
  SELECT o_orderkey AS id, CASE WHEN n IS NULL THEN o_orderstatus ELSE 'R' || n END AS status, CASE WHEN n IS NULL THEN o_orderpriority ELSE 'reset' END AS priority FROM orders LEFT JOIN c ON l_orderkey = o_orderkey""",
    "guarded_update": f"WITH {ARTICLES} SELECT status, count(*) FILTER (status = 'draft') AS approve, count(*) FILTER (status = 'draft' AND score IS NULL) AS reject, count(*) AS archive, count(*) FILTER (status = 'live' AND NOT pinned) AS pin, count(*) FILTER (status = 'live' AND pinned) AS unpin FROM articles GROUP BY status",
    "pin_change": f"""WITH {ARTICLES}, l AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY coalesce(score, -1) DESC, id DESC) = 1 AS best, pinned AND id % 2 <> 0 AS keep FROM articles WHERE status = 'live')
  SELECT id, best OR keep AS pinned, CASE WHEN best THEN 1 WHEN keep THEN pin_place END AS place, CASE WHEN best OR keep THEN 'manual' END AS pinned_by FROM l""",
    "feed_expiry": f"""WITH {FEED}, x AS (SELECT *, id % 5 <> 0 AS live, CASE WHEN id % 11 = 0 THEN NULL WHEN id % 7 = 0 THEN ts - INTERVAL 1 DAY ELSE ts END AS p, as_of - INTERVAL 2 HOUR AS edge FROM feed),
  y AS (SELECT *, CASE WHEN NOT live THEN NULL WHEN p IS NULL OR p < edge THEN 'item' WHEN ts < edge THEN 'time' END AS w FROM x), z AS (SELECT *, row_number() OVER (PARTITION BY live AND w IS NULL ORDER BY ts DESC, priority DESC NULLS LAST, id DESC) AS n FROM y)
  SELECT id, CASE WHEN coalesce(w, CASE WHEN live AND n > 12 THEN 'rank' END) IS NOT NULL THEN 'expired' WHEN live THEN 'live' ELSE 'draft' END AS status, coalesce(w, CASE WHEN live AND n > 12 THEN 'rank' END) AS why FROM z""",
    "prune_candidates": f"""WITH {HEADLINES}, x AS (SELECT id, title || ' ' AS text FROM h WHERE k % 3 <> 0 OR score IS NULL ORDER BY published DESC, id DESC LIMIT 500),
  y AS (SELECT id, text, {_hits(V.STRONG)} AS strong, {_hits(V.COMPANY)} AS company, {_hits(V.ATTENTION)} AS alert, {_hits(V.BROAD)} AS broad, {_hits(V.NOISE)} AS noise FROM x)
  SELECT id FROM y WHERE NOT (company >= 1 AND (strong >= 1 OR alert >= 1) OR strong >= 2 OR strong >= 1 AND (noise = 0 OR broad >= 1)) AND id NOT IN (SELECT doc_id FROM labels)""",
    "attempt_maps": f"""WITH x AS (SELECT event_id AS id, {K} % 3 AS r, {K} % 4 AS w, event_id % 3 AS s FROM events)
  SELECT id, {_maps("r + CASE WHEN s = 0 THEN 1 ELSE 0 END", "w + CASE WHEN s = 1 THEN 1 ELSE 0 END", "CASE WHEN s = 2 THEN 1 ELSE 0 END")} AS claimed, {_maps("r", "0", "0")} AS written FROM x""",
    "failed_log": f"""SELECT event_id AS case_id, {K} % 7 AS revision, 'failed' AS status, ts + INTERVAL 2 MINUTE AS retry_after, '{{"error":"error of ' || event_id || '"}}' AS details FROM events WHERE event_type = 'error' AND {K} % 4 <> 0""",
    "revision_log": """WITH o AS (SELECT user_id AS event, CASE WHEN event_type = 'purchase' THEN 'enriched' ELSE 'flash' END AS stage, md5(props) AS hash, min(event_id) AS revision FROM events GROUP BY ALL)
  SELECT *, revision = max(revision) OVER (PARTITION BY event) AS latest FROM o""",
    "register_cases": """WITH e AS (SELECT event_id AS item, user_id % 5 AS run, user_id || '|' || event_type AS key, o_custkey % 5 AS own FROM events LEFT JOIN orders ON o_orderkey = event_id)
  SELECT item, CASE WHEN own <> run THEN 'CASE_RUN_MISMATCH' WHEN own IS NOT NULL THEN 'existing' WHEN key IN (SELECT key FROM e WHERE own IS NOT NULL) OR item <> min(item) FILTER (own IS NULL) OVER (PARTITION BY key) THEN 'EVENT_ALREADY_ASSIGNED' ELSE 'created' END AS state FROM e""",
    "usage_log": f"""WITH x AS (SELECT ts::DATE AS day, event_type AS step, (row_number() OVER (PARTITION BY ts::DATE, event_type ORDER BY ts, event_id) - 1) // 15 AS batch, {K} AS k FROM events)
  SELECT day, step, batch, count(*) AS requested, sum(k * 10)::BIGINT AS tokens_in, sum(k)::BIGINT AS tokens_out, round((sum(k * 10) * 0.66::DOUBLE + sum(k) * 1.98::DOUBLE) / 1e6, 8) AS cost FROM x GROUP BY ALL HAVING sum(k) > 0""",
    "edited_drafts": f"""WITH x AS (SELECT doc_id AS id, {_pick(["Renter", "Sport", "Analyse", ""], "doc_id")} AS s, CASE WHEN doc_id % 9 <> 0 THEN substring(trim(text), 1, 220) ELSE '' END AS t, substring(trim(text), 1, 30000) AS b FROM documents)
  SELECT id, CASE WHEN list_contains({_list(EDIT_SECTIONS)}, s) THEN s ELSE 'Markeder' END AS section, sha256(t) AS title_sha256, length(b) AS body_chars, 'Desk' AS author, CASE WHEN id % 4 = 0 THEN 'https://x.no/a.png' END AS image_url,
  CASE WHEN t = '' THEN 'no title' WHEN b = '' THEN 'no body' END AS reject FROM x""",
    "live_freshness": """WITH x AS (SELECT event_id AS i, event_id % 13 <> 0 AND event_id % 200 - 30 BETWEEN -15 AND 120 AS recent, event_id % 3 <> 0 AS found, event_id % 4 <> 0 AS checked, event_id % 6 <> 0 AND event_id % 5 <> 0 AND event_id % 150 <= 120 AS fine FROM events)
  SELECT i AS id, CASE WHEN NOT recent THEN false WHEN NOT found THEN true WHEN checked THEN fine END AS fresh, recent AND found AND NOT checked AS to_check FROM x""",
    "stale_live": """SELECT event_id AS item, ts, ['rss', 'fast-news-aggregator', 'news-index'][event_id % 3 + 1] AS kind FROM events WHERE event_id % 3 <> 0 AND event_id % 5 <> 0 ORDER BY ts DESC, event_id DESC LIMIT 12""",
    "decision_urls": "SELECT event_id AS id, event_id % 4 = 0 AND (event_id // 4) % 4 IN (0, 3) AND year(ts) >= 2000 AS decision FROM events",
    "draft_list": f"WITH {ARTICLES} SELECT id, score, published, c_name AS source FROM (SELECT * FROM articles WHERE status = 'draft' ORDER BY score DESC NULLS LAST, published DESC, id DESC LIMIT 50) LEFT JOIN customer ON c_custkey = source_id",
    "published_list": f"WITH {ARTICLES} SELECT id, published, pinned FROM articles WHERE status = 'live' ORDER BY published DESC NULLS LAST, id DESC LIMIT 50",
    "feed_list": f"WITH {FEED} SELECT id, ts, section, priority FROM feed ORDER BY ts DESC, id DESC LIMIT 50",
    "live_order": f"WITH {ARTICLES} SELECT id, pinned, pin_place, score FROM articles WHERE status = 'live' ORDER BY pinned DESC, pin_place ASC NULLS LAST, score DESC NULLS LAST, published DESC NULLS LAST, id DESC LIMIT 20",
    "raw_list": "SELECT o_orderkey AS id, o_orderdate AS published, c_name AS source FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 30) LEFT JOIN customer ON c_custkey = o_custkey",
    "radar_list": f"""WITH {RI}, {ARTICLES}, t AS (SELECT id, {STATES} AS place, triage, ai_score, priority FROM ri ORDER BY place, ai_score DESC NULLS LAST, priority DESC NULLS LAST, attention DESC NULLS LAST, numbers DESC NULLS LAST, published DESC NULLS LAST, id DESC LIMIT 160)
  SELECT t.*, quality = 1 AS can_write, {COVERED} AS covered FROM t LEFT JOIN labels ON doc_id = id""",
    "case_list": f"""WITH {ARTICLES}, x AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 50) SELECT x.event_id AS id, ts, event_type AS title, 'b' || x.event_id AS reason, '2024' AS at, NULL::VARCHAR AS selection, a.status AS article_status FROM x LEFT JOIN articles a ON a.id = x.event_id""",
    "article_board": f"WITH {FEED}, l AS (SELECT user_id AS symbol, arg_max(priority, (ts, id)) AS value FROM feed GROUP BY 1) SELECT symbol, value, coalesce(list_position({BOARD}, symbol), 99)::BIGINT AS place FROM l ORDER BY place, symbol LIMIT 18",
    "scoring_queue": f"WITH {RI}, t AS (SELECT id, priority, published FROM ri WHERE {UNSCORED} AND (retry_after IS NULL OR retry_after <= as_of) ORDER BY priority DESC NULLS LAST, published DESC NULLS LAST, id DESC LIMIT 40) SELECT *, (row_number() OVER (ORDER BY priority DESC NULLS LAST, published DESC NULLS LAST, id DESC) - 1) // 15 AS batch FROM t",
    "scoring_state": f"""WITH {RI}, c AS (SELECT run, max(published) FILTER (k % 2 = 0) AS cutoff FROM ri GROUP BY run)
  SELECT run, count(*) FILTER (retry_after IS NULL OR retry_after <= cutoff) AS ready, count(*) FILTER (retry_after > cutoff) AS deferred FROM ri JOIN c USING (run) WHERE {UNSCORED} AND (cutoff IS NULL OR published <= cutoff) GROUP BY run""",
    "raw_queue": "SELECT o_orderkey AS id, c_name AS source FROM (SELECT * FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 30) LEFT JOIN customer ON c_custkey = o_custkey",
    "latest_runs": f"""WITH x AS (SELECT *, {K} % 4 AS s FROM events) SELECT event_type AS kind, max(ts) FILTER (s = 2) AS last_success, max(ts) FILTER (s = 3) AS error_at, arg_max(event_id, (ts, event_id)) FILTER (s = 3) AS error_id FROM x GROUP BY 1""",
    "auto_highlight": f"""WITH {RI}, {ARTICLES}, x AS (SELECT a.id, r.run, coalesce(a.score, -1) AS s, a.published AS p, a.pinned AND a.id % 3 = 0 AS manual, nullif(r.k % 6, 5) AS rank, r.attention AS sel FROM articles a JOIN ri r ON r.id = a.id WHERE a.status = 'live'),
  y AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY rank ASC NULLS LAST, sel DESC, s DESC, p DESC, id DESC) AS n, bool_or(manual) OVER (PARTITION BY run) AS locked FROM x)
  SELECT run, CASE WHEN NOT locked THEN id END AS id, CASE WHEN locked THEN 'manual_highlight_locked' ELSE 'auto_highlight' END AS reason FROM y WHERE n = 1""",
    "sitemap_xml": f"""WITH {ARTICLES}, x AS (SELECT * FROM articles WHERE status IN ('live', 'archived')), m AS (SELECT *, max(published) OVER () AS last, row_number() OVER (ORDER BY published DESC, id DESC) AS n FROM x)
  SELECT id, '<url><loc>https://www.example.com/a?id=' || id || '&amp;x=&apos;1&apos;</loc><lastmod>' || strftime(published, '%Y-%m-%d') || '</lastmod></url>' AS xml, published >= last - INTERVAL 2 DAY AND n <= 1000 AS news FROM m WHERE n <= 5000""",
    "live_json": f"""WITH {FEED} SELECT id, '{{"id":' || id || ',"headline":"' || section || '","at":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '","article":null}}' AS json FROM feed ORDER BY ts DESC, priority DESC NULLS LAST, id DESC LIMIT 12""",
    "radar_packs": f"WITH {RI}, {ARTICLES} SELECT id, triage, CASE WHEN doc_id IS NULL THEN NULL WHEN quality = 1 THEN 'ready' ELSE 'needs_source' END AS pack, {COVERED} AS covered FROM ri LEFT JOIN labels ON doc_id = id",
    "not_top_twelve": f"WITH {FEED}, x AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY ts DESC, priority DESC NULLS LAST, id DESC) AS n FROM feed) SELECT section, count(*) AS n, max(id) AS last_id FROM x WHERE n > 12 GROUP BY section",
    "linked_updates": f"WITH {FEED}, {ARTICLES} SELECT f.id, a.id AS article_id, coalesce(a.published, ts) AS at FROM feed f LEFT JOIN articles a ON a.id = f.id AND a.status = 'live'",
    "live_candidates_full": f"""WITH {RI} SELECT id, ai_score, published, floor((floor(epoch(as_of)) - floor(epoch(published))) / 60)::BIGINT AS age_minutes FROM ri WHERE triage = 'candidate' AND ai_score >= 60 AND coalesce(next_step, 'overvak') <> 'ignorer' AND published >= as_of - INTERVAL 20 DAY
  AND (list_contains({_list(LIVE_TYPES)}, type) OR attention >= 45 OR ai_score >= 70) AND NOT EXISTS (SELECT 1 FROM ri s WHERE s.triage = 'duplicate' AND (s.id = ri.id OR s.event_key = ri.event_key AND s.published >= s.as_of - INTERVAL 20 DAY))""",
    "selection_candidates": f"""WITH {RI}, {ARTICLES}, made AS (SELECT id FROM articles), cs AS (SELECT id, event_key, run FROM ri WHERE k % 17 = 3),
  recent AS (SELECT event_key FROM ri WHERE k % 7 = 5 AND published >= as_of - INTERVAL 6 HOUR AND (id IN (SELECT id FROM made) OR id IN (SELECT doc_id FROM labels WHERE quality = 1)))
  SELECT id, run, event_key, ai_score, id IN (SELECT id FROM made) OR coalesce(event_key IN (SELECT event_key FROM ri WHERE event_key IS NOT NULL AND id IN (SELECT id FROM made)), false) AS has_article,
  coalesce(event_key IN (SELECT event_key FROM ri WHERE event_key IS NOT NULL AND list_contains({_list(V.SELECTION_DOMAINS)}, domain)), false) AS has_trusted_source
  FROM ri WHERE triage = 'candidate' AND model = '{MODEL}' AND ai_score >= 60 AND published >= as_of - INTERVAL 20 DAY AND NOT EXISTS (SELECT 1 FROM cs WHERE (cs.id = ri.id OR cs.event_key = ri.event_key) AND cs.run IS DISTINCT FROM ri.run)
  AND NOT EXISTS (SELECT 1 FROM recent WHERE recent.event_key = ri.event_key)""",
    "source_stats": _round(False),
    "live_sources": _round(True),
}
