"""DuckDB SQL for each query of the catalog, over the tables as given."""

from __future__ import annotations

from ..functions import vocabulary as V
from ..functions.scoring import SPACE
from ..functions.unicode import BASE, MARKED
from ..operators.gates import NEXT_STEPS, SECTIONS, TYPES
from ..operators.texts import STOP
from ..operators.triage import STATES, STEPS
from ..sources.tables import COMPANIES, EVENT_KINDS, SOURCE_DOMAINS, SOURCE_KINDS, SOURCE_NAMES, TEMPLATES

_list = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
FEED = "feed AS (SELECT event_id AS id, ts, value AS priority, event_type AS section, event_id AS article_id, user_id || '|' || event_type AS event_key, user_id, max(ts) OVER () AS as_of FROM events)"
ARTICLES = """articles AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'live' WHEN 'O' THEN 'draft' ELSE 'archived' END AS status,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 101 END AS score, o_orderdate AS published, starts_with(o_orderpriority, '1') AS pinned, o_orderkey % 20 AS pin_place, o_custkey AS source_id, max(o_orderdate) OVER () AS as_of FROM orders)"""
HEADLINES = f"""h AS (SELECT event_id AS id, replace({_list(TEMPLATES)}[json_extract(props, '$.k')::BIGINT % {len(TEMPLATES)} + 1], '{{company}}', {_list(COMPANIES)}[user_id % {len(COMPANIES)} + 1]) AS title,
  ts AS published, event_type AS source_kind, value AS score, user_id, json_extract(props, '$.k')::BIGINT AS k FROM events)"""
PLAIN = f"trim(regexp_replace(translate(lower(title), '{MARKED}', '{BASE}'), '[^a-z0-9æøå]+', ' ', 'g'))"
TOKENS = f"list_filter(string_split({PLAIN}, ' '), lambda x: length(x) >= 3 AND NOT list_contains({_list(STOP)}, x))"
DISTINCT = f"list_filter({TOKENS}, lambda x, i: list_position({TOKENS}, x) = i)"
_pick = lambda xs, n: f"{_list(xs)}[{n} % {len(xs)} + 1]"
RADAR = f"""{HEADLINES}, r AS (SELECT id, title || ' ' AS text, published, score, k * 37 % 100 AS attention, k * 53 % 100 AS numbers, {_pick(SOURCE_NAMES, "user_id")} AS name, {_pick(SOURCE_KINDS, "user_id")} AS kind,
  regexp_replace({_pick(SOURCE_DOMAINS, "user_id")}, '^www[.]', '') AS domain, {_pick(EVENT_KINDS, "k")} AS type, (epoch(max(published) OVER ()) - epoch(published)) / 3600 AS age FROM h)"""


def _hit(pattern: str, text: str = "text") -> str:
    quoted = pattern.replace(r"\s", SPACE).replace("'", "''")
    return f"regexp_matches({text}, '(?i){quoted}')"


def _hits(patterns: list[str]) -> str:
    return "(" + " + ".join(f"{_hit(p)}::INT" for p in patterns) + ")"


TRIAGE_COUNTS = ", ".join(f"{_hits(getattr(V, f'TRIAGE_{x}'))} AS {y}" for x, y in (
    ("CORPORATE_FINANCE", "corporate"), ("MARKET_MACRO", "macro"), ("MAJOR_COMPANY", "company"), ("MAJOR_FIGURE", "figure"), ("BASIC_FINANCE", "basic"), ("MARKET_MOVE", "move"), ("ATTENTION", "alert"), ("NOISE", "noise"),
))
AUDIENCE = f"""a AS (SELECT *, {_hit(V.AUDIENCE_NORWEGIAN)} AS norwegian, {_hit(V.AUDIENCE_GLOBAL)} AS global, {_hit(V.AUDIENCE_EVENT)} OR list_contains({_list(V.CONCRETE_TYPES)}, type) AS concrete, {_hit(V.AUDIENCE_NOISE)} AS advert FROM r),
  b AS (SELECT *, NOT advert AND concrete AND (norwegian OR global) AS eligible FROM a), c AS (SELECT *, CASE WHEN NOT eligible THEN 0 WHEN norwegian THEN 90 ELSE 70 END AS audience_score FROM b)"""
TITLE = "regexp_extract(html, '(?is)<title>(.*?)</title>', 1)"
DOMAIN = "regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)), '^www\\.', '')"


def _plain_html(x: str) -> str:
    x = rf"regexp_replace({x}, '(?is)<(?:script|style|noscript)[^>]*>.*?</(?:script|style|noscript)>|<!--.*?-->', ' ', 'g')"
    x = f"regexp_replace({x}, '(?s)<[^>]*>', ' ', 'g')"
    for name, mark in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{mark}')"
    return rf"trim(regexp_replace({x}, '[ \t\n\r\f]+', ' ', 'g'))"


def _escaped(x: str) -> str:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&apos;")):
        x = f"replace({x}, '{mark}', '{name}')"
    return x


CLEAN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])(?:(?i)utm_[a-z]+|fbclid|gclid|cmpid|ref|source)=[^&]*', '\1', 'g'), '[&]+', '&', 'g'), '[?]&', '?', 'g'), '[?&]+$', '')"

EVENT_PLAIN = f"translate(lower(title), '{MARKED}', '{BASE}')"
for _pattern, _word in V.EVENT_SYNONYMS:
    EVENT_PLAIN = f"regexp_replace({EVENT_PLAIN}, '{_pattern}', '{_word}', 'g')"
EVENT_WORDS = f"list_filter(string_split(trim(regexp_replace({EVENT_PLAIN}, '[^a-z0-9æøå]+', ' ', 'g')), ' '), lambda x: length(x) >= 3 AND NOT list_contains({_list(V.EVENT_STOP)}, x))"
_squeezed = lambda text: f"trim(regexp_replace(coalesce({text}, ''), '{SPACE}+', ' ', 'g'))"
_when = lambda holds, name: f"CASE WHEN {holds} THEN '{name}' END"
_dated = lambda unknown: f"CASE WHEN {unknown} THEN 'original_date_unverified' WHEN i % 23 = 0 THEN 'original_date_in_future' WHEN i % 40 > 36 THEN 'event_expired' END"
_proof = lambda n, elsewhere: _when(f"i % 17 = 0 OR {elsewhere} OR length(q{n}) < 12 OR NOT contains(t, q{n})", f"evidence_missing:{n}") + ", " + _when(f"i % 17 = 0 OR {elsewhere} OR i % 4 = 2", f"source_untrusted:{n}")
SQL = {
    "live_feed_top12": f"WITH {FEED}, {ARTICLES} SELECT f.id, ts, priority, section, article_id, a.score AS article_score FROM feed f LEFT JOIN articles a ON a.id = f.article_id AND a.status = 'live' WHERE ts >= f.as_of - INTERVAL 2 HOUR ORDER BY ts DESC, priority DESC NULLS LAST, f.id DESC LIMIT 12",
    "front_page_rank": f"""WITH {ARTICLES}, p AS (SELECT *, pinned AND id % 3 <> 0 AS by_hand FROM articles) SELECT id, published, published + INTERVAL 2 HOUR > as_of AS breaking, by_hand AS pinned, CASE WHEN by_hand THEN pin_place END AS place,
  round(coalesce(score, 50) - 2 * least(100.0::DOUBLE, (epoch(as_of) - epoch(published)) / 3600), 6) AS rank_score FROM p WHERE status = 'live'
  ORDER BY breaking DESC, by_hand DESC, place ASC NULLS LAST, rank_score DESC, published DESC NULLS LAST, id DESC LIMIT 12""",
    "related_top3": f"""WITH {ARTICLES}, l AS (SELECT * FROM articles WHERE status = 'live'), t AS (SELECT * FROM l ORDER BY score DESC NULLS LAST, published DESC, id DESC LIMIT 4),
  x AS (SELECT l.id, t.id AS other, row_number() OVER (PARTITION BY l.id ORDER BY t.score DESC NULLS LAST, t.published DESC, t.id DESC) - 1 AS place FROM l JOIN t ON t.id <> l.id) SELECT id, place, other FROM x WHERE place < 3""",
    "breaking_story": f"WITH {ARTICLES} SELECT id, published FROM articles WHERE status = 'live' AND published + INTERVAL 48 HOUR > as_of ORDER BY published DESC, id DESC LIMIT 1",
    "market_board_rank": f"WITH {FEED}, l AS (SELECT user_id AS symbol, ts AS updated, priority AS value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) AS k FROM feed) SELECT symbol, updated, value, coalesce(list_position([7, 3, 11, 42], symbol), 99)::BIGINT AS place FROM l WHERE k = 1 ORDER BY place, symbol LIMIT 18",
    "usage_by_step_model": "WITH x AS (SELECT *, max(l_shipdate) OVER () AS as_of FROM lineitem) SELECT l_returnflag AS step, l_linestatus AS model, sum(l_quantity::BIGINT)::BIGINT AS tokens, round(sum(l_extendedprice * l_discount), 2) AS cost, count(*) AS calls FROM x WHERE l_shipdate >= date_trunc('day', as_of) - INTERVAL 365 DAY GROUP BY ALL",
    "job_status_counts": "SELECT event_type AS kind, ['pending', 'running', 'done', 'failed'][json_extract(props, '$.k')::BIGINT % 4 + 1] AS status, count(*) AS n FROM events GROUP BY ALL",
    "health_counts": f"WITH {ARTICLES} SELECT (SELECT count(*) FROM articles WHERE status = 'live') AS live_articles, (SELECT count(*) FROM events) AS feed_rows, (SELECT count(*) FROM customer) AS sources",
    "run_progress_counts": """SELECT c_custkey AS run, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS items, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS published,
  (SELECT count(DISTINCT l_partkey) FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey) AS parts FROM customer""",
    "funnel_counts": f"WITH {FEED} SELECT section, count(*) AS seen, count(*) FILTER (priority IS NULL) AS waiting, count(*) FILTER (priority >= 70) AS strong, count(*) FILTER (priority >= 60 AND priority < 70) AS fair, count(DISTINCT user_id) AS users FROM feed GROUP BY section",
    "source_list": f"WITH {ARTICLES} SELECT id, published, c_name AS source FROM (SELECT * FROM articles WHERE status = 'draft' ORDER BY published DESC, id DESC LIMIT 30) LEFT JOIN customer ON c_custkey = source_id",
    "draft_detail": f"WITH {ARTICLES} SELECT id, status, c_name AS source, n_name AS place FROM articles LEFT JOIN customer ON c_custkey = source_id LEFT JOIN nation ON n_nationkey = c_nationkey WHERE status = 'draft'",
    "pulse_slots": f"WITH {FEED} SELECT time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '2000-01-01') AS slot, count(*) AS n, min(id) AS first_id FROM feed GROUP BY 1",
    "feed_trim": f"WITH {FEED} SELECT id, CASE WHEN row_number() OVER (ORDER BY ts DESC, priority DESC NULLS LAST, id DESC) <= 12 THEN 'live' ELSE 'expired' END AS status FROM feed WHERE ts >= as_of - INTERVAL 24 HOUR",
    "value_change_points": f"WITH {FEED}, x AS (SELECT user_id AS symbol, id, ts, priority, lag(priority) OVER (PARTITION BY user_id ORDER BY ts, id) AS before FROM feed) SELECT symbol, id, ts, round(CASE WHEN before = 0 THEN 0.0 ELSE (priority / before - 1) * 100 END, 4) AS change_pct FROM x WHERE before IS NULL OR priority <> before",
    "cost_tariff": f"""WITH {FEED}, x AS (SELECT dayofweek(ts) BETWEEN 1 AND 5 AND (hour(ts) BETWEEN 1 AND 3 OR hour(ts) BETWEEN 6 AND 9) AS peak, id % 5000 AS tokens FROM feed)
  SELECT peak, count(*) AS calls, sum(tokens)::BIGINT AS tokens, round(sum(round(tokens * CASE WHEN peak THEN 1.32::DOUBLE ELSE 0.66::DOUBLE END / 1e6, 8)), 6) AS cost FROM x GROUP BY peak""",
    "retry_queue": """WITH j AS (SELECT event_id, event_type, ts, max(ts) OVER () AS as_of, json_extract(props, '$.k')::BIGINT % 6 AS attempts, json_extract(props, '$.k')::BIGINT % 3 AS state FROM events),
  r AS (SELECT event_id, event_type, attempts, least(300, 30 * attempts) AS wait_s, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS place FROM j WHERE attempts < 5 AND state < 2 AND (state = 0 OR epoch(ts) + least(300, 30 * attempts) <= epoch(as_of)))
  SELECT * FROM r WHERE place <= 3""",
    "live_candidates": f"""WITH {HEADLINES}, s AS (SELECT id, user_id % 50 AS key, published AS shown FROM h WHERE source_kind = 'error') SELECT id, title, published FROM h WHERE score >= 55 AND source_kind <> 'error' AND id - 1 NOT IN (SELECT id FROM s)
  AND NOT EXISTS (SELECT 1 FROM s WHERE s.key = h.user_id % 50 AND s.shown <= h.published AND s.shown > h.published - INTERVAL 8 HOUR)""",
    "insert_if_new": f"WITH {FEED} SELECT event_key, arg_min(id, (ts, id)) AS id FROM feed WHERE event_key NOT IN (SELECT event_key FROM feed WHERE section = 'signup') GROUP BY event_key",
    "upsert_latest": f"WITH {FEED} SELECT event_key, id, priority, ts, writes FROM (SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY ts DESC, id DESC) AS k, count(*) OVER (PARTITION BY event_key) AS writes FROM feed) WHERE k = 1",
    "review_blocks": """WITH x AS (SELECT u.conv_id, u.turn, (SELECT count(*) FROM conversations a WHERE a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant') AS n FROM conversations u WHERE u.role = 'user')
  SELECT conv_id, count(*) AS blocks, count(*) FILTER (n = 1) AS supported, bool_and(n = 1) AS passed FROM x GROUP BY conv_id""",
    "normalised_titles": f"WITH {HEADLINES} SELECT id, {PLAIN} AS plain, substr(regexp_replace(regexp_replace(replace(replace(translate(lower(title), '{MARKED}', '{BASE}'), 'æ', 'ae'), 'ø', 'o'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80) AS slug, array_to_string(list_sort(list_distinct({TOKENS})), ' ') AS tokens FROM h",
    "title_similarity_pairs": f"""WITH {HEADLINES}, t AS (SELECT DISTINCT title, list_distinct({TOKENS}) AS t FROM h),
  p AS (SELECT a.title, b.title AS other, len(list_intersect(a.t, b.t)) AS k, len(a.t) AS m, len(b.t) AS n FROM t a JOIN t b ON a.title < b.title WHERE len(list_intersect(a.t, b.t)) > 0)
  SELECT * FROM (SELECT title, other, round(greatest(k::DOUBLE / least(m, n), 1.35::DOUBLE * k / (m + n - k)), 6) AS similarity FROM p) WHERE similarity >= 0.52""",
    "event_keys": f"WITH {HEADLINES} SELECT substr(sha1(strftime(published, '%Y-%m-%d') || '|' || array_to_string(({DISTINCT})[1:10], '-')), 1, 20) AS event_key, count(*) AS n, min(id) AS first_id, count(DISTINCT user_id) AS users FROM h GROUP BY 1",
    "clean_urls": f"SELECT page_id, {CLEAN} AS clean, {DOMAIN} AS domain, substr(sha256({CLEAN} || '|' || {TITLE}), 1, 48) AS external_id FROM pages",
    "page_texts": f"""SELECT page_id, {_plain_html(TITLE)} AS title, {_escaped(_plain_html(TITLE))} AS title_xml, sha256({_plain_html('html')}) AS text_sha256,
  len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS links, len(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) AS different_links FROM pages""",
    "domain_counts": f"SELECT {DOMAIN} AS domain, count(*) AS pages, count(*) FILTER (starts_with(url, 'https://')) AS secure FROM pages GROUP BY 1",
    "word_counts": r"SELECT doc_id, len(regexp_extract_all(text, '[^ \t\n\r\f]+')) AS words, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS paragraphs, len(regexp_extract_all(text, '\d+(?:[,.]\d+)?')) AS numbers FROM documents",
    "quote_evidence": r"""WITH b AS (SELECT item_id, trim(regexp_extract(text, '^([^.]{12,}\.)', 1)) AS quote FROM benchmark) SELECT item_id, (SELECT count(*) FROM documents WHERE contains(text, quote)) AS documents FROM b WHERE quote <> ''""",
    "source_quality": "SELECT source, count(*) AS documents, count(quality) AS labelled, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic, sum(n_chars)::BIGINT AS chars FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source",
    "exact_copies": "SELECT sha256(text) AS text_sha256, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1",
    "relevance_filter": f"""WITH {RADAR}, x AS (SELECT id, name, text, {_hits(V.STRONG)} AS strong, {_hits(V.COMPANY)} AS company, {_hits(V.ATTENTION)} AS alert, {_hits(V.BROAD)} AS broad, {_hits(V.NOISE)} AS noise FROM r)
  SELECT id, CASE WHEN trim(text) = '' THEN false WHEN {_hit("E24 – Aksjetips", "name")} OR company >= 1 AND (strong >= 1 OR alert >= 1) OR strong >= 2 OR strong >= 1 AND (noise = 0 OR broad >= 1) THEN true
  WHEN {_hit("GDELT|Google News", "name")} THEN (strong >= 1 OR broad >= 1 OR company >= 1 AND alert >= 1) AND noise = 0
  WHEN {_hit("CNBC|Yahoo Finance|Financial Times|WSJ|Economist", "name")} THEN (strong >= 1 OR company >= 1 OR alert >= 1 OR broad >= 2) AND noise = 0
  WHEN {_hit("Federal Reserve|ECB", "name")} THEN strong >= 1 OR broad >= 1
  WHEN {_hit("E24 – Børs og finans|E24 – Makro og politikk|Dagens Næringsliv", "name")} THEN broad >= 2 AND noise = 0 ELSE false END AS relevant FROM x""",
    "audience_assess": f"""WITH {RADAR}, {AUDIENCE} SELECT id, eligible, norwegian, global, concrete, audience_score AS score, CASE WHEN advert THEN '{V.REASON_NOISE}' WHEN NOT concrete THEN '{V.REASON_VAGUE}'
  WHEN norwegian THEN '{V.REASON_NORWEGIAN}' WHEN global THEN '{V.REASON_GLOBAL}' ELSE '{V.REASON_REACH}' END AS reason FROM c""",
    "triage_priority": f"""WITH {RADAR}, x AS (SELECT id, text, name, age, {TRIAGE_COUNTS}, CASE WHEN contains(kind, 'official') THEN 22 WHEN list_contains({_list(V.TRUSTED_DOMAINS)}, domain) THEN 18
  WHEN kind = 'global-rss' THEN 14 WHEN kind = 'rss' THEN 11 WHEN kind = 'news-index' THEN 8 WHEN kind = 'news-aggregator' THEN 4 ELSE 6 END AS rank FROM r),
  y AS (SELECT *, greatest(0, least(100, floor(rank + greatest(0, 10 - greatest(0, age) * 0.5::DOUBLE) + (least(42, 24 * corporate) + least(36, 22 * macro) + CASE WHEN company > 0 THEN 24 ELSE 0 END + CASE WHEN figure > 0 THEN 20 ELSE 0 END
  + least(16, 8 * basic) + CASE WHEN move > 0 THEN 18 ELSE 0 END + least(14, 8 * alert) - least(70, 45 * noise)) + 0.5::DOUBLE)))::BIGINT AS priority, {_hit(V.FINANCE_DESK, "name")} AS desk FROM x),
  z AS (SELECT *, corporate > 0 OR macro > 0 OR move > 0 OR basic > 0 AND (desk OR rank >= 14) OR figure > 0 AND (desk OR alert > 0) OR company > 0 AND {_hit(V.MONEY_WORDS)} AS explicit_finance FROM y)
  SELECT id, rank, priority, explicit_finance, noise::BIGINT AS noise, NOT explicit_finance OR noise > 0 AND priority < 45 OR priority < 22 AS dropped FROM z""",
    "editorial_priority": f"""WITH {RADAR}, {AUDIENCE}, x AS (SELECT *, CASE WHEN contains(kind, 'official') THEN 6 WHEN list_contains({_list(V.SELECTION_DOMAINS)}, domain) THEN 5 WHEN kind = 'global-rss' THEN 4 WHEN kind = 'rss' THEN 3 WHEN kind = 'news-aggregator' THEN 1 ELSE 2 END AS rank FROM c)
  SELECT id, round(coalesce(score, 0) * 0.35::DOUBLE + attention * 0.15::DOUBLE + numbers * 0.10::DOUBLE + audience_score * 0.30::DOUBLE + greatest(0, 10 - age * 0.55::DOUBLE) + rank * 2.8::DOUBLE, 4) AS editorial_priority FROM x""",
    "queue_fold": f"""WITH e AS (SELECT *, json_extract(props, '$.k')::BIGINT AS k, max(ts) OVER () AS as_of FROM events), q AS (SELECT user_id AS desk, event_id AS id, {_pick(STATES, "k")} AS state, {_pick(STEPS, "event_id")} AS own, event_id % 2 = 0 AS waiting, k % 5 AS attempts,
  event_id % 3 = 0 AND epoch(ts) + k * 86400 > epoch(as_of) AS leased, event_id % 4 = 0 AND epoch(ts) + k * 86400 > epoch(as_of) AS later, event_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') AS made FROM e),
  s AS (SELECT *, CASE WHEN state IN ('selected', 'researching') THEN 'research' WHEN state IN ('ready', 'writing') THEN 'write' WHEN state = 'verifying' OR state = 'review' AND waiting THEN 'verify' WHEN state = 'failed' AND own <> 'other' THEN own END AS step FROM q),
  t AS (SELECT *, CASE WHEN state = 'blocked' THEN 'blocked' WHEN leased THEN 'busy' WHEN step IS NULL AND state = 'failed' THEN 'failed' WHEN step IS NULL THEN 'none' WHEN attempts >= 3 THEN 'failed' WHEN later THEN 'deferred_' || step ELSE step END AS kind FROM s),
  u AS (SELECT desk, count(*) FILTER (made) AS drafts, greatest(0, 3 - count(*) FILTER (made)) AS room, coalesce(list(id ORDER BY id) FILTER (kind = 'write'), []) AS ids, count(*) FILTER (kind = 'research') AS r, count(*) FILTER (kind = 'verify') AS verify,
  count(*) FILTER (kind = 'deferred_research') AS dr, count(*) FILTER (kind = 'deferred_write') AS dw, count(*) FILTER (kind = 'deferred_verify') AS deferred_verify, count(*) FILTER (kind = 'busy') AS busy, count(*) FILTER (kind = 'blocked') AS blocked, count(*) FILTER (kind = 'failed') AS failed FROM t GROUP BY desk)
  SELECT desk, drafts, CASE WHEN room > 0 THEN r ELSE 0 END AS research, least(room, len(ids)) AS write, verify, CASE WHEN room > 0 THEN dr ELSE 0 END AS deferred_research, CASE WHEN room > 0 THEN dw ELSE 0 END AS deferred_write, deferred_verify, busy, blocked, failed, array_to_string(ids[1:room], ',') AS ids FROM u""",
    "research_gate": f"""WITH d AS (SELECT doc_id AS i, {_squeezed("text")} AS t, {_squeezed("substring(text, 1, 40)")} AS q1, CASE WHEN doc_id % 3 = 0 THEN 'no such words at all' ELSE {_squeezed("substring(text, 10, 30)")} END AS q2, {_squeezed("substring(text, 1, 30)")} AS q3 FROM documents),
  r AS (SELECT i, list_filter([{_when("i % 10 = 0", "audience_relevance_missing")}, {_when("i % 17 = 0 OR i % 4 = 2", "source_not_verified")}, {_when("i % 13 = 0", "source_is_index")}, {_dated("i % 19 = 0")},
  {_when("i % 29 = 0", "research_declined")}, {_when("i % 31 = 0", "event_mismatch")}, {_when("i % 37 = 0 OR 50 + i % 50 < 70", "insufficient_facts")},
  {_proof(1, "false")}, {_proof(2, "false")}, {_proof(3, "i % 5 = 0")}, {_when("i % 7 = 0 OR i % 11 = 0", "headline_evidence_missing")}], lambda x: x IS NOT NULL) AS reasons FROM d)
  SELECT i AS id, coalesce(array_to_string(reasons, ','), '') AS reasons, len(reasons) = 0 AS passed FROM r""",
    "publication_gate": f"""WITH r AS (SELECT o_orderkey AS i, list_filter([{_when("i % 43 = 0", "case_version_missing")}, {_when("i % 7 = 0", "research_not_approved")}, {_when("i % 10 = 0", "audience_relevance_missing")}, {_dated("i % 19 = 0 OR i % 9 = 0")},
  {_when("i % 8 = 0", "verification_required")}, {_when("i % 3 = 0", "article_not_verified")}, {_when("i % 6 = 0 OR i % 21 = 0", "draft_changed")}, {_when("i % 5 = 0", "fact_pack_changed")}], lambda x: x IS NOT NULL) AS reasons FROM orders)
  SELECT i AS id, coalesce(array_to_string(reasons, ','), '') AS reasons, len(reasons) = 0 AS passed FROM r""",
    "reply_check": f"""WITH e AS (SELECT *, json_extract(props, '$.k')::BIGINT AS k FROM events), v AS (SELECT *, event_id % 9 <> 0 AND event_id % 14 <> 0 AND k % 6 <> 5 AND event_id % 12 <> 11 AND k % 5 <> 4 AND k % 12 <> 0 AS valid FROM e)
  SELECT event_id AS id, CASE WHEN valid THEN greatest(0, least(100, floor(value - 10 + 0.5)))::BIGINT END AS score, CASE WHEN valid THEN {_pick([*SECTIONS, "Sport"], "k")} END AS section, CASE WHEN valid THEN {_pick([*TYPES, "sport"], "event_id")} END AS type,
  CASE WHEN valid THEN {_pick([*NEXT_STEPS, "wait"], "k")} END AS next_step, CASE WHEN valid THEN 'because of ' || event_type END AS reason, CASE WHEN valid THEN CASE WHEN k % 2 = 0 THEN least(100, floor(k * 2.5::DOUBLE + 0.5))::BIGINT ELSE 0 END END AS attention,
  CASE WHEN valid THEN 0 END AS numbers, CASE WHEN valid THEN k % 7 = 0 END AS credit, NOT valid AS deferred FROM v""",
    "event_group_keys": f"""WITH {HEADLINES}, x AS (SELECT id, CASE WHEN id % 3 = 0 THEN 't' || (user_id % 20) ELSE substr(sha1(strftime(published, '%Y-%m-%d') || '|' || array_to_string(({EVENT_WORDS})[1:8], '-')), 1, 18) END AS event_key FROM h)
  SELECT event_key, count(*) AS n, min(id) AS first_id FROM x GROUP BY 1""",
    "feed_round_trip": f"""WITH {HEADLINES}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id, published::DATE ORDER BY published DESC, id DESC) AS n, max(published) OVER () AS as_of FROM h)
  SELECT 'feed ' || user_id || ' ' || published::DATE AS name, n - 1 AS place, title, 'https://www.example.com/a?id=' || id || '&b=1' AS url, 'example.com' AS source_domain, floor(epoch(published))::BIGINT AS second FROM n WHERE epoch(as_of) - floor(epoch(published)) <= 240 * 3600""",
}
