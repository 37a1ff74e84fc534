"""DuckDB SQL for the queries that SQL can express, each written from the definition, not from the method."""

from __future__ import annotations

from .quality_rules import STOP_WORDS, THRESHOLDS

_WORD = r"[^\x20\x09-\x0D]+"
_TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS words FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (
  SELECT doc_id, unnest([array_to_string(words[i:i + 4], ' ') FOR i IN range(1, greatest(len(words) - 3, 2))]) AS s FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT link.b, root FROM reach JOIN link ON link.a = reach.id),
least AS (SELECT id, min(root) AS root FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, root AS component_id, root = d.doc_id AS kept
FROM documents d JOIN least ON least.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

URLS = r"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(verdict, h, q) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
f AS (SELECT p.*, h || q AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(h || q) DESC NULLS LAST) AS k
  FROM p LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE k = 1
"""


def _rules() -> str:
    tests = []
    for _, part, whole, least, most in THRESHOLDS:
        scale = "1" if whole is None else whole
        tests += [f"{part} >= {least} * {scale}"] if least is not None else []
        tests += [f"{part} <= {most} * {scale}"] if most is not None else []
    stop = ", ".join(f"'{x}'" for x in STOP_WORDS)
    return rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM documents),
g AS (SELECT doc_id, i, words[i:i + 2] AS t FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
g2 AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS n FROM g) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g2) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
  len(list_filter(words, lambda x: lower(x) IN ({stop})))::BIGINT AS n_stop_words, len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•]')))::BIGINT AS n_bullet_lines,
  len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$')))::BIGINT AS n_ellipsis_lines FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id)
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {" AND ".join(tests)} AS kept FROM m
"""


PHRASES = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents),
g AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS t FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY t) AS one FROM g) WHERE one < doc_id),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(0, 13)) AS i FROM late),
k AS (SELECT x.doc_id, x.i, words[x.i] AS word FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w) x),
kept AS (SELECT k.doc_id, string_agg(word, ' ' ORDER BY k.i) AS t FROM k LEFT JOIN gone ON gone.doc_id = k.doc_id AND gone.i = k.i WHERE gone.i IS NULL GROUP BY k.doc_id),
c AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id LEFT JOIN c ON c.doc_id = w.doc_id
"""

LEAKS = rf"""
WITH iw AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_TERM}') AS words FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(words), 10) AS n, array_to_string(words[i:i + 9], ' ') AS t
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 8, 2))) AS i FROM iw WHERE len(words) > 0)),
w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_TERM}') AS words FROM documents),
g AS (SELECT doc_id, n, i, array_to_string(words[i:i + n - 1], ' ') AS t
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM win))),
hit AS (SELECT doc_id, item_id, i, g.n FROM g JOIN win ON g.n = win.n AND g.t = win.t),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(it.n, 0)::BIGINT AS n_items, sha256(coalesce(it.s, '')) AS items_sha256, c.n IS NOT NULL AS contaminated
FROM w LEFT JOIN c ON c.doc_id = w.doc_id LEFT JOIN it ON it.doc_id = w.doc_id
"""



def crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of an ASCII string, bit by bit."""
    bits = "list_reduce(list_concat([xor(c, b)], range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({text}, ''), lambda y: ascii(y)::BIGINT)), lambda c, b: {bits}), 4294967295::BIGINT)"


#: Levels that the SQL of the manifest has for a tree: enough for 8 ** 8 leaves.
_HEIGHT = 8


def _tree(name: str) -> list[str]:
    """CTEs from {name}0 (g, i, d) on: at each level the nodes, with what is left and right of them in their run, and the run's digest."""
    out = []
    for k in range(_HEIGHT):
        run = "PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND"
        out.append(f"{name}{k}s AS (SELECT *, coalesce(string_agg(d, '') OVER ({run} 1 PRECEDING), '') AS l, coalesce(string_agg(d, '') OVER (PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r, count(*) OVER (PARTITION BY g) AS n FROM {name}{k})")
        out.append(f"{name}{k + 1} AS (SELECT g, i // 8 AS i, sha256(string_agg(d, '' ORDER BY i)) AS d FROM {name}{k}s WHERE n > 1 GROUP BY g, i // 8)")
    out.append(f"{name}top AS ({' UNION ALL '.join(f'SELECT g, d FROM {name}{k}s WHERE n = 1' for k in range(_HEIGHT))})")
    return out


def _manifest() -> str:
    part = lambda x: f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen({x}::VARCHAR)::VARCHAR || ':' || {x}::VARCHAR END"
    leaf = lambda text: f"sha256({' || '.join(map(part, ('doc_id', 'source', 'lang', 'n_chars', text)))})"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def path(name: str, tree: str, at: str) -> tuple[str, str]:
        """A list of [left, right] of the levels of a path, and the joins that give it."""
        arms = ", ".join(f"CASE WHEN j{k}.n > 1 THEN [j{k}.l, j{k}.r] END" for k in range(_HEIGHT))
        joins = " ".join(f"LEFT JOIN {name}{k}s AS j{k} ON j{k}.g IS NOT DISTINCT FROM {tree} AND j{k}.i = {at} // {8**k} AND j{k}.n > 1" for k in range(_HEIGHT))
        return f"list_filter([{arms}], lambda y: y IS NOT NULL)", joins

    low, low_joins = path("t", "a.g", "a.i")
    high, high_joins = path("c", "0", "c.i")
    ctes = [
        f"f AS (SELECT doc_id, lang AS g, {leaf('text')} AS d, CASE WHEN {crc32('doc_id::VARCHAR')} % 3 = 0 THEN {leaf(lower)} END AS t FROM documents)",
        "a AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, d) - 1 AS i FROM f)",
        "t0 AS (SELECT g, i, d FROM a)", *_tree("t"),
        "c AS (SELECT g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, d FROM ttop)",
        "c0 AS (SELECT 0 AS g, i, d FROM c)", *_tree("c"),
        f"p AS (SELECT doc_id, a.g, a.d AS leaf, coalesce(a.t, a.d) AS x, {low} AS low FROM a {low_joins})",
        f"h AS (SELECT c.g, c.d AS subroot, {high} AS high FROM c {high_joins})",
        "z AS (SELECT doc_id, leaf, subroot, x, list_concat(low, high) AS path FROM p JOIN h ON h.g IS NOT DISTINCT FROM p.g)",
        "y AS (SELECT *, list_reduce(list_concat([[x]], path), lambda v, s: [sha256(s[1] || v[1] || s[2])])[1] AS folded_root, array_to_string(flatten(path), '') AS siblings FROM z)",
    ]
    return "WITH " + ",\n".join(ctes) + "\nSELECT doc_id, leaf, subroot, ctop.d AS root, sha256(siblings) AS proof_sha256, folded_root, folded_root = ctop.d AS verified FROM y, ctop"


TRIE = f"""
WITH t AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT *, ({crc32('conv_id::VARCHAR')} % 6)::BIGINT AS h FROM t),
r AS (SELECT h.conv_id, list_concat(coalesce(b.turns, [])[1:h.h], h.turns[h.h + 1:]) AS turns FROM h LEFT JOIN t b ON b.conv_id = h.conv_id - h.conv_id % 100),
p AS (SELECT conv_id, len(turns) AS n, d, turns[1:d] AS prefix FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM r)),
node AS (SELECT d, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, max(n) = d AS leaf, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '') AS ends,
  CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * length(prefix[d].t) END AS own FROM p GROUP BY d, prefix),
up AS (SELECT x.d, x.prefix, k, x.prefix[1:k] AS above, leaf, own FROM node x, LATERAL (SELECT unnest(range(0, x.d + 1)) AS k)),
below AS (SELECT k AS d, above AS prefix, count(*) FILTER (WHERE up.d = k + 1) AS n_children, count(*) FILTER (WHERE leaf) AS n_leaves, sum(own) AS saved FROM up GROUP BY k, above)
SELECT n.conv_id, n.d::BIGINT AS depth, m.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves, saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM node n JOIN below b ON b.d = n.d AND b.prefix = n.prefix LEFT JOIN node m ON m.d = n.d - 1 AND m.prefix = n.prefix[1:n.d - 1]
"""


ORACLES = {"op2_near_dedup": NEAR, "op3_url_filter": URLS, "op4_quality_rules": _rules(), "op5_phrase_dedup": PHRASES, "op6_decontamination": LEAKS, "op11_merkle_manifest": _manifest(), "op13_conversation_trie": TRIE}
