"""SQL that computes the same rows as a query, where SQL can express it."""

from __future__ import annotations

STATEMENTS = {
    "op2_redirect_equivalence": r"""
WITH RECURSIVE rules(verdict, rule, rule_host, rule_path) AS (
  VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
         ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')
), found AS (
  SELECT url AS source,
         replace(regexp_extract(regexp_extract(html,
           '<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>', 0, 'is'),
           '\bhref\s*=\s*["'']?([^"''\s>]+)', 1, 'is'), '&amp;', '&') AS target FROM pages
  UNION ALL
  SELECT url, replace(regexp_extract(regexp_extract(html,
           '<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0, 'is'),
           '\burl\s*=\s*["'']?([^"''\s>;]+)', 1, 'is'), '&amp;', '&') FROM pages
), links AS (
  SELECT source, CASE
    WHEN contains(target, '://') THEN target
    WHEN starts_with(target, '//') THEN 'http:' || target
    WHEN starts_with(target, '/') THEN regexp_extract(source, '^.*?://[^/?#]*', 0) || target
    ELSE source END AS target
  FROM found WHERE target <> ''
), urls AS (
  SELECT url FROM pages UNION SELECT target FROM links
), parts AS (
  SELECT url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM urls
), addresses AS (
  SELECT url, translate(regexp_extract(rest, '^[^/?#]*', 0),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         regexp_extract(rest, '^[^?#]*([?][^#]*)?', 1) AS query
  FROM parts
), nodes AS (
  SELECT url, coalesce(host, '') AS host, coalesce(path, '') AS path,
         CASE WHEN host <> '' THEN host || path || coalesce(query, '') END AS node
  FROM addresses
), edges AS (
  SELECT a.node AS a, b.node AS b FROM links JOIN nodes a ON a.url = source JOIN nodes b ON b.url = target
), both_ways AS (
  SELECT a, b FROM edges UNION SELECT b, a FROM edges
), reach(a, b) AS (
  SELECT DISTINCT node, node FROM nodes WHERE node IS NOT NULL
  UNION
  SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a
), component AS (
  SELECT a AS node, min(b) AS alias_of FROM reach GROUP BY a
), ruled AS (
  SELECT DISTINCT node, first_value(rule) OVER w AS rule, first_value(verdict) OVER w AS verdict
  FROM nodes JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host))
                       AND starts_with(path, rule_path)
  WHERE node IS NOT NULL
  WINDOW w AS (PARTITION BY node ORDER BY length(rule) DESC, verdict, rule DESC)
), carried AS (
  SELECT alias_of FROM component JOIN ruled USING (node) GROUP BY alias_of
  HAVING bool_or(verdict = 'block') AND NOT bool_or(verdict = 'allow')
)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
       coalesce(ruled.verdict, CASE WHEN carried.alias_of IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       component.alias_of AS alias_of
FROM pages LEFT JOIN nodes ON nodes.url IS NOT DISTINCT FROM pages.url
LEFT JOIN ruled USING (node) LEFT JOIN component USING (node)
LEFT JOIN carried ON carried.alias_of = component.alias_of
""",
    "op9_exact_dedup": r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
""",
    "op11_kronecker_negatives": """
WITH fine AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0
), parts AS (
  SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM fine
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, any_value(a.label) = any_value(r.label) AS same,
         CAST(sum(a.x * r.x) AS BIGINT) AS score
  FROM parts a JOIN parts r ON a.i = r.i AND a.vec_id <> r.vec_id
  WHERE a.vec_id % 50 = 0
  GROUP BY a.vec_id, r.vec_id
), positives AS (
  SELECT * FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
 AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) <= 3
""",
    "op12_source_divergence": r"""
WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), tokens AS (
  SELECT id, lang, source, unnest(terms) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS everywhere FROM tokens GROUP BY lang, term HAVING count(DISTINCT id) >= 3
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM tokens SEMI JOIN kept USING (lang, term) GROUP BY ALL
), sizes AS (
  SELECT lang, count(*) AS v, sum(everywhere) AS lang_n FROM kept GROUP BY lang
), groups AS (
  SELECT lang, source, coalesce(any_value(held.n), 0) AS n, coalesce(any_value(v), 0) AS v, any_value(lang_n) AS lang_n
  FROM docs LEFT JOIN (SELECT lang, source, sum(n) AS n FROM counts GROUP BY ALL) held USING (lang, source)
  LEFT JOIN sizes USING (lang) GROUP BY lang, source
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS c,
         1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1) // (g.n + g.v) AS p,
         1 + CAST(1000000000 AS HUGEINT) * (k.everywhere + 1) // (g.lang_n + g.v) AS q
  FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(any_value(value), 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS other, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
    FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
  ) s ON s.lang = a.lang AND s.source = a.source AND s.other = b.source
  GROUP BY a.lang, a.source, b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM shares WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM found
QUALIFY part = 'pair' OR rank <= 200
""",
}
