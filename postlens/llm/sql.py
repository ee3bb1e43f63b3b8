"""DuckDB SQL of the operators that SQL can express."""

ORACLE: dict[str, str] = {}

ORACLE["op10_url_rules"] = r"""
WITH u AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(action, rhost, rpath) AS (VALUES ('block','net','/'), ('allow','example.net','/en/'), ('block','example.com','/de/'), ('allow','org','/fr/')),
p(action, pattern) AS (VALUES ('block','(^|\.)adserver\.'), ('block','(^|\.)doubleclick\.'), ('block','(^|[./_-])casino([./_-]|$)'),
  ('block','(^|[./_-])xxx([./_-]|$)'), ('block','/wp-login\.php$'), ('block','/cgi-bin/'))
SELECT page_id, host, path,
  (SELECT rhost || rpath FROM r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
   ORDER BY length(rhost || rpath) DESC, rhost LIMIT 1) AS rule,
  coalesce((SELECT action FROM r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
   ORDER BY length(rhost || rpath) DESC, rhost LIMIT 1),
   (SELECT action FROM p WHERE regexp_matches(host || path, pattern) LIMIT 1), 'allow') AS verdict
FROM u
"""

ORACLE["op7_decontamination"] = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS need, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS span
  FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
needs AS (SELECT DISTINCT need FROM bw),
dw AS (SELECT rid, i, need, array_to_string(list_slice(w, i, i + need - 1), ' ') AS span
  FROM (SELECT rid, w, need, unnest(range(1, len(w) - need + 2)) AS i FROM d, needs WHERE len(w) >= need)),
h AS (SELECT rid, i, need, item FROM dw JOIN bw USING (need, span)),
c AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + need)) AS p FROM (SELECT DISTINCT rid, i, need FROM h)) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)
"""

ORACLE["op12_collocations"] = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (SELECT lang, unnest(pieces) AS piece FROM d)),
g AS (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 100),
cuts AS (SELECT lang, phrase, a, w, k, unnest(range(1, k)) AS j FROM c),
parts AS (SELECT cuts.lang, cuts.phrase, a, j, n, l.f AS l, r.f AS r, CAST((CAST(1000 AS HUGEINT) * a * n) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM cuts JOIN n USING (lang)
  JOIN f l ON l.lang = cuts.lang AND l.phrase = array_to_string(list_slice(w, 1, j), ' ')
  JOIN f r ON r.lang = cuts.lang AND r.phrase = array_to_string(list_slice(w, j + 1, cuts.k), ' ')),
best AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (SELECT lang, a AS longer, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase
  FROM (SELECT lang, a, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT lang, a, w, unnest(range(2, k)) AS m FROM c WHERE k > 2))),
held AS (SELECT lang, phrase, max(longer) AS longer FROM inside GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN held USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000
"""
