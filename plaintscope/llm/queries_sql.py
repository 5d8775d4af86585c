"""DuckDB SQL of the queries that SQL can express."""

OP1_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
short_hit AS (
  SELECT r, k, i, count(*) OVER (PARTITION BY r, k, h) > 1 AS again
  FROM (SELECT r, k, unnest(range(1, len(w) - k + 2)) AS i, hash(list_slice(w, i, i + k - 1)) AS h
        FROM words, (VALUES (3), (8)) AS t(k) WHERE len(w) >= k)),
long_hit AS (  -- only texts with so many repeated windows of 8 words can repeat one of 101
  SELECT r, 101 AS k, i, count(*) OVER (PARTITION BY r, h) > 1 AS again
  FROM (SELECT r, unnest(range(1, len(w) - 101 + 2)) AS i, hash(list_slice(w, i, i + 100)) AS h
        FROM words JOIN (SELECT r FROM short_hit WHERE again AND k = 8 GROUP BY r HAVING count(*) >= 94) USING (r)
        WHERE len(w) >= 101)),
hit AS (SELECT * FROM short_hit UNION ALL SELECT * FROM long_hit),
inside AS (
  SELECT r, k, count(DISTINCT p) AS n
  FROM (SELECT r, k, unnest(range(i, i + k)) AS p FROM hit WHERE again) GROUP BY r, k),
lines AS (
  SELECT r, CAST(sum(n - 1) AS BIGINT) AS n
  FROM (SELECT r, line, count(*) AS n
        FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM words)
        WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r, line) GROUP BY r),
counts AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(l.n, 0) AS n_dup_lines, coalesce(a.n, 0) AS n_repeat_words, coalesce(b.n, 0) AS covered_words,
         c.r IS NOT NULL AS long_repeat
  FROM words LEFT JOIN lines l USING (r)
  LEFT JOIN (SELECT * FROM inside WHERE k = 3) a USING (r)
  LEFT JOIN (SELECT * FROM inside WHERE k = 8) b USING (r)
  LEFT JOIN (SELECT * FROM inside WHERE k = 101) c USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * covered_words > 30 * n_words OR long_repeat) AS kept
FROM counts
"""

OP2_SQL = r"""
WITH lowered AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, list_slice(w, i, i + least(13, len(w)) - 1) AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM items WHERE len(w) > 0)),
places AS (
  SELECT r, i, k, list_slice(w, i, i + k - 1) AS s
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i
        FROM lowered, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)),
hits AS (SELECT r, i, p.k AS k, item_id FROM places p JOIN windows v ON p.k = v.k AND p.s = v.s),
marked AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hits) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
          FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS name FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM lowered LEFT JOIN marked USING (r) LEFT JOIN named USING (r)
"""

# A turn is escaped if it holds a closing mark, an already escaped mark, or (in a role) the text mark.
OP4_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, CASE WHEN role IN ('user', 'assistant') THEN text ELSE role || text END AS said,
         CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 19 END AS around
  FROM turns),
sized AS (
  SELECT *, length(said) + around +
    CASE WHEN regexp_matches(said, '\[/INST\]|</s>|\[/ROLE\]|(\[/?|</?)\\+(INST\]|ROLE\]|TEXT\]|s>)')
           OR (role NOT IN ('user', 'assistant') AND contains(role, '[TEXT]'))
         THEN len(regexp_extract_all(said, '(\[/?|</?)\\*(INST\]|ROLE\]|TEXT\]|s>)')) ELSE 0 END AS size
  FROM marked)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(size) AS BIGINT) AS formatted_chars, TRUE AS exact
FROM sized GROUP BY conv_id
"""

OP10_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path
  FROM cut),
ruled AS (
  SELECT page_id, parts.host, parts.path,
         max_by({verdict: rules.verdict, host: rules.host, path: rules.path}, length(rules.host || rules.path)) AS best
  FROM parts LEFT JOIN (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                               ('block', 'net', '/es/'), ('block', 'net', '/fr/')) AS rules(verdict, host, path)
    ON (parts.host = rules.host OR ends_with(parts.host, '.' || rules.host)) AND starts_with(parts.path, rules.path)
  GROUP BY page_id, parts.host, parts.path)
SELECT page_id, host, path, best.host || best.path AS rule,
       coalesce(best.verdict, CASE WHEN regexp_matches(host || path,
         '^([^/]*\.)?(adult-[^/]*|cheap-pills\.[^/]*)/|^[^/]*(casino|porn)[^/]*/|/(wp-login|phpmyadmin)[^/]*$|\.(exe|zip)$')
         THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled
"""

OP13_SQL = r"""
WITH docs AS (
  SELECT r, doc_id, w, len(w) AS n
  FROM (SELECT row_number() OVER () AS r, doc_id,
               regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
        FROM documents)),
asked AS (
  SELECT row_number() OVER () AS i, item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
corpus AS (SELECT CAST(count(*) FILTER (n > 0) AS BIGINT) AS docs_n, CAST(sum(n) AS BIGINT) AS terms_n FROM docs),
said AS (SELECT i, item_id, t, count(*) AS times FROM (SELECT i, item_id, unnest(w) AS t FROM asked) GROUP BY ALL),
held AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(w) AS t FROM docs)
         WHERE t IN (SELECT t FROM said) GROUP BY ALL),
weighed AS (SELECT t, CAST(floor(1000 * ln((2 * docs_n + 2) / (2 * df + 1))) AS BIGINT) AS weight
            FROM (SELECT t, count(*) AS df FROM held GROUP BY t), corpus),
scored AS (
  SELECT i, item_id, r, doc_id,
         CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs_n) // terms_n)))) AS BIGINT) AS score
  FROM said JOIN held USING (t) JOIN weighed USING (t), corpus GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS place FROM scored WHERE score > 0)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM ranked WHERE place <= 10
"""
