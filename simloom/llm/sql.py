"""DuckDB SQL for the contract's queries. The text columns are taken whole; null texts are empty."""

from simloom.llm.quality_rules import GRID, MEASURES

op2_line_dedup = r"""
WITH l AS (
  SELECT doc_id, i, w[i] AS line, translate(trim(w[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS w FROM documents))),
o AS (SELECT k, min(doc_id) AS owner FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT l.*, o.owner IS NOT NULL AND o.owner <> l.doc_id AS gone FROM l LEFT JOIN o USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

op4_substring_dedup = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
o AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
s AS (SELECT k, min(doc_id) AS owner FROM o GROUP BY k HAVING count(DISTINCT doc_id) > 1),
g AS (SELECT DISTINCT doc_id, j FROM (SELECT o.doc_id, unnest(range(o.i, o.i + 13)) AS j FROM o JOIN s USING (k) WHERE o.doc_id > s.owner)),
x AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS word FROM d)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(a.kept, '')) AS kept_sha256
FROM d
LEFT JOIN (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id) n USING (doc_id)
LEFT JOIN (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.j) AS kept FROM x LEFT JOIN g ON x.doc_id = g.doc_id AND x.j = g.j WHERE g.j IS NULL GROUP BY x.doc_id) a USING (doc_id)
"""

op6_url_filter = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r AS (
  SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')) AS v(verdict, rhost, rpath)),
m AS (
  SELECT p.page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM p JOIN r ON (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath) GROUP BY p.page_id)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
"""

op9_decontamination = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM p),
o AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
f AS (SELECT o.doc_id, o.i, o.n, p.item_id FROM o JOIN p ON o.n = p.n AND o.k = p.k),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT doc_id, i, n FROM f)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM f) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

op7_quality_rules = rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS times FROM g) WHERE times > 1) GROUP BY doc_id),
c AS (
  SELECT d.doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN r USING (doc_id)),
b AS (SELECT *, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, coalesce(word_chars / nullif(n_words, 0), 0)::DOUBLE AS mean FROM c),
m AS (
  SELECT *, coalesce(n_symbols / nullif(word_chars, 0), 0)::DOUBLE AS symbol_share, coalesce(n_dup_lines / nullif(len(lines), 0), 0)::DOUBLE AS dup_line_share,
    coalesce(n_repeat_words / nullif(n_words, 0), 0)::DOUBLE AS repeat_share, greatest(0, least(1, (4 - mean) / 3)) AS short_words, greatest(0, least(1, (mean - 8) / 10)) AS long_words
  FROM b),
x AS (SELECT doc_id, lang, base_failed, unnest({list(MEASURES)!r}) AS measure, unnest([{', '.join(MEASURES)}]) AS x FROM m),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
k AS (
  SELECT lang, measure, cut, count(*) AS n, 5 * count(*) FILTER (WHERE x.x > cut) AS k
  FROM x JOIN good USING (doc_id), (SELECT unnest({[float(c) for c in GRID]!r}::DOUBLE[]) AS cut) WHERE NOT base_failed GROUP BY lang, measure, cut),
p AS (
  SELECT lang, measure, cut, CASE WHEN k >= n * 0.02::DOUBLE THEN 1 ELSE (
    SELECT sum(exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln(0.02) + (n - i) * ln(0.98))) FROM (SELECT unnest(range(k + 1)) AS i)) END AS tail FROM k),
cuts AS (SELECT lang, measure, min(cut) AS cut FROM p WHERE tail <= 0.05 / ((SELECT count(*) FROM (SELECT DISTINCT lang FROM k)) * pow({len(GRID)} + 1.0, 5)) GROUP BY lang, measure),
bad AS (SELECT DISTINCT doc_id FROM x JOIN cuts ON x.lang IS NOT DISTINCT FROM cuts.lang AND x.measure = cuts.measure WHERE x.x > cut)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.doc_id IS NULL AS kept FROM m LEFT JOIN bad USING (doc_id)
"""

op10_jaccard_join = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list(DISTINCT k)) AS g FROM (SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)) GROUP BY doc_id),
c AS (SELECT g, min(doc_id) AS class, count(*) AS copies FROM s GROUP BY g),
e AS (SELECT class, len(g) AS n, unnest(g) AS k FROM c),
f AS (SELECT k FROM e GROUP BY k HAVING count(*) > 1),
t AS (SELECT class, n, k FROM e SEMI JOIN f USING (k)),
j AS (SELECT a.class AS x, b.class AS y FROM t a JOIN t b ON a.k = b.k AND a.class <> b.class AND 10 * least(a.n, b.n) >= 8 * greatest(a.n, b.n) GROUP BY a.class, b.class HAVING 10 * count(*) >= 8 * (min(a.n) + min(b.n) - count(*))),
reach AS (SELECT class AS x, class AS y FROM c UNION SELECT reach.x, j.y FROM reach JOIN j ON j.x = reach.y),
roots AS (SELECT x AS class, min(y) AS class_id FROM reach GROUP BY x),
n AS (SELECT j.x AS class, sum(c.copies) AS others FROM j JOIN c ON c.class = j.y GROUP BY j.x)
SELECT d.doc_id, coalesce(roots.class_id, d.doc_id) AS class_id, coalesce(c.copies - 1 + coalesce(others, 0), 0)::BIGINT AS n_links
FROM d LEFT JOIN s USING (doc_id) LEFT JOIN c ON c.g = s.g LEFT JOIN roots ON roots.class = c.class LEFT JOIN n ON n.class = c.class
"""
