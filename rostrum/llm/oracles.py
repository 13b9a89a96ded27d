"""DuckDB SQL for the queries of this subpackage that SQL can express."""

_UPPER, _LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINE_DEDUP = f"""
WITH split AS (
  SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), line AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split
), keyed AS (
  SELECT *, translate(trim(line, {_SPACES}), {_UPPER}, {_LOWER}) AS key FROM line
), frequent AS (
  SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.doc_id, k.line, k.pos, f.top IS NOT NULL AND k.doc_id <> f.top AS gone FROM keyed k LEFT JOIN frequent f USING (key)
)
SELECT doc_id, count(*) AS n_lines, count_if(gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

DECONTAMINATION = f"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_UPPER}, {_LOWER}), {_ALNUM}) AS w FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(translate(text, {_UPPER}, {_LOWER}), {_ALNUM}) AS w FROM benchmark WHERE text IS NOT NULL
), item_start AS (
  SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM item WHERE len(w) > 0
), window_of AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM item_start
), doc_start AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM window_of) WHERE len(w) >= n
), met AS (
  SELECT d.doc_id, d.i, d.n, x.item_id FROM doc_start d JOIN window_of x ON x.n = d.n AND x.s = array_to_string(d.w[d.i:d.i + d.n - 1], ' ')
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM met) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM met) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_WORDS = r"'[^\x20\x09-\x0D]+'"

SUBSTRING_DEDUP = f"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents
), win AS (
  SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM doc WHERE len(w) >= 20
), hashed AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM win
), again AS (
  SELECT doc_id, i FROM hashed QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM again
), word AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM doc
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, len(w)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (doc_id)
"""

NEAR_DEDUP = f"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_UPPER}, {_LOWER}), {_WORDS}) AS w FROM documents
), start AS (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM doc WHERE len(w) > 0
), shingle AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 3], ' ')) AS s FROM start
), size AS (
  SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), link AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN size p ON p.doc_id = a.doc_id JOIN size q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id
  HAVING 100 * count(*) >= 80 * (max(p.n) + max(q.n) - count(*))
), reach AS (
  SELECT doc_id, doc_id AS other FROM doc
  UNION
  SELECT r.doc_id, l.y FROM reach r JOIN link l ON l.x = r.other
)
SELECT r.doc_id, coalesce(max(s.n), 0) AS n_shingles, min(r.other) AS component_id, r.doc_id = min(r.other) AS kept
FROM reach r LEFT JOIN size s ON s.doc_id = r.doc_id GROUP BY r.doc_id
"""

QUALITY = f"""
WITH doc AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents
), line AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM doc) WHERE regexp_matches(line, {_WORDS}) GROUP BY doc_id
), gram AS (
  SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM doc WHERE len(w) >= 3)
), again AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM (SELECT doc_id, i FROM gram QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1)) GROUP BY doc_id
), m AS (
  SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM doc LEFT JOIN line USING (doc_id) LEFT JOIN again USING (doc_id)
), value AS (
  SELECT doc_id, lang, source, n_words, unnest(['word_length', 'symbols', 'dup_lines', 'repeats']) AS feature,
         unnest([coalesce(word_chars / nullif(n_words, 0), 0), coalesce(n_symbols / nullif(word_chars, 0), 0), n_dup_lines / (n_lines + 4), coalesce(n_repeat_words / nullif(n_words, 0), 0)]) AS x FROM m
), bucket AS (
  SELECT lang, source, feature, CASE WHEN x >= 1e-4 THEN ceil(ln(x) / ln(1.02))::INT END AS b, count(*) AS n FROM value WHERE n_words > 0 GROUP BY ALL
), level AS (
  SELECT 0 AS l, lang, source, feature, b, n FROM bucket
  UNION ALL SELECT 1, lang, NULL, feature, b, sum(n) FROM bucket GROUP BY ALL
  UNION ALL SELECT 2, NULL, NULL, feature, b, sum(n) FROM bucket GROUP BY ALL
), summed AS (
  SELECT *, sum(n) OVER (PARTITION BY l, lang, source, feature ORDER BY b NULLS FIRST) AS upto, sum(n) OVER (PARTITION BY l, lang, source, feature) AS total,
         CASE WHEN b IS NULL THEN 0 ELSE 2 * pow(1.02, b) / 2.02 END AS at_ FROM level
), quartile AS (
  SELECT l, lang, source, feature, max(total) AS total, min(at_) FILTER (WHERE upto > 0.25 * (total - 1)) AS q1, min(at_) FILTER (WHERE upto > 0.75 * (total - 1)) AS q3 FROM summed GROUP BY ALL
), fence AS (
  SELECT l, lang, source, feature, total / (total + 100.0) AS share, q1, q3, 3.0 * greatest(q3 - q1, CASE feature WHEN 'word_length' THEN 0.8 WHEN 'symbols' THEN 0.02 ELSE 0.1 END) AS spread FROM quartile
), limits AS (
  SELECT s.lang, s.source, s.feature,
         s.share * (s.q1 - s.spread) + (1 - s.share) * CASE WHEN s.feature IN ('word_length', 'repeats') THEN a.q1 - a.spread * (1 / a.share) ELSE a.share * (a.q1 - a.spread) + (1 - a.share) * (e.q1 - e.spread) END AS low,
         s.share * (s.q3 + s.spread) + (1 - s.share) * CASE WHEN s.feature IN ('word_length', 'repeats') THEN a.q3 + a.spread * (1 / a.share) ELSE a.share * (a.q3 + a.spread) + (1 - a.share) * (e.q3 + e.spread) END AS high
  FROM fence s JOIN fence a ON s.l = 0 AND a.l = 1 AND a.lang IS NOT DISTINCT FROM s.lang AND a.feature = s.feature JOIN fence e ON e.l = 2 AND e.feature = s.feature
), verdict AS (
  SELECT doc_id, bool_and(x <= high AND (x >= low OR v.feature <> 'word_length')) AS good
  FROM value v JOIN limits m ON m.lang IS NOT DISTINCT FROM v.lang AND m.source IS NOT DISTINCT FROM v.source AND m.feature = v.feature GROUP BY doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(good, false) AS kept
FROM m LEFT JOIN verdict USING (doc_id)
"""

PERIODIC_RUNS = f"""
WITH bits AS (
  SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, b: xor(c >> 1, (c & 1) * 3988292384))) AS t
), named AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS o,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM documents, bits
), placed AS (
  SELECT doc_id, o, h % 10 = 0 AND len(o) > 0 AS looped, CASE WHEN len(o) > 0 THEN (h // 10) % len(o) END AS a, 3 + (h // 10) % 8 AS d FROM named
), doc AS (
  SELECT doc_id, CASE WHEN looped THEN list_transform(range(len(o)), lambda i: o[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (len(o) - a) // d) END + 1]) ELSE o END AS w FROM placed
), word AS (
  SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS word, len(w) AS n FROM doc
), same AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM word x JOIN word y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), island AS (
  SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM same
), stretch AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM island GROUP BY doc_id, q, g HAVING count(*) + q >= greatest(6, 4 * q)
), run AS (
  SELECT doc_id, start, length, min(q) AS period FROM stretch GROUP BY doc_id, start, length
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run
), told AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM run GROUP BY doc_id
), best AS (
  SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) = 1
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM doc LEFT JOIN told USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_TERMS = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"

RANKED_SEARCH = f"""
WITH wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, {_UPPER}, {_LOWER}), {_TERMS})) AS term FROM benchmark
), doc AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, {_UPPER}, {_LOWER}), {_TERMS}) AS w FROM documents
), total AS (
  SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_words FROM doc WHERE len(w) > 0
), posting AS (
  SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(w) AS term FROM doc) WHERE term IN (SELECT term FROM wanted) GROUP BY row, term
), weight AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM posting, total GROUP BY term, n_docs
), scored AS (
  SELECT q.item_id, p.row, d.doc_id, sum(x.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (10 + (90 * len(d.w) * n_docs) // n_words))))::BIGINT AS score
  FROM wanted q JOIN posting p USING (term) JOIN weight x USING (term) JOIN doc d USING (row), total GROUP BY q.item_id, p.row, d.doc_id
), placed AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT * FROM placed WHERE rank <= 10
"""
