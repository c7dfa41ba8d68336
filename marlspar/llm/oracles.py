"""DuckDB counterparts of the queries that need more than a few lines of SQL."""

from __future__ import annotations

from .quality import COMMON, WORDS


def _without(text, pattern):
    return f"(length({text}) - length(regexp_replace({text}, '{pattern}', '', 'g')))"


_counts = ", ".join(f"len(list_filter(words, lambda w: w = '{w}'))" for w in WORDS)
_own = ", ".join(f"{{'n': {' + '.join(f'counts[{WORDS.index(w) + 1}]' for w in words)}, 'k': '{k}'}}" for k, words in COMMON.items())
_plogp = "CASE WHEN {0} > 0 THEN {0} * log2({0}) ELSE 0 END"


def _distance(p, q):
    x, y = f"(z[1] / list_sum({p})::DOUBLE)", f"(z[2] / list_sum({q})::DOUBLE)"
    inner = f"({_plogp.format(x)} + {_plogp.format(y)}) / 2 - ({_plogp.format(f'(({x} + {y}) / 2)')})"
    return f"CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN sqrt(greatest(list_sum(list_transform(list_zip({p}, {q}), lambda z: {inner})), 0)) END"


OP2 = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, lang, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
windows AS (
  SELECT row, i, count(*) OVER (PARTITION BY row, words[i], words[i + 1], words[i + 2]) AS n FROM docs, unnest(range(1, CAST(len(words) AS BIGINT) - 1)) AS t(i)),
covered AS (
  SELECT row, count(DISTINCT i + k) AS n_repeat_words FROM windows, unnest(range(0, 3)) AS t(k) WHERE n > 1 GROUP BY row),
lines AS (
  SELECT row, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS full_lines, array_to_string(words, '') AS joined FROM docs),
base AS (
  SELECT d.row, doc_id, lang, len(words) AS n_words, length(joined) AS word_chars, {_without('text', '[#*$%&|<>]')} AS n_symbols,
         len(full_lines) - len(list_distinct(full_lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         [{_without('joined', '[aeiou]')}, {_without('joined', '[A-Z]')}, {_without('joined', '[0-9]')}, {_without('joined', '[.,;:!?''"()-]')}, {_without('joined', '[#*$%&|<>]')}] AS classes,
         octet_length(encode(joined)) - length(joined) AS more_bytes, [{_counts}] AS counts
  FROM docs d JOIN lines USING (row) LEFT JOIN covered USING (row)),
histograms AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, list_max([{_own}]).k AS lang_seen,
         list_concat(classes, [more_bytes, greatest(word_chars - list_sum(classes), 0)]) AS all_classes, list_concat(counts, [n_words - list_sum(counts)]) AS all_counts
  FROM base),
keyed AS (SELECT *, coalesce(lang, lang_seen) AS lang_key FROM histograms),
summed_classes AS (
  SELECT lang_key, list(total ORDER BY i) AS ref_classes FROM (
    SELECT lang_key, i, sum(all_classes[i]) AS total FROM keyed, unnest(range(1, 8)) AS t(i) WHERE NOT base_failed GROUP BY ALL) GROUP BY lang_key),
summed_counts AS (
  SELECT lang_key, list(total ORDER BY i) AS ref_counts FROM (
    SELECT lang_key, i, sum(all_counts[i]) AS total FROM keyed, unnest(range(1, {len(WORDS) + 2})) AS t(i) WHERE NOT base_failed GROUP BY ALL) GROUP BY lang_key),
reference AS (SELECT * FROM summed_classes JOIN summed_counts USING (lang_key)),
measured AS (
  SELECT k.*, least({_distance('all_classes', 'r.ref_classes')}, {_distance('all_classes', 's.ref_classes')}) AS char_distance,
         least({_distance('all_counts', 'r.ref_counts')}, {_distance('all_counts', 's.ref_counts')}) AS word_distance
  FROM keyed k LEFT JOIN reference r ON k.lang_key = r.lang_key LEFT JOIN reference s ON k.lang_seen = s.lang_key)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND coalesce(word_chars < 300 OR char_distance <= 0.22 + 0.6 / sqrt(greatest(n_words, 1)), true)
         AND coalesce(n_words < 80 OR word_distance <= 0.24 + 0.6 / sqrt(greatest(n_words, 1)), true) AS kept,
       round(char_distance, 6) AS char_distance, round(word_distance, 6) AS word_distance
FROM measured
"""

OP3 = r"""
WITH lines AS (
  SELECT doc_id, i AS line, string_split(text, chr(10))[i] AS text, list_filter(regexp_split_to_array(string_split(text, chr(10))[i], '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents, unnest(range(1, CAST(len(string_split(text, chr(10))) AS BIGINT) + 1)) AS t(i)),
firsts AS (
  SELECT row_number() OVER () AS id, text, words, CAST(len(words) AS BIGINT) AS n, min((doc_id, line)) AS place FROM lines WHERE len(words) > 0 GROUP BY text, words),
runs AS (
  SELECT DISTINCT id, words[i:i + 5] AS run FROM firsts, unnest(range(1, n - 4)) AS t(i) WHERE n >= 10
  UNION SELECT id, words FROM firsts WHERE n <= 3 UNION SELECT id, list_concat(['2'], words[i:i + 1]) FROM firsts, unnest(range(1, n)) AS t(i) WHERE n <= 12),
pairs AS (
  SELECT DISTINCT a.id AS x, b.id AS y FROM runs a JOIN runs b ON a.run = b.run AND a.id < b.id),
fitting AS (
  SELECT a.text AS text_a, b.text AS text_b, a.place AS place_a, b.place AS place_b, greatest(greatest(a.n, b.n) * 8 // 100, CAST(greatest(a.n, b.n) >= 4 AS BIGINT)) AS k,
         CASE WHEN a.n <= b.n THEN a.words ELSE b.words END AS u, CASE WHEN a.n <= b.n THEN b.words ELSE a.words END AS v, least(a.n, b.n) AS nu, greatest(a.n, b.n) AS nv
  FROM pairs JOIN firsts a ON a.id = x JOIN firsts b ON b.id = y WHERE abs(a.n - b.n) <= greatest(greatest(a.n, b.n) * 8 // 100, CAST(greatest(a.n, b.n) >= 4 AS BIGINT))),
measured AS (
  SELECT *, list_reduce(range(1, nu + 1), lambda above, i: list_reduce(range(0, 2 * k + 1), lambda here, e: list_append(here,
           CASE WHEN i + e - k < 0 OR i + e - k > nv THEN 1000000 WHEN i + e - k = 0 THEN i ELSE
             least(above[e + 1] + CAST(u[i] <> v[i + e - k] AS BIGINT), coalesce(above[e + 2], 1000000) + 1, coalesce(here[e], 1000000) + 1) END), CAST([] AS BIGINT[])),
         list_transform(range(0, 2 * k + 1), lambda e: CASE WHEN e < k THEN 1000000 ELSE e - k END))[nv - nu + k + 1] AS edits
  FROM fitting),
near AS (
  SELECT DISTINCT CASE WHEN place_a > place_b THEN text_a ELSE text_b END AS text FROM measured WHERE edits <= k),
judged AS (
  SELECT l.*, len(l.words) > 0 AS full_, (l.doc_id, l.line) = f.place AS first, m.text IS NOT NULL AS near
  FROM lines l LEFT JOIN firsts f ON l.text = f.text LEFT JOIN near m ON l.text = m.text)
SELECT d.doc_id, count(j.line) FILTER (full_) AS n_lines, count(j.line) FILTER (full_ AND NOT first) AS n_exact, count(j.line) FILTER (full_ AND first AND near) AS n_near,
       sha256(coalesce(string_agg(j.text, chr(10) ORDER BY line) FILTER (NOT full_ OR first AND NOT near), '')) AS kept_sha256
FROM documents d LEFT JOIN judged j USING (doc_id) GROUP BY d.doc_id
"""

OP8 = r"""
WITH docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         row_number() OVER () AS row FROM documents),
windows AS (
  SELECT row, i, md5(array_to_string(words[i:i + 34], ' ')) AS digest
  FROM docs, unnest(range(1, CAST(len(words) AS BIGINT) - 33)) AS t(i)),
repeated AS (
  SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY digest) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT DISTINCT row, i + k AS place FROM repeated, unnest(range(0, 35)) AS t(k)),
places AS (
  SELECT row, place, words[place] AS word FROM docs, unnest(range(1, CAST(len(words) AS BIGINT) + 1)) AS t(place)),
kept AS (
  SELECT p.row, string_agg(word, ' ' ORDER BY p.place) FILTER (c.place IS NULL) AS text, count(c.place) AS n_removed
  FROM places p LEFT JOIN covered c ON p.row = c.row AND p.place = c.place GROUP BY p.row)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs LEFT JOIN kept k USING (row)
"""
OP9 = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) = 1 THEN words[1] ELSE words[i] || ' ' || words[i + 1] END AS shingle
  FROM docs, unnest(range(1, greatest(2, CAST(len(words) AS BIGINT)))) AS t(i) WHERE len(words) > 0),
sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * both_ >= 80 * (x.n + y.n - both_)),
either AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links),
reached AS (
  SELECT doc_id AS start, doc_id AS place FROM docs
  UNION SELECT r.start, e.b FROM reached r JOIN either e ON e.a = r.place)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, min(r.place) AS component_id, min(r.place) = d.doc_id AS kept
FROM docs d JOIN reached r ON r.start = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id GROUP BY d.doc_id, s.n
"""
