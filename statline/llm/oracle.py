"""DuckDB SQL of the operators that SQL can express, written from their
contracts: every window, shingle and pair is formed."""

from __future__ import annotations

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPACE_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = f"translate({{}}, '{_UPPER}', '{_UPPER.lower()}')"

# Words covered by a 13-word window that also starts in a smaller document.
WORD_REPEATS = f"""
WITH d AS (SELECT doc_id, coalesce({_SPACE_WORDS.format('text')}, []) AS w FROM documents),
starts AS (
  SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM starts),
firsts AS (SELECT k, min(doc_id) AS first_doc FROM windows GROUP BY k),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p
  FROM windows JOIN firsts USING (k) WHERE first_doc < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n
  FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
       CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id"""

_BENCH_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

# Words inside an occurrence of a window of ten benchmark words.
LEAKS = f"""
WITH d AS (
  SELECT doc_id, coalesce({_BENCH_WORDS.format(_LOWER.format('text'))}, []) AS w FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, {_BENCH_WORDS.format(_LOWER.format('text'))} AS w
  FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i
        FROM items WHERE len(w) > 0)),
doc_windows AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM d, (SELECT DISTINCT n FROM item_windows) WHERE len(w) >= n)),
found AS (SELECT doc_id, i, n, item_id FROM doc_windows JOIN item_windows USING (n, k)),
hits AS (
  SELECT doc_id, count(*) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
leaked AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits ON d.doc_id = hits.doc_id LEFT JOIN leaked ON d.doc_id = leaked.doc_id"""

# Groups of documents whose sets of three-word shingles are 0.85 alike.
NEAR_COPIES = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce({_SPACE_WORDS.format(_LOWER.format('text'))}, []) AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i
        FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 85 * (x.n + y.n - c)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT doc_id, doc_id AS other FROM d
  UNION SELECT reached.doc_id, sides.b FROM reached JOIN sides ON sides.a = reached.other),
comps AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT comps.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id,
       comps.doc_id = component_id AS kept
FROM comps LEFT JOIN sizes ON sizes.doc_id = comps.doc_id"""

# Weights, scores and ranks of a resampling towards the benchmark.  A CRC-32 is
# a fold over a feature's bytes with the table of its polynomial.
RESAMPLING = f"""
WITH crc_table AS (
  SELECT list(v ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]),
                          lambda c, z: xor(c >> 1, (c & 1) * 3988292384)) AS v
    FROM range(256) bytes(b))),
texts AS (
  SELECT doc_id, coalesce({_BENCH_WORDS.format(_LOWER.format('text'))}, []) AS w FROM documents
  UNION ALL
  SELECT NULL, coalesce({_BENCH_WORDS.format(_LOWER.format('text'))}, []) FROM benchmark),
features AS (
  SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)),
                                                      lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM texts),
kinds AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM features)),
bytes AS (
  SELECT f, list_transform(range(0, strlen(f)),
                           lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)) AS b FROM kinds),
buckets AS (
  SELECT f, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b),
                            lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM bytes, crc_table),
counted AS (SELECT doc_id, bucket, count(*) AS n FROM features JOIN buckets USING (f) GROUP BY ALL),
summed AS (
  SELECT bucket, sum(n) FILTER (doc_id IS NOT NULL) AS s, sum(n) FILTER (doc_id IS NULL) AS t
  FROM counted GROUP BY bucket),
sizes AS (SELECT CAST(coalesce(sum(s), 0) AS DOUBLE) AS s_all, CAST(coalesce(sum(t), 0) AS DOUBLE) AS t_all FROM summed),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * (s_all + 10000)
    / ((CAST(coalesce(s, 0) AS DOUBLE) + 1) * (t_all + 10000)))) AS BIGINT) AS gain FROM summed, sizes),
weights AS (
  SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features,
         CAST(floor(CAST(sum(n * gain) AS DOUBLE) / CAST(sum(n) AS DOUBLE)) AS BIGINT) AS weight
  FROM counted JOIN gains USING (bucket) WHERE doc_id IS NOT NULL GROUP BY doc_id),
scored AS (
  SELECT texts.doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
           (CAST(CAST('0x' || substr(sha256('7:' || texts.doc_id), 1, 8) AS BIGINT) AS DOUBLE) + CAST(0.5 AS DOUBLE))
           / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
  FROM texts LEFT JOIN weights ON texts.doc_id = weights.doc_id WHERE texts.doc_id IS NOT NULL),
places AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n
  FROM scored WHERE n_words >= 20)
SELECT scored.doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight,
       CAST(score AS BIGINT) AS score,
       CAST(CASE WHEN place <= 25 * n // 100 THEN place END AS BIGINT) AS rank
FROM scored LEFT JOIN places ON scored.doc_id = places.doc_id"""

# The blocks of each page's article, by splitting its source (the shared pages
# mark the article, and hold headings and paragraphs in it).
MAIN_TEXT = r"""
WITH articles AS (
  SELECT page_id, url, regexp_replace(coalesce(regexp_extract(html, '(?s)<article>(.*?)(</article>|$)', 1), ''),
                                      '<[^>]*$', '') AS source FROM pages),
blocks AS (
  SELECT page_id, url, list_transform(regexp_split_to_array(source, '</?p>|</?h1>'), lambda x:
    trim(regexp_replace(regexp_replace(replace(replace(replace(replace(
      regexp_replace(x, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''),
      '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS b FROM articles)
SELECT page_id, url, array_to_string(list_filter(b, lambda x: x <> ''), chr(10) || chr(10)) AS text,
       CAST(length(array_to_string(list_filter(b, lambda x: x <> ''), chr(10) || chr(10))) AS BIGINT) AS n_chars
FROM blocks"""
