"""DuckDB SQL for the operators whose result SQL can express."""

from __future__ import annotations

from .common import WORD

_NEAR = rf"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, regexp_extract_all(text, '{WORD}') AS words FROM documents
), named AS (
  SELECT doc_id, words, CASE WHEN len(words) > 0 THEN array_to_string(words, ' ') END AS body FROM rows_
), texts AS (
  SELECT body, any_value(words) AS words, min(doc_id) AS first_id, count(*) AS copies,
         row_number() OVER (ORDER BY body) AS node
  FROM named WHERE body IS NOT NULL GROUP BY body
), shingles AS (
  SELECT DISTINCT node,
         array_to_string(words[i:i + 4], ' ') AS shingle
  FROM (SELECT node, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM texts)
), sized AS (
  SELECT node, count(*) AS n FROM shingles GROUP BY node
), shared AS (
  SELECT a.node AS a, b.node AS b, count(*) AS n
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.node <> b.node GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN sized x ON x.node = a JOIN sized y ON y.node = b
  WHERE 5 * shared.n >= 4 * (x.n + y.n - shared.n)
), counted AS (
  SELECT a AS node, count(*) AS texts, sum(copies) AS links FROM links JOIN texts ON texts.node = b GROUP BY a
), reached(node, other) AS (
  SELECT node, node FROM texts UNION SELECT reached.node, b FROM reached JOIN links ON a = other
), classes AS (
  SELECT reached.node, min(texts.first_id) AS class_id FROM reached JOIN texts ON texts.node = other GROUP BY 1
)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id,
       CAST(coalesce(links + copies - 1, copies - 1, 0) AS BIGINT) AS n_links,
       CAST(coalesce(counted.texts, 0) AS BIGINT) AS n_text_links,
       CAST(coalesce(copies, 1) AS BIGINT) AS copies
FROM named d LEFT JOIN texts USING (body) LEFT JOIN classes USING (node) LEFT JOIN counted USING (node)
"""

# CRC-32 from its polynomial: a table of 256 remainders, then one step for each byte.
_SHARDS = """
WITH RECURSIVE poly(n, k, c) AS (
  SELECT range::BIGINT, 0, range::BIGINT FROM range(256)
  UNION ALL
  SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM poly WHERE k < 8
), tab AS (
  SELECT list(c ORDER BY n) AS t FROM poly WHERE k = 8
), rows_ AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT + 8 AS size,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes
  FROM documents
), summed AS (
  SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM rows_, tab
), placed AS (
  SELECT *, sum(size) OVER w AS upto, row_number() OVER w - 1 AS position, sum(size) OVER () AS total
  FROM summed WINDOW w AS (ORDER BY doc_id NULLS FIRST, text_crc32 ROWS UNBOUNDED PRECEDING)
), cut AS (
  SELECT *, least((2 * upto - size) * 24 // (2 * total), 23)::INT AS shard FROM placed
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  (position - min(position) OVER (PARTITION BY shard))::BIGINT AS slot, NULL::INT AS grown_shard
FROM cut
"""

_RULES = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS id, doc_id, lang, text, coalesce(regexp_extract_all(text, '{WORD}'), []) AS words FROM documents
), windows AS (
  SELECT id, i, array_to_string(words[i:i + 7], ' ') AS run
  FROM (SELECT id, words, unnest(range(1, len(words) - 6)) AS i FROM docs WHERE len(words) > 8)
), twice AS (
  SELECT id, i FROM windows QUALIFY count(*) OVER (PARTITION BY id, run) > 1
), repeated AS (
  SELECT id, count(DISTINCT i + k) AS n FROM twice, range(8) t(k) GROUP BY id
), base AS (
  SELECT d.id, doc_id, len(words)::BIGINT AS n_words, coalesce(length(array_to_string(words, '')), 0)::BIGINT AS word_chars,
    coalesce(len(regexp_extract_all(text, '[#*$%&|<>]')), 0)::BIGINT AS n_symbols,
    coalesce(len(filled) - len(list_distinct(filled)), 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS filled FROM docs) d
  LEFT JOIN repeated r ON r.id = d.id
), letters AS (
  SELECT id, ch, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(text, '(?s).')) AS ch FROM docs) GROUP BY ALL
), kinds AS (
  SELECT ch, CASE WHEN ch BETWEEN 'a' AND 'z' THEN 0 WHEN unicode(ch) > 65535 THEN 2 WHEN regexp_matches(ch, '\p{{Lu}}') THEN 1
    WHEN regexp_matches(ch, '[\p{{Nd}}\x{{B2}}\x{{B3}}\x{{B9}}]') THEN 3 WHEN regexp_matches(ch, '[\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]') THEN 4
    WHEN regexp_matches(ch, '[.,;:\x27"?-]') THEN 5 WHEN NOT regexp_matches(ch, '\p{{L}}') AND unicode(ch) < 8448 THEN 6 ELSE 2 END AS kind
  FROM (SELECT DISTINCT ch FROM letters)
), counted AS (
  SELECT id, kind, sum(n) AS n FROM letters JOIN kinds USING (ch) GROUP BY ALL
), sized AS (
  SELECT id, sum(n) AS chars FROM counted GROUP BY id
), class_refs AS (
  SELECT lang, kind, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q
  FROM docs JOIN counted USING (id) WHERE lang IS NOT NULL GROUP BY lang, kind
), class_grid AS (
  SELECT s.id, l.lang, coalesce(c.n / chars, 0) AS p, coalesce(r.q, 0) AS q
  FROM sized s CROSS JOIN (SELECT DISTINCT lang FROM class_refs) l CROSS JOIN range(7) k(kind)
  LEFT JOIN counted c ON c.id = s.id AND c.kind = k.kind LEFT JOIN class_refs r ON r.lang = l.lang AND r.kind = k.kind
), tokens AS (
  SELECT id, word, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(lower(text), '{WORD}')) AS word FROM docs) GROUP BY ALL
), lang_words AS (
  SELECT lang, word, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang) AS all_n
  FROM docs JOIN tokens USING (id) WHERE lang IS NOT NULL GROUP BY lang, word
), common AS (
  SELECT lang, word, n / all_n AS q FROM lang_words QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= 50
), word_grid AS (
  SELECT b.id, c.lang, coalesce(t.n / b.n_words, 0) AS p, q
  FROM base b CROSS JOIN common c LEFT JOIN tokens t ON t.id = b.id AND t.word = c.word WHERE b.n_words >= 50
  UNION ALL
  SELECT b.id, c.lang, greatest(0, 1 - sum(coalesce(t.n / b.n_words, 0))), greatest(0, 1 - sum(q))
  FROM base b CROSS JOIN common c LEFT JOIN tokens t ON t.id = b.id AND t.word = c.word WHERE b.n_words >= 50 GROUP BY ALL
), class_far AS (
  SELECT id, min(d) AS d FROM (
    SELECT id, lang, sqrt(least(1, greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END
      + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2))) AS d FROM class_grid GROUP BY ALL) GROUP BY id
), word_far AS (
  SELECT id, min(d) AS d FROM (
    SELECT id, lang, sqrt(least(1, greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END
      + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2))) AS d FROM word_grid GROUP BY ALL) GROUP BY id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(class_distance > 0.3, FALSE) AND NOT coalesce(word_distance > 0.45, FALSE) AS kept,
  round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance
FROM (
  SELECT b.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    CASE WHEN s.chars >= 100 THEN c.d END AS class_distance, w.d AS word_distance
  FROM base b LEFT JOIN sized s USING (id) LEFT JOIN class_far c USING (id) LEFT JOIN word_far w USING (id))
"""

_PHRASES = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words
  FROM (SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), grams AS (
  SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM pieces, range(1, 6) t(k))
), counts AS (
  SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, sum(f) AS n FROM counts WHERE k = 1 GROUP BY lang
), frequent AS (
  SELECT * FROM counts WHERE f >= 100
), free AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS words FROM frequent c WHERE k > 1 AND NOT EXISTS (
    FROM frequent x WHERE x.lang = c.lang AND x.k > c.k AND contains(' ' || x.phrase || ' ', ' ' || c.phrase || ' ') AND 100 * x.f >= 100 * c.f)
), cuts AS (
  SELECT f.lang, f.phrase, a, x.f AS l, y.f AS r, n, cut, (1000 * a * n) // (x.f * y.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM free) f
  JOIN frequent x ON x.lang = f.lang AND x.phrase = array_to_string(words[:cut], ' ')
  JOIN frequent y ON y.lang = f.lang AND y.phrase = array_to_string(words[cut + 1:], ' ')
  JOIN totals t ON t.lang = f.lang
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase,
  a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM best QUALIFY rank <= 2000
"""

_AUDIT = r"""
WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
), terms AS (
  SELECT lang, term, count(DISTINCT id) AS docs, count(*)::HUGEINT AS n
  FROM (SELECT id, lang, unnest(words) AS term FROM docs) GROUP BY ALL
), kept AS (
  SELECT * FROM terms WHERE docs >= 10
), sizes AS (
  SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang
), counts AS (
  SELECT lang, source, term, count(*)::HUGEINT AS n
  FROM (SELECT lang, source, unnest(words) AS term FROM docs) SEMI JOIN kept USING (lang, term) GROUP BY ALL
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS lang_n, v, s.total AS lang_total,
    sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total
  FROM groups g JOIN kept k USING (lang) JOIN sizes s USING (lang)
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), shares AS (
  SELECT lang, source, term, n, (1 + (1000000000 * (n + 2)) // (total + 2 * v))::HUGEINT AS p,
    (1 + (1000000000 * (lang_n + 2)) // (lang_total + 2 * v))::HUGEINT AS q
  FROM dense
), found AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(s.value, 0) AS value
  FROM groups g JOIN groups h ON h.lang = g.lang AND h.source <> g.source LEFT JOIN (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  ) s ON s.lang = g.lang AND s.source = g.source AND s.item = h.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value,
  (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)))::INT AS rank
FROM found QUALIFY part = 'pair' OR rank <= 10
"""

_REPEATS = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce(regexp_extract_all(text, '{WORD}'), []) AS words FROM documents
), windows AS (
  SELECT id, doc_id, i, array_to_string(words[i:i + 49], ' ') AS body
  FROM (SELECT id, doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM docs)
), judged AS (
  SELECT id, doc_id, i, min(doc_id) OVER (PARTITION BY body) AS least FROM windows
), gone AS (
  SELECT id, list(DISTINCT i + k) AS places FROM judged, range(50) t(k) WHERE doc_id > least GROUP BY id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(len(places), 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN places IS NULL THEN words ELSE
    list_transform(list_filter(list_zip(words, range(1, len(words) + 1)), lambda x: NOT list_contains(places, x[2])), lambda x: x[1]) END, ' '), '')) AS kept_sha256
FROM docs LEFT JOIN gone USING (id)
"""

ORACLE_SQL = {
    "op11_collocations": _PHRASES,
    "op12_source_divergence": _AUDIT,
    "op13_substring_dedup": _REPEATS,
    "op9_quality_rules": _RULES,
    "op3_sharding": _SHARDS,
    "op6_near_duplicates": _NEAR,
}
