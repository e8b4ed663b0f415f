"""SQL of the results of operators 11 to 13, each by a plainer way than the operator's own."""

from __future__ import annotations

# A row per state in the working table: the cheapest way there, as (cost, letters, lines), row by row.
CONVERSATION_AUDIT = r"""
WITH RECURSIVE keyed AS (
  SELECT row_number() OVER () AS rid, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
  FROM conversations
), struck AS (
  SELECT *, xor(list_reduce(
      list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1))::BIGINT),
      lambda crc, byte: list_reduce(range(8),
        lambda c, n: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(crc, byte)),
      4294967295), 4294967295) % 20 AS kind
  FROM keyed
), damaged AS (
  SELECT rid, conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM struck WHERE kind <> 0
), numbered AS (
  SELECT conv_id, turn, role, text, substr(role, 1, 1) AS initial,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, rid, copy) AS nth,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, rid, copy) AS i
  FROM damaged
), r AS (
  SELECT conv_id, turn, role, text, initial, i, coalesce(
           lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au'), false) AS illegal,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
              WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated'
              ELSE '' END AS fault
  FROM numbered
), inserts(s, t, letters, lines) AS (
  VALUES (0, 0, '', []), (1, 1, '', []), (2, 2, '', []), (3, 3, '', []), (0, 2, 'I', ['user:']), (1, 2, 'I', ['user:']),
         (3, 2, 'I', ['user:']), (2, 3, 'I', ['assistant:']), (0, 3, 'II', ['user:', 'assistant:']),
         (1, 3, 'II', ['user:', 'assistant:'])
), keeps(t, initial, u) AS (
  VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), moves AS (
  SELECT t, letter, CASE letter WHEN 'D' THEN t ELSE CASE t WHEN 2 THEN 3 ELSE 2 END END AS u
  FROM range(4) AS states(t), (VALUES ('D'), ('R')) AS letters(letter)
  UNION ALL SELECT t, 'K' || initial, u FROM keeps
), best AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS s, {'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]} AS way FROM r
  UNION ALL
  SELECT r.conv_id, r.i, m.u::INTEGER, min({
      'cost': b.way.cost + 5 * length(n.letters) + CASE m.letter WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END
              + CASE WHEN r.fault = 'truncated' AND m.letter <> 'D' THEN 5 ELSE 0 END,
      'audit': b.way.audit || n.letters || substr(m.letter, 1, 1),
      'lines': b.way.lines || n.lines::VARCHAR[] || CASE WHEN m.letter = 'D' THEN []::VARCHAR[]
               WHEN m.letter = 'R' THEN [CASE m.u WHEN 2 THEN 'user:' ELSE 'assistant:' END || r.text]
               ELSE [r.role || ':' || r.text] END})
  FROM best b JOIN r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i + 1
  JOIN inserts n ON n.s = b.s JOIN moves m ON m.t = n.t
   AND (m.letter = 'D' OR r.fault NOT IN ('blank', 'duplicate') AND m.letter IN ('R', 'K' || r.initial))
  GROUP BY r.conv_id, r.i, m.u
), counts AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal
  FROM r GROUP BY conv_id
), chosen AS (
  SELECT b.conv_id, min({'cost': b.way.cost + 5 * length(n.letters), 'audit': b.way.audit || n.letters,
                         'lines': b.way.lines || n.lines::VARCHAR[]}) AS way
  FROM best b JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND c.n = b.i
  JOIN inserts n ON n.s = b.s AND n.t IN (0, 3) GROUP BY b.conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(h.way.cost, 0)::BIGINT AS cost, coalesce(h.way.audit, '') AS audit,
       sha256(coalesce(array_to_string(h.way.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN chosen h ON h.conv_id IS NOT DISTINCT FROM o.conv_id
"""

# Every kept term with every group, and every pair of groups over all of them.
SOURCE_DIVERGENCE = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
), w AS (
  SELECT id, lang, source, unnest(words) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 3
), langs AS (
  SELECT lang, count(*) AS kinds, sum(n) AS total FROM kept GROUP BY lang
), groups AS (
  SELECT DISTINCT lang, source FROM d
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term
), counted AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS n_lang, l.kinds, l.total AS total_lang,
         sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN counts c USING (lang, source, term)
), shares AS (
  SELECT lang, source, term, n, (1 + (1000000000::HUGEINT * (n + 1)) // (total + kinds))::BIGINT AS p,
         (1 + (1000000000::HUGEINT * (n_lang + 1)) // (total_lang + kinds))::BIGINT AS q
  FROM counted
), pairs AS (
  SELECT g.lang, g.source, h.source AS item FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
  SELECT lang, source, 'pair' AS part, item, coalesce(value, 0)::BIGINT AS value
  FROM pairs LEFT JOIN sums USING (lang, source, item)
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts
)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""

# Every query with every row.
INNER_PRODUCTS = r"""
WITH v AS (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.id, q.vec_id AS query_id, c.vec_id,
         coalesce(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])), 0)::BIGINT AS score, c.id AS other
  FROM v q JOIN v c ON q.id <> c.id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, vec_id NULLS LAST, other) AS rank FROM scored
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""
