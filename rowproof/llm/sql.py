"""SQL that queries of this package must equal, where SQL can express them."""

_LETTERS = "(VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16))"

INTERACTIONS = rf"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), worded AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM texts
), least AS (
  SELECT t, min(doc_id) AS least_id FROM texts GROUP BY t
), marks AS (
  SELECT doc_id AS id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS bad FROM labels
  WHERE doc_id IS NOT NULL GROUP BY doc_id
), masked AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
    (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > least_id, false)::INT AS mask
  FROM worded JOIN least USING (t) LEFT JOIN marks ON doc_id = id
), counted AS (
  SELECT part, mask, good, bad, count(*) AS n FROM masked GROUP BY ALL
), letters(l, b) AS {_LETTERS}, orders AS (
  SELECT p.l || q.l || r.l || s.l || u.l AS filter_order, [p.b, q.b, r.b, s.b, u.b] AS bits
  FROM letters p, letters q, letters r, letters s, letters u
  WHERE p.b + q.b + r.b + s.b + u.b = 31 AND len(list_distinct([p.b, q.b, r.b, s.b, u.b])) = 5
), steps AS (
  SELECT filter_order, k AS step, bits[k] AS own, coalesce(list_sum(bits[1:k - 1]), 0)::INT AS earlier
  FROM orders, range(1, 6) AS s(k)
), figures AS (
  SELECT part, filter_order, step, own,
    sum(n * ((mask & (earlier | own)) = 0)::INT) AS kept,
    sum(n * ((mask & own) > 0 AND (mask & earlier) = 0)::INT) AS removed,
    sum(n * ((mask & own) > 0 AND (mask & earlier) > 0)::INT) AS redundant,
    sum(n * (mask = own)::INT) AS unique_fails,
    sum(n * good * ((mask & own) > 0 AND (mask & earlier) = 0)::INT) AS good_lost,
    sum(n * bad * ((mask & own) > 0 AND (mask & earlier) = 0)::INT) AS toxic_lost
  FROM counted, steps GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM figures
"""

COLLOCATIONS = r"""
WITH cut AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang,
    regexp_split_to_array(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[.,;:!?\x0A-\x0D]', chr(10), 'g'), chr(10)) AS pieces
  FROM documents
), pieces AS (
  SELECT lang, unnest(pieces) AS words FROM cut
), worded AS (
  SELECT lang, row_number() OVER () AS piece, regexp_extract_all(words, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
  SELECT lang, sum(len(w))::HUGEINT AS n FROM worded GROUP BY lang
), runs AS (
  SELECT lang, w1, lead(w1, 1) OVER x AS w2, lead(w1, 2) OVER x AS w3, lead(w1, 3) OVER x AS w4, lead(w1, 4) OVER x AS w5
  FROM (SELECT lang, piece, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM worded) WINDOW x AS (PARTITION BY piece ORDER BY i)
), grams AS (
  SELECT lang, [w1] AS p, count(*)::HUGEINT AS a FROM runs GROUP BY ALL HAVING a >= 100 UNION ALL
  SELECT lang, [w1, w2], count(*) AS a FROM runs WHERE w2 IS NOT NULL GROUP BY ALL HAVING a >= 100 UNION ALL
  SELECT lang, [w1, w2, w3], count(*) AS a FROM runs WHERE w3 IS NOT NULL GROUP BY ALL HAVING a >= 100 UNION ALL
  SELECT lang, [w1, w2, w3, w4], count(*) AS a FROM runs WHERE w4 IS NOT NULL GROUP BY ALL HAVING a >= 100 UNION ALL
  SELECT lang, [w1, w2, w3, w4, w5], count(*) AS a FROM runs WHERE w5 IS NOT NULL GROUP BY ALL HAVING a >= 100
), cuts AS (
  SELECT g.lang, g.p, g.a, n, k, l.a AS l, r.a AS r, (1000 * g.a * n) // (l.a * r.a) AS score
  FROM grams g JOIN totals t ON t.lang = g.lang, range(1, 5) AS s(k)
  JOIN grams l ON l.lang = g.lang AND l.p = g.p[1:k] JOIN grams r ON r.lang = g.lang AND r.p = g.p[k + 1:]
  WHERE k < len(g.p)
), weakest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1
), inner_ones AS (
  SELECT lang, p[i:j] AS p, max(a) AS longer FROM grams, range(1, 5) AS s(i), range(2, 6) AS u(j)
  WHERE j > i AND j <= len(p) AND j - i + 1 < len(p) GROUP BY ALL
), left_over AS (
  SELECT w.*, array_to_string(w.p, ' ') AS phrase FROM weakest w LEFT JOIN inner_ones i ON i.lang = w.lang AND i.p = w.p
  WHERE longer IS NULL OR 100 * longer < 100 * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l,
  r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM left_over QUALIFY rank <= 2000
"""
