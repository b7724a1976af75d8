"""DuckDB SQL of what SQL can say of the operators: whole results where it can say all, base columns elsewhere."""

from __future__ import annotations

#: doc_id, n_assign, n_access, n_hex, base_sha256. Patterns give no offsets here, so what stands between matches is measured.
SECRET_BASE = r"""
WITH texts AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
patterns AS (SELECT * FROM (VALUES
  ('assign', 0, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+'),
  ('access', 1, 'AKIA[A-Z0-9]+'),
  ('hex', 2, '[0-9a-f]+')) AS p(kind, place, pattern)),
found AS (SELECT row, kind, place, string_split_regex(t, pattern) AS gaps, regexp_extract_all(t, pattern) AS hits FROM texts, patterns),
each AS (SELECT row, kind, place, unnest(hits) AS hit, unnest(gaps[:len(hits)]) AS gap, generate_subscripts(hits, 1) AS k FROM found),
placed AS (SELECT row, kind, place, hit, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY row, kind ORDER BY k) AS BIGINT) AS stop FROM each),
spans AS (SELECT row, kind, place, stop - length(hit) AS start, stop FROM placed
  WHERE CASE kind WHEN 'assign' THEN length(regexp_replace(hit, '^[^:=]*[:=]\x20*["'']?', '')) >= 8 WHEN 'access' THEN length(hit) >= 16 ELSE length(hit) >= 32 END),
said AS (SELECT row, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) AS listed FROM spans GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(listed, '')) AS base_sha256
FROM texts LEFT JOIN said USING (row)
"""

#: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.
QUALITY_BASE = r"""
WITH texts AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
words AS (SELECT row, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS w, generate_subscripts(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), 1) AS k FROM texts),
threes AS (SELECT row, k, w AS a, lead(w, 1) OVER o AS b, lead(w, 2) OVER o AS c FROM words WINDOW o AS (PARTITION BY row ORDER BY k)),
twice AS (SELECT row, k FROM (SELECT row, k, count(*) OVER (PARTITION BY row, a, b, c) AS n FROM threes WHERE c IS NOT NULL) WHERE n > 1),
covered AS (SELECT row, count(DISTINCT k + d) AS n FROM twice, range(3) AS r(d) GROUP BY row),
lines AS (SELECT row, unnest(string_split(t, chr(10))) AS line FROM texts),
dup AS (SELECT row, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row),
sums AS (SELECT row, count(*) AS n, CAST(sum(length(w)) AS BIGINT) AS chars FROM words GROUP BY row),
made AS (SELECT doc_id, coalesce(sums.n, 0) AS n_words, coalesce(chars, 0) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(dup.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words FROM texts LEFT JOIN sums USING (row) LEFT JOIN dup USING (row) LEFT JOIN covered USING (row))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM made
"""

#: The whole result of op2_substring_dedup.
SUBSTRING_DEDUP = r"""
WITH texts AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT row, doc_id, ws, unnest(range(1, len(ws) - 48)) AS k FROM texts),
windows AS (SELECT row, doc_id, k, md5(array_to_string(ws[k:k + 49], ' ')) AS w FROM starts),
firsts AS (SELECT w, min(doc_id) AS first FROM windows GROUP BY w),
again AS (SELECT DISTINCT row, k FROM windows JOIN firsts USING (w) WHERE doc_id > first),
words AS (SELECT row, unnest(ws) AS word, generate_subscripts(ws, 1) AS k FROM texts),
marked AS (SELECT row, k, word, coalesce(max(again.k) OVER (PARTITION BY row ORDER BY k) > k - 50, FALSE) AS gone FROM words LEFT JOIN again USING (row, k)),
sums AS (SELECT row, count(*) FILTER (gone) AS n, string_agg(word, ' ' ORDER BY k) FILTER (NOT gone) AS kept FROM marked GROUP BY row)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM texts LEFT JOIN sums USING (row)
"""

#: The three discounts from a table of counts of counts, for a group of which the CTE {0} has the counts in c.
_DISCOUNTS = r"""
(SELECT [least(greatest(1 - 2 * y * r1, 0.1), 0.9), least(greatest(2 - 3 * y * r2, 0.1), 1.9), least(greatest(3 - 4 * y * r3, 0.1), 2.9)] AS d FROM (
  SELECT CASE WHEN n1 > 0 AND n2 > 0 THEN n1 / (n1 + 2 * n2) ELSE 0.5::DOUBLE END AS y, CASE WHEN n1 > 0 AND n2 > 0 THEN n2 / n1 ELSE 0.5::DOUBLE END AS r1,
    CASE WHEN n2 > 0 AND n3 > 0 THEN n3 / n2 ELSE 0.5::DOUBLE END AS r2, CASE WHEN n3 > 0 AND n4 > 0 THEN n4 / n3 ELSE 0.5::DOUBLE END AS r3
  FROM (SELECT (count(*) FILTER (c = 1))::DOUBLE AS n1, (count(*) FILTER (c = 2))::DOUBLE AS n2, (count(*) FILTER (c = 3))::DOUBLE AS n3, (count(*) FILTER (c = 4))::DOUBLE AS n4 FROM {0})))
"""

#: The whole result of op6_language_model.
LANGUAGE_MODEL = (
    r"""
WITH crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS steps FROM range(256) AS r(i)),
texts AS (SELECT row_number() OVER () AS row, doc_id,
  coalesce(xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))), lambda c, b: xor(steps[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 5 = 1, FALSE) AS held_out,
  list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), chr(10)) AS ts FROM documents, crc),
tokens AS (SELECT row, held_out, unnest(ts) AS b, unnest(list_prepend(chr(10), ts[:-2])) AS a FROM texts),
one AS (SELECT b, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY b),
size AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM one),
two AS (SELECT a, b, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY a, b),
places AS (SELECT b, count(*) AS c FROM two GROUP BY b),
cut AS """
    + _DISCOUNTS.format("two")
    + r""", low_cut AS """
    + _DISCOUNTS.format("places")
    + r""",
low AS (SELECT sum(low_cut.d[least(c, 3)]) / sum(c) AS rest, sum(c) AS total FROM places, low_cut),
after AS (SELECT a, sum(c) AS total, sum(cut.d[least(c, 3)]) AS taken FROM two, cut GROUP BY a),
each AS (SELECT row, coalesce(one.c, 0) AS c, after.total AS total, after.taken AS taken, coalesce(two.c - cut.d[least(two.c, 3)], 0) AS pair,
  coalesce((places.c - low_cut.d[least(places.c, 3)]) / low.total, 0) + coalesce(low.rest, 1) / (size.v + 1) AS under
  FROM tokens t CROSS JOIN size CROSS JOIN cut CROSS JOIN low_cut CROSS JOIN low LEFT JOIN one ON one.b = t.b LEFT JOIN places ON places.b = t.b LEFT JOIN after ON after.a = t.a LEFT JOIN two ON two.a = t.a AND two.b = t.b),
sums AS (SELECT row, count(*) AS n_tokens, count(*) FILTER (c > 0) AS n_known, sum(log10((c + 0.5) / (size.n + 0.5 * (size.v + 1)))) AS base_score,
  sum(log10(CASE WHEN total IS NULL THEN under ELSE pair / total + taken / total * under END)) AS score FROM each, size GROUP BY row)
SELECT doc_id, held_out, n_tokens, n_known, size.n AS train_tokens, round(base_score, 6) AS base_score, round(score, 6) AS score FROM texts JOIN sums USING (row), size
"""
)

#: The whole result of op13_phrase_collocations.
PHRASE_COLLOCATIONS = r"""
WITH texts AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
places AS (SELECT lang, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM lists, range(1, 5) AS sizes(size)),
f AS (SELECT lang, size, array_to_string(ws[i:i + size - 1], ' ') AS phrase, count(*) AS a FROM places GROUP BY ALL),
words AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
candidates AS (SELECT lang, size, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE size > 1 AND a >= 30),
cuts AS (SELECT *, unnest(range(1, size)) AS k FROM candidates),
scores AS (SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, CAST(2000000::HUGEINT * c.a // (x.a + y.a) AS BIGINT) AS score FROM cuts c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[k + 1:], ' ')),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
sizes_within AS (SELECT lang, a, ws, size, unnest(range(2, size)) AS part FROM candidates),
inner_places AS (SELECT lang, a, ws, part, unnest(range(1, size - part + 2)) AS i FROM sizes_within),
holders AS (SELECT lang, array_to_string(ws[i:i + part - 1], ' ') AS phrase, max(a) AS longest FROM inner_places GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN holders USING (lang, phrase) WHERE longest IS NULL OR 100::HUGEINT * longest < 80::HUGEINT * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN words USING (lang) QUALIFY rank <= 2000
"""


def _vector_codes(rounds: int = 4) -> str:
    assign = """a{k} AS MATERIALIZED (SELECT row, p, min(CAST(list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS BIGINT) * 256 + e) AS found FROM parts JOIN b{k} USING (p) GROUP BY ALL)"""
    move = """s{k} AS (SELECT p, found % 256 AS e, i, floor(sum(v) / count(*)) AS v FROM (SELECT row, p, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM parts) JOIN a{k} USING (row, p) GROUP BY ALL),
b{n} AS MATERIALIZED (SELECT p, e, coalesce(m.c, b{k}.c) AS c FROM b{k} LEFT JOIN (SELECT p, e, list(v ORDER BY i) AS c FROM s{k} GROUP BY ALL) m USING (p, e))"""
    steps = ",\n".join(f"{assign.format(k=k)},\n{move.format(k=k, n=k + 1)}" for k in range(rounds))
    return f"""
WITH whole AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS row, * FROM whole),
parts AS MATERIALIZED (SELECT row, p, v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4] AS x FROM kept, range(4) AS r(p)),
b0 AS (SELECT p, row - 1 AS e, x AS c FROM parts WHERE row <= 256),
{steps},
{assign.format(k=rounds)},
coded AS (SELECT row, string_agg(printf('%02x', found % 256), '' ORDER BY p) AS code, CAST(sum(found // 256) AS BIGINT) AS error FROM a{rounds} GROUP BY row),
books AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: CAST(x AS BIGINT)), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded USING (row), books
"""


#: The whole result of op11_vector_codes; of equal distances the least of distance and index together is the lower index.
VECTOR_CODES = _vector_codes()
