"""DuckDB SQL for the queries that SQL can express."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP8 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines
        WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
win AS (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM again, range(0, 8) AS t(k) GROUP BY rid),
m AS (SELECT doc_id, text, w, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_lines, 0)::BIGINT AS n_lines,
        coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
        len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS same
      FROM d LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (10 * n_symbols > n_words) AND NOT (word_chars < 2 * n_words OR word_chars > 20 * n_words)
  AND NOT (n_dup_lines >= 3 AND 10 * n_dup_lines > 4 * n_lines)
  AND NOT (5 * length(regexp_replace(text, '[^!]', '', 'g')) > 2 * n_words) AND NOT (2 * same > n_words) AS kept
FROM b"""

OP4 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t, len({_WORDS})::BIGINT AS size FROM documents),
k AS (SELECT *, md5(t) AS fp,
        -ln((('0x' || substr(md5('11|' || coalesce(doc_id::VARCHAR, '-') || '|' || md5(t)), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0)
        / greatest(0.1, 1.0 - (length(t) - length(regexp_replace(t, '[#*$%&|<>!]', '', 'g')))::DOUBLE / greatest(length(t), 1)) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, ([3, 1, 2])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight, 2 * source_size AS cap FROM s),
-- the level: the largest at which the sources below their ceilings share what is left
l AS (SELECT *, 1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0) AS lft, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS wl
      FROM r WINDOW o AS (ORDER BY cap::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, cap * wl <= lft * weight AS fl FROM l),
g AS (SELECT lft::DOUBLE AS lft, wl::DOUBLE AS wl FROM f WHERE NOT fl ORDER BY cap::DOUBLE / weight, source ASC NULLS LAST LIMIT 1),
t AS (SELECT f.source, source_size, CASE WHEN fl THEN cap::DOUBLE ELSE (SELECT lft FROM g) * weight / (SELECT wl FROM g) END AS target FROM f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN least(2, floor(target / source_size)) ELSE 0 END::BIGINT AS epochs FROM t),
w AS (SELECT *, floor(target - epochs * source_size + 0.5)::BIGINT AS owed FROM e),
p AS (SELECT k.*, w.source_size, w.target, w.epochs, w.owed,
        coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, fp, rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM k JOIN w ON k.source IS NOT DISTINCT FROM w.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, owed - before)))::BIGINT AS taken FROM p"""

OP7 = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.rid, a.vec_id AS query_id, b.vec_id, list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.rid <> b.rid)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20"""

OP5 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT rid, doc_id, i, array_to_string(w[i:i + 49], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
dup AS (SELECT rid, i FROM (SELECT rid, doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least FROM win) WHERE least < doc_id),
-- a word is covered if a duplicate window starts in the 50 places up to it
gone AS (SELECT DISTINCT rid, i + k AS p FROM dup, range(0, 50) AS t(k)),
n AS (SELECT rid, count(*) AS n FROM gone GROUP BY rid),
words AS (SELECT rid, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d SEMI JOIN n USING (rid)),
kept AS (SELECT rid, string_agg(x, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (rid, p) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
  sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ') ELSE coalesce(t, '') END) AS kept_sha256
FROM d LEFT JOIN n USING (rid) LEFT JOIN kept USING (rid)"""

OP9 = rf"""
WITH dt AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
tt AS (SELECT row_number() OVER () AS rid, {_WORDS} AS w FROM benchmark),
dw AS (SELECT rid, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM dt),
tw AS (SELECT rid, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM tt),
size AS (SELECT count(*)::BIGINT AS s FROM (SELECT x FROM dw UNION SELECT x FROM tw)),
dp AS (SELECT rid, coalesce(lag(x) OVER (PARTITION BY rid ORDER BY i), ' ') AS u, x AS v FROM dw),
tp AS (SELECT rid, coalesce(lag(x) OVER (PARTITION BY rid ORDER BY i), ' ') AS u, x AS v FROM tw),
b AS (SELECT u, v, count(*)::BIGINT AS n FROM dp GROUP BY u, v), t AS (SELECT u, v, count(*)::BIGINT AS n FROM tp GROUP BY u, v),
p AS (SELECT coalesce(b.u, t.u) AS u, coalesce(b.v, t.v) AS v, coalesce(b.n, 0) AS b, coalesce(t.n, 0) AS t FROM b FULL JOIN t ON b.u = t.u AND b.v = t.v),
q AS (SELECT *, sum(b) OVER (PARTITION BY v) AS bv, sum(t) OVER (PARTITION BY v) AS tv, sum(b) OVER (PARTITION BY u) AS bu, sum(t) OVER (PARTITION BY u) AS tu,
        sum(b) OVER () AS bn, sum(t) OVER () AS tn FROM p),
l AS (SELECT u, v, round((ln((b + 8.0::DOUBLE * ((bv + 1.0::DOUBLE) / (bn + s + 1)::DOUBLE)) / (bu + 8.0::DOUBLE))
        - ln((t + 8.0::DOUBLE * ((tv + 1.0::DOUBLE) / (tn + s + 1)::DOUBLE)) / (tu + 8.0::DOUBLE))) * 1e6::DOUBLE)::BIGINT AS loss FROM q, size),
s AS (SELECT rid, count(*)::BIGINT AS n, sum(loss)::BIGINT AS loss FROM dp JOIN l USING (u, v) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, CASE WHEN n IS NULL THEN 0.0::DOUBLE ELSE loss::DOUBLE / (1e6::DOUBLE * n) END AS score FROM dt LEFT JOIN s USING (rid)"""
