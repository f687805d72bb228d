"""The same results in SQL, for those operators that SQL can express."""

OP6_EXACT_DEDUP = r"""
WITH hashed AS (
  SELECT doc_id,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
), ranked AS (
  SELECT *, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
         row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) AS place
  FROM hashed WINDOW same AS (PARTITION BY text_sha256)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM ranked
"""

# CRC-32 bit by bit, over the digits of the id.
OP11_PERIODIC_RUNS = r"""
WITH hashed AS (
  SELECT doc_id,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         xor(list_reduce(list_prepend(4294967295::BIGINT,
               list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
             lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)),
               lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))),
           4294967295::BIGINT) AS h
  FROM documents
), placed AS (
  SELECT doc_id, words, h, len(words) AS n,
         CASE WHEN len(words) > 0 THEN (h // 10) % len(words) END AS a FROM hashed
), word AS (
  SELECT doc_id, i,
         words[1 + CASE WHEN h % 10 = 0 AND i >= a
                   THEN a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) ELSE i END] AS w
  FROM (SELECT *, unnest(range(n)) AS i FROM placed)
), equal AS (
  SELECT doc_id, x.i, y.i - x.i AS q FROM word x JOIN word y USING (doc_id, w) WHERE y.i > x.i
), stretch AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM equal)
  GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(12, 2 * q)
), run AS (
  SELECT doc_id, start, length, min(q) AS period FROM stretch GROUP BY doc_id, start, length
), runs AS (
  SELECT doc_id, count(*) AS n_runs,
         arg_max(struct_pack(s := start, l := length, p := period),
                 struct_pack(l := length, s := -start, p := -period)) AS best,
         string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period)
           AS lines
  FROM run GROUP BY doc_id
), kept AS (
  SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS collapsed FROM word
  WHERE NOT EXISTS (SELECT 1 FROM run WHERE run.doc_id = word.doc_id
                    AND i >= start + period AND i < start + length)
  GROUP BY doc_id
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length,
       best.p AS period, 1000 * best.l // best.p AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256,
       sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM documents LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP13_COLLOCATIONS = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents
), word AS (
  SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS words FROM piece
), gram AS (
  SELECT lang, k, words[i:i + k - 1] AS g
  FROM (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM word), range(1, 6) t(k)
  WHERE i + k - 1 <= len(words)
), total AS (
  SELECT lang, count(*) AS n FROM gram WHERE k = 1 GROUP BY lang
), f AS (
  SELECT lang, k, g, count(*) AS f FROM gram GROUP BY lang, k, g HAVING count(*) >= 100
), inner_ AS (
  SELECT lang, unnest([g[1:k - 1], g[2:k]]) AS g, f FROM f WHERE k > 2
), candidate AS (
  SELECT lang, k, g, f AS a FROM f
  WHERE k > 1 AND NOT EXISTS (
    SELECT 1 FROM inner_ WHERE inner_.lang = f.lang AND inner_.g = f.g AND inner_.f >= f.f)
), cut AS (
  SELECT lang, g, a, n, j, l.f AS l, r.f AS r,
         (1000::HUGEINT * a * n // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM candidate) c
  JOIN total USING (lang)
  JOIN (SELECT lang, g AS head, f FROM f) l USING (lang)
  JOIN (SELECT lang, g AS tail, f FROM f) r USING (lang)
  WHERE head = g[1:j] AND tail = g[j + 1:]
), best AS (
  SELECT lang, array_to_string(g, ' ') AS phrase, a, n,
         arg_min(struct_pack(l := l, r := r, score := score),
                 struct_pack(s := score, j := j)) AS b
  FROM cut GROUP BY lang, g, a, n
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY b.score DESC, a DESC,
                               encode(phrase)) AS rank FROM best
)
SELECT lang, rank, phrase, a, b.l AS l, b.r AS r, n, b.score AS score FROM ranked
WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op6_exact_dedup": OP6_EXACT_DEDUP,
        "op11_periodic_runs": OP11_PERIODIC_RUNS,
        "op13_collocations": OP13_COLLOCATIONS,
    }
