"""DuckDB SQL of the registered queries that SQL can state at a bearable cost."""

# The block join comes down to this: a source's documents in shuffled order, pass after
# pass, up to the source's quota. Sources that are stopped at three times their size are
# those whose size per weight is smallest, so a sort finds them.
OP3 = r"""
WITH sized AS (
  SELECT doc_id, text,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS turn,
         md5(coalesce(text, '')) AS tie
  FROM documents),
sources AS (SELECT key, CAST(sum(size) AS BIGINT) AS n FROM sized GROUP BY key),
weighted AS (SELECT key, n, CAST((row_number() OVER (ORDER BY key) - 1) % 3 + 1 AS DOUBLE) AS w FROM sources),
filled AS (SELECT * FROM weighted WHERE n > 0),
ordered AS (
  SELECT key, n, w,
         (SELECT sum(n) FROM filled) AS total,
         coalesce(sum(3 * n) OVER (ORDER BY n / w, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(w) OVER (ORDER BY n / w, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_from
  FROM filled),
level AS (
  SELECT CAST(total - before AS DOUBLE) AS rest, w_from AS w_open, n / w AS least FROM ordered
  WHERE CAST(total - before AS DOUBLE) * w / w_from <= 3 * n ORDER BY n / w, key LIMIT 1),
target AS (
  SELECT wt.key, wt.n,
         CASE WHEN wt.n = 0 THEN CAST(0 AS DOUBLE)
              WHEN l.rest IS NULL OR wt.n / wt.w < l.least THEN CAST(3 * wt.n AS DOUBLE)
              ELSE l.rest * wt.w / l.w_open END AS target
  FROM weighted wt LEFT JOIN level l ON true),
placed AS (
  SELECT s.doc_id, s.size, t.n, t.target, least(CAST(floor(t.target + 0.5) AS BIGINT), 3 * t.n) AS quota,
         coalesce(CAST(sum(s.size) OVER (PARTITION BY s.key ORDER BY s.turn, s.tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS begin_at
  FROM sized s JOIN target t ON s.key = t.key)
SELECT doc_id, CAST(size AS BIGINT) AS size, n AS source_size, target,
       CASE WHEN n = 0 THEN CAST(0 AS BIGINT)
            ELSE CAST(size * (quota // n) + greatest(0, least(size, quota % n - begin_at)) AS BIGINT) END AS taken
FROM placed
"""

OP6 = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

# Terms are counted straight from the texts; every pair of sources is compared term by term.
OP11 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source
  FROM documents),
words AS (
  SELECT doc, lang, source,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT doc) >= 10),
vocabulary AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term),
sizes AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source),
groups AS (SELECT DISTINCT lang, source FROM docs),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         CAST(1 + 1000000000 * (coalesce(c.n, 0) + 2)::HUGEINT // (coalesce(s.total, 0) + 2 * v.v) AS BIGINT) AS p,
         CAST(1 + 1000000000 * (k.n + 2)::HUGEINT // (v.total + 2 * v.v) AS BIGINT) AS q
  FROM groups g JOIN vocabulary v USING (lang) JOIN kept k USING (lang)
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN sizes s ON s.lang = g.lang AND s.source = g.source),
gaps AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce(g.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN gaps g ON g.lang = a.lang AND g.source = a.source AND g.item = b.source),
terms AS (
  SELECT lang, source, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, 'pair' AS part, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
  UNION ALL BY NAME
  SELECT *, 'term' AS part, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM terms)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""

# Four rounds over lists of whole numbers; distances are inner products of differences.
_PARTS = """
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
numbered AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS at_row FROM kept),
parts AS (
  SELECT at_row, part, v[part * (len(v) // 4) + 1 : (part + 1) * (len(v) // 4)] AS x
  FROM numbered, (SELECT unnest(range(4)) AS part)),
book0 AS (SELECT part, at_row AS entry, x AS e FROM parts WHERE at_row < 256)"""
_ROUND = """,
near{n} AS (
  SELECT at_row, part, unnest(arg_min(entry, (d, entry), 1)) AS entry, min(d) AS d
  FROM (SELECT p.at_row, p.part, b.entry,
               CAST(list_sum(list_transform(list_zip(p.x, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
        FROM parts p JOIN book{n} b USING (part)) GROUP BY at_row, part)"""
_MOVE = """,
means{n} AS (
  SELECT part, entry, list(CAST(floor_sum AS BIGINT) ORDER BY place) AS e
  FROM (SELECT part, entry, place, CASE WHEN s >= 0 THEN s // c ELSE -((c - 1 - s) // c) END AS floor_sum
        FROM (SELECT a.part, a.entry, i.place, sum(p.x[i.place]) AS s, count(*) AS c
              FROM near{n} a JOIN parts p USING (at_row, part), (SELECT unnest(range(1, (SELECT max(len(x)) FROM parts) + 1)) AS place) i
              GROUP BY ALL))
  GROUP BY part, entry),
book{m} AS (SELECT b.part, b.entry, coalesce(m.e, b.e) AS e FROM book{n} b LEFT JOIN means{n} m USING (part, entry))"""
_CODES = """
SELECT n.vec_id, string_agg(printf('%02x', CAST(a.entry AS BIGINT)), '' ORDER BY a.part) AS code, CAST(sum(a.d) AS BIGINT) AS error,
       CAST(sum(sum(a.d)) OVER (PARTITION BY n.label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY part, entry)) FROM book4) AS codebooks_sha256
FROM near4 a JOIN numbered n USING (at_row) GROUP BY n.at_row, n.vec_id, n.label
"""
OP13 = _PARTS + "".join(_ROUND.format(n=n) + _MOVE.format(n=n, m=n + 1) for n in range(4)) + _ROUND.format(n=4) + _CODES

LLM_SQL: dict[str, str] = {"op3_mixing": OP3, "op6_topk_search": OP6, "op11_source_divergence": OP11, "op13_vector_codes": OP13}
