"""The registered queries as plain SQL over the same tables, for checking results."""

from __future__ import annotations

WORD = r"[\p{L}\p{N}_]+"
LONG_WORD = r"[\p{L}\p{N}_]{2,}"
SPACES = r"[\t-\r\x{1C}-\x{20}\x{85}\p{Z}]+"


def norm(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{SPACES}', ' ', 'g'))"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '{WORD}')"


def first_token_type(x: str) -> str:
    first = f"regexp_extract(lower(coalesce({x}, '')), '{WORD}')"
    return f"CASE WHEN {first} IN ('who', 'what', 'when', 'where', 'why', 'how') THEN {first} ELSE 'other' END"


def title_words(x: str) -> str:
    words = f"regexp_extract_all(coalesce({x}, ''), '{WORD}')"
    return f"CAST(len(list_filter({words}, lambda w: regexp_full_match(w, '[A-Z][a-z]+'))) AS BIGINT)"


def number60(digest: str) -> str:
    return f"CAST('0x' || substr({digest}, 1, 15) AS BIGINT)"


def ratio(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0.0)"


# --- Shared table expressions, in dependency order -----------------------------------

QA = """
qa AS (
  SELECT concat(u.conv_id, '_', u.turn) AS question_id, u.conv_id, u.turn,
         u.text AS question, a.text AS answer
  FROM conversations u
  JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user'
)"""

QA_OPENED = QA + """,
qo AS (
  SELECT * REPLACE (
    CASE (conv_id + turn) % 8
      WHEN 0 THEN 'Who ' WHEN 1 THEN 'What ' WHEN 2 THEN 'When ' WHEN 3 THEN 'Where '
      WHEN 4 THEN 'Why ' WHEN 5 THEN 'How ' WHEN 6 THEN 'Is ' ELSE '' END || question AS question)
  FROM qa
)"""


def pair_ctes(qa: str, n: int = 3) -> str:
    return f"""
indexed AS (
  SELECT question_id, question, answer,
         row_number() OVER (ORDER BY md5('42:index:' || question_id), question_id) - 1 AS idx
  FROM {qa}
),
draws AS (
  SELECT question_id, question, idx, draw,
         {number60("md5('42:draw:' || question_id || ':' || draw)")} % ((SELECT count(*) FROM {qa}) - 1) AS r
  FROM indexed, range(1, {n + 1}) AS d(draw)
),
pairs AS MATERIALIZED (
  SELECT 'p_' || md5('42:pair:' || question_id || ':0') AS pair_id, question_id, question, answer AS document,
         1 AS label, 'positive' AS pair_type, question_id AS source_doc_question_id
  FROM {qa}
  UNION ALL
  SELECT 'p_' || md5('42:pair:' || d.question_id || ':' || d.draw), d.question_id, d.question, s.answer,
         0, 'negative', s.question_id
  FROM draws d
  JOIN indexed s ON s.idx = CASE WHEN d.r >= d.idx THEN d.r + 1 ELSE d.r END
)"""


PAIRS = QA_OPENED + "," + pair_ctes("qo")

SPLIT = """
held AS (SELECT count(DISTINCT question_id) AS n, ceil((1.0::DOUBLE - 0.7::DOUBLE) * count(DISTINCT question_id)) AS h FROM pairs),
ranked_q AS (
  SELECT question_id, row_number() OVER (ORDER BY md5('42:split:' || question_id)) AS r
  FROM (SELECT DISTINCT question_id FROM pairs)
),
split_q AS (
  SELECT question_id,
         CASE WHEN r <= n - h THEN 'train' WHEN r <= n - h + floor(0.5 * h) THEN 'validation' ELSE 'test' END AS split
  FROM ranked_q, held
)"""

HASH_SPLIT = """CASE WHEN substr(md5('42:split:' || question_id), 1, 8) < 'b3333333' THEN 'train'
     WHEN substr(md5('42:split:' || question_id), 1, 8) < 'd999999a' THEN 'validation' ELSE 'test' END"""

LEX = f"""
asked_tok AS MATERIALIZED (SELECT question, {tokens('question')} AS q_tok FROM (SELECT DISTINCT question FROM pairs)),
given_tok AS MATERIALIZED (SELECT document, {tokens('document')} AS d_tok FROM (SELECT DISTINCT document FROM pairs)),
tok AS MATERIALIZED (
  SELECT * FROM pairs JOIN asked_tok USING (question) JOIN given_tok USING (document)
),
lex AS (
  SELECT *, CAST(len(list_intersect(list_distinct(q_tok), list_distinct(d_tok))) AS BIGINT) AS token_overlap,
         CAST(len(q_tok) AS BIGINT) AS query_length, CAST(len(d_tok) AS BIGINT) AS document_length,
         {first_token_type('question')} AS question_type
  FROM tok
),
lexical AS MATERIALIZED (
  SELECT *, token_overlap / greatest(query_length, 1)::DOUBLE AS token_overlap_ratio,
         token_overlap / greatest(document_length, 1)::DOUBLE AS normalized_overlap
  FROM lex
)"""


def bm25_ctes(corpus: str) -> str:
    """``corpus``: a query giving distinct normalised documents as ``document``."""
    return f"""
corpus AS MATERIALIZED ({corpus}),
corpus_tok AS MATERIALIZED (SELECT document, {tokens('document')} AS t FROM corpus),
corpus_size AS MATERIALIZED (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM corpus_tok),
term_df AS (
  SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(t)) AS term FROM corpus_tok) GROUP BY term
),
term_raw AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM term_df, corpus_size),
term_idf AS MATERIALIZED (
  SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * mean_raw ELSE raw END AS idf
  FROM term_raw, (SELECT avg(raw) AS mean_raw FROM term_raw)
)"""


BM25_SCORES = f"""
q_terms AS MATERIALIZED (
  SELECT question, term, count(*) AS qn
  FROM (SELECT question, unnest({tokens('question')}) AS term FROM (SELECT DISTINCT question FROM pairs)) GROUP BY ALL
),
d_toks AS MATERIALIZED (SELECT document, {tokens('document')} AS t FROM (SELECT DISTINCT document FROM pairs)),
d_terms AS MATERIALIZED (
  SELECT document, term, count(*) AS tf, any_value(dl) AS dl
  FROM (SELECT document, len(t) AS dl, unnest(t) AS term FROM d_toks) GROUP BY document, term
),
bm25_sums AS MATERIALIZED (
  SELECT pair_id, sum(qn * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS s
  FROM pairs JOIN q_terms USING (question) JOIN d_terms USING (document, term) JOIN term_idf USING (term), corpus_size
  GROUP BY pair_id
),
bm25 AS MATERIALIZED (SELECT pair_id, coalesce(s, 0.0) AS bm25_score FROM pairs LEFT JOIN bm25_sums USING (pair_id))"""


def grams(x: str) -> str:
    return f"""list_concat({x}, list_transform(range(1, len({x})), lambda i: {x}[i] || ' ' || {x}[i + 1]))"""


def gram_idf_ctes(texts: str) -> str:
    """``texts``: a query giving all texts, repeats included, as ``text``."""
    return f"""
texts AS MATERIALIZED ({texts}),
text_words AS MATERIALIZED (SELECT regexp_extract_all(lower(coalesce(text, '')), '{LONG_WORD}') AS w FROM texts),
gram_df AS (
  SELECT gram, count(*) AS df FROM (SELECT unnest(list_distinct({grams('w')})) AS gram FROM text_words) GROUP BY gram
),
gram_idf AS MATERIALIZED (
  SELECT gram, df, ln((1.0 + (SELECT count(*) FROM texts)) / (1.0 + df)) + 1.0 AS idf FROM gram_df
)"""


def side_weights(side: str, column: str) -> str:
    return f"""
{side}_words AS MATERIALIZED (SELECT pair_id, regexp_extract_all(lower(coalesce({column}, '')), '{LONG_WORD}') AS w FROM pairs),
{side}_weights AS MATERIALIZED (
  SELECT pair_id, gram, count(*) * any_value(idf) AS wt
  FROM (SELECT pair_id, unnest({grams('w')}) AS gram FROM {side}_words) JOIN gram_idf USING (gram)
  GROUP BY pair_id, gram
),
{side}_norm AS MATERIALIZED (SELECT pair_id, sqrt(sum(wt * wt)) AS len FROM {side}_weights GROUP BY pair_id)"""


TFIDF = (
    gram_idf_ctes("SELECT question AS text FROM pairs UNION ALL SELECT document FROM pairs")
    + ","
    + side_weights("q", "question")
    + ","
    + side_weights("d", "document")
    + """,
dots AS MATERIALIZED (
  SELECT pair_id, sum(q.wt * d.wt) AS dot
  FROM q_weights q JOIN d_weights d USING (pair_id, gram) GROUP BY pair_id
),
tfidf AS MATERIALIZED (
  SELECT pair_id, coalesce(dot / (q.len * d.len), 0.0) AS tfidf_similarity
  FROM pairs LEFT JOIN dots USING (pair_id) LEFT JOIN q_norm q USING (pair_id) LEFT JOIN d_norm d USING (pair_id)
)"""
)


def dot(a: str, b: str) -> str:
    return f"list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


def cos(a: str, b: str) -> str:
    return f"{dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)}))"


def vec_of(x: str) -> str:
    return f"{number60(f'md5({x})')} % (SELECT count(*) FROM embeddings)"


SEMANTIC = f"""
vec_texts AS MATERIALIZED (SELECT {norm('question')} AS text FROM pairs UNION SELECT {norm('document')} FROM pairs),
text_vec AS MATERIALIZED (SELECT text, embedding FROM vec_texts JOIN embeddings ON vec_id = {vec_of('text')}),
normed AS MATERIALIZED (SELECT pair_id, {norm('question')} AS q_norm, {norm('document')} AS d_norm FROM pairs),
semantic AS MATERIALIZED (
  SELECT pair_id, coalesce({cos('a.embedding', 'b.embedding')}, 0.0) AS semantic_cosine_similarity
  FROM normed LEFT JOIN text_vec a ON a.text = q_norm LEFT JOIN text_vec b ON b.text = d_norm
)"""

OWN_CORPUS = f"SELECT DISTINCT {norm('document')} AS document FROM pairs"
BM25 = bm25_ctes(OWN_CORPUS) + "," + BM25_SCORES

FEATURES = (
    PAIRS
    + ","
    + LEX
    + ","
    + BM25
    + ","
    + TFIDF
    + ","
    + SEMANTIC
    + f""",
features AS MATERIALIZED (
  SELECT pair_id, question_id, {norm('question')} AS question, {norm('document')} AS document, label, pair_type,
         source_doc_question_id, semantic_cosine_similarity, token_overlap, token_overlap_ratio,
         tfidf_similarity, bm25_score, document_length, query_length, question_type,
         CAST(0 AS BIGINT) AS named_entity_count,
         semantic_cosine_similarity * document_length AS similarity_times_doc_length, normalized_overlap
  FROM lexical JOIN bm25 USING (pair_id) JOIN tfidf USING (pair_id) JOIN semantic USING (pair_id)
)"""
)

VECTOR_PAIRS = f"""
vp AS (
  SELECT concat(a.vec_id, '_', b.vec_id) AS pair_id, CAST(a.vec_id AS VARCHAR) AS question_id,
         CAST(a.label = b.label AS INTEGER) AS label, round({cos('a.embedding', 'b.embedding')}, 6) AS score
  FROM embeddings a JOIN embeddings b ON b.vec_id - a.vec_id BETWEEN 1 AND 8
)"""

DOC_SCORES = """
ds AS (
  SELECT doc_id, quality AS label, round(n_chars / (n_chars + 2000.0::DOUBLE), 6) AS y_prob
  FROM labels JOIN documents USING (doc_id)
)"""


def ranked_ctes(source: str, score: str, keys: str = "question_id", prefix: str = "") -> str:
    """Per-question metrics of a source with pair_id and label."""
    sums = []
    for k in (1, 3, 5):
        sums += [
            f"sum(CASE WHEN rn <= {k} THEN label ELSE 0 END) / least({k}, count(*))::DOUBLE AS precision_at_{k}",
            f"sum(CASE WHEN rn <= {k} THEN label / log2(rn + 1) ELSE 0 END) AS dcg_at_{k}",
            f"sum(CASE WHEN irn <= {k} THEN label / log2(irn + 1) ELSE 0 END) AS idcg_at_{k}",
        ]
    ndcg = ", ".join(f"coalesce(dcg_at_{k} / nullif(idcg_at_{k}, 0), 0.0) AS ndcg_at_{k}" for k in (1, 3, 5))
    return f"""
{prefix}ordered AS (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {score} DESC NULLS LAST, pair_id) AS rn,
         row_number() OVER (PARTITION BY {keys} ORDER BY label DESC) AS irn
  FROM {source}
),
{prefix}sums AS (
  SELECT {keys}, coalesce(1.0 / min(CASE WHEN label = 1 THEN rn END), 0.0) AS rr, {', '.join(sums)}
  FROM {prefix}ordered GROUP BY {keys}
),
{prefix}per_q AS (SELECT *, {ndcg} FROM {prefix}sums)"""


METRICS = ["mrr"] + [f"{m}_at_{k}" for k in (1, 3, 5) for m in ("precision", "ndcg")]


def means(keys: str = "", digits: int | None = 6) -> str:
    columns = ["avg(rr) AS mrr"] + [f"avg({m}) AS {m}" for m in METRICS[1:]]
    if digits is not None:
        columns = [f"round({c.split(' AS ')[0]}, {digits}) AS {c.split(' AS ')[1]}" for c in columns]
    return (keys + ", " if keys else "") + ", ".join(columns)


def top3(source: str, score: str, keys: str = "question_id", prefix: str = "") -> str:
    return f"""
{prefix}kept AS (
  SELECT * FROM {source}
  QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {score} DESC NULLS LAST, pair_id) <= 3
)"""


STABLE = (
    FEATURES
    + """,
stable AS (
  SELECT pair_id, question_id, label, round(semantic_cosine_similarity, 6) AS semantic_cosine_similarity,
         round(bm25_score, 6) AS bm25_score, round(tfidf_similarity, 6) AS tfidf_similarity
  FROM features
)"""
)

OVERLAP_SCORED = PAIRS + "," + LEX + ", scored AS (SELECT pair_id, question_id, label, token_overlap_ratio AS y_prob FROM lexical)"


def class_ctes(source: str, score: str, key: str) -> str:
    """Counts, the four threshold metrics and AUROC per key."""
    return f"""
cells AS (
  SELECT {key} AS k, count(*) FILTER (label = 1 AND {score} >= 0.5) AS tp,
         count(*) FILTER (label = 0 AND {score} >= 0.5) AS fp,
         count(*) FILTER (label = 1 AND {score} < 0.5) AS fn,
         count(*) FILTER (label = 0 AND {score} < 0.5) AS tn
  FROM {source} GROUP BY ALL
),
by_score AS (
  SELECT {key} AS k, {score} AS s, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg
  FROM {source} GROUP BY ALL
),
cum AS (SELECT *, sum(neg) OVER (PARTITION BY k ORDER BY s) AS upto FROM by_score),
areas AS (SELECT k, coalesce(sum(pos * (upto - neg / 2.0::DOUBLE)) / nullif(sum(pos)::DOUBLE * sum(neg)::DOUBLE, 0), 0.0) AS auroc FROM cum GROUP BY k),
classed AS (
  SELECT cells.k, {ratio('tp + tn', 'tp + fp + fn + tn')} AS accuracy, {ratio('tp', 'tp + fp')} AS precision,
         {ratio('tp', 'tp + fn')} AS recall, {ratio('2 * tp', '2 * tp + fp + fn')} AS f1, auroc
  FROM cells JOIN areas USING (k)
)"""


ALL_BY_SPLIT = (
    OVERLAP_SCORED
    + ","
    + SPLIT
    + """,
split_scored AS (SELECT * FROM scored JOIN split_q USING (question_id)),"""
    + class_ctes("split_scored", "y_prob", "split")
    + ","
    + ranked_ctes("split_scored", "y_prob", "split, question_id")
    + f""",
ranked AS (SELECT {means('split', None)} FROM per_q GROUP BY split),
long AS (
  SELECT k AS split, 'classification' AS family, metric, value FROM classed
  UNPIVOT (value FOR metric IN (accuracy, precision, recall, f1, auroc))
  UNION ALL
  SELECT split, 'ranking', replace(metric, '_at_', '@'), value FROM ranked
  UNPIVOT (value FOR metric IN ({', '.join(METRICS)}))
)"""
)

VECTOR_CURVE = """
desc_scores AS (
  SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM {src} GROUP BY score
),
points AS (
  SELECT score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n
  FROM desc_scores WINDOW w AS (ORDER BY score DESC)
)"""

SWEEP = f"""
sweep AS (
  SELECT score AS threshold, {ratio('tp', 'tp + fp')} AS precision, {ratio('tp', 'p')} AS recall,
         {ratio('2 * tp', 'p + tp + fp')} AS f1
  FROM points
)"""

DIGEST_QA = f"""
SELECT 'q_' || md5('42:question:' || question) AS question_id, source_example_id, question, answer
FROM (SELECT question_id AS source_example_id, {norm('question')} AS question, {norm('answer')} AS answer FROM qa)
WHERE question <> '' AND answer <> ''"""


def with_(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select.strip()}"


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}

    for name in ("scan_csv_roundtrip", "scan_jsonl_roundtrip", "scan_parquet_qa"):
        sql[name] = with_(QA, DIGEST_QA)
    sql["sample_exact_n"] = (
        "SELECT doc_id, lang, source FROM documents ORDER BY md5('42:sample:' || doc_id), doc_id LIMIT 100"
    )
    sql["sample_then_split"] = """
WITH chosen AS (SELECT doc_id FROM documents ORDER BY md5('42:sample:' || doc_id), doc_id LIMIT 400)
SELECT CAST(doc_id AS VARCHAR) AS question_id,
       CASE WHEN substr(md5('42:split:' || doc_id), 1, 8) < 'b3333333' THEN 'train'
            WHEN substr(md5('42:split:' || doc_id), 1, 8) < 'd999999a' THEN 'validation' ELSE 'test' END AS split
FROM chosen"""
    sql["extract_first_text_json_order"] = with_(QA, f"SELECT question_id, {norm('answer')} AS answer FROM qa")
    sql["extract_first_text_array"] = with_(QA, f"SELECT question_id, {norm('answer')} AS answer FROM qa")
    sql["extract_first_text_struct"] = with_(
        QA,
        f"SELECT question_id, CASE WHEN turn % 4 = 3 THEN {norm('question')} ELSE {norm('answer')} END AS answer FROM qa",
    )
    sql["answer_fallback_coalesce"] = with_(
        QA,
        f"SELECT question_id, CASE WHEN turn % 4 = 3 THEN {norm('question')} ELSE {norm('answer')} END AS answer FROM qa",
    )
    sql["filter_nonempty_qa"] = f"""
SELECT concat(conv_id, '_', turn) AS source_example_id, {norm('text')} AS question, {norm('text')} AS answer
FROM conversations WHERE role = 'assistant' AND {norm('text')} <> ''"""
    sql["dedup_keep_first"] = """
SELECT doc_id, text, source FROM documents
QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1"""
    sql["assign_question_ids"] = with_(
        QA,
        "SELECT concat('q_', row_number() OVER (ORDER BY conv_id, turn) - 1) AS question_id, conv_id, turn, question FROM qa",
    )

    sql["normalize_whitespace"] = f"SELECT doc_id, {norm('text')} AS text FROM documents"
    sql["tokenize"] = f"SELECT doc_id, coalesce(array_to_string({tokens('text')}, '|'), '') AS tokens FROM documents"
    sql["question_type"] = with_(QA_OPENED, f"SELECT question_id, {first_token_type('question')} AS question_type FROM qo")
    sql["named_entity_heuristic"] = f"SELECT doc_id, {title_words('text')} AS named_entity_count FROM documents"
    types = ("who", "what", "when", "where", "why", "how", "other")
    sql["one_hot_question_type"] = with_(
        QA_OPENED + f", kinds AS (SELECT question_id, {first_token_type('question')} AS t FROM qo)",
        "SELECT question_id, " + ", ".join(f"CAST(t = '{t}' AS INTEGER) AS qtype_{t}" for t in types) + " FROM kinds",
    )

    columns = "pair_id, question_id, document, label, pair_type, source_doc_question_id"
    sql["positive_pairs"] = with_(PAIRS, f"SELECT {columns} FROM pairs WHERE label = 1")
    sql["negative_sampling"] = with_(PAIRS, f"SELECT {columns} FROM pairs WHERE label = 0")
    sql["negative_sampling_other_text"] = with_(
        f"""
blocks AS (
  SELECT CAST(doc_id AS VARCHAR) AS question_id, text AS answer, count(*) OVER (PARTITION BY text) AS size,
         row_number() OVER (ORDER BY md5(text), md5('42:index:' || doc_id)) - 1 AS idx
  FROM documents
),
starts AS (SELECT *, min(idx) OVER (PARTITION BY answer) AS start FROM blocks),
drawn AS (
  SELECT question_id, draw, start, size,
         {number60("md5('42:draw:' || question_id || ':' || draw)")} % ((SELECT count(*) FROM documents) - size) AS r
  FROM starts, range(1, 4) AS d(draw)
)""",
        """SELECT 'p_' || md5('42:pair:' || d.question_id || ':' || d.draw) AS pair_id, d.question_id, s.answer AS document,
       s.question_id AS source_doc_question_id
FROM drawn d JOIN starts s ON s.idx = CASE WHEN d.r >= d.start THEN d.r + d.size ELSE d.r END""",
    )
    sql["assign_pair_ids"] = with_(
        PAIRS,
        """SELECT concat('p_', row_number() OVER (ORDER BY pair_id) - 1) AS pair_id, question_id, label,
       source_doc_question_id FROM pairs""",
    )
    sql["false_negative_audit"] = with_(
        "doc_qa AS (SELECT CAST(doc_id AS VARCHAR) AS question_id, source AS question, text AS answer FROM documents),"
        + pair_ctes("doc_qa")
        + """,
per_doc AS (
  SELECT question_id, document, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n
  FROM pairs GROUP BY ALL
)""",
        """SELECT question_id, CAST(sum(n) AS BIGINT) AS negatives,
       CAST(sum(CASE WHEN p > 0 THEN n ELSE 0 END) AS BIGINT) AS equal_to_positive,
       CAST(sum(greatest(n - 1, 0)) AS BIGINT) AS repeated_draws
FROM per_doc GROUP BY question_id""",
    )
    sql["split_exact_counts"] = with_(
        PAIRS + "," + SPLIT, "SELECT pair_id, question_id, split FROM pairs JOIN split_q USING (question_id)"
    )
    sql["split_hash_bucket"] = with_(PAIRS, f"SELECT pair_id, question_id, {HASH_SPLIT} AS split FROM pairs")
    sql["split_semi_join"] = with_(
        PAIRS,
        f"""SELECT pair_id, question_id, label FROM pairs
WHERE question_id IN (SELECT question_id FROM qa WHERE {HASH_SPLIT} <> 'train')""",
    )
    sql["split_leakage_check"] = with_(
        PAIRS + "," + SPLIT,
        """SELECT split, count(DISTINCT question_id) AS questions, CAST(0 AS BIGINT) AS leaks
FROM pairs JOIN split_q USING (question_id) GROUP BY split""",
    )
    sql["features_union_splits"] = with_(
        PAIRS + "," + SPLIT + "," + LEX,
        """SELECT split, pair_id, token_overlap, document_length, question_type
FROM lexical JOIN split_q USING (question_id)""",
    )
    sql["dataset_summary"] = with_(
        PAIRS + "," + SPLIT,
        """SELECT coalesce(split, 'all') AS split, count(*) AS rows, count(DISTINCT question_id) AS unique_questions,
       round(avg(label), 6) AS positive_rate
FROM pairs JOIN split_q USING (question_id) GROUP BY ROLLUP (split)""",
    )

    lex = PAIRS + "," + LEX
    sql["token_overlap"] = with_(
        lex, "SELECT pair_id, token_overlap, round(token_overlap_ratio, 6) AS token_overlap_ratio FROM lexical"
    )
    sql["text_lengths"] = with_(lex, "SELECT pair_id, query_length, document_length FROM lexical")
    sql["interaction_features"] = with_(
        FEATURES,
        """SELECT pair_id, round(similarity_times_doc_length, 4) AS similarity_times_doc_length,
       round(normalized_overlap, 4) AS normalized_overlap FROM features""",
    )
    doc_corpus = f"SELECT DISTINCT {norm('text')} AS document FROM documents"
    sql["distinct_documents"] = doc_corpus
    sql["bm25_term_idf"] = with_(bm25_ctes(doc_corpus), "SELECT term, df, round(idf, 6) AS idf FROM term_idf")
    sql["bm25_pair_score"] = with_(
        PAIRS + "," + BM25, "SELECT pair_id, round(bm25_score, 6) AS bm25_score FROM bm25"
    )
    train_corpus = f"SELECT DISTINCT {norm('document')} AS document FROM pairs WHERE label = 1 AND {HASH_SPLIT} = 'train'"
    sql["bm25_reference_corpus"] = with_(
        PAIRS + "," + bm25_ctes(train_corpus) + "," + BM25_SCORES + f""",
known AS (SELECT pair_id, {norm('document')} IN (SELECT document FROM corpus) AS known FROM pairs)""",
        """SELECT pair_id, CAST(known AS INTEGER) AS in_corpus, CASE WHEN known THEN round(bm25_score, 6) END AS bm25_score
FROM bm25 JOIN known USING (pair_id)""",
    )
    sql["tfidf_idf"] = with_(
        gram_idf_ctes("SELECT text FROM documents"), "SELECT gram, df, round(idf, 6) AS idf FROM gram_idf"
    )
    sql["bm25_idf_from_batches"] = sql["bm25_term_idf"]
    sql["bm25_saved_corpus"] = sql["bm25_reference_corpus"]
    sql["tfidf_idf_from_batches"] = sql["tfidf_idf"]
    texts = f"SELECT DISTINCT {norm('text')} AS text FROM documents"
    sql["vector_store_runs"] = f"""WITH part AS ({texts} WHERE doc_id % 2 = 0), whole AS ({texts})
SELECT CAST(1 AS BIGINT) AS run, count(*) AS encoded, count(*) AS stored FROM part
UNION ALL SELECT 2, count(*) - (SELECT count(*) FROM part), count(*) FROM whole
UNION ALL SELECT 3, 0, count(*) FROM whole"""
    sql["tfidf_similarity"] = with_(
        PAIRS + "," + TFIDF, "SELECT pair_id, round(tfidf_similarity, 6) AS tfidf_similarity FROM tfidf"
    )
    sql["semantic_cosine"] = with_(VECTOR_PAIRS, "SELECT pair_id, score AS semantic_cosine_similarity FROM vp")
    doubles = (
        "semantic_cosine_similarity", "token_overlap_ratio", "tfidf_similarity", "bm25_score",
        "similarity_times_doc_length", "normalized_overlap",
    )
    sql["feature_table"] = with_(
        FEATURES, "SELECT * REPLACE (" + ", ".join(f"round({c}, 4) AS {c}" for c in doubles) + ") FROM features"
    )
    numeric = (
        "semantic_cosine_similarity", "token_overlap", "token_overlap_ratio", "tfidf_similarity", "bm25_score",
        "document_length", "query_length", "named_entity_count", "similarity_times_doc_length", "normalized_overlap",
    )
    sql["model_matrix"] = with_(
        FEATURES,
        "SELECT pair_id, label, "
        + ", ".join(f"round(CAST(CAST({c} AS FLOAT) AS DOUBLE), 2) AS {c}" for c in numeric)
        + ", "
        + ", ".join(f"CAST(question_type = '{t}' AS DOUBLE) AS qtype_{t}" for t in types)
        + " FROM features",
    )

    per_q = OVERLAP_SCORED + "," + ranked_ctes("scored", "y_prob")
    for name, metric in (("precision_at_k", "precision"), ("dcg_at_k", "dcg"), ("ndcg_at_k", "ndcg")):
        listed = ", ".join(f"round({metric}_at_{k}, 6) AS {metric}_at_{k}" for k in (1, 3, 5))
        sql[name] = with_(per_q, f"SELECT question_id, {listed} FROM per_q")
    sql["reciprocal_rank"] = with_(per_q, "SELECT question_id, round(rr, 6) AS rr FROM per_q")
    sql["ranking_metrics"] = with_(VECTOR_PAIRS + "," + ranked_ctes("vp", "score"), f"SELECT {means()} FROM per_q")

    scores = {
        "semantic": "semantic_cosine_similarity",
        "bm25": "bm25_score",
        "tfidf": "tfidf_similarity",
    }
    for name, column in scores.items():
        sql[f"topk_{name}"] = with_(
            STABLE + "," + top3("stable", column), f"SELECT question_id, pair_id, label, {column} FROM kept"
        )
        sql[f"baseline_{name}"] = with_(
            STABLE + "," + top3("stable", column) + "," + ranked_ctes("kept", column),
            f"SELECT {means()} FROM per_q",
        )
    sql["baseline_comparison"] = with_(
        STABLE
        + ", rows_by_method AS ("
        + " UNION ALL ".join(
            f"SELECT '{name}' AS method, question_id, pair_id, label, {column} AS score FROM stable"
            for name, column in scores.items()
        )
        + "),"
        + top3("rows_by_method", "score", "method, question_id")
        + ","
        + ranked_ctes("kept", "score", "method, question_id"),
        f"SELECT {means('method')} FROM per_q GROUP BY method",
    )
    sql["metric_gain"] = with_(
        STABLE
        + ","
        + ranked_ctes("stable", "tfidf_similarity", prefix="a_")
        + ","
        + top3("stable", "semantic_cosine_similarity")
        + ","
        + ranked_ctes("kept", "semantic_cosine_similarity", prefix="b_")
        + f""",
a_mean AS (SELECT {means(digits=None)} FROM a_per_q), b_mean AS (SELECT {means(digits=None)} FROM b_per_q),
a_long AS (SELECT * FROM a_mean UNPIVOT (value FOR metric IN ({', '.join(METRICS)}))),
b_long AS (SELECT * FROM b_mean UNPIVOT (value FOR metric IN ({', '.join(METRICS)})))""",
        """SELECT replace(metric, '_at_', '@') AS metric, round(a.value, 6) AS value, round(b.value, 6) AS baseline,
       round(a.value - b.value, 6) AS gain FROM a_long a JOIN b_long b USING (metric)""",
    )

    sql["threshold_predictions"] = with_(
        DOC_SCORES, "SELECT doc_id, label, CAST(y_prob >= 0.5 AS INTEGER) AS y_pred FROM ds"
    )
    sql["classification_metrics"] = with_(
        DOC_SCORES + "," + class_ctes("ds", "y_prob", "0"),
        "SELECT "
        + ", ".join(f"round({m}, 6) AS {m}" for m in ("accuracy", "precision", "recall", "f1", "auroc"))
        + " FROM classed",
    )
    # The pairwise definition, to differ from the rank-sum form of the query.
    sql["auroc"] = with_(
        VECTOR_PAIRS,
        """SELECT round(avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END), 6) AS auroc
FROM (SELECT score FROM vp WHERE label = 1) p, (SELECT score FROM vp WHERE label = 0) n""",
    )
    sql["confusion_matrix"] = with_(
        DOC_SCORES,
        """SELECT g.label, g.predicted, count(ds.doc_id) AS n
FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS g(label, predicted)
LEFT JOIN ds ON ds.label = g.label AND CAST(y_prob >= 0.5 AS INTEGER) = g.predicted
GROUP BY g.label, g.predicted""",
    )
    sql["score_histogram"] = with_(
        DOC_SCORES
        + """,
span AS (SELECT label, min(y_prob) AS a, max(y_prob) AS b FROM ds GROUP BY label),
wide AS (SELECT label, CASE WHEN a = b THEN a - 0.5 ELSE a END AS lo, CASE WHEN a = b THEN b + 0.5 ELSE b END AS hi FROM span),
edges AS (
  SELECT label, bin, lo + bin * ((hi - lo) / 50) AS lower,
         CASE WHEN bin = 49 THEN hi ELSE lo + (bin + 1) * ((hi - lo) / 50) END AS upper
  FROM wide, range(0, 50) AS r(bin)
)""",
        """SELECT e.label, e.bin, round(e.lower, 6) AS lower, round(e.upper, 6) AS upper, count(ds.doc_id) AS n
FROM edges e LEFT JOIN ds ON ds.label = e.label AND ds.y_prob >= e.lower AND (ds.y_prob < e.upper OR (e.bin = 49 AND ds.y_prob <= e.upper))
GROUP BY e.label, e.bin, e.lower, e.upper""",
    )
    curve = VECTOR_PAIRS + "," + VECTOR_CURVE.format(src="vp")
    for name, kept in (
        ("roc_curve", "first OR last OR next_pos <> pos OR next_neg <> neg"),
        ("roc_curve_all_points", "true"),
    ):
        sql[name] = with_(
            curve
            + """,
turns AS (
  SELECT *, lead(pos) OVER w AS next_pos, lead(neg) OVER w AS next_neg,
         row_number() OVER w = 1 AS first, lead(score) OVER w IS NULL AS last
  FROM desc_scores WINDOW w AS (ORDER BY score DESC)
)""",
            f"""SELECT score AS threshold, round(fp / n::DOUBLE, 6) AS fpr, round(tp / p::DOUBLE, 6) AS tpr
FROM points JOIN turns USING (score) WHERE {kept}
UNION ALL SELECT 'inf'::DOUBLE, 0.0, 0.0""",
        )
    sql["pr_curve"] = with_(
        curve,
        """SELECT score AS threshold, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / p::DOUBLE, 6) AS recall FROM points
UNION ALL SELECT NULL, 1.0, 0.0""",
    )
    doc_curve = DOC_SCORES + ", dsr AS (SELECT label, y_prob AS score FROM ds)," + VECTOR_CURVE.format(src="dsr")
    listed = ", ".join(f"round({c}, 6) AS {c}" for c in ("threshold", "precision", "recall", "f1"))
    sql["threshold_sweep"] = with_(doc_curve + "," + SWEEP, f"SELECT {listed} FROM sweep")
    sql["operating_point"] = with_(
        curve + "," + SWEEP, f"SELECT {listed} FROM sweep ORDER BY f1 DESC, sweep.threshold DESC LIMIT 1"
    )
    sql["model_checks"] = with_(
        PAIRS,
        """SELECT 'features' AS "check", CAST(17 AS BIGINT) AS value
UNION ALL SELECT 'importance adds up to 1', 1 UNION ALL SELECT 'metrics', 3 * (5 + 7)
UNION ALL SELECT 'metrics from 0 to 1', 1 UNION ALL SELECT 'accuracy of the scored rows', 1
UNION ALL SELECT 'scored pairs', count(*) FROM pairs""",
    )
    sql["training_curve"] = """SELECT 'points' AS "check", CAST(2 * 100 // 10 AS BIGINT) AS value
UNION ALL SELECT 'rounds', 100 UNION ALL SELECT 'last round is the model', 2
UNION ALL SELECT 'auroc and error from 0 to 1', 1 UNION ALL SELECT 'training loss falls', 1"""
    sql["tune_checks"] = """SELECT 'settings rated' AS "check", CAST(3 * 2 * 2 * 2 AS BIGINT) AS value
UNION ALL SELECT 'first of the highest auroc is taken', 1
UNION ALL SELECT 'metrics from 0 to 1', 1 UNION ALL SELECT 'trees of the best', 1"""
    sql["all_metrics"] = with_(ALL_BY_SPLIT, "SELECT split, family, metric, round(value, 6) AS value FROM long")
    sql["metrics_pivot"] = with_(
        ALL_BY_SPLIT,
        "SELECT metric, "
        + ", ".join(
            f"round(max(CASE WHEN split = '{s}' THEN value END), 6) AS {s}" for s in ("train", "validation", "test")
        )
        + " FROM long GROUP BY metric",
    )
    return sql
