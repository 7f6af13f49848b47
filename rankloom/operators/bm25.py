"""Okapi BM25 of given (question, document) pairs.

A pair needs term counts of its own document only, and those are in its own row. So
documents are never indexed by (document, term): each pair row emits just the terms
its two texts share, these meet the corpus-wide term weights in one join, and the sum
per pair is the score. What shrinks before every shuffle: documents to distinct terms,
distinct terms to counts, pairs to shared terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.constants import BM25_B, BM25_EPSILON, BM25_K1
from rankloom.functions.counts import shared_rows, word_lists
from rankloom.functions.text import explode_rows, normalize_whitespace, text_key
from rankloom.operators.skew import salted_lookup
from rankloom.sources.writers import stage


def distinct_documents(docs: DataFrame, text: str = "document") -> DataFrame:
    """One row for each different text; map tasks drop their own copies by a 16-byte key."""
    texts = docs.select(normalize_whitespace(F.col(text)).alias("document"))
    return _one_per_key(texts.select("document", text_key(F.col("document")).alias("doc_key"))).select("document")


def _one_per_key(texts: DataFrame) -> DataFrame:
    copy = F.row_number().over(W.partitionBy("doc_key").orderBy("doc_key"))
    return texts.withColumn("__copy", copy).where("__copy = 1").drop("__copy")


def corpus_table(docs: DataFrame, text: str = "document", clean: bool = False) -> DataFrame:
    """(doc_key, terms, length) of each different document, as a staged table: distinct terms
    and the number of tokens. All corpus statistics come from it, and no text is read again.
    ``clean=True`` states that the texts are whitespace-normalised already."""
    texts = docs.select((F.col(text) if clean else normalize_whitespace(F.col(text))).alias("document"))
    texts = _one_per_key(texts.select("document", text_key(F.col("document")).alias("doc_key")))
    return stage(word_lists(texts, ["doc_key"], "document"), "bm25-corpus")


def corpus_size(corpus: DataFrame) -> Column:
    """Scalar struct (n_docs, avg_len) of a corpus table."""
    stats = corpus.agg(F.count("*").alias("n_docs"), F.avg("length").alias("avg_len"))
    return stats.select(F.struct("n_docs", "avg_len")).scalar()


def term_weights(corpus: DataFrame) -> DataFrame:
    """(term, df, idf) of a corpus table; negative weights are replaced by
    epsilon times the mean weight over all terms."""
    terms = explode_rows(corpus, items=F.col("terms"), out="term")
    return idf_of(terms.groupBy("term").agg(F.count("*").alias("df")), corpus_size(corpus)["n_docs"])


def idf_of(counts: DataFrame, n_docs: Column) -> DataFrame:
    """(term, df, idf) of document counts (term, df)."""
    raw = counts.select(
        "term", "df", (F.log(n_docs - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw")
    )
    floor = raw.agg(F.lit(BM25_EPSILON) * F.avg("raw")).scalar()
    return raw.select("term", "df", F.when(F.col("raw") < 0, floor).otherwise(F.col("raw")).alias("idf"))


def matched_scores(pairs: DataFrame, weights: DataFrame, size: Column, key: str = "pair_id") -> DataFrame:
    """(key, bm25_score) for the pairs that share at least one term, by ``term_weights`` and
    ``corpus_size`` of a corpus."""
    shared = shared_rows(pairs, [key], "question", "document", bigrams=False)
    shared = shared.selectExpr(key, "doc_len", "value AS term", "n AS tf", "query_n")
    shared = stage(shared, "shared-terms")
    weighted = salted_lookup(shared, weights, ["term"], spread=key, how="inner")
    tf = F.col("tf")
    length_norm = F.lit(1 - BM25_B) + F.lit(BM25_B) * F.col("doc_len") / size["avg_len"]
    gain = F.col("query_n") * F.col("idf") * tf * (BM25_K1 + 1) / (tf + F.lit(BM25_K1) * length_norm)
    return weighted.select(key, gain.alias("gain")).groupBy(key).agg(F.sum("gain").alias("bm25_score"))


def with_bm25(
    pairs: DataFrame,
    corpus_texts: DataFrame | None = None,
    corpus_column: str = "document",
    enabled: bool = True,
    key: str = "pair_id",
    texts: DataFrame | None = None,
    complete: bool = False,
    clean: bool = False,
) -> DataFrame:
    """Add ``bm25_score``. The corpus is the distinct documents of ``corpus_texts``, or
    of the pairs themselves if there is none or it has no rows. A pair whose document is not in the corpus gets NaN, and
    so does every pair when switched off. ``texts`` is the frame to read the pair texts
    from if ``pairs`` has been joined with other scores already. ``complete=True`` states
    that every pair document is in the corpus, which saves looking them up, ``clean=True`` that the pair
    texts are whitespace-normalised, which saves doing so again."""
    if not enabled:
        return pairs.withColumn("bm25_score", F.lit(float("nan")))
    texts = pairs if texts is None else texts
    own = corpus_texts is None or corpus_texts.isEmpty()
    corpus = corpus_table(texts, "document", clean) if own else corpus_table(corpus_texts, corpus_column)
    scores = matched_scores(texts, term_weights(corpus), corpus_size(corpus), key)
    scored = pairs.join(scores, key, "left").withColumn("bm25_score", F.coalesce("bm25_score", F.lit(0.0)))
    if own or complete:
        return scored
    return with_known(scored, texts, corpus.select("doc_key"), key)


def with_known(scored: DataFrame, texts: DataFrame, doc_keys: DataFrame, key: str) -> DataFrame:
    """``scored`` with NaN for the pairs whose document is not among the keys of a corpus."""
    doc_key = text_key(normalize_whitespace(F.col("document")))
    known = salted_lookup(
        texts.select(key, doc_key.alias("doc_key")),
        doc_keys,
        ["doc_key"],
        spread=key,
        how="inner",
    ).select(key, F.lit(True).alias("__known"))
    return (
        scored.join(known, key, "left")
        .withColumn("bm25_score", F.when(F.col("__known"), F.col("bm25_score")).otherwise(F.lit(float("nan"))))
        .drop("__known")
    )
