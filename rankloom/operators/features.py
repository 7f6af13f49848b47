"""The feature table: all per-pair scores in one plan."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.constants import FEATURE_COLUMNS, KEY_COLUMNS, PAIR_COLUMNS
from rankloom.functions.text import normalize_whitespace
from rankloom.operators.bm25 import with_bm25
from rankloom.operators.lexical import entity_count, with_lexical_features
from rankloom.operators.semantic import encode_texts, with_semantic
from rankloom.operators.tfidf import pair_texts, weighted_pair_texts, with_tfidf
from rankloom.sources.writers import stage


@dataclass(frozen=True)
class FeatureOptions:
    bm25: bool = True
    named_entities: bool = False
    encoder: Any = None
    entity_counter: Any = None


def feature_table(
    pairs: DataFrame,
    options: FeatureOptions | None = None,
    vectors: DataFrame | None = None,
    fit_texts: DataFrame | None = None,
    corpus_texts: DataFrame | None = None,
    qa: DataFrame | None = None,
) -> DataFrame:
    """Pairs with all features, in the fixed column order, other columns behind.

    Corpus-level scores default to the statistics of the given pairs. Score the whole
    pair table once and filter by split afterwards: that is the global corpus for
    every split, in one pass. ``fit_texts`` (column ``text``) and ``corpus_texts``
    (column ``document``) replace the TF-IDF and the BM25 corpus. ``qa``, the table the
    pairs were built from, gives the same statistics as the pairs from fewer texts.

    All score tables are keyed by pair_id, so the joins share one partitioning of the
    pairs. Pairs without that column are numbered; a repeated one is an error.
    """
    options = options or FeatureOptions()
    needed = {"question_id", "question", "document", "label"}
    missing = sorted(needed - set(pairs.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    if "pair_id" not in pairs.columns:
        # On file, so that all score tables see the same numbers.
        number = F.monotonically_increasing_id().cast("string")
        pairs = stage(pairs.withColumn("pair_id", F.concat(F.lit("p_"), number)), "numbered-pairs")
    elif not pairs.groupBy("pair_id").count().where("count > 1").isEmpty():
        raise ValueError("pair_id is not unique")
    clean = pairs.withColumns(
        {
            "question": normalize_whitespace(F.col("question")),
            "document": normalize_whitespace(F.col("document")),
        }
    )
    # On file, as every score reads the cleaned texts.
    clean = stage(clean, "clean-pairs")
    if vectors is None and options.encoder is not None:
        vectors = encode_texts(pair_texts(clean), options.encoder)

    scored = with_lexical_features(clean).withColumn(
        "named_entity_count",
        entity_count(F.col("question"), options.named_entities, options.entity_counter),
    )
    if corpus_texts is None and qa is not None:
        answers = qa.select(F.col("answer").alias("document"))
        scored = with_bm25(scored, answers, enabled=options.bm25, texts=clean, complete=True)
    else:
        scored = with_bm25(scored, corpus_texts, enabled=options.bm25, texts=clean, clean=True)
    own_texts = None if qa is None else weighted_pair_texts(qa, clean)
    scored = with_tfidf(scored, fit_texts, texts=clean, own_texts=own_texts)
    scored = with_semantic(scored, vectors, texts=clean).withColumn(
        "similarity_times_doc_length",
        F.col("semantic_cosine_similarity") * F.col("document_length"),
    )
    preferred = [c for c in PAIR_COLUMNS + FEATURE_COLUMNS if c in scored.columns]
    return scored.select(*preferred, *[c for c in scored.columns if c not in preferred])


def score_table(pairs: DataFrame, scores: list[str], vectors: DataFrame | None = None) -> DataFrame:
    """(pair_id, question_id, label) and the named ones of the three corpus-level scores.

    For who wants to rank by a score: what the others and the row-level features need is
    not computed. Values are those of ``feature_table``; pair ids have to be unique."""
    makers = {
        "bm25_score": lambda df, texts: with_bm25(df, texts=texts, clean=True),
        "tfidf_similarity": lambda df, texts: with_tfidf(df, texts=texts),
        "semantic_cosine_similarity": lambda df, texts: with_semantic(df, vectors, texts=texts),
    }
    unknown = sorted(set(scores) - set(makers))
    if unknown:
        raise ValueError(f"no such scores: {unknown}")
    texts = pairs.select("pair_id", *[normalize_whitespace(F.col(c)).alias(c) for c in ("question", "document")])
    texts = stage(texts, "clean-texts")
    scored = pairs.select("pair_id", "question_id", "label")
    for name in scores:
        scored = makers[name](scored, texts)
    return scored.select("pair_id", "question_id", "label", *scores)


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in KEY_COLUMNS]
