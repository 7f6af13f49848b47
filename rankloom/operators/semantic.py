"""Semantic cosine from text embeddings: precomputed vectors or a user's encoder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import normalize_whitespace, text_key
from rankloom.functions.vectors import cosine, cosine_batched
from rankloom.operators.skew import salted_lookup
from rankloom.sources.writers import stage


def encode_texts(texts: DataFrame, encoder, text: str = "text") -> DataFrame:
    """(text_key, embedding): every distinct text is encoded once.

    ``encoder`` is a pandas UDF from string to array<float>; write it in iterator form
    to load a model once per worker. Write the result as a table to keep it."""
    distinct = texts.select(normalize_whitespace(F.col(text)).alias("text")).distinct()
    return distinct.select(text_key(F.col("text")).alias("text_key"), encoder(F.col("text")).alias("embedding"))


def vector_cosines(
    pairs: DataFrame,
    vectors: DataFrame,
    question_key: str,
    document_key: str,
    vector_key: str,
    embedding: str = "embedding",
    key: str = "pair_id",
    out: str = "semantic_cosine_similarity",
    batched: bool = False,
) -> DataFrame:
    """``pairs`` with the cosine of the two vectors its key columns point to; null if
    one of them has no vector. A document that many pairs share is a hot key and gets
    salted."""
    joined = pairs
    for side, column in (("q", question_key), ("d", document_key)):
        joined = salted_lookup(
            joined,
            vectors.select(F.col(vector_key).alias(column), F.col(embedding).alias(f"__{side}_vec")),
            [column],
            spread=key,
        )
    measure = cosine_batched if batched else cosine
    return joined.withColumn(out, measure(F.col("__q_vec"), F.col("__d_vec"))).drop("__q_vec", "__d_vec")


def with_semantic(
    pairs: DataFrame,
    vectors: DataFrame | None,
    key: str = "pair_id",
    texts: DataFrame | None = None,
) -> DataFrame:
    """Add ``semantic_cosine_similarity``; ``vectors`` holds (text_key, embedding).
    Zeros without vectors and for texts that have none. ``texts`` is as in
    ``with_bm25``."""
    if vectors is None:
        return pairs.withColumn("semantic_cosine_similarity", F.lit(0.0))
    keys = (pairs if texts is None else texts).select(
        key,
        text_key(F.col("question")).alias("q_key"),
        text_key(F.col("document")).alias("d_key"),
    )
    keys = stage(keys, "vector-keys")
    scored = vector_cosines(keys, vectors, "q_key", "d_key", "text_key", key=key)
    return pairs.join(scored.select(key, "semantic_cosine_similarity"), key, "left").withColumn(
        "semantic_cosine_similarity", F.coalesce("semantic_cosine_similarity", F.lit(0.0))
    )
