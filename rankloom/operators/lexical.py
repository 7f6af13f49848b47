"""Features a pair row gives by itself: overlaps, lengths, type, entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.counts import with_overlap
from rankloom.functions.text import question_type, title_word_count


def with_lexical_features(
    df: DataFrame, question: str = "question", document: str = "document"
) -> DataFrame:
    return with_overlap(df, question, document).withColumns(
        {
            "token_overlap_ratio": share(F.col("token_overlap"), F.col("query_length")),
            "normalized_overlap": share(F.col("token_overlap"), F.col("document_length")),
            "question_type": question_type(F.col(question)),
        }
    )


def share(part: Column, whole: Column) -> Column:
    """part / max(whole, 1)"""
    return part / F.greatest(whole, F.lit(1))


def entity_count(question: Column, enabled: bool, counter=None) -> Column:
    """0 when switched off; else a user's pandas UDF, or the title-case heuristic."""
    if not enabled:
        return F.lit(0).cast("bigint")
    return (counter(question) if counter else title_word_count(question)).cast("bigint")


def one_hot(col: Column, categories: list[str], prefix: str) -> list[Column]:
    return [F.coalesce((col == c).cast("int"), F.lit(0)).alias(f"{prefix}{c}") for c in categories]
