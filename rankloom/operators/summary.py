"""Row, question and label counts of a dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.constants import SPLITS
from rankloom.operators.features import feature_columns


def split_summary(features: DataFrame) -> DataFrame:
    """(split, rows, unique_questions, positive_rate) per split and, as 'all', in total.

    Questions are reduced to one row each before they are counted."""
    per_question = features.groupBy("split", "question_id").agg(
        F.count("*").alias("n"), F.sum("label").alias("positives")
    )
    return (
        per_question.rollup("split")
        .agg(
            F.sum("n").alias("rows"),
            F.count("question_id").alias("unique_questions"),
            (F.sum("positives") / F.sum("n")).alias("positive_rate"),
            F.grouping("split").alias("is_total"),
        )
        .select(
            F.when(F.col("is_total") == 1, "all").otherwise(F.col("split")).alias("split"),
            "rows",
            "unique_questions",
            "positive_rate",
        )
    )


def summary_document(features: DataFrame, settings: dict[str, object]) -> DataFrame:
    """One nested row with the run's settings, counts per split and the feature list."""
    per_split = split_summary(features)
    entries = {
        name: F.max(
            F.when(F.col("split") == name, F.struct("rows", "unique_questions", "positive_rate"))
        )
        for name in [*SPLITS, "all"]
    }
    wide = per_split.agg(*[e.alias(f"__{n}") for n, e in entries.items()])
    return wide.select(
        *[F.lit(v).alias(k) for k, v in settings.items()],
        F.col("__all.unique_questions").alias("sample_size_loaded"),
        F.col("__all.rows").alias("total_pairs"),
        F.struct(*[F.col(f"__{n}").alias(n) for n in SPLITS]).alias("splits"),
        F.array(*[F.lit(c) for c in feature_columns(features)]).alias("feature_columns"),
    )
