"""Retrieval by a single score: top-k, then ranking metrics on what was retrieved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.constants import BASELINE_SCORES, BASELINE_TOP_K
from rankloom.operators.ranking import fill_missing, metric_names, ranking_metrics, to_long, top_k


def single_score_baseline(
    df: DataFrame,
    score: str,
    k: int = BASELINE_TOP_K,
    fill: float | None = None,
    label: str = "label",
    group: str = "question_id",
    tie: str = "pair_id",
) -> DataFrame:
    """Metrics of the k best candidates per question; what is cut off is gone, so a
    lost positive makes its question 0 and the ideal order is that of the survivors."""
    if score not in df.columns:
        raise ValueError(f"no such score column: {score}")
    value = F.col(score) if fill is None else fill_missing(F.col(score), fill)
    rows = df.select(group, tie, F.col(label).alias("label"), value.alias("score"))
    kept = top_k(rows, "score", k, [group], tie)
    return ranking_metrics(kept, score="score", group=group, tie=tie, small_groups=True)


def compare_baselines(
    df: DataFrame,
    scores: dict[str, str] | None = None,
    k: int = BASELINE_TOP_K,
    label: str = "label",
    group: str = "question_id",
    tie: str = "pair_id",
) -> DataFrame:
    """(method, metric columns) of several scores in one pass: the scores become rows
    and (method, question) the group. A missing BM25 score counts 0; one of
    the others, which can be negative, comes last."""
    scores = scores or BASELINE_SCORES
    missing = sorted(set(scores.values()) - set(df.columns))
    if missing:
        raise ValueError(f"no such score columns: {missing}")
    wide = df.select(
        group,
        tie,
        F.col(label).alias("label"),
        *[
            (fill_missing(F.col(column), 0.0) if column == "bm25_score" else F.col(column).cast("double")).alias(method)
            for method, column in scores.items()
        ],
    )
    # Not unpivot: it leaves rows with a null score out.
    cells = [F.struct(F.lit(method).alias("method"), F.col(method).alias("score")) for method in scores]
    rows = wide.select(group, tie, "label", F.inline(F.array(*cells)))
    kept = top_k(rows, "score", k, ["method", group], tie)
    return ranking_metrics(kept, by=["method"], score="score", group=group, tie=tie, small_groups=True)


def metric_gain(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(metric, value, baseline, gain) of two one-row metric tables."""
    names = metric_names()
    return (
        to_long(ours, [], names)
        .join(to_long(theirs, [], names).withColumnRenamed("value", "baseline"), "metric")
        .withColumn("gain", F.col("value") - F.col("baseline"))
    )


def pivot_splits(long_metrics: DataFrame, splits: list[str]) -> DataFrame:
    """(metric, one column per split) of (split, metric, value)."""
    return long_metrics.groupBy("metric").pivot("split", splits).agg(F.first("value"))
