"""Classification metrics, curves and distributions of a scored table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.constants import CLASSIFICATION_METRICS, DECISION_THRESHOLD, HISTOGRAM_BINS
from rankloom.operators.prefix import with_running_totals
from rankloom.operators.ranking import ranking_metrics, metric_names, to_long


def decide(score: Column, threshold: float = DECISION_THRESHOLD) -> Column:
    return (score >= threshold).cast("int")


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def class_counts(df: DataFrame, label: str, pred: str, by: list[str] | None = None) -> DataFrame:
    y, p = F.col(label), F.col(pred)
    return df.groupBy(*(by or [])).agg(
        _count((y == 1) & (p == 1)).alias("tp"),
        _count((y == 0) & (p == 1)).alias("fp"),
        _count((y == 1) & (p == 0)).alias("fn"),
        _count((y == 0) & (p == 0)).alias("tn"),
    )


def threshold_metrics(df: DataFrame, label: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """accuracy, precision, recall, f1 from one pass; a zero denominator gives 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return class_counts(df, label, pred, by).select(
        *(by or []),
        _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def score_counts(df: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """Positives and negatives per distinct score: the table all curves start from."""
    return df.groupBy(*(by or []), F.col(score).cast("double").alias("score")).agg(
        _count(F.col(label) == 1).alias("pos"), _count(F.col(label) == 0).alias("neg")
    )


def auroc(df: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve, ties counting one half; 0 when a class is missing."""
    by = by or []
    totals = with_running_totals(
        score_counts(df, label, score, by), [F.col("score").asc()], {"neg_upto": "neg"}, by
    )
    below = F.col("neg_upto") - F.col("neg") / 2
    return totals.groupBy(*by).agg(
        _ratio(
            F.sum(F.col("pos") * below), F.sum("pos").cast("double") * F.sum("neg").cast("double")
        ).alias("auroc")
    )


def classification_metrics(
    df: DataFrame, label: str, score: str, pred: str | None = None, by: list[str] | None = None
) -> DataFrame:
    """All five metrics, one row per ``by`` group."""
    by = by or []
    if pred is None:
        df, pred = df.withColumn("__pred", decide(F.col(score))), "__pred"
    group = by or [F.lit(0).alias("__all")]
    names = by or ["__all"]
    frame = df.select("*", *group) if not by else df
    joined = threshold_metrics(frame, label, pred, names).join(auroc(frame, label, score, names), names)
    return joined.select(*by, *CLASSIFICATION_METRICS)


def all_metrics(
    df: DataFrame, label: str, score: str, by: list[str] | None = None, **ranking_columns
) -> DataFrame:
    """Classification and ranking metrics in long form: (by, family, metric, value)."""
    by = by or []
    return to_long(
        classification_metrics(df, label, score, by=by), by, CLASSIFICATION_METRICS, "classification"
    ).unionByName(
        to_long(
            ranking_metrics(df, by=by, label=label, score=score, **ranking_columns),
            by,
            metric_names(ranking_columns.get("k_values")),
            "ranking",
        )
    )


def confusion_matrix(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Four rows (label, predicted, n), empty cells included."""
    cells = [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]
    grid = F.array(
        *[
            F.struct(F.lit(y).alias("label"), F.lit(p).alias("predicted"), F.col(c).alias("n"))
            for y, p, c in cells
        ]
    )
    return class_counts(df, label, pred).select(F.inline(grid))


def _descending(df: DataFrame, label: str, score: str) -> DataFrame:
    """(score, pos, neg, tp, fp, p, n, next_pos, next_neg): hits at each distinct score
    and at or above it, class totals, and the hits at the next lower score."""
    running = with_running_totals(
        score_counts(df, label, score),
        [F.col("score").desc()],
        {"tp": "pos", "fp": "neg"},
        following={"next_pos": "pos", "next_neg": "neg"},
    )
    totals = running.agg(F.struct(F.sum("pos").alias("p"), F.sum("neg").alias("n"))).scalar()
    return running.select("*", totals["p"].alias("p"), totals["n"].alias("n"))


def roc_curve(df: DataFrame, label: str, score: str, drop_intermediate: bool = True) -> DataFrame:
    """(threshold, fpr, tpr) by distinct score, and the point (0, 0) at +infinity.

    A point on the straight line between its neighbours is left out unless
    ``drop_intermediate`` is False: that is where the next step goes exactly as far.
    """
    points = _descending(df, label, score)
    if drop_intermediate:
        points = points.where(
            "(tp = pos AND fp = neg) OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg"
        )
    points = points.select(
        F.col("score").alias("threshold"),
        F.try_divide("fp", "n").alias("fpr"),
        F.try_divide("tp", "p").alias("tpr"),
    )
    start = points.agg(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return start.unionByName(points)


def pr_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """(threshold, precision, recall) at every distinct score, and the end point with
    precision 1 and recall 0, whose threshold is null."""
    points = _descending(df, label, score).select(
        F.col("score").alias("threshold"),
        F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        F.coalesce(F.try_divide("tp", "p"), F.lit(1.0)).alias("recall"),
    )
    end = points.agg(
        F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return points.unionByName(end)


def threshold_sweep(df: DataFrame, label: str, score: str) -> DataFrame:
    """Precision, recall and f1 when deciding at each distinct score."""
    tp, fp, p = F.col("tp"), F.col("fp"), F.col("p")
    return _descending(df, label, score).select(
        F.col("score").alias("threshold"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, p).alias("recall"),
        _ratio(2 * tp, p + tp + fp).alias("f1"),
    )


def best_threshold(sweep: DataFrame, min_precision: float = 0.0) -> DataFrame:
    """The operating point with the highest f1 (the highest threshold of equal ones)
    among those that reach ``min_precision``."""
    order = F.struct("f1", "threshold")
    return sweep.where(F.col("precision") >= min_precision).agg(
        *[F.max_by(c, order).alias(c) for c in ("threshold", "precision", "recall", "f1")]
    )


def score_histogram(df: DataFrame, label: str, score: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """(label, bin, lower, upper, n): equal-width bins over each class's own range.

    The last bin is closed; a class with a single value gets a range one wide around
    it. Only counts per (class, bin) are shuffled.
    """
    x = F.col("x")
    scores = df.select(F.col(label).alias("label"), F.col(score).cast("double").alias("x")).where(
        "label IN (0, 1) AND x IS NOT NULL"
    )
    flat = F.col("lo") == F.col("hi")
    ranges = (
        scores.groupBy("label")
        .agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
        .select(
            "label",
            F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
            F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
        )
        .withColumn("step", (F.col("hi") - F.col("lo")) / bins)
    )
    # Two rows at most: one per class.
    placed = scores.join(F.broadcast(ranges), "label")

    def edge(i: Column) -> Column:
        return F.when(i >= bins, F.col("hi")).otherwise(F.col("lo") + i * F.col("step"))

    guess = F.least(F.floor((x - F.col("lo")) / F.col("step")), F.lit(bins - 1))
    placed = placed.withColumn("guess", guess)
    # Division can land one bin off; the edges themselves decide.
    fixed = (
        F.when(x < edge(F.col("guess")), F.col("guess") - 1)
        .when((F.col("guess") < bins - 1) & (x >= edge(F.col("guess") + 1)), F.col("guess") + 1)
        .otherwise(F.col("guess"))
    )
    counts = placed.groupBy("label", fixed.alias("bin")).agg(F.count("*").alias("n"))
    grid = ranges.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)).cast("array<bigint>")).alias("bin"))
    return grid.join(F.broadcast(counts), ["label", "bin"], "left").select(
        "label",
        "bin",
        edge(F.col("bin")).alias("lower"),
        edge(F.col("bin") + 1).alias("upper"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )
