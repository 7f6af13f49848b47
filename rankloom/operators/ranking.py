"""Per-question ranking metrics and top-k selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.constants import RANK_CUTOFFS
from rankloom.sources.writers import stage

def nan_to_null(col: Column) -> Column:
    """NaN sorts above every number in Spark; as null it can be sorted last."""
    return F.nanvl(col.cast("double"), F.lit(None).cast("double"))


def fill_missing(col: Column, value: float) -> Column:
    return F.coalesce(nan_to_null(col), F.lit(value))


def _best_first(score: str, tie: str) -> list[Column]:
    return [F.col(score).desc_nulls_last(), F.col(tie).asc()]


def top_k(df: DataFrame, score: str, k: int, group: list[str], tie: str = "pair_id") -> DataFrame:
    """The k best rows per group; missing scores come last, ties go by ``tie``.

    Filtering on the row number lets every map task keep k rows per group before the
    shuffle, so a group of any size reaches its task as k rows per map task (for k up to
    spark.sql.optimizer.windowGroupLimitThreshold, 1000 unless set).
    """
    ranked = df.withColumn("__score", nan_to_null(F.col(score))).withColumn(
        "__rn", F.row_number().over(W.partitionBy(*group).orderBy(*_best_first("__score", tie)))
    )
    return ranked.where(F.col("__rn") <= k).drop("__score", "__rn")


def _ranked(rows: DataFrame, group: list[str]) -> DataFrame:
    """rn by score and ideal_rn by label, over one partitioning."""
    by_score = W.partitionBy(*group).orderBy(*_best_first("score", "tie"))
    by_label = W.partitionBy(*group).orderBy(F.col("label").desc())
    return rows.withColumns(
        {"rn": F.row_number().over(by_score), "ideal_rn": F.row_number().over(by_label)}
    )


def _discounted(rank: str, k: int) -> Column:
    return F.sum(F.when(F.col(rank) <= k, F.col("label") / F.log2(F.col(rank) + 1)))


def _top_sums(k_values: list[int]) -> list[Column]:
    sums = []
    for k in k_values:
        sums += [
            F.sum(F.when(F.col("rn") <= k, F.col("label"))).alias(f"hits_{k}"),
            _discounted("rn", k).alias(f"dcg_{k}"),
            _discounted("ideal_rn", k).alias(f"idcg_{k}"),
        ]
    return sums


def _whole_groups(rows: DataFrame, group: list[str], k_values: list[int]) -> DataFrame:
    """Group sums where each group fits one task: one shuffle, two sorts."""
    return _ranked(rows, group).groupBy(*group).agg(
        F.count("*").alias("n"),
        F.min(F.when(F.col("label") == 1, F.col("rn"))).alias("first_hit"),
        *_top_sums(k_values),
    )


def _reduced_groups(rows: DataFrame, group: list[str], k_values: list[int]) -> DataFrame:
    """The same sums for groups of any size: only the rows that can matter are ranked.

    The top by score and the top by label are kept by a filter on the row number, which
    prunes in every map task. The rank of the first hit is one more than the number of
    rows ahead of the best hit; both that hit and the count combine on the map side.
    """
    k_max = max(k_values)
    by_score = F.row_number().over(W.partitionBy(*group).orderBy(*_best_first("score", "tie")))
    by_label = F.row_number().over(W.partitionBy(*group).orderBy(F.col("label").desc()))
    top = rows.select(*group, "label", by_score.alias("rn")).where(F.col("rn") <= k_max)
    top_sums = [x for k in k_values for x in (F.sum(F.when(F.col("rn") <= k, F.col("label"))).alias(f"hits_{k}"), _discounted("rn", k).alias(f"dcg_{k}"))]
    ideal = rows.select(*group, "label", by_label.alias("ideal_rn")).where(F.col("ideal_rn") <= k_max)
    ideal_sums = [_discounted("ideal_rn", k).alias(f"idcg_{k}") for k in k_values]
    # Missing scores come last: a flag, then the negated score, then the tie column.
    place = lambda: F.struct(F.col("score").isNull().alias("last"), (-F.col("score")).alias("low"), F.col("tie"))
    best = rows.where("label = 1").groupBy(*group).agg(F.min(place()).alias("hit"))
    best = stage(best, "best-hits")
    ahead = rows.join(best, group).groupBy(*group).agg(F.count(F.when(place() < F.col("hit"), 1)).alias("ahead"))
    sizes = rows.groupBy(*group).agg(F.count("*").alias("n"))
    sums = sizes.join(top.groupBy(*group).agg(*top_sums), group).join(ideal.groupBy(*group).agg(*ideal_sums), group)
    return sums.join(ahead, group, "left").withColumn("first_hit", F.col("ahead") + 1)


def question_metrics(
    df: DataFrame,
    score: str = "y_prob",
    label: str = "label",
    group: str = "question_id",
    by: list[str] | None = None,
    tie: str = "pair_id",
    k_values: list[int] | None = None,
    small_groups: bool = False,
) -> DataFrame:
    """One row per (``by``, question): n, rr, and precision@k, dcg@k, ndcg@k.

    ``small_groups=True`` states that group sizes are bounded (a top-k result, say), so that
    whole groups can be ranked in one shuffle. Rows without a question are left out.
    """
    by, k_values = by or [], k_values or RANK_CUTOFFS
    keys = [*by, group]
    rows = df.where(F.col(group).isNotNull()).select(
        *keys, F.col(label).alias("label"), nan_to_null(F.col(score)).alias("score"), F.col(tie).alias("tie")
    )
    if small_groups:
        sums = _whole_groups(rows, keys, k_values)
    else:
        # Read five times: narrow rows on file instead of the plan behind them.
        sums = _reduced_groups(stage(rows, "ranked-rows"), keys, k_values)
    metrics = [F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0)).alias("rr")]
    for k in k_values:
        metrics += [
            (F.coalesce(F.col(f"hits_{k}"), F.lit(0)) / F.least(F.lit(k), F.col("n"))).alias(f"precision@{k}"),
            F.coalesce(F.col(f"dcg_{k}"), F.lit(0.0)).alias(f"dcg@{k}"),
            F.coalesce(F.try_divide(f"dcg_{k}", f"idcg_{k}"), F.lit(0.0)).alias(f"ndcg@{k}"),
        ]
    return sums.select(*keys, "n", *metrics)


def metric_names(k_values: list[int] | None = None) -> list[str]:
    return ["mrr"] + [f"{m}@{k}" for k in k_values or RANK_CUTOFFS for m in ("precision", "ndcg")]


def ranking_metrics(df: DataFrame, by: list[str] | None = None, k_values: list[int] | None = None, **columns) -> DataFrame:
    """Mean over questions, one row per ``by`` group; questions without a hit count 0."""
    per_question = question_metrics(df, by=by, k_values=k_values, **columns)
    means = [F.avg("rr").alias("mrr")] + [
        F.avg(f"`{name}`").alias(name) for name in metric_names(k_values) if name != "mrr"
    ]
    return per_question.groupBy(*(by or [])).agg(*means)


def to_long(df: DataFrame, keys: list[str], metrics: list[str], family: str | None = None) -> DataFrame:
    """One row per metric: (keys, [family], metric, value)."""
    long = df.unpivot([F.col(k) for k in keys], [F.col(f"`{m}`") for m in metrics], "metric", "value")
    return long.select(*keys, F.lit(family).alias("family"), "metric", "value") if family else long
