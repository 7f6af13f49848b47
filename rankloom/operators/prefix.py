"""Numbering and running totals over a whole table in any order.

``orderBy`` range-partitions on sampled bounds, so a value that a third of the rows
share is spread as long as the full sort key is unique. The sorted rows are cut off
with ``checkpoint()`` (the bounds are sampled, so both passes below have to see the
same partitions); then one row per partition carries the offset of that partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.session import ensure_checkpoint_dir

_ROW_BITS = (1 << 33) - 1  # monotonically_increasing_id keeps the row number in the low 33 bits


def _sorted_partitions(df: DataFrame, order: list[Column]) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return (
        df.orderBy(*order)
        .checkpoint()
        .select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__row"))
    )


def with_dense_index(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Number all rows 0..n-1 in the given order (its columns should identify a row)."""
    rows = _sorted_partitions(df, order)
    counts = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    earlier = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    # One row per partition of the sorted table: bounded by spark.sql.shuffle.partitions.
    return (
        rows.join(F.broadcast(offsets), "__part")
        .withColumn(out, F.col("__before") + F.col("__row").bitwiseAND(F.lit(_ROW_BITS)))
        .drop("__part", "__row", "__before")
    )


def with_running_totals(
    df: DataFrame,
    order: list[Column],
    totals: dict[str, str],
    by: list[str] | None = None,
    following: dict[str, str] | None = None,
) -> DataFrame:
    """Add inclusive running sums, ``{new column: summed column}``, per ``by`` group, and
    with ``following`` the values of the next row, ``{new column: column}`` (null in the
    last one).

    Callers aggregate to one row per sort key first; then no key is hot.
    """
    by, following = by or [], following or {}
    rows = _sorted_partitions(df, [F.col(c) for c in by] + order)
    # One row per partition and group: what lies before it and what comes next.
    parts = rows.groupBy("__part", *by).agg(
        *[F.sum(src).alias(f"__sum_{out}") for out, src in totals.items()],
        *[F.min_by(src, "__row").alias(f"__first_{out}") for out, src in following.items()],
    )
    in_order = W.partitionBy(*by).orderBy("__part")
    earlier = in_order.rowsBetween(W.unboundedPreceding, -1)
    edges = parts.select(
        "__part",
        *by,
        *[F.coalesce(F.sum(f"__sum_{out}").over(earlier), F.lit(0)).alias(f"__before_{out}") for out in totals],
        *[F.lead(f"__first_{out}").over(in_order).alias(f"__next_{out}") for out in following],
    )
    inside = W.partitionBy("__part", *by).orderBy("__row")
    upto = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.join(edges, ["__part", *by]).select(
        *df.columns,
        *[(F.col(f"__before_{out}") + F.sum(src).over(upto)).alias(out) for out, src in totals.items()],
        *[
            F.coalesce(F.lead(src).over(inside), F.col(f"__next_{out}")).alias(out)
            for out, src in following.items()
        ],
    )
