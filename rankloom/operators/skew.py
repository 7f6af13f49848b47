"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one key that a sub-key takes; keys with more are spread over several.
SUB_KEY_ROWS = 100_000


def hot_keys(df: DataFrame, keys: list[str], target: int = SUB_KEY_ROWS) -> DataFrame:
    """(keys, salts): the keys with more than ``target`` rows and the number of sub-keys
    that brings each below it. Counting combines on the map side."""
    return largest(df.groupBy(*keys).agg(F.count("*").alias("n")), keys, "n", target)


def largest(counts: DataFrame, keys: list[str], n: str, target: int = SUB_KEY_ROWS) -> DataFrame:
    """``hot_keys`` for a table that already holds the row count of each key."""
    return counts.where(F.col(n) > target).select(*keys, F.ceil(F.col(n) / target).cast("int").alias("salts"))


def _hash_small_partitions(spark: SparkSession) -> None:
    """Let adaptive execution join by hash instead of sorting both sides, where each partition of a
    side is measured to be no larger than its usual partition. A session's own setting stays."""
    name = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
    if spark.conf.get(name) in ("0", "0b"):
        spark.conf.set(name, spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes"))


def salted_lookup(
    rows: DataFrame,
    table: DataFrame,
    keys: list[str],
    spread: str,
    how: str = "left",
    hot: DataFrame | None = None,
) -> DataFrame:
    """Join ``rows`` with ``table`` (one row per key) on ``keys``.

    Rows of hot keys are spread over sub-keys by the hash of ``spread``, and only the
    table rows of those keys are repeated, once per sub-key. A key's sub-keys follow its
    own row count. Every hot key stands for ``SUB_KEY_ROWS`` rows or more, so the marks are few
    and are broadcast: both sides are dealt out once, by key and sub-key. For the join itself
    that stays with adaptive execution and its size threshold.

    ``hot`` replaces the counting pass where the caller knows a cheaper bound.
    """
    _hash_small_partitions(rows.sparkSession)
    if hot is None:
        hot = hot_keys(rows.select(*keys), keys)
    marker = F.broadcast(hot.select(*keys, F.col("salts").alias("__salts")))
    left = (
        rows.join(marker, keys, "left")
        .withColumn("__salt", F.expr(f"coalesce(int(pmod(xxhash64(`{spread}`), __salts)), 0)"))
        .drop("__salts")
    )
    right = (
        table.join(marker, keys, "left")
        .withColumn("__salt", F.expr("explode(sequence(0, coalesce(__salts, 1) - 1))"))
        .drop("__salts")
    )
    return left.join(right, [*keys, "__salt"], how).drop("__salt")
