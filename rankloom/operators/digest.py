"""Seeded, partition-independent order: everything random hangs on an md5 digest.

Digests are spread evenly, so their first 16 bits cut a table into 65,536 ranges of
near-equal size whatever the keys look like. Counts per range are a table of bounded
size; with them a rank over the whole table needs neither a global sort nor a window
over more than one range, and a cut point needs no shuffle of the rows at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PREFIX_DIGITS = 4
MAX_RANGES = 16**PREFIX_DIGITS
PAST_LAST_DIGEST = "g"


def seeded_digest(seed: int, purpose: str, *keys: Column) -> Column:
    """``purpose`` keeps the uses of one seed apart: what a sample keeps says nothing
    about the split or the draws of a row."""
    return F.md5(F.concat_ws(":", F.lit(f"{seed}:{purpose}"), *[k.cast("string") for k in keys]))


def digest_number(digest: Column) -> Column:
    """A 60-bit number of a digest: wide enough to pick among any number of rows."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def _range_of(digest: Column) -> Column:
    return F.substring(digest, 1, PREFIX_DIGITS)


def _range_counts(df: DataFrame, digest: str) -> DataFrame:
    """(digest_range, n, before): rows per range and rows in all earlier ranges.

    At most 65,536 rows, so the running sum fits one task by construction.
    """
    counts = df.groupBy(_range_of(F.col(digest)).alias("digest_range")).agg(
        F.count("*").alias("n")
    )
    earlier = W.orderBy("digest_range").rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def with_digest_index(df: DataFrame, digest: str, tie: str, out: str) -> DataFrame:
    """Number all rows 0..n-1 in the order of (digest, tie)."""
    ranges = _range_counts(df, digest).select("digest_range", "before")
    within = W.partitionBy("digest_range").orderBy(digest, tie)
    return (
        df.withColumn("digest_range", _range_of(F.col(digest)))
        .join(F.broadcast(ranges), "digest_range")
        .withColumn(out, F.col("before") + F.row_number().over(within) - 1)
        .drop("digest_range", "before")
    )


def digest_cuts(df: DataFrame, digest: str, targets) -> Column:
    """The digests that stand at given ranks, as one scalar struct column.

    ``targets(total)`` returns {name: rank expression (1-based)}. Field ``<name>`` holds
    the digest at that rank (null if the rank is 0 or past the end); field
    ``<name>_exact`` tells whether exactly ``rank`` rows lie at or below it, which holds
    wherever digests are unique. Only the ranges the ranks fall in are looked at row by
    row, and equal digests are counted before they are ranked.
    """
    ranges = _range_counts(df, digest)
    total = W.orderBy("digest_range").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranges = ranges.withColumn("total", F.sum("n").over(total))
    named = targets(F.col("total"))
    wanted = ranges.select(
        "digest_range",
        "n",
        "before",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(name).alias("target"), rank.cast("bigint").alias("rank"))
                    for name, rank in named.items()
                ]
            )
        ).alias("t"),
    ).where("t.rank > before AND t.rank <= before + n")
    wanted = wanted.select(
        "digest_range", F.col("t.target").alias("target"), (F.col("t.rank") - F.col("before")).alias("offset")
    )
    digests = (
        df.withColumn("digest_range", _range_of(F.col(digest)))
        .join(F.broadcast(wanted), "digest_range")
        .groupBy("target", "offset", F.col(digest).alias("digest"))
        .agg(F.count("*").alias("copies"))
    )
    upto = W.partitionBy("target").orderBy("digest")
    found = digests.withColumn("last", F.sum("copies").over(upto)).where(
        "last >= offset AND last - copies < offset"
    )
    fields = []
    for name in named:
        mine = F.col("target") == name
        fields.append(F.max(F.when(mine, F.col("digest"))).alias(name))
        fields.append(F.max(F.when(mine, F.col("last") == F.col("offset"))).alias(f"{name}_exact"))
    return found.agg(F.struct(*fields).alias("cuts")).scalar()


def sample_exact(df: DataFrame, n: int, key: Column, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (all if n <= 0 or n exceeds the input), without replacement,
    chosen by the seed.

    A row is kept by comparing its own digest with the n-th smallest one: no sort and
    no shuffle of the rows, whatever n is. ``key`` has to identify a row; the query
    fails if rows sharing a key straddle the cut, since no exact count exists then.
    """
    if n <= 0:
        return df
    keyed = df.withColumn("__digest", seeded_digest(seed, "sample", key))
    cuts = digest_cuts(
        keyed.select("__digest"), "__digest", lambda total: {"last": F.least(F.lit(n), total)}
    )
    cut = F.when(cuts["last_exact"], cuts["last"]).otherwise(
        F.raise_error(F.lit("the sample key does not identify a row"))
    )
    return keyed.where(F.col("__digest") <= cut).drop("__digest")
