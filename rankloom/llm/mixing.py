"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

A van der Corput sequence visits the unit interval evenly; mapped through the cumulated
target shares it names the source of each slot of the mix, so any stretch of the mix
holds the sources nearly in proportion. Slot number r of a source takes the source's
r-th block, pass after pass over its documents in a seeded shuffled order. Blocks hold
``block_tokens`` tokens each (the last of a source may be shorter), and may start
inside a document.

Per source only its totals go to the driver (one row a source). Positions and ranks are
running totals in two levels, within small ranges and over the totals of ranges, so no
source needs one task.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.llm.shared import staged

BLOCK_TOKENS = 256
MAX_PASSES = 3
#: Documents, and slots, that one range of a running total holds on average.
RANGE_ROWS = 1_024
BROADCAST_SOURCES = 50_000
_BITS = 40


class Target(NamedTuple):
    size: int
    target: float
    quota: int
    low: float  # the source's part of the unit interval
    high: float


def word_count(text: Column) -> Column:
    """Number of runs of other characters than space, tab, line feed, \\x0B, form feed and return; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A key without nulls that sorts as the sources by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def targets(sizes: dict[str, int], weights: dict[str, float], total: float | None = None, passes: int = MAX_PASSES) -> dict[str, Target]:
    """Targets in proportion to the weights, none above ``passes`` times its source's size.

    What a stopped source cannot take goes to the others by weight, until none is above.
    The sum is ``total`` (all tokens by default), or less if all sources are stopped.
    """
    names = sorted(sizes)
    rest, stopped = float(sum(sizes.values()) if total is None else total), {}
    open_names = [n for n in names if sizes[n] > 0]
    while open_names:
        weight = sum(weights[n] for n in open_names)
        above = [n for n in open_names if rest * weights[n] / weight > passes * sizes[n]]
        if not above:
            break
        for n in above:
            stopped[n] = float(passes * sizes[n])
        rest -= sum(stopped[n] for n in above)
        open_names = [n for n in open_names if n not in stopped]
    weight = sum(weights[n] for n in open_names) or 1.0
    got = {n: stopped.get(n, rest * weights[n] / weight if n in open_names else 0.0) for n in names}
    whole, at, out = sum(got.values()) or 1.0, 0.0, {}
    for n in names:
        out[n] = Target(sizes[n], got[n], min(int(np.floor(got[n] + 0.5)), passes * sizes[n]), at / whole, (at + got[n]) / whole)
        at += got[n]
    return out


def _positions(rows: DataFrame, n_rows: int) -> DataFrame:
    """Add ``begin``: the tokens of the source before this document in the shuffled order."""
    digits = max(2, int(np.ceil(np.log(max(2, n_rows / RANGE_ROWS)) / np.log(16))))
    half = digits // 2
    rows = rows.withColumn("range", F.substring("turn", 1, digits)).withColumn("coarse", F.substring("turn", 1, half))
    totals = rows.groupBy("key", "coarse", "range").agg(F.sum("size").alias("n"))
    before = lambda *by: W.partitionBy("key", *by).rowsBetween(W.unboundedPreceding, -1)
    coarse = totals.groupBy("key", "coarse").agg(F.sum("n").alias("n"))
    coarse = coarse.select("key", "coarse", F.coalesce(F.sum("n").over(before().orderBy("coarse")), F.lit(0)).alias("far"))
    fine = totals.select(
        "key", "coarse", "range", F.coalesce(F.sum("n").over(before("coarse").orderBy("range")), F.lit(0)).alias("near")
    ).join(coarse, ["key", "coarse"])
    own = F.coalesce(F.sum("size").over(before("range").orderBy("turn", "tie")), F.lit(0))
    fine = fine.select("key", "range", (F.col("far") + F.col("near")).alias("offset"))
    return rows.withColumn("own", own).join(fine, ["key", "range"]).withColumn("begin", F.col("own") + F.col("offset"))


def _per_source(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Numbers the driver holds for each source; sent along unless there are very many sources."""
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= BROADCAST_SOURCES else df


def schedule(spark: SparkSession, plan: dict[str, Target], block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The slots of the mix: slot, key (of the source), rank within the source, pass, block and
    the number of tokens taken from that block.

    A source whose share of the points falls short of its quota (by a few blocks, the
    discrepancy of the sequence) gets the rest in slots after all others.
    """
    names = [n for n in sorted(plan) if plan[n].quota > 0]
    if not names:
        return spark.createDataFrame([], "slot long, key string, rank long, pass long, block long, tokens long")
    bounds = np.array([plan[n].high for n in names])
    listed = np.array(names, dtype=object)
    n_slots = sum(-(-plan[n].quota // block_tokens) for n in names)

    @F.pandas_udf("string")
    def source_of(point: pd.Series) -> pd.Series:
        return pd.Series(listed[np.minimum(np.searchsorted(bounds, point.to_numpy(), "right"), len(listed) - 1)])

    point = F.conv(F.reverse(F.lpad(F.bin("id"), _BITS, "0")), 2, 10).cast("double") / F.lit(float(1 << _BITS))
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), source_of(point).alias("key"))
    slots = slots.withColumn("range", F.floor(F.col("slot") / RANGE_ROWS)).withColumn("coarse", F.floor(F.col("slot") / RANGE_ROWS**2))
    totals = slots.groupBy("key", "coarse", "range").agg(F.count("*").alias("n"))
    before = lambda *by: W.partitionBy("key", *by).rowsBetween(W.unboundedPreceding, -1)
    coarse = totals.groupBy("key", "coarse").agg(F.sum("n").alias("n"))
    far = coarse.select("key", "coarse", F.coalesce(F.sum("n").over(before().orderBy("coarse")), F.lit(0)).alias("far"))
    fine = totals.select("key", "coarse", "range", F.coalesce(F.sum("n").over(before("coarse").orderBy("range")), F.lit(0)).alias("near"))
    offsets = fine.join(far, ["key", "coarse"]).select("key", "range", (F.col("far") + F.col("near")).alias("offset"))
    own = F.row_number().over(W.partitionBy("key", "range").orderBy("slot")) - 1
    ranked = slots.withColumn("own", own).join(offsets, ["key", "range"]).select("slot", "key", (F.col("own") + F.col("offset")).alias("rank"))

    quotas = _per_source(spark, [(n, plan[n].size, plan[n].quota) for n in names], "key string, size long, quota long")
    counted = coarse.groupBy("key").agg(F.sum("n").alias("n"))
    # Bounded by the sources, and short: the discrepancy of the sequence in blocks.
    # A pass ends with a block that may be shorter than the others.
    per_pass = F.ceil(F.col("size") / block_tokens)
    needed = F.col("quota").cast("long") / F.col("size")
    full = F.floor(needed)
    blocks = full * per_pass + F.ceil((F.col("quota") - full * F.col("size")) / block_tokens)
    short = quotas.join(counted, "key", "left").withColumn("have", F.coalesce("n", F.lit(0))).withColumn("blocks", blocks)
    tail = short.where("have < blocks").select(
        F.lit(n_slots).alias("slot"), "key", F.explode(F.sequence(F.col("have"), F.col("blocks") - 1)).alias("rank")
    )
    taken = ranked.unionByName(tail).join(quotas, "key").withColumn("pass", F.floor(F.col("rank") / per_pass))
    taken = taken.withColumn("block", F.col("rank") - F.col("pass") * per_pass)
    at = F.col("pass") * F.col("size") + F.col("block") * block_tokens
    tokens = F.least(F.lit(block_tokens), F.col("size") - F.col("block") * block_tokens, F.col("quota") - at)
    return taken.select("slot", "key", "rank", "pass", "block", tokens.cast("long").alias("tokens")).where("tokens > 0")


def mix_sources(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weight_pattern: tuple[float, ...] = (1.0, 2.0, 3.0),
    total: float | None = None,
    passes: int = MAX_PASSES,
    block_tokens: int = BLOCK_TOKENS,
    seed: str = "mix",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: its id, size, source_size, target (of its source), taken, and ``keep``.

    Sources by code point, null last (a source of its own), get the weights of the
    pattern in turn. ``taken`` counts repeats; it is at most ``passes`` times the size.
    Null and empty texts have size 0 and are never taken; a table without words takes
    nothing; repeated rows are documents of their own. Sources are few: their totals, a
    row each, are held on the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        source_key(F.col(source)).alias("key"),
        word_count(F.col(text)).alias("size"),
        F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))).alias("turn"),
        F.md5(F.coalesce(F.col(text), F.lit(""))).alias("tie"),
        *[F.col(c).alias(f"__keep_{c}") for c in keep],
    )
    rows = staged(rows, "mix-sizes")
    by_source = rows.groupBy("key").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    sizes = {r["key"]: r["size"] for r in by_source}
    weights = {n: weight_pattern[i % len(weight_pattern)] for i, n in enumerate(sorted(sizes))}
    plan = targets(sizes, weights, total, passes)
    placed = staged(_positions(rows, sum(r["n"] for r in by_source)).select(*rows.columns, "begin", F.monotonically_increasing_id().alias("row")), "mix-placed")

    slots = schedule(spark, plan, block_tokens).select("key", "block", "tokens")
    block = F.explode(F.sequence(F.floor(F.col("begin") / block_tokens), F.floor((F.col("begin") + F.col("size") - 1) / block_tokens)))
    parts = placed.where("size > 0").select("row", "key", "begin", "size", block.alias("block"))
    low = F.greatest(F.col("begin") - F.col("block") * block_tokens, F.lit(0))
    high = F.least(F.col("begin") + F.col("size") - F.col("block") * block_tokens, F.lit(block_tokens))
    used = F.greatest(F.lit(0), F.least(high, F.col("tokens")) - low)
    taken = parts.join(slots, ["key", "block"]).groupBy("row").agg(F.sum(used).alias("taken"))

    per_source = _per_source(spark, [(n, t.size, t.target) for n, t in plan.items()], "key string, source_size long, target double")
    return placed.join(taken, "row", "left").join(per_source, "key").select(
        F.col("doc_id").alias(doc_id),
        "size",
        "source_size",
        "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        *[F.col(f"__keep_{c}").alias(c) for c in keep],
    )
