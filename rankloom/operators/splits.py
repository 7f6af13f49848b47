"""Train/validation/test assignment by question, so that no question leaks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.constants import SPLITS
from rankloom.operators.digest import PAST_LAST_DIGEST, digest_cuts, seeded_digest


def _check(train: float, validation: float, test: float) -> None:
    if not math.isclose(train + validation + test, 1.0, rel_tol=1e-5, abs_tol=1e-8):
        raise ValueError("split fractions must add up to 1")


def split_by_question(
    pairs: DataFrame,
    train: float = 0.70,
    validation: float = 0.15,
    test: float = 0.15,
    seed: int = 42,
    questions: DataFrame | None = None,
) -> DataFrame:
    """Add ``split`` with exact question counts: ceil((1-train)*n) questions are held
    out and floor(share*held_out) of them validate.

    The two digests at the cut ranks decide; each pair compares its question's digest
    with them, so the pair table is neither joined nor shuffled. ``questions`` is the
    table the pairs were built from, if it is at hand: its ids are read instead of the
    pairs', which are then read only once.
    """
    _check(train, validation, test)
    if "question_id" not in pairs.columns:
        raise ValueError("missing column: question_id")
    ids = (
        (pairs if questions is None else questions)
        .where("question_id IS NOT NULL")
        .select("question_id")
        .distinct()
        .select(seeded_digest(seed, "split", F.col("question_id")).alias("digest"))
    )
    share = validation / (validation + test)

    def ranks(total):
        checked = F.when(total >= 3, total).otherwise(
            F.raise_error(F.lit("a split needs at least 3 questions"))
        )
        held_out = F.ceil(F.lit(1.0 - train) * checked)
        return {
            "train": checked - held_out,
            "validation": checked - held_out + F.floor(F.lit(share) * held_out),
        }

    cuts = digest_cuts(ids, "digest", ranks)
    digest = seeded_digest(seed, "split", F.col("question_id"))
    return (
        pairs.withColumn("__cuts", cuts)
        .withColumn("__digest", digest)
        .withColumn(
            "split",
            F.when(F.col("__digest") <= F.col("__cuts.train"), SPLITS[0])
            .when(F.col("__digest") <= F.col("__cuts.validation"), SPLITS[1])
            .otherwise(SPLITS[2]),
        )
        .drop("__cuts", "__digest")
    )


def split_by_hash(
    pairs: DataFrame,
    train: float = 0.70,
    validation: float = 0.15,
    test: float = 0.15,
    seed: int = 42,
) -> DataFrame:
    """Add ``split`` by fixed digest ranges: map-only and stable while data grows, with
    counts that are near the fractions instead of exact."""
    _check(train, validation, test)

    def edge(fraction: float) -> str:
        reached = math.floor(fraction * 16**8 + 0.5)
        return PAST_LAST_DIGEST if reached >= 16**8 else f"{reached:08x}"

    prefix = F.substring(seeded_digest(seed, "split", F.col("question_id")), 1, 8)
    return pairs.withColumn(
        "split",
        F.when(prefix < edge(train), SPLITS[0])
        .when(prefix < edge(train + validation), SPLITS[1])
        .otherwise(SPLITS[2]),
    )


def keep_questions(pairs: DataFrame, questions: DataFrame) -> DataFrame:
    """Pairs whose question is in ``questions``: a left semi join."""
    return pairs.join(questions.select("question_id"), "question_id", "left_semi")


def split_leaks(pairs: DataFrame) -> DataFrame:
    """Questions found in more than one split; empty for every sound split."""
    return (
        pairs.groupBy("question_id")
        .agg(F.min("split").alias("first_split"), F.max("split").alias("last_split"))
        .where("first_split <> last_split")
    )


def concat_splits(parts: dict[str, DataFrame]) -> DataFrame:
    """Stack per-split tables with their name as the first column."""
    stacked = None
    for name, part in parts.items():
        named = part.select(F.lit(name).alias("split"), *[c for c in part.columns if c != "split"])
        stacked = named if stacked is None else stacked.unionByName(named)
    return stacked
