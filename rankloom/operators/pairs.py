"""Positive and negative (question, document) pairs from a question/answer table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.constants import PAIR_COLUMNS
from rankloom.operators.digest import digest_number, seeded_digest, with_digest_index
from rankloom.operators.prefix import with_dense_index
from rankloom.operators.skew import salted_lookup


def _require(df: DataFrame, names: list[str]) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")


def _pair_key(seed: int, draw: Column) -> Column:
    """Pair id from a digest of question and draw: unique, the same on every run, and
    in an order that says nothing about the label (it breaks ties in rankings)."""
    return F.concat(F.lit("p_"), seeded_digest(seed, "pair", F.col("question_id"), draw))


def positive_pairs(qa: DataFrame, seed: int = 42) -> DataFrame:
    _require(qa, ["question_id", "question", "answer"])
    return qa.select(
        _pair_key(seed, F.lit(0)).alias("pair_id"),
        "question_id",
        "question",
        F.col("answer").alias("document"),
        F.lit(1).alias("label"),
        F.lit("positive").alias("pair_type"),
        F.col("question_id").alias("source_doc_question_id"),
    )


def negative_pairs(
    qa: DataFrame, per_question: int = 1, seed: int = 42, exclude_same_text: bool = False
) -> DataFrame:
    """``per_question`` draws of another question's answer, uniform over all others and
    with replacement across draws.

    Questions get an index, in digest order; a draw picks one of the n-1 other indexes
    and meets its answer in an equi join. Draws are uniform, so no index is hot.

    "Other" goes by question: where answers repeat, a negative can read like the
    positive. ``exclude_same_text=True`` draws from the questions with another answer
    text instead; equal answers are then numbered side by side, and a draw steps over
    the own block.
    """
    _require(qa, ["question_id", "question", "answer"])
    if per_question < 1:
        raise ValueError("per_question must be at least 1")
    keyed = qa.select(
        "question_id",
        "question",
        "answer",
        seeded_digest(seed, "index", F.col("question_id")).alias("digest"),
    )
    indexed = _blocks_by_answer(keyed) if exclude_same_text else _blocks_by_question(keyed)
    total = qa.agg(F.count("*")).scalar()
    others = F.when(total > F.col("block_size"), total - F.col("block_size")).otherwise(
        F.raise_error(F.lit("negative pairs need at least 2 questions to draw from"))
    )
    draws = indexed.select(
        "question_id",
        "question",
        "block_start",
        "block_size",
        F.explode(F.sequence(F.lit(1), F.lit(per_question))).alias("draw"),
    )
    drawn = F.pmod(digest_number(seeded_digest(seed, "draw", F.col("question_id"), F.col("draw"))), others)
    draws = draws.withColumn("pick", drawn).select(
        _pair_key(seed, F.col("draw")).alias("pair_id"),
        "question_id",
        "question",
        F.expr("if(pick >= block_start, pick + block_size, pick) AS pick"),
    )
    answers = indexed.select(
        F.col("idx").alias("pick"),
        F.col("question_id").alias("source_doc_question_id"),
        F.col("answer").alias("document"),
    )
    return draws.join(answers, "pick").select(
        "pair_id",
        "question_id",
        "question",
        "document",
        F.lit(0).alias("label"),
        F.lit("negative").alias("pair_type"),
        "source_doc_question_id",
    )


def _blocks_by_question(keyed: DataFrame) -> DataFrame:
    """Index in digest order; what a draw must not hit is the question itself."""
    indexed = with_digest_index(keyed, "digest", "question_id", "idx").drop("digest")
    return indexed.selectExpr("*", "idx AS block_start", "1L AS block_size")


def _blocks_by_answer(keyed: DataFrame) -> DataFrame:
    """Index by answer, then question: equal answers form a block. One answer may hold a
    large share of the rows; the range sort cuts through it, and its block is looked up
    with salt."""
    by_answer = keyed.withColumn("answer_key", F.md5("answer"))
    indexed = with_dense_index(by_answer, [F.col("answer_key"), F.col("digest")], "idx")
    blocks = indexed.groupBy("answer_key").agg(
        F.min("idx").alias("block_start"), F.count("*").alias("block_size")
    )
    return salted_lookup(indexed, blocks, ["answer_key"], spread="question_id", how="inner").drop(
        "answer_key", "digest"
    )


def build_pairs(
    qa: DataFrame,
    negatives_per_question: int = 1,
    seed: int = 42,
    pair_ids: str = "digest",
    exclude_same_text: bool = False,
) -> DataFrame:
    """One positive and N negatives per question.

    ``pair_ids="sequential"`` numbers the pairs p_0, p_1, ... in shuffled (digest)
    order; the default keeps the digest itself as the id and needs no numbering.
    """
    if pair_ids not in ("digest", "sequential"):
        raise ValueError(f"unknown pair_ids: {pair_ids}")
    pairs = positive_pairs(qa, seed).unionByName(
        negative_pairs(qa, negatives_per_question, seed, exclude_same_text)
    )
    return number_pairs(pairs) if pair_ids == "sequential" else pairs


def number_pairs(pairs: DataFrame) -> DataFrame:
    """Replace digest pair ids by p_0..p_{n-1} in digest order."""
    digests = pairs.withColumn("digest", F.substring("pair_id", 3, 32))
    numbered = with_digest_index(digests, "digest", "pair_id", "n")
    return numbered.withColumn("pair_id", F.concat(F.lit("p_"), F.col("n"))).select(PAIR_COLUMNS)


def number_questions(df: DataFrame, order: list[Column]) -> DataFrame:
    """Add question_id = q_0..q_{n-1} in the given (load) order."""
    rest = [c for c in df.columns if c != "question_id"]
    return with_dense_index(df.select(rest), order, "__idx").select(
        F.concat(F.lit("q_"), F.col("__idx")).alias("question_id"), *rest
    )


def false_negatives(pairs: DataFrame) -> DataFrame:
    """Per question: negatives whose text equals the positive's, and repeated draws.

    Exclusion of the own answer goes by question, not by text, so both can happen
    where answers repeat. One aggregation on short digests; texts are not moved.
    """
    keyed = pairs.select("question_id", "label", F.md5("document").alias("doc_key"))
    per_doc = keyed.groupBy("question_id", "doc_key").agg(
        F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("as_positive"),
        F.sum(F.when(F.col("label") == 0, 1).otherwise(0)).alias("as_negative"),
    )
    return per_doc.groupBy("question_id").agg(
        F.sum("as_negative").alias("negatives"),
        F.sum(F.when(F.col("as_positive") > 0, F.col("as_negative")).otherwise(0)).alias("equal_to_positive"),
        F.sum(F.greatest(F.col("as_negative") - 1, F.lit(0))).alias("repeated_draws"),
    )
