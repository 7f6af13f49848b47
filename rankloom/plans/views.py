"""Question/answer, pair and score views over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.text import normalize_whitespace
from rankloom.operators.digest import digest_number
from rankloom.operators.pairs import build_pairs
from rankloom.operators.tfidf import pair_texts
from rankloom.sources.writers import stage

# The conversations rarely open with a question word; one is put in front by key.
OPENERS = ["Who", "What", "When", "Where", "Why", "How", "Is", ""]
NEGATIVES = 3


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def qa_view(spark: SparkSession, folder: str) -> DataFrame:
    """User turns joined with the assistant turn that follows."""
    turns = table(spark, folder, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    given = turns.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    return asked.join(given, ["conv_id", "turn"]).select(
        F.concat_ws("_", "conv_id", "turn").alias("question_id"), "conv_id", "turn", "question", "answer"
    )


def opened_qa_view(spark: SparkSession, folder: str) -> DataFrame:
    """``qa_view`` with an opening word put before each question."""
    opener = F.get(F.array(*[F.lit(w) for w in OPENERS]), F.pmod(F.col("conv_id") + F.col("turn"), F.lit(8)).cast("int"))
    return qa_view(spark, folder).withColumn(
        "question", F.when(opener == "", F.col("question")).otherwise(F.concat_ws(" ", opener, "question"))
    )


def pairs_view(spark: SparkSession, folder: str) -> DataFrame:
    """One positive and three negatives per question, as a staged table."""
    return stage(build_pairs(opened_qa_view(spark, folder), NEGATIVES), "pairs")


def text_vectors_view(spark: SparkSession, folder: str, pairs: DataFrame) -> DataFrame:
    """(text_key, embedding): a stand-in encoder. The digest of a text picks one of the
    vectors in ``embeddings``, whose ids run from 0."""
    vectors = table(spark, folder, "embeddings")
    # Copies go first, so that each text is normalised once; on file, as the optimizer merges two distincts.
    texts = stage(pair_texts(pairs).distinct(), "different-texts").select(normalize_whitespace(F.col("text")).alias("text"))
    keys = texts.select(F.md5("text").alias("digest")).distinct()
    total = vectors.agg(F.count("*")).scalar()
    picked = keys.select(
        F.unhex("digest").alias("text_key"),
        F.pmod(digest_number(F.col("digest")), total).alias("vec_id"),
    )
    return picked.join(vectors.select("vec_id", "embedding"), "vec_id").select("text_key", "embedding")


def vector_pairs_view(spark: SparkSession, folder: str, neighbours: int = 8) -> DataFrame:
    """Every vector as a question, with the next ``neighbours`` ids as its candidates;
    relevant when the labels agree."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "label")
    questions = vectors.select(
        F.col("vec_id").alias("q_vec"),
        F.col("label").alias("q_label"),
        F.explode(F.sequence(F.lit(1), F.lit(neighbours))).alias("step"),
    ).withColumn("d_vec", F.col("q_vec") + F.col("step"))
    return questions.join(
        vectors.select(F.col("vec_id").alias("d_vec"), F.col("label").alias("d_label")), "d_vec"
    ).select(
        F.concat_ws("_", "q_vec", "d_vec").alias("pair_id"),
        F.col("q_vec").cast("string").alias("question_id"),
        "q_vec",
        "d_vec",
        (F.col("q_label") == F.col("d_label")).cast("int").alias("label"),
    )


def doc_scores_view(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents with a score that grows with their length."""
    docs = table(spark, folder, "documents").select("doc_id", "n_chars")
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    score = F.round(F.col("n_chars") / (F.col("n_chars") + F.lit(2000.0)), 6)
    return labels.join(docs, "doc_id").select("doc_id", "label", score.alias("y_prob"))
