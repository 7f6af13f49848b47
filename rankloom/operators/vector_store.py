"""Text vectors that are kept between runs: each text is encoded once by each encoder.

The store is a folder with a Parquet table of (text_key, embedding) per encoder. A text is
named by the 128-bit key of its normalised form, wherever it came from, so every row is
right by itself: a task that is lost leaves nothing, and a run that ends while it appends
leaves vectors that the next run need not make again. One run at a time may add to a store.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.text import normalize_whitespace, text_key

_VECTORS = "text_key binary, embedding array<float>"


def _folder(path: str, encoder_name: str) -> str:
    if not encoder_name or any(not (c.isalnum() or c in "-_.") for c in encoder_name):
        raise ValueError("an encoder's name has letters, digits, '-', '_' and '.' only")
    return f"{path.rstrip('/')}/encoder={encoder_name}"


def stored_vectors(spark: SparkSession, path: str, encoder_name: str) -> DataFrame:
    """(text_key, embedding) of an encoder; no rows where there is no store yet."""
    try:
        return spark.read.schema(_VECTORS).parquet(_folder(path, encoder_name))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _VECTORS)


def missing_texts(texts: DataFrame, known: DataFrame, text: str = "text") -> DataFrame:
    """(text_key, text): each different text that has no vector, once. Null texts count as ''."""
    own = texts.select(normalize_whitespace(F.col(text)).alias("text"))
    # Copies are dropped in the map tasks by key, and known texts by a join on 16 bytes.
    keyed = own.select(text_key(F.col("text")).alias("text_key"), "text")
    different = keyed.groupBy("text_key").agg(F.first("text").alias("text"))
    return different.join(known.select("text_key"), "text_key", "left_anti")


def add_texts(texts: DataFrame, encoder, encoder_name: str, path: str, text: str = "text") -> DataFrame:
    """Encode the texts that the store lacks, append them, and return (text_key, embedding) of
    all it holds, as ``with_semantic`` takes them.

    ``encoder`` maps a text column to an array of floats, a pandas UDF or an expression. With
    nothing missing it never runs and nothing is written."""
    spark = texts.sparkSession
    lacking = missing_texts(texts, stored_vectors(spark, path, encoder_name), text)
    if not lacking.isEmpty():
        vectors = lacking.select("text_key", encoder(F.col("text")).cast("array<float>").alias("embedding"))
        vectors.write.mode("append").parquet(_folder(path, encoder_name))
    return stored_vectors(spark, path, encoder_name)
