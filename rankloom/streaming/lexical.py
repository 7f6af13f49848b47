"""Row-level features of pairs that arrive as files.

Tokens, overlaps, lengths, question type and entity count depend on the row alone, so
the batch expressions run on a stream unchanged and without state. Corpus-level scores
need the whole corpus and stay batch work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rankloom.operators.lexical import entity_count, with_lexical_features


def read_pair_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def lexical_stream(pairs: DataFrame) -> DataFrame:
    return with_lexical_features(pairs).withColumn(
        "named_entity_count", entity_count(F.col("question"), enabled=True)
    )


def write_feature_stream(features: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived to Parquet, then stop; run again for later files."""
    return (
        features.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
