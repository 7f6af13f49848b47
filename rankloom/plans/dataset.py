"""Whole dataset build: records to questions, pairs, splits, features and summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from rankloom.operators.features import FeatureOptions, feature_table
from rankloom.operators.pairs import build_pairs
from rankloom.operators.qa import build_qa, require_rows
from rankloom.operators.splits import split_by_question
from rankloom.operators.summary import summary_document
from rankloom.sources.readers import read_records
from rankloom.sources.writers import write_json, write_table


@dataclass(frozen=True)
class DatasetTables:
    qa: DataFrame
    pairs: DataFrame
    features: DataFrame
    summary: DataFrame


def build_dataset(
    spark: SparkSession,
    source: str,
    path: str,
    output: str,
    sample_size: int = 0,
    negatives_per_question: int = 1,
    fractions: tuple[float, float, float] = (0.70, 0.15, 0.15),
    seed: int = 42,
    options: FeatureOptions | None = None,
    vectors: DataFrame | None = None,
    csv: bool = True,
    **reader_options,
) -> DatasetTables:
    """Write ``raw/qa``, ``processed/pairs``, ``processed/features`` (both with a
    ``split`` column and folder) and ``processed/dataset_summary.json`` under ``output``
    and return the written tables. Each step starts from the files of the one before.
    Reading a table without a split filter gives the 'all' variant. ``sample_size`` keeps so
    many records, drawn by the seed; 0, the default, keeps all.
    """
    options = options or FeatureOptions()
    records = read_records(
        spark, source, path, sample_size=sample_size, seed=seed, **reader_options
    )
    qa = require_rows(
        write_table(build_qa(records, seed=seed), f"{output}/raw/qa", csv=csv), "question/answer table"
    )
    pairs = write_table(
        split_by_question(
            build_pairs(qa, negatives_per_question, seed), *fractions, seed=seed, questions=qa
        ),
        f"{output}/processed/pairs",
        csv=csv,
        partition_by="split",
    )
    features = write_table(
        feature_table(pairs, options, vectors, qa=qa),
        f"{output}/processed/features",
        csv=csv,
        partition_by="split",
    )
    summary = summary_document(
        features,
        {
            "source": source,
            "path": path,
            "sample_size_requested": sample_size,
            "negatives_per_question": negatives_per_question,
        },
    )
    write_json(summary, f"{output}/processed/dataset_summary.json")
    return DatasetTables(qa, pairs, features, summary)
