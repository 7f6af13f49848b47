"""Top-k retrieval baselines over a written feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.constants import BASELINE_TOP_K
from rankloom.operators.baseline import compare_baselines
from rankloom.operators.ranking import metric_names, to_long
from rankloom.sources.readers import read_split
from rankloom.sources.writers import write_json


def model_gain_run(
    spark: SparkSession, features_path: str, model_metrics: DataFrame, output: str | None = None, k: int = BASELINE_TOP_K
) -> DataFrame:
    """(method, metric, value, baseline, gain): a model's test metrics, as ``train_run`` returns them,
    against each single score's top-k retrieval."""
    ours = model_metrics.where("split = 'test' AND family = 'ranking'").select("metric", "value")
    theirs = to_long(compare_baselines(read_split(spark, features_path, "test"), k=k), ["method"], metric_names())
    gain = theirs.withColumnRenamed("value", "baseline").join(ours, "metric").select(
        "method", "metric", "value", "baseline", (F.col("value") - F.col("baseline")).alias("gain")
    )
    if output:
        write_json(gain, f"{output}/model_gain.json")
    return gain


def baseline_run(spark: SparkSession, features_path: str, output: str | None = None, k: int = BASELINE_TOP_K) -> DataFrame:
    results = compare_baselines(read_split(spark, features_path, "test"), k=k)
    if output:
        write_json(results, f"{output}/baseline_results.json")
    return results
