"""Training and tuning runs over a written feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from rankloom.constants import FULL_GRID, QUICK_GRID
from rankloom.operators.boosting import AT_ONCE, BoostedTrees
from rankloom.operators.model import (
    evaluate,
    grid_search,
    importance_table,
    save_model,
    top_features,
    train,
    training_curve,
)
from rankloom.sources.writers import write_json


def save_run(model: BoostedTrees, metrics: DataFrame, output: str) -> None:
    """Model, metrics and importance (highest first) under ``output``."""
    save_model(model, metrics.sparkSession, f"{output}/model")
    write_json(metrics, f"{output}/metrics.json")
    importance = importance_table(model, metrics.sparkSession)
    write_json(top_features(importance, n=importance.count()), f"{output}/feature_importance.json")


def train_run(features: DataFrame, output: str | None = None, **overrides):
    """Fit, rate all three splits, save, with the curve over the evaluation sets. Keyword
    arguments replace single parameters."""
    model = train(features, overrides)
    metrics = evaluate(model, features)
    if output:
        save_run(model, metrics, output)
        write_json(training_curve(model, features), f"{output}/training_curve.json")
    return model, metrics


def tuning_run(
    features: DataFrame, output: str | None = None, quick: bool = False, grid: dict | None = None, at_once: int = AT_ONCE
):
    """Grid search on the validation split, then the best model on the test split."""
    model, settings, results = grid_search(features, grid or (QUICK_GRID if quick else FULL_GRID), at_once)
    metrics = evaluate(model, features.where("split = 'test'"))
    if output:
        save_run(model, metrics, output)
        write_json(results, f"{output}/tuning_results.json")
        spark = features.sparkSession
        write_json(
            spark.createDataFrame([(k, float(v)) for k, v in settings.items()], "parameter string, value double"),
            f"{output}/best_params.json",
        )
    return model, settings, results, metrics
