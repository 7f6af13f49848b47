"""Gradient-boosted relevance classifier: matrix, training, grid search, importance."""

from __future__ import annotations

import itertools
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.constants import (
    MODEL_DEFAULTS,
    MODEL_FEATURES,
    NUMERIC_FEATURES,
    QUESTION_TYPES,
    TOP_FEATURES,
)
from rankloom.operators.boosting import AT_ONCE, BoostedTrees, Tree, fit_side_by_side, score_rounds
from rankloom.operators.classification import all_metrics, auroc
from rankloom.operators.lexical import one_hot
from rankloom.operators.ranking import fill_missing
from rankloom.sources.writers import stage

#: Rounds between two points of a training curve's AUROC.
CURVE_STEP = 10


def model_matrix(features: DataFrame) -> DataFrame:
    """The 17 model inputs in order, as floats, a missing BM25 score as 0; all other
    columns that are not features stay."""
    numeric = [
        (fill_missing(F.col(c), 0.0) if c == "bm25_score" else F.col(c)).cast("float").alias(c)
        for c in NUMERIC_FEATURES
    ]
    types = [
        c.cast("float").alias(f"qtype_{t}")
        for t, c in zip(QUESTION_TYPES, one_hot(F.col("question_type"), QUESTION_TYPES, "qtype_"))
    ]
    kept = [
        F.col(c).cast("int") if c == "label" else F.col(c)
        for c in features.columns
        if c not in NUMERIC_FEATURES and c != "question_type"
    ]
    return features.select(*kept, *numeric, *types)


def inputs_table(features: DataFrame) -> DataFrame:
    """Keys, label, the model inputs, and ``draw``, 64 bits that decide in which rounds a row is
    drawn; the texts are left behind."""
    keys = _keys(features)
    own = ["pair_id"] if "pair_id" in keys else [*keys, "label", *MODEL_FEATURES]
    matrix = model_matrix(features).withColumn("draw", F.xxhash64(*own))
    return matrix.select(*keys, "label", "draw", *MODEL_FEATURES)


def _keys(df: DataFrame) -> list[str]:
    return [c for c in ("split", "pair_id", "question_id") if c in df.columns]


def _settings(overrides: dict | None) -> dict:
    unknown = sorted(set(overrides or {}) - set(MODEL_DEFAULTS))
    if unknown:
        raise ValueError(f"unknown parameters: {unknown}")
    return {**MODEL_DEFAULTS, **(overrides or {})}


def train(features: DataFrame, overrides: dict | None = None) -> BoostedTrees:
    """Fit on the training split (all rows if there is no split column)."""
    rows = features.where("split = 'train'") if "split" in features.columns else features
    return fit_side_by_side(inputs_table(rows), MODEL_FEATURES, [_settings(overrides)])[0]


def score(model: BoostedTrees, features: DataFrame) -> DataFrame:
    """Keys, label and y_prob, the probability of class 1."""
    rows = inputs_table(features)
    return score_rounds(rows, [*_keys(rows), "label"], [model], [[len(model.trees)]]).drop("model", "rounds")


def evaluate(model: BoostedTrees, features: DataFrame) -> DataFrame:
    """(split, family, metric, value) of all splits; the model is applied once."""
    return all_metrics(stage(score(model, features), "scores"), "label", "y_prob", by=["split"])


def log_loss(label: Column, probability: Column) -> Column:
    """Mean logistic loss; probabilities are kept a little from 0 and 1."""
    p = F.least(F.greatest(probability, F.lit(1e-16)), F.lit(1 - 1e-16))
    return F.avg(-F.when(label == 1, F.log(p)).otherwise(F.log(1 - p)))


def training_curve(
    model: BoostedTrees, features: DataFrame, splits: tuple[str, ...] = ("train", "validation"), step: int = CURVE_STEP
) -> DataFrame:
    """(split, round, log_loss, error, auroc): how the model did on the evaluation sets after
    each ``step`` rounds and after the last one.

    One walk through the trees gives a row's probability at all of those rounds."""
    last = len(model.trees)
    marks = sorted({*range(step, last, step), last})
    rows = inputs_table(features.where(F.col("split").isin(*splits)))
    scored = score_rounds(rows, ["split", "label"], [model], [marks]).withColumnRenamed("rounds", "round")
    scored = stage(scored.drop("model"), "curve-scores")
    wrong = F.avg(((F.col("y_prob") > 0.5).cast("int") != F.col("label")).cast("int"))
    losses = scored.groupBy("split", "round").agg(
        log_loss(F.col("label"), F.col("y_prob")).alias("log_loss"), wrong.alias("error")
    )
    return losses.join(auroc(scored, "label", "y_prob", ["split", "round"]), ["split", "round"])


def expand_grid(grid: dict[str, list]) -> list[dict]:
    """All combinations; parameters by name, the last one varying fastest."""
    names = sorted(grid)
    return [dict(zip(names, values)) for values in itertools.product(*(grid[n] for n in names))]


def grid_search(
    features: DataFrame, grid: dict[str, list], at_once: int = AT_ONCE
) -> tuple[BoostedTrees, dict, DataFrame]:
    """Fit every setting on the train split and rate it on the validation split.

    The splits stay as they are (cross validation would cut questions apart). Settings are
    fitted side by side, ``at_once`` models in one pass over the rows; numbers of rounds
    share a model, and one pass over the validation rows scores all of them. Returns
    the best model, its settings, and a table (grid_idx, <parameters>, auroc, mrr, f1).
    The first setting wins among equals, and one has to beat an AUROC of 0.
    """
    spark = features.sparkSession
    settings = [_settings(s) for s in expand_grid(grid)]
    data = stage(inputs_table(features.where("split IN ('train', 'validation')")), "model-inputs")
    models = fit_side_by_side(data.where("split = 'train'"), MODEL_FEATURES, settings, at_once=at_once)
    check = data.where("split = 'validation'")
    rated: dict[int, dict] = {}
    for first in range(0, len(models), 4 * at_once):
        some = models[first : first + 4 * at_once]
        scored = score_rounds(check, ["pair_id", "question_id", "label"], *_longest(some))
        number = F.create_map(*[F.lit(x) for i, m in enumerate(_places(some)) for x in (m, first + i)])
        key = F.concat_ws("/", "model", "rounds")
        scored = scored.withColumn("grid_idx", F.element_at(number, key)).drop("model", "rounds")
        # Twelve numbers per setting.
        for r in all_metrics(stage(scored, "grid-scores"), "label", "y_prob", by=["grid_idx"]).collect():
            rated.setdefault(r["grid_idx"], {})[r["metric"]] = r["value"]
    best = max(rated, key=lambda i: (rated[i]["auroc"], -i), default=None)
    if best is None or rated[best]["auroc"] <= 0:
        raise ValueError("no setting reached an AUROC above 0")
    names = sorted(grid)
    table = spark.createDataFrame(
        [
            (i, *[float(settings[i][n]) for n in names], m["auroc"], m["mrr"], m["f1"])
            for i, m in sorted(rated.items())
        ],
        ["grid_idx", *names, "auroc", "mrr", "f1"],
    )
    return models[best], settings[best], table


def _kind(model: BoostedTrees) -> str:
    return json.dumps({k: v for k, v in model.settings.items() if k != "n_estimators"}, sort_keys=True)


def _longest(models: list[BoostedTrees]) -> tuple[list[BoostedTrees], list[list[int]]]:
    """The longest model of each kind, and the numbers of rounds that are asked of it."""
    longest: dict[str, BoostedTrees] = {}
    marks: dict[str, set] = {}
    for m in models:
        kind = _kind(m)
        if kind not in longest or len(m.trees) > len(longest[kind].trees):
            longest[kind] = m
        marks.setdefault(kind, set()).add(len(m.trees))
    return list(longest.values()), [sorted(marks[k]) for k in longest]


def _places(models: list[BoostedTrees]) -> list[str]:
    """Where ``_longest`` puts each model: "model/rounds"."""
    kinds = list(dict.fromkeys(_kind(m) for m in models))
    return [f"{kinds.index(_kind(m))}/{len(m.trees)}" for m in models]


def save_model(model: BoostedTrees, spark: SparkSession, path: str) -> None:
    """The trees as a table, and settings, inputs and bin edges as one JSON row."""
    nodes = "tree int, node int, input string, threshold double, gain double, value double"
    spark.createDataFrame(model.to_rows(), nodes).write.mode("overwrite").parquet(f"{path}/trees")
    about = json.dumps({"settings": model.settings, "inputs": model.inputs, "edges": model.edges})
    spark.createDataFrame([(about,)], "about string").write.mode("overwrite").json(f"{path}/about")


def load_model(spark: SparkSession, path: str) -> BoostedTrees:
    model = BoostedTrees(**json.loads(spark.read.json(f"{path}/about").first()["about"]))
    for r in sorted(spark.read.parquet(f"{path}/trees").collect(), key=lambda r: (r["tree"], r["node"])):
        while len(model.trees) <= r["tree"]:
            model.trees.append(Tree.unsplit())
        feature = model.inputs.index(r["input"]) if r["input"] is not None else -1
        cut = model.edges[feature].index(r["threshold"]) if feature >= 0 else 0
        model.trees[r["tree"]].place(
            {"node": r["node"], "feature": feature, "cut": cut, "gain": r["gain"], "value": r["value"], "left_value": 0.0, "right_value": 0.0}
        )
    return model


def importance_table(model: BoostedTrees, spark: SparkSession) -> DataFrame:
    """(feature, importance), adding up to 1: the mean gain of each input's splits."""
    return spark.createDataFrame(list(model.importance().items()), "feature string, importance double")


def top_features(importance: DataFrame, n: int = TOP_FEATURES) -> DataFrame:
    return importance.orderBy(F.desc("importance"), "feature").limit(n)
