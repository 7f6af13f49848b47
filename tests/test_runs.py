import json

import pytest
from pyspark.sql import functions as F

from rankloom.constants import FULL_GRID, MODEL_FEATURES, QUICK_GRID
from rankloom.operators.model import expand_grid, importance_table, load_model, model_matrix, score, train
from rankloom.operators.digest import sample_exact
from rankloom.operators.splits import split_by_hash
from rankloom.plans.dataset import build_dataset
from rankloom.plans.retrieval import baseline_run, model_gain_run
from rankloom.plans.training import train_run, tuning_run
from rankloom.plans.views import pairs_view, qa_view
from rankloom.sources.readers import read_importance_json, read_metrics_json, read_records, read_split
from rankloom.sources.writers import write_csv, write_json
from rankloom.streaming.lexical import lexical_stream, read_pair_stream, write_feature_stream

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def dataset(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("data"))
    write_csv(qa_view(spark, FOLDER).select("question", "answer"), f"{root}/in.csv")
    tables = build_dataset(
        spark, "csv", f"{root}/in.csv", f"{root}/out", sample_size=30, negatives_per_question=3, multiline_csv=True
    )
    return root, tables


def test_dataset_run(spark, dataset):
    root, tables = dataset
    assert tables.qa.count() == 30 and tables.pairs.count() == 120 and tables.features.count() == 120
    assert {r.question_id for r in tables.qa.collect()} == {f"q_{i}" for i in range(30)}
    doc = tables.summary.first()
    assert doc.total_pairs == 120 and doc.sample_size_loaded == 30 and len(doc.feature_columns) == 11
    assert (doc.splits.train.unique_questions, doc.splits.validation.unique_questions, doc.splits.test.unique_questions) == (20, 5, 5)
    assert doc.splits.train.positive_rate == 0.25
    again = spark.read.option("header", True).csv(f"{root}/out/processed/features.csv", multiLine=True, escape='"')
    assert again.count() == 120 and again.columns == tables.features.columns
    saved = spark.read.json(f"{root}/out/processed/dataset_summary.json").first()
    assert saved.splits.test.rows == 20


def test_split_read_prunes_folders(spark, dataset):
    root, _ = dataset
    test_rows = read_split(spark, f"{root}/out/processed/features.parquet", "test")
    assert test_rows.count() == 20
    assert "PartitionFilters: [isnotnull(split" in test_rows._jdf.queryExecution().executedPlan().toString()


def test_training_and_retrieval_runs(spark, dataset):
    root, tables = dataset
    model, metrics = train_run(tables.features, f"{root}/model", n_estimators=3, max_depth=3)
    values = {(r.split, r.metric): r.value for r in metrics.collect()}
    assert len(values) == 36 and all(0 <= v <= 1 for v in values.values())
    assert values["train", "precision@1"] == pytest.approx(values["train", "ndcg@1"])
    importance = importance_table(model, spark).collect()
    assert [r.feature for r in importance] == MODEL_FEATURES
    assert sum(r.importance for r in importance) == pytest.approx(1.0)
    assert spark.read.json(f"{root}/model/feature_importance.json").count() == 17
    curve = {(r.split, r.round): r.auroc for r in spark.read.json(f"{root}/model/training_curve.json").collect()}
    assert curve == {("train", 3): pytest.approx(values["train", "auroc"]), ("validation", 3): pytest.approx(values["validation", "auroc"])}
    ours, read = (sorted(map(tuple, score(m, tables.features).collect())) for m in (model, load_model(spark, f"{root}/model/model")))
    assert ours == read
    rows = baseline_run(spark, f"{root}/out/processed/features.parquet", f"{root}/base").collect()
    assert {r.method for r in rows} == {"semantic", "bm25", "tfidf"}
    for r in rows:
        assert r["precision@1"] == r["ndcg@1"] and r["precision@3"] == r["precision@5"]


def test_tuning_run_picks_the_best_auroc(spark, dataset):
    root, tables = dataset
    grid = {"max_depth": [2, 3], "n_estimators": [2], "scale_pos_weight": [1, 3]}
    _, settings, results, metrics = tuning_run(tables.features, f"{root}/tuned", grid=grid)
    rows = results.orderBy("grid_idx").collect()
    assert len(rows) == 4 and metrics.select("split").distinct().count() == 1
    best = max(rows, key=lambda r: (r.auroc, -r.grid_idx))
    assert settings["max_depth"] == best.max_depth and settings["scale_pos_weight"] == best.scale_pos_weight


def test_model_parameters(spark, dataset):
    _, tables = dataset
    assert len(expand_grid(QUICK_GRID)) == 24 and len(expand_grid(FULL_GRID)) == 2916
    with pytest.raises(ValueError):
        train(tables.features, {"depth": 4})
    matrix = model_matrix(tables.features)
    assert [c for c in matrix.columns if c in MODEL_FEATURES] == MODEL_FEATURES
    assert matrix.where("isnan(bm25_score)").isEmpty()
    small = train(tables.features, {"n_estimators": 1, "max_depth": 2})
    assert len(small.trees) == 1 and small.settings["max_depth"] == 2 and small.settings["learning_rate"] == 0.1


def test_reader_guards_and_order(spark, tmp_path):
    with pytest.raises(ValueError):
        read_records(spark, "xml", "x")
    with pytest.raises(ValueError):
        read_records(spark, "csv", None)
    with pytest.raises(FileNotFoundError):
        read_records(spark, "csv", str(tmp_path / "none.csv"))
    (tmp_path / "a.csv").write_text('id,question,answer\n1,"two\nlines","say ""hi"""\n2,plain,\n')
    rows = read_records(spark, "csv", str(tmp_path / "a.csv"), multiline_csv=True).orderBy("_load_order").collect()
    assert [(r.id, r.question, r.answer) for r in rows] == [("1", "two\nlines", 'say "hi"'), ("2", "plain", None)]
    (tmp_path / "b.jsonl").write_text("".join(json.dumps({"id": i, "answer": ["x", {"text": i}][i % 2]}) + "\n" for i in range(50)))
    records = read_records(spark, "jsonl", str(tmp_path / "b.jsonl"), irregular=["answer"], sample_size=10)
    assert records.count() == 10 and dict(records.dtypes)["answer"] == "struct<_json_text:string>"


@pytest.mark.parametrize("source", ["parquet", "jsonl"])
def test_a_sample_does_not_depend_on_folders_or_file_splits(spark, tmp_path, source):
    df = spark.range(5000).selectExpr("id % 2500 AS id", "concat('t', id % 2500) AS text").repartition(1)
    for name in ("a", "b"):
        folder = tmp_path / name
        (df.write.parquet if source == "parquet" else df.write.json)(str(folder))
        if name == "b":  # the same file in another folder
            for old in folder.glob("part-*"):
                old.unlink()
            for part in (tmp_path / "a").glob("part-*"):
                (folder / part.name).write_bytes(part.read_bytes())
    found = []
    for name, size in (("a", "128m"), ("b", "20k")):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = read_records(spark, source, str(tmp_path / name), sample_size=300)
            found.append(sorted(r.id for r in rows.collect()))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(found[0]) == 300 and found[0] == found[1]


def test_a_sample_keeps_the_fractions_of_the_hash_split(spark):
    rows = spark.range(10_000).selectExpr("concat('q', id) AS question_id")
    split = split_by_hash(sample_exact(rows, 2000, F.col("question_id")))
    n = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    assert abs(n["train"] - 1400) < 100 and abs(n["test"] - 300) < 70


def test_model_gain_run_joins_test_metrics_with_baselines(spark, tmp_path):
    rows = [("test", f"q{g}", f"p{g}{i}", int(i == 0), 0.1 * i, 0.2, -0.1 * i) for g in range(5) for i in range(3)]
    names = "split string, question_id string, pair_id string, label int, semantic_cosine_similarity double, bm25_score double, tfidf_similarity double"
    spark.createDataFrame(rows, names).write.partitionBy("split").parquet(str(tmp_path / "f.parquet"))
    ours = spark.createDataFrame([("test", "ranking", "mrr", 0.9), ("train", "ranking", "mrr", 1.0)], "split string, family string, metric string, value double")
    gain = {r.method: r.gain for r in model_gain_run(spark, str(tmp_path / "f.parquet"), ours, str(tmp_path)).collect()}
    assert gain["tfidf"] == pytest.approx(-0.1) and gain["semantic"] == pytest.approx(0.9 - 1 / 3)


def test_metric_files_round_trip(spark, tmp_path):
    doc = {"train": {"classification": {"f1": 0.5}, "ranking": {"ndcg@3": 0.9}}, "params": {"max_depth": 6}}
    (tmp_path / "m.json").write_text(json.dumps(doc, indent=2))
    rows = {tuple(r) for r in read_metrics_json(spark, str(tmp_path / "m.json")).collect()}
    assert rows == {("train", "classification", "f1", 0.5), ("train", "ranking", "ndcg@3", 0.9)}
    (tmp_path / "i.json").write_text(json.dumps({"b": 0.7, "a": 0.3}))
    assert {tuple(r) for r in read_importance_json(spark, str(tmp_path / "i.json")).collect()} == {("a", 0.3), ("b", 0.7)}
    write_json(spark.range(2).selectExpr("id", "IF(id = 1, NULL, id) AS v"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).columns == ["id", "v"]


def test_stream_gives_the_batch_features(spark, tmp_path):
    pairs = pairs_view(spark, FOLDER)
    pairs.write.parquet(str(tmp_path / "in"))
    stream = lexical_stream(read_pair_stream(spark, str(tmp_path / "in"), pairs.schema))
    write_feature_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    streamed = spark.read.parquet(str(tmp_path / "out"))
    batch = lexical_stream(pairs).select(streamed.columns)
    assert sorted(map(str, streamed.collect())) == sorted(map(str, batch.collect()))
