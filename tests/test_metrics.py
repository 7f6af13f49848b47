import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankloom.operators import classification as c
from rankloom.operators import ranking
from rankloom.operators.baseline import compare_baselines, metric_gain, pivot_splits, single_score_baseline

SCHEMA = "question_id string, pair_id string, label int, y_prob double"


def naive(rows, k_values=(1, 3, 5)):
    """Metrics of one question's rows (pair_id, label, score)."""
    ordered = sorted(rows, key=lambda r: (r[2] is None or math.isnan(r[2]), -(r[2] or 0) if r[2] is not None and not math.isnan(r[2]) else 0, r[0]))
    labels = [r[1] for r in ordered]
    ideal = sorted(labels, reverse=True)
    dcg = lambda xs: sum(x / math.log2(i + 2) for i, x in enumerate(xs))
    hits = [i for i, x in enumerate(labels) if x == 1]
    out = {"rr": 1 / (hits[0] + 1) if hits else 0.0}
    for k in k_values:
        out[f"precision@{k}"] = sum(labels[:k]) / min(k, len(labels))
        out[f"dcg@{k}"] = dcg(labels[:k])
        best = dcg(ideal[:k])
        out[f"ndcg@{k}"] = dcg(labels[:k]) / best if best else 0.0
    return out


def check(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.question_id: r.asDict() for r in ranking.question_metrics(df, **options).collect()}
    groups = {}
    for q, p, label, s in rows:
        if q is not None:
            groups.setdefault(q, []).append((p, label, s))
    assert set(got) == set(groups)
    for q, members in groups.items():
        assert got[q]["n"] == len(members)
        for name, value in naive(members).items():
            assert got[q][name] == pytest.approx(value, abs=1e-12), (q, name)


def random_rows(seed=3, groups=12, graded=False):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        for i in range(int(rng.integers(1, 40 if g else 400))):
            score = float(rng.integers(0, 6)) / 5
            score = None if rng.random() < 0.05 else math.nan if rng.random() < 0.05 else score
            rows.append((f"g{g}", f"p{rng.integers(0, 10**9)}_{i}", int(rng.integers(0, 3 if graded else 2) if rng.random() < 0.3 else 0), score))
    rows.append((None, "pn", 1, 0.5))
    return rows


@pytest.mark.parametrize("graded", [False, True])
def test_question_metrics(spark, graded):
    check(spark, random_rows(graded=graded))


@pytest.mark.parametrize("graded", [False, True])
def test_reduced_and_whole_groups_agree(spark, graded):
    df = spark.createDataFrame(random_rows(seed=5, graded=graded), SCHEMA)
    both = [sorted(map(str, ranking.question_metrics(df, small_groups=s).collect())) for s in (False, True)]
    assert both[0] == both[1]


def test_known_values(spark):
    rows = [("q", f"p{i}", y, s) for i, (y, s) in enumerate([(0, 0.9), (1, 0.8), (0, 0.7), (0, 0.1)])]
    r = ranking.question_metrics(spark.createDataFrame(rows, SCHEMA)).first()
    assert r.rr == 0.5 and r["precision@1"] == 0 and r["precision@3"] == pytest.approx(1 / 3)
    assert r["precision@5"] == 0.25 and r["ndcg@1"] == 0 and r["ndcg@3"] == pytest.approx(0.63093, abs=1e-5)


def test_one_positive_first_rank_metrics_agree(spark):
    rows = [(f"q{g}", f"p{g}{i}", int(i == 0), ((g * 7 + i * 5) % 11) / 11) for g in range(30) for i in range(4)]
    m = ranking.ranking_metrics(spark.createDataFrame(rows, SCHEMA)).first()
    assert m["precision@1"] == pytest.approx(m["ndcg@1"])
    assert all(0 <= v <= 1 for v in m)


def test_top_k_prunes_before_the_shuffle(spark):
    df = spark.createDataFrame(random_rows(), SCHEMA).where("question_id IS NOT NULL")
    kept = ranking.top_k(df, "y_prob", 3, ["question_id"])
    assert "WindowGroupLimit" in kept._jdf.queryExecution().executedPlan().toString()
    assert max(r["count"] for r in kept.groupBy("question_id").count().collect()) <= 3
    assert not kept.where("isnan(y_prob) AND question_id = 'g0'").count()


def test_ranking_shuffles_once_for_small_groups(spark):
    df = spark.createDataFrame(random_rows(), SCHEMA)
    plan = ranking.question_metrics(df, small_groups=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_baseline_drops_what_it_does_not_retrieve(spark):
    rows = [("q", f"p{i}", int(i == 3), 1 - i / 10) for i in range(4)] + [("r", "p9", 1, math.nan)]
    df = spark.createDataFrame(rows, SCHEMA)
    m = single_score_baseline(df.where("question_id = 'q'"), "y_prob", 3).first()
    assert all(v == 0 for v in m)
    full = ranking.ranking_metrics(df.where("question_id = 'q'")).first()
    assert full["mrr"] == 0.25
    with pytest.raises(ValueError):
        single_score_baseline(df, "nothing")
    both = compare_baselines(df.withColumn("b", -F.col("y_prob")), {"a": "y_prob", "b": "b"}).collect()
    assert {r.method for r in both} == {"a", "b"}
    one = compare_baselines(df, {"a": "y_prob"}).drop("method")
    assert metric_gain(one, one).where("gain <> 0").isEmpty()


def pairwise_auc(rows):
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    if not pos or not neg:
        return 0.0
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def scored(spark, rows):
    return spark.createDataFrame(rows, "label int, y_prob double")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 8).map(lambda i: i / 8)), min_size=1, max_size=40))
def test_auroc_is_the_pairwise_share(spark, rows):
    got = c.classification_metrics(scored(spark, rows), "label", "y_prob").first()
    assert got.auroc == pytest.approx(pairwise_auc(rows), abs=1e-12)
    tp = sum(y == 1 and s >= 0.5 for y, s in rows)
    fp = sum(y == 0 and s >= 0.5 for y, s in rows)
    fn = sum(y == 1 and s < 0.5 for y, s in rows)
    assert got.precision == pytest.approx(tp / (tp + fp) if tp + fp else 0)
    assert got.recall == pytest.approx(tp / (tp + fn) if tp + fn else 0)
    assert got.accuracy == pytest.approx(1 - (fp + fn) / len(rows))


def test_metrics_by_group(spark):
    rows = [("a", 1, 0.9), ("a", 0, 0.1), ("b", 0, 0.9), ("b", 1, 0.1), ("c", 1, 0.5)]
    df = spark.createDataFrame(rows, "split string, label int, y_prob double")
    got = {r.split: r for r in c.classification_metrics(df, "label", "y_prob", by=["split"]).collect()}
    assert got["a"].auroc == 1.0 and got["b"].auroc == 0.0 and got["c"].auroc == 0.0
    assert got["b"].precision == 0 and got["b"].f1 == 0 and got["c"].accuracy == 1.0


def test_confusion_matrix_has_empty_cells(spark):
    df = scored(spark, [(1, 0.9), (1, 0.8), (0, 0.7)]).withColumn("y_pred", c.decide(F.col("y_prob")))
    got = {(r.label, r.predicted): r.n for r in c.confusion_matrix(df, "label", "y_pred").collect()}
    assert got == {(0, 0): 0, (0, 1): 1, (1, 0): 0, (1, 1): 2}


def test_histogram_equals_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(int(y), float(s)) for y, s in zip(rng.integers(0, 2, 500), np.round(rng.random(500), 2))]
    got = c.score_histogram(scored(spark, rows), "label", "y_prob").orderBy("label", "bin").collect()
    for label in (0, 1):
        counts, edges = np.histogram([s for y, s in rows if y == label], bins=50)
        mine = [r for r in got if r.label == label]
        assert [r.n for r in mine] == counts.tolist()
        assert np.allclose([r.lower for r in mine], edges[:-1])
    flat = c.score_histogram(scored(spark, [(1, 0.5)] * 4), "label", "y_prob").where("n > 0").collect()
    counts, _ = np.histogram([0.5] * 4, bins=50)
    assert [(r.bin, r.n) for r in flat] == [(int(np.argmax(counts)), 4)]


def test_curves(spark):
    rows = [(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.3)]
    roc = {r.threshold: (r.fpr, r.tpr) for r in c.roc_curve(scored(spark, rows), "label", "y_prob").collect()}
    assert roc == {math.inf: (0.0, 0.0), 0.9: (0.0, 0.5), 0.8: (0.5, 1.0), 0.3: (1.0, 1.0)}
    pr = {r.threshold: (r.precision, r.recall) for r in c.pr_curve(scored(spark, rows), "label", "y_prob").collect()}
    assert pr == {0.9: (1.0, 0.5), 0.8: (pytest.approx(2 / 3), 1.0), 0.3: (0.5, 1.0), None: (1.0, 0.0)}
    best = c.best_threshold(c.threshold_sweep(scored(spark, rows), "label", "y_prob")).first()
    assert best.threshold == 0.8 and best.f1 == pytest.approx(0.8)
    strict = c.best_threshold(c.threshold_sweep(scored(spark, rows), "label", "y_prob"), 0.9).first()
    assert strict.threshold == 0.9


def test_roc_leaves_out_points_on_a_line(spark):
    rows = [(1, 0.9), (1, 0.8), (1, 0.7), (0, 0.6), (0, 0.5), (1, 0.4), (0, 0.3)]
    kept = {r.threshold for r in c.roc_curve(scored(spark, rows), "label", "y_prob").collect()}
    assert kept == {math.inf, 0.9, 0.7, 0.5, 0.4, 0.3}
    every = c.roc_curve(scored(spark, rows), "label", "y_prob", drop_intermediate=False)
    assert every.count() == 8


def test_pivot(spark):
    long = spark.createDataFrame([("train", "f1", 0.5), ("test", "f1", 0.4)], "split string, metric string, value double")
    assert pivot_splits(long, ["train", "validation", "test"]).first().asDict() == {"metric": "f1", "train": 0.5, "validation": None, "test": 0.4}
