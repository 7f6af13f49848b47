import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import rankloom.operators.boosting as boosting
from rankloom.constants import MODEL_DEFAULTS
from rankloom.operators.boosting import bin_edges, chosen_inputs, fit_side_by_side, score_rounds, uniform
from rankloom.operators.model import log_loss

INPUTS = ["a", "b", "c"]
SCHEMA = "id long, draw long, label int, a float, b float, c float"


def drawn(n, seed=1, values=20):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = (float(draw.randrange(values)) for _ in INPUTS)
        label = int(draw.random() < 1 / (1 + math.exp(-(8 * a - 6 * b) / values - (c > values / 2) + 1)))
        rows.append((i, draw.getrandbits(63), label, a, b, c))
    return rows


def settings(**kw):
    return {**MODEL_DEFAULTS, "n_estimators": 4, "max_depth": 3, **kw}


def flat(model):
    return model.to_rows()


def scores(spark, model, rows, rounds=None):
    found = score_rounds(spark.createDataFrame(rows, SCHEMA), ["id"], [model], [[rounds or len(model.trees)]])
    return {r.id: r.y_prob for r in found.collect()}


def naive(rows, setting):
    """Probabilities after all rounds, trees grown by trying every cut; no row or input sampling."""
    x = [r[3:] for r in rows]
    y = [r[2] for r in rows]
    w = [setting["scale_pos_weight"] if v else 1 for v in y]
    margin = [0.0] * len(rows)

    def grow(own, g, h, depth):
        total = lambda some: (sum(g[i] for i in some), sum(h[i] for i in some))
        fit = lambda s: s[0] ** 2 / (s[1] + 1)
        whole, best = total(own), (1e-6, None)
        for f in range(3) if depth < setting["max_depth"] else ():
            for cut in sorted({x[i][f] for i in own})[:-1]:
                left, right = [i for i in own if x[i][f] <= cut], [i for i in own if x[i][f] > cut]
                sums = total(left), total(right)
                gain = fit(sums[0]) + fit(sums[1]) - fit(whole)
                if min(sums[0][1], sums[1][1]) >= setting["min_child_weight"] and gain > best[0] + 1e-9:
                    best = (gain, (left, right))
        if best[1] is None:
            for i in own:
                margin[i] += -setting["learning_rate"] * whole[0] / (whole[1] + 1)
        else:
            for side in best[1]:
                grow(side, g, h, depth + 1)

    for _ in range(setting["n_estimators"]):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        grow(range(len(rows)), [(a - b) * c for a, b, c in zip(p, y, w)], [a * (1 - a) * c for a, c in zip(p, w)], 0)
    return {r[0]: 1 / (1 + math.exp(-m)) for r, m in zip(rows, margin)}


@pytest.mark.parametrize("kw", [{}, {"min_child_weight": 5, "learning_rate": 0.3, "scale_pos_weight": 1}])
def test_equals_trying_every_cut(spark, kw):
    # Few values, so that each has a bin of its own.
    rows, setting = drawn(300, values=8), settings(subsample=1.0, colsample_bytree=1.0, **kw)
    model = fit_side_by_side(spark.createDataFrame(rows, SCHEMA), INPUTS, [setting])[0]
    expected, found = naive(rows, setting), scores(spark, model, rows)
    assert found.keys() == expected.keys()
    assert all(found[i] == pytest.approx(expected[i], abs=1e-4) for i in found)


def test_levels_rows_and_partitions_give_the_same_trees(spark, monkeypatch):
    rows = spark.createDataFrame(drawn(400), SCHEMA)
    chosen = [settings(), settings(max_depth=5, scale_pos_weight=1)]
    whole = [flat(m) for m in fit_side_by_side(rows, INPUTS, chosen)]
    assert any(len(m) > 20 for m in whole)
    for packed, local_rows, data in ((50_000, 0, rows), (100, 60, rows.repartition(5)), (90, 10_000, rows.repartition(3, "a"))):
        monkeypatch.setattr(boosting, "PARTITION_ROWS", packed)
        assert [flat(m) for m in fit_side_by_side(data, INPUTS, chosen, local_rows=local_rows)] == whole


def test_a_small_table_takes_one_job_and_a_level_one_job(spark):
    rows, context = spark.createDataFrame(drawn(300), SCHEMA), spark.sparkContext
    for n, local_rows, most in ((0, 1_000, 8), (1, 50, 8 + 4 * 3)):
        context.setJobGroup(f"fit-{n}", "")
        fit_side_by_side(rows, INPUTS, [settings(), settings(scale_pos_weight=1)], local_rows=local_rows)
        assert len(context.statusTracker().getJobIdsForGroup(f"fit-{n}")) <= most
    context.setLocalProperty("spark.jobGroup.id", None)


def test_many_nodes_and_kept_margins_change_nothing(spark, monkeypatch):
    rows, chosen = spark.createDataFrame(drawn(150), SCHEMA).repartition(3), [settings(n_estimators=3), settings(max_depth=4)]
    whole = [flat(m) for m in fit_side_by_side(rows, INPUTS, chosen)]
    monkeypatch.setattr(boosting, "NODES_AT_ONCE", 3)
    monkeypatch.setattr(boosting, "STATE_ROUNDS", 2)
    for local_rows in (0, 1_000):
        assert [flat(m) for m in fit_side_by_side(rows, INPUTS, chosen, local_rows=local_rows)] == whole


def test_side_by_side_equals_fits_one_by_one(spark):
    rows = spark.createDataFrame(drawn(200), SCHEMA)
    chosen = [settings(n_estimators=n, max_depth=d, subsample=s) for n in (2, 5) for d in (2, 3) for s in (0.6, 1.0)]
    together = fit_side_by_side(rows, INPUTS, chosen, at_once=3)
    for setting, model in zip(chosen, together):
        assert model.settings == setting and len(model.trees) == setting["n_estimators"]
        assert flat(model) == flat(fit_side_by_side(rows, INPUTS, [setting])[0])


def test_margins_on_the_rows_change_nothing(spark, monkeypatch):
    rows = spark.createDataFrame(drawn(150), SCHEMA)
    whole = flat(fit_side_by_side(rows, INPUTS, [settings(n_estimators=7)])[0])
    monkeypatch.setattr(boosting, "STATE_ROUNDS", 2)
    assert flat(fit_side_by_side(rows, INPUTS, [settings(n_estimators=7)])[0]) == whole


def test_prefixes_are_the_models_of_fewer_rounds(spark):
    rows = drawn(200)
    data = spark.createDataFrame(rows, SCHEMA)
    long, short = fit_side_by_side(data, INPUTS, [settings(n_estimators=5), settings(n_estimators=2)])
    assert scores(spark, long, rows, 2) == scores(spark, short, rows)
    both = score_rounds(data, ["id", "label"], [long, short], [[1, 5], [0, 2]])
    assert both.groupBy("model", "rounds").count().count() == 4
    assert {r.y_prob for r in both.where("rounds = 0").collect()} == {0.5}


def test_odd_rows(spark):
    nan = float("nan")
    rows = drawn(80) + [(900, 1, 1, None, nan, 3.0), (901, None, None, nan, None, None), (900, 1, 1, None, nan, 3.0)]
    data = spark.createDataFrame(rows, SCHEMA)
    model = fit_side_by_side(data, INPUTS, [settings()])[0]
    found = score_rounds(data, ["id"], [model], [[4]]).collect()
    assert len(found) == len(rows) and all(0 < r.y_prob < 1 for r in found)
    for few in ([], rows[:1], [r for r in rows if r[2] == 0][:20], [(i, i, i % 2, 1.0, 1.0, 1.0) for i in range(10)]):
        model = fit_side_by_side(spark.createDataFrame(few, SCHEMA), INPUTS, [settings()])[0]
        assert len(model.trees) == 4 and all((t.feature == -1).all() for t in model.trees)
        assert 0 < scores(spark, model, rows[:1])[0] < 1 and sum(model.importance().values()) == 0


def test_bins_hold_equal_shares_and_sampling_is_by_row(spark):
    rows = spark.range(1000).select((F.col("id") % 500).cast("float").alias("x"), F.lit(None).cast("float").alias("y"))
    edges = bin_edges(rows, ["x", "y"], 10)
    assert edges[1] == [] and [round(e / 50) for e in edges[0]] == list(range(1, 10))
    draws = np.random.default_rng(0).integers(-(1 << 62), 1 << 62, 20_000)
    first, second = uniform(draws, 42, 0), uniform(draws, 42, 1)
    assert 0 <= first.min() and first.max() < 1 and abs(first.mean() - 0.5) < 0.01
    assert abs(np.corrcoef(first, second)[0, 1]) < 0.02 and (uniform(draws[::-1], 42, 0)[::-1] == first).all()
    picks = [tuple(chosen_inputs(settings(colsample_bytree=0.7), t, 17)) for t in range(5)]
    assert {sum(p) for p in picks} == {11} and len(set(picks)) > 1


def test_log_loss(spark):
    rows = [(1, 0.9), (0, 0.2), (1, 0.0), (0, 1.0)]
    found = spark.createDataFrame(rows, "label int, p double").agg(log_loss(F.col("label"), F.col("p")).alias("v")).first().v
    worst = -math.log(1e-16)
    assert found == pytest.approx((-math.log(0.9) - math.log(0.8) + worst - math.log(1 - (1 - 1e-16))) / 4, rel=0.3)


def test_many_models_are_grown_in_one_job_where_each_task_can_hold_the_rows(spark, monkeypatch):
    rows, context = spark.createDataFrame(drawn(300), SCHEMA), spark.sparkContext
    chosen = [settings(n_estimators=2, max_depth=2, scale_pos_weight=w) for w in range(1, context.defaultParallelism // 2 + 2)]
    monkeypatch.setattr(boosting, "LOCAL_ROWS", 50)
    context.setJobGroup("fit-many", "")
    many = [flat(m) for m in fit_side_by_side(rows, INPUTS, chosen)]
    assert len(context.statusTracker().getJobIdsForGroup("fit-many")) <= 8
    context.setLocalProperty("spark.jobGroup.id", None)
    monkeypatch.setattr(boosting, "HELD_ROWS", 50)
    assert [flat(m) for m in fit_side_by_side(rows, INPUTS, chosen)] == many


def test_inputs_counted_together_give_the_same_trees(spark, monkeypatch):
    # Enough rows for joint numbers at the first levels, and nodes on both sides of a chunk's end.
    rows, chosen = spark.createDataFrame(drawn(9_000, values=40), SCHEMA), [settings(max_depth=6)]
    whole = flat(fit_side_by_side(rows, INPUTS, chosen, local_rows=0)[0])
    assert len(whole) > 100
    for chunk in (700, 1 << 16):
        monkeypatch.setattr(boosting, "CHUNK_ROWS", chunk)
        assert flat(fit_side_by_side(rows, INPUTS, chosen)[0]) == whole


def test_fields_hold_every_input_once():
    widths = [5, 4, 0, 1, 5, 5, 1, 1, 3]
    numbers, wide, narrow = boosting._fields(widths)
    for fields, most in ((wide, 10), (narrow, 5)):
        assert sorted(i for f in fields for i, _, _ in f.inputs) == list(range(9)) and all(f.bits <= most for f in fields)
        for f in fields:
            for i, shift, bits in f.inputs:
                assert bits == widths[i] and (i, f.shift + shift) in numbers[f.group]
    draw = np.random.default_rng(3)
    bins = np.array([draw.integers(0, 1 << w, 500) for w in widths], np.uint8)
    codes = [sum(bins[i].astype(np.uint16) << s for i, s in n).astype(np.uint16) for n in numbers]
    first, second, ends = draw.integers(-9, 9, 500).astype(float), draw.integers(0, 9, 500).astype(float), np.array([0, 3, 200, 500])
    slot = np.repeat(np.arange(3), np.diff(ends))
    expected = boosting._sums(bins, slot, 3, first, second)
    assert all((boosting._node_sums(codes, f, 9, (first, second), ends) == expected).all() for f in (wide, narrow))
    assert (boosting._node_sums(codes, wide, 9, (first, second), ends[1:]) == expected[1:]).all()


def test_rows_end_where_the_splits_lead_them():
    tree, draw = boosting.Tree.unsplit(), np.random.default_rng(5)
    bins = draw.integers(0, 32, (200, 4)).astype(np.uint8)
    assert (tree.nodes(bins) == 1).all() and len(tree.nodes(bins[:0])) == 0
    splits = {1: (2, 15), 2: (0, 7), 3: (3, 20), 6: (1, 3), 13: (2, 30)}
    nodes = np.array(list(splits))
    found = {"node": nodes, "feature": np.array([f for f, _ in splits.values()]), "cut": np.array([c for _, c in splits.values()])}
    tree.put({**found, **{k: nodes * w for k, w in (("value", 1.0), ("gain", 1.0), ("left_value", 2.0), ("right_value", 2.5))}})

    def end(row, node=1):
        return end(row, 2 * node + int(row[splits[node][0]] > splits[node][1])) if node in splits else node

    for own in (bins, np.asfortranarray(bins)):
        assert tree.nodes(own).tolist() == [end(row) for row in bins]
    assert tree.value[[4, 5, 26, 27]].tolist() == [4.0, 5.0, 26.0, 32.5] and len(set(tree.nodes(bins))) > 4
