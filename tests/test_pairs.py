import hashlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rankloom.operators.digest import sample_exact, seeded_digest, with_digest_index
from rankloom.operators.pairs import build_pairs, false_negatives, number_pairs, number_questions
from rankloom.operators.prefix import with_running_totals
from rankloom.operators.splits import (
    concat_splits,
    keep_questions,
    split_by_hash,
    split_by_question,
    split_leaks,
)


def qa(spark, n):
    return spark.range(n).selectExpr("concat('q_', id) AS question_id", "concat('what ', id) AS question", "concat('answer ', id) AS answer")


def test_pairs_per_question(spark):
    pairs = build_pairs(qa(spark, 50), 3)
    per_q = pairs.groupBy("question_id").agg(F.sum("label").alias("p"), F.count("*").alias("n")).collect()
    assert len(per_q) == 50 and all(r.p == 1 and r.n == 4 for r in per_q)
    assert pairs.where("label = 0 AND source_doc_question_id = question_id").isEmpty()
    assert pairs.where("concat('answer ', substring(source_doc_question_id, 3)) <> document").isEmpty()
    assert pairs.select("pair_id").distinct().count() == 200


def test_draws_are_uniform_over_the_others(spark):
    drawn = build_pairs(qa(spark, 20), 400).where("label = 0")
    counts = [r["count"] for r in drawn.groupBy("source_doc_question_id").count().collect()]
    assert len(counts) == 20 and sum(counts) == 8000
    assert all(300 < c < 500 for c in counts)


def test_other_text_draws_never_read_like_the_positive(spark):
    """A third of the questions share one answer."""
    source = qa(spark, 90).withColumn("answer", F.expr("if(int(substring(question_id, 3)) % 3 = 0, 'same', answer)"))
    pairs = build_pairs(source, 40, exclude_same_text=True)
    assert false_negatives(pairs).where("equal_to_positive > 0").isEmpty()
    assert not false_negatives(build_pairs(source, 40)).where("equal_to_positive > 0").isEmpty()
    negatives = pairs.where("label = 0")
    assert negatives.count() == 3600
    wrong = negatives.join(source.select(F.col("question_id").alias("source_doc_question_id"), "answer"), "source_doc_question_id")
    assert wrong.where("answer <> document").isEmpty()
    assert negatives.select("source_doc_question_id").distinct().count() == 90
    with pytest.raises(PySparkException):
        build_pairs(source.where("answer = 'same'"), 1, exclude_same_text=True).collect()


def test_two_questions_get_each_other(spark):
    rows = build_pairs(qa(spark, 2), 3).where("label = 0").collect()
    assert {(r.question_id, r.document) for r in rows} == {("q_0", "answer 1"), ("q_1", "answer 0")}


def test_pair_guards(spark):
    with pytest.raises(ValueError):
        build_pairs(qa(spark, 5), 0)
    with pytest.raises(ValueError):
        build_pairs(qa(spark, 5).drop("answer"))
    with pytest.raises(PySparkException):
        build_pairs(qa(spark, 1)).collect()


def test_results_do_not_depend_on_partitions(spark):
    def run(parts):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            pairs = split_by_question(build_pairs(qa(spark, 60).repartition(int(parts)), 2))
            return sorted(map(tuple, pairs.collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")

    assert run("1") == run("8")


def test_sequential_pair_ids(spark):
    pairs = build_pairs(qa(spark, 10), 2)
    ids = {r.pair_id for r in number_pairs(pairs).collect()}
    assert ids == {f"p_{i}" for i in range(30)}
    assert {r.pair_id for r in build_pairs(qa(spark, 10), 2, pair_ids="sequential").collect()} == ids


def test_question_numbers_follow_the_order_across_partitions(spark):
    shuffled = spark.range(5000).orderBy(F.rand(1)).repartition(16)
    rows = number_questions(shuffled, [F.col("id")]).collect()
    assert all(r.question_id == f"q_{r.id}" for r in rows) and len(rows) == 5000


def test_false_negative_audit(spark):
    df = spark.createDataFrame(
        [("a", "x", 1), ("a", "x", 0), ("a", "y", 0), ("a", "y", 0), ("b", "z", 1), ("b", "y", 0)],
        "question_id string, document string, label int",
    )
    rows = {r.question_id: tuple(r)[1:] for r in false_negatives(df).collect()}
    assert rows == {"a": (3, 1, 1), "b": (1, 0, 0)}


@pytest.mark.parametrize("n,expected", [(3000, (2099, 450, 451)), (10000, (6999, 1500, 1501)), (3, (2, 0, 1))])
def test_split_counts(spark, n, expected):
    pairs = qa(spark, n).select("question_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("label"))
    split = split_by_question(pairs)
    counts = {r.split: r.n for r in split.groupBy("split").agg(F.countDistinct("question_id").alias("n")).collect()}
    assert tuple(counts.get(s, 0) for s in ("train", "validation", "test")) == expected
    assert split_leaks(split).isEmpty()
    by_source = split_by_question(pairs, questions=qa(spark, n))
    assert split.exceptAll(by_source).isEmpty()
    assert split.count() == 2 * n


def test_split_joins_and_shuffles_no_pairs(spark):
    plan = split_by_question(qa(spark, 100))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lstrip().startswith("Project") and "Join" not in plan.split("scalar-subquery")[0]


def test_split_guards(spark):
    with pytest.raises(ValueError):
        split_by_question(qa(spark, 5), 0.5, 0.2, 0.2)
    with pytest.raises(ValueError):
        split_by_question(spark.range(5))
    with pytest.raises(Exception, match="at least 3 questions"):
        split_by_question(qa(spark, 2)).collect()


def test_hash_split_is_close_and_stable(spark):
    split = split_by_hash(qa(spark, 3000))
    counts = {r.split: r["count"] for r in split.groupBy("split").count().collect()}
    assert abs(counts["train"] - 2100) < 100
    before = {r.question_id: r.split for r in split.collect()}
    after = {r.question_id: r.split for r in split_by_hash(qa(spark, 3500)).collect()}
    assert all(after[q] == s for q, s in before.items())
    assert {r.split for r in split_by_hash(qa(spark, 50), 1.0, 0.0, 0.0).collect()} == {"train"}


def test_semi_join_and_concat(spark):
    pairs = build_pairs(qa(spark, 10), 1)
    some = qa(spark, 4)
    assert keep_questions(pairs, some).count() == 8
    stacked = concat_splits({"train": pairs, "test": pairs})
    assert stacked.columns[0] == "split" and stacked.count() == 40


def test_sample_is_exact_and_by_digest(spark):
    df = spark.range(5000).repartition(7)
    expected = sorted(range(5000), key=lambda i: hashlib.md5(f"42:sample:{i}".encode()).hexdigest())
    for n in (1, 777, 4999, 5000, 9000):
        got = {r.id for r in sample_exact(df, n, F.col("id")).collect()}
        assert got == set(expected[:n])
    assert sample_exact(df, 0, F.col("id")).count() == 5000


def test_sample_refuses_keys_shared_across_the_cut(spark):
    df = spark.range(100).selectExpr("id", "id % 2 AS k")
    with pytest.raises(PySparkException):
        sample_exact(df, 10, F.col("k")).collect()
    assert sample_exact(df, 50, F.col("k")).count() == 50


def test_digest_index(spark):
    df = spark.range(3000).withColumn("d", seeded_digest(7, "index", F.col("id")))
    rows = with_digest_index(df, "d", "id", "i").collect()
    assert [r.id for r in sorted(rows, key=lambda r: r.i)] == [r.id for r in sorted(rows, key=lambda r: (r.d, r.id))]
    assert sorted(r.i for r in rows) == list(range(3000))


def test_running_totals_per_group(spark):
    df = spark.range(2000).selectExpr("id % 3 AS g", "id AS k", "id % 7 AS v").repartition(11)
    rows = with_running_totals(df, [F.col("k").desc()], {"t": "v"}, ["g"], {"after": "k"}).collect()
    for g in range(3):
        total = 0
        mine = sorted((r for r in rows if r.g == g), key=lambda r: -r.k)
        for r, following in zip(mine, [*mine[1:], None]):
            total += r.v
            assert r.t == total and r.after == (following.k if following else None)
