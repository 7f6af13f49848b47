import math
import time
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.functions.text import text_key
from rankloom.functions.text import with_shared_terms
from rankloom.operators import skew
from rankloom.operators.bm25 import with_bm25
from rankloom.operators.features import FeatureOptions, feature_columns, feature_table
from rankloom.operators.semantic import encode_texts, vector_cosines
from rankloom.operators.tfidf import with_tfidf
from rankloom.plans.views import opened_qa_view, pairs_view

FOLDER = "/root/testdata/sf0.001"


def words(s):
    return re.findall(r"\b\w+\b", s.lower())


def naive_bm25(question, doc, corpus):
    docs = [words(d) for d in corpus]
    n, avgdl = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(t for d in docs for t in set(d))
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: floor if v < 0 else v for t, v in idf.items()}
    d = Counter(words(doc))
    dl = len(words(doc))
    return sum(
        idf.get(t, 0) * d[t] * 2.5 / (d[t] + 1.5 * (0.25 + 0.75 * dl / avgdl)) for t in words(question)
    )


def gram_list(s):
    w = re.findall(r"\b\w\w+\b", s.lower())
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def naive_tfidf(question, doc, texts):
    df = Counter(g for t in texts for g in set(gram_list(t)))
    idf = {g: math.log((1 + len(texts)) / (1 + c)) + 1 for g, c in df.items()}

    def vector(s):
        v = {g: c * idf[g] for g, c in Counter(gram_list(s)).items() if g in idf}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {g: x / size for g, x in v.items()} if size else {}

    q, d = vector(question), vector(doc)
    return sum(x * d.get(g, 0) for g, x in q.items())


def toy(spark):
    rows = [
        ("p1", "a", "the cat sat", "the cat sat on the mat", 1),
        ("p2", "a", "the cat sat", "a dog in the fog", 0),
        ("p3", "b", "the the dog", "a dog in the fog", 1),
        ("p4", "b", "the the dog", "unrelated words only", 0),
        ("p5", "c", "", "", 0),
        ("p6", "c", "x y", "x y", 1),
    ]
    return spark.createDataFrame(rows, "pair_id string, question_id string, question string, document string, label int")


@pytest.fixture(params=["cold", "hot"])
def heat(request, monkeypatch):
    """Once as is, once with every frequent key treated as hot."""
    if request.param == "hot":
        for function in (skew.hot_keys, skew.largest):
            monkeypatch.setattr(function, "__defaults__", (2,))
    return request.param


def test_bm25_against_naive(spark, heat):
    for pairs in (toy(spark), pairs_view(spark, FOLDER)):
        rows = with_bm25(pairs).collect()
        corpus = list(dict.fromkeys(r.document for r in rows))
        assert len(rows) == pairs.count()
        for r in rows:
            assert r.bm25_score == pytest.approx(naive_bm25(r.question, r.document, corpus), abs=1e-9)


def test_bm25_reference_corpus_and_switch(spark, heat):
    corpus = spark.createDataFrame([("the  cat sat on the mat",), ("x y",), ("x y",)], "document string")
    rows = {r.pair_id: r.bm25_score for r in with_bm25(toy(spark), corpus).collect()}
    known = ["the cat sat on the mat", "x y"]
    assert rows["p1"] == pytest.approx(naive_bm25("the cat sat", known[0], known))
    assert rows["p6"] == pytest.approx(naive_bm25("x y", "x y", known))
    assert all(math.isnan(rows[p]) for p in ("p2", "p3", "p4", "p5"))
    assert all(math.isnan(r.bm25_score) for r in with_bm25(toy(spark), enabled=False).collect())


def test_tfidf_against_naive(spark, heat):
    for pairs in (toy(spark), pairs_view(spark, FOLDER)):
        rows = with_tfidf(pairs).collect()
        texts = [r.question for r in rows] + [r.document for r in rows]
        assert len(rows) == pairs.count()
        for r in rows:
            assert r.tfidf_similarity == pytest.approx(naive_tfidf(r.question, r.document, texts), abs=1e-9)


def test_tfidf_other_corpus_ignores_unknown_grams(spark, heat):
    fit = spark.createDataFrame([("the cat",), ("the dog",), ("the dog",)], "text string")
    for r in with_tfidf(toy(spark), fit).collect():
        expected = naive_tfidf(r.question, r.document, ["the cat", "the dog", "the dog"])
        assert r.tfidf_similarity == pytest.approx(expected, abs=1e-12)


def test_salted_lookup_equals_join_with_one_hot_key(spark):
    rows = spark.range(9000).selectExpr("id", "IF(id % 3 = 0, 0, id) AS k")
    table = spark.range(0, 9000, 2).selectExpr("id AS k", "id * 10 AS v")
    hot = skew.hot_keys(rows, ["k"], target=1000)
    assert [tuple(r) for r in hot.collect()] == [(0, 3)]
    for how in ("left", "inner"):
        salted = skew.salted_lookup(rows, table, ["k"], spread="id", how=how, hot=hot)
        assert sorted(map(tuple, salted.select("id", "k", "v").collect()), key=str) == sorted(
            map(tuple, rows.join(table, "k", how).select("id", "k", "v").collect()), key=str
        )


def test_any_number_of_keys_may_be_hot(spark):
    """Equal counts, and more hot keys than any fixed limit would keep."""
    rows = spark.range(30_000).selectExpr("id", "id % 3000 AS k")
    hot = skew.hot_keys(rows, ["k"], target=4)
    assert hot.count() == 3000 and hot.agg(F.max("salts")).first()[0] == 3
    table = spark.range(3000).selectExpr("id AS k", "id * 2 AS v")
    joined = skew.salted_lookup(rows, table, ["k"], spread="id", how="inner", hot=hot)
    assert joined.count() == 30_000 and joined.where("v <> k * 2").isEmpty()


def test_shared_terms_of_long_rows_take_linear_time(spark):
    words = " ".join(f"w{i}" for i in range(16_000))
    df = spark.createDataFrame([(words, words + " w0")], "question string, document string")
    rows = with_shared_terms(df.selectExpr("split(question, ' ') AS q", "split(document, ' ') AS d"), "q", "d", "s")
    began = time.time()
    shared = rows.select(F.size("s"), F.expr("filter(s, x -> x.value = 'w0')")).first()
    assert shared[0] == 16_000 and [tuple(x) for x in shared[1]] == [("w0", 2, 1)]
    assert time.time() - began < 10


def test_empty_reference_corpora_fall_back(spark):
    empty = spark.createDataFrame([], "document string, text string")
    own = {r.pair_id: (r.bm25_score, r.tfidf_similarity) for r in with_tfidf(with_bm25(toy(spark))).collect()}
    back = with_tfidf(with_bm25(toy(spark), empty), empty.select("text"), texts=toy(spark))
    assert {r.pair_id: (r.bm25_score, r.tfidf_similarity) for r in back.collect()} == own


def test_hot_rows_are_spread(spark):
    rows = spark.range(9000).selectExpr("id", "IF(id % 3 = 0, 0, id) AS k")
    hot = skew.hot_keys(rows, ["k"], target=200)
    table = spark.range(9000).selectExpr("id AS k", "id AS v")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        joined = skew.salted_lookup(rows, table, ["k"], spread="id", how="inner", hot=hot)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes) < 9000 / 8 * 1.5


def test_vector_cosines(spark, heat):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0])], "k int, embedding array<float>")
    pairs = spark.createDataFrame([("a", 1, 2), ("b", 1, 3), ("c", 1, 9), ("d", 2, 2)], "pair_id string, q int, d int")
    for batched in (False, True):
        scored = vector_cosines(pairs, vectors, "q", "d", "k", batched=batched)
        got = {r.pair_id: r.semantic_cosine_similarity for r in scored.collect()}
        assert got["a"] == pytest.approx(math.sqrt(0.5)) and got["b"] == 0.0
        assert got["c"] is None and got["d"] == pytest.approx(1.0)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def letters(texts: pd.Series) -> pd.Series:
    return texts.map(lambda s: [float(s.count(c)) for c in "aeiou"])


def test_encoder_plug_point_and_feature_order(spark):
    table = feature_table(toy(spark).withColumn("extra", F.lit(7)), FeatureOptions(encoder=letters, named_entities=True))
    assert table.columns[:6] == ["pair_id", "question_id", "question", "document", "label", "semantic_cosine_similarity"]
    assert table.columns[-1] == "extra"
    row = table.where("pair_id = 'p1'").first()
    a, b = ([float(s.count(c)) for c in "aeiou"] for s in (row.question, row.document))
    expected = np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))
    assert row.semantic_cosine_similarity == pytest.approx(expected)
    assert row.similarity_times_doc_length == pytest.approx(expected * 6)
    assert "extra" in feature_columns(table)
    assert encode_texts(toy(spark).select(F.col("document").alias("text")), letters).count() == 5
    assert text_key is not None


def test_feature_table_guards_and_defaults(spark):
    with pytest.raises(ValueError):
        feature_table(toy(spark).drop("label"))
    rows = feature_table(toy(spark), FeatureOptions(bm25=False)).collect()
    assert all(math.isnan(r.bm25_score) and r.semantic_cosine_similarity == 0 and r.named_entity_count == 0 for r in rows)
    empty = next(r for r in rows if r.pair_id == "p5")
    assert (empty.token_overlap, empty.token_overlap_ratio, empty.normalized_overlap) == (0, 0.0, 0.0)


def test_source_table_gives_the_same_scores(spark):
    source = opened_qa_view(spark, FOLDER).select("question_id", "question", "answer")
    pairs = pairs_view(spark, FOLDER)
    columns = ["pair_id", "bm25_score", "tfidf_similarity"]
    plain = {r[0]: r[1:] for r in feature_table(pairs).select(columns).collect()}
    short = {r[0]: r[1:] for r in feature_table(pairs, qa=source).select(columns).collect()}
    assert plain.keys() == short.keys()
    for key, values in plain.items():
        assert short[key] == pytest.approx(values, abs=1e-12)
