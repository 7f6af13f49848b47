import math

import pytest
from pyspark.sql import functions as F

from rankloom.operators import bm25, statistics, tfidf, vector_store
from rankloom.operators.semantic import with_semantic

PAIRS = "pair_id string, question string, document string"


def pairs(spark):
    rows = [("1", "red fox", "the red fox"), ("2", "red fox", "a blue sea"), ("3", "blue", "never added blue"), ("4", None, None)]
    return spark.createDataFrame(rows, PAIRS)


def docs(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "document string")


ALL = ["the red fox", "a  blue sea", "the sea", "The red fox", None, "red red sky"]


def table(df, *columns):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect()), key=str)


def test_documents_in_batches_equal_one_corpus(spark, tmp_path):
    path = str(tmp_path / "s")
    for batch in (ALL[:3], ALL[1:], [], ALL):
        statistics.add_documents(docs(spark, *batch), path)
    corpus = bm25.corpus_table(docs(spark, *ALL))
    assert table(statistics.saved_term_weights(spark, path), "term", "df", "idf") == table(bm25.term_weights(corpus), "term", "df", "idf")
    ours = {r.pair_id: r.bm25_score for r in statistics.with_saved_bm25(pairs(spark), path).collect()}
    whole = {r.pair_id: r.bm25_score for r in bm25.with_bm25(pairs(spark), docs(spark, *ALL)).collect()}
    assert math.isnan(ours.pop("3")) and math.isnan(whole.pop("3")) and ours == pytest.approx(whole)


def test_fit_texts_in_batches_equal_one_fit(spark, tmp_path):
    path = str(tmp_path / "s")
    texts = [*ALL, "red fox", "red fox"]
    for batch in (texts[:4], texts[4:]):
        statistics.add_fit_texts(docs(spark, *batch), path, "document")
    fit = docs(spark, *texts).withColumnRenamed("document", "text")
    saved = statistics.saved_gram_weights(spark, path)
    assert table(saved, "gram", "df", "idf") == table(tfidf.gram_weights(fit), "gram", "df", "idf")
    ours, whole = tfidf.with_tfidf(pairs(spark), weights=saved), tfidf.with_tfidf(pairs(spark), fit)
    assert table(ours, "pair_id", "tfidf_similarity") == table(whole, "pair_id", "tfidf_similarity")


def test_counts_of_a_run_that_failed_are_not_read(spark, tmp_path):
    path = str(tmp_path / "s")
    statistics.add_documents(docs(spark, *ALL), path)
    before = table(statistics.saved_term_weights(spark, path), "term", "df", "idf")
    for name, columns in (("counts", "'red' AS item, 5L AS df, 5L AS n_texts"), ("documents", "unhex(md5('lost')) AS doc_key")):
        spark.range(1).selectExpr(*columns.split(", ")[:3], "'lost' AS batch").write.mode("append").partitionBy("batch").parquet(f"{path}/{name}")
    assert table(statistics.saved_term_weights(spark, path), "term", "df", "idf") == before
    statistics.add_documents(docs(spark, "lost"), path)
    assert "lost" in {r.term for r in statistics.saved_term_weights(spark, path).collect()}


def test_nothing_saved(spark, tmp_path):
    path = str(tmp_path / "none")
    assert statistics.saved_term_weights(spark, path).collect() == [] == statistics.saved_gram_weights(spark, path).collect()
    assert all(math.isnan(r.bm25_score) for r in statistics.with_saved_bm25(pairs(spark), path).collect())


def test_each_text_is_encoded_once(spark, tmp_path):
    path, ran = str(tmp_path / "v"), []
    # Fails on any text that was encoded before.
    def encoder(allowed):
        ran.append(allowed)
        return lambda text: F.when(text.isin(allowed), F.array(F.length(text), F.ascii(text))).otherwise(F.raise_error(text))

    texts = lambda *t: spark.createDataFrame([(x,) for x in t], "text string")
    assert vector_store.stored_vectors(spark, path, "e1").collect() == []
    first = vector_store.add_texts(texts("a", "bb", " bb ", None), encoder(["a", "bb", ""]), "e1", path)
    assert first.count() == 3
    assert vector_store.add_texts(texts("bb", "ccc", "a"), encoder(["ccc"]), "e1", path).count() == 4
    assert vector_store.add_texts(texts("bb", "ccc"), encoder([]), "e1", path).count() == 4
    assert vector_store.add_texts(texts("a"), encoder(["a"]), "e2", path).count() == 1
    assert vector_store.missing_texts(texts(), first).collect() == []
    with pytest.raises(ValueError):
        vector_store.stored_vectors(spark, path, "../x")
    scored = with_semantic(spark.createDataFrame([("1", "a", "a"), ("2", "a", "none")], PAIRS), first)
    assert table(scored, "pair_id", "semantic_cosine_similarity") == [("1", 1.0), ("2", 0.0)]


def test_a_run_that_fails_leaves_the_store_as_it_was(spark, tmp_path):
    path = str(tmp_path / "v")
    texts = spark.createDataFrame([(f"t{i}",) for i in range(40)], "text string").repartition(8)
    good = lambda text: F.array(F.length(text))
    vector_store.add_texts(texts.where("text < 't2'"), good, "e", path)
    before = vector_store.stored_vectors(spark, path, "e").count()
    with pytest.raises(Exception):
        vector_store.add_texts(texts, lambda text: F.when(text == "t39", F.array(F.raise_error(F.lit("lost")).cast("int"))).otherwise(good(text)), "e", path).count()
    assert vector_store.stored_vectors(spark, path, "e").count() == before
    assert vector_store.add_texts(texts, good, "e", path).count() == 40


def test_single_scores_are_those_of_the_feature_table(spark):
    from rankloom.operators.features import feature_table, score_table

    rows = [("1", "q1", "red fox", "the red  fox", 1), ("2", "q1", "red fox", "a blue sea", 0), ("3", "q2", None, "red", 0)]
    data = spark.createDataFrame(rows, "pair_id string, question_id string, question string, document string, label int")
    names = ["tfidf_similarity", "bm25_score", "semantic_cosine_similarity"]
    whole = feature_table(data)
    for some in (names, names[:1], names[1:2], []):
        assert table(score_table(data, some), "pair_id", "question_id", "label", *some) == table(whole, "pair_id", "question_id", "label", *some)
    with pytest.raises(ValueError):
        score_table(data, ["token_overlap"])


def test_grams_are_kept_as_lists(spark, tmp_path):
    """Few rows per batch whatever the number of grams; those of a failed run are not read."""
    path = str(tmp_path / "s")
    texts = [" ".join(f"w{i}x{j}" for j in range(400)) for i in range(20)]
    for batch in (texts[:12], texts[12:] + texts[:3]):
        statistics.add_fit_texts(docs(spark, *batch), path, "document")
    kept = spark.read.parquet(f"{path}/grams")
    assert kept.groupBy("batch", "part").count().where("count > 1").isEmpty()
    assert kept.selectExpr("sum(size(split(items, '\n')))").first()[0] == (12 + 11) * (400 + 399) and kept.count() <= 2 * 2048
    spark.range(1).selectExpr("0 AS part", "'lost' AS items", "X'0100000000000000' AS df", "X'0100000000000000' AS n_texts", "'lost' AS batch").write.mode(
        "append"
    ).partitionBy("batch").parquet(f"{path}/grams")
    saved = {r.gram: (r.df, r.n_texts) for r in statistics.saved_gram_weights(spark, path).collect()}
    assert saved == {g: (1 + (i < 3),) * 2 for i, t in enumerate(texts) for w in [t.split()] for g in [*w, *map(" ".join, zip(w, w[1:]))]}


def test_counts_of_single_items_are_not_taken_for_grams(spark, tmp_path):
    statistics.add_documents(docs(spark, *ALL), str(tmp_path / "s"))
    with pytest.raises(ValueError):
        statistics.saved_gram_weights(spark, str(tmp_path / "s"))


def test_tfidf_where_grams_have_one_text(spark, monkeypatch):
    """Grams of one text take their df from its copies and are not looked up; both texts of a pair may be that text."""
    sizes, lookup = [], tfidf.salted_lookup
    monkeypatch.setattr(tfidf, "salted_lookup", lambda rows, table, *a, **k: (sizes.append(table.count()), lookup(rows, table, *a, **k))[1])
    data = spark.createDataFrame([("1", "red fox", "red fox"), ("2", "blue sea", "blue sky"), ("3", "red fox", "old")], PAIRS)
    counts = {"red": 3, "fox": 3, "red fox": 3, "blue": 2, "sea": 1, "blue sea": 1, "sky": 1, "blue sky": 1, "old": 1}
    idf = {g: math.log(7 / (n + 1)) + 1 for g, n in counts.items()}
    length = math.sqrt(idf["blue"] ** 2 + 2 * idf["sea"] ** 2)
    found = {r.pair_id: r.tfidf_similarity for r in tfidf.with_tfidf(data).collect()}
    assert found == pytest.approx({"1": 1.0, "2": idf["blue"] ** 2 / length**2, "3": 0.0})
    assert sizes[0] == 1  # "blue"
