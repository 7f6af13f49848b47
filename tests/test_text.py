import re

from pyspark.sql import functions as F

from rankloom.functions import text as t

CASES = [
    "Üachie für ß naïve_x 2²",
    "Who\twas   Dr. O'Neil?",
    "",
    None,
    "éclair cafe",
    "  a b c\x1cd\x85e \n",
    "WHO is it",
    "whose",
    "HelloX Hello Hello_ Él Al Bo9 Ce",
    "a cat a dog a cat",
]


def frame(spark, values=CASES):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, text string")


def column(df, expression):
    return [r[1] for r in df.select("id", expression).orderBy("id").collect()]


def py_norm(s):
    return " ".join((s or "").split())


def py_tokens(s):
    return re.findall(r"\b\w+\b", py_norm(s).lower())


def test_whitespace_equals_unicode_split(spark):
    assert column(frame(spark), t.normalize_whitespace(F.col("text"))) == [py_norm(s) for s in CASES]


def test_tokens_equal_unicode_words(spark):
    assert column(frame(spark), t.tokenize(F.col("text"))) == [py_tokens(s) for s in CASES]


def test_tokens_equal_unicode_words_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = docs.select("text", t.tokenize(F.col("text")).alias("t")).collect()
    assert all(r.t == py_tokens(r.text) for r in rows)


def test_question_type(spark):
    values = ["WHO is it", "whose", "", None, "- what, now", "How", "Is it"]
    got = column(frame(spark, values), t.question_type(F.col("text")))
    assert got == ["who", "other", "other", "other", "what", "how", "other"]


def test_title_words(spark):
    expected = [len(re.findall(r"\b[A-Z][a-z]+\b", s or "")) for s in CASES]
    assert column(frame(spark), t.title_word_count(F.col("text"))) == expected


def test_grams_drop_single_letters_first(spark):
    df = t.with_grams(frame(spark, ["a cat a dog", "x", "", None, "one"]), "text", "g")
    assert column(df, F.col("g")) == [["cat", "dog", "cat dog"], [], [], [], ["one"]]


def test_value_counts(spark):
    df = frame(spark, ["b a b c b a", "", "z"]).withColumn("w", t.tokenize(F.col("text")))
    got = column(t.with_value_counts(df, "w", "c"), F.col("c"))
    assert [[(r.value, r.n) for r in row] for row in got] == [[("a", 2), ("b", 3), ("c", 1)], [], [("z", 1)]]


def test_shared_terms(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a"], ["a", "c", "a", "b"]), (2, [], ["a"]), (3, ["x"], ["y"])], "id int, q array<string>, d array<string>")
    rows = t.with_shared_terms(df, "q", "d", "s").orderBy("id").collect()
    assert [[(x.value, x.n, x.query_n) for x in r.s] for r in rows] == [[("a", 2, 2), ("b", 1, 1)], [], []]


def test_explode_rows_keeps_the_expression_out_of_filters(spark):
    df = t.explode_rows(frame(spark), "id", items=F.array_distinct(t.tokenize(F.col("text"))), out="w")
    assert "size(" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.id, r.w) for r in df.collect()} == {(i, w) for i, s in enumerate(CASES) for w in py_tokens(s)}
