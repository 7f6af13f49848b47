import json

import pytest
from pyspark.sql import functions as F

from rankloom.functions.extract import first_text, first_text_json
from rankloom.operators.qa import answer_text, build_qa, extract_qa, find_field, first_per_question


def texts(df, name="v"):
    return [r[0] for r in df.orderBy("id").select(first_text(F.col(name), df.schema[name].dataType)).collect()]


def test_arrays_and_nested_arrays(spark):
    df = spark.createDataFrame(
        [(1, [["", " "], ["y  z"]]), (2, None), (3, [None, []]), (4, [["a"], ["b"]])], "id int, v array<array<string>>"
    )
    assert texts(df) == ["y z", "", "", "a"]


def test_struct_prefers_known_fields(spark):
    df = spark.createDataFrame(
        [(1, ("z", 5, "")), (2, ("z", None, None)), (3, ("z", 5, "t")), (4, None)],
        "id int, v struct<foo:string,value:int,text:string>",
    )
    assert texts(df) == ["5", "z", "t", ""]


def test_map_prefers_known_keys(spark):
    df = spark.createDataFrame(
        [(1, {"foo": "z", "answer": " a "}), (2, {"foo": "z"}), (3, {}), (4, {"text": "", "bar": "q"})],
        "id int, v map<string,string>",
    )
    assert texts(df) == ["a", "z", "", "q"]


def test_scalars_print_as_in_python(spark):
    values = [0.5, 1e10, 1234567.25, 1e16, 1.5e-5, 1e-4, float("nan"), float("-inf"), 12345678.125, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v double")
    assert texts(df) == ["" if v is None else str(v) for v in values]
    flags = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, v boolean")
    assert texts(flags) == ["True", "False", ""]


def test_irregular_json_keeps_key_order(spark):
    cells = ['{"b": "second", "a": "first"}', '["", {"value": 5, "text": ""}]', '" x "', "null", "true", '{"foo": []}']
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "id int, c string")
    got = [r[0] for r in df.orderBy("id").select(first_text_json(F.col("c"))).collect()]
    assert got == ["second", "5", "x", "", "True", ""]


def test_variant(spark):
    cells = ['["", "b"]', '"  plain text "', '{"text": {"answer": ["deep"]}}', None, "7"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "id int, c string")
    df = df.select("id", F.try_parse_json("c").alias("v"))
    assert texts(df) == ["b", "plain text", "deep", "", "7"]


def test_field_discovery():
    assert find_field(["x", "query", "question_text"], ["question", "query", "question_text"]) == "query"
    assert find_field(["x"], ["question"]) is None


def test_answer_fallbacks(spark):
    df = spark.createDataFrame(
        [(1, "", [], [("n",)], "l"), (2, " a ", ["s"], None, "l"), (3, None, ["", "s"], None, "l"), (4, None, None, None, "l")],
        "id int, answer string, answers array<string>, annotations array<struct<short_answers:string>>, long_answer string",
    )
    rows = df.orderBy("id").select(answer_text(df, "answer")).collect()
    assert [r[0] for r in rows] == ["n", "a", "s", "l"]


def test_build_qa_first_wins_and_ids_follow_order(spark):
    records = spark.createDataFrame(
        [(3, "q1 ", "late"), (1, "q2", "b"), (2, "q1", "early"), (4, " ", "none"), (5, "q3", None), (6, "q4", "d")],
        "example_id int, question string, answer string",
    )
    rows = build_qa(records, [F.col("example_id")]).orderBy("source_example_id").collect()
    assert [tuple(r) for r in rows] == [("q_0", "1", "q2", "b"), ("q_1", "2", "q1", "early"), ("q_2", "6", "q4", "d")]


def test_records_without_question_column_are_refused(spark):
    with pytest.raises(ValueError):
        extract_qa(spark.range(1), [F.col("id")])


def test_first_per_question_with_one_hot_question(spark):
    df = spark.range(30_000).selectExpr(
        "IF(id % 3 = 0, 'hot', concat('q', id)) AS question", "id AS load_order", "id * 2 AS payload"
    )
    kept = first_per_question(df)
    assert kept.count() == 20_001
    assert kept.where("question = 'hot'").first().payload == 0


def test_json_reader_uses_raw_text():
    assert list(json.loads('{"b": 1, "a": 2}')) == ["b", "a"]
