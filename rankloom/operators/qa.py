"""Question/answer table from raw records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.constants import ANSWER_FALLBACK_FIELDS, ANSWER_FIELDS, ID_FIELDS, QUESTION_FIELDS
from rankloom.functions.extract import first_text
from rankloom.functions.text import normalize_whitespace, text_key
from rankloom.operators.digest import seeded_digest
from rankloom.operators.pairs import number_questions
from rankloom.sources.readers import LOAD_ORDER


def find_field(columns: list[str], candidates: list[str]) -> str | None:
    """The first candidate that is a column."""
    return next((name for name in candidates if name in columns), None)


def answer_text(df: DataFrame, answer: str | None) -> Column:
    """Text of the answer column, or of the first fallback column that has one."""
    columns = [answer] if answer else []
    columns += [c for c in ANSWER_FALLBACK_FIELDS if c in df.columns and c != answer]
    texts = [F.nullif(first_text(F.col(c), df.schema[c].dataType), F.lit("")) for c in columns]
    return F.coalesce(*texts, F.lit(""))


def extract_qa(records: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """(source_example_id, question, answer, load_order): rows with both texts.

    ``order`` is the load order, by default the position the readers add. Records
    without an id get that position as their source id.
    """
    question = find_field(records.columns, QUESTION_FIELDS)
    if question is None:
        raise ValueError(f"no question column among {records.columns}")
    answer = find_field(records.columns, ANSWER_FIELDS)
    source_id = find_field(records.columns, ID_FIELDS)
    if order is None:
        if LOAD_ORDER not in records.columns:
            raise ValueError("give the load order, or read the records with rankloom.sources")
        order = [F.col(f"{LOAD_ORDER}.{f}") for f in records.schema[LOAD_ORDER].dataType.names]
    position = F.concat_ws("#", *[c.cast("string") for c in order])
    own_id = F.col(source_id).cast("string") if source_id else F.lit(None).cast("string")
    return records.select(
        normalize_whitespace(F.coalesce(own_id, position)).alias("source_example_id"),
        first_text(F.col(question), records.schema[question].dataType).alias("question"),
        answer_text(records, answer).alias("answer"),
        F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]).alias("load_order"),
    ).where("question <> '' AND answer <> ''")


def first_per_question(df: DataFrame, question: str = "question", order: str = "load_order") -> DataFrame:
    """Keep the row that comes first for each question text (null texts count as one).

    Rows are grouped by a 16-byte key. Filtering on the row number lets every map task
    keep one row per key before the shuffle, so a question a third of the rows share
    costs one row per task."""
    first = W.partitionBy("__key").orderBy(order)
    keyed = df.withColumn("__key", F.coalesce(text_key(F.col(question)), F.lit(b"")))
    return keyed.withColumn("__n", F.row_number().over(first)).where("__n = 1").select(df.columns)


def build_qa(records: DataFrame, order: list[Column] | None = None, ids: str = "sequential", seed: int = 42) -> DataFrame:
    """(question_id, source_example_id, question, answer), one row per question text.

    ``ids="sequential"`` gives q_0, q_1, ... in load order (one distributed sort);
    ``ids="digest"`` derives the id from the question and needs none.
    """
    if ids not in ("sequential", "digest"):
        raise ValueError(f"unknown ids: {ids}")
    qa = first_per_question(extract_qa(records, order))
    if ids == "digest":
        qa = qa.withColumn("question_id", F.concat(F.lit("q_"), seeded_digest(seed, "question", F.col("question"))))
    else:
        parts = qa.schema["load_order"].dataType
        assert isinstance(parts, T.StructType)
        qa = number_questions(qa, [F.col(f"load_order.{n}") for n in parts.names])
    return qa.select("question_id", "source_example_id", "question", "answer")


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Fail early on an empty table. Reads until the first row, so use it at the edge of
    a job only."""
    if df.isEmpty():
        raise ValueError(f"{what}: no rows")
    return df
