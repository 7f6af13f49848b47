"""Raw records from CSV, JSON lines or exported Parquet, with their load order."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.functions.extract import JSON_TEXT
from rankloom.operators.digest import sample_exact

LOAD_ORDER = "_load_order"
FORMATS = ("csv", "jsonl", "parquet")


def read_records(
    spark: SparkSession,
    source: str,
    path: str | list[str] | None,
    schema: T.StructType | str | None = None,
    irregular: list[str] | None = None,
    multiline_csv: bool = False,
    sample_size: int = 0,
    seed: int = 42,
) -> DataFrame:
    """Records of one or more files, plus a ``_load_order`` column.

    ``schema`` spares the inference pass. ``irregular`` names JSON fields whose shape
    differs by row; their source text is kept in a struct of one field, which keeps the
    order of keys (an inferred struct has them by name). CSV cells stay text, and a missing cell
    is null. A CSV file is split between tasks; quoted line breaks need ``multiline_csv``,
    which makes each file one task's work.

    A sample depends on the records only, not on folders or on how files are split:
    Parquet rows are drawn by file name and row number, text records by their content
    and, among equal ones, a copy number.
    """
    if source not in FORMATS:
        raise ValueError(f"unknown source {source!r}, expected one of {FORMATS}")
    if not path:
        raise ValueError("a path is required")
    try:
        records = _load(spark, source, path, schema, irregular or [], multiline_csv)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(str(path)) from error
        raise
    ordered = with_load_order(records)
    if sample_size <= 0:
        return ordered
    if source == "parquet":
        key = F.concat_ws("#", F.col("_metadata.file_name"), F.col("_metadata.row_index"))
        keyed = records.select("*", _load_order(), key.alias("__key"))
    else:
        content = F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in records.columns])))
        copy = F.row_number().over(W.partitionBy("__content").orderBy("__content"))
        keyed = ordered.withColumn("__content", content).withColumn("__key", F.concat_ws("#", "__content", copy)).drop("__content")
    return sample_exact(keyed, sample_size, F.col("__key"), seed).drop("__key")


def _load(spark, source, path, schema, irregular, multiline_csv) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    if source == "parquet":
        return reader.parquet(*([path] if isinstance(path, str) else path))
    if source == "csv":
        return (
            reader.option("header", True)
            .option("multiLine", multiline_csv)
            .option("quote", '"')
            .option("escape", '"')
            .csv(path)
        )
    if schema is None and irregular:
        inferred = spark.read.json(path).schema
        fields = [
            T.StructField(f.name, T.StringType() if f.name in irregular else f.dataType)
            for f in inferred.fields
        ]
        # Read as strings, nested values are kept as their source text.
        reader = spark.read.schema(T.StructType(fields))
    records = reader.json(path)
    return records.withColumns({c: F.struct(F.col(c).alias(JSON_TEXT)) for c in irregular if c in records.columns})


def with_load_order(df: DataFrame) -> DataFrame:
    """Add file, block start and position: sorts rows as they stand in the files. A block
    is read by one task from its start on, which makes the id rise within it."""
    return df.select("*", _load_order())


def _load_order() -> Column:
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    ).alias(LOAD_ORDER)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split of a table written with ``partition_by="split"``; the other splits'
    folders are not read."""
    return spark.read.parquet(path).where(F.col("split") == split)


def read_metrics_json(spark: SparkSession, path: str) -> DataFrame:
    """Long metrics (split, family, metric, value) from a nested JSON document of
    {split: {family: {metric: value}}}; other members are left out."""
    doc = spark.read.option("multiLine", True).json(path)
    cells = []
    for split in doc.schema.fields:
        if not isinstance(split.dataType, T.StructType):
            continue
        for family in split.dataType.fields:
            if not isinstance(family.dataType, T.StructType):
                continue
            for metric in family.dataType.names:
                value = F.col(f"`{split.name}`.`{family.name}`.`{metric}`").cast("double")
                cells.append(
                    F.struct(
                        F.lit(split.name).alias("split"),
                        F.lit(family.name).alias("family"),
                        F.lit(metric).alias("metric"),
                        value.alias("value"),
                    )
                )
    return doc.select(F.inline(F.array(*cells)))


def read_importance_json(spark: SparkSession, path: str) -> DataFrame:
    """(feature, importance) from a flat JSON object."""
    doc = spark.read.option("multiLine", True).json(path)
    return doc.unpivot([], [F.col(f"`{c}`").cast("double").alias(c) for c in doc.columns], "feature", "importance")
