"""Helpers of the corpus operators: text bytes of Arrow batches, bounded pieces, staged tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.session import scratch_path

#: Bytes of text that numpy works on at a time; temporary arrays take up to some 60 times as much.
PIECE_BYTES = 1 << 21

#: Bytes of an Arrow batch between Spark and Python.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and go on from the files: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold ``BATCH_BYTES`` at most from now on: texts are long, and a task
    holds its batch several times, in the JVM and in Python."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def with_own_text(docs: DataFrame, keep: list[str], text: str, *more: Column) -> tuple[DataFrame, str, str]:
    """The kept columns and more, with the text among them once; its name there, and the kept columns' schema."""
    small_batches(docs.sparkSession)
    kept = docs.select(*[F.col(f"`{c}`") for c in keep])
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema)
    if text in keep and docs.schema[text].dataType.simpleString() == "string":
        return docs.select(*[F.col(f"`{c}`") for c in keep], *more), text, fields
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).cast("string").alias("__text"), *more), "__text", fields


def text_digest(text: Column) -> Column:
    """16 bytes that name a text; a null counts as the empty text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column in one array and the n + 1 offsets of its rows; nulls are empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        width = np.int64
    else:
        column, width = column.cast(pa.string()) if not pa.types.is_binary(column.type) else column, np.int32
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, width, n + 1, column.offset * np.dtype(width).itemsize).astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, one row at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last
