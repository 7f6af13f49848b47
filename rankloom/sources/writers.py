"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame

from rankloom.session import scratch_path


def write_table(
    df: DataFrame, base: str, csv: bool = True, partition_by: str | None = None
) -> DataFrame:
    """Write ``<base>.parquet`` and, from what was written, ``<base>.csv``; return the
    Parquet table. The CSV and all later steps read the file, so the plan behind ``df``
    runs once."""
    spark = df.sparkSession
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{base}.parquet")
    written = spark.read.parquet(f"{base}.parquet")
    if csv:
        write_csv(written.select(df.columns), f"{base}.csv")
    return written


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a step's result to the shared folder and go on from the files.

    Later steps read pairs and features many times over; from files each of these
    reads takes only its own columns, and a lost executor costs no recomputation of the
    steps before."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, one object per row; null fields are kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
