"""Writing tables and flat files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from trolley.sources.files import move, remove


def write_table(df: DataFrame, path: str, partition_by: str | None = None, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def write_csv(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """A folder of CSV files with header, written by all tasks."""
    writer = df.write.mode("overwrite").option("header", True)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.csv(path)


_PART = "_part"


def _write_each(df: DataFrame, column: str, root: str, folders: dict[str, str], write) -> None:
    """One job for all values of ``column``: the rows of each go to the folder below ``root`` that ``folders`` names.

    The rows of a file stay in the order in which its task meets them.  A value without rows gets a folder with an empty table.
    """
    spark = df.sparkSession
    draft = f"{root}/.draft-{uuid.uuid4().hex}"
    numbered = df.select("*", F.array_position(F.lit([*folders]), F.col(column)).alias(_PART)).filter(f"{_PART} > 0")
    ordered = numbered.withColumn("_at", F.monotonically_increasing_id()).sortWithinPartitions(_PART, "_at").drop("_at")
    write(ordered, draft, _PART)
    for number, folder in enumerate(folders.values(), 1):
        if not move(spark, f"{draft}/{_PART}={number}", f"{root}/{folder}"):
            write(spark.createDataFrame([], df.schema), f"{root}/{folder}", None)
    remove(spark, draft)


def write_tables(df: DataFrame, column: str, root: str, folders: dict[str, str]) -> None:
    """A Parquet table for each value of ``column``, with all columns, in one job."""
    _write_each(df, column, root, folders, lambda rows, path, by: write_table(rows, path, by))


def write_csvs(df: DataFrame, column: str, root: str, folders: dict[str, str]) -> None:
    """A folder of CSV files for each value of ``column``, in one job."""
    _write_each(df, column, root, folders, lambda rows, path, by: write_csv(rows.drop(column), path, by))
