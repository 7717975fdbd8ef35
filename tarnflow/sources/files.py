"""CSV, JSON lines and text at the edge, with schemas given; and what reads and writes them again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.functions.text import blank_to_null


def read_csv_folder(spark: SparkSession, path: str, schema: str, code: str | None = None, pattern: str = r"([^/]+)\.csv") -> DataFrame:
    """All CSV files of a folder but those that begin with an underscore; a missing ``code`` comes from the file's name."""
    df = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "[!_]*.csv").csv(path)
    if code:
        df = df.withColumn(code, F.coalesce(F.col(code), F.regexp_extract(F.input_file_name(), pattern, 1)))
    return df


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with all columns as text; empty cells are null, a byte-order mark is no part of the first name."""
    df = spark.read.option("header", True).csv(path)
    return df.select(*[blank_to_null(F.col(f"`{c}`")).alias(c.lstrip("﻿")) for c in df.columns])


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are passed over, bad ones fail the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    df.sortWithinPartitions(*order).write.mode("overwrite").option("header", True).csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def unseen(df: DataFrame, done: DataFrame, key: str, force: bool = False) -> DataFrame:
    """Rows whose key has no output yet; all of them if ``force``."""
    return df if force else df.join(done.select(key).distinct(), key, "left_anti")
