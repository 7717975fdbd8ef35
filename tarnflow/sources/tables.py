"""Readers for the Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnflow.session import safe_unions


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``; a file or a folder of files."""
    safe_unions(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")
