"""Session helpers: where jobs may write, and how they cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (``spark.checkpoint.dir``); on a single machine that sets none, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tarnflow-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def safe_unions(spark: SparkSession) -> None:
    """A union is shuffled before it is grouped, whatever its sides are partitioned by.

    Spark 4.1 skips that shuffle where both sides have the same partitioning; when adaptive execution then merges the
    partitions of the sides in different ways, one group comes out as several. Other versions don't know the setting.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    The table outlives any executor, so nothing behind it is computed again, and the next plan
    starts from a scan of known size.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tarnflow/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
