"""Data-quality checks: each gives ``check, status, detail`` rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of column names that tell of values from after the event.
LEAKY = r"(?i)(^|_)(future|post|label|target|after|next)(_|$)|_p0_p\d+"


def _row(df: DataFrame, name: str, bad: Column, text: str) -> DataFrame:
    return df.select(F.lit(name).alias("check"), F.when(bad == 0, "pass").otherwise("fail").alias("status"), F.format_string(text, bad).alias("detail"))


def unique_key(df: DataFrame, key: Sequence[str]) -> DataFrame:
    many = df.groupBy(*key).count().filter("count > 1").agg(F.count("*").alias("n"))
    return _row(many, "unique_key", F.col("n"), "%d repeated keys")


def point_in_time(df: DataFrame, as_of: str, event: str) -> DataFrame:
    late = df.agg(F.count_if((F.col(as_of) > F.col(event)) | F.col(event).isNull()).alias("n"))
    return _row(late, "point_in_time", F.col("n"), "%d rows look ahead")


def key_alignment(diff: DataFrame) -> DataFrame:
    return _row(diff.agg(F.count("*").alias("n")), "key_alignment", F.col("n"), "%d keys on one side only")


def split_policy(df: DataFrame, split: str, date: str, legal: Sequence[str]) -> DataFrame:
    """Illegal values, and rows of an earlier split that are dated after the first of a later one."""
    order = {s: i for i, s in enumerate(legal)}
    rank = F.coalesce(*[F.when(F.col(split) == s, F.lit(i)) for s, i in order.items()], F.lit(-1))
    per = df.withColumn("__r", rank).groupBy("__r").agg(F.count("*").alias("n"), F.min(date).alias("lo"), F.max(date).alias("hi"))
    later = per.select(F.col("__r").alias("__r2"), F.col("lo").alias("lo2")).filter("__r2 >= 0")
    crossed = per.filter("__r >= 0").join(later, F.col("__r2") > F.col("__r")).filter("hi >= lo2").agg(F.count("*").alias("x"))  # a row per split
    bad = per.agg(F.coalesce(F.sum(F.when(F.col("__r") < 0, F.col("n"))), F.lit(0)).alias("i"), (F.lit(len(legal)) - F.count_if(F.col("__r") >= 0)).alias("e"))
    return _row(bad.join(crossed).select((F.col("i") + F.col("e") + F.col("x")).alias("n")), "split_policy", F.col("n"), "%d faults")


def label_alignment(events: DataFrame, labels: DataFrame, key: str, active: Column) -> DataFrame:
    lost = events.filter(active).join(labels, key, "left_anti").agg(F.count("*").alias("n"))
    return _row(lost, "label_alignment", F.col("n"), "%d active rows without a label")


def required_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    lost = [n for n in names if n not in df.columns]
    return df.groupBy().agg(F.count("*").alias("rows")).select(
        F.lit("required_columns").alias("check"), F.lit("fail" if lost else "pass").alias("status"), F.format_string(f"missing: {', '.join(lost) or 'none'}; rows: %d", "rows").alias("detail")
    )


def leaky_columns(dictionary: DataFrame, name: str = "column", role: str = "role") -> DataFrame:
    bad = dictionary.filter((F.col(role) == "feature") & F.col(name).rlike(LEAKY)).agg(F.count("*").alias("n"))
    return _row(bad, "leakage", F.col("n"), "%d leaky features")


def outputs(df: DataFrame, groups: str, date: str, latest: str) -> DataFrame:
    """Not empty, fewer groups than rows, and no date after the latest one."""
    got = df.agg(F.count("*").alias("rows"), F.count_distinct(groups).alias("g"), F.max(date).alias("hi"))
    bad = (F.col("rows") == 0).cast("int") + (F.col("g") > F.col("rows")).cast("int") + (F.col("hi") > F.lit(latest).cast("date")).cast("int")
    return _row(got.select(bad.alias("n")), "outputs", F.col("n"), "%d faults")
