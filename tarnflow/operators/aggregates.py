"""Roll-ups, distributions, de-duplication and reshaping. All pre-aggregate before they shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.operators.windows import best_per_key, exact_quantiles


def merge_sources(events: DataFrame, key: Sequence[str], source: str, weight: str, tie: str) -> DataFrame:
    """One row per key: the row of most weight (ties: least ``tie``), with the number and sorted set of sources, and of rows."""
    facts = events.groupBy(*key).agg(F.count_distinct(source).alias("n_sources"), F.array_join(F.array_sort(F.collect_set(source)), "|").alias("sources"), F.count("*").alias("n_rows"))
    best = best_per_key(events, key, [F.col(weight).desc(), F.col(tie)])
    return best.join(facts, list(key))


def group_events(events: DataFrame, key: Sequence[str], title: str, score: str, tie: str, most: int = 6) -> DataFrame:
    """Per key the best title, the first titles by score, counts, and a score that more events raise."""
    top = best_per_key(events, key, [F.col(score).desc(), F.col(tie)], most, "__r")
    titles = top.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__r", title))), lambda x: x[title]), " || ").alias("titles"), F.min_by(title, "__r").alias("title"))
    facts = events.groupBy(*key).agg(F.count("*").alias("n_events"), (F.max(score) + 0.5 * F.least(F.count("*"), F.lit(8))).alias("group_score"))
    return facts.join(titles, list(key))


def coverage_sets(df: DataFrame, a: str, b: str, hits: str) -> DataFrame:
    """Groups, groups with hits and the rate: over all, by a, by b, and by both, in one pass."""
    out = df.cube(a, b).agg(F.grouping_id().alias("gid"), F.count("*").alias("n"), F.count_if(F.col(hits) > 0).alias("n_with"))
    scope = F.element_at(F.array(F.lit("both"), F.lit(f"by_{a}"), F.lit(f"by_{b}"), F.lit("overall")), (F.col("gid") + 1).cast("int"))
    return out.select(scope.alias("scope"), a, b, "n", "n_with", (F.col("n") - F.col("n_with")).alias("n_without"), (F.col("n_with") / F.col("n")).alias("rate"))


def distribution(df: DataFrame, by: Sequence[str], x: str, probabilities: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Number, mean, deviation and exact quantiles of a value per group."""
    names = {f"p{round(p * 100):02d}": p for p in probabilities}
    out = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"))
    quantiles = exact_quantiles(df, by, x, names).withColumnsRenamed({c: f"__q_{c}" for c in by})
    on = [F.col(c).eqNullSafe(F.col(f"__q_{c}")) for c in by]
    return out.join(quantiles, on, "left").select(*by, "n", "mean", "std", *names)


def scoped_distribution(df: DataFrame, scopes: dict[str, Column], labels: Sequence[str]) -> DataFrame:
    """Distributions of several values over scopes that may overlap: a row counts in each scope that it is in."""
    tags = F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in scopes.items()]))).alias("scope")
    long = df.select(tags, *labels).unpivot(["scope"], list(labels), "label", "value")
    return distribution(long.filter("value is not null"), ["scope", "label"], "value", (0.01, 0.05, 0.5, 0.95, 0.99))


def histogram(df: DataFrame, x: str, bins: int = 24, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Counts of a value in equal bins between two of its quantiles, outliers in the outer ones, empty bins with 0."""
    edge = exact_quantiles(df, [], x, {"lo": low, "hi": high})
    width = (F.col("hi") - F.col("lo")) / bins
    bin_ = F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil((F.col(x) - F.col("lo")) / F.nullif(width, F.lit(0.0))))).cast("int")
    counts = df.filter(F.col(x).isNotNull()).join(F.broadcast(edge)).groupBy(F.coalesce(bin_, F.lit(1)).alias("bin")).count()  # one row of edges
    grid = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin")).join(F.broadcast(edge))
    return grid.join(counts, "bin", "left").select("bin", (F.col("lo") + (F.col("bin") - 1) * width).alias("from"), (F.col("lo") + F.col("bin") * width).alias("to"), F.coalesce("count", F.lit(0)).alias("n"))


def missingness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, nulls and their share for each column, in one pass."""
    one = df.agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return one.unpivot(["rows"], list(columns), "column", "missing").withColumn("rate", F.try_divide("missing", "rows"))


def dense_coverage(df: DataFrame, a: DataFrame, b: DataFrame, a_col: str, b_col: str, date: str) -> DataFrame:
    """Every pair of two dimensions with its rows and first and last date; pairs without rows are ``missing``. The pairs are the result: as many as one side has values times the other."""
    got = df.groupBy(a_col, b_col).agg(F.count("*").alias("n"), F.min(date).alias("first"), F.max(date).alias("last"))
    grid = a.select(a_col).distinct().crossJoin(b.select(b_col).distinct())  # dimensions, not rows
    out = grid.join(got, [a_col, b_col], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("status", F.when(F.col("n") == 0, "missing").when(F.col("n") < 10, "thin").otherwise("ok"))


def exploded_counts(df: DataFrame, column: str, mark: str = "|") -> DataFrame:
    """How often each of the values that a cell joins occurs."""
    return df.select(F.explode(F.split(F.col(column), f"\\{mark}")).alias("value")).filter("value <> ''").groupBy("value").count()


def group_mean_with_fallback(df: DataFrame, train: Column, by: str, y: str, out: str = "group_mean") -> DataFrame:
    """Mean of training rows per group; for groups without one that of all training rows."""
    rows = df.filter(train)
    per, all_ = rows.groupBy(by).agg(F.avg(y).alias("__m")), rows.agg(F.avg(y).alias("__a"))
    return df.join(per, by, "left").join(F.broadcast(all_)).withColumn(out, F.coalesce("__m", "__a")).drop("__m", "__a")  # one row


def symmetric_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has, and which."""
    x, y = a.select(key).distinct().withColumn("__a", F.lit(True)), b.select(key).distinct().withColumn("__b", F.lit(True))
    both = x.join(y, key, "full_outer").filter("__a is null or __b is null")
    return both.select(key, F.when(F.col("__b").isNull(), "left_only").otherwise("right_only").alias("side"))


def one_hot(df: DataFrame, column: str, values: Sequence[str], prefix: str) -> DataFrame:
    return df.withColumns({f"{prefix}_{v}": F.coalesce(F.col(column) == v, F.lit(False)).cast("int") for v in values})


def multi_hot(df: DataFrame, column: str, values: Sequence[str], prefix: str, mark: str = "|") -> DataFrame:
    cells = F.split(F.coalesce(F.col(column), F.lit("")), f"\\{mark}")
    return df.withColumns({f"{prefix}_{v}": F.array_contains(cells, v).cast("int") for v in values})


def union_sources(parts: dict[str, DataFrame]) -> DataFrame:
    """Tables of one event schema, each with its name as ``source``; columns that one lacks are null."""
    out = None
    for name, part in parts.items():
        part = part.withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def stratified_sample(df: DataFrame, id_col: str, score: str, impact: str, top: int = 8, edge: int = 6, rest: int = 10, seed: int = 7) -> DataFrame:
    """Ids for a recheck: the best, the largest and smallest impacts, and some by hash."""
    picks = [
        df.orderBy(F.col(score).desc(), id_col).limit(top), df.orderBy(F.col(impact).desc(), id_col).limit(edge), df.orderBy(F.col(impact), id_col).limit(edge),
        df.orderBy(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(str(seed)))), id_col).limit(rest),
    ]
    out = picks[0].select(id_col)
    for p in picks[1:]:
        out = out.union(p.select(id_col))
    return out.distinct()


def drop_repeated(df: DataFrame, by: Sequence[str], signature: Column, order: Sequence[Column]) -> DataFrame:
    """The first row of each signature within a group."""
    w = Window.partitionBy(*by, signature).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")
