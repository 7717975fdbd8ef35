"""Joins that Spark has no single operator for: as-of, nearest, range, overlap, near dates; and lookups with fallbacks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _both_sides(left: DataFrame, right: DataFrame, key: str, left_date: str, right_date: str, carry: Sequence[str], tie: Sequence[str]) -> DataFrame:
    payload = F.struct(F.col(right_date).alias("right_date"), *[F.col(c) for c in carry])
    a = left.select(F.col(key).alias("__k"), F.col(left_date).alias("__d"), F.struct("*").alias("__row"))
    b = right.filter(F.col(right_date).isNotNull()).select(F.col(key).alias("__k"), F.col(right_date).alias("__d"), payload.alias("__p"), F.struct(F.lit(0), *[F.col(c) for c in tie]).alias("__tie"))
    return a.unionByName(b, allowMissingColumns=True)


def asof_backward(
    left: DataFrame, right: DataFrame, key: str, left_date: str, right_date: str, carry: Sequence[str], tie: Sequence[str] = (), strict: bool = False
) -> DataFrame:
    """Each left row with the latest right row of its key on or before its date (``strict``: before it), and the days between.

    Both sides are one table, sorted once per key: the last right row seen is carried on. ``tie`` orders right
    rows of one date, the last of which wins. Left rows without a match or date have nulls.
    """
    side = F.col("__row").isNotNull().cast("int")
    order = [F.col("__d").asc_nulls_first(), (-side if strict else side), F.col("__tie").asc_nulls_first()]
    w = Window.partitionBy("__k").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = _both_sides(left, right, key, left_date, right_date, carry, tie).withColumn("__p", F.last("__p", ignorenulls=True).over(w))
    out = both.filter("__row is not null").select("__row.*", "__p.right_date", *[f"__p.{c}" for c in carry])
    return out.withColumn("days_since", F.datediff(F.col(left_date), F.col("right_date")))


def align_forward(left: DataFrame, right: DataFrame, key: str, left_date: str, right_date: str, carry: Sequence[str] = ()) -> DataFrame:
    """Each left row with the first right row (unique by key and date) on or after its date, and a status.

    Status: bad_date, before_first (no right row at or before the date: the key's first one is taken),
    after_last, no_key, or ok. Both sides are one table, shuffled once and sorted per key from the last date on: the
    right row seen last is carried on. The key's first and last dates, which only the status needs, come from the same table.
    """
    order = [F.col("__d").desc_nulls_last(), F.col("__row").isNotNull().cast("int")]
    every = Window.partitionBy("__k")
    w = every.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = _both_sides(left, right, key, left_date, right_date, carry, ())
    both = both.withColumns({"__p": F.last("__p", ignorenulls=True).over(w), "__first": F.min("__p.right_date").over(every), "__last": F.max("__p.right_date").over(every)})
    out = both.filter("__row is not null").select("__row.*", F.col("__p.right_date").alias("aligned_date"), *[F.col(f"__p.{c}").alias(c) for c in carry], "__first", "__last")
    d = F.col(left_date)
    status = (
        F.when(d.isNull(), "bad_date").when(F.col(key).isNull() | F.col("__first").isNull(), "no_key").when(d > F.col("__last"), "after_last")
        .when(d < F.col("__first"), "before_first").otherwise("ok")
    )
    known = d.isNotNull() & F.col(key).isNotNull()  # after the last right row none has been seen
    return out.withColumn("status", status).withColumns({c: F.when(known, F.col(c)) for c in ("aligned_date", *carry)}).drop("__first", "__last")


def range_pairs(left: DataFrame, right: DataFrame, key: str, left_date: str, right_date: str, low: int, high: int, width: int | None = None) -> DataFrame:
    """Rows of both sides with one key and ``low <= right date - left date <= high`` in days.

    Dates fall into buckets of ``width`` days; a left row goes to each bucket that its range touches, so
    the join is by equality and a key's rows spread over its buckets. Right columns that clash get ``_right``.
    """
    width = width or max(1, high - low + 1)
    bucket = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01")) / width)
    a = left.withColumn("__b", F.explode(F.sequence(bucket(F.date_add(F.col(left_date), low)), bucket(F.date_add(F.col(left_date), high)))))
    names = {c: f"{c}_right" if c in left.columns else c for c in right.columns}
    b = right.select(*[F.col(c).alias(n) for c, n in names.items()]).withColumn("__b2", bucket(F.col(names[right_date])))
    gap = F.datediff(F.col(names[right_date]), F.col(left_date))
    on = (a[key] == F.col(names[key])) & (F.col("__b") == F.col("__b2"))
    return a.join(b, on).withColumn("gap_days", gap).filter(F.col("gap_days").between(low, high)).drop("__b", "__b2")


def nearest_in_range(left: DataFrame, right: DataFrame, key: str, unique: Sequence[str], left_date: str, right_date: str, low: int, high: int, target: int) -> DataFrame:
    """Of the right rows in range the one whose distance is nearest to ``target`` days (ties: the earliest). ``unique`` names left rows."""
    pairs = range_pairs(left, right, key, left_date, right_date, low, high)
    date = f"{right_date}_right" if right_date in left.columns else right_date
    w = Window.partitionBy(*unique).orderBy(F.abs(F.col("gap_days") - target), F.col(date))
    return pairs.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def overlap_counts(events: DataFrame, key: str, at: str, start: str, end: str) -> DataFrame:
    """``events`` with how many others of their key are at a date within their closed window, and whether none is.

    Events are counted per key and day, and the running count is looked up at both ends of each window by as-of
    joins: the work grows with the events, not with their pairs.
    """
    per_day = events.filter(F.col(at).isNotNull()).groupBy(key, F.col(at).alias("__day")).agg(F.count("*").alias("__n"))
    running = F.sum("__n").over(Window.partitionBy(key).orderBy("__day"))
    cum = per_day.withColumn("__upto", running).withColumn("__before", F.col("__upto"))
    out = asof_backward(events, cum, key, end, "__day", ["__upto"]).drop("right_date", "days_since")
    out = asof_backward(out, cum, key, start, "__day", ["__before"], strict=True).drop("right_date", "days_since")
    own = F.coalesce(F.col(at).between(F.col(start), F.col(end)), F.lit(False)).cast("long")
    n = F.coalesce(F.col("__upto"), F.lit(0)) - F.coalesce(F.col("__before"), F.lit(0)) - own
    return out.withColumn("n_overlap", n).withColumn("is_clean", n == 0).drop("__upto", "__before")


def lookup(df: DataFrame, mapping: dict[str, str], column: str, out: str, other: str | None = None) -> DataFrame:
    """Values of a small literal map."""
    pairs = F.create_map(*[F.lit(x) for p in mapping.items() for x in p])
    return df.withColumn(out, F.coalesce(F.try_element_at(pairs, F.col(column)), F.lit(other)))


def fallback_lookup(df: DataFrame, first: DataFrame, second: DataFrame, first_key: str, second_key: str, value: str) -> DataFrame:
    """``value`` from ``first`` by its key, else from ``second`` by its key; both have unique keys."""
    a = first.select(F.col(first_key).alias("__k1"), F.col(value).alias("__v1"))
    b = second.select(F.col(second_key).alias("__k2"), F.col(value).alias("__v2"))
    both = df.join(a, df[first_key] == F.col("__k1"), "left").join(b, df[second_key] == F.col("__k2"), "left")
    return both.withColumn(value, F.coalesce("__v1", "__v2")).drop("__k1", "__k2", "__v1", "__v2")


def override(base: DataFrame, rules: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Columns of ``rules`` (unique by key) over those of ``base`` where they have a value; ``overridden`` says where."""
    r = rules.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in columns])
    both = base.join(r, base[key] == F.col("__k"), "left")
    out = both.withColumns({c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in columns}).withColumn("overridden", F.col("__k").isNotNull())
    return out.drop("__k", *[f"__{c}" for c in columns])


def first_known(tables: Sequence[DataFrame], key: str, value: str) -> DataFrame:
    """One value per key: the first not null by the order of the tables (smallest within a table)."""
    union = None
    for i, t in enumerate(tables):
        part = t.filter(F.col(value).isNotNull()).select(F.col(key), F.col(value), F.lit(i).alias("__i"))
        union = part if union is None else union.unionByName(part)
    return union.groupBy(key).agg(F.min_by(value, F.struct("__i", value)).alias(value))


def superseded(primary: DataFrame, secondary: DataFrame, key: str) -> DataFrame:
    """All rows of ``primary``, and of ``secondary`` those whose key it lacks."""
    return primary.unionByName(secondary.join(primary.select(key), key, "left_anti"), allowMissingColumns=True)


def joined_once(left: DataFrame, rights: Sequence[DataFrame], key: str, clash: Sequence[str]) -> DataFrame:
    """Left joins on a key that is unique on the right: no row is lost or doubled; columns that clash get a suffix."""
    out = left
    for right, suffix in zip(rights, clash, strict=True):
        names = {c: f"{c}_{suffix}" if c in out.columns and c != key else c for c in right.columns}
        out = out.join(right.select(*[F.col(c).alias(n) for c, n in names.items()]), key, "left")
    return out


def equal_filters(df: DataFrame, filters: dict[str, object]) -> DataFrame:
    """Rows that equal all filters; those that are None are passed over."""
    for name, value in filters.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df


def nearest_keys(c: Column, days: int) -> Column:
    """The dates within ``days`` of a date, for an equality join."""
    return F.explode(F.transform(F.sequence(F.lit(-days), F.lit(days)), lambda k: F.date_add(c, k)))
