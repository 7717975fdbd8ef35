"""Window operators over a panel: one row per key and day. Frames count rows of the calendar unless days are meant."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.session import materialize


def peer_mean_ex_self(df: DataFrame, by: Sequence[str], x: str, out: str = "peer_mean", needs_own: bool = False) -> DataFrame:
    """Mean of the others in a group. A null own value leaves the peers whole; ``needs_own``: it gives null.

    The group's sum and count come from a pre-aggregation joined back, so that a large group is not one
    task's window. It is written, so that its size is known and the rows of ``df``, which are read twice, stay where they are.
    """
    sums = materialize(df.groupBy(*by).agg(F.sum(x).alias("__s"), F.count(x).alias("__n")), "sums")
    both = df.join(sums, list(by), "left")
    others = F.col("__n") - F.col(x).isNotNull().cast("long")
    mean = F.try_divide(F.col("__s") - F.coalesce(F.col(x), F.lit(0.0)), others)
    if needs_own:
        mean = F.when(F.col(x).isNotNull(), mean)
    return both.withColumn(out, mean).drop("__s", "__n")


def event_sums(df: DataFrame, key: str, order: str, x: str, windows: dict[str, tuple[int, int]]) -> DataFrame:
    """For each window the sum of rows from a to b around each row (clipped to those that exist), and how many there are and should be."""
    w = Window.partitionBy(key).orderBy(order)
    out = {}
    for name, (a, b) in windows.items():
        frame = w.rowsBetween(a, b)
        out |= {f"sum_{name}": F.coalesce(F.sum(x).over(frame), F.lit(0.0)), f"actual_{name}": F.count("*").over(frame), f"expected_{name}": F.lit(b - a + 1)}
    return df.withColumns(out)


def end_value(df: DataFrame, key: str, order: str, columns: Sequence[str], ahead: int, suffix: str = "_end") -> DataFrame:
    """Values ``ahead`` rows on, or of the last row before that."""
    frame = Window.partitionBy(key).orderBy(order).rowsBetween(0, ahead)
    return df.withColumns({c + suffix: F.last(c).over(frame) for c in columns})


def pre_value(df: DataFrame, key: str, order: str, columns: Sequence[str], suffix: str = "_pre") -> DataFrame:
    """Values of the row before; the first row's own."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumns({c + suffix: F.when(F.row_number().over(w) == 1, F.col(c)).otherwise(F.lag(c).over(w)) for c in columns})


def trailing(df: DataFrame, key: str, order: str, x: str, sizes: Sequence[int]) -> DataFrame:
    """Sum, mean and deviation of the rows before each row, once half of them (two at least) have values."""
    out = {}
    for n in sizes:
        frame = Window.partitionBy(key).orderBy(order).rowsBetween(-n, -1)
        enough = F.count(x).over(frame) >= max(2, n // 2)
        out |= {f"{x}_{kind}{n}": F.when(enough, f(x).over(frame)) for kind, f in (("sum", F.sum), ("mean", F.avg), ("std", F.stddev_samp))}
    return df.withColumns(out)


def trailing_z(df: DataFrame, key: str, order: str, x: str, least: int = 3, out: str = "z") -> DataFrame:
    """Distance from the mean of all rows before, in their deviations, once there are ``least`` values."""
    frame = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    z = F.try_divide(F.col(x) - F.avg(x).over(frame), F.nullif(F.stddev_samp(x).over(frame), F.lit(0.0)))
    return df.withColumn(out, F.when(F.count(x).over(frame) >= least, z))


def trailing_mean(df: DataFrame, key: str, order: str, x: str, n: int = 4, least: int = 2, out: str = "trail_mean") -> DataFrame:
    frame = Window.partitionBy(key).orderBy(order).rowsBetween(-n, -1)
    return df.withColumn(out, F.when(F.count(x).over(frame) >= least, F.avg(x).over(frame)))


def average_rank(by: Sequence[Column], x: Column) -> Column:
    """Rank of non-null values, ties sharing their mean rank; null for null."""
    w = Window.partitionBy(*by, x.isNull())
    return F.when(x.isNotNull(), F.rank().over(w.orderBy(x)) + (F.count("*").over(Window.partitionBy(*by, x)) - 1) / 2.0)


def _cut(df: DataFrame, by: Sequence[str], x: str, parts: int = 128) -> DataFrame:
    """``df`` with ``__part``: which of about equal parts (a power of two) of its group a value lies in, by approximate quantiles of the group."""
    at = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    cuts = df.groupBy(*[F.col(c).alias(f"__b_{c}") for c in by]).agg(F.percentile_approx(x, at, 10000).alias("__cuts"))
    cuts = materialize(cuts, "cuts")  # of known size: no row is shuffled to meet its group's cuts
    on = [F.col(c).eqNullSafe(F.col(f"__b_{c}")) for c in by]
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(parts.bit_length() - 1))])
    part = F.aggregate(steps, F.lit(0), lambda i, s: i + F.when(F.get("__cuts", i + s - 1) < F.col(x), s).otherwise(0))  # how many cuts are less, by halving
    return df.join(cuts, on).withColumn("__part", part).drop("__cuts", *[f"__b_{c}" for c in by])


def _same(left: Sequence[str], prefix: str) -> list[Column]:
    return [F.col(c).eqNullSafe(F.col(f"{prefix}{c}")) for c in left]


def value_ends(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """``by, x, __n, __end, __total``: how often each value of a group occurs, how many of the group are not above it, and how many there are.

    Exact, without a window over a whole group: different values are counted, cut into parts by quantiles of
    the group, added up within their part, and moved on by what the parts before hold. The counts are written
    once, so that ``df`` is read once.
    """
    counts = df.filter(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count("*").alias("__n"))
    return count_ends(materialize(counts, "counts"), by, x)


def count_ends(counts: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """``value_ends`` from ``by, x, __n``, a row for each value."""
    out = cumulative_sums(counts, by, x, ["__n"])
    return out.select(*by, x, "__n", F.col("__end___n").alias("__end"), F.col("__total___n").alias("__total"))


def cumulative_sums(rows: DataFrame, by: Sequence[str], x: str, sums: Sequence[str]) -> DataFrame:
    """``rows`` (one for each value of ``x`` in a group) with ``__end_<c>`` and ``__total_<c>`` for each of ``sums``: the sum up to this value, and that of the group.

    Large groups are cut into parts of the values, so that no window runs over a whole group. Rows are read three times (write
    them before) and shuffled once, to their parts.
    """
    cut = _cut(rows, by, x)
    parts = Window.partitionBy(*by)  # a row for each part
    before = parts.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = cut.groupBy(*by, "__part").agg(*[F.sum(c).alias(f"__t_{c}") for c in sums])
    ahead = ahead.withColumns({f"__ahead_{c}": F.coalesce(F.sum(f"__t_{c}").over(before), F.lit(0)) for c in sums} | {f"__total_{c}": F.sum(f"__t_{c}").over(parts) for c in sums})
    ahead = ahead.select(*[F.col(c).alias(f"__b_{c}") for c in (*by, "__part")], *[f"__{k}_{c}" for c in sums for k in ("ahead", "total")])
    ahead = materialize(ahead, "ahead")
    within = Window.partitionBy(*by, "__part").orderBy(x)
    both = cut.join(ahead, _same([*by, "__part"], "__b_")).withColumns({f"__end_{c}": F.col(f"__ahead_{c}") + F.sum(c).over(within) for c in sums})
    return both.drop("__part", *[f"__ahead_{c}" for c in sums], *[f"__b_{c}" for c in (*by, "__part")])


def average_ranks(df: DataFrame, by: Sequence[str], x: str, out: str) -> DataFrame:
    """Average ranks within large groups, exact, without a window over a whole group; null for null."""
    ends = value_ends(df, by, x)
    ranks = ends.select(*[F.col(c).alias(f"__r_{c}") for c in (*by, x)], (F.col("__end") - (F.col("__n") - 1) / 2.0).alias(out))
    return df.join(ranks, _same([*by, x], "__r_"), "left").drop(*[f"__r_{c}" for c in (*by, x)])


def part_ranks(df: DataFrame, by: Sequence[str], x: str, out: str, parts: int = 128) -> DataFrame:
    """``average_ranks`` for a table that is quick to read: rows are read four times and shuffled once, no counts are joined to them.

    A group is cut at about equal places. Rows that equal a cut have one value and need only their number; those between two
    cuts are ranked in a window.
    """
    at = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    cuts = df.filter(F.col(x).isNotNull()).groupBy(*[F.col(c).alias(f"__b_{c}") for c in by]).agg(F.percentile_approx(x, at, 10000).alias("__cuts"))
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(parts.bit_length() - 1))])
    less = F.aggregate(steps, F.lit(0), lambda i, s: i + F.when(F.get("__cuts", i + s - 1) < F.col(x), s).otherwise(0))
    cut = df.join(materialize(cuts, "cuts"), _same(by, "__b_"), "left").drop(*[f"__b_{c}" for c in by])
    cut = cut.withColumn("__part", F.when(F.col(x).isNotNull(), less)).withColumn("__part", 2 * F.col("__part") + F.coalesce(F.get("__cuts", F.col("__part")) == F.col(x), F.lit(False)).cast("int")).drop("__cuts")
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    ahead = cut.groupBy(*by, "__part").agg(F.count("__part").alias("__t")).withColumn("__ahead", F.coalesce(F.sum("__t").over(before), F.lit(0)))
    ahead = materialize(ahead.select(*[F.col(c).alias(f"__b_{c}") for c in (*by, "__part")], "__t", "__ahead"), "ahead")
    both = cut.join(ahead, _same([*by, "__part"], "__b_")).drop(*[f"__b_{c}" for c in (*by, "__part")])
    within = Window.partitionBy(*by, "__part").orderBy(x)
    equal = both.filter(F.col("__part").isNull() | (F.col("__part") % 2 == 1)).withColumn(out, F.when(F.col("__part").isNotNull(), F.col("__ahead") + (F.col("__t") + 1) / 2.0))
    between = both.filter(F.col("__part") % 2 == 0)
    between = between.withColumn(out, F.col("__ahead") + F.rank().over(within) + (F.count("*").over(within.rangeBetween(Window.currentRow, Window.currentRow)) - 1) / 2.0)
    return equal.unionByName(between).drop("__part", "__t", "__ahead")


def exact_quantiles(df: DataFrame, by: Sequence[str], x: str, quantiles: dict[str, float]) -> DataFrame:
    """``by`` and a column for each of ``quantiles``: exact ones, between two values by their distance, of large groups too; one row if ``by`` is empty."""
    keys = list(by) or ["__every"]
    return quantiles_of(value_ends(df if by else df.withColumn("__every", F.lit(1)), keys, x), keys, x, quantiles).drop("__every")


def quantiles_of(ends: DataFrame, by: Sequence[str], x: str, quantiles: dict[str, float]) -> DataFrame:
    """``exact_quantiles`` from ``value_ends``."""
    begin, end, v = F.col("__end") - F.col("__n"), F.col("__end"), F.col(x).cast("double")
    values = []
    for name, p in quantiles.items():
        at = (F.col("__total") - 1) * p
        for place, k in (("a", F.floor(at)), ("b", F.ceil(at))):
            values.append(F.max(F.when((begin <= k) & (k < end), v)).alias(f"__{place}_{name}"))
        values.append(F.max(at - F.floor(at)).alias(f"__f_{name}"))
    got = ends.groupBy(*by).agg(*values)
    return got.select(*by, *[(F.col(f"__a_{n}") + F.col(f"__f_{n}") * (F.col(f"__b_{n}") - F.col(f"__a_{n}"))).alias(n) for n in quantiles])


def positions(df: DataFrame, by: Sequence[str], x: str, tie: str, out: str) -> DataFrame:
    """Row numbers of non-null values within large groups by value and tie, exact, without a window over a whole group."""
    rows = _cut(df.filter(F.col(x).isNotNull()), by, x)
    order = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = rows.groupBy(*by, "__part").agg(F.count("*").alias("__t")).withColumn("__ahead", F.coalesce(F.sum("__t").over(order), F.lit(0))).drop("__t")
    ahead = ahead.select(*[F.col(c).alias(f"__b_{c}") for c in (*by, "__part")], "__ahead")
    both = rows.join(ahead, [F.col(c).eqNullSafe(F.col(f"__b_{c}")) for c in (*by, "__part")]).drop(*[f"__b_{c}" for c in (*by, "__part")])
    number = F.col("__ahead") + F.row_number().over(Window.partitionBy(*by, "__part").orderBy(x, tie))
    return both.withColumn(out, number).drop("__ahead", "__part").unionByName(df.filter(F.col(x).isNull()).withColumn(out, F.lit(None).cast("long")))


def percentile_rank(df: DataFrame, by: Sequence[str], x: str, least: int = 4, out: str = "pct_rank") -> DataFrame:
    """Average rank over the number of values in the group, where it has ``least`` values. ``df`` is written once, as in ``cross_rank``."""
    df = materialize(df, "ranked")
    n = df.groupBy(*[F.col(c).alias(f"__n_{c}") for c in by]).agg(F.count(x).alias("__n"))
    both = average_ranks(df, by, x, "__rank").join(n, _same(by, "__n_"))
    return both.withColumn(out, F.when(F.col("__n") >= least, F.col("__rank") / F.col("__n"))).drop("__rank", "__n", *[f"__n_{c}" for c in by])


def cross_rank(df: DataFrame, by: Sequence[str], x: str) -> DataFrame:
    """Rank from the largest, number of values, mean of the others, and 1 - (rank - 1) / (n - 1) for rows with a value.

    ``df`` is written once: it is read three times, and ranks meet their rows by value. Values that are sums come out with other
    last digits when they are computed again, as parts arrive in another order; such rows would have no rank.
    """
    df = materialize(df.drop("rank"), "ranked")
    facts = df.groupBy(*[F.col(c).alias(f"__n_{c}") for c in by]).agg(F.count(x).alias("__count"), F.sum(x).alias("__sum"))
    ranks = value_ends(df, by, x).select(*[F.col(c).alias(f"__r_{c}") for c in (*by, x)], (F.col("__total") - F.col("__end") + 1).alias("rank"))
    both = df.join(ranks, _same([*by, x], "__r_"), "left").join(facts, _same(by, "__n_")).withColumn("n", F.col("__count"))
    out = both.withColumn("others_mean", F.when(F.col(x).isNotNull(), F.try_divide(F.col("__sum") - F.col(x), F.col("n") - 1)))
    out = out.withColumn("percentile", 1 - (F.col("rank") - 1) / F.greatest(F.col("n") - 1, F.lit(1)))
    return out.drop("__sum", "__count", *[f"__n_{c}" for c in by], *[f"__r_{c}" for c in (*by, x)])


def minus_group_median(df: DataFrame, by: Sequence[str], x: str, out: str = "demedianed") -> DataFrame:
    medians = exact_quantiles(df, by, x, {"__m": 0.5})
    return df.join(medians, list(by), "left").withColumn(out, F.col(x) - F.col("__m")).drop("__m")


def lagged_log(df: DataFrame, key: str, order: str, x: str, out: str = "log_pre") -> DataFrame:
    """Logarithm of the value of the row before, where that is positive."""
    pre = F.lag(x).over(Window.partitionBy(key).orderBy(order))
    return df.withColumn(out, F.when(pre > 0, F.log(pre)))


def range_counts(left: DataFrame, right: DataFrame, key: str, left_date: str, right_date: str, days: Sequence[int], value: str | None = None) -> DataFrame:
    """For each left row how many right rows of its key (and their sum of ``value``) lie in the ``days`` before it, its own day not among them.

    Both sides go into one table that is sorted once per key; frames run over day numbers.
    """
    day = lambda c: F.datediff(F.col(c), F.lit("1970-01-01"))
    a = left.select(F.col(key).alias("__k"), day(left_date).alias("__d"), F.struct("*").alias("__row"), F.lit(0).alias("__r"), F.lit(None).cast("double").alias("__v"))
    b = right.select(F.col(key).alias("__k"), day(right_date).alias("__d"), F.lit(1).alias("__r"), (F.col(value) if value else F.lit(1)).cast("double").alias("__v"))
    both = a.unionByName(b, allowMissingColumns=True)
    out = {}
    for n in days:
        frame = Window.partitionBy("__k").orderBy("__d").rangeBetween(-n, -1)
        out[f"n_{n}d"] = F.coalesce(F.sum("__r").over(frame), F.lit(0))
        if value:
            out[f"sum_{n}d"] = F.coalesce(F.sum("__v").over(frame), F.lit(0.0))
    return both.withColumns(out).filter("__row is not null").select("__row.*", *out)


def quantile_buckets(df: DataFrame, x: str, tie: str, q: int, by: Sequence[str], out: str = "bucket") -> DataFrame:
    """Buckets 1 to q of equal share by rank within groups (ties by ``tie``); null for null."""
    n = df.groupBy(*[F.col(c).alias(f"__n_{c}") for c in by]).agg(F.count(x).alias("__n"))
    both = positions(df, by, x, tie, "__r").join(n, [F.col(c).eqNullSafe(F.col(f"__n_{c}")) for c in by])
    bucket = F.greatest(F.lit(1), F.ceil((F.col("__r") - 1) * q / F.greatest(F.col("__n") - 1, F.lit(1)))).cast("int")
    return both.withColumn(out, F.when(F.col(x).isNotNull(), bucket)).drop("__r", "__n", *[f"__n_{c}" for c in by])


def best_per_key(df: DataFrame, key: Sequence[str], order: Sequence[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each key in an order that should name a unique column last."""
    w = Window.partitionBy(*key).orderBy(*order)
    out = df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n)
    return out.withColumnRenamed("__rn", rank) if rank else out.drop("__rn")
