"""Composites of the event study and feature sets: panels, event metrics, scores, surprises, dictionaries, selections."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.functions.text import safe_ratio
from tarnflow.operators.checks import LEAKY
from tarnflow.operators.joins import align_forward, asof_backward, nearest_in_range
from tarnflow.operators.windows import average_ranks, count_ends, cumulative_sums, end_value, event_sums, exact_quantiles, part_ranks, peer_mean_ex_self, pre_value
from tarnflow.session import materialize


def daily_panel(rows: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """``code, dt, value, n, ret``: a key's daily sums and their change from its row before (null for the first, or from zero)."""
    days = rows.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).groupBy(F.col(key).alias("code"), F.to_date(ts).alias("dt")).agg(F.sum(value).alias("value"), F.count("*").alias("n"))
    before = F.lag("value").over(Window.partitionBy("code").orderBy("dt"))
    return days.withColumn("ret", safe_ratio(F.col("value"), before) - 1)


def abnormal_panel(panel: DataFrame) -> DataFrame:
    """The panel with the mean change of the other keys on the day, and the change beyond it. The panel is written once: it is read twice."""
    panel = materialize(panel, "panel")
    return peer_mean_ex_self(panel, ["dt"], "ret").withColumn("abret", F.col("ret") - F.col("peer_mean"))


def event_metrics(panel: DataFrame, windows: dict[str, tuple[int, int]]) -> DataFrame:
    """For every row of the panel what an event on it would see: sums over windows, values before and at the end, change and impact."""
    out = event_sums(abnormal_panel(panel), "code", "dt", "abret", windows)
    out = pre_value(out, "code", "dt", ["value"])
    for name, (_, b) in windows.items():
        out = end_value(out, "code", "dt", ["value"], b, f"_end_{name}")
        out = out.withColumns({
            f"change_{name}": F.col(f"value_end_{name}") - F.col("value_pre"),
            f"return_{name}": safe_ratio(F.col(f"value_end_{name}"), F.col("value_pre")) - 1,
            f"impact_{name}": F.col("value_pre") * F.col(f"sum_{name}"),
        })
    return out


def study_events(events: DataFrame, panel: DataFrame, key: str, date: str, windows: dict[str, tuple[int, int]], carry: Sequence[str] | None = None) -> DataFrame:
    """Events aligned to the first panel day on or after theirs, with the metrics of that day (or those that ``carry`` names)."""
    metrics = event_metrics(panel, windows)
    carry = [c for c in metrics.columns if c not in ("code", "dt")] if carry is None else list(carry)
    return align_forward(events, metrics, key, date, "dt", carry) if key == "code" else align_forward(events, metrics.withColumnRenamed("code", key), key, date, "dt", carry)


def raw_sums(panel: DataFrame, key: str, order: str, x: str, a: int, b: int, out: str) -> DataFrame:
    """The sum of the rows from a to b around each row, looked up place by place instead of in a frame."""
    w = Window.partitionBy(key).orderBy(order)
    return panel.withColumn(out, sum((F.coalesce(F.lead(x, k).over(w), F.lit(0.0)) for k in range(a, b + 1)), F.lit(0.0)))


def event_scores(df: DataFrame, car: str, n_sources: str, volume: str) -> DataFrame:
    """``objective`` and ``priority`` scores from capped parts: abnormal change, sources, volume."""
    size = F.least(F.coalesce(F.abs(F.col(car)), F.lit(0.0)) * 100, F.lit(20.0))
    sources = F.least(F.col(n_sources).cast("double"), F.lit(5.0)) * 2
    amount = F.least(F.log1p(F.greatest(F.col(volume).cast("double"), F.lit(0.0))), F.lit(10.0))
    return df.withColumns({"objective": size + amount, "priority": size + sources + 0.5 * amount})


def evidence_chain(events: DataFrame, hits: DataFrame, key: str, group: str, n: str, link: str) -> DataFrame:
    """Events with their evidence (``hits``, unique by key): a link, that of another event of the group where they have none, a level from 0 to 3, and a score.

    Level: 3 for three hits or more, 2 for any, 1 for a group's link alone. Score: size of ``change``, plus ``priority``, plus five for each level.
    """
    both = events.join(hits, key, "left")
    groups = both.groupBy(F.col(group).alias("__g")).agg(F.min(link).alias("__link"))
    both = both.join(groups, F.col(group) == F.col("__g"), "left")
    count = F.coalesce(F.col(n), F.lit(0))
    level = F.when(count >= 3, 3).when(count >= 1, 2).when(F.col("__link").isNotNull(), 1).otherwise(0)
    out = both.withColumns({"hits": count, "level": level, "backfilled": F.col(link).isNull() & F.col("__link").isNotNull(), "link": F.coalesce(link, "__link")})
    return out.withColumn("score", F.abs("change") + F.col("priority") + 5 * F.col("level")).drop("__g", "__link")


def forecast_surprise(events: DataFrame, forecasts: DataFrame, key: str, date: str, f_date: str, low: str, high: str, recent: int = 100) -> DataFrame:
    """Midpoint and direction of the latest forecast before an event; a stale one (over ``recent`` days) has neither."""
    got = asof_backward(events, forecasts, key, date, f_date, [low, high], [low, high])
    fresh = F.col("days_since") <= recent
    mid = (F.col(low) + F.col(high)) / 2
    return got.withColumns({"forecast_mid": F.when(fresh, mid), "forecast_sign": F.when(fresh, F.signum(mid).cast("int")), "forecast_fresh": F.coalesce(fresh, F.lit(False))})


def yoy(df: DataFrame, key: str, period: str, x: str, slack: int = 20) -> DataFrame:
    """The value a year before (``slack`` days either way, the earliest), and the change from it over its size."""
    base = df.select(key, F.col(period).alias("base_period"), F.col(x).alias("base_value"))
    pairs = nearest_in_range(df, base, key, [key, period], period, "base_period", -365 - slack, -365 + slack, -365 - slack)
    pairs = pairs.select(F.col(key).alias("__k"), F.col(period).alias("__p"), "base_period", "base_value")
    out = df.join(pairs, (df[key] == F.col("__k")) & (df[period] == F.col("__p")), "left").drop("__k", "__p")
    return out.withColumn("yoy", safe_ratio(F.col(x) - F.col("base_value"), F.abs("base_value")))


def normalized(df: DataFrame, key: str, date: str, row: str, columns: Sequence[str], least_values: int = 6, least_before: int = 3, least_group: int = 4) -> DataFrame:
    """``row, feature, selfz, yoy, xsrank, xsdemed``: each column against its own past, the year before, and others of the quarter.

    Columns with fewer than ``least_values`` different values are flags and are left out. ``selfz``: distance from the mean of the key's
    rows before, in their standard deviations, from ``least_before`` values on. ``yoy``: change over its size from the key's value
    nearest to 365 days before (300 to 420, the earlier of two as near, the first row of a day). ``xsrank, xsdemed``: percentile rank in the quarter and
    distance from its median, where it has ``least_group`` values. All columns go through as one table of long form; ``row`` is unique.
    """
    counts = df.agg(*[F.count_distinct(c).alias(c) for c in columns]).head()
    wide = [c for c in columns if counts[c] >= least_values]
    long = df.select(F.col(row).alias("row"), F.col(key).alias("key"), F.to_date(date).alias("date"), *[F.col(c).cast("double").alias(c) for c in wide])
    if not wide:
        return long.select("row", F.lit("").alias("feature"), *[F.lit(0.0).alias(c) for c in ("selfz", "yoy", "xsrank", "xsdemed")]).limit(0)
    long = long.unpivot(["row", "key", "date"], wide, "feature", "value").withColumn("quarter", F.date_trunc("quarter", "date"))
    long = long.withColumn("__k", F.struct("key", "feature"))
    before = Window.partitionBy("key", "feature").orderBy("date", "row").rowsBetween(Window.unboundedPreceding, -1)
    z = F.try_divide(F.col("value") - F.avg("value").over(before), F.nullif(F.stddev_samp("value").over(before), F.lit(0.0)))
    out = materialize(long.withColumn("selfz", F.when(F.count("value").over(before) >= least_before, z)), "long")
    known = out.filter("value is not null and date is not null").select("__k", "row", "date", "value")
    prior = known.groupBy("__k", F.col("date").alias("past")).agg(F.min_by("value", "row").alias("prior"))
    past = nearest_in_range(known, prior, "__k", ["__k", "row"], "date", "past", -420, -300, -365)
    past = past.select("row", F.col("__k.feature").alias("feature"), F.try_divide(F.col("value") - F.col("prior"), F.abs("prior") + 1e-9).alias("yoy"))
    sizes = out.groupBy("feature", "quarter").agg(F.count("value").alias("__n"))
    ranked = average_ranks(out, ["feature", "quarter"], "value", "__rank").join(exact_quantiles(out, ["feature", "quarter"], "value", {"__m": 0.5}), ["feature", "quarter"], "left").join(sizes, ["feature", "quarter"], "left")
    enough = F.col("__n") >= least_group
    ranked = ranked.withColumns({"xsrank": F.when(enough, F.col("__rank") / F.col("__n")), "xsdemed": F.when(enough, F.col("value") - F.col("__m"))})
    return ranked.join(past, ["row", "feature"], "left").select("row", "feature", "selfz", "yoy", "xsrank", "xsdemed")


def latest_statements(left: DataFrame, statements: dict[str, DataFrame], key: str, date: str, announced: str = "announced", end: str = "end") -> DataFrame:
    """``left`` with each statement's latest row announced by its date: columns ``<name>_<column>``, among them ``<name>_end``, the end of its period.

    All statements and the left rows are one table, sorted once per key; each statement's last row seen is carried on. Of rows
    announced on one day that of the latest period wins. A left row without a date, or before the first statement, has nulls.
    """
    kinds = {n: F.struct(*[F.col(c) for c in s.columns if c not in (key, announced)]) for n, s in statements.items()}
    both = left.select(F.col(key).alias("__k"), F.col(date).alias("__d"), F.struct("*").alias("__row"))
    for name, s in statements.items():
        part = s.filter(F.col(announced).isNotNull()).select(F.col(key).alias("__k"), F.col(announced).alias("__d"), kinds[name].alias(f"__{name}"), F.col(end).alias("__end"))
        both = both.unionByName(part, allowMissingColumns=True)
    order = [F.asc_nulls_first("__d"), F.col("__row").isNotNull().cast("int"), F.asc_nulls_first("__end")]
    w = Window.partitionBy("__k").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumns({f"__{n}": F.last(f"__{n}", ignorenulls=True).over(w) for n in statements}).filter("__row is not null")
    names = [(n, c) for n, s in statements.items() for c in s.columns if c not in (key, announced)]
    return out.select("__row.*", *[F.col(f"__{n}.{c}").alias(f"{n}_{c}") for n, c in names])


def rank_correlation(df: DataFrame, by: Sequence[str], x: str, y: str, least: int = 3, out: str = "ic", x_rank: str | None = None) -> DataFrame:
    """Spearman correlation per group over rows with both values (0 where one is constant), and their number. ``x_rank`` names ranks of ``x`` among these rows, if known.

    Only ``x`` gets ranks row by row; of the rows with one value of ``y`` their sums are enough.
    """
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    first = rows.select(*by, y, F.col(x_rank).alias("__x")) if x_rank else average_ranks(rows.select(*by, x, y), by, x, "__x")
    return cell_correlation(rank_cells(first, by, F.col(y), F.col("__x")), by, least, out)


def rank_cells(rows: DataFrame, by: Sequence[str], y: Column, x_rank: Column) -> DataFrame:
    """For each value ``__y`` of a group how many rows have it and the sums of their ranks of another value, written once."""
    facts = {"__n": F.count("*"), "__sum": F.sum(x_rank), "__squares": F.sum(x_rank * x_rank), "__low": F.min(x_rank), "__high": F.max(x_rank)}
    return materialize(rows.groupBy(*by, y.alias("__y")).agg(*[v.cast("double" if c != "__n" else "long").alias(c) for c, v in facts.items()]), "cells")


def cell_correlation(cells: DataFrame, by: Sequence[str], least: int = 1, out: str = "ic") -> DataFrame:
    """``rank_correlation`` from ``rank_cells``."""
    rank = F.col("__end___n") - (F.col("__n") - 1) / 2.0 - (F.col("__total___n") + 1) / 2.0  # from the mean rank
    sums = cumulative_sums(cells, by, "__y", ["__n"]).groupBy(*by).agg(
        F.sum("__n").alias("n"), F.sum(rank * F.col("__sum")).alias("__xy"), F.sum(rank * rank * F.col("__n")).alias("__yy"),
        (F.sum("__squares") - F.sum("__sum") * F.sum("__sum") / F.sum("__n")).alias("__xx"), (F.min("__low") < F.max("__high")).alias("__moves"),
    )
    ic = F.when(F.col("__moves") & (F.col("__yy") > 0), F.try_divide(F.col("__xy"), F.sqrt("__xx") * F.sqrt("__yy"))).otherwise(0.0)
    return sums.select(*by, "n", ic.alias(out)).filter(F.col("n") >= least)


#: Values of all columns together whose ranks are broadcast.
_LOOKUP = 1 << 20


def ic_manifest(df: DataFrame, features: Sequence[str], split: str, target: str) -> DataFrame:
    """Per feature its missing rate, its rank correlation in train and test, and whether the sign holds.

    Features with few values are ranked by counts and meet the target in one pass (``few_correlations``), whatever their number; the others
    one by one.
    """
    facts = df.agg(F.count("*").alias("__rows"), *[F.count(f).alias(f"__n_{f}") for f in features], *[F.approx_count_distinct(F.struct(split, f)).alias(f"__d_{f}") for f in features]).head()
    few, left = [], _LOOKUP
    for f in sorted(features, key=lambda f: facts[f"__d_{f}"]):
        if (left := left - facts[f"__d_{f}"]) >= 0:
            few.append(f)
    found = [few_correlations(df, few, split, target)] if few else []
    for f in features:
        if f not in few:
            rows = df.filter(F.col(f).isNotNull() & F.col(target).isNotNull()).select(split, F.col(f).alias("__x"), F.col(target).alias("__y"))
            one = rank_correlation(part_ranks(rows, [split], "__x", "__rank"), [split], "__x", "__y", x_rank="__rank")
            found.append(one.select(F.lit(f).alias("feature"), split, "n", "ic"))
    ic = reduce(DataFrame.unionByName, found)
    wide = ic.groupBy("feature").agg(*[F.max(F.when(F.col(split) == s, F.col("ic"))).alias(f"ic_{s}") for s in ("train", "test")], F.sum("n").alias("n"))
    rows = facts["__rows"]
    missing = df.sparkSession.createDataFrame([(f, (rows - facts[f"__n_{f}"]) / rows) for f in features if rows], "feature string, missing_rate double")
    return missing.join(wide, "feature", "left").withColumn("stable", F.coalesce(F.col("ic_train") * F.col("ic_test") > 0, F.lit(False)))


def few_correlations(df: DataFrame, features: Sequence[str], split: str, target: str, least: int = 3) -> DataFrame:
    """``feature, split, n, ic``: rank correlation of each feature with the target over rows with both, for features whose values may be broadcast.

    The rows of one target value are one cell with a count and a sum of ranks for each feature, so that rows are shuffled once for all of them.
    """
    rows = df.filter(F.col(target).isNotNull()).select(split, target, *[F.col(f).alias(f"__x{i}") for i, f in enumerate(features)])
    numbers = range(len(features))
    values = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"__x{i}").cast("double").alias("v")) for i in numbers])).alias("x")
    counts = rows.select(split, values).select(split, "x.*").filter("v is not null").groupBy("i", split, "v").agg(F.count("*").alias("__n"))
    centred = F.col("__end") - (F.col("__n") - 1) / 2.0 - (F.col("__total") + 1) / 2.0
    ranks = materialize(count_ends(materialize(counts, "counts"), ["i", split], "v").select("i", split, "v", "__n", centred.alias("__rank")), "ranks")
    spread = ranks.groupBy("i", split).agg(F.sum("__n").alias("n"), F.sum(F.col("__n") * F.col("__rank") * F.col("__rank")).alias("__xx"), (F.count("*") > 1).alias("__moves"))
    for i in numbers:
        own = ranks.filter(F.col("i") == i).select(F.col(split).alias("__s"), F.col("v").alias("__v"), F.col("__rank").alias(f"__r{i}"))
        rows = rows.join(F.broadcast(own), F.col(split).eqNullSafe(F.col("__s")) & (F.col(f"__x{i}").cast("double") == F.col("__v")), "left").drop("__s", "__v", f"__x{i}")  # _LOOKUP values
    cells = rows.groupBy(split, F.col(target).alias("__y")).agg(*[g(f"__r{i}").alias(f"__{n}{i}") for i in numbers for n, g in (("n", F.count), ("s", F.sum))])
    sums = cumulative_sums(materialize(cells, "cells"), [split], "__y", [f"__n{i}" for i in numbers])
    rank = {i: F.col(f"__end___n{i}") - (F.col(f"__n{i}") - 1) / 2.0 - (F.col(f"__total___n{i}") + 1) / 2.0 for i in numbers}
    sums = sums.groupBy(split).agg(*[F.sum(v).alias(f"__{n}{i}") for i in numbers for n, v in (("xy", rank[i] * F.col(f"__s{i}")), ("yy", rank[i] * rank[i] * F.col(f"__n{i}")))])
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(f).alias("feature"), F.col(f"__xy{i}").alias("__xy"), F.col(f"__yy{i}").alias("__yy")) for i, f in enumerate(features)])).alias("x")
    sums = sums.select(F.col(split).alias("__s"), each).select("__s", "x.feature", F.col("x.i").alias("__i"), "x.__xy", "x.__yy")
    both = spread.join(sums, F.col(split).eqNullSafe(F.col("__s")) & (F.col("i") == F.col("__i")))
    ic = F.when(F.col("__moves") & (F.col("__yy") > 0), F.try_divide(F.col("__xy"), F.sqrt("__xx") * F.sqrt("__yy"))).otherwise(0.0)
    return both.filter(F.col("n") >= least).select("feature", split, "n", ic.alias("ic"))


def best_representations(manifest: DataFrame, mark: str = "__") -> DataFrame:
    """The manifest of ``feature__representation`` columns in two columns, with the one of each feature marked whose correlation in training is largest by size (ties: by name)."""
    parts = F.split("feature", mark)
    named = manifest.withColumns({"representation": parts[1], "feature": parts[0]})
    w = Window.partitionBy("feature").orderBy(F.abs(F.coalesce("ic_train", F.lit(0.0))).desc(), "representation")
    return named.withColumn("best", F.row_number().over(w) == 1)


def select_features(manifest: DataFrame, most_missing: float = 0.5) -> DataFrame:
    """``feature, representation, position``: each feature's best representation, without leaky names and without those that lack values too often, in order of correlation."""
    kept = manifest.filter(F.col("best") & (F.col("missing_rate") <= most_missing) & ~F.col("feature").rlike(LEAKY))
    order = Window.orderBy(F.abs("ic_train").desc_nulls_last(), "feature")  # a row for each feature
    return kept.select("feature", "representation", F.row_number().over(order).cast("int").alias("position"))


def value_leaks(df: DataFrame, label: str, columns: Sequence[str], limit: float = 0.999) -> DataFrame:
    """``column, corr, by_name, by_value, leaky``: columns whose names tell of the time after the event, or whose values are the label's in other words."""
    row = df.agg(*[F.corr(c, label).alias(c) for c in columns]).unpivot([], list(columns), "column", "corr")
    out = row.withColumns({"by_name": F.col("column").rlike(LEAKY), "by_value": F.coalesce(F.abs("corr") >= limit, F.lit(False))})
    return out.withColumn("leaky", F.col("by_name") | F.col("by_value"))


def data_dictionary(df: DataFrame, roles: dict[str, str]) -> DataFrame:
    """``column, type, role, group, missing_rate, date_share, inferred`` of a table: schema and, from one pass over all rows, how often a value is missing or reads as a date.

    A text column is inferred to be of dates if four in five of its values are.
    """
    facts = [F.struct(
        F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.lit(roles.get(f.name, "feature")).alias("role"), F.lit(feature_group(f.name)).alias("group"),
        F.avg(F.col(f.name).isNull().cast("double")).alias("missing_rate"),
        F.coalesce(F.avg(F.when(F.col(f.name).isNotNull(), F.col(f.name).cast("string").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}").cast("double"))), F.lit(0.0)).alias("date_share"),
    ) for f in df.schema]
    out = df.agg(F.array(*facts).alias("x")).select(F.inline("x"))
    return out.withColumn("inferred", F.when((F.col("type") == "string") & (F.col("date_share") >= 0.8), "date").otherwise(F.col("type")))


def column_groups(spark, columns: Sequence[str]) -> DataFrame:
    """``column, group`` for each name."""
    return spark.createDataFrame([(c, feature_group(c)) for c in columns], "column string, group string")


def overlay(base: DataFrame, reviews: DataFrame, key: str, code: str, meanings: dict[str, str]) -> DataFrame:
    """Reviews with whether their code is known and their key repeated, the decision of those that are neither, and what ``base`` (unique by key) knows of the key."""
    counts = reviews.groupBy(F.col(key).alias("__k")).agg(F.count("*").alias("__n"))
    names = F.create_map(*[F.lit(x) for pair in meanings.items() for x in pair])
    out = reviews.join(counts, F.col(key) == F.col("__k")).drop("__k").join(base, key, "left")
    single = F.col("__n") == 1
    return out.withColumns({"valid": F.col(code).isin(*meanings), "duplicate": ~single, "decision": F.when(single, F.try_element_at(names, F.col(code)))}).drop("__n")


def feature_group(name: str) -> str:
    """The group that a column's name tells."""
    for head, group in (("n_", "count"), ("sum_", "window"), ("ret", "market"), ("value", "market"), ("ic_", "metric")):
        if name.startswith(head):
            return group
    return "other"


def regression_metrics(df: DataFrame, by: Sequence[str], y: str, p: str, y_rank: str | None = None) -> DataFrame:
    """n, MAE, RMSE, R2, share of equal signs, and rank correlation per group (by ranks of ``y`` that are known, if given)."""
    rows = df.filter(F.col(y).isNotNull() & F.col(p).isNotNull())
    e = F.col(y) - F.col(p)
    base = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (1 - F.sum(e * e) / F.nullif(F.var_pop(y) * F.count("*"), F.lit(0.0))).alias("r2"), F.avg((F.signum(y) == F.signum(p)).cast("double")).alias("direction"),
    )
    return base.join(rank_correlation(rows, by, y, p, 1, x_rank=y_rank).drop("n"), list(by), "left")


def winsorised(df: DataFrame, x: str, train: Column, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """A value clipped to quantiles of its training rows."""
    edge = exact_quantiles(df.filter(train), [], x, {"__lo": low, "__hi": high})
    return df.join(F.broadcast(edge), how="left").withColumn(f"{x}_clipped", F.greatest(F.least(F.col(x), F.col("__hi")), F.col("__lo"))).drop("__lo", "__hi")  # one row of edges
