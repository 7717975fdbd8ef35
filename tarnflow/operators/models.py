"""Models: preparation learnt on the training rows, linear models from sums that Spark takes in one pass, boosted trees on Spark ML, selection, explanation, inference."""

from __future__ import annotations

import platform
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.operators.features import cell_correlation, rank_cells, regression_metrics
from tarnflow.operators.windows import average_ranks, count_ends, quantiles_of
from tarnflow.session import materialize


def prepare(df: DataFrame, features: Sequence[str], train: Column, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """``z_<feature>`` for each feature, and all as the vector ``features``: nulls by the training median, clipped to training quantiles, standardised on the training rows.

    A feature without training values is 0; one that is constant there is only centred. The training rows are read once, to count each
    feature's values; medians, quantiles, means and deviations come from the counts. The new columns are expressions over ``df``.
    """
    long = df.filter(train).select(F.lit(1).alias("__one"), *[F.col(f).cast("double").alias(f) for f in features]).unpivot(["__one"], list(features), "feature", "value")
    counts = materialize(long.groupBy("feature", "value").agg(F.count("*").alias("__n")), "counts")

    def of(counts: DataFrame, quantiles: dict[str, float]) -> dict[str, dict]:
        ends = count_ends(counts, ["feature"], "value")
        return {r["feature"]: r.asDict() for r in quantiles_of(ends, ["feature"], "value", quantiles).collect()}  # a row for each feature

    def known(value: Column, facts: dict[str, dict], name: str) -> Column:
        """``value``, or that of its feature among ``facts``."""
        return F.coalesce(value, *[F.when(F.col("feature") == f, F.lit(facts[f][name] if f in facts else 0.0)) for f in features])

    medians = of(counts.filter("value is not null"), {"m": 0.5})
    counts = materialize(counts.groupBy("feature", known(F.col("value"), medians, "m").alias("value")).agg(F.sum("__n").alias("__n")), "filled")
    edges = of(counts, {"lo": low, "hi": high})
    clip = lambda v, f: F.greatest(F.least(v, F.lit(edges[f]["hi"])), F.lit(edges[f]["lo"])) if f in edges else v
    clipped = counts.select("feature", "__n", F.coalesce(*[F.when(F.col("feature") == f, clip(F.col("value"), f)) for f in features]).alias("v"))
    n, v = F.col("__n"), F.col("v")
    first = clipped.groupBy("feature").agg(F.min("v").alias("lo"), F.sum("__n").alias("n"))
    means = clipped.join(first, "feature").groupBy("feature", "lo", "n").agg((F.sum(n * (v - F.col("lo"))) / F.col("n")).alias("up"))  # a constant's mean is exact
    means = {r["feature"]: r["lo"] + r["up"] for r in means.collect()}
    from_mean = v - F.coalesce(*[F.when(F.col("feature") == f, F.lit(m)) for f, m in means.items()], F.lit(0.0))
    spread = clipped.groupBy("feature").agg(F.sqrt(F.sum(n * from_mean * from_mean) / F.nullif(F.sum("__n") - 1, F.lit(0))).alias("s"))
    spread = {r["feature"]: r["s"] for r in spread.collect()}
    filled = {f: F.coalesce(F.col(f).cast("double"), F.lit(medians[f]["m"] if f in medians else 0.0)) for f in features}
    out = df.withColumns({f"z_{f}": (clip(filled[f], f) - F.lit(means.get(f, 0.0))) / F.lit(spread.get(f) or 1.0) for f in features})
    return out.withColumn("features", array_to_vector(F.array(*[F.col(f"z_{f}") for f in features])))


@dataclass
class Linear:
    """A linear model over columns."""

    columns: list[str]
    coefficients: list[float]
    intercept: float

    def score(self, places: int | None = None) -> Column:
        """The prediction; to ``places``, ones that differ by the order of sums alone are equal."""
        x = sum((F.col(c) * b for c, b in zip(self.columns, self.coefficients, strict=True)), F.lit(self.intercept))
        return x if places is None else F.round(x, places)

    def transform(self, df: DataFrame, places: int | None = None) -> DataFrame:
        return df.withColumn("prediction", self.score(places))


def moments(train: DataFrame, xs: Sequence[str], y: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Covariances of the columns, with the label, their means, and that of the label: one row of sums comes to the driver."""
    rows = train.filter(F.col(y).isNotNull())
    pairs = [(i, j) for i in range(len(xs)) for j in range(i, len(xs))]
    aggs = [F.covar_pop(xs[i], xs[j]).alias(f"c_{i}_{j}") for i, j in pairs] + [F.covar_pop(x, y).alias(f"d_{i}") for i, x in enumerate(xs)] + [F.avg(x).alias(f"m_{i}") for i, x in enumerate(xs)]
    row = rows.agg(F.avg(y).alias("y"), *aggs).head()
    c = np.zeros((len(xs), len(xs)))
    for i, j in pairs:
        c[i, j] = c[j, i] = row[f"c_{i}_{j}"] or 0.0
    return c, np.array([row[f"d_{i}"] or 0.0 for i in range(len(xs))]), np.array([row[f"m_{i}"] or 0.0 for i in range(len(xs))]), row["y"] or 0.0


def fit_moments(found: tuple[np.ndarray, np.ndarray, np.ndarray, float], xs: Sequence[str], alpha: float, l1: float = 0.0, use: Sequence[str] | None = None) -> Linear:
    """The coefficients that make mean squared error / 2 + alpha * (l1 * sum |b| + (1 - l1) / 2 * sum b^2) least, by coordinate descent on the moments.

    Every model of a grid comes from the same moments. ``use`` names the columns that take part (default: all).
    """
    c, d, m, y = found
    b = np.zeros(len(xs))
    active = [i for i, x in enumerate(xs) if use is None or x in use]
    for _ in range(10_000):
        last = b.copy()
        for i in active:
            v = d[i] - c[i] @ b + c[i, i] * b[i]
            b[i] = np.sign(v) * max(abs(v) - alpha * l1, 0.0) / max(c[i, i] + alpha * (1 - l1), 1e-300)
        if np.abs(b - last).max(initial=0.0) < 1e-14:
            break
    return Linear(list(xs), b.tolist(), float(y - m @ b))


def fit_linear(train: DataFrame, xs: Sequence[str], y: str, alpha: float, l1: float = 0.0) -> Linear:
    return fit_moments(moments(train, xs, y), xs, alpha, l1)


def fixed_effects(df: DataFrame, train: Column, xs: Sequence[str], y: str, group: str, alpha: float, l1: float = 0.0) -> tuple[DataFrame, Linear]:
    """``df`` with ``prediction`` of a linear model with an intercept for each group of the training rows, and the model within groups.

    Label and columns are taken as distances from their group's training mean. A group without training rows has the mean intercept.
    """
    names = [y, *xs]
    per = df.filter(train).groupBy(F.col(group).alias("__g")).agg(*[F.avg(c).alias(f"__m_{c}") for c in names])
    per = materialize(per, "groups")  # of known size: rows are not shuffled by group, of which there may be few
    every = df.filter(train).agg(*[F.avg(c).alias(f"__a_{c}") for c in names])
    both = df.join(per, F.col(group).eqNullSafe(F.col("__g")), "left")
    within = both.filter(train).select(*[(F.col(c) - F.col(f"__m_{c}")).alias(c) for c in names])
    model = fit_linear(within, xs, y, alpha, l1)
    mean = {c: F.coalesce(F.col(f"__m_{c}"), F.col(f"__a_{c}")) for c in names}
    score = mean[y] + sum((F.col(x) - mean[x]) * b for x, b in zip(xs, model.coefficients, strict=True))
    out = both.join(F.broadcast(every)).withColumn("prediction", score)  # one row
    return out.drop("__g", *[f"__m_{c}" for c in names], *[f"__a_{c}" for c in names]), model


def fit_gbt(train: DataFrame, label: str, valid_flag: str | None = None, rounds: int = 20, seed: int = 7):
    m = GBTRegressor(labelCol=label, featuresCol="features", maxIter=rounds, maxDepth=3, lossType="absolute", seed=seed)
    return (m.setValidationIndicatorCol(valid_flag) if valid_flag else m).fit(train)


def select_linear(
    df: DataFrame, xs: Sequence[str], label: str, split: str, grid: Sequence[tuple[float, float]], y_rank: str | None = None, places: int | None = None, found: tuple | None = None
) -> DataFrame:
    """``alpha, l1, split, n, mae, ...`` of a linear model per penalty, with the one of least validation error marked: all models from one pass (or from the moments ``found``), all metrics from another."""
    found = found or moments(df.filter(F.col(split) == "train"), xs, label)
    models = [(a, l1, fit_moments(found, xs, a, l1)) for a, l1 in grid]
    each = F.explode(F.array(*[F.struct(F.lit(float(a)).alias("alpha"), F.lit(float(l1)).alias("l1"), m.score(places).alias("prediction")) for a, l1, m in models])).alias("x")
    scored = df.select(split, label, *([y_rank] if y_rank else []), each).select("*", "x.*").drop("x")
    out = materialize(regression_metrics(scored, ["alpha", "l1", split], label, "prediction", y_rank), "metrics")  # read twice
    best = out.filter(F.col(split) == "valid").agg(F.min_by(F.struct("alpha", "l1"), F.struct("mae", "alpha", "l1")).alias("best"))
    return out.join(F.broadcast(best)).withColumn("selected", F.struct("alpha", "l1") == F.col("best")).drop("best")  # one row


def registry(
    df: DataFrame, xs: Sequence[str], label: str, split: str, grid: Sequence[tuple[float, float]], y_rank: str | None = None, places: int | None = None, versions: dict[str, str] | None = None
) -> DataFrame:
    """What it takes to fit a grid of linear models again: ``alpha, l1, features, intercept, coefficients, rows, selected, test, valid_ic, target, low, high, versions``.

    ``features`` and ``coefficients`` are arrays in one order, ``rows`` counts those of each split, ``low`` and ``high`` are the least and greatest
    label fitted on, ``test`` holds the metrics of the test rows (null where there are none), ``versions`` those of what ran (or as given). A label
    that is null is not fitted. A row for each model, whatever the size of the table.
    """
    found = moments(df.filter(F.col(split) == "train"), xs, label)
    fits = [(float(a), float(l1), fit_moments(found, xs, a, l1)) for a, l1 in grid]
    spark = df.sparkSession
    rows = [(a, l1, m.columns, m.intercept, m.coefficients) for a, l1, m in fits]
    models = spark.createDataFrame(rows, "alpha double, l1 double, features array<string>, intercept double, coefficients array<double>")
    scores = materialize(select_linear(df, xs, label, split, grid, y_rank, places, found), "scores")
    facts = F.struct("n", "mae", "rmse", "r2", "direction", "ic")
    per = scores.groupBy("alpha", "l1").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(split), F.col("n"))))).alias("rows"), F.first("selected").alias("selected"),  # an entry for each split
        F.max(F.when(F.col(split) == "test", facts)).alias("test"), F.max(F.when(F.col(split) == "valid", F.col("ic"))).alias("valid_ic"),
    )
    edges = df.filter(F.col(split) == "train").agg(F.lit(label).alias("target"), F.min(label).alias("low"), F.max(label).alias("high"))
    used = versions or {"python": platform.python_version(), "spark": spark.version, "numpy": np.__version__}
    out = models.join(F.broadcast(per), ["alpha", "l1"]).join(F.broadcast(edges))  # a row for each model, and one row
    return out.withColumn("versions", F.create_map(*[F.lit(x) for pair in sorted(used.items()) for x in pair]))


#: About how many rows of a shuffle a task deals at once.
_DEALT = 1 << 16


def permutation_drop(
    df: DataFrame, model: Linear, label: str, key: Column, shuffles: int = 5, seed: int = 7, places: int | None = None, label_rank: str | None = None
) -> DataFrame:
    """``feature, drop_mean, drop_std``: how far the rank correlation falls when a column's values are dealt anew among all rows, over several shuffles.

    A row's place in an order of hashed keys takes the value at the same place in another such order, one for each column and
    shuffle. ``key`` names a row; rows with a null in the label or a column are left out. ``label_rank`` names ranks of the label
    among the others, if known.

    Hashes are even, so their leading bits cut every order into about the same parts. What is dealt is shuffled once, by part; the
    rows at a part's places come to it, and only sums per prediction leave it.
    """
    deals = [(s, c) for s in range(shuffles) for c in model.columns]
    order = lambda name: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(name), F.col("__key"))), 1, 15), 16, 10).cast("long")
    rows = df.filter(~F.greatest(*[F.col(c).isNull() for c in (label, *model.columns)])).withColumns({"__key": key, "__all": F.lit(1)})
    rows = average_ranks(rows, ["__all"], label, "__rank") if label_rank is None else rows.withColumn("__rank", F.col(label_rank))
    rows = rows.select("__all", "__key", F.col("__rank").cast("double").alias("__rank"), model.score().alias("__score"), *[F.col(c).cast("double").alias(c) for c in model.columns])
    rows = materialize(rows.repartitionByRange("__key").sortWithinPartitions("__key").withColumn("__tie", F.monotonically_increasing_id()), "rows")  # ties go by key
    rounded = lambda p: p if places is None else F.round(p, places)
    base = cell_correlation(rank_cells(rows, ["__all"], rounded(F.col("__score")), F.col("__rank")), ["__all"]).head()
    if base is None:
        return df.sparkSession.createDataFrame([], "feature string, drop_mean double, drop_std double")
    bits = max(len(deals).bit_length(), (base["n"] // _DEALT).bit_length())
    rest = 60 - bits  # a hash without its part, behind the number of its deal
    part = F.shiftright("__hash", rest).cast("int").alias("__part")
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("deal"), order(f"{seed}|{s}|{c}").alias("__hash"), F.col(c).alias("given")) for i, (s, c) in enumerate(deals)]))
    dealt = rows.select("__key", "__tie", *model.columns).select("__tie", each.alias("x")).select("__tie", "x.*")
    counts = np.zeros((len(deals), 1 << bits), np.int64)
    for r in dealt.groupBy("deal", part).agg(F.count("*").alias("n")).collect():  # a row for some 2 ** 15 that are dealt
        counts[r["deal"], r["__part"]] = r["n"]
    ends = counts.cumsum(axis=1)
    begins = ends - counts
    low, high = begins.min(axis=0), ends.max(axis=0)  # places from 0 that a part needs

    own = rows.withColumn("__hash", order(str(seed))).select("__hash", part, "__tie", "__rank", "__score", *model.columns)
    heads = np.zeros(1 << bits, np.int64)
    for r in own.groupBy("__part").agg(F.count("*").alias("n")).collect():
        heads[r["__part"]] = r["n"]
    spark = df.sparkSession
    ahead = spark.createDataFrame([(i, int(a)) for i, a in enumerate(heads.cumsum() - heads)], "__part int, __ahead long")
    number = F.row_number().over(Window.partitionBy("__part").orderBy("__hash", "__tie"))
    placed = own.withColumn("__n", number).join(F.broadcast(ahead), "__part")  # a row for each part
    placed = placed.select((F.col("__ahead") + F.col("__n") - 1).alias("__at"), "__rank", "__score", *model.columns).withColumn("__block", F.floor(F.col("__at") / _DEALT))
    wanted = [(b, i, int(x), int(y)) for i, (x, y) in enumerate(zip(low, high, strict=True)) for b in range(int(x) // _DEALT, int(y) // _DEALT + 1)]
    blocks = spark.createDataFrame(wanted, "__block long, __part int, __low long, __high long")
    placed = placed.join(F.broadcast(blocks), "__block").filter("__at >= __low and __at < __high").drop("__block", "__low", "__high")  # a few rows for each part
    keyed = F.shiftleft(F.col("deal").cast("long"), rest).bitwiseOR(F.col("__hash").bitwiseAND(F.lit((1 << rest) - 1)))
    given = dealt.select(part, keyed.alias("__order"), "__tie", "given")
    columns, at = list(model.columns), np.array([model.columns.index(c) for _, c in deals])
    weights = np.array([model.coefficients[i] for i in at], float)

    def mix(key: tuple, places: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        keys, part = given["__order"].to_numpy(np.int64), int(key[0])
        by = np.argsort(keys, kind="stable")
        if (keys[by][1:] == keys[by][:-1]).any():
            by = np.lexsort((given["__tie"].to_numpy(np.int64), keys))
        deal = keys[by] >> rest
        to = begins[deal, part] + np.arange(len(by)) - np.searchsorted(deal, deal)
        places = places.sort_values("__at")
        row = np.searchsorted(places["__at"].to_numpy(np.int64), to)
        moved = given["given"].to_numpy(float)[by] - places[columns].to_numpy(float)[row, at[deal]]
        return pd.DataFrame({"deal": deal, "prediction": places["__score"].to_numpy(float)[row] + moved * weights[deal], "rank": places["__rank"].to_numpy(float)[row]})

    mixed = placed.groupBy("__part").cogroup(given.groupBy("__part")).applyInPandas(mix, "deal long, prediction double, rank double")
    cells = rank_cells(mixed, ["deal"], rounded(F.col("prediction")), F.col("rank"))
    names = spark.createDataFrame(list(enumerate(c for _, c in deals)), "deal long, feature string")
    drops = cell_correlation(cells, ["deal"]).join(F.broadcast(names), "deal").withColumn("drop", F.lit(base["ic"]) - F.col("ic"))  # a row for each deal
    return drops.groupBy("feature").agg(F.avg("drop").alias("drop_mean"), F.stddev_pop("drop").alias("drop_std"))


def contributions(df: DataFrame, model: Linear, keys: Sequence[str], top: int = 5) -> DataFrame:
    """``keys, rank, feature, contribution``: the parts of a linear prediction, largest by size first (ties: by name)."""
    parts = [(F.col(c) * b, c) for c, b in zip(model.columns, model.coefficients, strict=True)]
    named = F.array(*[F.struct((-F.abs(v)).alias("size"), F.lit(c).alias("feature"), v.alias("contribution")) for v, c in parts])
    best = F.slice(F.sort_array(named), 1, top)
    return df.select(*keys, F.posexplode(best).alias("pos", "x")).select(*keys, (F.col("pos") + 1).alias("rank"), "x.feature", "x.contribution")


def absorb(df: DataFrame, groups: Sequence[str], columns: Sequence[str], tol: float = 1e-10, rounds: int = 200) -> tuple[DataFrame, int]:
    """``df`` with each of ``columns`` as its distance from the effects of two groupings, and how many effects these are.

    Both groupings' effects are fitted in turns (alternating projections) until none moves by more than ``tol`` standard
    deviations. The turns read only the sums per pair of groups, written once; rows are read twice. Rows with a null in a
    column or a group are left out. The effects are counted as those of groupings that hang together.
    """
    a, b = groups
    rows = df.filter(~F.greatest(*[F.col(c).isNull() for c in [a, b, *columns]]))
    cells = rows.groupBy(a, b).agg(F.count("*").alias("__n"), *[F.sum(c).alias(f"__s_{c}") for c in columns], *[F.sum(F.col(c) * F.col(c)).alias(f"__q_{c}") for c in columns])
    cells = materialize(cells, "cells")
    facts = cells.agg(F.sum("__n"), *[F.sum(f"__q_{c}") / F.sum("__n") - F.pow(F.sum(f"__s_{c}") / F.sum("__n"), 2) for c in columns]).head()
    least = {c: tol * max(float(v or 0.0), 1e-300) ** 0.5 for c, v in zip(columns, facts[1:], strict=True)}

    def turn(by: str, other: str, given: DataFrame | None) -> DataFrame:
        left = cells if given is None else cells.join(given, other)
        rest = [(F.sum(f"__s_{c}") if given is None else F.sum(F.col(f"__s_{c}") - F.col("__n") * F.col(f"__e_{c}"))) / F.sum("__n") for c in columns]
        return materialize(left.groupBy(by).agg(*[r.alias(f"__e_{c}") for r, c in zip(rest, columns, strict=True)]), "effects")

    first = turn(a, b, None)
    second = turn(b, a, first)
    for _ in range(rounds):
        first = turn(a, b, second)
        after = turn(b, a, first)
        moved = after.join(second.select(b, *[F.col(f"__e_{c}").alias(f"__o_{c}") for c in columns]), b)
        most = moved.agg(*[F.max(F.abs(F.col(f"__e_{c}") - F.col(f"__o_{c}"))) for c in columns]).head()
        second = after
        if all((m or 0.0) <= least[c] for m, c in zip(most, columns, strict=True)):
            break
    else:
        raise RuntimeError(f"the effects did not settle in {rounds} rounds")
    out = rows
    for by, effects in ((a, first), (b, second)):
        out = out.join(effects, by)
        out = out.withColumns({c: F.col(c) - F.col(f"__e_{c}") for c in columns}).drop(*[f"__e_{c}" for c in columns])
    return out, max(first.count() + second.count() - 1, 0)


def cluster_blocks(df: DataFrame, cluster: str, y: str, xs: Sequence[str], const: bool = True) -> DataFrame:
    """Per cluster the sums that a regression needs: n, X'X, X'y and y'y (with an intercept, if ``const``), from one pass."""
    cols = [*([F.lit(1.0)] if const else []), *[F.col(x).cast("double") for x in xs]]
    rows = df.filter(F.col(y).isNotNull() & ~F.greatest(*[F.col(x).isNull() for x in xs], F.lit(False)))
    k = len(cols)
    aggs = [F.sum(cols[i] * cols[j]).alias(f"a_{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(c * F.col(y)).alias(f"b_{i}") for i, c in enumerate(cols)]
    return rows.groupBy(cluster).agg(F.count("*").alias("n"), F.sum(F.col(y) * F.col(y)).alias("yy"), *aggs)


def _unpack(blocks: pd.DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    a = np.zeros((len(blocks), k, k))
    for i in range(k):
        for j in range(i, k):
            a[:, i, j] = a[:, j, i] = blocks[f"a_{i}_{j}"]
    return a, blocks[[f"b_{i}" for i in range(k)]].to_numpy(float)


def _totals(blocks: DataFrame, k: int, effects: int = 0) -> tuple[np.ndarray, np.ndarray, int, float]:
    """Summed X'X and X'y, the number of clusters, and the factor of small samples: one row comes to the driver."""
    names = [c for c in blocks.columns if c.startswith(("a_", "b_"))]
    row = blocks.agg(F.count("*").alias("g"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in names]).toPandas()
    a, b = _unpack(row, k)
    g, n = int(row["g"][0]), int(row["n"][0])
    return a[0], b[0], g, (g / max(g - 1, 1)) * ((n - 1) / max(n - k - effects, 1))


def cluster_ols(df: DataFrame, cluster: str, y: str, xs: Sequence[str], effects: Sequence[str] | None = None) -> DataFrame:
    """``term, coef, se, t``: least squares with cluster-robust errors, from blocks that Spark sums per cluster and over clusters.

    With ``effects``, two columns, the model has an intercept for each value of both (fixed effects) instead of one.
    """
    n_effects = 0
    if effects:
        df, n_effects = absorb(df.select(cluster, *{*effects} - {cluster}, y, *xs), effects, [y, *xs])
    terms = [*([] if effects else ["const"]), *xs]
    k = len(terms)
    blocks = materialize(cluster_blocks(df, cluster, y, xs, not effects).drop(cluster), "blocks")
    a, b, _, scale = _totals(blocks, k, n_effects)
    inv = np.linalg.pinv(a)
    beta = inv @ b
    u = [F.col(f"b_{i}") - sum(F.col(f"a_{min(i, j)}_{max(i, j)}") * float(beta[j]) for j in range(k)) for i in range(k)]  # each cluster's score
    sums = blocks.agg(*[F.coalesce(F.sum(u[i] * u[j]), F.lit(0.0)).alias(f"{i}_{j}") for i in range(k) for j in range(k)]).head()
    v = inv @ np.array(sums, float).reshape(k, k) @ inv * scale
    se = np.sqrt(np.diag(v))
    rows = [(t, float(c), float(s), float(c / s) if s > 0 else None) for t, c, s in zip(terms, beta, se, strict=True)]
    return df.sparkSession.createDataFrame(rows, "term string, coef double, se double, t double")


#: Draws whose signs a task holds at once for a batch of clusters.
_DRAWS = 128
#: Values of the second effect that the bootstrap takes (years, say): tasks hold matrices of this size squared.
MAX_LEVELS = 256


def _signs(clusters: np.ndarray, draws: np.ndarray, seed: int) -> np.ndarray:
    """A sign for each cluster's hash and draw; draw 0 is the data as it is."""
    h = clusters.view(np.uint64)[:, None] ^ ((draws.astype(np.uint64) + np.uint64(seed) * np.uint64(1_000_003)) * np.uint64(0x9E3779B97F4A7C15))[None, :]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return np.where((draws == 0)[None, :] | ((h >> np.uint64(63)) == 0), 1.0, -1.0)


def _levels(df: DataFrame, cluster: str, level: str, y: str, xs: Sequence[str]) -> tuple[DataFrame, int]:
    """Per cluster's ``key`` arrays over the values of ``level``: rows ``ln``, sums of y ``ly`` and of each column ``l_i``."""
    found = [r[0] for r in df.select(level).distinct().limit(MAX_LEVELS + 1).collect()]
    if len(found) > MAX_LEVELS:
        raise ValueError(f"{level} has more than {MAX_LEVELS} values: use it as the cluster, or absorb it in cluster_ols")
    at = {v: i for i, v in enumerate(sorted(found))}
    names = df.sparkSession.createDataFrame([(i, v) for v, i in at.items()], f"__level int, {level} {df.schema[level].dataType.simpleString()}")
    cells = df.join(F.broadcast(names), level).groupBy(cluster, "__level").agg(F.count("*").cast("double").alias("ln"), F.sum(y).alias("ly"), *[F.sum(x).alias(f"l_{i}") for i, x in enumerate(xs)])
    values = ["ln", "ly", *[f"l_{i}" for i in range(len(xs))]]
    each = cells.groupBy(cluster).agg(F.map_from_entries(F.collect_list(F.struct("__level", F.struct(*values)))).alias("m"))  # at most MAX_LEVELS
    over = F.sequence(F.lit(0), F.lit(max(len(at) - 1, 0)))

    def along(v: str) -> Column:
        return F.transform(over, lambda i: F.coalesce(F.element_at("m", i)[v], F.lit(0.0))).alias(v)

    return each.select(cluster, *[along(v) for v in values]), len(at)


def wild_bootstrap(
    df: DataFrame, cluster: str, y: str, xs: Sequence[str], term: str, draws: int = 999, seed: int = 7, level: str | None = None
) -> DataFrame:
    """``t, p, draws``: restricted wild cluster bootstrap of one coefficient with signs drawn per cluster.

    With ``level`` the model has an effect for each cluster and for each value of ``level`` (at most MAX_LEVELS). Where all
    combinations of signs are no more than ``draws`` (few clusters), each of them is taken once instead of draws by hash.
    Tasks sum the signed scores of their clusters for each draw; only sums over all clusters leave them.
    """
    const, n_effects, n_levels = level is None, 0, 0
    if level is not None:
        df, n_effects = absorb(df.select(cluster, level, y, *xs), [cluster, level], [y, *xs])
        df = materialize(df, "absorbed")
    k, at = len(xs) + const, const + list(xs).index(term)
    blocks = cluster_blocks(df, cluster, y, xs, const)
    if level is not None:
        per, n_levels = _levels(df, cluster, level, y, xs)
        blocks = blocks.join(per, cluster)
    blocks = materialize(blocks.withColumn("key", F.xxhash64(cluster)).drop(cluster), "blocks")
    total, b, g, scale = _totals(blocks, k, n_effects)
    if not g:
        return df.sparkSession.createDataFrame([(0.0, None, 0)], "t double, p double, draws long")
    inv = np.linalg.pinv(total)
    keep = [i for i in range(k) if i != at]
    null = np.zeros(k)
    null[keep] = np.linalg.pinv(total[np.ix_(keep, keep)]) @ b[keep]
    listed = 0 < g < 31 and 2**g <= draws
    order = np.sort(np.array([r[0] for r in blocks.select("key").collect()], np.int64)) if listed else None  # log2(draws) at most
    last = 2**g if listed else draws + 1
    # A draw moves the coefficients by d = inv @ sum(w * score). With levels their effects e solve lap @ e = sum(w * residuals
    # per level). Of a cluster's new score the term takes w * q - v @ (d, e).
    m = k + n_levels
    names = [f"s_{i}" for i in range(m)] + [f"c_{i}" for i in range(m)] + ["qq"] + [f"v_{i}_{j}" for i in range(m) for j in range(m)] + [f"p_{i}_{j}" for i in range(n_levels) for j in range(n_levels)]

    def sums(batches):
        held = np.zeros((last, 2 * m))
        fixed = np.zeros(1 + m * m + n_levels * n_levels)
        for rows in batches:
            a, b = _unpack(rows, k)
            score = b - a @ null
            q, v = score @ inv[at], a @ inv[at]
            moves = score
            if n_levels:
                ln, ly, *lx = (np.stack(rows[c].to_numpy()).astype(float) for c in ["ln", "ly", *[f"l_{i}" for i in range(k)]])
                moves = np.concatenate([score, ly - sum(x * null[i] for i, x in enumerate(lx))], axis=1)
                v = np.concatenate([v, sum(x * inv[at, i] for i, x in enumerate(lx))], axis=1)
                fixed[1 + m * m :] += (np.diag(ln.sum(axis=0)) - (ln / ln.sum(axis=1)[:, None]).T @ ln).ravel()
            parts = np.concatenate([moves, q[:, None] * v], axis=1)
            fixed[: 1 + m * m] += np.concatenate([[q @ q], (v.T @ v).ravel()])
            for i in range(0, last, _DRAWS):
                some = np.arange(i, min(i + _DRAWS, last))
                keys = rows["key"].to_numpy(np.int64)
                signs = _signs(keys, some, seed) if order is None else 1.0 - 2.0 * ((some[None, :] >> np.searchsorted(order, keys)[:, None]) & 1)
                held[some] += signs.T @ parts
        out = pd.DataFrame(held, columns=names[: 2 * m])
        out.insert(0, "draw", np.arange(last))
        rest = np.zeros((last, len(names) - 2 * m))
        rest[0] = fixed  # the same for every draw
        yield pd.concat([out, pd.DataFrame(rest, columns=names[2 * m :])], axis=1)

    parts = blocks.mapInPandas(sums, ", ".join(["draw long", *[f"{c} double" for c in names]]))
    got = parts.groupBy("draw").agg(*[F.sum(c).alias(c) for c in names]).orderBy("draw").toPandas()  # a row for each draw
    fixed = got.loc[0, names[2 * m :]].to_numpy(float)
    moves = got[names[:m]].to_numpy(float)
    d = np.concatenate([moves[:, :k] @ inv, moves[:, k:] @ np.linalg.pinv(fixed[1 + m * m :].reshape(n_levels, n_levels))], axis=1)
    spread = fixed[0] - 2 * (d * got[names[m : 2 * m]].to_numpy(float)).sum(axis=1)
    spread += np.einsum("ni,ij,nj->n", d, fixed[1 : 1 + m * m].reshape(m, m), d)
    ts = d[:, at] / np.sqrt(np.maximum(spread * scale, 1e-300))
    others = ts if listed else ts[1:]
    p = float((np.abs(others) >= abs(ts[0]) * (1 - 1e-9)).mean()) if len(others) else None
    return df.sparkSession.createDataFrame([(float(ts[0]), p, len(others))], "t double, p double, draws long")
