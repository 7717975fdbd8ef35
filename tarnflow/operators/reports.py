"""Reports on classifiers over whole tables: curves from counts per score, confusion counts, and what each class is worth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.operators.windows import cumulative_sums
from tarnflow.session import materialize


def _rate(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b)


def curves(df: DataFrame, by: Sequence[str], label: str, score: str) -> DataFrame:
    """``by, roc_auc, pr_auc``: exact areas from counts per different score; equal scores count as one step of the curve.

    The area under precision and recall is average precision. Null where a group has one class only (precision: no positives).
    """
    hit = F.col(label).cast("int")
    counts = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*by, score).agg(F.count("*").alias("n"), F.sum(hit).alias("pos"))
    c = cumulative_sums(materialize(counts, "counts"), by, score, ["n", "pos"])
    positives, all_ = F.col("__total_pos"), F.col("__total_n")
    below = (F.col("__end_n") - F.col("n")) - (F.col("__end_pos") - F.col("pos"))
    pairs = F.col("pos") * (below + (F.col("n") - F.col("pos")) / 2)
    precision = (positives - F.col("__end_pos") + F.col("pos")) / (all_ - F.col("__end_n") + F.col("n"))
    out = c.groupBy(*by).agg(F.sum(pairs).alias("__pairs"), F.sum(F.col("pos") * precision).alias("__ap"), F.max(positives).alias("__p"), F.max(all_).alias("__n"))
    return out.select(*by, _rate(F.col("__pairs"), F.col("__p") * (F.col("__n") - F.col("__p"))).alias("roc_auc"), _rate(F.col("__ap"), F.col("__p")).alias("pr_auc"))


def confident_accuracy(df: DataFrame, by: Sequence[str], label: str, score: str, shares: Sequence[float], cut: float = 0.5) -> DataFrame:
    """``by, acc_at_<percent>``: accuracy on the share of rows whose scores lie farthest from ``cut`` (the whole part of n times the share).

    Distances that agree to 12 places are equal; where equal ones reach over the edge, as many of them as are wanted count with their mean accuracy. Null if no row is wanted.
    """
    right = ((F.col(score) >= cut) == F.col(label).cast("boolean")).cast("int")
    rows = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).withColumn("__far", F.round(F.abs(F.col(score) - cut), 12))
    counts = rows.groupBy(*by, "__far").agg(F.count("*").alias("n"), F.sum(right).alias("right"))
    c = cumulative_sums(materialize(counts, "counts"), by, "__far", ["n", "right"])
    above = F.col("__total_n") - F.col("__end_n")
    found = []
    for share in shares:
        want = F.floor(F.col("__total_n") * share)
        taken = F.greatest(F.least(want - above, F.col("n")), F.lit(0))
        found.append(_rate(F.sum(F.col("right") * taken / F.col("n")), F.max(want)).alias(f"acc_at_{round(100 * share)}"))
    return c.groupBy(*by).agg(*found)


def binary_report(df: DataFrame, by: Sequence[str], label: str, score: str, shares: Sequence[float] = (0.5, 0.3), cut: float = 0.5) -> DataFrame:
    """All of a two-class report for each group: sizes, accuracy, balanced accuracy, precision, recall, F1, both areas, accuracy of the most confident."""
    hit, said = F.col(label).cast("boolean"), F.col(score) >= cut
    cells = {"tp": hit & said, "fp": ~hit & said, "fn": hit & ~said, "tn": ~hit & ~said}
    rows = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    tp, fp, fn, tn = (F.col(c) for c in cells)
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.count_if(v).alias(c) for c, v in cells.items()])
    out = out.withColumns({
        "base_rate": _rate(tp + fn, F.col("n")), "majority": _rate(F.greatest(tp + fn, tn + fp), F.col("n")), "accuracy": _rate(tp + tn, F.col("n")), "balanced": (_rate(tp, tp + fn) + _rate(tn, tn + fp)) / 2,
        "precision": _rate(tp, tp + fp), "recall": _rate(tp, tp + fn), "f1": _rate(2 * tp, 2 * tp + fp + fn),
    })
    for more in (curves(df, by, label, score), confident_accuracy(df, by, label, score, shares, cut)):
        out = out.join(more, list(by), "left")
    return out


def class_report(df: DataFrame, by: Sequence[str], label: str, prediction: str) -> DataFrame:
    """``by, class, support, predicted, hits, precision, recall, f1``, and on each row the group's ``accuracy`` and ``macro_f1``.

    A class is one that is a label or a prediction; precision, recall and F1 are 0 where nothing is there to divide by.
    """
    pairs = df.groupBy(*by, F.col(label).alias("__l"), F.col(prediction).alias("__p")).agg(F.count("*").alias("__n"))  # a row for each cell
    same = F.col("__l") == F.col("__p")
    sides = F.array(F.struct(F.col("__l").alias("class"), F.lit(1).alias("is"), F.lit(0).alias("said")), F.struct(F.col("__p").alias("class"), F.lit(0).alias("is"), F.lit(1).alias("said")))
    per = pairs.select(*by, "__n", same.cast("int").alias("__same"), F.explode(sides).alias("x")).groupBy(*by, F.col("x.class").alias("class"))
    per = per.agg(F.sum(F.col("__n") * F.col("x.is")).alias("support"), F.sum(F.col("__n") * F.col("x.said")).alias("predicted"), F.sum(F.col("__n") * F.col("x.is") * F.col("__same")).alias("hits"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    per = per.withColumns({"precision": zero(_rate(F.col("hits"), F.col("predicted"))), "recall": zero(_rate(F.col("hits"), F.col("support"))), "f1": zero(_rate(2 * F.col("hits"), F.col("support") + F.col("predicted")))})
    whole = per.groupBy(*[F.col(c).alias(f"__b_{c}") for c in by]).agg(_rate(F.sum("hits"), F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"))
    on = [F.col(c).eqNullSafe(F.col(f"__b_{c}")) for c in by] or F.lit(True)
    return per.join(F.broadcast(whole), on).drop(*[f"__b_{c}" for c in by])  # a row for each group of counts
