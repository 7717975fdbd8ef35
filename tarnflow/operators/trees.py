"""Contributions of columns to the predictions of boosted trees, as Shapley values that follow the trees' paths."""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.session import scratch_dir


@dataclass
class Leaf:
    """What a leaf adds, and for each column on its path the values that lead there and the share of training rows that do."""

    value: float
    columns: list[int]
    above: list[float]
    upto: list[float]
    share: list[float]


def _rules(nodes: dict[int, dict], weight: float) -> list[Leaf]:
    out = []

    def walk(i: int, path: dict[int, tuple[float, float, float]]) -> None:
        node = nodes[i]
        if node["leftChild"] < 0:
            c = sorted(path)
            out.append(Leaf(weight * node["prediction"], c, [path[j][0] for j in c], [path[j][1] for j in c], [path[j][2] for j in c]))
            return
        split = node["split"]
        if split["numCategories"] != -1:
            raise ValueError("splits on categories are not supported")
        j, at = split["featureIndex"], split["leftCategoriesOrThreshold"][0]
        above, upto, share = path.get(j, (-math.inf, math.inf, 1.0))
        for child, bounds in ((node["leftChild"], (above, min(upto, at))), (node["rightChild"], (max(above, at), upto))):
            walk(child, {**path, j: (*bounds, share * nodes[child]["rawCount"] / node["rawCount"])})

    walk(0, {})
    return out


def read_leaves(df: DataFrame, model) -> tuple[list[Leaf], float]:
    """The leaves of all trees of a fitted ensemble of regression trees over numbers, and its mean over the training rows.

    The nodes come from the saved model (under the shared folder); they grow with trees and depth, not with rows.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tarnflow/{uuid.uuid4().hex}/model"
    model.write().save(path)
    trees: dict[int, dict[int, dict]] = {}
    for r in spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect():
        trees.setdefault(r["treeID"], {})[r["id"]] = r.asDict(recursive=True)
    found, mean = [], 0.0
    for tree, weight in enumerate(model.treeWeights):
        nodes = trees[tree]
        found += _rules(nodes, weight)
        mean += weight * sum(n["prediction"] * n["rawCount"] for n in nodes.values() if n["leftChild"] < 0) / nodes[0]["rawCount"]
    return found, mean


def shapley(x: np.ndarray, rules: Sequence[Leaf]) -> np.ndarray:
    """For each row (columns as in ``x``) what each column adds to the prediction over the mean.

    For a leaf with columns U, a column's value adds over all S of the others |S|! (|U| - |S| - 1)! / |U|! times the product
    of "the row goes there" over S and of the training shares over the rest; these sums are the coefficients of a product.
    """
    out = np.zeros(x.shape)
    for leaf in rules:
        d = len(leaf.columns)
        goes = [(~(x[:, j] <= a) & ((x[:, j] <= b) | (b == math.inf))).astype(float) for j, a, b in zip(leaf.columns, leaf.above, leaf.upto, strict=True)]
        weights = [math.factorial(s) * math.factorial(d - 1 - s) / math.factorial(d) for s in range(d)]
        for f, column in enumerate(leaf.columns):
            c = [np.ones(len(x))]
            for k in range(d):
                if k != f:
                    c = [(c[s] * leaf.share[k] if s < len(c) else 0.0) + (c[s - 1] * goes[k] if s else 0.0) for s in range(len(c) + 1)]
            out[:, column] += leaf.value * (goes[f] - leaf.share[f]) * sum(w * v for w, v in zip(weights, c, strict=True))
    return out


def tree_contributions(df: DataFrame, model, vector: str = "features") -> DataFrame:
    """``df`` with ``base`` (the mean prediction of the training rows) and ``parts``, an array of what each column adds.

    ``base`` and the parts add up to the prediction. Rows stay where they are; an empty table gives none. A missing value
    goes right at every split, as in the prediction.
    """
    rules, mean = read_leaves(df, model)

    @F.pandas_udf("array<double>")
    def parts(values: pd.Series) -> pd.Series:
        x = np.array(values.tolist(), float).reshape(len(values), -1)
        return pd.Series(list(shapley(x, rules)), index=values.index)

    return df.withColumns({"base": F.lit(mean), "parts": parts(vector_to_array(vector))})


def top_parts(df: DataFrame, names: Sequence[str], keys: Sequence[str], top: int = 5) -> DataFrame:
    """``keys, rank, feature, contribution``: the largest of ``parts`` by size (ties: by name)."""
    named = F.transform(F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("feature"), F.col("parts").alias("part")), lambda p: F.struct((-F.abs(p["part"])).alias("size"), p["feature"].alias("feature"), p["part"].alias("contribution")))
    return df.select(*keys, F.posexplode(F.slice(F.sort_array(named), 1, top)).alias("pos", "x")).select(*keys, (F.col("pos") + 1).alias("rank"), "x.feature", "x.contribution")


def mean_sizes(df: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``by, feature, mean_size``: how much each column moves predictions on average."""
    each = df.select(*by, F.explode(F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("feature"), F.col("parts").alias("part"))).alias("x"))
    return each.groupBy(*by, F.col("x.feature").alias("feature")).agg(F.avg(F.abs("x.part")).alias("mean_size"))
