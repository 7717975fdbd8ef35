"""Fixed effects, the bootstrap and contributions of trees against plain fits with dummies and against all subsets."""

import datetime as dt
import hashlib
import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tarnflow.operators import features, models, trees, windows


def panel(companies, years, n, seed):
    """Unbalanced rows of two groupings with effects of both."""
    r = np.random.default_rng(seed)
    g, t = r.integers(0, companies, n), r.integers(0, years, n)
    t = np.where(r.random(n) < 0.3, g % years, t)
    u, v = r.normal(size=n) + 0.3 * g, r.normal(size=n) - 0.2 * t
    y = 1.5 * u + 0.1 * v + g - 2.0 * t + r.normal(size=n) * (1 + g % 3)
    return pd.DataFrame({"g": g.astype("int64"), "t": t.astype("int64"), "y": y, "u": u, "v": v})


def dummies(p):
    g, t = pd.get_dummies(p.g).to_numpy(float), pd.get_dummies(p.t).to_numpy(float)[:, 1:]
    return np.concatenate([p[["u", "v"]].to_numpy(), g, t], axis=1)


def robust_t(x, y, clusters, j):
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    e, inv = y - x @ beta, np.linalg.pinv(x.T @ x)
    scores = np.array([x[clusters == c].T @ e[clusters == c] for c in np.unique(clusters)])
    n, k, m = len(y), x.shape[1], len(scores)
    se = np.sqrt(np.diag(inv @ scores.T @ scores @ inv) * m / (m - 1) * (n - 1) / (n - k))
    return beta[j], se[j], beta[j] / se[j]


def test_fixed_effects_equal_dummies(spark):
    p = panel(12, 5, 700, 1)
    odd = pd.DataFrame({"g": [1, None, 2], "t": [0, 0, None], "y": [None, 1.0, 1.0], "u": [0.0] * 3, "v": [0.0] * 3})
    df = spark.createDataFrame(pd.concat([p, odd]).astype(object).where(lambda x: x.notna(), None).values.tolist(), "g double, t double, y double, u double, v double")
    got = {r.term: (r.coef, r.se, r.t) for r in models.cluster_ols(df, "g", "y", ["u", "v"], ["g", "t"]).collect()}
    for j, term in enumerate(["u", "v"]):
        assert got[term] == pytest.approx(robust_t(dummies(p), p.y.to_numpy(), p.g.to_numpy(), j), rel=1e-6)


def test_absorbed_rows_and_effects(spark):
    p = panel(30, 4, 400, 2)
    out, n = models.absorb(spark.createDataFrame(p), ["g", "t"], ["y"])
    d = dummies(p)[:, 2:]
    want = p.y - d @ np.linalg.lstsq(d, p.y, rcond=None)[0]
    assert n == d.shape[1] and np.allclose(np.sort([r.y for r in out.collect()]), np.sort(want), atol=1e-8)


def bootstrap(p, signs):
    """t of ``v`` for each row of signs by cluster: every draw is fitted anew with all dummies."""
    x, y, clusters = dummies(p), p.y.to_numpy(), p.g.to_numpy()
    less = np.delete(x, 1, axis=1)
    fitted = less @ np.linalg.lstsq(less, y, rcond=None)[0]
    where = np.searchsorted(np.unique(clusters), clusters)
    return np.array([robust_t(x, fitted + (y - fitted) * s[where], clusters, 1)[2] for s in signs])


def test_bootstrap_takes_all_signs_of_few_clusters(spark):
    p = panel(6, 4, 200, 3)
    got = models.wild_bootstrap(spark.createDataFrame(p), "g", "y", ["u", "v"], "v", level="t").head()
    ts = bootstrap(p, np.array(list(itertools.product([1.0, -1.0], repeat=6))))
    assert got.draws == 64 and got.t == pytest.approx(ts[0], rel=1e-6)
    assert got.p == pytest.approx((abs(ts) >= abs(ts[0]) * (1 - 1e-9)).mean())


def test_bootstrap_by_hash(spark):
    p = panel(12, 4, 300, 4)
    df = spark.createDataFrame(p)
    got = models.wild_bootstrap(df, "g", "y", ["u", "v"], "v", draws=200, level="t").head()
    keys = np.array([r[0] for r in df.select("g", F.xxhash64("g").alias("k")).distinct().orderBy("g").select("k").collect()])
    ts = bootstrap(p, models._signs(keys, np.arange(201), 7).T)
    assert got.draws == 200 and got.t == pytest.approx(ts[0], rel=1e-6)
    assert got.p == pytest.approx((abs(ts[1:]) >= abs(ts[0]) * (1 - 1e-9)).mean())


def test_bootstrap_of_no_rows_and_too_many_levels(spark, monkeypatch):
    df = spark.createDataFrame(panel(6, 4, 50, 5))
    assert models.wild_bootstrap(df.limit(0), "g", "y", ["u"], "u").head().p is None
    monkeypatch.setattr(models, "MAX_LEVELS", 3)
    with pytest.raises(ValueError):
        models.wild_bootstrap(df, "g", "y", ["u"], "u", level="t")


@pytest.fixture(scope="module")
def boosted(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(400, 4))
    y = 2 * x[:, 0] + (x[:, 1] > 0) * x[:, 2] + 0.2 * x[:, 3]
    df = VectorAssembler(inputCols=list("abcd"), outputCol="features").transform(spark.createDataFrame(pd.DataFrame(np.c_[x, y], columns=list("abcdy"))))
    model = models.fit_gbt(df, "y", rounds=6)
    return df, model


def nodes(spark, model, path):
    model.write().overwrite().save(path)
    out = {}
    for r in spark.read.parquet(f"{path}/data").collect():
        out.setdefault(r.treeID, {})[r.nodeData.id] = r.nodeData
    return out


def expected(tree, i, x, known):
    """The mean prediction of a tree when only some columns are known: unknown ones go both ways by training rows."""
    n = tree[i]
    if n.leftChild < 0:
        return n.prediction
    left, right = tree[n.leftChild], tree[n.rightChild]
    if n.split.featureIndex in known:
        return expected(tree, n.leftChild if x[n.split.featureIndex] <= n.split.leftCategoriesOrThreshold[0] else n.rightChild, x, known)
    return (left.rawCount * expected(tree, n.leftChild, x, known) + right.rawCount * expected(tree, n.rightChild, x, known)) / n.rawCount


def test_tree_contributions_equal_all_subsets(spark, boosted, tmp_path):
    df, model = boosted
    rows = trees.tree_contributions(model.transform(df), model).limit(25).collect()
    saved = nodes(spark, model, str(tmp_path / "model"))
    value = lambda x, s: sum(w * expected(saved[t], 0, x, s) for t, w in enumerate(model.treeWeights))
    fact = [1, 1, 2, 6, 24]
    for r in rows:
        x = r.features.toArray()
        for f in range(4):
            others = [j for j in range(4) if j != f]
            want = sum(
                fact[len(s)] * fact[3 - len(s)] / 24 * (value(x, {*s, f}) - value(x, set(s)))
                for k in range(4) for s in itertools.combinations(others, k)
            )
            assert r.parts[f] == pytest.approx(want, abs=1e-9)
        assert r.base + sum(r.parts) == pytest.approx(r.prediction, abs=1e-9) and r.base == pytest.approx(value(x, set()))


def test_top_parts_and_mean_sizes(spark):
    df = spark.createDataFrame([(1, [0.5, -2.0, 0.5]), (2, [0.0, 1.0, -3.0])], "k int, parts array<double>")
    got = [(r.k, r["rank"], r.feature, r.contribution) for r in trees.top_parts(df, ["z", "x", "y"], ["k"], 2).orderBy("k", "rank").collect()]
    assert got == [(1, 1, "x", -2.0), (1, 2, "y", 0.5), (2, 1, "y", -3.0), (2, 2, "x", 1.0)]
    assert {r.feature: r.mean_size for r in trees.mean_sizes(df, ["z", "x", "y"]).collect()} == {"z": 0.25, "x": 1.5, "y": 1.75}


def test_tree_contributions_of_no_rows(boosted):
    df, model = boosted
    assert trees.tree_contributions(model.transform(df.limit(0)), model).collect() == []


def test_registry_fits_again(spark):
    rows = [("train" if i % 4 else "valid", float(i % 7), float((i * 5) % 11), 2.0 * (i % 7) - (i * 5) % 11 + 3.0) for i in range(80)] + [("train", 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "split string, a double, b double, y double").withColumn("y_rank", F.col("y"))
    got = {r.alpha: r for r in models.registry(df, ["a", "b"], "y", "split", [(0.0, 0.0), (1.0, 0.0)], places=9, versions={"job": "3"}).collect()}
    assert set(got) == {0.0, 1.0} and got[0.0].selected and not got[1.0].selected
    r = got[0.0]
    assert r.features == ["a", "b"] and np.allclose([r.intercept, *r.coefficients], [3.0, 2.0, -1.0])
    assert r.target == "y" and r.versions == {"job": "3"} and r.test is None and r.rows["valid"] == 20 and abs(r.valid_ic - 1.0) < 1e-9
    again = df.filter("split = 'train'").select(models.Linear(r.features, r.coefficients, r.intercept).score().alias("p"), "y").filter("abs(p - y) > 1e-6")
    assert again.count() == 0
    assert set(models.registry(df, ["a"], "y", "split", [(0.0, 0.0)]).head().versions) == {"python", "spark", "numpy"}


def shuffled(spark):
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def test_permutation_deals_each_value_once_as_one_after_the_other(spark):
    rng = np.random.default_rng(4)
    n, columns = 20_000, ["u", "v"]
    data = pd.DataFrame({"k": [f"{i}" for i in range(n)], "u": rng.integers(0, 9, n).astype(float), "v": rng.normal(size=n).round(2)})
    data["y"] = (data["u"] * 0.3 + data["v"] + rng.normal(size=n)).round(2)
    model = models.Linear(columns, [0.3, 1.0], 0.5)
    df = spark.createDataFrame([*data.itertuples(index=False, name=None), ("x", None, 1.0, 1.0), ("z", 1.0, 1.0, None)], "k string, u double, v double, y double").repartition(4)
    before = shuffled(spark)
    got = {r["feature"]: r for r in models.permutation_drop(df, model, "y", F.col("k"), shuffles=5, places=9).collect()}
    assert shuffled(spark) - before < 700 * n  # ten deals

    def at(name):  # rows in the order of their hashed keys
        return np.array(sorted(range(n), key=lambda i: (hashlib.md5(f"{name}|{data['k'][i]}".encode()).hexdigest()[:15], data["k"][i])))

    def ic(u, v):
        return data["y"].rank().corr((0.5 + u * 0.3 + v).round(9).rank())

    places = at("7")
    for c in columns:
        drops = []
        for s in range(5):
            mixed = data[columns].copy()
            mixed.loc[places, c] = data[c].to_numpy()[at(f"7|{s}|{c}")]
            drops.append(ic(data["u"], data["v"]) - ic(mixed["u"], mixed["v"]))
        assert abs(got[c]["drop_mean"] - np.mean(drops)) < 1e-9 and abs(got[c]["drop_std"] - np.std(drops)) < 1e-9


@pytest.mark.parametrize("lookup", [0, 30, 1 << 20])
def test_manifest_of_few_and_many_values(spark, lookup, monkeypatch):
    """By broadcast ranks, by ranks of rows, or both: correlations over rows with both values, equal to those of pandas."""
    monkeypatch.setattr(features, "_LOOKUP", lookup)
    rng = np.random.default_rng(5)
    x = pd.DataFrame({"split": rng.choice(["train", "test"], 400), "y": rng.integers(0, 60, 400).astype(float), "a": rng.integers(0, 4, 400).astype(float), "b": rng.normal(size=400), "c": 1.0, "d": np.nan})
    x.loc[rng.random(400) < 0.2, "a"] = np.nan
    x.loc[rng.random(400) < 0.1, "y"] = np.nan
    rows = spark.createDataFrame([tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in x.itertuples(index=False)], "split string, y double, a double, b double, c double, d double")
    got = {r.feature: r for r in features.ic_manifest(rows, ["a", "b", "c", "d"], "split", "y").collect()}
    for f in ("a", "b"):
        for s in ("train", "test"):
            own = x[(x.split == s) & x[f].notna() & x.y.notna()]
            assert got[f][f"ic_{s}"] == pytest.approx(own[f].rank().corr(own.y.rank()))
        assert got[f].n == (x[f].notna() & x.y.notna()).sum() and got[f].missing_rate == pytest.approx(x[f].isna().mean())
    assert (got["c"].ic_train, got["c"].stable, got["d"].ic_train, got["d"].n, got["d"].missing_rate) == (0.0, False, None, None, 1.0)


def test_ranks_by_parts(spark):
    rng = np.random.default_rng(6)
    x = pd.DataFrame({"i": range(600), "g": rng.choice(["p", "q"], 600), "v": np.where(rng.random(600) < 0.5, 7.0, rng.integers(0, 300, 600) / 10)})
    rows = spark.createDataFrame(x).withColumn("v", F.when(F.col("i") % 11 > 0, F.col("v"))).withColumn("g", F.when(F.col("g") == "p", "p"))
    got = {r.i: r.k for r in windows.part_ranks(rows, ["g"], "v", "k", 16).collect()}
    want = x[x.i % 11 > 0].groupby("g").v.rank()
    assert len(got) == 600 and all(got[i] == (want[i] if i in want.index else None) for i in x.i)


def test_prepare_from_counts(spark):
    """Medians, clipping, means and deviations equal those of the rows; a constant is only centred, a feature without values is 0. Nothing is collected by passes over rows."""
    rng = np.random.default_rng(8)
    x = pd.DataFrame({"a": rng.normal(size=300).round(1), "k": 0.1, "t": rng.random(300) < 0.7})
    x.loc[rng.random(300) < 0.3, "a"] = np.nan
    rows = spark.createDataFrame([(None if np.isnan(r.a) else float(r.a), float(r.k), None, bool(r.t)) for r in x.itertuples()], "a double, k double, e double, t boolean")
    out = models.prepare(rows, ["a", "k", "e"], F.col("t")).toPandas()
    a = x.a.fillna(x.a[x.t].median())
    a = a.clip(*a[x.t].quantile([0.01, 0.99]))
    assert out.z_a.to_numpy() == pytest.approx(((a - a[x.t].mean()) / a[x.t].std()).to_numpy())
    assert (out.z_k == 0).all() and (out.z_e == 0).all() and list(out.features[0]) == [out.z_a[0], 0.0, 0.0]


def test_frames_without_ranks_shuffle_no_rows(spark, tmp_path):
    from tarnflow import registry  # noqa: F401  all queries, in their order
    from tarnflow.queries import modelling

    rows = [(i, i % 9, i % 7, i % 5, float(i % 50), 1000.0 + i, 0.1, 0.05, "N", "O", dt.datetime(1996 + i % 4, 1, 1)) for i in range(200)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp").write.parquet(str(tmp_path / "lineitem.parquet"))
    frame, _ = modelling._ridge(spark, str(tmp_path), frame=modelling._plain_frame)
    assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString() and "y_rank" not in frame.columns
    assert modelling._frame(spark, str(tmp_path)).filter("y_rank is not null").count() == 200
