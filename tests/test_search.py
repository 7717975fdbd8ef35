"""Vectors without a model, the index of buckets, and reports on classifiers, against plain computations."""

import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarnflow import registry
from tarnflow.operators import reports, retrieval


def test_index_finds_true_neighbours(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(40, 16))
    x = centres[r.integers(0, 40, 3000)] + 0.5 * r.normal(size=(3000, 16))
    rows = [(i, x[i].tolist(), int(i % 3)) for i in range(3000)]
    rows += [(3000, None, 0), (3001, [0.0] * 16, 0), (3002, [float("nan")] * 16, 0), (3003, x[0].tolist(), None), (3004, x[6].tolist(), 0)]
    e = spark.createDataFrame([(*v, "z") for v in rows], "vec_id long, v array<double>, label int, bucket string")
    index = retrieval.plane_index(e, "vec_id", "v", "label", 16, 6)
    assert index.vectors.count() == 3001
    asked = e.filter("vec_id % 100 = 0")
    got, recall, probes = retrieval.indexed_top_k(asked, index, "vec_id", "v", "label")
    got = {(g.query, g.id): g.score for g in got.collect()}
    exact = {(g.query, g.id): g.score for g in retrieval.vector_top_k(asked, e, "vec_id", "vec_id", "v", "label").collect()}
    assert recall >= 0.95 and probes < 64 and len(exact) == 300
    found = sum(k in got for k in exact)
    assert found >= 0.95 * len(exact) and all(got[k] == exact[k] for k in exact if k in got)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    for q in (0, 600, 1500):
        same = [i for i in range(3000) if i % 3 == q % 3 and i != q] + ([3004] if q % 3 == 0 else [])
        near = sorted(same, key=lambda i: (-round(float(unit[q] @ (unit[6] if i == 3004 else unit[i])), 6), i))[:10]
        assert [i for qq, i in sorted(exact, key=lambda k: (-exact[k], k[1])) if qq == q] == near
    all_, recall, _ = retrieval.indexed_top_k(asked, index, "vec_id", "v", "label", least_recall=1.01)
    assert {(g.query, g.id) for g in all_.collect()} == set(exact)


def test_index_without_rows(spark):
    e = spark.createDataFrame([], "vec_id long, v array<double>, label int")
    got, recall, _ = retrieval.indexed_top_k(e, retrieval.plane_index(e, "vec_id", "v", "label", 4), "vec_id", "v", "label")
    assert got.count() == 0 and recall == 1.0


def plain_vector(text, df, n, query, width):
    words = [w for w in __import__("re").split(r"[^a-z0-9]+", text.lower()) if len(w) >= 2]
    out = np.zeros(width)
    for w in set(words):
        bits = bin(int(hashlib.md5(w.encode()).hexdigest(), 16))[2:].zfill(128)[:width]
        weight = (1 if query else 1 + math.log(words.count(w))) * (math.log((n + 1) / (df.get(w, 0) + 1)) + 1)
        out += weight * np.array([1.0 if b == "1" else -1.0 for b in bits])
    return out / np.linalg.norm(out) if words else None


def test_hashed_vectors(spark):
    texts = {1: "the cat and the cat", 2: "the dog", 3: "", 4: None, 5: "a, b; c"}
    docs = spark.createDataFrame(list(texts.items()), "k int, t string")
    got, df, n = retrieval.hashed_vectors(docs, "k", "t", width=32)
    counts = {r.term: r.df for r in df.collect()}
    assert counts == {"the": 2, "cat": 1, "and": 1, "dog": 1} and n == 5
    for r in got.collect():
        want = plain_vector(texts[r.id] or "", counts, n, False, 32)
        assert (r.vector is None) if want is None else np.allclose(r.vector, want)
    asked, _, _ = retrieval.hashed_vectors(spark.createDataFrame([(1, "cat cat bird")], "k int, t string"), "k", "t", df, n, query=True, width=32)
    assert np.allclose(asked.head().vector, plain_vector("cat cat bird", counts, n, True, 32))


def test_hashed_vectors_of_more_terms_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "MAX_TERMS", 3)
    r = np.random.default_rng(3)
    texts = {i: " ".join(f"w{k}" for k in r.integers(0, 60, 40)) + " the of and" * (i % 3) for i in range(30)} | {30: "", 31: None}
    docs = spark.createDataFrame(list(texts.items()), "k int, t string").repartition(5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got, df, n = retrieval.hashed_vectors(docs, "k", "t", width=40)
        plan = got._jdf.queryExecution().executedPlan().toString()
        # frequent words meet their frequencies where they lie, the others are brought to their text before they are spread to sums
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "REPARTITION_BY_COL" in plan
        counts = {x.term: x.df for x in df.collect()}
        vectors = {x.id: x.vector for x in got.collect()}
        asked, _, _ = retrieval.hashed_vectors(spark.createDataFrame([(1, "the w1 w2 unknown the")], "k int, t string"), "k", "t", df, n, query=True, width=40)
        query = asked.head().vector
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert set(vectors) == set(texts) and vectors[30] is None and vectors[31] is None
    assert all(np.allclose(vectors[i], plain_vector(texts[i], counts, n, False, 40)) for i in range(30))
    assert np.allclose(query, plain_vector("the w1 w2 unknown the", counts, n, True, 40))


def test_frequencies_that_are_broadcast(spark):
    df = spark.createDataFrame([(f"t{i}", f) for i, f in enumerate([1, 1, 1, 2, 3, 4, 7, 8])], "term string, df long")
    assert [retrieval._frequent(df, most) for most in (8, 7, 5, 4, 3, 1, 0)] == [1, 2, 2, 4, 4, 8, 1 << 62]
    assert retrieval._frequent(df.limit(0), 5) == 1


def test_texts_and_vectors_stay_where_they_lie(spark):
    plan = registry.QUERIES["se_semantic"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan  # hits meet texts and queries; vectors were ranked before


def areas(y, s):
    pairs = [(0.5 if a == b else float(a > b)) for a, la in zip(s, y, strict=True) if la for b, lb in zip(s, y, strict=True) if not lb]
    ap = sum(sum(lb for b, lb in zip(s, y, strict=True) if b >= a) / sum(b >= a for b in s) for a, la in zip(s, y, strict=True) if la) / max(sum(y), 1)
    return (sum(pairs) / len(pairs) if pairs else None), (ap if sum(y) else None)


def test_binary_report_with_tied_scores(spark):
    r = np.random.default_rng(1)
    rows = [("a", int(r.random() < 0.4), round(float(r.random()), 1)) for _ in range(200)] + [("b", 1, 0.7), ("b", 1, 0.2), ("c", 0, 0.5), ("a", None, 0.1), ("a", 1, None)]
    got = {x.g: x for x in reports.binary_report(spark.createDataFrame(rows, "g string, y int, p double"), ["g"], "y", "p").collect()}
    for g in "abc":
        y, p = zip(*[(y, p) for k, y, p in rows if k == g and y is not None and p is not None], strict=True)
        auc, ap = areas(y, p)
        assert got[g].n == len(y) and got[g].roc_auc == (auc if auc is None else pytest.approx(auc)) and got[g].pr_auc == (ap if ap is None else pytest.approx(ap))
        assert got[g].accuracy == pytest.approx(np.mean([(b >= 0.5) == bool(a) for a, b in zip(y, p, strict=True)]))
        for share, name in ((0.5, "acc_at_50"), (0.3, "acc_at_30")):
            k, far = int(len(y) * share), [round(abs(b - 0.5), 9) for b in p]
            total, left = 0.0, k
            for f in sorted(set(far), reverse=True):
                right = [(b >= 0.5) == bool(a) for a, b, d in zip(y, p, far, strict=True) if d == f]
                total += np.mean(right) * min(left, len(right))
                left -= min(left, len(right))
            assert got[g][name] == (pytest.approx(total / k) if k else None)


def test_class_report(spark):
    rows = [("x", "a", "a"), ("x", "a", "b"), ("x", "b", "b"), ("x", "c", "b"), ("y", "a", "d")]
    got = {(r.g, r["class"]): r for r in reports.class_report(spark.createDataFrame(rows, "g string, l string, p string"), ["g"], "l", "p").collect()}
    assert (got["x", "b"].support, got["x", "b"].predicted, got["x", "b"].hits) == (1, 3, 1)
    assert got["x", "b"].precision == pytest.approx(1 / 3) and got["x", "b"].f1 == pytest.approx(0.5) and got["x", "c"].precision == 0.0
    assert got["x", "a"].accuracy == 0.5 and got["x", "a"].macro_f1 == pytest.approx((2 / 3 + 0.5) / 3) and got["y", "d"].accuracy == 0.0
    whole = reports.class_report(spark.createDataFrame(pd.DataFrame(rows, columns=["g", "l", "p"])), [], "l", "p")
    assert whole.filter(F.col("class") == "a").head().support == 3
