import random
import zlib

import numpy as np

from tarnflow.llm import quality as op

GOOD = "clear sentences about rivers and mountains that children read in school every morning".split()


def rows(n=500):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        words = [rng.choice(GOOD) for _ in range(40)]
        docs.append((i, " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words), "src"))
        labels.append((i, 0 if bad else 1, "t"))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = rows()
    extra = [(9000, None, None), (9001, "", None), (None, "text", None), (3, docs[3][1], None), (9002, "word " * 50000, None)]
    d = spark.createDataFrame(docs + extra, "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels + [(1, None, "t"), (None, 1, "t"), (2, 7, "t")], "doc_id long, quality int, text string")
    got = op.classify_quality(d, lab).collect()
    assert len(got) == len(docs) + len(extra)
    want = {i: q for i, q, _ in labels}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in got if r.held_out and r.doc_id in want]
    assert len(held) > 60 and sum(r.predicted == want[r.doc_id] for r in held) == len(held)
    kept = op.keep_good(d, lab)
    assert kept.columns == d.columns
    assert {r.doc_id for r in kept.filter("doc_id < 500").collect()} >= {i for i, q in want.items() if q}


def test_held_out_labels_are_not_learnt(spark):
    docs, labels = rows(120)
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    a, b = (op.classify_quality(d, spark.createDataFrame(x, "doc_id long, quality int, t string")).collect() for x in (labels, flipped))
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_no_labels_and_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [r.score for r in op.classify_quality(d, none).collect()] == [0.5]
    assert op.classify_quality(d.limit(0), none).count() == 0


def test_features_of_rows_do_not_depend_on_their_neighbours():
    texts = ["a b a b", "", "x", "Über ÜBER uber !!! 12", "a b a b"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    row, index, value = op.features(data, offsets)
    for i, t in enumerate(texts):
        b = np.frombuffer(t.encode(), np.uint8)
        _, alone, v = op.features(b, np.array([0, len(b)]))
        assert sorted(zip(index[row == i], value[row == i].round(9))) == sorted(zip(alone, v.round(9)))


def test_one_update_is_the_published_one():
    z, n = np.zeros(op.DIM + 1), np.zeros(op.DIM + 1)
    op.learn(z, n, np.array([3]), np.array([2.0]), 1)
    assert z[3] == -1.0 and n[3] == 1.0 and z[op.DIM] == -0.5
    w = op.weights(z, n)
    assert np.isclose(w[3], (1.0 - op.L1) / ((op.BETA + 1.0) / op.ALPHA + op.L2)) and w[5] == 0
