"""Ranked search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import types as T

from tarnflow.llm import lexical_rank
from tarnflow.llm.lexical_rank import Best, Queries, Shard, ranked_search, search


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(docs, items, k=10):
    held = [(i, Counter(words(t)), len(words(t))) for i, t in docs]
    n, total = sum(x[2] > 0 for x in held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, size in held:
            score = 0
            for t in words(text):
                if c[t]:
                    m = 100 - 75 + (75 * size * n) // total
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k])]
    return out


def table(n, seed, vocabulary=300):
    rng = random.Random(seed)
    names = [f"w{k}" for k in range(vocabulary)]
    zipf = [1 / (k + 1) for k in range(vocabulary)]
    return [(k * 7 % n, " ".join(rng.choices(names, zipf, k=rng.randint(0, 80)))) for k in range(n)]


SCHEMA = "doc_id long, text string, score string, query string, n string"
ITEMS = "item_id long, text string"


def check(spark, docs, items, k=10):
    got = ranked_search(spark.createDataFrame([(*d, "z", "z", "z") for d in docs], SCHEMA).repartition(3), spark.createDataFrame(items, ITEMS), k)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, brute(docs, items, k)))


def test_all_scores(spark, monkeypatch):
    rng = random.Random(2)
    docs = table(900, 1)
    items = [(k, " ".join(docs[rng.randrange(900)][1].split()[:30])) for k in range(25)] + [(100, "W1 w1 W2, w2-w1"), (101, "nowhere"), (102, ""), (103, None)]
    check(spark, docs, items)
    check(spark, docs, items, k=3)


def test_ties_copies_and_odd_rows(spark):
    docs = [(k, "same words here") for k in range(200, 0, -1)] + [(None, "same words here"), (7, "same words here"), (500, None), (501, ""), (502, "Ünï ünï É中文 x_y"), (503, "a " * 30_000)]
    check(spark, docs, [(1, "same"), (2, "words HERE"), (3, "ünï x y 中文"), (4, "a"), (None, "same"), (1, "here here")])


def test_few_documents(spark):
    check(spark, [(1, "one"), (2, "two one")], [(1, "one two three")])
    check(spark, [(1, "one")], [(1, "one")])
    check(spark, [(1, None)], [(1, "one")])
    for docs, items in ([], [(1, "x")]), ([(1, "x")], []):
        left, right = spark.createDataFrame([(*d, "", "", "") for d in docs], SCHEMA), spark.createDataFrame(items, ITEMS)
        assert ranked_search(left, right).collect() == []


def test_blocks_and_shards_change_nothing(spark, monkeypatch):
    docs, items = table(400, 5), [(k, f"w{k} w{2 * k} w{3 * k} w1") for k in range(40)]
    monkeypatch.setattr(lexical_rank, "BLOCK_TERMS", 60)
    check(spark, docs, items)


def test_search_of_shards_against_sums():
    rng = np.random.default_rng(4)
    queries = Queries([[b"%d" % t for t in rng.integers(0, 40, 12)] for _ in range(30)])
    best, plain = Best(30, 10), [[] for _ in range(30)]
    seen = 0
    for s in range(4):
        n = 3000
        hit = rng.random((40, n)) < (1 / (1 + np.arange(40)))[:, None]
        term, doc = np.nonzero(hit)
        value = (rng.integers(1, 60, len(term)) ** 3 * 1000 // (1 + term)).astype(np.int64) + 1
        shard = Shard(np.arange(n) * 4 + s, doc, term, value, 40)
        seen += search(shard, queries, best, np.zeros(n, bool), np.arange(30))
        dense = np.zeros((40, n), np.int64)
        dense[term, doc] = value
        for q in range(30):
            at = slice(queries.begins[q], queries.begins[q + 1])
            score = sum(dense[t] * c for t, c in zip(queries.terms[at], queries.times[at], strict=True))
            plain[q] += [(-int(x), d * 4 + s) for d, x in enumerate(score) if x > 0]
    for q in range(30):
        assert list(zip((-best.score[q]).tolist(), best.id[q].tolist(), strict=True)) == sorted(plain[q])[:10]
    assert seen < 0.8 * 30 * 4 * 3000  # bounds leave documents out


def test_small_shards(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(lexical_rank, "SHARD_POSTINGS", 7)
    monkeypatch.setattr(lexical_rank, "SHARD_DOCS", 4)
    rng = random.Random(1)
    lists = [[k for k in range(20) if rng.random() < 0.2] for _ in range(60)] + [list(range(20))]
    batch = pa.RecordBatch.from_arrays([pa.array([None, *range(60)], pa.int64()), pa.array([9] * 61, pa.int64()), pa.array(lists, pa.list_(pa.int32())), pa.array([[1] * len(x) for x in lists], pa.list_(pa.int32()))], ["doc_id", "n", "terms", "times"])
    found = []
    for shard, none in lexical_rank._shards(iter([batch, batch.slice(10, 20)]), np.ones(20, np.int64), 61, 500):
        assert shard.n <= 4 and none.sum() <= 1
        found += [(None if none[k % shard.n] else int(shard.ids[k % shard.n]), int(k // shard.n)) for k in shard.key]
    want = [(i, t) for ids in ([None, *range(60)], range(9, 29)) for i in ids for t in lists[0 if i is None else i + 1]]
    assert sorted(found, key=str) == sorted(want, key=str)
