"""Periodic runs against comparing every word with every later one."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import types as T

from tarnflow.llm.periodic_runs import collapsed, periodic_runs, planted, run_digests, runs_of


def smallest_period(w):
    return next(q for q in range(1, len(w) + 1) if all(w[i] == w[i + q] for i in range(len(w) - q)))


def brute(w):
    """All maximal stretches of period q, for every q, whose smallest period is q."""
    found = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            e = i
            while e + q < len(w) and w[e] == w[e + q]:
                e += 1
            length = e - i + q
            if e > i and length >= max(6, 4 * q) and smallest_period(w[i : i + length]) == q:
                found.append((i, length, q))
            i = e + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def dropped(w, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return [x for k, x in enumerate(w) if k not in gone]


def texts():
    rng = random.Random(11)
    out = [[], [b"a"], [b"a"] * 5, [b"a"] * 6, [b"a", b"b"] * 4, [b"a", b"b"] * 3 + [b"a"]]
    for _ in range(150):
        w = [b"%d" % rng.randint(0, 1) for _ in range(rng.randint(0, 60))]  # many small runs
        out.append(w)
    for _ in range(120):
        w = []
        for _ in range(rng.randint(1, 4)):
            w += [b"%d" % rng.randint(0, rng.choice([1, 3, 1000])) for _ in range(rng.randint(0, 30))]
            period = [b"%d" % rng.randint(0, rng.choice([1, 2, 50])) for _ in range(rng.choice([1, 2, 5, 15, 16, 17, 18, 31, 32, 33, 40, 64, 65, 70]))]
            w += (period * 6)[: int(len(period) * rng.uniform(3.5, 5.5))]
        out.append(w)
    inner = [b"x", b"y"] * 10 + [b"%d" % k for k in range(30)]  # runs within the period of a run
    out.append(inner * 5)
    fib = [b"a"], [b"a", b"b"]
    for _ in range(11):
        fib = fib[1], fib[1] + fib[0]
    return [*out, fib[1], [b"t" if bin(k).count("1") % 2 else b"u" for k in range(512)]]


def test_runs_are_all_runs():
    some = texts()
    for w, runs in zip(some, runs_of(some), strict=True):
        want = brute(w)
        assert [tuple(r) for r in runs.tolist()] == want
        assert collapsed(w, runs) == dropped(w, want)


def test_equal_documents_stay_apart():
    w = [b"%d" % k for k in range(40)]
    assert all(not len(r) for r in runs_of([w] * 8))


@pytest.mark.parametrize("q", [3, 16, 17, 100, 1000, 4096, 5000])
def test_long_periods(q):
    head, tail = [b"h%d" % k for k in range(17)], [b"t%d" % k for k in range(23)]
    period = [b"%d" % (k * k % 7919) for k in range(q)]
    w = head + (period * 5)[: 4 * q + q // 2] + tail
    assert [tuple(r) for r in runs_of([w])[0].tolist()] == ([(17, 4 * q + q // 2, q)] if 4 * q + q // 2 >= 6 else [])
    assert not len(runs_of([head + (period * 4)[: 4 * q - 1] + tail])[0])


def plain_query(doc_id, text):
    w = (text or "").encode().split()
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = b" ".join(dropped(w, runs))
    longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *longest, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(["a", "b", "é", "c d", "x\x1cy"]) for _ in range(rng.randint(0, 90)))) for k in range(300)]
    rows += [(300, None), (300, None), (301, ""), (None, "a b " * 9), (302, "\x0b\x0c\r a\ta \n" * 5), (303, "w " * 50_000)]
    schema = T.StructType([T.StructField(n, t) for n, t in [("doc_id", T.LongType()), ("text", T.StringType()), ("runs", T.StringType()), ("start", T.StringType())]])
    got = run_digests(periodic_runs(spark.createDataFrame([(*r, "z", "z") for r in rows], schema), plant=True)).collect()
    small = [r for r in rows if r[0] != 303]
    assert sorted(map(str, (tuple(r) for r in got if r.doc_id != 303))) == sorted(str(plain_query(*r)) for r in small)
    assert sum(planted(5, r[0]) is not None for r in rows) > 10
    assert [(r.start, r.length, r.period) for r in got if r.doc_id == 303] == [(0, 50_000, 1)]
    assert periodic_runs(spark.createDataFrame([], schema)).collect() == []


def test_operator_gives_runs_and_text(spark):
    row = periodic_runs(spark.createDataFrame([(1, "start go go go go go go end")], "doc_id long, text string")).head()
    assert [tuple(r) for r in row.runs] == [(1, 6, 1)] and row.collapsed == "start go end" and row.exponent_milli == 6000
