import math
import time

import numpy as np
import pandas as pd

from tarnflow.llm import embed_dedup as op

SCHEMA = "vec_id long, embedding array<float>, label int, kept string"


def vectors(n=700, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 16))
    x[200:280] = x[200] + rng.normal(size=(80, 16)) * 0.03
    for i in range(0, 150, 3):
        x[i + 1] = x[i] + rng.normal(size=16) * 0.12
    x[600:610] = x[599]
    return x.astype(np.float32), [i % 3 if i < 150 or i > 300 else 0 for i in range(n)]


def brute(x, labels):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    links = (u @ u.T >= op.COSINE) & (np.array(labels)[:, None] == np.array(labels)[None, :])
    np.fill_diagonal(links, False)
    return links


def roots(links):
    out = list(range(len(links)))
    changed = True
    while changed:
        changed = False
        for i in range(len(links)):
            m = min([out[i], *(out[j] for j in np.nonzero(links[i])[0])])
            changed |= m < out[i]
            out[i] = m
    return out


def test_links_and_components_against_brute_force(spark):
    x, labels = vectors()
    links = brute(x, labels)
    want = roots(links)
    rows = [(i, [float(v) for v in x[i]], labels[i], "") for i in range(len(x))]
    nan, inf = math.nan, math.inf
    odd = [(900, None, 1, ""), (901, [], 1, ""), (902, [0.0] * 16, 1, ""), (903, [nan] * 16, 1, ""), (904, [inf] + [1.0] * 15, 1, ""), (905, [None] + [1.0] * 15, 1, ""),
           (906, rows[0][1], None, ""), (907, [1.0, 2.0], 1, ""), (908, [2.0, 4.0], 1, "")]
    df = spark.createDataFrame(rows + odd, SCHEMA)
    for shard in (8192, 64):
        got = {r.vec_id: r for r in op.embedding_near_dups(df, shard=shard).collect()}
        assert len(got) == len(rows) + len(odd)
        found = sum(got[i].n_links for i in range(len(x)))
        assert found >= 0.9 * links.sum() and all(got[i].n_links <= links[i].sum() for i in range(len(x)))
        if found == links.sum():
            assert [got[i].component_id for i in range(len(x))] == want
        for i in range(900, 907):
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
        assert (got[907].n_links, got[908].component_id, got[908].kept) == (1, 907, False)


def test_recall_of_graphs():
    x, labels = vectors()
    u = op._unit(list(x)).astype(np.float32)
    g = op.Graph(u)
    own = np.arange(len(u))
    hits = np.zeros((len(u), len(u)), bool)
    op._found(g, u, op.audited_beam(g, u, op.COSINE, own), op.COSINE, own, hits)
    truth = u @ u.T >= op.COSINE
    assert (hits & truth).sum() >= 0.99 * truth.sum()


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, [1.0, 0.0], 5, ""), (1, [1.0, 0.0], 5, ""), (None, [1.0, 0.0], 5, "")]
    got = op.embedding_near_dups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.n_links, r.component_id) for r in got] == [(2, 1)] * 3
    assert op.embedding_near_dups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_pairs_between_shards_beside_a_large_group():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(1500, 48))
    group = rng.normal(size=48) + rng.normal(size=(1200, 48)) * 0.02
    sides = [np.concatenate([a, group[:600]]), np.concatenate([a + rng.normal(size=a.shape) * 0.08, group[600:]])]
    rows = [pd.DataFrame({"label": 1, "dim": 48, "shard": s, "rep": np.arange(len(x)) + s * 10_000, "n": 1, "embedding": x.tolist()}) for s, x in enumerate(sides)]
    rows = pd.concat(map(op._build, rows))
    truth = op._unit(list(sides[0])) @ op._unit(list(sides[1])).T >= op.COSINE
    assert truth[:1500].any(axis=1).sum() > 1000
    began = time.time()
    got = op._linked(rows, op.COSINE)
    assert time.time() - began < 30
    counts = got[got["u"] == got["v"]].set_index("u")["n"]
    found = np.array([counts.get(i, 0) for i in range(2100)])
    assert (found <= truth.sum(axis=1)).all() and (found[1500:] == truth[1500:].sum(axis=1)).all()
    assert found[:1500].sum() >= 0.99 * truth[:1500].sum()
    other = np.array([counts.get(i + 10_000, 0) for i in range(2100)])
    assert other.sum() == found.sum() and (other <= truth.sum(axis=0)).all()


def test_links_that_the_audit_saw_are_kept(monkeypatch):
    x, labels = vectors()
    u = op._unit(list(x)).astype(np.float32)
    rows = pd.DataFrame({"label": 1, "dim": 16, "shard": 0, "rep": np.arange(len(u)), "n": 1, "embedding": u.tolist()})
    built = op._build(rows)
    truth = op._unit(list(u)) @ op._unit(list(u)).T >= op.COSINE
    np.fill_diagonal(truth, False)
    # a search that finds nothing, and an audit of all queries
    monkeypatch.setattr(op.Graph, "near", lambda self, q, ef, least, own=None: ([np.zeros(0, np.int64)] * len(q), np.zeros(len(q), bool)))
    monkeypatch.setattr(op, "_found", lambda *_: None)
    monkeypatch.setattr(op, "LINKED", len(u) + 1)
    got = op._linked(built, op.COSINE)
    counts = got[got["u"] == got["v"]].set_index("u")["n"]
    assert [counts.get(i, 0) for i in range(len(u))] == truth.sum(axis=1).tolist()


def test_beams_of_queries_with_many_links_are_audited():
    x, _ = vectors()
    u = op._unit(list(x)).astype(np.float32)
    g = op.Graph(u)
    beams = []

    class Blind(op.Graph):
        def near(self, q, ef, least, own=None):
            beams.append(ef)
            sims = q @ self.x.T >= least
            # those with many links find one alone until the beam is wide
            return [np.nonzero(s)[0][: 1 if s.sum() >= op.EF and ef < 128 else None] for s in sims], np.zeros(len(q), bool)

    g.__class__ = Blind
    assert op.audited_beam(g, u, op.COSINE, np.arange(len(u))) == 128 and beams[0] == op.EF
