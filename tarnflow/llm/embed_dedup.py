"""Embedding near-duplicates by hierarchical navigable small-world graphs, one per shard.

Vectors of one label are dealt over shards of bounded size, each with a graph of its own. Every vector
queries every shard of its label. Beams widen until an audit against brute force on part of the queries finds
nearly all links of each, not only of all together, so that a large group hides no small one. A query whose
beam is full of links has more than a beam shows: it is compared with the whole shard. Cosines are verified
in double precision; components are unions of the verified links.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnflow.llm.common import connected, materialize

COSINE = 0.98
#: Vectors of a shard on average; a shard is one task's work.
SHARD = 8192
M = 12
EF_BUILD = 48
EF = 32
#: Queries of a shard that an audit draws, and those among them with a link that it needs; it draws more until it has them.
AUDIT = 512
LINKED = 64
#: Share of its links that an audited query finds on average, of the queries that have any.
RECALL = 0.995
_BATCH = 256
#: Single precision finds candidates; a little below the limit is verified too.
_SLACK = 1e-4


def _diverse(x: np.ndarray, sims: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (best first, -1: none) those that are nearer to the node than to any chosen one, then the next best; padded with -1."""
    rows, width = ids.shape
    v = x[np.maximum(ids, 0)]
    among = np.matmul(v, v.transpose(0, 2, 1))
    chosen = np.zeros((rows, width), bool)
    nearest = np.full((rows, width), -np.inf, np.float32)
    for k in range(width):
        take = (ids[:, k] >= 0) & (sims[:, k] > nearest[:, k]) & (chosen.sum(axis=1) < most)
        chosen[:, k] = take
        nearest[take] = np.maximum(nearest[take], among[take, k])
    order = np.argsort(~chosen + 2 * (ids < 0), axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(ids, order, axis=1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)


class Graph:
    """Layers of neighbour lists over the rows of ``x`` (unit vectors, single precision)."""

    def __init__(self, x: np.ndarray, m: int = M):
        self.x, self.m = x, m
        draw = np.random.default_rng(len(x)).random(len(x))
        self.level = np.minimum((-np.log(np.maximum(draw, 1e-12)) / np.log(m)).astype(np.int64), 5)
        top = int(self.level.max(initial=0))
        self.layers = [np.full((len(x), 2 * m if i == 0 else m), -1, np.int32) for i in range(top + 1)]
        self.entry = np.zeros(0, np.int64)
        for start in range(0, len(x), _BATCH):
            self._insert(np.arange(start, min(start + _BATCH, len(x))))

    def _insert(self, new: np.ndarray) -> None:
        near = np.repeat(self.entry[None, :], len(new), axis=0)
        for layer in range(len(self.layers) - 1, -1, -1):
            mine = self.level[new] >= layer
            if near.shape[1]:
                sims, ids = self.search(self.x[new], near, EF_BUILD if mine.any() else 1, layer)
                near = ids[:, :4]
            else:
                sims, ids = np.zeros((len(new), 0), np.float32), np.zeros((len(new), 0), np.int64)
            if not mine.any():
                continue
            own = new[mine]
            among = self.x[own] @ self.x[own].T
            np.fill_diagonal(among, -np.inf)
            sims, ids = np.concatenate([sims[mine], among], axis=1), np.concatenate([ids[mine], np.repeat(own[None, :], len(own), axis=0)], axis=1)
            ids = np.where(np.isfinite(sims), ids, -1)
            order = np.argsort(-sims, axis=1, kind="stable")[:, :EF_BUILD]
            sims, ids = np.take_along_axis(sims, order, axis=1), np.take_along_axis(ids, order, axis=1)
            links = _diverse(self.x, sims, ids, self.m)
            width = self.layers[layer].shape[1]
            self.layers[layer][own, : self.m] = links[:, :width]
            self._link_back(layer, np.repeat(own, links.shape[1]), links.ravel())
        highest = np.nonzero(self.level == len(self.layers) - 1)[0]
        known = highest[highest <= new[-1]][:4]
        self.entry = known if len(known) else np.array([0])

    def _link_back(self, layer: int, source: np.ndarray, target: np.ndarray) -> None:
        """Add ``source`` to the lists of ``target``; full lists keep their diverse best."""
        adj = self.layers[layer]
        width = adj.shape[1]
        ok = target >= 0
        source, target = source[ok], target[ok]
        sims = np.einsum("nd,nd->n", self.x[source], self.x[target])
        order = np.lexsort((-sims, target))
        source, target = source[order], target[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(first, count)
        extra = np.full((len(nodes), width), -1, np.int64)
        at = np.repeat(np.arange(len(nodes)), count)
        extra[at[place < width], place[place < width]] = source[place < width]
        every = np.concatenate([adj[nodes].astype(np.int64), extra], axis=1)
        every.sort(axis=1)
        every[:, 1:][every[:, 1:] == every[:, :-1]] = -1
        sims = np.where(every >= 0, np.einsum("nd,nkd->nk", self.x[nodes], self.x[np.maximum(every, 0)]), -np.inf)
        order = np.argsort(-sims, axis=1, kind="stable")
        sims, every = np.take_along_axis(sims, order, axis=1), np.take_along_axis(every, order, axis=1)
        few = (every >= 0).sum(axis=1) <= width
        out = every[:, :width].copy()
        if (~few).any():
            out[~few] = _diverse(self.x, sims[~few], every[~few], width)
        adj[nodes] = out

    def search(self, q: np.ndarray, entry: np.ndarray, ef: int, layer: int = 0, at_once: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of all queries side by side: similarities and rows, best first (-inf and -1: none)."""
        n, adj = len(q), self.layers[layer]
        seen = np.zeros((n, len(self.x)), bool)
        ids = np.full((n, ef), -1, np.int64)
        sims = np.full((n, ef), -np.inf, np.float32)
        done = np.ones((n, ef), bool)
        rows, fresh = np.arange(n), entry
        while True:
            fresh = np.sort(fresh, axis=1)
            fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = -1
            known = seen[rows[:, None], np.maximum(fresh, 0)]
            ok = (fresh >= 0) & ~known
            seen[np.repeat(rows, fresh.shape[1]).reshape(fresh.shape)[ok], fresh[ok]] = True
            s = np.where(ok, np.einsum("nd,nkd->nk", q[rows], self.x[np.maximum(fresh, 0)]), -np.inf).astype(np.float32)
            s, f, d = np.concatenate([sims[rows], s], axis=1), np.concatenate([ids[rows], fresh], axis=1), np.concatenate([done[rows], ~ok], axis=1)
            best = np.argpartition(-s, ef - 1, axis=1)[:, :ef] if s.shape[1] > ef else np.arange(s.shape[1])[None, :].repeat(len(s), 0)
            sims[rows], ids[rows], done[rows] = (np.take_along_axis(z, best, axis=1) for z in (s, f, d))
            open_sims = np.where(done, -np.inf, sims)
            rows = np.nonzero(np.isfinite(open_sims).any(axis=1))[0]
            if not len(rows):
                break
            k = min(at_once, ef)
            pick = np.argpartition(-open_sims[rows], k - 1, axis=1)[:, :k]
            live = np.isfinite(np.take_along_axis(open_sims[rows], pick, axis=1))
            nodes = np.where(live, np.take_along_axis(ids[rows], pick, axis=1), -1)
            mark = done[rows]
            np.put_along_axis(mark, pick, True, axis=1)
            done[rows] = mark
            fresh = np.where((nodes >= 0)[:, :, None], adj[np.maximum(nodes, 0)], -1).reshape(len(rows), -1).astype(np.int64)
        order = np.argsort(-sims, axis=1, kind="stable")
        ids = np.where(np.isfinite(sims), ids, -1)
        return np.take_along_axis(sims, order, axis=1), np.take_along_axis(ids, order, axis=1)

    def near(self, q: np.ndarray, ef: int, least: float, own: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
        """For each query the rows found with a similarity of ``least`` or more, and which queries' beams are full of them."""
        entry = np.repeat(self.entry[None, :], len(q), axis=0)
        for layer in range(len(self.layers) - 1, 0, -1):
            entry = self.search(q, entry, 4, layer)[1]
        if own is not None:
            entry = np.concatenate([entry, own[:, None]], axis=1)
        sims, ids = self.search(q, entry, min(ef, len(self.x)))
        return [r[x >= least] for r, x in zip(ids, sims, strict=True)], sims[:, -1] >= least


def _layers_out(g: Graph) -> list[bytes]:
    return [b"".join(layer[i].tobytes() for layer in g.layers[: int(g.level[i]) + 1]) for i in range(len(g.x))]


def _layers_in(x: np.ndarray, level: np.ndarray, links: list[bytes], m: int = M) -> Graph:
    g = Graph.__new__(Graph)
    g.x, g.m, g.level = x, m, level
    g.layers = [np.full((len(x), 2 * m if i == 0 else m), -1, np.int32) for i in range(int(level.max(initial=0)) + 1)]
    for i, raw in enumerate(links):
        flat = np.frombuffer(raw, np.int32)
        g.layers[0][i] = flat[: 2 * m]
        for k in range(1, int(level[i]) + 1):
            g.layers[k][i] = flat[2 * m + (k - 1) * m : 2 * m + k * m]
    g.entry = np.nonzero(level == len(g.layers) - 1)[0][:4]
    return g


def _unit(raw: list) -> np.ndarray:
    v = np.stack([np.asarray(r, np.float64) for r in raw])
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("rep").reset_index(drop=True)
    g = Graph(_unit(rows["embedding"]).astype(np.float32))
    return rows.assign(level=g.level.astype(np.int32), links=_layers_out(g))


def _found(g: Graph, q: np.ndarray, ef: int, least: float, own: np.ndarray | None, hits: np.ndarray) -> None:
    """Mark the links of each query; the whole shard's for a query whose beam is full."""
    for i in range(0, len(q), 512):
        some = q[i : i + 512]
        if ef < len(g.x):
            got, full = g.near(some, ef, least - _SLACK, None if own is None else own[i : i + 512])
            for k, ids in enumerate(got):
                hits[i + k, ids] = True
        else:
            full = np.ones(len(some), bool)
        if full.any():
            hits[i + np.nonzero(full)[0]] = some[full] @ g.x.T >= least - _SLACK


def audited_beam(
    g: Graph, q: np.ndarray, least: float, own: np.ndarray | None, ef: int = EF, audit: int = AUDIT, recall: float = RECALL, hits: np.ndarray | None = None
) -> int:
    """The beam at which audited queries that have links in ``g`` find ``recall`` of theirs on average; as wide as the shard if none less does.

    Queries are drawn from all of ``q`` at even steps, and others beside them until LINKED have links or there are no more. Those with EF
    links or more, whose beams should be full so that they find all, have a mean of their own: they would hide what the others miss.
    All links of audited queries are marked in ``hits``, so what their search misses is not lost.
    """
    order = np.argsort((np.arange(len(q), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11), kind="stable")
    few, many = [], []
    truth: dict[int, np.ndarray] = {}
    for i in range(0, len(order), audit):
        new = order[i : i + audit]
        links = q[new] @ g.x.T >= least - _SLACK
        if own is not None:
            links[np.arange(len(new)), own[new]] = False
        if hits is not None:
            hits[new] |= links
        for k, n in enumerate(links.sum(axis=1)):
            kind = few if n < EF else many
            if n and len(kind) < LINKED + audit:
                kind.append(int(new[k]))
                truth[int(new[k])] = links[k]
        if len(few) >= LINKED:
            break
    some = np.array(few + many, np.int64)
    while ef < len(g.x) and len(some):
        got, full = g.near(q[some], ef, least - _SLACK, None if own is None else own[some])
        shares = [1.0 if f else truth[i][ids].sum() / truth[i].sum() for i, ids, f in zip(some.tolist(), got, full, strict=True)]
        if all(np.mean(part) >= recall for part in (shares[: len(few)], shares[len(few) :]) if part):
            break
        ef *= 2
    return ef


def _linked(rows: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links between two shards (or within one): for each vector how many others it links, and a forest of the links."""
    sides = [part.sort_values("rep").reset_index(drop=True) for _, part in rows.groupby("shard")]
    exact = [_unit(s["embedding"]) for s in sides]
    # the last side has the graph, the first one queries it
    graphs = [_layers_in(exact[-1].astype(np.float32), sides[-1]["level"].to_numpy(np.int64), list(sides[-1]["links"]))]
    if len(sides) == 1:
        own = np.arange(len(exact[0]))
        hits = np.zeros((len(own), len(own)), bool)
        _found(graphs[0], graphs[0].x, audited_beam(graphs[0], graphs[0].x, least, own, hits=hits), least, own, hits)
        hits |= hits.T
        np.fill_diagonal(hits, False)
    else:
        q, g = exact[0].astype(np.float32), graphs[-1]
        hits = np.zeros((len(q), len(g.x)), bool)
        _found(g, q, audited_beam(g, q, least, None, hits=hits), least, None, hits)
    left, right = exact[0], exact[-1]
    for i in range(0, len(left), 256):
        r, c = np.nonzero(hits[i : i + 256])
        for s in range(0, len(r), 100_000):
            rr, cc = r[s : s + 100_000] + i, c[s : s + 100_000]
            bad = np.einsum("nd,nd->n", left[rr], right[cc]) < least
            hits[rr[bad], cc[bad]] = False
    names, sizes = [s["rep"].to_numpy() for s in sides], [s["n"].to_numpy() for s in sides]
    found = [(names[0], hits @ sizes[-1])] + ([(names[1], hits.T @ sizes[0])] if len(sides) == 2 else [])
    counts = pd.concat([pd.DataFrame({"u": u, "v": u, "n": n})[n > 0] for u, n in found])
    # a forest: breadth-first from each vector that is not reached yet, from side to side
    parts, todo = [], set(np.nonzero(hits.any(axis=1))[0].tolist())
    cols_left = np.ones(hits.shape[1], bool)
    while todo:
        root = min(todo)
        rows_at, reached, across = np.array([root]), {root}, []
        while len(rows_at):
            cols = np.nonzero(hits[rows_at].any(axis=0) & cols_left)[0]
            cols_left[cols] = False
            across += cols.tolist()
            rows_at = np.array([i for i in np.nonzero(hits[:, cols].any(axis=1))[0] if i not in reached], np.int64) if len(cols) else np.zeros(0, np.int64)
            reached.update(rows_at.tolist())
        todo -= reached
        v = np.concatenate([names[0][sorted(reached)], names[-1][across]]) if across else names[0][sorted(reached)]
        parts.append(pd.DataFrame({"u": names[0][root], "v": np.unique(v), "n": 0}))
    edges = pd.concat(parts) if parts else counts.iloc[:0]
    return pd.concat([counts, edges[edges["u"] != edges["v"]]])[["u", "v", "n"]].astype("int64")


def embedding_near_dups(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = COSINE, shard: int = SHARD
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row: links of a cosine of ``least`` or more to vectors of its label and length.

    Null, empty or zero vectors, those with null or non-finite components, and those without a label link
    with nothing. Equal vectors of a label are searched for once and count as links of each other, so
    repeated rows do too. A null id names no component (its row has a null one if it stands alone). An
    empty table gives no rows; other columns are not read. All found links are real; the share found is
    audited for each pair of shards.
    """
    e = F.col(vector_col).cast("array<double>")
    valid = F.col(label_col).isNotNull() & F.coalesce(F.size(e) > 0, F.lit(False))
    valid &= F.coalesce(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), e.alias("embedding"), F.coalesce(valid, F.lit(False)).alias("valid"))
    # a class is a label and a vector, named by two hashes of 64 bits
    rows = materialize(rows.withColumn("k1", F.xxhash64(F.lit(1), "label", "embedding")).withColumn("k2", F.xxhash64(F.lit(2), "label", "embedding")), "vectors")
    classes = rows.filter("valid").groupBy("k1", "k2").agg(
        F.min("vec_id").alias("least_id"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("embedding").alias("embedding")
    )
    classes = materialize(classes.withColumn("dim", F.size("embedding")).withColumnRenamed("k1", "rep"), "classes")
    shards = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards"))
    dealt = classes.join(shards, ["label", "dim"]).withColumn("shard", F.pmod(F.col("k2"), F.col("shards")).cast("int"))
    dealt = dealt.select("label", "dim", "shards", "shard", "rep", "n", "embedding")
    built = materialize(dealt.groupBy("label", "dim", "shard").applyInPandas(_build, T.StructType([*dealt.schema.fields, T.StructField("level", T.IntegerType()), T.StructField("links", T.BinaryType())])), "graphs")
    to = built.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    to = to.withColumn("a", F.least("shard", "other")).withColumn("b", F.greatest("shard", "other"))
    to = to.withColumn("links", F.when(F.col("shard") == F.col("b"), F.col("links")))  # the lower shard of a pair only queries
    links = materialize(to.groupBy("label", "dim", "a", "b").applyInPandas(lambda pdf: _linked(pdf, least), "u long, v long, n long"), "links")
    counts = links.filter("u = v").groupBy("u").agg(F.sum("n").alias("links"))
    roots = connected(links.filter("u <> v"), "u", "v")
    ids = classes.select("rep", "k2", "least_id", "n")
    named = roots.join(ids, F.col("node") == F.col("rep")).groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = roots.join(named, "root").select("node", "component_id")
    ids = ids.join(counts, F.col("rep") == F.col("u"), "left").join(named, F.col("rep") == F.col("node"), "left")
    ids = ids.select(F.col("rep").alias("k1"), "k2", F.lit(True).alias("valid"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least_id").alias("component_id"))
    out = rows.select("vec_id", "valid", "k1", "k2").join(ids, ["k1", "k2", "valid"], "left")
    component = F.when(F.col("valid"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
