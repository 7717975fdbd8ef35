"""Ranked lexical search: the best documents of each query by bounds on intervals of documents.

Every task indexes the documents that lie with it, shard by shard: per term a posting list in order of the
documents, and over its impacts a sparse table that answers for any stretch of the list where its maximum
is. For an interval of documents the sum of the maxima of the query's terms bounds every score within.
A query's search takes its intervals best bound first, scores the document of the greatest impact in full
and goes on with the intervals on its two sides; one whose bound can't reach the k-th best score so far is
done with. Only each task's best documents are shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.llm.common import materialize

#: A term: letters, digits and everything beyond ASCII, in UTF-8; A-Z count as a-z.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Share (percent) of a document's length in its impact's denominator, and the fixed point of weights and impacts.
LENGTH_SHARE, ONE, SCALE = 75, 1000, 1_000_000_000
#: A shard is closed at so many postings or documents (one document at least).
SHARD_POSTINGS, SHARD_DOCS = 500_000, 1 << 16
#: Terms of the queries that are searched at once; more queries go in blocks, each a pass over the documents.
BLOCK_TERMS = 200_000
#: Intervals of a query that are split in one step, and terms looked up at once.
WIDE, LOOKUPS = 32, 2_000_000


def terms(text: str | None) -> list[bytes]:
    return TERM.findall((text or "").encode().translate(LOWER))


def length_norm(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """100 for a document of average length ``total / documents``."""
    return 100 - LENGTH_SHARE + (LENGTH_SHARE * n * documents) // total


def term_weight(df: int, documents: int) -> int:
    return math.floor(ONE * math.log((2 * documents + 2) / (2 * df + 1)))


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (SCALE * tf) // (ONE * tf + 8 * m)


class Queries:
    """Queries over one vocabulary: their terms (numbers) one after the other, with counts."""

    def __init__(self, items: list[list[bytes]]):
        counts = [Counter(i) for i in items]
        self.vocabulary = {t: k for k, t in enumerate(sorted({t for c in counts for t in c}))}
        self.begins = np.cumsum([0, *map(len, counts)])
        self.terms = np.array([self.vocabulary[t] for c in counts for t in c], np.int64)
        self.times = np.array([n for c in counts for n in c.values()], np.int64)

    def __len__(self) -> int:
        return len(self.begins) - 1

    def of(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The terms of some queries, flat: which entry each belongs to, its place in ``terms``, where entries begin."""
        sizes = self.begins[queries + 1] - self.begins[queries]
        begins = np.cumsum(sizes) - sizes
        which = np.repeat(np.arange(len(queries)), sizes)
        return which, np.arange(len(which)) - begins[which] + self.begins[queries][which], begins


class Shard:
    """Posting lists of some documents with a sparse table of range maxima over each."""

    def __init__(self, ids: np.ndarray, doc: np.ndarray, term: np.ndarray, value: np.ndarray, vocabulary: int):
        """``ids`` in the order in which equal scores rank; postings of a document (its place in ``ids``), term and impact."""
        self.ids, self.n = ids, len(ids)
        key = term * self.n + doc
        order = np.argsort(key, kind="stable")
        self.key, self.value = key[order], value[order]
        longest = int(np.bincount(term, minlength=1).max()) if len(term) else 0
        self.best = [np.arange(len(key), dtype=np.int32)]  # level j: place of the first maximum of 2**j postings
        while 2 << len(self.best) - 1 <= longest:
            half = 1 << len(self.best) - 1
            a, b = self.best[-1][:-half], self.best[-1][half:]
            self.best.append(np.where(self.value[b] > self.value[a], b, a))

    def places(self, term: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Where the postings of a term begin whose document is ``doc`` or a later one."""
        return np.searchsorted(self.key, term * self.n + doc)

    def maxima(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The place of the greatest impact of each stretch of one posting list (not empty), by two entries of its sparse table."""
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(lo), np.int64)
        for j in np.unique(level):
            at = level == j
            a, b = self.best[j][lo[at]], self.best[j][hi[at] - (1 << int(j))]
            out[at] = np.where(self.value[b] > self.value[a], b, a)
        return out


class Best:
    """The k best documents of every query so far, over all shards of a task."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.zeros((queries, k), np.int64)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)
        self.none = np.ones((queries, k), bool)  # a document without an id, or a free place

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        keep = score > 0
        if not keep.any():
            return
        old = np.repeat(np.arange(len(self.score)), self.k).reshape(self.score.shape)
        touched = np.unique(query[keep])
        q = np.concatenate([old[touched].ravel(), query[keep]])
        s = np.concatenate([self.score[touched].ravel(), score[keep]])
        i = np.concatenate([self.id[touched].ravel(), ids[keep]])
        x = np.concatenate([self.none[touched].ravel(), none[keep]])
        order = np.lexsort((i, x, -s, q))
        begins = np.searchsorted(q[order], touched)
        order = order[(begins[:, None] + np.arange(self.k)[None, :]).ravel()]
        for mine, new in ((self.score, s), (self.id, i), (self.none, x)):
            mine[touched] = new[order].reshape(len(touched), self.k)

    def open(self, query: np.ndarray, bound: np.ndarray, first: np.ndarray, none: np.ndarray) -> np.ndarray:
        """Which intervals may hold a document that ranks: a greater score, or an equal one with a smaller id."""
        worst, ids, missing = self.score[query, -1], self.id[query, -1], self.none[query, -1]
        before = (none < missing) | ((none == missing) & (first < ids))
        return (bound > worst) | ((bound == worst) & (bound > 0) & before)


def search(shard: Shard, queries: Queries, best: Best, none: np.ndarray, query: np.ndarray) -> int:
    """Find what ``shard`` adds to the ``best`` of some queries; returns how many documents were scored in full.

    ``none`` marks documents without an id, which come last in ``shard.ids``.
    """

    def bounded(q: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
        """The intervals [a, b) that hold a term of their query, their bounds and the document to split at."""
        which, at, _ = queries.of(q)
        term = queries.terms[at]
        lo, hi = shard.places(term, a[which]), shard.places(term, b[which])
        full = hi > lo
        which, at = which[full], at[full]
        if not len(which):
            return (np.zeros(0, np.int64),) * 5
        top = shard.maxima(lo[full], hi[full])
        value = shard.value[top] * queries.times[at]
        begins = np.flatnonzero(np.diff(which, prepend=-1))
        most = np.maximum.reduceat(value, begins)
        sizes = np.diff(np.append(begins, len(which)))
        peak = np.flatnonzero(value == np.repeat(most, sizes))
        peak = peak[np.diff(which[peak], prepend=-1) > 0]
        entry = which[begins]
        return q[entry], a[entry], b[entry], np.add.reduceat(value, begins), shard.key[top[peak]] % shard.n

    def scores(q: np.ndarray, doc: np.ndarray) -> np.ndarray:
        which, at, begins = queries.of(q)
        key = queries.terms[at] * shard.n + doc[which]
        place = np.minimum(np.searchsorted(shard.key, key), len(shard.key) - 1)
        return np.add.reduceat(np.where(shard.key[place] == key, shard.value[place] * queries.times[at], 0), begins)

    def kept(found: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        q, a, _, bound, _ = found
        at = best.open(q, bound, shard.ids[a], none[a])
        return tuple(x[at] for x in found)

    if not len(shard.key) or not len(query):
        return 0
    scored = 0
    waiting = kept(bounded(query, np.zeros(len(query), np.int64), np.full(len(query), shard.n)))
    while len(waiting[0]):
        q, a, b, bound, split = waiting
        order = np.lexsort((a, -bound, q))
        ranked = q[order]
        rank = np.arange(len(order)) - np.searchsorted(ranked, ranked)
        now, later = order[rank < WIDE], order[rank >= WIDE]
        scored += len(now)
        best.add(q[now], scores(q[now], split[now]), shard.ids[split[now]], none[split[now]])
        left, right = now[a[now] < split[now]], now[split[now] + 1 < b[now]]
        parts = bounded(np.concatenate([q[left], q[right]]), np.concatenate([a[left], split[right] + 1]), np.concatenate([split[left], b[right]]))
        waiting = kept(tuple(np.concatenate([x[later], y]) for x, y in zip(waiting, parts, strict=True)))
    return scored


def _postings(docs: DataFrame, vocabulary) -> DataFrame:
    """``doc_id, n`` and the document's terms that a query holds, with their counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value.get
        for batch in batches:
            sizes, found, times, ends = [], [], [], [0]
            for text in batch.column(1):
                words = terms(text.as_py())
                held = Counter(map(number, words))
                held.pop(None, None)
                sizes.append(len(words))
                found += held
                times += held.values()
                ends.append(len(found))
            offsets = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (found, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "times"])

    return docs.mapInArrow(count, "doc_id long, n long, terms array<int>, times array<int>")


def _shards(batches: Iterator[pa.RecordBatch], weights: np.ndarray, documents: int, total: int) -> Iterator[tuple[Shard, np.ndarray]]:
    """Index what a task reads, a shard at a time; documents by id, those without one last."""

    def made(held: list[tuple[np.ndarray, ...]]) -> tuple[Shard, np.ndarray]:
        ids, none, n, sizes, term, times = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((ids, none))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        doc = np.repeat(np.arange(len(ids)), sizes)
        value = weights[term] * impact(times, length_norm(n, documents, total)[doc])
        return Shard(ids[order], place[doc], term, value, len(weights)), none[order]

    held, postings, rows = [], 0, 0
    for batch in batches:
        ids, n, lists, times = (batch.column(k) for k in range(4))
        sizes = np.diff(lists.offsets.to_numpy())
        ends = np.cumsum(sizes)
        flat = [x.flatten().to_numpy().astype(np.int64) for x in (lists, times)]
        first = 0
        while first < batch.num_rows:
            room = max(SHARD_POSTINGS - postings, 0) + (ends[first - 1] if first else 0)
            last = min(int(np.searchsorted(ends, room, side="right")), first + SHARD_DOCS - rows, batch.num_rows)
            if last <= first and held:
                yield made(held)
                held, postings, rows = [], 0, 0
                continue
            last = max(last, first + 1)
            part = slice(ends[first - 1] if first else 0, ends[last - 1])
            none = ids.is_null().to_numpy(zero_copy_only=False)[first:last]
            held.append((ids.fill_null(0).to_numpy()[first:last], none, n.to_numpy()[first:last], sizes[first:last], flat[0][part], flat[1][part]))
            postings, rows, first = postings + part.stop - part.start, rows + last - first, last
    if held:
        yield made(held)


def _search_block(docs: DataFrame, items: list[list[bytes]], k: int) -> DataFrame:
    """``query, doc_id, score``: the best documents of each task for each of a block of queries."""
    sc = docs.sparkSession.sparkContext
    queries = Queries(items)
    lists = materialize(_postings(docs, sc.broadcast(queries.vocabulary)), "postings")
    counts = lists.filter("n > 0").agg(F.count("*"), F.sum("n")).head()
    documents, total = int(counts[0]), int(counts[1] or 1)
    found = lists.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # one row per term of the queries
    df = dict(map(tuple, found))
    shared = sc.broadcast((queries, np.array([term_weight(df.get(t, 0), documents) for t in range(len(queries.vocabulary))], np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights = shared.value
        best = Best(len(queries), k)
        step = max(1, LOOKUPS // (2 * WIDE * max(1, int(np.diff(queries.begins).max(initial=1)))))
        for shard, none in _shards(batches, weights, documents, total):
            for q in range(0, len(queries), step):
                search(shard, queries, best, none, np.arange(q, min(q + step, len(queries))))
        query, place = np.nonzero(best.score > 0)
        ids = pa.array(best.id[query, place], pa.int64(), mask=best.none[query, place])
        columns = [pa.array(query, pa.int64()), ids, pa.array(best.score[query, place], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["query", "doc_id", "score"])

    return lists.filter(F.size("terms") > 0).mapInArrow(run, "query long, doc_id long, score long")


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents of greatest score above 0 for each item, exactly.

    The score adds, over the item's terms with repeats, the term's weight (by how few documents hold it) times
    its saturated count in the document, in whole numbers. Equal scores rank by ``doc_id``, null last. Null and
    empty texts have no terms: such documents count in no average and are never found, such items have no rows.
    Rows with one id are documents of their own; rows of items that are wholly equal are one query, rows with one
    item_id and different texts are a query each. An empty table gives none; other columns are not read.

    Terms of up to BLOCK_TERMS are looked for in one pass over the texts; more items go in blocks, by a hash of
    their text. Postings are written where the texts lie; shuffled are counts and each task's best ``k``.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text")).filter("text is not null").distinct()
    asked = materialize(asked, "queries")
    size = asked.agg(F.sum(F.length("text"))).head()[0] or 0
    n = 1 + size // (2 * BLOCK_TERMS)  # a term and what ends it take two characters or more
    out = None
    for block in range(n):
        mine = asked.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == block).collect() if n > 1 else asked.collect()
        if not mine:
            continue
        found = _search_block(rows, [terms(r["text"]) for r in mine], k)
        names = asked.sparkSession.createDataFrame([(i, r["item_id"]) for i, r in enumerate(mine)], f"query long, item_id {asked.schema['item_id'].dataType.simpleString()}")
        parts = Window.partitionBy("query", F.pmod(F.xxhash64("doc_id"), F.lit(64))).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        whole = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        found = found.withColumn("rank", F.row_number().over(parts)).filter(F.col("rank") <= k)
        found = found.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= k)
        found = found.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.union(found)
    if out is None:
        out = asked.select("item_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    return out
