"""Periodic runs of words in whole texts, and the texts with each run collapsed to its first period.

A run of period q repeats q words at least four times. Periods up to DIRECT are found by comparing the
words with themselves at that distance. For longer ones, at the scale with q in (W, 2W], every window of W
starting places keeps the least hash of the 2W words that begin there. Inside a run two windows q apart hold
the same hashes, so their minima lie exactly q apart, and as 2W words are no shorter than the period, nothing
between them is equal. So neighbouring equal minima give the period; comparing words from there on both
sides gives the run. All work is per document, many documents at a time in one array.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.common import mix

#: Periods up to this are looked for directly, longer ones by minimizers (a power of two).
DIRECT = 16
#: A run has at least this many words, and this many times its period.
LEAST_WORDS, LEAST_TIMES = 6, 4
#: Words that are worked on at once (one document at least).
SLICE = 200_000

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _slide(x: np.ndarray, width: int, best: np.ufunc, fill: int) -> np.ndarray:
    """The least or greatest of every ``width`` neighbours, in time that does not grow with the width."""
    padded = np.full(-(-len(x) // width) * width, fill, x.dtype)
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    front = best.accumulate(rows, axis=1).ravel()
    back = best.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - width + 1
    return best(back[:n], front[width - 1 : width - 1 + n])


def minimizers(h: np.ndarray, width: int) -> np.ndarray:
    """Places whose hash is the least of some window of ``width`` places."""
    if len(h) < width:
        return np.zeros(0, np.int64)
    least = _slide(h, width, np.minimum, 2**64 - 1)
    edge = np.zeros(width - 1, np.uint64)
    return np.flatnonzero(_slide(np.concatenate([edge, least, edge]), width, np.maximum, 0) == h)


def _reach(words: np.ndarray, at: int, lag: int, step: int) -> int:
    """How many words from ``at`` on (``step`` 1) or before it (-1) equal those ``lag`` further on."""
    n, block = 0, 64
    most = len(words) - lag - at if step > 0 else at
    while n < most:
        size = min(block, most - n)
        start = at + n if step > 0 else at - n - size
        differ = words[start : start + size] != words[start + lag : start + lag + size]
        if differ.any():
            return n + int(differ.argmax() if step > 0 else differ[::-1].argmax())
        n, block = n + size, block * 2
    return n


def _stretches(words: np.ndarray, lag: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the places, ``least`` in a row or more, whose word comes again ``lag`` further on."""
    same = np.zeros(max(len(words) - lag, 0) + 2, np.int8)
    same[1:-1] = words[lag:] == words[: len(words) - lag]
    edges = np.flatnonzero(np.diff(same))
    starts, ends = edges[::2], edges[1::2]
    keep = ends - starts >= least
    return starts[keep], ends[keep]


def find_runs(ids: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Rows ``start, length, period`` of all runs, by start then period.

    ``ids`` holds the words of documents one after the other, each ended by a number of its own that is
    found nowhere else; ``begins`` the place of each document's first word and, last, the array's length.
    """
    found = []
    for q in range(1, min(DIRECT, len(ids) // LEAST_TIMES) + 1):
        s, e = _stretches(ids, q, max(LEAST_WORDS, LEAST_TIMES * q) - q)
        found.append(np.stack([s, e - s + q, np.full(len(s), q)], axis=1))
    lengths = np.diff(begins)
    words, places, of = ids, np.arange(len(ids)), np.repeat(np.arange(len(lengths)), lengths)
    h, width, grams = mix(ids.astype(np.uint64) * _MULTIPLIER + np.uint64(1)), DIRECT, 1
    while True:
        keep = lengths[of] > LEAST_TIMES * (width + 1)  # an end mark is counted with each document
        words, places, of, h = words[keep], places[keep], of[keep], h[keep]
        if not len(words):
            break
        while grams < 2 * width:
            h = mix(h * _MULTIPLIER + np.concatenate([h[grams:], np.zeros(min(grams, len(h)), np.uint64)]))
            grams *= 2
        at = minimizers(h, width)
        at = at[np.argsort(h[at], kind="stable")]
        lag = np.diff(at)
        seeds = np.flatnonzero((h[at[1:]] == h[at[:-1]]) & (lag > width) & (lag <= 2 * width))
        last, reached = 0, 0
        for i, q in sorted(zip(at[seeds].tolist(), lag[seeds].tolist(), strict=True), key=lambda s: (s[1], s[0])):
            if q == last and i < reached:  # in the stretch found from an earlier seed
                continue
            start = i - _reach(words, i, q, -1)
            last, reached = q, i + _reach(words, i, q, 1)
            if reached - start >= (LEAST_TIMES - 1) * q:
                found.append(np.array([[places[start], reached - start + q, q]]))
        width *= 2
    if not found:
        return np.zeros((0, 3), np.int64)
    runs = np.concatenate(found).astype(np.int64)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)  # of equal stretches the least period
    runs = runs[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def planted(n: int, doc_id: int | None) -> np.ndarray | None:
    """Which original word stands at each place of a document whose id asks for repetition; None: as it is."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places


def _documents(texts: list[str | None], doc_ids: list[int | None], plant: bool) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Slices of documents as lists of words: the first one's number, and the words of each."""
    first, held, size = 0, [], 0
    for i, (text, doc_id) in enumerate(zip(texts, doc_ids, strict=True)):
        words = (text or "").encode().split()  # bytes are split at \x20 and \x09-\x0D alone
        order = planted(len(words), doc_id) if plant else None
        if order is not None:
            words = [words[k] for k in order.tolist()]
        if held and size + len(words) > SLICE:
            yield first, held
            first, held, size = i, [], 0
        held.append(words)
        size += len(words)
    if held:
        yield first, held


def runs_of(documents: list[list[bytes]]) -> list[np.ndarray]:
    """The runs of each document, as rows ``start, length, period``."""
    numbers: dict[bytes, int] = {}
    begins = np.cumsum([0, *(len(d) + 1 for d in documents)])
    ids = np.empty(begins[-1], np.int64)
    for k, words in enumerate(documents):
        ids[begins[k] : begins[k + 1] - 1] = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
        ids[begins[k + 1] - 1] = -1 - k
    runs = find_runs(ids, begins)
    bounds = np.searchsorted(runs[:, 0], begins)
    return [runs[bounds[k] : bounds[k + 1]] - [begins[k], 0, 0] for k in range(len(documents))]


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not len(runs):
        return words
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
    np.add.at(cover, runs[:, 0] + runs[:, 1], -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()]


SCHEMA = (
    "doc_id long, runs array<struct<start:long,length:long,period:long>>, n_runs long, start long, length long, period long, "
    "exponent_milli long, collapsed string"
)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False) -> DataFrame:
    """The periodic runs of every row's whole text: ``doc_id, runs, n_runs``, the longest run (``start, length,
    period, exponent_milli``; equal lengths: least start, then period; nulls without a run) and ``collapsed``.

    Words are what stands between spaces, tabs and line ends. ``runs`` is sorted by start, then period.
    ``collapsed`` joins the words that no run holds after its first period by one space. With ``plant``, the ids
    make one document in ten repeat its own words (a test of recall that runs with the data); rows without an id
    are left as they are. Null and empty texts have no words, no runs and the empty string. Rows with one id give
    a row each; an empty table gives none; other columns are not read. Nothing is shuffled: the longest text
    bounds what a task holds.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, documents in _documents(texts, doc_ids, plant):
                out = []
                for k, (words, runs) in enumerate(zip(documents, runs_of(documents), strict=True)):
                    best = runs[np.lexsort((runs[:, 2], runs[:, 0], -runs[:, 1]))[0]].tolist() if len(runs) else None
                    rows = [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs.tolist()]
                    longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
                    out.append((doc_ids[first + k], rows, len(rows), *longest, b" ".join(collapsed(words, runs)).decode()))
                names = ["doc_id", "runs", "n_runs", "start", "length", "period", "exponent_milli", "collapsed"]
                run_type = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
                types = [pa.int64(), run_type, *[pa.int64()] * 5, pa.string()]
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scan, SCHEMA)


def run_digests(runs: DataFrame) -> DataFrame:
    """The runs and the collapsed text of ``periodic_runs`` as digests, for comparison."""
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    return runs.select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli",
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
