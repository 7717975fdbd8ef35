"""What several of the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.session import materialize

#: An odd multiplier and its inverse modulo 2**64, for polynomial hashes over bytes.
POLY = np.uint64(0x9E3779B97F4A7C15)
POLY_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary or string column as one array, and the offsets of its rows (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` bytes, one row at least: a step keeps some hundred times that in memory."""
    n, start = len(offsets) - 1, 0
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1)
        yield start, min(end, n)
        start = min(end, n)


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit hashes: every bit of the input reaches every bit of the output."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, from one prefix sum over all of them."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(POLY, len(data)), out=prefix[1:])
    inverse = powers(POLY_INV, len(data) + 1)
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def connected(edges: DataFrame, left: str = "a", right: str = "b", rounds: int = 60) -> DataFrame:
    """Components of an undirected graph: one row ``node, root`` per node that has an edge, root its smallest node.

    Alternates large-star and small-star steps (every node hands its neighbours to the smallest one)
    until only stars are left, in a number of rounds that grows with the logarithm of the graph. Each
    round is a written table. Null ends and loops are left out. A hub's neighbours are never gathered:
    its smallest neighbour comes from a pre-aggregated minimum and goes back by an equality join.
    """
    now = materialize(
        edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).filter("u > v").distinct(), "edges"
    )
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        now = materialize(small.filter("u > v").distinct(), "edges")
        roots = now.select(F.col("v").alias("u")).distinct()
        if not now.join(roots, "u", "left_semi").limit(1).count() and not now.groupBy("u").count().filter("count > 1").limit(1).count():
            break
    else:
        raise RuntimeError(f"the graph did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
