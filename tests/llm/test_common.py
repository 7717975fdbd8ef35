import random

import numpy as np
import pyarrow as pa

from tarnflow.llm import common


def components(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in root}


def test_components_of_chains_hubs_and_random_graphs(spark):
    rng = random.Random(2)
    chain = list(range(0, 60))
    rng.shuffle(chain)
    edges = list(zip(chain, chain[1:]))  # a long chain in no order
    edges += [(1000, 1000 + k) for k in range(1, 200)] + [(1999, 1000)]  # a hub
    edges += [(rng.randrange(3000, 3200), rng.randrange(3000, 3200)) for _ in range(120)]
    want = components([e for e in edges if e[0] != e[1]])
    df = spark.createDataFrame(edges + edges[:5] + [(None, 4), (7, 7)], "a long, b long")
    assert {r.node: r.root for r in common.connected(df).collect()} == want
    assert common.connected(df.limit(0)).count() == 0


def test_text_buffers_of_slices_and_nulls():
    column = pa.array([b"ab", None, b"", "é".encode(), b"xyz"], pa.binary())
    for part in (column, column.slice(1, 3), column.slice(4), column.slice(0, 0)):
        data, offsets = common.text_buffers(part)
        assert [data[a:b].tobytes() for a, b in zip(offsets, offsets[1:])] == [x or b"" for x in part.to_pylist()]


def test_slices_cover_all_rows():
    offsets = np.cumsum([0, 5, 50, 1, 1, 1, 0, 0, 200, 3])
    parts = list(common.slices(offsets, 10))
    assert parts[0][0] == 0 and parts[-1][1] == 9 and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
    assert all(b == a + 1 or offsets[b] - offsets[a] <= 10 for a, b in parts)


def test_span_hashes_depend_on_the_bytes_alone():
    a = np.frombuffer(b"one two one", np.uint8)
    h = common.span_hashes(a, np.array([0, 4, 8]), np.array([3, 7, 11]))
    assert h[0] == h[2] != h[1]
    assert common.span_hashes(np.frombuffer(b"one", np.uint8), np.array([0]), np.array([3]))[0] == h[0]
