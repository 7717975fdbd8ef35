"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

Words, pairs of words and triples of word shapes are hashed into ``DIM`` weights. Training runs in epochs:
each part of the training rows goes on from the shared state in its own task, and the states are averaged.
A score is a sparse dot product with the weights.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.common import materialize, mix, slices, span_hashes, text_buffers

DIM = 1 << 18
#: Labelled rows that training uses at most: those whose hashed ids come first.
MAX_TRAIN = 20_000
PARTS = 4
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.1
THRESHOLD = 0.3
MOST_WEIGHT = 20.0
_REPEAT = 9  # the shape of a word that is the one before it again


def _kinds() -> np.ndarray:
    kind = np.full(256, 3, np.uint8)
    kind[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
    kind[48:58] = 2
    kind[[32, *range(9, 14)]] = 0
    return kind


_KIND = _kinds()


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, index and value of the non-zero features of concatenated UTF-8 rows: log counts of words and pairs, and root counts of
    triples of shapes, each of length one in a row."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float64)
    n = len(data)
    if not n:
        return none
    kind = _KIND[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    change = np.concatenate([[True], kind[1:] != kind[:-1]]) | edge[:-1]
    starts = np.nonzero(change)[0]
    ends = np.append(starts[1:], n)
    word = kind[starts] > 0
    starts, ends = starts[word], ends[word]
    if not len(starts):
        return none
    row = np.searchsorted(offsets, starts, side="right") - 1
    before = np.concatenate([[np.uint8(0)], data[:-1]])
    upper = ((data >= 65) & (data <= 90)) | ((before == 0xC3) & (data >= 0x80) & (data <= 0x9E) & (data != 0x97))
    h = span_hashes(np.where(upper, data + 32, data), starts, ends)
    capitals = np.concatenate([[0], np.cumsum(upper)])
    caps = capitals[ends] - capitals[starts]
    length = ends - starts
    # 1 lower case, 2 one capital, 3 capitals, 4 digits, 5-7 marks by length, 9 the same word again
    shape = np.select([kind[starts] == 3, kind[starts] == 2, caps == 0, caps == 1], [4 + np.minimum(length, 3), 4, 1, 2], 3).astype(np.uint64)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1]) & (kind[starts[1:]] == 1)
    shape[again] = _REPEAT
    two = row[1:] == row[:-1]
    three = row[2:] == row[:-2]
    triple = mix((shape[:-2] * np.uint64(100) + shape[1:-1] * np.uint64(10) + shape[2:]) + np.uint64(0x5348415045))
    last, index = mix(h[:-1][two] * np.uint64(31) + h[1:][two]), mix(h + np.uint64(1))
    words = _counted(np.concatenate([row, row[1:][two]]), np.concatenate([index, last]))
    shapes = _counted(row[2:][three], triple[three])
    tables = [(r, i, np.log1p(c)) for r, i, c in (words,)] + [(r, i, np.sqrt(c)) for r, i, c in (shapes,)]
    lengths = [np.sqrt(np.bincount(r, weights=v * v, minlength=len(offsets) - 1)) for r, _, v in tables]
    rows, index, value = (np.concatenate(x) for x in zip(*((r, i, v / n[r]) for (r, i, v), n in zip(tables, lengths, strict=True)), strict=True))
    order = np.argsort(rows, kind="stable")
    return rows[order], index[order], value[order]


def _counted(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, index and count of hashed features, each once."""
    key, count = np.unique(row * DIM + (h % np.uint64(DIM)).astype(np.int64), return_counts=True)
    return key // DIM, key % DIM, count


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The weights that a follow-the-regularised-leader state stands for."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def learn(z: np.ndarray, n: np.ndarray, index: np.ndarray, value: np.ndarray, label: int, weight: float = 1.0) -> None:
    """One update of the state, in place. The last place of the state is the intercept."""
    index, value = np.append(index, DIM), np.append(value, 1.0)
    w = weights(z[index], n[index])
    g = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - label) * value * weight
    z[index] += g - (np.sqrt(n[index] + g * g) - np.sqrt(n[index])) / ALPHA * w
    n[index] += g * g


def training_features(labelled: DataFrame, text_col: str, label_col: str) -> DataFrame:
    """``part, rank, label, index, value``: the sparse features of each labelled text, as bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(3))
            for a, b in slices(offsets):
                row, index, value = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                at = np.searchsorted(row, np.arange(b - a + 1))
                pairs = list(zip(at[:-1], at[1:], strict=True))
                columns = [batch.column(i).slice(a, b - a) for i in range(3)]
                columns += [pa.array([index[s:e].astype("<i4").tobytes() for s, e in pairs], pa.binary()), pa.array([value[s:e].astype("<f4").tobytes() for s, e in pairs], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["part", "rank", "label", "index", "value"])

    return labelled.select("part", "rank", F.col(label_col).cast("int").alias("label"), F.col(text_col).cast("binary").alias("text")).mapInArrow(
        cut, "part int, rank long, label int, index binary, value binary"
    )


def _epoch(state: Broadcast, rare: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A pass over a part's rows, in the order of their hashed ids, from the shared state on."""

    def epoch(rows: pd.DataFrame) -> pd.DataFrame:
        z, n = (x.copy() for x in state.value)
        rows = rows.sort_values(["rank", "index"])
        for label, index, value in zip(rows["label"], rows["index"], rows["value"], strict=True):
            learn(z, n, np.frombuffer(index, "<i4"), np.frombuffer(value, "<f4").astype(np.float64), label, 1.0 if label else rare)
        at = np.nonzero(n)[0]
        return pd.DataFrame({"at": at, "z": z[at], "n": n[at]})

    return epoch


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MAX_TRAIN) -> np.ndarray:
    """The weights (DIM of them and the intercept) learnt from at most ``most`` rows of ``labels`` and their documents.

    ``labels`` has ``id_col`` and ``label_col`` (0 or 1; other rows are left out; of several labels of an
    id the larger holds). Only the bounded sample is shuffled; each task holds a part of it.
    """
    marks = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    sample = materialize(marks.withColumn("rank", F.xxhash64("id")).orderBy("rank", "id").limit(most), "sample")
    part = F.pmod(F.col("rank"), F.lit(PARTS)).cast("int")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    chosen = texts.join(F.broadcast(sample) if most <= 1_000_000 else sample, "id").withColumn("part", part)
    rows = materialize(training_features(chosen, "text", "label"), "features")
    sc = docs.sparkSession.sparkContext
    z, n = np.zeros(DIM + 1), np.zeros(DIM + 1)
    good, bad = sample.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).head()
    rare = min(MOST_WEIGHT, max(1 / MOST_WEIGHT, good / bad)) if good and bad else 1.0  # label 0 counts as much as label 1 altogether
    for _ in range(EPOCHS):
        state = sc.broadcast((z, n))
        parts = rows.groupBy("part").applyInPandas(_epoch(state, rare), "at int, z double, n double")
        # each weight is averaged over the parts that have met its feature; at most DIM + 1 rows come back
        mean = parts.groupBy("at").agg(F.avg("z").alias("z"), F.avg("n").alias("n")).toPandas()
        z, n = np.zeros(DIM + 1), np.zeros(DIM + 1)
        z[mean["at"]], n[mean["at"]] = mean["z"], mean["n"]
        state.unpersist()
    return weights(z, n)


def score_quality(docs: DataFrame, w: np.ndarray, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """``id_cols, score``: the probability of label 1 for each whole text (null and empty: that of the intercept)."""
    shared = docs.sparkSession.sparkContext.broadcast(w.astype(np.float32))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            data, offsets = text_buffers(batch.column(len(id_cols)))
            for a, b in slices(offsets):
                row, index, value = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                dot = np.bincount(row, weights=value * w[index], minlength=b - a) + w[DIM]
                columns = [batch.column(i).slice(a, b - a) for i in range(len(id_cols))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(1 / (1 + np.exp(-np.clip(dot, -35, 35))))], [*id_cols, "score"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in id_cols)
    return docs.select(*id_cols, F.col(text_col).cast("binary").alias("__text")).mapInArrow(score, f"{kinds}, score double")


def _fold(id_col: str, folds: int):
    return F.crc32(F.col(id_col).cast("string")) % folds


def classify_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    folds: int = 5, held: int = 0, threshold: float = THRESHOLD, most: int = MAX_TRAIN,
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Learns from labels whose crc32 of the id modulo ``folds`` is not ``held``; only texts play a part in
    a score. With no labels every score is 0.5. Null texts score as empty ones, a null id is not held
    out, repeated rows give a row each, an empty table none. Other columns are not read.
    """
    w = train(docs, labels.filter(_fold(id_col, folds) != held), id_col, text_col, label_col, most)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(_fold(id_col, folds) == held, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    return score_quality(rows, w, ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the classifier does not reject."""
    w = train(docs, labels.filter(_fold(id_col, 5) != 0), id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(w.astype(np.float32))
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            data, offsets = text_buffers(batch.column(at))
            good = []
            for a, b in slices(offsets):
                row, index, value = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                good.append(1 / (1 + np.exp(-np.clip(np.bincount(row, weights=value * w[index], minlength=b - a) + w[DIM], -35, 35))) >= threshold)
            yield batch.filter(pa.array(np.concatenate(good) if good else np.zeros(0, bool)))

    return docs.mapInArrow(keep, docs.schema)
