"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints of 64 bits are cut into two segments of 32. Two that differ in three bits or fewer have a
segment in which they differ in one bit at most, so they share a variant of that segment in which that
one bit is a wildcard. Variants are indexed and joined by equality, and what meets is verified.
A variant that more than ``CROWDED`` fingerprints share is not paired off: its fingerprints go on to
finer variants (three of eight bytes as wildcards, then three of sixteen half-bytes), which between
them still hold every pair, and the last of which 4,096 fingerprints can share at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.common import connected, materialize

BITS = 3
WORDS = 3
SEED = 42
CROWDED = 64
#: At most so many shared keys (8 bytes each) are broadcast to find their members; beyond it they are joined.
MAX_BROADCAST_KEYS = 2_000_000


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    """SimHash of a UTF-8 text: majority of the bits of XXH64 over its lower-cased word shingles (none: 0)."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        hashes = [xxhash.xxh64_intdigest(b" ".join(tokens), SEED)]
    else:
        hashes = [xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in zip(*(tokens[i:] for i in range(words)), strict=False)]
    votes, h = np.zeros(64, np.int64), np.array(hashes, dtype="<u8")
    for i in range(0, len(h), 65536):  # a part at a time: eight bytes become 64
        votes += np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_id: bool = False) -> DataFrame:
    """``doc_id, fp``: the fingerprint of each whole text as a signed long. Null and empty texts have 0. Ids are made long, or stay as they are if ``keep_id``."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x.as_buffer().to_pybytes() if x.is_valid else None) for x in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    name = F.col(id_col) if keep_id else F.col(id_col).cast("long")
    rows = docs.select(name.alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(of, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def _wildcard_variants() -> Column:
    """64 keys: which segment, which of its bits is the wildcard, and the segment without it."""
    i = F.col("i")
    segment = F.expr("shiftrightunsigned(fp, 32 * (i div 32)) & 4294967295L")
    return F.shiftleft(i.cast("long"), 32).bitwiseOR(segment.bitwiseAND(F.expr("~shiftleft(1L, cast(i % 32 as int))")))


def _masked_variants(masks: list[int]) -> Column:
    """A key for each mask: its number and the bits that it keeps."""
    signed = [m - 2**64 if m >= 2**63 else m for m in masks]
    kept = F.array(*[F.lit(m).cast("long") for m in signed])
    return F.xxhash64(F.col("i"), F.col("fp").bitwiseAND(F.element_at(kept, F.col("i") + 1)))


def _masks(blocks: int, wild: int = BITS) -> list[int]:
    width = 64 // blocks
    block = (1 << width) - 1
    return [sum(block << (width * b) for b in range(blocks) if b not in out) for out in combinations(range(blocks), wild)]


def _small(keys: DataFrame) -> DataFrame:
    """Keys to be broadcast if they are few, else to be joined as they are."""
    return F.broadcast(keys) if keys.count() <= MAX_BROADCAST_KEYS else keys


def near_pairs(prints: DataFrame, bits: int = BITS, crowded: int = CROWDED) -> DataFrame:
    """``a, b`` (a < b): all pairs of different fingerprints ``fp`` that differ in ``bits`` (3 at most) or fewer.

    ``prints`` has one row ``fp`` (long, not null) for each different fingerprint.
    """
    if not 0 <= bits <= BITS:
        raise ValueError(f"bits must be from 0 to {BITS}")
    found = None
    levels = [(64, _wildcard_variants(), crowded), (56, _masked_variants(_masks(8)), 8 * crowded), (560, _masked_variants(_masks(16)), None)]
    at = prints.select("fp")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits
    for n, key, most in levels:
        variants = at.select("fp", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).select(key.alias("key"), "fp")
        shared = materialize(variants.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
        some = shared if most is None else shared.filter(f"n <= {most}")
        members = materialize(variants.join(_small(some.select("key")), "key"), "members")
        met = members.withColumnRenamed("fp", "a").join(members.withColumnRenamed("fp", "b"), "key").filter("a < b")
        pairs = met.filter(near).select("a", "b")
        found = pairs if found is None else found.union(pairs)
        hot = shared.filter(f"n > {most}").select("key") if most else None
        if hot is None or not hot.limit(1).count():
            break
        at = materialize(variants.join(_small(hot), "key").select("fp").distinct(), "crowded")
    return found.distinct()


def _components(prints: DataFrame, bits: int, crowded: int) -> DataFrame:
    """``fp, component_id`` of each fingerprint, from ``doc_id, fp`` rows."""
    reps = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    roots = connected(near_pairs(reps, bits, crowded)).join(reps, F.col("node") == F.col("fp")).select("fp", "root", "rep")
    named = roots.groupBy("root").agg(F.min("rep").alias("component_id"))
    linked = roots.join(named, "root").select("fp", "root", "component_id")
    of = reps.join(linked.withColumn("linked", F.lit(True)), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("rep")).alias("component_id")
    )
    return materialize(of, "components")  # so that the last join stands alone and AQE can split the fingerprint of a large group of copies


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, crowded: int = CROWDED
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row: 16 hex digits, and the smallest doc_id reachable by links.

    Null or empty texts have fingerprint zero and link as any other. Repeated rows and ids keep a row
    each. A null doc_id never names a component, and its component is null if all its members are null.
    An empty table gives no rows. Other columns of the input are not read.
    """
    prints = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    of = _components(prints, bits, crowded).select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def simhash_keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """One row of ``docs`` for each near-duplicate group: of the smallest id (none: last), of several texts with it that of the smallest hash.

    Rows that share id and text are one document, of which one row stays (any, if they differ in other columns).
    Null and empty texts are near-duplicates of each other. An empty table gives none; all columns stay as they are, whatever their names.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    named = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text"), text.alias("words"))
    prints = fingerprints(named.select(F.struct("id", "text").alias("key"), "words"), "key", "words", keep_id=True)
    prints = materialize(prints.select(F.col("doc_id.id").alias("doc_id"), F.col("doc_id.text").alias("text"), "fp"), "fingerprints")
    of = _components(prints, bits, CROWDED).select("fp", "root")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text")
    first = prints.groupBy("fp").agg(F.min(rank).alias("first"))
    first = first.join(of, "fp").groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.text")
    first = first.select(F.col("doc_id").alias("first_id"), F.col("text").alias("first_text"), F.lit(True).alias("stays"))
    marked = prints.join(first, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text") == F.col("first_text")), "left")
    kept = materialize(marked.select(F.col("doc_id").alias("of_id"), F.col("text").alias("of_text"), F.coalesce("stays", F.lit(False)).alias("stays")), "stays")
    on = F.col("id").eqNullSafe(F.col("of_id")) & (F.col("text") == F.col("of_text"))
    out = named.drop("words").join(kept.filter("not stays").select("of_id", "of_text").distinct(), on, "left_anti")
    again = kept.filter("stays").groupBy("of_id", "of_text").count().filter("count > 1").select("of_id", "of_text")
    if again.limit(1).count():
        again = materialize(again, "again")
        out = out.join(again, on, "left_anti").unionByName(out.join(again, on, "left_semi").dropDuplicates(["id", "text"]))
    return out.select("row.*")
