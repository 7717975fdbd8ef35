"""Secret scans: patterns first, then a token-efficiency test for random strings.

Words of a language take few tokens of a public vocabulary; random strings take many. A candidate whose
characters per token fall below a ratio is reported as a secret of kind ``dense``, unless it is a known
sort of digest or identifier.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The kinds of a span, in their order; ``dense`` is the method's own.
KINDS = ("assign", "access", "hex", "dense")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
#: Strings that may be random: runs of the characters of base64, its URL form and hex in capitals.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
#: Parts of such a run are judged too; one of fewer characters says too little.
PART = re.compile(r"[A-Za-z0-9+=]+")
LEAST_PART = 20
#: Digests and identifiers that are public by nature: UUIDs, digests in capitals of usual lengths, and strings behind the name of a digest.
UUID = re.compile(r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}")
DIGEST = re.compile(r"[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{56}|[0-9A-F]{64}|[0-9A-F]{96}|[0-9A-F]{128}|[0-9a-f]+")
DIGEST_NAME = re.compile(r"(?ai:md5|sha-?1|sha-?224|sha-?256|sha-?384|sha-?512|etag|checksum|integrity)[\s\"':=-]{0,4}$")
#: How the vocabulary's library cuts text before it merges bytes (the usual pattern of byte-level BPE).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAX_VOCABULARY_BYTES = 16_000_000
RATIO = 2.0


def read_vocabulary(spark: SparkSession, path: str = VOCABULARY) -> bytes:
    """The bytes of a vocabulary file (``token rank`` lines), refused beyond MAX_VOCABULARY_BYTES since it is broadcast."""
    if "://" in path:
        found = spark.read.format("binaryFile").load(path).filter(F.col("length") <= MAX_VOCABULARY_BYTES).select("content").head()
        data = bytes(found[0]) if found else b""
    else:
        with open(path, "rb") as f:
            data = f.read(MAX_VOCABULARY_BYTES + 1)
    if not 0 < len(data) <= MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is empty or larger than {MAX_VOCABULARY_BYTES} bytes")
    return data


def encoding(data: bytes) -> tiktoken.Encoding:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``start, number of the kind, end`` of the pattern matches, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def is_dense(word: str, vocabulary: tiktoken.Encoding, ratio: float = RATIO) -> bool:
    """Whether a candidate mixes letters with digits, or letters of both cases, and has few characters per token."""
    if sum((any(c.isdigit() for c in word), any(c.islower() for c in word), any(c.isupper() for c in word))) < 2:
        return False
    return len(word) < ratio * len(vocabulary.encode_ordinary(word))


def _stretches(word: str, vocabulary: tiktoken.Encoding, ratio: float) -> Iterator[tuple[int, int]]:
    """Neighbouring parts of a run (between '/', '-' and '_', beside UUIDs) that each have few characters per token."""
    masked = UUID.sub(lambda m: " " * len(m[0]), word)
    start = end = -1
    for m in PART.finditer(masked):
        few = len(m[0]) < ratio * len(vocabulary.encode_ordinary(m[0]))
        if start >= 0 and not (few and m.start() == end + 1 and masked[end] != " "):
            yield start, end
            start = -1
        if few:
            start, end = (m.start() if start < 0 else start), m.end()
    if start >= 0:
        yield start, end


def dense_spans(text: str, vocabulary: tiktoken.Encoding, ratio: float = RATIO) -> list[tuple[int, int, int]]:
    """Runs that are dense as a whole, and of other runs the stretches that are."""

    def secret(start: int, end: int) -> bool:
        word = text[start:end]
        public = UUID.search(word) or DIGEST.fullmatch(word) or DIGEST_NAME.search(text[max(0, start - 16) : start])
        return not public and is_dense(word, vocabulary, ratio)

    found = []
    for m in CANDIDATE.finditer(text):
        if secret(m.start(), m.end()):
            found.append((m.start(), 3, m.end()))
        elif not DIGEST_NAME.search(text[max(0, m.start() - 16) : m.start()]):
            parts = [(m.start() + a, 3, m.start() + b) for a, b in _stretches(m[0], vocabulary, ratio) if b - a >= LEAST_PART]
            found += [p for p in parts if secret(p[0], p[2])]
    return found


def secret_spans(text: str, vocabulary: tiktoken.Encoding, ratio: float = RATIO) -> list[tuple[int, int, int]]:
    """All spans of a text by start, then kind; a dense one that a base span holds is left to that."""
    base, dense, i, reach = base_spans(text), [], 0, 0
    for d in dense_spans(text, vocabulary, ratio):
        while i < len(base) and base[i][0] <= d[0]:
            reach, i = max(reach, base[i][2]), i + 1
        if d[2] > reach:
            dense.append(d)
    return sorted(base + dense)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every stretch that spans cover replaced by ``[KIND]`` of the span that begins it."""
    out, at = [], 0
    for start, kind, end in spans:
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def scan_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, ratio: float = RATIO
) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_dense, base_sha256, spans, redacted`` for every row of ``docs``.

    Null texts count as empty: no spans, and the digest of the empty string. Spans are in code points,
    the end exclusive. ``redacted`` is the whole text without its secrets (null for null). Repeated rows
    and ids give a row each; an empty table gives none; other columns are not read. Rows are worked on
    where they lie: nothing is shuffled.
    """
    data = docs.sparkSession.sparkContext.broadcast(read_vocabulary(docs.sparkSession, vocabulary))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoding(data.value)
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            digests, texts, clean = [], [], []
            for value in batch.column(1):
                raw = value.as_py()
                text = raw or ""
                spans = secret_spans(text, words, ratio)
                for k, column in enumerate(counts):
                    column.append(sum(s[1] == k for s in spans))
                digests.append(hashlib.sha256(joined([s for s in spans if s[1] < 3]).encode()).hexdigest())
                texts.append(joined(spans))
                clean.append(None if raw is None else redact(text, spans))
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), *(pa.array(c, pa.string()) for c in (digests, texts, clean))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "n_dense", "base_sha256", "spans", "redacted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        scan, "doc_id long, n_assign long, n_access long, n_hex long, n_dense long, base_sha256 string, spans string, redacted string"
    )


def _replaced(batch: pa.RecordBatch, column: int, values: dict[int, object]) -> pa.RecordBatch:
    """The batch with new values in some rows (in order) of a column."""
    mask = np.zeros(batch.num_rows, bool)
    mask[list(values)] = True
    field = batch.schema.field(column)
    new = pc.replace_with_mask(batch.column(column), pa.array(mask), pa.array(list(values.values()), field.type))
    return batch.set_column(column, field, new)


def redact_secrets(
    docs: DataFrame, text_col: str = "text", count_col: str | None = None, vocabulary: str = VOCABULARY, ratio: float = RATIO
) -> DataFrame:
    """``docs`` with the secrets of ``text_col`` replaced; all other columns, rows and nulls as they were.

    ``count_col``, if given and there (an integer column), gets the code points of each text that changed.
    """
    data = docs.sparkSession.sparkContext.broadcast(read_vocabulary(docs.sparkSession, vocabulary))
    at = docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoding(data.value)
        for batch in batches:
            changed: dict[int, str] = {}
            for i, value in enumerate(batch.column(at)):
                text = value.as_py()
                if text and (new := redact(text, secret_spans(text, words, ratio))) != text:
                    changed[i] = new
            out = _replaced(batch, at, changed)
            if count_col in batch.schema.names:
                out = _replaced(out, batch.schema.get_field_index(count_col), {i: len(t) for i, t in changed.items()})
            yield out

    return docs.mapInArrow(clean, docs.schema)
