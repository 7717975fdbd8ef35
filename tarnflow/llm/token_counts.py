"""Token counts of whole texts without moving their pre-tokens between tasks.

A byte-level BPE cuts a text into pre-tokens and encodes each on its own, so a text's count is a sum of
lengths of pre-tokens. Two tiers give these lengths where the texts lie: a broadcast table of the
pre-tokens that are frequent in the corpus, and behind it a cache in each Python worker, whose misses
alone are encoded.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tarnflow.llm.common import materialize
from tarnflow.llm.secrets import SPLIT, read_vocabulary

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
LIMIT = 512
#: A pre-token is frequent if it is at least this share of all; so there are at most 131,072 of them.
FREQUENT_SHARE = 2.0**-17
#: Longer pre-tokens are neither in the table nor in the caches, so that both have a proven size; they are encoded each time.
LONGEST_KEPT = 64
#: Distinct pre-tokens that a task counts at once, and that a worker's cache holds.
COUNTED = 1 << 18
CACHED = 1 << 18
#: Longer texts are worked on in blocks of about so many characters, cut where a pre-token surely begins.
BLOCK = 1 << 20

_PIECES = regex.compile(SPLIT)
_BORDER = re.compile(r"(?<=\S) (?=\S)")

#: Characters of Latin scripts, for whose texts the same pattern with its classes spelled out is faster.
_LATIN = frozenset(map(chr, range(0x250)))
_CLASS = {k: "".join(re.escape(c) for c in sorted(_LATIN) if unicodedata.category(c)[0] == k) for k in "LN"}
_SPACE = r"\t-\r \x85\xa0"
_LATIN_PIECES = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_CLASS['L']}]+| ?[{_CLASS['N']}]+| ?[^{_SPACE}{_CLASS['L']}{_CLASS['N']}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)

#: How byte-level models write a byte as a character: printable ones as they are, the others from U+0100 on.
_HIDDEN = [b for b in range(256) if b == 32 or not chr(b).isprintable()]
_BYTES = {b: 256 + k for k, b in enumerate(_HIDDEN)}


class PreTokens:
    """Cuts texts into pre-tokens as the tokenizer does, and encodes single ones."""

    def __init__(self, data: bytes):
        spec = json.loads(data)
        split, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        if not plain or spec.get("normalizer") or spec["model"].get("type") != "BPE":
            raise ValueError("only byte-level BPE with the usual split, no normaliser and no prefix space is counted by pre-tokens")
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added):
            raise ValueError("added tokens that strip or need word borders are not counted by pre-tokens")
        self.tokenizer = Tokenizer.from_str(data.decode())
        self.model = self.tokenizer.model
        names = sorted((t["content"] for t in added), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, names))) if names else None
        self.cache: dict[str, int] = {}

    def parts(self, text: str) -> tuple[list[str], int]:
        """The stretches of a text between added tokens, and the number of these (one token each)."""
        if self.added is None:
            return [text], 0
        parts = self.added.split(text)
        return parts, len(parts) - 1

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a stretch. The pattern's classes are those of the tokenizer but for characters that
        this Python's Unicode does not know; texts with such ones are cut by the tokenizer itself."""
        if text.isascii() or (chars := set(text)) <= _LATIN:
            return _LATIN_PIECES.findall(text)
        if any(unicodedata.category(c) == "Cn" for c in chars):
            return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return _PIECES.findall(text)

    def length(self, piece: str) -> int:
        """Tokens of one pre-token, from the worker's cache or encoded."""
        n = self.cache.get(piece)
        if n is None:
            n = len(self.model.tokenize(piece.encode().decode("latin-1").translate(_BYTES)))
            if len(piece) <= LONGEST_KEPT:
                if len(self.cache) >= CACHED:
                    self.cache.clear()
                self.cache[piece] = n
        return n


@lru_cache(maxsize=2)
def pre_tokens(data: bytes) -> PreTokens:
    """One object, with its cache, for all tasks that a Python worker runs."""
    return PreTokens(data)


def blocks(text: str, most: int | None = None) -> Iterator[str]:
    """The text in blocks cut before a single space between two characters that are no white space."""
    at, most = 0, most or BLOCK
    while len(text) - at > most and (found := _BORDER.search(text, at + most)):
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def frequent_pieces(texts: Iterator[str], cutter: PreTokens, counted: int | None = None) -> Counter[str]:
    """The pre-tokens that make up a share of FREQUENT_SHARE of ``texts``, in bounded memory: when more than
    ``counted`` differ, all lose the median count (Misra and Gries), which no frequent one can be lost by."""
    found: Counter[str] = Counter()
    counted, total = counted or COUNTED, 0
    for text in texts:
        for part in cutter.parts(text)[0]:
            for block in blocks(part):
                pieces = cutter.pieces(block)
                total += len(pieces)
                found.update(pieces)
                if len(found) > counted:
                    cut = sorted(found.values())[len(found) // 2]
                    found = Counter({k: n - cut for k, n in found.items() if n > cut and len(k) <= LONGEST_KEPT})
    least = max(4, int(total * FREQUENT_SHARE))
    return Counter({k: n for k, n in found.items() if n >= least and len(k) <= LONGEST_KEPT})


def token_count(text: str, cutter: PreTokens, frequent: dict[str, int]) -> int:
    parts, n = cutter.parts(text)
    for part in parts:
        for block in blocks(part):
            pieces = cutter.pieces(block)
            lengths = list(map(frequent.get, pieces))
            n += sum(filter(None, lengths))
            if None in lengths:
                n += sum(map(cutter.length, [p for p, k in zip(pieces, lengths, strict=True) if k is None]))
    return n


def _lengths_of_frequent(docs: DataFrame, vocabulary, data: bytes) -> dict[str, int]:
    """Tokens of the corpus's frequent pre-tokens: each task counts its own and hands on the frequent ones only."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = frequent_pieces((t for b in batches for t in b.column(0).to_pylist() if t), pre_tokens(vocabulary.value))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["piece", "n"])

    heads = docs.select("text").mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    heads = materialize(heads, "pieces")
    total = heads.agg(F.sum("n")).head()[0] or 0
    cutter = PreTokens(data)
    rows = heads.filter(F.col("n") >= max(1, int(total * FREQUENT_SHARE))).select("piece").collect()  # at most 1 / FREQUENT_SHARE
    return {r[0]: cutter.length(r[0]) for r in rows}


def count_tokens(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, limit: int = LIMIT
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``: its whole text under a byte-level BPE.

    Counts are those of the library for the tokenizer's file, without begin, end or added tokens; the text of
    an added token inside a document is that one token, as is the library's default. Null texts count as
    empty (0 bytes, 0 tokens). Rows with one id, or none, give a row each; an empty table gives none; other
    columns are not read, whatever they are called. Texts are read twice, and neither they nor their
    pre-tokens are shuffled: only each task's frequent ones (at most 1 / FREQUENT_SHARE) are added up.
    """
    data = read_vocabulary(docs.sparkSession, tokenizer)
    PreTokens(data)  # refused here rather than in a task
    sc = docs.sparkSession.sparkContext
    vocabulary = sc.broadcast(data)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    frequent = sc.broadcast(_lengths_of_frequent(rows, vocabulary, data))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = pre_tokens(vocabulary.value)
        for batch in batches:
            texts = batch.column(1)
            n = pa.array([token_count(t.as_py() or "", cutter, frequent.value) for t in texts], pa.int64())
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, n, pc.greater(n, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
