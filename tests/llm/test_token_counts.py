"""Counts of pre-tokens against the tokenizer's own encoding of whole texts."""

import random
import unicodedata

import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tarnflow.llm import token_counts
from tarnflow.llm.token_counts import TOKENIZER, PreTokens, blocks, count_tokens, frequent_pieces, token_count

DATA = open(TOKENIZER, "rb").read()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(TOKENIZER)


def texts():
    rng = random.Random(5)
    alphabet = ["a", "B", "é", "ß", "1", "²", "中", "🙂", "́", "'s", "'", "'LL", " ", "  ", "\n", "\t", " ", "　", "\x1c", "-", "_", "<|endoftext|>", "<|", "the", " of", "\U0001f9ff", "࢏"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]


def test_counts_are_those_of_the_library(library):
    cutter = PreTokens(DATA)
    some = texts()
    frequent = {p: cutter.length(p) for p in frequent_pieces(iter(some), cutter)}
    assert frequent
    for text, e in zip(some, library.encode_batch(some, add_special_tokens=False), strict=True):
        assert token_count(text, cutter, frequent) == len(e.ids) == token_count(text, cutter, {})


def test_pieces_of_every_character():
    cutter = PreTokens(DATA)
    cut = cutter.tokenizer.pre_tokenizer.pre_tokenize_str
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    for i in range(0, len(chars), 512):
        text = "".join(f"a{c}1{c} {c}b{c}{c}-" for c in chars[i : i + 512])
        assert cutter.pieces(text) == [text[a:b] for _, (a, b) in cut(text)]
        assert cutter.pieces(text + "\n中") == cutter.pieces(text) + ["\n", "中"]  # by the other pattern
    odd = "a࢏1 \U0003fc3bb"  # not in this Python's Unicode
    assert cutter.pieces(odd) == [odd[a:b] for _, (a, b) in cut(odd)]


def test_blocks_change_nothing(library):
    cutter = PreTokens(DATA)
    for text in [*texts()[:500], "word " * 3000, "x" * 5000, " \n " * 2000]:
        assert "".join(blocks(text, 7)) == text
        assert [p for b in blocks(text, 7) for p in cutter.pieces(b)] == cutter.pieces(text)


def test_frequent_pieces_survive_a_small_table():
    cutter = PreTokens(DATA)
    rare = [f" {a}{b}{c}" for a in "abcdefgh" for b in "ijklmnop" for c in "qrstuvwx"]
    found = frequent_pieces((" often" + r for r in rare), cutter, counted=50)
    assert " often" in found and len(found) <= 51


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHED", 10)
    cutter = PreTokens(DATA)
    for n in range(200):
        cutter.length(f" w{n}")
    assert len(cutter.cache) <= 10
    cutter.length("x" * 1000)
    assert "x" * 1000 not in cutter.cache


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        PreTokens(open("/opt/tokenizers/word_bpe_49k.json", "rb").read())


def test_rows(spark, library):
    long = "One more sentence, with 12 numbers; and l'été. " * 40_000
    some = [(1, "The cat."), (1, "The cat."), (None, "a"), (2, None), (3, ""), (4, long), (5, "x<|endoftext|>y")]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_tokens", T.StringType()), T.StructField("piece", T.StringType())])
    got = count_tokens(spark.createDataFrame([(*r, "z", "z") for r in some], schema)).collect()
    want = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in some]
    assert sorted(map(str, [(r.doc_id, r.n_bytes, r.n_tokens) for r in got])) == sorted(map(str, want))
    assert all(r.over_limit == (r.n_tokens > 512) for r in got) and sum(r.over_limit for r in got) == 1
    assert count_tokens(spark.createDataFrame([], schema)).collect() == []
