"""Benchmark decontamination by template canonicalisation.

Texts become sequences of lower-cased words in which numbers, units and names are typed placeholders.
Windows of eight such words are hashed; windows of documents meet those of benchmark items by an
equality join. The values behind the placeholders (slots) must agree within an occurrence: where one
value of the item stands for two in the document, it is not the same question with other parameters.
A window with too few plain words says little as a template: it is matched by its own words, and as a
template it goes on until it has enough. A capitalised word that begins a sentence may be a name or not:
both readings are matched. An item shorter than a window is one window; one of a few words must
be a whole sentence of the document, word by word. Signs between numbers (``+ - * / =`` and their like)
are words. Of scripts that set no spaces each character is a word, which says half as much as another.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.common import materialize, mix, powers, slices, span_hashes, text_buffers

WINDOW = 8
#: An item with fewer template words than this is matched as a whole sentence alone: within one, it would say too little.
MIN_WORDS = 5
#: A window with fewer plain words than this is matched verbatim, and as a template of up to LONGEST words.
MIN_PLAIN = 5
LONGEST = 16
#: Windows of one occurrence lie within so many words of each other's alignment.
BAND = 16
#: A document has an item if an occurrence shares this part of its windows, or this many (13 words in a row).
COVERAGE = 0.5
RUN = 6
#: At most so many window hashes of the benchmark are broadcast (8 bytes each); beyond that all windows go to the join.
MAX_BROADCAST = 4_000_000

#: Units that count as such right behind a number.
UNITS = (
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg lb lbs oz pound pounds ton tons tonne tonnes ml l litre litres "
    "liter liters gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "mph kmh hz khz mhz ghz kb mb gb tb w kw mw v a c f k percent degree degrees dollar dollars euro euros cent cents usd eur gbp"
).split()

#: Code points of scripts without spaces (Thai, Lao, Burmese, Khmer, kana, ideographs), and of marks beyond Latin and general punctuation.
UNSPACED = (
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17D3), (0x3005, 0x3007), (0x3040, 0x30FA), (0x30FC, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF),
    (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF),
)
MARKS = (
    (0x0964, 0x0965), (0x17D4, 0x17DA), (0x3000, 0x3004), (0x3008, 0x303F), (0x30FB, 0x30FB), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65),
)
WIDE_DIGITS = ((0xFF10, 0xFF19),)
#: Those of the marks that end sentences or open quotations (full stops, !, ?, :, ;, corner brackets).
WIDE_ENDS = ((0x0964, 0x0965), (0x17D4, 0x17D5), (0x3002, 0x3002), (0x300C, 0x300F), (0xFF01, 0xFF01), (0xFF0E, 0xFF0E), (0xFF1A, 0xFF1B), (0xFF1F, 0xFF1F), (0xFF61, 0xFF61))
OPERATORS = b"+-*/=^<>"

_BASE = np.uint64(0xD6E8FEB86659FD93)
_NUMBER, _UNIT, _NAME = (np.uint64(x) for x in (0x6E756D6265720001, 0x756E697400000002, 0x6E616D6500000003))


#: Kinds of bytes: none of a word, of a number, of a word, a sign between numbers, of a character that is a word.
_DIGIT, _LETTER, _SIGN, _UNSPACED = 1, 2, 3, 4


def _classes() -> tuple[np.ndarray, np.ndarray]:
    kind, ends = np.zeros(256, np.uint8), np.zeros(256, bool)
    kind[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
    kind[48:58] = _DIGIT
    ends[list(b".!?:;\n\r\"*#|-")] = True
    return kind, ends


_KIND, _ENDS = _classes()


def _within(points: np.ndarray, ranges: tuple[tuple[int, int], ...]) -> np.ndarray:
    out = np.zeros(len(points), bool)
    for a, b in ranges:
        out |= (points >= a) & (points <= b)
    return out


def _wide(data: np.ndarray, kind: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Set kinds and sentence ends of characters of three and four bytes in place; where characters begin that are words."""
    at = np.nonzero(data >= 0xE0)[0]
    begins = np.zeros(len(data), bool)
    if not len(at):
        return begins
    follow = [data[np.minimum(at + k, len(data) - 1)].astype(np.int64) & 63 for k in (1, 2, 3)]
    four = data[at] >= 0xF0
    points = np.where(four, 0, (data[at].astype(np.int64) & 15) << 12 | follow[0] << 6 | follow[1])
    points[four] = ((data[at].astype(np.int64) & 7) << 18 | follow[0] << 12 | follow[1] << 6 | follow[2])[four]
    for ranges, value in ((UNSPACED, _UNSPACED), (MARKS, 0), (WIDE_DIGITS, _DIGIT)):
        mine = _within(points, ranges)
        for k in range(4):
            some = at[mine] if k < 3 else at[mine & four]
            kind[np.minimum(some + k, len(data) - 1)] = value
        if value == _UNSPACED:
            begins[at[mine]] = True
    ends[at[_within(points, WIDE_ENDS)]] = True
    return begins


def _signs(data: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Where signs stand between numbers: behind a number or a closing bracket, or behind a word and before a number; a hyphen between numbers alone. Only spaces lie between."""
    at = np.nonzero(np.isin(data, np.frombuffer(OPERATORS, np.uint8)))[0]
    if not len(at):
        return at
    solid = np.nonzero(data != 32)[0]
    k = np.searchsorted(solid, at)
    before, after = solid[np.maximum(k - 1, 0)], solid[np.minimum(k + 1, len(solid) - 1)]
    rows = np.cumsum(edge[:-1])
    has_before, has_after = (k > 0) & (rows[before] == rows[at]), (k + 1 < len(solid)) & (rows[after] == rows[at])
    digit = lambda i: (data[i] >= 48) & (data[i] <= 57)
    number_before = has_before & (digit(before) | (data[before] == 41))
    number_after = has_after & (digit(after) | (data[after] == 40))
    word_before = has_before & ((_KIND[data[before]] > 0) | (data[before] == 41))
    return at[np.where(data[at] == 45, number_before & number_after, number_before | (word_before & number_after))]


def _unit_hashes() -> np.ndarray:
    data = np.frombuffer("".join(UNITS).encode(), np.uint8)
    ends = np.cumsum([len(u) for u in UNITS])
    return np.sort(span_hashes(data, ends - np.array([len(u) for u in UNITS]), ends))


class Tokens(NamedTuple):
    """Words of concatenated UTF-8 rows in lower-cased bytes: spans, row, hash, and whether each is a number, a unit, capitalised like a name, begins a sentence, or is a character of a script without spaces."""

    low: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    value: np.ndarray
    number: np.ndarray
    unit: np.ndarray
    capital: np.ndarray
    first: np.ndarray
    dense: np.ndarray


class Words(NamedTuple):
    """Template words: row, hash of the word or its placeholder, hash of its value, whether it is plain, begins a sentence, or is read as a name
    though it begins one, the number of its first word within its row, and whether it is a character of a script without spaces."""

    row: np.ndarray
    code: np.ndarray
    value: np.ndarray
    plain: np.ndarray
    first: np.ndarray
    switched: np.ndarray
    place: np.ndarray
    dense: np.ndarray


def tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    n = len(data)
    none, no = np.zeros(0, np.int64), np.zeros(0, bool)
    empty = Tokens(data, none, none, none, np.zeros(0, np.uint64), no, no, no, no, no)
    if not n:
        return empty
    before = np.concatenate([[np.uint8(0)], data[:-1]])
    upper = ((data >= 65) & (data <= 90)) | ((before == 0xC3) & (data >= 0x80) & (data <= 0x9E) & (data != 0x97))
    kind = _KIND[data]
    for lead in ((data == 0xC2), (data == 0xE2) & np.isin(np.append(data[1:], 0), (0x80, 0x81))):  # Latin and general punctuation
        at = np.nonzero(lead)[0]
        for k in range(3 if len(at) and data[at[0]] == 0xE2 else 2):
            kind[np.minimum(at + k, n - 1)] = 0
    stop = _ENDS[data]
    single = _wide(data, kind, stop)
    low = np.where(upper, data + 32, data)
    edge = np.zeros(n + 1, bool)
    edge[offsets[(offsets >= 0) & (offsets <= n)]] = True
    edge[n] = True
    signs = _signs(data, edge)
    kind[signs], single[signs] = _SIGN, True
    change = np.concatenate([[True], kind[1:] != kind[:-1]]) | edge[:-1] | single
    starts = np.nonzero(change)[0]
    ends = np.append(starts[1:], n)
    word = kind[starts] > 0
    starts, ends = starts[word], ends[word]
    if not len(starts):
        return empty
    row = np.searchsorted(offsets, starts, side="right") - 1
    value = span_hashes(low, starts, ends)
    stops = np.concatenate([[0], np.cumsum(stop)])
    first = np.ones(len(starts), bool)
    first[1:] = (row[1:] != row[:-1]) | (stops[starts[1:]] > stops[ends[:-1]])
    number = kind[starts] == _DIGIT
    follows = np.zeros(len(starts), bool)
    follows[1:] = number[:-1] & (row[1:] == row[:-1]) & ~number[1:]
    units = _unit_hashes()
    at = np.minimum(np.searchsorted(units, value), len(units) - 1)
    unit = follows & (units[at] == value)
    capital = upper[starts] | ((data[starts] == 0xC3) & upper[np.minimum(starts + 1, n - 1)])
    second = starts + 1 + (data[starts] == 0xC3)
    capitals = upper[np.minimum(second, n - 1)] & (second < ends)
    return Tokens(low, starts, ends, row, value, number, unit, capital & ~number & ~unit & ~capitals, first, kind[starts] == _UNSPACED)


def template(t: Tokens, named: bool | np.ndarray = False) -> Words:
    """Template words. Capitalised words that begin a sentence are plain, or names where ``named`` is true."""
    if not len(t.starts):
        return Words(t.row, t.value, t.value, t.number, t.first, t.first, t.row, t.dense)
    name = t.capital & (~t.first | named)
    code = np.select([t.number, t.unit, name], [_NUMBER, _UNIT, _NAME], t.value)
    plain = ~(t.number | t.unit | name)
    # neighbouring placeholders of one type become one, its value that of all of them
    begins = np.ones(len(t.starts), bool)
    begins[1:] = plain[1:] | (code[1:] != code[:-1]) | (t.row[1:] != t.row[:-1]) | t.first[1:]
    group = np.nonzero(begins)[0]
    last = np.append(group[1:], len(t.starts)) - 1
    several = last > group
    value = t.value[group]
    if several.any():
        value[several] = span_hashes(t.low, t.starts[group][several], t.ends[last][several])
    row = t.row[group]
    place = group - np.searchsorted(t.row, np.arange(row[-1] + 1))[row]
    return Words(row, code[group], value, plain[group], t.first[group], (name & t.first)[group], place, t.dense[group])


def windows(w: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each window of ``n`` template words within one row starts, its hash, and whether that is of its own words, since few are plain."""
    inside, h, own, plain = _spans(w, n)
    few = plain < min(MIN_PLAIN, n)
    return inside, mix(np.where(few, own + np.uint64(1), h) + np.uint64(n)), few


def _spans(w: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts of windows of ``n`` words within a row, hashes of their template words and of their values, and how many are plain."""
    count = len(w.row) - n + 1
    if count <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    weights = powers(_BASE, n)
    h, own = np.zeros(count, np.uint64), np.zeros(count, np.uint64)
    for k in range(n):
        h += w.code[k : k + count] * weights[k]
        own += w.value[k : k + count] * weights[k]
    words = np.concatenate([[0], np.cumsum(w.plain)])
    inside = np.nonzero(w.row[:count] == w.row[n - 1 :])[0]
    return inside, h[inside], own[inside], (words[n : n + count] - words[:count])[inside]


def long_windows(w: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Size, starts and hashes (none of their own words) of the windows that have MIN_PLAIN plain words only beyond WINDOW words: the shortest one from each start."""
    at = np.nonzero(w.plain)[0]
    before = np.cumsum(w.plain) - w.plain
    starts = np.nonzero(before + MIN_PLAIN <= len(at))[0]
    end = at[before[starts] + MIN_PLAIN - 1] if len(starts) else starts
    size = end - starts + 1
    ok = (size > WINDOW) & (size <= LONGEST)
    ok &= w.row[starts] == w.row[end]
    starts, size = starts[ok], size[ok]
    for n in np.unique(size):
        mine = starts[size == n]
        weights, h = powers(_BASE, int(n)), np.zeros(len(mine), np.uint64)
        for k in range(n):
            h += w.code[mine + k] * weights[k]
        yield int(n), mine, mix(h + np.uint64(n)), np.zeros(len(mine), bool)


def sentences(w: Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and hashes of the windows of ``n`` words that are whole sentences, all of their own words."""
    inside, _, own, _ = _spans(w, n)
    ends = np.append((w.row[1:] != w.row[:-1]) | w.first[1:], True) if len(w.row) else np.zeros(0, bool)
    whole = w.first[inside] & ends[inside + n - 1]
    return inside[whole], mix(own[whole] + np.uint64(2) + np.uint64(n)), whole[whole]


def _weights(w: Words, starts: np.ndarray, n: int) -> np.ndarray:
    """What each window says: 1, and half of that if all its words are characters."""
    upto = np.concatenate([[0], np.cumsum(w.dense)])
    return 1 - (upto[starts + n] - upto[starts]) / (2 * n)


def _slots(w: Words, starts: np.ndarray, n: int, own: np.ndarray) -> list[list[int]]:
    """The values behind the placeholders of each window; none of a window that is matched by its own words."""
    signed = w.value.view(np.int64)
    return [[] if o else [int(signed[i]) for i in range(s, s + n) if not w.plain[i]] for s, o in zip(starts, own, strict=True)]


def item_windows(bench: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, ipos, size, hash, islots, n_windows, weight``: the windows of each item; a short item is one window."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            out: list[tuple] = []
            t = tokens(data, offsets)
            head = np.ones(len(t.row), bool)  # in a document an item's first word may stand within a sentence, where it alone is a name
            head[1:] = t.row[1:] != t.row[:-1]
            for named in (False, True, head):
                w = template(t, named)
                count = np.bincount(w.row, minlength=len(offsets) - 1)
                for n, at, h, own in _all_windows(w, range(1, WINDOW + 1), named is not False, count):
                    size = count[w.row[at]]
                    mine = np.ones(len(at), bool) if n > WINDOW else size == n if n < WINDOW else size >= n
                    at, h = at[mine], h[mine]
                    of = w.row[at]
                    for i, k, x, s, y in zip(of, w.place[at], h.view(np.int64), _slots(w, at, n, own[mine]), _weights(w, at, n), strict=True):
                        out.append((batch.column(0)[int(i)].as_py(), int(k), n, int(x), s, max(1, int(count[i]) - WINDOW + 1), float(y)))
            columns = list(zip(*out, strict=True)) or [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["item_id", "ipos", "size", "hash", "islots", "n_windows", "weight"]
            )

    cut_all = bench.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(
        cut, "item_id long, ipos long, size int, hash long, islots array<long>, n_windows long, weight double"
    )
    return cut_all.distinct()


def _all_windows(
    w: Words, sizes: Iterable[int], switched: bool, count: np.ndarray | None = None
) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Size, starts, hashes and whether they are of their own words, of the windows of these sizes, and of the longer ones; if ``switched``, of those that hold a word that is read otherwise.

    A window of few words, or of few by what its characters say, is matched as a sentence; of items, whose words ``count`` gives, only so if it is the whole item.
    """
    upto = np.concatenate([[0], np.cumsum(w.switched)])

    def each() -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        for n in sizes:
            if n < MIN_WORDS:
                yield n, *sentences(w, n)
                continue
            at, h, own = windows(w, n)
            if w.dense.any():
                light = _weights(w, at, n) * n < MIN_WORDS
                if count is not None:
                    light &= count[w.row[at]] == n
                    at, h, own = at[~light], h[~light], own[~light]
                whole, sh, sown = sentences(w, n)
                few = _weights(w, whole, n) * n < MIN_WORDS
                if few.any():
                    yield n, whole[few], sh[few], sown[few]
            yield n, at, h, own

    for n, at, h, own in chain(each(), long_windows(w)):
        if switched:
            other = upto[at + n] > upto[at]
            at, h, own = at[other], h[other], own[other]
        yield n, at, h, own


def document_windows(docs: DataFrame, sizes: list[int], wanted: np.ndarray | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, dpos, hash, dslots``: the windows of the whole documents whose hash is among the sorted ``wanted`` (None: all)."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for a, b in slices(offsets):
                t = tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for named in (False, True) if sizes else ():
                    w = template(t, named)
                    for n, at, h, own in _all_windows(w, [n for n in sizes if n <= WINDOW], named):
                        if wanted is not None:
                            i = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                            hit = wanted[i] == h
                            at, h, own = at[hit], h[hit], own[hit]
                        if len(at):
                            ids = batch.column(0).take(pa.array(w.row[at] + a))
                            slots = pa.array(_slots(w, at, n, own), pa.list_(pa.int64()))
                            yield pa.RecordBatch.from_arrays(
                                [ids, pa.array(w.place[at]), pa.array(h.view(np.int64)), slots], ["doc_id", "dpos", "hash", "dslots"]
                            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(
        cut, "doc_id long, dpos long, hash long, dslots array<long>"
    )


def find_contamination(
    docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    coverage: float = COVERAGE, run: int = RUN,
) -> DataFrame:
    """``doc_id, item_id, n_matched, n_windows, coverage, verbatim``: each benchmark item that a document holds.

    ``n_matched`` counts different windows of the item in the occurrence that has the most, with consistent slots;
    ``verbatim`` is false where the document's numbers, units or names differ from the item's. Null and empty texts
    match nothing. Repeated rows of an id count as one document or item; a null id is an id. Empty tables give no
    rows. Other columns are not read.
    """
    items = materialize(item_windows(bench, item_col, item_text_col), "items")
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())
    hashes = items.select("hash").distinct()
    wanted = None
    if hashes.count() <= MAX_BROADCAST:
        wanted = np.sort(np.array([r[0] for r in hashes.toLocalIterator()], np.int64).view(np.uint64))
        if not len(wanted):
            sizes = []
    hits = document_windows(docs, sizes, wanted, id_col, text_col)
    met = materialize(
        hits.join(items, "hash").select("doc_id", "item_id", "ipos", (F.col("dpos") - F.col("ipos")).alias("at"), "islots", "dslots", "n_windows", "weight"), "met"
    )
    key = ["doc_id", "item_id", "at"]
    slots = met.select(*key, F.explode(F.arrays_zip("islots", "dslots")).alias("s")).select(*key, "s.islots", "s.dslots")
    torn = slots.groupBy(*key, "islots").agg(F.min("dslots").alias("x"), F.max("dslots").alias("y")).filter("x <> y").select(*key).distinct()
    torn = torn.select(*[F.col(k).alias(f"t_{k}") for k in key])
    whole = met.join(torn, [F.col(k).eqNullSafe(F.col(f"t_{k}")) for k in key], "left_anti")
    # alignments of one occurrence differ by what was put in or left out: they share one of two rows of bands
    bands = F.array(F.floor(F.col("at") / BAND) * 2, F.floor((F.col("at") + BAND // 2) / BAND) * 2 + 1)
    each = whole.select("doc_id", "item_id", "ipos", F.explode(bands).alias("band"), "n_windows", "weight", (F.col("islots") == F.col("dslots")).alias("same"))
    each = each.groupBy("doc_id", "item_id", "band", "ipos").agg(F.min("n_windows").alias("n_windows"), F.max("weight").alias("weight"), F.max("same").alias("same"))
    near = each.groupBy("doc_id", "item_id", "band").agg(
        F.count("*").alias("n_matched"), F.min("n_windows").alias("n_windows"), F.round(F.sum("weight"), 6).alias("weight"), F.min("same").alias("verbatim")
    )
    best = near.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_matched", "verbatim", "n_windows", "weight")).alias("x")).select("doc_id", "item_id", "x.*")
    # of an item of less than two windows of characters that are words, part says too little
    light = (F.col("n_windows") <= WINDOW) & (F.col("weight") < F.col("n_matched") * 0.75)
    enough = (F.col("coverage") >= F.when(light, F.lit(1.0)).otherwise(F.lit(coverage))) | (F.col("weight") >= run)
    share = F.least(F.lit(1.0), F.col("n_matched") / F.col("n_windows"))
    return best.select("doc_id", "item_id", "n_matched", "n_windows", share.alias("coverage"), "verbatim", "weight").filter(enough).drop("weight")


def drop_contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that hold a benchmark item, in all their columns, whatever their names. Rows without an id count as one document each, by their text."""
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    named = rows.filter("id is not null")
    # as a table their size is known, so that Spark need not shuffle the texts for a few ids
    gone = materialize(find_contamination(named, bench, "id").select(F.col("doc_id").alias("gone")).distinct(), "gone")
    kept = named.join(gone, F.col("id") == F.col("gone"), "left_anti").select("row.*")
    nameless = rows.filter("id is null").withColumn("hash", F.xxhash64("text"))
    if not nameless.limit(1).count():
        return kept
    gone = find_contamination(nameless, bench, "hash").select(F.col("doc_id").alias("gone")).distinct()
    return kept.unionByName(nameless.join(gone, F.col("hash") == F.col("gone"), "left_anti").select("row.*"))
