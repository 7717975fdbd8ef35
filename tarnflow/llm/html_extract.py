"""Main text of web pages by wrappers inferred from pages of one host.

A page is a tree of tokens: labels of blocks, and texts. Trees of one host are aligned one after
another: what both have is matched, what only one has becomes an optional item, neighbours (or runs of
several labels in turn) that match each other fold into a repeated one. The outcome, a regular
expression without unions, is the host's wrapper. Each text of a page is then matched to one slot of
it, and slots tell the article from the rest: slots of links that are the same on different pages are
the template's, and where a page does not mark its article, so are all slots of links and all constant ones.
"""

from __future__ import annotations

import functools
import html as entities
import json
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.common import materialize

#: Wrappers are broadcast if they take no more than this; beyond it they are joined by host.
MAX_BROADCAST_BYTES = 32_000_000
#: Parts over which the pages of one host are spread in that join.
SALTS = 16
#: A slot whose text is the same on so many different pages of a host, and on no page another, is the template's.
CONSTANT_PAGES = 5
#: Labels of a path beyond so many become one, named by a hash of them all.
DEPTH = 40
#: Wrappers of a host that one task aligns.
AT_ONCE = 64
#: Labels that may take turns in one repeated group.
PERIOD = 6
#: Cells of a full alignment table; longer lists are first cut at labels that each has once.
CELLS = 250_000

#: HTML elements that make blocks, that have no end tag, whose content is no text, and that are no part of an article.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html iframe legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = "script|style|noscript|template|svg|math|iframe|object|textarea|select|button"
OUTSIDE = frozenset("head title nav footer aside form dialog menu".split())
#: Words in a class, id or role that mark what is no part of an article, and what is.
OUTSIDE_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar side nav navbar navigation menu footer header masthead "
    "topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay comment comments disqus reply replies respond discussion share sharing social "
    "related recommended breadcrumb breadcrumbs newsletter subscribe subscription signup login widget pagination pager complementary contentinfo search hidden".split()
)
INSIDE_WORDS = frozenset("content article post entry story main body text".split())
REPLY_WORDS = frozenset("comment comments reply replies respond discussion".split())
#: First and last words of a compound name that say what is absent or beside.
PREFIXES = frozenset("has with without no not is js".split())
SUFFIXES = frozenset("free off none".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({SKIPPED})\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)/?>|<[!?/][^>]*>|<[a-zA-Z!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SPLIT = re.compile(r"[^a-z]+")
#: What a start tag ends that is still open above it.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "body": {"head", "title"}}

#: Regions of a page: outside the article, unmarked, in a part named as content, in <main>, in <article>, in an <article> that looks like a reader's reply.
OUT, PLAIN, NAMED, MAIN, ARTICLE, REPLY = -1, 0, 1, 2, 3, 4


class Block(NamedTuple):
    """A text with its path of labels, region, number of its article (0: none), and characters within links; an outside part is one block without text."""

    path: tuple[str, ...]
    region: int
    article: int
    text: str
    linked: int


class Marks(NamedTuple):
    label: str
    outside: bool
    inside: bool
    reply: bool


@functools.lru_cache(65536)
def marks(tag: str, attributes: str) -> Marks:
    """Label of a tag (with the words of its class, id and role) and what they say; whole names count before words of compounds."""
    names = {n for m in _NAMED.finditer(attributes) for n in (m[1] or m[2] or m[3] or "").lower().split()} if attributes else set()
    parts = [[w for w in _SPLIT.split(n) if w] for n in names]
    words = {w for p in parts for w in p if len(w) > 1}
    compound = {w for p in parts if len(p) > 1 and p[0] not in PREFIXES and p[-1] not in SUFFIXES for w in p}
    whole = {p[0] for p in parts if len(p) == 1}
    outside = bool(whole & OUTSIDE_WORDS) and not (whole & INSIDE_WORDS and whole & OUTSIDE_WORDS <= {"header"})
    outside |= bool(compound & OUTSIDE_WORDS) and not whole & INSIDE_WORDS
    return Marks(".".join([tag, *sorted(words)]), outside, bool((whole | compound) & INSIDE_WORDS), bool((whole | compound) & REPLY_WORDS))


def _region(tag: str, m: Marks, above: int) -> int:
    """The region of an element within one of region ``above``."""
    if above == OUT or tag in OUTSIDE:
        return OUT
    if tag == "article":
        return REPLY if above in (ARTICLE, REPLY) or m.reply else ARTICLE
    if tag == "main":
        return max(above, MAIN)
    if tag in ("html", "body"):
        return above
    if tag == "header" or (tag not in HEADINGS and m.outside):
        named_header = above > PLAIN and (tag == "header" or "header" in m.label.split(".")) and not {*m.label.split(".")[1:]} & (OUTSIDE_WORDS - {"header"})
        return above if named_header else OUT
    return max(above, NAMED) if m.inside and tag in ("div", "section", "td") else above


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, references decoded and white space turned into one space."""
    out: list[Block] = []
    tags: list[str] = []
    labels: list[str] = []
    regions: list[int] = []
    articles: list[int] = []
    hashes: list[int] = []
    open_tags: dict[str, int] = {}
    held: list[str] = []
    at = linked = count = 0
    in_link = False

    def path() -> tuple[str, ...]:
        return (*labels[:DEPTH], f"~{hashes[-1]:x}") if len(labels) > DEPTH else tuple(labels)

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                out.append(Block(path(), regions[-1] if regions else PLAIN, articles[-1] if articles else 0, text, min(linked, len(text))))
            held.clear()
        linked = 0

    def close(i: int) -> None:
        for t in tags[i:]:
            open_tags[t] -= 1
        for x in (tags, labels, regions, articles, hashes):
            del x[i:]

    for m in _TOKEN.finditer(page):
        if m.start() > at and not (regions and regions[-1] == OUT):
            held.append(page[at : m.start()])
            if in_link:
                linked += m.start() - at
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag not in BLOCKS:
            if tag == "br":
                held.append(" ")
            elif tag == "a":
                in_link = not m[2]
            continue
        flush()
        if tag in VOID:
            continue
        if m[2]:
            if open_tags.get(tag):
                close(len(tags) - 1 - tags[::-1].index(tag))
            continue
        if tags and tags[-1] == "p":
            close(len(tags) - 1)
        while tags and tags[-1] in _ENDS.get(tag, ()):
            close(len(tags) - 1)
        mark = marks(tag, m[4] or "")
        above = regions[-1] if regions else PLAIN
        region = _region(tag, mark, above)
        if tag == "article" and region != OUT:
            count += 1
        tags.append(tag)
        labels.append(mark.label)
        regions.append(region)
        articles.append(count if tag == "article" else articles[-1] if articles else 0)
        hashes.append(zlib.crc32(mark.label.encode(), hashes[-1] if hashes else 0))
        open_tags[tag] = open_tags.get(tag, 0) + 1
        if region == OUT != above:
            out.append(Block(path(), OUT, 0, "", 0))
    if not (regions and regions[-1] == OUT):
        held.append(page[at:])
    flush()
    return out


# A page's node is (label, nodes); a text is ("#", its number). A wrapper's item is [label, optional, repeated, items];
# a text slot has the label "#" and no items, a group of several labels in turn the label "(a|b)" and an item for each.


def page_tree(paths: list[tuple[str, ...]], texts: list[bool]) -> list:
    """The nodes of a page from the paths of its blocks; each text is a block of its own."""
    root: list = []
    for i, path in enumerate(paths):
        nodes = root
        for k, label in enumerate(path):
            if not nodes or nodes[-1][0] != label or k == len(path) - 1:
                nodes.append((label, []))
            nodes = nodes[-1][1]
        if texts[i]:
            nodes.append(("#", i))
    return root


def _group_label(items: list) -> str:
    return "(" + "|".join(x[0] for x in items) + ")"


def _merge_items(items: list) -> list:
    """One item for several of one label that follow each other or stand for each other."""
    first, children = items[0], items[0][3]
    for x in items[1:]:
        children = children if children == x[3] else _positions(children, x[3]) if first[0][0] == "(" else align(children, x[3])
    return children


def _positions(a: list, b: list) -> list:
    return [[x[0], x[1] or y[1], x[2] or y[2], _merge_items([x, y])] for x, y in zip(a, b, strict=True)]


def _fold(items: list) -> list:
    """Neighbours of one label become a repeated item; labels that take turns (two full turns at least) become a repeated group."""
    out, i = [], 0
    while i < len(items):
        j = i + 1
        while j < len(items) and items[j][0] == items[i][0]:
            j += 1
        run = items[i:j]
        out.append(run[0] if len(run) == 1 else [run[0][0], all(x[1] for x in run), True, _merge_items(run)])
        i = j
    for k in range(2, PERIOD + 1):
        labels, folded, i = [x[0] for x in out], [], 0
        while i < len(out):
            j = i
            while j + 2 * k <= len(out) and labels[j : j + k] == labels[j + k : j + 2 * k]:
                j += k
            if j > i and len(set(labels[i : i + k])) == k:
                turns = [out[s : s + k] for s in range(i, j + k, k)]
                folded.append(["(" + "|".join(labels[i : i + k]) + ")", all(x[1] for t in turns for x in t), True, functools.reduce(_positions, turns)])
                i = j + k
            else:
                folded.append(out[i])
                i += 1
        out = folded
    return out


def _turns(labels: list[str], pattern: list[str]) -> Iterator[tuple[int, int]]:
    """Start and end of the stretches in which the labels of a group take turns."""
    i, k = 0, len(pattern)
    while i + k <= len(labels):
        j = i
        while labels[j : j + k] == pattern:
            j += k
        if j > i:
            yield i, j
        i = max(j, i + 1)


def _grouped(items: list, groups: list[str]) -> list:
    """Items with the stretches that are turns of a group of the other side made such a group."""
    for label in groups:
        pattern = label[1:-1].split("|")
        out, at, k = [], 0, len(pattern)
        for i, j in _turns([x[0] for x in items], pattern):
            turns = [items[s : s + k] for s in range(i, j, k)]
            out += items[at:i] + [[label, all(x[1] for t in turns for x in t), len(turns) > 1, functools.reduce(_positions, turns)]]
            at = j
        items = out + items[at:]
    return items


def _group_labels(*sides: list) -> list[str]:
    return sorted({x[0] for side in sides for x in side if x[0][0] == "(" and "(" not in x[0][1:]}, key=lambda g: (-g.count("|"), g))


def matched(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of a longest common subsequence; of lists too long for a table, one through labels that both have once."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    head = [(i, i) for i in range(start)]
    tail = [(len(a) - end + i, len(b) - end + i) for i in range(end)]
    x, y = a[start : len(a) - end], b[start : len(b) - end]
    if not x or not y:
        return head + tail
    if len(x) * len(y) <= CELLS:
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x) - 1, -1, -1):
            row, below, label = best[i], best[i + 1], x[i]
            for j in range(len(y) - 1, -1, -1):
                row[j] = below[j + 1] + 1 if label == y[j] else max(below[j], row[j + 1])
        middle, i, j = [], 0, 0
        while i < len(x) and j < len(y):
            if x[i] == y[j]:
                middle.append((i, j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    else:
        middle = _anchored(x, y)
    return head + [(start + i, start + j) for i, j in middle] + tail


def _anchored(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Matches through labels that both lists have once, in rising order; without any, each label meets its next place on the other side."""
    at = [{l: i for i, l in enumerate(s)} for s in (x, y)]
    once = [{l for l, n in _counts(s).items() if n == 1} for s in (x, y)]
    anchors, last = [], -1
    for l in sorted(once[0] & once[1], key=at[0].get):
        if at[1][l] > last:
            last = at[1][l]
            anchors.append((at[0][l], last))
    if not anchors:
        places: dict[str, list[int]] = {}
        for j in range(len(y) - 1, -1, -1):
            places.setdefault(y[j], []).append(j)
        out, last = [], -1
        for i, l in enumerate(x):
            next_places = places.get(l, [])
            while next_places and next_places[-1] <= last:
                next_places.pop()
            if next_places and next_places[-1] - last <= max(64, len(y) // 16):  # a far jump would leave too much behind
                last = next_places.pop()
                out.append((i, last))
        return out
    out, i, j = [], 0, 0
    for p, q in [*anchors, (len(x), len(y))]:
        out += [(i + s, j + t) for s, t in matched(x[i:p], y[j:q])]
        if p < len(x):
            out.append((p, q))
        i, j = p + 1, q + 1
    return out


def _counts(labels: list[str]) -> dict[str, int]:
    out: dict[str, int] = {}
    for l in labels:
        out[l] = out.get(l, 0) + 1
    return out


def align(a: list, b: list) -> list:
    """Items without unions that cover both: a common subsequence is matched, the rest is optional."""
    if a == b:
        return a
    groups = _group_labels(a, b)
    a, b = _grouped(a, groups), _grouped(b, groups)
    out, i, j = [], 0, 0
    for p, q in [*matched([x[0] for x in a], [x[0] for x in b]), (len(a), len(b))]:
        out += [[x[0], True, *x[2:]] for x in a[i:p]] + [[x[0], True, *x[2:]] for x in b[j:q]]
        if p < len(a):
            out.append([a[p][0], a[p][1] or b[q][1], a[p][2] or b[q][2], _merge_items([a[p], b[q]])])
        i, j = p + 1, q + 1
    return _fold(out)


def page_items(nodes: list) -> list:
    """The wrapper of one page."""
    return _fold([[label, False, False, [] if label == "#" else page_items(below)] for label, below in nodes])


def numbered(items: list, start: int = 0) -> int:
    """Give each text slot of a wrapper its number, as a fifth value, in order; the next number."""
    for x in items:
        if x[0] == "#":
            x.append(start)
            start += 1
        else:
            start = numbered(x[3], start)
    return start


def slots_of(nodes: list, items: list, out: dict[int, int]) -> None:
    """The slot of each text of a page, by its number, from a wrapper with numbered slots. A text that the wrapper does not foresee has none."""
    runs: list[tuple[str, list]] = []
    for node in nodes:
        if runs and runs[-1][0] == node[0]:
            runs[-1][1].append(node)
        else:
            runs.append((node[0], [node]))
    for label in _group_labels(items):
        pattern = label[1:-1].split("|")
        taken, at, k = [], 0, len(pattern)
        for i, j in _turns([r[0] for r in runs], pattern):
            taken += runs[at:i] + [(label, [[n for r in runs[i + t : j : k] for n in r[1]] for t in range(k)])]
            at = j
        runs = taken + runs[at:]
    for p, q in matched([r[0] for r in runs], [x[0] for x in items]):
        (label, found), item = runs[p], items[q]
        pairs = zip(found, item[3], strict=True) if label[0] == "(" else [(found, item)]
        for mine, x in pairs:
            for node in mine:
                if node[0] == "#":
                    out[node[1]] = x[4]
                else:
                    slots_of(node[1], x[3], out)


def choose(regions: list[int], articles: list[int], headings: list[bool], sizes: list[int], template: list[bool]) -> list[bool]:
    """Which texts of a page are its article.

    Texts of articles, but not those of replies: nested articles, articles named so, and articles without a heading
    behind one with a heading and more. With them the page's first heading in its main part, or all of that part if
    it holds more than its articles. Else the main part, else parts named as content, else all. Never what is the template's.
    """
    n = range(len(regions))
    regions = [OUT if t else r for r, t in zip(regions, template, strict=True)]
    if ARTICLE not in regions:
        regions = [ARTICLE if r == REPLY else r for r in regions]
    headed = {articles[i] for i in n if regions[i] == ARTICLE and headings[i]} & {articles[i] for i in n if regions[i] == ARTICLE and not headings[i]}
    with_heading = {articles[i] for i in n if regions[i] == ARTICLE and headings[i]}
    regions = [OUT if r == ARTICLE and headed and articles[i] > min(headed) and articles[i] not in with_heading else r for i, r in enumerate(regions)]
    size = {r: sum(sizes[i] for i in n if regions[i] == r) for r in (NAMED, MAIN, ARTICLE)}
    if size[ARTICLE]:
        if size[MAIN] > size[ARTICLE]:
            return [r in (MAIN, ARTICLE) for r in regions]
        first = next((i for i in n if regions[i] == ARTICLE), len(regions))
        return [r == ARTICLE or (r == MAIN and headings[i] and i < first) for i, r in enumerate(regions)]
    for r in (MAIN, NAMED):
        if size[r]:
            return [x == r for x in regions]
    return [r == PLAIN for r in regions]


_PARSED = "page_id long, url string, host string, page long, paths array<string>, regions array<int>, articles array<int>, texts array<string>, linked array<int>, wrapper string"


def _parsed(pages: DataFrame) -> DataFrame:
    """The blocks of each page, a hash of its content, and the wrapper of the page alone."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for page in batch.column(4):
                got = blocks(page.as_py() or "")
                paths = ["/".join(b.path) for b in got]
                shape = json.dumps(page_items(page_tree([b.path for b in got], [bool(b.text) for b in got])), separators=(",", ":"))
                found.append((paths, [b.region for b in got], [b.article for b in got], [b.text for b in got], [b.linked for b in got], shape))
            columns = list(zip(*found, strict=True)) or [[]] * 6
            kinds = (pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.string())
            new = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *new], ["page_id", "url", "host", "page", "paths", "regions", "articles", "texts", "linked", "wrapper"])

    return pages.select("page_id", "url", "host", F.xxhash64("html").alias("page"), "html").mapInArrow(parse, _PARSED)


def _merged(rows: pd.DataFrame) -> pd.DataFrame:
    items = functools.reduce(align, (json.loads(w) for w in sorted(rows["wrapper"])))
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "wrapper": [json.dumps(items, separators=(",", ":"))]})


def infer_wrappers(shapes: DataFrame) -> DataFrame:
    """``host, wrapper``: one wrapper for each host of ``host, wrapper`` rows, aligned about AT_ONCE at a time in parts by hash, then the outcomes in turn.

    Parts and their order depend on the wrappers alone, so the outcome does not depend on how rows lie.
    """
    level = shapes.select("host", "wrapper").distinct()
    while True:
        level = materialize(level, "wrappers")
        most = level.groupBy("host").count().agg(F.coalesce(F.max("count"), F.lit(0))).head()[0]
        if most <= 1:
            return level
        parts = -(-most // AT_ONCE)
        level = level.withColumn("part", F.pmod(F.xxhash64("wrapper"), F.lit(parts))).groupBy("host", "part").applyInPandas(_merged, "host string, wrapper string")


class _Matcher:
    """Slots of pages by wrapper, with the last wrappers kept ready."""

    def __init__(self) -> None:
        self.known: dict[str, list] = {}

    def slots(self, wrapper: str, paths: list[str], texts: list[str]) -> list[int]:
        if wrapper not in self.known:
            if len(self.known) > 2_000:
                self.known.clear()
            self.known[wrapper] = json.loads(wrapper)
            numbered(self.known[wrapper])
        out: dict[int, int] = {}
        slots_of(page_tree([tuple(p.split("/")) if p else () for p in paths], [bool(t) for t in texts]), self.known[wrapper], out)
        return [out.get(i, -1) for i in range(len(paths))]


def _slot_facts(parsed: DataFrame) -> DataFrame:
    """``host, slot, region, low, high, pages, size, linked``: least and greatest hash of a slot's texts, up to CONSTANT_PAGES pages, characters, and those in links."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, held = _Matcher(), {}
        for batch in batches:
            for row in batch.select(["host", "page", "paths", "regions", "texts", "linked", "wrapper"]).to_pylist():
                marked = max(row["regions"], default=OUT) > PLAIN
                of: dict[int, list] = {}
                slots = matcher.slots(row["wrapper"], row["paths"], row["texts"])
                for slot, region, text, linked in zip(slots, row["regions"], row["texts"], row["linked"], strict=True):
                    if text and (region > PLAIN or not marked):
                        x = of.setdefault(slot, [0, 0, 0, region])
                        x[0], x[1], x[2] = zlib.crc32(text.encode("utf-8", "replace"), x[0]), x[1] + len(text), x[2] + linked
                for slot, (value, size, linked, region) in of.items():
                    fact = held.setdefault((row["host"], slot), [value, value, set(), 0, 0, region])
                    fact[0], fact[1], fact[3], fact[4] = min(fact[0], value), max(fact[1], value), fact[3] + size, fact[4] + linked
                    if len(fact[2]) < CONSTANT_PAGES:
                        fact[2].add(row["page"])
            if len(held) > 200_000:
                yield out(held)
        yield out(held)

    def out(held: dict) -> pa.RecordBatch:
        rows = [(h, s, region, low, high, sorted(pages), size, linked) for (h, s), (low, high, pages, size, linked, region) in held.items()]
        held.clear()
        columns = list(zip(*rows, strict=True)) or [[]] * 8
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64())
        names = ["host", "slot", "region", "low", "high", "pages", "size", "linked"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return parsed.mapInArrow(gather, "host string, slot int, region int, low long, high long, pages array<long>, size long, linked long")


def template_slots(facts: DataFrame) -> DataFrame:
    """``host, slots``: the template's slots. They are constant over CONSTANT_PAGES different pages or more, or links for the most part; in marked regions, both."""
    facts = materialize(facts, "facts")
    pages = facts.select("host", "slot", F.explode("pages").alias("page")).distinct().groupBy("host", "slot").agg(F.count("*").alias("n"))
    sums = facts.groupBy("host", "slot").agg(
        F.max("region").alias("region"), (F.min("low") == F.max("high")).alias("same"), (F.sum("linked") * 2 > F.sum("size")).alias("menu")
    )
    constant = F.col("same") & (F.col("n") >= CONSTANT_PAGES)
    both = sums.join(pages, ["host", "slot"]).filter((F.col("slot") >= 0) & F.when(F.col("region") > PLAIN, F.col("menu") & constant).otherwise(F.col("menu") | constant))
    return both.groupBy("host").agg(F.array_sort(F.collect_list("slot")).alias("slots"))  # no more than a wrapper has


def _with_wrappers(rows: DataFrame, wrappers: DataFrame, small: bool, how: str = "inner") -> DataFrame:
    """Rows with what their host has: by broadcast, or spread over parts of a host."""
    if small:
        return rows.join(F.broadcast(wrappers), "host", how)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url", "page"), F.lit(SALTS)).cast("int")).join(wrappers.withColumn("salt", salts), ["host", "salt"], how)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for every row: the main text of each whole page, blocks joined by two line ends.

    A null page is empty and has an empty text. Pages without a host are one host. The wrapper is the
    same for all pages of a host, whatever their order. Repeated rows give a row each and count as one
    page; an empty table gives none; other columns are not read.
    """
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col).cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), host.alias("host"))
    parsed = materialize(_parsed(rows), "blocks")
    wrappers = infer_wrappers(parsed)
    small = wrappers.agg(F.coalesce(F.sum(F.length("wrapper") + F.length("host")), F.lit(0))).head()[0] <= MAX_BROADCAST_BYTES
    columns = ["page_id", "url", "host", "page", "paths", "regions", "articles", "texts", "linked"]
    both = _with_wrappers(parsed.select(columns), wrappers, small)
    template = materialize(template_slots(_slot_facts(both)), "template")
    both = _with_wrappers(both.select(*columns, "wrapper"), template, small, "left")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _Matcher()
        for batch in batches:
            texts = []
            for row in batch.select(["paths", "regions", "articles", "texts", "wrapper", "slots"]).to_pylist():
                dropped = {*(row["slots"] or ())}
                slots = matcher.slots(row["wrapper"], row["paths"], row["texts"]) if dropped else []
                template = [s in dropped for s in slots] or [False] * len(row["texts"])
                headings = [p.rsplit("/", 1)[-1].split(".", 1)[0] in HEADINGS for p in row["paths"]]
                kept = choose(row["regions"], row["articles"], headings, [len(t) for t in row["texts"]], template)
                texts.append("\n\n".join(t for t, k in zip(row["texts"], kept, strict=True) if k and t))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    return both.select("page_id", "url", "paths", "regions", "articles", "texts", "wrapper", "slots").mapInArrow(extract, "page_id long, url string, text string, n_chars long")
