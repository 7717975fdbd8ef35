"""Chunks of long texts, sections of pages, tables as text: Arrow functions over rows where they lie."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split_overlap(text: str, most: int = 1800, overlap: int = 160, least: int = 80) -> list[str]:
    """Windows of ``most`` characters that share ``overlap``; a window ends at a paragraph or sentence in its second half if there is one.

    A window of fewer than ``least`` characters is left out only if the one before holds all of it.
    """
    out, start, n, least = [], 0, len(text), min(least, overlap)
    while start < n:
        end = min(start + most, n)
        if end < n:
            half = start + most // 2
            for mark in ("\n\n", "\n", "。", ". ", "! ", "? "):
                at = text.rfind(mark, half, end)
                if at >= 0:
                    end = at + len(mark)
                    break
        piece = text[start:end].strip()
        if len(piece) > least or (piece and not out):
            out.append(piece)
        if end >= n:
            break
        start = max(end - overlap, start + 1)
    return out


def split_soft(text: str, most: int = 4000) -> list[str]:
    """Paragraphs packed into chunks of at most ``most`` characters; longer paragraphs are cut at sentences, and longer sentences as they come."""
    units: list[tuple[str, str]] = []  # what stands before a unit, and the unit
    for paragraph in re.split(r"\n\s*\n", text):
        paragraph, before = paragraph.strip(), "\n\n"
        for sentence in re.split(r"(?<=[.!?。！？])(?=\s)", paragraph) if len(paragraph) > most else [paragraph]:
            for i in range(0, len(sentence), most):
                units.append((before, sentence[i : i + most]))
                before = ""
    out: list[str] = []
    for before, u in units:
        if out and len(out[-1]) + len(before) + len(u) <= most:
            out[-1] += before + u
        elif u.strip():
            out.append(u.lstrip())
    return out


#: Bytes of texts that a step turns into Python strings at once, one text at least.
_STEP = 1 << 20


def _steps(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in slices of about ``_STEP`` bytes of ``column``."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, before + _STEP, side="right")))
            yield batch.slice(start, end - start)
            start = end


def chunk_texts(docs: DataFrame, id_col: str, text_col: str, how: str = "overlap", keep: Sequence[str] = (), lengths: bool = False, **sizes: int) -> DataFrame:
    """``id, part, chunk`` of whole texts by ``overlap`` or ``soft`` splitting, and the columns ``keep``. Null texts have no chunks.

    With ``lengths`` there is ``n_chars`` instead of ``chunk``. A task holds the chunks of a slice of its rows.
    """
    split = {"overlap": split_overlap, "soft": split_soft}[how]
    names = ["id", *keep]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _steps(batches, "text"):
            chunks = [split(t, **sizes) if t is not None else [] for t in rows.column("text").to_pylist()]
            at = np.repeat(np.arange(len(chunks)), [len(c) for c in chunks])
            parts = pa.array([i for c in chunks for i in range(len(c))], pa.int64())
            values = pa.array([len(x) for c in chunks for x in c], pa.int64()) if lengths else pa.array([x for c in chunks for x in c], pa.string())
            own = [rows.column(n).take(pa.array(at)) for n in names]
            yield pa.RecordBatch.from_arrays([*own, parts, values], [*names, "part", "n_chars" if lengths else "chunk"])

    kinds = [f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, [id_col, *keep], strict=True)]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *keep)
    return rows.mapInArrow(cut, ", ".join([*kinds, "part long", "n_chars long" if lengths else "chunk string"])).select("id", "part", "n_chars" if lengths else "chunk", *keep)


class _Sections(HTMLParser):
    """Title (first h1, else title tag) and the text under each h2 and h3."""

    def __init__(self) -> None:
        super().__init__()
        self.title, self.h1, self.sections = "", "", [["", 0, []]]
        self._in: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style", "noscript", "title", "h1", "h2", "h3"):
            self._in.append(tag)
        if tag in ("h2", "h3"):
            self.sections.append(["", int(tag[1]), []])
        elif tag in ("p", "li", "tr", "pre", "td"):
            self.sections[-1][2].append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in self._in:
            del self._in[self._in.index(tag) :]

    def handle_data(self, data: str) -> None:
        where = self._in[-1] if self._in else ""
        if where == "title":
            self.title += data
        elif where == "h1":
            self.h1 += data
        elif where in ("h2", "h3"):
            self.sections[-1][0] += data
        elif not where:
            self.sections[-1][2].append(data)


def page_sections(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """``id, title, pos, heading, level, content``: a lead section, then one per h2 or h3; scripts and styles are left out."""

    kind = pages.schema[id_col].dataType.simpleString()
    names = ["title", "pos", "heading", "level", "content"]
    types = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _steps(batches, "html"):
            at, out = [], []
            for row, (key, html) in enumerate(zip(rows.column("name").to_pylist(), rows.column("html").to_pylist(), strict=True)):
                p = _Sections()
                p.feed(html or "")
                p.close()
                clean = lambda s: " ".join(s.split())
                title = clean(p.h1) or clean(p.title) or key
                for i, (heading, level, parts) in enumerate(p.sections):
                    at.append(row)
                    out.append((title, i, clean(heading), level, "\n".join(x for x in map(clean, "".join(parts).split("\n")) if x)))
            columns = [pa.array([r[i] for r in out], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([rows.column("id").take(pa.array(at, pa.int64())), *columns], ["id", *names])

    rows = pages.select(F.col(id_col).alias("id"), F.col(id_col).cast("string").alias("name"), F.col(html_col).alias("html"))
    return rows.mapInArrow(cut, f"id {kind}, title string, pos int, heading string, level int, content string")


def toc_leaves(rows: DataFrame, doc: str, pos: str, level: str, title: str, levels: int) -> DataFrame:
    """Entries of contents tables with no deeper entry right behind them, with ``path``: the titles from the outermost down to their own.

    An ancestor at depth k is the last entry before at k or above, if that is at k itself. Levels count from 1 to ``levels``;
    a null title is empty. All windows share one sort by document.
    """
    w = Window.partitionBy(doc).orderBy(pos)
    before, here = w.rowsBetween(Window.unboundedPreceding, -1), F.trim(F.coalesce(F.col(title), F.lit("")))
    last = {k: F.last(F.when(F.col(level) <= k, F.struct(F.col(level).alias("level"), here.alias("title"))), ignorenulls=True).over(before) for k in range(1, levels)}
    out = rows.withColumns({"__next": F.lead(level).over(w), **{f"__up{k}": v for k, v in last.items()}})
    above = [F.when((F.col(level) > k) & (F.col(f"__up{k}.level") == k), F.col(f"__up{k}.title")) for k in last]
    leaf = F.col("__next").isNull() | (F.col("__next") <= F.col(level))
    return out.filter(leaf).withColumn("path", F.concat_ws("/", *above, here)).drop("__next", *[f"__up{k}" for k in last])


def department(title: Column, key: Column, marker: str, names: dict[str, str], other: str) -> Column:
    """The title up to a marker; where nothing is left, the name that belongs to the key."""
    head = F.trim(F.element_at(F.split(title, marker, 2), 1))
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.nullif(head, F.lit("")), F.try_element_at(known, key), F.lit(other))


def clean_lines(c: Column, boilerplate: str = r"(?i)^\s*(?:page\s+)?\d+\s*(?:/\s*\d+)?\s*$") -> Column:
    """A text without lines of page numbers, and without short lines that repeat the one before."""
    lines = F.filter(F.split(c, "\n"), lambda x: ~x.rlike(boilerplate))
    # index i counts from 0 and places from 1: place i is the line before
    same = lambda x, i: (F.length(x) <= 40) & (i > 0) & x.eqNullSafe(F.try_element_at(lines, F.greatest(i, F.lit(1))))
    kept = F.filter(lines, lambda x, i: ~same(x, i))
    return F.array_join(kept, "\n")


def markdown_table(cells: Column) -> Column:
    """Rows of cells as a markdown table; bars are escaped, nulls are empty, the first row is the head."""
    row = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda x: F.replace(F.coalesce(x, F.lit("")), F.lit("|"), F.lit("\\|"))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size(F.element_at(cells, 1))))
    return F.array_join(F.concat(F.array(row(F.element_at(cells, 1)), rule), F.transform(F.slice(cells, 2, F.size(cells)), row)), "\n")
