"""Sections of paged documents between the titles of their contents table, and the pages that spans of text lie on."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.operators.chunking import split_soft
from tarnflow.session import safe_unions

#: What stands between two pages of a document.
PAGE_BREAK = "\n\n"
# Ticked boxes of report forms that say nothing, the longer forms first.
PLACEHOLDERS = (r"□\s*适用\s*√\s*不适用", r"√\s*适用\s*□\s*不适用", r"□\s*适用", r"√\s*不适用", "不适用", r"□\s*是\s*√\s*否", r"√\s*是\s*□\s*否")


def match_titles(full: str, starts: Sequence[int], titles: Sequence[tuple[str | None, int | None]]) -> list[tuple[int, int] | None]:
    """Where each title stands in ``full`` (start, and where its section's text begins), or None.

    White space counts neither in titles nor in the text. A title is looked for behind the one found before; failing that,
    from the start of its hinted page (from 1) on. One that isn't found moves nothing; one found by its hint sets the place
    from which later ones are looked for.
    """
    there = np.array([not c.isspace() for c in full], bool)
    places = np.append(np.flatnonzero(there), len(full))
    plain = "".join(full.split())
    out: list[tuple[int, int] | None] = []
    at = 0
    for title, hint in titles:
        key = "".join((title or "").split())
        found = plain.find(key, at) if key else -1
        page = max((hint or 1) - 1, 0)
        if key and found < 0 and page < len(starts):
            found = plain.find(key, int(np.searchsorted(places, starts[page])))
        if found < 0:
            out.append(None)
            continue
        at = found + len(key)
        out.append((int(places[found]), int(places[at])))
    return out


def sections_of(pages: Sequence[str | None], titles: Sequence[tuple[str | None, int | None]], least: int = 30, least_said: int = 20) -> list[tuple[int, int, int, str]]:
    """``(number of the title, first page, last page, text)`` for each title with a section that says something."""
    pages = [(p or "").strip() + PAGE_BREAK for p in pages]
    full = "".join(pages)
    starts = np.cumsum([0, *map(len, pages)])
    found = match_titles(full, starts[:-1].tolist(), titles)
    out, end = [], len(full)
    for i in range(len(titles) - 1, -1, -1):
        if found[i] is None:
            continue
        begin = found[i][1]
        text = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", full[begin:end])).strip()
        said = "".join(re.sub("|".join(PLACEHOLDERS), "", text).split())
        if len(text) >= least and len(said) >= least_said:
            on = np.searchsorted(starts[:-1], [begin, max(begin, end - 1)], side="right")
            out.append((i, int(on[0]), int(on[1]), text))
        end = found[i][0]
    return out[::-1]


def cut_sections(pages: DataFrame, leaves: DataFrame, doc: str, page: str, text: str, pos: str, path: str, title: str, hint: str, **sizes: int) -> DataFrame:
    """``doc, pos, path, title, page_start, page_end, text``: the text between each title of a contents table and the next one found.

    ``pages`` has a row per page, ``leaves`` one per entry with no deeper one (``toc_leaves``), with its hinted page. The text of
    a section found by its hint before the one in front of it is empty. Sections of fewer than 30 characters, and such as hold
    fewer than 20 besides white space and placeholders, are left out. Documents without pages or entries have none; null texts
    are empty pages. A document is put together in one task; documents are spread.
    """
    whole = pages.groupBy(F.col(doc).alias("__d")).agg(F.transform(F.sort_array(F.collect_list(F.struct(page, F.coalesce(text, F.lit("")).alias("t")))), lambda p: p["t"]).alias("pages"))
    entry = F.struct(F.col(pos).alias("pos"), F.col(path).alias("path"), F.col(title).alias("title"), F.col(hint).cast("long").alias("hint"))
    table = leaves.groupBy(F.col(doc).alias("__d")).agg(F.sort_array(F.collect_list(entry)).alias("entries"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for key, texts, entries in zip(rows["__d"], rows["pages"], rows["entries"], strict=True):
                for i, first, last, section in sections_of(list(texts), [(e["title"], e["hint"]) for e in entries], **sizes):
                    out.append((key, entries[i]["pos"], entries[i]["path"], entries[i]["title"], first, last, section))
            yield pd.DataFrame(out, columns=["doc", "pos", "path", "title", "page_start", "page_end", "text"])

    kinds = [pages.schema[doc].dataType.simpleString(), leaves.schema[pos].dataType.simpleString()]
    schema = f"doc {kinds[0]}, pos {kinds[1]}, path string, title string, page_start long, page_end long, text string"
    return whole.join(table, "__d").mapInPandas(cut, schema)


def section_chunks(sections: DataFrame, name: str, most: int = 4000) -> DataFrame:
    """``chunk_id`` and the parts of each section's text: ``name#path``, with ``#partN`` where a text is cut into several."""
    split = F.pandas_udf(lambda texts: texts.map(lambda t: split_soft(t, most)), "array<string>")
    parts = sections.withColumn("__parts", split("text"))
    out = parts.select("*", F.size("__parts").alias("__n"), F.posexplode("__parts").alias("__i", "__part"))
    suffix = F.when(F.col("__n") > 1, F.concat(F.lit("#part"), F.col("__i") + 1)).otherwise("")
    out = out.withColumns({"chunk_id": F.concat(F.col(name).cast("string"), F.lit("#"), "path", suffix), "text": F.col("__part"), "n_chars": F.length("__part")})
    return out.drop("__parts", "__part", "__n", "__i")


def page_starts(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """``pages`` with ``start``: the place of the page's first character in the document's whole text."""
    w = Window.partitionBy(doc).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    size = F.length(F.coalesce(F.col(text), F.lit(""))) + len(PAGE_BREAK)
    return pages.withColumn("start", F.coalesce(F.sum(size).over(w), F.lit(0)).cast("long"))


def locate_pages(spans: DataFrame, starts: DataFrame, doc: str, start: str, end: str, page: str, page_start: str = "start") -> DataFrame:
    """``spans`` with ``page_first, page_last``: the pages of the first and of the last character of each span.

    Page starts and the spans' ends are sorted together once per document, and each end takes the last page that starts at or
    before it; no pair of span and page that don't belong together is ever formed. A span before the first page, with a null
    end, or of a document without pages has nulls; an empty span lies where it starts.
    """
    safe_unions(spans.sparkSession)
    keys = [F.struct(*[F.col(c) for c in spans.columns]).alias("__row"), F.monotonically_increasing_id().alias("__span")]
    last = F.greatest(F.col(start), F.col(end) - 1)
    kept = spans.select(F.col(doc).alias("__d"), *keys, F.col(start).cast("long").alias("__a"), F.when(F.col(end).isNotNull(), last).cast("long").alias("__b"))
    both = kept.select("__d", "__row", "__span", F.explode(F.array(*[F.struct(F.lit(side).alias("side"), F.col(c).alias("at")) for side, c in ((1, "__a"), (2, "__b"))])).alias("__x"))
    points = both.select("__d", F.col("__x.at").alias("__at"), F.col("__x.side").alias("__side"), F.lit(None).cast(starts.schema[page].dataType).alias("__page"), "__row", "__span")
    none = [F.lit(None).cast(points.schema[c].dataType).alias(c) for c in ("__row", "__span")]
    marks = starts.select(F.col(doc).alias("__d"), F.col(page_start).cast("long").alias("__at"), F.lit(0).alias("__side"), F.col(page).alias("__page"), *none)
    w = Window.partitionBy("__d").orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = points.unionByName(marks).withColumn("__on", F.last("__page", ignorenulls=True).over(w)).filter("__side > 0")
    seen = seen.withColumn("__on", F.when(F.col("__at").isNotNull(), F.col("__on")))
    one = lambda side: F.max(F.when(F.col("__side") == side, F.col("__on")))
    out = seen.groupBy("__d", "__span").agg(F.first("__row").alias("__row"), one(1).alias("page_first"), one(2).alias("page_last"))
    return out.select("__row.*", "page_first", "page_last")
