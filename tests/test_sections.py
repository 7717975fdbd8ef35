"""Sections by contents titles and the pages of spans."""

import random

from pyspark.sql import functions as F

from tarnflow.operators import sections
from tarnflow.operators.sections import match_titles, sections_of

SAYS = "this section says something of its own, at some length"


def test_titles_in_order_with_white_space_anywhere():
    full = "1 Out line\n\nintro\n2 Ri\nsks\n\nsome text 1 Outline again\n3 End"
    got = match_titles(full, [0], [("1 Outline", 1), ("2 Risks", 1), ("absent", 1), ("3 End", 1)])
    assert [full[a:b].split() if (g := x) else None for x in got for a, b in [x or (0, 0)]][:2] == [["1", "Out", "line"], ["2", "Ri", "sks"]]
    assert got[2] is None and full[got[3][0] :] == "3 End" and got[3][1] == len(full)


def test_repeated_titles_go_forward_and_hints_go_back():
    full = "A x A y B z"
    assert [g[0] for g in match_titles(full, [0], [("A", 1), ("A", 1), ("B", 1)])] == [0, 4, 8]
    assert [g and g[0] for g in match_titles(full, [0, 4], [("B", 1), ("A", 2), ("y", None)])] == [8, 4, 6]  # found by its hint, then on from there
    assert match_titles("", [], [("A", 1), ("", 1), (None, None)]) == [None, None, None]
    assert match_titles("A", [0], [("A", 9)]) == [(0, 1)] and match_titles("A", [0], [("B", 9)]) == [None]


def test_sections_that_say_nothing_are_left_out():
    pages = [f"One\n{SAYS}\nTwo\nshort", "Three\n□适用 √不适用 □ 适用 √ 不适用 □适用 √不适用 □适用 √不适用", None, f"Four\n{SAYS}", "  and more\n\n\n\nof it "]
    got = sections_of(pages, [(t, 1) for t in ("One", "Two", "Three", "Four")])
    assert [(i, a, b) for i, a, b, _ in got] == [(0, 1, 1), (3, 4, 5)]
    assert got[1][3] == f"{SAYS}\n\nand more\n\nof it"


def test_page_range_crosses_pages():
    got = sections_of([f"T1 {SAYS}", SAYS, f"T2 {SAYS}"], [("T1", 1), ("T2", 3)])
    assert [(i, a, b) for i, a, b, _ in got] == [(0, 1, 2), (1, 3, 3)]


def test_cut_sections_and_chunks(spark):
    long = ". ".join([SAYS] * 20)
    pages = spark.createDataFrame([(1, 2, f"Second {long}", "z"), (1, 1, f"First {SAYS}", "z"), (2, 1, None, "z"), (3, 1, "no entries", "z"), (None, 1, SAYS, "z")], "doc int, page int, text string, pos string")
    leaves = spark.createDataFrame([(1, 1, "a/First", "First", 1), (1, 2, "a/Second", "Second", 2), (2, 1, "x", "x", 1), (4, 1, "y", "y", 1)], "doc int, pos int, path string, title string, hint int")
    cut = sections.cut_sections(pages, leaves, "doc", "page", "text", "pos", "path", "title", "hint")
    got = [(r.doc, r.pos, r.path, r.page_start, r.page_end, len(r.text)) for r in cut.orderBy("pos").collect()]
    assert got == [(1, 1, "a/First", 1, 1, len(SAYS)), (1, 2, "a/Second", 2, 2, len(long))]
    parts = sections.section_chunks(cut, "doc", most=400).orderBy("pos", "chunk_id").collect()
    assert [p.chunk_id for p in parts] == ["1#a/First", *[f"1#a/Second#part{k}" for k in range(1, len(parts))]] and len(parts) > 2
    assert all(p.n_chars == len(p.text) <= 400 for p in parts) and "".join("".join(p.text for p in parts[1:]).split()) == "".join(long.split())
    assert sections.cut_sections(pages.limit(0), leaves, "doc", "page", "text", "pos", "path", "title", "hint").count() == 0


def test_pages_of_spans(spark):
    rng = random.Random(1)
    pages = [(d, p, "x" * rng.choice([0, 1, 5, 40])) for d in (1, 2) for p in range(1, 12)] + [(3, 1, None)]
    starts, at = {}, {}
    for d, p, t in pages:
        starts.setdefault(d, []).append((at.get(d, 0), p))
        at[d] = at.get(d, 0) + len(t or "") + 2
    spans = [(d, a, a + rng.choice([0, 1, 3, 30])) for d in (1, 2) for a in range(0, at[d], 3)] + [(1, 0, 5), (1, 0, 5), (3, 0, 1), (9, 0, 1), (1, -3, 1), (1, None, 4), (1, 2, None)]
    on = lambda d, x: None if x is None else max((p for s, p in starts.get(d, []) if s <= x), default=None)
    want = [(d, a, b, on(d, a), on(d, None if a is None and b is None or b is None else max(x for x in (a, b - 1) if x is not None))) for d, a, b in spans]
    df = spark.createDataFrame([(*s, "z") for s in spans], "doc int, a int, b int, start string")
    first = sections.page_starts(spark.createDataFrame(pages, "doc int, page int, text string"), "doc", "page", "text")
    got = sections.locate_pages(df, first, "doc", "a", "b", "page")
    assert got.columns == ["doc", "a", "b", "start", "page_first", "page_last"]
    assert sorted(map(str, [(r.doc, r.a, r.b, r.page_first, r.page_last) for r in got.collect()])) == sorted(map(str, want))
    assert "SortMergeJoin" not in got._jdf.queryExecution().toString() and sections.locate_pages(df.limit(0), first, "doc", "a", "b", "page").count() == 0


def test_groups_of_unions_stay_whole(spark):
    from tarnflow.session import safe_unions

    safe_unions(spark)
    t = spark.range(200).select((F.col("id") % 7).alias("k"), "id")
    a = t.groupBy("k").agg(F.max("id").alias("id"))
    assert a.union(t.groupBy("k").agg(F.min("id"))).groupBy("k").count().count() == 7
