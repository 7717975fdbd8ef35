"""Manifests of texts and their chunks by source: known cases."""

import datetime as dt

from pyspark.sql import functions as F

from tarnflow.operators import manifest
from tarnflow.operators.manifest import Variant

D = dt.date(2024, 5, 1)


def fields():
    return {"title": F.col("title"), "summary": F.col("summary")}


def frames(spark):
    events = spark.createDataFrame([
        (1, "S", "announcement", "has a file", D, "AN1", "s"), (2, "S", "announcement", "no file", D, "AN2", "s"), (3, "S", "announcement", "file failed", D, "AN3", "s"), (4, "S", "announcement", "no code", D, " ", "s"),
        (5, "S", "irm_qa", "question", D, None, "answer"), (6, "S", "irm_qa", " ", D, None, None), (7, "S", "weather", "not known", D, "AN7", "s"), (8, None, "news", None, None, None, "news text"), (9, "S", "announcement", "no file", D, "AN2", "s"),
    ], "event_id int, symbol string, source_type string, title string, event_date date, code string, summary string")
    files = spark.createDataFrame([("AN1", "S", "file", D, "ok", 2), ("AN3", "S", "failed", D, "error", 2), ("AN5", "S", "empty", D, "exists", 0), (None, "S", "no code", D, "ok", 1)], "code string, symbol string, title string, notice_date date, status string, n_pages int")
    pages = spark.createDataFrame([("AN1", 1, "Page one. " * 30), ("AN1", 2, " "), ("AN1", 3, "Page three."), ("AN9", 1, "nobody's")], "code string, page int, text string")
    contents = spark.createDataFrame([("AN2", "What the interface   gave."), ("AN3", " "), ("AN1", "not used")], "code string, content string")
    return events, files, pages, contents


def made(spark):
    events, files, pages, contents = frames(spark)
    return manifest.text_manifest(events, files, {"irm_qa": "irm_qa", "news": "news"}, fields()), pages, contents


def test_manifest(spark):
    rows = {r.document_id: r for r in made(spark)[0].collect()}
    assert {k: (r.text_source, r.strength, r.event_id) for k, r in rows.items()} == {
        "pdf:S:AN1": ("pdf", "strong", None), "notice_api:S:AN2": ("notice_api", "strong", 2), "notice_api:S:AN3": ("notice_api", "strong", 3), "irm_qa:S:5": ("irm_qa", "auxiliary", 5), "news::8": ("news", "auxiliary", 8),
    }
    assert rows["irm_qa:S:5"].source_text == "title: question\nsummary: answer" and rows["news::8"].source_text == "summary: news text"


def test_chunks_by_source(spark):
    m, pages, contents = made(spark)
    got = manifest.source_chunks(m, pages, contents, Variant("small", 120, 40))
    rows = {r.chunk_id: (r.route, r.page, r.text, r.symbol) for r in got.collect()}
    assert rows["pdf:S:AN1#p3"] == ("pages", 3, "Page three.", "S") and rows["notice_api:S:AN2#api1"] == ("content", None, "What the interface gave.", "S")
    assert rows["news::8#text1"] == ("composed", None, "summary: news text", None) and "pdf:S:AN1#p1.2" in rows and not any(k.startswith("notice_api:S:AN3") for k in rows)
    facts = manifest.chunk_statistics(m, got, Variant("small")).head()
    assert (facts.documents, facts.with_chunks, facts.failed, facts.by_pages, facts.by_content, facts.by_composed) == (5, 4, 1, 1, 1, 2)
    assert facts.chunks == len(rows) and facts.longest <= 120


def test_boilerplate_and_prefix_once(spark):
    m, pages, contents = made(spark)
    again = pages.filter("page = 3").select("code", "page", F.lit("symbol: S\nsource: pdf\nstrength: strong\ndate: 2024-05-01\ntitle: file\nAll rights reserved. Text.").alias("text"))
    v = Variant("clean", 1000, 100, r"(?i)all rights reserved\. ", True)
    rows = {r.chunk_id: r.text for r in manifest.source_chunks(m, again, contents, v).collect()}
    assert rows["pdf:S:AN1#p3"] == "symbol: S\nsource: pdf\nstrength: strong\ndate: 2024-05-01\ntitle: file\nText."
    assert rows["irm_qa:S:5#text1"].startswith("symbol: S\nsource: irm_qa\nstrength: auxiliary\ndate: 2024-05-01\ntitle: question\ntitle: question")


def test_no_rows(spark):
    events, files, pages, contents = (x.limit(0) for x in frames(spark))
    m = manifest.text_manifest(events, files, {"news": "news"}, fields())
    chunks = manifest.source_chunks(m, pages, contents)
    assert m.count() == 0 and chunks.count() == 0
    facts = manifest.compare_variants(m, pages, contents, [Variant("a"), Variant("b", prefix=True)]).collect()
    assert [(f.strategy, f.documents, f.chunks, f.mean_chars) for f in facts] == [("a", 0, 0, 0.0), ("b", 0, 0, 0.0)]
