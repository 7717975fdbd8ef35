"""Which text stands for each announcement or event, and its chunks: files first, then what an interface gave, then composed text."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.functions.text import blank_to_null, norm_whitespace
from tarnflow.operators.chunking import chunk_texts
from tarnflow.operators.windows import best_per_key
from tarnflow.session import materialize

#: How far a source's text is the announcement itself; any other source is weak.
STRONG, AUXILIARY = ("pdf", "notice_api"), ("research_report", "ir_record", "irm_qa", "news")
COLUMNS = "document_id, symbol, source_type, title, publish_date, code, event_id, text_source, strength, source_text".split(", ")


def strength(source: Column) -> Column:
    return F.when(source.isin(*STRONG), "strong").when(source.isin(*AUXILIARY), "auxiliary").otherwise("weak")


def composed(fields: dict[str, Column]) -> Column:
    """Lines ``name: value`` of the values that are not blank; null without any."""
    lines = [F.when(blank_to_null(v).isNotNull(), F.concat(F.lit(f"{k}: "), blank_to_null(v))) for k, v in fields.items()]
    return F.nullif(F.concat_ws("\n", *lines), F.lit(""))


def text_manifest(events: DataFrame, files: DataFrame, sources: dict[str, str], fields: dict[str, Column]) -> DataFrame:
    """One row (COLUMNS) for each document that has a text to look for.

    ``files`` (``code, symbol, title, notice_date, status, n_pages``): those with a code, status ok or exists, and pages are of source
    ``pdf``. ``events`` (``event_id, symbol, source_type, title, event_date, code``, and what ``fields`` names): announcements whose code
    has no such file are of source ``notice_api``; events of another kind that ``sources`` knows get a composed text. Rows of one
    document id: files come before interfaces, these before composed texts, then the least event id. Blank codes are none.
    """
    code = blank_to_null(F.col("code"))
    had = files.filter(code.isNotNull() & F.col("status").isin("ok", "exists") & (F.coalesce("n_pages", F.lit(0)) > 0)).withColumn("code", code)
    null = F.lit(None).cast("string")
    kind = events.schema["event_id"].dataType

    def rows(df: DataFrame, order: int, source: Column, ident: Column, source_type: Column, date: str, event: Column, text: Column) -> DataFrame:
        df = df.withColumns({"text_source": source, "source_text": text})
        parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (F.col("text_source"), F.col("symbol"), ident)]
        return df.select(
            F.concat_ws(":", *parts).alias("document_id"), "symbol", source_type.alias("source_type"), blank_to_null(F.col("title")).alias("title"), F.col(date).alias("publish_date"), code.alias("code"), event.alias("event_id"),
            "text_source", strength(F.col("text_source")).alias("strength"), "source_text", F.lit(order).alias("__order"),
        )

    first = rows(had, 0, F.lit("pdf"), F.col("code"), F.lit("notice_pdf"), "notice_date", F.lit(None).cast(kind), null)
    announced = events.filter((F.col("source_type") == "announcement") & code.isNotNull()).withColumn("code", code)
    second = rows(announced.join(had.select("code").distinct(), "code", "left_anti"), 1, F.lit("notice_api"), F.col("code"), F.lit("announcement"), "event_date", F.col("event_id"), null)
    known = F.create_map(*[F.lit(x) for pair in sources.items() for x in pair])
    third = rows(events.filter(F.col("source_type").isin(*sources)), 2, F.try_element_at(known, F.col("source_type")), F.col("event_id"), F.col("source_type"), "event_date", F.col("event_id"), composed(fields))
    every = first.unionByName(second).unionByName(third.filter("source_text is not null"))
    return best_per_key(every, ["document_id"], [F.col("__order"), F.asc_nulls_first("event_id"), F.asc_nulls_first("publish_date")]).select(*COLUMNS)


@dataclass(frozen=True)
class Variant:
    """How texts are made ready and cut."""

    name: str
    most: int = 1800
    overlap: int = 160
    boilerplate: str | None = None
    prefix: bool = False


def _ready(text: Column, v: Variant) -> Column:
    """Blanks in order, without sentences of form (``boilerplate``), and with the document's facts in front, once."""
    out = norm_whitespace(F.coalesce(text, F.lit("")))
    if v.boilerplate:
        out = norm_whitespace(F.regexp_replace(out, v.boilerplate, ""))
    if v.prefix:
        facts = composed({"symbol": F.col("symbol"), "source": F.col("text_source"), "strength": F.col("strength"), "date": F.col("publish_date").cast("string"), "title": F.col("title")})
        out = F.when(out != "", F.when(F.startswith(out, facts), out).otherwise(F.concat_ws("\n", facts, out))).otherwise(out)
    return out


def _routed(manifest: DataFrame, pages: DataFrame, contents: DataFrame) -> DataFrame:
    """The manifest with ``route``, ``page`` and ``__text``: where every document's best text comes from, and the text."""
    source = F.coalesce("text_source", F.lit(""))
    said = lambda c: F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) > 0
    paged = pages.filter(said("text")).select("code", "page", F.col("text").alias("__t"))
    given = contents.filter(said("content")).select("code", F.col("content").alias("__c"))
    from_files = manifest.filter(source.isin("", "pdf")).join(paged, "code").withColumns({"route": F.lit("pages"), "__text": F.col("__t")}).drop("__t")
    rest = manifest.join(from_files.select("document_id").distinct(), "document_id", "left_anti")
    rest = rest.join(given, "code", "left").withColumn("__c", F.when(F.coalesce("text_source", F.lit("")).isin("", "notice_api"), F.col("__c")))
    rest = rest.withColumns({"route": F.when(said("__c"), "content").otherwise("composed"), "__text": F.when(said("__c"), F.col("__c")).otherwise(F.col("source_text")), "page": F.lit(None).cast(pages.schema["page"].dataType)}).drop("__c")
    return from_files.unionByName(rest)


def source_chunks(manifest: DataFrame, pages: DataFrame, contents: DataFrame, variant: Variant = Variant("plain")) -> DataFrame:
    """``document_id, route, page, chunk_index, chunk_id, text`` and the manifest's columns: the chunks of every document's best text.

    ``pages`` (``code, page, text``) serves documents of source ``pdf``, ``contents`` (``code, content``) those of ``notice_api``, either also
    documents without a source; where these give no text the composed one does. Documents without any text have no chunks.
    Codes are null where there is none; a code of ``contents`` is there once.
    """
    texts = _routed(manifest, pages, contents).withColumn("__text", _ready(F.col("__text"), variant)).filter("__text <> ''")
    texts = materialize(texts.withColumn("__id", F.concat_ws("\x1f", "document_id", F.coalesce(F.col("page").cast("string"), F.lit("")))), "texts")
    cut = chunk_texts(texts, "__id", "__text", "overlap", most=variant.most, overlap=variant.overlap).select(F.col("id").alias("__id"), "part", F.col("chunk").alias("text"))
    out = texts.drop("__text").join(cut, "__id")
    mark = F.when(F.col("route") == "pages", F.concat(F.lit("#p"), "page", F.when(F.col("part") > 0, F.concat(F.lit("."), F.col("part") + 1)).otherwise("")))
    mark = F.coalesce(mark, F.concat(F.when(F.col("route") == "content", "#api").otherwise("#text"), F.col("part") + 1))
    return out.withColumns({"chunk_id": F.concat("document_id", mark), "chunk_part": (F.col("part") + 1).cast("int"), "n_chars": F.length("text")}).drop("__id", "part")


def chunk_statistics(manifest: DataFrame, chunks: DataFrame, variant: Variant) -> DataFrame:
    """One row on a variant: documents, those with and without chunks, by route, and how long chunks are."""
    docs = chunks.groupBy("document_id").agg(F.first("route").alias("route"), F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"))
    facts = docs.agg(
        F.count("*").alias("with_chunks"), *[F.count_if(F.col("route") == r).alias(f"by_{r}") for r in ("pages", "content", "composed")],
        F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars"), F.coalesce(F.max("longest"), F.lit(0)).cast("long").alias("longest"),
    )
    both = manifest.agg(F.count("*").alias("documents")).join(F.broadcast(facts))  # one row each
    mean = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)), 2)
    return both.withColumns({"strategy": F.lit(variant.name), "failed": F.col("documents") - F.col("with_chunks"), "mean_chars": mean("chars", "chunks"), "chunks_per_document": mean("chunks", "with_chunks")})


def compare_variants(manifest: DataFrame, pages: DataFrame, contents: DataFrame, variants: Sequence[Variant]) -> DataFrame:
    """``chunk_statistics`` of several variants over one manifest; texts are found once, and only lengths of chunks leave the tasks."""
    texts = materialize(_routed(manifest, pages, contents), "texts")
    out = None
    for v in variants:
        ready = texts.select("document_id", "route", _ready(F.col("__text"), v).alias("__text")).filter("__text <> ''")
        chunks = chunk_texts(ready, "document_id", "__text", "overlap", ["route"], True, most=v.most, overlap=v.overlap)
        row = chunk_statistics(manifest, chunks.withColumnRenamed("id", "document_id"), v)
        out = row if out is None else out.unionByName(row)
    return out
