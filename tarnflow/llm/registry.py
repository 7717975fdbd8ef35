"""The corpus operators as queries over whole tables, by name, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.llm import oracles
from tarnflow.llm.chat_format import format_preferences
from tarnflow.llm.decontaminate import find_contamination
from tarnflow.llm.embed_dedup import embedding_near_dups
from tarnflow.llm.html_extract import extract_main_text
from tarnflow.llm.language_id import identify_languages
from tarnflow.llm.lexical_rank import ranked_search
from tarnflow.llm.licenses import scan_licenses
from tarnflow.llm.mixing import mix_sources
from tarnflow.llm.near_dup_simhash import simhash_components
from tarnflow.llm.periodic_runs import periodic_runs, run_digests
from tarnflow.llm.quality import classify_quality
from tarnflow.llm.secrets import scan_secrets
from tarnflow.llm.token_counts import count_tokens
from tarnflow.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {"op8_chat_format": oracles.CHAT_FORMAT, "op9_mix_sources": oracles.MIX_SOURCES, "op13_ranked_search": oracles.RANKED_SEARCH}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@_query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_dense")


@_query
def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


@_query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


@_query
def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


@_query
def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_dups(table(spark, sf_dir, "embeddings"))


@_query
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


@_query
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_preferences(table(spark, sf_dir, "conversations"))


@_query
def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.withColumn("target", F.round("target", 6))


@_query
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


@_query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(periodic_runs(table(spark, sf_dir, "documents"), plant=True))


@_query
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
