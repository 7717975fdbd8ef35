"""Evidence for orders: chunks are the lines of their customer, by name, kind and mark of the part."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnflow.functions import text
from tarnflow.operators import evidence
from tarnflow.registry import query
from tarnflow.session import materialize
from tarnflow.sources.tables import table

#: Words that tell of a category, and the category that has none.
_CATEGORY = {"1-URGENT": ["economy", "standard"], "2-HIGH": ["promo"], "3-MEDIUM": ["small", "medium"], "4-NOT SPECIFIED": ["large"]}
_OTHER = "5-LOW"
_TERMS = lambda c: f"list_distinct(list_filter(regexp_split_to_array(lower({c}), '[^a-z0-9]+'), lambda x: length(x) >= 4))"
_SCORE = lambda terms: f"coalesce(list_sum(list_transform({terms}, lambda x: length(haystack) - length(replace(haystack, x, '')))), 0)"
_BASE = f"""b AS (SELECT l_orderkey, l_linenumber, l_partkey, o_custkey AS symbol, CAST(l_shipdate AS DATE) AS ship, l_returnflag, p_name, p_type, p_brand FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
t AS (SELECT l_orderkey, min(p_name) FILTER (l_linenumber = 1) AS title, string_agg(DISTINCT p_name, '|' ORDER BY p_name) AS titles FROM b GROUP BY 1),
ev AS (SELECT o_orderkey, o_custkey AS symbol, CAST(o_orderdate AS DATE) AS event_date, o_orderpriority AS category, regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', '', 'g') AS normal_title, {_TERMS("coalesce(title, '')")} AS own_terms, {_TERMS("coalesce(titles, '')")} AS terms,
  CASE o_orderpriority {" ".join(f"WHEN '{k}' THEN {v}" for k, v in _CATEGORY.items())} ELSE [] END AS category_terms FROM orders LEFT JOIN t ON l_orderkey = o_orderkey),
ch AS (SELECT DISTINCT symbol, CASE WHEN l_linenumber < 7 THEN ship END AS publish_date, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS chunk_id, l_linenumber AS chunk_index, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS chunk_title,
  lower(p_name || ' ' || p_type || ' ' || p_brand) AS haystack, CASE l_returnflag WHEN 'A' THEN 'pdf' WHEN 'N' THEN 'irm_qa' ELSE '' END AS text_source FROM b)"""


def _events_and_chunks(spark, d):
    """Orders with titles from their lines' parts, and all lines of customers as chunks. Repeated lines go before they meet their texts."""
    o = table(spark, d, "orders")
    lines = table(spark, d, "lineitem").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    part = table(spark, d, "part")
    b = lines.select("o_orderkey", "l_linenumber", "l_partkey").join(part.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    titles = b.groupBy("o_orderkey").agg(F.min(F.when(F.col("l_linenumber") == 1, F.col("p_name"))).alias("title"), F.collect_set("p_name").alias("titles"))
    both = o.join(titles, "o_orderkey", "left")
    words = lambda c: text.title_terms(F.coalesce(c, F.lit("")))
    none = F.array().cast("array<string>")
    category = none
    for k, v in _CATEGORY.items():
        category = F.when(F.col("o_orderpriority") == k, F.array(*map(F.lit, v))).otherwise(category)
    events = both.select(
        "o_orderkey", F.col("o_custkey").alias("symbol"), F.to_date("o_orderdate").alias("event_date"), F.col("o_orderpriority").alias("category"), text.normalize_title(F.coalesce("title", F.lit(""))).alias("normal_title"),
        words(F.col("title")).alias("own_terms"), words(F.array_join("titles", "|")).alias("terms"), category.alias("category_terms"),
    )
    source = F.when(F.col("l_returnflag") == "A", "pdf").when(F.col("l_returnflag") == "N", "irm_qa").otherwise("")
    own = lines.select("l_orderkey", "l_linenumber", "l_partkey", F.col("o_custkey").alias("symbol"), F.when(F.col("l_linenumber") < 7, F.to_date("l_shipdate")).alias("publish_date"), source.alias("text_source")).distinct()
    texts = part.select("p_partkey", text.normalize_title(F.col("p_name")).alias("chunk_title"), F.lower(F.concat_ws(" ", "p_name", "p_type", "p_brand")).alias("haystack")).distinct()
    chunks = own.join(texts, F.col("l_partkey") == F.col("p_partkey")).select(
        "symbol", "publish_date", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("chunk_id"), F.col("l_linenumber").alias("chunk_index"), "chunk_title", "haystack", "text_source",
    )
    return events, chunks


@query("join_symbol_chunks", f"""WITH {_BASE} SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY score DESC, coalesce(abs(gap), 999999), chunk_index, publish_date NULLS FIRST, chunk_id) AS INT) AS rank, chunk_id, score, gap AS gap_days
FROM (SELECT o_orderkey, chunk_id, chunk_index, publish_date, date_diff('day', event_date, publish_date) AS gap, CAST({_SCORE("own_terms")} AS BIGINT) AS score FROM ev JOIN ch USING (symbol) WHERE len(own_terms) > 0) WHERE score > 0 AND (gap IS NULL OR abs(gap) <= 370) QUALIFY rank <= 5""")
def _(spark, d):
    events, chunks = _events_and_chunks(spark, d)
    return evidence.keyword_hits(events.drop("terms").withColumnRenamed("own_terms", "terms"), chunks, "o_orderkey").withColumn("gap_days", F.col("gap_days").cast("long"))


_MATCHES = f"""{_BASE}, pa AS (SELECT *, date_diff('day', event_date, publish_date) AS gap, {_SCORE("terms")} AS es, {_SCORE("category_terms")} AS ws, normal_title <> '' AND (contains(chunk_title, normal_title) OR contains(normal_title, chunk_title)) AS direct FROM ev JOIN ch USING (symbol) WHERE publish_date BETWEEN event_date - 3 AND event_date + 3),
ma AS (SELECT *, CASE WHEN direct THEN 'direct_title_date' WHEN es >= 12 THEN 'expanded_group_title' WHEN ws >= 8 AND abs(gap) <= 1 THEN 'weak_category_date' END AS method, CAST(CASE WHEN direct THEN 1000 + 2 * length(normal_title) WHEN es >= 12 THEN 500 + es ELSE 100 + ws END AS BIGINT) AS score FROM pa)"""


@query("se_rule_evidence", f"""WITH {_MATCHES} SELECT o_orderkey, chunk_id, method, score, gap AS gap_days, CASE WHEN method = 'weak_category_date' THEN 'weak' WHEN text_source = 'irm_qa' THEN 'auxiliary' ELSE 'strong' END AS strength FROM ma WHERE method IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY score DESC, abs(gap), chunk_index, chunk_id) = 1""")
def _(spark, d):
    best = evidence.best_matches(evidence.rule_matches(*_events_and_chunks(spark, d)), "o_orderkey")
    return best.select("o_orderkey", "chunk_id", "method", "score", F.col("gap_days").cast("long").alias("gap_days"), "strength")


@query("se_evidence_gaps", f"""WITH {_MATCHES} SELECT o_orderkey, category, length(normal_title) AS title_length, coalesce(same_day, 0) AS same_day, coalesce(near_day, 0) AS near_day,
CASE WHEN near_day IS NULL THEN 'no_nearby_chunks' WHEN length(normal_title) < 4 THEN 'short_or_template_title' WHEN category = '{_OTHER}' THEN 'weak_category_terms' ELSE 'title_terms_not_matched' END AS reason
FROM ev LEFT JOIN (SELECT o_orderkey, count(*) FILTER (gap = 0) AS same_day, count(*) AS near_day FROM pa GROUP BY 1) USING (o_orderkey) WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ma WHERE method IS NOT NULL)""")
def _(spark, d):
    events, chunks = _events_and_chunks(spark, d)
    events = materialize(events, "events")
    return evidence.pair_gaps(events, evidence.rule_pairs(events, chunks), "o_orderkey", _OTHER, keep=["category"])
