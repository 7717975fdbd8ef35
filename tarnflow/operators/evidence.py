"""Which pieces of text speak for an event: pairs of one symbol near in time, rules that tell how well a piece fits, and why some events have none."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.functions.text import keyword_score
from tarnflow.operators.joins import range_pairs
from tarnflow.operators.windows import best_per_key

#: Least scores by which words of an event's titles, or of its category, make a match.
EXPANDED_LEAST, WEAK_LEAST = 12, 8
#: Sources whose text is the announcement itself.
FULL_TEXTS = ("pdf", "notice_api")


def symbol_chunks(events: DataFrame, chunks: DataFrame, within: int = 370) -> DataFrame:
    """Every pair of an event and a chunk of its ``symbol`` whose dates lie ``within`` days, with ``gap_days``; a missing date lets any pair pass.

    ``events`` has ``symbol, event_date``, ``chunks`` ``symbol, publish_date``, and other names of their own. Dated pairs meet in
    buckets of days, so that a symbol with very many chunks spreads over its dates.
    """
    dated = range_pairs(events.filter("event_date is not null"), chunks.filter("publish_date is not null"), "symbol", "event_date", "publish_date", -within, within)
    names = [c for c in chunks.columns if c != "symbol"]
    columns = [*events.columns, *names]
    free = events.filter("event_date is null").join(chunks, "symbol").select(*columns)
    late = events.filter("event_date is not null").join(chunks.filter("publish_date is null"), "symbol").select(*columns)
    return dated.select(*columns, "gap_days").unionByName(free.unionByName(late).withColumn("gap_days", F.lit(None).cast("int")))


def _distance() -> Column:
    """Days between event and chunk; an unknown distance comes after any known one."""
    return F.coalesce(F.abs("gap_days"), F.lit(999_999))


def keyword_hits(events: DataFrame, chunks: DataFrame, key: str, k: int = 5, within: int = 370) -> DataFrame:
    """``key, rank, chunk_id, score, gap_days``: the ``k`` chunks of an event that hold most of its ``terms``, by length of what they hold.

    Equal scores rank by distance in days, place in the document, date and id. Events without terms have none.
    """
    pairs = symbol_chunks(events.filter(F.size("terms") > 0), chunks, within)
    scored = pairs.withColumn("score", keyword_score(F.col("haystack"), F.col("terms"))).filter("score > 0")
    order = [F.desc("score"), _distance(), F.abs(F.coalesce("chunk_index", F.lit(0))), F.asc_nulls_first("publish_date"), F.col("chunk_id")]
    return best_per_key(scored, [key], order, k, "rank").select(key, "rank", "chunk_id", "score", "gap_days")


def rule_matches(events: DataFrame, chunks: DataFrame, near: int = 3) -> DataFrame:
    """The ``rule_pairs`` that a rule matches."""
    return rule_pairs(events, chunks, near).filter("method is not null")


def rule_pairs(events: DataFrame, chunks: DataFrame, near: int = 3) -> DataFrame:
    """Pairs of an event and a chunk within ``near`` days, with ``method, score, strength`` of the rule that matches them; a null method where none does.

    ``direct_title_date``: one title holds the other, as any holds an empty one (1000 and twice the length of the event's). ``expanded_group_title``: the chunk
    holds words of the event's group of titles (500 and their score). ``weak_category_date``: it holds words of the category and lies
    at most a day away (100 and their score). The same day is distance 0.
    """
    pairs = range_pairs(events, chunks, "symbol", "event_date", "publish_date", -near, near)
    title, other = F.col("normal_title"), F.coalesce("chunk_title", F.lit(""))
    direct = (title != "") & (F.contains(other, title) | F.contains(title, other))
    expanded = keyword_score(F.col("haystack"), F.col("terms"))
    weak = keyword_score(F.col("haystack"), F.col("category_terms"))
    method = F.when(direct, "direct_title_date").when(expanded >= EXPANDED_LEAST, "expanded_group_title").when((weak >= WEAK_LEAST) & (F.abs("gap_days") <= 1), "weak_category_date")
    score = F.when(direct, 1000 + 2 * F.length(title)).when(expanded >= EXPANDED_LEAST, 500 + expanded).otherwise(100 + weak)
    source = F.coalesce("text_source", F.lit(""))
    strength = F.when(F.col("method") == "weak_category_date", "weak").when(source.isin(*FULL_TEXTS, ""), "strong").otherwise("auxiliary")
    found = pairs.withColumns({"method": method, "score": score.cast("long")})
    return found.withColumn("strength", strength)


def best_matches(matches: DataFrame, key: str) -> DataFrame:
    """The best match of each event: greatest score, then nearest, then first in its document, then by id."""
    return best_per_key(matches, [key], [F.desc("score"), _distance(), F.coalesce("chunk_index", F.lit(0)), F.col("chunk_id")])


def evidence_gaps(events: DataFrame, chunks: DataFrame, matched: DataFrame, key: str, other: str, near: int = 3, short: int = 4, keep: Sequence[str] = ()) -> DataFrame:
    """Events that no rule matched, how many chunks lie on their day and near it, and why: no chunk near, a title too short
    to tell, a category without words of its own (``other``), or words that no chunk holds."""
    open_ = events.join(matched.select(key).distinct(), key, "left_anti")
    pairs = range_pairs(open_.select(key, "symbol", "event_date"), chunks.select("symbol", "publish_date"), "symbol", "event_date", "publish_date", -near, near)
    return pair_gaps(open_, pairs.withColumn("method", F.lit(None).cast("string")), key, other, short, keep)


def pair_gaps(events: DataFrame, pairs: DataFrame, key: str, other: str, short: int = 4, keep: Sequence[str] = ()) -> DataFrame:
    """``evidence_gaps`` from ``rule_pairs``, which are found once for matches and counts; ``events`` are read twice."""
    counts = pairs.groupBy(key).agg(F.count_if(F.col("gap_days") == 0).alias("same_day"), F.count("*").alias("near_day"), F.count("method").alias("__matched"))
    out = events.join(counts, key, "left").filter(F.coalesce("__matched", F.lit(0)) == 0)
    out = out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("same_day", "near_day")})
    size = F.length("normal_title")
    reason = F.when(F.col("near_day") == 0, "no_nearby_chunks").when(size < short, "short_or_template_title").when(F.col("category") == other, "weak_category_terms").otherwise("title_terms_not_matched")
    return out.select(key, *keep, size.cast("long").alias("title_length"), "same_day", "near_day", reason.alias("reason"))
