"""Ordered rules as one expression each: classes, labels, ladders. Rules are parameters; thresholds have defaults."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnflow.functions.text import keyword_count, keyword_flag


def first_rule(rules: Sequence[tuple[Column, str]], other: str) -> Column:
    """The value of the first condition that holds (a null one does not)."""
    out = F.lit(other)
    for when, value in reversed(rules):
        out = F.when(when, F.lit(value)).otherwise(out)
    return out


def category(c: Column, rules: dict[str, Sequence[str]], other: str = "other", most: int = 5) -> Column:
    """``primary, tags, score``: first rule with a keyword hit, all of them, and hits summed, each rule's at most ``most``."""
    tags = F.array_compact(F.array(*[F.when(keyword_flag(c, w), F.lit(name)) for name, w in rules.items()]))
    hits = [F.least(keyword_count(c, w), F.lit(most)) for w in rules.values()]
    return F.struct(F.coalesce(F.try_element_at(tags, F.lit(1)), F.lit(other)).alias("primary"), tags.alias("tags"), sum(hits[1:], hits[0]).alias("score"))


def topics(c: Column, rules: dict[str, Sequence[str]], other: str = "unclassified") -> Column:
    """All topics with a keyword hit, joined by ``|``."""
    tags = F.array_compact(F.array(*[F.when(keyword_flag(c, w), F.lit(name)) for name, w in rules.items()]))
    return F.when(F.size(tags) == 0, F.lit(other)).otherwise(F.array_join(tags, "|"))


def compound_subtype(c: Column, rules: dict[str, Sequence[str]], excluded: dict[str, Sequence[str]], other: str = "other", compound: str = "compound") -> Column:
    """No hit: other, one: its name, more: compound. A rule's excluding words undo its hit."""
    hits = []
    for name, words in rules.items():
        hit = keyword_flag(c, words)
        if name in excluded:
            hit &= ~keyword_flag(c, excluded[name])
        hits.append(F.when(hit, F.lit(name)))
    tags = F.array_compact(F.array(*hits))
    return F.when(F.size(tags) == 0, F.lit(other)).when(F.size(tags) == 1, F.try_element_at(tags, F.lit(1))).otherwise(F.lit(compound))


def reaction_label(x: Column, band: float = 0.02, closed: bool = True) -> Column:
    """positive, negative or neutral around a band, whose ends belong to the outer classes if ``closed``; null without a value."""
    up, down = ((x >= band), (x <= -band)) if closed else ((x > band), (x < -band))
    return F.when(x.isNull(), F.lit(None)).when(up, "positive").when(down, "negative").otherwise("neutral")


def market_response(own: Column, relative: Column, band: float = 0.05) -> Column:
    """Relative return against a band; own return only, or no coverage, where there is none."""
    return (
        F.when(own.isNull() & relative.isNull(), "no_coverage").when(relative.isNull(), "own_only")
        .when(relative >= band, "outperform").when(relative <= -band, "underperform").otherwise("in_line")
    )


def time_split(date: Column, status: Column, label: Column, train_end: str, valid_end: str) -> Column:
    """``split, reason``: train, valid or test by date; excluded with a reason where status, date or label are wanting."""
    out = (
        F.when(F.coalesce(status, F.lit("")) != "ok", F.struct(F.lit("excluded").alias("split"), F.lit("status_not_ok").alias("reason")))
        .when(date.isNull(), F.struct(F.lit("excluded").alias("split"), F.lit("bad_date").alias("reason")))
        .when(label.isNull(), F.struct(F.lit("excluded").alias("split"), F.lit("missing_label").alias("reason")))
    )
    for end, name in ((train_end, "train"), (valid_end, "valid")):
        out = out.when(date <= F.lit(end).cast("date"), F.struct(F.lit(name).alias("split"), F.lit(f"date_in_{name}").alias("reason")))
    return out.otherwise(F.struct(F.lit("test").alias("split"), F.lit("date_in_test").alias("reason")))


def sample_policy(has_label: Column, listing: Column, mechanics: Column, clean: Column, overlaps: Column, most: int = 3) -> Column:
    """Which training sample an event belongs to, and why: an ordered ladder."""
    pair = lambda p, r: F.struct(F.lit(p).alias("policy"), F.lit(r).alias("reason"))
    return (
        F.when(~F.coalesce(has_label, F.lit(False)), pair("exclude_no_label", "no main label"))
        .when(F.coalesce(listing, F.lit(False)), pair("exclude_listing", "listing related"))
        .when(F.coalesce(mechanics, F.lit(False)), pair("exclude_mechanics", "trading mechanics"))
        .when(F.coalesce(clean, F.lit(False)), pair("train_clean", "no overlap"))
        .when(F.coalesce(overlaps, F.lit(0)) <= most, pair("train_overlap", "few overlaps"))
        .otherwise(pair("review_overlap", "many overlaps"))
    )


def readiness(n_train: Column, n_test: Column, enough: tuple[int, int] = (60, 5), some: tuple[int, int] = (20, 3)) -> Column:
    """ready, limited or not_ready by counts, with the counts in words."""
    state = F.when((n_train >= enough[0]) & (n_test >= enough[1]), "ready").when((n_train >= some[0]) & (n_test >= some[1]), "limited").otherwise("not_ready")
    return F.struct(state.alias("readiness"), F.format_string("train=%d test=%d", n_train, n_test).alias("reason"))


def coverage_status(rows: Column, days: Column) -> Column:
    """Status and advice for a data set by its rows and the days that they span."""
    state = F.when(F.coalesce(rows, F.lit(0)) == 0, "missing").when((rows < 10) | (days < 30), "thin").otherwise("ok")
    advice = F.when(state == "missing", "collect").when(state == "thin", "use with care").otherwise("use")
    return F.struct(state.alias("status"), advice.alias("recommendation"))
