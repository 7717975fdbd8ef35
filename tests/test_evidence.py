"""Intensity of announcements, rules of evidence, and gaps: known cases."""

import datetime as dt

import pytest

from tarnflow.operators import evidence, intensity

D = dt.date(2024, 3, 10)
EVENTS = "e int, symbol string, event_date date, category string, normal_title string, terms array<string>, category_terms array<string>"
CHUNKS = "symbol string, publish_date date, chunk_id string, chunk_index int, chunk_title string, haystack string, text_source string"


def day(n):
    return None if n is None else D + dt.timedelta(days=n)


def announce(spark, rows):
    df = spark.createDataFrame(rows, "title string, summary string, sample string, size double, money string")
    return intensity.event_intensity(df.drop("money"), ["title", "summary", "sample"], "size").collect()


def test_amounts_and_profit(spark):
    up, down = announce(spark, [
        ("预增 预计净利润11200-14200万", "公司拟回购股份，金额不低于1亿元且不超过2亿元。", "2024年度业绩预告", 100.0, ""),
        ("首亏 预计净利润-119000~-118500万", "关于签署资产管理合同的公告", "首亏 预计净利润-119000~-118500万", 100.0, ""),
    ])
    assert (up.profit_direction, up.is_repurchase, up.is_contract_order) == (1.0, 1, 0)
    assert [up.profit_low, up.profit_high, up.money_max, up.money_max_to_size] == pytest.approx([1.12, 1.42, 2.0, 0.02])
    assert up.money_count == 3 and up.money_sum == pytest.approx(1.42 + 1 + 2)  # the second end of the range is no negative amount
    assert down.profit_direction == -1.0 and [down.profit_low, down.profit_high] == pytest.approx([-11.9, -11.85]) and down.is_contract_order == 0
    assert down.money_count == 1  # the same text counts once


def test_units_directions_and_nothing(spark):
    rows = announce(spark, [
        ("利润 5至 8", None, None, 0.0, ""), ("净利润2000到1500", "增长 下降", None, None, ""), ("下滑 -3.5 % 和 7%", "", None, 1.0, ""), (None, None, None, 1.0, ""), ("补贴3000元", "增长", "增长", float("nan"), ""),
    ])
    assert [(r.profit_low, r.profit_high) for r in rows[:2]] == [(5.0, 8.0), (pytest.approx(0.15), pytest.approx(0.2))] and rows[0].profit_mid_to_size is None
    assert [r.profit_direction for r in rows] == [0.0, 0.0, -1.0, 0.0, 1.0]
    assert (rows[2].percent_count, rows[2].percent_max, rows[2].percent_mean) == (2.0, pytest.approx(0.07), pytest.approx(0.0175))
    assert (rows[3].money_count, rows[3].money_max, rows[3].money_sum, rows[3].percent_mean, rows[3].profit_mid) == (0.0, None, None, None, None)
    assert rows[4].money_sum == pytest.approx(3e-5) and rows[4].money_max_to_size is None and rows[4].is_subsidy == 1 and rows[4].positive_words == 1.0
    assert len(rows[0]) == 4 + 26


def events(spark, rows):
    return spark.createDataFrame([(e, s, day(n), c, t, w, x) for e, s, n, c, t, w, x in rows], EVENTS)


def chunks(spark, rows):
    return spark.createDataFrame([(s, day(n), i, k, t, h, src) for s, n, i, k, t, h, src in rows], CHUNKS)


def test_rules_in_their_order(spark):
    e = events(spark, [
        (1, "A", 0, "x", "repurchaseplan", ["repurchase", "plan"], ["shares"]),
        (2, "B", 0, "x", "", ["buyback", "shares"], ["share"]),
        (3, "C", 0, "x", "other", ["nothing"], ["dividend"]),
        (4, "D", 0, "x", "unmatched", ["nothing"], []),
    ])
    c = chunks(spark, [
        ("A", 2, "a1", 3, "repurchaseplanofthecompany", "plan", "irm_qa"), ("A", 0, "a2", 1, "nought", "repurchase plan repurchase", "pdf"), ("A", 4, "a3", 0, "repurchaseplan", "", "pdf"),
        ("B", 1, "b1", 2, "zzz", "buyback of shares", ""), ("B", -1, "b2", 1, "zzz", "shares buyback", "pdf"), ("B", 0, "b3", 9, "zzz", "share share", "pdf"),
        ("C", 2, "c1", 1, "zzz", "dividend", "pdf"), ("C", 1, "c2", 1, "zzz", "dividend", "pdf"), ("D", 0, "d1", 1, "zzz", "word", "pdf"), (None, 0, "n", 1, "zzz", "x", "pdf"),
    ])
    matches = evidence.rule_matches(e, c)
    best = {r.e: (r.chunk_id, r.method, r.score, r.strength) for r in evidence.best_matches(matches, "e").collect()}
    assert best == {
        1: ("a1", "direct_title_date", 1028, "auxiliary"), 2: ("b2", "expanded_group_title", 513, "strong"), 3: ("c2", "weak_category_date", 108, "weak"),
    }
    untitled = evidence.rule_matches(e, chunks(spark, [("D", 0, "d2", 1, None, "word", "pdf")])).head()
    assert (untitled.method, untitled.e) == ("direct_title_date", 4)  # any title holds an empty one
    gaps = evidence.evidence_gaps(e, c, matches, "e", "other").collect()
    assert [(g.e, g.title_length, g.same_day, g.near_day, g.reason) for g in gaps] == [(4, 9, 1, 1, "title_terms_not_matched")]


def test_reasons_of_gaps(spark):
    e = events(spark, [(1, "A", 0, "x", "long enough", [], []), (2, "B", 0, "other", "abc", [], []), (3, "B", 0, "other", "abcd", [], []), (4, "B", 1, "x", "abcd", [], []), (5, "B", None, "x", "abcd", [], [])])
    c = chunks(spark, [("A", 5, "a", 1, "zzz", "h", "pdf"), ("B", 0, "b", 1, "zzz", "h", "pdf"), ("B", 1, "b", 2, "zzz", "h", "pdf")])
    got = {g.e: (g.same_day, g.near_day, g.reason) for g in evidence.evidence_gaps(e, c, evidence.rule_matches(e, c), "e", "other").collect()}
    assert got == {1: (0, 0, "no_nearby_chunks"), 2: (1, 2, "short_or_template_title"), 3: (1, 2, "weak_category_terms"), 4: (1, 2, "title_terms_not_matched"), 5: (0, 0, "no_nearby_chunks")}


def test_keyword_hits_take_pairs_without_dates(spark):
    e = events(spark, [(1, "A", 0, "x", "", ["alpha", "beta"], []), (2, "A", None, "x", "", ["alpha"], []), (3, "A", 0, "x", "", [], [])])
    c = chunks(spark, [("A", 370, "far", 1, "", "alpha beta", ""), ("A", 371, "beyond", 1, "", "alpha beta", ""), ("A", None, "undated", 1, "", "alpha alpha", ""), ("A", 1, "near", 1, "", "alpha", ""), ("A", 0, "none", 1, "", "gamma", "")])
    got = [(r.e, r["rank"], r.chunk_id, r.score, r.gap_days) for r in evidence.keyword_hits(e, c, "e", k=2).orderBy("e", "rank").collect()]
    assert got == [(1, 1, "undated", 10, None), (1, 2, "far", 9, 370), (2, 1, "undated", 10, None), (2, 2, "near", 5, None)]


def test_gaps_from_pairs_found_once(spark):
    e = events(spark, [(1, "A", 0, "x", "long enough", [], []), (2, "B", 0, "x", "abc", ["word", "words"], []), (3, "B", 0, "other", "abcd", [], []), (4, "B", None, "x", "abcd", [], [])])
    c = chunks(spark, [("A", 5, "a", 1, "zzz", "h", "pdf"), ("B", 0, "b", 1, "zzz", "word words word", "pdf"), ("B", 1, "b2", 2, "zzz", "h", "pdf")])
    got = {g.e: (g.same_day, g.near_day, g.reason) for g in evidence.pair_gaps(e, evidence.rule_pairs(e, c), "e", "other").collect()}
    assert got == {g.e: (g.same_day, g.near_day, g.reason) for g in evidence.evidence_gaps(e, c, evidence.rule_matches(e, c), "e", "other").collect()}
    assert got == {1: (0, 0, "no_nearby_chunks"), 3: (1, 2, "weak_category_terms"), 4: (0, 0, "no_nearby_chunks")}
