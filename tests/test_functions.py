"""Known answers for dates, texts and rules."""

from pyspark.sql import functions as F

from tarnflow.functions import dates, rules, text


def one(spark, column, **row):
    """The value of an expression over a single row of strings."""
    names = list(row)
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{n} string" for n in names)) if row else spark.range(1)
    return df.select(column.alias("x")).head()[0]


def test_dates(spark):
    for written, want in (("20260518", "2026-05-18"), ("2026/5/8", "2026-05-08"), ("2026年5月8日 18:00", "2026-05-08"), ("", None), ("2026-13-40", None), ("20260518.0", "2026-05-18"), (None, None)):
        assert one(spark, dates.normalize_date(F.col("a")), a=written) == want
    assert str(one(spark, dates.parse_compact(F.col("a")), a="20260518.0")) == "2026-05-18"
    assert one(spark, dates.parse_compact(F.col("a")), a="soon") is None
    assert one(spark, dates.first_date(F.col("a"), F.col("b")), a="x", b="2026-05-20") == "2026-05-20"
    assert str(one(spark, dates.week_end_friday(F.to_date(F.lit("2026-05-22"))))) == "2026-05-22"
    assert str(one(spark, dates.week_end_friday(F.to_date(F.lit("2026-05-23"))))) == "2026-05-29"


def test_amounts(spark):
    assert [round(x, 6) for x in one(spark, text.money_values(F.col("a")), a="1.12亿元 and 14200万元, 20 billion")] == [1.12, 1.42, 200.0]
    assert [round(x, 6) for x in one(spark, text.percent_values(F.col("a")), a="up 2% or -3.5 %")] == [0.02, -0.035]
    low, high = one(spark, text.profit_range(F.col("a")), a="profit -11.85亿元~-11.9亿元")
    assert (round(low, 6), round(high, 6)) == (-11.9, -11.85)
    assert one(spark, text.profit_range(F.col("a")), a="no range") is None
    low, high = one(spark, text.profit_range(F.col("a")), a="3-5 million")
    assert (round(low, 6), round(high, 6)) == (0.03, 0.05)


def test_texts(spark):
    assert one(spark, text.clean_title(F.col("a"), F.col("b")), a="Acme: new plant", b="Acme") == "new plant"
    assert one(spark, text.normalize_title(F.col("a"), ["notice"]), a="A Notice: of, things!") == "aofthings"
    assert one(spark, text.title_terms(F.col("a")), a="long-term plan; plan, long") == ["long", "term", "plan"]
    assert one(spark, text.keyword_count(F.col("a"), ["aa", "b"]), a="aaaab") == 3
    assert one(spark, text.keyword_score(F.col("a"), F.array(F.lit("aa"), F.lit(""))), a="aaaa") == 4
    assert one(spark, text.first_match(r"AN\d+", F.col("a"), F.col("b")), a="none", b="x/AN12.pdf") == "AN12"
    assert one(spark, text.md5_point_id(F.col("a")), a="x") == int("9dd4e461268c8034", 16)
    assert one(spark, text.safe_ratio(F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, text.placeholder_only(F.col("a")), a="□ yes ☑ no [x]") is True
    assert one(spark, text.snippet_center(F.col("a"), F.lit("KEY")), a="x" * 100 + "key" + "y" * 300).startswith("...xxx")
    assert one(spark, text.to_number(F.col("a")), a="n/a") is None
    assert [one(spark, text.bool_text(F.col("a")), a=x) for x in ("1", "True", "0", None)] == [True, True, False, False]


def test_rules(spark):
    x = lambda v: one(spark, rules.reaction_label(F.col("a").cast("double")), a=v)
    assert [x("0.02"), x("-0.02"), x("0.01"), x(None)] == ["positive", "negative", "neutral", None]
    assert one(spark, rules.reaction_label(F.lit(0.02), closed=False)) == "neutral"
    pledge = {"buyback": ["repurchase"], "pledge": ["pledge"]}
    kind = lambda v: one(spark, rules.compound_subtype(F.col("a"), pledge, {"buyback": ["pledged repurchase", "cancel"]}), a=v)
    assert [kind("share repurchase"), kind("pledged repurchase"), kind("cancel repurchase"), kind("repurchase and pledge"), kind(None)] == ["buyback", "pledge", "other", "compound", "other"]
    split = lambda d, s="ok": one(spark, rules.time_split(F.col("d").cast("date"), F.col("s"), F.lit(1.0), "2022-12-31", "2023-12-31")["split"], d=d, s=s)
    assert [split("2022-12-31"), split("2023-01-01"), split("2024-01-01"), split("2024-01-01", "late"), split(None)] == ["train", "valid", "test", "excluded", "excluded"]
    policy = lambda *a: one(spark, rules.sample_policy(*[F.lit(v) for v in a])["policy"])
    assert [policy(True, False, False, True, 0), policy(True, False, False, False, 3), policy(True, False, False, False, 4), policy(False, True, True, True, 0)] == ["train_clean", "train_overlap", "review_overlap", "exclude_no_label"]
    got = one(spark, rules.category(F.col("a"), {"x": ["foo"], "y": ["bar"]}), a="bar foo foo")
    assert (got["primary"], got["tags"], got["score"]) == ("x", ["x", "y"], 3)


def test_tags_of_pages(spark):
    pages = [
        '<head><meta name="keywords" content="ETL, slow query ,,ETL"></head>slow CDN', "<META NAME='Keywords' CONTENT='a；b，c'>", '<meta charset="utf-8"><p>CDN and ETL', "<meta content='it, is' name=keywords>",
        '<meta name="description" content="x,y">', "", None,
    ]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string")
    got = {r.i: r.t for r in df.select("i", text.tags(text.meta_keywords(F.col("html")), F.col("html"), ("CDN", "ETL")).alias("t")).collect()}
    assert got == {0: ["CDN", "ETL", "slow query"], 1: ["a", "b", "c"], 2: ["CDN", "ETL"], 3: ["is", "it"], 4: [], 5: [], 6: []}
