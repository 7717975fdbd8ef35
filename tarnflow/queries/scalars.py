"""Scalar functions and rules over columns of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnflow.functions import dates, rules, text
from tarnflow.operators import joins
from tarnflow.registry import query
from tarnflow.sources.tables import table

#: Rules of the examples: categories by words of a part's name or type.
CATEGORIES = {"grade": ["ECONOMY", "STANDARD"], "offer": ["PROMO"], "sized": ["SMALL", "LARGE", "MEDIUM"]}
_HAS = {k: " OR ".join(f"contains(p_type,'{w}')" for w in v) for k, v in CATEGORIES.items()}
_HITS = {k: "least(" + "+".join(f"CAST((length(p_type)-length(replace(p_type,'{w}','')))/{len(w)} AS BIGINT)" for w in v) + ",5)" for k, v in CATEGORIES.items()}


def _orders(spark, d):
    return table(spark, d, "orders")


@query("fn_parse_yyyymmdd", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS d FROM orders""")
def _(spark, d):
    written = F.when(F.col("o_orderkey") % 5 == 0, "n/a").when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyyMMdd'.0'")).otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    return _orders(spark, d).select("o_orderkey", dates.parse_compact(written).alias("d"))


@query("fn_normalize_date", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders""")
def _(spark, d):
    k, t = F.col("o_orderkey") % 4, "o_orderdate"
    written = F.when(k == 0, F.date_format(t, "yyyyMMdd")).when(k == 1, F.date_format(t, "yyyy/M/d")).when(k == 2, F.date_format(t, "yyyy年M月d日 18:00")).otherwise(F.date_format(t, "yyyy-MM-dd HH:mm"))
    return _orders(spark, d).select("o_orderkey", dates.normalize_date(written).alias("d"))


@query("fn_first_date", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders""")
def _(spark, d):
    a = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyyMMdd")).otherwise("")
    return _orders(spark, d).select("o_orderkey", dates.first_date(a, F.lit(None).cast("string"), F.date_format("o_orderdate", "yyyy/MM/dd")).alias("d"))


@query("fn_date_diff", """SELECT l_orderkey, l_linenumber, abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) AS gap FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def _(spark, d):
    both = table(spark, d, "lineitem").join(_orders(spark, d), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.select("l_orderkey", "l_linenumber", dates.date_gap(F.to_date("l_shipdate"), F.to_date("o_orderdate")).cast("long").alias("gap"))


@query("fn_clean_title", """SELECT p_partkey, CASE WHEN starts_with(p_name || ' ' || p_type, split_part(p_name,' ',1)) THEN regexp_replace(substr(p_name || ' ' || p_type, length(split_part(p_name,' ',1))+1), '^[\\s:,-]+', '') END AS t FROM part""")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", text.clean_title(F.concat_ws(" ", "p_name", "p_type"), F.element_at(F.split("p_name", " "), 1)).alias("t"))


@query("fn_title_key", """SELECT p_partkey, substr(lower(regexp_replace(p_type || p_name, '\\s+', '', 'g')),1,80) AS k FROM part""")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", text.title_key(F.concat(F.lit("2024-01-31 "), "p_type", F.lit(" 20240131"), "p_name")).alias("k"))


@query("fn_normalize_title", """SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ': ' || p_type), '\\b(?:red|small)\\b', '', 'g'), '[\\s[:punct:]]+', '', 'g') AS t FROM part""")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", text.normalize_title(F.concat_ws(": ", "p_name", "p_type"), ["red", "small"]).alias("t"))


@query("fn_title_terms", """SELECT p_partkey, array_to_string(list_filter(string_split(lower(p_type), ' '), lambda x: length(x) >= 4), '|') AS t FROM part""")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(text.title_terms(F.col("p_type")), "|").alias("t"))


@query("fn_compact_text", """SELECT doc_id, substr(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')), 1, 120) AS t FROM documents""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", text.compact_text(F.col("text"), 120).alias("t"))


@query("fn_norm_whitespace", """SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10)||chr(10), 'g'), ' ')) AS h FROM documents""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.norm_whitespace(F.col("text"))).alias("h"))


@query("fn_sha_id", """SELECT o_orderkey, substr(sha256(CAST(o_custkey AS VARCHAR) || '|' || strftime(o_orderdate,'%Y-%m-%d') || '|' || o_orderpriority),1,16) AS id FROM orders""")
def _(spark, d):
    return _orders(spark, d).select("o_orderkey", text.sha_id(F.col("o_custkey"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderpriority")).alias("id"))


@query("fn_md5_point_id", """SELECT o_orderkey, CAST(CAST(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)),1,16)) AS UBIGINT) AS VARCHAR) AS id FROM orders""")
def _(spark, d):
    return _orders(spark, d).select("o_orderkey", text.md5_point_id(F.col("o_orderkey").cast("string")).cast("string").alias("id"))


@query("fn_code_suffix", """SELECT s_suppkey, lpad(CAST(s_suppkey*7919 AS VARCHAR),6,'0') || CASE substr(lpad(CAST(s_suppkey*7919 AS VARCHAR),6,'0'),1,1) WHEN '6' THEN '.SH' WHEN '0' THEN '.SZ' WHEN '3' THEN '.SZ' ELSE '' END AS c FROM supplier""")
def _(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", text.code_suffix(F.col("s_suppkey") * 7919, {"6": ".SH", "0": ".SZ", "3": ".SZ"}).alias("c"))


@query("fn_announce_code", """SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 2 = 0 THEN 'AN' || l_orderkey WHEN l_partkey % 3 = 0 THEN NULL ELSE 'AN' || l_partkey END AS c FROM lineitem""")
def _(spark, d):
    a = F.when(F.col("l_orderkey") % 2 == 0, F.concat(F.lit("see AN"), "l_orderkey", F.lit(".pdf"))).otherwise("none")
    b = F.when(F.col("l_partkey") % 3 != 0, F.concat(F.lit("/x/AN"), "l_partkey", F.lit("/")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.first_match(r"AN\d+", a, b).alias("c"))


@query("fn_keyword_flag", """SELECT p_partkey, regexp_matches(p_type, '(?i)economy|promo') AS any_case, contains(p_type, 'economy') AS exact FROM part""")
def _(spark, d):
    c = F.col("p_type")
    return table(spark, d, "part").select("p_partkey", text.keyword_flag(c, ["economy", "promo"], True).alias("any_case"), text.keyword_flag(c, ["economy"]).alias("exact"))


@query("fn_keyword_count", """SELECT doc_id, CAST((length(text)-length(replace(text,'the','')))/3 + (length(text)-length(replace(text,'ion','')))/3 AS BIGINT) AS n FROM documents""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", text.keyword_count(F.col("text"), ["the", "ion"]).alias("n"))


@query("fn_keyword_score", """SELECT doc_id, CAST((length(text)-length(replace(text,'with','')))+(length(text)-length(replace(text,'der','')))  AS BIGINT) AS s FROM documents""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", text.keyword_score(F.col("text"), F.array(F.lit("with"), F.lit("der"))).alias("s"))


@query("fn_money_values", """SELECT o_orderkey, round(o_totalprice*0.01,6) AS a, round(round(o_totalprice/7,2)*10,6) AS b, CAST(2 AS BIGINT) AS n FROM orders""")
def _(spark, d):
    v = text.money_values(F.concat(F.lit("profit "), F.format_string("%.2f", "o_totalprice"), F.lit(" million and "), F.format_string("%.2f", F.round(F.col("o_totalprice") / 7, 2)), F.lit("billion, 3 units")))
    return _orders(spark, d).select("o_orderkey", F.round(v[0], 6).alias("a"), F.round(v[1], 6).alias("b"), F.size(v).cast("long").alias("n"))


@query("fn_percent_values", """SELECT l_orderkey, l_linenumber, round(l_discount,6) AS a, round(l_tax,6) AS b FROM lineitem""")
def _(spark, d):
    v = text.percent_values(F.concat(F.format_string("%.2f", F.col("l_discount") * 100), F.lit("% off, "), F.format_string("%.2f", F.col("l_tax") * 100), F.lit(" % tax")))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(v[0], 6).alias("a"), F.round(v[1], 6).alias("b"))


@query("fn_profit_range", """SELECT o_orderkey, round(least(o_orderkey, o_custkey)::DOUBLE * 0.01, 6) AS lo, round(greatest(o_orderkey, o_custkey)::DOUBLE * 0.01, 6) AS hi FROM orders""")
def _(spark, d):
    r = text.profit_range(F.concat(F.lit("expects a profit of "), "o_orderkey", F.lit(" ~ "), "o_custkey", F.lit(" million")))
    return _orders(spark, d).select("o_orderkey", F.round(r["low"], 6).alias("lo"), F.round(r["high"], 6).alias("hi"))


@query("fn_profit_direction", """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '5-LOW' THEN -1 WHEN '2-HIGH' THEN 1 ELSE 0 END AS s FROM orders""")
def _(spark, d):
    return _orders(spark, d).select("o_orderkey", text.direction(F.col("o_orderpriority"), ["urgent"], ["low"], ["high"], ["no such"]).alias("s"))


@query("fn_safe_ratio", """SELECT l_orderkey, l_linenumber, round(l_extendedprice / nullif(l_discount, 0), 4) AS r FROM lineitem""")
def _(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(text.safe_ratio(F.col("l_extendedprice"), F.col("l_discount")), 4).alias("r"))


@query("fn_text_signal", """SELECT doc_id, length(text) AS n_chars, CAST(length(regexp_replace(text,'[^0-9]','','g')) AS BIGINT) AS n_digits, CAST(length(text)-length(replace(text,'%','')) AS BIGINT) AS n_percent,
CAST((length(text)-length(replace(text,'License','')))/7 AS BIGINT) AS lic_count, CAST(contains(text,'License') AS INT) AS lic_has FROM documents""")
def _(spark, d):
    s = text.text_signals(F.col("text"), {"lic": ["License"]})
    return table(spark, d, "documents").select("doc_id", *[c.cast("int" if k.endswith("_has") else "long").alias(k) for k, c in s.items()])


@query("fn_bool_text", """SELECT l_orderkey, l_linenumber, l_returnflag = 'Y' OR l_linenumber = 1 AS b FROM lineitem""")
def _(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.bool_text(F.when(F.col("l_linenumber") == 1, "1.0").otherwise(F.lower("l_returnflag"))).alias("b"))


@query("fn_to_numeric", """SELECT c_custkey, try_cast(split_part(c_name, '#', 2) AS DOUBLE) AS a, try_cast(c_mktsegment AS DOUBLE) AS b FROM customer""")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.to_number(F.try_element_at(F.split("c_name", "#"), F.lit(2))).alias("a"), text.to_number(F.col("c_mktsegment")).alias("b"))


@query("fn_round_columns", """SELECT o_orderkey, round(o_totalprice, 1) AS a, round(o_totalprice / 3, 2) AS b FROM orders""")
def _(spark, d):
    return _orders(spark, d).select("o_orderkey", F.round("o_totalprice", 1).alias("a"), F.round(F.col("o_totalprice") / 3, 2).alias("b"))


@query("fn_rename_labels", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'other' END AS status FROM orders""")
def _(spark, d):
    return joins.lookup(_orders(spark, d), {"F": "finished", "O": "open"}, "o_orderstatus", "status", "other").select("o_orderkey", "status")


@query("fn_snippet_center", """SELECT doc_id, CASE WHEN p > 80 AND p - 80 > 1 THEN '...' ELSE '' END || substr(text, s, 200) || CASE WHEN s - 1 + 200 < length(text) THEN '...' ELSE '' END AS t
FROM (SELECT *, CASE WHEN p > 0 THEN greatest(p - 80, 1) ELSE 1 END AS s FROM (SELECT *, strpos(lower(text), 'license') AS p FROM documents))""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", text.snippet_center(F.col("text"), F.lit("License")).alias("t"))


@query("fn_snippet_clean", """SELECT p_partkey, substr(trim(regexp_replace(p_name || ' ' || p_type, '[ ]+', ' ', 'g')),1,200) AS t FROM part""")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", text.snippet_clean(F.concat(F.lit("[ ] "), "p_name", F.lit(" ☑  "), "p_type")).alias("t"))


@query("fn_placeholder_only", """SELECT p_partkey, length(replace(p_type,' ','')) < 20 AS b FROM part""")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", text.placeholder_only(F.concat(F.lit("□ "), "p_type")).alias("b"))


@query("fn_passage", """SELECT doc_id, md5('lang: ' || lang || chr(10) || 'source: ' || source || chr(10) || substr(text,1,500)) AS h FROM documents""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.passage({"lang": F.col("lang"), "source": F.col("source"), "none": F.lit(" ")}, F.col("text"), 500)).alias("h"))


@query("fn_excerpt", """SELECT doc_id, substr(split_part(text, ' | ', 1), 1, 240) AS t FROM documents""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", text.excerpt(F.col("text")).alias("t"))


@query("cls_category", f"""SELECT p_partkey, CASE WHEN {_HAS['grade']} THEN 'grade' WHEN {_HAS['offer']} THEN 'offer' WHEN {_HAS['sized']} THEN 'sized' ELSE 'other' END AS primary_category,
concat_ws('|', CASE WHEN {_HAS['grade']} THEN 'grade' END, CASE WHEN {_HAS['offer']} THEN 'offer' END, CASE WHEN {_HAS['sized']} THEN 'sized' END) AS tags,
CAST({' + '.join(_HITS.values())} AS BIGINT) AS score FROM part""")
def _(spark, d):
    c = rules.category(F.col("p_type"), CATEGORIES)
    return table(spark, d, "part").select("p_partkey", c["primary"].alias("primary_category"), F.array_join(c["tags"], "|").alias("tags"), c["score"].cast("long").alias("score"))


@query("cls_topics", f"""SELECT p_partkey, CASE WHEN t = '' THEN 'unclassified' ELSE t END AS topics FROM (SELECT p_partkey, concat_ws('|', CASE WHEN {_HAS['offer']} THEN 'offer' END, CASE WHEN {_HAS['sized']} THEN 'sized' END) AS t FROM part)""")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", rules.topics(F.col("p_type"), {k: CATEGORIES[k] for k in ("offer", "sized")}).alias("topics"))


@query("cls_signal_group", """SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'large' WHEN o_orderpriority = '1-URGENT' THEN 'urgent' ELSE 'plain' END AS g FROM orders""")
def _(spark, d):
    return _orders(spark, d).select("o_orderkey", rules.first_rule([(F.col("o_totalprice") > 200000, "large"), (F.col("o_orderpriority") == "1-URGENT", "urgent")], "plain").alias("g"))


@query("cls_event_subtype", """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag='R' AND l_linestatus='F' THEN 'returned' WHEN l_returnflag='N' AND l_linestatus='O' THEN 'open' ELSE 'type_' || l_returnflag END AS s FROM lineitem""")
def _(spark, d):
    f, s = F.col("l_returnflag"), F.col("l_linestatus")
    named = F.nullif(rules.first_rule([((f == "R") & (s == "F"), "returned"), ((f == "N") & (s == "O"), "open")], ""), F.lit(""))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.coalesce(named, F.concat(F.lit("type_"), f)).alias("s"))


@query("cls_capital_subtype", """SELECT p_partkey, CASE a+b WHEN 0 THEN 'other' WHEN 2 THEN 'compound' ELSE CASE WHEN a=1 THEN 'promo' ELSE 'red' END END AS s
FROM (SELECT p_partkey, CAST(contains(p_type,'PROMO') AS INT) AS a, CAST(contains(p_name,'red') AND NOT contains(p_name,'widget') AS INT) AS b FROM part)""")
def _(spark, d):
    s = rules.compound_subtype(F.concat_ws(" ", "p_type", "p_name"), {"promo": ["PROMO"], "red": ["red"]}, {"red": ["widget"]})
    return table(spark, d, "part").select("p_partkey", s.alias("s"))


@query("cls_evidence_level", """SELECT p_partkey, CASE WHEN p_size > 40 THEN 3 WHEN p_size > 25 THEN 2 WHEN p_size > 10 THEN 1 ELSE 0 END AS level, CASE WHEN p_size > 40 THEN 'strong' WHEN p_size > 25 THEN 'medium' WHEN p_size > 10 THEN 'weak' ELSE 'none' END AS label FROM part""")
def _(spark, d):
    s = F.col("p_size")
    label = rules.first_rule([(s > 40, "strong"), (s > 25, "medium"), (s > 10, "weak")], "none")
    return joins.lookup(table(spark, d, "part").withColumn("label", label), {"strong": "3", "medium": "2", "weak": "1"}, "label", "level", "0").select("p_partkey", F.col("level").cast("int").alias("level"), "label")


@query("cls_reaction_label", """SELECT l_orderkey, l_linenumber, CASE WHEN x >= 0.02 THEN 'positive' WHEN x <= -0.02 THEN 'negative' ELSE 'neutral' END AS closed, CASE WHEN x > 0.02 THEN 'positive' WHEN x < -0.02 THEN 'negative' ELSE 'neutral' END AS open
FROM (SELECT *, round(l_discount - 0.05, 4) AS x FROM lineitem)""")
def _(spark, d):
    x = F.round(F.col("l_discount") - 0.05, 4)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", rules.reaction_label(x).alias("closed"), rules.reaction_label(x, closed=False).alias("open"))


@query("cls_market_response", """SELECT l_orderkey, l_linenumber, CASE WHEN own IS NULL AND rel IS NULL THEN 'no_coverage' WHEN rel IS NULL THEN 'own_only' WHEN rel >= 0.05 THEN 'outperform' WHEN rel <= -0.05 THEN 'underperform' ELSE 'in_line' END AS r
FROM (SELECT *, CASE WHEN l_linenumber < 6 THEN l_tax END AS own, CASE WHEN l_linenumber < 5 THEN round((l_discount - 0.05) * 2, 4) END AS rel FROM lineitem)""")
def _(spark, d):
    n = F.col("l_linenumber")
    own, rel = F.when(n < 6, F.col("l_tax")), F.when(n < 5, F.round((F.col("l_discount") - 0.05) * 2, 4))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", rules.market_response(own, rel).alias("r"))


_SPLIT = """CASE WHEN o_orderstatus = 'P' THEN 'excluded' WHEN CAST(o_orderdate AS DATE) <= DATE '1998-12-31' THEN 'train' WHEN CAST(o_orderdate AS DATE) <= DATE '1999-12-31' THEN 'valid' ELSE 'test' END"""


@query("cls_time_split", f"""SELECT o_orderkey, {_SPLIT} AS split, CASE WHEN o_orderstatus = 'P' THEN 'status_not_ok' ELSE 'date_in_' || {_SPLIT} END AS reason FROM orders""")
def _(spark, d):
    status = F.when(F.col("o_orderstatus") == "P", "late").otherwise("ok")
    s = rules.time_split(F.to_date("o_orderdate"), status, F.col("o_totalprice"), "1998-12-31", "1999-12-31")
    return _orders(spark, d).select("o_orderkey", s["split"].alias("split"), s["reason"].alias("reason"))


@query("cls_sample_policy", """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN 'exclude_no_label' WHEN l_returnflag = 'A' THEN 'exclude_listing' WHEN l_quantity > 45 THEN 'exclude_mechanics' WHEN l_linenumber = 1 THEN 'train_clean' WHEN l_linenumber <= 3 THEN 'train_overlap' ELSE 'review_overlap' END AS policy FROM lineitem""")
def _(spark, d):
    n = F.col("l_linenumber")
    p = rules.sample_policy(n != 7, F.col("l_returnflag") == "A", F.col("l_quantity") > 45, n == 1, n)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", p["policy"].alias("policy"))


@query("cls_reviewed_scope", """SELECT d.doc_id, CASE WHEN l.quality = 0 THEN 'dropped' WHEN l.toxic = 1 THEN 'review' WHEN l.quality = 1 THEN 'core' ELSE 'unreviewed' END AS scope FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def _(spark, d):
    both = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return both.select("doc_id", rules.first_rule([(F.col("quality") == 0, "dropped"), (F.col("toxic") == 1, "review"), (F.col("quality") == 1, "core")], "unreviewed").alias("scope"))


@query("cls_readiness", """SELECT c_mktsegment, CASE WHEN a >= 60 AND b >= 5 THEN 'ready' WHEN a >= 20 AND b >= 3 THEN 'limited' ELSE 'not_ready' END AS readiness, 'train=' || a || ' test=' || b AS reason
FROM (SELECT c_mktsegment, count(*) FILTER (c_acctbal > 0) AS a, count(*) FILTER (c_acctbal <= 0) AS b FROM customer GROUP BY 1)""")
def _(spark, d):
    got = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count_if(F.col("c_acctbal") > 0).alias("a"), F.count_if(F.col("c_acctbal") <= 0).alias("b"))
    r = rules.readiness(F.col("a"), F.col("b"))
    return got.select("c_mktsegment", r["readiness"].alias("readiness"), r["reason"].alias("reason"))


@query("cls_coverage", """SELECT user_id, CASE WHEN n < 10 OR days < 30 THEN 'thin' ELSE 'ok' END AS status FROM (SELECT user_id, count(*) AS n, date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) AS days FROM events GROUP BY 1)""")
def _(spark, d):
    got = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.datediff(F.max("ts"), F.min("ts")).alias("days"))
    return got.select("user_id", rules.coverage_status(F.col("n"), F.col("days"))["status"].alias("status"))


@query("cls_suggested_action", """SELECT d.doc_id, CASE WHEN l.quality = 0 THEN 'drop' WHEN l.doc_id IS NULL AND n_chars > 5000 THEN 'review_first' WHEN l.doc_id IS NULL THEN 'review' ELSE 'keep' END AS action FROM documents d LEFT JOIN labels l USING (doc_id)""")
def _(spark, d):
    both = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    none = F.col("quality").isNull()
    return both.select("doc_id", rules.first_rule([(F.col("quality") == 0, "drop"), (none & (F.col("n_chars") > 5000), "review_first"), (none, "review")], "keep").alias("action"))


@query("cls_gap_reason", """SELECT c_custkey, CASE WHEN count(o_orderkey) = 0 THEN 'no_orders' WHEN max(o_totalprice) < 100000 THEN 'only_small' ELSE 'has_evidence' END AS reason FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1""")
def _(spark, d):
    got = table(spark, d, "customer").join(_orders(spark, d), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"), F.max("o_totalprice").alias("m"))
    return got.select("c_custkey", rules.first_rule([(F.col("n") == 0, "no_orders"), (F.col("m") < 100000, "only_small")], "has_evidence").alias("reason"))


@query("cls_query_enrich", """SELECT item_id, CAST(length(text)-length(replace(text,' ','')) AS BIGINT) AS n_blanks, contains(lower(text),'the ') AS is_en, contains(lower(text),' der ') AS is_de FROM benchmark""")
def _(spark, d):
    t = F.col("text")
    return table(spark, d, "benchmark").select("item_id", text.keyword_count(t, [" "]).alias("n_blanks"), text.keyword_flag(F.lower(t), ["the "]).alias("is_en"), text.keyword_flag(F.lower(t), [" der "]).alias("is_de"))


@query("flt_event_scope", """SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND NOT regexp_matches(o_orderpriority, 'NOT|LOW')""")
def _(spark, d):
    return _orders(spark, d).filter((F.col("o_orderstatus") == "F") & ~text.keyword_flag(F.col("o_orderpriority"), ["NOT", "LOW"])).select("o_orderkey")


@query("flt_payload_eq", """SELECT event_id FROM events WHERE event_type = (SELECT min(event_type) FROM events)""")
def _(spark, d):
    e = table(spark, d, "events")
    first = e.agg(F.min("event_type")).head()[0]
    return joins.equal_filters(e, {"event_type": first, "user_id": None}).select("event_id")
