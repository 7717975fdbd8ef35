"""Feature sets, dictionaries, models, explanation and inference over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnflow.functions import rules, text
from tarnflow.operators import checks, features, intensity, joins, models, reports, trees
from tarnflow.operators.windows import exact_quantiles, part_ranks, trailing_mean
from tarnflow.queries.panel import ORDERS, USERS, orders, r, users
from tarnflow.registry import query
from tarnflow.session import materialize
from tarnflow.sources.tables import table

#: Statements of a customer's quarter: how many days after its end each is announced, and its columns over the quarter's lines.
_STATEMENTS = {
    "fin": (30, {"margin": "avg(l_discount)", "tax": "avg(l_tax)"}),
    "inc": (35, {"revenue": "sum(l_extendedprice)", "income": "sum(l_extendedprice * l_discount)"}),
    "bal": (40, {"assets": "sum(l_quantity)", "liabilities": "sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END)", "current": "sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END)", "due": "sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END)"}),
    "cf": (45, {"operating": "sum(l_extendedprice * l_tax)"}),
}
_RATIOS = {"liability_to_assets": ("bal_liabilities", "bal_assets"), "current_ratio": ("bal_current", "bal_due"), "cash_to_assets": ("cf_operating", "bal_assets"), "net_margin": ("inc_income", "inc_revenue")}


def _financial_sql() -> str:
    tables = ", ".join(
        f"{n} AS (SELECT o_custkey AS k, CAST(date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS fin, CAST(date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) + {days} AS ann, {', '.join(f'{v} AS {c}' for c, v in columns.items())} FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3)"
        for n, (days, columns) in _STATEMENTS.items()
    )
    columns = [f"round({n}.{c}, 6) AS {n}_{c}" for n, (_, names) in _STATEMENTS.items() for c in names]
    ratios = [f"round({a.replace('_', '.', 1)} / nullif({b.replace('_', '.', 1)}, 0), 6) AS {r}" for r, (a, b) in _RATIOS.items()]
    joined = " ".join(f"ASOF LEFT JOIN {n} ON ord.o_custkey = {n}.k AND ord.d >= {n}.ann" for n in _STATEMENTS)
    days = ", ".join(f"date_diff('day', {n}.fin, d) AS {n}_days_since" for n in _STATEMENTS)
    return f"WITH {ORDERS}, {tables} SELECT o_orderkey, {', '.join([*columns, *ratios])}, {days} FROM ord {joined}"


@query("ft_financial", _financial_sql())
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    end = F.last_day(F.add_months(F.to_date(F.date_trunc("quarter", "l_shipdate")), 2)).alias("end")
    every = {c: F.expr(v) for _, columns in _STATEMENTS.values() for c, v in columns.items()}
    sums = lines.groupBy("o_custkey", end).agg(*[v.alias(c) for c, v in every.items()])  # one aggregation for all statements
    statements = {n: sums.select("o_custkey", "end", F.date_add("end", days).alias("announced"), *columns) for n, (days, columns) in _STATEMENTS.items()}
    out = features.latest_statements(orders(spark, d), statements, "o_custkey", "d")
    columns = [F.round(f"{n}_{c}", 6).alias(f"{n}_{c}") for n, (_, names) in _STATEMENTS.items() for c in names]
    ratios = [F.round(text.safe_ratio(F.col(a), F.col(b)), 6).alias(r) for r, (a, b) in _RATIOS.items()]
    return out.select("o_orderkey", *columns, *ratios, *[F.datediff("d", f"{n}_end").cast("long").alias(f"{n}_days_since") for n in _STATEMENTS])


#: Announcements made of orders' figures: title, summary (the title again for odd orders) and sample.
_ANNOUNCED = {
    "title": """CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN concat('预增 预计净利润', CAST(floor(o_totalprice / 100) AS BIGINT), '-', CAST(floor(o_totalprice / 50) AS BIGINT), '万')
      WHEN '2' THEN concat('首亏 预计净利润-', CAST(floor(o_totalprice / 50) AS BIGINT), '~-', CAST(floor(o_totalprice / 100) AS BIGINT), CASE WHEN o_custkey % 3 = 0 THEN '' ELSE '万' END)
      WHEN '3' THEN concat('关于回购公司股份的公告 占比 2.5% 至 ', o_custkey % 7, '%') WHEN '4' THEN concat('收到问询函 金额 ', CAST(floor(o_totalprice) AS BIGINT), '元, 下降 ', o_custkey % 50, ' %') ELSE '新产品发布' END""",
    "sample": "CASE WHEN o_orderstatus = 'F' THEN '盈利 增长 增长' WHEN o_orderstatus = 'O' THEN NULL ELSE '风险' END",
    "summary": "CASE WHEN o_orderkey % 2 = 0 THEN concat('公司拟投入, 金额不低于', o_custkey % 9 + 1, '亿元且不超过', o_custkey % 9 + 2, '.5亿元。') END",
    "size": "CASE WHEN o_custkey % 11 = 0 THEN 0 ELSE o_totalprice / 1000 END",
}


def _intensity_sql() -> str:
    flag = lambda words: "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"
    count = lambda words: "(" + " + ".join(f"(length(t) - length(replace(t, '{w}', ''))) // {len(w)}" for w in words) + ")::DOUBLE"
    scale = lambda u: "CASE " + u + " " + " ".join(f"WHEN '{k}' THEN {v!r}::DOUBLE" for k, v in intensity.UNITS.items()) + " END"
    money = rf"(?:^|[^\d])({intensity.NUMBER})\s*({intensity.UNIT})"
    number = lambda k: f"TRY_CAST(nullif(regexp_extract(t, '{intensity.PROFIT}', {k}), '') AS DOUBLE)"
    ratio = lambda a: f"{a} / nullif(size, 0)"
    facts = {
        "money_count": "len(m)::DOUBLE", "money_max": "list_max(m)", "money_sum": "list_sum(m)", "money_max_to_size": ratio("list_max(m)"),
        "percent_count": "len(p)::DOUBLE", "percent_max": "list_max(list_transform(p, lambda x: abs(x)))", "percent_mean": "list_avg(p)",
        "profit_direction": f"CASE WHEN {flag(intensity.SURE_UP)} THEN 1 WHEN {flag(intensity.SURE_DOWN)} THEN -1 WHEN {flag(intensity.UP)} AND NOT {flag(intensity.DOWN)} THEN 1 WHEN {flag(intensity.DOWN)} AND NOT {flag(intensity.UP)} THEN -1 ELSE 0 END::DOUBLE",
        "profit_low": "least(a * s, b * s)", "profit_high": "greatest(a * s, b * s)", "profit_mid": "(a * s + b * s) / 2", "profit_mid_to_size": ratio("((a * s + b * s) / 2)"),
    }
    facts = {k: f"round({v}, 6)" for k, v in facts.items()}
    facts |= {f"is_{n}": f"CAST({flag(w)} AS INT)" for n, w in intensity.TOPICS.items()} | {"positive_words": count(intensity.POSITIVE), "negative_words": count(intensity.NEGATIVE)}
    return f"""WITH o AS (SELECT o_orderkey, {", ".join(f"{v} AS {k}" for k, v in _ANNOUNCED.items())} FROM orders),
x AS (SELECT o_orderkey, size, concat_ws(' ', title, coalesce(summary, CASE WHEN o_orderkey % 4 = 1 THEN NULL END), sample) AS t FROM o),
y AS (SELECT *, list_transform(list_zip(regexp_extract_all(t, '{money}', 1), regexp_extract_all(t, '{money}', 2)), lambda z: z[1]::DOUBLE * {scale("z[2]")}) AS m, list_transform(regexp_extract_all(t, '{intensity.PERCENT}', 1), lambda n: n::DOUBLE / 100) AS p,
  {number(1)} AS a, {number(2)} AS b, nullif(regexp_extract(t, '{intensity.PROFIT}', 3), '') AS u FROM x),
z AS (SELECT *, {scale("coalesce(u, CASE WHEN greatest(abs(a), abs(b)) > 1000 THEN '万' ELSE '亿' END)")} AS s FROM y)
SELECT o_orderkey, {", ".join(f"{v} AS {k}" for k, v in facts.items())} FROM z"""


@query("ft_intensity", _intensity_sql())
def _(spark, d):
    """Odd orders of every other kind repeat their title as their summary: it counts once."""
    rows = table(spark, d, "orders").select("o_orderkey", *[F.expr(v).alias(k) for k, v in _ANNOUNCED.items()])
    rows = rows.withColumn("summary", F.coalesce("summary", F.when(F.col("o_orderkey") % 4 == 1, F.col("title"))))
    out = intensity.event_intensity(rows, ["title", "summary", "sample"], "size").drop(*_ANNOUNCED)
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query("ft_earnings_surprise", "WITH q AS (SELECT o_custkey AS k, date_trunc('quarter', o_orderdate)::DATE AS p, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2) SELECT k, p, round(CASE WHEN count(v) OVER w >= 2 THEN v - avg(v) OVER w END, 6) AS surprise FROM q WINDOW w AS (PARTITION BY k ORDER BY p ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)")
def _(spark, d):
    q = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k"), F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("p")).agg(F.sum("o_totalprice").alias("v"))
    out = trailing_mean(q, "k", "p", "v")
    return out.select("k", "p", F.round(F.col("v") - F.col("trail_mean"), 6).alias("surprise"))


_NORMAL = """x AS (SELECT o_orderkey AS row, o_custkey AS key, CAST(o_orderdate AS DATE) AS date, date_trunc('quarter', o_orderdate) AS q, 'o_totalprice' AS feature, o_totalprice AS v FROM orders
UNION ALL SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE), date_trunc('quarter', o_orderdate), 'cents', CASE WHEN o_orderkey % 5 > 0 THEN CAST(floor(o_totalprice * 100) % 100 AS DOUBLE) END FROM orders),
y AS (SELECT a.row, a.feature, (a.v - b.v) / (abs(b.v) + 1e-9) AS yoy FROM x a JOIN x b ON a.key = b.key AND a.feature = b.feature AND b.date BETWEEN a.date - 420 AND a.date - 300 WHERE a.v IS NOT NULL AND b.v IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY a.row, a.feature ORDER BY abs(date_diff('day', a.date, b.date) + 365), b.date, b.row) = 1),
n AS (SELECT *, CASE WHEN count(v) OVER p >= 3 THEN (v - avg(v) OVER p) / nullif(stddev_samp(v) OVER p, 0) END AS selfz, count(v) OVER g AS k,
  CASE WHEN v IS NOT NULL THEN (rank() OVER (PARTITION BY feature, q, v IS NULL ORDER BY v) + (count(*) OVER (PARTITION BY feature, q, v) - 1) / 2.0) END AS r, v - median(v) OVER g AS m FROM x
  WINDOW p AS (PARTITION BY key, feature ORDER BY date, row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), g AS (PARTITION BY feature, q))"""


@query("ft_normalized", f"WITH {_NORMAL} SELECT row, feature, round(selfz, 4) AS selfz, round(yoy, 4) AS yoy, round(CASE WHEN k >= 4 THEN r / k END, 6) AS xsrank, round(CASE WHEN k >= 4 THEN m END, 4) AS xsdemed FROM n LEFT JOIN y USING (row, feature)")
def _(spark, d):
    """Prices, their cents (missing for every fifth order), and a flag, which is left out."""
    o = table(spark, d, "orders").withColumn("cents", F.when(F.col("o_orderkey") % 5 > 0, F.floor(F.col("o_totalprice") * 100) % 100)).withColumn("urgent", (F.col("o_orderpriority") == "1-URGENT").cast("int"))
    out = features.normalized(o, "o_custkey", "o_orderdate", "o_orderkey", ["o_totalprice", "cents", "urgent"])
    return out.select("row", "feature", r("selfz"), r("yoy"), r("xsrank", 6), r("xsdemed"))


@query("ds_feature_master", f"WITH {ORDERS} SELECT o_orderkey, d AS as_of, round(ln(1 + o_totalprice), 6) AS log_price, CAST(o_orderpriority = '1-URGENT' AS INT) AS urgent FROM ord")
def _(spark, d):
    return orders(spark, d).select("o_orderkey", F.col("d").alias("as_of"), F.round(F.log1p("o_totalprice"), 6).alias("log_price"), (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("urgent"))


_LINE_TYPES = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
    "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
}
_LINE_ROLES = {"l_orderkey": "key", "l_extendedprice": "label"}


@query("ds_dictionary", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{t}' AS type, '{_LINE_ROLES.get(c, "feature")}' AS role, 'other' AS "group", round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_rate,
  round(coalesce(avg(CASE WHEN regexp_matches(CAST({c} AS VARCHAR), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN 1.0 ELSE 0.0 END) FILTER ({c} IS NOT NULL), 0), 6) AS date_share, '{t}' AS inferred FROM lineitem""" for c, t in _LINE_TYPES.items()
))
def _(spark, d):
    out = features.data_dictionary(table(spark, d, "lineitem"), _LINE_ROLES)
    return out.withColumns({c: F.round(c, 6) for c in ("missing_rate", "date_share")})


@query("ds_schema_contract", """SELECT '{"table":"orders","key":["o_orderkey"],"rows":' || count(*) || ',"distinct_keys":' || count(DISTINCT o_orderkey) || ',"split":{"train":' || count(*) FILTER (year(o_orderdate) < 1998)
 || ',"valid":' || count(*) FILTER (year(o_orderdate) = 1998) || ',"test":' || count(*) FILTER (year(o_orderdate) > 1998) || '},"columns":["o_orderkey","o_custkey","o_orderstatus","o_totalprice","o_orderdate","o_orderpriority"]}' AS contract FROM orders""")
def _(spark, d):
    o, year = table(spark, d, "orders"), F.year("o_orderdate")
    split = F.struct(F.count_if(year < 1998).alias("train"), F.count_if(year == 1998).alias("valid"), F.count_if(year > 1998).alias("test"))
    facts = [F.lit("orders").alias("table"), F.array(F.lit("o_orderkey")).alias("key"), F.count("*").alias("rows"), F.count_distinct("o_orderkey").alias("distinct_keys"), split.alias("split")]
    return o.agg(F.to_json(F.struct(*facts, F.array(*[F.lit(c) for c in o.columns]).alias("columns"))).alias("contract"))


@query("ds_review_template", "SELECT d.doc_id, source, length(text) AS n_chars, CASE WHEN length(text) < 200 THEN 'short' WHEN lang <> 'en' THEN 'foreign' ELSE 'open' END AS reason, CAST(NULL AS VARCHAR) AS keep_code FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, d):
    left = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left_anti")
    reason = rules.first_rule([(F.length("text") < 200, "short"), (F.col("lang") != "en", "foreign")], "open")
    return left.select("doc_id", "source", F.length("text").cast("long").alias("n_chars"), reason.alias("reason"), F.lit(None).cast("string").alias("keep_code"))


@query("ds_overlay", "WITH r AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'T' WHEN quality = 1 THEN 'K' ELSE 'X' END AS code FROM labels UNION ALL SELECT doc_id, 'K' FROM labels WHERE doc_id % 10 = 0), n AS (SELECT doc_id, count(*) AS n FROM r GROUP BY 1) SELECT r.doc_id, code, code IN ('K', 'T') AS valid, n > 1 AS duplicate, CASE WHEN n = 1 THEN CASE code WHEN 'K' THEN 'keep' WHEN 'T' THEN 'noise' END END AS decision, d.source FROM r JOIN n USING (doc_id) LEFT JOIN documents d USING (doc_id)")
def _(spark, d):
    t = table(spark, d, "labels")
    code = rules.first_rule([(F.col("toxic") == 1, "T"), (F.col("quality") == 1, "K")], "X")
    reviews = t.select("doc_id", code.alias("code")).union(t.filter("doc_id % 10 = 0").select("doc_id", F.lit("K")))
    return features.overlay(table(spark, d, "documents").select("doc_id", "source"), reviews, "doc_id", "code", {"K": "keep", "T": "noise"})


@query("ds_model_frame", f"WITH {ORDERS} SELECT o_orderkey, CASE WHEN d <= DATE '1998-12-31' THEN 'train' ELSE 'valid' END AS split, o_totalprice AS y FROM ord WHERE o_totalprice IS NOT NULL AND d <= DATE '1999-12-31'")
def _(spark, d):
    s = rules.time_split(F.col("d"), F.lit("ok"), F.col("o_totalprice"), "1998-12-31", "1999-12-31")["split"]
    return orders(spark, d).withColumn("split", s).filter(F.col("split").isin("train", "valid") & F.col("o_totalprice").isNotNull()).select("o_orderkey", "split", F.col("o_totalprice").alias("y"))


_REPRESENTATIONS = {"l_discount__raw": "l_discount", "l_discount__gap": "abs(l_discount - 0.05)", "l_tax__raw": "l_tax", "l_tax__known": "nullif(l_tax, 0)", "l_rare__raw": "CASE WHEN l_quantity > 30 THEN l_discount END", "next_price__raw": "l_extendedprice"}
_MANIFEST = "m AS (WITH x AS (" + " UNION ALL ".join(
    f"SELECT '{n.split('__')[0]}' AS feature, '{n.split('__')[1]}' AS representation, CASE WHEN year(l_shipdate) < 1999 THEN 'train' ELSE 'test' END AS split, CAST({e} AS DOUBLE) AS v, l_extendedprice AS y FROM lineitem" for n, e in _REPRESENTATIONS.items()
) + """), k AS (SELECT feature, representation, split, rank() OVER (PARTITION BY feature, representation, split ORDER BY v) + (count(*) OVER (PARTITION BY feature, representation, split, v) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY feature, representation, split ORDER BY y) + (count(*) OVER (PARTITION BY feature, representation, split, y) - 1) / 2.0 AS b FROM x WHERE v IS NOT NULL),
i AS (SELECT feature, representation, split, corr(a, b) AS ic, count(*) AS n FROM k GROUP BY 1, 2, 3),
j AS (SELECT feature, representation, max(ic) FILTER (split = 'train') AS ic_train, max(ic) FILTER (split = 'test') AS ic_test, CAST(sum(n) AS BIGINT) AS n FROM i GROUP BY 1, 2),
s AS (SELECT feature, representation, avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END) AS missing_rate FROM x GROUP BY 1, 2)
SELECT *, coalesce(ic_train * ic_test > 0, false) AS stable, row_number() OVER (PARTITION BY feature ORDER BY abs(coalesce(ic_train, 0)) DESC, representation) = 1 AS best FROM s LEFT JOIN j USING (feature, representation))"""


def _manifest(spark, d):
    lines = table(spark, d, "lineitem").withColumn("split", F.when(F.year("l_shipdate") < 1999, "train").otherwise("test"))
    lines = lines.select("split", "l_extendedprice", *[F.expr(e).cast("double").alias(n) for n, e in _REPRESENTATIONS.items()])
    return materialize(features.best_representations(features.ic_manifest(lines, list(_REPRESENTATIONS), "split", "l_extendedprice")), "manifest")


@query("ft_ic_manifest", f"WITH {_MANIFEST} SELECT feature, representation, round(missing_rate, 6) AS missing_rate, round(ic_train, 6) AS ic_train, round(ic_test, 6) AS ic_test, n, stable, best FROM m")
def _(spark, d):
    columns = [F.round(c, 6).alias(c) for c in ("missing_rate", "ic_train", "ic_test")]
    return _manifest(spark, d).select("feature", "representation", *columns, "n", "stable", "best")


@query("ds_feature_select", f"WITH {_MANIFEST} SELECT feature, representation, CAST(row_number() OVER (ORDER BY abs(ic_train) DESC NULLS LAST, feature) AS INT) AS position FROM m WHERE best AND missing_rate <= 0.5 AND feature NOT LIKE 'next%'")
def _(spark, d):
    return features.select_features(_manifest(spark, d))


_LEAKS = {"l_quantity": "l_quantity", "l_discount": "l_discount", "label_next": "l_tax", "scaled": "3 * l_extendedprice + 1"}


@query("dq_leakage", " UNION ALL ".join(f"""SELECT '{n}' AS "column", round(corr({e}, l_extendedprice), 6) AS corr, {n == 'label_next'} AS by_name, coalesce(abs(corr({e}, l_extendedprice)) >= 0.999, false) AS by_value, {n == 'label_next'} OR coalesce(abs(corr({e}, l_extendedprice)) >= 0.999, false) AS leaky FROM lineitem""" for n, e in _LEAKS.items()))
def _(spark, d):
    lines = table(spark, d, "lineitem").select("l_extendedprice", *[F.expr(e).alias(n) for n, e in _LEAKS.items()])
    return features.value_leaks(lines, "l_extendedprice", list(_LEAKS)).withColumn("corr", F.round("corr", 6))


_GROUPS = {"code": "other", "dt": "other", "value": "market", "n": "other", "ret": "market"}


@query("cls_feature_group", f"""WITH {USERS}, g AS ({" UNION ALL ".join(f"SELECT '{g}' AS \"group\", count({c}) AS n FROM users" for c, g in _GROUPS.items())}) SELECT "group", count(*) AS n_columns, CAST(sum(n) AS BIGINT) AS n_values FROM g GROUP BY 1""")
def _(spark, d):
    u = users(spark, d).select(*_GROUPS)
    counts = u.agg(*[F.count(c).alias(c) for c in u.columns]).unpivot([], u.columns, "column", "n")
    return counts.join(F.broadcast(features.column_groups(spark, u.columns)), "column").groupBy("group").agg(F.count("*").alias("n_columns"), F.sum("n").alias("n_values"))


_CHAIN = """h AS (SELECT l_orderkey AS k, count(*) AS n, min(l_partkey) AS link FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), c AS (SELECT o_custkey AS c, min(link) AS other FROM ord JOIN h ON k = o_orderkey GROUP BY 1),
e AS (SELECT o_orderkey, coalesce(link, other) AS link, link IS NULL AND other IS NOT NULL AS backfilled, CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' ELSE 'usual' END AS subtype,
  CASE WHEN n >= 3 THEN 3 WHEN n >= 1 THEN 2 WHEN other IS NOT NULL THEN 1 ELSE 0 END AS level, coalesce(n, 0) AS hits, o_totalprice, CAST(substr(o_orderpriority, 1, 1) AS INT) AS p FROM ord LEFT JOIN h ON k = o_orderkey LEFT JOIN c ON c = o_custkey)"""


@query("ev_chain", f"WITH {ORDERS}, {_CHAIN} SELECT o_orderkey, link, backfilled, subtype, level, hits, round(abs(o_totalprice / 100000 - 1) + (6 - p) + 5 * level, 6) AS score FROM e")
def _(spark, d):
    o = orders(spark, d)
    hits = table(spark, d, "lineitem").filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.min("l_partkey").alias("own_link"))
    change, priority = F.col("o_totalprice") / 100000 - 1, 6 - F.substring("o_orderpriority", 1, 1).cast("int")
    subtype = rules.first_rule([(F.col("o_orderpriority") == "1-URGENT", "urgent"), (F.col("o_orderpriority") == "2-HIGH", "high")], "usual")
    out = features.evidence_chain(o.withColumns({"subtype": subtype, "change": change, "priority": priority}), hits, "o_orderkey", "o_custkey", "n", "own_link")
    return out.select("o_orderkey", "link", "backfilled", "subtype", "level", "hits", F.round("score", 6).alias("score"))


_FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
_Z = [f"z_{f}" for f in _FEATURES]
_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
#: Places to which predictions are compared: sums in any order agree on them.
_PLACES = 9


def _lines(spark, d):
    """The lines with what a model is made of: split by year of shipping, label, features (a discount of zero counts as missing)."""
    year = F.year("l_shipdate")
    x = table(spark, d, "lineitem").withColumns({"split": F.when(year < 1998, "train").when(year < 1999, "valid").otherwise("test"), "y": F.col("l_extendedprice") / 1000})
    return x.withColumn("l_discount", F.nullif("l_discount", F.lit(0.0))).select("split", "y", "l_returnflag", *_KEYS, "l_quantity", "l_discount", "l_tax")


def _plain_frame(spark, d):
    """The lines as a modelling frame: features prepared on the training rows."""
    return models.prepare(_lines(spark, d), _FEATURES, F.col("split") == "train")


def _frame(spark, d):
    """The modelling frame with ranks of the label within splits. What is written are the columns of the lines and the ranks; prepared features are computed when read."""
    ranked = materialize(part_ranks(_lines(spark, d), ["split"], "y", "y_rank"), "frame")
    return models.prepare(ranked, _FEATURES, F.col("split") == "train")


def _each(form: str, sep: str = ", ") -> str:
    return sep.join(form.replace("#", str(i)) for i in range(1, 5))


# The frame in SQL: x1 to x4 are the features, z1 to z4 the prepared ones.
_FRAME = f"""f0 AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, CASE WHEN year(l_shipdate) < 1998 THEN 'train' WHEN year(l_shipdate) < 1999 THEN 'valid' ELSE 'test' END AS split,
  l_extendedprice / 1000 AS y, l_quantity AS x1, nullif(l_discount, 0) AS x2, l_tax AS x3, CAST(l_linenumber AS DOUBLE) AS x4 FROM lineitem),
f1 AS (SELECT f0.* REPLACE ({_each("coalesce(x#, m#) AS x#")}) FROM f0, (SELECT {_each("median(x#) AS m#")} FROM f0 WHERE split = 'train')),
f2 AS (SELECT f1.* REPLACE ({_each("greatest(least(x#, hi#), lo#) AS x#")}) FROM f1, (SELECT {_each("quantile_cont(x#, 0.01) AS lo#, quantile_cont(x#, 0.99) AS hi#")} FROM f1 WHERE split = 'train')),
fr AS (SELECT f2.*, {_each("(x# - a#) / s# AS z#")} FROM f2, (SELECT {_each("avg(x#) AS a#, stddev_samp(x#) AS s#")} FROM f2 WHERE split = 'train'))"""


def _fit(*par: tuple, rows: str = "fr", where: str = "split = 'train'") -> str:
    """A table ``fit`` of coefficients b0 to b4 for each ``(alpha, l1, features left out ...)``, by coordinate descent on covariances."""
    cov = ", ".join(f"covar_pop(z{i}, z{j}) AS c{i}{j}" for i in range(1, 5) for j in range(1, 5))
    names = "alpha, l1, use1, use2, use3, use4, b1, b2, b3, b4"
    penalties = " UNION ALL ".join(f"SELECT CAST({a} AS DOUBLE) AS alpha, CAST({l1} AS DOUBLE) AS l1, " + ", ".join(f"{i not in out} AS use{i}" for i in range(1, 5)) for a, l1, *out in par)
    step = f"SELECT it, {names} FROM cd WHERE it < 60"
    for i in range(1, 5):
        v = f"(d{i} - ({' + '.join(f'c{i}{j} * b{j}' for j in range(1, 5) if j != i)}))"
        step = f"SELECT q.* REPLACE (CASE WHEN use{i} THEN sign({v}) * greatest(abs({v}) - alpha * l1, 0) / (c{i}{i} + alpha * (1 - l1)) ELSE 0 END AS b{i}) FROM ({step}) q, gram"
    return f"""gram AS (SELECT {cov}, {_each("covar_pop(z#, y) AS d#")}, {_each("avg(z#) AS m#")}, avg(y) AS my FROM {rows} WHERE {where}),
cd AS (SELECT 0 AS it, p.*, {_each("CAST(0 AS DOUBLE) AS b#")} FROM ({penalties}) p UNION ALL SELECT it + 1, {names} FROM ({step})),
fit AS (SELECT cd.*, my - ({_each("m# * b#", " + ")}) AS b0 FROM cd, gram WHERE it = 60)"""


_SCORE = "b0 + " + _each("b# * z#", " + ")
_P = f"round({_SCORE}, {_PLACES}) AS p"


def _metrics_sql(keys: str, scored: str) -> str:
    """A table ``met`` of metrics by keys from ``y`` and ``p``."""
    rank = lambda v: f"rank() OVER (PARTITION BY {keys} ORDER BY {v}) + (count(*) OVER (PARTITION BY {keys}, {v}) - 1) / 2.0"
    return f"""met AS (SELECT {keys}, count(*) AS n, round(avg(abs(y - p)), 4) AS mae, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(1 - sum((y - p) * (y - p)) / nullif(var_pop(y) * count(*), 0), 5) AS r2,
  round(avg(CAST(sign(y) = sign(p) AS INT)), 6) AS direction, round(CASE WHEN stddev_pop(ry) > 0 AND stddev_pop(rp) > 0 THEN corr(ry, rp) ELSE 0 END, 5) AS ic
  FROM (SELECT *, {rank("y")} AS ry, {rank("p")} AS rp FROM ({scored})) GROUP BY {keys})"""


def _metrics(rows, by, y_rank="y_rank"):
    """Metrics to the places that sums in any order agree on."""
    return _rounded(features.regression_metrics(rows.withColumn("prediction", F.round("prediction", _PLACES)), by, "y", "prediction", y_rank))


def _rounded(metrics):
    return metrics.withColumns({c: F.round(c, p) for c, p in (("mae", 4), ("rmse", 4), ("r2", 5), ("direction", 6), ("ic", 5))})


def _ridge(spark, d, l1=0.0, frame=_frame):
    f = frame(spark, d)
    return f, models.fit_linear(f.filter("split = 'train'"), _Z, "y", 0.1, l1)


@query("ml_impute_clip_scale", f"WITH {_FRAME} SELECT split, count(*) AS n, {_each('round(avg(z#), 4) + 0.0 AS mean_#, round(stddev_samp(z#), 4) AS std_#')} FROM fr GROUP BY split")
def _(spark, d):
    facts = [x for i, z in enumerate(_Z, 1) for x in ((F.round(F.avg(z), 4) + 0.0).alias(f"mean_{i}"), F.round(F.stddev_samp(z), 4).alias(f"std_{i}"))]
    return _plain_frame(spark, d).groupBy("split").agg(F.count("*").alias("n"), *facts)


_WITHIN = f"""fm AS (SELECT l_returnflag AS g, avg(y) AS gy, {_each("avg(z#) AS g#")} FROM fr WHERE split = 'train' GROUP BY 1), fa AS (SELECT avg(y) AS ay, {_each("avg(z#) AS a#")} FROM fr WHERE split = 'train'),
fw AS (SELECT fr.* REPLACE (y - gy AS y, {_each("z# - g# AS z#")}) FROM fr JOIN fm ON g = l_returnflag)"""
_WITHIN_P = f"""SELECT split, y, round(coalesce(gy, ay) + {_each("b# * (z# - coalesce(g#, a#))", " + ")}, {_PLACES}) AS p FROM fr LEFT JOIN fm ON g = l_returnflag, fa, fit"""


@query("ml_ridge", f"SELECT 'plain' AS variant, * FROM (WITH RECURSIVE {_FRAME}, {_fit((0.1, 0))}, {_metrics_sql('split', f'SELECT split, y, {_P} FROM fr, fit')} SELECT * FROM met) UNION ALL SELECT 'fixed_effects', * FROM (WITH RECURSIVE {_FRAME}, {_WITHIN}, {_fit((0.1, 0), rows='fw')}, {_metrics_sql('split', _WITHIN_P)} SELECT * FROM met)")
def _(spark, d):
    f, m = _ridge(spark, d)
    fixed, _ = models.fixed_effects(f, F.col("split") == "train", _Z, "y", "l_returnflag", 0.1)
    columns = ["variant", "split", "y", "y_rank", "prediction"]
    both = m.transform(f).withColumn("variant", F.lit("plain")).select(*columns).union(fixed.withColumn("variant", F.lit("fixed_effects")).select(*columns))
    return _metrics(both, ["variant", "split"])


_GRID = [(0.01, 0.2), (0.01, 0.8), (0.05, 0.5), (0.1, 1.0)]


@query("ml_elasticnet", f"WITH RECURSIVE {_FRAME}, {_fit(*_GRID)}, {_metrics_sql('alpha, l1, split', f'SELECT alpha, l1, split, y, {_P} FROM fr, fit')} SELECT * FROM met")
def _(spark, d):
    return _rounded(models.select_linear(_frame(spark, d), _Z, "y", "split", _GRID, "y_rank", _PLACES).drop("selected"))


@query("ml_gbt")
def _(spark, d):
    f = _frame(spark, d).withColumn("is_valid", F.col("split") == "valid")
    m = models.fit_gbt(f.filter("split <> 'test'"), "y", "is_valid", 10)
    return features.regression_metrics(m.transform(f), ["split"], "y", "prediction", "y_rank")


_ALPHAS = [(0.01, 0.0), (0.1, 0.0), (1.0, 0.0)]
_BEST = f"SELECT alpha FROM (SELECT alpha, y, {_P} FROM fr, fit WHERE split = 'valid') GROUP BY 1 ORDER BY avg(abs(y - p)), alpha LIMIT 1"


@query("ml_grid_select", f"WITH RECURSIVE {_FRAME}, {_fit(*_ALPHAS)}, {_metrics_sql('alpha, split', f'SELECT alpha, split, y, {_P} FROM fr, fit')} SELECT *, alpha = ({_BEST}) AS selected FROM met")
def _(spark, d):
    return _rounded(models.select_linear(_frame(spark, d), _Z, "y", "split", _ALPHAS, "y_rank", _PLACES)).drop("l1")


@query("join_eval_best", f"WITH RECURSIVE {_FRAME}, {_fit((0.01, 0), (1.0, 0))} SELECT alpha, round(avg(abs(y - p)), 4) AS test_mae, count(*) AS n FROM (SELECT alpha, y, {_P} FROM fr, fit WHERE split = 'test') WHERE alpha = ({_BEST}) GROUP BY 1")
def _(spark, d):
    got = materialize(models.select_linear(_frame(spark, d), _Z, "y", "split", [(0.01, 0.0), (1.0, 0.0)], "y_rank", _PLACES), "grid")
    return got.filter("selected and split = 'test'").select("alpha", F.round("mae", 4).alias("test_mae"), "n")


_SETS = {"all": [], "no_quantity": [1], "no_discount_tax": [2, 3]}


@query("ml_ablation", f"WITH RECURSIVE {_FRAME}, {_fit(*[(0.1, 0, *out) for out in _SETS.values()])}, {_metrics_sql('features, split', f"SELECT CASE WHEN NOT use1 THEN 'no_quantity' WHEN NOT use2 THEN 'no_discount_tax' ELSE 'all' END AS features, split, y, {_P} FROM fr, fit")} SELECT * FROM met")
def _(spark, d):
    f = _frame(spark, d)
    found = models.moments(f.filter("split = 'train'"), _Z, "y")
    fits = {name: models.fit_moments(found, _Z, 0.1, use=[z for i, z in enumerate(_Z, 1) if i not in out]) for name, out in _SETS.items()}
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("features"), m.score().alias("prediction")) for n, m in fits.items()])).alias("x")
    return _metrics(f.select("split", "y", "y_rank", each).select("split", "y", "y_rank", "x.*"), ["features", "split"])


@query("ml_clean_only", f"WITH RECURSIVE {_FRAME}, {_fit((0.1, 0), where="split = 'train' AND l_returnflag = 'N'")}, {_metrics_sql('split', f"SELECT split, y, {_P} FROM fr, fit WHERE l_returnflag = 'N'")} SELECT * FROM met")
def _(spark, d):
    f = _plain_frame(spark, d).filter("l_returnflag = 'N'").select("split", "y", *_Z)
    f = materialize(part_ranks(f, ["split"], "y", "y_rank"), "clean")
    return _metrics(models.fit_linear(f.filter("split = 'train'"), _Z, "y", 0.1).transform(f), ["split"])


#: Values of y from which on a move is large.
_LARGE = (50, 70)


@query("ml_largemove")
def _(spark, d):
    """Logistic models with balanced class weights, one for each threshold, and their whole report by split."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    f, out = _frame(spark, d), None
    for threshold in _LARGE:
        rows = f.withColumn("large", (F.col("y") >= threshold).cast("double"))
        n = rows.filter("split = 'train'").agg(F.count("*").alias("n"), F.sum("large").alias("k")).head()
        rows = rows.withColumn("w", F.when(F.col("large") == 1, n["n"] / max(2 * n["k"], 1)).otherwise(n["n"] / max(2 * (n["n"] - n["k"]), 1)))
        m = LogisticRegression(labelCol="large", featuresCol="features", weightCol="w", regParam=0.01).fit(rows.filter("split = 'train'"))
        scored = m.transform(rows).select("split", "large", vector_to_array("probability")[1].alias("p"), F.lit(threshold).alias("threshold"))
        out = scored if out is None else out.union(scored)
    return reports.binary_report(out, ["threshold", "split"], "large", "p")


# Scores of a linear model as probabilities in hundredths, so that many are equal.
_CHANCE = f"SELECT split, y >= 50 AS large, round(1 / (1 + exp((50 - ({_SCORE})) / 10)), 2) AS p FROM fr, fit"
_REPORT_PLACES = {c: 6 for c in ("base_rate", "majority", "accuracy", "balanced", "precision", "recall", "f1", "roc_auc", "pr_auc", "acc_at_50", "acc_at_30")}
_CURVES = f"""sc AS ({_CHANCE}), v AS (SELECT split, p, count(*) AS n, count(*) FILTER (large) AS pos FROM sc GROUP BY 1, 2),
cu AS (SELECT *, sum(n) OVER w AS en, sum(pos) OVER w AS ep, sum(n) OVER g AS tn, sum(pos) OVER g AS tp FROM v WINDOW w AS (PARTITION BY split ORDER BY p), g AS (PARTITION BY split)),
ar AS (SELECT split, sum(pos * ((en - n - ep + pos) + (n - pos) / 2)) / (max(tp) * (max(tn) - max(tp))) AS roc_auc, sum(pos * ((tp - ep + pos) / (tn - en + n))) / max(tp) AS pr_auc FROM cu GROUP BY 1),
fa AS (SELECT split, round(abs(p - 0.5), 12) AS far, count(*) AS n, count(*) FILTER ((p >= 0.5) = large) AS ok FROM sc GROUP BY 1, 2),
fc AS (SELECT *, sum(n) OVER (PARTITION BY split ORDER BY far DESC) - n AS above, sum(n) OVER (PARTITION BY split) AS tn FROM fa),
co AS (SELECT split, {", ".join(f"sum(ok * greatest(least(floor(tn * {c}) - above, n), 0) / n) / max(floor(tn * {c})) AS acc_at_{round(100 * c)}" for c in (0.5, 0.3))} FROM fc GROUP BY 1),
ce AS (SELECT split, count(*) AS n, count(*) FILTER (large AND p >= 0.5) AS tp, count(*) FILTER (NOT large AND p >= 0.5) AS fp, count(*) FILTER (large AND p < 0.5) AS fn, count(*) FILTER (NOT large AND p < 0.5) AS tn FROM sc GROUP BY 1),
me AS (SELECT *, (tp + fn) / n AS base_rate, greatest(tp + fn, tn + fp) / n AS majority, (tp + tn) / n AS accuracy, (tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2 AS balanced, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1 FROM ce)"""


@query("ml_largemove_curves", f"WITH RECURSIVE {_FRAME}, {_fit((0.1, 0))}, {_CURVES} SELECT me.split, n, tp, fp, fn, tn, {', '.join(f'round({c}, {p}) AS {c}' for c, p in _REPORT_PLACES.items())} FROM me LEFT JOIN ar USING (split) LEFT JOIN co USING (split)")
def _(spark, d):
    f, m = _ridge(spark, d, frame=_plain_frame)
    p = F.round(1 / (1 + F.exp((50 - m.score()) / 10)), 2)
    out = reports.binary_report(f.select("split", (F.col("y") >= 50).alias("large"), p.alias("p")), ["split"], "large", "p")
    return out.withColumns({c: F.round(c, p) for c, p in _REPORT_PLACES.items()})


def _classes(y):
    return F.when(y < 25, 0.0).when(y < 60, 1.0).otherwise(2.0)


def _three_class(spark, d):
    """Test rows as a multinomial model with balanced class weights predicts them."""
    from pyspark.ml.classification import LogisticRegression

    f = _frame(spark, d).withColumn("cls", _classes(F.col("y")))
    counts = f.filter("split = 'train'").groupBy("cls").agg(F.count("*").alias("k"))
    weighted = f.join(F.broadcast(counts), "cls", "left").withColumn("w", 1.0 / F.coalesce("k", F.lit(1)))  # three classes
    m = LogisticRegression(labelCol="cls", featuresCol="features", weightCol="w", family="multinomial", regParam=0.01).fit(weighted.filter("split = 'train'"))
    return m.transform(weighted).filter("split = 'test'")


@query("ml_three_class")
def _(spark, d):
    return reports.class_report(_three_class(spark, d), [], "cls", "prediction")


@query("ml_three_class_matrix")
def _(spark, d):
    return _three_class(spark, d).groupBy("cls").pivot("prediction", [0.0, 1.0, 2.0]).agg(F.count("split"))


_CLS = lambda v: f"CASE WHEN {v} < 25 THEN 0.0 WHEN {v} < 60 THEN 1.0 ELSE 2.0 END"


@query("ml_class_report", f"""WITH RECURSIVE {_FRAME}, {_fit((0.1, 0))}, pr AS (SELECT split, {_CLS("y")} AS l, {_CLS("p")} AS p FROM (SELECT split, y, {_P} FROM fr, fit)),
k AS (SELECT split, l AS class FROM pr UNION SELECT split, p FROM pr), c AS (SELECT k.split, class, count(*) FILTER (l = class) AS support, count(*) FILTER (p = class) AS predicted, count(*) FILTER (l = class AND p = class) AS hits FROM k JOIN pr USING (split) GROUP BY 1, 2),
f AS (SELECT *, coalesce(hits / nullif(predicted, 0), 0) AS precision, coalesce(hits / nullif(support, 0), 0) AS recall, 2 * hits / (support + predicted) AS f1 FROM c)
SELECT split, class, support, predicted, hits, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(sum(hits) OVER w / sum(support) OVER w, 6) AS accuracy, round(avg(f1) OVER w, 6) AS macro_f1 FROM f WINDOW w AS (PARTITION BY split)""")
def _(spark, d):
    f, m = _ridge(spark, d, frame=_plain_frame)
    out = reports.class_report(m.transform(f, _PLACES).select("split", _classes(F.col("y")).alias("l"), _classes(F.col("prediction")).alias("p")), ["split"], "l", "p")
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1", "accuracy", "macro_f1")})


_REGISTRY = '{"target":"y","features":["' + '","'.join(_FEATURES) + '"],"alpha":0.1}'


@query("ml_registry", f"WITH RECURSIVE {_FRAME}, {_fit((0.1, 0))}, {_metrics_sql('split', f'SELECT split, y, {_P} FROM fr, fit')} SELECT *, '{_REGISTRY}' AS registry FROM met")
def _(spark, d):
    f, m = _ridge(spark, d)
    facts = F.to_json(F.struct(F.lit("y").alias("target"), F.array(*[F.lit(c) for c in _FEATURES]).alias("features"), F.lit(0.1).alias("alpha")))
    return _metrics(m.transform(f), ["split"]).withColumn("registry", facts)


@query("ml_registry_fitted", f"""WITH RECURSIVE {_FRAME}, {_fit(*_ALPHAS)}, {_metrics_sql('alpha, split', f'SELECT alpha, split, y, {_P} FROM fr, fit')},
n AS (SELECT count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'valid') AS n_valid, count(*) FILTER (split = 'test') AS n_test, min(y) FILTER (split = 'train') AS low, max(y) FILTER (split = 'train') AS high FROM fr)
SELECT alpha, 'y' AS target, '{",".join(_Z)}' AS features, round(b0, 5) AS intercept, {_each("round(b#, 5) + 0.0 AS b#")}, n_train, n_valid, n_test, round(low, 5) AS low, round(high, 5) AS high, alpha = ({_BEST}) AS selected,
  v.ic AS valid_ic, t.mae AS test_mae, t.rmse AS test_rmse, t.r2 AS test_r2, t.ic AS test_ic FROM fit, n LEFT JOIN met v ON v.alpha = fit.alpha AND v.split = 'valid' LEFT JOIN met t ON t.alpha = fit.alpha AND t.split = 'test'""".replace("SELECT alpha, 'y'", "SELECT fit.alpha, 'y'").replace("alpha = (SELECT", "fit.alpha = (SELECT", 1))
def _(spark, d):
    got = models.registry(_frame(spark, d), _Z, "y", "split", _ALPHAS, "y_rank", _PLACES)
    b = [(F.round(F.element_at("coefficients", i), 5) + 0.0).alias(f"b{i}") for i in range(1, 5)]
    counts = [F.coalesce(F.element_at("rows", F.lit(s)), F.lit(0)).alias(f"n_{s}") for s in ("train", "valid", "test")]
    test = [F.round(f"test.{c}", p).alias(f"test_{c}") for c, p in (("mae", 4), ("rmse", 4), ("r2", 5), ("ic", 5))]
    return got.select("alpha", "target", F.array_join("features", ",").alias("features"), F.round("intercept", 5).alias("intercept"), *b, *counts, F.round("low", 5).alias("low"), F.round("high", 5).alias("high"), "selected", F.round("valid_ic", 5).alias("valid_ic"), *test)


_KEY = "concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey)"
_PLACED = lambda what: f"row_number() OVER (ORDER BY substr(md5({what} || '|' || key), 1, 15), key)"
_DEALT = " UNION ALL ".join(f"SELECT {k} AS shuffle, '{z}' AS feature, {_PLACED(f"'7|{k}|{z}'")} AS at_, z{i} AS given FROM te" for k in range(5) for i, z in enumerate(_Z, 1))
_MIXED = " ".join(f"WHEN '{z}' THEN b{i} * (given - z{i})" for i, z in enumerate(_Z, 1))
_RANKED = "SELECT shuffle, feature, rank() OVER (PARTITION BY shuffle, feature ORDER BY y) + (count(*) OVER (PARTITION BY shuffle, feature, y) - 1) / 2.0 AS a, rank() OVER (PARTITION BY shuffle, feature ORDER BY p) + (count(*) OVER (PARTITION BY shuffle, feature, p) - 1) / 2.0 AS b FROM al"


@query("ex_permutation", f"""WITH RECURSIVE {_FRAME}, {_fit((0.1, 0))}, te AS (SELECT fr.*, fit.*, {_KEY} AS key FROM fr, fit WHERE split = 'test'), pl AS (SELECT *, {_PLACED("'7'")} AS at_ FROM te),
al AS (SELECT -1 AS shuffle, 'base' AS feature, y, round({_SCORE}, {_PLACES}) AS p FROM te UNION ALL SELECT shuffle, feature, y, round({_SCORE} + CASE feature {_MIXED} END, {_PLACES}) FROM pl JOIN ({_DEALT}) USING (at_)),
ic AS (SELECT shuffle, feature, corr(a, b) AS ic FROM ({_RANKED}) GROUP BY 1, 2)
SELECT x.feature, round(avg(b.ic - x.ic), 5) AS drop_mean, round(stddev_pop(b.ic - x.ic), 5) AS drop_std FROM ic x, ic b WHERE b.feature = 'base' AND x.feature <> 'base' GROUP BY 1""")
def _(spark, d):
    f, m = _ridge(spark, d)
    key = F.concat_ws("|", *[F.col(k).cast("string") for k in _KEYS])
    return models.permutation_drop(f.filter("split = 'test'"), m, "y", key, places=_PLACES, label_rank="y_rank").withColumns({c: F.round(c, 5) for c in ("drop_mean", "drop_std")})


@query("ex_coefficients", f"WITH RECURSIVE {_FRAME}, {_fit((0.1, 0))}, c AS ({' UNION ALL '.join(f"SELECT '{f}' AS feature, b{i} AS b FROM fit" for i, f in enumerate(_FEATURES, 1))}) SELECT feature, round(b, 6) AS coefficient, CAST(row_number() OVER (ORDER BY abs(b) DESC, feature) AS INT) AS rank FROM c")
def _(spark, d):
    _, m = _ridge(spark, d)
    order = sorted(range(4), key=lambda i: (-abs(m.coefficients[i]), _FEATURES[i]))
    return spark.createDataFrame([(_FEATURES[i], round(m.coefficients[i], 6), k + 1) for k, i in enumerate(order)], "feature string, coefficient double, rank int")


_KEY_COLUMNS = ", ".join(_KEYS)


@query("ex_waterfall", f"""WITH RECURSIVE {_FRAME}, {_fit((0.1, 0))}, te AS (SELECT fr.*, fit.*, {_P} FROM fr, fit WHERE split = 'test'),
ed AS (SELECT * FROM (SELECT * FROM te ORDER BY p, {_KEY_COLUMNS} LIMIT 10) UNION ALL SELECT * FROM (SELECT * FROM te ORDER BY p DESC, {_KEY_COLUMNS} LIMIT 10)),
c AS ({" UNION ALL ".join(f"SELECT {_KEY_COLUMNS}, '{z}' AS feature, b{i} * z{i} AS v FROM ed" for i, z in enumerate(_Z, 1))})
SELECT {_KEY_COLUMNS}, CAST(row_number() OVER (PARTITION BY {_KEY_COLUMNS} ORDER BY abs(v) DESC, feature) AS INT) AS rank, feature, round(v, 6) AS contribution FROM c QUALIFY rank <= 5""")
def _(spark, d):
    f, m = _ridge(spark, d)
    scored = m.transform(f.filter("split = 'test'"), _PLACES)
    edge = scored.orderBy("prediction", *_KEYS).limit(10).union(scored.orderBy(F.col("prediction").desc(), *_KEYS).limit(10))
    return models.contributions(edge, m, _KEYS, 5).withColumn("contribution", F.round("contribution", 6))


def _boosted(spark, d):
    """Lines with predictions of boosted trees and what each column adds to them."""
    f = _frame(spark, d).withColumn("is_valid", F.col("split") == "valid")
    m = models.fit_gbt(f.filter("split <> 'test'"), "y", "is_valid", 10)
    return trees.tree_contributions(m.transform(f), m)


@query("ex_tree_waterfall")
def _(spark, d):
    scored = materialize(_boosted(spark, d).filter("split = 'test'").select(*_KEYS, F.round("prediction", _PLACES).alias("prediction"), "parts"), "parts")
    edge = scored.orderBy("prediction", *_KEYS).limit(10).union(scored.orderBy(F.col("prediction").desc(), *_KEYS).limit(10))
    return trees.top_parts(edge, _FEATURES, _KEYS, 5)


@query("ex_tree_importance")
def _(spark, d):
    return trees.mean_sizes(_boosted(spark, d), _FEATURES, ["split"])


#: Turns of demeaning in SQL; the effects of these tables settle in fewer.
_TURNS = 40
_DEMEAN = lambda v, by: f"{v} - sum(n * {v}) OVER (PARTITION BY {by}) / sum(n) OVER (PARTITION BY {by})"


def _inference_sql(cluster: str) -> str:
    """Lines with both effects absorbed: ``w0`` the lines, ``bc`` sums per cluster and year, ``iv`` the inverse of X'X, ``k`` the number of terms."""
    turn = ", ".join(f"{_DEMEAN(v, 'g')} AS {v}" for v in "yuv")
    return f"""i0 AS (SELECT {cluster} AS g, year(l_shipdate) AS t, l_extendedprice / 1000 AS y, l_quantity AS u, nullif(l_discount, 0) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
i1 AS (SELECT g, t, y, u, coalesce(v, m) AS v FROM i0, (SELECT median(v) AS m FROM i0 WHERE t < 1998)),
ce AS (SELECT g, t, count(*)::DOUBLE AS n, avg(y) AS y, avg(u) AS u, avg(v) AS v FROM i1 GROUP BY g, t),
ab AS (SELECT 0 AS it, * FROM ce UNION ALL SELECT it + 1, g, t, n, {", ".join(f"{_DEMEAN(v, 't')} AS {v}" for v in "yuv")} FROM (SELECT it, g, t, n, {turn} FROM ab WHERE it < {_TURNS})),
ef AS (SELECT ce.g, ce.t, ce.y - ab.y AS ey, ce.u - ab.u AS eu, ce.v - ab.v AS ev FROM ce JOIN ab ON ce.g = ab.g AND ce.t = ab.t AND it = {_TURNS}),
w0 AS (SELECT i1.g, i1.t, y - ey AS y, u - eu AS u, v - ev AS v FROM i1 JOIN ef ON i1.g = ef.g AND i1.t = ef.t),
bc AS (SELECT g, t, count(*)::DOUBLE AS n, sum(y) AS sy, sum(u) AS su, sum(v) AS sv, sum(u * u) AS uu, sum(u * v) AS uv, sum(v * v) AS vv, sum(u * y) AS uy, sum(v * y) AS vy FROM w0 GROUP BY g, t),
iv AS (SELECT *, vv / (uu * vv - uv * uv) AS i00, -uv / (uu * vv - uv * uv) AS i01, uu / (uu * vv - uv * uv) AS i11, gs / (gs - 1) * (n - 1) / (n - 2 - (gs + ts - 1)) AS f
  FROM (SELECT sum(n) AS n, sum(uu) AS uu, sum(uv) AS uv, sum(vv) AS vv, sum(uy) AS uy, sum(vy) AS vy, count(DISTINCT g)::DOUBLE AS gs, count(DISTINCT t)::DOUBLE AS ts FROM bc))"""


_CLUSTERED = f"""{_inference_sql("l_suppkey")}, be AS (SELECT *, i00 * uy + i01 * vy AS b0, i01 * uy + i11 * vy AS b1 FROM iv),
sc AS (SELECT g, sum(bc.uy - bc.uu * b0 - bc.uv * b1) AS e0, sum(bc.vy - bc.uv * b0 - bc.vv * b1) AS e1 FROM bc, be GROUP BY g),
va AS (SELECT any_value(b0) AS b0, any_value(b1) AS b1, sqrt(any_value(f) * sum((i00 * e0 + i01 * e1) ** 2)) AS s0, sqrt(any_value(f) * sum((i01 * e0 + i11 * e1) ** 2)) AS s1 FROM sc, be)"""


def _inference(spark, d):
    """Lines with their supplier, region and year; a missing discount is the training median. Only the columns that inference reads."""
    year = F.year("l_shipdate")
    x = table(spark, d, "lineitem").select("l_suppkey", year.alias("year"), (F.col("l_extendedprice") / 1000).alias("y"), "l_quantity", F.nullif("l_discount", F.lit(0.0)).alias("l_discount"))
    m = exact_quantiles(x.filter("year < 1998"), [], "l_discount", {"m": 0.5})
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), "n_regionkey")
    return x.join(F.broadcast(m)).withColumn("l_discount", F.coalesce("l_discount", "m")).drop("m").join(s, "l_suppkey")  # one row


@query("inf_cluster_ols", f"WITH RECURSIVE {_CLUSTERED} " + " UNION ALL ".join(f"SELECT '{t}' AS term, round(b{i}, 6) AS coef, round(s{i}, 6) AS se, round(b{i} / s{i}, 4) AS t FROM va" for i, t in enumerate(["l_quantity", "l_discount"])))
def _(spark, d):
    out = models.cluster_ols(_inference(spark, d), "l_suppkey", "y", ["l_quantity", "l_discount"], ["l_suppkey", "year"])
    return out.withColumns({"coef": F.round("coef", 6), "se": F.round("se", 6), "t": F.round("t", 4)})


# All combinations of signs of the few clusters; the restricted model has the first column alone.
_SIGNED = f"""{_inference_sql("n_regionkey")}, gi AS (SELECT g, row_number() OVER (ORDER BY g) - 1 AS i FROM (SELECT DISTINCT g FROM bc)),
dr AS (SELECT draw, g, CASE WHEN (draw >> i) & 1 = 1 THEN -1.0 ELSE 1.0 END AS w FROM gi, (SELECT unnest(range(CAST(2 ** (SELECT count(*) FROM gi) AS BIGINT))) AS draw)),
cs AS (SELECT draw, bc.g, bc.t, bc.n, w, w * (bc.sy - iv.uy / iv.uu * bc.su) / bc.n AS r, w * (bc.uy - iv.uy / iv.uu * bc.uu) AS s0, w * (bc.vy - iv.uy / iv.uu * bc.uv) AS s1, bc.su, bc.sv, bc.uu, bc.uv, bc.vv FROM bc JOIN dr ON bc.g = dr.g, iv),
rs AS (SELECT 0 AS it, draw, g, t, n, r FROM cs UNION ALL SELECT it + 1, draw, g, t, n, {_DEMEAN("r", "draw, t")} AS r FROM (SELECT it, draw, g, t, n, {_DEMEAN("r", "draw, g")} AS r FROM rs WHERE it < {_TURNS})),
mv AS (SELECT draw, i00 * sum(s0) + i01 * sum(s1) AS d0, i01 * sum(s0) + i11 * sum(s1) AS d1 FROM cs, iv GROUP BY draw, i00, i01, i11),
us AS (SELECT cs.draw, cs.g, any_value(d1) AS d1, sum(s0 - (cs.r - rs.r) * su - cs.uu * d0 - cs.uv * d1) AS e0, sum(s1 - (cs.r - rs.r) * sv - cs.uv * d0 - cs.vv * d1) AS e1
  FROM cs JOIN rs ON cs.draw = rs.draw AND cs.g = rs.g AND cs.t = rs.t AND it = {_TURNS} JOIN mv ON cs.draw = mv.draw GROUP BY cs.draw, cs.g),
ts AS (SELECT draw, any_value(d1) / sqrt(any_value(f) * sum((i01 * e0 + i11 * e1) ** 2)) AS t FROM us, iv GROUP BY draw)"""


@query("inf_wild_bootstrap", f"WITH RECURSIVE {_SIGNED} SELECT round(max(t) FILTER (draw = 0), 4) AS t, round(avg(CAST(abs(t) >= (SELECT abs(t) FROM ts WHERE draw = 0) * (1 - 1e-9) AS INT)), 6) AS p, count(*) AS draws FROM ts")
def _(spark, d):
    out = models.wild_bootstrap(_inference(spark, d), "n_regionkey", "y", ["l_quantity", "l_discount"], "l_discount", level="year")
    return out.select(F.round("t", 4).alias("t"), F.round("p", 6).alias("p"), "draws")


@query("inf_wild_bootstrap_suppliers")
def _(spark, d):
    return models.wild_bootstrap(_inference(spark, d), "l_suppkey", "y", ["l_quantity", "l_discount"], "l_discount", level="year")
