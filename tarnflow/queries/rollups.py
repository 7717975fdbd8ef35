"""Aggregations, top lists, reshaping, feature sets and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnflow.operators import aggregates, checks, features, joins
from tarnflow.operators.windows import best_per_key, exact_quantiles, range_counts
from tarnflow.queries.panel import ORDERS, USERS, orders, users
from tarnflow.registry import query
from tarnflow.sources.tables import table


def r(c, n=4):
    return F.round(c, n).alias(c)


@query("agg_event_sources", """SELECT o_custkey, y, k.o_orderkey AS best_order, n_sources, sources, n_rows FROM (SELECT o_custkey, year(o_orderdate) AS y, count(DISTINCT o_orderpriority) AS n_sources, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS sources, count(*) AS n_rows FROM orders GROUP BY 1, 2)
JOIN (SELECT o_custkey, year(o_orderdate) AS y, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_totalprice DESC, o_orderkey) = 1) k USING (o_custkey, y)""")
def _(spark, d):
    o = table(spark, d, "orders").withColumn("y", F.year("o_orderdate").cast("long"))
    out = aggregates.merge_sources(o, ["o_custkey", "y"], "o_orderpriority", "o_totalprice", "o_orderkey")
    return out.select("o_custkey", "y", F.col("o_orderkey").alias("best_order"), "n_sources", "sources", "n_rows")


@query("agg_analysis_groups", """WITH x AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders)
SELECT o_custkey, o_orderpriority, count(*) AS n_events, round(max(o_totalprice) + 0.5 * least(count(*), 8), 4) AS group_score, string_agg(CAST(o_orderkey AS VARCHAR), ' || ' ORDER BY rn) FILTER (rn <= 6) AS titles FROM x GROUP BY 1, 2""")
def _(spark, d):
    o = table(spark, d, "orders").withColumn("title", F.col("o_orderkey").cast("string"))
    return aggregates.group_events(o, ["o_custkey", "o_orderpriority"], "title", "o_totalprice", "o_orderkey").select("o_custkey", "o_orderpriority", "n_events", r("group_score"), "titles")


@query("agg_ir_visits", """SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS objects, greatest(count(DISTINCT o_orderpriority), count(*)) AS n, least(100, 20 * count(*)) AS strength FROM orders GROUP BY 1, 2""")
def _(spark, d):
    g = orders(spark, d).groupBy("o_custkey", "d")
    return g.agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), "|").alias("objects"), F.greatest(F.count_distinct("o_orderpriority"), F.count("*")).alias("n"), F.least(F.lit(100).cast("long"), 20 * F.count("*")).alias("strength"))


@query("agg_category_impact", "SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 2) AS mean, round(median(o_totalprice), 2) AS median, round(sum(abs(o_totalprice - 100000)), 0) AS total_abs FROM orders GROUP BY 1")
def _(spark, d):
    x = F.col("o_totalprice")
    o = table(spark, d, "orders")
    sums = o.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.avg(x), 2).alias("mean"), F.round(F.sum(F.abs(x - 100000)), 0).alias("total_abs"))
    return sums.join(exact_quantiles(o, ["o_orderpriority"], "o_totalprice", {"median": 0.5}).withColumn("median", F.round("median", 2)), "o_orderpriority")


@query("agg_company_category_impact", "SELECT l_suppkey, l_returnflag, count(*) AS n, round(avg(l_extendedprice), 3) AS mean, round(max(l_extendedprice), 2) AS most FROM lineitem GROUP BY 1, 2")
def _(spark, d):
    x = "l_extendedprice"
    return table(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"), F.round(F.avg(x), 3).alias("mean"), F.round(F.max(x), 2).alias("most"))


@query("agg_status_counts", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("agg_coverage_sets", """SELECT CASE grouping_id(lang, source) WHEN 0 THEN 'both' WHEN 1 THEN 'by_lang' WHEN 2 THEN 'by_source' ELSE 'overall' END AS scope, lang, source, count(*) AS n, count(*) FILTER (h > 0) AS n_with, count(*) FILTER (h = 0) AS n_without, round(count(*) FILTER (h > 0) / count(*), 6) AS rate
FROM (SELECT d.lang, d.source, CASE WHEN l.doc_id IS NULL THEN 0 ELSE 1 END AS h FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY CUBE (lang, source)""")
def _(spark, d):
    both = table(spark, d, "documents").select("doc_id", "lang", "source").join(table(spark, d, "labels"), "doc_id", "left")
    return aggregates.coverage_sets(both.withColumn("h", F.col("quality").isNotNull().cast("int")), "lang", "source", "h").withColumn("rate", F.round("rate", 6))


@query("agg_label_distribution", """WITH x AS (SELECT 'all' AS scope, l_quantity AS q, l_extendedprice AS p FROM lineitem UNION ALL SELECT 'returned', l_quantity, l_extendedprice FROM lineitem WHERE l_returnflag = 'R'), y AS (SELECT scope, 'q' AS label, q AS v FROM x UNION ALL SELECT scope, 'p', p FROM x)
SELECT scope, label, count(v) AS n, round(avg(v), 3) AS mean, round(stddev_samp(v), 3) AS std, round(quantile_cont(v, 0.01), 4) AS p01, round(quantile_cont(v, 0.5), 4) AS p50, round(quantile_cont(v, 0.99), 4) AS p99 FROM y GROUP BY 1, 2""")
def _(spark, d):
    x = table(spark, d, "lineitem").withColumns({"q": F.col("l_quantity"), "p": F.col("l_extendedprice")})
    out = aggregates.scoped_distribution(x, {"all": F.lit(True), "returned": F.col("l_returnflag") == "R"}, ["q", "p"])
    return out.select("scope", "label", "n", r("mean", 3), r("std", 3), r("p01"), r("p50"), r("p99"))


@query("agg_category_audit", "SELECT p_brand, count(*) AS n, round(median(p_retailprice), 3) AS median, count(*) FILTER (p_size > 40) AS dirty, CASE WHEN count(*) FILTER (p_size > 40) * 5 > count(*) THEN 'high' ELSE 'low' END AS priority FROM part GROUP BY 1")
def _(spark, d):
    p = table(spark, d, "part")
    g = p.groupBy("p_brand").agg(F.count("*").alias("n"), F.count_if(F.col("p_size") > 40).alias("dirty"))
    g = g.join(exact_quantiles(p, ["p_brand"], "p_retailprice", {"median": 0.5}).withColumn("median", F.round("median", 3)), "p_brand")
    return g.withColumn("priority", F.when(F.col("dirty") * 5 > F.col("n"), "high").otherwise("low"))


@query("agg_policy_summary", "SELECT o_orderstatus, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1, 2")
def _(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus", F.year("o_orderdate").cast("long").alias("y")).agg(F.count("*").alias("n"))


@query("agg_capital_counts", "SELECT l_returnflag, count(*) AS n, count(*) FILTER (l_quantity > 25) AS n_large, count(DISTINCT CASE WHEN l_quantity > 25 THEN l_suppkey END) AS n_suppliers, median(l_quantity) AS med FROM lineitem GROUP BY 1")
def _(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if(q > 25).alias("n_large"), F.count_distinct(F.when(q > 25, F.col("l_suppkey"))).alias("n_suppliers"), F.median(q).alias("med"))


@query("agg_overlap_summary", f"WITH {ORDERS}, x AS (SELECT a.o_orderkey, a.o_orderpriority, (SELECT count(*) FROM ord b WHERE b.o_custkey = a.o_custkey AND b.o_orderkey <> a.o_orderkey AND b.d BETWEEN a.d AND a.d + 5) AS n5, (SELECT count(*) FROM ord b WHERE b.o_custkey = a.o_custkey AND b.o_orderkey <> a.o_orderkey AND b.d BETWEEN a.d AND a.d + 20) AS n20 FROM ord a) SELECT o_orderpriority, 'p5' AS w, count(*) FILTER (n5 > 0) AS dirty, count(*) FILTER (n5 = 0) AS clean FROM x GROUP BY 1 UNION ALL SELECT o_orderpriority, 'p20', count(*) FILTER (n20 > 0), count(*) FILTER (n20 = 0) FROM x GROUP BY 1")
def _(spark, d):
    out = None
    for n in (5, 20):
        o = orders(spark, d).withColumns({"start": F.col("d"), "end": F.date_add("d", n)})
        x = joins.overlap_counts(o, "o_custkey", "d", "start", "end")
        s = x.groupBy("o_orderpriority").agg(F.lit(f"p{n}").alias("w"), F.count_if(~F.col("is_clean")).alias("dirty"), F.count_if(F.col("is_clean")).alias("clean"))
        out = s if out is None else out.union(s)
    return out


@query("agg_coverage_gaps", "SELECT a.lang, b.source, count(d.doc_id) AS n, min(d.doc_id) AS first, max(d.doc_id) AS last, CASE WHEN count(d.doc_id) = 0 THEN 'missing' WHEN count(d.doc_id) < 10 THEN 'thin' ELSE 'ok' END AS status FROM (SELECT DISTINCT lang FROM documents) a CROSS JOIN (SELECT DISTINCT source FROM documents) b LEFT JOIN documents d ON d.lang = a.lang AND d.source = b.source GROUP BY 1, 2")
def _(spark, d):
    t = table(spark, d, "documents").select("doc_id", "lang", "source")
    return aggregates.dense_coverage(t, t, t, "lang", "source", "doc_id")


@query("agg_category_diag", "SELECT o_orderpriority, count(*) FILTER (o_orderdate < TIMESTAMP '1999-01-01') AS n_train, count(*) FILTER (o_orderdate >= TIMESTAMP '1999-01-01') AS n_test, round(avg(o_totalprice), 2) AS mean, round(avg(CASE WHEN o_totalprice > 150000 THEN 1.0 ELSE 0 END), 6) AS share FROM orders GROUP BY 1")
def _(spark, d):
    late = F.col("o_orderdate") >= F.lit("1999-01-01").cast("timestamp")
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count_if(~late).alias("n_train"), F.count_if(late).alias("n_test"), F.round(F.avg("o_totalprice"), 2).alias("mean"), F.round(F.avg((F.col("o_totalprice") > 150000).cast("double")), 6).alias("share"))


_Q = ", ".join(f"round(quantile_cont(l_extendedprice, {p}), 4) AS p{round(p * 100):02d}" for p in (0.05, 0.25, 0.5, 0.75, 0.95))


@query("agg_boxplot", f"SELECT l_returnflag, count(l_extendedprice) AS n, {_Q} FROM lineitem GROUP BY 1")
def _(spark, d):
    out = aggregates.distribution(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return out.select("l_returnflag", "n", *[r(f"p{p:02d}") for p in (5, 25, 50, 75, 95)])


@query("agg_histogram", """WITH e AS (SELECT quantile_cont(o_totalprice, 0.01) AS lo, quantile_cont(o_totalprice, 0.99) AS hi FROM orders), b AS (SELECT greatest(1, least(24, CAST(ceil((o_totalprice - lo) / ((hi - lo) / 24)) AS INT))) AS bin FROM orders, e)
SELECT CAST(g.i AS INT) AS bin, count(b.bin) AS n FROM range(1, 25) g(i) LEFT JOIN b ON b.bin = g.i GROUP BY 1""")
def _(spark, d):
    return aggregates.histogram(table(spark, d, "orders"), "o_totalprice").select("bin", "n")


@query("agg_reason_counts", "SELECT v AS value, count(*) AS count FROM (SELECT unnest(string_split(p_type, ' ')) AS v FROM part) WHERE v <> '' GROUP BY 1")
def _(spark, d):
    return aggregates.exploded_counts(table(spark, d, "part"), "p_type", " ")


@query("agg_review_summary", "SELECT m AS metric, v AS value FROM (SELECT count(*) AS labelled, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic FROM labels) UNPIVOT (v FOR m IN (labelled, good, toxic))")
def _(spark, d):
    one = table(spark, d, "labels").agg(F.count("*").alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"))
    return one.unpivot([], ["labelled", "good", "toxic"], "metric", "value")


@query("agg_missingness", """SELECT 'quality' AS "column", count(*) AS rows, count(*) FILTER (quality IS NULL) AS missing, round(count(*) FILTER (quality IS NULL) / count(*), 6) AS rate FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT 'lang', count(*), count(*) FILTER (lang IS NULL), round(count(*) FILTER (lang IS NULL) / count(*), 6) FROM documents LEFT JOIN labels USING (doc_id)""")
def _(spark, d):
    both = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return aggregates.missingness(both, ["quality", "lang"]).withColumn("rate", F.round("rate", 6))


@query("agg_evidence_summary", "SELECT o_custkey, count(*) AS n, min_by(o_orderkey, (-o_totalprice, o_orderkey)) AS best FROM orders GROUP BY 1")
def _(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.min_by("o_orderkey", F.struct((-F.col("o_totalprice")).alias("a"), "o_orderkey")).alias("best"))


@query("agg_group_evidence", """SELECT o_custkey, CAST(sum(n) AS BIGINT) AS hits, count(*) AS n_groups, string_agg(o_orderpriority, '|' ORDER BY o_orderpriority) FILTER (rn <= 3) AS refs FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) AS rn FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)) GROUP BY 1""")
def _(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    top = best_per_key(g, ["o_custkey"], [F.col("n").desc(), F.col("o_orderpriority")], 3).groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list("o_orderpriority")), "|").alias("refs"))
    return g.groupBy("o_custkey").agg(F.sum("n").alias("hits"), F.count("*").alias("n_groups")).join(top, "o_custkey")


@query("agg_chunk_experiment", "SELECT w AS width, count(*) AS docs, CAST(sum(ceil(length(text) / w)) AS BIGINT) AS chunks FROM documents, (SELECT unnest([400, 1200, 1800]) AS w) GROUP BY 1")
def _(spark, d):
    lengths = table(spark, d, "documents").select(F.length("text").alias("n"))
    strategies = F.explode(F.array(*[F.lit(w) for w in (400, 1200, 1800)])).alias("width")
    return lengths.select("n", strategies).groupBy("width").agg(F.count("*").alias("docs"), F.sum(F.ceil(F.col("n") / F.col("width"))).cast("long").alias("chunks"))


@query("agg_quality_kpis", "SELECT count(*) AS docs, count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents")
def _(spark, d):
    return table(spark, d, "documents").agg(F.count("*").alias("docs"), F.count_distinct("source").alias("sources"), F.count_distinct("lang").alias("langs"), F.sum(F.length("text")).alias("chars"))


@query("agg_inventory", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, min(ts) AS first, max(ts) AS last FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 12")
def _(spark, d):
    g = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return g.orderBy(F.col("n").desc(), "event_type").limit(12)


@query("agg_event_distribution", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ROLLUP (user_id, event_type)")
def _(spark, d):
    return table(spark, d, "events").rollup("user_id", "event_type").agg(F.count("*").alias("n"))


@query("agg_category_mean", "WITH t AS (SELECT o_custkey, avg(o_totalprice) AS m FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1) SELECT o_orderkey, round(coalesce(m, (SELECT avg(o_totalprice) FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01')), 6) AS group_mean FROM orders LEFT JOIN t USING (o_custkey)")
def _(spark, d):
    early = F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp")
    return aggregates.group_mean_with_fallback(table(spark, d, "orders"), early, "o_custkey", "o_totalprice").select("o_orderkey", r("group_mean", 6))


@query("agg_distinct_fields", "SELECT DISTINCT p_brand, p_size FROM part ORDER BY 1, 2 LIMIT 100")
def _(spark, d):
    return table(spark, d, "part").select("p_brand", "p_size").distinct().orderBy("p_brand", "p_size").limit(100)


@query("agg_count", "SELECT count(*) AS n FROM embeddings")
def _(spark, d):
    return table(spark, d, "embeddings").agg(F.count("*").alias("n"))


@query("dedup_best_pdf", "SELECT o_custkey, d, o_orderkey FROM (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, o_orderkey, row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY o_orderstatus = 'F' DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def _(spark, d):
    o = table(spark, d, "orders").withColumn("d", F.to_date("o_orderdate"))
    return best_per_key(o, ["o_custkey", "d"], [(F.col("o_orderstatus") == "F").desc(), F.col("o_orderkey")]).select("o_custkey", "d", "o_orderkey")


@query("dedup_first", "SELECT md5(text) AS h, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def _(spark, d):
    return table(spark, d, "documents").groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("doc_id"))


@query("dedup_signature", "SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source, substr(text, 1, 100) ORDER BY doc_id) = 1")
def _(spark, d):
    return aggregates.drop_repeated(table(spark, d, "documents"), ["source"], F.substring("text", 1, 100), [F.col("doc_id")]).select("source", "doc_id")


@query("top_events", "(SELECT 'most' AS list, o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100) UNION ALL (SELECT 'least', o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 100)")
def _(spark, d):
    o = table(spark, d, "orders")
    a = o.orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(100).select(F.lit("most").alias("list"), "o_orderkey")
    return a.union(o.orderBy("o_totalprice", "o_orderkey").limit(100).select(F.lit("least"), "o_orderkey"))


@query("top_chain", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag = 'R' ORDER BY l_discount DESC, l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 100")
def _(spark, d):
    rows = table(spark, d, "lineitem").filter("l_returnflag = 'R'").orderBy(F.col("l_discount").desc(), F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber", "l_partkey")
    return rows.limit(100).select("l_orderkey", "l_linenumber", "l_partkey")


@query("top_review_queue", "WITH q AS (SELECT quantile_cont(o_totalprice, 0.9) AS hi, quantile_cont(o_totalprice, 0.1) AS lo FROM orders) SELECT o_orderkey, concat_ws('|', CASE WHEN o_totalprice >= hi THEN 'large' END, CASE WHEN o_totalprice <= lo THEN 'small' END, CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' END) AS reasons FROM orders, q WHERE o_totalprice >= hi OR o_totalprice <= lo OR o_orderpriority = '1-URGENT' ORDER BY o_totalprice DESC, o_orderkey LIMIT 360")
def _(spark, d):
    o = table(spark, d, "orders")
    q = exact_quantiles(o, [], "o_totalprice", {"lo": 0.1, "hi": 0.9})
    x = F.col("o_totalprice")
    tags = F.array_compact(F.array(F.when(x >= F.col("hi"), F.lit("large")), F.when(x <= F.col("lo"), F.lit("small")), F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("urgent"))))
    rows = o.join(F.broadcast(q)).withColumn("tags", tags).filter(F.size("tags") > 0)  # one row of thresholds
    return rows.orderBy(x.desc(), "o_orderkey").limit(360).select("o_orderkey", F.array_join("tags", "|").alias("reasons"))


@query("top_review_template", "SELECT o_orderkey, concat_ws(' ', o_orderpriority, o_orderstatus) AS evidence, CAST(NULL AS VARCHAR) AS keep_code FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def _(spark, d):
    rows = table(spark, d, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(100)
    return rows.select("o_orderkey", F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("evidence"), F.lit(None).cast("string").alias("keep_code"))


@query("top_errors", "SELECT o_orderkey FROM orders ORDER BY abs(o_totalprice - (SELECT avg(o_totalprice) FROM orders)) DESC, o_orderkey LIMIT 20")
def _(spark, d):
    o = table(spark, d, "orders")
    return o.join(F.broadcast(o.agg(F.avg("o_totalprice").alias("m")))).orderBy(F.abs(F.col("o_totalprice") - F.col("m")).desc(), "o_orderkey").limit(20).select("o_orderkey")


@query("top_hits", "SELECT o_custkey, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderdate, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def _(spark, d):
    return best_per_key(table(spark, d, "orders"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderdate"), F.col("o_orderkey")], 3, "rank").select("o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank"))


@query("top_abs_change", f"WITH {USERS} SELECT code, dt FROM users WHERE ret IS NOT NULL ORDER BY abs(round(ret, 6)) DESC, code, dt LIMIT 300")
def _(spark, d):
    return users(spark, d).filter("ret is not null").orderBy(F.abs(F.round("ret", 6)).desc(), "code", "dt").limit(300).select("code", "dt")


@query("top_notice_candidates", "SELECT min(p_partkey) AS p_partkey, p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part WHERE contains(p_type, 'S')) WHERE rn <= 80 GROUP BY p_name")
def _(spark, d):
    rows = best_per_key(table(spark, d, "part").filter(F.contains("p_type", F.lit("S"))), ["p_brand"], [F.col("p_partkey")], 80)
    return rows.groupBy("p_name").agg(F.min("p_partkey").alias("p_partkey"))


@query("top_paging", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def _(spark, d):
    return table(spark, d, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").offset(50).limit(25).select("o_orderkey")


@query("smp_recheck", "SELECT DISTINCT o_orderkey FROM ((SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 8) UNION ALL (SELECT o_orderkey FROM orders ORDER BY o_custkey DESC, o_orderkey LIMIT 6) UNION ALL (SELECT o_orderkey FROM orders ORDER BY o_custkey, o_orderkey LIMIT 6) UNION ALL (SELECT o_orderkey FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '7'), o_orderkey LIMIT 10))")
def _(spark, d):
    return aggregates.stratified_sample(table(spark, d, "orders"), "o_orderkey", "o_totalprice", "o_custkey")


@query("set_union_sources", "SELECT o_custkey AS id, o_totalprice AS v, CAST(NULL AS VARCHAR) AS seg, 'order' AS source FROM orders UNION ALL SELECT c_custkey, c_acctbal, c_mktsegment, 'customer' FROM customer")
def _(spark, d):
    a = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("v"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"), F.col("c_mktsegment").alias("seg"))
    return aggregates.union_sources({"order": a, "customer": b})


@query("set_union_ledger", "SELECT id, min(source) AS source FROM (SELECT o_custkey AS id, 'order' AS source FROM orders UNION ALL SELECT user_id, 'event' FROM events) GROUP BY 1")
def _(spark, d):
    both = aggregates.union_sources({"order": table(spark, d, "orders").select(F.col("o_custkey").alias("id")), "event": table(spark, d, "events").select(F.col("user_id").alias("id"))})
    return both.groupBy("id").agg(F.min("source").alias("source"))


@query("set_symmetric_diff", "SELECT coalesce(c_custkey, user_id) AS k, CASE WHEN user_id IS NULL THEN 'left_only' ELSE 'right_only' END AS side FROM (SELECT DISTINCT c_custkey FROM customer) FULL JOIN (SELECT DISTINCT user_id FROM events) ON c_custkey = user_id WHERE c_custkey IS NULL OR user_id IS NULL")
def _(spark, d):
    return aggregates.symmetric_difference(table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "events").select(F.col("user_id").alias("k")), "k")


@query("rs_onehot", "SELECT doc_id, CAST(lang = 'en' AS INT) AS lang_en, CAST(lang = 'de' AS INT) AS lang_de FROM documents")
def _(spark, d):
    return aggregates.one_hot(table(spark, d, "documents"), "lang", ["en", "de"], "lang").select("doc_id", "lang_en", "lang_de")


@query("rs_pivot", "SELECT CAST(ts AS DATE) AS dt, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY 1")
def _(spark, d):
    out = table(spark, d, "events").groupBy(F.to_date("ts").alias("dt")).pivot("event_type", ["click", "view"]).agg(F.count("event_id"))
    return out.select("dt", F.coalesce("click", F.lit(0)).alias("click"), F.coalesce("view", F.lit(0)).alias("view"))


@query("rs_multi_window", f"WITH {USERS} SELECT code, dt, round(coalesce(sum(value) OVER (PARTITION BY code ORDER BY dt ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING), 0), 4) AS sum_p5, round(coalesce(sum(value) OVER (PARTITION BY code ORDER BY dt ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 0), 4) AS sum_m1 FROM users")
def _(spark, d):
    from tarnflow.operators.windows import event_sums

    return event_sums(users(spark, d), "code", "dt", "value", {"p5": (0, 5), "m1": (-1, 1)}).select("code", "dt", r("sum_p5"), r("sum_m1"))


@query("rs_explode_sources", "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY 1")
def _(spark, d):
    return table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("ft_management", "WITH e AS (SELECT user_id, CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, d, " + ", ".join(f"CAST(coalesce(sum(n) OVER (PARTITION BY user_id ORDER BY d RANGE BETWEEN INTERVAL {k} DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING), 0) AS BIGINT) AS n_{k}d" for k in (30, 90, 180)) + " FROM e")
def _(spark, d):
    e = table(spark, d, "events").select("user_id", F.to_date("ts").alias("d"))
    return range_counts(e.distinct(), e, "user_id", "d", "d", [30, 90, 180])


_IC = """WITH x AS (SELECT l_returnflag, (rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0) AS a, (rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0) AS b FROM lineitem)
SELECT l_returnflag, count(*) AS n, round(corr(a, b), 6) AS ic FROM x GROUP BY 1"""


@query("ml_ic_by_group", _IC)
def _(spark, d):
    return features.rank_correlation(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice").select("l_returnflag", "n", r("ic", 6))


@query("ml_metrics", "SELECT l_returnflag, count(*) AS n, round(avg(abs(e)), 2) AS mae, round(sqrt(avg(e * e)), 2) AS rmse FROM (SELECT l_returnflag, l_extendedprice - 1500 * l_quantity AS e FROM lineitem) GROUP BY 1")
def _(spark, d):
    x = table(spark, d, "lineitem").withColumn("p", 1500 * F.col("l_quantity"))
    return features.regression_metrics(x, ["l_returnflag"], "l_extendedprice", "p").select("l_returnflag", "n", r("mae", 2), r("rmse", 2))


@query("ml_target_winsor", "WITH q AS (SELECT quantile_cont(o_totalprice, 0.01) AS lo, quantile_cont(o_totalprice, 0.99) AS hi FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01') SELECT o_orderkey, round(greatest(least(o_totalprice, hi), lo), 4) AS y FROM orders, q")
def _(spark, d):
    out = features.winsorised(table(spark, d, "orders"), "o_totalprice", F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp"))
    return out.select("o_orderkey", F.round("o_totalprice_clipped", 4).alias("y"))


@query("ml_dummy_mean", "SELECT o_orderkey, round((SELECT avg(o_totalprice) FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'), 4) AS p FROM orders")
def _(spark, d):
    o = table(spark, d, "orders")
    m = o.filter(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp")).agg(F.round(F.avg("o_totalprice"), 4).alias("p"))
    return o.select("o_orderkey").join(F.broadcast(m))


@query("ds_event_master", "SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS event_date, o_orderstatus = 'F' AS is_final FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("event_date"), (F.col("o_orderstatus") == "F").alias("is_final"))


@query("ds_label_master", f"WITH {USERS}, {'m AS (SELECT dt, avg(ret) AS m FROM users GROUP BY 1)'} SELECT code, dt, round(ret - m, 4) AS relative FROM users JOIN m USING (dt)")
def _(spark, d):
    u = users(spark, d)
    return u.join(u.groupBy("dt").agg(F.avg("ret").alias("m")), "dt").select("code", "dt", F.round(F.col("ret") - F.col("m"), 4).alias("relative"))


@query("ds_split_master", "SELECT y, split, count(*) AS n FROM (SELECT year(o_orderdate) AS y, CASE WHEN o_orderdate < TIMESTAMP '1999-01-01' THEN 'train' WHEN o_orderdate < TIMESTAMP '2000-01-01' THEN 'valid' ELSE 'test' END AS split FROM orders) GROUP BY 1, 2")
def _(spark, d):
    from tarnflow.functions.rules import time_split

    s = time_split(F.to_date("o_orderdate"), F.lit("ok"), F.col("o_totalprice"), "1998-12-31", "1999-12-31")["split"]
    return table(spark, d, "orders").groupBy(F.year("o_orderdate").cast("long").alias("y"), s.alias("split")).agg(F.count("*").alias("n"))


def _check(sql):
    return f"SELECT c AS \"check\", CASE WHEN n = 0 THEN 'pass' ELSE 'fail' END AS status FROM ({sql})"


@query("dq_unique_key", _check("SELECT 'unique_key' AS c, count(*) AS n FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)"))
def _(spark, d):
    return checks.unique_key(table(spark, d, "orders"), ["o_orderkey"]).select("check", "status")


@query("dq_key_alignment", _check("SELECT 'key_alignment' AS c, count(*) AS n FROM ((SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents))"))
def _(spark, d):
    diff = aggregates.symmetric_difference(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id"), "doc_id")
    return checks.key_alignment(diff).select("check", "status")


@query("dq_point_in_time", _check("SELECT 'point_in_time' AS c, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate > l_shipdate OR l_shipdate IS NULL"))
def _(spark, d):
    both = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return checks.point_in_time(both, "o_orderdate", "l_shipdate").select("check", "status")


@query("dq_split_policy", "SELECT 'split_policy' AS \"check\", CASE WHEN min(o_orderdate) < TIMESTAMP '1999-01-01' AND max(o_orderdate) >= TIMESTAMP '2000-01-01' THEN 'pass' ELSE 'fail' END AS status FROM orders")
def _(spark, d):
    y = F.year("o_orderdate")
    o = table(spark, d, "orders").withColumn("split", F.when(y < 1999, "train").when(y < 2000, "valid").otherwise("test"))
    return checks.split_policy(o, "split", "o_orderdate", ["train", "valid", "test"]).select("check", "status")


@query("dq_label_alignment", _check("SELECT 'label_alignment' AS c, count(*) AS n FROM documents WHERE lang = 'en' AND doc_id NOT IN (SELECT doc_id FROM labels)"))
def _(spark, d):
    return checks.label_alignment(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id", F.col("lang") == "en").select("check", "status")


@query("dq_required_columns", "SELECT 'required_columns' AS \"check\", 'fail' AS status, 'missing: no_such; rows: ' || count(*) AS detail FROM orders")
def _(spark, d):
    return checks.required_columns(table(spark, d, "orders"), ["o_orderkey", "no_such"])


@query("dq_outputs", _check("SELECT 'outputs' AS c, CAST(max(o_orderdate) > TIMESTAMP '2030-01-01' AS INT) AS n FROM orders"))
def _(spark, d):
    return checks.outputs(table(spark, d, "orders"), "o_custkey", "o_orderdate", "2030-01-01").select("check", "status")


@query("inventory_rollup", "SELECT l_linestatus, l_returnflag, count(*) AS n, count(*) FILTER (l_quantity IS NULL) AS errors FROM lineitem GROUP BY ROLLUP (l_linestatus, l_returnflag)")
def _(spark, d):
    return table(spark, d, "lineitem").rollup("l_linestatus", "l_returnflag").agg(F.count("*").alias("n"), F.count_if(F.col("l_quantity").isNull()).alias("errors"))


@query("probe_quality", "SELECT event_type, count(*) AS n, min(CAST(ts AS DATE)) AS first, max(CAST(ts AS DATE)) AS last, count(*) FILTER (value < 0) AS n_negative FROM events GROUP BY 1")
def _(spark, d):
    dt = F.to_date("ts")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.min(dt).alias("first"), F.max(dt).alias("last"), F.count_if(F.col("value") < 0).alias("n_negative"))


@query("src_cache_or_parse", "SELECT d.doc_id FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, d):
    from tarnflow.sources.files import unseen

    return unseen(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id").select("doc_id")


@query("sink_upsert", "SELECT o_orderkey, CASE WHEN l IS NULL THEN o_totalprice ELSE l END AS v FROM orders LEFT JOIN (SELECT l_orderkey, max_by(l_extendedprice, (l_shipdate, l_extendedprice)) AS l FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def _(spark, d):
    from tarnflow.operators.retrieval import upsert

    base = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("v"), F.struct(F.lit(None).cast("timestamp").alias("a"), F.lit(None).cast("double").alias("b")).alias("at"))
    fresh = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").alias("v"), F.struct(F.col("l_shipdate").alias("a"), F.col("l_extendedprice").alias("b")).alias("at"))
    fresh = fresh.join(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", "left_semi")
    return upsert(base, fresh, "o_orderkey", "at").select("o_orderkey", "v")
