"""Known answers for windows, joins, aggregates, checks, chunks and streams."""

import datetime as dt
import os

from pyspark.sql import functions as F

from tarnflow.operators import aggregates, checks, chunking, features, joins, models, retrieval, windows
from tarnflow.sources import files
from tarnflow.streaming import sessions

D = lambda s: dt.date.fromisoformat(s)


def panel(spark, rows):
    return spark.createDataFrame(rows, "code string, dt date, ret double")


def test_window_is_clipped_at_the_end(spark):
    p = panel(spark, [("a", D("2024-01-01"), 5.0), ("a", D("2024-01-02"), 0.01), ("a", D("2024-01-03"), None), ("a", D("2024-01-04"), -0.01)])
    got = windows.event_sums(p, "code", "dt", "ret", {"w": (0, 5)}).filter("dt = '2024-01-02'").head()
    assert (round(got.sum_w, 9), got.actual_w, got.expected_w) == (0.0, 3, 6)
    last = windows.event_sums(p, "code", "dt", "ret", {"w": (1, 5)}).filter("dt = '2024-01-04'").head()
    assert (last.sum_w, last.actual_w) == (0.0, 0)


def test_rank_and_mean_of_the_others(spark):
    rows = [("A", D("2024-01-01"), 0.10), ("B", D("2024-01-01"), -0.10), ("C", D("2024-01-01"), 0.05), ("E", D("2024-01-01"), None)]
    got = {r.code: r for r in windows.cross_rank(panel(spark, rows), ["dt"], "ret").collect()}
    assert (got["A"]["rank"], got["A"].n, round(got["A"].others_mean, 6), got["A"].percentile) == (1, 3, -0.025, 1.0)
    assert got["E"]["rank"] is None and got["E"].others_mean is None
    both = {r.code: r.peer_mean for r in windows.peer_mean_ex_self(panel(spark, rows), ["dt"], "ret").collect()}
    assert round(both["A"], 6) == -0.025 and round(both["E"], 6) == round(0.05 / 3, 6)
    assert windows.peer_mean_ex_self(panel(spark, rows), ["dt"], "ret", needs_own=True).filter("code = 'E'").head().peer_mean is None
    assert windows.peer_mean_ex_self(panel(spark, rows[:1]), ["dt"], "ret").head().peer_mean is None


def test_ranks_of_values_that_differ_when_computed_again(spark):
    again = F.udf(lambda i: i + int.from_bytes(os.urandom(4)) / 2**33, "double").asNondeterministic()  # like a sum whose parts arrive in any order
    df = spark.range(40).select(F.lit("g").alias("g"), "id").repartition(4).withColumn("x", again("id"))
    got = windows.cross_rank(df, ["g"], "x").orderBy("id").collect()
    assert [r["rank"] for r in got] == list(range(40, 0, -1)) and all(r.n == 40 for r in got)
    assert [round(40 * r.pct_rank) for r in windows.percentile_rank(df, ["g"], "x").orderBy("id").collect()] == list(range(1, 41))


def test_trailing_needs_half_of_the_window(spark):
    p = panel(spark, [("a", D(f"2024-01-0{i}"), float(i)) for i in range(1, 7)])
    got = [r.ret_mean5 for r in windows.trailing(p, "code", "dt", "ret", (5,)).orderBy("dt").collect()]
    assert got == [None, None, 1.5, 2.0, 2.5, 3.0]


def test_as_of_joins(spark):
    left = spark.createDataFrame([("a", D("2024-01-05"), 1), ("a", D("2024-01-01"), 2), ("b", D("2024-01-05"), 3), ("a", None, 4)], "k string, d date, i int")
    right = spark.createDataFrame([("a", D("2024-01-02"), 10), ("a", D("2024-01-05"), 20), ("a", D("2024-01-05"), 30), ("a", D("2024-01-09"), 40)], "k string, e date, v int")
    back = {r.i: (r.v, r.days_since) for r in joins.asof_backward(left, right, "k", "d", "e", ["v"], ["v"]).collect()}
    assert back == {1: (30, 0), 2: (None, None), 3: (None, None), 4: (None, None)}
    strict = {r.i: r.v for r in joins.asof_backward(left, right, "k", "d", "e", ["v"], ["v"], strict=True).collect()}
    assert strict == {1: 10, 2: None, 3: None, 4: None}
    fwd = {r.i: (str(r.aligned_date), r.status) for r in joins.align_forward(left, right.dropDuplicates(["k", "e"]), "k", "d", "e").collect()}
    assert fwd == {1: ("2024-01-05", "ok"), 2: ("2024-01-02", "before_first"), 3: ("None", "no_key"), 4: ("None", "bad_date")}
    late = spark.createDataFrame([("a", D("2025-01-01"), 9)], "k string, d date, i int")
    assert joins.align_forward(late, right.dropDuplicates(["k", "e"]), "k", "d", "e").head().status == "after_last"


def test_overlap_leaves_itself_out(spark):
    rows = [("a", i, D(d), D(d) - dt.timedelta(days=1), D(d) + dt.timedelta(days=5), c) for i, d, c in ((1, "2024-01-01", "x"), (2, "2024-01-06", "y"), (3, "2024-02-01", "x"))]
    df = spark.createDataFrame(rows, "k string, i int, d date, s date, e date, c string")
    got = {r.i: (r.n_overlap, r.is_clean) for r in joins.overlap_counts(df, "k", "d", "s", "e").collect()}
    assert got == {1: (1, False), 2: (0, True), 3: (0, True)}


def test_range_pairs_and_counts_against_brute_force(spark):
    import random

    rng = random.Random(3)
    day = lambda: D("2024-01-01") + dt.timedelta(days=rng.randrange(90))
    a, b = [(rng.choice("xy"), day(), i) for i in range(60)], [(rng.choice("xy"), day(), i) for i in range(80)]
    left, right = spark.createDataFrame(a, "k string, d date, i int"), spark.createDataFrame(b, "k string, e date, j int")
    got = sorted((r.i, r.j) for r in joins.range_pairs(left, right, "k", "d", "e", -4, 7, 5).collect())
    assert got == sorted((i, j) for k, d, i in a for m, e, j in b if k == m and -4 <= (e - d).days <= 7)
    counts = {r.i: r.n_30d for r in windows.range_counts(left, right, "k", "d", "e", (30,)).collect()}
    assert counts == {i: sum(k == m and -30 <= (e - d).days < 0 for m, e, _ in b) for k, d, i in a}


def test_buckets_and_ranks(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(11)] + [(99, None)], "i int, x double")
    got = {r.i: r.bucket for r in windows.quantile_buckets(df.withColumn("g", F.lit(None).cast("string")), "x", "i", 5, ["g"]).collect()}
    assert got[0] == 1 and got[10] == 5 and got[99] is None and [got[i] for i in (2, 3, 4, 5)] == [1, 2, 2, 3]
    ties = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 2.0), (4, 3.0)], "i int, x double").withColumn("g", F.lit(1))
    assert [r.k for r in windows.average_ranks(ties, ["g"], "x", "k").orderBy("i").collect()] == [1.5, 1.5, 3.0, 4.0]
    assert [r.pct_rank for r in windows.percentile_rank(ties, ["g"], "x").orderBy("i").collect()] == [0.375, 0.375, 0.75, 1.0]


def test_histogram_counts_every_value(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (0.3,), (None,)], "x double")
    got = aggregates.histogram(df, "x", 3).collect()
    assert len(got) == 3 and sum(r.n for r in got) == 3


def test_clip_bounds(spark):
    df = spark.createDataFrame([(0.0,), (10.0,), (20.0,), (30.0,)], "x double")
    got = sorted(r.x_clipped for r in features.winsorised(df, "x", F.lit(True), 0.25, 0.75).collect())
    assert got == [7.5, 10.0, 20.0, 22.5]


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (-1.0, -0.5), (3.0, 2.5)], "y double, p double").withColumn("g", F.lit("all"))
    got = features.regression_metrics(df, ["g"], "y", "p").head()
    assert got.direction == 1.0 and got.ic > 0.9 and got.n == 3


def test_checks(spark):
    df = spark.createDataFrame([(1, "train", D("2024-01-01")), (1, "test", D("2024-03-01")), (2, "valid", D("2024-02-01"))], "i int, s string, d date")
    assert checks.unique_key(df, ["i"]).head().status == "fail" and checks.unique_key(df, ["i", "s"]).head().status == "pass"
    assert checks.split_policy(df, "s", "d", ["train", "valid", "test"]).head().status == "pass"
    assert checks.split_policy(df.withColumn("d", F.lit(D("2024-01-01"))), "s", "d", ["train", "valid", "test"]).head().status == "fail"
    assert checks.required_columns(df, ["i", "z"]).head().status == "fail"


def test_upsert_and_supersede(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, t int")
    fresh = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 1)], "k int, v string, t int")
    assert {(r.k, r.v) for r in retrieval.upsert(base, fresh, "k", "t").collect()} == {(1, "a"), (2, "d"), (3, "e")}
    assert {(r.k, r.v) for r in joins.superseded(base, fresh, "k").collect()} == {(1, "a"), (2, "b"), (3, "e")}


def test_chunks_cover_the_text():
    text = "\n\n".join(f"Paragraph {i}. " + "word " * 60 for i in range(20))
    parts = chunking.split_overlap(text, 600, 60)
    assert all(len(p) <= 600 for p in parts) and all(p in text for p in parts)
    assert chunking.split_overlap("short") == ["short"] and chunking.split_overlap("") == []
    soft = chunking.split_soft(text, 700)
    assert all(len(p) <= 700 for p in soft) and "".join("".join(soft).split()) == "".join(text.split())


def test_sections_and_tables(spark):
    pages = spark.createDataFrame([(1, "<title>T</title><script>x</script><h1>Head</h1><p>lead</p><h2>A</h2><p>one</p><li>two</li><h3>B</h3>end"), (2, None)], "i int, h string")
    got = [(r.title, r.heading, r.level, r.content) for r in chunking.page_sections(pages, "i", "h").filter("id = 1").orderBy("pos").collect()]
    assert got == [("Head", "", 0, "lead"), ("Head", "A", 2, "one\ntwo"), ("Head", "B", 3, "end")]
    md = spark.range(1).select(chunking.markdown_table(F.array(F.array(F.lit("a"), F.lit("b|c")), F.array(F.lit("1"), F.lit(None))))).head()[0]
    assert md == "| a | b\\|c |\n| --- | --- |\n| 1 |  |"


def test_sessions_stream_and_batch_agree(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, t0 + dt.timedelta(minutes=m)) for m in (0, 10, 39, 69, 100)] + [(2, t0), (-1, t0 + dt.timedelta(days=30)), (-1, t0 + dt.timedelta(days=60))]
    df = spark.createDataFrame(rows, "u int, ts timestamp")
    for i in range(len(rows)):
        spark.createDataFrame([rows[i]], "u int, ts timestamp").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    batch = {(r.u, r.start, r.n) for r in sessions.batch_sessions(df, "u", "ts").filter("u > 0").collect()}
    out = sessions.run_to_table(sessions.stream_sessions(stream, "u", "ts"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert {(r.u, r.start, r.n) for r in out.filter("u > 0").collect()} == batch
    got = {(r.u, r.n) for r in out.filter("u > 0").collect()}
    assert got == {(1, 4), (1, 1), (2, 1)}


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", "a,b"), ("2", None)], "k string, v string")
    files.write_csv(df, str(tmp_path / "c"), ["k"])
    assert {tuple(r) for r in files.read_csv_text(spark, str(tmp_path / "c")).collect()} == {("1", "a,b"), ("2", None)}
    files.write_jsonl(df, str(tmp_path / "j"))
    assert {tuple(r) for r in files.read_jsonl(spark, str(tmp_path / "j"), "k string, v string").collect()} == {("1", "a,b"), ("2", None)}


def test_toc_leaves(spark):
    rows = [(1, 1, "A"), (2, 2, " b "), (3, 3, "c"), (4, 2, None), (5, 1, "D"), (6, 3, "e"), (7, 2, "f")]
    df = spark.createDataFrame([(0, *r) for r in rows] + [(1, 1, 3, "alone")], "doc int, pos int, level int, title string")
    got = {(r.doc, r.pos): r.path for r in chunking.toc_leaves(df, "doc", "pos", "level", "title", 3).collect()}
    assert got == {(0, 3): "A/b/c", (0, 4): "A/", (0, 6): "D/e", (0, 7): "D/f", (1, 1): "alone"}
    assert chunking.toc_leaves(df.limit(0), "doc", "pos", "level", "title", 3).count() == 0


def test_department(spark):
    df = spark.createDataFrame([("Network On-Call guide", "k"), ("on-call", "k"), ("Plain", "k"), (None, "k"), ("", None)], "title string, key string")
    name = chunking.department(F.col("title"), F.col("key"), r"(?i)\s*on[\s-]?call", {"k": "known"}, "other")
    assert [r[0] for r in df.select(name).collect()] == ["Network", "known", "Plain", "known", "other"]


def test_cluster_ols_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x, g = rng.normal(size=200), np.arange(200) % 10
    y = 2 + 3 * x + rng.normal(size=200) + rng.normal(size=10)[g]
    df = spark.createDataFrame([(int(a), float(b), float(c)) for a, b, c in zip(g, x, y)], "g int, x double, y double")
    got = {r.term: r for r in models.cluster_ols(df, "g", "y", ["x"]).collect()}
    m = np.column_stack([np.ones(200), x])
    beta = np.linalg.lstsq(m, y, rcond=None)[0]
    u = y - m @ beta
    meat = sum(np.outer(m[g == k].T @ u[g == k], m[g == k].T @ u[g == k]) for k in range(10))
    inv = np.linalg.inv(m.T @ m)
    se = np.sqrt(np.diag(inv @ meat @ inv) * (10 / 9) * (199 / 198))
    assert np.allclose([got["const"].coef, got["x"].coef], beta) and np.allclose([got["const"].se, got["x"].se], se)
    assert models.wild_bootstrap(df, "g", "y", ["x"], "x", 99).head().p < 0.05


def test_inference_over_more_clusters_than_a_driver_should_hold(spark):
    import math

    import numpy as np
    from pyspark.sql import functions as F

    g = 120_000
    df = spark.range(g).select("id", (F.col("id") % 7).cast("double").alias("x"), ((F.col("id") % 7) * 0.01 + F.col("id") % 11 + F.when(F.col("id") >= 100_000, 5).otherwise(0)).alias("y"))
    x, y = np.arange(g) % 7, (np.arange(g) % 7) * 0.01 + np.arange(g) % 11 + np.where(np.arange(g) >= 100_000, 5, 0)
    m = np.column_stack([np.ones(g), x])
    inv = np.linalg.inv(m.T @ m)
    beta = inv @ (m.T @ y)
    u = m * (y - m @ beta)[:, None]
    t = beta[1] / np.sqrt((inv @ (u.T @ u) @ inv)[1, 1] * (g / (g - 1)) * ((g - 1) / (g - 2)))
    got = {r.term: r for r in models.cluster_ols(df, "id", "y", ["x"]).collect()}
    assert np.isclose(got["x"].coef, beta[1]) and np.isclose(got["x"].t, t)
    row = models.wild_bootstrap(df, "id", "y", ["x"], "x", 199).head()
    assert np.isclose(row.t, t) and row.draws == 199
    assert abs(row.p - 2 * (1 - 0.5 * (1 + math.erf(abs(t) / math.sqrt(2))))) < 0.12


def test_fields_have_their_own_statistics(spark):
    docs = spark.createDataFrame([(1, "c++ guide", "the guide"), (2, "cats", "the c guide of cats cats"), (3, None, ""), (4, "guide", None)], "doc int, title string, body string")
    fields = [retrieval.Field("title", F.col("title"), 2.0), retrieval.Field("body", F.col("body")), retrieval.Field("raw", F.concat_ws(" ", "title", "body"), 0.5, retrieval.raw_tokens)]
    ask = lambda q, **kw: [(r.query, r.doc, r["rank"]) for r in retrieval.bm25_fields(spark.createDataFrame(q, "q int, text string"), docs, "q", "text", "doc", fields, **kw).orderBy("query", "rank").collect()]
    assert ask([(1, "C++"), (2, "cats"), (3, ""), (4, None)]) == [(1, 1, 1), (2, 2, 1)]  # the signs count in the raw field alone
    every = ask([(1, "guide")])
    assert [d for _, d, _ in every] == [1, 4, 2] and ask([(1, "guide")], k=1, offset=1) == [(1, every[1][1], 2)]
    assert ask([(1, "guide")], k=5, offset=3) == []


def test_phrases_by_positions(spark):
    docs = spark.createDataFrame([(1, "to be or not to be"), (2, "be to or to not be"), (3, None)], "doc int, body string")
    fields = [retrieval.Field("body", F.col("body"))]
    ask = lambda q: sorted(tuple(r) for r in retrieval.phrase_hits(spark.createDataFrame(q, "q int, text string"), docs, "q", "text", "doc", fields).collect())
    assert ask([(1, "To be"), (2, "to be to"), (3, "not to be"), (4, "be"), (5, None)]) == [(1, "body", 1, 2, 0), (3, "body", 1, 1, 3), (4, "body", 1, 2, 1), (4, "body", 2, 2, 0)]


def test_statements_of_one_sort(spark):
    left = spark.createDataFrame([(1, "a", D("2024-05-01")), (2, "a", D("2024-01-01")), (3, "b", D("2024-05-01")), (4, "a", None), (5, None, D("2024-05-01"))], "e int, k string, d date")
    fin = spark.createDataFrame([("a", D("2024-04-01"), D("2023-12-31"), 1.0), ("a", D("2024-04-01"), D("2024-03-31"), 2.0), ("a", D("2024-05-02"), D("2024-03-31"), 3.0), ("b", None, D("2024-03-31"), 9.0)], "k string, announced date, end date, x double")
    bal = spark.createDataFrame([("a", D("2024-05-01"), D("2024-03-31"), None), ("a", D("2024-01-01"), D("2023-09-30"), 5.0)], "k string, announced date, end date, x double")
    got = {r.e: (r.fin_x, r.fin_end, r.bal_x, r.bal_end) for r in features.latest_statements(left, {"fin": fin, "bal": bal}, "k", "d").collect()}
    assert got == {1: (2.0, D("2024-03-31"), None, D("2024-03-31")), 2: (None, None, 5.0, D("2023-09-30")), 3: (None,) * 4, 4: (None,) * 4, 5: (None,) * 4}


def test_normalized_columns(spark):
    rows = [(i, "a", D("2023-01-10") + dt.timedelta(days=90 * i), float(i * i), i % 2) for i in range(8)] + [(90 + i, k, D("2023-01-20"), v, 0) for i, (k, v) in enumerate([("b", 4.0), ("c", 8.0), ("d", None), ("e", 0.0)])]
    out = features.normalized(spark.createDataFrame(rows, "i int, k string, d date, v double, flag int"), "k", "d", "i", ["v", "flag"])
    got = {r.row: r for r in out.collect()}
    assert {r.feature for r in got.values()} == {"v"} and len(got) == 12
    assert [got[i].selfz is None for i in range(4)] == [True, True, True, False] and round(got[3].selfz, 6) == round((9 - 5 / 3) / (13 / 3) ** 0.5, 6)
    assert got[3].yoy is None and round(got[5].yoy, 6) == 24.0 and round(got[6].yoy, 6) == 8.0  # 360 days before
    assert (got[0].xsrank, got[90].xsrank, got[91].xsrank, got[0].xsdemed) == (0.375, 0.75, 1.0, -2.0) and got[92].xsrank is None and got[1].xsrank is None
    assert features.normalized(spark.createDataFrame([], "i int, k string, d date, v double"), "k", "d", "i", ["v"]).count() == 0


def test_chunks_leave_a_task_in_small_batches(monkeypatch, spark):
    """10,000 texts at once would all be strings at once, with their chunks."""
    import pyarrow as pa

    found = {}
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, f, schema: found.update(f=f) or self.limit(0).selectExpr("id", "0L as part", "'' as chunk", "'' as title"), raising=True)
    docs = spark.createDataFrame([(1, "x")], "id long, text string")
    chunking.chunk_texts(docs, "id", "text", most=1000, overlap=100)
    batch = pa.RecordBatch.from_pydict({"id": list(range(300)), "text": [("Ein Satz. " * 3000) if i % 3 else None for i in range(300)]})
    out = list(found["f"](iter([batch])))
    assert len(out) > 3 and max(b.nbytes for b in out) < 3_000_000
    assert sorted({i for b in out for i in b.column(0).to_pylist()}) == [i for i in range(300) if i % 3]
    chunking.page_sections(docs, "id", "text")
    batch = pa.RecordBatch.from_pydict({"id": list(range(300)), "name": [str(i) for i in range(300)], "html": ["<h2>a</h2>" + "<p>b</p>" * 3000] * 300})
    out = list(found["f"](iter([batch])))
    assert len(out) > 3 and sum(b.num_rows for b in out) == 600


def test_align_forward_shuffles_once(spark):
    """The days of the right side are read once, also for the status, and null keys meet none."""
    left = spark.createDataFrame([(1, "a", 3), (2, "a", 9), (3, None, 1), (4, "b", 1), (5, "a", None)], "i int, k string, n int").withColumn("d", F.date_add(F.lit("2024-01-01").cast("date"), F.col("n")))
    right = spark.createDataFrame([("a", 4, 1.0), ("a", 6, 2.0), (None, 5, 3.0)], "k string, m int, v double").withColumn("e", F.date_add(F.lit("2024-01-01").cast("date"), F.col("m")))
    out = joins.align_forward(left, right.select("k", "e", "v"), "k", "d", "e", ["v"])
    assert {r.i: (r.v, r.status) for r in out.collect()} == {1: (1.0, "before_first"), 2: (None, "after_last"), 3: (None, "no_key"), 4: (None, "no_key"), 5: (None, "bad_date")}
    assert out._jdf.queryExecution().sparkPlan().toString().count("LocalTableScan") + out._jdf.queryExecution().sparkPlan().toString().count("Scan ExistingRDD") == 2


def test_raw_sums_are_those_of_the_frame(spark):
    rows = spark.createDataFrame([(c, n, float(n * n) if n % 3 else None) for c in "ab" for n in range(9)], "c string, n int, x double")
    both = features.raw_sums(windows.event_sums(rows, "c", "n", "x", {"w": (0, 2)}), "c", "n", "x", 0, 2, "again").collect()
    assert len(both) == 18 and all(r.again == r.sum_w for r in both)
