"""Text, search, evidence, sessions and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tarnflow.functions import text
from tarnflow.operators import chunking, manifest, retrieval, sections
from tarnflow.operators.windows import best_per_key
from tarnflow.registry import query
from tarnflow.session import materialize, scratch_dir
from tarnflow.sources import files
from tarnflow.sources.tables import table
from tarnflow.streaming import sessions
from tarnflow.streaming.changelog import ChangeLog

_TOKENS = "list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: length(t) >= 2)"
_TOK = lambda c: _TOKENS.format(c=c)


def _fresh(spark, name):
    """A new folder under the shared one."""
    return f"{scratch_dir(spark)}/tarnflow/{uuid.uuid4().hex}/{name}"


@query("tx_tokens", f"SELECT doc_id, len({_TOK('text')}) AS n, md5(array_to_string({_TOK('text')}, ' ')) AS h FROM documents")
def _(spark, d):
    t = retrieval.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.md5(F.array_join(t, " ")).alias("h"))


@query("se_index_docs", f"SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS n FROM (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK('text')}) AS term FROM documents) GROUP BY 1, 2) GROUP BY 1")
def _(spark, d):
    posts, _ = retrieval.postings(table(spark, d, "documents"), "doc_id", "text")
    return posts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n"))


_HEAD = "substr(split_part(text, chr(10), 1), 1, 80)"
_RAW = lambda c: f"list_filter(regexp_split_to_array(lower({c}), '\\s+'), lambda t: t <> '')"
_FIELD_WORDS = f"SELECT doc_id AS doc, 'title' AS field, {_TOK(_HEAD)} AS words FROM documents UNION ALL SELECT doc_id, 'content', {_TOK('text')} FROM documents UNION ALL SELECT doc_id, 'raw', {_RAW('text')} FROM documents"
_FIELD_QUERIES = f"SELECT item_id AS query, f AS field, CASE WHEN f = 'raw' THEN {_RAW('text')} ELSE {_TOK('text')} END AS words FROM benchmark, (SELECT unnest(['title', 'content', 'raw']) AS f) WHERE item_id % 100 = 0"


def _fields():
    """A document's first line, its words, and its strings with all signs."""
    head = F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 80)
    return [retrieval.Field("title", head, 2.0), retrieval.Field("content", F.col("text")), retrieval.Field("raw", F.col("text"), 0.5, retrieval.raw_tokens)]


@query("se_bm25", f"""WITH d AS ({_FIELD_WORDS}), q AS (SELECT DISTINCT query, field, unnest(words) AS term FROM ({_FIELD_QUERIES})),
tf AS (SELECT doc, field, len, term, count(*) AS tf FROM (SELECT doc, field, len(words) AS len, unnest(words) AS term FROM d) GROUP BY ALL), df AS (SELECT field, term, count(*) AS df FROM tf GROUP BY 1, 2), tot AS (SELECT field, count(*) AS n, avg(len(words)) AS a FROM d GROUP BY 1),
s AS (SELECT query, doc, round(sum(CASE field WHEN 'title' THEN 2.0 WHEN 'raw' THEN 0.5 ELSE 1.0 END::DOUBLE * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))), 6) AS score FROM tf JOIN df USING (field, term) JOIN tot USING (field) JOIN q USING (field, term) GROUP BY 1, 2)
SELECT query, doc, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM s) WHERE rank BETWEEN 6 AND 15""")
def _(spark, d):
    q = table(spark, d, "benchmark").filter("item_id % 100 = 0")
    out = retrieval.bm25_fields(q, table(spark, d, "documents"), "item_id", "text", "doc_id", _fields(), 10, offset=5)
    return out.select("query", "doc", F.col("rank").cast("long").alias("rank"))


@query("se_phrase", f"""WITH d AS ({_FIELD_WORDS}), q AS (SELECT item_id AS query, f AS field, CASE WHEN f = 'raw' THEN {_RAW('phrase')} ELSE {_TOK('phrase')} END AS p FROM (SELECT item_id, array_to_string(string_split(text, ' ')[1:3], ' ') AS phrase FROM benchmark), (SELECT unnest(['title', 'content', 'raw']) AS f)),
t AS (SELECT query, field, unnest(p) AS term, generate_subscripts(p, 1) AS idx, len(p) AS size FROM q), w AS (SELECT doc, field, unnest(words) AS term, generate_subscripts(words, 1) AS pos FROM d),
h AS (SELECT query, field, doc, pos - idx AS hit FROM w JOIN t USING (field, term) GROUP BY query, field, doc, pos - idx, size HAVING count(*) = size)
SELECT query, field, doc, count(*) AS n, CAST(min(hit) AS BIGINT) AS first FROM h GROUP BY query, field, doc""")
def _(spark, d):
    phrase = F.array_join(F.slice(F.split("text", " "), 1, 3), " ")
    return retrieval.phrase_hits(table(spark, d, "benchmark").withColumn("phrase", phrase), table(spark, d, "documents"), "item_id", "phrase", "doc_id", _fields())


_COS = "round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6)"


@query("se_vector_topk", f"SELECT query, id, rank FROM (SELECT a.vec_id AS query, b.vec_id AS id, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) WHERE rank <= 10")
def _(spark, d):
    e = table(spark, d, "embeddings")
    out = retrieval.vector_top_k(e.filter("vec_id % 100 = 0"), e, "vec_id", "vec_id", "embedding", "label")
    return out.select("query", "id", F.col("rank").cast("long").alias("rank"))


@query("se_vector_index")
def _(spark, d):
    """The neighbours of se_vector_topk by an index of buckets, probed until an audit finds 0.95 of the true ones."""
    e = table(spark, d, "embeddings")
    index = retrieval.plane_index(e, "vec_id", "embedding", "label", 64, 6)
    out, _, _ = retrieval.indexed_top_k(e.filter("vec_id % 100 = 0"), index, "vec_id", "embedding", "label")
    return out.select("query", "id", F.col("rank").cast("long").alias("rank"))


_WIDTH = 64


def _embed_sql(name: str, texts: str, is_query: bool) -> str:
    """A table ``name`` of ``id, v``: hashed vectors of ``texts`` (id, text); ``pd`` and ``pn`` are the passages' document frequencies and number."""
    signs = [f"sum(CASE WHEN (instr('0123456789abcdef', substr(h, {k + 1}, 1)) - 1) >> {3 - b} & 1 = 1 THEN w ELSE -w END)" for k in range(_WIDTH // 4) for b in range(4)]
    weight = "1.0::DOUBLE" if is_query else "(1 + ln(tf))"
    return f"""{name}0 AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({_TOK('text')}) AS term FROM ({texts})) GROUP BY 1, 2),
{name} AS (SELECT id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS v FROM (SELECT id, [{', '.join(signs)}] AS e FROM (SELECT id, md5(term) AS h, {weight} * (ln((pn + 1)::DOUBLE / (coalesce(df, 0) + 1)) + 1) AS w FROM {name}0 LEFT JOIN pd USING (term), (SELECT count(*) AS pn FROM documents)) GROUP BY id))"""


_PASSAGES = _embed_sql("pv", "SELECT doc_id AS id, text FROM documents", False).replace("pv AS (", "pd AS (SELECT term, count(*) AS df FROM pv0 GROUP BY 1), pv AS (", 1)


@query("se_embed", f"WITH {_PASSAGES} SELECT id AS doc_id, i AS dim, round(v[i], 5) + 0.0 AS value FROM pv, (SELECT unnest(range(1, {_WIDTH + 1})) AS i)")
def _(spark, d):
    """Vectors of passages, an entry a row."""
    v, _, _ = retrieval.hashed_vectors(table(spark, d, "documents"), "doc_id", "text", width=_WIDTH)
    each = v.filter("vector is not null").select(F.col("id").alias("doc_id"), F.posexplode("vector").alias("pos", "x"))
    return each.select("doc_id", (F.col("pos") + 1).cast("long").alias("dim"), (F.round("x", 5) + 0.0).alias("value"))


@query("se_semantic", f"""WITH {_PASSAGES}, {_embed_sql("qv", "SELECT item_id AS id, text FROM benchmark WHERE item_id % 100 = 0", True)},
c AS (SELECT qv.id AS query, pv.id AS doc, round(list_dot_product(qv.v, pv.v), 6) AS score FROM qv, pv QUALIFY row_number() OVER (PARTITION BY qv.id ORDER BY round(list_dot_product(qv.v, pv.v), 6) DESC, pv.id) <= 30),
w AS (SELECT item_id AS query, list_distinct({_TOK('text')}) AS w FROM benchmark),
b AS (SELECT query, doc, round(0.7 * score + 0.3 * (len(list_intersect(w, {_TOK('text')})) / len(w)), 7) AS blend FROM c JOIN w USING (query) JOIN documents ON doc_id = doc)
SELECT query, doc, blend, row_number() OVER (PARTITION BY query ORDER BY blend DESC, doc) AS rank FROM b QUALIFY rank <= 10""")
def _(spark, d):
    """Query forms against passage forms, the thirty nearest, then ranked again with the share of query words that they hold."""
    q, docs = table(spark, d, "benchmark").filter("item_id % 100 = 0"), table(spark, d, "documents")
    passages, df, n = retrieval.hashed_vectors(docs, "doc_id", "text", width=_WIDTH)
    asked, _, _ = retrieval.hashed_vectors(q, "item_id", "text", df, n, query=True, width=_WIDTH)
    one = F.lit(0).alias("label")
    asked = materialize(asked.select("id", "vector", one), "asked")  # of known size, as the hits: no passage is shuffled to meet a few rows
    hits = materialize(retrieval.unit_top_k(asked, passages.select("id", "vector", one), "label", 30), "hits")
    texts = hits.join(docs.select(F.col("doc_id").alias("id"), F.col("text").alias("doc_text")), "id").join(q.select(F.col("item_id").alias("query"), F.col("text").alias("query_text")), "query")
    blended = retrieval.rerank(texts.withColumn("share", retrieval.keyword_share(F.col("query_text"), F.col("doc_text"))), "share")
    out = best_per_key(blended.select("query", F.col("id").alias("doc"), "blend"), ["query"], [F.col("blend").desc(), F.col("doc")], 10, "rank")
    return out.withColumn("rank", F.col("rank").cast("long"))


@query("se_rerank", f"""WITH q AS (SELECT item_id AS query, list_distinct({_TOK('text')}) AS w FROM benchmark WHERE item_id % 100 = 0), qt AS (SELECT query, unnest(w) AS term FROM q),
w AS (SELECT doc_id AS doc, unnest({_TOK('text')}) AS term FROM documents), tf AS (SELECT term, doc, count(*) AS tf FROM w WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
len AS (SELECT doc_id AS doc, len({_TOK('text')}) AS len FROM documents), tot AS (SELECT count(*) AS n, avg(len) AS a FROM len),
s AS (SELECT query, doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))), 6) AS score FROM tf JOIN df USING (term) JOIN len USING (doc) JOIN qt USING (term), tot GROUP BY 1, 2),
c AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) <= 30),
b AS (SELECT query, doc AS id, source AS root, round(0.7 * round(score / max(score) OVER (PARTITION BY query), 6) + 0.3 * (len(list_intersect(w, {_TOK('text')})) / len(w)), 7) AS blend FROM c JOIN q USING (query) JOIN documents ON doc_id = doc),
f AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY query, root ORDER BY blend DESC, id) = 1)
SELECT query, id, root, blend, row_number() OVER (PARTITION BY query ORDER BY blend DESC, id) AS rank FROM f QUALIFY rank <= 10""")
def _(spark, d):
    q, docs = table(spark, d, "benchmark").filter("item_id % 100 = 0"), table(spark, d, "documents")
    hits = retrieval.bm25(q, docs, "item_id", "text", "doc_id", "text", 30)
    texts = docs.select(F.col("doc_id").alias("doc"), "source", F.col("text").alias("doc_text"))
    both = hits.drop("rank").join(texts, "doc").join(q.select(F.col("item_id").alias("query"), F.col("text").alias("query_text")), "query")
    best = hits.groupBy("query").agg(F.max("score").alias("most"))
    both = both.join(best, "query").withColumns({"share": retrieval.keyword_share(F.col("query_text"), F.col("doc_text")), "score": F.round(F.col("score") / F.col("most"), 6)})
    blended = retrieval.rerank(both, "share").select("query", F.col("doc").alias("id"), F.coalesce("source", F.lit("")).alias("root"), "blend")
    return retrieval.one_per_root(blended, "query", "root", "blend", "id", 10).withColumn("rank", F.col("rank").cast("long"))


@query("se_substring", "SELECT doc_id, 1.0::DOUBLE AS score, substr(text, greatest(strpos(text, '|') - 60, 1), 121) AS snippet FROM documents WHERE contains(text, '|')")
def _(spark, d):
    return retrieval.substring_search(table(spark, d, "documents"), "doc_id", "text", "|")


@query("se_get", "SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _(spark, d):
    """Texts by id from a change log, after others were deleted by id."""
    docs, marks = table(spark, d, "documents").select("doc_id", "text", F.lit(0).alias("at")), table(spark, d, "labels")
    log = ChangeLog(spark, _fresh(spark, "texts"), "doc_id", "at")
    log.apply(docs.withColumn("deleted", F.lit(False)), 0)
    log.delete(marks.filter("toxic = 1").select("doc_id", F.lit(1).alias("at")))
    return log.get(marks.filter("quality = 0")).select("doc_id", F.md5("text").alias("h"))


@query("se_keyword_search", "SELECT source, doc_id, s FROM (SELECT source, doc_id, CAST((length(text) - length(replace(text, 'License', ''))) + (length(text) - length(replace(text, 'with', ''))) AS BIGINT) AS s FROM documents) WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY source ORDER BY s DESC, doc_id) <= 5")
def _(spark, d):
    s = text.keyword_score(F.col("text"), F.array(F.lit("License"), F.lit("with")))
    scored = table(spark, d, "documents").select("source", "doc_id", s.alias("s")).filter("s > 0")
    return best_per_key(scored, ["source"], [F.col("s").desc(), F.col("doc_id")], 5)


@query("top_rule_match", "WITH o AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders) SELECT a.o_orderkey, b.o_orderkey AS other FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey AND b.d BETWEEN a.d - 30 AND a.d + 30 QUALIFY row_number() OVER (PARTITION BY a.o_orderkey ORDER BY abs(date_diff('day', a.d, b.d)), b.o_orderkey) = 1")
def _(spark, d):
    from tarnflow.operators.joins import range_pairs
    from tarnflow.queries.panel import orders

    o = orders(spark, d).select("o_custkey", "o_orderkey", "d")
    pairs = range_pairs(o, o, "o_custkey", "d", "d", -30, 30).filter("o_orderkey <> o_orderkey_right")
    return best_per_key(pairs, ["o_orderkey"], [F.abs("gap_days"), F.col("o_orderkey_right")]).select("o_orderkey", F.col("o_orderkey_right").alias("other"))


@query("tx_html_extract", "SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) <> '' AS has_title, CAST(1 + len(regexp_extract_all(html, '<h[23][ >]')) AS BIGINT) AS n_sections FROM pages")
def _(spark, d):
    s = chunking.page_sections(table(spark, d, "pages"), "page_id", "html")
    return s.groupBy(F.col("id").alias("page_id")).agg((F.max("title") != "").alias("has_title"), F.count("*").alias("n_sections"))


@query("tx_catalog", "SELECT page_id, length(regexp_extract(html, '<title>([^<]*)', 1)) AS n_title FROM pages")
def _(spark, d):
    title = F.coalesce(F.nullif(F.regexp_extract("html", "<title>([^<]*)", 1), F.lit("")), F.nullif(F.regexp_extract("html", "<h1>([^<]*)", 1), F.lit("")), F.col("page_id").cast("string"))
    return table(spark, d, "pages").select("page_id", F.length(title).cast("long").alias("n_title"))


_DOMAIN = "regexp_extract(url, '^[a-z]+://[^/:?#]*[.]([a-z]+)', 1)"


@query("tx_department", f"""WITH p AS (SELECT page_id, trim(regexp_replace(regexp_extract(html, '<title>([^<]*)', 1), '(?is)(^|\\s+)the\\s.*$', '')) AS head, {_DOMAIN} AS domain FROM pages)
SELECT page_id, CASE WHEN head <> '' THEN head WHEN domain = 'com' THEN 'commercial' WHEN domain = 'org' THEN 'organisation' ELSE 'network' END AS department FROM p""")
def _(spark, d):
    names = {"com": "commercial", "org": "organisation"}
    name = chunking.department(F.regexp_extract("html", "<title>([^<]*)", 1), F.expr(_DOMAIN), r"(?i)(^|\s+)the\s", names, "network")
    return table(spark, d, "pages").select("page_id", name.alias("department"))


@query("tx_tags", "SELECT doc_id, concat_ws('|', CASE WHEN contains(text, 'MIT License') THEN 'mit' END, CASE WHEN contains(text, 'Apache License') THEN 'apache' END, lang) AS tags FROM documents")
def _(spark, d):
    t = F.col("text")
    tags = F.array_compact(F.array(F.when(t.contains("MIT License"), "mit"), F.when(t.contains("Apache License"), "apache"), F.col("lang")))
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_distinct(tags), "|").alias("tags"))


_WORDS = ("the", "der", "que", "charset", "cookie", "License")
_META = """regexp_extract(regexp_extract(html, '(?is)<meta\\b[^>]*\\bname\\s*=\\s*["'']?keywords\\b[^>]*>', 0), '(?is)\\bcontent\\s*=\\s*"([^"]*)"', 1)"""


@query("tx_tags_pages", f"""SELECT page_id, coalesce(array_to_string(list_sort(list_distinct(list_concat(list_filter(list_transform(regexp_split_to_array({_META}, '[,，;；]'), lambda k: trim(k)), lambda k: k <> ''),
  list_filter([{", ".join(f"'{w}'" for w in _WORDS)}], lambda w: contains(html, w))))), '|'), '') AS tags FROM pages""")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(text.tags(text.meta_keywords(F.col("html")), F.col("html"), _WORDS), "|").alias("tags"))


_PAGE_LINE = r"(?i)^\s*(?:page\s+)?\d+\s*(?:/\s*\d+)?\s*$|licensed? under|all rights reserved"


@query("tx_clean_pages", f"WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '{_PAGE_LINE}')) AS l FROM documents) SELECT doc_id, CAST(len(k) AS BIGINT) AS n_lines, md5(array_to_string(k, chr(10))) AS h FROM (SELECT doc_id, list_filter(l, lambda x, i: NOT (length(x) <= 40 AND i > 1 AND x = l[i - 1])) AS k FROM l)")
def _(spark, d):
    t = table(spark, d, "documents").select("doc_id", chunking.clean_lines(F.col("text"), _PAGE_LINE).alias("t"))
    return t.select("doc_id", F.when(F.col("t") == "", 0).otherwise(F.size(F.split("t", "\n"))).cast("long").alias("n_lines"), F.md5("t").alias("h"))


#: Spans of a conversation's whole text: how long they are, and how far apart they start.
_SPAN, _STRIDE = 700, 450
_PAGES = "pg AS (SELECT conv_id, turn, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, length(text) + 2 AS size FROM conversations)"


@query("tx_page_offsets", f"""WITH {_PAGES}, sp AS (SELECT conv_id, s AS span_start, least(s + {_SPAN}, total) AS span_end FROM (SELECT conv_id, total, unnest(range(0, total, {_STRIDE})) AS s FROM (SELECT conv_id, CAST(sum(size) AS BIGINT) AS total FROM pg GROUP BY 1)))
SELECT sp.*, (SELECT max(turn) FROM pg WHERE pg.conv_id = sp.conv_id AND pg.start <= span_start) AS page_first, (SELECT max(turn) FROM pg WHERE pg.conv_id = sp.conv_id AND pg.start <= span_end - 1) AS page_last FROM sp""")
def _(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", "text")
    total = turns.groupBy("conv_id").agg(F.sum(F.length("text") + 2).alias("total")).filter("total > 0")
    spans = total.select("conv_id", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.lit(_STRIDE).cast("long"))).alias("span_start"))
    spans = spans.select("conv_id", "span_start", F.least(F.col("span_start") + _SPAN, "total").alias("span_end"))
    return sections.locate_pages(spans, sections.page_starts(turns, "conv_id", "turn", "text"), "conv_id", "span_start", "span_end", "turn")


_LEVELS = "CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END"


@query("tx_toc_leaves", f"""WITH r AS (SELECT conv_id, turn, {_LEVELS} AS level, role || ' ' || turn AS title FROM conversations),
x AS (SELECT *, lead(level) OVER w AS nxt, max(turn) FILTER (level <= 1) OVER v AS t1, max(turn) FILTER (level <= 2) OVER v AS t2 FROM r
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn), v AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT x.conv_id, x.turn, concat_ws('/', CASE WHEN x.level > 1 AND a.level = 1 THEN a.title END, CASE WHEN x.level > 2 AND b.level = 2 THEN b.title END, x.title) AS path
FROM x LEFT JOIN r a ON a.conv_id = x.conv_id AND a.turn = x.t1 LEFT JOIN r b ON b.conv_id = x.conv_id AND b.turn = x.t2 WHERE nxt IS NULL OR nxt <= x.level""")
def _(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.expr(_LEVELS).alias("level"), F.concat_ws(" ", "role", "turn").alias("title"))
    return chunking.toc_leaves(rows, "conv_id", "turn", "level", "title", 3).select("conv_id", "turn", "path")


# Contents tables of conversations: the first words of each turn as its title, one title that is nowhere, and the first turn's again at the end.
_TITLE = r"^\s*((?:\S+\s+){0,3}\S+)"
_CUT = rf"""pt AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS page, regexp_extract(text, '{_TITLE}', 1) AS title, regexp_replace(text, '^\s+|\s+$', '', 'g') || chr(10) || chr(10) AS t FROM conversations),
fu AS (SELECT conv_id, string_agg(t, '' ORDER BY page) AS whole, max(turn) AS last FROM pt GROUP BY 1),
wh AS (SELECT *, regexp_replace(whole, '\s+', '', 'g') AS plain, list_filter(range(1, length(whole) + 1), lambda i: NOT regexp_matches(whole[i], '\s')) AS places FROM fu),
st AS (SELECT conv_id, page, CAST(coalesce(sum(length(t)) OVER (PARTITION BY conv_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, CAST(coalesce(sum(length(regexp_replace(t, '\s+', '', 'g'))) OVER (PARTITION BY conv_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS plain_start FROM pt),
le AS (SELECT conv_id, pos, title, hint, regexp_replace(title, '\s+', '', 'g') AS key, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS i FROM (SELECT conv_id, 2 * turn AS pos, title, page AS hint FROM pt
  UNION ALL SELECT conv_id, 1, 'no such title anywhere', 1 FROM fu UNION ALL SELECT fu.conv_id, 2 * last + 1, title, 1 FROM fu JOIN pt ON pt.conv_id = fu.conv_id AND page = 1)),
ma AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS mark, CAST(NULL AS BIGINT) AS found, CAST(0 AS BIGINT) AS size FROM wh
UNION ALL SELECT conv_id, i, CASE WHEN found IS NULL THEN mark ELSE found + size END, found, size FROM (SELECT ma.conv_id, le.i, ma.mark, length(key) AS size,
  coalesce(CASE WHEN key <> '' AND strpos(plain[ma.mark + 1:], key) > 0 THEN ma.mark + strpos(plain[ma.mark + 1:], key) - 1 END, CASE WHEN key <> '' AND strpos(plain[plain_start + 1:], key) > 0 THEN plain_start + strpos(plain[plain_start + 1:], key) - 1 END) AS found
  FROM ma JOIN le ON le.conv_id = ma.conv_id AND le.i = ma.i + 1 JOIN wh ON wh.conv_id = ma.conv_id JOIN st ON st.conv_id = ma.conv_id AND st.page = hint)),
sx AS (SELECT ma.conv_id, ma.i, length(whole) AS n, whole, coalesce(places[found + 1] - 1, length(whole)) AS title_start, coalesce(places[found + size + 1] - 1, length(whole)) AS begins FROM ma JOIN wh ON wh.conv_id = ma.conv_id WHERE found IS NOT NULL),
se AS (SELECT conv_id, i, whole, begins, coalesce(lead(title_start) OVER (PARTITION BY conv_id ORDER BY i), n) AS ends FROM sx),
cu AS (SELECT conv_id, i, begins, ends, regexp_replace(regexp_replace(regexp_replace(CASE WHEN ends > begins THEN whole[begins + 1:ends] ELSE '' END, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM se)"""


@query("tx_section_cut", rf"""WITH RECURSIVE {_CUT} SELECT cu.conv_id AS doc, pos, title AS path, (SELECT max(page) FROM st WHERE st.conv_id = cu.conv_id AND st.start <= begins) AS page_start, (SELECT max(page) FROM st WHERE st.conv_id = cu.conv_id AND st.start <= greatest(begins, ends - 1)) AS page_end,
  length(text) AS n_chars, md5(text) AS h FROM cu JOIN le ON le.conv_id = cu.conv_id AND le.i = cu.i WHERE length(text) >= 30 AND length(regexp_replace(text, '\s+', '', 'g')) >= 20""")
def _(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id")
    turns = table(spark, d, "conversations").withColumns({"page": F.row_number().over(w.orderBy("turn")), "last": F.max("turn").over(w), "title": F.regexp_extract("text", _TITLE, 1)})
    entry = lambda pos, title, hint: F.struct(pos.cast("long").alias("pos"), title.alias("title"), hint.alias("hint"))
    own, none, again = entry(2 * F.col("turn"), F.col("title"), F.col("page")), entry(F.lit(1), F.lit("no such title anywhere"), F.lit(1)), entry(2 * F.col("last") + 1, F.col("title"), F.lit(1))
    leaves = turns.select("conv_id", F.explode(F.when(F.col("page") == 1, F.array(own, none, again)).otherwise(F.array(own))).alias("x")).select("conv_id", "x.*")
    out = sections.cut_sections(turns, leaves.withColumn("path", F.col("title")), "conv_id", "page", "text", "pos", "path", "title", "hint")
    return out.select("doc", "pos", "path", "page_start", "page_end", F.length("text").alias("n_chars"), F.md5("text").alias("h"))


@query("tx_table_markdown", "SELECT r_regionkey, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS md FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def _(spark, d):
    rows = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("x"))
    cells = F.concat(F.array(F.array(F.lit("key"), F.lit("name"))), F.transform("x", lambda r: F.array(r["n_nationkey"].cast("string"), r["n_name"])))
    return rows.select("r_regionkey", chunking.markdown_table(cells).alias("md"))


_STRIPPED = lambda c: rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def _overlap_sql(rows: str, most: int, overlap: int, least: int = 80) -> str:
    """``id, chunk``: windows of ``rows`` (``id, text``) one after the other, each ended by the first kind of mark that its second half holds."""
    half = f"substr(text, s + {most // 2 + 1}, {most - most // 2})"
    ends = ", ".join(rf"nullif(length(regexp_extract({half}, '(?s)^.*{mark}')), 0)" for mark in (r"\n\n", r"\n", "。", r"\. ", "! ", r"\? "))
    stop = f"CASE WHEN s + {most} < length(text) THEN s + coalesce({most // 2} + coalesce({ends}), {most}) ELSE length(text) END"
    return f"""(WITH RECURSIVE w AS (SELECT id, text, s, {stop} AS stop FROM (SELECT id, text, CAST(0 AS BIGINT) AS s FROM ({rows}) WHERE length(text) > 0)
UNION ALL SELECT id, text, s, {stop} FROM (SELECT id, text, greatest(stop - {overlap}, s + 1) AS s FROM w WHERE stop < length(text))),
c AS (SELECT id, s, {_STRIPPED("substr(text, s + 1, stop - s)")} AS chunk FROM w)
SELECT id, chunk FROM c WHERE chunk <> '' QUALIFY length(chunk) > {min(least, overlap)} OR row_number() OVER (PARTITION BY id ORDER BY s) = 1)"""


_DOC_TEXTS = "SELECT doc_id AS id, text FROM documents"
_SOFT = 1200


@query("tx_split_soft", rf"""WITH RECURSIVE p AS (SELECT doc_id AS id, generate_subscripts(l, 1) AS i, unnest(l) AS par FROM (SELECT doc_id, string_split_regex(text, '\n\s*\n') AS l FROM documents)),
t AS (SELECT id, i, {_STRIPPED("par")} AS par FROM p), l AS (SELECT id, i, CASE WHEN length(par) > {_SOFT} THEN string_split(regexp_replace(par, '([.!?。！？])(\s)', '\1' || chr(1) || '\2', 'g'), chr(1)) ELSE [par] END AS l FROM t),
s AS (SELECT id, i, generate_subscripts(l, 1) AS j, unnest(l) AS s FROM l), k AS (SELECT id, i, j, s, unnest(range(0, length(s), {_SOFT})) AS k FROM s),
u AS (SELECT id, substr(s, k + 1, {_SOFT}) AS u, row_number() OVER (PARTITION BY id ORDER BY i, j, k) AS pos, CASE WHEN row_number() OVER (PARTITION BY id, i ORDER BY j, k) = 1 THEN 2 ELSE 0 END AS gap FROM k),
f AS (SELECT DISTINCT id, CAST(0 AS BIGINT) AS pos, CAST(NULL AS BIGINT) AS size, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS longest FROM u
UNION ALL SELECT id, pos, size, n + fresh, greatest(longest, coalesce(size, 0)) FROM (SELECT f.id, u.pos, f.n, f.longest,
  CASE WHEN coalesce(size + gap + length(u) <= {_SOFT}, false) THEN size + gap + length(u) WHEN {_STRIPPED("u")} <> '' THEN length(regexp_replace(u, '^\s+', '')) ELSE size END AS size,
  CASE WHEN NOT coalesce(size + gap + length(u) <= {_SOFT}, false) AND {_STRIPPED("u")} <> '' THEN 1 ELSE 0 END AS fresh FROM f JOIN u ON u.id = f.id AND u.pos = f.pos + 1))
SELECT id, max(n) AS n, CAST(max(longest) AS INT) AS longest FROM f GROUP BY id HAVING max(n) > 0""")
def _(spark, d):
    c = chunking.chunk_texts(table(spark, d, "documents"), "doc_id", "text", "soft", most=_SOFT)
    return c.groupBy("id").agg(F.count("*").alias("n"), F.max(F.length("chunk")).alias("longest"))


@query("tx_split_overlap", f"SELECT id, count(*) AS n, CAST(max(length(chunk)) AS INT) AS longest, CAST(sum(length(chunk)) AS BIGINT) AS chars FROM {_overlap_sql(_DOC_TEXTS, 1800, 160)} GROUP BY id")
def _(spark, d):
    c = chunking.chunk_texts(table(spark, d, "documents"), "doc_id", "text", "overlap")
    return c.groupBy("id").agg(F.count("*").alias("n"), F.max(F.length("chunk")).alias("longest"), F.sum(F.length("chunk")).alias("chars"))


# Events are documents (announcements, questions, news and others); files are conversations, a turn a page; an interface knows every third document's text.
_KIND = "CASE doc_id % 5 WHEN 0 THEN 'announcement' WHEN 1 THEN 'announcement' WHEN 2 THEN 'irm_qa' WHEN 3 THEN 'news' ELSE 'other' END"
_CODE = "CASE WHEN doc_id % 7 > 0 THEN concat('AN', doc_id) ELSE ' ' END"
_KINDS = {"irm_qa": "irm_qa", "news": "news"}
_FORM = r"(?i)licensed? under[^.\n]*|all rights reserved"
_MANIFEST = f"""ev AS (SELECT doc_id AS event_id, lang AS symbol, {_KIND} AS source_type, trim(substr(text, 1, 40)) AS title, {_CODE} AS code, substr(text, 1, 3000) AS summary, source FROM documents),
fi AS (SELECT concat('AN', 5 * conv_id) AS code, 'c' AS symbol, CASE WHEN conv_id % 4 = 3 THEN 'failed' ELSE 'ok' END AS status, count(*) AS n FROM conversations GROUP BY conv_id),
ma AS (SELECT 'pdf:c:' || code AS document_id, symbol, 'notice_pdf' AS source_type, CAST(NULL AS VARCHAR) AS title, code, CAST(NULL AS BIGINT) AS event_id, 'pdf' AS text_source, 'strong' AS strength, CAST(NULL AS VARCHAR) AS source_text FROM fi WHERE status = 'ok'
UNION ALL SELECT 'notice_api:' || coalesce(symbol, '') || ':' || code, symbol, 'announcement', nullif(title, ''), code, event_id, 'notice_api', 'strong', NULL FROM ev WHERE source_type = 'announcement' AND trim(code) <> '' AND code NOT IN (SELECT code FROM fi WHERE status = 'ok')
UNION ALL SELECT source_type || ':' || coalesce(symbol, '') || ':' || event_id, symbol, source_type, nullif(title, ''), nullif(trim(code), ''), event_id, source_type, 'auxiliary', t FROM (SELECT *, concat_ws(chr(10), 'title: ' || nullif(title, ''), 'summary: ' || nullif(trim(summary), ''), 'institution: ' || nullif(trim(source), '')) AS t FROM ev) WHERE source_type IN ('irm_qa', 'news') AND t <> '')"""


def _manifest(spark, d):
    """The manifest, pages by code, and what the interface gives."""
    docs, turns = table(spark, d, "documents"), table(spark, d, "conversations")
    events = docs.select(
        F.col("doc_id").alias("event_id"), F.col("lang").alias("symbol"), F.expr(_KIND).alias("source_type"), F.trim(F.substring("text", 1, 40)).alias("title"), F.lit(None).cast("date").alias("event_date"), F.expr(_CODE).alias("code"), F.substring("text", 1, 3000).alias("summary"), "source"
    )
    code = F.concat(F.lit("AN"), 5 * F.col("conv_id")).alias("code")
    status = F.when(F.col("conv_id") % 4 == 3, "failed").otherwise("ok")
    found = turns.groupBy("conv_id").agg(F.count("*").alias("n_pages")).select(code, F.lit("c").alias("symbol"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("date").alias("notice_date"), status.alias("status"), "n_pages")
    made = manifest.text_manifest(events, found, _KINDS, {"title": F.col("title"), "summary": F.col("summary"), "institution": F.col("source")})
    contents = docs.filter("doc_id % 3 = 0").select(F.concat(F.lit("AN"), "doc_id").alias("code"), F.col("text").alias("content"))
    return materialize(made, "manifest"), turns.select(code, F.col("turn").alias("page"), "text"), contents


@query("tx_manifest", f"WITH {_MANIFEST} SELECT document_id, symbol, source_type, title, code, event_id, text_source, strength, md5(source_text) AS h FROM ma")
def _(spark, d):
    return _manifest(spark, d)[0].drop("publish_date").withColumn("h", F.md5("source_text")).drop("source_text")


_NORM = lambda c: rf"regexp_replace(regexp_replace({c}, '[ \t　]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
_SPACED = lambda c: f"trim({_NORM(c)})"
_ROUTES = f"""pa AS (SELECT concat('AN', 5 * conv_id) AS code, turn, text FROM conversations WHERE trim(text) <> ''),
fr AS (SELECT ma.*, 'pages' AS route, turn, text AS t FROM ma JOIN pa USING (code) WHERE text_source = 'pdf'),
ro AS (SELECT * FROM fr UNION ALL BY NAME SELECT ma.*, CASE WHEN trim(content) <> '' THEN 'content' ELSE 'composed' END AS route, CAST(NULL AS BIGINT) AS turn, CASE WHEN trim(content) <> '' THEN content ELSE source_text END AS t
  FROM ma LEFT JOIN (SELECT concat('AN', doc_id) AS code, text AS content FROM documents WHERE doc_id % 3 = 0) co ON ma.code = co.code AND text_source = 'notice_api' WHERE document_id NOT IN (SELECT document_id FROM fr))"""
_FACTS = "concat_ws(chr(10), 'symbol: ' || nullif(trim(symbol), ''), 'source: ' || text_source, 'strength: ' || strength, 'title: ' || nullif(trim(title), ''))"


def _ready_sql(v) -> str:
    t = _SPACED("t")
    t = _SPACED(f"regexp_replace({t}, '{v.boilerplate}', '', 'g')") if v.boilerplate else t
    text = f"CASE WHEN {t} = '' THEN '' ELSE {_FACTS} || chr(10) || {t} END" if v.prefix else t
    return f"SELECT document_id || chr(31) || coalesce(CAST(turn AS VARCHAR), '') || chr(31) || route AS id, {text} AS text FROM ro WHERE t IS NOT NULL"


_PLAIN = manifest.Variant("plain", 1400, 240)


@query("tx_chunk_sources", f"WITH {_MANIFEST}, {_ROUTES} SELECT string_split(id, chr(31))[3] AS route, count(*) AS chunks, count(DISTINCT string_split(id, chr(31))[1]) AS documents, CAST(sum(length(chunk)) AS BIGINT) AS chars FROM {_overlap_sql(_ready_sql(_PLAIN), 1400, 240)} GROUP BY 1")
def _(spark, d):
    chunks = manifest.source_chunks(*_manifest(spark, d), _PLAIN)
    return chunks.groupBy("route").agg(F.count("*").alias("chunks"), F.count_distinct("document_id").alias("documents"), F.sum("n_chars").alias("chars"))


#: Five strategies: as it is, cleaned, and cleaned with the document's facts in front at three sizes.
_STRATEGIES = [
    manifest.Variant("plain_1800_160"), manifest.Variant("clean_1800_160", boilerplate=_FORM),
    *[manifest.Variant(f"prefix_{m}_{o}", m, o, _FORM, True) for m, o in ((1400, 240), (1200, 240), (1000, 300))],
]


@query("tx_chunk_experiments", f"WITH {_MANIFEST}, {_ROUTES} " + " UNION ALL ".join(
    f"SELECT '{v.name}' AS strategy, (SELECT count(*) FROM ma) AS documents, count(DISTINCT doc) AS with_chunks, (SELECT count(*) FROM ma) - count(DISTINCT doc) AS failed, count(*) AS chunks, CAST(sum(n) AS BIGINT) AS chars, max(n) AS longest, round(sum(n) / count(*), 2) AS mean_chars, round(count(*) / count(DISTINCT doc), 2) AS chunks_per_document FROM (SELECT string_split(id, chr(31))[1] AS doc, length(chunk) AS n FROM {_overlap_sql(_ready_sql(v), v.most, v.overlap)})"
    for v in _STRATEGIES
))
def _(spark, d):
    return manifest.compare_variants(*_manifest(spark, d), _STRATEGIES).drop("by_pages", "by_content", "by_composed")


_SESSIONS = """WITH x AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) <= 1800000000 THEN 0 ELSE 1 END AS new FROM events), y AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM x)
SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM y GROUP BY user_id, s"""


@query("st_session_gaps", _SESSIONS)
def _(spark, d):
    return sessions.batch_sessions(table(spark, d, "events"), "user_id", "ts").select("user_id", "start", "last", "n")


@query("st_session_stream", _SESSIONS)
def _(spark, d):
    """The same as a stream over the table's files. A stream ends without later rows to close its last windows: rows far ahead do that."""
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(_stream_folder(spark, d))
    out = sessions.stream_sessions(stream, "user_id", "ts")
    return sessions.run_to_table(out, _fresh(spark, "out"), _fresh(spark, "checkpoint")).filter("user_id >= 0").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("last").cast("timestamp_ntz").alias("last"), "n")


def _stream_folder(spark, d):
    """The events as a folder that a stream can read, with a last file whose row closes all windows."""
    path = _fresh(spark, "events")
    events = table(spark, d, "events")
    events.write.parquet(path)
    end = events.agg(F.max("ts").alias("ts"))
    for days in (30, 60):
        row = end.select(*[(F.col("ts") + F.make_interval(days=F.lit(days))).alias("ts") if c == "ts" else F.lit(-1).cast(events.schema[c].dataType).alias(c) if c == "user_id" else F.lit(None).cast(events.schema[c].dataType).alias(c) for c in events.columns])
        row.write.mode("append").parquet(path)
    return path


# Commands of sessions from the events, twenty times as fast: clears, reads and messages.
_FASTER = "make_timestamp(CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 20) AS BIGINT) + epoch_us(TIMESTAMP '2024-01-01'))"
_REPLAY = f"""WITH c AS (SELECT user_id, event_id, {_FASTER} AS tm, CASE WHEN event_id % 29 = 0 THEN 'clear' WHEN event_id % 3 = 0 THEN 'read' ELSE 'append' END AS op, event_type || event_id AS content FROM events),
l AS (SELECT *, max(CASE WHEN op = 'append' THEN tm END) OVER (PARTITION BY user_id ORDER BY tm, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c),
e AS (SELECT *, sum(CASE WHEN op = 'clear' OR epoch_us(tm) - epoch_us(before) >= 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY tm, event_id) AS epoch FROM l),
h AS (SELECT *, count(*) FILTER (op = 'append') OVER w AS n, string_agg(content, ',' ORDER BY tm, event_id) FILTER (op = 'append') OVER w AS said FROM e WINDOW w AS (PARTITION BY user_id, epoch ORDER BY tm, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT user_id, event_id, n, coalesce(said, '') AS said FROM h WHERE op = 'read'"""


def _commands(spark, d):
    """``session, seq, at, op, role, content`` from the events."""
    from_start = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) / 20
    at = F.timestamp_micros(F.floor(from_start) + F.unix_micros(F.lit("2024-01-01").cast("timestamp")))
    op = F.when(F.col("event_id") % 29 == 0, "clear").when(F.col("event_id") % 3 == 0, "read").otherwise("append")
    return table(spark, d, "events").select(
        F.col("user_id").alias("session"), F.col("event_id").alias("seq"), at.alias("at"), op.alias("op"), F.when(F.col("event_id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat("event_type", F.col("event_id").cast("string")).alias("content")
    )


def _said(reads):
    return reads.select(F.col("session").alias("user_id"), F.col("seq").alias("event_id"), F.size("history").cast("long").alias("n"), F.array_join(F.transform("history", lambda m: m["content"]), ",").alias("said"))


@query("st_session_append", _REPLAY)
def _(spark, d):
    return _said(sessions.replay_sessions(_commands(spark, d)))


@query("st_session_state", _REPLAY)
def _(spark, d):
    """The same from a stream that takes a quarter of the time span after the other; a last command of nobody's lets the clock pass them all."""
    commands, path = _commands(spark, d), _fresh(spark, "commands")
    edges = commands.agg(F.min("at").alias("a"), F.max("at").alias("b")).head()
    for k in range(4):
        lo, hi = edges["a"] + (edges["b"] - edges["a"]) * k / 4, edges["a"] + (edges["b"] - edges["a"]) * (k + 1) / 4
        commands.filter((F.col("at") >= lo) & ((F.col("at") < hi) | F.lit(k == 3))).coalesce(1).write.mode("append").parquet(path)
    for days in (1, 2):
        end = (-1, 0, edges["b"] + (edges["b"] - edges["a"]) * days, "read", None, None)
        spark.createDataFrame([end], "session long, seq long, at timestamp, op string, role string, content string").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(commands.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return _said(sessions.run_to_table(sessions.session_state(stream), _fresh(spark, "reads"), _fresh(spark, "checkpoint")).filter("session >= 0"))


@query("st_history_filter", "SELECT conv_id, count(*) AS n FROM conversations WHERE role IN ('user', 'assistant') AND length(trim(text)) > 0 GROUP BY 1")
def _(spark, d):
    return sessions.history(table(spark, d, "conversations"), "conv_id", "turn", "role", "text").select("conv_id", F.col("n").cast("long").alias("n"))


@query("st_ingest_upsert", "SELECT user_id, event_id, value FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) WHERE event_type <> 'error'")
def _(spark, d):
    """The latest event of each user from a stream of files into a change log; an error deletes its user until another event comes."""
    source = _fresh(spark, "events")
    table(spark, d, "events").repartition(8).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 2).parquet(source)
    log = ChangeLog(spark, _fresh(spark, "state"), "user_id", "at")
    log.follow(stream.select("user_id", "event_id", "value", F.struct("ts", "event_id").alias("at"), (F.col("event_type") == "error").alias("deleted")), _fresh(spark, "checkpoint"))
    return log.read().select("user_id", "event_id", "value")


@query("st_first_seen", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, event_id FROM events) GROUP BY ALL")
def _(spark, d):
    """Events of a source that sends each file twice, each event once."""
    source = _fresh(spark, "events")
    for _ in range(2):
        table(spark, d, "events").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source).withColumn("at", F.col("ts").cast("timestamp"))
    out = sessions.run_to_table(sessions.first_seen(stream, "event_id", "at").select("user_id", "event_type"), _fresh(spark, "first"), _fresh(spark, "checkpoint"))
    return out.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("src_csv_multi", "SELECT c_custkey, c_name, c_mktsegment, CAST(c_nationkey AS VARCHAR) AS code FROM customer")
def _(spark, d):
    """A folder of files for each code, which the files themselves do not hold."""
    path = _fresh(spark, "csv")
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", F.col("c_nationkey").alias("code"))
    rows.write.partitionBy("code").option("header", True).csv(path)
    return files.read_csv_folder(spark, path, "c_custkey long, c_name string, c_mktsegment string, code string", "code", r"code=([^/]+)/")


@query("src_csv_text", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation")
def _(spark, d):
    path = _fresh(spark, "csv")
    table(spark, d, "nation").select("n_nationkey", "n_name").write.option("header", True).csv(path)
    return files.read_csv_text(spark, path)


@query("src_jsonl", "SELECT doc_id, md5(text) AS h FROM documents")
def _(spark, d):
    path = _fresh(spark, "jsonl")
    files.write_jsonl(table(spark, d, "documents").select("doc_id", "text"), path)
    return files.read_jsonl(spark, path, "doc_id long, text string").select("doc_id", F.md5("text").alias("h"))


@query("sink_csv", "SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders")
def _(spark, d):
    path = _fresh(spark, "csv")
    files.write_csv(table(spark, d, "orders").select("o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice")), path, ["o_orderkey"])
    return files.read_csv_folder(spark, path, "o_orderkey long, o_totalprice double")


@query("sink_jsonl", "SELECT item_id, md5(text) AS h FROM benchmark")
def _(spark, d):
    path = _fresh(spark, "jsonl")
    files.write_jsonl(table(spark, d, "benchmark"), path)
    return files.read_jsonl(spark, path, "item_id long, text string").select("item_id", F.md5("text").alias("h"))


@query("src_html_pages", "SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1)) AS host, length(html) AS n FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.lower(F.regexp_extract("url", "^[a-z]+://([^/:?#]*)", 1)).alias("host"), F.length("html").cast("long").alias("n"))


@query("src_list_dates", "SELECT c_custkey, min(CAST(o_orderdate AS DATE)) AS first FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _(spark, d):
    first = table(spark, d, "orders").groupBy("o_custkey").agg(F.min(F.to_date("o_orderdate")).alias("first"))
    return table(spark, d, "customer").join(first, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "first")
