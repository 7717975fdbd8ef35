"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations


def _escape(column: str) -> str:
    return rf"regexp_replace(coalesce({column}, ''), '<(\\*)\|', '<\1\\|', 'g')"


def _render(turns: str) -> str:
    return f"coalesce(array_to_string(list_transform({turns}, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), ''), '')"


def _spans(turns: str) -> str:
    """Start and end of each assistant text: a turn is 13 characters longer than its role and text."""
    start = f"(CAST(coalesce(list_sum(list_transform(({turns})[1:i - 1], lambda u: length(u.role) + length(u.text) + 13)), 0) AS BIGINT) + length(t.role) + 5)"
    each = f"list_transform({turns}, lambda t, i: CASE WHEN t.role = 'assistant' THEN {start} || ':' || ({start} + length(t.text) + 7) END)"
    return f"coalesce(array_to_string(list_filter({each}, lambda x: x IS NOT NULL), ','), '')"


CHAT_FORMAT = f"""
WITH t AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, text) AS turns FROM (SELECT conv_id, turn, {_escape('role')} AS role, {_escape('text')} AS text FROM conversations) WHERE conv_id IS NOT NULL GROUP BY conv_id),
c AS (SELECT *, turns[1] AS opening, coalesce(list_sum(list_transform(list_filter(turns, lambda t: t.role = 'assistant'), lambda t: length(t.text))), 0) AS said FROM t),
best AS (SELECT opening, conv_id AS best_id, turns AS best_turns FROM c QUALIFY row_number() OVER (PARTITION BY opening ORDER BY said DESC, conv_id) = 1),
p AS (SELECT c.*, best_id, best_turns, turns <> best_turns AS pair,
  coalesce(list_position(list_transform(range(1, least(len(turns), len(best_turns)) + 1), lambda i: turns[i] = best_turns[i]), false) - 1, least(len(turns), len(best_turns))) AS n,
  coalesce(list_max(list_transform(turns, lambda t, i: CASE WHEN t.role = 'assistant' THEN i - 1 END)), len(turns)) AS head FROM c JOIN best USING (opening)),
s AS (SELECT conv_id, pair, best_id, n, head, CASE WHEN pair THEN turns[1:n] ELSE turns[1:head] END AS front, CASE WHEN pair THEN best_turns[n + 1:] ELSE turns[head + 1:] END AS a, turns[n + 1:] AS b FROM p)
SELECT conv_id, CASE WHEN pair THEN best_id ELSE conv_id END AS chosen_id, CASE WHEN pair THEN CAST(n AS INT) END AS n_common, {_render('front')} AS prompt,
  {_render('a')} AS chosen, {_spans('a')} AS chosen_mask, CASE WHEN pair THEN {_render('b')} END AS rejected, CASE WHEN pair THEN {_spans('b')} END AS rejected_mask FROM s"""


MIX_SOURCES = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), text, '')) AS o, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
e AS (SELECT *, greatest(0, CAST(length(bin(size)) AS BIGINT) - 7) AS low FROM d),
f AS (SELECT doc_id, source, o, size, (size >> CAST(low AS INT)) << CAST(low AS INT) AS class FROM e),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight FROM f GROUP BY source),
lim AS (SELECT *, source_size::DOUBLE * 3 AS lim FROM per),
lev AS (SELECT *, greatest(0, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level FROM lim),
tar AS (SELECT source, source_size, least(lim, max(level) OVER () * weight) AS target FROM lev),
cls AS (SELECT f.source, class, count(*) AS n, CAST(sum(size) AS BIGINT) AS words, row_number() OVER (PARTITION BY f.source ORDER BY class DESC) AS k FROM f GROUP BY f.source, class),
mean AS (SELECT sum(words * CASE WHEN class > 0 THEN log2(class) ELSE 0 END) / greatest(sum(words), 1) AS at, 1.0 * sum(words) AS ridge FROM cls),
cell AS (SELECT c.source, c.words, log2(c.class) - m.at AS z FROM cls c, mean m WHERE c.words > 0),
-- Newton steps on the dual: lam of each source that is below its limit, mu for length
dual AS (
  SELECT CAST(0 AS INT) AS step, source, target, CASE WHEN target >= source_size * 3::DOUBLE * (1 - 1e-9) THEN 'infinity'::DOUBLE ELSE ln(target / source_size) END AS lam, CAST(0 AS DOUBLE) AS mu FROM tar WHERE target > 0
  UNION ALL
  SELECT step + 1, source, target, CASE WHEN lam < 'infinity'::DOUBLE THEN lam + greatest(-1, least(1, coalesce((target - got - b * move) / nullif(h, 0), -1))) ELSE lam END, mu + move
  FROM (SELECT *, greatest(-1, least(1, -(sum(m) OVER () + ridge * mu + sum(CASE WHEN lam < 'infinity'::DOUBLE AND h > 0 THEN b / h * (target - got) ELSE 0 END) OVER ())
      / (sum(CASE WHEN lam < 'infinity'::DOUBLE THEN c - CASE WHEN h > 0 THEN b * b / h ELSE 0 END ELSE 0 END) OVER () + ridge))) AS move
    FROM (SELECT step, source, any_value(target) AS target, any_value(lam) AS lam, any_value(mu) AS mu, any_value(ridge) AS ridge, sum(wr) AS got, sum(wh) AS h, sum(wh * z) AS b, sum(wh * z * z) AS c, sum(wr * z) AS m
      FROM (SELECT d.*, c.z, n.ridge, c.words * CASE WHEN d.lam + d.mu * c.z < ln(3) THEN exp(d.lam + d.mu * c.z) ELSE 3 END AS wr, CASE WHEN d.lam + d.mu * c.z < ln(3) THEN c.words * exp(d.lam + d.mu * c.z) ELSE 0 END AS wh
        FROM dual d JOIN cell c ON c.source IS NOT DISTINCT FROM d.source, mean n WHERE d.step < 30) GROUP BY step, source))),
rat AS (SELECT c.source, c.class, t.source_size, t.target, round(CASE WHEN d.lam IS NULL THEN 0 ELSE least(exp(d.lam + d.mu * CASE WHEN c.class > 0 THEN log2(c.class) - m.at ELSE 0 END), 3) END, 9) AS rate
  FROM cls c JOIN tar t ON t.source IS NOT DISTINCT FROM c.source LEFT JOIN (SELECT * FROM dual WHERE step = 30) d ON d.source IS NOT DISTINCT FROM c.source, mean m),
fold AS (
  SELECT source, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS class, CAST(0 AS BIGINT) AS copies, CAST(0 AS DOUBLE) AS carry FROM tar
  UNION ALL
  SELECT source, k, class, copies, want - copies * words::DOUBLE / n FROM (
    SELECT c.source, c.k, c.class, c.words, c.n, r.rate * c.words + o.carry AS want,
      greatest(0, least(CAST(round(CASE WHEN c.words > 0 THEN (r.rate * c.words + o.carry) / (c.words::DOUBLE / c.n) ELSE r.rate * c.n END) AS BIGINT), c.n * 3)) AS copies
    FROM fold o JOIN cls c ON c.source IS NOT DISTINCT FROM o.source AND c.k = o.k + 1 JOIN rat r ON r.source IS NOT DISTINCT FROM c.source AND r.class = c.class)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source, class ORDER BY o, doc_id, size) AS i, count(*) OVER (PARTITION BY source, class) AS n FROM f),
taken AS (SELECT a.doc_id, a.size, r.source_size, r.target, r.rate, (a.i * o.copies) // a.n - ((a.i - 1) * o.copies) // a.n AS copies
  FROM ranked a JOIN fold o ON o.source IS NOT DISTINCT FROM a.source AND o.class = a.class JOIN rat r ON r.source IS NOT DISTINCT FROM a.source AND r.class = a.class)
SELECT doc_id, size, source_size, round(target, 6) AS target, CAST(copies * size AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies, rate FROM taken"""

_TERMS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

RANKED_SEARCH = f"""
WITH d AS (SELECT doc_id, {_TERMS.format('text')} AS terms FROM documents),
s AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(terms)) AS BIGINT) AS total FROM d WHERE len(terms) > 0),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS.format('text')}) AS term FROM benchmark) GROUP BY item_id, term),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, n, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * max(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term),
i AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total))) AS impact FROM p JOIN w USING (term), s),
r AS (SELECT item_id, doc_id, CAST(sum(times * impact) AS BIGINT) AS score FROM q JOIN i USING (term) GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM r WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10"""
