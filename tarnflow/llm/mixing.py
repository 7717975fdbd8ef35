"""Mixing sources to target weights by entropy balancing.

Every word starts with weight one. The weights nearest to that (in relative entropy, none above ``most``) that
give each source its target of words, and keep the mean log length of the documents that a word comes from
near that of the corpus, are exponentials of one dual variable per source and one for length. Newton steps on
the convex dual find them; each takes its gradient and Hessian as sums over the documents, pre-added by source and
size class, in which all documents have one rate. Rates become whole copies by carrying the rounding error from
long documents to short ones, so that a source's words come near its target. All of it is DataFrame expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnflow.llm.common import materialize

WEIGHTS = (5, 2, 1)
MOST = 3
#: Newton steps at most, and the part of any target that may be missed when they end.
STEPS = 30
CLOSE = 1e-11
#: Strength, in words of the corpus, of a pull of the variable for length to zero: lengths give way, targets do not.
RIDGE = 1.0
#: Documents of one source and size class are ranked by hash in parts of about so many, by the hash's first hex digits.
PART = 50_000


def word_count(text_col: str = "text") -> Column:
    """Words of a text: runs of anything but ASCII white space (null: 0)."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``skey, source_size, target`` of each source, from ``skey, source, size`` rows.

    Sources in code-point order (null last) take the weights in turn: they are cut into ranges, numbered in
    each, and moved on by what the ranges before hold. A target stops at ``most`` times the source's size, and the
    excess is shared anew: the level of the others rises until no more sources are at their limit.
    """
    per = sizes.groupBy("skey").agg(F.min("source").alias("source"), F.sum("size").alias("source_size"))
    per = per.repartitionByRange(F.col("source").isNull(), "source").withColumn("part", F.spark_partition_id())
    per = materialize(per, "sources")
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each range
    ahead = per.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("ahead"))
    turn = F.col("ahead") + F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    limit = F.col("source_size").cast("double") * most
    per = materialize(per.join(F.broadcast(ahead), "part").select("skey", "source_size", weight.alias("weight"), limit.alias("limit")), "weights")
    level, last = 0.0, -1.0
    while level != last:
        full = F.col("limit") < F.lit(level) * F.col("weight")
        all_words, held, rest = per.agg(F.sum("source_size"), F.sum(F.when(full, F.col("limit"))), F.sum(F.when(~full, F.col("weight")))).head()
        last, level = level, max(level, (float(all_words) - (held or 0.0)) / rest) if rest else level
    return per.select("skey", "source_size", F.least("limit", F.lit(level) * F.col("weight")).alias("target"))


def _newton(cells: DataFrame, targets: DataFrame, most: int = MOST, steps: int = STEPS) -> tuple[DataFrame, float]:
    """``skey, source_size, target, lam`` and the variable for length, from ``skey, z, words`` cells; ``lam`` is null for a rate of 0 and infinite for one of ``most``.

    A step solves the bordered system by its Schur complement: sums over a source's cells, then over sources.
    """
    size = F.col("source_size").cast("double")
    free = (F.col("target") > 0) & (F.col("target") < size * most * (1 - 1e-9))
    lam = F.when(free, F.log(F.col("target") / size)).when(F.col("target") > 0, F.lit(math.inf))
    state, mu = materialize(targets.select("skey", "source_size", "target", lam.alias("lam")), "dual"), 0.0
    ridge = RIDGE * float(cells.agg(F.coalesce(F.sum("words"), F.lit(0))).head()[0])
    for _ in range(steps):
        x = F.col("lam") + F.lit(mu) * F.col("z")
        got = F.col("words") * F.when(x < math.log(most), F.exp(x)).otherwise(F.lit(float(most)))
        each = cells.join(state, "skey").filter("lam is not null").select("skey", "z", got.alias("got"), F.when(x < math.log(most), got).otherwise(F.lit(0.0)).alias("h"))
        sums = each.groupBy("skey").agg(
            F.sum("got").alias("got"), F.sum("h").alias("h"), F.sum(F.col("h") * F.col("z")).alias("b"), F.sum(F.col("h") * F.col("z") ** 2).alias("c"), F.sum(F.col("got") * F.col("z")).alias("m")
        )
        now = materialize(state.join(sums, "skey", "left"), "step")
        open_ = F.col("lam") < math.inf
        g, tilt = F.col("target") - F.col("got"), F.try_divide(F.col("b"), F.nullif(F.col("h"), F.lit(0.0)))
        moment, bend, pull, missed = now.agg(
            F.sum("m"), F.sum(F.when(open_, F.col("c") - F.coalesce(F.col("b") * tilt, F.lit(0.0)))), F.sum(F.when(open_, F.coalesce(tilt * g, F.lit(0.0)))), F.max(F.when(open_, F.abs(g) / F.col("target")))
        ).head()
        if missed is None:
            break
        by = max(-1.0, min(1.0, -(moment + ridge * mu + pull) / (bend + ridge)))
        if missed < CLOSE and abs(by) < CLOSE:
            break
        move = F.coalesce(F.try_divide(g - F.col("b") * by, F.nullif(F.col("h"), F.lit(0.0))), F.lit(-1.0))
        state = now.select("skey", "source_size", "target", F.when(open_, F.col("lam") + F.greatest(F.lit(-1.0), F.least(F.lit(1.0), move))).otherwise(F.col("lam")).alias("lam"))
        mu += by
    return state, mu


def _round_classes(classes: Column, most: int) -> Column:
    """Copies for each size class of a source, largest first: what a class takes too much or too little, the next makes good."""
    words, count = (lambda c: c["words"].cast("double")), (lambda c: c["count"])

    def put(state: Column, c: Column) -> Column:
        want = c["rate"] * words(c) + state["carry"]
        mean = words(c) / count(c)
        copies = F.when(c["words"] > 0, F.round(want / F.nullif(mean, F.lit(0.0)))).otherwise(F.round(c["rate"] * count(c)))
        copies = F.greatest(F.lit(0), F.least(copies.cast("long"), count(c) * most)).cast("long")
        new = F.struct(c["class"].alias("class"), copies.alias("copies"), c["rate"].alias("rate"))
        return F.struct((want - copies * mean).alias("carry"), F.concat(state["out"], F.array(new)).alias("out"))

    start = F.struct(F.lit(0.0).alias("carry"), F.array().cast("array<struct<class:bigint,copies:bigint,rate:double>>").alias("out"))
    return F.aggregate(classes, start, put, lambda s: s["out"])


def _keys(id_col: str, text_col: str, source_col: str) -> dict[str, Column]:
    """What the mix reads of a row: source, size, and a hash by which rows of a class are ordered (of the id; without one, of the text)."""
    source, name, text = F.col(source_col).cast("string"), F.col(id_col).cast("string"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return {
        "source": source, "skey": F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source)), "size": word_count(text_col),
        "order": F.md5(F.coalesce(name, text)), "tie": F.xxhash64(text),
    }


def _class_plan(sizes: DataFrame, weights: tuple[int, ...], most: int, digits: int) -> DataFrame:
    """``skey, class, salt, count, ahead, class_copies, source_size, target, rate``: what each part of a size class of a source takes."""
    targets = source_targets(sizes, weights, most)
    parts = materialize(sizes.withColumn("salt", F.substring("order", 1, digits)).groupBy("skey", "class", "salt").agg(F.count("*").alias("n"), F.sum("size").alias("words")), "parts")
    classes = materialize(parts.groupBy("skey", "class").agg(F.sum("n").alias("count"), F.sum("words").alias("words")), "classes")
    z = F.log2(F.col("class").cast("double"))
    all_words, length = classes.agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum(F.col("words") * z), F.lit(0.0))).head()
    z = F.when(F.col("class") > 0, z - F.lit(length / max(int(all_words), 1))).otherwise(F.lit(0.0))
    classes = classes.withColumn("z", z)
    dual, mu = _newton(classes.select("skey", "z", "words").filter("words > 0"), targets, most)
    rate = F.when(F.col("lam").isNull(), F.lit(0.0)).otherwise(F.least(F.exp(F.col("lam") + F.lit(mu) * F.col("z")), F.lit(float(most))))
    rated = classes.join(dual, "skey").withColumn("rate", F.round(rate, 9))  # sums come in any order: beyond that, reruns would differ
    # a source has a few hundred size classes at most: 64 for each doubling of the size
    lists = rated.groupBy("skey").agg(
        F.sort_array(F.collect_list(F.struct("class", "count", "words", "rate")), asc=False).alias("classes"), F.max("source_size").alias("source_size"), F.max("target").alias("target")
    )
    copies = lists.select("skey", "source_size", "target", F.explode(_round_classes(F.col("classes"), most)).alias("c"))
    copies = copies.select("skey", "source_size", "target", "c.class", F.col("c.copies").alias("class_copies"), "c.rate")
    ahead = Window.partitionBy("skey", "class").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each part
    parts = parts.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n", "words")
    return materialize(parts.join(classes.select("skey", "class", "count"), ["skey", "class"]).join(copies, ["skey", "class"]), "copies")


def _mixed(rows: DataFrame, sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """``rows`` (with ``skey, class, size, order, tie`` and ``doc_id``) with what the mix, planned from their ``sizes``, does with each."""
    digits = max(1, math.ceil(math.log(max(sizes.count(), 1) / PART, 16)))
    plan = _class_plan(sizes, weights, most, digits)
    rank = F.row_number().over(Window.partitionBy("skey", "class", "salt").orderBy("order", "doc_id", "size", "tie")).cast("long")
    # the rows lie by these keys already; as a file the parts are far smaller than in memory, so Spark would broadcast them
    ranked = rows.withColumn("salt", F.substring("order", 1, digits)).withColumn("rank", rank).join(plan.hint("merge"), ["skey", "class", "salt"])
    ranked = ranked.withColumn("copies", F.expr("((ahead + rank) * class_copies) div count - ((ahead + rank - 1) * class_copies) div count"))
    return ranked.withColumn("taken", F.col("copies") * F.col("size"))


def _with_class(rows: DataFrame) -> DataFrame:
    """A size's class: its seven leading bits."""
    return rows.withColumn("low", F.greatest(F.lit(0), F.length(F.bin("size")) - 7)).withColumn("class", F.expr("shiftleft(shiftright(size, low), low)")).drop("low")


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST
) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies, rate`` for every row: 0 to ``most`` whole copies of each document.

    Sizes count words (null text: 0). A null source is a source of its own, the last. Documents without
    words are taken at their source's mean rate but give no words. A source whose documents are few and long
    can miss its target by up to half of its shortest document. Repeated rows are documents of their
    own. Which documents get the odd copy depends on hashes of their ids (without an id, of their texts), then on size and
    text, so reruns agree in any order of rows. An empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *[c.alias(n) for n, c in _keys(id_col, text_col, source_col).items()])
    rows = materialize(_with_class(rows), "sizes")
    return _mixed(rows, rows, weights, most).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def take_mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST
) -> DataFrame:
    """The documents that the mix takes, with ``copies`` and ``taken`` (``mix_copies``, ``mix_taken`` where those names are in use).

    Each row has its own copies, rows without an id or of one id too; rows with no copy are left out. An empty table gives none.
    """
    keys = _keys(id_col, text_col, source_col)
    sizes = materialize(_with_class(docs.select(*[c.alias(n) for n, c in keys.items()])), "sizes")
    rows = _with_class(docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), *[c.alias(n) for n, c in keys.items() if n != "source"]))
    names = {c.lower() for c in docs.columns}
    new = [F.col(c).alias(c if c not in names else f"mix_{c}") for c in ("copies", "taken")]
    return _mixed(rows, sizes, weights, most).filter("copies > 0").select("row.*", *new)
