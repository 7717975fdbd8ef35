"""Language identification by interpolated Kneser-Ney character models.

One model of order four per language, learnt from counts over all training texts; no gram is left out. Counts,
discounts and probabilities are Spark tables, keyed by packed 64-bit character n-grams. The different grams of all texts get
their log-probabilities under each language by joins. The most frequent of them, as many as fit into a fixed number of
bytes, go to all tasks as sorted arrays; what a text holds of the others is joined. A text gets the language of the
lowest cross-entropy per character. Part of the training texts is kept out of what is learnt: a cross-entropy beyond what
a language's texts among them show marks a prediction as not accepted, and how much evidence its score counts is what
suits them best.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.common import materialize, slices, text_buffers

ORDER = 4
UNDETERMINED = "und"
#: Characters that the score's posterior counts at most, so that it stays calibrated for long texts: that of the least log loss is chosen.
EVIDENCE = (1, 2, 5, 10, 20, 40, 80, 160)
#: Of the training rows, one in so many is kept out of the counts.
CALIBRATION = 10
#: Part of a language's own texts, of those kept out, whose cross-entropy may lie beyond its limit.
REJECTED = 0.001
#: Bytes of grams and log-probabilities that are broadcast at most.
MAX_BROADCAST = 64 << 20
_SPACE, _BORDER = 32, 1
_KEEP = (0xFFFF, 0xFFFFFFFF, 0xFFFFFFFFFFFF)


@functools.cache
def _codes() -> np.ndarray:
    """16-bit code of every code point: letters (with marks) in lower case, all else a space."""
    out = np.full(0x110000, _SPACE, np.uint16)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = ord(c.lower()[0])
            out[cp] = low if low < 0x10000 else 0xE000 + low % 0x1900
    return out


def letters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of concatenated UTF-8 rows, runs of other characters one space, three borders before each row; the row of each code."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    if lead[-1] != len(points):  # ill-formed bytes: decode row by row
        rows = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        points = np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(r) for r in rows])
    else:
        lengths = np.diff(lead[offsets])
    row = np.repeat(np.arange(len(lengths)), lengths)
    code = _codes()[points]
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != _SPACE) | (code[:-1] != _SPACE) | (row[1:] != row[:-1])
    code, row = code[keep], row[keep]
    at = np.searchsorted(row, np.repeat(np.arange(len(lengths)), ORDER - 1))
    return np.insert(code, at, _BORDER), np.insert(row, at, np.repeat(np.arange(len(lengths)), ORDER - 1))


def grams(code: np.ndarray) -> np.ndarray:
    """The packed gram of ORDER codes that ends at each code (from the ORDER-th on)."""
    c = code.astype(np.uint64)
    n = len(c) - ORDER + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(ORDER):
        out = (out << np.uint64(16)) | c[k : k + max(n, 0)]
    return out


def count_grams(docs: DataFrame, text_col: str, tag_col: str) -> DataFrame:
    """``tag, gram, n``: counts over whole texts, added up within each task before they are shuffled. A null tag is a tag like any other."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            names = batch.column(1).to_pylist()
            known = {x: i for i, x in enumerate(dict.fromkeys(names))}
            of = np.array([known[x] for x in names])
            for a, b in slices(offsets):
                code, row = letters(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                gram, last, end = grams(code), code[ORDER - 1 :], row[ORDER - 1 :]
                for name, i in known.items():
                    g, n = np.unique(gram[(of[a + end] == i) & (last != _BORDER)], return_counts=True)
                    if name in held:
                        old, m = held[name]
                        every = np.concatenate([old, g])
                        g, inverse = np.unique(every, return_inverse=True)
                        n = np.bincount(inverse, weights=np.concatenate([m, n])).astype(np.int64)
                    held[name] = g, n
            if sum(len(g) for g, _ in held.values()) > 2_000_000:
                yield from flush(held)
        yield from flush(held)

    def flush(held: dict[str | None, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for name, (g, n) in held.items():
            for i in range(0, len(g), 200_000):
                part = slice(i, i + 200_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(g[part]), pa.string()), pa.array(g[part].view(np.int64)), pa.array(n[part])], ["tag", "gram", "n"]
                )
        held.clear()

    counted = docs.select(F.col(text_col).cast("binary").alias("text"), F.col(tag_col).cast("string").alias("tag")).mapInArrow(
        count, "tag string, gram long, n long"
    )
    return counted.groupBy("tag", "gram").agg(F.sum("n").alias("n"))


def _suffix(gram: Column, order: int) -> Column:
    """The last ``order`` characters of a packed gram."""
    return gram.bitwiseAND(F.lit(_KEEP[order - 1])) if order < ORDER else gram


def _context(gram: Column) -> Column:
    """All of a packed gram but its last character."""
    return F.shiftrightunsigned(gram, 16)


def discounts(seen: list[int]) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney, from how many grams were seen one to four times."""
    seen = [max(1, x) for x in seen]
    y = seen[0] / (seen[0] + 2 * seen[1])
    return tuple(min(k - 1e-3, max(0.1, k - (k + 1) * y * seen[k] / seen[k - 1])) for k in (1, 2, 3))


@dataclass
class Models:
    """The languages' models as tables: of order k at place k - 1, ``gram, logp`` and ``context, loglam`` with a map from a language's place to its value."""

    langs: list[str]
    grams: list[DataFrame]
    contexts: list[DataFrame]
    floor: float


def train_models(counts: DataFrame) -> Models:
    """Interpolated Kneser-Ney models from ``tag, gram, n`` counts; tags are languages, rows with a null tag are left out.

    Lower orders count the different characters before a gram. Every step is a grouping or an equality join on
    a language and a gram, whose keys have at most 65,536 partners each (one for each code).
    """
    spark = counts.sparkSession
    langs = [r[0] for r in counts.filter("tag is not null").select("tag").distinct().orderBy("tag").collect()]
    if not langs:
        return Models([], [], [], 0.0)
    places = F.create_map(*[x for i, name in enumerate(langs) for x in (F.lit(name), F.lit(i))])
    tables = [counts.filter("tag is not null").select(F.element_at(places, F.col("tag")).alias("lang"), "gram", "n")]
    for order in range(ORDER - 1, 0, -1):
        low = tables[0].groupBy("lang", _suffix(F.col("gram"), order).alias("gram")).agg(F.count("*").alias("n"))
        tables.insert(0, materialize(low, f"continued{order}"))
    floor = math.log(1 / max(2, tables[0].select("gram").distinct().count() + 1))
    models, below = Models(langs, [], [], floor), None
    for order, table in enumerate(tables, 1):
        seen = table.groupBy("lang").agg(*[F.count_if(F.col("n") == k).alias(f"n{k}") for k in range(1, 5)]).collect()
        cuts = spark.createDataFrame([(r["lang"], *discounts([r[f"n{k}"] for k in range(1, 5)])) for r in seen], "lang int, one double, two double, more double")
        cut = table.join(F.broadcast(cuts), "lang").withColumn("context", _context(F.col("gram")))  # a row for each language
        times = [F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2), F.count_if(F.col("n") > 2)]
        held = sum(t * F.max(c) for t, c in zip(times, ("one", "two", "more"), strict=True))
        left = cut.groupBy("lang", "context").agg(F.sum("n").alias("total"), (held / F.sum("n")).alias("left"))
        left = materialize(left.select("lang", "context", "total", F.greatest("left", F.lit(1e-9)).alias("left")), f"left{order}")
        known = cut.join(left, ["lang", "context"])
        if below is None:
            known = known.withColumn("low", F.lit(math.exp(floor)))
        else:
            known = known.withColumn("suffix", _suffix(F.col("gram"), order - 1)).join(below, ["lang", "suffix"])
        less = F.when(F.col("n") == 1, F.col("one")).when(F.col("n") == 2, F.col("two")).otherwise(F.col("more"))
        p = F.greatest(F.col("n") - less, F.lit(0.0)) / F.col("total") + F.col("left") * F.col("low")
        known = materialize(known.select("lang", "gram", p.alias("p")), f"order{order}")
        below = known.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("low"))
        by_lang = lambda value: F.map_from_entries(F.collect_list(F.struct("lang", F.log(value))))  # one entry for each language
        models.grams.append(known.groupBy("gram").agg(by_lang("p").alias("logp")))
        models.contexts.append(left.groupBy("context").agg(by_lang("left").alias("loglam")))
    return models


def resolve(grams: DataFrame, models: Models) -> DataFrame:
    """``gram, n, logp``: of each different gram of the texts, the log-probability of its last character under each language.

    Where a language lacks the gram, its context leaves the character to the lower order. Orders go upwards, over
    different grams of each, so that no key meets more than 65,536 others.
    """
    wanted = [grams.select("gram")]
    for order in range(ORDER - 1, 0, -1):
        wanted.insert(0, materialize(wanted[0].select(_suffix(F.col("gram"), order).alias("gram")).distinct(), f"wanted{order}"))
    places = F.array(*[F.lit(i) for i in range(len(models.langs))])
    found = None
    for order, want in enumerate(wanted, 1):
        got = want.join(models.grams[order - 1], "gram", "left").withColumn("context", _context(F.col("gram"))).join(models.contexts[order - 1], "context", "left")
        if found is None:
            low = lambda i: F.lit(models.floor)
        else:
            got = got.withColumn("suffix", _suffix(F.col("gram"), order - 1)).join(found, "suffix")
            low = lambda i: F.element_at("low", i + 1)
        value = lambda i: F.coalesce(F.element_at("logp", i), F.coalesce(F.element_at("loglam", i), F.lit(0.0)) + low(i))
        found = materialize(got.select(F.col("gram").alias("suffix"), F.transform(places, value).alias("low")), f"resolved{order}")
    return materialize(grams.join(found.select(F.col("suffix").alias("gram"), F.col("low").alias("logp")), "gram"), "resolved")


def _frequent(resolved: DataFrame, langs: int, most_bytes: int) -> int:
    """The least power of two such that the grams seen so often or more fit into ``most_bytes``."""
    sizes = {r[0]: r[1] for r in resolved.groupBy(F.length(F.bin("n")).alias("bits")).count().collect()}
    room, bits = most_bytes // (8 + 8 * langs), max(sizes, default=1)
    while bits > 0 and room >= sizes.get(bits, 0):
        room -= sizes.get(bits, 0)
        bits -= 1
    return 1 << bits


def text_scores(docs: DataFrame, resolved: DataFrame, langs: list[str], id_cols: list[str], text_col: str = "text", most_bytes: int = MAX_BROADCAST) -> DataFrame:
    """``id_cols, total, n_chars, n_letters`` of every whole text: the summed log-probability under each language (of all its characters, spaces too).

    The most frequent grams, as many as fit into ``most_bytes``, are broadcast as sorted arrays. What a text holds of others
    meets their table in a join; as only rare grams do, no key is hot.
    """
    often = _frequent(resolved, len(langs), most_bytes)
    top = resolved.filter(F.col("n") >= often).select("gram", "logp").toArrow()
    key = top.column("gram").to_numpy().view(np.uint64)
    order = np.argsort(key)
    values = top.column("logp").combine_chunks().flatten().to_numpy().reshape(len(key), len(langs))
    shared = docs.sparkSession.sparkContext.broadcast((key[order], values[order]))
    names = [*id_cols, "total", "n_chars", "n_letters", "gram", "times"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = shared.value
        for batch in batches:
            data, offsets = text_buffers(batch.column(len(id_cols)))
            for a, b in slices(offsets):
                code, row = letters(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                gram, last, of = grams(code), code[ORDER - 1 :], row[ORDER - 1 :]
                gram, last, of = (x[last != _BORDER] for x in (gram, last, of))
                n_chars, n_letters = np.bincount(of, minlength=b - a), np.bincount(of[last != _SPACE], minlength=b - a)
                each, at = np.unique(gram, return_inverse=True)
                place = np.minimum(np.searchsorted(keys, each), max(len(keys) - 1, 0))
                known = keys[place] == each if len(keys) else np.zeros(len(each), bool)
                place, here = place[at], known[at]
                total = np.zeros((b - a, len(langs)))
                for k in range(len(langs)):
                    total[:, k] = np.bincount(of[here], weights=values[place[here], k], minlength=b - a)
                pairs, times = np.unique(of[~here] * max(len(each), 1) + at[~here], return_counts=True)
                ends = pa.array(np.searchsorted(pairs, np.arange(b - a + 1) * max(len(each), 1)).astype(np.int32))
                rare = each[pairs % max(len(each), 1)].view(np.int64)
                columns = [batch.column(i).slice(a, b - a) for i in range(len(id_cols))]
                columns += [pa.array(list(total), pa.list_(pa.float64())), pa.array(n_chars), pa.array(n_letters)]
                columns += [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (rare, times)]
                yield pa.RecordBatch.from_arrays(columns, names)

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in id_cols)
    scanned = docs.select(*id_cols, F.col(text_col).cast("binary").alias("__text")).mapInArrow(
        score, f"{kinds}, total array<double>, n_chars long, n_letters long, gram array<long>, times array<long>"
    )
    scanned = materialize(scanned.withColumn("__row", F.monotonically_increasing_id()), "scanned")
    out = [*id_cols, "total", "n_chars", "n_letters"]
    rare = scanned.select("__row", F.explode(F.arrays_zip("gram", "times")).alias("g")).select("__row", F.col("g.gram").alias("gram"), F.col("g.times").alias("times"))
    sums = [F.sum(F.col("times") * F.element_at("logp", i + 1)) for i in range(len(langs))]
    rest = rare.join(resolved.filter(F.col("n") < often).select("gram", "logp"), "gram").groupBy("__row").agg(F.array(*sums).alias("rest"))
    # texts of frequent grams alone are not shuffled
    some = scanned.filter(F.size("gram") > 0).drop("gram", "times").join(rest, "__row").withColumn("total", F.zip_with("total", "rest", lambda x, y: x + y))
    return scanned.filter(F.size("gram") == 0).select(*out).union(some.select(*out))


def score_languages(docs: DataFrame, counts: DataFrame, id_cols: list[str], text_col: str = "text", most_bytes: int = MAX_BROADCAST) -> DataFrame:
    """``id_cols, lang_pred, scores, entropy, n_letters`` of every whole text, a score for each of EVIDENCE. Texts without a letter are undetermined, with score 0.

    ``counts`` (``tag, gram, n``) hold all grams of the texts; those with a tag are learnt from.
    """
    models = train_models(counts)
    nothing = [F.lit(UNDETERMINED).alias("lang_pred"), F.array_repeat(F.lit(0.0), len(EVIDENCE)).alias("scores"), F.lit(0.0).alias("entropy"), F.lit(0).cast("long").alias("n_letters")]
    if not models.langs:
        return docs.select(*id_cols, *nothing)
    resolved = resolve(counts.groupBy("gram").agg(F.sum("n").alias("n")), models)
    totals = text_scores(docs, resolved, models.langs, id_cols, text_col, most_bytes)
    chars, least = F.greatest("n_chars", F.lit(1)), F.array_min("h")
    h = totals.withColumn("h", F.transform("total", lambda t: F.round(-t / chars, 9)))  # sums come in any order: beyond that, reruns would differ
    names = F.array(*[F.lit(x) for x in models.langs])
    seen = F.col("n_letters") > 0
    weigh = lambda e: F.aggregate("h", F.lit(0.0), lambda s, x: s + F.exp(-(x - least) * F.least("n_letters", F.lit(e))))
    return h.select(
        *id_cols,
        F.when(seen, F.element_at(names, F.array_position("h", least).cast("int"))).otherwise(UNDETERMINED).alias("lang_pred"),
        F.array(*[F.when(seen, 1 / weigh(e)).otherwise(0.0) for e in EVIDENCE]).alias("scores"),
        F.when(seen, least).otherwise(0.0).alias("entropy"),
        "n_letters",
    )


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held: int = 2) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, entropy, n_letters, accepted`` for every row.

    Learns from the whole texts of rows with a language whose crc32 of the id modulo ``folds`` is not
    ``held`` (a null id is not learnt from); language and id play no part in a prediction. One in CALIBRATION of
    these rows is kept out of the counts. ``accepted`` is false beyond the cross-entropy that all but REJECTED of the
    language's own texts among these keep to (a language without any accepts all), and ``score`` is the posterior whose
    evidence suits them.
    Null texts and texts without letters are ``und`` with score 0 and accepted false; with nothing to learn from,
    all are. Ties go to the language that sorts first. Repeated rows give a row each.
    """
    code = F.crc32(F.col(id_col).cast("string"))
    held_out = F.coalesce(code % folds == held, F.lit(False))
    role = F.when(held_out | F.col(id_col).isNull() | F.col(lang_col).isNull() | F.col(text_col).isNull(), "none").when(F.floor(code / folds) % CALIBRATION == 0, "calibrate").otherwise("count")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), role.alias("role"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")
    )
    counts = materialize(count_grams(rows.withColumn("tag", F.when(F.col("role") == "count", F.col("lang"))), "text", "tag"), "grams")
    scored = materialize(score_languages(rows, counts, ["doc_id", "held_out", "role", "lang"], "text"), "scored")
    apart = scored.filter("role = 'calibrate' and n_letters > 0")
    limits = apart.filter("lang = lang_pred").groupBy("lang_pred").agg(F.percentile_approx("entropy", 1 - REJECTED, 10000).alias("limit"))
    right = F.col("lang") == F.col("lang_pred")
    loss = [F.avg(-F.log(F.greatest(F.when(right, p := F.element_at("scores", i + 1)).otherwise(1 - p), F.lit(1e-9)))) for i in range(len(EVIDENCE))]
    losses = apart.agg(*loss).head()
    best = min(range(len(EVIDENCE)), key=lambda i: (losses[i], i)) if losses[0] is not None else 0
    known = scored.join(F.broadcast(limits), "lang_pred", "left")  # a row for each language
    inside = (F.col("n_letters") > 0) & (F.col("lang_pred") != UNDETERMINED) & (F.col("limit").isNull() | (F.col("entropy") <= F.col("limit")))
    return known.select(
        "doc_id", "held_out", "lang_pred", F.element_at("scores", best + 1).alias("score"), "entropy", "n_letters", F.coalesce(inside, F.lit(False)).alias("accepted")
    )
