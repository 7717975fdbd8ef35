import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from tarnflow.llm import language_id as op

EN = "the house on the hill was old and the people who lived there were kind to every stranger that came by".split()
DE = "das alte haus auf dem hügel war schön und die leute die dort wohnten waren freundlich zu jedem fremden".split()


def rows(n=400, seed=2):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(EN if i % 2 else DE) for _ in range(25)), "en" if i % 2 else "de", i) for i in range(n)]


def test_prediction_on_held_out_texts(spark):
    data = rows() + [(1000, None, "en", 0), (1001, "123 !!", "en", 0), (1002, "", None, 0), (None, "the house", "en", 0), (3, "the old people", None, 0), (1003, "das haus " * 30000, "de", 0)]
    got = op.identify_languages(spark.createDataFrame(data, "doc_id long, text string, lang string, entropy long")).collect()
    assert len(got) == len(data)
    for r in got:
        assert 0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if r.doc_id in (1000, 1001, 1002):
            assert r.lang_pred == "und" and r.score == 0
    want = {i: lang for i, _, lang, _ in rows()}
    held = [r for r in got if r.held_out and r.doc_id in want]
    assert sum(r.lang_pred == want[r.doc_id] for r in held) == len(held) > 50
    assert next(r for r in got if r.doc_id == 1003).lang_pred == "de"


def test_language_is_no_input_of_a_prediction(spark):
    schema = "doc_id long, text string, lang string"
    a = [(i, t, lang) for i, t, lang, _ in rows(120)]
    b = [(i, t, lang if zlib.crc32(str(i).encode()) % 4 != 2 else None) for i, t, lang in a]
    x, y = (sorted(map(str, op.identify_languages(spark.createDataFrame(z, schema)).collect())) for z in (a, b))
    assert x == y


def brute_models(texts):
    """Interpolated Kneser-Ney models, modified discounts, by plain dictionaries: language -> probability of a character behind three."""
    count = {lang: Counter() for lang in sorted({lang for _, lang in texts})}
    for t, lang in texts:
        count[lang].update(brute_grams(t))
    letters = {g[-1] for c in count.values() for g in c}
    floor = 1 / max(2, len(letters) + 1)
    out = {}
    for lang, c in count.items():
        orders = {4: c}
        for k in (3, 2, 1):
            orders[k] = Counter(g[1:] for g in orders[k + 1])
        out[lang] = brute_probability(orders, floor)
    return out


def brute_grams(text):
    padded = "\1\1\1" + re.sub(" +", " ", "".join(x if x.isalpha() else " " for x in text.lower()))
    return [padded[i - 3 : i + 1] for i in range(3, len(padded))]


def brute_probability(orders, floor):
    cuts, totals, left = {}, {}, {}
    for k, c in orders.items():
        seen = [max(1, sum(n == j for n in c.values())) for j in (1, 2, 3, 4)]
        y = seen[0] / (seen[0] + 2 * seen[1])
        cuts[k] = [0] + [min(j - 1e-3, max(0.1, j - (j + 1) * y * seen[j] / seen[j - 1])) for j in (1, 2, 3)]
        totals[k], left[k] = Counter(), Counter()
        for g, n in c.items():
            totals[k][g[:-1]] += n
            left[k][g[:-1]] += cuts[k][min(n, 3)]

    def p(g):
        k = len(g)
        if not k:
            return floor
        low, context = p(g[1:]), g[:-1]
        if context not in totals[k]:
            return low
        n = orders[k].get(g, 0)
        return max(n - cuts[k][min(n, 3)], 0) / totals[k][context] + max(left[k][context] / totals[k][context], 1e-9) * low

    return p


def many_letters(n=90, seed=6):
    """Texts with counts of every kind, of three languages, one with few texts."""
    rng = random.Random(seed)
    word = lambda base: "".join(rng.choice(base) for _ in range(rng.randint(1, 5)))
    return [(" ".join(word(["abcdef", "cdefghé", "ефгхab"][i % 7 % 3]) for _ in range(20)), ["x", "y", "z"][i % 7 % 3]) for i in range(n)]


def test_predictions_against_brute_force_with_and_without_broadcast(spark):
    learnt, other = many_letters(), [t for t, _ in many_letters(40, seed=7)] + ["qqq abq", "ab", "é", None, "12"]
    docs = [(i, t, lang) for i, (t, lang) in enumerate(learnt)] + [(1000 + i, t, None) for i, t in enumerate(other)]
    df = spark.createDataFrame(docs, "i long, text string, tag string").repartition(3)
    counts = op.materialize(op.count_grams(df, "text", "tag"), "grams")
    models = brute_models(learnt)
    for room in (0, 5000, op.MAX_BROADCAST):  # none, some and all grams broadcast
        got = {r.i: r for r in op.score_languages(df, counts, ["i"], "text", room).collect()}
        assert len(got) == len(docs)
        for i, t, _ in docs:
            if not t or not any(x.isalpha() for x in t):
                assert got[i].lang_pred == "und"
                continue
            g = brute_grams(t)
            h = {lang: -sum(math.log(p(x)) for x in g) / len(g) for lang, p in models.items()}
            assert abs(got[i].entropy - min(h.values())) < 1e-6 and h[got[i].lang_pred] < min(h.values()) + 1e-6
            n = sum(x.isalpha() for x in re.sub(" +", " ", t))
            for e, score in zip(op.EVIDENCE, got[i].scores, strict=True):
                assert abs(score - 1 / sum(math.exp(-(x - min(h.values())) * min(n, e)) for x in h.values())) < 1e-5


def test_broadcast_is_bounded_and_takes_the_most_frequent(spark):
    df = spark.createDataFrame([(i, 2 ** (i % 5)) for i in range(50)], "gram long, n long")
    room = lambda grams: grams * (8 + 8 * 3)
    assert [op._frequent(df, 3, room(k)) for k in (0, 9, 10, 29, 30, 50, 99)] == [32, 32, 16, 8, 4, 1, 1]


def test_counts_against_brute_force(spark):
    data = [(t, lang) for _, t, lang, _ in rows(20)] + [("ohne sprache", None)]
    counts = {(r.tag, r.gram): r.n for r in op.count_grams(spark.createDataFrame(data, "text string, lang string").repartition(3), "text", "lang").collect()}
    brute = Counter()
    for t, lang in data:
        for x in brute_grams(t):
            g = sum(ord(c) << 16 * (3 - j) for j, c in enumerate(x))
            brute[lang, g - 2**64 if g >= 2**63 else g] += 1
    assert counts == brute


def test_nothing_to_learn_from(spark):
    got = op.identify_languages(spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")).collect()
    assert len(got) == 1 and 0 <= got[0].score <= 1
    assert op.identify_languages(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_no_gram_is_left_out_with_many_languages(spark):
    rng = np.random.default_rng(5)
    langs = [f"l{i:03d}" for i in range(60)]
    words = ["".join(chr(0x4E00 + c) for c in rng.integers(0, 4000, 900)) for _ in langs]
    docs = spark.createDataFrame(list(zip(range(60), words, langs, strict=True)), "i int, text string, lang string")
    counts = op.materialize(op.count_grams(docs, "text", "lang"), "grams")
    models = op.train_models(counts)
    assert models.langs == langs
    assert models.grams[3].count() == counts.select("gram").distinct().count()
    got = op.score_languages(docs, counts, ["i"], "text", 1 << 20).collect()  # 54,000 grams of 488 bytes do not fit
    assert len(got) == 60 and all(r.lang_pred == langs[r.i] for r in got)


def test_calibration_rows_are_kept_out_of_the_counts(spark):
    schema = "doc_id long, text string, lang string"
    kept_out = lambda i: zlib.crc32(str(i).encode()) % 4 != 2 and zlib.crc32(str(i).encode()) // 4 % op.CALIBRATION == 0
    a = [(i, t, lang) for i, t, lang, _ in rows(160)]
    assert sum(kept_out(i) for i, _, _ in a) > 5
    b = [(i, "qqq " + t if kept_out(i) else t, lang) for i, t, lang in a]
    x, y = ({r.doc_id: (r.lang_pred, r.entropy) for r in op.identify_languages(spark.createDataFrame(z, schema)).collect()} for z in (a, b))
    assert all(x[i] == y[i] for i in x if not kept_out(i)) and any(x[i] != y[i] for i in x)


def test_ties_go_to_the_first_language(spark):
    same = [(i, "the same words in both", lang) for i, lang in enumerate(["b", "a"] * 40)]
    got = op.identify_languages(spark.createDataFrame(same, "doc_id long, text string, lang string").filter("crc32(cast(doc_id as string)) % 4 != 2 and (crc32(cast(doc_id as string)) div 4) % 10 != 0"))
    rows = got.collect()
    assert {r.lang_pred for r in rows} <= {"a", "b"}
    docs = spark.createDataFrame([(i, "the same words", x) for i, x in enumerate("ba")], "i int, text string, tag string")
    for room in (0, op.MAX_BROADCAST):
        assert [r.lang_pred for r in op.score_languages(docs, op.count_grams(docs, "text", "tag"), ["i"], "text", room).collect()] == ["a", "a"]
