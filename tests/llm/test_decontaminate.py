import random
import re

import numpy as np

from tarnflow.llm import decontaminate as op

ITEM = "A train leaves the old station at 9 and travels 120 km toward the coast where Maria waits for 3 hours with a small red suitcase"
OTHER = "Compute how many apples remain in the basket after the farmer gives seven of them to each neighbour who lives nearby"
NOISE = "the quick brown fox jumps over the lazy dog while nobody on the hill seems to notice what the weather does today "


def found(spark, docs, items=((1, ITEM), (2, OTHER))):
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, coverage int")
    b = spark.createDataFrame(list(items), "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in op.find_contamination(d, b).collect()}


def test_leaks_are_found_and_clean_texts_are_not(spark):
    changed = ITEM.replace("9", "11").replace("120", "450").replace("Maria", "Tom").replace("3 hours", "5 hours")
    docs = [(1, NOISE + ITEM + NOISE), (2, NOISE + changed), (3, NOISE * 3), (4, None), (5, ""), (6, NOISE + " ".join(OTHER.split()[:7]) + " " + NOISE),
            (7, OTHER.upper()), (8, OTHER.replace(" ", "\n\t")), (9, NOISE * 400 + OTHER), (1, NOISE + ITEM + NOISE), (None, OTHER)]
    got = found(spark, docs)
    assert set(got) == {(1, 1), (2, 1), (7, 2), (8, 2), (9, 2), (None, 2)}
    assert got[1, 1].verbatim and not got[2, 1].verbatim
    assert got[9, 2].coverage == 1.0


def test_slots_must_agree(spark):
    item = "If x is 5 then add 5 to the sum and again take 5 from what is left in the jar"
    same, torn = item.replace("5", "8"), item.replace("5", "8", 1).replace("5", "9", 1)
    assert set(found(spark, [(1, same), (2, torn)], [(1, item)])) == {(1, 1)}


def test_tokens_of_many_rows_are_those_of_each():
    texts = [ITEM, OTHER, NOISE, "Short one", "", "Élan vital à 5 kg, «quoted» words go on and on for ever"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    for named in (False, True):
        w = op.template(op.tokens(data, offsets), named)
        alone = []
        for t in texts:
            b = np.frombuffer(t.encode(), np.uint8)
            alone.append(op.template(op.tokens(b, np.array([0, len(b)])), named))
        for name in ("code", "value", "place"):
            assert np.array_equal(getattr(w, name), np.concatenate([getattr(a, name) for a in alone]))
        for n in (5, 8):
            at, h, _ = op.windows(w, n)
            assert np.array_equal(h, np.concatenate([op.windows(a, n)[1] for a in alone]))
            assert len(at) == sum(max(0, len(a.code) - n + 1) for a in alone)


def plainly(text, named):
    """Template words by regular expressions and a loop: (kind or word, value, begins a sentence)."""
    out, end, number = [], 0, False
    for m in re.finditer(r"[0-9]+|[^\W\d_]+", text):
        word, first = m[0], not out or bool(re.search(r"[.!?:;\n\r\"*#|-]", text[end : m.start()]))
        if word[0].isdigit():
            kind = "<number>"
        elif number and word.lower() in op.UNITS:
            kind = "<unit>"
        elif word[0].isupper() and (named or not first) and not word[1:2].isupper():
            kind = "<name>"
        else:
            kind = word.lower()
        if out and kind[0] == "<" and out[-1][0] == kind and not first:
            out[-1] = (kind, out[-1][1] + text[end : m.end()].lower(), out[-1][2])
        else:
            out.append((kind, word.lower(), first))
        end, number = m.end(), kind == "<number>"
    return out


def plain_windows(words):
    out = []
    for i in range(len(words)):
        for n in range(8, 17):
            part = words[i : i + n]
            plain = sum(w[0][0] != "<" for w in part)
            if len(part) == n and n == 8:
                out.append((n, tuple(w[1] for w in part) if plain < 5 else tuple(w[0] for w in part), plain < 5))
            elif len(part) == n and plain == 5 and sum(w[0][0] != "<" for w in part[:-1]) == 4:
                out.append((n, tuple(w[0] for w in part), False))
    return out


def test_windows_against_brute_force():
    rng = random.Random(5)
    pool = "the of runs Tom Anna Maria 7 12 km hours apples. Each has gives. red with 3, Bob Smith then add 900 kg to? A".split()
    for _ in range(60):
        text = " ".join(rng.choices(pool, k=40))
        data = np.frombuffer(text.encode(), np.uint8)
        for named in (False, True):
            w = op.template(op.tokens(data, np.array([0, len(data)])), named)
            words = plainly(text, named)
            assert [a[0][0] == "<" for a in words] == (~w.plain).tolist() and [a[2] for a in words] == w.first.tolist()
            hashes = {}
            for n, at, h, _ in op._all_windows(w, [8], False):
                for i, x in zip(at, h):
                    hashes.setdefault(int(x), []).append((n, int(i)))
            # windows have one hash where they are one by brute force, and as many different ones
            assert sum(map(len, hashes.values())) == len(plain_windows(words)) and len(hashes) == len(set(plain_windows(words)))


def test_names_that_begin_sentences_and_many_numbers(spark):
    items = [(1, "Tom has 12 apples. Tom gives 5 to Bob. Tom buys 3 more apples and shares them with Eve."), (2, "Add 5 and 7 and 9 then 12 and 15 and 18 then divide the sum by 3 and 4 and 6 to get the answer")]
    docs = [
        (1, "Anna has 7 apples. Anna gives 3 to Max. Anna buys 9 more apples and shares them with Joe."), (2, "Yesterday Tom has 12 apples. Tom gives 5 to Bob. Tom buys 3 more apples and shares them with Eve."),
        (3, "Add 1 and 2 and 3 then 4 and 6 and 8 then divide the sum by 10 and 20 and 30 to get the answer"), (4, "Tom has a dog. Anna likes apples. Bob gives them to Eve. Joe buys more and shares them with Max."),
    ]
    assert set(found(spark, docs, items)) == {(1, 1), (2, 1), (3, 2)}


def test_matches_from_far_apart_are_no_leak(spark):
    words = OTHER.split()
    pieces = [" ".join(words[i : i + 8]) for i in (0, 4, 8)]
    scattered = (" " + NOISE * 3).join([pieces[0], pieces[2], " ".join(words[11:19]), pieces[1]])
    assert not found(spark, [(1, scattered)], [(2, OTHER)])
    inserted = " ".join([*words[:9], "very", *words[9:]])
    assert set(found(spark, [(1, NOISE + inserted)], [(2, OTHER)])) == {(1, 2)}


def test_short_items_and_empty_tables(spark):
    items = [(1, "One two three four five."), (2, "too short"), (3, None), (4, "What is photosynthesis anyway?"), (5, "Why did Rome fall")]
    docs = [(1, "one two three four five"), (2, NOISE), (3, "what is photosynthesis anyway?"), (4, "Why did Rome fall"), (5, NOISE + ". Why did Rome fall? " + NOISE), (6, "this is too short to say"), (7, "Too short!")]
    assert set(found(spark, docs, items)) == {(1, 1), (3, 4), (4, 5), (5, 5), (7, 2)}
    nameless = spark.createDataFrame([(None, ITEM, 3), (None, NOISE, 4), (1, NOISE, 5)], "doc_id long, text string, t_at int")
    kept = op.drop_contaminated(nameless, spark.createDataFrame([(1, ITEM)], "item_id long, text string"))
    assert sorted(r.t_at for r in kept.collect()) == [4, 5]
    assert found(spark, [], [(1, ITEM)]) == {}
    empty = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, ITEM, 3), (None, OTHER, 4)], "doc_id long, text string, t_at int")
    assert op.find_contamination(docs, empty).count() == 0
    assert op.drop_contaminated(docs, empty).columns == docs.columns


def test_join_without_broadcast_gives_the_same(spark, monkeypatch):
    docs = [(1, NOISE + ITEM), (2, NOISE)]
    want = found(spark, docs)
    monkeypatch.setattr(op, "MAX_BROADCAST", 0)
    assert found(spark, docs) == want


def test_scripts_without_spaces(spark):
    items = [(1, "中国的首都是哪里？"), (2, "水的沸点在标准大气压下是多少摄氏度请说明原因"), (3, "ประเทศไทยมีเมืองหลวงชื่อว่าอะไรและตั้งอยู่ที่ไหน")]
    docs = [
        (1, "前言。中国的首都是哪里？答案是北京。"), (2, "中国的首都是哪里的人都知道的地方。"), (3, "问：水的沸点在标准大气压下是多少摄氏度请说明原因。谢谢"), (4, "水的沸点在标准大气压下不同。"),
        (5, "ถาม ประเทศไทยมีเมืองหลวงชื่อว่าอะไรและตั้งอยู่ที่ไหน"), (6, "中国的首都是哪里？"), (7, "「中国的首都是哪里」と聞いた"), (8, "水的沸点"),
    ]
    assert set(found(spark, docs, items)) == {(1, 1), (3, 2), (5, 3), (6, 1), (7, 1)}


def test_a_short_row_of_characters_of_a_long_item_is_no_leak(spark):
    item = "".join(chr(0x4E00 + 7 * i) for i in range(120))
    rest = "".join(chr(0x7000 + 5 * i) for i in range(90))
    docs = [(1, rest + item[20:38] + rest), (2, rest + item[20:50] + rest), (3, item)]
    assert set(found(spark, docs, [(1, item)])) == {(2, 1), (3, 1)}  # 18 characters say as much as nine words


def test_signs_between_numbers_are_words(spark):
    item = "Compute 12 + 34 * 56 - 78 / 9 = what number"
    docs = [
        (1, "Now Compute 21 + 43 * 65 - 87 / 3 = what number please"), (2, "Compute 12+34*56-78/9 = what number"), (3, "Compute 12 * 34 + 56 / 78 - 9 = what number"),
        (4, "* Compute\n- 5 apples + pears = fruit / food"), (5, "Compute 12 34 56 78 9 what number"),
    ]
    got = found(spark, docs, [(1, item)])
    assert set(got) == {(1, 1), (2, 1)} and got[2, 1].verbatim and not got[1, 1].verbatim

    def signs(text):
        data = np.frombuffer(text.encode(), np.uint8)
        t = op.tokens(data, np.array([0, len(data)]))
        return "".join(text.encode()[a:b].decode() for a, b in zip(t.starts, t.ends) if not text.encode()[a:b].isalnum())

    assert [signs(t) for t in ("a - b", "* item", "3-year", "7-2", "x = 5", "x =\ty", "(2) ^ (3)", "and/or", "- 5", "\n+ 5", "5 <", "->")] == ["", "", "", "-", "=", "", "^", "", "", "", "<", ""]


def plain_words(text, reading):
    """Template words by a loop: (kind or word, value, begins a sentence, number of its first word, read as a name though it begins a sentence)."""
    out, end, number = [], 0, False
    for place, m in enumerate(re.finditer(r"[0-9]+|[^\W\d_]+", text)):
        word, first = m[0], not place or bool(re.search(r"[.!?:;\n\r\"*#|-]", text[end : m.start()]))
        named = reading is True or (reading == "head" and not place)
        if word[0].isdigit():
            kind = "<number>"
        elif number and word.lower() in op.UNITS:
            kind = "<unit>"
        elif word[0].isupper() and (named or not first) and not word[1:2].isupper():
            kind = "<name>"
        else:
            kind = word.lower()
        if out and kind[0] == "<" and out[-1][0] == kind and not first:
            out[-1] = (kind, out[-1][1] + text[end : m.end()].lower(), *out[-1][2:])
        else:
            out.append((kind, word.lower(), first, place, kind == "<name>" and first))
        end, number = m.end(), kind == "<number>"
    return out


def brute_windows(text, readings, item):
    """``(place, key, slots, n_windows)`` of the windows of a text."""
    out = []
    for reading in readings:
        words = plain_words(text, reading)
        for i in range(len(words)):
            for n in range(1, 17):
                part = words[i : i + n]
                plain = [w[0][0] != "<" for w in part]
                if len(part) < n or (reading and not any(w[4] for w in part)):
                    continue
                whole = part[0][2] and (i + n == len(words) or words[i + n][2])
                if n > 8:
                    keep, own = sum(plain) == 5 and plain[-1], False
                else:
                    keep, own = (whole if n < 5 else True), (n < 5 or sum(plain) < min(5, n))
                    if item:
                        keep = keep and (n == 8 if len(words) >= 8 else n == len(words))
                if keep:
                    key = (n, own, tuple(w[1] if own else w[0] for w in part))
                    out.append((part[0][3], key, [] if own else [w[1] for w in part if w[0][0] == "<"], max(1, len(words) - 7)))
    return out


def brute_matches(docs, items):
    want = {}
    for d, doc in docs:
        places = {}
        for place, key, slots, _ in brute_windows(doc, (False, True), False):
            places.setdefault(key, []).append((place, slots))
        for i, item in items:
            met = [(ipos, dpos - ipos, a, b, n) for ipos, key, a, n in brute_windows(item, (False, True, "head"), True) for dpos, b in places.get(key, ())]
            torn = {x[1] for x in met for y in met if x[1] == y[1] for p, q in zip(x[2], x[3]) for r, s in zip(y[2], y[3]) if p == r and q != s}
            bands = {}
            for ipos, at, a, b, n in met:
                if at not in torn:
                    for band in (at // 16 * 2, (at + 8) // 16 * 2 + 1):
                        bands.setdefault(band, {}).setdefault(ipos, []).append((n, a == b))
            best = max(((len(x), all(any(s for _, s in v) for v in x.values()), min(n for v in x.values() for n, _ in v)) for x in bands.values()), default=None)
            if best and (min(1.0, best[0] / best[2]) >= 0.5 or best[0] >= 6):
                want[d, i] = (best[0], best[2], min(1.0, best[0] / best[2]), best[1])
    return want


def test_matches_against_brute_force(spark):
    rng = random.Random(11)
    pool = "the of runs Tom Anna Maria 7 12 km hours apples. Each has gives. red with 3, Bob Smith then add 900 kg to? A when from here they take old new".split()
    items = [(i, " ".join(rng.choices(pool, k=rng.choice((2, 4, 6, 9, 14, 25))))) for i in range(12)]
    docs = []
    for d in range(150):
        words = rng.choices(pool, k=rng.randint(0, 30))
        for _ in range(rng.randint(0, 2)):
            item = rng.choice(items)[1].split()
            item = [rng.choice(("Joe", "Eve", "41", w)) if w[0].isupper() or w[0].isdigit() else w for w in item] if rng.random() < 0.5 else item
            a = rng.randint(0, len(item) // 3)
            words = words + (["end."] if rng.random() < 0.5 else []) + item[a:] + rng.choices(pool, k=rng.randint(0, 10))
        docs.append((d, " ".join(words)))
    want = brute_matches(docs, items)
    got = {k: (r.n_matched, r.n_windows, r.coverage, r.verbatim) for k, r in found(spark, docs, items).items()}
    assert len(want) > 20 and got == want


def test_columns_of_clashing_names(spark):
    names = ["gone", "row", "id", "text_", "hash", "doc_id_", "item_id", "ipos", "coverage", "__gone", "__id", "weight"]
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names)
    rows = [(1, ITEM, *range(12)), (2, NOISE, *range(12)), (None, NOISE, *range(12)), (None, ITEM, *range(12))]
    kept = op.drop_contaminated(spark.createDataFrame(rows, schema), spark.createDataFrame([(1, ITEM)], "item_id long, text string"))
    assert kept.columns == ["doc_id", "text", *names] and sorted(map(tuple, kept.collect()), key=str) == sorted(rows[1:3], key=str)
