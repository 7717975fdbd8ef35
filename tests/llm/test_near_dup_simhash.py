"""SimHash against brute force: fingerprints, all pairs, components; crowded variants; odd inputs."""

import random

import xxhash

from tarnflow.llm import near_dup_simhash as op

DOCS = "doc_id long, text string"


def brute_fingerprint(text):
    out = ""
    for c in text or "":
        out += c.lower() if "A" <= c <= "Z" else c
    words, word = [], ""
    for c in out + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints):
    ids = list(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def test_fingerprints_follow_the_definition():
    for text in (None, "", "  \t\n", "One", "one two", "A b C", "ÀÉ Straße ÉÉ x y", "a\x0bb\x0cc d", "a a a a a a", " ".join(map(str, range(500)))):
        assert op.fingerprint(None if text is None else text.encode()) == brute_fingerprint(text)


def test_pairs_are_those_of_brute_force(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(30)]
    prints = {x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for x in base for _ in range(8)}
    prints |= {base[0] ^ (1 << b) for b in range(64)}
    want = {tuple(sorted((signed(a), signed(b)))) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3}
    df = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    for crowded in (64, 3):  # 3: nearly all variants are crowded, so the finer ones find the pairs
        got = [tuple(r) for r in op.near_pairs(df, crowded=crowded).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_components_are_those_of_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for g in range(12):
        text = [rng.choice(words) for _ in range(150)]
        for _ in range(4):
            near = list(text)
            near[rng.randrange(150)] = rng.choice(words)
            rows.append((100 - len(rows), " ".join(near)))
    rows += [(500, None), (501, ""), (7000, rows[3][1]), (7000, rows[3][1])]
    got = op.simhash_components(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    want = brute_components({i: brute_fingerprint(t) for i, t in rows})
    assert {(r.doc_id, r.component_id) for r in got} == set(want.items())
    assert {r.fingerprint for r in got if r.doc_id in (500, 501)} == {"0" * 16}
    assert {r.component_id for r in got if r.doc_id in (500, 501)} == {500}


def test_one_document_of_a_group_stays_with_its_columns(spark):
    rows = [(2, "a b c d", "x"), (1, "a b c d", "y"), (3, "other words here now", None), (None, "a b c d", "z")]
    docs = spark.createDataFrame(rows, DOCS + ", fp string")
    kept = op.simhash_keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == [rows[1], rows[2]]  # a row without an id goes like any other


def test_one_row_of_a_group_stays_without_ids_and_with_repeated_ones(spark):
    long = "one two three four five six seven eight nine ten"
    rows = [(None, "same text of rows without ids", 1), (None, "same text of rows without ids", 2), (None, "another text " * 9, 3), (7, long, 4), (7, long, 5), (7, "quite different words under the id", 6),
            (3, "quite different words under the id", 7), (None, long, 8), (9, None, 9), (10, "", 10)]
    for order in (rows, rows[::-1]):
        kept = op.simhash_keep_first(spark.createDataFrame(order, "doc_id long, text string, n int").repartition(3)).collect()
        assert sorted((r.doc_id or -1, r.text or "") for r in kept) == sorted([(-1, "same text of rows without ids"), (-1, "another text " * 9), (7, long), (3, "quite different words under the id"), (9, "")])


def test_empty_table(spark):
    assert op.simhash_components(spark.createDataFrame([], DOCS)).count() == 0


def test_columns_of_clashing_names(spark):
    names = ["__text", "__id", "__hash", "row", "id", "words", "of_id", "of_text", "stays", "fp", "root", "component_id", "key"]
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names)
    same = "one two three four five six seven eight nine ten"
    rows = [(2, same, *range(13)), (1, same, *range(13)), (1, same, *range(13)), (3, "other words here now", *range(13)), (None, same, *range(13))]
    kept = op.simhash_keep_first(spark.createDataFrame(rows, schema))
    assert kept.columns == ["doc_id", "text", *names] and sorted(map(tuple, kept.collect())) == [rows[1], rows[3]]
