import random
import time

from tarnflow.llm import licenses as op

MIT = op.TEMPLATES["MIT"][1]
SMALL = {"A": ["a b c d", "a b a b a"], "B": ["b c d e f", "c"], "C": ["d e d e"]}


def told_apart(own, held, name, templates):
    """Whether a stretch's bigrams tell the template from every other licence's that is much like it."""
    for other, texts in templates.items():
        for t in texts if other != name else []:
            its = list(zip(op.normalised(t), op.normalised(t)[1:]))
            alike = 2 * sum(min(own.count(g), its.count(g)) for g in set(own)) / max(len(own) + len(its), 1)
            marks = set(own) - set(its)
            if alike >= op.ALIKE and marks and not marks & held:
                return False
    return True


def brute(text, templates):
    """The notices by comparing every stretch of the text with every template."""
    words = op.normalised(text or "")
    grams, found = list(zip(words, words[1:])), []
    for name, texts in templates.items():
        for t in texts:
            own = list(zip(op.normalised(t), op.normalised(t)[1:]))
            for i in range(len(grams)):
                best = None
                for j in range(i + 1, len(grams) + 1):
                    part = grams[i:j]
                    d = 2 * sum(min(part.count(g), own.count(g)) for g in set(part)) / (len(part) + len(own))
                    if d >= op.LEAST and (best is None or d > best[0]):
                        best = d, j
                if best and told_apart(own, set(grams[i : best[1]]), name, templates):
                    found.append((-best[0], i - best[1], i, name, best[1]))
    kept = []
    for d, _, i, name, j in sorted(found):
        if all(j <= a or b <= i for a, b, _, _ in kept):
            kept.append((i, j, name, -d))
    return sorted(kept)


def test_notices_against_every_stretch():
    rng = random.Random(2)
    index = op.Index(SMALL)
    some = 0
    for _ in range(400):
        words = " ".join(rng.choices(["a b c d", "a b a b a", "b c d e f", "d e d e", "x", "c", "f a"], k=rng.randint(0, 4))).split()
        text = " ".join(w for w in words if rng.random() < 0.9)
        got = [tuple(n) for n in index.notices(text)]
        assert [g[:3] for g in got] == [w[:3] for w in brute(text, SMALL)], text
        some += bool(got)
    assert some > 50


def test_scan(spark):
    bsd2 = op.TEMPLATES["BSD-2-Clause"][1]
    cases = [
        (None, ""), ("", ""), ("MIT", ""), ("Released under the MIT License.", "MIT"), ("prose before\nReleased under the MIT license\nand after", "MIT"),
        ("x " * 50 + MIT + " y" * 50, "MIT"), (MIT.replace("Software", "Work", 2), "MIT"), ("Licensed under CC BY-NC 4.0. Licensed under CC BY 4.0.", "CC-BY-4.0,CC-BY-NC-4.0"),
        ("\n".join([MIT[:200], MIT[200:400], MIT[400:]]), "MIT"), ("Licensed under the Apache License, Version 2.0.\n" * 2, "Apache-2.0"),
        ("Licensed under the Apache License, Version 2.0. Released under the MIT License.", "Apache-2.0,MIT"),
        ("All of the work in the archive is released under the MIT License. It is part of the set of the tools.", "MIT"),
        ("Copyright (c) 2020\n" + bsd2, "BSD-2-Clause"), (op.TEMPLATES["BSD-3-Clause"][1], "BSD-3-Clause"), (op.TEMPLATES["AGPL-3.0"][2], "AGPL-3.0"), (op.TEMPLATES["LGPL-2.1"][1], "LGPL-2.1"),
        (op.TEMPLATES["Unlicense"][1] + " " + op.TEMPLATES["GPL-2.0"][0], "GPL-2.0,Unlicense"),
    ]
    rows = [(i, t, "clash") for i, (t, _) in enumerate(cases)] + [(3, cases[3][0], "again")]
    got = op.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, licenses string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.licenses == cases[r.doc_id][1], (r, cases[r.doc_id])
        assert (r.best_license is None) == (not r.licenses) and (r.n_notices > 0) == bool(r.licenses)


def names(text):
    return sorted({n.licence for n in op.Index(op.TEMPLATES).notices(text)})


def test_versions_and_families():
    cases = {
        "This work is licensed under the GNU General Public License, version 3.0.": ["GPL-3.0"], "Distributed under the terms of the GNU General Public License v3.0": ["GPL-3.0"],
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.": ["CC-BY-NC-SA-4.0"], "Licensed under CC BY 3.0.": ["CC-BY-3.0"],
        "This work is licensed under the GNU Lesser General Public License, version 2.": ["LGPL-2.0"], "Licensed under CC BY-NC-SA 4.0.": ["CC-BY-NC-SA-4.0"], "Licensed under CC BY-ND 4.0": ["CC-BY-ND-4.0"],
        "Licensed under the BSD 3-Clause License.": ["BSD-3-Clause"], "SPDX-License-Identifier: GPL-2.0-or-later": ["GPL-2.0"], "// SPDX-License-Identifier: Apache-2.0": ["Apache-2.0"], "Licensed under the Apache License, v2.0.": ["Apache-2.0"],
    }
    assert {t: names(t) for t in cases} == cases


def test_versions_that_are_not_known_are_nobodys():
    for text in ["Licensed under CC BY 9.0.", "Licensed under CC BY-XY 4.0.", "Licensed under the Apache License, Version 7.0.", "SPDX-License-Identifier: Nobody-1.0"]:
        assert names(text) == [], text
    for name in ("AGPL-3.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0"):
        short = op.TEMPLATES[name][0]
        assert names(short) == [name] and names(short[: short.rindex("version")] + "version 9") == [], name


def test_ties_go_to_the_first_name():
    index = op.Index({"Z": ["p q r"], "Y": ["p q r"]})
    assert [n.licence for n in index.notices("p q r")] == ["Y"]


def test_very_long_texts():
    began = time.time()
    index = op.Index(op.TEMPLATES)
    assert len(index.notices("\n".join(["word of the text"] * 50_000))) == 0
    assert [n.licence for n in index.notices("word " * 100_000 + MIT + " word" * 100_000)] == ["MIT"]
    assert time.time() - began < 20


def test_empty_table(spark):
    assert op.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0
