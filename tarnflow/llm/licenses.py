"""License scans: stretches of normalised text compared with licence templates by Dice over word bigrams.

A similarity of t needs sizes within a factor of (2 - t) / t of each other, and t / (2 - t) of a template's
bigrams. So a template is compared only where a text holds so many of its bigrams within its greatest size, and
there with every stretch of a size that can do: the one of the highest coefficient is the notice. Licences whose
templates are much alike (versions, families) are told apart: a stretch without any bigram by which its template differs
from another licence's is no notice of it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import ceil
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 0.8

_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
    "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED "
    "AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF "
    "THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_3 = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
)
_GNU = (
    "{0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version."
)
_GNU_REST = (
    " {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
    "See the GNU {1} for more details. You should have received a copy of the GNU {1} along with this program. If not, see <https://www.gnu.org/licenses/>."
)


def _gnu(program: str, name: str, version: str) -> list[str]:
    first = _GNU.format(program, name, version)
    short = [f"{how} the GNU {name}, version {version}" for how in ("licensed under", "distributed under the terms of", "released under")]
    return [*short, first, first + _GNU_REST.format(program, name)]


def _creative_commons() -> dict[str, list[str]]:
    """The licences of all combinations and versions, by their short and long names."""
    words = {"BY": "Attribution", "NC": "NonCommercial", "ND": "NoDerivatives", "SA": "ShareAlike"}
    out = {}
    for marks in ("BY", "BY-NC", "BY-NC-ND", "BY-NC-SA", "BY-ND", "BY-SA"):
        long = "-".join(words[m] for m in marks.split("-"))
        for version in ("2.0", "2.5", "3.0", "4.0"):
            kind = "International" if version == "4.0" else "Unported"
            out[f"CC-{marks}-{version}"] = [
                f"Licensed under CC {marks} {version}.", f"Licensed under a Creative Commons {long} {version} License.", f"This work is licensed under a Creative Commons {long} {version} {kind} License.",
            ]
    return out


def _identified(templates: dict[str, list[str]]) -> dict[str, list[str]]:
    """The templates, and for each licence the lines that name it by its SPDX identifier."""
    gnu = ("", "-only", "-or-later", "+")
    return {n: [*t, *[f"SPDX-License-Identifier: {n}{x}" for x in (gnu if "GPL" in n else ("",))]] for n, t in templates.items()}


#: Texts and usual notices of licences. Of licences of many pages, the notices alone.
TEMPLATES = _identified({
    "AGPL-3.0": _gnu("This program", "Affero General Public License", "3"),
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "BSD-2-Clause": [_BSD, f"{_BSD} {_WARRANTY}", "Licensed under the BSD 2-Clause License.", "Licensed under the 2-Clause BSD License."],
    "BSD-3-Clause": [_BSD + _BSD_3, f"{_BSD}{_BSD_3} {_WARRANTY}", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Licensed under the BSD 3-Clause License.", "Licensed under the 3-Clause BSD License."],
    **_creative_commons(),
    "CC0-1.0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work is released under CC0 1.0 Universal Public Domain Dedication.",
    ],
    "GPL-2.0": _gnu("This program", "General Public License", "2"),
    "GPL-3.0": _gnu("This program", "General Public License", "3"),
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE "
        "FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "LGPL-2.0": _gnu("This library", "Library General Public License", "2") + _gnu("This library", "Lesser General Public License", "2")[:3],
    "LGPL-2.1": _gnu("This library", "Lesser General Public License", "2.1"),
    "LGPL-3.0": _gnu("This library", "Lesser General Public License", "3"),
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means.",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ],
})

#: Two templates of different licences that are so alike are told apart by the bigrams that one has and the other has not.
ALIKE = 0.4

_VERSION = re.compile(r"\b(?:version|ver\.?|v\.?)\s*(?=\d)")
_ZERO = re.compile(r"(?<![\w.-])(\d+)\.0(?![\w-]|\.\w)")
_NUMBER = re.compile(r"\d+(?:\.\d+)?")
_WORD = re.compile(r"[^\W_]+(?:[.'-][^\W_]+)*")


class Notice(NamedTuple):
    """A stretch of bigrams of a text, the end exclusive, and the licence it is most like."""

    start: int
    end: int
    licence: str
    dice: float


def normalised(text: str) -> list[str]:
    """Words in lower case, without marks between them; versions are bare numbers (``version 3.0``, ``v3``: ``3``)."""
    return _WORD.findall(_ZERO.sub(r"\1", _VERSION.sub("", text.lower())))


class Index:
    """Which templates have a bigram, how often, and what sizes of stretches can reach ``least`` with each."""

    def __init__(self, templates: dict[str, list[str]], least: float = LEAST):
        self.least = least
        self.size: list[int] = []
        self.licence: list[str] = []
        self.of: dict[tuple[str, str], list[tuple[int, int]]] = {}
        for name, texts in sorted(templates.items()):
            for text in texts:
                words = normalised(text)
                for g, n in Counter(zip(words, words[1:], strict=False)).items():
                    self.of.setdefault(g, []).append((len(self.size), n))
                self.size.append(max(0, len(words) - 1))
                self.licence.append(name)
        self.marks = self._marks()

    def _marks(self) -> list[list[frozenset[tuple[str, str]]]]:
        """For each template the sets of bigrams of which a stretch must hold one each: what it has and a template like it, of another
        licence, has not; and, where it names one number (its version), the words beside that."""
        shared: dict[tuple[int, int], int] = {}
        grams: list[dict[tuple[str, str], int]] = [{} for _ in self.size]
        for g, entries in self.of.items():
            for t, n in entries:
                grams[t][g] = n
                for u, m in entries:
                    if self.licence[t] != self.licence[u]:
                        shared[t, u] = shared.get((t, u), 0) + min(n, m)
        marks: list[set[frozenset[tuple[str, str]]]] = [set() for _ in self.size]
        for (t, u), n in shared.items():
            if 2 * n >= ALIKE * (self.size[t] + self.size[u]):
                marks[t].add(frozenset(g for g in grams[t] if g not in grams[u]))
        for t, own in enumerate(grams):
            numbers = [g for g in own if _NUMBER.fullmatch(g[0]) or _NUMBER.fullmatch(g[1])]
            if 0 < len(numbers) <= 2:
                marks[t].add(frozenset(numbers))
        return [sorted((m for m in found if m), key=sorted) for found in marks]

    def notices(self, text: str) -> list[Notice]:
        """The notices of a text by place: of stretches that overlap, that of the highest coefficient stands (ties: the longest, then the first by place and name)."""
        words = normalised(text)
        hits: dict[int, list[tuple[int, tuple[str, str], int]]] = {}
        for i, g in enumerate(zip(words, words[1:], strict=False)):
            if g in self.of:
                for t, n in self.of[g]:
                    hits.setdefault(t, []).append((i, g, n))
        found: list[Notice] = []
        for t, places in hits.items():
            if len(places) >= self._needed(t):
                found += self._stretches(t, places)
        kept: list[Notice] = []
        taken = bytearray(len(words))
        for x in sorted(found, key=lambda x: (-x.dice, x.start - x.end, x.start, x.licence)):
            if not any(taken[x.start : x.end]):
                taken[x.start : x.end] = b"\1" * (x.end - x.start)
                kept.append(x)
        return sorted(kept)

    def _needed(self, t: int) -> int:
        """How many of its bigrams a stretch must share with a template."""
        return max(1, ceil(self.size[t] * self.least / (2 - self.least) - 1e-9))

    def _stretches(self, t: int, places: list[tuple[int, tuple[str, str], int]]) -> Iterator[Notice]:
        """For each place of a template's bigrams the best stretch that begins there, if it reaches ``least``; a best one begins and ends with such bigrams."""
        n, needed = self.size[t], self._needed(t)
        widest = int(n * (2 - self.least) / self.least + 1e-9)
        for k in range(len(places) - needed + 1):
            start = places[k][0]
            if places[k + needed - 1][0] - start >= widest:
                continue
            seen: dict[tuple[str, str], int] = {}
            shared, best, end = 0, 0.0, start
            for i, g, most in places[k : k + widest]:
                if i - start >= widest:
                    break
                c = seen[g] = seen.get(g, 0) + 1
                if c <= most:
                    shared += 1
                    if (d := 2 * shared / (n + i - start + 1)) > best:
                        best, end = d, i + 1
            if best >= self.least and self._told_apart(t, places, k, end):
                yield Notice(start, end, self.licence[t], best)


    def _told_apart(self, t: int, places: list[tuple[int, tuple[str, str], int]], k: int, end: int) -> bool:
        """Whether the stretch that begins at a place holds a bigram of each set that tells its template from another licence's."""
        if not self.marks[t]:
            return True
        held = set()
        for i, g, _ in places[k:]:
            if i >= end:
                break
            held.add(g)
        return all(not held.isdisjoint(m) for m in self.marks[t])


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] | None = None, least: float = LEAST
) -> DataFrame:
    """``doc_id, licenses, best_license, best_dice, n_notices`` for every row of ``docs``.

    ``licenses`` are the names of all notices of the whole text (stretches that reach ``least``, each held by the
    template it is most like), sorted and comma-joined (empty if none); the best one is that of the highest
    coefficient, of equal ones the first by name (null if none). Lines mean nothing. Null texts are empty. Repeated
    rows give a row each; an empty table gives none; other columns are not read. Nothing is shuffled.
    """
    index = docs.sparkSession.sparkContext.broadcast(Index(TEMPLATES if templates is None else templates, least))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [index.value.notices(x.as_py() or "") for x in batch.column(1)]
            best = [min(f, key=lambda x: (-x.dice, x.licence)) if f else None for f in found]
            columns = [
                pa.array([",".join(sorted({x.licence for x in f})) for f in found], pa.string()), pa.array([b and b.licence for b in best], pa.string()),
                pa.array([b and b.dice for b in best], pa.float64()), pa.array([len(f) for f in found], pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "licenses", "best_license", "best_dice", "n_notices"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        scan, "doc_id long, licenses string, best_license string, best_dice double, n_notices int"
    )
