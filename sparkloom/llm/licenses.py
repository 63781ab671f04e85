"""License notices in texts: winnowed fingerprints, then banded alignment.

Templates are cut into overlapping runs of GRAM words; of each WINDOW
neighbouring runs the one with the smallest hash is kept (winnowing), so any
WINDOW + GRAM - 1 words in a row that a text shares with a template hold a kept
run. The kept runs are an inverted index from run to (template, place). All runs
of a text are looked up, the hits give diagonals, and along each diagonal the
template is aligned with the text in a band: matched words give coverage and
span. Words are runs of letters and digits, in lower case (ASCII).

Edited notices may share no run. So each template has anchors in the index too, single words of which
every match holds one: a word that it may not miss, or, without such words, its longest ones, one more than a match may
miss. An anchor's diagonal is aligned in twice the band, which holds the bands of all
diagonals that could meet the anchor, if the words around it can reach the coverage at all. No match of any diagonal is missed.

Words that tell licenses apart (families, clauses such as NonCommercial, version
numbers) must agree: an alignment leaves none of the template out and passes over
none in the text, so one license is never named for another. Of matches that
overlap, of one or several templates, the one of most words is reported.

The templates are a parameter. They go to the executors in blocks of BLOCK_WORDS
words; with more than one block the texts pass from block to block, each adding
its matches, and the choice among overlapping ones follows the last.

Defined results: null and empty texts match nothing; very long texts are scanned
whole; a template shorter than a run is one run, one without words matches
nothing; of equal matches (ties) the most covered, then the leftmost, then the first name counts; repeated
rows are reported each time; an empty table gives an empty result; columns other
than doc_id and text are not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import texts

GRAM = 3
WINDOW = 2
BAND = 6
COVERAGE = 0.75
#: Words of templates that the executors hold at once.
BLOCK_WORDS = 200_000
#: Public license notices and the bodies of short licenses.
NOTICES = {
    "Apache-1.1": "Licensed under the Apache License, Version 1.1",
    "Apache-1.1-name": "Apache License, Version 1.1",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-name": "Apache License, Version 2.0",
    "Apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD-redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    ),
    "BSD-disclaimer": (
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
        "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
        "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
        "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies."
    ),
    "MIT": "Released under the MIT License",
    "MIT-body": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, '
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN "
        "THE SOFTWARE."
    ),
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in "
        "the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software"
    ),
    "MIT-title": "MIT License",
    "Apache-2.0-title": "Apache License 2.0",
    "BSD-2-Clause-title": "BSD 2-Clause License",
    "BSD-3-Clause-title": "BSD 3-Clause License",
    "MPL-2.0-title": "Mozilla Public License 2.0",
    "MPL-2.0-name": "Mozilla Public License, Version 2.0",
    "ISC-title": "ISC License",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from "
        "the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
        "redistribute it freely, subject to the following restrictions"
    ),
    "all-rights-reserved": "All rights reserved",
}
#: The clauses of Creative Commons licenses, their versions, those of the GNU licenses, and how they are written out.
CC_CLAUSES = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
CC_VERSIONS = ("2.0", "3.0", "4.0")
GNU = {"GPL": "GNU General Public License", "LGPL": "GNU Lesser General Public License", "AGPL": "GNU Affero General Public License"}
GNU_VERSIONS = {"GPL": ("2", "3"), "LGPL": ("2.1", "3"), "AGPL": ("3",)}
#: Identifiers of the SPDX list.
SPDX = (
    "0BSD AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC0-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 EPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later "
    "ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-2.0 Unlicense Zlib"
).split()
#: Words that tell licenses apart, and words after which a number is a version.
TELLING = frozenset(
    "apache mit bsd isc mozilla mpl gnu gpl lgpl agpl affero lesser cc cc0 nc sa nd noncommercial sharealike noderivatives noderivs unlicense zlib 0bsd bsl epl gplv2 gplv3 lgplv3 agplv3 v2 v3".encode().split()
)
VERSIONED = frozenset("version v license licence public apache bsd mit bsl epl gpl lgpl agpl mpl cc cc0 by nc sa nd attribution noncommercial sharealike noderivatives noderivs".encode().split())


def _all_templates() -> dict[str, str]:
    out = dict(NOTICES)
    for name in SPDX:
        out[f"{name}-spdx"] = f"SPDX-License-Identifier: {name}"
    for version in CC_VERSIONS:
        for code, name in CC_CLAUSES.items():
            out[f"CC-{code}-{version}"] = f"CC {code} {version}"
            out[f"CC-{code}-{version}-name"] = f"Creative Commons {name} {version}"
            out[f"CC-{code}-{version}-title"] = f"{name} {version}"
    for code, name in GNU.items():
        for version in GNU_VERSIONS[code]:
            full = version if "." in version else f"{version}.0"
            out[f"{code}-{full}"] = f"This work is licensed under the {name}, version {version}"
            out[f"{code}-{full}-short"] = f"GNU {code}, version {version}"
            out[f"{code}-{full}-name"] = f"{name}, version {version}"
            out[f"{code}-{full}-title"] = f"{name} v{full}"
            out[f"{code}-{full}-letters"] = f"{code}v{version}"
            out[f"{code}-{full}-notice"] = (
                f"This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by "
                f"the Free Software Foundation, either version {version} of the License, or (at your option) any later version"
            )
    return out


TEMPLATES = _all_templates()
_WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")
#: Everything but letters, digits and bytes of other scripts becomes a space.
_SPACE = bytes(b if chr(b).isalnum() and b < 128 or b >= 128 else 32 for b in range(256)).lower()
_TABLE = 1 << 20


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_SPACE).split()


def telling(found: list[bytes]) -> list[bool]:
    """Whether each word tells licenses apart: a family, a clause, or a number of a version."""
    out: list[bool] = []
    for k, word in enumerate(found):
        number = word.isdigit() and k > 0 and (found[k - 1] in VERSIONED or found[k - 1].isdigit() and out[k - 1])
        out.append(word in TELLING or number)
    return out


def winnow(hashes: list[int], window: int = WINDOW) -> list[int]:
    """Places of the smallest hash (the last of equals) of each window."""
    kept: list[int] = []
    for at in range(max(1, len(hashes) - window + 1)):
        part = range(at, min(at + window, len(hashes)))
        best = min(part, key=lambda i: (hashes[i], -i))
        if not kept or kept[-1] != best:
            kept.append(best)
    return kept


def align(template: list[bytes], text: list[bytes], shift: int, must: list[bool], stops: list[bool], band: int = BAND) -> tuple[int, int, int]:
    """(matched words, first place, last place) of the best alignment of a template with text words, all in a band about a diagonal.

    Longest common subsequence in the band: word i of the template may only meet
    words shift + i - band to shift + i + band of the text. Words that `must` marks
    can't be left out of the template, words that `stops` marks can't be passed over
    inside the span. Of equal counts the shorter span counts, then the one that
    begins nearer to the diagonal.
    """
    width = 2 * band + 1
    last_must = max((i for i, m in enumerate(must) if m), default=-1)
    #: A state is (matched, -span, -distance from the diagonal, first, last); None: none is allowed.
    empty = (0, 0, 0, -1, -1)
    before: list[tuple[int, int, int, int, int] | None] = [empty] * (width + 1)
    best = empty
    for i, word in enumerate(template):
        row: list[tuple[int, int, int, int, int] | None] = []
        for d in range(width):
            j = shift + i + d - band
            state = None if must[i] else before[d + 1]  # the template's word left out
            if d and 0 <= j < len(text) and row[-1] is not None and (state is None or row[-1] > state) and not (stops[j] and row[-1][0]):
                state = row[-1]  # the text's word passed over
            above = before[d]
            if above is not None and 0 <= j < len(text) and text[j] == word:
                first, distance = (above[3], above[2]) if above[0] else (j, -abs(d - band))
                made = (above[0] + 1, first - j, distance, first, j)
                if state is None or made > state:
                    state = made
                if i >= last_must and made > best:
                    best = made
            row.append(state)
        before = [*row, None if must[i] else before[width]]
    return best[0], best[3], best[4]


def chosen(matches: list[tuple]) -> list[tuple]:
    """Of (name, coverage, matched, first, last) those that stay where some overlap: most words first, then the most covered, shortest, leftmost, first name."""
    out: list[tuple] = []
    begins: list[int] = []
    for m in sorted(set(matches), key=lambda m: (-m[2], -m[1], m[4] - m[3], m[3], m[0])):
        k = bisect(begins, m[4])  # those that stay don't overlap: only the last one that begins before m ends can
        if not k or out[k - 1][4] < m[3]:
            out.insert(k, m)
            begins.insert(k, m[3])
    return out


class TemplateIndex:
    """The inverted index of winnowed runs."""

    def __init__(self, templates: dict[str, str], gram: int = GRAM, coverage: float = COVERAGE):
        self.gram, self.coverage = gram, coverage
        self.names = sorted(templates)
        self.templates = [words(templates[n]) for n in self.names]
        self.must = [telling(t) for t in self.templates]
        self.ids = {w: n + 1 for n, w in enumerate(sorted({w for t in self.templates for w in t}))}
        self.runs: dict[tuple[bytes, ...], list[tuple[int, int]]] = {}
        self.table = np.zeros(_TABLE, np.bool_)
        for n, t in enumerate(self.templates):
            runs = [tuple(t[i : i + gram]) for i in range(max(1, len(t) - gram + 1))]
            for i in winnow([crc32(b" ".join(r)) for r in runs]) if t else []:
                self.runs.setdefault(runs[i], []).append((n, i))
                if len(runs[i]) == gram:
                    self.table[int(self._codes(np.array([self.ids[w] for w in runs[i]], np.int64))[0])] = True
        self.short = {k: v for k, v in self.runs.items() if len(k) < gram}
        #: Words of each template with how often they occur, those that it may not miss, and (template, place) by anchor.
        self.often = [Counter(t) for t in self.templates]
        self.needed = [frozenset(w for w, m in zip(t, must) if m) for t, must in zip(self.templates, self.must)]
        self.anchors: dict[bytes, list[tuple[int, int]]] = {}
        for n, t in enumerate(self.templates):
            places = [i for i, m in enumerate(self.must[n]) if m and not t[i].isdigit()] or [i for i, m in enumerate(self.must[n]) if m]
            if places:
                places = [max(places, key=lambda i: len(t[i]))]
            else:
                places = sorted(range(len(t)), key=lambda i: -len(t[i]))[: len(t) - self.least(n) + 1]
            for i in places:
                self.anchors.setdefault(t[i], []).append((n, i))
        self.anchored = np.zeros(len(self.ids) + 1, np.bool_)
        self.anchored[[self.ids[w] for w in self.anchors]] = True

    def least(self, n: int) -> int:
        """Words of template n that a match holds at least."""
        return max(1, math.ceil(self.coverage * len(self.templates[n]) - 1e-9))

    def _codes(self, ids: np.ndarray) -> np.ndarray:
        """A table slot for each run of known words."""
        n = len(ids) - self.gram + 1
        h = np.zeros(n, np.int64)
        for k in range(self.gram):
            h = h * 1_000_003 + ids[k : k + n]
        return (h ^ h >> 21) & (_TABLE - 1)

    def numbers(self, found: list[bytes]) -> np.ndarray:
        """The number of each word that a template has, 0 of others."""
        get = self.ids.get
        return np.fromiter((get(w, 0) for w in found), np.int64, len(found))

    def hits(self, found: list[bytes], ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(template, its place, the text's place) of each run that the index holds."""
        if len(found) >= self.gram and ids.any():
            known = ids > 0
            full = known[: len(ids) - self.gram + 1].copy()
            for k in range(1, self.gram):
                full &= known[k : len(ids) - self.gram + 1 + k]
            if full.any():
                at = np.flatnonzero(full)
                at = at[self.table[self._codes(ids)[at]]]
                for p in at.tolist():
                    for n, i in self.runs.get(tuple(found[p : p + self.gram]), ()):
                        yield n, i, p
        for run, where in self.short.items():
            for p in np.flatnonzero(ids == self.ids[run[0]]).tolist():
                if tuple(found[p : p + len(run)]) == run:
                    for n, i in where:
                        yield n, i, p

    def reachable(self, n: int, found: list[bytes]) -> bool:
        """Whether these words hold all that template n needs, and enough of the rest."""
        around = set(found)
        if not self.needed[n] <= around:
            return False
        often, have = self.often[n], 0
        for w in around:
            have += often.get(w, 0)
        return have >= self.least(n)

    def matches(self, found: list[bytes]) -> list[tuple[str, float, int, int, int]]:
        """(template, coverage, matched words, first word, last word) of every match, overlapping ones too."""
        ids = self.numbers(found)
        bands = {(n, p - i): BAND for n, i, p in self.hits(found, ids)}
        for p in np.flatnonzero(self.anchored[ids]).tolist():
            for n, i in self.anchors[found[p]]:
                bands[n, p - i] = 2 * BAND
        stops, out = None, []
        for (n, shift), band in sorted(bands.items()):
            template = self.templates[n]
            size = len(template)
            if shift >= 0 and found[shift : shift + size] == template:
                out.append((self.names[n], 1.0, size, shift, shift + size - 1))
            else:
                spans = [(max(0, shift - band), min(len(found), shift + size + band))]
                while spans:  # what stands beside a match may hold another
                    low, high = spans.pop()
                    if high <= low or not self.reachable(n, found[low:high]):
                        continue
                    stops = stops or telling(found)
                    k, first, last = align(template, found[low:high], shift - low, self.must[n], stops[low:high], band)
                    if k >= self.least(n):
                        out.append((self.names[n], k / size, k, low + first, low + last))
                        spans += [(low, low + first), (low + last + 1, high)]
        return out


def placed(text: str, matches: list[tuple]) -> list[tuple[str, float, int, int, int]]:
    """(template, coverage, matched words, start, stop) of the matches that stay; places in code points."""
    if not matches:
        return []
    places = [m.span() for m in _WORD.finditer(text)]
    return [(name, cover, k, places[first][0], places[last][1]) for name, cover, k, first, last in chosen(matches)]


def blocks(templates: dict[str, str], size: int = BLOCK_WORDS) -> list[dict[str, str]]:
    """The templates in blocks of at most `size` words (one template at least)."""
    out: list[dict[str, str]] = [{}]
    held = 0
    for name in sorted(templates):
        n = len(words(templates[name]))
        if out[-1] and held + n > size:
            out.append({})
            held = 0
        out[-1][name] = templates[name]
        held += n
    return out


_FOUND = "array<struct<license:string,coverage:double,matched:long,start:long,stop:long>>"


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, size: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, license, coverage, matched, start, stop) of notices in texts."""
    parts = blocks(TEMPLATES if templates is None else templates, size)
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.array().cast(_FOUND).alias("found"))
    for part in parts[:-1]:
        rows = rows.mapInArrow(_adder(part, coverage, False), f"doc_id long, text string, found {_FOUND}")
    return rows.mapInArrow(_adder(parts[-1], coverage, True), f"doc_id long, found {_FOUND}").selectExpr("doc_id", "inline(found)")


def _adder(templates: dict[str, str], coverage: float, last: bool):
    names = ("license", "coverage", "matched", "start", "stop")
    kind = pa.list_(pa.struct(list(zip(names, (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Matches so far are words' places; the last block chooses among them and gives the texts' places."""
        index = TemplateIndex(templates, coverage=coverage)
        for batch in batches:
            ids, every = [], []
            for doc_id, text, found in zip(batch.column(0), texts(batch), batch.column(2)):
                matches = [tuple(m.values()) for m in found.as_py()] + index.matches(words(text))
                matches = placed(text, matches) if last else matches
                if matches or not last:
                    ids.append(doc_id.as_py())
                    every.append([dict(zip(names, m)) for m in matches])
            made = [pa.array(ids, pa.int64()), pa.array(every, kind)]
            yield pa.RecordBatch.from_arrays(made, ["doc_id", "found"]) if last else pa.RecordBatch.from_arrays([made[0], batch.column(1), made[1]], ["doc_id", "text", "found"])

    return run
