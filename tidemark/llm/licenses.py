"""Licence statements in documents by Dice's coefficient over word bigrams.

A document's units are its lines, the sentences of lines that hold several, its paragraphs,
the whole text, and windows of consecutive segments of its sequence of words. A segment ends
with a sentence or a line, and what is no word (line breaks, comment leaders) counts for
nothing, so that wrapped, embedded and commented notices are windows. Of the windows that reach
the threshold with a template, those with the highest coefficient that do not overlap are units.

With n bigrams, a unit can reach the threshold t only against templates of n * t / (2 - t) to
n * (2 - t) / t bigrams, and only if it holds t / (2 - t) of the template's: a document that
does not hold so many of any template's is done after one look at its bigrams.

A name is given only if the unit and the template also agree in the words that tell licences
apart: versions, the GNU family, the parts of Creative Commons, "or later", BSD clauses.
"""

from __future__ import annotations

import math
import pkgutil
import re
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tokens import slices

THRESHOLD = 0.8
#: Short statements and standard notices of public licences.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-3-Clause", "Released under the 3-Clause BSD License."),
    ("BSD-2-Clause", "Released under the 2-Clause BSD License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Apache-1.1", "Licensed under the Apache License, Version 1.1."),
    ("Apache-1.1", "Licensed under the Apache Software License, Version 1.1."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.0", "This work is licensed under the GNU Library General Public License, version 2."),
    ("MPL-2.0", "This work is licensed under the Mozilla Public License, version 2.0."),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
]
_OLD = "This {thing} is free software; you can redistribute it and/or modify it under the terms of the GNU {title} Public License as published by the Free Software Foundation; {version}."
_NEW = "This {thing} is free software: you can redistribute it and/or modify it under the terms of the GNU {title} Public License as published by the Free Software Foundation, {version}."
_REST = " This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {title} Public License for more details."
_COPY = " You should have received a copy of the GNU {title} Public License along with this {thing}; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"
_SEE = " You should have received a copy of the GNU {title} Public License along with this {thing}. If not, see <http://www.gnu.org/licenses/>."


def _gnu() -> Iterator[tuple[str, str]]:
    """The program notices of the GNU licences, whole and without their later parts."""
    for name, title, number, thing in (("GPL-1.0", "General", "1", "program"), ("GPL-2.0", "General", "2", "program"), ("LGPL-2.0", "Library General", "2", "library"), ("LGPL-2.1", "Lesser General", "2.1", "library"), ("GPL-3.0", "General", "3", "program"), ("LGPL-3.0", "Lesser General", "3", "program"), ("AGPL-3.0", "Affero General", "3", "program")):
        first = (_OLD if number < "3" else _NEW).format(thing=thing, title=title, version="{version}")
        rest = _REST.format(thing=thing, title=title)
        for suffix, version in (("-or-later", f"either version {number} of the License, or (at your option) any later version"), ("", f"version {number} of the License"), ("", f"version {number}")):
            said = first.format(version=version)
            yield from ((name + suffix, x) for x in (said, said + rest, said + rest + (_COPY if number < "3" else _SEE).format(thing=thing, title=title)))


def _creative_commons() -> Iterator[tuple[str, str]]:
    parts = {"": "Attribution", "-SA": "Attribution-ShareAlike", "-ND": "Attribution-NoDerivatives", "-NC": "Attribution-NonCommercial", "-NC-SA": "Attribution-NonCommercial-ShareAlike", "-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
    for version, port in (("3.0", "Unported"), ("4.0", "International")):
        for part, title in parts.items():
            name, code = f"CC-BY{part}-{version}", f"CC BY{part} {version}"
            titles = [title, title.replace("NoDerivatives", "NoDerivs")] if "ND" in part else [title]
            yield name, f"Licensed under {code}."
            yield name, f"This work is licensed under {code}."
            for t in titles:
                yield name, f"This work is licensed under a Creative Commons {t} {version} {port} License."
                yield name, f"This work is licensed under the Creative Commons {t} {version} {port} License. To view a copy of this license, visit http://creativecommons.org/licenses/{code[3:].lower()}/{version}/"


#: Identifiers whose SPDX lines are known; those of GNU licences also have -only and -or-later.
SPDX = "Apache-1.1 Apache-2.0 MIT MIT-0 ISC 0BSD BSD-2-Clause BSD-3-Clause BSD-4-Clause MPL-1.1 MPL-2.0 EPL-1.0 EPL-2.0 BSL-1.0 Zlib Unlicense CC0-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-ND-3.0 CC-BY-ND-4.0 CC-BY-NC-SA-3.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-3.0 CC-BY-NC-ND-4.0 OFL-1.1 NCSA".split()
SPDX_GNU = "GPL-1.0 GPL-2.0 GPL-3.0 LGPL-2.0 LGPL-2.1 LGPL-3.0 AGPL-3.0 GFDL-1.2 GFDL-1.3".split()
#: Licences whose whole texts are in license_texts.
FULL = "Apache-2.0 Artistic-1.0-Perl BSD-2-Clause CC-BY-SA-4.0 CC0-1.0 GFDL-1.2 GFDL-1.3 GPL-1.0 GPL-2.0 GPL-3.0 ISC LGPL-2.0 LGPL-2.1 LGPL-3.0 MIT MPL-1.1 MPL-2.0 NCSA OFL-1.1".split()


def _standard() -> Iterator[tuple[str, str]]:
    yield from _gnu()
    yield from _creative_commons()
    for name in SPDX + SPDX_GNU:
        yield name, f"SPDX-License-Identifier: {name}"
    for name in SPDX_GNU:
        yield name, f"SPDX-License-Identifier: {name}-only"
        yield f"{name}-or-later", f"SPDX-License-Identifier: {name}-or-later"
        yield f"{name}-or-later", f"SPDX-License-Identifier: {name}+ or later"
    texts = {name: (pkgutil.get_data(__package__, f"license_texts/{name}.txt") or b"").decode() for name in FULL}
    yield from texts.items()
    two = texts["BSD-2-Clause"][texts["BSD-2-Clause"].index("Redistribution and use") :]
    conditions, disclaimer = two.split("THIS SOFTWARE IS PROVIDED")
    for name, clauses in (
        ("BSD-2-Clause", ""),
        ("BSD-3-Clause", "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "),
        ("BSD-4-Clause", "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization. 4. Neither the name of the organization nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "),
    ):
        yield name, conditions + clauses
        yield name, f"{conditions}{clauses}THIS SOFTWARE IS PROVIDED{disclaimer}"
    for name, begin in (("MIT", "Permission is hereby granted"), ("ISC", "Permission to use")):
        yield name, texts[name][texts[name].index(begin) :]
    yield "Apache-2.0", texts["Apache-2.0"][: texts["Apache-2.0"].index("APPENDIX")]


TEMPLATES += _standard()

_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_PARAGRAPH = re.compile(r"\n\s*\n")
#: What stands between two words where a segment ends.
_BREAK = re.compile(r"[\n\r\x0b\f\u2028\u2029]|[.!?][\"')\]\u201d\u2019]*\s")


def bigrams(text: str) -> frozenset[tuple[str, str]]:
    w = _WORD.findall(text.lower())
    return frozenset(zip(w, w[1:], strict=False))


def dice(a: frozenset, b: frozenset) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


#: A template of more bigrams is a whole text, which names other licences too: its title must be in the unit.
LONG = 400
_NUMBER = re.compile(r"v?([0-9]+(?:\.[0-9]+)*)\Z")
_BEFORE = frozenset("version v gpl lgpl agpl mpl epl cc0 by sa nc nd apache attribution sharealike noncommercial noderivatives noderivs mit license licence licenses".split())
_PARTS = {"sa": "sa", "sharealike": "sa", "nc": "nc", "noncommercial": "nc", "nd": "nd", "noderivatives": "nd", "noderivs": "nd"}
_SAID = frozenset("endorse advertising".split())


def marks(w: list[str]) -> list[tuple[int, str, str]]:
    """What tells licences apart, by place: versions, GNU names, parts of Creative Commons and
    clauses that the words name."""
    out = []
    for k, x in enumerate(w):
        before = w[k - 1] if k else ""
        if x[0] in "v0123456789" and (m := _NUMBER.match(x)):
            if x[0] == "v" or before in _BEFORE and ("." in x or not before.startswith("licen")) or w[k + 1 : k + 2] in (["clause"], ["international"], ["unported"]):
                out.append((k, "version", m[1].removesuffix(".0")))
        elif x == "general" and before in ("gnu", "lesser", "library", "affero") and w[k + 1 : k + 2] == ["public"]:
            out.append((k, "gnu", before))
        elif x in _PARTS and ("by" in w[max(0, k - 3) : k] or "attribution" in w[max(0, k - 4) : k]):
            out.append((k, "part", _PARTS[x]))
        elif x == "later" and before in ("or", "any") or x in _SAID:
            out.append((k, "said", x))
    return out


def _title(w: list[str]) -> tuple[str, ...]:
    """The first words up to a version; none where it does not come soon."""
    return next((tuple(w[: k + 1]) for k, x in enumerate(w[:8]) if _NUMBER.match(x)), ())


class Words:
    """The words of a text and what an agreement with templates is judged by."""

    def __init__(self, words: list[str]):
        self.words = words
        self.marks = marks(words)
        self.titles: dict[tuple[str, ...], list[int]] = {}

    def named(self, begin: int, end: int) -> set[tuple[str, str]]:
        return {x[1:] for x in self.marks[bisect_left(self.marks, (begin,)) : bisect_left(self.marks, (end,))]}

    def places(self, title: tuple[str, ...]) -> list[int]:
        if title not in self.titles:
            n, w = len(title), self.words
            self.titles[title] = [k for k, x in enumerate(w) if x == title[0] and tuple(w[k : k + n]) == title]
        return self.titles[title]

    def agree(self, wanted: tuple, begin: int, end: int) -> bool:
        title, named = wanted
        if named is not None:
            return self.named(begin, end) == named
        at = bisect_left(self.places(title), begin) if title else 0
        return not title or at < len(self.places(title)) and self.places(title)[at] + len(title) <= end


class Templates:
    """Templates by their number of bigrams."""

    def __init__(self, templates: Iterable[tuple[str, str]], threshold: float = THRESHOLD):
        known = sorted(((len(b), name, b, text) for name, text in templates if (b := bigrams(text))), key=lambda x: x[:2])
        made = [x[:3] for x in known]
        self.marks = {}
        for n, name, b, text in known:
            w = _WORD.findall(text.lower())
            self.marks[name, b] = (_title(w), None) if n > LONG else ((), Words(w).named(0, len(w)))
        self.sizes, self.made, self.threshold = [n for n, _, _ in made], made, threshold
        t = threshold / (2 - threshold)
        self.least, self.most = (min(self.sizes) * t, max(self.sizes) / t) if made else (1, 0)
        self.ratio = t
        self.all = frozenset().union(*[b for _, _, b in made])

    def best(self, unit: str) -> tuple[str, float] | None:
        """The most similar template at or over the threshold that agrees in its marks; ties to
        the first name."""
        if len(unit) < self.least:
            return None
        part = 2000
        while part < len(unit):  # a longer unit has no fewer bigrams than its beginning, bar the word cut
            if len(bigrams(unit[:part])) > self.most + 1:
                return None
            part *= 8
        b = bigrams(unit)
        n = len(b)
        if not self.least <= n <= self.most or len(b & self.all) < n * self.ratio - 1e-9:
            return None
        low, high = bisect_left(self.sizes, n * self.ratio), bisect_right(self.sizes, n / self.ratio)
        near = [(-d, name, t) for _, name, t in self.made[low:high] if (d := dice(b, t)) >= self.threshold]
        for d, name, t in sorted(near, key=lambda x: x[:2]):
            if self.agree(unit, name, t):
                return name, -d
        return None

    def agree(self, unit: str, name: str, template: frozenset) -> bool:
        w = Words(_WORD.findall(unit.lower()))
        return w.agree(self.marks[name, template], 0, len(w.words))

    def possible(self, held: frozenset | set) -> list[tuple[str, frozenset]]:
        """Templates of whose bigrams a text with the bigrams ``held`` has enough for a match of
        any part of it."""
        found = held & self.all
        return [(name, b) for n, name, b in self.made if len(found) >= n * self.ratio - 1e-9 and len(b & found) >= n * self.ratio - 1e-9]


@lru_cache(maxsize=4)
def standard(threshold: float = THRESHOLD) -> Templates:
    return Templates(TEMPLATES, threshold)


def _structure(text: str) -> Iterator[tuple[int, int]]:
    """Lines, sentences in them, paragraphs, the whole text."""
    seen = set()

    def new(start: int, end: int) -> Iterator[tuple[int, int]]:
        while start < end and text[start].isspace():
            start += 1
        while end > start and text[end - 1].isspace():
            end -= 1
        if end > start and (start, end) not in seen:
            seen.add((start, end))
            yield start, end

    at = 0
    for line in text.split("\n"):
        yield from new(at, at + len(line))
        begin = 0
        for m in _SENTENCE.finditer(line):
            yield from new(at + begin, at + m.start())
            begin = m.end()
        if begin:
            yield from new(at + begin, at + len(line))
        at += len(line) + 1
    at = 0
    for m in _PARAGRAPH.finditer(text):
        yield from new(at, m.start())
        at = m.end()
    if at:
        yield from new(at, len(text))
    yield from new(0, len(text))


def _lower(text: str) -> str:
    """Lower case at the same places."""
    low = text.lower()
    return low if len(low) == len(text) else text.replace("\u0130", "I").lower()


def _windows(pairs: list[tuple[str, str]], cuts: list[int], template: frozenset, threshold: float, titles: tuple[list[int], int] | None, marks: list[tuple[int, tuple]], agree: Callable[[int, int], bool]) -> list[tuple[int, int]]:
    """Ranges of words from cut to cut that reach the threshold with one template and agree with
    it, by falling coefficient and without overlaps.

    A window begins and ends with a segment that has a bigram of the template, as one without
    would only lower its coefficient, and may be of any length. From a beginning only those ends
    count up to which a bigram, a mark or a title comes for the first time, as between them nothing
    changes; they are kept in the order of their first places while the beginning moves back, and
    come to an end where bigrams of others make a match impossible, so a beginning takes no more
    steps than a match has different bigrams. ``titles`` are the places and the length of the title
    of which a window holds one, where that is asked for; ``marks`` are what agreement is judged by.
    """
    n, last = len(template), len(pairs)
    need, spare = n * threshold / (2 - threshold) - 1e-9, n * (2 - 2 * threshold) / threshold + 1e-9
    hits, total = [0], 0
    for p in pairs:
        total += p in template
        hits.append(total)
    ending = [len(cuts)] * (len(cuts) + 1)  # the first cut from here on whose segment has a bigram of the template
    for j in range(len(cuts) - 1, 0, -1):
        ending[j] = j if hits[min(max(cuts[j] - 1, 0), last)] > hits[min(max(cuts[j - 1] - 2, 0), last)] else ending[j + 1]
    first: OrderedDict[tuple, int] = OrderedDict()
    mark: OrderedDict[tuple, int] = OrderedDict()
    found, at, mark_at = [], last, len(marks)
    for k in range(len(cuts) - 2, -1, -1):
        begin = cuts[k]
        while at > begin:
            at -= 1
            first.pop(pairs[at], None)
            first[pairs[at]] = at
        while mark_at and marks[mark_at - 1][0] >= begin:
            mark_at -= 1
            place, value = marks[mark_at]
            mark.pop(value, None)
            mark[value] = place
        if hits[min(cuts[k + 1], last)] == hits[min(begin, last)] or total - hits[min(begin, last)] < need:
            continue
        named = bisect_left(titles[0], begin) if titles else 0
        if titles and named == len(titles[0]):
            continue
        inside, others, limit = [], [], last
        for pair, place in reversed(first.items()):
            (inside if pair in template else others).append(place)
            if len(others) > spare:
                limit = place
                break
        if len(inside) < need:
            continue
        least = inside[max(0, math.ceil(need) - 1)] + 2
        ends = {p + 2 for p in inside if p + 2 >= least} | {p + 2 for p in others if p + 2 >= least} | {p + 1 for p in mark.values() if limit >= p}
        if titles:
            ends.add(titles[0][named] + titles[1])
        for j in {ending[bisect_left(cuts, max(e, least))] for e in ends if e <= cuts[-1]}:
            if j < len(cuts) and cuts[j] - 1 <= limit:
                common, odd = bisect_left(inside, cuts[j] - 1), bisect_left(others, cuts[j] - 1)
                d = 2 * common / (common + odd + n)
                if common >= need and d >= threshold:
                    found.append((-d, begin, cuts[j]))
    chosen: list[tuple[int, int]] = []
    for _, begin, end in sorted(found):
        at = bisect_left(chosen, (begin, end))
        if (at == 0 or chosen[at - 1][1] <= begin) and (at == len(chosen) or chosen[at][0] >= end) and agree(begin, end):
            chosen.insert(at, (begin, end))
    return chosen


def units(text: str, templates: Templates | None = None) -> Iterator[tuple[int, int]]:
    """Ranges of code points: lines, sentences in them, paragraphs, the whole text, then the best
    windows for ``templates`` with other words than these, by place."""
    made = standard() if templates is None else templates
    yield from _structure(text)
    low = _lower(text)
    spans = [m.span() for m in _WORD.finditer(low)]
    words = [low[s:e] for s, e in spans]
    pairs = list(zip(words, words[1:], strict=False))
    wanted = made.possible(set(pairs))
    if not wanted:
        return
    cuts = [0, *[k for k in range(1, len(words)) if _BREAK.search(text, spans[k - 1][1], spans[k][0])], len(words)]
    starts = [s for s, _ in spans]
    said = {(bisect_left(starts, s), bisect_left(starts, e)) for s, e in _structure(text)}
    known, found = Words(words), set()
    for name, b in wanted:
        title, named = kind = made.marks[name, b]
        titles = known.places(title) if title else None
        if titles != [] and (named is None or named <= known.named(0, len(words))):
            marks_ = [(m[0], m[1:]) for m in known.marks] if named is not None else []
            found.update(_windows(pairs, cuts, b, made.threshold, (titles, len(title)) if titles else None, marks_, lambda i, j, kind=kind: known.agree(kind, i, j)))
    for begin, end in sorted(found - said):
        yield starts[begin], spans[end - 1][1]


def scan(text: str | None, templates: Templates) -> list[dict]:
    """Units that match a template: start, end, license, dice, in the order of units."""
    text, out = text or "", []
    if len(low := text.lower()) == len(text):
        words = _WORD.findall(low)
        if not templates.possible(set(zip(words, words[1:], strict=False))):
            return out
    for start, end in units(text, templates):
        if found := templates.best(text[start:end]):
            out.append({"start": start, "end": end, "license": found[0], "dice": found[1]})
    return out


_MATCH = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("license", pa.string()), ("dice", pa.float64())])


def license_matches(documents: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and matches (start, end, license, dice) for every row of ``documents`` by its
    whole text; code points, end exclusive.

    A null or empty text has none. Each row stands for itself, and other columns are not read.
    Templates that are given travel with the task; the standard ones are part of the package.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = standard(threshold) if templates is None else Templates(templates, threshold)
        for batch in slices(batches):
            found = [scan(t.as_py(), made) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(_MATCH))], names=["doc_id", "matches"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, matches array<struct<start: long, end: long, license: string, dice: double>>")


def license_report(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license and dice of the best match (null without one; ties to the first unit),
    licenses (all names found, sorted, comma-joined), n_matches."""
    best = F.reduce("matches", F.lit(None).cast("struct<start: long, end: long, license: string, dice: double>"), lambda a, x: F.when(a.isNull() | (x["dice"] > a["dice"]), x).otherwise(a))
    return license_matches(documents, threshold=threshold).withColumn("best", best).select(
        "doc_id", "best.license", "best.dice", F.array_join(F.array_sort(F.array_distinct("matches.license")), ",").alias("licenses"), F.size("matches").cast("long").alias("n_matches")
    )
