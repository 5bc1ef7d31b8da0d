"""Licence scans: Dice coefficient over word bigrams between normalised text and licence templates.

Normalised text is the sequence of its words (runs of letters and digits, lower case), so case, punctuation,
comment marks and line breaks don't count. A *window* of a text runs from the first to the last word of
template bigrams found near each other. With ``a`` bigrams in the window, ``b`` in the template and ``c`` in
common (as multisets) its score is ``2c / (a + b)``; a score of ``t`` needs ``c >= t b / (2 - t)`` and
``a <= b (2 - t) / t``. So, by an index from bigrams to templates, only templates with enough common bigrams in
the whole text go on, and of those only beginnings with enough of them within the longest window. A beginning that
one more common bigram right before it would improve is left out, too: that bigram is the better beginning.

For each template and beginning the best end counts (the nearest, on ties). Of a template of more than ``2 * FINE``
bigrams every ``b / FINE``-th beginning is tried first, which costs at most ``1 / FINE`` of the score; then all
beginnings around each best one, and if none of those reaches the threshold, all of that part. Of all these windows the best that do
not overlap are reported. All steps are array operations over the hits of a text, so the work grows with the number
of hits times the length of a window.

Templates: notices and headers in common use, SPDX lines, whole texts of the short licences, the whole texts in
``licence_texts`` with their openings, and the Affero text, which follows from the GPL's by rule.

Defined results: a null or empty text has no licence; rows that repeat give equal rows; ties go to the longer
template, then to the smaller name; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import functools
import importlib.resources
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORDS = re.compile(r"[^\W_]+")

#: Public licence names and the notices under which they are commonly stated.
NAMES = {
    "MIT": ["MIT License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GPL v2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GPL v3"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License"],
    "ISC": ["ISC License"],
    "Unlicense": ["Unlicense"],
    "CC0-1.0": ["CC0 1.0 Universal"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
}
NOTICES = ["Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "Distributed under the {}.", "This work is licensed under the {}.", "This program is licensed under the terms of the {}."]
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
        to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
        whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
        notice shall be included in all copies or substantial portions of the Software.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "GPL-2.0": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions
        and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions
        and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of
        the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
        without specific prior written permission.""",
}


_MIT_WARRANTY = """
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE
        FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
        WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_WARRANTY = """ THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
        IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
        CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
        NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_WARRANTY = """ THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
        INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
        EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
        CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS;
        OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
        NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: %sRedistributions of source code must retain the above copyright notice, this list of conditions
        and the following disclaimer. %sRedistributions in binary form must reproduce the above copyright notice, this list of conditions
        and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = """ %sNeither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
        from this software without specific prior written permission."""
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU %s as published by the Free
        Software Foundation, either version %s of the License, or (at your option) any later version."""
_GNU_ONLY = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU %s version %s as published
        by the Free Software Foundation."""
_GNU_REST = """ This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU %s for more details. You should have received a copy of the GNU %s
        along with this program. If not, see <https://www.gnu.org/licenses/>."""
_GNU_NAMES = {
    "GPL-2.0": ("General Public License", "2"),
    "GPL-3.0": ("General Public License", "3"),
    "LGPL-2.1": ("Lesser General Public License", "2.1"),
    "LGPL-3.0": ("Lesser General Public License", "3"),
    "AGPL-3.0": ("Affero General Public License", "3"),
}
_CC_NAMES = {"CC-BY-4.0": "Attribution", "CC-BY-SA-4.0": "Attribution-ShareAlike", "CC-BY-NC-4.0": "Attribution-NonCommercial", "CC-BY-ND-4.0": "Attribution-NoDerivatives"}
_APACHE_REST = """ Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS
        IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
        permissions and limitations under the License."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
        this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
        sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
        non-commercial, and by any means."""
_UNLICENSE_REST = """ In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest
        in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our
        heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights
        to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
        BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
        AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT
        OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to
        <https://unlicense.org>"""
_CC0 = """To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to
        the public domain worldwide. This software is distributed without any warranty."""
_CC0_REST = """ You should have received a copy of the CC0 Public Domain Dedication along with this software. If not, see
        <http://creativecommons.org/publicdomain/zero/1.0/>."""
_CC = """This work is licensed under a Creative Commons %s 4.0 International License."""
_CC_VIEW = """ To view a copy of this license, visit http://creativecommons.org/licenses/%s/4.0/"""
_CC_LETTER = """ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."""


def _whole_texts() -> list[tuple[str, str]]:
    """Whole texts of short licences, the standard headers of long ones, and SPDX lines."""
    out = [("MIT", TEXTS["MIT"] + _MIT_WARRANTY), ("ISC", TEXTS["ISC"] + _ISC_WARRANTY), ("Apache-2.0", TEXTS["Apache-2.0"] + _APACHE_REST)]
    for marks in (("", "", ""), ("1. ", "2. ", "3. ")):
        two = _BSD_2 % marks[:2]
        three = two + _BSD_3 % marks[2]
        out += [("BSD-2-Clause", two), ("BSD-2-Clause", two + _BSD_WARRANTY), ("BSD-3-Clause", three), ("BSD-3-Clause", three + _BSD_WARRANTY)]
    for k, (name, version) in _GNU_NAMES.items():
        rest = _GNU_REST % (name, name)
        for head in (_GNU % (name, version), _GNU_ONLY % (name, version)):
            out += [(k, head), (k, head + rest)]
            if k.startswith("LGPL"):
                out += [(k, x.replace("This program", "This library").replace("this program", "this library")) for x in (head, head + rest)]
    out += [("MPL-2.0", _MPL), ("Unlicense", _UNLICENSE), ("Unlicense", _UNLICENSE + _UNLICENSE_REST), ("CC0-1.0", _CC0), ("CC0-1.0", _CC0 + _CC0_REST)]
    for k, name in _CC_NAMES.items():
        view = _CC % name + _CC_VIEW % k[3:-4].lower()
        out += [(k, _CC % name), (k, view), (k, view + _CC_LETTER)]
    for k in NAMES:
        ends = ("", "-only", "-or-later") if k in _GNU_NAMES else ("",)
        out += [(k, f"SPDX-License-Identifier: {k}{e}") for e in ends]
    return out


#: Where the Affero licence differs from the GNU GPL, version 3.
_AFFERO_HEAD = """GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
        Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble
        The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to
        ensure cooperation with the community in the case of network server software. The licenses for most software and other practical
        works are designed to take away your freedom to share and change the works. By contrast, our General Public Licenses are intended to
        guarantee your freedom to share and change all versions of a program--to make sure it remains free software for all its users. When
        we speak of free software, we are referring to freedom, not price. Our General Public Licenses are designed to make sure that you
        have the freedom to distribute copies of free software (and charge for them if you wish), that you receive source code or can get it
        if you want it, that you can change the software or use pieces of it in new free programs, and that you know you can do these things.
        Developers that use our General Public Licenses protect your rights with two steps: (1) assert copyright on the software, and (2)
        offer you this License which gives you legal permission to copy, distribute and/or modify the software. A secondary benefit of
        defending all users' freedom is that improvements made in alternate versions of the program, if they receive widespread use, become
        available for other developers to incorporate. Many developers of free software are heartened and encouraged by the resulting
        cooperation. However, in the case of software used on network servers, this result may fail to come about. The GNU General Public
        License permits making a modified version and letting the public access it on a server without ever releasing its source code to the
        public. The GNU Affero General Public License is designed specifically to ensure that, in such cases, the modified source code becomes
        available to the community. It requires the operator of a network server to provide the source code of the modified version running
        there to the users of that server. Therefore, public use of a modified version, on a publicly accessible server, gives the public
        access to the source code of the modified version. An older license, called the Affero General Public License and published by Affero,
        was designed to accomplish similar goals. This is a different license, not a version of the Affero GPL, but Affero has released a new
        version of the Affero GPL which permits relicensing under this license. The precise terms and conditions for copying, distribution and
        modification follow."""
_AFFERO_13 = """13. Remote Network Interaction; Use with the GNU General Public License. Notwithstanding any other provision of this License, if you
        modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network (if
        your version supports such interaction) an opportunity to receive the Corresponding Source of your version by providing access to the
        Corresponding Source from a network server at no charge, through some standard or customary means of facilitating copying of software.
        This Corresponding Source shall include the Corresponding Source for any work covered by version 3 of the GNU General Public License
        that is incorporated pursuant to the following paragraph. Notwithstanding any other provision of this License, you have permission to
        link or combine any covered work with a work licensed under version 3 of the GNU General Public License into a single combined work, and
        to convey the resulting work. The terms of this License will continue to apply to the part which is the covered work, but the work with
        which it is combined will remain governed by version 3 of the GNU General Public License."""
OPENING = 40  # words
FINE = 256


def _from_files() -> list[tuple[str, str]]:
    """The texts in ``licence_texts`` and what follows from them, each whole, without its appendix, and its opening."""
    folder = importlib.resources.files(__package__) / "licence_texts"
    texts = {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in folder.iterdir() if f.name.endswith(".txt")}
    if "GPL-3.0" in texts:
        terms = "TERMS AND CONDITIONS" + texts["GPL-3.0"].split("TERMS AND CONDITIONS", 1)[1]
        before, rest = terms.split("13. Use with", 1)
        after = rest[rest.index("14. Revised") :]
        before, after = (x.replace("GNU General Public License", "GNU Affero General Public License") for x in (before, after))
        texts["AGPL-3.0"] = "\n".join((_AFFERO_HEAD, before, _AFFERO_13, after))
    out = []
    for name, text in sorted(texts.items()):
        body = re.split(r"END OF TERMS AND CONDITIONS", text)[0]
        head = re.split(r"\bPreamble\b", body)[0] if re.search(r"\bPreamble\b", body) else " ".join(body.split()[:OPENING])
        out += [(name, text), (name, head)] + [(name, body)] * (body != text)
    return out


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall((text or "").lower())


@functools.cache
def default_templates() -> tuple[tuple[str, str], ...]:
    """Pairs of licence name and template text."""
    stated = [(k, n.format(x)) for k, names in NAMES.items() for x in names for n in NOTICES]
    return tuple(dict.fromkeys(stated + list(TEXTS.items()) + _whole_texts() + _from_files()))


class Scanner:
    def __init__(self, templates: Iterable[tuple[str, str]], threshold: float):
        self.threshold = threshold
        split = [(k, words_of(t)) for k, t in templates]
        self.number = {w: i for i, w in enumerate(sorted({w for _, ws in split for w in ws}))}
        self.size = len(self.number)
        self.names: list[str] = []
        grams = []
        for k, ws in split:
            ids = np.array([self.number[w] for w in ws], dtype=np.int64)
            if len(ids) > 1:
                grams.append(np.unique(ids[:-1] * self.size + ids[1:], return_counts=True))
                self.names.append(k)
        self.b = np.array([c.sum() for _, c in grams], dtype=np.int64)
        self.codes = np.unique(np.concatenate([x for x, _ in grams])) if grams else np.empty(0, np.int64)
        self.grams = [(np.searchsorted(self.codes, x), c) for x, c in grams]
        self.wanted = np.zeros(self.size * self.size, dtype=bool)
        self.wanted[self.codes] = True
        # the index: for each bigram its templates and how often they have it
        owner = np.repeat(np.arange(len(grams)), [len(x) for x, _ in grams])
        flat, times = (np.concatenate(x) if grams else np.empty(0, np.int64) for x in zip(*self.grams, strict=True)) if grams else (self.codes, self.codes)
        by = np.argsort(flat, kind="stable")
        self.holder, self.times = owner[by], times[by]
        self.at = np.searchsorted(flat[by], np.arange(len(self.codes) + 1))
        self.need = threshold * self.b / (2 - threshold) - 1e-9
        self.longest = np.floor(self.b * (2 - threshold) / threshold + 1e-9).astype(np.int64)

    def _windows(self, t: int, at: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of one template: scores, first bigrams and numbers of bigrams of its windows."""
        own, times = self.grams[t]
        many = np.zeros(len(self.codes), dtype=np.int64)
        many[own] = times
        k = np.flatnonzero(many[gram])
        pos, g, n = at[k], gram[k], len(k)
        m = many[g]
        # a hit counts in a window unless the template's share of its bigram is used up there: m hits before it
        by = np.argsort(g, kind="stable")
        place = np.arange(n) - np.searchsorted(g[by], g[by], side="left")
        before, after = np.full(n, -1, dtype=np.int64), np.full(n, n, dtype=np.int64)
        has = np.flatnonzero(place >= m[by])
        before[by[has]] = by[has - m[by][has]]
        after[by[has - m[by][has]]] = by[has]
        end = np.searchsorted(pos, pos + self.longest[t])
        start = np.arange(n)
        useful = end - start >= self.need[t]
        useful[1:] &= (pos[1:] != pos[:-1] + 1) | (after[:-1] < end[1:])
        start = np.flatnonzero(useful)

        def tried(start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The best score of each beginning, and its window's number of bigrams."""
            width = int((end[start] - start).max()) if len(start) else 1
            dice, sizes = np.empty(len(start)), np.empty(len(start), dtype=np.int64)
            step = max(1, (1 << 20) // width)
            for a in range(0, len(start), step):
                i = start[a : a + step, None]
                j = i + np.arange(width)
                inside = j < end[i]
                j = np.minimum(j, n - 1)
                common = np.cumsum((before[j] < i) & inside, axis=1)
                size = pos[j] - pos[i] + 1
                score = np.where(inside, 2 * common / (size + self.b[t]), 0.0)
                best = score.argmax(axis=1)
                rows = np.arange(len(i))
                dice[a : a + step], sizes[a : a + step] = score[rows, best], size[rows, best]
            return dice, sizes

        step, least = max(1, int(self.b[t]) // FINE), self.threshold - 1e-12
        if step > 1 and len(start):
            # every step-th beginning, and those with no hit right before them
            probe = np.flatnonzero((np.arange(len(start)) % step == 0) | (np.diff(pos[start], prepend=-2) > 1))
            rough = tried(start[probe])[0]
            high = np.flatnonzero(rough >= self.threshold - 1.5 / FINE)
            keep = np.zeros(len(start), dtype=bool)
            for group in np.split(high, np.flatnonzero(np.diff(high) > 1) + 1):
                if len(group):
                    sides = np.pad(rough[group], 1, constant_values=-1.0)
                    near = np.zeros(len(start), dtype=bool)
                    for k in probe[group[(sides[1:-1] > sides[:-2]) & (sides[1:-1] >= sides[2:])]].tolist():
                        near[max(0, k - step) : k + step + 1] = True
                    if not (tried(start[near])[0] >= least).any():
                        near[max(0, probe[group[0]] - step) : probe[group[-1]] + step + 1] = True
                    keep |= near
            start = start[keep]
        dice, sizes = tried(start)
        ok = dice >= least
        return dice[ok], pos[start[ok]], sizes[ok]

    def scan(self, text: str | None) -> list[tuple[float, str, int, int]]:
        """``(dice, licence, first word, words)`` of the windows reported, in text order."""
        find = self.number.get
        ids = np.fromiter((find(w, -1) for w in words_of(text)), np.int64)
        at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
        code = ids[at] * self.size + ids[at + 1]
        ok = self.wanted[code]
        at, code = at[ok], code[ok]
        if not len(at):
            return []
        gram = np.searchsorted(self.codes, code)
        met, n = np.unique(gram, return_counts=True)
        m = self.at[met + 1] - self.at[met]
        rows = np.repeat(self.at[met] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
        common = np.bincount(self.holder[rows], weights=np.minimum(np.repeat(n, m), self.times[rows]), minlength=len(self.b))
        found = []
        for t in np.flatnonzero(common >= self.need).tolist():
            dice, start, size = self._windows(t, at, gram)
            found += [(-d, -int(self.b[t]), self.names[t], s, a + 1) for d, s, a in zip(dice.tolist(), start.tolist(), size.tolist(), strict=True)]
        found.sort()
        taken: list[tuple[int, int, str, float]] = []  # sorted by place
        for dice, _, name, start, n_words in found:
            k = bisect.bisect(taken, (start,))
            if (k == len(taken) or start + n_words <= taken[k][0]) and (not k or taken[k - 1][0] + taken[k - 1][1] <= start):
                taken.insert(k, (start, n_words, name, -dice))
        return [(d, name, start, n_words) for start, n_words, name, d in taken]


@functools.lru_cache(maxsize=2)
def scanner(threshold: float, templates: tuple[tuple[str, str], ...] | None = None) -> Scanner:
    return Scanner(templates or default_templates(), threshold)


def scan_licences(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.9, templates: Iterable[tuple[str, str]] | None = None) -> DataFrame:
    """One row for each document: ``id, n_licences, licence`` (best, or null)``, dice, found``.

    ``templates``: pairs of name and text, a few hundred, which the driver reads and broadcasts.

    ``found`` has all windows as ``struct<licence, dice, start, n_words>`` in text order.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    item = pa.struct([("licence", pa.string()), ("dice", pa.float64()), ("start", pa.int64()), ("n_words", pa.int64())])

    shipped = docs.sparkSession.sparkContext.broadcast(tuple(templates or default_templates()))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner(threshold, shipped.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [s.scan(t) for t in part.column("text").to_pylist()]
                best = [max(f, key=lambda x: x[0]) if f else (0.0, None, 0, 0) for f in found]
                rows = [[{"licence": x[1], "dice": x[0], "start": x[2], "n_words": x[3]} for x in f] for f in found]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(f) for f in found], pa.int64()), pa.array([x[1] for x in best], pa.string()), pa.array([x[0] for x in best], pa.float64()), pa.array(rows, pa.list_(item))], ["id", "n_licences", "licence", "dice", "found"])

    out = slim.mapInArrow(scan, f"id {kind}, n_licences long, licence string, dice double, found array<struct<licence: string, dice: double, start: bigint, n_words: bigint>>")
    return out.withColumnRenamed("id", id_col)
