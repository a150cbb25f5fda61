"""Licence scan: normalised text against licence templates by the Dice coefficient over word bigrams.

Compared are every line, every run of lines that mostly consist of bigrams of one template, the whole text, and
windows of words from any bigram of a template to any other, across lines or inside one.  A segment and a template with a and b bigrams can reach a coefficient of t only if a lies between
b * t / (2 - t) and b * (2 - t) / t, and only if they share t * (a + b) / 2; templates beyond those bounds are
never compared.  Bigrams are hashed for that, and coefficients are computed on words.
"""

from __future__ import annotations

import heapq
import pkgutil
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import ALNUM, gram_hashes, hashed_words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MATCH = "array<struct<license:string,kind:string,first_line:int,last_line:int,dice:double>>"

# The wording of public licences and of the notices that refer to them.
TEMPLATES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES
OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is
not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
software. 3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see
https://www.gnu.org/licenses/.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means.""",
    "MIT notice": "Released under the MIT License.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0 notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0 notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "BSD-3-Clause notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 short notice": "Licensed under CC BY 4.0.",
    "All rights reserved": "All rights reserved.",
    "LGPL-2.1 notice": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "BSL-1.0 notice": "Distributed under the Boost Software License, Version 1.0.",
    "CC0-1.0 notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "BSL-1.0": """Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any
person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software")
to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software,
and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in
the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must
be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or
derivative works are solely in the form of machine-executable object code generated by a source language processor. THE
SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE
DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
}

#: Full texts that lie next to this module, as their publishers word them.
FILES = ["Apache-2.0", "CC0-1.0", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-1.1", "MPL-2.0"]
NETWORK = """  13. Remote Network Interaction; Use with the GNU General Public License. Notwithstanding any other provision of this
License, if you modify the Program, your modified version must prominently offer all users interacting with it remotely through
a computer network (if your version supports such interaction) an opportunity to receive the Corresponding Source of your
version by providing access to the Corresponding Source from a network server at no charge, through some standard or customary
means of facilitating copying of software. This Corresponding Source shall include the Corresponding Source for any work
covered by version 3 of the GNU General Public License that is incorporated pursuant to the following paragraph.
Notwithstanding any other provision of this License, you have permission to link or combine any covered work with a work
licensed under version 3 of the GNU General Public License into a single combined work, and to convey the resulting work. The
terms of this License will continue to apply to the part which is the covered work, but the work with which it is combined will
remain governed by version 3 of the GNU General Public License.
"""


def _full_texts() -> dict[str, str]:
    """The files, and what differs from another text in a few clauses only: BSD-3-Clause, BSD-4-Clause and AGPL-3.0.

    Close relatives must all be there, as a text shows the closest template.
    """
    out = {f"{name} text": pkgutil.get_data(__package__, f"license_texts/{name}.txt").decode() for name in FILES}
    named = re.sub(r"(?i)GNU (General Public License)", r"GNU Affero \1", out["GPL-3.0 text"])
    head, tail = named.split("\n  13. ")[0], named.split("\n  14. ")[1]
    out["AGPL-3.0 text"] = f"{head}\n{NETWORK}\n  14. {tail}"
    head, tail = TEMPLATES["BSD-2-Clause"].split("THIS SOFTWARE IS PROVIDED")
    names = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    adverts = "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization."
    out["BSD-3-Clause"] = f"{head}3. {names} THIS SOFTWARE IS PROVIDED{tail}"
    out["BSD-4-Clause"] = f"{head}3. {adverts} 4. {names} THIS SOFTWARE IS PROVIDED{tail}"
    return out


TEMPLATES |= _full_texts()


def _words(text: str) -> list[str]:
    """Words, A-Z in lower case."""
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))


def bigrams(text: str) -> frozenset[tuple[str, ...]]:
    """Pairs of neighbouring words, A-Z in lower case; a single word is its own only member."""
    words = _words(text)
    return frozenset(zip(words, words[1:])) if len(words) > 1 else frozenset((w,) for w in words)


def _reach(before: list[int], after: list[int], hit: list[bool], most: int, need: int, size: int) -> Iterator[tuple[int, int, int, float]]:
    """(start, end of the bounds, shared, dice) of starts whose windows can share ``need`` bigrams with a template of ``size``.

    ``shared`` is what all bigrams up to the end share, and ``dice`` that of the shortest window that shares as many: no
    window of the start ranks higher.  Both ends only move on, so this takes one step for each bigram and end.
    """
    n = len(hit)
    end = distinct = shared = 0  # of [s, end)
    last = inside = 0  # [s, last) is the shortest prefix with all that is shared; its distinct bigrams
    for s in range(n):
        while end < n and (before[end] >= s or distinct < most):
            if before[end] < s:
                distinct += 1
                if hit[end]:
                    shared += 1
                    while last <= end:
                        inside += before[last] < s
                        last += 1
            end += 1
        if hit[s] and shared >= need:
            yield s, end, shared, 2 * shared / (inside + size)
        following = after[s]
        if following >= end:
            distinct -= 1
            shared -= hit[s]
        elif hit[s]:
            while last <= following:
                inside += before[last] < s
                last += 1
        inside -= s < last and following >= last
        if last <= s:
            last, inside = s + 1, 0


class Templates:
    """Templates by size, and their bigrams' hashes."""

    def __init__(self, texts: dict[str, str], threshold: float):
        self.threshold = threshold
        sets = sorted(((len(b), name, b) for name, t in texts.items() if (b := bigrams(t))), key=lambda x: x[:2])
        self.sizes = np.array([n for n, _, _ in sets])
        self.names = [name for _, name, _ in sets]
        self.sets = [b for _, _, b in sets]
        self.single = {w for b in self.sets for g in b if len(g) == 1 for w in g}
        found = [gram_hashes(next(hashed_words([" ".join(t.split())], ALNUM))[1], 2) for t in texts.values()]
        self.hashes = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.uint64)

    def best(self, segment: frozenset) -> list[tuple[str, float]]:
        """The closest template, if it reaches the threshold, from within the size bounds; several if they are equally close."""
        if not segment or not len(self.sizes):
            return []
        t, a = self.threshold, len(segment)
        lo = np.searchsorted(self.sizes, a * t / (2 - t) - 1e-9)
        hi = np.searchsorted(self.sizes, a * (2 - t) / t + 1e-9, side="right")
        out = []
        for i in range(lo, hi):
            dice = 2 * len(segment & self.sets[i]) / (a + len(self.sets[i]))
            if dice >= t:
                out.append((self.names[i], dice))
        most = max((dice for _, dice in out), default=0.0)
        return [(name, dice) for name, dice in out if dice == most]

    def runs(self, sets: list[frozenset]) -> set[tuple[int, int]]:
        """Runs of two and more lines that are blank or have half of their bigrams in one template."""
        out = set()
        for template in self.sets:
            start, last = None, None
            for i, s in enumerate([*sets, None]):
                if s is not None and (not s or 2 * len(s & template) >= len(s)):
                    if s:
                        start, last = i if start is None else start, i
                else:
                    if start is not None and last > start:
                        out.add((start, last))
                    start = None
        return out

    def windows(self, words: list[str]) -> list[tuple[int, int, str, float]]:
        """(first word, last word, template, dice) of windows that reach the threshold, none inside or across another.

        A template's best window of each start among its bigrams is found among all ends within the size bounds.  Of
        windows that overlap, the one that shares most bigrams stays, then the closest; equals all stay.

        Starts wait in a queue by the most that their windows can share, which one slide over the text tells.  A start is
        looked at when its turn comes; those inside a window that stays by then never are.
        """
        t = self.threshold
        numbers: dict[tuple, int] = {}
        grams = np.array([numbers.setdefault(g, len(numbers)) for g in zip(words, words[1:])], dtype=np.int64)
        before, after = np.full(len(grams), -1), np.full(len(grams), len(grams))
        order = np.argsort(grams, kind="stable")
        same = grams[order][1:] == grams[order][:-1]
        before[order[1:][same]] = order[:-1][same]
        after[order[:-1][same]] = order[1:][same]
        queue: list[tuple] = []  # (-shared, -dice, first word, last word or -1 if not looked at, template, end of the bounds)
        hits: dict[int, np.ndarray] = {}
        links = before.tolist(), after.tolist()
        for k, b in enumerate(self.sets):
            need, most = int(np.ceil(t / (2 - t) * len(b) - 1e-9)), int(len(b) * (2 - t) / t + 1e-9)
            if len(b) == 1 and len(word := next(iter(b))) == 1:
                queue += [(-1, -1.0, i, i, k, 0) for i, w in enumerate(words) if w == word[0]]
                continue
            held = [numbers[g] for g in b if g in numbers]
            if held and len(held) >= need:
                hits[k] = np.isin(grams, held)
                queue += [(-most_shared, -dice, s, -1, k, end) for s, end, most_shared, dice in _reach(*links, hits[k].tolist(), most, need, len(b))]
        heapq.heapify(queue)
        free, out, starts = np.ones(len(words), dtype=bool), {}, set()
        while queue:
            less, lower, s, e, k, end = heapq.heappop(queue)
            if not free[s] and s not in starts:
                continue
            if e < 0:
                new = before[s:end] < s  # repeated bigrams do not count, so a window may be longer than its set
                size, shared = np.cumsum(new), np.cumsum(new & hits[k][s:end])
                dice = 2 * shared / (size + len(self.sets[k]))
                at = int(dice.argmax())
                if dice[at] >= t:
                    heapq.heappush(queue, (-int(shared[at]), -float(dice[at]), s, s + at + 1, k, end))
            elif free[s : e + 1].all() or out.get((s, e), (0, 0))[:2] == (less, lower):
                free[s : e + 1] = False
                starts.add(s)
                out.setdefault((s, e), (less, lower, []))[2].append(self.names[k])
        return [(s, e, name, -lower) for (s, e), (_, lower, names) in sorted(out.items()) for name in names]

    def reachable(self, grams: frozenset) -> bool:
        """Whether a text of these bigrams can hold a segment that reaches the threshold with some template."""
        t = self.threshold
        return bool(self.single) or any(len(grams & b) >= t / (2 - t) * len(b) - 1e-9 for b in self.sets)

    def matches(self, text: str) -> list[dict]:
        lines = text.split("\n")
        by_line = [_words(line) for line in lines]
        words = [w for line in by_line for w in line]
        if not self.reachable(frozenset(zip(words, words[1:]))):
            return []
        sets = [bigrams(line) for line in lines]
        found = {("line", i, i): s for i, s in enumerate(sets) if s}
        for first, last in self.runs(sets):
            found["run", first, last] = bigrams("\n".join(lines[first : last + 1]))
        if len(lines) > 1:
            found["text", 0, len(lines) - 1] = bigrams(text)
        out = [(first, last, kind, name, dice) for (kind, first, last), s in found.items() for name, dice in self.best(s)]
        whole = [(first, last, name) for first, last, _, name, _ in out]
        at = np.repeat(np.arange(len(lines)), [len(line) for line in by_line]).tolist()
        for s, e, name, dice in self.windows(words):
            first, last = at[s], at[e]
            # whole lines that match are listed above
            if not any(name == n and i <= first and last <= j for i, j, n in whole):
                out.append((first, last, "window", name, dice))
        return [
            {"license": name, "kind": kind, "first_line": first, "last_line": last, "dice": dice}
            for first, last, kind, name, dice in sorted(out, key=lambda x: (x[0], x[1], x[2]))
        ]

    def worth_a_look(self, texts: list[str | None]) -> Iterator[int]:
        """Indexes of texts with so many bigrams of templates that some template can be reached.

        A text that shares fewer than t / (2 - t) * b bigrams with every template of b bigrams has no match: a
        segment that reaches t has at least t / (2 - t) * b bigrams, and shares at least that many.
        """
        need = max(1, int(np.ceil(self.sizes.min(initial=1) * self.threshold / (2 - self.threshold) - 1e-9)))
        for first, hashes, offsets in hashed_words(texts, ALNUM):
            grams = gram_hashes(hashes, 2)
            hit = np.zeros(len(hashes) + 1, dtype=np.int64)
            if len(grams) and len(self.hashes):
                at = np.minimum(np.searchsorted(self.hashes, grams), len(self.hashes) - 1)
                hit[1 : len(grams) + 1] = self.hashes[at] == grams
            hit = np.cumsum(hit)
            enough = hit[offsets[1:]] - hit[offsets[:-1]] >= need
            if self.single:
                enough[:] = True
            yield from (first + np.flatnonzero(enough)).tolist()


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.9, templates: dict[str, str] | None = None,
) -> DataFrame:
    """One row per document: doc_id and matches (license, kind of segment, first and last line, dice).

    Words are runs of digits, letters and characters beyond ASCII, A-Z in lower case; a segment of one word is compared by that
    word.  A segment is listed with its closest template; templates equally close are all listed, by size and name.  A window
    is listed unless whole lines around it match the same template.  Null, empty and wordless texts have no
    matches; whole texts are read whatever their length.  Repeated rows give a row each, other columns are not read, an
    empty table, or no templates, gives no matches.
    """
    known = Templates(TEMPLATES if templates is None else templates, threshold)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    kind = pa.list_(pa.struct([("license", pa.string()), ("kind", pa.string()), ("first_line", pa.int32()), ("last_line", pa.int32()), ("dice", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found: list[list[dict]] = [[] for _ in texts]
            for i in known.worth_a_look(texts):
                if texts[i]:
                    found[i] = known.matches(texts[i])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "matches"])

    return rows.mapInArrow(run, f"doc_id {id_type}, matches {MATCH}")
