"""License scan: Dice coefficient of word bigrams against licence templates.

A document's units are its whole text, each line, and each span of two or more
consecutive lines. Unit and template are ASCII-lower-cased words; their bigrams
are multisets. A unit matches the template with the highest Dice coefficient if
that is ``threshold`` or more. Of the lines and spans that match one template and
overlap, a span is reported only if it is the best (of equals, the one of fewer
lines, then the first); matching lines and whole texts are always reported.

Two exact bounds prune: with a coefficient of t, sizes differ by a factor of
(2 - t) / t at most, so only templates within that range of the unit's size
are compared; and the unit shares at least t / (2 - t) of its bigrams with the
template, so a unit with fewer bigrams known to any template is no match.

Defined results: null and empty texts match nothing; a unit of fewer than two
words has no bigrams and matches nothing; equal coefficients go to the least
template id; repeated rows are reported one by one; an empty table gives an
empty result; further columns, clashing ones too, are ignored.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterable
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, map_batches, texts_of
from .decontaminate import item_words

THRESHOLD = 0.8

# The names of the SPDX list whose identifier lines are known.
SPDX = "0BSD AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 EPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MPL-2.0 Unlicense Zlib".split()

_GNU = (
    "{it} is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {name} "
    "as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. "
    "{it} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. "
    "You should have received a copy of the GNU {name} along with {this}; if not, {where}"
)
_WRITE = "write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."
_SEE = "see <https://www.gnu.org/licenses/>."
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission. "
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
    "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

# The wording of public licence notices and of licences that are short.
TEMPLATES: dict[str, str] = {
    **{f"spdx:{x}": f"SPDX-License-Identifier: {x}" for x in SPDX},
    "0bsd": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
        "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "agpl-3.0": _GNU.format(it="This program", this="this program", colon=":", name="Affero General Public License", version="3", where=_SEE),
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "bsd-2-clause": _BSD + _BSD_END,
    "bsd-3-clause": _BSD + _BSD_THIRD + _BSD_END,
    "bsl-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation "
        'covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative '
        "works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: "
        "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, "
        "must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative "
        "works are solely in the form of machine-executable object code generated by a source language processor. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING "
        "THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
        "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "cc-by-4.0-line": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0.",
    "gpl-2.0": _GNU.format(it="This program", this="this program", colon=";", name="General Public License", version="2", where=_WRITE),
    "gpl-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
        "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "lgpl-2.1": _GNU.format(it="This library", this="this library", colon=";", name="Lesser General Public License", version="2.1", where=_WRITE),
    "lgpl-3.0": _GNU.format(it="This library", this="this library", colon=":", name="Lesser General Public License", version="3", where=_SEE),
    "mit-line": "Released under the MIT License.",
    "mit": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. "
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software "
        "to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend "
        "this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org/>"
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
        "from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
        "alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must "
        "not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be "
        "appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original "
        "software. 3. This notice may not be removed or altered from any source distribution."
    ),
}


class Scanner:
    """Templates as bigram multisets, in order of size."""

    def __init__(self, templates: dict[str, str], threshold: float = THRESHOLD):
        self.threshold = threshold
        grams = {k: Counter(self.bigrams(item_words(t.encode()))) for k, t in templates.items()}
        self.templates = sorted((sum(g.values()), k, g) for k, g in grams.items() if g)
        self.sizes = [n for n, _, _ in self.templates]
        self.known = frozenset(x for _, _, g in self.templates for x in g)
        self.share = threshold / (2 - threshold)

    @staticmethod
    def bigrams(w: list[bytes]) -> Iterable[tuple[bytes, bytes]]:
        return zip(w, w[1:], strict=False)

    def best(self, w: list[bytes]) -> tuple[float, str] | None:
        """(coefficient, template) of the best match at the threshold or more."""
        n = len(w) - 1
        if n < 1 or not self.sizes:
            return None
        low = bisect.bisect_left(self.sizes, n * self.share - 1e-9)
        high = bisect.bisect_right(self.sizes, n / self.share + 1e-9)
        if low >= high or sum(g in self.known for g in self.bigrams(w)) < n * self.share - 1e-9:
            return None
        own = Counter(self.bigrams(w))
        found = max((2 * (own & g).total() / (n + size), _Last(k)) for size, k, g in self.templates[low:high])
        return (found[0], found[1].name) if found[0] >= self.threshold else None

    def scan(self, text: bytes) -> list[tuple[int, int, str, float]]:
        """(first line, last line, template, coefficient) of each matching unit, in order."""
        lines = [item_words(x) for x in text.split(b"\n")]
        words = [x for w in lines for x in w]
        # Number of known bigrams before each word of the whole text.
        known = [0, *accumulate(g in self.known for g in self.bigrams(words))]
        full = [i for i, w in enumerate(lines) if w]
        ends = list(accumulate(len(lines[i]) for i in full))
        starts = [0, *ends][:-1]
        out = {}
        for i, a, b in zip(full, starts, ends, strict=True):
            if b - a > 1 and known[b - 1] - known[a] >= (b - 1 - a) * self.share - 1e-9 and (found := self.best(lines[i])):
                out[i, i] = found
        spans = {(full[i], full[j]): found for i, j in self._spans(known, starts, ends) if (found := self.best(words[starts[i] : ends[j]]))}
        taken: dict[str, list[tuple[int, int]]] = {}
        spanned: list[tuple[int, int]] = []
        for (a, b), (score, k) in sorted((out | spans).items(), key=lambda x: (-x[1][0], x[0][1] - x[0][0], x[0])):
            if all(b < c or d < a for c, d in [*taken.setdefault(k, []), *(spanned if b > a else [])]):
                taken[k].append((a, b))
                out[a, b] = (score, k)
                if b > a:
                    spanned.append((a, b))
        matched = {i for a, b in out for i in range(a, b + 1)}
        if len(lines) > 1 and len(words) - 1 <= max(self.sizes, default=0) / self.share and (found := self.best(words)):
            out[0, len(lines) - 1] = found
        every = [(a, b, k, score) for (a, b), (score, k) in out.items()]
        if self.sizes and known[-1] >= self.sizes[0] * self.share - 1e-9:
            total = np.array(known)
            every += [(i, i, k, score) for i, a, b in zip(full, starts, ends, strict=True) if i not in matched for k, score in self.inside(words[a:b], total[a:b])]
        return sorted(every, key=lambda x: x[:2])

    def inside(self, w: list[bytes], known: np.ndarray) -> list[tuple[str, float]]:
        """(template, coefficient) of the stretches of a line that have a template's length; ``known`` counts known bigrams before each word."""
        own = list(self.bigrams(w))
        found = []
        for size, k, grams in self.templates:
            if size >= len(own):
                break
            starts = np.flatnonzero(known[size:] - known[: len(known) - size] >= size * self.share - 1e-9)
            last, held, common = None, Counter(), 0
            for at in starts.tolist():
                if last is None or at - last > size:
                    held = Counter(own[at : at + size])
                    common = (held & grams).total()
                else:
                    for i in range(last, at):
                        gone, new = own[i], own[i + size]
                        common -= held[gone] <= grams[gone]
                        held[gone] -= 1
                        held[new] += 1
                        common += held[new] <= grams[new]
                last = at
                if common >= self.threshold * size:
                    found.append((-common / size, -size, at, k))
        out, taken = [], []
        for score, size, at, k in sorted(found):
            if all(at - size < a or b < at for a, b in taken):
                taken.append((at, at - size))
                out.append((at, k, -score))
        return [(k, score) for _, k, score in sorted(out)]

    def _spans(self, known: list[int], starts: list[int], ends: list[int]) -> Iterable[tuple[int, int]]:
        """Spans (first, last) of two or more non-blank lines with the size and the share of known bigrams that any match needs.

        A bigram in no stretch with that share is in no such span, and cuts the lines into groups.
        """
        if len(starts) < 2 or not self.sizes or not known[-1]:
            return
        total = np.array(known) - self.share * np.arange(len(known))
        reach = np.maximum.accumulate(total[:0:-1])[::-1] - np.minimum.accumulate(total)[:-1]
        outside = np.concatenate([[0], np.cumsum(reach < -1e-6)])
        least, most = self.sizes[0] * self.share - 1e-9, self.sizes[-1] / self.share + 1e-9
        first, last = np.array(starts), np.array(ends) - 1
        joined = outside[last[1:]] == outside[first[:-1]]  # the whole of a line and the step to the next line's last word
        for i in np.flatnonzero(joined).tolist():
            for j in range(i + 1, len(starts)):
                n = ends[j] - 1 - starts[i]
                if n > most or not joined[j - 1]:
                    break
                if n >= least and known[ends[j] - 1] - known[starts[i]] >= n * self.share - 1e-9:
                    yield i, j


class _Last:
    """Orders names backwards, so that max() takes the least name of equal scores."""

    __slots__ = ("name",)

    def __init__(self, name: str):
        self.name = name

    def __lt__(self, other: _Last) -> bool:
        return self.name > other.name


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id and matches, an array of (first_line, last_line, license, score)."""
    scanner = Scanner(TEMPLATES if templates is None else templates, threshold)

    def fn(batch: pa.RecordBatch) -> dict:
        out = [[{"first_line": a, "last_line": b, "license": k, "score": s} for a, b, k, s in scanner.scan(t)] for t in texts_of(batch, "text")]
        return {"doc_id": batch.column("doc_id"), "matches": out}

    own = id_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return map_batches(own, fn, "doc_id long, matches array<struct<first_line:long,last_line:long,license:string,score:double>>")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_matches, licenses (sorted, comma-joined), best_score, matches (license:first:last)."""
    found = scan(docs)
    spans = F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["first_line"].cast("string"), m["last_line"].cast("string")))
    return found.select("doc_id", F.size("matches").cast("long").alias("n_matches"), F.concat_ws(",", F.array_sort(F.array_distinct("matches.license"))).alias("licenses"), F.array_max("matches.score").alias("best_score"), F.concat_ws(",", spans).alias("matches"))
