"""Licence scans: lines, passages and whole texts compared to templates by Dice over word bigrams.

A unit of text is normalised to lower-case words; its set of word bigrams A is compared with
each template's set B by ``2 |A n B| / (|A| + |B|)``.  Only templates with
``t / (2 - t) <= |A| / |B| <= (2 - t) / t`` can reach the threshold t, so the templates are
kept in order of size and a unit looks at that range alone; units that share too few bigrams
with any template are passed over by vectorised hash look-ups.  The templates are a fixed
list, so the broadcast does not grow with the data.

Units are each line, the whole text, and passages: all runs of consecutive words of at most
``(2 - t) / t`` times a template's length, wherever they begin and end.  A run can reach the
threshold only if it holds ``t / (2 - t)`` of the template's bigrams, so runs are looked at
only where so many known bigrams lie within that length.  Of passages that overlap, the one
with the most above the threshold (``2 |A n B| - t (|A| + |B|)``) is reported, unless a line
that matches as well or better lies in it, or the whole text matches the same licence.

A line or text of one word counts as one bigram.  Edge cases: null and empty texts match
nothing; repeated rows are each reported; ties go to the earlier template, then to the earlier line;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewire.llm.common import ids_and_texts, map_batches
from tidewire.llm.textbatch import ALNUM, Words, utf8_parts, window_hashes, word_chunks

THRESHOLD = 0.9


def _full_text(name: str) -> tuple[str, str]:
    """A whole licence by its SPDX identifier, on one line."""
    return name, " ".join((Path(__file__).parent / "license_texts" / f"{name}.txt").read_text(encoding="utf-8").split())


_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'

#: Licence notices and texts, by SPDX identifier.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0-or-later", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Proprietary", "All rights reserved."),
    ("BSD-2-Clause", f"{_BSD_HEAD} {_BSD_TAIL}"),
    ("BSD-3-Clause", f"{_BSD_HEAD} {_BSD_THIRD} {_BSD_TAIL}"),
    ("GPL-2.0-only", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    _full_text("Apache-2.0"),
    _full_text("GPL-2.0-only"),
    _full_text("GPL-3.0-only"),
)


class TemplateIndex:
    """Bigram sets of the templates in order of size, and all their bigrams for a first look."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> None:
        self.threshold = threshold
        self.ratio = threshold / (2 - threshold)
        made, lengths = [], {}
        for order, (name, text) in enumerate(templates):
            data, offsets = utf8_parts(pa.array([text], pa.string()))
            hashes = Words(data, offsets, ALNUM).hashes()
            made.append((bigrams(hashes), order, name))
            lengths[order] = max(1, len(hashes) - 1)
        made.sort(key=lambda x: (len(x[0]), x[1]))
        self.sets = [(frozenset(s.tolist()), order, name) for s, order, name in made]
        self.sizes = [len(s) for s, _, _ in made]
        self.all = np.unique(np.concatenate([s for s, _, _ in made]))
        self.size_of = {order: len(s) for s, order, _ in made}
        #: For each template its order, name, size, longest run in bigrams, and which of all bigrams it has.
        self.passages = [(order, name, len(s), int(lengths[order] / self.ratio + 1e-9), np.isin(self.all, s)) for s, order, name in made]
        self.least_shared = max(1, int(np.ceil(self.ratio * self.sizes[0] - 1e-9)))

    def best(self, unit: np.ndarray) -> tuple[float, int, str] | None:
        """(dice, -order, name) of the best template for a set of bigrams, if it reaches the threshold."""
        if not len(unit):
            return None
        lo = bisect.bisect_left(self.sizes, len(unit) * self.ratio - 1e-9)
        hi = bisect.bisect_right(self.sizes, len(unit) / self.ratio + 1e-9)
        if lo >= hi:
            return None
        have = set(unit.tolist())
        scored = max((2 * len(have & s) / (len(have) + len(s)), -order, name) for s, order, name in self.sets[lo:hi])
        return scored if scored[0] >= self.threshold - 1e-12 else None

    def runs(self, pairs: np.ndarray, at: np.ndarray, known: np.ndarray, limits: np.ndarray) -> list[tuple[float, float, int, str, int, int, int]]:
        """(surplus, dice, -order, name, shared, first, last bigram + 1) of each start's best run that reaches the threshold.

        ``at`` has the place of each bigram among all, ``limits`` where the text of each ends.
        """
        out = []
        where = np.flatnonzero(known)
        codes = at[where]
        for order, name, size, span, holds in self.passages:
            need = max(1, int(np.ceil(self.ratio * size - 1e-9)))
            spots = where[holds[codes]]
            if len(spots) < need:
                continue
            stops = np.minimum(limits[spots], spots + span)
            dense = np.flatnonzero(np.searchsorted(spots, stops) - np.arange(len(spots)) >= need)
            if not len(dense):
                continue
            starts, stops = spots[dense], stops[dense]
            for group in np.split(np.arange(len(dense)), np.flatnonzero(starts[1:] >= stops[:-1]) + 1):
                lo, hi = int(starts[group[0]]), int(stops[group[-1]])
                mine = known[lo:hi] & holds[at[lo:hi]]
                earlier = _earlier(pairs[lo:hi])
                for a, b in zip((starts[group] - lo).tolist(), (stops[group] - lo).tolist()):
                    fresh = earlier[a:b] < a
                    shared, total = np.cumsum(fresh & mine[a:b]), np.cumsum(fresh) + size
                    dice = 2 * shared / total
                    k = int(dice.argmax())
                    if dice[k] >= self.threshold - 1e-12:
                        out.append((float(2 * shared[k] - self.threshold * total[k]), float(dice[k]), -order, name, int(shared[k]), lo + a, lo + a + k + 1))
        return out


def _earlier(values: np.ndarray) -> np.ndarray:
    """Where each value was last seen before, or -1."""
    order = np.argsort(values, kind="stable")
    out = np.full(len(values), -1)
    same = values[order[1:]] == values[order[:-1]]
    out[order[1:][same]] = order[:-1][same]
    return out


def apart(runs: list[tuple], lines: list[tuple[float, int, int, int]]) -> list[tuple]:
    """The runs with most surplus that overlap neither one another nor a line (surplus, shared, first, last bigram + 1) as good."""
    kept: list[tuple] = []
    for run in sorted(runs, key=lambda r: (-r[0], -r[1], -r[2], r[5])):
        surplus, shared, a, b = run[0], run[4], run[5], run[6]
        if all(b <= k[5] or k[6] <= a for k in kept) and all(b <= c or d <= a or (s < surplus - 1e-9 and n < shared) for s, n, c, d in lines):
            kept.append(run)
    return kept


def bigrams(words: np.ndarray) -> np.ndarray:
    """Distinct bigram hashes of consecutive words; a single word stands for itself."""
    if len(words) < 2:
        return words
    (_, pairs), = window_hashes(words, {2})
    return np.unique(pairs)


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and its matches (unit: line number from 0, where a passage begins, or -1 for the whole text; license; dice), best first."""
    index = TemplateIndex(templates, threshold)
    schema = T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("matches", T.ArrayType(T.StructType([T.StructField("unit", T.IntegerType()), T.StructField("license", T.StringType()), T.StructField("dice", T.DoubleType())]))),
        ]
    )
    arrow = pa.list_(pa.struct([("unit", pa.int32()), ("license", pa.string()), ("dice", pa.float64())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(batch.num_rows)]
        for lo, hi, words in word_chunks(batch.column("text"), ALNUM):
            hashes = words.hashes()
            if not len(hashes):
                continue
            docs_of = words.owners()
            breaks = np.cumsum(words.low == 10)
            line = breaks[words.starts] if len(breaks) else np.zeros(0, int)
            pairs = next((p for _, p in window_hashes(hashes, {2})), np.zeros(0, np.uint64))
            at = np.searchsorted(index.all, pairs)
            at[at == len(index.all)] = 0
            known = index.all[at] == pairs
            known &= docs_of[: len(pairs)] == docs_of[len(docs_of) - len(pairs) :]
            known_words = np.isin(hashes, index.all)
            runs: dict[int, list[tuple]] = {}
            for one in index.runs(pairs, at, known, words.first[docs_of[: len(pairs)] + 1] - 1):
                runs.setdefault(int(docs_of[one[5]]), []).append(one)
            for doc in np.unique(np.concatenate([docs_of[:-1][known], docs_of[known_words]])).tolist():
                a, b = int(words.first[doc]), int(words.first[doc + 1])
                shared = np.flatnonzero(known[a : b - 1])
                found, whole, taken = [], None, []
                if len(shared) >= index.least_shared:
                    unit = bigrams(hashes[a:b])
                    if len(shared) >= index.ratio * len(unit) - 1e-9 and (best := index.best(unit)):
                        found.append((best, -1))
                        whole = best[2]
                own = line[a:b]
                start = int(words.offsets[doc])
                base = int(breaks[start - 1]) if start else 0
                lines, begin = np.unique(own, return_index=True)
                inner = shared[own[shared] == own[shared + 1]]
                hit = np.bincount(np.searchsorted(lines, own[inner]), minlength=len(lines)) >= index.least_shared
                ends = np.append(begin[1:], b - a)
                for k in np.flatnonzero(hit | (ends - begin == 1)).tolist():
                    unit = bigrams(hashes[a + begin[k] : a + ends[k]])
                    if best := index.best(unit):
                        found.append((best, int(lines[k]) - base))
                        total = len(unit) + index.size_of[-best[1]]
                        taken.append((best[0] * total - index.threshold * total, round(best[0] * total / 2), a + int(begin[k]), a + int(ends[k])))
                for _, dice, order, name, _, first, _ in apart(runs.get(doc, []), taken):
                    if name != whole:
                        found.append(((dice, order, name), int(line[first]) - base))
                found.sort(key=lambda f: (-f[0][0], -f[0][1], f[1]))
                out[lo + doc] = [{"unit": unit, "license": name, "dice": dice} for (dice, _, name), unit in found]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, arrow)], ["doc_id", "matches"])

    return map_batches(ids_and_texts(docs), run, schema)


def digest(found: DataFrame) -> DataFrame:
    """Distinct licences by name, and the best match, of each document."""
    from pyspark.sql import functions as F

    best = F.get("matches", F.lit(0))
    return found.select(
        "doc_id",
        F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",").alias("licenses"),
        best["license"].alias("best_license"),
        best["unit"].cast("long").alias("best_unit"),
        F.round(best["dice"], 6).alias("best_dice"),
        F.size("matches").cast("long").alias("n_units"),
    )
