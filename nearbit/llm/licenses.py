"""License scans: templates found by MinHash over overlapping windows, verified by containment.

A template of T shingles is looked for in windows of twice to four times T
positions that overlap by half, so any passage as long as the template lies in
one of them whole. If 80 % of the template are there, window and template have
a Jaccard similarity of 0.19 or more; ``COORDS`` bands of one coordinate then
collide with probability 1 - (1 - 0.19)^64 > 1 - 2e-6. A collision only
retrieves: the match is decided by the share of the template's shingles that
the passage really holds.

Null and empty texts match nothing; repeated rows and null ids keep their rows.
Very long texts are read whole; of passages that tie, the first stays. Extra
columns are left out, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearbit.llm import shingles as S
from nearbit.llm.common import slices

WORDS, PERCENT, COORDS = 5, 80, 64
#: Positions whose minima are taken together first.
UNIT = 4
LETTERS = re.compile(r"[^\W_]+")

# Words that licences spell in two ways.
SPELLING = {"licence": "license", "licences": "licenses", "licenced": "licensed", "licencing": "licensing", "sublicence": "sublicense", "authorisation": "authorization", "authorised": "authorized", "organisation": "organization", "whilst": "while", "favour": "favor"}

# The wording of public licences and notices.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-2-clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "bsd-3-clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit": "Released under the MIT License.",
    "mit-header": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}


def words(text: str | None) -> list[str]:
    return [SPELLING.get(w, w) for w in LETTERS.findall(text.lower())] if text else []


class Scanner:
    """Finds templates in texts."""

    def __init__(self, templates: dict[str, str], n: int = WORDS, percent: int = PERCENT) -> None:
        self.memory, self.sketch, self.percent = S.WordHashes(), S.Circulant(COORDS), percent
        self.groups: dict[tuple[int, int], list[tuple[str, np.ndarray, np.ndarray]]] = {}
        for name, text in sorted(templates.items()):
            h = S.word_hashes(words(text), self.memory)
            if len(h):
                k = min(n, len(h))
                own = np.unique(S.shingle_hashes(h, k))
                size = 2 * UNIT
                while size < 2 * len(own):
                    size *= 2
                self.groups.setdefault((k, size), []).append((name, own, self.sketch.signature(own)))
        self.values = {}
        for key, group in self.groups.items():
            self.values[key] = np.zeros(S.POSITIONS, bool)
            for _, _, sig in group:
                self.values[key][sig] = True

    def scan(self, text: str | None) -> list[tuple[str, int, int, float]]:
        """(template, first word, end word, containment) of each passage, in order."""
        h = S.word_hashes(words(text), self.memory)
        found, near = [], {}
        for k in sorted({k for k, _ in self.groups}):
            if len(h) < k:
                continue
            s = S.shingle_hashes(h, k)
            step = S.BLOCK // UNIT * UNIT
            low = np.concatenate([np.minimum.reduceat(rows, np.arange(0, len(rows), UNIT)) for rows in (self.sketch.rows_of(s[i : i + step]) for i in range(0, len(s), step))])
            width, size = UNIT, max(size for kk, size in self.groups if kk == k)
            while width < size:
                if len(low) > 1:
                    window = np.minimum(low[:-1], low[1:])  # twice the width, by one width
                else:
                    window = low
                if (k, 2 * width) in self.groups:
                    for w in np.flatnonzero(self.values[k, 2 * width][window].any(axis=1)).tolist():
                        for name, own, sig in self.groups[k, 2 * width]:
                            if (sig == window[w]).any():
                                near.setdefault(name, (own, []))[1].append((max(0, (w - 1) * width), (w + 3) * width))
                if len(low) % 2:
                    low = np.concatenate([low, low[-1:]])
                low, width = np.minimum(low[::2], low[1::2]), 2 * width
            for name, (own, ranges) in near.items():
                found += self._verify(name, own, s, ranges, k)
            near.clear()
        kept: list[tuple[str, int, int, float]] = []
        starts: list[int] = []  # of those kept, in order, with their ends: they lie apart, so neighbours decide
        stops: list[int] = []
        # Of passages that overlap, the one that holds most of its template stays: a version does not count as its sister.
        for n, *m in sorted(found, key=lambda m: (-m[0], -m[4], m[1], m[2])):
            at = bisect_left(starts, m[1])
            if (at == len(starts) or m[2] <= starts[at]) and (at == 0 or stops[at - 1] <= m[1]):
                starts.insert(at, m[1])
                stops.insert(at, m[2])
                kept.append(tuple(m))
        return sorted(kept, key=lambda m: (m[1], m[0]))

    def _verify(self, name: str, own: np.ndarray, s: np.ndarray, ranges: list[tuple[int, int]], k: int) -> list[tuple[int, str, int, int, float]]:
        """Passages that lie apart and hold enough of the template; of all such choices the best, then the shortest.

        A passage counts as much as it holds beyond half the threshold: so whole
        copies in a row are not cut into more passages of just enough, and two
        copies with a word changed are not taken for one.
        """
        inside = np.zeros(len(s), bool)
        for lo, hi in ranges:
            inside[lo:hi] = True
        at = np.flatnonzero(inside)
        at = at[np.isin(s[at], own)]
        span = 2 * len(own) + k  # room for words put in
        need = max(1, -(-self.percent * len(own) // 100))
        last = np.searchsorted(at, at + span).tolist()
        behind = np.searchsorted(at, at + k).tolist()
        order = np.argsort(s[at], kind="stable")
        before = np.full(len(at), -1)  # the hit before of the same shingle
        same = s[at][order]
        before[order[1:]] = np.where(same[1:] == same[:-1], order[:-1], -1)
        place = at.tolist()
        # From the last hit on: what the passages count, less their lengths; and the first of them.
        best: list[tuple[int, int]] = [(0, 0)] * (len(place) + 1)
        first: list[tuple[int, int, int, int] | None] = [None] * (len(place) + 1)
        for i in range(len(place) - 1, -1, -1):
            best[i], first[i] = best[i + 1], first[i + 1]
            if last[i] - i < need:
                continue
            new = np.flatnonzero(before[i : last[i]] < i)[need - 1 :] + i
            for n, x in enumerate(new.tolist(), need):
                end, j = place[x] + k, behind[x]
                total = (best[j][0] + 200 * n - self.percent * len(own), best[j][1] - (end - place[i]))
                if total >= best[i]:
                    best[i], first[i] = total, (n, place[i], end, j)
        out, m = [], first[0]
        while m:
            out.append((m[0], name, m[1], m[2], m[0] / len(own)))
            m = first[m[3]]
        return out


def license_scan(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n_matches, licenses, matches)`` for every row; matches are structs (license, start, end, containment)."""
    chosen = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen, n, percent)
        kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())]))
        for batch in slices(batches):
            got = [[dict(zip(("license", "start", "end", "containment"), m, strict=True)) for m in scanner.scan(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, kind)], ["doc_id", "matches"])

    found = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, matches array<struct<license:string,start:bigint,end:bigint,containment:double>>")
    names = F.array_join(F.array_sort(F.array_distinct(F.col("matches.license"))), ",")
    return found.select("doc_id", F.size("matches").cast("long").alias("n_matches"), names.alias("licenses"), "matches")
