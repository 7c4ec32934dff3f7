"""License scans: winnowed fingerprints pick candidates, banded alignment confirms them.

Templates and texts are sequences of lower-cased terms. Hashes of `gram` terms are
winnowed: the least of each window of `window` hashes. Any common run of gram + window - 1
terms then has a common fingerprint. The inverted index of the templates is small and
fixed. Hits of one template on near diagonals make a region, and a banded local alignment
of region and template gives matched terms, coverage and the span in the text. What a
region has left and right of a match is aligned again, so copies close by come out too.

Defined results: a null or empty text has no matches. Repeated rows give their matches
again. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import bisect
import heapq
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm import kernel
from corpusloom.llm.pii import IS_TERM

#: Names and wording of common license statements, notices and whole licenses.
#: A whole license holds its grant, so a text with it matches both.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "mit-line": "Released under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.',
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "bsd-2-clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "isc": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "bsl-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.',
}


@dataclass(frozen=True)
class LicenseParams:
    gram: int = 3
    window: int = 3
    band: int = 8
    min_coverage: float = 0.75
    templates: dict[str, str] = field(default_factory=lambda: dict(TEMPLATES))


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    lowered = kernel.LOWER[data]
    starts, ends, first = kernel.runs(IS_TERM[lowered], offsets)
    return starts, ends, first, kernel.span_hashes(kernel.prefix_sums(lowered), starts, ends)


def winnow(grams: np.ndarray, width: int) -> np.ndarray:
    """Places of the least hash (the last of equals) in each window; of all, if they are fewer."""
    if len(grams) <= width:
        return np.array([len(grams) - 1 - int(np.argmin(grams[::-1]))] if len(grams) else [], dtype=np.int64)
    seen = np.lib.stride_tricks.sliding_window_view(grams, width)[:, ::-1]
    return np.unique(np.arange(len(seen)) + width - 1 - np.argmin(seen, axis=1))


def align(text: list[int], template: list[int], shift: int, band: int) -> tuple[int, int, int]:
    """Local alignment near the diagonal text = template + shift: matched terms, first, last + 1.

    A match scores 2, a mismatch or a gap -1. Cells farther than `band` off the diagonal are left out.
    """
    best, before = (0, 0, 0, 0), {}
    for j, want in enumerate(template):
        row, left = {}, None
        for i in range(max(0, j + shift - band), min(len(text), j + shift + band + 1)):
            score, matched, begin = max(before.get(i - 1, (0, 0, i)), (0, 0, i))
            cell = (score + 2, matched + 1, begin) if text[i] == want else (score - 1, matched, begin)
            for other in (before.get(i), left):
                if other and other[0] - 1 > cell[0]:
                    cell = (other[0] - 1, other[1], other[2])
            left = cell if cell[0] > 0 else None
            if left:
                row[i] = cell
                if (cell[0], cell[1]) > best[:2]:
                    best = (cell[0], cell[1], cell[2], i + 1)
        before = row
    return best[1:]


SCHEMA = "doc_id long, license string, matched long, coverage double, start long, end long"


def scan(docs: DataFrame, params: LicenseParams = LicenseParams()) -> DataFrame:
    """A row of SCHEMA for each match."""
    kernel.tuned(docs.sparkSession)
    names, sequences, index = list(params.templates), [], {}
    for number, text in enumerate(params.templates.values()):
        raw = np.frombuffer(text.encode(), np.uint8)
        keys = _terms(raw, np.array([0, len(raw)]))[3]
        sequences.append(keys.tolist())
        grams = kernel.windows(keys, np.array([0, len(keys)]), params.gram)[0]
        for at in winnow(grams, params.window):
            index.setdefault(int(grams[at]), []).append((number, int(at)))
    prints = np.array(sorted(index), dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for begin, _, data, offsets in kernel.slices(batch.column(1)):
                starts, ends, first, keys = _terms(data, offsets)
                grams, of = kernel.windows(keys, first, params.gram)
                at = np.minimum(np.searchsorted(prints, grams), len(prints) - 1) if len(prints) else np.zeros(len(grams), np.int64)
                known = np.flatnonzero(prints[at] == grams) if len(prints) else np.zeros(0, np.int64)
                for d in np.unique(np.searchsorted(of, known, "right") - 1):
                    # Only documents that hold a template's fingerprint at all are winnowed.
                    mine = grams[of[d] : of[d + 1]]
                    chosen = winnow(mine, params.window)
                    hits = [(t, int(p) - q, int(p)) for p in chosen for t, q in index.get(int(mine[p]), ())]
                    if hits:
                        points = np.cumsum((data[offsets[d] : offsets[d + 1]] & 0xC0) != 0x80)
                        a, b = starts[first[d] : first[d + 1]] - offsets[d], ends[first[d] : first[d + 1]] - offsets[d]
                        text = keys[first[d] : first[d + 1]].tolist()
                        for name, matched, coverage, s, e in _matches(text, hits, names, sequences, params):
                            out.append((ids[begin + d], name, matched, coverage, int(points[a[s]]) - 1, int(points[b[e - 1] - 1])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), shape, strict=True)], schema=shape)

    shape = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("matched", pa.int64()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())])
    return docs.select("doc_id", "text").mapInArrow(kernel.tidy(run), SCHEMA)


def _matches(text: list[int], hits: list[tuple[int, int, int]], names: list[str], sequences: list[list[int]], params: LicenseParams) -> Iterator[tuple[str, int, float, int, int]]:
    """Alignments of the hits' regions that cover enough of their template, best first, without overlaps of a template.

    What is left of a region beside a match is aligned again, until nothing covers enough.
    """
    regions, todo, taken = [], [], defaultdict(list)

    def ask(number: int, diagonal: int, low: int, high: int) -> None:
        template = sequences[number]
        if high - low < params.min_coverage * len(template):
            return
        matched, s, e = align(text[low:high], template, diagonal - low, 2 * params.band)
        if matched >= params.min_coverage * len(template):
            heapq.heappush(todo, (number, -matched, low + s, low + e, diagonal, low, high))

    def within(spans: list[tuple[int, int]], low: int, high: int) -> list[tuple[int, int]]:
        # Spans of a template are in order and apart.
        first = max(0, bisect.bisect_left(spans, (low, low)) - 1)
        return [x for x in spans[first : bisect.bisect_left(spans, (high, high))] if x[1] > low]

    for number, diagonal, _ in sorted(hits):
        if not regions or regions[-1][0] != number or diagonal - regions[-1][1] > params.band:
            regions.append((number, diagonal))
            ask(number, diagonal, max(0, diagonal - params.band), min(len(text), diagonal + len(sequences[number]) + 2 * params.band + 1))
    while todo:
        number, lost, s, e, diagonal, low, high = heapq.heappop(todo)
        near = within(taken[number], low, high)
        if not any(a < e and s < b for a, b in near):
            bisect.insort(taken[number], (s, e))
            bisect.insort(near, (s, e))
            yield names[number], -lost, -lost / len(sequences[number]), s, e
        # The parts of the segment that no match holds.
        at = low
        for a, b in near:
            ask(number, diagonal, at, a)
            at = max(at, b)
        ask(number, diagonal, at, high)
