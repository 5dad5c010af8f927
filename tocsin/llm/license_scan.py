"""License scans: winnowed fingerprints pick candidates, banded alignment measures them.

Text and templates are words of ASCII letters and digits (and bytes above 127),
lower-cased.  Every run of ``GRAM`` words is hashed; of every ``WINDOW`` hashes in
a row the least (the last, on ties) is a fingerprint, so any shared run of
``GRAM + WINDOW - 1`` words shares one.  Templates shorter than that keep all their
hashes, and texts are probed with all hashes of theirs.  An inverted index maps a
template's fingerprints to their places.

A text's hits are grouped by template and diagonal (place in the text less place
in the template) into regions; each region is aligned with the template word by
word within a band of ``BAND`` diagonals: match 1, otherwise 0, gaps free (a
longest common subsequence), which gives the words that the region covers.  A
region is reported if it covers at least ``MIN_COVERAGE`` of the template, unless
one of the same template that covers more overlaps it, or one of another template that
covers a larger share of that takes most of it (versions of a license differ by a word).

The templates are public license notices, given below or by the caller; the index
is made once and has the size of the templates, not of the data.

Defined cases: null or empty text, or one without words: no rows.  Repeated rows
give repeated matches; a null doc_id stays null.  Extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tocsin.llm.common import released, slices
from tocsin.llm.shingles import LOWER, PLACES, buffers, hashed_runs, mix

GRAM, WINDOW, BAND, MIN_COVERAGE = 3, 3, 12, 0.75
#: Public license notices.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "bsd-3-clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "bsl-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "lgpl-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "agpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "cc0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    "wtfpl": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}
PART = np.zeros(256, dtype=bool)
PART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word, word offsets of the texts, and the bytes with their offsets."""
    data, offsets = buffers(texts)
    inside = PART[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    first[heads] = inside[heads]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, starts, np.zeros(len(offsets), np.int64), data, offsets
    chars = LOWER[data[inside]]
    before = np.cumsum(inside, dtype=np.int64)[starts] - 1
    lengths = np.diff(np.append(before, len(chars)))
    return hashed_runs(chars, before), starts, starts + lengths, np.searchsorted(starts, offsets), data, offsets


def grams(words: np.ndarray) -> np.ndarray:
    """Hash of each run of GRAM words, whatever text they belong to; none if there are fewer."""
    n = max(0, len(words) - GRAM + 1)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(GRAM):
        total += words[k : k + n] * PLACES[k]
    return mix(total)


def winnow(hashes: np.ndarray) -> np.ndarray:
    """Places of the fingerprints: of each window the least hash, the last on ties; all if there is no whole window."""
    if len(hashes) < WINDOW:
        return np.arange(len(hashes))
    windows = np.lib.stride_tricks.sliding_window_view(hashes, WINDOW)
    return np.unique(np.arange(len(windows)) + WINDOW - 1 - windows[:, ::-1].argmin(axis=1))


class Index:
    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.words = []
        keys, owner, place = [], [], []
        for t, name in enumerate(self.names):
            words = word_hashes(pa.array([templates[name]], pa.string()))[0]
            self.words.append(words)
            hashes = grams(words)
            kept = winnow(hashes)
            keys.append(hashes[kept])
            owner.append(np.full(len(kept), t))
            place.append(kept)
        order = np.argsort(np.concatenate(keys), kind="stable")
        self.keys, self.owner, self.place = (np.concatenate(x)[order] for x in (keys, owner, place))
        self.screen = np.zeros(1 << 16, dtype=bool)
        self.screen[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def probe(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the text, template, place in the template) of every hit."""
        spots = np.flatnonzero(self.screen[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        low, high = np.searchsorted(self.keys, hashes[spots]), np.searchsorted(self.keys, hashes[spots], side="right")
        counts = high - low
        rows = np.repeat(low, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return np.repeat(spots, counts), self.owner[rows], self.place[rows]


def align(text: np.ndarray, template: np.ndarray, diagonal: int) -> tuple[int, int, int]:
    """(words matched, first and last matched place in the text) by the best alignment in a band around the diagonal."""
    n, width = len(template), 2 * BAND + 1
    score = np.zeros(width, dtype=np.int64)
    begin, end = np.full(width, -1), np.full(width, -1)
    for j in range(n):  # cell c stands for the text's place j + diagonal - BAND + c
        at = j + diagonal - BAND + np.arange(width)
        inside = (at >= 0) & (at < len(text))
        same = inside & (text[np.clip(at, 0, len(text) - 1)] == template[j])
        skip, skip_b, skip_e = np.append(score[1:], 0), np.append(begin[1:], -1), np.append(end[1:], -1)  # template word j unmatched: same text place
        new, nb, ne = score + same, np.where(same & (begin < 0), at, begin), np.where(same, at, end)
        better = skip > new
        new, nb, ne = np.where(better, skip, new), np.where(better, skip_b, nb), np.where(better, skip_e, ne)
        for c in range(1, width):  # text words passed over
            if new[c - 1] > new[c]:
                new[c], nb[c], ne[c] = new[c - 1], nb[c - 1], ne[c - 1]
        score, begin, end = new, nb, ne
    best = int(score.argmax())
    return int(score[best]), int(begin[best]), int(end[best])


def scan_text(index: Index, words: np.ndarray, hits: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(template, words matched, first word, last word) of one text; hits: (place, template, place in template) rows."""
    found = []
    for t in np.unique(hits[:, 1]):
        mine = hits[hits[:, 1] == t]
        template = index.words[t]
        regions: dict[int, int] = {}  # a diagonal for each strip of BAND // 2 of them
        for d in np.unique(mine[:, 0] - mine[:, 2]).tolist():
            strip = d // (BAND // 2)
            if all(abs(regions.get(k, d + BAND) - d) > BAND // 2 for k in (strip - 1, strip)):
                regions[strip] = d
        for d in regions.values():
            matched, begin, end = align(words, template, d)
            if matched >= MIN_COVERAGE * len(template):
                found.append((int(t), matched, begin, end))
    out: list[tuple[int, int, int, int]] = []
    share = lambda f: f[1] / len(index.words[f[0]])
    for f in sorted(found, key=lambda f: (-share(f), -f[1], f[2], f[0])):
        if not any(g[2] <= f[3] and f[2] <= g[3] and (g[0] == f[0] or share(g) > share(f) and 2 * (min(f[3], g[3]) - max(f[2], g[2]) + 1) > f[3] - f[2] + 1) for g in out):
            out.append(f)
    return sorted(out, key=lambda f: (f[2], f[0]))


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license, n_matched, coverage, and the span [start, end) in code points, of every match."""
    index = Index(templates or TEMPLATES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in slices(big, 2048):
                words, starts, ends, offsets, data, begins = word_hashes(batch["text"])
                place, template, spot = index.probe(grams(words))
                owner = np.searchsorted(offsets, place, side="right") - 1
                within = place + GRAM <= offsets[owner + 1]
                place, template, spot, owner = place[within], template[within], spot[within], owner[within]
                rows = []
                for d in np.unique(owner):
                    some = owner == d
                    hits = np.stack([place[some] - offsets[d], template[some], spot[some]], axis=1)
                    for t, matched, a, b in scan_text(index, words[offsets[d] : offsets[d + 1]], hits):
                        raw = data[begins[d] : begins[d + 1]]
                        lo, hi = starts[offsets[d] + a] - begins[d], ends[offsets[d] + b] - begins[d]
                        lead = (raw & 0xC0) != 0x80
                        rows.append((batch["doc_id"][int(d)].as_py(), index.names[t], matched, matched / len(index.words[t]), int(lead[:lo].sum()), int(lead[:hi].sum())))
                columns = list(zip(*rows, strict=True)) or [[]] * 6
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.record_batch([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["doc_id", "license", "n_matched", "coverage", "start", "end"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(released(run), "doc_id long, license string, n_matched long, coverage double, start long, end long")
