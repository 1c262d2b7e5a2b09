"""License scan: MinHash bands over overlapping text windows, then exact shingle containment.

Texts and templates are lower-cased; every ASCII character that is neither a
letter nor a digit parts words, and so do the marks, signs and spaces of Unicode.  A template of n words has the shingles of
min(5, n) words.  Its windows of ``W`` shingles (the largest of ``WIDTHS`` that
fits) are sketched by ``bands * rows`` MinHash values, and so is every window of
as many shingles of a text, at every position: values over a window come from
those over its halves.  A text window that agrees with a template window in a
band retrieves the template.  A window of Jaccard similarity s is retrieved with
probability 1 - (1 - s**rows)**bands (:func:`collision_probability`): 1 for an
exact one, over 0.99 at s = 2/3, to which a window falls that keeps 0.8 of its
shingles.  Retrieved templates are verified in the words around: the share of
the template's shingles found there must reach ``least``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import modest_batches
from .words import WordHashes, grams
from .workers import kept

#: Notices and opening passages of public licenses.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-licensed": "Licensed under the MIT license.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "licensed under the GNU General Public License",
    "LGPL-notice": "licensed under the GNU Lesser General Public License",
    "BSD-notice": "Licensed under the BSD 3-Clause License.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "rights-reserved": "All rights reserved.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "EPL-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "MIT-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
SHINGLE = 5
WIDTHS = (1, 2, 4, 8, 16)
MATCH = "doc_id long, template string, start_char long, end_char long, containment double"
_TO_SPACES = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: In UTF-8: U+0080 to U+00BF but for its three letters, U+2000 to U+2BFF, the marks of U+3000 to U+3020, full-width marks, the byte order mark.
_MARKS = re.compile(rb"\xc2[\x80-\xa9\xab-\xb4\xb6-\xb9\xbb-\xbf]|\xe2[\x80-\xaf][\x80-\xbf]|\xe3\x80[\x80-\x84\x88-\xa0]|\xef\xbc[\x81-\x8f\x9a-\xa0\xbb-\xbf]|\xef\xbd[\x80\x9b-\xa5]|\xef\xbb\xbf")
_BITS = 18


@dataclass(frozen=True)
class Bands:
    bands: int = 8
    rows: int = 2
    least: float = 0.8
    seed: int = 11


def collision_probability(similarity: float, p: Bands = Bands()) -> float:
    return 1 - (1 - similarity**p.rows) ** p.bands


def plain(text: bytes) -> bytes:
    """Lower-case words of UTF-8 between spaces, each at its place in ``text``."""
    if not text.isascii():
        text = _MARKS.sub(lambda m: b" " * len(m[0]), text)
    return text.lower().translate(_TO_SPACES)


def plain_words(text: bytes) -> list[bytes]:
    return plain(text).split()


def read_templates(folder: str) -> dict[str, str]:
    """Further templates, such as whole license texts: the files of a folder of the driver's, by name."""
    return {p.stem: p.read_text("utf-8", "replace") for p in sorted(Path(folder).iterdir()) if p.is_file()}


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """Minima over all windows of ``width`` (a power of two) along the last axis."""
    step = 1
    while step < width:
        h = np.minimum(h[:, :-step], h[:, step:])
        step *= 2
    return h


class Library:
    """The templates' windows, by shingle length and width, and their shingle sets."""

    def __init__(self, templates: dict[str, str], p: Bands):
        self.p, self.known = p, WordHashes(100_000)
        rng = np.random.default_rng(p.seed)
        n = p.bands * p.rows
        self.a = rng.integers(0, 1 << 32, n, dtype=np.uint32)[:, None] | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, n, dtype=np.uint32)[:, None]
        self.names = list(templates)
        self.sets: list[np.ndarray] = []
        self.lengths: list[int] = []
        self.tables: dict[tuple[int, int], dict[int, list[tuple[int, int]]]] = {}
        for t, text in enumerate(templates.values()):
            words = self.known.of(plain_words(text.encode()))
            k = min(SHINGLE, len(words))
            g = grams(words, k)
            self.sets.append(np.unique(g))
            self.lengths.append(len(words))
            width = max(w for w in WIDTHS if w <= len(g))
            table = self.tables.setdefault((k, width), {})
            for band in self.band_keys(self.minhashes(g), width):
                for at, key in enumerate(band.tolist()):
                    table.setdefault(key, []).append((t, at))
        self.filters = {}
        for shape, table in self.tables.items():
            bits = np.zeros(1 << _BITS, bool)
            bits[np.fromiter(table, np.uint64, len(table)) >> np.uint64(64 - _BITS)] = True
            self.filters[shape] = bits

    def minhashes(self, g: np.ndarray) -> np.ndarray:
        return (g >> np.uint64(32)).astype(np.uint32)[None, :] * self.a + self.b

    def band_keys(self, h: np.ndarray, width: int) -> Iterator[np.ndarray]:
        low = window_minima(h, width)
        for b in range(self.p.bands):
            key = np.full(low.shape[1], b + 1, np.uint64)
            for r in range(self.p.rows):
                key = key * np.uint64(0x9E3779B97F4A7C15) + low[b * self.p.rows + r]
            yield key * np.uint64(0xD6E8FEB86659FD93)

    def retrieved(self, by_length: dict[int, np.ndarray]) -> set[tuple[int, int]]:
        """(template, word where it would start) of all agreeing windows."""
        found: set[tuple[int, int]] = set()
        sketched: dict[int, np.ndarray] = {}
        for (k, width), table in self.tables.items():
            g = by_length[k]
            if len(g) < width:
                continue
            if k not in sketched:
                sketched[k] = self.minhashes(g)
            bits = self.filters[k, width]
            for keys in self.band_keys(sketched[k], width):
                for i in np.flatnonzero(bits[keys >> np.uint64(64 - _BITS)]).tolist():
                    for t, at in table.get(int(keys[i]), ()):
                        found.add((t, i - at))
        return found

    def matches(self, words: list[bytes]) -> list[tuple[int, int, int, float]]:
        """(template, first word, end word, containment), one for each stretch of text, best first word first."""
        hashes = self.known.of(words)
        by_length = {k: grams(hashes, k) for k, _ in self.tables}
        best: dict[int, list[tuple[int, int, float]]] = {}
        starts: list[tuple[int, int, int]] = []  # template, first and last of places that lie together
        for t, start in sorted(self.retrieved(by_length)):
            if starts and starts[-1][0] == t and start - starts[-1][1] <= self.lengths[t] // 4 + 2:
                starts[-1] = (t, starts[-1][1], start)
            else:
                starts.append((t, start, start))
        for t, start, end in starts:
            n = self.lengths[t]
            k, slack = min(SHINGLE, n), n // 4 + 2
            lo = max(0, start - slack)
            region = by_length[k][lo : max(0, end + n + slack)]
            inside = np.isin(region, self.sets[t])
            share = len(np.unique(region[inside])) / len(self.sets[t])
            if share < self.p.least:
                continue
            at = np.flatnonzero(inside)
            got = (lo + int(at[0]), lo + int(at[-1]) + k, share)
            spans = best.setdefault(t, [])
            if spans and got[0] < spans[-1][1]:
                if share > spans[-1][2]:
                    spans[-1] = got
            else:
                spans.append(got)
        return [(t, *span) for t in sorted(best) for span in best[t]]


def library(templates: tuple[tuple[str, str], ...], p: Bands) -> Library:
    return kept(("licenses", templates, p), lambda: Library(dict(templates), p))


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, p: Bands = Bands()) -> DataFrame:
    """Verified templates of every text with their place; texts without one, or null, give no row."""
    shipped = tuple((templates or TEMPLATES).items())
    modest_batches(docs.sparkSession)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = library(shipped, p)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if not text:
                    continue
                found = lib.matches(plain_words(text))
                if found:
                    spans = [m.span() for m in re.finditer(rb"[^ ]+", plain(text))]
                    for t, lo, hi, share in found:
                        start = len(text[: spans[lo][0]].decode())
                        rows.append((doc_id, lib.names[t], start, start + len(text[spans[lo][0] : spans[hi - 1][1]].decode()), share))
            if rows:
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in MATCH.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(scan, MATCH)
