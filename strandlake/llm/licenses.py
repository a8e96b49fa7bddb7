"""License scans: MinHash bands over overlapping windows, then exact shingle containment.

Words are lower-cased, with ASCII punctuation as blanks. A template of m words belongs to the least
scale L >= m; texts are cut into windows of L + L/4 words, every L/4 words, so a copy of the template lies whole
in some window and has at least a third of that window's five-word shingles. With BANDS bands of one
row the chance of a common MinHash value is then over 0.9999. A band's value comes from
one shingle, so windows without any template shingle that attains a band's minimum need no
signature: they cannot collide. Retrieved pairs are verified by the exact share of the
template's shingles in the window.

Defined results: null and empty texts match nothing; documents that match nothing give no row; repeated
rows give repeated results; null doc_id is kept; a text of any length is one chunk; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy
from .words import Chunk, chunks, find_words, mix, window_hashes, word_hashes

SHINGLE, BANDS = 5, 32
MAX_TEMPLATES = 10_000
SCALES = (5, 7, 10, 14, 20, 28, 40, 56, 80, 112, 160, 224, 320, 448, 640, 896, 1280, 1792, 2560)

#: Notices and license texts to look for, by identifier.
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "MIT-notice": "Released under the MIT License",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "LGPL-3.0-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
}

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 32


def plain_chunks(column: pa.Array) -> Iterator[Chunk]:
    """Chunks of the column with case and punctuation levelled; byte places stay."""
    for c in chunks(column):
        data = _PLAIN[c.data]
        starts, ends = find_words(data, c.offsets)
        yield Chunk(c.first, c.n, data, starts, ends, np.searchsorted(c.offsets, starts, "right") - 1, np.searchsorted(starts, c.offsets, "left"), c.offsets)


class Index:
    """Band tables of the templates, by scale."""

    def __init__(self, templates: dict[str, str]):
        self.names, self.shingles, self.bands = sorted(templates), [], {}
        self.scale = []
        for t, name in enumerate(self.names):
            c = next(plain_chunks(pa.array([templates[name]])))
            h = window_hashes(word_hashes(c.data, c.starts, c.ends), SHINGLE)
            if not len(h):
                raise ValueError(f"template {name} has under {SHINGLE} words")
            self.shingles.append(np.unique(h))
            self.scale.append(next((s for s in SCALES if s >= len(c.starts)), len(c.starts)))
            for band, value in enumerate(signature(h[None, :])[0].tolist()):
                self.bands.setdefault((self.scale[-1], band, value), []).append(t)
        attaining = [h[permuted(h).argmin(1)] for h in self.shingles]
        self.attaining = np.unique(np.concatenate(attaining)) if attaining else np.zeros(0, np.uint64)
        self.table = np.zeros(1 << 16, bool)
        self.table[(self.attaining >> np.uint64(48)).astype(np.int64)] = True


_SEEDS = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def permuted(h: np.ndarray) -> np.ndarray:
    """bands x shingles: each shingle's value under each band's hash."""
    return mix(h[None, :] ^ _SEEDS[:, None])


def signature(h: np.ndarray) -> np.ndarray:
    """windows x bands: MinHash values of windows x shingles."""
    return np.stack([mix(h ^ s).min(1) for s in _SEEDS], 1)


def scan(docs: DataFrame, templates: dict[str, str] | DataFrame | None = None, min_containment: float = 0.8) -> DataFrame:
    """doc_id, license, containment (best), places (matches that do not overlap), first_char of the first.

    The templates, by identifier or as a table (license, text), are a catalogue of the caller's choice, with five words
    or more each; MAX_TEMPLATES of them at most, as their tables go to every task."""
    if isinstance(templates, DataFrame):
        templates = {r["license"]: r["text"] for r in templates.select("license", "text").limit(MAX_TEMPLATES + 1).collect()}
    if templates and len(templates) > MAX_TEMPLATES:
        raise ValueError(f"over {MAX_TEMPLATES} templates")
    shared = docs.sparkSession.sparkContext.broadcast(Index(templates or TEMPLATES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            rows = []
            for c in plain_chunks(batch.column(1)):
                rows += _matches(c, index, min_containment)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64())],
                names=["doc_id", "license", "containment", "places", "first_char"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, license string, containment double, places long, first_char long")


def _matches(c: Chunk, index: Index, least: float) -> list[tuple]:
    h = window_hashes(word_hashes(c.data, c.starts, c.ends), SHINGLE)
    inside = c.doc[: len(h)] == c.doc[SHINGLE - 1 :] if len(h) else np.zeros(0, bool)
    maybe = np.flatnonzero(index.table[(h >> np.uint64(48)).astype(np.int64)] & inside)
    hits = maybe[np.isin(h[maybe], index.attaining)]
    found: dict[tuple[int, int], list[tuple[int, int, float]]] = {}
    for scale in sorted(set(index.scale)):
        step = max(1, scale // 4)
        begin = c.word_from[c.doc[hits]]
        end = c.word_from[c.doc[hits] + 1]
        place = hits - begin
        windows = set()
        for back in range((scale + step) // step + 1):  # every window that holds the hit's shingle
            w = (place // step - back) * step
            fits = (w >= 0) & (place + SHINGLE <= w + scale + step)
            windows.update(zip((begin + w)[fits].tolist(), np.minimum(begin + w + scale + step, end)[fits].tolist()))
        for a, b in windows:
            s = h[a : b - SHINGLE + 1]
            met: set[int] = set()
            for band, value in enumerate(signature(s[None, :])[0].tolist()):
                met.update(index.bands.get((scale, band, value), ()))
            for t in met:
                held = np.isin(index.shingles[t], s)
                if held.mean() >= least:
                    at = a + int(np.isin(s, index.shingles[t]).argmax())
                    found.setdefault((int(c.doc[a]), t), []).append((at, b, float(held.mean())))
    out = []
    for (doc, t), spans in sorted(found.items()):
        spans.sort()
        places, reach = 0, -1
        for at, b, _ in spans:
            places += at >= reach
            reach = max(reach, at + index.scale[t] // 2)
        first = spans[0][0]
        chars = int(((c.data[c.offsets[doc] : c.starts[first]] & 0xC0) != 0x80).sum())  # bytes that begin one
        out.append((c.first + doc, index.names[t], max(x[2] for x in spans), places, chars))
    return out

