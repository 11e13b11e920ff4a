"""License scans by conditional compression.

Every word of every text is read. A wording of which the share LIKENESS stands in a text in order, with as few words put in, leaves there a
number of its runs of RUN words unbroken, so the places where a text and a template share so many are all that need to be looked at; which words
these are follows from the templates alone. Each place says where the wording would begin and end, by words, wherever lines and sentences end. The block of words that lies
there is compressed alone and with each template as the compressor's raw dictionary; of the templates by falling reduction of size, all that save
LEAST_GAIN at least are confirmed by the exact differences between the words of block and template. The share of the template's words
that the block holds in order is its likeness; words besides may be no more than may be missing. Of findings that overlap the one with most words in common stands.

Reported are the template, the lines of its first and last word, gain, likeness, and the words that lack or are besides. Templates are a parameter.

Edge cases: a null or empty text has no finding; a text can have several, in order of place; equal findings go to the alphabetically first
template; repeated rows are scanned each; a text of any length is scanned whole, its blocks are as long as a template.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIKENESS, LEAST_GAIN, RUN = 0.9, 0.3, 3

#: Wordings of public licenses and of notices that name them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-2-Clause-full": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-notice": "Licensed under the BSD License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-4.0-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Released into the public domain under CC0 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "ISC-full": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-full": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MIT-long": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "proprietary": "Copyright. All rights reserved.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}
_WORD = re.compile(r"[a-z0-9][a-z0-9.+-]*[a-z0-9]|[a-z0-9]")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Scanner:
    """Templates, their runs of RUN words, and what is known of blocks; one per worker."""

    def __init__(self, templates: dict[str, str]):
        self.alone = zstandard.ZstdCompressor(level=3)
        self.templates = []
        for name in sorted(templates):
            plain = " ".join(words(templates[name]))
            raw = zstandard.ZstdCompressionDict(plain.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.templates.append((name, plain.split(), zstandard.ZstdCompressor(level=3, dict_data=raw)))
        if any(len(wording) < RUN for _, wording, _ in self.templates):
            raise ValueError(f"a template needs {RUN} words")
        self.number = {w: i for i, w in enumerate(sorted({w for _, wording, _ in self.templates for w in wording}))}
        self.places: dict[int, list[tuple[int, int]]] = {}  # (template, place in it) of each run
        for t, (_, wording, _) in enumerate(self.templates):
            for at, code in enumerate(self._runs(np.array([self.number[w] for w in wording])).tolist()):
                self.places.setdefault(code, []).append((t, at))
        self.runs = np.array(sorted(self.places))
        self.known: dict[str, list[tuple]] = {}

    def _runs(self, numbers: np.ndarray) -> np.ndarray:
        code, base = numbers[: len(numbers) - RUN + 1].astype(np.int64), len(self.number)
        for i in range(1, RUN):
            code = code * base + numbers[i : len(numbers) - RUN + 1 + i]
        return code

    def confirmed(self, block: list[str]) -> list[tuple]:
        """(words in common, template, gain, likeness, missing words, words besides, first and last place of what is in common) of the templates that a block holds."""
        text = " ".join(block)
        if text in self.known:
            return self.known[text]
        data = text.encode()
        size = len(self.alone.compress(data))
        found = []
        for less, i in sorted((-(size - len(t[2].compress(data))) / size, i) for i, t in enumerate(self.templates)):
            if -less < LEAST_GAIN:
                break
            name, wording, _ = self.templates[i]
            same = [m for m in SequenceMatcher(None, wording, block, autojunk=False).get_matching_blocks() if m.size]
            held = sum(m.size for m in same)
            if held < LIKENESS * len(wording):
                continue
            low, high = same[0].b, same[-1].b + same[-1].size
            missing = [w for a, b in zip([0, *(m.a + m.size for m in same)], [*(m.a for m in same), len(wording)]) for w in wording[a:b]]
            besides = [w for a, b in zip((m.b + m.size for m in same), [m.b for m in same][1:]) for w in block[a:b]]
            if len(besides) <= (1 - LIKENESS) * len(wording):
                found.append((held, name, -less, held / len(wording), " ".join(missing), " ".join(besides), low, high))
        if len(self.known) < 50_000:
            self.known[text] = found
        return found

    def scan(self, text: str | None) -> list[tuple]:
        """(first line, last line, template, gain, likeness, missing, besides), lines counted from 0."""
        if not text:
            return []
        low = text.lower()
        own = _WORD.findall(low)
        if len(own) < RUN:
            return []
        get = self.number.get
        numbers = np.fromiter((get(w, -1) for w in own), np.int64, len(own))
        inside = numbers >= 0
        all_ = inside[: len(own) - RUN + 1].copy()
        for i in range(1, RUN):
            all_ &= inside[i : len(own) - RUN + 1 + i]
        at = np.flatnonzero(all_)
        if not len(at):
            return []
        codes = self._runs(numbers)[at]
        hit = self.runs[np.minimum(np.searchsorted(self.runs, codes), len(self.runs) - 1)] == codes
        begins: dict[int, list[int]] = {}
        for place, code in zip(at[hit].tolist(), codes[hit].tolist()):
            for t, k in self.places[code]:
                begins.setdefault(t, []).append(place - k)
        found, tried = set(), set()
        for t, starts in begins.items():
            n = len(self.templates[t][1])
            slack = int((1 - LIKENESS) * n + 1e-9)
            # a word left out breaks RUN runs at most, words put in at one place RUN - 1: so many stay, and their begins move by so much
            need = max(1, n - RUN + 1 - RUN * slack - (RUN - 1) * slack)
            starts.sort()
            for i, start in enumerate(starts):
                near = starts[i : bisect_right(starts, start + 2 * slack, i)]
                if len(near) < need:
                    continue
                ends = sorted(set(near))
                for first, last in {(a, b + n) for a in ends for b in ends} | {(ends[0] - slack, ends[-1] + n + slack)}:
                    span = max(0, first), min(len(own), last)
                    if span[0] < span[1] and span not in tried:
                        tried.add(span)
                        for held, name, gain, likeness, missing, besides, a, b in self.confirmed(own[span[0] : span[1]]):
                            found.add((-held, -likeness, name, span[0] + a, span[0] + b, gain, missing, besides))
        if not found:
            return []
        line, begun, ended, out = None, [], [], []
        for held, less, name, a, b, gain, missing, besides in sorted(found):
            at = bisect_right(begun, a)  # taken places lie apart, in order
            if (at and ended[at - 1] > a) or (at < len(begun) and begun[at] < b):
                continue
            begun.insert(at, a)
            ended.insert(at, b)
            if line is None:
                places = np.fromiter((m.start() for m in _WORD.finditer(low)), np.int64, len(own))
                line = np.searchsorted(np.flatnonzero(np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4") == 10), places)
            out.append((int(line[a]), int(line[b - 1]), name, gain, -less, missing, besides, a))
        return [x[:-1] for x in sorted(out, key=lambda x: x[-1])]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per finding: (doc_id, first_line, last_line, license, gain, likeness, missing, besides)."""
    templates = templates or TEMPLATES
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text"))
    fields = "first_line int, last_line int, license string, gain double, likeness double, missing string, besides string"
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(templates)
        for batch in batches:
            found = [(d, *x) for d, t in zip(batch["doc_id"].astype(object), batch["text"]) for x in scanner.scan(t)]
            frame = pd.DataFrame(found, columns=["doc_id", "first_line", "last_line", "license", "gain", "likeness", "missing", "besides"])
            yield frame.astype({"doc_id": object if batch["doc_id"].hasnans else batch["doc_id"].dtype})

    return rows.mapInPandas(run, f"doc_id {kind}, {fields}")
