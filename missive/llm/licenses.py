"""License scans by conditional compression.

Every line of every text is compressed plainly and with all license templates together as a raw zstandard dictionary (long lines in
overlapping windows). Lines that the dictionary makes smaller by more than chance seed candidate blocks (seeds at most
three lines apart join). A block that is not wholly
made of complete notices is taken again with the lines of its paragraph around it, as far as the longest template
reaches. It is compressed plainly and with each license template as a raw zstandard dictionary, and the templates are ranked by
what they take off. In this order they are held against it word by word: the template is aligned where most of its word
triples lie, and a license is confirmed if enough of its words are there and none of its distinguishing words differs (list
markers at line starts are not counted as added). The first that holds is taken, and what is left before and after it is
ranked and searched again. Long blocks are searched part by part. The words missing and added are reported.

Defined cases: a null or empty text has no blocks; a block that no template fits is reported with a null license, and a
confirmed license with the lines of its words; equal ones go to the template of the smaller name; repeated rows are scanned each; an empty table gives no rows;
other columns are not needed; a line with carriage returns is a line.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, ship

#: Well-known notices and the openings of license texts.
TEMPLATES = {
    "All-rights-reserved": "All rights reserved.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-warranty": 'This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-full": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Proprietary": "All rights reserved. No part of this work may be reproduced without the prior written permission of the publisher.",
    "Unlicense": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.',
}
#: The end of both texts of the BSD family.
BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
for _name in ("BSD-2-Clause", "BSD-3-Clause"):
    TEMPLATES[f"{_name}-full"] = f"{TEMPLATES[_name]} {BSD_END}"
#: Names in one-line identifiers, and wordings that name a license in a line.
IDENTIFIERS = ("AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-3.0-only", "MIT", "MPL-2.0", "Unlicense")
for _name in IDENTIFIERS:
    TEMPLATES[f"SPDX-{_name}"] = f"SPDX-License-Identifier: {_name}"
TEMPLATES |= {"MIT-licensed": "Licensed under the MIT license.", "BSD-licensed": "Licensed under the BSD license.", "GPL-3.0-licensed": "Licensed under the GPL, version 3.", "GPL-2.0-licensed": "Licensed under the GPL, version 2."}
#: A line is a seed if the templates save so many bytes of it, and this share of its compressed size on top.
SAVED, BY_CHANCE = 8, 0.12
#: Lines of more characters are cut into windows of about that, each with some of the one before.
WINDOW, OVERLAP = 240, 60
_WORDS = re.compile(r"[a-z]+|\d+(?:\.\d+)*")
_PLACED = re.compile(r"[a-zA-Z]+|\d+(?:\.\d+)*")
_MARKER = re.compile(r"^[^\w\n(]*\(?(\d{1,2}|[a-zA-Z]|[ivx]{1,4})[.)](?=\s)", re.M)
GAP = 3
#: Words whose absence or presence changes the license.
TELLING = frozenset("no not non nc nd sa by lesser affero mit apache bsd gnu gpl lgpl mpl mozilla cc without prior".split())


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text.lower())


def blocks_of(text: str, seed: Callable[[str], bool]) -> list[tuple[int, int]]:
    """(start, end) of the candidate blocks."""
    out: list[list[int]] = []
    at, last = 0, -GAP - 1
    for i, line in enumerate(text.split("\n")):
        if len(line) >= SAVED and seed(line):
            if out and i - last <= GAP:
                out[-1][1] = at + len(line)
            else:
                out.append([at, at + len(line)])
            last = i
        at += len(line) + 1
    return [(a, b) for a, b in out]


def extended(text: str, spans: list[tuple[int, int]], reach: int) -> list[tuple[int, int]]:
    """The blocks with the lines of their paragraphs before and after, as far as reach words, but not into other blocks."""
    out = []
    for k, (a, b) in enumerate(spans):
        least, most = spans[k - 1][1] + 1 if k else 0, spans[k + 1][0] - 1 if k + 1 < len(spans) else len(text)
        left = reach
        while a > least and left > 0:
            start = max(least, text.rfind("\n", 0, a - 1) + 1)
            if not (line := text[start : a - 1]).strip():
                break
            a, left = start, left - len(_PLACED.findall(line))
        left = reach
        while b < most and left > 0:
            end = text.find("\n", b + 1, most)
            end = most if end < 0 else end
            if not (line := text[b + 1 : end]).strip():
                break
            b, left = end, left - len(_PLACED.findall(line))
        out.append((a, b))
    return out


def aligned(template: list[str], block: list[str], loose: int = 0) -> tuple[list[str], list[int], int, int]:
    """The template's words that the block lacks where it matches best, the places of words between others there, and where the match begins and ends."""
    votes: Counter = Counter()
    for n in (3, 1):  # single words where no triple is left
        places: dict[tuple, list[int]] = {}
        for i in range(len(template) - n + 1):
            places.setdefault(tuple(template[i : i + n]), []).append(i)
        votes = votes or Counter(j - i for j in range(len(block) - n + 1) for i in places.get(tuple(block[j : j + n]), ()))
    if not votes:
        return template, [], 0, 0
    start = min(votes, key=lambda s: (-votes[s], s))
    low = max(0, start - 5 - loose)
    part = block[low : max(0, start) + len(template) + 5 + loose]
    missing, added = [], []
    ops = SequenceMatcher(None, template, part, autojunk=False).get_opcodes()
    inside = [k for k, op in enumerate(ops) if op[0] == "equal"]
    for k, (kind, a, b, c, d) in enumerate(ops):
        if kind != "equal":
            missing += template[a:b]
            if inside and inside[0] < k < inside[-1]:
                added += range(low + c, low + d)
    return missing, added, low + ops[inside[0]][3] if inside else 0, low + ops[inside[-1]][4] if inside else 0


def differences(template: list[str], block: list[str]) -> tuple[list[str], list[str]]:
    """The template's words that the block lacks where it matches best, and the words that stand between others there."""
    missing, added, _, _ = aligned(template, block)
    return missing, [block[i] for i in added]


#: start and end in the block, license, reduction, missing and added words.
Found = tuple[int, int, str | None, float, list[str], list[str]]


class Scanner:
    def __init__(self, templates: dict[str, str], level: int, least: float):
        self.plain = zstandard.ZstdCompressor(level=level, write_content_size=False)
        self.least, self.seeds, self.parts = least, {}, {}
        together = zstandard.ZstdCompressionDict("\n".join(text for _, text in sorted(templates.items())).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        together.precompute_compress(level=level)
        self.together = zstandard.ZstdCompressor(level=level, write_content_size=False, write_dict_id=False, dict_data=together)
        self.by = {}
        for name, text in sorted(templates.items()):
            with_it = zstandard.ZstdCompressor(level=level, write_content_size=False, write_dict_id=False, dict_data=zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            self.by[name] = (with_it, words_of(text))
        self.reach = max((len(t) for _, t in self.by.values()), default=0)

    def seed(self, line: str) -> bool:
        """Whether the templates make the line, or a window of it, smaller by more than chance."""
        found = self.seeds.get(line)
        if found is None:
            found = any(self._saves(line[a : a + WINDOW]) for a in range(0, max(1, len(line) - OVERLAP), WINDOW - OVERLAP))
            if len(line) < 200:
                if len(self.seeds) > 50_000:
                    self.seeds.clear()
                self.seeds[line] = found
        return found

    def _saves(self, part: str) -> bool:
        data = part.encode("utf-8", "surrogatepass")
        size = len(self.plain.compress(data))
        return size - len(self.together.compress(data)) >= SAVED + BY_CHANCE * size

    def ranked(self, part: str) -> list[tuple[str, float]]:
        """All templates with the share they take off a part's compressed size, the greatest first and equal ones by name."""
        data = part.encode("utf-8", "surrogatepass")
        size = len(self.plain.compress(data))
        rank = sorted((-(size - len(c.compress(data))) / size, name) for name, (c, _) in self.by.items())
        return [(name, -minus) for minus, name in rank]

    def _confirmed(self, text: str, words: list[str], markers: tuple[int, ...]) -> tuple | None:
        """Begin, end, license, reduction, missing and added words of the first template in the order of reduction whose wording holds."""
        key = (text, markers)
        if key not in self.parts:
            if len(self.parts) >= 5_000:
                self.parts.clear()
            self.parts[key] = self._first(text, words, set(markers))
        return self.parts[key]

    def _first(self, text: str, words: list[str], markers: set[int]) -> tuple | None:
        there = Counter(words)
        for name, reduction in self.ranked(text):
            template = self.by[name][1]
            if sum((Counter(template) - there).values()) > (1 - self.least) * len(template) + 1e-9:
                continue
            missing, added, a, b = aligned(template, words, len(markers))
            added = [words[i] for i in added if i not in markers]
            changed = [w for w in missing + added if w in TELLING or w[0].isdigit()]
            if 1 - len(missing) / max(1, len(template)) >= self.least and not changed and a < b:
                return a, b, name, reduction, missing, added
        return None

    def scan(self, block: str) -> list[Found]:
        """The confirmed licenses, in their order; one with a null license if there is none.

        Parts of at most twice the longest template are searched; what is found in the first half of one has all its words in it. What is left before
        and after a find goes on a list of parts, so work grows with the block, however many notices it has.
        """
        placed = list(_PLACED.finditer(block))
        words = [m[0].lower() for m in placed]
        at = {m.start(1) for m in _MARKER.finditer(block)}
        markers = [i for i, m in enumerate(placed) if m.start() in at]
        out: list[Found] = []
        todo = [(0, len(words))]
        while todo:
            low, high = todo.pop()
            if low >= high:
                continue
            end = min(high, low + 2 * self.reach)
            marked = tuple(i - low for i in markers[bisect_left(markers, low) : bisect_left(markers, end)])
            found = self._confirmed(block[placed[low].start() : placed[end - 1].end()], words[low:end], marked)
            if found is None:
                if end < high:
                    todo.append((low + self.reach, high))
                continue
            a, b, *found = found
            a, b = low + a, low + b
            if a >= low + self.reach and end < high:  # it may go on beyond the part: again from its begin
                todo += [(a, high), (low, a)]
                continue
            start = block.rfind("\n", 0, placed[a].start()) + 1
            stop = block.find("\n", placed[b - 1].end())
            out.append((start, len(block) if stop < 0 else stop, *found))
            todo += [(b, high), (low, a)]
        if out:
            return sorted(out, key=lambda x: x[:3])
        rank = self.ranked(block)
        return [(0, len(block), None, rank[0][1] if rank else 0.0, [], [])]


def _whole(block: str, found: list[Found], seed: Callable[[str], bool]) -> bool:
    """Whether all lines with a seed belong to licenses without missing words."""
    if any(x[2] is None or x[4] for x in found):
        return False
    at, ends, reached = 0, [(x[0], x[1]) for x in found], 0
    for line in block.split("\n"):
        while reached < len(ends) and ends[reached][1] <= at:
            reached += 1
        inside = reached < len(ends) and ends[reached][0] <= at
        if len(line) >= SAVED and not inside and seed(line):
            return False
        at += len(line) + 1
    return True


def scan_licenses(docs: DataFrame, *, templates: dict[str, str] | None = None, level: int = 3, least: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start and length of each confirmed license, or of a candidate block without one (license is null), reduction, missing and added words."""
    ship(docs.sparkSession)
    forms = dict(TEMPLATES if templates is None else templates)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text <> ''")
    names = ["doc_id", "start", "length", "license", "reduction", "missing", "added"]

    def run(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, known = Scanner(forms, level, least), {}
        for record in records:
            cols: list[list] = [[] for _ in names[1:]]
            of = []
            for k, value in enumerate(record.column(1)):
                text = value.as_py()
                spans = blocks_of(text, scanner.seed)
                for (a, b), (wide_a, wide_b) in zip(spans, extended(text, spans, scanner.reach), strict=True):
                    block = text[a:b]
                    found = known.get(block)
                    if found is None:
                        found = scanner.scan(block)
                        found = (found, _whole(block, found, scanner.seed))
                        if len(block) < 500 and len(known) < 100_000:
                            known[block] = found
                    found, whole = found
                    if not whole and (wide_a, wide_b) != (a, b):
                        wide = scanner.scan(text[wide_a:wide_b])
                        if wide[0][2] is not None:
                            found, a = wide, wide_a
                    for start, end, *x in found:
                        of.append(k)
                        for c, y in zip(cols, (a + start, end - start, x[0], x[1], " ".join(x[2]), " ".join(x[3])), strict=True):
                            c.append(y)
            types = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([record.column(0).take(pa.array(of, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, start long, length long, license string, reduction double, missing string, added string")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))
