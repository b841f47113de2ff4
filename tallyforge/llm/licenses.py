"""License scans by conditional compression.

The words around a licence's cue words are candidate blocks, narrow ones for notices of up to SHORT words and wide ones for longer texts: cues
close to each other share a block, and one of over PIECE words is read in overlapping pieces. A block is compressed alone and with every template
as a zstandard raw dictionary; templates are ranked by the bytes they save, and each that saves any (of the long ones, a share of its own size) is
aligned with the block. A winner is confirmed by its exact wording: the words that differ within the stretch it covers, and none of its key words
may be among them. Of winners that overlap, that with the smallest share of differing words stays (ties: the longer one, the one that saves more, then by name).
Winners of one licence that follow each other as the parts of its notice do, NEXT words apart at most, are one occurrence. Tags (SPDX-License-Identifier) are notices too.
Null and empty texts have no blocks; texts are judged whole however long; each occurrence and each repeated row is reported; extra columns are ignored;
an empty table gives none.
"""

from __future__ import annotations

import bisect
import difflib
import re

from pyspark.sql import DataFrame

from tallyforge.llm.text import mapped

SHORT, PIECE, OVERLAP, LEAST_SAVED, NEXT = 40, 900, 450, 0.3, 15
#: Words before the first cue, after the last one, and between cues of one block.
NARROW, WIDE = (20, 40, 10), (40, 140, 120)
# fixed values: notices of public licences and, where they are short, their whole texts; words in [] name the licence and must be there as they are
NOTICES = {
    "Apache-2.0": ["Licensed under the [Apache] License, Version [2.0].", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://[www.apache.org]/licenses/[LICENSE-2.0]"],
    "MIT": [
        "Released under the [MIT] License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction,"
        " including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,"
        " subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
        " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
        " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "GPL-3.0": ["This work is licensed under the [GNU] [General] Public License, version [3].", "either version [3] of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"],
    "GPL-2.0": ["This work is licensed under the [GNU] [General] Public License, version [2].", "either version [2] of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"],
    "LGPL-3.0": ["This work is licensed under the GNU [Lesser] General Public License, version [3]."],
    "AGPL-3.0": ["This work is licensed under the GNU [Affero] General Public License, version [3]."],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice,"
        " this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials"
        " provided with the distribution. 3. [Neither] the name of the copyright holder nor the names of its contributors may be used to [endorse] or promote products derived from this software without specific prior written permission.",
    ],
    "BSD-2-Clause": [
        "Released under the [BSD-2-Clause] License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice,"
        " this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials"
        " provided with the distribution. THIS SOFTWARE IS PROVIDED",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose"],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the [Mozilla] Public License, v. [2.0]. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "This Source Code Form is subject to the terms of the [Mozilla] Public License, v. [2.0]."],
    "CC-BY-4.0": ["Licensed under CC [BY] [4.0].", "This work is licensed under a Creative Commons [Attribution] [4.0] International License."],
    "CC-BY-SA-4.0": ["Licensed under CC [BY-SA] [4.0].", "This work is licensed under a Creative Commons [Attribution-ShareAlike] [4.0] International License."],
    "CC-BY-NC-4.0": ["Licensed under CC [BY-NC] [4.0].", "This work is licensed under a Creative Commons [Attribution-NonCommercial] [4.0] International License."],
    "CC0-1.0": ["To the extent possible under law, the author has [waived] all copyright and related or neighboring rights to this work."],
}
_FREE = "This program is free software: you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation, either version [{}] of the License, or (at your option) any later version."
for _name, _title, _version in (("GPL-3.0", "GNU [General] Public License", 3), ("GPL-2.0", "GNU [General] Public License", 2), ("LGPL-3.0", "GNU [Lesser] General Public License", 3), ("AGPL-3.0", "GNU [Affero] General Public License", 3)):
    NOTICES[_name].append(_FREE.format(_title, _version))
#: The forms of a licence's name in tags.
TAGS = {k: [k, f"{k}-only", f"{k}-or-later"] if "GPL" in k else [k] for k in NOTICES}
CUE = re.compile(r"(?i)licen[sc]e|redistribution and use|copyright|permission is|permission to use|public domain|source code form|as-is")
_WORD = re.compile(r"[\w.-]*\w")


class Template:
    def __init__(self, name: str, part: int, notice: str, zstandard):
        self.part = part
        text = re.sub(r"\[([\w.-]+)\]", r"\1", notice)
        self.name, self.words = name, _WORD.findall(text.lower())
        self.key = set(_WORD.findall(" ".join(re.findall(r"\[([\w.-]+)\]", notice)).lower()))
        raw = " ".join(self.words).encode()
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=19)
        self.compress = zstandard.ZstdCompressor(dict_data=d, write_content_size=False).compress
        self.size = len(zstandard.ZstdCompressor(level=19, write_content_size=False).compress(raw))

    def align(self, own: list[str]) -> tuple[int, int, int] | None:
        """(first word, end, differing words) of the stretch of the block that the template covers best; None if a key word differs."""
        m = [b for b in difflib.SequenceMatcher(None, self.words, own, autojunk=False).get_matching_blocks() if b.size]
        # a stray match far from the rest isn't part of the stretch
        best: tuple[int, int, int] | None = None
        for i in range(len(m)):
            inner = 0
            for j in range(i, len(m)):
                if j > i:  # words of the template that aren't matched, or words in between that aren't the template's, whichever are more
                    inner += max(m[j].a - m[j - 1].a - m[j - 1].size, m[j].b - m[j - 1].b - m[j - 1].size)
                differ = m[i].a + inner + len(self.words) - m[j].a - m[j].size
                if best is None or differ < best[2]:
                    best = (m[i].b, m[j].b + m[j].size, differ)
        if best is None or not self.key <= set(own[best[0] : best[1]]):
            return None
        return best


def scan(own: list[str], templates: list[Template], plain, max_differ: float) -> list[tuple]:
    """(share of differing words, -words, -bytes saved, licence, first word, end, differing words, part of its notice) of what fits a block."""
    raw = " ".join(own).encode("utf-8", "surrogatepass")
    alone = len(plain.compress(raw))
    ranked = sorted(((alone - len(t.compress(raw)), t) for t in templates), key=lambda x: (-x[0], x[1].name))
    found = []
    for saved, t in ranked:
        if saved > (0 if len(t.words) <= SHORT else LEAST_SAVED * t.size):
            rest = list(own)
            while at := t.align(rest):
                if at[2] > max_differ * len(t.words):
                    break
                found.append((at[2] / len(t.words), -len(t.words), -saved, t.name, *at, t.part))
                rest[at[0] : at[1]] = [""] * (at[1] - at[0])  # its next occurrence
    return found


def winners(found: list[tuple]) -> list[tuple]:
    """Those that overlap none that fits better, in order."""
    starts: list[int] = []
    out: list[tuple] = []
    for x in sorted(set(found)):
        k = bisect.bisect(starts, x[4])
        if (k == 0 or out[k - 1][5] <= x[4]) and (k == len(out) or x[5] <= out[k][4]):
            starts.insert(k, x[4])
            out.insert(k, x)
    return out


def whole(parts: list[tuple]) -> list[tuple]:
    """Winners in order, with those that are further parts of the same notice joined to the one before."""
    out: list[tuple] = []
    for x in parts:
        last = out[-1] if out else None
        if last and last[3] == x[3] and 0 <= last[7] < x[7] and 0 <= x[4] - last[5] <= NEXT:
            out[-1] = (last[0], last[1] + x[1], last[2] + x[2], x[3], last[4], x[5], last[6] + x[6], x[7])
        else:
            out.append(x)
    return out


def pieces(cues: list[int], n: int, before: int, after: int, gap: int) -> list[tuple[int, int]]:
    """Word ranges of the candidate blocks."""
    out = []
    k = 0
    while k < len(cues):
        first = last = cues[k]
        while k < len(cues) and cues[k] - last <= gap:
            last = cues[k]
            k += 1
        lo, hi = max(0, first - before), min(n, last + after)
        while hi - lo > PIECE:
            out.append((lo, lo + PIECE))
            lo += PIECE - OVERLAP
        out.append((lo, hi))
    return out


def find(docs: DataFrame, max_differ: float = 0.2) -> DataFrame:
    """doc_id, line (from 0, where it begins), license, saved (bytes), differing, exact; differing words are max_differ of the template's at most."""

    def make():
        import zstandard

        templates = [Template(k, n, v, zstandard) for k, vs in NOTICES.items() for n, v in enumerate(vs)]
        # a tag is a notice by itself
        templates += [Template(k, -1, f"SPDX-License-Identifier: [{tag}]", zstandard) for k, tags in TAGS.items() for tag in tags]
        plain = zstandard.ZstdCompressor(level=19, write_content_size=False)
        scales = [(NARROW, [t for t in templates if len(t.words) <= SHORT]), (WIDE, [t for t in templates if len(t.words) > SHORT])]

        def work(texts):
            index, rows = [], []
            for d, t in enumerate(texts):
                if not t or not CUE.search(t):
                    continue
                spans = [m.span() for m in _WORD.finditer(t)]
                starts = [a for a, _ in spans]
                own = [t[a:b].lower() for a, b in spans]
                cues, k = [], 0
                for m in CUE.finditer(t):
                    while k + 1 < len(starts) and starts[k + 1] <= m.start():
                        k += 1
                    cues.append(k)
                found = []
                for around, some in scales:
                    for lo, hi in pieces(cues, len(own), *around):
                        found += [(*x[:4], lo + x[4], lo + x[5], *x[6:]) for x in scan(own[lo:hi], some, plain, max_differ)]
                for _, _, saved, name, a, _, n, _ in whole(winners(found)):
                    index.append(d)
                    rows.append((t.count("\n", 0, starts[a]), name, -saved, n, n == 0))
            return index, list(zip(*rows)) or [[]] * 5

        return work

    return mapped(docs, make, "line long, license string, saved long, differing long, exact boolean")
