"""License scan by conditional compression: how much shorter does a block get when a license text is known?

Blocks around words that licenses use are cut from a text and written as lower-case words. Each block is compressed
alone and with each template as a raw zstandard dictionary; the bytes saved, as a share of what the template saves on
itself, rank the templates. Those that save enough are compared with the block word by word, and the first that misses
few words and none that tells it from its relatives is a finding, with the exact differences. Its words are cut out and
the rest is searched again, so a block gives all of its licenses.
"""

from __future__ import annotations

import re
from collections import OrderedDict
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame

#: Short notices and texts of public licenses, (license, text).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies.",
    ),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0."),
)
#: Words whose loss or gain makes another license of it; numbers count too.
TELLING = frozenset("apache mit gnu lesser affero general public bsd mozilla cc cc0 by sa nc nd sharealike noncommercial noderivatives creative isc eclipse unencumbered".split())
#: Stems that hint at a license, looked up in lower-cased text.
HINTS = ("licen", "copyright", "permission", "redistribut", "warrant", "merchantab", "spdx", "creative commons", "public domain", "cc by", "cc-by", "cc0")
#: Code points around a hint that belong to its block; hints closer than twice that share a block.
AROUND = 240
#: Share of a template's words that a block may lack, and of its own saving that a block must save.
LACKS, SAVES = 0.15, 0.3
LEVEL = 12
#: Blocks whose finding a task remembers.
REMEMBERED = 1 << 14

_WORD = re.compile(r"[^\W_]+")
_BLANK = re.compile(r"\s")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def hints(text: str) -> list[int]:
    """Where the stems begin, in order."""
    low = text.lower()
    if len(low) != len(text):  # a few letters change their length
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    out = []
    for stem in HINTS:
        at = low.find(stem)
        while at >= 0:
            out.append(at)
            at = low.find(stem, at + len(stem))
    return sorted(out)


def blocks(text: str) -> list[tuple[int, int]]:
    """Start and end of the parts of a text that may hold a license, in order, apart from each other, cut at white space where there is some."""
    found: list[list[int]] = []  # start, first hint, last hint, end
    for hint in hints(text):
        a, b = max(0, hint - AROUND), min(len(text), hint + AROUND)
        if found and a <= found[-1][3]:
            found[-1][2:] = hint, b
        else:
            found.append([a, hint, hint, b])
    out = []
    for a, first, last, b in found:
        if a and (blank := _BLANK.search(text, a, first)):
            a = blank.start()
        if b < len(text) and (blanks := list(_BLANK.finditer(text, last, b))):
            b = blanks[-1].end()
        out.append((a, b))
    return out


def differences(template: list[str], block: list[str]) -> tuple[list[str], list[str], int, int]:
    """Words of the template that the block lacks, words that it has between the first and last match, and that range.

    Only words around the longest common run count, as far as a template with a half more words would reach, and of
    those the stretch in which matches outweigh the words between them most.
    """
    anchor = SequenceMatcher(None, template, block, autojunk=False).find_longest_match()
    if not anchor.size:
        return template, [], 0, 0
    slack = len(template) // 2 + 1
    begin = max(0, anchor.b - anchor.a - slack)
    near = block[begin : anchor.b - anchor.a + len(template) + slack]
    runs = [m for m in SequenceMatcher(None, template, near, autojunk=False).get_matching_blocks() if m.size]
    best, score, at = (0, 0, 0), 0, 0  # weight of a stretch, its first run and the one after its last
    for k, m in enumerate(runs):
        gap = m.b - runs[k - 1].b - runs[k - 1].size if k else 0
        if score - gap < 0:
            score, at, gap = 0, k, 0
        score += m.size - gap
        if score > best[0]:
            best = (score, at, k + 1)
    runs = runs[best[1] : best[2]]
    kept = {i for m in runs for i in range(m.a, m.a + m.size)}
    own = {j for m in runs for j in range(m.b, m.b + m.size)}
    first, last = runs[0].b, runs[-1].b + runs[-1].size
    added = [near[j] for j in range(first, last) if j not in own]
    return [w for i, w in enumerate(template) if i not in kept], added, begin + first, begin + last


class Templates:
    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES):
        import zstandard

        self.names = [name for name, _ in templates]
        self.words = [words_of(text) for _, text in templates]
        self.alone = zstandard.ZstdCompressor(level=LEVEL)
        self.knowing = []
        for words in self.words:
            raw = zstandard.ZstdCompressionDict(" ".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.knowing.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=raw))
        self.own = [self.savings(" ".join(w).encode(), k) for k, w in enumerate(self.words)]

    def savings(self, block: bytes, k: int) -> int:
        return len(self.alone.compress(block)) - len(self.knowing[k].compress(block))

    def ranked(self, words: list[str]) -> tuple[list[int], list[float]]:
        """Templates by bytes saved, those that save too little behind, and the shares saved; ties in the order of the list."""
        written = " ".join(words).encode()
        alone = len(self.alone.compress(written))
        saved = [alone - len(c.compress(written)) for c in self.knowing]
        share = [s / max(1, own) for s, own in zip(saved, self.own, strict=True)]
        return sorted(range(len(share)), key=lambda k: (-(share[k] >= SAVES) * saved[k], -share[k], k)), share

    def confirmed(self, words: list[str]):
        """(first word, word after the last, license, template, share saved, runner-up, missing, added) or None."""
        order, share = self.ranked(words)
        for k in order:
            if share[k] < SAVES:
                return None
            missing, added, first, last = differences(self.words[k], words)
            telling = [w for w in (*missing, *added) if w in TELLING or w[0].isdigit()]
            if len(missing) <= LACKS * len(self.words[k]) and len(added) <= len(self.words[k]) // 2 and not telling:
                other = next((self.names[o] for o in order if self.names[o] != self.names[k]), None)
                return first, last, self.names[k], k, share[k], other, missing, added
        return None

    def find(self, words: list[str]) -> list[tuple]:
        """All licenses in words, in order, as `confirmed` gives them. A stretch of twice the longest template is looked at at once."""
        out, at, longest = [], 0, max(map(len, self.words), default=0)
        while at < len(words):
            part = words[at : at + 2 * longest]
            found = self.confirmed(part)
            if found is None:
                if at + len(part) == len(words):
                    break
                at += longest
                continue
            first, last = found[:2]
            out += [(a + at, b + at, *rest) for a, b, *rest in self.find(part[:first])]
            out.append((first + at, last + at, *found[2:]))
            at += last
        return out

    def findings(self, block: str) -> list[tuple]:
        """(start, end, license, template, share saved, runner-up, missing, added): all licenses of a block or, if there is none, one row without."""
        places = list(_WORD.finditer(block))
        words = [m.group().lower() for m in places]
        found = [(places[a].start(), places[b - 1].end(), *rest) for a, b, *rest in self.find(words)]
        if found or not self.names:
            return found or [(0, len(block), None, None, 0.0, None, [], words)]
        order, share = self.ranked(words)
        missing, added, _, _ = differences(self.words[order[0]], words)
        return [(0, len(block), None, order[0], share[order[0]], self.names[order[0]], missing, added)]


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """A row for each license found in docs (doc_id, text; others are ignored), and for each candidate block without one.

    doc_id, block (from 0), start, end (code points of the finding, end exclusive; without one, of the block), license
    (null if no template was confirmed), template (number of the winner or, unconfirmed, of the best), saved (its saving
    as a share of its saving on itself), runner_up (the next license in rank; unconfirmed, the best), missing and added
    (the differing words). Of templates that save the same the one earlier in the list is tried first. Null and empty texts
    and texts without a hint have no rows, an empty table has none; a null doc_id stays null. Repeated rows are reported
    each time. Texts are read whole; the work on a block grows with its length.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, told = Templates(templates), OrderedDict()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for number, (a, b) in enumerate(blocks(text or "")):
                    block = text[a:b]
                    found = told.get(block)
                    if found is None:
                        found = told[block] = known.findings(block)
                        if len(told) > REMEMBERED:
                            told.popitem(last=False)
                    rows += [(doc_id, number, a + x, a + y, *which, " ".join(missing), " ".join(added)) for x, y, *which, missing, added in found]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    kinds = "doc_id long, block int, start int, end int, license string, template int, saved double, runner_up string, missing string, added string"
    names = [k.split()[0] for k in kinds.split(", ")]
    arrow = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    types = [arrow[k.split()[1]] for k in kinds.split(", ")]
    return docs.select("doc_id", "text").mapInArrow(step, kinds)
