"""License scan by conditional compression and word differences.

Candidates come from the license texts' own words: of each text its longest words are anchors,
one more than may differ, so a stretch that can be confirmed still holds one of them. The words
around its anchors, to both sides as many as it can take, are candidate pieces for a license
text, over line ends and comment marks; where they run together they are cut with overlap. A
piece is compressed by zstandard alone, and with the license text as raw dictionary. The bytes
saved, as a share of what the license text itself takes, rank the candidates, whatever the
length of the line around. The winners, all that save enough, are confirmed by exact word
differences; every stretch that equals a license text but for a tenth of its words is a find.
Between them the nearest license text is shown as a near miss.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from splitlane.llm.common import rows_with

# Wording of public licenses and notices.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("proprietary", "All rights reserved."),
]
# Wording of further public licenses and notices, and names of license identifiers.
NOTICES = [
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
]
IDENTIFIERS = [
    "MIT", "Apache-2.0", "GPL-3.0", "GPL-2.0", "LGPL-3.0", "LGPL-2.1", "AGPL-3.0", "BSD-3-Clause", "BSD-2-Clause",
    "ISC", "MPL-2.0", "Unlicense", "BSL-1.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "Zlib",
]
KNOWN = TEMPLATES + NOTICES + [(name, f"SPDX-License-Identifier: {name}") for name in IDENTIFIERS]

#: A level that leaves literals as they are: savings then are the bytes of matches, and do not
#: depend on how well the words around the match can be entropy-coded.
LEVEL = -1
#: Least saving, as a share of the license text's own compressed size, of a winner.
LEAST_REDUCTION = 0.1
#: A piece of a long block has this many times the words of the longest stretch.
PIECE = 4
#: Most differing words, as a share of the template's, for a find to be confirmed.
MOST_DIFFERENT = 0.1

RESULT = (
    "n_blocks long, found array<struct<license:string,start:long,end:long,reduction:double,"
    "differences:long,template_words:long,confirmed:boolean>>"
)
# A comment mark that looks like a word, at the start of a line, is none.
_WORD = re.compile(r"(?:(?<=\n)|\A)[ \t]*(?:dnl|@?rem|c)(?=[ \t])|([^\W_]+(?:\.[0-9]+)*)", re.I)
_CLOSING = re.compile(r"[.,:;!?)\]\"'’”]*")


def words_of(text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Words in lower case, with their starts and ends."""
    found = [m for m in _WORD.finditer(text) if m[1]]
    return (
        [m[1].lower() for m in found],
        np.array([m.start(1) for m in found], np.int64),
        np.array([m.end(1) for m in found], np.int64),
    )


def blocks(marks: list[tuple[int, int]], n_words: int, reach: int) -> list[tuple[int, int]]:
    """Word ranges of ``reach`` words to both sides of each mark; what overlaps is one."""
    out: list[tuple[int, int]] = []
    for a, b in marks:
        a, b = max(0, a - reach), min(n_words, b + reach)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _edits(template: list[str], block: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For every end in the block, the least edits that turn the template into a stretch of
    words up to there, and where the shortest such stretch begins."""
    names = {w: i for i, w in enumerate(dict.fromkeys(template))}
    row = np.array([names.get(w, -1) for w in block], np.int64)
    n = len(row)
    unit = n + 1  # of a cost; below it, how far from the end the stretch begins
    step = np.arange(n + 1) * unit
    before = n - np.arange(n + 1)  # a stretch may begin anywhere
    for k, word in enumerate(template, 1):
        now = np.empty_like(before)
        now[0] = k * unit + n
        now[1:] = np.minimum(before[:-1] + (row != names[word]) * unit, before[1:] + unit)
        before = np.minimum.accumulate(now - step) + step  # extra words in the block
    return before // unit, n - before % unit


def differences(template: list[str], block: list[str]) -> int:
    """Least edits that turn the template into some stretch of consecutive block words."""
    return int(_edits(template, block)[0].min())


def stretches(template: list[str], block: list[str], most: int) -> list[tuple[int, int, int]]:
    """``(edits, first word, end word)`` of stretches within ``most`` edits, none overlapping."""
    own = set(template)
    shared = np.r_[0, np.cumsum([w in own for w in block])]
    width = min(len(template) + most, len(block))
    if not width or (shared[width:] - shared[: len(shared) - width]).max() < len(template) - most:
        return []  # no stretch has enough of the template's words
    cost, start = _edits(template, block)
    out: list[tuple[int, int, int]] = []
    used = np.zeros(len(block), bool)
    for end in sorted(np.flatnonzero(cost <= most).tolist(), key=lambda j: (cost[j], j)):
        first = int(start[end])
        if first < end and not used[first:end].any():
            used[first:end] = True
            out.append((int(cost[end]), first, end))
    return out


def anchors(words: list[str], most: int) -> list[str]:
    """The ``most`` + 1 longest different words; ``most`` edits leave one of them in place."""
    return sorted(dict.fromkeys(words), key=lambda w: (-len(w), w))[: most + 1]


def pieces(n_words: int, reach: int) -> list[tuple[int, int]]:
    """Word ranges that hold every stretch of ``reach`` words whole."""
    size = PIECE * reach
    return [(a, min(a + size, n_words)) for a in range(0, max(n_words - reach, 1), size - reach)]


class Scanner:
    def __init__(self, templates: list[tuple[str, str]]):
        import zstandard

        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        empty = len(self.plain.compress(b""))
        self.known = []
        #: Words that start a candidate, with the license texts they are anchors of.
        self.anchors: dict[str, list[int]] = {}
        for name, text in templates:
            words = words_of(text)[0]
            if not words:
                continue
            flat = " ".join(words).encode()
            raw = zstandard.ZstdCompressionDict(flat, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=raw, write_content_size=False, write_dict_id=False)
            most = int(MOST_DIFFERENT * len(words))
            self.known.append((name, words, squeeze, len(self.plain.compress(flat)) - empty, most))
            for word in anchors(words, most):
                self.anchors.setdefault(word, []).append(len(self.known) - 1)
        #: Words of the longest stretch that can be confirmed.
        self.reach = max((len(words) + most for _, words, _, _, most in self.known), default=0)

    def winners(self, block: list[str]) -> list[tuple[float, int, int, int]]:
        """Saving, license text, first and end word of the pieces that save enough, by saving."""
        places: dict[int, list[tuple[int, int]]] = {}
        for spot, word in enumerate(block):
            for k in self.anchors.get(word, ()):
                places.setdefault(k, []).append((spot, spot + 1))
        out = []
        for k, spots in places.items():
            reach = len(self.known[k][1]) + self.known[k][4]
            for a, b in blocks(spots, len(block), reach):
                for at, to in pieces(b - a, reach):
                    (saved,) = self._saved(block[a + at : a + to], [k])
                    if saved >= LEAST_REDUCTION:
                        out.append((saved, k, a + at, a + to))
        return sorted(out, key=lambda f: (-f[0], *f[1:]))

    def ranked(self, words: list[str]) -> list[int]:
        """License texts that save enough on these words, the largest saving first."""
        every = list(range(len(self.known)))
        saved = self._saved(words, every)
        return sorted((k for k in every if saved[k] >= LEAST_REDUCTION), key=lambda k: (-saved[k], k))

    def _saved(self, words: list[str], which: list[int]) -> list[float]:
        data = " ".join(words).encode()
        alone = len(self.plain.compress(data))
        return [(alone - len(self.known[k][2].compress(data))) / self.known[k][3] for k in which]

    def __call__(self, block: list[str], marks: list[int]) -> list[tuple[str, int, int, float, int, int, bool]]:
        """License, first and end word, reduction, differences, template words and whether
        they confirm it, of every confirmed stretch and of the best near miss between them."""
        found = {
            (len(self.known[k][1]) - apart, k, apart, at + a, at + b)
            for _, k, at, to in self.winners(block)
            for apart, a, b in stretches(self.known[k][1], block[at:to], self.known[k][4])
        }
        used = {name: np.zeros(len(block), bool) for name, *_ in self.known}
        out = []
        for _, k, apart, a, b in sorted(found, key=lambda s: (-s[0], s[1], s[3], s[4])):
            name, words = self.known[k][:2]
            if used[name][a:b].any():
                continue  # a shorter wording of the same license in the same place
            used[name][a:b] = True
            out.append((name, a, b, self._saved(block[a:b], [k])[0], apart, len(words), True))
        edges, at = [], 0
        for a, b in sorted(f[1:3] for f in out):
            edges.append((at, a))
            at = max(at, b)
        for a, b in [*edges, (at, len(block))]:
            if bisect_left(marks, a) < bisect_left(marks, b):
                miss = self._nearest(block[a:b])
                if miss:
                    name, x, y, *rest = miss
                    out.append((name, a + x, a + y, *rest, False))
        return sorted(out, key=lambda f: f[1:3])

    def _nearest(self, words: list[str]) -> tuple[str, int, int, float, int, int] | None:
        best = None
        for at, to in pieces(len(words), self.reach):
            part = words[at:to]
            for rank, k in enumerate(self.ranked(part)):
                name, template = self.known[k][:2]
                cost, start = _edits(template, part)
                end = int(cost.argmin())
                apart = int(cost[end])
                order = (apart / len(template), rank, at)
                if apart < len(template) and (best is None or order < best[0]):
                    best = (order, (name, at + int(start[end]), at + end, k, apart, len(template)))
        if not best:
            return None
        name, a, b, k, apart, size = best[1]
        return name, a, b, self._saved(words[a:b], [k])[0], apart, size


def scanning(templates: list[tuple[str, str]]) -> Callable[[], Callable[[pa.Array], pa.StructArray]]:
    item = pa.struct(
        [("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("reduction", pa.float64()),
         ("differences", pa.int64()), ("template_words", pa.int64()), ("confirmed", pa.bool_())]
    )

    def compute() -> Callable[[pa.Array], pa.StructArray]:
        scan = Scanner(templates)
        likely_words = "|".join(map(re.escape, sorted(scan.anchors))) or r"[^\s\S]"
        seen: dict[tuple, list] = {}

        def work(texts: pa.Array) -> pa.StructArray:
            likely = pc.match_substring_regex(texts, likely_words, ignore_case=True).fill_null(False).to_pylist()
            n, found = [], []
            for text, look in zip(texts, likely, strict=True):
                whole = text.as_py() if look else ""
                words, first, end = words_of(whole)
                marks = [k for k, word in enumerate(words) if word in scan.anchors]
                spans = blocks([(k, k + 1) for k in marks], len(words), scan.reach)
                n.append(len(spans))
                rows = []
                for a, b in spans:
                    block = words[a:b]
                    own = [k - a for k in marks[bisect_left(marks, a) : bisect_left(marks, b)]]
                    key = (*block, *own)
                    if key not in seen:
                        if len(seen) > 2_000:
                            seen.clear()
                        seen[key] = scan(block, own)
                    for name, x, y, reduction, apart, size, sure in seen[key]:
                        stop = _CLOSING.match(whole, int(end[a + y - 1])).end()
                        rows.append(dict(zip(
                            ("license", "start", "end", "reduction", "differences", "template_words", "confirmed"),
                            (name, int(first[a + x]), stop, reduction, apart, size, sure), strict=True,
                        )))
                found.append(rows)
            return pa.StructArray.from_arrays(
                [pa.array(n, pa.int64()), pa.array(found, pa.list_(item))], names=["n_blocks", "found"]
            )

        return work

    return compute


def license_scan(
    docs: DataFrame, text_col: str = "text", templates: list[tuple[str, str]] | None = None
) -> DataFrame:
    """``row`` (the input columns) and ``out`` for every row of ``docs``.

    ``out.n_blocks`` counts candidate blocks. ``out.found`` has, in page order, every place
    where a license text stands but for at most ``MOST_DIFFERENT`` of its words (confirmed;
    wordings of one license in the same place count once), and between those of a block the
    nearest license text if it saves enough. Each has its place (code points, end
    exclusive), the reduction and the differing words. Line ends, punctuation, case and
    comment marks do not count. Null and empty texts have no blocks. Equal blocks get equal
    results.
    """
    return rows_with(docs, text_col, RESULT, scanning(KNOWN if templates is None else templates))
