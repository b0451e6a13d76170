"""License scans: normalised text against licence templates by Dice coefficient over word bigrams.

A licence is a line of a document, the whole of it, or a window of words somewhere in it. A passage
with n bigrams can reach Dice d with a template of m bigrams only if 2*min(n, m)/(n+m) >= d, so
templates outside these size bounds are not compared; nor is one without enough common bigrams, found
through a map from bigrams to templates. Windows begin and end at bigrams of their template (others
only lower Dice): each bigram in the text that may begin one is tried with all ends in the bounds.

Licences of a family differ by a word or a number only, less than Dice tells. A notice (a template of up to ``NOTICE_WORDS``)
matches only what has the same telling words (such as ShareAlike or Lesser) and the same version as itself, so a
relative without a template matches nothing.

Lines and windows are taken by common bigrams times Dice (a line before an equal window; windows in a
matching line are not looked at) while they do not overlap, then what lies between is searched again.
The whole text stands for them if it matches no worse than any line and they are one match at most.
Templates of a single word are compared with lines and whole texts only.

Defined results: a null or empty text has no match; ties go to the earlier template, then the
earlier passage, the shorter window; repeated rows are scanned each; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tagloom.llm.common import bounded, slices
from tagloom.llm.license_texts import COMPLETE, NOTICES

_GRANT_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    "(the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the Software."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
    "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)
#: Fixed public wordings: (licence, template).
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", _GRANT_MIT),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("lgpl-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("bsd-2-clause", _BSD),
    ("bsd-3-clause", _BSD + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)
#: All that scans look for: the wordings above, which the SQL knows, and those of ``license_texts``.
ALL_TEMPLATES = TEMPLATES + NOTICES + COMPLETE
THRESHOLD = 0.8
#: Words that tell licences of a family apart, words that a version follows, and the most words of a notice.
TELLING = frozenset("noncommercial noderivatives noderivs sharealike nc nd sa lesser affero".split())
BEFORE_VERSION = TELLING | frozenset("version v attribution by license gpl lgpl agpl mpl epl".split())
NOTICE_WORDS = 80
_VERSIONED = re.compile(r"v([0-9]+)")
_WORD = re.compile(r"[a-z0-9]+")
_SPLIT = re.compile(r"[^a-z0-9]+")


def words_of(passage: str) -> list[str]:
    """Lower case, everything but ASCII letters and digits a separator."""
    return [w for w in _SPLIT.split(passage.lower()) if w]


def bigrams(words: list[str]) -> Counter:
    """Multiset of adjacent pairs; a single word stands for itself."""
    return Counter(zip(words, words[1:])) if len(words) > 1 else Counter([(w,) for w in words])


def telling(words: list[str]) -> frozenset[str]:
    """Telling words of a passage, and versions without closing zeros."""
    out = TELLING.intersection(words)
    for k, word in enumerate(words):
        joined = _VERSIONED.fullmatch(word)
        if joined or word in BEFORE_VERSION and k + 1 < len(words) and words[k + 1].isdigit():
            parts, k = ([joined.group(1)] if joined else []), k + 1
            while k < len(words) and words[k].isdigit() and len(parts) < 3:
                parts.append(words[k])
                k += 1
            while len(parts) > 1 and parts[-1] == "0":
                parts.pop()
            out |= {".".join(parts)}
    return out


def dice(a: Counter, b: Counter) -> float:
    total = a.total() + b.total()
    return 2 * (a & b).total() / total if total else 0.0


class Matcher:
    def __init__(self, templates: tuple[tuple[str, str], ...], threshold: float):
        self.threshold = threshold
        self.grams = [bigrams(words_of(text)) for _, text in templates]
        self.sizes = [g.total() for g in self.grams]
        self.telling = [telling(w) if len(w) <= NOTICE_WORDS else None for w in (words_of(text) for _, text in templates)]
        self.single = any(len(pair) == 1 for grams in self.grams for pair in grams)
        self.low = min(threshold * m / (2 - threshold) for m in self.sizes)
        self.high = max((2 - threshold) * m / threshold for m in self.sizes)
        self.needed = [threshold * m / (2 - threshold) - 1e-9 for m in self.sizes]
        self.having: dict[tuple, list[int]] = {}
        for i, grams in enumerate(self.grams):
            for pair in grams:
                self.having.setdefault(pair, []).append(i)

    def bounded(self, n: int) -> list[int]:
        """Templates which a passage of ``n`` bigrams can match by size alone."""
        return [i for i, m in enumerate(self.sizes) if 2 * min(n, m) >= self.threshold * (n + m)]

    def tells(self, i: int, words: list[str]) -> bool:
        """Whether template ``i``, if it is a notice, has the telling words and versions of ``words``."""
        return self.telling[i] is None or self.telling[i] == telling(words)

    def possible(self, words: list[str]) -> list[int]:
        """Templates of two words or more that some passage of ``words`` may match, by their common bigrams."""
        common: Counter = Counter()
        for pair in self.having.keys() & set(zip(words, words[1:])):
            for i in self.having[pair]:
                common[i] += self.grams[i][pair]
        return sorted(i for i, c in common.items() if c >= self.needed[i] and len(next(iter(self.grams[i]))) > 1)

    def windows(self, words: list[str], low: int, high: int, i: int) -> list[tuple[float, int, int, int]]:
        """Best window (Dice, common bigrams, first word, end) of template ``i`` from each of its bigrams in ``words[low:high]``."""
        grams, m, most = self.grams[i], self.sizes[i], int((2 - self.threshold) * self.sizes[i] / self.threshold + 1e-9)
        places, before, seen = [], [], {}  # before: a bigram counts in windows that begin after this one
        for k in range(low, high - 1):
            if often := grams.get((words[k], words[k + 1]), 0):
                same = seen.setdefault((words[k], words[k + 1]), [])
                before.append(same[-often] if len(same) >= often else -1)
                same.append(len(places))
                places.append(k)
        if len(places) < self.needed[i]:
            return []
        at, before = np.array(places), np.array(before)
        change = np.bincount(np.maximum(before + 1, np.searchsorted(at, at - most + 1)), minlength=len(at) + 1)
        change[1:] -= 1
        out = []
        for start in np.flatnonzero(np.cumsum(change)[:-1] >= self.needed[i]).tolist():  # common bigrams of the longest window
            end = int(np.searchsorted(at, at[start] + most))
            common = np.cumsum(before[start:end] < start)
            score = 2 * common / (at[start:end] - at[start] + 1 + m)
            k = int(np.argmax(score))
            if score[k] >= self.threshold and self.tells(i, words[places[start] : places[start + k] + 2]):
                out.append((float(score[k]), int(common[k]), places[start], places[start + k] + 2))
        return out

    def best(self, passage: str) -> tuple[float, int] | None:
        if not self.low <= (len(passage) + 1) / 2:  # that many words at most
            return None
        words = words_of(passage)
        n = max(len(words) - 1, min(1, len(words)))
        if not self.low <= n <= self.high:
            return None
        pairs = set(zip(words, words[1:])) if len(words) > 1 else {(w,) for w in words}
        near = {i for pair in pairs & self.having.keys() for i in self.having[pair]}.intersection(self.bounded(n))
        near = {i for i in near if self.tells(i, words)}
        if not near:
            return None
        grams = bigrams(words)
        found = max(((dice(grams, self.grams[i]), -i) for i in near), default=(0.0, 0))
        return (found[0], -found[1]) if found[0] >= self.threshold else None


@lru_cache(4)
def _matcher(templates: tuple[tuple[str, str], ...], threshold: float) -> Matcher:
    return Matcher(templates, threshold)


def _words_at(text: str) -> list[tuple[str, int, int]]:
    """Each word with its place in ``text`` (lower case can be longer)."""
    lower = text.lower()
    found = [(m.group(), m.start(), m.end()) for m in _WORD.finditer(lower)]
    if len(lower) != len(text):
        back = [i for i, c in enumerate(text) for _ in c.lower()]
        found = [(w, back[s], back[e - 1] + 1) for w, s, e in found]
    return found


def scan_text(text: str, templates: tuple[tuple[str, str], ...] = ALL_TEMPLATES, threshold: float = THRESHOLD) -> list[tuple[str, float, int, int]]:
    """Matches (licence, Dice, start, end in code points) by start: lines and windows, or else the whole text."""
    matcher = _matcher(templates, threshold)
    words = words_of(text)
    possible = matcher.possible(words)
    if not possible and not matcher.single:
        return []
    lines, at = [], 0
    for line in text.split("\n"):
        if got := matcher.best(line):
            lines.append((*got, at, at + len(line)))
        at += len(line) + 1
    out = _placed(matcher, text, possible, lines)
    if "\n" in text and len(out) < 2 and (got := matcher.best(text)) and got[0] >= max((line[0] for line in lines), default=0.0):
        out = [(*got, 0, len(text))]
    return [(templates[i][0], d, s, e) for d, i, s, e in out]


def _placed(matcher: Matcher, text: str, possible: list[int], lines: list[tuple[float, int, int, int]]) -> list[tuple[float, int, int, int]]:
    """Lines and windows (Dice, template, start, end) that are taken, by start."""
    found = _words_at(text)
    words, starts, ends = [w for w, _, _ in found], [s for _, s, _ in found], [e for _, _, e in found]
    line_of = {k: (bisect_left(starts, s), bisect_left(starts, e)) for k, (_, _, s, e) in enumerate(lines)}
    taken: list[tuple[float, int, int, int]] = []
    gaps, first = [(0, len(words))], True
    while gaps:
        again = []
        for low, high in gaps:
            options = []
            if first:
                for k, (d, i, s, e) in enumerate(lines):
                    a, b = line_of[k]
                    options.append((-d * (b - a - 1 + matcher.sizes[i]) * d / 2, 0, i, a, b, (d, i, s, e)))
            if high - low > 1:
                inside = [line_of[k] for k in line_of] if first else []
                for i in possible:
                    for d, c, a, b in matcher.windows(words, low, high, i):
                        k = bisect_right(inside, (a, len(words))) - 1
                        if k < 0 or inside[k][1] < b:
                            options.append((-d * c, 1, i, a, b, (d, i, starts[a], ends[b - 1])))
            placed: list[tuple[int, int]] = []
            for *_, a, b, match in sorted(options):
                k = bisect_left(placed, (a, b))
                if (k == 0 or placed[k - 1][1] <= a) and (k == len(placed) or placed[k][0] >= b):
                    placed.insert(k, (a, b))
                    taken.append(match)
            if placed:
                again += zip([low, *(b for _, b in placed)], [*(a for a, _ in placed), high])
        gaps, first = again, False
    return sorted(taken, key=lambda t: t[2:])


_FOUND = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = ALL_TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: its id and ``matches``. Map-side only."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = to_arrow_type(source.schema["id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches):
            rows = [[dict(zip(("license", "dice", "start", "end"), m)) for m in scan_text(t or "", templates, threshold)] for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(rows, _FOUND)], ["id", "matches"])

    out = bounded(source).mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, matches array<struct<license:string,dice:double,start:bigint,end:bigint>>")
    return out.withColumnRenamed("id", id_col)


def summary(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The columns of the query: number of matching passages, the best one's licence and Dice, and all of them."""
    best = F.element_at(F.array_sort(F.transform("matches", lambda m: F.struct((-m["dice"]).alias("d"), m["start"].alias("s"), m["license"].alias("l")))), 1)
    some = F.size("matches") > 0
    return found.select(
        id_col,
        F.size("matches").cast("long").alias("n_matches"),
        F.when(some, best["l"]).alias("license"),
        F.when(some, F.round(-best["d"], 6)).otherwise(F.lit(0.0)).alias("dice"),
        F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["start"].cast("string"), m["end"].cast("string"))), ",").alias("matches"),
    )
