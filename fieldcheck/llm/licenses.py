"""License scans by patience alignment of texts with license templates.

Both sides are words (ASCII letters, digits and characters beyond ASCII, A-Z lower-cased). Words unique
to both sides are anchors; the longest increasing subsequence of their places keeps those in order; the
gaps between kept anchors are aligned in the same way, where a word need only be unique within the gap,
and equal words next to an anchor join it. Coverage is the share of a template's words that are aligned.

Places are found for whole slices at once from word hashes, so the alignment runs on the few that can hold
a template of ``n`` words, of which ``k`` are enough. Around every ``SEED`` consecutive words of a template
a window reaches as far as the template could on both sides; windows are joined where they touch, in bounded
memory. A window that holds a notice twice has no unique words, so each copy is aligned by itself as well: a
copy ends where the seeds step back in the template, and its window ends where the seeds of its neighbours begin.

A covered text need not hold such a run of words. So the ``n`` and the ``REACH * n`` words from every place are
aligned too where that place can be the first match, which no word after the first ``n - k + 1`` of a template
is, unless a count shows that they fall short: of the words a text must share ``k``, as often as the template
has them at most, and of any ``m`` words of the template all but ``n - k``. The ``m`` are the rarest in the
slice. These tests leave out only what cannot be covered.

Defined results: null texts and texts without words have no licenses; each template is reported at most
once a document, with its best window (the earliest of equals); rows are independent. Extra columns are
ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcheck.llm.common import ALNUM, Words, chain, slices, windows, words

#: Words in a row that start the search of a window.
SEED = 3
#: Share of a template's words that must be aligned.
COVERAGE = 0.8
#: A window reaches so many times the template's length to each side of a seed.
REACH = 2

#: Short public license notices.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required "
        'by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License."),
    "mit": "Released under the MIT License",
    "mit-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the Software."),
    "bsd-notice": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met"),
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation"),
    "gpl-3.0": "licensed under the GNU General Public License, version 3",
    "mpl-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights",
    "reserved": "All rights reserved",
}


def longest_increasing(values: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence, by patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    back = [-1] * len(values)
    for i, v in enumerate(values):
        p = bisect_left(tops, v)
        if p:
            back[i] = at[p - 1]
        if p == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[p], at[p] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Matched places of ``a`` and ``b``, increasing on both sides."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        lo, hi, low, high = todo.pop()
        while lo < hi and low < high and a[lo] == b[low]:
            out.append((lo, low))
            lo, low = lo + 1, low + 1
        while lo < hi and low < high and a[hi - 1] == b[high - 1]:
            hi, high = hi - 1, high - 1
            out.append((hi, high))
        if lo >= hi or low >= high:
            continue
        left, right = Counter(a[lo:hi]), Counter(b[low:high])
        place = {x: low + i for i, x in enumerate(b[low:high]) if right[x] == 1}
        anchors = [(i, place[a[i]]) for i in range(lo, hi) if left[a[i]] == 1 and a[i] in place]
        anchors = [anchors[i] for i in longest_increasing([j for _, j in anchors])]
        if not anchors:
            continue
        out += anchors
        for (i, j), (k, m) in zip([(lo - 1, low - 1), *anchors], [*anchors, (hi, high)]):
            todo.append((i + 1, k, j + 1, m))
    return sorted(out)


class Templates:
    """Templates as word hashes, and the seeds by which their places are found."""

    def __init__(self, texts: dict[str, str]):
        self.names = sorted(texts)
        w = words(pa.array([texts[n] for n in self.names], pa.large_string()), ALNUM, lower=True)
        h = w.hashes()
        self.hashes = [h[a:b].tolist() for a, b in zip(w.first[:-1], w.first[1:])]
        self.seeds: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for t, own in enumerate(self.hashes):
            size = min(SEED, len(own))
            for i in range(len(own) - size + 1) if size else ():
                key = int(chain([np.array([x], np.uint64) for x in own[i:i + size]])[0])
                self.seeds.setdefault(size, {}).setdefault(key, []).append((t, i))
        self.vocabulary = np.unique(np.concatenate([np.array(x, np.uint64) for x in self.hashes] or [np.zeros(0, np.uint64)]))
        self.codes = [np.searchsorted(self.vocabulary, np.array(x, np.uint64)) for x in self.hashes]
        self.probe = {s: np.sort(np.array(list(x), np.uint64)) for s, x in self.seeds.items()}

    def scan(self, text: pa.Array) -> Iterator[tuple[int, int, float, int, int]]:
        """(document, template, coverage, first word, end word) of every template that is covered enough."""
        w = words(text, ALNUM, lower=True)
        h = w.hashes()
        spots: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for size, known in self.probe.items():
            at = windows(w, size)
            if not len(at):
                continue
            got = chain([h[at + i] for i in range(size)])
            low = np.searchsorted(known, got)
            low[low == len(known)] = 0
            for i in np.flatnonzero(known[low] == got):
                first = int(at[i])
                doc = int(np.searchsorted(w.first, first, "right")) - 1
                for t, j in self.seeds[size][int(got[i])]:
                    spots.setdefault((doc, t), []).append((first, j, size))
        found: dict[tuple[int, int], tuple[float, int, int]] = {}
        for (doc, t), seeds in spots.items():
            begin, end, n = int(w.first[doc]), int(w.first[doc + 1]), len(self.hashes[t])
            best = (0.0, 0, 0)
            for a, b in _ranges(seeds, n):
                a, b = max(a, begin), min(b, end)
                if best[0] == 1 and a > best[1]:
                    break
                met = align(h[a:b].tolist(), self.hashes[t])
                if met:
                    best = min(best, (len(met) / n, a + met[0][0], a + met[-1][0] + 1), key=lambda x: (-x[0], x[1], x[2]))
            found[doc, t] = best
        for t, first, last in self._starts(w, h):
            doc, n = int(np.searchsorted(w.first, first, "right")) - 1, len(self.hashes[t])
            best = found.get((doc, t), (0.0, 0, 0))
            for stop in {min(first + n, last), last} if best[0] < 1 else ():
                met = align(h[first:stop].tolist(), self.hashes[t])
                if met:
                    best = min(best, (len(met) / n, first + met[0][0], first + met[-1][0] + 1), key=lambda x: (-x[0], x[1], x[2]))
            found[doc, t] = best
        for (doc, t), (share, first, last) in sorted(found.items()):
            if share >= COVERAGE:
                yield doc, t, share, first - int(w.first[doc]), last - int(w.first[doc])

    def _starts(self, w: Words, h: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(template, first word, end word) of stretches whose first word may be the first match of a covered template."""
        none = len(self.vocabulary)
        if not none or not len(h):
            return
        code = np.searchsorted(self.vocabulary, h)
        code[self.vocabulary[np.minimum(code, none - 1)] != h] = none
        seen, until = np.bincount(code, minlength=none + 1), np.repeat(w.first[1:], w.counts)
        for t, own in enumerate(self.codes):
            n = len(own)
            if not n:
                continue
            lost = n - next(k for k in range(n + 1) if k / n >= COVERAGE)
            rare = own[np.argsort(seen[own], kind="stable")[:2 * lost + 1]]
            first = np.flatnonzero(_among(own[:lost + 1], none)[code])
            last = np.minimum(first + REACH * n, until[first])
            for some, least in ((rare, len(rare) - lost), (own, n - lost)):
                total = np.concatenate([[0], np.cumsum(_among(some, none)[code])])
                ok = total[last] - total[first] >= least
                first, last = first[ok], last[ok]
            bag = np.bincount(own, minlength=none)
            for a, b in zip(first.tolist(), last.tolist()):
                if np.minimum(np.bincount(code[a:b], minlength=none + 1)[:none], bag).sum() >= n - lost:
                    yield t, a, b


def _among(codes: np.ndarray, none: int) -> np.ndarray:
    """Which codes are among ``codes``; ``none`` is the code of all other words."""
    out = np.zeros(none + 1, bool)
    out[codes] = True
    return out


def _ranges(seeds: list[tuple[int, int, int]], n: int) -> list[tuple[int, int]]:
    """Ranges of words to be aligned with a template of ``n`` words, from (word, template word, size) of seeds."""
    seeds = sorted(seeds)
    out = set(_joined([(p - j - (REACH - 1) * n, p - j + REACH * n) for p, j, _ in seeds], 4 * REACH * n))
    copies = _copies(seeds, n)
    for k, (p, j, _) in enumerate(copies):
        low, high = p - j - (REACH - 1) * n, p - j + REACH * n
        if k:
            low = max(low, copies[k - 1][2])
        if k + 1 < len(copies):
            high = min(high, copies[k + 1][0])
        out.add((low, max(high, copies[k][2])))
    # A stray seed within a notice cuts it in two, so the plain length from every start is taken too.
    out.update((p - j, p - j + n) for p, j, _ in seeds)
    out.update((p - j, p - j + REACH * n) for p, j, _ in copies)
    return sorted(out)


def _copies(seeds: list[tuple[int, int, int]], n: int) -> list[tuple[int, int, int]]:
    """First word, its place in the template and end of each run of sorted seeds that goes forward in the template."""
    at: dict[int, list[tuple[int, int]]] = {}
    for p, j, size in seeds:
        at.setdefault(p, []).append((j, size))
    out: list[list[int]] = []
    last = -1
    for p, found in at.items():
        # Of several places of a run of words the next one is the likeliest.
        ahead = [x for x in found if out and x[0] > last and p - out[-1][0] < REACH * n]
        j, size = min(ahead or found)
        if not ahead:
            out.append([p, j, p])
        last, out[-1][2] = j, p + size
    return [(p, j, e) for p, j, e in out]


def _joined(ranges: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """Overlapping ranges as one, unless it would be longer than ``most``; none twice."""
    out: list[list[int]] = []
    for a, b in sorted(set(ranges)):
        if out and a <= out[-1][1] and b - out[-1][0] <= most:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def license_scan(docs: DataFrame, texts: dict[str, str] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_licenses, licenses (name:coverage:first:end, by name)."""
    texts = TEMPLATES if texts is None else texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates(texts)
        for b in slices(batches):
            found: list[list[str]] = [[] for _ in range(b.num_rows)]
            for doc, t, share, a, e in templates.scan(b.column("text")):
                found[doc].append(f"{templates.names[t]}:{share:.3f}:{a}:{e}")
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x) for x in found], pa.int64()),
                                              pa.array([",".join(x) for x in found], pa.string())], ["doc_id", "n_licenses", "licenses"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_licenses long, licenses string")
