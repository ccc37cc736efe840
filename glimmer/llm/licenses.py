"""License scan by patience alignment.

Text and template are word sequences. Words that occur exactly once in both are anchors; the longest increasing
subsequence of their positions is kept and the gaps between are aligned the same way, down to gaps without a common
word. Matched template words over template words is the coverage.

Every whole document is scanned against every template; a template is passed over only where the document has too few
of its words to reach the floor or to beat the best template so far. A document may align a template only within a window as long as the template allows around its anchors, so the words of a long text can't add up to a
license by chance: the aligned pairs are cut where the text skips more than ``slack`` words between two of them, and
the best run counts.

Defined results: null and empty texts have no match (license null, coverage 0.0, licenses empty); ties go to the longer template,
then the first name; repeated rows are judged alike; an empty table gives an empty one; columns but doc_id and text are
ignored, so their names can't clash.
"""

from __future__ import annotations

import math
import pkgutil
import re
from bisect import bisect_left
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

_WORD = re.compile(r"[a-z0-9]+(?:[.\-'][a-z0-9]+)*")

#: Short notices by which works name their license, the notices that licenses ask for, and license texts.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies "
        "of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"
    ),
    "BSD-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    ),
    "MIT-whole-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies "
        "of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this "
        "permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, "
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "BSD-2-Clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or "
        "other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
        "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER "
        "OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
        "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
        "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice "
        "and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH "
        "THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License."
    ),
    "MPL-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
        "https://mozilla.org/MPL/2.0/."
    ),
} | {
    # the notices that the GNU licenses ask for
    f"{name}-notice": (
        f"{it} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {kind} General Public License as published by the Free Software "
        f"Foundation{sep} either version {version} of the License, or (at your option) any later version. {it} is distributed in the hope that it will be useful, but WITHOUT ANY "
        f"WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} General Public License for more details."
    )
    for name, it, mark, kind, sep, version in (
        ("GPL-2.0", "This program", ";", "", ";", "2"),
        ("GPL-3.0", "This program", ":", "", ",", "3"),
        ("AGPL-3.0", "This program", ":", "Affero", ",", "3"),
        ("LGPL-2.1", "This library", ";", "Lesser", ";", "2.1"),
        ("LGPL-3.0", "This library", ":", "Lesser", ",", "3"),
    )
} | {
    f"CC-{name}-4.0-notice": f"This work is licensed under a Creative Commons {kind} 4.0 International License."
    for name, kind in (
        ("BY", "Attribution"),
        ("BY-SA", "Attribution-ShareAlike"),
        ("BY-ND", "Attribution-NoDerivatives"),
        ("BY-NC", "Attribution-NonCommercial"),
        ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
        ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
    )
} | {
    # whole texts, as files of this package
    f"{name}-text": pkgutil.get_data(__package__, f"license_texts/{name}-text.txt").decode()
    for name in "Apache-2.0 Artistic-1.0 BSD-3-Clause CC0-1.0 GFDL-1.2 GFDL-1.3 GPL-1.0 GPL-2.0 GPL-3.0 LGPL-2.0 LGPL-2.1 LGPL-3.0 MPL-1.1 MPL-2.0".split()
}


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs (sorted by the first) whose second members increase, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, y) in enumerate(pairs):
        k = bisect_left(tops, y)
        back[i] = piles[k - 1] if k else -1
        if k == len(tops):
            tops.append(y)
            piles.append(i)
        else:
            tops[k], piles[k] = y, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def gaps(pairs: list[tuple[int, int]], a: int, b: int, c: int, d: int) -> Iterator[tuple[int, int, int, int]]:
    """What lies between the pairs in text[a:b] and template[c:d], where both have words."""
    for i, j in [*pairs, (b, d)]:
        if i > a and j > c:
            yield a, i, c, j
        a, c = i + 1, j + 1


def places(template: list) -> dict:
    """The positions of each word of the template, in order."""
    out: dict = {}
    for j, w in enumerate(template):
        out.setdefault(w, []).append(j)
    return out


#: From so many words of a text on, numpy finds the words of a gap that stand there once.
_WIDE = 256


def align(text: list, template: list, xs: np.ndarray | None = None, ts: np.ndarray | None = None, at: dict | None = None, beat: float = 0) -> list[tuple[int, int]]:
    """(position in text, position in template) of aligned words, both increasing; none as soon as fewer than ``beat``
    are sure to come of it.

    Words may be numbers from 1, and 0 in the text what the template lacks; xs and ts, the same as arrays, find the
    anchors of wide gaps faster. ``at`` has the ``places`` of the template, where they are at hand.
    """
    at = places(template) if at is None else at
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    hope = min(len(text), len(template))  # aligned words, and the most that gaps may still give
    while todo:
        a, b, c, d = todo.pop()
        hope -= min(b - a, d - c)
        was = len(out)
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a < b and c < d:
            if xs is not None and b - a > _WIDE:
                many = int(ts.max()) + 1
                once = (np.bincount(xs[a:b], minlength=many) == 1) & (np.bincount(ts[c:d], minlength=many) == 1)
                once[0] = False
                own = np.zeros(many, dtype=np.int64)
                own[ts[c:d]] = np.arange(c, d)
                found = np.flatnonzero(once[xs[a:b]]) + a
                pairs = list(zip(found.tolist(), own[xs[found]].tolist()))
            else:
                seen: dict = {}
                for i in range(a, b):
                    w = text[i]
                    seen[w] = -1 if w in seen else i
                pairs = []
                for w, i in seen.items():  # in the order of the text
                    if i >= 0 and w in at:
                        js = at[w]
                        k = bisect_left(js, c) if len(js) > 1 else 0
                        if k < len(js) and c <= js[k] < d and (k + 1 == len(js) or js[k + 1] >= d):
                            pairs.append((i, js[k]))
            if pairs:
                pairs = increasing(pairs) if len(pairs) > 1 else pairs
                for gap in gaps(pairs, a, b, c, d):
                    todo.append(gap)
                    hope += min(gap[1] - gap[0], gap[3] - gap[2])
                out.extend(pairs)
        hope += len(out) - was
        if hope < beat:
            return []
    return sorted(out)


def best_run(pairs: list[tuple[int, int]], slack: int) -> tuple[int, int, int]:
    """(matched words, first and one past the last text position) of the best run without a longer skip than slack."""
    best, start = (0, 0, 0), 0
    for k in range(1, len(pairs) + 1):
        if k == len(pairs) or pairs[k][0] - pairs[k - 1][0] > slack + 1:
            if k - start > best[0]:
                best = (k - start, pairs[start][0], pairs[k - 1][0] + 1)
            start = k
    return best


def longest_run(text: list[str], template: list[str], slack: int) -> tuple[int, int, int]:
    """As ``best_run``, of the best of all alignments; needs no unique word."""
    at: dict[str, list[int]] = {}
    for j, w in enumerate(template):
        at.setdefault(w, []).append(j)
    best = (0, 0, 0)
    near: deque[tuple[int, list[tuple[int, int, int]]]] = deque()
    for i, w in enumerate(text):
        if w not in at:
            continue
        while near and near[0][0] < i - slack - 1:
            near.popleft()
        # runs that may go on here by template position, and the best of them so far (the shortest of equals)
        before = sorted(x for _, runs in near for x in runs)
        tops: list[tuple[int, int]] = []
        for _, n, s in before:
            tops.append(max(tops[-1], (n, s)) if tops else (n, s))
        runs = []
        for j in at[w]:
            k = bisect_left(before, (j,))
            n, s = tops[k - 1] if k else (0, i)
            runs.append((j, n + 1, s))
            if n + 1 > best[0]:
                best = (n + 1, s, i + 1)
        near.append((i, runs))
    return best


def needed(template: list[str], least_coverage: float, whole_under: int = 0) -> int:
    """The fewest words whose share of the template reaches least_coverage; all of a template of under whole_under."""
    if len(template) < whole_under:
        return len(template)
    n = max(1, math.floor(least_coverage * len(template)))
    return n if n / len(template) >= least_coverage else n + 1


def anchors(count: Counter, where: dict[str, list[int]], need: int) -> list[int]:
    """Positions in the text of so many template words, rarest in it first, that no run of need words is without one."""
    out: list[int] = []
    left = count.total()
    for w in sorted(count, key=lambda w: (len(where.get(w, ())), w)):
        if left < need:
            break
        left -= count[w]
        out.extend(where.get(w, ()))
    return sorted(out)


def stretches(at: list[int], reach: int, end: int) -> list[tuple[int, int]]:
    """The ranges that lie within reach of the sorted positions, overlapping ones merged."""
    out: list[tuple[int, int]] = []
    for i in at:
        a, b = max(0, i - reach), min(end, i + reach + 1)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


Run = tuple[str | None, float, int, int]


class Scanner:
    """Finds (license, coverage, first word, one past the last word) for each template.

    The text is aligned in windows around the template's rarest word in it: each window spans the template's length
    plus slack on either side. A notice may lack that word, and a window that holds it twice may have no unique anchor,
    so stretches around ``anchors``, as far as a run can reach from one, get their longest run wherever their words
    could make up ``least_coverage``. So no run from there on is missed, and its coverage is exact, but that a template
    over ``long`` words which the alignment already carries that far keeps the alignment's. Below ``least_coverage`` it
    is what the alignment found.
    """

    def __init__(self, templates: dict[str, list[str]], slack: int = 12, least_coverage: float = 0.8, long: int = 400, whole_under: int = 0):
        self.slack, self.long = slack, long
        ordered = sorted(((k, t) for k, t in templates.items() if t), key=lambda x: (len(x[1]), x[0]))  # short ones first: they raise what long ones must beat
        self.index = {w: i for i, w in enumerate(sorted(set().union(*templates.values())))}
        self.templates = []
        for name, t in ordered:
            count = Counter(sorted(t))
            own = np.zeros(len(self.index) + 1, dtype=np.int32)  # number of a word within the template, 0 for others
            own[[self.index[w] for w in count]] = range(1, len(count) + 1)
            ts = own[[self.index[w] for w in t]]
            self.templates.append((name, t, count, needed(t, least_coverage, whole_under), own, np.array([0, *count.values()]), ts, ts.tolist(), places(ts.tolist())))
        # of all templates one behind the other: their distinct words, how often they hold each, and where they begin
        self.held = np.array([self.index[w] for x in self.templates for w in x[2]], dtype=np.int64)
        self.times = np.array([n for x in self.templates for n in x[2].values()], dtype=np.int64)
        self.begins = np.cumsum([0, *(len(x[2]) for x in self.templates)])[:-1]
        self.spans = [(a, a + len(x[2])) for a, x in zip(self.begins.tolist(), self.templates)]

    def run(self, words: list[str], t: list[str], count: Counter, need: int, least: float, most: int, counts: np.ndarray, seen: np.ndarray, xs: np.ndarray, ts: np.ndarray, numbers: list[int], at: dict[int, list[int]]) -> tuple[int, int, int]:
        rare = int(seen.argmin()) + 1
        reach = len(t) + self.slack
        own, done = (0, 0, 0), None
        held = np.flatnonzero(xs)  # words that the template lacks match nothing
        mine = xs[held]
        middle = held[mine == rare]
        for a, b in zip(held.searchsorted(middle - reach).tolist(), held.searchsorted(middle + reach + 1).tolist()):
            beat = max(least, own[0] + 1)
            if (a, b) != done and b - a >= beat:  # else the same window again, or one that makes no difference
                near, stand = mine[a:b], held[a:b].tolist()
                own = max(own, best_run([(stand[x], y) for x, y in align(near.tolist(), numbers, near, ts, at, beat)], self.slack), key=lambda r: r[0])
            done = a, b
        if most < need or own[0] == len(t) or own[0] >= need and len(t) > self.long:
            return own
        where: dict[str, list[int]] = {}
        for i in held.tolist():
            where.setdefault(words[i], []).append(i)
        for a, b in stretches(anchors(count, where, need), (len(t) - 1) * (self.slack + 1), len(words)):
            if int(np.minimum(np.bincount(xs[a:b], minlength=len(counts))[1:], counts[1:]).sum()) >= max(need, own[0] + 1):
                n, s, e = longest_run(words[a:b], t, self.slack)
                own = max(own, (n, s + a, e + a), key=lambda r: r[0])
        return own

    def __call__(self, text: str | None) -> tuple[Run, list[Run]]:
        """The best template, and all that reach least_coverage, the best first."""
        words = words_of(text)
        best: Run = (None, 0.0, 0, 0)
        rank = (0.0, 0)
        found: list[tuple[float, int, Run]] = []
        if not words or not self.templates:
            return best, []
        other = len(self.index)
        ids = np.array([self.index.get(w, other) for w in words])
        # how often the text has each word of each template, and how many words of a template it has at most
        has = np.bincount(ids, minlength=other + 1)[self.held]
        most = np.add.reduceat(np.minimum(has, self.times), self.begins).tolist()
        has[has == 0] = len(ids) + 1  # so that a rarest word is one that the text has
        for (name, t, count, need, number, counts, ts, numbers, at), (begin, end), could in zip(self.templates, self.spans, most):
            least = min(need, rank[0] * len(t) - 1e-9)  # a template that can't have so many words is neither best nor found
            if could < max(least, 1):
                continue
            n, s, e = self.run(words, t, count, need, least, could, counts, has[begin:end], number[ids], ts, numbers, at)
            score = (n / len(t), len(t))
            if n >= need:
                found.append((-score[0], -len(t), (name, score[0], s, e)))
            if n and score > rank:
                rank, best = score, (name, score[0], s, e)
        return best, [x[2] for x in sorted(found, key=lambda x: (x[0], x[1], x[2][0]))]


def scan_text(text: str | None, templates: dict[str, list[str]], slack: int = 12, least_coverage: float = 0.8) -> Run:
    """(license, coverage, first word, one past the last word) of the best template."""
    return Scanner(templates, slack, least_coverage)(text)[0]


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least_coverage: float = 0.8, whole_under: int = 10) -> DataFrame:
    """doc_id, license (null under ``least_coverage``), coverage of the best template, first_word, end_word, and
    licenses: every template that reaches ``least_coverage``, the best first. Notices of under ``whole_under`` words,
    most of them common ones, reach it with all of them only."""
    parsed = {k: words_of(v) for k, v in (TEMPLATES if templates is None else templates).items()}

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(parsed, least_coverage=least_coverage, whole_under=whole_under)
        for b in batches:
            both = [scanner(t) for t in b.text]
            ok = [bool(every) for _, every in both]
            found = [every[0] if every else f for f, every in both]
            yield pd.DataFrame(
                {
                    "doc_id": b.doc_id.astype("Int64"),
                    "license": pd.Series([f[0] if k else None for f, k in zip(found, ok)], dtype=object),
                    "coverage": [float(f[1]) for f in found],
                    "first_word": pd.Series([f[2] if k else None for f, k in zip(found, ok)], dtype="Int64"),
                    "end_word": pd.Series([f[3] if k else None for f, k in zip(found, ok)], dtype="Int64"),
                    "licenses": pd.Series([[dict(zip(("license", "coverage", "first_word", "end_word"), f)) for f in every] for _, every in both], dtype=object),
                }
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    one = "license string, coverage double, first_word long, end_word long"
    return rows.mapInPandas(scan, f"doc_id long, {one}, licenses array<struct<{one.replace(' ', ': ').replace(',:', ',')}>>")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
