"""License scans: Dice coefficient over word bigrams against templates, pruned by size bounds."""

from __future__ import annotations

import bisect
import heapq
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

_TOKEN = re.compile(r"[a-z0-9]+")

#: Wordings of well-known licences and notices, by SPDX id where there is one.
_NOTICES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS "
        "OF ANY KIND, either express or implied. See the License for the specific language governing permissions "
        "and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the Software), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("all-rights-reserved", "All rights reserved."),
)


_ASIS = (
    "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
    "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
    "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
    "Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
    "met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)
_NO_ENDORSEMENT = (
    " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission."
)
_TEXTS = (
    ("MIT", f"{_MIT_GRANT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_ASIS}"),
    ("MIT-0", f"{_MIT_GRANT}."),
    ("MIT-0", f"{_MIT_GRANT}. {_ASIS}"),
    ("BSD-2-Clause", _BSD),
    ("BSD-3-Clause", _BSD + _NO_ENDORSEMENT),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("Apache-1.1", "Licensed under the Apache License, Version 1.1."),
    ("MPL-1.1", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1."),
    ("EPL-1.0", "This program is made available under the terms of the Eclipse Public License v1.0"),
    ("EPL-2.0", "This program is made available under the terms of the Eclipse Public License v 2.0"),
    ("EUPL-1.2", "Licensed under the EUPL, Version 1.2"),
)
_NAMED = (("MIT", "MIT"), ("ISC", "ISC"), ("BSD-2-Clause", "BSD 2-Clause"), ("BSD-3-Clause", "BSD 3-Clause"), ("0BSD", "0BSD"), ("Zlib", "zlib"), ("Unlicense", "Unlicense"))


def _families() -> list[tuple[str, str]]:
    """Notices of the GNU and Creative Commons families, of every version and variant."""
    out = []
    for name, kind, version in (
        ("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-2.0", "Library ", "2"), ("LGPL-2.1", "Lesser ", "2.1"), ("LGPL-3.0", "Lesser ", "3"), ("AGPL-3.0", "Affero ", "3"),
    ):
        out += [(name, f"{who} licensed under the GNU {kind}General Public License, version {version}.") for who in ("This work is", "This program is")]
        out.append((name, f"Licensed under the GNU {kind}General Public License v{version}"))
        for what in ("program", "library"):
            out.append(
                (name, f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published "
                 f"by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.")
            )
    words = {"SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}
    for variant in ("", "-SA", "-ND", "-NC", "-NC-SA", "-NC-ND"):
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            name = f"CC-BY{variant}-{version}"
            out.append((name, f"Licensed under CC BY{variant} {version}."))
            whole = "-".join(["Attribution", *[words[v] for v in variant.split("-")[1:]]])
            scope = "International" if version == "4.0" else "Unported"
            out.append((name, f"This work is licensed under a Creative Commons {whole} {version} {scope} License."))
    return out


TEMPLATES: tuple[tuple[str, str], ...] = tuple(
    dict.fromkeys((*_NOTICES, *_TEXTS, *_families(), *[(a, f"{how} under the {b} License.") for a, b in _NAMED for how in ("Released", "Licensed")]))
)

#: Words that tell siblings apart, besides versions: a place must hold those of its template and no others.
_VARIANTS = frozenset("lesser affero sa nc nd sharealike noncommercial noderivatives noderivs".split())
_VERSION = re.compile(r"v?\d+")


def telling(words: list[str]) -> frozenset[str]:
    return frozenset(w.removeprefix("v") if _VERSION.fullmatch(w) else w for w in words if w in _VARIANTS or _VERSION.fullmatch(w))


def normalised(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


@dataclass(frozen=True)
class _Template:
    name: str
    grams: Counter  # of word bigrams
    size: int
    low: float  # Dice >= least bounds the bigrams of a window from below
    high: int  # and from above
    told: frozenset[str]


class _Windows:
    """The best windows of one template in one text: from each place where one of its bigrams stands."""

    def __init__(self, of: _Template, hits: list[tuple[int, tuple[str, str]]], places: dict[str, np.ndarray], least: float) -> None:
        self.of, self.least = of, least
        self.at = np.array([i for i, _ in hits])
        # A bigram counts in a window as often as the template has it: where the occurrence that many
        # places before lies in the window too, it does not.
        self.blocked = np.full(len(hits), -1)
        earlier: dict[tuple[str, str], list[int]] = {}
        for n, (_, g) in enumerate(hits):
            own = earlier.setdefault(g, [])
            if len(own) >= of.grams[g]:
                self.blocked[n] = own[-of.grams[g]]
            own.append(n)
        self.end = np.searchsorted(self.at, self.at + of.high, side="left")  # no window is longer
        # Bounds of the last bigram: all that tells the template must be inside, nothing of a sibling.
        words = len(self.at) and int(self.at[-1]) + 2
        after = lambda x: np.append(x, words + 1)[np.searchsorted(x, self.at)]
        nothing = np.zeros(0, np.int64)
        needed = [after(places.get(t, nothing)) for t in of.told]
        others = [after(places[t]) for t in _VARIANTS - of.told if t in places]
        self.first_last = np.max(needed, axis=0) - 1 if needed else np.zeros(len(hits), np.int64)
        self.last_last = np.min(others, axis=0) - 2 if others else np.full(len(hits), words)

    def best(self, starts: np.ndarray, limit: int) -> list[tuple[int, float, int, int]]:
        """(start, dice, common, last hit) of the starts that have a window up to the word ``limit``: most in common, then the shortest."""
        width = int((self.end[starts] - starts).max(initial=0))
        reach = starts[:, None] + np.arange(width)
        inside = reach < self.end[starts][:, None]
        reach = np.minimum(reach, len(self.at) - 1)
        common = ((self.blocked[reach] < starts[:, None]) & inside).cumsum(1)
        last = self.at[reach]
        dice = 2 * common / (self.of.size + last - self.at[starts][:, None] + 1)
        ok = inside & (dice >= self.least) & (last + 2 <= limit)
        ok &= (last >= self.first_last[starts][:, None]) & (last <= self.last_last[starts][:, None])
        common = np.where(ok, common, -1)
        if not width:
            return []
        pick = common.argmax(1)
        row = np.arange(len(starts))
        return [
            (int(n), float(d), int(c), int(j))
            for n, d, c, j in zip(starts, dice[row, pick], common[row, pick], reach[row, pick], strict=True)
            if c >= 0
        ]


def scanner(templates: tuple[tuple[str, str], ...], least: float) -> Callable[[str], list[tuple[str, float, int, int]]]:
    """A function from a text to (licence, Dice, start, end): places with character offsets.

    Of overlapping places the one with most bigrams in common is taken first, then the one of the higher
    coefficient, then the earlier. Each start offers its best window; one that overlaps what is taken is
    looked up anew in what is left. So the work follows the length of a text, however often it
    repeats a wording.
    """
    known: list[_Template] = []
    starts: dict[tuple[str, str], list[int]] = {}
    for name, wording in templates:
        words = normalised(wording)
        grams = Counter(zip(words[:-1], words[1:], strict=True))
        for g in grams:
            starts.setdefault(g, []).append(len(known))
        size = sum(grams.values())
        known.append(_Template(name, grams, size, size * least / (2 - least) - 1e-9, int(size * (2 - least) / least + 1e-9), telling(words)))
    first_words = {g[0] for g in starts}

    def scan(text: str) -> list[tuple[str, float, int, int]]:
        words = normalised(text)
        hits: dict[int, list[tuple[int, tuple[str, str]]]] = {}
        for i, a in enumerate(words[:-1]):
            if a in first_words:
                for k in starts.get((a, words[i + 1]), ()):
                    hits.setdefault(k, []).append((i, (a, words[i + 1])))
        hits = {k: own for k, own in hits.items() if len(own) >= known[k].low}  # else not even all of them in one window would do
        if not hits:
            return []
        places: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            if w in _VARIANTS or _VERSION.fullmatch(w):
                places.setdefault(next(iter(telling([w]))), []).append(i)
        found = {t: np.array(x) for t, x in places.items()}
        offers: list[tuple] = []

        def offer(k: int, starts: np.ndarray, limit: int) -> None:
            own = windows[k]
            for n, dice, common, last in own.best(starts, limit):
                heapq.heappush(offers, (-common, -dice, int(own.at[n]), int(own.at[last]) + 2, known[k].name, k, n))

        windows = {k: _Windows(known[k], own, found, least) for k, own in hits.items()}
        for k, own in windows.items():
            for at in range(0, len(own.at), 2048):
                offer(k, np.arange(at, min(at + 2048, len(own.at))), len(words))
        taken: list[tuple[int, int]] = []  # in order
        out = []
        while offers:
            common, dice, i, j, name, k, n = heapq.heappop(offers)
            place = bisect.bisect_right(taken, (i, len(words) + 1))
            if place and taken[place - 1][1] > i:
                continue
            limit = taken[place][0] if place < len(taken) else len(words)
            if j > limit:
                offer(k, np.array([n]), limit)
                continue
            taken.insert(place, (i, j))
            out.append((name, -dice, i, j))
        if out:
            offsets = [m.span() for m in _TOKEN.finditer(text.lower())]
            out = [(name, dice, offsets[i][0], offsets[j - 1][1]) for name, dice, i, j in out]
        return sorted(out, key=lambda x: (x[2], x[0]))

    return scan


def license_notices(
    docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = 0.8
) -> DataFrame:
    """Places in whole texts of ``docs`` (doc_id, text) that read like a licence template.

    Texts are normalised to lower-case letters and digits. A place is a window of words that
    begins and ends with a bigram of the template, and holds its versions and variants (telling
    apart GPL-2.0 and GPL-3.0, or CC-BY and CC-BY-SA); templates whose size bounds rule out the
    coefficient are not compared. Of overlapping places the one that shares most bigrams stays.
    Templates are a fixed list, each text is scanned in its own task, and nothing is shuffled.
    Very long texts are scanned whole, repeated wording in time that follows their length.
    Defined cases: null, empty and one-word texts give no rows; ties go to the higher coefficient,
    then the earlier place; repeated rows give repeated results; offsets count characters of the
    lower-cased text; other columns are ignored.
    Returns doc_id, license, dice, start_at, end_at: one row per place.
    """
    small_batches(docs.sparkSession)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(templates, least)
        for batch in batches:
            at, rows = [], []
            for n, text in enumerate(batch.column("text")):
                found = scan(text.as_py() or "")
                rows += found
                at += [n] * len(found)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(at, pa.int64())),
                    pa.array([r[0] for r in rows], pa.string()),
                    pa.array([r[1] for r in rows], pa.float64()),
                    pa.array([r[2] for r in rows], pa.int32()),
                    pa.array([r[3] for r in rows], pa.int32()),
                ],
                names=["doc_id", "license", "dice", "start_at", "end_at"],
            )

    head = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}"
    return docs.select("doc_id", "text").mapInArrow(
        scanned, f"{head}, license string, dice double, start_at int, end_at int"
    )
