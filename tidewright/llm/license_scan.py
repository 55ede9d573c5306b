"""License scans: a trained paragraph classifier, confirmed by comparison with templates.

Lines are read without comment marks; blank ones (a lone mark is blank) part paragraphs.  A paragraph
with a cue word (``CUES``, a word the templates use to speak of licences) is classified by its lines with
a cue, by their clauses (parts between ``JOINING`` words), and whole if it has at most ``WHOLE`` words, otherwise by windows of consecutive lines of about ``STEP`` words (a very long
line counts as several), those with a cue.  So wrapped notices, comment blocks and texts without blank
lines are found alike.  The classifier is multinomial logistic regression over sparse word 1- to
3-grams, learned from generated variants of the templates and paragraphs that grant nothing.
Probabilities are calibrated by a temperature fitted on held-out ones, unknown included.  Every family
of at least ``PROBABILITY`` is compared with its templates: over windows of words around, as long as the
template (and as pieces of ``PIECE`` words of a long one), the share of its trigrams that the window
holds must reach ``CONFIRM``.  A short heading or an
SPDX line is a template as well; headings of two words or fewer must be the whole line.  A family's
confirmed lines that follow each other are one report.

The model is trained here; nothing labels licences in the corpus.  It is the same for every input.

Defined results: null text counts as empty; a text without a reported paragraph has an empty list;
whole texts are read; repeated rows give repeated results; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import ship

PROBABILITY, CONFIRM, WHOLE, STEP, PIECE, VARIANTS, EPOCHS = 0.05, 0.6, 60, 40, 24, 60, 12
UNKNOWN = "unknown"
#: Notices by which licences are granted, and paragraphs of their bodies, by family.
WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS"'
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0", "Apache License Version 2.0, January 2004", "SPDX-License-Identifier: Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license",
    ],
    "mit": [
        "Released under the MIT License", "The MIT License (MIT)", "This project is licensed under the terms of the MIT license", "Licensed under the MIT License", "SPDX-License-Identifier: MIT", "MIT License",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        WARRANTY + ", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "bsd": [
        "Licensed under the BSD 3-Clause License", "Licensed under the BSD 2-Clause License", "Use of this source code is governed by a BSD-style license", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause", "BSD 3-Clause License", "BSD 2-Clause License", "BSD License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES',
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU GPL v2 or later", "GNU General Public License Version 3, 29 June 2007", "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-2.0-only", "GNU General Public License",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    ],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: LGPL-2.1-or-later", "You should have received a copy of the GNU Lesser General Public License along with this library", "GNU Lesser General Public License"],
    "agpl": ["Licensed under the GNU Affero General Public License, version 3", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: AGPL-3.0-only", "You should have received a copy of the GNU Affero General Public License along with this program", "GNU Affero General Public License"],
    "mpl-2.0": ["Licensed under the Mozilla Public License, version 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/", "SPDX-License-Identifier: MPL-2.0", "Mozilla Public License Version 2.0"],
    "isc": ["Licensed under the ISC License", "SPDX-License-Identifier: ISC", "ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS'],
    "zlib": ["Licensed under the zlib License", "SPDX-License-Identifier: Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."],
    "unlicense": ["Released under the Unlicense", "SPDX-License-Identifier: Unlicense", "This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "cc0": ["Released under CC0 1.0 Universal", "SPDX-License-Identifier: CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "dedicated to the public domain under Creative Commons Zero"],
    "cc-by": ["Licensed under CC BY 4.0", "SPDX-License-Identifier: CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "SPDX-License-Identifier: CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "SPDX-License-Identifier: CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-nd": ["Licensed under CC BY-ND 4.0", "SPDX-License-Identifier: CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "proprietary": ["All rights reserved", "This software is proprietary and confidential; unauthorized copying of this file, via any medium, is strictly prohibited"],
}
#: Words by which the notices speak of licences.
CUES = frozenset("license licensed licence licenced licenses licensing apache mit bsd gnu gpl lgpl agpl affero lesser mozilla mpl isc unlicense unencumbered cc cc0 commons copyright copyrights rights reserved proprietary confidential warranties permission hereby redistribution redistribute redistributions software domain compliance waived endorse spdx zlib copyleft warranty disclaims".split())
#: Short names of the families; ``SHORT`` says how a line names one.
NAMES = {
    "apache-2.0": "Apache-2.0 | Apache 2.0 | Apache 2 | Apache v2 | Apache License 2.0", "mit": "MIT", "bsd": "BSD | BSD-3-Clause | BSD-2-Clause", "gpl": "GPL | GPLv2 | GPLv3 | GPL v2 | GPL v3 | GPL-2.0 | GPL-3.0 | GNU GPL | GNU GPLv2 | GNU GPLv3 | GNU GPL v2 | GNU GPL v3",
    "lgpl": "LGPL | LGPLv2.1 | LGPLv3 | LGPL v2.1 | LGPL v3 | GNU LGPL | GNU LGPL v3", "agpl": "AGPL | AGPLv3 | AGPL v3 | GNU AGPL v3 | GNU AGPLv3", "mpl-2.0": "MPL 2.0 | MPL-2.0 | MPLv2", "isc": "ISC", "zlib": "zlib", "unlicense": "Unlicense | The Unlicense",
    "cc0": "CC0 | CC0-1.0 | CC0 1.0", "cc-by": "CC BY 4.0 | CC-BY-4.0", "cc-by-sa": "CC BY-SA 4.0 | CC-BY-SA-4.0", "cc-by-nc": "CC BY-NC 4.0 | CC-BY-NC-4.0", "cc-by-nd": "CC BY-ND 4.0 | CC-BY-ND-4.0",
}
SHORT = ("License: {}", "Licensed under {}", "Licensed under the {}", "Released under the {}")
#: An SPDX line and what its expression is made of; what follows WITH is an exception, no licence.
SPDX = re.compile(r"SPDX-License-Identifier:[^\S\n]*([A-Za-z0-9.+()\x20-]*[A-Za-z0-9.+)])", re.I)
SPDX_WORD = re.compile(r"(?:WITH\x20+)?[A-Za-z0-9.+-]+", re.I)
JOINING = frozenset("or and".split())
#: What begins a comment's line, or is all of it.
MARK = re.compile(r"[^\S\n]*(?:(?:#+|//+!?|/\*+|\*+/?|--+|;+|%+|>+|<!--|-->|'''|\"\"\"|REM\b)[^\S\n]*)*")
WORD = re.compile(r"[^\W_]+")
CUE = re.compile(r"(?<![^\W_])(?:" + "|".join(sorted(CUES)) + r")(?![^\W_])", re.I)


def words_of(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def ngrams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)}


def trigrams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}


class Paragraph:
    """Words of consecutive lines, with the line of each and where lines stand in the text."""

    def __init__(self) -> None:
        self.words: list[str] = []
        self.line_of: list[int] = []
        self.lines: list[tuple[int, int]] = []
        self.cues: list[int] = []
        self._held: set[str] | None = None

    def held(self) -> set[str]:
        """All trigrams of a paragraph that is complete."""
        if self._held is None:
            self._held = trigrams(self.words)
        return self._held

    def add(self, text: str, start: int, end: int) -> None:
        for m in WORD.finditer(text, start, end):
            word = m[0].lower()
            if word in CUES:
                self.cues.append(len(self.words))
            self.words.append(word)
            self.line_of.append(len(self.lines))
        self.lines.append((start, end))

    def windows(self, whole: int, step: int) -> Iterator[tuple[int, int]]:
        """Word ranges to classify: lines with a cue, and all, or the lines of about ``step`` words and of twice that with a cue."""
        n = len(self.words)
        for line in sorted({self.line_of[k] for k in self.cues}) if len(self.lines) > 1 else ():
            a, b = bisect_left(self.line_of, line), bisect_left(self.line_of, line + 1)
            if b - a < whole:
                yield a, b
        for line in sorted({self.line_of[k] for k in self.cues}):
            a, b = bisect_left(self.line_of, line), bisect_left(self.line_of, line + 1)
            if b - a < whole:
                yield from self.clauses(a, b)
        if n <= whole:
            yield 0, n
            return
        cuts = [0]
        for k in range(1, n):
            if k - cuts[-1] >= step and (self.line_of[k] != self.line_of[k - 1] or k - cuts[-1] >= 2 * step):
                cuts.append(k)
        cuts.append(n)
        for a, b in [*zip(cuts, cuts[1:]), *zip(cuts, cuts[2:])]:
            at = bisect_left(self.cues, a)
            if at < len(self.cues) and self.cues[at] < b:
                yield a, b

    def clauses(self, a: int, b: int) -> Iterator[tuple[int, int]]:
        """The parts of a line between words that join clauses, if there are several: each may name another licence."""
        cuts = [a - 1, *(k for k in range(a, b) if self.words[k] in JOINING), b]
        for low, high in zip(cuts, cuts[1:]) if len(cuts) > 2 else ():
            if high - low > 2 and not CUES.isdisjoint(self.words[low + 1 : high]):
                yield low + 1, high

    def span(self, a: int, b: int) -> tuple[int, int]:
        """Where the lines of a range of words stand in the text."""
        return self.lines[self.line_of[a]][0], self.lines[self.line_of[b - 1]][1]


def paragraphs(text: str) -> Iterator[Paragraph]:
    """The paragraphs of a text that have a cue, without comment marks."""
    part, at = Paragraph(), 0
    while at <= len(text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        start = MARK.match(text, at, stop).end()
        end = start + len(text[start:stop].rstrip())
        if start < end:
            part.add(text, start, end)
        elif part.lines:
            if part.cues:
                yield part
            part = Paragraph()
        at = stop + 1
    if part.cues:
        yield part


def _variants(rnd: random.Random) -> Iterator[tuple[str, str]]:
    """Training paragraphs: templates in other settings, and paragraphs that grant no licence."""
    made = ["".join(rnd.choice("abcdefghijklmnoprstuvwz") for _ in range(rnd.randint(2, 9))) for _ in range(3000)]

    def prose(low: int, high: int) -> str:
        return " ".join(rnd.choice(made) for _ in range(rnd.randint(low, high)))

    spare = ["the software runs on any machine", "a driving license", "copyright law in europe", "human rights", "the public domain of the name", "permission to leave", "mit der zeit", "general public opinion", "a free person", "the version of the file", "source of the river", "cc the team on the mail", "commons debate", "the gnu herd crossed the river", "license plate number", "apache helicopter", "he reserved a table", "compliance report of the year"]
    everyday = "the a of to in and is for on with this that from was are not by as at it you may any all under terms use copy work without or see file version free".split()
    phrases = [w for notices in TEMPLATES.values() for x in notices for w in x.split()]
    for _ in range(6 * VARIANTS):
        # the templates' words out of order, and everyday words
        yield UNKNOWN, " ".join(rnd.choice(phrases if rnd.random() < 0.3 else everyday if rnd.random() < 0.5 else made) for _ in range(rnd.randint(6, 60)))
    for family, notices in TEMPLATES.items():
        for notice in notices:
            words = notice.split()
            for k in range(VARIANTS // len(notices) + 4):
                if k % 5 == 4 and len(words) > 30:
                    # a window need not begin with the notice
                    at = rnd.randint(0, len(words) - 25)
                    yield family, " ".join(words[at : at + rnd.randint(22, 60)])
                    continue
                kept = [w for w in words if rnd.random() > 0.06] if len(words) > 9 and k % 3 else words
                lead = prose(1, 12) + rnd.choice([". ", " ", ": "]) if k % 4 == 1 else "Copyright (c) 20%02d %s. " % (rnd.randint(0, 40), prose(1, 2)) if k % 4 == 2 else ""
                yield family, lead + " ".join(kept) + rnd.choice([".", "", ". " + prose(2, 9)])
    for family, names in NAMES.items():
        lines = [form.format(name) for name in names.split(" | ") for form in SHORT]
        for _ in range(VARIANTS // 2):
            yield family, rnd.choice(["", prose(1, 6) + ". "]) + rnd.choice(lines) + rnd.choice(["", ".", ", " + prose(1, 6)])
    for _ in range(10 * VARIANTS):
        text = prose(3, 40)
        for _ in range(rnd.randint(0, 3)):
            text += " " + (rnd.choice(spare) if rnd.random() < 0.7 else rnd.choice(sorted(CUES))) + " " + prose(0, 12)
        yield UNKNOWN, text


@lru_cache(maxsize=1)
def default_model() -> dict:
    return train()


def train() -> dict:
    rnd = random.Random(314)
    templates = {f: [words_of(x) for x in xs] for f, xs in TEMPLATES.items()}
    # a name must be there word for word, or one family's would confirm another's
    short = {f: [words_of(form.format(name)) for name in names.split(" | ") for form in SHORT] for f, names in NAMES.items()}
    classes = [UNKNOWN, *TEMPLATES]
    made = [(f, words_of(t)) for f, t in _variants(rnd)]
    # learned: what occurs in several of the paragraphs that grant something
    often = Counter(g for f, words in made if f != UNKNOWN for g in ngrams(words))
    vocabulary = {g: i for i, g in enumerate(sorted(g for g, n in often.items() if n >= 3))}
    data = [(classes.index(f), features(vocabulary, words)) for f, words in made]
    rnd.shuffle(data)
    held, fitted = data[: len(data) // 5], data[len(data) // 5 :]
    w, b = np.zeros((len(vocabulary), len(classes))), np.zeros(len(classes))
    b[0] = 2.0
    g2, b2 = np.full_like(w, 1e-3), np.full_like(b, 1e-3)
    for _ in range(EPOCHS):
        for y, f in fitted:
            z = b + w[f].sum(axis=0)
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            if len(f):
                d = p + 1e-4 * w[f].mean(axis=0)
                g2[f] += d * d
                w[f] -= 0.1 * d / np.sqrt(g2[f])
            b2 += p * p
            b -= 0.1 * p / np.sqrt(b2)
    scores = np.array([b + w[f].sum(axis=0) for _, f in held])
    truth = np.array([y for y, _ in held])

    def loss(t: float) -> float:
        z = scores / t
        z -= z.max(axis=1, keepdims=True)
        return float(-(z[np.arange(len(z)), truth] - np.log(np.exp(z).sum(axis=1))).mean())

    return {"classes": classes, "vocabulary": vocabulary, "w": w, "b": b, "temperature": min((0.5 * 1.1**k for k in range(40)), key=loss), "templates": {f: [(len(y), trigrams(y), CONFIRM) for x in xs for y in pieces(x)] + [(len(x), trigrams(x), 1.0) for x in short.get(f, ())] for f, xs in templates.items()}}


def pieces(words: list[str]) -> list[list[str]]:
    """A long template is compared by pieces of about ``PIECE`` words too, so that a part of it confirms."""
    n = max(1, round(len(words) / PIECE))
    return [words[k * len(words) // n : (k + 1) * len(words) // n] for k in range(n)] + [words] * (n > 1)


def features(vocabulary: dict[str, int], words: list[str]) -> list[int]:
    return sorted(vocabulary[g] for g in ngrams(words) if g in vocabulary)


def classify(model: dict, words: list[str]) -> list[tuple[str, float]]:
    """(family, calibrated probability) of each family that may be meant."""
    z = (model["b"] + model["w"][features(model["vocabulary"], words)].sum(axis=0)) / model["temperature"]
    p = np.exp(z - z.max())
    p /= p.sum()
    return [(model["classes"][k], float(p[k])) for k in np.flatnonzero(p >= PROBABILITY).tolist() if k]


def confirm(part: Paragraph, low: int, high: int, size: int, template: set[str]) -> tuple[float, int, int]:
    """(share of the template's trigrams, first and last word) of the window around that holds most of them."""
    if size < 3:
        for line in {part.line_of[k] for k in range(low, high)}:
            a = bisect_left(part.line_of, line)
            b = bisect_left(part.line_of, line + 1)
            if " ".join(part.words[a:b]) in template:
                return 1.0, a, b
        return 0.0, low, low
    low, high = max(0, low - size), min(len(part.words), high + size)
    at = [k for k in range(low, high - 2) if " ".join(part.words[k : k + 3]) in template]
    reach, best, first, held = size + size // 4, (0.0, low, low), 0, Counter()
    for k in at:
        held[" ".join(part.words[k : k + 3])] += 1
        while at[first] + reach < k + 3:
            gone = " ".join(part.words[at[first] : at[first] + 3])
            held[gone] -= 1
            if not held[gone]:
                del held[gone]
            first += 1
        best = max(best, (len(held) / len(template), at[first], k + 3), key=lambda x: x[0])
    return best


def scan(text: str, model: dict) -> list[tuple[int, int, str, float, float]]:
    """(start, end, family, probability, likeness) of the lines that grant a licence."""
    if not CUE.search(text):
        return []
    out = []
    for part in paragraphs(text):
        found: dict[str, list[tuple[int, int, float, float]]] = {}
        for low, high in part.windows(WHOLE, STEP):
            for family, p in classify(model, part.words[low:high]):
                # no window holds more of a template than the paragraph does
                held = part.held()
                likely = [x for x in model["templates"][family] if x[0] < 3 or len(x[1] & held) >= x[2] * len(x[1])]
                compared = ((confirm(part, low, high, size, t), least) for size, t, least in likely)
                found.setdefault(family, []).extend((a, b, p, like) for (like, a, b), least in compared if like >= least)
        for family, ranges in found.items():
            joined: list[list] = []
            for a, b, p, like in sorted(ranges):
                if joined and part.line_of[a] <= part.line_of[joined[-1][1] - 1] + 1:
                    joined[-1] = [joined[-1][0], max(b, joined[-1][1]), max(p, joined[-1][2]), max(like, joined[-1][3])]
                else:
                    joined.append([a, b, p, like])
            out += [(*part.span(a, b), family, p, like) for a, b, p, like in joined]
    return sorted(out + [x for x in spdx(text, model) if not any(y[2] == x[2] and y[0] < x[1] and x[0] < y[1] for y in out)])


def spdx(text: str, model: dict) -> list[tuple[int, int, str, float, float]]:
    """What each identifier of an SPDX expression names: classified and compared as if it stood alone on its line."""
    out = []
    for m in SPDX.finditer(text):
        for name in SPDX_WORD.findall(m[1]):
            if name.upper() in ("AND", "OR") or name.upper().startswith("WITH "):
                continue
            words = words_of(f"SPDX-License-Identifier: {name}")
            for family, p in classify(model, words):
                like = max((len(t & trigrams(words)) / len(t) for _, t, _ in model["templates"][family]), default=0.0)
                if like >= CONFIRM and (m.start(), m.end(), family) not in [x[:3] for x in out]:
                    out.append((m.start(), m.end(), family, p, like))
    return out


# --- Spark --------------------------------------------------------------------------------------

SCHEMA = "doc_id long, families array<string>, starts array<int>, ends array<int>, probabilities array<double>, likeness array<double>"


def find_licenses(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): the licence paragraphs in order (code points, end exclusive)."""
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(default_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64()))
        for batch in batches:
            found = [scan(t or "", model.value) for t in batch.column(1).to_pylist()]
            cols = [[[x[k] for x in xs] for xs in found] for k in (2, 0, 1, 3, 4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], names=["doc_id", "families", "starts", "ends", "probabilities", "likeness"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    """One row per document: its families, paragraphs as family:start:end, and the least sure one's probability."""
    listed = F.transform(F.arrays_zip("families", "starts", "ends"), lambda x: F.concat_ws(":", x["families"], x["starts"].cast("string"), x["ends"].cast("string")))
    return found.select("doc_id", F.array_join(F.array_sort(F.array_distinct("families")), ",").alias("licenses"), F.size("families").cast("long").alias("n_paragraphs"), F.array_join(listed, ",").alias("paragraphs"), F.array_min("probabilities").alias("probability"))
