"""License scans by template-markup matching (operator 12).

A license is a template: its wording, with `[...]` around optional regions (they may nest) and
`<name:least-most>` for replaceable ones of so many words (copyright holders, product names, list
marks). Each template is compiled into a token automaton; a place is accepted if the mandatory
wording stands there exactly, word for word, with nothing between it but what the markup allows.
Base phrases are templates without markup.

A text is turned into words (A-Z in lower case; every other run of ASCII that is no digit or letter
separates). One Aho-Corasick pass finds the anchors, the words with which a template begins;
from each anchor the template's automaton reads on. It is made deterministic as it is used, so
a word costs one lookup. Work is linear in a text: a run ends with its template's longest form.

`scan` returns all matches with label and word span; `score` is the largest share of a template's
mandatory words that stand in order from one of its anchors, 1 if a template is accepted, 0
without anchor. So a license text with one altered word has no label, but a score above 0.

Defined results: null and empty texts have no words, labels or places; overlapping places all
count; repeated rows are all returned; long texts are read whole; an empty input gives an empty
result; only id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_texts, text_or_empty

# Phrases with their labels, and wordings of public licenses and of their usual notices.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
TEMPLATES = (
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice [(including the next paragraph)] shall be included in all copies
        or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <holders:1-30> BE LIABLE
        FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
        SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"""),
    ("bsd-2", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
        are met: <mark:0-1> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        <mark:0-1> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY <holders:1-30> AS IS AND ANY EXPRESS OR
        IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
        IN NO EVENT SHALL <holders:1-30> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
        LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
        THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
        SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"""),
    ("bsd-3", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
        are met: <mark:0-1> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        <mark:0-1> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution. <mark:0-1> Neither the name of <holders:1-30> nor the names of [its]
        contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS
        PROVIDED BY <holders:1-30> AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY
        AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <holders:1-30> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
        EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
        BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
        OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
        above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <holders:1-30> DISCLAIMS ALL
        WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <holders:1-30> BE LIABLE
        FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
        ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE"""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will <holders:1-30> be held liable for any damages
        arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and
        to alter it and redistribute it freely, subject to the following restrictions"""),
    ("apache-2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
        obtain a copy of the License at [http] [https] [www] apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the
        License for the specific language governing permissions and limitations under the License"""),
    ("gpl-2", "free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("gpl-3", "free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License"),
    ("lgpl-2.1", "free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("lgpl-3", "free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License"),
    ("agpl-3", "free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation; either version 3 of the License"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, [v] [version] 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("boost-1", "Distributed under the Boost Software License, Version 1.0"),
    ("gpl-2", "GNU General Public License [(GPL)] [v] [version] 2"),
    ("gpl-3", "GNU General Public License [(GPL)] [v] [version] 3"),
    ("gpl-2", "GNU General Public License [(GPL)] v2"),
    ("gpl-3", "GNU General Public License [(GPL)] v3"),
    ("gpl-2", "GNU GPL [license] [version] 2"),
    ("gpl-3", "GNU GPL [license] [version] 3"),
    ("gpl-2", "GNU GPL v2"),
    ("gpl-3", "GNU GPL v3"),
    ("lgpl-2.1", "GNU Lesser General Public License [(LGPL)] [version] 2.1"),
    ("lgpl-3", "GNU Lesser General Public License [(LGPL)] [version] 3"),
    ("agpl-3", "GNU Affero General Public License [(AGPL)] [version] 3"),
    ("mpl-2", "Mozilla Public License [(MPL)] [version] 2"),
    ("mit", "the MIT License"),
    ("cc0", "CC0 1.0 [Universal]"),
    ("cc-by", "Creative Commons Attribution [<version:1-1> 0] [International] License"),
    ("cc-by-sa", "Creative Commons Attribution-ShareAlike [<version:1-1> 0]"),
    ("cc-by-nc", "Creative Commons Attribution-NonCommercial [<version:1-1> 0]"),
    ("cc-by-nd", "Creative Commons Attribution-NoDerivatives [<version:1-1> 0]"),
    ("cc-by-sa", "CC BY SA"),
    ("cc-by-nd", "CC BY ND"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("apache-2", "SPDX-License-Identifier: Apache-2.0"),
    ("bsd-2", "SPDX-License-Identifier: BSD-2-Clause"),
    ("bsd-3", "SPDX-License-Identifier: BSD-3-Clause"),
    ("isc", "SPDX-License-Identifier: ISC"),
    ("gpl-2", "SPDX-License-Identifier: GPL-2.0"),
    ("gpl-3", "SPDX-License-Identifier: GPL-3.0"),
    ("lgpl-2.1", "SPDX-License-Identifier: LGPL-2.1"),
    ("lgpl-3", "SPDX-License-Identifier: LGPL-3.0"),
    ("agpl-3", "SPDX-License-Identifier: AGPL-3.0"),
    ("mpl-2", "SPDX-License-Identifier: MPL-2.0"),
)

#: Bytes of separators become spaces, A-Z become a-z.
_TO_WORDS = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_GAPS = re.compile(b"  +")
#: Words of an anchor at most; deterministic states that one automaton remembers before it starts anew.
ANCHOR, MEMO = 4, 20_000
_MARKUP = re.compile(r"\[|\]|<[^:<>]*:(\d+)-(\d+)>|[^\[\]<>]+")


def spaced(text: str | None) -> str:
    """The words of a text, each between single spaces; one space if there is none."""
    flat = _GAPS.sub(b" ", (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS)).strip(b" ")
    return f" {flat.decode('utf-8', 'surrogatepass')} " if flat else " "


class Automaton:
    """A template as a token automaton; `run` reads words from a place.

    The steps are words, ANY (a replaceable word) and jumps: a set of steps that may come next
    is a state, made when it is first reached.
    """

    ANY, SKIP = object(), object()

    def __init__(self, label: str, template: str, base: bool = False):
        self.label, self.base = label, base
        #: (word or ANY, None) or (SKIP, step behind the optional region); the last step is acceptance.
        self.steps: list[tuple] = []
        #: Mandatory words before each step.
        self.before: list[int] = []
        self.mandatory = 0
        opened: list[int] = []
        for token in _MARKUP.finditer(template):
            if token[0] == "[":
                opened.append(len(self.steps))
                self._add(self.SKIP, None)
            elif token[0] == "]":
                self.steps[opened.pop()] = (self.SKIP, len(self.steps))
            elif token[1]:
                least, most = int(token[1]), int(token[2])
                for k in range(most):
                    if k >= least:
                        self._add(self.SKIP, len(self.steps) + 2 * (most - k))
                    self._add(self.ANY, None)
            else:
                for word in spaced(token[0]).split():
                    self._add(word, None)
                    self.mandatory += not opened
        if opened:
            raise ValueError(f"an optional region of {label} has no end")
        self.before.append(self.mandatory)
        self.anchor = self._anchor()
        self.words = {w for w, _ in self.steps if isinstance(w, str)}
        self._forget()

    def _add(self, step: object, to: int | None) -> None:
        self.steps.append((step, to))
        self.before.append(self.mandatory)

    def _anchor(self) -> tuple[str, ...]:
        first = []
        for step, _ in self.steps[:ANCHOR]:
            if not isinstance(step, str):
                break
            first.append(step)
        if not first:
            raise ValueError(f"the template of {self.label} begins with markup")
        return tuple(first)

    def _forget(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.next: list[dict] = []
        self.accepts: list[bool] = []
        self.passed: list[int] = []
        self.start = self._state(self._closed({len(self.anchor)}))

    def _closed(self, steps: set[int]) -> frozenset:
        """The steps that can be read next: jumps over optional regions taken and not taken."""
        found, todo = set(), list(steps)
        while todo:
            at = todo.pop()
            if at in found:
                continue
            found.add(at)
            if at < len(self.steps) and self.steps[at][0] is self.SKIP:
                todo += [at + 1, self.steps[at][1]]
        return frozenset(s for s in found if s == len(self.steps) or self.steps[s][0] is not self.SKIP)

    def _state(self, steps: frozenset) -> int:
        at = self.states.get(steps)
        if at is None:
            at = self.states[steps] = len(self.sets)
            self.sets.append(steps)
            self.next.append({})
            self.accepts.append(len(self.steps) in steps)
            self.passed.append(max((self.before[s] for s in steps), default=0))
        return at

    def _read(self, state: int, word: str | None) -> int:
        after = {s + 1 for s in self.sets[state] if s < len(self.steps) and (self.steps[s][0] is self.ANY or self.steps[s][0] == word)}
        at = self._state(self._closed(after)) if after else -1
        self.next[state][word] = at
        return at

    def run(self, words: Iterator[str], start: int) -> tuple[int | None, int]:
        """The end of the longest accepted form whose anchor stands before `words`, at `start`, None if there
        is none; and how many mandatory words were passed."""
        if len(self.sets) > MEMO:
            self._forget()
        state, at = self.start, start + len(self.anchor)
        end, passed = at if self.accepts[state] else None, self.passed[state]
        if self.sets[state] == {len(self.steps)}:
            return end, passed  # the anchor is the whole template
        for word in words:
            word = word if word in self.words else None
            state = found if (found := self.next[state].get(word)) is not None else self._read(state, word)
            if state < 0:
                break
            at += 1
            passed = max(passed, self.passed[state])
            if self.accepts[state]:
                end = at
        return end, passed


class Match(NamedTuple):
    label: str
    base: bool
    start: int
    end: int


def _words_from(text: str, place: int) -> Iterator[str]:
    """The words behind the space at `place`, one at a time."""
    while (stop := text.find(" ", place + 1)) > 0:
        yield text[place + 1 : stop]
        place = stop


class Scanner:
    def __init__(self, base: tuple = BASE, templates: tuple = TEMPLATES):
        self.automata = [Automaton(label, phrase, True) for label, phrase in base] + [Automaton(label, text) for label, text in templates]
        by_anchor: dict[str, list[Automaton]] = {}
        for automaton in self.automata:
            by_anchor.setdefault(f" {' '.join(automaton.anchor)} ", []).append(automaton)
        self.anchors = ahocorasick.Automaton()
        for anchor, automata in by_anchor.items():
            self.anchors.add_word(anchor, automata)
        self.anchors.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[Match], float]:
        """Number of words, matches by start, score."""
        text = spaced(text)
        found, score, counted, n = [], 0.0, 0, 0
        for last, automata in self.anchors.iter(text):
            n, counted = n + text.count(" ", counted, last), last  # words before the anchor's last space
            for automaton in automata:
                start = n - len(automaton.anchor)
                end, passed = automaton.run(_words_from(text, last), start)
                if end is not None:
                    found.append(Match(automaton.label, automaton.base, start, end))
                score = max(score, 1.0 if end is not None else passed / automaton.mandatory)
        return n + text.count(" ", counted) - 1, sorted(found, key=lambda m: (m.start, m.end, m.label, not m.base)), score


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: tuple = BASE, templates: tuple = TEMPLATES) -> DataFrame:
    """One row per input row: id, n_words, matches array<struct<label, base, start, end>>, score. Spans count words, ends exclusive."""
    kind = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("end", pa.int64())]))

    def make():
        scanner = Scanner(base, templates)

        def apply(texts: list, columns: dict) -> dict:
            rows = [scanner.scan(t) for t in texts]
            return {"id": columns["id"], "n_words": [r[0] for r in rows], "matches": pa.array([[m._asdict() for m in r[1]] for r in rows], kind), "score": [r[2] for r in rows]}

        return apply

    rows = docs.select(text_or_empty(text_col).alias("text"), F.col(id_col).cast("long").alias("id"))
    return map_texts(rows, make, "id long, n_words long, matches array<struct<label:string,base:boolean,start:long,end:long>>, score double").withColumnRenamed("id", id_col)


def op12_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir)).withColumn("_base", F.filter("matches", lambda m: m["base"]))
    labels = lambda matches: F.array_join(F.array_sort(F.array_distinct(F.transform(matches, lambda m: m["label"]))), ",")
    starts = F.transform("_base", lambda m: m["start"])
    return found.select(
        "doc_id", "n_words", F.size("_base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(F.col("_base")).alias("base_labels"), labels(F.col("matches")).alias("labels"), "score", F.size("matches").cast("long").alias("n_matches"),
    )
