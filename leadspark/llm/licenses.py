"""License notices by template markup.

A template is words with optional and replaceable regions:

    <<beginOptional>> words <<endOptional>>      these words may be absent
    <<var;name=x;original=y;match=2>>            up to so many arbitrary words (here 2)

Each template compiles into a small automaton over word hashes.  A place of a text is
accepted when the automaton consumes words from there to the template's end; so all
mandatory wording must stand there word for word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textnum import ALNUM, lean, small_batches, steps, word_hashes, words

# The base phrases with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# License notices that refer to a license, as (label, template).
NOTICES = [
    ("apache-2.0", "licensed under the apache license <<beginOptional>> version <<endOptional>> 2 0"),
    ("apache-2.0", "apache license <<beginOptional>> version <<endOptional>> 2 0"),
    ("bsd", "<<var;name=verb;original=released;match=1>> under the <<beginOptional>> new <<endOptional>> bsd <<var;name=clauses;original=3 clause;match=2>> license"),
    ("cc-by-4.0", "licensed under <<beginOptional>> a <<endOptional>> <<beginOptional>> the <<endOptional>> cc by 4 0"),
    ("cc-by-nc-4.0", "licensed under <<beginOptional>> a <<endOptional>> <<beginOptional>> the <<endOptional>> cc by nc <<beginOptional>> 4 0 <<endOptional>>"),
    ("cc-by-nc-4.0", "creative commons attribution noncommercial <<var;name=version;original=4 0;match=2>> <<beginOptional>> international <<endOptional>> license"),
    ("cc-by-sa-4.0", "licensed under <<beginOptional>> a <<endOptional>> <<beginOptional>> the <<endOptional>> cc by sa <<beginOptional>> 4 0 <<endOptional>>"),
    ("gpl-2.0", "licensed under the <<beginOptional>> gnu <<endOptional>> general public license version 2"),
    ("gpl-3.0", "licensed under the <<beginOptional>> gnu <<endOptional>> general public license version 3"),
    ("mit", "<<var;name=verb;original=released;match=1>> under the <<beginOptional>> terms of the <<endOptional>> mit license"),
    ("mpl-2.0", "mozilla public license <<beginOptional>> version <<endOptional>> 2 0"),
    ("reserved", "copyright <<beginOptional>> c <<endOptional>> <<var;name=holder;original=name;match=6>> all rights reserved"),
]

_BSD_START = """
    Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
    following conditions are met: <<var;name=bullet1;original=1.;match=1>> Redistributions of source code must retain the above copyright notice,
    this list of conditions and the following disclaimer. <<var;name=bullet2;original=2.;match=1>> Redistributions in binary form must reproduce
    the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
    materials provided with the distribution."""
_BSD_END = """
    THIS SOFTWARE IS PROVIDED BY <<var;name=who;original=THE COPYRIGHT HOLDERS AND CONTRIBUTORS;match=8>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
    INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
    DISCLAIMED. IN NO EVENT SHALL <<var;name=party;original=THE COPYRIGHT HOLDER OR CONTRIBUTORS;match=8>> BE LIABLE FOR ANY DIRECT, INDIRECT,
    INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
    GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
    LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
    OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GNU_END = """
    This <<var;name=kind;original=program;match=2>> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
    implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
_GNU = """
    <<var;name=what;original=This program;match=3>> is free software you can redistribute it and/or modify it under the terms of the GNU {0} as published
    by the Free Software Foundation either version {1} of the License, or <<beginOptional>> at your option <<endOptional>> any later version.""" + _GNU_END

# Whole licenses, and the headers that the long ones ask for, as (label, template).
LICENSES = [
    ("mit", """
    Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
    documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
    rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
    persons to whom the Software is furnished to do so, subject to the following conditions:
    The above copyright notice and this permission notice <<beginOptional>> (including the next paragraph) <<endOptional>> shall be included in all copies or
    substantial portions of the Software.
    THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
    WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
    <<var;name=party;original=THE AUTHORS OR COPYRIGHT HOLDERS;match=8>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
    TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("isc", """
    Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
    provided that the above copyright notice and this permission notice appear in all copies.
    THE SOFTWARE IS PROVIDED "AS IS" AND <<var;name=who;original=THE AUTHOR;match=6>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
    WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;name=party;original=THE AUTHOR;match=6>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
    CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
    CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("bsd-2-clause", _BSD_START + _BSD_END),
    ("bsd-3-clause", _BSD_START + """
    <<var;name=bullet3;original=3.;match=1>> Neither the name of <<var;name=organization;original=the copyright holder;match=8>> nor the names of its contributors may be used to endorse or
    promote products derived from this software without specific prior written permission.""" + _BSD_END),
    ("zlib", """
    This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
    for any damages arising from the use of this software.
    Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
    and redistribute it freely, subject to the following restrictions:
    <<var;name=bullet1;original=1.;match=1>> The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use
    this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
    <<var;name=bullet2;original=2.;match=1>> Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
    <<var;name=bullet3;original=3.;match=1>> This notice may not be removed or altered from any source distribution."""),
    ("bsl-1.0", """
    Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
    accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
    transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software
    is furnished to do so, all subject to the following:"""),
    ("apache-2.0", """
    Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
    License. You may obtain a copy of the License at <<var;name=scheme;original=http;match=1>> www.apache.org/licenses/LICENSE-2.0
    Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
    "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
    language governing permissions and limitations under the License."""),
    ("mpl-2.0", """
    This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
    distributed with this file, You can obtain one at <<var;name=scheme;original=http;match=1>> mozilla.org/MPL/2.0/"""),
    ("gpl-2.0", _GNU.format("General Public License", "2")),
    ("gpl-3.0", _GNU.format("General Public License", "3")),
    ("lgpl-2.1", _GNU.format("Lesser General Public License", "2.1")),
    ("lgpl-3.0", _GNU.format("Lesser General Public License", "3")),
    ("agpl-3.0", _GNU.format("Affero General Public License", "3")),
    ("unlicense", """
    This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
    compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
    commercial or non-commercial, and by any means."""),
]
TEMPLATES = NOTICES + LICENSES

_MARK = re.compile(r"<<(.*?)>>")


def hashes_of(text: str) -> list[int]:
    out: list[int] = []
    for _, _, data, offs in steps(pa.array([text], pa.string())):
        starts, ends, _ = words(data, offs, ALNUM)
        out += word_hashes(data, starts, ends).tolist()
    return out


class Automaton:
    """States 0..end; from a state, a word leads on by its hash, any word may lead on, or no word is needed."""

    def __init__(self, template: str):
        self.by_word: list[dict[int, int]] = [{}]
        self.any_word: list[list[int]] = [[]]
        self.free: list[list[int]] = [[]]
        opened: list[int] = []
        at = 0
        for k, part in enumerate(_MARK.split(template)):
            if k % 2 == 0:
                for h in hashes_of(part):
                    at = self._add(at, by_word=h)
            elif part == "beginOptional":
                opened.append(at)
            elif part == "endOptional":
                start = opened.pop()
                at = self._add(at)
                self.free[start].append(at)
            elif part.startswith("var;"):
                most = int(re.search(r"match=(\d+)", part)[1])
                start, inner = at, [at]
                for _ in range(most):
                    at = self._add(at, any_word=True)
                    inner.append(at)
                at = self._add(at)
                for x in inner[:-1]:
                    self.free[x].append(at)
                del start
            else:
                raise ValueError(f"unknown mark-up: {part}")
        if opened:
            raise ValueError("an optional region does not end")
        self.end = at
        self.first = self._closure({0})
        self.starts = None if any(self.any_word[s] for s in self.first) else {h for s in self.first for h in self.by_word[s]}

    def _add(self, at: int, by_word: int | None = None, any_word: bool = False) -> int:
        new = len(self.free)
        self.by_word.append({})
        self.any_word.append([])
        self.free.append([])
        if by_word is not None:
            self.by_word[at][by_word] = new
        elif any_word:
            self.any_word[at].append(new)
        else:
            self.free[at].append(new)
        return new

    def _closure(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    def longest(self, tokens: list[int], at: int) -> int:
        """The end of the longest accepted run of words from `at`, or -1."""
        states, found = self.first, -1
        while True:
            if self.end in states:
                found = at
            if at >= len(tokens):
                return found
            word = tokens[at]
            states = {t for s in states for t in self.any_word[s]} | {self.by_word[s][word] for s in states if word in self.by_word[s]}
            if not states:
                return found
            states, at = self._closure(states), at + 1


class Scanner:
    """Phrases and templates, and the words that one of them cannot do without."""

    def __init__(self, phrases: dict[str, str], templates: list[tuple[str, str]]):
        self.phrases = [(np.array(hashes_of(p), dtype=np.uint64), label) for p, label in phrases.items()]
        self.automata = [(label, Automaton(t), *self._needed(t)) for label, t in templates]
        need = {h for _, _, n, _ in self.automata for h in n} | {int(p[-1]) for p, _ in self.phrases}
        self.rare = np.array(sorted(need), dtype=np.uint64)

    @staticmethod
    def _needed(template: str) -> tuple[list[int], int]:
        """(the mandatory words, how many words may stand before the first of them)."""
        needed: list[int] = []
        inside = lead = 0
        for k, part in enumerate(_MARK.split(template)):
            if k % 2:
                inside += (part == "beginOptional") - (part == "endOptional")
                if part.startswith("var;") and not needed:
                    lead += int(re.search(r"match=(\d+)", part)[1])
            elif not inside:
                needed += hashes_of(part)
            elif not needed:
                lead += len(hashes_of(part))
        if not needed:
            raise ValueError("a template needs mandatory words")
        return needed, lead

    def scan(self, tokens: np.ndarray) -> tuple[list[tuple[int, str]], list[tuple[int, int, str]]]:
        """(base places with labels, template runs with labels) in one text."""
        places = []
        for p, label in self.phrases:
            ok = np.ones(max(0, len(tokens) - len(p) + 1), dtype=bool)
            for j, h in enumerate(p):
                ok &= tokens[j : len(ok) + j] == h
            places += [(int(i), label) for i in np.flatnonzero(ok)]
        runs, have, listed = [], None, None
        for label, automaton, needed, lead in self.automata:
            if have is None:
                have = set(tokens[np.isin(tokens, self.rare)].tolist())
            if not have.issuperset(needed):
                continue
            if listed is None:
                listed = tokens.tolist()
            if automaton.starts is None:  # any word may stand first: start before the first mandatory word
                at = sorted({int(i) - k for i in np.flatnonzero(tokens == np.uint64(needed[0])) for k in range(lead + 1) if i >= k})
            else:
                at = np.flatnonzero(np.isin(tokens, np.array(sorted(automaton.starts), dtype=np.uint64))).tolist()
            for i in at:
                end = automaton.longest(listed, i)
                if end > i:
                    runs.append((i, end, label))
        first: dict[tuple[int, str], int] = {}  # of runs to the same end, the longest
        for i, end, label in sorted(runs):
            first.setdefault((end, label), i)
        return sorted(places), sorted((i, end, label) for (end, label), i in first.items())


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row for each row of docs(doc_id, text) with its phrases and license notices.

    Columns doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and
    notices: the accepted runs as (first_word, end_word, label).  Words are runs of ASCII letters
    and digits and of characters beyond ASCII, with A-Z read as a-z.  score is 1 with an
    accepted notice, 0.5 with a phrase alone, else 0.  A null text is empty; rows are
    independent; other columns are ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Scanner(PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates))
    notice = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("label", pa.string())]))
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "notices"]
    kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64(), notice]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = shared.value
        nothing = (0, None, None, "", "", 0.0, [])
        for b in batches:
            rows: list[tuple] = []
            for lo, hi, data, offs in steps(b.column("text")):
                starts, ends, at = words(data, offs, ALNUM)
                h = word_hashes(data, starts, ends)
                near = np.minimum(np.searchsorted(scanner.rare, h), len(scanner.rare) - 1) if len(scanner.rare) else np.zeros(len(h), np.int64)
                hit = scanner.rare[near] == h if len(scanner.rare) else np.zeros(len(h), bool)
                some = np.diff(np.concatenate([[0], np.cumsum(hit)])[at]) > 0
                for r in range(hi - lo):
                    found = nothing
                    if some[r]:
                        places, runs = scanner.scan(h[at[r] : at[r + 1]])
                        if places or runs:
                            base = ",".join(sorted({p[1] for p in places}))
                            every = ",".join(sorted({p[1] for p in places} | {x[2] for x in runs}))
                            score = 1.0 if runs else 0.5
                            found = (len(places), places[0][0] if places else None, places[-1][0] if places else None, base, every, score, [{"first_word": i, "end_word": e, "label": x} for i, e, x in runs])
                    rows.append((int(at[r + 1] - at[r]), *found))
            cols = [b.column("doc_id").cast(pa.int64()), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds[1:]))]
            yield pa.record_batch(cols, names)

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, notices array<struct<first_word:long,end_word:long,label:string>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), schema)
