"""License scans by template markup: wording that must be there, regions that may be left out, regions that may hold anything.

A template is compiled into an automaton over words: one state for each word of its wording, ``<<beginOptional>>`` ... ``<<endOptional>>``
an edge past what it encloses (regions may nest), ``<<var;max=n>>`` up to n words of any kind. A text holds the license where a run of the
automaton ends; a single word of the wording that differs, is missing or stands in between ends the run. Runs begin where two neighbouring words can be a template's
first two, found for whole batches at once, so a text without such a pair costs no more than its words. Plain phrases are templates without markup.

Words are runs of letters and digits of ASCII (A-Z as a-z) and of everything beyond ASCII; words are compared by 64-bit hashes.

Defined cases: a null text is empty; empty texts have no words and no places; of runs from one word the longest counts, runs from different words may overlap; repeated rows
and ids are rows as any other; texts are scanned whole; an empty table gives no rows; columns of df named as the result's are replaced, others stay.
"""

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelight.llm.words import flat, scan, slices

# --- fixed values: wordings of licenses and of their usual notices, with what may vary in them
TEMPLATES = [
    ("mit", True, "mit license"),
    ("apache", True, "apache license"),
    ("gpl", True, "general public license"),
    ("mit", False, "<<beginOptional>>this <<var;max=3>> is<<endOptional>> <<beginOptional>>released<<endOptional>> <<beginOptional>>licensed<<endOptional>> <<beginOptional>>distributed<<endOptional>> under the <<beginOptional>>terms of the<<endOptional>> mit license"),
    ("apache-2.0", False, "licensed under the apache license <<beginOptional>>version<<endOptional>> 2 <<beginOptional>>0<<endOptional>>"),
    ("gpl-2.0", False, "licensed under <<beginOptional>>the terms of<<endOptional>> the gnu general public license <<beginOptional>>version<<endOptional>> 2 <<beginOptional>>0<<endOptional>>"),
    ("gpl-3.0", False, "licensed under <<beginOptional>>the terms of<<endOptional>> the gnu general public license <<beginOptional>>version<<endOptional>> 3 <<beginOptional>>0<<endOptional>>"),
    ("cc-by-4.0", False, "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> cc by 4 0"),
    ("cc-by-sa-4.0", False, "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> cc by sa 4 0"),
    ("cc-by-nc-4.0", False, "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> cc by nc 4 0"),
    ("cc-by-4.0", False, "creative commons attribution 4 0 <<beginOptional>>international<<endOptional>> license"),
    ("cc-by-nc-4.0", False, "creative commons attribution noncommercial 4 0 <<beginOptional>>international<<endOptional>> license"),
    ("mit", False, """
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without
        restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
        Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall
        be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE <<var;max=12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN
        AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("isc", False, """
        Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice
        and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<var;max=12>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;max=12>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
        PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("bsd", False, """
        Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<beginOptional>>1.<<endOptional>> Redistributions of
        source code must retain the above copyright notice, this list of conditions and the following disclaimer. <<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
        <<beginOptional>><<beginOptional>>3.<<endOptional>> Neither the name of <<var;max=12>> nor the names of its contributors may be used to endorse or promote products derived from this software
        without specific prior written permission.<<endOptional>> THIS SOFTWARE IS PROVIDED BY <<var;max=12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES"""),
    ("apache-2.0", False, """
        Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
        <<beginOptional>>http<<endOptional>><<beginOptional>>https<<endOptional>> www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is
        distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("gpl-or-later", False, """
        <<beginOptional>>this program<<endOptional>> is free software<<beginOptional>>:<<endOptional>> you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
        Foundation<<beginOptional>>;<<endOptional>> either version <<var;max=2>> of the License, or <<beginOptional>>(at your option)<<endOptional>> any later version"""),
]

MARK = re.compile(r"<<(beginOptional|endOptional|var;max=(\d+))>>")
BETWEEN = np.ones(256, bool)  # bytes that stand between words
BETWEEN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
PLACES = "array<struct<label:string,phrase:boolean,first:bigint,end:bigint>>"
ANY = None


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


class Automaton(NamedTuple):
    """word[i] leads from state i to the next (ANY: every word); reach[i]: states that i stands for, its own and those past regions that may be left out."""

    word: list[str | None]
    reach: list[frozenset[int]]


def parsed(markup: str) -> Iterator[tuple[str, str | int]]:
    at = 0
    for m in MARK.finditer(markup):
        yield from (("word", w) for w in words_of(markup[at : m.start()]))
        at = m.end()
        yield ("any", int(m[2])) if m[2] else (m[1], 0)
    yield from (("word", w) for w in words_of(markup[at:]))


def compiled(markup: str) -> Automaton:
    word, past, open_ = [], [], []  # past: (from, to) edges that read no word
    for kind, value in parsed(markup):
        if kind == "word":
            word.append(value)
        elif kind == "any":
            past += [(len(word) + i, len(word) + value) for i in range(value)]
            word += [ANY] * value
        elif kind == "beginOptional":
            open_.append(len(word))
        else:
            past.append((open_.pop(), len(word)))
    if open_:
        raise ValueError("an optional region is not closed")
    reach: list[frozenset[int]] = [frozenset()] * (len(word) + 1)
    for i in reversed(range(len(word) + 1)):
        reach[i] = frozenset({i}).union(*(reach[b] for a, b in past if a == i and b > i))
    if any(i == len(word) or word[i] is ANY for i in reach[0]):
        raise ValueError("a template begins with wording")
    return Automaton(word, reach)


def step(a: Automaton, states: frozenset[int], word) -> frozenset[int]:
    return frozenset().union(*(a.reach[i + 1] for i in states if i < len(a.word) and (a.word[i] is ANY or a.word[i] == word)))


def first_pairs(a: Automaton) -> set[tuple[str, str | None]]:
    """What two words a run can begin with; the second is ANY where one word is all, too."""
    out = set()
    for i in a.reach[0]:
        if i < len(a.word):
            for j in a.reach[i + 1]:
                out.add((a.word[i], a.word[j] if j < len(a.word) else ANY))
    return out


class Templates:
    """Automata over numbers of words; runs are tried where a pair of words allows it."""

    def __init__(self, templates: list[tuple[str, bool, str]]):
        automata = [compiled(markup) for _, _, markup in templates]
        known = sorted({w for a in automata for w in a.word if w is not ANY})
        scanned = scan(pa.array(known), BETWEEN)
        hashes = scanned.hashes(fold=True)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        number = {known[i]: n + 1 for n, i in enumerate(order)}  # 0: any other word
        self.of = [(label, phrase, Automaton([ANY if w is ANY else number[w] for w in a.word], a.reach)) for (label, phrase, _), a in zip(templates, automata, strict=True)]
        self.wide = len(known) + 1
        pairs: dict[int, list[int]] = {}
        for t, (_, _, a) in enumerate(self.of):
            for x, y in first_pairs(a):
                for q in [y] if y is not ANY else range(self.wide):
                    of = pairs.setdefault(x * self.wide + q, [])
                    if t not in of:
                        of.append(t)
        self.pairs = pairs
        self.begins = np.zeros(self.wide**2, bool)
        self.begins[list(pairs)] = True

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at + 1, 0)

    def places(self, numbers: np.ndarray, doc: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, str, bool, int, int]]:
        """(text, label, phrase, first word, word after the last) of all places in a batch of texts."""
        after = np.zeros(len(numbers), np.int64)
        after[:-1] = np.where(doc[1:] == doc[:-1], numbers[1:], 0)
        for at in np.flatnonzero(self.begins[numbers * self.wide + after]):
            stop = int(first[doc[at] + 1])
            for t in self.pairs[int(numbers[at]) * self.wide + int(after[at])]:
                label, phrase, a = self.of[t]
                states, end, i = a.reach[0], None, int(at)
                while states and i < stop:
                    states, i = step(a, states, int(numbers[i])), i + 1
                    if len(a.word) in states:
                        end = i
                if end is not None:
                    yield int(doc[at]), label, phrase, int(at - first[doc[at]]), end - int(first[doc[at]])


def scan_licenses(df: DataFrame, text: str = "text", templates: list[tuple[str, bool, str]] | None = None) -> DataFrame:
    """df's other columns with n_words, places (label, phrase, first, end; words from 0, end is past the last) and n_covered, the number of words in any place.

    templates: (label, whether it is a plain phrase, markup)."""
    chosen = TEMPLATES if templates is None else templates
    kept = [c for c in df.columns if c.lower() not in (text.lower(), "n_words", "places", "n_covered")]
    rows = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias(text))
    schema = T.StructType([*rows.schema.fields[:-1], *T._parse_datatype_string(f"n_words long, places {PLACES}, n_covered long").fields])
    place = pa.list_(pa.struct([("label", pa.string()), ("phrase", pa.bool_()), ("first", pa.int64()), ("end", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(chosen)
        for batch in batches:
            texts = flat(batch.column(len(batch.columns) - 1))
            for low, high in slices(texts):
                words = scan(texts.slice(low, high - low), BETWEEN)
                numbers = known.numbers(words.hashes(fold=True))
                found: list[list[dict]] = [[] for _ in range(high - low)]
                covered = np.zeros(len(numbers) + 1, np.int64)
                for doc, label, phrase, begin, end in known.places(numbers, words.doc, words.first):
                    found[doc].append({"label": label, "phrase": phrase, "first": begin, "end": end})
                    covered[words.first[doc] + begin] += 1
                    covered[words.first[doc] + end] -= 1
                inside = np.concatenate([[0], np.cumsum(np.cumsum(covered)[:-1] > 0)])
                columns = [c.slice(low, high - low) for c in batch.columns[:-1]]
                counts = [pa.array(np.diff(words.first)), pa.array(found, place), pa.array(inside[words.first[1:]] - inside[words.first[:-1]])]
                yield pa.RecordBatch.from_arrays([*columns, *counts], [*kept, "n_words", "places", "n_covered"])

    return rows.mapInArrow(find, schema)


def pattern(markup: str) -> str:
    """A template as a regular expression over words with one space after each: for SQL and tests, which do not use the automaton."""
    out = ""
    for kind, value in parsed(markup):
        out += {"word": f"{value} ", "any": f"(?:[^ ]+ ){{0,{value}}}", "beginOptional": "(?:", "endOptional": ")?"}[kind]
    return out
