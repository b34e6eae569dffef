"""License scans: matching statistics of files against a generalised suffix automaton of license texts, chained to covered spans.

Texts are lower-cased (A-Z); words are runs of digits, a to z and characters outside ASCII. The automaton holds every run of
words of every template and phrase, one after the other; it is built once from a small table of texts (at most TOKENS words,
else an error, so what is broadcast is bounded) and a file's words are streamed through it: after each word its state is the
longest run of words ending there that some template has, found by suffix links. States know which phrases end in them, so
phrases are read off as they pass; and for runs of LEAST words or more, at which places of which templates they end, in the
state itself and along its suffix links, so a run that ends in one template while it goes on in another is not lost. A run that
its template cannot carry on is a match. The matches with one template are chained: in order in both, apart by GAP words at most
in each, by most words covered. A chain that covers SHARE of its template, or a template of
NOTICE words or fewer whole, is a span with the template's label. Words are
found by hash and then compared as bytes; words of no template clear the automaton, and single ones between such are skipped.

Cases: a null, empty or wordless text has neither phrases nor spans. Rows stay as they are, nulls and repeats included;
repeated and overlapping licenses give a span each; of equal chains the one that starts and ends first stays. An empty table
gives no rows. A text of any length is scanned whole, and memory follows the longest one. Columns other than doc_id and text
are not looked at.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm import session, text

LEAST, GAP, SHARE, TOKENS = 3, 12, 0.6, 1 << 20
#: Templates of up to so many words are spans only where they are covered whole: notices differ by single words.
NOTICE = 12

# Phrases with their labels, and public license texts and notices.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
TEMPLATES = [
    ("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("as-is-warranty", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("gpl-text", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2"),
    ("lgpl", "GNU Lesser General Public License"),
    ("agpl", "GNU Affero General Public License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("mit-notice", "released under the MIT License"),
    ("mit-notice", "licensed under the MIT License"),
    ("mit-notice", "SPDX-License-Identifier: MIT"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("cc-by-4.0", "licensed under CC BY 4.0"),
    ("cc-by-4.0", "Creative Commons Attribution 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("all-rights-reserved", "all rights reserved"),
]

HITS, SPANS = "array<struct<label:string,start:long,length:long>>", "array<struct<label:string,start:long,end:long,covered:long,share:double>>"


def split(line: str) -> list[bytes]:
    """The words of a text, as bytes."""
    return re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", line.translate({c: c + 32 for c in range(65, 91)}).encode())


@dataclass
class Automaton:
    """The generalised suffix automaton of several sequences of numbers: state 0 is the start."""

    moves: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    size: list[int] = field(default_factory=lambda: [0])

    def _state(self, size: int, link: int, moves: dict[int, int]) -> int:
        self.moves.append(moves)
        self.link.append(link)
        self.size.append(size)
        return len(self.size) - 1

    def _split(self, at: int, token: int, to: int) -> int:
        """A state for the run that `at` makes with the token, apart from longer ones in `to`; the runs that are as short lead to it from now on."""
        copy = self._state(self.size[at] + 1, self.link[to], dict(self.moves[to]))
        self.link[to] = copy
        while at >= 0 and self.moves[at].get(token) == to:
            self.moves[at][token] = copy
            at = self.link[at]
        return copy

    def add(self, tokens: list[int]) -> None:
        """Every run of the sequence."""
        last = 0
        for token in tokens:
            to = self.moves[last].get(token)
            if to is not None:
                last = to if self.size[to] == self.size[last] + 1 else self._split(last, token, to)
                continue
            new, at = self._state(self.size[last] + 1, 0, {}), last
            while at >= 0 and token not in self.moves[at]:
                self.moves[at][token] = new
                at = self.link[at]
            if at >= 0:
                to = self.moves[at][token]
                self.link[new] = to if self.size[to] == self.size[at] + 1 else self._split(at, token, to)
            last = new

    def walk(self, tokens: list[int]) -> list[int]:
        """The states that a known run leads through."""
        at, out = 0, []
        for token in tokens:
            at = self.moves[at][token]
            out.append(at)
        return out

    def step(self, at: int, length: int, token: int) -> tuple[int, int]:
        """State and length of the longest known run that ends with the token after the one of `length` in state `at`."""
        moves = self.moves
        while at and token not in moves[at]:
            at = self.link[at]
            length = self.size[at]
        return (moves[at][token], length + 1) if token in moves[at] else (0, 0)


class Matcher:
    """Phrases and templates in an automaton, and what its states say of them."""

    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str], least: int = LEAST):
        lines = [split(t) for _, t in templates]
        places = [(label, split(p)) for p, label in phrases.items()]
        if sum(map(len, lines)) + sum(len(p) for _, p in places) > TOKENS:
            raise ValueError(f"templates and phrases: more than {TOKENS} words")
        self.labels, self.sizes, self.least = [label for label, _ in templates], list(map(len, lines)), least
        self.words = sorted({w for line in [*lines, *[p for _, p in places]] for w in line})
        number = {w: k for k, w in enumerate(self.words)}
        lines, named = [[number[w] for w in line] for line in lines], [[number[w] for w in p] for _, p in places]
        self.automaton = Automaton()
        for line in [*lines, *named]:
            self.automaton.add(line)
        states = len(self.automaton.size)
        own: list[list[tuple[int, int]]] = [[] for _ in range(states)]
        for k, line in enumerate(lines):
            for end, at in enumerate(self.automaton.walk(line), 1):
                own[at].append((k, end))
        #: By state, (template, end, longest run that ends there) of its own runs and of those along its links.
        self.ends: list[list[tuple[int, int, int]]] = [[] for _ in range(states)]
        for at in sorted(range(1, states), key=self.automaton.size.__getitem__, reverse=True):
            if self.automaton.size[at] >= least:
                own[self.automaton.link[at]] += own[at] if self.automaton.link[at] else []
        #: By state, (phrase's label, its size) of phrases that end in it or along its links.
        self.phrases: list[list[tuple[str, int]]] = [[] for _ in range(states)]
        for (label, _), line in zip(places, named):
            self.phrases[self.automaton.walk(line)[-1]].append((label, len(line)))
        for at in sorted(range(1, states), key=self.automaton.size.__getitem__):
            above = self.automaton.link[at]
            self.phrases[at] = self.phrases[at] + self.phrases[above]
            if self.automaton.size[at] >= least:
                mine = set(own[at])
                self.ends[at] = [(k, end, self.automaton.size[at]) for k, end in sorted(mine)] + [x for x in self.ends[above] if x[:2] not in mine]
        data = np.frombuffer(b" ".join(self.words), np.uint8)
        hashes, *_ = text.words(data, np.array([0, len(data)]), text.PLAIN) if self.words else (np.zeros(0, np.uint64),)
        order = np.argsort(hashes)
        self.shortest = min([least, *[len(line) for line in named]])
        self.hashes, self.numbers = hashes[order], order

    def tokens(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and numbers of the known words that stand next to known words."""
        if not len(self.hashes) or not len(hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        to = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        known = self.hashes[to] == hashes
        beside = np.zeros(len(known), bool)
        pair = known[1:] & known[:-1] & (rows[1:] == rows[:-1])
        beside[1:] |= pair
        beside[:-1] |= pair
        at = np.flatnonzero(beside if self.shortest > 1 else known)
        number = self.numbers[to[at]]
        same = [data[i:j].tobytes() == self.words[w] for i, j, w in zip(starts[at].tolist(), ends[at].tolist(), number.tolist())]
        return at[same], number[same]

    def stream(self, places: list[int], numbers: list[int]) -> tuple[list[tuple[str, int, int]], list[tuple[int, int, int, int]]]:
        """Phrases (label, start, size) and matches (template, start, end, template's end) of known words and their places in the text."""
        hits, matches = [], []
        at = length = 0
        live: dict[tuple[int, int], tuple[int, int]] = {}  # by template and distance of ends: where the run starts, where it has come to
        before = -2
        for place, token in zip(places, numbers):
            if place != before + 1:
                at = length = 0
            at, length = self.automaton.step(at, length, token)
            before = place
            for label, size in self.phrases[at]:
                if size <= length:
                    hits.append((label, place + 1 - size, size))
            now = {}
            if length >= self.least:
                for k, end, longest in self.ends[at]:
                    key = (k, end - place)
                    now[key] = live.pop(key)[0] if key in live else place + 1 - min(length, longest), place + 1
            matches += [(k, start, end, shift + end - 1) for (k, shift), (start, end) in live.items()]
            live = now
        matches += [(k, start, end, shift + end - 1) for (k, shift), (start, end) in live.items()]
        return hits, matches

    def spans(self, matches: list[tuple[int, int, int, int]], gap: int, share: float) -> list[tuple[str, int, int, int, float]]:
        """(label, start, end, words covered, share of the template) of the best chains of a text's matches."""
        out = []
        for k in sorted({m[0] for m in matches}):
            for start, end, covered in chains(sorted((s, e, to - (e - s), to) for own, s, e, to in matches if own == k), gap):
                if covered >= (share if self.sizes[k] > NOTICE else 1.0) * self.sizes[k]:
                    out.append((self.labels[k], start, end, covered, min(1.0, covered / self.sizes[k])))
        return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def chains(matches: list[tuple[int, int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """Of matches (start, end, template start, template end) in order, the chains by most words covered: start, end, words.

    A match follows another that starts and ends before it in both, gap words apart at most in each; what overlaps counts once.
    Each match is in one chain: the best comes first, and what leads to a match that is taken ends there.
    """
    best: list[tuple[int, int]] = []  # words covered up to a match, the match before it
    near: list[int] = []
    for i, (start, end, t_start, t_end) in enumerate(matches):
        near = [j for j in near if matches[j][1] + gap >= start]
        found = (end - start, -1)
        for j in near:
            s, e, ts, te = matches[j]
            over = max(0, e - start, te - t_start)
            if s < start and e < end and ts < t_start and te < t_end and t_start - te <= gap and over < end - start:
                found = max(found, (best[j][0] + end - start - over, j))
        best.append(found)
        near.append(i)
    out, taken = [], set()
    for i in sorted(range(len(matches)), key=lambda i: (-best[i][0], matches[i])):
        if i in taken:
            continue
        at, first = i, i
        while at >= 0 and at not in taken:
            taken.add(at)
            first, at = at, best[at][1]
        covered = best[i][0] - (best[at][0] if at >= 0 else 0)
        out.append((matches[first][0], matches[i][1], covered))
    return sorted(out)


def _scan(shared: Broadcast, gap: int, share: float):
    def run(batches):
        matcher = shared.value
        for batch in batches:
            for at, to, data, offs in text.pieces(batch.column(1)):
                n = to - at
                hashes, rows, starts, ends = text.words(data, offs, text.PLAIN)
                places, numbers = matcher.tokens(hashes, text._LOWER[data], starts, ends, rows)
                first = np.searchsorted(rows, np.arange(n + 1))
                bounds = np.searchsorted(places, first)
                hits, spans, sizes = [], [], np.zeros((2, n + 1), np.int64)
                for k in np.flatnonzero(np.diff(bounds)).tolist():
                    i, j = bounds[k], bounds[k + 1]
                    found, matches = matcher.stream((places[i:j] - first[k]).tolist(), numbers[i:j].tolist())
                    covered = matcher.spans(matches, gap, share)
                    hits += sorted(found, key=lambda x: (x[1], x[0], x[2]))
                    spans += covered
                    sizes[:, k + 1] = len(found), len(covered)
                told = []
                for rows_of, size, names in ((hits, sizes[0], ("label", "start", "length")), (spans, sizes[1], ("label", "start", "end", "covered", "share"))):
                    kinds = [pa.string(), *[pa.int64()] * 2, *([pa.int64(), pa.float64()] if len(names) > 3 else [])]
                    columns = [pa.array([r[c] for r in rows_of], kind) for c, kind in enumerate(kinds)]
                    told.append(pa.ListArray.from_arrays(pa.array(np.cumsum(size).astype(np.int32)), pa.StructArray.from_arrays(columns, list(names))))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(np.diff(first).astype(np.int64)), *told], ["doc_id", "n_words", "phrases", "spans"])

    return run


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, least: int = LEAST, gap: int = GAP, share: float = SHARE) -> DataFrame:
    """doc_id, n_words, phrases (label, start, length) and spans (label, start, end, covered, share) of every row (doc_id, text), in words."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(Matcher(templates, phrases, least))
    return slim.mapInArrow(_scan(shared, gap, share), f"doc_id long, n_words long, phrases {HITS}, spans {SPANS}")


def op12_license_scan(spark, sf_dir: str) -> DataFrame:
    """Every document of `documents`: places and labels of phrases, labels of covered templates, and the greatest share covered (1 for a phrase)."""
    session.workers_find_package(spark)
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    own, added = F.col("phrases.label"), F.col("spans.label")
    score = F.when(F.size("phrases") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("spans.share"), F.lit(0.0)))
    starts = F.col("phrases.start")
    return found.select("doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), joined(own).alias("base_labels"), joined(F.concat(own, added)).alias("labels"), score.alias("score"), "spans")
