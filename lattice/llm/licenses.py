"""License scans with a generalised suffix automaton over the tokens of license templates.

The automaton holds every token substring of every template. A text streams through it and yields matching
statistics: for each position, the length of the longest template substring that ends there. Long maximal matches
are chained, in template order, into spans; spans that cover enough of a template add its label.
Phrases are templates too: a phrase stands where the current state's suffix-link path holds the phrase's own state.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattice.llm.words import ALNUM, map_docs, raw

#: Shortest match that may start or extend a chain, widest gap inside one, and least tokens of a chain, in tokens.
LEAST_MATCH, WIDEST_GAP, LEAST_COVER = 5, 8, 7

# Phrases and labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Labels and the wording of notices and license texts in general use.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
)

PLACES, SPANS = "array<struct<label:string,start:int>>", "array<struct<label:string,start:int,end:int,template:int>>"


@dataclass
class Scan:
    """Of one text: its words, the places of phrases, the covered spans and the largest covered share of a template."""

    n_words: int
    places: list[tuple[int, str]]
    spans: list[tuple[int, int, int]]
    score: float


class Automaton:
    """A generalised suffix automaton of token sequences."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for number, tokens in enumerate(sequences):
            last = 0
            for at, token in enumerate(tokens):
                last = self._extend(last, token)
                self.ends[last].add((number, at))
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]

    def _new(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.link) - 1

    def _clone(self, p: int, token: int, q: int) -> int:
        clone = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, token: int) -> int:
        q = self.next[last].get(token)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, token, q)
        now, p = self._new(self.length[last] + 1, {}, 0), last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = now
            p = self.link[p]
        if p >= 0:
            q = self.next[p][token]
            self.link[now] = q if self.length[q] == self.length[p] + 1 else self._clone(p, token, q)
        return now

    def step(self, state: int, length: int, token: int) -> tuple[int, int]:
        """The state and length of the longest substring that ends with ``token``."""
        while state and token not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        following = self.next[state].get(token)
        return (0, 0) if following is None else (following, length + 1)


class Licenses:
    """Scans texts for the phrases and templates."""

    def __init__(self, phrases=PHRASES, templates=TEMPLATES):
        self.phrases, self.templates = phrases, templates
        texts = [t.encode().translate(ALNUM).split() for t in [*(p for p, _ in phrases), *(t for _, t in templates)]]
        self.vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
        sequences = [[self.vocabulary[w] for w in t] for t in texts]
        self.lengths = [len(t) for t in texts]
        self.automaton = a = Automaton(sequences)
        self.of_state: dict[int, list[int]] = {}
        for k in range(len(phrases)):
            state = 0
            for token in sequences[k]:
                state = a.next[state][token]
            self.of_state[state] = [*self.of_state.get(state, []), k]
        for state in sorted(range(1, len(a.link)), key=a.length.__getitem__):
            if up := self.of_state.get(a.link[state]):
                self.of_state[state] = [*self.of_state.get(state, []), *up]
        n = len(self.vocabulary)
        self.pairs, self.phrase_pairs, self.alone = np.zeros((n + 1, n + 1), bool), np.zeros((n + 1, n + 1), bool), np.zeros(n + 1, bool)
        for k, s in enumerate(sequences):
            self.pairs[s[:-1], s[1:]] = True
            if k < len(phrases):
                self.phrase_pairs[s[:-1], s[1:]] = True
            if len(s) == 1:
                self.alone[s] = True
        notices = self.lengths[len(phrases) :]
        self.least = min([LEAST_MATCH, *(x for x in notices if x)])
        shortest = {label: min(x for x, (other, _) in zip(notices, templates, strict=True) if other == label) for label, _ in templates}
        said = {label: max(x for x, (_, other) in zip(self.lengths, phrases, strict=False) if other == label) for _, label in phrases}
        self.share = {label: n / shortest.get(label, n) for label, n in said.items()}  # of the shortest template, by its label's longest phrase

    def scan(self, text: bytes) -> Scan:
        words, get, none = text.translate(ALNUM).split(), self.vocabulary.get, len(self.vocabulary)
        ids = np.array([get(w, none) for w in words], np.int32)
        places: list[tuple[int, str]] = []
        matches: list[tuple[int, int, int]] = []
        for start, end in self._runs(ids):
            self._stream(ids[start : end + 1].tolist(), start, places, matches)
        spans, share = self._chain(matches)
        return Scan(len(words), sorted(places), spans, min(1.0, max([share, *(self.share[label] for _, label in places)])))

    def _runs(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Stretches of words, start to end inclusive, outside of which no phrase and no long match can lie."""
        hit = self.pairs[ids[:-1], ids[1:]] if len(ids) > 1 else np.zeros(0, bool)
        alone = self.alone[ids]
        if not hit.any() and not alone.any():
            return []
        edges = np.flatnonzero(np.diff(np.concatenate(([0], hit, [0])).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        said = np.concatenate(([0], np.cumsum(self.phrase_pairs[ids[:-1], ids[1:]])))
        single = np.concatenate(([0], np.cumsum(alone)))
        of_use = (ends - starts + 1 >= self.least) | (said[ends] > said[starts]) | (single[ends + 1] > single[starts])
        out = list(zip(starts[of_use].tolist(), ends[of_use].tolist(), strict=True))
        for start, end in out:
            alone[start : end + 1] = False
        return sorted(out + [(i, i) for i in np.flatnonzero(alone).tolist()])

    def _stream(self, tokens: list[int], at: int, places: list, matches: list) -> None:
        """Matching statistics of a run: phrase places, and maximal matches (start, end exclusive, state)."""
        a, state, length, before = self.automaton, 0, 0, (0, 0)
        for i, token in enumerate([*tokens, -1]):
            before, (state, length) = (state, length), a.step(state, length, token)
            if length <= before[1] and before[1] >= self.least:
                matches.append((at + i - before[1], at + i, before[0]))
            for k in self.of_state.get(state, ()):
                if self.lengths[k] <= length:
                    places.append((at + i + 1 - self.lengths[k], self.phrases[k][1]))

    def _chain(self, matches: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int, int]], float]:
        """Spans (start, end, template) with enough covered tokens, and the largest share of a template."""
        base, open_, done = len(self.phrases), {}, []
        for start, end, state in matches:
            for number, last in sorted(self.automaton.ends[state]):
                if number < base or end - start < min(LEAST_MATCH, self.lengths[number]):
                    continue
                first = last - (end - start) + 1
                chain = open_.get(number)
                if chain and start - chain[1] <= WIDEST_GAP and 0 <= first - chain[3] - 1 + (chain[1] - start if start < chain[1] else 0) <= 2 * WIDEST_GAP:
                    chain[2] += end - max(start, chain[1])
                    chain[1], chain[3] = end, last
                elif not chain or end - start > chain[2] or start >= chain[1]:
                    if chain:
                        done.append((number, chain))
                    open_[number] = [start, end, end - start, last]
        done += open_.items()
        spans = {(c[0], c[1], k - base) for k, c in done if c[2] >= min(LEAST_COVER, self.lengths[k])}
        share = max((c[2] / self.lengths[k] for k, c in done if c[2] >= min(LEAST_COVER, self.lengths[k])), default=0.0)
        return sorted(spans), min(1.0, share)


def scan_licenses(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, places, spans, score): a row for each row of ``docs``.

    places are (label, first word) of every phrase; spans are (label, first word, end word exclusive, number of the template).
    Words are numbered from 0. score is the largest share of a template that is covered, or of the shortest template of a phrase's label
    that the phrase makes; a phrase whose label has no template scores 1. A null or empty text has no words and score 0; very long
    texts are scanned whole. Repeated rows are rows of their own, ids may be null. Other columns are ignored; an empty table
    gives no rows.
    """
    known = Licenses(phrases, templates)

    def each(doc: int | None, text: bytes) -> tuple:
        found = known.scan(text)
        places = [{"label": label, "start": at} for at, label in found.places]
        spans = [{"label": templates[t][0], "start": a, "end": b, "template": t} for a, b, t in found.spans]
        return doc, found.n_words, places, spans, found.score

    return map_docs(docs, [F.col(id_col).cast("long"), raw(text_col)], f"doc_id long, n_words long, places {PLACES}, spans {SPANS}, score double", each)


def digest(found: DataFrame) -> DataFrame:
    """The counts, first and last place, joined labels and spans (label:template:start:end) of :func:`scan_licenses`."""
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    starts = F.transform("places", lambda p: p["start"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        joined(F.col("places.label")).alias("base_labels"),
        joined(F.concat("places.label", "spans.label")).alias("labels"),
        "score",
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["label"], s["template"], s["start"], s["end"])), ",").alias("spans"),
    )
