"""Licence scans by a generalised suffix automaton of licence tokens.

The automaton holds every run of tokens of every template. A text streams through it
once: at each token it gives the longest run that ends there and occurs in a template
(the matching statistic). Long runs of one template that follow one another in text and
template are chained into spans, and a chain that covers enough of its template labels
the text. The base phrases are templates too; a phrase ends at a token when its state
lies on the suffix links of the statistic there.

A null text is empty. An empty text has no words, no labels and score 0.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddlework.llm.common import per_row, text_bytes

# The base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Public licence notices.
TEMPLATES = {
    "apache-2.0": (
        "licensed under the apache license version 2 0 the license you may not use this file except in "
        "compliance with the license you may obtain a copy of the license at http www apache org licenses "
        "license 2 0 unless required by applicable law or agreed to in writing software distributed under "
        "the license is distributed on an as is basis without warranties or conditions of any kind either "
        "express or implied see the license for the specific language governing permissions and limitations "
        "under the license"
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted "
        "provided that the following conditions are met redistributions of source code must retain the "
        "above copyright notice this list of conditions and the following disclaimer"
    ),
    "cc-by-4.0": (
        "this work is licensed under a creative commons attribution 4 0 international license to view a "
        "copy of this license visit http creativecommons org licenses by 4 0"
    ),
    "gpl-notice": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu "
        "general public license as published by the free software foundation either version 3 of the license "
        "or at your option any later version this program is distributed in the hope that it will be useful "
        "but without any warranty without even the implied warranty of merchantability or fitness for a "
        "particular purpose"
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee "
        "is hereby granted provided that the above copyright notice and this permission notice appear in "
        "all copies"
    ),
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and "
        "associated documentation files the software to deal in the software without restriction including "
        "without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
        "copies of the software and to permit persons to whom the software is furnished to do so"
    ),
    "mpl-2.0": (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the "
        "mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0"
    ),
    "unlicense": (
        "this is free and unencumbered software released into the public domain anyone is free to copy "
        "modify publish use compile sell or distribute this software"
    ),
}

WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")

MIN_RUN = 4
"""Shorter runs of template tokens count for nothing: they are common in any prose."""
MAX_GAP = 12
"""Tokens of the text that may lie between two chained runs."""
MIN_COVER = 0.5
"""Share of a template's tokens that a chain must cover to label the text."""


class Automaton:
    """A suffix automaton over several token sequences, with where each state ends."""

    def __init__(self, templates: dict[str, list[bytes]], phrases: dict[bytes, str]):
        self.step: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.tokens = {name: len(words) for name, words in templates.items()}
        marks: dict[int, set[tuple[str, int]]] = {}
        self.phrases: list[tuple[tuple[int, str], ...]] = []
        known = [(name, words) for name, words in templates.items()] + [(None, p.split()) for p in phrases]
        for name, words in known:
            last = 0
            for at, word in enumerate(words):
                last = self._extend(last, word)
                if name:
                    marks.setdefault(last, set()).add((name, at))
        ends: list[list[tuple[int, str]]] = [[] for _ in self.step]
        for phrase, label in phrases.items():
            state, words = 0, phrase.split()
            for word in words:
                state = self.step[state][word]
            ends[state].append((len(words), label))
        order = sorted(range(1, len(self.step)), key=self.length.__getitem__)
        for state in reversed(order):
            if self.link[state] > 0 and state in marks:
                marks.setdefault(self.link[state], set()).update(marks[state])
        for state in order:
            ends[state] = ends[state] + ends[self.link[state]]
        self.phrases = [tuple(e) for e in ends]
        self.marks = [tuple(sorted(marks.get(s, ()))) for s in range(len(self.step))]
        self.alphabet = {word for step in self.step for word in step}

    def _extend(self, last: int, word: bytes) -> int:
        step, link, length = self.step, self.link, self.length
        if word in step[last]:
            there = step[last][word]
            return there if length[there] == length[last] + 1 else self._split(last, word, there)
        new = self._state(length[last] + 1, {})
        at = last
        while at >= 0 and word not in step[at]:
            step[at][word] = new
            at = link[at]
        if at < 0:
            link[new] = 0
        else:
            there = step[at][word]
            link[new] = there if length[there] == length[at] + 1 else self._split(at, word, there)
        return new

    def _split(self, at: int, word: bytes, there: int) -> int:
        copy = self._state(self.length[at] + 1, dict(self.step[there]))
        self.link[copy], self.link[there] = self.link[there], copy
        while at >= 0 and self.step[at].get(word) == there:
            self.step[at][word] = copy
            at = self.link[at]
        return copy

    def _state(self, length: int, step: dict[bytes, int]) -> int:
        self.step.append(step)
        self.link.append(0)
        self.length.append(length)
        return len(self.step) - 1

    def scan(self, words: list[bytes]):
        """Base phrases as (start, label), and maximal runs as (start, end, state)."""
        step, link, length, phrases, alphabet = self.step, self.link, self.length, self.phrases, self.alphabet
        found, runs = [], []
        state = run = 0
        before = -1
        for at, word in enumerate(words):
            if word not in alphabet:
                continue
            if at - 1 != before:
                if run >= MIN_RUN:
                    runs.append((before - run + 1, before, state))
                state = run = 0
            before = at
            if word not in step[state]:
                if run >= MIN_RUN:
                    runs.append((at - run, at - 1, state))
                while state and word not in step[state]:
                    state = link[state]
                    run = length[state]
            state = step[state].get(word, 0)
            run = run + 1 if state else 0
            for size, label in phrases[state]:
                if size <= run:
                    found.append((at - size + 1, label))
        if run >= MIN_RUN:
            runs.append((before - run + 1, before, state))
        return found, runs

    def spans(self, runs) -> list[tuple[str, int, int, float]]:
        """Chains as (template, first word, last word, share of the template covered).

        A run joins the best chain of its template that ends at most ``MAX_GAP`` words
        before it and earlier in the template.
        """
        out = []
        places: dict[str, list[tuple[int, int, int]]] = {}
        for start, end, state in runs:
            for name, at in self.marks[state]:
                places.setdefault(name, []).append((start, end, at))
        for name, runs_of in places.items():
            chains: list[tuple[int, int, int, int]] = []  # end, template end, first word, covered
            for start, end, at in runs_of:
                size, best = end - start + 1, (start, 0)
                for c_end, c_at, first, covered in reversed(chains):
                    if start - c_end > MAX_GAP:
                        break
                    # Runs may overlap in text or template; the overlap counts once.
                    lost = max(0, c_end - start + 1, c_at - (at - size))
                    if c_at < at and lost < size and covered - lost > best[1]:
                        best = (first, covered - lost)
                chains.append((end, at, best[0], best[1] + size))
            closed: list[tuple[str, int, int, float]] = []
            taken: list[tuple[int, int]] = []  # spans of this template, in order; none overlap
            for end, _, first, covered in sorted(chains, key=lambda c: (-c[3], c[2], c[0])):
                if covered < MIN_COVER * self.tokens[name]:
                    break
                k = bisect_left(taken, (first,))
                if (k == 0 or taken[k - 1][1] < first) and (k == len(taken) or end < taken[k][0]):
                    taken.insert(k, (first, end))
                    closed.append((name, first, end, min(1.0, covered / self.tokens[name])))
            out += closed
        return sorted(out, key=lambda s: (s[1], s[0]))


@lru_cache(1)
def automaton() -> Automaton:
    return Automaton(
        {name: text.encode().split() for name, text in TEMPLATES.items()},
        {phrase.encode(): label for phrase, label in PHRASES.items()},
    )


def scan_text(text: bytes) -> tuple:
    words = WORDS.findall(text.lower())
    found, runs = automaton().scan(words)
    spans = automaton().spans(runs)
    base = sorted({label for _, label in found})
    labels = sorted({*base, *(s[0] for s in spans)})
    starts = [at for at, _ in found]
    score = 1.0 if found else max((s[3] for s in spans), default=0.0)
    return (
        len(words), len(found), min(starts, default=None), max(starts, default=None),
        ",".join(base), ",".join(labels), score,
        [{"label": n, "first_word": a, "last_word": b, "cover": c} for n, a, b, c in spans],
    )


SCAN = (
    "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
    "score double, spans array<struct<label:string,first_word:bigint,last_word:bigint,cover:double>>"
)


def license_scan(df: DataFrame, text: str = "text", into: str = "license") -> DataFrame:
    """``df`` with a struct column ``into`` of what the scan of ``text`` found."""
    return df.withColumn(into, per_row(lambda texts: map(scan_text, texts), SCAN)(text_bytes(F.col(text))))
