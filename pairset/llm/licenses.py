"""License scans of whole texts by template-markup matching.

Words are runs of ASCII letters and digits and of characters above ASCII, after lower-casing A-Z.

*Base places* are places where a base phrase's words stand consecutively, all of them, overlapping ones included.

*Templates* are license notices with markup: ``[[ ... ]]`` is an optional region, ``{name:n}`` a replaceable
one of at most ``n`` words. Each is compiled into an automaton over words, whose states are positions in the
template: a word must match exactly, an optional region may be stepped over, a replaceable one counts the words
it takes. A text is accepted where the automaton reaches its end, so all mandatory wording stands there as
written. A template begins with mandatory words; automata start only where its first two words stand.

NULL and empty texts have no words, no places, empty labels and score 0. The score is 1 for a matched template,
0.5 for a base phrase outside any match, and 0 without either.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairset.session import ship

# The base phrases and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Wording of public license texts and notices, with their identifiers.
TEMPLATES = [
    ("MIT", "released under the [[terms of the]] mit license"),
    ("MIT", "licensed under the [[terms of the]] mit license"),
    ("MIT", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files [[the software]] to deal in the software without restriction including without "
            "limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the "
            "software and to permit persons to whom the software is furnished to do so subject to the following "
            "conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be "
            "included in all copies or substantial portions of the software"),
    ("Apache-2.0", "licensed under the apache license version 2 0 [[the license you may not use this file except in "
                   "compliance with the license you may obtain a copy of the license at {url:12} unless required by "
                   "applicable law or agreed to in writing software distributed under the license is distributed on an "
                   "as is basis without warranties or conditions of any kind either express or implied]]"),
    ("GPL-3.0-only", "licensed under the [[terms of the]] gnu general public license [[as published by the free software "
                     "foundation]] version 3"),
    ("GPL-3.0-or-later", "{program:4} is free software you can redistribute it and or modify it under the terms of the gnu "
                         "general public license as published by the free software foundation either version 3 of the "
                         "license or at your option any later version"),
    ("GPL-2.0-or-later", "{program:4} is free software you can redistribute it and or modify it under the terms of the gnu "
                         "general public license as published by the free software foundation either version 2 of the "
                         "license or at your option any later version"),
    ("BSD-2-Clause", "redistribution and use in source and binary forms with or without modification are permitted provided "
                     "that the following conditions are met [[1]] redistributions of source code must retain the above "
                     "copyright notice this list of conditions and the following disclaimer [[2]] redistributions in "
                     "binary form must reproduce the above copyright notice this list of conditions and the following "
                     "disclaimer in the documentation and or other materials provided with the distribution this "
                     "software is provided by"),
    ("BSD-3-Clause", "redistribution and use in source and binary forms with or without modification are permitted provided "
                     "that the following conditions are met [[1]] redistributions of source code must retain the above "
                     "copyright notice this list of conditions and the following disclaimer [[2]] redistributions in "
                     "binary form must reproduce the above copyright notice this list of conditions and the following "
                     "disclaimer in the documentation and or other materials provided with the distribution [[3]] neither "
                     "the name of {organisation:12} nor the names of its contributors may be used to endorse or promote "
                     "products derived from this software without specific prior written permission"),
    ("ISC", "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is "
            "hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("CC-BY-NC-4.0", "licensed under [[a]] [[the]] cc by nc 4 0"),
    ("CC-BY-4.0", "licensed under [[a]] [[the]] creative commons attribution 4 0 international license"),
    ("All-Rights-Reserved", "all rights reserved"),
]

_SPACED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass
class Automaton:
    """States 0..end; ``edges`` by word, ``free`` steps that take no word, ``fills`` that take any word."""

    label: str
    head: bytes
    edges: list[dict[bytes, int]]
    fills: list[int]
    free: list[list[int]]
    end: int

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.free[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    def accepts(self, words: list[bytes], start: int) -> int:
        """The end of the longest match at ``start``, or -1."""
        states, best, at = self.closure({0}), -1, start
        while states:
            if self.end in states:
                best = at
            if at == len(words):
                break
            w = words[at]
            after = {e for s in states if (e := self.edges[s].get(w)) is not None} | {self.fills[s] for s in states if self.fills[s] >= 0}
            states, at = self.closure(after), at + 1
        return best


def compiled(label: str, template: str) -> Automaton:
    """Compile a template. A leading replaceable region is context only: matching starts at the words after it."""
    parts = template.split()
    while re.fullmatch(r"\{\w+:\d+\}", parts[0]):
        parts = parts[1:]
    edges: list[dict[bytes, int]] = [{}]
    fills, free, opened = [-1], [[]], []

    def state() -> int:
        edges.append({})
        fills.append(-1)
        free.append([])
        return len(edges) - 1

    for part in parts:
        opens, closes = part.startswith("[["), part.endswith("]]")
        word = part.removeprefix("[[").removesuffix("]]")
        if opens:
            opened.append(len(edges) - 1)
        if m := re.fullmatch(r"\{\w+:(\d+)\}", word):
            skips = []
            for _ in range(int(m[1])):
                last = len(edges) - 1
                skips.append(last)
                fills[last] = state()
            for s in skips:
                free[s].append(len(edges) - 1)
        else:
            last = len(edges) - 1
            edges[last][word.encode()] = state()
        if closes:
            free[opened.pop()].append(len(edges) - 1)
    head = []
    for part in parts[:2]:
        if "[" in part or "{" in part:
            break
        head.append(part)
    return Automaton(label, " ".join(head).encode(), edges, fills, free, len(edges) - 1)


def places(spaced: bytes, phrase: bytes) -> list[int]:
    """The word numbers at which a phrase stands in words that are separated by one space."""
    found, needle, at, words = [], b" " + phrase + b" ", 0, 0
    last = 0
    while (at := spaced.find(needle, at)) >= 0:
        words += spaced.count(b" ", last, at)
        last = at
        found.append(words)
        at += 1
    return found


def scan_text(text: str | None, automata: list[Automaton]) -> tuple:
    words = (text or "").encode().translate(_SPACED).split()
    spaced = b" " + b" ".join(words) + b" "
    base = [(at, label) for phrase, label in BASE_PHRASES.items() for at in places(spaced, phrase.encode())]
    spans = []
    for a in automata:
        for at in places(spaced, a.head):
            if (end := a.accepts(words, at)) >= 0:
                spans.append((at, end, a.label))
    at = [p for p, _ in base]
    base_labels = sorted({label for _, label in base})
    labels = sorted({*base_labels, *(label for _, _, label in spans)})
    return (
        len(words), len(base), min(at, default=None), max(at, default=None), ",".join(base_labels), ",".join(labels),
        1.0 if spans else 0.5 if base else 0.0, [{"start": s, "end": e, "label": t} for s, e, t in sorted(spans)],
    )


_FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
_TYPE = f"struct<{', '.join(f.replace(' ', ':') for f in _FIELDS.split(', '))}, spans:array<struct<start:long,end:long,label:string>>>"


def scanned(text: Column, docs: DataFrame) -> Column:
    """Counts, places, labels and matched spans of a text, as one struct."""
    ship(docs.sparkSession)

    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automata = [compiled(*t) for t in TEMPLATES]
        names = [f.split()[0] for f in _FIELDS.split(", ")] + ["spans"]
        for batch in batches:
            out = pd.DataFrame([scan_text(t, automata) for t in batch], columns=names)
            yield out.astype({"first_word": "Int64", "last_word": "Int64"})

    scan.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(scan, _TYPE)(text)


def scan_documents(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the scan of every text; ``spans`` are word numbers, end exclusive."""
    return docs.select("doc_id", scanned(F.col("text"), docs).alias("scan")).select("doc_id", "scan.*")
