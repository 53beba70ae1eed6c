"""License scans by template markup.

A template is the wording of a license or notice with marked regions: ``[[ ... ]]`` may be
left out, ``{a|b}`` is either wording, and ``<<m,n>>`` stands for any m to n words. It is
compiled into a token automaton that accepts a run of words whose mandatory wording is exactly
the template's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Wording of public licenses and of usual notices.
TEMPLATES = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files [[(the \"Software\")]], to deal in {the|this} Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice [[(including the next paragraph)]] shall be included in all "
        "copies or substantial portions of the Software.",
        "{released|licensed|distributed|available|published} under the [[terms of the]] [[<<1,3>>]] MIT {license|licence}",
        "SPDX License Identifier: MIT",
    ],
    "apache-2": [
        "Licensed under the Apache License, Version 2.0 [[(the \"License\"); you may not use this {file|work|software} except "
        "in compliance with the License]]",
        "{released|distributed|available|published} under the [[terms of the]] Apache {license|licence} [[version]] 2[[.0]]",
        "SPDX License Identifier: Apache 2.0",
    ],
    "cc-by-nc": [
        "licensed under [[a|the]] [[creative commons attribution noncommercial]] CC BY NC [[{sa|nd}]] [[{4|3|2}.{0|5}]]",
        "licensed under [[a|the]] Creative Commons Attribution {noncommercial|non commercial} [[<<1,2>>]] [[{4|3|2}.{0|5}]] "
        "[[international]] [[license]]",
    ],
    "cc-by": [
        "licensed under [[a|the]] Creative Commons Attribution {4.0|3.0|2.5|2.0} [[international]] [[license]]",
        "licensed under CC BY {4.0|3.0|2.5|2.0}",
    ],
    "gpl-3": [
        "licensed under the GNU General Public {License|Licence}[[,]] version 3",
        "under the terms of the GNU General Public {License|Licence} [[as published by the Free Software Foundation]][[,]] "
        "either version 3 [[of the License]]",
        "SPDX License Identifier: GPL 3.0 [[{only|or later}]]",
    ],
    "gpl-2": [
        "licensed under the GNU General Public {License|Licence}[[,]] version 2",
        "under the terms of the GNU General Public {License|Licence} [[as published by the Free Software Foundation]][[,]] "
        "either version 2 [[of the License]]",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: [[1.]] Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. [[2.]] Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
        "provided with the distribution.",
        "{released|licensed|distributed|available} under the [[terms of the]] [[<<1,2>>]] BSD [[{2|3} clause]] {license|licence}",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
}

_NOT_WORD = bytes(c for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122))
_TO_WORDS = bytes.maketrans(_NOT_WORD + bytes(range(65, 91)), b" " * len(_NOT_WORD) + bytes(range(97, 123)))
_MARK = re.compile(r"(\[\[|\]\]|\{|\||\}|<<\d+,\d+>>)")
ANY = None
RESULT = (
    "_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<label: string, start: long, end: long>>"
)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters and digits and of all other characters outside ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


class Automaton:
    """A template's token automaton.

    ``steps[state]`` has (word or ANY, next state); ``empty[state]`` the states reached without a
    word. Matching starts at the mandatory words that open the template.
    """

    def __init__(self, markup: str) -> None:
        self.steps: list[list[tuple[bytes | None, int]]] = [[]]
        self.empty: list[list[int]] = [[]]
        self.mandatory = 0
        parts = [x for x in _MARK.split(markup) if x]
        self.end, rest = self._sequence(parts, 0, 0)
        if rest != len(parts):
            raise ValueError(f"unbalanced template: {markup}")
        self.start = self._closed({0})
        self.openings = {w for s in self.start for w, _ in self.steps[s]}
        if ANY in self.openings or self.end in self.start:
            raise ValueError(f"a template must open with wording: {markup}")

    def _state(self) -> int:
        self.steps.append([])
        self.empty.append([])
        return len(self.steps) - 1

    def _sequence(self, parts: list[str], i: int, at: int, depth: int = 0) -> tuple[int, int]:
        """Adds parts from state ``at`` until the region closes; returns the last state and the next part."""
        while i < len(parts) and parts[i] not in ("]]", "|", "}"):
            part = parts[i]
            if part in ("[[", "{"):
                ends, start = [], at
                while True:
                    begin = self._state()
                    self.empty[start].append(begin)
                    last, i = self._sequence(parts, i + 1, begin, depth + 1)
                    ends.append(last)
                    if i >= len(parts):
                        raise ValueError("a region is left open")
                    if parts[i] != "|":
                        break
                at = self._state()
                for x in ends + ([start] if part == "[[" else []):
                    self.empty[x].append(at)
            elif part.startswith("<<"):
                least, most = map(int, part[2:-2].split(","))
                end = self._state()
                for k in range(most):
                    if k >= least:
                        self.empty[at].append(end)
                    new = self._state()
                    self.steps[at].append((ANY, new))
                    at = new
                self.empty[at].append(end)
                at = end
            else:
                for word in words_of(part):
                    new = self._state()
                    self.steps[at].append((word, new))
                    at = new
                    self.mandatory += depth == 0
            i += 1
        return at, i

    def _closed(self, states: set[int]) -> frozenset[int]:
        todo, out = list(states), set(states)
        while todo:
            for x in self.empty[todo.pop()]:
                if x not in out:
                    out.add(x)
                    todo.append(x)
        return frozenset(out)

    def match(self, words: list[bytes], i: int) -> int:
        """The end of the longest accepted run of words that starts at word i, or -1."""
        now, best = self.start, -1
        while now:
            if self.end in now:
                best = i
            if i >= len(words):
                break
            word = words[i]
            now = self._closed({t for s in now for w, t in self.steps[s] if w is ANY or w == word})
            i += 1
        return best

    def two_word_openings(self) -> set[bytes]:
        """Every pair of words that an accepted run can start with; runs of one word give single words."""
        out = set()
        for s in self.start:
            for word, t in self.steps[s]:
                after = self._closed({t})
                follow = {w for x in after for w, _ in self.steps[x]}
                if self.end in after or ANY in follow:
                    out.add(b" " + word + b" ")
                else:
                    out |= {b" " + word + b" " + w + b" " for w in follow}
        return out


def compile_templates(templates: dict[str, list[str]]) -> list[tuple[str, Automaton]]:
    return [(label, Automaton(markup)) for label, wordings in templates.items() for markup in wordings]


def _places(line: bytes, needle: bytes) -> list[int]:
    """Word positions at which `` needle `` starts in a line of words with spaces around; overlaps count."""
    out, at, seen, spaces = [], line.find(needle), 0, 0
    while at >= 0:
        spaces += line.count(b" ", seen, at)
        seen = at
        out.append(spaces)
        at = line.find(needle, at + 1)
    return out


def scan_text(text: str | None, phrases: dict[bytes, str], automata: list[tuple[str, Automaton]], openings: list[set[bytes]]) -> tuple:
    words = words_of(text)
    line = b" " + b" ".join(words) + b" "
    base = {p: label for p, label in phrases.items() if p in line}
    places = sorted(x for p in base for x in _places(line, p))
    spans, best = set(), 0.5 if base else 0.0
    present: dict[bytes, list[int]] = {}
    for (label, automaton), starts in zip(automata, openings, strict=True):
        for opening in starts:
            if opening not in line:
                continue
            if opening not in present:
                present[opening] = _places(line, opening)
            for i in present[opening]:
                end = automaton.match(words, i)
                if end > 0:
                    spans.add((label, i, end))
                    best = max(best, 1 - 0.5 / (1 + automaton.mandatory))
    base_labels = sorted(set(base.values()))
    labels = sorted({*base_labels, *(x[0] for x in spans)})
    return (
        len(words), len(places), places[0] if places else None, places[-1] if places else None,
        ",".join(base_labels), ",".join(labels), best,
        [{"label": a, "start": b, "end": c} for a, b, c in sorted(spans)],
    )


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    templates: dict[str, list[str]] | None = None, phrases: dict[str, str] | None = None,
) -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``n_base`` counts the places of all phrases, with the smallest and largest start in
    first_word and last_word (null where there is none). ``labels`` adds those of accepted
    templates, whose word spans are in ``spans``. The score is 0 without a label, 0.5 for
    phrases alone, and up to 1 the more mandatory words an accepted template has. Null and empty
    texts have no words and empty labels; rows are scanned one by one, so repeated rows and
    null ids stay as they are. Other columns are ignored.
    """
    templates, phrases = templates or TEMPLATES, phrases or PHRASES

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automata = compile_templates(templates)
        openings = [a.two_word_openings() for _, a in automata]
        needles = {b" " + b" ".join(words_of(p)) + b" ": label for p, label in phrases.items()}
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        for batch in batches:
            found = pd.DataFrame([scan_text(t, needles, automata, openings) for t in batch["_text"]], columns=names)
            found.insert(0, "_id", batch["_id"].astype("Int64").to_numpy())
            yield found.astype({"_id": "Int64", "first_word": "Int64", "last_word": "Int64"})

    slim = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return slim.mapInPandas(scan, RESULT).withColumnRenamed("_id", id_col)
