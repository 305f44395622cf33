"""License scans by template-markup matching.

A template is a license wording in a small markup: [[ ]] encloses what may be left out, {{0..5}} stands for a number
of words that the licensor fills in. compile_template() turns it into an automaton over word hashes; a text is
accepted from a place if the mandatory words follow there exactly, in order. Automata start only where a template's
first two mandatory words stand, which numpy finds for a whole batch at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.shared import small_batches
from seqloom.llm.words import batch_words, not_alphanumeric, parts, phrase_places, word_hash

#: The phrases whose places are counted, and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label: wordings. The licenses' own notices.
TEMPLATES = {
    "apache-2.0": [
        "licensed under the apache license version 2 0 [[ the license you may not use this file except in compliance with the license you may obtain a copy of the license at {{0..8}} ]]",
    ],
    "mit": [
        "released under the mit license",
        "licensed under the [[ terms of the ]] mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"
        " including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is"
        " furnished to do so subject to the following conditions the above copyright notice and this permission notice [[ including the next paragraph ]] shall be included in all copies or"
        " substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"
        " fitness for a particular purpose and noninfringement in no event shall {{1..8}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise"
        " arising from out of or in connection with the software or the use or other dealings in the software",
    ],
    "isc": ["permission to use copy modify and [[ or ]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "bsd": [
        "released under the [[ terms of the ]] {{0..3}} bsd license",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[ 1 ]] redistributions of source code must"
        " retain the above copyright notice this list of conditions and the following disclaimer [[ 2 ]] redistributions in binary form must reproduce the above copyright notice this list of"
        " conditions and the following disclaimer in the documentation and or other materials provided with the distribution [[ [[ 3 ]] neither the name of {{0..12}} nor the names of its"
        " contributors may be used to endorse or promote products derived from this software without specific prior written permission ]] this software is provided by {{1..8}} as is and any"
        " express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    ],
    "lgpl": ["terms of the gnu [[ lesser ]] [[ library ]] general public license as published by the free software foundation either version {{1..2}} of the license"],
    "agpl-3.0": ["terms of the gnu affero general public license as published by the free software foundation either version 3 of the license"],
    "gpl-2.0": [
        "[[ this {{1..3}} is ]] licensed under the gnu general public license version 2",
        "free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license",
    ],
    "gpl-3.0": [
        "[[ this {{1..3}} is ]] licensed under the gnu general public license version 3",
        "free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license",
    ],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "cc-by-4.0": ["licensed under [[ a ]] [[ creative commons ]] cc by [[ license ]] 4 0"],
    "cc-by-sa-4.0": ["licensed under [[ a ]] [[ creative commons ]] cc by sa [[ license ]] 4 0"],
    "cc-by-nc-4.0": ["licensed under [[ a ]] [[ creative commons ]] cc by nc [[ license ]] 4 0"],
    "cc-by-nd-4.0": ["licensed under [[ a ]] [[ creative commons ]] cc by nd [[ license ]] 4 0"],
    "copyright": ["copyright {{0..8}} all rights reserved"],
}

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


class Automaton:
    """States 0..n; moves by a word's hash, by any word, or without a word."""

    def __init__(self) -> None:
        self.by_word: list[tuple[int, int] | None] = []
        self.any_word: list[int | None] = []
        self.free: list[list[int]] = []
        self.final = 0

    def state(self) -> int:
        self.by_word.append(None)
        self.any_word.append(None)
        self.free.append([])
        return len(self.free) - 1

    def closure(self, states: dict[int, int]) -> dict[int, int]:
        """States reached without a word, each with the most mandatory words matched on a way to it."""
        todo = list(states)
        while todo:
            s = todo.pop()
            for t in self.free[s]:
                if states.get(t, -1) < states[s]:
                    states[t] = states[s]
                    todo.append(t)
        return states

    def accept(self, words: list[int], at: int, end: int) -> tuple[int, int] | None:
        """(end of the longest accepted stretch from at, words in it that matched by wording), or None."""
        states, found = self.closure({0: 0}), None
        while True:
            if self.final in states:
                found = at, states[self.final]
            if at >= end or not states:
                return found
            word, after = words[at], {}
            for s, n in states.items():
                if (move := self.by_word[s]) and move[0] == word:
                    after[move[1]] = max(after.get(move[1], -1), n + 1)
                if (to := self.any_word[s]) is not None:
                    after[to] = max(after.get(to, -1), n)
            states, at = self.closure(after), at + 1


def compile_template(markup: str) -> tuple[Automaton, list[int]]:
    """The automaton, and the hashes of the first one or two adjacent mandatory words outside all regions."""
    auto, opened, lead, done = Automaton(), [], [], False
    at = auto.state()
    start = None
    for part in re.findall(r"\[\[|\]\]|\{\{\d+\.\.\d+\}\}|[^\s\[\]{}]+", markup.lower()):
        if part == "[[":
            opened.append(at)
            done |= bool(lead)
        elif part == "]]":
            end = auto.state()
            auto.free[at].append(end)
            auto.free[opened.pop()].append(end)
            at = end
        elif part.startswith("{{"):
            low, high = map(int, part[2:-2].split(".."))
            end = auto.state()
            for k in range(high + 1):
                if k >= low:
                    auto.free[at].append(end)
                if k < high:
                    to = auto.state()
                    auto.any_word[at] = to
                    at = to
            at = end
            done |= bool(lead)
        else:
            to, h = auto.state(), word_hash(part)
            auto.by_word[at] = h, to
            if not opened and not done and len(lead) < 2:
                start = at if start is None else start
                lead.append(h)
            at = to
    if opened or not lead:
        raise ValueError(f"template needs closed regions and a mandatory word: {markup}")
    auto.final = at
    return auto, lead


def scan_batch(column: pa.Array, templates: list[tuple[str, Automaton, list[int]]], base: list[tuple[str, list[int]]]) -> dict[str, list]:
    words, _, bounds = batch_words(column, not_alphanumeric())
    n = len(column)
    places: list[list[int]] = [[] for _ in range(n)]
    base_of: list[set[str]] = [set() for _ in range(n)]
    labels: list[set[str]] = [set() for _ in range(n)]
    best = [0.0] * n
    owner = lambda at: np.searchsorted(bounds, at, "right") - 1
    for label, phrase in base:
        at = phrase_places(words, bounds, phrase)
        for k, d in zip(at.tolist(), owner(at).tolist(), strict=True):
            places[d].append(k - int(bounds[d]))
            base_of[d].add(label)
            best[d] = max(best[d], 0.5)
    for label, auto, lead in templates:
        at = phrase_places(words, bounds, lead)
        for k, d in zip(at.tolist(), owner(at).tolist(), strict=True):
            if label in labels[d] and best[d] == 1.0:
                continue
            stop = min(int(bounds[d + 1]), k + len(auto.free))
            if got := auto.accept(words[k:stop].tolist(), 0, stop - k):
                labels[d].add(label)
                best[d] = max(best[d], 0.5 + 0.5 * got[1] / got[0])
    count = np.diff(bounds).tolist()
    return {
        "n_words": count,
        "n_base": [len(p) for p in places],
        "first_word": [min(p, default=None) for p in places],
        "last_word": [max(p, default=None) for p in places],
        "base_labels": [",".join(sorted(b)) for b in base_of],
        "labels": [",".join(sorted(a | b)) for a, b in zip(labels, base_of, strict=True)],
        "score": best,
    }


def scan_licenses(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", templates: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Over the whole text, A-Z lower-cased. n_base counts all places of the base phrases; first_word and last_word are
    the smallest and largest of their starts (null without any). labels joins the base phrases' labels and those of the
    templates that accept a stretch of the text. score: 0 without either; 0.5 with base phrases only; with a template
    0.5 and half the share of the stretch's words that are its wording. A null text counts as empty. Repeated rows
    give repeated rows; an empty table gives none; other columns are not read.
    """
    wordings = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [(label, *skip_leading(t)) for label, ts in wordings.items() for t in ts]
        base = [(label, [word_hash(w) for w in phrase.split()]) for phrase, label in BASE_PHRASES.items()]
        for batch in parts(batches):
            got = scan_batch(batch.column(1), made, base)
            types = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "score": pa.float64()}
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, types.get(k, pa.string())) for k, v in got.items())], ["doc_id", *got])

    return small_batches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))).mapInArrow(run, SCHEMA)


def skip_leading(markup: str) -> tuple[Automaton, list[int]]:
    """The template without a region at its very start: what may be absent there doesn't decide acceptance."""
    while m := re.match(r"\s*(\[\[(?:(?!\[\[|\]\]).)*\]\]|\{\{\d+\.\.\d+\}\})", markup):
        markup = markup[m.end() :]
    return compile_template(markup)
