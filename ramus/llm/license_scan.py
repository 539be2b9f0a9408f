"""License scan: matching statistics on a generalised suffix automaton of license tokens.

The automaton holds every token sequence that occurs in any template, and so is as
large as the templates, which are a parameter. A text streams through it once: after
each token the automaton's state is the longest suffix of the text so far that
occurs in some template, and its length is the matching statistic. Where the length
stops growing a maximal match ends; matches of ``min_match`` tokens or more are
chained along each template (places in text and template both rising, small gaps),
and the share of a template that its best chain covers is its coverage.

Tokens that no template has can't be in a match, so only runs of template tokens
that are long enough are streamed; numpy finds them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ramus.llm.arrowtext import LOWER_ALNUM, Words, chunks, runs
from ramus.llm.shared import Safe, without

# Phrases that always count, with their labels.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Notices by which texts name their license, with the method's labels.
TEMPLATES = {
    "agpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "apache-line": "Licensed under the Apache License, Version 2.0",
    "apache-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "cc-by-line": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc-line": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-line": "Licensed under CC BY-SA 4.0",
    "gpl-line": "This work is licensed under the GNU General Public License, version 3",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc-notice": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit-line": "Released under the MIT License",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
}


def tokens(text: str) -> list[bytes]:
    words = Words(pa.array([text]), LOWER_ALNUM, fold=True)
    return words.as_array().to_pylist()


class SuffixAutomaton:
    """Of several token sequences; each state knows in which template and where its strings end."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for k, sequence in enumerate(sequences):
            last = 0
            for place, token in enumerate(sequence):
                last = self._extend(last, token)
                self.ends[last].add((k, place + 1))
        # What ends in a state ends in the states of its suffixes as well.
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.ends.append(set())
        return len(self.next) - 1

    def _split(self, parent: int, token: int, child: int) -> int:
        """A copy of child for the strings that parent's longest and token make."""
        copy = self._state(self.length[parent] + 1, self.link[child], dict(self.next[child]))
        self.link[child] = copy
        while parent >= 0 and self.next[parent].get(token) == child:
            self.next[parent][token] = copy
            parent = self.link[parent]
        return copy

    def _extend(self, last: int, token: int) -> int:
        if (child := self.next[last].get(token)) is not None:
            return child if self.length[child] == self.length[last] + 1 else self._split(last, token, child)
        new, parent = self._state(self.length[last] + 1, 0, {}), last
        while parent >= 0 and token not in self.next[parent]:
            self.next[parent][token] = new
            parent = self.link[parent]
        if parent >= 0:
            child = self.next[parent][token]
            self.link[new] = child if self.length[child] == self.length[parent] + 1 else self._split(parent, token, child)
        return new

    def statistics(self, stream: list[int]) -> Iterator[tuple[int, int]]:
        """After each token: the state, and the length of the longest suffix that occurs in a template."""
        state = length = 0
        for token in stream:
            while state and token not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if token in self.next[state]:
                state, length = self.next[state][token], length + 1
            yield state, length

    def matches(self, stream: list[int], least: int) -> Iterator[tuple[int, int, int]]:
        """State, end in the stream and length of each maximal match of ``least`` tokens or more."""
        before = (0, 0)
        for i, (state, length) in enumerate(self.statistics(stream)):
            if length <= before[1] and before[1] >= least:
                yield before[0], i, before[1]
            before = (state, length)
        if before[1] >= least:
            yield before[0], len(stream), before[1]


def best_chain(matches: list[tuple[int, int, int]], gap: int) -> tuple[int, int, int]:
    """Covered template tokens, and the first and last text place, of the best chain.

    matches: (end in text, end in template, length) of one template. A match follows
    another if it begins after it in both, by ``gap`` tokens at most in the text; the
    part that overlaps it doesn't count.
    """
    matches = sorted(matches)
    best: list[tuple[int, int]] = []
    for i, (end, to, length) in enumerate(matches):
        here = (length, end - length)
        # Ends rise, so what lies too far back ends the search.
        for j in range(i - 1, -1, -1):
            end_j, to_j, _ = matches[j]
            if end_j < end - length - gap:
                break
            new = min(length, end - end_j, to - to_j)
            if end_j < end and to_j < to and best[j][0] + new > here[0]:
                here = (best[j][0] + new, best[j][1])
        best.append(here)
    i = max(range(len(best)), key=lambda i: (best[i][0], -i))
    return best[i][0], best[i][1], matches[i][0] - 1


class Scanner:
    def __init__(self, templates: dict[str, str], phrases: dict[str, str], least: int, gap: int, coverage: float):
        self.names, self.least, self.gap, self.coverage = sorted(templates), least, gap, coverage
        sequences = [tokens(templates[n]) for n in self.names]
        phrases = {p: tokens(p) for p in phrases} if phrases else {}
        self.number: dict[bytes, int] = {}
        for sequence in [*sequences, *phrases.values()]:
            for token in sequence:
                self.number.setdefault(token, len(self.number))
        self.phrases = [(p, [self.number[t] for t in s]) for p, s in phrases.items()]
        self.automaton = SuffixAutomaton([[self.number[t] for t in s] for s in sequences])
        self.sizes = [len(s) for s in sequences]
        self.in_template = np.zeros(len(self.number) + 1, bool)
        self.in_template[[self.number[t] for s in sequences for t in s]] = True

    def spans(self, ids: np.ndarray, text_of: np.ndarray) -> dict[int, list[tuple[str, float, int, int]]]:
        """For texts with covered templates: (name, coverage, first and last place among all words)."""
        flag = self.in_template[ids]
        found: dict[tuple[int, int], list[tuple[int, int, int]]] = defaultdict(list)
        for a, b in zip(*runs(flag)):
            if b - a < self.least:
                continue
            cuts = np.flatnonzero(np.diff(text_of[a:b])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), int(b - a)]):
                if hi - lo >= self.least:
                    for state, end, length in self.automaton.matches(ids[a + lo : a + hi].tolist(), self.least):
                        for k, to in self.automaton.ends[state]:
                            found[int(text_of[a]) if lo == 0 else int(text_of[a + lo]), k].append((int(a) + lo + end, to, length))
        out: dict[int, list[tuple[str, float, int, int]]] = defaultdict(list)
        for (text, k), matches in sorted(found.items()):
            covered, first, last = best_chain(matches, self.gap)
            if covered >= self.coverage * self.sizes[k]:
                out[text].append((self.names[k], min(1.0, covered / self.sizes[k]), first, last))
        return out


def _scan(batches: Iterator[pa.RecordBatch], templates: dict[str, str], phrases: dict[str, str], least: int, gap: int, coverage: float, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    scanner = Scanner(templates, phrases, least, gap, coverage)
    for batch in chunks(batches):
        words = Words(batch.column("text"), LOWER_ALNUM, fold=True)
        n, texts = len(words), batch.num_rows
        known = np.array([scanner.number.get(w, len(scanner.number)) for w in words.vocabulary.to_pylist()], np.int64)
        ids, text_of = known[words.ids] if n else np.empty(0, np.int64), words.text_of
        count, first, last = np.zeros(texts, np.int64), np.full(texts, n), np.full(texts, -1)
        labels: dict[int, set[str]] = defaultdict(set)
        for phrase, own in scanner.phrases:
            m = n - len(own) + 1
            if m <= 0:
                continue
            hit = text_of[:m] == text_of[len(own) - 1 :]
            for i, token in enumerate(own):
                hit &= ids[i : i + m] == token
            at = np.flatnonzero(hit)
            t, place = text_of[at], at - words.per_text[text_of[at]]
            np.add.at(count, t, 1)
            np.minimum.at(first, t, place)
            np.maximum.at(last, t, place)
            for x in set(t.tolist()):
                labels[x].add(phrases[phrase])
        spans = scanner.spans(ids, text_of) if n else {}
        base = [",".join(sorted(labels[i])) if i in labels else "" for i in range(texts)]
        every = [",".join(sorted(labels.get(i, set()) | {s[0] for s in spans.get(i, [])})) if i in labels or i in spans else "" for i in range(texts)]
        score = [max([0.5 * (i in labels), *(s[1] for s in spans.get(i, []))]) for i in range(texts)]
        listed = [[{"template": s[0], "coverage": s[1], "first": s[2] - int(words.per_text[i]), "last": s[3] - int(words.per_text[i])} for s in spans.get(i, [])] for i in range(texts)]
        columns = [batch.column("rec"), pa.array(words.counts, pa.int64()), pa.array(count), pa.array(first, mask=count == 0), pa.array(last, mask=count == 0), pa.array(base), pa.array(every), pa.array(score, pa.float64()), pa.array(listed, schema.field("spans").type)]
        yield pa.RecordBatch.from_arrays(columns, ["rec", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])


def license_scan(docs: DataFrame, text_col: str = "text", templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, min_match: int = 4, max_gap: int = 12, coverage: float = 0.75, keep: list[str] | None = None) -> DataFrame:
    """One row per input row: rec (struct of ``keep``, by default all columns but the text), n_words, n_base,
    first_word, last_word, base_labels, labels, score, spans.

    The scan is a projection without a shuffle. A template is reported if its best
    chain covers at least ``coverage`` of its tokens; spans has its place in the text.
    score: the best coverage, or 0.5 where only a phrase is found. Null and empty
    texts have no words, no labels and score 0. Input columns may have any names.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    t = Safe(docs, without(docs, text_col) if keep is None else keep)
    base = t.rows.select(t.rec, t.col(text_col).alias("text"))
    schema = t.schema("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<template:string,coverage:double,first:long,last:long>>")
    arrow = to_arrow_schema(schema)
    args = (templates or TEMPLATES, BASE_PHRASES if phrases is None else phrases, min_match, max_gap, coverage, arrow)
    return t.out(base.mapInArrow(lambda b: _scan(b, *args), schema))
