"""License scans by patience alignment of texts with notice templates.

Texts and templates are words (ASCII letters, digits and non-ASCII bytes, A-Z
lower-cased). Three words in a row that a template has mark a place; places
nearer to each other than the template is long form a region, which is aligned
with the template: anchors are the words that occur once in both, their longest
increasing subsequence is kept, and the gaps between anchors are aligned in the
same way (common words at a gap's ends first). A template's coverage is the
share of its words that are aligned; at least MIN_COVERAGE is a finding. Words
in brackets tell a license from its relatives: all of them must be aligned, and
those of one pair of brackets must stand next to each other in the text too. Of
findings that overlap, the one with more aligned words stays.

Null texts count as empty. Every occurrence of a notice is found, however many
a text has. Repeated rows are scanned each; empty tables give no rows; extra
columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireflow.llm import textkit

MIN_COVERAGE, MIN_ALIGNED = 0.8, 4
#: License and notice; the words in brackets are its name.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the [Apache License], Version [2.0]"),
    ("Apache-2.0", 'Licensed under the [Apache License], Version [2.0] (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("MIT", "Released under the [MIT] License"),
    ("MIT", "Licensed under the [MIT] License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("ISC", "Released under the [ISC] License"),
    ("ISC", "Licensed under the [ISC] License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("GPL-3.0", "This work is licensed under the [GNU General Public License], [version 3]"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the [GNU General Public License] as published by the Free Software Foundation, either [version 3] of the License, or any later version"),
    ("GPL-2.0", "This program is licensed under the [GNU General Public License], [version 2]"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the [GNU General Public License] as published by the Free Software Foundation, either [version 2] of the License, or any later version"),
    ("AGPL-3.0", "Licensed under the [GNU Affero General Public License], [version 3]"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the [GNU Affero General Public License] as published by the Free Software Foundation, either [version 3] of the License, or any later version"),
    ("LGPL-3.0", "Licensed under the [GNU Lesser General Public License], [version 3]"),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the [GNU Lesser General Public License] as published by the Free Software Foundation, either [version 3] of the License, or any later version"),
    ("LGPL-2.1", "Licensed under the [GNU Lesser General Public License], [version 2.1]"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the [GNU Lesser General Public License] as published by the Free Software Foundation, either [version 2.1] of the License, or any later version"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the [Mozilla Public License], [v. 2.0]"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the [Eclipse Public License] [2.0]"),
    ("Unlicense", "This is free and unencumbered software released into the [public domain]"),
    ("CC0-1.0", "Released under [CC0 1.0]"),
    ("CC-BY-4.0", "Licensed under [CC BY 4.0]"),
    ("CC-BY-SA-4.0", "Licensed under [CC BY-SA 4.0]"),
    ("CC-BY-NC-4.0", "Licensed under [CC BY-NC 4.0]"),
    ("CC-BY-ND-4.0", "Licensed under [CC BY-ND 4.0]"),
    ("CC-BY-4.0", "This work is licensed under a [Creative Commons Attribution 4.0] International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a [Creative Commons Attribution-ShareAlike 4.0] International License"),
    ("CC-BY-NC-4.0", "This work is licensed under a [Creative Commons Attribution-NonCommercial 4.0] International License"),
]
_SEPARATOR = np.ones(256, bool)
_SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_STEPS = np.array([3, 5, 7], np.uint64)
#: License, words, triples, runs of words in brackets.
Template = tuple[str, np.ndarray, np.ndarray, list[tuple[int, int]]]


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    lowered = textkit.LOWER[data]
    starts, ends, first = textkit.word_spans(lowered, offsets, _SEPARATOR)
    return textkit.span_hashes(lowered, starts, ends), starts, ends, first


def _triples(words: np.ndarray) -> np.ndarray:
    return textkit.mix(words[:-2] * _STEPS[0] + textkit.mix(words[1:-1] * _STEPS[1]) + textkit.mix(textkit.mix(words[2:] * _STEPS[2]))) if len(words) > 2 else np.zeros(0, np.uint64)


def align(text: list, template: list) -> list[tuple[int, int]]:
    """Pairs (place in text, place in template) of the patience alignment, increasing in both."""
    out: list[tuple[int, int]] = []
    work = [(0, len(text), 0, len(template))]
    while work:
        a, b, c, d = work.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        in_text, in_template = Counter(text[a:b]), Counter(template[c:d])
        place = {w: k for k, w in enumerate(template[c:d], c) if in_template[w] == 1 and in_text.get(w) == 1}
        anchors = _increasing([(k, place[w]) for k, w in enumerate(text[a:b], a) if w in place])
        if not anchors:
            continue
        out += anchors
        for (p, q), (r, s) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)], strict=True):
            if r - p > 1 and s - q > 1:
                work.append((p + 1, r, q + 1, s))
    return sorted(out)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence that increases in the second place (patience sorting)."""
    tops: list[int] = []
    piles: list[int] = []
    before: list[int] = []
    for k, (_, q) in enumerate(pairs):
        at = bisect_left(tops, q)
        before.append(piles[at - 1] if at else -1)
        if at == len(tops):
            tops.append(q)
            piles.append(k)
        else:
            tops[at], piles[at] = q, k
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def prepared(templates: list[tuple[str, str]]) -> list[Template]:
    """License, words, triples and the runs of words in brackets (first, after the last) of each template."""
    out = []
    for name, text in templates:
        parts = [np.frombuffer(part.encode(), np.uint8) for part in re.split(r"[\[\]]", text)]
        words = [_words(part, np.array([0, len(part)]))[0] for part in parts]
        ends = np.cumsum([len(w) for w in words]).tolist()
        whole = np.concatenate(words)
        out.append((name, whole, _triples(whole), [(ends[k] - len(words[k]), ends[k]) for k in range(1, len(words), 2)]))
    return out


def _named(pairs: list[tuple[int, int]], runs: list[tuple[int, int]]) -> bool:
    """Whether each of the template's runs is aligned with words that stand next to each other."""
    at = {q: p for p, q in pairs}
    return all(q in at and at[q] - at.get(low, q) == q - low for low, high in runs for q in range(low, high))


def scan(words: np.ndarray, templates: list[Template]) -> list[tuple[str, float, int, int, int]]:
    """(license, coverage, aligned words, first word, word after the last) of the findings in a text, by place."""
    triples = _triples(words)
    found = []
    for name, template, marks, runs in templates:
        n = len(template)
        places = np.flatnonzero(np.isin(triples, marks))
        if not len(places):
            continue
        for region in np.split(places, np.flatnonzero(np.diff(places) > n) + 1):
            low = max(0, int(region[0]) - n)
            todo = [(low, min(len(words), int(region[-1]) + 3 + n))]
            if region[-1] - region[0] > n:  # several occurrences: one for each start of the template's own words
                starts = [int(region[0]), *(int(q) for p, q in zip(region[:-1], region[1:], strict=True) if q - p > 1)]
                todo = [(max(low, s - 2), min(len(words), s + n + n // 2 + 3)) for s in starts]
            for a, b in todo:
                pairs = align(words[a:b].tolist(), template.tolist())
                pairs = _dense(pairs, n)
                if len(pairs) >= min(MIN_ALIGNED, n) and len(pairs) >= MIN_COVERAGE * n and _named(pairs, runs):
                    found.append((name, len(pairs) / n, len(pairs), a + pairs[0][0], a + pairs[-1][0] + 1))
    chosen: list[tuple[str, float, int, int, int]] = []
    for x in sorted(found, key=lambda x: (-x[2], -x[1], x[3], x[0])):
        if all(x[4] <= y[3] or x[3] >= y[4] for y in chosen):
            chosen.append(x)
    return sorted(chosen, key=lambda x: x[3])


def _dense(pairs: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """The longest run of pairs without a gap in the text of more than n // 2 + 3 words."""
    runs, run = [], []
    for p in pairs:
        if run and p[0] - run[-1][0] > n // 2 + 3:
            runs.append(run)
            run = []
        run.append(p)
    return max([*runs, run], key=len)


def scanned(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, findings (array of license, coverage, start and end: code points in the text): a row per row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = prepared(templates)
        marks = np.unique(np.concatenate([k[2] for k in known])) if known else np.zeros(0, np.uint64)
        for batch in batches:
            data, offsets = textkit.column_buffer(batch.column(1))
            for low, high in textkit.row_slices(offsets):
                part, bounds = data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
                words, starts, ends, first = _words(part, bounds)
                findings: list[list] = [[] for _ in range(high - low)]
                if len(words) > 2 and len(marks):
                    triples = _triples(words)
                    hit = np.flatnonzero(marks[np.minimum(np.searchsorted(marks, triples), len(marks) - 1)] == triples)
                    for r in np.unique(np.searchsorted(first, hit, "right") - 1).tolist():
                        text_start = int(bounds[r])
                        place = lambda byte: len(part[text_start:byte].tobytes().decode())  # noqa: B023, E731
                        for name, coverage, _, a, b in scan(words[first[r] : first[r + 1]], known):
                            findings[r].append({"license": name, "coverage": coverage, "start": place(int(starts[first[r] + a])), "end": place(int(ends[first[r] + b - 1]))})
                kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(findings, kind)], ["doc_id", "findings"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), text_column).mapInArrow(run, "doc_id long, findings array<struct<license string, coverage double, start long, end long>>")


def report(findings: DataFrame) -> DataFrame:
    """doc_id, n_findings, licenses (distinct, ascending, comma-joined), coverage (the best)."""
    names = F.array_sort(F.array_distinct(F.transform("findings", lambda f: f["license"])))
    return findings.select("doc_id", F.size("findings").cast("long").alias("n_findings"), F.array_join(names, ",").alias("licenses"), F.round(F.coalesce(F.array_max(F.transform("findings", lambda f: f["coverage"])), F.lit(0.0)), 6).alias("coverage"))
