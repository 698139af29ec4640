"""License scans by patience alignment.

A region of a text that holds enough words of a template is aligned with it: words unique to both are anchors, the
longest increasing subsequence of their places is kept, and the gaps between them are aligned in the same way, after
equal words at both of their ends are matched. Coverage is the share of template words that are matched in order.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quakeline.llm.tokens import ALNUM, blocks, few_rows, lowered, split_words

# Notices and opening clauses of public licenses.
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MIT-notice": "Released under the MIT License.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}
#: Share of a template's words that must be matched, and how much longer than the template a region may be.
COVERAGE, SLACK = 0.8, 1.25


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs, in order of their first members, whose second members rise."""
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(pairs)
    for i, (_, y) in enumerate(pairs):
        k = bisect_left(tails, y)
        before[i] = ends[k - 1] if k else -1
        if k == len(tails):
            tails.append(y)
            ends.append(i)
        else:
            tails[k], ends[k] = y, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched places (i, j) of two word sequences, rising in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, k, j, m = todo.pop()
        while i < k and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < k and j < m and a[k - 1] == b[m - 1]:
            k, m = k - 1, m - 1
            out.append((k, m))
        if i == k or j == m:
            continue
        left, right = Counter(a[i:k]), Counter(b[j:m])
        where = {w: y for y, w in enumerate(b[j:m], j) if right[w] == 1}
        anchors = _rising([(x, where[w]) for x, w in enumerate(a[i:k], i) if left[w] == 1 and w in where])
        if anchors:
            out += anchors
            bounds = [(i - 1, j - 1), *anchors, (k, m)]
            todo += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(bounds[:-1], bounds[1:], strict=True)]
    return sorted(out)


def _templates() -> list[tuple[str, list[int], np.ndarray]]:
    out = []
    for name, text in TEMPLATES.items():
        h = split_words(lowered([text]), ALNUM).hashes
        out.append((name, h.tolist(), np.unique(h)))
    return out


def find(hashes: np.ndarray, templates: list, coverage: float = COVERAGE) -> list[tuple[str, float, int, int]]:
    """(license, coverage, first word, end word) of all regions of a text; of overlapping ones the longer template's."""
    found: list[tuple[str, float, int, int]] = []
    for name, words, vocabulary in sorted(templates, key=lambda t: -len(t[1])):
        k = np.searchsorted(vocabulary, hashes)
        k[k == len(vocabulary)] = 0
        inside = vocabulary[k] == hashes
        need, width = int(np.ceil(coverage * len(words))), int(np.ceil(SLACK * len(words)))
        if int(inside.sum()) < need:
            continue
        total = np.concatenate(([0], np.cumsum(inside)))
        starts = np.arange(len(hashes))
        dense = np.flatnonzero((total[np.minimum(starts + width, len(hashes))] - total[:-1] >= need) & inside)
        at = k = 0
        while (k := k + int(np.searchsorted(dense[k:], at))) < len(dense):
            lo = int(dense[k])
            hi = min(lo + width, len(hashes))
            matched = patience(words, hashes[lo:hi].tolist())
            if len(matched) >= need:
                first, end = lo + matched[0][1], lo + matched[-1][1] + 1
                if not any(first < e and s < end for _, _, s, e in found):
                    found.append((name, len(matched) / len(words), first, end))
                at = max(end, lo + 1)
            else:  # each step on brings one new word into reach, so this many are needed at least
                at = lo + need - len(matched)
    return sorted(found, key=lambda x: x[2:])


_SCHEMA = "doc_id long, n_licenses long, licenses string, coverage double, matched_words long, spans array<struct<license string, coverage double, start long, end long>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    templates = _templates()
    for batch in few_rows(batches):
        raw = lowered(batch.column(1).to_pylist())
        rows = []
        for part in blocks(raw):
            w = split_words(raw[part], ALNUM)
            for k, (lo, hi) in enumerate(zip(w.at[:-1].tolist(), w.at[1:].tolist(), strict=True)):
                rows.append([(n, c, int(w.start[lo + a] - w.offsets[k]), int(w.end[lo + b - 1] - w.offsets[k]), b - a) for n, c, a, b in find(w.hashes[lo:hi], templates)])
        spans = pa.array([[{"license": n, "coverage": c, "start": a, "end": b} for n, c, a, b, _ in r] for r in rows], pa.list_(pa.struct({"license": pa.string(), "coverage": pa.float64(), "start": pa.int64(), "end": pa.int64()})))
        yield pa.record_batch(
            [batch.column(0), pa.array([len(r) for r in rows], pa.int64()), pa.array([",".join(sorted({x[0] for x in r})) for r in rows], pa.string()), pa.array([max([0.0, *(x[1] for x in r)]) for r in rows], pa.float64()), pa.array([sum(x[4] for x in r) for r in rows], pa.int64()), spans],
            ["doc_id", "n_licenses", "licenses", "coverage", "matched_words", "spans"],
        )


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_licenses, licenses (sorted, comma-joined), coverage (the best), matched_words,
    spans (byte offsets in the text). Null and empty texts have none; repeated rows are answered alike; long texts are
    read whole; other columns don't matter, and an empty table gives an empty result."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scan, _SCHEMA)
