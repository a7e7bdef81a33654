"""License scan: winnowed fingerprints of templates in an inverted index pick candidates, banded alignment verifies them.

A text is cut into tokens (letters and digits, in lower case). Where a winnowed fingerprint of a document is in the index, the template
that has it may lie along that diagonal. Hits of one template whose diagonals are near make a candidate; the template is aligned with
the document around it within a band, which gives the matched tokens and the span of characters.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Tokens of a gram and grams of a window: K + WINDOW - 1 equal tokens in a row are found for certain.
K = 3
WINDOW = 3
#: Tokens by which an alignment may leave a candidate's diagonals, and the share of the template's tokens that must match.
BAND = 8
COVERAGE = 0.8
#: Templates of one pass; more are scanned in several passes, so that the index of a pass stays small.
PASS_TEMPLATES = 1_000

# Notices as license texts give them.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "Apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version."
    ),
    "BSD-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:"
    ),
    "MPL-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
}

_TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+")
#: ASCII characters other than letters and digits end a token; bytes of other characters belong to it.
_TO_SPACE = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256))
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def _grams(ids: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k ids in a row."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = (out ^ (ids[j : j + n] + np.uint64(1))) * _FACTORS[j % len(_FACTORS)]
        out ^= out >> np.uint64(29)
    return out


def winnow(grams: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the smallest hash of each window, the rightmost of equal ones."""
    if not len(grams):
        return np.empty(0, np.int64)
    window = min(window, len(grams))
    views = np.lib.stride_tricks.sliding_window_view(grams[::-1], window)
    starts = np.arange(len(views))
    return np.unique(len(grams) - 1 - (starts + views.argmin(axis=1)))


class Scanner:
    """Finds a set of templates in texts."""

    def __init__(self, templates: dict[str, str], k: int = K, window: int = WINDOW, band: int = BAND, coverage: float = COVERAGE):
        self.k, self.window, self.band, self.coverage = k, window, band, coverage
        self.names = sorted(templates)
        # Only words of templates have numbers of their own; equal runs of words stay equal.
        self.number: dict[bytes, int] = {}
        self.templates = []
        for name in self.names:
            tokens = templates[name].encode().lower().translate(_TO_SPACE).split()
            self.templates.append(np.array([self.number.setdefault(t, len(self.number) + 1) for t in tokens], np.uint64))
        self.index: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, ids in enumerate(self.templates):
            grams = _grams(ids, min(k, max(1, len(ids))))
            for at in winnow(grams, window).tolist():
                self.index[int(grams[at])].append((t, at))
        self.hashes = np.array(sorted(self.index), np.uint64)

    def scan(self, text: bytes) -> list[tuple[str, float, int, int, int]]:
        """(template, coverage, matched tokens, start, end) of each occurrence; start and end count code points."""
        tokens = text.lower().translate(_TO_SPACE).split()
        if not len(self.hashes) or not tokens:
            return []
        get = self.number.get
        ids = np.fromiter((get(t, 0) for t in tokens), np.uint64, len(tokens))
        grams = _grams(ids, self.k)
        at = winnow(grams, self.window)
        kept = grams[at]
        place = np.minimum(np.searchsorted(self.hashes, kept), len(self.hashes) - 1)
        found = at[self.hashes[place] == kept]
        if not len(found):
            return []
        hits: dict[int, list[int]] = defaultdict(list)
        for position in found.tolist():
            for template, own in self.index[int(grams[position])]:
                hits[template].append(position - own)
        spans, out = None, []
        for template, diagonals in hits.items():
            # At most a quarter of the template, so that two occurrences in a row are two candidates.
            band = min(self.band, max(1, len(self.templates[template]) // 4))
            for low, high in candidates(sorted(diagonals), band):
                matched = align(self.templates[template], ids, low, high, band)
                if matched and len(matched) >= self.coverage * len(self.templates[template]):
                    if spans is None:
                        spans = [m.span() for m in _TOKEN.finditer(text.lower())]
                    first, last = spans[matched[0]][0], spans[matched[-1]][1]
                    start = len(text[:first].decode("utf-8", "replace"))
                    end = start + len(text[first:last].decode("utf-8", "replace"))
                    share = len(matched) / len(self.templates[template])
                    out.append((self.names[template], share, len(matched), start, end))
        return sorted(set(out), key=lambda o: (o[3], o[4], o[0]))


def candidates(diagonals: list[int], band: int) -> Iterator[tuple[int, int]]:
    """Ranges of diagonals whose neighbours are at most a band apart, and no range wider than two bands."""
    low = high = diagonals[0]
    for d in diagonals[1:]:
        if d - high > band or d - low > 2 * band:
            yield low, high
            low = d
        high = d
    yield low, high


def align(template: np.ndarray, ids: np.ndarray, low: int, high: int, band: int) -> list[int]:
    """Document tokens that match the template's in order, the most that there are within the band (longest common
    subsequence), those nearest to each other first."""
    first = max(0, low - band)
    want, have = template.tolist(), ids[first : high + band + len(template)].tolist()
    offset, width = low - band - first, high - low + 2 * band + 1
    # best[i][j]: (matched tokens, minus gaps) of template[i:] and the document from diagonal j on.
    rows = [[(0, 0)] * (width + 2) for _ in range(len(want) + 1)]
    for i in range(len(want) - 1, -1, -1):
        row, below = rows[i], rows[i + 1]
        for j in range(width - 1, -1, -1):
            at = i + j + offset
            best = max(below[j - 1] if j else (0, 0), row[j + 1] if j + 1 < width else (0, 0))
            if best[0]:
                best = (best[0], best[1] - 1)
            if 0 <= at < len(have) and have[at] == want[i]:
                best = max(best, (below[j][0] + 1, below[j][1]))
            row[j] = best
    matched, i = [], 0
    j = max(range(width), key=lambda c: rows[0][c])
    while i < len(want) and j < width and rows[i][j][0]:
        at = i + j + offset
        took = 0 <= at < len(have) and have[at] == want[i] and rows[i][j] == (rows[i + 1][j][0] + 1, rows[i + 1][j][1])
        if took:
            matched.append(first + at)
            i += 1
        elif j + 1 < width and rows[i][j + 1][0] == rows[i][j][0]:
            j += 1
        else:
            i, j = i + 1, j - 1
            if j < 0:
                break
    return matched


_SCANNERS: dict[tuple, Scanner] = {}


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, license, coverage, matched_tokens, start, end: one row for each place of a row of `docs` where a template matches.

    Coverage is the share of the template's tokens that the document has there, in order. Start and end are code points of
    the whole text. Null and empty texts match nothing; null ids and repeated rows are scanned like any other; other columns are not
    looked at; an empty table gives an empty result. A template without tokens matches nothing. There is no shuffle; templates
    beyond PASS_TEMPLATES are scanned in further passes, so what a task holds has a bound.
    """
    chosen = sorted((TEMPLATES if templates is None else templates).items())
    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "cast(cast(text as string) as binary) as text")
    schema = "doc_id long, license string, coverage double, matched_tokens int, start long, end long"

    def one_pass(part: tuple[tuple[str, str], ...]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if (part, coverage) not in _SCANNERS:
                _SCANNERS.clear()
                _SCANNERS[part, coverage] = Scanner(dict(part), coverage=coverage)
            scanner = _SCANNERS[part, coverage]
            for batch in batches:
                found = [
                    (doc_id, *match)
                    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1))
                    for match in scanner.scan(text.as_py() or b"")
                ]
                kinds = (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int64(), pa.int64())
                columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "license", "coverage", "matched_tokens", "start", "end"])

        return rows.mapInArrow(run, schema)

    result = one_pass(tuple(chosen[:PASS_TEMPLATES]))
    for at in range(PASS_TEMPLATES, len(chosen), PASS_TEMPLATES):
        result = result.unionByName(one_pass(tuple(chosen[at : at + PASS_TEMPLATES])))
    return result
