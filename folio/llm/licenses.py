"""License scans: MinHash bands over text windows, then exact containment.

A template is looked for in windows of about its own length. Windows overlap
by three quarters, so that one of them covers a copy but for an eighth at
either end; ``hit_probability`` of the bands is then above 99 in a hundred.
What the bands retrieve is verified by the template's own shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.runtime import small_batches
from folio.llm.words import PUNCTUATION, Words, mix, windows, words

SHINGLE = 3
#: With one row a band any shared least shingle is a hit: verification is cheap, and few notices may be missed.
BANDS = 8
ROWS = 1
CONTAINED = 0.8

# The wording of licence notices.
TEMPLATES = {
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "mit-notice": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "mit": "Released under the MIT License.",
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "isc-notice": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "unlicense-notice": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def hit_probability(similarity: float, bands: int = BANDS, rows: int = ROWS) -> float:
    """The probability that two windows of this Jaccard similarity share a band."""
    return 1 - (1 - similarity**rows) ** bands


def _salts() -> np.ndarray:
    return mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def _least(values: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The least of ``length`` values from each start, by doubling."""
    span, least = 1, values
    while 2 * span <= length:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    return np.minimum(least[starts], least[starts + length - span])


def _bands(hashes: np.ndarray, starts: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """(band, key of each window): windows are runs of ``length`` shingles."""
    salts = _salts()
    for b in range(BANDS):
        key = np.zeros(len(starts), np.uint64)
        for r in range(ROWS):
            key = key * np.uint64(0x9E3779B97F4A7C15) + _least(hashes * salts[b * ROWS + r], starts, length)
        yield b, key


def _whole_bands(hashes: np.ndarray, bounds: np.ndarray, docs: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(band, key of each document) with all of a document's shingles as its window."""
    salts = _salts()
    mine = np.concatenate([np.arange(bounds[d], bounds[d + 1]) for d in docs])
    at = np.concatenate([[0], np.cumsum(bounds[docs + 1] - bounds[docs])[:-1]])
    for b in range(BANDS):
        key = np.zeros(len(docs), np.uint64)
        for r in range(ROWS):
            key = key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(hashes[mine] * salts[b * ROWS + r], at)
        yield b, key


class TemplateIndex:
    """Templates by the bands of their shingles; those of one length class share a window length."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.names = sorted(templates)
        self.hashes: list[np.ndarray] = []
        for name in self.names:
            w = next(words(pa.array([templates[name]]), lower=True, space=PUNCTUATION), None)
            h = windows(w, SHINGLE)[1] if w is not None else np.zeros(0, np.uint64)
            if not len(h):
                raise ValueError(f"template {name} has fewer than {SHINGLE} words")
            self.hashes.append(h)
        self.lengths = sorted({self._window(len(h)) for h in self.hashes})
        self.tables: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for length in self.lengths:
            members = [t for t, h in enumerate(self.hashes) if self._window(len(h)) == length]
            per_band: list[list[tuple[int, int]]] = [[] for _ in range(BANDS)]
            for t in members:
                for b, key in _bands(self.hashes[t], np.zeros(1, np.int64), len(self.hashes[t])):
                    per_band[b].append((int(key[0]), t))
            self.tables[length] = [(np.array([k for k, _ in sorted(x)], np.uint64), np.array([t for _, t in sorted(x)])) for x in per_band]

    @staticmethod
    def _window(n: int) -> int:
        """Window lengths go up by an eighth, so that few are in use and each is near its templates' lengths."""
        length = 3
        while length < n and length + max(1, length // 8) <= n:
            length += max(1, length // 8)
        return length

    def _hits(self, length: int, band: int, keys: np.ndarray, doc: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(document, template, start) of each window whose key a template has in this band."""
        table, members = self.tables[length][band]
        i = np.searchsorted(table, keys)
        for j in np.flatnonzero((i < len(table)) & (table[np.minimum(i, len(table) - 1)] == keys)):
            k = i[j]
            while k < len(table) and table[k] == keys[j]:
                yield int(doc[starts[j]]), int(members[k]), int(starts[j])
                k += 1

    def scan(self, column: pa.Array) -> Iterator[tuple[int, str, int, int, float]]:
        """(row, template, first code point, end, containment) of every match, in order of row and template."""
        for w in words(column, lower=True, space=PUNCTUATION):
            yield from self._scan_block(w)

    def _scan_block(self, w: Words) -> Iterator[tuple[int, str, int, int, float]]:
        at, hashes = windows(w, SHINGLE)
        doc = w.doc[at]
        bounds = np.searchsorted(doc, np.arange(len(w.counts) + 1))
        found: set[tuple[int, int, int]] = set()
        for length in self.lengths:
            step = max(1, length // 4)
            # windows at every step of each document, and one that ends with it
            n = np.diff(bounds)
            count = np.where(n >= length, (n - length) // step + 1, 0)
            own = np.repeat(bounds[:-1], count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * step
            starts = np.concatenate([own, (bounds[1:] - length)[n >= length]])
            # a document that is shorter than a window is one by itself
            short = np.flatnonzero((n > 0) & (n < length))
            for b, keys in _bands(hashes, starts, length) if len(starts) else ():
                found.update(self._hits(length, b, keys, doc, starts))
            for b, keys in _whole_bands(hashes, bounds, short) if len(short) else ():
                found.update(self._hits(length, b, keys, doc, bounds[short]))
        last: dict[tuple[int, int], int] = {}
        for d, t, start in sorted(found):
            template = self.hashes[t]
            n = len(template)
            lo, hi = max(bounds[d], start - n, last.get((d, t), 0)), min(bounds[d + 1], start + 2 * n)
            if lo >= hi:
                continue
            held = np.flatnonzero(np.isin(hashes[lo:hi], template)) + lo
            kinds, first_at = np.unique(hashes[held], return_index=True)
            share = len(kinds) / len(np.unique(template))
            if share >= CONTAINED:
                # up to where the last of the shingles is first seen: what follows may be the next copy
                a, b = int(held[0]), int(held[first_at.max()])
                last[d, t] = b + 1
                begin, end = w.starts[at[a]], w.ends[at[b] + SHINGLE - 1]
                head = w.bounds[d]
                chars = lambda x, y: int(((w.data[x:y] & 0xC0) != 0x80).sum())
                first = chars(head, begin)
                yield w.first + d, self.names[t], first, first + chars(begin, end), share


def license_matches(docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, start, end, containment) of every place that holds a template.

    Words are runs of letters and digits, in any case. A place matches when
    ``CONTAINED`` of the template's shingles are in it; places of one template
    do not overlap. Null and empty texts match nothing, very long ones are
    scanned whole, null ids are returned as such, repeated rows as often as
    given, places of equal containment all; an empty table gives an empty
    result, and other columns are ignored.
    Documents are not shuffled; templates, a bounded list, go with the code.
    """
    index = TemplateIndex(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(index.scan(batch["text"]))
            if rows:
                i, name, start, end, share = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(i, pa.int64())), pa.array(name), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(share, pa.float64())], names=["doc_id", "license", "start", "end", "containment"])

    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, license string, start long, end long, containment double")
