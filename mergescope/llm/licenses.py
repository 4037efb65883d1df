"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies them.

Texts become lower-case words without outer punctuation, and five-word shingles. A window starts at every shingle; its
size is 1, 2, 4 or 8 shingles, the largest that fits the template. A window of 4 or 8 has four bands of one value, so at a
similarity of 0.8 to a template's window it shares one with probability 0.998; windows of 1 or 2 can only be that similar
if they are equal, and then share their one band. A match at containment 0.8 of a long template also holds whole windows
of it, whose bands are all equal. What is retrieved is verified by the share of the template's shingles that the text
holds near the window. Templates are a short fixed list held by every task, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
CONTAINED = 0.8
#: Window sizes in shingles with their numbers of bands.
BANDS = {1: 1, 2: 1, 4: 4, 8: 4}
CACHED_WORDS = 400_000
LONGEST_CACHED = 64
DOCS_AT_ONCE = 256
MIX = np.uint64(0xBF58476D1CE4E5B9)
TABLE_BITS = 20

# Notices and conditions of public licenses.
TEMPLATES: tuple[tuple[str, str, str], ...] = (
    ("MIT", "mit_statement", "Released under the MIT License"),
    ("MIT", "mit_licensed", "Licensed under the MIT License"),
    ("MIT", "mit_grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "apache_statement", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "apache_notice", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "gpl3_statement", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "gpl3_notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "gpl2_notice", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "lgpl3_notice", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD", "bsd_conditions", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("ISC", "isc_grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "mpl2_notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "unlicense_notice", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC-BY-4.0", "cc_by", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "cc_by_sa", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "cc_by_nc", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "cc_by_long", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "cc_by_nc_long", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
)

def stripped(token: str) -> str:
    """A token from its first letter or digit to its last; empty where it has none."""
    if token.isalnum():
        return token
    at = [i for i, c in enumerate(token) if c.isalnum()]
    return token[at[0] : at[-1] + 1] if at else ""


def words_of(text: str | None) -> list[str]:
    """Lower-case words without the punctuation around them."""
    return [w for w in map(stripped, (text or "").lower().split()) if w]


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * MIX
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    n = len(words) - SHINGLE + 1
    if n < 1:
        return np.empty(0, dtype=np.uint64)
    out = words[:n].copy()
    for i in range(1, SHINGLE):
        out = out * np.uint64(0x100000001B3) + words[i : n + i]
    return mixed(out, 1)


def band_keys(shingles: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(size, keys of all windows of that size) for each size and band."""
    for band in range(max(BANDS.values())):
        least, reach = mixed(shingles, 2 + band), 1
        while True:
            if band < BANDS[reach]:
                yield reach, least
            if 2 * reach not in BANDS or len(least) <= reach:
                break
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2


class Scanner:
    def __init__(self, templates: list[tuple[str, str, str]]):
        self.cache: dict[str, int] = {}
        self.words = [words_of(text) for *_, text in templates]
        self.sets = [frozenset(zip(*(w[i:] for i in range(SHINGLE)), strict=False)) for w in self.words]
        found: dict[int, list[tuple[int, int, int]]] = {size: [] for size in BANDS}
        for t, words in enumerate(self.words):
            shingles = shingle_hashes(self.hashes(words))
            own = max(size for size in BANDS if size <= len(shingles))
            for size, keys in band_keys(shingles):
                if size == own:
                    found[size].extend((int(k), t, at) for at, k in enumerate(keys))
        self.sizes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for size, keys in found.items():
            if keys:
                keys.sort()
                known, table = np.array([k for k, *_ in keys], dtype=np.uint64), np.zeros(1 << TABLE_BITS, dtype=bool)
                table[(known & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)] = True
                self.sizes[size] = known, np.array([t for _, t, _ in keys]), np.array([at for *_, at in keys]), table

    def hashes(self, tokens: list[str]) -> np.ndarray:
        """Hashes of the words of lower-case tokens, those without a letter or digit left out."""
        cache = self.cache
        if len(cache) > CACHED_WORDS:
            cache.clear()
        long = []
        for token in set(tokens).difference(cache):
            word = stripped(token)
            cache[token] = (xxhash.xxh3_64_intdigest(word) | 1) if word else 0
            if len(token) > LONGEST_CACHED:
                long.append(token)
        out = np.fromiter(map(cache.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
        for token in long:
            del cache[token]
        return out[out != 0]

    def candidates(self, hashes: np.ndarray) -> list[tuple[int, int, int]]:
        """(word of the window, template, word at which that would begin) of every retrieved window."""
        found: set[tuple[int, int, int]] = set()
        for size, key in band_keys(shingle_hashes(hashes)) if len(hashes) >= SHINGLE else ():
            if size not in self.sizes:
                continue
            known, template, offset, table = self.sizes[size]
            for at in np.flatnonzero(table[(key & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)]).tolist():
                first, last = np.searchsorted(known, key[at], "left"), np.searchsorted(known, key[at], "right")
                found.update((at, int(template[i]), at - int(offset[i])) for i in range(first, last))
        return sorted(found)

    def scan_all(self, texts: list[str | None]) -> list[list[tuple[int, int, int, float]]]:
        """For each text the verified matches; windows over the end of a text retrieve nothing that holds in one."""
        hashes = [self.hashes((t or "").lower().split()) for t in texts]
        ends = np.cumsum([len(h) for h in hashes])
        begun: dict[int, set[tuple[int, int]]] = {}
        for at, template, begin in self.candidates(np.concatenate(hashes)) if texts else ():
            text = int(np.searchsorted(ends, at, side="right"))
            begun.setdefault(text, set()).add((template, begin - int(ends[text]) + len(hashes[text])))
        return [self.verified(words_of(t), begun[i]) if i in begun else [] for i, t in enumerate(texts)]

    def verified(self, words: list[str], begun: set[tuple[int, int]]) -> list[tuple[int, int, int, float]]:
        """(template, first word, words, containment) of the verified matches; those of a template don't overlap."""
        by_template: dict[int, list[tuple[float, int, int]]] = {}
        for t, begin in begun:
            slack = len(self.words[t]) // 4
            first, last = max(0, begin - slack), min(len(words), begin + len(self.words[t]) + slack)
            shingles = list(zip(*(words[first + i : last] for i in range(SHINGLE)), strict=False))
            hits = [i for i, s in enumerate(shingles) if s in self.sets[t]]
            share = len({shingles[i] for i in hits}) / len(self.sets[t])
            if share >= CONTAINED:
                by_template.setdefault(t, []).append((-share, first + hits[0], hits[-1] - hits[0] + SHINGLE))
        out = []
        for t, matches in by_template.items():
            taken: list[tuple[int, int]] = []
            for share, first, n in sorted(set(matches)):
                if all(first >= b or first + n <= a for a, b in taken):
                    taken.append((first, first + n))
                    out.append((t, first, n, -share))
        return sorted(out, key=lambda m: (m[1], m[0]))


def license_matches(
    docs: DataFrame, templates: tuple[tuple[str, str, str], ...] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, license, template, first_word, n_words, containment): one row for each match, in whole texts.

    templates: (license, name, text), a short list; those of fewer than five words can't be found and are refused. A null
    or empty text has no match; rows with equal or null ids are scanned each for itself; other columns are ignored.
    """
    listed = [tuple(t) for t in templates]
    if short := [name for _, name, text in listed if len(words_of(text)) < SHINGLE]:
        raise ValueError(f"templates of fewer than {SHINGLE} words: {short}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(listed)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            matches = [m for at in range(0, len(texts), DOCS_AT_ONCE) for m in scanner.scan_all(texts[at : at + DOCS_AT_ONCE])]
            found = [(i, m) for i, own in enumerate(matches) for m in own]
            columns = [[listed[m[0]][0] for _, m in found], [listed[m[0]][1] for _, m in found]]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array([i for i, _ in found], pa.int64())), *(pa.array(c, pa.string()) for c in columns),
                    pa.array([m[1] for _, m in found], pa.int64()), pa.array([m[2] for _, m in found], pa.int64()),
                    pa.array([m[3] for _, m in found], pa.float64()),
                ],
                names=["id", "license", "template", "first_word", "n_words", "containment"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, license string, template string, first_word long, n_words long, containment double"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
