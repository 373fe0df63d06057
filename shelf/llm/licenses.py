"""License scans: MinHash bands over overlapping windows of words retrieve templates, exact shingle containment verifies them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelf.llm import common
from shelf.llm.decontam import words

SHINGLE = 5
LEAST = 0.8
#: Bands of one hash each. A window has less than four times the template's shingles, so at a containment of 0.8 its similarity is
#: 0.19 or more, and 64 bands all miss with a chance of 0.81 ** 64, one in 700,000. A template of one shingle is half of its
#: window, and the first 20 bands miss it with a chance of 0.5 ** 20, one in a million.
BANDS, BANDS_OF_ONE = 64, 20
#: Shingles of a text that are hashed at a time.
STRIDE = 1 << 12

#: Texts of common licenses and of the notices that name them (fixed values).
TEMPLATES = [
    ("mit-notice", "Released under the MIT License."),
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0."),
    ("gpl-3.0-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc-4.0-notice", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0-notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("mpl-2.0-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
            "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
            "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
            "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
            "substantial portions of the Software."),
    ("bsd-2-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
                     "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
                     "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
                     "the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                   "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
                   "in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY "
                   "KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
                "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed "
                "in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
                "PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
            "above copyright notice and this permission notice appear in all copies."),
]
FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("matches", T.ArrayType(T.StructType([
        T.StructField("template", T.StringType()), T.StructField("containment", T.DoubleType()),
        T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
    ]))),
])
FOUND_ARROW = pa.struct([
    ("n_words", pa.int64()),
    ("matches", pa.list_(pa.struct([("template", pa.string()), ("containment", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())]))),
])


def shingles(found: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each ``SHINGLE`` consecutive words; of all words if there are fewer. The same within a process."""
    if not found:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hash, found), np.int64, len(found)).view(np.uint64)
    n = max(1, len(w) - SHINGLE + 1)
    h = np.full(n, len(found[:SHINGLE]), np.uint64)
    for i in range(min(SHINGLE, len(w))):
        h = (h ^ w[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


class Library:
    """The templates' band values by window size, and their shingles for the exact check."""

    def __init__(self, templates: Sequence[tuple[str, str]]):
        rng = np.random.default_rng(7)
        self.flip = rng.integers(0, 1 << 32, (BANDS, 1), np.uint32)
        self.times = rng.integers(0, 1 << 32, (BANDS, 1), np.uint32) | np.uint32(1)
        self.offsets = np.arange(BANDS)[:, None] << 16
        self.names = [name for name, _ in templates]
        self.sets = [set(shingles(words(text)).tolist()) for _, text in templates]
        self.by_size: dict[int, tuple[np.ndarray, dict[tuple[int, int], list[int]]]] = {}
        for k, have in enumerate(self.sets):
            if have:
                size = 1 << (len(have) - 1).bit_length()
                maybe, at = self.by_size.setdefault(size, (np.zeros((BANDS, 1 << 16), bool), {}))
                low = self.bands(np.fromiter(have, np.uint64, len(have))).min(axis=1)
                for band, value in enumerate(low.tolist()):
                    maybe[band, value >> 16] = True
                    at.setdefault((band, value), []).append(k)

    def bands(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(32)).astype(np.uint32)[None, :] ^ self.flip) * self.times

    def windows(self, h: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(size, start, template) of the windows that share a band value: 2 * size shingles each, one every ``size``."""
        seen: set[tuple[int, int, int]] = set()
        largest = max(self.by_size, default=0)
        step = max(STRIDE, 2 * largest)
        for base in range(0, max(1, len(h) - largest) if largest else 0, step):
            part = self.bands(h[base : base + step + 2 * largest])
            size = 1
            while size <= largest:
                if size in self.by_size:
                    maybe, at = self.by_size[size]
                    rows = part[: BANDS_OF_ONE if size == 1 else BANDS]
                    low = np.minimum(rows[:, :-1], rows[:, 1:]) if rows.shape[1] > 1 else rows
                    cells = (low >> np.uint32(16)).astype(np.intp)
                    cells += self.offsets[: len(low)]
                    band, window = np.nonzero(maybe.ravel()[cells])
                    for b, w in zip(band.tolist(), window.tolist()):
                        for k in at.get((b, int(low[b, w])), ()):
                            seen.add((size, base + w * size, k))
                if part.shape[1] % 2:
                    part = np.concatenate([part, part[:, -1:]], axis=1)
                part = np.minimum(part[:, ::2], part[:, 1::2])
                size *= 2
        return iter(sorted(seen))

    def scan(self, text: str | None, least: float) -> dict:
        found = words(text)
        h = shingles(found)
        best: dict[int, list[list]] = {}
        for size, start, k in self.windows(h):
            window = h[start : start + 2 * size].tolist()
            hits = [i for i, x in enumerate(window) if x in self.sets[k]]
            share = len({window[i] for i in hits}) / len(self.sets[k])
            if share >= least:
                span = [start + hits[0], min(start + hits[-1] + SHINGLE, len(found)), share]
                spans = best.setdefault(k, [])
                if spans and span[0] < spans[-1][1]:
                    spans[-1] = [spans[-1][0], max(spans[-1][1], span[1]), max(spans[-1][2], share)]
                else:
                    spans.append(span)
        return {"n_words": len(found), "matches": [
            {"template": self.names[k], "containment": c, "first_word": i, "last_word": j - 1} for k in sorted(best, key=lambda k: self.names[k]) for i, j, c in best[k]
        ]}


def _scan(templates: Sequence[tuple[str, str]], least: float):
    @F.arrow_udf(returnType=FOUND)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        library = Library(templates)
        for batch in batches:
            yield pa.array([library.scan(t, least) for t in batch.to_pylist()], type=FOUND_ARROW)

    return scan


def scanned(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, text: str = "text", least: float = LEAST, into: str = "licenses") -> DataFrame:
    """``docs`` with a struct ``into`` (underscores added if taken): n_words and matches (template, containment, first_word, last_word).

    Words are lower-cased runs of letters and digits. A template of n shingles is sought in windows of 2 * size shingles, one every
    ``size``, size being n rounded up to a power of two, so each whole occurrence lies in a window; a window matches that holds
    ``least`` of the template's different shingles. Matches of one template that overlap are one. The templates are literals of
    the call, so their number is bounded by it. Null and empty texts match nothing; no templates: no matches; repeats each count.
    """
    return docs.withColumn(common.fresh(docs, into), _scan(list(templates), least)(F.col(text)))
