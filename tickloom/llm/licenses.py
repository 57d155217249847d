"""License scans: winnowed fingerprints of templates in an inverted index, then banded alignment of the candidates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tickloom.llm.common import NOT_ALPHANUMERIC, documents_of, each_text, records, shingles

# Wordings of public licenses and of their usual notices
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-short": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either '
        "express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "gpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details."
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        'Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies."
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
        "met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
}

#: Words of a fingerprint, and fingerprints of a winnowing window: any GRAM + WINDOW - 1 common words share one.
GRAM, WINDOW = 3, 2
#: Share of a template's fingerprints that a region must hold to be aligned, and of its words to be reported.
CANDIDATE, COVERAGE = 0.3, 0.8
#: Words by which an alignment may leave its diagonal, at most.
BAND = 8


def winnow(h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the (rightmost) minima of all windows of the fingerprints."""
    n = len(h)
    if n <= window:
        return np.array([n - 1 - int(np.argmin(h[::-1]))]) if n else np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(h, window)[:, ::-1]
    return np.unique(np.arange(n - window + 1) + window - 1 - views.argmin(axis=1))


def banded_alignment(a: np.ndarray, b: np.ndarray, band: int = BAND) -> list[tuple[int, int]]:
    """Pairs of equal positions of the longest common subsequence of a and b that stays within a band around the
    main diagonal of a."""
    width = 2 * band + 1
    best = np.zeros((len(a) + 1, width + 1), np.int32)  # the last column stays 0: outside the band
    offsets = np.arange(width) - band
    equal = np.zeros((len(a), width), bool)
    for i in range(len(a)):
        j = i + offsets
        inside = (j >= 0) & (j < len(b))
        equal[i, inside] = b[j[inside]] == a[i]
        row = np.maximum(best[i, :width] + equal[i], best[i, 1:])
        best[i + 1, :width] = np.maximum.accumulate(row)
    pairs, i, k = [], len(a), width - 1
    while i > 0 and best[i, k]:
        if k and best[i, k - 1] == best[i, k]:
            k -= 1
        elif best[i - 1, k + 1] == best[i, k]:
            i, k = i - 1, k + 1
        elif equal[i - 1, k]:
            pairs.append((i - 1, i - 1 + k - band))
            i -= 1
        else:
            break
    return pairs[::-1]


class Index:
    """Templates' words, and their winnowed fingerprints with the templates and positions that hold them."""

    def __init__(self, templates: dict[str, str]):
        self.names, self.words, rows, self.n_prints = list(templates), [], [], []
        for t, (_, _, _, _, h) in enumerate(each_text(list(templates.values()), lower=True, separator=NOT_ALPHANUMERIC)):
            self.words.append(h)
            f = shingles(h, GRAM)
            at = winnow(f)
            self.n_prints.append(max(len(at), 1))
            rows += [(int(f[p]), t, int(p)) for p in at]
        rows.sort()
        self.prints = np.array([r[0] for r in rows], np.uint64)
        self.template = np.array([r[1] for r in rows], np.int64)
        self.position = np.array([r[2] for r in rows], np.int64)

    def regions(self, h: np.ndarray):
        """(template, first word of a region that may hold it) of a document's words."""
        f = shingles(h, GRAM)
        at = winnow(f)
        lo, hi = np.searchsorted(self.prints, f[at]), np.searchsorted(self.prints, f[at], "right")
        hits = [(int(self.template[x]), int(p) - int(self.position[x]), int(self.position[x])) for p, a, b in zip(at[hi > lo], lo[hi > lo], hi[hi > lo]) for x in range(a, b)]
        hits.sort()
        k = 0
        while k < len(hits):
            t, diagonal, _ = hits[k]
            end = k
            while end < len(hits) and hits[end][0] == t and hits[end][1] <= diagonal + BAND:
                end += 1
            if len({x[2] for x in hits[k:end]}) >= CANDIDATE * self.n_prints[t]:
                yield t, hits[k + (end - k) // 2][1]
            k = end


def license_spans(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, license, coverage, n_matched, span_start, span_end (code points, end exclusive) of each place in a
    document that holds at least the given share of a template's words, in order.

    Words are runs of ASCII letters, digits and all other characters beyond ASCII, lower-cased in A-Z. Null or empty
    text: no rows. Repeated rows each get theirs; regions of one template that start within BAND words of each other
    are one; other columns are dropped; empty table or no templates: no rows. The templates are a bounded library
    that goes along with the code.
    """
    index = Index(TEMPLATES if templates is None else templates)
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("n_matched", pa.int64()), ("span_start", pa.int64()), ("span_end", pa.int64())])

    def scan(batches):
        for batch in batches:
            out: dict[str, list] = {f: [] for f in schema.names}
            doc_ids = batch.column("doc_id").to_pylist()
            for i, data, starts, ends, h in each_text(batch.column("text").to_pylist(), lower=True, separator=NOT_ALPHANUMERIC):
                for t, first in index.regions(h) if len(h) else ():
                    a = index.words[t]
                    begin = max(first, 0)
                    lead = begin - first  # words of the template that would lie before the document
                    pairs = banded_alignment(a[lead:], h[begin : begin + len(a) - lead + BAND])
                    if not pairs or len(pairs) < coverage * len(a):
                        continue
                    lo, hi = int(starts[begin + pairs[0][1]]), int(ends[begin + pairs[-1][1]])
                    lo_c = len(data[:lo].decode("utf-8", "surrogatepass"))
                    row = (doc_ids[i], index.names[t], len(pairs) / len(a), len(pairs), lo_c, lo_c + len(data[lo:hi].decode("utf-8", "surrogatepass")))
                    for name, value in zip(schema.names, row):
                        out[name].append(value)
            yield records(schema, out)

    return documents_of(docs).mapInArrow(scan, "doc_id long, license string, coverage double, n_matched long, span_start long, span_end long")
