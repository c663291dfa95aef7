"""License scans: winnowed fingerprints of templates pick candidates, banded alignment reports coverage and spans.

Templates are tokenised (lower-cased runs of letters and digits), their k-grams hashed, and of each window of ``WINDOW`` k-grams the
least hash is kept. The inverted index maps each kept hash to its templates and places. All k-grams of a document are looked
up, so any run of K + WINDOW - 1 tokens that it shares with a template is found; hits vote for (template, diagonal). Around each candidate's diagonals a banded local alignment (match, mismatch, gap) of the document's tokens with the
template's gives the matched template tokens and the span of the document. A match's tokens are then marked as used, and the band is aligned
again until nothing more passes, so notices that follow each other are all reported.

Templates of fewer than K tokens are looked up as they are, in full. `SPDX-License-Identifier:` lines are read by rule: a match per line, named SPDX- and the expression that
stands there, whatever it is.

The index depends on the templates only. They may be given as a table: Spark hashes and winnows it, its size is measured, and only an index of at most INDEX_BYTES is
sent with the tasks; a larger one is cut into parts by template, and the documents are scanned part by part. Documents are scanned whole, one by one, and
nothing of them is shuffled. Templates without a token match nothing; of several templates of one name each counts. Defined results: null, empty and unmatched texts have an empty list of matches. Repeated rows get equal lists; one
document may match several templates, or one several times; of matches that overlap, the one with more matched tokens stays (then the
one with more coverage, the earlier one, the smaller name). A notice with more than about BAND foreign tokens inside comes back as one match for
each part that passes by itself. An empty table gives no rows. Other columns pass through; an own column named matches is replaced.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import arrow_batch, arrow_rows, discarded, stored, stored_at
from .language_id import ddl_of

K, WINDOW = 3, 2
BAND = 12
MATCH, MISMATCH, GAP_COST = 2, -1, -1
#: A match is reported from this share of the template's tokens on, in percent, or from this many matched tokens.
MIN_PERCENT, MIN_TOKENS = 60, 24
#: Templates of fewer tokens than SHORT must match in full.
SHORT = 8
#: Bytes of an index that is sent with the tasks.
INDEX_BYTES = 32 << 20

# Short public license notices, by their common names.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT-line": "Permission is hereby granted, free of charge, to any person obtaining a copy",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-3.0-line": "This program is free software: you can redistribute it and/or modify",
    "GPL-2.0-line": "licensed under the GNU General Public License, version 2.",
    "GPL-3.0-short": "licensed under the GNU General Public License, version 3.",
    "MIT-short": "Released under the MIT License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-line": "Licensed under CC BY 4.0.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    "All-rights-reserved": "All rights reserved.",
}

_token = re.compile(r"[^\W_]+")
_id = r"\(*[A-Za-z0-9][A-Za-z0-9.+-]*[A-Za-z0-9+]\)*"
_spdx = re.compile(rf"SPDX-License-Identifier:[ \t]*({_id}(?:[ \t]+(?:AND|OR|WITH)[ \t]+{_id})*)")


def token_spans(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    found = list(_token.finditer(text))
    return [m.group().lower() for m in found], [m.span() for m in found]


def _codes(tokens: list[str]) -> np.ndarray:
    return np.fromiter((zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in tokens), np.uint64, len(tokens))


def gram_hashes(codes: np.ndarray, k: int = K) -> np.ndarray:
    if len(codes) < k:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(codes) - k + 1, np.uint64)
    for i in range(k):
        h = (h ^ codes[i : len(codes) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def winnowed(h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The places of each window's least hash (the rightmost of equal ones)."""
    if len(h) <= window:
        return np.array([len(h) - 1 - int(np.argmin(h[::-1]))]) if len(h) else np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(h, window)[:, ::-1]
    return np.unique(np.arange(len(views)) + window - 1 - np.argmin(views, 1))


@dataclass
class Index:
    names: list[str]
    codes: list[np.ndarray]
    hashes: np.ndarray  # sorted
    owner: np.ndarray
    place: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # by number of tokens: sorted hashes of whole templates, and which these are


def _fingerprints(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens' codes of a template, its winnowed hashes and their places."""
    codes = _codes(token_spans(text or "")[0])
    h = gram_hashes(codes)
    places = winnowed(h)
    return codes, h[places], places


def _indexed(templates: list[tuple[str, np.ndarray, np.ndarray, np.ndarray]]) -> Index:
    names, codes = [t[0] for t in templates], [t[1] for t in templates]
    hashes = np.concatenate([np.zeros(0, np.uint64), *(t[2] for t in templates)])
    owner = np.repeat(np.arange(len(templates)), [len(t[2]) for t in templates])
    place = np.concatenate([np.zeros(0, np.int64), *(t[3] for t in templates)])
    order = np.lexsort((place, owner, hashes))
    short = {}
    for n in range(1, K):
        own = [i for i, c in enumerate(codes) if len(c) == n]
        whole = np.array([gram_hashes(codes[i], n)[0] for i in own], np.uint64)
        ranks = np.argsort(whole, kind="stable")
        short[n] = whole[ranks], np.array(own, np.int64)[ranks]
    return Index(names, codes, hashes[order], owner[order], place[order], short)


def build_index(templates: dict[str, str] | None = None) -> Index:
    """The inverted index of a small list of templates."""
    return _indexed([(name, *_fingerprints(text)) for name, text in (templates or TEMPLATES).items()])


def indexes_of(templates: DataFrame, most: int = INDEX_BYTES) -> Iterator[Index]:
    """The inverted index of a table of templates (name, text), in parts of at most about so many bytes (a single template may have more)."""
    schema = pa.schema([("name", pa.string()), ("codes", pa.binary()), ("hashes", pa.binary()), ("places", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(name, *(x.tobytes() for x in _fingerprints(text))) for name, text in arrow_rows(batch, "name", "text")]
            if rows:
                yield arrow_batch(schema, list(zip(*rows, strict=True)))

    made, path = stored_at(templates.select(F.col("name").cast("string").alias("name"), "text").mapInArrow(run, "name string, codes binary, hashes binary, places binary"), "templates")
    size = made.agg(F.coalesce(F.sum(F.octet_length("codes") + 3 * F.octet_length("hashes")), F.lit(0))).first()[0]
    parts = max(1, -(-size // most))
    for part in range(parts):
        rows = made.where(F.pmod(F.xxhash64("name", "codes"), F.lit(parts)) == part).orderBy("name", "codes").collect()
        yield _indexed([(r.name, np.frombuffer(r.codes, np.uint64), np.frombuffer(r.hashes, np.uint64), np.frombuffer(r.places, np.int64)) for r in rows])
    discarded(templates.sparkSession, path)


def banded(doc: np.ndarray, template: np.ndarray, diagonal: int, band: int) -> tuple[int, int, int, int, int]:
    """The best local alignment with document place - template place within band of the diagonal.

    Returns score, matched tokens, first and last document place (exclusive), and the diagonal halfway along the match. A row of the band is a few
    array operations: runs of document tokens without a counterpart are a running maximum.
    """
    width = 2 * band + 1
    step = np.arange(width)
    score, state = np.zeros(width, np.int64), np.zeros((3, width), np.int64)  # matched, first document place, first template place
    best = (0, 0, 0, 0, 0)
    for j in range(len(template)):
        i = j + diagonal - band + step
        valid = (i >= 0) & (i < len(doc))
        if not valid.any():
            score, state = np.zeros(width, np.int64), np.zeros((3, width), np.int64)
            continue
        same = valid & (doc[np.clip(i, 0, len(doc) - 1)] == template[j])
        top = score + np.where(same, MATCH, MISMATCH)
        source = np.stack((state[0] + same, np.where(score > 0, state[1], i), np.where(score > 0, state[2], j)))
        above = np.append(score[1:] + GAP_COST, GAP_COST)  # template token without a counterpart
        skips = above > top
        top = np.where(valid, np.where(skips, above, top), -len(template) - width)
        source = np.where(skips, np.append(state[:, 1:], np.zeros((3, 1), np.int64), 1), source)
        reach = np.maximum.accumulate(top - GAP_COST * step)  # document tokens without a counterpart
        origin = np.maximum.accumulate(np.where(top - GAP_COST * step == reach, step, 0))
        top = np.where(valid, np.maximum(reach + GAP_COST * step, 0), 0)
        score, state = top, np.where(top > 0, source[:, origin], 0)
        b = int(np.argmax(score))
        if score[b] > best[0]:
            best = (int(score[b]), int(state[0, b]), int(state[1, b]), int(i[b]) + 1, (int(state[1, b]) - int(state[2, b]) + int(i[b]) - j) // 2)
    return best


#: Stands for document tokens that a match has used up; no crc32 has this value.
USED = np.uint64(1 << 40)


def scan(text: str | None, index: Index, min_percent: int = MIN_PERCENT, min_tokens: int = MIN_TOKENS, identifiers: bool = True) -> list[dict]:
    """The matches of one whole text: template, coverage (matched share of its tokens, in percent), span in code points."""
    if not text or not (words := _token.findall(text)):
        return []
    codes = _codes([w.lower() for w in words])
    h = gram_hashes(codes)
    at = np.searchsorted(index.hashes, h)
    at[at == len(index.hashes)] = 0
    kept = np.nonzero(index.hashes[at] == h)[0] if len(index.hashes) else at[:0]
    found: list[dict] = []
    for m in _spdx.finditer(text) if identifiers and "SPDX-" in text else ():
        found.append({"template": f"SPDX-{' '.join(m[1].split())}", "coverage": 100.0, "matched_tokens": len(_token.findall(m.group())), "start": m.start(), "end": m.end()})
    whole = [(n, p, i) for n, (hashes, owners) in index.short.items() if len(hashes) for p, i in _exact(codes, n, hashes, owners)]
    if not len(kept) and not whole:
        return _apart(found)
    votes: dict[tuple[int, int], list[int]] = {}  # places of the hits
    for p in kept.tolist():
        a, b = np.searchsorted(index.hashes, h[p]), np.searchsorted(index.hashes, h[p], "right")
        for r in range(a, b):
            key = int(index.owner[r]), (p - int(index.place[r])) // BAND
            votes.setdefault(key, []).append(p)
    _, spans = token_spans(text)
    found += [{"template": index.names[i], "coverage": 100.0, "matched_tokens": n, "start": spans[p][0], "end": spans[p + n - 1][1]} for n, p, i in whole]
    free: dict[int, np.ndarray] = {}  # per template, the document's tokens that none of its matches has used
    for (owner, group), hits in sorted(votes.items(), key=lambda v: (-len(v[1]), v[0])):
        template, own = index.codes[owner], free.setdefault(owner, codes.copy())
        need = 100 if len(template) < SHORT else min_percent
        # a notice may stand several times along one band of diagonals: as often as fingerprints are left that no match has used
        while any(own[p] != USED and own[p + K - 1] != USED for p in hits):
            middle = group * BAND + BAND // 2
            for _ in range(2):  # the second time around the match that was found, which may lie at the band's edge
                first = max(0, middle - BAND)
                score, matched, a, b, at = banded(own[first : middle + len(template) + BAND + 1], template, middle - first, BAND)
                middle = first + at
            if not score or 100 * matched < need * len(template) and matched < min_tokens:
                break
            found.append({"template": index.names[owner], "coverage": 100.0 * matched / len(template), "matched_tokens": matched, "start": spans[first + a][0], "end": spans[first + b - 1][1]})
            own[first + a : first + b] = USED
    return _apart(found)


def _exact(codes: np.ndarray, n: int, hashes: np.ndarray, owners: np.ndarray) -> Iterator[tuple[int, int]]:
    """(place, template) where templates of n tokens stand as they are."""
    h = gram_hashes(codes, n)
    first, last = np.searchsorted(hashes, h), np.searchsorted(hashes, h, "right")
    for p in np.flatnonzero(last > first).tolist():
        yield from ((p, int(i)) for i in owners[first[p] : last[p]])


def _apart(found: list[dict]) -> list[dict]:
    """Of matches that overlap, the best, in order."""
    best: list[dict] = []
    taken: list[tuple[int, int]] = []  # spans of best, sorted and apart
    for f in sorted(found, key=lambda f: (-f["matched_tokens"], -f["coverage"], f["start"], f["template"] or "")):
        k = bisect.bisect(taken, (f["start"], f["end"]))
        if (k == 0 or taken[k - 1][1] <= f["start"]) and (k == len(taken) or f["end"] <= taken[k][0]):
            taken.insert(k, (f["start"], f["end"]))
            best.append(f)
    return sorted(best, key=lambda f: (f["start"], f["template"] or ""))


MATCHES = "array<struct<template:string,coverage:double,matched_tokens:bigint,start:bigint,`end`:bigint>>"


def scanned(docs: DataFrame, templates: dict[str, str] | DataFrame | None = None, most: int = INDEX_BYTES) -> DataFrame:
    """Adds matches to all columns of docs (an own column of that name is replaced). templates: a small list, or a table (name, text)."""
    rows = docs.select(*[c for c in docs.columns if c != "matches"]).withColumn("matches", F.lit(None).cast(MATCHES))
    kind = pa.list_(pa.struct([("template", pa.string()), ("coverage", pa.float64()), ("matched_tokens", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))

    def with_matches(rows: DataFrame, index: Index, first: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [_apart((known or []) + scan(text, index, identifiers=first)) if known else scan(text, index, identifiers=first) for text, known in arrow_rows(batch, "text", "matches")]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, kind)], names=batch.schema.names)

        return rows.mapInArrow(run, ddl_of(rows))

    before = None
    for i, index in enumerate(indexes_of(templates, most) if isinstance(templates, DataFrame) else [build_index(templates)]):
        if before is not None:  # the parts before have their say as a table: only one part is held at a time
            before = stored(before, "license-matches")
        before = with_matches(rows if before is None else before, index, i == 0)
    return before
