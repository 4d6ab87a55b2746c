"""License scans.

Templates are cut into word k-grams, winnowed (of every window of grams the least
hash is kept) and listed in an inverted index.  A document's own winnowed grams
look up the index; hits of one template near one diagonal make a candidate.  A
banded alignment of the template's words with the document's then gives matched
coverage and span.

A match needs its share of the template's words (coverage) and of all words from its first
to its last, those of the template that are missing among them (identity).  A replaced word counts
against identity twice: at identity 0.8 a match with replaced words covers 0.89 of its template;
one with words left out needs its coverage only.

The shortest run that is sure to share a fingerprint has WINDOW + GRAM - 1 words,
the length of the shortest template.

Edge cases: null, empty and wordless texts match nothing.  Equal templates are
reported each.  Of overlapping matches the one with most matched words stays (ties:
identity, then the first).  Repeated rows are reported once each, null ids are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textarrays import Words, chunks, shingle_hashes

#: Words of a gram, grams of a winnowing window.
GRAM, WINDOW = 2, 2
#: Least share of a template's words that a match covers, and of its fingerprints that
#: a candidate hits.
COVERAGE, CANDIDATE_SHARE = 0.8, 0.4
#: Least share of matched words among all words of the template and the span.
IDENTITY = 0.8
#: Words that may be added or missing along a match, as a share of the template.
BAND = 0.2

# Notices by which licenses are declared (short forms and standard headers).
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License."),
    "bsd-condition": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met"),
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version."),
    "mit": "Released under the MIT License.",
    "mit-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "public-domain": "This work has been released into the public domain.",
}


def winnow(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places of the kept grams: the least of every window inside a text (ties: the rightmost)."""
    n = len(grams)
    if not n:
        return np.zeros(0, np.int64)
    keep = np.zeros(n, bool)
    last = np.repeat(first[1:], np.diff(first))  # end of each gram's text
    if WINDOW == 1:
        return np.arange(n)
    at = np.arange(n)
    full = at[at + WINDOW <= last]
    best = full.copy()
    for k in range(1, WINDOW):
        best = np.where(grams[full + k] <= grams[best], full + k, best)
    keep[best] = True
    short = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < WINDOW))
    for t in short:
        keep[first[t] + int(np.argmin(grams[first[t]:first[t + 1]]))] = True
    return np.flatnonzero(keep)


def _grams(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and first word of every gram, and each text's first gram (texts of fewer words have none)."""
    number = np.maximum(words.counts - GRAM + 1, 0)
    first = np.concatenate(([0], np.cumsum(number)))
    start = np.arange(first[-1]) - np.repeat(first[:-1], number) + np.repeat(words.first[:-1], number)
    hashes = shingle_hashes(words.hash, GRAM)
    return (hashes[start] if first[-1] else np.zeros(0, np.uint64)), start, first


@dataclass
class Index:
    names: list[str]
    words: list[np.ndarray]
    prints: np.ndarray  # distinct fingerprints per template
    grams: np.ndarray  # sorted
    template: np.ndarray
    place: np.ndarray


def build_index(templates: dict[str, str]) -> Index:
    """Inverted index of the templates' winnowed grams."""
    names = sorted(templates)
    w = Words([templates[n] for n in names])
    grams, start, first = _grams(w)
    kept = winnow(grams, first)
    template = np.searchsorted(first, kept, "right") - 1
    order = np.argsort(grams[kept], kind="stable")
    return Index(names, [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:])],
                 np.bincount(template, minlength=len(names)), grams[kept][order], template[order],
                 (start[kept] - w.first[template])[order])


def candidates(words: Words, index: Index) -> np.ndarray:
    """Rows (text, template, word where the template would begin) with enough hits on near diagonals."""
    grams, start, first = _grams(words)
    kept = winnow(grams, first)
    low, high = np.searchsorted(index.grams, grams[kept]), np.searchsorted(index.grams, grams[kept], "right")
    hitting = np.flatnonzero(high > low)
    kept, low, n = kept[hitting], low[hitting], (high - low)[hitting]
    if not len(kept):
        return np.zeros((0, 3), np.int64)
    hit = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    text = np.repeat(np.searchsorted(first, kept, "right") - 1, n)
    template, diagonal = index.template[hit], np.repeat(start[kept], n) - index.place[hit]
    order = np.lexsort((diagonal, template, text))
    text, template, diagonal = text[order], template[order], diagonal[order]
    # hits from each one on, as far as the band reaches
    span = np.array([max(1, int(BAND * len(x))) for x in index.words])[template]
    group = text * len(index.names) + template
    wide = np.int64(1) << np.int64(33)
    key = group * wide + diagonal + wide // 2
    until = np.searchsorted(key, key + span, "right")
    enough = until - np.arange(len(key)) >= np.maximum(1, np.ceil(CANDIDATE_SHARE * index.prints[template]))
    return np.unique(np.stack((text[enough], template[enough], diagonal[enough]), 1), axis=0)


def align(template: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest common subsequence of the template and each row: length, first and last matched place.

    ``rows`` are the band around a candidate, padded with 0, which no word has.
    """
    n, width = rows.shape
    best = np.zeros((n, width + 1), np.int64)
    # where the first match of the best path stands; a path without matches starts nowhere
    begin = np.full((n, width + 1), width, np.int64)
    for word in template:
        same = rows == word
        new, new_begin = best.copy(), begin.copy()
        for j in range(1, width + 1):
            diagonal = best[:, j - 1] + 1
            take = same[:, j - 1] & (diagonal > new[:, j])
            started = np.where(best[:, j - 1] > 0, begin[:, j - 1], j - 1)
            new[:, j] = np.where(take, diagonal, new[:, j])
            new_begin[:, j] = np.where(take, started, new_begin[:, j])
            left = new[:, j - 1] > new[:, j]
            new[:, j] = np.where(left, new[:, j - 1], new[:, j])
            new_begin[:, j] = np.where(left, new_begin[:, j - 1], new_begin[:, j])
        best, begin = new, new_begin
    end = (best == best[:, -1:]).argmax(axis=1)
    return best[:, -1], begin[:, -1], end


def matches(words: Words, index: Index, found: np.ndarray, coverage: float, least: float = IDENTITY) -> list[tuple]:
    """(text, template, coverage, identity, first word, word after the last) of the aligned candidates.

    Coverage is the matched share of the template; identity also counts the words
    in between that match nothing.
    """
    out = []
    for t in np.unique(found[:, 1]):
        template = index.words[t]
        size, band = len(template), max(1, int(BAND * len(template)))
        own = found[found[:, 1] == t]
        for part in np.array_split(own, len(own) // 2000 + 1):
            first, last = words.first[part[:, 0]], words.first[part[:, 0] + 1]
            at = np.maximum(part[:, 2] - band, first)[:, None] + np.arange(size + 2 * band)
            rows = np.where(at < last[:, None], words.hash[np.minimum(at, len(words.hash) - 1)], np.uint64(0))
            # equal bands are aligned once
            distinct, back = np.unique(rows, axis=0, return_inverse=True)
            length, begin, end = align(template, distinct)
            back = back.reshape(-1)
            share = length / size
            identity = length / np.maximum(size + (end - begin) - length, 1)
            good = (share >= coverage) & (identity >= least)
            for i in np.flatnonzero(good[back]):
                k = back[i]
                out.append((int(part[i, 0]), int(t), float(share[k]), float(identity[k]), int(at[i, 0] + begin[k]),
                            int(at[i, 0] + end[k]), int(length[k])))
    kept: dict[int, list] = {}
    for row in sorted(set(out), key=lambda r: (r[0], -r[6], -r[3], r[4], r[1])):
        mine = kept.setdefault(row[0], [])
        rivals = [x for x in mine if row[4] < x[5] and row[5] > x[4]]
        # equal templates are equally right
        if all(row[4:] == x[4:] and row[3] == x[3] for x in rivals):
            mine.append(row)
    return sorted(r[:6] for mine in kept.values() for r in mine)


def scan(documents: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id",
         text_col: str = "text", coverage: float = COVERAGE, identity: float = IDENTITY) -> DataFrame:
    """One row per match: document id, license, coverage, identity, start and length (code points).

    Templates are the caller's argument and travel with the tasks; they are a list
    written by people, not a table that grows with the corpus.
    """
    index = build_index(TEMPLATES if templates is None else templates)
    shared = documents.sparkSession.sparkContext.broadcast(index)
    schema = (T.StructType().add("doc_id", documents.schema[id_col].dataType).add("license", "string")
              .add("coverage", "double").add("identity", "double").add("start", "integer").add("length", "integer"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            rows = []
            for at, texts in chunks(batch.column(1).to_pylist()):
                w = Words(texts)
                for t, k, share, same, a, b in matches(w, held, candidates(w, held), coverage, identity):
                    lo = int(w.begin[a] - w.base[t])
                    rows.append((at + t, held.names[k], share, same, lo, int(w.end[b - 1] - w.base[t]) - lo))
            columns = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(list(columns[0]), pa.int64())), pa.array(list(columns[1]), pa.string()),
                 pa.array(list(columns[2]), pa.float64()), pa.array(list(columns[3]), pa.float64()),
                 pa.array(list(columns[4]), pa.int32()), pa.array(list(columns[5]), pa.int32())], names=schema.names)

    return documents.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
