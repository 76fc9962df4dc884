"""License scans: an exact containment join of text blocks with license templates.

Words are runs of letters, digits and bytes from 0x80 of the text with A-Z lower-cased. The blocks of a
template of n words are all windows of 1.25 n words of the text, wherever its lines break (a shorter text
is one block). A block meets a template T if it holds at least ``CONTAINMENT`` of T's distinct words; at 0.9
a notice of fewer than ten words has to be whole, as one word often is the name of the license.

The join is exact and filtered three ways. All words of the templates are ordered by the number of
documents that hold them, rarest first; a block with enough common words holds one of T's first
|T| - need + 1 words (prefix filter, applied to the whole document first); it has at least ``need``
words (length filter); and a place of a prefix word is only looked around if it can be a block's rarest
common word: the words of T that come later in the order, and those of them that stand within a block's
reach of the place, both have to make up ``need`` (positional filter). Around the places that are left,
the window slides over the template's words alone, so the work is linear in the text.

Templates are a table (label, text). It is bounded: beyond ``MOST_TEMPLATES`` rows or ``MOST_WORDS`` words in
all an error is raised, else its inverted index goes to every task. Texts are never shuffled; only one count
per template word is gathered.

Besides, exact phrases give base labels wherever their words stand in a row.

Defined results: null text counts as empty: no words, no labels, score 0; null ids are kept; repeated
rows stay repeated; templates without words are ignored; extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from silvaspan.sources.tables import table

CONTAINMENT = 0.9
STRETCH = 1.25
MOST_TEMPLATES, MOST_WORDS = 1 << 12, 1 << 20
#: Phrases and labels of the contract.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Notices by which works are commonly licensed.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide."),
    ("reserved", "Copyright. All rights reserved."),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("gpl-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("unlicense", """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
)
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD).split()


class Index:
    """Templates with their words in the global order, and the words by which a block can be a candidate."""

    def __init__(self, counts: dict[bytes, int], templates, containment: float = CONTAINMENT) -> None:
        vocab = {w for _, t in templates for w in words_of(t.encode())}
        rank = {w: k for k, w in enumerate(sorted(vocab, key=lambda w: (counts.get(w, 0), w)))}
        self.templates, self.prefix = [], {}
        for label, text in templates:
            words = words_of(text.encode())
            if not words:
                continue
            order = sorted(set(words), key=rank.__getitem__)
            need = -int(-(containment * len(order) - 1e-9) // 1)
            for w in order[: len(order) - need + 1]:
                self.prefix.setdefault(w, []).append(len(self.templates))
            self.templates.append((label, {w: i for i, w in enumerate(order)}, need, int(STRETCH * len(words) + 1e-9)))

    def regions(self, at: np.ndarray, word: np.ndarray, k: int) -> list[tuple[int, int]]:
        """Parts [lo, hi) of the places ``at`` of template k's words, around the places that can be a block's rarest common word."""
        _, order, need, most = self.templates[k]
        spans = []
        for i in range(len(order) - need + 1):
            own, later = at[word == i], at[word > i]
            reach = np.searchsorted(later, own + most) - np.searchsorted(later, own - most, side="right")
            own = own[1 + np.minimum(reach, len(order) - i - 1) >= need]
            spans += zip(np.searchsorted(at, own - most, side="right").tolist(), np.searchsorted(at, own + most).tolist())
        merged: list[tuple[int, int]] = []
        for lo, hi in sorted(spans):
            if merged and lo <= merged[-1][1]:
                merged[-1] = merged[-1][0], max(hi, merged[-1][1])
            else:
                merged.append((lo, hi))
        return merged

    def matches(self, words: list[bytes]) -> list[tuple[str, float, int, int]]:
        """(label, containment, first word, words): of every run of overlapping blocks that meet a template, the part of the best one from its first common word to its last."""
        seen = set(words)
        wanted = sorted({k for w in self.prefix.keys() & seen for k in self.prefix[w]})
        out = []
        for k in wanted:
            label, order, need, most = self.templates[k]
            if len(order.keys() & seen) < need:
                continue
            places = [(p, order[w]) for p, w in enumerate(words) if w in order]
            at, word = np.array([p for p, _ in places]), np.array([i for _, i in places])
            for lo, hi in self.regions(at, word, k):
                held, distinct, end, best = Counter(), 0, lo, None
                for first in range(lo, hi):
                    while end < hi and places[end][0] < places[first][0] + most:
                        held[places[end][1]] += 1
                        distinct += held[places[end][1]] == 1
                        end += 1
                    if best and places[first][0] >= best[1] + best[2]:
                        out.append((label, best[0], best[1], best[2]))
                        best = None
                    if distinct >= need and (best is None or distinct / len(order) > best[0]):
                        best = distinct / len(order), places[first][0], places[end - 1][0] - places[first][0] + 1
                    held[places[first][1]] -= 1
                    distinct -= held[places[first][1]] == 0
                if best:
                    out.append((label, best[0], best[1], best[2]))
        return out


def bounded(templates: DataFrame) -> list[tuple[str, str]]:
    """The rows (label, text) of a templates table, or an error if it is too large to send to every task."""
    rows = [(r["label"], r["text"] or "") for r in templates.select("label", "text").limit(MOST_TEMPLATES + 1).collect()]
    if len(rows) > MOST_TEMPLATES or sum(len(words_of(t.encode())) for _, t in rows) > MOST_WORDS:
        raise ValueError(f"templates have at most {MOST_TEMPLATES} rows and {MOST_WORDS} words")
    return sorted(rows)


def word_documents(docs: DataFrame, templates: list[tuple[str, str]]) -> dict[bytes, int]:
    """In how many documents each template word stands: one number per word of the fixed templates."""
    vocab = {w for _, t in templates for w in words_of(t.encode())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(vocab.intersection(words_of(text.as_py() or b"")))
        yield pa.RecordBatch.from_arrays([pa.array([w for w in counts], pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    found = docs.select(F.col("text").cast("binary")).mapInArrow(run, "word binary, n long")
    return {bytes(r["word"]): r["n"] for r in found.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def phrase_places(words: list[bytes], phrases=PHRASES) -> list[tuple[int, str]]:
    """(first word, label) of every place where a phrase's words stand in a row."""
    joined = b" " + b" ".join(words) + b" "
    out = []
    for phrase, label in phrases:
        before, word = 0, 0
        at = joined.find(sought := b" " + phrase.encode() + b" ")
        while at >= 0:
            word += joined.count(b" ", before, at)
            out.append((word, label))
            before, at = at, joined.find(sought, at + 1)
    return out


def scan(docs: DataFrame, templates: DataFrame | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """One row for each row of docs (doc_id, text): digests and ``blocks``, the blocks that meet a template of the table (label, text)."""
    known = list(TEMPLATES) if templates is None else bounded(templates)
    index = docs.sparkSession.sparkContext.broadcast(Index(word_documents(docs, known), known, containment))
    rows = docs.select("doc_id", F.col("text").cast("binary"))
    more = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<label: string, containment: double, start: long, words: long>>"
    schema = T.StructType([rows.schema["doc_id"], *T._parse_datatype_string(more).fields])
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("containment", pa.float64()), ("start", pa.int64()), ("words", pa.int64())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1):
                words = words_of(text.as_py() or b"")
                places = phrase_places(words)
                blocks = index.value.matches(words)
                base = {label for _, label in places}
                at = [k for k, _ in places]
                score = 1.0 if places else max((x[1] for x in blocks), default=0.0)
                out.append((len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | {x[0] for x in blocks})), score, [dict(zip(("label", "containment", "start", "words"), x)) for x in blocks]))
            columns = zip(*out) if out else [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=schema.names)

    return rows.mapInArrow(run, schema)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of all documents."""
    return scan(table(spark, sf_dir, "documents")).drop("blocks")
