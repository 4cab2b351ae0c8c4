"""Licence scan: a trained paragraph classifier.

A paragraph is a line with a word in it, or a passage of adjoining lines: hard-wrapped texts spread a sentence over
several lines, which are also called together. Paragraphs are numbered by lines, a passage by its first one. Sparse word 1- and
2-grams feed a multinomial logistic regression over licence families and ``none``. It is fitted on the driver on ``TRAINING``
generated paragraphs: the families' names alone and in ``PHRASES``, sentences and parts of the licences' texts, both varied, and
paragraphs without a licence, mixed with words of many shapes. N-grams outside its vocabulary carry no weight.
A paragraph that looks like a licence is called by its likeliest family if the probability reaches a threshold,
calibrated on phrases that the fit has not seen and on names of unknown licences, and if enough of one of the family's templates
(its names and sentences) stands in it; otherwise it is ``unknown``.

A passage ends at a line without a word (comment markers are no words) and reaches ``REACH`` times the longest template's
words beyond its first line. Those that can hold enough of a template, by counts, are called, the shortest first; a passage
with a family counts unless that family is already called in it, and replaces ``unknown`` calls of its lines. ``unknown``
itself comes from single lines only.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm import _text as T
from weirflow.llm._shared import bounded, picked

# Names of public licences.
NAMES = {
    "agpl": ["GNU Affero General Public License", "GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"],
    "apache": ["Apache License", "Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache Software License"],
    "boost": ["Boost Software License", "Boost Software License - Version 1.0", "BSL-1.0"],
    "bsd": ["BSD License", "BSD 2-Clause License", "BSD 3-Clause License", "BSD-2-Clause", "BSD-3-Clause", "New BSD License", "Simplified BSD License", "modified BSD license"],
    "cc-by": ["Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License", "CC BY 4.0", "CC-BY-4.0", "CC BY 3.0"],
    "cc-by-nc": ["Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0", "CC-BY-NC-4.0", "CC BY-NC 3.0"],
    "cc-by-sa": ["Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0", "CC-BY-SA-4.0", "CC BY-SA 3.0"],
    "cc0": ["CC0 1.0 Universal", "CC0-1.0", "CC0", "Creative Commons Zero"],
    "epl": ["Eclipse Public License", "Eclipse Public License - v 2.0", "EPL-2.0", "Eclipse Public License, version 1.0"],
    "gpl": ["GNU General Public License", "GNU General Public License, version 3", "GNU General Public License version 2", "GNU GPL", "GPLv3", "GPL-3.0-or-later", "GPL-2.0-only", "GPL-3.0"],
    "isc": ["ISC License", "ISC"],
    "lgpl": ["GNU Lesser General Public License", "GNU Lesser General Public License, version 2.1", "GNU Library General Public License", "LGPL", "LGPL-2.1-or-later", "LGPL-3.0"],
    "mit": ["MIT License", "The MIT License (MIT)", "MIT licence", "Expat License"],
    "mpl": ["Mozilla Public License", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "MPL-2.0", "MPL 2.0"],
    "unlicense": ["The Unlicense", "Unlicense"],
    "zlib": ["zlib License", "zlib/libpng License", "Zlib"],
}
# Sentences of these licences and of the notices that they ask for.
TEXTS = {
    "agpl": ["You should have received a copy of the GNU Affero General Public License along with this program.", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "apache": ["you may not use this file except in compliance with the License.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "See the License for the specific language governing permissions and limitations under the License."],
    "boost": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License which accompanies this distribution"],
    "gpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "You should have received a copy of the GNU General Public License along with this program."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "lgpl": ["You should have received a copy of the GNU Lesser General Public License along with this library.", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."],
}
# What names stand in; the second list calibrates.
PHRASES = ["Licensed under the {}.", "This software is licensed under {}", "This work is licensed under the {}.", "Released under the {}", "{}", "License: {}", "SPDX-License-Identifier: {}", "Distributed under the terms of the {}.", "available under the {}", "{} - see the LICENSE file for details", "Copyright (c) 2019 the authors. {}", "licence {}", "This file is part of a project under {}."]
PHRASES_TWO = ["Published under {}.", "You may use this under the terms of the {}", "All code here is {} licensed", "Except where noted, content is under {}.", "Terms: {}"]
# Names of licences that the fit does not know; they calibrate the unknown class.
STRANGE = ["Frobnitz Public Licence, version 7", "Example Corp Source License", "Beerware License", "Open Widget License 1.2", "Vendor License Agreement", "Zope Public License", "Community Data License", "Artistic License 2.0", "Sleepycat License", "Ruby License"]
# Sentences without a licence that share words with licences.
PLAIN = ["The driver needs a license to drive the bus.", "The public library is open until version two of the plan is released.", "You may not use this door.", "The work is subject to change without notice.", "He was free to copy the file.", "She was granted permission to leave.", "The general said the public should be informed.", "Apache helicopters flew over the mit campus.", "The software was released in May and the documentation in June.", "A fishing license costs ten euros.", "The foundation is free and open to any person.", "under the terms of the treaty", "He works at the Mozilla foundation with the Eclipse team.", "the original copy of the notice", "An eclipse of the sun is seen by the public.", "Creative work is common in the zero hour.", "A GNU is an animal of the plains.", "the MIT professor and the ISC group met", "Boost the signal by 3.0 or 4.0 times"]
FAMILIES = sorted(NAMES)
TEMPLATES = {f: NAMES[f] + TEXTS.get(f, []) for f in FAMILIES}
NONE, UNKNOWN = "none", "unknown"
TRAINING, PRECISION, COVER, REACH = 6000, 0.98, 0.7, 2


def _grams(text: str) -> np.ndarray:
    w = T.words(*T.strings(pa.array([text])), T.ALNUM).hashes
    return np.unique(np.concatenate([w, T.windows(w, 2)]))


@dataclass
class Classifier:
    """weights: one row for each n-gram of the vocabulary (sorted hashes); classes: families, then none."""

    classes: list[str]
    vocabulary: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    threshold: float
    templates: list[tuple[str, np.ndarray, np.ndarray]]

    def probabilities(self, grams: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.vocabulary, grams), len(self.vocabulary) - 1)
        z = self.bias + self.weights[at[self.vocabulary[at] == grams]].sum(0)
        e = np.exp(z - z.max())
        return e / e.sum()

    def licences(self, words: np.ndarray, two: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
        """The lines (words from ``at`` to ``to``) that ``call`` would not call none."""
        if not len(at):
            return at
        line = np.repeat(np.arange(len(at)), to - at)
        inner = np.ones(len(words), bool)
        inner[to - 1] = False  # a 2-gram does not reach into the next line
        line, gram = np.concatenate([line, line[inner]]), np.concatenate([words, two[inner]])
        spot = np.minimum(np.searchsorted(self.vocabulary, gram), len(self.vocabulary) - 1)
        own = self.vocabulary[spot] == gram
        some = np.unique(line[own] * len(self.vocabulary) + spot[own])
        lines, first = np.unique(some // len(self.vocabulary), return_index=True)
        if not len(lines):
            return lines
        z = self.bias + np.add.reduceat(self.weights[some % len(self.vocabulary)], first, axis=0)
        e = np.exp(z - z.max(1, keepdims=True))
        # rounding differs from one line's sum; ``call`` decides
        return lines[1 - e[:, -1] / e.sum(1) >= 0.499]

    def cover(self, family: str, grams: np.ndarray) -> float:
        """The largest part of one of the family's templates that the n-grams hold, by the n-grams' weights."""
        return max(float(w[np.isin(t, grams)].sum() / w.sum()) for f, t, w in self.templates if f == family)

    def call(self, grams: np.ndarray) -> tuple[str, float]:
        """The class of a paragraph and its probability; unknown has that of being a licence at all."""
        p = self.probabilities(grams)
        licence = float(1 - p[-1])
        if licence < 0.5:
            return NONE, float(p[-1])
        best = int(p[:-1].argmax())
        sure = p[best] / licence
        if sure >= self.threshold and self.cover(self.classes[best], grams) >= COVER:
            return self.classes[best], float(p[best])
        return UNKNOWN, licence


def _paragraphs(n: int, seed: int, phrases: list[str] = PHRASES) -> list[tuple[str, str]]:
    r = random.Random(seed)

    def filler() -> str:
        return " ".join("".join(r.choice("abcdefghilmnoprstuvxyzéü") for _ in range(r.randint(1, 9))) for _ in range(r.randint(0, 12)))

    def varied(s: str) -> str:
        w = s.split()
        if len(w) > 6 and r.random() < 0.3:
            w.pop(r.randrange(len(w)))
        s = " ".join(w)
        return r.choice([s, s, s.upper(), s.lower(), f"// {s}", f"{filler()} {s}", f"{s} {filler()}"])

    def part(s: str) -> str:
        """Most of a sentence, as a line of it holds."""
        w = s.split()
        size = max(4, int(len(w) * r.uniform(0.75, 1)))
        at = r.randrange(len(w) - size + 1) if len(w) > size else 0
        return " ".join(w[at : at + size])

    words = [w for s in PLAIN + sum(TEXTS.values(), []) + [p.replace("{}", "") for p in PHRASES] for w in s.split()]
    out = []
    for _ in range(n):
        x = r.random()
        family = r.choice(FAMILIES)
        if x < 0.4 or x < 0.5 and family not in TEXTS:
            out.append((varied(r.choice(phrases).format(r.choice(NAMES[family]))), family))
        elif x < 0.5:
            out.append((varied(part(r.choice(TEXTS[family]))), family))
        else:
            some = [r.choice(words) for _ in range(r.randint(0, 4))]
            out.append((r.choice([filler() or "a", f"{filler()} {' '.join(some)}", varied(r.choice(PLAIN)), f"{' '.join(some)} {filler()}"]), NONE))
    return out


def _weighted(templates: list[tuple[str, np.ndarray]]) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """Templates with a weight for each n-gram: what the templates of many families hold tells little."""
    owners: dict[int, set[str]] = {}
    for f, t in templates:
        for g in t.tolist():
            owners.setdefault(g, set()).add(f)
    return [(f, t, np.array([1 / len(owners[g]) for g in t.tolist()])) for f, t in templates]


_fitted: dict[int, Classifier] = {}


def fit(n: int = TRAINING) -> Classifier:
    """Full-batch logistic regression with weight decay."""
    if n in _fitted:
        return _fitted[n]
    rows = _paragraphs(n, 11)
    grams = [_grams(t) for t, _ in rows]
    every, seen = np.unique(np.concatenate(grams), return_counts=True)
    vocabulary = every[seen >= 3]
    classes = [*FAMILIES, NONE]
    at = [np.searchsorted(vocabulary, g[np.isin(g, vocabulary)]) for g in grams]
    x = np.zeros((len(rows), len(vocabulary)), np.float32)
    for i, own in enumerate(at):
        x[i, own] = 1
    y = np.eye(len(classes), dtype=np.float32)[[classes.index(c) for _, c in rows]]
    w, b = np.zeros((len(vocabulary), len(classes)), np.float32), np.zeros(len(classes), np.float32)
    for _ in range(200):
        z = x @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (y - p) / len(rows)
        w += 8 * (x.T @ g - 1e-4 * w)
        b += 8 * g.sum(0)
    m = Classifier(classes, vocabulary, w, b, 0.0, _weighted([(f, _grams(s)) for f in FAMILIES for s in TEMPLATES[f]]))
    # the least threshold at which calls on unseen phrases are right often enough, unfamiliar licences among them
    trials = []
    for t, c in _paragraphs(n // 3, 12, PHRASES_TWO) + [(q.format(s), UNKNOWN) for s in STRANGE for q in PHRASES + PHRASES_TWO]:
        g = _grams(t)
        p = m.probabilities(g)
        best = classes[int(p[:-1].argmax())]
        if c != NONE and p[-1] < 0.5 and m.cover(best, g) >= COVER:
            trials.append((float(p[:-1].max() / (1 - p[-1])), best == c))
    trials.sort(reverse=True)
    right = np.cumsum([ok for _, ok in trials]) / np.arange(1, len(trials) + 1)
    ok = np.flatnonzero(right >= PRECISION)
    m.threshold = trials[ok[-1]][0] if len(ok) else 1.0
    _fitted[n] = m
    return m


class _Passages:
    """Finds the families of passages of two and more lines."""

    def __init__(self, m: Classifier):
        self.m = m
        texts = [s for f in FAMILIES for s in TEMPLATES[f]]
        n_words = [T.words(*T.strings(pa.array([s])), T.ALNUM).hashes for s in texts]
        self.reach = REACH * max(map(len, n_words))
        self.grams = np.unique(np.concatenate([t for _, t, _ in m.templates]))
        self.held = np.zeros((len(self.grams), len(m.templates)))
        for i, (_, t, w) in enumerate(m.templates):
            self.held[np.searchsorted(self.grams, t), i] = w
        # what a passage needs of each template: weight of n-grams, and of these 2-grams when it has all the words
        self.least = COVER * self.held.sum(0) - 1e-6
        self.least_two = self.least - np.array([w[np.isin(t, x)].sum() for (_, t, w), x in zip(m.templates, n_words, strict=True)])

    def _counts(self, hashes: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        """For each range of positions and each template, the weight of its n-grams in it, repeated ones counted again."""
        k = np.minimum(np.searchsorted(self.grams, hashes), len(self.grams) - 1)
        hits = np.flatnonzero(self.grams[k] == hashes)
        sums = np.zeros((len(hits) + 1, self.held.shape[1]))
        np.cumsum(self.held[k[hits]], axis=0, out=sums[1:])
        return sums[np.searchsorted(hits, z)] - sums[np.searchsorted(hits, a)]

    def find(self, words: np.ndarray, two: np.ndarray, at: np.ndarray, to: np.ndarray, joined: np.ndarray, called: dict[int, tuple[str, float]]) -> dict[int, list[tuple[str, float]]]:
        """The calls of single lines, by line, with those of passages; ``joined`` says whether the next line belongs to the same passage."""
        n = len(at)
        ends = np.flatnonzero(~joined)
        last = np.minimum(ends[np.searchsorted(ends, np.arange(n))], np.searchsorted(to, to + self.reach))
        some = np.flatnonzero(last > np.arange(n))
        if not len(some):
            return {i: [c] for i, c in called.items()}
        a, z = at[some], to[last[some]]
        twos = self._counts(two, a, z - 1)
        some = some[((twos >= self.least_two) & (twos + self._counts(words, a, z) >= self.least)).any(1)]

        def grams(i: int, j: int) -> np.ndarray:
            return np.unique(np.concatenate([words[at[i] : to[j]], two[at[i] : to[j] - 1]]))

        lines: dict[str, set[int]] = {}
        for i, (family, _) in called.items():
            lines.setdefault(family, set()).add(i)
        out = dict(called)
        more: dict[int, list[tuple[str, float]]] = {}
        pairs = [(j - i, i, j) for i in some.tolist() for j in range(i + 1, int(last[i]) + 1)]
        for _, i, j in sorted(pairs):
            g = grams(i, j)
            family, p = self.m.call(g)
            if family in (NONE, UNKNOWN) or not lines.get(family, set()).isdisjoint(range(i, j + 1)):
                continue
            # the rest of the sentence belongs to the passage
            cover = self.m.cover(family, g)
            while joined[j] and (c := self.m.cover(family, grams(i, j + 1))) > cover:
                j, cover = j + 1, c
            while i and joined[i - 1] and (c := self.m.cover(family, grams(i - 1, j))) > cover:
                i, cover = i - 1, c
            lines.setdefault(family, set()).update(range(i, j + 1))
            for k in range(i, j + 1):
                if out.get(k, ("", 0))[0] == UNKNOWN:
                    del out[k]
            more.setdefault(i, []).append((family, p))
        return {i: [*([out[i]] if i in out else []), *more.get(i, [])] for i in sorted({*out, *more})}


def _scan(spread):
    @T.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Classifier = spread.value
        passages = _Passages(m)
        for whole in batches:
            for b in T.batches_of(whole, "text", 1 << 20):
                data, offsets = T.strings(b.column("text"))
                w = T.words(data, offsets, T.ALNUM)
                # a word starts a paragraph if a line feed or a border of texts lies before it
                lines = np.concatenate([[0], np.cumsum(data == 10)])
                new = np.ones(len(w.hashes), bool)
                new[1:] = lines[w.starts[1:]] != lines[w.starts[:-1]]
                new[w.offsets[:-1][w.offsets[:-1] < len(new)]] = True
                at = np.flatnonzero(new)
                to = np.append(at[1:], len(new))
                two = np.append(T.windows(w.hashes, 2), np.uint64(0))[: len(new)]
                out: list[list] = [[] for _ in range(b.num_rows)]
                docs = np.searchsorted(w.offsets, at, "right") - 1
                called = {}
                for i in m.licences(w.hashes, two, at, to).tolist():
                    a, z = int(at[i]), int(to[i])
                    family, p = m.call(np.unique(np.concatenate([w.hashes[a:z], two[a : z - 1]])))
                    if family != NONE:
                        called[i] = family, p
                joined = np.zeros(len(at), bool)
                joined[:-1] = (docs[1:] == docs[:-1]) & (np.diff(lines[w.starts[at]]) == 1)
                for i, calls in passages.find(w.hashes, two, at, to, joined, called).items():
                    d = int(docs[i])
                    out[d] += [{"paragraph": int(i - np.searchsorted(docs, d)), "family": family, "p": p} for family, p in calls]
                count = np.bincount(docs, minlength=b.num_rows) if len(docs) else np.zeros(b.num_rows, np.int64)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(count.astype(np.int64)), pa.array(out, _FOUND)], ["doc_id", "n_paragraphs", "found"])

    return run


_FOUND = pa.list_(pa.struct([("paragraph", pa.int64()), ("family", pa.string()), ("p", pa.float64())]))


def licence_paragraphs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_paragraphs and found (paragraph number, family or ``unknown``, probability) for each paragraph called a licence.

    Every line of every whole text is classified, and passages of lines that can hold a template. Null, empty and blank texts have no paragraphs. Rows are worked off where
    they lie, repeated ones each; other columns are ignored; an empty table gives an empty result.
    """
    spread = bounded(docs).sparkContext.broadcast(fit())
    rows = picked(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_scan(spread), "doc_id long, n_paragraphs long, found array<struct<paragraph:long,family:string,p:double>>")


def licence_report(docs: DataFrame, **columns: str) -> DataFrame:
    """Per row: doc_id, n_paragraphs, n_licence, n_unknown, families (sorted, joined with commas, unknown left out) and score (of the surest call; null without one)."""
    f = licence_paragraphs(docs, **columns)
    names = F.array_sort(F.array_distinct(F.filter(F.transform("found", lambda x: x["family"]), lambda x: x != UNKNOWN)))
    return f.select("doc_id", "n_paragraphs", F.size("found").cast("long").alias("n_licence"), F.size(F.filter("found", lambda x: x["family"] == UNKNOWN)).cast("long").alias("n_unknown"), F.concat_ws(",", names).alias("families"), F.array_max(F.transform("found", lambda x: x["p"])).alias("score"))
