"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates.

Paragraphs are the lines of a text, and runs of lines between blank ones, as notices are often wrapped. Sparse word 1- to 3-grams feed a softmax regression over licence families and an unknown
class. It is trained here on the templates below, varied by a seeded generator, and on unrelated paragraphs: those below and a
bounded sample of the documents' own. Its probabilities are calibrated by a temperature that is fitted on templates and
paragraphs that took no part in training, each in its turn. A prediction counts only when it is
likely enough and the paragraph holds most of the n-grams of a template of that family.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import sliced

UNKNOWN = "unknown"
PROBABILITY, SIMILARITY = 0.5, 0.6

# Usual notices of each family.
TEMPLATES = {
    "agpl": ["This program is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-or-later", "You should have received a copy of the GNU Affero General Public License along with this program.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "apache": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Released under the Apache 2.0 license.", "Apache License, Version 2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership."],
    "bsd": ["Released under the BSD License.", "SPDX-License-Identifier: BSD-3-Clause", "Licensed under the 3-clause BSD license.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "boost": ["Distributed under the Boost Software License, Version 1.0.", "Boost Software License - Version 1.0 - August 17th, 2003", "SPDX-License-Identifier: BSL-1.0"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0", "Licensed under CC BY-NC-SA 4.0."],
    "cc-by-nd": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related rights to this work (CC0).", "Released under CC0 1.0 Universal, public domain dedication.", "SPDX-License-Identifier: CC0-1.0"],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.", "SPDX-License-Identifier: EPL-2.0", "Eclipse Public License - v 2.0"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.", "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-2.0-only", "Licensed under the GPL.", "GNU General Public License", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."],
    "isc": ["Released under the ISC License.", "SPDX-License-Identifier: ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-or-later", "Licensed under the LGPL.", "GNU Lesser General Public License", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "mit": ["Released under the MIT License.", "Licensed under the MIT license.", "The MIT License (MIT)", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0", "Licensed under the Mozilla Public License, version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "proprietary": ["All rights reserved.", "Copyright the company. All rights reserved.", "This document is confidential and proprietary and may not be reproduced without prior written permission.", "No part of this publication may be reproduced without the prior written permission of the copyright holder."],
    "public-domain": ["This work is in the public domain.", "This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
    "zlib": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:", "SPDX-License-Identifier: Zlib", "Released under the zlib License."],
}
#: Unrelated paragraphs, some about licences without granting one.
OTHERS = [
    "You need a driving license to rent a car in most countries.", "The license plate was found near the river.", "The council granted a license to the new bar on Main Street.",
    "She was licensed as a nurse in three states.", "The rights of the workers were discussed at the meeting.", "The software update is available for download today.", "Copyright law differs between countries.",
    "The public library opens at nine in the morning.", "The general public was invited to the opening of the foundation.", "Permission to enter the building is required for visitors.", "A reserved seat costs more than a free one.",
    "The version of the story that he told was not true.", "The source of the river lies in the mountains.", "We use a new form for all orders and returns.", "Students at MIT built a small robot.", "The Apache helicopter landed at the base.",
    "The commons were open to all creative people of the village.", "The domain of the function is the set of real numbers.", "Read the following conditions before you buy a ticket.", "He wrote a program that sorts numbers.",
]
#: At most so many documents give paragraphs of the unknown class, at most so many each, of at most so many words; paragraphs that hold more than KIN of a
#: template's n-grams are left out, as they may be notices.
DOCUMENTS, EACH, WORDS, KIN = 100, 2, 60, 0.25
FOLDS = 3
_TOKEN = re.compile(r"[a-z]+|\d+(?:\.\d+)*")


def grams(paragraph: str) -> Counter:
    w = _TOKEN.findall(paragraph.lower())
    return Counter(" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1))


@dataclass
class Model:
    """terms: n-gram -> row of the weights; templates: family -> n-gram sets."""

    families: list[str]
    terms: dict[str, int]
    weight: np.ndarray
    bias: np.ndarray
    temperature: float
    templates: dict[str, list[frozenset]]

    def __post_init__(self):
        """The bound that SIMILARITY sets: fewer than ``least`` shared word pairs rule a template out.

        A paragraph that shares b pairs with a template shares at most all its words, the b pairs, and for each pair the ``fan`` triples
        that begin with it.
        """
        self.pairs: dict[tuple[str, str], list[int]] = {}
        self.least: list[float] = []
        for t in (t for group in self.templates.values() for t in group):
            parts = [tuple(g.split(" ")) for g in t]
            fan = max(Counter(g[:2] for g in parts if len(g) == 3).values(), default=0)
            for g in parts:
                if len(g) == 2:
                    self.pairs.setdefault(g, []).append(len(self.least))
            self.least.append((SIMILARITY * len(t) - sum(len(g) == 1 for g in parts)) / (1 + fan) - 1e-9)
        self.known = frozenset(self.pairs)
        self.longest = max((sum(" " not in g for g in t) for group in self.templates.values() for t in group), default=0)
        self.always = any(n <= 0 for n in self.least)

    def possible(self, words: list[str]) -> bool:
        """False only if no template can be similar enough."""
        if self.always:
            return True
        held = Counter(i for pair in self.known.intersection(zip(words, words[1:])) for i in self.pairs[pair])
        return any(n >= self.least[i] for i, n in held.items())

    def logits(self, counts: Counter) -> np.ndarray:
        ids = [i for t in counts if (i := self.terms.get(t)) is not None]
        return self.bias + (self.weight[ids].sum(0) / np.sqrt(len(ids)) if ids else 0)

    def classify(self, paragraph: str) -> tuple[str, float, float]:
        """(family or unknown, its calibrated probability, best share of a template's n-grams)."""
        counts = grams(paragraph)
        z = self.logits(counts) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        family = self.families[best]
        like = max((len(t & counts.keys()) / len(t) for t in self.templates.get(family, ())), default=0.0)
        if family != UNKNOWN and p[best] >= PROBABILITY and like >= SIMILARITY:
            return family, float(p[best]), like
        return UNKNOWN, float(p[self.families.index(UNKNOWN)]), like

    def scan(self, text: str | None) -> list[tuple[int, str, float, float]]:
        """(paragraph number, family, probability, similarity) of every confirmed paragraph."""
        out, block = [], []
        for k, line in enumerate([*(text or "").split("\n"), ""]):
            if line.strip():
                block.append((k, line, _TOKEN.findall(line.lower())))
            elif block:
                if self.possible([w for _, _, words in block for w in words]):
                    out += self._block(block)
                block = []
        return out

    def _block(self, block: list[tuple[int, str, list[str]]]) -> list[tuple[int, str, float, float]]:
        """Lines that are notices, and between them the shortest runs of lines that are one; a run begins at its first line's number."""
        own = []
        for k, line, words in block:
            family, p, like = self.classify(line) if self.possible(words) else (UNKNOWN, 0.0, 0.0)
            own.append((k, family, p, like) if family != UNKNOWN else None)
        out, i = [], 0
        while i < len(block):
            if own[i]:
                out.append(own[i])
                i += 1
                continue
            words, inner, j, hit = list(block[i][2]), 0, i + 1, None
            while j < len(block) and not own[j] and not hit and inner <= self.longest:  # more words between its ends than a template has: no wrapped notice
                words += block[j][2]
                if self.possible(words):
                    family, p, like = self.classify(" ".join(line for _, line, _ in block[i : j + 1]))
                    hit = (block[i][0], family, p, like) if family != UNKNOWN else None
                inner += len(block[j][2])
                j += 1
            out += [hit] if hit else []
            i = j if hit else i + 1
        return out


def _soft(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _fit(x: np.ndarray, one: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    w, b = np.zeros((x.shape[1], one.shape[1]), np.float32), np.zeros(one.shape[1], np.float32)
    gw, gb = np.full_like(w, 1e-8), np.full_like(b, 1e-8)
    for _ in range(steps):
        d = (_soft(x @ w + b) - one) / len(x)
        dw, db = x.T @ d + 1e-6 * w, d.sum(0)
        gw += dw**2
        gb += db**2
        w -= 0.5 * dw / np.sqrt(gw)
        b -= 0.5 * db / np.sqrt(gb)
    return w, b


@lru_cache(4)
def train(unrelated: tuple[str, ...] = (), seed: int = 9, copies: int = 8, steps: int = 100) -> Model:
    """Fit on varied templates, OTHERS and ``unrelated`` paragraphs.

    For the temperature, templates and paragraphs are dealt into FOLDS with all their variations: each is predicted by a fit that has
    seen none of them. (A template of a family with one fold only is never predicted from nothing: families have several templates.)
    """
    rng = np.random.default_rng(seed)
    families = [*sorted(TEMPLATES), UNKNOWN]
    sets = [frozenset(grams(t)) for group in TEMPLATES.values() for t in group]
    kin = lambda c: max(len(t & c.keys()) / len(t) for t in sets)
    unrelated = [t for t in unrelated if kin(grams(t)) <= KIN]
    filler = [w for o in [*OTHERS, *unrelated] for w in o.split()]

    def vary(text: str) -> str:
        w = [x for x in text.split() if rng.random() > 0.05] or text.split()
        pad = lambda: list(rng.choice(filler, int(rng.integers(0, 6))))
        return " ".join([*pad(), *w, *pad()])

    data = [(text if k == 0 else vary(text), f, j % FOLDS) for f, group in TEMPLATES.items() for j, text in enumerate(group) for k in range(copies)]
    data += [(text if k == 0 else vary(text), UNKNOWN, j % FOLDS) for j, text in enumerate(OTHERS) for k in range(copies)]
    data += [(text, UNKNOWN, j % FOLDS) for j, text in enumerate(unrelated)]
    data += [(" ".join(rng.choice(filler, int(rng.integers(1, 40)))), UNKNOWN, k % FOLDS) for k in range(400)]
    counts = [grams(t) for t, _, _ in data]
    df = Counter(t for c in counts for t in c)
    terms = {t: i for i, t in enumerate(sorted(t for t, n in df.items() if n >= 2))}
    x = np.zeros((len(data), len(terms)), np.float32)
    for r, c in enumerate(counts):
        ids = [terms[t] for t in c if t in terms]
        if ids:
            x[r, ids] = 1 / np.sqrt(len(ids))
    y, fold = np.array([families.index(f) for _, f, _ in data]), np.array([k for _, _, k in data])
    one = np.eye(len(families), dtype=np.float32)[y]
    z = np.zeros((len(data), len(families)), np.float32)
    for k in range(FOLDS):
        w, b = _fit(x[fold != k], one[fold != k], steps)
        z[fold == k] = x[fold == k] @ w + b
    loss = lambda t: -np.log(_soft(z / t)[np.arange(len(z)), y] + 1e-12).mean()
    temperature = min(np.geomspace(0.2, 5, 60), key=loss)
    w, b = _fit(x, one, steps)
    return Model(families, terms, w, b, float(temperature), {f: [frozenset(grams(t)) for t in group] for f, group in TEMPLATES.items()})


def unrelated_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, ...]:
    """Paragraphs of a bounded sample of documents, drawn by a hash of id and paragraph; the same at any partitioning."""
    import pyarrow as pa

    ids = docs.select(F.col(id_col).cast("string").alias("_id")).filter("_id is not null").distinct()
    ids = ids.orderBy(F.xxhash64(F.lit(3), "_id"), "_id").limit(DOCUMENTS)
    texts = docs.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(ids), "_id")  # bounded: DOCUMENTS

    def run(batches):
        for batch in sliced(batches):
            picked = []
            for t in batch.column(1).to_pylist():
                lines = {line for line in (t or "").split("\n") if 0 < len(line.split()) <= WORDS}
                picked += sorted(lines, key=lambda line: (xxhash.xxh64_intdigest(line.encode()), line))[:EACH]
            yield pa.RecordBatch.from_arrays([pa.array(picked, pa.string())], names=["line"])

    return tuple(sorted({r.line for r in texts.mapInArrow(run, "line string").distinct().orderBy(F.xxhash64("line"), "line").limit(DOCUMENTS * EACH).collect()}))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_paragraphs, families (sorted, distinct), licence and notices.

    Unknown paragraphs for training come from a sample of ``docs`` (at most DOCUMENTS ids). notices lists paragraph number (from 0), family, probability and similarity. licence is the family most often found, the
    first in order on ties; 'unknown' without any. A notice over several lines has the number of its first line. A null or empty text has no paragraphs. Repeated rows give
    repeated rows, an empty table an empty result. Whole texts are read. Only the named columns are read.
    """
    import pyarrow as pa

    model = train(unrelated_paragraphs(docs, id_col, text_col))

    def run(batches):
        notice = pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64())])
        for batch in sliced(batches):
            texts = batch.column(1).to_pylist()
            found = [model.scan(t) for t in texts]
            main = [min(Counter(f for _, f, _, _ in x).items(), key=lambda i: (-i[1], i[0]))[0] if x else UNKNOWN for x in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([sum(1 for line in (t or "").split("\n") if line.strip()) for t in texts], pa.int64()),
                    pa.array([sorted({f for _, f, _, _ in x}) for x in found], pa.list_(pa.string())),
                    pa.array(main, pa.string()),
                    pa.array([[dict(zip(("paragraph", "family", "probability", "similarity"), n, strict=True)) for n in x] for x in found], pa.list_(notice)),
                ],
                names=["doc_id", "n_paragraphs", "families", "licence", "notices"],
            )

    rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"cast(`{text_col}` AS string) AS text")
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(
        run, f"doc_id {kind}, n_paragraphs long, families array<string>, licence string, notices array<struct<paragraph: int, family: string, probability: double, similarity: double>>"
    )
