"""Licence families of paragraphs: a trained n-gram classifier, confirmed against templates.

A multinomial logistic regression over hashed word uni- and bigrams tells the families, ordinary
text ("none") and licence statements of no known family ("unknown") apart. It is trained here, on
variations of the templates below and on a bounded sample of the corpus' own paragraphs as ordinary
text. Its probabilities are calibrated by one temperature, fitted on variations held out; a paragraph
whose best family stays under ``CERTAIN`` is unknown. A family is confirmed when the words of the
paragraph and of one of its templates contain each other well enough.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.shingles import texts_of

#: Documents whose paragraphs serve as ordinary text, paragraphs taken from each, variations of a template.
ORDINARY_DOCS, ORDINARY_PARAGRAPHS, VARIATIONS = 400, 5, 24
DIM = 1 << 14
CERTAIN, CONFIRM = 0.6, 0.5
#: Words of a paragraph that the classifier reads at once; longer ones are read in windows.
WINDOW = 120

# How licences of each family are stated.
TEMPLATES: dict[str, list[str]] = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License. See LICENSE for details.", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"],
    "Apache": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0", "This project is distributed under the terms of the Apache 2.0 license."],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.", "SPDX-License-Identifier: GPL-3.0-or-later", "Distributed under the GPL version 2."],
    "LGPL": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-only", "Released under the LGPL.", "you can redistribute this library under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "AGPL": ["Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only", "Released under the AGPL.", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "BSD": ["Released under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "SPDX-License-Identifier: BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "MPL": ["Licensed under the Mozilla Public License, version 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0", "Released under the MPL."],
    "ISC": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "SPDX-License-Identifier: ISC", "Licensed under the ISC license."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Available under CC-BY-3.0.", "Text is available under the Creative Commons Attribution license."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Available under CC-BY-SA-3.0.", "Text is available under the Creative Commons Attribution-ShareAlike license."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Available under CC-BY-NC-3.0.", "Available under the Creative Commons Attribution-NonCommercial license."],
    "public domain": ["Dedicated to the public domain under CC0 1.0.", "This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: CC0-1.0", "This work is in the public domain."],
    "proprietary": ["All rights reserved.", "Copyright (c) 2020 Example Inc. All rights reserved. Unauthorized copying of this file is strictly prohibited.", "This document is proprietary and confidential. No part may be reproduced without prior written permission.", "All rights reserved. Reproduction without permission is prohibited."],
}
UNKNOWN = ["Licensed under the {} Public Terms, version {}.", "Released under the {} License.", "This work is subject to the {} licence agreement.", "See the {} license for terms of use.", "Use is governed by the {} Community License {}.", "Distributed under the {} Source Terms."]
FILLERS = ["Copyright (c) 2019 The Authors.", "See the file for details.", "All contributors agree.", "Version 1.2.3.", "Please read carefully.", "Thanks to everyone who helped."]

FAMILIES = [*TEMPLATES, "unknown", "none"]
_WORD = re.compile(r"[a-z0-9]+")
#: Words of templates that alone say nothing of a licence (with "mit" and "sa", words of other languages); beside them stands a cue.
PLAIN = frozenset("a above all and any appear are as at be by c can either everyone following for found free in including into is it later list mit modify no not of only option or part please provided published purpose see sa terms that the this thus to under v who with without you your".split())
#: Words between two cues of prose that make them two statements, and words read on either side.
GAP, AROUND = 8, 4


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


#: Words that make a paragraph worth classifying. They come from the templates alone: no text of the corpus takes one away.
CUES = frozenset(v for ts in [*TEMPLATES.values(), [t.replace("{}", " ") for t in UNKNOWN]] for t in ts for v in words_of(t) if not v.isdigit()) - PLAIN


def stretches(words: list[str]) -> list[list[str]]:
    """What the classifier reads of a paragraph: all of a short one, of prose the words around its cues; nothing without a cue."""
    if CUES.isdisjoint(words):
        return []
    if len(words) <= 20:
        return [words]
    cue = [i for i, w in enumerate(words) if w in CUES]
    cut = [0, *(k for k in range(1, len(cue)) if cue[k] - cue[k - 1] > GAP), len(cue)]
    return [words[max(0, cue[a] - AROUND) : cue[b - 1] + AROUND + 1] for a, b in zip(cut, cut[1:])]


def slots(words: list[str]) -> np.ndarray:
    """Hashed uni- and bigrams, each once."""
    grams = {*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))}
    return np.unique(np.array([zlib.crc32(g.encode()) % DIM for g in grams], np.int64)) if grams else np.zeros(0, np.int64)


@dataclass(frozen=True)
class LicenseModel:
    weights: np.ndarray  # DIM + 1 rows, the intercept last
    temperature: float

    def probabilities(self, words: list[str]) -> np.ndarray:
        at = slots(words)
        z = (self.weights[at].sum(0) / np.sqrt(max(1, len(at))) + self.weights[-1]) / self.temperature
        p = np.exp(z - z.max())
        return p / p.sum()


def variations(text: str, n: int, rng: random.Random) -> list[str]:
    """The text as it may be met: parts around it, a word changed or lost, other case."""
    out = [text]
    while len(out) < n:
        words = text.split()
        if len(words) > 6 and rng.random() < 0.5:
            words[rng.randrange(len(words))] = rng.choice(["the", "said", "project", ""])
        if len(words) > 20 and rng.random() < 0.5:
            k = rng.randrange(len(words) // 3)
            words = words[k : k + max(12, rng.randrange(len(words) // 2, len(words)))]
        t = " ".join(w for w in words if w)
        if rng.random() < 0.3:
            t = f"{rng.choice(FILLERS)} {t}"
        if rng.random() < 0.3:
            t = f"{t} {rng.choice(FILLERS)}"
        out.append(t.upper() if rng.random() < 0.1 else t)
    return out


def train(ordinary: list[str], seed: int = 11) -> LicenseModel:
    """Fit weights on four fifths of the examples and the temperature on the rest."""
    rng = random.Random(seed)
    texts, labels = [], []
    for k, family in enumerate(FAMILIES[:-2]):
        for t in TEMPLATES[family]:
            got = variations(t, VARIATIONS, rng)
            texts += got
            labels += [k] * len(got)
    for _ in range(VARIATIONS * 12):
        name = "".join(rng.choice("aeioubcdfglmnrst") for _ in range(rng.randrange(4, 9))).title()
        texts.append(rng.choice(UNKNOWN).format(name, rng.randrange(1, 9)))
        labels.append(len(FAMILIES) - 2)
    # ordinary prose also as it is read around a cue
    ordinary = [*FILLERS, *ordinary, *(" ".join(p) for t in ordinary for w in [words_of(t)] if len(w) > 20 for p in stretches(w))]
    texts += ordinary
    labels += [len(FAMILIES) - 1] * len(ordinary)
    order = list(range(len(texts)))
    rng.shuffle(order)
    x = [slots(words_of(texts[i])[:WINDOW]) for i in order]
    y = np.array([labels[i] for i in order])
    cut = len(x) * 4 // 5
    scale = np.array([1 / np.sqrt(max(1, len(r))) for r in x])
    flat, of = np.concatenate([*x, np.zeros(0, np.int64)]), np.repeat(np.arange(len(x)), [len(r) for r in x])
    w = np.zeros((DIM + 1, len(FAMILIES)))
    total = np.full_like(w, 1e-8)

    def logits(rows: slice) -> np.ndarray:
        pick = (of >= rows.start) & (of < rows.stop)
        z = np.zeros((rows.stop - rows.start, len(FAMILIES)))
        np.add.at(z, of[pick] - rows.start, w[flat[pick]] * scale[of[pick], None])
        return z + w[-1]

    head = of < cut
    for _ in range(150):  # AdaGrad on the whole training part, with a little shrinkage
        z = logits(slice(0, cut))
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(cut), y[:cut]] -= 1
        grad = np.zeros_like(w)
        np.add.at(grad, flat[head], p[of[head]] * scale[of[head], None])
        grad[-1] = p.sum(0)
        grad = grad / cut + 1e-6 * w
        total += grad * grad
        w -= 0.5 * grad / np.sqrt(total)
    z = logits(slice(cut, len(x)))

    def loss(t: float) -> float:
        q = z / t
        q = q - q.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(q).sum(1)) - q[np.arange(len(q)), y[cut:]]))

    temperature = min(np.geomspace(0.05, 20, 60), key=loss)
    return LicenseModel(w, float(temperature))


def _containment(a: set[str], b: set[str]) -> float:
    return len(a & b) / min(len(a), len(b)) if a and b else 0.0


_GRAMS = {f: [({" ".join(p) for p in zip(w, w[1:])}, set(w)) for t in ts for w in [words_of(t)]] for f, ts in TEMPLATES.items()}


def confirmed(family: str, words: list[str]) -> bool:
    """Some template of the family shares enough of its words and of its word pairs."""
    pairs, single = {" ".join(p) for p in zip(words, words[1:])}, set(words)
    return any(_containment(single, w) >= CONFIRM and _containment(pairs, g) >= CONFIRM for g, w in _GRAMS.get(family, ()))


def scan(text: str, model: LicenseModel) -> list[tuple[int, str, float, bool]]:
    """Licence paragraphs of a text: (paragraph, family, probability, confirmed).

    Paragraphs are lines. One without any cue of the templates (``CUES``) is ordinary text.
    """
    out = []
    for k, line in enumerate(text.split("\n")):
        best: dict[str, tuple[float, bool]] = {}
        for part in [p[at : at + WINDOW] for p in stretches(words_of(line)) for at in range(0, max(1, len(p) - WINDOW // 2), WINDOW // 2)]:
            p = model.probabilities(part)
            top = int(p.argmax())
            if FAMILIES[top] == "none":  # the words around may outweigh a short statement, which must then be confirmed
                cue = [i for i, w in enumerate(part) if w in CUES]
                part = part[max(0, cue[0] - 1) : cue[-1] + 2] if cue else []
                p = model.probabilities(part)
                top = int(p.argmax())
                if p[top] < CERTAIN or len(part) < 3 or not confirmed(FAMILIES[top], part):
                    continue
            family = FAMILIES[top] if p[top] >= CERTAIN else "unknown"
            got = (float(p[top]), family != "unknown" and confirmed(family, part))
            best[family] = max(best.get(family, (0.0, False)), got, key=lambda g: (g[1], g[0]))
        out += [(k, f, p, c) for f, (p, c) in sorted(best.items())]
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LicenseModel:
    """Train on the templates and on paragraphs of at most ORDINARY_DOCS documents, those of least id hash."""
    line = F.explode(F.slice(F.split(F.col("text"), "\n"), 1, ORDINARY_PARAGRAPHS)).alias("line")
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    # ids first: only the sample's texts are then read
    ids = picked.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(ORDINARY_DOCS)
    rows = picked.join(F.broadcast(ids.distinct()), "doc_id").select(line).select(F.substring("line", 1, 2000).alias("line")).limit(ORDINARY_DOCS * ORDINARY_PARAGRAPHS)
    stated = re.compile(r"licen[cs]|copyright|rights reserved|public domain|creative commons|\bcc[ -]by", re.I)
    return train(sorted(r["line"] for r in rows.collect() if r["line"].strip() and not stated.search(r["line"])))


def scan_documents(docs: DataFrame, model: LicenseModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, license, probability, confirmed, n_paragraphs, hits``.

    ``license`` is the family of the best hit (confirmed ones first, then by probability), or null
    where no paragraph states a licence; ``hits`` lists all of them. Null and empty texts have none.
    Rows pass one by one, repeated and null ids included; other columns are ignored.
    """
    model = model or fit(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIM x families numbers, whatever the corpus
    hit = pa.struct([("paragraph", pa.int32()), ("license", pa.string()), ("probability", pa.float64()), ("confirmed", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            for at, texts in texts_of(b, 1):
                got = [scan(t or "", model) for t in texts]
                best = [max(g, key=lambda h: (h[3], h[1] != "unknown", h[2])) if g else None for g in got]
                cols = [pa.array([x and x[1] for x in best], pa.string()), pa.array([x and x[2] for x in best], pa.float64()), pa.array([bool(x and x[3]) for x in best]), pa.array([len({h[0] for h in g}) for g in got], pa.int32())]
                hits = pa.array([[dict(zip(("paragraph", "license", "probability", "confirmed"), h, strict=True)) for h in g] for g in got], pa.list_(hit))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(texts)), *cols, hits], names=["doc_id", "license", "probability", "confirmed", "n_paragraphs", "hits"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, license string, probability double, confirmed boolean, n_paragraphs int, hits array<struct<paragraph:int,license:string,probability:double,confirmed:boolean>>")
