"""License scanning by a trained paragraph classifier.

A paragraph is a line. Sparse counts of its word n-grams (one to three words) go
through a multinomial logistic regression over license families and a class
`unknown`; its probabilities are calibrated by a temperature fitted on variants
that training has not seen. A prediction stands if its probability reaches a
bound and the paragraph shares enough word pairs with a template of that family.

The model is trained here, on edited variants of the templates against
paragraphs of a bounded sample of documents; what in the sample looks like a
template is left out of the negatives. Since a prediction must share a word pair
with a template, paragraphs without any template word are unknown for certain
and are not featurised. Rows are scanned where they are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = "unknown"
#: Customary wording of license notices.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Distributed under the BSD 3-Clause License.",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "public-domain": (
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0 Universal.",
    ),
    "proprietary": (
        "All rights reserved.",
        "Copyright 2024 Example Inc. All rights reserved.",
        "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
    ),
}
STOP = frozenset("a an and any are as at be by for from in is it its of on or that the this to under with you may not can".split())
WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
#: Rows of the table that training may read paragraphs from, and paragraphs kept of these.
SAMPLE_ROWS, SAMPLE_PARAGRAPHS = 400, 1500
VARIANTS = 30
#: Least probability, and least share of the shorter side's word pairs that a template must have in common.
BOUND, OVERLAP = 0.5, 0.5


def words_of(paragraph: str) -> list[str]:
    return WORD.findall(paragraph.lower())


def ngrams(words: list[str]) -> list[str]:
    return words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)] + [f"{a} {b} {c}" for a, b, c in zip(words, words[1:], words[2:], strict=False)]


def pairs(words: list[str]) -> frozenset[tuple[str, str]]:
    """Neighbouring words, pairs of two function words aside."""
    return frozenset((a, b) for a, b in zip(words, words[1:], strict=False) if a not in STOP or b not in STOP)


TEMPLATE_PAIRS = {family: [pairs(words_of(t)) for t in texts] for family, texts in TEMPLATES.items()}
ANCHORS = sorted({w for own in TEMPLATE_PAIRS.values() for p in own for pair in p for w in pair} - STOP)
_ANCHOR = re.compile(r"(?<![^\W_])(?:" + "|".join(map(re.escape, ANCHORS)) + r")(?![^\W_])", re.I)
#: The same test on whole texts, for the engine.
GATE = r"(?iu)(?<![\p{L}\p{N}])(" + "|".join(re.escape(w) for w in ANCHORS) + r")(?![\p{L}\p{N}])"


def overlap(words: list[str], family: str) -> float:
    """The largest share of a template's or of the paragraph's word pairs, whichever are fewer, that are common to both."""
    own = pairs(words)
    if not own:
        return 0.0
    return max(len(own & t) / min(len(own), len(t)) for t in TEMPLATE_PAIRS[family])


@dataclass
class Model:
    vocabulary: dict[str, int]
    weights: np.ndarray  # (features, classes), the last class unknown
    bias: np.ndarray
    temperature: float
    classes: list[str]

    @cached_property
    def rows(self) -> dict[str, np.ndarray]:
        return {g: self.weights[i] for g, i in self.vocabulary.items()}

    def probabilities(self, words: list[str]) -> np.ndarray:
        grams = ngrams(words)
        found = [self.rows[g] for g in grams if g in self.rows]
        z = self.bias + (np.sum(found, axis=0) / np.sqrt(len(grams)) if found else 0.0)
        z = (z - z.max()) / self.temperature
        e = np.exp(z)
        return e / e.sum()

    def judge(self, paragraph: str) -> tuple[str, float, float]:
        """(family or unknown, calibrated probability, template overlap)."""
        if not _ANCHOR.search(paragraph):
            return UNKNOWN, 1.0, 0.0
        words = words_of(paragraph)
        p = self.probabilities(words)
        best = int(p.argmax())
        if self.classes[best] == UNKNOWN:
            return UNKNOWN, float(p[best]), 0.0
        shared = overlap(words, self.classes[best])
        if p[best] < BOUND or shared < OVERLAP:
            return UNKNOWN, float(p[-1]), shared
        return self.classes[best], float(p[best]), shared


def variants(words: list[str], filler: list[str], rng: np.random.Generator) -> list[str]:
    """The words with some dropped and, around them, some of the filler."""
    kept = [w for w in words if rng.random() > rng.choice([0.0, 0.0, 0.1, 0.2])] or words
    around = lambda: [filler[i] for i in rng.integers(0, len(filler), rng.integers(0, 6))] if filler else []
    return around() + kept + around() if rng.random() < 0.5 else kept


def fit(negatives: list[list[str]], seed: int = 7) -> Model:
    """negatives: words of paragraphs that are no license notices."""
    rng = np.random.default_rng(seed)
    classes = [*TEMPLATES, UNKNOWN]
    filler = [w for own in negatives for w in own][:20000]
    texts, labels = [], []
    for c, family in enumerate(TEMPLATES):
        for template in TEMPLATES[family]:
            own = words_of(template)
            for i in range(VARIANTS):
                texts.append(own if i == 0 else variants(own, filler, rng))
                labels.append(c)
    notice = [w for own in TEMPLATES.values() for t in own for w in words_of(t)]
    for own in [*negatives, *([[filler[i] for i in rng.integers(0, len(filler), 8)] for _ in range(200)] if filler else [])]:
        texts.append(own)
        labels.append(len(classes) - 1)
    for _ in range(300):  # words of notices out of order are no notice
        texts.append([notice[i] for i in rng.integers(0, len(notice), rng.integers(2, 14))])
        labels.append(len(classes) - 1)
    y = np.array(labels)
    train = rng.random(len(y)) < 0.75
    counts = Counter(g for t, own in zip(texts, train, strict=True) if own for g in set(ngrams(t)))
    signal = {g for own in TEMPLATES.values() for t in own for g in ngrams(words_of(t))}
    vocabulary = {g: i for i, g in enumerate(sorted(g for g in signal if counts[g] > 1))}
    x = np.zeros((len(texts), len(vocabulary)), np.float32)
    for i, t in enumerate(texts):
        grams = ngrams(t)
        for g in grams:
            if g in vocabulary:
                x[i, vocabulary[g]] += 1 / np.sqrt(len(grams))
    goal = np.eye(len(classes), dtype=np.float32)[y]
    share = (1 / np.bincount(y[train], minlength=len(classes)).clip(1))[y[train]][:, None].astype(np.float32)
    w, b = np.zeros((x.shape[1], len(classes)), np.float32), np.zeros(len(classes), np.float32)
    pw, pb = w.copy(), b.copy()
    for step in range(200):
        speed = step / (step + 3)
        vw, vb = w + speed * (w - pw), b + speed * (b - pb)
        z = x[train] @ vw + vb
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        d = (p - goal[train]) * share
        pw, pb = w, b
        w, b = vw - 0.7 * (x[train].T @ d + 1e-4 * vw), vb - 0.7 * d.sum(axis=0)
    z = x[~train] @ w + b
    loss = {}
    for t in np.geomspace(0.1, 4, 40):
        s = z / t
        s -= s.max(axis=1, keepdims=True)
        loss[float(t)] = float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), y[~train]]).mean()) if len(s) else t
    return Model(vocabulary, w, b, min(loss, key=loss.get), classes)


def sample_negatives(df: DataFrame, text: str, rows: int = SAMPLE_ROWS, paragraphs: int = SAMPLE_PARAGRAPHS) -> list[list[str]]:
    """Words of at most `paragraphs` distinct paragraphs of about `rows` rows, drawn by the hash of a text;
    a paragraph that has a third of a template's word pairs is left out."""
    own = df.where(F.col(text).isNotNull()).select(F.col(text).alias("__text"), F.xxhash64(text, F.lit(2)).alias("__h"))
    total = own.count()
    rate = min(1.0, 2 * rows / max(1, total))
    lines = own.where(F.pmod("__h", F.lit(1 << 30)) < int(rate * (1 << 30))).select(F.explode(F.split("__text", "\n")).alias("p"))
    picked = lines.where("trim(p) <> ''").select(F.substring("p", 1, 1000).alias("p")).distinct().orderBy(F.xxhash64("p"), "p").limit(paragraphs)
    found = [words_of(r[0]) for r in picked.collect()]
    return [w for w in found if w and all(overlap(w, f) < 1 / 3 for f in TEMPLATES)]


def scan(df: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` of df with n_paragraphs (lines that are not blank) and licenses: an array of
    (paragraph, start, end, family, probability, overlap) of the paragraphs that hold a license notice;
    paragraph counts lines from 0, start and end are code points.

    A null text has no paragraph. Repeated rows are scanned each; an empty table gives an empty result.
    """
    gated = F.coalesce(F.col(text).rlike(GATE), F.lit(False))
    blank = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.trim(x) != "")
    kept = df.select(*(F.col(c) for c in keep), F.size(blank).cast("long").alias("n_paragraphs"), F.when(gated, F.col(text)).cast("string").alias("__text"))
    item = T.StructType([T.StructField("paragraph", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("family", T.StringType()), T.StructField("probability", T.DoubleType()), T.StructField("overlap", T.DoubleType())])
    fields = [*kept.schema.fields[:-1], T.StructField("licenses", T.ArrayType(item))]
    arrow = pa.list_(pa.struct([("paragraph", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("overlap", pa.float64())]))

    def found(whole: str | None) -> list[dict]:
        out, at = [], 0
        for i, line in enumerate(whole.split("\n") if whole else ()):
            family, probability, shared = model.judge(line)
            if family != UNKNOWN:
                out.append({"paragraph": i, "start": at, "end": at + len(line), "family": family, "probability": probability, "overlap": shared})
            at += len(line) + 1
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([found(x) for x in batch.column(batch.num_columns - 1).to_pylist()], arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], names=[f.name for f in fields])

    return kept.mapInArrow(run, T.StructType(fields))
