"""Licence notices by a trained paragraph classifier.

A paragraph is a run of lines with words. A multinomial logistic regression over word n-grams (one to three words, as a sparse
set, of templates and corpus alike, the `features` most frequent) tells licence families and an unknown class apart; its scores
are calibrated by a temperature fitted on examples that training did not see. A predicted family is confirmed by comparison with
the family's templates: it counts where the words and word pairs of some template, without version numbers and clause counts,
occur to a share of `confirm` at least. That bar is low, so that altered wording passes; which family it is, and whether it is
one, the classifier decides.

Lines are scored first. What no line gives is sought in windows of words over the other lines of a paragraph, and over the words
of long lines, each window little longer than its template: notices that are wrapped or lie within other text. Of overlapping
windows the one that resembles its template most counts. A notice is reported at the line where it starts.

Training is on the driver: examples of the families are made from the templates by dropping, adding and replacing words
but those that only one family has; unknown ones are made from phrases that only sound alike, and from at most `sample_lines` lines of the corpus, those with the
smallest hashes and 5,000 characters at most, that resemble no template. Scanning reads every text whole. A line or window that has none of a template's
rarest words, so many that none without them can share `confirm` of its words, can't be confirmed and needs no score.

Cases: null and empty texts have no notices; repeated rows give repeated results; a null doc_id is reported as null; an empty
table gives an empty result (and a model from the fixed phrases alone); columns beside doc_id and text are ignored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.common import by_batch, prepare, spread

UNKNOWN = "unknown"
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_VERSIONS = {b"v", b"version", b"only", b"later"}
#: Longer lines are scored in windows only.
LONG = 60

#: Notices in common use, by family.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ],
    "Apache": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "Released under the GNU GPL version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    ],
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
    ],
    "BSD": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "ISC": ["Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC0": ["Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "Proprietary": ["All rights reserved.", "Copyright. All rights reserved.", "No part of this publication may be reproduced without prior written permission of the publisher."],
}
#: Phrases that share words with notices and are none.
ALIKE = [
    "He was released under the terms of the agreement.", "A driver must carry a valid license at all times.", "The version of the work was licensed to a general publisher.", "The Apache people lived in the southwest.",
    "She studied at MIT before moving to the public sector.", "The license fee is due every year and is not refunded.", "Public works under the general plan started in version two of the project.", "All seats were reserved for the guests.",
    "The rights of the author were discussed in parliament.", "Creative work is common in this international school.", "The source of the river and the form of the valley", "Permission to enter the building was granted by the owner.",
    "Software is subject to frequent change, version 2.0 or 3.", "This work is about the free use of terms.",
]
FAMILIES = [UNKNOWN, *TEMPLATES]


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split()


def grams_of(words: list[bytes], longest: int = 3) -> set[tuple[bytes, ...]]:
    return {tuple(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)}


def level(words: list[bytes]) -> list[bytes]:
    """words with every number as the same one."""
    return [b"0" if w.isdigit() else w for w in words]


def plain(words: list[bytes]) -> list[bytes]:
    """words without version numbers and clause counts, and without the words that go with them."""
    return [w for i, w in enumerate(words) if not w.isdigit() and w not in _VERSIONS and not (w == b"or" and words[i + 1 : i + 2] == [b"later"])]


def resemblance(template: set[tuple[bytes, ...]], line: set[tuple[bytes, ...]]) -> float:
    """The smaller of the shares of the template's words and word pairs that the line has."""
    out = 1.0
    for n in (1, 2):
        own = {g for g in template if len(g) == n}
        out = min(out, len(own & line) / len(own)) if own else out
    return out


def _varied(words: list[bytes], other: list[bytes], own: set[bytes], rng: np.random.Generator) -> list[bytes]:
    """words with some dropped, replaced and put around them; those in own stay."""
    share = 0.06 if rng.random() < 0.7 else 0.25
    out = [w for w in words if w in own or rng.random() > share]
    out = [w if w in own else other[rng.integers(len(other))] if rng.random() < 0.04 else w for w in out]
    pad = lambda: [other[rng.integers(len(other))] for _ in range(rng.integers(0, 9) if rng.random() < 0.5 else 0)]
    return [*pad(), *out, *pad()]


@dataclass
class Model:
    index: dict[tuple[bytes, ...], int]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    templates: list[tuple[str, int, set[tuple[bytes, ...]]]]
    rare: frozenset[bytes]
    anchors: dict[bytes, list[int]]  # templates by their rare words
    sizes: list[int]  # words of each template
    confirm: float
    threshold: float
    unseen: tuple[np.ndarray, np.ndarray] | None  # calibrated probabilities and classes of the examples that training did not see

    def probabilities(self, grams: set[tuple[bytes, ...]]) -> np.ndarray:
        at = sorted(self.index[g] for g in grams if g in self.index)
        z = (self.weights[at].sum(axis=0) + self.bias) / self.temperature
        p = np.exp(z - z.max())
        return p / p.sum()

    def scan(self, line: str) -> tuple[str, int, float, float] | None:
        """Family, template number, probability and resemblance of a notice; None for any other line."""
        return self._scan(words_of(line))

    def _scan(self, words: list[bytes]) -> tuple[str, int, float, float] | None:
        if self.rare.isdisjoint(words):
            return None
        p = self.probabilities(grams_of(level(words)))
        best = int(p.argmax())
        if best == 0 or p[best] < self.threshold:
            return None
        own = grams_of(plain(words), 2)
        near = max(((resemblance(t, own), -i) for family, i, t in self.templates if family == FAMILIES[best]), default=(0.0, 0))
        return (FAMILIES[best], -near[1], float(p[best]), near[0]) if near[0] >= self.confirm else None

    def notices(self, text: str) -> list[tuple[int, str, int, float, float]]:
        """Line, family, template number, probability and resemblance of every notice of a text."""
        out: list[tuple[int, str, int, float, float]] = []
        block: list[tuple[int, list[bytes]]] = []
        for i, line in enumerate([*text.split("\n"), ""]):
            if words := words_of(line):
                block.append((i, words))
            elif block:
                if not all(self.rare.isdisjoint(w) for _, w in block):
                    out += self._paragraph(block)
                block = []
        return out

    def _paragraph(self, block: list[tuple[int, list[bytes]]]) -> list[tuple[int, str, int, float, float]]:
        out: list[tuple[int, str, int, float, float]] = []
        words: list[bytes] = []
        at: list[int] = []
        for i, own in block:
            if len(own) <= LONG and (found := self._scan(own)) is not None:
                out += [*self._windows(words, at), (i, *found)]
                words, at = [], []
            else:
                words += own
                at += [i] * len(own)
        return out + self._windows(words, at)

    def _windows(self, words: list[bytes], at: list[int]) -> list[tuple[int, str, int, float, float]]:
        """Notices in windows over words; at has the line of each."""
        near: list[tuple[float, int, int, int, int]] = []  # resemblance, size and start (all negative), end, template
        tried: dict[int, int] = {}
        for p, w in enumerate(words):
            for t in self.anchors.get(w, ()):
                grams, size = self.templates[t][2], self.sizes[t]
                width = size + size // 4 + 2
                low = max(tried.get(t, 0), p - width + 1)
                if resemblance(grams, grams_of(plain(words[low : p + width]), 2)) < self.confirm:
                    continue
                tried[t] = p + 1
                for a in range(low, p + 1):
                    if (words[a],) in grams and (r := resemblance(grams, grams_of(plain(words[a : a + width]), 2))) >= self.confirm:
                        b = min(a + width, len(words))
                        while (words[b - 1],) not in grams and not words[b - 1].isdigit():
                            b -= 1
                        near.append((-r, -size, -a, b, t))
        out: list[tuple[int, tuple[int, str, int, float, float]]] = []
        free = bytearray(b"\1") * len(words)
        for r, _, a, b, t in sorted(near):  # the last start of the best ones has no words before the notice
            a = -a
            if all(free[a:b]):
                family, i, _ = self.templates[t]
                p = self.probabilities(grams_of(level(words[a:b])))
                best = int(p.argmax())
                if FAMILIES[best] == family and p[best] >= self.threshold:
                    free[a:b] = bytes(b - a)
                    out.append((a, (at[a], family, i, float(p[best]), -r)))
        return [found for _, found in sorted(out)]


class _Sparse:
    """Rows of feature numbers, for products with dense matrices in both directions."""

    def __init__(self, rows: list[np.ndarray], width: int):
        self.shape = (len(rows), width)
        self.flat = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
        sizes = np.array([len(r) for r in rows], np.int64)
        self.filled = np.flatnonzero(sizes)
        self.starts = (np.cumsum(sizes) - sizes)[self.filled]
        order = np.argsort(self.flat, kind="stable")
        self.by_feature = np.repeat(np.arange(len(rows)), sizes)[order]
        self.used, self.feature_starts = np.unique(self.flat[order], return_index=True)

    def times(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros((self.shape[0], w.shape[1]), np.float32)
        if len(self.flat):
            out[self.filled] = np.add.reduceat(w[self.flat], self.starts)
        return out

    def transposed_times(self, e: np.ndarray) -> np.ndarray:
        out = np.zeros((self.shape[1], e.shape[1]), np.float32)
        if len(self.flat):
            out[self.used] = np.add.reduceat(e[self.by_feature], self.feature_starts)
        return out


def train(corpus_lines: list[str], confirm: float = 0.6, threshold: float = 0.5, copies: int = 60, steps: int = 150, features: int = 20_000, seed: int = 42) -> Model:
    rng = np.random.default_rng(seed)
    templates = [(f, i, grams_of(plain(words_of(t)), 2)) for f, ts in TEMPLATES.items() for i, t in enumerate(ts)]
    sizes = [len(words_of(t)) for ts in TEMPLATES.values() for t in ts]
    strange = [w for w in map(words_of, corpus_lines) if w and max(resemblance(t, grams_of(plain(w), 2)) for _, _, t in templates) < 0.5]
    alike = [words_of(t) for t in ALIKE]
    filler = sorted({w for line in [*strange, *alike] for w in line}) or [b"text"]
    families = Counter(w for ts in TEMPLATES.values() for w in {w for t in ts for w in words_of(t)})
    own_words = {w for w, n in families.items() if n == 1}  # what tells one family from the others
    examples: list[tuple[list[bytes], int]] = [(w, 0) for w in strange]
    for k, family in enumerate(FAMILIES):
        for words in alike if family == UNKNOWN else map(words_of, TEMPLATES[family]):
            examples.append((words, k))
            examples += [(_varied(words, filler, own_words, rng), k) for _ in range(copies)]
    order = rng.permutation(len(examples))
    grams = [grams_of(level(examples[i][0])) for i in order]
    y = np.array([examples[i][1] for i in order])
    cut = len(order) * 4 // 5
    seen = Counter(g for own in grams[:cut] for g in own)
    index = {g: i for i, g in enumerate(sorted(sorted((g for g in seen if seen[g] >= 2), key=lambda g: (-seen[g], g))[:features]))}
    rows = [np.array(sorted(index[g] for g in own if g in index), np.int64) for own in grams]
    x, unseen = _Sparse(rows[:cut], len(index)), _Sparse(rows[cut:], len(index))
    kinds = len(FAMILIES)
    target = np.eye(kinds, dtype=np.float32)[y]
    share = np.sqrt(np.bincount(y[:cut], minlength=kinds).astype(np.float32) + 1)
    weight = (1 / share)[y[:cut], None]
    weight /= weight.mean()
    w, b = np.zeros((len(index), kinds), np.float32), np.zeros(kinds, np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = x.times(w) + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        e = (p - target[:cut]) * weight / cut
        g = x.transposed_times(e) + 1e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        b -= 2.0 * e.sum(axis=0)
    z = unseen.times(w) + b

    def loss(t: float) -> float:
        s = z / t - (z / t).max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), y[cut:]]).mean())

    temperature = min(np.geomspace(0.25, 8, 41), key=loss)
    held = np.exp(z / temperature - (z / temperature).max(axis=1, keepdims=True))
    held /= held.sum(axis=1, keepdims=True)
    common = Counter(word for line in strange for word in set(line))
    anchors: dict[bytes, list[int]] = {}
    for n, (_, _, t) in enumerate(templates):
        own = sorted((g[0] for g in t if len(g) == 1), key=lambda word: (common[word], word))
        for word in own[: int((1 - confirm) * len(own)) + 1]:  # without these a line has less than the confirming share
            anchors.setdefault(word, []).append(n)
    return Model(index, w, b, float(temperature), templates, frozenset(anchors), anchors, sizes, confirm, threshold, (held, y[cut:]))


def sample_lines(documents: DataFrame, lines: int = 3000, documents_read: int = 1000) -> list[str]:
    """At most `lines` lines of about documents_read documents, chosen by hash."""
    total = documents.count()
    share = int(min(1.0, documents_read / max(total, 1)) * (1 << 30))
    some = documents.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share).select(F.explode(F.split("text", "\n")).alias("line")).where(F.length("line").between(1, 5000))
    return [r["line"] for r in some.orderBy(F.xxhash64("line"), "line").limit(lines).collect()]


def scan(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, paragraph (line where it starts, from 0), family, template, probability and resemblance of every notice."""
    spark = documents.sparkSession
    prepare(spark)
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = spark.sparkContext.broadcast(replace(model or train(sample_lines(source)), unseen=None))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        notices = held.value.notices
        out = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            out += [(doc_id, *found) for found in notices(text.as_py() or "")]
        if not out:
            return None
        types = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.float64()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["doc_id", "paragraph", "family", "template", "probability", "resemblance"])

    return spread(source).mapInArrow(by_batch(each), "doc_id long, paragraph int, family string, template int, probability double, resemblance double")
