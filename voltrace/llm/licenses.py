"""License scans: a paragraph classifier over sparse word n-grams, confirmed against templates.

A paragraph is a line with a word in it. Its features are words and word pairs
that occur in licence texts (the vocabulary; pairs of only common words don't
count). A multinomial logistic regression gives a probability to each licence
family and to ``unknown``; a temperature fitted on held-out examples makes the
probabilities calibrated. Training examples are templates, cut, thinned and
set in other words, and for ``unknown`` paragraphs of the corpus itself (a
bounded sample of documents by a hash of their ids) and random mixtures of
vocabulary words. A family is confirmed if the paragraph holds enough of the
word pairs of one of its templates, and half of the words that only this
family's templates have (so another licence's name in the same sentence confirms
nothing). Families of one kind differ by marks (such as Affero, or NC and SA):
only the one with exactly the marks of the text is possible, and the temperature
is fitted with impossible families ruled out. A notice after a negation confirms
nothing. A paragraph without any feature is ``unknown`` by definition.

Notices are often wrapped. In a block (lines with a word, up to a line without
one, such as a bare comment mark) runs of lines are joined and classified as
well; a family that no line of the block confirms counts once for the block.

Null and empty texts have no paragraphs; repeated rows are scanned each; an
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WORD = re.compile(r"[^\W_]+")
#: Comment marks that are words; all others are no part of a word.
_MARK = re.compile(r"^\s*(?:dnl|rem)\b", re.IGNORECASE)
UNKNOWN = "unknown"
SAMPLE_DOCUMENTS, LEAST_PROBABILITY, LEAST_SHARE = 1000, 0.5, 0.6

#: Notices and key sentences of public licences, by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Licensed under the MIT license.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "LGPL": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
    ),
    "AGPL": (
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Affero General Public License, version 3.",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Use of this source code is governed by a BSD-style license.",
        "Licensed under the BSD 3-Clause License.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one",
        "Licensed under the Mozilla Public License, version 2.0.",
    ),
    "CC-BY": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ),
    "CC-BY-SA": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ),
    "CC-BY-NC": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
    ),
    "CC0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal",
    ),
    "CC-BY-ND": (
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "Licensed under CC BY-ND 4.0.",
    ),
    "CC-BY-NC-SA": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
    ),
    "CC-BY-NC-ND": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
        "Licensed under CC BY-NC-ND 4.0.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Licensed under the ISC License.",
    ),
    "BSL-1.0": (
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software",
    ),
    "ECL-2.0": (
        "Licensed under the Educational Community License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Licensed under the Educational Community License, Version 2.0.",
    ),
    "OpenSSL": (
        "Licensed under the OpenSSL License (the \"License\"). You may not use this file except in compliance with the License.",
        "Licensed under the OpenSSL License.",
    ),
    "Proprietary": (
        "All rights reserved.",
        "Copyright. All rights reserved. No part of this work may be reproduced without written permission of the publisher.",
    ),
}
#: Identifiers that tags name, by family; each gives a template of its own.
TAGS = {
    "MIT": ("MIT",), "Apache-2.0": ("Apache-2.0",), "GPL": ("GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later"), "LGPL": ("LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-or-later"),
    "AGPL": ("AGPL-3.0-only", "AGPL-3.0-or-later"), "BSD": ("BSD-2-Clause", "BSD-3-Clause"), "MPL-2.0": ("MPL-2.0",), "CC-BY": ("CC-BY-4.0",), "CC-BY-SA": ("CC-BY-SA-4.0",), "CC-BY-NC": ("CC-BY-NC-4.0",),
    "CC-BY-ND": ("CC-BY-ND-4.0",), "CC-BY-NC-SA": ("CC-BY-NC-SA-4.0",), "CC-BY-NC-ND": ("CC-BY-NC-ND-4.0",), "CC0": ("CC0-1.0",), "Unlicense": ("Unlicense",), "ISC": ("ISC",), "BSL-1.0": ("BSL-1.0",), "ECL-2.0": ("ECL-2.0",), "OpenSSL": ("OpenSSL",),
}
TEMPLATES = {f: (*texts, *(f"SPDX-License-Identifier: {t}" for t in TAGS.get(f, ()))) for f, texts in TEMPLATES.items()}
#: Words, and pairs of them, that are marks; short ones count after a word of BEFORE_SHORT; and the marks of families, by kind.
MARKS = {"sharealike": "sa", "share alike": "sa", "noncommercial": "nc", "non commercial": "nc", "noderivatives": "nd", "noderivs": "nd", "no derivatives": "nd", "affero": "affero", "agpl": "affero", "lesser": "lesser", "lgpl": "lesser"}
SHORT_MARKS, BEFORE_SHORT = ("sa", "nc", "nd"), ("by", "cc", "nc", "sa", "nd")
KINDS = (
    {"GPL": (), "LGPL": ("lesser",), "AGPL": ("affero",)},
    {"CC-BY": (), "CC-BY-SA": ("sa",), "CC-BY-NC": ("nc",), "CC-BY-ND": ("nd",), "CC-BY-NC-SA": ("nc", "sa"), "CC-BY-NC-ND": ("nc", "nd")},
)
#: Words that negate a notice, unless its template has them, among the NEGATED_WORDS before it and the first ones in it ("t" is what a contraction leaves), and words before a short notice.
NEGATIONS, NEGATED_WORDS, COPYRIGHT = frozenset(("not", "never", "nor", "t", "cannot")), 5, frozenset(("copyright", "copr", "c"))
#: Templates of fewer words confirm only a paragraph that ends with them, after a copyright or a word at most; words of the lines before and after that may hold a name.
SHORT_WORDS, NEAR_WORDS = 4, 3
#: Words too common to be features alone.
COMMON = frozenset("a an and any are as at be by can for from if in is it its not of on one or that the their this to was were will with without you may no".split())


def paragraph_words(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


def _grams(words: list[str]) -> set[str]:
    return set(words) | {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


def _vocabulary() -> tuple[dict[str, int], frozenset[str]]:
    words = sorted({w for texts in TEMPLATES.values() for t in texts for w in paragraph_words(t)} - COMMON)
    cues = frozenset(words)
    pairs = {p for texts in TEMPLATES.values() for t in texts for p in _grams(paragraph_words(t)) if " " in p and not set(p.split()) <= COMMON}
    return {g: k for k, g in enumerate([*words, *sorted(pairs)])}, cues


VOCABULARY, CUES = _vocabulary()
FAMILIES = [*TEMPLATES, UNKNOWN]
_TEMPLATE_GRAMS = {f: [frozenset(g for g in _grams(paragraph_words(t)) if " " in g) for t in texts] for f, texts in TEMPLATES.items()}
_SIZES = {f: [len(paragraph_words(t)) for t in texts] for f, texts in TEMPLATES.items()}
_SHORT = {f: [w for w in map(paragraph_words, texts) if len(w) < SHORT_WORDS] for f, texts in TEMPLATES.items()}
_TEMPLATE_PAIRS = [frozenset(tuple(g.split()) for g in t) for texts in _TEMPLATE_GRAMS.values() for t in texts]
_ALL_PAIRS = frozenset().union(*_TEMPLATE_PAIRS)
#: Words of lines that are joined at most: thrice the longest template.
JOINED_WORDS = 3 * max(len(paragraph_words(t)) for texts in TEMPLATES.values() for t in texts)


def features(words: list[str]) -> list[int]:
    return sorted({VOCABULARY[g] for g in _grams(words) if g in VOCABULARY})


def _tellings() -> dict[str, list[frozenset[str]]]:
    """For each template its words, without numbers, that no other family's templates have."""
    families: dict[str, set[str]] = {}
    for f, texts in TEMPLATES.items():
        for w in {w for t in texts for w in paragraph_words(t)} - COMMON:
            families.setdefault(w, set()).add(f)
    return {f: [frozenset(w for w in paragraph_words(t) if families.get(w) == {f} and not w.isdigit()) for t in texts] for f, texts in TEMPLATES.items()}


_TELLING = _tellings()


def _negated(words: list[str], grams: frozenset[str]) -> bool:
    start = next((i for i, (a, b) in enumerate(pairwise(words)) if f"{a} {b}" in grams), 0)
    own = {w for g in grams for w in g.split()}
    return bool(NEGATIONS.intersection(words[max(0, start - NEGATED_WORDS):start + NEGATED_WORDS]) - own)


def template_share(words: list[str], family: str) -> float:
    """The largest share of a template's word pairs that the paragraph holds, with half of its telling words and not negated. A short template counts only at its end."""
    pairs, held = {f"{a} {b}" for a, b in pairwise(words)}, set(words)
    best = 0.0
    for grams, telling, size in zip(_TEMPLATE_GRAMS[family], _TELLING[family], _SIZES[family], strict=True):
        share = len(grams & pairs) / len(grams) if size >= SHORT_WORDS else 0.0
        if share > best and 2 * len(telling & held) >= len(telling) and not _negated(words, grams):
            best = share
    for t in _SHORT[family]:
        ahead = words[:-len(t)]
        if words[-len(t):] == t and (len(ahead) < 2 or not COPYRIGHT.isdisjoint(ahead) or any(w.isdigit() and len(w) == 4 for w in ahead)):
            return 1.0
    return best


def marks(words: list[str]) -> set[str]:
    out = {MARKS[w] for w in (*words, *map(" ".join, pairwise(words))) if w in MARKS}
    return out | {b for a, b in pairwise(words) if b in SHORT_MARKS and a in BEFORE_SHORT}


def _impossible(held: list[str]) -> list[int]:
    """Families that words rule out: of each kind all but the one with exactly their marks."""
    found = marks(held)
    return [k for k, f in enumerate(FAMILIES) for kind in KINDS if f in kind and found & set().union(*kind.values()) != set(kind[f])]


def _examples(background: list[list[str]], rng: np.random.Generator) -> list[tuple[list[int], int, list[int]]]:
    """(features, family, families ruled out): varied templates, and for unknown the background and mixtures of vocabulary words."""
    out = []
    cues, common = sorted(CUES), sorted(COMMON)
    for label, (family, texts) in enumerate(TEMPLATES.items()):
        for text in texts:
            words = paragraph_words(text)
            for k in range(24):
                keep = [w for w in words if k == 0 or rng.random() > 0.08]
                if k % 4 == 3 and len(keep) > 12:
                    keep = keep[:int(len(keep) * rng.uniform(0.6, 1.0))]
                ahead = [str(rng.choice(common)) for _ in range(k % 3)]
                if template_share(ahead + keep, family) >= LEAST_SHARE:
                    out.append((features(ahead + keep), label, _impossible(ahead + keep)))
    unknown = len(TEMPLATES)
    for _ in range(1500):
        n = int(rng.integers(1, 6))
        words = [str(rng.choice(cues if rng.random() < 0.5 else common)) for _ in range(n * 2)]
        out.append((features(words), unknown, _impossible(words)))
    for words in background:
        if max(template_share(words, f) for f in TEMPLATES) < 0.3:
            out.append((features(words), unknown, _impossible(words)))
    return [row for row in out if row[0] and row[1] not in row[2]]


@dataclass(frozen=True)
class Classifier:
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def probabilities(self, present: list[int]) -> np.ndarray:
        z = (self.weights[present].sum(axis=0) + self.bias) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def classify(self, paragraph: str) -> tuple[str, float, float] | None:
        """(family or unknown, its probability, template share); None without any feature."""
        return self.classify_words(paragraph_words(paragraph))

    def classify_words(self, words: list[str], near: tuple[str, ...] | list[str] = ()) -> tuple[str, float, float] | None:
        """near: words just before and after, which may hold the name of a family too."""
        if CUES.isdisjoint(words):
            return None
        p = self.probabilities(features(words))
        p[_impossible([*words, *near])] = 0
        p /= p.sum()
        k = int(p.argmax())
        if FAMILIES[k] == UNKNOWN or p[k] < LEAST_PROBABILITY:
            return UNKNOWN, float(p[-1]), 0.0
        return FAMILIES[k], float(p[k]), template_share(words, FAMILIES[k])

    def wrapped(self, lines: list[list[str]], known: set[str]) -> list[tuple[int, str, float, float]]:
        """(line, family, probability, share) of families but the known ones that joined lines of a block confirm, each once."""
        held = _ALL_PAIRS.intersection(pairwise(chain.from_iterable(lines)))
        if len(lines) < 2 or not any(len(t & held) >= LEAST_SHARE * len(t) for t in _TEMPLATE_PAIRS):
            return []
        out, i = [], 0
        while i < len(lines):
            best, words = None, list(lines[i])
            for j in range(i, len(lines)):
                if j > i:
                    words = words + lines[j]
                    if len(words) > JOINED_WORDS:
                        break
                c = self.classify_words(words, [*(lines[i - 1][-NEAR_WORDS:] if i else ()), *(lines[j + 1][:NEAR_WORDS] if j + 1 < len(lines) else ())])
                if c is not None and c[0] != UNKNOWN and c[2] >= LEAST_SHARE and (best is None or c[2] > best[1][2]):
                    best = j, c
            if best is not None and best[1][0] not in known:
                known = known | {best[1][0]}
                out.append((i, *best[1]))
            i = i + 1 if best is None else best[0] + 1
        return out


def train(background: list[list[str]], *, rounds: int = 300, rate: float = 0.5, ridge: float = 1e-4, seed: int = 42) -> Classifier:
    """Full-batch gradient steps with momentum on the softmax loss; every fifth example is held out for the temperature."""
    rng = np.random.default_rng(seed)
    data = _examples(background, rng)
    held = np.arange(len(data)) % 5 == 4
    rows = np.repeat(np.arange(len(data)), [len(x) for x, _, _ in data])
    cols = np.concatenate([np.array(x) for x, _, _ in data])
    y, ruled_out = np.zeros((len(data), len(FAMILIES))), np.zeros((len(data), len(FAMILIES)), dtype=bool)
    y[np.arange(len(data)), [label for _, label, _ in data]] = 1
    for k, (_, _, gone) in enumerate(data):
        ruled_out[k, gone] = True
    x = np.zeros((len(data), len(VOCABULARY)))
    x[rows, cols] = 1
    w, b = np.zeros((len(VOCABULARY), len(FAMILIES))), np.zeros(len(FAMILIES))
    share = 1 / np.sqrt(1 + y[~held].sum(axis=0))
    weight = (y[~held] * share).sum(axis=1, keepdims=True)
    weight /= weight.mean()
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(rounds):
        z = x[~held] @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = weight * (p - y[~held]) / (~held).sum()
        vw = 0.9 * vw - rate * (x[~held].T @ g + ridge * w)
        vb = 0.9 * vb - rate * g.sum(axis=0)
        w, b = w + vw, b + vb
    z = np.where(ruled_out[held], -np.inf, x[held] @ w + b)  # as classify sees them

    def loss(t: float) -> float:
        s = z / t - (z / t).max(axis=1, keepdims=True)
        return float(-(np.where(y[held] > 0, s, 0.0).sum(axis=1) - np.log(np.exp(s).sum(axis=1))).sum())

    return Classifier(w, b, min((float(t) for t in np.geomspace(0.25, 4, 25)), key=loss))


def background_sample(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SAMPLE_DOCUMENTS, most: int = 4000) -> list[list[str]]:
    """Words of at most ``most`` paragraphs with a feature, or parts of JOINED_WORDS words of long ones, of ``size`` documents; both chosen by hashes."""
    total = docs.count()
    draw = F.pmod(F.xxhash64(F.lit(5), id_col), F.lit(1 << 30))
    rows = docs.filter(draw < F.lit(int(min(1.0, 1.2 * size / max(1, total)) * (1 << 30)))).select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), draw.alias("draw"), F.col(id_col).alias("id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                for line in text.split("\n"):
                    words = paragraph_words(line)
                    parts = (words[at:at + JOINED_WORDS] for at in range(0, len(words), JOINED_WORDS))
                    out += [" ".join(part) for part in parts if not CUES.isdisjoint(part)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["line"])

    lines = rows.orderBy("draw", "id").limit(size).mapInArrow(run, "line string")
    return [r.line.split() for r in lines.orderBy(F.xxhash64(F.lit(8), "line"), "line").limit(most).collect()]


def scan_paragraphs(docs: DataFrame, model: Classifier, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, print, n_paragraphs, paragraph, family, probability, share): a row for each paragraph with a feature, and one without a paragraph for each document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                index, found = [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    n, mine, block, known = 0, [], [], set()
                    lines = [*text.split("\n"), ""]
                    ahead = paragraph_words(lines[0])
                    for k, line in enumerate(lines):
                        words, ahead = ahead, paragraph_words(lines[k + 1]) if k + 1 < len(lines) else []
                        if not words and block:
                            mine += [(k - len(block) + at, *c) for at, *c in model.wrapped(block, known)]
                            block, known = [], set()
                        if not line or line.isspace():
                            continue
                        n += 1
                        near = [*(block[-1][-NEAR_WORDS:] if block else ()), *ahead[:NEAR_WORDS]]
                        if words:
                            block.append(paragraph_words(_MARK.sub("", line)) if _MARK.match(line) else words)
                        if (c := model.classify_words(words, near)) is not None and (c[0] != UNKNOWN):
                            mine.append((k, *c))
                            known |= {c[0]} if c[2] >= LEAST_SHARE else set()
                    index.append(i)
                    found.append((n, [dict(zip(("paragraph", "family", "probability", "share"), m, strict=True)) for m in mine]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(index, pa.int64())), pa.array([n for n, _ in found], pa.int64()), pa.array([m for _, m in found], kind)], names=["doc_id", "n_paragraphs", "found"])

    kind = pa.list_(pa.struct([("paragraph", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("share", pa.float64())]))
    found_type = T.ArrayType(T.StructType([T.StructField("paragraph", T.LongType()), T.StructField("family", T.StringType()), T.StructField("probability", T.DoubleType()), T.StructField("share", T.DoubleType())]))
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("n_paragraphs", T.LongType()), T.StructField("found", found_type)])
    return rows.mapInArrow(run, schema)


def license_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_paragraphs, n_license, families, family, probability) of every row.

    n_license counts confirmed paragraphs, and notices that only joined lines confirm; families are theirs, sorted and joined by commas; family is the
    confirmed one of highest probability, or unknown.
    """
    model = train(background_sample(docs, id_col=id_col, text_col=text_col))
    found = scan_paragraphs(docs, model, id_col=id_col, text_col=text_col)
    sure = F.filter("found", lambda x: x["share"] >= LEAST_SHARE)
    best = F.array_max(F.transform(sure, lambda x: F.struct(F.round(x["probability"], 4).alias("probability"), x["family"].alias("family"))))
    return found.select(
        "doc_id", "n_paragraphs", F.size(sure).cast("long").alias("n_license"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("families"),
        F.coalesce(best["family"], F.lit(UNKNOWN)).alias("family"), best["probability"].alias("probability"))
