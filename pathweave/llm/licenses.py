"""Licence notices: a trained paragraph classifier, confirmed by template comparison.

A paragraph is a line; where a line is classified but not confirmed, it is the lines around it, up to the next blank ones,
so a notice that is wrapped over lines is found whole.  Its features are the words and word pairs it has of a small vocabulary; a softmax regression with a
sparsity penalty tells licence families and an *unknown* class apart.  It is trained on the driver, on worded templates
of each family (whole, shortened, amid other words) against a bounded sample of the corpus's own paragraphs and
scrambled template words.  A temperature fitted on the held-out half calibrates the probabilities, and a family must be
likelier than unknown by them.  A prediction counts as confirmed if the paragraph has enough of one of the family's
templates, by word triples.

Weights and templates become literals of built-in expressions over the paragraphs of each row: all texts are read whole,
without a shuffle and without Python.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Usual wordings of notices, by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "This project is licensed under the terms of the Apache License 2.0.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "BSD": (
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ),
    "AGPL": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, Version 2.0.",
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
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "Released into the public domain under CC0 1.0.",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "All-rights-reserved": (
        "All rights reserved.",
        "Copyright. All rights reserved. No part of this publication may be reproduced without prior written permission of the publisher.",
    ),
}
UNKNOWN = "unknown"
FAMILIES = (*TEMPLATES, UNKNOWN)
SAMPLE_DOCS = 400  # documents whose paragraphs stand for unknown ones in training, at most
SAMPLE_PARAGRAPHS = 4000  # of them at most
REACH = 3  # lines before and after one that may belong to its notice
CONFIRMED = 0.6  # of a template's word triples that a paragraph must have
PUNCTUATION = ".,;:!?()[]{}<>\"'/|*#`_=+~"
_STRIP = str.maketrans(PUNCTUATION, " " * len(PUNCTUATION))


def words(paragraph: str) -> list[str]:
    return [w for w in re.split("[ \t\x0b\f\r]+", paragraph.translate(_STRIP).lower()) if w]


def ngrams(w: list[str], n: int) -> list[str]:
    return [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)]


def _triples(w: list[str]) -> set[str]:
    return set(ngrams(w, 3)) or set(ngrams(w, len(w)))


def template_share(w: list[str], family: str) -> float:
    """Largest share of a template's triples that the words have."""
    if family == UNKNOWN:
        return 0.0
    own = _triples(w)
    return max(len(own & t) / len(t) for t in (_triples(words(x)) for x in TEMPLATES[family]))


@dataclass
class Model:
    features: list[str]
    weights: np.ndarray  # a row per feature, a column per family and unknown
    bias: np.ndarray
    temperature: float = 1.0

    def probabilities(self, w: list[str]) -> np.ndarray:
        have = set(w) | set(ngrams(w, 2))
        z = self.bias + sum((self.weights[i] for i, f in enumerate(self.features) if f in have), np.zeros(len(self.bias)))
        e = np.exp((z - z.max()) / self.temperature)
        return e / e.sum()


def train(unknown: list[str], seed: int = 0) -> Model:
    """Fit on the templates against paragraphs of unknown licence."""
    rng = np.random.default_rng(seed)
    others = [w for w in map(words, unknown) if w and max(template_share(w, f) for f in TEMPLATES) < CONFIRMED]
    texts = [(words(t), FAMILIES.index(f)) for f, ts in TEMPLATES.items() for t in ts]
    filler = [x for w in others for x in w[:20]][:2000] or ["the"]
    pool = [x for w, _ in texts for x in w]
    rows: list[tuple[list[str], int]] = []
    for w, y in texts:
        for _ in range(24):
            keep = [x for x in w if rng.random() > 0.08] if len(w) > 4 else list(w)
            around = [str(x) for x in rng.choice(filler, rng.integers(0, 8))]
            cut = int(rng.integers(0, len(around) + 1))
            rows.append((around[:cut] + (keep or w) + around[cut:], y))
    none = FAMILIES.index(UNKNOWN)
    rows += [(w, none) for w in others]
    rows += [([str(x) for x in rng.choice(pool, rng.integers(1, 9))], none) for _ in range(400)]
    vocabulary = sorted({x for w, _ in texts for x in [*w, *ngrams(w, 2)]})
    number = {x: i for i, x in enumerate(vocabulary)}
    x = np.zeros((len(rows), len(vocabulary)), np.float32)
    for i, (w, _) in enumerate(rows):
        x[i, [number[f] for f in {*w, *ngrams(w, 2)} if f in number]] = 1
    y = np.array([k for _, k in rows])
    fit = rng.random(len(rows)) < 0.5
    weight = np.where(y == none, 1.0, (y == none).sum() / max(1, (y != none).sum()))[:, None]
    a, b = np.zeros((len(vocabulary), len(FAMILIES)), np.float32), np.zeros(len(FAMILIES), np.float32)
    xs, ys, ws = x[fit], np.eye(len(FAMILIES), dtype=np.float32)[y[fit]], (weight[fit] / weight[fit].sum()).astype(np.float32)
    rate, penalty = np.float32(0.05), np.float32(0.0001)
    m, v = np.zeros_like(a), np.zeros_like(a)
    for k in range(1, 401):  # Adam steps, each followed by the shrinkage of the penalty: weights that do not pay are exactly zero
        z = xs @ a + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        d = (p - ys) * ws
        g = xs.T @ d
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        a = a - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-6)
        a = np.sign(a) * np.maximum(np.abs(a) - rate * penalty, 0)
        b = b - d.sum(axis=0)
    a, b = a.astype(float), b.astype(float)
    held = ~fit
    z = x[held] @ a + b
    best, temperature = np.inf, 1.0
    for t in np.geomspace(0.1, 4, 40):
        s = z / t
        loss = np.log(np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)) + s.max(axis=1) - s[np.arange(len(s)), y[held]]
        loss = float((loss * weight[held][:, 0]).sum()) if len(s) else 0.0
        if loss < best:
            best, temperature = loss, float(t)
    used = np.flatnonzero(np.abs(a).max(axis=1) > 0)
    return Model([vocabulary[i] for i in used], a[used].round(6), b.round(6), temperature)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Train with paragraphs of at most SAMPLE_DOCS documents, the first in the order of the ids' MD5, as unknown ones."""
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    chosen = rows.select(F.col(id_col).alias("__id")).orderBy(F.md5(F.col(id_col).cast("string")), id_col).limit(SAMPLE_DOCS)
    lines = rows.join(F.broadcast(chosen), rows[id_col] == F.col("__id")).select(F.explode(F.split(text_col, "\n")).alias("line")).where("length(line) <= 2000")
    found = [r["line"] for r in lines.distinct().orderBy(F.md5("line")).limit(SAMPLE_PARAGRAPHS).collect()]
    return train(found)


def _array(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def _bound(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def classify(line: Column, model: Model) -> Column:
    """family, probability and template_share of a paragraph; null where unknown is likeliest."""
    parts = sorted({w for f in model.features for w in f.split(" ")})
    table = F.create_map(*[x for f, w in zip(model.features, model.weights.tolist(), strict=True) for x in (F.lit(f), F.array(*map(F.lit, w)))])
    bias = F.array(*map(F.lit, model.bias.tolist()))
    families = _array(list(FAMILIES))
    pairs = lambda w: F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))

    def of_scores(scores: Column, w: Column) -> Column:
        best = F.array_max(scores)
        at = F.array_position(scores, best).cast("int")
        total = F.aggregate(scores, F.lit(0.0), lambda a, s: a + F.exp((s - best) / F.lit(model.temperature)))
        family = F.element_at(families, at)
        return F.when(family != UNKNOWN, F.struct(family.alias("family"), (F.lit(1.0) / total).alias("probability"), _share(family, w).alias("template_share")))

    def of_words(w: Column) -> Column:
        grams = F.when(F.size(w) > 1, F.concat(w, pairs(w))).otherwise(w)
        hits = F.array_intersect(grams, _array(model.features))
        scores = F.aggregate(hits, bias, lambda a, h: F.zip_with(a, F.element_at(table, h), lambda x, y: x + y))
        # no word of any feature: the scores are the biases, and unknown has the largest
        return F.when(F.size(F.array_intersect(w, _array(parts))) > 0, _bound(scores, lambda s: of_scores(s, w)))

    cleaned = F.translate(F.lower(line), PUNCTUATION + "\t\x0b\f\r", " " * (len(PUNCTUATION) + 4))
    return _bound(F.filter(F.split(cleaned, " +"), lambda x: x != ""), of_words)


def _share(family: Column, w: Column) -> Column:
    run = lambda k: F.slice(w, k, F.size(w) - 2)
    triples = F.when(F.size(w) > 2, F.zip_with(F.zip_with(run(1), run(2), lambda a, b: F.concat_ws(" ", a, b)), run(3), lambda a, b: F.concat_ws(" ", a, b)))
    own = F.coalesce(triples, F.array(F.concat_ws(" ", w)))
    out = None
    for name, templates in TEMPLATES.items():
        shares = [F.size(F.array_intersect(own, _array(sorted(t)))) / F.lit(float(len(t))) for t in (_triples(words(x)) for x in templates)]
        value = F.greatest(*shares) if len(shares) > 1 else shares[0]
        out = F.when(family == name, value) if out is None else out.when(family == name, value)
    return out.otherwise(0.0)


def around(lines: Column, i: Column) -> Column:
    """Line ``i`` (from 0) with up to REACH lines before and after it, none beyond a blank one, breaks turned to spaces."""
    blank = "[ \t\x0b\f\r]*"
    first = F.greatest(i - REACH, F.lit(0))
    before = F.concat(F.array_join(F.slice(lines, first + 1, i - first), "\n"), F.when(i > 0, F.lit("\n")).otherwise(F.lit("")))
    after = F.concat(F.lit("\n"), F.array_join(F.slice(lines, i + 2, REACH), "\n"))
    before, after = F.regexp_replace(before, f"(?s)^(.*\n)?{blank}\n", ""), F.regexp_replace(after, f"(?s)\n{blank}(\n.*)?$", "")
    return F.translate(F.concat(before, F.element_at(lines, i + 1), after), "\n", " ")


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_paragraphs (lines with a word), found (paragraph number from 0, family, probability, template_share), families
    (of confirmed paragraphs, sorted) and unconfirmed (number of the others found) of each row of ``docs``.

    Null and empty texts have no paragraphs; ids may be null or repeated; other columns are ignored.
    """
    lines = F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\n")
    number = lambda x, i: F.struct(i.alias("paragraph"), classify(x, model).alias("is"))
    alone = F.filter(F.transform(lines, number), lambda x: x["is"].isNotNull())

    def entry(paragraph: Column, c: Column) -> Column:
        return F.struct(paragraph.alias("paragraph"), *(c[f].alias(f) for f in ("family", "probability", "template_share")))

    def confirmed(x: Column) -> Column:
        """As classified alone, or with the lines around if these confirm a family."""
        line = entry(x["paragraph"], x["is"])
        wider = _bound(classify(around(lines, x["paragraph"]), model), lambda c: F.when(c["template_share"] >= CONFIRMED, entry(x["paragraph"], c)).otherwise(line))
        return F.when(x["is"]["template_share"] >= CONFIRMED, line).otherwise(wider)

    found = F.transform(alone, confirmed)
    n = F.size(F.filter(lines, lambda x: F.length(F.trim(F.translate(x, "\t\x0b\f\r", "    "))) > 0)).cast("long")
    rows = docs.select(id_col, n.alias("n_paragraphs"), found.alias("found"))
    good = F.filter("found", lambda x: x["template_share"] >= CONFIRMED)
    return rows.select(
        id_col, "n_paragraphs", "found",
        F.array_sort(F.array_distinct(F.transform(good, lambda x: x["family"]))).alias("families"),
        (F.size("found") - F.size(good)).cast("long").alias("unconfirmed"),
    )
