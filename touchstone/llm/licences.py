"""Licence statements in texts, by a trained classifier of paragraphs.

A paragraph is a line with words. Its features are hashed sequences of one to three words; a multinomial
logistic regression tells the licence families, statements of other licences (`unknown`) and ordinary
text apart. It is trained here: licence paragraphs are made from templates by dropping, adding and
changing words, ordinary ones are a bounded sample of the corpus. On the part of them that training
does not see, a temperature is fitted that makes the probabilities honest, and the least probability
of a family is set that keeps PRECISION of its predictions right. Predictions at or above it stand if a
template of the family confirms them by shared pairs of words. All others are `unknown` if a template of
any licence shares some pairs, and else ordinary text.

Cases: null and empty texts have no paragraphs. Repeated rows count each. Long lines are read whole. No
documents give no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchstone.llm.common import byte_slices, mapped, small_batches
from touchstone.llm.shingles import PLACES, mixed, word_hashes

FEATURES, ORDERS = 1 << 16, 3
#: Bounds of the sample: documents, characters of each, and paragraphs made from each template.
SAMPLE_DOCS, SAMPLE_CHARS, VARIANTS = 300, 8_000, 40
ROUNDS, RATE, PENALTY = 80, 0.5, 1e-5
#: Shares of word pairs that a template of the family, or of any licence, must have in common with a paragraph.
PRECISION, CONFIRMED, RELATED = 0.99, 0.5, 0.3
NONE, UNKNOWN = "none", "unknown"
#: Notices by which well-known licences are stated.
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc": [
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
    ],
    "reserved": ["All rights reserved.", "Copyright the authors. All rights reserved. No part may be reproduced without permission."],
    UNKNOWN: [
        "Licensed under the {} License.",
        "Released under the {} Public License, version {}.",
        "Distributed under the terms of the {} license agreement.",
        "SPDX-License-Identifier: {}",
        "Use of this text is subject to the {} licence terms.",
    ],
}
CLASSES = [*sorted(t for t in TEMPLATES if t != UNKNOWN), UNKNOWN, NONE]
#: Bytes that words are made of stay; letters become lower case and line ends stay apart by their place.
PLAIN = bytes(n + 32 if 65 <= n <= 90 else n if 97 <= n <= 122 or 48 <= n <= 57 or n >= 128 else 32 for n in range(256))
FOUND = "doc_id BIGINT, n_paragraphs BIGINT, licences ARRAY<STRUCT<start: BIGINT, end: BIGINT, family: STRING, probability: DOUBLE>>"


def features(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts: the start and end byte of every paragraph in all texts laid end to end with line ends between;
    and by feature, its paragraph and number."""
    data = b"\n".join(raw)
    start, words = word_hashes(data.translate(PLAIN))
    ends = np.r_[np.flatnonzero(np.frombuffer(data, np.uint8) == 10), len(data)]
    line = np.searchsorted(ends, start)
    used, paragraph = np.unique(line, return_inverse=True)
    owners, found = [], []
    for order in range(1, ORDERS + 1):
        n = len(words) - order + 1
        if n <= 0:
            break
        some = sum((words[i : i + n] * PLACES[i] for i in range(order)), np.full(n, order, np.uint64))
        inside = paragraph[:n] == paragraph[order - 1 :]
        owners.append(paragraph[:n][inside])
        found.append((mixed(some) >> np.uint64(48)).astype(np.int64)[inside])
    owner, feature = np.concatenate(owners or [line]), np.concatenate(found or [line])
    order = np.argsort(owner, kind="stable")
    return np.r_[-1, ends[:-1]][used] + 1, ends[used], owner[order], feature[order]


class Model:
    def __init__(self, weights: np.ndarray, temperature: float = 1.0, least: float = 0.0):
        self.weights, self.temperature, self.least = weights, temperature, least

    def scores(self, n: int, owner: np.ndarray, feature: np.ndarray) -> np.ndarray:
        """Class scores of n paragraphs: mean weights by the root of the number of features."""
        if not n:
            return np.zeros((0, len(CLASSES)))
        starts = np.searchsorted(owner, np.arange(n))
        counts = np.diff(np.r_[starts, len(owner)])
        return np.add.reduceat(self.weights[feature], starts, axis=0) / np.sqrt(counts)[:, None]

    def probabilities(self, n: int, owner: np.ndarray, feature: np.ndarray) -> np.ndarray:
        return softmax(self.scores(n, owner, feature) / self.temperature)


def softmax(scores: np.ndarray) -> np.ndarray:
    shifted = np.exp(scores - scores.max(axis=1, keepdims=True))
    return shifted / shifted.sum(axis=1, keepdims=True)


def variants(ordinary: list[str]) -> tuple[list[str], list[int]]:
    """Changed templates and ordinary paragraphs with their classes, in a fixed random order."""
    rng = random.Random(11)
    vocabulary = sorted({w for p in ordinary for w in p.split()[:50]}) or ["text"]
    made: list[tuple[str, int]] = [(p, CLASSES.index(NONE)) for p in ordinary]
    for family, templates in TEMPLATES.items():
        for template in templates:
            for _ in range(VARIANTS):
                text = template.replace("{}", " ".join(rng.choices(vocabulary, k=rng.randint(1, 2))).title(), 1).replace("{}", str(rng.randint(1, 9)))
                words = [w for w in text.split() if rng.random() > 0.08] or text.split()
                words = [rng.choice(vocabulary) if rng.random() < 0.04 else w for w in words]
                words = rng.choices(vocabulary, k=rng.choice([0, 0, 2, 6])) + words + rng.choices(vocabulary, k=rng.choice([0, 0, 2, 6]))
                made.append((" ".join(words), CLASSES.index(family)))
    rng.shuffle(made)
    return [t for t, _ in made], [c for _, c in made]


def fit(texts: list[str], classes: list[int]) -> Model:
    """Trains on three quarters; fits the temperature and the least probability on the rest."""
    _, _, owner, feature = features([t.encode() for t in texts])
    n, labels = len(texts), np.array(classes)
    seen = np.arange(n) % 4 != 3
    model = Model(np.zeros((FEATURES, len(CLASSES))))
    counts = np.bincount(owner, minlength=n)
    share = np.bincount(labels, minlength=len(CLASSES))
    balance = (seen / share[labels] / np.count_nonzero(share))[:, None]
    wanted = np.eye(len(CLASSES))[labels]
    squares = np.full(FEATURES, 1e-8)
    active = np.unique(feature)
    position = np.searchsorted(active, feature)
    for _ in range(ROUNDS):
        error = (softmax(model.scores(n, owner, feature)) - wanted) * balance
        per_feature = error[owner] / np.sqrt(counts[owner])[:, None]
        slope = np.stack([np.bincount(position, per_feature[:, c], len(active)) for c in range(len(CLASSES))], axis=1)
        slope += PENALTY * model.weights[active]
        squares[active] += (slope**2).sum(axis=1)
        model.weights[active] -= RATE * slope / np.sqrt(squares[active])[:, None]
    held = ~seen
    scores, truth = model.scores(n, owner, feature)[held], labels[held]
    if held.any():
        grid = np.geomspace(0.05, 5, 60)
        loss = [-np.log(softmax(scores / t)[np.arange(len(truth)), truth] + 1e-300).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        found = softmax(scores / model.temperature)
        best = found.argmax(axis=1)
        sure = np.where(best < CLASSES.index(UNKNOWN), found.max(axis=1), -1.0)
        order = np.argsort(-sure)
        order = order[sure[order] >= 0]
        right = np.cumsum(best[order] == truth[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(right >= PRECISION)
        model.least = float(sure[order[good[-1]]]) if len(good) else 1.0
    return model


def pairs(text: str) -> set[tuple[str, str]]:
    words = text.encode().translate(PLAIN).split()
    return set(zip(words, words[1:], strict=False)) or {(w, b"") for w in words}


TEMPLATE_PAIRS = {family: [pairs(t) for t in templates] for family, templates in TEMPLATES.items()}


def confirmed(family: str, text: str) -> bool:
    found = pairs(text)
    return any(len(found & t) >= CONFIRMED * min(len(found), len(t)) for t in TEMPLATE_PAIRS[family])


def related(text: str) -> bool:
    found = pairs(text)
    return any(len(found & t) >= RELATED * min(len(found), len(t)) for ts in TEMPLATE_PAIRS.values() for t in ts)


def verdict(family: str, chance: float, least: float, text: str) -> str:
    """The family that is reported for a paragraph that isn't predicted to be ordinary."""
    if family != UNKNOWN and chance >= least and confirmed(family, text):
        return family
    return UNKNOWN if related(text) else NONE


def train(docs: DataFrame) -> Model:
    """Trains on a bounded sample: the leading lines of the documents with the smallest hashes."""
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    chosen = docs.filter("text IS NOT NULL").orderBy(order, "doc_id", "text").limit(SAMPLE_DOCS)
    sample = [r["text"] for r in chosen.select(F.substring("text", 1, SAMPLE_CHARS).alias("text")).collect()]
    lines = sorted({line for text in sample for line in text.split("\n") if line.encode().translate(PLAIN).split()})
    return fit(*variants([line for line in lines if not related(line)]))


def classify(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_paragraphs, and licences (start and end byte, family, probability) in order."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train(docs))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch, raw in byte_slices(batches):
            start, end, owner, feature = features(raw)
            chances = model.value.probabilities(len(start), owner, feature)
            begins = np.cumsum([0] + [len(r) + 1 for r in raw])
            document = np.searchsorted(begins, start, side="right") - 1
            licences: list[list] = [[] for _ in raw]
            for n in np.flatnonzero(chances.argmax(axis=1) != CLASSES.index(NONE)) if len(start) else ():
                i = int(document[n])
                a, b = int(start[n] - begins[i]), int(end[n] - begins[i])
                best = int(chances[n].argmax())
                family = verdict(CLASSES[best], chances[n, best], model.value.least, raw[i][a:b].decode())
                if family == NONE:
                    continue
                licences[i].append({"start": a, "end": b, "family": family, "probability": float(chances[n, best])})
            counts = np.bincount(document, minlength=len(raw))
            ids = batch["doc_id"].reset_index(drop=True)
            yield pd.DataFrame({"doc_id": ids, "n_paragraphs": counts, "licences": pd.Series(licences, dtype=object)})

    return mapped(docs.select("doc_id", "text"), run, FOUND)


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_paragraphs, n_licences, n_unknown, families (sorted, comma-joined), spans (family:start:end)."""
    known = F.filter("licences", lambda x: x["family"] != UNKNOWN)
    return classify(docs).select(
        "doc_id", "n_paragraphs", F.size(known).cast("bigint").alias("n_licences"),
        (F.size("licences") - F.size(known)).cast("bigint").alias("n_unknown"),
        F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(known, lambda x: x["family"])))).alias("families"),
        F.concat_ws(",", F.transform("licences", lambda x: F.concat_ws(":", x["family"], x["start"], x["end"]))).alias("spans"),
    )
