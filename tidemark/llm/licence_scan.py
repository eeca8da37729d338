"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates.

Features are word 1- to 3-grams, hashed; the model is a multinomial logistic regression over licence families
and an unknown class, trained on variations of the templates and on a bounded sample of the corpus: of ``SAMPLE_DOCS`` documents, those with
the smallest hash of their id, every line is cut into windows of ``WINDOW`` words, and the ``SAMPLE_WINDOWS`` different windows with the
smallest hash are taken, wherever in their texts they stand. Its probabilities are calibrated by a
temperature on variations held back. A paragraph is predicted to be of a family if that beats the unknown class and
``LEAST``; a prediction is confirmed if the paragraph holds ``CONFIRM`` of the 2-grams of a template sentence of it.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import sampled, table, trim

SAMPLE_DOCS, SAMPLE_WINDOWS, WIDTH, WINDOW, LEAST, CONFIRM, EPOCHS = 1500, 4000, 1 << 15, 64, 0.5, 0.7, 12
UNKNOWN = "unknown"
#: Notices by which publicly known licences are named and granted, one sentence each.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "This software is released under the 3-Clause BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "CC-BY-4.0": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "CC-BY-NC-4.0": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "CC-BY-SA-4.0": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "Proprietary": (
        "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
        "Copyright (c) the authors. All rights reserved. Confidential and proprietary.",
    ),
}
FAMILIES = (UNKNOWN, *sorted(TEMPLATES))
_WORD = re.compile(rb"[a-z0-9]+(?:\.[0-9]+)*|[^\x00-\x7F]+")
_known: dict[bytes, int] = {}


def _word_hashes(text: str) -> np.ndarray:
    words = _WORD.findall(text.lower().encode())
    if len(_known) > 400_000:
        _known.clear()
    for w in words:
        if w not in _known:
            _known[w] = zlib.crc32(w) * 0x9E3779B97F4A7C15 & (1 << 64) - 1 | 1
    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


def _forget() -> None:
    """In the worker, where the function is looked up by name."""
    _known.clear()
    trim()


def _grams(h: np.ndarray) -> list[np.ndarray]:
    """Hashes of the 1-, 2- and 3-grams; those of size k start at each of the first len(h) - k + 1 words."""
    out = [h]
    for k in (1, 2):
        out.append(out[-1][: max(0, len(h) - k)] * np.uint64(0xD6E8FEB86659FD93) + h[k:] if len(h) > k else h[:0])
    return out


def _slots(grams: np.ndarray) -> np.ndarray:
    return (grams * np.uint64(0x9FB21C651E98DF25) >> np.uint64(64 - 15)).astype(np.int32)


class Licences:
    def __init__(self, weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.weights, self.bias, self.temperature = weights, bias, temperature

    def probabilities(self, h: np.ndarray) -> np.ndarray:
        """Of each window of WINDOW words, half overlapping; one row at least."""
        if len(h) <= WINDOW:
            slots = np.concatenate([_slots(g) for g in _grams(h)])
            logits = (np.add.reduce(self.weights.take(slots, 0), 0) / np.sqrt(max(1, 3 * len(h))) + self.bias) / self.temperature
            e = np.exp(logits - logits.max())
            return (e / e.sum())[None, :]
        return self.of_windows(h, *_windows(0, len(h)))

    def of_windows(self, h: np.ndarray, starts: list[int], ends: list[int]) -> np.ndarray:
        """Of the words from each start to its end."""
        first, stop = np.array(starts), np.array(ends)
        total = np.zeros((len(first), len(FAMILIES)))
        for k, g in enumerate(_grams(h)):
            if len(g):
                sums = np.concatenate([np.zeros((1, len(FAMILIES))), np.cumsum(self.weights[_slots(g)], 0, dtype=np.float64)])
                last = np.maximum(stop - k, first)
                total += sums[np.minimum(last, len(g))] - sums[np.minimum(first, len(g))]
        logits = (total / np.sqrt(np.maximum(1, 3 * (stop - first)))[:, None] + self.bias) / self.temperature
        e = np.exp(logits - logits.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def _windows(a: int, b: int) -> tuple[list[int], list[int]]:
    """Starts and ends of windows of WINDOW words of a part of a text, half overlapping."""
    starts = list(range(a, max(a + 1, b - WINDOW // 2), WINDOW // 2))
    return starts, [min(x + WINDOW, b) for x in starts]


@lru_cache(1)
def _template_pairs() -> dict[str, list[frozenset]]:
    return {f: [frozenset(_pairs(_word_hashes(t))) for t in ts] for f, ts in TEMPLATES.items()}


def _pairs(h: np.ndarray) -> list[int]:
    return (_grams(h)[1] if len(h) > 1 else h).tolist()


def template_share(h: np.ndarray, family: str) -> float:
    """Most of a template sentence's 2-grams that the paragraph holds."""
    own = set(_pairs(h))
    return max((len(own & t) / max(1, len(t)) for t in _template_pairs().get(family, [])), default=0.0)


def _variations(rng: np.random.Generator, sentence: str, filler: list[list[str]], n: int) -> list[str]:
    """The sentence with words lost, cut short, in capitals, beside its fellows, or between words of other texts."""
    out, words = [sentence, sentence.upper()], sentence.split()
    while len(out) < n:
        w = [x for x in words if rng.random() > 0.08] or words
        if len(w) > 12 and rng.random() < 0.4:
            a = int(rng.integers(0, len(w) - 8))
            w = w[a : a + int(rng.integers(8, 40))]
        if filler and rng.random() < 0.3:
            f = filler[int(rng.integers(len(filler)))]
            w = f[: int(rng.integers(0, 12))] + w + f[12 : 12 + int(rng.integers(0, 12))]
        out.append(" ".join(w))
    return out


def train(paragraphs: list[str], seed=7) -> Licences:
    rng = np.random.default_rng(seed)
    own = [t for ts in TEMPLATES.values() for t in ts]
    plain = [p for p in paragraphs if max(template_share(_word_hashes(p), f) for f in TEMPLATES) < 0.4]
    filler = [p.split() for p in plain[:500] if len(p.split()) > 24]
    rows: list[tuple[str, int]] = [(p, 0) for p in plain] + [("", 0)]
    vocabulary = sorted({w for t in own for w in t.split()})
    rows += [(" ".join(rng.choice(vocabulary, int(rng.integers(3, 25)))), 0) for _ in range(600)]  # the same words in no order
    for y, f in enumerate(FAMILIES[1:], 1):
        rows += [(v, y) for t in TEMPLATES[f] for v in _variations(rng, t, filler, 60)]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    held, rows = rows[: len(rows) // 5], rows[len(rows) // 5 :]
    weights, seen = np.zeros((WIDTH, len(FAMILIES)), np.float32), np.full((WIDTH, 1), 1e-3, np.float32)
    bias = np.zeros(len(FAMILIES))
    coded = []
    for t, y in rows:
        h = _word_hashes(t)[:WINDOW]
        coded.append((np.concatenate([_slots(g) for g in _grams(h)]), 1 / np.sqrt(max(1, 3 * len(h))), y))
    share = np.bincount([y for *_, y in coded], minlength=len(FAMILIES))
    for _ in range(EPOCHS):
        for slots, scale, y in coded:
            z = weights[slots].sum(0) * scale + bias
            p = np.exp(z - z.max())
            g = p / p.sum()
            g[y] -= 1
            g *= len(coded) / (len(FAMILIES) * max(1, share[y])) if y else 1.0
            bias -= 0.01 * g
            np.add.at(seen, slots, np.float32((g * g).mean() * scale * scale))
            np.subtract.at(weights, slots, (0.3 * scale * g / np.sqrt(seen[slots])).astype(np.float32))
    model = Licences(weights, bias, 1.0)
    cases = [(_word_hashes(t)[:WINDOW], y) for t, y in held]

    def loss(temperature: float) -> float:
        model.temperature = temperature
        return -float(np.mean([np.log(model.probabilities(h)[0, y] + 1e-12) for h, y in cases])) if cases else 0.0

    model.temperature = min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)
    return model


def fit(docs: DataFrame, sample_docs=SAMPLE_DOCS, sample_windows=SAMPLE_WINDOWS, id_col="doc_id", text_col="text") -> Licences:
    own = docs.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    picked = sampled(own.select("_id"), F.col("_id"), sample_docs)

    def cut(batches):
        for b in batches:
            out = []
            for text in b.column(0):
                for line in text.as_py().split("\n"):
                    words = line.split()
                    if words:
                        out += [" ".join(words[x:y]) for x, y in zip(*_windows(0, len(words)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["t"])

    windows = own.join(F.broadcast(picked.distinct()), "_id").select("_text").mapInArrow(cut, "t string").distinct()
    return train(sorted(r[0] for r in windows.orderBy(F.xxhash64("t"), "t").limit(sample_windows).collect()))


def _hits(model: Licences, text: str) -> tuple[int, list[dict]]:
    """Lines with a word, and what is found in them and across the lines of a block between blank lines: a hit per line and
    family, and per block and family if none of its lines has one, or only the block is confirmed."""
    words, parts, blocks, n, at = [], [], [[]], 0, 0
    for line in text.split("\n"):
        if not line.strip():
            blocks.append([])
            continue
        h = _word_hashes(line)
        if len(h):
            words.append(h)
            blocks[-1].append((at, at + len(h), n))
            at += len(h)
        n += 1
    if not words:
        return n, []
    h, lines_of = np.concatenate(words), {}
    line_starts, line_at = [a for block in blocks for a, *_ in block], [i for block in blocks for *_, i in block]
    for block in blocks:
        for a, b, i in block:
            parts.append((a, b, [i]))
        if len(block) > 1:
            parts.append((block[0][0], block[-1][1], [i for *_, i in block]))
    starts, ends, owner = [], [], []
    for k, (a, b, _) in enumerate(parts):
        x, y = _windows(a, b)
        starts += x
        ends += y
        owner += [k] * len(x)
    p = model.of_windows(h, starts, ends)
    best: dict[tuple[int, int], tuple[float, int]] = {}
    for w, y in zip(*np.nonzero((p[:, 1:] >= LEAST) & (p[:, 1:] > p[:, :1])), strict=True):
        best[owner[w], int(y) + 1] = max(best.get((owner[w], int(y) + 1), (0.0, 0)), (float(p[w, y + 1]), -starts[w]))
    found = []
    for (k, y), (prob, start) in sorted(best.items()):  # the lines of a block come before it
        a, b, lines = parts[k]
        share = template_share(h[a:b], FAMILIES[y])
        if len(lines) > 1:
            own = [lines_of[i, y] for i in lines if (i, y) in lines_of]
            if any(own) or own and share < CONFIRM:
                continue
            i = line_at[bisect_right(line_starts, -start) - 1]
        else:
            i = lines[0]
            lines_of[i, y] = share >= CONFIRM
        found.append({"paragraph": i, "family": FAMILIES[y], "probability": round(prob, 4), "template_share": share, "confirmed": share >= CONFIRM})
    return n, sorted(found, key=lambda x: x["paragraph"])


def scan(docs: DataFrame, model: Licences, id_col="doc_id", text_col="text") -> DataFrame:
    """Per document: doc_id, n_paragraphs (lines with a word), and hits: an array of (paragraph, family, probability,
    template_share, confirmed) in the order of the text. Null and empty texts have no paragraphs; repeated rows are
    scanned alike. Every line is read whole, in windows, and so are blocks of lines, where a hit has the number of the line that
    its window begins in."""
    hit = pa.struct([("paragraph", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("template_share", pa.float64()), ("confirmed", pa.bool_())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_paragraphs", pa.int64()), ("hits", pa.list_(hit))])

    def scanned(batches):
        for b in batches:
            counts, hits = [], []
            for text in b.column(1):
                n, found = _hits(model, text.as_py() or "")
                counts.append(n)
                hits.append(found)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(hits, schema.field(2).type)], schema=schema)
        _forget()

    ddl = "doc_id long, n_paragraphs long, hits array<struct<paragraph:long,family:string,probability:double,template_share:double,confirmed:boolean>>"
    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text").mapInArrow(scanned, ddl)


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, fit(docs))
    confirmed = F.array_sort(F.array_distinct(F.transform(F.filter("hits", lambda h: h["confirmed"]), lambda h: h["family"])))
    return found.select(
        "doc_id", "n_paragraphs", F.size("hits").cast("long").alias("n_hits"),
        F.when(F.size(confirmed) > 0, F.array_join(confirmed, ",")).otherwise(UNKNOWN).alias("families"), "hits",
    )
