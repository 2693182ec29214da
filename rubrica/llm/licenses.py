"""License scans, on DataFrame functions: a trained classifier of paragraphs, confirmed by templates.

A paragraph ends at a blank line (comment signs alone are blank); its lines are read as one run of
words, so notices that are wrapped or set in comments are whole, and long paragraphs are read in
overlapping windows. The classifier is a multinomial logistic regression over word n-grams (one and
two words), sparse by an L1 penalty, with a learned class of its own for what is no license. It is
fitted on the driver, from the templates below and from a bounded sample of the corpus. A prediction
counts as confirmed only if the window also covers enough of a template of that family. A scan is one
pass over the rows, without a shuffle.
"""

from __future__ import annotations

import json
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"
#: Usual notices of each family, a sentence or header each, of at most STEP words.
TEMPLATES = {
    "agpl": (
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "boost": (
        "Distributed under the Boost Software License, Version 1.0.",
        "Boost Software License - Version 1.0 - August 17th, 2003",
        "SPDX-License-Identifier: BSL-1.0",
    ),
    "bsd": (
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Released under the BSD License.",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "cc0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "epl": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "isc": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "SPDX-License-Identifier: LGPL-3.0-only",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: Unlicense",
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
        "SPDX-License-Identifier: Zlib",
    ),
}
#: Words that say nothing of a license by themselves. A feature has another word as well.
PLAIN = frozenset(
    "0 1 17th 2 2003 3 4 a above accompanying agreed all along altered an and any anyone appear applicable are arising as associated at august author "
    "authors available basis be been being by can charge clause code commercial compliance conditions copies copy damages deal dedicated distribute "
    "distributed documentation domain either event except express extent fee file files following for form forms found foundation free from general "
    "governed has have held http https if implied in included international into is it kind later law legal library list made marked materials may means "
    "met modification modify more must no non not obtain of on one only option or org original other person plainly possible program project provided "
    "public purpose received related released required rights see shall should software source style subject such terms that the this to under universal "
    "unless use v version versions was which will with without work writing www you your".split())
#: Sentences with words of licenses that are none.
OTHERS = (
    "He lost his driving license on the way to the public library.", "The apache helicopter landed near the river, and the Apache people were there first.",
    "She studied at MIT and released a new version of her work under her own name.", "Permission to speak was granted free of charge to any person.",
    "The general public is not subject to these terms.", "The software is provided to schools, with source code and files.",
    "You may obtain a copy of the report at the office.", "This work is free and open to any person.",
    "Er kam mit dem Zug und ging mit einer Lizenz der Software nach Hause, mit Freunden.", "Die Genehmigung wurde mit Auflagen erteilt, mit oder ohne Änderung.",
    "A fishing license is required by law; licensed anglers may use the lake.", "The restaurant is fully licensed and the bar has a license until midnight.",
    "The GNU compiler and the BSD kernel were compared with Mozilla and Eclipse on three machines.", "The creative director commons room and the attribution of the painting are disputed.",
    "The server runs Apache 2.0 behind a proxy; the MIT group measured it.", "Redistribution of income was permitted by the following conditions of the treaty.",
    "Copy this file to cc by mail, and cc the author.", "A gnu grazes on the lesser plains, and a boost of rain came.",
    "The license plate of the car was found in public.", "Wir danken dem MIT für die Lizenzierung der Daten und der Firma Apache für alles.",
    "Le permis est accordé par la loi; la licence de la radio fut vendue.", "Authors will be held liable for damages in no event that we know of.",
)
#: The driver learns from windows of at most so many documents, at most so many of each.
MOST_DOCS, MOST_WINDOWS = 300, 20
#: Words of a window, and from one to the next; a template fits into what two neighbours share.
WINDOW, STEP = 96, 48
#: A family needs this calibrated probability, and this share of a template's word pairs.
LEAST_PROBABILITY, LEAST_COVERAGE = 0.5, 0.6
_WORD = re.compile("[a-z0-9]+")
#: Between paragraphs: a line of blanks and comment signs only.
BLANK_LINE = r"\n[ \t\r#*/;%!|<>\-]*\n"


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _pairs(words: list[str]) -> list[str]:
    """Neighbouring words, each pair once; the words themselves where there is no pair."""
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))) or list(dict.fromkeys(words))


def _grams(words: list[str]) -> set[str]:
    return set(words) | set(_pairs(words))


class LicenseModel:
    """classes (the last is UNKNOWN), weights per n-gram, bias per class, heat.

    words: no family can win in a window without one of them, since the leads (what an n-gram adds at
    most to a family over UNKNOWN) of all n-grams without these words do not make up for the biases.
    """

    def __init__(self, classes, grams, weights, bias, heat):
        self.classes, self.grams, self.weights, self.bias, self.heat = classes, grams, weights, bias, heat
        least = float((bias[-1] - bias[:-1]).min()) - 1e-6
        lead = np.maximum(0, (weights[:, :-1] - weights[:, -1:]).max(1, initial=0)) if len(grams) else np.zeros(0)
        total: dict[str, float] = {}
        for g, x in zip(grams, lead.tolist(), strict=True):
            for w in g.split():
                if w not in PLAIN:
                    total[w] = total.get(w, 0.0) + x
        # the words whose n-grams lead most; the rest, all together, stay below `least`
        chosen: set[str] = set()
        for w in sorted(total, key=lambda w: (-total[w], w)):
            if sum(x for g, x in zip(grams, lead.tolist(), strict=True) if not chosen.intersection(g.split())) < least:
                break
            chosen.add(w)
        self.words = sorted(chosen)


def fit(negatives: list[list[str]], *, seed: int = 5, copies: int = 40, rounds: int = 400, rate: float = 0.5, l1: float = 2e-4) -> LicenseModel:
    """Learns from noisy copies of the templates against `negatives` (windows of words) and OTHERS.

    Every n-gram of a template that has a word outside PLAIN is a feature, whatever the negatives
    hold, and the weights alone decide what it says. Negatives with two such pairs of one template
    are taken for a license and left out. Every fifth example is kept out of training and sets the
    heat, by which logits are divided.
    """
    rng = np.random.default_rng(seed)
    classes = [*TEMPLATES, UNKNOWN]
    said = lambda grams: {g for g in grams if not PLAIN.issuperset(g.split())}
    templates = [(k, words_of(t)) for k, ts in enumerate(TEMPLATES.values()) for t in ts]
    telling = [said(_pairs(t)) for _, t in templates]
    clean = [n for n in negatives if not any(len(own & p) >= 2 for own in [set(_pairs(n))] for p in telling)]
    filler = sorted({w for n in clean for w in n}) or ["x"]
    grams = sorted(set().union(*[said(_grams(t)) for _, t in templates]))
    index = {g: i for i, g in enumerate(grams)}
    some = lambda words, n: [words[i] for i in rng.integers(0, len(words), n)]
    examples, y = [], []
    for k, words in templates:
        for c in range(copies):
            kept = [w for w in words if c == 0 or rng.random() > 0.1]
            ahead = int(rng.integers(0, 30)) * (c > 0)
            examples.append([*some(filler, ahead), *kept, *some(filler, int(rng.integers(0, 30)) * (c > 0))])
            y.append(k)
    terms = sorted({w for t in telling for p in t for w in p.split() if w not in PLAIN})
    others = [words_of(t) for t in OTHERS]
    stray = [[*some(filler, 10), *some(terms, 1), *some(filler, 10), *some(terms, int(rng.integers(0, 2))), *some(filler, 10)] for _ in range(6 * len(terms))]
    for n in [*clean, *others * 20, *stray]:
        examples.append(n)
        y.append(len(classes) - 1)
    rows: dict[tuple, list[int]] = {}  # equal examples are one row with a weight
    for i, (words, k) in enumerate(zip(examples, y, strict=True)):
        rows.setdefault((i % 5 == 4, k, tuple(sorted(index[g] for g in _grams(words) if g in index))), []).append(i)
    x, n = np.zeros((len(rows), len(grams)), np.float32), np.array([len(v) for v in rows.values()], np.float32)
    for r, (_, _, at) in enumerate(rows):
        x[r, list(at)] = 1
    held, y = np.array([h for h, _, _ in rows]), np.array([k for _, k, _ in rows])
    share = np.bincount(y[~held], n[~held], len(classes))
    each = share.sum() / np.maximum(1, share * len(classes))
    each[-1] = max(1.0, each[-1])  # negatives are real text: each counts in full
    w, b = np.zeros((len(grams), len(classes)), np.float32), np.zeros(len(classes), np.float32)
    xt, yt = x[~held], y[~held]
    weight = (each[yt] * n[~held] / share.sum())[:, None].astype(np.float32)
    for _ in range(rounds):
        z = xt @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(yt)), yt] -= 1
        p *= weight
        w -= 10 * rate * (xt.T @ p)
        w = np.sign(w) * np.maximum(np.abs(w) - 10 * rate * l1, 0)
        b -= rate * p.sum(0)
    z, best, heat = x[held] @ w + b, np.inf, 1.0
    for h in np.geomspace(0.2, 5, 30):
        p = np.exp((z - z.max(1, keepdims=True)) / h)
        p /= p.sum(1, keepdims=True)
        loss = -(n[held] * np.log(np.maximum(p[np.arange(held.sum()), y[held]], 1e-9))).sum()
        if loss < best:
            best, heat = loss, float(h)
    used = np.abs(w).sum(1) > 0
    return LicenseModel(classes, [g for g, u in zip(grams, used, strict=True) if u], w[used].astype(float), b.astype(float), heat)


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _windows(text: Column) -> Column:
    """array<struct<paragraph, part, words>>: the windows of all paragraphs of a text, in order."""
    def of(words: Column, i: Column) -> Column:
        parts = F.greatest(F.lit(1), F.ceil((F.size(words) - (WINDOW - STEP)) / STEP).cast("int"))
        return F.transform(F.sequence(F.lit(0), parts - 1), lambda k: F.struct(i.alias("paragraph"), k.alias("part"), F.slice(words, k * STEP + 1, F.lit(WINDOW)).alias("words")))

    return F.flatten(F.transform(F.transform(F.split(F.lower(text), BLANK_LINE), _words), of))


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most_docs: int = MOST_DOCS, most_windows: int = MOST_WINDOWS) -> LicenseModel:
    """A model from the templates and from at most `most_windows` windows each of `most_docs` documents.

    Documents are taken by the order of a hash of their ids, windows by that of their words; null
    texts teach nothing. Without documents the templates and OTHERS are all there is to learn from.
    """
    rows = docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(F.col(id_col)).alias("h"), F.col(text_col).alias("text"))
    least = [r["h"] for r in rows.select("h").distinct().orderBy("h").limit(most_docs).collect()]
    keyed = F.transform(_windows(F.col("text")), lambda x: F.struct(F.xxhash64(x["words"]).alias("h"), x["words"].alias("words")))
    found = rows.where(F.col("h").isin(least)).select("h", F.slice(F.array_sort(keyed), 1, most_windows).alias("w"))
    few = found.groupBy("h").agg(F.min("w").alias("w")).orderBy("h")  # of rows that share an id, one
    return fit([list(x["words"]) for r in few.collect() for x in r["w"]])


def scan(docs: DataFrame, model: LicenseModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, findings array<struct<paragraph, part, family, probability, coverage, confirmed>>), a row per row of docs.

    findings are the windows (part `part` of a paragraph, both from 0) whose best class is a family
    with at least LEAST_PROBABILITY, in order; confirmed ones cover at least LEAST_COVERAGE of the
    word pairs of one of its templates. Of neighbouring windows of one family only the one with more
    coverage stays, so a notice that both hold is found once. Null and empty texts have none. Rows
    that repeat id and text have equal rows; null ids stay. Only the two named columns are read. An
    empty table gives an empty result.

    Rows are judged each by itself. Weights and templates travel with the plan, and the templates
    above bound them; a text without a word that the model needs is split into words and no more.
    """
    constant = lambda value, kind: F.from_json(F.lit(json.dumps(value)), kind)
    known = F.array(*map(F.lit, model.words)) if model.words else F.array().cast("array<string>")
    weights = constant({g: w for g, w in zip(model.grams, model.weights.tolist(), strict=True)}, "map<string,array<double>>")
    bias, classes = constant(model.bias.tolist(), "array<double>"), constant(model.classes, "array<string>")
    templates = constant({f: [_pairs(words_of(t)) for t in ts] for f, ts in TEMPLATES.items()}, "map<string,array<array<string>>>")

    def pairs(words: Column) -> Column:
        each = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1)))
        return F.array_distinct(F.when(F.size(words) > 1, each).otherwise(words))

    def judged(window: Column) -> Column:
        def by(own: Column) -> Column:
            held = F.array_intersect(F.concat(window["words"], own), F.map_keys(weights))
            logits = F.aggregate(held, bias, lambda z, g: F.zip_with(z, F.try_element_at(weights, g), lambda a, b: a + b))
            return _let(logits, lambda z: _let(F.array_max(z), lambda top: F.struct(
                window["paragraph"].alias("paragraph"), window["part"].alias("part"), F.get(classes, F.array_position(z, top).cast("int") - 1).alias("family"),
                (1 / F.aggregate(z, F.lit(0.0), lambda s, x: s + F.exp((x - top) / model.heat))).alias("probability"), own.alias("pairs"))))

        return _let(pairs(window["words"]), by)

    def covered(hit: Column) -> Column:
        shares = F.transform(F.try_element_at(templates, hit["family"]), lambda t: F.size(F.array_intersect(hit["pairs"], t)) / F.size(t))
        return F.struct(hit["paragraph"].alias("paragraph"), hit["part"].alias("part"), hit["family"].alias("family"), hit["probability"].alias("probability"), F.array_max(shares).alias("coverage"))

    def beaten(hits: Column, x: Column, other: Column) -> Column:
        beside = (x["paragraph"] == other["paragraph"]) & (F.abs(x["part"] - other["part"]) == 1) & (x["family"] == other["family"])
        rank = lambda h: F.struct(h["coverage"].alias("a"), h["probability"].alias("b"), (-h["part"]).alias("c"))
        return F.coalesce(beside & (rank(other) > rank(x)), F.lit(False))

    def best(hits: Column) -> Column:
        kept = F.filter(hits, lambda x, i: ~beaten(hits, x, F.get(hits, i + 1)) & ~beaten(hits, x, F.get(hits, F.greatest(i - 1, F.lit(0)))))
        return F.transform(kept, lambda x: F.struct(*[x[c].alias(c) for c in ("paragraph", "part", "family", "probability", "coverage")], (x["coverage"] >= LEAST_COVERAGE).alias("confirmed")))

    kind = "array<struct<paragraph:int,part:int,family:string,probability:double,coverage:double,confirmed:boolean>>"
    text = F.col(text_col)
    windows = F.filter(_windows(text), lambda w: F.arrays_overlap(w["words"], known))
    hits = F.filter(F.transform(windows, judged), lambda x: (x["family"] != UNKNOWN) & (x["probability"] >= LEAST_PROBABILITY))
    found = F.when(F.arrays_overlap(_words(text), known), _let(F.transform(hits, covered), best))
    return docs.select(F.col(id_col).alias(id_col), F.coalesce(found, F.array()).cast(kind).alias("findings"))
