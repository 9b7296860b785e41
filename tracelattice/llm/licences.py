"""Licence notices by a trained paragraph classifier (scoring is native).

Paragraphs are runs of lines that are not empty, so a notice that is wrapped, or commented line by line, is one.
They are read in windows of ``WINDOW`` words, each half over the one before: how long the line or the paragraph
round a notice is makes no difference.  Features are the words and word pairs that a window has of those of the
notices; a multinomial logistic regression with an L1 penalty is fitted on the driver to notices in many
wordings (``SAMPLE`` rows for each family, a fixed bound) and to an unknown class: notices of invented licences,
salad of licence words, everyday sentences.  Its temperature is fitted on held-out rows.  A window is given a
family if its calibrated probability reaches ``LEAST_P`` and if it has ``LEAST_SHARE`` of the terms of one of that
family's names or of one of the stretches of at most ``STRETCH`` words that its notices are cut into.

Plan: each text's terms are hashes; they meet a broadcast table of the features (the notices' words, a fixed
bound), and only hits go on: into their two windows, distinct, then summed.  A window without a hit has only the
intercepts, which say unknown, so it needs no row.  (Outer explodes: an inner one infers a filter that repeats
the expression below it for every word.)

Defined cases: null texts are empty; a very long text or line is just more windows, its hits dealt by window;
every row is scored, repeated or not; null keys are carried, other columns left out; a tie between families goes
to the first in the alphabet; an empty table gives no rows.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelattice.llm.common import RID, whole

SAMPLE = 240
WINDOW, STRIDE, STRETCH = 48, 24, 16
LEAST_P, LEAST_SHARE = 0.7, 0.75
# Public names, SPDX identifiers and notices by family.
NAMES = {
    "agpl": ["GNU Affero General Public License", "AGPL license", "AGPL v3", "AGPLv3", "AGPL-3.0"],
    "apache": ["Apache License", "Apache License 2.0", "Apache License, Version 2.0", "Apache 2.0 license", "Apache-2.0"],
    "bsd": ["BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "3-Clause BSD License", "Modified BSD License", "BSD-3-Clause", "BSD-2-Clause"],
    "cc0": ["CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero", "CC0-1.0"],
    "cc-by": ["Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 3.0 License", "Creative Commons Attribution License", "CC BY 4.0", "CC BY 3.0", "CC-BY license"],
    "cc-by-nc": ["Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial License", "CC BY-NC 4.0", "CC BY-NC 3.0", "CC-BY-NC license"],
    "cc-by-sa": ["Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike License", "CC BY-SA 4.0", "CC BY-SA 3.0", "CC-BY-SA license"],
    "gpl": ["GNU General Public License", "GNU GPL", "GPL license", "GPL v2", "GPL v3", "GPLv2", "GPLv3", "GPL-2.0", "GPL-3.0"],
    "lgpl": ["GNU Lesser General Public License", "GNU Library General Public License", "LGPL license", "LGPL v2.1", "LGPL v3", "LGPLv3", "LGPL-2.1", "LGPL-3.0"],
    "mit": ["MIT License", "MIT/X11 License", "MIT licence", "SPDX-License-Identifier: MIT", "license: MIT"],
    "mpl": ["Mozilla Public License", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0", "MPL-2.0"],
    "unlicense": ["The Unlicense", "Unlicense license", "SPDX-License-Identifier: Unlicense"],
    "zlib": ["zlib License", "zlib/libpng License", "SPDX-License-Identifier: Zlib"],
}
NOTICES = {
    "agpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation."],
    "apache": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "gpl": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."],
    "mit": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software."],
}
FORMS = [
    "Released under the {}.", "Licensed under the {}.", "Licensed under {}.", "This work is licensed under a {}.", "This software is distributed under the terms of the {}.", "{}", "License: {}",
    "Available under the {}, see the file LICENSE.", "The code is published under the {}.", "SPDX-License-Identifier: {}", "Use of this file is governed by the {} that can be found in the LICENSE file.",
]
EVERYDAY = [
    "The driver lost the license after the second accident.", "The software was released in spring and is free to use for schools.", "A copy of the letter was sent to the foundation in general terms.",
    "The public library is open to any person with a card.", "You can modify the form under the following conditions.", "The work is based on source material and the general idea of attribution.",
    "He was licensed to sell wine in the version of the law then in force.", "Free admission for children; all others pay at the door.", "The apache helicopter was released from service.",
    "Researchers at MIT published a study of public transport.", "Mozilla presented a new version of the browser.", "Creative work needs common ground and attribution.", "Permission to use the hall is granted by the office, provided that the fee is paid.",
    "All rights reserved. Copyright by the authors.", "Critics of the GPL met in the library.", "The warranty covers damages of any kind, express or implied.",
]
SUFFIXES = ["License", "Public License", "License 1.0", "Public License 2.0", "Public License, Version 2.0", "Software License", "Open License v1", "Free License", "License, Version 2.0", "Community License"]
FUNCTION_WORDS = "a an and any are as at be by for has in into is it may not of on or that the this to was with you".split()


def words_of(text: str) -> list[str]:
    return [x for x in re.split(r"[^\w]+|_+", text.lower()) if x]


def terms_of(w: list[str]) -> list[str]:
    """Distinct words and word pairs, joined by a space."""
    return list(dict.fromkeys([*w, *(" ".join(p) for p in zip(w, w[1:]))]))


def paragraphs(text: str | None) -> list[list[str]]:
    """The words of each paragraph."""
    return [words_of(p) for p in re.split(r"\n[ \t\x0b\x0c\r]*(?=\n)", text or "")]


def windows(w: list[str]) -> list[list[str]]:
    return [w[k : k + WINDOW] for k in range(0, max(1, len(w) - STRIDE), STRIDE)]


def varied(text: str, r: random.Random) -> str:
    """A text with words dropped and noise words around it; of a long one, some words on end."""
    w = text.split()
    if len(w) > 2 * STRETCH and r.random() < 0.7:
        n = r.randint(STRETCH + 4, len(w))
        at = r.randint(0, len(w) - n)
        w = w[at : at + n]
    if len(w) > 6:
        w = [x for x in w if r.random() > 0.05]
    noise = lambda: ["".join(r.choice("aeionrst") for _ in range(r.randint(2, 7))) for _ in range(r.choice((0, 0, 0, 2, 4, 12)))]
    return " ".join([*noise(), *w, *noise()])


def invented(r: random.Random) -> str:
    """The name of a licence that there is not."""
    word = lambda: "".join(r.choice(("ba", "ro", "ki", "len", "tor", "mu", "sa", "vix", "dal", "pe", "no", "gra")) for _ in range(r.randint(2, 4))).title()
    name = " ".join([word() for _ in range(r.choice((1, 1, 2)))] + [r.choice(SUFFIXES)])
    return r.choice((name, name, f"{word()[:4].upper()}-{r.randint(1, 3)}.0", f"{word()[:4].upper()} v{r.randint(1, 3)}"))


def examples(seed: int) -> list[tuple[str, int]]:
    """(text, class); class 0 is unknown, then the families in order."""
    r = random.Random(seed)
    salad = " ".join([*(t for ts in NOTICES.values() for t in ts), *FORMS, *SUFFIXES]).replace("{}", "").split()
    out = []
    for k, family in enumerate(sorted(NAMES), 1):
        for i in range(SAMPLE):
            notices = NOTICES.get(family, [])
            text = notices[i // 2 % len(notices)] if notices and i % 2 else r.choice(FORMS).format(r.choice(NAMES[family]))
            out.append((varied(text, r), k))
    for i in range(8 * SAMPLE):
        text = (r.choice(EVERYDAY), r.choice(FORMS).format(invented(r)), r.choice(FORMS).format(invented(r)), " ".join(r.choice(salad) for _ in range(r.randint(1, 14))))[i % 4]
        out.append((varied(text, r), 0))
    return out


class Model:
    """Weights by term, intercepts and temperature."""

    def __init__(self, seed: int = 1) -> None:
        drop = set(FUNCTION_WORDS)
        self.families = sorted(NAMES)
        texts = [(k, t) for k, f in enumerate(self.families, 1) for t in (*NAMES[f], *NOTICES.get(f, []))]
        found = {t for text in [*(t for _, t in texts), *FORMS, *EVERYDAY, *SUFFIXES] for t in terms_of(words_of(text))}
        self.terms = sorted(t for t in found if not set(t.split()) <= drop)
        self.index = {t: i for i, t in enumerate(self.terms)}
        x, y = self.matrix(examples(seed))
        n, k = len(y), len(self.families) + 1
        target = np.eye(k, dtype=np.float32)[y]
        w, b, step, penalty = np.zeros((x.shape[1], k), np.float32), np.zeros(k, np.float32), np.float32(2.0), np.float32(3e-5)
        for _ in range(600):
            p = softmax(x @ w + b)
            w -= step * (x.T @ (p - target) / n)
            b -= step * (p - target).mean(0)
            w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)  # L1: most weights are 0
        self.w, self.b = np.round(w.astype(float), 5), np.round(b.astype(float), 5)
        hx, hy = self.matrix(examples(seed + 1))
        z = hx @ self.w + self.b
        loss = lambda t: -np.log(softmax(z / t)[np.arange(len(hy)), hy] + 1e-12).mean()
        self.temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=loss)
        # What confirms a family: its names, and its notices in stretches.
        parts = [(c, words_of(t)[a : a + STRETCH]) for c, t in texts for a in range(0, max(1, len(words_of(t)) - STRETCH // 2), STRETCH // 2)]
        self.templates = [(c, [t for t in terms_of(w) if t in self.index]) for c, w in parts]

    def matrix(self, rows: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(rows), len(self.terms)), np.float32)
        for i, (text, _) in enumerate(rows):
            x[i, [self.index[u] for u in terms_of(words_of(text)) if u in self.index]] = 1
        return x, np.array([k for _, k in rows])

    def classify_window(self, w: list[str]) -> tuple[str, float] | None:
        """Family and probability of one window, as ``scan`` says."""
        have = {t for t in terms_of(w) if t in self.index}
        z = (self.b + sum((self.w[self.index[t]] for t in sorted(have)), np.zeros(len(self.b)))) / self.temperature
        p = softmax(z[None])[0]
        best = int(p.argmax())
        confirmed = any(c == best and len(have & set(t)) >= LEAST_SHARE * len(t) for c, t in self.templates)
        return (self.families[best - 1], float(p[best])) if best and p[best] >= LEAST_P and confirmed else None

    def classify(self, text: str | None) -> dict[tuple[int, str], float]:
        """(paragraph, family) to the best probability of its windows."""
        out: dict[tuple[int, str], float] = {}
        for k, w in enumerate(paragraphs(text)):
            for x in filter(None, map(self.classify_window, windows(w))):
                out[k, x[0]] = max(out.get((k, x[0]), 0.0), x[1])
        return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@lru_cache(1)
def trained() -> Model:
    return Model()


def tables(spark: SparkSession, m: Model) -> tuple[DataFrame, DataFrame]:
    """(h, term, w1..) for each feature, and (term, template, class, least) for each feature of a template."""
    weights = [(i, t, *(float(v) for v in m.w[i])) for i, t in enumerate(m.terms)]
    pair = F.split("text", " ")
    h = F.when(F.size(pair) == 1, F.xxhash64(pair[0])).otherwise(F.xxhash64(pair[0], F.get(pair, 1))).alias("h")
    columns = [f"w{c}" for c in range(len(m.b))]
    features = spark.createDataFrame(weights, "term int, text string, " + ", ".join(f"{c} double" for c in columns)).select(h, "term", *columns)
    member = [(m.index[t], j, c, LEAST_SHARE * len(ts)) for j, (c, ts) in enumerate(m.templates) for t in ts]
    return features, spark.createDataFrame(member, "term int, template int, best int, least double")


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, paragraph, family, probability, word) of every family that a paragraph has a notice of; paragraphs
    and words count from 0, ``word`` begins the window of the highest probability (the first of these)."""
    spark, m = docs.sparkSession, trained()
    features, member = tables(spark, m)
    split = F.split(whole(F.col(f"`{text}`")), "\n[\\x20\\x09\\x0B-\\x0D]*(?=\n)")
    rows = docs.select(F.monotonically_increasing_id().alias(RID), F.col(f"`{key}`").alias("key"), F.posexplode_outer(split).alias("paragraph", "t"))
    rows = rows.select(RID, "key", "paragraph", F.filter(F.split(F.lower("t"), "[^\\p{L}\\p{N}]+"), lambda x: x != "").alias("w"))
    pairs = F.transform(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("w", i + 1)))
    rows = rows.select(RID, "key", "paragraph", F.size("w").alias("n"), F.concat(F.transform("w", lambda x: F.xxhash64(x)), pairs).alias("h"))
    hits = rows.select(RID, "key", "paragraph", "n", F.posexplode_outer("h").alias("at", "h")).join(F.broadcast(features.select("h", "term")), "h")
    # A word or pair is in the windows that begin at most WINDOW words before its end.
    first = F.when(F.col("at") < F.col("n"), F.col("at")).otherwise(F.col("at") - F.col("n"))
    end = F.when(F.col("at") < F.col("n"), first + 1).otherwise(first + 2)
    turn = F.call_function("div", first, F.lit(STRIDE)).cast("int")
    count = F.greatest(F.lit(1), F.ceil((F.col("n") - STRIDE) / F.lit(STRIDE)))
    near = F.filter(F.array(turn - 1, turn), lambda k: (k >= 0) & (k < count) & (end <= k * STRIDE + WINDOW))
    window = [RID, "key", "paragraph", "k"]
    hits = hits.select(RID, "key", "paragraph", F.explode(near).alias("k"), "term").distinct()
    classes = range(len(m.b))
    scored = hits.join(F.broadcast(features.drop("h")), "term").groupBy(*window).agg(*[F.sum(f"w{c}").alias(f"w{c}") for c in classes])
    logits = F.array(*[(F.col(f"w{c}") + float(m.b[c])) / m.temperature for c in classes])
    scored = scored.select(*window, logits.alias("z"))
    total: Column = F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("z")))
    scored = scored.select(*window, (F.array_position("z", F.array_max("z")) - 1).cast("int").alias("best"), (1 / total).alias("probability"))
    scored = scored.where((F.col("best") > 0) & (F.col("probability") >= LEAST_P))
    confirmed = hits.join(F.broadcast(member), "term").groupBy(*window, "best", "template", "least").agg(F.count("*").alias("common")).where(F.col("common") >= F.col("least"))
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"c.{c}")) for c in (*window, "best")]
    found = scored.alias("s").join(confirmed.alias("c"), [x for x in same], "left_semi")
    top = F.max(F.struct("probability", (-F.col("k")).alias("before"))).alias("top")
    found = found.groupBy(RID, "key", "paragraph", "best").agg(top)
    family = F.get(F.array(F.lit("unknown"), *[F.lit(f) for f in m.families]), F.col("best"))
    return found.select(F.col("key").alias(key), "paragraph", family.alias("family"), F.col("top.probability").alias("probability"), (-F.col("top.before") * STRIDE).alias("word"))
