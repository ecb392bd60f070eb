"""Licence scan: a trained paragraph classifier, confirmed against templates.

Paragraphs are the lines of a text, and its blocks: lines up to a blank one,
joined, so that a notice wrapped over several lines is seen whole. They are
scored by a multinomial logistic regression over the presence of words and word
pairs: licence families, and ``unknown``. Texts and paragraphs without one of the
model's ``telling`` words aren't scored: its other words, all together, can't raise
any family above unknown. The model is trained when the operator is set up, from
the templates below: copies with words dropped, inserted and cut, and, for the
unknown class, texts that use the same words otherwise, and others. A temperature
calibrates its probabilities; it is fitted on notices and sentences that were in no
way trained on (``HELD``). What stays below ``LEAST`` is unknown. A prediction is
confirmed if a template of its family shares enough word pairs with the paragraph.

On the main path there are DataFrame functions only: weights and templates are a
small table (a fixed size, broadcast) that meets the exploded n-grams in a join.
Rows of n-grams don't carry their paragraph's text, and texts aren't shuffled.

A line has a row if it holds a cue or a family is predicted, a block if a family
is predicted that none of its lines shows as well.

Cases: null and empty texts have no paragraphs, so no rows. Repeated rows of one
doc_id with the same line at the same place count once; null ids are kept. Equal
probabilities go to the smaller family name. Empty tables give no rows. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"
#: A family is predicted with this probability at least, and confirmed with this share of a template's word pairs.
LEAST, CONFIRM = 0.5, 0.6

#: Notices by which texts state their licences.
TEMPLATES = {
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU Affero General Public License v3.0.", "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "artistic": ["Licensed under the Artistic License.", "This package is free software; you may redistribute it under the terms of the Artistic License 2.0.", "SPDX-License-Identifier: Artistic-2.0"],
    "boost": ["Licensed under the Boost Software License.", "Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Released under the BSD License.", "SPDX-License-Identifier: BSD-3-Clause",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."],
    "cc-by-nd": ["This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "Licensed under CC BY-ND 4.0."],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related rights to this work.", "Dedicated to the public domain under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0", "Licensed under CC0.", "Released under a CC0 license."],
    "epl": ["Licensed under the Eclipse Public License.", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.", "SPDX-License-Identifier: EPL-2.0"],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.", "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.", "SPDX-License-Identifier: ISC",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-only",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ],
    "mit": [
        "Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the Software without restriction.", "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "mpl": [
        "Licensed under the Mozilla Public License 2.0.", "Released under the MPL 2.0 license.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/, the license text.",
    ],
    "odbl": ["Licensed under the Open Database License.", "This database is made available under the Open Database License.", "SPDX-License-Identifier: ODbL-1.0"],
    "proprietary": [
        "Copyright. All rights reserved. No part of this work may be reproduced without written permission of the publisher.", "All rights reserved.",
        "This copyrighted material is confidential and proprietary. Unauthorized copying of this file, via any medium, is strictly prohibited.",
    ],
    "unlicense": ["Released into the public domain under the Unlicense.", "This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
    "wtfpl": ["Licensed under the Do What The Fuck You Want To Public License, version 2.", "SPDX-License-Identifier: WTFPL"],
    "zlib": [
        "Licensed under the zlib License.", "Released under the zlib License.", "SPDX-License-Identifier: Zlib",
        "This notice may not be removed or altered from any source distribution. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. It is licensed as is.",
    ],
}
#: Sentences that state no licence, many with the same words.
OTHERWISE = [
    "She lost her driving license in the city.", "The licensed plumber came under the house at noon.", "A public library opened its doors.",
    "He was given permission to leave the hall.", "The general asked for copies of the source.", "Apache helicopters flew over the valley.",
    "Students at MIT published a paper.", "The law on copyright was debated in public.", "All rights and duties of citizens are reserved to the courts.",
    "The version of the story was free of errors.", "Distribution of the goods began at dawn.", "They released the birds under the bridge.",
    "The fishing licence costs ten pounds.", "This work is hard and the terms are poor.", "Creative people share their domain with others.",
    "The file that you asked for is on the desk in the other room.", "Conditions on the mountain changed within an hour of our arrival.", "Her name may be used by the family without any fee.",
    "We met the following people at the station, each with a list of questions.", "Software engineers often work late when a program fails.", "The eclipse was visible from the whole coast last summer.",
    "A boost in sales followed the new advertising.", "The artistic director of the theatre retired after thirty years.", "Mozilla and other companies hired developers that spring.",
    "You can obtain tickets at the door or through the website.", "Any person over the age of twelve pays the full price.", "The foundation gave money to schools and hospitals in the region.",
    "Modification of the old engine took them most of the winter.", "He wrote the original of the letter in pencil.", "The database of the museum holds a million photographs.",
    "Prices include tax and are subject to change.", "The notice on the wall said that the pool was closed.", "Commons and heaths surround the village on three sides.",
    "Attribution of the painting to her is still in doubt.", "International flights leave from the second terminal.", "In no event did the mayor take part in the race.",
]
#: Notices and sentences that only the temperature is fitted on.
HELD = [
    ("agpl", "Distributed under the terms of the GNU Affero General Public License, version 3."), ("apache", "This project is licensed under the Apache License 2.0."), ("artistic", "Available under the Artistic License."),
    ("boost", "Use is subject to the Boost Software License."), ("bsd", "This software is distributed under the three clause BSD license."), ("cc-by", "Text is available under Creative Commons Attribution 4.0."),
    ("cc-by-nc", "Images are CC BY-NC licensed."), ("cc-by-sa", "Content is available under CC BY-SA 4.0 unless noted."), ("cc0", "The data are released under CC0."), ("epl", "Made available under the Eclipse Public License."),
    ("gpl", "This file is covered by the GNU General Public License."), ("isc", "Published under the ISC license."), ("lgpl", "You may link to it under the GNU Lesser General Public License."), ("mit", "The code is MIT licensed, see the MIT License."),
    ("mpl", "Covered by the Mozilla Public License 2.0."), ("odbl", "Map data under the Open Database License."), ("proprietary", "All rights reserved by the author."), ("unlicense", "Unencumbered software in the public domain."),
    ("zlib", "It comes with the zlib license."),
    ("unknown", "The old man walked to the harbour every morning."), ("unknown", "A dog licence was required in the town until recently."), ("unknown", "The permission slip must be signed by a parent."),
    ("unknown", "Public transport is free of charge on Sundays."), ("unknown", "The copyright office moved to another street."), ("unknown", "Rights of way cross the field in two places."), ("unknown", "Use the source of the river as a landmark."),
    ("unknown", "They agreed in writing on the terms of the sale."), ("unknown", "The software failed on the first day of the trial."), ("unknown", "Version two of the plan had no conditions at all."), ("unknown", "Any later train will do as well."),
]
#: Stems, one of which each template has.
CUES = ("licen", "copyright", "rights reserved", "redistribut", "permission is hereby", "public domain", "free software", "spdx")
#: Words of ordinary texts. They teach nothing alone or among themselves: only pairs with another word are features.
COMMON = (
    "the of and to in a that is it was on for with he are at by this be or as an from do no our what any all not may you your we they i if but have has had will would can"
    " their there which when who its his her she one two so up out about into than then them these some could other more only new now over such"
).split()
_WORD = "[a-z0-9][a-z0-9.+-]*[a-z0-9+]|[a-z0-9]"


def ngrams(text: str) -> list[str]:
    words = re.findall(_WORD, text.lower())
    return sorted({*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))})


def _words(low: Column) -> Column:
    return F.regexp_extract_all(low, F.lit(f"({_WORD})"), 1)


def _ngrams(words: Column) -> Column:
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.concat(words, F.filter(pairs, lambda x: x.isNotNull())))


def telling(model: Classifier) -> list[str]:
    """Words one of which a text must hold for a family to reach unknown's probability.

    The rest are words whose weights for a family above those for unknown, and
    those of the pairs among them, don't add up to what the bias gives unknown.
    """
    at = model.families.index(UNKNOWN)
    room = np.delete(model.bias[at] - model.bias, at)
    above = np.delete(np.maximum(model.weights - model.weights[:, [at]], 0), at, axis=1)
    pairs: dict[str, list[tuple[str, int]]] = {}
    for f, i in model.number.items():
        x, _, y = f.partition(" ")
        pairs.setdefault(x, []).append((y or x, i))
        if y and y != x:
            pairs.setdefault(y, []).append((x, i))
    stock = [f for f in model.features if " " not in f]
    harmless: set[str] = set(COMMON)
    for w in sorted(stock, key=lambda w: (above[model.number[w]].max(), w)):
        cost = above[[i for x, i in pairs[w] if x == w or x in harmless]].sum(axis=0)
        if (cost <= room).all():
            harmless.add(w)
            room = room - cost
    return [w for w in stock if w not in harmless]


class Classifier:
    def __init__(self, families: list[str], features: list[str], weights: np.ndarray, bias: np.ndarray) -> None:
        self.families, self.features, self.weights, self.bias = families, features, weights, bias
        self.number = {f: i for i, f in enumerate(features)}

    def logits(self, text: str) -> np.ndarray:
        return self.bias + self.weights[[self.number[g] for g in ngrams(text) if g in self.number]].sum(axis=0)


@functools.cache
def train(copies: int = 12, steps: int = 200, rate: float = 0.5, l2: float = 2e-4, seed: int = 5) -> Classifier:
    """Fit the classifier and its temperature; the data are the constants above."""
    rng = np.random.default_rng(seed)
    families = [UNKNOWN, *sorted(TEMPLATES)]
    filler = sorted({w for x in OTHERWISE for w in x.split()})
    stock = sorted({w for x in TEMPLATES.values() for t in x for w in t.split()})

    def varied(text: str) -> str:
        words = [w for w in text.split() if rng.random() > 0.08]
        for _ in range(rng.integers(0, 4)):
            words.insert(int(rng.integers(0, len(words) + 1)), str(rng.choice(filler)))
        return " ".join(words)

    rows = [(families.index(f), t if i == 0 else varied(t)) for f, x in TEMPLATES.items() for t in x for i in range(copies)]
    rows += [(0, t if i == 0 else varied(t)) for t in OTHERWISE for i in range(copies)]
    rows += [(0, " ".join(rng.choice(stock if i % 2 else filler, rng.integers(1, 9)))) for i in range(20 * copies)]
    features = sorted({g for _, t in rows for g in ngrams(t) if not set(g.split()) <= set(COMMON)})
    number = {g: i for i, g in enumerate(features)}
    x = np.zeros((len(rows), len(features)), np.float32)
    for i, (_, t) in enumerate(rows):
        x[i, [number[g] for g in ngrams(t) if g in number]] = 1
    y = np.array([k for k, _ in rows])
    target = np.eye(len(families), dtype=np.float32)[y]
    w, b = np.zeros((len(features), len(families)), np.float32), np.zeros(len(families), np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = x.T @ (p - target) / len(rows) + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        b -= rate * (p - target).mean(axis=0)
    z = np.stack([b + w[[number[g] for g in ngrams(t) if g in number]].sum(axis=0) for _, t in HELD])
    held = np.array([families.index(f) for f, _ in HELD])

    def loss(t: float) -> float:
        s = z * t
        s = s - s.max(axis=1, keepdims=True)
        return float(-(s[np.arange(len(s)), held] - np.log(np.exp(s).sum(axis=1))).mean())

    t = min(np.geomspace(0.1, 3, 40), key=loss)
    return Classifier(families, features, np.round(w.astype(float) * t, 6), np.round(b.astype(float) * t, 6))


def paragraphs(text: DataFrame) -> DataFrame:
    """doc_id, h (the text's hash), row, line (from 1), lines, content: lines, and blocks of several lines, once each."""
    lines = F.split("text", "\n", -1)
    each = F.transform(lines, lambda x, i: F.struct((i + 1).alias("line"), F.lit(1).alias("lines"), x.alias("content")))
    marked = F.transform(lines, lambda x, i: F.when(F.trim(F.regexp_replace(x, r"\s", " ")) == "", "").otherwise(F.concat((i + 1).cast("string"), F.lit("\x01"), x)))
    blocks = F.transform(F.split(F.array_join(marked, "\n"), "\n\n+"), lambda b: F.regexp_replace(b, r"^\n+|\n+$", ""))
    first = lambda b: F.regexp_extract(b, "^([0-9]+)\x01", 1).try_cast("int")
    blocks = F.transform(blocks, lambda b: F.struct(first(b).alias("line"), F.size(F.split(b, "\n")).alias("lines"), F.regexp_replace(b, "(^|\n)[0-9]+\x01", " ").alias("content")))
    # in one array, so that a text is read once
    return text.select("doc_id", "h", "row", F.inline(F.concat(each, F.filter(blocks, lambda b: b["lines"] > 1))))


#: Templates whose counts of shared pairs one 64-bit number holds, each in so many bits.
PACKED, WIDTH = 7, 9


def gram_table(model: Classifier, templates: list[set[str]]) -> list[tuple[str, list[float], list[int]]]:
    """For each n-gram its weights by family, and ones packed for the templates that have it as a pair; the empty n-gram has the bias."""
    packs = -(-len(templates) // PACKED)
    marks: dict[str, list[int]] = {}
    for i, pairs in enumerate(templates):
        assert len(pairs) < 1 << WIDTH
        for g in pairs:
            marks.setdefault(g, [0] * packs)[i // PACKED] += 1 << (WIDTH * (i % PACKED))
    rows = [("", [float(v) for v in model.bias], [0] * packs)]
    for g in sorted({*model.features, *marks}):
        w = model.weights[model.number[g]] if g in model.number else np.zeros(len(model.families))
        rows.append((g, [float(v) for v in w], marks.get(g, [0] * packs)))
    return rows


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, line (the first, from 1), lines, family, probability, similarity, confirmed: each line or block that may state a licence."""
    spark = docs.sparkSession
    model = train()
    k = len(model.families)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    stock = telling(model)

    def cue(low: Column) -> Column:
        return functools.reduce(lambda a, b: a | b, [low.contains(x) for x in CUES])

    def told(words: Column) -> Column:
        return F.exists(words, lambda w: w.isin(stock))

    # most texts hold neither a cue nor a telling word, so neither do their paragraphs; an array of one, as a filter evaluates an expression at each use
    text = text.where(F.exists(F.array(F.lower("text")), lambda low: cue(low) | told(_words(low))))
    one = F.col("lines") == 1
    # repeated rows are told apart by a number of the row
    text = text.withColumn("row", F.monotonically_increasing_id())
    key = ["doc_id", "h", "row", "line", "lines"]
    # inline keeps what follows from evaluating these expressions again
    lines = paragraphs(text).select(*key, F.inline(F.transform(F.array(F.lower("content")), lambda low: F.struct(low.alias("low"), _words(low).alias("words")))))
    lines = lines.where((one & cue(F.col("low"))) | told(F.col("words")))
    named = [(f, {g for g in ngrams(t) if " " in g}) for f, x in TEMPLATES.items() for t in x]
    grams = gram_table(model, [pairs for _, pairs in named])
    table = spark.createDataFrame(grams, "gram string, w array<double>, t array<long>")
    # a paragraph's text goes no further: its n-grams have the weights and the templates' pairs, and a flag tells of its cue
    lines = lines.select(*key, (one & cue(F.col("low"))).alias("cued"), F.explode(F.concat(F.array(F.lit("")), _ngrams(F.col("words")))).alias("gram"))
    hits = lines.join(F.broadcast(table), "gram")
    packs = len(grams[0][2])
    logits = hits.groupBy(*key, "cued").agg(*(F.sum(F.col("w")[i]).alias(f"z{i}") for i in range(k)), *(F.sum(F.col("t")[i]).alias(f"t{i}") for i in range(packs)))
    top = logits.withColumn("top", F.greatest(*(F.col(f"z{i}") for i in range(k))))
    total = functools.reduce(lambda a, b: a + b, [F.exp(F.col(f"z{i}") - F.col("top")) for i in range(k)])
    guess = top.withColumn("probability", 1 / total).withColumn("guess", F.coalesce(*(F.when(F.col(f"z{i}") == F.col("top"), F.lit(f)) for i, f in enumerate(model.families))))
    guess = guess.withColumn("family", F.when(F.col("probability") >= LEAST, F.col("guess")).otherwise(F.lit(UNKNOWN)))
    guess = guess.where((F.col("family") != UNKNOWN) | F.col("cued"))

    def share(i: int) -> Column:
        held = F.shiftright(F.col(f"t{i // PACKED}"), WIDTH * (i % PACKED)).bitwiseAND(F.lit((1 << WIDTH) - 1))
        return held / F.lit(max(len(named[i][1]), 1))

    # the largest share of a template's pairs, of the templates of its family
    of = {f: [share(i) for i, (g, _) in enumerate(named) if g == f] for f in TEMPLATES}
    shares = [F.when(F.col("family") == f, F.greatest(*x) if len(x) > 1 else x[0]) for f, x in of.items()]
    best = guess.withColumn("similarity", F.coalesce(*shares, F.lit(0.0)))
    best = best.withColumn("confirmed", (F.col("family") != UNKNOWN) & (F.round("similarity", 6) >= CONFIRM))
    # a block says nothing new if one of its lines shows its family as well as it does
    units = best.groupBy("doc_id", "h").agg(F.collect_list(F.struct("line", "lines", "family", "probability", "similarity", "confirmed")).alias("u"))
    new = F.filter("u", lambda x: (x["lines"] == 1) | ~F.exists("u", lambda y: (y["lines"] == 1) & (y["line"] >= x["line"]) & (y["line"] < x["line"] + x["lines"]) & (y["family"] == x["family"]) & (y["confirmed"] | ~x["confirmed"])))
    found = units.select("doc_id", F.inline(new)).distinct()
    return found.select("doc_id", "line", "lines", "family", F.round("probability", 6).alias("probability"), F.round("similarity", 6).alias("similarity"), "confirmed")
