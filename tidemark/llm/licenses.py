"""Licence scans: a paragraph classifier over sparse word n-grams, confirmed against templates.

A multinomial logistic regression is fitted on the driver from the licence templates below, varied, and
from a bounded sample of the corpus' own paragraphs and of scrambled templates as the class ``unknown``; its
probabilities are calibrated by a temperature on examples kept apart. Scanning is DataFrame work only:
a paragraph is a run of lines with a letter or digit in each, so comment signs alone part paragraphs too, and
each single line is a candidate as well. A text without any of the model's signs cannot reach the weight that a family
needs, whatever else it says (``_signs``), so it is unknown; the others, each distinct one once, are cut into
n-grams, joined to the weights and summed. A family is confirmed if enough of one of its templates' n-grams stand in
the paragraph.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.tables import seeded_sample
from tidemark.plans.staging import stage

UNKNOWN = "unknown"
#: What paragraphs of the licence families say.
TEMPLATES = {
    "apache": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "See the License for the specific language governing permissions and limitations under the License.",
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "cc-by-nc": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "cc-by-sa": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "mit": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "reserved": (
        "All rights reserved.",
        "Copyright (c) 2020 Example. All rights reserved.",
        "No part of this publication may be reproduced, distributed or transmitted in any form without the prior written permission of the publisher.",
    ),
}
FAMILIES = (*TEMPLATES, UNKNOWN)
#: Paragraphs of the corpus that may be fitted on as unknown, at most.
TRAIN_PARAGRAPHS = 400
#: Characters of such a line, at most; of a longer one a stretch chosen by a seeded hash.
TRAIN_CHARS = 2_000
#: n-grams of 1 to so many words.
LONGEST = 3
#: Share of a template's n-grams that confirms its family.
CONFIRM = 0.7

#: Words that begin a comment line.
_COMMENT_WORD = r"(?i)^\s*@?(?:rem|dnl)\s"


def normal(text: str) -> list[str]:
    """Words of letters and digits, lower-cased, every number the same."""
    return [w for w in re.sub(r"[0-9]+", "0", re.sub(r"[^A-Za-z0-9]+", " ", text).lower()).split(" ") if w]


def normal_column(text: Column) -> Column:
    """The same words as a column, joined by single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, "[^A-Za-z0-9]+", " ")), "[0-9]+", "0"))


def ngrams(ws: list[str]) -> set[str]:
    return {" ".join(ws[i : i + n]) for n in range(1, LONGEST + 1) for i in range(len(ws) - n + 1)}


def ngrams_column(ws: Column) -> Column:
    """The distinct n-grams of an array of words."""
    # bound once: as a plain expression the array would be made anew for every n-gram
    return F.element_at(F.transform(F.array(ws), _ngrams_of), 1)


def _ngrams_of(ws: Column) -> Column:
    def of(n):
        last = F.size(ws) - n
        # elements one by one: a slice would copy the whole array for each n-gram
        gram = lambda i: F.concat_ws(" ", *[F.get(ws, i + j) for j in range(n)])
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), gram)).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[of(n) for n in range(1, LONGEST + 1)]))


def anchors() -> list[str]:
    """Few words of which every template paragraph holds one: a greedy cover, ties by the alphabet."""
    left = [" ".join(normal(t)) for ts in TEMPLATES.values() for t in ts]
    pool = sorted({w for t in left for w in t.split(" ") if len(w) >= 5})
    out = []
    while left:
        best = max(pool, key=lambda w: sum(w in t for t in left))
        out.append(best)
        left = [t for t in left if best not in t]
    return out


@dataclass
class Model:
    """Weights per n-gram and family, and each family's intercept, both divided by the temperature.

    Every text that is not unknown holds one of ``signs``; if that is None, any text may be of a family.
    """

    weights: dict[str, np.ndarray]
    intercept: np.ndarray
    signs: list[str] | None = None


def _signs(weights: dict[str, np.ndarray], intercept: np.ndarray, unknown: list[str]) -> list[str] | None:
    """The words of the n-grams without those that say too little: all n-grams made of the latter alone, taken
    together, leave every family behind unknown. Words frequent in ``unknown`` are left out first."""
    need = intercept[-1] - intercept[:-1] - 1e-6
    if (need <= 0).any():
        return None
    words = {g: set(g.split(" ")) for g in weights}
    seen = Counter(w for text in unknown for w in set(normal(text)))
    sum_of, idle = np.zeros(len(need)), set()
    for word in sorted({w for ws in words.values() for w in ws}, key=lambda w: (-seen[w], w)):
        more = [np.maximum(weights[g][:-1] - weights[g][-1], 0) for g, ws in words.items() if word in ws and ws <= idle | {word}]
        if (sum_of + sum(more) < need).all():
            sum_of, idle = sum_of + sum(more), idle | {word}
    return sorted({w for ws in words.values() for w in ws} - idle)


def _examples(unknown: list[str], rng: np.random.Generator) -> list[tuple[list[str], int]]:
    out = []
    for i, family in enumerate(TEMPLATES):
        for text in TEMPLATES[family]:
            ws = normal(text)
            out += [(ws, i)] * 4
            for _ in range(8):
                # a paragraph may stand among other words, or lose a few
                lead = [f"w{rng.integers(1000)}" for _ in range(rng.integers(0, 6))]
                kept = [w for w in ws if rng.random() > 0.05]
                out.append((lead + kept if rng.random() < 0.5 else kept + lead, i))
    every = [normal(t) for ts in TEMPLATES.values() for t in ts]
    last = len(FAMILIES) - 1
    for ws in every:
        for _ in range(6):
            # single licence words in other company say nothing
            some = rng.permutation(ws)[: rng.integers(1, 5)].tolist()
            filler = [f"w{rng.integers(1000)}" for _ in range(rng.integers(3, 20))]
            out.append((rng.permutation(some + filler).tolist(), last))
    out += [(normal(t), last) for t in unknown]
    return out


def fit(unknown: list[str], *, rounds: int = 150, ridge: float = 2e-3, seed: int = 21) -> Model:
    rng = np.random.default_rng(seed)
    examples = _examples(unknown, rng)
    vocabulary = sorted({g for ts in TEMPLATES.values() for t in ts for g in ngrams(normal(t))})
    number = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(examples), len(vocabulary) + 1))
    x[:, -1] = 1
    y = np.zeros((len(examples), len(FAMILIES)))
    for r, (ws, label) in enumerate(examples):
        x[r, [number[g] for g in ngrams(ws) if g in number]] = 1
        y[r, label] = 1
    apart = np.arange(len(x)) % 5 == 4
    xt, yt = x[~apart], y[~apart]
    w, m, s = np.zeros((x.shape[1], y.shape[1])), 0.0, 0.0

    def softmax(z):
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    for step in range(1, rounds + 1):
        g = xt.T @ (softmax(xt @ w) - yt) / len(xt) + ridge * np.vstack([w[:-1], np.zeros((1, w.shape[1]))])
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    loss = lambda t: -np.log(np.maximum((softmax(x[apart] @ w / t) * y[apart]).sum(1), 1e-12)).mean()
    w /= min(np.geomspace(0.25, 4, 33), key=loss)
    weights = {g: w[i] for g, i in number.items()}
    return Model(weights, w[-1], _signs(weights, w[-1], unknown))


def paragraphs(documents: DataFrame, signs: list[str] | None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, id, block, paragraph, lines, words, named): the lines numbered from 1, and the paragraphs of several lines,
    numbered by their first line; their words as one string, and whether an anchor is in them. Of each, those with
    a sign or an anchor.

    ``row`` is a number for each row of ``documents``, ``block`` the first line of the paragraph that a line is in.
    """
    any_of = lambda c: _either([c.contains(a) for a in anchors()])
    sign = lambda c: F.exists(F.split(c, " "), lambda w: w.isin(signs)) if signs is not None else F.lit(True)
    # an array of one: as a plain expression the words would be made anew for every test
    told = lambda c: F.exists(F.array(c), lambda w: any_of(w) | sign(w))
    near = documents.select(F.monotonically_increasing_id().alias("row"), id, text).where(told(normal_column(F.col(text))))
    # lines carry their numbers between two control characters; those without a letter or digit are left empty
    plain = F.split(F.translate(text, "\x01\x02", "  "), "\n")
    numbered = F.transform(plain, lambda x, i: F.when(x.rlike(r"[\p{L}\p{N}]"), F.concat(F.lit("\x01"), (i + 1).cast("string"), F.lit("\x02"), x)).otherwise(""))
    blocks = near.select("row", id, F.explode(F.split(F.array_join(numbered, "\n"), "\n\n+")).alias("said")).where(F.col("said").contains("\x01"))
    bare = lambda c: F.regexp_replace(c, "\x01[0-9]+\x02", "")
    number = lambda c: F.regexp_extract(c, "\x01([0-9]+)\x02", 1).cast("int")
    blocks = blocks.select("row", id, number(F.col("said")).alias("block"), F.split(F.trim("said", F.lit("\n")), "\n").alias("said"))
    line = lambda x: F.struct(number(x).alias("paragraph"), F.lit(1).alias("lines"), bare(x).alias("said"))
    joined = F.struct(F.col("block").alias("paragraph"), F.size("said").alias("lines"), F.array_join(
        F.transform("said", lambda x: F.regexp_replace(bare(x), _COMMENT_WORD, " ")), " ").alias("said"))
    # lines and paragraphs in one list, so that documents are read once
    every = F.concat(F.transform("said", line), F.filter(F.array(joined), lambda x: x["lines"] > 1))
    texts = blocks.select("row", id, "block", F.explode(every).alias("of")).select(
        "row", id, "block", "of.paragraph", "of.lines", normal_column(F.col("of.said")).alias("words"))
    return texts.where(told(F.col("words"))).withColumn("named", any_of(F.col("words")))


def _either(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def train(documents: DataFrame, id: str = "doc_id", text: str = "text", seed: int = 13) -> Model:
    """A model with a line of at most TRAIN_PARAGRAPHS documents of the corpus as unknown: documents, lines with a
    letter or digit, and stretches of TRAIN_CHARS characters of long lines are chosen by a seeded hash."""
    place = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), F.lit(seed), id), n.cast("long")).cast("int")
    chosen = documents.where(F.col(text).isNotNull()).join(F.broadcast(seeded_sample(documents.select(id), TRAIN_PARAGRAPHS, seed, id)), id)
    lines = chosen.select(id, F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[\p{L}\p{N}]")).alias("lines")).where(F.size("lines") > 0)
    line = lines.select(id, F.get("lines", place("line", F.size("lines"))).alias("line"))
    few = line.select(F.substring("line", place("at", F.greatest(F.length("line") - TRAIN_CHARS, F.lit(0)) + 1) + 1, F.lit(TRAIN_CHARS)).alias("line")).limit(2 * TRAIN_PARAGRAPHS)
    have = anchors()
    rows = sorted(r["line"] for r in few.collect() if not any(a in " ".join(normal(r["line"])) for a in have))
    return fit(rows)


def scan(documents: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, paragraph, lines, family, probability, template_share, confirmed), for every line that is not unknown or has
    an anchor word, and for paragraphs of several lines (``lines``, from line ``paragraph`` on) that say more than their
    lines do. All lines and paragraphs are judged; those not told are unknown.

    ``family`` is the likeliest class, ``unknown`` among them; ``template_share`` the largest share of a
    template of that family that stands in the line or paragraph (null for unknown), confirmed from CONFIRM on. A
    paragraph is told if it is not unknown and none of its lines is of its family and confirmed if it is.

    Defined cases: null and empty texts have no lines; lines of repeated documents are told for each; a
    null id stays null; other columns are ignored. Equal lines and paragraphs are classified once.
    """
    spark = documents.sparkSession
    found = stage(paragraphs(documents, model.signs, id, text).withColumnRenamed(id, "_id"))
    distinct = found.select(F.md5("words").alias("key"), "words").distinct()
    grams = distinct.select("key", F.explode(ngrams_column(F.split("words", " "))).alias("gram"))
    # as many rows as the templates have n-grams: bounded, so every task gets them
    table = spark.createDataFrame([(g, [float(v) for v in w]) for g, w in model.weights.items()], "gram string, w array<double>")
    sums = grams.join(F.broadcast(table), "gram").groupBy("key").agg(*[F.sum(F.col("w")[i]).alias(f"z{i}") for i in range(len(FAMILIES))])
    z = [F.coalesce(F.col(f"z{i}"), F.lit(0.0)) + float(b) for i, b in enumerate(model.intercept)]
    scored = distinct.select("key", "words").join(sums, "key", "left").select("key", "words", F.array(*z).alias("z"))
    top = F.array_max("z")
    scored = scored.withColumns({
        "family": F.element_at(F.array(*[F.lit(f) for f in FAMILIES]), F.array_position("z", top).cast("int")),
        "probability": 1.0 / F.reduce(F.transform("z", lambda v: F.exp(v - top)), F.lit(0.0), lambda a, b: a + b),
    })
    templates = spark.createDataFrame(
        [(f, sorted(ngrams(normal(t)))) for f, ts in TEMPLATES.items() for t in ts], "family string, template array<string>")
    shares = scored.where(F.col("family") != UNKNOWN).withColumn("own", ngrams_column(F.split("words", " "))).join(F.broadcast(templates), "family").groupBy("key").agg(
        F.max(F.size(F.array_intersect("own", "template")) / F.size("template")).alias("template_share"))
    judged = stage(scored.join(shares, "key", "left").select("key", "family", "probability", "template_share"))
    told = found.withColumn("key", F.md5("words")).drop("words").join(judged, "key", "left").withColumn(
        "confirmed", F.coalesce(F.col("template_share") >= CONFIRM, F.lit(False)))
    single = F.col("lines") == 1
    said = told.where(single).groupBy("row", "block", "family").agg(F.max("confirmed").alias("sure"))
    more = told.where(~single & (F.col("family") != UNKNOWN)).join(said, ["row", "block", "family"], "left").where(
        F.col("sure").isNull() | (F.col("confirmed") & ~F.col("sure"))).drop("sure")
    return told.where(single & (F.col("named") | (F.col("family") != UNKNOWN))).unionByName(more).select(
        F.col("_id").alias(id), "paragraph", "lines", "family", F.round("probability", 6).alias("probability"),
        F.round("template_share", 6).alias("template_share"), "confirmed")
