"""License scans: a trained paragraph classifier, confirmed by comparison with templates.

A paragraph is a block of lines, ended by a line without letters and digits (a blank
one, an empty comment); marks of comments are no words, so they don't count. A notice
may also be one line among others, so the lines of a block are scored as well. The
features of a paragraph are word 1-, 2- and 3-grams of the notices below. A
multinomial logistic regression with an L1 penalty is trained on the notices, on
pieces and alterations of them, and on an unknown class: sentences that use the same
words otherwise, and the notices' words in any order. A temperature fitted on
alterations left out of training calibrates the odds. A family found is confirmed
where enough of one of its templates' n-grams are there.

What an n-gram can at most add to any family's odds against the unknown class is one
number, kept to a step above it. A paragraph in which these numbers do not add up to
the lead that the unknown class starts with can't be of a family, so only the others
are scored in full.

Training works on the notices only and ends with a table of bounded size. The
scan over documents is built-in functions, joins and aggregates.
"""

from __future__ import annotations

import json
import random
import re
from collections.abc import Callable, Iterable
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.session import materialise

UNKNOWN = "unknown"
#: Notices by family, as they are published.
NOTICES: dict[str, list[str]] = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "Apache License Version 2.0, January 2004",
        "SPDX-License-Identifier: Apache-2.0",
        "This project is licensed under the Apache 2.0 license.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
        "The MIT License (MIT)",
    ],
    "bsd": [
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License v3.0.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Released under the GPLv3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "lgpl": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Content is available under CC-BY-4.0.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
        "Licensed under CC BY-NC-ND 4.0.",
    ],
    "cc0": [
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released under the Creative Commons Zero license.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Licensed under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "Released under the Unlicense.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright 2020 the company. All rights reserved.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form without the prior written permission of the publisher.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
    ],
}
#: Sentences with the same words that are no notices.
OTHER = [
    "The driver showed his license to the officer and drove on.",
    "She renewed her fishing license at the town hall in spring.",
    "A licensed electrician must inspect the public building every year.",
    "Copyright law in the twentieth century changed with the printing press.",
    "The committee asked permission to publish the general version of the report.",
    "He had reserved a table by the window, and all were seated on time.",
    "The public domain of the king was the forest along the river.",
    "Civil rights and property rights were debated at length.",
    "The warranty on the machine covers parts for two years.",
    "Mit dem Zug fahren wir in die Stadt und zurück.",
    "The GNU project and other software were the subject of the lecture.",
    "Creative people in the commons of the university met for lunch.",
    "Redistribution of income is a question for the general public.",
    "An Apache helicopter landed near the village in the morning.",
    "The free software movement has a long history of distribution.",
    "They agreed in writing to the terms and conditions of the sale.",
    "Its use in source and binary systems of stars is well known.",
    "A copy of the letter was distributed to all persons in the room.",
    "The license of the poet is to bend the rules of grammar.",
    "The version of the story in this work is licensed by memory alone.",
]
#: Words that name a licence and so are not drawn for the unknown class.
NAMES = {"spdx", "apache", "gpl", "lgpl", "agpl", "mpl", "cc0", "unlicense", "isc", "mit", "bsd"}
#: Words that prose and notices share.
PLAIN = ["license", "licensed", "licenses", "copyright", "permission", "warranty", "reserved", "public", "domain", "software", "the", "of", "to", "in", "and", "a", "this", "is", "or", "under", "with"]
#: What stands between words: everything but ASCII letters, digits, and a dot between digits.
BREAKS = "[^a-z0-9.]+|\\.(?![0-9])|(?<![0-9])\\."
#: A version right behind a name is a word of its own: GPLv3, LGPL2.1.
VERSIONED = "(?<![a-z0-9])(gpl|lgpl|agpl|mpl|bsd|apache)(?=v?[0-9])"
LONGEST = 3
#: Templates are known by their n-grams of all words; a smaller share of one than this is no confirmation.
CONFIRMED, LIKELY = 0.5, 0.5


def words_of(text: str) -> list[str]:
    return [w for w in re.split(BREAKS, re.sub(VERSIONED, r"\1 ", text.lower())) if w]


def grams_of(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in range(1, LONGEST + 1) for i in range(len(words) - n + 1)}


def words_column(text: Column) -> Column:
    versions = reduce(Column.__or__, (F.contains(F.lower(text), F.lit(x)) for x in ("gpl", "mpl", "bsd", "apache")))
    split = F.when(versions, F.regexp_replace(F.lower(text), VERSIONED, "$1 ")).otherwise(F.lower(text))
    return F.array_remove(F.split(split, BREAKS), "")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, as the element of an array of one; a plain column would be put in at each use."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def known_words(text: Column, vocabulary: list[str]) -> Column:
    """The words of a text in order, with one null for each run of others."""
    words = F.transform(words_column(text), lambda w: F.when(w.isin(vocabulary), w))
    return let(words, lambda words: F.filter(words, lambda w, i: w.isNotNull() | ((i > 0) & F.get(words, i - 1).isNotNull())))


def grams_column(words: Column, known: list[str]) -> Column:
    """The distinct n-grams of an array of words that are among those ``known``; a null word is in none."""

    def of(words: Column, n: int) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).isNotNull() & F.get(words, i + n - 1).isNotNull())
        return F.transform(starts, lambda i: F.concat(*(x for k in range(n) for x in (F.lit(" "), F.get(words, i + k))[k == 0 :])))

    def every(words: Column) -> Column:
        return F.array_distinct(F.filter(F.concat(words, *(of(words, n) for n in range(2, LONGEST + 1))), lambda g: g.isin(known)))

    return let(words, lambda words: F.when(F.exists(words, lambda w: w.isNotNull()), every(words)).otherwise(F.array().cast("array<string>")))


def alterations(text: str, rng: random.Random, n: int) -> list[list[str]]:
    """Words dropped and strange, the first or last part, or in the middle of others."""
    words, out = words_of(text), []
    strange = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8)))
    for _ in range(n):
        own = [w if rng.random() > 0.08 else strange() for w in words if rng.random() > 0.06]
        if len(own) > 8 and rng.random() < 0.3:
            cut = rng.randint(6, len(own))
            own = own[:cut] if rng.random() < 0.5 else own[-cut:]
        if rng.random() < 0.5:
            own = [strange() for _ in range(rng.randint(0, 6))] + own + [strange() for _ in range(rng.randint(0, 6))]
        out.append(own)
    return out


@lru_cache(maxsize=2)
def trained(penalty: float = 1e-4, seed: int = 13) -> tuple[list[str], list[str], np.ndarray, np.ndarray, float]:
    """Families (unknown last), grams, weights (grams x families), biases and temperature, from the notices alone."""
    rng = random.Random(seed)
    families = [*NOTICES, UNKNOWN]
    grams = sorted({g for texts in NOTICES.values() for t in texts for g in grams_of(words_of(t))})
    index = {g: i for i, g in enumerate(grams)}
    examples, held = [], []
    for k, family in enumerate(families):
        for text in NOTICES.get(family, OTHER):
            some = [words_of(text)] * 6 + alterations(text, rng, 40)
            examples += [(w, k) for w in some]
            held += [(w, k) for w in alterations(text, rng, 8)]
    unknown = len(families) - 1
    texts = [words_of(t) for own in NOTICES.values() for t in own]
    every = sorted({x for t in texts for x in t} - NAMES)
    for some in (examples, held):  # the words in any order, and the words of prose between others, say nothing
        some += [([rng.choice(every) for _ in range(rng.randint(1, 60))], unknown) for _ in range(600)]
        some += [(rng.sample([w for w in t if w not in NAMES], k=len([w for w in t if w not in NAMES])), unknown) for t in texts for _ in range(3)]
        some += [([w], unknown) for w in PLAIN for _ in range(2)] + [([], unknown)] * 60

    def matrix(some):
        x = np.zeros((len(some), len(grams)), np.float32)
        for i, (words, _) in enumerate(some):
            x[i, [index[g] for g in grams_of(words) if g in index]] = 1
        return x, np.eye(len(families), dtype=np.float32)[[k for _, k in some]]

    x, y = matrix(examples)
    w, b = np.zeros((len(grams), len(families)), np.float32), np.zeros(len(families), np.float32)
    ahead_w, ahead_b, t = w, b, 1.0
    step = 4.0 / (1 + x.sum(1).mean())

    def shares(z):
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    for _ in range(300):  # proximal gradient with momentum
        gap = (shares(x @ ahead_w + ahead_b) - y) / len(x)
        new_w, new_b = ahead_w - step * (x.T @ gap), ahead_b - step * gap.sum(0)
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - step * penalty, 0)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead_w, ahead_b = new_w + (t - 1) / nt * (new_w - w), new_b + (t - 1) / nt * (new_b - b)
        w, b, t = new_w, new_b, nt
    hx, hy = matrix(held)
    z = hx @ w + b
    losses = {s: -np.log(np.maximum((shares(z / s) * hy).sum(1), 1e-9)).mean() for s in np.geomspace(0.2, 5, 40)}
    return families, grams, w, b, float(min(losses, key=losses.get))


def _table(spark: SparkSession, schema: str, rows: Iterable[tuple]) -> DataFrame:
    """A table of the values given, as part of the plan."""
    names = [c.split()[0] for c in schema.split(", ")]
    text = json.dumps([dict(zip(names, r)) for r in rows])
    one = ", ".join(f"{c.split()[0]}: {c.split()[1]}" for c in schema.split(", "))
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{one}>>")))


@lru_cache(maxsize=2)
def _model_rows() -> tuple[list[tuple], list[tuple]]:
    """``(gram, weights, templates)`` of what the scan looks up, and ``(template, family, size)``; all of the notices."""
    _, grams, weights, _, _ = trained()
    templates = [(f, sorted(grams_of(words_of(t)))) for f, texts in NOTICES.items() for t in texts]
    rows = {g: (g, [float(v) for v in weights[i]], []) for i, g in enumerate(grams)}
    for n, (_, own) in enumerate(templates):
        for g in own:
            rows[g][2].append(n)
    return list(rows.values()), [(n, f, len(own)) for n, (f, own) in enumerate(templates)]


#: Steps in which the most that an n-gram adds is kept.
STEP = 0.25


@lru_cache(maxsize=2)
def bounds() -> tuple[dict[float, list[str]], float]:
    """The n-grams by the most that each adds to a family's odds against the unknown class, a step above it at most; and that class's lead."""
    _, grams, weights, biases, _ = trained()
    most = (weights[:, :-1].astype(float) - weights[:, -1:]).max(1)
    by: dict[float, list[str]] = {}
    for g, m in zip(grams, most):
        by.setdefault(float(np.ceil(m / STEP + 1e-6) * STEP), []).append(g)
    return by, float((biases[-1].astype(float) - biases[:-1]).min())


def may_be_notice(grams: Column) -> Column:
    by, lead = bounds()

    def adds(g: Column) -> Column:
        cases = F
        for most, own in sorted(by.items(), key=lambda x: -len(x[1])):
            cases = cases.when(g.isin(own), F.lit(most))
        return cases.otherwise(F.lit(0.0))

    return F.aggregate(grams, F.lit(0.0), lambda total, g: total + adds(g)) >= lead - 1e-3


def units(docs: DataFrame, known: list[str]) -> DataFrame:
    """``(doc_id, doc, first, last, grams)``: the blocks of a document's lines, and the lines of blocks that have several; ``doc`` is the row.

    ``first`` and ``last`` count lines from 0, ``grams`` are those ``known``. Lines
    without letters and digits are in no unit; units that can't be of a family are
    left out.
    """
    vocabulary = sorted({w for g in known for w in g.split()})

    def unit(first: Column, n: Column, words: Column) -> Column:
        return F.struct(first.alias("first"), (first + n - 1).alias("last"), grams_column(words, known).alias("grams"))

    def block(words: Column, first: Column, n: Column) -> Column:
        each = lambda own: F.transform(own, lambda w, i: unit(first + i, F.lit(1), w))
        return let(F.slice(words, first + 1, n), lambda own: F.when(n > 1, F.array_append(each(own), unit(first, n, F.flatten(own)))).otherwise(each(own)))

    def blocks(lines: Column, words: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: ~F.get(lines, i).rlike("[\\p{L}\\p{N}]"))
        edges = F.concat(F.array(F.lit(-1)), ends, F.array(F.size(lines)))
        return let(edges, lambda e: F.flatten(F.transform(F.sequence(F.lit(0), F.size(e) - 2), lambda k: block(words, F.get(e, k) + 1, F.get(e, k + 1) - F.get(e, k) - 1))))

    every = let(F.split("text", "\n", -1), lambda lines: let(F.transform(lines, lambda x: known_words(x, vocabulary)), lambda words: blocks(lines, words)))
    # what is left out goes within the generator: a filter behind it would work all of this out a second time
    some = docs.select("doc_id", "text").where("text is not null").withColumn("doc", F.monotonically_increasing_id())
    out = some.select("doc_id", "doc", F.explode(F.filter(every, lambda u: may_be_notice(u["grams"]))).alias("u"))
    return out.select("doc_id", "doc", "u.first", "u.last", "u.grams")


def scan(docs: DataFrame, likely: float = LIKELY, confirmed: float = CONFIRMED) -> DataFrame:
    """Notices in ``docs (doc_id, text)``: ``doc_id, paragraph, lines, family, probability, similarity, confirmed``.

    ``paragraph`` is its first line, counted from 0, and ``lines`` how many it has:
    a block, or one line of a block. ``family`` is the likeliest if its calibrated
    ``probability`` is ``likely`` or more; paragraphs of the unknown class give no
    row. ``similarity`` is the greatest share of the n-grams of one of the family's
    templates that the paragraph holds, and ``confirmed`` whether it reaches
    ``confirmed``. Of a block and its lines with one family the lines stay where
    any of them is confirmed or the block isn't, else the block does. Null and
    empty texts give no row. Null ids stay; repeated rows each give their rows;
    other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    families, _, _, biases, temperature = trained()
    rows, templates = _model_rows()
    # the tables are made of the notices and as small as these
    of = [F.lit(f) for f in families]
    found = units(docs, [r[0] for r in rows])
    found = materialise(found.withColumn("row_id", F.monotonically_increasing_id()), "license-paragraphs")
    model = F.broadcast(_table(spark, "gram string, weights array<double>, templates array<int>", rows))
    sizes = F.broadcast(_table(spark, "template int, of string, size int", templates))
    hits = found.select("row_id", F.explode("grams").alias("gram")).join(model, "gram")
    sums = hits.groupBy("row_id").agg(*(F.coalesce(F.sum(F.get("weights", F.lit(k))), F.lit(0.0)).alias(f"z{k}") for k in range(len(families))))
    z = F.array(*((F.col(f"z{k}") + float(b)) / temperature for k, b in enumerate(biases)))
    scored = sums.select("row_id", z.alias("z")).withColumn("top", F.array_max("z"))
    total = F.aggregate(F.transform("z", lambda v: F.exp(v - F.col("top"))), F.lit(0.0), lambda a, v: a + v)
    best = F.get(F.array(*of), (F.array_position("z", F.col("top")) - 1).cast("int"))
    scored = scored.select("row_id", (1 / total).alias("probability"), best.alias("family")).where((F.col("probability") >= likely) & (F.col("family") != UNKNOWN))
    shared = hits.join(scored, "row_id").select("row_id", "family", F.explode("templates").alias("template")).groupBy("row_id", "family", "template").agg(F.count("*").alias("n"))
    shared = shared.join(sizes, "template").where("of = family").groupBy("row_id").agg(F.max(F.col("n") / F.col("size")).alias("similarity"))
    similarity = F.coalesce("similarity", F.lit(0.0))
    out = found.drop("grams").join(scored, "row_id").join(shared, "row_id", "left").select("doc_id", "doc", "first", "last", "family", "probability", similarity.alias("similarity"), (similarity >= confirmed).alias("confirmed"))
    out = materialise(out, "license-notices")
    one, blocks = out.where("first = last").alias("l"), out.where("first < last").alias("b")
    inside = (F.col("b.doc") == F.col("l.doc")) & (F.col("b.family") == F.col("l.family")) & F.col("l.first").between(F.col("b.first"), F.col("b.last"))
    # a block stays where no line says the same as well; lines stay unless their block does
    kept = blocks.where("confirmed").join(one.where("confirmed"), inside, "left_anti")
    rest = one.where("confirmed").unionByName(one.where("not confirmed").alias("l").join(kept.alias("b"), inside, "left_anti"))
    loose = blocks.where("not confirmed").join(one, inside, "left_anti")
    every = kept.unionByName(rest).unionByName(loose)
    return every.select("doc_id", F.col("first").cast("long").alias("paragraph"), (F.col("last") - F.col("first") + 1).cast("long").alias("lines"), "family", "probability", "similarity", "confirmed")
