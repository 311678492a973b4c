"""Licence scans with a trained paragraph classifier; the scan uses DataFrame functions only.

A sparse multinomial logistic regression over words and word pairs (words without meaning of their own count in pairs only),
with a class for text that is no licence or another one, is trained on the driver from the notices below, their fragments,
the same notices with other names put in, and sentences that only sound alike; a temperature fitted on fragments that are
left out calibrates it.

Documents are scanned by paragraph: lines are joined until a blank line or the end of a sentence (a line of an SPDX tag
stands alone), and paragraphs of over `WINDOW` words are cut to windows that overlap by half. Every window with a word of the
model is scored: its words and pairs are joined with the weight table (its size is fixed by the notices) and summed by
family. A window without such words has the unknown class, so leaving it out loses nothing. A prediction counts if its
calibrated probability reaches `threshold`. It is confirmed if the window holds `overlap` of the word pairs of one of the
family's notices, where a pair that several families share counts for less, and none of the pairs that tell the family's near
relatives (another version, ND, SA, -0) apart.

Edge cases: null and empty texts have no paragraphs; ties between families go to the alphabetically first; of two notices in
one window the likelier family is given; repeated rows are scanned each; extra columns pass through scan() unread.
"""

from __future__ import annotations

import math
import random
import re
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checked, cut, literal, table

MAX_BROADCAST = 200_000

# fixed values: usual notices and paragraphs of the licences, and of others that count as unknown
NOTICES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.",
        "Use of this source code is governed by a BSD-style license.",
        "Released under the BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related rights to this work.", "Released into the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
    "GPL-2.0": [
        "This program is free software; you can redistribute it under the terms of the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "GPL-3.0": [
        "This program is free software: you can redistribute it under the terms of the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
        "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.",
        "SPDX-License-Identifier: MIT",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "proprietary": ["All rights reserved. No part of this work may be reproduced without written permission.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited."],
}
UNKNOWN = "unknown"
OTHER = [
    "He passed the test and got his driving license last year.", "The bar lost its license to sell drinks.", "The copyright lawsuit was settled out of court.", "Researchers at MIT released a new study.",
    "The Apache helicopter landed near the village.", "An artist takes license with the facts.", "The pilot license was renewed in version 3 of the form.", "General public opinion on the work was mixed.",
    "Permission to enter was granted by the guard.", "The software was released under great pressure.", "A creative person in the commons room.", "Please renew your fishing license at the office.",
    "The rights of the public are reserved by law.", "Copyright law is taught in the second year.", "The license plate was stolen.", "Free of charge for any person under twelve.",
    "The author has a copy of this book.", "Redistribution of wealth was debated.", "The terms of the contract are public.", "Mozilla announced a new browser version.",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "The software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness.",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "Licensed under the Eclipse Public License, Version 2.0.", "SPDX-License-Identifier: EPL-2.0", "Licensed under the EUPL, Version 1.2 or later.", "Licensed under the European Union Public Licence, version 1.2.", "SPDX-License-Identifier: EUPL-1.2",
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "SPDX-License-Identifier: Zlib", "SPDX-License-Identifier: ISC", "Licensed under the ISC License.",
    "This is free and unencumbered software released into the public domain.", "Licensed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0", "Licensed under the Artistic License 2.0.",
    "The contents of this file are subject to the Common Development and Distribution License, version 1.0.", "This program is free software: you can redistribute it under the terms of the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.", "Licensed under the Open Data Commons Open Database License.", "Licensed under the Academic Free License version 3.0.", "Licensed under the PostgreSQL License.", "Licensed under the Microsoft Public License.",
    "SPDX-License-Identifier: MIT-0", "Licensed under the MIT No Attribution License.", "SPDX-License-Identifier: Apache-1.1", "Licensed under the Apache Software License, Version 1.1.", "SPDX-License-Identifier: MPL-1.1", "SPDX-License-Identifier: GPL-1.0-only",
    "SPDX-License-Identifier: CC-BY-ND-4.0", "SPDX-License-Identifier: CC-BY-NC-ND-4.0", "SPDX-License-Identifier: CC-BY-NC-SA-4.0", "Licensed under CC BY-ND 4.0.", "Licensed under CC BY-NC-ND 4.0.", "Licensed under CC BY-NC-SA 4.0.",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
]
# fixed values: word pairs of each family's near relatives; a window that holds one is no notice of the family
RELATIVES = {
    "Apache-2.0": ["apache 1", "version 1", "license 1"],
    "CC-BY": ["by nc", "by nd", "by sa", "attribution noncommercial", "attribution noderivatives", "attribution noderivs", "attribution sharealike", "non commercial", "share alike", "no derivatives"],
    "CC-BY-NC": ["nc nd", "nc sa", "noncommercial noderivatives", "noncommercial noderivs", "noncommercial sharealike", "share alike", "no derivatives"],
    "CC-BY-SA": ["by nc", "nc sa", "attribution noncommercial", "non commercial"],
    "GPL-2.0": ["gpl 1", "gpl 3", "version 1", "version 3", "gnu lesser", "gnu library", "gnu affero", "agpl 3", "lgpl 2"],
    "GPL-3.0": ["gpl 1", "gpl 2", "version 1", "version 2", "gnu lesser", "gnu library", "gnu affero", "agpl 3", "lgpl 3"],
    "MIT": ["mit 0", "no attribution"],
    "MPL-2.0": ["mpl 1", "license 1", "version 1", "v 1"],
}
STOP = frozenset("a all an and any are as at be but by can do for from had has have he his if in is it its may no not of on or our out shall she so than that the their there this to under was we were which who will with you your".split())
NAMES = frozenset("apache bsd cc cc0 creative commons attribution noncommercial nc sa sharealike gnu gpl lgpl lesser general mit mozilla mpl".split())
# a line end counts behind the end of a sentence, before a blank line, and around the line of an SPDX tag; the rest is tried at line ends only
PARAGRAPH = r"\n(?:(?<=[.!?:;]\n)|(?=\n)|(?=[^\nA-Za-z0-9]*SPDX-License-Identifier:)|(?<=\x00\n))"
WINDOW, STRIDE = 64, 32
THRESHOLD, OVERLAP = 0.7, 0.6


def words_of(text: str) -> list[str]:
    """Lowered words of a paragraph, as word_column() has them."""
    return [x for x in re.split("[^a-z0-9]+", text.lower()) if x]


def grams(words: list[str]) -> list[str]:
    """Distinct words and word pairs, as gram_column() has them."""
    return sorted({*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))})


def windows(words: list[str]) -> list[list[str]]:
    return [words] if len(words) <= WINDOW else [words[i : i + WINDOW] for i in range(0, len(words) - STRIDE, STRIDE)]


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text: blanks before line ends go, and the line of an SPDX tag gets a mark at its end."""
    plain = F.regexp_replace(F.translate(text, "\0", " "), r"[ \t\r]+(?=\n|\z)", "")
    return F.split(F.regexp_replace(plain, r"(SPDX-License-Identifier:[^\n]*)\n", "$1\0\n"), PARAGRAPH)


def word_column(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: x != "")


def pair_column(words: Column) -> Column:
    return F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.size(words)), lambda a, b: F.concat_ws(" ", a, b))


def window_column(words: Column) -> Column:
    starts = F.sequence(F.lit(0), F.size(words) - STRIDE - 1, F.lit(STRIDE))
    return F.when(F.size(words) <= WINDOW, F.array(words)).otherwise(F.transform(starts, lambda i: F.slice(words, i + 1, WINDOW)))


@cache
def model(seed: int = 7, fragments: int = 24, epochs: int = 200, l2: float = 1e-4, least: float = 0.02) -> tuple[tuple[str, ...], dict[str, list[float]], list[float]]:
    """(families, weights of each gram, biases), divided by the calibrating temperature."""
    rng = random.Random(seed)
    families = (*sorted(NOTICES), UNKNOWN)
    last = len(families) - 1
    rows: list[tuple[list[str], int]] = []
    syllables = [a + b for a in "bdfgklmnprstvz" for b in ("a", "e", "i", "o", "u", "an", "er", "il", "or", "us")]

    def name() -> str:
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))

    def parts(words: list[str]) -> list[str]:
        """Words dropped here and there, or a stretch of them, or as they are."""
        kind = rng.random()
        if kind < 0.5:
            return [w for w in words if rng.random() > 0.12]
        if kind < 0.75 and len(words) > 8:
            n = rng.randint(max(5, len(words) // 2), len(words))
            at = rng.randint(0, len(words) - n)
            return words[at : at + n]
        return [name() for _ in range(rng.randint(0, 12))] + words + [name() for _ in range(rng.randint(0, 12))]

    for i, f in enumerate(families[:-1]):
        for text in NOTICES[f]:
            own = words_of(text)
            rows += [(own, i)] * 4 + [(parts(own), i) for _ in range(fragments)]
            if any(w in NAMES for w in own):  # the licence of another name is another licence
                new = lambda: {n: name() for n in NAMES}
                for _ in range(fragments // 2):
                    other = new()
                    rows.append((parts([other.get(w, w) for w in own]), last))
    for text in OTHER:
        own = words_of(text)
        rows += [(own, last)] * 4 + [(parts(own), last) for _ in range(fragments // 2)]
    every = [w for texts in NOTICES.values() for t in texts for w in words_of(t)] + [w for t in OTHER for w in words_of(t)]
    for _ in range(600):  # shuffled words of all notices are no licence
        rows.append((rng.sample(every, rng.randint(1, 12)), last))
    known = set(every)
    rng.shuffle(rows)

    def features(words: list[str]) -> list[str]:
        # stop words count in pairs with others only, so that a text without words of the model has no features at all
        return [g for g in grams(words) if all(x in known for x in g.split(" ")) and not all(x in STOP for x in g.split(" "))]

    rows_f = [(features(r), label) for r, label in rows]
    vocabulary = {g: i for i, g in enumerate(sorted({g for r, _ in rows_f for g in r}))}
    x = np.zeros((len(rows), len(vocabulary) + 1), np.float32)
    x[:, -1] = 1
    for i, (r, _) in enumerate(rows_f):
        x[i, [vocabulary[g] for g in r]] = 1
    y = np.eye(len(families), dtype=np.float32)[[label for _, label in rows]]
    train, test = slice(0, len(rows) * 4 // 5), slice(len(rows) * 4 // 5, None)
    w = np.zeros((x.shape[1], len(families)))
    m, v = np.zeros_like(w), np.zeros_like(w)

    def soft(z):
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    xt = x[train]
    for t in range(1, epochs + 1):
        grad = xt.T @ (soft(xt @ w.astype(np.float32)) - y[train]) / len(xt) + l2 * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    w[:-1][np.abs(w[:-1]).max(1) < least] = 0
    z = x[test] @ w
    heat = min(np.arange(0.5, 4.01, 0.1), key=lambda k: -np.log(np.maximum((soft(z / k) * y[test]).sum(1), 1e-12)).mean())
    w = np.round(w / heat, 6)
    if int(np.argmax(w[-1])) != last:
        raise RuntimeError("text without features must be of the unknown class")
    return families, {g: w[i].tolist() for g, i in vocabulary.items() if w[i].any()}, w[-1].tolist()


@cache
def templates() -> list[tuple[str, dict[str, float]]]:
    """Family and weighted word pairs of each notice; a pair of several families counts for less, all of a notice for 1."""
    pairs = [(f, {g for g in grams(words_of(t)) if " " in g}) for f, texts in NOTICES.items() for t in texts]
    shared = {g: len({f for f, own in pairs if g in own}) for _, have in pairs for g in have}
    return [(f, {g: 1 / shared[g] / sum(1 / shared[x] for x in sorted(own)) for g in sorted(own)}) for f, own in pairs]


def classify(words: list[str]) -> tuple[str, float, float]:
    """Family, probability and template overlap of a window: what scan() computes, in plain Python."""
    families, weights, bias = model()
    own = grams(words)
    z = [b + sum(weights[g][i] for g in own if g in weights) for i, b in enumerate(bias)]
    e = [math.exp(v - max(z)) for v in z]
    best = max(range(len(z)), key=lambda i: (e[i], -i))
    share = max((sum(x for g, x in pairs.items() if g in own) for f, pairs in templates() if f == families[best]), default=0.0)
    return families[best], e[best] / sum(e), share


def scan(docs: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """pos, window, words, family, probability, overlap, confirmed of each window predicted to be a licence, with the other columns of docs.

    pos: number of the paragraph in the document, window: of the window in the paragraph.
    """
    spark = docs.sparkSession
    families, weights, bias = model()
    table_ = F.broadcast(literal(spark, [{"gram": g, "w": w} for g, w in weights.items()], "gram string, w array<double>"))
    cues = sorted({x for g in weights for x in g.split(" ") if x not in STOP})
    own = [c for c in docs.columns if c not in ("text", "pos", "window", "words", "family", "probability", "overlap", "confirmed")]
    found = docs.select(F.struct(*own).alias("own") if own else F.lit(0).alias("own"), F.posexplode(paragraphs(F.col("text"))).alias("pos", "paragraph"))
    found = found.select("own", "pos", word_column(F.col("paragraph")).alias("all")).where(F.exists("all", lambda x: x.isin(cues)))
    found = found.select("own", "pos", F.posexplode(window_column(F.col("all"))).alias("window", "words"))
    h = [F.xxhash64(F.lit(k), "words").alias(f"h{k}") for k in (1, 2)]
    found = cut(found.where(F.exists("words", lambda x: x.isin(cues))).select("own", "pos", "window", "words", *h), "windows")
    # one row for each distinct window: what repeats is classified once
    once = found.groupBy("h1", "h2").agg(F.first("words").alias("words"))
    gram = F.explode(F.array_distinct(F.concat("words", pair_column(F.col("words"))))).alias("gram")
    parts = once.select("h1", "h2", gram).join(table_, "gram")
    sums = parts.groupBy("h1", "h2").agg(*[F.sum(F.col("w")[i]).alias(f"z{i}") for i in range(len(families))])
    z = F.array(*[F.col(f"z{i}") + b for i, b in enumerate(bias)])
    e = F.transform(F.col("z"), lambda x: F.exp(x - F.array_max("z")))
    scored = sums.select("h1", "h2", z.alias("z")).withColumn("e", e)
    names = F.array(*[F.lit(f) for f in families])
    scored = scored.select("h1", "h2", names[F.array_position("e", F.lit(1.0)) - 1].alias("family"), (1 / F.aggregate("e", F.lit(0.0), lambda a, x: a + x)).alias("probability"))
    scored = cut(scored.where((F.col("family") != UNKNOWN) & (F.col("probability") >= threshold)), "scored")
    # template comparison on word pairs
    pairs = [{"family": f, "template": i, "pair": g, "share": x} for i, (f, own_) in enumerate(templates()) for g, x in own_.items()]
    pairs = F.broadcast(literal(spark, pairs, "family string, template int, pair string, share double"))
    # found rows that share a window are equal in words: a distinct window's hot key is one row
    hits = found.join(checked(scored, MAX_BROADCAST), ["h1", "h2"])
    seen = once.join(checked(scored, MAX_BROADCAST), ["h1", "h2"]).select("h1", "h2", "family", F.explode(F.array_distinct(pair_column(F.col("words")))).alias("pair"))
    compared = seen.join(pairs, ["family", "pair"]).groupBy("h1", "h2", "template").agg(F.sum("share").alias("share")).groupBy("h1", "h2").agg(F.max("share").alias("overlap"))
    out = hits.join(checked(cut(compared, "compared"), MAX_BROADCAST), ["h1", "h2"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0.0)))
    relatives = F.create_map(*[F.lit(x) for f, pairs_ in RELATIVES.items() for x in (f, pairs_)])
    other = F.coalesce(F.arrays_overlap(pair_column(F.col("words")), F.try_element_at(relatives, F.col("family"))), F.lit(False))
    return out.select(*[F.col(f"own.{c}").alias(c) for c in own], "pos", "window", "words", "family", "probability", "overlap", ((F.col("overlap") >= overlap) & ~other).alias("confirmed"))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "pos", "window", "family", F.round("probability", 4).alias("probability"), F.round("overlap", 4).alias("overlap"), "confirmed")


QUERIES = {"op8_licences": op8_licences}
ORACLE_SQL: dict[str, str] = {}
