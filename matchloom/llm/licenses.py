"""Licence scan: a trained paragraph classifier, with template comparison of what it finds.

A document is cut into paragraphs at blank lines. Units of a paragraph are its lines and, with line breaks as spaces, the
paragraph itself, so that notices are found whether they are wrapped or stand on a line among others; a unit
of over ``WINDOW`` words is read in windows that overlap by half. A unit's word 1- to 3-grams are looked up in
the sparse weights of a multinomial logistic regression with a class for each licence family and one for
*unknown*; their sum, over the root of their number, is the unit's score. The unknown class is calibrated: a temperature is fitted
on ``HELD_OUT``, which nothing is trained on, and a family needs at least ``least`` calibrated probability. A family that
is predicted is confirmed if the unit's grams cover at least ``overlap`` of one of the family's templates.

Units without any of the ``keywords()`` are left out, which loses no confirmed family: the words are chosen so
that a text without them covers less than ``OVERLAP`` of every template.

The regression is fitted on the driver from the fixed texts below, whatever the size of the
documents, and its weights are literals of the query. The scan itself is
DataFrame functions with no join and no shuffle.

Defined results: a null or empty text has no licence; a paragraph counts once for each family that it is
confirmed for, and paragraphs that repeat count each time; families come in alphabetical order; of classes with equal
scores the first in that order wins; a very long text has only windows in memory besides itself; repeated rows and null ids
are judged one by one; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from matchloom.llm.pii import let

UNKNOWN = "unknown"
WINDOW = 512
OVERLAP = 0.6
SLOTS = 256
# Notices by family, each a paragraph as it is found in files.
GNU = "This program is free software{c} you can redistribute it and/or modify it under the terms of the GNU {x}General Public License as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version."
GNU_WARRANTY = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {x}General Public License for more details."
GNU_COPY = "You should have received a copy of the GNU {x}General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
CC = "This work is licensed under a Creative Commons {x} {v} International License."
BSD_CONDITIONS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
TEMPLATES = {
    "agpl": (
        GNU.format(c=":", x="Affero ", v="3"), GNU_WARRANTY.format(x="Affero "), GNU_COPY.format(x="Affero "),
        "Licensed under the GNU Affero General Public License, version 3.", "GNU Affero General Public License v3.0", "GNU AGPL v3", "Released under AGPLv3.", "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed under the Apache License, Version 2.0.", "Released under the Apache License 2.0.", "Released under Apache 2.0.", "This project is licensed under the terms of the Apache 2.0 license.", "Apache License Version 2.0, January 2004", "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        BSD_CONDITIONS,
        BSD_CONDITIONS + " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "Released under the BSD License.", "Licensed under the BSD 3-Clause License.", "Licensed under the BSD 2-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "cc-by": (CC.format(x="Attribution", v="4.0"), "Licensed under CC BY 4.0.", "Released under CC BY 4.0.", "This work is licensed under the Creative Commons Attribution License, version 4.0.", "SPDX-License-Identifier: CC-BY-4.0"),
    "cc-by-nc": (CC.format(x="Attribution-NonCommercial", v="4.0"), "Licensed under CC BY-NC 4.0.", "Released under CC BY-NC 4.0.", "This work is licensed under the Creative Commons Attribution NonCommercial License.", CC.format(x="Attribution-NonCommercial-ShareAlike", v="4.0"), "Licensed under CC BY-NC-SA 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "cc-by-nd": (CC.format(x="Attribution-NoDerivatives", v="4.0"), "Licensed under CC BY-ND 4.0.", "Released under CC BY-ND 4.0.", "This work is licensed under the Creative Commons Attribution NoDerivatives License.", "SPDX-License-Identifier: CC-BY-ND-4.0"),
    "cc-by-sa": (CC.format(x="Attribution-ShareAlike", v="4.0"), "Licensed under CC BY-SA 4.0.", "Released under CC BY-SA 4.0.", "Text is available under the Creative Commons Attribution ShareAlike License.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "gpl": (
        GNU.format(c=":", x="", v="3"), GNU.format(c=";", x="", v="2"), GNU_WARRANTY.format(x=""), GNU_COPY.format(x=""),
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 2.", "GNU General Public License v3.0", "Released under the GNU GPL v3.", "Released under GPLv3.", "GPLv2+", "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Released under the ISC License.", "Licensed under the ISC License.", "SPDX-License-Identifier: ISC"),
    "lgpl": (
        GNU.format(c=":", x="Lesser ", v="3").replace("program", "library"), GNU.format(c=";", x="Lesser ", v="2.1").replace("program", "library"), GNU_WARRANTY.format(x="Lesser ").replace("program", "library"), GNU_COPY.format(x="Lesser ").replace("program", "library"),
        "Licensed under the GNU Lesser General Public License, version 3.", "GNU Lesser General Public License v2.1", "GNU LGPL v2.1", "GNU LGPL v3", "Released under LGPLv3.", "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license.", "The MIT License (MIT)", "SPDX-License-Identifier: MIT",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.", "Released under the MPL 2.0.", "Mozilla Public License Version 2.0", "SPDX-License-Identifier: MPL-2.0",
    ),
    "public-domain": (
        "This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "Placed in the public domain.", "Dedicated to the public domain under CC0 1.0.", "Released under CC0 1.0 Universal Public Domain Dedication.", "SPDX-License-Identifier: CC0-1.0",
    ),
    "reserved": ("All rights reserved.", "Copyright 2020 Example Corp. All rights reserved.", "Copyright (c) 2019 the authors. All rights reserved.", "No part of this publication may be reproduced without the prior written permission of the publisher.", "Proprietary and confidential. All rights reserved."),
}
# Sentences that use the words and name no licence.
OTHERS = (
    "A driving licence was found on the bench near the station.",
    "The officer asked for the license plate of the car.",
    "You need permission from your parents to go on the trip.",
    "The apache helicopter landed at dusk.",
    "She studied at MIT before she moved to Oxford.",
    "Poetic license let the author change the ending.",
    "The debate about copyright goes on in public.",
    "The general public was admitted free of charge.",
    "The commons was open to all villagers.",
    "The hunting license must be renewed every year under the new law.",
    "Version 2.0 of the game was released in May.",
    "He was licensed as a pilot in 1998.",
    "The public domain name market is large.",
    "The fishing permit is granted by the town.",
    "Rights were reserved for members of the club.",
    "Work on the bridge was released to a new contractor.",
    "Free software is a matter of liberty, wrote the author of the book on the history of code.",
    "The software is provided to schools in the city, and the warranty covers all parts for two years.",
    "This program was made for children and it is shown on television in the evening.",
    "You should have received a copy of the letter that we sent to the office of the mayor.",
    "The library is open from nine to five; see the notice at the door for more details.",
    "Any person who wants to use the pool may obtain a card at the desk.",
    "The names of the contributors are on the last page of the report.",
    "The foundation published a new version of its map.",
)
# Words that are taken as keywords first, and words that say little in some language, taken last.
TELLING = frozenset("affero agpl agplv3 copyright creative gnu gpl gplv2 gplv3 lesser lgpl lgplv3 licence license licensed licenses mozilla mpl redistribute redistribution redistributions spdx unencumbered warranties warranty".split())
COMMON = frozenset("a above all along an and any are as at be but by can charge copy do either even file files fee for free from general have if in included including into is it its later may more must neither no nor not obtain of one option or other part parts permit person place provided public see should so subject than that the their then this to under up use used this those version was were what which who will with without work works you your mit met list form forms code sell met do deal into is style holder shall released portions program hope copy office name names any distribute".split())
# What the temperature is fitted on and nothing else, by family.
HELD_OUT = {
    "agpl": ("The code is under the GNU Affero General Public License version 3 or later.",),
    "apache": ("Distributed under the Apache License, version 2.0; see the file LICENSE.",),
    "bsd": ("This code is distributed under a 3-clause BSD license.",),
    "cc-by": ("Content is available under a Creative Commons Attribution 4.0 license.",),
    "cc-by-nc": ("Photos are shared under the Creative Commons Attribution-NonCommercial 4.0 license.",),
    "cc-by-nd": ("The essay is under a Creative Commons Attribution-NoDerivatives 4.0 license.",),
    "cc-by-sa": ("The article is under the Creative Commons Attribution-ShareAlike 4.0 license.",),
    "gpl": ("You can copy it under the terms of the GNU General Public License version 2 or later.",),
    "isc": ("Use it under the terms of the ISC license.",),
    "lgpl": ("This library is under the GNU Lesser General Public License version 2.1 or later.",),
    "mit": ("It is open source software under the MIT license.",),
    "mpl": ("Its source code is under the Mozilla Public License 2.0.",),
    "public-domain": ("The text was placed in the public domain by its author.",),
    "reserved": ("Copyright 2014 by the publisher, all rights reserved.",),
    UNKNOWN: (
        "The license of the restaurant was taken away by the city.",
        "The public asked the commons for a free vote.",
        "She asked for permission to modify the old house.",
        "Copies of the paper were sold at the station without a fee.",
        "The version of the story that he told is in the public record.",
        "The copyright office moved to a new building.",
    ),
}


def tokens(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def grams(words: list[str]) -> list[str]:
    return [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def template_grams() -> list[tuple[str, list[str]]]:
    """(family, distinct grams) of every template."""
    return [(c, sorted(set(grams(tokens(t))))) for c in sorted(TEMPLATES) for t in TEMPLATES[c]]


def keywords(overlap: float = OVERLAP) -> list[str]:
    """Words of which a text needs one to cover ``overlap`` of any template.

    Of each template its rarest words over all texts above, one after the other, until the grams without
    any of the words chosen so far are too few.
    """
    seen = Counter(w for t in OTHERS + HELD_OUT[UNKNOWN] for w in set(tokens(t)))
    used = Counter(w for ts in TEMPLATES.values() for t in ts for w in set(tokens(t)))
    chosen: set[str] = set()
    for _, gs in template_grams():
        left = sorted({w for g in gs for w in g.split()} - chosen, key=lambda w: (w in COMMON, w not in TELLING, len(w) == 1 or w.isdigit(), seen[w], -used[w], w))
        while sum(not chosen & set(g.split()) for g in gs) >= overlap * len(gs) - 1e-9:
            chosen.add(left.pop(0))
    return sorted(chosen)


@dataclass(frozen=True)
class LicenceModel:
    classes: tuple[str, ...]  # the last is unknown
    weights: dict[str, tuple[float, ...]]
    bias: tuple[float, ...]
    temperature: float


def train(epochs: int = 400, rate: float = 2.0, decay: float = 2e-4) -> LicenceModel:
    """Gradient descent on the templates and the sentences without licence; the temperature on what is held out."""
    classes = (*sorted(TEMPLATES), UNKNOWN)
    rows = [(t, k) for k, c in enumerate(classes[:-1]) for t in TEMPLATES[c]] + [(t, len(classes) - 1) for t in (*OTHERS, "")]
    vocabulary = sorted({g for t, _ in rows for g in grams(tokens(t))})
    at = {g: i for i, g in enumerate(vocabulary)}

    def matrix(texts: list[str]) -> np.ndarray:
        x = np.zeros((len(texts), len(vocabulary)))
        for i, t in enumerate(texts):
            found = [at[g] for g in set(grams(tokens(t))) if g in at]
            x[i, found] = 1 / math.sqrt(max(1, len(found)))
        return x

    def softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    x, y = matrix([t for t, _ in rows]), np.eye(len(classes))[[k for _, k in rows]]
    share = 1 / (len(classes) * y.sum(0))[[k for _, k in rows]]  # families weigh alike
    w, b = np.zeros((len(vocabulary), len(classes))), np.zeros(len(classes))
    for _ in range(epochs):
        d = (softmax(x @ w + b) - y) * share[:, None]
        w -= rate * len(classes) * (x.T @ d + decay * w)
        b -= rate * 0.1 * len(classes) * d.sum(0)
    w, b = np.round(w, 4), np.round(b, 4)
    held = [(t, classes.index(c)) for c in sorted(HELD_OUT) for t in HELD_OUT[c]]
    z, k = matrix([t for t, _ in held]) @ w + b, [k for _, k in held]
    loss = lambda s: -np.log(softmax(z / s)[np.arange(len(k)), k] + 1e-12).sum()
    temperature = min((0.1 * 1.2**i for i in range(24)), key=loss)
    return LicenceModel(classes, {g: tuple(w[i].tolist()) for g, i in at.items()}, tuple(b.tolist()), round(float(temperature), 6))


def slot(gram: str) -> int:
    """crc32 of a gram, modulo SLOTS."""
    import zlib

    return zlib.crc32(gram.encode()) % SLOTS


def _lookup(model: LicenceModel) -> Column:
    """array<map<gram, weights>>: a map is searched from its start, so grams are dealt to SLOTS short ones."""
    slots: list[list[str]] = [[] for _ in range(SLOTS)]
    for g, w in sorted(model.weights.items()):
        slots[slot(g)].append(f'"{g}":[{",".join(map(str, w))}]')
    return F.from_json(F.lit("[" + ",".join("{" + ",".join(s) + "}" for s in slots) + "]"), "array<map<string,array<double>>>")


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def unit_licence(words: Column, model: LicenceModel, least: float = 0.5, overlap: float = OVERLAP) -> Column:
    """struct(family, confirmed) of a unit's words."""

    def found(ws: Column) -> Column:
        def of(k: int) -> Column:
            places = F.sequence(F.lit(1), F.size(ws) - (k - 1))
            return F.when(F.size(ws) >= k, F.transform(places, lambda i: F.array_join(F.slice(ws, i, F.lit(k)), " "))).otherwise(F.expr("CAST(array() AS array<string>)"))

        return F.array_distinct(F.concat(of(1), of(2), of(3)))

    def judged(gs: Column) -> Column:
        weights = F.filter(F.transform(gs, lambda g: F.element_at(F.element_at(_lookup(model), (F.crc32(g.cast("binary")) % SLOTS + 1).cast("int")), g)), lambda w: w.isNotNull())

        def scored(ws: Column) -> Column:
            zero = F.array(*[F.lit(0.0)] * len(model.classes))
            total = F.aggregate(ws, zero, lambda a, w: F.zip_with(a, w, lambda x, y: x + y))
            scale = F.lit(1.0) / F.sqrt(F.greatest(F.size(ws), F.lit(1)))
            return F.zip_with(total, F.array(*map(F.lit, model.bias)), lambda t, b: (t * scale + b) / model.temperature)

        def chosen(z: Column) -> Column:
            top = F.array_max(z)
            p = F.lit(1.0) / F.aggregate(z, F.lit(0.0), lambda a, v: a + F.exp(v - top))
            return F.when(p >= least, F.element_at(_strings(list(model.classes)), F.array_position(z, top).cast("int"))).otherwise(F.lit(UNKNOWN))

        def confirmed(c: Column) -> Column:
            templates = F.array(*[F.struct(F.lit(f).alias("family"), _strings(t).alias("grams")) for f, t in template_grams()])
            same = F.exists(templates, lambda t: (t["family"] == c) & (F.size(F.array_intersect(t["grams"], gs)) >= overlap * F.size(t["grams"]) - 1e-9))
            return F.struct(c.alias("family"), same.alias("confirmed"))

        return let(let(let(weights, scored), chosen), confirmed)

    return let(let(words, found), judged)


BREAK = r"(?:\r\n|\r|\n)"
BLANK = BREAK + r"[ \t]*+(?:" + BREAK + r"[ \t]*+)+"
NO_WORDS = "CAST(array() AS array<array<string>>)"


def units(paragraph: Column, held: list[str], pattern: str) -> Column:
    """array<array<string>>: the words of lines and of the whole, in windows, where they hold a keyword."""
    words = lambda t: F.regexp_extract_all(t, F.lit("[a-z0-9]+"), F.lit(0))

    def windows(ws: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(1), F.size(ws), F.lit(WINDOW // 2)), lambda i: F.slice(ws, i, F.lit(WINDOW)))
        return F.when(F.size(ws) <= WINDOW, F.array(ws)).otherwise(parts)

    lines = F.filter(F.split(paragraph, BREAK), lambda t: t.rlike(pattern))
    of_lines = F.flatten(F.transform(lines, lambda t: let(words(t), windows)))
    whole = F.when(paragraph.rlike(BREAK), let(words(paragraph), windows)).otherwise(F.expr(NO_WORDS))
    return F.filter(F.concat(of_lines, whole), lambda u: F.arrays_overlap(u, _strings(held)))


def scan(docs: DataFrame, model: LicenceModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_candidates, families, n_confirmed, n_unconfirmed, n_unknown) for every row, of paragraphs with a keyword.

    families: the confirmed ones and in how many paragraphs, as ``name:count`` joined by commas.
    """
    model = model or train()
    held = keywords()
    pattern = "(?<![a-z0-9])(?:" + "|".join(held) + ")(?![a-z0-9])"
    text = F.lower(F.col(text_col).cast("string"))
    none = "CAST(array() AS array<array<struct<family:string,confirmed:boolean>>>)"
    paragraphs = F.filter(F.split(text, BLANK), lambda p: p.rlike(pattern))
    judged = F.when(text.rlike(pattern), F.transform(paragraphs, lambda p: F.array_distinct(F.transform(units(p, held, pattern), lambda u: unit_licence(u, model)))))
    found = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(judged, F.expr(none)).alias("found"))
    sure = F.flatten(F.transform("found", lambda p: F.array_distinct(F.transform(F.filter(p, lambda u: u["confirmed"]), lambda u: u["family"]))))
    out = found.withColumn("sure", sure)
    count = F.transform(F.array_sort(F.array_distinct("sure")), lambda f: F.concat_ws(":", f, F.size(F.filter("sure", lambda x: x == f))))
    confirmed = F.size(F.filter("found", lambda p: F.exists(p, lambda u: u["confirmed"])))
    unknown = F.size(F.filter("found", lambda p: F.forall(p, lambda u: u["family"] == UNKNOWN)))
    return out.select("doc_id", F.size("found").cast("long").alias("n_candidates"), F.array_join(count, ",").alias("families"), confirmed.cast("long").alias("n_confirmed"), (F.size("found") - confirmed - unknown).cast("long").alias("n_unconfirmed"), unknown.cast("long").alias("n_unknown"))
