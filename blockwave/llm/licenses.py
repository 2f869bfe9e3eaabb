"""Licence scans by a trained paragraph classifier, in DataFrame functions only.

A multinomial logistic regression over the words and word pairs of a paragraph (present or not)
tells the licence families and plain text apart. It is trained here, at the driver, on variants of
the families' notices; scoring is native expressions over literal weights, without a shuffle. A
family's threshold is calibrated on held-out variants and on notices of other licences; a predicted
family has to be confirmed by the share of one of its templates' word pairs in the paragraph.
Paragraphs that look like a licence but aren't confirmed are of the class ``unknown``.

Each line is classified, and so is each paragraph between blank lines as one text, as notices are
usually wrapped. Lines that hold a template by themselves take no part in the joined text.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCH = 0.6  # of a template's word pairs
WRAPPED = 0.8  # the same for the joined lines of a paragraph, which hold more pairs by chance
SEED = 11
NONE, UNKNOWN = "none", "unknown"
#: Usual notices of the families.
TEMPLATES = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License", "Apache License Version 2.0, January 2004", "SPDX-License-Identifier: Apache-2.0"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, either version 3 of the License", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "SPDX-License-Identifier: GPL-3.0-or-later"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "you can redistribute it and/or modify it under the terms of the GNU General Public License; either version 2 of the License", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "SPDX-License-Identifier: GPL-2.0-only"),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "SPDX-License-Identifier: AGPL-3.0-or-later", "SPDX-License-Identifier: AGPL-3.0-only"),
    "LGPL": ("This library is licensed under the GNU Lesser General Public License.", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    "BSD": ("Released under the BSD 3-Clause License.", "Licensed under the BSD license", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "SPDX-License-Identifier: BSD-3-Clause"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0", "Mozilla Public License Version 2.0", "SPDX-License-Identifier: MPL-2.0"),
    "EPL-2.0": ("Licensed under the Eclipse Public License 2.0.", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "Eclipse Public License - v 2.0", "SPDX-License-Identifier: EPL-2.0"),
    "ISC": ("Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "SPDX-License-Identifier: ISC"),
    "Zlib": ("Distributed under the terms of the zlib license.", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely", "SPDX-License-Identifier: Zlib"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "Public-Domain": ("Released into the public domain under CC0 1.0.", "This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: CC0-1.0"),
}
#: Notices that belong to no family, and sentences that only use such words.
OTHERS = ("Licensed under the Example Corp Commercial License, version 7.", "All rights reserved under a proprietary license agreement.", "Use of this product is subject to the end user license agreement", "Licensed under the Artistic License 2.0", "Released under the Boost Software License, Version 1.0.", "Licensed under the European Union Public Licence", "This work is licensed under the Open Database License.", "This software is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.", "This software is the confidential and proprietary information of the company and may be used only in accordance with the terms of the license agreement.", "The software is licensed, not sold, and may not be redistributed without prior written permission.", "This Font Software is licensed under the SIL Open Font License, Version 1.1.", "The contents of this file are subject to the terms of the Common Development and Distribution License.", "Licensed under the Eclipse Public License 1.0.", "This library is free software under the terms of the GNU Library General Public License.", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License", "SPDX-License-Identifier: Artistic-2.0", "SPDX-License-Identifier: BSL-1.0", "SPDX-License-Identifier: CDDL-1.0", "SPDX-License-Identifier: EUPL-1.2", "SPDX-License-Identifier: OFL-1.1", "SPDX-License-Identifier: LicenseRef-Proprietary")
PLAIN = ("He lost his driver license in the city.", "The public library has a new general manager.", "This work was done in version 3 of the plan.", "The commons is open to the public.", "A copy of the software was free of charge for the team.", "The foundation published a general report.", "They modify the source in binary form.", "Conditions were met without modification to the plan.", "The domain of the function is free.", "An international attribution error", "the following conditions", "under the version", "this work")
STOP = frozenset("a all an and any are as at be by can either except following for from has hereby if in into is it its may new not of on only or open person that the they this to use user was were with without you your".split())


def words(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def telling(word: str) -> bool:
    return word not in STOP and len(word) > 1 and not word.isdigit()


def grams(text: str) -> set[str]:
    """Words that tell something, and word pairs that hold one."""
    w = words(text)
    return {x for x in w if telling(x)} | {f"{a} {b}" for a, b in zip(w, w[1:]) if telling(a) or telling(b)}


class Model:
    """Weights by n-gram and class, and each family's threshold."""

    def __init__(self, seed: int = SEED):
        r = random.Random(seed)
        self.classes = [*TEMPLATES, UNKNOWN, NONE]
        noise = [random.Random(k).choice("bcdfglmnprst") + "".join(random.Random(k * 7 + j).choice("aeioubdlmnrst") for j in range(5)) for k in range(200)]

        def vary(text: str) -> set[str]:
            w = words(text)
            if len(w) > 6 and r.random() < 0.5:
                del w[r.randrange(len(w))]
            filler = [r.choice(noise) for _ in range(r.randint(0, 12))]
            return grams(" ".join(filler[:6] + w + filler[6:]))

        rows = [(vary(t), c) for c, ts in TEMPLATES.items() for t in ts for _ in range(12)]
        rows += [(vary(t), UNKNOWN) for t in OTHERS for _ in range(8)]
        rows += [(vary(t), NONE) for t in PLAIN for _ in range(8)] + [(grams(" ".join(r.choice(noise) for _ in range(20))), NONE) for _ in range(100)]
        r.shuffle(rows)
        cut = len(rows) * 3 // 4
        own = {g for texts in (*TEMPLATES.values(), OTHERS) for t in texts for g in grams(t)}
        self.vocab = sorted(own)
        index = {g: i for i, g in enumerate(self.vocab)}
        x = np.zeros((len(rows), len(index) + 1))
        x[:, -1] = 1
        for i, (g, _) in enumerate(rows):
            x[i, [index[w] for w in g if w in index]] = 1
        y = np.array([self.classes.index(c) for _, c in rows])
        want = np.eye(len(self.classes))[y]
        w = np.zeros((len(index) + 1, len(self.classes)))
        for _ in range(400):
            w -= 0.5 * (x[:cut].T @ (_softmax(x[:cut] @ w) - want[:cut]) / cut + 1e-4 * w)
        p = _softmax(x[cut:] @ w)
        self.weights, self.bias = w[:-1], w[-1]
        self.held_out = float((p.argmax(1) == y[cut:]).mean())
        self.thresholds = {}
        for k, c in enumerate(TEMPLATES):
            wrong, right = p[y[cut:] != k, k], p[y[cut:] == k, k]
            self.thresholds[c] = float(min(0.9, max(wrong.max(initial=0.0), 0.3) * 0.5 + right.min(initial=1.0) * 0.5))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@lru_cache(maxsize=1)
def model() -> Model:
    return Model()


def _strings(values) -> Column:
    """An array of words or pairs: one literal that is split when the query is planned, not one for each value."""
    return F.split(F.lit("\n".join(values)), "\n")


def _numbers(values) -> Column:
    return F.split(F.lit(" ".join(repr(float(v)) for v in values)), " ").cast("array<double>")


def _known(values) -> str:
    """SQL that asks whether x is one of the values, which becomes one look into a hash set."""
    if not all(re.fullmatch("[a-z0-9 ]+", v) for v in values):
        raise ValueError("only words and word pairs are looked up")
    return "x IN (" + ", ".join(f"'{v}'" for v in values) + ")"


def _among(array: str, values) -> Column:
    """The elements of a column's array that are among the values."""
    return F.expr(f"filter({array}, x -> {_known(values)})")


def _overlaps(array: str, values) -> Column:
    return F.expr(f"exists({array}, x -> {_known(values)})")


def _fence(df: DataFrame, *columns: str | Column) -> DataFrame:
    """A projection that the optimizer does not merge into later ones, so that each value is computed once."""
    row = F.explode(F.array(F.struct(*columns))).alias("_row")
    kept = [c for c in ("doc_id", "paragraph", "wide") if c in df.columns]
    return df.select(*kept, row).select(*kept, "_row.*")


def _words(text: str | Column) -> Column:
    """The words of a text without the comment markers that are words themselves."""
    return F.filter(F.split(F.lower(F.regexp_replace(text, "(?im)^[ \\t]*(?:dnl|rem)[ \\t]+", "")), "[^a-z0-9]+"), lambda x: x != "")


def _pairs(w: str | Column) -> Column:
    last = F.greatest(F.size(w) - 1, F.lit(0))
    return F.zip_with(F.slice(w, F.lit(1), last), F.slice(w, F.lit(2), last), lambda a, b: F.concat_ws(" ", a, b))


@lru_cache(maxsize=1)
def _parts() -> list[list[list[str]]]:
    """The word pairs of each template of each family."""
    return [[sorted({f"{a} {b}" for a, b in zip(words(t), words(t)[1:])}) for t in texts] for texts in TEMPLATES.values()]


def _template_pairs() -> list[str]:
    return sorted({p for texts in _parts() for t in texts for p in t})


def _shares(found: str) -> list[str]:
    """SQL of the largest share of a template's word pairs that are among ``found``, for each family. Pairs
    that no template has are not in it. As text, since a call to build each node takes longer than the query."""
    share = "size(array_intersect({0}, split('{1}', ','))) / {2:.1f}D"
    return [f"greatest({', '.join(share.format(found, ','.join(t), len(t)) for t in texts)}, 0.0D)" for texts in _parts()]


def _most(found: str) -> str:
    return f"CASE WHEN size({found}) > 0 THEN greatest({', '.join(_shares(found))}) ELSE 0.0D END"


def _of(index: str | Column, values: list[Column], default: float) -> Column:
    """The value at a place counted from 1; only that one is computed."""
    out = F.lit(default)
    for k, v in enumerate(values):
        out = F.when(F.col(index) == k + 1, v).otherwise(out)
    return out


def _paragraphs(docs: DataFrame, anchors: list[str]) -> DataFrame:
    """(doc_id, paragraph, lines, w): runs of lines without a blank one (comment markers aside) that hold an
    anchor, the number of the first line, the lines and the words of all of them."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.split(F.col("text").cast("string"), "\n").alias("lines"))
    d = _fence(d, "lines", F.transform("lines", lambda x: x.rlike(r"[\p{L}\p{N}]")).alias("full"))
    here, before, after = (lambda i, k=k: F.coalesce(F.get("full", i + k), F.lit(False)) for k in (0, -1, 1))
    at = F.sequence(F.lit(0), F.size("full") - 1)
    first, last = F.filter(at, lambda i: here(i) & ~before(i)), F.filter(at, lambda i: here(i) & ~after(i))
    d = _fence(d.where(F.size("full") > 0), "lines", F.zip_with(first, last, lambda a, b: F.struct(a.alias("a"), b.alias("b"))).alias("runs"))
    run = F.transform("runs", lambda r: F.struct(r.a.alias("paragraph"), F.slice("lines", r.a + 1, r.b - r.a + 1).alias("lines")))
    p = d.select("doc_id", F.explode(run).alias("r")).select("doc_id", "r.*")
    return _fence(p, "lines", _words(F.array_join("lines", "\n")).alias("w")).where(_overlaps("w", anchors))


def _units(p: DataFrame) -> DataFrame:
    """(doc_id, paragraph, wide, line): the lines of each paragraph and, where those that match no template
    alone match one together, the joined text of these.

    ``wide`` (own, family, share) tells such a paragraph's family, counted from 1, or 0 if the best share
    is that of several, and whether the row is the joined text itself; it is null for other paragraphs.
    """
    own = _template_pairs()
    p = _fence(p, "lines", F.when(F.size("lines") > 1, _pairs("w")).alias("pairs"))
    p = _fence(p, "lines", _among("pairs", own).alias("pairs"))
    p = _fence(p, "lines", F.when(F.col("pairs").isNotNull(), F.expr(_most("pairs"))).alias("most"))
    p = _fence(p, "lines", F.when(F.col("most") >= WRAPPED, F.transform("lines", lambda x: _pairs(_words(x)))).alias("each"))
    p = _fence(p, "lines", F.expr(f"transform(each, y -> filter(y, x -> {_known(own)}))").alias("each"))
    rest = F.expr(f"filter(lines, (x, i) -> {_most('get(each, i)')} < {WRAPPED}D)")
    p = _fence(p, "lines", F.when(F.col("each").isNotNull(), F.array_join(rest, "\n")).alias("text"))
    p = _fence(p, "lines", "text", F.when(F.col("text").isNotNull(), _pairs(_words("text"))).alias("pairs"))
    p = _fence(p, "lines", "text", _among("pairs", own).alias("pairs"))
    p = _fence(p, "lines", "text", F.when(F.col("pairs").isNotNull(), F.expr(f"array({', '.join(_shares('pairs'))})")).alias("shares"))
    p = _fence(p, "lines", "text", "shares", F.array_max("shares").alias("share"))
    best = F.when(F.size(F.filter("shares", lambda x: x >= F.col("share"))) == 1, F.array_position("shares", F.col("share")).cast("int")).otherwise(0)
    p = _fence(p, "lines", "text", "share", F.when(F.col("share") >= WRAPPED, best).alias("family"))
    wrapped = F.col("family").isNotNull()

    def wide(own: bool) -> Column:
        return F.when(wrapped, F.struct(F.lit(own).alias("own"), F.col("family").alias("family"), F.col("share").alias("share"))).alias("wide")

    def unit(number: Column, own: bool, line: Column) -> Column:
        return F.struct(number.cast("int").alias("paragraph"), wide(own), line.alias("line"))

    each = F.transform("lines", lambda x, i: unit(F.col("paragraph") + i, False, x))
    joined = F.array(unit(F.col("paragraph"), True, F.col("text")))
    return p.select("doc_id", F.explode(F.when(wrapped, F.concat(each, joined)).otherwise(each)).alias("u")).select("doc_id", "u.*")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph, family, probability, template_match): a row for each line, and for each wrapped
    paragraph, that is a licence notice; family ``unknown`` for notices that no family's threshold and
    template confirm.

    paragraph is the number of the line, or of the paragraph's first line, from 0. Of the lines of a
    wrapped notice only those have rows of their own that hold a template by themselves. A
    null or empty text has no paragraph of interest; repeated rows give repeated rows; other columns are
    ignored; an empty table gives an empty result. A line without any n-gram of the model scores by the
    constants alone, which say ``none``, so only the others are scored.
    """
    m = model()
    if m.classes[int(m.bias.argmax())] != NONE:
        raise AssertionError("a paragraph without features has to be of class none")
    anchors = sorted({max((w for w in g.split(" ") if telling(w)), key=lambda w: (len(w), w)) for g in m.vocab})
    own = F.coalesce(F.col("wide.own"), F.lit(False))
    w = _fence(_units(_paragraphs(docs, anchors)), _words("line").alias("w")).where(_overlaps("w", anchors))
    g = _fence(w, "w", _pairs("w").alias("pairs"))
    g = _fence(g, "pairs", F.concat("w", "pairs").alias("hits"))
    g = _fence(g, "pairs", _among("hits", m.vocab).alias("hits")).where(F.size("hits") > 0)
    g = _fence(g, _among("pairs", _template_pairs()).alias("pairs"), F.array_distinct("hits").alias("hits"))
    start, rows, vocab, k = _numbers(m.bias), _numbers(m.weights.ravel()), _strings(m.vocab), len(m.classes)

    def weights(hit: Column) -> Column:
        return F.slice(rows, ((F.array_position(vocab, hit) - 1) * k + 1).cast("int"), F.lit(k))

    logits = F.aggregate("hits", start, lambda acc, h: F.zip_with(acc, weights(h), lambda a, b: a + b))
    z = _fence(g, "pairs", logits.alias("z"))
    top = _fence(z, "pairs", "z", F.array_max("z").alias("top"))
    total = F.aggregate("z", F.lit(0.0), lambda a, v: a + F.exp(v - F.element_at(F.array("top"), 1)))
    sure = own & (F.col("wide.family") > 0)
    best = F.when(sure, F.col("wide.family")).otherwise(F.array_position("z", F.col("top")).cast("int"))
    probability = F.when(sure, F.exp(F.get("z", F.col("wide.family") - 1) - F.col("top"))).otherwise(1.0) / total
    p = _fence(top, "pairs", best.alias("best"), probability.alias("probability"))
    p = p.where((F.col("best") != len(m.classes)) | own)
    limit = F.when(F.col("best").between(1, len(TEMPLATES)), F.get(_numbers(m.thresholds.values()), F.col("best") - 1)).otherwise(2.0)
    match = F.when(own, F.col("wide.share")).otherwise(_of("best", [F.expr(x) for x in _shares("pairs")], 0.0))
    out = _fence(p, "best", "probability", match.alias("template_match"), limit.alias("limit"))
    line = (F.col("probability") >= F.col("limit")) & (F.col("template_match") >= MATCH)
    out = out.where(F.col("wide").isNull() | own | line & (F.col("template_match") >= WRAPPED))
    known = F.when(own, F.col("wide.family") > 0).otherwise(line)
    family = F.when(known, F.element_at(_strings(m.classes), F.greatest("best", F.lit(1)))).otherwise(F.lit(UNKNOWN))
    return out.select("doc_id", F.col("paragraph").cast("long").alias("paragraph"), family.alias("family"), "probability", "template_match")
