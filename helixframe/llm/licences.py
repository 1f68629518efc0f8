"""Licence scan: a trained paragraph classifier, scored by SQL functions alone.

A paragraph is a line, or neighbouring lines without a blank one between them
over which a notice may be wrapped: of the first and last line the words next
to the others, as many as the longest notice has, and fewer than those between.
Its distinct words and word pairs are the features of a multinomial logistic
regression over licence families and "unknown", trained on variations of the
notices below (numpy, on the driver, no corpus data; the weights are a table of
bounded size). Probabilities are calibrated by a temperature fitted on notices
and sentences that training never sees. A family is reported if its calibrated
probability is at least ``least``, the paragraph has at least ``cover`` of the
words of one of the family's notices, and it doesn't name another version of the
licence alone. Shorter paragraphs go first; one that overlaps another of its
family doesn't count; of equally sure families the last by name is the licence.
Of each notice so many words are markers that ``cover`` of it can't do without
all of them, so texts and lines without a marker can't be confirmed and aren't
scored.

All of it is one projection of each row: no join, no shuffle, no Python on the
executors. Nulls: a null text has no paragraphs; a null id is carried along.
Texts are scanned whole, however long. Repeated rows each give a row; an empty
table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Notices by family (public texts; the part that names or grants the licence).
NOTICES = {
    "mit": ["Released under the MIT License.", "This project is licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "you may not use this file except in compliance with the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "gpl-2.0": ["This work is licensed under the GNU General Public License, version 2.", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later"],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3.", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "lgpl-2.1": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License", "SPDX-License-Identifier: LGPL-2.1-only"],
    "lgpl-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3.", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License", "SPDX-License-Identifier: LGPL-3.0-only"],
    "agpl-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: AGPL-3.0-only"],
    "bsd-2-clause": ["Released under the BSD 2-Clause License.", "Licensed under the simplified BSD 2-Clause License", "SPDX-License-Identifier: BSD-2-Clause"],
    "bsd-3-clause": ["Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "SPDX-License-Identifier: BSD-3-Clause"],
    "mpl-1.1": ["The contents of this file are subject to the Mozilla Public License Version 1.1", "SPDX-License-Identifier: MPL-1.1"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "epl-1.0": ["Licensed under the Eclipse Public License, version 1.0.", "SPDX-License-Identifier: EPL-1.0"],
    "epl-2.0": ["Licensed under the Eclipse Public License, version 2.0.", "made available under the terms of the Eclipse Public License 2.0", "SPDX-License-Identifier: EPL-2.0"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Released under the ISC License.", "SPDX-License-Identifier: ISC"],
    "cc-by-3.0": ["Licensed under CC BY 3.0.", "This work is licensed under a Creative Commons Attribution 3.0 Unported License."],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa-3.0": ["Licensed under CC BY-SA 3.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "public-domain": ["This is free and unencumbered software released into the public domain.", "Dedicated to the public domain under the CC0 license.", "SPDX-License-Identifier: CC0-1.0"],
    "proprietary": ["Copyright. All rights reserved.", "Copyright holder. All rights reserved. No part of this publication may be reproduced without permission."],
}
#: Notices that calibrate and that training never sees.
CALIBRATION = {
    "mit": ["The code is available under the terms of the MIT License."], "apache-2.0": ["Distributed under Apache License 2.0."], "gpl-2.0": ["This program comes under the GNU General Public License, version 2."], "gpl-3.0": ["This program comes under the GNU General Public License, version 3."],
    "lgpl-2.1": ["Distributed under the GNU Lesser General Public License, version 2.1."], "lgpl-3.0": ["Distributed under the GNU Lesser General Public License, version 3."], "agpl-3.0": ["Distributed under the GNU Affero General Public License, version 3."], "bsd-2-clause": ["Distributed under the BSD 2-Clause License."],
    "bsd-3-clause": ["Distributed under the BSD 3-Clause License."], "mpl-1.1": ["Distributed under the Mozilla Public License 1.1."], "mpl-2.0": ["Distributed under the Mozilla Public License 2.0."], "epl-1.0": ["Distributed under the Eclipse Public License 1.0."], "epl-2.0": ["Distributed under the Eclipse Public License 2.0."],
    "isc": ["Distributed under the ISC License."], "cc-by-3.0": ["Text available under CC BY 3.0."], "cc-by-4.0": ["Text available under CC BY 4.0."], "cc-by-sa-3.0": ["Text available under CC BY-SA 3.0."], "cc-by-sa-4.0": ["Text available under CC BY-SA 4.0."], "cc-by-nc-4.0": ["Text available under CC BY-NC 4.0."],
    "public-domain": ["This work was released into the public domain by its author."], "proprietary": ["2021 Example Press. All rights reserved."],
}
UNKNOWN_CALIBRATION = [
    "The licensing board met on Tuesday.", "A hunting license is valid for one season.", "The public library is open until eight.", "All seats are reserved for members.", "Version 2 of the game was sold out.", "The terms of the contract were not published.", "The software needs 3 gigabytes of memory.", "She wrote free verse and distributed it to friends.",
    "A general strike was called by the unions.", "The foundation published its yearly report.",
]
#: Families that differ in their version alone: the numbers that name each.
VERSIONS = [
    {"gpl-2.0": ["2", "2.0"], "gpl-3.0": ["3", "3.0"]}, {"lgpl-2.1": ["2.1", "2"], "lgpl-3.0": ["3", "3.0"]}, {"bsd-2-clause": ["2", "two"], "bsd-3-clause": ["3", "three"]}, {"mpl-1.1": ["1.1", "1.0"], "mpl-2.0": ["2.0", "2"]}, {"epl-1.0": ["1.0", "1"], "epl-2.0": ["2.0", "2"]},
    {"cc-by-3.0": ["3.0", "3"], "cc-by-4.0": ["4.0", "4"]}, {"cc-by-sa-3.0": ["3.0", "3"], "cc-by-sa-4.0": ["4.0", "4"]}, {"apache-2.0": ["2.0", "2"], "": ["1.0", "1.1", "1"]}, {"agpl-3.0": ["3", "3.0"], "": ["1", "1.0"]}, {"cc-by-nc-4.0": ["4.0", "4"], "": ["3.0", "3", "2.0"]},
]
OTHERS = [
    "A driver's license is required to rent a car.", "The fishing license costs ten dollars a year.", "The city council reviewed the liquor license of the restaurant.", "He lost his licence after the accident.", "Poetic license lets a writer bend the rules.", "Copyright law differs from country to country.",
    "The museum owns the copyright of the painting.", "The public debate about licensing went on for weeks.", "They redistribute the wealth of the region.", "The software was free and everyone used it.", "Permission was granted by the owner of the house.", "The Apache helicopter landed at noon.",
    "She studied at MIT for four years.", "A creative commons for the arts was opened downtown.", "The general public was invited to the opening.", "Domain names are sold to the public.", "See the terms of service for details.", "The version 3 of the plan was approved.", "A work by an unknown author.", "Rights of way are reserved for walkers.",
]
FAMILIES = ["unknown", *NOTICES]
#: Words and pairs with weights: at most so many.
VOCABULARY = 2000
WORD = "[a-z0-9]+(?:[.][0-9]+)*"
DECIMAL = "^[0-9]+[.][0-9]+$"


def words(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


#: Words of the longest notice.
LONGEST = max(len(words(t)) for texts in NOTICES.values() for t in texts)
#: Frequent words, markers only if a notice has no others.
FREQUENT = {"a", "all", "and", "any", "as", "by", "file", "in", "is", "it", "no", "not", "of", "or", "out", "part", "the", "this", "to", "under", "use", "with", "without", "work", "you", "may", "can"}


def needed(text: str, cover: float) -> int:
    """Distinct words of a notice that confirm it."""
    size = len(set(words(text)))
    return next(n for n in range(size + 1) if n >= cover * size)


def markers(cover: float) -> list[str]:
    """Words of which any text with cover of a notice has one."""
    found = set()
    for text in (t for texts in NOTICES.values() for t in texts):
        w = sorted(set(words(text)), key=lambda x: (x in FREQUENT, -len(x), x))
        found |= set(w[: len(w) - needed(text, cover) + 1])
    return sorted(found)


def foreign(family: str) -> tuple[list[str], list[str]]:
    """(numbers of a family's own version, numbers of its other versions)."""
    for group in VERSIONS:
        if family in group:
            return group[family], sorted({n for name, numbers in group.items() if name != family for n in numbers} - set(group[family]))
    return [], []


def of_version(family: str, w: list[str]) -> bool:
    """Whether words name the family's version, or none."""
    own, other = foreign(family)
    return bool(set(own) & set(w)) or not (set(other) & set(w) or (own and any(re.search(DECIMAL, x) for x in w)))


def grams(w: list[str]) -> set[str]:
    return {*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))}


def _varied(text: str, g: random.Random, filler: list[str]) -> list[str]:
    w = words(text)
    w = [x for x in w if g.random() > 0.08 or x[0].isdigit()] or w
    before = [g.choice(filler) for _ in range(g.choice((0, 0, 0, 2, 5)))]
    after = [g.choice(filler) for _ in range(g.choice((0, 0, 0, 3, 8)))]
    return before + w + after


def _examples(notices: dict[str, list[str]], others: list[str], seed: int, copies: int) -> list[tuple[set[str], int]]:
    g = random.Random(seed)
    filler = [w for t in others for w in words(t)]
    out = []
    for k, family in enumerate(FAMILIES):
        texts = notices.get(family, others)
        out += [(grams(_varied(t, g, filler)), k) for t in texts for _ in range(max(1, copies * 4 // len(texts)))]
    out += [(grams([g.choice(filler) for _ in range(g.randrange(3, 20))]), 0) for _ in range(copies)]
    return out


@lru_cache(1)
def model() -> tuple[dict[str, np.ndarray], np.ndarray, float]:
    """(weights by feature, bias, temperature): deterministic."""
    train, check = _examples(NOTICES, OTHERS, 1, 24), _examples(CALIBRATION, UNKNOWN_CALIBRATION, 2, 10)
    count: dict[str, int] = {}
    for x, _ in train:
        for f in x:
            count[f] = count.get(f, 0) + 1
    names = sorted(count, key=lambda f: (-count[f], f))[:VOCABULARY]
    place = {f: k for k, f in enumerate(names)}

    def matrix(rows):
        m = np.zeros((len(rows), len(names) + 1))
        for r, (x, _) in enumerate(rows):
            m[r, [place[f] for f in x if f in place]] = 1
        m[:, -1] = 1
        return m, np.eye(len(FAMILIES))[[y for _, y in rows]]

    x, y = matrix(train)
    w = np.zeros((x.shape[1], y.shape[1]))
    for _ in range(300):
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        w -= 2.0 * (x.T @ (p - y) / len(x) + 1e-4 * w)
    x, y = matrix(check)
    z = x @ w

    def loss(t):
        s = z / t - (z / t).max(1, keepdims=True)
        return -((s - np.log(np.exp(s).sum(1, keepdims=True))) * y).sum() / len(y)

    heat = min((0.5 + 0.05 * k for k in range(60)), key=loss)
    w = np.round(w, 6)
    return {f: w[k] for f, k in place.items()}, w[-1], round(heat, 2)


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _numbers(values) -> str:
    return "array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")"


def licence_scan(documents: DataFrame, least: float = 0.5, cover: float = 0.7) -> DataFrame:
    """doc_id, licence (family of the surest confirmed paragraph, null without
    one), probability, n_paragraphs (confirmed) and families (their families,
    sorted) of each row of documents."""
    weights, bias, heat = model()
    table = "map(" + ", ".join(f"{_quoted(f)}, {_numbers(w)}" for f, w in weights.items()) + ")"
    notices = "array(" + ", ".join(f"struct({k} as family, {needed(t, cover)} as need, array({', '.join(_quoted(w) for w in sorted(set(words(t))))}) as words)" for k, name in enumerate(FAMILIES) for t in NOTICES.get(name, ())) + ")"
    names = "array(" + ", ".join(map(_quoted, FAMILIES)) + ")"
    lists = lambda which: "array(" + ", ".join(f"cast(array({', '.join(map(_quoted, foreign(f)[which]))}) as array<string>)" for f in FAMILIES) + ")"
    own, other = (f"{lists(k)}[cast(u.family as int)]" for k in (0, 1))
    version = f"(arrays_overlap(u.words, {own}) or not (arrays_overlap(u.words, {other}) or (size({own}) > 0 and exists(u.words, w -> w rlike '{DECIMAL}'))))"
    marks = markers(cover)
    marked = " or ".join(f"contains(low, {_quoted(m)})" for m in marks if not any(o in m for o in marks if o != m))
    has_mark = f"arrays_overlap(u.words, array({', '.join(map(_quoted, marks))}))"
    covers = "size(array_intersect(u.words, n.words)) >= n.need"
    joined = f"concat(slice(lines[s], greatest(size(lines[s]) - {LONGEST - 1}, 1), {LONGEST}), flatten(slice(lines, s + 2, e - s - 1)), slice(lines[e], 1, {LONGEST}))"
    ends = f"filter(sequence(s, least(s + {LONGEST}, size(lines) - 1)), e -> e = s or (not exists(slice(lines, s + 1, e - s + 1), l -> size(l) = 0) and (e = s + 1 or size(flatten(slice(lines, s + 2, e - s - 1))) < {LONGEST})))"
    kept = "array<struct<len:int,s:int,p:double,name:string>>"
    steps = [
        ("low", "lower(cast(text as string))"),
        ("lines", f"case when {marked} then transform(split(low, '\n'), l -> regexp_extract_all(l, '{WORD}', 0)) else array() end"),
        ("found", f"case when size(lines) > 0 then flatten(transform(sequence(0, size(lines) - 1), s -> transform({ends}, e -> struct(e - s as len, s as s, case when e = s then lines[s] else {joined} end as words)))) else array() end"),
        ("found", f"filter(found, u -> {has_mark} and exists({notices}, n -> {covers}))"),
        ("found", "transform(found, u -> struct(u.len as len, u.s as s, array_distinct(u.words) as words, array_distinct(concat(u.words, case when size(u.words) > 1 then transform(sequence(1, size(u.words) - 1), i -> concat(u.words[i - 1], ' ', u.words[i])) else array() end)) as grams))"),
        ("found", f"transform(found, f -> struct(f.len as len, f.s as s, f.words as words, aggregate(filter(transform(f.grams, g -> try_element_at({table}, g)), w -> w is not null), {_numbers(bias)}, (a, w) -> zip_with(a, w, (x, y) -> x + y)) as z))"),
        ("found", f"transform(found, f -> struct(f.len as len, f.s as s, f.words as words, array_position(f.z, array_max(f.z)) - 1 as family, 1 / aggregate(transform(f.z, x -> exp((x - array_max(f.z)) / {heat}D)), 0D, (a, x) -> a + x) as p))"),
        ("found", f"filter(found, u -> u.family > 0 and u.p >= {least}D and exists({notices}, n -> n.family = u.family and {covers}) and {version})"),
        ("found", f"array_sort(cast(transform(found, f -> struct(f.len as len, f.s as s, f.p as p, {names}[cast(f.family as int)] as name)) as {kept}))"),
        ("found", f"aggregate(found, cast(array() as {kept}), (a, f) -> case when exists(a, o -> o.name = f.name and o.s <= f.s + f.len and f.s <= o.s + o.len) then a else concat(a, array(f)) end)"),
        ("found", "transform(found, f -> struct(f.p as p, f.name as name))"),
    ]
    out = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    for name, code in steps:
        out = out.withColumn(name, F.expr(code))
    return out.select(
        "doc_id",
        F.expr("array_max(found).name").alias("licence"),
        F.expr("round(array_max(found).p, 6)").alias("probability"),
        F.expr("coalesce(size(found), 0)").alias("n_paragraphs"),
        F.expr("coalesce(array_sort(array_distinct(transform(found, f -> f.name))), array())").alias("families"),
    )


def scan_text(text: str | None, least: float = 0.5, cover: float = 0.7) -> tuple[str | None, float | None, int, list[str]]:
    """The same of one text in plain Python, as a check of the SQL."""
    weights, bias, heat = model()
    lines = [words(line) for line in (text or "").lower().split("\n")]
    units = [(0, s, w) for s, w in enumerate(lines)]
    for s, w in enumerate(lines):
        between: list[str] = []
        for e in range(s + 1, min(s + LONGEST, len(lines) - 1) + 1):
            if not w or not lines[e] or len(between) >= LONGEST:
                break
            units.append((e - s, s, w[-LONGEST:] + between + lines[e][:LONGEST]))
            between += lines[e]
    kept: list[tuple[float, str, int, int]] = []
    for size, s, w in sorted(units, key=lambda u: u[:2]):
        z = sum((weights[g] for g in grams(w) if g in weights), bias.copy())
        p = np.exp((z - z.max()) / heat)
        k = int(z.argmax())
        if k and 1 / p.sum() >= least and any(len(set(words(t)) & set(w)) >= cover * len(set(words(t))) for t in NOTICES[FAMILIES[k]]) and of_version(FAMILIES[k], w):
            if not any(n == FAMILIES[k] and a <= s + size and s <= a + m for _, n, a, m in kept):
                kept.append((1 / p.sum(), FAMILIES[k], s, size))
    found = [(p, n) for p, n, _, _ in kept]
    best = max(found, default=(None, None))
    return best[1], best[0] and round(best[0], 6), len(found), sorted({f for _, f in found})
