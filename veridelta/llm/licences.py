"""Licence scan by a trained paragraph classifier, with DataFrame functions only.

Features of a paragraph are its word 1- to 3-grams that hold one of a few anchor words; all
other n-grams have weight 0 by construction, so a paragraph without an anchor word has the
score of the empty paragraph, unknown, and is left after a plain string search.  A sparse
multinomial logistic regression (L1 proximal gradient) over these n-grams is trained on the
notices of TEMPLATES, variations of them, and sentences that speak of licences without
granting one, as class unknown.  HELD, lines that others wrote about the same licences, sets
the temperature of the probabilities and of the unknown class.  A prediction is confirmed if
most word pairs of one of the family's templates stand in the paragraph.  Paragraphs are
lines and, for notices that are wrapped, the blocks of lines between blank lines.

Training data are the fixed notices below; the scan covers every paragraph of every whole
text.  Each distinct paragraph is scored once, however often it stands in the corpus, so a
notice that a third of all documents carry costs one row.  Weights and templates are tables
whose size the notices fix; they are broadcast.

Defined cases: null and empty texts have no paragraphs; ids may be null or repeat: every row
is answered on its own, and equal rows give one result each; very long texts and lines are
read whole; of equally likely families the last in the alphabet is taken; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import blocks as B

#: fixed values: notices as their licences word them
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "SPDX-License-Identifier: Apache-2.0",
        "Apache Software License 2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-3.0-only",
        "GNU GPL version 3", "GPLv3", "GNU GPLv3", "GNU GPL v3",
    ),
    "gpl-2.0": (
        "Licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "SPDX-License-Identifier: GPL-2.0-or-later",
        "GNU GPL version 2", "GPLv2", "GPL-2.0", "GNU GPL v2",
    ),
    "lgpl-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "LGPL-2.1", "LGPLv2.1", "GNU LGPL v2.1",
    ),
    "lgpl-3.0": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
        "Licensed under the GNU Lesser General Public License, version 3.",
        "GNU Lesser General Public License v3.0", "LGPL-3.0", "LGPLv3", "GNU LGPL v3",
    ),
    "agpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "Licensed under the GNU Affero General Public License v3.0.",
        "AGPL-3.0", "AGPLv3", "GNU AGPL v3",
    ),
    "cc-by-nc-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "cc-by-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "cc-by-sa-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "cc-by-nd-4.0": (
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ),
    "cc-by-nc-sa-4.0": (
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    ),
    "cc-by-nc-nd-4.0": (
        "Licensed under CC BY-NC-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    ),
    "cc0-1.0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
        "Creative Commons Zero v1.0 Universal, public domain dedication",
    ),
    "bsd-3-clause": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "bsd-2-clause": ("Released under the BSD 2-Clause Simplified License.", "SPDX-License-Identifier: BSD-2-Clause", "Licensed under the FreeBSD license, BSD-2-Clause."),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
        "Mozilla Public License, v. 2.0", "Mozilla Public License 2.0",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "For more information, please refer to the Unlicense at unlicense.org",
        "SPDX-License-Identifier: Unlicense",
    ),
    "epl-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "SPDX-License-Identifier: EPL-2.0",
        "Eclipse Public License - v 2.0",
    ),
    "bsl-1.0": (
        "Distributed under the Boost Software License, Version 1.0.",
        "Boost Software License - Version 1.0 - August 17th, 2003",
        "SPDX-License-Identifier: BSL-1.0",
    ),
    "zlib": (
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
        "Released under the zlib License.",
        "SPDX-License-Identifier: Zlib",
    ),
    "artistic-2.0": ("Licensed under the Artistic License 2.0.", "The Artistic License 2.0, Copyright (c) 2000-2006, The Perl Foundation.", "SPDX-License-Identifier: Artistic-2.0"),
    "ofl-1.1": (
        "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
        "SPDX-License-Identifier: OFL-1.1",
    ),
    "eupl-1.2": ("Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission", "SPDX-License-Identifier: EUPL-1.2", "European Union Public Licence v. 1.2"),
    "wtfpl": ("Do What The Fuck You Want To Public License, WTFPL Version 2", "SPDX-License-Identifier: WTFPL", "Released under the WTFPL."),
    "unknown": (
        "All rights reserved under copyright law.", "He renewed his driving licence last year.", "The licence fee was paid in full.", "A public library is open to any person.",
        "The software was released in version 2.0.", "She is a licensed doctor and this is her work.", "Permission to enter was granted by the guard.", "The foundation published a general report.",
        "Version 3 of the document is free.", "The restaurant lost its license to serve wine.", "Creative people work in common rooms.", "They modified the source of the river.",
        "Terms of the license are not known.", "Licensed dealers only.", "Released under pressure.", "Redistribution of wealth was debated.",
        "A solar eclipse was seen by the public.", "The house is in the public domain of the town.", "They asked for permission to use the hall.", "An artistic performance for any purpose.",
        "The gnu is a large antelope.", "Apache is a people of the southwest.", "Mozilla is a foundation.", "A boost for the economy.", "The warranty covers two years without fee.",
        "The license number of the car was noted.", "Please send your answer by mail, cc to the office.", "A permission slip was signed by the parents.",
        "The eclipse lasted an hour.", "Her artistic work was shown to the public.", "The artistic team won the prize.", "They bought a domain name.", "Knowledge in the domain of law is public.", "An eclipse of the sun was seen.",
    ),
}
#: fixed values: lines about the same licences in other words, for calibration only
HELD: tuple[tuple[str, str], ...] = (
    ("License: Apache 2.0", "apache-2.0"), ("This project is distributed under the Apache License 2.0", "apache-2.0"), ("ASL 2.0, see the Apache license text", "apache-2.0"),
    ("The MIT License (MIT)", "mit"), ("License :: OSI Approved :: MIT License", "mit"), ("Code is available under the MIT license", "mit"),
    ("License: GNU GPL v3", "gpl-3.0"), ("distributed under GPL-3.0-or-later", "gpl-3.0"), ("See the GNU General Public License version 3 for details", "gpl-3.0"),
    ("distributed under the GNU GPL version 2", "gpl-2.0"), ("License: GPL-2.0", "gpl-2.0"), ("GNU LGPL version 2.1", "lgpl-2.1"), ("License: LGPL-2.1", "lgpl-2.1"),
    ("GNU Lesser General Public License v3", "lgpl-3.0"), ("License: LGPL-3.0", "lgpl-3.0"), ("GNU Affero GPL v3", "agpl-3.0"), ("License: AGPL-3.0", "agpl-3.0"),
    ("Text is available under CC BY-NC 4.0", "cc-by-nc-4.0"), ("Images: CC BY 4.0", "cc-by-4.0"), ("Content under CC BY-SA 4.0", "cc-by-sa-4.0"), ("Data: CC0 1.0", "cc0-1.0"),
    ("Photos under CC BY-ND 4.0", "cc-by-nd-4.0"), ("License: BSD 3-Clause", "bsd-3-clause"), ("New BSD, BSD-3-Clause", "bsd-3-clause"), ("License: BSD-2-Clause", "bsd-2-clause"),
    ("Covered by the Mozilla Public License 2.0", "mpl-2.0"), ("License: MPL-2.0, Mozilla", "mpl-2.0"), ("ISC License text", "isc"), ("License: ISC", "isc"), ("dedicated by the Unlicense", "unlicense"),
    ("made available under the Eclipse Public License v2.0", "epl-2.0"), ("License: EPL-2.0, Eclipse", "epl-2.0"), ("uses the Boost Software License 1.0", "bsl-1.0"), ("zlib License", "zlib"),
    ("the Artistic License version 2.0", "artistic-2.0"), ("fonts under the SIL Open Font License 1.1", "ofl-1.1"), ("subject to the EUPL v1.2", "eupl-1.2"), ("WTFPL", "wtfpl"),
    ("The driver had no valid licence.", "unknown"), ("Her licence to practise expired.", "unknown"), ("He took the picture without permission.", "unknown"), ("The foundation of the house is old.", "unknown"),
    ("Licensing costs rose again this year.", "unknown"), ("the gnu herd crossed the river", "unknown"), ("an account of the accident", "unknown"), ("The artistic director left.", "unknown"),
    ("public domain name registration", "unknown"), ("the warranty has run out", "unknown"), ("eclipse of the moon", "unknown"), ("the redistribution of land", "unknown"),
)
#: a feature holds one of these; searched for as plain substrings of the lower-cased text
ANCHORS = ("licen", "apache", "gnu", "gpl", "mozilla", "creative", "cc", "bsd", "permission", "redistribut", "spdx", "foundation", "eclipse", "domain", "boost", "artistic", "zlib", "wtfpl", "eupl", "mpl-", "warranty")
NGRAMS = 3
_WORD = r"[a-z0-9.+-]*[a-z0-9+]"


def _words(text: str) -> list[str]:
    return re.findall(_WORD, text.lower())


def ngrams(words: list[str]) -> set[str]:
    grams = {" ".join(words[i : i + n]) for n in range(1, NGRAMS + 1) for i in range(len(words) - n + 1)}
    return {g for g in grams if any(a in g for a in ANCHORS)}


def _variants(seed: int, each: int) -> list[tuple[set[str], str]]:
    """Notices with words lost, changed or put before and after them."""
    r = random.Random(seed)
    filler = ["code", "file", "project", "see", "for", "details", "and", "copyright", "2020", "authors", "thon", "erre", "text", "available", "is", "of", "this", "data", "by", "it"]
    out = []
    for family, texts in TEMPLATES.items():
        for text in texts:
            for k in range(each):
                w = _words(text)
                if k:
                    w = [x for x in w if r.random() > 0.06]
                    w = [r.choice(filler) for _ in range(r.randint(0, 4))] + w + [r.choice(filler) for _ in range(r.randint(0, 6))]
                out.append((ngrams(w), family))
    return out


def _design(data: list[set[str]], place: dict[str, int]) -> np.ndarray:
    x = np.zeros((len(data), len(place)))
    for i, grams in enumerate(data):
        x[i, [place[g] for g in grams if g in place]] = 1.0
    return x


def _softmax_rows(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@lru_cache(maxsize=1)
def model() -> tuple[dict[tuple[str, str], float], dict[str, float], float]:
    """Sparse weights (n-gram, family), intercepts, temperature."""
    data, families = _variants(11, 8), list(TEMPLATES)
    grams = sorted({g for x, _ in data for g in x})
    x = _design([g for g, _ in data], {g: i for i, g in enumerate(grams)})
    y = np.array([families.index(f) for _, f in data])
    share = 1.0 / np.bincount(y, minlength=len(families))[y] / len(families)  # all families weigh the same
    b = np.array([1.0 if f == "unknown" else 0.0 for f in families])
    w = np.zeros((len(grams), len(families)))
    rate, l1 = 12.0, 0.0001
    for _ in range(200):
        e = (np.eye(len(families))[y] - _softmax_rows(x @ w + b)) * share[:, None]
        w += rate * (x.T @ e)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1, 0)
    held = _design([ngrams(_words(t)) for t, _ in HELD], {g: i for i, g in enumerate(grams)}) @ w + b
    own = np.array([families.index(f) for _, f in HELD])

    def loss(t: float) -> float:
        return -float(np.log(_softmax_rows(held / t)[np.arange(len(own)), own]).sum())

    temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0), key=loss)
    return {(grams[i], families[j]): round(float(w[i, j]), 6) for i, j in zip(*np.nonzero(np.round(w, 6)), strict=True)}, dict(zip(families, b.tolist(), strict=True)), temperature


def _softmax(z: dict[str, float]) -> dict[str, float]:
    p = _softmax_rows(np.array([list(z.values())]))[0]
    return dict(zip(z, p.tolist(), strict=True))


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, row, block, paragraph, lines, line and key of the paragraphs with an anchor word.

    A paragraph is a line, or all lines of a block between blank lines; paragraph is the number
    from 0 of its first line, block that of the block's first line, lines how many it has; row is a
    digest of the text, which tells rows of one id apart, key one of the paragraph.
    """
    any_of = lambda c: [c.contains(a) for a in ANCHORS]

    def has(c):
        out = F.lit(False)
        for x in any_of(c):
            out = out | x
        return out

    d = docs.select(F.col("doc_id").cast("long"), F.col("text")).where(has(F.lower("text")))
    d = d.withColumn("row", F.sha2(F.col("text").cast("binary"), 256))
    # each line carries its number, so that a block split off the text knows its place
    numbered = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.lit("\n"), i.cast("string"), F.lit(":"), x)), "")
    blocks = d.select("doc_id", "row", F.explode(F.split(numbered, r"\n[0-9]+:[ \t\r\f\x0b]*(?=\n|\z)")).alias("block")).where(has(F.lower("block")))
    lines = blocks.select("doc_id", "row", F.split(F.substr("block", F.lit(2)), "\n").alias("lines"))
    number = lambda x: F.substring_index(x, ":", 1).cast("int")
    plain = lambda x: F.substr(x, F.instr(x, ":") + 1)
    unit = lambda at, n, line: F.struct(number(at).alias("paragraph"), F.lit(n).cast("int").alias("lines"), line.alias("line"))
    first = F.get("lines", F.lit(0))
    whole = F.array(F.struct(number(first).alias("paragraph"), F.size("lines").alias("lines"), F.array_join(F.transform("lines", plain), "\n").alias("line")))
    units = F.transform("lines", lambda x: unit(x, 1, plain(x)))
    p = lines.select("doc_id", "row", number(first).alias("block"), F.explode(F.when(F.size("lines") > 1, F.concat(units, whole)).otherwise(units)).alias("u")).select("doc_id", "row", "block", "u.*").where(has(F.lower("line")))
    return p.withColumn("key", F.sha2(F.col("line").cast("binary"), 256))


def _table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A fixed table as one JSON literal: no Python reaches an executor."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("x")).select("x.*")


def _weights(spark: SparkSession) -> DataFrame:
    families = list(TEMPLATES)
    rows: dict[str, list[float]] = {}
    for (g, f), v in model()[0].items():
        rows.setdefault(g, [0.0] * len(families))[families.index(f)] = v
    return _table(spark, [{"gram": g, "w": w} for g, w in sorted(rows.items())], "gram:string,w:array<double>")


def _pairs(words: list[str]) -> list[str]:
    return sorted({" ".join(words[i : i + 2]) for i in range(len(words) - 1)})


def _templates(spark: SparkSession) -> DataFrame:
    rows = [{"family": f, "pairs": _pairs(_words(t))} for f, texts in TEMPLATES.items() if f != "unknown" for t in texts if _pairs(_words(t))]
    return _table(spark, rows, "family:string,pairs:array<string>")


def _grams(words: Column, n: int) -> Column:
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))
    return F.when(F.size(words) >= n, runs).otherwise(F.array().cast("array<string>"))


def scored(lines: DataFrame, least: float = 0.5) -> DataFrame:
    """key, family, probability and similarity of the distinct lines (key, line) that are not predicted unknown."""
    spark, families = lines.sparkSession, list(TEMPLATES)
    _, b, t = model()
    own = lines.withColumn("words", F.regexp_extract_all(F.lower("line"), F.lit(_WORD), F.lit(0)))
    every = F.array_distinct(F.concat(*[_grams(F.col("words"), k) for k in range(1, NGRAMS + 1)]))
    # the tables' sizes are fixed by the notices above
    sums = own.select("key", F.explode(every).alias("gram")).join(F.broadcast(_weights(spark)), "gram").groupBy("key").agg(*[F.sum(F.get("w", F.lit(i))).alias(f"z{i}") for i in range(len(families))])
    z = [(F.coalesce(F.col(f"z{i}"), F.lit(0.0)) + b[f]) / t for i, f in enumerate(families)]
    sums = sums.select("key", F.array(*z).alias("z"))
    top = F.array_max("z")
    best = F.array_max(F.zip_with("z", F.array(*map(F.lit, families)), lambda x, f: F.struct(x.alias("z"), f.alias("family"))))
    found = sums.select("key", best["family"].alias("family"), (1 / F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x - top))).alias("probability"))
    found = found.where((F.col("family") != "unknown") & (F.col("probability") >= least)).join(own.select("key", _grams(F.col("words"), 2).alias("own")), "key")
    share = F.size(F.array_intersect("own", "pairs")) / F.size("pairs")
    return found.join(F.broadcast(_templates(spark)), "family").groupBy("key", "family", "probability").agg(F.max(share).alias("similarity"))


def scan(docs: DataFrame, least: float = 0.5, alike: float = 0.6) -> DataFrame:
    """doc_id, paragraph, family, probability, similarity, confirmed and text of every paragraph that is not predicted unknown.

    A block's own row stands for its lines of the same family if they are not confirmed and it is, or if there are none.
    """
    p = B.stored(paragraphs(docs), "paragraphs")
    known = B.stored(scored(p.groupBy("key").agg(F.min("line").alias("line")), least), "licences")
    # both sides are exchanged, so Spark may split a paragraph that many rows hold
    found = p.join(known, "key").withColumn("confirmed", F.col("similarity") >= alike)
    # a wrapped notice is reported once: whole if only the block meets its template, else by its lines
    alone, own_family = F.col("lines") == 1, Window.partitionBy("doc_id", "row", "block", "family")
    any_in = lambda c: F.coalesce(F.max(c.cast("int")).over(own_family), F.lit(0)) > 0
    found = found.withColumns({"by_line": any_in(alone & F.col("confirmed")), "met": any_in(alone), "by_block": any_in(~alone & F.col("confirmed"))})
    block_wins = ~F.col("by_line") & (F.col("by_block") | ~F.col("met"))
    found = found.where(F.when(alone, ~block_wins).otherwise(block_wins))
    # lines of a notice that is met whole are parts of it, whatever they look like on their own
    whole = F.max((~alone & F.col("confirmed")).cast("int")).over(Window.partitionBy("doc_id", "row", "block")) > 0
    found = found.withColumn("part", alone & ~F.col("confirmed") & whole).where("not part")
    return found.select("doc_id", "paragraph", "family", F.round("probability", 6).alias("probability"), F.round("similarity", 6).alias("similarity"), "confirmed", F.col("line").alias("text"))
