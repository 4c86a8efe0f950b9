import textwrap

from veridelta.llm import licences as L


def test_scan(spark):
    rows = [
        (1, "Thon erre.\nLicensed under the Apache License, Version 2.0.\nmore"),
        (2, "Released under the MIT License.\n\nReleased under the MIT License."),
        (3, "He renewed his driving licence last year."),
        (4, None),
        (5, ""),
        (None, "Licensed under CC BY-NC 4.0."),
        (6, "This work is licensed under the GNU General Public License, version 3."),
        (6, "This work is licensed under the GNU General Public License, version 3."),
        (7, "erre " * 30_000 + "\nLicensed under CC BY 4.0."),
        (8, "PERMISSION is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
        (9, "They asked for permission.\nThe licence was lost in creative commons."),
    ]
    df = spark.createDataFrame([(d, t, "x", 1.0) for d, t in rows], "doc_id long, text string, family string, row double")
    got = sorted(((r.doc_id, r.paragraph, r.family, r.confirmed) for r in L.scan(df).collect()), key=str)
    assert got == sorted([(1, 1, "apache-2.0", True), (2, 0, "mit", True), (2, 2, "mit", True), (None, 0, "cc-by-nc-4.0", True), (6, 0, "gpl-3.0", True), (6, 0, "gpl-3.0", True), (7, 1, "cc-by-4.0", True), (8, 0, "mit", True)], key=str)
    assert L.scan(df.where("doc_id > 100")).collect() == []


def plain(text):
    """Family and probability of a paragraph by the model's definition."""
    w, b, t = L.model()
    grams = L.ngrams(L._words(text))
    p = L._softmax({f: (sum(w.get((g, f), 0.0) for g in grams) + b[f]) / t for f in L.TEMPLATES})
    f = max(p, key=lambda x: (p[x], x))
    return f, p[f]


def test_held_out_accuracy():
    variants = L._variants(99, 8)
    w, b, _ = L.model()
    right = sum(max(L.TEMPLATES, key=lambda f: sum(w.get((g, f), 0.0) for g in x) + b[f]) == y for x, y in variants)
    assert right / len(variants) > 0.93
    # lines of other origin, which only set the temperature
    assert sum(plain(t)[0] == f for t, f in L.HELD) / len(L.HELD) > 0.85
    assert len(L.TEMPLATES) > 20


def test_against_plain_python(spark):
    """Scores, similarities and families of lines, by their definition."""
    lines = [t for t, _ in L.HELD] + [t for texts in L.TEMPLATES.values() for t in texts] + ["", "erre thon", "cc cc cc"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)] + [(len(lines) + i, t) for i, t in enumerate(lines[:9] * 3)], "doc_id long, text string")
    want = []
    for r in df.collect():
        f, p = plain(r.text)
        if f != "unknown" and p >= 0.5 and any(a in r.text.lower() for a in L.ANCHORS):
            own = set(L._pairs(L._words(r.text)))
            alike = max(len(own & set(x)) / len(x) for t in L.TEMPLATES[f] if (x := L._pairs(L._words(t))))
            want.append((r.doc_id, f, round(p, 4), round(alike, 4)))
    got = [(r.doc_id, r.family, round(r.probability, 4), round(r.similarity, 4)) for r in L.scan(df).collect()]
    assert sorted(got) == sorted(want)


def test_no_python_on_executors(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = L.scan(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_notices_without_licen(spark):
    """Every line with a feature reaches the classifier, whichever anchor it holds."""
    notices = ["Distributed under GPL-3.0-or-later", "CC BY-NC 4.0", "CC BY 4.0", "Apache-2.0", "BSD 3-Clause", "GNU General Public", "Subject to the terms of the Mozilla Public, v. 2.0."]
    rows = [(i, f"thon\n{x}\nerre") for i, x in enumerate(notices)] + [(99, "erre thon\nApache2 is a server; the account was closed; thon")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(i, k, f, round(p, 5)) for i, text in rows for k, line in enumerate(text.split("\n")) for f, p in [plain(line)] if f != "unknown" and p >= 0.5]
    got = [(r.doc_id, r.paragraph, r.family, round(r.probability, 5)) for r in L.scan(df).collect()]
    assert sorted(got) == sorted(want)
    assert {(0, "gpl-3.0"), (1, "cc-by-nc-4.0"), (3, "apache-2.0")} <= {(d, f) for d, _, f, _ in got}


def test_wrapped_notices(spark):
    """A notice over several lines meets its template whole, at the line where its block begins."""
    gpl, bsd = L.TEMPLATES["gpl-3.0"][1], L.TEMPLATES["bsd-3-clause"][1]
    wrap = lambda t, n, mark="": "\n".join(mark + x for x in textwrap.wrap(t, n))
    rows = [
        (1, "thon: erre\n \t\n\n" + wrap(gpl, 80)),
        (2, "\n" + wrap(bsd, 40, " * ") + "\r\n\r\n" + wrap(gpl, 30, "# ")),
        (3, "7:erre\n" + gpl + "\nthon\n\nReleased under the MIT License.\nReleased under the MIT License."),
        (4, "erre\n\n" * 3000 + wrap(bsd, 14)),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.paragraph, r.family, r.similarity, r.confirmed) for r in L.scan(df).collect())
    second = len(textwrap.wrap(bsd, 40)) + 2
    want = [(1, 3, "gpl-3.0"), (2, 1, "bsd-3-clause"), (2, second, "gpl-3.0"), (3, 1, "gpl-3.0"), (3, 4, "mit"), (3, 5, "mit"), (4, 6000, "bsd-3-clause")]
    assert got == [(*x, 1.0, True) for x in want]
