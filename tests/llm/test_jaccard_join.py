import random
import re

import pytest

from veridelta.llm import jaccard_join as J
from veridelta.llm.components import components
from tests.llm.collisions import thue_morse, thue_morse_words


def brute(rows, k, percent):
    sets = []
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            da, db = rows[i][0], rows[j][0]
            if a and b and None not in (da, db) and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(da), find(db)
                root[max(x, y)] = min(x, y)
    return sorted(((d, len(s), None if d is None else find(d)) for (d, _), s in zip(rows, sets)), key=str)


def corpus(seed, n=120):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)]
    rows, texts = [], []
    for d in range(n):
        if texts and r.random() < 0.7:
            w = r.choice(texts[-15:]).split()
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                if w:
                    i = r.randrange(len(w))
                    w[i : i + 1] = r.choice([[], [r.choice(vocab)], [w[i], r.choice(vocab)]])
            t = " ".join(w)
        else:
            t = " ".join(r.choice(vocab) for _ in range(r.choice([0, 2, 3, 4, 10, 40, 90])))
        texts.append(t)
        rows.append((d * 3 % (3 * n + 1), t.upper() if r.random() < 0.2 else t))
    return rows + [(1000, None), (1001, ""), (None, rows[5][1]), (1002, "  W1\tw2 ")]


@pytest.mark.parametrize(("seed", "k", "percent", "side"), [(1, 4, 85, 256), (2, 5, 80, 4), (3, 2, 60, 3)])
def test_matches_brute_force(spark, monkeypatch, seed, k, percent, side):
    monkeypatch.setattr(J, "SIDE", side)
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, block int, rep int")
    got = sorted((tuple(r) for r in J.near_duplicates(df, k, percent).collect()), key=str)
    assert got == brute(rows, k, percent)


def test_empty_table(spark):
    assert J.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_a_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(70)] + [(100, 101), (5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {i: 0 for i in range(71)} | {100: 100, 101: 100}


def test_regular_texts_do_not_collide(spark):
    x, y = thue_morse_words()
    one, other = thue_morse(10, "left", "right")
    rows = [(1, x), (2, y), (3, f"{x} {y}"), (4, f"{y} {x}"), (5, " ".join([x] * 9)), (6, " ".join([y] * 9)), (7, " ".join(one)), (8, " ".join(other))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in J.near_duplicates(df, 4, 85).collect()), key=str) == brute(rows, 4, 85)


def test_very_long_texts(spark):
    r = random.Random(9)
    long = [f"w{r.randrange(10**6)}" for _ in range(60_000)]
    near = list(long)
    for i in range(0, 60_000, 600):
        near[i] = f"x{i}"
    rows = [(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(reversed(long))), (4, "w" * 300_000), (5, "W" * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in J.near_duplicates(df, 4, 85).collect()), key=str) == brute(rows, 4, 85)
