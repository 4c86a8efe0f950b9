import hashlib
import random
import re

from veridelta.llm.substring_dedup import dedup_substrings
from tests.llm.collisions import thue_morse, thue_morse_words


def brute(rows, k):
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first = {}
    for d, w in words:
        for i in range(len(w) - k + 1):
            g = tuple(w[i : i + k])
            if d is not None:
                first[g] = min(first.get(g, d), d)
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - k + 1):
            if d is not None and first[tuple(w[i : i + k])] < d:
                gone.update(range(i, i + k))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, k):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, block string, bucket int")
    return sorted((tuple(r) for r in dedup_substrings(df, k, digest=True).collect()), key=str)


def corpus(seed, n=60):
    r = random.Random(seed)
    shared = [" ".join(r.choice("abcdefg") for _ in range(r.randint(3, 25))) for _ in range(8)]
    rows = []
    for d in range(n):
        parts = [r.choice(shared) if r.random() < 0.5 else " ".join(r.choice(["q", "é", "zz", f"u{d}_{i}"]) for i in range(r.randint(0, 12))) for _ in range(r.randint(0, 5))]
        rows.append((d, r.choice([" ", "\n", "\t "]).join(parts)))
    return rows + [(n, rows[3][1]), (n + 1, ""), (n + 2, None), (None, rows[3][1]), (5, rows[5][1]), (5, rows[6][1])]


def test_matches_brute_force(spark):
    for seed, k in ((1, 5), (2, 13)):
        rows = corpus(seed)
        assert run(spark, rows, k) == brute(rows, k)


def test_periodic_and_long_texts(spark):
    rows = [(1, "a " * 5000), (2, "a " * 40), (3, "b a " * 30), (4, "x y"), (5, "b a " * 3000)]
    assert run(spark, rows, 13) == brute(rows, 13)


def test_empty_table(spark):
    assert run(spark, [], 13) == []


def test_regular_texts_do_not_collide(spark):
    x, y = thue_morse_words()
    one, other = thue_morse(10, "left", "right")
    rows = [(1, " ".join([x] * 14)), (2, " ".join([y] * 14)), (3, " ".join(one)), (4, " ".join(other)), (5, " ".join([f"{x}{i}" for i in range(20)])), (6, " ".join([f"{y}{i}" for i in range(20)]))]
    assert run(spark, rows, 13) == brute(rows, 13)


def test_spans_are_compared_by_their_words(spark, monkeypatch):
    """Windows that hash alike are no repetition where the words differ."""
    import numpy as np

    from veridelta.llm import substring_dedup as S
    from veridelta.llm import tokens as T

    w = next(T.words(pa_array(["a b c d", "a  b\tc e"]), T.whitespace_words(), T.as_written()))
    same = S._digests(w, np.array([0, 4]), np.array([2, 6]))
    differ = S._digests(w, np.array([0, 4]), np.array([3, 7]))
    assert same[0] == same[1] and differ[0] != differ[1] and len(same[0]) == 16


def pa_array(texts):
    import pyarrow as pa

    return pa.array(texts)
