import random
import re

from veridelta.llm import decontaminate as D
from tests.llm.collisions import thue_morse_words


def words(t):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute(docs, items, n):
    windows = {}
    for i, t in items:
        w = words(t)
        for p in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[p : p + n]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, got = words(t), set(), set()
        for x, ids in windows.items():
            for p in range(len(w) - len(x) + 1):
                if tuple(w[p : p + len(x)]) == x:
                    hit.update(range(p, p + len(x)))
                    got |= ids
        out.append((d, len(w), len(hit), len(got), D.digest_of(list(got)), bool(hit)))
    return sorted(out, key=str)


def data(spark, docs, items):
    return spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, items string"), spark.createDataFrame([(i, t) for i, t in items], "item_id long, text string")


def corpus(seed):
    r = random.Random(seed)
    items = [(i, " ".join(r.choice(["Ab", "c", "d-e", "É", "9"]) for _ in range(r.choice([0, 2, 3, 5, 9, 14])))) for i in range(12)] + [(99, None), (100, "!?"), (7, "ab c ab")]
    docs = [(d, " ".join(r.choice([r.choice(items)[1] or "", "ab", "c", "zz", "é"]) for _ in range(r.randint(0, 9)))) for d in range(50)]
    return docs + [(50, None), (51, ""), (3, docs[4][1]), (None, docs[5][1]), (52, "ab c " * 4000)], items


def test_phrases(spark):
    for seed, n in ((1, 4), (2, 10)):
        docs, items = corpus(seed)
        d, q = data(spark, docs, items)
        got = D.digest(D.find(D.build_index(d), q, n)).collect()
        assert sorted((tuple(r) for r in got), key=str) == brute(docs, items, n)


def test_query_blocks_give_the_same(spark, monkeypatch):
    docs, items = corpus(3)
    d, q = data(spark, docs, items)
    monkeypatch.setattr(D, "QUERY_ROWS", 5)
    got = D.digest(D.find(D.build_index(d), q, 4)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(docs, items, 4)


def test_proximity(spark):
    docs = [(1, "c x a y b"), (2, "c x a y z z b"), (3, "a b"), (4, "b a c"), (5, "a a c x b")]
    d, q = data(spark, docs, [(1, "a b c")])
    got = {r.doc_id: r.n_hit > 0 for r in D.find(D.build_index(d), q, 3, slop=2).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True, 5: True}


def test_empty_tables(spark):
    d, q = data(spark, [], [])
    assert D.find(D.build_index(d), q).collect() == []
    d, q = data(spark, [(1, "a b")], [])
    assert [tuple(r)[:3] for r in D.find(D.build_index(d), q).collect()] == [(1, 2, 0)]


def test_regular_words_do_not_collide(spark):
    x, y = thue_morse_words()
    docs, items = [(1, f"{x} stone"), (2, f"{y} stone"), (3, " ".join([y] * 12))], [(1, x), (2, " ".join([x] * 12))]
    d, i = data(spark, docs, items)
    got = sorted((tuple(r) for r in D.digest(D.find(D.build_index(d), i, n=10)).collect()), key=str)
    assert got == brute(docs, items, 10)
