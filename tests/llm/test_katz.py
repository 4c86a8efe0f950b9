import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridelta.llm import katz as K
from veridelta.llm import queries as Q
from veridelta.llm.katz import discounts, fit, katz_scores
from tests.llm.collisions import thue_morse_words


class Plain:
    """The model in plain Python, by its definition."""

    def __init__(self, texts, order):
        self.order = order
        self.c = [Counter() for _ in range(order + 1)]
        for w in texts:
            w = ["<s>"] * (order - 1) + w + ["</s>"]
            for i in range(order - 1, len(w)):
                for k in range(1, order + 1):
                    self.c[k][tuple(w[i - k + 1 : i + 1])] += 1
        self.d = [None]
        for k in range(1, order + 1):
            n = Counter(self.c[k].values())
            self.d.append(discounts([n[r] if r else 0 for r in range(7)]))
        self.N, self.V = sum(self.c[1].values()), len(self.c[1])
        taken = sum(self.dc(1, c) for c in self.c[1].values())
        self.den = self.N if self.N - taken > 1e-12 * self.N else self.N + 1
        self.unk = 1 - taken / self.den
        self.seen = [defaultdict(list) for _ in range(order + 1)]
        for k in range(2, order + 1):
            for g, c in self.c[k].items():
                self.seen[k][g[:-1]].append((g[-1], c))

    def dc(self, k, c):
        return c * (self.d[k][c] if c <= 5 else 1)

    def p(self, h, w):
        k = len(h) + 1
        if k == 1:
            c = self.c[1][(w,)]
            return self.dc(1, c) / self.den if c else self.unk
        seen = self.seen[k].get(h)
        if not seen:
            return self.p(h[1:], w)
        n, taken = sum(c for _, c in seen), sum(self.dc(k, c) for _, c in seen)
        if n - taken <= 1e-12 * n:
            n += 1
        if c := self.c[k][(*h, w)]:
            return self.dc(k, c) / n
        return (1 - taken / n) / (1 - sum(self.p(h[1:], x) for x, _ in seen)) * self.p(h[1:], w)

    def score(self, w):
        w = ["<s>"] * (self.order - 1) + w + ["</s>"]
        return sum(math.log10(self.p(tuple(w[i - self.order + 1 : i]), w[i])) for i in range(self.order - 1, len(w)))


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def corpus(n=80):
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(60)]
    rows = [(d, " ".join(vocab[min(int(r.expovariate(0.12)), 59)] for _ in range(r.randint(0, 40)))) for d in range(n)]
    return rows + [(n, None), (n + 1, "Unknown WORDS w1\tW2"), (None, "w1"), (3, "w1 w2")]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_matches_definition(spark, order):
    rows = corpus()
    held = {d: zlib.crc32(str(d).encode() if d is not None else b"") % 7 == 2 for d, _ in rows}
    m = Plain([words(t) for d, t in rows if not held[d]], order)
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, order int")
    got = katz_scores(df, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 != 2, order).collect()
    want = []
    for d, t in rows:
        w = words(t)
        c = [m.c[1][(x,)] for x in [*w, "</s>"]]
        want.append((d, held[d], len(w) + 1, sum(x > 0 for x in c), m.N, round(sum(math.log10((x + 1) / (m.N + m.V + 1)) for x in c), 7), round(m.score(w), 7)))
    assert sorted(((*r[:5], round(r[5], 7), round(r[6], 7)) for r in got), key=str) == sorted(want, key=str)


def test_probabilities_sum_to_one():
    m = Plain([words(t) for _, t in corpus()], 3)
    types = [w for (w,) in m.c[1]] + ["never"]
    for h in [("w0", "w1"), ("w3", "nothing"), ("w55", "w56")]:
        assert sum(m.p(h, w) for w in types) == pytest.approx(1)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert katz_scores(df, F.lit(True)).collect() == []
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    (r,) = katz_scores(df, F.lit(False)).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 3, 0, 0, 0, 0)


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_registered_query_is_a_trigram_model(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    held = {d: zlib.crc32(str(d).encode() if d is not None else b"") % 7 == 2 for d, _ in rows}
    m = Plain([words(t) for d, t in rows if not held[d]], 3)
    got = Q.op5_katz(spark, SF).collect()
    assert sorted(((r.doc_id, round(r.score, 5)) for r in got), key=str) == sorted(((d, round(m.score(words(t)), 5)) for d, t in rows), key=str)


def test_regular_and_very_long_words(spark):
    x, y = thue_morse_words()
    rows = [(1, f"{x} {x} stone"), (2, y), (3, f"{x} {y} {x}"), (4, "river stone " * 40_000), (5, "z" * 200_000)]
    held = {d: d in (2, 3) for d, _ in rows}
    m = Plain([words(t) for d, t in rows if not held[d]], 3)
    got = katz_scores(spark.createDataFrame(rows, "doc_id long, text string"), ~F.col("doc_id").isin(2, 3), 3).collect()
    for r in got:
        w = words(dict(rows)[r.doc_id])
        assert (r.n_tokens, r.n_known) == (len(w) + 1, sum(m.c[1][(z,)] > 0 for z in [*w, "</s>"]))
        assert r.score == pytest.approx(m.score(w), abs=1e-4)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_fitted_model_scores_new_texts(spark, order):
    rows = corpus()
    m = Plain([words(t) for _, t in rows], order)
    model = fit(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(True), order)
    new = [(1, "w0 w1 w2 w3"), (1, "w1 never w2 W3"), (2, ""), (None, None), (3, rows[5][1]), (4, "nothing known here at all")]
    got = model.score(spark.createDataFrame(new, "doc_id long, text string")).collect()
    want = [(d, len(words(t)) + 1, round(m.score(words(t)), 7)) for d, t in new]
    assert sorted(((r.doc_id, r.n_tokens, round(r.score, 7)) for r in got), key=str) == sorted(want, key=str)
    assert model.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    kinds = {(r.kind, r.order) for r in model.table.select("kind", "order").distinct().collect()}
    assert kinds == {("count", k) for k in range(1, order + 1)} | {("alpha", k) for k in range(2, order + 1)}


@pytest.mark.parametrize("order", [2, 3])
def test_what_one_block_alone_has_is_not_exchanged(spark, order):
    rows = [(d, " ".join(f"x{d}y{i}" for i in range(50)) + " a b c a b d") for d in range(60)]
    blocks, n = K._blocks(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(True), 9)
    model, got = K._learned(blocks, order, n, False)
    sent = Counter()
    for r in got.where("block >= 0").collect():
        sent[r.kind, r.order] += len(K.B.unplanes(K.B.unsqueezed(r.answer), "i8" if r.kind == "count" else "c16"))
    # words that one text has are 3,000 of 3,005; longer ones are sent where all their words are other texts' too
    assert sent["count", 1] >= 3000 and sent["count", order] <= n * 10 and sent["alpha", order] <= n * 10
    assert model.total == 60 * 57


def test_index_of_values_that_share_high_bits():
    r = np.random.default_rng(1)
    for x in (r.integers(0, 9, 3000), r.integers(0, 2**63, 40).repeat(50) ^ r.integers(0, 3, 2000), r.integers(0, 2**64, 1000, dtype=np.uint64), 2**64 - 1 - r.integers(0, 4, 100).astype(np.uint64), np.zeros(0)):
        x = x.astype(np.uint64)
        i = K._Index(x)
        assert (i.keys == np.unique(x)).all() and (i.keys[i.place] == x).all() and (x[i.one] == i.keys).all()


def test_alpha_goes_only_to_blocks_that_back_off(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcdef") for _ in range(12))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def answers(train):
        blocks, n = K._blocks(docs, train, 9)
        got = K._learned(blocks, 3, n, False)[1].where("kind = 'alpha'").select("answer").collect()
        return np.concatenate([K.B.unplanes(K.B.unsqueezed(r[0]), np.complex128) for r in got])

    all_seen, some_unseen = answers(F.lit(True)), answers(F.col("doc_id") % 7 != 2)
    assert (all_seen.real > 0).any() and not all_seen.imag.any()
    assert (some_unseen.imag > 0).any()
