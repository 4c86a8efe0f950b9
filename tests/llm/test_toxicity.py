import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from veridelta.llm import toxicity as X

BAD = ["idiot", "worthless", "stupid", "moron", "trash", "pathetic"]
GOOD = ["window", "letter", "garden", "river", "stone", "planet", "market", "silver", "button", "coffee", "a", "of"]


def trigrams(words):
    n = Counter()
    for w in words:
        s = "^^" + w + "$"
        n.update(s[i : i + 3] for i in range(len(s) - 2))
    return n


def chars():
    return X.CharModel({t: 50 * n for t, n in trigrams(BAD + GOOD).items()})


def test_viterbi_restores():
    m = chars()
    for written, plain in {"1d10t": "idiot", "w0rthl3$$": "worthless", "stuuupid": "stupid", "m0r0n": "moron", "tr@$h": "trash", "path3t1c": "pathetic", "coffee": "coffee", "idiiiot": "idiot"}.items():
        assert m.decode(written) == plain


def test_suspicious_stretches():
    texts = pa.array(["an 1d10t! i d i o t and s.t.u.p.i.d stuuupid that$$$ 12345 plain bees", ""])
    known = np.zeros(0, np.uint64)
    got = [w for p in X._pieces(texts) for _, w, _ in p.suspicious(known)]
    assert sorted(got) == sorted(["1d10t", "stuuupid", "idiot", "stupid"])


def test_viterbi_against_all_paths():
    m = chars()

    def best(written, h="^^", last="", word=""):
        if not written:
            return m.logp(h, "$"), word
        ch, rest = written[0], written[1:]
        letters = [(c, X.LEET) for c in X.LOOKALIKES.get(ch, "")] + ([(ch, X.SAME)] if X._is_letter(ch) else [])
        options = []
        for c, cost in letters:
            s, w = best(rest, h[1] + c, c, word + c)
            options.append((cost + m.logp(h, c) + s, w))
            if c == last:
                s, w = best(rest, h, c, word)
                options.append((cost + X.DROPPED + s, w))
        if not letters or not X._is_letter(ch):
            s, w = best(rest, h, last, word)
            options.append(((X.KEPT if letters else X.DROPPED) + s, w))
        return max(options, key=lambda x: x[0])

    r = random.Random(4)
    for _ in range(60):
        written = "".join(r.choice("idotssee01!3$5-") for _ in range(r.randint(1, 7)))
        assert m.decode(written) == best(written)[1]


def test_letter_trigrams_of_all_texts(spark):
    texts = ["Stone River", "stone  x1 st0ne", "ñandú", None, "", "a"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    plain = ["stone", "river", "stone", "ñandú".encode().decode("latin-1"), "a"]
    assert X.letter_trigrams(docs) == dict(trigrams(plain))
    assert X.letter_trigrams(docs.where("doc_id > 9")) == {}


def test_signs_alone_are_decoded_and_numbers_are_not():
    known = np.zeros(0, np.uint64)
    got = [w for p in X._pieces(pa.array(["an @55 of 2019 and i - d - i"])) for _, w, _ in p.suspicious(known)]
    assert sorted(got) == ["@55", "idi"]


def test_ties_and_repeated_rows(spark):
    docs, labels = data(spark, 120)
    split = F.lit(True)
    one = X.fit(docs, labels, split)
    again = X.fit(docs.union(docs), labels.union(labels), split)
    text = pa.array(["a worthless stone of a river", "m0r0n", ""])
    # repeated rows teach once; the character model counts them twice
    assert np.allclose(one.score(text), again.score(text), atol=0.05)


def data(spark, n=600):
    r = random.Random(1)
    rows, labels = [], []
    for d in range(n):
        w = [r.choice(GOOD) for _ in range(30)]
        y = d % 6 == 0
        if y:
            for _ in range(3):
                bad = r.choice(BAD)
                w[r.randrange(30)] = r.choice([bad, bad, bad, bad.replace("o", "0").replace("i", "1"), " ".join(bad), bad.replace("i", "iii").replace("o", "ooo")])
        rows.append((d, " ".join(w), "x"))
        labels.append((d, None if d == 7 else int(y)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxicity string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = data(spark)
    split = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    m = X.fit(docs, labels, split)
    got = {r.doc_id: r.toxicity for r in X.scored(docs.drop("toxicity"), m).collect()}
    held = [d for d in got if zlib.crc32(str(d).encode()) % 5 == 0]
    assert sum((got[d] >= 0.5) == (d % 6 == 0) for d in held) / len(held) > 0.97
    for bad in ("you 1d10t, a m 0 r 0 n of a river", "so p-a-t-h-e-t-i-c and w0rthl3ss", "stuuupid traaash"):
        assert m.score(pa.array([bad]))[0] >= 0.5


def test_nulls_empty_and_one_label(spark):
    docs, labels = data(spark, 60)
    m = X.fit(docs, labels.where("toxic = 0"), F.lit(True))
    odd = spark.createDataFrame([(1, None), (None, ""), (2, "x" * 100_000), (2, "x")], "doc_id long, text string")
    assert all(0 <= r.toxicity < 0.5 for r in X.scored(odd, m).collect())
    assert X.scored(odd.where("doc_id > 9"), m).collect() == []
    m = X.fit(odd.where("doc_id > 9"), labels.where("toxic > 9"), F.lit(True))
    assert m.score(pa.array([""]))[0] < 0.5
