import random
import re

import corpus_pipeline as C
from pyspark.sql import functions as F

from veridelta.llm import mixture


def corpus(n=160):
    r = random.Random(9)
    vocab = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "pu", "ra", "so", "ti") for b in ("bel", "dor", "fan", "gus", "hin")]
    items = [(i, " ".join(r.choice(vocab) for _ in range(14))) for i in range(5)]
    docs, labels, kinds = [], [], {}
    for d in range(n):
        w = [r.choice(vocab) for _ in range(60)]
        kind = ["plain", "plain", "plain", "toxic", "copy", "leak", "private", "plain"][d % 8]
        if kind == "toxic":
            for _ in range(4):
                w[r.randrange(60)] = r.choice(["idiot", "moron", "1d10t", "m0r0n"])
        if kind == "copy":
            w = docs[d - 4][1].split()
            w[3] = "changed"
        if kind == "leak":
            w[20:20] = r.choice(items)[1].split()
        if kind == "private":
            w[10] = f"mail{d}@example.com"
        kinds[d] = kind
        docs.append((d, " ".join(w), "en", f"s{d % 3}", 0))
        labels.append((d, 1, int(kind == "toxic")))
    return docs, labels, items, kinds


def shingles(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_stages_against_brute_force(spark, tmp_path):
    docs, labels, items, kinds = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    text = {d: t for d, t, *_ in docs}
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in C.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == [c.split()[0] for c in schema.split(", ")]
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r.doc_id: r for r in now.collect()}
    assert set(seen["toxicity"]) == {d for d in kinds if kinds[d] != "toxic"}
    left = set()
    for d in sorted(seen["toxicity"]):
        if not any(len(shingles(text[d]) & shingles(text[e])) >= 0.8 * len(shingles(text[d]) | shingles(text[e])) for e in left):
            left.add(d)
    assert set(seen["near-duplicates"]) == left
    passages = [tuple(t.split()[i : i + 10]) for _, t in items for i in range(5)]
    clean = {d for d in left if not any(re.search(rf"\b{' '.join(p)}\b", text[d]) for p in passages)}
    assert set(seen["decontamination"]) == clean
    for d, r in seen["personal-data"].items():
        assert r.text == re.sub(r"mail\d+@example\.com", "[EMAIL]", text[d]) and r.n_chars == len(r.text)
    mixed = C.mix_sources(spark, now, str(tmp_path)).collect()
    plain = {r.doc_id: r.copies for r in mixture.mix(now, seed=7).collect()}
    assert {r.doc_id for r in mixed} <= clean and all(plain[r.doc_id] == r.copies for r in mixed)
    whole = C.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.copy) for r in whole.collect()) == sorted((r.doc_id, r.copy) for r in mixed)


def test_empty_and_null_rows(spark, tmp_path):
    docs, labels, items, _ = corpus(24)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    plain = "lobel midor kafan puhin ragus sobel tidor nefan"
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    data = [(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "de", None, 0), (1, "", "en", None, 0), (1, plain, "en", "a", 1), (2, f"other words here {plain}", "en", "a", 1), (3, plain.upper(), "en", "a", 1), (None, plain, "en", "a", 1)]
    rows = spark.createDataFrame(data, schema)
    kept = {}
    df = rows
    for name, stage in C.STAGES[:-1]:
        df = stage(spark, df, str(tmp_path))
        kept[name] = sorted(((r.doc_id, r.text, r.lang) for r in df.collect()), key=str)
    assert kept["toxicity"] == sorted(((d, t, x) for d, t, x, *_ in data), key=str)
    # 3 is a copy of a row of 1; rows of 1 with different texts stay, equal ones once, by their other columns
    left = [(1, "", "de"), (1, plain, "en"), (2, f"other words here {plain}", "en"), (None, None, None), (None, plain, "en")]
    assert kept["near-duplicates"] == kept["decontamination"] == kept["personal-data"] == sorted(left, key=str)
    empty = rows.where(F.lit(False))
    for _, stage in C.STAGES:
        empty = stage(spark, empty, str(tmp_path))
    assert empty.collect() == []


def test_very_long_texts(spark, tmp_path):
    docs, labels, items, _ = corpus(24)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    filler = " ".join(f"w{i}" for i in range(60_000))
    late = {1: f"{filler} {items[0][1]}", 2: f"{filler.replace('w', 'v')} mail@example.com", 3: f"x{filler}"}
    spark.createDataFrame([(d, t, "en", "s", 0) for d, t in late.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in C.STAGES[1:-1]:
        df = stage(spark, df, str(tmp_path))
    # 3 is a near copy of 1, whose passage of the benchmark stands at its very end
    assert {r.doc_id: r.text[-7:] for r in df.collect()} == {2: "[EMAIL]"}
