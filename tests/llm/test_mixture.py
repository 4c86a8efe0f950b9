import math

import pytest
from pyspark.sql import functions as F

from veridelta.llm import mixture as M


def docs(spark, rows):
    return spark.createDataFrame([(d, s, "t", 1) for d, s in rows], "doc_id long, source string, text string, copy int")


def test_rates_and_order(spark):
    rows = [(d, "big") for d in range(6000)] + [(d, "small") for d in range(6000, 7000)] + [(7000, None)]
    df = docs(spark, rows)
    targets = spark.createDataFrame([("big", 1.0), ("small", 3.0), ("never", 5.0)], "source string, weight double")
    got = M.mix(df, targets.where("source <> 'never'"), total=8000, seed=1).collect()
    n = {s: sum(r.source == s for r in got) for s in ("big", "small", None)}
    assert abs(n["big"] - 2000) < 5 * math.sqrt(2000) and abs(n["small"] - 6000) < 5 * math.sqrt(6000) and n[None] == 0
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert all(sorted(r.copy for r in v) == list(range(v[0].copies)) for v in by.values())
    k = [len(by.get(d, [])) for d in range(6000, 7000)]
    mean = sum(k) / 1000
    assert abs(sum((x - mean) ** 2 for x in k) / 1000 - mean) < 1.0  # a Poisson variance
    again = M.mix(df.repartition(7), targets.where("source <> 'never'"), total=8000, seed=1)
    assert sorted((r.doc_id, r.copy, r.order_key) for r in again.collect()) == sorted((r.doc_id, r.copy, r.order_key) for r in got)


def test_inverts_the_distribution(spark):
    df = docs(spark, [(d, "a") for d in range(400)])
    u = {r.doc_id: r.u for r in df.select("doc_id", M.uniform(7, "doc_id", F.lit(1)).alias("u")).collect()}
    got = {r.doc_id: r.copies for r in M.mix(df, total=1000, seed=7).collect()}
    for d, x in u.items():
        p = s = math.exp(-2.5)
        k = 0
        while s <= x:
            k += 1
            p *= 2.5 / k
            s += p
        assert got.get(d, 0) == k


def test_large_rates_and_empty_table(spark):
    got = M.mix(docs(spark, [(1, "a"), (2, "a"), (2, "a"), (None, "a")]), total=2000).groupBy("doc_id").count().collect()
    n = {r.doc_id: r["count"] for r in got}
    assert n[1] == pytest.approx(500, abs=130) and n[2] == pytest.approx(1000, abs=260) and n[None] > 0
    assert M.mix(docs(spark, [])).collect() == []
