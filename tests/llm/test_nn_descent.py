import numpy as np
import pytest
from pyspark.sql import functions as F

from veridelta.llm import nn_descent as N


def frame(spark, x, extra=()):
    rows = [(i, v.tolist(), "a", 1) for i, v in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string, node int")


def brute(rows, k, every):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 16 and None not in v and np.isfinite(v).all() and np.any(v):
            ok[i] = np.array(v, np.float32).astype(float)
    out = {}
    for q in ok:
        if q % every == 0:
            s = sorted(((-float(ok[q] @ v / np.linalg.norm(v) / np.linalg.norm(ok[q])), i) for i, v in ok.items() if i != q))
            out[q] = [(i, -c) for c, i in s[:k]]
    return out


def test_odd_vectors_and_copies(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 16)).astype(np.float32)
    x[100:140] = x[3]
    nan = [float("nan")] + [0.0] * 15
    extra = [(1000, None, "a", 1), (1001, [0.0] * 16, "a", 1), (1002, nan, "a", 1), (1003, [None] + [1.0] * 15, "a", 1), (1004, [1.0, 2.0], "a", 1), (None, x[5].tolist(), "a", 1), (7, x[7].tolist(), "a", 1), (1005, [], "a", 1), (1006, [float("inf")] + [1.0] * 15, "a", 1)]
    df = frame(spark, x, extra)
    want = brute([(i, v.tolist()) for i, v in enumerate(x)] + [(e[0], e[1]) for e in extra], 5, 10)
    got = {}
    for row in sorted(N.neighbours(df, F.col("vec_id") % 10 == 0).collect(), key=lambda z: (z.query_id, z.rank)):
        got.setdefault(row.query_id, []).append((row.vec_id, row.score))
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=1e-12)


def test_recall_of_a_graph_built_from_random_groups(spark, monkeypatch):
    monkeypatch.setattr(N, "GROUP", 64)  # lists of 20 begin among 64 of 2,000 vectors
    x = np.random.default_rng(3).normal(size=(2000, 24)).astype(np.float32)
    df = frame(spark, x)
    found = N.neighbours(df, F.col("vec_id") % 20 == 0, list_length=20, ef=64)
    assert N.recall(df, found, F.col("vec_id") % 20 == 0) >= 0.9


def test_rounds_improve_the_lists(spark):
    x = np.random.default_rng(5).normal(size=(1500, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    nodes = spark.createDataFrame([(i, bytearray(v.astype(np.float16).tobytes())) for i, v in enumerate(x)], "node long, h binary")
    near = np.argsort(-(x @ x.T) + 4 * np.eye(len(x)), axis=1)[:, :5]

    def share(rows):
        got = {}
        for r in rows:
            got.setdefault(r.node, set()).update(np.frombuffer(r.nbrs, np.int64).tolist())
        return np.mean([len(set(near[i].tolist()) & got.get(i, set())) / 5 for i in range(len(x))])

    first = share(N._start(nodes, len(x), 12, 4).collect())
    built = share(N.build_graph(nodes, len(x), k=12, sample=8).collect())
    assert built > 0.8 > 0.4 > first > 0


def test_a_hub_and_ties(spark):
    x = np.tile(np.eye(4, 16, dtype=np.float32), (50, 1)) + np.repeat(np.linspace(0, 1e-3, 50, dtype=np.float32), 4)[:, None]
    df = frame(spark, x)
    got = N.neighbours(df, F.col("vec_id") % 10 == 0)
    want = brute([(i, v.tolist()) for i, v in enumerate(x)], 5, 10)
    scores = {}
    for r in got.collect():
        scores.setdefault(r.query_id, []).append(r.score)
    for q in want:
        assert sorted(scores[q], reverse=True) == pytest.approx([s for _, s in want[q]], abs=1e-5)


def test_few_and_no_rows(spark):
    df = frame(spark, np.eye(3, 16, dtype=np.float32))
    got = N.neighbours(df, F.col("vec_id") == 0).collect()
    assert [(r.rank, r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank)] == [(1, 1, 0.0), (2, 2, 0.0)]
    assert N.neighbours(df.where("vec_id > 9"), F.lit(True)).collect() == []


def test_blocks_exchange_a_row_for_each_two_of_them(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 200)
    x = np.random.default_rng(6).normal(size=(1200, 16)).astype(np.float32)
    df = frame(spark, x)
    rows, stored = [], N.B.stored

    def counted(out, name, *rest):
        out = stored(out, name, *rest)
        rows.append((name, out.count() if name in ("links", "graph", "beams", "met") else 0))
        return out

    monkeypatch.setattr(N.B, "stored", counted)
    found = N.neighbours(df, F.col("vec_id") % 20 == 0, list_length=20, ef=64)
    assert {"links", "graph"} <= {name for name, _ in rows}
    assert max(n for _, n in rows) <= 6 * 6 + 6 * 13  # and not one for each of 1,200 nodes
    assert N.recall(df, found, F.col("vec_id") % 20 == 0) >= 0.9
