import math
import random

import pytest
from pyspark.sql import functions as F

from veridelta.operators import embed as E
from veridelta.operators import judge as J
from veridelta.operators import match as M
from veridelta.operators import score as S
from veridelta.plans.compare import CompareConfig, compare

VERDICT = "a_text string, b_text string, similarity double, explanation string"


def scored(spark, a, b, verdicts=(), judge=None):
    rows = [(s, i, t, e) for s, side in (("A", a), ("B", b)) for i, (t, e) in enumerate(side)]
    df = spark.createDataFrame(rows, "doc_id string, index int, text string, embedding array<double>")
    chunks = df.select("doc_id", F.lit("sentence").alias("granularity"), "index", "text", F.lit(1).alias("page"), F.lit("").alias("section"), F.greatest(F.lit(1), F.size(F.split("text", " "))).cast("double").alias("weight"), "embedding")
    pairs = spark.createDataFrame([(1, "A", "B")], "pair_id int, doc_a string, doc_b string")
    matched = M.greedy_grouped(M.dense_cosine(pairs, chunks))
    j = judge or (J.table_judge(spark.createDataFrame(list(verdicts), VERDICT)) if verdicts else None)
    rows = S.changes(pairs, chunks, S.rescored(S.attach(pairs, chunks, matched), j))
    return S.summary(pairs, rows, ("sentence",)).first(), rows.collect()


def test_identical(spark):
    s, rows = scored(spark, [("the cat sat", [1.0, 0.0])], [("the cat sat", [1.0, 0.0])])
    assert s.similarity_pct == 100.0 and [r.kind for r in rows] == ["same"]


def test_reworded(spark):
    s, rows = scored(spark, [("payment due in 30 days", [1.0, 0.0])], [("must be paid within thirty days", [0.8, 0.3])], [("payment due in 30 days", "must be paid within thirty days", 0.98, "equivalent")])
    assert s.similarity_pct == pytest.approx(98.0) and rows[0].kind == "same" and s.judged_pairs == 1


def test_negation(spark):
    a, b = "the tenant must pay the deposit", "the tenant must not pay the deposit"
    s, rows = scored(spark, [(a, [1.0, 0.0])], [(b, [0.9, 0.2])], [(a, b, 0.1, "obligation inverted")])
    assert s.similarity_pct == pytest.approx(10.0) and rows[0].kind == "changed" and "inverted" in rows[0].explanation


def test_added_and_deleted(spark):
    s, rows = scored(spark, [("alpha beta gamma", [1.0, 0.0])], [("delta epsilon zeta", [0.0, 1.0])])
    assert s.similarity_pct == 0.0 and sorted(r.kind for r in rows) == ["added", "deleted"]


def test_weighting(spark):
    long = " ".join(["word"] * 50)
    s, _ = scored(spark, [("ok", [1.0, 0.0]), (long, [0.0, 1.0])], [("no", [0.8, 0.3]), (long, [0.0, 1.0])], [("ok", "no", 0.0, "")])
    assert s.similarity_pct == pytest.approx(100 * 50 / 51)


def test_missing_and_failed_verdicts(spark):
    a, b = [("x", [1.0, 0.0])], [("y", [0.8, 0.3])]
    s, rows = scored(spark, a, b, [("other", "pair", 1.0, "")])
    assert (rows[0].similarity, rows[0].explanation) == (0.5, "?")
    for failed in (math.nan, None):
        s, rows = scored(spark, a, b, [("x", "y", failed, "why")])
        assert rows[0].similarity == pytest.approx(0.8 / math.hypot(0.8, 0.3)) and rows[0].explanation == "why" and s.judged_pairs == 1


def test_band_is_split_before_the_judge(spark):
    calls = spark.sparkContext.accumulator(0)

    class Counting:
        def judge_batch(self, pairs):
            calls.add(len(pairs))
            return [(0.7, "n") for _ in pairs]

    rows = spark.createDataFrame([(0.5, "a", "b"), (0.99, "a", "b"), (0.4999, "a", "b"), (0.9901, "a", "b")], "s double, a_text string, b_text string")
    got = sorted((r.s, r.similarity, r.judged) for r in S.rescored(rows, J.batched_judge(Counting)).collect())
    assert got == [(0.4999, 0.4999, False), (0.5, 0.7, True), (0.99, 0.7, True), (0.9901, 0.9901, False)] and calls.value == 2


def test_generative_judges_and_verdicts(monkeypatch):
    assert J.parse_verdict('x {"similarity": 2, "explanation": " e "} y') == (1.0, "e")
    assert J.parse_verdict('{"similarity": NaN}') == (1.0, "")
    g = J.Generative(lambda prompt: '{"similarity": 0.3, "explanation": "n"}' if "A: p" in prompt else "none")
    (s, e), (t, why) = g.judge_batch([("p", "q"), ("r", "q")])
    assert (s, e) == (0.3, "n") and math.isnan(t) and "judge error" in why
    monkeypatch.setenv("ANTHROPIC_API_KEY", "k")
    sent = []
    post = lambda url, body, headers, timeout: sent.append((url, body, headers)) or {"content": [{"text": '{"similarity": 1}'}]}
    make, model = J.BACKENDS["anthropic"]
    assert J.Generative(make(model, post)).judge_batch([("a", "b")]) == [(1.0, "")] and sent[0][1]["max_tokens"] == 256
    monkeypatch.delenv("ANTHROPIC_API_KEY")
    with pytest.raises(RuntimeError):
        J.judge("anthropic")
    with pytest.raises(ValueError):
        J.judge("oracle")


def test_http_embedder(monkeypatch):
    with pytest.raises(RuntimeError):
        E.embedder("voyage")
    with pytest.raises(ValueError):
        E.embedder("abacus")
    monkeypatch.setenv("K", "v")
    sizes = []
    e = E.HttpEmbedder("x", "u", "K", "m", lambda url, body, headers, timeout: sizes.append(len(body["input"])) or {"data": [{"embedding": [float(len(t))]} for t in body["input"]]})
    assert e.embed(["a" * (i % 5) for i in range(130)]) == [[float(i % 5)] for i in range(130)] and sizes == [128, 2]


def test_hash_features(spark):
    import zlib

    text = "The the CAT 42 straße ÀÉ--x"
    df = spark.createDataFrame([("d", "g", 0, text)], "doc_id string, granularity string, index int, text string")
    want = {}
    for t in ["the", "the", "cat", "42", "straße", "àé", "x"]:
        h = zlib.crc32(t.encode())
        want[h % 1024] = want.get(h % 1024, 0) + (1 if h >> 16 & 1 else -1)
    assert {r.bucket: r.v for r in E.hash_features(df).collect()} == {k: v for k, v in want.items() if v}


def plain(cands):
    a, b, out = set(), set(), []
    for s, i, j in sorted(cands, reverse=True):
        if i not in a and j not in b:
            a.add(i)
            b.add(j)
            out.append((i, j))
    return sorted(out)


def test_greedy_strategies_agree(spark):
    r = random.Random(7)
    groups = {0: [(1.0, 0, 0), (1.0, 1, 1), (1.0, 1, 0), (0.9, 0, 1)]}
    for g in range(1, 5):
        groups[g] = [(r.choice([0.5, 0.6, 0.7, 1.0]), i, j) for i in range(12) for j in range(9) if r.random() < 0.6]
    rows = [(g, "x", i, j, s) for g, c in groups.items() for s, i, j in c]
    df = spark.createDataFrame(rows, "pair_id int, granularity string, i int, j int, s double")
    spark.sparkContext.setCheckpointDir("/tmp/veridelta-tests")
    for name, f in M.STRATEGIES.items():
        got = {}
        for x in f(df).collect():
            got.setdefault(x.pair_id, []).append((x.i, x.j))
        assert {g: sorted(v) for g, v in got.items()} == {g: plain(c) for g, c in groups.items()}, name
    assert plain(groups[0]) == [(0, 0), (1, 1)]


BLOCK = "doc_id string, block_ord int, page int, text string, is_heading boolean"


def test_degenerate_and_swapped_documents(spark):
    docs = {"e1": [], "e2": [], "n": ["---"], "m": ["---"], "a": ["one two three", "four five six seven"], "b": ["one two four", "eight nine"]}
    blocks = spark.createDataFrame([(d, i, 1, t, False) for d, ts in docs.items() for i, t in enumerate(ts)], BLOCK)
    pairs = spark.createDataFrame([(0, "e1", "e2"), (1, "e1", "a"), (2, "n", "m"), (3, "a", "b"), (4, "b", "a"), (5, "a", "a")], "pair_id int, doc_a string, doc_b string")
    c = compare(pairs, blocks, CompareConfig.of("paragraph"))
    pct = {r.pair_id: r.similarity_pct for r in c.summary.collect()}
    assert pct[0] == 100 and pct[1] == 0 and pct[2] == 0 and pct[5] == 100 and pct[3] == pytest.approx(pct[4])
    kinds = {}
    for r in c.changes.collect():
        kinds.setdefault(r.pair_id, []).append(r.kind)
    assert sorted(kinds[2]) == ["added", "deleted"]
    swap = {"added": "deleted", "deleted": "added"}
    assert sorted(kinds[3]) == sorted(swap.get(k, k) for k in kinds[4])
    zero = compare(pairs, blocks, CompareConfig.of("paragraph", match_floor=0.0)).summary.where("pair_id = 2").first()
    assert zero.n_a == 1 and zero.similarity_pct == 0
    for bad in ({"match_floor": -0.1}, {"strategy": "x"}):
        with pytest.raises(ValueError):
            CompareConfig(**bad)


def test_reports(spark):
    import json

    blocks = spark.createDataFrame([("a", 0, 1, "Title", True), ("a", 1, 1, "the quick brown fox jumps", False), ("a", 2, 2, "only here", False), ("b", 0, 1, "Title", True), ("b", 1, 1, "the quick brown fox sleeps", False)], BLOCK)
    pairs = spark.createDataFrame([(0, "a", "b")], "pair_id int, doc_a string, doc_b string")
    c = compare(pairs, blocks, CompareConfig())
    text, md, js = (c.reports(f).first().report for f in ("text", "md", "json"))
    assert text.startswith("PDF semantic comparison\n  A: a\n  B: b\n  embed: hash:1024   judge: none\n\nSIMILARITY  section=")
    assert "── PARAGRAPH ★ " in text and "[CHANGED · sim 0.80 · 5w · Title]" in text and '[DELETED · Title] "only here"' in text
    assert "| paragraph ★ |" in md and "- **DELETED** · Title: only here" in md
    data = json.loads(js)
    assert list(data["granularities"]) == ["section", "paragraph", "sentence"]
    changes = data["granularities"]["paragraph"]["changes"]
    assert [(x["kind"], x["similarity"]) for x in changes] == [("changed", 0.8), ("deleted", None)] and changes[0]["explanation"] is None
    with pytest.raises(ValueError):
        c.reports("html")


def test_json_rounds_halves_as_sql():
    import duckdb

    from veridelta.operators.report import Pair, rounded

    values = [3.125, 0.375, 99.625, 2.675, 1.005, 0.00005, 0.12345, -3.125, 100 * (1 - 31 / 32), 50.0, 0.0]
    for digits in (2, 4):
        want = duckdb.execute(f"SELECT round(unnest(?::DOUBLE[]), {digits})", [values]).fetchall()
        assert [rounded(x, digits) for x in values] == [x for (x,) in want]
    level = {"granularity": "paragraph", "similarity_pct": 3.125, "difference_pct": 96.875, "n_a": 1, "n_b": 1, "judged_pairs": 0, "n_same": 0, "changes": []}
    assert '"similarity_pct": 3.13,' in Pair("1", "2", "e", "none", "paragraph", [level]).json()
    assert rounded(float("inf"), 2) == float("inf")
