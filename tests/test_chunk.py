import random
import re

import pytest
from pyspark.sql import functions as F

from veridelta.functions import text as X
from veridelta.operators import chunk as C

SCHEMA = "doc_id string, block_ord int, page int, text string, is_heading boolean"


def blocks(spark, *rows):
    return spark.createDataFrame([("d", i, 1 + i // 3, t, h) for i, (t, h) in enumerate(rows)], SCHEMA)


def texts(df):
    return [(r.text, r.section) for r in df.orderBy("index").collect()]


def test_sentences(spark):
    df = blocks(spark, ('See Dr. Smith. He said "stop." Then 3 left. ok no', False), ("  A b! (C) d?  ", False), ("", False))
    got = [r.text for r in C.chunk(df, "sentence").orderBy("index").collect()]
    assert got == ["See Dr.", "Smith.", 'He said "stop.', "Then 3 left. ok no", "A b!", "(C) d?"]
    kept = [r.text for r in C.sentences(df, respect_abbreviations=True).orderBy("index").collect()]
    assert kept[0] == "See Dr. Smith."


def test_sections(spark):
    df = blocks(spark, ("intro see SECTION 2.1 now", False), ("more", False), ("Head A", True), ("Head B", True), ("text", False))
    assert texts(C.chunk(df, "section")) == [("intro see SECTION 2.1 now more", "SECTION 2.1"), ("Head A", "Head A"), ("Head B text", "Head B")]
    flat = blocks(spark, ("a", False), ("b", False))
    assert texts(C.chunk(flat, "section")) == [("a b", "")]


def test_paragraph_labels_and_cap(spark):
    df = blocks(spark, ("x", False), ("Head", True), ("in subsection 3 we", False), ("y", False))
    assert texts(C.chunk(df, "paragraph")) == [("x", ""), ("Head", "Head"), ("in subsection 3 we", "section 3"), ("y", "Head")]
    assert texts(C.chunk(df, "paragraph", 2)) == [("x", ""), ("Head", "Head")]
    for bad in (0, -1):
        with pytest.raises(ValueError):
            C.chunk(df, "paragraph", bad)
    with pytest.raises(ValueError):
        C.chunk(df, "word")


def test_words_as_python_splits(spark):
    r = random.Random(0)
    rows = ["".join(r.choice(["a", "é", " ", "\t", " ", "\x1c", "\n", " ", "b"]) for _ in range(r.randint(0, 20))) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in rows], "t string").select("t", X.word_weight("t").alias("w"), X.strip("t").alias("s"), X.trimmed(F.repeat("t", 20)).alias("c"))
    for x in df.collect():
        assert x.w == max(1, len(x.t.split())) and x.s == x.t.strip()
        flat = " ".join((x.t * 20).split())
        assert x.c == (flat if len(flat) <= 100 else flat[:99] + "…")


def test_sentences_match_a_plain_pattern(spark):
    r = random.Random(1)
    rows = ["".join(r.choice(["A", "b", ".", "!", "?", '"', "'", ")", "]", "(", " ", " ", "\n", "9"]) for _ in range(r.randint(0, 30))) for _ in range(300)]
    plain = re.compile(r"""(?<=[.!?])["')\]]?\s+(?=["'(\[]?[A-Z0-9])""")
    got = spark.createDataFrame([(t,) for t in rows], "t string").select("t", X.sentences("t").alias("s")).collect()
    for x in got:
        assert x.s == [p.strip() for p in plain.split(x.t) if p.strip()]
