"""Judges that score ambiguous pairs again.

A judge is a function from rows with a_text and b_text to the same rows with j_sim and
j_explanation; a null j_sim says that it failed.  Only rows inside the band reach it: the
split is a filter before the call, as expressions do not short-circuit Python.
"""

from __future__ import annotations

import json
import math
import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridelta.operators.embed import post_json

Judge = Callable[[DataFrame], DataFrame]

#: fixed values: the table judge's answer for a pair that it does not list
MISSING = (0.5, "?")

PROMPT = """Two passages, A and B, come from two versions of one document. How close is their meaning? \
Wording, layout and order do not count; negations, other numbers, dates or parties, and new or dropped \
duties count heavily. Answer with one JSON object and nothing else: \
{{"similarity": <number from 0 to 1>, "explanation": "<what changed, or equivalent>"}}
A: {a}
B: {b}"""


def table_judge(verdicts: DataFrame) -> Judge:
    """Looks pairs up in (a_text, b_text, similarity, explanation)."""

    def judge(rows: DataFrame) -> DataFrame:
        v = verdicts.select("a_text", "b_text", F.lit(True).alias("listed_"), F.col("similarity").cast("double").alias("sim_"), F.col("explanation").alias("expl_")).dropDuplicates(["a_text", "b_text"])
        found = rows.join(v, ["a_text", "b_text"], "left")
        sim = F.when(F.col("listed_"), F.col("sim_")).otherwise(MISSING[0])
        expl = F.when(F.col("listed_"), F.coalesce("expl_", F.lit(""))).otherwise(MISSING[1])
        return found.withColumns({"j_sim": F.when(~F.isnan(sim), sim), "j_explanation": expl}).select(*rows.columns, "j_sim", "j_explanation")

    return judge


def parse_verdict(raw: str) -> tuple[float, str]:
    """Similarity clamped to [0, 1] and explanation from the outermost braces of an answer; raises where there are none.

    A parsed NaN counts as 1.0, as clamping by comparisons makes it.
    """
    raw = raw.strip()
    lo, hi = raw.find("{"), raw.rfind("}")
    data = json.loads(raw[lo : hi + 1] if 0 <= lo < hi else raw)
    sim = float(data.get("similarity"))
    return (1.0 if math.isnan(sim) else min(1.0, max(0.0, sim))), str(data.get("explanation", "")).strip()


def parsed(raw: F.Column) -> F.Column:
    """The same natively: struct(similarity, explanation), or null where the answer has no usable object."""
    text = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    text = F.regexp_replace(text, r":\s*(-?(?:NaN|Infinity))", ': "$1"')
    j = F.from_json(text, "similarity string, explanation string")
    sim = j["similarity"].try_cast("double")
    clamped = F.when(F.isnan(sim), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), sim)))
    return F.when(sim.isNotNull(), F.struct(clamped.alias("similarity"), F.trim(F.coalesce(j["explanation"], F.lit(""))).alias("explanation")))


def batched_judge(make: Callable[[], object], parts: int | None = None) -> Judge:
    """A judge_batch(pairs) object, made once for a worker; parts bounds how many run at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        j = make()
        for b in batches:
            out = j.judge_batch(list(zip(b["a_text"], b["b_text"], strict=True))) if len(b) else []
            yield b.assign(j_sim=[None if math.isnan(s) else float(s) for s, _ in out], j_explanation=[e for _, e in out])

    def judge(rows: DataFrame) -> DataFrame:
        schema = T.StructType([*rows.schema.fields, T.StructField("j_sim", T.DoubleType()), T.StructField("j_explanation", T.StringType())])
        return (rows.repartition(parts) if parts else rows).mapInPandas(run, schema)

    return judge


class CrossEncoder:
    """A sentence-pair model, loaded at first use; scores clamped, no explanation."""

    def __init__(self, model: str = "cross-encoder/stsb-roberta-large") -> None:
        self._id, self._model = model, None

    def judge_batch(self, pairs: list[tuple[str, str]]) -> list[tuple[float, str]]:
        if self._model is None:
            try:
                from sentence_transformers import CrossEncoder as Model
            except ImportError as e:
                raise RuntimeError("the local judge needs the package sentence-transformers") from e
            self._model = Model(self._id)
        return [(max(0.0, min(1.0, float(s))), "") for s in self._model.predict(pairs)]


class Generative:
    """One request for each pair; a request that fails gives NaN and says why."""

    TIMEOUT = 120.0

    def __init__(self, complete: Callable[[str], str]) -> None:
        self._complete = complete

    def judge_batch(self, pairs: list[tuple[str, str]]) -> list[tuple[float, str]]:
        out = []
        for a, b in pairs:
            try:
                out.append(parse_verdict(self._complete(PROMPT.format(a=a, b=b))))
            except Exception as e:  # one pair must not end the job
                out.append((math.nan, f"(judge error: {e})"))
        return out


def _key(variable: str, judge: str) -> str:
    if not (value := os.environ.get(variable)):
        raise RuntimeError(f"judge {judge} needs {variable} in the environment")
    return value


def _ollama(model: str, post: Callable) -> Callable[[str], str]:
    url = os.environ.get("OLLAMA_HOST", "http://localhost:11434") + "/api/generate"
    return lambda prompt: post(url, {"model": model, "prompt": prompt, "format": "json", "stream": False}, {}, Generative.TIMEOUT)["response"]


def _anthropic(model: str, post: Callable) -> Callable[[str], str]:
    headers = {"x-api-key": _key("ANTHROPIC_API_KEY", "anthropic"), "anthropic-version": "2023-06-01"}
    return lambda prompt: post("https://api.anthropic.com/v1/messages", {"model": model, "max_tokens": 256, "messages": [{"role": "user", "content": prompt}]}, headers, Generative.TIMEOUT)["content"][0]["text"]


def _openai(model: str, post: Callable) -> Callable[[str], str]:
    headers = {"authorization": f"Bearer {_key('OPENAI_API_KEY', 'openai')}"}
    return lambda prompt: post("https://api.openai.com/v1/chat/completions", {"model": model, "response_format": {"type": "json_object"}, "messages": [{"role": "user", "content": prompt}]}, headers, Generative.TIMEOUT)["choices"][0]["message"]["content"]


#: fixed values: default models
BACKENDS = {"ollama": (_ollama, "llama3.1"), "anthropic": (_anthropic, "claude-haiku-4-5-20251001"), "openai": (_openai, "gpt-4o-mini")}


def judge(backend: str, model: str | None = None, verdicts: DataFrame | None = None, post: Callable = post_json, parts: int | None = None) -> Judge | None:
    """The backend's judge; None for "none", which is never asked."""
    if backend == "none":
        return None
    if backend == "table":
        if verdicts is None:
            raise ValueError("the table judge needs verdicts")
        return table_judge(verdicts)
    if backend == "local":
        return batched_judge(lambda: CrossEncoder(model or "cross-encoder/stsb-roberta-large"), parts)
    if backend in BACKENDS:
        make, default = BACKENDS[backend]
        make(model or default, post)  # a missing key is reported here, not by a task
        return batched_judge(lambda: Generative(make(model or default, post)), parts)
    raise ValueError(f"unknown judge backend: {backend!r}")
