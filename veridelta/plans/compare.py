"""The comparison of many document pairs.

Pairs, chunks, matched pairs and changes are tables in the shared folder, each written once:
the results read the last, whatever is asked of them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from veridelta.operators import chunk as C
from veridelta.operators import embed as E
from veridelta.operators import judge as J
from veridelta.operators import match as M
from veridelta.operators import report as R
from veridelta.operators import score as S
from veridelta.functions.staging import stored


@dataclass(frozen=True)
class CompareConfig:
    granularities: tuple[str, ...] = C.GRANULARITIES
    primary: str = "paragraph"
    embed_backend: str = "hash"
    embed_model: str | None = None
    hash_dim: int = 1024
    judge_backend: str = "none"
    judge_model: str | None = None
    judge_band: tuple[float, float] = S.BAND
    sim_threshold: float = S.THRESHOLD
    match_floor: float = M.FLOOR
    max_chunks: int | None = None
    strategy: str = "grouped"
    judge_parts: int | None = None

    def __post_init__(self) -> None:
        if bad := [g for g in self.granularities if g not in C.GRANULARITIES]:
            raise ValueError(f"unknown granularity: {bad[0]!r}")
        if not 0 <= self.match_floor <= 1:
            raise ValueError("match_floor must lie in [0, 1]")
        if self.strategy not in M.STRATEGIES:
            raise ValueError(f"unknown matching strategy: {self.strategy!r}")

    @staticmethod
    def of(choice: str, **more) -> CompareConfig:
        """X3: "all" features paragraphs; any other granularity stands alone."""
        return CompareConfig(**more) if choice == "all" else CompareConfig((choice,), choice, **more)


@dataclass
class Comparison:
    """Results: summary (a row for pair and granularity) and changes (a row for a chunk or matched pair)."""

    pairs: DataFrame
    summary: DataFrame
    changes: DataFrame
    config: CompareConfig
    embed_name: str = field(default="")
    judge_name: str = field(default="none")

    def listed(self) -> DataFrame:
        return R.listed(self.changes)

    def reports(self, fmt: str = "text") -> DataFrame:
        return R.render(self.pairs, self.summary, self.changes, fmt, self.embed_name, self.judge_name, self.config.granularities, self.config.primary)


def candidates(pairs: DataFrame, chunks: DataFrame, config: CompareConfig) -> DataFrame:
    make = E.embedder(config.embed_backend, config.embed_model)
    if make is None:
        return M.sparse_cosine(pairs, stored(E.hash_features(chunks, config.hash_dim), "features"), config.match_floor, chunks)
    return M.dense_cosine(pairs, E.dense(chunks, make), config.match_floor)


def compare_chunks(pairs: DataFrame, chunks: DataFrame, config: CompareConfig, verdicts: DataFrame | None = None, judge: J.Judge | None = None) -> Comparison:
    """From chunks of all documents that the pairs name."""
    judge = judge or J.judge(config.judge_backend, config.judge_model, verdicts, parts=config.judge_parts)
    matched = stored(M.STRATEGIES[config.strategy](candidates(pairs, chunks, config)), "matched")
    scored = S.rescored(S.attach(pairs, chunks, matched), judge, config.judge_band)
    if judge is not None:
        # verdicts of a service may differ between calls: all results must read the same ones, and pay once
        scored = stored(scored, "scored")
    rows = stored(S.changes(pairs, chunks, scored, config.sim_threshold), "changes")
    name = config.judge_backend if judge is not None or config.judge_backend == "none" else "none"
    return Comparison(pairs, S.summary(pairs, rows, config.granularities), rows, config, E.embedder_name(config.embed_backend, config.embed_model, config.hash_dim), name + (f":{config.judge_model}" if config.judge_model else ""))


def compare(pairs: DataFrame, blocks: DataFrame, config: CompareConfig | None = None, verdicts: DataFrame | None = None, judge: J.Judge | None = None) -> Comparison:
    """Pairs (pair_id, doc_a, doc_b) of documents given as blocks (doc_id, block_ord, page, text, is_heading).

    Only documents that some pair names are chunked.
    """
    config = config or CompareConfig()
    pairs = stored(pairs.select("pair_id", "doc_a", "doc_b"), "pairs")
    named = pairs.select(pairs["doc_a"].alias("doc_id")).union(pairs.select("doc_b")).distinct()
    own = blocks.join(named, "doc_id", "left_semi")
    chunks = stored(C.chunk_all(own, config.granularities, config.max_chunks), "chunks")
    return compare_chunks(pairs, chunks, config, verdicts, judge)
