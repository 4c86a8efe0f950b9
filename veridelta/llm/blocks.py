"""Blocks of documents that ask a distributed dictionary, without a row per word.

Documents are dealt into blocks by a hash of their key and text, into a bucketed table that
all passes read in place.  A block sums up its own items
(n-grams, shingles, words) into sorted distinct 64-bit keys and sends one packed row per
(block, bucket of the key space).  A bucket merges what all blocks sent and answers every
block in the order of its keys.  A key that half of all documents hold is one entry per
block, so no task gathers more than its slice of the key space, whatever the data look like.
"""

from __future__ import annotations

__all__ = ["Merged", "block_count", "block_of", "blocked", "dealt", "estimated_bytes", "planes", "pack", "read_answers", "requests", "shared_dir", "stored", "unpack", "unplanes"]

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridelta.functions.staging import CLEANUP, setting, shared_dir, stored

U64 = np.uint64
REQUEST = "bucket int, block int, keys binary, extra binary"
ANSWER = "block int, bucket int, answer binary"


def dealt(rows: DataFrame, n: int, name: str) -> DataFrame:
    """The rows in a table bucketed by their column block: every later pass over blocks reads it without an exchange."""
    spark = rows.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    w = rows.repartition(n, "block").write.bucketBy(n, "block").option("compression", "zstd").option("path", f"{shared_dir(spark)}/veridelta/{table}")
    with setting(spark, CLEANUP, "true"):
        w.saveAsTable(table, format="parquet")
    return spark.table(table)


def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's estimate of the rows' size, of files their size; None where it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 55 else None


def block_count(docs: DataFrame, text: str = "text", mb: int = 14, most: int = 4096, most_mb: int = 64) -> int:
    """Blocks of about mb MB of text; their number follows the text's true size.

    Blocks and buckets exchange a row for each two of them, so beyond `most` blocks they grow
    first, up to most_mb, before their number does.
    """
    size = docs.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0
    return max(8, min(most, -(-size // (mb << 20))), -(-size // (most_mb << 20)))


def blocked(docs: DataFrame, n: int, key: str = "doc_id", text: str = "text", name: str = "blocks") -> DataFrame:
    """Key, whole text (null: empty) and block of each document; rows of one key, or without, are spread by their texts."""
    d = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return dealt(d.withColumn("block", block_of(n, F.col("doc_id"), F.xxhash64("text"))), n, name)


def block_of(n: int, key: Column, text_hash: Column) -> Column:
    return F.pmod(F.xxhash64(key, text_hash), F.lit(n)).cast("int")


def planes(x: np.ndarray) -> bytes:
    """Numbers as byte planes, so that a general compressor sees the empty high bytes together."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unplanes(b: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).reshape(-1).view(dtype)


def squeezed(raw: bytes) -> bytes:
    """The bytes by zstd, behind their length: planes of counts and flags shrink to little before they are exchanged."""
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True) if raw else b""


def unsqueezed(b: bytes) -> bytes:
    return pa.decompress(b[8:], decompressed_size=int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True) if b else b""


def pack(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return planes(np.diff(keys, prepend=U64(0))) if len(keys) else b""


def unpack(b: bytes) -> np.ndarray:
    return np.cumsum(unplanes(b, U64), dtype=U64) if len(b) else np.zeros(0, U64)


def cuts(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that the sorted keys fall into, and where each begins and ends."""
    b = ((keys >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)
    used, at = np.unique(b, return_index=True)
    return used, np.append(at, len(keys))


def requests(block: int, keys: np.ndarray, buckets: int, extra: list[np.ndarray] | None = None) -> pa.Table:
    """Rows of REQUEST for a block's sorted distinct keys; extra: columns beside them."""
    used, at = cuts(keys, buckets)
    rows = [(int(b), block, pack(keys[i:j]), squeezed(b"".join(planes(np.ascontiguousarray(x[i:j])) for x in extra or []))) for b, i, j in zip(used, at[:-1], at[1:], strict=True)]
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([r[1] for r in rows], pa.int32()), "keys": pa.array([r[2] for r in rows], pa.binary()), "extra": pa.array([r[3] for r in rows], pa.binary())})


class Merged:
    """What a bucket has of all blocks: entries sorted by key; group: index of each entry's key."""

    def __init__(self, table: pa.Table, dtypes: list[type]) -> None:
        self.blocks = table.column("block").to_pylist()
        lists = [unpack(b) for b in table.column("keys").to_pylist()]
        self.sizes = [len(x) for x in lists]
        keys = np.concatenate(lists) if lists else np.zeros(0, U64)
        self.order = np.argsort(keys, kind="stable")
        s = keys[self.order]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        self.at, self.keys = np.flatnonzero(new), s[new]
        self.group = np.cumsum(new) - 1
        self.extra: list[np.ndarray] = []
        cols: list[list[np.ndarray]] = [[] for _ in dtypes]
        for n, e in zip(self.sizes, table.column("extra").to_pylist(), strict=True):
            e, lo = unsqueezed(e), 0
            for k, t in enumerate(dtypes):
                hi = lo + n * np.dtype(t).itemsize
                cols[k].append(unplanes(e[lo:hi], t))
                lo = hi
        self.extra = [np.concatenate(c)[self.order] if c else np.zeros(0, t) for c, t in zip(cols, dtypes, strict=True)]

    def reduce(self, f: np.ufunc, x: np.ndarray) -> np.ndarray:
        """f over the entries of each key."""
        return f.reduceat(x, self.at) if len(self.at) else x[:0]

    def answers(self, bucket: int, entry: np.ndarray) -> pa.Table:
        """Rows of ANSWER from a value for each entry."""
        back = np.empty_like(entry)
        back[self.order] = entry
        parts = np.split(back, np.cumsum(self.sizes)[:-1]) if self.sizes else []
        return pa.table({"block": pa.array(self.blocks, pa.int32()), "bucket": pa.array([bucket] * len(self.blocks), pa.int32()), "answer": pa.array([squeezed(planes(p)) for p in parts], pa.binary())})


def read_answers(table: pa.Table, keys: np.ndarray, buckets: int, dtype: type) -> np.ndarray:
    """The answers for a block's sorted distinct keys, in their order."""
    got = dict(zip(table.column("bucket").to_pylist(), table.column("answer").to_pylist(), strict=True))
    used, _ = cuts(keys, buckets)
    return np.concatenate([unplanes(unsqueezed(got[int(b)]), dtype) for b in used]) if len(used) else np.zeros(0, dtype)
