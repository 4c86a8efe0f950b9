"""Removal of repeated word spans by De Bruijn compaction.

Token k-mers are edges between their first and last k-1 words.  Four passes over blocks
of documents (see blocks.py); what a pass learns comes back to the blocks that asked:

1. sketch: each window of k words keeps the smallest hash of its m-word pieces, as
   minimizers do for De Bruijn graphs of genomes.  Equal windows have equal minimizers, so
   a window whose minimizer lies in one document only is unique and goes no further.
2. edges: the remaining k-mers with their neighbours.  An edge is repeated if two documents
   have it; a side of it is a branch if occurrences differ there or one is at a text's end.
3. paths: a run of repeated edges without a branch between them is one nonbranching path;
   each document gives one row for each path it holds, with its source coordinates and a
   128-bit digest of the words that stand there in the text.  A Spark aggregation and join
   over (head, length, digest) compacts occurrences into paths, so only spans of the same
   words meet, whatever the hashes say that led to them.
4. removal: spans whose path also occurs in a document with a smaller id leave the text.

Defined cases: null and empty texts have no words; a null doc_id is returned but neither
removes nor loses words; repeated ids are not smaller than each other; other columns are
ignored; texts are never cut; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import tokens as T

U64 = np.uint64
_NONE = np.iinfo(np.int64).min
PIECES = "head long, len int, span binary, doc_id long, row long, start int, block int"
RESULT = "doc_id long, n_words long, n_removed long, kept_text string"


def _ids(table: pa.Table) -> np.ndarray:
    return np.asarray(T.column(table, "doc_id").fill_null(_NONE).to_numpy(zero_copy_only=False), np.int64)


def _windows(w: T.Words, k: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows that lie in one text, and their minimizers (48 bits)."""
    at = np.flatnonzero(w.inside(k))
    if not len(at):
        return at, np.zeros(0, U64)
    g = T.ngrams(w.hash, m) >> U64(16)
    n = len(w.hash) - k + 1
    least = g[:n].copy()
    for i in range(1, k - m + 1):
        np.minimum(least, g[i : i + n], out=least)
    return at, least[at] << U64(16)


def _pieces_of(table: pa.Table):
    ids = _ids(table)
    for w in T.words(T.column(table, "text"), T.whitespace_words(), T.as_written()):
        yield ids[w.rows], w


def _sketch(table: pa.Table, k: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's distinct minimizers, and which of them two of its documents have."""
    keys, owners = [], []
    for ids, w in _pieces_of(table):
        at, least = _windows(w, k, m)
        if len(at):
            doc = ids[w.doc[at]]
            run = np.ones(len(at), bool)
            run[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
            keys.append(least[run])
            owners.append(doc[run])
    if not keys:
        return np.zeros(0, U64), np.zeros(0, np.uint8)
    key, owner = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(key, kind="stable")
    key, owner = key[order], owner[order]
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[at], (np.minimum.reduceat(owner, at) != np.maximum.reduceat(owner, at)).astype(np.uint8)


def _rows(texts: pa.Array) -> np.ndarray:
    """A 63-bit digest of each text, which tells rows of one id apart."""
    off, data = T.raw(texts)
    raw = memoryview(data)
    return np.array([int.from_bytes(hashlib.blake2b(raw[a:b], digest_size=8).digest(), "little") >> 1 for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], np.int64)


def _digests(w: T.Words, first: np.ndarray, last: np.ndarray) -> list[bytes]:
    """128 bits of the words from first to last, joined by one space, as they stand in the text."""
    raw = w.data.tobytes()
    return [hashlib.blake2b(b" ".join(raw[a:b].split()), digest_size=16).digest() for a, b in zip(w.start[first].tolist(), w.end[last].tolist(), strict=True)]


class _Edges:
    """A block's distinct k-mers among the windows with shared minimizers."""

    def __init__(self, table: pa.Table, shared: np.ndarray, k: int, m: int) -> None:
        self.parts, keys = [], []
        docs, before, after = [], [], []
        for ids, w in _pieces_of(table):
            at, least = _windows(w, k, m)
            i = np.searchsorted(shared, least)
            at = at[shared[np.minimum(i, len(shared) - 1)] == least] if len(shared) else at[:0]
            g = T.grams(w.hash, at, k)
            self.parts.append((ids, w, at, g))
            if len(at):
                keys.append(g)
                docs.append(ids[w.doc[at]])
                # 0 stands for a text's end
                left = np.where(at > w.first[w.doc[at]], w.hash[np.maximum(at - 1, 0)] | U64(1), U64(0))
                right = np.where(at + k < w.first[w.doc[at] + 1], w.hash[np.minimum(at + k, len(w.hash) - 1)] | U64(1), U64(0))
                before.append(left)
                after.append(right)
        if not keys:
            self.keys = np.zeros(0, U64)
            self.extra = [np.zeros(0, np.int64)] * 2 + [np.zeros(0, U64)] * 2
            return
        key = np.concatenate(keys)
        order = np.argsort(key, kind="stable")
        key = key[order]
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        self.keys = key[at]
        doc = np.concatenate(docs)[order]
        known = doc != _NONE  # without an id: neither first nor second
        lo = np.minimum.reduceat(np.where(known, doc, np.iinfo(np.int64).max), at)
        hi = np.maximum.reduceat(np.where(known, doc, _NONE), at)
        sides = [_agree(np.minimum.reduceat(x := np.concatenate(s)[order], at), np.maximum.reduceat(x, at)) for s in (before, after)]
        self.extra = [lo, hi - np.where(hi >= lo, lo, hi), *sides]  # the difference is 0 for most


def _agree(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return np.where(lo == hi, lo, U64(0))


def repeats(docs: DataFrame, k: int = 13, block_mb: int = 14) -> tuple[DataFrame, DataFrame]:
    """Blocks of the documents, and a row (block, doc_id, row, start, len) for each span that repeats an earlier document."""
    m = max(1, (k + 1) // 2)
    n = B.block_count(docs, mb=block_mb)
    blocks = B.blocked(docs, n)

    def sketch(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        keys, multi = _sketch(table, k, m)
        return B.requests(key[0].as_py(), keys, n, [multi])

    def shared(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        x = B.Merged(table, [np.uint8])
        many = (np.diff(np.append(x.at, len(x.order))) > 1) | (x.reduce(np.maximum, x.extra[0]) > 0)
        return x.answers(key[0].as_py(), many[x.group].astype(np.uint8))

    sketched = blocks.groupBy("block").applyInArrow(sketch, B.REQUEST)
    asked = sketched.groupBy("bucket").applyInArrow(shared, B.ANSWER).select("block", "bucket", "answer", F.lit(1).alias("step"))

    def shared_of(table: pa.Table, got: pa.Table) -> np.ndarray:
        keys, _ = _sketch(table, k, m)
        first = got.filter(pc.equal(got.column("step"), 1))
        return keys[B.read_answers(first, keys, n, np.uint8) > 0]

    def edges(key: tuple[pa.Scalar, ...], table: pa.Table, got: pa.Table) -> pa.Table:
        e = _Edges(table, shared_of(table, got), k, m)
        return B.requests(key[0].as_py(), e.keys, n, e.extra)

    def branches(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        x = B.Merged(table, [np.int64, np.int64, U64, U64])
        lo, span, left, right = x.extra
        known = lo != np.iinfo(np.int64).max
        hi = np.where(known, lo + span, _NONE)
        repeated = x.reduce(np.minimum, lo) < x.reduce(np.maximum, hi)
        flags = repeated.astype(np.uint8)
        for bit, side in ((2, left), (4, right)):
            a, b = x.reduce(np.minimum, side), x.reduce(np.maximum, side)
            flags |= ((a != b) | (a == 0)).astype(np.uint8) * np.uint8(bit)
        return x.answers(key[0].as_py(), flags[x.group])

    asked = B.stored(asked, "minimizers")
    edge_rows = blocks.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(edges, B.REQUEST)
    flagged = edge_rows.groupBy("bucket").applyInArrow(branches, B.ANSWER).select("block", "bucket", "answer", F.lit(2).alias("step"))

    def paths(key: tuple[pa.Scalar, ...], table: pa.Table, got: pa.Table) -> pa.Table:
        e = _Edges(table, shared_of(table, got), k, m)
        flags = B.read_answers(got.filter(pc.equal(got.column("step"), 2)), e.keys, n, np.uint8)
        out: list[list[np.ndarray]] = [[] for _ in range(5)]
        spans: list[bytes] = []
        rows = _rows(T.column(table, "text"))
        for ids, w, at, g in e.parts:
            if not len(at):
                continue
            f = flags[np.searchsorted(e.keys, g)]
            keep = (f & 1 > 0) & (ids[w.doc[at]] != _NONE)
            at, g, f = at[keep], g[keep], f[keep]
            if not len(at):
                continue
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] != at[:-1] + 1) | (w.doc[at[1:]] != w.doc[at[:-1]]) | (f[:-1] & 4 > 0) | (f[1:] & 2 > 0)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(at)) - 1
            length = at[last] - at[first] + 1
            doc = w.doc[at[first]]
            row = rows[w.rows]
            spans.extend(_digests(w, at[first], at[last] + k - 1))
            cols = (g[first], length, ids[doc], row[doc], at[first] - w.first[doc])
            for o, c in zip(out, cols, strict=True):
                o.append(c)
        cols = [np.concatenate(o) if o else np.zeros(0, np.int64) for o in out]
        head, length, doc, row, start = cols
        return pa.table({"head": head.view(np.int64), "len": length.astype(np.int32), "span": pa.array(spans, pa.binary()), "doc_id": doc.astype(np.int64), "row": row.astype(np.int64), "start": start.astype(np.int32), "block": np.full(len(head), key[0].as_py(), np.int32)})

    both = asked.unionByName(B.stored(flagged, "branches"))
    pieces = B.stored(blocks.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(paths, PIECES), "paths")
    path = ["head", "len", "span"]
    # a table of its own: the join then exchanges both sides and Spark may split a path that many documents hold
    compacted = B.stored(pieces.groupBy(*path).agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("first_doc < last_doc").drop("last_doc"), "compacted")
    later = pieces.join(compacted, path).where("doc_id > first_doc")
    return blocks, later.select("block", "doc_id", "row", "start", (F.col("len") + (k - 1)).alias("len"))


def dedup_substrings(docs: DataFrame, k: int = 13, block_mb: int = 14, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (digest: kept_sha256): the texts without spans of k or more words that an earlier document has."""
    blocks, spans = repeats(docs, k, block_mb)

    def remove(table: pa.Table, got: pa.Table) -> pa.Table:
        ids = _ids(table)
        texts = T.column(table, "text")
        off, data = T.raw(texts)
        data = data.tobytes()
        by, own_rows = got.column("row").to_numpy(), _rows(texts)
        order = np.argsort(by, kind="stable")
        by, doc, start, length = (got.column(c).to_numpy()[order] for c in ("row", "doc_id", "start", "len"))
        total, gone, kept = [], [], []
        for w in T.words(texts, T.whitespace_words(), T.as_written()):
            lo, hi = np.searchsorted(by, own_rows[w.rows]), np.searchsorted(by, own_rows[w.rows], side="right")
            for i, row in enumerate(w.rows):
                text = data[off[row] : off[row + 1]].split()
                n = 0
                if hi[i] > lo[i]:
                    mark = np.zeros(len(text) + 1, np.int32)
                    own = slice(lo[i], hi[i])
                    mine = doc[own] == ids[row]
                    np.add.at(mark, start[own][mine], 1)
                    np.add.at(mark, (start[own] + length[own])[mine], -1)
                    stay = np.cumsum(mark[:-1]) == 0
                    n = len(text) - int(stay.sum())
                    total.append(len(text))
                    text = [text[j] for j in np.flatnonzero(stay)]
                else:
                    total.append(len(text))
                gone.append(n)
                joined = b" ".join(text)
                kept.append(hashlib.sha256(joined).hexdigest() if digest else joined.decode())
        return pa.table({"doc_id": T.column(table, "doc_id"), "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256" if digest else "kept_text": pa.array(kept, pa.string())})

    return blocks.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(remove, RESULT.replace("kept_text", "kept_sha256") if digest else RESULT)
