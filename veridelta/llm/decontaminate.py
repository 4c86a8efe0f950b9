"""Benchmark decontamination with a distributed positional inverted index.

build_index stores the training text's token postings as segments of some half a million words:
the segment's documents and their lengths, its sorted terms (64-bit hashes of lower-cased
words) and, term by term, the ascending word positions.  Segments are rows of a written
table, so an index of any size is searched without a shuffle, each segment on its own.

A phrase is found from the rarest of its terms in the segment: the positions of that term
less its offset are the candidate starts, and the offset-adjusted lists of the other terms
are intersected with them, rarest first, until none is left.  Proximity search starts from
the rarest term in the same way and asks for all terms within n + slop words in any order.
The query set is read in blocks of a stated size; only one block's terms are broadcast.

Defined cases: null and empty texts and texts without words have 0 words and no hits; null
and wordless items have no windows; an item of fewer words than n is one window; rows with
repeated or null ids are each answered on their own; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import tokens as T

U64 = np.uint64
SEGMENT = "segment long, docs binary, no_id binary, lengths binary, terms binary, counts binary, positions binary"
RESULT = "segment long, place int, doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"
#: rows and bytes of text in one block of the query set
QUERY_ROWS, QUERY_BYTES = 20_000, 4 << 20


def _terms(texts: pa.Array) -> Iterator[T.Words]:
    return T.words(texts, T.alnum_words(), T.folded())


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", segment_words: int = 1 << 19) -> DataFrame:
    """The stored index of all whole texts, in segments of at least so many words (but for a partition's last)."""
    d = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def segments(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[tuple[np.ndarray, ...]] = []  # ids, missing ids, lengths, word hashes
        for part in parts:
            ids = T.column(part, "doc_id")
            empty = np.asarray(ids.is_null())
            ids = np.asarray(ids.fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            for w in _terms(T.column(part, "text")):
                held.append((ids[w.rows], empty[w.rows], np.diff(w.first).astype(np.int32), w.hash))
                if sum(len(x[3]) for x in held) >= segment_words:
                    yield _segment(number, held)
                    number, held = number + 1, []
        if held:
            yield _segment(number, held)

    return B.stored(d.mapInArrow(segments, SEGMENT), "postings")


def _segment(number: int, held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    ids, empty, lengths, words = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(words, kind="stable")
    h = words[order]
    at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    gaps = np.diff(order, prepend=0)
    gaps[at] = order[at]  # each list begins anew
    row = [B.planes(ids), np.packbits(empty).tobytes(), B.planes(lengths), B.pack(h[at]), B.planes(np.diff(np.append(at, len(h))).astype(np.int32)), B.planes(gaps.astype(np.uint32))]
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([x], pa.binary()) for x in row)], names=[c.split()[0] for c in SEGMENT.split(", ")])


class Segment:
    """One row of the index, decoded; lists of positions are cut out on demand."""

    def __init__(self, row: dict) -> None:
        self.number = row["segment"]
        self.docs, self.lengths = B.unplanes(row["docs"], np.int64), B.unplanes(row["lengths"], np.int32)
        self.no_id = np.unpackbits(np.frombuffer(row["no_id"], np.uint8), count=len(self.docs)).astype(bool)
        self.terms, counts = B.unpack(row["terms"]), B.unplanes(row["counts"], np.int32)
        self.at = np.append(0, np.cumsum(counts, dtype=np.int64))
        self.gaps = B.unplanes(row["positions"], np.uint32)
        self.first = np.append(0, np.cumsum(self.lengths, dtype=np.int64))

    def places(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each term's list, and its length (0: absent)."""
        if not len(self.terms):
            return np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64)
        i = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return i, np.where(self.terms[i] == terms, self.at[i + 1] - self.at[i], 0)

    def list(self, i: int) -> np.ndarray:
        return np.cumsum(self.gaps[self.at[i] : self.at[i + 1]], dtype=np.int64)

    def phrase(self, lists: list[int], sizes: list[int]) -> np.ndarray:
        """Word positions at which the terms stand one after the other in one document."""
        order = sorted(range(len(lists)), key=sizes.__getitem__)
        start = self.list(lists[order[0]]) - order[0]
        for o in order[1:]:
            if not len(start):
                break
            other = self.list(lists[o]) - o
            j = np.minimum(np.searchsorted(other, start), len(other) - 1)
            start = start[other[j] == start]
        start = start[start >= 0]
        doc = np.searchsorted(self.first, start, side="right") - 1
        return start[start + len(lists) <= self.first[doc + 1]] if len(start) else start

    def near(self, lists: list[int], sizes: list[int], width: int) -> np.ndarray:
        """Starts of the stretches of at most width words of one document that hold all terms, as often as asked, in any order."""
        need: dict[int, int] = defaultdict(int)
        for i in lists:
            need[i] += 1
        every = sorted((int(p), i) for i in need for p in self.list(i))
        have: dict[int, int] = defaultdict(int)
        lacking, lo, found = len(lists), 0, []
        for p, i in every:
            have[i] += 1
            lacking -= have[i] <= need[i]
            while every[lo][0] <= p - width or have[every[lo][1]] > need[every[lo][1]]:
                have[every[lo][1]] -= 1
                lacking += have[every[lo][1]] < need[every[lo][1]]
                lo += 1
            if not lacking:
                found.append((every[lo][0], p))
        if not found:
            return np.zeros(0, np.int64)
        a, b = np.array(found).T
        doc = np.searchsorted(self.first, a, side="right")
        return np.unique(a[b < self.first[doc]])


class Phrases:
    """A block of the query set: distinct windows as rows of term numbers, and the items of each.

    At most QUERY_BYTES of text, or one item, is in a block, so the matrix has at most some
    QUERY_BYTES / 2 rows of n numbers.
    """

    def __init__(self, rows: list[tuple[str | None, str | None]], n: int) -> None:
        hashes, starts, lengths, owners = [np.zeros(0, U64)], [], [], []
        at = 0
        for w in _terms(pa.array([t or "" for _, t in rows], pa.string())):
            size = np.diff(w.first)
            count = np.where(size > 0, np.maximum(1, size - n + 1), 0)
            inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            starts.append(at + np.repeat(w.first[:-1], count) + inner)
            lengths.append(np.repeat(np.minimum(size, n), count))
            owners.append(np.repeat(w.rows, count))
            hashes.append(w.hash)
            at += len(w.hash)
        words = np.concatenate(hashes)
        start, length, owner = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (starts, lengths, owners))
        self.vocabulary, number = np.unique(words, return_inverse=True)
        number = np.append(number.astype(np.int32), np.int32(-1))
        place = start[:, None] + np.arange(n)
        windows = number[np.where(np.arange(n) < length[:, None], place, len(words))].reshape(-1, n)
        self.terms, which = np.unique(windows, axis=0, return_inverse=True)
        self.length = (self.terms >= 0).sum(axis=1)
        pairs = np.unique(np.stack([which.ravel(), owner]), axis=1)
        self.edge, self.owner = np.searchsorted(pairs[0], np.arange(len(self.terms) + 1)), pairs[1]
        self.names = [x for x, _ in rows]

    def items(self, window: int) -> list[str]:
        return [x for i in self.owner[self.edge[window] : self.edge[window + 1]] if (x := self.names[i]) is not None]

    def possible(self, size: np.ndarray) -> np.ndarray:
        """Windows all of whose terms the segment has."""
        if not len(self.terms):
            return np.zeros(0, np.int64)
        return np.flatnonzero((np.append(size, 1)[self.terms] > 0).all(axis=1))


def _search(index: DataFrame, phrases: Phrases, slop: int) -> DataFrame:
    shared = index.sparkSession.sparkContext.broadcast(phrases)

    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for part in parts:
            for i in range(part.num_rows):  # one segment in memory at a time
                s = Segment(part.slice(i, 1).to_pylist()[0])
                place, size = s.places(q.vocabulary)
                mark = np.zeros(int(s.first[-1]) + 1, np.int32)
                items: dict[int, set[str]] = defaultdict(set)
                for k in q.possible(size):
                    n = int(q.length[k])
                    own = q.terms[k, :n]
                    lists, sizes = place[own].tolist(), size[own].tolist()
                    width = n + slop
                    start = s.near(lists, sizes, width) if slop else s.phrase(lists, sizes)
                    if not len(start):
                        continue
                    doc = np.searchsorted(s.first, start, side="right") - 1
                    np.add.at(mark, start, 1)
                    np.add.at(mark, np.minimum(start + width, s.first[doc + 1]), -1)
                    for d in np.unique(doc):
                        items[int(d)].update(q.items(k))
                hit = (np.cumsum(mark[:-1]) > 0).astype(np.int8)
                total = np.append(0, np.cumsum(hit, dtype=np.int64))
                found = np.flatnonzero(total[s.first[1:]] > total[s.first[:-1]])
                spans: dict[int, list[dict[str, int]]] = {}
                for d in found:
                    edge = np.flatnonzero(np.diff(np.r_[0, hit[s.first[d] : s.first[d + 1]], 0]))
                    spans[int(d)] = [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(s.docs), s.number)), pa.array(np.arange(len(s.docs)), pa.int32()), pa.array(s.docs, pa.int64(), mask=s.no_id), pa.array(s.lengths, pa.int64()), pa.array(total[s.first[1:]] - total[s.first[:-1]], pa.int64()), pa.array([sorted(items.get(d, ())) for d in range(len(s.docs))], pa.list_(pa.string())), pa.array([spans.get(d, []) for d in range(len(s.docs))], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                    names=["segment", "place", "doc_id", "n_words", "n_hit", "items", "spans"],
                )

    return index.mapInArrow(search, RESULT)


def find(index: DataFrame, items: DataFrame, n: int = 10, slop: int = 0, key: str = "item_id", text: str = "text") -> DataFrame:
    """Of each indexed document: n_words, n_hit, items with occurring windows, and the hit word spans.

    slop > 0: all words of a window within n + slop words in any order, in place of the exact phrase.
    """
    q = items.select(F.col(key).cast("string").alias("item"), F.col(text).alias("text"))
    rows, size = q.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n_blocks = max(1, -(-rows // QUERY_ROWS), -(-size // QUERY_BYTES))
    found = None
    for b in range(n_blocks):
        # a block of the stated size: the number of passes grows with the query set, memory does not
        own = q if n_blocks == 1 else q.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == b)
        one = _search(index, Phrases([tuple(r) for r in own.collect()], n), slop)
        found = one if found is None else found.unionByName(one)
    return (found if n_blocks == 1 else _merged(found)).drop("segment", "place")


def _merged(found: DataFrame) -> DataFrame:
    """Results of several query blocks: spans united; a document's place in the stored index is the same in each."""
    spans = F.array_sort(F.flatten(F.collect_list("spans")))
    joined = F.aggregate(
        spans,
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    united = found.groupBy("segment", "place", "doc_id", "n_words").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), joined.alias("spans"))
    return united.select("segment", "place", "doc_id", "n_words", F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["start"])).alias("n_hit"), "items", "spans")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def digest_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
