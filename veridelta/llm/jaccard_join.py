"""Exact n-gram Jaccard self-join: size-banded tiles, bitmap signatures, sorted-array intersection.

1. Documents with equal shingle sets are one class, stood for by its smallest doc_id.
2. Blocks of documents (see blocks.py) ask for each shingle's document frequency among the
   classes.  A shingle of one class is in no intersection, so a set that has less than the
   threshold's share of repeated shingles has no partner and goes no further.
3. Prefix filter: with the rarest shingles first, two sets that reach the threshold share
   one of their first size - ceil(threshold * size) + 1 shingles.  Those make the tiles
   (shingle, size band); a set enters its own band and the one below, the only ones that
   can hold a partner.  A tile of many sets is cut into square sub-tiles of bounded sides.
4. In a tile, hashed bitmaps bound overlaps from above by bit counts: a bit that only one
   side has is a shingle that is not shared.  Pairs that survive leave the tile of their
   first common shingle and are decided by an exact intersection of the sorted hash arrays.

Large families would make a pair of every two members.  Components need only the links
that connect, so tiles by min-hash first link sets exactly inside small sub-tiles (a union-
find skips pairs already connected); step 3 then compares sets of different components only.
It decides every pair that the first round left, so no link between components is lost.

Defined cases: null and wordless texts have an empty set and no links (the component is the
row's own id); a null doc_id takes no part and has a null component; rows with the same
doc_id count as one document; other columns are ignored.  Shingles are equal if their
64-bit hashes are.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import tokens as T
from .components import components

U64 = np.uint64
SETS = "doc_id long, t long, n int, d1 long, d2 long"
KEPT = "node long, size int, lead binary, tile0 long, tile1 long, bits binary, shingles binary"
#: sets in a sub-tile's side, words of a bitmap
SIDE, BITMAP = 256, 128
_SEED = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89], U64)


def shingle_sets(texts: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct shingle hashes of each text."""
    for w in T.words(texts, T.whitespace_words(), T.folded()):
        first, last = w.first[:-1], w.first[1:]
        g = T.ngrams(w.hash, k)
        short = T.short_sequences(w.hash, first, last, k)
        for i, row in enumerate(w.rows):
            n = last[i] - first[i]
            yield int(row), np.unique(g[first[i] : last[i] - k + 1]) if n >= k else short[i : i + 1] if n else short[:0]


def _digest(s: np.ndarray) -> tuple[int, int]:
    return int(T.mix(s ^ _SEED[0]).sum(dtype=U64).view(np.int64)), int(T.mix(s ^ _SEED[1]).sum(dtype=U64).view(np.int64))


def need(size: int, t: Fraction) -> int:
    """Least overlap of a set of this size with any partner."""
    return -(-size * t.numerator // t.denominator)


def overlap(a: np.ndarray, b: np.ndarray, t: Fraction) -> np.ndarray:
    """Least overlap of two sets of these sizes that link."""
    return -(-(a + b) * t.numerator // (t.numerator + t.denominator))


def _sets(docs: DataFrame, k: int) -> DataFrame:
    def sets(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            n, d1, d2 = (np.zeros(part.num_rows, np.int64) for _ in range(3))
            for row, s in shingle_sets(T.column(part, "text"), k):
                n[row], (d1[row], d2[row]) = len(s), _digest(s)
            yield pa.RecordBatch.from_arrays([T.column(part, "doc_id"), T.column(part, "t"), pa.array(n, pa.int32()), pa.array(d1), pa.array(d2)], names=["doc_id", "t", "n", "d1", "d2"])

    d = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))
    return B.stored(d.mapInArrow(sets, SETS), "sets")


def _members(table: pa.Table, got: pa.Table, k: int) -> list[tuple[int, np.ndarray]]:
    """Sets of the block's rows that stand for a class, smallest id first."""
    own = got.filter(pc.is_valid(got.column("rep")))
    wanted = set(zip(own.column("rep").to_pylist(), own.column("d1").to_pylist(), strict=True))
    ids = T.column(table, "doc_id").to_pylist()
    found = {}
    for row, s in shingle_sets(T.column(table, "text"), k):
        if len(s) and ids[row] is not None and (x := (ids[row], _digest(s)[0])) in wanted:
            found[x] = s
    return [(x[0], found[x]) for x in sorted(found)]


def _frequencies(members: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not members:
        return np.zeros(0, U64), np.zeros(0, np.uint8)
    keys, n = np.unique(np.concatenate([s & ~U64(0xFFFF) for _, s in members]), return_counts=True)
    return keys, np.minimum(n, 255).astype(np.uint8)


def _repeated(docs: DataFrame, reps: DataFrame, k: int, t: Fraction, block_mb: int) -> DataFrame:
    """The sets that have enough repeated shingles, rarest first."""
    n = B.block_count(docs, mb=block_mb)
    blocks = B.blocked(docs.where(F.col("doc_id").cast("long").isNotNull()), n)
    mine = reps.select(B.block_of(n, F.col("rep"), F.col("t")).alias("block"), "rep", "d1")

    def ask(key: tuple[pa.Scalar, ...], table: pa.Table, got: pa.Table) -> pa.Table:
        keys, count = _frequencies(_members(table, got, k))
        return B.requests(key[0].as_py(), keys, n, [count])

    def answer(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        x = B.Merged(table, [np.uint8])
        total = x.reduce(np.add, x.extra[0].astype(np.int64))
        rank = np.where(total > 1, 1 + np.log2(np.maximum(total, 1)), 0).astype(np.uint8)
        return x.answers(key[0].as_py(), rank[x.group])

    asked = blocks.groupBy("block").cogroup(mine.groupBy("block")).applyInArrow(ask, B.REQUEST)
    ranks = B.stored(asked.groupBy("bucket").applyInArrow(answer, B.ANSWER), "frequencies")
    both = ranks.unionByName(mine, allowMissingColumns=True)

    def keep(key: tuple[pa.Scalar, ...], table: pa.Table, got: pa.Table) -> pa.Table:
        members = _members(table, got, k)
        keys, _ = _frequencies(members)
        rank = B.read_answers(got.filter(pc.is_valid(got.column("bucket"))), keys, n, np.uint8)
        out: dict[str, list] = {c.split()[0]: [] for c in KEPT.split(", ")}
        for node, s in members:
            r = rank[np.searchsorted(keys, s & ~U64(0xFFFF))]
            least, many = need(len(s), t), int(np.count_nonzero(r))
            if many < least:
                continue
            own, r = s[r > 0], r[r > 0]
            tiles = [int(T.mix(own ^ c).min().view(np.int64)) for c in _SEED[2:]]
            ranked = own[np.lexsort((own, r))]
            # shingles of one set only come first in the order and index nothing
            row = (node, len(s), ranked[: many - least + 1].tobytes(), *tiles, _bitmap(own), ranked.tobytes())
            for c, x in zip(out.values(), row, strict=True):
                c.append(x)
        return pa.table({c: pa.array(x, ty) for (c, x), ty in zip(out.items(), (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)})

    return B.stored(blocks.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(keep, KEPT), "candidates")


def _bitmap(s: np.ndarray) -> bytes:
    bits = np.zeros(BITMAP * 64, bool)
    bits[(s % U64(BITMAP * 64)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def _groups(parts: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys of a partition sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for part in parts:
        if not part.num_rows:
            continue
        cols = [T.column(part, c).to_numpy() for c in keys]
        new = np.zeros(part.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        new[0] = tuple(c[0] for c in cols) != last
        last = tuple(c[-1] for c in cols)
        at = [0, *np.flatnonzero(new[1:]) + 1, part.num_rows]
        if new[0] and held:
            yield pa.Table.from_batches(held)
            held = []
        for i, j in zip(at[:-1], at[1:], strict=True):
            held.append(part.slice(i, j - i))
            if j < part.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


class _Tile:
    """Sets of a tile in ascending size, with a union-find over them."""

    def __init__(self, table: pa.Table, t: Fraction) -> None:
        size = table.column("size").to_numpy().astype(np.int64)
        self.order = np.argsort(size, kind="stable")
        self.size, self.t = size[self.order], t
        self.node = table.column("node").to_numpy()[self.order]
        bits = table.column("bits").to_pylist()
        self.bits = np.array([np.frombuffer(bits[i], U64) for i in self.order])
        have = np.bitwise_count(self.bits).sum(axis=1, dtype=np.int64)
        self.slack = self.size - have  # of an upper bound: size - bits that only this side has

    def near(self, i: int, among: np.ndarray) -> np.ndarray:
        """Of the positions, those whose size and bits allow a link with i."""
        big, small = np.maximum(self.size[among], self.size[i]), np.minimum(self.size[among], self.size[i])
        among = among[small * self.t.denominator >= big * self.t.numerator]
        common = np.bitwise_count(self.bits[among] & self.bits[i]).sum(axis=1, dtype=np.int64)
        most = np.minimum(self.slack[among], self.slack[i]) + common
        return among[most >= overlap(self.size[among], self.size[i], self.t)]


def _linked(a: np.ndarray, b: np.ndarray, size_a: int, size_b: int, t: Fraction) -> bool:
    """Exact intersection of sorted hashes."""
    j = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int(np.count_nonzero(b[j] == a)) >= overlap(np.int64(size_a), np.int64(size_b), t)


def _first_links(kept: DataFrame, t: Fraction, parts: int) -> DataFrame:
    """Links that connect sets with an equal min-hash; exact, but not all."""
    schema = "a long, b long"
    links = None
    for r in ("tile0", "tile1"):
        crowded = kept.groupBy(r).count().where(F.col("count") > SIDE)
        # a crowded tile is cut anew for each min-hash, so cuts of a family differ
        side = F.pmod(F.xxhash64("node", F.lit(r)), F.ceil(F.coalesce("count", F.lit(1)) / SIDE).cast("int"))
        rows = kept.join(crowded, r, "left").select("node", "size", "bits", "shingles", F.col(r).alias("tile"), side.cast("int").alias("side"))

        def link(table: pa.Table) -> tuple[list, list]:
            tile = _Tile(table, t)
            raw = table.column("shingles").to_pylist()
            own = [np.sort(np.frombuffer(raw[i], U64)) for i in tile.order]
            got = [(tile.node[i], tile.node[j]) for i, j in _connected(tile, np.arange(len(own)), lambda i, later: np.ones(len(later), bool), lambda i, j: _linked(own[i], own[j], tile.size[i], tile.size[j], t))]
            return [x for x, _ in got], [y for _, y in got]

        one = B.stored(rows.repartition(parts, "tile", "side").sortWithinPartitions("tile", "side").mapInArrow(lambda b, link=link: _pairs(b, ["tile", "side"], link), schema), "tile-links")
        links = one if links is None else links.union(one)
    return links


def _connected(tile: _Tile, root: np.ndarray, fits, linked) -> Iterator[tuple[int, int]]:
    """Positions of pairs that connect different roots: fits(i, j's) and linked(i, j) decide; at most one pair for a member."""
    for i in range(len(root) - 1):
        later = np.arange(i + 1, len(root))
        later = later[root[later] != root[i]]
        for j in tile.near(i, later[fits(i, later)]):
            if root[j] != root[i] and linked(i, j):
                root[root == root[j]] = root[i]
                yield i, int(j)


def _pairs(batches: Iterator[pa.RecordBatch], keys: list[str], found) -> Iterator[pa.RecordBatch]:
    """Pairs of nodes from found(table, tile) of each group of rows."""
    for table in _groups(batches, keys):
        a, b = found(table) if table.num_rows > 1 else ([], [])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _rest(kept: DataFrame, known: DataFrame, t: Fraction, parts: int) -> DataFrame:
    """All links between sets that the first links leave in different components.

    A pair that size and bits allow is handed on by one tile, that of its first common
    shingle, however many it shares; then it is decided exactly.
    """

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            lead = [np.frombuffer(x, np.int64) for x in T.column(part, "lead").to_pylist()]
            n = [len(x) for x in lead]
            rows = [np.concatenate(lead) if lead else np.zeros(0, np.int64), *(np.repeat(T.column(part, c).to_numpy(), n) for c in ("node", "size"))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=["shingle", "node", "size"])

    rows = kept.select("node", "size", "lead").mapInArrow(prefixes, "shingle long, node long, size int").join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ratio = float(t.denominator / t.numerator)
    band = F.floor(F.log("size") / F.log(F.lit(ratio)) + F.lit(1e-9)).cast("int")
    rows = rows.select("shingle", "node", "component", band.alias("own"), F.explode(F.array(band, band - 1)).alias("band"))
    rows = B.stored(rows, "prefixes")
    tiles = rows.groupBy("shingle", "band").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("own").alias("least")).where("lo < hi and least = band").select("shingle", "band", "n")
    side = F.ceil(F.col("n") / SIDE).cast("int")
    rows = rows.join(tiles, ["shingle", "band"]).join(kept.select("node", "size", "bits", "lead"), "node")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("node"), side).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), side - 1)))
    rows = rows.withColumns({"row": F.least("mine", "other"), "col": F.greatest("mine", "other")}).drop("other", "n")
    keys = ["shingle", "band", "row", "col"]

    def pairs(table: pa.Table) -> tuple[list, list]:
        tile = _Tile(table, t)
        comp, mine, own = (table.column(c).to_numpy()[tile.order] for c in ("component", "mine", "own"))
        lead = table.column("lead").to_pylist()
        shingle, band = (table.column(c)[0].as_py() for c in ("shingle", "band"))
        off = table.column("row")[0].as_py() != table.column("col")[0].as_py()
        before: dict[int, set] = {}

        def earlier(i: int) -> set:
            if i not in before:
                x = np.frombuffer(lead[tile.order[i]], np.int64)
                before[i] = set(x[: int(np.flatnonzero(x == shingle)[0])].tolist())
            return before[i]

        a, b = [], []
        for i in range(len(comp) - 1):
            later = np.arange(i + 1, len(comp))
            fit = (comp[later] != comp[i]) & ((own[later] == band) | (own[i] == band))
            if off:
                fit &= mine[later] != mine[i]
            for j in tile.near(i, later[fit]):
                if earlier(i).isdisjoint(earlier(int(j))):
                    a.append(tile.node[i])
                    b.append(tile.node[j])
        return a, b

    schema = "a long, b long"
    found = rows.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(lambda b: _pairs(b, keys, pairs), schema)
    found = B.stored(found, "pairs")
    sets = [kept.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("shingles").alias(f"set_{x}")) for x in "ab"]

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            cols = [T.column(part, c).to_pylist() for c in ("set_a", "set_b", "size_a", "size_b")]
            fit = [_linked(np.sort(np.frombuffer(x, U64)), np.sort(np.frombuffer(y, U64)), n, m, t) for x, y, n, m in zip(*cols, strict=True)]
            yield part.select(["a", "b"]).filter(pa.array(fit, pa.bool_()))

    return B.stored(found.join(sets[0], "a").join(sets[1], "b").select("a", "b", "size_a", "size_b", "set_a", "set_b").mapInArrow(decide, schema), "links")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, block_mb: int = 14) -> DataFrame:
    """doc_id, n_shingles and component_id of every row: documents link at a Jaccard similarity of percent / 100 or more of their word k-shingles."""
    t = Fraction(percent, 100)
    spark = docs.sparkSession
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sets = _sets(docs, k)
    full = sets.where("n > 0 and doc_id is not null")
    reps = full.groupBy("d1", "d2", "n").agg(F.min(F.struct("doc_id", "t")).alias("rep"))
    reps = B.stored(reps.select("d1", "d2", "n", F.col("rep.doc_id").alias("rep"), F.col("rep.t").alias("t")), "classes")
    kept = _repeated(docs, reps, k, t, block_mb)
    # a row's own id joins it to the class that stands for its set, also where ids repeat
    same = full.join(reps, ["d1", "d2", "n"]).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    first = components(_first_links(kept, t, parts), "near")
    rest = _rest(kept, first, t, parts)
    known = components(same.union(first.select("node", "component")).union(rest), "all")
    known = known.select(F.col("node").alias("doc_id"), "component")
    return sets.join(known, "doc_id", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
