"""Approximate nearest neighbours: NN-descent builds a neighbour graph, greedy search answers.

Dong, Moses and Li, Efficient k-nearest neighbor graph construction for generic similarity
measures (2011), on tables in the shared folder:

1. Rows with equal vectors are one node, the smallest vec_id; copies are put back at the end.
2. Nodes are dealt twice into random groups of about GROUP and begin with their nearest
   neighbours there; two dealings lead from group to group.
3. A round joins neighbours of neighbours.  Each node takes SAMPLE entries of its list that
   no round has used yet and SAMPLE used ones, and as many of the lists that name it; a join
   fetches the members' vectors, all pairs with an unused member are compared, and what
   is nearer than a member's worst entry is merged into that member's list.  Rounds go on
   until they change less than LEAST of all entries, however many that takes.
4. Queries walk the graph greedily from their own node: the best unexpanded nodes' lists and
   then the vectors of what is new in them are joined in, until all of the best EF nodes
   of a query are expanded.
5. The best found are scored again in double precision on the original vectors.

Samples are drawn by a hash of both ends and the round, as in the paper; entries that were
not drawn stay unused and have their turn later.

Nodes are dealt into blocks by a hash.  A block keeps its lists in one row, and what blocks
tell or ask each other in a step (names, vectors, found entries, beams) is one packed row for
each two of them, so that rows cost next to nothing beside the bytes in them.  A block is one
task; it holds its nodes, their members' vectors and what it found.  A hub gets from each
block no more names than it may use and no more entries than a list has.  recall() measures
the result against brute force.

Defined cases: vectors that are null, empty, zero, of another length than most, or hold
null or non-finite numbers take no part, neither do rows with a null vec_id; repeated rows
count once; ties go to the smaller vec_id; fewer candidates than k give all of them; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from . import blocks as B
from . import tokens as T

U64 = np.uint64
FOUND = "node long, nbrs binary, sims binary"
#: what blocks keep and exchange; kind STATE: a block's nodes or queries, the others of src's block to this one or for itself
ROW = "block int, kind int, src int, a binary, b binary, c binary, d binary, e binary"
NAMES = [c.split()[0] for c in ROW.split(", ")]
STATE, SENT, OWN, VECTORS = 0, 1, 2, 3
#: list length, entries a node hands on in a round, nodes of a random group, share of entries that must change, beam, expansions of a round
K, SAMPLE, GROUP, LEAST, EF, WIDTH = 40, 16, 128, 0.002, 128, 32
#: nodes of a block, below 2**16
BLOCK = 8192


def usable(emb: DataFrame, key: str, vector: str) -> DataFrame:
    """Distinct (vec_id, v) that take part; v: array<double>."""
    v = F.col("v")
    d = emb.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    d = d.where(~F.coalesce(F.exists(v, bad), F.lit(True)) & F.exists(v, lambda x: x != 0)).withColumn("d", F.size(v))
    most = d.groupBy("d").count().orderBy(F.desc("count"), "d").limit(1).select("d")
    return d.join(F.broadcast(most), "d").select("vec_id", "v").distinct()  # one row is broadcast


def _unit(v: pa.Array) -> np.ndarray:
    x = np.asarray(v.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(v), -1)
    big = np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    x = x / np.where(big > 0, big, 1)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _matrix(c: pa.Array, dtype: type = np.float32) -> np.ndarray:
    return np.frombuffer(b"".join(c.to_pylist()), dtype).reshape(len(c), -1) if len(c) else np.zeros((0, 1), dtype)


def _binaries(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in x], pa.binary())


def _flat(c: pa.Array, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all binaries, and how many each has."""
    parts = c.to_pylist()
    return np.frombuffer(b"".join(parts), dtype), np.array([len(x) // np.dtype(dtype).itemsize for x in parts], np.int64)


def _cut(x: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """One binary for each stretch of x."""
    size, raw, at = x.dtype.itemsize, np.ascontiguousarray(x).tobytes(), np.append(0, np.cumsum(lengths))
    return pa.array([raw[a * size : b * size] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())


def _rank(group: np.ndarray) -> np.ndarray:
    """Place of each row in its run of equal values."""
    if not len(group):
        return np.zeros(0, np.int64)
    at = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    return np.arange(len(group)) - np.repeat(at, np.diff(np.append(at, len(group))))


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of a partition sorted by key that hold all rows of each of their keys."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        at = b.column(key).to_numpy()
        new = np.flatnonzero(at[1:] != at[:-1])
        if held and at[0] != held[-1].column(key)[-1].as_py():
            yield pa.Table.from_batches(held)
            held = []
        if len(new):  # the last key may go on in the next batch
            cut = int(new[-1]) + 1
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
            held = [b.slice(cut)]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def _grouped(rows: DataFrame, parts: int, key: str, f, schema: str, *order: str) -> DataFrame:
    """f over tables of whole groups of key, in sorted partitions: no group or partition is held at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, key):
            yield from f(table).to_batches()

    return rows.repartition(parts, key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def _best(u: np.ndarray, w: np.ndarray, s: np.ndarray, k: int) -> pa.Table:
    """FOUND rows: the k best w of each u by similarity."""
    nodes, place = np.unique(u, return_inverse=True)
    bits = s.astype(np.float32).view(np.uint32)
    down = np.where(s < 0, bits, np.uint32(0x7FFFFFFF) - bits)  # ascending for falling similarity
    order = np.argsort(place.astype(U64) << U64(32) | down.astype(U64), kind="stable")
    place, w, s = place[order], w[order], s[order]
    again = np.zeros(len(w), bool)
    again[1:] = (w[1:] == w[:-1]) & (place[1:] == place[:-1])
    place, w, s = place[~again], w[~again], s[~again]
    keep = _rank(place) < k
    place, w, s = place[keep], w[keep], s[keep]
    n = np.bincount(place, minlength=len(nodes))
    return pa.table({"node": nodes, "nbrs": _cut(w, n), "sims": _cut(s.astype(np.float32), n)})


def _start(nodes: DataFrame, n: int, k: int, parts: int) -> DataFrame:
    """FOUND rows from brute force inside random groups, dealt twice."""
    groups = max(1, n // GROUP)
    deal = lambda i: F.pmod(F.xxhash64("node", F.lit(i)), F.lit(groups)) * 2 + i
    rows = nodes.select(F.explode(F.array(deal(0), deal(1))).alias("group"), "node", "h")

    def within(table: pa.Table) -> pa.Table:
        at, ids = (T.column(table, c).to_numpy() for c in ("group", "node"))
        x = _matrix(T.column(table, "h"), np.float16).astype(np.float32)
        edge = np.flatnonzero(np.r_[True, at[1:] != at[:-1], True])
        out = []
        for i, j in zip(edge[:-1], edge[1:], strict=True):
            s = x[i:j] @ x[i:j].T
            np.fill_diagonal(s, -np.inf)
            m = min(k, j - i - 1)
            if m > 0:
                best = np.argpartition(-s, m - 1, axis=1)[:, :m]
                out.append((np.repeat(ids[i:j], m), ids[i:j][best].ravel(), np.take_along_axis(s, best, 1).ravel()))
        u, w, s = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
        return _best(u, w, s, k)

    return _grouped(rows, parts, "group", within, FOUND)


def block_number(n: int) -> int:
    """Blocks of about BLOCK nodes: each is one task of a few hundred MB at most, and tasks are few enough for their own cost not to count."""
    return max(1, -(-n // BLOCK))


def _block_of(ids: np.ndarray, blocks: int) -> np.ndarray:
    return (T.mix(ids.view(U64) ^ U64(0x6A09E667F3BCC909)) % U64(blocks)).astype(np.uint32)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    """A batch of ROW; what a tuple leaves out is null."""
    whole = [(*r, *[None] * (len(NAMES) - len(r))) for r in rows]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in whole], pa.int32() if i < 3 else pa.binary()) for i in range(len(NAMES))], names=NAMES)


def _split(to: np.ndarray, kind: int, src: int, *columns: np.ndarray) -> Iterator[tuple]:
    """A row for each block in `to`: its part of the columns, in their order."""
    if not len(to):
        return
    order = np.argsort(to.astype(np.uint16) if to.max() < 1 << 16 else to, kind="stable")
    to = to[order]
    at = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
    columns = tuple(np.ascontiguousarray(c[order]) for c in columns)
    for i, j in zip(at.tolist(), [*at[1:].tolist(), len(to)], strict=True):
        yield (int(to[i]), kind, src, *[c[i:j].tobytes() for c in columns])


def _batched(rows: Iterator[tuple], most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(len(x) for x in r[3:] if x is not None)
        if size > most:
            yield _rows(held)
            held, size = [], 0
    if held:
        yield _rows(held)


def _mapped(rows: DataFrame, f) -> DataFrame:
    """f(block, src, a, b, ...) over each row, without an exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for block, _, *rest in zip(*columns, strict=True):
                yield from _batched(f(block, *rest))

    return rows.select(*NAMES).mapInArrow(run, ROW)


def _exchanged(rows: DataFrame, blocks: int, f) -> DataFrame:
    """f(block, {kind: rows without block and kind, by src}) over all rows of each block; a partition is a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[int, list[tuple]]] = {}
        for batch in batches:
            for block, kind, *rest in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                held.setdefault(block, {}).setdefault(kind, []).append(tuple(rest))
        for block in sorted(held):
            of = held.pop(block)
            for x in of.values():
                x.sort(key=lambda r: r[0])
            yield from _batched(f(block, of))

    return rows.select(*NAMES).repartitionById(blocks, F.col("block")).mapInArrow(run, ROW)


def _only(rows: DataFrame, columns: str = "abcde", kind: int | None = None) -> DataFrame:
    """The rows (of a kind) with the other columns left unread."""
    rows = rows if kind is None else rows.where(F.col("kind") == kind)
    return rows.select("block", "kind", "src", *[F.col(c) if c in columns else F.lit(None).cast("binary").alias(c) for c in "abcde"])


def _joined_bytes(rows: list[tuple], column: int, dtype: type) -> np.ndarray:
    return np.frombuffer(b"".join(r[column] for r in rows), dtype)


def _lists(row: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes in order, and for each as many places of a list: neighbours, similarities (best first, -inf: not filled), unused ones."""
    ids = np.frombuffer(row[1], np.int64)
    return ids, *[np.frombuffer(row[i], t).reshape(len(ids), -1) for i, t in ((2, np.int64), (3, np.float32), (4, np.bool_))]


def _marks(node: np.ndarray, nbr: np.ndarray, turn: int) -> np.ndarray:
    return T.mix(T.mix(node.view(U64) + U64(turn)) ^ T.mix(nbr.view(U64) * U64(0x9E3779B97F4A7C15)))


def _handed(ids: np.ndarray, nbrs: np.ndarray, sims: np.ndarray, fresh: np.ndarray, n: int, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """Which entries a round hands on: n unused and n used ones of each node, by a hash."""
    live, mark = sims > -np.inf, _marks(ids[:, None], nbrs, turn) >> U64(1)
    out = []
    for those in (live & fresh, live & ~fresh):
        key = np.where(those, mark, ~U64(0))
        out.append(those & (key <= np.partition(key, n - 1, axis=1)[:, n - 1 : n]) if n < key.shape[1] else those)
    return out[0], out[1]


def _down(s: np.ndarray) -> np.ndarray:
    """Ascending for falling similarity."""
    bits = s.astype(np.float32).view(np.uint32)
    return np.where(bits >> np.uint32(31) > 0, bits, np.uint32(0x7FFFFFFF) - bits)


def _within(group: np.ndarray, fall: np.ndarray, n: int) -> np.ndarray:
    """Places of the n entries of each group that come first by fall (below 2**32), in order."""
    order = np.argsort(group.astype(U64) << U64(32) | fall.astype(U64), kind="stable")
    return order[_rank(group[order]) < n]


def _merged(ids: np.ndarray, nbrs: np.ndarray, sims: np.ndarray, fresh: np.ndarray, at: np.ndarray, new: np.ndarray, s: np.ndarray) -> tuple[int, bytes, bytes, bytes, bytes]:
    """The lists with entries (at: place of the node, new, s) merged in, and how many of them are new."""
    a, j = np.nonzero(sims > -np.inf)
    group, w, val = np.r_[a, at].astype(np.int64), np.r_[nbrs[a, j], new], np.r_[sims[a, j], s].astype(np.float32)
    late, unused = np.arange(len(w)) >= len(a), np.r_[fresh[a, j], np.ones(len(new), bool)]
    key = group.astype(U64) << U64(44) | T.mix(w.view(U64)) >> U64(21) << U64(1) | late.astype(U64)  # of a repeated entry the list's own stays
    order = np.argsort(key)
    key = key[order] >> U64(1)
    if len(key):
        order = order[np.r_[True, key[1:] != key[:-1]]]
    keep = order[_within(group[order], _down(val[order]), nbrs.shape[1])]
    place = _rank(group[keep])
    out = np.repeat(ids[:, None], nbrs.shape[1], axis=1), np.full(sims.shape, -np.inf, np.float32), np.zeros(fresh.shape, bool)
    for x, y in zip(out, (w, val, unused), strict=True):
        x[group[keep], place] = y[keep]
    return int(late[keep].sum()), ids.tobytes(), *[x.tobytes() for x in out]


def _vectors(row: tuple, n: int) -> np.ndarray:
    return np.frombuffer(row[5], np.float16).reshape(n, -1)


def _first(nodes: DataFrame, found: DataFrame, k: int, blocks: int) -> DataFrame:
    """Rows STATE (lists) and VECTORS of all blocks, from nodes (node, h) and FOUND rows."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in batches:
            ids = p.column("node").to_numpy()
            yield from _batched((b, VECTORS, 0, i, None, None, None, h) for b, _, _, i, h in _split(_block_of(ids, blocks), VECTORS, 0, ids, _matrix(p.column("h"), np.float16)))

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in batches:
            (w, n), (s, _) = _flat(p.column("nbrs"), np.int64), _flat(p.column("sims"), np.float32)
            at = np.repeat(p.column("node").to_numpy(), n)
            yield from _batched(_split(_block_of(at, blocks), SENT, 0, at, w, s))

    def gather(block: int, of: dict[int, list[tuple]]) -> Iterator[tuple]:
        ids, parts = _joined_bytes(of[VECTORS], 1, np.int64), of.get(SENT, [])
        order = np.argsort(ids)
        yield block, VECTORS, 0, ids[order].tobytes(), None, None, None, _joined_bytes(of[VECTORS], 5, np.float16).reshape(len(ids), -1)[order].tobytes()
        ids, shape = ids[order], (len(ids), k)
        at, w, s = (_joined_bytes(parts, i, t) for i, t in ((1, np.int64), (2, np.int64), (3, np.float32)))
        yield block, STATE, *_merged(ids, np.zeros(shape, np.int64), np.full(shape, -np.inf, np.float32), np.zeros(shape, bool), np.searchsorted(ids, at), w, s)

    return B.stored(_exchanged(nodes.mapInArrow(deal, ROW).unionByName(found.mapInArrow(lists, ROW)), blocks, gather), "graph")


def _links(graph: DataFrame, blocks: int, sample: int, turn: int) -> DataFrame:
    """Of each block whom a round joins at its nodes (OWN), and the other blocks' nodes whose vectors it needs (SENT)."""

    def backward(block: int, *row: bytes) -> Iterator[tuple]:
        ids, nbrs, sims, fresh = _lists(row)
        f, u = _handed(ids, nbrs, sims, fresh, sample, turn)
        at, j = np.nonzero(f | u)
        node, nbr, new = ids[at], nbrs[at, j], f[at, j]
        cell = (T.mix(nbr.view(U64)) >> U64(48)).astype(np.int64) * 2 + new
        many = np.bincount(cell, minlength=1 << 17)[cell] > sample
        if many.any():  # a hub gets no more than it may use from each block
            i = np.flatnonzero(many)
            _, who = np.unique(nbr[i], return_inverse=True)
            many[i[_within(who * 2 + new[i], _marks(node[i], nbr[i], turn) >> U64(32), sample)]] = False
            node, nbr, new = node[~many], nbr[~many], new[~many]
        yield from _split(_block_of(nbr, blocks), SENT, block, nbr, node, new)

    def members(block: int, of: dict[int, list[tuple]]) -> Iterator[tuple]:
        ids, nbrs, sims, fresh = _lists(of[STATE][0])
        f, u = _handed(ids, nbrs, sims, fresh, sample, turn)
        at, j = np.nonzero(f | u)
        nbr, node, new = (_joined_bytes(of.get(SENT, []), i, t) for i, t in ((1, np.int64), (2, np.int64), (3, np.bool_)))
        place = np.searchsorted(ids, nbr)
        keep = _within(place * 2 + new, _marks(node, nbr, turn) >> U64(32), sample)
        at, member, new = np.r_[at, place[keep]], np.r_[nbrs[at, j], node[keep]], np.r_[f[at, j], new[keep]]
        some = (np.bincount(at, new, len(ids)) > 0)[at]  # without an unused member nothing is compared
        asked, inverse = np.unique(member[some], return_inverse=True)
        to = _block_of(asked, blocks)
        order = np.argsort(to, kind="stable")
        index = np.empty(len(asked), np.int64)
        index[order] = np.arange(len(asked))
        key = np.sort(at[some].astype(U64) << U64(33) | index[inverse].astype(U64) << U64(1) | (~new[some]).astype(U64))
        key = key[np.r_[True, key[1:] >> U64(1) != key[:-1] >> U64(1)]] if len(key) else key
        counts = np.bincount((key >> U64(33)).astype(np.int64), minlength=len(ids)).astype(np.int32)
        index = ((key >> U64(1)) & U64(0xFFFFFFFF)).astype(np.int32)
        yield block, OWN, block, counts.tobytes(), index.tobytes(), (key & U64(1) == 0).tobytes(), asked[order].tobytes()
        yield from _split(to, SENT, block, asked)

    return B.stored(_exchanged(_only(graph, "abcd").unionByName(_mapped(_only(graph, "abcd"), backward)), blocks, members), "links")


def _joined(graph: DataFrame, vectors: DataFrame, links: DataFrame, k: int, blocks: int) -> DataFrame:
    """Entries that a round finds, for the block of their node: its place there, the neighbour, the similarity."""

    def answers(block: int, of: dict[int, list[tuple]]) -> Iterator[tuple]:
        ids = np.frombuffer(of[VECTORS][0][1], np.int64)
        x = _vectors(of[VECTORS][0], len(ids))
        bar = np.ascontiguousarray(np.frombuffer(of[STATE][0][3], np.float32).reshape(len(ids), -1)[:, -1])
        for src, a, *_ in of.get(SENT, []):
            place = np.searchsorted(ids, np.frombuffer(a, np.int64))
            yield src, SENT, block, x[place].tobytes(), bar[place].tobytes(), place.astype(np.int32).tobytes()

    def join(block: int, of: dict[int, list[tuple]]) -> Iterator[tuple]:
        counts, index, fresh, asked = (np.frombuffer(of[OWN][0][i], t) for i, t in ((1, np.int32), (2, np.int32), (3, np.bool_), (4, np.int64)))
        if not len(index):
            return
        n = len(asked)  # also the index of a filler, that is near to nothing
        x = _joined_bytes(of[SENT], 1, np.float16).reshape(n, -1).astype(np.float32)
        x = np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)])
        bar, place = np.append(_joined_bytes(of[SENT], 2, np.float32), np.float32(np.inf)), _joined_bytes(of[SENT], 3, np.int32)
        home = np.repeat(np.array([r[0] for r in of[SENT]], np.uint32), [len(r[3]) // 4 for r in of[SENT]])
        counts = counts[counts > 0]
        width = int(counts.max())
        who, new = np.full((len(counts), width), n, np.int32), np.zeros((len(counts), width), bool)
        filled = np.arange(width) < counts[:, None]
        who[filled], new[filled] = index, fresh
        step = max(1, (1 << 20) // (width * max(width, x.shape[1])))  # groups compared at once
        own, out = np.arange(width), []
        for lo in range(0, len(counts), step):
            i, f = who[lo : lo + step], new[lo : lo + step]
            y = x[i]
            s = y @ y.transpose(0, 2, 1)
            fit = (f[:, :, None] & filled[lo : lo + step, None, :]) | f[:, None, :]
            fit &= s > bar[i][:, :, None]
            fit[:, own, own] = False
            hit = np.flatnonzero(fit)
            row = hit // width
            flat = i.ravel()
            out.append((flat[row], flat[row // width * width + hit % width], s.ravel()[hit]))
        u, w, s = (np.concatenate(c) for c in zip(*out, strict=True))
        many = np.bincount(u, minlength=n)[u] > k
        if many.any():  # the k best of each node are enough
            i = np.flatnonzero(many)
            i = i[np.argsort(u[i].astype(U64) << U64(32) | _down(s[i]).astype(U64), kind="stable")]
            again = np.r_[False, (u[i][1:] == u[i][:-1]) & (w[i][1:] == w[i][:-1])]
            i = i[~again]
            i = np.r_[np.flatnonzero(~many), i[_rank(u[i]) < k]]
            u, w, s = u[i], w[i], s[i]
        yield from _split(home[u], SENT, block, place[u], asked[w], s)

    answered = _exchanged(_only(links, "a", SENT).unionByName(_only(graph, "ac")).unionByName(vectors), blocks, answers)
    return _exchanged(_only(links, "abcd", OWN).unionByName(answered), blocks, join)


def _forget(*rows: DataFrame) -> None:
    """Deletes stored tables that a later one has replaced."""
    for df in rows:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        for at in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(conf).delete(path, True)


def _built(nodes: DataFrame, n: int, k: int, sample: int, least: float) -> tuple[DataFrame, DataFrame, int]:
    """The lists of all nodes (rows STATE), their vectors (rows VECTORS) and the number of blocks."""
    parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // 8192))
    blocks = block_number(n)
    first = _first(nodes, _start(nodes, n, k, parts), k, blocks)
    graph, vectors, turn = _only(first, "abcd", STATE), _only(first, "ae", VECTORS), 0
    while True:
        links = _links(graph, blocks, sample, turn)

        def merge(block: int, of: dict[int, list[tuple]], turn: int = turn) -> Iterator[tuple]:
            ids, nbrs, sims, fresh = _lists(of[STATE][0])
            used, _ = _handed(ids, nbrs, sims, fresh, sample, turn)
            found = [_joined_bytes(of.get(SENT, []), i, t) for i, t in ((1, np.int32), (2, np.int64), (3, np.float32))]
            yield block, STATE, *_merged(ids, nbrs, sims, fresh & ~used, *found)

        merged = B.stored(_exchanged(_only(graph, "abcd").unionByName(_joined(graph, vectors, links, k, blocks)), blocks, merge), "graph")
        _forget(links, *[graph] * (turn > 0))
        graph, turn = merged, turn + 1
        if (merged.agg(F.sum("src")).first()[0] or 0) <= least * n * k:  # of lists, src is the number of entries that changed
            return graph, vectors, blocks


def build_graph(nodes: DataFrame, n: int, k: int = K, sample: int = SAMPLE, least: float = LEAST) -> DataFrame:
    """FOUND rows: the neighbour lists of all nodes (node, h), n in number."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in zip(*[c.to_pylist() for c in batch.columns[2:]], strict=True):
                ids, nbrs, sims, _ = _lists(r)
                live = sims > -np.inf
                n = live.sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(ids), _cut(nbrs[live], n), _cut(sims[live], n)], names=["node", "nbrs", "sims"])

    return _built(nodes, n, k, sample, least)[0].select(*NAMES).mapInArrow(rows, FOUND)


def _beams(row: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Queries, and of each the best found, their similarities (best first, -inf: not filled), which are not expanded, and its vector."""
    q = np.frombuffer(row[1], np.int64)
    return q, *[np.frombuffer(row[i], t).reshape(len(q), -1) for i, t in ((2, np.int64), (3, np.float32), (4, np.bool_), (5, np.float16))]


def search(graph: DataFrame, vectors: DataFrame, queries: DataFrame, blocks: int, ef: int = EF, width: int = WIDTH) -> DataFrame:
    """(q, found) of the ef nodes nearest to each query node that greedy search meets; graph and vectors as _built made them."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in batches:
            q = p.column("node").to_numpy()
            yield from _batched(_split(_block_of(q, blocks), SENT, 0, q))

    def beams(q: np.ndarray, ids: np.ndarray, sims: np.ndarray, open_: np.ndarray, v: np.ndarray) -> tuple:
        return int(open_.sum()), *[np.ascontiguousarray(x).tobytes() for x in (q, ids, sims, open_, v)]  # src: how many are not expanded

    def begin(block: int, of: dict[int, list[tuple]]) -> Iterator[tuple]:
        if SENT not in of:
            return
        ids, nbrs, sims, _ = _lists(of[STATE][0])
        q = np.unique(_joined_bytes(of[SENT], 1, np.int64))
        at, n = np.searchsorted(ids, q), min(ef, nbrs.shape[1])
        best, near = np.repeat(q[:, None], ef, axis=1), np.full((len(q), ef), -np.inf, np.float32)
        best[:, :n], near[:, :n] = nbrs[at, :n], sims[at, :n]
        yield block, STATE, *beams(q, best, near, near > -np.inf, _vectors(of[VECTORS][0], len(ids))[at])
        seen = np.concatenate([q[:, None], nbrs[at]], axis=1)
        yield block, VECTORS, block, np.repeat(np.arange(len(q), dtype=np.int32), seen.shape[1]).tobytes(), seen.tobytes()

    def expanded(open_: np.ndarray) -> np.ndarray:
        return open_ & (np.cumsum(open_, axis=1) <= width)

    def expansions(block: int, *row: bytes) -> Iterator[tuple]:
        _, ids, _, open_, _ = _beams((*row[:5], b""))
        node = np.unique(ids[expanded(open_)])
        yield from _split(_block_of(node, blocks), SENT, block, node)

    def neighbours_of(block: int, of: dict[int, list[tuple]]) -> Iterator[tuple]:
        ids = np.frombuffer(of[STATE][0][1], np.int64)
        nbrs = np.frombuffer(of[STATE][0][2], np.int64).reshape(len(ids), -1)
        for src, a, *_ in of.get(SENT, []):
            node = np.frombuffer(a, np.int64)
            yield src, SENT, block, node.tobytes(), nbrs[np.searchsorted(ids, node)].tobytes()

    def unseen(block: int, of: dict[int, list[tuple]]) -> Iterator[tuple]:
        if SENT not in of:  # all of the block's queries have ended
            return
        q, ids, _, open_, _ = _beams((*of[STATE][0][:5], b""))
        node = _joined_bytes(of[SENT], 1, np.int64)
        lists = _joined_bytes(of[SENT], 2, np.int64).reshape(len(node), -1)
        order = np.argsort(node)
        i, j = np.nonzero(expanded(open_))
        met = lists[order[np.searchsorted(node[order], ids[i, j])]]
        every = np.r_[_joined_bytes(of[VECTORS], 2, np.int64), met.ravel()]
        asker = np.r_[_joined_bytes(of[VECTORS], 1, np.int32), np.repeat(i, met.shape[1])].astype(np.int64)
        known = np.arange(len(every)) < len(every) - met.size
        asked, inverse = np.unique(every, return_inverse=True)
        key = np.sort(asker.astype(U64) << U64(33) | inverse.astype(U64) << U64(1) | (~known).astype(U64))
        pair = key >> U64(1)
        new = pair[np.r_[True, pair[1:] != pair[:-1]] & (key & U64(1) == 1)]
        index = (new & U64(0xFFFFFFFF)).astype(np.int64)
        asked, index = np.unique(asked[index], return_inverse=True)
        to = _block_of(asked, blocks)
        order = np.argsort(to, kind="stable")
        place = np.empty(len(asked), np.int32)
        place[order] = np.arange(len(asked))
        yield block, OWN, block, (new >> U64(32)).astype(np.int32).tobytes(), place[index].tobytes(), asked[order].tobytes()
        yield from _split(to, SENT, block, asked)

    def vectors_of(block: int, of: dict[int, list[tuple]]) -> Iterator[tuple]:
        ids = np.frombuffer(of[VECTORS][0][1], np.int64)
        x = _vectors(of[VECTORS][0], len(ids))
        for src, a, *_ in of.get(SENT, []):
            yield src, SENT, block, x[np.searchsorted(ids, np.frombuffer(a, np.int64))].tobytes()

    def walk(block: int, of: dict[int, list[tuple]]) -> Iterator[tuple]:
        q, ids, sims, open_, v = _beams(of[STATE][0])
        open_ = open_ & ~expanded(open_)
        yield from ((block, VECTORS, *r) for r in of[VECTORS])
        if OWN in of and len(of[OWN][0][1]):
            asker, index, asked = (np.frombuffer(of[OWN][0][i], t) for i, t in ((1, np.int32), (2, np.int32), (3, np.int64)))
            x, new = _joined_bytes(of[SENT], 1, np.float16).reshape(len(asked), -1), asked[index]
            yield block, VECTORS, block, asker.tobytes(), new.tobytes()
            near = np.empty(len(new), np.float32)
            edge = np.searchsorted(asker, np.arange(len(q) + 1))
            for i in range(len(q)):
                near[edge[i] : edge[i + 1]] = x[index[edge[i] : edge[i + 1]]].astype(np.float32) @ v[i].astype(np.float32)
            a, j = np.nonzero(sims > -np.inf)
            group, every, val, more = np.r_[a, asker], np.r_[ids[a, j], new], np.r_[sims[a, j], near], np.r_[open_[a, j], np.ones(len(new), bool)]
            keep = _within(group, _down(val), ef)
            place = _rank(group[keep])
            ids, sims, open_ = np.repeat(q[:, None], ef, axis=1), np.full(sims.shape, -np.inf, np.float32), np.zeros(open_.shape, bool)
            for y, z in ((ids, every), (sims, val), (open_, more)):
                y[group[keep], place] = z[keep]
        yield block, STATE, *beams(q, ids, sims, open_, v)

    def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in zip(*[c.to_pylist() for c in batch.columns[2:]], strict=True):
                q, ids, sims, _, _ = _beams(r)
                live = sims > -np.inf
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q, live.sum(1))), pa.array(ids[live])], names=["q", "found"])

    state = B.stored(_exchanged(_only(graph, "abcd").unionByName(vectors).unionByName(queries.select("node").mapInArrow(deal, ROW)), blocks, begin), "beams")
    while state.where(F.col("kind") == STATE).agg(F.sum("src")).first()[0]:
        asked = _mapped(_only(state, "abcd", STATE), expansions)
        met = _exchanged(_only(graph, "ab").unionByName(asked), blocks, neighbours_of)
        rows = _only(state, "abcd", STATE).unionByName(_only(state, "ab", VECTORS)).unionByName(met)
        new = B.stored(_exchanged(rows, blocks, unseen), "met")
        got = _exchanged(vectors.unionByName(_only(new, "a", SENT)), blocks, vectors_of)
        after = B.stored(_exchanged(state.unionByName(_only(new, "abc", OWN)).unionByName(got), blocks, walk), "beams")
        _forget(state, new)
        state = after
    return _only(state, kind=STATE).select(*NAMES).mapInArrow(result, "q long, found long")


def cosine(a: Column, b: Column) -> Column:
    """In double precision, numbers added in order."""
    add = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    dot = add(F.zip_with(a, b, lambda x, y: x * y))
    return dot / (F.sqrt(add(F.transform(a, lambda x: x * x))) * F.sqrt(add(F.transform(b, lambda x: x * x))))


def neighbours(emb: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", list_length: int = K, ef: int = EF) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row where is_query (of vec_id) holds, its own row excepted."""
    rows = B.stored(usable(emb, key, vector), "vectors")
    copies = B.stored(rows.groupBy("v").agg(F.min("vec_id").alias("node")), "distinct")
    n = copies.count()

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in batches:
            if p.num_rows:
                x = _unit(p.column("v"))
                yield pa.RecordBatch.from_arrays([p.column("node"), _binaries(x.astype(np.float16))], names=["node", "h"])

    nodes = B.stored(copies.mapInArrow(units, "node long, h binary"), "nodes")
    graph, vectors, blocks = _built(nodes, n, max(list_length, k), SAMPLE, LEAST)
    # a node's first k + 1 rows are enough for any query; ranks are limited before the exchange
    members = rows.join(copies, "v").select("node", "vec_id")
    members = B.stored(members, "members")
    few = members.withColumn("i", F.row_number().over(_by("node", "vec_id"))).where(F.col("i") <= k + 1).select("node", "vec_id")
    queries = members.where(is_query).select(F.col("vec_id").alias("query_id"), "node")
    own = B.stored(queries.select("node").distinct(), "query-nodes")
    found = search(graph, vectors, own, blocks, max(ef, 4 * k))
    found = found.union(own.select(F.col("node").alias("q"), F.col("node").alias("found")))
    of = lambda name: copies.select(F.col("node").alias(name), F.col("v").alias(f"v_{name}"))
    exact = B.stored(found.join(of("q"), "q").join(of("found"), "found").select("q", "found", cosine(F.col("v_q"), F.col("v_found")).alias("score")), "scores")
    # the nearest k + 1 nodes hold the nearest k rows
    exact = exact.withColumn("i", F.row_number().over(_by("q", F.desc("score"), "found"))).where(F.col("i") <= k + 1 + ef).drop("i")
    near = exact.join(few.withColumnRenamed("node", "found"), "found").join(queries.withColumnRenamed("node", "q"), "q").where("vec_id <> query_id")
    ranked = near.withColumn("rank", F.row_number().over(_by("query_id", F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _by(key: str | tuple[str, ...], *order: Column | str) -> WindowSpec:
    return Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*order)


def recall(emb: DataFrame, found: DataFrame, queries: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> float:
    """Share of the true k nearest of the stated queries that `found` has; the queries are collected, all rows are scanned in blocks."""
    rows = usable(emb, key, vector)
    q = rows.where(queries).toArrow()
    ids, x = q.column("vec_id").to_numpy(), _unit(T.column(q, "v")) if q.num_rows else np.zeros((0, 1), np.float32)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in batches:
            if p.num_rows and len(ids):
                own = p.column("vec_id").to_numpy()
                s = x @ _unit(p.column("v")).T
                s[ids[:, None] == own[None, :]] = -np.inf
                m = min(k, len(own))
                top = np.argpartition(-s, m - 1, axis=1)[:, :m]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, m)), pa.array(own[top].ravel()), pa.array(np.take_along_axis(s, top, 1).ravel().astype(np.float64))], names=["query_id", "vec_id", "s"])

    true = rows.mapInArrow(best, "query_id long, vec_id long, s double").where("s > -2").withColumn("i", F.row_number().over(_by("query_id", F.desc("s"), "vec_id"))).where(F.col("i") <= k)
    hit = true.join(found.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").count()
    return hit / max(1, true.count())
