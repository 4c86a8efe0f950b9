"""Katz back-off language model: Good-Turing discounts, exactly normalised back-off weights.

    P(w | h) = d(c) c(hw) / c(h)          if hw was seen
             = alpha(h) P(w | h')         otherwise; h' drops the oldest word
             = P(w | h')                  if h was not seen
    alpha(h) = (1 - sum of the discounted P) / (1 - sum of P(w | h') over the seen w)

Unigrams are discounted too and what they leave is the probability of one further type,
<unk>; so P sums to 1 over the V + 1 types after every history.  Where a history's counts
leave nothing to back off with (all above the discounted range), its denominator is c(h)+1.

Counting and look-up are one exchange per order, one order after the other, between blocks of documents and buckets of
the n-gram space (see blocks.py): a block sends its distinct n-grams with their training
counts, a bucket adds up, and the answers are a written table, partitioned by order.  For
each n-gram one block is named owner; owners sum discounted and lower-order mass by history,
and a second exchange adds these to alpha(h).  The last pass evaluates token by token, from
the lowest order up.

A bucket also says which n-grams only one block holds.  What holds such an n-gram, the longer
n-grams that begin or end with it and the history that it is, only that block has too: it
counts and weighs them itself, exactly, and they are not exchanged.  Everything gathered follows the corpus; the driver sees only
counts of counts.

fit() keeps what the buckets know as two written tables, n-grams with their counts and
histories with c(h) and alpha(h), each partitioned by order and cut into the same buckets;
Katz.score() looks up the n-grams and histories of any other texts there.

Defined cases: null and empty texts are one token (the end); a null doc_id counts as the
text "" in the split rule; every row is scored on its own, repeated ids too; other columns
are ignored; without training text every token has probability 1 / (V + 1) = 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import tokens as T

U64 = np.uint64
END, START = U64(0xE2D0000000000001), U64(0x57A2700000000001)
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
#: counts up to GT_MAX are discounted
GT_MAX = 5
_EPS = 1e-12


def discounts(n: list[int], top: int = GT_MAX) -> np.ndarray:
    """Katz's d for counts 0..top (1 beyond), from n[r], the number of n-grams seen r times, r up to top + 1.

    A discount outside (0, 1], or one that needs a count of counts that is 0, is 1.
    """
    d = np.ones(top + 2)
    if n[1]:
        cut = (top + 1) * n[top + 1] / n[1]
        for r in range(1, top + 1):
            if n[r] and cut < 1:
                x = ((r + 1) * n[r + 1] / (r * n[r]) - cut) / (1 - cut)
                d[r] = x if 0 < x <= 1 else 1.0
    return d


def _discount(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return d[np.minimum(c, len(d) - 1)] * c


class _Text:
    """Padded token sequences of some texts: order - 1 starts, words, one end."""

    def __init__(self, w: T.Words, order: int) -> None:
        n = np.diff(w.first)
        pad = order - 1
        self.first = np.append(0, np.cumsum(n + pad + 1))
        self.h = np.full(self.first[-1], START, U64)
        shift = np.arange(len(n)) * (pad + 1) + pad
        self.h[np.arange(len(w.hash)) + shift[w.doc]] = w.hash
        self.h[self.first[1:] - 1] = END
        self.rows = w.rows
        here = np.ones(len(self.h), bool)
        for i in range(pad):
            here[self.first[:-1] + i] = False
        self.at = np.flatnonzero(here)  # scored positions
        self.doc = np.repeat(np.arange(len(n)), n + 1)

    def grams(self, k: int) -> np.ndarray:
        """The k-gram that ends at each scored position."""
        return T.grams(self.h, self.at - k + 1, k)


class _Block:
    """All scored tokens of a block's texts: row of the text, whether it trains; n-grams of one order at a time."""

    def __init__(self, table: pa.Table, order: int) -> None:
        self.texts = [_Text(w, order) for w in T.words(T.column(table, "text"), T.whitespace_words(), T.folded())]
        self.row = _join([t.rows[t.doc] for t in self.texts], np.int64)
        self.train = np.asarray(T.column(table, "train"))[self.row]

    def grams(self, k: int) -> _Index:
        return _Index(_join([t.grams(k) for t in self.texts], U64))

    def before(self, flag: np.ndarray) -> np.ndarray:
        """What holds for the token before, in the same text; the first token of a text has none."""
        out = np.zeros(len(flag), bool)
        out[1:] = flag[:-1] & (self.row[1:] == self.row[:-1])
        return out


def _join(parts: list[np.ndarray], dtype: type) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


class _Index:
    """Sorted distinct values, the place of each value among them, and one position of each distinct value."""

    def __init__(self, x: np.ndarray) -> None:
        # the values' high bits, each with its place below them, sort faster than places by value
        low = U64((1 << len(x).bit_length()) - 1)
        order = (np.sort(x & ~low | np.arange(len(x), dtype=U64)) & low).astype(np.int64)
        s = x[order]
        for high in np.unique(s[1:][s[1:] < s[:-1]] & ~low):  # values that differ in low bits only
            run = slice(*np.searchsorted(s & ~low, [high, high + U64(1)]))
            order[run] = order[run][np.argsort(s[run], kind="stable")]
            s[run] = x[order[run]]
        new = np.r_[True, s[1:] != s[:-1]] if len(s) else np.zeros(0, bool)
        self.keys, self.one = s[new], order[new]
        self.place = np.empty(len(x), np.int32)
        self.place[order] = np.cumsum(new, dtype=np.int32) - 1


class Model:
    """What the driver knows of each order: discounts, and of unigrams the denominator and the probability of <unk>."""

    def __init__(self, stats: dict[int, list[int]], order: int) -> None:
        self.d = []
        for k in range(1, order + 1):
            _, total, *n = stats.get(k, [0] * (GT_MAX + 3))
            self.d.append(discounts([0, *n]))
        self.types, self.total, *n = stats.get(1, [0] * (GT_MAX + 3))
        taken = self.total - sum(n[r - 1] * r * (1 - self.d[0][r]) for r in range(1, GT_MAX + 1))
        self.denominator = self.total if self.total - taken > _EPS * self.total else self.total + 1
        self.unknown = 1 - taken / self.denominator


#: an n-gram's answer is its count in steps of STEP, and whether this block is its owner and the only one that has it
OWNER, SOLE, STEP = 1, 2, 4


def _answers(got: pa.Table, kind: str, k: int, keys: np.ndarray, buckets: int) -> np.ndarray:
    """What the exchanges say of a block's k-grams (count and flags) or histories (c(h) + alpha(h) i)."""
    own = got.filter(pc.and_(pc.equal(got.column("kind"), kind), pc.equal(got.column("order"), k)))
    return B.read_answers(own, keys, buckets, np.int64 if kind == "count" else np.complex128)


def _alone(block: _Block, sole: np.ndarray) -> np.ndarray:
    """Positions whose k-gram begins or ends with a (k - 1)-gram that no other block has; sole: of the (k - 1)-grams."""
    return sole | block.before(sole)


def _known(block: _Block, g: _Index, alone: np.ndarray, got: pa.Table, k: int, buckets: int) -> np.ndarray:
    """Count and flags of each k-gram, from the exchange or the block's own count."""
    own = alone[g.one]
    x = np.bincount(g.place[block.train], minlength=len(g.keys)).astype(np.int64) * STEP + (OWNER | SOLE)
    x[~own] = _answers(got, "count", k, g.keys[~own], buckets)
    return x


def _sole(block: _Block, got: pa.Table, order: int, buckets: int) -> np.ndarray:
    """At each position, whether no other block has the n-gram of this order that ends there."""
    sole = np.zeros(len(block.row), bool)
    for k in range(1, order + 1):
        g = block.grams(k)
        sole = (_known(block, g, _alone(block, sole), got, k, buckets) & SOLE > 0)[g.place]
    return sole


def _histories(block: _Block, g: _Index, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted (k - 1)-grams g with the history of a text's first token, the place of each position's history among them, and that of the first's."""
    first = T.grams(np.full(k - 1, START), np.zeros(1, np.int64), k - 1)[0]
    i = int(np.searchsorted(g.keys, first))
    place = np.full(len(g.place), i, np.int32)
    inner = np.flatnonzero(block.row[1:] == block.row[:-1])
    before = g.place[inner]
    place[inner + 1] = before + (before >= i)
    return np.insert(g.keys, i, first), place, i


def _sums(g: _Index, x: np.ndarray, place: np.ndarray, p: np.ndarray, d: np.ndarray, of: np.ndarray) -> list[np.ndarray]:
    """By history, over the seen n-grams that the block owns: counts, discounted counts, lower-order probabilities; of: the histories asked for."""
    at = place[g.one]
    use = np.flatnonzero((x & OWNER > 0) & (x >= STEP) & of[at])
    c, at = x[use] // STEP, at[use]
    return [np.bincount(at, y, len(of)) for y in (c, _discount(c, d), p[g.one[use]])]


def _weights(c: np.ndarray, taken: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """c(h) + alpha(h) i from whole sums."""
    c = np.where(c - taken > _EPS * c, c, c + (c > 0))
    free = 1 - lower
    alpha = np.where(free > 0, (1 - taken / np.where(c > 0, c, 1)) / np.where(free > 0, free, 1), 0)
    return np.where((free > 0) | (c == 0), c, taken) + 1j * alpha  # nothing to back off to: the seen take all


def _probabilities(block: _Block, got: pa.Table, model: Model, order: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, _Index, np.ndarray]]:
    """For k = 1 to order: at all positions, counts of the k-grams and P of the tokens by order k; the k-grams, and what is known of each.

    An n-gram that was not seen backs off to the order below, whose P is the one before.
    """
    p, sole, g, x = np.zeros(0), np.zeros(len(block.row), bool), None, None
    for k in range(1, order + 1):
        if k > 1:
            keys, place, i = _histories(block, g, k)
            own = np.insert(x & SOLE > 0, i, False)
        g = block.grams(k)
        x = _known(block, g, _alone(block, sole), got, k, buckets)
        c = (x // STEP)[g.place]
        if k == 1:
            p = np.where(c > 0, _discount(c, model.d[0]) / max(model.denominator, 1), model.unknown)
        else:
            a = _weights(*_sums(g, x, place, p, model.d[k - 1], own))
            a[~own] = _answers(got, "alpha", k, keys[~own], buckets)
            a = a[place]
            del keys, place, own
            p = np.where(c > 0, _discount(c, model.d[k - 1]) / np.where(a.real > 0, a.real, 1), np.where(a.real > 0, a.imag * p, p))
            del a
        sole = (x & SOLE > 0)[g.place]
        yield c, p, g, x


#: block -1: the bucket's own keys and values, kept for the model
COUNTS = "block int, bucket int, answer binary, keys binary, stat array<bigint>"
ALPHAS = "block int, bucket int, answer binary, keys binary"


def _kept(rows: pa.Table, bucket: int, keys: np.ndarray | None, values: np.ndarray | None) -> pa.Table:
    """Answers, and the bucket's row of the model where there are keys to keep."""
    rows = rows.append_column("keys", pa.nulls(rows.num_rows, pa.binary()))
    if keys is None:
        return rows
    own = pa.table({"block": pa.array([-1], pa.int32()), "bucket": pa.array([bucket], pa.int32()), "answer": pa.array([B.squeezed(B.planes(values))], pa.binary()), "keys": pa.array([B.pack(keys)], pa.binary())})
    return pa.concat_tables([rows, own.select(rows.column_names)])


def _count_tables(blocks: DataFrame, order: int, n: int, keep: bool) -> DataFrame:
    """n-gram counts of all orders, one after the other, as answers to the blocks that asked, with a bucket's counts of counts.

    Row -1 of a bucket has these; a block's of what it alone has come to a bucket as such a row.
    A model that is kept needs all n-grams in the buckets, so there nothing counts as one block's.
    """

    def stat(counts: np.ndarray) -> np.ndarray:
        often = np.bincount(np.minimum(counts, GT_MAX + 2), minlength=GT_MAX + 3)
        return np.array([(counts > 0).sum(), counts.sum(), *often[1 : GT_MAX + 2]], np.int64)

    def ask_for(k: int):
        def ask(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table | None) -> pa.Table:
            block, at = _Block(table, order), key[0].as_py()
            alone = _alone(block, _sole(block, answers, k - 1, n))
            own = block.grams(k)
            counts, mine = np.bincount(own.place[block.train], minlength=len(own.keys)).astype(np.int32), alone[own.one]
            rows = B.requests(at, own.keys[~mine], n, [counts[~mine]])
            if not mine.any():
                return rows
            said = pa.table({"bucket": [at % n], "block": [-1], "keys": [b""], "extra": [stat(counts[mine]).tobytes()]}, rows.schema)
            return pa.concat_tables([rows, said])

        return ask if k > 1 else lambda key, table: ask(key, table, None)

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        said = table.filter(pc.less(table.column("block"), 0)).column("extra").to_pylist()
        x = B.Merged(table.filter(pc.greater_equal(table.column("block"), 0)), [np.int32])
        total = x.reduce(np.add, x.extra[0].astype(np.int64))
        own = sum((np.frombuffer(b, np.int64) for b in said), stat(total))
        flags = np.zeros(len(x.order), np.int64)
        flags[x.at] = OWNER
        if not keep:
            flags[x.at[np.diff(x.at, append=len(x.order)) == 1]] |= SOLE
        seen = total > 0 if keep else np.zeros(len(total), bool)
        rows = _kept(x.answers(key[0].as_py(), total[x.group] * STEP + flags), key[0].as_py(), x.keys[seen], total[seen] * STEP)
        return rows.append_column("stat", pa.array([*[None] * (rows.num_rows - 1), own.tolist()], pa.list_(pa.int64())))

    out = None
    for k in range(1, order + 1):
        by = blocks.groupBy("block")
        by = by if out is None else by.cogroup(out.where("block >= 0").select("block", "bucket", "answer", "order", "kind").groupBy("block"))
        asked = by.applyInArrow(ask_for(k), B.REQUEST)
        rows = B.stored(asked.groupBy("bucket").applyInArrow(add, COUNTS).withColumns({"order": F.lit(k), "kind": F.lit("count")}), f"ngram-counts-{k}")
        out = rows if out is None else out.unionByName(rows)
    return out


def _alphas(blocks: DataFrame, got: DataFrame, model: Model, k: int, order: int, n: int, keep: bool) -> DataFrame:
    """c(h) and alpha(h) of order k, as answers to the blocks that have the history; alpha(h) only to those that back off from it."""

    def ask(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        block = _Block(table, order)
        *_, (_, p, g, x) = _probabilities(block, answers, model, k - 1, n)
        keys, place, i = _histories(block, g, k)
        others, sole = np.insert(x & SOLE == 0, i, True), (x & SOLE > 0)[g.place]
        g = block.grams(k)
        x = _known(block, g, _alone(block, sole), answers, k, n)
        sums = _sums(g, x, place, p, model.d[k - 1], others)  # each seen n-gram counts once, with its owner
        backs = np.zeros(len(keys), np.uint8)  # only what was not seen asks for alpha(h)
        backs[place[(x < STEP)[g.place]]] = 1
        return B.requests(key[0].as_py(), keys[others], n, [y[others] for y in (*sums, backs)])

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        x = B.Merged(table, [*[np.float64] * 3, np.uint8])
        a = _weights(*(x.reduce(np.add, e) for e in x.extra[:3]))
        seen, said = a.real > 0, a[x.group]
        said.imag[x.extra[3] == 0] = 0
        return _kept(x.answers(key[0].as_py(), said), key[0].as_py(), x.keys[seen] if keep else None, a[seen])

    needed = got.where((F.col("block") >= 0) & (F.col("order") <= k)).select("block", "bucket", "answer", "order", "kind")
    asked = blocks.groupBy("block").cogroup(needed.groupBy("block")).applyInArrow(ask, B.REQUEST)
    rows = asked.groupBy("bucket").applyInArrow(add, ALPHAS).select("*", F.lit(k).alias("order"))
    return B.stored(rows, f"alpha-{k}").withColumn("kind", F.lit("alpha"))


def _blocks(docs: DataFrame, train: F.Column, block_mb: int) -> tuple[DataFrame, int]:
    n = B.block_count(docs, mb=block_mb)
    flagged = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    return B.dealt(flagged.withColumn("block", B.block_of(n, F.col("doc_id"), F.xxhash64("text"))), n, "texts"), n


def _learned(blocks: DataFrame, order: int, n: int, keep: bool) -> tuple[Model, DataFrame]:
    """The driver's numbers, and the answers to all blocks with, if asked, the model's rows."""
    counts = _count_tables(blocks, order, n, keep)
    stats = counts.where("stat is not null").groupBy("order").agg(*[F.sum(F.element_at("stat", i + 1)).alias(f"s{i}") for i in range(GT_MAX + 3)]).collect()
    model = Model({r[0]: list(r[1:]) for r in stats}, order)
    got = counts.select("block", "bucket", "answer", "keys", "order", "kind")
    for k in range(2, order + 1):
        got = got.unionByName(_alphas(blocks, got, model, k, order, n, keep))
    return model, got


def katz_scores(docs: DataFrame, train: F.Column, order: int = 3, block_mb: int = 9) -> DataFrame:
    """The scores of all whole texts by the model of those where train holds (null: not)."""
    blocks, n = _blocks(docs, train, block_mb)
    return _scored(blocks, *_learned(blocks, order, n, False), order, n)


@dataclass
class Katz:
    """A fitted model: its table (kind, order, bucket, keys, answer) and what the driver knows."""

    table: DataFrame
    model: Model
    order: int
    buckets: int

    def score(self, docs: DataFrame, block_mb: int = 9) -> DataFrame:
        """Scores of any texts; all count as held out."""
        blocks, _ = _blocks(docs, F.lit(False), block_mb)
        order, buckets = self.order, self.buckets

        def ask(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            block = _Block(table, order)
            out = []
            for k in range(1, order + 1):
                g = block.grams(k)
                for kind, j, keys in (("count", k, g.keys), ("alpha", k + 1, _histories(block, g, k + 1)[0]))[: 2 if k < order else 1]:
                    rows = B.requests(key[0].as_py(), keys, buckets).drop_columns(["extra"])
                    out.append(rows.append_column("kind", pa.array([kind] * rows.num_rows, pa.string())).append_column("order", pa.array([j] * rows.num_rows, pa.int32())))
            return pa.concat_tables(out)

        def look_up(key: tuple[pa.Scalar, ...], asked: pa.Table, known: pa.Table) -> pa.Table:
            dtype = np.int64 if key[0].as_py() == "count" else np.complex128
            keys = B.unpack(known.column("keys")[0].as_py()) if known.num_rows else np.zeros(0, U64)
            values = B.unplanes(B.unsqueezed(known.column("answer")[0].as_py()), dtype) if known.num_rows else np.zeros(0, dtype)
            keys, values = np.append(keys, U64(0)), np.append(values, dtype(0))  # where nothing is found
            answers = []
            for packed in asked.column("keys").to_pylist():
                own = B.unpack(packed)
                i = np.minimum(np.searchsorted(keys[:-1], own), len(keys) - 1)
                answers.append(B.squeezed(B.planes(np.where(keys[i] == own, values[i], dtype(0)))))
            return asked.drop_columns(["keys"]).append_column("answer", pa.array(answers, pa.binary()))

        by = ("kind", "order", "bucket")
        asked = blocks.groupBy("block").applyInArrow(ask, "bucket int, block int, keys binary, kind string, order int")
        got = asked.groupBy(*by).cogroup(self.table.groupBy(*by)).applyInArrow(look_up, "bucket int, block int, kind string, order int, answer binary")
        return _scored(blocks, self.model, B.stored(got, "looked-up"), order, buckets)


def fit(docs: DataFrame, train: F.Column, order: int = 3, block_mb: int = 9) -> Katz:
    """The model of the texts where train holds (null: not), in a table partitioned by order."""
    blocks, n = _blocks(docs, train, block_mb)
    model, got = _learned(blocks, order, n, True)
    own = got.where("block = -1").select("kind", "order", "bucket", "keys", "answer")
    return Katz(B.stored(own, "katz-model", "order"), model, order, n)


def _scored(blocks: DataFrame, model: Model, got: DataFrame, order: int, n: int) -> DataFrame:
    """Scores of the blocks' texts from the answers to them."""

    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        block = _Block(table, order)
        base, seen, p = np.zeros(0), np.zeros(0, bool), np.zeros(0)
        for k, (c, p, *_) in enumerate(_probabilities(block, answers, model, order, n)):
            if k == 0:
                base, seen = np.log10((c + 1) / (model.total + model.types + 1)), c > 0
        sums = [np.bincount(block.row, x, table.num_rows) for x in (np.ones(len(seen)), seen, base, np.log10(p))]
        cols = [x.astype(np.int64) for x in sums[:2]] + sums[2:]
        held = pc.invert(T.column(table, "train"))
        return pa.table([T.column(table, "doc_id"), held, *map(pa.array, cols[:2]), pa.array(np.full(table.num_rows, model.total, np.int64)), *map(pa.array, cols[2:])], names=[x.split()[0] for x in SCORES.split(", ")])

    answers = got.where("block >= 0").select("block", "bucket", "answer", "order", "kind")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, SCORES)
