"""Toxicity by noisy-channel deobfuscation and a classifier over the restored text.

The channel writes a letter as itself, as a look-alike (leetspeak), several times, or with
a separator after it.  A suspicious stretch of text becomes a lattice: each written
character may stand for several letters or for none.  Viterbi decoding under a trigram
character language model (words with word ends) finds the likeliest original; no path of
the lattice is cut.  Stretches are suspicious if they mix letters and look-alikes, consist
of look-alikes that are not all digits, repeat a letter three times or more, repeat one so
that the plain form is a word the classifier knows, or are at least three separated single
characters; every other word's lattice has one path, itself.

The character model counts the letter trigrams of all plain words of all whole texts, by
bytes: its table has at most 155 ** 3 rows however much text there is, and some thousands
in practice, so it is small enough to broadcast.

The score is a logistic regression over hashed features of the restored words: whole words
and their prefixes, which meet inflected forms.  Feature extraction is vectorised over the
bytes of many texts (tokens.py), decoding is memoised by spelling.

fit() reads labels of the training rows only and takes at most `sample` ids of each label
(the smallest hashes of doc_id), one row of each, and of these at most `sample_bytes` of text
in the same order; the bounds keep text and design matrix on the driver small.  The
intercept is set back to the labels' shares in all training rows.

Defined cases: null and empty texts are scored by the intercept; a null doc_id has no label
and counts as the text "" in the split rule; repeated ids are scored row by row, and the row
with the smallest text hash teaches; rows with a null label teach nothing; without both
labels every score is the share of label 1 (0 if there is none); spellings that are equally
likely are decoded to the first in the order of the look-alikes; other columns are ignored;
whole texts are read.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tokens as T

U64 = np.uint64
#: fixed values: letters that a look-alike may stand for
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t"}
#: channel log-probabilities
SAME, LEET, DROPPED, KEPT = 0.0, -0.7, -0.4, -6.0
PREFIXES = (3, 4, 5, 6, 7, 8)
MEMO = 200_000


class CharModel:
    """Interpolated trigram model over the letters (bytes) of words."""

    def __init__(self, trigrams: dict[str, int]) -> None:
        self.three: dict[str, dict[str, int]] = defaultdict(dict)
        self.two: dict[str, Counter] = defaultdict(Counter)
        self.one: Counter = Counter()
        for t, n in trigrams.items():
            self.three[t[:2]][t[2]] = n
            self.two[t[1]][t[2]] += n
            self.one[t[2]] += n
        self.sum3 = {h: sum(c.values()) for h, c in self.three.items()}
        self.sum2 = {h: sum(c.values()) for h, c in self.two.items()}
        self.sum1 = sum(self.one.values()) + 1
        self.memo: dict[tuple[str, str], float] = {}

    def logp(self, h: str, c: str) -> float:
        if (x := self.memo.get((h, c))) is None:
            p = (self.one[c] + 0.01) / self.sum1
            if n := self.sum2.get(h[1]):
                p = (self.two[h[1]][c] + 2 * p) / (n + 2)
            if n := self.sum3.get(h):
                p = (self.three[h].get(c, 0) + p) / (n + 1)
            x = self.memo[h, c] = math.log(p)
        return x

    def decode(self, written: str) -> str:
        """The likeliest word behind the written characters: Viterbi over (last two letters, letter that may still repeat)."""
        states: dict[tuple[str, str], tuple[float, str]] = {("^^", ""): (0.0, "")}
        for ch in written:
            after: dict[tuple[str, str], tuple[float, str]] = {}

            def reach(h: str, last: str, score: float, word: str, after=after) -> None:
                if (old := after.get((h, last))) is None or score > old[0]:
                    after[h, last] = (score, word)

            letters = [(c, LEET) for c in LOOKALIKES.get(ch, "")]
            if _is_letter(ch):
                letters.append((ch, SAME))
            for (h, last), (score, word) in states.items():
                for c, cost in letters:
                    reach(h[1] + c, c, score + cost + self.logp(h, c), word + c)
                    if c == last:  # one more writing of the same letter
                        reach(h, c, score + cost + DROPPED, word)
                if not letters or not _is_letter(ch):  # a separator, or a sign that stands for nothing
                    reach(h, last, score + (DROPPED if not letters else KEPT), word)
            states = after
        return max(((s + self.logp(h, "$"), w) for (h, _), (s, w) in states.items()), key=lambda x: x[0], default=(0.0, written))[1]


def _is_letter(ch: str) -> bool:
    return "a" <= ch <= "z" or ch >= "\x80"


def _fold() -> np.ndarray:
    f = np.arange(256, dtype=np.uint8)
    f[0x41:0x5B] += 32
    return f


_FOLD = _fold()
_LETTER = np.zeros(256, bool)
_LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in LOOKALIKES]] = True
_WORD = _LETTER.copy()
_WORD[0x30:0x3A] = True
_WORD |= _SIGN
_WORD[0x41:0x5B] = True


def _prefix_sums(flags: np.ndarray) -> np.ndarray:
    return np.append(0, np.cumsum(flags, dtype=np.int64))


class Pieces:
    """Words of some texts with hashes of all their features."""

    def __init__(self, w: T.Words) -> None:
        self.w, self.data = w, _FOLD[w.data]
        # closing signs belong to the text around, not to the word
        sign = _SIGN[self.data] & ~((self.data >= 0x30) & (self.data <= 0x39))
        plain = np.where(sign, 0, np.arange(1, len(self.data) + 1)) if len(self.data) else np.zeros(0, np.int64)
        last = np.maximum.accumulate(plain) if len(plain) else plain
        self.start = w.start
        self.end = np.maximum(w.start + 1, np.minimum(w.end, last[w.end - 1])) if len(w.start) else w.end
        length = self.end - self.start
        self.edge = np.append(0, np.cumsum(length))
        self.at = np.arange(self.edge[-1]) - np.repeat(self.edge[:-1], length) + np.repeat(self.start, length)
        self.values = T._BYTE[self.data[self.at]]
        self.sums = T.byte_sums(self.values, length)

    def whole(self) -> np.ndarray:
        return T.mix(self.sums[self.edge[1:]] - self.sums[self.edge[:-1]])

    def prefix(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Words longer than n bytes, and the hash of their first n."""
        at = np.flatnonzero(self.end - self.start > n)
        s = self.edge[at]
        return at, T.mix(self.sums[s + n] - self.sums[s] + U64(n))

    def features(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Indices of words and the hashes of one of their features."""
        yield np.arange(len(self.start)), self.whole()
        for n in PREFIXES:
            yield self.prefix(n)

    def collapsed(self) -> tuple[np.ndarray, np.ndarray]:
        """Words in which a letter repeats, and the hash of the form without repetition."""
        d = self.data
        again = np.zeros(len(d), bool)
        again[1:] = (d[1:] == d[:-1]) & _LETTER[d[1:]]
        again[self.start] = False
        gone = _prefix_sums(again[self.at])
        lost = gone[self.edge[1:]] - gone[self.edge[:-1]]
        at = np.flatnonzero(lost)
        length = (self.end - self.start - lost)[at]
        kept = np.repeat(lost > 0, self.end - self.start) & ~again[self.at]
        s = T.byte_sums(self.values[kept], length)
        edge = np.append(0, np.cumsum(length))
        return at, T.mix(s[edge[1:]] - s[edge[:-1]])

    def suspicious(self, known: np.ndarray) -> list[tuple[int, str, bool]]:
        """Text, spelling and whether it is a run of single characters, of each stretch that the channel may have changed.

        known: sorted hashes of the classifier's words.
        """
        d = self.data
        letters, signs = _prefix_sums(_LETTER[d]), _prefix_sums(_SIGN[d])
        mixed = (letters[self.end] > letters[self.start]) & (signs[self.end] > signs[self.start])
        plain_digits = _prefix_sums((d >= 0x30) & (d <= 0x39))
        n_signs = signs[self.end] - signs[self.start]
        mixed |= (n_signs == self.end - self.start) & (n_signs >= 3) & (plain_digits[self.end] - plain_digits[self.start] < n_signs)
        thrice = np.zeros(len(d), bool)
        thrice[2:] = (d[2:] == d[1:-1]) & (d[1:-1] == d[:-2]) & _LETTER[d[2:]]
        n = _prefix_sums(thrice)
        mixed |= n[self.end] - n[np.minimum(self.start + 2, self.end)] > 0
        at, plain = self.collapsed()
        mixed[at[_member(known, plain)]] = True
        out = [(int(self.w.doc[i]), d[self.start[i] : self.end[i]].tobytes().decode("latin-1"), False) for i in np.flatnonzero(mixed)]
        # single characters, at most three bytes apart
        single = self.end - self.start == 1
        near = np.zeros(len(single), bool)
        near[1:] = single[1:] & single[:-1] & (self.start[1:] - self.end[:-1] <= 3) & (self.w.doc[1:] == self.w.doc[:-1])
        first = np.flatnonzero(~near)
        length = np.diff(np.append(first, len(single)))
        for i, m in zip(first[length >= 3], length[length >= 3], strict=True):
            chars = d[self.start[i : i + m]].tobytes().decode("latin-1")
            if any(_is_letter(c) for c in chars):
                out.append((int(self.w.doc[i]), chars, True))
        return out


def _member(known: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), bool)
    i = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return known[i] == x


def _pieces(texts: pa.Array) -> Iterator[Pieces]:
    for w in T.words(texts, _WORD, T._BYTE):
        yield Pieces(w)


class Classifier:
    """Character model, feature hashes with weights, intercept."""

    def __init__(self, chars: CharModel, keys: np.ndarray, weights: np.ndarray, intercept: float) -> None:
        self.chars, self.keys, self.weights, self.intercept = chars, keys, weights, intercept
        self.words = keys[weights > 0]
        self.sieve = np.zeros(1 << 16, bool)  # most words have no feature: one look-up each
        self.sieve[(keys & U64(0xFFFF)).astype(np.int64)] = True
        self.memo: dict[str, str] = {}

    def restored(self, written: str) -> str:
        if (x := self.memo.get(written)) is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            plain = self.chars.decode(written)
            x = self.memo[written] = plain.encode("latin-1").decode("utf-8", "replace")
        return x

    def counts(self, texts: pa.Array) -> list[dict[int, float]]:
        """Features of each text's words and restored words, with how often they occur."""
        out: list[dict[int, float]] = [{} for _ in range(len(texts))]
        owner, words = [], []
        for p in _pieces(texts):
            self._add(p, p.w.rows, out)
            for doc, written, spaced in p.suspicious(self.words):
                plain = self.restored(written)
                owner.append(int(p.w.rows[doc]))
                # a run of single characters may hold several words; prefixes of its ends meet each
                words.append(" ".join(plain[i:] for i in range(len(plain) - 3)) if spaced else plain)
        if words:
            for p in _pieces(pa.array(words, pa.string())):
                self._add(p, np.array(owner)[p.w.rows], out)
        return out

    def _add(self, p: Pieces, rows: np.ndarray, out: list[dict[int, float]]) -> None:
        for at, h in p.features():
            maybe = np.flatnonzero(self.sieve[(h & U64(0xFFFF)).astype(np.int64)])
            maybe = maybe[_member(self.keys, h[maybe])]
            for d, k in zip(rows[p.w.doc[at[maybe]]].tolist(), np.searchsorted(self.keys, h[maybe]).tolist(), strict=True):
                out[d][k] = out[d].get(k, 0) + 1

    def score(self, texts: pa.Array) -> np.ndarray:
        z = [self.intercept + sum(float(self.weights[k]) * math.log1p(n) for k, n in c.items()) for c in self.counts(texts)]
        return 1 / (1 + np.exp(-np.clip(np.array(z, np.float64), -40, 40)))


def letter_trigrams(docs: DataFrame, text: str = "text") -> dict[str, int]:
    """How often each trigram of bytes occurs in the plain words of all texts, with two starts and an end around each word."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for part in parts:
            for p in _pieces(T.column(part, "text")):
                letters = _prefix_sums(_LETTER[p.data])
                own = np.flatnonzero(letters[p.end] - letters[p.start] == p.end - p.start)
                start, length = p.start[own], (p.end - p.start)[own]
                if not len(own):
                    continue
                edge = np.cumsum(length + 3) - (length + 3)
                s = np.full(int((length + 3).sum()), ord("^"), np.int32)
                inner = np.repeat(edge + 2, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
                s[inner] = p.data[np.repeat(start, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)]
                s[edge + length + 2] = ord("$")
                last = np.concatenate([inner, edge + length + 2])
                code, n = np.unique(s[last - 2] << 16 | s[last - 1] << 8 | s[last], return_counts=True)
                total.update(dict(zip(code.tolist(), n.tolist(), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], names=["code", "n"])

    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(count, "code int, n long").groupBy("code").agg(F.sum("n")).collect()
    return {bytes([c >> 16, c >> 8 & 255, c & 255]).decode("latin-1"): n for c, n in sorted(rows)}


def fit(docs: DataFrame, labels: DataFrame, train: Column, sample: int = 2500, sample_bytes: int = 32 << 20, features: int = 2500, l2: float = 1.0) -> Classifier:
    """A classifier from the labels where train (of doc_id) holds."""
    own = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int").alias("y")).where(train & F.col("doc_id").isNotNull() & F.col("y").isin(0, 1)).groupBy("doc_id").agg(F.max("y").alias("y"))
    shares = {r[0]: r[1] for r in own.groupBy("y").count().collect()}
    chosen = None
    for y in (0, 1):  # a top-k by hash: the bound of the sample
        part = own.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.union(part)
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id")  # 2 * sample rows are broadcast
    rows = rows.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    size = F.sum(F.octet_length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # of 2 * sample rows at most
    rows = rows.withColumn("size", size).where(F.col("size") <= sample_bytes).select("doc_id", "text", "y")
    prior = math.log((shares.get(1, 0) + 1e-9) / (shares.get(0, 0) + 1e-9)) if shares else -30.0
    chars = CharModel(letter_trigrams(docs))

    def learn(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The weights, from the bounded sample, in one worker's memory."""
        if not (own := list(parts)):
            return
        table = pa.Table.from_batches(own).sort_by("doc_id")
        y, text = table.column("y").to_numpy(), T.column(table, "text")
        if len(np.unique(y)) < 2:
            return
        keys = _selected(text, y, features)
        w, b = _logistic(_design(Classifier(chars, keys, np.ones(len(keys)), 0.0), text), y, l2)
        drawn = math.log(max(1, (y == 1).sum()) / max(1, (y == 0).sum()))
        yield pa.RecordBatch.from_arrays([pa.array([keys.tobytes()], pa.binary()), pa.array([w.tobytes()], pa.binary()), pa.array([float(b) - drawn])], names=["keys", "weights", "intercept"])

    got = rows.mapInArrow(learn, "keys binary, weights binary, intercept double").collect()
    if not got:
        return Classifier(chars, np.zeros(0, U64), np.zeros(0), max(-30.0, min(30.0, prior)))
    return Classifier(chars, np.frombuffer(got[0].keys, U64), np.frombuffer(got[0].weights, np.float64), got[0].intercept + prior)


def _design(model: Classifier, text: pa.Array) -> np.ndarray:
    x = np.zeros((len(text), len(model.keys)), np.float32)
    for i, found in enumerate(model.counts(text)):
        for k, n in found.items():
            x[i, k] = math.log1p(n)
    return x


def _selected(text: pa.Array, y: np.ndarray, features: int) -> np.ndarray:
    """Hashes of the features whose document shares differ most between the labels."""
    n = {label: (np.zeros(0, U64), np.zeros(0, np.int64)) for label in (False, True)}
    for p in _pieces(text):
        doc, feature = zip(*((p.w.doc[at], h) for at, h in p.features()), strict=True)
        doc, feature = np.concatenate(doc), np.concatenate(feature)
        order = np.lexsort((feature, doc))
        doc, feature = doc[order], feature[order]
        once = np.r_[True, (doc[1:] != doc[:-1]) | (feature[1:] != feature[:-1])] if len(doc) else np.zeros(0, bool)
        doc, feature = doc[once], feature[once]
        for label in n:  # counts of texts are summed piece by piece, so only distinct features are held
            n[label] = _summed(*n[label], feature[(y[p.w.rows[doc]] == 1) == label])
    key, count = n[True]
    key, count = key[count >= 3], count[count >= 3]
    i = np.minimum(np.searchsorted(n[False][0], key), max(0, len(n[False][0]) - 1))
    clean = np.where(n[False][0][i] == key, n[False][1][i], 0) if len(n[False][0]) else np.zeros(len(key))
    a, b = (count + 0.5) / ((y == 1).sum() + 1), (clean + 0.5) / ((y == 0).sum() + 1)
    gain = a * np.log(a / b) + (1 - a) * np.log((1 - a) / (1 - b))
    best = np.lexsort((key, -gain))[:features]
    return np.sort(key[best[(a > b)[best]]])


def _summed(keys: np.ndarray, counts: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys with their counts, and once more for each of `more`."""
    every, place = np.unique(np.concatenate([keys, more]), return_inverse=True)
    return every, np.bincount(place, np.concatenate([counts, np.ones(len(more))]), len(every)).astype(np.int64)


def _logistic(x: np.ndarray, y: np.ndarray, l2: float, rounds: int = 400) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression by Nesterov's gradient method; both labels weigh the same."""
    n = len(y)
    weight = np.where(y == 1, n / (2 * max(1, (y == 1).sum())), n / (2 * max(1, (y == 0).sum()))).astype(np.float32)
    w = v = np.zeros(x.shape[1], np.float32)
    b = vb = 0.0
    u = np.ones(x.shape[1], np.float32)
    for _ in range(8):  # largest eigenvalue, for the step
        u = x.T @ (weight * (x @ u))
        size = float(np.linalg.norm(u)) or 1.0
        u /= size
    step = 1 / (0.25 * (size + n) + l2)
    for t in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ v + vb, -30, 30)))
        e = (weight * (p - y)).astype(np.float32)
        w_, b_ = v - step * (x.T @ e + l2 * v), vb - step * float(e.sum())
        v, vb = w_ + t / (t + 3) * (w_ - w), b_ + t / (t + 3) * (b_ - b)
        w, b = w_, b_
    return w.astype(np.float64), b + math.log(max(1, (y == 1).sum()) / max(1, (y == 0).sum()))


def scored(docs: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """The rows with toxicity, a number from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(shared.value.score(pa.array(b.fillna(""), pa.string())))

    return docs.withColumn("toxicity", score(F.coalesce(F.col(text), F.lit(""))))
