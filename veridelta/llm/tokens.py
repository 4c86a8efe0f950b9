"""Vectorised words, word hashes and n-gram hashes over Arrow string columns.

Everything works on the UTF-8 bytes of many texts at once: a byte is either part of a
word or a separator, and words never cross texts.  A word's 64-bit hash is multilinear:
each of its (optionally case-folded) bytes stands for a random number, which is multiplied
by a random number of the byte's place in the word, so no regular pattern of bytes can make
two words equal, as it can with powers of one base.  A mixing step finishes the sum.  An
n-gram's hash is built in the same way from its words' hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SEEDS = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _SEEDS.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_WORD = _SEEDS.integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)

#: bytes of texts handled at once, unless one text alone is longer
CHUNK = 1 << 19


def whitespace_words() -> np.ndarray:
    """Word bytes of ``[^\\x20\\x09-\\x0D]+``."""
    t = np.ones(256, bool)
    t[[0x20, *range(0x09, 0x0E)]] = False
    return t


def alnum_words() -> np.ndarray:
    """Word bytes of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    t = np.zeros(256, bool)
    t[0x30:0x3A] = t[0x41:0x5B] = t[0x61:0x7B] = t[0x80:] = True
    return t


def folded() -> np.ndarray:
    """Values of bytes with A-Z read as a-z."""
    v = _BYTE.copy()
    v[0x41:0x5B] = v[0x61:0x7B]
    return v


def as_written() -> np.ndarray:
    return _BYTE


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class _Places:
    """A random number for each place in a word: a counter, mixed; the table grows with the longest word."""

    def __init__(self) -> None:
        self.table = np.zeros(0, U64)

    def __call__(self, n: int) -> np.ndarray:
        if len(self.table) < n:
            i = np.arange(1, max(n, 2 * len(self.table), 64) + 1, dtype=U64)
            self.table = mix(mix(i * U64(0x9E3779B97F4A7C15)) + U64(0xD6E8FEB86659FD93)) | U64(1)
        return self.table


_places = _Places()


def byte_sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Prefix sums of the values of words that stand one after the other, each value times the number of its place in its word."""
    at = np.cumsum(lengths) - lengths
    place = np.arange(len(values)) - np.repeat(at, lengths)
    s = np.zeros(len(values) + 1, U64)
    np.cumsum(values * _places(int(lengths.max()) if len(lengths) else 0)[place], out=s[1:])
    return s


def grams(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the word sequences h[i:i+n] for the places i in at."""
    s = np.full(len(at), U64(n))
    for j in range(n):
        s += h[at + j] * _WORD[j]
    return mix(s)


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of h[i:i+n] for each i; the caller drops those that cross texts."""
    m = max(0, len(h) - n + 1)
    s = np.full(m, U64(n))
    for j in range(n):
        s += h[j : j + m] * _WORD[j]
    return mix(s)


def short_sequences(h: np.ndarray, first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the sequences h[first:last] of those texts that have fewer than n words; 0 for others."""
    out = np.zeros(len(first), U64)
    for m in range(1, n):
        own = np.flatnonzero(last - first == m)
        out[own] = grams(h, first[own], m)
    return out


@dataclass
class Words:
    """Words of several texts.  doc: index of each word's text; first[i]:first[i+1] are text i's words."""

    hash: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    rows: np.ndarray  # row number of each text in the column
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def inside(self, n: int) -> np.ndarray:
        """Of each n-gram of the joined words, whether it lies in one text."""
        m = len(self.hash) - n + 1
        return self.doc[:m] == self.doc[n - 1 :] if m > 0 else np.zeros(0, bool)


def column(table: pa.Table | pa.RecordBatch, name: str) -> pa.Array:
    c = table.column(name)
    if isinstance(c, pa.ChunkedArray):
        c = c.combine_chunks() if c.num_chunks != 1 else c.chunk(0)
        if isinstance(c, pa.ChunkedArray):
            c = c.chunk(0)
    return c


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string or binary column without nulls."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, o, d = texts.buffers()
    off = np.frombuffer(o, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(d, np.uint8) if d is not None and d.size else np.zeros(0, np.uint8)
    return off, data


def words(texts: pa.Array, is_word: np.ndarray, value: np.ndarray, chunk: int = CHUNK) -> Iterator[Words]:
    """Words of the texts, a few texts at a time; every text appears in exactly one piece."""
    if not len(texts):
        return
    off, every = raw(texts)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + chunk, side="right")) - 1)
        data, o = every[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        inside = is_word[data]
        at = inside.copy()
        at[1:] &= ~inside[:-1]
        full = o[:-1] < o[1:]
        b, e = o[:-1][full], o[1:][full] - 1
        at[b] |= inside[b]
        till = inside.copy()
        till[:-1] &= ~inside[1:]
        till[e] |= inside[e]
        start, end = np.flatnonzero(at), np.flatnonzero(till) + 1
        length = end - start
        s = byte_sums(value[data[inside]], length)
        edge = np.append(0, np.cumsum(length))
        h = mix(s[edge[1:]] - s[edge[:-1]])
        first = np.searchsorted(start, o)
        doc = np.repeat(np.arange(hi - lo), np.diff(first))
        yield Words(h, doc, first, np.arange(lo, hi), data, start, end)
        lo = hi
