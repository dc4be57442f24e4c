"""Words of whole Arrow columns at once, as 64-bit hashes.

Texts are split on bytes: every separator of the operators is an ASCII character, and in
UTF-8 no other character holds an ASCII byte. Equal words have equal hashes on every
machine; two different words share one with a chance of about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at a time; one longer text is a piece of its own.
PIECE_BYTES = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15)
#: What the base is to be multiplied with to give 1, modulo 2**64.
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """True for the bytes of the ranges, both ends included."""
    table = np.zeros(256, dtype=bool)
    for first, last in ranges:
        table[first : last + 1] = True
    return table


#: Words between white space: everything but 0x20 and 0x09 to 0x0D.
SPACED = ~byte_set((0x20, 0x20), (0x09, 0x0D))
#: Letters and digits: ASCII ones and every character beyond ASCII.
ALNUM = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: Letters: ASCII ones and every character beyond ASCII.
LETTERS = byte_set((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


@dataclass
class Words:
    """Words of some texts in order: hash, text number, byte range in ``data`` (lower-cased)."""

    hash: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray
    texts: int

    def counts(self) -> np.ndarray:
        return np.bincount(self.text, minlength=self.texts)

    def first(self) -> np.ndarray:
        """Number of each text's first word, and at the end the number of words."""
        return np.concatenate([[0], np.cumsum(self.counts())])

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def prefix_hash(words: Words, number: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first ``size`` bytes of those words that are longer, and which words these are."""
    longer = np.flatnonzero(words.end[number] - words.start[number] > size)
    at = words.start[number[longer]]
    total = np.full(len(at), size, dtype=np.uint64)
    for i in range(size):
        total = total * _BASE + words.data[at + i].astype(np.uint64) + np.uint64(1)
    return mix(total + np.uint64(0x5851F42D4C957F2D)), longer


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """The first to n-th power of ``base``; those that a usual piece of text needs are kept."""
    table = _TABLES.get(base, _NO_POWERS)
    if len(table) < n:
        table = np.cumprod(np.full(n, base, dtype=np.uint64), dtype=np.uint64)
        if n <= 2 * PIECE_BYTES:
            _TABLES[base] = table
    return table[:n]


_NO_POWERS = np.zeros(0, dtype=np.uint64)
_TABLES: dict[np.uint64, np.ndarray] = {}


def run_sums(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sum of (value + 1) * base ** (1, 2, ...) over each of the runs, modulo 2**64.

    Taken from running sums over all values: the powers that a run's place adds are taken
    off again by those of the base's inverse.
    """
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    sums[1:] = values
    sums[1:] += np.uint64(1)
    sums[1:] *= _powers(_BASE, len(values))
    np.cumsum(sums, out=sums)
    return (sums[end] - sums[start]) * _powers(_INVERSE, len(values) + 1)[start] * _BASE


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8), offsets


def split(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray | Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]] = SPACED, lower: bool = True) -> Words:
    """Words of the texts that ``offsets`` cuts ``data`` into, A to Z lower-cased if not told otherwise.

    ``kind``: which byte values belong to words, or a function that marks the bytes that do
    and those that begin a word of their own after another one.
    """
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    data = _LOWER[data] if lower else data
    inside, apart = kind(data) if callable(kind) else (kind[data], None)
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    if apart is not None and len(data):
        opens |= apart
        closes[:-1] |= apart[1:]
    if len(data):  # a word ends with its text
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        opens[cuts] = inside[cuts]
        closes[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets)))
    hashes = mix(run_sums(data, start, end) + (end - start).astype(np.uint64)) if len(start) else np.zeros(0, np.uint64)
    return Words(hashes, text, start, end, data, len(offsets) - 1)


def pieces(column: pa.Array, kind: np.ndarray = SPACED, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, Words]]:
    """First text, end and words of runs of texts of about ``limit`` bytes."""
    data, offsets = column_bytes(column)
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, to, split(data, offsets[at : to + 1], kind)
        at = to


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words of a text, and the number of the first word of each."""
    n = len(words.hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    whole = np.flatnonzero(words.text[:n] == words.text[size - 1 :])
    return run_hash(words.hash, whole, size), whole


def run_hash(hashes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """One hash of ``size`` values from each place on; order counts."""
    total = np.full(len(at), size, dtype=np.uint64)
    for i in range(size):
        total = total * _BASE + hashes[at + i]
    return mix(total)


def spans(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The ranges first, first + 1, ... of the given lengths, one after the other."""
    places = np.repeat(first - (np.cumsum(length) - length), length)
    places += np.arange(len(places))
    return places
