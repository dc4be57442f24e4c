"""Spelling variants of a corpus: words one edit apart, and the form that each rare one leads to.

A word is a point that counts its letters. One inserted letter raises one coordinate by one
and changes no other; one replaced letter raises one and lowers one, so two near words of
one length are at an L1 distance of two, and of lengths that differ by one at a distance of
one. For each pair of lengths a k-d tree over the points is searched for boxes that such a
step can reach, and only the letter order of what lies in them is compared.

The upper part of each tree is fitted on a bounded sample and only deals words to cells; a
word is a point in its own cell and a query in each cell that a step can reach. Below, each
cell builds the rest of its tree over all its words. Pairs don't leave a cell: it gives one
row a word, with the number of near words and the best of them.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfrank.llm import words as W
from shelfrank.llm.storage import keep

#: Shortest word in code points, fewest occurrences, and how much more frequent a form is.
MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
#: Words dealt to one cell; words of the sample that the upper trees are fitted on, and sampled words a cell at least.
CELL, SAMPLE, PER_CELL = 4096, 100_000, 4
#: Points in a box whose letter order is compared with all queries that reach it; letters compared at once.
LEAF, COMPARED = 24, 4 << 20
#: Distinct words that a task gathers before it passes them on.
GATHERED = 500_000
#: Planted errors: one occurrence in so many loses a letter (None: none does).
ERASED_ONE_IN = 199

_ASCII = W.byte_set((0x41, 0x5A), (0x61, 0x7A))
# Coordinates: a to z, then U+00C0 to U+00FF; by Latin-1 byte.
_DIMENSION = np.zeros(256, np.int64)
_DIMENSION[ord("a") : ord("z") + 1] = np.arange(26)
_DIMENSION[0xC0:] = 26 + np.arange(64)
DIMENSIONS = 90
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> np.uint32(1)) ^ np.uint32(0xEDB88320), _CRC >> np.uint32(1))
_LONG = 64


def _runs(data: np.ndarray) -> tuple[np.ndarray, None]:
    """Marks ASCII letters and U+00C0 to U+00FF, whose UTF-8 bytes are 0xC3 and one more."""
    lead = data == 0xC3
    inside = _ASCII[data] | lead
    inside[1:] |= lead[:-1]
    return inside, None


def crc32_from(crc: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc32 of many byte ranges at once, each carried on from a crc32 of its own."""
    out = np.empty(len(crc), np.uint32)
    for i in np.flatnonzero(length > _LONG):
        out[i] = zlib.crc32(data[start[i] : start[i] + length[i]].tobytes(), int(crc[i]))
    short = np.flatnonzero(length <= _LONG)
    short = short[np.argsort(-length[short], kind="stable")]
    state, at = crc[short] ^ np.uint32(0xFFFFFFFF), start[short]
    ends = np.searchsorted(-length[short], -np.arange(_LONG + 1), side="left")  # ranges longer than k come first
    for k in range(_LONG):
        m = ends[k]
        if not m:
            break
        state[:m] = _CRC[(state[:m] ^ data[at[:m] + k]) & np.uint32(255)] ^ (state[:m] >> np.uint32(8))
    out[short] = state ^ np.uint32(0xFFFFFFFF)
    return out


def _strings(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[W.spans(start, length)].tobytes()))


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = MIN_LENGTH, fewest: int = MIN_COUNT, erased: int | None = ERASED_ONE_IN) -> DataFrame:
    """word, n: runs of letters (ASCII and U+00C0 to U+00FF) of all whole texts, A to Z lower-cased.

    If ``erased`` divides the crc32 of "<key>:<run>", the run loses its code point at that
    crc32 modulo its length. Words of fewer than ``shortest`` code points or ``fewest``
    occurrences are left out. A null text has no words; a null key is the empty text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, rows = [], 0

        def merged():
            hashes, n = np.concatenate([h for h, _, _ in waiting]), np.concatenate([c for _, c, _ in waiting])
            _, first, place = np.unique(hashes, return_index=True, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.concat_arrays([w for _, _, w in waiting]).take(pa.array(first)), pa.array(np.bincount(place, weights=n).astype(np.int64))], names=["word", "n"])

        for batch in batches:
            starts = np.array([zlib.crc32(k + b":") for k in batch.column(0).to_pylist()], np.uint32)
            for at, _, words in W.pieces(batch.column(1), _runs):
                double = np.concatenate([[0], np.cumsum(words.data == 0xC3)])
                points = words.end - words.start - (double[words.end] - double[words.start])
                long = np.flatnonzero(points >= shortest)
                if not len(long):
                    continue
                start, size, points, hashes = words.start[long], (words.end - words.start)[long], points[long], words.hash[long]
                if erased:
                    crc = crc32_from(starts[at + words.text[long]], words.data, start, size)
                    hit = crc % np.uint32(erased) == 0
                    changed = Counter()
                    for i in np.flatnonzero(hit):
                        word = words.data[start[i] : start[i] + size[i]].tobytes().decode()
                        place = int(crc[i]) % len(word)
                        changed[word[:place] + word[place + 1 :]] += 1
                    changed = {w: n for w, n in changed.items() if len(w) >= shortest}
                    if changed:
                        yield pa.RecordBatch.from_arrays([pa.array(list(changed)), pa.array(list(changed.values()), pa.int64())], names=["word", "n"])
                    start, size, hashes = start[~hit], size[~hit], hashes[~hit]
                distinct, first, n = np.unique(hashes, return_index=True, return_counts=True)
                if len(distinct):
                    waiting.append((distinct, n, _strings(words.data, start[first], size[first])))
                    rows += len(distinct)
                if rows > GATHERED:
                    yield merged()
                    waiting, rows = [], 0
        if waiting:
            yield merged()

    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary").alias("key"), F.col(text).cast("binary").alias("text"))
    counts = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= fewest)


def letters(words: list[str] | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Latin-1 bytes of all words one after the other, and the length of each."""
    raw = [w.encode("latin-1") for w in words]
    return np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw], np.int64)


def vectors(codes: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Counts of each letter, up to 255: a step changes a capped count by no more than a whole one."""
    out = np.empty((len(length), DIMENSIONS), np.int16)
    ends = np.concatenate([[0], np.cumsum(length)])
    for at in range(0, len(length), 10_000):
        some = length[at : at + 10_000]
        row = np.repeat(np.arange(len(some)), some)
        counts = np.bincount(row * DIMENSIONS + _DIMENSION[codes[ends[at] : ends[at + len(some)]]], minlength=len(some) * DIMENSIONS)
        out[at : at + len(some)] = np.minimum(counts, 255).reshape(len(some), DIMENSIONS)
    return out


def _split(points: np.ndarray) -> tuple[int, int] | None:
    """Coordinate and largest value of the left side; the points are cut as evenly as one coordinate can."""
    best = None
    for d in np.argsort(-points.std(axis=0))[:4]:
        x = points[:, d]
        low, high = x.min(), x.max()
        if low == high:
            break
        t = min(int(np.median(x)), high - 1)
        for value in {t, max(t - 1, low)}:
            odds = abs(int((x <= value).sum()) * 2 - len(x))
            if best is None or odds < best[0]:
                best = odds, int(d), int(value)
    return best and best[1:]


def _step(x: np.ndarray, up: np.ndarray, down: np.ndarray, d: int, t: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Queries that reach the left side (values up to t) and the right one, with what steps they have left.

    ``up`` and ``down``: the coordinate that the step raised or lowered so far, -1 for none
    yet, -2 if it mustn't. ``x``: the queries' values at coordinate d.
    """
    x = x + (up == d) - (down == d)
    free = np.flatnonzero((x <= t) | ((x == t + 1) & (down == -1)))
    yield free, up[free], np.where(x[free] > t, d, down[free]).astype(down.dtype)
    free = np.flatnonzero((x > t) | ((x == t) & (up == -1)))
    yield free, np.where(x[free] <= t, d, up[free]).astype(up.dtype), down[free]


@dataclass
class Trees:
    """Upper trees by word length. A node is (coordinate, value, left, right), or a cell's number."""

    nodes: list = field(default_factory=list)
    root: dict[int, int] = field(default_factory=dict)
    cells: int = 0

    def add(self, length: int, points: np.ndarray, words: int) -> None:
        """A tree for ``words`` words of a length, of which ``points`` are a sample."""
        least = max(PER_CELL, len(points) * CELL // max(words, 1))
        self.root[length] = self._build(points, least)

    def _build(self, points: np.ndarray, least: int) -> int:
        number = len(self.nodes)
        self.nodes.append(None)
        cut = _split(points) if len(points) > least else None
        if cut is None:
            self.nodes[number], self.cells = self.cells, self.cells + 1
        else:
            left = points[:, cut[0]] <= cut[1]
            self.nodes[number] = (*cut, self._build(points[left], least), self._build(points[~left], least))
        return number

    def reach(self, length: int, points: np.ndarray, up: int, down: int) -> Iterator[tuple[int, np.ndarray]]:
        """Cells of words of ``length``, and which of the points reach each in the steps that -1 allows."""
        if length not in self.root:
            return
        start = (self.root[length], np.arange(len(points)), np.full(len(points), up, np.int16), np.full(len(points), down, np.int16))
        stack = [start]
        while stack:
            number, rows, ups, downs = stack.pop()
            if not len(rows):
                continue
            node = self.nodes[number]
            if not isinstance(node, tuple):
                yield node, rows
                continue
            d, t, *sides = node
            for side, (free, u, w) in zip(sides, _step(points[rows, d], ups, downs, d, t), strict=True):
                stack.append((side, rows[free], u, w))


def fit(words: DataFrame) -> Trees:
    """Upper trees of a stored word table; the driver sees a count a length and at most about SAMPLE words."""
    sizes = {r.length: r.n for r in words.groupBy(F.length("word").alias("length")).agg(F.count("*").alias("n")).collect()}
    share = min(1.0, SAMPLE / max(sum(sizes.values()), 1))
    sample = [r.word for r in words.where(F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(share * (1 << 30))).select("word").collect()]
    own: dict[int, list[str]] = {}
    for word in sample:
        own.setdefault(len(word), []).append(word)
    trees = Trees()
    for size, n in sorted(sizes.items()):
        trees.add(size, vectors(*letters(own.get(size, []))), n)
    return trees


def _boxes(points: np.ndarray, queries: np.ndarray, up: np.ndarray, down: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Small boxes of a k-d tree over the points, each with the queries that reach it."""
    stack = [(np.arange(len(points)), np.arange(len(queries)), up, down)]
    while stack:
        own, rows, ups, downs = stack.pop()
        if not len(rows):
            continue
        cut = _split(points[own]) if len(own) > LEAF else None
        if cut is None:
            yield own, rows
            continue
        left = points[own, cut[0]] <= cut[1]
        for side, (free, u, w) in zip((own[left], own[~left]), _step(queries[rows, cut[0]], ups, downs, *cut), strict=True):
            stack.append((side, rows[free], u, w))


def one_edit(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether rows of code points, of equal lengths or one longer, are exactly one edit apart."""
    size = short.shape[1]
    if size == long.shape[1]:
        return (short != long).sum(axis=1) == 1
    before = np.cumprod(short == long[:, :size], axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
    after = np.cumprod((short == long[:, 1:])[:, ::-1], axis=1, dtype=np.uint8).sum(axis=1, dtype=np.int64)
    return before + after >= size


def _pairs(points: np.ndarray, codes: np.ndarray, queries: np.ndarray, own: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of queries and of points that are one edit apart, in runs of bounded size."""
    if not len(own) or not len(codes):
        return
    start = np.full(len(own), -1, np.int16)
    most = max(1, COMPARED // codes.shape[1])
    waiting, rows = [], 0

    def compare():
        q, p = np.concatenate([a for a, _ in waiting]), np.concatenate([b for _, b in waiting])
        good = one_edit(own[q], codes[p])
        return q[good], p[good]

    for box, reached in _boxes(points, queries, start, start if same else start - 1):
        for at in range(0, len(reached), max(1, most // len(box))):  # a box of equal vectors may be large
            some = reached[at : at + max(1, most // len(box))]
            waiting.append((np.repeat(some, len(box)), np.tile(box, len(some))))
            rows += len(some) * len(box)
            if rows >= most:
                yield compare()
                waiting, rows = [], 0
    if waiting:
        yield compare()


class _Best:
    """Number of near words, and the best of them, of each word of a cell. ``order``: places in code-point order."""

    def __init__(self, size: int):
        self.near, self.n, self.word = np.zeros(size, np.int64), np.zeros(size, np.int64), np.full(size, -1, np.int64)

    def add(self, word: np.ndarray, other: np.ndarray, n: np.ndarray, order: np.ndarray) -> None:
        """Words and their near words, numbers of one run of pairs."""
        by = np.lexsort((order[other], -n[other], word))
        word, other = word[by], other[by]
        first = np.flatnonzero(np.diff(word, prepend=-1))
        np.add.at(self.near, word, 1)
        word, other = word[first], other[first]
        held = self.word[word]
        better = (held < 0) | (n[other] > self.n[word]) | ((n[other] == self.n[word]) & (order[other] < order[held]))
        self.word[word[better]], self.n[word[better]] = other[better], n[other[better]]


_PARTS = "word string, n_near long, best_n long, best string"


def _search_cell(table: pa.Table) -> pa.Table:
    """Near words of one cell: one row for each of its words and queries that has some."""
    words, n = np.array(table["word"].to_pylist(), object), table["n"].to_numpy()
    point = table["point"].to_numpy(zero_copy_only=False)
    codes, length = letters(words)
    place = np.concatenate([[0], np.cumsum(length)])
    coordinates = vectors(codes, length)
    order = np.empty(len(words), np.int64)
    order[np.argsort(words, kind="stable")] = np.arange(len(words))  # Latin-1 order is code-point order
    points = np.flatnonzero(point)
    size = int(length[points[0]]) if len(points) else 0
    matrix = codes[W.spans(place[points], length[points])].reshape(len(points), size)
    best = _Best(len(words))
    for step in (0, 1):
        queries = np.flatnonzero(~point & (length == size - step))
        own = codes[W.spans(place[queries], length[queries])].reshape(len(queries), size - step)
        for q, p in _pairs(coordinates[points], matrix, coordinates[queries], own, step == 0):
            q, p = queries[q], points[p]
            best.add(q, p, n, order)
            if step:  # the longer word is not a query among shorter ones
                best.add(p, q, n, order)
    found = np.flatnonzero(best.near)
    return pa.table({"word": pa.array(words[found], pa.string()), "n_near": best.near[found], "best_n": best.n[found], "best": pa.array(words[best.word[found]], pa.string())})


def deal(words: DataFrame, trees: Trees) -> DataFrame:
    """cell, point, word, n: each word as a point of its cell, and as a query in the cells that one edit reaches."""
    trees = words.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, length = letters(batch.column(0).to_pylist())
            points = vectors(codes, length)
            for size in np.unique(length):
                own = np.flatnonzero(length == size)
                ways = [(True, size, -2, -2), (False, size, -1, -1), (False, size + 1, -1, -2)]
                for point, at, up, down in ways:
                    for cell, rows in trees.value.reach(int(at), points[own], up, down):
                        part = batch.take(pa.array(own[rows]))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), cell, np.int32)), pa.array(np.full(len(rows), point)), part.column(0), part.column(1)], names=["cell", "point", "word", "n"])

    return words.select("word", "n").mapInArrow(run, "cell int, point boolean, word string, n long")


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, and its most frequent near word ``best`` (ties: smallest in code-point order) with ``best_n``."""
    parts = deal(words, fit(words)).groupBy("cell").applyInArrow(_search_cell, _PARTS)
    first = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w"))).alias("_first")
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), first).select("word", "n_near", (-F.col("_first.m")).alias("best_n"), F.col("_first.w").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of a stored table (word, form): forms followed to the last, by doubling the way of every word.

    A form is more frequent than its word by a factor, so ways are short and have an end.
    """
    way = forms.select("word", F.col("form").alias("root"))
    while True:
        onward = way.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        longer = keep(way.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "spelling-ways")
        way = longer.select("word", "root")
        if not longer.where("_moved").limit(1).count():
            return way


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = MIN_LENGTH, fewest: int = MIN_COUNT, ratio: int = RATIO, erased: int | None = ERASED_ONE_IN) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words of the corpus (see count_words).

    Two words are near if exactly one inserted, deleted or replaced code point makes one of
    the other. A word's form is its near word of largest n (ties: smallest in code-point
    order) if that n is at least ``ratio`` times the word's, else null; its root is the last
    of the forms that follow each other, the word itself if it has none. Repeated rows
    count as often as they stand; other columns are not read; no words give an empty table.
    """
    words = keep(count_words(docs, key, text, shortest, fewest, erased), "spelling-words")
    rows = words.join(near_words(words), "word", "left")
    good = F.col("best_n") >= ratio * F.col("n")
    rows = keep(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n")), "spelling-forms")
    ends = roots(rows.where("form is not null"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
