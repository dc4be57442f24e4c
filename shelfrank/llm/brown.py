"""Class-based n-gram language model over a whole corpus, and scores of its texts.

* Exchange clustering deals the VOCABULARY most frequent training words into CLASSES
  classes: each word in turn moves to the class that raises the likelihood of the training
  bigrams most, until no word moves.
* Every other training word then goes to its best class by the classes that stand before and
  after it. In up to ROUNDS written rounds their contexts are gathered anew, and half of
  them by hash, the other half in the next round, go to their best class against the class
  bigrams of the round before: all at once would overshoot. After each round the frequent
  words are exchanged one by one again, beside the new classes of the others. A round that
  lowers the likelihood is not used and ends the rounds.
* A word's probability is that of its class after the class of the word before it (smoothed
  by the class's own share), times its share of its class. Words never seen are one class,
  which gets as much as the words seen once; they are no history, the word before them is.

Counts, contexts and classes of all words go through shuffles and grow with the corpus. The
texts are kept as blocks of word numbers, each with its own vocabulary. A block sends the
counts of its words once and in a round the contexts of the words whose turn it is, in packed
lists by range of word hash, and gets their classes; the task that writes these also counts
the bigrams by them. Blocks and classes are bucketed by block, so the blocks themselves are
shuffled once. Only tables of fixed size reach the driver: bigrams of the VOCABULARY words
and the classes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfrank.llm import words as W
from shelfrank.llm.storage import keep, keep_clustered, settings

VOCABULARY, CLASSES, ROUNDS = 1024, 64, 4
#: Text of a block; texts for each range of word hashes, and the least number of ranges.
BLOCK_BYTES, RANGE_TEXTS, LEAST_RANGES = 8 << 20, 16384, 1024
#: Text of a bucket of blocks, and how many buckets there are at least and at most.
BUCKET_BYTES, FEWEST, MOST = 16 << 20, 8, 65536
#: Words asked for that ranges are taken together up to; bigram cells in a packed list.
AT_ONCE, CELLS = 32768, 1 << 14
#: Weight of a class's own share against what follows the class before.
WEIGHT = 20.0

#: Blocks are made of the texts that travel to Python at once; a block's row is some MB, so they travel one by one.
MANY_TEXTS = {"spark__sql__execution__arrow__maxBytesPerBatch": str(16 << 20)}
ONE_BLOCK = {"spark__sql__execution__arrow__maxBytesPerBatch": str(4 << 20)}
#: Every step ends in a stored table or a small result, so Spark can delete its shuffle files then.
NO_OLD_SHUFFLES = {"spark__sql__classic__shuffleDependency__fileCleanup__enabled": "true"}

# Classes of the model: CLASSES of training words, unseen words, the end. As neighbours of a
# word, UNSEEN are words without a class yet and END is the edge of a text.
UNSEEN = CLASSES
END = UNSEEN + 1
START = CLASSES  # the history before the first known word


def _turned(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)


def planes(values: np.ndarray) -> bytes:
    """Fixed-width integers byte plane by byte plane, which compresses well."""
    return _turned(values).tobytes()


def unplanes(data: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    if width == 1:
        return np.frombuffer(data, kind)
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order and the place of each hash among them; only the distinct ones are sorted."""
    found, known = pd.factorize(hashes)
    order = np.argsort(known)
    places = np.empty(len(known), np.int32)
    places[order] = np.arange(len(known), dtype=np.int32)
    return known[order], places[found]


BLOCKS = "block long, ids array<long>, train array<boolean>, counts array<int>, tokens binary, vocabulary binary, places binary"


def _blocks(docs: DataFrame, train: Column, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        names = [x.split()[0] for x in BLOCKS.split(", ")]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), *[pa.binary()] * 3]
        for batch in batches:
            held, at, size = [], 0, 0
            for _, to, found in W.pieces(batch.column(2)):
                held.append(found)
                size += len(found.data)
                if size >= BLOCK_BYTES or to == batch.num_rows:
                    hashes = np.concatenate([f.hash for f in held])
                    known, token = distinct(hashes)
                    uses = np.bincount(token, minlength=len(known))
                    places = np.argsort(-uses, kind="stable").astype(np.int32)  # frequent words get small numbers
                    rank = np.empty(len(known), np.int32)
                    rank[places] = np.arange(len(known), dtype=np.int32)
                    own = batch.slice(at, to - at)
                    row = [number, own.column(0).to_pylist(), own.column(1).to_pylist(), np.concatenate([f.counts() for f in held]), planes(rank[token]), planes(known), planes(places)]
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=names)
                    number, held, at, size = number + 1, [], to, 0

    body = F.col("text").cast("binary")
    blocks = docs.select("doc_id", F.coalesce(train, F.lit(False)).alias("train"), body).mapInArrow(run, BLOCKS)
    with settings(docs.sparkSession, **MANY_TEXTS):
        return keep_clustered(blocks.repartition(buckets, "block"), "lm-blocks", "block", buckets)


@dataclass
class Block:
    """A row of the blocks table, unpacked."""

    tokens: np.ndarray
    vocabulary: np.ndarray
    counts: np.ndarray
    train: np.ndarray

    def first(self) -> np.ndarray:
        return np.cumsum(self.counts) - self.counts

    def in_training(self) -> np.ndarray:
        return np.repeat(self.train, self.counts)


def _open(batch: pa.RecordBatch) -> Iterator[tuple[dict, Block]]:
    for at in range(batch.num_rows):
        row = batch.slice(at, 1).to_pylist()[0]
        tokens = unplanes(row.pop("places"), np.int32)[unplanes(row.pop("tokens"), np.int32)]
        yield row, Block(tokens, unplanes(row.pop("vocabulary"), np.uint64), np.array(row["counts"], np.int64), np.array(row["train"], bool))


def history(block: Block, clas: np.ndarray) -> np.ndarray:
    """The class of the last word with a class before each token (START at first), and before each text's end."""
    own = clas[block.tokens]
    n, first = len(own), block.first()
    at = np.where(own < CLASSES, np.arange(n), -1)
    last = np.maximum.accumulate(at) if n else at
    before = np.concatenate([[-1], last[:-1]]) if n else last
    begin = np.repeat(first, block.counts)
    inside = np.where(before >= begin, own[np.maximum(before, 0)] if n else before, START)
    stop = first + block.counts - 1
    end = np.full(len(first), START, np.int64)
    full = block.counts > 0
    seen = last[stop[full]] >= first[full]
    end[np.flatnonzero(full)[seen]] = own[last[stop[full]][seen]]
    return np.concatenate([inside, end])


def contexts(block: Block, clas: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per asked word of the vocabulary how many kinds of neighbours it has in training texts; kinds and uses, word after word.

    A kind is the class before, END + 1 and the class after, or SAME for the word before itself.
    """
    n, side = len(block.tokens), END + 1
    own, first = clas[block.tokens], block.first()[block.counts > 0]
    before, after = np.concatenate([[END], own])[:n], np.concatenate([own, [END]])[1:]
    before[first] = END
    after[first[1:] - 1] = END
    inside, again = np.flatnonzero(block.in_training() & asked[block.tokens]), np.zeros(n, dtype=bool)
    again[:-1] = block.tokens[1:] == block.tokens[:-1]
    again[first[1:] - 1] = False
    base = block.tokens[inside].astype(np.int64) * (SAME + 1)
    cells, uses = np.unique(np.concatenate([base + before[inside], base + side + after[inside], (base + SAME)[again[inside]]]), return_counts=True)
    return np.bincount(cells // (SAME + 1), minlength=len(block.vocabulary))[asked], cells % (SAME + 1), uses


SAME = 2 * (END + 1)
COUNTS = "range long, block long, words binary, counts binary"
CONTEXTS = "range long, block long, words binary, clas binary, many binary, kinds binary, uses binary"


def _send(blocks: DataFrame, ranges: int, schema: str, lists: Callable[[dict, Block], tuple]) -> DataFrame:
    """Words of each block with what ``lists`` says of them, by range of their hashes.

    ``lists``: the words, then for each further column its values and, if these aren't one a
    word, how many each word has.
    """
    shift = np.uint64(64 - (ranges - 1).bit_length())
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, block in _open(batch):
                words, *columns = lists(row, block)
                single = np.arange(len(words) + 1)
                columns = [(_turned(words), single)] + [(_turned(x), single if many is None else np.concatenate([[0], np.cumsum(many)])) for x, many in columns]
                at, start = np.unique((words >> shift).astype(np.int64), return_index=True)
                ends = np.append(start[1:], len(words))
                for k in range(0, len(at), 256):
                    part = list(zip(start[k : k + 256], ends[k : k + 256], strict=True))
                    packed = [pa.array([x[:, c[a] : c[b]].tobytes() for a, b in part], pa.binary()) for x, c in columns]
                    yield pa.RecordBatch.from_arrays([pa.array(at[k : k + 256]), pa.array(np.full(len(part), row["block"])), *packed], names=names)

    return blocks.mapInArrow(run, schema).repartition("range").sortWithinPartitions("range")


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Requests of whole ranges: of as many as it takes to ask for AT_ONCE words."""
    held, asked = [], 0
    for batch in batches:
        for row in batch.to_pylist():
            if asked >= AT_ONCE and held[-1]["range"] != row["range"]:
                yield held
                held, asked = [], 0
            held.append(row)
            asked += len(row["words"]) // 8
    if held:
        yield held


def _words(rows: list[dict]) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Bounds of each request's words, all words, and where each request's words are among them."""
    own = [unplanes(r["words"], np.uint64) for r in rows]
    ends = np.cumsum([len(o) for o in own])
    words, which = distinct(np.concatenate(own))
    return list(zip(ends - [len(o) for o in own], ends, strict=True)), words, which


def _column(rows: list[dict], name: str, kind) -> np.ndarray:
    if np.dtype(kind).itemsize == 1:
        return np.frombuffer(b"".join([r[name] for r in rows]), kind)
    return np.concatenate([unplanes(r[name], kind) for r in rows])


#: A block's words; one row of those that a task wrote also has the bigrams of all of them.
STATE = "block long, clas binary, uses binary, cells binary, n binary"


def _counts(blocks: DataFrame, ranges: int, buckets: int) -> tuple[int, int, np.ndarray, DataFrame]:
    """Training tokens and distinct words without the ends, the most frequent words, and each block's words with counts and no classes yet."""

    def lists(row: dict, block: Block) -> tuple:
        uses = np.bincount(block.tokens[block.in_training()], minlength=len(block.vocabulary))
        return block.vocabulary, (uses.astype(np.int32), None)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "range", "counts", "word", "n", "distinct"]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        table = lambda *columns: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
        for rows in _by_range(batches):
            bounds, words, which = _words(rows)
            counts = np.bincount(which, weights=_column(rows, "counts", np.int32), minlength=len(words)).astype(np.int64)
            best = np.lexsort((words, -counts))[:VOCABULARY]
            best = best[counts[best] > 0]
            none, every = [None] * len(best), counts[which]
            yield table(none, none, none, words[best].view(np.int64), counts[best], np.zeros(len(best), np.int64))
            yield table([None], [None], [None], [None], [int(counts.sum())], [int((counts > 0).sum())])
            none = [None] * len(rows)
            yield table([r["block"] for r in rows], [r["range"] for r in rows], [planes(every[a:b]) for a, b in bounds], none, none, none)

    found = keep(_send(blocks, ranges, COUNTS, lists).mapInArrow(add, "block long, range long, counts binary, word long, n long, distinct long"), "lm-counts")
    tokens, distinct = found.where("word is null").agg(F.sum("n"), F.sum("distinct")).first()
    top = found.where("word is not null").orderBy(F.desc("n"), "word").limit(VOCABULARY).toPandas()["word"].to_numpy(np.int64).view(np.uint64)

    top = np.sort(top)
    shared = blocks.sparkSession.sparkContext.broadcast(top)

    def join(row: dict, block: Block) -> tuple:
        counts = [unplanes(x["counts"], np.int64) for x in sorted(row["answers"] or [], key=lambda x: x["range"])]
        counts = np.concatenate([np.zeros(0, np.int64), *counts])
        return np.full(len(counts), UNSEEN), counts, _ranks(block.vocabulary, shared.value)

    rows = blocks.join(_gathered(found.where("block is not null"), buckets, "counts"), "block", "left")
    return int(tokens or 0), int(distinct or 0), top, _states(rows, len(top), join, buckets)


def _gathered(answers: DataFrame, buckets: int, value: str) -> DataFrame:
    """All answers to a block, in the buckets of the blocks."""
    return answers.repartition(buckets, "block").groupBy("block").agg(F.collect_list(F.struct("range", value)).alias("answers")).hint("merge")


def _states(rows: DataFrame, n: int, words: Callable[[dict, Block], tuple], buckets: int) -> DataFrame:
    """The blocks' words by ``words`` (class, count and rank of each), and the bigrams of the texts by them.

    ``n``: how many words are frequent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds, held = [x.split()[0] for x in STATE.split(", ")], [pa.int64(), *[pa.binary()] * 4], None
        table = lambda *row: pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=names)
        bigrams = Bigrams(n)
        for batch in batches:
            for row, block in _open(batch):
                if held:
                    yield table(*held, None, None)
                clas, counts, rank = words(row, block)
                if len(clas) != len(block.vocabulary):
                    raise ValueError(f"block {row['block']}: {len(clas)} of {len(block.vocabulary)} words answered")
                bigrams.add(block, clas, counts, rank)
                held = row["block"], planes(clas.astype(np.uint8)), planes(counts)
        if held:
            cells = np.flatnonzero(bigrams.total).astype(np.int32)
            yield table(*held, planes(cells), planes(bigrams.total[cells]))

    return keep_clustered(rows.mapInArrow(run, STATE), "lm-state", "block", buckets)


def _with(blocks: DataFrame, state: DataFrame) -> DataFrame:
    return blocks.join(state.drop("cells", "n").hint("merge"), "block")


def _ranks(vocabulary: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Number of each word among the frequent ones, -1 for others. ``top`` is sorted."""
    if not len(top):
        return np.full(len(vocabulary), -1)
    at = np.minimum(np.searchsorted(top, vocabulary), len(top) - 1)
    return np.where(top[at] == vocabulary, at, -1)


def _known(row: dict, block: Block, top: np.ndarray, clas: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class, count and rank of each word of a block; the classes of frequent words are those of ``clas``."""
    own, counts = unplanes(row["clas"], np.uint8).astype(np.int64), unplanes(row["uses"], np.int64)
    if len(own) != len(block.vocabulary):
        raise ValueError(f"block {row['block']}: {len(own)} of {len(block.vocabulary)} words answered")
    rank = _ranks(block.vocabulary, top)
    return np.where(rank >= 0, clas[rank], own) if len(top) else own, counts, rank


def _asked(block: Block, counts: np.ndarray, rank: np.ndarray, turn: int | None) -> np.ndarray:
    """The words of a block that move in a round: trained ones that aren't frequent, of one half by hash or of both."""
    asked = (counts > 0) & (rank < 0)
    return asked if turn is None else asked & (W.mix(block.vocabulary) % np.uint64(2) == turn)


PAIRS = "part long, cells binary, n binary"


def _pack(total: np.ndarray) -> pa.RecordBatch:
    """The cells that hold something and their counts, in lists by ranges of CELLS cells."""
    there = np.flatnonzero(total).astype(np.int32)
    part, start, many = np.unique(there // CELLS, return_index=True, return_counts=True)
    bounds = list(zip(start, start + many, strict=True))
    columns = [pa.array([planes(x[a:b]) for a, b in bounds], pa.binary()) for x in (there, total[there])]
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), *columns], names=["part", "cells", "n"])


class Bigrams:
    """Training bigrams, and after them what stands before words seen once.

    Frequent words stand for themselves, others for their class, after all ``n`` frequent ones;
    END of these is the end of a text, and of the text before the first word.
    """

    def __init__(self, n: int):
        self.n, self.side = n, n + END + 1
        self.total = np.zeros(self.side * (self.side + 1), np.int64)

    def add(self, block: Block, clas: np.ndarray, counts: np.ndarray, rank: np.ndarray) -> None:
        side, end = self.side, self.n + END
        symbol = np.where(rank >= 0, rank, self.n + clas)
        texts = np.flatnonzero(block.train)
        tokens = block.tokens[W.spans(block.first()[texts], block.counts[texts])]
        places = np.cumsum(block.counts[texts])
        line = np.concatenate([[end], np.insert(symbol[tokens], places, end)])  # a text's end starts the next
        once = np.insert(counts[tokens] == 1, places, False)
        self.total[: side * side] += np.bincount(line[:-1] * side + line[1:], minlength=side * side)
        self.total[side * side :] += np.bincount(line[:-1][once], minlength=side)


def _bigrams(state: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sums of all tasks' bigrams: pairs, and what stands before words seen once."""
    side = n + END + 1

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(side * (side + 1), np.int64)
        for batch in batches:
            for cells, count in zip(batch.column("cells").to_pylist(), batch.column("n").to_pylist(), strict=True):
                total[unplanes(cells, np.int32)] += unplanes(count, np.int64)
        yield _pack(total)

    # A list of cells is a row: some MB of counts from each task would be millions of rows.
    lists = state.where("cells is not null").select("cells", "n").mapInArrow(add, PAIRS)
    cells = lists.repartition("part").mapInArrow(add, PAIRS).toPandas()
    out = np.zeros(side * (side + 1))
    for there, count in zip(cells["cells"], cells["n"], strict=True):
        out[unplanes(there, np.int32)] = unplanes(count, np.int64)
    return out[: side * side].reshape(side, side), out[side * side :]


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-12))


def exchange(bigrams: np.ndarray, classes: int, fixed: int = 0, rounds: int = 12, clas: np.ndarray | None = None) -> np.ndarray:
    """Class of each word: exchange clustering on bigram counts.

    ``clas``: the classes to start from. The last ``fixed`` words don't move; they are
    classes of their own if no classes are given.
    """
    n = len(bigrams) - fixed
    clas = np.concatenate([np.arange(n) % classes, classes + np.arange(fixed)]) if clas is None else clas.copy()
    total = int(clas.max(initial=0)) + 1
    hot = np.zeros((len(bigrams), total))
    hot[np.arange(len(bigrams)), clas] = 1
    table = hot.T @ bigrams @ hot
    use = bigrams.sum(axis=1), bigrams.sum(axis=0)
    order = np.argsort(-use[0][:n], kind="stable")
    for _ in range(rounds):
        moved = 0
        for w in order:
            a, self = clas[w], bigrams[w, w]
            right = np.bincount(clas, weights=bigrams[w], minlength=total)
            left = np.bincount(clas, weights=bigrams[:, w], minlength=total)
            right[a] -= self
            left[a] -= self
            table[a] -= right
            table[:, a] -= left
            table[a, a] -= self
            some, every = table[:classes], table[:, :classes]
            gain = (_xlogx(some + right) - _xlogx(some)).sum(axis=1) + (_xlogx(every + left[:, None]) - _xlogx(every)).sum(axis=0)
            d = np.arange(classes)
            own = table[d, d]
            gain += _xlogx(own + right[d] + left[d] + self) - _xlogx(own + right[d]) - _xlogx(own + left[d]) + _xlogx(own)
            for marginal, c in ((some.sum(axis=1), use[0][w]), (every.sum(axis=0), use[1][w])):
                gain -= _xlogx(marginal + c) - _xlogx(marginal)
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9 * abs(gain[a]):
                b = a
            table[b] += right
            table[:, b] += left
            table[b, b] += self
            clas[w] = b
            moved += b != a
        if not moved:
            break
    return clas[:n]


def _filled(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the cells that hold something; quicker than ``np.nonzero`` of a table."""
    return np.divmod(np.flatnonzero(cells.ravel()), cells.shape[1])


def _steps(table: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Class bigrams by neighbour and class, and what up to 15 more uses in each are worth."""
    return [(cells, _xlogx(cells + np.arange(16)[:, None, None]) - _xlogx(cells)) for cells in (table[:, :CLASSES], table[:CLASSES].T)]


def reassign(clas: np.ndarray, before: np.ndarray, after: np.ndarray, same: np.ndarray, table: np.ndarray, steps: list | None = None) -> np.ndarray:
    """The best class of each word, if it alone moved. The step of ``exchange``, for many words at once.

    ``before``, ``after``: uses by class of the neighbour; ``same``: uses before the word
    itself; ``table``: class bigrams with these words in their classes; ``steps``: its ``_steps``.
    A word that is UNSEEN has no class yet and gets one.
    """
    n, words, d = len(clas), np.arange(len(clas)), np.arange(CLASSES)
    left, right = before.astype(float), after.astype(float)
    left[words, clas] -= same
    right[words, clas] -= same
    gain = np.zeros((n, CLASSES))
    for use, (cells, worth) in zip((left, right), steps or _steps(table), strict=True):
        most, flat = len(worth), worth.reshape(-1, CLASSES)
        w, c = _filled(use)
        to = 0
        while to < len(w):  # whole words, as many as the processor's cache holds
            k, to = to, int(np.searchsorted(w, w[min(to + 2048, len(w)) - 1], side="right"))
            own, kind, r = w[k:to], c[k:to], use[w[k:to], c[k:to]]
            value = flat.take(np.minimum(r, most - 1).astype(np.int64) * len(cells) + kind, axis=0)
            big = np.flatnonzero(r >= most)
            value[big] = _xlogx(cells[kind[big]] + r[big, None]) - _xlogx(cells[kind[big]])
            start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            gain[own[start]] += np.add.reduceat(value, start)
    # The word's own uses leave the cells of its class: those that another class would share with it.
    for use, other, cells in ((left, right, table), (right, left, table.T)):
        w, b = _filled((use[:, :CLASSES] > 0) & (other[words, clas] > 0)[:, None])
        t, x, y = cells[b, clas[w]], use[w, b], other[w, clas[w]]
        gain[w, b] += _xlogx(t - x + y) - _xlogx(t - x) - _xlogx(t + y) + _xlogx(t)
    w, b = _filled(((left[:, :CLASSES] > 0) & (right[:, :CLASSES] > 0)) | (same > 0)[:, None])
    t, x, y = table[b, b], left[w, b], right[w, b]
    gain[w, b] += _xlogx(t + x + y + same[w]) - _xlogx(t + x) - _xlogx(t + y) + _xlogx(t)
    sums = (table.sum(axis=1), after.sum(axis=1)), (table.sum(axis=0), before.sum(axis=1))
    for marginal, count in sums:
        uses, which = np.unique(count, return_inverse=True)
        gain -= (_xlogx(marginal[:CLASSES] + uses[:, None]) - _xlogx(marginal[:CLASSES]))[which]
    # To stay is worth what taking the word out of its class costs.
    has = np.flatnonzero(clas < CLASSES)
    a, stay = clas[has], np.zeros(len(has))
    for use, cells in ((left[has], table[:, :CLASSES]), (right[has], table[:CLASSES].T)):
        w, c = _filled(use)
        w, c = w[c != a[w]], c[c != a[w]]
        t = cells[c, a[w]]
        stay += np.bincount(w, weights=_xlogx(t) - _xlogx(t - use[w, c]), minlength=len(has))
    t = table[a, a]
    stay += _xlogx(t) - _xlogx(t - left[has, a] - right[has, a] - same[has])
    for marginal, count in sums:
        stay -= _xlogx(marginal[a]) - _xlogx(marginal[a] - count[has])
    gain[has, a] = stay
    best = gain.argmax(axis=1)
    held = gain[has, best[has]] <= stay + 1e-9 * np.abs(stay)
    best[has[held]] = a[held]
    return best


class Once:
    """Best classes of words used once, by their own class and those before and after: few distinct cases."""

    def __init__(self, table: np.ndarray, steps: list):
        self.table, self.steps = table, steps
        self.best = np.full((UNSEEN + 1) * (END + 1) ** 2, -1, np.int8)

    def classes(self, clas: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        case = (clas * (END + 1) + before) * (END + 1) + after
        new = np.unique(case[self.best[case] < 0])
        one = np.eye(END + 1)
        for k in range(0, len(new), 8192):
            rest, last = np.divmod(new[k : k + 8192], END + 1)
            own, first = np.divmod(rest, END + 1)
            self.best[new[k : k + 8192]] = reassign(own, one[first], one[last], np.zeros(len(own)), self.table, self.steps)
        return self.best[case].astype(np.int64)


ANSWER = "block long, range long, clas binary"


def _round(blocks: DataFrame, state: DataFrame, known: tuple, table: np.ndarray, turn: int | None, ranges: int, buckets: int) -> DataFrame:
    """The classes after a round: contexts of every word whose turn it is from all blocks, its best class, sent to the blocks that hold it."""
    shared = blocks.sparkSession.sparkContext.broadcast((table, known))

    def lists(row: dict, block: Block) -> tuple:
        clas, counts, rank = _known(row, block, *shared.value[1])
        asked = _asked(block, counts, rank, turn)
        many, kinds, uses = contexts(block, clas, asked)
        return block.vocabulary[asked], (clas[asked].astype(np.uint8), None), (many.astype(np.int32), None), (kinds.astype(np.uint8), many), (uses.astype(np.int32), many)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = _steps(shared.value[0])
        once = Once(shared.value[0], steps)
        for rows in _by_range(batches):
            bounds, words, which = _words(rows)
            word = np.repeat(which, _column(rows, "many", np.int32))
            kinds, uses = _column(rows, "kinds", np.uint8), _column(rows, "uses", np.int32)
            clas = np.zeros(len(words), np.int64)
            clas[which] = _column(rows, "clas", np.uint8)
            by = np.argsort(word, kind="stable")
            word, kinds, uses = word[by], kinds[by].astype(np.int64), uses[by]
            single = np.bincount(word, weights=uses, minlength=len(words)) == 2  # what stands before and after one use
            own = np.flatnonzero(single[word])
            clas[single] = once.classes(clas[single], kinds[own[::2]], kinds[own[1::2]] - END - 1)
            more = np.flatnonzero(~single)
            for k in range(0, len(more), 8192):  # rows of all kinds for some words at a time
                own = more[k : k + 8192]
                a, b = np.searchsorted(word, [own[0], own[-1] + 1])
                at = a + np.flatnonzero(~single[word[a:b]])
                sums = np.bincount(np.searchsorted(own, word[at]) * (SAME + 1) + kinds[at], weights=uses[at], minlength=len(own) * (SAME + 1)).reshape(len(own), SAME + 1)
                clas[own] = reassign(clas[own], sums[:, : END + 1], sums[:, END + 1 : SAME], sums[:, SAME], shared.value[0], steps)
            found = clas[which].astype(np.uint8)
            columns = [pa.array([r["block"] for r in rows]), pa.array([r["range"] for r in rows]), pa.array([planes(found[a:b]) for a, b in bounds], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "range", "clas"])

    def join(row: dict, block: Block) -> tuple:
        clas, counts, rank = _known(row, block, *shared.value[1])
        new = [unplanes(x["clas"], np.uint8) for x in sorted(row["answers"] or [], key=lambda x: x["range"])]
        clas[_asked(block, counts, rank, turn)] = np.concatenate([np.zeros(0, np.uint8), *new])
        return clas, counts, rank

    rows = _with(blocks, state)
    answers = _send(rows, ranges, CONTEXTS, lists).mapInArrow(answer, ANSWER)
    return _states(rows.join(_gathered(answers, buckets, "clas"), "block", "left"), len(known[0]), join, buckets)


def transitions(follows: np.ndarray, single: np.ndarray) -> np.ndarray:
    """log10 probability of each class after each history. Unseen words count like words seen once."""
    follows = follows.copy()
    follows[:, UNSEEN] = single
    follows[START, UNSEEN] += 1.0
    share = follows.sum(axis=0) / follows.sum()
    smooth = (follows + WEIGHT * share) / (follows.sum(axis=1, keepdims=True) + WEIGHT)
    return np.log10(np.maximum(smooth, 1e-300))


def likelihood(follows: np.ndarray) -> float:
    """Log-likelihood of the training classes given those before them, less what classes don't change."""
    return float(_xlogx(follows).sum() - _xlogx(follows.sum(axis=0)).sum() - _xlogx(follows.sum(axis=1)).sum())


SCORES = "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores of all rows by a model of those where ``train`` holds.

    Words stand between white space, A to Z lower-cased; each text has an end token more,
    which is all that a null or empty one has. ``base_score``: the add-half unigram model;
    ``score``: the class model's log10 probability of the text; perplexity is
    10 ** (-score / n_tokens). Repeated rows count as often as they stand, null keys are
    rows like others. Without training texts every token is unseen and has probability 1.
    """
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), train.alias("train"), F.col(text).alias("text"))
    number, size = docs.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    buckets = min(max(-(-(size or 0) // BUCKET_BYTES), FEWEST), MOST)
    with settings(docs.sparkSession, **ONE_BLOCK, **NO_OLD_SHUFFLES):
        return _score(docs, number, buckets)


def _score(docs: DataFrame, number: int, buckets: int) -> DataFrame:
    spark = docs.sparkSession
    ranges = 1 << (max(LEAST_RANGES, number // RANGE_TEXTS) - 1).bit_length()
    blocks = _blocks(docs, F.col("train"), buckets)
    texts = blocks.agg(F.sum(F.size(F.filter("train", lambda t: t)))).first()[0] or 0
    tokens, distinct, top, state = _counts(blocks, ranges, buckets)
    clas, best = np.arange(len(top)) % CLASSES, None
    for k in range(ROUNDS + 2):
        pairs, single = _bigrams(state, len(top))
        clas = np.concatenate([exchange(pairs, CLASSES, fixed=END + 1, clas=np.concatenate([clas, np.arange(END + 1)])), np.arange(END + 1)])
        hot = np.eye(END + 1)[clas]
        table, clas = hot.T @ pairs @ hot, clas[: len(top)]
        if k:  # before the first round only frequent words have classes
            gained = likelihood(table)
            if best is not None and gained <= best[0]:
                break
            best = gained, state, clas, table, hot.T @ single
        if k <= ROUNDS:
            state = _round(blocks, state, (top, clas), table, k % 2 if k else None, ranges, buckets)
    _, state, clas, table, single = best
    follows, single = (np.delete(x, UNSEEN, axis=0) for x in (table, single))  # no word of the training texts is without a class
    answered = _with(blocks, state)
    shared = spark.sparkContext.broadcast((transitions(follows, single), follows.sum(axis=0), tokens + texts, distinct + (texts > 0), texts, (top, clas)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, size, n, v, ends, known = shared.value
        base = lambda c: np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
        for batch in batches:
            for row, block in _open(batch):
                clas, counts, _ = _known(row, block, *known)
                emit = np.where(counts > 0, np.log10(np.maximum(counts, 1) / np.maximum(size[clas], 1)), 0.0)
                own = np.concatenate([clas[block.tokens], np.full(len(block.counts), END)])
                value = step[history(block, clas), own]
                value[: len(block.tokens)] += emit[block.tokens]
                text = np.concatenate([np.repeat(np.arange(len(block.counts)), block.counts), np.arange(len(block.counts))])
                seen = np.concatenate([counts[block.tokens], np.full(len(block.counts), ends)])
                sums = [np.bincount(text, weights=x, minlength=len(block.counts)) for x in (seen > 0, base(seen), value)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], pa.int64()), pa.array(row["train"], pa.bool_()), pa.array(block.counts + 1), pa.array(sums[0].astype(np.int64)), pa.array(np.full(len(block.counts), n)), pa.array(sums[1]), pa.array(sums[2])],
                    names=[x.split()[0] for x in SCORES.split(", ")],
                )

    return keep(answered.mapInArrow(run, SCORES), "lm-scores")
