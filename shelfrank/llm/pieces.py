"""SentencePiece encoding and decoding by suffix-array matching.

Texts are cut where no piece can reach across (two characters that stand together in no
piece), and each distinct cut is encoded once a batch: the new cuts of a batch are put one
after the other, a suffix array is built over them, every piece is found in it by binary
search, and its range of the array gives all places where it occurs. These edges, sorted by
position, are then relaxed in the model's order: in each cut the best-scored edge over two
neighbouring parts joins them, the leftmost of equals first, until none is left. This is
what the model's byte-pair rule asks for, so the ids are those of the library.

Characters without a piece become their UTF-8 bytes. Decoding joins the pieces again.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfrank.llm import words as W

SPACE = 0x2581
#: Text taken at once; characters of new cuts in one suffix array; cuts that a task remembers; longest cut relaxed with others.
BATCH_BYTES, MATCHED, REMEMBERED, LONG = 4 << 20, 1 << 18, 200_000, 64
_NONE = np.int32(2**31 - 1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """The vocabulary of a byte-pair model file, as arrays."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes = np.zeros(256, np.int32)
        texts, ids, scores = [], [], []
        self.out = [b""] * n
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.out[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                texts.append(piece)
                ids.append(i)
                scores.append(model.get_score(i))
                self.out[i] = piece.replace("▁", " ").encode()
        self.ids = np.array(ids, np.int32)
        _, rank = np.unique(-np.array(scores), return_inverse=True)  # equal scores, equal ranks
        self.rank = rank.astype(np.int32)
        self.length = np.array([len(t) for t in texts], np.int64)
        self.longest = int(self.length.max())
        self.points = np.zeros((len(texts), self.longest), np.int64)
        for i, t in enumerate(texts):
            self.points[i, : len(t)] = [ord(c) for c in t]
        inside = np.arange(self.longest - 1) < (self.length - 1)[:, None]
        self.pairs = np.unique((self.points[:, :-1] << 21 | self.points[:, 1:])[inside])
        low = self.pairs[(self.pairs >> 21 < 1024) & (self.pairs & 0x1FFFFF < 1024)]
        self.near = np.zeros((1024, 1024), dtype=bool)
        self.near[low >> 21, low & 0x1FFFFF] = True

    def together(self, points: np.ndarray) -> np.ndarray:
        """Whether some piece holds the character and the next one side by side."""
        x, y = points[:-1], points[1:]
        small = (x < 1024) & (y < 1024)
        out = np.zeros(len(x), dtype=bool)
        out[small] = self.near[x[small], y[small]]
        rest = np.flatnonzero(~small)
        pair = x[rest] << 21 | y[rest]
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        out[rest] = self.pairs[at] == pair
        return out


def suffix_array(points: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``points`` in the order of the ``depth`` (or more) characters from there on, by doubling."""
    rank = np.unique(points, return_inverse=True)[1].astype(np.int64) + 1
    step = 1
    while step < depth:
        after = np.zeros_like(rank)
        after[:-step] = rank[step:]
        rank = np.unique(rank * (len(points) + 2) + after, return_inverse=True)[1].astype(np.int64) + 1
        step *= 2
    return np.argsort(rank, kind="stable")


def occurrences(points: np.ndarray, order: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """For each piece its range in the suffix array: binary search for all pieces side by side."""
    width = pieces.longest
    padded = np.concatenate([points, np.full(width, -1)])
    ends = []
    for above in (False, True):
        low, high = np.zeros(len(pieces.length), np.int64), np.full(len(pieces.length), len(order), np.int64)
        open_ = np.flatnonzero(low < high)
        while len(open_):
            mid = (low[open_] + high[open_]) // 2
            sign = np.zeros(len(open_), np.int8)  # of text less piece, at the first character that differs
            for k in range(width):
                todo = np.flatnonzero((sign == 0) & (k < pieces.length[open_]))
                if not len(todo):
                    break
                sign[todo] = np.sign(padded[order[mid[todo]] + k] - pieces.points[open_[todo], k])
            right = (sign < 0) | (above & (sign == 0))
            low[open_[right]] = mid[right] + 1
            high[open_[~right]] = mid[~right]
            open_ = open_[low[open_] < high[open_]]
        ends.append(low)
    return ends[0], ends[1]


def encode_cuts(points: np.ndarray, first: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all cuts, one after the other, and how many each has. ``points``: the cuts, a -1 after each."""
    width = pieces.longest + 1
    order = suffix_array(points, pieces.longest)
    low, high = occurrences(points, order, pieces)
    piece = np.repeat(np.arange(len(low), dtype=np.int32), high - low)
    place = order[W.spans(low, high - low)] * width + pieces.length[piece]
    del order, low, high
    by = np.argsort(place)  # edges by position, then length
    place, piece = place[by], piece[by]
    rank, ids = np.full(len(points) * width, _NONE, np.int32), np.full(len(points) * width, -1, np.int32)
    rank[place], ids[place] = pieces.rank[piece], pieces.ids[piece]

    length = np.diff(np.append(first, len(points))) - 1
    start = W.spans(first, length)
    size, cut = np.ones(len(start), np.int64), np.repeat(np.arange(len(first)), length)
    long = np.flatnonzero(length > LONG)
    done = [_heap(int(first[c]), int(length[c]), rank, width, int(c)) for c in long]
    live = ~np.isin(cut, long) if len(long) else np.ones(len(start), dtype=bool)
    start, size, cut = start[live], size[live], cut[live]
    while len(start):
        both = np.minimum(size[:-1] + size[1:], width - 1)
        pair = np.full(len(start), _NONE, np.int64)
        good = (cut[:-1] == cut[1:]) & (size[:-1] + size[1:] < width)
        pair[:-1][good] = rank[(start[:-1] * width + both)[good]]
        begin = np.flatnonzero(np.concatenate([[True], cut[1:] != cut[:-1]]))
        best = np.minimum.reduceat(pair << 32 | np.arange(len(start)), begin)  # leftmost of equals
        joins = best >> 32 < _NONE
        which = best[joins] & 0xFFFFFFFF
        size[which] += size[which + 1]
        ended = np.repeat(~joins, np.diff(np.append(begin, len(start))))
        done.append((start[ended], size[ended], cut[ended]))
        stay = ~ended
        stay[which + 1] = False
        start, size, cut = start[stay], size[stay], cut[stay]
    start, size, cut = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (start, size, cut)
    by = np.argsort(start, kind="stable")
    start, size, cut = start[by], size[by], cut[by]
    out = ids[start * width + size]
    return _bytes(out, points[start], cut, pieces, len(first))


def _heap(first: int, length: int, rank: np.ndarray, width: int, cut: int):
    """The same relaxation for one long cut, with a queue."""
    size, nxt, prev = [1] * length, list(range(1, length + 1)), list(range(-1, length - 1))
    queue = []

    def offer(i):
        j = nxt[i]
        if j < length and size[i] + size[j] < width:
            r = int(rank[(first + i) * width + size[i] + size[j]])
            if r < _NONE:
                heapq.heappush(queue, (r, i, size[i], size[j]))

    for i in range(length - 1):
        offer(i)
    while queue:
        _, i, a, b = heapq.heappop(queue)
        j = nxt[i]
        if size[i] != a or j >= length or size[j] != b:
            continue
        size[i], size[j], nxt[i] = a + b, 0, nxt[j]
        if nxt[i] < length:
            prev[nxt[i]] = i
        offer(i)
        if prev[i] >= 0:
            offer(prev[i])
    size = np.array(size)
    own = np.flatnonzero(size)
    return own + first, size[own], np.full(len(own), cut)


def _bytes(ids: np.ndarray, points: np.ndarray, cut: np.ndarray, pieces: Pieces, cuts: int) -> tuple[np.ndarray, np.ndarray]:
    """Puts UTF-8 bytes in place of characters without a piece."""
    lone = np.flatnonzero(ids < 0)
    if len(lone):
        raw = [chr(p).encode("utf-8", "replace") for p in points[lone].tolist()]
        many = np.ones(len(ids), np.int64)
        many[lone] = [len(r) for r in raw]
        ids, cut = np.repeat(ids, many), np.repeat(cut, many)
        ids[ids < 0] = pieces.bytes[np.frombuffer(b"".join(raw), np.uint8)]
    return ids, np.bincount(cut, minlength=cuts)


class Encoder:
    """Ids of whole texts; remembers cuts seen before by their hash."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.forget()

    def forget(self) -> None:
        self.hash, self.first, self.length, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _cuts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Characters, where cuts start, their hashes, and the number of cuts of each text."""
        full = [(b" " + t).decode("utf-8", "replace") if t else "" for t in texts]
        size = np.array([len(t) for t in full], np.int64)
        points = np.frombuffer("".join(full).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        if not len(points):
            return points, np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
        points[points == 32] = SPACE
        opens = np.concatenate([[True], ~self.pieces.together(points)])
        opens[(np.cumsum(size) - size)[size > 0]] = True
        first = np.flatnonzero(opens)
        length = np.diff(np.append(first, len(points)))
        hashes = W.mix(W.run_sums(points, first, first + length) + length.astype(np.uint64))
        own = np.add.reduceat(opens.astype(np.int64), (np.cumsum(size) - size)[size > 0])
        counts = np.zeros(len(texts), np.int64)
        counts[size > 0] = own
        return points, first, hashes, counts

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and how many each has. An empty text has none."""
        if len(self.hash) > REMEMBERED:
            self.forget()
        hashes, counts, new = [], [], []
        at = 0
        seen = self.hash
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (size == 0 or size < W.PIECE_BYTES):
                size += len(texts[to])
                to += 1
            points, first, hash_, count = self._cuts(texts[at:to])
            value, where = np.unique(hash_, return_index=True)
            fresh = ~np.isin(value, seen, assume_unique=True)
            if fresh.any():
                own = np.sort(where[fresh])
                length = np.diff(np.append(first, len(points)))[own]
                text = np.full(int(length.sum()) + len(own), -1, np.int64)
                starts = np.cumsum(length + 1) - length - 1
                text[W.spans(starts, length)] = points[W.spans(first[own], length)]
                new.append((text, starts, hash_[own]))
                seen = np.union1d(seen, value[fresh])
            hashes.append(hash_)
            counts.append(count)
            at = to
        if new:
            base = np.cumsum([0, *[len(t) for t, _, _ in new]])[:-1]
            text, starts, fresh = np.concatenate([t for t, _, _ in new]), np.concatenate([s + b for (_, s, _), b in zip(new, base, strict=True)]), np.concatenate([h for _, _, h in new])
            del new
            parts, at = [], 0
            while at < len(starts):  # whole cuts, as many as one array is to hold
                to = max(at + 1, int(np.searchsorted(starts, starts[at] + MATCHED)))
                end = starts[to] if to < len(starts) else len(text)
                parts.append(encode_cuts(text[starts[at] : end], starts[at:to] - starts[at], self.pieces))
                at = to
            ids, many = (np.concatenate(x) for x in zip(*parts, strict=True))
            self.hash = np.concatenate([self.hash, fresh])
            self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(many) - many])
            self.length = np.concatenate([self.length, many])
            self.ids = np.concatenate([self.ids, ids])
            by = np.argsort(self.hash)
            self.hash, self.first, self.length = self.hash[by], self.first[by], self.length[by]
        out, sizes = [], []
        for hash_, count in zip(hashes, counts, strict=True):
            at = np.searchsorted(self.hash, hash_)
            length = self.length[at]
            out.append(self.ids[W.spans(self.first[at], length)])
            sizes.append(np.diff(np.concatenate([[0], np.cumsum(length)])[np.cumsum(count)], prepend=0))
        return np.concatenate([*out, np.zeros(0, np.int32)]), np.concatenate([*sizes, np.zeros(0, np.int64)])


def decode(ids: np.ndarray, pieces: Pieces) -> bytes:
    """The text of the ids, without the space put before every text."""
    text = b"".join([pieces.out[i] for i in ids.tolist()])
    return text[1:] if text.startswith(b" ") else text


_KEPT: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """The worker's encoder of a model file, kept for its next task."""
    if path not in _KEPT:
        _KEPT[path] = Encoder(Pieces(path))
    return _KEPT[path]


def _schema(docs: DataFrame, but: set[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name not in but)


def encode(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """Puts ``ids`` (array<int>) in the place of the text column; other columns pass through.

    The ids are those of the model's own library. A null text has no ids, like an empty one;
    bytes that are no UTF-8 count as U+FFFD. ``model_path``: a byte-pair model file with
    identity normalisation that every executor can open. A column named ids is replaced.
    """
    docs = docs.drop("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model_path)
        for batch in batches:
            number = batch.schema.get_field_index(text)
            column = batch.column(number).cast(pa.large_binary()).fill_null(b"")
            others = [i for i in range(batch.num_columns) if i != number]
            _, offsets = W.column_bytes(column)
            at = 0
            while at < len(column):
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BATCH_BYTES, side="right")) - 1)
                ids, sizes = encoder.encode(column.slice(at, to - at).to_pylist())
                edges = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                own = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([*[own.column(i) for i in others], pa.ListArray.from_arrays(pa.array(edges), pa.array(ids, pa.int32()))], names=[*[batch.schema.names[i] for i in others], "ids"])
                at = to

    return docs.mapInArrow(run, f"{_schema(docs, {text})}, ids array<int>")


def decoded(encoded: DataFrame, model_path: str) -> DataFrame:
    """Adds ``text``, read back from ``ids``; a null list is an empty text. A column named text is replaced."""
    encoded = encoded.drop("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _encoder(model_path).pieces
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids"))
            texts = [decode(np.asarray(row or [], np.int64), pieces) for row in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())], names=[*batch.schema.names, "text"])

    return encoded.mapInArrow(run, f"{_schema(encoded, set())}, text string")


def digest(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_pieces, ids_crc32 (ids as little-endian 32-bit integers), round_trip (the ids give the text back).

    A text that holds the space mark U+2581 itself, or bytes that are no UTF-8, doesn't come back as it was.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model_path)
        for batch in batches:
            column = batch.column(1).cast(pa.large_binary()).fill_null(b"")
            _, offsets = W.column_bytes(column)
            at = 0
            while at < len(column):
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BATCH_BYTES, side="right")) - 1)
                texts = column.slice(at, to - at).to_pylist()
                ids, sizes = encoder.encode(texts)
                parts = np.split(ids, np.cumsum(sizes)[:-1])
                back = [decode(p, encoder.pieces) == t for p, t in zip(parts, texts, strict=True)]
                crc = [zlib.crc32(p.astype("<u4").tobytes()) for p in parts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(sizes), pa.array(crc, pa.int64()), pa.array(back)], names=[key, "n_pieces", "ids_crc32", "round_trip"])
                at = to

    rows = docs.select(key, F.col(text).cast("binary").alias(text))
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, n_pieces long, ids_crc32 long, round_trip boolean")
