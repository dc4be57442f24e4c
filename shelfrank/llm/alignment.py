"""Alignment of two tokenizers' tokens of the same texts, and how often their ids go together.

Tokens of both tokenizers lie over the same bytes. Two tokens belong together if they
overlap, directly or through others; such a group ends where tokens of both end. Every token
points to the token of the other kind that overlaps it and reaches farthest to the right;
doubling these pointers for all tokens at once leads each to the last token of its group,
which names the group.

Texts are cut before spaces that no token of either tokenizer can reach across, so groups
end there too, and each distinct cut is encoded and aligned once for many texts.

The number of documents that hold a linked pair of ids comes from a shuffle over all
documents. The pairs that stand in most documents, up to a fixed number, are sent to every
task; what is left are rare pairs, which are joined without a hot key.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfrank.llm import words as W
from shelfrank.llm.storage import keep

#: Cuts whose alignment a task remembers; cuts encoded as one text, and the longest such.
REMEMBERED, AT_ONCE, LONGEST = 300_000, 64, 200
#: Bytes of text taken at a time (one longer text is taken whole); cuts whose groups' texts are put together at a time.
PIECE_BYTES, GATHERED = 1 << 19, 1 << 14
#: Pairs of ids that are sent to every task.
FREQUENT = 1 << 20
_SEEN: dict[tuple[str, str], "Cuts"] = {}


class Vocabulary:
    """Bytes of every token of a tokenizer, and its ids of texts; the bytes are None where an id stands for no text."""

    def __init__(self, path: str):
        self.bytes: list[bytes | None]


class ByteLevel(Vocabulary):
    """Byte-level BPE of the tokenizers library: a token's characters stand for bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # Printable Latin-1 characters stand for themselves; the other bytes, in order, for U+0100 and on.
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        value = {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(sorted(set(range(256)) - set(own)))}
        vocabulary = self.tokenizer.get_vocab()
        self.bytes = [None] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            if all(c in value for c in token):
                self.bytes[i] = bytes(value[c] for c in token)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class SentencePieces(Vocabulary):
    """A sentencepiece model that sets a space before every text; U+2581 stands for a space, <0xHH> for a byte."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else None if self.model.is_control(i) or self.model.is_unknown(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        #: Whether some piece holds a space after another character, so that texts can't be cut there.
        self.whole = any("▁" in p.lstrip("▁") for i, p in enumerate(pieces) if self.bytes[i])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode([t[1:] for t in texts], num_threads=1)


def _white(data: np.ndarray) -> np.ndarray:
    """Marks last bytes of white space characters, ASCII and other (and of U+001C to U+001F)."""
    white = ((data >= 0x09) & (data <= 0x0D)) | ((data >= 0x1C) & (data <= 0x20))
    one, two = data[1:], data[2:]
    white[1:] |= (data[:-1] == 0xC2) & ((one == 0x85) | (one == 0xA0))
    first, second = data[:-2], data[1:-1]
    white[2:] |= (first == 0xE1) & (second == 0x9A) & (two == 0x80)
    white[2:] |= (first == 0xE2) & (second == 0x80) & ((two <= 0x8A) | (two == 0xA8) | (two == 0xA9) | (two == 0xAF))
    white[2:] |= (first == 0xE2) & (second == 0x81) & (two == 0x9F)
    white[2:] |= (first == 0xE3) & (second == 0x80) & (two == 0x80)
    return white


def cut_places(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Marks each space after a character that is no white space, unless its text ends with it."""
    cuts = np.zeros(len(data), dtype=bool)
    cuts[1:] = (data[1:] == 0x20) & ~_white(data)[:-1]
    cuts[offsets[1:][offsets[1:] > 0] - 1] = False
    return cuts


def groups_of(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group of each token of both kinds, numbered from 0 in order of place.

    ``a_end`` and ``b_end``: where tokens end, in ascending order; both kinds fill the same
    bytes. A token points to the farthest-reaching one that overlaps it, itself included (of
    two that end together, to that of the first kind); pointers are doubled until they rest.
    """
    n = len(a_end)
    over_a, over_b = np.searchsorted(b_end, a_end), np.searchsorted(a_end, b_end)
    pointer = np.concatenate([np.where(b_end[over_a] > a_end, n + over_a, np.arange(n)), over_b])
    while True:
        onward = pointer[pointer]
        if np.array_equal(onward, pointer):
            break
        pointer = onward
    group = np.unique(pointer, return_inverse=True)[1]
    return group[:n], group[n:]


def _digits(ids: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of all ids, a mark behind each; and how many bytes each takes."""
    width = len(str(int(ids.max(initial=0))))
    size = np.ones(len(ids), np.int64)
    for k in range(1, width):
        size += ids >= 10**k
    place = np.arange(width + 1)
    power = 10 ** np.maximum(size[:, None] - 1 - place, 0)
    out = (ids[:, None] // power % 10 + 48).astype(np.uint8)
    out[np.arange(len(ids)), size] = mark
    return out[place <= size[:, None]], size + 1


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sum of their values."""
    by = np.argsort(keys, kind="stable")
    keys = keys[by]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(values[by], first) if len(first) else np.zeros(0, np.int64)


def _token_table(tokens: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size of each token, where it begins, and the bytes of all; a token without bytes is empty."""
    size = np.array([len(t or b"") for t in tokens], np.int64)
    return size, np.cumsum(size) - size, np.frombuffer(b"".join(t or b"" for t in tokens), np.uint8)


_SPACES = W.byte_set((0x09, 0x0D), (0x1C, 0x20))


class Cuts:
    """Alignments of the cuts seen so far, by hash."""

    def __init__(self, a: Vocabulary, b: Vocabulary):
        self.a, self.b = a, b
        self.a_table, self.b_table = (_token_table(v.bytes) for v in (a, b))
        self.known, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        #: A row a cut: tokens of both kinds, groups, links, and 1 if its bytes can't be had back.
        self.sums = np.zeros((0, 5), np.int64)
        self.text_at, self.text_size, self.text = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
        self.pair_at, self.pair_size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pairs, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.known)

    def _runs(self, raw: bytes, edges: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Encodes runs of cuts that stand one after the other in ``raw``, each run as one text.

        ``edges``: where each run ends. Gives the ids of both kinds, how many each run has, and
        which runs' bytes can be had back from both; the others have no ids.
        """
        texts = [raw[x:y].decode("utf-8", "replace") for x, y in zip([0, *edges[:-1].tolist()], edges.tolist(), strict=True)]
        ids, counts, good = [], [], np.ones(len(edges), dtype=bool)
        size = np.diff(edges, prepend=0)
        for v, sizes, at, flat in ((self.a, *self.a_table), (self.b, *self.b_table)):
            found = v.encode(texts)
            n = np.array([len(f) for f in found], np.int64)
            own = np.concatenate([np.array(f, np.int64) for f in found])
            have = np.add.reduceat(np.append(sizes[own], 0), np.cumsum(n) - n) * (n > 0)
            bad = have != size
            text = flat[W.spans(at[own], sizes[own])].tobytes()
            if bad.any() or text != raw:
                ends = np.cumsum(have)
                for i in np.flatnonzero(~bad):
                    bad[i] = text[ends[i] - have[i] : ends[i]] != raw[edges[i] - size[i] : edges[i]]
            good &= ~bad
            ids.append(own)
            counts.append(n)
        keep_ = [np.repeat(good, n) for n in counts]
        return [i[k] for i, k in zip(ids, keep_, strict=True)], [n * good for n in counts], good

    def _encode(self, words: W.Words, which: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], np.ndarray]:
        """The cuts in the order they were encoded in, their ids of both kinds, how many each
        has, and which cuts' bytes can't be had back from them.

        Cuts are encoded many at a time; the ids are told apart by their bytes, and a run
        whose bytes differ or that has a token across an edge is encoded cut by cut.
        """
        start, size = words.start[which], words.end[which] - words.start[which]
        joined = np.flatnonzero((size <= LONGEST) & (words.data[start + size - 1] < 0x80) & ~_SPACES[words.data[start + size - 1]])
        alone = np.setdiff1d(np.arange(len(which)), joined)
        done = []  # (cuts, ids, counts, lost)
        if len(joined):
            raw = words.data[W.spans(start[joined], size[joined])].tobytes()
            edges = np.cumsum(size[joined])
            last = np.append(np.arange(AT_ONCE - 1, len(joined) - 1, AT_ONCE), len(joined) - 1)
            ids, counts, good = self._runs(raw, edges[last])
            own = np.repeat(good, np.diff(last, prepend=-1))  # cuts of good runs
            ends = np.cumsum(size[joined][own])
            parts, apart = [], np.zeros(len(ends), dtype=bool)
            for i, sizes in zip(ids, (self.a_table[0], self.b_table[0]), strict=True):
                token_ends = np.cumsum(sizes[i])
                place = np.searchsorted(token_ends, ends)
                apart |= token_ends[place] != ends if len(ends) else apart
                parts.append(np.diff(place, prepend=-1))
            if apart.any():  # a token across an edge: none is known, and all are encoded cut by cut then
                own[:] = False
                ids, parts = [i[:0] for i in ids], [p[:0] for p in parts]
            done.append((joined[own], ids, parts, np.zeros(int(own.sum()), dtype=bool)))
            alone = np.concatenate([alone, joined[~own]])
        if len(alone):
            raw = words.data[W.spans(start[alone], size[alone])].tobytes()
            ids, counts, good = self._runs(raw, np.cumsum(size[alone]))
            done.append((alone, ids, counts, ~good))
        ids, counts = ([np.concatenate([d[k][kind] for d in done]) for kind in (0, 1)] for k in (1, 2))
        return np.concatenate([d[0] for d in done]), ids, counts, np.concatenate([d[3] for d in done])

    def _learn(self, hashes: np.ndarray, words: W.Words, which: np.ndarray) -> None:
        cuts, (a, b), (n_a, n_b), lost = self._encode(words, which)
        hashes = hashes[cuts]
        cut_of_a = np.repeat(np.arange(len(cuts)), n_a)
        group_a, group_b = groups_of(np.cumsum(self.a_table[0][a]), np.cumsum(self.b_table[0][b]))
        groups = int(group_a[-1]) + 1 if len(a) else 0
        in_a, in_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        cut_of = cut_of_a[np.cumsum(in_a) - 1] if groups else np.zeros(0, np.int64)
        n_groups = np.bincount(cut_of, minlength=len(cuts))
        n_links = np.bincount(cut_of, weights=in_a * in_b, minlength=len(cuts)).astype(np.int64)

        # The text of the groups: ids of the first kind, a bar, ids of the second, a semicolon.
        before_a, before_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        place_a, place_b = np.arange(len(a)) + before_b[group_a], np.arange(len(b)) + (before_a + in_a)[group_b]
        ids, mark = np.zeros(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[place_a], ids[place_b] = a, b
        mark[place_a[before_a + in_a - 1]], mark[place_b[before_b + in_b - 1]] = ord("|"), ord(";")
        text, size = _digits(ids, mark)
        text_size = np.diff(np.concatenate([[0], np.cumsum(size)])[np.cumsum(n_a + n_b)], prepend=0)

        # Links: distinct ids of a group meet, with how often each pair does.
        wide = np.int64(max(len(self.a.bytes), len(self.b.bytes)))
        (key_a, times_a), (key_b, times_b) = _summed(group_a * wide + a, np.ones(len(a), np.int64)), _summed(group_b * wide + b, np.ones(len(b), np.int64))
        per_b = np.bincount(key_b // wide, minlength=groups)
        meets = per_b[key_a // wide]
        left, right = np.repeat(np.arange(len(key_a)), meets), W.spans((np.cumsum(per_b) - per_b)[key_a // wide], meets)
        pair = (key_a[left] % wide) << 32 | key_b[right] % wide
        times, cut = times_a[left] * times_b[right], cut_of[key_a[left] // wide]
        by = np.lexsort((pair, cut))
        pair, times, cut = pair[by], times[by], cut[by]
        first = np.flatnonzero((np.diff(pair, prepend=-1) != 0) | (np.diff(cut, prepend=-1) != 0))
        pair_size = np.bincount(cut[first], minlength=len(cuts))

        number = len(self.sums) + np.arange(len(cuts))
        self.sums = np.concatenate([self.sums, np.stack([n_a, n_b, n_groups, n_links, lost], axis=1)])
        for at, size, flat, new_size, new in (("text_at", "text_size", "text", text_size, text), ("pair_at", "pair_size", "pairs", pair_size, pair[first])):
            setattr(self, at, np.concatenate([getattr(self, at), len(getattr(self, flat)) + np.cumsum(new_size) - new_size]))
            setattr(self, size, np.concatenate([getattr(self, size), new_size]))
            setattr(self, flat, np.concatenate([getattr(self, flat), new]))
        self.times = np.concatenate([self.times, np.add.reduceat(times, first) if len(first) else times])
        by = np.argsort(hashes)
        place = np.searchsorted(self.known, hashes[by])
        self.known, self.number = np.insert(self.known, place, hashes[by]), np.insert(self.number, place, number[by])

    def numbers(self, words: W.Words) -> np.ndarray:
        distinct, first, place = np.unique(words.hash, return_index=True, return_inverse=True)
        new = np.flatnonzero(self.known[np.searchsorted(self.known, distinct).clip(max=len(self) - 1)] != distinct) if len(self) else np.arange(len(distinct))
        if len(new):
            self._learn(distinct[new], words, first[new])
        return self.number[np.searchsorted(self.known, distinct)][place]

    def align(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """For texts with a space before each (or no bytes at all): a row of sums a text, the text
        of its groups, how many distinct pairs it has, the pairs, and how often it links each."""
        texts = len(offsets) - 1
        whole = getattr(self.b, "whole", False)
        places = (lambda d: np.zeros(len(d), bool)) if whole else (lambda d: cut_places(d, offsets - offsets[0]))
        words = W.split(data, offsets, lambda d: (np.ones(len(d), bool), places(d)), lower=False)
        if not len(words.hash):
            return np.zeros((texts, 4), np.int64), [b""] * texts, np.zeros(texts, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        cut, text = self.numbers(words), words.text
        edges = words.first()
        sums = np.diff(np.concatenate([np.zeros((1, 5), np.int64), np.cumsum(self.sums[cut], axis=0)])[edges], axis=0)
        lost = sums[:, 4] > 0
        stay = ~lost[text]
        cut, text = cut[stay], text[stay]
        sums = np.where(lost[:, None], 0, sums)[:, :4]

        size = np.bincount(text, weights=self.text_size[cut], minlength=texts).astype(np.int64)
        parts = (cut[at : at + GATHERED] for at in range(0, len(cut), GATHERED))
        flat = memoryview(b"".join([self.text[W.spans(self.text_at[p], self.text_size[p])].tobytes() for p in parts]))
        ends = np.cumsum(size)
        groups = [bytes(flat[e - s : e - 1]) if s else b"" for s, e in zip(size.tolist(), ends.tolist(), strict=True)]

        many, n = np.unique(text * np.int64(len(self.sums)) + cut, return_counts=True)
        text, cut = many // len(self.sums), many % len(self.sums)
        at = W.spans(self.pair_at[cut], self.pair_size[cut])
        text, pair, times = np.repeat(text, self.pair_size[cut]), self.pairs[at], self.times[at] * np.repeat(n, self.pair_size[cut])
        by = np.lexsort((pair, text))
        text, pair, times = text[by], pair[by], times[by]
        first = np.flatnonzero((np.diff(pair, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
        times = np.add.reduceat(times, first) if len(first) else times
        return sums, groups, np.bincount(text[first], minlength=texts), pair[first], times


def _with_space(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts, a space before each that isn't empty."""
    data, offsets = W.column_bytes(column)
    length = np.diff(offsets)
    size = length + (length > 0)
    ends = np.cumsum(size)
    out = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
    out[W.spans(ends - length, length)] = data[offsets[0] : offsets[-1]]
    return out, np.concatenate([[0], ends])


def align(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """Per row: key, n_a, n_b, n_groups, n_links, groups, pairs and times.

    ``a_path``: a byte-level file of the tokenizers library, which encodes a space and the
    text; ``b_path``: a sentencepiece model. ``groups`` lists the ids of both kinds as
    `a1,a2|b1;a3|b2,b3`; with ``digest`` it is the hex SHA-256 of that. ``pairs`` are the
    distinct linked ids, the first one times 2**32 plus the second, and ``times`` how many
    links each has. A null or empty text, and one whose bytes can't be had back from both
    kinds of tokens, has no tokens: zeros, an empty text of groups and no pairs. Rows are
    taken as they come, so repeated rows and ids give rows of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        files = (a_path, b_path)
        if files not in _SEEN:  # kept for the worker's next task
            _SEEN[files] = Cuts(ByteLevel(a_path), SentencePieces(b_path))
        for batch in batches:
            data, offsets = _with_space(batch.column(1))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE_BYTES, side="right")) - 1)
                if len(_SEEN[files]) > REMEMBERED:
                    _SEEN[files] = Cuts(_SEEN[files].a, _SEEN[files].b)
                sums, groups, size, pairs, times = _SEEN[files].align(data, offsets[at : to + 1])
                edges = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                texts = [hashlib.sha256(g).hexdigest() if g else "" for g in groups] if digest else [g.decode() for g in groups]
                lists = [pa.ListArray.from_arrays(pa.array(edges), pa.array(x)) for x in (pairs, times)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), *[pa.array(sums[:, i]) for i in range(4)], pa.array(texts, pa.string()), *lists], names=names)
                at = to

    rows = docs.select(F.col(key), F.col(text).cast("binary").alias("_text"))
    kind = rows.schema[0].dataType.simpleString()
    names = [key, "n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "times"]
    return rows.mapInArrow(run, f"`{key}` {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<long>")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n: in how many rows each pair of ids is linked."""
    return aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))


def rate(aligned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``align`` with n_best and count_sum in place of pairs and times.

    A pair's count is the number of rows that link it. count_sum adds the counts of a row's
    links; n_best counts its links whose count is the highest of all pairs of their first id.
    """
    spark = aligned.sparkSession
    rows = keep(aligned.withColumn("_row", F.monotonically_increasing_id()), "aligned")
    counts = keep(pair_counts(rows), "pair-counts")
    # A row for each id of the first vocabulary.
    best = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("most"))
    sizes = counts.groupBy(F.floor(F.log2(F.col("n"))).cast("int").alias("power")).agg(F.count("*").alias("n")).collect()
    least, total = 1 << 62, 0
    for power, n in sorted(((r.power, r.n) for r in sizes), reverse=True):
        total += n
        if total > FREQUENT:
            break
        least = 1 << power
    table = counts.where(F.col("n") >= least).orderBy("pair").toArrow()
    firsts = best.orderBy("a").toArrow()
    shared = spark.sparkContext.broadcast(tuple(c.to_numpy() for t in (table, firsts) for c in t.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, ids, most = shared.value
        for batch in batches:
            own, times = batch.column("pairs"), batch.column("times").values.to_numpy()
            edges = own.offsets.to_numpy()
            own, times = own.values.to_numpy()[edges[0] : edges[-1]], times[edges[0] : edges[-1]]
            edges = edges - edges[0]
            at = np.searchsorted(pairs, own).clip(max=max(len(pairs) - 1, 0))
            held = pairs[at] == own if len(pairs) else np.zeros(len(own), dtype=bool)
            n = np.where(held, counts[at], 0) if len(pairs) else np.zeros(len(own), np.int64)
            top = np.where(held & (n == most[np.searchsorted(ids, own >> 32)]), times, 0) if len(ids) else n
            total = [np.diff(np.concatenate([[0], np.cumsum(x)])[edges]) for x in (top, n * times)]
            rest = np.concatenate([[0], np.cumsum(~held)])[edges].astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(rest), pa.array(x[~held])) for x in (own, times)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in front], *map(pa.array, total), *lists], names=[*front, "n_best", "count_sum", "pairs", "times"])

    front = ["_row", key, "n_a", "n_b", "n_groups", "n_links", "groups"]
    kind = rows.schema[key].dataType.simpleString()
    shape = f"_row long, `{key}` {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, n_best long, count_sum long, pairs array<long>, times array<long>"
    rated = keep(rows.select(*front, "pairs", "times").mapInArrow(run, shape), "rated")
    # Rare pairs: each stands in few rows, and meets its count by a shuffle.
    rare = rated.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("_row", "p.pairs", "p.times").withColumnRenamed("pairs", "pair")
    rare = rare.join(counts.where(F.col("n") < least), "pair").withColumn("a", F.shiftright("pair", 32)).join(F.broadcast(best), "a")
    rare = rare.groupBy("_row").agg(F.sum(F.when(F.col("n") == F.col("most"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("n") * F.col("times")).alias("_sum"))
    joined = rated.drop("pairs", "times").join(rare, "_row", "left")
    sums = [(F.col(c) + F.coalesce(o, F.lit(0))).alias(c) for c, o in (("n_best", "_best"), ("count_sum", "_sum"))]
    return joined.select(key, "n_a", "n_b", "n_groups", "n_links", *sums, "groups")


def split_groups(groups: str) -> list[tuple[list[int], list[int]]]:
    """The ids of both kinds of each group, from the text of the groups."""
    sides = [g.split("|") for g in re.split(";", groups) if g]
    return [([int(i) for i in a.split(",")], [int(i) for i in b.split(",")]) for a, b in sides]
