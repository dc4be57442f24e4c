"""Token ids of documents in ORC files, in order of document id.

ORC keeps the ids in run-length encoded integer stripes with a row index, and a Bloom
filter on the document id: a reader of one document or a range skips files, stripes and
row groups by their metadata, and Spark reads the stripes of one file in parallel.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfrank.llm import words as W
from shelfrank.llm.storage import keep
from shelfrank.session import shared_folder

END_ID = 2
#: Stripe size, rows an index entry stands for, and false hits of the Bloom filter.
ORC_OPTIONS = {"orc.stripe.size": 64 << 20, "orc.row.index.stride": 10_000, "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": 0.01, "orc.create.index": "true", "compression": "zstd"}
#: Words and other parts of chunks whose ids a worker remembers.
REMEMBERED = 1_000_000
_SEEN: dict[str, "Chunks"] = {}


#: Punctuation that may be cut off the end of a chunk: never part of a word, of a special token or of "'s".
TAIL = ".,;:!?|%&$#*"
#: Words encoded in one call; bits of a part's hash by which it is looked up first; new parts merged at once.
AT_ONCE, EARLY_BITS, RECENT = 256, 20, 1 << 16
_EARLY_SHIFT = np.uint64(64 - EARLY_BITS)


_TAIL = W.byte_set(*[(ord(c), ord(c)) for c in TAIL])
_ASCII_LETTER = W.byte_set((0x41, 0x5A), (0x61, 0x7A))
_SMALL_LETTER = W.byte_set((0x61, 0x7A))


def _letters(data: np.ndarray) -> np.ndarray:
    """Marks the bytes of letters that neither composing nor lower-casing changes into several: ASCII and Latin-1 ones."""
    second = np.zeros(len(data), dtype=bool)
    second[1:] = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)  # no multiplication or division sign
    first = np.zeros(len(data), dtype=bool)
    first[:-1] = second[1:]
    return _ASCII_LETTER[data] | first | second


def parts_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks what is no white space, and where the punctuation at the end of a chunk begins.

    Only after a plain letter: the tokenizer composes (NFC) and lower-cases before it looks
    for words, and some letters end in a combining mark then, which stays with punctuation.
    """
    inside, tail = W.SPACED[data], _TAIL[data]
    opens, closes, cuts = tail.copy(), tail.copy(), np.zeros(len(data), dtype=bool)
    opens[1:] &= ~tail[:-1]
    closes[:-1] &= ~inside[1:]
    # The run of punctuation that a chunk closes with: the last one opened before.
    runs = np.flatnonzero(opens)
    at = runs[np.searchsorted(runs, np.flatnonzero(closes), side="right") - 1]
    at = at[at > 0]
    two = data[np.stack([np.maximum(at - 2, 0), at - 1], axis=1).ravel()]  # the bytes before
    cuts[at] = _letters(two)[1::2]
    return inside, cuts


def _bare(tokenizer):
    """The tokenizer's model alone, for words of a to z between spaces; None if its other steps change or join such words."""
    from tokenizers import Tokenizer, pre_tokenizers

    letters = "".join(map(chr, range(0x61, 0x7B)))
    words = [letters, letters[::-1], *letters]
    text = " ".join(words)
    if tokenizer.normalizer and tokenizer.normalizer.normalize_str(text) != text:
        return None
    if any(not set(t.content) - set(text) for t in tokenizer.get_added_tokens_decoder().values()):
        return None
    if not tokenizer.pre_tokenizer or [x for x, _ in tokenizer.pre_tokenizer.pre_tokenize_str(text)] != words:
        return None
    bare = Tokenizer(tokenizer.model)
    bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    return bare


def _grown(values: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """``more`` behind the first ``used`` values, in place while there is room."""
    if used + len(more) > len(values):
        values = np.concatenate([values[:used], np.empty(used + 2 * len(more), values.dtype)])
    values[used : used + len(more)] = more
    return values


class Chunks:
    """The parts of chunks seen so far, by hash, and the ids of all of them, one after the other.

    The tokenizer never joins across white space, so a text's ids are those of its chunks.
    Nor does it join a letter with punctuation, so a chunk's tail is encoded apart; and each
    word ends with an id that only ends words, so the ids of many words encoded as one text
    can be told apart. Texts that may hold a special token are not lower-cased first.
    """

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        vocabulary = tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.bare = _bare(tokenizer)
        # Hashes in order and numbers of their parts: of most parts, and of those not yet merged with them.
        self.known, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.recent, self.recent_number = self.known, self.number
        # By part; room for more is kept at the end.
        self.first, self.length, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.parts = self.held = 0  # how many parts and ids
        # The part that came first of all whose hashes begin alike: found without a search.
        self.early, self.early_number = np.zeros(1 << EARLY_BITS, np.uint64), np.full(1 << EARLY_BITS, -1, np.int32)

    def __len__(self) -> int:
        return self.parts

    @classmethod
    def of(cls, path: str) -> "Chunks":
        """Those of this process for a tokenizer's file, kept for the worker's next tasks; begun anew when many.

        Spark sends a task's function with copies of the variables it names, so a task has to
        ask the module for them.
        """
        if path not in _SEEN or len(_SEEN[path]) > REMEMBERED:
            from tokenizers import Tokenizer

            _SEEN[path] = cls(_SEEN[path].tokenizer if path in _SEEN else Tokenizer.from_file(path))
        return _SEEN[path]

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the parts with these hashes, -1 for those not seen."""
        found = np.full(len(hashes), -1, np.int32)
        for known, number in ((self.known, self.number), (self.recent, self.recent_number)):
            if len(known):
                at = np.searchsorted(known, hashes).clip(max=len(known) - 1)
                found = np.where(known[at] == hashes, number[at], found)
        return found

    def _learn(self, hashes: np.ndarray, words: W.Words, which: np.ndarray) -> np.ndarray:
        """Encodes new parts, and returns their numbers: words of letters many at a time, all else one by one."""
        start, length = words.start[which], words.end[which] - words.start[which]
        # All parts one after the other, with a space behind each.
        ends = np.cumsum(length + 1)
        text = np.full(int(ends[-1]), 0x20, np.uint8)
        text[W.spans(ends - length - 1, length)] = words.data[W.spans(start, length)]
        plain = np.add.reduceat(_letters(text), ends - length - 1) == length
        small = np.add.reduceat(_SMALL_LETTER[text], ends - length - 1, dtype=np.int64) == length if self.bare else np.zeros(len(which), dtype=bool)
        counts, found, alone = np.zeros(len(which), np.int64), [], list(np.flatnonzero(~plain))
        order = []
        raw = text.tobytes()
        for tokenizer, many in ((self.bare, np.flatnonzero(small)), (self.tokenizer, np.flatnonzero(plain & ~small))):
            rows = [many[at : at + AT_ONCE] for at in range(0, len(many), AT_ONCE)]
            texts = [b"".join([raw[ends[i] - length[i] - 1 : ends[i]] for i in row.tolist()]).decode() for row in rows]
            for row, encoded in zip(rows, tokenizer.encode_batch_fast(texts, add_special_tokens=False) if rows else [], strict=True):
                ids = np.array(encoded.ids, np.int32)
                stops = np.flatnonzero(self.ends[ids])
                if len(stops) != len(row) or stops[-1] != len(ids) - 1:  # not one word each
                    alone += row.tolist()
                    continue
                counts[row] = np.diff(stops, prepend=-1)
                order.append(row)
                found.append(ids)
        texts = [raw[ends[i] - length[i] - 1 : ends[i] - 1].decode("utf-8", "replace") for i in alone]
        for i, encoded in zip(alone, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            counts[i] = len(encoded.ids)
            order.append([i])
            found.append(np.array(encoded.ids, np.int32))
        order, found = np.concatenate(order), np.concatenate(found)
        number = np.empty(len(which), np.int32)
        number[order] = self.parts + np.arange(len(which))
        self.first = _grown(self.first, self.parts, self.held + np.cumsum(counts[order]) - counts[order])
        self.length = _grown(self.length, self.parts, counts[order])
        self.ids = _grown(self.ids, self.held, found)
        self.parts, self.held = self.parts + len(which), self.held + len(found)
        place = np.searchsorted(self.recent, hashes)
        self.recent, self.recent_number = np.insert(self.recent, place, hashes), np.insert(self.recent_number, place, number)
        if len(self.recent) > RECENT:
            place = np.searchsorted(self.known, self.recent)
            self.known, self.number = np.insert(self.known, place, self.recent), np.insert(self.number, place, self.recent_number)
            self.recent, self.recent_number = self.recent[:0], self.recent_number[:0]
        at = hashes >> _EARLY_SHIFT
        free = self.early_number[at] < 0
        self.early[at[free]], self.early_number[at[free]] = hashes[free], number[free]
        return number

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts that ``offsets`` cuts ``data`` into, and how many each has."""
        special = b"<|" in data[offsets[0] : offsets[-1]].tobytes()
        words = W.split(data, offsets, parts_of, lower=not special)
        if not len(words.hash):
            return np.zeros(0, np.int32), np.zeros(words.texts, np.int64)
        at = words.hash >> _EARLY_SHIFT
        part = self.early_number[at]
        rest = np.flatnonzero((part < 0) | (self.early[at] != words.hash))
        if len(rest):
            distinct, first, place = np.unique(words.hash[rest], return_index=True, return_inverse=True)
            found = self._find(distinct)
            new = np.flatnonzero(found < 0)
            if len(new):
                found[new] = self._learn(distinct[new], words, rest[first[new]])
            part[rest] = found[place]
        length = self.length[part]
        ends = np.concatenate([[0], np.cumsum(length)])[words.first()[1:]]
        return self.ids[W.spans(self.first[part], length)], np.diff(ends, prepend=0)


def encode(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """doc_id and ids of every whole text, the end id last. A null text is empty.

    ``tokenizer_path``: a file of the tokenizers library that every executor can open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        for batch in batches:
            column = batch.column(1).cast(pa.large_binary()).fill_null(b"")
            data, offsets = W.column_bytes(column)
            at = 0
            while at < len(column):
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + W.PIECE_BYTES, side="right")) - 1)
                ids, counts = Chunks.of(tokenizer_path).encode(data, offsets[at : to + 1])
                places = np.cumsum(counts)
                ids = np.insert(ids, places, end_id).astype(np.int32)
                edges = np.concatenate([[0], places + np.arange(1, to - at + 1)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.ListArray.from_arrays(pa.array(edges), pa.array(ids))], names=["doc_id", "ids"])
                at = to

    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def write_ids(docs: DataFrame, tokenizer_path: str, folder: str | None = None, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> str:
    """Encodes and writes the documents in ascending order of their id; returns the folder.

    Texts are dealt to tasks by ranges of the id and the text's hash and sorted there, so
    file k holds no larger ids than file k + 1, and one id that many rows have is dealt to
    many files. Null ids come first. The writer's commit names files only when their task
    has ended well.
    """
    folder = folder or shared_folder(docs.sparkSession, "token-ids")
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    encode(rows, tokenizer_path, "doc_id", "text", end_id).write.format("orc").options(**ORC_OPTIONS).save(folder)
    return folder


def read_ids(spark: SparkSession, folder: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Documents of an id range; files, stripes and row groups beyond it are not read."""
    rows = spark.read.orc(folder)
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    return rows if last is None else rows.where(F.col("doc_id") <= last)


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(2)
        edges, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False).astype("<u4")
        raw = memoryview(values.tobytes())
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(edges), pa.int64()), pa.array(crc, pa.int64())], names=["file", "doc_id", "n_tokens", "ids_crc32"])


def index(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of the written files.

    Running sums are taken file by file; files follow each other by the number that their
    writer gave them, which is that of their range.
    """
    rows = spark.read.orc(folder).select(F.col("_metadata.file_path").alias("file"), "doc_id", "ids")
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = keep(rows.mapInArrow(_crc, f"file string, doc_id {kind}, n_tokens long, ids_crc32 long"), "token-index")
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    part = F.regexp_extract("file", r"part-(\d+)-[^/]*$", 1).cast("long")
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    own = Window.partitionBy("file").orderBy(F.col("doc_id").asc_nulls_first(), "n_tokens", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n_tokens").over(own), F.lit(0))
    return rows.withColumn("_own", before).join(files, "file").select("doc_id", (F.col("base") + F.col("_own")).alias("start"), "n_tokens", "ids_crc32")
