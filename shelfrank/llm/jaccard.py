"""Documents whose word-shingle sets are alike, exactly, and the groups they form.

1. Routing. Two sets that link differ in few shingles, D at most for their sizes. Dealt over
   parts by hash, each differing shingle changes one part, so of any D + 1 parts one is the
   same in both. Every set sends a key for each of its first D + 1 parts that aren't empty; a
   small set, or one with too few such parts, its first shingles in a common order, of which
   linked sets share one. Shingles that many documents of a sample hold come last in that
   order and are left out of the parts; this changes which keys meet, never the result.
2. Sets are told by a hash of the whole set, so equal sets are one from here on. Sets of a key
   meet with their parity sketches: bits that differ in two sketches are at most the shingles
   that differ. Only pairs within D hang together in candidate groups, so unlike documents
   that share a passage don't. Keys with the same sets meet once.
3. Within each group, signature trees find the links (see signature_tree). A large group is
   cut into blocks, and pairs of blocks are traversed as separate tasks.
4. Links are joined to components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfrank.llm import signature_tree as S
from shelfrank.llm import words as W
from shelfrank.llm.components import components
from shelfrank.llm.lang_id import fit_sample
from shelfrank.llm.storage import keep, pruned_joins

#: Sets below this size are routed by single shingles; sizes of a class differ by less than STEP.
SMALL, STEP = 100, 1.5
#: Documents sampled for frequent shingles, how many of them make one frequent, and how many are held.
SAMPLE, FREQUENT, MOST_FREQUENT = 12_000, 5, 200_000
#: Parts beyond those that linked sets of a class may differ in, so that empty ones can be passed over.
SPARE_PARTS = 1.25
#: Bits of the smallest and the longest parity sketch; between them a sketch has a bit for each shingle.
LEAST_BITS, MOST_BITS = 64, 1 << 16
#: Sets of a key that meet in one task, and those up to which all their pairs are compared at once.
KEY_SETS, FEW = 4096, 24
#: Rows of keys that a task packs at a time, and the least number of blocks that keys are dealt into.
PACK, LEAST_BLOCKS = 1 << 20, 1024
#: Sets and shingles of a block of a large group.
BLOCK_SETS, BLOCK_SHINGLES = 1024, 1 << 21

_HOT = np.uint64(1 << 63)


def shingle_sets(found: W.Words, size: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text in the common order, one text after the other; how many each has.

    A text of fewer words has its whole sequence as its one shingle; one without words none.
    The order is by hash, frequent ones last.
    """
    value, place = W.shingles(found, size)
    text = found.text[place]
    counts, first = found.counts(), found.first()[:-1]
    for n in range(1, size):
        short = np.flatnonzero(counts == n)
        value, text = np.concatenate([value, W.run_hash(found.hash, first[short], n)]), np.concatenate([text, short])
    value = value >> np.uint64(1)
    if len(frequent):
        at = np.searchsorted(frequent, value)
        at[at == len(frequent)] = 0
        value = np.where(frequent[at] == value, value | _HOT, value)
    by = np.lexsort((value, text))
    value, text = value[by], text[by]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    return value[new], np.bincount(text[new], minlength=found.texts)


def _marks(value: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each whole set."""
    owner, value, out = np.repeat(np.arange(len(sizes)), sizes), value & ~_HOT, []
    for salt in (1, 2):
        sums = np.zeros(len(sizes), np.uint64)
        np.add.at(sums, owner, W.mix(value + np.uint64(salt)))
        out.append(sums.view(np.int64))
    return out[0], out[1]


class Router:
    """Keys of shingle sets for one threshold."""

    def __init__(self, percent: int):
        self.percent = percent
        bounds, step = [SMALL], max(STEP, 100 / percent)  # a linked set is of the same class or the next
        while bounds[-1] < 1 << 40:
            bounds.append(int(bounds[-1] * step) + 1)
        self.bounds = np.array(bounds, np.int64)
        self.parts = (SPARE_PARTS * self.differ(self.bounds[1:] - 1)).astype(np.int64) + 3

    def differ(self, n: np.ndarray) -> np.ndarray:
        """Shingles in which a set of ``n`` and a linked one that isn't smaller differ at most."""
        return (100 - self.percent) * n // self.percent

    def keys(self, value: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys, and the number of the set that each comes from."""
        first = np.cumsum(sizes) - sizes
        keys, owners = [], []
        spare = sizes - -(-self.percent * sizes // 100) + 1  # of so many first shingles linked sets share one
        short = (sizes > 0) & (-(-self.percent * sizes // 100) < SMALL)
        level = np.searchsorted(self.bounds, sizes, side="right") - 1
        for up in (0, 1):
            own = np.flatnonzero(sizes >= SMALL)
            if up:
                own = own[100 * sizes[own] // self.percent >= self.bounds[level[own] + 1]]
            if not len(own):
                continue
            many = self.parts[level[own] + up]
            base = np.cumsum(many) - many
            at, which = W.spans(first[own], sizes[own]), np.repeat(np.arange(len(own)), sizes[own])
            v = value[at]
            part = (v % many.astype(np.uint64)[which]).astype(np.int64)
            slot = (base[which] + part)[v < _HOT]
            sums = np.zeros(int(many.sum()), np.uint64)
            np.add.at(sums, slot, W.mix(v[v < _HOT]))
            filled = np.bincount(slot, minlength=len(sums)) > 0
            owner, need = np.repeat(np.arange(len(own)), many), self.differ(sizes[own]) + 1
            before = np.cumsum(filled) - filled  # filled parts before this one, of this set:
            before -= before[base][owner]
            salt = (level[own][owner] + up).astype(np.uint64) << np.uint64(40) | (np.arange(len(sums)) - base[owner]).astype(np.uint64)
            sent = filled & (before < need[owner])
            keys.append(W.mix(sums ^ W.mix(salt + np.uint64(7)))[sent])
            owners.append(own[owner[sent]])
            # Of two sets with too few filled parts, the part that they share may be empty in both.
            short[own[np.bincount(owner[sent], minlength=len(own)) < need]] = True
        own = np.flatnonzero(short)
        at = W.spans(first[own], spare[own])
        keys.append(W.mix(value[at] ^ np.uint64(0xA5A5A5A5A5A5A5A5)))
        owners.append(np.repeat(own, spare[own]))
        return np.concatenate(keys), np.concatenate(owners)


def sketches(value: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity sketches, one after the other, and the 64-bit words of each: bit x tells whether an odd number of shingles fall on it."""
    bits = np.clip(1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64), LEAST_BITS, MOST_BITS)
    first = np.cumsum(bits) - bits
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = (W.mix((value & ~_HOT) + np.uint64(11)) & (bits - 1).astype(np.uint64)[owner]).astype(np.int64)
    odd = np.zeros(int(bits.sum()), np.uint8)
    np.bitwise_xor.at(odd, first[owner] + place, np.uint8(1))
    return np.packbits(odd, bitorder="little").view(np.uint64), bits // 64


class Meeting:
    """Sets with sizes and sketches, of which pairs are asked whether they may link."""

    def __init__(self, size: np.ndarray, sketch: np.ndarray, words: np.ndarray, percent: int):
        self.size, self.sketch, self.words, self.percent = size, sketch, words, percent
        self.first = np.cumsum(words) - words

    def _cut(self, own: np.ndarray, words: int) -> np.ndarray:
        """Sketches of some sets, folded to the given length: the low bits of a place are its place in a shorter sketch."""
        out = np.empty((len(own), words), np.uint64)
        for length in np.unique(self.words[own]).tolist():
            these = np.flatnonzero(self.words[own] == length)
            long = self.sketch[self.first[own[these]][:, None] + np.arange(length)]
            out[these] = np.bitwise_xor.reduce(long.reshape(len(these), length // words, words), axis=1)
        return out

    def may(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Whether two sets of each pair differ in few enough bits, and in size."""
        total = self.size[one] + self.size[two]
        fits = 100 * np.minimum(self.size[one], self.size[two]) >= self.percent * np.maximum(self.size[one], self.size[two])
        words = np.minimum(self.words[one], self.words[two])
        for length in np.unique(words[fits]).tolist():
            these = np.flatnonzero(fits & (words == length))
            for at in range(0, len(these), max(1, (1 << 20) // length)):
                pair = these[at : at + max(1, (1 << 20) // length)]
                apart = np.bitwise_count(self._cut(one[pair], length) ^ self._cut(two[pair], length)).sum(axis=1, dtype=np.int64)
                fits[pair] = (100 + self.percent) * apart <= (100 - self.percent) * total[pair]
        return fits

    def ties(self, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that tie together whatever pairs that may link tie together, within each run of sets."""
        one, two = [], []
        for m in range(2, FEW + 1):
            runs = start[length == m]
            i, j = np.triu_indices(m, 1)
            for at in range(0, len(runs), 4096):
                a, b = ((runs[at : at + 4096, None] + k).ravel() for k in (i, j))
                good = self.may(a, b)
                one.append(a[good])
                two.append(b[good])
        for first, m in zip(start[length > FEW].tolist(), length[length > FEW].tolist(), strict=True):
            label = np.arange(m)
            for pivot in range(m):
                other = np.flatnonzero(label != label[pivot])
                if not len(other):
                    break
                other = other[self.may(np.full(len(other), first + pivot), first + other)]
                if len(other):
                    groups, at = np.unique(label[other], return_index=True)
                    one.append(np.full(len(groups), first + pivot))
                    two.append(first + other[at])
                    label[np.isin(label, np.append(groups, label[pivot]))] = label[pivot]
        return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in (one, two))


def _distinct(keys: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (key, set) in order."""
    by = np.lexsort((marks, keys))
    keys, marks = keys[by], marks[by]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = (keys[1:] != keys[:-1]) | (marks[1:] != marks[:-1])
    return keys[new], marks[new]


def _pack(keys: np.ndarray, marks: np.ndarray) -> bytes:
    """Sorted keys as differences, and sets, byte plane by byte plane, which compresses well."""
    planes = [np.diff(keys, prepend=np.uint64(0)), marks]
    return b"".join(np.ascontiguousarray(np.ascontiguousarray(p).view(np.uint8).reshape(-1, 8).T).tobytes() for p in planes)


def _unpack(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(block) // 16
    planes = np.frombuffer(block, np.uint8).reshape(2, 8, n)
    keys, marks = (np.ascontiguousarray(p.T).view(np.uint64).ravel() for p in planes)
    return np.cumsum(keys, dtype=np.uint64), marks.view(np.int64)


def frequent_shingles(docs: DataFrame, size: int) -> np.ndarray:
    """Shingles of at least FREQUENT documents of a sample, in order."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, found in W.pieces(batch.column(0)):
                value, _ = shingle_sets(found, size, np.zeros(0, np.uint64))
                value, n = np.unique(value, return_counts=True)
                yield pa.record_batch([pa.array(value.view(np.int64)), pa.array(n)], names=["value", "n"])

    sample = fit_sample(docs, "doc_id", SAMPLE).select("text").mapInArrow(count, "value long, n long")
    often = sample.groupBy("value").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "value").limit(MOST_FREQUENT)
    return np.sort(often.toPandas()["value"].to_numpy(np.int64).view(np.uint64))


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, two marks and the parity sketch of every row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, found in W.pieces(batch.column(1)):
                value, sizes = shingle_sets(found, size, np.zeros(0, np.uint64))
                bits, words = sketches(value, sizes)
                ends = np.append(0, np.cumsum(words * 8)).astype(np.int64)
                sketch = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(bits)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), *[pa.array(x, pa.int64()) for x in (sizes, *_marks(value, sizes))], sketch], names=["doc_id", "n_shingles", "mark", "mark2", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, mark long, mark2 long, sketch binary")


def _route(docs: DataFrame, size: int, percent: int, blocks: int) -> DataFrame:
    """One pass over the texts: packed (key, mark of the set) by range of key."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, size))
    shift = np.uint64(64 - (blocks - 1).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router, held, rows = Router(percent), [], 0

        def flush():
            keys, marks = _distinct(np.concatenate([k for k, _ in held]), np.concatenate([m for _, m in held]))
            block, start = np.unique((keys >> shift).astype(np.int64), return_index=True)
            ends = np.append(start[1:], len(keys))
            for at in range(0, len(block), 256):
                part = [_pack(keys[a:b], marks[a:b]) for a, b in zip(start[at : at + 256], ends[at : at + 256], strict=True)]
                yield pa.record_batch([pa.array(block[at : at + 256]), pa.array(part, pa.binary())], names=["at", "block"])

        for batch in batches:
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            for at, to, found in W.pieces(batch.column(1)):
                value, sizes = shingle_sets(found, size, shared.value)
                key, owner = router.keys(value, sizes)
                good = known[at:to][owner]
                held.append((key[good], _marks(value, sizes)[0][owner[good]]))
                rows += len(key)
                if rows >= PACK:
                    yield from flush()
                    held, rows = [], 0
        if held:
            yield from flush()

    return docs.select("doc_id", "text").mapInArrow(run, "at long, block binary")


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(meeting, mark): the sets of every key that has several; keys with the same sets are one meeting.

    Rows (at, block) come sorted by the former. A key of many sets becomes meetings of every
    two blocks of its sets.
    """

    def found(held: list[bytes]) -> Iterator[pa.RecordBatch]:
        keys, marks = _distinct(*(np.concatenate(x) for x in zip(*map(_unpack, held), strict=True)))
        start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        length = np.diff(np.append(start, len(keys)))
        meeting = np.add.reduceat(W.mix(marks.view(np.uint64) + np.uint64(5)), start)
        _, once = np.unique(meeting, return_index=True)
        once = once[length[once] > 1]
        few = once[length[once] <= KEY_SETS]
        yield rows(np.repeat(meeting[few], length[few]), marks[W.spans(start[few], length[few])])
        for k in once[length[once] > KEY_SETS].tolist():
            cuts = np.array_split(marks[start[k] : start[k] + length[k]], -(-2 * length[k] // KEY_SETS))
            for i in range(len(cuts)):
                for j in range(i + 1, len(cuts)):
                    name = W.mix(meeting[k : k + 1] + np.uint64(i << 32 | j))
                    yield rows(np.repeat(name, len(cuts[i]) + len(cuts[j])), np.concatenate([cuts[i], cuts[j]]))

    def rows(meeting: np.ndarray, marks: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(meeting.view(np.int64)), pa.array(marks, pa.int64())], names=["meeting", "mark"])

    now, held = -1, []
    for batch in batches:
        for at, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if at != now and held:
                yield from found(held)
                held = []
            now = at
            held.append(block)
    if held:
        yield from found(held)


def _ties(percent: int):
    """(u, v), marks of sets that may link, of rows (meeting, mark, n_shingles, sketch) sorted by meeting."""

    def tied(table: pa.Table) -> pa.RecordBatch:
        meeting, mark, size = (table.column(k).to_numpy() for k in range(3))
        data, offsets = W.column_bytes(table.column(3))
        sketch = np.frombuffer(data[offsets[0] : offsets[-1]].tobytes(), np.uint64)
        start = np.flatnonzero(np.concatenate([[True], meeting[1:] != meeting[:-1]]))
        u, v = Meeting(size, sketch, np.diff(offsets) // 8, percent).ties(start, np.diff(np.append(start, len(meeting))))
        pairs = np.unique(np.stack([np.minimum(mark[u], mark[v]), np.maximum(mark[u], mark[v])], axis=1), axis=0)
        return pa.record_batch([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            meeting = held.column(0).to_numpy()
            whole = int(np.searchsorted(meeting, meeting[-1])) if len(meeting) else 0  # the last one may go on
            if whole:
                yield tied(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None and len(held):
            yield tied(held)

    return run


def _traverse(size: int, percent: int):
    """Links within each run of rows with equal (group, one, two); rows are sorted by them."""

    def links(rows: list[tuple]) -> pa.RecordBatch:
        _, one, two, *_ = rows[0]
        parts = []
        for _, _, found in W.pieces(pa.array([r[-1] for r in rows], pa.large_binary())):
            value, n = shingle_sets(found, size, np.zeros(0, np.uint64))
            parts.append((value, n, _marks(value, n)[0]))
        value, n, mark = (np.concatenate([p[k] for p in parts]) for k in range(3))
        block, ids, asked = (np.array([r[k] for r in rows], np.int64) for k in (3, 4, 5))
        # A repeated id may bring texts that were not asked for, or one twice.
        _, once = np.unique(np.stack([ids, mark], axis=1), axis=0, return_index=True)
        own = once[mark[once] == asked[once]]
        own = own[np.argsort(block[own], kind="stable")]
        value, n, ids, split = value[W.spans((np.cumsum(n) - n)[own], n[own])], n[own], ids[own], None
        if one != two:
            split = int((block[own] == one).sum())
        found = S.links(S.Sets(value, n), percent, split) if len(own) > 1 and split not in (0, len(own)) else []
        u, v = ids[[a for a, _ in found]], ids[[b for _, b in found]]
        return pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[:3] != now and held:
                    yield links(held)
                    held = []
                now = row[:3]
                held.append(row)
        if held:
            yield links(held)

    return run


def link(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(sets, links): n_shingles and set id of every row, and links between different sets.

    ``sets``: doc_id, n_shingles, set_id (smallest document id with this very set); ``links``:
    u, v, pairs of set ids that tie together whatever links tie together. See ``groups``.
    """
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    blocks = 1 << (max(LEAST_BLOCKS, docs.count() // 500) - 1).bit_length()
    rows = keep(_sets(docs, size), "shingle-marks")
    sets = rows.drop("sketch")
    same = ["n_shingles", "mark", "mark2"]
    distinct = rows.where("n_shingles > 0 and doc_id is not null").groupBy(*same).agg(F.min("doc_id").alias("set_id"), F.first("sketch").alias("sketch"))
    distinct = keep(distinct, "shingle-sets")
    met = _route(docs, size, percent, blocks).repartition("at").sortWithinPartitions("at").mapInArrow(_meet, "meeting long, mark long").distinct()
    met = met.join(distinct.select("mark", "n_shingles", "sketch"), "mark").select("meeting", "mark", "n_shingles", "sketch")
    group = components(met.repartition("meeting").sortWithinPartitions("meeting").mapInArrow(_ties(percent), "u long, v long"))
    grouped = distinct.select(*same, "set_id").join(group, distinct["mark"] == group["vertex"]).withColumnRenamed("component", "group")
    sizes = grouped.groupBy("group").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("n")).where("m > 1")
    blocked = sizes.select("group", F.greatest(F.ceil(F.col("m") / BLOCK_SETS), F.ceil(F.col("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    asked = grouped.join(blocked, "group").withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    asked = keep(asked.select("group", "blocks", "block", F.col("set_id").alias("doc_id"), "mark"), "shingle-groups")
    rows = docs.join(asked.where("blocks > 0"), "doc_id")
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.least(b, F.col("block")).alias("one"), F.greatest(b, F.col("block")).alias("two")))
    rows = rows.select("group", "block", "doc_id", "mark", "text", F.explode(meets).alias("p")).withColumn("slot", F.xxhash64("group", "p.one", "p.two"))
    rows = rows.repartitionByRange("slot").sortWithinPartitions("slot", "group", "p.one", "p.two", "doc_id")
    rows = rows.select("group", "p.one", "p.two", "block", "doc_id", "mark", "text")
    with pruned_joins(docs.sparkSession):
        found = keep(rows.mapInArrow(_traverse(size, percent), "u long, v long"), "links")
    return sets.join(distinct.select(*same, "set_id"), same, "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("set_id", "doc_id")).alias("set_id")), found


def groups(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links, itself included) of every row.

    Documents link when 100 * common >= percent * united, over distinct shingles of ``size``
    words between white space, A to Z lower-cased. Null, empty and wordless texts have no
    shingles and link with nothing. A row without an id links with nothing and has no
    component. Rows that repeat an id are one document: all get its smallest component.
    """
    sets, found = link(docs, size, percent, key, text)
    several = sets.where("doc_id is not null").groupBy("doc_id").agg(F.min("set_id").alias("u"), F.max("set_id").alias("last")).where("u < last")
    joined = components(found.union(sets.join(several, "doc_id").select("u", F.col("set_id").alias("v"))))
    named = sets.join(joined, sets["set_id"] == joined["vertex"], "left")
    return named.select("doc_id", "n_shingles", F.coalesce("component", "set_id").alias("component_id"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The row with the smallest id of each group, as it was.

    Groups are of texts, by their hashes, whatever ids they have: unlike texts under one id
    stay, each in its own group. Of rows equal in id and text one stays. Rows without
    shingles or without an id stay.
    """
    from pyspark.sql import Window

    own, head, least, place = (next(n for n in (f"{name}{i}" for i in range(len(docs.columns) + 1)) if n not in docs.columns) for name in ("own", "head", "least", "place"))
    part = F.col(key).isNotNull() & F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.where(part).withColumn(own, F.xxhash64(text))
    named = groups(rows.select(F.col(own).alias("doc_id"), F.col(text).alias("text")), size, percent).select(F.col("doc_id").alias(own), "component_id").distinct()
    first = F.min(F.struct(F.col(key).alias("id"), F.col(own).alias("text")))
    heads = rows.select(F.col(key), own).distinct().join(named, own).groupBy("component_id").agg(first.alias("first")).select(F.col("first.text").alias(head), F.col("first.id").alias(least))
    found = rows.join(heads, (F.col(own) == F.col(head)) & (F.col(key) == F.col(least))).drop(head, least)
    order = Window.partitionBy(own, key).orderBy(own)
    single = found.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).drop(place, own)
    return single.union(docs.where(~part))
