"""Benchmark items found in documents: a prefix-filtered containment join.

An item is cut into windows of ten words (a shorter item is one window). A document holds
a window only if it holds every shingle of it, so one shingle is prefix enough: the rarest,
by counts over all documents. Documents are joined with the windows on that shingle; the
shingle's place in the window gives the only place where the window can start, the
document's length bounds it, and the words there are compared one by one.

Windows are held by every task, in blocks of at most BLOCK_BYTES of item text; a larger
benchmark takes one pass over the documents for each block, written before the next block
is read, with the same results: every document row has a stored number by which they meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfrank.llm import words as W
from shelfrank.llm.storage import keep, keep_rows

WINDOW, SHINGLE = 10, 3
#: Item text whose windows one pass holds; about 20 times that in memory.
BLOCK_BYTES = 8 << 20
_GATE = np.uint64((1 << 20) - 1)


class Windows:
    """Distinct windows of some items, by length, with their prefix shingles."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW, shingle: int = SHINGLE):
        found = W.split(*W.column_bytes(pa.array([t for _, t in items], pa.large_binary())), W.ALNUM)
        first, counts = found.first(), found.counts()
        self.ids = np.array([i for i, _ in items], dtype=object)
        self.shingle = shingle
        self.groups = []
        for size in sorted({min(int(n), window) for n in counts if n}):
            own = np.flatnonzero(np.minimum(counts, window) == size)
            many = counts[own] - size + 1
            at, item = W.spans(first[own], many), np.repeat(own, many)
            content = found.hash[at[:, None] + np.arange(size)]
            content, which = np.unique(content, axis=0, return_inverse=True)
            pairs = np.unique(np.stack([which.ravel(), item], axis=1), axis=0)
            self.groups.append({"size": size, "words": content, "items": pairs[:, 1], "item_from": np.searchsorted(pairs[:, 0], np.arange(len(content) + 1))})
        for g in self.groups:
            g["k"] = min(shingle, g["size"])
            flat = g["words"].ravel()
            at = np.arange(len(g["words"]))[:, None] * g["size"] + np.arange(g["size"] - g["k"] + 1)
            g["shingles"] = W.run_hash(flat, at.ravel(), g["k"]).reshape(at.shape)

    def all_shingles(self) -> dict[int, np.ndarray]:
        by: dict[int, list] = {}
        for g in self.groups:
            by.setdefault(g["k"], []).append(g["shingles"].ravel())
        return {k: np.unique(np.concatenate(v)) for k, v in by.items()}

    def order(self, counts: dict[int, int]) -> None:
        """Chooses each window's rarest shingle; ties go to the smaller hash."""
        for g in self.groups:
            known, which = np.unique(g["shingles"], return_inverse=True)
            often = np.array([counts.get(int(s), 0) for s in known.view(np.int64)])
            rank = np.empty(len(known), np.int64)
            rank[np.lexsort((known, often))] = np.arange(len(known))
            place = rank[which.reshape(g["shingles"].shape)].argmin(axis=1)
            prefix = g["shingles"][np.arange(len(place)), place]
            by = np.argsort(prefix, kind="stable")
            g["prefix"], start = np.unique(prefix[by], return_index=True)
            g["from"], g["by"], g["place"] = np.append(start, len(by)), by, place
            g["gate"] = _gate(g["prefix"])


def _gate(values: np.ndarray) -> np.ndarray:
    gate = np.zeros(int(_GATE) + 1, dtype=bool)
    gate[values & _GATE] = True
    return gate


def _lookup(known: np.ndarray, gate: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the values that are known, and their numbers there."""
    maybe = np.flatnonzero(gate[values & _GATE])
    at = np.searchsorted(known, values[maybe])
    at[at == len(known)] = 0
    same = known[at] == values[maybe]
    return maybe[same], at[same]


def count_shingles(docs: DataFrame, text: str, known: dict[int, np.ndarray]) -> dict[int, int]:
    """How often all documents together hold each of the shingles; as many numbers as shingles."""
    gates = {k: _gate(v) for k, v in known.items()}
    shared = docs.sparkSession.sparkContext.broadcast((known, gates))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, gates = shared.value
        sums = {k: np.zeros(len(v), np.int64) for k, v in known.items()}
        for batch in batches:
            for _, _, found in W.pieces(batch.column(0), W.ALNUM):
                for k in known:
                    _, at = _lookup(known[k], gates[k], W.shingles(found, k)[0])
                    sums[k] += np.bincount(at, minlength=len(known[k]))
        for k, n in sums.items():
            there = np.flatnonzero(n)
            yield pa.record_batch([pa.array(known[k][there].view(np.int64)), pa.array(n[there])], names=["shingle", "n"])

    rows = docs.select(F.col(text).cast("binary").alias("text")).mapInArrow(count, "shingle long, n long")
    return {r.shingle: r.n for r in rows.groupBy("shingle").agg(F.sum("n").alias("n")).toLocalIterator()}


def _find(found: W.Words, windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word whether a window covers it; and (text, item) pairs of windows that occur."""
    first = found.first()
    cover = np.zeros(len(found.hash) + 1, np.int32)
    texts, items = [], []
    for g in windows.groups:
        value, place = W.shingles(found, g["k"])
        hit, at = _lookup(g["prefix"], g["gate"], value)
        many = g["from"][at + 1] - g["from"][at]
        window = g["by"][W.spans(g["from"][at], many)]
        start = np.repeat(place[hit], many) - g["place"][window]
        text = found.text[np.repeat(place[hit], many)]
        fits = (start >= first[text]) & (start + g["size"] <= first[text + 1])
        window, start, text = window[fits], start[fits], text[fits]
        same = np.ones(len(start), dtype=bool)
        for i in range(g["size"]):
            same &= found.hash[start + i] == g["words"][window, i]
        window, start, text = window[same], start[same], text[same]
        np.add.at(cover, start, 1)
        np.add.at(cover, start + g["size"], -1)
        many = g["item_from"][window + 1] - g["item_from"][window]
        items.append(g["items"][W.spans(g["item_from"][window], many)])
        texts.append(np.repeat(text, many))
    return np.cumsum(cover[:-1]) > 0, np.concatenate(texts or [np.zeros(0, int)]), np.concatenate(items or [np.zeros(0, int)])


OUT = "n_words long, runs array<struct<first:int,last:int>>, items array<string>"


def _search(docs: DataFrame, text: str, windows: Windows) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(windows)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != text) + ", " + OUT

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        for batch in batches:
            column = batch.schema.get_field_index(text)
            others = [i for i in range(batch.num_columns) if i != column]
            counts, runs, items = [], [], []
            for _, _, found in W.pieces(batch.column(column), W.ALNUM):
                covered, texts, hit_items = _find(found, windows)
                counts.append(found.counts())
                own, had = [[] for _ in range(found.texts)], [set() for _ in range(found.texts)]
                edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
                first = found.first()
                for a, b in edges.reshape(-1, 2):  # a run may go on into the next text
                    while a < b:
                        t = found.text[a]
                        end = min(b, first[t + 1])
                        own[t].append({"first": int(a - first[t]), "last": int(end - first[t] - 1)})
                        a = end
                for t, i in set(zip(texts.tolist(), hit_items.tolist(), strict=True)):
                    had[t].add(windows.ids[i])
                runs += own
                items += [sorted(h) for h in had]
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in others], pa.array(n, pa.int64()), pa.array(runs, kind), pa.array(items, pa.list_(pa.string()))],
                names=[*[batch.schema.names[i] for i in others], "n_words", "runs", "items"],
            )

    return docs.mapInArrow(search, schema)


def blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[Windows, bool]]:
    """The benchmark's windows, some items at a time, and whether there are several blocks. Items without an id or a text take no part."""
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).cast("binary").alias("text")).where("item is not null and text is not null")
    size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = size // block_bytes + 1
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else rows
        yield Windows([(r.item, bytes(r.text)) for r in part.collect()]), n > 1


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: key, n_words, runs of hit words (first and last word number), items that occur.

    A null or empty text has no words, no runs and no items. Equal item texts all count.
    Repeated keys keep a row each. Other columns are not read.
    """
    docs = docs.select(F.col(key), F.col(text).cast("binary").alias("_text"))
    rows = None
    for windows, more in blocks(benchmark, block_bytes=block_bytes):
        if more and rows is None:
            docs = keep(docs.withColumn("_row", F.monotonically_increasing_id()), "benchmark-rows")
        windows.order(count_shingles(docs, "_text", windows.all_shingles()))
        found = _search(docs, "_text", windows)
        if not more:
            return found
        found = keep(found, "benchmark-block")
        rows = found if rows is None else rows.unionByName(found)
    words = F.flatten(F.collect_list(F.flatten(F.transform("runs", lambda r: F.sequence(r["first"], r["last"])))))
    merged = rows.groupBy("_row").agg(F.first(key).alias(key), F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(words)).alias("_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # Neighbouring words are one run again, as they are within a block.
    first = F.filter("_hit", lambda w, i: F.coalesce(F.get("_hit", i - 1) < w - 1, F.lit(True)))
    last = F.filter("_hit", lambda w, i: F.coalesce(F.get("_hit", i + 1) > w + 1, F.lit(True)))
    runs = F.zip_with(first, last, lambda a, b: F.struct(a.alias("first"), b.alias("last")))
    return merged.select(key, "n_words", runs.alias("runs"), "items")


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows that hold no window of the benchmark, as they were."""
    for windows, more in blocks(benchmark, block_bytes=block_bytes):
        windows.order(count_shingles(docs, text, windows.all_shingles()))
        shared = docs.sparkSession.sparkContext.broadcast(windows)

        def clean(column: pa.Array, shared=shared) -> np.ndarray:
            out = np.ones(len(column), dtype=bool)
            for at, _, found in W.pieces(column, W.ALNUM):
                covered, _, _ = _find(found, shared.value)
                out[at + found.text[covered]] = False
            return out

        docs = keep_rows(docs, text, clean)
        if more:
            docs = keep(docs, "benchmark-clean")
            shared.unpersist()
    return docs


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and item digest of the rows of ``decontaminate``."""
    hit = F.aggregate("runs", F.lit(0).cast("long"), lambda s, r: s + r["last"] - r["first"] + 1)
    return found.select(
        key, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )
