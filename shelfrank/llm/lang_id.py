"""Language of whole texts: known words first, shorter and shorter character n-grams for others.

A word known from the labelled texts adds its log frequency in each language. An unknown
word adds the mean log frequency of its longest n-grams that are known, counted as one
word. The posterior of the best language is the score.

The model is fitted on at most about FIT_ROWS labelled rows, drawn per language by a hash: a
language with few rows gives all of them, the others share the rest evenly. It holds at most
MAX_WORDS words and MAX_GRAMS n-grams of each length, taken in turns from the languages' most
frequent ones; n-grams are counted over all words of the sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfrank.llm import words as W
from shelfrank.llm.storage import keep, keep_rows

FIT_ROWS, MAX_WORDS, MAX_GRAMS = 24_000, 150_000, 60_000
LONGEST = 5
UNKNOWN = "und"


def fit_sample(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """About ``limit`` of the rows, the same ones in every run, by a hash of the key."""
    n = rows.count()
    if n <= limit:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.lit("fit"), F.col(key)), F.lit(1 << 30)) < int((1 << 30) * limit / n))


def language_shares(rows: dict[str, int], limit: int) -> dict[str, float]:
    """Share of each language's rows to draw: about ``limit`` in all, evenly as far as a language has rows."""
    out, left = {}, limit
    for k, lang in enumerate(sorted(rows, key=lambda x: (rows[x], x))):
        take = min(rows[lang], left / (len(rows) - k))
        out[lang], left = take / rows[lang], left - take
    return out


class Model:
    """Log frequencies by language of words and n-grams, found by their hashes.

    ``grams``: for each length the n-grams, their counts by language, and all counts by language.
    """

    def __init__(self, langs: list[str], prior: np.ndarray, word: np.ndarray, word_counts: np.ndarray, grams: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.langs, self.prior = langs, prior
        by = np.argsort(word)
        self.word, self.word_value = word[by], _centred(word_counts[by])
        self.gram, self.gram_value = np.zeros(0, np.uint64), np.zeros((0, len(langs)))
        if grams:
            gram, value = np.concatenate([g for g, _, _ in grams]), np.concatenate([_centred(c, t) for _, c, t in grams])
            by = np.argsort(gram)
            self.gram, self.gram_value = gram[by], value[by]

    def values(self, found: W.Words, number: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """A row for each distinct word; ``number``: where it first stands."""
        out = np.zeros((len(hashes), len(self.langs)))
        at, known = _find(self.word, hashes)
        out[known] = self.word_value[at[known]]
        rest = np.flatnonzero(~known)
        points, first, length = _points([found.word(i) for i in number[rest]])
        for n in range(LONGEST, 0, -1):
            if not len(rest):
                break
            place, own = _grams(points, first, length, n)
            at, known = _find(self.gram, W.run_hash(points, place, n))
            at, own = at[known], own[known]
            counts = np.bincount(own, minlength=len(rest))
            sums = np.stack([np.bincount(own, weights=self.gram_value[at, k], minlength=len(rest)) for k in range(out.shape[1])], axis=1)
            done = counts > 0
            out[rest[done]] = sums[done] / counts[done][:, None]
            rest, first, length = rest[~done], first[~done], length[~done]
        return out


def _centred(counts: np.ndarray, totals: np.ndarray | None = None) -> np.ndarray:
    """Smoothed log frequencies less their mean over the languages."""
    totals = counts.sum(axis=0) if totals is None else totals
    logs = np.log((counts + 0.1) / (totals + 0.1 * max(1, len(counts))))
    return logs - logs.mean(axis=1, keepdims=True)


def _find(known: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(known):
        return np.zeros(len(values), np.int64), np.zeros(len(values), dtype=bool)
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return at, known[at] == values


def _points(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the words with a space before and after each; where a word with both spaces starts, its length."""
    text = " " + " ".join(w.decode("utf-8", "replace") for w in words) + " "
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if not words:
        return points, np.zeros(0, np.int64), np.zeros(0, np.int64)
    spaces = np.flatnonzero(points == 32)
    return points, spaces[:-1], np.diff(spaces) + 1


def _grams(points: np.ndarray, first: np.ndarray, length: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all n-grams of the words, and whose they are; the word's ends count as characters, not alone."""
    if n == 1:
        first, length = first + 1, length - 2
    many = np.maximum(length - n + 1, 0)
    return W.spans(first, many), np.repeat(np.arange(len(first)), many)


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", fit_rows: int = FIT_ROWS) -> Model:
    """A model from the rows with text and language. Without any, every text is unknown."""
    rows = rows.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    share = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(share)
    if not langs:
        return Model([], np.zeros(0), np.zeros(0, np.uint64), np.zeros((0, 0)), [])
    drawn = rows.sparkSession.createDataFrame([(x, int((1 << 30) * p)) for x, p in language_shares(share, fit_rows).items()], "lang string, below long")
    place = F.pmod(F.xxhash64(F.lit("fit"), F.col("key"), F.col("text")), F.lit(1 << 30))
    rows = rows.join(F.broadcast(drawn), "lang").where(place < F.col("below"))  # a row per language

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(1).dictionary_encode()
            of = langs.indices.to_numpy()
            for at, to, found in W.pieces(pc.utf8_lower(batch.column(0)), W.LETTERS):
                pair = W.mix(found.hash + of[at:to][found.text].astype(np.uint64))
                _, first, n = np.unique(pair, return_index=True, return_counts=True)
                yield pa.record_batch(
                    [pa.array([found.word(i).decode("utf-8", "replace") for i in first], pa.string()), pa.array(found.hash[first].view(np.int64)), langs.dictionary.take(pa.array(of[at:to][found.text[first]], pa.int32())), pa.array(n)],
                    names=["word", "hash", "lang", "n"],
                )

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which = batch.column(1).dictionary_encode()
            uses = batch.column(2).to_numpy()
            points, first, length = _points([w.encode() for w in batch.column(0).to_pylist()])
            for n in range(1, LONGEST + 1):
                at, own = _grams(points, first, length, n)
                if not len(at):
                    continue
                gram = W.run_hash(points, at, n)
                for k, x in enumerate(which.dictionary.to_pylist()):
                    some = which.indices.to_numpy()[own] == k
                    value, to = np.unique(gram[some], return_inverse=True)
                    sums = np.bincount(to, weights=uses[own[some]], minlength=len(value)).astype(np.int64)
                    yield pa.record_batch([pa.array(np.full(len(value), n, np.int32)), pa.array(value.view(np.int64)), pa.array([x] * len(value), pa.string()), pa.array(sums)], names=["size", "hash", "lang", "n"])

    counted = rows.select("text", "lang").mapInArrow(count, "word string, hash long, lang string, n long")
    words = keep(counted.groupBy("hash", "lang").agg(F.min("word").alias("word"), F.sum("n").alias("n")), "language-words")
    best = _in_turns(words.withColumn("size", F.lit(0)), langs, MAX_WORDS).toPandas()
    grams = words.select("word", "lang", "n").mapInArrow(count_grams, "size int, hash long, lang string, n long")
    grams = keep(grams.groupBy("size", "hash", "lang").agg(F.sum("n").alias("n")), "language-grams")
    totals = {(r["size"], r["lang"]): r["n"] for r in grams.groupBy("size", "lang").agg(F.sum("n").alias("n")).collect()}
    most = _in_turns(grams, langs, MAX_GRAMS).toPandas()
    names = [f"n{k}" for k in range(len(langs))]
    tables = []
    for n, own in most.groupby("size"):
        tables.append((own["hash"].to_numpy(np.int64).view(np.uint64), own[names].to_numpy(float), np.array([totals.get((n, x), 0) for x in langs], float)))
    prior = np.log(np.array([share[x] for x in langs], float) / sum(share.values()))
    return Model(langs, prior, best["hash"].to_numpy(np.int64).view(np.uint64), best[names].to_numpy(float), tables)


def _in_turns(counts: DataFrame, langs: list[str], limit: int) -> DataFrame:
    """Per size ``limit`` hashes with their counts in each language: each language's most frequent, then its second, and so on."""
    by = Window.partitionBy("size", "lang").orderBy(F.desc("n"), "hash")
    sums = [F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"n{k}") for k, x in enumerate(langs)]
    table = counts.withColumn("rank", F.row_number().over(by)).groupBy("size", "hash").agg(F.min("rank").alias("rank"), *sums)
    turn = F.row_number().over(Window.partitionBy("size").orderBy("rank", "hash"))
    return table.withColumn("turn", turn).where(F.col("turn") <= limit).drop("rank", "turn")


def _has_letter(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)


def scores(model: Model, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and posterior of each text."""
    lettered = _has_letter(column)
    out = np.zeros((len(column), max(1, len(model.langs))))
    if model.langs:
        out[:] = model.prior
        for at, _, found in W.pieces(pc.utf8_lower(column), W.LETTERS):
            hashes, first, which = np.unique(found.hash, return_index=True, return_inverse=True)
            value = model.values(found, first, hashes)[which]
            for k in range(len(model.langs)):
                out[at : at + found.texts, k] += np.bincount(found.text, weights=value[:, k], minlength=found.texts)
    best = out.argmax(axis=1)
    share = 1 / np.exp(out - out.max(axis=1, keepdims=True)).sum(axis=1)
    known = lettered & bool(model.langs)
    return [model.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, share, 0.0)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score`` to every row; the other columns pass through.

    A null text, one without a letter, and any text under a model without languages is
    ``und`` with score 0. Columns of those two names are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = scores(shared.value, batch.column(batch.schema.get_field_index(text)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score)], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, f"{schema}, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows whose language is known with a score of at least ``least``, as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return keep_rows(docs, text, lambda column: scores(shared.value, column)[1] >= least)


def fold(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; a null key is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds)), F.lit(0))
