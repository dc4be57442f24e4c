"""Toxic passages by maximum-scoring segments, and a document score calibrated by extreme values.

* Every token has a log-odds ratio between toxic and clean training texts that hold it, with a Dirichlet
  prior that is proportional to the token's frequency in both (so rare ones stay near 0).
  Tokens are words and their first 8, 7, 6, 5 or 4 bytes. A word scores the ratio of the
  longest of these that is clear (z of at least CLEAR, ratio of at least STRONG), otherwise a small negative STEP;
  the r-th use of a word in a text counts 1 / r, as words come in bursts.
* One linear scan finds all maximal segments of a text: its toxic passages.
* Scores of the best segment of clean text follow an extreme-value law with parameters
  lambda and K; the passages of a text are added up by its sum statistics, and a logistic
  curve over that evidence, fitted on training texts not used for the words, gives 0 to 1.

Fitted on at most about FIT_ROWS labelled rows, taken by a hash of their key; at most
MAX_WORDS words are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfrank.llm import words as W
from shelfrank.llm.lang_id import fit_sample
from shelfrank.llm.storage import keep_rows

FIT_ROWS, MAX_WORDS = 24_000, 50_000
#: Weight of the prior as a share of all training words; least z and log-odds of a clear word; score of the others.
PRIOR, CLEAR, STRONG, STEP = 0.05, 3.0, 1.5, -0.05
THRESHOLD = 0.7
PREFIXES = (8, 7, 6, 5, 4)


@dataclass
class Model:
    word: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    odds: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: float = 1.0  # lambda
    k: float = 1.0
    slope: float = 0.0
    offset: float = -30.0


def segments(place: np.ndarray, score: np.ndarray, total: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word, score), in linear time.

    ``place`` and ``score``: words with a positive score; ``total``: sum of all scores up to
    and with each of them. Words between them only matter through those sums.
    """
    stack: list[list] = []  # sum before, sum at the end, first, last, the nearest one below with a smaller sum before
    for p, s, t in zip(place.tolist(), score.tolist(), total.tolist(), strict=True):
        first, before = p, t - s
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= before:
                j = stack[j][4]
            if j < 0 or stack[j][1] >= t:
                stack.append([before, t, first, p, j])
                break
            before, first = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, t - l) for l, t, a, b, _ in stack]


def evidence(scores: np.ndarray, n: int, scale: float, k: float) -> float:
    """-ln of the chance that clean text of ``n`` words has such segments, at the best number of them."""
    norm = np.sort(scale * scores - np.log(k * max(n, 1)))[::-1]
    norm = norm[norm > 0]
    if not len(norm):
        return 0.0
    sums, r = np.cumsum(norm), np.arange(1, len(norm) + 1)
    logs = np.cumsum(np.log(r))
    return float(max(0.0, (sums - (r - 1) * np.log(np.maximum(sums, 1e-9)) + 2 * logs - np.log(r)).max()))


def passages(found: W.Words, model: Model) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
    """Text number and segments of each text that has any."""
    if not len(model.word) or not len(found.hash):
        return
    hashes, number, which = np.unique(found.hash, return_index=True, return_inverse=True)
    value, rest = np.full(len(hashes), STEP), np.arange(len(hashes))
    for size in (None, *PREFIXES):
        token, longer = (hashes, rest) if size is None else W.prefix_hash(found, number[rest], size)
        at = np.searchsorted(model.word, token)
        at[at == len(model.word)] = 0
        known = model.word[at] == token
        own = rest[longer[known]]
        value[own] = model.odds[at[known]]
        rest = np.setdiff1d(rest, own, assume_unique=True)
    score = value[which]
    good = np.flatnonzero(score > 0)
    by = good[np.lexsort((good, which[good], found.text[good]))]  # the r-th use of a word in a text counts 1 / r
    new = np.ones(len(by), dtype=bool)
    new[1:] = (which[by][1:] != which[by][:-1]) | (found.text[by][1:] != found.text[by][:-1])
    score[by] /= np.arange(len(by)) - np.maximum.accumulate(np.where(new, np.arange(len(by)), 0)) + 1
    total, first = np.cumsum(score), found.first()
    texts = found.text[good]
    for t in np.unique(texts):
        own = good[np.searchsorted(texts, t) : np.searchsorted(texts, t, side="right")]
        base = total[first[t] - 1] if first[t] else 0.0
        yield int(t), segments(own - first[t], score[own], total[own] - base)


def _word_odds(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, log-odds and share in clean text of the clear words; rows: text, toxic."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for at, to, found in W.pieces(batch.column(0), W.ALNUM):
                bad = toxic[at:to][found.text]
                _, number = np.unique(W.mix(found.hash + found.text.astype(np.uint64)), return_index=True)  # once a text
                tokens, of = [found.hash[number]], [number]
                for size in PREFIXES:
                    token, longer = W.prefix_hash(found, number, size)
                    _, once = np.unique(W.mix(token + found.text[number[longer]].astype(np.uint64)), return_index=True)
                    tokens.append(token[once])
                    of.append(number[longer[once]])
                word, which = np.unique(np.concatenate(tokens), return_inverse=True)
                n = np.bincount(which, minlength=len(word))
                t = np.bincount(which, weights=bad[np.concatenate(of)], minlength=len(word)).astype(np.int64)
                yield pa.record_batch([pa.array(word.view(np.int64)), pa.array(t, pa.int64()), pa.array(n - t, pa.int64())], names=["word", "t", "c"])

    words = rows.mapInArrow(count, "word long, t long, c long").groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    totals = words.agg(F.sum("t"), F.sum("c")).first()
    nt, nc = float(totals[0] or 0), float(totals[1] or 0)
    if not nt or not nc:
        return np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
    weight = PRIOR * (nt + nc)
    prior = (F.col("t") + F.col("c")) * F.lit(PRIOR)
    yt, yc = F.col("t") + prior, F.col("c") + prior
    odds = F.log(yt / (F.lit(nt + weight) - yt)) - F.log(yc / (F.lit(nc + weight) - yc))
    z = odds / F.sqrt(1 / yt + 1 / yc)
    clear = words.select("word", odds.alias("odds"), z.alias("z"), (yc / (nc + weight)).alias("share")).where((F.abs("z") >= CLEAR) & (F.abs("odds") >= STRONG))
    best = clear.orderBy(F.desc(F.abs("z")), "word").limit(MAX_WORDS).toPandas().sort_values("word")
    word = best["word"].to_numpy(np.int64).view(np.uint64)
    by = np.argsort(word)
    return word[by], best["odds"].to_numpy()[by], best["share"].to_numpy()[by]


def _root(odds: np.ndarray, share: np.ndarray) -> float:
    """lambda: the positive root of sum(p * exp(lambda * score)) = 1 over words of clean text."""
    rest = max(1e-9, 1 - share.sum())
    total = lambda x: rest * np.exp(x * STEP) + (share * np.exp(np.minimum(x * odds, 700))).sum() - 1
    low, high = 1e-4, 20.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if total(mid) < 0 else (low, mid)
    return low


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the best logistic curve over ln(1 + x), slightly shrunk."""
    a = np.stack([np.log1p(x), np.ones(len(x))], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.diag([0.05, 0.001])
        w = w - np.linalg.solve(hess, a.T @ (p - y) + np.array([0.05, 0.001]) * w)
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", fit_rows: int = FIT_ROWS) -> Model:
    """A model from the labelled documents. A key labelled twice counts as toxic if one label says so.

    Without toxic and clean labels nothing is known, and all texts score near 0.
    """
    labels = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(label).alias("_toxic"))
    chosen = F.broadcast(fit_sample(labels, key, fit_rows))  # as many rows as fit_rows says
    rows = docs.select(key, F.col(text).cast("binary").alias("_text")).join(chosen, key)
    part = F.pmod(F.xxhash64(F.lit("calibrate"), F.col(key)), F.lit(4))
    word, odds, share = _word_odds(rows.where(part > 0).select("_text", F.col("_toxic") > 0))
    if not len(word):
        return Model()
    model = Model(word, odds, scale=_root(odds, share))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, _, found in W.pieces(batch.column(0), W.ALNUM):
                lists = [[] for _ in range(found.texts)]
                for t, own in passages(found, shared.value):
                    lists[t] = [s for _, _, s in own]
                yield pa.record_batch([batch.column(1).slice(at, found.texts), pa.array(found.counts(), pa.int64()), pa.array(lists, pa.list_(pa.float64()))], names=["y", "n", "s"])

    seen = rows.where(part == 0).select("_text", F.col("_toxic") > 0).mapInArrow(scan, "y boolean, n long, s array<double>").toPandas()
    y, clean = seen["y"].to_numpy(bool), seen[~seen["y"].astype(bool)]
    if not y.any() or y.all():
        return Model()
    flat = np.concatenate([*clean["s"], np.zeros(0)])
    least = float(np.median(flat)) if len(flat) else 1.0
    model.k = float(np.clip(((flat >= least).sum() + 0.5) / (clean["n"].sum() + 1) * np.exp(model.scale * least), 1e-6, 1.0))
    x = np.array([evidence(np.asarray(s), n, model.scale, model.k) for s, n in zip(seen["s"], seen["n"], strict=True)])
    model.slope, model.offset = _logistic(x, y.astype(float))
    return model


def scores(model: Model, column: pa.Array) -> tuple[np.ndarray, list[list[dict]]]:
    """Score of each text, and its passages that are significant alone."""
    x, spans = np.zeros(len(column)), [[] for _ in range(len(column))]
    for at, _, found in W.pieces(column, W.ALNUM):
        n = found.counts()
        for t, own in passages(found, model):
            s = np.array([v for _, _, v in own])
            x[at + t] = evidence(s, n[t], model.scale, model.k)
            least = np.log(model.k * n[t] / 0.05)
            spans[at + t] = [{"first": a, "last": b, "score": v} for a, b, v in own if model.scale * v >= least]
    return 1 / (1 + np.exp(-np.clip(model.slope * np.log1p(x) + model.offset, -30, 30))), spans


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``score``, ``predicted`` and ``passages`` to every row; the other columns pass through.

    ``passages``: first and last word and score of each segment that is significant alone
    (expected at most 0.05 times in clean text of that length). An empty or null text has
    no words and the score of no evidence. Columns of those names are replaced.
    """
    docs = docs.drop("score", "predicted", "passages")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, spans = scores(shared.value, batch.column(batch.schema.get_field_index(text)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32)), pa.array(spans, kind)], names=[*batch.schema.names, "score", "predicted", "passages"])

    return docs.mapInArrow(run, f"{schema}, score double, predicted int, passages array<struct<first:int,last:int,score:double>>")


def keep_clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows that are not predicted toxic, as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return keep_rows(docs, text, lambda column: scores(shared.value, column)[0] < THRESHOLD)

