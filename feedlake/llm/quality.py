"""Operator 3: quality classifier, a factorisation machine.

Features of a text: hashed words and hashed word shapes (log counts, unit length),
structure statistics of characters, words and lines (as numbers and in bins), and the
row's n_chars as metadata. Score = sigmoid(w0 + w.x + half the sum over factors of
((sum v_if x_i)^2 - sum v_if^2 x_i^2)): all pairwise interactions at low rank, in time
linear in the features.

The model is fitted by Adam on at most ``SAMPLE`` labelled rows (those with the smallest
id digests, so that source and order play no part) outside the held-out fold; features
of that bounded sample are computed by tasks, and only they reach the driver. Scoring is
one narrow pass over all whole texts. Labels, lang, source and doc_id are never features.

Defined results: null or empty texts get the score of a text without words; null ids are
scored and never held out; repeated rows are scored each; conflicting labels of an id
count as the worst; without any label every score is 0.5; an empty table gives an empty
result; extra columns are ignored.
"""
from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from feedlake.llm.common import give_back, slices

SAMPLE = 8_000                      # most labelled rows the model is fitted on
WORDS, SHAPES, BINS = 4096, 1024, 16
RANK, EPOCHS, BATCH, RATE, DECAY = 8, 12, 64, 0.02, 1e-4
THRESHOLD = 0.3

# classes of bytes: 0 other, 1 lower case or multi-byte letter, 2 upper case, 3 digit, 4 blank, 5 line end
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[97:123], _CLASS[128:], _CLASS[65:91], _CLASS[48:58], _CLASS[[32, 9]], _CLASS[[10, 13]] = 1, 1, 2, 3, 4, 5
_RUN = re.compile(r"(.)\1+")
_SHAPE = str.maketrans({**{c: "a" for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{c: "0" for c in "0123456789"}})
STATS = 14
DIM = WORDS + SHAPES + STATS * (BINS + 1)


class _Codes(dict):
    """word -> word bucket * SHAPES + shape bucket, remembered for a bounded number of words."""

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        shape = _RUN.sub(r"\1", re.sub(r"[^\x00-\x7f]", "a", word.translate(_SHAPE)))
        value = zlib.crc32(word.lower().encode("utf-8", "replace")) % WORDS * SHAPES + zlib.crc32(shape.encode()) % SHAPES
        if len(word) <= 64:
            self[word] = value
        return value


_CODES = _Codes()


def statistics(text: str, words: list[str], codes: np.ndarray, n_chars: float) -> np.ndarray:
    """Numbers in [0, 1]."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    other, lower, upper, digit, blank, lines = np.bincount(_CLASS[raw], minlength=6)
    n, solid = max(len(raw), 1), max(len(raw) - blank - lines, 1)
    m = max(len(words), 1)
    _, counts = np.unique(codes, return_counts=True)
    again = float((codes[1:] == codes[:-1]).mean()) if len(codes) > 1 else 0.0
    capital = sum(w[0].isupper() for w in words) / m
    log = lambda v, top: min(1.0, np.log1p(v) / np.log1p(top))
    return np.clip([
        log(n, 1e6), log(len(words), 2e5), min(1.0, solid / m / 20), other / solid, upper / solid, digit / solid,
        blank / n, lines / m, len(counts) / m, counts.max(initial=0) / m, again, capital, log(n_chars, 1e6),
        min(1.0, abs(n_chars - len(text)) / max(n_chars, len(text), 1))], 0, 1)


def features(text: str | None, n_chars: float | None) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values) of one whole text."""
    text = text or ""
    words = text.split()
    codes = np.fromiter(map(_CODES.__getitem__, words), dtype=np.int64, count=len(words))
    parts_i, parts_v = [], []
    for bucket, offset in ((codes // SHAPES, 0), (codes % SHAPES, WORDS)):
        index, count = np.unique(bucket, return_counts=True)
        value = np.log1p(count)
        parts_i.append(index + offset)
        parts_v.append(value / (np.sqrt((value * value).sum()) or 1.0))
    stats = statistics(text, words, codes, float(n_chars or 0))
    base = WORDS + SHAPES
    parts_i += [base + np.arange(STATS), base + STATS + np.arange(STATS) * BINS + np.minimum((stats * BINS).astype(np.int64), BINS - 1)]
    parts_v += [stats, np.full(STATS, 0.5)]
    return np.concatenate(parts_i).astype(np.int32), np.concatenate(parts_v).astype(np.float32)


class FactorisationMachine:
    def __init__(self, seed: int = 11):
        self.bias = 0.0
        self.table = np.zeros((DIM, 1 + RANK))  # linear weight, then factors
        self.table[:, 1:] = np.random.default_rng(seed).normal(0, 0.02, (DIM, RANK))

    def margin(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(margins, factor sums, weighted rows) of rows laid end to end; every row has features."""
        rows = self.table[index] * value[:, None]
        sums = np.add.reduceat(rows, starts, axis=0)
        squares = np.add.reduceat(rows[:, 1:] ** 2, starts, axis=0)
        return self.bias + sums[:, 0] + 0.5 * (sums[:, 1:] ** 2 - squares).sum(1), sums[:, 1:], rows[:, 1:]

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.empty(0)
        size = np.array([len(i) for i, _ in rows])
        z, _, _ = self.margin(np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows]), np.cumsum(size) - size)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 5) -> FactorisationMachine:
        random, y = np.random.default_rng(seed), labels.astype(np.float64)
        if not len(rows):
            return self
        self.bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        first, second, step = np.zeros_like(self.table), np.zeros_like(self.table), 0
        epochs = max(EPOCHS, -(-1500 * BATCH // (10 * len(rows))))
        for _ in range(min(epochs, 60)):
            order = random.permutation(len(rows))
            for at in range(0, len(order), BATCH):
                pick = order[at : at + BATCH]
                size = np.array([len(rows[r][0]) for r in pick])
                index, value = (np.concatenate([rows[r][c] for r in pick]) for c in (0, 1))
                z, sums, weighted = self.margin(index, value, np.cumsum(size) - size)
                off = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) / len(pick)
                each = np.repeat(off, size)
                slope = np.empty((len(index), 1 + RANK))
                slope[:, 0] = each * value
                slope[:, 1:] = (each * value)[:, None] * (np.repeat(sums, size, axis=0) - weighted)
                grad = DECAY * self.table
                np.add.at(grad, index, slope)
                step += 1
                first += 0.1 * (grad - first)
                second += 0.001 * (grad * grad - second)
                self.table -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
                self.bias -= RATE * off.sum()
        return self


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5 (0: held out)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> FactorisationMachine:
    """Fit on at most ``sample`` labelled rows outside the held-out fold."""
    chosen = (labels.where("quality is not null").where(fold(F.col("doc_id")) != 0)
              .groupBy("doc_id").agg(F.min("quality").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                rows = [features(t, n) for t, n in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(3), pa.array([i.tobytes() for i, _ in rows], pa.binary()), pa.array([v.tobytes() for _, v in rows], pa.binary())],
                    names=["doc_id", "quality", "i", "v"])

    # the sample is bounded by ``sample`` rows: a proven broadcast size
    joined = docs.select(F.col("doc_id").cast("long"), "text", F.col("n_chars").cast("double")).join(
        F.broadcast(chosen.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"))), "doc_id")
    got = joined.mapInArrow(work, "doc_id long, quality int, i binary, v binary").toPandas().sort_values(["doc_id", "i", "v"])
    rows = [(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32)) for i, v in zip(got["i"], got["v"], strict=True)]
    return FactorisationMachine().fit(rows, got["quality"].to_numpy())


def score(docs: DataFrame, model: FactorisationMachine, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score and predicted (columns of those names are replaced).

    Only the text and n_chars go to Python, once, and only the score comes back; all other columns stay in the JVM.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIM x (RANK + 1) numbers

    def work(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for texts, sizes in batches:
            parts = [shared.value.score([features(t, n) for t, n in zip(p.column(0).to_pylist(), p.column(1).to_pylist(), strict=True)])
                     for p in slices(pa.RecordBatch.from_arrays([texts, sizes], names=["text", "n_chars"]))]
            yield pa.array(np.concatenate([np.empty(0), *parts]))
        _CODES.clear()  # the worker lives on
        give_back()

    found = arrow_udf(work, "double")(F.col("text"), F.col("n_chars").cast("double"))
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    return (docs.select(*kept, found.alias("score"))
            .withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0)))
