"""Operator 12: language identification by hierarchical discrimination.

A text is first given a language family; then linear support vector machines, one for each
pair of languages, separate the languages of that family. Both levels use the same
features and the same machines: hashed byte n-grams of the lower-cased text (one to four
bytes, everything but letters is one blank), logarithms of counts, unit length, no bias.
A level's winner has most duels, then the largest sum of margins, then the smallest name.

Families are those of ``FAMILIES``; a language without an entry is a family of its own, so
that any label can be learned. The machines are trained by dual coordinate descent on about
``PER_LANGUAGE`` texts of a language and at most ``SAMPLE`` in all (those with the smallest
id digests, outside the held-out fold); features of that bounded sample are computed by
tasks and only they reach the driver. Prediction is one narrow pass over all whole texts.

Defined results: null texts and texts without a letter are ``und`` with score 0, as is every
text if there was nothing to learn from; null ids take no part in learning; of rows that
share an id the least (lang, text) is learned from; repeated rows are predicted each; extra
columns are kept (lang_pred and score are replaced); an empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from feedlake.llm.quality import fold

PER_LANGUAGE, SAMPLE = 800, 16_000  # texts of a language (about), most texts in all
LANGUAGES = 1000                    # most label values that are learned, by number of texts
BITS, ORDERS, CHUNK = 13, 4, 1 << 20
PENALTY, EPOCHS = 4.0, 20
UNKNOWN = "und"

# Genealogy of languages by ISO 639-1 code.
FAMILIES = {
    "germanic": "de en nl sv da no nb nn is fo af lb fy yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "semitic": "ar he mt am",
    "indic": "hi bn ur pa gu mr ne si",
    "iranian": "fa ps ku tg",
    "dravidian": "ta te kn ml",
    "malayic": "id ms jv su tl",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_ASCII = np.arange(256, dtype=np.uint8)
_ASCII[[i for i in range(128) if not 97 <= i <= 122]] = 32
_CLEAN = _ASCII.tobytes()
_FACTORS = np.array([2654435761, 2246822519, 3266489917, 668265263], dtype=np.uint32)


def family(language: str) -> str:
    """Family of a language tag (``en-GB`` is ``en``); unlisted languages are their own."""
    return _FAMILY.get(language.replace("_", "-").split("-")[0].lower(), language)


def counts(text: str) -> np.ndarray:
    """Hashed n-gram counts of one whole text."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace").translate(_CLEAN), dtype=np.uint8)
    total = np.zeros(1 << BITS)
    for at in range(0, len(raw), CHUNK):
        piece = raw[at : at + CHUNK + ORDERS - 1].astype(np.uint32)
        size, blank = min(CHUNK, len(raw) - at), piece == 32
        code, empty = np.zeros(len(piece), np.uint32), np.ones(len(piece), bool)
        for k in range(ORDERS):
            n = len(piece) - k
            if n <= 0:
                break
            code, empty = code[:n] + (piece[k:] + np.uint32(1)) * _FACTORS[k], empty[:n] & blank[k:]
            mixed = (code ^ (code >> np.uint32(15))) * np.uint32(2246822519 + 2 * k) >> np.uint32(32 - BITS)
            here = min(n, size)
            total += np.bincount(mixed[:here][~empty[:here]], minlength=1 << BITS)
    return total


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values) of unit length."""
    found = counts(text)
    index = np.flatnonzero(found)
    value = np.log1p(found[index])
    return index.astype(np.int32), (value / (np.sqrt(value @ value) or 1.0)).astype(np.float32)


def fit_machine(rows: list[tuple[np.ndarray, np.ndarray]], sides: np.ndarray, seed: int = 3) -> np.ndarray:
    """Weights of a linear support vector machine (hinge loss) for sides +1 and -1, by dual coordinate descent."""
    weights, alpha, random = np.zeros(1 << BITS), np.zeros(len(rows)), np.random.default_rng(seed)
    bound = PENALTY * len(rows) / 2 / np.where(sides > 0, (sides > 0).sum(), (sides < 0).sum())  # classes weigh alike
    for _ in range(EPOCHS):
        moved = 0.0
        for r in random.permutation(len(rows)):
            index, value = rows[r]
            slope = sides[r] * (weights[index] @ value) - 1
            new = min(max(alpha[r] - slope, 0.0), bound[r])  # rows have unit length
            if new != alpha[r]:
                weights[index] += (new - alpha[r]) * sides[r] * value
                moved = max(moved, abs(new - alpha[r]))
                alpha[r] = new
        if moved < 1e-3:
            break
    return weights


class Duels:
    """One machine for each pair of classes."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], names: np.ndarray):
        self.classes = sorted(set(names.tolist()))
        self.pairs = list(combinations(range(len(self.classes)), 2))
        machines = []
        for a, b in self.pairs:
            pick = np.flatnonzero((names == self.classes[a]) | (names == self.classes[b]))
            machines.append(fit_machine([rows[r] for r in pick], np.where(names[pick] == self.classes[a], 1.0, -1.0)))
        self.weights = np.array(machines).reshape(-1, 1 << BITS)

    def decide(self, index: np.ndarray, value: np.ndarray) -> tuple[str, float]:
        """(winner, mean confidence of its duels)."""
        if not self.pairs:
            return self.classes[0], 1.0
        margins = self.weights[:, index] @ value
        won, total, sure = (np.zeros(len(self.classes)) for _ in range(3))
        for (a, b), m in zip(self.pairs, margins, strict=True):
            won[a if m >= 0 else b] += 1
            total[[a, b]] += m, -m
            sure[[a, b]] += 1 / (1 + np.exp(-2 * m)), 1 / (1 + np.exp(2 * m))
        best = max(range(len(self.classes)), key=lambda c: (won[c], total[c], -c))
        return self.classes[best], float(sure[best] / (len(self.classes) - 1))


class Model:
    """Families, then the languages of each."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], languages: list[str]):
        families = np.array([family(x) for x in languages], dtype=object)
        names = np.array(languages, dtype=object)
        self.families = Duels(rows, families)
        self.inside = {f: Duels([rows[r] for r in np.flatnonzero(families == f)], names[families == f]) for f in self.families.classes}

    def predict(self, text: str) -> tuple[str, float]:
        if not self.families.classes:
            return UNKNOWN, 0.0
        index, value = features(text)
        group, sure = self.families.decide(index, value)
        language, also = self.inside[group].decide(index, value)
        return language, min(1.0, max(0.0, sure * also))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, sample: int = SAMPLE) -> Model:
    """Learn from ``text`` and ``lang`` of a bounded sample outside the held-out fold."""
    known = docs.where("lang is not null and text is not null").where(fold(F.col("doc_id")) != 0)
    sizes = (known.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.02).alias("n"))
             .orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect())
    if not sizes:
        return Model([], [])
    # an id's digest as a share of 1, times the size of its language: about its rank there, without a sort of the language
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    size = F.create_map(*[F.lit(x) for r in sizes for x in (r.lang, float(r.n))])
    chosen = (known.groupBy("doc_id").agg(F.min("lang").alias("lang"))
              .withColumn("place", share * size[F.col("lang")]).where(F.col("place") < per_language)
              .orderBy("place", "doc_id").limit(sample).select("doc_id"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([i.tobytes() for i, _ in rows], pa.binary()), pa.array([v.tobytes() for _, v in rows], pa.binary())],
                names=["lang", "i", "v"])

    # the sample is bounded by ``sample`` rows: a proven broadcast size
    texts = (docs.where("lang is not null and text is not null").select("doc_id", "lang", "text")
             .join(F.broadcast(chosen), "doc_id")
             .groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("one")).select("one.lang", "one.text")
             .where(has_letter(F.col("text"))))
    got = texts.mapInArrow(work, "lang string, i binary, v binary").toPandas().sort_values(["lang", "i", "v"])
    rows = [(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32)) for i, v in zip(got["i"], got["v"], strict=True)]
    return Model(rows, got["lang"].tolist())


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score. Only texts with a letter go to Python, only the answer comes back."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights for each pair of languages of a family

    @arrow_udf("lang string, score double")
    def answer(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            found = [(None, None) if t is None else shared.value.predict(t) for t in (x.as_py() for x in batch)]
            yield pa.StructArray.from_arrays(
                [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["lang", "score"])

    found = answer(F.when(has_letter(F.col(text)), F.col(text)))
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return (docs.withColumns({"lang_pred": found, "score": F.lit(0.0)})
            .select(*kept, F.coalesce(F.col("lang_pred.lang"), F.lit(UNKNOWN)).alias("lang_pred"),
                    F.coalesce(F.col("lang_pred.score"), F.lit(0.0)).alias("score")))
