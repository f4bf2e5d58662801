"""Language identification by nearest centroid over hashed byte n-grams.

A text is a TF-IDF vector of byte 2- and 3-grams of its lower-cased letters, scaled to length 1.
Each language has `CENTROIDS` centroids (spherical k-means over its labelled texts); the nearest
by cosine names the language. A similarity below what nearly all training texts reach marks the
row as rejected.

Fitted on about `PER_LANGUAGE` texts of each language, taken by hash of the id outside the
held-out third. Defined cases: null text, or one without a letter, is `und` with score 0; without
labelled rows every row is `und`; of centroids of one cosine the first in order of the languages'
names decides; repeated rows are judged each; a null id is held out and learns nothing; texts of any
length are counted whole; columns beside doc_id, text and lang are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, held_out

BITS = 13
DIMS = 1 << BITS
CENTROIDS = 4
PER_LANGUAGE = 800
REJECT_SHARE = 0.001

_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)
_PLAIN_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str | None) -> bool:
    """Whether a character is in a Unicode category L*; numerals such as U+2167 and marks are not."""
    return bool(text) and (_PLAIN_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def gram_counts(text: str | None) -> np.ndarray:
    """Counts of hashed byte 2- and 3-grams; other signs count as one space each."""
    b = _LETTERS[np.frombuffer(f" {(text or '').lower()} ".encode(), np.uint8)].astype(np.uint32)
    two = (b[:-1] << np.uint32(8)) | b[1:]
    three = (two[:-1] << np.uint32(8)) | b[2:]
    code = np.concatenate([two | np.uint32(1 << 24), three]) * np.uint32(2654435761)
    return np.bincount(code >> np.uint32(32 - BITS), minlength=DIMS)


@dataclass
class CentroidModel:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    floor: float

    def predict(self, texts: list) -> tuple[list[str], np.ndarray, np.ndarray]:
        if not self.languages or not texts:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        sims = vectors(np.stack([gram_counts(t) for t in texts]), self.idf) @ self.centroids.T
        best = sims.argmax(axis=1)
        score = np.clip(sims[np.arange(len(texts)), best].astype(np.float64), 0.0, 1.0)
        known = np.array([has_letter(t) for t in texts], bool)
        names = [self.languages[self.owner[k]] if ok else "und" for k, ok in zip(best, known)]
        return names, np.where(known, score, 0.0), ~known | (score < self.floor)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts, dtype=np.float32) * idf
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm == 0, 1, norm)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        nearest = (x @ centres.T).argmax(axis=1)
        for c in range(len(centres)):
            mean = x[nearest == c].sum(axis=0)
            if norm := float(np.linalg.norm(mean)):
                centres[c] = mean / norm
    return centres


def fit(counts: np.ndarray, langs: list[str]) -> CentroidModel:
    """IDF, centroids and rejection floor of labelled gram counts."""
    names = sorted(set(langs))
    if not names:
        return CentroidModel([], np.zeros(DIMS, np.float32), np.zeros((0, DIMS), np.float32), np.zeros(0, np.int64), 0.0)
    idf = np.log((1 + len(langs)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + np.float32(0.1)
    owner, centres, reached = [], [], []
    where = np.array(langs)
    for i, name in enumerate(names):
        x = vectors(counts[where == name], idf)
        own = spherical_kmeans(x, CENTROIDS)
        centres.append(own)
        owner += [i] * len(own)
        reached.append((x @ own.T).max(axis=1))
    floor = float(np.quantile(np.concatenate(reached), REJECT_SHARE))
    return CentroidModel(names, idf, np.concatenate(centres), np.array(owner), floor)


def labelled_counts(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[np.ndarray, list[str]]:
    """Gram counts and language of about ``per_language`` texts of each language, by hash of the id.

    The share to take of each language follows from its count, so no language is sorted as a whole.
    """
    spark = bounded_batches(docs.sparkSession)
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text").filter(~held_out(F.col("doc_id")))
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return np.zeros((0, DIMS), np.int64), []
    shares = spark.createDataFrame([(k, min(1.0, per_language / n)) for k, n in sizes.items()], "l string, share double")
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.join(F.broadcast(shares), (F.col("lang") == F.col("l")) & (draw < F.col("share"))).select("doc_id", "lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [gram_counts(t) for t in b.column(2).to_pylist()]
            index = [np.flatnonzero(c) for c in found]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([i.astype("<u2").tobytes() for i in index], pa.binary()), pa.array([c[i].astype("<u4").tobytes() for c, i in zip(found, index)], pa.binary())],
                names=["doc_id", "lang", "i", "c"],
            )

    got = sorted(tuple(r) for r in chosen.mapInArrow(count, "doc_id long, lang string, i binary, c binary").collect())
    counts = np.zeros((len(got), DIMS), np.uint32)
    for k, (_, _, i, c) in enumerate(got):
        counts[k, np.frombuffer(i, "<u2")] = np.frombuffer(c, "<u4")
    return counts, [r[1] for r in got]


def predict_language(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of each row."""
    spark = bounded_batches(docs.sparkSession)
    model = spark.sparkContext.broadcast(fit(*labelled_counts(docs, per_language)))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                names, score, rejected = model.value.predict(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return source.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
