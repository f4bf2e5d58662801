"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

Score = sigmoid(w0 + <w, x> + 1/2 * sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)): all pairwise
interactions of rank `RANK` in time linear in the features. It is trained on at most
`MAX_LABELLED` labelled rows whose id does not fall in the held-out third. Inputs are the words and
statistics of the text and one field of metadata, the stated length (`n_chars`).

Defined cases: null and empty texts are scored on their structure; repeated rows are scored each; a
null id is scored, held out and learns nothing; a score of 0.5 predicts 1; texts of any length are
counted whole; without labelled rows every score is 0.5; a stated length that is null, negative or
not finite, and a table without one numeric column of that name, count as not stated; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .common import bounded_batches, held_out

WORD_BITS = 14
N_WORDS = 1 << WORD_BITS
RANK = 8
MAX_LABELLED = 6000
SYMBOLS = (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")
N_STRUCTURE = 10
N_METADATA = 2
SIZE = N_WORDS + N_STRUCTURE + N_METADATA


class Features:
    """Sparse rows: hashed words with weight sqrt(count / words), then structure statistics and metadata."""

    def __init__(self, max_entries: int = 300_000):
        self.buckets: dict[bytes, int] = {}
        self.max_entries = max_entries

    def _bucket(self, word: bytes) -> int:
        b = self.buckets.get(word)
        if b is None:
            if len(self.buckets) > self.max_entries:
                self.buckets.clear()
            b = self.buckets[word] = zlib.crc32(word) & (N_WORDS - 1)
        return b

    def row(self, text: str | None, n_chars: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        data = (text or "").encode()
        words = data.lower().split()
        n = len(words)
        size = max(len(data), 1)
        symbols = sum(map(data.count, SYMBOLS))
        lines = [x for x in data.split(b"\n") if x.strip()]
        windows = list(zip(words, words[1:], words[2:]))
        digits = sum(map(data.count, (b"0", b"1", b"2", b"3", b"4", b"5", b"6", b"7", b"8", b"9")))
        structure = np.array([
            np.log1p(n) / 8, len(data) / max(n, 1) / 10, symbols / size * 10, np.log1p(symbols) / 6, len(set(words)) / max(n, 1),
            (len(lines) - len(set(lines))) / max(len(lines), 1), 1 - len(set(windows)) / max(len(windows), 1), digits / size * 10,
            len(lines) / max(n, 1) * 10, (data.count(b".") + data.count(b",")) / max(n, 1),
        ])
        stated = n_chars is not None and 0 <= n_chars < np.inf
        metadata = np.array([np.log1p(n_chars) / 8 if stated else 0.0, 0.0 if stated else 1.0])
        counts = np.bincount(np.fromiter(map(self._bucket, words), np.int64, n), minlength=1) if n else np.zeros(1)
        index = np.flatnonzero(counts)
        weight = np.sqrt(counts[index] / max(n, 1)) if n else np.zeros(0)
        return np.concatenate([index, np.arange(N_WORDS, SIZE)]), np.concatenate([weight, structure, metadata])


@dataclass
class FactorisationMachine:
    w0: float
    w: np.ndarray
    v: np.ndarray

    def raw(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the sigmoid and the factor sums, for rows laid end to end."""
        vx = self.v[index] * value[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat((vx * vx).sum(axis=1), starts)
        return self.w0 + np.add.reduceat(self.w[index] * value, starts) + 0.5 * ((sums**2).sum(axis=1) - squares), sums

    def probability(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        starts = np.cumsum([0, *(len(r[0]) for r in rows[:-1])])
        raw, _ = self.raw(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), starts)
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.1, decay: float = 1e-4, seed: int = 5) -> FactorisationMachine:
    """Logistic loss, AdaGrad, the two labels weighted alike."""
    rng = np.random.default_rng(seed)
    model = FactorisationMachine(0.0, np.zeros(SIZE), rng.normal(0, 0.01, (SIZE, RANK)))
    if len(set(y.tolist())) < 2:
        if len(y):
            model.w0 = 4.0 if y[0] else -4.0
        return model
    gw, gv, g0 = np.full(SIZE, 1e-6), np.full((SIZE, RANK), 1e-6), 1e-6
    weight = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), batch):
            pick = order[a : a + batch]
            index, value = np.concatenate([rows[i][0] for i in pick]), np.concatenate([rows[i][1] for i in pick])
            sizes = np.array([len(rows[i][0]) for i in pick])
            raw, sums = model.raw(index, value, np.cumsum(sizes) - sizes)
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[pick]) * weight[pick] / len(pick)
            e = np.repeat(error, sizes)
            used, at = np.unique(index, return_inverse=True)
            dw = np.bincount(at, e * value, len(used)) + decay * model.w[used]
            each = (e * value)[:, None] * (np.repeat(sums, sizes, axis=0) - model.v[index] * value[:, None])
            dv = np.stack([np.bincount(at, each[:, f], len(used)) for f in range(RANK)], axis=1) + decay * model.v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            d0 = error.sum()
            g0 += d0**2
            model.w[used] -= rate * dw / np.sqrt(gw[used])
            model.v[used] -= rate * 0.3 * dv / np.sqrt(gv[used])
            model.w0 -= rate * d0 / np.sqrt(g0)
    return model


def stated_length(docs: DataFrame) -> Column:
    """``n_chars`` as a double; null where the table has no such column, or not one of numbers."""
    same = [f for f in docs.schema.fields if f.name.lower() == "n_chars"]
    if len(same) != 1 or not isinstance(same[0].dataType, NumericType):
        return F.lit(None).cast("double").alias("n_chars")
    return F.col(f"`{same[0].name}`").cast("double").alias("n_chars")


def labelled_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED) -> tuple[list, np.ndarray]:
    """Features and labels of at most ``max_rows`` rows outside the held-out third, in hash order."""
    bounded_batches(docs.sparkSession)
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.filter(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", stated_length(docs)).join(F.broadcast(known), "doc_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features()
        for b in batches:
            rows = list(map(make.row, b.column("text").to_pylist(), b.column("n_chars").to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("quality"), pa.array([r[0].astype("<i4").tobytes() for r in rows], pa.binary()), pa.array([r[1].astype("<f4").tobytes() for r in rows], pa.binary())],
                names=["doc_id", "quality", "i", "v"],
            )

    found = sorted(tuple(r) for r in texts.select("doc_id", "quality", "text", "n_chars").mapInArrow(features, "doc_id long, quality int, i binary, v binary").collect())
    rows = [(np.frombuffer(r[2], "<i4").astype(np.int64), np.frombuffer(r[3], "<f4").astype(np.float64)) for r in found]
    return rows, np.array([r[1] for r in found], np.float64)


def score_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    spark = bounded_batches(docs.sparkSession)
    fitted = train(*labelled_rows(docs, labels, max_rows))
    model = spark.sparkContext.broadcast(fitted)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features()
        for b in batches:
            p = model.value.probability(list(map(make.row, b.column(2).to_pylist(), b.column(3).to_pylist())))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text", stated_length(docs))
    return source.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
