"""Quality rules: isolation forests over rule statistics.

Each document gets counts (words, symbols, repeated lines and windows). Fixed rules reject some
outright; the others are judged by two isolation forests, one over ratios of symbols and word
lengths, one over shares of repeated lines and windows: a document that random splits set apart
after few steps is anomalous. The forests grow on one half of at most `MAX_LABELLED` labelled rows
outside the held-out third, and their thresholds are set on the other half.

Defined cases: null text has no words and fails the base rules; repeated rows are judged each; a
null id is judged and learns nothing; a score equal to the threshold is kept; texts of any length
are counted whole; without labelled rows of both kinds only the base rules reject; an empty table
gives an empty result; columns beside doc_id and text take no part and `keep_good` keeps them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, held_out

SYMBOLS = (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")
MAX_LABELLED = 6000
#: Share of labelled clean rows that a forest's threshold may reject at most.
MAX_CLEAN_LOSS = 0.002
#: Labelled rows from which a forest and its threshold see different rows.
SPLIT_FROM = 400
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    n = end = 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            n += i + 3 - max(end, i)
            end = i + 3
    return n


def rule_counts(text: str | None) -> tuple[int, int, int, int, int]:
    data = (text or "").encode()
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    chars = sum(map(len, words)) if data.isascii() else sum(len(w.decode()) for w in words)
    return len(words), chars, sum(map(data.count, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words)


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


def ratios(counts: np.ndarray) -> np.ndarray:
    """Statistics that don't grow with a text's length; rows of `COLUMNS`."""
    words, chars, symbols = counts.astype(np.float64).T[:3]
    share = symbols / np.maximum(chars, 1)
    return np.stack([chars / np.maximum(words, 1), share, np.sqrt(share), np.log1p(symbols) / np.log1p(chars + 1), symbols / np.maximum(words, 1)], axis=1)


def repeat_ratios(counts: np.ndarray) -> np.ndarray:
    """Repeated lines and repeated words a word.

    They have a forest of their own: clean texts hold them too, and as the rarest values they would
    be the first that random splits set apart, before symbols.
    """
    return counts[:, 3:5] / np.maximum(counts[:, :1].astype(np.float64), 1)


@dataclass
class IsolationForest:
    """Trees as arrays: feature (or -1), cut, and mean path length at the node."""

    feature: np.ndarray
    cut: np.ndarray
    path: np.ndarray
    depth: int
    norm: float

    @staticmethod
    def mean_path(n: int) -> float:
        """Mean path of an unsuccessful search among ``n`` keys."""
        if n <= 1:
            return 0.0
        return 1.0 if n == 2 else 2.0 * (np.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n

    @classmethod
    def grow(cls, x: np.ndarray, trees: int = 200, sample: int = 32, seed: int = 11) -> IsolationForest:
        rng = np.random.default_rng(seed)
        sample = min(sample, len(x))
        depth = max(1, int(np.ceil(np.log2(max(sample, 2)))))
        size = 2 ** (depth + 1)
        feature, cut, path = np.full((trees, size), -1, np.int32), np.zeros((trees, size)), np.zeros((trees, size))
        for t in range(trees):
            todo = [(1, x[rng.choice(len(x), sample, replace=False)], 0)]
            while todo:
                node, rows, level = todo.pop()
                low, high = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (np.zeros(x.shape[1]),) * 2
                varied = np.flatnonzero(high > low)
                if level == depth or len(rows) <= 1 or not len(varied):
                    path[t, node] = level + cls.mean_path(len(rows))
                    continue
                f = int(rng.choice(varied))
                c = rng.uniform(low[f], high[f])
                feature[t, node], cut[t, node] = f, c
                left = rows[:, f] < c
                todo += [(2 * node, rows[left], level + 1), (2 * node + 1, rows[~left], level + 1)]
        return cls(feature, cut, path, depth, cls.mean_path(sample))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score, 2 ** -(mean path / expected path), in (0, 1)."""
        n, trees = len(x), np.arange(len(self.feature))[None, :]
        node = np.ones((n, len(self.feature)), np.int64)
        rows = np.arange(n)[:, None]
        for _ in range(self.depth):
            f = self.feature[trees, node]
            inner = f >= 0
            step = 2 * node + (x[rows, np.maximum(f, 0)] >= self.cut[trees, node])
            node = np.where(inner, step, node)
        return 2.0 ** (-self.path[trees, node].mean(axis=1) / (self.norm or 1.0))


@dataclass
class RuleModel:
    forest: IsolationForest | None
    threshold: float
    repeats: IsolationForest | None = None
    repeats_threshold: float = np.inf

    def anomaly(self, counts: np.ndarray) -> np.ndarray:
        """The larger of both forests' scores, that of repeats shifted to the threshold of the other."""
        if self.forest is None or self.repeats is None or not len(counts):
            return np.zeros(len(counts))
        return np.maximum(self.forest.score(ratios(counts)), self.repeats.score(repeat_ratios(counts)) - self.repeats_threshold + self.threshold)


def calibrated(x: np.ndarray, quality: np.ndarray) -> tuple[IsolationForest, float]:
    """Forest over every other row, threshold on the rows between, which the forest has not seen.

    The threshold rejects the most labelled 0 for at most `MAX_CLEAN_LOSS` of those labelled 1,
    half-way to the nearest score of a 0 above it. With under `SPLIT_FROM` rows, or a part without
    both labels, all rows serve for both. Samples of 32 rows keep like anomalies from hiding one another.
    """
    judged = np.arange(len(x)) % 2 == 1
    if len(x) < SPLIT_FROM or set(quality[judged].tolist()) != {0, 1}:
        judged[:] = True
    forest = IsolationForest.grow(x if judged.all() else x[~judged])
    score, quality = forest.score(x[judged]), quality[judged]
    clean = np.sort(score[quality == 1])
    allowed = int(MAX_CLEAN_LOSS * len(clean))
    limit = float(clean[len(clean) - 1 - allowed])
    above = score[(quality == 0) & (score > limit)]
    return forest, (limit + float(above.min())) / 2 if len(above) else limit


def fit(counts: np.ndarray, quality: np.ndarray) -> RuleModel:
    """Both forests over the rows that pass the base rules, each with its own threshold."""
    judged = np.array([not base_failed(r[0], r[4]) for r in counts], bool) if len(counts) else np.zeros(0, bool)
    counts, quality = counts[judged], quality[judged]
    if not (quality == 0).any() or not (quality == 1).any():
        return RuleModel(None, np.inf)
    return RuleModel(*calibrated(ratios(counts), quality), *calibrated(repeat_ratios(counts), quality))


def labelled_counts(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Counts and quality of at most ``max_rows`` labelled rows, in hash order of the id."""
    bounded_batches(docs.sparkSession)
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    known = known.filter(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [rule_counts(t) for t in b.column("text").to_pylist()]
            columns = list(zip(*rows)) if rows else [[] for _ in COLUMNS]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality").cast(pa.int64()), *[pa.array(c, pa.int64()) for c in columns]], names=["doc_id", "quality", *COLUMNS])

    rows = texts.select("doc_id", "quality", "text").mapInArrow(count, "doc_id long, quality long, " + ", ".join(f"{c} long" for c in COLUMNS)).collect()
    rows = sorted(map(tuple, rows))
    return np.array([r[2:] for r in rows], np.int64).reshape(-1, len(COLUMNS)), np.array([r[1] for r in rows], np.int64)


RESULT = "doc_id long, " + ", ".join(f"{c} long" for c in COLUMNS) + ", base_failed boolean, kept boolean, anomaly double"


def _judge(model: RuleModel, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    counts = np.array([rule_counts(t) for t in texts], np.int64).reshape(-1, len(COLUMNS))
    failed = np.array([base_failed(r[0], r[4]) for r in counts], bool)
    return counts, failed, model.anomaly(counts)


def apply_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the five counts, base_failed, kept and the anomaly score of each row."""
    spark = bounded_batches(docs.sparkSession)
    model = spark.sparkContext.broadcast(fit(*labelled_counts(docs, labels)))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, failed, anomaly = _judge(model.value, b.column(1).to_pylist())
            kept = ~failed & (anomaly <= model.value.threshold)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c) for c in counts.T], pa.array(failed), pa.array(kept), pa.array(anomaly)], names=["doc_id", *COLUMNS, "base_failed", "kept", "anomaly"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(judge, RESULT)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs``, all columns, that the rules keep; nothing is shuffled."""
    spark = bounded_batches(docs.sparkSession)
    model = spark.sparkContext.broadcast(fit(*labelled_counts(docs, labels)))
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, failed, anomaly = _judge(model.value, b.column(at).to_pylist())
            yield b.filter(pa.array(~failed & (anomaly <= model.value.threshold)))

    return docs.mapInArrow(keep, docs.schema)
