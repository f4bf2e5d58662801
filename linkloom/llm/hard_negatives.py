"""Hard-negative mining on a vector-approximation file.

Vectors become integers floor(scale * x) and are written once, each with its approximation: one
byte a component, the cell of equal width between that component's least and largest value. For an
anchor, a table of the least product of its component with each cell makes the lower bound of a
score a sum of lookups; all cells of a component being equally wide, the upper bound lies a fixed
span above it. Only vectors whose bounds may bring them into a result receive an exact inner product:

* positives: those whose upper bound reaches the k-th best score or lower bound seen so far;
* negatives: those whose bounds meet the window of scores that a positive sets, and whose upper
  bound reaches the n-th best score or lower bound that surely lies in that window.

Anchors are taken in blocks of about ``block_anchors`` by hash; a block, bounded by that parameter,
is sent to all tasks, which read the written table once for the positives and once for the
negatives and return, for each anchor, at most as many rows as the result may hold. Results of
tasks meet by anchor. No block depends on the size of a label or on copies of a vector.

Defined cases: rows with a null label or vector, or with a null, non-finite or too large component
(2**27 / scale or more) take no part; shorter vectors count as padded by zeros; a null vec_id is no
anchor and comes after all others among ties; repeated rows are rows of their own, told apart by
their place in the written table; an anchor without positives, or without negatives in a window,
gives no rows; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship_package
from .centroids import LARGEST, matrix
from .common import written

CELLS = 256
#: Rows that bounds are computed for at a time, and anchors beside them: tables and bounds stay in cache.
_ROWS, _ANCHORS = 4096, 32
_LAST = np.iinfo(np.int64).max


def _integers(column: pa.Array, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors that take part, and their integers, padded by zeros."""
    sizes = np.asarray(column.value_lengths().fill_null(-1))
    at = np.flatnonzero(sizes >= 0)
    x = np.zeros((len(at), dim))
    kept = column.take(pa.array(at)) if len(at) else column.slice(0, 0)
    flat = kept.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    x[np.arange(dim)[None, :] < sizes[at][:, None]] = flat
    x = np.floor(x * float(scale))
    good = (np.abs(x) < LARGEST).all(axis=1)
    return at[good], x[good].astype(np.int64)


def whole_rows(vectors: DataFrame, scale: int) -> tuple[DataFrame, int]:
    """(rid, vec_id, label, q) of the rows that take part, written, and the longest vector's size."""
    ship_package(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.filter("label IS NOT NULL AND embedding IS NOT NULL")
    dim = rows.agg(F.max(F.size("embedding"))).first()[0] or 0

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, q = _integers(b.column(2), dim, scale)
            own = [b.column(i).take(pa.array(at, pa.int64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*own, pa.array([r.tobytes() for r in q.astype("<i4")], pa.binary())], names=["vec_id", "label", "q"])

    packed = rows.mapInArrow(pack, "vec_id long, label long, q binary")
    return written(packed.withColumn("rid", F.monotonically_increasing_id()), "whole-vectors"), dim


def cell_edges(table: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Least value and cell width of each component, over all rows; tasks send two numbers a component."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(dim, LARGEST, np.int64), np.full(dim, -LARGEST, np.int64)
        for b in batches:
            if b.num_rows:
                q = matrix(b.column(0), "<i4", dim)
                low, high = np.minimum(low, q.min(axis=0)), np.maximum(high, q.max(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(low), pa.array(high)], names=["d", "low", "high"])

    each = table.select("q").mapInArrow(ends, "d int, low long, high long")
    found = {r.d: (r.low, r.high) for r in each.groupBy("d").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()}
    low = np.array([found[d][0] for d in range(dim)], np.int64)
    high = np.array([found[d][1] for d in range(dim)], np.int64)
    return low, np.maximum(1, -(-(high - low + 1) // CELLS))


def approximated(table: DataFrame, dim: int, low: np.ndarray, width: np.ndarray) -> DataFrame:
    """``table`` with the approximation file's column: the cell of each component."""

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                q = matrix(b.column(3), "<i4", dim).astype(np.int64)
                cells = ((q - low) // width).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r.tobytes() for r in cells], pa.binary())], names=[*b.schema.names, "cells"])

    return table.select("rid", "vec_id", "label", "q").mapInArrow(quantise, "rid long, vec_id long, label long, q binary, cells binary")


def bound_tables(q: np.ndarray, low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor: least product of each component and cell, and how far upper bounds lie above lower ones."""
    starts = low[:, None] + np.arange(CELLS)[None, :] * width[:, None]
    tables = np.minimum(q[:, :, None] * starts, q[:, :, None] * (starts + width[:, None] - 1))
    return tables, (np.abs(q) * (width - 1)).sum(axis=1)


def lower_bounds(tables: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """(anchors, rows): sums of table lookups; ``cells`` has a row a component."""
    total = np.zeros((tables.shape[0], cells.shape[1]), np.int64)
    one = np.empty_like(total)
    for d in range(tables.shape[1]):
        np.take(tables[:, d, :], cells[d], axis=1, out=one, mode="clip")
        total += one
    return total


class _Best:
    """The first ``k`` (score, id, rid) in order: higher scores, then smaller ids."""

    def __init__(self, k: int):
        self.k, self.rows = k, np.zeros((3, 0), np.int64)

    def add(self, score: np.ndarray, ids: np.ndarray, rids: np.ndarray) -> None:
        rows = np.concatenate([self.rows, np.stack([score, ids, rids])], axis=1)
        order = np.lexsort((rows[2], rows[1], -rows[0]))[: self.k]
        self.rows = rows[:, order]

    def floor(self) -> int | None:
        return int(self.rows[0, -1]) if self.rows.shape[1] == self.k else None


def _kth(values: np.ndarray, k: int) -> int | None:
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else None


def _floor(*known: int | None) -> int:
    return max([x for x in known if x is not None], default=-_LAST)


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple]:
    """Rows in blocks of about `_ROWS`: rid, vec_id (null last), label, q, cells by component."""
    held: list[pa.RecordBatch] = []

    def block() -> tuple:
        t = pa.Table.from_batches(held).combine_chunks()
        number = lambda c, null: t.column(c).fill_null(null).to_numpy()
        q, cells = (matrix(t.column(c).combine_chunks(), k, dim) for c, k in (("q", "<i4"), ("cells", "u1")))
        return number("rid", 0), number("vec_id", _LAST), number("label", 0), q, np.ascontiguousarray(cells.T).astype(np.intp)

    rows = 0
    for b in batches:
        for start in range(0, b.num_rows, _ROWS):
            held.append(b.slice(start, _ROWS))
            rows += held[-1].num_rows
            if rows >= _ROWS:
                yield block()
                held, rows = [], 0
    if rows:
        yield block()


def _scan(table: DataFrame, dim: int, schema: str, work) -> DataFrame:
    """``work`` on the blocks of each task; its rows are lists of columns."""
    kinds = {"long": pa.int64()}
    fields = [f.split() for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in work(_blocks(batches, dim)):
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])

    return table.select("rid", "vec_id", "label", "q", "cells").mapInArrow(run, schema)


def _emit(best: dict[tuple, _Best]) -> Iterator[list]:
    rows = [np.concatenate([np.repeat(np.array(key, np.int64)[:, None], b.rows.shape[1], axis=1), b.rows]) for key, b in best.items() if b.rows.shape[1]]
    for start in range(0, len(rows), 4096):
        yield list(np.concatenate(rows[start : start + 4096], axis=1))


def positives(table: DataFrame, dim: int, anchors: dict, edges: tuple, k: int) -> DataFrame:
    """(anchor, score, id, other) for each task: its ``k`` best rows of an anchor's label beside the anchor."""
    sent = table.sparkSession.sparkContext.broadcast(anchors)

    def work(blocks) -> Iterator[list]:
        a = sent.value
        best = {int(r): _Best(k) for r in a["rid"]}
        for rid, vec, label, q, cells in blocks:
            for y in np.unique(a["label"]):
                mine, rows = np.flatnonzero(a["label"] == y), np.flatnonzero(label == y)
                for start in range(0, len(mine) if len(rows) else 0, _ANCHORS):
                    some = mine[start : start + _ANCHORS]
                    tables, span = bound_tables(a["q"][some], *edges)
                    low = lower_bounds(tables, cells[:, rows])
                    for i, m in enumerate(some):
                        b, other = best[int(a["rid"][m])], rid[rows] != a["rid"][m]
                        need = _floor(b.floor(), _kth(low[i][other], k))
                        hit = rows[other & (low[i] + span[i] >= need)]
                        b.add(q[hit].astype(np.int64) @ a["q"][m], vec[hit], rid[hit])
        yield from _emit({(r,): b for r, b in best.items()})

    return _scan(table, dim, "anchor long, score long, id long, other long", work)


def negatives(table: DataFrame, dim: int, anchors: dict, edges: tuple, n: int, window: tuple[int, int]) -> DataFrame:
    """(anchor, positive_score, score, id, other) for each task: its ``n`` best rows of other labels in each window."""
    sent = table.sparkSession.sparkContext.broadcast(anchors)
    least, most = window

    def work(blocks) -> Iterator[list]:
        a = sent.value
        ends = {p: (-(-least * p // 100), most * p // 100) for s in a["scores"] for p in s}
        best = {(int(r), p): _Best(n) for r, s in zip(a["rid"], a["scores"]) for p in s if ends[p][0] <= ends[p][1]}
        for rid, vec, label, q, cells in blocks:
            for start in range(0, len(a["rid"]), _ANCHORS):
                stop = min(start + _ANCHORS, len(a["rid"]))
                tables, span = bound_tables(a["q"][start:stop], *edges)
                low = lower_bounds(tables, cells)
                for m in range(start, stop):
                    lo, anchor, differ = low[m - start], int(a["rid"][m]), label != a["label"][m]
                    hi, scored = lo + span[m - start], {}
                    for p in a["scores"][m]:
                        b = best.get((anchor, p))
                        if b is None:
                            continue
                        bottom, top = ends[p]
                        sure = lo[differ & (lo >= bottom) & (hi <= top)]
                        need = max(bottom, _floor(b.floor(), _kth(sure, n)))
                        hit = np.flatnonzero(differ & (hi >= need) & (lo <= top))
                        fresh = [h for h in hit.tolist() if h not in scored]
                        scored.update(zip(fresh, (q[fresh].astype(np.int64) @ a["q"][m]).tolist()))
                        score = np.array([scored[h] for h in hit.tolist()], np.int64)
                        within = (score >= bottom) & (score <= top)
                        b.add(score[within], vec[hit[within]], rid[hit[within]])
        yield from _emit(best)

    return _scan(table, dim, "anchor long, positive_score long, score long, id long, other long", work)


def _first(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of what tasks found, by score, id and row, with their rank."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "id", "other")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def mine(
    vectors: DataFrame, is_anchor: Column, k: int = 5, n: int = 10, window: tuple[int, int] = (30, 90), scale: int = 256, block_anchors: int = 32_768
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Negatives have a score of ``window`` percent of the positive's. ``is_anchor`` is a condition on
    vec_id and label.
    """
    table, dim = whole_rows(vectors, scale)
    known = lambda c: F.when(F.col(c) != _LAST, F.col(c))
    spark = vectors.sparkSession
    done = []
    chosen = table.filter(is_anchor)
    count = chosen.count() if dim else 0
    if count:
        edges = cell_edges(table, dim)
        table = written(approximated(table, dim, *edges), "approximations")
    blocks = -(-count // block_anchors)
    for i in range(blocks):
        block = table.filter(is_anchor & (F.pmod(F.xxhash64("rid"), F.lit(blocks)) == i)).select("rid", "vec_id", "label", "q").collect()
        if not block:
            continue
        anchors = {"rid": np.array([r.rid for r in block], np.int64), "label": np.array([r.label for r in block], np.int64), "q": np.array([np.frombuffer(r.q, "<i4") for r in block], np.int64)}
        found = written(_first(positives(table, dim, anchors, edges, k), ["anchor"], k), "positives")
        scores: dict[int, list[int]] = {}
        for r in found.select("anchor", "score").distinct().orderBy("anchor", F.desc("score")).collect():
            scores.setdefault(r.anchor, []).append(r.score)
        anchors["scores"] = [scores.get(int(r), []) for r in anchors["rid"]]
        hard = _first(negatives(table, dim, anchors, edges, n, window), ["anchor", "positive_score"], n).withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).drop("other")
        ids = spark.createDataFrame([(r.rid, r.vec_id) for r in block], "anchor long, anchor_id long")
        pairs = found.select("anchor", F.col("score").alias("positive_score"), F.col("id").alias("positive_id"))
        met = pairs.join(hard, ["anchor", "positive_score"]).join(F.broadcast(ids), "anchor")
        done.append(written(met.select("anchor_id", known("positive_id").alias("positive_id"), "rank", known("negative_id").alias("negative_id"), "positive_score", "negative_score"), "negatives"))
    if not done:
        none = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        return spark.createDataFrame([], none)
    return spark.read.schema(done[0].schema).parquet(*[f for d in done for f in {p.rsplit("/", 1)[0] for p in d.inputFiles()}])
