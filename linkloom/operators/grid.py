"""All pairs of vectors on a block grid, reduced within each cell to what a query needs of them.

Rows fall into hash blocks; two blocks meet in one cell, and a row goes to as many cells as there are
blocks. A cell works through its matrix in strips and gives pairs, the best pairs of each row, the
extent of the values, counts of bins or a forest of the graph of near pairs. Only that leaves the
task, so what crosses the network grows with rows and blocks, not with pairs.

Products of matrices may differ in the last bits for equal vectors at different places. Where values
are ordered, pairs near the border are scored again, component by component, so equal vectors tie.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship_package

#: Values of a matrix that are computed at once.
STRIP = 1 << 20
#: Values nearer than this may have been put in the wrong order by a product of matrices.
MARGIN = 1e-9
#: Up to so many blocks are made of a small table, so that its cells occupy the cluster.
SPREAD, LEAST_ROWS, BLOCK_ROWS = 24, 1024, 8192


def block_count(rows: int, block_rows: int | None) -> int:
    if block_rows is not None:
        return max(1, -(-rows // block_rows))
    return max(1, -(-rows // BLOCK_ROWS), min(SPREAD, -(-rows // LEAST_ROWS)))


def vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column as a matrix; a null component is nan, and lists of different lengths are an error."""
    parts = []
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if not len(chunk):
            continue
        sizes = chunk.value_lengths().to_numpy(zero_copy_only=False)
        if chunk.null_count or (sizes != sizes[0]).any():
            raise ValueError("vectors must be there and have equal lengths")
        parts.append(chunk.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(chunk), int(sizes[0])))
    return np.concatenate(parts)


class Side:
    """Rows of one block: ids, matrices of the vector columns, other columns."""

    def __init__(self, table: pa.Table, columns: list[str], others: list[str]):
        self.id = table.column("id").to_numpy()
        self.v = {c: vectors(table.column(c)) for c in columns}
        self.of = {c: table.column(c).to_numpy(zero_copy_only=False) for c in others}

    def __len__(self) -> int:
        return len(self.id)

    def take(self, at) -> Side:
        out = object.__new__(Side)
        out.id, out.v, out.of = self.id[at], {c: v[at] for c, v in self.v.items()}, {c: v[at] for c, v in self.of.items()}
        return out

    def strips(self, width: int) -> Iterator[Side]:
        step = max(1, STRIP // max(1, width))
        for k in range(0, len(self), step):
            yield self.take(slice(k, k + step))


Cell = Callable[[Side, Side, bool], Iterator[pa.RecordBatch]]


def on_grid(df: DataFrame, id_col: str, columns: list[str], cell: Cell, schema: str, others: tuple[str, ...] = (), block_rows: int | None = None) -> DataFrame:
    """What ``cell`` gives of each pair of blocks (left, right, whether they are one), in any number of batches."""
    ship_package(df.sparkSession)
    blocks = block_count(df.count(), block_rows)
    kept = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    vector = lambda c: F.col(c) if kept[c] == "array<float>" else F.col(c).cast("array<double>").alias(c)
    b = F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int").alias("b")
    own = df.select(F.col(id_col).cast("long").alias("id"), *[vector(c) for c in columns], *others, b)
    placed = own.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    placed = placed.select("id", *columns, *others, "b", (F.least("b", "o").cast("long") * blocks + F.greatest("b", "o")).alias("cell"))
    names = list(others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        at = table.column("cell")[0].as_py()
        first, last = divmod(at, blocks)
        block = table.column("b").to_numpy()
        left = Side(table.filter(pa.array(block == first)), columns, names) if (block == first).any() else None
        if first == last:
            yield from cell(left, left, True)
        elif left is not None and (block == last).any():
            yield from cell(left, Side(table.filter(pa.array(block == last)), columns, names), False)

    return placed.groupBy("cell").applyInArrow(run, schema)


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], names=list(columns))


Kernel = Callable[[np.ndarray, np.ndarray], np.ndarray]


def pairs(df: DataFrame, id_col: str, values: dict[str, tuple[str, Kernel]], keep: Callable[[dict[str, np.ndarray]], np.ndarray] | None = None, same: str | None = None, block_rows: int | None = None) -> DataFrame:
    """(i, j, values), i < j: each value is a kernel on a vector column.

    Only pairs stay that ``keep`` says, which gets the matrices by name, and whose ``same`` column is equal, if given.
    """

    def cell(left: Side, right: Side, one: bool) -> Iterator[pa.RecordBatch]:
        for part in left.strips(len(right)):
            s = {name: f(part.v[v], right.v[v]) for name, (v, f) in values.items()}
            kept = part.id[:, None] < right.id[None, :] if one else np.ones((len(part), len(right)), bool)
            if same is not None:
                kept &= part.of[same][:, None] == right.of[same][None, :]
            if keep is not None:
                kept &= keep(s)
            x, y = np.nonzero(kept)
            i, j = part.id[x], right.id[y]
            yield _batch(i=np.minimum(i, j), j=np.maximum(i, j), **{name: m[x, y] for name, m in s.items()})

    columns = list(dict.fromkeys(v for v, _ in values.values()))
    return on_grid(df, id_col, columns, cell, "i long, j long, " + ", ".join(f"{n} double" for n in values), (same,) if same else (), block_rows)


def cross(left: DataFrame, right: DataFrame, left_id: str, right_id: str, vec: str, kernel: Kernel, block_rows: int | None = None) -> DataFrame:
    """(l, r, sim) of every row of ``left`` with every row of ``right``, on a grid of blocks of both."""
    ship_package(left.sparkSession)
    nl, nr = (block_count(t.count(), block_rows) for t in (left, right))

    def side(df: DataFrame, key: str, own: int, other: int, rows: bool) -> DataFrame:
        kind = "array<float>" if df.schema[vec].dataType.simpleString() == "array<float>" else "array<double>"
        b = F.pmod(F.xxhash64(key), F.lit(own))
        placed = df.select(F.col(key).cast("long").alias("id"), F.col(vec).cast(kind).alias("v"), b.alias("b"), F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias("o"))
        return placed.select("id", "v", F.lit(rows).alias("rows"), (F.col("b") * nr + F.col("o") if rows else F.col("o") * nr + F.col("b")).alias("cell"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        of = table.column("rows").to_numpy(zero_copy_only=False).astype(bool)
        if of.any() and not of.all():
            there = Side(table.filter(pa.array(~of)), ["v"], [])
            for part in Side(table.filter(pa.array(of)), ["v"], []).strips(len(there)):
                s = kernel(part.v["v"], there.v["v"])
                yield _batch(l=np.repeat(part.id, len(there)), r=np.tile(there.id, len(part)), sim=s.ravel())

    both = side(left, left_id, nl, nr, True).unionByName(side(right, right_id, nr, nl, False))
    return both.groupBy("cell").applyInArrow(run, "l long, r long, sim double")


def extent(df: DataFrame, id_col: str, vec: str, kernel: Kernel, block_rows: int | None = None) -> tuple[float | None, float | None]:
    """The least and the largest value over all pairs; none of a table of one row."""

    def cell(left: Side, right: Side, one: bool) -> Iterator[pa.RecordBatch]:
        for part in left.strips(len(right)):
            s = kernel(part.v[vec], right.v[vec])
            if one:
                s = s[part.id[:, None] < right.id[None, :]]
            if s.size:
                yield _batch(lo=np.array([np.fmin.reduce(s, axis=None)]), hi=np.array([s.max()]))

    return tuple(on_grid(df, id_col, [vec], cell, "lo double, hi double", (), block_rows).agg(F.min("lo"), F.max("hi")).first())


def binned(df: DataFrame, id_col: str, vec: str, kernel: Kernel, bins: Callable[[np.ndarray], np.ndarray], block_rows: int | None = None) -> DataFrame:
    """(bin, n): how many pairs fall into each bin, counted in the cells first."""

    def cell(left: Side, right: Side, one: bool) -> Iterator[pa.RecordBatch]:
        for part in left.strips(len(right)):
            s = kernel(part.v[vec], right.v[vec])
            found, n = np.unique(bins(s[part.id[:, None] < right.id[None, :]] if one else s.ravel()), return_counts=True)
            yield _batch(bin=found.astype(np.int64), n=n.astype(np.int64))

    return on_grid(df, id_col, [vec], cell, "bin long, n long", (), block_rows).groupBy("bin").agg(F.sum("n").alias("n"))


def joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root`` (each node's least linked node) after the edges a-b."""
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != (up := root[root])).any():
            root = up
    return root


def near_forest(df: DataFrame, id_col: str, vec: str, kernel: Kernel, near: Callable[[np.ndarray], np.ndarray], block_rows: int | None = None) -> DataFrame:
    """(a, b): edges that connect what the pairs that ``near`` marks connect, at most one a row of each cell."""

    def cell(left: Side, right: Side, one: bool) -> Iterator[pa.RecordBatch]:
        ids = left.id if one else np.concatenate([left.id, right.id])
        root, shift, before = np.arange(len(ids)), 0 if one else len(left), 0
        for part in left.strips(len(right)):
            x, y = np.nonzero(near(kernel(part.v[vec], right.v[vec])))
            root = joined(root, x + before, y + shift)
            before += len(part)
        child = np.nonzero(root != np.arange(len(ids)))[0]
        yield _batch(a=ids[child], b=ids[root[child]])

    return on_grid(df, id_col, [vec], cell, "a long, b long", (), block_rows)


def cosine_rows(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of rows x of ``a`` and y of ``b``, summed in order of components."""

    def dot(p: np.ndarray, q: np.ndarray, i, j) -> np.ndarray:
        total = np.zeros(len(p[i, 0]))
        for c in range(p.shape[1]):
            total += p[i, c] * q[j, c]
        return total

    every = slice(None)
    size = np.sqrt(dot(a, a, every, every))[x] * np.sqrt(dot(b, b, every, every))[y]
    return np.divide(dot(a, b, x, y), size, out=np.zeros(len(x)), where=size != 0)


def best(df: DataFrame, id_col: str, vec: str, k: int, kernel: Kernel, exact: Callable = cosine_rows, query: str | None = None, target: str | None = None, same: str | None = None, differ: str | None = None, block_rows: int | None = None) -> DataFrame:
    """(a, b, sim, rank): the ``k`` largest values of each row with others, ties by the smaller id.

    Rows marked by ``query`` look for rows marked by ``target`` (all, if not given) whose ``same``
    column is equal and whose ``differ`` column is not. A cell gives at most ``k`` rows for each of its rows.
    """

    def looked(left: Side, right: Side, one: bool) -> Iterator[pa.RecordBatch]:
        q = left.take(np.nonzero(left.of[query])[0]) if query else left
        t = right.take(np.nonzero(right.of[target])[0]) if target else right
        if not len(q) or not len(t):
            return
        at = min(k, len(t))
        for part in q.strips(len(t)):
            s = kernel(part.v[vec], t.v[vec])
            s[np.isnan(s)] = np.inf
            barred = part.id[:, None] == t.id[None, :] if one else np.zeros(s.shape, bool)
            if same:
                barred |= part.of[same][:, None] != t.of[same][None, :]
            if differ:
                barred |= part.of[differ][:, None] == t.of[differ][None, :]
            s[barred] = -np.inf
            border = s.max(axis=1) if at == 1 else np.partition(s, len(t) - at, axis=1)[:, len(t) - at]
            x, y = np.nonzero((s >= border[:, None] - MARGIN) & (s > -np.inf))
            value = exact(part.v[vec], t.v[vec], x, y)
            order = np.lexsort((t.id[y], -np.where(np.isnan(value), np.inf, value), x))
            x, y, value = x[order], y[order], value[order]
            place = np.arange(len(x)) - np.searchsorted(x, x)
            x, y, value = x[place < k], y[place < k], value[place < k]
            yield _batch(a=part.id[x], b=t.id[y], sim=value)

    def cell(left: Side, right: Side, one: bool) -> Iterator[pa.RecordBatch]:
        yield from looked(left, right, one)
        if not one:
            yield from looked(right, left, one)

    others = tuple(dict.fromkeys(c for c in (query, target, same, differ) if c))
    found = on_grid(df, id_col, [vec], cell, "a long, b long, sim double", others, block_rows)
    w = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
