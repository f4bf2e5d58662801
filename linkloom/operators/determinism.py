"""Sampling by hash order: the same draw in every engine and for every partitioning."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship_package
from ..storage import written


def hash_order(seed: int | str, *keys: str | Column) -> Column:
    """md5 of seed and keys; sorting by it is a seeded shuffle."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k if isinstance(k, Column) else F.col(k) for k in keys]))


def hash_number(seed: int | str, *keys: str | Column) -> Column:
    """A non-negative integer below 2**32 from the hash."""
    return F.conv(F.substring(hash_order(seed, *keys), 1, 8), 16, 10).cast("long")


#: Up to here a sample is one top-k of bounded size.
TOP_K = 10_000


def take_hashed(df: DataFrame, k: int, seed: int, *keys: str) -> DataFrame:
    """Exactly the first ``k`` rows (or all) in hash order of ``keys``, without replacement.

    A large sample is not gathered in one place: counts of the leading hash digits (at most 65,536)
    say which digits go whole, and only rows with the digits at the border are ordered.
    """
    h = hash_order(seed, *keys)
    if k <= TOP_K:
        return df.orderBy(h, *keys).limit(max(0, k))
    lead = F.substring(h, 1, 4)
    counts = sorted(tuple(r) for r in df.groupBy(lead.alias("lead")).count().collect())
    before = 0
    for digits, n in counts:
        if before + n > k:
            border = df.filter(lead == digits).orderBy(h, *keys).limit(k - before)
            return df.filter(lead < digits).unionByName(border)
        before += n
    return df


def ranked(df: DataFrame, out: str, *order: str | Column) -> DataFrame:
    """``df`` with its place from 0 in a total order.

    Rows are range-sorted and written with their place in their partition; the rows before a
    partition are a sum over partitions. No task sees all rows.
    """
    placed = written(df.sort(*order).withColumn("__m", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__m", 33)
    sizes = placed.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("__p", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__b"))
    met = placed.withColumn("__p", part).join(F.broadcast(before), "__p")
    place = F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__b")
    return met.select(*[F.col(f"`{c}`") for c in df.columns], place.cast("long").alias(out))


def running_sums(df: DataFrame, order: list[str | Column], sums: dict[str, str]) -> DataFrame:
    """``df`` with inclusive running sums (name: column) in a total order. No task sees all rows:
    sums run within range-sorted partitions, to which the totals of the partitions before are added."""
    placed = written(df.sort(*order).withColumn("__m", F.monotonically_increasing_id()), "running").withColumn("__p", F.shiftright("__m", 33))
    totals = placed.groupBy("__p").agg(*[F.sum(c).alias(f"__t{i}") for i, c in enumerate(sums.values())])
    earlier = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("__p", *[F.coalesce(F.sum(f"__t{i}").over(earlier), F.lit(0)).alias(f"__b{i}") for i in range(len(sums))])
    inner = Window.partitionBy("__p").orderBy("__m").rowsBetween(Window.unboundedPreceding, 0)
    own = placed.select("*", *[F.sum(c).over(inner).alias(f"__s{i}") for i, c in enumerate(sums.values())])
    met = own.join(F.broadcast(before), "__p")
    return met.select(*[F.col(f"`{c}`") for c in df.columns], *[(F.col(f"__s{i}") + F.col(f"__b{i}")).alias(n) for i, n in enumerate(sums)])


def permuted_cells(j: str, n_left: int, n_right: int, seed: int) -> tuple[Column, Column]:
    """Cell (left, right) of the number in column ``j`` of a grid in a seeded order, in which each cell comes once.

    Four rounds in which one coordinate moves by a hash of the other: each can be undone, so the
    order is a permutation for any grid, and none is written down.
    """
    left, right = F.expr(f"`{j}` div {n_right}"), F.col(j) % n_right
    for r in (1, 3):
        left = (left + hash_number(f"{seed}:{r}", right)) % n_left
        right = (right + hash_number(f"{seed}:{r + 1}", left)) % n_right
    return left, right


def hash_numbers(seed: int | str, values: np.ndarray) -> np.ndarray:
    """`hash_number` of seed and each of the integers."""
    lead = f"{seed}:".encode()
    return np.frombuffer(b"".join([md5(b"%b%d" % (lead, v)).digest() for v in values.tolist()]), ">u4")[::4].astype(np.int64)


def permuted(df: DataFrame, n_left: int, n_right: int, seed: int, back: bool = False) -> DataFrame:
    """(__j, __li, __ri): the cells of `permuted_cells` of the numbers ``__j``, or, ``back``, the numbers of cells.

    The digests are made in Arrow workers: as columns, Spark repeats them in the filters it adds below joins.
    """
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if back:
                x, y = (b.column(k).to_numpy() for k in range(2))
                l, r = x, y
                for k in (3, 1):
                    r = (r - hash_numbers(f"{seed}:{k + 1}", l)) % n_right
                    l = (l - hash_numbers(f"{seed}:{k}", r)) % n_left
                j = l * n_right + r
            else:
                j = b.column(0).to_numpy()
                x, y = j // n_right, j % n_right
                for k in (1, 3):
                    x = (x + hash_numbers(f"{seed}:{k}", y)) % n_left
                    y = (y + hash_numbers(f"{seed}:{k + 1}", x)) % n_right
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (j, x, y)], names=["__j", "__li", "__ri"])

    return df.select(*(["__li", "__ri"] if back else ["__j"])).mapInArrow(run, "__j long, __li long, __ri long")


def downsample_negatives(df: DataFrame, label: str, neg_multiple: int, seed: int, *keys: str) -> DataFrame:
    """All rows with label 1 and ``neg_multiple`` times as many others; all of those if they are fewer."""
    positives = df.filter(F.col(label) == 1)
    wanted = positives.count() * neg_multiple
    return positives.unionByName(take_hashed(df.filter(F.col(label) != 1), wanted, seed, *keys))


def permute_column(df: DataFrame, column: str, seed: int, key: str) -> DataFrame:
    """``column`` dealt to other rows: the row of rank i in key order gets the value of hash rank i."""
    own = ranked(df, "__r", key)
    dealt = ranked(df.select(key, F.col(column).alias("__v")), "__r", hash_order(seed, key), key).select("__r", "__v")
    return own.join(dealt, "__r").withColumn(column, F.col("__v")).drop("__r", "__v")
