"""Entries of large JSON objects, found in ranges of bytes.

A file holds one object, on one line or many. Whether a range begins inside a string, and how deep,
depends on all bytes before it. A first pass gives for each range the number of its quotes and its
change of depth, for either case; a sum over the ranges of a file, one row each, decides. A second
pass then finds the entries whose first byte lies in its range and reads each to its end.

Paths are those of pyarrow's file systems (a mount, or a URI that executors can open).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship_package
from ..storage import written
from .npy import _filesystem

_STEP = 1 << 20


def _ranges(spark: SparkSession, path: str, split: int) -> DataFrame:
    """(file, start, stop) of all files; only sizes are read."""
    from pyarrow import fs

    store, place = _filesystem(path)
    info = store.get_file_info(place)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    # the parts that Spark writes as text are files of this kind too
    inside = [f for f in store.get_file_info(fs.FileSelector(place)) if f.base_name[0] not in "._"] if info.type == fs.FileType.Directory else [info]
    files = spark.createDataFrame([(f.path, f.size) for f in inside if f.size], "file string, size long")
    cut = files.select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(size - 1) div {split}"))).alias("k"))
    return cut.select("file", (F.col("k") * split).alias("start"), F.least("size", (F.col("k") + 1) * split).alias("stop")).repartition("file", "start")


def _unescaped(f, start: int, data: bytes) -> np.ndarray:
    """Places of quotes in ``data`` that no backslash escapes; those before ``start`` are looked up."""
    odd, at = 0, start
    while at > 0:
        back = f.read_at(min(4096, at), at - min(4096, at))
        run = len(back) - len(back.rstrip(b"\\"))
        odd, at = odd + run, at - run
        if run < len(back):
            break
    raw = np.frombuffer(data, np.uint8)
    slash = raw == 0x5C
    place = np.arange(len(raw))
    last = np.maximum.accumulate(np.where(slash, -1, place)) if len(raw) else place
    # backslashes right before each byte; a run that reaches the start goes on with those before it
    before = np.empty(len(raw), np.int64)
    if len(raw):
        before[0] = odd
        run = place[:-1] - last[:-1]
        before[1:] = np.where(last[:-1] >= 0, run, place[:-1] + 1 + odd)
    return (raw == 0x22) & (before % 2 == 0)


def _depths(raw: np.ndarray, quotes: np.ndarray, inside: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each byte is outside strings, and the depth after it."""
    outside = (inside + np.cumsum(quotes)) % 2 == 0
    change = np.isin(raw, (0x7B, 0x5B)).astype(np.int64) - np.isin(raw, (0x7D, 0x5D))
    return outside, np.cumsum(np.where(outside, change, 0))


def _stats(rows: DataFrame, path: str) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _filesystem(path)
        for b in batches:
            out = []
            for name, start, stop in zip(*(c.to_pylist() for c in b.columns)):
                with store.open_input_file(name) as f:
                    data = f.read_at(stop - start, start)
                    quotes = _unescaped(f, start, data)
                raw = np.frombuffer(data, np.uint8)
                ends = [int(_depths(raw, quotes, h)[1][-1]) for h in (0, 1)]
                out.append((name, start, stop, int(quotes.sum()), *ends))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 0 else pa.int64()) for k, c in enumerate(zip(*out))] if out else [pa.array([], pa.string() if k == 0 else pa.int64()) for k in range(6)], names=["file", "start", "stop", "quotes", "d0", "d1"])

    return rows.mapInArrow(count, "file string, start long, stop long, quotes long, d0 long, d1 long")


def entries(spark: SparkSession, path: str, split: int = 32 << 20) -> DataFrame:
    """(entry): the text '"key": value' of each entry of each file's object."""
    ship_package(spark)
    stats = written(_stats(_ranges(spark, path, split), path), "json-ranges")
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    placed = stats.withColumn("inside", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
    placed = placed.withColumn("d", F.when(F.col("inside") == 1, F.col("d1")).otherwise(F.col("d0")))
    placed = placed.select("file", "start", "stop", "inside", F.coalesce(F.sum("d").over(earlier), F.lit(0)).alias("depth"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _filesystem(path)
        for b in batches:
            for name, start, stop, inside, depth in zip(*(c.to_pylist() for c in b.columns)):
                with store.open_input_file(name) as f:
                    yield pa.RecordBatch.from_arrays([pa.array(list(_starting(f, start, stop, inside, depth)), pa.string())], names=["entry"])

    return written(placed, "json-places").repartition("file", "start").mapInArrow(find, "entry string")


def _starting(f, start: int, stop: int, inside: int, depth: int) -> Iterator[str]:
    """Entries that begin in [start, stop): after the object's brace or a comma at its level."""
    data = f.read_at(stop - start, start)
    raw = np.frombuffer(data, np.uint8)
    outside, levels = _depths(raw, _unescaped(f, start, data), inside)
    levels = levels + depth
    comma = outside & (raw == 0x2C) & (levels == 1)
    heads = np.flatnonzero(comma | (outside & (raw == 0x7B) & (levels == 1)))
    ends = np.flatnonzero(comma | (outside & (raw == 0x7D) & (levels == 0)))
    for h in heads.tolist():
        k = np.searchsorted(ends, h, side="right")
        if k < len(ends):
            text = data[h + 1 : ends[k]]
        else:
            rest, at, q, level = [data[h + 1 :]], stop, (inside + _quotes(f, start, data)) % 2, int(levels[-1])
            while more := f.read_at(_STEP, at):
                part = np.frombuffer(more, np.uint8)
                quotes = _unescaped(f, at, more)
                out, deep = _depths(part, quotes, q)
                deep = deep + level
                hit = np.flatnonzero(out & (((part == 0x2C) & (deep == 1)) | ((part == 0x7D) & (deep == 0))))
                rest.append(more[: hit[0]] if len(hit) else more)
                if len(hit):
                    break
                at, q, level = at + len(more), (q + int(quotes.sum())) % 2, int(deep[-1])
            text = b"".join(rest)
        if text.strip():
            yield text.decode()


def _quotes(f, start: int, data: bytes) -> int:
    return int(_unescaped(f, start, data).sum())


def object_lines(rows: DataFrame) -> DataFrame:
    """(value): the lines of one object for each partition of ``rows`` (entry)."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for b in batches:
            out = []
            for e in b.column(0).to_pylist():
                out.append(("{" if first else ",") + e)
                first = False
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array([] if first else ["}"], pa.string())], names=["value"])

    return rows.mapInArrow(lines, "value string")
