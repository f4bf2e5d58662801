"""Packing along a Hilbert curve: neighbours in a projected document space share sequences.

A document's hashed token vector is projected to `DIMS` signed sums; their signs of deviation,
quantised, give a Hilbert key. Documents are range-sorted by that key, and each range task fills
sequences of `capacity` ids one after another, cutting documents where a sequence is full. The
end of a range is cut into sequences whose lengths are powers of two, which need no padding.

Defined cases: null text is empty and yields one piece with the end id only; rows that share an
id are packed separately, repeated rows too; null ids are kept as null; documents of one key follow
each other by id and ids; a document longer than a sequence is cut into as many as it needs; columns
beside doc_id and text are ignored; an empty table gives no piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, parts_for, written
from .subwords import worker_encoder

DIMS, BITS = 4, 8


def projection(seed: int, n_ids: int = 1 << 16) -> np.ndarray:
    """A Gaussian row for each token id: hashing an id is looking up its row."""
    return np.random.default_rng(seed).standard_normal((n_ids, DIMS)).astype(np.float32)


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of integer points (rows) on the Hilbert curve, by Skilling's transposition (2004)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(high, x[0] ^ (q - 1), x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros(x.shape[1], np.int64), 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for v in x:
            key = key << 1 | ((v ^ t) >> b & 1)
    return key


def curve_keys(ids: list[bytes], table: np.ndarray) -> np.ndarray:
    """Keys of documents of at least one id each. The direction of a document's summed rows is
    quantised, not its length, which only says how long the document is."""
    if not ids:
        return np.zeros(0, np.int64)
    size = np.fromiter(map(len, ids), np.int64, len(ids)) >> 1
    v = np.add.reduceat(table[np.frombuffer(b"".join(ids), "<u2")], np.cumsum(size) - size, axis=0).astype(np.float64)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    v /= np.where(norm == 0, 1, norm)
    return hilbert_keys(np.minimum((1 << BITS) - 1, ((v + 1) / 2 * (1 << BITS)).astype(np.int64)))


def sequence_sizes(total: int, capacity: int) -> list[int]:
    """Full sequences of ``capacity`` ids; the rest is cut into powers of two, largest first."""
    rest = total % capacity
    return [capacity] * (total // capacity) + [1 << b for b in range(capacity.bit_length(), -1, -1) if rest >> b & 1]


def pieces(lengths: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, ...]:
    """(document, place, length, sequence, offset) arrays for documents laid end to end over sequences of
    ``sizes``: a piece ends where a document or a sequence does. Ids behind the last sequence have none."""
    documents, sequences = np.cumsum(lengths), np.cumsum(np.array(sizes, np.int64))
    top = int(sequences[-1]) if len(sizes) else 0
    ends = np.union1d(documents[documents <= top], sequences)
    place = np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(ends)]
    sequence = np.searchsorted(sequences, place, side="right")
    return np.searchsorted(documents, place, side="right"), place, ends - place, sequence, place - (sequences - sizes)[sequence]


def _encoder(vocabulary: str, end_id: int, seed: int):
    end = end_id.to_bytes(2, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, table = worker_encoder(vocabulary, lower=False), projection(seed)
        for batch in batches:
            ids = [encoder.encode(t.as_py()) + end for t in batch.column(1)]
            keys = curve_keys(ids, table)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "curve", "ids"])

    return encode


def _packer(capacity: int, window_ids: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 40
        held: list[tuple] = []  # doc_id, ids, how many of them are packed
        size = 0

        def rows(last: bool) -> pa.RecordBatch:
            nonlocal sequence, held, size
            # a window that is not the last packs whole sequences only; the cut document's rest stays
            sizes = sequence_sizes(size if last else size - size % capacity, capacity)
            total, done = np.array([len(h[1]) // 2 for h in held]), np.array([h[2] for h in held])
            ends = np.cumsum(total - done)
            d, place, length, seq, offset = pieces(total - done, sizes)
            start = place - (ends - total)[d]
            crcs = []
            for k, a, n in zip(d.tolist(), start.tolist(), length.tolist()):
                crcs.append(zlib.crc32(np.frombuffer(held[k][1], "<u2", n, 2 * a).astype("<u4")))
            columns = [pa.array([held[k][0] for k in d.tolist()], pa.int64()), *[pa.array(c, pa.int64()) for c in (start, length, crcs, total[d], sequence + seq, offset)]]
            used = sum(sizes)
            sequence += len(sizes)
            held = [(h[0], h[1], max(h[2], t - (e - used))) for h, t, e in zip(held, total.tolist(), ends.tolist()) if e > used]
            size -= used
            return pa.RecordBatch.from_arrays(columns, schema=PIECES_ARROW)

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.append((doc_id, ids, 0))
                size += len(ids) // 2
            if size >= window_ids:
                yield rows(last=False)
        if size:
            yield rows(last=True)

    return pack


PIECES_ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(
    docs: DataFrame, capacity: int = 1024, vocabulary: str = "byte_bpe_50k.json", end_id: int = 0, seed: int = 7, window_ids: int = 1 << 20
) -> DataFrame:
    """One row per piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Ids are written once before the range sort, which would otherwise encode every text twice (for
    its bounds and for its rows). The id breaks ties of the curve key, so equal keys can be split.
    """
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    coded = written(source.mapInArrow(_encoder(vocabulary, end_id, seed), "doc_id long, curve long, ids binary"), "pack-ids")
    ordered = coded.repartitionByRange(parts_for(coded), "curve", "doc_id").sortWithinPartitions("curve", "doc_id", "ids")
    return ordered.select("doc_id", "ids").mapInArrow(_packer(capacity, window_ids), PIECES)
