"""Token ids in a range-ANS file format, written and read back through Spark.

A file is one Parquet row per segment: the ids of whole documents, a shared frequency table,
and independent blocks. A block interleaves `LANES` coder states, keeps decoder checkpoints
(states and word position) and has a CRC-32 of its ids, so blocks, and spans between
checkpoints, decode in parallel and damage is found where it lies.

Defined cases: null text is empty and has only the end id; null ids sort first; rows that share
an id are kept as separate rows in a stable order by text, repeated rows too; a text longer than a
segment is one segment of several blocks; columns beside doc_id and text are ignored; an empty table
gives an empty store.
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

PRECISION = 18
LANES = 4096
BLOCK_IDS = 1 << 20
CHECKPOINT_STEPS = 128
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)


class BlockDamaged(ValueError):
    pass


def frequency_table(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and their frequencies, at least 1 each, that add up to 2**PRECISION."""
    tally = np.bincount(ids, minlength=1)
    symbols = np.flatnonzero(tally)
    counts = tally[symbols]
    total = 1 << PRECISION
    spare = total - len(symbols)
    share = np.floor(counts * (spare / counts.sum())).astype(np.int64)
    share[np.argmax(counts)] += spare - share.sum()
    return symbols.astype("<u2"), (share + 1).astype("<u4")


class Coder:
    def __init__(self, symbols: np.ndarray, freqs: np.ndarray):
        self.symbols = symbols
        self.freq = freqs.astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(freqs, dtype=np.uint64)[:-1]]).astype(np.uint64)
        self._slots: np.ndarray | None = None
        self._dense = np.zeros(1 << 16, np.int32)
        self._dense[symbols] = np.arange(len(symbols))

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.symbols), dtype=np.int32), self.freq.astype(np.int64))
        return self._slots

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
        """(words, checkpoint states, checkpoint word positions) of one block."""
        steps = -(-len(ids) // LANES)
        index = np.zeros(steps * LANES, np.int64)
        index[: len(ids)] = self._dense[ids]
        freq, cum = self.freq[index].reshape(steps, LANES), self.cum[index].reshape(steps, LANES)
        limit = freq << np.uint64(63 - PRECISION)
        x = np.full(LANES, _LOW, np.uint64)
        out: list[np.ndarray] = []
        marks: list[tuple[int, np.ndarray]] = []
        emitted = marked = 0  # a step may emit nothing, so words are counted and not steps
        for s in range(steps - 1, -1, -1):
            full = x >= limit[s]
            if full.any():
                out.append(x[full].astype(np.uint32))
                emitted += len(out[-1])
                x = np.where(full, x >> _WORD, x)
            q = x // freq[s]
            x = (q << np.uint64(PRECISION)) + (x - q * freq[s]) + cum[s]
            if s % CHECKPOINT_STEPS == 0:
                marks.append((emitted - marked, x.copy()))
                marked = emitted
        words = np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)
        sizes, states = [m[0] for m in marks[::-1]], [m[1] for m in marks[::-1]]
        at = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if sizes else np.zeros(0)
        return words.astype("<u4").tobytes(), np.concatenate(states).astype("<u8").tobytes() if states else b"", at.astype("<u4").tobytes()

    def decode_span(self, words: np.ndarray, state: np.ndarray, at: int, steps: int) -> np.ndarray:
        """Ids of ``steps`` steps from a checkpoint."""
        x, out = state.astype(np.uint64), np.empty((steps, LANES), np.int32)
        mask = np.uint64((1 << PRECISION) - 1)
        slots, freq, cum = self.slots, self.freq, self.cum
        for s in range(steps):
            slot = x & mask
            k = slots[slot.astype(np.int64)]
            out[s] = k
            x = freq[k] * (x >> np.uint64(PRECISION)) + slot - cum[k]
            low = x < _LOW
            n = int(np.count_nonzero(low))
            if n:
                if at + n > len(words):
                    raise BlockDamaged("a block's words end early")
                x[low] = (x[low] << _WORD) | words[at : at + n]
                at += n
        return self.symbols[out.ravel()]

    def decode(self, words: bytes, states: bytes, positions: bytes, n_ids: int, crc: int) -> np.ndarray:
        stream = np.frombuffer(words, "<u4").astype(np.uint64)
        state = np.frombuffer(states, "<u8").reshape(-1, LANES)
        steps = -(-n_ids // LANES)
        spans = [
            self.decode_span(stream, state[c], int(at), min(CHECKPOINT_STEPS, steps - c * CHECKPOINT_STEPS))
            for c, at in enumerate(np.frombuffer(positions, "<u4"))
        ]
        ids = (np.concatenate(spans) if spans else np.zeros(0, "<u2"))[:n_ids]
        if zlib.crc32(np.ascontiguousarray(ids, "<u2").tobytes()) != crc:
            raise BlockDamaged("a block's ids do not match its checksum")
        return ids


_BLOCK = pa.struct([("n_ids", pa.int64()), ("crc32", pa.int64()), ("words", pa.binary()), ("states", pa.binary()), ("positions", pa.binary())])
SEGMENT_ARROW = pa.schema(
    [
        ("part", pa.int64()),
        ("segment", pa.int64()),
        ("before", pa.int64()),
        ("n_ids", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("doc_tokens", pa.list_(pa.int64())),
        ("symbols", pa.binary()),
        ("freqs", pa.binary()),
        ("blocks", pa.list_(_BLOCK)),
    ]
)
SEGMENT = (
    "part long, segment long, before long, n_ids long, doc_ids array<long>, doc_tokens array<long>, symbols binary, freqs binary, "
    "blocks array<struct<n_ids: long, crc32: long, words: binary, states: binary, positions: binary>>"
)


def pack_segment(part: int, segment: int, before: int, doc_ids: list, parts: list[bytes]) -> dict:
    ids = np.frombuffer(b"".join(parts), "<u2")
    symbols, freqs = frequency_table(ids)
    coder = Coder(symbols, freqs)
    blocks = []
    for a in range(0, len(ids), BLOCK_IDS):
        block = ids[a : a + BLOCK_IDS]
        words, states, positions = coder.encode(block)
        blocks.append({"n_ids": len(block), "crc32": zlib.crc32(block.tobytes()), "words": words, "states": states, "positions": positions})
    return {
        "part": part, "segment": segment, "before": before, "n_ids": len(ids), "doc_ids": doc_ids, "doc_tokens": [len(p) // 2 for p in parts],
        "symbols": symbols.tobytes(), "freqs": freqs.tobytes(), "blocks": blocks,
    }


def unpack_segment(row: dict) -> np.ndarray:
    coder = Coder(np.frombuffer(row["symbols"], "<u2"), np.frombuffer(row["freqs"], "<u4"))
    ids = [coder.decode(b["words"], b["states"], b["positions"], b["n_ids"], b["crc32"]) for b in row["blocks"]]
    return np.concatenate(ids) if ids else np.zeros(0, "<u2")


def _writer(vocabulary: str, end_id: int, segment_ids: int):
    end = end_id.to_bytes(2, "little")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder = TaskContext.get().partitionId(), worker_encoder(vocabulary, True)
        ids: list = []
        parts: list[bytes] = []
        size = segment = before = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([pack_segment(part, segment, before, ids, parts)], schema=SEGMENT_ARROW)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                parts.append(encoder.encode(text.as_py()) + end)
                ids.append(doc_id)
                size += len(parts[-1]) // 2
                if size >= segment_ids:
                    yield flush()
                    ids, parts, size, segment, before = [], [], 0, segment + 1, before + size
        if ids:
            yield flush()

    return write


def write_tokens(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 2, segment_ids: int = 1 << 21) -> DataFrame:
    """The token store of ``docs``, in ascending doc_id order over parts, segments and documents.

    Texts are range-partitioned by id, and within an id by a hash of the text, before they are encoded: a
    part is a contiguous id range, and rows without an id or of one repeated id spread over parts.
    A segment holds whole documents and closes at ``segment_ids`` ids, so a task holds one segment.
    """
    bounded_batches(docs.sparkSession)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = ("doc_id", F.xxhash64("text"))
    ordered = ordered.repartitionByRange(parts_for(ordered), *order).sortWithinPartitions(*order, "text")
    return written(ordered.mapInArrow(_writer(vocabulary, end_id, segment_ids), SEGMENT), "token-store")


def read_tokens(store: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the store.

    A segment says how many ids its part has before it; the driver adds one total for each part,
    as many as there are partitions.
    """
    spark = bounded_batches(store.sparkSession)
    totals = sorted(tuple(r) for r in store.groupBy("part").agg(F.sum("n_ids")).collect())
    base, total = {}, 0
    for part, n in totals:
        base[part], total = total, total + n

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                ids = unpack_segment(row).astype("<u4")
                tokens = np.array(row["doc_tokens"], np.int64)
                ends = np.cumsum(tokens)
                crcs = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends.tolist(), tokens.tolist())]
                start = base[row["part"]] + row["before"] + ends - tokens
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(start, pa.int64()), pa.array(tokens, pa.int64()), pa.array(crcs, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return store.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
