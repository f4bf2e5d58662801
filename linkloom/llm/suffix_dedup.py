"""Suffix-array de-duplication: bytes of passages that an earlier document also holds are removed.

A byte goes if a window of `WINDOW` bytes over it also starts in a document with a smaller id.

0. Rows are gathered in chunks of about `CHUNK_BYTES` of text, each one row of a bucketed table. A row
   is known by its chunk and its place in it; later steps join by chunk without moving texts again.
1. Every window has a key, the least hash of its `GRAM`-byte grams: equal windows have equal keys.
   Each chunk sends the distinct hashes of its keys to key ranges, whose number grows with the
   corpus, and gets back which of them other texts hold too. No task and no broadcast holds a
   filter of the whole corpus, and none fills up.
2. A key that more than `HOT_TEXTS` texts hold is hot: its windows go one by one to the shards of
   their own hashes. What surrounds a common passage is spread so, and the passage is sent once a chunk.
   Chunks form parts of about `FAN_IN`. With more than one part, the smallest id of a hot window is taken
   within each part, then over the parts, and goes back the same way: no task meets a row of every chunk.
3. Runs of windows with one shared key go to the shard of that key as short regions, once for each
   content and chunk, with the smallest id there. Places stay in the chunk, so a common passage
   costs a region for each chunk and not for each document.
4. In a shard, a region that alone has its key, and a window whose hash no other content there has,
   needs no sorting. All suffixes of what is left are sorted by external induction (`induced_sort`).
   Suffixes that share `WINDOW` bytes with their neighbours are one group; its smallest id decides
   each window. Chunks get back the spans of their regions that earlier documents hold.
5. Chunks cut the spans out of every place of their regions and digest the texts.

Copies of a text within one chunk are judged by its smallest id there, the others are removed whole
(each window starts in that one too).

Defined cases: null text is empty; null ids come after every id, so they remove nothing of others,
and of equal texts with null ids none removes the other; rows that share an id, repeated rows too,
never remove each other's bytes; texts shorter than a window keep everything; a text of any length
lies in one chunk; of equal windows the smallest id stays, whatever their order; extra columns are
ignored by `repeated_passages` and kept by `cut_repeats`, under any names; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, bucketed, shuffle_partitions, spare_name, written
from .induced_sort import sorted_suffixes

WINDOW = 50
GRAM = 24
MAX_RUN = 64
#: The windows of a key that more texts hold are sent one by one.
HOT_TEXTS = 1000
NO_ID = np.iinfo(np.int64).max
#: Text bytes of a chunk, of one range of the key exchange, of one shard, and of a bucket of chunks.
CHUNK_BYTES = 8 << 20
RANGE_BYTES = 48 << 20
SHARD_BYTES = 8 << 20
BUCKET_BYTES = 64 << 20
#: Chunks whose hot windows are merged in one step.
FAN_IN = 1000
BLOCK_BYTES = 1 << 18
SEPARATOR = b"\xff"  # never a byte of UTF-8


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _slide(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each ``width`` neighbours."""
    step = 1
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


_FACTOR = 0x9E3779B97F4A7C15


@lru_cache(4)
def _powers(factor: int, n: int) -> np.ndarray:
    """1, factor, factor ** 2, .. modulo 2 ** 64."""
    out = np.ones(n, np.uint64)
    k = 1
    while k < n:
        out[k : 2 * k] = out[: min(k, n - k)] * np.uint64(pow(factor, k, 1 << 64))
        k *= 2
    return out


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from each place of ``data``: differences of a running polynomial."""
    n = len(data)
    room = 1 << n.bit_length()
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_FACTOR, room)[:n], out=total[1:])
    h = total[size:] - total[:-size]
    h *= _powers(pow(_FACTOR, -1, 1 << 64), room)[: len(h)]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    return h


def window_keys(data: np.ndarray) -> np.ndarray:
    """Key of the window at each place of ``data`` where one fits (at least `WINDOW` bytes)."""
    return _slide(gram_hashes(data, GRAM), WINDOW - GRAM + 1)


def key_runs(sizes: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, windows, key) of runs of windows with one key, for texts laid end to end."""
    none = np.zeros(0, np.int64)
    if len(data) < WINDOW:
        return none, none, none, none.astype(np.uint64)
    keys = window_keys(data)
    ends = np.cumsum(sizes)
    fits = np.zeros(len(data) + 1, np.int32)
    long_ = sizes >= WINDOW
    np.add.at(fits, (ends - sizes)[long_], 1)
    np.add.at(fits, (ends - WINDOW + 1)[long_], -1)
    valid = np.cumsum(fits[: len(keys)]) > 0
    before = np.concatenate([[False], valid[:-1]])
    changed = np.concatenate([[True], keys[1:] != keys[:-1]])
    edge = np.flatnonzero((valid & (~before | changed)) | (before & ~valid))
    edge = np.append(edge, len(keys))
    start, stop = edge[:-1], edge[1:]
    run = valid[start]
    start, stop = start[run], stop[run]
    pieces = -(-(stop - start) // MAX_RUN)
    if len(pieces) and pieces.max() > 1:
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start, stop = np.repeat(start, pieces) + nth * MAX_RUN, np.repeat(stop, pieces)
        stop = np.minimum(stop, start + MAX_RUN)
    text = np.searchsorted(ends, start, side="right")
    return text, start - (ends - sizes)[text], stop - start, keys[start]


def codes_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Range (upper 32 bits) and value in it (lower 32 bits) of hashes."""
    h = _mix(hashes ^ np.uint64(0x5851F42D4C957F2D))
    low = np.uint64(0xFFFFFFFF)
    return (((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)) << np.uint64(32) | _mix(h) & low


def _shards_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((_mix(keys) >> np.uint64(17)) % np.uint64(shards)).astype(np.int64)


def _squeeze(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 1)


def _spread(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def _nth(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. for each of ``counts``, one after another."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _heads(x: np.ndarray) -> np.ndarray:
    """Places where a run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


# chunks

CHUNK = "chunk long, rows binary"


def _chunker(text_at: int, most: int):
    def pack(chunk: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_table(pa.Table.from_batches(held).combine_chunks())
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "rows"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.column(text_at).nbytes
            if size >= most:
                yield pack(chunk, held)
                held, size, chunk = [], 0, chunk + 1
        if held:
            yield pack(chunk, held)

    return gather


class Chunk:
    """The distinct texts of a chunk with the rows that hold them, and the runs of their keys."""

    def __init__(self, chunk: int, rows: pa.Table, id_at: int, text_at: int):
        self.chunk, self.rows = chunk, rows
        ids = rows.column(id_at).to_pylist()
        owners: dict[bytes, list[int]] = {}
        self.ids = np.array([NO_ID if i is None else i for i in ids], np.int64)
        for k, t in enumerate(rows.column(text_at).to_pylist()):
            owners.setdefault((t or "").encode(), []).append(k)
        self.texts, self.owners = list(owners), list(owners.values())
        self.low = np.array([self.ids[o].min() for o in self.owners], np.int64)

    def find_runs(self, keep_bytes: bool = True) -> Chunk:
        """Runs of windows with one key: text, first window, windows, key, and place in the chunk's bytes."""
        found: list[list[np.ndarray]] = [[], [], [], [], []]
        self.blocks: list[tuple[int, np.ndarray]] = []
        at = 0
        for texts, offsets, parts in self._blocks():
            sizes, data = np.array([len(x) for x in parts]), np.frombuffer(b"".join(parts), np.uint8)
            piece, start, windows, keys = key_runs(sizes, data)
            if keep_bytes:
                self.blocks.append((at, data))
            place = at + (np.cumsum(sizes) - sizes)[piece] + start
            for out, x in zip(found, (np.array(texts)[piece], start + np.array(offsets)[piece], windows, keys, place)):
                out.append(x)
            at += len(data)
        kinds = (np.int64, np.int64, np.int64, np.uint64, np.int64)
        self.text, self.start, self.windows, self.keys, self.place = (np.concatenate(x) if x else np.zeros(0, k) for x, k in zip(found, kinds))
        return self

    def _blocks(self) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
        """Pieces of texts (number, offset, bytes), about `BLOCK_BYTES` together; pieces of one text
        overlap by what lets each window lie in one of them."""
        texts, offsets, parts, size = [], [], [], 0
        for t, data in enumerate(self.texts):
            for a in range(0, len(data) - WINDOW + 1, BLOCK_BYTES):
                part = data[a : a + BLOCK_BYTES + WINDOW - 1]
                texts.append(t)
                offsets.append(a)
                parts.append(part)
                size += len(part)
                if size >= BLOCK_BYTES:
                    yield texts, offsets, parts
                    texts, offsets, parts, size = [], [], [], 0
        if parts:
            yield texts, offsets, parts

    def windows_of(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(run, start, hash) of each window of ``runs``, which ascend."""
        run, nth = np.repeat(runs, self.windows[runs]), _nth(self.windows[runs])
        place, hashes = self.place[run] + nth, np.zeros(len(run), np.uint64)
        for at, data in self.blocks:
            a, e = np.searchsorted(place, [at, at + len(data)])
            if a < e:
                hashes[a:e] = gram_hashes(data, WINDOW)[place[a:e] - at]
        return run, self.start[run] + nth, hashes

    def regions(self, flags: dict[int, bytes], ranges: int) -> Regions:
        """Runs whose key other texts hold, and the single windows of runs whose key is hot."""
        flag = flags_of(codes_of(self.keys, ranges), flags)
        runs = np.flatnonzero(flag == 1)
        run, start, hashes = self.windows_of(np.flatnonzero(flag == 2))
        join = lambda x, y: np.concatenate([x, y])
        return Regions(self, join(self.text[runs], self.text[run]), join(self.start[runs], start), join(self.windows[runs], np.ones(len(run), np.int64)), join(self.keys[runs], hashes), len(runs))


class Regions:
    """Distinct region contents of a chunk, the smallest id of each, and all places they have there."""

    def __init__(self, chunk: Chunk, text: np.ndarray, start: np.ndarray, windows: np.ndarray, keys: np.ndarray, hot_from: int):
        texts = chunk.texts
        self.text, self.start, self.size = text, start, windows + WINDOW - 1
        number: dict[bytes, int] = {}
        setdefault = number.setdefault
        of = [setdefault(texts[t][a:e], len(number)) for t, a, e in zip(text.tolist(), start.tolist(), (start + self.size).tolist())]
        self.contents, self.region = list(number), np.array(of, np.int64)
        self.keys = np.zeros(len(self.contents), np.uint64)
        self.keys[self.region] = keys
        self.hot = np.zeros(len(self.contents), bool)  # equal windows have one key, so all places of a content agree
        self.hot[self.region[hot_from:]] = True
        self.low = np.full(len(self.contents), NO_ID, np.int64)
        np.minimum.at(self.low, self.region, chunk.low[text])

    def by_shard(self, shards: int, hot_at: int) -> Iterator[tuple[int, np.ndarray]]:
        """Numbers of the regions of each shard, ascending; shards of hot windows count from ``hot_at``."""
        shard = _shards_of(self.keys, shards) + hot_at * self.hot
        order = np.argsort(shard, kind="stable")
        heads = _heads(shard[order])
        for a, e in zip(heads, np.append(heads[1:], len(order))):
            yield int(shard[order[a]]), order[a:e]

    def places(self, chunk: Chunk, shards: int, hot_at: int) -> np.ndarray:
        """(text, start, size, shard, number in the shard's regions, later) of each place, as columns.

        A place is later if its text has a larger id than the region's first one in the chunk.
        """
        shard, number = np.zeros(len(self.contents), np.int64), np.zeros(len(self.contents), np.int64)
        for s, own in self.by_shard(shards, hot_at):
            shard[own], number[own] = s, np.arange(len(own))
        order = np.lexsort((self.start, self.text))
        later = chunk.low[self.text] > self.low[self.region]
        return np.stack([self.text, self.start, self.size, shard[self.region], number[self.region], later]).astype("<u4")[:, order]


def _read_chunk(rows: pa.Table, id_at: int, text_at: int) -> Chunk:
    with pa.ipc.open_stream(rows.column("rows")[0].as_py()) as stream:
        return Chunk(rows.column("chunk")[0].as_py(), stream.read_all(), id_at, text_at)


# the exchange of hashes

HASHES = "hash_range long, chunk long, values binary, counts binary"
FLAGS = "chunk long, hash_range long, flags binary"


def hash_rows(chunk: int, text: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
    """A row a range: the distinct values there, ascending, and how many texts of the chunk hold each."""
    order = np.lexsort((text, codes))
    code, text = codes[order], text[order]
    heads = _heads(code)
    fresh = np.concatenate([[True], (code[1:] != code[:-1]) | (text[1:] != text[:-1])]) if len(code) else np.zeros(0, bool)
    texts = np.minimum(np.add.reduceat(fresh.astype(np.int64), heads), 65535) if len(code) else heads
    code = code[heads]
    ranges = code >> np.uint64(32)
    values = (code & np.uint64(0xFFFFFFFF)).astype("<u4")
    cuts = _heads(ranges)
    rows = [(int(ranges[a]), chunk, _squeeze(np.diff(values[a:e], prepend=np.uint32(0))), _squeeze(texts[a:e].astype("<u2"))) for a, e in zip(cuts, np.append(cuts[1:], len(code)))]
    columns = list(zip(*rows)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["hash_range", "chunk", "values", "counts"])


def _flagger(hot_texts: int):
    def flag(table: pa.Table) -> pa.Table:
        """For each chunk of one range, 1 for values that two texts hold and 2 for hot ones."""
        values = [np.cumsum(_spread(v, "<u4"), dtype="<u4") for v in table.column("values").to_pylist()]
        each = np.concatenate(values)
        counts = np.concatenate([_spread(c, "<u2") for c in table.column("counts").to_pylist()]).astype(np.int64)
        order = np.argsort(each, kind="stable")
        heads = _heads(each[order])
        total = np.add.reduceat(counts[order], heads)
        kind = (total > 1).astype(np.uint8) + (total > hot_texts).astype(np.uint8)
        flags = np.empty(len(each), np.uint8)
        flags[order] = np.repeat(kind, np.diff(np.append(heads, len(each))))
        ends = np.cumsum([len(v) for v in values])
        rows = []
        for chunk, a, e in zip(table.column("chunk").to_pylist(), ends - [len(v) for v in values], ends):
            part = flags[a:e]
            if part.any():
                rows.append((chunk, table.column("hash_range")[0].as_py(), _squeeze(part)))
        columns = list(zip(*rows)) if rows else [[]] * 3
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary()))], names=["chunk", "hash_range", "flags"])

    return flag


def flags_of(codes: np.ndarray, flags: dict[int, bytes]) -> np.ndarray:
    """Flag of each code, from the flags of its range; a range without flags has none set."""
    code, back = np.unique(codes, return_inverse=True)
    out = np.zeros(len(code), np.uint8)
    ranges = code >> np.uint64(32)
    heads = _heads(ranges)
    for a, e in zip(heads, np.append(heads[1:], len(code))):
        found = flags.get(int(ranges[a]))
        if found is not None:
            out[a:e] = _spread(found, np.uint8)
    return out[back]


# shards

_SHARD = "shard long, chunk long, regions binary, sizes binary, marks binary, ids binary, places binary"
_SHARD_NAMES = [c.split()[0] for c in _SHARD.split(", ")]
#: Shard of the row that carries the places of a chunk.
_PLACES = -1
_SPANS = "chunk long, shard long, spans binary"


def least_ids(contents: np.ndarray, sizes: np.ndarray, ids: np.ndarray, budget: int) -> np.ndarray:
    """For each byte of the regions (each followed by a separator) the smallest id that holds its window.

    ``ids`` is the smallest id of each region. Places without a window keep the largest number.
    """
    ends = np.cumsum(sizes + 1)
    starts = ends - sizes - 1
    least = np.full(len(contents), NO_ID, np.int64)
    open_at: list[np.ndarray] = []  # a group may go on in the next block

    def id_of(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether a window fits at each place, and the id of its region if it does."""
        owner = np.searchsorted(ends, members, side="right")
        fits = members - starts[owner] <= sizes[owner] - WINDOW
        return fits, np.where(fits, ids[owner], NO_ID)

    def close(members: np.ndarray) -> None:
        if len(members):
            fits, value = id_of(members)
            least[members[fits]] = value.min()

    for suffixes, prefixes in sorted_suffixes(contents, WINDOW, budget):
        heads = np.flatnonzero(prefixes < WINDOW)
        if not len(heads):
            open_at.append(suffixes)
            continue
        open_at.append(suffixes[: heads[0]])
        close(np.concatenate(open_at))
        inner = suffixes[heads[0] : heads[-1]]
        if len(inner):
            group = heads[:-1] - heads[0]
            fits, value = id_of(inner)
            low = np.minimum.reduceat(value, group)
            least[inner[fits]] = np.repeat(low, np.diff(np.append(group, len(inner))))[fits]
        open_at = [suffixes[heads[-1] :]]
    if open_at:
        close(np.concatenate(open_at))
    return least


def least_of_windows(regions: list[bytes], marks: np.ndarray, low: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """First window of each of the distinct ``regions``, and for all windows the smallest id that holds them.

    ``low`` is the smallest id of each region; ``marks`` are equal for regions with equal keys.
    """
    windows = np.array([len(r) for r in regions], np.int64) - WINDOW + 1
    first = np.cumsum(windows) - windows
    least = np.repeat(low, windows)
    _, group, members = np.unique(marks, return_inverse=True, return_counts=True)
    judged = np.flatnonzero(members[group] > 1) if len(regions) else np.zeros(0, np.int64)
    if not len(judged):
        return first, least
    # windows whose hash another one has, in runs
    region, nth = np.repeat(judged, windows[judged]), _nth(windows[judged])
    ends = np.cumsum(windows[judged] + WINDOW - 1)
    hashes = np.empty(len(region), np.uint64)
    at = 0
    for a in range(0, len(judged), 2048):
        part = judged[a : a + 2048]
        data = np.frombuffer(b"".join([regions[i] for i in part.tolist()]), np.uint8)
        start = ends[a : a + len(part)] - (windows[part] + WINDOW - 1) - (ends[a - 1] if a else 0)
        n = int(windows[part].sum())
        hashes[at : at + n] = gram_hashes(data, WINDOW)[np.repeat(start, windows[part]) + _nth(windows[part])]
        at += n
    order = np.argsort(hashes)
    same = hashes[order[1:]] == hashes[order[:-1]]
    shared = np.zeros(len(region), bool)
    shared[order[1:][same]] = shared[order[:-1][same]] = True
    hit = np.flatnonzero(shared)
    region, nth = region[hit], nth[hit]
    head = np.flatnonzero(np.concatenate([[True], (region[1:] != region[:-1]) | (nth[1:] != nth[:-1] + 1)])) if len(hit) else hit
    count = np.diff(np.append(head, len(hit)))
    owner, start = region[head], nth[head]
    # what is left of each region, again once a content
    number: dict[bytes, int] = {}
    content = np.array([number.setdefault(regions[r][a : a + n + WINDOW - 1], len(number)) for r, a, n in zip(owner.tolist(), start.tolist(), count.tolist())], np.int64)
    parts = list(number)
    part_low = np.full(len(parts), NO_ID, np.int64)
    np.minimum.at(part_low, content, low[owner])
    part_mark = np.zeros(len(parts), marks.dtype)
    part_mark[content] = marks[owner]
    part_windows = np.array([len(x) for x in parts], np.int64) - WINDOW + 1
    part_first = np.cumsum(part_windows) - part_windows
    part_least = np.repeat(part_low, part_windows)
    _, group, members = np.unique(part_mark, return_inverse=True, return_counts=True)
    sort = np.flatnonzero(members[group] > 1) if len(parts) else np.zeros(0, np.int64)
    if len(sort):
        sizes = part_windows[sort] + WINDOW - 1
        joined = np.frombuffer(SEPARATOR.join([*[parts[i] for i in sort.tolist()], b""]), np.uint8)
        found = least_ids(joined, sizes, part_low[sort], budget)
        base = np.cumsum(sizes + 1) - sizes - 1
        n = part_windows[sort]
        part_least[np.repeat(part_first[sort], n) + _nth(n)] = found[np.repeat(base, n) + _nth(n)]
    least[np.repeat(first[owner] + start, count) + _nth(count)] = part_least[np.repeat(part_first[content], count) + _nth(count)]
    return first, least


def shard_spans(regions: list[bytes], marks: np.ndarray, holder: np.ndarray, ids: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, start, end) of the bytes of held regions that a smaller id than the holder's holds too.

    ``regions`` are distinct; ``marks`` are equal for regions with equal keys. ``holder`` is the region
    of each place and ``ids`` the smallest id there.
    """
    sizes = np.array([len(r) for r in regions], np.int64)
    low = np.full(len(sizes), NO_ID, np.int64)
    np.minimum.at(low, holder, ids)
    first_window, least = least_of_windows(regions, marks, low, budget)
    some = np.zeros(len(sizes), bool)  # regions with a window of a smaller id
    some[np.searchsorted(first_window, np.flatnonzero(least < np.repeat(low, sizes - WINDOW + 1)), side="right") - 1] = True
    later = ids > low[holder]
    whole = np.flatnonzero(later)
    out = [(whole, np.zeros(len(whole), np.int64), sizes[holder[whole]])]
    first = np.flatnonzero(~later & some[holder])
    windows = sizes[holder[first]] - WINDOW + 1
    nth = _nth(windows)
    hit = np.flatnonzero(least[np.repeat(first_window[holder[first]], windows) + nth] < np.repeat(ids[first], windows))
    if len(hit):
        which = np.repeat(np.arange(len(first)), windows)[hit]
        a = np.flatnonzero(np.concatenate([[True], (np.diff(hit) != 1) | (np.diff(which) != 0)]))
        b = np.append(a[1:], len(hit)) - 1
        out.append((first[which[a]], nth[hit[a]], nth[hit[b]] + WINDOW))
    return tuple(np.concatenate(x) for x in zip(*out))


def same_regions(contents: bytes, sizes: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Number of each region among the distinct ones, and those in order."""
    distinct: dict[bytes, int] = {}
    ends = np.cumsum(sizes, dtype=np.int64)
    number = [distinct.setdefault(contents[a:b], len(distinct)) for a, b in zip((ends - sizes).tolist(), ends.tolist())]
    return np.array(number, np.int64), list(distinct)


def _sorter(budget: int):
    def sort(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        sizes = [_spread(r["sizes"], "<u2") for r in rows]
        number, distinct = same_regions(b"".join([zstandard.decompress(r["regions"]) for r in rows]), np.concatenate(sizes))
        marks = np.zeros(len(distinct), "<u4")
        marks[number] = np.concatenate([np.frombuffer(r["marks"], "<u4") for r in rows])
        place, start, end = shard_spans(distinct, marks, number, np.concatenate([_spread(r["ids"], "<i8") for r in rows]), budget)
        ends = np.cumsum([len(s) for s in sizes])
        row = np.searchsorted(ends, place, side="right")
        order = np.lexsort((start, place))
        out = []
        for part in np.split(order, _heads(row[order])[1:]) if len(order) else ():
            k = row[part[0]]
            spans = np.stack([place[part] - (ends[k] - len(sizes[k])), start[part], end[part]]).astype("<u4")
            out.append((rows[k]["chunk"], rows[k]["shard"], _squeeze(spans)))
        columns = list(zip(*out)) if out else [[]] * 3
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary()))], names=["chunk", "shard", "spans"])

    return sort


# hot windows of many chunks

_MERGED = "shard long, part long, regions binary, ids binary"
_LEAST = "shard long, part long, least binary"


def _merged(rows: list[dict], by: str) -> tuple[list[dict], list[np.ndarray], list[np.ndarray], list[bytes], np.ndarray]:
    """Rows in order of ``by``, the ids and window numbers of each, the distinct windows and their smallest ids."""
    rows = sorted(rows, key=lambda r: r[by])
    ids = [_spread(r["ids"], "<i8") for r in rows]
    number, distinct = same_regions(b"".join([zstandard.decompress(r["regions"]) for r in rows]), np.full(sum(map(len, ids)), WINDOW))
    low = np.full(len(distinct), NO_ID, np.int64)
    np.minimum.at(low, number, np.concatenate(ids))
    return rows, ids, np.split(number, np.cumsum([len(x) for x in ids])[:-1]), distinct, low


def _merge_part(table: pa.Table) -> pa.Table:
    """The distinct hot windows of one shard and part, with the smallest id of each."""
    rows, _, _, distinct, low = _merged(table.to_pylist(), "chunk")
    columns = [rows[0]["shard"]], [rows[0]["part"]], [zstandard.compress(b"".join(distinct), 1)], [_squeeze(low.astype("<i8"))]
    return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["shard", "part", "regions", "ids"])


def _merge_parts(table: pa.Table) -> pa.Table:
    """For the windows of each part of one shard, in the part's order, the smallest id in any part."""
    rows, _, numbers, _, low = _merged(table.to_pylist(), "part")
    columns = [r["shard"] for r in rows], [r["part"] for r in rows], [_squeeze(low[n].astype("<i8")) for n in numbers]
    return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary()))], names=["shard", "part", "least"])


def _part_spans(table: pa.Table, answers: pa.Table) -> pa.Table:
    """For each chunk of one shard and part, its windows that a smaller id holds."""
    rows, ids, numbers, _, _ = _merged(table.to_pylist(), "chunk")
    least = _spread(answers.column("least")[0].as_py(), "<i8")
    out = []
    for r, own, number in zip(rows, ids, numbers):
        hit = np.flatnonzero(least[number] < own)
        if len(hit):
            out.append((r["chunk"], r["shard"], _squeeze(np.stack([hit, np.zeros(len(hit), np.int64), np.full(len(hit), WINDOW)]).astype("<u4"))))
    columns = list(zip(*out)) if out else [[]] * 3
    return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary()))], names=["chunk", "shard", "spans"])


def hot_spans(hot: DataFrame, parts: int) -> DataFrame:
    """Spans of the hot windows of ``hot``: up to parts of chunks, over the parts, and back to the chunks."""
    hot = hot.withColumn("part", F.pmod(F.xxhash64("chunk"), F.lit(parts)))
    up = written(hot.groupBy("shard", "part").applyInArrow(_merge_part, _MERGED), "passage-parts")
    least = up.groupBy("shard").applyInArrow(_merge_parts, _LEAST)
    return hot.groupBy("shard", "part").cogroup(least.groupBy("shard", "part")).applyInArrow(_part_spans, _SPANS)


# cuts


def removed_runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by intervals; touching ones are one run."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    head = np.concatenate([[True], starts[1:] > ends[:-1]])
    return starts[head], ends[np.append(np.flatnonzero(head)[1:], len(starts)) - 1]


def kept_bytes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    at, out = 0, []
    for a, b in zip(starts.tolist(), ends.tolist()):
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def chunk_cuts(chunk: Chunk, places: np.ndarray, spans: dict[int, bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Removed runs of each row of a chunk, from the spans that shards returned for its regions."""
    text, start, size, shard, number, later = places.astype(np.int64)
    found = [(s, *_spread(data, "<u4").reshape(3, -1).astype(np.int64)) for s, data in sorted(spans.items())]
    region = np.concatenate([np.zeros(0, np.int64), *[s << 32 | k for s, k, _, _ in found]])
    order = np.argsort(region, kind="stable")
    region, a, e = region[order], *(np.concatenate([np.zeros(0, np.int64), *[f[i] for f in found]])[order] for i in (2, 3))
    whole, first = np.flatnonzero(later), np.flatnonzero(later == 0)
    own = shard[first] << 32 | number[first]
    lo, hi = np.searchsorted(region, own), np.searchsorted(region, own, side="right")
    place, span = np.repeat(first, hi - lo), np.repeat(lo, hi - lo) + _nth(hi - lo)
    texts = np.concatenate([text[whole], text[place]])
    starts = np.concatenate([start[whole], start[place] + a[span]])
    ends = np.concatenate([start[whole] + size[whole], start[place] + e[span]])
    order = np.argsort(texts, kind="stable")
    runs = {int(texts[p[0]]): removed_runs(starts[p], ends[p]) for p in np.split(order, _heads(texts[order])[1:])} if len(order) else {}
    none = (np.zeros(0, np.int64),) * 2
    cuts = [none] * chunk.rows.num_rows
    for t, owners in enumerate(chunk.owners):
        n = len(chunk.texts[t])
        for row in owners:
            if chunk.ids[row] == chunk.low[t]:
                cuts[row] = runs.get(t, none)
            elif n >= WINDOW:
                cuts[row] = np.array([0]), np.array([n])
    return cuts


class _Answers:
    """What came back to a chunk: flags of keys, spans of shards, and its own places."""

    def __init__(self, table: pa.Table):
        self.by_kind: list[dict[int, bytes]] = [{}, {}, {}]
        for kind, at, data in zip(*(table.column(n).to_pylist() for n in ("kind", "at", "data"))):
            self.by_kind[kind][at] = data


def _answers(flags: DataFrame, kind: int, at: str, data: str) -> DataFrame:
    return flags.select(F.lit(kind).alias("kind"), "chunk", F.col(at).alias("at"), F.col(data).alias("data"))


def _run(docs: DataFrame, finish, result, budget: int) -> DataFrame:
    """``finish(chunk, cuts)`` makes the result's rows of a chunk."""
    spark = bounded_batches(docs.sparkSession)
    text_at, id_at = docs.columns.index("text"), len(docs.columns)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges, shards = max(1, total // RANGE_BYTES), max(1, total // SHARD_BYTES)
    parts = max(1, total // (CHUNK_BYTES * FAN_IN))
    hot_at = shards if parts > 1 else 0
    rows = docs.withColumn(spare_name(docs.columns, "id"), F.col("doc_id").cast("long"))
    chunks = bucketed(rows.mapInArrow(_chunker(text_at, CHUNK_BYTES), CHUNK), "chunks", "chunk", max(shuffle_partitions(spark), total // BUCKET_BYTES))

    def key_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                c = _read_chunk(pa.Table.from_batches([b.slice(k, 1)]), id_at, text_at).find_runs(keep_bytes=False)
                found = hash_rows(c.chunk, c.text, codes_of(c.keys, ranges))
                del c
                pa.default_memory_pool().release_unused()
                yield found

    def cogrouped(answers: DataFrame, f, schema) -> DataFrame:
        """``f`` of each chunk and what came back to it; chunks to which nothing did included."""
        return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(f, schema)

    hashes = chunks.mapInArrow(key_hashes, HASHES)
    flags = written(hashes.groupBy("hash_range").applyInArrow(_flagger(HOT_TEXTS), FLAGS), "passage-flags")

    def regions(rows: pa.Table, answers: pa.Table) -> pa.Table:
        c, found = _read_chunk(rows, id_at, text_at).find_runs(), _Answers(answers)
        r = c.regions(found.by_kind[0], ranges)
        out = [(_PLACES, c.chunk, None, None, None, None, _squeeze(r.places(c, shards, hot_at)))] if len(r.text) else []
        for shard, own in r.by_shard(shards, hot_at):
            contents = [r.contents[i] for i in own.tolist()]
            out.append((shard, c.chunk, zstandard.compress(b"".join(contents), 1), _squeeze(np.array([len(x) for x in contents], "<u2")), r.keys[own].astype("<u4").tobytes(), _squeeze(r.low[own].astype("<i8")), None))
        columns = list(zip(*out)) if out else [[]] * 7
        del c, r
        pa.default_memory_pool().release_unused()
        return pa.table([pa.array(x, pa.int64() if i < 2 else pa.binary()) for i, x in enumerate(columns)], names=_SHARD_NAMES)

    shipped = written(cogrouped(_answers(flags, 0, "hash_range", "flags"), regions, _SHARD), "passage-regions")
    sent = shipped.filter(F.col("shard") >= 0).drop("places")
    if parts > 1:
        sorted_, hot = sent.filter(F.col("shard") < hot_at), sent.filter(F.col("shard") >= hot_at)
        spans = sorted_.groupBy("shard").applyInArrow(_sorter(budget), _SPANS).unionByName(hot_spans(hot, parts))
    else:
        spans = sent.groupBy("shard").applyInArrow(_sorter(budget), _SPANS)
    places = shipped.filter(F.col("shard") == _PLACES)

    def cut(rows: pa.Table, answers: pa.Table) -> pa.Table:
        c, found = _read_chunk(rows, id_at, text_at), _Answers(answers)
        own = found.by_kind[2].get(_PLACES)
        return finish(c, chunk_cuts(c, _spread(own, "<u4").reshape(6, -1) if own else np.zeros((6, 0), "<u4"), found.by_kind[1]))

    return cogrouped(_answers(spans, 1, "shard", "spans").unionByName(_answers(places, 2, "shard", "places")), cut, result)


def repeated_passages(docs: DataFrame, budget: int = 128 << 20) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row."""
    names, kinds = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], [pa.int64()] * 4 + [pa.string()]

    def digest(c: Chunk, cuts: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
        out: list = [None] * len(cuts)
        for t, owners in zip(c.texts, c.owners):
            for row in owners:
                starts, ends = cuts[row]
                out[row] = (len(t), int((ends - starts).sum()), len(starts), hashlib.sha256(kept_bytes(t, starts, ends)).hexdigest())
        columns = list(zip(*out)) if out else [[]] * 4
        return pa.table([c.rows.column(c.rows.num_columns - 1), *[pa.array(x, k) for x, k in zip(columns, kinds[1:])]], names=names)

    return _run(docs.select("doc_id", "text"), digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", budget)


def cut_repeats(docs: DataFrame, budget: int = 128 << 20) -> DataFrame:
    """Rows of ``docs``, all columns, without the removed bytes; n_chars follows the text."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema])
    arrow, names, text_at = to_arrow_schema(schema), docs.columns, docs.columns.index("text")

    def edit(c: Chunk, cuts: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
        texts = c.rows.column(text_at).to_pylist()
        for row, (starts, ends) in enumerate(cuts):
            if len(starts):
                # a character that lost some of its bytes goes whole; what is left of two is no third one
                data = texts[row].encode()
                texts[row] = "".join(data[a:b].decode("utf-8", "ignore") for a, b in zip([0, *ends.tolist()], [*starts.tolist(), len(data)]))
        columns = [c.rows.column(i) for i in range(len(names))]
        columns[text_at] = pa.array(texts, pa.string())
        if "n_chars" in names and pa.types.is_integer(arrow.field("n_chars").type):
            columns[names.index("n_chars")] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
        return pa.table(columns, names=names).cast(arrow)

    return _run(docs, edit, schema, budget)
