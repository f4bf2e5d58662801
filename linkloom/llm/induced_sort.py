"""Suffix sorting by external induction, with capped common-prefix values.

Suffixes are sorted as in SA-IS: the left-most S suffixes are named and sorted by recursion, then
one scan up through queues induces the L suffixes and one scan down the S suffixes. The queues are
the priority queue of the method: one FIFO a leading byte, taken in byte order; a FIFO that
outgrows the memory budget continues in a scratch file of the task, removed when the sort ends.
Entries carry a suffix and its common prefix with the entry before it. The common prefix of an
induced neighbour pair is one more than the least value scanned between the two, so all values
follow by induction. Values are capped at `cap`: order beyond `cap` bytes is not needed.

The recursion sorts strings of names in the same way. Their alphabets are wide: a queue then serves
a range of names, and a run of its entries is popped together as far as no push of one of them goes
between the others. Steps are NumPy operations on runs of queue entries.

Queues, the L suffixes and the orders of the recursion lie in scratch files beyond the budget. The
text of a shard, its types, and the positions and names of one level's stars stay in memory.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np


#: Strings of so many names are sorted by prefix doubling.
SMALL = 64


class SpillingFifos:
    """FIFOs of (suffix, common prefix or symbol) whose total in memory stays within ``budget`` bytes."""

    def __init__(self, budget: int, folder: str, n: int = 256):
        self.budget, self.folder, self.used, self.spilled = budget, folder, 0, 0
        self.blocks: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(n)]
        self.files: list[list[str]] = [[] for _ in range(n)]
        self.size = [0] * n

    def push(self, bucket: int, suffixes: np.ndarray, prefixes: np.ndarray) -> None:
        self.blocks[bucket].append((suffixes, prefixes))
        n = suffixes.nbytes + prefixes.nbytes
        self.size[bucket] += n
        self.used += n
        while self.used > self.budget:
            self._spill(max(range(len(self.size)), key=self.size.__getitem__))

    def _spill(self, bucket: int) -> None:
        path = os.path.join(self.folder, f"{self.spilled}.npz")
        self.spilled += 1
        np.savez(path, s=np.concatenate([b[0] for b in self.blocks[bucket]]), p=np.concatenate([b[1] for b in self.blocks[bucket]]))
        self.files[bucket].append(path)
        self.used -= self.size[bucket]
        self.blocks[bucket], self.size[bucket] = [], 0

    def pop(self, bucket: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All entries that the FIFO has now, in order, a block at a time."""
        files, self.files[bucket] = self.files[bucket], []
        blocks, self.blocks[bucket] = self.blocks[bucket], []
        self.used -= self.size[bucket]
        self.size[bucket] = 0
        for path in files:
            with np.load(path) as f:
                yield f["s"], f["p"]
            os.remove(path)
        if blocks:
            yield (blocks[0] if len(blocks) == 1 else (np.concatenate([b[0] for b in blocks]), np.concatenate([b[1] for b in blocks])))


class RangeMinima:
    """Minimum of any range of a block of common-prefix values."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        step = 1
        while 2 * step <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-step], last[step:]))
            step *= 2

    def between(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minima of ``values[low + 1 .. high]``; low < high."""
        k = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), self.levels[0].dtype)
        for level in np.unique(k):
            at = k == level
            t = self.levels[level]
            out[at] = np.minimum(t[low[at] + 1], t[high[at] - (1 << level) + 1])
        return out


class Scan:
    """Moves predecessors of scanned suffixes into their queues, with their common prefixes."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, queues: SpillingFifos, cap: int):
        self.text, self.wanted, self.queues, self.cap = text, wanted, queues, cap
        self.since = np.zeros(256, np.uint8)  # least value scanned since a queue's last entry
        self.begun = np.zeros(256, bool)

    def feed(self, suffixes: np.ndarray, prefixes: np.ndarray) -> None:
        if not len(suffixes):
            return
        before = suffixes - 1
        at = np.flatnonzero((before >= 0) & self.wanted[np.maximum(before, 0)])
        lowest = prefixes.min()
        if not len(at):
            np.minimum(self.since, lowest, out=self.since)
            return
        target = self.text[before[at]]
        order = np.argsort(target, kind="stable")
        at, target = at[order], target[order]
        heads = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
        value = np.empty(len(at), np.uint8)
        inner = np.ones(len(at), bool)
        inner[heads] = False
        follow = np.flatnonzero(inner)
        if len(follow):
            value[follow] = RangeMinima(prefixes).between(at[follow - 1], at[follow])
        up = np.minimum.accumulate(prefixes)
        value[heads] = np.minimum(self.since[target[heads]], up[at[heads]])
        down = np.append(np.minimum.accumulate(prefixes[::-1])[::-1], np.uint8(255))
        tails = np.append(heads[1:], len(at)) - 1
        np.minimum(self.since, lowest, out=self.since)
        self.since[target[tails]] = down[at[tails] + 1]
        value = np.minimum(value, self.cap - 1) + np.uint8(1)
        value[heads] = np.where(self.begun[target[heads]], value[heads], 0)
        self.begun[target[heads]] = True
        moved = before[at]
        for h, e in zip(heads.tolist(), (tails + 1).tolist()):
            self.queues.push(int(target[h]), moved[h:e], value[h:e])


def s_types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last one is not."""
    n = len(text)
    step = (text[1:] > text[:-1]).astype(np.int8) - (text[1:] < text[:-1])
    place = np.append(np.where(step != 0, np.arange(n - 1), n), n - 1)
    nearest = np.minimum.accumulate(place[::-1])[::-1]
    return np.append(step, -1)[np.minimum(nearest, n - 1)] > 0


def words_at(text: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Eight bytes from each place as a number in byte order; ``text`` has eight spare bytes."""
    view = np.ndarray(len(text) - 7, ">u8", text, 0, (1,)) if isinstance(text, np.ndarray) and text.flags["C_CONTIGUOUS"] else None
    return view[where].astype(np.uint64)


def common_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of suffix pairs, compared eight bytes at a time up to ``cap``.

    ``text`` is followed by spare bytes; a suffix that ends early is cut by the caller's separators.
    """
    out = np.zeros(len(a), np.int64)
    open_ = np.arange(len(a))
    limit = len(text) - 8
    for at in range(0, cap, 8):
        x, y = words_at(text, np.minimum(a[open_] + at, limit)), words_at(text, np.minimum(b[open_] + at, limit))
        differ = x ^ y
        bits = np.where(differ == 0, 64, 0)
        some = differ != 0
        if some.any():
            d = differ[some]
            lead = np.zeros(len(d), np.int64)
            for s in (32, 16, 8):
                small = d < (np.uint64(1) << np.uint64(64 - s))
                lead[small] += s
                d = np.where(small, d << np.uint64(s), d)
            bits[some] = lead
        out[open_] += bits // 8
        open_ = open_[~some]
        if not len(open_):
            break
    return np.minimum(out, cap).astype(np.uint8)


def _ranks(columns: list[np.ndarray]) -> np.ndarray:
    """Dense ranks of rows, first column first."""
    order = np.lexsort(columns[::-1]) if len(columns) > 1 else np.argsort(columns[0])
    new = np.zeros(len(order), bool)
    for c in columns:
        s = c[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def names_of(text: np.ndarray, stars: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Order-preserving names of the substrings from each star to the next, both included.

    Of two of which one is a prefix of the other the longer is smaller: bytes behind a substring's
    end count as 255, and then the longer one goes first. Seven bytes and that order make a key.
    """
    limit = len(text) - 8
    final = np.zeros(len(stars), bool)
    final[-1] = True  # behind the last one the text ends, which is smaller than any byte

    def column(which: np.ndarray, at: int) -> np.ndarray:
        w = words_at(text, np.minimum(stars[which] + at, limit))
        left = np.clip(lengths[which] - at, 0, 8)
        behind = (np.uint64(1) << (np.uint64(8) * np.minimum(8 - left, 7).astype(np.uint64))) - np.uint64(1)
        code = (9 - left).astype(np.uint64)
        last = final[which]
        w = np.where(last, w & ~behind, w | behind)
        code = np.where(last & (left < 8), np.uint64(0), code)
        return (w & ~np.uint64(255)) | code

    rank = _ranks([column(np.arange(len(stars)), 0)])
    at = 7
    while True:
        size = np.bincount(rank)
        tied = np.flatnonzero((size[rank] > 1) & (lengths > at))
        if not len(tied):
            return rank
        # tied rows reach beyond these bytes together, or end in them together
        wide = np.zeros(len(stars), np.int64)
        wide[tied] = _ranks([rank[tied], column(tied, at)]) + 1
        rank = _ranks([rank, wide])
        at += 7


def sort_names_in_memory(names: np.ndarray, depth: int) -> np.ndarray:
    """Suffix order of a string of names, by prefix doubling up to ``depth`` names.

    A rank is the first place of its group; a round sorts only the members of groups that are tied.
    """
    n = len(names)
    counts = np.bincount(names, minlength=1)
    rank = (np.cumsum(counts) - counts)[names]
    tied = np.flatnonzero(counts[names] > 1)
    step = 1
    while step < depth and len(tied):
        after = np.where(tied + step < n, rank[np.minimum(tied + step, n - 1)], -1)
        order = np.argsort(rank[tied] * np.int64(n + 1) + after + 1)
        tied, own, after = tied[order], rank[tied][order], after[order]
        place = np.arange(len(tied))
        group = np.concatenate([[True], own[1:] != own[:-1]])
        part = group.copy()
        part[1:] |= after[1:] != after[:-1]
        first = np.maximum.accumulate(np.where(part, place, 0))
        rank[tied] = own + first - np.maximum.accumulate(np.where(group, place, 0))
        alone = part & np.append(part[1:], True)
        tied = tied[~alone]
        step *= 2
    return np.argsort(rank, kind="stable")


class SymbolQueue:
    """Priority queue of (symbol, suffix) that pops in order of symbols, and of pushes within one.

    Symbols are cut into ranges of like weight, a FIFO each, so what waits can lie in files; only the
    range that is being popped is sorted in memory. ``fixed`` entries, sorted by symbol, come after
    all pushed ones of their symbol. An entry's push never goes before the entry itself.
    """

    def __init__(self, symbols: np.ndarray, wanted: np.ndarray, fixed: np.ndarray, budget: int, folder: str):
        self.symbols, self.wanted, self.fixed = symbols, wanted, fixed
        # as many ranges as keep both their number and the pushes within one small
        n = max(1, int(len(symbols) ** 0.5))
        self.edges = np.unique(np.partition(symbols, np.arange(n) * (len(symbols) - 1) // n)[np.arange(n) * (len(symbols) - 1) // n])
        self.edges[0] = symbols.min()
        self.fifos = SpillingFifos(budget, folder, len(self.edges))
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_waiting, self.deal_from = 0, min(64 * len(self.edges), max(1, budget // 64))
        self.fixed_at = np.searchsorted(symbols[fixed], np.append(self.edges, np.iinfo(np.int64).max))

    def push(self, suffixes: np.ndarray, symbols: np.ndarray) -> None:
        """Pushes wait together and are dealt to the FIFOs when there are many."""
        if len(suffixes):
            self.waiting.append((suffixes, symbols))
            self.n_waiting += len(suffixes)
        if self.n_waiting > self.deal_from:
            suffixes, symbols = self._all_waiting()
            bucket = np.searchsorted(self.edges, symbols, side="right") - 1
            order = np.argsort(bucket, kind="stable")
            heads = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            suffixes, symbols = suffixes[order], symbols[order]
            for k, a, e in zip(bucket[order[heads]].tolist(), heads.tolist(), [*heads[1:].tolist(), len(order)]):
                self.fifos.push(k, suffixes[a:e], symbols[a:e])

    def _all_waiting(self) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        out = tuple(np.concatenate([none, *x]) for x in zip(*self.waiting)) if self.waiting else (none, none)
        self.waiting, self.n_waiting = [], 0
        return out

    def _due(self, k: int, top: int) -> tuple[np.ndarray, np.ndarray]:
        """What was pushed to range ``k``, in order: its FIFO, then what still waits."""
        found = list(self.fifos.pop(k))
        suffixes, symbols = self._all_waiting()
        now = symbols < top
        if not now.all():
            self.waiting, self.n_waiting = [(suffixes[~now], symbols[~now])], int((~now).sum())
        found.append((suffixes[now], symbols[now]))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def drain(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(suffixes, whether fixed) in order; predecessors that are wanted are pushed on the way."""
        never = np.iinfo(np.int64).max
        for k in range(len(self.edges)):
            top = self.edges[k + 1] if k + 1 < len(self.edges) else never
            due, symbol = self._due(k, top)
            own = self.fixed[self.fixed_at[k] : self.fixed_at[k + 1]]
            suffix, key = np.concatenate([due, own]), np.concatenate([2 * symbol, 2 * self.symbols[own] + 1])
            order = np.argsort(key, kind="stable")
            suffix, key = suffix[order], key[order]
            while len(suffix):
                before = suffix - 1
                goes = (before >= 0) & self.wanted[np.maximum(before, 0)]
                pushed = np.where(goes, 2 * self.symbols[np.maximum(before, 0)], never)
                least = np.minimum.accumulate(pushed)
                # up to the first entry that a push of an earlier one goes before
                late = np.flatnonzero(key[1:] > least[:-1])
                m = int(late[0]) + 1 if len(late) else len(suffix)
                yield suffix[:m], (key[:m] & 1).astype(bool)
                new, symbol = before[:m][goes[:m]], pushed[:m][goes[:m]] >> 1
                here = symbol < top
                self.push(new[~here], symbol[~here])
                suffix, key = np.concatenate([suffix[m:], new[here]]), np.concatenate([key[m:], 2 * symbol[here]])
                if here.any():
                    order = np.argsort(key, kind="stable")
                    suffix, key = suffix[order], key[order]


class _Sequence:
    """Numbers written one after another to a scratch file, read back as a mapped array."""

    def __init__(self, folder: str):
        self.file, self.n = tempfile.NamedTemporaryFile(dir=folder, delete=False), 0

    def add(self, x: np.ndarray) -> None:
        np.ascontiguousarray(x, np.int64).tofile(self.file)
        self.n += len(x)

    def read(self) -> np.ndarray:
        self.file.close()
        return np.memmap(self.file.name, np.int64, "r", shape=(self.n,)) if self.n else np.zeros(0, np.int64)


def star_names(symbols: np.ndarray, stars: np.ndarray) -> np.ndarray:
    """Order-preserving names of the substrings of a wide alphabet from each star to the next, both included.

    Of two of which one is a prefix of the other the longer is smaller; the last one, behind which
    the string ends, is smaller than those it is a prefix of.
    """
    ends = np.append(stars[1:], len(symbols) - 1)
    longer = symbols.max() + 1
    rank = _ranks([symbols[stars]])
    at = 1
    while True:
        tied = np.flatnonzero((np.bincount(rank)[rank] > 1) & (stars + at <= ends + 1))
        if not len(tied):
            return rank
        place = stars[tied] + at
        column = np.where(place <= ends[tied], symbols[np.minimum(place, len(symbols) - 1)], longer)
        column = np.where((place > ends[tied]) & (tied == len(stars) - 1), -1, column)
        wide = np.zeros(len(stars), np.int64)
        wide[tied] = _ranks([rank[tied], column]) + 1
        rank = _ranks([rank, wide])
        at += 1


def sort_names(names: np.ndarray, budget: int, folder: str, depth: int) -> np.ndarray:
    """Suffix order of a string of names by the same induction again, for the first ``depth`` names.

    Recursion ends where all names differ, where one name covers all that counts, or at a string
    that is `SMALL`. Orders go through scratch files.
    """
    n = len(names)
    if depth <= 1 or int(names.max()) + 1 == n:
        return np.argsort(names, kind="stable")
    if n <= SMALL:
        return sort_names_in_memory(names, depth)
    names = names.astype(np.int64)
    small = s_types(names)
    stars = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(stars):
        # a substring has at least two names that the next one does not
        stars = stars[sort_names(star_names(names, stars), budget, folder, -(-depth // 2) + 1)]
    up = SymbolQueue(names, ~small, stars, budget, folder)
    up.push(np.array([n - 1]), names[-1:])
    larges = _Sequence(folder)
    for suffixes, star in up.drain():
        larges.add(suffixes[~star])
    top = int(names.max())
    mirrored = top - names
    down = SymbolQueue(mirrored, small, np.asarray(larges.read())[::-1], budget, folder)
    out = _Sequence(folder)
    for suffixes, _ in down.drain():
        out.add(suffixes)
    return np.asarray(out.read())[::-1]


def sorted_suffixes(text: np.ndarray, cap: int, budget: int = 256 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Suffixes of ``text`` in descending order, in blocks of (suffix, common prefix with the one before).

    The order and the common prefixes hold for the first ``cap`` bytes (cap <= 250).
    """
    n = len(text)
    if not n:
        return
    folder = tempfile.mkdtemp(prefix="induced-")
    try:
        kind = np.int32 if n < 1 << 31 else np.int64
        small = s_types(text)
        padded = np.concatenate([text, np.zeros(16, np.uint8)])
        stars = np.flatnonzero(small[1:] & ~small[:-1]).astype(np.int64) + 1
        bounds = np.zeros(257, np.int64)
        if len(stars):
            lengths = np.append(stars[1:], n - 1) - stars + 1
            names = names_of(padded, stars, lengths)
            if names.max() + 1 < len(names):
                stars = stars[sort_names(names, budget, folder, -(-cap // 2) + 1)]
            else:
                stars = stars[np.argsort(names, kind="stable")]
            star_prefix = np.zeros(len(stars), np.uint8)
            star_prefix[1:] = common_prefixes(padded, stars[:-1], stars[1:], cap)
            bounds = np.searchsorted(text[stars], np.arange(257))
        stars = stars.astype(kind)
        # up: L suffixes by leading byte, each before the stars with that byte
        queues, kept = SpillingFifos(budget, folder), SpillingFifos(budget, tempfile.mkdtemp(dir=folder))
        scan = Scan(text, ~small, queues, cap)
        last_l = np.full(256, -1, np.int64)
        scan.feed(np.array([n], kind), np.zeros(1, np.uint8))
        for c in range(256):
            scan.since[:] = 0  # nothing is common with smaller bytes
            while queues.size[c] or queues.files[c]:
                for s, p in queues.pop(c):
                    kept.push(c, s, p)
                    last_l[c] = s[-1]
                    scan.feed(s, p)
            if bounds[c] < bounds[c + 1]:
                own = stars[bounds[c] : bounds[c + 1]]
                p = star_prefix[bounds[c] : bounds[c + 1]].copy()
                p[0] = common_prefixes(padded, last_l[c : c + 1], own[:1].astype(np.int64), cap)[0] if last_l[c] >= 0 else 0
                scan.feed(own, p)
        # down: S suffixes by leading byte, each before the L suffixes with that byte
        queues = SpillingFifos(budget, folder)
        scan = Scan(text, small, queues, cap)
        for c in range(255, -1, -1):
            scan.since[:] = 0
            last = -1
            while queues.size[c] or queues.files[c]:
                for s, p in queues.pop(c):
                    last = int(s[-1])
                    yield s, p
                    scan.feed(s, p)
            larges = list(kept.pop(c))
            for k in range(len(larges) - 1, -1, -1):
                s, p = larges[k]
                s = s[::-1]
                following = larges[k + 1][1][0] if k + 1 < len(larges) else None
                if following is None:
                    following = common_prefixes(padded, np.array([last]), s[:1].astype(np.int64), cap)[0] if last >= 0 else 0
                p = np.concatenate([[following], p[:0:-1]]).astype(np.uint8)
                yield s, p
                scan.feed(s, p)
    finally:
        shutil.rmtree(folder, ignore_errors=True)
