"""Token counts by prefix dynamic programming over byte-pair pieces.

A sequence of pieces is a byte-pair encoding exactly if each piece is one and each neighbouring
pair stays as it is when encoded alone. So the last piece of each prefix follows from the last
pieces of shorter prefixes: one pass gives the exact count at every prefix of a pre-token, and
running sums over pre-tokens give it at every prefix of a document. Tables of pre-tokens are kept.
The count of a text, whether it is over a budget, and the longest prefix within one are then
look-ups; nothing is encoded again.

Defined cases: null text is empty and counts 0; null ids and repeated rows are counted each; texts of
any length are counted whole; a text of exactly the limit is not over it; an empty table gives an
empty result; columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .subwords import UNSETTLED, WORD_PATTERN, library_tokenizer, vocabulary

#: Characters up to which every prefix of a pre-token has its count kept.
_LONG = 512
_SPECIAL = re.compile(r"<\|startoftext\|>|<\|endoftext\|>")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 for itself, then U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class PairTable:
    """Which piece may follow which.

    A pair comes apart only if a merge crosses its border: of a piece x that ends the first one while
    it is built and a piece y that begins the second one, while neither has been merged on. Of equal
    ranks the merge further left goes first.
    """

    _NEVER = 1 << 60

    def __init__(self, merges: dict[tuple[str, str], int], suffix: str):
        self.merges, self.suffix = merges, suffix
        self.known: dict[tuple[str, str], bool] = {}
        self.max_entries = 1_000_000
        self.parts: dict[str, tuple[str, str]] = {}
        for a, b in merges:
            self.parts.setdefault(a + b, (a, b))
        self.edges: tuple[dict, dict] = ({}, {})

    def split(self, piece: str) -> list[str]:
        closed = bool(self.suffix) and piece.endswith(self.suffix) and len(piece) > len(self.suffix)
        letters = list(piece.removesuffix(self.suffix) if closed else piece)
        if closed:
            letters[-1] += self.suffix
        return letters

    def encode(self, symbols: list[str]) -> list[str]:
        """Plain merging, the best rank first; decides which pieces encode as themselves."""
        ranks = self.merges
        while len(symbols) > 1:
            best, at = None, 0
            for i in range(len(symbols) - 1):
                r = ranks.get((symbols[i], symbols[i + 1]))
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                return symbols
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def edge(self, piece: str, side: int) -> list[tuple[str, int, int]]:
        """(part, rank that makes it, rank that takes it) of the parts at the left (0) or right (1) edge of a piece."""
        found = self.edges[side].get(piece)
        if found is None:
            found, taken, part = [], self._NEVER, piece
            while True:
                pair = self.parts.get(part)
                made = self.merges[pair] if pair else -1
                found.append((part, made, taken))
                if pair is None:
                    break
                part, taken = pair[side], made
            self.edges[side][piece] = found
        return found

    def allows(self, a: str, b: str) -> bool:
        ok = self.known.get((a, b))
        if ok is None:
            if len(self.known) > self.max_entries:
                self.known.clear()
            ok = self.known[a, b] = self._apart(a, b)
        return ok

    def _apart(self, a: str, b: str) -> bool:
        rank = self.merges.get
        right = self.edge(b, 0)
        for x, made_x, taken_x in self.edge(a, 1):
            for y, made_y, taken_y in right:
                if made_y < taken_x and made_x < taken_y:
                    r = rank((x, y))
                    if r is not None and r < taken_x and r <= taken_y:
                        return False
        return True


class PrefixCounter:
    """Exact counts at every prefix. ``name`` is a byte-level vocabulary with word-end pieces."""

    def __init__(self, name: str = "word_bpe_49k.json", max_bytes: int = 128 << 20):
        with open(vocabulary(name), encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.pairs = PairTable({tuple(m): r for r, m in enumerate(model["merges"])}, self.suffix)
        usable = {p for p in model["vocab"] if self.pairs.encode(self.pairs.split(p)) == [p]}
        closed = {p[: -len(self.suffix)] for p in usable if self.suffix and p.endswith(self.suffix) and p != self.suffix}
        self.open, self.closed = frozenset(p for p in usable if not (self.suffix and p.endswith(self.suffix) and p != self.suffix)), frozenset(closed)
        self.longest = max(map(len, self.open | self.closed))
        #: Ends of pieces: what goes on to a longer piece when read backwards.
        self.open_tails, self.closed_tails = (frozenset(p[k:] for p in ps for k in range(len(p))) for ps in (self.open, self.closed))
        self.rewritten: dict[str, str] = {}
        self.letters = byte_alphabet()
        self.library = library_tokenizer(name)
        #: Two generations of tables; when the bytes of one reach the bound the older goes.
        self.tables: dict[str, bytes | tuple[int, ...]] = {}
        self.earlier: dict[str, bytes | tuple[int, ...]] = {}
        self.max_bytes, self.held = max_bytes, 0

    def _ends(self, word: str) -> tuple[list[str], list[int]]:
        """Last open piece and open count of every prefix of a byte-level word."""
        last, count = [""], [0]
        allows, pieces, tails = self.pairs.allows, self.open, self.open_tails
        for end in range(1, len(word) + 1):
            start, found = end - 1, []
            while start >= 0 and (piece := word[start:end]) in tails:
                if piece in pieces:
                    found.append((start, piece))
                start -= 1
            for start, piece in reversed(found):
                if not start or last[start] and allows(last[start], piece):
                    last.append(piece)
                    count.append(count[start] + 1)
                    break
            else:
                raise ValueError("a byte has no piece")
        return last, count

    def _close(self, word: str, end: int, last: list[str], count: list[int]) -> int:
        """Count of the prefix up to ``end`` as a word of its own."""
        start, found = end - 1, []
        while start >= 0 and (piece := word[start:end]) in self.closed_tails:
            if piece in self.closed:
                found.append((start, piece))
            start -= 1
        for start, piece in reversed(found):
            if not start or self.pairs.allows(last[start], piece + self.suffix):
                return count[start] + 1
        raise ValueError("a byte has no closing piece")

    def _word(self, token: str) -> tuple[str, list[int]]:
        """The byte-level form of a pre-token, and where each of its characters ends there."""
        word, at = [], [0]
        for c in token:
            word += [self.letters[b] for b in c.encode()]
            at.append(len(word))
        return "".join(word), at

    def total(self, token: str) -> int:
        """Count of a whole pre-token; of a long one only the last prefix is closed, and nothing is kept."""
        if len(token) <= _LONG:
            return self.table(token)[-1]
        word, _ = self._word(token)
        return self._close(word, len(word), *self._ends(word))

    def within(self, token: str, budget: int) -> int:
        """Characters of the longest prefix of a pre-token with at most ``budget`` tokens."""
        if len(token) <= _LONG:
            return max(k for k, c in enumerate(self.table(token)) if c <= budget)
        # a token is at most so many bytes, and a prefix closes behind one of the last so many
        word, at = self._word(token[: (budget + 1) * self.longest])
        last, count = self._ends(word)
        for k in range(len(at) - 1, 0, -1):
            if min(count[max(0, at[k] - self.longest) : at[k]]) < budget and self._close(word, at[k], last, count) <= budget:
                return k
        return 0

    def table(self, token: str) -> bytes | tuple[int, ...]:
        """Counts at every prefix, in characters, of a lower-case pre-token; kept for reuse."""
        known = self.tables.get(token)
        if known is None:
            known = self.earlier.get(token)
            if known is None:
                word, at = self._word(token)
                last, count = self._ends(word)
                counts = tuple([self._close(word, e, last, count) if e else 0 for e in at])
                known = bytes(counts) if max(counts) < 256 else counts
            if self.held > self.max_bytes:
                self.earlier, self.tables, self.held = self.tables, {}, 0
            self.tables[token] = known
            self.held += 160 + 3 * len(token) if type(known) is bytes else 160 + 40 * len(token)
        return known

    def pretokens(self, text: str) -> list[tuple[str | None, int, int]]:
        """(pre-token, start, end); None stands for a special string, which is one token."""
        out: list[tuple[str | None, int, int]] = []
        at = 0
        for m in [*_SPECIAL.finditer(text), None]:
            end = m.start() if m else len(text)
            part = text[at:end]
            if part.isascii() or not UNSETTLED.search(part):
                out += [(w.group(), at + w.start(), at + w.end()) for w in WORD_PATTERN.finditer(part.lower())]
            else:
                whole = self.library.normalizer.normalize_str(part)
                for piece, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(whole):
                    out.append((whole[a:b], at + a, at + b))
            if m:
                out.append((None, m.start(), m.end()))
                at = m.end()
        return out

    def prefix_counts(self, text: str | None) -> tuple[list[int], list[int]]:
        """Ends of pre-tokens, and the exact token count of the text up to each."""
        ends, counts, n = [0], [0], 0
        for token, _, end in self.pretokens(text or ""):
            n += 1 if token is None else self.total(token)
            ends.append(end)
            counts.append(n)
        return ends, counts

    def count_at(self, text: str, length: int) -> int:
        """Exact token count of ``text[:length]``, for texts the normaliser keeps in place."""
        n = 0
        for token, a, b in self.pretokens(text):
            if b <= length:
                n += 1 if token is None else self.total(token)
            else:
                return n + (self.total(token[: length - a]) if token is not None and a < length else 0)
        return n

    def truncate(self, text: str, budget: int) -> str:
        """The longest run of whole pre-tokens within ``budget`` tokens."""
        ends, counts = self.prefix_counts(text)
        return text[: ends[bisect_right(counts, budget) - 1]]

    def count(self, text: str | None) -> int:
        """The count at the last prefix, from the tables of the pre-tokens."""
        if not text:
            return 0
        if settled(text):
            special = len(_SPECIAL.findall(text)) if "<|" in text else 0
            tokens = WORD_PATTERN.findall((_SPECIAL.sub(" ", text) if special else text).lower())
            found = list(map(self.tables.get, tokens))
            if None in found:
                found = [n or (self.table(t) if len(t) <= _LONG else (self.total(t),)) for t, n in zip(tokens, found)]
            return special + sum([t[-1] for t in found])
        return sum(1 if t is None else self.total(t) for t, _, _ in self.pretokens(text))

    def fit(self, text: str | None, budget: int) -> int:
        """Characters of the longest prefix with at most ``budget`` tokens.

        It ends in no special string, and between no characters that the normaliser composes.
        """
        text = text or ""
        n, place = 0, None if settled(text) else self._places(text)
        for token, start, end in self.pretokens(text):
            cost = 1 if token is None else self.total(token)
            if n + cost > budget:
                more = self.within(token, budget - n) if token is not None else 0
                return start + more if place is None else place(start, end, more)
            n += cost
        return len(text)

    def _places(self, text: str) -> Callable[[int, int, int], int]:
        """Where in ``text`` the first ``more`` characters of the pre-token at [start, end) end.

        `pretokens` counts characters of each part as the normaliser rewrites it. Runs that compose
        with nothing outside them are rewritten one by one, and white space once a run.
        """
        bounds = [0, *(x for m in _SPECIAL.finditer(text) for x in m.span()), len(text)]
        parts = list(zip(bounds[::2], bounds[1::2]))

        def place(start: int, end: int, more: int) -> int:
            a, b = max((p for p in parts if p[0] <= start), default=(0, len(text)))
            if (start, end) in {m.span() for m in _SPECIAL.finditer(text)}:
                return start
            part, want, at, done, white = text[a:b], start - a + more, 0, 0, False
            if part.isascii() or not UNSETTLED.search(part):
                return a + want
            for run in composed_runs(part):
                new = self.rewritten.get(run)
                if new is None:
                    new = self.library.normalizer.normalize_str(run)
                    if len(self.rewritten) < 1 << 16:
                        self.rewritten[run] = new
                size = len(new) - (white and new.startswith(" "))
                if done + size > want:
                    break
                done, at, white = done + size, at + len(run), new.endswith(" ")
            return a + at

        return place


@lru_cache(1)
def _composing() -> frozenset[str]:
    """Characters that may be composed with one before them."""
    second = {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    for k in range(0x110000):
        made = unicodedata.decomposition(chr(k))
        if made and made[0] != "<":
            second.update(chr(int(x, 16)) for x in made.split()[1:])
    return frozenset(second)


def composed_runs(text: str) -> Iterator[str]:
    """``text`` in pieces between which nothing is composed: characters, if it is composed already."""
    if unicodedata.is_normalized("NFC", text):
        yield from text
        return
    second, start = _composing(), 0
    for k in range(1, len(text)):
        if not unicodedata.combining(text[k]) and text[k] not in second:
            yield text[start:k]
            start = k
    yield text[start:]


def settled(text: str) -> bool:
    """Whether the splitting pattern alone says what the library's normaliser and splitter do."""
    return text.isascii() and not ("\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text) or not UNSETTLED.search(text)


@lru_cache(1)
def worker_counter(name: str) -> PrefixCounter:
    """The counter of a Python worker, which keeps its tables for the tasks that follow."""
    return PrefixCounter(name)


def _counter(name: str, limit: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_counter(name)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = [counter.count(t) for t in texts]
            size = [len((t or "").encode()) for t in texts]
            fit = [counter.fit(t, limit) if x > limit else len(t or "") for t, x in zip(texts, n)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_()), pa.array(fit, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"],
            )

    return count


def token_counts(docs: DataFrame, name: str = "word_bpe_49k.json", limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and fit_chars (characters of the longest prefix within the limit) of each row."""
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(_counter(name, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")
