"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three transducers are compiled from the model file, over the tropical semiring (weights add along a
path, the least path counts, no arc is the semiring's zero):

* the normaliser: an arc without input that writes the word mark in front, an arc from each space to
  the mark, and any other character to itself, all of weight 0;
* the pieces: a trie whose states are prefixes of pieces; where a piece ends, an arc without input
  writes its id with weight 0 and returns to the root. From the root, byte fallback arcs read any
  character, write the ids of its bytes and weigh one a byte;
* the pairs: an acceptor whose states are the last id. Its arc from piece a to piece b weighs 0 if
  the model leaves that pair apart and is missing otherwise; after a fallback arc any piece may
  follow. It has as many arcs as pairs of pieces, so arcs are made when a composition asks for them.

An input is composed with the three as the search needs states (place in the text, last id), and the
shortest path is found in order of distance, of equal ones the furthest place first. A path of weight 0
is the model's encoding; characters that no piece holds add their bytes. No piece has the word mark
after another character, so the input is composed word by word and paths of words are kept.

Defined cases: null and empty texts have no pieces and decode to the empty text; null ids and repeated
rows are encoded each; of pairs with one score the leftmost is merged first; texts of any length are
encoded whole, word by word; an empty table gives an empty result; columns beside doc_id and text are
ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .subwords import vocabulary

MARK = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE = 1, 2, 3, 4, 6
#: The tropical semiring: the weight of an arc that is free and of one that is missing.
ONE, ZERO = 0.0, math.inf
#: State of the pairs before the first piece and after a fallback arc: every piece may follow.
FREE = -1


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol-buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while i < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[i : i + n]
            i += n


class Model:
    """Pieces, scores, kinds and normaliser flags of a model file."""

    def __init__(self, path: str):
        self.pieces: list[tuple[str, float, int]] = []
        self.prefix, self.squeeze, self.charsmap, self.kind = True, True, b"", 1
        with open(path, "rb") as f:
            data = f.read()
        for field, value in _fields(data):
            if field == 1:
                got = dict(_fields(value))
                self.pieces.append((got[1].decode(), float(np.frombuffer(got.get(2, b"\0\0\0\0"), "<f4")[0]), got.get(3, _NORMAL)))
            elif field == 2:
                self.kind = dict(_fields(value)).get(3, 1)
            elif field == 3:
                got = dict(_fields(value))
                self.charsmap, self.prefix, self.squeeze = got.get(2, b""), bool(got.get(3, 1)), bool(got.get(4, 1))


class Transducer:
    """``encode`` and ``decode`` of a byte-pair model with byte fallback."""

    def __init__(self, name: str = "piece_bpe_32k.model", max_entries: int = 300_000, max_bytes: int = 96 << 20):
        model = Model(vocabulary(name))
        if model.kind != 2 or model.charsmap or model.squeeze:
            raise ValueError("only byte-pair models with the identity normaliser are compiled")
        self.prefix = model.prefix
        self.ids = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind == _NORMAL}
        self.score = {p: s for p, s, kind in model.pieces if kind == _NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(model.pieces) if kind == _BYTE}
        self.user = [p for p, _, kind in model.pieces if kind == _USER]
        if self.user or len(self.bytes) != 256:
            raise ValueError("the model has user pieces or lacks byte pieces")
        self.text = [None if kind in (_CONTROL, _UNKNOWN) else bytes([int(p[3:5], 16)]) if kind == _BYTE else p.encode() for p, _, kind in model.pieces]
        #: Neighbouring characters inside some piece; between any others every path has a state.
        self.inside = frozenset(p[i : i + 2] for p in self.ids for i in range(len(p) - 1))
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece spans words")
        #: Normaliser: what is written before the text, and the characters that aren't written as they are.
        self.opening, self.rewritten = MARK if self.prefix else "", {" ": MARK}
        self._compile_pieces()
        #: Arcs of the pairs made so far: the last id and the next one, in 16 bits each, to the weight.
        self.pairs: dict[int, float] = {}
        self.paths: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}
        self.max_entries, self.max_bytes, self.held = max_entries, max_bytes, 0
        self.word = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")

    def _merge(self, symbols: list[str]) -> list[str]:
        """The model's merges: the best-scored neighbouring pair first, the leftmost of equals."""
        score = self.score
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = score.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def _compile_pieces(self) -> None:
        """``step[q]`` has the reading arcs of trie state q, ``written[q]`` the id of its writing arc or FREE.

        A piece that doesn't encode as itself is on no path and gets no writing arc.
        """
        self.step: list[dict[str, int]] = [{}]
        self.written = [FREE]
        for piece, i in self.ids.items():
            if self._merge([*piece]) != [piece]:
                continue
            q = 0
            for c in piece:
                q = self.step[q].setdefault(c, len(self.step))
                if q == len(self.step):
                    self.step.append({})
                    self.written.append(FREE)
            self.written[q] = i
        self.name = {i: p for p, i in self.ids.items()}

    def pair_weight(self, a: int, b: int) -> float:
        """Weight of the pairs' arc from state ``a`` that reads piece ``b``."""
        if a == FREE:
            return ONE
        weight = self.pairs.get(a << 16 | b)
        if weight is None:
            if len(self.pairs) > 2 * self.max_entries:
                self.pairs.clear()
            x, y = self.name[a], self.name[b]
            weight = self.pairs[a << 16 | b] = ONE if self._merge([*x, *y]) == [x, y] else ZERO
        return weight

    def piece_arcs(self, word: str, s: int) -> list[tuple[int, int]]:
        """(end, id) of the pieces that the trie reads in ``word`` from place ``s``, short ones first; each weighs 0."""
        step, written, q, found = self.step, self.written, 0, []
        for e in range(s, len(word)):
            q = step[q].get(word[e])
            if q is None:
                break
            if written[q] != FREE:
                found.append((e + 1, written[q]))
        return found

    def fallback_arc(self, c: str) -> tuple[list[int], float]:
        """Ids and weight of the fallback arc that reads ``c``."""
        ids = [self.bytes[b] for b in c.encode()]
        return ids, float(len(ids))

    def shortest_path(self, word: str) -> tuple[list[int], float]:
        """Output ids and weight of the least path through the composition with ``word``.

        ``waiting`` has arcs by the distance at which they arrive: a state and the one before it. Arcs of
        weight 0 stay at the distance in hand, fallback arcs wait for theirs, so states are settled in
        order of distance and the first one at the end of the word has the least.
        """
        came: dict[tuple[int, int], tuple[int, int] | None] = {}
        waiting: dict[float, list] = {ONE: [((0, FREE), None)]}
        while waiting:
            distance = min(waiting)
            arcs, settled = waiting.pop(distance), []
            while arcs:
                state, before = arcs.pop()
                place, last = state
                if state in came or before is not None and last != FREE and self.pair_weight(before[1], last) == ZERO:
                    continue
                came[state] = before
                if place == len(word):
                    return self._outputs(word, came, state), distance
                settled.append(state)
                for arc in self.piece_arcs(word, place):
                    arcs.append((arc, state))
            for state in settled:
                weight = self.fallback_arc(word[state[0]])[1]
                waiting.setdefault(distance + weight, []).append(((state[0] + 1, FREE), state))
        raise ValueError("a word has no path")

    def _outputs(self, word: str, came: dict, state: tuple[int, int]) -> list[int]:
        out: list[int] = []
        while (before := came[state]) is not None:
            out += [state[1]] if state[1] != FREE else self.fallback_arc(word[before[0]])[0][::-1]
            state = before
        return out[::-1]

    def path(self, word: str) -> bytes:
        """Ids of a word as bytes, composed between the places that no piece spans; kept for reuse."""
        found = self.earlier.get(word)
        if found is not None:
            self.paths[word] = found
            return found
        cuts = [0, *(i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.inside), len(word)]
        if len(cuts) > 2:
            found = b"".join([self._known(word[a:b]) for a, b in zip(cuts, cuts[1:])])
        else:
            found = array("H", self.shortest_path(word)[0]).tobytes()
        self.paths[word] = found
        self.held += 200 + 4 * len(word)
        return found

    def _known(self, word: str) -> bytes:
        return self.paths.get(word) or self.path(word)

    def normalise(self, text: str) -> str:
        for read, write in self.rewritten.items():
            text = text.replace(read, write)
        return self.opening + text if text else text

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 16-bit bytes."""
        if not text:
            return b""
        words = self.word.findall(self.normalise(text))
        parts = list(map(self.paths.get, words))
        if None in parts:
            if len(self.paths) > self.max_entries or self.held > self.max_bytes:
                self.earlier, self.paths, self.held = self.paths, {}, 0
            parts = [self._known(w) if p is None else p for w, p in zip(words, parts)]
        return b"".join(parts)

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD each, as in the library."""
        text = self.text
        data = b"".join([t for i in np.frombuffer(ids, "<u2").tolist() if (t := text[i]) is not None])
        out = data.decode("utf-8", "replace").replace(MARK, " ")
        return out[1:] if self.prefix and out.startswith(" ") else out


@lru_cache(2)
def worker_transducer(name: str) -> Transducer:
    """The transducer of a Python worker, which keeps its paths for the tasks that follow."""
    return Transducer(name)


def _coder(name: str):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = worker_transducer(name)
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                ids = fst.encode(t)
                back = fst.decode(ids)
                rows.append((len(ids) // 2, zlib.crc32(np.frombuffer(ids, "<u2").astype("<u4").tobytes()), hashlib.sha256(back.encode()).hexdigest(), back == (t or "")))
            n, crc, sha, same = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha, pa.string()), pa.array(same, pa.bool_())],
                names=["doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "round_trip"],
            )

    return code


def encode_pieces(docs: DataFrame, name: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (ids as unsigned 32-bit), decoded_sha256 and round_trip of each row."""
    bounded_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(_coder(name), "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean")
