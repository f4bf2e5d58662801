"""Exact ids of the `tokenizers` library through a bounded cache of pre-tokens.

A byte-pair encoder never merges across pre-tokens, so a text's ids are the ids of its
pre-tokens in order. The library encodes each distinct pre-token; texts that need the full
normaliser (characters outside the plain Latin range, special strings) go to it whole. What is
kept is bounded by entries and by bytes.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np

# Unicode categories L and N up to U+00FF and up to U+017F, ASCII white space, and the
# two public splitting patterns over them. Branches that begin with different signs stand in the
# order of their frequency.
_LATIN_1 = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_LATIN = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
_S = "\t-\r "
_WHITE = "\t\n\x0b\x0c\r "


def word_pattern(letters: str) -> re.Pattern:
    return re.compile(rf"[{letters}]+|'(?:[stmd]|re|ve|ll)|[{_N}]|[^{_S}{letters}{_N}]+")


def byte_pattern(letters: str) -> re.Pattern:
    return re.compile(rf" ?[{letters}]+|'(?:[stmd]|re|ve|ll)| ?[{_N}]+| ?[^{_S}{letters}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


WORD_PATTERN, BYTE_PATTERN = word_pattern(_LATIN), byte_pattern(_LATIN)
#: Characters whose class, case or composition the patterns above do not settle.
UNSETTLED = re.compile("[\x1c-\x1f\x85\xa0İƀ-\U0010ffff]")


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file; a path is returned as it is."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def library_tokenizer(name: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(name))


#: Those of them up to U+00FF, as Latin-1 bytes.
_UNSETTLED_BYTES = (b"\x1c", b"\x1d", b"\x1e", b"\x1f", b"\x85", b"\xa0", b"<|")


def reach(text: str) -> int:
    """Which pattern splits ``text`` as the library does: 1 up to U+00FF, 2 up to U+017F, 0 none."""
    try:
        data = text.encode("latin-1")
    except UnicodeEncodeError:
        return 0 if "<|" in text or UNSETTLED.search(text) else 2
    return 0 if any(b in data for b in _UNSETTLED_BYTES) else 1


class CachedEncoder:
    """Ids as little-endian unsigned 16-bit bytes (vocabularies here have under 65,536 ids)."""

    def __init__(self, name: str, lower: bool, max_entries: int = 300_000, max_bytes: int = 96 << 20):
        self.library = library_tokenizer(name)
        assert self.library.get_vocab_size() <= 1 << 16
        self.lower = lower
        pattern = word_pattern if lower else byte_pattern
        self.find = (None, pattern(_LATIN_1).findall, pattern(_LATIN).findall)
        ends = ("</w>",) if lower else ()
        pieces = self.library.get_vocab()
        self.edges = np.zeros(1 << 16, bool)
        self.edges[[i for p, i in pieces.items() if (p.endswith(ends) if lower else p.startswith("\u0120"))]] = True
        self.words: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}
        self.max_entries, self.max_bytes, self.held = max_entries, max_bytes, 0

    def _library_ids(self, texts: list[str]) -> list[bytes]:
        return [array("H", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined_ids(self, tokens: list[str]) -> list[bytes]:
        """Ids of pre-tokens that the library tells apart in one text, cut at their first or last pieces.

        Lower-case pre-tokens are joined by spaces, which the library drops, and end in word-end
        pieces. The others begin with their own space, which only a first piece holds.
        """
        text = (" " if self.lower else "").join(tokens)
        ids = array("H", self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids)
        edge = np.flatnonzero(self.edges[np.frombuffer(ids, np.uint16)])
        if len(edge) != len(tokens):
            return self._library_ids(tokens)
        cuts = [0, *(edge + 1).tolist()] if self.lower else [*edge.tolist(), len(ids)]
        data = ids.tobytes()
        return [data[2 * a : 2 * b] for a, b in zip(cuts, cuts[1:])]

    def _new_ids(self, tokens: list[str], together: int = 2000) -> dict[str, bytes]:
        joint = tokens if self.lower else [t for t in tokens if t[0] == " " and len(t) > 1 and t[1] not in _WHITE]
        found: dict[str, bytes] = {}
        for a in range(0, len(joint), together):
            part = joint[a : a + together]
            found.update(zip(part, self._joined_ids(part)))
        if len(found) < len(tokens):
            alone = [t for t in tokens if t not in found]
            found.update(zip(alone, self._library_ids(alone)))
        return found

    def _learn(self, words: list[str]) -> None:
        """Ids of words that the cache lacks. It has two generations; when one is full, by entries or by
        bytes, the older goes."""
        if len(self.words) > self.max_entries or self.held > self.max_bytes:
            self.earlier, self.words, self.held = self.words, {}, 0
        new = []
        for w in dict.fromkeys(words):
            p = self.earlier.get(w)
            if p is None:
                new.append(w)
            else:
                self.words[w] = p
            self.held += 200 + 4 * len(w)
        if new:
            self.words.update(self._new_ids(new))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        kind = reach(text)
        if not kind:
            return self._library_ids([text])[0]
        words = self.find[kind](text.lower() if self.lower else text)
        parts = list(map(self.words.get, words))
        if None in parts:
            self._learn([w for w, p in zip(words, parts) if p is None])
            parts = [self.words[w] if p is None else p for w, p in zip(words, parts)]
        return b"".join(parts)


@lru_cache(1)
def worker_encoder(name: str, lower: bool) -> CachedEncoder:
    """The encoder of a Python worker, which keeps its cache for the tasks that follow."""
    return CachedEncoder(name, lower, 500_000)
