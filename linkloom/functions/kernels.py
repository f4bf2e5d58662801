"""Pair kernels on sequences, one pair or a block of pairs at a time, and a registry of them."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship_package

# The lower triangle of the public BLOSUM62 matrix, in this order of letters.
BLOSUM62_LETTERS = "ARNDCQEGHILKMFPSTWYVBZX*"
BLOSUM62_LOWER = """
4
-1 5
-2 0 6
-2 -2 1 6
0 -3 -3 -3 9
-1 1 0 0 -3 5
-1 0 0 2 -4 2 5
0 -2 0 -1 -3 -2 -2 6
-2 0 1 -1 -3 0 0 -2 8
-1 -3 -3 -3 -1 -3 -3 -4 -3 4
-1 -2 -3 -4 -1 -2 -3 -4 -3 2 4
-1 2 0 -1 -3 1 1 -2 -1 -3 -2 5
-1 -1 -2 -3 -1 0 -2 -3 -2 1 2 -1 5
-2 -3 -3 -3 -2 -3 -3 -3 -1 0 0 -3 0 6
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4 7
1 -1 1 0 -1 0 0 0 -1 -2 -2 0 -1 -2 -1 4
0 -1 0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1 1 5
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1 1 -4 -3 -2 11
-2 -2 -2 -3 -2 -1 -2 -3 2 -1 -1 -2 -1 3 -3 -2 -2 2 7
0 -3 -3 -3 -1 -2 -2 -3 -3 3 1 -2 1 -1 -2 -2 0 -3 -1 4
-2 -1 3 4 -3 0 1 -1 0 -3 -4 0 -3 -3 -2 0 -1 -4 -3 -3 4
-1 0 0 1 -3 3 4 -2 0 -3 -3 1 -1 -3 -1 0 -1 -3 -2 -2 1 4
0 -1 -1 -1 -2 -1 -1 -1 -1 -1 -1 -1 -1 -1 -2 0 0 -2 -1 -1 -1 -1 -1
-4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 -4 1
"""
GAP_OPEN, GAP_EXTEND, UNKNOWN = -11.0, -1.0, -1e6

KERNELS: dict[str, Callable] = {}


def register(name: str):
    def add(f):
        KERNELS[name] = f
        return f

    return add


@lru_cache(1)
def blosum62() -> np.ndarray:
    """Scores by byte; letters outside the matrix have `UNKNOWN`."""
    rows = np.zeros((len(BLOSUM62_LETTERS),) * 2)
    for i, line in enumerate(BLOSUM62_LOWER.strip().splitlines()):
        rows[i, : i + 1] = rows[: i + 1, i] = [float(x) for x in line.split()]
    out = np.full((256, 256), UNKNOWN)
    at = np.frombuffer(BLOSUM62_LETTERS.encode(), np.uint8)
    out[np.ix_(at, at)] = rows
    return out


def affine_score(a: str, b: str, score: np.ndarray, gap_open: float, gap_extend: float) -> float:
    """Global alignment with affine gaps (Gotoh), a row of the table at a time.

    The horizontal gap state of a row is a running maximum, so a row is a few array operations.
    """
    x, y = np.frombuffer(a.encode("latin-1", "replace"), np.uint8), np.frombuffer(b.encode("latin-1", "replace"), np.uint8)
    if not len(x) or not len(y):
        n = max(len(x), len(y))
        return 0.0 if n == 0 else gap_open + gap_extend * (n - 1)
    j = np.arange(len(y) + 1)
    best = np.where(j == 0, 0.0, gap_open + gap_extend * (j - 1))
    down = np.full(len(y) + 1, -np.inf)
    for i, c in enumerate(x, 1):
        down = np.maximum(best + gap_open, down + gap_extend)
        here = down.copy()
        here[1:] = np.maximum(here[1:], best[:-1] + score[c, y])
        here[0] = gap_open + gap_extend * (i - 1)
        # right[j] = max over k < j of here[k] + open + (j - k - 1) * extend
        lead = np.maximum.accumulate(here - gap_extend * j)
        right = np.full(len(here), -np.inf)
        right[1:] = lead[:-1] + gap_open + gap_extend * (j[1:] - 1)
        best = np.maximum(here, right)
    return float(best[-1])


def known(*sequences: str) -> bool:
    """Whether all letters are in the matrix."""
    return all(set(s) <= set(BLOSUM62_LETTERS) for s in sequences)


@register("blosum62")
def blosum_score(a: str, b: str) -> float:
    """Score of the best global alignment; `UNKNOWN` for the whole pair if a letter is not in the matrix."""
    return affine_score(a, b, blosum62(), GAP_OPEN, GAP_EXTEND) if known(a, b) else UNKNOWN


@register("identity")
def sequence_identity(a: str, b: str) -> float | None:
    """Identical residues over the shorter length, on the alignment with the fewest gaps and the best score.

    A gap costs more to open than any substitutions gain, so sequences of one length are laid on each
    other, and others have one gap as long as their difference, where the scores around it are best
    (the first such place). No letters on a side: 0; a letter that is not in the matrix: null.
    """
    if not known(a, b):
        return None
    a, b = sorted((a, b), key=len)
    x, y = (np.frombuffer(s.encode(), np.uint8) for s in (a, b))
    if not len(x):
        return 0.0
    score, gap = blosum62(), len(y) - len(x)
    before, after = np.append(0, np.cumsum(score[x, y[: len(x)]])), np.append(0, np.cumsum(score[x, y[gap:]]))
    at = int(np.argmax(before + (after[-1] - after)))
    return float((x[:at] == y[:at]).sum() + (x[at:] == y[at + gap :]).sum()) / len(x)


def _classes(sequences: list[str]) -> dict[int, tuple[list[int], np.ndarray]]:
    """Places and letters of the sequences of each length."""
    by: dict[int, list[int]] = {}
    for k, s in enumerate(sequences):
        by.setdefault(len(s), []).append(k)
    return {n: (at, np.frombuffer("".join(sequences[k] for k in at).encode("latin-1", "replace"), np.uint8).reshape(len(at), n)) for n, at in by.items()}


#: Numbers that one array of a block of pairs may hold.
_CELLS = 4 << 20


def _by_length(xs: list[str], ys: list[str], f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Matrix of f over pairs of length classes (shorter first), a slice of the first class at a time."""
    out = np.empty((len(xs), len(ys)))
    for n, (at, x) in _classes(xs).items():
        for m, (to, y) in _classes(ys).items():
            step = max(1, _CELLS // max(1, len(to) * (max(n, m) + 1)))
            for k in range(0, len(at), step):
                part = x[k : k + step]
                out[np.ix_(at[k : k + step], to)] = f(part, y) if n <= m else f(y, part).T
    return out


def _unknown(xs: list[str]) -> np.ndarray:
    return np.array([not known(x) for x in xs], bool)


def identity_matrix(xs: list[str], ys: list[str]) -> np.ndarray:
    """`sequence_identity` of all pairs of two lists as array operations by length; nan for unknown letters."""
    score = blosum62()

    def block(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        n, gap = x.shape[1], y.shape[1] - x.shape[1]
        if not n:
            return np.zeros((len(x), len(y)))
        a, b, c = x[:, None, :], y[None, :, :n], y[None, :, gap:]
        start = np.zeros((len(x), len(y), 1))
        before = np.concatenate([start, np.cumsum(score[a, b], axis=2)], axis=2)
        after = np.concatenate([start, np.cumsum(score[a, c], axis=2)], axis=2)
        at = np.argmax(before + (after[:, :, -1:] - after), axis=2)[:, :, None]
        left = np.concatenate([start, np.cumsum(a == b, axis=2)], axis=2)
        right = np.concatenate([start, np.cumsum(a == c, axis=2)], axis=2)
        pick = lambda m: np.take_along_axis(m, at, axis=2)[:, :, 0]
        return (pick(left) + right[:, :, -1] - pick(right)) / n

    out = _by_length(xs, ys, block)
    out[_unknown(xs)] = np.nan
    out[:, _unknown(ys)] = np.nan
    return out


def blosum_matrix(xs: list[str], ys: list[str]) -> np.ndarray:
    """`blosum_score` of all pairs of two lists: the table of a whole block of pairs, a row at a time."""
    score = blosum62()

    def block(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        n, m = x.shape[1], y.shape[1]
        j = np.arange(m + 1)
        if not n:
            return np.full((len(x), len(y)), 0.0 if not m else GAP_OPEN + GAP_EXTEND * (m - 1))
        best = np.broadcast_to(np.where(j == 0, 0.0, GAP_OPEN + GAP_EXTEND * (j - 1)), (len(x), len(y), m + 1))
        down = np.full((len(x), len(y), m + 1), -np.inf)
        for i in range(n):
            down = np.maximum(best + GAP_OPEN, down + GAP_EXTEND)
            here = down.copy()
            here[:, :, 1:] = np.maximum(here[:, :, 1:], best[:, :, :-1] + score[x[:, i, None, None], y[None]])
            here[:, :, 0] = GAP_OPEN + GAP_EXTEND * i
            lead = np.maximum.accumulate(here - GAP_EXTEND * j, axis=2)
            right = np.full(here.shape, -np.inf)
            right[:, :, 1:] = lead[:, :, :-1] + GAP_OPEN + GAP_EXTEND * (j[1:] - 1)
            best = np.maximum(here, right)
        return best[:, :, -1]

    out = _by_length(xs, ys, block)
    out[_unknown(xs)] = UNKNOWN
    out[:, _unknown(ys)] = UNKNOWN
    return out


def pair_kernel(name: str) -> Callable[[Column, Column], Column]:
    """A registered kernel as a column function, evaluated in Arrow batches."""
    f = KERNELS.get(name)
    if f is None:
        raise KeyError(f"no kernel named {name}; register one with kernels.register")

    ship_package(SparkSession.getActiveSession())

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b)], dtype="float64")

    return lambda a, b: run(a, b)
