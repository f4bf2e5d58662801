"""Near de-duplication by SimHash and the generalised pigeonhole.

Distinct fingerprints are cut into parts of correlated bits. If a pair differs in at most `t` bits
then for any thresholds T_1..T_m that add up to t - m + 1 some part i differs in at most T_i bits.
Dynamic programming chooses the thresholds (-1 leaves a part out) and the number of parts from
candidate counts measured on all fingerprints. Each fingerprint probes the neighbours of its part
within T_i and the full distance is verified inside the join, so only links become rows.

Before that, the first and last fingerprint of each part's bucket are linked to the members near
them; the join then only reports links between different components of that. Dense groups never
list their pairs, and no link that joins components is lost.

Defined cases: null and empty texts, and texts without a word, have fingerprint 0; null ids don't
name a component (it is null if all its ids are null); repeated rows are rows of one class; a bit
that exactly half the hashes set is 0; texts of any length are hashed a block at a time; an empty
table gives an empty result; columns beside doc_id and text are ignored by `near_duplicates` and
kept by `keep_one`, under any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.clusters import components
from .common import bounded_batches, spare_name, written
from .exact_dedup import id_filter, probe

WIDTH = 64
SHINGLE = 4
MAX_DISTANCE = 4
_BLOCK = 1 << 16
#: Cost of a probe row (made, shuffled and sorted) in units of one comparison inside the join.
PROBE_COST = 60.0


def shingle_hashes(text: str | None, size: int = SHINGLE, block: int = _BLOCK) -> Iterator[np.ndarray]:
    """XXH64 of each shingle, repeats included, a bounded block at a time."""
    words = (text or "").encode().lower().split()
    if not words:
        return
    if len(words) <= size:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
        return
    joined = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(length + 1) - length - 1
    begins, ends = start[: len(words) - size + 1].tolist(), (start[size - 1 :] + length[size - 1 :]).tolist()
    digest = xxhash.xxh64_intdigest
    for a in range(0, len(begins), block):
        part = [digest(joined[i:j], 42) for i, j in zip(begins[a : a + block], ends[a : a + block])]
        yield np.array(part, np.uint64)


def fingerprint(text: str | None) -> int:
    """Signed 64-bit fingerprint: a bit is set if it is in over half the shingle hashes."""
    n, ones = 0, np.zeros(WIDTH, np.int64)
    for h in shingle_hashes(text):
        n += len(h)
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0]) if n else 0


def fingerprints(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t.as_py()) for t in b.column(1)], pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(compute, "doc_id long, fp long")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and how many have bits i and j set, over all of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((WIDTH, WIDTH)), 0
        for b in batches:
            bits = np.unpackbits(b.column(0).to_numpy().astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
            both += bits.T @ bits
            n += len(bits)
        cells = [*range(WIDTH * WIDTH), -1]
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array([*both.ravel(), float(n)])], names=["cell", "n"])

    sums = {r[0]: r[1] for r in fps.select("fp").mapInArrow(count, "cell int, n double").groupBy("cell").agg(F.sum("n")).collect()}
    return int(sums.get(-1, 0)), np.array([sums.get(i, 0.0) for i in range(WIDTH * WIDTH)]).reshape(WIDTH, WIDTH)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits (0 = most significant) in ``parts`` groups of like size, correlated bits together."""
    p = np.diag(both) / max(n, 1)
    deviation = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(deviation, deviation)
    np.fill_diagonal(corr, 0)
    left, groups = set(range(WIDTH)), []
    for k in range(parts):
        size = (WIDTH + k) // parts
        pool = sorted(left)
        seed = max(pool, key=lambda b: (corr[b, pool].sum(), -b))
        group = [seed]
        left.discard(seed)
        while len(group) < size:
            b = max(sorted(left), key=lambda x: (corr[x, group].sum(), -x))
            group.append(b)
            left.discard(b)
        groups.append(sorted(group))
    return groups


def mask_of(bits: list[int]) -> int:
    m = sum(1 << (WIDTH - 1 - b) for b in bits)
    return m - (1 << 64) if m >> 63 else m


def within(probabilities: np.ndarray, most: int) -> np.ndarray:
    """P(at most t of independent bits differ) for t = 0..most."""
    dist = np.zeros(most + 2)
    dist[0] = 1.0
    for d in probabilities:
        dist[1:] = dist[1:] * (1 - d) + dist[:-1] * d
        dist[0] *= 1 - d
    return np.cumsum(dist[: most + 1])


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds from -1 up, ``costs[i][t + 1]`` for part i, of least cost that add up to ``total``."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for s, (c, chosen) in best.items():
            for k, extra in enumerate(part):
                if (key := s + k - 1) not in nxt or c + extra < nxt[key][0]:
                    nxt[key] = (c + extra, [*chosen, k - 1])
        best = nxt
    return best[total]


def plan(fps: DataFrame, max_distance: int = MAX_DISTANCE) -> list[tuple[int, list[int], int]]:
    """(part, bits, threshold) of the cheapest division of all fingerprints."""
    n, both = bit_statistics(fps)
    p = np.diag(both) / max(n, 1)
    choices = {m: group_bits(n, both, m) for m in range(2, max_distance + 2)}
    keyed = [F.struct(F.lit(m * 100 + i).alias("part"), F.col("fp").bitwiseAND(F.lit(mask_of(g))).alias("key")) for m, gs in choices.items() for i, g in enumerate(gs)]
    buckets = fps.select(F.explode(F.array(*keyed)).alias("k")).groupBy("k.part", "k.key").count()
    pairs = {r[0]: float(r[1]) for r in buckets.groupBy("part").agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2)).collect()}
    found = []
    for m, groups in choices.items():
        total = max_distance - m + 1
        costs = []
        for i, g in enumerate(groups):
            near = within(2 * p[g] * (1 - p[g]), total + m)
            same = max(pairs.get(m * 100 + i, 0.0), n * (n - 1) / 2 * near[0])
            row = [0.0]
            for t in range(total + m):
                probes = sum(comb(len(g), r) for r in range(t + 1))
                row.append(n * (probes + 1) * PROBE_COST + same * near[t] / max(near[0], 1e-30))
            costs.append(row)
        cost, chosen = allocate(costs, total)
        found.append((cost, m, [(i, g, t) for i, (g, t) in enumerate(zip(groups, chosen))]))
    return min(found, key=lambda f: f[:2])[2]


def _flips(bits: list[int], threshold: int) -> list[int]:
    return [mask_of(list(c)) for r in range(threshold + 1) for c in combinations(bits, r)]


def _neighbours(part: int, key: Column, flips: list[int]) -> Column:
    return F.transform(F.array(*[F.lit(f) for f in flips]), lambda f: F.struct(F.lit(part).alias("part"), key.bitwiseXOR(f).alias("key")))


def _probes(division: list[tuple[int, list[int], int]], fp: Column) -> Column:
    return F.explode(F.concat(*[_neighbours(i, fp.bitwiseAND(F.lit(mask_of(bits))), _flips(bits, t)) for i, bits, t in division if t >= 0]))


def _exact(division: list[tuple[int, list[int], int]], fp: Column, every: bool) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(i).alias("part"), fp.bitwiseAND(F.lit(mask_of(g))).alias("key")) for i, g, t in division if every or t >= 0]))


def _near(a: str, b: str, most: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= most


def roots(fps: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(fp, root): distinct fingerprints and a common root for those that links connect."""
    division = plan(fps, max_distance)
    buckets = fps.select("fp", _exact(division, F.col("fp"), every=True).alias("k")).select("fp", "k.part", "k.key")
    # written, so that the join has no aggregate on its keys and a dense bucket can be split
    ends = written(buckets.groupBy("part", "key").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low <> high"), "simhash-ends")
    led = buckets.join(ends, ["part", "key"])
    stars = led.select(F.col("fp").alias("a"), F.explode(F.array("low", "high")).alias("b")).filter((F.col("a") != F.col("b")) & _near("a", "b", max_distance))
    local = components(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    held = written(fps.join(local, fps.fp == local.node, "left").select("fp", F.coalesce("root", "fp").alias("root")), "local-roots")
    index = held.select("fp", "root", _exact(division, F.col("fp"), every=False).alias("k")).select(F.col("k.part"), F.col("k.key"), F.col("fp").alias("a"), F.col("root").alias("ra"))
    probes = held.select("fp", "root", _probes(division, F.col("fp")).alias("k")).select(F.col("k.part").alias("pp"), F.col("k.key").alias("pk"), F.col("fp").alias("b"), F.col("root").alias("rb"))
    joined = index.join(probes, (F.col("part") == F.col("pp")) & (F.col("key") == F.col("pk")) & (F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & _near("a", "b", max_distance))
    final = components(joined.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")))
    step = final.select(F.col("node").alias("root"), F.col("root").alias("next"))
    return held.join(step, "root", "left").select("fp", F.coalesce("next", "root").alias("root"))


def _judged(docs: DataFrame, max_distance: int) -> DataFrame:
    """doc_id, fp, component_id of each row."""
    signed = written(fingerprints(docs), "simhash")
    fps = written(signed.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-distinct")
    rooted = written(fps.join(roots(fps.select("fp"), max_distance), "fp"), "simhash-roots")
    # written, so that the join has no aggregate on its keys and a large component can be split
    least = written(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "simhash-components")
    named = rooted.join(least, "root").select("fp", "component_id")
    return signed.join(named, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of each row."""
    return _judged(docs, max_distance).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _with_fingerprint(docs: DataFrame) -> DataFrame:
    """(row, id, fp): all columns of a row in a struct, so that no name of theirs meets one of ours."""
    at, names = docs.columns.index("text"), docs.columns

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([fingerprint(t.as_py()) for t in b.column(at)], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, fps], names=[*b.schema.names, spare])

    spare = spare_name(names, "fp")
    told = docs.mapInArrow(compute, StructType([*docs.schema.fields, StructField(spare, LongType())]))
    return told.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.col(spare).alias("fp"))


def keep_one(docs: DataFrame, max_distance: int = MAX_DISTANCE, bits_per_row: int = 16, probes: int = 2, max_broadcast_bytes: int = 64 << 20) -> DataFrame:
    """Rows of ``docs``, all columns: of each component the smallest id (rows with a null id stay).

    An id can have texts in several components; only rows of such ids are told apart by fingerprint.
    Ids that go set a bitmap, which is broadcast (`id_filter`); rows whose id is not in it pass straight through.
    """
    judged = written(_judged(docs.select("doc_id", "text"), max_distance), "simhash-judged")
    gone = written(judged.filter("doc_id <> component_id").select(F.col("doc_id").alias("gone"), F.col("fp").alias("gone_fp")).distinct(), "simhash-gone")
    of_gone = F.col("id") == F.col("gone")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"))
    bitmaps, n_bits = id_filter(gone.select(F.col("gone").alias("id")), bits_per_row, probes, max_broadcast_bytes)
    marked = probe(rows, "id", bitmaps, n_bits, probes, True)
    met = marked.filter("maybe").select("row", "id")
    # outer and inner joins: an anti or semi join would be moved below the bitmaps' joins, to all rows
    stays = met.join(gone, of_gone, "left").filter(F.col("gone").isNull()).select("row")
    kept = marked.filter(~F.col("maybe")).select("row").unionByName(stays)
    mixed = written(gone.select("gone").distinct().join(judged.filter("doc_id = component_id").select(F.col("doc_id").alias("id")), of_gone, "left_semi"), "simhash-mixed")
    if mixed.isEmpty():
        return kept.select("row.*")
    told = _with_fingerprint(met.join(mixed, of_gone).select("row.*"))
    return kept.unionByName(told.join(gone, of_gone & (F.col("fp") == F.col("gone_fp")), "left_anti").select("row")).select("row.*")
