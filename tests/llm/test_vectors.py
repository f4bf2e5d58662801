"""Centroid clustering and hard negatives against plain versions in whole numbers."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from compare import assert_same, connect
from pyspark.sql import functions as F

from linkloom.llm import centroids, hard_negatives
from linkloom.llm.queries import ORACLE_SQL, QUERIES


def plain_clusters(rows, k, rounds, dim, scale, seed=1):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: (i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())
    cs = [q for _, q in sorted(kept, key=lambda r: (digest(r[0]), np.array(r[1], "<i4").tobytes()))[:k]]
    far = lambda q, c: sum((x - y) ** 2 for x, y in zip(q, c))
    assign = lambda: [min((far(q, c), j) for j, c in enumerate(cs)) for _, q in kept]
    for _ in range(rounds):
        of = assign()
        for j in range(len(cs)):
            mine = [q for (_, q), (_, at) in zip(kept, of) if at == j]
            if mine:
                cs[j] = [sum(x) // len(mine) for x in zip(*mine)]
    of = assign()
    per = Counter()
    for d, j in of:
        per[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return [(i, j, d, per[j], sum(per.values()), sha[j]) for (i, _), (d, j) in zip(kept, of)]


def vectors(dim, n=300, seed=3):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    rows = [(i, [m + rng.gauss(0, 0.3) for m in rng.choice(middles)]) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(n // 2)]  # a third of all rows is one vector
    rows += [(7, rows[9][1]), (7, rows[9][1]), (None, rows[3][1]), (9001, None), (9002, [0.5] * (dim - 1)), (9003, [0.5] * (dim + 1)), (9004, [])]
    rows += [(9005, [math.nan] + [0.0] * (dim - 1)), (9006, [math.inf] + [0.0] * (dim - 1)), (9007, [None] + [0.0] * (dim - 1)), (9008, [0.0] * dim), (9009, [-0.0078125] * dim)]
    return rows


@pytest.mark.parametrize(("dim", "segment", "k"), [(8, 4, 5), (10, 4, 16), (6, 1, 3)])
def test_clusters_equal_plain_ones(spark, dim, segment, k):
    rows = vectors(dim)
    df = spark.createDataFrame([(v, i, "x", 1) for i, v in rows], "embedding array<double>, vec_id long, cluster string, q int").repartition(5)
    got = centroids.clusters(df, k=k, dim=dim, segment=segment, rounds=3, scale=64)
    key = lambda r: (r[0] is None, *map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain_clusters(rows, k, 3, dim, 64), key=key)


def test_bounds_never_exceed_distances_and_spare_most(spark):
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(16, 64)) * 40
    q = np.floor(middles[rng.integers(0, 16, 2000)] + rng.normal(size=(2000, 64)) * 4).astype(np.int64)
    c = np.floor(middles).astype(np.int64)
    norms = centroids.segment_norms(q, 4).astype("<f4").astype(float)
    label, best, spent = centroids.nearest(q, norms, c, 4)
    far = ((q[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert (best == far.min(axis=1)).all() and (label == far.argmin(axis=1)).all()
    assert spent < 2 * len(q)


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    got = centroids.clusters(df, k=16, dim=2)
    assert {(r.vec_id, r.cluster, r.distance) for r in got.collect()} == {(1, 0, 0), (2, 0, 0)}
    assert centroids.clusters(df.limit(0)).count() == 0
    assert centroids.clusters(df.limit(0)).columns == got.columns


def plain_negatives(rows, anchor, k, n, window, scale, dim):
    kept = []
    for rid, (i, y, v) in enumerate(rows):
        if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((rid, i, y, [math.floor(scale * x) for x in v] + [0] * (dim - len(v))))
    last = 1 << 62
    out = Counter()
    for rid, i, y, q in kept:
        if not anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, r[3])), last if r[1] is None else r[1], r[0], r[1], r[2]) for r in kept if r[0] != rid)
        for p in [s for s in scored if s[4] == y][:k]:
            found = [s for s in scored if s[4] != y and window[0] * -p[0] <= 100 * -s[0] <= window[1] * -p[0]][:n]
            out.update((i, p[3], rank, s[3], -p[0], -s[0]) for rank, s in enumerate(found, 1))
    return out


def labelled(dim, n, seed):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(3), [rng.gauss(0, 1) for _ in range(dim)]) for i in range(n)]
    rows += [(n + i, i % 3, rows[5][2]) for i in range(n // 2)]
    rows += [(None, 1, rows[8][2]), (None, None, rows[8][2]), (20, 1, rows[20][2]), (20, 1, rows[20][2]), (9000, None, [0.0] * dim), (9010, 1, None), (9020, 1, [None] + [0.0] * (dim - 1))]
    rows += [(9030, 2, [math.nan] * dim), (9040, 2, [math.inf] * dim), (9050, 0, [0.0] * dim), (9060, 0, [1.0] * (dim - 2)), (9070, 7, [1.0] * dim), (9080, 0, [])]
    return rows


@pytest.mark.parametrize("block", [32_768, 7])
@pytest.mark.parametrize("window", [(30, 90), (-20, 100)])
def test_negatives_equal_plain_ones(spark, block, window, monkeypatch):
    monkeypatch.setattr(hard_negatives, "_ROWS", 64)
    dim, rows = 6, labelled(6, 200, 8)
    df = spark.createDataFrame([(v, i, y, 1, "x") for i, y, v in rows], "embedding array<double>, vec_id long, label int, rid int, score string").repartition(4)
    got = hard_negatives.mine(df, F.col("vec_id") % 10 == 0, k=3, n=6, window=window, block_anchors=block)
    expected = plain_negatives(rows, lambda i: i is not None and i % 10 == 0, 3, 6, window, 256, dim)
    assert Counter(tuple(r) for r in got.collect()) == expected and expected


def test_no_vectors_and_no_anchors(spark):
    df = spark.createDataFrame([(1, 1, [1.0])], "vec_id long, label int, embedding array<double>")
    for x in (df, df.limit(0)):
        assert hard_negatives.mine(x, F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives.mine(df, F.col("vec_id") == 1).count() == 0


def test_bounds_hold_and_spare_exact_scores():
    rng = np.random.default_rng(1)
    q = np.floor(rng.normal(size=(500, 16)) * 200).astype(np.int64)
    low = q.min(axis=0)
    width = np.maximum(1, -(-(q.max(axis=0) - low + 1) // hard_negatives.CELLS))
    cells = ((q - low) // width).astype(np.intp)
    assert cells.max() < hard_negatives.CELLS
    tables, span = hard_negatives.bound_tables(q[:20], low, width)
    least = hard_negatives.lower_bounds(tables, np.ascontiguousarray(cells.T))
    exact = q[:20] @ q.T
    assert (least <= exact).all() and (exact <= least + span[:, None]).all()
    tenth = np.sort(exact, axis=1)[:, -10][:, None]
    assert (least + span[:, None] >= tenth).sum() < 40 * 20


@pytest.mark.parametrize("name", ["op12_centroids", "op13_hard_negatives"])
def test_queries_equal_their_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    assert_same(QUERIES[name](spark, sf).toPandas(), connect(sf).sql(ORACLE_SQL[name]).df())
