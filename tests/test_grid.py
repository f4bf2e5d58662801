"""All pairs of vectors on a grid of blocks, reduced within its cells, against plain loops."""

import numpy as np
import pytest

from linkloom.operators import clusters, grid
from linkloom.operators.pairwise import KERNELS

COSINE = KERNELS["cosine"]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    v = rng.normal(size=(60, 8)).astype(np.float32)
    v[30:50] = v[10]  # copies: their order must follow from ids alone
    return [(int(k) * 3, v[n].tolist()) for n, k in enumerate(rng.permutation(60))]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "k long, v array<float>")


def plain(rows):
    # equal vectors have one set of values here, whatever place they have
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    size = np.sqrt((v * v).sum(axis=1))
    return ids, np.array([[(a * b).sum() / (x * y) for b, y in zip(v, size)] for a, x in zip(v, size)]).round(12)


@pytest.mark.parametrize("block_rows", [7, 1000])
def test_best_of_each_row_with_copies(df, rows, block_rows):
    ids, sim = plain(rows)
    got = grid.best(df.withColumns({"q": df.k % 2 == 0, "m": df.k % 4}), "k", "v", 5, COSINE, query="q", differ="m", block_rows=block_rows)
    expected = {}
    for x, a in enumerate(ids):
        if a % 2 == 0:
            near = sorted((-sim[x, y], b) for y, b in enumerate(ids) if a % 4 != b % 4)
            expected |= {(int(a), n + 1): int(b) for n, (_, b) in enumerate(near[:5])}
    assert {(r.a, r["rank"]): r.b for r in got.collect()} == expected


def test_what_leaves_the_cells_grows_with_rows_not_pairs(df, rows):
    """A forest a cell: 60 rows in 9 blocks can't give more than 60 x 9 links, whatever the cutoff."""
    ends = clusters.extent(df, "k", "v")
    ids, sim = plain(rows)
    assert np.allclose(ends, (min(sim.min(), 1.0), 1.0))
    links = grid.near_forest(df, "k", "v", COSINE, lambda s: s > -2, block_rows=7)
    assert links.count() < 60 * 9 < 60 * 59 / 2
    assert {r.cluster for r in clusters.vector_linkage(df, "k", "v", ends, -1.0).collect()} == {int(ids.min())}
    for cutoff in (0.7, 0.9):
        near = (sim - ends[0]) / (ends[1] - ends[0]) > cutoff
        root = {int(a): int(a) for a in ids}
        for _ in ids:
            for x, y in zip(*np.nonzero(near)):
                root[int(ids[x])] = min(root[int(ids[x])], root[int(ids[y])])
        assert {r.k: r.cluster for r in clusters.vector_linkage(df, "k", "v", ends, cutoff).collect()} == root


@pytest.mark.parametrize("block_rows", [7, 1000])
def test_pairs_and_cross(df, rows, block_rows):
    ids, sim = plain(rows)
    got = {(r.i, r.j): r.s for r in grid.pairs(df, "k", {"s": ("v", COSINE)}, lambda s: s["s"] > 0.1, block_rows=block_rows).collect()}
    expected = {(int(a), int(b)): sim[x, y] for x, a in enumerate(ids) for y, b in enumerate(ids) if a < b and sim[x, y] > 0.1}
    assert got.keys() == expected.keys() and np.allclose([got[p] for p in expected], list(expected.values()))
    crossed = grid.cross(df.filter("k % 2 = 0"), df.filter("k % 2 = 1"), "k", "k", "v", COSINE, block_rows)
    assert {(r.l, r.r) for r in crossed.collect()} == {(int(a), int(b)) for a in ids for b in ids if a % 2 == 0 and b % 2 == 1}


def test_no_pairs_are_joined_or_sorted(spark, sf):
    """Queries with a row an entity must not send pairs over the network: one exchange of vectors into cells, one of best rows."""
    from linkloom.catalogue import QUERIES

    for name in ("w1_top_neighbours", "j12_max_similarity", "j13_nearest", "j14_known_partner", "j15_combined_similarity", "j19_metric_alignment", "v11_best_direction"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().sparkPlan().toString()
        assert "FlatMapCoGroupsInArrow" not in plan and plan.count("FlatMapGroupsInArrow") == 1, name


def test_first_fit_lists_no_pairs(spark):
    """Of rows that are all near each other the first is the anchor, with no table of pairs: a round writes rows once."""
    from unittest import mock

    df = spark.range(500).selectExpr("id AS k", "array(id / 10000.0D, IF(id = 7, double('NaN'), 0.0D)) AS v")
    with mock.patch.object(grid, "pairs", side_effect=AssertionError("pairs are listed")):
        got = {r.k: r.anchor for r in clusters.first_fit(df, "k", "v", 1.0, 64).collect()}
    assert got == {k: 7 if k == 7 else 0 for k in range(500)}


def test_sibling_pairs_without_a_distinct_of_all(spark):
    from linkloom.operators import pairwise

    links = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (2, 3), (3, 4), (None, 1)], "p long, e long")
    assert sorted(tuple(r) for r in pairwise.sibling_pairs(links, "p", "e").collect()) == [(1, 2), (1, 3), (2, 3)]
    single = spark.range(40).selectExpr("id % 2 AS p", "id AS e")
    plan = pairwise.sibling_pairs(single, "p", "e")
    assert plan.count() == 2 * 20 * 19 // 2 and "HashAggregate" not in plan._jdf.queryExecution().sparkPlan().toString()


def test_a_folder_of_part_files_is_one_entry(spark, tmp_path):
    from linkloom.catalogue import QUERIES

    spark.range(9).repartition(3).write.parquet(str(tmp_path / "orders.parquet"))
    (tmp_path / "nation.parquet").write_bytes(b"x")
    assert sorted(r.id for r in QUERIES["s16_directory_listing"](spark, str(tmp_path)).collect()) == ["nation", "orders"]
