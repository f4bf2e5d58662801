"""Properties that hold for any input."""

import random

import pytest
from pyspark.sql import functions as F

from linkloom import schemas
from linkloom.functions import kernels, text, vectors
from linkloom.operators import clusters, determinism, metrics, negatives, pairwise, splits
from linkloom.operators.links import dictionary_encode, extend_index, links


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def test_components_of_chains_stars_and_random_graphs(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(120)] + [(1000, 1000 + i) for i in range(1, 80)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)] + [(7000, 7000)]
    got = dict(tuple(r) for r in clusters.components(spark.createDataFrame(edges, "a long, b long")).collect())
    expected = {k: v for k, v in union_find([e for e in edges if e[0] != e[1]]).items()}
    assert got == expected


def test_components_of_nothing(spark):
    assert clusters.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_clusters_nest_across_cutoffs(spark, sf):
    from linkloom.plans.fixtures import vector_pairs
    from linkloom.registry import table

    norm = clusters.normalised(vector_pairs(spark, sf)).cache()
    ids = table(spark, sf, "embeddings")
    coarse = dict(tuple(r) for r in clusters.single_linkage(ids, "vec_id", norm, 0.58).collect())
    fine = clusters.single_linkage(ids, "vec_id", norm, 0.62).collect()
    of = {}
    for k, c in fine:
        assert of.setdefault(c, coarse[k]) == coarse[k]


def test_grid_and_builtin_pairs_agree_for_any_blocks(spark, sf):
    from linkloom.registry import table

    e = table(spark, sf, "embeddings").filter("vec_id < 60")
    counts = set()
    for rows in (7, 64):
        a = {(r.i, r.j): r.sim for r in pairwise.pairwise(e, "vec_id", "embedding", "cosine", rows).collect()}
        b = {(r.i, r.j): r.sim for r in pairwise.pairwise_builtin(e, "vec_id", "embedding", vectors.cosine, rows).collect()}
        assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)
        counts.add(len(a))
    assert counts == {60 * 59 // 2}


def test_symmetrised_reader_and_neighbours(spark):
    pairs = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.0), (2, 3, 0.9)], "i long, j long, sim double")
    assert pairwise.symmetrised(pairs).count() == 6
    top = pairwise.top_neighbours(pairs, 1).collect()
    assert {(r.a, r.b) for r in top} == {(1, 2), (2, 3), (3, 2)}
    assert all(r.a != r.b for r in top)


def test_sampling_does_not_depend_on_partitioning(spark, sf):
    from linkloom.plans.fixtures import scored

    s = scored(spark, sf).select("doc_id", "y")
    a = sorted(tuple(r) for r in determinism.downsample_negatives(s, "y", 1, 3, "doc_id").collect())
    b = sorted(tuple(r) for r in determinism.downsample_negatives(s.repartition(7), "y", 1, 3, "doc_id").collect())
    assert a == b


def test_large_samples_are_the_first_in_hash_order(spark, monkeypatch):
    df = spark.range(3000).withColumnRenamed("id", "k")
    whole = [r.k for r in df.orderBy(determinism.hash_order(4, "k"), "k").collect()]
    monkeypatch.setattr(determinism, "TOP_K", 10)
    for n in (0, 11, 1000, 2999, 3000, 5000):
        assert sorted(r.k for r in determinism.take_hashed(df, n, 4, "k").collect()) == sorted(whole[:n])


def test_ranks_do_not_depend_on_partitions(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("v")).repartition(9)
    got = [(r.v, r.n) for r in determinism.ranked(df, "n", F.desc("v")).collect()]
    assert sorted(got, key=lambda x: x[1]) == [(v, n) for n, v in enumerate(sorted((x * 7919 % 5003 for x in range(5000)), reverse=True))]
    assert determinism.ranked(df.limit(0), "n", "v").count() == 0


def test_random_negatives_are_exact_and_stop_at_the_grid(spark):
    full = spark.createDataFrame([(i, j) for i in range(6) for j in range(6) if (i + j) % 3], "pid long, rid long")
    got = negatives.random_negatives(full, "pid", "rid", 10, 1).collect()
    assert len(got) == len(set(got)) == 36 - full.count()
    assert negatives.violations(full, spark.createDataFrame(got), "pid", "rid").count() == 0
    sparse = spark.createDataFrame([(i, (i * 7) % 40) for i in range(40)], "pid long, rid long")
    assert negatives.random_negatives(sparse, "pid", "rid", 3, 1).count() == 120


def test_counting_modes():
    assert negatives.wanted_negatives(10, 10, 10) == 90
    assert negatives.wanted_negatives(10, 10, 10, "reference") == 80


def test_splits_are_disjoint(spark, sf):
    s = splits.random_split(links(spark, sf), "rid", 3, 20, 5)
    assert splits.straddling_groups(s, "rid", "split").count() == 0
    assert {r[0] for r in s.select("split").distinct().collect()} == {-1, 0, 1, 2}


def test_dense_index_and_extension(spark):
    df = spark.createDataFrame([(x,) for x in (5, 1, 9, 5, 1)], "k long")
    known = dictionary_encode(df, "k", "idx")
    assert sorted(tuple(r) for r in known.collect()) == [(1, 0), (5, 1), (9, 2)]
    more = extend_index(known, spark.createDataFrame([(9,), (2,), (7,)], "k long"), "k", "idx")
    assert sorted(tuple(r) for r in more.collect()) == [(1, 0), (2, 3), (5, 1), (7, 4), (9, 2)]


def test_auroc_of_a_permuted_score_is_near_half(spark, sf):
    from linkloom.plans.fixtures import scored

    rows = determinism.permute_column(scored(spark, "/root/testdata/sf0.01").select("doc_id", "y", "score"), "score", 1, "doc_id")
    assert abs(metrics.auroc(rows).first()[0] - 0.5) < 0.12


def test_known_auroc(spark):
    from linkloom.plans.fixtures import scored

    assert abs(metrics.auroc(scored(spark, "/root/testdata/sf0.01")).first()[0] - 0.6066589139447871) < 1e-12


def test_best_threshold_of_hopeless_scores_is_zero(spark):
    rows = spark.createDataFrame([(0, 0.3), (0, 0.9)], "y int, score double")
    counts = metrics.grid_counts(rows, "y", "score").withColumn("f1", metrics.rates()["f1"])
    assert metrics.best_threshold(counts).first()[0] == 0.0


def test_grid_counts_at_the_thresholds_themselves(spark):
    values = [k / 99.0 for k in range(0, 100, 7)] + [0.0, 1.0]
    rows = spark.createDataFrame([(1, v) for v in values], "y int, score double")
    for r in metrics.grid_counts(rows, "y", "score").collect():
        assert r.tp == sum(v > r.t / 99.0 for v in values)


def test_text_functions(spark):
    row = spark.createDataFrame([("(C.O).N>>c:1]", "1,2;3>>4")], "s string, c string").select(
        text.balanced_fragments(F.lit("(C.O).N")).alias("f"), text.encode_centre(text.decode_centre(F.col("c"))).alias("c"),
        text.reverse_sides(F.lit("a.b>>c")).alias("r"), text.match_level(F.lit("1.2.3"), F.lit("1.2.4")).alias("m"),
    ).first()
    assert row.f == ["C.O", "N"] and row.c == "1,2;3>>4" and row.r == "c>>a.b" and row.m == 2


def plain_affine(a, b, score, gap_open, gap_extend):
    """Global alignment by the table of three states, cell by cell."""
    low = float("-inf")
    m, n = len(a), len(b)
    best = [[[low] * 3 for _ in range(n + 1)] for _ in range(m + 1)]
    best[0][0][0] = 0.0
    for i in range(m + 1):
        for j in range(n + 1):
            if i and j:
                best[i][j][0] = max(best[i - 1][j - 1]) + score(a[i - 1], b[j - 1])
            if i:
                best[i][j][1] = max(best[i - 1][j][0] + gap_open, best[i - 1][j][1] + gap_extend, best[i - 1][j][2] + gap_open)
            if j:
                best[i][j][2] = max(best[i][j - 1][0] + gap_open, best[i][j - 1][2] + gap_extend, best[i][j - 1][1] + gap_open)
    return max(best[m][n])


def plain_identity(a, b):
    """Identity on the best of all alignments with one gap, written out."""
    score = lambda x, y: kernels.blosum62()[ord(x), ord(y)]
    a, b = sorted((a, b), key=len)
    laid = [b[:k] + b[k + len(b) - len(a) :] for k in range(len(a) + 1)]
    found = max(laid, key=lambda s: sum(score(x, y) for x, y in zip(a, s)))
    return sum(x == y for x, y in zip(a, found)) / len(a)


def test_alignment_kernels():
    assert kernels.blosum_score("HEAGAWGHEE", "PAWHEAE") == kernels.blosum_score("PAWHEAE", "HEAGAWGHEE")
    assert kernels.blosum_score("ACD", "ACD") == 4 + 9 + 6
    assert kernels.blosum_score("AAAA", "AA") == 4 + 4 - 11 - 1
    assert kernels.blosum_score("ACDJ", "ACDE") == -1e6 and kernels.blosum_score("acd", "ACD") == -1e6
    assert kernels.blosum_score("ABZX*", "ABZX*") == 4 + 4 + 4 - 1 + 1
    assert kernels.sequence_identity("ACDEF", "CDEFG") == 0.0
    assert kernels.sequence_identity("ACDE", "ACE") == 1.0
    assert kernels.sequence_identity("WCDW", "WW") == 1.0 and kernels.sequence_identity("ACDJ", "ACDE") is None
    assert kernels.sequence_identity("", "A") == 0.0
    import random

    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("ARNDCWYV") for _ in range(rng.randint(1, 12))) for _ in range(2))
        assert kernels.blosum_score(a, b) == plain_affine(a, b, lambda x, y: kernels.blosum62()[ord(x), ord(y)], -11.0, -1.0)
        assert kernels.sequence_identity(a, b) == plain_identity(a, b)


def test_blocks_of_pairs_equal_single_pairs(monkeypatch):
    import numpy as np

    rng = random.Random(4)
    words = lambda n: ["".join(rng.choice("ARNDCWYVJ" if rng.random() < 0.1 else "ARNDCWYV") for _ in range(rng.randint(0, 9))) for _ in range(n)]
    for cells in (40, 4 << 20):
        monkeypatch.setattr(kernels, "_CELLS", cells)
        xs, ys = words(30), words(20)
        for many, one in ((kernels.identity_matrix, kernels.sequence_identity), (kernels.blosum_matrix, kernels.blosum_score)):
            got = many(xs, ys)
            expected = np.array([[np.nan if (v := one(x, y)) is None else v for y in ys] for x in xs])
            assert np.array_equal(got, expected, equal_nan=True)


def test_string_pairs_by_threshold(spark):
    words = ["ACDE", "ACDF", "WWWW", "ACD", "", "JJ"]
    df = spark.createDataFrame([(w,) for w in words + words], "s string")
    for rows in (2, 256):
        pairs = {(r.a, r.b): r.x for r in pairwise.string_pairs(df, "s", kernels.identity_matrix, "x", block_rows=rows).collect()}
        assert len(pairs) == 15 and all(pairs[a, b] == kernels.sequence_identity(a, b) for a, b in pairs)
        near = {(r.a, r.b) for r in pairwise.string_pairs(df, "s", kernels.identity_matrix, "x", 0.75, rows).collect()}
        assert near == {p for p, v in pairs.items() if v is not None and v >= 0.75}


def test_fragments_and_tokens_of_reactions(spark):
    one = spark.range(1)
    fragments = lambda s, side=0: one.select(text.side_patterns(F.lit(s), side)).first()[0]
    assert fragments("(N)CC(O).[C:1]>>C") == ["(N)CC(O)", "[C]"] and fragments("(C)>>C") == ["(C)"]
    assert fragments("([C:2].N).O>>(CC.O)N", 0) == ["[C].N", "O"] and fragments("([C:2].N).O>>(CC.O)N", 1) == ["CC.ON"]
    assert fragments("(C.O>>N") == []
    tokens = lambda s: one.select(text.smiles_tokens(F.lit(s))).first()[0]
    assert tokens("C>>O") == ["C", ">>", "O"] and tokens("C>O") == ["C", ">", "O"]
    assert tokens("F/C=C\\F") == ["F", "/", "C", "=", "C", "\\", "F"]
    assert tokens("C%(123)|%12[NH4+]") == ["C", "%(123)", "|", "%12", "[NH4+]"]


def test_vector_and_matrix_files(spark, tmp_path):
    import numpy as np
    from linkloom.sources import files

    np.save(tmp_path / "p1.npy", np.array([1.5, -2.0], np.float32))
    np.save(tmp_path / "p2.npy", np.array([[0.25, 4.0]], np.float32))
    got = {r.id: r.embedding for r in files.read_vectors(spark, str(tmp_path / "p*.npy")).collect()}
    assert got == {"p1": [1.5, -2.0], "p2": [0.25, 4.0]}
    np.save(tmp_path / "m.npy", np.array([[1.0, 0.5, 0.0], [0.5, 1.0, 0.25], [0.0, 0.25, 1.0]]))
    assert sorted(map(tuple, files.read_matrix(spark, str(tmp_path / "m.npy")).collect())) == [(0, 1, 0.5), (1, 2, 0.25)]


@pytest.mark.parametrize("multiple", [1, 2, 9])
def test_free_cells_at_any_density(spark, multiple):
    from linkloom.operators import negatives

    known = spark.createDataFrame([(i, j * 10) for i in range(12) for j in range(9) if (i * j + i) % 4 == 0], "l long, r long")
    n, n_left = known.count(), known.select("l").distinct().count()
    cells = n_left * known.select("r").distinct().count()
    got = [tuple(r) for r in negatives.random_negatives(known, "l", "r", multiple, 3).collect()]
    assert len(got) == len(set(got)) == min(multiple * n, cells - n)
    assert not set(got) & {tuple(r) for r in known.collect()} and len({g[0] for g in got}) > n_left // 2


def test_running_sums_over_many_partitions(spark):
    from linkloom.operators import determinism

    rows = [(i, (i * 37) % 11) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(7)
    total, expected = 0, {}
    for k, v in sorted(rows, reverse=True):
        total += v
        expected[k] = total
    assert {r.k: r.s for r in determinism.running_sums(df, [F.desc("k")], {"s": "v"}).collect()} == expected


def test_schemas_and_config():
    tree = {"a": {"b": 1, "c": "2.5"}, "d": "None"}
    flat = schemas.flatten_config(tree)
    assert flat == {"a/b": 1, "a/c": "2.5", "d": "None"}
    assert schemas.unflatten_config(flat) == {"a": {"b": 1, "c": 2.5}, "d": None}


def test_file_round_trips(spark, tmp_path):
    import numpy as np

    from linkloom.sources import files

    m = np.array([[1.0, 0.5, 0.0], [0.5, 1.0, 0.2], [0.0, 0.2, 1.0]])
    (tmp_path / "m").mkdir()
    np.save(tmp_path / "m" / "x.npy", m)
    got = sorted(tuple(r) for r in files.read_matrix(spark, str(tmp_path / "m" / "*.npy")).collect())
    assert got == [(0, 1, 0.5), (1, 2, 0.2)]
    (tmp_path / "v").mkdir()
    np.save(tmp_path / "v" / "P1.npy", np.arange(3, dtype=np.float32))
    assert [(r.id, r.embedding) for r in files.read_vectors(spark, str(tmp_path / "v" / "*.npy")).collect()] == [("P1", [0.0, 1.0, 2.0])]
    assert [r.id for r in files.file_ids(spark, str(tmp_path / "v")).collect()] == ["P1"]
    (tmp_path / "c.clstr").write_text(">Cluster 0\n0\t10aa, >A... *\n1\t9aa, >B... at 90%\n>Cluster 1\n0\t8aa, >C... *\n")
    assert {(r.member, r.cluster) for r in files.read_cluster_report(spark, str(tmp_path / "c.clstr")).collect()} == {("A", 0), ("B", 0), ("C", 1)}
    store = spark.createDataFrame([("k1", "CC"), ("k2", "OO")], "key string, smarts string")
    files.write_json_store(store, "key", str(tmp_path / "j"))
    from pyspark.sql import types as T

    (tmp_path / "store.json").write_text('{"r1": {"smarts": "C>>O", "reverse": 1}}')
    back = files.read_json_store(spark, str(tmp_path / "store.json"), T.StructType.fromDDL("smarts string, reverse long"))
    assert [tuple(r) for r in back.collect()] == [("r1", "C>>O", 1)]
    merged = files.merge_stores(store, spark.createDataFrame([("k2", "NN")], "key string, smarts string"), "key")
    assert {tuple(r) for r in merged.collect()} == {("k1", "CC"), ("k2", "NN")}


def test_containment_covers_all_customers(spark, tmp_path):
    from linkloom.catalogue import QUERIES

    tokens = {1: "ab", 2: "ba", 3: "a", 4: "abc", 5: "c", 6: "a", 17: "d", 28: "abcd"}
    rows = [(k, t) for k, ts in tokens.items() for t in ts]
    spark.createDataFrame(rows, "o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    members = [tuple(r) for r in QUERIES["j17_containment_members"](spark, str(tmp_path)).select("o_custkey", "set_id").collect()]
    relation = {(r.l, r.r): r.relation for r in QUERIES["j17_containment"](spark, str(tmp_path)).collect()}
    got = {(a, b): relation[x, y] for a, x in members for b, y in members if (x, y) in relation}
    sets = {k: set(ts) for k, ts in tokens.items()}
    expected = {(a, b): "equal" if s == t else "subset" if s < t else "superset" for a, s in sets.items() for b, t in sets.items() if s <= t or s >= t}
    assert got == expected


def test_combined_similarity_covers_all_pairs_and_decides_between_both_sides(spark, sf):
    from linkloom.catalogue import QUERIES
    from linkloom.plans.fixtures import r6, vector_pairs
    from linkloom.registry import table

    n = table(spark, sf, "embeddings").count()
    met = QUERIES["j15_combined_similarity"](spark, sf).join(vector_pairs(spark, sf).select(F.col("i").alias("l1"), F.col("j").alias("l2"), r6("sim").alias("left")), ["l1", "l2"])
    rows = met.agg(F.count(F.lit(1)), F.count_if(F.col("sim") == F.col("left")), F.count_if(F.col("sim") > F.col("left"))).first()
    assert rows[0] == n * (n - 1) // 2 and rows[1] > 0 and rows[2] > 0 and rows[1] + rows[2] == rows[0]


def test_clusters_merge_over_all_pairs(spark, sf):
    from linkloom.catalogue import QUERIES

    merged = sorted(tuple(r) for r in QUERIES["c4_cluster_merge"](spark, sf).collect())
    assert merged == sorted(tuple(r) for r in QUERIES["c2_single_linkage"](spark, sf).collect())


def test_the_order_of_cells_can_be_undone_and_is_that_of_the_columns(spark):
    n_left, n_right = 7, 11
    a, b = determinism.permuted_cells("__j", n_left, n_right, 3)
    by_columns = {tuple(r) for r in spark.range(77).withColumnRenamed("id", "__j").select("__j", a, b).collect()}
    there = determinism.permuted(spark.range(77).withColumnRenamed("id", "__j"), n_left, n_right, 3)
    assert {tuple(r) for r in there.collect()} == by_columns
    assert {tuple(r) for r in determinism.permuted(there, n_left, n_right, 3, back=True).collect()} == by_columns


def test_only_cells_of_the_result_are_made_and_named(spark, monkeypatch):
    """Cells were made for all known ones too, each digest several times, and met the known ones by name."""
    made = []
    own = negatives.permuted
    monkeypatch.setattr(negatives, "permuted", lambda df, *args, back=False: (back or made.append(df.count())) and None or own(df, *args, back=back))
    known = spark.range(300).selectExpr("id % 30 AS a", "(id * 7) % 41 AS b").distinct()
    n = known.count()
    got = negatives.free_cells(known, "a", "b", 200, 5)
    assert made == [200] and got.count() == 200 == got.distinct().count() and got.join(known, ["a", "b"]).count() == 0
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "md5" not in plan and n > 0


def test_generated_negatives_are_counted_as_they_are_listed(spark):
    import random

    from pyspark.sql import functions as F

    from linkloom.operators import negatives

    rng = random.Random(12)
    sides = "abcd"
    made = {(r, f"{l}>>{rng.choice(sides)}") for r, l in ((r, rng.choice(sides)) for r in range(120)) for _ in range(rng.randint(1, 3))}
    known = [(r, rng.choice(sorted(g for x, g in made if x == r) + [f"{rng.choice(sides)}>>x"])) for r in range(120)]
    link = [(rng.choice([None, *range(15)]), rng.randint(0, 130)) for _ in range(200)]
    made, known, link = (spark.createDataFrame(sorted(rows, key=str), kind) for rows, kind in ((made, "r long, generated string"), (known, "r long, s string"), (link, "p long, r long")))
    turned = lambda s: F.concat_ws(">>", F.split(s, ">>")[1], F.split(s, ">>")[0])
    got = {x.p: (x.crossed, x.fresh) for x in negatives.generated_counts(link, known, made, "p", "r", "s", turned).collect()}
    own, texts, others = {}, {r.r: r.s for r in known.collect()}, {}
    for r in made.collect():
        others.setdefault(r.r, set()).add(r.generated)
    others = {r: g - {texts[r]} for r, g in others.items() if texts[r] in g}
    back = lambda g: ">>".join(g.split(">>")[::-1])
    met = {(a, b) for a, gs in others.items() for g in gs for b, s in texts.items() if a != b and s in (g, back(g))}
    met |= {(b, a) for a, b in met}
    for x in link.collect():
        own.setdefault(x.p, set()).add(x.r)
    new = {r: {g for g in gs if not {g, back(g)} & set(texts.values())} for r, gs in others.items()}
    listed = {p: (len({b for a, b in met if a in rs} - rs), len(set().union(*[new.get(r, set()) for r in rs]))) for p, rs in own.items()}
    assert got == {p: n for p, n in listed.items() if any(n)}
