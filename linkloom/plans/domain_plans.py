"""Clusters (C), splits (F), negatives (N), scalar functions (X, V) and kernels (K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import text as X
from ..functions import vectors as V
from ..operators import clusters as C
from ..operators import graphs as G
from ..operators import grid
from ..operators import negatives as N
from ..operators import pairwise as P
from ..operators import splits as Sp

from ..operators.links import assemble, links
from ..registry import query, table
from ..storage import written
from .fixtures import COSINE, HIER, LINKS, PAIRS, RXN, hashed, hier, number, r6, rxn, vector_pairs

NORMAL = f"{PAIRS}, lo AS (SELECT least(min(sim), 1.0::DOUBLE) AS lo, greatest(max(sim), 1.0::DOUBLE) AS hi FROM pairs), norm AS (SELECT i, j, (sim - lo) / (hi - lo) AS sim FROM pairs, lo)"


def clusters_sql(cutoff: float, name: str = "cl") -> str:
    return f"""e{name} AS (SELECT i AS a, j AS b FROM norm WHERE sim > {cutoff}::DOUBLE UNION ALL SELECT j, i FROM norm WHERE sim > {cutoff}::DOUBLE),
    w{name} AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT e.b, w.root FROM w{name} w JOIN e{name} e ON e.a = w.node),
    {name} AS (SELECT node AS vec_id, min(root) AS cluster FROM w{name} GROUP BY node)"""


@query("c1_normalised_distance", f"WITH {NORMAL} SELECT i, j, round(1 - sim, 6) AS distance FROM norm")
def c1(spark, sf):
    lo, hi = C.extent(table(spark, sf, "embeddings"), "vec_id", "embedding")
    scaled = (F.col("sim") - F.lit(lo)) / (F.lit(hi) - F.lit(lo))
    return vector_pairs(spark, sf).select("i", "j", r6(1 - scaled).alias("distance"))


def _clusters(spark, sf, cutoff):
    e = table(spark, sf, "embeddings")
    return C.vector_linkage(e, "vec_id", "embedding", C.extent(e, "vec_id", "embedding"), cutoff)


@query("c2_single_linkage", f"WITH RECURSIVE {NORMAL}, {clusters_sql(0.6)} SELECT vec_id, cluster FROM cl")
def c2(spark, sf):
    return _clusters(spark, sf, 0.6)


@query(
    "c3_first_fit",
    """WITH RECURSIVE r AS (SELECT vec_id, embedding::DOUBLE[] AS v, row_number() OVER (ORDER BY vec_id) AS n FROM embeddings),
    nb AS MATERIALIZED (SELECT b.n, b.vec_id, coalesce(list(a.vec_id) FILTER (a.vec_id IS NOT NULL), []) AS near FROM r b LEFT JOIN r a ON a.n < b.n AND list_max(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2]))) <= 0.35::DOUBLE GROUP BY b.n, b.vec_id),
    s AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS anchors, NULL::BIGINT AS vec_id, NULL::BIGINT AS anchor
        UNION ALL SELECT nb.n, CASE WHEN list_min(list_intersect(anchors, near)) IS NULL THEN list_append(anchors, nb.vec_id) ELSE anchors END, nb.vec_id, coalesce(list_min(list_intersect(anchors, near)), nb.vec_id) FROM s JOIN nb ON nb.n = s.n + 1)
    SELECT vec_id, anchor FROM s WHERE vec_id IS NOT NULL""",
)
def c3(spark, sf):
    return C.first_fit(table(spark, sf, "embeddings"), "vec_id", "embedding", 0.35)


@query(
    "c4_cluster_merge",
    f"""WITH RECURSIVE {NORMAL}, {clusters_sql(0.62, 'base')}, g AS (SELECT a.cluster AS a, b.cluster AS b FROM norm JOIN base a ON i = a.vec_id JOIN base b ON j = b.vec_id WHERE sim > 0.6::DOUBLE AND a.cluster <> b.cluster),
    h AS (SELECT a, b FROM g UNION SELECT b, a FROM g), w AS (SELECT DISTINCT cluster AS node, cluster AS root FROM base UNION SELECT h.b, w.root FROM w JOIN h ON h.a = w.node),
    m AS (SELECT node, min(root) AS root FROM w GROUP BY node) SELECT vec_id, root AS cluster FROM base JOIN m ON cluster = node""",
)
def c4(spark, sf):
    """Clusters merged over all pairs above the second cutoff."""
    e = table(spark, sf, "embeddings")
    ends = C.extent(e, "vec_id", "embedding")
    base = C.vector_linkage(e, "vec_id", "embedding", ends, 0.62)
    return C.merge_clusters(base, "vec_id", "cluster", C.near_links(e, "vec_id", "embedding", ends, 0.6))


@query("c5_mixed_clusters", f"WITH RECURSIVE {NORMAL}, {clusters_sql(0.6)} SELECT cluster, count(DISTINCT vec_id % 2) AS sides, count(*) AS members FROM cl GROUP BY cluster HAVING count(DISTINCT vec_id % 2) > 1")
def c5(spark, sf):
    side = _clusters(spark, sf, 0.6).withColumn("side", F.col("vec_id") % 2)
    return C.mixed_clusters(side, "cluster", "side")


GROUPS = f"g AS (SELECT rid, row_number() OVER (ORDER BY {hashed(1, 'rid')}, rid) AS o, count(*) OVER () AS n FROM (SELECT DISTINCT rid FROM links))"


@query("f1_group_holdout", f"WITH {LINKS}, {GROUPS} SELECT pid, links.rid, o <= ceil(n * 20 / 100) AS held FROM links JOIN g USING (rid)")
def f1(spark, sf):
    return Sp.group_holdout(links(spark, sf), "rid", 20, 1).select("pid", "rid", "held")


@query("f2_group_folds", f"WITH {LINKS} SELECT pid, rid, ({number(2, 'rid')} % 3)::INTEGER AS fold FROM links")
def f2(spark, sf):
    return Sp.group_folds(links(spark, sf), "rid", 3, 2).select("pid", "rid", "fold")


SPLIT = f"{LINKS}, {GROUPS}, s AS (SELECT pid, links.rid, CASE WHEN o <= ceil(n * 20 / 100) THEN -1 ELSE ({number(2, 'links.rid')} % 3)::INTEGER END AS split FROM links JOIN g USING (rid))"


@query("f3_disjoint_groups", f"WITH {SPLIT}, m AS (SELECT rid, split FROM s UNION ALL SELECT rid, 9 FROM s WHERE rid < 4) SELECT rid, count(DISTINCT split) AS n_splits FROM m GROUP BY rid HAVING count(DISTINCT split) > 1")
def f3(spark, sf):
    """The check on a split to which rows of the first groups were added on another side: it finds those groups and no more."""
    s = Sp.random_split(links(spark, sf), "rid", 3, 20, 1).select("rid", "split")
    return Sp.straddling_groups(s.unionByName(s.filter("rid < 4").select("rid", F.lit(9).alias("split"))), "rid", "split")


@query("f4_split_by_entity", f"WITH {SPLIT} SELECT split, count(*) AS n, count(DISTINCT rid) AS groups FROM s GROUP BY split")
def f4(spark, sf):
    return Sp.random_split(links(spark, sf), "rid", 3, 20, 1).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("rid").alias("groups"))


@query("f5_rule_set_groups", "WITH r AS (SELECT p_partkey, array_to_string(list_sort([p_brand, p_type]), '|') AS k FROM part) SELECT p_partkey, dense_rank() OVER (ORDER BY k) - 1 AS grp FROM r")
def f5(spark, sf):
    from ..operators.links import dictionary_encode

    keyed = table(spark, sf, "part").select("p_partkey", Sp.rule_set_key(F.array("p_brand", "p_type")).alias("k"))
    return keyed.join(dictionary_encode(keyed, "k", "grp"), "k").select("p_partkey", "grp")


def _level_points(spark, sf):
    e = table(spark, sf, "embeddings")
    ends = C.extent(e, "vec_id", "embedding")
    coarse = C.vector_linkage(e, "vec_id", "embedding", ends, 0.58).withColumnRenamed("cluster", "c58")
    return coarse.join(C.vector_linkage(e, "vec_id", "embedding", ends, 0.62).withColumnRenamed("cluster", "c62"), "vec_id")


@query(
    "f6_level_draw",
    f"""WITH RECURSIVE {NORMAL}, {clusters_sql(0.6)}, hit AS (SELECT DISTINCT cluster FROM cl WHERE vec_id % 50 = 0), n AS (SELECT greatest(1, floor(0.2::DOUBLE / 2 * count(DISTINCT cluster)))::BIGINT AS n FROM cl),
    o AS (SELECT cluster, row_number() OVER (ORDER BY {hashed(4, 'cluster')}, cluster) AS o FROM (SELECT DISTINCT cluster FROM cl) WHERE cluster NOT IN (SELECT cluster FROM hit))
    SELECT vec_id FROM cl WHERE cluster IN (SELECT cluster FROM o, n WHERE o.o <= n.n)""",
)
def f6(spark, sf):
    points = _clusters(spark, sf, 0.6)
    return Sp.level_draw(points, "vec_id", "cluster", points.filter("vec_id % 50 = 0"), 0.2, 2, 4)


def _stratified_sql(columns: list[str], folds: int, test_percent: float, seed: int) -> str:
    """CTEs of each draw (d), what a split has drawn so far (t) and what is left for the next one (l)."""
    inner = (100 - test_percent) / 100 / folds
    ctes, left, parts = [], "pts", []
    for split, fraction in [(-1, test_percent / 100), *((f, inner) for f in range(folds - 1))]:
        s, taken = split + 1, "none"
        for level, c in enumerate(columns):
            d, order = f"{s}_{level}", hashed(seed + 31 * (split + 2) + level, c)
            ctes.append(
                f"""o{d} AS (SELECT {c}, row_number() OVER (ORDER BY {order}, {c}) AS o FROM (SELECT DISTINCT {c} FROM {left} WHERE {c} NOT IN (SELECT {c} FROM {left} JOIN {taken} USING (vec_id)))),
    n{d} AS (SELECT greatest(1, floor('{fraction / len(columns)!r}'::DOUBLE * count(DISTINCT {c})))::BIGINT AS n FROM {left}),
    t{d} AS MATERIALIZED (SELECT vec_id FROM {taken} UNION SELECT vec_id FROM {left} WHERE {c} IN (SELECT {c} FROM o{d}, n{d} WHERE o <= n))"""
            )
            taken = f"t{d}"
        ctes.append(f"l{s} AS MATERIALIZED (SELECT * FROM {left} WHERE vec_id NOT IN (SELECT vec_id FROM {taken}))")
        left = f"l{s}"
        parts.append(f"SELECT vec_id, {split} AS split FROM {taken}")
    return ", ".join(ctes) + " " + " UNION ALL ".join([*parts, f"SELECT vec_id, {folds - 1} FROM {left}"])


@query(
    "f6_stratified_split",
    f"""WITH RECURSIVE {NORMAL}, {clusters_sql(0.58, 'a58')}, {clusters_sql(0.62, 'a62')}, none AS (SELECT vec_id FROM embeddings LIMIT 0),
    pts AS MATERIALIZED (SELECT vec_id, a58.cluster AS c58, a62.cluster AS c62 FROM a58 JOIN a62 USING (vec_id)), {_stratified_sql(['c58', 'c62'], 3, 20, 8)}""",
)
def f6_all(spark, sf):
    return Sp.stratified_split(_level_points(spark, sf), "vec_id", ["c58", "c62"], 3, 20, 8)


@query("f7_expand_to_pairs", f"WITH {LINKS} SELECT pid, rid, rid % 4 AS split FROM links")
def f7(spark, sf):
    entity = table(spark, sf, "part").select(F.col("p_partkey").alias("rid"), (F.col("p_partkey") % 4).alias("split"))
    return Sp.expand_to_pairs(links(spark, sf), entity, "rid").select("pid", "rid", "split")


@query("f8_fold_roles", f"WITH {SPLIT} SELECT idx, role, count(*) AS n FROM (SELECT -2 AS idx, 'train' AS role FROM s UNION ALL SELECT -1, CASE WHEN split = -1 THEN 'test' ELSE 'train' END FROM s UNION ALL SELECT 1, CASE WHEN split = 1 THEN 'val' ELSE 'train' END FROM s WHERE split <> -1) GROUP BY ALL")
def f8(spark, sf):
    s = Sp.random_split(links(spark, sf), "rid", 3, 20, 1)
    sizes = s.groupBy("split").agg(F.count(F.lit(1)).alias("k"))
    parts = [Sp.arranged(sizes, "split", i).withColumn("idx", F.lit(i)) for i in (-2, -1, 1)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("idx", "role").agg(F.sum("k").alias("n"))


@query("f9_novelty_split", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority <> '5-LOW' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def f9(spark, sf):
    o = table(spark, sf, "orders")
    known = [(o.filter("o_orderstatus = 'F'"), "o_custkey")]
    return Sp.novelty_split(o, known, (F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") != "5-LOW")).select("o_orderkey", "o_custkey")


@query("f10_oversample", "SELECT doc_id, toxic FROM labels, range(3) t(k) WHERE toxic = 1 OR k = 0")
def f10(spark, sf):
    return Sp.oversample_positives(table(spark, sf, "labels").select("doc_id", "toxic"), "toxic", 3)


def cells_sql(seed: int, known: str, left: str, right: str, wanted: str) -> str:
    """Statements up to ``neg``: the first ``wanted`` cells of the permuted grid that ``known`` lacks."""
    step = lambda r, c: number(f"{seed}:{r}", c)
    return f"""li AS (SELECT {left}, row_number() OVER (ORDER BY {left}) - 1 AS i FROM (SELECT DISTINCT {left} FROM {known})), ri AS (SELECT {right}, row_number() OVER (ORDER BY {right}) - 1 AS i FROM (SELECT DISTINCT {right} FROM {known})),
    z AS (SELECT (SELECT count(*) FROM li) AS nl, (SELECT count(*) FROM ri) AS nr, (SELECT count(*) FROM {known}) AS nk, greatest(0, least(({wanted})::BIGINT, (SELECT count(*) FROM li) * (SELECT count(*) FROM ri) - (SELECT count(*) FROM {known}))) AS want),
    c0 AS (SELECT j, j // nr AS l, j % nr AS r, nl, nr FROM z, range((SELECT (CASE WHEN want > 0 THEN want + nk ELSE 0 END)::BIGINT FROM z)) t(j)),
    c1 AS (SELECT j, (l + {step(1, 'r')}) % nl AS l, r, nl, nr FROM c0), c2 AS (SELECT j, l, (r + {step(2, 'l')}) % nr AS r, nl, nr FROM c1),
    c3 AS (SELECT j, (l + {step(3, 'r')}) % nl AS l, r, nl, nr FROM c2), c4 AS (SELECT j, l, (r + {step(4, 'l')}) % nr AS r FROM c3),
    neg AS (SELECT {left}, {right} FROM c4 JOIN li ON c4.l = li.i JOIN ri ON c4.r = ri.i WHERE ({left}, {right}) NOT IN (SELECT ({left}, {right}) FROM {known}) ORDER BY j LIMIT (SELECT want::BIGINT FROM z))"""


FREE = f"{LINKS}, {cells_sql(42, 'links', 'pid', 'rid', 'SELECT 3 * count(*) FROM links')}"


@query("n1_random_negatives", f"WITH {FREE} SELECT pid, rid FROM neg")
def n1(spark, sf):
    return N.random_negatives(links(spark, sf), "pid", "rid", 3, 42)


@query(
    "n1_random_negatives_staged",
    f"""WITH {FREE}, a AS (SELECT pid, rid, 1 AS y FROM links UNION ALL SELECT pid, rid, 0 FROM neg)
    SELECT ({number(2, 'rid')} % 3)::INTEGER AS fold, c_mktsegment, count(*) AS n, round(avg(y), 6) AS positive FROM a JOIN customer ON pid = c_custkey JOIN part ON rid = p_partkey GROUP BY ALL""",
)
def n1_staged(spark, sf):
    """Links, three sampled negatives each, attributes, folds by right entity: size and share of positives."""
    link = written(links(spark, sf), "links")
    pairs = Sp.group_folds(N.labelled_pairs(link, N.random_negatives(link, "pid", "rid", 3, 42)), "rid", 3, 2)
    left = table(spark, sf, "customer").select(F.col("c_custkey").alias("pid"), "c_mktsegment")
    staged = assemble(pairs, left, "pid", table(spark, sf, "part").select(F.col("p_partkey").alias("rid")), "rid")
    return staged.groupBy("fold", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("y")).alias("positive"))




@query(
    "n2_generated_negatives",
    f"""WITH {LINKS}, k AS (SELECT p_size::VARCHAR AS rid, concat('a', p_size % 10, '>>', 'b', p_size // 10) AS s FROM (SELECT DISTINCT p_size FROM part)),
    own AS (SELECT DISTINCT pid, p_size::VARCHAR AS rid FROM links JOIN part ON rid = p_partkey),
    gen AS (SELECT rid, s, unnest([s, concat(string_split(s, '>>')[1], '>>b', (rid::INTEGER + 7) % 6)]) AS g FROM k),
    oth AS (SELECT DISTINCT rid, g, concat(string_split(g, '>>')[2], '>>', string_split(g, '>>')[1]) AS rv FROM gen WHERE g <> s),
    met AS (SELECT DISTINCT o.rid AS a, k.rid AS b FROM oth o JOIN k ON (o.g = k.s OR o.rv = k.s) AND o.rid <> k.rid), both_ AS (SELECT a, b FROM met UNION SELECT b, a FROM met),
    crossed AS (SELECT DISTINCT pid, b AS rid FROM own JOIN both_ ON rid = a EXCEPT SELECT pid, rid FROM own),
    fresh AS (SELECT * FROM oth WHERE g NOT IN (SELECT s FROM k) AND rv NOT IN (SELECT s FROM k))
    SELECT pid, rid FROM crossed UNION ALL (SELECT DISTINCT pid, sha1(g) FROM fresh JOIN own USING (rid))""",
)
def n2(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_size")
    own = links(spark, sf).join(part, F.col("rid") == F.col("p_partkey")).select("pid", F.col("p_size").cast("string").alias("rid")).distinct()
    known = part.select("p_size").distinct().select(F.col("p_size").cast("string").alias("rid"), F.concat(F.lit("a"), F.col("p_size") % 10, F.lit(">>b"), F.floor(F.col("p_size") / 10)).alias("s"))

    def rule(rows):
        other = F.concat(F.split("s", ">>")[0], F.lit(">>b"), (F.col("rid").cast("int") + 7) % 6)
        return rows.withColumn("generated", F.explode(F.array("s", other)))

    return N.generated_negatives(own, known, "pid", "rid", "s", rule, X.reverse_sides)[0]


@query(
    "n3_upsampled_negatives",
    f"""WITH b AS (SELECT DISTINCT s_suppkey % 20 AS l, s_nationkey AS r FROM supplier), k AS (SELECT l, r, CASE WHEN (l + r) % 4 = 0 THEN 0 ELSE 1 END AS y FROM b), known AS (SELECT l AS a, r AS b FROM k),
    {cells_sql(6, 'known', 'a', 'b', 'SELECT 2 * sum(y) - sum(1 - y) FROM k')}
    SELECT l, r, y FROM k UNION ALL SELECT a, b, 0 FROM neg""",
)
def n3(spark, sf):
    b = table(spark, sf, "supplier").select((F.col("s_suppkey") % 20).alias("l"), F.col("s_nationkey").alias("r")).distinct()
    return N.upsample_negatives(b.withColumn("y", F.when((F.col("l") + F.col("r")) % 4 == 0, 0).otherwise(1)), "l", "r", 2, 6)


@query("n4_batch_negatives", "WITH l AS (SELECT DISTINCT s_nationkey AS b, s_suppkey AS l, s_suppkey % 13 AS r FROM supplier) SELECT DISTINCT x.b, x.l, y.r FROM l x JOIN l y USING (b) WHERE NOT EXISTS (SELECT 1 FROM l z WHERE z.l = x.l AND z.r = y.r)")
def n4(spark, sf):
    l = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("b"), F.col("s_suppkey").alias("l"), (F.col("s_suppkey") % 13).alias("r")).distinct()
    return N.batch_negatives(l, "b", "l", "r").select("b", "l", "r")


@query("n5_negative_validity", f"WITH {FREE}, mixed AS (SELECT pid, rid FROM neg UNION ALL SELECT pid, rid FROM links WHERE pid = (SELECT min(pid) FROM links)) SELECT pid, rid FROM mixed JOIN links USING (pid, rid)")
def n5(spark, sf):
    """The check on sampled negatives among which the links of the first entity were put: it finds those and no more."""
    link = written(links(spark, sf), "links")
    planted = link.join(link.agg(F.min("pid").alias("pid")), "pid", "left_semi").select("pid", "rid")
    return N.violations(link, N.random_negatives(link, "pid", "rid", 3, 42).unionByName(planted), "pid", "rid").select("pid", "rid")


@query("x1_reverse_sides", f"WITH {RXN} SELECT p_partkey, concat(string_split(s, '>>')[2], '>>', string_split(s, '>>')[1]) AS r FROM rxn")
def x1(spark, sf):
    return rxn(spark, sf).select("p_partkey", X.reverse_sides(F.col("s")).alias("r"))


@query("x2_canonical_components", f"WITH {RXN} SELECT p_partkey, concat(array_to_string(list_sort(string_split(string_split(s, '>>')[1], '.')), '.'), '>>', array_to_string(list_sort(string_split(string_split(s, '>>')[2], '.')), '.')) AS r FROM rxn")
def x2(spark, sf):
    return rxn(spark, sf).select("p_partkey", X.canonical_components(F.col("s")).alias("r"))


@query("x3_content_id", f"WITH {RXN} SELECT p_partkey, sha1(s) AS id FROM rxn")
def x3(spark, sf):
    return rxn(spark, sf).select("p_partkey", X.content_id(F.col("s")).alias("id"))


@query("x4_fractionate", f"WITH {RXN} SELECT p_partkey, unnest(string_split(replace(s, '>>', '.'), '.')) AS part FROM rxn")
def x4(spark, sf):
    return rxn(spark, sf).select("p_partkey", F.explode(X.fractionate(F.col("s"))).alias("part"))


@query("x5_strip_map_numbers", "SELECT p_partkey, concat('[', p_type, ']>>[O]') AS r FROM part")
def x5(spark, sf):
    mapped = F.concat(F.lit("["), F.col("p_type"), F.lit(":"), F.col("p_size"), F.lit("]>>[O:12]"))
    return table(spark, sf, "part").select("p_partkey", X.strip_map_numbers(mapped).alias("r"))


@query("x6_balanced_fragments", "SELECT p_partkey, [concat(p_type, '.', p_brand), concat('(', p_size, ')C'), p_name] AS r FROM part")
def x6(spark, sf):
    """Grouping goes from the rejoined fragment only; map numbers go from all."""
    s = F.concat(F.lit("("), F.col("p_type"), F.lit("."), F.col("p_brand"), F.lit(").("), F.col("p_size"), F.lit(")C."), F.col("p_name"), F.lit(">>[O:1]"))
    return table(spark, sf, "part").select("p_partkey", X.side_patterns(s, 0).alias("r"))


@query("x7_centre_codec", "SELECT p_partkey, concat(p_size, ',', p_partkey % 9, ';3>>', p_size) AS r, p_size + p_partkey % 9 + 3 + p_size AS total FROM part")
def x7(spark, sf):
    s = F.concat_ws("", "p_size", F.lit(","), F.col("p_partkey") % 9, F.lit(";3>>"), "p_size")
    c = table(spark, sf, "part").select("p_partkey", X.decode_centre(s).alias("c"))
    return c.select("p_partkey", X.encode_centre(F.col("c")).alias("r"), F.aggregate(F.flatten(F.flatten("c")), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


_TOKENS = "CASE WHEN p_size % 2 = 0 THEN '( = O )' ELSE '# N' END, '[O-]', CASE WHEN p_partkey % 3 = 0 THEN '. Cl' ELSE 'Br' END, CASE WHEN p_size % 5 = 0 THEN '%(123) |' ELSE 'F / C = C \\ F' END"


@query("x8_smiles_tokens", f"SELECT p_partkey, concat_ws(' ', 'C', {_TOKENS}, '>>', 'c 1 c c c', p_size % 9, '%12 n 1 > @') AS tokens FROM part")
def x8(spark, sf):
    """Texts put together from known tokens: what the pattern finds must be these again."""
    size = F.col("p_size")
    known = [F.lit("C"), F.when(size % 2 == 0, "(=O)").otherwise("#N"), F.lit("[O-]"), F.when(F.col("p_partkey") % 3 == 0, ".Cl").otherwise("Br")]
    known += [F.when(size % 5 == 0, "%(123)|").otherwise("F/C=C\\F"), F.lit(">>c1ccc"), size % 9, F.lit("%12n1>@")]
    return table(spark, sf, "part").select("p_partkey", F.array_join(X.smiles_tokens(F.concat(*known)), " ").alias("tokens"))


@query("x9_encode_pad", "SELECT p_partkey, list_concat(t[1:4], CASE WHEN len(t) >= 4 THEN [] ELSE [0 FOR k IN range(4 - len(t))] END) AS ids, list_concat([1 FOR k IN range(least(len(t), 4))], [0 FOR k IN range(4 - least(len(t), 4))]) AS mask FROM (SELECT p_partkey, [length(w)::INTEGER FOR w IN string_split(concat(p_name, ' ', CASE WHEN p_size > 25 THEN 'a bc def' ELSE '' END), ' ') IF w <> ''] AS t FROM part)")
def x9(spark, sf):
    words = F.filter(F.split(F.concat_ws(" ", "p_name", F.when(F.col("p_size") > 25, "a bc def").otherwise("")), " "), lambda w: w != "")
    t = table(spark, sf, "part").select("p_partkey", F.transform(words, lambda w: F.length(w)).alias("t"))
    return t.select("p_partkey", X.pad_ids(F.col("t"), 4, 0).alias("ids"), X.attention_mask(F.col("t"), 4).alias("mask"))


@query("x10_component_filter", "SELECT p_partkey, array_to_string([w FOR w IN string_split(p_name, ' ') IF w NOT IN ('small', 'red')], '.') AS kept, substr(replace(p_brand, '#', '_'), 1, 7) AS short FROM part")
def x10(spark, sf):
    dotted = F.replace("p_name", F.lit(" "), F.lit("."))
    return table(spark, sf, "part").select("p_partkey", X.drop_components(dotted, ["small", "red"]).alias("kept"), F.substring(F.replace("p_brand", F.lit("#"), F.lit("_")), 1, 7).alias("short"))


@query("x11_trailing_number", "SELECT c_custkey, regexp_extract(c_name, '([0-9]+)$', 1)::BIGINT AS n FROM customer")
def x11(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", X.trailing_number(F.col("c_name")).alias("n"))


@query("x13_hierarchy_match", f"WITH {HIER}, p AS (SELECT c_custkey, string_split(code, '.') AS a, string_split(concat('1.', c_custkey % 25, '.BUILDING'), '.') AS b FROM hier) SELECT c_custkey, (CASE WHEN a[1] <> b[1] THEN 0 WHEN a[2] <> b[2] THEN 1 WHEN a[3] <> b[3] THEN 2 ELSE 3 END)::INTEGER AS level FROM p")
def x13(spark, sf):
    other = F.concat(F.lit("1."), F.col("c_custkey") % 25, F.lit(".BUILDING"))
    return hier(spark, sf).select("c_custkey", X.best_match_level(F.array("code"), F.array(other)).alias("level"))


@query("x14_lengths", f"WITH {RXN} SELECT p_partkey, length(s) AS n, len(string_split(replace(s, '>>', '.'), '.'))::INTEGER AS parts FROM rxn")
def x14(spark, sf):
    return rxn(spark, sf).select("p_partkey", F.length("s").cast("long").alias("n"), F.size(X.fractionate(F.col("s"))).alias("parts"))


@query("x15_literal_parse", "SELECT p_partkey, p_size + 1 AS total FROM part")
def x15(spark, sf):
    text = F.concat(F.lit("["), F.col("p_size"), F.lit(", 1]"))
    return table(spark, sf, "part").select("p_partkey", F.aggregate(F.from_json(text, "array<int>"), F.lit(0), lambda a, x: a + x).alias("total"))


#: Each vector meets the first one of its label.
E0 = "e0 AS (SELECT e.label AS l0, e.embedding::DOUBLE[] AS q FROM embeddings e JOIN (SELECT label, min(vec_id) AS first FROM embeddings GROUP BY label) f ON f.label = e.label AND f.first = e.vec_id)"


def _with_first(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.join(e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("q")), "label")


@query("v1_dot_sigmoid", f"WITH {E0} SELECT vec_id, round(1 / (1 + exp(-list_dot_product(embedding::DOUBLE[], q))), 6) AS p FROM embeddings JOIN e0 ON l0 = label")
def v1(spark, sf):
    return _with_first(spark, sf).select("vec_id", r6(V.sigmoid(V.dot(F.col("embedding"), F.col("q")))).alias("p"))


@query("v2_cosine", f"WITH {E0} SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], q) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) / sqrt(list_dot_product(q, q)), 6) AS c FROM embeddings JOIN e0 ON l0 = label")
def v2(spark, sf):
    return _with_first(spark, sf).select("vec_id", r6(V.cosine(F.col("embedding"), F.col("q"))).alias("c"))


@query("v3_tanimoto", f"WITH {E0}, b AS (SELECT vec_id, [CASE WHEN x > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FOR x IN embedding] AS a, [CASE WHEN x > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FOR x IN q] AS q FROM embeddings JOIN e0 ON l0 = label) SELECT vec_id, round(list_dot_product(a, q) / (list_sum(a) + list_sum(q) - list_dot_product(a, q)), 6) AS t FROM b")
def v3(spark, sf):
    met = _with_first(spark, sf)
    return met.select("vec_id", r6(V.tanimoto(V.binarise(F.col("embedding")), V.binarise(F.col("q")))).alias("t"))


@query("v4_cross_similarity", "SELECT a.vec_id AS l, b.vec_id AS r, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim FROM embeddings a, embeddings b WHERE a.vec_id % 2 = 0 AND b.vec_id % 2 = 1")
def v4(spark, sf):
    e = table(spark, sf, "embeddings")
    return P.cross_similarity(e.filter("vec_id % 2 = 0"), e.filter("vec_id % 2 = 1"), "vec_id", "vec_id", "embedding").select("l", "r", r6("sim").alias("sim"))


@query("v5_absolute_difference", f"WITH {E0} SELECT vec_id, round(list_sum([abs(x - y) FOR x, k IN embedding::DOUBLE[]]), 6) AS d FROM embeddings JOIN e0 ON l0 = label".replace("[abs(x - y) FOR x, k IN embedding::DOUBLE[]]", "list_transform(list_zip(embedding::DOUBLE[], q), lambda z: abs(z[1] - z[2]))"))
def v5(spark, sf):
    met = _with_first(spark, sf)
    return met.select("vec_id", r6(F.aggregate(V.absolute_difference(F.col("embedding"), F.col("q")), F.lit(0.0), lambda a, x: a + x)).alias("d"))


@query("v6_concatenated", "SELECT vec_id, round(list_dot_product(list_concat(embedding, embedding)::DOUBLE[], list_concat(embedding, embedding)::DOUBLE[]), 6) AS n FROM embeddings")
def v6(spark, sf):
    both = F.concat("embedding", "embedding")
    return table(spark, sf, "embeddings").select("vec_id", r6(V.dot(both, both)).alias("n"))


@query("v7_clamp_and_bins", "SELECT l_orderkey, l_linenumber, least(40, greatest(10, l_quantity)) AS q, CASE WHEN l_quantity < 10 THEN '<10' WHEN l_quantity < 25 THEN '[10, 25)' WHEN l_quantity < 40 THEN '[25, 40)' ELSE '>40' END AS bin FROM lineitem")
def v7(spark, sf):
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", V.clamp(q, 10.0, 40.0).alias("q"), V.bin_label(q, [10.0, 25.0, 40.0]).alias("bin"))


@query("v8_all_close", f"WITH {E0} SELECT vec_id, list_max(list_transform(list_zip(embedding::DOUBLE[], q), lambda z: abs(z[1] - z[2]))) <= 0.3::DOUBLE AS close, round(list_max(list_transform(list_zip(embedding::DOUBLE[], q), lambda z: abs(z[1] - z[2]))), 6) AS worst FROM embeddings JOIN e0 ON l0 = label")
def v8(spark, sf):
    met = _with_first(spark, sf)
    return met.select("vec_id", V.all_close(F.col("embedding"), F.col("q"), rtol=0.0, atol=0.3).alias("close"), r6(V.max_absolute_difference(F.col("embedding"), F.col("q"))).alias("worst"))


@query("v9_two_tower", "WITH p AS (SELECT vec_id, embedding[1]::DOUBLE + 2 * embedding[2]::DOUBLE + 0.5::DOUBLE AS a1, embedding[3]::DOUBLE - 0.25::DOUBLE AS a2, embedding[1]::DOUBLE AS b1, embedding[2]::DOUBLE + embedding[3]::DOUBLE AS b2 FROM embeddings) SELECT vec_id, round(1 / (1 + exp(-(a1 * b1 + a2 * b2))), 6) AS p FROM p")
def v9(spark, sf):
    x = F.slice("embedding", 1, 3)
    return table(spark, sf, "embeddings").select("vec_id", r6(V.two_tower_score([[1, 2, 0], [0, 0, 1]], [0.5, -0.25], [[1, 0, 0], [0, 1, 1]], [0.0, 0.0], x, x)).alias("p"))


_SWAPPED = COSINE.replace("b.embedding", "list_concat(b.embedding[33:64], b.embedding[1:32])")


@query("v11_best_direction", f"SELECT a.vec_id AS i, b.vec_id AS j, round(greatest({COSINE}, {_SWAPPED}), 6) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND a.label = b.label")
def v11(spark, sf):
    """Pairs behind a gate (one label): the better of the forward similarity and that to the other's halves swapped."""
    found = grid.pairs(table(spark, sf, "embeddings"), "vec_id", {"sim": ("embedding", P.KERNELS["cosine_either_way"])}, same="label")
    return found.select("i", "j", r6("sim").alias("sim"))


_SEQUENCES = "upper(regexp_replace(p_name, '[^acdefghiklmnpqrstuvwy]', '', 'g'))"
_MATRIX = "VALUES " + ", ".join(f"('{a}', '{b}', {int(K.blosum62()[ord(a), ord(b)])})" for a in K.BLOSUM62_LETTERS for b in K.BLOSUM62_LETTERS)


def _sequences(spark, sf):
    return table(spark, sf, "part").select(F.upper(F.regexp_replace("p_name", "[^acdefghiklmnpqrstuvwy]", "")).alias("s"))


@query(
    "k1_sequence_identity",
    f"""WITH m(x, y, v) AS ({_MATRIX}), s AS (SELECT DISTINCT {_SEQUENCES} AS s FROM part), p AS (SELECT a.s AS a, b.s AS b, CASE WHEN length(a.s) <= length(b.s) THEN a.s ELSE b.s END AS short, CASE WHEN length(a.s) <= length(b.s) THEN b.s ELSE a.s END AS long FROM s a JOIN s b ON a.s < b.s),
    c AS (SELECT a, b, short, long, k, i, short[i:i] AS x, long[(CASE WHEN i <= k THEN i ELSE i + length(long) - length(short) END):(CASE WHEN i <= k THEN i ELSE i + length(long) - length(short) END)] AS y
        FROM (SELECT *, unnest(range(length(short) + 1)) AS k FROM p), range(1, 60) t(i) WHERE i <= length(short)),
    g AS (SELECT a, b, k, sum(v) AS score, sum(CASE WHEN c.x = c.y THEN 1 ELSE 0 END) / min(length(short)) AS identity FROM c JOIN m ON m.x = c.x AND m.y = c.y GROUP BY a, b, k)
    SELECT a, b, CASE WHEN concat(a, b) NOT LIKE '%U%' THEN round(arg_max(identity, (score, -k)), 6) END AS identity FROM g GROUP BY a, b""",
)
def k1(spark, sf):
    return P.string_pairs(_sequences(spark, sf), "s", K.identity_matrix, "identity").withColumn("identity", r6("identity"))


#: A row of the table of three states a step: `best` and `down` are lists over the places of the second sequence.
_GOTOH = """t AS (SELECT a, b, 0 AS i, list_transform(range(length(b) + 1), lambda j: CASE WHEN j = 0 THEN 0 ELSE -10 - j END)::DOUBLE[] AS best, list_transform(range(length(b) + 1), lambda j: -1e9)::DOUBLE[] AS down FROM pairs
    UNION ALL SELECT a, b, i, list_transform(range(length(b) + 1), lambda j: greatest(here[j + 1], list_max(list_transform(range(j + 1), lambda k: CASE WHEN k = j THEN here[j + 1] ELSE here[k + 1] - 10 - j + k END)))), down FROM (
        SELECT a, b, i, down, list_transform(range(length(b) + 1), lambda j: CASE WHEN j = 0 THEN -10.0 - i ELSE greatest(down[j + 1], best[j] + score[x * 24 + strpos(letters, b[j:j])]) END) AS here FROM (
            SELECT a, b, i + 1 AS i, best, strpos(letters, a[i + 1:i + 1]) - 1 AS x, list_transform(range(length(b) + 1), lambda j: greatest(best[j + 1] - 11, down[j + 1] - 1)) AS down, score, letters FROM t, m WHERE i < length(a))))"""
_SCORES = "[" + ", ".join(str(int(K.blosum62()[ord(a), ord(b)])) for a in K.BLOSUM62_LETTERS for b in K.BLOSUM62_LETTERS) + "]"


@query(
    "k2_blosum_score",
    f"""WITH RECURSIVE m AS (SELECT {_SCORES}::DOUBLE[] AS score, '{K.BLOSUM62_LETTERS}' AS letters), s AS (SELECT DISTINCT {_SEQUENCES} AS s FROM part), pairs AS (SELECT x.s AS a, y.s AS b FROM s x JOIN s y ON x.s < y.s), {_GOTOH}
    SELECT a, b, CASE WHEN concat(a, b) LIKE '%U%' THEN -1e6 ELSE best[-1] END::DOUBLE AS score FROM t WHERE i = length(a)""",
)
def k2(spark, sf):
    return P.string_pairs(_sequences(spark, sf), "s", K.blosum_matrix, "score")


BONDS = "b AS (SELECT l_orderkey AS g, l_linenumber AS u, l_linenumber + 1 AS v, 1 AS bond FROM lineitem), a AS (SELECT l_orderkey AS g, l_linenumber AS u, l_linenumber + 1 AS v, CASE WHEN l_quantity > 25 THEN 2 ELSE 1 END AS bond FROM lineitem WHERE l_returnflag <> 'R')"


def _bonds(spark, sf):
    i = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("u"), (F.col("l_linenumber") + 1).alias("v"), "l_quantity", "l_returnflag")
    before = i.select("g", "u", "v", F.lit(1).alias("bond"))
    return before, i.filter("l_returnflag <> 'R'").select("g", "u", "v", F.when(F.col("l_quantity") > 25, 2).otherwise(1).alias("bond"))


@query("k9_reaction_centre", f"WITH {BONDS}, c AS (SELECT coalesce(b.g, a.g) AS g, coalesce(b.u, a.u) AS u, coalesce(b.v, a.v) AS v FROM b FULL JOIN a ON a.g = b.g AND a.u = b.u AND a.v = b.v WHERE coalesce(a.bond, 0) <> coalesce(b.bond, 0)) SELECT DISTINCT g, unnest([u, v]) AS node FROM c")
def k9(spark, sf):
    return G.reaction_centre(*_bonds(spark, sf), "g")


@query(
    "k10_balance",
    """WITH b AS (SELECT l_orderkey AS g, l_linenumber AS num, count(*) AS n, min(l_returnflag) AS e FROM lineitem GROUP BY ALL),
    a AS (SELECT l_orderkey AS g, l_linenumber AS num, count(*) AS n, min(CASE WHEN l_quantity > 49 THEN 'X' ELSE l_returnflag END) AS e FROM lineitem WHERE l_quantity > 2 GROUP BY l_orderkey, l_linenumber)
    SELECT b.g, min(CASE WHEN a.n = 1 AND b.n = 1 AND a.e = b.e THEN 1 ELSE 0 END) = 1 AS balanced FROM b LEFT JOIN a ON a.g = b.g AND a.num = b.num GROUP BY b.g""",
)
def k10(spark, sf):
    i = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("num"), F.col("l_returnflag").alias("element"), "l_quantity")
    after = i.filter("l_quantity > 2").select("g", "num", F.when(F.col("l_quantity") > 49, "X").otherwise(F.col("element")).alias("element"))
    return G.balance(i.select("g", "num", "element"), after, "g")


@query(
    "k12_within_hops",
    """WITH e AS (SELECT DISTINCT l_orderkey AS g, l_linenumber AS u, l_linenumber + 1 AS v FROM lineitem), d AS (SELECT g, u, v FROM e UNION SELECT g, v, u FROM e),
    h0 AS (SELECT DISTINCT g, 1 AS node FROM e), h1 AS (SELECT DISTINCT g, v AS node FROM d JOIN h0 USING (g) WHERE u = node EXCEPT SELECT g, node FROM h0),
    h2 AS (SELECT DISTINCT g, v AS node FROM d JOIN h1 USING (g) WHERE u = node EXCEPT (SELECT g, node FROM h0 UNION SELECT g, node FROM h1))
    SELECT g, node, 0 AS hop FROM h0 UNION ALL SELECT g, node, 1 FROM h1 UNION ALL SELECT g, node, 2 FROM h2""",
)
def k12(spark, sf):
    before, _ = _bonds(spark, sf)
    return G.within_hops(before, before.select("g", F.lit(1).alias("node")).distinct(), "g", 2)


@query(
    "p17_radial_mask",
    """WITH n AS (SELECT DISTINCT l_orderkey AS g, l_linenumber AS u FROM lineitem), c AS (SELECT l_orderkey AS g, l_linenumber AS u FROM lineitem WHERE l_returnflag = 'R'),
    f AS (SELECT DISTINCT n.g, n.u FROM n JOIN c ON n.g = c.g AND abs(n.u - c.u) <= 1), one AS (SELECT g FROM f GROUP BY g HAVING max(u) - min(u) + 1 = count(*))
    SELECT g, u AS node FROM f JOIN one USING (g)""",
)
def p17(spark, sf):
    """Orders as chains of their lines, cut to what is next to a returned line; orders that fall apart are dropped."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("g"), F.col("l_linenumber").alias("u"), "l_returnflag")
    edges = lines.join(lines.select("g", (F.col("u") - 1).alias("u"), F.col("u").alias("v")), ["g", "u"]).select("g", "u", "v").distinct()
    return G.radial_mask(edges, lines.filter("l_returnflag = 'R'").select("g", F.col("u").alias("node")), "g", 1)


@query("m8_vector_lookup", "SELECT p_partkey, embedding[1]::DOUBLE AS first FROM part LEFT JOIN embeddings ON vec_id = p_partkey")
def m8(spark, sf):
    """Vectors by index; an index without a vector has none."""
    vectors = table(spark, sf, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("first"))
    return table(spark, sf, "part").select("p_partkey").join(vectors, F.col("p_partkey") == F.col("vec_id"), "left").select("p_partkey", "first")


@query("v10_schedules", """SELECT event_id AS step, round(1e-4 + (1e-2 - 1e-4) * (1 + cos(pi() * least(event_id, 5000) / 5000)) / 2, 9) AS cosine, round(1e-3 * least(1.0::DOUBLE, event_id / 1000), 9) AS warmup,
    round(power(64, -0.5) * least(power(greatest(event_id, 1), -0.5), greatest(event_id, 1) * power(2000, -1.5)), 9) AS inverse_root FROM events""")
def v10(spark, sf):
    """Rates at the steps that a stream of events counts."""
    k = F.col("event_id")
    r9 = lambda c: F.round(c, 9)
    rates = [r9(V.cosine_schedule(k, 5000, 1e-2, 1e-4)).alias("cosine"), r9(V.warmup_schedule(k, 1000, 1e-3)).alias("warmup"), r9(V.inverse_root_schedule(k, 2000, 64)).alias("inverse_root")]
    return table(spark, sf, "events").select(k.alias("step"), *rates)


@query("k14_multi_hot", "SELECT o_orderkey, [CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END, CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END, CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END, CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE 0 END] AS hot FROM orders")
def k14(spark, sf):
    hot = G.multi_hot({"status": (F.col("o_orderstatus"), ["F"]), "priority": (F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"])})
    return table(spark, sf, "orders").select("o_orderkey", hot.alias("hot"))


@query("k15_virtual_node", "WITH s AS (SELECT l_orderkey AS g, (l_linenumber % 2) AS p, l_linenumber FROM lineitem), z AS (SELECT g, p, count(*) AS n FROM s GROUP BY ALL), m AS (SELECT s.g, row_number() OVER (PARTITION BY s.g, s.p ORDER BY l_linenumber) - 1 + coalesce((SELECT sum(n) FROM z WHERE z.g = s.g AND z.p < s.p), 0) AS node FROM s) SELECT g, (max(node) + 1)::BIGINT AS u, 0::BIGINT AS v FROM m GROUP BY g")
def k15(spark, sf):
    from pyspark.sql import Window

    i = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("g"), (F.col("l_linenumber") % 2).alias("p"), "l_linenumber")
    nodes = i.select("g", "p", (F.row_number().over(Window.partitionBy("g", "p").orderBy("l_linenumber")) - 1).cast("long").alias("node"))
    edges = nodes.filter("node > 0").select("g", "p", (F.col("node") - 1).alias("u"), F.col("node").alias("v"))
    moved, _ = G.offset_graphs(nodes, edges, "g", "p")
    return G.virtual_node(moved, moved.groupBy("g").agg(F.min("node").alias("node")), "g")


@query("m10_split_embedding", "SELECT label, round(avg(embedding[1]), 6) AS a, round(avg(embedding[33]), 6) AS b FROM (SELECT DISTINCT ON (label) label, embedding FROM embeddings ORDER BY label, vec_id) GROUP BY label")
def m10(spark, sf):
    """A concatenated vector cut in its two halves, one row an entity."""
    first = Sp.first_rows(table(spark, sf, "embeddings"), ["label"], "vec_id")
    halves = first.select("label", F.slice("embedding", 1, 32).alias("l"), F.slice("embedding", 33, 32).alias("r"))
    return halves.select("label", r6(F.col("l")[0].cast("double")).alias("a"), r6(F.col("r")[0].cast("double")).alias("b"))


@query("m5_weighted_loss", "SELECT round(avg(-(3 * y * ln(p) + (1 - y) * ln(1 - p))), 6) AS loss FROM (SELECT quality AS y, ((n_chars % 997) + 1)::DOUBLE / 999 AS p FROM documents JOIN labels USING (doc_id))")
def m5(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(F.col("quality").alias("y"), ((F.col("n_chars") % 997 + 1) / 999.0).alias("p"))
    return rows.agg(r6(F.avg(-(3 * F.col("y") * F.log("p") + (1 - F.col("y")) * F.log(1 - F.col("p"))))).alias("loss"))
