"""Graph kernels against plain versions on small random graphs."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.operators import canonical, clusters, common_subgraph, fingerprints, graphs, pairwise, pooling, rings, templates


def random_graph(rng, n, labels=3, share=0.4, orders=2):
    atoms = {k: rng.randrange(labels) for k in range(n)}
    bonds = {(u, v): rng.randint(1, orders) for u, v in itertools.combinations(range(n), 2) if rng.random() < share}
    return atoms, bonds


def tables(spark, many, parts=3):
    atoms = spark.createDataFrame([(g, k, y) for g, (a, _) in many.items() for k, y in a.items()], "g long, node long, label int").repartition(parts)
    rows = [(g, *((u, v) if (u + v + g) % 2 else (v, u)), b) for g, (_, e) in many.items() for (u, v), b in e.items()]
    return atoms, spark.createDataFrame(rows, "g long, u long, v long, bond int").repartition(parts)


def neighbours(bonds):
    out = {}
    for (u, v), b in bonds.items():
        out.setdefault(u, {})[v] = b
        out.setdefault(v, {})[u] = b
    return out


def number48(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:12], 16)


def plain_environments(atoms, bonds, radius):
    near = neighbours(bonds)
    code = {k: number48(0, y) for k, y in atoms.items()}
    found = {(k, 0, c) for k, c in code.items()}
    sets = {k: frozenset() for k in atoms}
    reach = {k: {k} for k in atoms}
    alive, seen = {k for k in atoms if near.get(k)}, set()
    for r in range(1, radius + 1):
        code = {k: number48(r, code[k], sum(number48(b, code[w]) for w, b in near.get(k, {}).items()), len(near.get(k, {}))) for k in atoms}
        sets = {k: frozenset((min(x, w), max(x, w)) for x in reach[k] for w in near.get(x, {})) for k in atoms}
        reach = {k: reach[k] | {w for x in reach[k] for w in near.get(x, {})} for k in atoms}
        best = {}
        for k in alive:
            if sets[k] not in seen:
                best[sets[k]] = min(best.get(sets[k], (code[k], k)), (code[k], k))
        seen |= set(best)
        alive = {k for _, k in best.values()}
        found |= {(k, r, c) for c, k in best.values()}
    return found


@pytest.mark.parametrize("radius", [1, 3])
def test_environments_equal_plain_ones_for_any_partitions(spark, radius):
    rng = random.Random(radius)
    many = {g: random_graph(rng, rng.randint(1, 8), share=rng.choice([0.2, 0.5])) for g in range(30)}
    expected = {(g, *e) for g, one in many.items() for e in plain_environments(*one, radius)}
    for parts in (1, 5):
        got = fingerprints.environments(*tables(spark, many, parts), "g", radius)
        assert {(r.g, r.node, r.radius, r.code) for r in got.collect()} == expected and got.count() == len(expected)


def test_packed_bits_and_differences_of_sides(spark):
    rng = random.Random(1)
    codes = [(g, s, rng.randrange(1 << 48)) for g in range(8) for s in (0, 1) for _ in range(rng.randint(0, 40))]
    codes += [(g, 1 - s, c) for g, s, c in codes[::3]]
    df = spark.createDataFrame(codes, "g long, side int, code long")
    diff = {(r.g, r.code) for r in fingerprints.side_difference(df, "g", "side").collect()}
    by = {(g, s): {c for h, t, c in codes if (h, t) == (g, s)} for g in range(8) for s in (0, 1)}
    assert diff == {(g, c) for g in range(8) for c in by[g, 0] ^ by[g, 1]}
    words = {r.g: r.words for r in fingerprints.packed(fingerprints.folded(df, "g", 256), "g", 256).collect()}
    for g, w in words.items():
        bits = {64 * i + k for i, x in enumerate(w) for k in range(64) if (x % (1 << 64)) >> k & 1}
        assert len(w) == 4 and bits == {c % 256 for s in (0, 1) for c in by[g, s]}


@pytest.mark.parametrize("block_rows", [3, 512])
def test_aligned_similarity_of_reactions(spark, block_rows):
    rng = random.Random(4)
    rows = []
    for r in range(24):
        for slot in range(rng.randint(1, 3)):
            rows.append((r, "xy"[r % 2], slot, [rng.choice([0, -1, rng.getrandbits(63), -rng.getrandbits(60)]) for _ in range(3)], rng.randint(1, 9)))
    df = spark.createDataFrame(rows, "r long, gate string, slot int, words array<long>, size int")
    parts = {r: [x for x in rows if x[0] == r] for r in range(24)}
    expected = {}
    for i, j in itertools.combinations(range(24), 2):
        a, b = parts[i], parts[j]
        if a[0][1] == b[0][1] and len(a) == len(b):
            top = low = 0
            for x, y in zip(a, b):
                both = sum((p & q & ((1 << 64) - 1)).bit_count() for p, q in zip(x[3], y[3]))
                either = sum(((p | q) & ((1 << 64) - 1)).bit_count() for p, q in zip(x[3], y[3]))
                top += (both / either if either else 0) * max(x[4], y[4])
                low += max(x[4], y[4])
            expected[i, j] = top / low
    got = {(r.i, r.j): r.sim for r in fingerprints.aligned_tanimoto(df, "r", "gate", "slot", "words", "size", block_rows=block_rows).collect()}
    assert got.keys() == expected.keys() and all(abs(got[k] - v) < 1e-12 and 0 <= v <= 1 for k, v in expected.items())
    near = {(r.i, r.j) for r in fingerprints.aligned_tanimoto(df, "r", "gate", "slot", "words", "size", 0.5, block_rows).collect()}
    assert near == {k for k, v in expected.items() if v >= 0.5}


def test_a_reaction_is_sent_once_to_a_cell(spark):
    def sent():
        double, store = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), spark.sparkContext._jsc.sc().statusStore()
        stages = store.stageList(None, False, False, double, None)
        return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteRecords() for k in range(stages.size())}

    df = spark.createDataFrame([(r, "x", 0, [r, -r], 1) for r in range(1000)], "r long, gate string, slot int, words array<long>, size int")
    before = sent()
    assert fingerprints.aligned_tanimoto(df, "r", "gate", "slot", "words", "size").count() == 499_500
    # once for the slots of a reaction, once for its cell, and a few for counts
    assert sum(n for k, n in sent().items() if k not in before) < 2_500


def exhaustive_common(one, two, centre=None, other=None):
    """(bonds, atoms) of the largest connected common subgraph, by growing every one there is."""
    (la, ba), (lb, bb) = one, two
    na, nb = neighbours(ba), neighbours(bb)
    inside = lambda c, k: c is not None and k in c
    same = lambda a, b: la[a] == lb[b] and inside(centre, a) == inside(other, b)
    if centre is None:
        starts = [frozenset([(a, b)]) for a in la for b in lb if same(a, b)]
    else:
        order = sorted(centre)
        starts = [frozenset(zip(order, p)) for p in itertools.permutations(other, len(order)) if len(order) == len(other) and all(map(same, order, p))] if order else []
    best, seen, todo = (0, 0), set(), [(s, frozenset()) for s in starts]
    while todo:
        state = todo.pop()
        if state in seen:
            continue
        seen.add(state)
        pairs, taken = state
        best = max(best, (len(taken), len(pairs)))
        there, back = dict(pairs), {b: a for a, b in pairs}
        for a, b in pairs:
            for x, o in na.get(a, {}).items():
                for y, q in nb.get(b, {}).items():
                    if o == q and same(x, y) and there.get(x, y) == y and back.get(y, x) == x:
                        todo.append((pairs | {(x, y)}, taken | {frozenset((a, x))}))
    return best


def test_common_subgraphs_equal_an_exhaustive_search(spark):
    rng = random.Random(9)
    many = {g: random_graph(rng, rng.randint(1, 5), labels=2, share=0.6) for g in range(14)}
    atoms, bonds = tables(spark, many)
    pairs = spark.createDataFrame(list(itertools.combinations(range(14), 2)), "i long, j long")
    got = {(r.i, r.j): (r.bonds, r.atoms, r.whole) for r in common_subgraph.common_subgraphs(pairs, atoms, bonds, "g").collect()}
    assert got == {(i, j): (*exhaustive_common(many[i], many[j]), True) for i, j in itertools.combinations(range(14), 2)}
    scored = common_subgraph.subgraph_similarity(common_subgraph.common_subgraphs(pairs, atoms, bonds, "g"), atoms, "g").collect()
    assert all(abs(r.sim - r.atoms / max(len(many[r.i][0]), len(many[r.j][0]))) < 1e-12 for r in scored)


def test_common_subgraphs_around_centres(spark):
    rng = random.Random(11)
    many = {g: random_graph(rng, rng.randint(1, 5), labels=2, share=0.6) for g in range(12)}
    centres = {g: {k for k in a if rng.random() < 0.4} for g, (a, _) in many.items()}
    centre = spark.createDataFrame([(g, k) for g, c in centres.items() for k in c], "g long, node long")
    pairs = spark.createDataFrame(list(itertools.combinations(range(12), 2)), "i long, j long")
    got = {(r.i, r.j): (r.bonds, r.atoms, r.whole) for r in common_subgraph.common_subgraphs(pairs, *tables(spark, many), "g", centre=centre).collect()}
    assert got == {(i, j): (*exhaustive_common(many[i], many[j], centres[i], centres[j]), True) for i, j in itertools.combinations(range(12), 2)}
    assert any(v[1] > len(centres[i]) > 0 for (i, _), v in got.items())


def test_a_search_that_is_cut_off_says_so(spark):
    ring = ({k: 0 for k in range(9)}, {(k, (k + 1) % 9) if k < 8 else (0, 8): 1 for k in range(9)})
    dense = ({k: 0 for k in range(9)}, {p: 1 for p in itertools.combinations(range(9), 2)})
    pairs = spark.createDataFrame([(0, 1)], "i long, j long")
    args = (pairs, *tables(spark, {0: dense, 1: dense}), "g")
    found = common_subgraph.common_subgraphs(*args, budget=50).first()
    assert not found.whole and 0 < found.bonds <= 36
    assert common_subgraph.common_subgraphs(pairs, *tables(spark, {0: ring, 1: ring}), "g").first().whole


def packed_rows(many):
    import pyarrow as pa

    atoms = pa.array([[{"node": k, "label": str(y), "inside": False} for k, y in a.items()] for a, _ in many], pa.list_(pa.struct({"node": pa.int64(), "label": pa.string(), "inside": pa.bool_()})))
    bonds = pa.array([[{"u": u, "v": v, "kind": str(b)} for (u, v), b in e.items()] for _, e in many], pa.list_(pa.struct({"u": pa.int64(), "v": pa.int64(), "kind": pa.string()})))
    return common_subgraph.Graphs(atoms, bonds)


def test_as_many_bonds_with_more_atoms_are_better():
    """Both the search and the table; the search used to stop at as many bonds as it had."""
    rng = random.Random(1)
    many = [random_graph(rng, rng.randint(3, 7), labels=3, share=0.5) for _ in range(60)]
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(400)]
    expected = [exhaustive_common(many[i], many[j]) for i, j in pairs]
    packed = packed_rows(many)
    bonds, atoms, whole = common_subgraph.matched(packed, *np.array(pairs).T, False, 20_000)
    assert list(zip(bonds.tolist(), atoms.tolist())) == expected and whole.all()
    assert [common_subgraph.searched(*packed.plain(i), *packed.plain(j), False, 20_000)[:2] for i, j in pairs] == expected


def test_null_labels_match_nothing_and_graphs_may_be_missing(spark):
    atoms = spark.createDataFrame([(0, 0, None), (0, 1, None), (1, 0, None), (1, 1, None), (2, 0, "a"), (3, 5, "a")], "g long, node long, label string")
    bonds = spark.createDataFrame([(0, 0, 1, 1), (1, 0, 1, 1), (2, 0, 9, 1), (3, 5, 5, 1)], "g long, u long, v long, bond int")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (2, 3), (2, 8), (8, 9)], "i long, j long")
    got = {(r.i, r.j): (r.bonds, r.atoms, r.whole) for r in common_subgraph.common_subgraphs(pairs, atoms, bonds, "g").collect()}
    assert got == {(0, 1): (0, 0, True), (0, 2): (0, 0, True), (2, 3): (0, 1, True), (2, 8): (0, 0, True), (8, 9): (0, 0, True)}
    packed = common_subgraph.packed_graphs(atoms, bonds, "g")
    none = spark.createDataFrame([], "bucket string, r long, slot int, g long")
    assert common_subgraph.bucket_subgraphs(none, "bucket", "r", "slot", packed, "g").count() == 0


@pytest.mark.parametrize("block_rows", [2, 1024])
def test_common_subgraphs_of_buckets_send_no_pairs(spark, monkeypatch, block_rows):
    monkeypatch.setattr(common_subgraph, "PAIRS", 7)
    rng = random.Random(5)
    many = {g: random_graph(rng, rng.randint(1, 9), labels=2) for g in range(40)}
    packed = common_subgraph.packed_graphs(*tables(spark, many), "g").cache()
    parts = [("x" if r < 12 else "y", r, slot, 2 * r + slot) for r in range(20) for slot in range(2)]
    args = (spark.createDataFrame(parts, "bucket string, r long, slot int, g long"), "bucket", "r", "slot", packed, "g")
    found = common_subgraph.bucket_subgraphs(*args, block_rows=block_rows)
    expected = {}
    for i, j in itertools.combinations(range(20), 2):
        if (i < 12) == (j < 12):
            each = [(*exhaustive_common(many[2 * i + s], many[2 * j + s]), max(len(many[2 * i + s][0]), len(many[2 * j + s][0]))) for s in range(2)]
            expected[i, j] = tuple(map(sum, zip(*each)))
    assert {(r.i, r.j): (r.bonds, r.atoms, r.weight) for r in found.collect() if r.whole} == expected
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Exchange")


RULES = [
    templates.Rule("cut", (0, 1), ((0, 1, 1),), ()),
    templates.Rule("turn", (None, 1, None), ((0, 1, 1), (1, 2, 2)), ((0, 1, 2), (1, 2, 1))),
    templates.Rule("ring", (None, None, None), ((0, 1, 1), (1, 2, 1), (0, 2, 1)), ((0, 1, 1),)),
    templates.Rule("meet", (0, 1, 2), ((0, 1, 1),), ((0, 1, 1), (1, 2, 1))),
]


def plain_pieces(nodes, bonds):
    root = {k: k for k in nodes}
    for _ in nodes:
        for u, v in bonds:
            root[u] = root[v] = min(root[u], root[v])
    return root


def plain_matches(atoms, bonds, rule):
    of = plain_pieces(atoms, bonds)
    bond = lambda u, v: bonds.get((min(u, v), max(u, v)))
    fragment = plain_pieces(range(len(rule.labels)), [(u, v) for u, v, _ in rule.left])
    for nodes in itertools.permutations(atoms, len(rule.labels)):
        if all(y is None or atoms[n] == y for y, n in zip(rule.labels, nodes)) and all(bond(nodes[u], nodes[v]) == b for u, v, b in rule.left):
            heads = {f: of[nodes[f]] for f in set(fragment.values())}
            if len(set(heads.values())) == len(heads):
                yield nodes


def test_matches_and_products_equal_plain_ones(spark):
    rng = random.Random(21)
    many = {g: random_graph(rng, rng.randint(2, 6), share=rng.choice([0.15, 0.35, 0.7])) for g in range(50)}
    atoms, bonds = tables(spark, many)
    of = spark.createDataFrame([(g, k, r) for g, (a, b) in many.items() for k, r in plain_pieces(a, b).items()], "g long, node long, molecule long")
    atoms = atoms.join(of, ["g", "node"])
    found = templates.matches(atoms, bonds, RULES, "g")
    expected = {(g, r.name, m) for g, one in many.items() for r in RULES for m in plain_matches(*one, r)}
    assert {(r.g, r.rule, tuple(r.nodes)) for r in found.collect()} == expected and found.count() == len(expected)
    assert {e[1] for e in expected} == {r.name for r in RULES}
    products, after = templates.applied(bonds, found, RULES, "g")
    got = {r.product: (r.g, r.rule, tuple(r.nodes)) for r in products.collect()}
    made = {p: {} for p in got}
    for r in after.collect():
        made[r.product][r.u, r.v] = r.bond
    assert set(got.values()) == expected
    for p, (g, name, nodes) in got.items():
        rule = next(r for r in RULES if r.name == name)
        bond = {k: b for k, b in many[g][1].items()}
        for u, v, _ in rule.left:
            del bond[min(nodes[u], nodes[v]), max(nodes[u], nodes[v])]
        for u, v, b in rule.right:
            bond[min(nodes[u], nodes[v]), max(nodes[u], nodes[v])] = b
        assert made[p] == bond
    pieces = {(r.product, r.node): r.molecule for r in templates.pieces(products, after, atoms, "g").collect()}
    assert pieces == {(p, k): r for p, (g, *_) in got.items() for k, r in plain_pieces(many[g][0], made[p]).items()}
    side = lambda df: df.select("product", F.col("node").alias("num"), F.col("label").alias("element"))
    body = products.select("product", "g").join(atoms, "g")
    kept = spark.createDataFrame(list(pieces), "product long, node long").join(body.select("product", "node", "label"), ["product", "node"])
    assert graphs.balance(side(body), side(kept), "product").filter("NOT balanced").count() == 0
    graph_rows = canonical.packed(atoms, bonds, "g")
    assert {(r.g, r.node): r.molecule for r in templates.molecules(graph_rows, "g").collect()} == {(r.g, r.node): r.molecule for r in of.collect()}
    after_of = lambda limit=None: {(r.g, r.rule, tuple(r.nodes)): {(b.u, b.v): b.bond for b in r.bonds} for r in templates.packed_products(graph_rows, found, RULES, "g", limit).collect()}
    assert after_of() == {got[p]: made[p] for p in got}
    limited, _ = templates.applied(bonds, found, RULES, "g", 3)
    full = {p for p, (g, _, nodes) in got.items() if any(sum(b for k, b in made[p].items() if n in k) > 3 for n in nodes)}
    assert {(r.g, r.rule, tuple(r.nodes)) for r in limited.collect()} == {v for p, v in got.items() if p not in full}
    assert set(after_of(3)) == {v for p, v in got.items() if p not in full}


def shuffled(rng, graph):
    atoms, bonds = graph
    to = list(atoms)
    rng.shuffle(to)
    to = dict(zip(atoms, to))
    return {to[k]: y for k, y in atoms.items()}, {(min(to[u], to[v]), max(to[u], to[v])): b for (u, v), b in bonds.items()}


def plain_form(graph):
    atoms, bonds = graph
    n = len(atoms)
    forms = []
    for p in itertools.permutations(range(n)):
        at = dict(zip(atoms, p))
        forms.append((tuple(y for _, y in sorted((at[k], y) for k, y in atoms.items())), tuple(sorted((*sorted((at[u], at[v])), b) for (u, v), b in bonds.items()))))
    return min(forms)


def test_isomorphic_graphs_and_only_those_share_an_id(spark):
    rng = random.Random(6)
    cycle = lambda n, start=0: {(start + min(k, (k + 1) % n), start + max(k, (k + 1) % n)): 1 for k in range(n)}
    plain = lambda n, bonds: ({k: 0 for k in range(n)}, bonds)
    base = [random_graph(rng, rng.randint(1, 5), labels=2, share=0.5) for _ in range(25)]
    base += [plain(6, cycle(6)), plain(6, {**cycle(3), **cycle(3, 3)}), plain(6, {(a, b): 1 for a in range(3) for b in range(3, 6)})]
    base += [plain(6, {**cycle(3), **cycle(3, 3), **{(k, k + 3): 1 for k in range(3)}}), plain(6, {(0, k): 1 for k in range(1, 6)}), plain(5, {p: 1 for p in itertools.combinations(range(5), 2)})]
    base += [plain(6, {(0, 1): 1, (0, 2): 1, (0, 3): 1, (3, 4): 1, (3, 5): 1}), plain(6, {(k, k + 1): 1 for k in range(5)}), plain(4, {})]
    many = {2 * g + s: shuffled(rng, b) if s else b for g, b in enumerate(base) for s in (0, 1)}
    ids, order = canonical.canonical(*tables(spark, many), "g")
    got = {r.g: r.canonical_id for r in ids.collect()}
    forms = {g: plain_form(b) for g, b in many.items()}
    for a, b in itertools.combinations(many, 2):
        assert (got[a] == got[b]) == (forms[a] == forms[b]), (a, b)
    places = {}
    for r in order.collect():
        places.setdefault(r.g, {})[r.node] = r.place
    for g in many:
        a, b = places[g - g % 2], places[g - g % 2 + 1]
        written = lambda g, at: (sorted((at[k], y) for k, y in many[g][0].items()), sorted((*sorted((at[u], at[v])), o) for (u, v), o in many[g][1].items()))
        assert sorted(a.values()) == list(range(len(a))) and written(g - g % 2, a) == written(g - g % 2 + 1, b)


def test_graphs_of_eight_atoms_and_more_share_ids_with_their_copies_only(spark):
    rng = random.Random(9)
    ring = lambda *sizes: {(s + min(k, (k + 1) % n), s + max(k, (k + 1) % n)): 1 for s, n in zip(itertools.accumulate((0, *sizes)), sizes) for k in range(n)}
    cube = {(a, a | b): 1 for a in range(8) for b in (1, 2, 4) if not a & b}
    pairs = {(k, k + 1): 1 for k in range(0, 8, 2)}
    base = [({k: 0 for k in range(n)}, e) for n, e in ((8, ring(8)), (8, ring(4, 4)), (8, ring(3, 5)), (8, cube), (8, pairs), (9, ring(9)), (9, ring(3, 3, 3)), (9, ring(4, 5)))]
    many = {3 * g + s: shuffled(rng, b) for g, b in enumerate(base) for s in range(3)}
    ids, order = canonical.canonical(*tables(spark, many), "g")
    got = {r.g: r.canonical_id for r in ids.collect()}
    assert len(got) == len(many) and len(set(got.values())) == len(base)
    assert all(got[3 * g] == got[3 * g + 1] == got[3 * g + 2] for g in range(len(base)))
    places = {}
    for r in order.collect():
        places.setdefault(r.g, []).append((r.place, r.node))
    assert all(sorted(p for p, _ in places[g]) == list(range(len(a))) and {k for _, k in places[g]} == set(a) for g, (a, _) in many.items())


def test_small_graphs_are_put_in_order_without_rounds_of_jobs(spark):
    rng = random.Random(10)
    atoms, bonds = tables(spark, {g: random_graph(rng, rng.randint(1, 7), labels=2) for g in range(40)})
    spark.sparkContext.setJobGroup("canonical", "")
    canonical.canonical(atoms, bonds, "g")[0].collect()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("canonical")) < 15


def test_rings_and_atom_features(spark):
    rng = random.Random(17)
    many = {g: random_graph(rng, rng.randint(1, 9), share=0.25) for g in range(25)}
    atoms, bonds = tables(spark, many)

    def walk(near, starts, without=()):
        far, border = dict.fromkeys(starts, 0), list(starts)
        while border:
            border = [(w, far[k] + 1) for k in border for w in near.get(k, {}) if w not in far and {k, w} != set(without)]
            for w, d in border:
                far.setdefault(w, d)
            border = list(dict(border))
        return far

    expected, features = {}, {}
    centres = {g: [k for k in a if k % 4 == 1] for g, (a, _) in many.items()}
    for g, (a, b) in many.items():
        near = neighbours(b)
        ring = {(u, v): d + 1 for u, v in b if (d := walk(near, [u], (u, v)).get(v)) is not None}
        expected.update({(g, u, v): d for (u, v), d in ring.items()})
        far = walk(near, centres[g])
        for k, y in a.items():
            mine = [d for e, d in ring.items() if k in e]
            hetero = sum(a[w] != 0 for w in near.get(k, {}))
            features[g, k] = (len(near.get(k, {})), sum(near.get(k, {}).values()), bool(mine), min(mine, default=0), hetero if y == 0 else -1, hetero + sum(o - 1 for o in near.get(k, {}).values()) if y == 0 else -1, far.get(k, 10_000))
    assert {(r.g, r.u, r.v): r.ring for r in rings.bond_rings(bonds, "g").collect()} == expected and expected
    short = {k: d for k, d in expected.items() if d <= 4}
    assert {(r.g, r.u, r.v): r.ring for r in rings.bond_rings(bonds, "g", 4).collect()} == short
    centre = spark.createDataFrame([(g, k) for g, c in centres.items() for k in c], "g long, node long")
    got = rings.atom_features(atoms, bonds, centre, "g", F.col("label") == 0)
    assert {(r.g, r.node): tuple(r)[2:] for r in got.collect()} == features


def test_pooling_of_node_vectors(spark):
    rng = random.Random(2)
    rows = [(g, k, [rng.uniform(-2, 2) for _ in range(3)], rng.choice([-900.0, 0.0, 1.5, 800.0])) for g in range(6) for k in range(rng.randint(1, 7))]
    df = spark.createDataFrame(rows, "g long, k int, v array<double>, s double").repartition(3)
    got = {r.g: r.pooled for r in pooling.attention_pooled(df, "g", "v", F.col("s")).collect()}
    last = {r.g: r.pooled for r in pooling.last_node(df, "g", "k", "v").collect()}
    for g in range(6):
        mine = [r for r in rows if r[0] == g]
        e = np.exp(np.array([r[3] for r in mine]) - max(r[3] for r in mine))
        assert np.allclose(got[g], (e / e.sum()) @ np.array([r[2] for r in mine])) and last[g] == max(mine)[2]


@pytest.mark.parametrize("block_rows", [16, 1024])
def test_first_fit_by_rounds(spark, block_rows):
    rng = random.Random(8)
    rows = [(k, [rng.randrange(8) / 4, rng.randrange(8) / 4]) for k in rng.sample(range(1000), 120)]
    rows += [(2000 + k, [k * 0.3, 9.0]) for k in range(14)] + [(3000, rows[0][1]), (3001, rows[1][1])]
    anchors, expected = [], {}
    for k, v in sorted(rows):
        hit = next((a for a, w in anchors if max(abs(x - y) for x, y in zip(v, w)) <= 0.5), None)
        if hit is None:
            anchors.append((k, v))
        expected[k] = k if hit is None else hit
    df = spark.createDataFrame(rows, "k long, v array<double>").repartition(4)
    assert {r.k: r.anchor for r in clusters.first_fit(df, "k", "v", 0.5, block_rows).collect()} == expected
    assert clusters.first_fit(df.limit(0), "k", "v", 0.5).count() == 0


def test_a_bucket_of_all_rows_spreads_over_cells(spark):
    n = 300
    df = spark.range(n).select(F.col("id").alias("k"), F.lit("x").alias("f"), F.when(F.col("id") % 2 == 0, "x").otherwise("x").alias("g"))
    pairs = pairwise.rule_gated_pairs(df, "k", "f", "g", block_rows=20)
    assert {(r.i, r.j) for r in pairs.collect()} == set(itertools.combinations(range(n), 2)) and pairs.count() == n * (n - 1) // 2
    rows, columns = pairwise.bucket_cells(df, "f", "k", 20)
    sizes = [r["count"] for r in rows.groupBy("cell_row", "cell_column").count().collect()]
    assert len(sizes) == 15 * 16 // 2 and max(sizes) < 5 * 20 and columns.filter("cell_row > cell_column").isEmpty()
    siblings = pairwise.sibling_pairs(df.unionByName(df), "f", "k", block_rows=20)
    assert siblings.count() == n * (n - 1) // 2
    sides = spark.createDataFrame([(1, "a", "b"), (2, "b", "a"), (3, "a", "b"), (4, "a", "a"), (5, "a", "a")], "k long, f string, g string")
    assert {tuple(r) for r in pairwise.rule_gated_pairs(sides, "k", "f", "g", 2).collect()} == {(1, 2, True), (1, 3, False), (2, 3, True), (4, 5, False)}


def test_message_passing_equals_matrix_products(spark):
    rng = random.Random(12)
    many = {g: random_graph(rng, rng.randint(1, 7), share=0.5) for g in range(8)}
    atoms, bonds = tables(spark, many)
    weights = [[[[rng.uniform(-1, 1) for _ in range(a)] for _ in range(b)] for _ in range(2)] + [[rng.uniform(-1, 1) for _ in range(b)]] for a, b in ((3, 4), (4, 2))]
    nodes = atoms.withColumn("h", F.array(*[(F.col("label") == i).cast("double") for i in range(3)]))
    got = {(r.g, r.node, r.layer): r.state for r in pooling.message_passing(nodes, fingerprints.both_ways(bonds, "g"), "g", "h", [tuple(w) for w in weights]).collect()}
    for g, (a, b) in many.items():
        adjacent = np.zeros((len(a), len(a)))
        for u, v in b:
            adjacent[u, v] = adjacent[v, u] = 1
        h = np.eye(3)[list(a.values())]
        for k in range(3):
            assert all(np.allclose(got[g, n, k], h[n]) for n in a)
            if k < 2:
                own, others, bias = map(np.array, weights[k])
                h = np.maximum(0, h @ own.T + adjacent @ h @ others.T + bias)
