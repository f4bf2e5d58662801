"""Standard forms of molecules against plain versions on small random molecules."""

import random

from linkloom.operators import standardise

ATOMS, BONDS = "g long, node long, element string, charge int, hydrogens int", "g long, u long, v long, bond int"


def random_molecules(rng, n):
    out = {}
    for g in range(n):
        atoms = {k: (e := rng.choice("HHCNO"), 0 if e == "H" and rng.random() < 0.8 else rng.choice([0, 1, -1, -2, 2]), 0 if e == "H" else rng.randint(0, 3)) for k in range(rng.randint(1, 9))}
        bonds = {(u, v): rng.choice([1, 1, 2]) for u in atoms for v in atoms if u < v and rng.random() < 0.25}
        out[g] = atoms, bonds
    return out


def frames(spark, many, parts=3):
    atoms = [(g, k, *a) for g, (atoms, _) in many.items() for k, a in atoms.items()]
    bonds = [(g, *((u, v) if (u + v) % 2 else (v, u)), b) for g, (_, bonds) in many.items() for (u, v), b in bonds.items()]
    return spark.createDataFrame(atoms, ATOMS).repartition(parts), spark.createDataFrame(bonds + bonds[::3], BONDS).repartition(parts)


def near(bonds):
    out = {}
    for (u, v), b in bonds.items():
        out.setdefault(u, {})[v] = b
        out.setdefault(v, {})[u] = b
    return out


def plain_folded(atoms, bonds):
    by, gone = near(bonds), {}
    for k, (e, c, h) in atoms.items():
        if (e, c, h) == ("H", 0, 0) and list(by.get(k, {}).values()) == [1] and atoms[holder := next(iter(by[k]))][0] != "H":
            gone[k] = holder
    kept = {k: (e, c, h + list(gone.values()).count(k)) for k, (e, c, h) in atoms.items() if k not in gone}
    return kept, {e: b for e, b in bonds.items() if not set(e) & set(gone)}


def plain_parent(atoms, bonds):
    by, left, pieces = near(bonds), set(atoms), []
    while left:
        piece, todo = set(), [min(left)]
        while todo:
            if (k := todo.pop()) not in piece:
                piece.add(k)
                todo += by.get(k, {})
        left -= piece
        pieces.append(piece)
    best = min(pieces, key=lambda p: (-sum(1 + atoms[k][2] for k in p), min(p))) if pieces else set()
    return {k: a for k, a in atoms.items() if k in best}, {e: b for e, b in bonds.items() if set(e) <= best}


def plain_neutral(atoms, bonds):
    by = near(bonds)
    goes = {k for k, (_, c, h) in atoms.items() if (c == -1 or (c == 1 and h)) and not any(atoms[w][1] * c < 0 for w in by.get(k, {}))}
    return {k: (e, 0, h - c) if k in goes else (e, c, h) for k, (e, c, h) in atoms.items()}


def test_standard_form_equals_a_plain_one(spark):
    many = random_molecules(random.Random(4), 80)
    atoms, bonds = standardise.standardised(*frames(spark, many), "g")
    folded = {g: plain_parent(*plain_folded(*m)) for g, m in many.items()}
    assert sorted(map(tuple, atoms.collect())) == sorted((g, k, *a) for g, m in folded.items() for k, a in plain_neutral(*m).items())
    assert {(r.g, min(r.u, r.v), max(r.u, r.v), r.bond) for r in bonds.collect()} == {(g, *e, b) for g, (_, bonds) in folded.items() for e, b in bonds.items()}
    assert any(len(m[0]) < len(many[g][0]) for g, m in folded.items())


def test_standard_form_of_a_standard_form_is_the_same(spark):
    once = standardise.standardised(*frames(spark, random_molecules(random.Random(5), 20)), "g")
    charged = {(r.g, r.node) for r in once[0].filter("charge <> 0").collect()}
    twice = standardise.parent_fragment(*once, "g")
    assert sorted(map(tuple, twice[0].collect())) == sorted(map(tuple, once[0].collect())) and charged


def test_charges_side_by_side_stay_and_nulls_are_none(spark):
    atoms = spark.createDataFrame([(1, 0, "N", 1, 0), (1, 1, "O", -1, 0), (1, 2, "O", -1, 0), (1, 3, "C", None, None), (2, 0, "N", 1, 4)], ATOMS)
    bonds = spark.createDataFrame([(1, 0, 1, 1), (1, 0, 3, 1), (1, 3, 2, 1)], BONDS)
    got = sorted(map(tuple, standardise.neutralised(atoms, bonds, "g").collect()))
    assert got == [(1, 0, "N", 1, 0), (1, 1, "O", -1, 0), (1, 2, "O", 0, 1), (1, 3, "C", 0, 0), (2, 0, "N", 0, 3)]


def test_a_ring_with_two_nitrogens_has_one_shift(spark):
    elements = [("N", 1), ("C", 1), ("N", 0), ("C", 1), ("C", 1)]
    atoms = spark.createDataFrame([(1, k, e, 0, h) for k, (e, h) in enumerate(elements)] + [(2, 0, "N", 0, 1)], ATOMS)
    bonds = spark.createDataFrame([(1, k, (k + 1) % 5, 4) for k in range(5)], BONDS)
    got = [tuple(r) for r in standardise.tautomers(atoms, bonds, "g", aromatic=4).filter("tautomer > 0").orderBy("node").collect()]
    assert got == [(1, 1, k, e, 0, {0: 0, 2: 1}.get(k, h)) for k, (e, h) in enumerate(elements)]


def test_empty_tables(spark):
    atoms, bonds = standardise.standardised(spark.createDataFrame([], ATOMS), spark.createDataFrame([], BONDS), "g")
    assert atoms.count() == 0 and bonds.count() == 0 and standardise.tautomers(atoms, bonds, "g", 4).count() == 0
