"""Standard form of molecules on atom and bond tables: hydrogens, parent fragment, charges, hydrogen shifts.

Atoms are (graph, node, element, charge, hydrogens) with a total count of implicit hydrogens, bonds
are (graph, u, v, bond) in any direction. A null charge or count is 0; a bond given twice, or once in
each direction, is one bond, if its rows agree in their order. Work is joins on (graph, node); only charged atoms look at neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from .clusters import components
from .determinism import ranked
from .fingerprints import both_ways


def _filled(atoms: DataFrame, graph: str) -> DataFrame:
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return atoms.select(graph, "node", "element", zero("charge"), zero("hydrogens"))


def fold_hydrogens(atoms: DataFrame, bonds: DataFrame, graph: str) -> tuple[DataFrame, DataFrame]:
    """Hydrogen atoms become counts of the atoms that hold them.

    One stays an atom if it is charged, has hydrogens itself, has not exactly one bond or one of an
    order other than 1, or if its neighbour is a hydrogen too.
    """
    atoms, ends = _filled(atoms, graph), both_ways(bonds, graph)
    plain = atoms.filter("element = 'H' AND charge = 0 AND hydrogens = 0").select(graph, F.col("node").alias("u"))
    single = ends.join(plain, [graph, "u"]).groupBy(graph, "u").agg(F.count(F.lit(1)).alias("n"), F.max("bond").alias("b"), F.min("v").alias("v")).filter("n = 1 AND b = 1")
    heavy = atoms.filter("element <> 'H'").select(graph, F.col("node").alias("v"))
    folded = written(single.join(heavy, [graph, "v"], "left_semi").select(graph, "u", "v"), "folded-hydrogens")
    gained = folded.groupBy(graph, F.col("v").alias("node")).agg(F.count(F.lit(1)).cast("int").alias("more"))
    left = atoms.join(folded.select(graph, F.col("u").alias("node")), [graph, "node"], "left_anti").join(gained, [graph, "node"], "left")
    kept = left.select(graph, "node", "element", "charge", (F.col("hydrogens") + F.coalesce("more", F.lit(0))).alias("hydrogens"))
    gone = folded.select(graph, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return kept, ends.filter("u < v").join(gone, [graph, "u", "v"], "left_anti").select(graph, "u", "v", "bond")


def parent_fragment(atoms: DataFrame, bonds: DataFrame, graph: str) -> tuple[DataFrame, DataFrame]:
    """The largest connected piece of each graph, hydrogens counted; of equal ones that with the smallest node."""
    numbered = written(ranked(_filled(atoms, graph), "n", graph, "node"), "numbered-atoms")
    a, b = (numbered.select(graph, F.col("node").alias(end), F.col("n").alias(name)) for end, name in (("u", "a"), ("v", "b")))
    piece = components(bonds.select(graph, "u", "v").join(a, [graph, "u"]).join(b, [graph, "v"]).select("a", "b"))
    rooted = written(numbered.join(piece.select(F.col("node").alias("n"), "root"), "n", "left").withColumn("root", F.coalesce("root", "n")), "rooted-atoms")
    sizes = rooted.groupBy(graph, "root").agg(F.sum(1 + F.col("hydrogens")).alias("size"), F.min("node").alias("first"))
    best = sizes.groupBy(graph).agg(F.max_by("root", F.struct("size", -F.col("first"))).alias("root"))
    kept = rooted.join(best, [graph, "root"], "left_semi").select(graph, "node", "element", "charge", "hydrogens")
    inside = kept.select(graph, F.col("node").alias("u"))
    return kept, bonds.join(inside, [graph, "u"], "left_semi")


def neutralised(atoms: DataFrame, bonds: DataFrame, graph: str) -> DataFrame:
    """Atoms without the charges that a proton can take away.

    A charge of +1 on an atom with a hydrogen, and one of -1, goes unless a neighbour has a charge of
    the other sign; the hydrogens follow. All charges are judged on the input.
    """
    atoms = _filled(atoms, graph)
    movable = (F.col("charge") == -1) | ((F.col("charge") == 1) & (F.col("hydrogens") > 0))
    own = atoms.filter(movable).select(graph, F.col("node").alias("u"), F.col("charge").alias("own"))
    other = atoms.filter("charge <> 0").select(graph, F.col("node").alias("v"), F.col("charge").alias("other"))
    met = both_ways(bonds, graph).join(own, [graph, "u"]).join(other, [graph, "v"])
    bound = met.filter("own * other < 0").select(graph, F.col("u").alias("node"), F.lit(True).alias("bound")).distinct()
    goes = movable & F.col("bound").isNull()
    return atoms.join(bound, [graph, "node"], "left").select(
        graph,
        "node",
        "element",
        F.when(goes, 0).otherwise(F.col("charge")).alias("charge"),
        F.when(goes, F.col("hydrogens") - F.col("charge")).otherwise(F.col("hydrogens")).alias("hydrogens"),
    )


def standardised(atoms: DataFrame, bonds: DataFrame, graph: str, parent: bool = True, neutral: bool = True) -> tuple[DataFrame, DataFrame]:
    """Atoms and bonds with hydrogens folded, then the parent fragment, then without charges."""
    atoms, bonds = fold_hydrogens(atoms, bonds, graph)
    if parent:
        atoms, bonds = parent_fragment(atoms, bonds, graph)
    return (neutralised(atoms, bonds, graph) if neutral else atoms), bonds


def tautomers(atoms: DataFrame, bonds: DataFrame, graph: str, aromatic: int, element: str = "N", middle: str = "C") -> DataFrame:
    """(graph, tautomer, node, element, charge, hydrogens): each graph as 0, then one for each hydrogen shift.

    A shift takes the hydrogen of an ``element`` atom with one hydrogen and two neighbours, over a
    ``middle`` atom, to an ``element`` atom with none and two neighbours; both bonds are ``aromatic``.
    Tautomers are numbered in order of donor and acceptor; ways over different middles are one.
    """
    atoms, ends = written(_filled(atoms, graph), "tautomer-atoms"), written(both_ways(bonds, graph), "tautomer-ends")
    degree = ends.groupBy(graph, F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    hands = atoms.filter((F.col("element") == element) & F.col("hydrogens").isin(0, 1)).join(degree.filter("degree = 2"), [graph, "node"])
    step = ends.filter(F.col("bond") == aromatic).select(graph, F.col("u").alias("node"), F.col("v").alias("mid"))
    over = atoms.filter(F.col("element") == middle).select(graph, F.col("node").alias("mid"))
    reach = written(hands.select(graph, "node", "hydrogens").join(step, [graph, "node"]).join(over, [graph, "mid"], "left_semi"), "tautomer-reach")
    donor, acceptor = (reach.filter(F.col("hydrogens") == h).select(graph, "mid", F.col("node").alias(name)) for h, name in ((1, "donor"), (0, "acceptor")))
    shifts = donor.join(acceptor, [graph, "mid"]).select(graph, "donor", "acceptor").distinct()
    numbered = shifts.withColumn("tautomer", F.row_number().over(Window.partitionBy(graph).orderBy("donor", "acceptor")))
    gain = F.when(F.col("node") == F.col("donor"), -1).when(F.col("node") == F.col("acceptor"), 1).otherwise(0)
    moved = atoms.join(numbered, graph).select(graph, "tautomer", "node", "element", "charge", (F.col("hydrogens") + gain).alias("hydrogens"))
    return atoms.select(graph, F.lit(0).alias("tautomer"), "node", "element", "charge", "hydrogens").unionByName(moved)
