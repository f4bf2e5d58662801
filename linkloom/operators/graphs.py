"""Graphs of reactions as edge and node tables: centres, balance, fragments, encodings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from .clusters import components
from .determinism import ranked


def reaction_centre(before: DataFrame, after: DataFrame, graph: str) -> DataFrame:
    """(graph, node) whose bonds differ between two edge tables (graph, u, v, bond); a missing bond is 0."""
    side = lambda df, name: df.select(graph, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.col("bond").alias(name))
    met = side(before, "x").join(side(after, "y"), [graph, "u", "v"], "full")
    changed = met.filter(F.coalesce("x", F.lit(0)) != F.coalesce("y", F.lit(0)))
    return changed.select(graph, F.explode(F.array("u", "v")).alias("node")).distinct()


def balance(before: DataFrame, after: DataFrame, graph: str) -> DataFrame:
    """(graph, balanced): same map numbers and elements on both sides, none twice. Tables (graph, num, element)."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(graph, "num").agg(F.count(F.lit(1)).alias(f"n_{name}"), F.min("element").alias(f"e_{name}"))

    met = side(before, "a").join(side(after, "b"), [graph, "num"], "full")
    ok = F.coalesce((F.col("n_a") == 1) & (F.col("n_b") == 1) & (F.col("e_a") == F.col("e_b")), F.lit(False))
    return met.groupBy(graph).agg(F.min(ok).alias("balanced"))


def within_hops(edges: DataFrame, centre: DataFrame, graph: str, hops: int) -> DataFrame:
    """(graph, node, hop): nodes at most ``hops`` edges from a centre node, breadth first."""
    both = edges.select(graph, "u", "v").unionByName(edges.select(graph, F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    reached = centre.select(graph, "node").distinct().withColumn("hop", F.lit(0))
    for h in range(1, hops + 1):
        border = reached.filter(F.col("hop") == h - 1).withColumnRenamed("node", "u")
        new = border.join(both, [graph, "u"]).select(graph, F.col("v").alias("node")).distinct()
        reached = reached.unionByName(new.join(reached, [graph, "node"], "left_anti").withColumn("hop", F.lit(h)))
    return reached


def radial_mask(edges: DataFrame, centre: DataFrame, graph: str, hops: int) -> DataFrame:
    """(graph, node) of what lies within ``hops`` of a graph's centre; graphs that fall into pieces are dropped."""
    kept = written(within_hops(edges, centre, graph, hops).select(graph, "node").distinct(), "fragment")
    numbered = ranked(kept, "n", graph, "node")
    a, b = numbered.select(graph, F.col("node").alias("u"), F.col("n").alias("a")), numbered.select(graph, F.col("node").alias("v"), F.col("n").alias("b"))
    piece = components(edges.select(graph, "u", "v").join(a, [graph, "u"]).join(b, [graph, "v"]).select("a", "b"))
    rooted = numbered.join(piece.select(F.col("node").alias("n"), "root"), "n", "left").select(graph, "node", F.coalesce("root", "n").alias("root"))
    whole = rooted.groupBy(graph).agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x = y")
    return kept.join(whole, graph, "left_semi")


def one_hot(value: Column, choices: list, unknown: bool = True) -> Column:
    """1 at the place of the value among ``choices``, and a last place for any other value."""
    hit = [F.when(value == F.lit(c), 1).otherwise(0) for c in choices]
    if unknown:
        hit.append(F.when(F.coalesce(value.isin(choices), F.lit(False)), 0).otherwise(1))
    return F.array(*hit)


def multi_hot(row: dict[str, tuple[Column, list]]) -> Column:
    """Encodings side by side, by feature name in sorted order."""
    return F.concat(*[one_hot(*row[k]) for k in sorted(row)])


def offset_graphs(nodes: DataFrame, edges: DataFrame, graph: str, part: str) -> tuple[DataFrame, DataFrame]:
    """Parts of a graph laid end to end: node numbers shift by the nodes of earlier parts."""
    sizes = nodes.groupBy(graph, part).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(graph).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(graph, part, F.coalesce(F.sum("n").over(w), F.lit(0)).alias("shift"))
    moved = nodes.join(shift, [graph, part]).select(graph, (F.col("node") + F.col("shift")).alias("node"), part)
    bonds = edges.join(shift, [graph, part]).select(graph, (F.col("u") + F.col("shift")).alias("u"), (F.col("v") + F.col("shift")).alias("v"))
    return moved, bonds


def virtual_node(nodes: DataFrame, centre: DataFrame, graph: str) -> DataFrame:
    """Edges (graph, u, v) from a new last node to each centre node."""
    top = nodes.groupBy(graph).agg((F.max("node") + 1).alias("u"))
    return centre.join(top, graph).select(graph, "u", F.col("node").alias("v"))
