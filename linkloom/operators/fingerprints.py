"""Fingerprints of graphs from atom and bond tables: environments, differences of sides, bit similarity.

Graphs are two tables: atoms (graph, node, label) and bonds (graph, u, v, bond), each bond once or
from both ends. Codes are 48-bit numbers from md5, so that SQL can state them; neighbours enter a
code as a sum, which tasks add up before the exchange, and no node's neighbours are gathered.
Graphs are meant to have bounded degrees, as molecules have: an environment's bonds are rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship_package
from ..storage import in_buckets, written
from .pairwise import bucket_grid

#: Pairs, or values of an array, that are worked on at once.
VALUES = 1 << 15


def number48(*parts: Column | str | int) -> Column:
    """A number below 2**48 from the md5 of the parts, joined by colons."""
    as_column = lambda p: p if isinstance(p, Column) else F.lit(p) if isinstance(p, int) else F.col(p)
    text = F.concat_ws(":", *[as_column(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")


def both_ways(bonds: DataFrame, graph: str | list[str]) -> DataFrame:
    """(graph, u, v, bond) from each end, once; loops are left out. Rows stay in the task they are in."""
    key = [graph] if isinstance(graph, str) else graph
    turned = F.struct(F.col("v").alias("u"), F.col("u").alias("v"))
    return bonds.select(*key, F.inline(F.array(F.struct("u", "v"), turned)), "bond").filter("u <> v").distinct()


def refined(codes: DataFrame, ends: DataFrame, graph: list[str], step: int) -> DataFrame:
    """(graph, node, code): each node's code with the codes of its neighbours and the bonds to them.

    ``codes`` may have more key columns than ``ends``; they are in ``graph``.
    """
    own = [c for c in graph if c in ends.columns]
    theirs = codes.select(*graph, F.col("node").alias("v"), F.col("code").alias("c"))
    met = ends.join(theirs, [*own, "v"]).groupBy(*graph, F.col("u").alias("node")).agg(F.sum(number48("bond", "c")).alias("s"), F.count(F.lit(1)).alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return codes.join(met, [*graph, "node"], "left").select(*graph, "node", number48(step, "code", zero(F.col("s")), zero(F.col("n"))).alias("code"))


def environments(atoms: DataFrame, bonds: DataFrame, graph: str | list[str], radius: int = 2) -> DataFrame:
    """(graph, node, radius, code) of circular environments.

    Radius 0 are the labels. Of environments of a graph with the same set of bonds only the one with
    the smallest radius, then code, then node stays, and a node whose environment went has no wider
    ones. A node without bonds has radius 0 only.

    All tables are in buckets of (the first column of) ``graph``: with atoms and bonds that are too
    (`in_buckets`) no row crosses the network. Only nodes whose environment is left are followed on.
    """
    key = [graph] if isinstance(graph, str) else graph
    low, high = F.least("u", "v"), F.greatest("u", "v")
    ends = in_buckets(both_ways(bonds, key).withColumns({"a": low, "b": high, "h": number48(low, high)}), "ends", key[0])
    codes = in_buckets(atoms.select(*key, "node", number48(0, "label").alias("code")), "codes", key[0])
    found = [codes.select(*key, "node", F.lit(0).alias("radius"), "code")]
    border = ends.withColumnRenamed("u", "node")
    seen = None
    for r in range(1, radius + 1):
        codes = in_buckets(refined(codes, ends, key, r), "codes", key[0])
        around = border.select(*key, "node", "a", "b", "h").distinct()
        if r < radius:
            around = in_buckets(around, "around", key[0])
        sets = around.groupBy(*key, "node").agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("s"))
        if seen is not None:
            sets = sets.join(seen, [*key, "n", "s"], "left_anti")
        first = sets.join(codes, [*key, "node"]).groupBy(*key, "n", "s").agg(F.min(F.struct("code", "node")).alias("m"))
        kept = in_buckets(first.select(*key, "n", "s", F.col("m.node").alias("node"), F.col("m.code").alias("code")), "environments", key[0])
        found.append(kept.select(*key, "node", F.lit(r).alias("radius"), "code"))
        now = kept.select(*key, "n", "s")
        seen = now if seen is None else seen.unionByName(now)
        if r < radius:
            alive = around.join(kept.select(*key, "node"), [*key, "node"], "left_semi")
            reach = alive.select(*key, "node", F.explode(F.array("a", "b")).alias("at")).distinct()
            border = reach.join(ends.withColumnRenamed("u", "at"), [*key, "at"])
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def side_difference(environments: DataFrame, reaction: str, side: str) -> DataFrame:
    """(reaction, code) of the codes that only one of the two sides has."""
    ends = environments.groupBy(reaction, "code").agg(F.min(side).alias("lo"), F.max(side).alias("hi"))
    return ends.filter(F.col("lo") == F.col("hi")).select(reaction, "code")


def folded(codes: DataFrame, graph: str, n_bits: int) -> DataFrame:
    """(graph, bit): distinct places of the codes."""
    return codes.select(graph, (F.col("code") % n_bits).cast("int").alias("bit")).distinct()


def packed(bits: DataFrame, graph: str, n_bits: int) -> DataFrame:
    """(graph, words): the bits as ``n_bits`` / 64 longs; at most that many values meet in a row."""
    n_words = -(-n_bits // 64)
    words = bits.groupBy(graph, F.expr("bit div 64").cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, bit % 64)")).alias("x"))
    rows = words.groupBy(graph).agg(F.map_from_entries(F.collect_list(F.struct("w", "x"))).alias("m"))
    every = F.transform(F.sequence(F.lit(0), F.lit(n_words - 1)), lambda w: F.coalesce(F.try_element_at("m", w), F.lit(0).cast("long")))
    return rows.select(graph, every.alias("words"))


def aligned_tanimoto(parts: DataFrame, reaction: str, gate: str, slot: str, words: str, size: str, at_least: float | None = None, block_rows: int = 4096) -> DataFrame:
    """(i, j, sim), i < j: similarity of reactions of one gate whose components are aligned by slot.

    Each slot's Tanimoto similarity of packed bits (0 without any bit) is weighted by the larger of
    the two sizes. Only reactions with as many slots meet; gates are laid on a grid of blocks, so a
    common gate spreads. A reaction is sent once to each cell of its block, which gives its pairs a
    few rows at a time.
    """
    ship_package(parts.sparkSession)
    rows = parts.groupBy(reaction, gate).agg(F.sort_array(F.collect_list(F.struct(slot, words, size))).alias("p"))
    one = rows.select(
        F.col(reaction).cast("long").alias("id"),
        F.concat_ws("|", F.col(gate).cast("string"), F.size("p").cast("string")).alias("bucket"),
        F.transform("p", lambda x: x[words]).alias("words"),
        F.transform("p", lambda x: x[size].cast("double")).alias("sizes"),
    )
    placed = bucket_grid(written(one, "reactions"), "bucket", "id", block_rows)

    def numbers(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids in order, words (word, reaction, slot), counts of bits and sizes."""
        t = t.sort_by("id")
        flat = t.column("words").combine_chunks().flatten()
        w = flat.flatten().to_numpy().view(np.uint64).reshape(t.num_rows, -1, len(flat[0]))
        sizes = t.column("sizes").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        return t.column("id").to_numpy(), np.ascontiguousarray(w.transpose(2, 0, 1)), np.bitwise_count(w).sum(axis=2, dtype=np.int32), sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        row, inside = t.column("cell_row")[0], t.column("cell_row")[0] == t.column("cell_column")[0]
        mine = pc.equal(t.column("block"), row)
        a = t.filter(mine)
        b = a if inside else t.filter(pc.invert(mine))
        if not a.num_rows or not b.num_rows:
            return
        (ids, w, own, n), (others, x, theirs, m) = numbers(a), numbers(b)
        out: list[tuple[np.ndarray, ...]] = []
        tile = max(1, VALUES // n.shape[1])
        for k, one_id in enumerate(ids):
            for start in range(k + 1 if inside else 0, len(others), tile):
                at = slice(start, start + tile)
                both = np.zeros(m[at].shape, np.int32)
                for mine_word, their_words in zip(w[:, k], x[:, at]):
                    if mine_word.any():
                        both += np.bitwise_count(mine_word & their_words)
                either = own[k] + theirs[at] - both
                weight = np.maximum(n[k], m[at])
                sim = (np.divide(both, either, out=np.zeros(both.shape), where=either > 0) * weight).sum(axis=1) / weight.sum(axis=1)
                keep = slice(None) if at_least is None else sim >= at_least
                out.append((np.minimum(one_id, others[at][keep]), np.maximum(one_id, others[at][keep]), sim[keep]))
            if out and (k + 1 == len(ids) or sum(len(o[0]) for o in out) >= VALUES):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["i", "j", "sim"])
                out = []

    return placed.groupBy("bucket", "cell_row", "cell_column").applyInArrow(run, "i long, j long, sim double")
