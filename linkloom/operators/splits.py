"""Group-disjoint and similarity-stratified splits. Draws are by hash: see `determinism`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from .determinism import hash_number, take_hashed

TEST, TRAIN_ALL, OUTER = -1, -2, -1


def rule_set_key(rules: Column) -> Column:
    """Order-free key of a list of rules."""
    return F.array_join(F.array_sort(rules), "|")


def group_holdout(df: DataFrame, group: str, percent: float, seed: int) -> DataFrame:
    """``df`` with boolean ``held``: ceil(percent of the groups) first groups in hash order."""
    groups = df.select(group).distinct()
    k = -(-groups.count() * percent // 100)
    chosen = take_hashed(groups, int(k), seed, group).withColumn("__h", F.lit(True))
    return df.join(chosen, group, "left").withColumn("held", F.coalesce("__h", F.lit(False))).drop("__h")


def group_folds(df: DataFrame, group: str, folds: int, seed: int) -> DataFrame:
    """``df`` with ``fold``; a group lies in one fold. Folds are balanced by hash, not by a running size."""
    return df.withColumn("fold", (hash_number(seed, group) % folds).cast("int"))


def random_split(df: DataFrame, group: str, folds: int, percent: float, seed: int) -> DataFrame:
    """``split``: -1 for the held-out groups, else the fold of the rest."""
    held = group_folds(group_holdout(df, group, percent, seed), group, folds, seed + 1)
    return held.withColumn("split", F.when(F.col("held"), F.lit(TEST)).otherwise(F.col("fold"))).drop("held", "fold")


def straddling_groups(df: DataFrame, group: str, split: str) -> DataFrame:
    """Groups found on more than one side; must be empty."""
    return df.groupBy(group).agg(F.countDistinct(split).alias("n_splits")).filter("n_splits > 1")


def arranged(df: DataFrame, split: str, index: int) -> DataFrame:
    """``role`` of each row: index -2 trains on all, -1 tests on the held-out rows, k validates on fold k."""
    if index == TRAIN_ALL:
        return df.withColumn("role", F.lit("train"))
    if index == OUTER:
        return df.withColumn("role", F.when(F.col(split) == TEST, "test").otherwise("train"))
    inner = df.filter(F.col(split) != TEST)
    return inner.withColumn("role", F.when(F.col(split) == index, "val").otherwise("train"))


def expand_to_pairs(links: DataFrame, entity_split: DataFrame, key: str) -> DataFrame:
    """All pairs of the split entities."""
    return links.join(entity_split, key)


def level_draw(points: DataFrame, key: str, cluster: str, sampled: DataFrame, fraction: float, levels: int, seed: int) -> DataFrame:
    """Points of one level's draw: clusters without a sampled point, in hash order, max(1, fraction / levels
    of the cluster count) of them, with all their points. Points without a cluster are their own."""
    hit = points.join(sampled.select(key).distinct(), key, "left_semi").select(cluster).distinct()
    candidates = points.select(cluster).distinct().join(hit, cluster, "left_anti")
    n = max(1, int(fraction / levels * points.select(cluster).distinct().count()))
    chosen = take_hashed(candidates, n, seed, cluster)
    return points.join(chosen, cluster, "left_semi").select(key)


def stratified_split(points: DataFrame, key: str, level_columns: list[str], folds: int, test_percent: float, seed: int) -> DataFrame:
    """(key, split) by similarity level, coarse first: a share of whole clusters at each level goes to
    the test side (-1), then to folds 0..folds-2; what is left is the last fold.

    ``level_columns`` hold the cluster of each point by cutoff, ascending. The driver loops over
    folds and levels only; each draw is written before the next.
    """
    left = points
    done: DataFrame | None = None
    inner = (100 - test_percent) / 100 / folds
    for split, fraction in [(TEST, test_percent / 100), *((f, inner) for f in range(folds - 1))]:
        taken: DataFrame | None = None
        for level, column in enumerate(level_columns):
            known = taken if taken is not None else left.select(key).limit(0)
            draw = written(level_draw(left, key, column, known, fraction, len(level_columns), seed + 31 * (split + 2) + level), "draw")
            taken = draw if taken is None else written(taken.unionByName(draw).distinct(), "drawn")
        part = taken.withColumn("split", F.lit(split))
        done = part if done is None else done.unionByName(part)
        left = written(left.join(taken, key, "left_anti"), "left")
    return done.unionByName(left.select(key).withColumn("split", F.lit(folds - 1)))


def novelty_split(rows: DataFrame, known: list[tuple[DataFrame, str]], keep: Column) -> DataFrame:
    """Rows that satisfy ``keep`` and whose keys none of the earlier tables hold."""
    out = rows.filter(keep)
    for earlier, key in known:
        out = out.join(earlier.select(key).distinct(), key, "left_anti")
    return out


def oversample_positives(pairs: DataFrame, label: str, multiple: int) -> DataFrame:
    """Positives repeated ``multiple`` times."""
    copies = F.explode(F.array_repeat(F.lit(1), F.when(F.col(label) == 1, F.lit(multiple)).otherwise(F.lit(1))))
    return pairs.select("*", copies.alias("__c")).drop("__c")


def first_rows(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """One row a key: the first in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
